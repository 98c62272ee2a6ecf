"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_RUNS the runs per query (the best counts).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quercus.session import build_session, drop_scratch  # noqa: E402

GROUPS = {
    "cleaning": ["dedup_keep_first", "iqr_outliers", "describe_lengths", "duplicate_ratio", "strip_markup"],
    "rewriting": ["add_prefixes", "add_limit", "extract_ids", "label_query", "extract_placeholders", "fill_placeholders"],
    "executions": ["execution_status", "error_classes", "error_index", "status_counts", "error_class_examples", "reexecution_compare"],
    "answers": ["response_cells", "key_columns", "column_pair_join", "nested_value_metrics", "cross_metrics", "id_column_metrics", "final_report"],
    "sampling": ["split_75_5_20", "few_shot_examples"],
    "experiments": ["parse_run_name_split", "parse_run_name_regex", "box_stats", "pivot_rate", "linear_fit_by_group"],
    "overlap": ["rouge_n", "corpus_bleu", "meteor_exact", "rouge_l"],
    "steps": ["ordered_steps"],
}


def split_copy(spark, sf_dir: str, files: int) -> str:
    """The tables in as many files as there are cores: each given table is one file of one row group, which one task reads.

    Large tables have many files; the copy, which is not timed, stands in for that.
    """
    out = tempfile.mkdtemp(prefix="quercus-bench-")
    for name in sorted(n for n in os.listdir(sf_dir) if n.endswith(".parquet")):
        spark.read.parquet(f"{sf_dir}/{name}").repartition(files).write.parquet(f"{out}/{name}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        f"local[{cpus}]", "quercus-bench",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quercus.plans import QUERIES

    given, sf_dir = sf_dir, split_copy(spark, sf_dir, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in (n for group in GROUPS.values() for n in group):
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
            drop_scratch(spark)
        times[name] = round(best, 3)
    spark.stop()
    groups = {g: round(sum(times[n] for n in names), 3) for g, names in GROUPS.items()}
    print(
        json.dumps(
            {
                "metric": "total wall seconds of the headline queries, best run each",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "groups": groups,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
