"""Experiment tables."""

from pyspark.sql import functions as F

from quercus.operators import experiments as ops
from quercus.plans.registry import query, rounded
from quercus.sources.tables import runs, table

LONG = """long AS (SELECT run_id, model, 'eval_bleu' AS metric, eval_bleu AS score FROM runs UNION ALL SELECT run_id, model, 'eval_rouge2', eval_rouge2 FROM runs)"""
STATES = "states AS (SELECT *, state = 'finished' AS is_success, regexp_extract(run_name, '-gc(\\d)-', 1) = '1' AS gradient_checkpointing, " \
         "regexp_extract(run_name, '-ctx(\\d+)-', 1)::INT AS context_length, regexp_extract(run_name, '_rv(\\d+)-', 1)::INT AS lora_rvalue FROM runs)"


def long(spark, sf):
    return ops.unpivot_metrics(runs(spark, sf), ["run_id", "model"], ["eval_bleu", "eval_rouge2"])


def states(spark, sf):
    return ops.recode_and_fill(ops.parse_run_name_regex(runs(spark, sf)))


@query(
    "SELECT run_id, state = 'finished' AS is_success, coalesce(eval_bleu, 100) AS eval_bleu FROM (SELECT run_id, lower(upper(state)) AS state, eval_bleu FROM runs)", ["runs"]
)
def recode_and_fill(spark, sf):
    df = runs(spark, sf).withColumn("state", F.when(F.col("run_id") % 2 == 0, F.upper("state")).otherwise(F.col("state")))
    return ops.recode_and_fill(df, fill={"eval_bleu": 100.0}).select("run_id", "is_success", "eval_bleu")


@query("SELECT run_id, eval_bleu AS \"eval bleu\", eval_rouge2 AS \"gnv map\", memory_bytes AS \"grad norm\" FROM runs", ["runs"])
def rename_metric_columns(spark, sf):
    df = runs(spark, sf).select("run_id", "eval_bleu", F.col("eval_rouge2").alias("eval/gnv_mean_average_precision"), F.col("memory_bytes").alias("train/grad_norm"))
    out = ops.rename_metric_columns(df, {"eval/gnv_mean_average_precision": "eval/gnv_map"})
    return out.withColumnRenamed("run id", "run_id")


@query("SELECT run_id, run_name, model, eval_bleu, eval_rouge2 FROM runs WHERE eval_bleu IS NOT NULL", ["runs"])
def prune_columns(spark, sf):
    return ops.prune_columns(runs(spark, sf), ["state", "memory_bytes"], "eval_bleu")


@query("SELECT run_id, coalesce(eval_bleu, eval_rouge2) AS eval_bleu, eval_rouge2 FROM runs", ["runs"])
def coalesce_metric_pairs(spark, sf):
    return ops.coalesce_metric_pairs(runs(spark, sf), {"eval_bleu": "eval_rouge2"}).select("run_id", "eval_bleu", "eval_rouge2")


@query(
    "SELECT run_id, CAST((p_size * 8) AS VARCHAR) AS rvalue, 'labeled' AS input, lower(p_type) AS target, 'labeled ' || lower(p_type) AS \"input-target\", '4bit' AS quantization "
    "FROM runs JOIN part ON p_partkey = run_id",
    ["runs"],
)
def parse_run_name_split(spark, sf):
    df = runs(spark, sf).withColumn("run_name", F.replace("run_name", F.lit("-gc0-"), F.lit("-template-"))).withColumn(
        "run_name", F.replace("run_name", F.lit("-gc1-"), F.lit("-template-"))
    )
    out = ops.parse_run_name_split(df, "run_name", 0, 1, 4)
    quant = ops.parse_quantization(out.select("*"), "run_name", 0, 3)
    return quant.select("run_id", "rvalue", "input", "target", "input-target", "quantization")


@query(f"WITH {STATES} SELECT run_id, gradient_checkpointing, context_length, lora_rvalue FROM states", ["runs"])
def parse_run_name_regex(spark, sf):
    return ops.parse_run_name_regex(runs(spark, sf)).select("run_id", "gradient_checkpointing", "context_length", "lora_rvalue")


@query("SELECT run_id, list_extract(string_split(run_name, '-'), -3) || '-' || list_extract(string_split(run_name, '-'), -2) || '-' || list_extract(string_split(run_name, '-'), -1) AS short FROM runs", ["runs"])
def short_model_name(spark, sf):
    from quercus.functions.text import short_model_name as short

    return runs(spark, sf).select("run_id", short(F.col("run_name")).alias("short"))


@query("SELECT run_id, round(memory_bytes / 1073741824e0, 9) AS gib FROM runs", ["runs"])
def bytes_to_gib(spark, sf):
    return rounded(runs(spark, sf).select("run_id", ops.bytes_to_gib(F.col("memory_bytes")).alias("gib")), "gib")


@query("SELECT run_id, 'Mistral' AS dataset, true AS finetuned FROM runs", ["runs"])
def tag_constant(spark, sf):
    return ops.tag_constant(runs(spark, sf).select("run_id"), dataset="Mistral", finetuned=True)


@query(
    "SELECT p_partkey AS run_id, 'op' || CASE WHEN p_partkey % 2 = 0 THEN 'awtor' ELSE 'awbn8' END || '-rv' || p_size || '-ty' || replace(p_brand, '#', '') AS label, "
    "'opa' || replace(p_brand, '#' || substr(p_brand, 7), '') AS letters FROM part"
)
def run_label(spark, sf):
    optimizer = F.when(F.col("p_partkey") % 2 == 0, F.lit("adamw_torch")).otherwise(F.lit("adamw_bnb_8bit"))
    values = {"optimizer": optimizer, "r": F.col("p_size"), "skip": F.col("p_name"), "type": F.col("p_brand")}
    names = {"optimizer": "op", "r": "rv", "skip": "no", "type": "ty"}
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("run_id"), ops.run_label(values, names).alias("label"),
        ops.run_label({"type": F.col("p_brand")}, {"type": "opa"}, letters_only=True).alias("letters"),
    )


@query(
    "SELECT * FROM (SELECT DISTINCT p_brand AS brand FROM part), (SELECT DISTINCT p_type AS kind FROM part), (SELECT DISTINCT p_size AS size FROM part)"
)
def parameter_grid(spark, sf):
    """Every combination of the parameter values that occur; each list is a small parameter domain."""
    lists = table(spark, sf, "part").agg(
        F.collect_set("p_brand").alias("brand"), F.collect_set("p_type").alias("kind"), F.collect_set("p_size").alias("size")
    )
    return ops.parameter_grid(lists, ["brand", "kind", "size"])


@query(f"WITH {STATES} SELECT run_id, run_name, CASE WHEN is_success THEN 'finished' ELSE 'failed' END AS half FROM states WHERE is_success IS NOT NULL", ["runs"])
def split_success(spark, sf):
    finished, failed = ops.split_success(states(spark, sf))
    return finished.select("run_id", "run_name", F.lit("finished").alias("half")).unionByName(
        failed.select("run_id", "run_name", F.lit("failed").alias("half"))
    )


@query(f"WITH {STATES} SELECT context_length, gradient_checkpointing, round(avg(is_success::INT) * 100, 9) AS success_rate FROM states GROUP BY ALL", ["runs"])
def success_rate_by_pair(spark, sf):
    return rounded(ops.success_rate_by_pair(states(spark, sf), "context_length", "gradient_checkpointing"), "success_rate")


@query(
    f"WITH {STATES} SELECT lora_rvalue, " + ", ".join(f"round(avg(is_success::INT) FILTER (context_length = {c}) * 100, 9) AS \"{c}\"" for c in (1024, 2048, 3072))
    + " FROM states GROUP BY ALL",
    ["runs"],
)
def pivot_rate(spark, sf):
    return rounded(ops.pivot_rate(states(spark, sf), "lora_rvalue", "context_length", [1024, 2048, 3072]), "1024", "2048", "3072")


@query(f"WITH {LONG} SELECT * FROM long", ["runs"])
def unpivot_metrics(spark, sf):
    return long(spark, sf)


@query(f"WITH {LONG} SELECT * FROM long WHERE metric IN ('eval_bleu', 'eval_meteor')", ["runs"])
def metric_family(spark, sf):
    return ops.metric_family(long(spark, sf), ["eval_bleu", "eval_meteor"])


@query(
    f"""WITH {LONG}, q AS (SELECT metric, model, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3, count(score) AS n FROM long WHERE score IS NOT NULL GROUP BY ALL)
SELECT metric, model, round(any_value(q1), 9) AS q1, round(any_value(median), 9) AS median, round(any_value(q3), 9) AS q3, any_value(n) AS n,
 round(min(score) FILTER (score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 9) AS whisker_low, round(max(score) FILTER (score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 9) AS whisker_high,
 count(*) FILTER (NOT (score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS n_outliers FROM long JOIN q USING (metric, model) WHERE score IS NOT NULL GROUP BY metric, model""",
    ["runs"],
)
def box_stats(spark, sf):
    return rounded(ops.box_stats(long(spark, sf), ["metric", "model"]), "q1", "median", "q3", "whisker_low", "whisker_high")


@query(f"WITH {LONG} SELECT model, metric, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS sd FROM long GROUP BY ALL", ["runs"])
def mean_sd_by_group(spark, sf):
    return rounded(ops.mean_sd_by_group(long(spark, sf), ["model", "metric"]), "mean", "sd")


@query(f"WITH {LONG} SELECT metric, round(regr_slope(score, run_id), 9) AS slope, round(regr_intercept(score, run_id), 9) AS intercept FROM long GROUP BY metric", ["runs"])
def linear_fit_by_group(spark, sf):
    return rounded(ops.linear_fit_by_group(long(spark, sf), ["metric"], "run_id", "score"), "slope", "intercept")


@query(f"WITH {STATES} SELECT lora_rvalue, context_length, count(*) FILTER (NOT is_success) AS n_failed, count(*) FILTER (is_success) AS n_success FROM states GROUP BY ALL", ["runs"])
def success_failed_counts(spark, sf):
    return ops.success_failed_counts(states(spark, sf), ["lora_rvalue", "context_length"])


@query(
    "SELECT run_id, eval_bleu, NULL::DOUBLE AS eval_rouge2 FROM runs WHERE run_id % 2 = 0 UNION ALL SELECT run_id, NULL, eval_rouge2 FROM runs WHERE run_id % 2 = 1", ["runs"]
)
def union_runs(spark, sf):
    df = runs(spark, sf)
    return ops.union_runs(df.filter("run_id % 2 = 0").select("run_id", "eval_bleu"), df.filter("run_id % 2 = 1").select("run_id", "eval_rouge2"))


@query("SELECT run_id, eval_bleu, eval_rouge2, model FROM runs", ["runs"])
def sort_multi_key(spark, sf):
    df = runs(spark, sf).select("run_id", "eval_bleu", "eval_rouge2", "model")
    return df.orderBy(F.desc("model"), F.desc("eval_rouge2"), F.desc("eval_bleu"), F.desc("run_id"))
