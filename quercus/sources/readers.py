"""Readers: corpus tables, column-oriented JSON, run tables, evaluation files."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quercus.session import settle

PARQUET = (".parquet", ".parquet.gzip")
#: An object whose first value is an object with a number as its first key.
COLUMNAR = re.compile(r'\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\{\s*"-?[0-9]+"\s*:')


def _exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that the path belongs to, not the driver's disk."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_dataset(spark: SparkSession, path: str | Path, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a table by its extension.

    ``.json`` is a table of JSON lines, or ``{column: {number: value}}`` objects as the sinks write
    them; the start of the file tells which. The latter, of any size, have a text column ``index`` and text values.
    """
    if not isinstance(path, (str, Path)):
        raise TypeError("path must be a string or a Path")
    text = str(path)
    if not _exists(spark, text):
        raise FileNotFoundError(f"no table at {text}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    name = os.path.basename(text.rstrip("/"))
    if name.endswith(PARQUET):
        return reader.parquet(text)
    if name.endswith(".json"):
        # read up to the first quotes, as a whole table may stand in one line
        start = "\"".join(r.value for r in spark.read.option("lineSep", "\"").text(text).take(20)) if schema is None else ""
        return load_columnar_objects(spark, text) if COLUMNAR.match(start) else reader.json(text)
    raise ValueError(f"use parquet or json, found: {name}")


def load_columnar_json(
    spark: SparkSession, path: str, columns: list[str] | None = None, index: str = "index", multi_line: bool = False
) -> DataFrame:
    """Read ``{column: {index: value}}`` objects, one a line (or one a file), all values as text.

    Columns that all have the same indexes in the same order are zipped by place: no shuffle. In any
    other object a value goes to its index, and an index that a column lacks gives null there. Without
    ``columns`` the names are read off the data first. An object of a line is parsed by one task;
    files of one object each (``multi_line``) are read by ``load_columnar_objects``.
    """
    if multi_line:
        return load_columnar_objects(spark, path, columns, index)
    parsed = (
        spark.read.text(path, recursiveFileLookup=True)
        .select(F.monotonically_increasing_id().alias("_object"), F.from_json("value", "map<string,map<string,string>>").alias("m"))
        .filter(F.col("m").isNotNull() & (F.size("m") > 0))
    )
    if columns is None:
        names = parsed.select(F.explode(F.map_keys("m")).alias("c")).distinct()
        columns = sorted(r.c for r in names.toLocalIterator())
    of = {c: F.try_element_at(F.col("m"), F.lit(c)) for c in columns}
    first = F.map_keys(F.element_at(F.map_values("m"), 1))
    even = reduce(lambda x, y: x & y, [F.coalesce(F.map_keys(v) == first, F.lit(False)) for v in of.values()], F.lit(True))
    parts = [first.alias(index)] + [F.map_values(v).alias(c) for c, v in of.items()]
    zipped = parsed.filter(even).select(*parts).select(F.explode(F.arrays_zip(index, *columns)).alias("r")).select("r.*")
    cells = (
        parsed.filter(~even).select("_object", F.explode("m").alias("_c", "_v"))
        .select("_object", "_c", F.explode("_v").alias(index, "_value"))
    )
    ragged = cells.groupBy("_object", index).agg(*[F.max(F.when(F.col("_c") == c, F.col("_value"))).alias(c) for c in columns])
    return zipped.unionByName(ragged.drop("_object"))


def load_columnar_objects(
    spark: SparkSession, path: str, columns: list[str] | None = None, index: str = "index"
) -> DataFrame:
    """Read ``{column: {index: value}}`` objects of any size and layout by byte ranges, all values as text.

    One row per (object, index); a cell goes to its index, and an index that a column lacks gives null
    there. A column that repeats an index keeps the greatest text. A column whose value is no object has
    no cells, an index that only such columns or none would have gives no row. Columns without any cell
    are named in ``columns`` or not there.
    """
    cells = settle(columnar_cells(spark, path), "columnar-cells")
    if columns is None:
        columns = sorted(r.column for r in cells.select("column").distinct().toLocalIterator())
    values = [F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"_{i}") for i, c in enumerate(columns)]
    rows = cells.groupBy("file", "object", "index").agg(F.lit(0).alias("_"), *values)
    return rows.select(F.col("index").alias(index), *[F.col(f"_{i}").alias(c) for i, c in enumerate(columns)])


def columnar_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, object, column, index, value): the cells of ``{column: {index: value}}`` objects.

    Files are read as the pieces between quotes, by byte ranges of ``spark.sql.files.maxPartitionBytes``. A
    quote after an odd number of backslashes is part of a text, whatever stands before, so a first pass
    counts for each range the other quotes, and the brackets outside and inside of texts if the range
    begins outside of one. Running sums over the ranges tell how each begins, and a second pass cuts
    it into columns and cells. What crosses the end of a range is put together by range, a row or two each.
    """
    pieces = spark.read.option("lineSep", '"').option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value"
    )
    ranges = pieces.mapInPandas(count_quotes, "file string, at bigint, quotes bigint, outside bigint, inside bigint")
    ranges = ranges.groupBy("file", "at").agg(*[F.sum(c).alias(c) for c in ("quotes", "outside", "inside")])
    # one row per range: their number is the bytes read by the bytes of a range
    starts: dict[str, dict[int, tuple[bool, int]]] = {}
    last: tuple[str | None, bool, int] = (None, False, 0)
    for r in ranges.orderBy("file", "at").toLocalIterator():
        _, within, depth = last if last[0] == r.file else (r.file, False, 0)
        starts.setdefault(r.file, {})[r["at"]] = (within, depth)
        last = (r.file, within ^ bool(r.quotes % 2), depth + (r.inside if within else r.outside))
    shared = spark.sparkContext.broadcast(starts)
    schema = "file string, at bigint, no bigint, kind string, depth int, object bigint, column string, raw string"
    cut = settle(pieces.mapInPandas(lambda batches: cut_ranges(batches, shared.value), schema), "columnar-parts")

    # the parts that cross ranges, in order; a run of open parts ends with the first part of a later range
    by_file = Window.partitionBy("file").orderBy("at", "no").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.filter(F.col("kind").isin("open", "ends at {", "ends"))
    run = F.coalesce(F.sum((F.col("kind") != "open").cast("bigint")).over(by_file), F.lit(0))
    joined = parts.withColumn("run", run).groupBy("file", "run").agg(
        F.max("at").alias("at"), F.max_by("kind", F.struct("at", "no")).alias("kind"),
        F.max_by("depth", F.struct("at", "no")).alias("depth"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "no", "raw"))), lambda p: p["raw"]), "").alias("raw"),
    )
    header = (F.col("kind") == "ends at {") & (F.col("depth") == 1)
    name = F.map_keys(F.from_json(F.concat(F.lit("{"), "raw", F.lit("0}")), "map<string,string>"))
    crossing = joined.filter(F.col("kind") != "open").select(
        "file", "at", F.lit(0).alias("late"), "kind", "depth", "raw", F.when(header, F.try_element_at(name, F.lit(1))).alias("column"),
        ((F.col("kind") == "ends at {") & (F.col("depth") == 0)).cast("bigint").alias("objects"),
    )
    # how each range ends: its last column, and the objects that begin in it
    sums = cut.filter(F.col("kind") == "range").select(
        "file", "at", F.lit(1).alias("late"), "kind", "depth", "raw", "column", F.col("object").alias("objects")
    )
    upto = Window.partitionBy("file").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, -1)
    known = crossing.unionByName(sums).select(
        "*", F.last("column", ignorenulls=True).over(upto).alias("before"), F.coalesce(F.sum("objects").over(upto), F.lit(0)).alias("base")
    )
    known = settle(known, "columnar-ranges")
    whole = cut.filter(F.col("kind") == "cell").join(
        known.filter("late = 1").select("file", "at", "before", "base"), ["file", "at"]
    ).select("file", (F.col("base") + F.col("object")).alias("object"), F.coalesce("column", "before").alias("column"), "raw")
    met = known.filter((F.col("kind") == "ends") & (F.col("depth") == 2)).select(
        "file", F.col("base").alias("object"), F.col("before").alias("column"), "raw"
    )
    entry = F.from_json(F.concat(F.lit("{"), "raw", F.lit("}")), "map<string,string>")
    return whole.unionByName(met).filter(F.col("column").isNotNull()).select(
        "file", "object", "column", F.explode(entry).alias("index", "value")
    )


def _by_range(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, range, pieces) in the order of the file, a batch at a time."""
    for batch in batches:
        new = (batch["at"].diff() != 0) | (batch["file"] != batch["file"].shift())
        for _, group in batch.groupby(new.cumsum(), sort=False):
            yield group["file"].iat[0], int(group["at"].iat[0]), group["value"].tolist()


def _escaped(piece: str) -> bool:
    """Is the quote after this piece part of a text?"""
    return piece.endswith("\\") and (len(piece) - len(piece.rstrip("\\"))) % 2 == 1


def count_quotes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch and range: quotes that begin or end a text, and the balance of brackets by their parity."""
    quotes: dict[tuple[str, int], int] = {}
    for file, at, pieces in _by_range(batches):
        before = quotes.get((file, at), 0)
        n, balance = before, [0, 0]
        for p in pieces:
            balance[n % 2] += p.count("{") + p.count("[") - p.count("}") - p.count("]")
            n += not _escaped(p)
        quotes = {(file, at): n}  # a task reads its ranges one after the other
        yield pd.DataFrame({"file": [file], "at": [at], "quotes": [n - before], "outside": balance[:1], "inside": balance[1:]})


BOUND = re.compile(r"[{}\[\],]")


class _Cutter:
    """Cuts the pieces of one range at the brackets and commas of the first two levels."""

    def __init__(self, within: bool, depth: int):
        self.within, self.depth = within, depth
        self.raw: list[str] = []
        self.no, self.objects = 0, 0
        self.column: str | None = None
        self.rows: list[tuple] = []  # no, kind, depth, object, column, raw

    def ended(self, sign: str) -> None:
        raw = "".join(self.raw)
        self.raw = []
        if self.no == 0:  # what the range before it left open
            self.rows.append((0, "ends at {" if sign == "{" else "ends", self.depth, None, None, raw))
        elif sign == "{" and self.depth == 0:
            self.objects += 1
        elif sign == "{":
            self.column = json.loads(raw.strip().rstrip(":").rstrip())
        elif self.depth == 2 and raw.strip():
            self.rows.append((self.no, "cell", 2, self.objects, self.column, raw))
        self.no += 1

    def take(self, piece: str) -> None:
        if self.within:
            self.raw.append(piece)
        else:
            done = 0
            for m in BOUND.finditer(piece):
                sign = m.group()
                if (sign == "{" and self.depth < 2) or (sign in "}," and self.depth <= 2):
                    self.raw.append(piece[done : m.start()])
                    done = m.end()
                    self.ended(sign)
                self.depth += (sign in "{[") - (sign in "}]")
            self.raw.append(piece[done:])
        self.raw.append('"')
        self.within ^= not _escaped(piece)

    def finish(self) -> None:
        self.rows.append((self.no, "range", self.depth, self.objects, self.column, None))
        self.rows.append((self.no + 1, "open", self.depth, None, None, "".join(self.raw)))


def cut_ranges(batches: Iterator[pd.DataFrame], starts: dict) -> Iterator[pd.DataFrame]:
    """The cells of each range, what it ends of the range before and leaves open to the next, and how it ends."""
    cutter, place = None, None

    def made():
        names = ["no", "kind", "depth", "object", "column", "raw"]
        out = pd.DataFrame(cutter.rows, columns=names, dtype=object)
        out.insert(0, "at", place[1])
        out.insert(0, "file", place[0])
        cutter.rows = []
        return out

    for file, at, pieces in _by_range(batches):
        if (file, at) != place:
            if cutter:
                cutter.finish()
                yield made()
            cutter, place = _Cutter(*starts[file][at]), (file, at)
        for piece in pieces:
            cutter.take(piece)
            if len(cutter.rows) >= 10_000:
                yield made()
    if cutter:
        cutter.finish()
        yield made()


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)


def load_run_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def stack_eval_files(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame | None:
    """One row per one-object JSON file, columns united; None when the folder holds no file."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    try:
        return (reader if schema is None else reader.schema(schema)).json(path)
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def load_eval_tree(spark: SparkSession, path: str, metrics: T.StructType | str | None = None) -> DataFrame:
    """Metric files of a folder tree; input, target, model and dataset come from the names.

    A name is ``a_b_c_<input>_d_e_<target>.json`` in a folder ``<model>_x_<dataset>``. A folder
    written by Spark counts as a file: its part files and ``key=`` marks are skipped over.
    """
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    if metrics is not None:
        reader = reader.schema(f"metrics struct<{metrics}>" if isinstance(metrics, str) else metrics)
    df = reader.json(path).select("metrics.*", F.col("_metadata.file_path").alias("_path"))
    steps = F.filter(F.split("_path", "/"), lambda s: ~F.startswith(s, F.lit("part-")))
    steps = F.transform(steps, lambda s: F.regexp_replace(s, "^[^=]*=", ""))
    name = F.split(F.split(F.element_at(steps, -1), r"\.")[0], "_")
    folder = F.split(F.element_at(steps, -2), "_")

    def named(c):
        return F.replace(F.replace(c, F.lit("mistral"), F.lit("Mistral")), F.lit("llama3"), F.lit("Llama 3"))

    return df.select(
        *[c for c in df.columns if c != "_path"],
        F.replace(name[3], F.lit("templated"), F.lit("labeled")).alias("input"),
        F.replace(F.replace(name[6], F.lit("template"), F.lit("labeled")), F.lit("raw"), F.lit("basic")).alias("target"),
        named(folder[0]).alias("model"),
        named(folder[2]).alias("dataset"),
    )
