"""Reproducible choices: every draw is a hash of (seed, key), equal on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quercus.operators.ordering import as_scalar

BATCH = 1000


def seeded_hash(seed: int, key: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def hash_number(digest: Column, start: int = 1) -> Column:
    """Eight hex digits as a number."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def split_75_5_20(df: DataFrame, seed: int = 0, key: str = "row_id", shares: tuple[float, float] = (0.75, 0.80)) -> DataFrame:
    """Seeded shuffle cut at int(.75 n) and int(.80 n): exact sizes.

    The shuffled order is the order of the keys' hashes. Hashes are counted by their first four hex
    digits; that tells which of the 65,536 buckets holds each cut, and only rows of these two buckets
    are ordered to find the hash at the cut. Rows then compare their hash with the two cuts, so the
    table itself is neither sorted nor shuffled.
    """
    digest = seeded_hash(seed, F.col(key))
    marked = df.select(F.concat(digest, F.col(key).cast("string")).alias("_h"))
    buckets = marked.groupBy(F.substring("_h", 1, 4).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # at most 65,536 rows
    placed = buckets.withColumn("_end", F.sum("_n").over(upto)).withColumn("_begin", F.col("_end") - F.col("_n"))
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    placed = placed.withColumn("_total", total)
    cuts = []
    for i, share in enumerate(shares):
        place = F.floor(F.col("_total") * F.lit(share)).cast("bigint")
        holds = (F.col("_begin") <= place) & (place < F.col("_end"))
        cuts.append(placed.filter(holds).select(F.lit(i).alias("_cut"), "_b", (place - F.col("_begin")).alias("_skip")))
    wanted = cuts[0].unionByName(cuts[1])
    inside = marked.withColumn("_b", F.substring("_h", 1, 4)).join(F.broadcast(wanted), "_b")  # two rows
    order = Window.partitionBy("_cut").orderBy("_h")
    at = inside.withColumn("_rn", F.row_number().over(order) - 1).filter(F.col("_rn") == F.col("_skip"))
    borders = as_scalar(at.agg(*[F.max(F.when(F.col("_cut") == i, F.col("_h"))).alias(f"c{i}") for i in (0, 1)]))
    own = F.concat(digest, F.col(key).cast("string"))
    beyond = F.lit("~")  # sorts after every hex digit
    return df.withColumn(
        "split",
        F.when(own < F.coalesce(borders["c0"], beyond), F.lit("train"))
        .when(own < F.coalesce(borders["c1"], beyond), F.lit("valid"))
        .otherwise(F.lit("test")),
    )


def pick_one(items: Column, seed: int, key: Column) -> Column:
    """One element of a list, chosen by the row's hash; null for an empty list."""
    return F.get(items, F.pmod(hash_number(seeded_hash(seed, key)), F.nullif(F.size(items), F.lit(0))).cast("int"))


def few_shot_examples(
    df: DataFrame, n: int, seed: int = 0, key: str = "row_id", inputs: str = "inputs", target: str = "target", batch: int = BATCH
) -> DataFrame:
    """``examples``: n other rows of the same batch, never the row itself, each with one question.

    Rows fall into about count/batch hash buckets and get a place there. Row at place p takes the
    places p + d for n different non-zero steps d, so each row asks for n rows by key and no pair is
    built that is not used.
    """
    n_buckets = as_scalar(df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(batch)), F.lit(1)).cast("bigint").alias("n")))["n"]
    digest = seeded_hash(seed, F.col(key))
    keyed = df.select(key, digest.alias("_h")).withColumn("_b", F.pmod(hash_number(F.col("_h")), n_buckets))
    size = F.count(F.lit(1)).over(Window.partitionBy("_b"))
    placed = keyed.withColumn("_p", F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1).withColumn("_m", size)
    first = F.pmod(hash_number(F.col("_h"), 9), F.greatest(F.col("_m") - 1, F.lit(1)))
    steps = F.when(
        F.col("_m") > 1,
        F.transform(
            F.sequence(F.lit(0), F.least(F.lit(n), F.col("_m") - 1).cast("int") - 1),
            lambda j: F.struct(j.alias("j"), F.pmod(F.col("_p") + 1 + F.pmod(first + j, F.col("_m") - 1), F.col("_m")).alias("q")),
        ),
    )
    asked = placed.select(F.col(key).alias("_asker"), "_b", F.inline(steps))
    named = asked.join(placed.select("_b", F.col("_p").alias("q"), F.col(key).alias("_example")), ["_b", "q"])
    shown = df.select(
        F.col(key).alias("_example"),
        F.struct(pick_one(F.col(inputs), seed + 1, F.col(key)).alias("question"), F.col(target).alias("target"), F.col(key).alias("id")).alias("_ex"),
    )
    gathered = (
        named.join(shown, "_example").groupBy("_asker")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "_ex"))), lambda x: x["_ex"]).alias("examples"))
    )  # n per row
    none = F.array().cast("array<struct<question:string,target:string,id:bigint>>")
    return df.join(gathered, F.col(key) == F.col("_asker"), "left").withColumn("examples", F.coalesce("examples", none)).drop("_asker")


def first_acceptable_attempt(attempts: DataFrame, group: str, ok: Column, limit: int, answer: str = "answer", attempt: str = "attempt") -> DataFrame:
    """First acceptable of up to ``limit`` attempts (0: none are made, below 0: no cap); attempts
    are numbered from 0. No acceptable one: skipped."""
    allowed = F.lit(True) if limit < 0 else F.col(attempt) < limit
    good = ok & allowed
    return attempts.groupBy(group).agg(
        F.min_by(F.when(good, F.col(answer)), F.when(good, F.col(attempt))).alias("result"),
        (F.count_if(good) == 0).alias("is_skipped"),
    )


def mark_too_long(df: DataFrame, tokens: Column, context_length: int) -> DataFrame:
    """A prompt of exactly the context length still fits."""
    too_long = tokens > context_length
    return df.withColumn("is_prompt_too_long", too_long).withColumn("is_skipped", too_long)
