"""Quality rules: base counts per text, then robust multivariate outliers per language and source.

Only DataFrame functions. Texts are read once, for the counts; everything after works on a written table of
numbers. The minimum covariance determinant is reached by concentration steps: start from medians and
quartile ranges, take the share SUPPORT of each group that is nearest, re-estimate mean and covariance from
it, and repeat. Quantiles inside a group are read off counts per bin, so no group is ever gathered. A text
is rejected if its squared distance, made consistent for normal data, is beyond CUTOFF.

A group with fewer than MIN_ROWS estimates is judged with the other small groups of its language, and, if
those are too few as well, with all such rows together.

Defined cases: a null text has no words and fails the base rules; null language or source is a group of its
own; groups without spread are kept apart from zero by the floors; an empty table gives no rows; repeated
rows each get a verdict, the same one; very long texts are counted whole; columns besides id, text, lang and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quercus.llm.common import settle

SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
MIN_ROWS = 60
SUPPORT = 0.75
STEPS = 4
#: 0.999 quantile of the chi-squared distribution with five degrees of freedom.
CUTOFF = 20.52
#: SUPPORT over the share of the chi-squared distribution with 7 degrees below the SUPPORT quantile of that with 5.
CONSISTENCY = 0.75 / 0.53113
#: Least standard deviation of each statistic: log words, word length, symbol, repeated-line and repeated-word roots.
#: In a group without repeats a text goes on repeated lines, or words, alone beyond CUTOFF * 0.12^2 = 30 % of them.
FLOORS = {"s_words": 0.3, "s_word_length": 0.25, "s_symbols": 0.06, "s_lines": 0.12, "s_repeats": 0.12}
STATISTICS = list(FLOORS)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more in the list."""

    def covered(marks: Column) -> Column:
        def same(ordered: Column) -> Column:
            twice = F.filter(
                ordered,
                lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"]),
            )
            places = F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
            return F.size(F.array_distinct(F.flatten(places)))

        located = F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(marks)) == F.size(marks), F.lit(0)).otherwise(
            let(F.array_sort(located), same)
        )

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        marks = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(marks, covered))

    return let(words, windows)


def base_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """id, _group, _lang, the five base counts, n_lines, base_failed: numbers instead of texts."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.filter(F.split("_text", SPACE + "+"), lambda w: w != "")
    worded = F.filter(F.split("_text", "\n"), lambda line: line.rlike(NOT_SPACE))

    def part(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-"))

    counted = docs.select(
        id_column, F.concat(part(lang), F.lit("\x1f"), part(source)).alias("_group"), part(lang).alias("_lang"),
        text.alias("_text"),
    ).select(
        id_column, "_group", "_lang",
        let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r"))).alias("_w"),
        let(worded, lambda rows: F.struct(F.size(rows).alias("n"), F.size(F.array_distinct(rows)).alias("d"))).alias("_l"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).alias("_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).alias("_symbols"),
    )
    counts = {
        "n_words": "_w.n", "word_chars": "_chars", "n_symbols": "_symbols", "n_repeat_words": "_w.r", "n_lines": "_l.n",
    }
    rows = counted.select(
        id_column, "_group", "_lang", *[F.col(c).cast("bigint").alias(n) for n, c in counts.items()],
        (F.col("_l.n") - F.col("_l.d")).cast("bigint").alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def statistics(counts: DataFrame) -> DataFrame:
    """The transformed statistic vector, as columns."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.withColumns(
        {
            "s_words": F.log1p(F.col("n_words").cast("double")),
            "s_word_length": F.col("word_chars") / n,
            "s_symbols": F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
            "s_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "s_repeats": F.sqrt(F.col("n_repeat_words") / n),
        }
    )


def pooled(rows: DataFrame, min_rows: int) -> DataFrame:
    """(_group, _pool): which rows share an estimate."""
    sizes = rows.groupBy("_group", "_lang").agg(F.count(F.lit(1)).alias("_n"))
    small = F.concat(F.lit("small:"), "_lang")
    first = sizes.withColumn("_pool", F.when(F.col("_n") >= min_rows, F.col("_group")).otherwise(small))
    # one row per group, summed by language
    together = F.sum("_n").over(Window.partitionBy("_pool"))
    return first.withColumn("_m", together).select(
        "_group", F.when(F.col("_m") >= min_rows, F.col("_pool")).otherwise(F.lit("small:")).alias("_pool")
    )


def quantile_bins(binned: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """For every key the first bin at which the running count reaches each share; ``binned`` has keys and _bin."""
    counts = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*keys))})
    return placed.groupBy(*keys).agg(
        *[F.min(F.when(F.col("_upto") >= F.col("_all") * s, F.col("_bin"))).alias(n) for n, s in shares.items()]
    )


BIN = 200  # bins per unit of a statistic
LOG_BIN = 50  # bins per unit of the logarithm of a distance


def first_estimate(rows: DataFrame) -> DataFrame:
    """Per pool: the medians m_i and a diagonal factor l_i_j from quartile ranges."""
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.floor(F.col(s) * BIN).alias("b")) for s in STATISTICS]))
    binned = rows.select("_pool", cells.alias("_c")).select("_pool", F.col("_c.s").alias("_s"), F.col("_c.b").alias("_bin"))
    found = quantile_bins(binned, ["_pool", "_s"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = found.groupBy("_pool").agg(
        *[F.max(F.when(F.col("_s") == s, F.struct("q1", "q2", "q3"))).alias(f"_{s}") for s in STATISTICS]
    )
    out = [(F.col(f"_{s}.q2") + 0.5) / BIN for s in STATISTICS]
    spread = [(F.col(f"_{s}.q3") - F.col(f"_{s}.q1")) / (BIN * 1.349) for s in STATISTICS]
    factor = {}
    for i, s in enumerate(STATISTICS):
        for j in range(i + 1):
            factor[f"l_{i}_{j}"] = F.greatest(spread[i], F.lit(FLOORS[s])) if i == j else F.lit(0.0)
    return wide.select("_pool", *[m.alias(f"m_{i}") for i, m in enumerate(out)], *[c.alias(n) for n, c in factor.items()])


def distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with _d, the squared Mahalanobis distance, by forward substitution in the triangular factor."""
    joined = rows.join(estimate, "_pool")
    for i, s in enumerate(STATISTICS):
        rest = F.col(s) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"_y{j}")
        joined = joined.withColumn(f"_y{i}", rest / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, len(STATISTICS))), F.col("_y0") * F.col("_y0"))
    return joined.select(*rows.columns, total.alias("_d"))


def concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The next estimate: mean and triangular factor of the covariance of the nearest SUPPORT of each pool."""
    far = distance(rows, estimate).withColumn("_bin", F.floor(F.log(F.col("_d") + 1e-9) * LOG_BIN))
    # written, so that its size is known: one row per pool is broadcast, and a hot pool stays where it is
    limit = settle(quantile_bins(far.select("_pool", "_bin"), ["_pool"], {"_limit": SUPPORT}), "quality-limit")
    near = far.join(limit, "_pool").filter(F.col("_bin") <= F.col("_limit"))
    p = len(STATISTICS)
    moments = near.groupBy("_pool").agg(
        *[F.avg(s).alias(f"m_{i}") for i, s in enumerate(STATISTICS)],
        *[F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)],
    )
    # the consistency factor is applied before the floors, which are absolute
    factor = moments
    for i, s in enumerate(STATISTICS):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}") * CONSISTENCY
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            if i == j:
                value = F.sqrt(F.greatest(rest, F.lit(0.0)) + FLOORS[s] ** 2)
            else:
                value = rest / F.col(f"l_{j}_{j}")
            factor = factor.withColumn(f"l_{i}_{j}", value)
    return factor.select("_pool", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])


def judge(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang: str = "lang", source: str = "source",
    cutoff: float = CUTOFF, min_rows: int = MIN_ROWS, steps: int = STEPS,
) -> DataFrame:
    """id, the five base counts, base_failed, distance (null if base_failed), kept of every row."""
    counts = settle(base_counts(docs, id_column, text_column, lang, source), "quality-counts")
    good = statistics(counts.filter(~F.col("base_failed")))
    pools = settle(pooled(good, min_rows), "quality-pools")
    rows = good.join(pools, "_group").select("_pool", *STATISTICS)
    estimate = settle(first_estimate(rows), "quality-start")
    for step in range(steps):
        estimate = settle(concentrated(rows, estimate), f"quality-step-{step}")
    judged = distance(good.join(pools, "_group"), estimate)
    columns = [id_column, *BASE, "base_failed"]
    failed = counts.filter("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.select(*columns, F.col("_d").alias("distance"), (F.col("_d") <= cutoff).alias("kept")).unionByName(failed)
