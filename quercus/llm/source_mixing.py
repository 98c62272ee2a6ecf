"""A mix of sources by target weights: Efraimidis-Spirakis sampling up to a budget of words per source.

Targets: each source has a share by its weight of SHARE times all words, at most MOST_EPOCHS times its own words; what
a source can't take goes to the others by weight, until none is above its limit.

Sampling: a source first gives as many complete epochs as fit its target. The rest is drawn without replacement: each
document has the key -ln(u) / quality, an exponential variable whose rate is the document's quality weight, u being a
hash of its id and text. Documents go by ascending key, their sizes are summed up, and those before the budget's end
are taken; the one in which the budget ends gives its first words only, so a source meets its target to the word.

The sorted order is never laid out. A key's logarithm is a number of KEY_BITS bits, with TIE_BITS of a row's hash
below it. Sizes are summed per source and leading digit, running sums of these (at most 65,536 per source) tell in
which digit the budget ends, and the next digit is looked at among those rows only. After all digits, the few rows
with exactly the boundary's number are put in order. So no document is shuffled, however large its source is: each
pass reads a written table of numbers and shuffles sums. No logarithm's digit can hold more than 4 in 10,000 of a
source's distinct documents, whatever their weights are, and rows that repeat are parted by the hash of their row.

Defined cases: a null text has no words, is never cut and takes 0; a null source is a source of its own, the last;
repeated rows are one document each, with the same key, and it is all the same which of them the budget reaches; a
null id counts as the empty text; very long texts are counted whole; a source without words has the target 0; an
empty table gives no rows; carried columns are kept in a struct and can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quercus.llm.common import settle, whole_row

#: Weights of the sources by code point of their names, repeated as often as needed.
WEIGHTS = (3, 1, 2)
#: The mix holds so many times the words of all sources, and at most so many times those of one source.
SHARE, MOST_EPOCHS = 1.5, 2
#: Least quality weight, so that every document can be drawn.
LEAST_QUALITY = 0.05
KEY_BITS, TIE_BITS = 48, 15
#: Shifts that leave the first digit, the first two digits, ... and at last the whole number.
SHIFTS = (47, 31, 15, 0)
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Number of words between white space of a text that is not null."""
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, WHITE_RUN))).cast("bigint")


def plainness(text: Column) -> Column:
    """Quality weight of a text: the share of its characters, white space aside, that are no ASCII digits or marks."""
    solid = F.length(F.translate(text, WHITE, ""))
    marks = F.length(text) - F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", ""))
    return F.when(solid == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(LEAST_QUALITY), 1 - marks / solid))


def order_code(id_text: Column, text: Column, quality: Column) -> Column:
    """Ascending Efraimidis-Spirakis keys as numbers of KEY_BITS bits.

    u is the middle of one of 2^52 steps. The logarithm of the key lies between -37 and 4 less the logarithm of the
    quality; it is spread over 64 units, so one digit of 16 bits holds a thousandth of a unit.
    """
    digits = F.substring(F.md5(F.concat(id_text, F.lit(":"), text)), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)
    place = (F.ln(-F.ln(u)) - F.ln(quality) + 40.0) / 64.0 * float(1 << KEY_BITS)
    return F.least(F.greatest(F.floor(place), F.lit(0)), F.lit((1 << KEY_BITS) - 1)).cast("bigint")


def measured(
    docs: DataFrame, carry: Sequence[str], id_column: str, text_column: str, source_column: str, quality: Column | None
) -> DataFrame:
    """The written table of numbers: _kept (carried columns), source, size, _at (key and tie bits), _n (row number)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    weight = plainness(text) if quality is None else F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-9))
    key = order_code(F.coalesce(F.col(id_column).cast("string"), F.lit("")), text, weight)
    rows = docs.select(
        whole_row(docs.select(*[f"`{c}`" for c in carry])).alias("_kept"), F.col(source_column).alias("source"),
        words_of(text).alias("size"), key.alias("_key"), F.monotonically_increasing_id().alias("_n"),
    )
    tie = F.shiftrightunsigned(F.xxhash64("_n"), 64 - TIE_BITS)
    return settle(rows.select("_kept", "source", "size", (F.shiftleft("_key", TIE_BITS) + tie).alias("_at"), "_n"), "mix-rows")


def targets(
    rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS
) -> DataFrame:
    """source, source_size, target: one row per source, which one task puts in order (a row is a name and numbers).

    Sources are looked at by ascending limit per weight. The first that stays below its limit shows how many words
    one unit of weight gets; all before it are at their limit.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per.withColumn("_w", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    capped = weighed.withColumn("_cap", F.lit(float(most_epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = capped.withColumn("_unit", left / F.sum("_w").over(after))
    below = F.when(F.col("_unit") < F.col("_cap") / F.col("_w"), F.col("_unit"))
    unit = F.max(below).over(everywhere)  # from the first one on they fall
    return level.select("source", "source_size", F.least("_cap", F.coalesce(unit * F.col("_w"), F.col("_cap"))).alias("target"))


def budgets(per_source: DataFrame) -> DataFrame:
    """Adds _epochs (complete ones) and _left (words still to draw): together the target, to the nearest word."""
    size, words = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("bigint")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("bigint")
    return per_source.withColumn("_epochs", epochs).withColumn("_left", words - F.col("_epochs") * size)


def boundaries(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """source, _bound, _left: the number at which a source's budget ends, and what is left for the rows that have it.

    A source whose budget takes all its rows has no boundary.
    """
    found = per_source.select("source", F.lit(0).cast("bigint").alias("_bound"), "_left")
    for level, shift in enumerate(SHIFTS):
        inside = rows.select("source", "size", "_at")
        known = found.withColumnRenamed("source", "_s")
        open_rows = inside.join(known, F.col("source").eqNullSafe(F.col("_s")))
        if level:
            open_rows = open_rows.filter(F.shiftright("_at", SHIFTS[level - 1]) == F.col("_bound"))
        digit = F.shiftright("_at", shift).alias("_digit")
        sums = open_rows.groupBy("source", digit, "_left").agg(F.sum("size").alias("_sum"))
        running = sums.withColumn("_run", F.sum("_sum").over(Window.partitionBy("source").orderBy("_digit")))
        ends = running.filter(F.col("_run") > F.col("_left")).groupBy("source").agg(
            F.min_by(F.struct(F.col("_digit"), (F.col("_left") - F.col("_run") + F.col("_sum")).alias("_left")), "_digit").alias("_e")
        )
        found = settle(ends.select("source", F.col("_e._digit").alias("_bound"), F.col("_e._left").alias("_left")), "mix-bounds")
    return found


def plan(
    docs: DataFrame, carry: Sequence[str] = ("doc_id",), id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source", quality: Column | None = None, weights: Sequence[float] = WEIGHTS,
    share: float = SHARE, most_epochs: float = MOST_EPOCHS,
) -> DataFrame:
    """_kept (the carried columns), source, size, source_size, target, taken (words, repeats counted): a row per row.

    ``quality`` is a positive weight per document, the plainness of its text if not given.
    """
    rows = measured(docs, carry, id_column, text_column, source_column, quality)
    per_source = settle(budgets(targets(rows, weights, share, most_epochs)), "mix-targets")
    ends = boundaries(rows, per_source).select(F.col("source").alias("_e"), "_bound", F.col("_left").alias("_last"))
    known = per_source.withColumnRenamed("source", "_s")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).join(
        ends, F.col("source").eqNullSafe(F.col("_e")), "left"
    )
    out = ["_kept", "source", "size", "source_size", "target"]
    full = F.col("_epochs") * F.col("size")
    at_end = F.coalesce(F.col("_at") == F.col("_bound"), F.lit(False))
    in_budget = F.coalesce(F.col("_at") < F.col("_bound"), F.lit(True))
    decided = placed.filter(~at_end).select(*out, (full + F.when(in_budget, F.col("size")).otherwise(0)).alias("taken"))
    one_by_one = Window.partitionBy("source").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(one_by_one), F.lit(0))
    part = F.least(F.greatest(F.col("_last") - before, F.lit(0)), F.col("size"))
    return decided.unionByName(placed.filter(at_end).select(*out, (full + part).alias("taken")))


def mixture(docs: DataFrame, text_column: str = "text", **choices) -> DataFrame:
    """The mix itself: ``_row`` (all given columns), copy (from 0), words, text.

    Documents of which nothing is taken have no row. The copy in which a budget ends has its first words, one space apart.
    """
    planned = plan(docs, carry=docs.columns, text_column=text_column, **choices).filter("taken > 0")
    copies = F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)
    rows = planned.select("_kept", "size", "taken", F.explode(copies).alias("copy"))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    text = F.col("_kept").getField(text_column)
    cut = F.concat_ws(" ", F.slice(F.split(F.btrim(text, F.lit(WHITE)), WHITE_RUN), F.lit(1), words.cast("int")))
    return rows.select(
        F.col("_kept").alias("_row"), "copy", words.alias("words"), F.when(words == F.col("size"), text).otherwise(cut).alias("text")
    )
