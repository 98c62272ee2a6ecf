"""Scoring predicted answer tables against gold answer tables.

Answer tables live as long cells ``(qid, side, row_no, col_pos, col, kind, value)``. One aggregation
turns them into distinct values: (qid, value) with a bit for each gold and predicted column that
holds it. Copies are combined before that shuffle, and a hot answer is spread by value. A second
aggregation counts the values that are held alike, a few rows per answer: set sizes, key columns and
shared values of column pairs are read off its bits, so gold and predicted values are never joined.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quercus.fixed_values import ANSWER_METRICS
from quercus.functions.responses import cell_kind, cell_value, is_entity_iri, nested_values, parse_execution
from quercus.functions.status import execution_status
from quercus.operators.corpus import drop_failed_generation
from quercus.operators.ordering import HOT_ROWS, as_scalar, rank_within
from quercus.session import settle


def response_cells(df: DataFrame, bindings: str, key: str = "row_id", qid: str = "qid") -> DataFrame:
    """Bindings -> cells. Columns are the keys of the first row; a missing key gives a null value."""
    rows = df.select(
        F.col(key).alias(qid), F.map_keys(F.get(bindings, 0)).alias("_cols"), F.posexplode(bindings).alias("_row", "_cells")
    )
    wide = rows.select(qid, "_row", "_cells", F.posexplode("_cols").alias("col_pos", "col"))
    cell = F.try_element_at(F.col("_cells"), F.col("col"))
    return wide.select(
        qid, (F.col("_row") + 1).alias("row_no"), "col_pos", "col",
        cell_kind(cell).alias("kind"), cell_value(cell).alias("value"),
    )


def read_responses(df: DataFrame, execution: str = "execution", key: str = "row_id") -> DataFrame:
    """(key, bindings) of the rows that worked and can be read; failed generations are left out."""
    working = drop_failed_generation(df).filter(execution_status(F.col(execution)) == "to_eval")
    return working.select(key, parse_execution(F.col(execution)).alias("bindings")).filter(F.col("bindings").isNotNull())


def evaluation_cells(gold: DataFrame, predicted: DataFrame, execution: str = "execution", key: str = "row_id") -> DataFrame:
    """Stored executions of both sides as one table of cells. A prediction without a readable
    response has no cells, so its answer scores zero."""

    def side(df, name):
        return response_cells(read_responses(df, execution, key), "bindings", key).withColumn("side", F.lit(name))

    return side(gold, "gold").unionByName(side(predicted, "pred"))


def evaluation_values(gold: DataFrame, predicted: DataFrame, execution: str = "execution", key: str = "row_id") -> DataFrame:
    """The same as flat lists: every nested value of a response, whatever its column."""

    def side(df, name):
        found = read_responses(df, execution, key).select(F.col(key).alias("qid"), nested_values(F.col("bindings")).alias("v"))
        return found.select("qid", F.lit(name).alias("side"), F.lit(0).alias("col_pos"), F.lit("*").alias("col"), F.explode("v").alias("value"))

    return side(gold, "gold").unionByName(side(predicted, "pred"))


def merge_gold(predicted: DataFrame, gold: DataFrame, key: str = "qid") -> DataFrame:
    """Predictions with their gold columns; a missing gold array becomes empty."""
    joined = predicted.join(gold, key, "left")
    filled = [
        F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name)
        if f.dataType.typeName() == "array" and f.name in gold.columns else F.col(f.name)
        for f in joined.schema.fields
    ]
    return joined.select(*filled)


# ---- distinct values and columns ----------------------------------------------------------------

#: Columns of a side are numbered by ``col_pos``; each 64 of them are one word of a value's membership.
WORDS = 2


def membership(values: DataFrame, side: str) -> list[Column]:
    """The words of a side of ``answer_values``."""
    return [F.col(c) for c in values.columns if c.startswith(f"{side}_")]


def anywhere(words: list[Column]) -> Column:
    """Whether any column of the side holds the value."""
    return reduce(lambda a, b: a.bitwiseOR(b), words) != 0


def holds(words: list[Column], number: Column) -> Column:
    """Whether the bit of a column's number is set."""
    word = words[0]
    for i, other in enumerate(words[1:], 1):
        word = F.when(number < 64 * i, word).otherwise(other)
    # shifts without sign, so that column 63 reads like any other
    return F.call_function("shiftrightunsigned", word, (number % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def spread(df: DataFrame, words: list[Column], name: str, where: Column | None = None) -> DataFrame:
    """One row per column whose bit is set, its number as ``name``; rows for which ``where`` fails have none.

    Numbers up to the highest bit are tried, which keeps all of it in generated code.
    """
    top = F.length(F.bin(words[0])) - 1
    for i, word in enumerate(words[1:], 1):
        top = F.when(word == 0, top).otherwise(F.length(F.bin(word)) + (64 * i - 1))
    tried = F.sequence(F.lit(0), top)
    tried = tried if where is None else F.when(where, tried)
    return df.select("*", F.explode(tried).alias(name)).filter(holds(words, F.col(name)))


def answer_values(cells: DataFrame, words: int = WORDS) -> DataFrame:
    """(qid, value, gold_0.., pred_0..): the columns that hold the value, one bit each.

    A column's number is its ``col_pos``, which tells the columns of a side apart. Membership has fixed
    width, so this is a plain hash aggregation; 64 columns of a side take one of ``words``, and a cell
    beyond them is an error that asks for more.
    """
    number = F.col("col_pos")
    word = F.when(
        (number >= 0) & (number < 64 * words), F.floor(number / 64).cast("int")
    ).otherwise(F.raise_error(F.concat(F.lit(f"no room in {words} words for column "), F.coalesce(number.cast("string"), F.lit("null")))).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (number % 64).cast("int"))

    def held(side: str, i: int) -> Column:
        return F.bit_or(F.when((F.col("side") == side) & (word == i), bit).otherwise(F.lit(0).cast("bigint"))).alias(f"{side}_{i}")

    bits = [held(side, i) for side in ("gold", "pred") for i in range(words)]
    return cells.filter(F.col("qid").isNotNull()).groupBy("qid", "value").agg(*bits)


def flat_values(values: DataFrame) -> DataFrame:
    """The same with each side taken as one list, its column 0."""
    flat = [anywhere(membership(values, side)).cast("bigint").alias(f"{side}_0") for side in ("gold", "pred")]
    return values.select("qid", "value", *flat)


def counting(keep_blank: bool = False) -> Column:
    """Whether a value counts: null never does, the empty text where ``keep_blank`` says so."""
    counts = F.col("value").isNotNull()
    return counts if keep_blank else counts & (F.col("value") != "")


def members(values: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Values of an answer that are held alike, with their number: (qid, gold_0.., pred_0.., counts, iri, n).

    An answer has as many rows as its columns overlap in different ways, however many values it has.
    """
    words = [c for c in values.columns if c not in ("qid", "value")]
    marks = values.select("qid", *words, counting(keep_blank).alias("counts"), is_entity_iri(F.col("value")).alias("iri"))
    return marks.groupBy("qid", *words, "counts", "iri").agg(F.count(F.lit(1)).alias("n"))


def numbered_sizes(held: DataFrame) -> DataFrame:
    """Per (qid, number) of the ``members`` and for each side of that column: distinct values in all, those that
    count, and whether all are entity IRIs (gold_unique, gold_n, gold_entity, and the same of pred)."""
    words = {side: membership(held, side) for side in ("gold", "pred")}
    either = [g.bitwiseOR(p) for g, p in zip(words["gold"], words["pred"])]
    sizes = []
    for side in ("gold", "pred"):
        mine = holds(words[side], F.col("number"))
        sizes += [
            F.sum(F.when(mine, F.col("n")).otherwise(0)).alias(f"{side}_unique"),
            F.sum(F.when(mine & F.col("counts"), F.col("n")).otherwise(0)).alias(f"{side}_n"),
            F.bool_and(F.col("iri") | ~mine).alias(f"{side}_entity"),
        ]
    return spread(held, either, "number").groupBy("qid", "number").agg(*sizes)


def sizes_by_answer(sizes: DataFrame) -> DataFrame:
    """One row per answer: number -> size, for each side; bounded by the columns of the answer."""

    def of(side):
        entry = F.when(F.col(f"{side}_unique") > 0, F.struct(F.col("number"), F.col(f"{side}_n")))
        return F.map_from_entries(F.collect_list(entry)).alias(side)

    return sizes.groupBy("qid").agg(of("gold"), of("pred"))


def column_profile(cells: DataFrame) -> DataFrame:
    """(qid, side, number, col, n_rows, n_unique, n, is_entity, unique_ratio) of every column of an answer: rows, distinct
    values in all (null counts as one), those that count, whether all are entity IRIs, and the share of unique values.

    Copies are counted first, so a hot column is spread by value. Nothing is joined: cells that are already
    dealt by answer stay in their tasks, whose memory then doesn't grow with the table.
    """
    column = ["qid", "side", "number", "col"]
    known = cells.filter(F.col("qid").isNotNull() & F.col("side").isin("gold", "pred")).withColumnRenamed("col_pos", "number")
    copies = known.groupBy(*column, "value").agg(F.count(F.lit(1)).alias("n_rows"))
    profile = copies.groupBy(*column).agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.count_if(counting()).alias("n"),
        F.bool_and(is_entity_iri(F.col("value"))).alias("is_entity"),
    )
    return profile.withColumn("unique_ratio", F.col("n_unique") / F.col("n_rows"))


def entity_columns(cells: DataFrame) -> DataFrame:
    return column_profile(cells).filter("is_entity").select("qid", "side", "col")


def key_choice(columns: Column) -> Column:
    """The identifying columns among array<struct<col, number, n, unique_ratio, is_entity>>.

    One column: it. Else the entity columns. Else the columns with the highest unique ratio, and of
    several those whose name starts or ends with ``id``.
    """

    def named_id(c):
        return F.startswith(F.lower(c["col"]), F.lit("id")) | F.endswith(F.lower(c["col"]), F.lit("id"))

    entities = F.filter(columns, lambda c: c["is_entity"])
    best = F.array_max(F.transform(columns, lambda c: c["unique_ratio"]))
    tied = F.filter(columns, lambda c: c["unique_ratio"] == best)
    with_id = F.filter(tied, named_id)
    chosen = (
        F.when(F.size(columns) == 1, columns)
        .when(F.size(entities) > 0, entities)
        .when((F.size(tied) > 1) & (F.size(with_id) > 0), with_id)
        .otherwise(tied)
    )
    return chosen


def answers_by_columns(profile: DataFrame) -> DataFrame:
    """One row per answer: the profiles of its columns, per side, and the key columns."""

    def of(side):
        return F.collect_list(F.when(F.col("side") == side, F.struct("col", "number", "n", "unique_ratio", "is_entity")))

    wide = profile.groupBy("qid").agg(of("gold").alias("_gold"), of("pred").alias("_pred"))
    return wide.withColumns({"gold_keys": key_choice(F.col("_gold")), "pred_keys": key_choice(F.col("_pred"))})


def key_columns(cells: DataFrame) -> DataFrame:
    """(qid, side, col) of the identifying columns of every answer table."""
    answers = answers_by_columns(column_profile(cells))

    def listed(side):
        return F.transform(f"{side}_keys", lambda c: F.struct(F.lit(side).alias("side"), c["col"].alias("col")))

    return answers.select("qid", F.inline(F.concat(listed("gold"), listed("pred"))))


# ---- relevance and run lists --------------------------------------------------------------------


def to_qrels(cells: DataFrame, side: str = "gold", per_column: bool = False) -> DataFrame:
    """Values as (qid, doc_id, relevance); nulls are left out."""
    shown = ["qid", "col"] if per_column else ["qid"]
    kept = cells.filter((F.col("side") == side) & F.col("value").isNotNull())
    return kept.select(*shown, F.col("value").cast("string").alias("doc_id"), F.lit(1).alias("relevance"))


def to_runs(cells: DataFrame, side: str = "pred", per_column: bool = False, score: float = 1.0) -> DataFrame:
    shown = ["qid", "col"] if per_column else ["qid"]
    kept = cells.filter((F.col("side") == side) & F.col("value").isNotNull())
    return kept.select(*shown, F.col("value").cast("string").alias("doc_id"), F.lit(float(score)).alias("score"))


def rank_run(runs: DataFrame, keys: list[str], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Order of a run: score descending, then doc id descending; a repeated doc counts once."""
    best = runs.groupBy(*keys, "doc_id").agg(F.max("score").alias("score"))
    return rank_within(best, keys, [F.desc("score"), F.desc("doc_id")], "rank", hot_rows)


# ---- metrics ------------------------------------------------------------------------------------


def safe_ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.when(bottom > 0, top / bottom), F.lit(0.0))


def set_overlap(common: Column, n_gold: Column, n_pred: Column) -> Column:
    return safe_ratio(common, F.least(n_gold, n_pred))


def set_jaccard(common: Column, n_gold: Column, n_pred: Column) -> Column:
    return safe_ratio(common, n_gold + n_pred - common)


def set_dice(common: Column, n_gold: Column, n_pred: Column) -> Column:
    return safe_ratio(2 * common, n_gold + n_pred)


def by_side(sizes: DataFrame, key: str, *fields: str) -> DataFrame:
    """One row per answer: column -> fields, for each side; bounded by the columns of the answer."""

    def of(side):
        entry = F.struct(F.col(key), F.struct(*fields) if len(fields) > 1 else F.col(fields[0]))
        return F.map_from_entries(F.collect_list(F.when(F.col("side") == side, entry)))

    return sizes.groupBy("qid").agg(of("gold").alias("gold"), of("pred").alias("pred"))


def shared_values(held: DataFrame) -> DataFrame:
    """(qid, gcol, pcol, n_common): how many values that count two numbered columns share, from ``members``."""
    gold, pred = membership(held, "gold"), membership(held, "pred")
    pairs = spread(spread(held, gold, "gcol", F.col("counts") & anywhere(gold) & anywhere(pred)), pred, "pcol")
    return pairs.groupBy("qid", "gcol", "pcol").agg(F.sum("n").alias("n_common"))


def column_pair_join(cells: DataFrame) -> DataFrame:
    """Every (gold column, predicted column) of an answer with its set sizes and shared values.

    The pairs are of columns of one answer table; shared values are counted by membership. Sizes and shared
    values meet as one row per answer each, bounded by its columns, so cells dealt by answer are not shuffled again.
    """

    def pair(gold, pred):
        return F.col(gold).cast("bigint") * (64 * WORDS) + F.col(pred)

    entry = F.struct(pair("gcol", "pcol"), "n_common")
    shared = shared_values(members(answer_values(cells))).groupBy("qid").agg(F.map_from_entries(F.collect_list(entry)).alias("_shared"))
    answers = by_side(column_profile(cells), "number", "col", "n").join(shared, "qid", "left")
    pairs = answers.select("qid", "pred", "_shared", F.explode("gold").alias("gcol", "_g")).select(
        "qid", "gcol", "_g", "_shared", F.explode("pred").alias("pcol", "_p")
    )
    return pairs.select(
        "qid", F.col("_g.col").alias("gcol"), F.col("_p.col").alias("pcol"), F.col("_g.n").alias("n_gold"), F.col("_p.n").alias("n_pred"),
        F.coalesce(F.try_element_at("_shared", pair("gcol", "pcol")), F.lit(0)).cast("bigint").alias("n_common"),
    )


def best_column_pair(pairs: DataFrame, metric: Callable[[Column, Column, Column], Column], maximise: bool = True) -> DataFrame:
    """Best value of a metric over the pairs of an answer, never below 0 (above 1 when minimising)."""
    score = metric(F.col("n_common"), F.col("n_gold"), F.col("n_pred"))
    if maximise:
        return pairs.groupBy("qid").agg(F.greatest(F.max(score), F.lit(0.0)).alias("score"))
    return pairs.groupBy("qid").agg(F.least(F.min(score), F.lit(1.0)).alias("score"))


def best_column_pair_components(pairs: DataFrame, metrics: list[Callable], maximise: bool = True) -> DataFrame:
    """Metrics with several components: the best of each component by itself, the last dropped."""
    pick, bound, start = (F.max, F.greatest, 0.0) if maximise else (F.min, F.least, 1.0)
    scores = [m(F.col("n_common"), F.col("n_gold"), F.col("n_pred")) for m in metrics[:-1]]
    return pairs.groupBy("qid").agg(
        *[bound(pick(s), F.lit(start)).alias(f"score_{i}") for i, s in enumerate(scores)]
    )


def column_pair_score(
    cells: DataFrame,
    shared: Callable[[Column, Column], Column],
    score: Callable[[Column, Column, Column], Column],
) -> DataFrame:
    """User-defined pair metric, best pair per answer.

    ``shared(gold_count, pred_count)`` is summed over the values that both columns hold;
    ``score(shared_sum, gold_rows, pred_rows)`` makes the number and may call a pandas UDF. No
    column is ever gathered into one list, so a column may have any length.
    """
    counted = cells.filter("value <> ''").groupBy("qid", "value", "side", "col").agg(F.count(F.lit(1)).alias("n"))

    def of(side):
        return counted.filter(F.col("side") == side)

    golden = of("gold").select("qid", "value", F.col("col").alias("gcol"), F.col("n").alias("gn"))
    predicted = of("pred").select("qid", "value", F.col("col").alias("pcol"), F.col("n").alias("pn"))
    sums = golden.join(predicted, ["qid", "value"]).groupBy("qid", "gcol", "pcol").agg(
        F.sum(shared(F.col("gn"), F.col("pn"))).alias("_shared")
    )
    rows = cells.groupBy("qid", "side", "col").agg(F.count_if(F.col("value") != "").alias("n"))
    scored = by_side(rows, "col", "n").join(sums, "qid", "left").withColumn(
        "_score", score(F.col("_shared"), F.try_element_at("gold", "gcol"), F.try_element_at("pred", "pcol"))
    )
    return scored.groupBy("qid").agg(F.greatest(F.coalesce(F.max("_score"), F.lit(0.0)), F.lit(0.0)).alias("score"))


SET_METRICS = ["overlap", "jaccard", "dice_coeff"]


def pair_metrics(
    values: DataFrame, k: int = 5, keep_blank: bool = False, ranked: bool = True, hot_rows: int | None = HOT_ROWS,
    profile: DataFrame | None = None, evaluated: DataFrame | None = None,
) -> DataFrame:
    """The seven metrics for each pair of a gold and a predicted column that share a value.

    A pair without a shared value scores zero in every metric, so it can be left out; an answer
    without any pair, be it that gold or prediction is empty or missing, has one row of zeros.
    ``evaluated`` lists the answers (qid) that count; without it they are those with any cell. Every run score is 1, so a run is ordered by doc id,
    descending. Hits are numbered inside groups that are no larger than the run they come from.
    With a column ``profile``, ``is_key`` tells the pairs of two key columns.
    """
    held = members(values, keep_blank)
    gold, pred = membership(values, "gold"), membership(values, "pred")
    if profile is None:
        answers = sizes_by_answer(numbered_sizes(held))
    else:

        def sizes_of(columns):
            return F.map_from_entries(F.transform(columns, lambda c: F.struct(c["number"], c["n"])))

        keyed = answers_by_columns(profile)
        numbers_of = {f"{s}_keys": F.transform(f"{s}_keys", lambda c: c["number"]) for s in ("gold", "pred")}
        answers = keyed.withColumns({"gold": sizes_of("_gold"), "pred": sizes_of("_pred"), **numbers_of})
    keys = ["qid", "gcol", "pcol"]
    if ranked:
        # values that do not count are left out here, not by a filter: a filter would reach below the
        # aggregation and keep the sizes and the runs from sharing its shuffle
        run = spread(values, pred, "pcol", counting(keep_blank) & anywhere(pred))
        run = rank_within(run.select("qid", "value", *gold, "pcol"), ["qid", "pcol"], [F.desc("value")], "rank", hot_rows)
        hits = spread(run, gold, "gcol", anywhere(gold)).select(*keys, "rank")
        hits = rank_within(hits, keys, ["rank"], "hit_no", hot_rows)
        in_reach = F.col("rank") <= k
        pairs = hits.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_common"),
            F.sum(F.col("hit_no") / F.col("rank")).alias("_precisions"),
            (F.count_if(in_reach) / F.lit(float(k))).alias("precision"),
            F.max(in_reach.cast("double")).alias("recall"),
            F.max(F.when(in_reach, 1 / F.col("rank")).otherwise(0.0)).alias("rr"),
        )
    else:
        pairs = shared_values(held)
    if evaluated is not None:
        answers = evaluated.select("qid").distinct().join(answers, "qid", "left")
    sized = answers.join(pairs, "qid", "left").withColumns(
        {"n_gold": F.try_element_at("gold", "gcol"), "n_pred": F.try_element_at("pred", "pcol")}
    )
    sizes = (F.col("n_common"), F.col("n_gold"), F.col("n_pred"))
    metrics = {"overlap": set_overlap(*sizes), "jaccard": set_jaccard(*sizes), "dice_coeff": set_dice(*sizes)}
    if ranked:
        metrics["map"] = F.col("_precisions") / F.col("n_gold")
        metrics |= {c: F.col(c) for c in ("precision", "recall", "rr")}
    shown = [F.coalesce(m, F.lit(0.0)).alias(c) for c, m in metrics.items()]
    if profile is not None:
        is_key = F.array_contains("gold_keys", F.col("gcol")) & F.array_contains("pred_keys", F.col("pcol"))
        shown.append(F.coalesce(is_key, F.lit(False)).alias("is_key"))
    return sized.select("qid", "gcol", "pcol", *shown)


def best_per_answer(pairs: DataFrame, ranked: bool = True, among: Column | None = None) -> DataFrame:
    """Per answer the best of each metric over its pairs (those for which ``among`` holds)."""
    names = ANSWER_METRICS if ranked else SET_METRICS

    def best(m):
        return F.max(F.col(m) if among is None else F.when(among, F.col(m)).otherwise(0.0)).alias(m)

    return pairs.groupBy("qid").agg(*[best(m) for m in names])


def nested_value_metrics(
    cells: DataFrame, k: int = 5, ranked: bool = True, hot_rows: int | None = HOT_ROWS, values: DataFrame | None = None,
    evaluated: DataFrame | None = None,
) -> DataFrame:
    """All values of an answer as one list per side; blank values stay members."""
    flat = flat_values(answer_values(cells) if values is None else values)
    return best_per_answer(pair_metrics(flat, k, True, ranked, hot_rows, evaluated=evaluated), ranked)


def cross_metrics(
    cells: DataFrame, k: int = 5, hot_rows: int | None = HOT_ROWS, evaluated: DataFrame | None = None
) -> DataFrame:
    return best_per_answer(pair_metrics(answer_values(cells), k, hot_rows=hot_rows, evaluated=evaluated))


def id_column_metrics(
    cells: DataFrame, k: int = 5, hot_rows: int | None = HOT_ROWS, evaluated: DataFrame | None = None
) -> DataFrame:
    """The cross metrics on key columns of both sides."""
    values = answer_values(cells)
    pairs = pair_metrics(values, k, hot_rows=hot_rows, profile=column_profile(cells), evaluated=evaluated)
    return best_per_answer(pairs, among=F.col("is_key"))


def metric_means(scored: DataFrame, prefix: str, names: list[str] = ANSWER_METRICS) -> DataFrame:
    return scored.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{prefix}_{m}") for m in names])


def final_report(
    cells: DataFrame, texts: DataFrame, text_rates: list[DataFrame], logs: list[DataFrame], k: int = 5,
    hot_rows: int | None = HOT_ROWS, nested: DataFrame | None = None, evaluated: DataFrame | None = None,
) -> DataFrame:
    """One row: 3x7 answer metrics, the one-row tables of text rates, the one-row log counts.

    ``nested`` holds the flat value lists (``evaluation_values``); without it they are all values of
    the cells. The means run over the answers that ``evaluated`` lists, or over those with any cell.

    The cross and key-column views come from one table of pairs. With ``hot_rows=None`` no answer is hot: the cells are
    taken as they are dealt by answer, and every view is worked out in the tasks that they were dealt to, so that nothing
    is written or shuffled again. Else they are written once, and a hot answer is spread by value. If every generated
    text is empty all rates are zero. The parts are one-row tables, put side by side as scalar subqueries.
    """
    cells = cells.select("qid", "side", "col_pos", "col", "value")
    if hot_rows is not None:
        cells = settle(cells, "answer-cells")
    values = answer_values(cells)
    pairs = pair_metrics(values, k, hot_rows=hot_rows, profile=column_profile(cells), evaluated=evaluated)
    cross_and_id = pairs.groupBy("qid").agg(
        *[F.max(m).alias(f"cross_{m}") for m in ANSWER_METRICS],
        *[F.max(F.when(F.col("is_key"), F.col(m)).otherwise(0.0)).alias(f"id_{m}") for m in ANSWER_METRICS],
    )
    both = cross_and_id.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in cross_and_id.columns if c != "qid"])
    if nested is None:
        flat = nested_value_metrics(cells, k, hot_rows=hot_rows, values=values, evaluated=evaluated)
    else:
        flat = nested_value_metrics(nested, k, hot_rows=hot_rows, evaluated=evaluated)
    parts = [metric_means(flat, "gnv"), both, *text_rates]
    one = texts.agg(F.coalesce(F.max(F.length("prediction")), F.lit(0)).alias("longest"))
    for i, part in enumerate(parts + logs):
        one = one.withColumn(f"_part{i}", as_scalar(part))
    rates = [(f"_part{i}", c) for i, part in enumerate(parts) for c in part.columns]
    plain = [(f"_part{i + len(parts)}", c) for i, part in enumerate(logs) for c in part.columns]
    zeroed = [F.when(F.col("longest") == 0, F.lit(0.0)).otherwise(F.col(p)[c]).alias(c) for p, c in rates]
    return one.select(*zeroed, *[F.col(p)[c].alias(c) for p, c in plain])
