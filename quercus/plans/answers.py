"""Responses, answer tables, metrics, text overlap, user steps."""

import pandas as pd
from pyspark.sql import functions as F

from quercus.fixed_values import ANSWER_METRICS
from quercus.functions import responses as rs, text as tx
from quercus.operators.corpus import drop_failed_generation
from quercus.operators import answers as ops, executions as ex, labels as lb, overlap as ov, steps as sp
from quercus.plans.registry import query, rounded
from quercus.plans.text import FILLED, LABELLED
from quercus.sources.tables import answer_bound, answers, cells, executions, label_dict, queries, table

ENTITY = "http://www.wikidata.org/entity/Q"
TO_EVAL = "(SELECT * FROM executions WHERE starts_with(execution, '[{'))"


def scored(spark, sf, metrics, **options):
    """A metric function over the cells, with the size question asked once."""
    hot_rows = answer_bound(spark, sf)
    return metrics(cells(spark, sf, hot_rows), hot_rows=hot_rows, **options)


def parsed(spark, sf):
    df = ex.keep_working(executions(spark, sf))
    return df.select("row_id", rs.parse_execution(F.col("execution")).alias("bindings")).filter("bindings IS NOT NULL")


@query(f"SELECT row_id, len(json_extract(replace(execution, '''', '\"'), '$[*]')) AS n_rows, replace(execution, '''', '\"')::JSON ->> '$[0].id.value' AS id, "
       f"replace(execution, '''', '\"')::JSON ->> '$[0].n.datatype' AS datatype FROM {TO_EVAL}", ["executions"])
def parse_execution(spark, sf):
    first = F.get("bindings", 0)
    return parsed(spark, sf).select(
        "row_id", F.size("bindings").cast("bigint").alias("n_rows"),
        first["id"]["value"].alias("id"), first["n"]["datatype"].alias("datatype"),
    )


@query("SELECT event_id AS row_id, concat('http://www.wikidata.org/entity/Q', CAST(user_id AS VARCHAR), '|', CAST(event_id % 10 AS VARCHAR)) AS \"values\" "
       "FROM events WHERE event_type IN ('signup', 'purchase')")
def nested_values(spark, sf):
    return parsed(spark, sf).select("row_id", F.array_join(rs.nested_values(F.col("bindings")), "|").alias("values"))


@query(
    """SELECT event_id AS qid, 1 AS row_no, 0 AS col_pos, 'id' AS col, 'uri' AS kind, concat('http://www.wikidata.org/entity/Q', CAST(user_id AS VARCHAR)) AS value
 FROM events WHERE event_type IN ('signup', 'purchase')
UNION ALL SELECT event_id, 1, 1, 'n', 'integer', CAST(event_id % 10 AS VARCHAR) FROM events WHERE event_type IN ('signup', 'purchase')"""
)
def response_cells(spark, sf):
    return ops.response_cells(parsed(spark, sf), "bindings")


@query("SELECT row_id, CASE WHEN starts_with(execution, '[{') THEN 'id|n' END AS cols FROM executions WHERE starts_with(execution, '[')", ["executions"])
def response_columns(spark, sf):
    df = executions(spark, sf).filter(F.startswith("execution", F.lit("[")))
    return df.select("row_id", F.array_join(rs.response_columns(rs.parse_execution(F.col("execution"))), "|").alias("cols"))


@query("SELECT qid, side, row_no, col, starts_with(lower(value), 'http://www.wikidata.org/') AS is_iri FROM cells", ["cells"])
def is_entity_iri(spark, sf):
    return cells(spark, sf).select("qid", "side", "row_no", "col", rs.is_entity_iri(F.col("value")).alias("is_iri"))


PROFILE = """prof AS (SELECT qid, side, col, (count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END)) / count(*)::DOUBLE AS unique_ratio,
 bool_and(coalesce(starts_with(lower(value), 'http://www.wikidata.org/'), false)) AS is_entity FROM cells GROUP BY qid, side, col)"""
KEYS = f"""{PROFILE}, ranked AS (SELECT *, max(unique_ratio) OVER w AS best, count(*) OVER w AS n_cols, bool_or(is_entity) OVER w AS any_entity FROM prof WINDOW w AS (PARTITION BY qid, side)),
keycols AS (SELECT qid, side, col FROM ranked WHERE n_cols = 1 OR (any_entity AND is_entity) OR (NOT any_entity AND unique_ratio = best))"""


@query(f"WITH {PROFILE} SELECT qid, side, col, round(unique_ratio, 9) AS unique_ratio FROM prof", ["cells"])
def unique_ratio(spark, sf):
    return rounded(ops.column_profile(cells(spark, sf)).select("qid", "side", "col", "unique_ratio"), "unique_ratio")


@query(f"WITH {PROFILE} SELECT qid, side, col FROM prof WHERE is_entity", ["cells"])
def entity_columns(spark, sf):
    return ops.entity_columns(cells(spark, sf))


@query(f"WITH {KEYS} SELECT * FROM keycols", ["cells"])
def key_columns(spark, sf):
    return ops.key_columns(cells(spark, sf))


@query("SELECT qid, col, value AS doc_id, 1 AS relevance FROM cells WHERE side = 'gold' AND value IS NOT NULL", ["cells"])
def to_qrels(spark, sf):
    return ops.to_qrels(cells(spark, sf), per_column=True)


@query("SELECT qid, value AS doc_id, 1e0 AS score FROM cells WHERE side = 'pred' AND value IS NOT NULL", ["cells"])
def to_runs(spark, sf):
    return ops.to_runs(cells(spark, sf))


RANKED = (
    "SELECT qid, col, doc_id, row_number() OVER (PARTITION BY qid, col ORDER BY doc_id DESC) AS rank "
    "FROM (SELECT DISTINCT qid, col, value AS doc_id FROM cells WHERE side = 'pred' AND value IS NOT NULL)"
)


@query(RANKED, ["cells"])
def rank_run(spark, sf):
    hot_rows = answer_bound(spark, sf)
    runs = ops.to_runs(cells(spark, sf, hot_rows), per_column=True)
    return ops.rank_run(runs, ["qid", "col"], hot_rows).select("qid", "col", "doc_id", "rank")


@query(RANKED, ["cells"])
def rank_run_in_slices(spark, sf):
    """The same when runs of more than four documents count as hot: these are sorted by range and numbered by offsets."""
    runs = ops.to_runs(cells(spark, sf, None), per_column=True)
    return ops.rank_run(runs, ["qid", "col"], hot_rows=4).select("qid", "col", "doc_id", "rank")


PAIRS = """gv AS (SELECT DISTINCT qid, col AS gcol, value FROM {c} WHERE side = 'gold' AND {w}), pv AS (SELECT DISTINCT qid, col AS pcol, value FROM {c} WHERE side = 'pred' AND {w}),
gs AS (SELECT qid, gcol, count(*) AS n_gold FROM gv GROUP BY ALL), ps AS (SELECT qid, pcol, count(*) AS n_pred FROM pv GROUP BY ALL),
cm AS (SELECT qid, gcol, pcol, count(*) AS n_common FROM gv JOIN pv USING (qid, value) GROUP BY ALL),
pairs AS (SELECT g.qid, g.gcol, p.pcol, coalesce(n_gold, 0) AS n_gold, coalesce(n_pred, 0) AS n_pred, coalesce(n_common, 0) AS n_common
 FROM (SELECT DISTINCT qid, col AS gcol FROM {c} WHERE side = 'gold') g JOIN (SELECT DISTINCT qid, col AS pcol FROM {c} WHERE side = 'pred') p USING (qid)
 LEFT JOIN gs USING (qid, gcol) LEFT JOIN ps USING (qid, pcol) LEFT JOIN cm USING (qid, gcol, pcol))"""
CROSS_PAIRS = PAIRS.format(c="cells", w="value <> ''")
JACCARD = "CASE WHEN n_gold + n_pred - n_common > 0 THEN n_common / (n_gold + n_pred - n_common)::DOUBLE ELSE 0 END"
SIMPLE = {
    "overlap": "CASE WHEN least(n_gold, n_pred) > 0 THEN n_common / least(n_gold, n_pred)::DOUBLE ELSE 0 END",
    "jaccard": JACCARD,
    "dice_coeff": "CASE WHEN n_gold + n_pred > 0 THEN 2 * n_common / (n_gold + n_pred)::DOUBLE ELSE 0 END",
}


@query(f"WITH {CROSS_PAIRS} SELECT * FROM pairs", ["cells"])
def column_pair_join(spark, sf):
    return ops.column_pair_join(cells(spark, sf))


@query(f"WITH {CROSS_PAIRS} SELECT qid, round(greatest(max({JACCARD}), 0), 9) AS score FROM pairs GROUP BY qid", ["cells"])
def best_column_pair(spark, sf):
    return rounded(ops.best_column_pair(ops.column_pair_join(cells(spark, sf)), ops.set_jaccard), "score")


@query(
    f"WITH {CROSS_PAIRS} SELECT qid, round(greatest(max({SIMPLE['overlap']}), 0), 9) AS score_0, round(greatest(max({JACCARD}), 0), 9) AS score_1 FROM pairs GROUP BY qid",
    ["cells"],
)
def best_column_pair_components(spark, sf):
    """The best overlap and the best Jaccard over the pairs of an answer, each by itself; the last component is dropped."""
    metrics = [ops.set_overlap, ops.set_jaccard, ops.set_dice]
    return rounded(ops.best_column_pair_components(ops.column_pair_join(cells(spark, sf)), metrics), "score_0", "score_1")


@query("SELECT event_id AS row_id, concat(event_type, '|', CAST(user_id AS VARCHAR), '|x') AS \"values\" FROM events")
def nested_values_any_depth(spark, sf):
    """Values at several depths; numbers, other keys and empty places are passed over."""
    e = table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    text = F.to_json(
        F.struct(
            F.struct(F.col("event_type").alias("value")).alias("a"),
F.struct(F.struct(user.alias("value"), F.col("event_id").alias("n_value"), F.lit("no").alias("kind")).alias("b")).alias("c"),
            F.struct(F.struct(F.struct(F.lit("x").alias("old_value")).alias("e")).alias("d")).alias("f"),
        )
    )
    return e.select(F.col("event_id").alias("row_id"), F.array_join(rs.nested_values_any_depth(text), "|").alias("values"))


@query(f"WITH {CROSS_PAIRS} SELECT qid, round(least(min({JACCARD}), 1), 9) AS score FROM pairs GROUP BY qid", ["cells"])
def best_column_pair_min(spark, sf):
    return rounded(ops.best_column_pair(ops.column_pair_join(cells(spark, sf)), ops.set_jaccard, maximise=False), "score")


# ---- the seven metrics --------------------------------------------------------------------------

SCORED = """run{s} AS (SELECT *, row_number() OVER (PARTITION BY qid, pcol ORDER BY value DESC) AS rank FROM (SELECT DISTINCT qid, {pc} AS pcol, value FROM {c} WHERE side = 'pred' AND {w})),
rel{s} AS (SELECT DISTINCT qid, {pc} AS gcol, value FROM {c} WHERE side = 'gold' AND {w}),
hits{s} AS (SELECT qid, gcol, pcol, rank, row_number() OVER (PARTITION BY qid, gcol, pcol ORDER BY rank) AS hit_no FROM rel{s} JOIN run{s} USING (qid, value)),
scored{s} AS (SELECT qid, gcol, pcol, count(*) AS n_common, sum(hit_no / rank::DOUBLE) / any_value(n_gold) AS map, count(*) FILTER (rank <= 5) / 5e0 AS precision,
 max(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END) AS recall, max(CASE WHEN rank <= 5 THEN 1e0 / rank ELSE 0e0 END) AS rr, any_value(n_gold) AS n_gold, any_value(n_pred) AS n_pred
 FROM hits{s} JOIN (SELECT qid, gcol, count(*) AS n_gold FROM rel{s} GROUP BY ALL) USING (qid, gcol) JOIN (SELECT qid, pcol, count(*) AS n_pred FROM run{s} GROUP BY ALL) USING (qid, pcol) GROUP BY ALL),
best{s} AS (SELECT q.qid, coalesce(max(map), 0) AS map, coalesce(max(precision), 0) AS precision, coalesce(max(recall), 0) AS recall, coalesce(max(rr), 0) AS rr,
 coalesce(max(n_common / least(n_gold, n_pred)::DOUBLE), 0) AS overlap, coalesce(max(n_common / (n_gold + n_pred - n_common)::DOUBLE), 0) AS jaccard,
 coalesce(max(2 * n_common / (n_gold + n_pred)::DOUBLE), 0) AS dice_coeff FROM (SELECT DISTINCT qid FROM {b}) q LEFT JOIN scored{s} USING (qid) GROUP BY q.qid)"""
FLAT = SCORED.format(s="_gnv", pc="'*'", c="cells", b="cells", w="value IS NOT NULL")
CROSS = SCORED.format(s="_cross", pc="col", c="cells", b="cells", w="value <> ''")
IDS = KEYS + ", idcells AS (SELECT c.* FROM cells c JOIN keycols USING (qid, side, col)), " + SCORED.format(s="_id", pc="col", c="idcells", b="cells", w="value <> ''")


def shown(names):
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


def flat_metric(name, metric, ranked):
    @query(f"WITH {FLAT} SELECT qid, round({metric}, 9) AS {metric} FROM best_gnv", ["cells"], name=name)
    def one(spark, sf):
        df = scored(spark, sf, ops.nested_value_metrics, ranked=ranked)
        return rounded(df.select("qid", metric), metric)

    return one


for _name, _metric, _ranked in [
    ("set_overlap", "overlap", False), ("set_jaccard", "jaccard", False), ("set_dice", "dice_coeff", False),
    ("average_precision", "map", True), ("precision_at_k", "precision", True),
    ("success_at_k", "recall", True), ("reciprocal_rank_at_k", "rr", True),
]:
    flat_metric(_name, _metric, _ranked)


@query(f"WITH {FLAT} SELECT qid, {shown(ANSWER_METRICS)} FROM best_gnv", ["cells"])
def nested_value_metrics(spark, sf):
    return rounded(scored(spark, sf, ops.nested_value_metrics), *ANSWER_METRICS)


@query(f"WITH {CROSS} SELECT qid, {shown(ANSWER_METRICS)} FROM best_cross", ["cells"])
def cross_metrics(spark, sf):
    return rounded(scored(spark, sf, ops.cross_metrics), *ANSWER_METRICS)


@query(f"WITH {IDS} SELECT qid, {shown(ANSWER_METRICS)} FROM best_id", ["cells"])
def id_column_metrics(spark, sf):
    return rounded(scored(spark, sf, ops.id_column_metrics), *ANSWER_METRICS)


STORED = """stored AS (SELECT event_id AS qid, unnest(['gold', 'gold', 'pred', 'pred']) AS side, unnest(['id', 'n', 'id', 'n']) AS col,
 unnest([concat('http://www.wikidata.org/entity/Q', CAST(user_id AS VARCHAR)), CAST(event_id % 10 AS VARCHAR), concat('http://www.wikidata.org/entity/Q', CAST(user_id AS VARCHAR)),
 CASE WHEN event_id % 2 = 0 THEN '3' ELSE CAST(event_id % 10 AS VARCHAR) END]) AS value FROM events WHERE event_type IN ('signup', 'purchase') AND NOT (event_type = 'signup' AND event_id % 3 = 0)),
cells AS (SELECT * FROM stored WHERE (side = 'gold' AND qid % 7 <> 0) OR (side = 'pred' AND qid % 5 <> 0)),
evaluated AS (SELECT event_id AS qid FROM events WHERE NOT (event_type = 'signup' AND event_id % 3 = 0))"""
EVALUATED = {"_e": ("col", "cells", "value IS NOT NULL"), "_i": ("col", "idcells", "value IS NOT NULL"), "_f": ("'*'", "cells", "value IS NOT NULL")}


def stored_predictions(spark, sf):
    """Executions of predicted queries: every fifth times out, every second has another number."""
    e, key = F.col("execution"), F.col("row_id")
    changed = F.regexp_replace(e, r"'value': '\d'", "'value': '3'")
    return executions(spark, sf).withColumn(
        "execution", F.when(key % 5 == 0, F.lit("timeout")).when(key % 2 == 0, changed).otherwise(e)
    )


def stored_gold(spark, sf):
    """Every seventh gold query has no row, an empty response or a timeout."""
    key = F.col("row_id")
    gold = executions(spark, sf).filter(key % 21 != 0)
    return gold.withColumn(
        "execution", F.when(key % 21 == 7, F.lit("[]")).when(key % 21 == 14, F.lit("timeout")).otherwise(F.col("execution"))
    )


@query(
    f"WITH {STORED}, {KEYS}, idcells AS (SELECT c.* FROM cells c JOIN keycols USING (qid, side, col)), "
    + ", ".join(SCORED.format(s=s, pc=pc, c=c, b="evaluated", w=w) for s, (pc, c, w) in EVALUATED.items())
    + " SELECT qid, " + ", ".join(
        f"round({t}.{m}, 9) AS {name}_{m}" for name, t in (("cross", "c"), ("id", "i"), ("gnv", "f")) for m in ANSWER_METRICS
    )
    + " FROM best_e c JOIN best_i i USING (qid) JOIN best_f f USING (qid)"
)
def evaluate_executions(spark, sf):
    """From the stored executions of gold and predicted queries to all scores of every prediction."""
    gold, predicted = stored_gold(spark, sf), stored_predictions(spark, sf)
    evaluated = drop_failed_generation(predicted).select(F.col("row_id").alias("qid"))
    table_cells = ops.evaluation_cells(gold, predicted)
    views = {
        "cross": ops.cross_metrics(table_cells, evaluated=evaluated),
        "id": ops.id_column_metrics(table_cells, evaluated=evaluated),
        "gnv": ops.nested_value_metrics(ops.evaluation_values(gold, predicted), evaluated=evaluated),
    }
    out = None
    for name, view in views.items():
        named = view.select("qid", *[F.col(m).alias(f"{name}_{m}") for m in ANSWER_METRICS])
        out = named if out is None else out.join(named, "qid")
    return rounded(out, *[c for c in out.columns if c != "qid"])


@query(
    """WITH g AS (SELECT qid, col AS gcol, value, count(*) AS n FROM cells WHERE side = 'gold' AND value <> '' GROUP BY ALL),
p AS (SELECT qid, col AS pcol, value, count(*) AS n FROM cells WHERE side = 'pred' AND value <> '' GROUP BY ALL),
m AS (SELECT qid, gcol, pcol, sum(least(g.n, p.n)) AS m FROM g JOIN p USING (qid, value) GROUP BY ALL),
s AS (SELECT m.qid, 2 * m / (gt.n + pt.n)::DOUBLE AS score FROM m JOIN (SELECT qid, gcol, sum(n) AS n FROM g GROUP BY ALL) gt USING (qid, gcol) JOIN (SELECT qid, pcol, sum(n) AS n FROM p GROUP BY ALL) pt USING (qid, pcol))
SELECT q.qid, round(coalesce(max(score), 0), 9) AS score FROM (SELECT DISTINCT qid FROM cells) q LEFT JOIN s USING (qid) GROUP BY q.qid""",
    ["cells"],
)
def column_pair_udf(spark, sf):
    """A user's metric: multiset Dice, its last step in a pandas UDF."""

    @F.pandas_udf("double")
    def dice(shared: pd.Series, gold: pd.Series, pred: pd.Series) -> pd.Series:
        return 2.0 * shared / (gold + pred)

    return rounded(ops.column_pair_score(cells(spark, sf), F.least, dice), "score")


@query(
    """WITH p AS (SELECT event_id AS qid, CASE WHEN event_type IN ('signup', 'purchase')
 THEN concat('http://www.wikidata.org/entity/Q', CAST(user_id AS VARCHAR), '|', CAST(event_id % 10 AS VARCHAR)) ELSE '' END AS v FROM events)
SELECT qid, v AS pred, CASE WHEN qid % 4 <> 0 THEN v ELSE '' END AS gold, CASE WHEN qid % 4 <> 0 THEN 'gold' END AS source FROM p"""
)
def merge_gold(spark, sf):
    values = executions(spark, sf).select(
        F.col("row_id").alias("qid"), rs.nested_values(rs.parse_execution(F.col("execution"))).alias("pred_values")
    )
    gold = values.filter("qid % 4 <> 0").select("qid", F.col("pred_values").alias("gold_values"), F.lit("gold").alias("source"))
    merged = ops.merge_gold(values, gold)
    return merged.select(
        "qid", F.array_join("pred_values", "|").alias("pred"), F.array_join("gold_values", "|").alias("gold"), "source"
    )


# ---- text overlap -------------------------------------------------------------------------------


def pairs(spark, sf):
    return answers(spark, sf).select("row_id", F.col("answer").alias("prediction"), F.col("target").alias("reference"))


def ngram_sql(tokens: str, sizes: str, suffix: str = "") -> str:
    return f"""tk{suffix} AS (SELECT row_id, {tokens.format(c='answer')} AS a, {tokens.format(c='target')} AS t FROM answers), sz{suffix} AS (SELECT unnest({sizes}) AS n),
gr{suffix} AS (SELECT row_id, n, 1 AS p, array_to_string(a[i:i + n - 1], ' ') AS gram FROM (SELECT row_id, n, a, unnest(range(1, len(a) - n + 2)) AS i FROM tk{suffix}, sz{suffix})
 UNION ALL SELECT row_id, n, 0, array_to_string(t[i:i + n - 1], ' ') FROM (SELECT row_id, n, t, unnest(range(1, len(t) - n + 2)) AS i FROM tk{suffix}, sz{suffix})),
ct{suffix} AS (SELECT row_id, n, gram, count(*) FILTER (p = 1) AS p, count(*) FILTER (p = 0) AS r FROM gr{suffix} GROUP BY ALL),
ng{suffix} AS (SELECT row_id, n, sum(least(p, r)) AS m, sum(p) AS p, sum(r) AS r FROM ct{suffix} GROUP BY ALL)"""


ROUGE = ngram_sql("regexp_extract_all(lower({c}), '[a-z0-9]+')", "[1, 2]", "1") + """,
rouge AS (SELECT a.row_id, coalesce(max(2e0 * m / (p + r)) FILTER (n = 1), 0) AS rouge1, coalesce(max(2e0 * m / (p + r)) FILTER (n = 2), 0) AS rouge2
 FROM answers a LEFT JOIN ng1 USING (row_id) GROUP BY a.row_id)"""
BLEU = ngram_sql("regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')", "[1, 2, 3, 4]", "2") + """,
bleu AS (SELECT CASE WHEN min(m) > 0 THEN exp(avg(ln(m / p::DOUBLE))) * CASE WHEN max(p) FILTER (n = 1) >= max(r) FILTER (n = 1) THEN 1 ELSE exp(1 - max(r) FILTER (n = 1) / (max(p) FILTER (n = 1))::DOUBLE) END ELSE 0 END AS bleu,
 (max(p) FILTER (n = 1))::BIGINT AS pred_len, (max(r) FILTER (n = 1))::BIGINT AS ref_len FROM (SELECT n, sum(m) AS m, sum(p) AS p, sum(r) AS r FROM ng2 GROUP BY n))"""
METEOR = r"""wd AS (SELECT row_id, list_filter(regexp_split_to_array(lower(answer), '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(target), '\s+'), lambda x: x <> '') AS t FROM answers),
wp AS (SELECT row_id, word, pos, row_number() OVER (PARTITION BY row_id, word ORDER BY pos DESC) AS copy FROM (SELECT row_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM wd)),
wr AS (SELECT row_id, word, pos, row_number() OVER (PARTITION BY row_id, word ORDER BY pos DESC) AS copy FROM (SELECT row_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM wd)),
al AS (SELECT wp.row_id, wp.pos AS p, wr.pos AS r FROM wp JOIN wr USING (row_id, word, copy)),
ch AS (SELECT row_id, count(*) AS m, sum(s) AS c FROM (SELECT row_id, CASE WHEN p = lag(p) OVER w + 1 AND r = lag(r) OVER w + 1 THEN 0 ELSE 1 END AS s FROM al WINDOW w AS (PARTITION BY row_id ORDER BY p)) GROUP BY row_id),
meteor AS (SELECT wd.row_id, CASE WHEN m > 0 THEN (m / len(a)::DOUBLE) * (m / len(t)::DOUBLE) / (0.9e0 * m / len(a) + 0.1e0 * m / len(t)) * (1 - 0.5e0 * pow(c / m::DOUBLE, 3)) ELSE 0 END AS meteor FROM wd LEFT JOIN ch USING (row_id))"""


@query(f"WITH {ROUGE} SELECT row_id, {shown(['rouge1', 'rouge2'])} FROM rouge", ["answers"])
def rouge_n(spark, sf):
    return rounded(ov.rouge_n(pairs(spark, sf)), "rouge1", "rouge2")


#: The table of common-subsequence lengths, one step per reference token: a step takes the longer of
#: what was and what a match adds, then the greatest up to each place.
LCS = """lt AS (SELECT row_id, regexp_extract_all(lower(answer), '[a-z0-9]+') AS p, regexp_extract_all(lower(target), '[a-z0-9]+') AS r FROM answers),
lcs AS (SELECT row_id, 0 AS i, list_transform(range(0, len(p) + 1), lambda j: 0::BIGINT) AS best, p, r FROM lt
 UNION ALL SELECT row_id, i + 1, list_transform(range(1, len(x) + 1), lambda k: list_max(x[1:k])), p, r FROM (SELECT row_id, i, p, r,
  list_transform(range(0, len(p) + 1), lambda j: CASE WHEN j > 0 AND p[j] = r[i + 1] THEN best[j] + 1 ELSE best[j + 1] END) AS x FROM lcs WHERE i < len(r))),
rougel AS (SELECT row_id, CASE WHEN best[len(best)] > 0 THEN 2e0 * best[len(best)] / (len(p) + len(r)) ELSE 0 END AS rougeL FROM lcs WHERE i = len(r))"""


@query(f"WITH RECURSIVE {LCS} SELECT row_id, round(rougeL, 9) AS rougeL FROM rougel", ["answers"])
def rouge_l(spark, sf):
    return rounded(ov.rouge_l(pairs(spark, sf)).select("row_id", "rougeL"), "rougeL")


@query()
def rouge_lsum(spark, sf):
    return rounded(ov.rouge_l(pairs(spark, sf)), "rougeL", "rougeLsum")


@query(f"WITH {BLEU} SELECT round(bleu, 9) AS bleu, pred_len, ref_len FROM bleu", ["answers"])
def corpus_bleu(spark, sf):
    return rounded(ov.corpus_bleu(pairs(spark, sf)), "bleu")


@query(f"WITH {METEOR} SELECT row_id, round(meteor, 9) AS meteor FROM meteor", ["answers"])
def meteor_exact(spark, sf):
    return rounded(ov.meteor_exact(pairs(spark, sf)), "meteor")


@query(
    "SELECT a.row_id, a.answer, b.target FROM (SELECT row_id, answer, row_number() OVER (ORDER BY row_id) AS p FROM answers) a "
    "JOIN (SELECT text AS target, row_number() OVER (ORDER BY item_id) AS p FROM benchmark) b USING (p)",
    ["answers"],
)
def align_by_position(spark, sf):
    predictions = answers(spark, sf).select("row_id", "answer")
    targets = table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("target"))
    return ov.align_by_position(predictions, targets)


def means(prefix):
    return ", ".join(f"round(avg({m}), 9) AS {prefix}_{m}" for m in ANSWER_METRICS)


@query(
    f"WITH RECURSIVE {FLAT}, {CROSS}, {IDS}, {ROUGE}, {LCS}, {BLEU}, {METEOR} SELECT * FROM (SELECT {means('gnv')} FROM best_gnv), (SELECT {means('cross')} FROM best_cross), (SELECT {means('id')} FROM best_id), "
    "(SELECT round(avg(rouge1), 9) AS rouge1, round(avg(rouge2), 9) AS rouge2 FROM rouge), (SELECT round(avg(rougeL), 9) AS rougeL FROM rougel), (SELECT round(bleu, 9) AS bleu FROM bleu), (SELECT round(avg(meteor), 9) AS meteor FROM meteor), "
    "(SELECT round(avg(CASE WHEN execution LIKE 'exception:%' OR execution LIKE 'timeout%' THEN 0 ELSE 1 END), 9) AS correct_syntax, "
    "count(*) FILTER (execution LIKE 'exception:%') AS exception_count, count(*) FILTER (execution LIKE 'timeout%') AS timeout_count FROM executions)",
    ["cells", "answers", "executions"],
)
def final_report(spark, sf):
    return whole_report(spark, sf, ("rougeL",))


@query()
def final_report_by_line(spark, sf):
    """The report with the line-wise ROUGE too, for which there is no SQL."""
    return whole_report(spark, sf, ("rougeL", "rougeLsum"))


def whole_report(spark, sf, lcs):
    texts = pairs(spark, sf)
    logs = executions(spark, sf)
    report = scored(
        spark, sf, ops.final_report, texts=texts,
        text_rates=[ov.text_report(texts, lcs=lcs), ex.correct_syntax(logs)], logs=[ex.exception_timeout_counts(logs)],
    )
    return rounded(report, *[c for c in report.columns if not c.endswith("_count")])


# ---- user steps ---------------------------------------------------------------------------------


def labelled_answers(spark, sf):
    """Answers that carry a labelled query between tags; every seventh lacks the end tag."""
    dictionary = label_dict(spark, sf)
    df = lb.label_query(queries(spark, sf), dictionary).select("row_id", "query_templated")
    end = F.when(F.col("row_id") % 7 == 0, F.lit("")).otherwise(F.lit("[/query]"))
    return df.select("row_id", F.concat(F.lit("Sure [query]"), "query_templated", end).alias("answer")), dictionary


STEPS_SQL = f"""WITH {FILLED} SELECT l.row_id, CASE WHEN l.row_id % 7 = 0 THEN NULL ELSE output END AS output,
 CASE WHEN l.row_id % 7 = 0 THEN 'Unexpected err.msg="The LLM result doesn''t match desired format.": err.sparql=''Sure [query]' || query_templated || '''' ELSE '' END AS status,
 l.row_id % 7 = 0 AS has_error, CASE WHEN l.row_id % 7 = 0 THEN '' ELSE 'fill' END AS last_executed_step, CASE WHEN l.row_id % 7 = 0 THEN 'translate' ELSE '' END AS to_be_executed_step
 FROM labelled l JOIN filled USING (row_id)"""


@query(STEPS_SQL, ["queries", "label_dict"])
def ordered_steps(spark, sf):
    df, dictionary = labelled_answers(spark, sf)
    out = sp.run_steps(df, sp.template_steps("answer", dictionary))
    return out.select("row_id", "output", "status", "has_error", "last_executed_step", "to_be_executed_step")


query(STEPS_SQL, ["queries", "label_dict"], name="ordered_pipeline")(ordered_steps)


@query(
    f"WITH {LABELLED} SELECT row_id, query, query_templated, CASE WHEN row_id % 7 <> 0 THEN query_templated ELSE '' END AS translated_prompt, CAST(NULL AS VARCHAR) AS output FROM labelled",
    ["queries", "label_dict"],
)
def attach_results(spark, sf):
    """Step results stay beside the source columns; the missing output column is added as null."""
    dictionary = label_dict(spark, sf)
    df = lb.label_query(queries(spark, sf).select("row_id", "query"), dictionary)
    end = F.when(F.col("row_id") % 7 == 0, F.lit("")).otherwise(F.lit("[/query]"))
    df = df.withColumn("answer", F.concat(F.lit("[query]"), F.regexp_replace("query_templated", "^PREFIX", "PREFIX"), end))
    out = sp.ensure_output_column(sp.run_steps(df, [sp.translate_step("answer")]))
    return out.select("row_id", "query", "query_templated", "translated_prompt", "output")


@query("SELECT row_id, CASE WHEN row_id % 2 = 0 THEN query END AS output FROM queries", ["queries"])
def ensure_output_column(spark, sf):
    half = sp.Step("half", lambda d: d.withColumn("output", F.col("query")).withColumn(
        "error", F.when(F.col("row_id") % 2 == 1, F.lit("odd"))), ["output"])
    return sp.ensure_output_column(sp.run_steps(queries(spark, sf), [half])).select("row_id", "output")


@query("WITH g AS (SELECT DISTINCT qid, value FROM cells WHERE side = 'gold' AND value <> ''), p AS (SELECT DISTINCT qid, value FROM cells WHERE side = 'pred' AND value <> ''), "
       "s AS (SELECT q.qid, (SELECT count(*) FROM g WHERE g.qid = q.qid) AS n, (SELECT count(*) FROM g JOIN p USING (qid, value) WHERE g.qid = q.qid) AS c, "
       "(SELECT count(*) FROM p WHERE p.qid = q.qid) AS m FROM (SELECT DISTINCT qid FROM cells WHERE value <> '') q) "
       "SELECT round(avg(CASE WHEN least(n, m) > 0 THEN c / least(n, m)::DOUBLE ELSE 0 END), 9) AS mean_overlap, round(avg(c / (n + m - c)::DOUBLE), 9) AS mean_jaccard, "
       "round(avg(2 * c / (n + m)::DOUBLE), 9) AS mean_dice, count(*) AS n_answers FROM s", ["cells"])
def answer_match_report(spark, sf):
    """How well predicted answers match gold answers: the mean set metrics over all values."""
    filled = cells(spark, sf).filter("value <> ''")
    scored = ops.nested_value_metrics(filled, ranked=False)
    report = scored.agg(
        F.avg("overlap").alias("mean_overlap"), F.avg("jaccard").alias("mean_jaccard"), F.avg("dice_coeff").alias("mean_dice"),
        F.count(F.lit(1)).alias("n_answers"),
    )
    return rounded(report, "mean_overlap", "mean_jaccard", "mean_dice")
