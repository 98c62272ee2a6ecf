"""Cleaning, ranges, sorting, sampling, splits."""

from pyspark.sql import functions as F

from quercus.operators import corpus as ops, sampling
from quercus.functions import text as tx
from quercus.plans.registry import query, rounded
from quercus.sources import readers
from quercus.sources.tables import answers, cells, documents, executions, table

DOCS = "(SELECT doc_id AS row_id, * EXCLUDE (doc_id) FROM documents)"


@query("SELECT * FROM documents")
def load_dataset(spark, sf):
    return readers.load_dataset(spark, f"{sf}/documents.parquet")


@query("SELECT doc_id, text, lang FROM documents")
def require_columns(spark, sf):
    return readers.require_columns(table(spark, sf, "documents"), ["doc_id", "text", "lang"])


@query(
    "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS position, text, lang, source, n_chars FROM "
    "(SELECT min(doc_id) AS row_id, text, lang, source, n_chars FROM documents GROUP BY ALL)"
)
def dedup_keep_first(spark, sf):
    return ops.dedup_keep_first(documents(spark, sf), renumber="position")


@query(
    "SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS n_duplicates, "
    "round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents))) / count(*)::DOUBLE, 9) AS ratio FROM documents"
)
def duplicate_ratio(spark, sf):
    return rounded(ops.duplicate_ratio(documents(spark, sf).select("row_id", "text")), "ratio")


@query(
    """SELECT 'row_id' AS "column", count(*) FILTER (doc_id IS NULL) AS n_null, 0::BIGINT AS n_empty FROM documents
UNION ALL SELECT 'text', count(*) FILTER (text IS NULL), count(*) FILTER (text = '') FROM documents
UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL), count(*) FILTER (lang = '') FROM documents
UNION ALL SELECT 'source', count(*) FILTER (source IS NULL), count(*) FILTER (source = '') FROM documents
UNION ALL SELECT 'n_chars', count(*) FILTER (n_chars IS NULL), 0 FROM documents"""
)
def missing_profile(spark, sf):
    return ops.missing_profile(documents(spark, sf))


@query(
    "SELECT count(*) AS n, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 6) AS std, min(length(text)) AS min, "
    "max(length(text)) AS max, quantile_cont(length(text), 0.25)::DOUBLE AS q1, quantile_cont(length(text), 0.5)::DOUBLE AS median, "
    "quantile_cont(length(text), 0.75)::DOUBLE AS q3 FROM documents"
)
def describe_lengths(spark, sf):
    df = ops.describe_lengths(documents(spark, sf), "text")
    return rounded(df, "mean", "std", digits=6).withColumns({c: F.col(c).cast("bigint") for c in ("min", "max")})


@query(
    """WITH f AS (SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL
UNION ALL SELECT 'text', text, count(*) FROM documents GROUP BY ALL)
SELECT "column", sum(n)::BIGINT AS count, count(*) AS "unique", arg_min(value, {'a': -n, 'b': value}) AS top, max(n) AS freq
FROM f WHERE value IS NOT NULL GROUP BY "column" """
)
def describe_strings(spark, sf):
    return ops.describe_strings(documents(spark, sf), ["lang", "source", "text"])


OUTLIERS = """WITH q AS (SELECT quantile_cont(length({c}), 0.25) AS q1, quantile_cont(length({c}), 0.75) AS q3 FROM {t} WHERE {w})
SELECT {k}, length({c}) AS len FROM {t}, q WHERE (length({c}) < q1 - 1.5 * (q3 - q1) OR length({c}) > q3 + 1.5 * (q3 - q1)) AND {w}"""


@query(OUTLIERS.format(c="text", t="documents", k="doc_id AS row_id", w="true"))
def iqr_outliers(spark, sf):
    return ops.iqr_outliers(documents(spark, sf), "text").select("row_id", F.length("text").cast("bigint").alias("len"))


@query(OUTLIERS.format(c="html", t="pages", k="page_id", w="length(html) > 0"))
def iqr_outliers_filled(spark, sf):
    df = ops.iqr_outliers(table(spark, sf, "pages"), "html", only_filled=True)
    return df.select("page_id", F.length("html").cast("bigint").alias("len"))


@query("SELECT doc_id AS row_id, lang, n_chars FROM documents WHERE doc_id >= 100")
def rows_range(spark, sf):
    return ops.rows_range(documents(spark, sf), 100, 0).select("row_id", "lang", "n_chars")


@query(
    "SELECT l.doc_id * 10 + l.quality AS ord, d.doc_id AS row_id, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1"
)
def rows_targeted(spark, sf):
    targets = table(spark, sf, "labels").filter("toxic = 1").select(
        (F.col("doc_id") * 10 + F.col("quality")).alias("ord"), F.col("doc_id").alias("row_id")
    )
    return ops.rows_targeted(documents(spark, sf), targets).select("ord", "row_id", "source", "n_chars").orderBy("ord")


@query("SELECT row_id, attempt, answer FROM answers WHERE is_skipped", ["answers"])
def rows_skipped(spark, sf):
    return ops.rows_skipped(answers(spark, sf)).select("row_id", "attempt", "answer")


@query("SELECT doc_id AS row_id, source FROM documents WHERE contains(lower(text), 'the ')")
def search_text(spark, sf):
    return documents(spark, sf).filter(tx.search_text(F.col("text"), "The ")).select("row_id", "source")


@query("SELECT doc_id AS row_id, length(text) AS len FROM documents ORDER BY len, row_id")
def sort_by_length(spark, sf):
    df = documents(spark, sf).select("row_id", "text")
    return ops.sort_by_length(df, "text").select("row_id", F.col("len").cast("bigint").alias("len"))


@query("SELECT doc_id AS row_id, length(text) AS len FROM documents ORDER BY len DESC, row_id LIMIT 20")
def top_k_longest(spark, sf):
    df = documents(spark, sf).select("row_id", "text")
    return ops.top_k_longest(df, "text", 20).select("row_id", F.col("len").cast("bigint").alias("len"))


HASH = "md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR)))"
SPLIT_SQL = (
    "WITH o AS (SELECT *, row_number() OVER (ORDER BY concat("
    + HASH.format(seed=0, key="doc_id")
    + ", CAST(doc_id AS VARCHAR))) - 1 AS place, count(*) OVER () AS n FROM documents) "
    "SELECT doc_id AS row_id, text, lang, source, n_chars, CASE WHEN place < floor(n * 0.75e0) THEN 'train' WHEN place < floor(n * 0.8e0) THEN 'valid' ELSE 'test' END AS split FROM o"
)


@query(SPLIT_SQL)
def split_75_5_20(spark, sf):
    return sampling.split_75_5_20(documents(spark, sf))


QUESTIONS = (
    "(SELECT conv_id * 1000 + turn AS row_id, string_split(text, chr(10)) AS inputs, "
    "'SELECT ?x WHERE { ' || string_split(text, chr(10))[1] || ' }' AS target FROM conversations)"
)


def questions(spark, sf):
    """Rows with a list of questions (the lines of a text) and a target query."""
    lines = F.split("text", "\n")
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        lines.alias("inputs"),
        F.concat(F.lit("SELECT ?x WHERE { "), lines[0], F.lit(" }")).alias("target"),
    )


def pick_sql(seed, key="row_id", items="inputs"):
    h = HASH.format(seed=seed, key=key)
    return f"{items}[(('0x' || substr({h}, 1, 8))::BIGINT % len({items}) + 1)::BIGINT]"


@query(f"SELECT row_id, {pick_sql(7)} AS picked FROM {QUESTIONS}")
def pick_one_input(spark, sf):
    return questions(spark, sf).select("row_id", sampling.pick_one(F.col("inputs"), 7, F.col("row_id")).alias("picked"))


FEW_SHOT_SQL = f"""WITH q AS (SELECT *, {HASH.format(seed=3, key="row_id")} AS h FROM {QUESTIONS}),
b AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (SELECT greatest(ceil(count(*) / 100.0), 1)::BIGINT FROM q) AS b FROM q),
p AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY row_id) - 1 AS p, count(*) OVER (PARTITION BY b) AS m FROM b),
a AS (SELECT row_id, b, j, (p + 1 + (('0x' || substr(h, 9, 8))::BIGINT % greatest(m - 1, 1) + j) % (m - 1)) % m AS q
  FROM p, (SELECT unnest([0, 1, 2]) AS j) WHERE m > 1 AND j < least(3, m - 1)),
e AS (SELECT a.row_id, a.j, p.row_id AS example_id, {pick_sql(4, "p.row_id", "p.inputs")} AS question FROM a JOIN p ON a.b = p.b AND a.q = p.p)
SELECT q.row_id, coalesce(string_agg(CAST(example_id AS VARCHAR) || ':' || question, '|' ORDER BY j), '') AS examples
FROM q LEFT JOIN e USING (row_id) GROUP BY q.row_id"""


@query(FEW_SHOT_SQL)
def few_shot_examples(spark, sf):
    df = sampling.few_shot_examples(questions(spark, sf), 3, seed=3, batch=100)
    shown = F.transform("examples", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["question"]))
    return df.select("row_id", F.array_join(shown, "|").alias("examples"))


@query(
    "SELECT conv_id, arg_min(answer, attempt) FILTER (attempt < 3 AND NOT contains(answer, 'GROUP') AND length(answer) % 3 = 0) AS result, "
    "count(*) FILTER (attempt < 3 AND NOT contains(answer, 'GROUP') AND length(answer) % 3 = 0) = 0 AS is_skipped FROM answers GROUP BY conv_id",
    ["answers"],
)
def first_acceptable_attempt(spark, sf):
    ok = ~F.contains(F.col("answer"), F.lit("GROUP")) & (F.length("answer") % 3 == 0)
    return sampling.first_acceptable_attempt(answers(spark, sf), "conv_id", ok, 3)


@query(
    "SELECT doc_id AS row_id, n AS num_tokens, n > 300 AS is_prompt_too_long, n > 300 AS is_skipped FROM "
    "(SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS n FROM documents)"
)
def prompt_too_long(spark, sf):
    df = documents(spark, sf).select("row_id", tx.count_tokens(F.col("text")).alias("num_tokens"))
    return sampling.mark_too_long(df, F.col("num_tokens"), 300)


@query(
    "SELECT d.doc_id AS row_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN quality = 1 THEN 'kept' END ELSE source END AS source, "
    "CASE WHEN l.doc_id IS NOT NULL THEN CAST(toxic AS VARCHAR) ELSE lang END AS lang FROM documents d LEFT JOIN labels l USING (doc_id)"
)
def overwrite_from(spark, sf):
    newer = table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, F.lit("kept")).alias("source"),
        F.col("toxic").cast("string").alias("lang"),
    )
    return ops.overwrite_from(documents(spark, sf).select("row_id", "source", "lang"), newer, ["source", "lang"])


@query(
    "SELECT DISTINCT value FROM (SELECT value FROM cells WHERE side = 'gold' INTERSECT SELECT value FROM cells WHERE side = 'pred')", ["cells"]
)
def value_intersect(spark, sf):
    c = cells(spark, sf)
    return c.filter("side = 'gold'").select("value").intersect(c.filter("side = 'pred'").select("value"))


@query("SELECT DISTINCT value FROM cells", ["cells"])
def value_union(spark, sf):
    c = cells(spark, sf)
    return c.filter("side = 'gold'").select("value").union(c.filter("side = 'pred'").select("value")).distinct()


@query("SELECT row_id, execution FROM executions WHERE execution NOT LIKE 'exception%'", ["executions"])
def rows_except(spark, sf):
    df = executions(spark, sf)
    return ops.rows_except(df, df.filter(F.startswith("execution", F.lit("exception")))).select("row_id", "execution")


@query("SELECT row_id, execution FROM executions WHERE execution <> 'timeout' AND NOT starts_with(execution, '[]')", ["executions"])
def drop_rows_by_key(spark, sf):
    df = executions(spark, sf)
    rest = ops.rows_except(df, df.filter("execution = 'timeout'"))
    return ops.rows_except(rest, df.filter(F.startswith("execution", F.lit("[]")))).select("row_id", "execution")
