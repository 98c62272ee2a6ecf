"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

from pyspark.sql import DataFrame, SparkSession

LONG = "the house of the long road " * 12_000
ODD_TEXTS = [
    None, "", " \n\t ", "12345 67 !!", "a", "two words", "Ünï cödé straße 日本語 \U0001f600", "x" * 70_000, LONG,
    "one two three four five six seven eight nine ten eleven", "one two three four five six seven eight nine ten eleven",
    "<|im_end|> <|endoftext|> #*$%&|<>", "a  b\r\n c d\x0b\x0c e", "nul\x00byte",
]
#: Names that operators use for columns of their own.
CLASH = (
    "score", "predicted", "lang_pred", "n_words", "bands", "node", "hub", "class_id", "h1", "number", "_row", "_v", "_f", "_s",
    "word", "n", "id", "digest", "piece", "start", "length", "features", "label", "part", "_pool", "kept", "position", "items", "a.b", "_n", "_m",
)


def odd_documents(spark: SparkSession, with_clash: bool = True) -> DataFrame:
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", None)[i % 2], len(t) if t else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[9], (None, "text without an id", "en", "s1", 18)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if with_clash:
        for name in CLASH:
            df = df.selectExpr("*", f"'extra' AS `{name}`")
    return df


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def texts(df: DataFrame) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
