"""Quality by co-training: one classifier sees the text, the other the metadata, and each teaches the other.

Both start from the labelled rows. In each round each scores all unlabelled rows and hands the ones it is
sure of, with its label, to the training rows of the other; however many they are, together they weigh a fixed
share of what the labelled rows weigh. At the end both are calibrated by isotonic regression on labelled rows
that neither was fitted on, and a logistic regression of the calibrated views gives the score. Labelled rows are
a bounded sample, unlabelled ones are all used: their features are written once, and fits run on executors.

Defined cases: a null text counts as empty, an empty one has all text features 0; null language and source
are values of their own, a null or negative length counts as 0; without labels, or with one class only, all
rows get the same score; rows are judged one by one, so rows that are equal in all named columns tie; very long texts
are read whole; an empty table gives no rows; columns besides those named are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from quercus.llm.boosting import Calibration, fit_isotonic
from quercus.llm.common import bounded_batches, bounded_sample, settle

#: Labelled rows that the classifiers are fitted on at most.
MAX_FIT_ROWS = 20_000
ROUNDS = 3
SURE = 0.97
#: Weight of all pseudo-labels of a round as a share of the weight of the labelled rows; 0.3 each at most.
PSEUDO_SHARE, PSEUDO_WEIGHT = 0.4, 0.3
BUCKETS = 64

TEXT_FEATURES = (
    "log_words", "word_length", "long_words", "capitals", "digits", "stops", "exclamations", "pipes", "symbols",
    "different_words", "repeated_neighbours", "repeated_lines", "short_lines", "shouted_words", "signed_words", "blank",
)


def text_features(text: str | None) -> list[float]:
    if not text:
        return [0.0] * len(TEXT_FEATURES)
    words = text.split()
    n = max(len(words), 1)
    lines = [line for line in text.split("\n") if line.strip()]
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = np.bincount(np.minimum(points, 192), minlength=193)
    upper = int(counts[65:91].sum())
    letters = max(upper + int(counts[97:123].sum()) + int(counts[192]), 1)
    visible = max(len(points) - int(counts[9:14].sum()) - int(counts[32]), 1)

    def rate(k: float) -> float:
        return float(np.log1p(100 * k))

    symbols = sum(int(counts[ord(c)]) for c in "#*$%&<>^~=+_@{}[]\\")
    same = sum(a == b for a, b in zip(words, words[1:]))
    signed = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?)\"'»")
    return [
        float(np.log1p(len(words))), min(visible / n, 30.0), rate(sum(len(w) > 20 for w in words) / n), rate(upper / letters),
        rate(counts[48:58].sum() / visible), rate((counts[46] + counts[44]) / visible), rate(counts[33] / visible),
        rate(counts[124] / visible), rate(symbols / visible), len(set(words)) / n, rate(same / n),
        rate(1 - len(set(lines)) / max(len(lines), 1)), rate(sum(len(x) < 20 for x in lines) / max(len(lines), 1)),
        rate(sum(map(str.isupper, words)) / n if upper > 0.2 * letters else 0.0), rate(signed / n),
        (len(points) - visible) / len(points),
    ]


def metadata_features(lang, source, length) -> list[float]:
    """Length and hashed one-hot places of language, source and both; nothing of the text."""
    out = [0.0] * (BUCKETS + 2)
    size = float(np.log1p(max(float(length), 0.0))) if length is not None and length == length else 0.0
    out[0], out[1] = size, size * size / 10
    for value in (f"l={lang}", f"s={source}", f"b={lang}/{source}"):
        out[2 + zlib.crc32(value.encode()) % BUCKETS] += 1.0
    return out


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -300, 300)))


@dataclass
class QualityModel:
    text: Linear
    metadata: Linear
    text_calibration: Calibration
    metadata_calibration: Calibration
    both: Linear

    def scores(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.text_calibration(self.text.probability(x_text))
        b = self.metadata_calibration(self.metadata.probability(x_meta))
        return self.both.probability(np.column_stack([log_odds(a), log_odds(b)])), a, b


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.002, 0.998)
    return np.log(p / (1 - p))


def fit_linear(rows: DataFrame, features: str, size: int) -> Linear:
    """A logistic regression of (features, label, weight); one class alone gives its share."""
    seen = {int(r.label) for r in rows.select("label").distinct().collect()}
    if len(seen) < 2:
        return Linear(np.zeros(size), 6.0 if 1 in seen else -6.0 if 0 in seen else 0.0)
    data = rows.select(array_to_vector(features).alias("x"), F.col("label").cast("double").alias("y"), "weight")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=1e-3, maxIter=25).fit(data)
    return Linear(np.array(model.coefficients.toArray()), float(model.intercept))


def views(text: Column, lang: Column, source: Column, length: Column) -> tuple[Column, Column]:
    @F.pandas_udf("array<double>")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in texts])

    @F.pandas_udf("array<double>")
    def of_metadata(lang: pd.Series, source: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([metadata_features(*row) for row in zip(lang, source, length)])

    return of_text(text), of_metadata(lang.cast("string"), source.cast("string"), length.cast("double"))


def scorer(model: Linear):
    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.array(features.tolist()).reshape(-1, len(model.weights))))

    return score


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang: str = "lang",
    source: str = "source", length: str = "n_chars", label_column: str = "quality", rounds: int = ROUNDS,
    max_fit_rows: int = MAX_FIT_ROWS,
) -> QualityModel:
    """Both views and their combination, from the labelled rows of ``docs`` and all others."""
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    marks = marks.groupBy(id_column).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    part = F.pmod(F.xxhash64(F.lit(3), F.coalesce(F.col(text_column), F.lit(""))), F.lit(10)).alias("part")
    x_text, x_meta = views(*[F.col(c) for c in (text_column, "_lang", "_source", "_length")])
    given = docs.select(
        F.col(id_column).alias("_id"), part, x_text.alias("x_text"), F.col(lang).alias("_lang"),
        F.col(source).alias("_source"), F.col(length).alias("_length"),
    )
    # texts are read once, where they lie; what is joined with the labels is narrow
    given = settle(given, "quality-features")
    fit_marks = bounded_sample(marks, id_column, max_fit_rows).withColumnRenamed(id_column, "_id")
    known = settle(given.join(fit_marks, "_id").select("label", "part", "x_text", x_meta.alias("x_meta")), "quality-labelled")
    # labels grow with the documents, so they are never broadcast here
    marked = marks.select(F.col(id_column).alias("_id")).hint("merge")
    pool = settle(given.join(marked, "_id", "left_anti").select("x_text", x_meta.alias("x_meta")), "quality-unlabelled")

    train = known.filter(F.col("part") < 7).withColumn("weight", F.lit(1.0)).select("x_text", "x_meta", "label", "weight")
    held, n_train = known.filter(F.col("part") >= 7), train.count()
    sizes = {"x_text": len(TEXT_FEATURES), "x_meta": BUCKETS + 2}
    rows = {"x_text": train, "x_meta": train}
    for r in range(rounds + 1):
        fitted = {view: fit_linear(rows[view], view, size) for view, size in sizes.items()}
        if r == rounds:
            break
        for teacher, pupil in (("x_text", "x_meta"), ("x_meta", "x_text")):
            p = scorer(fitted[teacher])(teacher)
            sure = pool.withColumn("_p", p).filter((F.col("_p") >= SURE) | (F.col("_p") <= 1 - SURE))
            taught = settle(sure.select(pupil, (F.col("_p") >= 0.5).cast("int").alias("label")), f"quality-round-{r}")
            each = min(PSEUDO_WEIGHT, PSEUDO_SHARE * n_train / max(taught.count(), 1))
            rows[pupil] = train.select(pupil, "label", "weight").unionByName(taught.withColumn("weight", F.lit(each)))
    calibration = {
        view: fit_isotonic(held.select(scorer(m)(view).alias("raw"), "label")) for view, m in fitted.items()
    }

    @F.pandas_udf("array<double>")
    def odds(x_text: pd.Series, x_meta: pd.Series) -> pd.Series:
        pairs = []
        for view, x in (("x_text", x_text), ("x_meta", x_meta)):
            grid = np.array(x.tolist()).reshape(-1, sizes[view])
            pairs.append(log_odds(calibration[view](fitted[view].probability(grid))))
        return pd.Series(list(np.column_stack(pairs)))

    joint = held.select(odds("x_text", "x_meta").alias("x"), "label", F.lit(1.0).alias("weight"))
    both = fit_linear(settle(joint, "quality-joint"), "x", 2)
    return QualityModel(fitted["x_text"], fitted["x_meta"], calibration["x_text"], calibration["x_meta"], both)


def judge(
    docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text", lang: str = "lang",
    source: str = "source", length: str = "n_chars",
) -> DataFrame:
    """id, score (share of good texts among such), text_score, metadata_score, predicted, kept of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, text_score double, metadata_score double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts, langs, sources, lengths in batches:
            x_text = np.array([text_features(t) for t in texts]).reshape(-1, len(TEXT_FEATURES))
            x_meta = np.array([metadata_features(*r) for r in zip(langs, sources, lengths)]).reshape(-1, BUCKETS + 2)
            yield pd.DataFrame(dict(zip(("score", "text_score", "metadata_score"), m.scores(x_text, x_meta))))

    given = [F.col(text_column), F.col(lang).cast("string"), F.col(source).cast("string"), F.col(length).cast("double")]
    judged = docs.select(id_column, score.asNondeterministic()(*given).alias("_s")).select(id_column, "_s.*")
    return judged.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "kept": F.col("score") >= 0.5})
