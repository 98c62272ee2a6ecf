"""Language identification: multinomial naive Bayes over hashed character n-grams.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a training set without a
row makes every text ``und``; equal posteriors go to the language that sorts first; rows are judged one
by one, so repeated ids or texts simply repeat; very long texts are read whole; an empty table gives no rows; columns besides id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quercus.llm.common import bounded_batches, whole_row

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.1
#: Code points worked on at once; longer texts are cut into overlapping runs, so memory stays bounded.
RUN = 1 << 19
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray  # one per language
    log_prob: np.ndarray  # buckets by languages


def runs(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of the lower-cased texts and the row of each, at most about RUN of them at a time."""
    codes, owners, held = [], [], 0
    overlap = max(ORDERS) - 1
    for row, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        start = 0
        while start < len(points):
            piece = points[max(0, start - overlap) : start + RUN]
            # the overlap of a cut text has the row -1 - row, so that its n-grams count once
            owner = np.full(len(piece), row, np.int64)
            owner[: start - max(0, start - overlap)] = -1 - row
            codes.append(piece)
            owners.append(owner)
            held += len(piece)
            start += RUN
            if held >= RUN:
                yield np.concatenate(codes), np.concatenate(owners)
                codes, owners, held = [], [], 0
    if held:
        yield np.concatenate(codes), np.concatenate(owners)


def grams(codes: np.ndarray, owners: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram; an n-gram belongs to the row of its last code point."""
    rows = np.where(owners < 0, -1 - owners, owners)
    rolled = np.zeros(len(codes), np.uint64)
    points = codes.astype(np.uint64) + np.uint64(1)
    for n in range(1, max(ORDERS) + 1):
        rolled = (rolled[: len(codes) - n + 1] if n == 1 else rolled[:-1]) * np.uint64(0x100000001B3) + points[n - 1 :]
        if n in ORDERS:
            last = owners[n - 1 :]
            whole = (last >= 0) & (rows[: len(codes) - n + 1] == last)
            mixed = (rolled[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            yield last[whole], (mixed >> np.uint64(48)).astype(np.int64)


def gram_counts(docs: DataFrame, text_column: str, lang_column: str) -> DataFrame:
    """(lang, bucket, n) over all rows, combined inside each task; bucket -1 counts the documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"lang": lang, "bucket": at - 1, "n": counts[at]})
            held.clear()

        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                counts = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                counts[0] += len(texts)
                for codes, owners in runs(texts):
                    for _, bucket in grams(codes, owners):
                        counts[1:] += np.bincount(bucket, minlength=BUCKETS)
            if len(held) > 100:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    return (
        rows.mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    )


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """The model of the rows with a language.

    Every row counts; what comes to the driver is at most one number per language and bucket.
    """
    bounded_batches(docs.sparkSession)
    got = gram_counts(docs, text_column, lang_column).toPandas()
    languages = sorted(got["lang"].unique())
    place = {lang: i for i, lang in enumerate(languages)}
    table = np.zeros((BUCKETS + 1, len(languages)))
    table[got["bucket"].to_numpy(int) + 1, got["lang"].map(place).to_numpy(int)] = got["n"]
    smooth = table[1:] + SMOOTHING
    return LanguageModel(
        languages,
        np.log(np.maximum(table[0], 1) / max(table[0].sum(), 1)),
        np.log(smooth / smooth.sum(axis=0)) if languages else smooth,
    )


def posteriors(model: LanguageModel, texts) -> np.ndarray:
    """One row per text, one column per language."""
    total = np.tile(model.log_prior, (len(texts), 1))
    step = max(1, (1 << 22) // max(1, len(model.languages)))
    for codes, owners in runs(texts):
        for row, bucket in grams(codes, owners):
            for at in range(0, len(row), step):
                own, part = row[at : at + step], bucket[at : at + step]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[first]] += np.add.reduceat(model.log_prob[part], first, axis=0)
    total -= total.max(axis=1, keepdims=True)
    odds = np.exp(total)
    return odds / odds.sum(axis=1, keepdims=True)


def prediction(spark, model: LanguageModel, text: Column) -> Column:
    """struct<lang_pred, score> of a text; the model is broadcast (languages x buckets numbers)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for texts in batches:
            share = posteriors(m, texts.tolist())
            best = share.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": names[best], "score": share[np.arange(len(best)), best]})

    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.languages:
        return none
    lettered = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    return F.when(lettered, predict.asNondeterministic()(text)).otherwise(none)


def identify(
    docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, lang_pred, score (posterior of the predicted language) of every row."""
    bounded_batches(docs.sparkSession)
    verdict = prediction(docs.sparkSession, model, F.col(text_column)).alias("_v")
    return docs.select(id_column, verdict).select(id_column, "_v.lang_pred", "_v.score")


def keep_identified(
    docs: DataFrame, model: LanguageModel, text_column: str = "text", least: float = 0.5
) -> DataFrame:
    """The rows, all columns, whose language is known with a posterior of ``least`` or more."""
    bounded_batches(docs.sparkSession)
    verdict = prediction(docs.sparkSession, model, docs[text_column])
    kept = docs.select(whole_row(docs), verdict.alias("_v"))
    return kept.filter((F.col("_v.lang_pred") != UNKNOWN) & (F.col("_v.score") >= least)).select("_row.*")
