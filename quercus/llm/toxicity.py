"""Toxicity: gradient-boosted trees over dense features of the text, calibrated by isotonic regression.

The lexicon is learned from the labelled texts too: words, and the first letters of words, that are many
times more frequent among toxic texts. Labelled rows are dealt by a hash of the text into three parts,
for the lexicon, the trees and the calibration, so that no part judges what it was made from, and copies
of a text stay together.

Defined cases: a null text counts as empty; an empty text has all features 0 and gets the score that the
trees give it; labels that are null are left out; with no label, or one class only, all rows get the same score; rows are judged one by one, so equal texts tie; very long texts are read whole; an empty table gives no
rows; columns besides id and text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quercus.llm.boosting import Calibration, Trees, fit_isotonic, fit_trees
from quercus.llm.common import bounded_batches, bounded_sample, settle, whole_row

#: Labelled rows that the classifier is fitted on at most.
MAX_FIT_ROWS = 30_000
STEMS = range(3, 10)  # letters of a stem
NEAR = 5  # words between a hit and a second-person word

SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous "
    "votre vos tú ti tus usted ustedes vosotros vuestro".split()
)
LETTERS = re.compile(r"[^\W\d_]+")
#: Signs and digits that stand for letters, between letters; and a whole word with such.
DISGUISES = "0134579@$*!"
DISGUISE = re.compile(r"(?<=[^\W\d_])[0134579@$*!]+(?=[^\W\d_])")
DISGUISED = re.compile(r"[^\W\d_]+(?:[0134579@$*!]+[^\W\d_]+)+")
PLAIN = str.maketrans("0134579@$!", "oieastgasi")

FEATURES = (
    "lexicon_density", "lexicon_weight", "strongest_hit", "distinct_hits", "stem_density", "strongest_stem",
    "hits_near_you", "you_density", "capitals", "shouted_words", "punctuation", "exclamations", "obfuscated",
    "drawn_out", "log_words",
)


@dataclass
class ToxicityModel:
    words: dict[str, float]
    stems: dict[str, float]
    trees: Trees
    calibration: Calibration


def words_and_disguises(text: str) -> tuple[list[str], int]:
    """Lower-case words of letters, disguised ones as the letters they stand for; and the signs that disguise."""
    lowered, n = text.lower(), 0
    if any(c in lowered for c in DISGUISES):
        n = len(DISGUISE.findall(lowered))
        if n:
            lowered = DISGUISED.sub(lambda m: m[0].translate(PLAIN).replace("*", ""), lowered)
    return LETTERS.findall(lowered), n


def words_of(text: str) -> list[str]:
    return words_and_disguises(text)[0]


def stem_weight(word: str, stems: dict[str, float]) -> float | None:
    return next((stems[word[:k]] for k in STEMS if word[:k] in stems), None)


def features_of(text: str | None, words: dict[str, float], stems: dict[str, float], heads: set[str]) -> list[float]:
    """The features in the order of FEATURES; ``heads`` are the first letters of all stems."""
    if not text:
        return [0.0] * len(FEATURES)
    tokens, n_disguised = words_and_disguises(text)
    n = max(len(tokens), 1)
    different = set(tokens)
    hit_words = {w: words[w] for w in words.keys() & different}
    likely = [w for w in different if w[: min(STEMS)] in heads]
    hit_stems = {w: weight for w in likely if (weight := stem_weight(w, stems)) is not None}
    place = [i for i, w in enumerate(tokens) if w in hit_words or w in hit_stems] if hit_words or hit_stems else []
    weights = [hit_words[tokens[i]] for i in place if tokens[i] in hit_words]
    stem_weights = [hit_stems[tokens[i]] for i in place if tokens[i] in hit_stems]
    n_you = sum(map(SECOND_PERSON.__contains__, tokens)) if SECOND_PERSON & different else 0
    near = 0
    if place and n_you:
        you = np.array([-(1 << 40), *(i for i, w in enumerate(tokens) if w in SECOND_PERSON), 1 << 40])
        at = np.searchsorted(you, place)
        near = int(((place - you[at - 1] <= NEAR) | (you[at] - place <= NEAR)).sum())
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = np.bincount(np.minimum(points, 192), minlength=193)  # 192 stands for all letters and signs from there on
    upper = int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum()) + int(counts[192])
    visible = max(len(points) - int(counts[9:14].sum()) - int(counts[32]), 1)
    signs = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    shouted = sum(map(str.isupper, text.split())) if upper > 0.2 * letters else 0
    drawn = (points[2:] == points[1:-1]) & (points[2:] == points[:-2]) & (points[2:] >= 65)
    return [
        len(weights) / n, sum(weights) / n, max(weights, default=0.0), float(np.log1p(len(hit_words) + len(hit_stems))),
        len(stem_weights) / n, max(stem_weights, default=0.0), near / n, n_you / n, upper / max(letters, 1), shouted / n,
        signs / visible, counts[33] / visible, n_disguised / n,
        int(drawn.sum()) / n, float(np.log1p(len(tokens))),
    ]


def heads_of(stems: dict[str, float]) -> set[str]:
    return {s[: min(STEMS)] for s in stems}


def terms_of(text: str) -> set[str]:
    """The words of a text and, marked by a star, their beginnings."""
    words = set(words_of(text))
    return words | {w[:k] + "*" for w in words for k in range(min(STEMS), min(max(STEMS), len(w)) + 1)}


def count_terms(rows: DataFrame) -> DataFrame:
    """(term, hot, cold): in how many texts of label 1, and of label 0, a term is; counts are combined in each task
    before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush():
            for label, counts in held.items():
                if counts:
                    n = np.fromiter(counts.values(), np.int64, len(counts))
                    yield pd.DataFrame({"term": list(counts), "hot": n * label, "cold": n * (1 - label)})
                    counts.clear()

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                held[label].update(terms_of(text))
            if len(held[0]) + len(held[1]) > 500_000:
                yield from flush()
        yield from flush()

    counted = rows.select("text", "label").mapInPandas(count, "term string, hot bigint, cold bigint")
    return counted.groupBy("term").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold"))


def learn_lexicon(rows: DataFrame, least: int = 6, ratio: float = 15.0) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log odds: in ``least`` toxic texts or more, and ``ratio`` times as frequent there.

    All terms are weighed where they are counted; the driver gets those that pass. Of stems that begin alike, the
    longest is kept that loses next to none of the texts of the shorter.
    """
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n_hot, n_cold = n.get(1, 0), n.get(0, 0)
    if not n_hot or not n_cold:
        return {}, {}
    odds = ((F.col("hot") + 0.5) / (n_hot + 1)) / ((F.col("cold") + 0.5) / (n_cold + 1))
    telling = count_terms(rows).filter(F.col("hot") >= least).withColumn("odds", odds).filter(F.col("odds") >= ratio).collect()
    hot = {r.term: r.hot for r in telling}
    chosen = {r.term: float(np.log(r.odds)) for r in sorted(telling, key=lambda r: r.term)}
    stems: dict[str, float] = {}
    longer: dict[str, int] = {}  # most texts that any one-letter extension of a stem keeps
    for t in chosen:
        if t.endswith("*") and len(t) > min(STEMS) + 1:
            longer[t[:-2]] = max(longer.get(t[:-2], 0), hot[t])
    for t in sorted((t[:-1] for t in chosen if t.endswith("*")), key=lambda t: (len(t), t)):
        covered = any(t[:k] in stems for k in range(min(STEMS), len(t)))
        if not covered and longer.get(t, 0) < 0.95 * hot[t + "*"]:
            stems[t] = chosen[t + "*"]
    return {t: w for t, w in chosen.items() if not t.endswith("*")}, stems


def _features(words: dict[str, float], stems: dict[str, float]):
    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        heads = heads_of(stems)
        for texts in batches:
            yield pd.Series([features_of(t, words, stems, heads) for t in texts])

    return features


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "toxic", max_fit_rows: int = MAX_FIT_ROWS,
) -> ToxicityModel:
    """The model of the labelled rows of ``docs``; one label per id (the largest, if they differ)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
    marks = marks.groupBy(id_column).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    marks = bounded_sample(marks, id_column, max_fit_rows)
    rows = docs.select(id_column, F.coalesce(F.col(text_column), F.lit("")).alias("text")).join(marks, id_column)
    # copies of one text would count as so many witnesses
    part = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(10))
    rows = rows.select("text", "label").dropDuplicates(["text", "label"]).withColumn("part", part)
    rows = settle(rows.repartition(spark.sparkContext.defaultParallelism), "toxicity-fit")
    words, stems = learn_lexicon(rows.filter(F.col("part") < 5).select("text", "label"))
    made = settle(rows.select("part", "label", _features(words, stems)("text").alias("features")), "toxicity-features")
    trees = fit_trees(made.filter((F.col("part") >= 5) & (F.col("part") < 8)))
    held = made.filter(F.col("part") >= 8)

    @F.pandas_udf("double")
    def raw(features: pd.Series) -> pd.Series:
        return pd.Series(trees.probability(np.array(features.tolist()).reshape(-1, len(FEATURES))))

    calibration = fit_isotonic(held.select(raw("features").alias("raw"), "label"))
    return ToxicityModel(words, stems, trees, calibration)


def score_column(spark, model: ToxicityModel, text: Column) -> Column:
    """Calibrated share of toxic texts among those that look like this one."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        heads = heads_of(m.stems)
        for texts in batches:
            x = np.array([features_of(t, m.words, m.stems, heads) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(m.calibration(m.trees.probability(x)))

    return score.asNondeterministic()(text)


def judge(
    docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, score, predicted (1 if the score is 0.5 or more) of every row."""
    bounded_batches(docs.sparkSession)
    scored = docs.select(id_column, score_column(docs.sparkSession, model, F.col(text_column)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_civil(docs: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """The rows, all columns, that are not predicted toxic."""
    bounded_batches(docs.sparkSession)
    score = score_column(docs.sparkSession, model, docs[text_column])
    return docs.select(whole_row(docs), score.alias("_s")).filter(F.col("_s") < 0.5).select("_row.*")
