"""Text overlap between predictions and references: ROUGE, BLEU, METEOR (exact stage).

Input is ``(row_id, prediction, reference)``, one row per text; the key is unique, so no key is hot.
Tokens are our own fixed rules, stated in each function.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quercus.functions.text import TOKEN, sentence_lines
from quercus.operators.ordering import as_scalar, by_key, global_position


#: Characters of both texts in one task, which holds their n-grams in hash tables of about a hundred bytes a character.
TASK_CHARS = 2_000_000


def text_tasks(df: DataFrame) -> int:
    """As many tasks as leave each about ``TASK_CHARS``, so that its memory does not grow with the table."""
    chars = F.coalesce(F.length("prediction"), F.lit(0)) + F.coalesce(F.length("reference"), F.lit(0))
    return -(-(df.agg(F.sum(chars)).first()[0] or 0) // TASK_CHARS)


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def bleu_tokens(text: Column) -> Column:
    """Words and single punctuation marks, case kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def _ngrams(tokens: Column, n: int, side: str) -> Column:
    """The n-grams of a text, each as 128 bits of hash, so that counting them needs no texts as keys."""
    size = F.size(tokens) - F.lit(n - 1)
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))

    def gram(i):
        members = [F.get(tokens, i + j) for j in range(n)]
        return F.xxhash64(F.lit(1), *members).alias("h1"), F.xxhash64(F.lit(2), *members).alias("h2")

    return F.transform(
        starts,
        lambda i: F.struct(
            F.lit(n).alias("n"), *gram(i), F.lit(side == "p").cast("int").alias("p"), F.lit(side == "r").cast("int").alias("r"),
        ),
    )


def ngram_matches(df: DataFrame, tokens, sizes: list[int], key: str = "row_id", tasks: int | None = None) -> DataFrame:
    """(key, n, clipped matches, prediction n-grams, reference n-grams), one row per text and n; a
    text without n-grams has one row with a null n.

    The texts are shuffled once by their key; their n-grams, many times larger, are then counted
    where they are. ``tasks`` is what ``text_tasks`` says, for who asks it once for several metrics.
    """
    cut = by_key(df, key, text_tasks(df) if tasks is None else tasks).select(key, tokens(F.col("prediction")).alias("_p"), tokens(F.col("reference")).alias("_r"))
    grams = F.concat(*[_ngrams(F.col("_p"), n, "p") for n in sizes], *[_ngrams(F.col("_r"), n, "r") for n in sizes])
    counts = cut.select(key, F.inline_outer(grams)).groupBy(key, "n", "h1", "h2").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    return counts.groupBy(key, "n").agg(
        F.sum(F.least("p", "r")).alias("matches"), F.sum("p").alias("n_pred"), F.sum("r").alias("n_ref")
    )


def _f1(matches: Column, n_pred: Column, n_ref: Column) -> Column:
    return F.when(n_pred + n_ref > 0, 2.0 * matches / (n_pred + n_ref)).otherwise(0.0)


def rouge_n(df: DataFrame, key: str = "row_id", tasks: int | None = None) -> DataFrame:
    """ROUGE-1 and ROUGE-2 F1 per text; 0 where a text has no n-gram."""
    scored = ngram_matches(df, rouge_tokens, [1, 2], key, tasks).withColumn(
        "f1", _f1(F.col("matches"), F.col("n_pred"), F.col("n_ref"))
    )
    return scored.groupBy(key).agg(
        *[F.coalesce(F.max(F.when(F.col("n") == n, F.col("f1"))), F.lit(0.0)).alias(f"rouge{n}") for n in (1, 2)]
    )


def corpus_bleu(df: DataFrame, key: str = "row_id", tasks: int | None = None) -> DataFrame:
    """BLEU-4 over the whole corpus: clipped n-gram sums, geometric mean, brevity penalty."""
    sums = ngram_matches(df, bleu_tokens, [1, 2, 3, 4], key, tasks).agg(
        *[F.coalesce(F.sum(F.when(F.col("n") == n, F.col("matches"))), F.lit(0)).alias(f"m{n}") for n in (1, 2, 3, 4)],
        *[F.coalesce(F.sum(F.when(F.col("n") == n, F.col("n_pred"))), F.lit(0)).alias(f"t{n}") for n in (1, 2, 3, 4)],
        F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("n_ref"))), F.lit(0)).alias("ref_len"),
    )
    logs = sum(F.ln(F.col(f"m{n}") / F.col(f"t{n}")) for n in (1, 2, 3, 4)) / 4
    some = F.least(*[F.col(f"m{n}") for n in (1, 2, 3, 4)]) > 0
    brevity = F.when(F.col("t1") >= F.col("ref_len"), F.lit(1.0)).otherwise(F.exp(1 - F.col("ref_len") / F.col("t1")))
    return sums.select(
        F.when(some, brevity * F.exp(logs)).otherwise(0.0).alias("bleu"),
        F.col("t1").alias("pred_len"), "ref_len",
    )


def meteor_exact(
    df: DataFrame, key: str = "row_id", alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, tasks: int | None = None
) -> DataFrame:
    """METEOR with exact word matches only, per text.

    Tokens are white-space cut and lower-cased. The k-th last copy of a word in the prediction is
    matched with its k-th last copy in the reference; a chunk is a run of matches that is adjacent
    in both. The texts are shuffled once by their key; what follows works on the words of one text.
    """

    def words(text):
        return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")

    def placed(tokens, side):
        return F.transform(tokens, lambda t, i: F.struct(F.lit(side).alias("side"), t.alias("word"), i.alias("pos")))

    cut = by_key(df, key, text_tasks(df) if tasks is None else tasks).select(key, words("prediction").alias("_p"), words("reference").alias("_r"))
    long = cut.select(
        key, F.size("_p").alias("n_pred"), F.size("_r").alias("n_ref"),
        F.inline_outer(F.concat(placed(F.col("_p"), "p"), placed(F.col("_r"), "r"))),
    )
    copies = Window.partitionBy(key, "word", "side").orderBy(F.desc("pos"))
    pairs = (
        long.withColumn("copy", F.row_number().over(copies))
        .groupBy(key, "word", "copy", "n_pred", "n_ref")
        .agg(F.max(F.when(F.col("side") == "p", F.col("pos"))).alias("p"), F.max(F.when(F.col("side") == "r", F.col("pos"))).alias("r"))
        .withColumn("hit", F.col("p").isNotNull() & F.col("r").isNotNull())
    )
    in_text = Window.partitionBy(key, "hit").orderBy("p")
    adjacent = (F.col("p") == F.lag("p").over(in_text) + 1) & (F.col("r") == F.lag("r").over(in_text) + 1)
    matched = (
        pairs.withColumn("start", F.col("hit") & ~F.coalesce(adjacent, F.lit(False)))
        .groupBy(key, "n_pred", "n_ref").agg(F.count_if("hit").alias("m"), F.count_if("start").alias("chunks"))
    )
    precision, recall = F.col("m") / F.col("n_pred"), F.col("m") / F.col("n_ref")
    f_mean = precision * recall / (alpha * precision + (1 - alpha) * recall)
    penalty = gamma * F.pow(F.col("chunks") / F.col("m"), F.lit(beta))
    return matched.select(key, F.when(F.col("m") > 0, f_mean * (1 - penalty)).otherwise(0.0).alias("meteor"))


# ---- longest common subsequence: no expression for it, so Arrow batches --------------------------


def _places(tokens: list[str]) -> dict[str, int]:
    """Token -> the places where it stands, as bits."""
    where: dict[str, int] = {}
    for j, token in enumerate(tokens):
        where[token] = where.get(token, 0) | (1 << j)
    return where


def _next_row(row: int, where: dict[str, int], token: str, full: int) -> int:
    """One step of the bit-parallel table: the zeros of a row are the columns at which the length grows."""
    hit = row & where.get(token, 0)
    return ((row + hit) | (row - hit)) & full


def lcs_length(ref: list[str], cand: list[str]) -> int:
    row = full = (1 << len(cand)) - 1
    where = _places(cand)
    for token in ref:
        row = _next_row(row, where, token, full)
    return (full ^ row).bit_count()


def lcs_places(ref: list[str], cand: list[str]) -> set[int]:
    """Places in ``ref`` of one longest common subsequence (walk back: left before up).

    Of the table's rows only every s-th is kept, s being the root of their number; the walk back works out the rows
    between two kept ones again, one stretch at a time. So 2 s rows are held, not all of them.
    """
    where, full = _places(cand), (1 << len(cand)) - 1
    stretch = math.isqrt(len(ref)) + 1
    kept, row = [full], full
    for i, token in enumerate(ref, 1):
        row = _next_row(row, where, token, full)
        if i % stretch == 0:
            kept.append(row)
    places, i, j = set(), len(ref), len(cand)
    left = full
    while i > 0 and j > 0:
        first = (i - 1) // stretch * stretch
        rows = [kept[first // stretch]]
        for token in ref[first:i]:
            rows.append(_next_row(rows[-1], where, token, full))
        grows = [full ^ r for r in rows]  # of the rows first to i
        while i > first and j > 0:
            if ref[i - 1] == cand[j - 1]:
                places.add(i - 1)
                i, j, left = i - 1, j - 1, left >> 1
            elif (grows[i - first] & left).bit_count() > (grows[i - first - 1] & left).bit_count():
                j, left = j - 1, left >> 1
            else:
                i -= 1
    return places


def _f_measure(hits: int, n_pred: int, n_ref: int) -> float:
    return 2.0 * hits / (n_pred + n_ref) if hits else 0.0


def _summary_hits(ref_lines: list[list[str]], pred_lines: list[list[str]]) -> int:
    left_ref = Counter(t for line in ref_lines for t in line)
    left_pred = Counter(t for line in pred_lines for t in line)
    hits = 0
    for ref in ref_lines:
        union = set().union(*(lcs_places(ref, pred) for pred in pred_lines))
        for place in sorted(union):
            token = ref[place]
            if left_pred[token] > 0 and left_ref[token] > 0:
                hits += 1
                left_pred[token] -= 1
                left_ref[token] -= 1
    return hits


def _cut(tokens_per_line) -> list[list[str]]:
    return [list(line) for line in tokens_per_line if len(line)]


def rouge_l(df: DataFrame, key: str = "row_id") -> DataFrame:
    """ROUGE-L (whole text) and ROUGE-Lsum (line by line) F1 per text; whole texts, no cap; a null text is empty."""

    def lines(text):
        return F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda line: rouge_tokens(line))

    cut = df.select(key, lines("prediction").alias("p"), lines("reference").alias("r"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole, summary = [], []
            for p, r in zip(batch["p"], batch["r"]):
                pred, ref = _cut(p), _cut(r)
                flat_p, flat_r = [t for x in pred for t in x], [t for x in ref for t in x]
                whole.append(_f_measure(lcs_length(flat_r, flat_p), len(flat_p), len(flat_r)))
                summary.append(_f_measure(_summary_hits(ref, pred), len(flat_p), len(flat_r)))
            yield pd.DataFrame({key: batch[key], "rougeL": whole, "rougeLsum": summary})

    kind = df.schema[key].dataType.simpleString()
    return cut.mapInPandas(score, schema=f"`{key}` {kind}, rougeL double, rougeLsum double")


def text_report(
    df: DataFrame, key: str = "row_id", lcs: tuple[str, ...] = ("rougeL", "rougeLsum"), by_sentence: bool = True
) -> DataFrame:
    """Means over the corpus, one row; each metric is averaged by itself, so texts are not joined.

    ``lcs`` names the metrics of the longest common subsequence that are wanted. ``by_sentence`` puts
    each sentence of both texts on a line of its own for them, which matters to the line-wise one.
    """

    def mean(scored, *names):
        return scored.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])

    tasks = text_tasks(df)
    parts = [mean(rouge_n(df, key, tasks), "rouge1", "rouge2")]
    if lcs:
        cut = df
        if by_sentence:
            cut = df.select(key, *[sentence_lines(F.col(c)).alias(c) for c in ("prediction", "reference")])
        parts.append(mean(rouge_l(cut, key), *lcs))
    report = mean(meteor_exact(df, key, tasks=tasks), "meteor").withColumn("bleu", corpus_bleu(df, key, tasks).select("bleu").scalar())
    for i, part in enumerate(parts):
        report = report.withColumn(f"_{i}", as_scalar(part))
    return report.select(*[f"_{i}.*" for i in range(len(parts))], "meteor", "bleu")


def align_by_position(predictions: DataFrame, targets: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions beside the targets at the same position in the order of the key; what is longer is cut.

    The key of the prediction stays.
    """
    left = global_position(predictions, [key], "_position")
    right = global_position(targets, [key], "_position").drop(key)
    return left.join(right, "_position").drop("_position")
