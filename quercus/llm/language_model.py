"""Scoring by a smoothed n-gram model as a weighted backoff automaton.

Counting: words and n-grams of all training texts are counted exactly, task by task and then by a shuffle. Every
word, and every n-gram that occurs LEAST_COUNT times, is in the model, at any size of the corpus. The model is a
written table of n-grams with their counts and the backoff weights of those that others go on from; no machine
holds it whole.

Automaton: each n-gram shorter than the order is a state. A state has an arc for every kept continuation, with
the discounted log-probability, and a failure arc to its suffix, with the backoff weight; the root has an arc
for every word, with its smoothed unigram probability. One traversal from left to right carries the state of
each text. As a state depends on the last order - 1 tokens only, long texts are walked as lanes that start a few
tokens early, many lanes side by side.

Scoring: texts are cut into chunks of about CHUNK tokens as they lie. A chunk lists each of its n-grams once, a
join brings counts and weights to them, and the chunk walks that part of the automaton. A common n-gram is
listed once per chunk, however often it occurs.

Documents that are scored by a model of their own corpus go through ``corpus_scoring``, which cuts them once.

Defined cases: a null text is empty; an empty text is its end token alone; without training texts every
token is unknown; rows with equal id and text are scored alike and returned as often as they came; columns
besides id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quercus.llm.common import bounded_batches, settle

ORDER = 2
#: An n-gram is kept if it occurs so often, whatever the size of the corpus.
LEAST_COUNT = 2
DISCOUNT = 0.6
END = b""  # no word is empty
LANE = 256
#: Tokens of a chunk, or of one longer text.
CHUNK = 1_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


@dataclass
class Automaton:
    arc_keys: np.ndarray  # state << 32 | word, sorted
    arc_log: np.ndarray
    arc_next: np.ndarray
    fail_log: np.ndarray  # by state; state 0 is the root
    fail_next: np.ndarray
    root_log: np.ndarray  # by word
    start: int
    order: int

    def walk(self, lanes: np.ndarray, states: np.ndarray, skip: np.ndarray, rare: float) -> np.ndarray:
        """Sum of log-probabilities of each lane (a column; -2 is padding) after its first ``skip`` tokens.

        A word that the vocabulary lacks adds ``rare`` (0 where its probability is added later) and leads to the root.
        """
        total = np.zeros(lanes.shape[1])
        live = np.arange(lanes.shape[1])
        for t in range(lanes.shape[0]):
            live = live[lanes[t, live] != -2]
            if not len(live):
                break
            word, state = lanes[t, live], states[live]
            gained = np.zeros(len(live))
            after = np.zeros(len(live), np.int64)
            open_ = np.arange(len(live))
            for _ in range(self.order):
                s, w = state[open_], word[open_]
                key = (s << 32) | np.maximum(w, 0)
                at = np.minimum(np.searchsorted(self.arc_keys, key), max(len(self.arc_keys) - 1, 0))
                hit = (self.arc_keys[at] == key) & (w >= 0) & (s > 0) if len(self.arc_keys) else np.zeros(len(s), bool)
                gained[open_[hit]] += self.arc_log[at[hit]]
                after[open_[hit]] = self.arc_next[at[hit]]
                at_root = ~hit & (s == 0)
                known = open_[at_root & (w >= 0)]
                gained[known] += self.root_log[word[known]]
                after[known] = word[known] + 1 if self.order > 1 else 0
                gained[open_[at_root & (w < 0)]] += rare
                open_ = open_[~hit & (s > 0)]
                if not len(open_):
                    break
                gained[open_] += self.fail_log[state[open_]]
                state[open_] = self.fail_next[state[open_]]
            states[live] = after
            counted = t >= skip[live]
            total[live[counted]] += gained[counted]
        return total


class Numbers(dict):
    """Word -> number, in the order of first use; the end token is 0."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


@dataclass
class Chunk:
    rows: list[pa.Array]  # the other column of its rows
    words: list[bytes]  # by number
    texts: list[np.ndarray]  # each as end, words, end, -1


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[Chunk]:
    """Batches of (any column, text), cut into chunks of about ``most`` tokens."""
    numbers, rows, texts, tokens = Numbers({END: 0}), [], [], 0
    for batch in batches:
        other, start = batch.column(0), 0
        for i, text in enumerate(batch.column(1)):
            words = words_of(text.as_py())
            ids = np.zeros(len(words) + 3, np.int32)
            ids[1:-2] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            ids[-1] = -1
            texts.append(ids)
            tokens += len(ids)
            if tokens >= most:
                yield Chunk([*rows, other.slice(start, i + 1 - start)], list(numbers), texts)
                numbers, rows, texts, tokens, start = Numbers({END: 0}), [], [], 0, i + 1
        if start < len(other):
            rows.append(other.slice(start))
    if texts:
        yield Chunk(rows, list(numbers), texts)


def distinct_grams(ids: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 2 the sorted keys of all n-grams, (entry of the first k - 1 words) << 32 | last word, and how often each occurs."""
    levels, last = [], ids
    for k in range(2, order + 1):
        prefix, word = last[:-1], ids[k - 1 :]
        whole = (prefix >= 0) & (word >= 0)
        keys, entry, n = np.unique((prefix[whole] << 32) | word[whole], return_inverse=True, return_counts=True)
        last = np.full(len(prefix), -1)
        last[whole] = entry
        levels.append((keys, n))
    return levels


def spelled(words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """The n-grams of each order from 1 as text. No word holds a space, so the spaces tell the words apart."""
    single = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())
    out = [single]
    for keys, _ in levels:
        out.append(pc.binary_join_element_wise(out[-1].take(pa.array(keys >> 32)), single.take(pa.array(keys & 0xFFFFFFFF)), " "))
    return out


def count_all(docs: DataFrame, text_column: str, order: int) -> DataFrame:
    """(gram, n): how often every n-gram of each order occurs; the end token is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            ids = np.concatenate(chunk.texts).astype(np.int64)
            levels = distinct_grams(ids, order)
            once = np.bincount(ids[ids >= 0])
            once[0] = len(chunk.texts)  # one end token per text
            for grams, n in zip(spelled(chunk.words, levels), [once, *[n for _, n in levels]]):
                yield pa.RecordBatch.from_arrays([grams, pa.array(n.astype(np.int64))], ["gram", "n"])

    given = docs.select(F.lit(0).alias("no"), F.col(text_column).alias("text"))
    return given.mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class JoinedModel:
    grams: DataFrame  # gram, n, back: every word and kept n-gram, and the log of its backoff weight
    total: int
    distinct: int
    order: int

    @property
    def divisor(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def weighted(counts: DataFrame, order: int, divisor: float) -> DataFrame:
    """(gram, n, back) of counted n-grams; ``back`` is null where nothing goes on from the n-gram."""
    levels = [counts.filter(F.col("k") == k).select("gram", "n") for k in range(1, order + 1)]
    below = levels[0].select(F.col("gram").alias("suffix"), ((F.col("n") + 0.5) / divisor).alias("p"))
    out = []
    for k in range(2, order + 1):
        context = levels[k - 2]
        parts = levels[k - 1].select(
            "gram", "n", F.substring_index("gram", " ", k - 1).alias("prefix"),
            F.expr("substring(gram, instr(gram, ' ') + 1)").alias("suffix"),
        )
        sums = parts.join(below, "suffix").groupBy("prefix").agg(
            F.sum(F.col("n") - DISCOUNT).alias("_explicit"), F.sum("p").alias("_covered")
        )
        left = F.greatest(1 - F.col("_explicit") / F.col("n"), F.lit(1e-12))
        back = F.log10(left / F.greatest(1 - F.col("_covered"), F.lit(1e-12)))
        out.append(context.join(sums, F.col("gram") == F.col("prefix"), "left").select("gram", "n", back.alias("back")))
        if k < order:
            shares = context.select(F.col("gram").alias("prefix"), F.col("n").alias("_c"))
            p = ((F.col("n") - DISCOUNT) / F.col("_c")).alias("p")
            below = parts.join(shares, "prefix").select(F.col("gram").alias("suffix"), p)
    whole = levels[-1].select("gram", "n", F.lit(None).cast("double").alias("back"))
    for level in out:
        whole = whole.unionByName(level)
    return whole


def fit(docs: DataFrame, text_column: str = "text", order: int = ORDER, least_count: int = LEAST_COUNT) -> JoinedModel:
    """The model of all ``docs``."""
    bounded_batches(docs.sparkSession)
    kept = (F.col("n") >= least_count) | ~F.contains("gram", F.lit(" "))
    k = (F.length("gram") - F.length(F.translate("gram", " ", "")) + 1).alias("k")
    counts = settle(count_all(docs, text_column, order).filter(kept).select(k, "gram", "n"), "gram-counts")
    sums = counts.filter("k = 1").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    model = JoinedModel(counts, sums.n or 0, sums.v, order)
    model.grams = settle(weighted(counts, order, model.divisor), "gram-weights")
    return model


def walk_texts(ids: np.ndarray, lengths: np.ndarray, automaton: Automaton, rare: float = 0.0) -> np.ndarray:
    """Log-probability of each text; ``ids`` hold each as end, words, end, -1, ``lengths`` the words of each."""
    warm = automaton.order - 1
    first = np.cumsum(lengths + 3) - (lengths + 3) + 1  # of the first word
    n = lengths + 1  # words and end
    per = -(-n // LANE)
    owner = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[owner] + nth * LANE
    skip = np.where(nth > 0, np.minimum(warm, nth * LANE), 0)
    stop = np.minimum(begin + LANE, (first + n)[owner])
    at = (begin - skip)[None, :] + np.arange(LANE + warm)[:, None]
    lanes = np.where(at < stop[None, :], ids[np.minimum(at, len(ids) - 1)], -2)
    states = np.where(nth == 0, automaton.start, 0)
    sums = automaton.walk(lanes, states, skip, rare)
    return np.bincount(owner, sums, len(n))


def assemble(sizes: list[int], levels: list[np.ndarray], counts: list[np.ndarray], back: list[np.ndarray], divisor: float) -> Automaton:
    """The automaton over the n-grams of a chunk; those with count 0 are not in the model and have no arc.

    ``levels`` are the sorted keys of each order from 2; ``sizes``, ``counts`` and ``back`` begin with the words.
    """
    order = len(sizes)
    offset = np.cumsum([1, *sizes])  # first state of each order
    n_states = int(offset[order - 1])
    fail_log, fail_next = np.zeros(n_states), np.zeros(n_states, np.int64)
    arc_keys, arc_log, arc_next = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
    suffix = np.zeros(sizes[0], np.int64)
    for k, keys in enumerate(levels, 2):
        prefix, word = keys >> 32, keys & 0xFFFFFFFF
        own_suffix = word if k == 2 else np.searchsorted(levels[k - 3], (suffix[prefix] << 32) | word)
        first = int(offset[k - 2])
        fail_log[first : first + sizes[k - 2]] = back[k - 2]
        fail_next[first : first + sizes[k - 2]] = 0 if k == 2 else offset[k - 3] + suffix
        has = counts[k - 1] > 0
        arc_keys.append((((first + prefix) << 32) | word)[has])
        arc_log.append(np.log10((counts[k - 1][has] - DISCOUNT) / counts[k - 2][prefix[has]]))
        arc_next.append((offset[k - 1] + np.arange(len(keys)) if k < order else offset[k - 2] + own_suffix)[has])
        suffix = own_suffix
    keys = np.concatenate(arc_keys)
    by = np.argsort(keys, kind="stable")
    return Automaton(
        keys[by], np.concatenate(arc_log)[by], np.concatenate(arc_next)[by], fail_log, fail_next,
        np.log10((counts[0] + 0.5) / divisor), 1 if order > 1 else 0, order,
    )


def score_joined(docs: DataFrame, model: JoinedModel, id_column: str, text_column: str) -> DataFrame:
    order, divisor = model.order, model.divisor
    kind = docs.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for nth, chunk in enumerate(chunks(batches)):
            rows = pa.chunked_array(chunk.rows).combine_chunks()
            yield pa.RecordBatch.from_arrays([
                pa.array([task + nth]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                pa.array([np.concatenate(chunk.texts).tobytes()], pa.binary()), pa.array([b" ".join(chunk.words)], pa.binary()),
            ], ["chunk", "ids", "tokens", "words"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, tokens, words in zip(*(batch.column(c) for c in ("chunk", "tokens", "words"))):
                levels = distinct_grams(np.frombuffer(tokens.as_buffer(), np.int32).astype(np.int64), order)
                for k, grams in enumerate(spelled(words.as_py().split(b" "), levels)):
                    entry = pa.array((k << 32) | np.arange(len(grams)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), number.as_py())), entry, grams], ["_chunk", "entry", "gram"])

    def walk(chunk: pa.Table, met: pa.Table) -> pa.Table:
        ids = np.frombuffer(chunk.column("tokens")[0].as_buffer(), np.int32).astype(np.int64)
        lengths = np.diff(np.flatnonzero(ids < 0), prepend=-1) - 3  # words of each text
        levels = [keys for keys, _ in distinct_grams(ids, order)]
        sizes = [int(ids.max(initial=0)) + 1, *map(len, levels)]
        counts, back = [np.zeros(n) for n in sizes], [np.zeros(n) for n in sizes]
        entry, n = met.column("entry").to_numpy(), met.column("n").to_numpy()
        weight = met.column("back").fill_null(0.0).to_numpy()
        for j in range(order):
            own = entry >> 32 == j
            at = entry[own] & 0xFFFFFFFF
            counts[j][at], back[j][at] = n[own], weight[own]
        automaton = assemble(sizes, levels, counts, back, divisor)
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        first = np.ones(len(ids), bool)
        first[np.cumsum(lengths + 3) - (lengths + 3)] = False
        own = ids[first & (ids >= 0)]  # words and the closing end token
        base = np.bincount(owner, automaton.root_log[own], len(lengths))
        known = np.bincount(owner, counts[0][own] > 0, len(lengths)).astype(np.int64)
        sums = walk_texts(ids, lengths, automaton)
        names = ["id", "n_tokens", "n_known", "base_score", "score"]
        return pa.Table.from_arrays([chunk.column("ids")[0].values, *map(pa.array, (lengths + 1, known, base, sums))], names)

    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    cuts = settle(given.mapInArrow(cut, f"chunk bigint, ids array<{kind}>, tokens binary, words binary"), "chunks")
    grams = cuts.select("chunk", "tokens", "words").mapInArrow(listed, "_chunk bigint, entry bigint, gram string")
    met = grams.join(model.grams, "gram").select("_chunk", "entry", "n", "back")
    scored = cuts.select("chunk", "ids", "tokens").groupBy("chunk").cogroup(met.groupBy("_chunk")).applyInArrow(
        walk, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.withColumnRenamed("id", id_column)


def score(docs: DataFrame, model: JoinedModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score, score of every row."""
    bounded_batches(docs.sparkSession)
    return score_joined(docs, model, id_column, text_column)
