"""Benchmark decontamination: Wu-Manber search of documents for word windows of benchmark items.

Texts become lower-case words joined by one space, and a window of ten item words is a byte string with a
space on either side. A table of shifts over hashed byte blocks tells how far the search may move without
missing a string; where it may not move, the block at the end of the shortest string selects a bucket of
strings, which are compared directly. Many cursors move over a batch of documents at once.

Items are taken in blocks of bounded size, each searched in all documents, so what is broadcast does not
grow with the benchmark.

Defined cases: null and empty texts have no words and no hits; an item of fewer than ten words, but not
none, is one window; equal windows of several items count for each; items of one id count as one item, and
a null id reads as the empty one; an empty benchmark contaminates nothing; rows are judged one by one, and very
long texts are searched whole; an empty table of documents gives no rows; columns besides id and text are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quercus.llm.common import bounded_batches, settle, whole_row

WINDOW = 10
#: Bytes of item text per block of the benchmark.
BLOCK_BYTES = 2 << 20
#: Bytes of a batch that one cursor walks over.
LANE = 4096
TABLE_BITS = 20

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


class StringSet:
    """Shift table and suffix buckets of strings that are at least ``least`` bytes long."""

    def __init__(self, strings: dict[bytes, int]):
        self.least = min(map(len, strings))
        self.block = 8 if self.least >= 16 else min(3, self.least)
        self.buckets: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        self.shift = np.full(1 << TABLE_BITS, self.least - self.block + 1, np.int64)
        heads = np.frombuffer(b"".join(s[: self.least] for s in strings), np.uint8).reshape(-1, self.least)
        for end in range(self.block, self.least + 1):
            blocks = self._blocks(heads[:, end - self.block : end])
            np.minimum.at(self.shift, self._slot(blocks), self.least - end)
        for key, (string, number) in zip(blocks.tolist(), strings.items()):
            self.buckets[key].append((string, number))

    @staticmethod
    def _blocks(columns: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(columns), 8), np.uint8)
        wide[:, : columns.shape[1]] = columns
        return wide.view(np.uint64).ravel()

    @staticmethod
    def _slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def find(self, data: bytes) -> Iterator[tuple[int, int]]:
        """(place, number) of every occurrence of every string in ``data``."""
        last = len(data) - self.least
        if last < 0:
            return
        seen = np.frombuffer(data, np.uint8)
        at = np.arange(0, last + 1, LANE)
        stop = np.minimum(at + LANE, last + 1)
        reach = np.arange(self.least - self.block, self.least)
        while len(at):
            blocks = self._blocks(seen[at[:, None] + reach])
            move = self.shift[self._slot(blocks)]
            here = move == 0
            for place, key in zip(at[here].tolist(), blocks[here].tolist()):
                for string, number in self.buckets.get(key, ()):
                    if data.startswith(string, place):
                        yield place, number
            at = at + np.maximum(move, 1)
            going = at < stop
            at, stop = at[going], stop[going]


class Windows:
    """The windows of some items, in classes of length so that a short item does not slow the long ones."""

    CLASSES = (8, 16, 32)

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.owners: list[set[str]] = []
        self.n_words: list[int] = []
        numbers: dict[bytes, int] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(len(words) - window, 0) + 1 if words else 0):
                part = words[i : i + window]
                number = numbers.setdefault(b" " + b" ".join(part) + b" ", len(numbers))
                if number == len(self.owners):
                    self.owners.append(set())
                    self.n_words.append(len(part))
                self.owners[number].add(item)
        classes: dict[int, dict[bytes, int]] = defaultdict(dict)
        for string, number in numbers.items():
            classes[sum(len(string) >= c for c in self.CLASSES)][string] = number
        self.sets = [StringSet(c) for c in classes.values()]

    def search(self, texts) -> pd.DataFrame:
        """n_words, spans (merged intervals of hit words) and items of every text."""
        words = [words_of(t) for t in texts]
        parts = [b" " + b" ".join(w) + b" " for w in words]
        starts = np.cumsum([0] + [len(p) + 1 for p in parts])
        data = b"\n".join(parts)  # no string holds a line feed, so none reaches from one text into the next
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for strings in self.sets:
            for place, number in strings.find(data):
                row = int(np.searchsorted(starts, place, "right")) - 1
                found[row].append((place - int(starts[row]), number))
        spans, items = [[] for _ in parts], [[] for _ in parts]
        for row, hits in found.items():
            gaps = np.flatnonzero(np.frombuffer(parts[row], np.uint8) == 32)
            first = np.searchsorted(gaps, [place for place, _ in hits])
            spans[row] = merged((int(a), int(a) + self.n_words[k]) for a, (_, k) in zip(first, hits))
            items[row] = sorted(set().union(*(self.owners[k] for _, k in hits)))
        return pd.DataFrame({"n_words": [len(w) for w in words], "spans": spans, "items": items})


def merged(spans) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], b)
        else:
            out.append({"a": a, "b": b})
    return out


_FOUND = "n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"


def _search_column(spark, items: list[tuple[str, str | None]], window: int, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(Windows(items, window))

    @F.pandas_udf(_FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        windows = shared.value
        for texts in batches:
            yield windows.search(texts.tolist())

    return search.asNondeterministic()(text)


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    rows = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(item_text), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def found(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(_row, _f): all columns of a row as a struct, and n_words, spans and items of its text."""
    spark = docs.sparkSession
    bounded_batches(spark)

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def merge_spans(spans: pd.Series) -> pd.Series:
        return pd.Series([merged((s["a"], s["b"]) for s in row) for row in spans])

    out = None
    row = whole_row(docs)
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        if out is None:
            out = docs.select(row, _search_column(spark, items, window, docs[text_column]).alias("_f"))
            continue
        # a further block: what was found so far is written, so that one search at a time holds its tables
        before = settle(out, "decontamination")
        more = before.withColumn("_g", _search_column(spark, items, window, F.col(f"_row.{text_column}")))
        out = more.select(
            "_row",
            F.struct(
                "_f.n_words", merge_spans(F.concat("_f.spans", "_g.spans")).alias("spans"),
                F.array_union("_f.items", "_g.items").alias("items"),
            ).alias("_f"),
        )
    return out


def search(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """id, n_words, n_hit, spans (word intervals, half open), items (ids, sorted), contaminated of every row."""
    hits = found(docs.select(id_column, text_column), benchmark, text_column, **options)
    n_hit = F.aggregate("_f.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    return hits.select(
        F.col(f"_row.{id_column}").alias(id_column), "_f.n_words", n_hit.alias("n_hit"), "_f.spans",
        F.array_sort("_f.items").alias("items"), (F.size("_f.spans") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows, all columns, in which no window occurs."""
    return found(docs, benchmark, text_column, **options).filter(F.size("_f.spans") == 0).select("_row.*")


