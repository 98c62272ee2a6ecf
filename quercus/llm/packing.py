"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

A document is its ids by the given tokenizer file followed by one end id. One longer than a sequence is
cut into full pieces, with the rest as its first piece; full pieces are sequences of their own. All other
pieces are placed one after the other: each goes where the sum of the squared counts of open bins per
residual gap becomes smallest, a new bin being one of the choices.

Pieces are dealt by a hash to shards of about SHARD_PIECES, and a shard is packed by one task. The number
of shards follows the number of pieces; a shard wastes at most its last open bins.

Defined cases: a null text counts as empty and still has its end id; an empty table gives no rows; rows
with the same id and text are packed each by itself; very long texts are tokenised whole; ties between bins go to the
smallest gap; columns besides id and text are not looked at.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, functions as F

from quercus.llm.common import bounded_batches, settle

LENGTH = 2048
END_ID = 0
SHARD_PIECES = 50_000
#: Words whose ids a task remembers; at the limit it starts anew.
REMEMBERED = 250_000
#: The published pattern that byte-level BPE files of this kind split by, and its pre-tokenizer's name.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRE_TOKENIZER = "ByteLevel"


class _Uneven(Exception):
    """White space beside white space: the text can't be cut at its single spaces."""


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenIds:
    """ids of a text as little-endian unsigned 32-bit numbers, as the tokenizer file defines them.

    The file's vocabulary is applied by its merge ranks. A text whose white space is single spaces splits
    at them into parts that are tokenised independently, so ids of parts are remembered. Texts that hold
    one of the file's added tokens go through the ``tokenizers`` library, and so does every text if the
    file is of another kind.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            kept = json.load(file)
        self.path, self._library = path, None
        self.added = [t["content"] for t in kept.get("added_tokens", [])]
        pre, model = kept.get("pre_tokenizer") or {}, kept["model"]
        plain = (
            pre.get("type") == PRE_TOKENIZER and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and model.get("type") == "BPE" and not kept.get("normalizer") and not model.get("dropout")
        )
        self.core = None
        if plain:
            as_byte = byte_alphabet()
            ranks = {
                bytes(as_byte[c] for c in token): rank
                for token, rank in model["vocab"].items()
                if token not in self.added
            }
            self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if self.core is not None and not any(t in text for t in self.added):
            return array("I", self.core.encode_ordinary(text)).tobytes()
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Uneven
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[part] = ids = array("I", self.core.encode_ordinary(" " + part)).tobytes()
        return ids

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.core is None or any(t in text for t in self.added):
            return self._whole(text)
        first, *rest = text.split(" ")
        try:
            if not first or first[0].isspace() or first[-1].isspace():
                raise _Uneven
            known, part = self.known, self._part
            return self._whole(first) + b"".join([known.get(p) or part(p) for p in rest])
        except _Uneven:
            return self._whole(text)


def pieces(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
    length: int = LENGTH, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. Texts are tokenised where they are read."""
    bounded_batches(docs.sparkSession)
    cells = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"

    @F.pandas_udf(cells)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids_of = TokenIds(tokenizer_path)
        end = array("I", [end_id]).tobytes()
        for texts in batches:
            out = []
            for text in texts:
                ids = memoryview((ids_of(text) if text else b"") + end)
                n = len(ids) // 4
                first = (n - 1) % length + 1
                edges = [0, *range(first, n + 1, length)]
                out.append([
                    {"piece": i, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])}
                    for i, (a, b) in enumerate(zip(edges, edges[1:]))
                ])
            yield pd.Series(out)

    cut_texts = docs.select(id_column, cut.asNondeterministic()(F.col(text_column)).alias("_p"))
    return cut_texts.select(id_column, F.explode("_p").alias("_p")).select(id_column, "_p.*")


def place(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece, in the given order, by the sum-of-squares rule.

    Placing a piece of size s into a bin of gap g takes one from the count of g and adds one to that of
    g - s; a full bin is closed and counts no more. Among equal sums the smallest gap is taken, a new bin last.
    """
    counts = np.zeros(length + 1, np.int64)  # open bins by gap
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    never = np.int64(1) << 60
    for i, size in enumerate(lengths.tolist()):
        # change of the sum of squares, less 2: 2 (count[g - s] - count[g]) for a gap g that stays open
        gain = 2 * (counts[: length + 1 - size] - counts[size:])
        gain[0] = -2 * counts[size] - 1  # an exact fit closes its bin
        gain[counts[size:] == 0] = never
        best = int(gain.argmin())
        fresh = 2 * counts[length - size] - 1 if size < length else -2
        if gain[best] == never or fresh < gain[best]:
            where, gap = made, length
            made += 1
        else:
            gap = best + size
            where = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = where, length - gap
        left = gap - size
        if left:
            open_bins[left].append(where)
            counts[left] += 1
    return bins, offsets


def pack(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
    length: int = LENGTH, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    ``pieces`` is written once, since it is counted before it is dealt out; it holds numbers only. A written
    row number is part of what is dealt by, so that rows that repeat id and text spread over all shards.
    """
    cut = pieces(docs, tokenizer_path, id_column, text_column, length, end_id)
    cut = settle(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    order = F.xxhash64(F.lit(3), "_row", id_column, "piece", "ids_crc32")
    dealt = cut.withColumn("_shard", F.pmod(order, F.lit(shards)).cast("int")).drop("_row")
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields if f.name != "_row"}
    names = list(kinds)

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # a fixed order, so that a task that is run again places every piece alike
        rows = rows.sort_values(["length", "ids_crc32", id_column, "piece"], ascending=[False, True, True, True])
        bins, offsets = place(rows["length"].to_numpy(), length)
        rows["sequence_id"] = (np.int64(key[0]) << 40) + bins
        rows["offset"] = offsets
        return rows[[*names, "sequence_id", "offset"]]

    out = ", ".join(f"`{n}` {k}" for n, k in kinds.items()) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("_shard").applyInPandas(fill, out)
