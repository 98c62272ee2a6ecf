"""Fill-in-the-middle documents: texts are cut at two of their character boundaries and told out of order.

A boundary is a place between two code points of a text, as an offset in its UTF-8 bytes. The k-th boundary is
found by a learned rank index: a piecewise-linear function from rank to offset, fitted so that no boundary lies
further than EPSILON from its segment's line, with what is left of each boundary stored as one byte. A cut is the
line's value at its rank plus the stored residual, which is exact. Texts of one batch are indexed together, in
groups of about GROUP_BYTES; a longer text is a group of its own.

Where a text is cut and how it is told follows from its id alone: h1 to h4 are the first four 8-digit groups of the
hex sha256 of ``1:`` and the decimal id. The prefix ends after the smaller of h1 mod (n + 1) and h2 mod (n + 1) code
points, the middle after the larger.

Defined cases: a null text is empty; an empty text, and one that holds a marker, stays plain; a null id counts as no
digits; a very long text is indexed and cut whole, by itself; rows with equal id and text give equal rows, as often as
they came, so there are no ties to break; an empty table gives no rows; other columns are kept under ``_row`` and can
not clash with the added ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quercus.llm.common import bounded_batches, whole_row

#: The markers that a model is given.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, how many stay plain; of a hundred others, how many tell the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Widest distance of a boundary from its line; with rounding it still fits one signed byte.
EPSILON = 100
#: Boundaries that a segment is first tried on; doubled as long as the segment goes on.
FIRST_SPAN = 256
#: Bytes of text that are indexed together.
GROUP_BYTES = 1 << 22


@dataclass
class RankIndex:
    """Boundary offset by rank: segments (first rank, offset there, slope) and one residual per boundary."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        return _line(self, ranks) + self.residual[ranks]


def _line(index: RankIndex, ranks: np.ndarray) -> np.ndarray:
    at = np.searchsorted(index.first, ranks, "right") - 1
    return index.base[at] + np.rint(index.slope[at] * (ranks - index.first[at])).astype(np.int64)


def fit(boundaries: np.ndarray, epsilon: int = EPSILON) -> RankIndex:
    """The index of ascending offsets. A segment goes on as long as one line from its first boundary passes
    within ``epsilon`` of all its boundaries: the slopes that do form a cone, which narrows boundary by boundary."""
    first, base, slope = [], [], []
    n, start = len(boundaries), 0
    while start < n:
        low, high, end, span = -np.inf, np.inf, start + 1, FIRST_SPAN
        while end < n:
            ranks = np.arange(end, min(end + span, n))
            rise, run = boundaries[ranks] - boundaries[start], ranks - start
            highs = np.minimum(np.minimum.accumulate((rise + epsilon) / run), high)
            lows = np.maximum(np.maximum.accumulate((rise - epsilon) / run), low)
            broken = lows > highs
            fits = int(broken.argmax()) if broken.any() else len(ranks)
            if fits:
                low, high = lows[fits - 1], highs[fits - 1]
            end += fits
            if fits < len(ranks):
                break
            span *= 2
        first.append(start)
        base.append(boundaries[start])
        slope.append((low + high) / 2 if end > start + 1 else 0.0)
        start = end
    index = RankIndex(
        np.array(first, np.int64), np.array(base, np.int64), np.array(slope, np.float64), np.zeros(0, np.int8)
    )
    left = boundaries - _line(index, np.arange(n)) if n else np.zeros(0, np.int64)
    if n and np.abs(left).max() > np.iinfo(np.int8).max:
        raise ValueError("epsilon is too wide for residuals of one byte")
    index.residual = left.astype(np.int8)
    return index


def boundaries(data: np.ndarray) -> np.ndarray:
    """Offsets in UTF-8 bytes at which a code point starts, and the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes together stay within ``most``; a longer text is a range of its own."""
    start = 0
    while start < len(offsets) - 1:
        end = max(int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1, start + 1)
        yield start, end
        start = end


def cut_texts(
    texts: pa.Array, h1: np.ndarray, h2: np.ndarray, forms: list[str], group_bytes: int = GROUP_BYTES
) -> pa.StructArray:
    """n, prefix_chars, middle_chars and the told text of each text without nulls."""
    count = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + count + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    n, head, mid = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    told: list[bytes] = []
    for start, end in _groups(offsets, group_bytes):
        low = int(offsets[start])
        block = raw[low : int(offsets[end])]
        at = boundaries(block)
        index = fit(at)
        edges = offsets[start : end + 1] - low
        ranks = np.searchsorted(at, edges)
        size = np.diff(ranks)
        a, b = h1[start:end] % (size + 1), h2[start:end] % (size + 1)
        first, last = np.minimum(a, b), np.maximum(a, b)
        n[start:end], head[start:end], mid[start:end] = size, first, last - first
        p, m = index.offsets(ranks[:-1] + first), index.offsets(ranks[:-1] + last)
        whole = block.tobytes()
        for form, t0, t1, t2, t3 in zip(forms[start:end], edges[:-1], p, m, edges[1:]):
            if form == "plain":
                told.append(whole[t0:t3])
                continue
            prefix, middle, suffix = whole[t0:t1], whole[t1:t2], whole[t2:t3]
            if form == "psm":
                told.append(b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle)))
            else:
                told.append(b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle)))
    plain = np.array([f == "plain" for f in forms], bool)
    arrays = [
        pa.array(n), pa.array(head, mask=plain), pa.array(mid, mask=plain), pa.array(told, pa.binary()).view(pa.string()),
    ]
    return pa.StructArray.from_arrays(arrays, names=["n", "prefix_chars", "middle_chars", "told"])


def draws(id_column: str) -> list[Column]:
    """h1 to h4 of the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def form_of(text: Column, h3: Column, h4: Column) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (h3 % 100 >= 100 - PLAIN_PERCENT)
    return F.when(plain, F.lit("plain")).otherwise(F.when(h4 % 100 < SPM_PERCENT, F.lit("spm")).otherwise(F.lit("psm")))


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``_row`` (all given columns), n, form, prefix_chars, middle_chars and told: the text to train on."""
    bounded_batches(docs.sparkSession)
    kind = "struct<n:bigint,prefix_chars:bigint,middle_chars:bigint,told:string>"

    @F.arrow_udf(kind)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, h1, h2, forms in batches:
            yield cut_texts(texts, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False), forms.to_pylist())

    h1, h2, h3, h4 = draws(id_column)
    text = F.coalesce(F.col(text_column), F.lit(""))
    drawn = docs.select(whole_row(docs), text.alias("_t"), h1.alias("_h1"), h2.alias("_h2"), form_of(text, h3, h4).alias("form"))
    made = drawn.select("_row", "form", cut.asNondeterministic()("_t", "_h1", "_h2", "form").alias("_c"))
    return made.select("_row", "_c.n", "form", "_c.prefix_chars", "_c.middle_chars", "_c.told")


def restore(told: Column, form: Column) -> Column:
    """The exact text, from what ``transform`` made of it. The first marker of each kind is the one that was put in."""
    body = F.substr(told, F.lit(len(PREFIX) + 1))

    def split(value: Column, marker: str) -> tuple[Column, Column]:
        head = F.substring_index(value, marker, 1)
        return head, F.substr(value, F.char_length(head) + len(marker) + 1)

    prefix, rest = split(body, SUFFIX)
    suffix, middle = split(rest, MIDDLE)
    late_suffix, late_rest = split(body, PREFIX)
    late_prefix, late_middle = split(late_rest, MIDDLE)
    return (
        F.when(form == "plain", told)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .otherwise(F.concat(late_prefix, late_middle, late_suffix))
    )
