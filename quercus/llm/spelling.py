"""Spelling variants: words of a corpus that differ by one edit, grouped under their most frequent form.

Words are runs of letters, ASCII lower-cased, counted task by task in bounded tables and then by a shuffle. Words of
at least LEAST_LENGTH code points and LEAST_COUNT occurrences are kept, as a written table.

Near words (one inserted, deleted or replaced code point) are found by dense prefix-suffix tiling. Two words of m and
m or m + 1 code points that differ by one edit agree outside one of REGIONS regions of the shorter word, so each word
is listed under what lies around each region, once as the shorter and once as the longer word. Words listed alike are
laid out as matrices of code points, padded to one width, and blocks of them are compared: the common prefix plus the
common suffix of a pair reach the longer length minus one exactly if one edit is enough. A pair is taken at the first
region around which it agrees, hence once.

A list of more than BLOCK words is dealt in blocks by a hash of the word, and each pair of blocks is a tile of its
own, so tiles are bounded by BLOCK words and by CELLS code points, and no list has to fit in one task. Only near pairs
leave a tile, and a word has no more of those than its length times the alphabet, twice.

A word's form is its most frequent near word, if at least RATIO times as frequent. Forms are followed to their last by
pointer doubling: each round joins the chains to themselves, so a chain of d forms takes log2(d) rounds.

Defined cases: a null text has no words; an empty table, or one without words that are kept, gives no rows; a null id
counts as no digits; equal rows count as often as they come; ties between forms go to the smaller word by code point;
very long texts are read whole, and very long words are compared whole; columns besides id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quercus.llm.common import bounded_batches, settle

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a code point.
DAMAGE = 97
#: Parts of a word of which one may differ.
REGIONS = 3
#: Words per block of a long list, and code points per block of long words.
BLOCK, CELLS = 2048, 1 << 20
#: Pairs that are compared at once; with words of w code points this takes about 4 w bytes for each.
PAIRS = 1 << 17
#: Listed words that one task compares.
SHARD_WORDS = 25_000
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 200_000
#: Letters of a run, in UTF-8: a to z, and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def runs_of(doc_id: int | None, text: str, damage: int = DAMAGE) -> Counter:
    """Occurrences of each run of a text, after the damage that the id and the run decide on."""
    seed = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    found: Counter = Counter()
    for run, n in Counter(RUN.findall(text.encode("utf-8", "replace").lower())).items():
        h = zlib.crc32(run, seed)
        if h % damage == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        found[run] += n
    return found


def counted_words(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """word, n: every word of the corpus that is long and frequent enough."""
    bounded_batches(docs.sparkSession)

    def table(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in runs_of(doc_id, text.as_py()).items():
                    # no word has more code points than bytes
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield table(held)
                    held = Counter()
        yield table(held)

    texts = docs.filter(F.col(text_column).isNotNull()).select(F.col(id_column).cast("bigint"), text_column)
    words = texts.mapInArrow(count, "word string, n bigint")
    total = words.groupBy("word").agg(F.sum("n").alias("n"))
    return total.filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def region_starts(m: int, regions: int = REGIONS) -> list[int]:
    """Where the regions of a word of m code points start, and its end."""
    return [i * m // regions for i in range(regions + 1)]


def listed(words: DataFrame, regions: int = REGIONS) -> DataFrame:
    """word, m (code points of the shorter of a pair), region, key: where a word is listed.

    The key is what stands before the region and, from the end, what stands after it; m and region are part of it.
    """
    size = F.length("word")
    roles = F.explode(F.array(size, size - 1)).alias("m")
    rows = words.select("word", roles).withColumn("region", F.explode(F.sequence(F.lit(0), F.lit(regions - 1))))
    m, r = F.col("m"), F.col("region")
    start, end = F.floor(r * m / F.lit(regions)).cast("int"), F.floor((r + 1) * m / F.lit(regions)).cast("int")
    head = F.substring("word", F.lit(1), start)
    tail = F.substring("word", F.length("word") - (m - end) + 1, m - end)
    return rows.withColumn("key", F.xxhash64(m, r, head, tail))


def tiles(lists: DataFrame, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """word, m, region, key, tile: one row per tile that a listed word takes part in; side tells the block.

    Short lists are tile (0, 0). The words of a longer one are hashed to blocks; block i takes part in tiles (i, j) and
    (j, i) for all j.
    """
    most = F.least(F.lit(block), F.greatest(F.lit(1), (F.lit(cells) / F.col("m")).cast("int")))
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("_size"), F.max("m").alias("m"))
    long_lists = settle(
        sizes.filter(F.col("_size") > most).select(F.col("key").alias("_k"), F.ceil(F.col("_size") / most).cast("int").alias("_blocks")),
        "spelling-long",
    )
    own = lists.join(long_lists, F.col("key") == F.col("_k"), "left").drop("_k").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    placed = own.withColumn("side", F.pmod(F.xxhash64(F.lit(5), "word"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    spread = placed.select("word", "m", "region", "key", "side", other)
    return spread.select(
        "word", "m", "region", "key", "side",
        F.least("side", "_other").alias("tile_a"), F.greatest("side", "_other").alias("tile_b"),
    )


def code_points(words: list[str], width: int) -> np.ndarray:
    """One row per word, padded with zeros on the right."""
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


def one_edit(words: list[str], first: np.ndarray, second: np.ndarray, region: np.ndarray, m: int, regions: int = REGIONS) -> np.ndarray:
    """Which pairs, of m and of m or m + 1 code points, are one edit apart and agree around no earlier region.

    Both words are laid out from the left and from the right; the number of leading columns that agree is the common
    prefix, or suffix.
    """
    sizes = np.array([len(w) for w in words])
    width = m + 1
    from_left = code_points(words, width)
    from_right = code_points([w[::-1] for w in words], width)
    starts = np.array(region_starts(m, regions))
    keep = np.zeros(len(first), bool)
    step = max(1, PAIRS * 8 // width)
    for low in range(0, len(first), step):
        a, b, r = first[low : low + step], second[low : low + step], region[low : low + step]
        prefix = _agreeing(from_left[a], from_left[b])
        suffix = _agreeing(from_right[a], from_right[b])
        longer, shorter = np.maximum(sizes[a], sizes[b]), np.minimum(sizes[a], sizes[b])
        # beyond the shorter word nothing agrees
        prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
        near = (shorter == m) & (prefix + suffix >= longer - 1)
        around = (prefix[:, None] >= starts[None, :-1]) & (suffix[:, None] >= m - starts[None, 1:])
        keep[low : low + step] = near & (around.argmax(axis=1) == r)
    return keep


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading columns in which two matrices agree, row by row."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _pairs_of(sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j inside consecutive groups of the given sizes, about ``most`` at a time.

    Row i of a group of which k rows follow makes k pairs; rows are taken together until there are enough.
    """
    ends = np.cumsum(sizes)
    end_of = np.repeat(ends, sizes)
    rows = np.arange(len(end_of))
    follow = end_of - rows - 1
    made = np.cumsum(follow)
    start = 0
    while start < len(rows):
        before = made[start - 1] if start else 0
        stop = max(int(np.searchsorted(made, before + most, "right")), start + 1)
        k = follow[start:stop]
        first = np.repeat(rows[start:stop], k)
        within = np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k)
        yield first, first + 1 + within
        start = stop


def near_pairs(words: DataFrame, regions: int = REGIONS, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """a, b: pairs of words that are one edit apart, each once."""
    lists = listed(words, regions)
    spread = tiles(lists, block, cells)
    shards = max(1, -(-words.count() * 2 * regions // SHARD_WORDS))
    dealt = spread.withColumn("_shard", F.pmod(F.xxhash64("key", "tile_a", "tile_b"), F.lit(shards)).cast("int"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for m, part in rows.groupby("m", sort=False):
            part = part.sort_values(["key", "tile_a", "tile_b"])
            marks = part[["key", "tile_a", "tile_b"]].to_numpy()
            starts = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1)))
            sizes = np.diff(np.append(starts, len(part)))
            texts = part["word"].to_numpy()
            region, side = part["region"].to_numpy(), part["side"].to_numpy()
            # two blocks of one list meet in one tile; pairs inside a block belong to the tile of that block alone
            crossing = (part["tile_a"] != part["tile_b"]).to_numpy()
            most = max(1, PAIRS * 8 // (int(m) + 1))
            for first, second in _pairs_of(sizes, most):
                meets = ~crossing[first] | (side[first] != side[second])
                first, second = first[meets], second[meets]
                if not len(first):
                    continue
                low, high = int(first[0]), int(second.max()) + 1
                near = one_edit(list(texts[low:high]), first - low, second - low, region[first], int(m), regions)
                out_a.append(texts[first[near]])
                out_b.append(texts[second[near]])
        none = np.array([], object)
        return pd.DataFrame({"a": np.concatenate(out_a or [none]), "b": np.concatenate(out_b or [none])})

    return dealt.groupBy("_shard").applyInPandas(compare, "a string, b string")


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: every word with its most frequent near word, if frequent enough."""
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_p"))
    known = words.select(F.col("word").alias("_near"), F.col("n").alias("_n"))
    links = both.select("_p.a", "_p.b").join(known, F.col("b") == F.col("_near"))
    best = links.groupBy(F.col("a").alias("_word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("b"))).alias("_best")
    )
    joined = words.join(best, F.col("word") == F.col("_word"), "left")
    enough = -F.col("_best.n") >= ratio * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("_best.b")).alias("form"), F.when(enough, -F.col("_best.n")).alias("form_n"),
    )


def roots(chosen: DataFrame) -> DataFrame:
    """word, root of the words that have a form: the last of the chain. Each round doubles the reach of every link."""
    reach = settle(chosen.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = reach.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        moved = reach.join(ahead, F.col("root") == F.col("_w"), "left")
        further = settle(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        reach = further.select("word", "root")
        if further.filter("_moved").isEmpty():
            return reach


def group_variants(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", regions: int = REGIONS, block: int = BLOCK
) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per kept word."""
    words = settle(counted_words(docs, id_column, text_column), "spelling-words")
    chosen = settle(forms(words, near_pairs(words, regions, block)), "spelling-forms")
    last = roots(chosen).withColumnRenamed("word", "_of")
    joined = chosen.join(last, F.col("word") == F.col("_of"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
