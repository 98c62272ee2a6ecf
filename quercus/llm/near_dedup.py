"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, bands, and a check of the multiset overlap.

1. Signature. The weight of a shingle is its count. The line of weights is cut into dyadic intervals [0, 1),
   [1, 2), [2, 4), ..., and each (shingle, interval) has a Poisson process of points in time, as dense as the
   interval is long, the same in every document. Each point has a component and, by halving the interval
   again and again, a weight; it counts if that weight is below the shingle's. A component's value is its
   first point, and two documents agree in a component with the probability of their weighted Jaccard
   similarity. Points are made in order of time and only up to a bound after which no component is empty.
2. Equal texts are one text from here on. Documents that agree in a whole band of components share a bucket;
   buckets of one text are dropped.
3. Each text is scored by the sizes of its buckets, and the best of a bucket is its hub. Near copies of one
   text mostly have that text as their hub, so the number of pairs (text, hub) is about that of the texts.
   All of them are checked exactly.
4. Two texts of one bucket belong to one hub. A pair that both are linked to the hub are in one class
   already; any other has an outsider, a text that isn't linked to the hub. Outsiders are compared with all
   texts of the hub, in blocks of bounded size, so no link is lost to the choice of hubs.
5. Classes are the connected components of the links, found by joins alone; a class is named by its least id.

Defined cases: a null text counts as empty; equal texts are always one class, empty ones too; a text of
fewer than five words, but not none, is one shingle; rows with equal ids and unlike texts are told apart by
the text and may be in different classes; of a class the least id stays; very long texts are compared whole; an
empty table gives no rows; columns besides id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quercus.llm.common import bounded_batches, settle, whole_row
from quercus.llm.shingles import groups, mix, shingles, tokens

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 30, 6  # a pair at 0.8 is missed once in ten thousand
BLOCK = 256  # outsiders in a block
MEMBERS = 2048  # texts of a hub that are compared at once
UNIT = 1024  # texts that a task gets in one group, of one hub or many

_COMPONENT = np.uint64(0xA0761D6478BD642F)
_WEIGHT = np.uint64(0xE7037ED1A0B428DB)


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """n_rows x size first points in time; infinite for texts without shingles."""
    out = np.full(n_rows * size, np.inf)
    # one process per shingle and dyadic interval that its weight reaches into
    elements = [(row, shingle, np.zeros(len(row)), np.ones(len(row)), weight)]
    low = 1
    while (more := weight > low).any():
        k = int(more.sum())
        elements.append((row[more], shingle[more], np.full(k, float(low)), np.full(k, float(low)), weight[more]))
        low *= 2
    row, shingle, low_, length, weight = (np.concatenate(c) for c in zip(*elements))
    seed = mix(shingle ^ mix(low_.astype(np.uint64)))
    covered = np.minimum(weight, low_ + length) - low_
    total = np.bincount(row, covered, n_rows)
    bound = size / np.maximum(total, 1) * (np.log(size) + 7)
    time, nth = np.zeros(len(row)), 0
    open_ = np.arange(len(row))
    while True:
        while len(open_):
            random = mix(seed[open_] + np.uint64(nth * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            nth += 1
            gap = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length[open_]
            now = time[open_] + gap
            time[open_] = now
            component = ((mix(random ^ _COMPONENT) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            # the highest bits of a random number say into which half the point falls, at each halving
            at = low_[open_] + np.floor((mix(random ^ _WEIGHT) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * length[open_])
            below = at < weight[open_]
            r = row[open_]
            np.minimum.at(out, r[below] * size + component[below], now[below])
            open_ = open_[now < bound[r]]
        grid = out.reshape(n_rows, size)
        short = np.isinf(grid).any(axis=1) & (total > 0)
        # points up to the bound are all made; a text with an empty component, which is rare, starts anew with twice the bound
        if not short.any():
            return grid
        bound = np.where(short, bound * 2, 0)
        open_ = np.flatnonzero(short[row])
        time[open_], nth = 0.0, 0


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), bits.shape[:2]).copy()
    for k in range(rows):
        key = mix(key ^ bits[:, :, k])
    return key.view(np.int64)


def keyed(docs: DataFrame, id_column: str, text_column: str) -> list:
    """number (the id; for ids of another type a hash; null as -1) and h1, h2 (128 bits that stand for the text)."""
    text = F.coalesce(docs[text_column], F.lit(""))
    plain = docs.schema[id_column].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    number = docs[id_column].cast("bigint") if plain else F.xxhash64(docs[id_column].cast("string"))
    return [
        F.when(docs[id_column].isNull(), F.lit(-1)).otherwise(number).alias("number"), F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(7), F.octet_length(text), text).alias("h2"),
    ]


def banded(docs: DataFrame, id_column: str, text_column: str, bands: int, rows: int, words: int) -> DataFrame:
    """id, number, h1, h2, bands (empty for a text without words)."""

    @F.pandas_udf("array<bigint>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = []
            for _, group in groups(texts):
                row, shingle, weight = shingles(group, words)
                made = band_keys(signatures(row, shingle, weight, len(group), bands * rows), bands, rows)
                some = np.bincount(row, minlength=len(group)) > 0
                out += [k if s else [] for k, s in zip(made, some)]
            yield pd.Series(out)

    made = keys.asNondeterministic()(docs[text_column]).alias("bands")
    return docs.select(docs[id_column].alias("id"), *keyed(docs, id_column, text_column), made)


def hubs(unique: DataFrame) -> DataFrame:
    """(node, hub): for every bucket of two texts or more, each text and the bucket's hub."""
    placed = unique.select("node", F.posexplode("bands").alias("band", "key"))
    placed = placed.select("node", F.xxhash64("band", "key").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = settle(placed.join(sizes, "bucket"), "buckets")
    score = shared.groupBy("node").agg(F.sum("n").alias("score"))
    scored = shared.join(score, "node")
    best = scored.groupBy("bucket").agg(F.max(F.struct("score", (-F.col("node")).alias("node"))).alias("best"))
    pairs = shared.join(best.select("bucket", (-F.col("best.node")).alias("hub")), "bucket")
    return pairs.filter(F.col("node") != F.col("hub")).select("node", "hub").distinct()


def _overlaps(queries: list[np.ndarray], members: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """For each member its Jaccard similarity with every query, all sorted token sets."""
    token = np.concatenate(queries) if queries else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
    by = np.argsort(token, kind="stable")
    token, owner = token[by], owner[by]
    sizes = np.array([len(q) for q in queries])
    for member in members:
        first = np.searchsorted(token, member, "left")
        n = np.searchsorted(token, member, "right") - first
        spread = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        common = np.bincount(owner[spread], minlength=len(queries))
        union = sizes + len(member) - common
        yield np.where(union > 0, common / np.maximum(union, 1), 0.0)


def _token_sets(texts, words: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, group in groups(texts):
        row, token = tokens(group, words)
        out += np.split(token, np.cumsum(np.bincount(row, minlength=len(group)))[:-1])
    return out


def compared(
    left: DataFrame, right: DataFrame, keys: list[str], words: int, least: float, rows: int
) -> DataFrame:
    """(a, b) for the texts a of ``left`` and b of ``right`` of equal keys that are similar by ``least`` or more.

    Both have node and text. A task takes many small keys at once; ``rows`` is about the rows of ``right``.
    """

    def compare(few: pd.DataFrame, many: pd.DataFrame) -> pd.DataFrame:
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        asked = few.groupby(keys).indices
        for key, at in many.groupby(keys).indices.items():
            if key not in asked:
                continue
            own = few.iloc[asked[key]]
            names = own["node"].to_numpy()
            others = many.iloc[at]
            shares = _overlaps(_token_sets(own["text"], words), iter(_token_sets(others["text"], words)))
            for node, share in zip(others["node"], shares):
                good = names[(share >= least) & (names != node)]
                found_a.append(good)
                found_b.append(np.full(len(good), node))
        return pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    units = max(1, -(-rows // UNIT))
    unit = F.pmod(F.xxhash64(F.lit(9), *keys), F.lit(units)).alias("_unit")
    # both sides come from the same tables: new names make their columns distinct
    names = [*keys, "node", "text"]
    left, right = (side.select(unit, *[F.col(c).alias(c) for c in names]) for side in (left, right))
    return left.groupBy("_unit").cogroup(right.groupBy("_unit")).applyInPandas(compare, "a bigint, b bigint")


def links(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b) of texts with a similarity of ``threshold`` or more: with their hubs, then outsiders with all of the hub."""
    parts = F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts")
    sizes = settle(pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).select("hub", "n", parts), "hub-sizes")
    placed = pairs.join(sizes, "hub").select(
        "hub", "node", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    )
    everywhere = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    centres = sizes.select("hub", everywhere).join(texts.withColumnRenamed("node", "hub"), "hub")
    centres = centres.select("hub", "part", F.col("hub").alias("node"), "text")
    near = compared(centres, placed.join(texts, "node"), ["hub", "part"], words, threshold, pairs.count())
    near = settle(near.select(F.col("a").alias("hub"), F.col("b").alias("node")), "hub-links")

    out = settle(pairs.join(near, ["hub", "node"], "left_anti"), "outsiders")
    blocks = F.ceil(F.col("n_out") / BLOCK).cast("int").alias("blocks")
    # a hub with one text has no further pair
    per = out.groupBy("hub").agg(F.count(F.lit(1)).alias("n_out")).join(sizes.filter(F.col("n") > 1), "hub")
    per = settle(per.select("hub", blocks, "parts", "n"), "outsider-sizes")
    rows = per.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    queries = out.join(per, "hub").select(
        "hub", "node", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int").alias("block"), everywhere
    )
    against = placed.drop("parts").join(per, "hub").select(
        "hub", "node", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    rest = compared(
        queries.join(texts, "node"), against.join(texts, "node"), ["hub", "block", "part"], words, threshold, rows
    )
    return settle(near.select(F.col("hub").alias("a"), F.col("node").alias("b")).unionByName(rest), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, by turns of large and small stars."""
    edges = edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges = settle(edges, "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has a shuffle of its own on either side, and a hot node can be split there
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least-neighbour")
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.filter(F.col("u") != F.col("v")).distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter(F.col("u") != F.col("v")).distinct()
        edges = settle(small, "small-star")
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state


def classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD,
    bands: int = BANDS, rows: int = ROWS, words: int = WORDS,
) -> DataFrame:
    """id, number, h1, h2, class_id, is_first of every row.

    ``class_id`` is the least id of the class; ``is_first`` marks the row of that id, and no other unless rows
    with equal id and text repeat. An id that comes with several texts is replaced by a hash in class names.
    """
    bounded_batches(docs.sparkSession)
    made = banded(docs, id_column, text_column, bands, rows, words)
    marked = settle(made.withColumn("row", F.monotonically_increasing_id()), "band-keys")
    # a node is one row of its text, also where id and text repeat
    each = marked.groupBy("h1", "h2").agg(F.min("number").alias("number"), F.min_by("row", "number").alias("row"))
    shared = each.groupBy("number").agg(F.count(F.lit(1)).alias("_n"))
    own_name = F.when(F.col("_n") == 1, F.col("number")).otherwise(-F.abs(F.xxhash64("h1", "h2") / 2).cast("bigint") - 2)
    nodes = settle(each.join(shared, "number").select("h1", "h2", "number", "row", own_name.alias("node")), "nodes")
    unique = marked.select("row", "bands").join(nodes.select("row", "node"), "row").select("node", "bands")
    pairs = settle(hubs(unique), "pairs")
    wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct().join(nodes, "node")
    given = docs.select(*keyed(docs, id_column, text_column), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    # rows that repeat id and text come back together: each task leaves one of them before the shuffle
    texts = given.join(wanted, ["h1", "h2", "number"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = settle(texts, "near-texts")
    labels = components(links(pairs, texts, words, threshold))
    named = nodes.drop("row").join(labels, "node", "left").select(
        "h1", "h2", F.col("number").alias("first"), F.coalesce("label", "node").alias("class_id"),
        F.coalesce("label", "node").eqNullSafe(F.col("node")).alias("leads"),
    )
    return marked.select("id", "number", "h1", "h2").join(named, ["h1", "h2"]).select(
        "id", "number", "h1", "h2", "class_id", (F.col("leads") & (F.col("number") == F.col("first"))).alias("is_first")
    )


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row, all columns, of each class: the one with the least id."""
    found = classes(docs, id_column, text_column, **options)
    kept = found.filter("is_first").select("number", "h1", "h2").distinct()
    rows = docs.select(whole_row(docs), *keyed(docs, id_column, text_column)).join(kept, ["number", "h1", "h2"])
    # rows that repeat id and text lie side by side after the join
    nth = F.row_number().over(Window.partitionBy("number", "h1", "h2").orderBy(F.lit(0)))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") == 1).select("_row.*")
