"""A corpus scored by the backoff automaton of its own training texts, with each text read and cut once.

The model is that of ``language_model`` at order 2: all words, all pairs that occur LEAST_COUNT times in training
texts, discounted, with backoff weights as failure arcs. What differs is how counts meet texts:

1. Texts are cut into chunks of about CHUNK tokens, whose words are numbered inside the chunk; a written table.
2. A chunk sends its distinct words, with their counts among training texts, as one packed list per part of the
   vocabulary. A part adds up the counts of its words, numbers them, and answers each list with numbers and totals.
3. A chunk sends its distinct pairs, now two numbers each, as one packed list per part of all pairs. A part adds up,
   drops totals below the least count, answers each list with the totals, and adds up what each first word gives to
   its continuations. Pairs are dealt by both words, so a frequent first word is spread over all parts.
4. These sums are added up per word and answered to the lists of step 2 as backoff weights.
5. Each chunk walks its part of the automaton, as in ``language_model``.

Lists are packed columns (byte planes, zstd), a few bytes per pair instead of a row each: pairs are ordered by the
numbers of their words, so the second is a step from the one before, and its total is sent once per list. An answer has
the order of its list, so it carries no keys. Parts hold about PART_ENTRIES entries: their number follows the counted words and tokens, and a
pair that every chunk has is one entry per chunk. No machine holds the model, and nothing of it reaches the driver but
the number of words, of training tokens and of entries.

Defined cases: a null text is empty; an empty text is its end token alone; a null id is an id like any other; without
training texts every token is unknown; rows with equal id and text are scored alike and returned as often as they
came, so there are no ties to break; a very long text is a chunk by itself; an empty table gives no rows; columns
besides id, text and what ``training`` reads are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quercus.llm.common import bounded_batches, settle
from quercus.llm.language_model import CHUNK, DISCOUNT, LEAST_COUNT, assemble, chunks, walk_texts

#: Entries (words or pairs of a chunk) that one part adds up.
PART_ENTRIES = 2_000_000


def packed(data: np.ndarray | bytes) -> bytes:
    """The bytes compressed, after their number; of an array all lowest bytes come first, then all next ones."""
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).view(np.uint8).reshape(-1, data.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(blob[8:], size, asbytes=True) if size else b""


def numbers(blob: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(unpacked(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def part_of_words(words: list[bytes], parts: int) -> np.ndarray:
    """Part of each word, by a hash that is the same on every machine."""
    return np.fromiter((crc32(w) for w in words), np.int64, len(words)) % parts


def part_of_pairs(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % parts


def cut_texts(given: DataFrame, kind: str, most: int = CHUNK) -> DataFrame:
    """(chunk, rows, tokens, words, n_words, n_tokens): the written chunks; rows hold id and whether a text trains."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for nth, chunk in enumerate(chunks(batches, most)):
            rows = pa.chunked_array(chunk.rows).combine_chunks()
            rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
            tokens = np.concatenate(chunk.texts)
            yield pa.RecordBatch.from_arrays([
                pa.array([task + nth]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                pa.array([packed(tokens)], pa.binary()), pa.array([packed(b" ".join(chunk.words))], pa.binary()),
                pa.array([len(chunk.words)]), pa.array([len(tokens)]),
            ], ["chunk", "rows", "tokens", "words", "n_words", "n_tokens"])

    out = f"chunk bigint, rows array<struct<id:{kind},trains:boolean>>, tokens binary, words binary, n_words bigint, n_tokens bigint"
    return settle(given.mapInArrow(cut, out), "lm-chunks")


def training_tokens(ids: np.ndarray, trains: list[bool]) -> np.ndarray:
    """Which tokens stand in texts that train; -1 ends a text."""
    return np.asarray(trains, bool)[np.cumsum(np.append(0, ids[:-1] < 0))]


def word_counts(ids: np.ndarray, trains: list[bool], n_words: int) -> np.ndarray:
    """How often each word of a chunk occurs in texts that train."""
    counts = np.bincount(ids[training_tokens(ids, trains) & (ids >= 0)], minlength=n_words)
    counts[0] = int(np.sum(trains))  # one end token per text
    return counts


def distinct_pairs(ids: np.ndarray) -> np.ndarray:
    """The sorted pairs of a chunk, first << 32 | second by local number."""
    keys = np.sort((ids[:-1] << 32 | ids[1:])[(ids[:-1] >= 0) & (ids[1:] >= 0)])
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def pair_counts(ids: np.ndarray, trains: list[bool], pairs: np.ndarray) -> np.ndarray:
    """How often each pair occurs in texts that train."""
    whole = (ids[:-1] >= 0) & (ids[1:] >= 0) & training_tokens(ids, trains)[:-1]
    own = np.sort((ids[:-1] << 32 | ids[1:])[whole])
    return np.searchsorted(own, pairs, "right") - np.searchsorted(own, pairs, "left")


def read_tokens(blob: bytes) -> np.ndarray:
    return numbers(blob, np.int32).astype(np.int64)


def by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, with the places of its entries in their given order."""
    # few parts make a short sort key
    order = np.argsort(parts.astype(np.uint16) if len(parts) and parts.max() < 1 << 16 else parts, kind="stable")
    edges = np.flatnonzero(np.diff(parts[order])) + 1
    for places in np.split(order, edges):
        if len(places):
            yield int(parts[places[0]]), places


def number_words(cuts: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, ids, totals): for each list of words their numbers, -1 where no training text has the word."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = unpacked(row["words"]).split(b" ")
                n = word_counts(read_tokens(row["tokens"]), row["trains"], len(words))
                for part, at in by_part(part_of_words(words, parts)):
                    own = packed(b" ".join(words[i] for i in at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part]), pa.array([row["chunk"]]), pa.array([own], pa.binary()), pa.array([packed(n[at])], pa.binary())],
                        ["part", "chunk", "words", "n"],
                    )

    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by("chunk").to_pylist()
        known: dict[bytes, int] = {}
        places = [
            np.fromiter((known.setdefault(w, len(known)) for w in unpacked(r["words"]).split(b" ")), np.int64) for r in rows
        ]
        totals = np.zeros(len(known), np.int64)
        for at, r in zip(places, rows):
            totals[at] += numbers(r["n"])  # a chunk has each word once
        part = rows[0]["part"]
        ids = np.where(totals > 0, np.arange(len(known)) * parts + part, -1)
        return pa.Table.from_arrays([
            pa.array([part] * len(rows)), pa.array([r["chunk"] for r in rows]),
            pa.array([packed(ids[at]) for at in places], pa.binary()), pa.array([packed(totals[at]) for at in places], pa.binary()),
            pa.array([int((totals > 0).sum())] + [0] * (len(rows) - 1)), pa.array([int(totals.sum())] + [0] * (len(rows) - 1)),
        ], ["part", "chunk", "ids", "totals", "distinct", "tokens"])

    lists = cuts.select("chunk", "tokens", "words", F.transform("rows", lambda r: r["trains"]).alias("trains"))
    sent = lists.mapInArrow(send, "part bigint, chunk bigint, words binary, n binary")
    out = "part bigint, chunk bigint, ids binary, totals binary, distinct bigint, tokens bigint"
    return settle(sent.groupBy("part").applyInArrow(add, out), "lm-words")


def gathered(words: list[bytes], answers: list[dict], parts: int, *fields: tuple[str, type]) -> list[np.ndarray]:
    """Answers of all parts to one chunk, put back at the places of its words."""
    by = {a["part"]: a for a in answers}
    out = [np.zeros(len(words), kind) for _, kind in fields]
    for part, at in by_part(part_of_words(words, parts)):
        for whole, (name, kind) in zip(out, fields):
            whole[at] = numbers(by[part][name], kind)
    return out


def in_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of pairs of numbers, ascending; numbers of 32 bits are sorted as one key."""
    if len(first) and max(first.max(), second.max()) < 1 << 31:
        return np.argsort(first << 32 | second)
    return np.lexsort((second, first))


def sent_pairs(pairs: np.ndarray, ids: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Places of the pairs of known words by part, each list by the number of the second word, then of the first."""
    first, second = ids[pairs >> 32], ids[pairs & 0xFFFFFFFF]
    known = np.flatnonzero((first >= 0) & (second >= 0))
    known = known[in_order(second[known], first[known])]
    return [(p, known[at]) for p, at in by_part(part_of_pairs(first[known], second[known], parts))]


def count_pairs(cuts: DataFrame, words: DataFrame, word_parts: int, parts: int, least_count: int) -> DataFrame:
    """What the parts of pairs answer: (chunk, part, totals) for lists and (word, explicit, covered) for first words."""

    def send(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        tokens, spelled = read_tokens(row["tokens"]), unpacked(row["words"]).split(b" ")
        ids, totals = gathered(spelled, answers.to_pylist(), word_parts, ("ids", np.int64), ("totals", np.int64))
        pairs = distinct_pairs(tokens)
        n = pair_counts(tokens, row["trains"], pairs)
        lists = sent_pairs(pairs, ids, parts)
        columns = [[], [], [], []]
        for _, at in lists:
            first, second = pairs[at] >> 32, pairs[at] & 0xFFFFFFFF
            steps = np.diff(ids[second], prepend=-1)
            for column, values in zip(columns, (ids[first], steps, n[at], totals[second[steps > 0]])):
                column.append(packed(values))
        return pa.Table.from_arrays(
            [pa.array([p for p, _ in lists], pa.int64()), pa.array([row["chunk"]] * len(lists), pa.int64()), *[pa.array(c, pa.binary()) for c in columns]],
            ["part", "chunk", "first", "second", "n", "below"],
        )

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = []
        for r in rows:
            steps = numbers(r["second"])
            below = numbers(r["below"])[np.cumsum(steps > 0) - 1]
            lists.append((numbers(r["first"]), np.cumsum(steps) - 1, numbers(r["n"]), below))
        first, second, n, below = (np.concatenate(c) for c in zip(*lists))
        order = in_order(first, second)
        fresh = np.append(True, (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0))
        sums = np.add.reduceat(n[order], np.flatnonzero(fresh))
        totals = np.empty(len(n), np.int64)
        totals[order] = sums[np.cumsum(fresh) - 1]
        totals[totals < least_count] = 0
        lengths = [len(x[0]) for x in lists]
        answers = [packed(t) for t in np.split(totals, np.cumsum(lengths)[:-1])]
        kept = order[fresh][sums >= least_count]
        contexts, of = np.unique(first[kept], return_inverse=True)
        explicit = np.bincount(of, totals[kept] - DISCOUNT, len(contexts))
        covered = np.bincount(of, below[kept] + 0.5, len(contexts))
        m, c = len(rows), len(contexts)
        return pa.Table.from_arrays([
            pa.array([r["chunk"] for r in rows] + [None] * c, pa.int64()), pa.array([r["part"] for r in rows] + [None] * c, pa.int64()),
            pa.array(answers + [None] * c, pa.binary()), pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(contexts, pa.int64())]),
            pa.concat_arrays([pa.nulls(m, pa.float64()), pa.array(explicit, pa.float64())]),
            pa.concat_arrays([pa.nulls(m, pa.float64()), pa.array(covered, pa.float64())]),
        ], ["chunk", "part", "totals", "word", "explicit", "covered"])

    lists = cuts.select("chunk", "tokens", "words", F.transform("rows", lambda r: r["trains"]).alias("trains"))
    known = words.select("part", "chunk", "ids", "totals")
    sent = lists.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        send, "part bigint, chunk bigint, first binary, second binary, n binary, below binary"
    )
    out = "chunk bigint, part bigint, totals binary, word bigint, explicit double, covered double"
    return settle(sent.groupBy("part").applyInArrow(add, out), "lm-pairs")


def weigh_words(words: DataFrame, pairs: DataFrame, parts: int, divisor: float) -> DataFrame:
    """(chunk, part, back): the backoff weights of each list of words, 0 where nothing goes on from a word."""
    sums = pairs.filter("word IS NOT NULL").groupBy("word").agg(F.sum("explicit").alias("explicit"), F.sum("covered").alias("covered"))

    def weigh(lists: pa.Table, sums: pa.Table) -> pa.Table:
        place, explicit, covered = (sums.column(c).to_numpy() for c in ("word", "explicit", "covered"))
        order = np.argsort(place)
        place, explicit, covered = place[order], explicit[order], covered[order]
        out = []
        for row in lists.select(["ids", "totals"]).to_pylist():
            ids, totals = numbers(row["ids"]), numbers(row["totals"])
            at = np.minimum(np.searchsorted(place, ids), max(len(place) - 1, 0))
            has = place[at] == ids if len(place) else np.zeros(len(ids), bool)
            back = np.zeros(len(ids))
            left = np.maximum(1 - explicit[at[has]] / totals[has], 1e-12)
            back[has] = np.log10(left / np.maximum(1 - covered[at[has]] / divisor, 1e-12))
            out.append(packed(back))
        return lists.select(["chunk", "part"]).append_column("back", pa.array(out, pa.binary()))

    by_word_part = sums.withColumn("part", F.pmod("word", F.lit(parts)))
    lists = words.select("part", "chunk", "ids", "totals")
    return lists.groupBy("part").cogroup(by_word_part.groupBy("part")).applyInArrow(weigh, "chunk bigint, part bigint, back binary")


def score_corpus(
    docs: DataFrame, training: Column, id_column: str = "doc_id", text_column: str = "text", least_count: int = LEAST_COUNT,
    chunk_tokens: int = CHUNK, part_entries: int = PART_ENTRIES,
) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of every row, by the model of the rows that ``training`` picks."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    trains = F.coalesce(training, F.lit(False)).alias("trains")
    given = docs.select(F.struct(F.col(id_column).alias("id"), trains).alias("row"), F.col(text_column).alias("text"))
    cuts = cut_texts(given, kind, chunk_tokens)
    size = cuts.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("pairs")).first()
    word_parts, pair_parts = (max(1, -(-n // part_entries)) for n in (size.words, size.pairs))
    words = number_words(cuts, word_parts)
    sums = words.agg(F.sum("tokens").alias("total"), F.sum("distinct").alias("distinct")).first()
    total, divisor = sums.total or 0, (sums.total or 0) + 0.5 * ((sums.distinct or 0) + 1)
    pairs = count_pairs(cuts, words, word_parts, pair_parts, least_count)
    back = weigh_words(words, pairs, word_parts, divisor)

    def answer(rows: DataFrame, column: str) -> DataFrame:
        return rows.select("chunk", "part", F.col(column).alias("answer"), F.lit(column).alias("kind"))

    # "totals" of words, "kept" totals of pairs
    kept = pairs.filter("chunk IS NOT NULL").withColumnRenamed("totals", "kept")
    answers = answer(back, "back").unionByName(answer(kept, "kept")).unionByName(answer(words, "ids")).unionByName(answer(words, "totals"))

    def walk(chunk: pa.Table, met: pa.Table) -> pa.Table:
        rows = chunk.column("rows").combine_chunks().values
        tokens = read_tokens(chunk.column("tokens")[0].as_py())
        found = distinct_pairs(tokens)
        by = {(a["kind"], a["part"]): a["answer"] for a in met.select(["kind", "part", "answer"]).to_pylist()}
        spelled = unpacked(chunk.column("words")[0].as_py()).split(b" ")
        ids, n, backs = np.zeros(len(spelled), np.int64), np.zeros(len(spelled), np.int64), np.zeros(len(spelled))
        for part, at in by_part(part_of_words(spelled, word_parts)):
            for whole, kind in ((ids, "ids"), (n, "totals"), (backs, "back")):
                whole[at] = numbers(by[kind, part], whole.dtype)
        kept = np.zeros(len(found), np.int64)
        for part, at in sent_pairs(found, ids, pair_parts):
            kept[at] = numbers(by["kept", part])
        automaton = assemble([len(ids), len(found)], [found], [n, kept], [backs], divisor)
        lengths = np.diff(np.flatnonzero(tokens < 0), prepend=-1) - 3  # words of each text
        owner = np.repeat(np.arange(len(lengths)), lengths + 1)
        inside = tokens >= 0
        inside[np.cumsum(lengths + 3) - (lengths + 3)] = False
        told = tokens[inside]  # words and the closing end token
        base = np.bincount(owner, automaton.root_log[told], len(lengths))
        known = np.bincount(owner, n[told] > 0, len(lengths)).astype(np.int64)
        scores = walk_texts(tokens, lengths, automaton)
        columns = [rows.field("id"), *map(pa.array, (lengths + 1, known, np.full(len(lengths), total), base, scores))]
        return pa.Table.from_arrays(columns, ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = cuts.select("chunk", "rows", "tokens", "words").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        walk, f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
    return scored.withColumnRenamed("id", id_column)
