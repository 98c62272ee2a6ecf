"""The stages one by one against brute force on their own input, and all of them together."""

import pytest
from test_llm_decontamination import brute as brute_hits
from test_llm_near_dedup import brute_classes

import corpus_pipeline
from llm_cases import no_documents, odd_documents
from pyspark.sql import functions as F
from quercus.llm import language_id, packing, toxicity
from quercus.llm.common import crc_mod, settle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The input of each stage, and the result."""
    rows, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(rows)
    for name, stage in corpus_pipeline.STAGES:
        rows = settle(stage(spark, rows, SF), f"test-{name}")
        out.append(rows)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(kept):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_dedup", "decontamination", "packing"]
    assert all(df.columns == kept[0].columns for df in kept[1:-1])
    for before, after in zip(kept, kept[1:-1]):
        assert set(ids(after)) <= set(ids(before))


def test_language_id_keeps_texts_with_letters(kept):
    lost = set(ids(kept[0])) - set(ids(kept[1]))
    assert len(lost) <= 0.02 * kept[0].count()


def test_toxicity_keeps_clean_documents(spark, kept):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = set(ids(kept[1])) - set(ids(kept[2]))
    assert sum(labels.get(i) == 0 for i in lost) <= 0.02 * kept[1].count()


def test_near_dedup_equals_brute_force(kept):
    rows = sorted((r.doc_id, r.text) for r in kept[2].collect())
    assert ids(kept[3]) == sorted(set(brute_classes(rows).values()))


def test_decontamination_equals_brute_force(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits([(r.doc_id, r.text) for r in kept[3].collect()], items)
    assert ids(kept[4]) == sorted(d for d, (_, n, _) in hits.items() if not n)


def test_packing_takes_all_that_is_left(kept):
    assert sorted(set(ids(kept[5]))) == ids(kept[4])


def test_run_equals_the_stages(spark, kept):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, kept[5].select(columns).collect()))


def planted(df, rows):
    """Rows with ids of their own beside the given ones."""
    extra = [(900_000 + i, text, "en", "planted", len(text)) for i, text in enumerate(rows)]
    return df.unionByName(df.sparkSession.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint"), allowMissingColumns=True)


def test_language_id_drops_what_the_operator_rejects(spark, kept):
    docs = planted(kept[0], ["12345 67 !!", "", "... --- ...", "\U0001f600 \U0001f600"])
    model = language_id.fit(docs.filter(crc_mod("doc_id", 3) != 1).select("lang", "text"))
    verdicts = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    want = sorted(i for i, (lang, score) in verdicts.items() if lang != "und" and score >= 0.5)
    got = ids(corpus_pipeline.identify_language(spark, docs, SF))
    assert got == want and not any(i >= 900_000 for i in got)


def test_toxicity_drops_what_the_operator_rejects(spark):
    """On the larger tables: the smallest have too few toxic labels to learn from."""
    larger = SF.replace("0.001", "0.01")
    given, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    toxic = [r.text for r in given.join(labels.filter("toxic = 1"), "doc_id").orderBy("doc_id").limit(12).collect()]
    docs = planted(given, toxic)
    model = toxicity.fit(docs.filter(crc_mod("doc_id", 5) != 0), labels)
    verdicts = {r.doc_id: r.predicted for r in toxicity.judge(docs, model).collect()}
    got = ids(corpus_pipeline.drop_toxic(spark, docs, larger))
    assert got == sorted(i for i, bad in verdicts.items() if not bad)
    assert sum(i >= 900_000 for i in got) < 0.5 * len(toxic)


def test_packed_sequences_are_gapless_and_few(kept):
    sequences = {}
    for r in kept[5].collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    tokens = sum(length for members in sequences.values() for _, length in members)
    assert len(sequences) <= 1.04 * -(-tokens // packing.LENGTH) + 1


@pytest.mark.parametrize("rows", [odd_documents, no_documents])
def test_odd_rows_and_empty_tables_go_through_all_stages(spark, rows):
    given = rows(spark)
    docs, names = given, given.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF), f"odd-{name}")
        if name != "packing":
            assert docs.columns == names
            assert all(docs.filter(F.col(f"`{c}`") != "extra").isEmpty() for c in names if c not in ("doc_id", "text", "lang", "source", "n_chars"))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)
    assert given.isEmpty() == docs.isEmpty() or docs.isEmpty()
