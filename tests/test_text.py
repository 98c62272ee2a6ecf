from itertools import product

import pytest
from pyspark.sql import functions as F

from quercus.functions import text as tx

C = F.col


@pytest.mark.parametrize(
    "query, expected",
    [
        ("find it", True), ("", False), ("   \n", False), (None, False),
        ("x LIMIT 10 y", False), ("x limit 10", False), ("x lImIt 3", False), ("}LIMIT 3", True), ("x LIMIT", True),
        ("COUNT (?a)", False), ("count(?a)", False), ("COUNT(DISTINCT ?a)", False), ("cOuNt(*)", False),
        ("counting -x", True), ("limit10", True),
    ],
)
def test_can_add_limit(one, query, expected):
    assert one(tx.can_add_limit(C("q")), q=query) is expected


def test_add_limit(one):
    assert one(tx.add_limit(C("q"), 7), q="a") == "a\nLIMIT 7"
    assert one(tx.add_limit(C("q"), 0), q="a") == "a"
    assert one(tx.add_limit(C("q"), 7), q="a LIMIT 2") == "a LIMIT 2"


def test_prefixes_are_added_in_table_order_once(one):
    q = "SELECT * { ?a wdt:P1 wd:Q2; wdt:P3 ?b }"
    assert one(tx.add_prefixes(C("q")), q=q) == (
        "PREFIX wd: <http://www.wikidata.org/entity/>\nPREFIX wdt: <http://www.wikidata.org/prop/direct/>\n\n" + q
    )
    for same in ("", "plain", "wd:Q1 at the start", "?x unknown:y ?z"):
        assert one(tx.add_prefixes(C("q")), q=same) == same
    declared = "PREFIX dct: <http://purl.org/dc/terms/> # c\n?l dct:language wd:Q1"
    assert one(tx.add_prefixes(C("q")), q=declared) == "PREFIX wd: <http://www.wikidata.org/entity/>\n\n" + declared
    assert one(tx.add_prefixes(C("q")), q="?a wikibaseβ:x ?b").startswith("PREFIX wikibaseβ: <")


TAGS = [("[query]", "[/query]"), ("<sparql>", "</sparql>"), ("`sparql\n", "`")]


@pytest.mark.parametrize("tags, before, after", list(product(TAGS, ["", "noise "], ["", " noise"])))
def test_extract_tagged(one, tags, before, after):
    start, end = tags
    x = tx.extract_tagged(C("t"), start, end)
    assert one(x, t=f"{before}{start}the query{end}{after}") == "the query"
    assert one(x, t=f"{before}{start}a{end}b{end}{after}") == f"a{end}b"
    assert one(x, t=f"{before}{start}{end}{after}") == ""
    assert one(x, t=f"{before}{start}the query{after}") is None
    assert one(x, t=f"{before}the query{after}") is None


@pytest.mark.parametrize("tags, before, after", list(product(TAGS, ["", "noise "], ["", " noise"])))
def test_query_in_answer(one, tags, before, after):
    start, end = tags
    x = tx.query_in_answer(C("t"), start, end)
    status = tx.query_in_answer_status(C("t"), start, end)
    assert one(x, t=f"{before}{start}SELECT{end}{after}") == "SELECT"
    assert one(x, t=f"{before}{start} PREFIX p\nSELECT s {end}{end}{after}") == "PREFIX p\nSELECT s"
    assert one(x, t=f"{before}{start}{end}{after}") is None
    assert one(status, t=f"{before}{start}{end}{after}") == "NoSparqlMatch"
    assert one(status, t=f"{before}{start}SELECT{end}{after}") == ""


def test_query_format_ok(one):
    x = tx.query_format_ok(C("t"), "[q]", "[/q]")
    assert [one(x, t=t) for t in ("[q]SELECT[/q]", "[q]prefix[/q]", "[q]Select[/q]", "[q] [/q]", "no", None)] == [
        True, True, False, False, False, False,
    ]


def test_prepare_query(one):
    x = tx.prepare_query(C("t"), "[q]", "[/q]")
    assert one(x, t="[q]?a wd:Q1[/q]") == "PREFIX wd: <http://www.wikidata.org/entity/>\n\n?a wd:Q1\nLIMIT 10"
    assert one(x, t="[q] [/q]") == "exception: query is empty"
    assert one(tx.prepare_query(C("t"), "[q]", "[/q]", empty=None), t="none") is None


def test_ids(one):
    assert one(tx.extract_ids(C("q")), q="wd:Q1/wdt:P31 :L9 :X3 Q5 wd:Q1") == ["Q1", "P31", "L9", "Q1"]
    assert one(tx.extract_ids(C("q")), q="nothing") == []


def test_placeholders_with_accents(one):
    q = "un [entity:été bleu] et [property:sœur d'une, x] puis [entity:b] [other:c] [entity:a(b)]"
    assert one(tx.placeholders(C("q"), "entity"), q=q) == ["été bleu", "b"]
    assert one(tx.placeholders(C("q"), "property"), q=q) == ["sœur d'une, x"]


def test_fill_is_literal_and_keeps_unlinked(spark):
    row = ("[entity:a?] [property:of] [entity:b]", [("a?", "Q1", "A")], [("of", "P2", "of")])
    kind = "array<struct<label:string,id:string,matched:string>>"
    df = spark.createDataFrame([row], f"q string, e {kind}, p {kind}")
    assert df.select(tx.fill_placeholders(C("q"), C("e"), C("p")).alias("x")).first().x == "Q1 P2 [entity:b]"


def test_annotate_sentence(one):
    x = tx.annotate_sentence(C("s"), C("e"), C("p"))
    assert one(x, s="Which books of Ann are red?", e=["books", "Ann"], p=["of"]) == (
        "Which [entity 0] [property 0] [entity 1] are red?"
    )


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Entities: [a, b c]\nProperties: [d]", (["a", "b c"], ["d"], None)),
        ("entities [] properties [ x ]", ([], ["x"], None)),
        ("Entities: [] Properties: []", (None, None, "Nothing has been extracted.")),
        ("Entities: [a", (None, None, "The format of the response is not correct.")),
        ("Entities, Properties: [a]", (None, None, "The format of the response is not correct.")),
        ("", (None, None, "The generated answer by the LLM is empty.")),
    ],
)
def test_entity_listing(one, text, expected):
    assert tuple(one(tx.parse_entity_listing(C("t")), t=text)) == expected


def test_templates(one):
    assert one(tx.apply_template(F.lit("a <x> <y> <x>"), {"x": F.lit("<y>"), "y": F.lit(3)}, "<", ">")) == "a 3 3 3"
    with pytest.raises(TypeError):
        tx.apply_template(F.lit("a"), {1: F.lit("b")})
    with pytest.raises(TypeError):
        tx.apply_template(F.lit("a"), ["b"])
    for model, start in [("x/Llama-2-7b", "[INST] <<SYS>>"), ("LLAMA-3", "<|begin"), ("CodeLlama", "[INST] [sys"), ("Mistral-7B", "[INST] [system_prompt] [p")]:
        assert one(tx.template_for_model(C("m")), m=model).startswith(start)
    assert one(tx.template_for_model(C("m")), m="gpt") is None
    assert one(tx.row_as_text(C("a"), C("b"), C("c")), a="q", b=None, c="") == 'QUERY="q" DESCRIPTION="None" CONTEXT=""'


def test_few_shot_prompt_without_examples(one, spark):
    none = F.array().cast("array<struct<question:string,target:string>>")
    text = one(tx.few_shot_prompt(F.lit("<|start_header_id|>system<|end_header_id|>\n\n[system_prompt]<|eot_id|>U [prompt] A"), C("q"), none, C("t"), "<", ">"), q="why", t="x")
    assert text.startswith("U Your assignment") and text.endswith("instruction:why A") and "[examples]" not in text


def test_cleaning(one):
    assert one(tx.strip_comments(C("q")), q="a # b\nc <http://x#y>\nd") == "a \nc <http://x\nd"
    assert one(tx.strip_markup(C("q")), q=' <b>x</b>\n\ny class="c d" <img src=1/> ') == "x \ny"
    assert one(tx.strip_urls(C("q")), q="see https://a.b/c_1#d?e now") == "see  ?e now"
    assert one(tx.drop_prefix_lines(C("q")), q="PREFIX a: <b>\nPREFIX é1: <c>\nSELECT") == "SELECT"
    assert one(tx.quoted_sentences(C("q")), q='1. "Who a" and "b"\n"no"\nx "What?"') == ['"Who a" and "b"', '"What?"']
    assert one(tx.sentence_lines(C("q")), q=" A b.  C? D ") == "A b.\nC?\nD"
    assert one(tx.count_tokens(C("q")), q="né à 2, ok!") == 6
    assert one(tx.unescape_tag(C("q")), q="`a\\n") == "`a\n"
    assert one(tx.short_model_name(C("q")), q="a-b-c-d") == "b-c-d"
    assert one(tx.search_text(C("q"), "ÉT"), q="un été") is True


@pytest.mark.parametrize(
    "query, expected",
    [
        ("SELECT ?a WHERE {\n?a wdt:P1 wd:Q2\n}", True),
        ("SELECT ?a WHERE { ?a wdt:P1/wdt:P2* wd:Q2 }", True),
        ("SELECT ?a WHERE { ?a wdt:P1 wd:Q2 . ?a wdt:P3 ?b }", False),
        ("SELECT ?a { ?a wdt:P1 wd:Q2 }", False),
    ],
)
def test_single_hop(one, query, expected):
    assert one(tx.is_single_hop(C("q")), q=query) is expected


def test_answers_acceptable(one):
    x = tx.answers_acceptable(C("a"))
    assert one(x, a=["Who?", "What?"]) is True
    assert one(x, a=[]) is False
    assert one(x, a=["Who?", "use SELECT"]) is False
    assert one(x, a=["a GROUP of"]) is False


def test_recover_from_status(one):
    status = "Unexpected: err.sparql='x [INST] q [/INST] SELECT ?a\\nWHERE \\\\n'"
    assert one(tx.recover_from_status(C("s")), s=status) == "SELECT ?a\nWHERE \\n"
    assert one(tx.recover_from_status(C("s")), s="nothing") is None
