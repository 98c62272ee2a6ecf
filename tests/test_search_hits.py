"""Search over labels, against a scan of the dictionary for each text."""

import random

from quercus.operators import labels as lb

DICTIONARY = "id string, kind string, lang string, label string"


def brute(text, kind, dictionary, moved, best):
    norm = (text or "").strip(" ").lower()

    def first(of):
        hits = []
        for id, k, _, label in dictionary:
            own = (label or "").strip(" ").lower()
            if norm and k == of and own and (" " + own).find(" " + norm) >= 0:
                rank = 0 if own == norm else 1 if own.startswith(norm) else 2
                hits.append((rank, int(id[1:]), id, label))
        return min(hits, default=None)

    hit = first(kind) or first("entity" if kind == "property" else "property")
    if hit is None:
        return text, text, None
    if hit[2] in moved:
        target = moved[hit[2]]
        return target, best.get(target, target), hit[0]
    return hit[2], hit[3], hit[0]


def test_hits_equal_a_scan(spark):
    rng = random.Random(5)
    words = ["of", "river", "rivers", "house", "hous", "a", "ab", "the", "lake"]

    def label():
        return " ".join(rng.choices(words, k=rng.randrange(1, 4)))

    dictionary = [(f"Q{i}", "entity", "en", label()) for i in range(60)] + [(f"P{i}", "property", "en", label()) for i in range(40)]
    dictionary += [("Q90", "entity", "en", None), ("Q91", "entity", "en", "  "), ("Q92", "entity", "en", " River  of Time ")]
    # a word that is in every label of a kind
    dictionary += [(f"Q{1000 + i}", "entity", "en", f"common thing {i}") for i in range(2000)]
    moved = {f"Q{i}": f"Q{i + 1}" for i in range(0, 60, 4)} | {"P3": "P9999"}
    best = {id: label.strip() for id, _, _, label in dictionary if label}
    asked = {(label(), k) for k in ("entity", "property") for _ in range(60)}
    asked |= {(t, k) for t in ("", "  ", None, "riv", "RIVER", " of the ", "ous", "common", "common thing 17", "zebra", "h") for k in ("entity", "property")}
    wanted = spark.createDataFrame([(t, k, i) for i, (t, k) in enumerate(sorted(asked, key=str))], "label string, kind string, n int")
    redirects = spark.createDataFrame(list(moved.items()), "id string, target string")
    got = lb.search_hits(wanted, spark.createDataFrame(dictionary, DICTIONARY).repartition(4), redirects)
    assert got.columns == ["label", "kind", "n", "id", "matched", "rank"]
    rows = got.collect()
    assert len(rows) == len(asked)
    for r in rows:
        assert (r.id, r.matched, r["rank"]) == brute(r.label, r.kind, dictionary, moved, best), (r.label, r.kind)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DICTIONARY)
    wanted = spark.createDataFrame([("x", "entity")], "label string, kind string")
    assert [tuple(r) for r in lb.search_hits(wanted, none).collect()] == [("x", "entity", "x", "x", None)]
    assert lb.search_hits(wanted.limit(0), none).count() == 0
