"""Column-oriented objects cut by byte ranges, against the standard parser on the whole text."""

import json
import random

import pytest

from quercus.sources import readers

AWKWARD = ["", "\\", "\\\\", '"', '\\"', '"\\', "a, b", "}", "{", "],[", ":", "é\U0001f600 日本", "two\nlines", "\t", "x" * 700, '","', '{"a":{"0":"'] 


def random_object(rng, rows):
    def value():
        return rng.choice([rng.choice(AWKWARD), rng.choice(AWKWARD) + rng.choice(AWKWARD), rng.randrange(10**6), None, True, ["}", "{\""], {"k": {"0": ",\""}}])

    out = {}
    for name in rng.sample(["a", "b", 'c"', "d\\", "é"], rng.randrange(1, 5)):
        out[name] = {str(i): value() for i in rng.sample(range(rows), rng.randrange(rows + 1))}
    return out


def brute(objects):
    """(index, {column: text}) as text values; a row for every index of an object."""
    rows = []
    for o in objects:
        for i in {i for cells in o.values() for i in cells}:
            rows.append((i, {c: cells[i] for c, cells in o.items() if cells.get(i) is not None}))
    return rows


def as_text(value):
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def comparable(rows):
    return sorted((i, tuple(sorted(cells.items()))) for i, cells in rows)


@pytest.fixture
def ranges(spark):
    """Read by ranges of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def use(size):
        for k, v in zip(keys, (size, 0)):
            spark.conf.set(k, str(v))

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed, size, indent", [(1, 97, None), (2, 211, 1), (3, 1 << 20, None)])
def test_any_range_gives_the_same_cells(spark, tmp_path, ranges, seed, size, indent):
    rng = random.Random(seed)
    objects = [random_object(rng, 12) for _ in range(4)]
    text = "\n".join(json.dumps(o, ensure_ascii=bool(seed % 2), indent=indent) for o in objects)
    (tmp_path / "one.json").write_text(text, encoding="utf-8")
    (tmp_path / "two.json").write_text(json.dumps(objects[0]), encoding="utf-8")
    ranges(size)
    cells = readers.columnar_cells(spark, str(tmp_path))
    got = {}
    for r in cells.collect():
        got.setdefault((r.file, r.object, r["index"]), {})[r.column] = r.value
    got = [(i, {c: v for c, v in row.items() if v is not None}) for (_, _, i), row in got.items()]
    want = [(i, {c: as_text(v) for c, v in row.items()}) for i, row in brute(objects + objects[:1])]
    assert comparable(got) == comparable(want)


def test_one_line_table_is_read_by_many_tasks(spark, tmp_path, ranges):
    """The task of a range holds its own cells only, whatever the table's size, and no line is read whole."""
    table = {c: {str(i): f"{c} {i}" for i in range(400)} for c in ("a", "b")}
    (tmp_path / "t.json").write_text(json.dumps(table))
    ranges(2000)
    pieces = spark.read.option("lineSep", '"').text(str(tmp_path))
    assert pieces.rdd.getNumPartitions() >= 8
    rows = readers.load_dataset(spark, str(tmp_path / "t.json")).collect()
    assert sorted((r["index"], r.a, r.b) for r in rows) == sorted((str(i), f"a {i}", f"b {i}") for i in range(400))


def test_defined_cases(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "hollow.json").write_text('{"a":{}}\n{}\n')
    (tmp_path / "other.json").write_text('{"n":5,"a":{"1":"x"},"l":[1,2],"b":{"1":"p","1":"q"}}')
    df = readers.load_columnar_objects(spark, str(tmp_path))
    assert df.columns == ["index", "a", "b"] and [tuple(r) for r in df.collect()] == [("1", "x", "q")]
    named = readers.load_columnar_objects(spark, str(tmp_path), ["a", "a.b", "none"], index="key")
    assert named.columns == ["key", "a", "a.b", "none"] and [tuple(r) for r in named.collect()] == [("1", "x", None, None)]
