import pytest

from lexivault.operators.packed_values import dialects, parse, split_values, unquote


@pytest.mark.parametrize(
    ("cell", "values"),
    [
        ("a; b;c", ["a", "b", "c"]),
        ('"x ""Y XR"""\tz', ['x "Y XR"', "z"]),
        ("“sharp, on waking” • dull", ["sharp, on waking", "dull"]),
        ("a/b / c", ["a/b", "c"]),
        ("K63.0–K63.7, T12 (late, mild)", ["K63.0–K63.7", "T12 (late, mild)"]),
        ("x [A; B] | ,, y", ["x [A; B]", "y"]),
        ('open "quote, b', ['open "quote', "b"]),
        ("(open, b", ["(open", "b"]),
        ("", []),
    ],
)
def test_parse(cell, values):
    delimiters = {d for s, _ in dialects(cell) for d in s}
    assert parse(cell, sorted(delimiters), True) == values


def test_unquote():
    assert unquote(' "a ""b""" ') == 'a "b"'
    assert unquote('"a" and "b"') == '"a" and "b"'
    assert unquote('"') == '"'


def test_split_values(spark):
    long = "; ".join(f"v{i}" for i in range(3000))
    rows = [(1, "a; b", None, 0), (1, "a; b", None, 0), (2, " ", "NaN", 0), (3, "-", "b; a; b", 0), (4, long, "a", 0), (None, "c", "", 0)]
    df = spark.createDataFrame(rows, "id int, `F 1` string, g string, item int")
    got = {(r["id"], r["field_name"], r["pos"], r["item"]) for r in split_values(df, "id", ["F 1", "g"]).collect() if r["id"] != 4}
    assert got == {(1, "F 1", 1, "a"), (1, "F 1", 2, "b"), (3, "g", 1, "b"), (3, "g", 2, "a"), (3, "g", 3, "b"), (None, "F 1", 1, "c")}
    assert split_values(df, "id", ["F 1"]).where("id = 4").count() == 3000


def test_empty(spark):
    out = split_values(spark.createDataFrame([], "id int, f string"), "id", ["f"])
    assert out.columns == ["id", "field_name", "pos", "item"]
    assert out.count() == 0


def test_dialect_of_least_length(spark):
    """A comma that is part of a value many cells hold whole isn't a delimiter, one between known values is."""
    rows = [(i, "rest, then walk") for i in range(3)] + [(9, "alpha,beta"), (10, "alpha"), (11, "beta"), (12, '"rest, then walk"; alpha')]
    got = {(r["id"], r["pos"]): r["item"] for r in split_values(spark.createDataFrame(rows, "id int, f string"), "id", ["f"]).collect()}
    assert (got[9, 1], got[9, 2]) == ("alpha", "beta")
    assert got[12, 1] == "rest, then walk"


def test_every_set_of_delimiters_is_scored(spark):
    """Two delimiters divide, two are part of values that other cells hold in quotes: neither all nor one alone is right."""
    assert len(dialects("a; b, c | d • e")) == 16
    rows = [(i, f'"early, late"; v{i}') for i in range(40)] + [(100 + i, f'"left | right"; w{i}') for i in range(40)] + [(200 + i, "alpha; beta") for i in range(40)]
    rows += [(300, "early, late; alpha • left | right")]
    out = split_values(spark.createDataFrame(rows, "id int, f string"), "id", ["f"]).where("id = 300").orderBy("pos")
    assert [r["item"] for r in out.collect()] == ["early, late", "alpha", "left | right"]


def test_null_ids_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(None, "a; b"), (None, "a; b"), (1, "c"), (1, "c")], "id int, f string")
    assert split_values(df, "id", ["f"]).where("id is null").count() == 4 and split_values(df, "id", ["f"]).where("id = 1").count() == 1
