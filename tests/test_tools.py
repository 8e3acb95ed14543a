"""Reading tools: schemas, answers, and the guards of a turn."""

import pytest

from papershed.operators import tools as T

A, B = "a" * 16, "b" * 16


@pytest.fixture(scope="module")
def library(spark):
    materials = spark.createDataFrame([(A, "Spark plans", "x" * 30_000, 5), (B, "Other", "of SPARK and plans", 9)], "id string, title string, text string, saved_s long")
    notes = spark.createDataFrame([(A, 2, "xx", None)], "material string, start int, quote string, note string")
    inbox = spark.createDataFrame([("i1", "Spark Plans today", "src", 1), ("i2", "Else", "src", None)], "id string, title string, source_id string, published_s long")
    T.register(spark, {"materials": materials, "annotations": notes, "inbox": inbox})
    return spark


def test_answers(library):
    rows = lambda name, **a: [tuple(r) for r in T.call(library, name, a).collect()]
    assert sorted(rows("library_search", query="plans  spark")) == [(A, "Spark plans", "material"), (B, "Other", "material"), ("i1", "Spark Plans today", "item")]
    assert rows("library_search", query="nothing of it") == []
    assert rows("library_recent", how_many=1) == [(B, "Other", 9)] and len(rows("library_recent")) == 2
    first = rows("material_read", material=A)[0]
    assert len(first[0]) == 24_000 and first[1:] == (24_000, 30_000) and rows("material_read", material=A, start=24_000)[0][1] is None
    assert rows("material_read", material=A, start=30_001) == [] and rows("material_annotations", material_id=A) == [(2, "xx", None)]
    assert [r[0] for r in rows("inbox_list")] == ["i1", "i2"]
    assert [r[0] for r in library.sql(f"SELECT total FROM material_read('{B}')").collect()] == [18]
    assert rows("library_search", query="'; DROP VIEW materials; --") == []


@pytest.mark.parametrize("name, arguments, says", [
    ("library_search", {}, "missing"), ("library_search", {"query": "  "}, "non-empty"), ("library_search", {"query": "x" * 201}, "longer than 200"), ("library_search", {"query": 3}, "non-empty"),
    ("library_recent", {"how_many": 0}, "between 1 and 100"), ("library_recent", {"how_many": 101}, "between"), ("library_recent", {"how_many": True}, "integer"), ("library_recent", {"limit": 5}, "Unknown argument"),
    ("material_read", {"material": "x"}, "form"), ("material_read", {"material": A, "start": -1}, "between"), ("library_search", ["q"], "JSON object"), ("nothing", {}, "Unknown tool"),
])
def test_arguments_are_checked_before_anything_is_planned(library, name, arguments, says):
    with pytest.raises(T.ArgumentError, match=says):
        T.call(library, name, arguments)


def test_schemas_and_tools_of_callers(library):
    assert T.READING[0].schema() == {"type": "object", "properties": {"query": {"type": "string", "maxLength": 200}}, "required": ["query"], "additionalProperties": False}
    mine = (T.Tool("long_titles", {"least": {"type": "integer"}}, ("least",), "title STRING", "SELECT title FROM materials WHERE char_length(title) >= least"),)
    T.register(library, {}, mine)
    assert [r[0] for r in T.call(library, "long_titles", {"least": 6}, mine).collect()] == ["Spark plans"]


def test_guards(spark):
    def outcomes(calls):
        df = spark.createDataFrame([(1, k, a, r) for k, (a, r) in enumerate(calls)], "turn int, k int, args string, reads boolean")
        return [r["outcome"] for r in T.guarded(df, "turn", ["k"], ["args"], "reads").orderBy("k").collect()]

    assert outcomes([("a", True)] * 14) == ["answered"] * 2 + ["refused"] * 9 + ["stopped"] + ["ended"] * 2
    assert outcomes([("w", False)] * 14) == ["answered"] * 14
    assert outcomes([("a", True), ("b", True), ("a", True), ("a", True), ("c", True)]) == ["answered"] * 3 + ["refused", "answered"]
    many = outcomes([(str(k), True) for k in range(303)])
    assert many == ["answered"] * 250 + ["refused"] * 49 + ["stopped"] + ["ended"] * 3
