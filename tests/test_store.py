"""Kept tables and reviews on cases that a glance can check."""

import pytest
from pyspark.sql import functions as F

from papershed.operators import quality as Q
from papershed.operators import review as R
from papershed.operators import store as S


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_saves_replace_whole_rows(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda *r: spark.createDataFrame(r, "id string, v string, saved_at int")
    ids = [f"{k:016x}" for k in range(40)]
    S.save(rows(*[(i, "old", 1) for i in ids]), path, ["id"])
    S.save(rows((ids[3], "new", 2), (ids[3], "newer", 3), ("f" * 16, "more", 2)), path, ["id"])
    found = {r["id"]: r["v"] for r in S.load(spark, path).collect()}
    assert len(found) == 41 and found[ids[3]] == "newer" and found[ids[4]] == "old"
    assert [r["v"] for r in S.load(spark, path, ids[3]).collect()] == ["newer"] and S.load(spark, path, "x'; --").count() == 0
    S.save(rows().limit(0), path, ["id"])
    assert S.load(spark, path).count() == 41


def test_versions_of_the_table(spark):
    old = spark.createDataFrame([(1, "t", None)], "id int, title string, note string")
    assert [r["meta"] for r in S.migrated(old, 1).collect()] == ['{"title":"t"}'] and "kept_s" in S.migrated(old, 2).columns
    assert S.migrated(S.migrated(old, 1), 1).columns == S.migrated(old, 1).columns
    with pytest.raises(ValueError):
        S.migrated(old, 5)


def test_edits(spark):
    df = spark.createDataFrame([("abcabc", "b", "X"), ("abc", "b", "X"), ("aaa", "aa", "X"), ("abc", "z", "X"), ("abc", "", "X")], "s string, o string, n string")
    assert [tuple(r[0]) for r in df.select(R.edited_once(F.col("s"), F.col("o"), F.col("n"))).collect()] == [(None, "repeated"), ("aXc", None), (None, "repeated"), (None, "absent"), (None, "empty")]


def test_editor_notes(spark):
    notes = lambda title, text, cites=False: one(spark, lambda v: R.editor_notes(F.lit(title), v, F.lit(cites)), text)[0]
    assert notes("Caches in CPUs", "# T\n\nA lead.\n\n## Rerankers win\n\ntext") == []
    assert notes("Summary", "## Notes\n\nIn conclusion " + "word " * 200, True) == ["title", "lead", "heading", "citations", "filler", "paragraph"]
    assert notes("x" * 91, "word " * 401) == ["long_title", "sections", "paragraph"]


def test_evidence(spark):
    text = "## Head\nOne **bold** word\nand <b>more</b> text.\n## Next\nLast line here"
    assert one(spark, lambda v: R.evidence_occurs(v, F.lit(text)), "One bold word and more", "One **bold** word…", "two", "  ", "...") == [True, True, False, False, False]
    shown = lambda quote, seen: one(spark, lambda v: R.section_shown(v, F.lit(text), F.lit(seen)), quote)[0]
    assert shown("One bold word", "head one bold word. And b more b text") and not shown("One bold word", "one bold word") and not shown("bold word", "Head One bold word and more text")
    assert one(spark, lambda v: R.beyond_article(F.lit("missing_content"), v), "© 2024 X", "@article{x", "prose") == ["notice", "citation", None]
    assert one(spark, lambda v: v.rlike(R.MOJIBAKE), "cafÃ©", "â†’", "café", "Â©") == [True, True, False, True]


def test_greedy_matching_takes_the_closest_first(spark):
    issue = "struct<kind: string, layer: string, severity: string, evidence: string, refs: array<string>>"
    screen = [("images", "content", "minor", "s0", ["r1"]), ("images", "rendering", "major", "s1", ["r1", "r2"]), ("noise", "content", "major", "s2", []), ("noise", "content", "minor", "s2", [])]
    confirm = [("images", "rendering", "minor", "c0", ["r1"]), ("text", "content", "major", "c1", ["r1"]), ("noise", "content", "minor", "c2", []), ("noise", "content", "major", "c3", ["r9"])]
    df = spark.createDataFrame([("a", screen, confirm), ("b", [], confirm[:1]), ("c", [], [])], f"slug string, screen array<{issue}>, confirm array<{issue}>")
    rows = {r["slug"]: r for r in Q.cross_confirmed(df, lambda i: i["kind"] == "images").collect()}
    assert [tuple(p) for p in rows["a"]["pairs"]] == [(0, 1), (1, 0), (2, 2)] and rows["c"]["merged"] == []
    assert [(m["evidence"], m["severity"], m["origin"]) for m in rows["a"]["merged"]] == [("c0", "major", "both"), ("c1", "major", "both"), ("c2", "major", "both"), ("c3", "minor", "one-sided-downgraded"), ("s2", "minor", "one-sided")]
    assert [(m["evidence"], m["origin"]) for m in rows["b"]["merged"]] == [("c0", "one-sided")]


def test_pictures_in_order(spark):
    df = spark.createDataFrame([(["b", None, "x", "a", None, None], ["a", "b", "c", "d"])], "k array<string>, p array<string>")
    assert df.select(R.aligned_sources(F.col("k"), F.col("p"))).first()[0] == ["b", "c", "x", "a", "d", ""]


def test_policies():
    assert R.policy_key("single", ["a"]) == "single a" and R.policy_key("both", ["a", "b"]) == "both a + b"
    for wrong in (("none", ["a"], []), ("single", ["a", "b"], []), ("screen-then-confirm", ["a", "b"], []), ("both", ["a", "b"], ["MAJOR"])):
        with pytest.raises(ValueError):
            R.policy_key(*wrong)


def test_links_fit(spark):
    long = one(spark, lambda v: R.fitted_link(F.lit("https://e.org/?b="), v, 100), "word " * 50, "short", "漢字 " * 40)
    assert all(len(x) <= 120 for x in long) and long[1] == "https://e.org/?b=short" and long[0].endswith("%E2%80%A6")
    assert one(spark, R.find_text, "“Hello, big  world! And then one more.”") == ["Hello big world And then one"]
