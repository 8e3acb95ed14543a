"""Tables in versions: readers, lost writers, two writers, exports."""

import pytest
from pyspark.sql import functions as F

from papershed.sources import versions as V


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, v string, saved_at long")


def pairs(df):
    return sorted((r["id"], r["v"]) for r in df.collect())


def test_saves_make_versions_that_readers_pin(spark, tmp_path):
    path = str(tmp_path / "t")
    assert V.versions(spark, path) == [] and V.manifest(spark, path) is None
    with pytest.raises(ValueError):
        V.load(spark, path)
    assert V.save(table(spark, *[(f"k{i}", "old", 1) for i in range(40)]), path, ["id"], rows_per_bucket=5) == 1
    first = V.load(spark, path)
    assert V.save(table(spark, ("k3", "new", 2), ("k3", "newer", 3), ("k99", "more", None)), path, ["id"], rows_per_bucket=5) == 2
    assert pairs(first) == [(k, "old") for k in sorted(f"k{i}" for i in range(40))] == pairs(V.load(spark, path, 1))
    assert dict(pairs(V.load(spark, path)))["k3"] == "newer" and V.load(spark, path).count() == 41
    made = V.manifest(spark, path)
    assert made["buckets"] >= 8 and made["rows"] == 41
    was = V.manifest(spark, path, 1)
    assert sum(made["folders"][b] != was["folders"][b] for b in was["folders"]) <= 2  # buckets that weren't touched stay where they were
    assert V.save(table(spark), path, ["id"]) is None and V.versions(spark, path) == [1, 2]
    assert pairs(V.load(spark, path, key=("id", "k3"))) == [("k3", "newer")] and V.load(spark, path, key=("id", "x")).count() == 0
    with pytest.raises(ValueError):
        V.load(spark, path, 9)


def test_ties_do_not_hang_on_chance(spark, tmp_path):
    rows = [("a", f"v{k}", 1) for k in range(30)]
    found = {V.latest(table(spark, *rows[k:], *rows[:k]).repartition(4), ["id"], "saved_at").first()["v"] for k in range(0, 30, 7)}
    assert len(found) == 1


def test_tables_grow_more_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(5):
        V.save(table(spark, *[(f"k{k}-{i}", "x", k) for i in range(20)]), path, ["id"], rows_per_bucket=10)
    assert V.manifest(spark, path)["buckets"] >= 8 and V.load(spark, path).count() == 100


def test_a_lost_writer_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.save(table(spark, ("a", "1", 1)), path, ["id"])
    with monkeypatch.context() as m:
        m.setattr(V, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            V.save(table(spark, ("a", "2", 2)), path, ["id"])
    assert pairs(V.load(spark, path)) == [("a", "1")]
    broken = table(spark, ("a", "3", 3)).withColumn("v", F.when(F.col("id") == "a", F.raise_error("no").cast("string")))
    with pytest.raises(Exception, match="no"):
        V.save(broken, path, ["id"])
    assert V.versions(spark, path) == [1] and pairs(V.load(spark, path)) == [("a", "1")]


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    V.save(table(spark, ("a", "1", 1)), path, ["id"])
    old = V.manifest(spark, path)
    rows = table(spark, ("b", "2", 1)).withColumn("bucket", F.lit(0))
    assert V._written(rows, path, old, 1, {0}) == 2
    with pytest.raises(V.Conflict):
        V._written(table(spark, ("c", "3", 1)).withColumn("bucket", F.lit(0)), path, old, 1, {0})
    assert pairs(V.load(spark, path)) == [("b", "2")]


def test_exports_in_whole_and_in_part(spark, tmp_path):
    path = str(tmp_path / "t")
    full = spark.createDataFrame([(f"s{k}", k, "one") for k in range(6)], "slug string, place int, text string")
    V.replace(full, path, "slug")
    again = full.filter("slug in ('s1', 's4')").withColumn("text", F.lit("two")).filter("slug <> 's4'")
    V.replace(again, path, "slug", full.filter("slug in ('s1', 's4')"))
    found = [(r["slug"], r["text"]) for r in V.load(spark, path).orderBy("place").collect()]
    assert found == [("s0", "one"), ("s1", "two"), ("s2", "one"), ("s3", "one"), ("s5", "one")]  # s4 failed this time
    V.replace(full.limit(2), path, "slug")
    assert V.load(spark, path).count() == 2 and V.load(spark, path, 1).count() == 6
