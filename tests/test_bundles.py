"""Archives that are read and archives that are refused; catalogs, results, imports; lineage."""

import gzip
import io
import json
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from papershed.operators import lineage as L
from papershed.sources import bundles as B


def packed(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


FILES = {"report.json": b'{"url": "https://www.a.org/x/Y?q", "view": "web", "kinds": ["layout", "layout"]}', "page.html": b"<p>" * 500, "dir/": b"", "__MACOSX/a": b"", "dir/.DS_Store": b"", "dir/ü.txt": b"u"}


def changed(data, at, new):
    return data[:at] + new + data[at + len(new) :]


def test_files_of_archives():
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        found = dict(B.zip_files(packed(FILES, method)))
        assert set(found) == {"report.json", "page.html", "dir/ü.txt"} and found["page.html"] == FILES["page.html"]
    assert B.zip_files(packed({})) == []


def refused(data):
    with pytest.raises(B.BundleError) as e:
        B.zip_files(data)
    return str(e.value)


def test_archives_that_are_refused():
    whole = packed({"a": b"abc" * 50, "b": b"x"}, zipfile.ZIP_STORED)
    end, directory = whole.rindex(b"PK\x05\x06"), whole.index(b"PK\x01\x02")
    assert "no zip" in refused(b"") and "no zip" in refused(b"PK\x03\x04 and so on")
    assert "damaged" in refused(changed(whole, whole.index(b"abc"), b"abd"))  # the CRC tells
    assert "zip64" in refused(changed(whole, end + 10, b"\xff\xff")) and "zip64" in refused(changed(whole, end + 16, b"\xff\xff\xff\xff"))
    assert "encrypted" in refused(changed(whole, directory + 8, struct.pack("<H", 1)))
    assert "method" in refused(packed({"a": b"abc"}, zipfile.ZIP_BZIP2))
    assert "damaged" in refused(whole[200:])
    for name in ("../a", "/a", "x/../../a", "..\\a", "C:a"):
        assert "leads out" in refused(packed({name: b"x"}))
    with pytest.warns(UserWarning):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a", b"1")
            z.writestr("a", b"2")
    assert "twice" in refused(out.getvalue())


def test_a_small_archive_may_not_unpack_to_anything(monkeypatch):
    monkeypatch.setattr(B, "LARGEST_ENTRY", 1000)
    assert "too large" in refused(packed({"a": b"0" * 100_000}))


def test_roots():
    assert B.bundle_root(["report.json", "a/b"]) == "" and B.bundle_root(["r/report.json", "r/x"]) == "r/"
    for names in ([], ["a/report.json", "b/x"], ["a/x"]):
        with pytest.raises(B.BundleError):
            B.bundle_root(names)


def test_cases_and_imports(spark):
    report = lambda **kw: packed({"report.json": json.dumps({"url": "https://www.a.org/x/Y?q", "view": "web"} | kw)})
    data = [(1, packed(FILES)), (2, report()), (3, report(url="file:///tmp/Some%20Paper.pdf", view="text")), (4, report(view="feed")), (5, report(url="")), (6, packed({"report.json": b"{"})), (7, None), (8, report(url="https://b.org/", kinds=["a", 3]))]
    cases = B.feedback_cases(spark.createDataFrame(data, "path long, content binary"))
    by = {r["path"]: r for r in cases.collect()}
    assert (by[1]["slug"], by[1]["tags"], by[1]["corpus"]) == ("a-org-x-y", ["layout", "feedback"], "web")
    assert (by[3]["slug"], by[3]["corpus"]) == ("some-paper", "pdf") and by[8]["tags"] == ["a", "feedback"]
    assert [by[k]["problem"][:20] for k in (4, 5, 6, 7)] == ["a report on the view", "report.json has no u", "report.json is no JS", "no zip archive"]
    added, no = B.imported(spark.createDataFrame([("some-paper",)], "slug string"), cases)
    assert sorted(r["slug"] for r in added.collect()) == ["a-org-x-y", "b-org"]
    assert sorted(r["path"] for r in no.collect()) == [2, 3, 4, 5, 6, 7]


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "one.zip").write_bytes(packed(FILES))
    (tmp_path / "two.zip").write_bytes(b"no")
    rows = B.bundle_entries(B.binary_files(spark, str(tmp_path), "*.zip")).collect()
    assert {(r["path"][-7:], r["name"], r["problem"]) for r in rows} == {("one.zip", n, None) for n in ("report.json", "page.html", "dir/ü.txt")} | {("two.zip", None, "no zip archive")}
    with pytest.raises(FileNotFoundError):
        B.binary_files(spark, str(tmp_path), "*.gz")


def test_catalogs_and_snapshots(spark, tmp_path):
    entries = [{"slug": s, "url": f"https://x.org/{s}", "framework": "f", "tags": ["t"]} for s in ("b", "a", "c")]
    (tmp_path / "corpus.json").write_text(json.dumps(entries, indent=2))
    for slug, data in (("a", gzip.compress(b"<p>a")), ("c", b"no gzip"), ("z", gzip.compress(b"z"))):
        (tmp_path / "corpus" / slug).mkdir(parents=True)
        (tmp_path / "corpus" / slug / "page.html.gz").write_bytes(data)
    catalog = B.catalog(spark, str(tmp_path / "corpus.json"))
    assert [r["slug"] for r in catalog.orderBy("place").collect()] == ["b", "a", "c"]
    found = {r["slug"]: r["html"] for r in B.snapshots(catalog, B.binary_files(spark, str(tmp_path / "corpus"), "page.html.gz")).collect()}
    assert found == {"a": b"<p>a", "c": None}
    known = spark.createDataFrame([("https://x.org/a",)], "url string")
    assert sorted(r["slug"] for r in B.unknown_entries(catalog, known).collect()) == ["b", "c"]
    (tmp_path / "bad.json").write_text('[{"slug": ')
    with pytest.raises(Exception):
        B.catalog(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        B.catalog(spark, str(tmp_path / "none.json"))


def test_results_are_there_or_an_error(spark, tmp_path):
    schema, folder = "slug string, n int", tmp_path / "r"
    folder.mkdir()
    with pytest.raises(FileNotFoundError):
        B.judge_results(spark, str(folder), schema)
    (folder / "a.json").write_text('{\n "slug": "a",\n "n": 1}')
    (folder / "b.json").write_text('{"slug": "b"}')
    assert sorted(map(tuple, B.judge_results(spark, str(folder), schema).collect())) == [("a", 1), ("b", None)]
    (folder / "c.json").write_text('{"n": 3}')
    with pytest.raises(Exception, match="no slug"):
        B.judge_results(spark, str(folder), schema).collect()
    (folder / "c.json").write_text('{"slug": "c", "n": "x')
    with pytest.raises(Exception):
        B.judge_results(spark, str(folder), schema).collect()


def test_lineage_ends_and_is_found_soon(spark, monkeypatch):
    rounds = []
    own = L.kept
    monkeypatch.setattr(L, "kept", lambda *a: rounds.append(1) or own(*a))
    chain = spark.range(1, 301).select(F.col("id").cast("string").alias("id"), F.array((F.col("id") - 1).cast("string")).alias("lineage"))
    found = L.ancestors(chain)
    assert found.count() == 300 * 301 // 2 and len(rounds) <= 12
    cycle = spark.createDataFrame([("a", ["b"]), ("b", ["c", "d"]), ("c", ["a"]), ("e", [])], "id string, lineage array<string>")
    assert {(r[0], r[1]) for r in L.ancestors(cycle).collect()} == {(x, y) for x in "abc" for y in "abcd"}
    assert L.ancestors(cycle.limit(0)).count() == 0


def test_lineage_of_any_shape_in_small_tasks(spark):
    draw = random.Random(4)
    edges = {k: sorted(draw.sample(range(40), draw.choice((0, 1, 1, 2)))) for k in range(40)} | {0: [0], 41: [42], 42: [43], 43: [44], 44: [41]}
    expect = {(k, a) for k, made_from in edges.items() for a in made_from}
    while True:
        more = expect | {(a, d) for a, b in expect for c, d in expect if b == c}
        if more == expect:
            break
        expect = more
    found = L.ancestors(spark.createDataFrame([*edges.items()], "id long, lineage array<long>"))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == expect and len(rows) == len(expect)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism  # a task's pairs grow no faster than the cluster is small
    assert {tuple(r) for r in L.ancestors(spark.createDataFrame([(1, [2, None]), (2, [3])], "id long, lineage array<long>")).collect()} == {(1, 2), (1, None), (1, 3), (2, 3)}


def test_rebuilt_artifacts(spark):
    a, b, c, d = (ch * 16 for ch in "abcd")
    tool = lambda name, status, summary: {"name": name, "status": status, "summary": summary}
    schema = "id string, text string, tools array<struct<name:string,status:string,summary:string>>"
    rows = [(a, f"made {d} and {b}; not {'x' + c}", [tool("artifact_write", "done", f"artifact_write T → {c}"), tool("artifact_write", "failed", f"artifact_write T → {d}"), tool("other", "done", f"artifact_write T → {d}")]), (b, None, None)]
    asked = spark.createDataFrame(rows, schema).select("id", L.candidates(F.col("text"), F.col("tools")).alias("candidates"))
    assert {r["id"]: r["candidates"] for r in asked.collect()} == {a: [c, d, b], b: []}
    records = spark.createDataFrame([(c, "web", [a]), (d, "agent", [c]), (b, "agent", [a])], "id string, origin string, lineage array<string>")
    assert [tuple(r) for r in L.rebuilt(asked, records, L.ancestors(records)).collect()] == [(a, d)]


def test_bundles_are_packed_a_few_pages_at_a_time(spark, tmp_path):
    from papershed.plans import bundle_queries as Q

    spark.createDataFrame([(i, f"http://a.org/{i}", f"<p>{i}</p>") for i in range(200)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    made = Q._bundles(spark, str(tmp_path))
    assert "ArrowEvalPython" not in made._jdf.queryExecution().executedPlan().toString()  # which holds a whole batch of pages twice
    assert made.count() == 200 and Q.bundle_entries(spark, str(tmp_path)).filter("not refused").count() == len([i for i in range(200) if i % 13 != 4])
