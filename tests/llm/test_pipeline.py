import corpus_pipeline as C
from papershed.llm import decontaminate, similar

from .conftest import ODD
from .test_decontamination import plain
from .test_similar import plain_roots


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = {r["doc_id"]: r["text"] for r in docs.collect()}, spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.items() <= before.items()
        kept.append((before, after))
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    before, after = kept[0]
    assert len(set(before) - set(after) - toxic) <= 0.02 * len(before)
    before, after = kept[1]
    assert len(after) >= 0.98 * len(before)
    before, after = kept[2]
    ids = sorted(before)
    assert set(after) == {ids[g] for g in plain_roots([before[i] for i in ids])}
    before, after = kept[3]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {str(i) for i in after} == {i for i, _, n, _ in plain(list(before.items()), items) if not n}
    pieces = C.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == set(after)


def test_run_is_the_stages(spark, sf_dir):
    assert C.run(spark, sf_dir).count() > 0 and C.ORACLE_SQL is None
    assert (similar.SHINGLE, similar.SIMILARITY, decontaminate.WIDTH) == (5, 0.8, 10)


def test_stages_with_odd_rows_and_clashing_names(spark, documents, sf_dir):
    for _, stage in C.STAGES[:-1]:
        for rows in (ODD, []):
            docs = documents(rows)
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            kept = [(r["doc_id"], r["text"]) for r in out.collect()]
            assert all(kept.count(r) <= rows.count(r) for r in kept)
    assert [(r["doc_id"], r["length"]) for r in C.STAGES[-1][1](spark, documents([(1, None)]), sf_dir).collect()] == [(1, 1)]
