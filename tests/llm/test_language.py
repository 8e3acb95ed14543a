import numpy as np
from pyspark.sql import functions as F

from papershed.llm import langid as L
from papershed.llm.queries import op2_language

from .conftest import ODD


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    found = op2_language(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").filter("held_out").collect()
    assert found.count() == 1000 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


def test_odd_rows(spark, documents):
    texts = {"en": "the cat sat with the other hat and then went home", "es": "el niño comió la manzana y después salió a jugar"}
    docs = documents([(100 + k, texts[lang], lang) for k in range(10) for lang in texts] + [(*r, "en") for r in ODD] + [(1, "el niño y la niña", None)])
    filters = L.fit(docs, F.lit(False))
    assert filters.languages == ["en", "es"]
    found = docs.select("doc_id", L.language(filters, F.col("text")).alias("f")).select("doc_id", "f.*").collect()
    assert len(found) == 33 and all(0 <= r["score"] <= 1 for r in found)
    by_id = {r["doc_id"]: r["lang_pred"] for r in found}
    assert [by_id[k] for k in (3, 4, 5, 12)] == ["und"] * 4 and by_id[1] == "es" and by_id[10] in ("en", "es")


def test_nothing_to_learn_from(spark, documents):
    filters = L.fit(documents([(1, "text", None)]), F.lit(False))
    assert filters.decide("text") == ("und", 0.0)
    assert L.fit(documents([]), F.lit(False)).languages == []


def exact_counts(text, grams):
    """How many n-grams of the text each language's set has, without filters."""
    own = L.gram_hashes(L.normal(text)).tolist()
    return [sum(h in g for h in own) for g in grams]


def test_filters_against_exact_sets():
    rng = np.random.default_rng(3)
    words = lambda: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(300))
    grams = [np.unique(L.gram_hashes(words())) for _ in range(130)]
    filters = L.Filters.of([f"l{k:03}" for k in range(130)], grams, 0)
    assert [t.dtype for t in filters.tables] == [np.uint64, np.uint64, np.uint8]
    sets = [set(g.tolist()) for g in grams]
    for _ in range(5):
        text = words()
        h = L.gram_hashes(L.normal(text))
        exact, found = np.array(exact_counts(text, sets)), filters.counts(h)
        assert (found >= exact).all()  # a filter loses nothing
        assert abs((found - len(h) * filters.rates) / (1 - filters.rates) - exact).max() <= 2 + 0.001 * len(h)
    other = L.Filters.of(filters.languages, [L.gram_hashes(f"word{chr(97 + j // 26)}{chr(97 + j % 26)}") for j in range(130)], 0)
    for k in (0, 63, 64, 100, 127, 128, 129):
        assert other.decide(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}")[0] == f"l{k:03}"


def test_more_than_64_languages_are_learned(spark, documents):
    rows = [(70 * n + k, f"zq{chr(97 + k // 26)}{chr(97 + k % 26)}xw here", f"l{k:02}") for n in range(6) for k in range(70)]
    docs = documents(rows)
    filters = L.fit(docs, F.lit(False))
    assert len(filters.languages) == 70
    found = docs.select("lang", L.language(filters, F.col("text"))["lang_pred"].alias("p")).collect()
    assert all(r["lang"] == r["p"] for r in found)
