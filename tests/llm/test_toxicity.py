import random

from pyspark.sql import functions as F

from papershed.llm import toxicity as T
from papershed.llm.queries import op6_toxicity

from .conftest import ODD


def test_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.1")
    found = op6_toxicity(spark, sf_dir)
    rows = found.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").select("toxic", "predicted").collect()
    toxic, clean = [r["predicted"] for r in rows if r["toxic"]], [r["predicted"] for r in rows if not r["toxic"]]
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.02


def train(spark, documents, rows):
    docs = documents([(k, t) for k, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(k, 1, y) for k, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    return T.fit(docs, labels, F.lit(False)), docs


def test_folding_exceptions_and_length(spark, documents):
    rng = random.Random(5)
    calm = lambda n: " ".join(rng.choices("the calm words only here and there are of many kinds".split(), k=n))
    rows = [(f"{calm(20)} grumbo {calm(20)}", 1) for _ in range(60)] + [(calm(40), 0) for _ in range(100)]
    rows += [(f"{calm(20)} grumbo salad {calm(20)}", 0) for _ in range(10)]
    lexicon, _ = train(spark, documents, rows)
    assert lexicon.score(f"here are grumbo and {calm(20)}") > 0.5 > lexicon.score(calm(30))
    assert lexicon.score(f"here are gruмbо and {calm(20)}") > 0.5 and lexicon.score(f"here are grumb0 and {calm(20)}") > 0.5
    assert lexicon.score(f"here are grumbo salad and {calm(20)}") < 0.5
    assert lexicon.score(f"grumbo {calm(5)}") > lexicon.score(f"grumbo {calm(800)}")


def test_odd_rows_and_missing_labels(spark, documents):
    lexicon, _ = train(spark, documents, [("only clean words", 0)])
    for model in (lexicon, T.fit(documents([]), spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(False))):
        scores = [r[0] for r in documents(ODD).select(T.toxicity(model, F.col("text"))).collect()]
        assert len(scores) == len(ODD) and all(0 <= s < 0.5 for s in scores)


def plain_matches(entries, folded):
    """Every word with the largest weight of the entries that it is or begins with, by plain search."""
    words = folded.split()
    found = []
    for k, word in enumerate(words):
        weights = [v for e, v in entries.items() if (e == f" {word} " if e.endswith(" ") else f" {word}".startswith(e))]
        if weights:
            found.append((f"{words[k - 1] if k else ''} {word}", f"{word} {words[k + 1] if k + 1 < len(words) else ''}", max(weights)))
    return sorted(found)


def test_automaton_against_plain_search():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcd", k=rng.randint(2, 9))) for _ in range(80)]
    entries = {f" {w} ": rng.uniform(2, 5) for w in words[:20]} | {f" {w[:4]}": rng.uniform(2, 5) for w in words[20:40] if len(w) >= 4}
    lexicon = T.Lexicon(entries)
    for n in (0, 1, 2, 50, 400):
        folded = T.fold(" ".join(rng.choices(words, k=n)))
        assert sorted(lexicon.matches(folded)) == plain_matches(entries, folded)


def test_only_numbers_next_to_letters_are_folded():
    assert T.fold("In 455 of 8008 cases, at $100 or 45.5%") == " in 455 of 8008 cases at 100 or 45 5 "
    assert T.fold("gr0ss b4d @pple $tone h3llo_w0rld а́Б") == " gross bad apple stone hello world a б "
    assert T.fold(None) == T.fold(" ,;") == "  "
    assert len(T.fold("a" * 300000 + " " + "1" * 300000)) == 600003
