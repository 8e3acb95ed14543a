import re

import pytest

from papershed.llm import decontaminate as D
from papershed.llm.queries import ORACLE_SQL

from .conftest import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank."), (2, None), (3, "..."), (10, "Rare-pair words"),
    (11, "rare pair WORDS"), (12, "a b c d e f g h i j"), (13, "a b c d e f g h i j k"),
]
TEXTS = [
    (20, "He said: the QUICK, brown fox jumps over the lazy dog near the old mill"), (21, "rare pair words rare pair words"), (21, "rare pair words rare pair words"),
    (22, "a b c d e f g h i j a b c d e f g h i j k"), (23, "quick brown fox jumps over the lazy dog near"), (24, "rare pair"),
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in windows}:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in windows:
                    hit.update(range(p, p + k))
                    found |= windows[g]
        out.append((str(doc), len(w), len(hit), sorted(found)))
    return sorted(out)


@pytest.mark.parametrize("limits", [(D.LITERAL_LIMIT, D.BROADCAST_LIMIT), (0, D.BROADCAST_LIMIT), (0, 0)])
def test_against_brute_force(spark, documents, monkeypatch, limits):
    monkeypatch.setattr(D, "LITERAL_LIMIT", limits[0])
    monkeypatch.setattr(D, "BROADCAST_LIMIT", limits[1])
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, hash int")
    rows = [*ODD, *TEXTS]
    found = D.decontaminate(documents(rows), items).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["items"])) for r in found) == plain(rows, ITEMS)
    for r in found:
        assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_hit"]
    clean = D.clean_documents(documents(rows), items)
    assert clean.columns == documents([]).columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _, n, _ in plain(rows, ITEMS) if not n)


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(documents([]), items).collect() == []
    found = D.decontaminate(documents(ODD), items).collect()
    assert len(found) == len(ODD) and not any(r["n_hit"] for r in found)
    assert D.clean_documents(documents(ODD), items).count() == len(ODD)
    assert "op3_decontamination" in ORACLE_SQL
