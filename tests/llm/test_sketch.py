import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from papershed.llm import sketch as K

from .conftest import ODD


def plain(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        a, b, c = K.sketch(text), K.sketch(new), K.sketch(after)
        out.append((str(i), len(text), hashlib.sha256(new.encode()).hexdigest(), K.encoded(a), K.encoded(b), K.likeness(a, b), K.likeness(a, c)))
    return sorted(out)


def check(docs, rows):
    found = sorted((str(r[0]), *tuple(r)[1:]) for r in K.fingerprints(docs).collect())
    assert found == (plain(rows) if rows else [])


def test_odd_rows(spark, documents):
    rows = [*ODD, *((k, f"text {k} " * (k % 40)) for k in range(50, 300)), (300, "🙂é" * 100)]
    check(documents(rows), rows)
    check(documents(rows).repartition(7), rows)
    check(documents([]), [])
    check(documents([(5, "alone in the table")]), [(5, "alone in the table")])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_shingles_are_hashed_by_content(text):
    h, w = K.shingle_hashes(text), min(K.WIDTH, len(text))
    assert len(h) == (len(text) - w + 1 if w else 0)
    for k, v in enumerate(h.tolist()):
        assert K.shingle_hashes(text[k : k + w]).tolist() == [v]


def test_likeness_containment_and_merge():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 10**9, 6000)]
    long, part = " ".join(words), " ".join(words[:1500])
    shingles = lambda t: {t[k : k + 12] for k in range(len(t) - 11)}
    a, b = K.sketch(long), K.sketch(part)
    assert abs(K.likeness(a, b) - len(shingles(long) & shingles(part)) / len(shingles(long))) < 0.05
    assert K.containment(b, a) > 0.98
    both = K.merge(b, K.sketch(" ".join(words[1500:])))
    assert K.likeness(both, a) > 0.98
    assert K.likeness(K.decoded(K.encoded(a)), a) == 1.0
    assert K.likeness(K.sketch(""), K.sketch(None)) == 1.0 and K.likeness(K.sketch(""), a) == 0.0


def plain_hash(points):
    """The hash of one shingle in plain integers."""
    h = 0
    for p in points:
        h = (h * 0x100000001B3 + p + 1) % 2**64
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
    return (h ^ (h >> 31)) >> 32


@settings(max_examples=40, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text("ab ", max_size=400), st.integers(0, 6000).map(lambda n: " ".join(str(k * k) for k in range(n // 3)))))
def test_sketch_against_brute_force(text):
    width = min(K.WIDTH, len(text))
    hashes = sorted({plain_hash(map(ord, text[k : k + width])) for k in range(len(text) - width + 1)}) if width else []
    below = [h for h in hashes if h < 2**32 // K.FRACTION]
    want = (K.LIMIT, below) if len(below) >= K.FLOOR else (hashes[K.FLOOR - 1], hashes[: K.FLOOR]) if len(hashes) > K.FLOOR else (K.ALL, hashes)
    bound, found = K.sketch(text)
    assert (bound, found.tolist()) == want


def test_likeness_and_containment_estimate_those_of_whole_sets():
    a, b = (" ".join(str(k * k) for k in range(n, n + 30000)) for n in (0, 12000))
    whole = [set(K.shingle_hashes(t).tolist()) for t in (a, b)]
    both = len(whole[0] & whole[1])
    assert abs(K.likeness(K.sketch(a), K.sketch(b)) - both / len(whole[0] | whole[1])) < 0.05
    assert abs(K.containment(K.sketch(a[:20000]), K.sketch(a)) - 1) < 0.02
    merged = K.merge(K.sketch(a), K.sketch(b))
    assert set(merged[1].tolist()) == {h for h in whole[0] | whole[1] if h <= merged[0]}
