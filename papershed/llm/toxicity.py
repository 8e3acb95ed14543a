"""Toxicity from a weighted lexicon.

Texts are folded first: lower case, letters of other scripts that look Latin to their Latin
counterparts, digits and signs inside words to the letters they stand for. An Aho-Corasick
automaton then finds the entries of the lexicon, whole words and beginnings of words, each with
a weight learned from labelled documents. Exception phrases, in which an entry is harmless,
cancel it. The sum of weights is set against the text's length, and a logistic curve fitted on
the labelled sample turns it into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bound of the fit: labelled documents (expected, by a hash of doc_id).
SAMPLE = 20_000
#: An entry is in at least so many toxic documents of the sample and in at least this share of them, and its log odds
#: are at least so high.
LEAST_DOCS, LEAST_PART, LEAST_WEIGHT = 6, 0.01, 2.0
STEMS = (4, 5, 6, 7)
#: Different strings that a task counts before it sends the counts on.
HELD = 100_000

# Letters of other scripts by the Latin letters they look like, and what stands for letters.
CYRILLIC = dict(zip("авеѕіјкмнортсухԁѵ", "abesijkmhoptcyxdv"))
GREEK = dict(zip("αβεικνορτυχ", "abeiknoptux"))
SIGNS = dict(zip("0134578@$", "oieastbas"))

_FOLD = CYRILLIC | GREEK | SIGNS
#: What is folded: few characters of most texts, so looking for them is cheaper than a table for all characters.
_FOLDED = re.compile(f"[{re.escape(''.join(_FOLD))}]")
_OTHER = re.compile(r"[\W_]+")
#: A run of digits and signs without letters.
_NUMBER = re.compile(r"[\d@$_](?<![\w@$][\d@$_])[\d@$_]*+(?![\w@$])")


def fold(text: str | None) -> str:
    """The folded words of a text, with a space before, between and after them.

    Digits and signs stand for letters only where letters are next to them: plain numbers stay.
    """
    lower = (text or "").lower()
    folded, parts, at = _FOLDED.sub(lambda m: _FOLD[m[0]], lower), [], 0
    for number in _NUMBER.finditer(lower):
        parts += (folded[at : number.start()], number[0])
        at = number.end()
    return f" {_OTHER.sub(' ', ''.join(parts) + folded[at:]).strip()} "


def _entries(folded: str) -> set[str]:
    """What could be an entry: every word (with a space after it) and its beginnings."""
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for n in STEMS:
        found.update(" " + w[:n] for w in words if len(w) >= n)
    return found


@dataclass
class Lexicon:
    """``entries``: weights; ``exceptions``: word pairs; ``curve``: bias and slopes of the logistic curve."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 1.0]))
    automaton: object = None

    def matches(self, folded: str) -> Iterator[tuple[str, str, float]]:
        """(word pair before, word pair after, weight) of each word an entry is found in, the largest weight of a word counting."""
        if not self.entries:
            return
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for entry, weight in self.entries.items():
                self.automaton.add_word(entry, (len(entry), weight))
            self.automaton.make_automaton()
        best: dict[int, float] = {}
        for end, (n, weight) in self.automaton.iter(folded):
            start = end - n + 1
            best[start] = max(weight, best.get(start, 0.0))
        for start, weight in best.items():
            end = folded.find(" ", start + 1)
            before = folded.rfind(" ", 0, start)
            after = folded.find(" ", end + 1)
            word = folded[start + 1 : end]
            yield f"{folded[before + 1 : start]} {word}", f"{word} {folded[end + 1 : after] if after > 0 else ''}", weight

    def features(self, text: str | None) -> tuple[float, float]:
        """The sum of weights, damped, and the same for 100 words of the text."""
        folded = fold(text)
        total = sum(w for before, after, w in self.matches(folded) if before not in self.exceptions and after not in self.exceptions)
        if not total:
            return 0.0, 0.0
        return float(np.log1p(total)), float(np.log1p(100 * total / (folded.count(" ") - 1)))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.curve[0] + np.dot(self.curve[1:], self.features(text))))))


def _counted(sample: DataFrame, kind: str, found) -> DataFrame:
    """How many documents of the sample have each string that ``found`` returns."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], [kind, "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(found(text.as_py()))
                if len(counts) >= HELD:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return sample.select("text").mapInArrow(emit, f"{kind} string, n long").groupBy(kind).agg(F.sum("n").alias("n"))


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; slopes stay at or above 0."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x.T * (p * (1 - p) + 1e-9)) @ x + 0.05 * np.eye(len(b))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * b)
        b += np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    b[1:] = np.maximum(b[1:], 0)
    return b


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> Lexicon:
    """A lexicon from labelled documents that aren't held out (``held_out`` is a condition on doc_id).

    SAMPLE labels in the mean, by a hash of doc_id, are looked up in the documents; their whole
    texts are counted on the executors, equal texts with one label once. A doc_id with several labels counts under
    each of them; labels besides 0 and 1 and labels without a document don't count. What comes to the driver are
    entries that a hundredth of the sample's toxic documents has, so the sample bounds it. Without labels of
    either kind the score is low for all. Columns besides doc_id and text are ignored.
    """
    spark = docs.sparkSession
    usable = labels.filter(F.col("toxic").isin(0, 1)).filter(~held_out).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, SAMPLE / max(1, usable.count()))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * share))
    sample = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic").distinct().cache()
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        sample.unpersist()
        return Lexicon()
    toxic, clean = sample.filter("toxic = 1"), sample.filter("toxic = 0")
    enough = F.col("n") >= max(LEAST_DOCS, LEAST_PART * n[1])
    often = {r["entry"]: r["n"] for r in _counted(toxic, "entry", lambda text: _entries(fold(text))).filter(enough).collect()}
    known = spark.sparkContext.broadcast(frozenset(often))
    harmed = {r["entry"]: r["n"] for r in _counted(clean, "entry", lambda text: _entries(fold(text)) & known.value).collect()}
    strong = {e: float(np.log((k + 0.5) / (n[1] + 1)) - np.log((harmed.get(e, 0) + 0.5) / (n[0] + 1))) for e, k in often.items()}
    lexicon = Lexicon()
    for entry, weight in sorted(strong.items(), key=lambda e: (len(e[0]), e[0])):
        if weight >= LEAST_WEIGHT and all(lexicon.entries.get(entry[: n + 1], 0.0) < weight - 0.7 for n in STEMS if n + 1 < len(entry)):
            lexicon.entries[entry] = weight
    shared = spark.sparkContext.broadcast(Lexicon(dict(lexicon.entries)))
    pairs = lambda text: {p for before, after, _ in shared.value.matches(fold(text)) for p in (before, after)}
    phrases = _counted(clean, "phrase", pairs).filter("n >= 5").withColumnRenamed("n", "clean")
    phrases = phrases.join(_counted(toxic, "phrase", pairs).withColumnRenamed("n", "toxic"), "phrase", "left").na.fill(0, ["toxic"])
    harmless = phrases.filter(F.col("clean") * n[1] > 4 * (F.col("toxic") + 1) * n[0])
    lexicon.exceptions = {r["phrase"] for r in harmless.collect()}
    shared = spark.sparkContext.broadcast(Lexicon(dict(lexicon.entries), lexicon.exceptions))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(shared.value.features(t)))

    rows = sample.select(features("text").alias("x"), "toxic").collect()
    lexicon.curve = _curve(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    sample.unpersist()
    return lexicon


def toxicity(lexicon: Lexicon, text: Column) -> Column:
    """The score of a text column, 0 to 1; a null or empty text has the score of a text without any entry. Texts of any length are read whole; equal texts score the same."""
    shared = SparkSession.active().sparkContext.broadcast(Lexicon(lexicon.entries, lexicon.exceptions, lexicon.curve))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score)

    return score(text)
