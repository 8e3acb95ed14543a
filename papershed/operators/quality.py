"""Quality evaluation: issues, opinions, verdicts, baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papershed.functions.text import let

LAYERS = ("content", "metadata", "rendering")
NAMES = ("PASS", "MINOR", "MAJOR")


def verdicts(cases: DataFrame) -> DataFrame:
    """Cases with ``rank``, the worst layer's; layers that weren't judged don't count."""
    return cases.withColumn("rank", F.greatest(*LAYERS))


def verdicts_from_issues(issues: DataFrame) -> DataFrame:
    """A case's verdict for each layer with issues: 2 with a major one, else 1."""
    return issues.groupBy("slug", "layer").agg(F.max(F.when(F.col("severity") == "major", 2).otherwise(1)).alias("rank"))


def totals(cases: DataFrame) -> DataFrame:
    """Verdict counts overall and for each layer, every verdict listed."""
    judged = verdicts(cases)
    layers = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(c).alias("rank")) for n, c in (*((x, x) for x in LAYERS), ("all", "rank"))])
    flat = judged.select(F.explode(layers).alias("v")).select("v.*").filter("rank is not null")
    return flat.groupBy("layer").agg(*[F.count_if(F.col("rank") == k).alias(NAMES[k].lower()) for k in range(3)])


def issue_counts(issues: DataFrame) -> DataFrame:
    """Cases, issues and severities by layer and kind, and by kind over all layers, in one pass."""
    counted = issues.groupingSets([["layer", "kind"], ["kind"]], "layer", "kind").agg(
        F.grouping("layer").cast("int").alias("all_layers"),
        F.countDistinct("slug").alias("n_cases"),
        F.count("*").alias("n_issues"),
        F.count_if(F.col("severity") == "major").alias("n_major"),
    )
    return counted.select(F.coalesce("layer", F.lit("all")).alias("layer"), "kind", "n_cases", "n_issues", "n_major")


def compare(cases: DataFrame, baseline: DataFrame) -> DataFrame:
    """Cases against a baseline by slug: ``errored`` without any verdict, ``added`` if the baseline hasn't the slug, ``worse`` if the overall
    verdict or any layer is, whatever else improved, then ``better``. Layers that either side didn't judge don't count."""
    b = baseline.select("slug", F.lit(True).alias("known"), *[F.col(c).alias(f"b_{c}") for c in LAYERS])
    pairs = [(F.greatest(*LAYERS), F.greatest(*[f"b_{c}" for c in LAYERS])), *((F.col(c), F.col(f"b_{c}")) for c in LAYERS)]
    worse = F.coalesce(*[F.when(now > then, True) for now, then in pairs], F.lit(False))
    better = F.coalesce(*[F.when(now < then, True) for now, then in pairs], F.lit(False))
    change = F.when(F.greatest(*LAYERS).isNull(), "errored").when(F.col("known").isNull(), "added").when(worse, "worse").when(better, "better").otherwise("unchanged")
    return cases.join(b, "slug", "left").select("slug", change.alias("change"))


def updated_baseline(cases: DataFrame, baseline: DataFrame) -> DataFrame:
    """The baseline with judged cases written over it; the others keep what they had."""
    new = cases.select("slug", *[F.col(c).alias(f"n_{c}") for c in LAYERS], F.lit(True).alias("judged"))
    merged = [F.when(F.col("judged"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in LAYERS]
    return baseline.join(new, "slug", "full_outer").select("slug", *merged)


def agreement(opinions: DataFrame) -> DataFrame:
    """``screen, pass, minor, major``: how often each confirming verdict follows each screening one, all nine counts, zeros filled in."""
    spark = opinions.sparkSession
    counted = opinions.filter("confirm is not null").groupBy("screen").agg(*[F.count_if(F.col("confirm") == k).alias(NAMES[k].lower()) for k in range(3)])
    every = spark.range(3).select(F.col("id").cast("int").alias("screen"))
    return every.join(F.broadcast(counted), "screen", "left").na.fill(0)


def first_of_each(issues: DataFrame) -> DataFrame:
    """Issues without repeats of (layer, kind, ref) in an opinion; the first stays."""
    first = Window.partitionBy("slug", "opinion", "layer", "kind", "ref").orderBy("ord")
    return issues.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def distinct_kinds(issues: DataFrame) -> DataFrame:
    """A case's kinds in order of first appearance, each with its worst severity."""
    kinds = issues.groupBy("slug", "kind").agg(F.min("ord").alias("ord"), F.bool_or(F.col("severity") == "major").alias("major"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "kind", "major")))
    text = F.transform(listed, lambda k: F.concat(k["kind"], F.when(k["major"], "!").otherwise("")))
    return kinds.groupBy("slug").agg(F.array_join(text, ",").alias("kinds"))


def matched_issues(cases: DataFrame) -> DataFrame:
    """Cases (slug, ``screen`` and ``confirm``: arrays of struct<kind, layer, refs, ...> in order) with ``pairs``, array<struct<c, s>>.

    Two issues match if they share a ref, or, with no refs on either side, on layer and kind. Each confirming issue in
    turn takes, of the screening ones not taken, the first of its kind and layer, else of its kind, else the first.
    A case's issues are few; cases are spread over the tasks.
    """

    def match(c: Column, s: Column) -> Column:
        a, b = c["refs"], s["refs"]
        return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b)).otherwise((F.size(a) == F.size(b)) & (c["layer"] == s["layer"]) & (c["kind"] == s["kind"]))

    def step(acc: Column, k: Column) -> Column:
        c = F.get("confirm", k)

        def rank(i: Column) -> Column:
            s = F.get("screen", i)
            closest = F.when((s["kind"] == c["kind"]) & (s["layer"] == c["layer"]), 0).when(s["kind"] == c["kind"], 1).otherwise(2)
            return F.when(match(c, s) & ~F.exists(acc, lambda p: p["s"] == i), F.struct(closest.alias("rank"), i.alias("i")))

        best = F.array_min(F.transform(_places("screen"), rank))
        return F.when(best.isNull(), acc).otherwise(F.array_append(acc, F.struct(k.alias("c"), best["i"].alias("s"))))

    none = F.array().cast("array<struct<c:int,s:int>>")
    return cases.withColumn("pairs", F.aggregate(_places("confirm"), none, step))


def _places(name: str) -> Column:
    """The places in an array, none if it is empty."""
    return F.when(F.size(name) > 0, F.sequence(F.lit(0), F.size(name) - 1)).otherwise(F.array().cast("array<int>"))


def cross_confirmed(cases: DataFrame, supported: Callable[[Column], Column]) -> DataFrame:
    """Cases with ``merged``: pairs keep the confirming issue at the more severe severity (origin ``both``); of one-sided issues a
    minor one stays, a major one stays if a measured fact supports it (``supported``) and is minor otherwise. Of issues that agree
    in layer, kind and evidence the first stays. Issues have ``severity, layer, kind, evidence, refs``."""
    matched = matched_issues(cases)

    def out(issue: Column, severity: Column, origin: Column) -> Column:
        return F.struct(issue["layer"].alias("layer"), issue["kind"].alias("kind"), issue["evidence"].alias("evidence"), severity.alias("severity"), origin.alias("origin"))

    def paired(p: Column) -> Column:
        c, s = F.get("confirm", p["c"]), F.get("screen", p["s"])
        capped = F.when(c["kind"] == "extra_content", "minor").when((c["severity"] == "major") | (s["severity"] == "major"), "major").otherwise("minor")
        return out(c, capped, F.lit("both"))

    def alone(issue: Column) -> Column:
        minor, fact = issue["severity"] == "minor", supported(issue)
        return out(issue, F.when(minor | ~fact, "minor").otherwise("major"), F.when(minor, "one-sided").when(fact, "one-sided-fact").otherwise("one-sided-downgraded"))

    def rest(pairs: Column, name: str, side: str) -> Column:
        left = F.filter(_places(name), lambda i: ~F.exists(pairs, lambda p: p[side] == i))
        return F.transform(left, lambda i: alone(F.get(name, i)))

    def distinct(every: Column) -> Column:
        keys = F.transform(every, lambda e: F.struct(e["layer"], e["kind"], e["evidence"]))
        return let(keys, lambda known: F.filter(every, lambda e, i: F.array_position(known, F.get(known, i)) == i + 1))

    merged = let(F.col("pairs"), lambda pairs: let(F.concat(F.transform(pairs, paired), rest(pairs, "confirm", "c"), rest(pairs, "screen", "s")), distinct))
    return matched.withColumn("merged", merged)
