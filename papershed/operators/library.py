"""Library operators: identity, filters, search, tags, metadata layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papershed.functions.text import let

MAX_TAGS, TAG_CHARS, MAX_WORDS = 20, 40, 8


def normal_tags(tags: Column) -> Column:
    """Trimmed to 40 characters, blanks dropped, the first spelling of each kept, 20 at most."""
    clean = F.filter(F.transform(tags, lambda t: F.trim(F.substring(F.trim(t), 1, TAG_CHARS))), lambda t: t != "")

    def first_spellings(clean: Column) -> Column:
        return let(F.transform(clean, F.lower), lambda low: F.transform(F.slice(F.array_distinct(low), 1, MAX_TAGS), lambda t: F.get(clean, (F.array_position(low, t) - 1).cast("int"))))

    return let(clean, first_spellings)


def has_tag(tags: Column, wanted: str) -> Column:
    return F.exists(tags, lambda t: F.lower(t) == wanted.strip().lower())


def has_all_words(haystack: Column, query: str) -> Column:
    """Every one of the query's first eight words is a substring; a blank query finds nothing."""
    words = query.lower().split()[:MAX_WORDS]
    found = F.lit(bool(words))
    for w in words:
        found = found & F.contains(F.lower(haystack), F.lit(w))
    return found


def tag_counts(tagged: DataFrame) -> DataFrame:
    """Tags by how many rows carry them."""
    return tagged.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def layered(layers: list[str], name: str) -> Column:
    """The first layer whose field isn't empty."""
    return F.coalesce(*[F.nullif(F.col(f"{layer}.{name}"), F.lit("")) for layer in layers]).alias(name)


def resolve(requests: DataFrame, known: DataFrame) -> DataFrame:
    """The material that a request's keys name: ``request_id, id``.

    Both sides have ``keys``, an array of struct(priority, key). Keys are exploded and met in
    one equi-join; of the candidates, the request's most important key wins, then the
    material fetched first. Common keys don't multiply: candidates of a key are reduced
    to the earliest before the join.
    """
    asked = requests.select("request_id", F.explode("keys").alias("k")).select("request_id", "k.priority", "k.key")
    offered = known.select("id", "fetched_s", F.explode("keys").alias("k")).groupBy("k.key").agg(F.min(F.struct("fetched_s", "id")).alias("best"))
    met = asked.join(offered, "key")
    return met.groupBy("request_id").agg(F.min(F.struct("priority", "best.fetched_s", "best.id")).alias("m")).select("request_id", "m.id")


def missing_references(rows: DataFrame, refs: str, known: DataFrame) -> DataFrame:
    """(id, ref) of references that name no row, and of those that name the row itself."""
    pairs = rows.select("id", F.explode(refs).alias("ref"))
    absent = pairs.join(known.select(F.col("id").alias("ref")), "ref", "left_anti").select("id", "ref")
    return absent.union(pairs.filter("id = ref").select("id", "ref")).distinct()


def unreferenced(refs: DataFrame, deleted: DataFrame) -> DataFrame:
    """References (id, ref) of deleted rows that no remaining row has."""
    gone = refs.join(deleted, "id", "left_semi").select("ref").distinct()
    return gone.join(refs.join(deleted, "id", "left_anti").select("ref"), "ref", "left_anti")


def merge_overrides(current: Column, patch: Column) -> Column:
    """map of overrides after a patch: an empty value clears its key, others replace."""
    kept = F.map_filter(current, lambda k, _: ~F.coalesce(F.map_contains_key(patch, k), F.lit(False)))
    return F.map_concat(kept, F.map_filter(patch, lambda _, v: v != ""))


def as_of(versions: DataFrame, version: int | None = None) -> DataFrame:
    """Each artifact at its newest version, or at the newest up to one."""
    rows = versions if version is None else versions.filter(F.col("version") <= version)
    return rows.groupBy("id").agg(F.max("version").alias("version"), F.max_by("body", "version").alias("body"))


def nearest_before(points: DataFrame, marks: DataFrame, by: str, at: str, name: str) -> DataFrame:
    """Each point with the last mark at or before it, per group: one union, one window, no join."""
    both = points.withColumn(name, F.lit(None).cast("string")).withColumn("_mark", F.lit(1)).unionByName(
        marks.select(by, at, F.col("value").cast("string").alias(name)).withColumn("_mark", F.lit(0)), allowMissingColumns=True
    )
    upto = Window.partitionBy(by).orderBy(at, "_mark").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(upto)).filter("_mark = 1").drop("_mark")


def overlapping(left: DataFrame, right: DataFrame, by: str, width: int) -> DataFrame:
    """Pairs of intervals of one group that overlap: left.start < right.stop and left.stop > right.start.

    Intervals are cut into bins of ``width`` and meet in an equi-join on group and bin; a pair is
    kept in the bin where its overlap starts, so it comes out once.
    """
    bins = lambda d, s, e: d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    a = bins(left.withColumnsRenamed({"start": "l_start", "stop": "l_stop"}), "l_start", "l_stop")
    b = bins(right.withColumnsRenamed({"start": "r_start", "stop": "r_stop"}), "r_start", "r_stop")
    met = a.join(b, [by, "_bin"]).filter((F.col("l_start") < F.col("r_stop")) & (F.col("l_stop") > F.col("r_start")))
    return met.filter(F.col("_bin") == F.floor(F.greatest("l_start", "r_start") / width)).drop("_bin")
