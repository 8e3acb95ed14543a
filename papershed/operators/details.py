"""Smaller operators: labels and flags, numbering, matching, validation, tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS, MAX_ANNOTATIONS, TILE_HEIGHT = 150, 2000, 4096


def review_flags(text: Column, title: Column, links: Column, paragraphs: Column) -> Column:
    """The names of the rules that a document breaks."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.array_compact(
        F.array(
            F.when(words < MIN_WORDS, "short"),
            F.when(F.coalesce(F.trim(title), F.lit("")) == "", "no_title"),
            F.when(links > 3 * F.greatest(paragraphs, F.lit(1)), "many_links"),
        )
    )


def quality_label(completeness: Column, safe: Column, warnings: Column) -> Column:
    """struct<label, low>: the first case that holds."""
    case = lambda label, low: F.struct(F.lit(label).alias("label"), F.lit(low).alias("low"))
    return F.when(~safe, case("unsafe", True)).when(completeness == "summary", case("summary", True)).when(warnings > 0, case("checked", False)).otherwise(case("full", False))


def day_label(at: Column, now: Column) -> Column:
    """Today, Yesterday, the weekday within a week, else the date."""
    days = F.datediff(F.to_date(now), F.to_date(at))
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.date_format(at, "EEEE")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def nearest(rows: DataFrame, by: str, at: str, is_mark: Column, mark_id: str) -> DataFrame:
    """Each row that is no mark with the nearest mark of its group, the earlier one of two as near.

    Two running windows over one sort: the last mark before and the first one after; no join.
    """
    mark = F.when(is_mark, F.struct(F.col(at).alias("t"), F.col(mark_id).alias("id")))
    order = Window.partitionBy(by).orderBy(at, mark_id)
    before = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    both = rows.withColumn("_before", before).withColumn("_after", after).withColumn("_mark", is_mark)
    gap = lambda c: F.abs(F.col(at) - F.col(f"{c}.t"))
    pick = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    return both.filter(~F.col("_mark")).withColumn("nearest", pick["id"]).drop("_before", "_after", "_mark")


def matched_counts(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Multiset match and difference: how many of each key pair off one to one, and how many are left over."""
    a = left.groupBy(*key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*key).agg(F.count("*").alias("n_right"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, key, "full_outer").select(
        *key, F.least(zero("n_left"), zero("n_right")).alias("matched"), F.greatest(zero("n_left") - zero("n_right"), F.lit(0)).alias("dropped")
    )


def carried(rows: DataFrame, by: str, order: str, value: Column, name: str) -> DataFrame:
    """Each row with the last value so far that isn't null."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def citation_numbers(cited: DataFrame) -> DataFrame:
    """Numbers of a document's cited ids in order of first appearance: ``doc, ref, number``."""
    first = cited.groupBy("doc", "ref").agg(F.min("pos").alias("pos"))
    return first.select("doc", "ref", F.row_number().over(Window.partitionBy("doc").orderBy("pos", "ref")).alias("number"))


def listed_citations(lists: DataFrame) -> DataFrame:
    """``citation_numbers`` of documents ``doc, refs`` that hold their ids as a list in order.

    A document with a row of its own is numbered where it lies; no id of it is shuffled. Documents of several rows, whose places compete, go the long way.
    """
    several = lists.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc").alias("_doc"))
    numbered = lambda rows: rows.select("doc", F.posexplode(F.array_distinct("refs")).alias("pos", "ref")).select("doc", "ref", (F.col("pos") + 1).alias("number"))
    if several.isEmpty():
        return numbered(lists)
    of_several = F.col("doc").eqNullSafe(F.col("_doc"))
    parted = lists.join(several, of_several, "left_semi")
    return numbered(lists.join(several, of_several, "left_anti")).union(citation_numbers(parted.select("doc", F.posexplode("refs").alias("pos", "ref"))))


def hyphens_joined(text: Column) -> Column:
    """Words cut by a hyphen at a line's end put together before a lower-case letter."""
    return F.regexp_replace(text, r"(\p{L})-[ \t]*\n[ \t]*(\p{Ll})", "$1$2")


def tiles(heights: DataFrame, height: str, size: int = TILE_HEIGHT) -> DataFrame:
    """Bands of a fixed height that cover each row, the last one cut: ``tile, top, tile_height``."""
    tops = F.sequence(F.lit(0).cast("long"), F.greatest(F.col(height) - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))
    cut = heights.select("*", F.posexplode(tops).alias("tile", "top"))
    return cut.withColumn("tile_height", F.least(F.lit(size).cast("long"), F.col(height) - F.col("top")))


def sniffed(data: Column) -> Column:
    """Type of binary data by its first bytes."""
    head = F.hex(F.substring(data, 1, 12))
    text = F.lower(F.trim(F.decode(F.substring(data, 1, 64), "ISO-8859-1")))
    return (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").when(head.startswith("255044462D"), "application/pdf")
        .when(text.startswith("<!doctype html") | text.startswith("<html"), "text/html").when(text.startswith("<svg"), "image/svg+xml")
        .when(text.startswith("<?xml"), "application/xml").otherwise("text/plain")
    )


def annotation_upsert(stored: DataFrame, batch: DataFrame, limit: int = MAX_ANNOTATIONS) -> DataFrame:
    """Annotations replaced by (material, id), created times kept; of each material the first ``limit`` stay."""
    b = batch.select("material", "id", F.col("note").alias("new_note"), F.col("created").alias("new_created"))
    merged = stored.join(b, ["material", "id"], "full_outer").select(
        "material", "id", F.coalesce("new_note", "note").alias("note"), F.coalesce("created", "new_created").alias("created")
    )
    nth = F.row_number().over(Window.partitionBy("material").orderBy("created", "id"))
    return merged.withColumn("_nth", nth).filter(F.col("_nth") <= limit).drop("_nth")


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """The name of the first condition that holds, null if none does."""
    return F.coalesce(*[F.when(condition, name) for name, condition in reasons])


def differing(a: str, b: str, fields: list[str]) -> Column:
    """Names of the fields in which two structs differ, nulls being equal to each other."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}")), f) for f in fields]))


def batched(lengths: Column, budget: int) -> Column:
    """Number of the request that each part of an ordered list goes into: a new one where the budget would be passed."""

    def step(acc: Column, n: Column) -> Column:
        new = (acc["used"] + n > budget) & (acc["used"] > 0)
        number = acc["number"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, n).otherwise(acc["used"] + n).alias("used"), number.alias("number"), F.array_append(acc["out"], number).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("number"), F.lit([]).cast("array<int>").alias("out"))
    return F.aggregate(lengths, zero, step, lambda acc: acc["out"])
