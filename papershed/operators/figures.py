"""Regions of figures and tables on pages of lines: what text can't carry, to be cropped as a picture.

A caption names the region above it (a figure) or below it (a table) that no body text enters; four or more evenly spaced rows of
several cells are a table without a caption too. Both are sweeps over a page's lines from the top: the line that ends a region is the
last or the next of its kind in a window, and grids are runs of rows. Lines are those of ``layout.placed_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papershed.functions.text import let
from papershed.operators.layout import CAPTION

# Shares of the page and of sizes.
LEAST_REGION, PAGE_MARGIN, PADDING = 0.06, 0.06, 0.02
BODY_TOLERANCE, BODY_WIDTH, CAPTION_LEADING, BASELINE, HEADING = 0.08, 0.5, 1.6, 0.4, 1.1
LEAST_ROWS, SPACING = 4, 0.3


def caption_kind(text: Column) -> Column:
    """"figure" or "table" for the first line of a caption, else null."""
    word = F.lower(F.regexp_extract(text, CAPTION, 1))
    return F.when(word == "", None).when(word.isin("table", "表"), "table").otherwise("figure")


def _scans(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each line in the scan of its own column and in that of the whole page (-1), with what bounds a region."""
    own = Window.partitionBy("doc", "page", "column")
    beside = own.orderBy("baseline").rangeBetween(-1, 1)
    known = lines.join(sizes, "doc").withColumn("kind", caption_kind(F.col("text"))).withColumn("col_left", F.min("x").over(own)).withColumn("col_right", F.max("right").over(own))
    alone = F.count("*").over(beside) == 1
    prose = F.col("text").rlike(r"\p{L}{2,}.*\s.*\p{L}{2,}")
    body = F.col("kind").isNull() & (F.abs(F.col("size") - F.col("body_size")) <= BODY_TOLERANCE * F.col("body_size")) & (F.col("right") - F.col("x") >= BODY_WIDTH * (F.col("col_right") - F.col("col_left"))) & alone & prose
    marked = known.withColumn("bound", body | F.col("kind").isNotNull()).withColumn("head", F.col("size") > HEADING * F.col("body_size"))
    return marked.withColumn("scan", F.explode(F.array_distinct(F.array(F.col("column"), F.lit(-1)))))


def caption_regions(lines: DataFrame, sizes: DataFrame, page_height: float) -> DataFrame:
    """``doc, page, kind, x, y, w, h, caption``: the region of each caption; ``sizes`` has ``doc, body_size``.

    A figure lies above its caption, or else below; a table below, or else above; a region has 6 percent of the page's height at least. It
    ends at body text, another caption, a heading below, or the page's margin. Lines that follow a caption closely are part of it.
    """
    scans = _scans(lines, sizes)
    order = Window.partitionBy("doc", "page", "scan").orderBy("y", "x")
    gap = F.col("baseline") - F.lag("baseline").over(order)
    follows = F.col("kind").isNull() & (gap <= CAPTION_LEADING * F.greatest("size", F.lag("size").over(order))) & (F.abs(F.col("size") - F.lag("size").over(order)) <= BODY_TOLERANCE * F.col("size"))
    blocks = scans.withColumn("block", F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(order))
    in_block = Window.partitionBy("doc", "page", "scan", "block").orderBy("y", "x")
    of_caption = F.first("kind").over(in_block).isNotNull()
    said = blocks.withColumn("of_caption", of_caption)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    stops = F.col("bound") & ~(F.col("of_caption") & F.col("kind").isNull())
    swept = (
        said.withColumn("above", F.max(F.when(stops, F.col("bottom"))).over(before))
        .withColumn("below", F.min(F.when((stops | F.col("head")), F.col("y"))).over(after))
        .withColumn("end", F.max("bottom").over(Window.partitionBy("doc", "page", "scan", "block")))
        .withColumn("page_left", F.min("x").over(Window.partitionBy("doc", "page", "scan")))
        .withColumn("page_right", F.max("right").over(Window.partitionBy("doc", "page", "scan")))
    )
    asked = swept.filter(F.col("kind").isNotNull() & (F.col("scan") == F.col("column")))
    top, foot = F.coalesce("above", F.lit(PAGE_MARGIN * page_height)), F.coalesce("below", F.lit((1 - PAGE_MARGIN) * page_height))
    upper, lower = F.struct(top.alias("y"), (F.col("y") - top).alias("h")), F.struct(F.col("end").alias("y"), (foot - F.col("end")).alias("h"))
    least = LEAST_REGION * page_height
    first, second = F.when(F.col("kind") == "table", lower).otherwise(upper), F.when(F.col("kind") == "table", upper).otherwise(lower)
    chosen = F.when(first["h"] >= least, first).when(second["h"] >= least, second)
    found = asked.withColumn("region", chosen).filter("region is not null")
    return found.select("doc", "page", "kind", F.col("page_left").alias("x"), F.col("region.y").alias("y"), (F.col("page_right") - F.col("page_left")).alias("w"), F.col("region.h").alias("h"), F.col("text").alias("caption"))


def grid_regions(lines: DataFrame) -> DataFrame:
    """``doc, page, kind, x, y, w, h, n_rows``: four or more rows in a column, several cells each on one baseline, at even distances."""
    column = Window.partitionBy("doc", "page", "column").orderBy("baseline", "x")
    apart = F.abs(F.col("baseline") - F.lag("baseline").over(column)) > BASELINE * F.greatest("size", F.lag("size").over(column))
    rows = lines.withColumn("row", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(column)).groupBy("doc", "page", "column", "row").agg(
        F.count("*").alias("cells"), F.min("baseline").alias("baseline"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("right").alias("right"), F.max("bottom").alias("bottom")
    )
    order = Window.partitionBy("doc", "page", "column").orderBy("row")
    several = F.col("cells") >= 2
    runs = rows.withColumn("run", F.sum((several != F.lag(several, 1).over(order)).cast("int")).over(order)).filter(several)
    grouped = runs.withColumn("run", F.coalesce("run", F.lit(0))).groupBy("doc", "page", "column", "run").agg(
        F.array_sort(F.collect_list("baseline")).alias("b"), F.count("*").alias("n_rows"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("right").alias("right"), F.max("bottom").alias("bottom")
    )

    def even(steps: Column) -> Column:
        middle = F.get(F.array_sort(steps), F.floor(F.size(steps) / 2).cast("int"))
        return let(middle, lambda m: (m > 0) & F.forall(steps, lambda d: F.abs(d - m) <= SPACING * m))

    steps = F.zip_with(F.slice("b", 2, F.greatest(F.size("b") - 1, F.lit(1))), F.slice("b", F.lit(1), F.greatest(F.size("b") - 1, F.lit(1))), lambda a, z: a - z)
    fine = grouped.filter(F.col("n_rows") >= LEAST_ROWS).filter(let(steps, even))
    return fine.select("doc", "page", F.lit("table").alias("kind"), "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "n_rows")


def padded(regions: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """Regions a fiftieth of the page larger on every side, kept inside the page: what a crop takes."""
    dx, dy = PADDING * page_width, PADDING * page_height
    x, y = F.greatest(F.lit(0.0), F.col("x") - dx), F.greatest(F.lit(0.0), F.col("y") - dy)
    right, bottom = F.least(F.lit(page_width), F.col("x") + F.col("w") + dx), F.least(F.lit(page_height), F.col("y") + F.col("h") + dy)
    return regions.withColumns({"x": x, "y": y, "w": right - x, "h": bottom - y})


def figure_regions(lines: DataFrame, sizes: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """All regions of a document's pages; a grid that a caption's region covers is that region."""
    captioned = caption_regions(lines, sizes, page_height)
    grids = grid_regions(lines)
    same = [(grids[c] == captioned[c]) for c in ("doc", "page")]
    inside = (grids["y"] >= captioned["y"] - 1) & (grids["y"] + grids["h"] <= captioned["y"] + captioned["h"] + 1) & (grids["x"] >= captioned["x"] - 1) & (grids["x"] + grids["w"] <= captioned["x"] + captioned["w"] + 1)
    loose = grids.join(captioned, [*same, inside], "left_anti")
    names = ["doc", "page", "kind", "x", "y", "w", "h"]
    every = captioned.select(*names, "caption").unionByName(loose.select(*names, F.lit(None).cast("string").alias("caption")))
    return padded(every, page_width, page_height)
