"""Regions on pages that a glance can check."""

from papershed.operators import figures as G

LINE = "doc int, page int, column int, x double, y double, right double, bottom double, baseline double, size double, text string"


def lines(spark, rows):
    """(column, x, right, top, size, text) of lines ten points high, on page 0 of document 1."""
    return spark.createDataFrame([(1, 0, c, float(x), float(y), float(r), y + 10.0, y + 8.0, float(s), t) for c, x, r, y, s, t in rows], LINE)


def sizes(spark):
    return spark.createDataFrame([(1, 10.0)], "doc int, body_size double")


def body(column, left, tops, width=200):
    return [(column, left, left + width, y, 10, "words of the body text that go on") for y in tops]


def found(frame):
    return sorted((r["kind"], r["x"], r["y"], r["w"], r["h"]) for r in frame.collect())


def test_a_figure_above_its_caption_and_a_table_below(spark):
    rows = [*body(0, 50, range(60, 200, 12)), (0, 50, 250, 400, 9, "Figure 3: Seen from above"), (0, 50, 180, 411, 9, "and from below"), *body(0, 50, range(440, 600, 12))]
    rows += [*body(1, 300, range(60, 150, 12)), (1, 300, 500, 170, 9, "Table II. What was counted"), (1, 310, 340, 200, 9, "12"), (1, 400, 430, 200, 9, "13"), *body(1, 300, range(330, 500, 12))]
    page = lines(spark, rows)
    assert found(G.caption_regions(page, sizes(spark), 800.0)) == [("figure", 50, 202, 200, 198), ("table", 300, 180, 200, 150)]


def test_the_other_side_counts_where_there_is_no_room(spark):
    rows = [*body(0, 50, range(60, 200, 12)), (0, 50, 250, 205, 9, "Fig. 1. Below"), *body(0, 50, [500, 512])]
    assert found(G.caption_regions(lines(spark, rows), sizes(spark), 800.0)) == [("figure", 50, 215, 200, 285)]
    rows = [*body(0, 50, range(60, 200, 12)), (0, 50, 250, 205, 9, "Fig. 1. Nowhere"), *body(0, 50, [230, 242])]
    assert found(G.caption_regions(lines(spark, rows), sizes(spark), 800.0)) == []  # less than 6 percent of the page
    top = [(0, 50, 250, 400, 9, "图 2：上"), *body(0, 50, [430])]
    assert found(G.caption_regions(lines(spark, top), sizes(spark), 800.0)) == [("figure", 50, 48, 200, 352)]  # from the margin


def test_headings_end_a_table_and_captions_end_each_other(spark):
    rows = [*body(0, 50, [60, 72]), (0, 50, 250, 90, 9, "Table 1: A"), (0, 50, 150, 300, 14, "2 Next part"), (0, 50, 250, 520, 9, "Figure 2: B"), *body(0, 50, [540])]
    assert found(G.caption_regions(lines(spark, rows), sizes(spark), 800.0)) == [("figure", 50, 100, 200, 420), ("table", 50, 100, 200, 200)]


def test_grids(spark):
    grid = [(0, x, x + 40, y, 9, "7") for y in (100, 120, 140, 161) for x in (50, 120, 200)]
    assert found(G.grid_regions(lines(spark, [*body(0, 50, [60]), *grid, *body(0, 50, [200])]))) == [("table", 50, 100, 190, 71)]
    assert found(G.grid_regions(lines(spark, grid[:9]))) == []  # three rows
    uneven = [(0, x, x + 40, y, 9, "7") for y in (100, 120, 180, 200) for x in (50, 120)]
    assert found(G.grid_regions(lines(spark, uneven))) == []
    assert found(G.grid_regions(lines(spark, [*grid[:6], *body(0, 50, [130]), *grid[6:]]))) == []  # prose between


def test_all_regions_of_a_page(spark):
    grid = [(0, x, x + 40, y, 9, "7") for y in (300, 320, 340, 360) for x in (50, 120)]
    loose = [(1, x, x + 40, y, 9, "8") for y in (300, 320, 340, 360) for x in (300, 380)]
    rows = [*body(0, 50, [60, 72]), (0, 50, 250, 280, 9, "Table 1: A"), *grid, *body(0, 50, [400]), *body(1, 300, [60, 400]), *loose]
    regions = G.figure_regions(lines(spark, rows), sizes(spark), 600.0, 800.0)
    assert {(r["kind"], r["caption"]) for r in regions.collect()} == {("table", "Table 1: A"), ("table", None)}
    assert all(r["x"] >= 0 and r["x"] + r["w"] <= 600 for r in regions.collect())
    assert G.figure_regions(lines(spark, rows).limit(0), sizes(spark), 600.0, 800.0).count() == 0
