"""Benchmark decontamination with DataFrame expressions only.

Words are runs of digits, a-z and anything beyond ASCII, after lower-casing A-Z. A window is
``WIDTH`` consecutive words of an item; an item with fewer words is one window as a whole.

The documents are scanned once: each row turns its text into words, hashes every run of words
as long as a window and keeps the runs whose hash is in the set of window hashes. That set goes
to the executors as a literal set inside the plan, after its size has been checked; beyond
``LITERAL_LIMIT`` windows the hashed runs meet a broadcast table of hashes where they lie, beyond ``BROADCAST_LIMIT`` in a shuffled join. Hits are
few; they are verified word by word against the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papershed.llm.common import ascii_lower, stored

WIDTH = 10
#: Most window hashes that travel inside the plan: 8 bytes each in the plan, some 50 in memory.
LITERAL_LIMIT = 200_000
#: Most window hashes that are broadcast to the exploded runs, some 200 MB; beyond that both sides are shuffled.
BROADCAST_LIMIT = 4_000_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    parts = F.split(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, " "), " ")
    return F.filter(parts, lambda w: w != "")


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, width, window, hash``: the distinct windows of every item."""
    listed = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(WIDTH))
    starts = F.sequence(F.lit(1), F.size("w") - width + 1)
    return (
        listed.select("item_id", "w", width.alias("width"), F.explode(starts).alias("at"))
        .select("item_id", "width", F.slice("w", F.col("at"), F.col("width")).alias("run"))
        .select("item_id", "width", F.array_join("run", " ").alias("window"), F.xxhash64("run").alias("hash"))
        .distinct()
    )


def _runs(width: int) -> Column:
    """All runs of so many words of ``w``: struct(at, width, hash)."""
    last = F.size("w") - (width - 1)
    return F.transform(
        F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")),
        lambda at: F.struct(at.alias("at"), F.lit(width).alias("width"), F.xxhash64(F.slice("w", at, width)).alias("hash")),
    )


def _among(hashes: list[int]):
    return lambda run: run["hash"].isin(hashes)


def _with_text(runs: Column) -> Column:
    return F.transform(
        runs,
        lambda r: F.struct(r["at"].alias("at"), r["width"].alias("width"), r["hash"].alias("hash"),
                           F.array_join(F.slice("w", r["at"], r["width"]), " ").alias("window")),
    )


def scan(docs: DataFrame, windows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, ``n_words``, and ``hits``: runs with a window's hash.

    ``hits`` is array<struct<at, width, hash, window>>, not verified yet.
    """
    by_width = {r["width"]: r["n"] for r in windows.groupBy("width").agg(F.countDistinct("hash").alias("n")).collect()}
    listed = docs.select(*keep, words(F.col("text")).alias("w"))
    n_words = F.size("w").cast("long").alias("n_words")
    if sum(by_width.values()) <= LITERAL_LIMIT:
        found = []
        for width in sorted(by_width):
            hashes = [r["hash"] for r in windows.filter(F.col("width") == width).select("hash").distinct().collect()]
            found.append(F.filter(_runs(width), _among(hashes)))
        hits = F.concat(*found) if found else F.array().cast("array<struct<at:int,width:int,hash:bigint>>")
        return listed.select(*keep, "w", n_words, hits.alias("runs")).select(*keep, "n_words", _with_text(F.col("runs")).alias("hits"))
    rows = stored(listed.select(*keep, n_words, "w", F.monotonically_increasing_id().alias("row")))
    runs = rows.select("row", F.explode(F.concat(*[_runs(width) for width in sorted(by_width)])).alias("r"))
    known = windows.select("hash", "width").distinct()
    met = runs.join(F.broadcast(known) if sum(by_width.values()) <= BROADCAST_LIMIT else known, (F.col("r.hash") == F.col("hash")) & (F.col("r.width") == F.col("width")), "left_semi")
    gathered = met.groupBy("row").agg(F.collect_list("r").alias("runs"))
    none = F.array().cast(gathered.schema["runs"].dataType)
    return rows.join(gathered, "row", "left").withColumn("runs", F.coalesce("runs", none)).select(*keep, "n_words", _with_text(F.col("runs")).alias("hits"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items, spans``.

    ``spans`` are the hit word intervals (first, last; counted from 1), merged where they
    overlap or touch; ``items`` the ids of items with a window in the document, sorted as strings. A null
    or wordless text has no words and no hit; a wordless item has no window; with no items
    nothing is hit. Repeated rows keep a row each. Other columns are ignored.
    """
    windows = stored(item_windows(items.select("item_id", "text")))
    scanned = stored(scan(docs, windows, ["doc_id"]).withColumn("row", F.monotonically_increasing_id()))
    hits = (
        scanned.filter(F.size("hits") > 0)
        .select("row", F.explode("hits").alias("h"))
        .join(windows, (F.col("h.hash") == F.col("hash")) & (F.col("h.width") == windows["width"]) & (F.col("h.window") == windows["window"]))
        .select("row", F.col("h.at").alias("first"), (F.col("h.at") + F.col("h.width") - 1).alias("last"), "item_id")
    )
    by_row = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    reach = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("first", "last")
    intervals = (
        hits.groupBy("row", "first").agg(F.max("last").alias("last"))
        .withColumn("reached", F.coalesce(F.max("last").over(reach), F.lit(-1)))
        .withColumn("span", F.sum((F.col("first") > F.col("reached") + 1).cast("int")).over(upto))
        .groupBy("row", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("row").agg(
            F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"),
            F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"),
        )
    )
    return (
        scanned.select("row", "doc_id", "n_words")
        .join(intervals, "row", "left")
        .join(by_row, "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"),
        )
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without any verified window of an item, all their columns as they were."""
    windows = stored(item_windows(items.select("item_id", "text")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    # A filter on hits must not move below the scan, where the words would be made anew for every run: the row number holds it.
    kept = scan(docs.select(whole, "text"), windows, ["doc"]).withColumn("row", F.monotonically_increasing_id())
    known = windows.select("window").distinct()
    if known.count() <= LITERAL_LIMIT:
        texts = [r["window"] for r in known.collect()]
        verified = F.exists("hits", lambda h: h["window"].isin(texts)) if texts else F.lit(False)
        return kept.filter(~verified & (F.col("row") >= 0)).select("doc.*")
    rows = stored(kept)
    dirty = rows.select("row", F.explode("hits").alias("h")).join(known, F.col("h.window") == F.col("window"), "left_semi")
    return rows.join(dirty.select("row").distinct(), "row", "left_anti").select("doc.*")
