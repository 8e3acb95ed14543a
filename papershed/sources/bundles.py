"""Files of evaluation: zip bundles, catalogs with their snapshots, and results of judges.

Files are read by Spark's own readers (``binaryFile``, ``json``), so they may lie wherever Spark reads from; archives are taken apart
where their bytes are, one row a file. What must be there and isn't is an error, never an empty table.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What no bundle is asked for; views by the corpus that their reports go to; the tag of imported cases; lengths.
LEFT_OUT, LEFT_OUT_NAME = "__MACOSX/", ".DS_Store"
WEB_VIEWS, PDF_VIEWS = ("web",), ("pdf", "text")
MARKER, LONGEST_SLUG = "feedback", 60
#: Bytes of one entry, unpacked, beyond which an archive is refused: a small archive may unpack to anything.
LARGEST_ENTRY = 256 << 20
END, ZIP64_COUNT, ZIP64_AT = b"PK\x05\x06", 0xFFFF, 0xFFFFFFFF


class BundleError(ValueError):
    """Why an archive is refused."""


def _checked_name(name: str) -> str:
    """A name inside the archive's folder."""
    parts = name.replace("\\", "/").split("/")
    if name.startswith(("/", "\\")) or ".." in parts or re.match(r"[A-Za-z]:", name) or "\0" in name:
        raise BundleError(f"entry {name!r} leads out of the archive")
    return name


def zip_files(data: bytes) -> list[tuple[str, bytes]]:
    """The files of a zip archive by its central directory, read before any content; every file's CRC is checked.

    Refused: zip64, encryption, methods but stored and deflate, names that lead out of the archive, two files of one name, and entries whose size or CRC isn't
    the one that the directory says. Folders and what archivers add are left out.
    """
    at = data.rfind(END, max(0, len(data) - 65_557))
    if at < 0:
        raise BundleError("no zip archive")
    if int.from_bytes(data[at + 10 : at + 12], "little") == ZIP64_COUNT or int.from_bytes(data[at + 16 : at + 20], "little") == ZIP64_AT:
        raise BundleError("zip64 archives are not supported")
    found: dict[str, bytes] = {}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for entry in archive.infolist():
                name = _checked_name(entry.orig_filename)
                if name.endswith("/") or name.startswith(LEFT_OUT) or name.rsplit("/", 1)[-1] == LEFT_OUT_NAME:
                    continue
                if entry.flag_bits & 1:
                    raise BundleError(f"entry {name!r} is encrypted")
                if entry.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise BundleError(f"entry {name!r} has an unknown method")
                if entry.file_size > LARGEST_ENTRY:
                    raise BundleError(f"entry {name!r} is too large")
                if name in found:
                    raise BundleError(f"entry {name!r} is there twice")
                found[name] = archive.read(entry)
    except BundleError:
        raise
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, OSError, ValueError, struct.error) as e:
        raise BundleError(f"the archive is damaged: {e}") from e
    return list(found.items())


def bundle_root(names: list[str]) -> str:
    """Where a bundle's report lies: at the root, or in its one top folder."""
    tops = {n.split("/")[0] for n in names}
    if "report.json" in names:
        return ""
    if len(tops) == 1 and f"{next(iter(tops))}/report.json" in names:
        return f"{next(iter(tops))}/"
    raise BundleError("there is no report.json at its root or in its one folder")


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, content`` of all files below ``path`` with names like ``pattern``; an error if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"{path} has no {pattern}")
    return files.select("path", "content")


def bundle_entries(files: DataFrame, key: str = "path") -> DataFrame:
    """``key, name, bytes, problem`` of archives ``key, content``: a row for each file; for an archive that is refused one row with its problem."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    rows = [(n, b, None) for n, b in zip_files(batch.column("content")[k].as_py() or b"")]
                except BundleError as e:
                    rows = [(None, None, str(e))]
                names, bodies, problems = zip(*rows) if rows else ((), (), ())
                arrays = [pa.array([batch.column(key)[k].as_py()] * len(rows), batch.schema.field(key).type), pa.array(names, pa.string()), pa.array(bodies, pa.binary()), pa.array(problems, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [key, "name", "bytes", "problem"])

    return files.select(key, "content").mapInArrow(run, f"{key} {kind}, name string, bytes binary, problem string")


def slug_of(url: str) -> str:
    """A name for a URL: host without www. and path, letters and digits with single hyphens, cut at a bounded length."""
    parts = urlsplit(url)
    name = unquote(parts.path.rsplit("/", 1)[-1]).removesuffix(".pdf") if parts.scheme == "file" else (parts.netloc.removeprefix("www.") + unquote(parts.path))
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")[:LONGEST_SLUG].rstrip("-")


CASE = "corpus string, slug string, url string, tags array<string>, problem string"


def feedback_cases(files: DataFrame, key: str = "path") -> DataFrame:
    """``key, corpus, slug, url, tags, problem`` of feedback bundles ``key, content``: the case that each would add, or why it adds none."""
    kind = files.schema[key].dataType.simpleString()

    def case(data: bytes) -> tuple:
        try:
            entries = dict(zip_files(data))
            root = bundle_root(list(entries))
            try:
                report = json.loads(entries[f"{root}report.json"].decode("utf-8"))
            except ValueError as e:
                raise BundleError(f"report.json is no JSON: {e}") from e
            url, view = (report.get(k) if isinstance(report, dict) else None for k in ("url", "view"))
            if not isinstance(url, str) or not url:
                raise BundleError("report.json has no url")
            corpus = "web" if view in WEB_VIEWS else "pdf" if view in PDF_VIEWS else None
            if corpus is None:
                raise BundleError(f"a report on the view {view!r} belongs to no corpus")
            slug = slug_of(url)
            if not slug:
                raise BundleError("its url gives no slug")
            kinds = [k for k in report.get("kinds") or [] if isinstance(k, str)]
            return corpus, slug, url, list(dict.fromkeys([*kinds, MARKER])), None
        except BundleError as e:
            return None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(case(c.as_py() or b"") for c in batch.column("content")))) or [()] * 5
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(rows, types))], [key, *(c.split()[0] for c in CASE.split(", "))])

    return files.select(key, "content").mapInArrow(run, f"{key} {kind}, {CASE}")


def imported(catalog: DataFrame, cases: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """(catalog rows to append, ``key, problem`` of cases that are refused): a slug that the catalog has, or an earlier case took, is refused."""
    good = cases.filter("problem is null").select(key, "slug", "url", "tags")
    first = good.groupBy("slug").agg(F.min(key).alias("_first"))
    marked = good.join(first, "slug").join(catalog.select("slug", F.lit(True).alias("_known")), "slug", "left")
    taken = F.coalesce("_known", F.lit(False)) | (F.col(key) != F.col("_first"))
    refused = marked.filter(taken).select(key, F.concat(F.lit("slug "), "slug", F.lit(" already exists")).alias("problem"))
    return marked.filter(~taken).select("slug", "url", "tags"), cases.filter("problem is not null").select(key, "problem").union(refused)


# Catalogs and results


def catalog(spark: SparkSession, path: str, schema: str = "slug string, url string, framework string, tags array<string>") -> DataFrame:
    """The entries of a catalog, one JSON array, in their order (``place``); a broken or missing file is an error."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.from_json("value", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>", {"mode": "FAILFAST"}).alias("e"))
    return entries.select(F.posexplode("e").alias("place", "entry")).select("place", "entry.*")


def snapshots(entries: DataFrame, files: DataFrame) -> DataFrame:
    """``entries`` that have a snapshot, with its ``html``: files ``path, content`` named ``<slug>/page.html.gz``. Entries without one are left out."""
    slug = F.regexp_extract("path", r"([^/]+)/page\.html\.gz$", 1)
    named = files.select(slug.alias("slug"), "content").filter("slug <> ''")
    return entries.join(named, "slug").withColumn("html", unzipped(F.col("content"))).drop("content")


def unzipped(content: Column) -> Column:
    """The bytes of a gzip file; null if it isn't one."""
    def of(data: bytes | None) -> bytes | None:
        try:
            return gzip.decompress(bytes(data)) if data is not None else None
        except (OSError, EOFError, zlib.error):
            return None

    @F.pandas_udf("binary")
    def unzip(values: pd.Series) -> pd.Series:
        return pd.Series([of(v) for v in values], dtype=object)

    return unzip(content)


def unknown_entries(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Entries whose URL no known material has: what an import would add."""
    return entries.join(known.select("url").distinct(), "url", "left_anti")


def judge_results(spark: SparkSession, path: str, schema: str, whole: bool = True) -> DataFrame:
    """All result files below ``path``, one JSON object each (or, not ``whole``, one a line); no file, a broken one or one without its slug is an error."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=whole)
    if files.isEmpty():
        raise FileNotFoundError(f"{path} has no results")
    row = files.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return row.withColumn("slug", F.coalesce("slug", F.raise_error("a result has no slug").cast("string")))
