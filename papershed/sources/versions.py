"""Tables in versions: data is written beside what is there, and one small manifest, renamed into place, makes it the table.

A manifest names for each bucket the folder that holds it. A writer that is lost half way leaves files that no manifest
names, and the old version stays as it was; readers pin a version and see no later one. Of two writers from one version the second
to rename finds the name taken and fails. Keys are dealt over buckets whose number follows the table's size, and a save writes
only the buckets that its rows touch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of a bucket, in the mean; at twice as many a table gets more buckets. Folders of earlier versions from which a save writes the whole table.
ROWS, FOLDERS = 1_000_000, 16


class Conflict(RuntimeError):
    """Another writer made the same version first."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdecimal())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the table at ``path``, oldest first; none if there is no table."""
    return _manifests(spark, path)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """``version, schema, buckets, folders`` (bucket to folder), ``rows`` of a version, or of the newest; None if there is no table."""
    known = _manifests(spark, path)
    if not known:
        return None
    number = known[-1] if version is None else version
    if number not in known:
        raise ValueError(f"{path} has no version {number}")
    (line,) = [r[0] for r in spark.read.text(f"{path}/manifests/{number}.json").collect()]
    return json.loads(line)


def _commit(spark: SparkSession, path: str, made: dict) -> None:
    fs, folder = _fs(spark, f"{path}/manifests")
    fs.mkdirs(folder)
    _, draft = _fs(spark, f"{path}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    _, target = _fs(spark, f"{path}/manifests/{made['version']}.json")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    rename = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = getattr(spark._jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), rename)
    except Exception as e:
        fs.delete(draft, False)
        raise Conflict(f"version {made['version']} of {path} exists already") from e


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def _rows(spark: SparkSession, path: str, made: dict, buckets: set[int] | None = None) -> DataFrame:
    """The rows of a version, or those of some buckets; a folder is read for the buckets that the version takes from it."""
    schema = StructType.fromJson(made["schema"])
    by: dict[str, list[int]] = {}
    for bucket, folder in made["folders"].items():
        if buckets is None or int(bucket) in buckets:
            by.setdefault(folder, []).append(int(bucket))
    out = None
    for folder, held in sorted(by.items()):
        part = spark.read.schema(StructType([*schema, StructField("bucket", IntegerType())])).parquet(f"{path}/{folder}").filter(F.col("bucket").isin(held))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))


def load(spark: SparkSession, path: str, version: int | None = None, key: tuple[str, str] | None = None) -> DataFrame:
    """The rows of a version (the newest if none is named); with ``key`` (column, value) only its bucket is read."""
    made = manifest(spark, path, version)
    if made is None:
        raise ValueError(f"there is no table at {path}")
    if key is None:
        return _rows(spark, path, made).drop("bucket")
    n = made["buckets"]
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(key[1])), F.lit(n))).first()[0]
    return _rows(spark, path, made, {int(bucket)}).filter(F.col(key[0]) == key[1]).drop("bucket")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: the last by ``order``, of equal ones that with the greatest digest, so that a save run again gives the same."""
    digest = F.xxhash64(*[F.col(f"`{c}`").cast("string") if rows.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in rows.columns])
    last = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("_digest"))
    return rows.withColumn("_digest", digest).withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_digest", "_nth")


def save(rows: DataFrame, path: str, key: list[str], order: str = "saved_at", rows_per_bucket: int = ROWS) -> int | None:
    """Puts rows over the stored ones with the same key as a new version; returns its number, None if there was nothing to save."""
    spark = rows.sparkSession
    old = manifest(spark, path)
    n_new = rows.count()
    if not n_new and old:
        return None
    n, rows_then = (old["buckets"], old["rows"] + n_new) if old else (1, n_new)
    if not old or rows_then > 2 * n * rows_per_bucket:
        while n * rows_per_bucket < rows_then:
            n *= 2
    new = rows.withColumn("bucket", _bucket(key[0], n))
    anew = not old or n != old["buckets"] or len(set(old["folders"].values())) >= FOLDERS
    touched = set(range(n)) if anew else {r["bucket"] for r in new.select("bucket").distinct().collect()}
    if old:
        stored = _rows(spark, path, old, None if anew else touched).withColumn("bucket", _bucket(key[0], n))
        new = stored.unionByName(new, allowMissingColumns=True)
    return _written(latest(new, key, order), path, old, n, touched)


def replace(rows: DataFrame, path: str, key: str, chosen: DataFrame | None = None) -> int:
    """An export. Without ``chosen`` the rows become the table; else all rows of the keys in ``chosen`` go and ``rows`` come in their place."""
    spark = rows.sparkSession
    old = manifest(spark, path)
    if chosen is not None and old:
        kept = _rows(spark, path, old).drop("bucket").join(chosen.select(key).distinct(), key, "left_anti")
        rows = kept.unionByName(rows, allowMissingColumns=True)
    n = old["buckets"] if old else 1
    return _written(rows.withColumn("bucket", _bucket(key, n)), path, old, n, set(range(n)))


def _written(rows: DataFrame, path: str, old: dict | None, n: int, touched: set[int]) -> int:
    """Writes the buckets ``touched`` into a folder of their own and commits the version that has them."""
    spark, folder, number = rows.sparkSession, f"data-{uuid.uuid4().hex}", (old["version"] + 1 if old else 1)
    schema = json.loads(rows.drop("bucket").schema.json())
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    folders = {**(old["folders"] if old and old["buckets"] == n else {}), **{str(b): folder for b in sorted(touched)}}
    made = {"version": number, "schema": schema, "buckets": n, "folders": folders, "rows": 0}
    made["rows"] = _rows(spark, path, made).count()
    _commit(spark, path, made)
    return number
