"""Published versions of a table that is partitioned by tier and origin: data is written first, then one file makes it current.

path/data/batch=<id>/tier=<tier>/origin=<origin>/ holds rows; path/versions/<number>.json names, for each
partition of that version, the batch that holds it. Batches are never changed, so that readers who
hold a version go on reading it, and a version's partitions that a write doesn't touch stay where they are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION = ("tier", "origin")


class VersionConflictError(RuntimeError):
    """Another writer has published this version."""


@dataclass
class Version:
    number: int = 0
    #: (tier, origin) -> batch; None stands for a null tier or origin.
    batches: dict[tuple[str | None, str | None], str] = field(default_factory=dict)
    schema: str | None = None
    #: What a writer notes beside it, as the last batch number of a stream.
    notes: dict[str, str] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, path: str) -> list[int]:
    files, at = _files(spark, f"{path}/versions")
    if not files.exists(at):
        return []
    names = [x.getPath().getName() for x in files.listStatus(at)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def current(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """The newest version, or that of a number; without any an empty one."""
    numbers = _numbers(spark, path)
    if not numbers:
        return Version()
    number = numbers[-1] if number is None else number
    files, at = _files(spark, f"{path}/versions/{number:012}.json")
    stream = files.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    held = json.loads(text)
    return Version(number, {(t, o): b for t, o, b in held["partitions"]}, held["schema"], held["notes"])


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    """Make a version current by one rename, which fails if its number is taken."""
    body = {"partitions": sorted(([*k, b] for k, b in version.batches.items()), key=str), "schema": version.schema, "notes": version.notes}
    files, folder = _files(spark, f"{path}/versions")
    files.mkdirs(folder)
    _, draft = _files(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    _, final = _files(spark, f"{path}/versions/{version.number:012}.json")
    out = files.create(draft, False)
    try:
        out.write(bytearray(json.dumps(body).encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, final, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise VersionConflictError(f"version {version.number} is there") from e
        raise


def publish(rows: DataFrame, path: str, touched: DataFrame | None = None, notes: dict[str, str] | None = None, base: Version | None = None) -> Version:
    """Publish rows as the content of the touched partitions (tier, origin); of all, without `touched`.

    Partitions that aren't touched keep their files; touched ones of which rows has none are gone from
    the new version. A failure before the last step leaves the old version current. base: the
    version that the rows were made from; if another has been published since, VersionConflictError.
    """
    spark = rows.sparkSession
    base = current(spark, path) if base is None else base
    keys = None if touched is None else {(r.tier, r.origin) for r in touched.select(*PARTITION).distinct().collect()}  # a row a partition
    own = rows
    if touched is not None:
        marks = touched.select(*PARTITION).distinct()
        own = rows.join(F.broadcast(marks), [F.equal_null(rows[c], marks[c]) for c in PARTITION], "left_semi")
    batch = uuid.uuid4().hex
    own.write.partitionBy(*PARTITION).parquet(f"{path}/data/batch={batch}")
    held = {} if keys is None else {k: b for k, b in base.batches.items() if k not in keys}
    written = _read(spark, path, [f"{path}/data/batch={batch}"], own.schema.json()).select(*PARTITION).distinct().collect() if _any(spark, f"{path}/data/batch={batch}") else []
    schema = own.schema.json() if base.schema is None or keys is None or not held else _merged(base.schema, own)
    version = Version(base.number + 1, held | {(r.tier, r.origin): batch for r in written}, schema, notes or {})
    _commit(spark, path, version)
    return version


def _merged(schema: str, rows: DataFrame) -> str:
    """The fields of a version's schema and, after them, those that only the new rows have."""
    from pyspark.sql.types import StructType

    old = StructType.fromJson(json.loads(schema))
    return StructType(old.fields + [f for f in rows.schema.fields if f.name not in old.names]).json()


def _any(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at) and any(x.isDirectory() for x in files.listStatus(at))


def _read(spark: SparkSession, path: str, folders: list[str], schema: str) -> DataFrame:
    from pyspark.sql.types import StructType

    own = StructType.fromJson(json.loads(schema))
    return spark.read.schema(own).option("basePath", f"{path}/data").parquet(*folders).select(*own.names)


def _folder(value: str | None) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if value is None else value


def read_version(spark: SparkSession, path: str, grants: DataFrame, number: int | None = None) -> DataFrame:
    """Rows of the granted tiers in one version, the newest unless a number is given. There is no reader without grants.

    Folders of other tiers aren't listed, let alone read. A frame that was made before a later
    version was published goes on reading its own.
    """
    version = current(spark, path, number)
    tiers = {r.tier for r in grants.select("tier").distinct().collect()}  # a row a tier
    chosen = {k: b for k, b in version.batches.items() if k[0] in tiers}
    if version.schema is None:
        raise FileNotFoundError(f"no version in {path}")
    if not chosen:
        from pyspark.sql.types import StructType

        return spark.createDataFrame([], StructType.fromJson(json.loads(version.schema)))
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    folders = [f"{path}/data/batch={b}/tier={escaped.escapePathName(_folder(t))}/origin={escaped.escapePathName(_folder(o))}" for (t, o), b in sorted(chosen.items(), key=str)]
    return _read(spark, path, folders, version.schema)


def expire(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest `keep` versions, and the batches that none of these names; the number of batches deleted. Not beside a writer."""
    numbers = _numbers(spark, path)
    kept = [current(spark, path, n) for n in numbers[-keep:]]
    for n in numbers[:-keep]:
        files, at = _files(spark, f"{path}/versions/{n:012}.json")
        files.delete(at, False)
    named = {b for v in kept for b in v.batches.values()}
    files, at = _files(spark, f"{path}/data")
    gone = 0
    for found in files.listStatus(at) if files.exists(at) else []:
        if found.getPath().getName().removeprefix("batch=") not in named:
            files.delete(found.getPath(), True)
            gone += 1
    return gone
