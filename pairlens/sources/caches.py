"""Cache tables for embeddings and annotations.

Embeddings never change once made. Their table is bucketed by the text's key, so that joining it,
or asking what it lacks, moves the keys of the other side and none of its vectors.

Annotations may be asked again. Their table is a list of commits: a job writes its rows to a folder
of its own and then publishes the folder in the next numbered manifest, which only one writer can
create. Readers see published folders only, and the latest answer for a key wins. A job that fails
leaves a folder that nothing lists. Many commits are compacted into one under a new manifest; commits
published meanwhile stay behind it.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFESTS = "_commits"
COMMIT = "commit"
MANY_COMMITS = 64


def _hadoop(spark: SparkSession, path: str):
    """(file system, path object) of a path."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, found = _hadoop(spark, path)
    return fs.exists(found)


def _read(spark: SparkSession, path: str) -> str:
    fs, found = _hadoop(spark, path)
    stream = fs.open(found)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


# Commits


def _local(spark: SparkSession, path: str) -> str | None:
    """The plain path, if it is one of the local file system."""
    fs, found = _hadoop(spark, path)
    return found.toUri().getPath() if fs.getScheme() == "file" else None


def _manifests(spark: SparkSession, path: str) -> list[int]:
    folder = f"{path}/{MANIFESTS}"
    if not table_exists(spark, folder):
        return []
    fs, found = _hadoop(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(found)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def commits(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of the latest manifest (0 if there is none) and the commits it lists, oldest first."""
    numbers = _manifests(spark, path)
    if not numbers:
        return 0, []
    return numbers[-1], json.loads(_read(spark, f"{path}/{MANIFESTS}/{numbers[-1]:08d}.json"))


def _create(spark: SparkSession, target: str, text: str) -> bool:
    """Create a file with its content at once; False if it is there already."""
    temporary = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
    plain = _local(spark, target)
    if plain is not None:
        os.makedirs(os.path.dirname(plain), exist_ok=True)
        aside = f"{os.path.dirname(plain)}/.{uuid.uuid4().hex}"
        with open(aside, "w") as f:
            f.write(text)
        try:
            os.link(aside, plain)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
    fs, aside = _hadoop(spark, temporary)
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        return bool(fs.rename(aside, _hadoop(spark, target)[1]))  # fails if the target exists
    finally:
        fs.delete(aside, False)


def publish(spark: SparkSession, path: str, change: Callable[[list[str]], list[str]]) -> list[str]:
    """Replace the list of commits by ``change`` of it, whatever other writers publish meanwhile."""
    while True:
        number, listed = commits(spark, path)
        new = change(listed)
        if _create(spark, f"{path}/{MANIFESTS}/{number + 1:08d}.json", json.dumps(new)):
            return new


def _write_commit(rows: DataFrame, path: str, partition: list[str]) -> str:
    name = uuid.uuid4().hex
    rows.write.partitionBy(*partition).parquet(f"{path}/{COMMIT}={name}")
    return name


def _all_versions(spark: SparkSession, path: str, schema: T.StructType, listed: list[str]) -> DataFrame:
    """Rows of the listed commits with the position of their commit in ``_order``."""
    if not listed:
        return spark.createDataFrame([], schema).withColumn("_order", F.lit(0))
    full = T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType())])
    rows = spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/{COMMIT}={name}" for name in listed])
    order = F.array_position(F.array(*[F.lit(name) for name in listed]), F.col(COMMIT))
    return rows.withColumn("_order", order).drop(COMMIT)


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "_order")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_order").alias("_newest"))
    return newest.select(*keys, "_newest.*")


def read_cache(
    spark: SparkSession, path: str | None, schema: T.StructType, keys: list[str], **partition: str
) -> DataFrame:
    """The latest row of each key of one cache partition (e.g. one model)."""
    listed = commits(spark, path)[1] if path is not None else []
    rows = _all_versions(spark, path or "", schema, listed)
    for column, value in partition.items():
        rows = rows.filter(F.col(column) == value)
    return _latest(rows.drop(*partition), keys)


def append_cache(rows: DataFrame, path: str, keys: list[str], **partition: str) -> None:
    """Add rows under their partition; from now on they win over older rows of their keys."""
    spark = rows.sparkSession
    tagged = rows.withColumns({c: F.lit(v) for c, v in partition.items()})
    name = _write_commit(tagged, path, list(partition))
    listed = publish(spark, path, lambda known: [*known, name])
    if len(listed) > MANY_COMMITS:
        compact(spark, path, tagged.schema, keys, list(partition))


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], partition: list[str]) -> None:
    """Put the latest rows of all commits into one. Folders no longer listed stay for readers under way
    and may be deleted later."""
    _, merged = commits(spark, path)
    name = _write_commit(_latest(_all_versions(spark, path, schema, merged), [*keys, *partition]), path, partition)
    publish(spark, path, lambda known: [name, *[c for c in known if c not in merged]])


# Buckets


def _bucket_count(spark: SparkSession, path: str) -> int:
    """The number of buckets of a table, fixed when it is first written."""
    target = f"{path}/_buckets.json"
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not table_exists(spark, target):
        _create(spark, target, json.dumps({"buckets": wanted}))
    return json.loads(_read(spark, target))["buckets"]


def bucketed_table(spark: SparkSession, path: str, schema: T.StructType, key: str, **partition: str) -> DataFrame:
    """One partition of a table bucketed by ``key``, as this session's catalog knows it now.

    Every partition is a folder of its own. The catalog entry only tells Spark about the buckets; the
    files and the number of buckets are all that persists.
    """
    name, _ = _bucketed_entry(spark, path, schema, key, partition)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _bucketed_entry(
    spark: SparkSession, path: str, schema: T.StructType, key: str, partition: dict[str, str]
) -> tuple[str, int]:
    parts = [f"{c}={spark._jvm.java.net.URLEncoder.encode(v, 'UTF-8')}" for c, v in partition.items()]
    location = "/".join([path, *parts])
    n = _bucket_count(spark, path)
    name = "pairlens_cache_" + hashlib.md5(location.encode()).hexdigest()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name not in partition)
    quoted = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {n} BUCKETS LOCATION '{quoted}'"
    )
    return name, n


def append_bucketed(rows: DataFrame, path: str, schema: T.StructType, key: str, **partition: str) -> None:
    """Add rows to their buckets; readers see them once the whole job has committed."""
    spark = rows.sparkSession
    name, n = _bucketed_entry(spark, path, schema, key, partition)
    columns = [f.name for f in schema.fields if f.name not in partition]
    rows.select(*columns).repartition(n, key).write.insertInto(name)
    spark.catalog.refreshTable(name)
