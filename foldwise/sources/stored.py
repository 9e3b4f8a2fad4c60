"""Stored tables: bucketed by key, and published by one manifest each.

A table becomes visible in one step. Its files are staged in a folder of their own; then a
manifest, which names folder, schema, buckets and rows, is created under the table's name. Only
one creation of a name can succeed, so of several writers one publishes and the others find its
table. A reader goes by the manifest alone: neither staged nor half-written files are ever seen,
and columns keep their types whatever their values look like.

Buckets are hash partitions of the key kept in the files: tables with equal buckets are joined by
that key without moving a row.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


# ------------------------------------------------------------------ bucketed files
BUCKETS = "_buckets"  # a file beside the data that holds their number


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``df`` to the new folder ``path``, one sorted file per bucket of ``key``."""
    name = f"foldwise_w_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: the folder is not the catalog's
    fs, p = _folder(df.sparkSession, f"{path.rstrip('/')}/{BUCKETS}-{buckets}")
    fs.create(p, True).close()


def bucket_count(spark: SparkSession, path: str) -> int:
    fs, p = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    found = [int(n.rsplit("-", 1)[1]) for n in names if n.startswith(f"{BUCKETS}-")]
    if len(found) != 1:
        raise ValueError(f"{path} is no bucketed table")
    return found[0]


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The table of ``write_bucketed``; the session's catalog only learns where its buckets are."""
    fs, p = _folder(spark, path)
    full = fs.makeQualified(p).toString()
    name = f"foldwise_r_{hashlib.sha256(f'{full}:{key}:{buckets}'.encode()).hexdigest()[:24]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    location = full.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {buckets} BUCKETS LOCATION '{location}'")
    return spark.table(name)


# ------------------------------------------------------------------ manifests
class AlreadyPublished(ValueError):
    """Another writer has published a table of this name."""


def _create_once(spark: SparkSession, folder: str, name: str, content: str) -> bool:
    """Create the file ``folder/name`` with all its content, or return False if it exists.

    The content is written to a file of its own first. A hard link (local and network file
    systems) or a rename that does not replace (HDFS) then gives it the name: both are one step.
    """
    fs, p = _folder(spark, folder)
    fs.mkdirs(p)
    where = urlparse(fs.resolvePath(p).toString())
    temp = f".{name}-{uuid.uuid4().hex}"
    if where.scheme in ("", "file"):
        at = unquote(where.path)
        with open(os.path.join(at, temp), "x", encoding="utf-8") as f:
            f.write(content)
        try:
            os.link(os.path.join(at, temp), os.path.join(at, name))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(os.path.join(at, temp))
    path = spark._jvm.org.apache.hadoop.fs.Path
    out = fs.create(path(p, temp), False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    if not fs.exists(path(p, name)) and fs.rename(path(p, temp), path(p, name)):
        return True
    fs.delete(path(p, temp), False)
    if not fs.exists(path(p, name)):
        raise OSError(f"{folder}/{name} could not be created")
    return False


def manifest(spark: SparkSession, store: str, name: str) -> dict | None:
    """What is published under ``name``, or None."""
    path = f"{store.rstrip('/')}/manifests/{name}.json"
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def publish(df: DataFrame, store: str, name: str, key: str, facts: dict | None = None, buckets: int | None = None) -> dict:
    """Write ``df`` and publish it as ``name``; ``AlreadyPublished`` if another table has the name."""
    spark, store = df.sparkSession, store.rstrip("/")
    if manifest(spark, store, name) is not None:
        raise AlreadyPublished(f"{name} is stored already")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = f"data/{name}-{uuid.uuid4().hex}"
    write_bucketed(df, f"{store}/{data}", key, buckets)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    rows = read_bucketed(spark, f"{store}/{data}", schema, key, buckets).count()
    entry = {"data": data, "key": key, "buckets": buckets, "rows": rows, "schema": schema.jsonValue(), "facts": facts or {}}
    if not _create_once(spark, f"{store}/manifests", f"{name}.json", json.dumps(entry, sort_keys=True)):
        fs, p = _folder(spark, f"{store}/{data}")
        fs.delete(p, True)  # our own files, which no manifest names
        raise AlreadyPublished(f"{name} is stored already")
    return entry


def published(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """The table published under ``name``, or None; one whose files lost or gained rows is an error."""
    entry = manifest(spark, store, name)
    if entry is None:
        return None
    schema = T.StructType.fromJson(entry["schema"])
    table = read_bucketed(spark, f"{store.rstrip('/')}/{entry['data']}", schema, entry["key"], entry["buckets"])
    rows = table.count()  # from the files' footers
    if rows != entry["rows"]:
        raise ValueError(f"{name}: {rows} rows, published with {entry['rows']}")
    return table
