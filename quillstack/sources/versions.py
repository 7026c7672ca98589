"""A library's tables as one version: written aside, then made visible all at once.

Below a root lie the versions' tables and the file ``CURRENT``, a manifest that
names the folder of each table.  A writer writes the tables that it changes to a
folder of its own and puts a new manifest in the old one's place by one rename,
the only step that a reader can see.  A writer that fails, at whatever table,
leaves the manifest and all that it names as they were.  Unchanged tables are
named again, not copied.

The rename replaces its target at once on HDFS and local disks.  Writers are
expected one at a time; one that finds another's manifest in place of the one it
began with gives up.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _file_context(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm, path, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, root: str) -> dict[str, str]:
    """table: folder, of the version that is visible; nothing before the first load."""
    jvm, path, files = _file_context(spark, root)
    at = jvm.org.apache.hadoop.fs.Path(path, POINTER)
    if not files.util().exists(at):
        return {}
    stream = files.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def switch(spark: SparkSession, root: str, before: dict[str, str], after: dict[str, str]) -> None:
    """Make ``after`` the manifest by one rename, if ``before`` still is."""
    jvm, path, files = _file_context(spark, root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    new = jvm.org.apache.hadoop.fs.Path(path, f".{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(after, sort_keys=True).encode()))
    out.close()
    if manifest(spark, root) != before:
        fs.delete(new, False)
        raise RuntimeError("another writer has switched the version meanwhile")
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(new, jvm.org.apache.hadoop.fs.Path(path, POINTER), option)


def _publish(spark: SparkSession, root: str, before: dict[str, str], tables: dict[str, DataFrame], kept: dict[str, str]) -> dict[str, str]:
    folder = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    after = kept | {name: f"{folder}/{name}" for name in tables}
    switch(spark, root, before, after)
    return after


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as it is in the version that is visible now; later versions don't change what the result reads."""
    return spark.read.parquet(manifest(spark, root)[name])


def reset(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """These tables and nothing else."""
    return _publish(spark, root, manifest(spark, root), tables, {})


def _books(tables: dict[str, DataFrame], key: str) -> DataFrame:
    out = None
    for df in tables.values():
        own = df.select(key).distinct()
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def load(spark: SparkSession, root: str, tables: dict[str, DataFrame], key: str = "book") -> dict[str, str]:
    """More books: their rows follow those that are there. A book that is there already is refused, before anything is written."""
    before = manifest(spark, root)
    books = _books(tables, key)
    for name in tables:
        if name in before:
            twice = spark.read.parquet(before[name]).join(books, key, "left_semi").select(key).first()
            if twice:
                raise ValueError(f"{twice[0]} is loaded already: reload it")
    new = {name: spark.read.parquet(before[name]).unionByName(df) if name in before else df for name, df in tables.items()}
    return _publish(spark, root, before, new, before)


def reload(spark: SparkSession, root: str, tables: dict[str, DataFrame], key: str = "book") -> dict[str, str]:
    """Books anew: in every table that has the key, their old rows go, new ones take their place where given."""
    before = manifest(spark, root)
    books = _books(tables, key)
    new = {}
    for name, path in before.items():
        old = spark.read.parquet(path)
        if key in old.columns:
            rest = old.join(books, key, "left_anti").select(*old.columns)
            new[name] = rest.unionByName(tables[name]) if name in tables else rest
    new |= {name: df for name, df in tables.items() if name not in before}
    return _publish(spark, root, before, new, before)


def clean(spark: SparkSession, root: str) -> None:
    """Delete the folders that the visible version doesn't name: what failed writers and older versions have left. Readers of older versions must be done."""
    jvm, path, _ = _file_context(spark, root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = {p.rsplit("/", 2)[-2] for p in manifest(spark, root).values()}
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in named or name.startswith(f".{POINTER}-"):
            fs.delete(status.getPath(), True)


def counts(spark: SparkSession, root: str) -> DataFrame:
    """table, rows of the visible version."""
    out = [spark.read.parquet(p).agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n, p in sorted(manifest(spark, root).items())]
    first = out[0]
    for df in out[1:]:
        first = first.unionByName(df)
    return first
