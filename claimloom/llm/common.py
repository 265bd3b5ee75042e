"""What the operators share: the cluster's shared folder and tables written there."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where all is one machine (tests), a temporary
    one is made if it is unset; on a cluster that is an error, for executors would write where nobody reads."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: list[str] = []


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    _MADE.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor costs nothing that was done before. A result may read
    such tables until it is itself written; then removed() may delete them."""
    spark, at = df.sparkSession, fresh(df.sparkSession, tag)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def made() -> list[str]:
    """What this driver has made in the shared folder and not removed, in order."""
    return list(_MADE)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables and folders that made() lists; nothing that is still to be computed may read them."""
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _MADE.remove(at)


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or of a path without scheme, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def tokenizer_path(name: str, root: str | None = None) -> str:
    """Where a public tokenizer's file lies; root overrides the installed folder."""
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_KEPT: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks. Workers outlive operators: what another one kept goes, and the memory
    that it used is given back."""
    others = [k for k in _KEPT if k != owner]
    for k in others:
        del _KEPT[k]
    if others:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)
    return _KEPT.setdefault(owner, {})
