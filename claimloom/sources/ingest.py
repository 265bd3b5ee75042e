"""Documents as they come in: content addresses, idempotent appends, response caches, uploads and where their files lie.

A null text counts as empty, a null name is no file of any kind. Contents that repeat are taken in once; empty tables give empty ones.
"""

from __future__ import annotations

import _hashlib
import ctypes
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = 128 << 20  # bytes of a file that one task reads whole
BOM = b"\xef\xbb\xbf"


def hashed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def new_documents(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming documents whose content isn't stored, each content once (smallest doc_id)."""
    own = hashed(incoming)
    first = own.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    return own.join(first, ["sha256", "doc_id"], "left_semi").join(stored.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256", "doc_id"])


def cache_key(block_sha, model: str, version: str = "1"):
    return F.sha2(F.concat_ws("|", block_sha, F.lit(version), F.lit(model)), 256)


def cache_misses(blocks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Blocks that the model hasn't answered: the only ones that are sent."""
    return blocks.withColumn("key", cache_key(F.col("sha256"), model)).join(cache.select("key"), "key", "left_anti")


def files(spark: SparkSession, glob: str) -> DataFrame:
    """Files of a glob with their content's hash; the reader leaves empty files out. Contents of up to PIECE bytes stay with the reader until
    asked for. Longer ones are hashed at once, a split a task, each going on from the hash's state after the split before, so no task reads
    a whole one. Only files whose names the reader would unpack (.gz and the like), which it can't split, are read whole at any length."""
    own = spark.read.format("binaryFile").load(glob)
    hashes = lambda df: df.select("path", "length", F.sha2("content", 256).alias("sha256"))
    long = own.where(F.col("length") > PIECE).select("path", "length").collect()
    if not long:
        return hashes(own)
    jvm = spark._jvm.org.apache.hadoop
    codecs = jvm.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    packed = [_literal(r.path) for r in long if codecs.getCodec(jvm.fs.Path(r.path)) is not None]
    plain = [r for r in long if _literal(r.path) not in packed]
    out = hashes(own.where(F.col("length") <= PIECE))
    if packed:
        out = out.unionByName(hashes(spark.read.format("binaryFile").load(packed)))
    with ThreadPoolExecutor(max(1, min(len(plain), spark.sparkContext.defaultParallelism))) as pool:
        found = list(pool.map(lambda r: (r.path, r.length, _split_sha256(spark, r.path, r.length)), plain))
    return out.unionByName(spark.createDataFrame(found, "path string, length long, sha256 string"))


def _literal(path: str) -> str:
    """A glob that fits this path alone."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


class Sha256:
    """SHA-256 whose state can go to another process; hashlib keeps its own. The state is OpenSSL's context, a flat structure of 112 bytes."""

    def __init__(self, state: bytes | None = None):
        self.lib, self.own = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(state or b"", 256)
        if state is None:
            self.lib.SHA256_Init(self.own)

    def update(self, data: bytes | pa.Buffer) -> None:
        at = ctypes.c_void_p(data.address) if isinstance(data, pa.Buffer) else data
        self.lib.SHA256_Update(self.own, at, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.own.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.own.raw, 256))
        return out.raw.hex()


STEP = "at long, upto long, lines long, size long, state binary"


def _lines_hashed(state: bytes, some: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Goes on with a hash over lines (at, line), with a line end before each but a file's first (some: there were lines before)."""

    def run(batches):
        sha, lines, size, starts = Sha256(state), 0, 0, []
        for b in batches:
            if not len(b):
                continue
            own = pa.array([b"\n"]).cast(b["line"].type)[0]
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(b)], b["line"]), own)[0].as_buffer()
            if some or lines:
                sha.update(b"\n")
            sha.update(joined)
            lines, size = lines + len(b), size + len(joined) - len(b) + 1
            starts += [b["at"][0].as_py(), b["at"][-1].as_py()]
        if lines:
            yield pa.RecordBatch.from_pylist([{"at": min(starts), "upto": max(starts), "lines": lines, "size": size, "state": sha.state()}], pa.schema([(c, pa.binary() if c == "state" else pa.int64()) for c in ("at", "upto", "lines", "size", "state")]))

    return run


def _split_sha256(spark: SparkSession, path: str, length: int, head: bytes = b"") -> str:
    """Hash of a file that is read as lines, whatever its bytes, in the order of its splits. The reader drops a byte order mark at a file's
    head, and doesn't tell whether its last line ended; the file's length does."""
    rows = spark.read.text(_literal(path), lineSep="\n").select(F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("line"))
    sha, lines, size, done = Sha256(), 0, 0, -1
    sha.update(head)
    state = sha.state()
    for k in range(rows.rdd.getNumPartitions()):  # of one file, splits are partitions in their order, which is checked
        step = rows.mapInArrow(_lines_hashed(state, lines > 0), STEP).rdd
        for r in spark.sparkContext.runJob(step, list, [k]):
            if r.at <= done:
                raise RuntimeError(f"splits of {path} out of order")
            done, lines, size, state = r.upto, lines + r.lines, size + r.size, bytes(r.state)
    left = length - len(head) - size - lines  # -1: the last line has no end; 0: it has one
    if left in (2, 3) and not head:
        return _split_sha256(spark, path, length, BOM)
    if left not in (-1, 0):
        raise RuntimeError(f"{path} has changed while it was read")
    sha = Sha256(state)
    if left == 0:
        sha.update(b"\n")
    return sha.hexdigest()


def latest_jobs(progress: DataFrame) -> DataFrame:
    w = Window.partitionBy("job").orderBy(F.desc("at"))
    return progress.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def received(uploads: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """uploads (name, sha256) with the status of each: 202 and a job for files of the wanted kind, whatever its case, else 400 and none. A
    job is known by name and content, so an upload that comes again is the same job."""
    fits = F.coalesce(F.lower("name").endswith(suffix), F.lit(False))
    return uploads.withColumns({"status": F.when(fits, 202).otherwise(400), "job": F.when(fits, F.sha2(F.concat_ws("|", "name", "sha256"), 256))})


def resolved(documents: DataFrame, files: DataFrame) -> DataFrame:
    """documents (stored_path) with path: where their file lies now among files (path): as stored, else the first by path of the same
    name in any folder, else null."""
    name = lambda c: F.substring_index(c, "/", -1)
    here = files.select(F.col("path").alias("as_stored")).distinct()
    moved = files.groupBy(name("path").alias("moved_name")).agg(F.min("path").alias("moved"))
    own = documents.join(here, F.col("stored_path") == F.col("as_stored"), "left").join(moved, name("stored_path") == F.col("moved_name"), "left")
    return own.withColumn("path", F.coalesce("as_stored", "moved")).drop("as_stored", "moved", "moved_name")
