"""What the operators share: written intermediate tables, 64-bit hashing with numpy, column guards."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, on a local master (tests), one of our
    own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='stacklight-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str, drop_shuffles: bool = False, written: list | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: it cuts lineage, survives lost executors, and gives the
    planner true sizes. The files go when the driver ends, or with release() of `written`. With `drop_shuffles` the shuffle files
    of the write go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    if drop_shuffles:
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if drop_shuffles:
            spark.conf.set(SHUFFLES_GO, before) if before is not None else spark.conf.unset(SHUFFLES_GO)
    if not _written:
        atexit.register(cleanup)
    _written.append((spark, path))
    if written is not None:
        written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(written: list) -> None:
    """Deletes tables that materialize() noted in `written`; DataFrames that read them can't be used afterwards."""
    while written:
        spark, path = written.pop()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove((spark, path))


def store_file(spark: SparkSession, name: str, content: bytes) -> str:
    """The path of a file of its own in the shared folder, for Spark to hand to the executors; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(content))
    out.close()
    if not _written:
        atexit.register(cleanup)
    _written.append((spark, path))
    return path


def cleanup() -> None:
    """Deletes the written tables of this process; DataFrames that read them can't be used afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the cluster's own clean-up of the folder remains
            return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches, rows: int = 512):
    """The batches in parts of few rows, so that a worker holds little beside the batch itself."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def text_bytes(text: str = "text"):
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte, so that the polynomial hashes below don't depend on small byte values.
BYTE64 = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0x5851F42D4C957F2D)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1), modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 4096), BASE, np.uint64), dtype=np.uint64)])
    return _powers[:n]


#: Separators of `[^\x20\x09-\x0D]+`, and an A-Z to a-z table.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of a text, A-Z lower-cased."""
    b = np.frombuffer(text, np.uint8)
    inside = ~SPACES[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    chars = LOWER[b[inside]]
    first = np.cumsum(lens) - lens
    at = np.arange(len(chars)) - np.repeat(first, lens)
    return mix64(np.add.reduceat(BYTE64[chars] * powers(int(lens.max()))[at], first) + lens.astype(np.uint64))


def shingle_hashes(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of `width` words; of fewer words, one of them all; none of none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    n, c = len(w) - k + 1, powers(width + 1)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += mix64(w[i : i + n] + c[i]) * c[k - i]
    return np.unique(mix64(out))
