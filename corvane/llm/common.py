"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into arrays at a time.
CHUNK_BYTES = 2 << 20
#: Spark's switch that removes a query's shuffle files at its end; no later step reads those of a written table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's limit of the bytes that a Python worker gets at a time; without it 10,000 rows may be a whole task's text.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_KEPT: dict[str, dict] = {}


def kept_by(operator: str) -> dict:
    """What this Python worker keeps of ``operator`` from task to task. Workers outlive a query's step, so what others kept goes."""
    for other in [k for k in _KEPT if k != operator]:
        del _KEPT[other]
    return _KEPT.setdefault(operator, {})


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint folder; one of its own only in local mode, where none need be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corvane/{uuid.uuid4().hex}"


def table(df: DataFrame, compression: str = "zstd", batch_bytes: int | None = None) -> DataFrame:
    """``df`` as a written table: it cuts the lineage and survives lost executors. Shuffle files of its plan go as soon as it is written.

    Its Python workers get about ``batch_bytes`` at a time, if given."""
    spark, path, schema = df.sparkSession, shared_dir(df.sparkSession), df.schema
    now = {CLEANUP: "true"} | ({ARROW_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {k: spark.conf.get(k) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark removes shuffle files of plans only once the driver's JVM has collected them
    return spark.read.schema(schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of written tables that no later step reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    """Partitions of the plan below; no job runs."""
    return max(1, df.rdd.getNumPartitions())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of the caller never clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after another, and the offsets of each; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pa.compute.fill_null(col, "").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class RollingHash:
    """Polynomial hashes modulo 2**64 of substrings of a block of at most ``span`` bytes."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, span: int):
        self.span = 0
        self.values = np.random.default_rng(12345).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.grow(span)

    def grow(self, span: int) -> None:
        if span <= self.span:
            return
        inverse = pow(self.BASE, -1, 2**64)
        with np.errstate(over="ignore"):
            self.power, self.inverse = (np.full(span + 1, x, np.uint64) for x in (self.BASE, inverse))
            for p in (self.power, self.inverse):
                p[0] = 1
                np.cumprod(p, out=p)
        self.span = span

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.inverse[starts])


_ROLLING: dict[int, RollingHash] = {}


def rolling(span: int = 1 << 20) -> RollingHash:
    return _ROLLING.setdefault(0, RollingHash(span))


#: Words as the near-duplicate contract has them: bytes other than space and \x09-\x0D, A-Z in lower case.
WORD_TABLE = np.arange(256, dtype=np.uint8)
WORD_TABLE[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one after another, and the first word of each text (one more at the end)."""
    out, firsts, r = [], np.zeros(len(offsets), np.int64), rolling()
    space = np.empty(len(data) + 1, bool)
    space[:-1] = SPACE[data]
    space[-1] = True
    cut = np.zeros(len(data) + 1, bool)  # a text's first byte starts a word even after a word byte
    cut[offsets] = True
    begin = ~space
    begin[1:] &= space[:-1] | cut[1:]
    starts = np.flatnonzero(begin)
    stop = space[1:] | cut[1:]
    ends = np.flatnonzero(stop & ~space[:-1]) + 1
    firsts = np.searchsorted(starts, offsets)
    at = 0
    while at < len(starts):  # blocks of about the span of the powers
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + (1 << 20), "right")))
        lo, hi = starts[at], ends[end - 1]
        prefix = r.prefix(WORD_TABLE[data[lo:hi]])
        out.append(r.of(prefix, starts[at:end] - lo, ends[at:end] - lo))
        at = end
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), firsts


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text, with the offset of each text's first; a text of fewer words, but not none, is one shingle."""
    parts, sizes = [], [0]
    coef = [np.uint64(c) for c in np.random.default_rng(777).integers(1, 2**62, max(n, 1)) * 2 + 1]
    full = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        full += words[i : i + len(full)] * coef[i]
    full = mix(full) if len(full) else full
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= n:
            part = np.unique(full[a : b - n + 1])
        elif b > a:
            part = mix(np.array([sum((int(w) * int(c) for w, c in zip(words[a:b], coef, strict=False)), b - a) & (2**64 - 1)], np.uint64))
        else:
            part = full[:0]
        parts.append(part)
        sizes.append(len(part))
    return (np.concatenate(parts) if parts else full[:0]), np.cumsum(sizes)


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``names`` renamed so that none clashes, and the columns that give it back."""
    own = [n if n in names else f"aside_{i}_" for i, n in enumerate(df.columns)]
    return df.toDF(*own), [F.col(o).alias(n) for o, n in zip(own, df.columns, strict=True)]
