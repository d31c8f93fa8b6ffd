"""What the operators of this subpackage share: reading, checkpoints, word hashing."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes of text about, that a Python function gets at once, so that a worker's memory stays bounded.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

#: Word separators of the contracts: space and the ASCII controls 9 to 13.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session, whose workers see the driver's disk, may name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame | None) -> None:
    """Delete what stash() wrote for df, once nothing will read it again."""
    path = getattr(df, "_stash_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, where their PYTHONPATH doesn't have it."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    out = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(out))
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, however they are spelt there."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sampled(key: Column, share: float) -> Column:
    """Whether a hash of the key is among that share of all; a share of a billionth picks some of many billions, too."""
    return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 52)) < F.lit(int(share * (1 << 52)))


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most BATCH_ROWS rows and about BATCH_BYTES bytes (a longer row is a part of its own)."""
    at = 0
    while at < batch.num_rows:
        n = min(BATCH_ROWS, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > BATCH_BYTES:
            n //= 2
        yield batch.slice(at, n)
        at += n


def spans(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Start and end of parts of a list of texts, of the size that pieces() gives."""
    at = size = 0
    for k, t in enumerate(texts):
        more = len(t or b"")
        if k > at and (k - at == BATCH_ROWS or size + more > BATCH_BYTES):
            yield at, k
            at, size = k, 0
        size += more
    if texts:
        yield at, len(texts)


class Kept:
    """What a worker keeps from task to task: the things of the operator that ran last, so that they don't pile up in one that
    serves a job's operators in turn."""

    things: dict = {}
    used = False

    @classmethod
    def get(cls, key: tuple, build: Callable[[], object]):
        cls.used = True
        if key not in cls.things:
            cls.things[key] = build()
        return cls.things[key]

    @classmethod
    def forget(cls) -> None:
        cls.things.clear()


def trim() -> None:
    """Give memory that is free inside this worker back to the system: workers outlive the stages that they served."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict]], schema: str) -> DataFrame:
    """mapInArrow with columns as Python lists. make() builds a task's function, once in each task; what that returns for a column is
    a list, a numpy array or an Arrow array."""
    ship(df.sparkSession)
    names = list(df.columns)
    kinds = {part.split()[0]: KINDS[part.split()[1]] for part in schema.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Kept.used = False
        fn = make()
        if not Kept.used:
            Kept.forget()
        for batch in batches:
            for part in pieces(batch):
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=kinds[k]) for k, v in got.items()]
                if arrays and len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, names=list(got))
            del batch
            got = arrays = part = None
            trim()

    return df.mapInArrow(run, schema)


def ragged(parts: list[np.ndarray], lengths: np.ndarray) -> pa.ListArray:
    """A list for each row, from the values of all rows one after another and the rows' lengths."""
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(values.view(np.int64)))


KINDS = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()),
    "array<double>": pa.list_(pa.float64()),
}


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


# --- word hashing -----------------------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_BYTE[_IS_SPACE] = 0
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = {"n": 0}
BLOCK = 1 << 20


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, 1 << 16)
        _powers["p"] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _P, dtype=np.uint64))))
        _powers["q"] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, _P_INV, dtype=np.uint64))))
        _powers["n"] = n
    return _powers["p"], _powers["q"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that nearby values become unlike ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: for random 64-bit values far faster than a hash table."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    if not data:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_IS_SPACE[np.frombuffer(data, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash for each word of UTF-8 bytes, computed from prefix sums of a polynomial; long texts go in blocks."""
    if len(data) > 2 * BLOCK:
        out, at = [], 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            while end < len(data) and not _IS_SPACE[data[end]]:
                end += 1
            out.append(word_hashes_block(data[at:end]))
            at = end
        return np.concatenate(out)
    return word_hashes_block(data)


def word_hashes_block(data: bytes) -> np.ndarray:
    start, end = word_bounds(data)
    if not len(start):
        return np.empty(0, np.uint64)
    p, q = _tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * p[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n]
    return mix64(out)


@dataclass
class Segment:
    """Some texts one after another, and the hashes of all their words, so that many short texts are hashed together."""

    at: int  # which of the texts is the first
    data: bytes  # the texts, joined by spaces
    hashes: np.ndarray
    first: np.ndarray  # number of the first word of each text, and of all words

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Which of the segment's texts each word belongs to."""
        return np.repeat(np.arange(self.texts), self.counts)

    def inside(self, k: int) -> np.ndarray:
        """The words at which k words of one text start."""
        n = len(self.hashes) - k + 1
        return np.flatnonzero(np.arange(n) + k <= np.repeat(self.first[1:], self.counts)[:n]) if n > 0 else np.empty(0, np.int64)


def segments(texts: list[bytes | None], lower: bool = False) -> Iterator[Segment]:
    """Segments of about BLOCK bytes; a text of more is a segment of its own."""
    at, n = 0, len(texts)
    while at < n:
        end, size = at + 1, len(texts[at] or b"") + 1
        while end < n and size + len(texts[end] or b"") < BLOCK:
            size += len(texts[end] or b"") + 1
            end += 1
        group = [t or b"" for t in texts[at:end]]
        data = b" ".join(group)
        if lower:
            data = data.translate(LOWER)
        if len(group) == 1:
            hashes = word_hashes(data)
            first = np.array([0, len(hashes)])
        else:
            begins = np.cumsum([0, *(len(t) + 1 for t in group)])
            starts, _ = word_bounds(data)
            hashes, first = word_hashes_block(data), np.searchsorted(starts, begins)
        yield Segment(at, data, hashes, first)
        at = end


def shingle_sets(texts: list[bytes | None], k: int = 5) -> list[np.ndarray]:
    """Of each text, the sorted distinct k-word shingles of its lower-cased UTF-8; the whole sequence as one where it has fewer words."""
    out = []
    for seg in segments(texts, lower=True):
        grams = shingles(seg.hashes, k)
        for a, b in zip(seg.first[:-1].tolist(), seg.first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(distinct(grams[a : b - k + 1]))
            else:
                out.append(shingles(seg.hashes[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out
