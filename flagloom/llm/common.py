"""Helpers shared by the operators: tables, settled intermediates, byte kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flagloom.session import scratch_path

#: Rows above this many bytes of text are handled in slices of a batch, so a
#: task holds the arrays of one slice (or one whole long text) at a time.
SLICE_BYTES = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settle(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back (``compression``: the
    files' codec, where it is not the session's).

    Cuts the lineage at a point every executor can reach, so a lost executor
    never repeats what lies before it; the cluster's owner of
    ``spark.checkpoint.dir`` cleans the folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def shared_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a full address (``file:``, ``hdfs:``, ``s3:`` ...)."""
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def parquet_batches(path: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of the files of a folder on the shared file system; none where there is no folder."""
    files, name = shared_fs(path)
    for info in sorted(files.get_file_info(pafs.FileSelector(name, allow_not_found=True)), key=lambda f: f.path):
        if info.base_name.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(1 << 16, columns=columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def first_ids(rows: DataFrame, group: str, ident: str, most: int, salts: int = 64) -> DataFrame:
    """At most ``most`` rows (``group``, ``ident``) of every group, least hashes of the id
    first. Ranked inside salted parts of each group before the group itself, so that
    no task holds a group whole."""
    salt = F.pmod(F.xxhash64(ident, F.lit(1)), F.lit(salts))
    for part in ([group, "_salt"], [group]):
        order = Window.partitionBy(*part).orderBy(F.xxhash64(ident), F.col(ident))
        rows = (rows.withColumn("_salt", salt).withColumn("_n", F.row_number().over(order))
                .where(F.col("_n") <= most).drop("_n", "_salt"))
    return rows


def as_binary(column: pa.Array) -> pa.Array:
    """A string column as large_binary without nulls (null becomes empty)."""
    out = column.cast(pa.large_binary())
    return out.fill_null(b"") if out.null_count else out


def slices(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``limit`` bytes of ``column``,
    or a single row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.frombuffer(as_binary(batch.column(column)).buffers()[1], np.int64)[-(n + 1):]
        start = 0
        while start < n:
            stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
            stop = min(n, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # worker processes live on between tasks


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``column`` (a long without nulls)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(keys != keys[-1], False)) if keys[0] != keys[-1] else 0
        if start or (held and held[-1].column(column)[-1].as_py() != keys[0]):
            ready = [*held, batch.slice(0, start)] if start else held
            yield pa.Table.from_batches(ready).combine_chunks()
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column of texts, as byte offsets.

    ``data`` holds the UTF-8 bytes of all texts, ``start``/``end`` the words,
    and words ``first[i]:first[i + 1]`` belong to text ``i``.
    """

    _SEP = np.zeros(256, bool)
    _SEP[[0x20, *range(0x09, 0x0E)]] = True
    _LOWER = np.arange(256, dtype=np.uint8)
    _LOWER[0x41:0x5B] += 32

    def __init__(self, texts: pa.Array, lower: bool = False):
        col = as_binary(texts)
        n = len(col)
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = self._LOWER[data[offs[0]:offs[-1]]] if lower else data[offs[0]:offs[-1]]
        self.offsets = offs - offs[0]
        word = ~self._SEP[self.data]
        size = len(word)
        inner = self.offsets[:-1][self.offsets[:-1] < size]
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        opens[inner] = word[inner]
        closes = word
        closes[:-1] = word[:-1] & ~word[1:]
        lasts = self.offsets[1:][self.offsets[1:] > 0] - 1
        closes[lasts] |= ~self._SEP[self.data[lasts]]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of every word; equal words get equal hashes in any task."""
        if not len(self):
            return np.zeros(0, np.uint64)
        return mix(windows_hash(self.data.astype(np.uint64) + np.uint64(1), self.start, self.end, seed))

    def dictionary(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and which of them each word is."""
        if not len(self):
            return [], np.zeros(0, np.int32)
        bounds = np.concatenate(([0], np.cumsum(self.end - self.start)))
        return distinct_parts(bounds, self.data[~self._SEP[self.data]])

    def identities(self, seed: int = 0) -> np.ndarray:
        """XXH64 of every word: as :meth:`hashes`, without structured words that collide."""
        names, which = self.dictionary()
        digest = xxhash.xxh64_intdigest
        return np.array([digest(w, seed) for w in names], np.uint64)[which]

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def distinct_parts(bounds: np.ndarray, data: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct ``data[bounds[i]:bounds[i + 1]]``, and which of them each is."""
    packed = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    found = packed.dictionary_encode()
    _, ends, raw = found.dictionary.buffers()
    raw, ends = raw.to_pybytes(), np.frombuffer(ends, np.int64)[:len(found.dictionary) + 1].tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])], found.indices.to_numpy()


_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        base = _BASES[seed]
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = out[0], out[1]
        if size <= 1 << 23:  # longer ones are made again when a longer text comes
            _POWERS[seed] = have
    return have


def windows_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Polynomial hash (modulo 2^64) of every ``values[start:end]``."""
    power, inverse = _powers(seed, len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * power[:len(values)], out=total[1:])
    return (total[end] - total[start]) * inverse[start]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the 64-bit result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
