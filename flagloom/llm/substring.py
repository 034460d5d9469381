"""Substring de-duplication by fixed-block anchors.

A window is ``window`` consecutive words. Each document's text is cut into
non-overlapping reference blocks of ``window // 2`` words; every window holds
at least one whole block of its own document. So two equal windows of two
documents meet when every rolling block-length run of words of one is probed
against the reference blocks of the other. Hits are then extended: all windows
around a hit are compared by 96-bit hashes, and runs of equal windows are the
maximal exact repeats. A window's words go if the same words also start a
window in a document with a smaller id.

The rows are dealt to shares of a bounded number of bytes and written once;
neither texts nor positions move after that. A share sends each of its
distinct runs once, however often it has it, packed to a few bytes, to hash
buckets, and gets back those that are hits; it then sends each distinct window
around its hits once, with the least and greatest id it has it in, and gets
back the least id of all where that outranks one of its own. So a passage of a
third of all documents is one entry a share, and a bucket holds a few million
distinct entries: the buckets' number follows the bytes of the texts. The
anchor probe may hit by chance (32 bits within a bucket): the window comparison
decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagloom.llm.common import Words, mix, parquet_batches, shuffle_partitions, slices, windows_hash
from flagloom.session import scratch_path

_FLUSH = 2 << 20
_LAST = np.iinfo(np.int64).max
#: Bytes of text in a share, and in the runs of a bucket, on average.
_SHARE_BYTES, _BUCKET_BYTES = 32 << 20, 32 << 20
_RUNS = "bucket int, share int, key binary, marks binary"
_WINDOWS = "bucket int, share int, key binary, more binary, low binary, high binary"


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal significance together: the high ones are nearly constant."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(b: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _by_bucket(at: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(bucket, its entries) of entries in the order of their buckets."""
    cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at)).tolist()
    for a, b in zip(cuts, cuts[1:]):
        yield int(at[a]), slice(a, b)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)],
                                      list(names))


def _idents(batch: pa.RecordBatch) -> np.ndarray:
    """Ids as numbers; a null one is larger than all."""
    return batch.column("_id").cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _by_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one share each."""
    for batch in batches:
        share = batch.column("_share").to_numpy(zero_copy_only=False)
        for _, part in _by_bucket(share):
            yield batch.slice(part.start, part.stop - part.start)


def _block_runs(words: Words, window: int, identities: np.ndarray):
    """Text, position and key of every block-length run of texts that have a window."""
    block = window // 2
    counts = np.diff(words.first)
    many = np.where(counts >= window, counts - block + 1, 0)
    doc = np.repeat(np.arange(len(counts)), many)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = words.first[doc] + pos
    return doc, pos, mix(windows_hash(identities, start, start + block))


class _Gathered:
    """Entries of one share until they are sent: arrays side by side."""

    def __init__(self):
        self.parts, self.size, self.share = [], 0, None

    def add(self, *arrays: np.ndarray) -> bool:
        self.parts.append(arrays)
        self.size += len(arrays[0])
        return self.size >= _FLUSH

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.size = [], 0
        return out


def _sent(window: int, buckets: int, entries, packed, schema: str):
    """One row per bucket and flush with a share's entries: ``entries(batch)`` gives a batch's,
    ``packed(share, arrays)`` the rows of a flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered()
        for batch in slices(_by_share(batches), "_text"):
            share = batch.column("_share")[0].as_py()
            if held.size and held.share != share:
                yield _batch(packed(held.share, *held.take()), schema)
            held.share = share
            found = entries(batch, share)
            if len(found[0]) and held.add(*found):
                yield _batch(packed(share, *held.take()), schema)
        if held.size:
            yield _batch(packed(held.share, *held.take()), schema)

    return run


def _runs(window: int, buckets: int):
    """Every distinct run of a flush: key and two marks: whether it is a reference block somewhere, and
    whether several documents of the flush have it (a document is never in two flushes)."""
    block, numbers = window // 2, count()

    def entries(batch: pa.RecordBatch, share: int):
        words = Words(batch.column("_text"))
        doc, pos, key = _block_runs(words, window, words.identities())
        own = next(numbers) * np.int64(1 << 32) + doc  # tells the documents of a task apart
        return key, own, (pos % block == 0).astype(np.uint8)

    def packed(share: int, key, own, marks) -> list[tuple]:
        order = np.argsort(key)
        starts = _group_starts(key[order])
        own, marks = own[order], np.maximum.reduceat(marks[order], starts)
        marks |= (np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)).astype(np.uint8) << 1
        key = key[order][starts]
        at = _bucket(key, buckets)  # in the order of the keys
        return [(bucket, share, key[x].astype(np.uint32).tobytes(),
                 np.packbits(np.stack([marks[x] & 1, marks[x] >> 1])).tobytes()) for bucket, x in _by_bucket(at)]

    return _sent(window, buckets, entries, packed, _RUNS)


def _hits(table: pa.Table) -> pa.Table:
    """The runs of a bucket that are a reference block of one document and occur in another, for every share that has them."""
    rows = table.to_pylist()
    key = [np.frombuffer(r["key"], np.uint32) for r in rows]
    sizes = [len(k) for k in key]
    marks = [np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=2 * n).reshape(2, n) for r, n in zip(rows, sizes)]
    key = np.concatenate(key)
    aligned, several = np.concatenate(marks, axis=1)
    row = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(key, kind="stable")
    starts = _group_starts(key[order])
    times = np.diff(np.append(starts, len(key)))
    hit = np.maximum.reduceat(aligned[order], starts).astype(bool)
    hit &= (times > 1) | np.maximum.reduceat(several[order], starts).astype(bool)
    pick = order[np.repeat(hit, times)]
    share = np.array([r["share"] for r in rows], np.int32)[row[pick]]
    pick = pick[np.argsort(share, kind="stable")]
    share = np.sort(share)
    high = np.uint64(rows[0]["bucket"])
    return pa.Table.from_batches([_batch([(s, (high << np.uint64(32) | np.unique(key[pick[x]]).astype(np.uint64)).tobytes())
                                          for s, x in _by_bucket(share)], "_share int, key binary")])


_HELD: dict[tuple, tuple] = {}


def _answers(path: str, share: int, columns: list[str], dtypes: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """What came back for a share, sorted by its first column; a worker process keeps the last it read of each kind."""
    at, kind = f"{path}/_share={share}", tuple(columns)
    if _HELD.get(kind, ("",))[0] != at:
        parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in dtypes]
        for batch in parquet_batches(at, columns):
            for have, c, t in zip(parts, columns, dtypes):
                have.extend(np.frombuffer(x, t) for x in batch.column(c).to_pylist())
        arrays = [np.concatenate(x) for x in parts]
        order = np.argsort(arrays[0], kind="stable")
        _HELD[kind] = at, tuple(x[order] for x in arrays)
    return _HELD[kind][1]


def _near_hits(batch: pa.RecordBatch, share: int, words: Words, window: int, buckets: int, path: str):
    """Start, text and both hashes of every window that holds a run that is a hit."""
    block, base = window // 2, words.identities()
    doc, pos, key = _block_runs(words, window, base)
    (hits,) = _answers(path, share, ["key"], ("u8",))
    short = (_bucket(key, buckets).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
    at = np.minimum(np.searchsorted(hits, short), max(len(hits) - 1, 0))
    hit = np.flatnonzero(hits[at] == short) if len(hits) else np.zeros(0, np.int64)
    doc, pos = doc[hit], pos[hit]
    edge = np.zeros(len(words) + 2, np.int64)
    low = words.first[doc] + np.maximum(pos + block - window, 0)
    high = np.minimum(words.first[doc] + pos, words.first[doc + 1] - window)
    ok = low <= high
    np.add.at(edge, low[ok], 1)
    np.add.at(edge, high[ok] + 1, -1)
    start = np.flatnonzero(np.cumsum(edge) > 0)
    doc = np.searchsorted(words.first, start, side="right") - 1
    key = mix(windows_hash(base, start, start + window))
    more = mix(windows_hash(words.identities(1), start, start + window, 1)).astype(np.uint32) if len(start) else np.zeros(0, np.uint32)
    return start, doc, key, more


def _window_ids(window: int, buckets: int, hits: str):
    """Every distinct window around a share's hits, with the least and the greatest id that has it there."""

    def entries(batch: pa.RecordBatch, share: int):
        _, doc, key, more = _near_hits(batch, share, Words(batch.column("_text")), window, buckets, hits)
        ident = _idents(batch)[doc]
        return key, more, ident

    def packed(share: int, key, more, ident) -> list[tuple]:
        order = np.lexsort((more, key))
        key, more, ident = key[order], more[order], ident[order]
        starts = _group_starts(key, more)
        low, high = np.minimum.reduceat(ident, starts), np.maximum.reduceat(ident, starts)
        key, more = key[starts], more[starts]
        return [(bucket, share, key[x].tobytes(), more[x].tobytes(), _planes(low[x]), _planes(high[x]))
                for bucket, x in _by_bucket(_bucket(key, buckets))]

    return _sent(window, buckets, entries, packed, _WINDOWS)


def _outranked(table: pa.Table) -> pa.Table:
    """The least id of all for every window of a bucket, for the shares where it outranks one of their own."""
    rows = table.to_pylist()
    key = [np.frombuffer(r["key"], np.uint64) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(k) for k in key])
    key, more = np.concatenate(key), np.concatenate([np.frombuffer(r["more"], np.uint32) for r in rows])
    low, high = (np.concatenate([_unplanes(r[c], "i8") for r in rows]) for c in ("low", "high"))
    order = np.lexsort((more, key))
    starts = _group_starts(key[order], more[order])
    least = np.repeat(np.minimum.reduceat(low[order], starts), np.diff(np.append(starts, len(order))))
    pick = order[least < high[order]]
    least = least[least < high[order]]
    share = np.array([r["share"] for r in rows], np.int32)[row[pick]]
    by = np.argsort(share, kind="stable")
    share, pick, least = share[by], pick[by], least[by]
    return pa.Table.from_batches([_batch([(s, key[pick[x]].tobytes(), more[pick[x]].tobytes(), least[x].tobytes())
                                          for s, x in _by_bucket(share)], "_share int, key binary, more binary, least binary")])


def _removed(batch: pa.RecordBatch, words: Words, window: int, buckets: int, hits: str, ranks: str) -> np.ndarray:
    """Which words of a batch lie in a window that a smaller id has, too."""
    share = batch.column("_share")[0].as_py()
    keys, mores, leasts = _answers(ranks, share, ["key", "more", "least"], ("u8", "u4", "i8"))
    edge = np.zeros(len(words) + 1, np.int64)
    if len(keys):
        start, doc, key, more = _near_hits(batch, share, words, window, buckets, hits)
        ident = _idents(batch)[doc]
        at, end = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
        gone = np.zeros(len(start), bool)
        while (live := np.flatnonzero(at < end)).size:  # a step for each answer of one key: one, but for chance
            gone[live] |= (mores[at[live]] == more[live]) & (leasts[at[live]] < ident[live])
            at[live] += 1
        np.add.at(edge, start[gone], 1)
        np.add.at(edge, start[gone] + window, -1)
    return np.cumsum(edge)[:-1] > 0


def _cut(keep: list[str], window: int, buckets: int, hits: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(_by_share(batches), "_text"):
            words = Words(batch.column("_text"))
            stay = ~_removed(batch, words, window, buckets, hits, ranks)
            total, removed, kept = [], [], []
            for i in range(batch.num_rows):
                a, b = words.first[i], words.first[i + 1]
                own, data, shift = stay[a:b], words.text(i), words.offsets[i]
                total.append(int(b - a))
                removed.append(int(b - a) - int(own.sum()))
                kept.append(b" ".join([data[s:e] for s, e in zip((words.start[a:b][own] - shift).tolist(),
                                                                 (words.end[a:b][own] - shift).tolist())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                [*keep, "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                 share_bytes: int = _SHARE_BYTES, bucket_bytes: int = _BUCKET_BYTES, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``_id``, ``_text``, ``_rest`` (its other
    columns), ``n_words``, ``n_removed``, ``kept_text`` (the kept words joined by
    one space) and ``kept_sha256``.

    ``window`` is even. Only a smaller id outranks: repeated rows and rows of
    one id never remove each other's words. A null id counts as larger than
    every id. Null, empty and short texts (fewer words than the window) keep
    all their words; no rows give none. ``id_col`` is an integer column. Texts of
    any length are taken whole; shares and buckets have about ``share_bytes`` and
    ``bucket_bytes`` of text, and at least one long text; ``buckets`` states the buckets' number instead.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.struct(*rest, F.lit(0).alias("_")).alias("_rest"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shares, by_size = (max(n, -(-size // most)) for most in (share_bytes, bucket_bytes))
    buckets = by_size if buckets is None else buckets
    # dealt by row, repeated rows too, and written once
    deal = F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(shares)).cast("int")
    path, hits, ranks = (scratch_path(spark, f"substring-{x}") for x in ("rows", "hits", "ranks"))
    dealt = rows.withColumn("_share", deal).repartition(shares, "_share").sortWithinPartitions("_share")
    dealt.write.parquet(path)
    placed = spark.read.schema(dealt.schema).parquet(path)
    texts = placed.select("_share", "_id", "_text").where("_text IS NOT NULL")

    def back(answers: DataFrame, to: str) -> None:
        answers.repartition(n, "_share").write.partitionBy("_share").parquet(to)

    back(texts.mapInArrow(_runs(window, buckets), _RUNS).repartition(buckets, "bucket").groupBy("bucket")
         .applyInArrow(_hits, "_share int, key binary"), hits)
    back(texts.mapInArrow(_window_ids(window, buckets, hits), _WINDOWS).repartition(buckets, "bucket").groupBy("bucket")
         .applyInArrow(_outranked, "_share int, key binary, more binary, least binary"), ranks)
    keep = ["_id", "_text", "_rest"]
    schema = rows.select(*keep).schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_text", "string"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    return placed.select("_share", *keep).mapInArrow(_cut(keep, window, buckets, hits, ranks), schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text_col``; a text that loses nothing stays as it is."""
    found = drop_repeats(docs, id_col, text_col, window)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("_text"))
    return found.select(*(F.col("_id").alias(c) if c == id_col else text.alias(c) if c == text_col
                          else F.col("_rest").getField(c).alias(c) for c in docs.columns))
