"""Order MinHash fingerprints: signatures that follow edit distance.

Every k-mer of a text (``k`` code points) is numbered by its earlier
occurrences, so repeats count. Each of ``sketches`` hash functions picks the
``picks`` numbered k-mers with the smallest hashes, puts them back into text
order and hashes the tuple. Two texts' likeness is the share of equal tuples:
moved or reordered passages change it, which a plain MinHash would not see.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flagloom.llm.common import mix, settle, shuffle_partitions

_SPACING = np.uint64(0x9E3779B97F4A7C15)
#: Bits cut off a k-mer's hash: one number for texts of every length, so that a
#: k-mer has the same hash in each of them.
_CUT = 7
#: Hash values of one text that are compared at once.
_CELLS = 1 << 16


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` values, by joining two shorter runs."""
    h, have, factor = points.astype(np.uint64), 1, 0x9E3779B97F4A7C15
    h += np.uint64(1)
    while have < k:
        step = min(have, k - have)
        head = h[:-step] * np.uint64(factor)
        head += h[step:]
        h, have, factor = head, have + step, factor * factor % (1 << 64)
    return mix(h)


def _by_hash(base: np.ndarray) -> np.ndarray:
    """Places of the hashes (``_CUT`` bits short) in their order, equal ones by place."""
    bits = max(_CUT, (len(base) - 1).bit_length())
    # one plain sort of values that carry their place instead of their lowest bits
    packed = base >> np.uint64(bits - _CUT)
    packed <<= np.uint64(bits)
    packed |= np.arange(len(base), dtype=np.uint64)
    packed.sort()
    top = packed >> np.uint64(bits)
    packed &= np.uint64((1 << bits) - 1)
    place = packed.view(np.int64)
    twin = np.flatnonzero(top[1:] == top[:-1])
    if (base[place[twin]] != base[place[twin + 1]]).any():  # unequal hashes that differ in the lowest bits only
        return np.argsort(base, kind="stable")
    return place


def signature(points: np.ndarray, k: int = 6, picks: int = 2, sketches: int = 32) -> np.ndarray:
    """``sketches`` 32-bit tuple hashes of one text given as code points.

    A text shorter than ``k`` is one k-mer, the empty text too; a text with
    fewer than ``picks`` k-mers uses them all. Equal hashes go to the earlier.
    """
    size = len(points)
    if not size:
        points, size = np.zeros(1, np.uint32), 1
    k = min(k, size)
    n = size - k + 1
    base = _kmer_hashes(points, k)
    base >>= np.uint64(_CUT)
    # occurrence numbers: equal k-mers side by side, in text order
    place = _by_hash(base)
    same = base[place]
    repeat = np.flatnonzero(same[1:] == same[:-1]) + 1
    if len(repeat):
        starts = np.arange(n)
        starts[repeat] = 0
        number = repeat - np.maximum.accumulate(starts)[repeat]
        same[repeat] = mix(same[repeat] + number.astype(np.uint64) * _SPACING)
    # the top bits of the hash are cut off; a product spreads the rest
    same *= _SPACING
    numbered = np.empty(n, np.uint64)
    numbered[place] = same
    few = min(picks, n)
    narrow = (numbered >> np.uint64(32)).astype(np.uint32)
    factor, shift = _functions(sketches)
    chosen = np.empty((sketches, few), np.int64)
    rows = max(1, _CELLS // n)
    for at in range(0, sketches, rows):
        order = narrow ^ shift[at:at + rows, None]
        order *= factor[at:at + rows, None]
        lines = np.arange(len(order))
        for j in range(few):
            least = order.argmin(axis=1)
            chosen[at:at + rows, j] = least
            order[lines, least] = 0xFFFFFFFF
    chosen.sort(axis=1)
    code = np.arange(1, sketches + 1, dtype=np.uint64)
    for j in range(few):
        code = mix(code * _SPACING + numbered[chosen[:, j]])
    return (code >> np.uint64(32)).astype(np.uint32)


_MADE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _functions(sketches: int) -> tuple[np.ndarray, np.ndarray]:
    if sketches not in _MADE:
        raw = mix(np.arange(1, 2 * sketches + 1, dtype=np.uint64) * _SPACING)
        _MADE[sketches] = ((raw[:sketches] >> np.uint64(32)).astype(np.uint32) | np.uint32(1),
                           (raw[sketches:] >> np.uint64(32)).astype(np.uint32))
    return _MADE[sketches]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def _packed(sig: np.ndarray) -> bytes:
    return sig.astype(">u4").tobytes()


_RESULT = ("n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
           "near_edited double, near_next double")


class _Pairing:
    """Results of a text and the one after it."""

    def __init__(self, k: int, picks: int, sketches: int):
        self.how = k, picks, sketches

    def of(self, text: str | None) -> tuple[str, np.ndarray, np.ndarray]:
        text = text or ""
        points = _points(text)
        return text, points, signature(points, *self.how)

    def row(self, own, after) -> tuple:
        text, points, sig = own
        n = len(points)
        edited = text[:n - n // 3] + after[0][:n // 3]
        new = sig if edited == text else signature(_points(edited), *self.how)
        return (n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest(), _packed(sig), _packed(new),
                likeness(sig, new), likeness(sig, after[2]))


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  k: int = 6, picks: int = 2, sketches: int = 32) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    Rows are taken by descending id (null ids last, rows of one id by their
    text's hash); the row after the last is the first. The edited text is the own text with
    its last third of code points (rounded down) replaced by the first as many
    of the next row's text, or all of them. Returns ``id_col``, ``n_chars``,
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``
    and ``near_next``; equal texts have equal fingerprints. A null text is
    empty; a single row is its own next; no rows give none. Other columns are
    ignored.

    The texts are dealt once by ranges of the id; each task walks its rows in
    order and holds two texts. What the walk cannot see is the text after a
    task's last row: first and last rows travel with the results to a table
    in the shared folder and are matched there, two rows a task, by the task's
    number; one task ranks these numbers and sees no text.
    """
    spark = docs.sparkSession
    how = _Pairing(k, picks, sketches)
    # the ranges' sample of keys goes to the driver, so a key has the text's hash, not the text
    order = [F.col("_id").desc_nulls_last(), F.xxhash64("_text")]
    rows = (docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
            .repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "_text"))
    kind = rows.schema["_id"].dataType
    walked = f"part int, edge string, _id {kind.simpleString()}, {_RESULT}, _text string"
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out, size = TaskContext.get().partitionId(), None, [], 0

        def made() -> pa.RecordBatch:
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(cols, types)], ["part", "edge", "_id", *names, "_text"])

        types = [pa.int32(), pa.string(), None, pa.int64(), pa.binary(), pa.binary(), pa.binary(),
                 pa.float64(), pa.float64(), pa.string()]
        for batch in batches:
            types[2] = batch.schema.field("_id").type
            for ident, text in zip(batch.column("_id"), batch.column("_text")):
                now = ident.as_py(), how.of(text.as_py())
                if held is None:
                    out.append((part, "first", now[0], *[None] * 6, now[1][0]))
                else:
                    out.append((part, None, held[0], *how.row(held[1], now[1]), None))
                held = now
                if len(out) >= 1000:
                    yield made()
                    out.clear()
        if held is not None:
            out.append((part, "last", held[0], *[None] * 6, held[1][0]))
            yield made()

    done = settle(rows.mapInArrow(walk, walked), "order-minhash")
    # at most two rows for each task of the walk; only the tasks' numbers are put in one order
    tails = done.where("edge = 'last'").select("part", F.struct("_id", "_text").alias("tail"))
    heads = done.where("edge = 'first'").select(F.col("part").alias("after"), F.struct("_text").alias("next"))
    by_range = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(by_range), F.first("part").over(by_range)).alias("after")
    closed = (tails.join(done.where("edge = 'last'").select("part", after), "part")
              .join(heads, "after").select("tail", "next"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [how.row(how.of(a["_text"]), how.of(b["_text"]))
                     for a, b in zip(batch.column("tail").to_pylist(), batch.column("next").to_pylist())]
            ids = pa.array([a["_id"] for a in batch.column("tail").to_pylist()], batch.column("tail").type.field("_id").type)
            cols = list(zip(*found)) if found else [()] * 6
            types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), t) for c, t in zip(cols, types))], ["_id", *names])

    last = closed.mapInArrow(close, f"_id {kind.simpleString()}, {_RESULT}")
    kinds = dict(x.split() for x in _RESULT.split(", "))
    return (done.where("edge IS NULL").select("_id", *names).unionByName(last)
            .select(F.col("_id").alias(id_col), *(F.lower(F.hex(c)).alias(c) if kinds[c] == "binary" else c
                                                  for c in names)))
