"""SimHash near-duplicates, with pigeonring filtering of candidate pairs.

A text's fingerprint has a bit set where more than half of its word-shingle
hashes (repeats counted) have it set. Two fingerprints link when they differ
in at most ``max_bits`` bits. The 64 bits are cut into ``max_bits + 1``
segments on a ring. If the whole difference is within the budget, some
segment starts a chain whose every prefix of ``l`` segments differs in at most
``floor(l * max_bits / segments)`` bits: its first segment is equal and the
first two differ in one bit at most. Candidates come from an equi-join on
those two segments (one side lists the one-bit changes of the second); the
longer prefixes of the chain prune them, and its full length is the Hamming
check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flagloom.llm.common import as_binary, settle
from flagloom.llm.components import connected_components

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_SEED = 42
_CHUNK = 1 << 16


def simhash(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one UTF-8 text, unsigned; 0 if it has no word.

    A-Z are lower-cased; ``bytes.split`` cuts at the six ASCII spaces.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - k + 1
    starts, ends = starts[:n], ends[k - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = [digest(joined[s:e], _SEED)
                for s, e in zip(starts[at:at + _CHUNK].tolist(), ends[at:at + _CHUNK].tolist())]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 shingle: int = 3) -> DataFrame:
    """The ``keep`` columns and ``simhash`` (a long with the fingerprint's 64 bits) of every row."""
    source = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = docs.select(*keep).schema.add("simhash", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(x.as_py(), shingle) for x in as_binary(batch.column("_text"))]
            bits = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), bits], [*keep, "simhash"])

    return source.mapInArrow(run, schema)


def _segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the ring's segments."""
    m = max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def _part(bits: Column, segment: tuple[int, int]) -> Column:
    shift, width = segment
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def near_pairs(prints: DataFrame, max_bits: int = 3, col: str = "simhash") -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of the distinct fingerprints in ``col`` that
    differ in 1 to ``max_bits`` bits (``max_bits`` from 1 to 15). Nulls take no part."""
    if not 1 <= max_bits <= 15:
        raise ValueError("max_bits must be from 1 to 15")
    ring = _segments(max_bits)
    m = len(ring)
    prints = prints.where(F.col(col).isNotNull())

    def key(i: int, bits: Column, change: int | None = None) -> Column:
        second = _part(bits, ring[(i + 1) % m])
        if change is not None:
            second = second.bitwiseXOR(F.lit(1 << change).cast("long"))
        return F.xxhash64(F.lit(i), _part(bits, ring[i]), second)

    def keyed(name: str, changes: bool) -> DataFrame:
        bits = F.col(col)
        keys = [F.struct(F.lit(i).alias("i"), key(i, bits, c).alias("k"))
                for i in range(m)
                for c in (None, *(range(ring[(i + 1) % m][1]) if changes else ()))]
        return (prints.select(bits.alias(name), F.explode(F.array(*keys)).alias("x"))
                .select(name, F.col("x.i").alias("i"), F.col("x.k").alias("k")))

    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = F.lit(False)
    for i in range(m):
        chain, so_far = F.col("i") == i, F.lit(0)
        for length in range(1, m + 1):
            so_far = so_far + F.bit_count(_part(differ, ring[(i + length - 1) % m]))
            chain = chain & (so_far <= length * max_bits // m)
        within = within | chain
    return (keyed("a", True).join(keyed("b", False), ["i", "k"])
            .where((F.col("a") < F.col("b")) & within).select("a", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links, its own
    included. Equal fingerprints are one node, so copies never become pairs.
    Null, empty and blank texts have fingerprint 0 and link like any other;
    repeated rows give repeated results; a null id keeps its row but is no
    component's id unless all its members' ids are null; no rows give none.
    Other columns of ``docs`` are ignored.
    """
    prints = settle(fingerprints(docs.select(F.col(id_col).alias("_id"), text_col), text_col, ("_id",), shingle),
                    "simhash")
    classes = settle(prints.groupBy("simhash").agg(F.min("_id").alias("first_id")), "simhash-classes")
    roots = connected_components(near_pairs(classes, max_bits))
    linked = settle(classes.join(roots, classes["simhash"] == roots["node"])
                    .select("simhash", "root", "first_id"), "simhash-linked")
    merged = linked.join(linked.groupBy("root").agg(F.min("first_id").alias("least")), "root")
    classes = settle(classes.join(merged.select("simhash", "least"), "simhash", "left")
                     .select("simhash", F.coalesce("least", "first_id").alias("component_id")), "simhash-ids")
    return (prints.join(classes, "simhash")
            .select(F.col("_id").alias(id_col),
                    F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, one per id.

    Where several rows carry that id, the least by the hash of its columns
    stays. A row without an id cannot be named as a representative: it stays.
    Only ids and fingerprints are grouped; texts meet them in one join.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    best = settle(found.where(F.col(id_col) == F.col("component_id"))
                  .groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_rows")), "simhash-best")
    kept = docs.join(best, docs[id_col] == best["_id"])
    first = Window.partitionBy("_id").orderBy(F.xxhash64(*(docs[c] for c in docs.columns)))
    several = kept.where("_rows > 1").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return (kept.where("_rows = 1").select(*docs.columns)
            .unionByName(several.select(*docs.columns))
            .unionByName(docs.where(F.col(id_col).isNull())))
