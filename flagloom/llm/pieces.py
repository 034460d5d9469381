"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into segments (a run of spaces with what follows it, or one
control character that is in no longer piece) that no piece crosses. The distinct segments are exploded
into their bounded-length substrings, equi-joined to the piece table, and the
edges are grouped by segment into a lattice. A fold with Spark's higher-order
``aggregate`` then walks it:

* a unigram model takes the Viterbi path of greatest total score;
* a BPE model's own ids are not a path of greatest total (its scores are the
  order of merges), so the fold goes through the edges by their merges' order
  and removes the one boundary inside each whose two halves stand. Where a
  segment has a piece that may come about later than its own place in that order
  (see :attr:`PieceModel.late`), the best such edge is looked for again after
  every merge.

Boundaries of a segment are bits of one long, or of an array of longs where it
has 62 characters or more; the fold is the same.

The segments that occur most often are read by every task from the shared
folder (their number is bounded). The others are gathered with the shares of
the texts (so many rows of a file) that have them, go through the lattice,
and come back to a folder for each share, which the tasks that encode the share
read. So texts are read three times (to count, to find what the common segments
lack, to encode) and neither texts nor encoded rows ever move.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagloom.llm.common import Words, distinct_parts, parquet_batches, settle, shuffle_partitions, slices
from flagloom.session import scratch_path

#: Boundaries in one long.
_BITS = 62
#: Spark's own seed of xxhash64.
_SEED = 42
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


@dataclass(frozen=True)
class PieceModel:
    """A piece table; ``pieces[i]`` has id ``i``, spaces are written as spaces."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool

    @property
    def table(self) -> dict[str, int]:
        return {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (_NORMAL, _USER)}

    @property
    def cuts(self) -> list[int]:
        """ASCII control characters that are in no piece of several characters."""
        joined = {c for p in self.table if len(p) > 1 for c in p}
        return [c for c in (*range(32), 127) if chr(c) not in joined]

    @property
    def byte_ids(self) -> list[int]:
        found = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        unknown = self.kinds.index(_UNKNOWN) if _UNKNOWN in self.kinds else 0
        return [found.get(b, unknown) for b in range(256)]

    @property
    def late(self) -> list[int]:
        """Pieces of a BPE model that merging makes of their own text, but not by one pass over
        the edges in their merges' order.

        Where a text has no edge of such a piece, one pass makes all merges: the inside
        of an edge that no merge crosses is as if alone, so if it has not become two
        pieces by the edge's own place, something crossed it and it never will."""
        table, out = self.table, []
        for p, own in table.items():
            n = len(p)
            spans = sorted((-self.scores[table[p[i:j]]], i, j) for i in range(n) for j in range(i + 2, n + 1) if p[i:j] in table)
            bounds = (1 << (n + 1)) - 1
            for _, i, j in spans:
                ends, inner = (1 << i) | (1 << j), (1 << j) - (1 << (i + 1))
                if bounds & ends == ends and (bounds & inner).bit_count() == 1:
                    bounds &= ~inner
            if n > 1 and bounds != 1 | (1 << n) and merged(p, self) == [own]:
                out.append(own)
        return out

    @property
    def unknown_score(self) -> float:
        return min(s for s, k in zip(self.scores, self.kinds) if k == _NORMAL) - 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if wire == 2 else 8 if wire == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size


def load_model(source: str | bytes) -> PieceModel:
    """Read a SentencePiece model file (or its bytes).

    Taken are unigram and BPE models with identity normalisation, a dummy
    space before the text, kept white space, and no piece that crosses a
    segment's edge; others raise ``ValueError``.
    """
    if isinstance(source, str):
        with open(source, "rb") as f:
            source = f.read()
    pieces, scores, kinds, model_type = [], [], [], 1
    rules = {1: b"", 3: 1, 4: 1}
    for number, value in _fields(source):
        if number == 1:
            part = dict(_fields(value))
            pieces.append(part.get(1, b"").decode())
            scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
            kinds.append(part.get(3, _NORMAL))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, 1)
        elif number == 3:
            rules.update(_fields(value))
    if model_type not in (1, 2):
        raise ValueError("neither a unigram nor a BPE model")
    if rules[1] not in (b"identity", b"") or not rules[3] or rules[4]:
        raise ValueError("only identity normalisation with a dummy prefix and kept white space is taken")
    model = PieceModel([p.replace("▁", " ") if k in (_NORMAL, _USER) else p for p, k in zip(pieces, kinds)],
                       scores, kinds, model_type == 1)
    for p in model.table:
        if " " in p.lstrip(" "):
            raise ValueError(f"piece {p!r} crosses segments")
    return model


def _prepared(text: Column) -> Column:
    """Dummy space, and spaces for the space mark; an empty text stays empty."""
    marked = F.replace(text, F.lit("▁"), F.lit(" "))
    return F.when(F.length(text) > 0, F.concat(F.lit(" "), marked)).otherwise(F.lit(""))


def segment_counts(docs: DataFrame, text_col: str, model: PieceModel) -> DataFrame:
    """``(segment, n)`` of all texts. Each slice of texts counts its own before the rows are grouped."""
    cuts = model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _HELD.clear()  # tables of an earlier query
        for batch in slices(batches, "_ready"):
            names, which = _Segments(batch.column("_ready"), cuts).dictionary()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()).cast(pa.string()),
                 pa.array(np.bincount(which, minlength=len(names)).astype(np.int64))], ["segment", "n"])

    ready = docs.where(F.length(text_col) > 0).select(_prepared(F.col(text_col)).alias("_ready"))
    return ready.mapInArrow(run, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def encode_segments(segments: DataFrame, model: PieceModel, keep: str = "n") -> DataFrame:
    """``(segment, keep, ids)`` for distinct ``segment`` rows of one character and more; ``keep`` is
    a column that comes along."""
    spark, table, size = segments.sparkSession, model.table, F.length("segment")
    longest = max(map(len, table))
    least = 1 if model.unigram else 2
    # an empty substring, too, so that a segment without a known piece keeps a row
    lengths = F.concat(F.when(F.col("i") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
                       F.when(size - F.col("i") >= least, F.sequence(F.lit(least), F.least(size - F.col("i"), F.lit(longest))))
                       .otherwise(F.array().cast("array<int>")))
    edges = (segments.select("segment", keep, F.explode(F.sequence(F.lit(0), size - 1)).alias("i"))
             .select("segment", keep, "i", F.explode(lengths).alias("k"))
             .select("segment", keep, "i", "k", F.substring("segment", F.col("i") + 1, F.col("k")).alias("piece")))
    if model.unigram:
        pieces = spark.createDataFrame([(p, i, float(model.scores[i])) for p, i in table.items()],
                                       "piece string, id int, score double")
        # bounded by the vocabulary, so it may be broadcast
        edges = edges.join(F.broadcast(pieces), "piece", "left").where(
            F.col("id").isNotNull() | (F.col("k") == 1))
        edge = F.struct((F.col("i") + F.col("k")).alias("j"), "i",
                        (-F.coalesce("score", F.lit(model.unknown_score))).alias("cost"), "id")
        lattice = edges.groupBy("segment", keep).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
        ids = _let(_letter_ids(model), lambda c: _viterbi_ids(F.col("edges"), _Letters(c)))
        return lattice.select("segment", keep, ids.alias("ids"))
    # place in the merges' order, start, length and id in one long, so that the edges sort by themselves
    order = {c: r for r, c in enumerate(sorted({-model.scores[i] for i in table.values()}))}
    widths = {"k": longest.bit_length(), "id": len(model.pieces).bit_length(), "place": len(order).bit_length()}
    widths["i"] = 63 - sum(widths.values())
    places = spark.createDataFrame([("", 0, 0), *((p, i, order[-model.scores[i]]) for p, i in table.items() if len(p) > 1)],
                                   "piece string, id int, place int")
    packed = F.col("place").cast("long")
    for name in ("i", "k", "id"):
        packed = F.call_function("shiftleft", packed, F.lit(widths[name])).bitwiseOR(F.col(name).cast("long"))
    edges = edges.join(F.broadcast(places), "piece")
    lattice = edges.groupBy("segment", keep).agg(F.sort_array(F.collect_list(packed)).alias("edges"))
    late = model.late
    how = widths, late, min((len(model.pieces[i]) for i in late), default=0)
    ids = _let(_letter_ids(model), lambda c: F.when(
        size < _BITS, _merged_ids(F.col("edges"), *how, _Letters(c), _OneLong(widths))).otherwise(
        _merged_ids(F.col("edges"), *how, _Letters(c), _ManyLongs(widths))))
    return lattice.select("segment", keep, ids.alias("ids"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable is never
    expanded, as a column named in many places may be."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _constants(values, kind: str = "bigint") -> Column:
    """A constant array: a text that is cut once, when the query is planned. The driver prints a plan
    again and again, constants in full: a long one is named once, by :func:`_let`."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


class _OneLong:
    """Boundaries of a segment of fewer than 62 characters. The bits of an edge's ends
    and of the boundaries between come out of tables by its length, and move to its start."""

    def __init__(self, widths: dict[str, int]):
        lengths = range(1, min(1 << widths["k"], _BITS))
        self.widths = widths
        # what is no edge (length 0, at the start) has ends that no segment has
        self.ends = _constants([-1, *(1 | 1 << k for k in lengths)])
        self.inner = _constants([0, *((1 << k) - 2 for k in lengths)])

    def opened(self, edges: Column) -> Column:
        i, k = (lambda x: _field(x, "i", self.widths)), (lambda x: _field(x, "k", self.widths))
        moved = lambda bits, x: F.call_function("shiftleft", F.get(bits, k(x)), i(x))
        return F.transform(edges, lambda x: F.struct(moved(self.ends, x).alias("ends"), moved(self.inner, x).alias("inner"),
                                                     x.alias("x")))

    def all(self) -> Column:
        return _bit(F.length("segment") + 1) - F.lit(1)

    def halves(self, bounds: Column, e: Column) -> Column:
        """Whether the edge spans exactly two standing pieces."""
        return (bounds.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(bounds.bitwiseAND(e["inner"])) == 1)

    def stands(self, bounds: Column, e: Column) -> Column:
        return bounds.bitwiseAND(e["ends"].bitwiseOR(e["inner"])) == e["ends"]

    def cleared(self, bounds: Column, e: Column) -> Column:
        return bounds.bitwiseAND(F.bitwise_not(e["inner"]))

    def pieces(self, bounds: Column) -> Column:
        """How many pieces stand."""
        return F.bit_count(bounds) - 1

    def alone(self, bounds: Column, i: Column) -> Column:
        """Whether the character at ``i`` stands alone."""
        return F.call_function("shiftright", bounds, i).bitwiseAND(F.lit(3).cast("long")) == 3


class _ManyLongs:
    """The same for longer segments: 62 boundaries in each long of an array."""

    def __init__(self, widths: dict[str, int]):
        self.widths = widths

    def opened(self, edges: Column) -> Column:
        i, k = (lambda x: _field(x, "i", self.widths)), (lambda x: _field(x, "k", self.widths))
        return F.transform(F.filter(edges, lambda x: k(x) > 0),
                           lambda x: F.struct(i(x).alias("low"), (i(x) + k(x)).alias("high"), x.alias("x")))

    def all(self) -> Column:
        last = F.length("segment") + 1
        return F.transform(F.sequence(F.lit(0), F.floor((last - 1) / _BITS).cast("int")),
                           lambda w: _bit(F.least(last - w * _BITS, F.lit(_BITS))) - F.lit(1))

    def _between(self, word: Column, e: Column) -> Column:
        """Bits of a word's boundaries strictly inside the edge."""
        clamp = lambda x: F.greatest(F.least(x - word * _BITS, F.lit(_BITS)), F.lit(0))
        return _bit(clamp(e["high"])) - _bit(clamp(e["low"] + 1))

    def _has(self, bounds: Column, p: Column) -> Column:
        return F.get(bounds, F.floor(p / _BITS).cast("int")).bitwiseAND(_bit(p % _BITS)) != 0

    def _inside(self, bounds: Column, e: Column) -> Column:
        """Boundaries inside an edge that both ends of stand; a piece is shorter than a word has bits, so
        its inside lies in two words at most."""
        word = lambda p: F.floor(p / _BITS).cast("int")
        part = lambda w: F.bit_count(F.get(bounds, w).bitwiseAND(self._between(w, e)))
        count = part(word(e["low"])) + F.when(word(e["high"]) > word(e["low"]), part(word(e["high"]))).otherwise(0)
        return F.when(self._has(bounds, e["low"]) & self._has(bounds, e["high"]), count).otherwise(-1)

    def halves(self, bounds: Column, e: Column) -> Column:
        return self._inside(bounds, e) == 1

    def stands(self, bounds: Column, e: Column) -> Column:
        return self._inside(bounds, e) == 0

    def cleared(self, bounds: Column, e: Column) -> Column:
        return F.transform(bounds, lambda x, w: x.bitwiseAND(F.bitwise_not(self._between(w, e))))

    def pieces(self, bounds: Column) -> Column:
        return F.aggregate(bounds, F.lit(-1), lambda n, x: n + F.bit_count(x))

    def alone(self, bounds: Column, i: Column) -> Column:
        return self._has(bounds, i) & self._has(bounds, i + 1)


def _field(x: Column, name: str, widths: dict[str, int]) -> Column:
    """A field of a packed edge: place, i, k, id from the high bits to the low ones."""
    below = {"i": widths["k"] + widths["id"], "k": widths["id"], "id": 0}[name]
    return F.shiftright(x, below).bitwiseAND(F.lit((1 << widths[name]) - 1).cast("long")).cast("int")


def _merged_ids(packed: Column, widths: dict[str, int], late: list[int], shortest_late: int, letters: _Letters, sets) -> Column:
    """Ids left by BPE merges: a merge takes an edge that spans exactly two standing pieces, the first
    by place in the merges' order (ties: the leftmost)."""
    size, bits = F.length("segment"), widths["id"]
    none = (1 << bits) - 1  # no id: a character that stands alone

    def fold(edges: Column) -> Column:
        def merge(bounds: Column, _: Column) -> Column:
            best = F.slice(F.filter(edges, lambda e: sets.halves(bounds, e)), 1, 1)
            return F.aggregate(best, bounds, sets.cleared)

        bounds = F.aggregate(edges, sets.all(), lambda b, e: F.when(sets.halves(b, e), sets.cleared(b, e)).otherwise(b))
        if late:
            any_late = F.exists(edges, lambda e: _field(e["x"], "id", widths).isin(late))
            bounds = F.when((size >= shortest_late) & any_late,
                            F.aggregate(F.sequence(F.lit(1), size), sets.all(), merge)).otherwise(bounds)
        start = lambda i: F.shiftleft(i.cast("long"), bits)
        found = lambda b: F.transform(F.filter(edges, lambda e: sets.stands(b, e)), lambda e: start(
            _field(e["x"], "i", widths)).bitwiseOR(_field(e["x"], "id", widths).cast("long")))
        letters_alone = lambda b: F.transform(F.filter(F.sequence(F.lit(0), size - 1), lambda i: sets.alone(b, i)),
                                              lambda i: start(i).bitwiseOR(F.lit(none).cast("long")))
        return _let(bounds, lambda b: _let(found(b), lambda f: F.when(
            F.size(f) == sets.pieces(b), F.transform(F.sort_array(f), own)).otherwise(
            _let(F.sort_array(F.concat(f, letters_alone(b))), named))))

    def own(p: Column) -> Column:
        return p.bitwiseAND(F.lit(none).cast("long")).cast("int")

    def named(path: Column) -> Column:
        at = lambda p: F.shiftright(p, bits).cast("int")
        known = F.transform(path, lambda p: F.when(own(p) < none, own(p)).otherwise(letters.of(at(p))))
        spelled = F.flatten(F.transform(path, lambda p: F.when(own(p) < none, F.array(own(p))).otherwise(letters.spelled(at(p)))))
        return _let(known, lambda ids: F.when(F.exists(ids, lambda x: x < 0), spelled).otherwise(ids))

    return _let(sets.opened(packed), fold)


@dataclass(frozen=True)
class _Letters:
    """Ids of single characters of a segment: by the place in a text of all that have one, or by their
    bytes (``constants``: what :func:`_letter_ids` gives)."""

    constants: Column

    def of(self, i: Column) -> Column:
        """The id of the character at ``i``, -1 if it has none."""
        place = F.call_function("instr", self.constants["text"], F.substring("segment", i + 1, F.lit(1)))
        return F.coalesce(F.get(self.constants["ids"], place - 1), F.lit(-1))

    def spelled(self, i: Column) -> Column:
        """Its id, or the ids of its bytes."""
        raw = F.hex(F.encode(F.substring("segment", i + 1, F.lit(1)), "UTF-8"))
        return F.when(self.of(i) >= 0, F.array(self.of(i))).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda k: F.element_at(
                self.constants["byte_ids"], F.conv(F.substring(raw, k, F.lit(2)), 16, 10).cast("int") + 1)))


def _letter_ids(model: PieceModel) -> Column:
    own = {p: i for p, i in model.table.items() if len(p) == 1}
    return F.struct(F.lit("".join(own)).alias("text"), _constants(own.values(), "int").alias("ids"),
                    _constants(model.byte_ids, "int").alias("byte_ids"))


def _viterbi_ids(edges: Column, letters: _Letters) -> Column:
    """Ids of the path of least total cost; edges are sorted by end and start. Ties
    go to the longer last piece."""
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("id"))

    def step(best: Column, e: Column) -> Column:
        path = F.struct((F.element_at(best, e["i"] + 1)["cost"] + e["cost"]).alias("cost"), e["i"].alias("i"), e["id"].alias("id"))
        return (F.when(F.size(best) <= e["j"], F.concat(best, F.array(path)))
                .when(path["cost"] < F.element_at(best, -1)["cost"],
                      F.concat(F.slice(best, 1, F.size(best) - 1), F.array(path))).otherwise(best))

    def back(best: Column) -> Column:
        def walk(at: Column, j: Column) -> Column:
            last = F.element_at(best, j + 1)
            return F.when(at["j"] == j, F.struct(last["i"].alias("j"), F.concat(
                F.array(F.struct(last["i"].alias("i"), last["id"].alias("id"))), at["path"]).alias("path"))).otherwise(at)

        end = F.struct(F.length("segment").alias("j"), F.array().cast("array<struct<i:int,id:int>>").alias("path"))
        return F.aggregate(F.sequence(F.length("segment"), F.lit(1)), end, walk, lambda at: at["path"])

    path = _let(F.aggregate(edges, F.array(start), step), back)
    return F.flatten(F.transform(path, lambda e: F.when(e["id"].isNotNull(), F.array(e["id"])).otherwise(letters.spelled(e["i"]))))


def merged(segment: str, model: PieceModel) -> list[int]:
    """Ids of one text by BPE merges, each looked up when its halves come to stand; for
    :attr:`PieceModel.late`."""
    n, table = len(segment), model.table
    after, before, alive, heap = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n, []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            k = table.get(segment[i:after[j]])
            if k is not None:
                heapq.heappush(heap, (-model.scores[k], i, j, after[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if alive[i] and j < n and alive[j] and after[i] == j and after[j] == end:
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(table.get(segment[i:after[i]], -1))
        i = after[i]
    return out


class _Segments(Words):
    """Segments of prepared texts as byte offsets, by the model's pattern."""

    def __init__(self, texts: pa.Array, cuts: list[int]):
        super().__init__(texts)
        data, size = self.data, len(self.data)
        alone = np.zeros(256, bool)
        alone[cuts] = True
        space, control = data == 32, alone[data]
        opens = control | space
        opens[1:] &= control[1:] | ~space[:-1]
        opens[1:] |= control[:-1]
        opens[self.offsets[:-1][self.offsets[:-1] < size]] = True
        self.start = np.flatnonzero(opens)
        self.end = np.append(self.start[1:], size)
        self.first = np.searchsorted(self.start, self.offsets)

    def dictionary(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct segments, and which of them each segment is; segments leave nothing out."""
        if not len(self):
            return [], np.zeros(0, np.int32)
        bounds = np.append(self.start, len(self.data)).astype(np.int64)
        return distinct_parts(bounds, self.data)


@dataclass(frozen=True)
class _Ids:
    """Ids of segments by the segments' hashes: sorted hashes, where their ids begin, how many they are."""

    hashes: np.ndarray
    begins: np.ndarray
    counts: np.ndarray
    values: np.ndarray

    @classmethod
    def read(cls, path: str) -> _Ids:
        """Piece by piece: the Arrow form is many times the size of these arrays."""
        hashes, each, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for batch in parquet_batches(path, ["hash", "ids"]):
            hashes.append(batch.column("hash").to_numpy().view(np.uint64))
            ids = batch.column("ids")
            each.append(np.diff(np.asarray(ids.offsets, dtype=np.int64)).astype(np.uint32))
            values.append(ids.flatten().to_numpy().astype(np.uint32))
        each, hashes, values = np.concatenate(each), np.concatenate(hashes), np.concatenate([*values, np.zeros(1, np.uint32)])
        order = np.argsort(hashes)
        begins = (np.cumsum(each, dtype=np.int64) - each).astype(np.uint32)  # of a bounded table
        pa.default_memory_pool().release_unused()
        return cls(hashes[order], begins[order], each[order], values)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes are here, where their ids begin and how many they are (none for those that are not)."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        hit = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        first, count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        first[hit], count[hit] = self.begins[at[hit]], self.counts[at[hit]]
        return hit, first, count


_HELD: dict[str, tuple[str, _Ids]] = {}


def _held(kind: str, path: str) -> _Ids:
    """The table at ``path``; a worker process keeps the last it read of each kind."""
    if _HELD.get(kind, ("",))[0] != path:
        _HELD.pop(kind, None)
        _HELD[kind] = path, _Ids.read(path)
    return _HELD[kind][1]


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, _SEED) for w in words], np.uint64)


def _common_segments(counts: DataFrame, most: int) -> Column:
    """Which rows are common: those of the greatest counts, ``most`` at most."""
    steps = (counts.groupBy(F.floor(F.log2("n") * 4).alias("step"))
             .agg(F.count("*").alias("segments"), F.min("n").alias("least")).orderBy(F.desc("step")).collect())
    least, total = 1 << 62, 0
    for s in steps:  # a few dozen rows: quarters of a doubling of the count
        total += s["segments"]
        if total > most:
            break
        least = s["least"]
    return F.col("n") >= least


def _by_share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one share each."""
    for batch in batches:
        if batch.num_rows:
            share = batch.column("_share").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(share)]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)


def _has_places(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` has a place in a Parquet file."""
    try:
        return "_metadata" not in docs.columns and len(docs.select("_metadata.file_path", "_metadata.row_index").columns) == 2
    except AnalysisException:
        return False


def encode(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text",
           common_segments: int = 1 << 20, share_rows: int = 1 << 14) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_tokens``, ``ids`` and ``lossless``
    (whether decoding gives the text back).

    ``common_segments`` bounds the segments that every task holds, ``share_rows`` the rows
    whose other segments it holds. Rows of Parquet files are known by their places in
    them; other frames are written first. A null or empty
    text has no ids (lossless: null, true); the mark U+2581 in a text decodes as
    a space; characters without a piece are spelled in bytes. Segments of any
    length go through the lattice. Repeated rows give repeated results, no rows
    none; other columns are ignored.
    """
    spark = docs.sparkSession
    own = [F.col(id_col).alias("_id"), F.col(text_col).alias("_text")]
    if not _has_places(docs):
        docs = settle(docs.select(*own), "piece-texts")
        own = [F.col("_id"), F.col("_text")]
    place_of = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / share_rows))
    rows = docs.select(*own, F.pmod(place_of, F.lit((1 << 31) - 1)).cast("int").alias("_share"))
    counts = settle(segment_counts(rows, "_text", model), "piece-counts", "zstd")
    often = _common_segments(counts, common_segments)
    # every task reads this bounded table from the shared folder; it never passes the driver
    common, shares = scratch_path(spark, "piece-common"), scratch_path(spark, "piece-shares")
    hashed = F.xxhash64("segment").alias("hash")
    encode_segments(counts.where(often), model).select(hashed, "ids").write.parquet(common, compression="zstd")
    cuts = model.cuts
    ready = rows.where("_text IS NOT NULL").select("_share", "_id", _prepared(F.col("_text")).alias("_ready"),
                                                   F.xxhash64("_text").alias("_sum"))

    def lacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = _held("common", common)
        for batch in slices(_by_share(batches), "_ready"):
            share = batch.column("_share")[0].as_py()
            names, _ = _Segments(batch.column("_ready"), cuts).dictionary()
            hit, _, _ = book.places(_hashed(names))
            gone = [names[x] for x in np.flatnonzero(~hit).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.binary()).cast(pa.string()),
                                              pa.array([share] * len(gone), pa.int32())], ["segment", "share"])

    # a rare segment is in fewer shares than the least count of a common one
    rare = (ready.mapInArrow(lacking, "segment string, share int").repartition(shuffle_partitions(spark), "segment")
            .groupBy("segment").agg(F.sort_array(F.collect_set("share")).alias("shares")))
    (encode_segments(rare, model, "shares").select(hashed, "ids", F.explode("shares").alias("_share"))
     .repartition(shuffle_partitions(spark), "_share").write.partitionBy("_share").parquet(shares, compression="zstd"))
    spelling = spark.sparkContext.broadcast(_spellings(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, words = _held("common", common), spelling.value
        for batch in slices(_by_share(batches), "_ready"):
            own = _held("share", f"{shares}/_share={batch.column('_share')[0].as_py()}")
            found = _Segments(batch.column("_ready"), cuts)
            names, place = found.dictionary()
            hashes = _hashed(names)
            hit, first, count = book.places(hashes)
            rest = np.flatnonzero(~hit)
            more, at, size = own.places(hashes[rest])
            if not more.all():
                raise ValueError("a segment was in no earlier read of these texts: their files have changed")
            # the share's own ids stand behind the common ones
            first[rest], count[rest] = at + len(book.values), size
            first, count = first[place], count[place]
            begins = np.concatenate(([0], np.cumsum(count)))
            index = np.repeat(first - begins[:-1], count) + np.arange(begins[-1])
            tokens = np.empty(len(index), np.int32)
            here = index < len(book.values)
            tokens[here], tokens[~here] = book.values[index[here]], own.values[index[~here] - len(book.values)]
            ends = begins[found.first]
            same = []
            for a, b, total in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column("_sum").to_numpy().view(np.uint64).tolist()):
                decoded = _decode_bytes(tokens[a:b], words).decode("utf-8", "replace").encode()
                same.append(xxhash.xxh64_intdigest(decoded, _SEED) == total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(np.diff(ends).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(tokens)), pa.array(same, pa.bool_())],
                ["_id", "n_tokens", "ids", "lossless"])

    kind = rows.schema["_id"].dataType.simpleString()
    done = ready.mapInArrow(run, f"_id {kind}, n_tokens long, ids array<int>, lossless boolean")
    empty = rows.where("_text IS NULL").select(
        F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<int>").alias("ids"),
        F.lit(None).cast("boolean").alias("lossless"))
    return done.select(F.col("_id").alias(id_col), "n_tokens", "ids", "lossless").unionByName(empty)


def _spellings(model: PieceModel) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if k == _BYTE else p.encode() if k in (_NORMAL, _USER) else
            " ⁇ ".encode() if k == _UNKNOWN else b"" for p, k in zip(model.pieces, model.kinds)]


def _decode_bytes(ids: np.ndarray, words: list[bytes]) -> bytes:
    return b"".join([words[i] for i in ids.tolist()])[1:]


def decode(encoded: DataFrame, model: PieceModel, ids_col: str = "ids", to_col: str = "text") -> DataFrame:
    """``encoded`` with the text of each id list (``to_col``; an existing one is
    replaced). A null list gives null, an empty one the empty text; an id out of
    the table is an error; broken byte runs become U+FFFD."""
    names = [c for c in encoded.columns if c != to_col]
    texts = encoded.sparkSession.sparkContext.broadcast(_spellings(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x.as_py() is None else _decode_bytes(np.array(x.as_py(), np.int64), texts.value)
                   .decode("utf-8", "replace") for x in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())],
                                             [*names, to_col])

    kept = encoded.select(*names)
    return kept.mapInArrow(run, encoded.select(*names).schema.add(to_col, "string"))
