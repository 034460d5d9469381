"""Phrase collocation mining by best-first branch-and-bound growth.

Texts are cut into pieces, pieces into words; a phrase is a run of words of one
piece. A phrase's score is ``floor(10^6 a^2 / (l r))`` for its count ``a`` and the
counts of its two parts at the cut that scores least. Phrases grow word by word
from the words themselves:

* A prefix can only grow into a candidate while it occurs often enough itself,
  so pairs grow from frequent words, triples from frequent pairs.
* A triple ``xyz`` occurs at most as often as ``xy`` and as the most frequent pair
  that begins with ``y``, and ``yz`` at least as often as ``xyz``. So no triple that
  grows from ``xy`` scores more than ``10^6 min(f(xy), max f(y.)) / f(x)``.

Best first: each round sets a score for every language below which nothing is
looked at yet, and expands the prefixes whose bound reaches it, together with
those whose triples decide whether a pair of such a score survives. A language
is settled when enough phrases that reach its score survive; then nothing
unexpanded can enter its result. For the others the score falls to where twice
as many phrases lie. Ties of that score are always expanded with it.

An expansion is one pass over the texts. The frontier goes to the tasks as a
Bloom filter of a fixed number of bits, so a task leaves out most other phrases
before the shuffle; the exact frontier is joined to what remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flagloom.llm.common import Words, mix, settle, slices

_ROWS = 1 << 16
_SPREAD = mix(np.arange(901, 905, dtype=np.uint64)) | np.uint64(1)
_SALTS = 16


class PieceWords(Words):
    """Words ``[^\\x20\\x09]+`` of pieces split at ``[.,;:!?\\x0A-\\x0D]``, A-Z lower-cased."""

    _HARD = np.zeros(256, bool)
    _HARD[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    _SEP = _HARD.copy()
    _SEP[[0x20, 0x09]] = True

    def __init__(self, texts: pa.Array):
        super().__init__(texts, lower=True)
        self.text_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self) -> np.ndarray:
        """Whether each word but the last is in one piece with the next."""
        hard = np.concatenate(([0], np.cumsum(self._HARD[self.data], dtype=np.int32)))
        return (hard[self.start[1:]] == hard[self.end[:-1]]) & (self.text_of[1:] == self.text_of[:-1])


def _keys(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit key of phrases from the hashes of their language and words."""
    h = lang * _SPREAD[0]
    for i, w in enumerate(words):
        h = h + w * _SPREAD[i + 1]
    return mix(h)


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys >> np.uint64(64 - bits), mix(keys) >> np.uint64(64 - bits)


def _hash(names: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)


def bloom(phrases: DataFrame, words: int, bits: int) -> np.ndarray:
    """Bits of the rows (lang, phrase) of ``words`` words each; as many as asked for, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = batch.column("lang").dictionary_encode()
            lang = _hash([x.encode() for x in langs.dictionary.to_pylist()])[langs.indices.to_numpy()]
            each = Words(batch.column("phrase")).identities().reshape(-1, words)
            keys = _keys(lang, [each[:, i] for i in range(words)])
            place = np.concatenate(_places(keys, bits))
            at, bit = (place >> np.uint64(6)).astype(np.int32), np.uint64(1) << (place & np.uint64(63))
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[order][first]), pa.array(np.bitwise_or.reduceat(bit[order], first).view(np.int64))],
                ["at", "bits"])

    # at most 2^bits / 64 rows
    found = (phrases.select("lang", "phrase").mapInArrow(run, "at int, bits long")
             .groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _in(filter_: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for place in _places(keys, bits):
        hit &= (filter_[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def _counted(words: int, bits: int, prefixes=None, suffixes=None):
    """Phrases of ``words`` words of each slice with their counts; of those the
    filters (broadcasts) know the first and the last ``words - 1`` words of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = PieceWords(batch.column("text"))
            if len(found) < words:
                continue
            names, word = found.dictionary()
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy()[found.text_of]
            at = np.arange(len(found) - words + 1)
            if words > 1:
                joined = found.joined()
                at = at[np.logical_and.reduce([joined[i:len(joined) - words + 2 + i] for i in range(words - 1)])]
            key, example, n = lang[at].astype(np.int64), at, None
            for i in range(words):  # numbers stay below slices' phrases times words
                key, example, number, n = _numbered(key * len(names) + word[at + i], at)
                key = number
            if not len(example):
                continue
            own = lang[example]
            parts = [word[example + i] for i in range(words)]
            if words > 1:
                hashes, of_lang = _hash(names), _hash([x.encode() for x in langs.dictionary.to_pylist()])[own]
                each = [hashes[p] for p in parts]
                keep = (_in(prefixes.value, _keys(of_lang, each[:-1]), bits)
                        & _in(suffixes.value, _keys(of_lang, each[1:]), bits))
                own, n, parts = own[keep], n[keep], [p[keep] for p in parts]
            table = pa.array(names, pa.binary())
            for a in range(0, len(n), _ROWS):
                texts = [table.take(pa.array(p[a:a + _ROWS])) for p in parts]
                phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary())) if words > 1 else texts[0]
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(own[a:a + _ROWS])), phrase.cast(pa.string()),
                     pa.array(n[a:a + _ROWS], pa.int64())], ["lang", "phrase", "n"])

    return run


def _numbered(key: np.ndarray, at: np.ndarray):
    _, first, number, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return None, at[first], number, n


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(10^6 a^2 / (left right))`` in exact decimals (counts below 10^15)."""
    big = lambda c: c.cast("decimal(15,0)")
    over, under = F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right)
    return F.call_function("div", over, under)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 2000, least: int = 10,
         absorb: int = 50, bits: int = 23) -> DataFrame:
    """The ``top`` best phrases of two or three words of every language: ``lang``,
    ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of its parts at the cut
    that scores least), ``n`` (all words of the language) and ``score``.

    A-Z are lower-cased. Phrases that occur fewer than ``least`` times are none;
    one that lies inside a longer one with at least ``absorb`` % of its count is
    dropped. Order: score, count (both falling), phrase in the order of UTF-8
    bytes. A null language is ``und``, a null text empty; repeated rows count as
    often as they occur; languages without a phrase and empty tables give no
    rows; other columns are ignored. ``bits`` sets the size of the filters
    (2^``bits`` bits), not the result.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                         F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def counts(words: int, prefixes=None, suffixes=None) -> DataFrame:
        return (source.mapInArrow(_counted(words, bits, prefixes, suffixes), "lang string, phrase string, n long")
                .groupBy("lang", "phrase").agg(F.sum("n").alias("a")))

    def filter_of(phrases: DataFrame, words: int):
        return spark.sparkContext.broadcast(bloom(phrases, words, bits))

    every = settle(counts(1), "phrases-words")
    totals = settle(every.groupBy("lang").agg(F.sum("a").alias("n")), "phrases-totals")
    common = settle(every.where(F.col("a") >= least), "phrases-common")
    of_words = filter_of(common, 1)
    pairs = settle(counts(2, of_words, of_words).where(F.col("a") >= least), "phrases-pairs")
    of_words.unpersist()

    word = lambda name, count: common.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    first, second = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    pairs = pairs.withColumns({"first": first, "second": second})
    follow = pairs.groupBy("lang", "first").agg(F.max("a").alias("follow")).withColumnRenamed("first", "second")
    pairs = settle(pairs.join(word("first", "l"), ["lang", "first"]).join(word("second", "r"), ["lang", "second"])
                   .join(follow, ["lang", "second"], "left")
                   .withColumns({"score": _score(F.col("a"), F.col("l"), F.col("r")),
                                 "bound": F.when(F.col("follow").isNotNull(), _ratio(F.least("a", "follow"), F.col("l")))}), "phrases-scored")
    if pairs.isEmpty():
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    of_pairs = filter_of(pairs, 2)
    triples = spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, score long")
    grown = pairs.select("lang", "phrase").limit(0)
    open_, settled, goal = pairs.select("lang").distinct(), None, 2 * top
    columns = ["lang", "phrase", "a", "l", "r", "score"]

    def surviving() -> DataFrame:
        """Pairs that no known triple absorbs, and the known triples."""
        inside = (triples.select("lang", "a", F.explode(F.array(
            F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
        alive = (pairs.join(inside, ["lang", "phrase"], "left")
                 .where(F.col("longer").isNull() | (100 * F.col("longer") < absorb * F.col("a"))))
        return alive.select(*columns).unionByName(triples.select(*columns))

    alive = settle(surviving(), "phrases-alive")
    while True:
        floors = settle(_floors(alive.join(open_, "lang", "left_semi"), goal), "phrases-floors")
        known = F.col("score") >= F.col("floor")
        need = (pairs.select("lang", "phrase", "first", "a", "score").join(floors, "lang").where(known)
                .join(alive.select("lang", "phrase"), ["lang", "phrase"], "left_semi"))
        # a pair's prefix grows if it may absorb the pair, or one that begins with its second word
        starts = need.groupBy("lang", F.col("first").alias("second")).agg(F.min("a").alias("needed"))
        may = pairs.where(F.col("bound").isNotNull())
        wanted = (may.join(floors, "lang").where(F.col("bound") >= F.col("floor")).select("lang", "phrase")
                  .unionByName(may.join(need.select("lang", "phrase"), ["lang", "phrase"], "left_semi")
                               .where(100 * F.col("follow") >= absorb * F.col("a")).select("lang", "phrase"))
                  .unionByName(may.join(starts, ["lang", "second"])
                               .where(100 * F.col("a") >= absorb * F.col("needed")).select("lang", "phrase"))
                  .distinct())
        fresh = settle(wanted.join(grown, ["lang", "phrase"], "left_anti"), "phrases-frontier")
        if not fresh.isEmpty():
            of_fresh = filter_of(fresh, 2)
            more = settle(counts(3, of_fresh, of_pairs).where(F.col("a") >= least)
                          .withColumn("prefix", F.substring_index("phrase", " ", 2))
                          .join(fresh.select("lang", F.col("phrase").alias("prefix")), ["lang", "prefix"], "left_semi"),
                          "phrases-grown")
            of_fresh.unpersist()
            pair = lambda name, count: pairs.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
            one = _score(F.col("a"), F.col("l1"), F.col("r1"))
            two = _score(F.col("a"), F.col("l2"), F.col("r2"))
            scored = (more.withColumns({"first": first, "third": second, "suffix": F.substring_index("phrase", " ", -2)})
                      .join(pair("prefix", "l2"), ["lang", "prefix"]).join(pair("suffix", "r1"), ["lang", "suffix"])
                      .join(word("first", "l1"), ["lang", "first"]).join(word("third", "r2"), ["lang", "third"])
                      .withColumns({"s1": one, "s2": two}))
            later = F.col("s2") < F.col("s1")
            scored = scored.select("lang", "phrase", "a", F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                                   F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"),
                                   F.least("s1", "s2").alias("score"))
            triples = settle(triples.unionByName(scored), "phrases-triples")
            grown = settle(grown.unionByName(fresh), "phrases-known")
            alive = settle(surviving(), "phrases-alive")
        reached = (alive.join(floors, "lang").where(known).groupBy("lang").agg(F.count("*").alias("m")))
        states = settle(floors.join(reached, "lang", "left")
                        .withColumn("done", (F.coalesce("m", F.lit(0)) >= top) | (F.col("floor") < 0)), "phrases-states")
        now = states.where("done").select("lang", "floor")
        settled = now if settled is None else settled.unionByName(now)
        open_ = states.where("NOT done").select("lang")
        if open_.isEmpty():
            break
        goal *= 2

    best = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"), "phrase")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = (alive.join(settled, "lang").where(F.col("score") >= F.col("floor"))
            .withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
            .withColumn("n", F.row_number().over(best)).where(F.col("n") <= top)
            .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .drop("n").join(totals, "lang"))
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ratio(part: Column, whole: Column) -> Column:
    """The bound ``floor(10^6 part / whole)``."""
    return _score(part, whole, part)


def _floors(alive: DataFrame, goal: int) -> DataFrame:
    """``(lang, floor)``: a score that at least ``goal`` of the rows reach, or -1
    where there are fewer. Scores are counted in steps of a sixteenth of a
    doubling, so a few hundred rows a language are ordered."""
    step = F.floor(F.log2(F.col("score") + 1) * 16)
    steps = (alive.groupBy("lang", step.alias("step"))
             .agg(F.count("*").alias("m"), F.min("score").alias("low")))
    so_far = F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    return (steps.withColumn("so_far", so_far).groupBy("lang")
            .agg(F.coalesce(F.max(F.when(F.col("so_far") >= goal, F.col("low"))), F.lit(-1).cast("long")).alias("floor")))
