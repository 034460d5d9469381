"""Substring de-duplication against window-by-window brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from flagloom.llm import substring

SCHEMA = "doc_id long, text string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    last = 1 << 70
    cut = [(last if i is None else i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, ws in cut:
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s:s + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for (ident, _), (i, ws) in zip(rows, cut):
        gone = set()
        for s in range(len(ws) - window + 1):
            if least[tuple(ws[s:s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((ident, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def make_rows(window):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)]
                for n in (window - 1, window, window + 1, 2 * window, 3 * window + 7)]
    rows = [(None, " ".join(passages[3])), (1, None), (2, ""), (3, "  x \x1f y "), (4, "é " * (window + 5))]
    for i in range(5, 45):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice("xyz") + str(rng.randrange(10**6)) for _ in range(rng.randrange(0, 30))]
            words += rng.choice(passages)
        rows.append((i if i % 9 else i - 1, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows + rows[10:13] + [(99, " ".join(passages[4] * 300))]


@pytest.mark.parametrize("window", [4, 50])
def test_matches_brute_force(spark, window):
    rows = make_rows(window)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = substring.drop_repeats(df, window=window).select("_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, window)


def test_many_flushes_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(substring, "_FLUSH", 50)
    rows = make_rows(6)
    df = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)
    got = substring.drop_repeats(df, window=6, buckets=37).select("_id", "n_words", "n_removed", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 6)


def test_cut_keeps_columns_and_untouched_texts(spark):
    df = spark.createDataFrame([(1, "a b\n c d e", "k"), (2, "x a b c d y", "l"), (3, None, "m")], SCHEMA)
    got = {r["doc_id"]: tuple(r) for r in substring.cut_repeats(df, window=4).collect()}
    assert got == {1: (1, "a b\n c d e", "k"), 2: (2, "x y", "l"), 3: (3, None, "m")}


def test_empty_table_and_odd_window(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring.drop_repeats(df).count() == 0
    with pytest.raises(ValueError):
        substring.drop_repeats(df, window=5)


@pytest.mark.parametrize("size", [1024, 4096, 8192])
def test_structured_words_are_told_apart(spark, size):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo powers of two."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    other = one.translate(str.maketrans("ab", "ba"))
    common = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([*common, one, *common])), (2, " ".join([*common, other, *common])), (3, " ".join([*common, one, *common]))]
    df = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)
    got = substring.drop_repeats(df, window=50).select("_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 50)


def hot_rows():
    """A third of the documents share one run of 25 words, many times each; some share whole windows."""
    rng = random.Random(11)
    run = [f"hot{i}" for i in range(25)]
    rows = []
    for i in range(90):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
        if i % 3 == 0:
            for _ in range(4):
                at = rng.randrange(len(words))
                words[at:at] = run * (2 if i % 9 == 0 else 1)
        rows.append((i, " ".join(words)))
    return rows


def test_a_hot_run_is_one_entry_a_share():
    rows = hot_rows()
    batch = pa.RecordBatch.from_pydict({"_share": pa.array([3] * len(rows), pa.int32()), "_id": [i for i, _ in rows],
                                        "_text": [t for _, t in rows]})
    keys = []
    for out in substring._runs(50, 7)(iter([batch, batch])):
        for r in out.to_pylist():
            assert r["share"] == 3 and 0 <= r["bucket"] < 7
            own = np.frombuffer(r["key"], np.uint32)
            assert len(set(own.tolist())) == len(own)
            keys.append((r["bucket"], own))
    assert len(keys) <= 7  # one flush: each run of both batches once, however often it occurs


def test_hot_runs_over_many_shares_and_buckets(spark):
    rows = hot_rows() + [(200, None), (None, " ".join(f"hot{i}" for i in range(25)) * 3)]
    df = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)
    for how in ({}, {"share_bytes": 2000, "bucket_bytes": 1000}):
        got = substring.drop_repeats(df, window=50, **how).select("_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, 50)
