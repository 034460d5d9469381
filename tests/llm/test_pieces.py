"""Piece lattice against the public library (BPE) and against all segmentations (unigram)."""

import itertools
import random

import pytest
import sentencepiece

from flagloom.llm import pieces
from flagloom.llm.queries import PIECE_MODEL

SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def bpe():
    return pieces.load_model(PIECE_MODEL)


def toy(unigram=True):
    rng = random.Random(4)
    names = ["<unk>"] + [f"<0x{b:02X}>" for b in range(256)]
    kinds = [2] + [6] * 256
    found = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(30)} | {"a", "b", " ", " a", " ab", "  "})
    return pieces.PieceModel(names + found, [0.0] * 257 + [-rng.randrange(1, 40) / 4 for _ in found], kinds + [1] * len(found), unigram)


def texts():
    rng = random.Random(9)
    words = ["the", "antidisestablishment", "é", "漢字", "😀", "naïve", "x", "...", "\r\n", "\t", "a1b2", "  ", "▁"]
    rows = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, "  lead and trail  "), (5, "same id"), (6, "a" * 400 + " b"),
            (7, "é" * 100 + "\x00\x7f;\r"), (None, "no id"), (8, "no id"), (9, " " * 90)]
    rows += [(400 + n, "a" + " " * n + "b" + " " * n) for n in (15, 16, 17, 32, 40)]
    rows += [(20 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(40)]
    return rows + [(99, "long words here, again and again. " * 4000)]


@pytest.mark.parametrize("common", [1 << 21, 12, 0])
def test_bpe_ids_equal_the_library(spark, bpe, common):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    rows = texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = pieces.encode(df, bpe, common_segments=common)
    assert got.columns == ["doc_id", "n_tokens", "ids", "lossless"]
    have = sorted(((r["doc_id"], r["n_tokens"], list(r["ids"]), r["lossless"]) for r in got.collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), ids, None if t is None else "▁" not in t))
    assert have == sorted(want, key=str)


def test_rows_of_files_are_known_by_their_places(spark, bpe, tmp_path):
    """From files no text is written again; shares of few rows, more partitions, a filter and repeated rows change nothing."""
    rows = [(i, t) for i, t in texts() if t is None or len(t) < 5000] * 2
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    assert pieces._has_places(read) and pieces._has_places(read.where("doc_id > 3").repartition(7))
    assert not pieces._has_places(df) and not pieces._has_places(read.withColumn("_metadata", read.text))
    want = sorted(map(str, pieces.encode(df, bpe, common_segments=20).collect()))
    assert sorted(map(str, pieces.encode(read.repartition(5), bpe, common_segments=20, share_rows=7).collect())) == want
    few = pieces.encode(read.where("doc_id > 3"), bpe, common_segments=0).coalesce(1)
    assert few.count() == df.where("doc_id > 3").count()


def test_decode_round_trip(spark, bpe):
    rows = [(i, t) for i, t in texts() if t is None or "▁" not in t]
    df = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)
    back = pieces.decode(pieces.encode(df, bpe), bpe)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    lists = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decode(lists, bpe).collect()} == {1: None, 2: ""}


def segmentations(s, table):
    if not s:
        yield []
    for j in range(1, len(s) + 1):
        if s[:j] in table or j == 1:
            for rest in segmentations(s[j:], table):
                yield [s[:j], *rest]


def cost(parts, model):
    table = model.table
    return -sum(model.scores[table[p]] if p in table else model.unknown_score for p in parts)


def test_viterbi_takes_the_greatest_total(spark):
    model = toy()
    table, segments = model.table, ["".join(x) for n in (1, 2, 5) for x in itertools.product("abcx", repeat=n)][::7]
    segments += [" " + s for s in segments[::5]]
    df = spark.createDataFrame([(s, 1) for s in sorted(set(segments))], "segment string, n long")
    spelled = {f"<0x{b:02X}>": b for b in range(256)}
    for r in pieces.encode_segments(df, model).collect():
        names = [model.pieces[i] for i in r["ids"]]
        parts = [chr(spelled[p]) if p in spelled else p for p in names]
        assert "".join(parts) == r["segment"]
        best = min(cost(p, model) for p in segmentations(r["segment"], table))
        assert cost(parts, model) == pytest.approx(best)


def test_viterbi_of_long_segments(spark):
    model = toy()
    table, rng = model.table, random.Random(6)
    segments = ["".join(rng.choice("abcx") for _ in range(n)) for n in (61, 62, 63, 300)]
    spelled = {f"<0x{b:02X}>": b for b in range(256)}
    df = spark.createDataFrame([(s, 1) for s in segments], "segment string, n long")
    for r in pieces.encode_segments(df, model).collect():
        s, best = r["segment"], [0.0]
        for j in range(1, len(s) + 1):
            best.append(min(best[i] + cost([s[i:j]], model) for i in range(max(0, j - 5), j) if s[i:j] in table or j - i == 1))
        parts = [chr(spelled[p]) if p in spelled else p for p in (model.pieces[i] for i in r["ids"])]
        assert "".join(parts) == s and cost(parts, model) == pytest.approx(best[-1])


def pair_by_pair(segment, model):
    table, parts = model.table, list(segment)
    while True:
        pairs = [(-model.scores[table[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in table]
        if not pairs:
            return [i for p in parts for i in ([table[p]] if p in table else [model.byte_ids[x] for x in p.encode()])]
        _, i = min(pairs)
        parts[i:i + 2] = ["".join(parts[i:i + 2])]


def test_merges_match_pair_by_pair_restatement(spark):
    model, rng = toy(unigram=False), random.Random(2)
    assert model.late  # pieces of any order: each merge is looked for anew where one of these is
    segments = {"".join(rng.choice("abc é") for _ in range(rng.randrange(1, 20))) for _ in range(150)}
    segments |= {"".join(rng.choice("abc") for _ in range(n)) for n in (60, 61, 62, 63, 64, 130)}
    df = spark.createDataFrame([(s, 1) for s in segments], "segment string, n long")
    for r in pieces.encode_segments(df, model).collect():
        assert list(r["ids"]) == pair_by_pair(r["segment"], model), r["segment"]


def learned(seed):
    """A BPE model whose pieces are merges in the order in which they were learned."""
    rng = random.Random(seed)
    words = [list(" " + "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))) for _ in range(60)]
    merges = []
    for _ in range(25):
        pairs = sorted((a + b) for w in words for a, b in zip(w, w[1:]) if a + b not in merges)
        if not pairs:
            break
        best = max(set(pairs), key=lambda p: (pairs.count(p), p))
        merges.append(best)
        for w in words:
            i = 0
            while i + 1 < len(w):
                if w[i] + w[i + 1] == best:
                    w[i:i + 2] = [best]
                i += 1
    names = ["<unk>"] + [f"<0x{b:02X}>" for b in range(256)] + list(" abcd") + merges
    scores = [0.0] * 257 + [-1000.0 - i for i in range(5)] + [-float(i) for i in range(len(merges))]
    return pieces.PieceModel(names, scores, [2] + [6] * 256 + [1] * (len(names) - 257), False)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_pass_merges_as_pair_by_pair(spark, seed):
    model, rng = learned(seed), random.Random(seed)
    assert not model.late
    segments = {" " + "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 30))) for _ in range(120)}
    segments |= {"".join(rng.choice("abcd") for _ in range(n)) for n in (61, 62, 63, 124, 125, 700)}
    df = spark.createDataFrame([(s, 1) for s in segments], "segment string, n long")
    for r in pieces.encode_segments(df, model).collect():
        assert list(r["ids"]) == pair_by_pair(r["segment"], model), r["segment"]


def test_late_pieces_of_the_public_model(bpe):
    assert bpe.late == [bpe.table[" " * 16]]
    assert pieces.merged(" the", bpe) == [bpe.table[" the"]]


def test_no_segment_is_crossed(spark, bpe):
    rows = [(i, t) for i, t in texts() if t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {r["segment"]: r["n"] for r in pieces.segment_counts(df, "text", bpe).collect()}
    for s in counts:
        assert " " not in s.lstrip(" ") and (len(s) == 1 or not any(ord(c) in bpe.cuts for c in s))
    assert sum(len(s) * n for s, n in counts.items()) == sum(len(t) + 1 for _, t in rows)
    assert max(map(len, counts)) > 400


def test_other_models_are_refused():
    with open(PIECE_MODEL, "rb") as f:
        data = f.read()
    with pytest.raises(ValueError):
        pieces.load_model(data.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x03"))
    assert pieces.load_model(data.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01")).unigram


def test_empty_table(spark, bpe):
    df = spark.createDataFrame([], SCHEMA)
    assert pieces.encode(df, bpe).count() == 0


def test_the_plan_names_its_constants_once(spark, bpe):
    """The driver prints the plan for every event, constants in full."""
    letters = "".join(p for p in bpe.table if len(p) == 1)
    df = spark.createDataFrame([(" word", 1)], "segment string, n long")
    plan = pieces.encode_segments(df, bpe)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(letters) == 1 and len(plan) < 20_000 + 10 * len(letters)


def test_bpe_of_segments_about_as_long_as_a_long_has_bits(spark, bpe):
    rng = random.Random(12)
    segments = [" " + "".join(rng.choice("etaoin漢é😀ß") if i % 7 == 0 else rng.choice("etaoinshr") for i in range(n - 1))
                for n in (1, 2, 3, 17, 60, 61, 62, 63, 64, 125)]
    df = spark.createDataFrame([(s, 1) for s in segments], "segment string, n long")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    have = {r["segment"]: list(r["ids"]) for r in pieces.encode_segments(df, bpe).collect()}
    assert have == {s: library.encode(s[1:]) or [bpe.table[" "]] for s in segments}
