"""The corpus pipeline against a brute-force version, stage by stage."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from flagloom.llm import mixing, quality
from flagloom.llm.common import settle
from test_simhash_dedup import brute as simhash_brute
from test_substring_dedup import WORD

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small documents and labels pair with planted copies, passages and toxic rows."""
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows, labels = [], []
    for i in range(260):
        words = [rng.choice(vocab) for _ in range(rng.randrange(60, 160))]
        if i % 8 == 1:
            words[5:5] = passage
        toxic = i % 5 == 2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["moron", "scum"])
        rows.append((i, " ".join(words), "en", f"s{min(i % 9, 3)}", 0))
        labels.append((i, int(i % 10 != 4), int(toxic)))
        if i % 10 == 4:
            rows[-1] = (i, " ".join(w + "%%" for w in words), "en", "s0", 0)
    for j in range(30):
        src = rows[j * 5]
        words = src[1].split(" ")
        if j % 2:
            words[3] = "changed"
        rows.append((1000 + j, " ".join(words), "en", "s1", 0))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s2", 0), (2002, "short text", "en", None, 10)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def cut(rows, window=50):
    """Texts without the windows that an earlier document has."""
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, ws in split:
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s:s + window])
            least[key] = min(i, least.get(key, i))
    out = {}
    for (i, t), (_, ws) in zip(rows, split):
        gone = {p for s in range(len(ws) - window + 1) if least[tuple(ws[s:s + window])] < i for p in range(s, s + window)}
        out[i] = " ".join(w for p, w in enumerate(ws) if p not in gone) if gone else t
    return out


def test_stages_and_run_match_brute_force(spark, folder):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup",
                                         "mixing sources to target weights", "SentencePiece encoding and decoding"]
    docs, seen = cp.read(spark, folder, "documents"), []
    for name, stage in cp.STAGES:
        seen.append(docs.collect())
        if name == "mixing sources to target weights":
            passes = {r["doc_id"]: r["n"] for r in mixing.mix_sources(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        docs = settle(stage(spark, docs, folder), "test-stage")
        if name != cp.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    raw, good, single, clean, mixed = seen

    # quality: the fitted model's own judgement, and what it must catch and keep
    kept = {r["doc_id"] for r in good}
    model = quality.fit(cp.read(spark, folder, "documents"), quality.grades_of_labels(cp.read(spark, folder, "labels")))
    judged = quality.grade(cp.read(spark, folder, "documents"), model).where("accepted").collect()
    assert kept == {r["doc_id"] for r in judged}
    toxic = {r["doc_id"] for r in raw if r["text"] and ("moron" in r["text"] or "scum" in r["text"])}
    plain = {r["doc_id"] for r in raw if r["text"] and r["doc_id"] not in toxic and "%%" not in r["text"]}
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(kept & plain) >= 0.9 * len(plain)

    # one of each near-duplicate group
    groups = simhash_brute([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted(i for i, _, c in groups if i == c)

    # repeated passages are cut
    want = cut([(r["doc_id"], r["text"]) for r in single])
    assert {r["doc_id"]: r["text"] for r in clean} == want
    assert sum(a["text"] != b["text"] for a, b in zip(sorted(single), sorted(clean))) >= 5
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean)

    # mixing repeats rows and drops none
    count = {}
    for r in mixed:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == passes and set(count) == set(want)

    # ids of the library
    library = sentencepiece.SentencePieceProcessor(model_file=cp.PIECE_MODEL)
    ids = sorted((r["doc_id"], library.encode(r["text"] or "")) for r in mixed)
    assert sorted((r["doc_id"], list(r["ids"])) for r in docs.collect()) == ids
    assert sorted((r["doc_id"], list(r["ids"])) for r in cp.run(spark, folder).collect()) == ids


def test_clashing_columns_come_through(spark, folder):
    docs = cp.read(spark, folder, "documents").limit(30).withColumns(
        {c: F.lit(f"own {c}") for c in ("accepted", "mix_pass", "n_words", "fingerprint", "simhash", "tokens", "_starts")})
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        assert {r["accepted"] for r in got.collect()} == {"own accepted"} == {r["accepted"] for r in docs.collect()}
        assert {r["mix_pass"] for r in got.collect()} == {"own mix_pass"}


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        cp.read(spark, folder, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
