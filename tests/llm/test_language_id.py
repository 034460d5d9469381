"""Conditional random field: exact chains by brute force, accuracy on planted languages."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from flagloom.llm import crf
from flagloom.llm.common import Words

ALPHABETS = {"aa": "abcde", "bb": "fghij", "cc": "éèçàù"}


def sentence(lang, n, rng):
    return [rng.choice(ALPHABETS[lang]) * rng.randrange(1, 3) + rng.choice(ALPHABETS[lang]) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    langs = [lang for lang in ALPHABETS for _ in range(12)]
    return crf.learn([" ".join(sentence(x, 60, rng)) for x in langs], langs, rounds=15)


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(4)
    emit, moves, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = [0, 4, 4, 5]  # texts of 4, 0, 1 and 4 words
    p, q, _ = crf.forward_backward(emit, np.array(first), moves, start)
    got = p * q / (p * q).sum(axis=1, keepdims=True)
    want = np.zeros_like(got)
    for a, b in zip(first, [*first[1:], 9]):
        for path in itertools.product(range(3), repeat=b - a):
            w = start[path[0]] if path else 0
            w += sum(emit[a + t, x] for t, x in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:]))
            for t, x in enumerate(path):
                want[a + t, x] += np.exp(w)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(got, want)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 400])
def test_blocks_do_not_change_a_text_alone(n):
    rng = np.random.default_rng(n)
    emit, moves, start = rng.normal(size=(2 * n, 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    p, q, _ = crf.forward_backward(emit, np.array([0, n]), moves, start)
    for a in (0, n):
        x, y, _ = crf.forward_backward(emit[a:a + n], np.array([0]), moves, start)
        one, both = x * y, (p * q)[a:a + n]
        assert np.allclose(one / one.sum(1, keepdims=True), both / both.sum(1, keepdims=True))


def test_code_switched_words_get_their_own_labels(model):
    rng = random.Random(2)
    text = sentence("aa", 30, rng) + sentence("cc", 30, rng) + sentence("bb", 30, rng)
    labels = crf.probabilities(Words(pa.array([" ".join(text)])), model).argmax(axis=1)
    want = [model.langs.index(x) for x in ("aa", "cc", "bb") for _ in range(30)]
    assert np.mean(labels == want) > 0.95


def test_identify_defined_cases(spark, model):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " 12 34 --- \n"), (4, "… — ١٢"), (5, " ".join(sentence("bb", 20, rng))),
            (5, " ".join(sentence("aa", 20, rng))), (None, " ".join(sentence("cc", 40000, rng))), (7, "ÉÈ éé")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, score string")
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in crf.identify(df, model).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "bb"), (5, "aa"), (None, "cc"), (7, "cc")],
                         key=str)
    for r in crf.identify(df, model).collect():
        assert 0 <= r["score"] <= 1 and (r["score"] == 0) == (r["lang_pred"] == "und")
    assert crf.identify(df.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in crf.identify(df, None).collect()} == {"und"}


def test_spans_cover_each_word_once(spark, model):
    rng = random.Random(6)
    text = " ".join(sentence("aa", 15, rng) + sentence("bb", 15, rng))
    spans = crf.label_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), model).collect()
    by = {r["doc_id"]: r["spans"] for r in spans}
    assert by[2] == [] and sum(s["n_words"] for s in by[1]) == 30
    assert [s["lang"] for s in by[1]][0] == "aa" and [s["lang"] for s in by[1]][-1] == "bb"


def test_fit_is_bounded_and_skips_unlabelled_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(sentence("aa" if i % 2 else "bb", 30, rng)), "aa" if i % 2 else "bb") for i in range(80)]
    rows += [(200, "zz zz", None), (None, "yy yy", "aa"), (201, None, "bb"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = crf.training_rows(df, "doc_id", "text", "lang", per_lang=10).collect()
    assert 18 <= len(sample) <= 20 and {r["lang"] for r in sample} == {"aa", "bb"}
    assert crf.fit(df, per_lang=10, rounds=3).langs == ["aa", "bb"]
    assert crf.fit(df.limit(0)) is None


def test_held_out_accuracy(spark):
    from flagloom.llm.queries import op3_language_id, read

    got = op3_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    lang = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    right, n = got.join(lang, "doc_id").selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    assert n > 100 and right / n > 0.97


def test_every_language_has_its_lexicon_feature():
    langs = [f"l{j:03d}" for j in range(130)]
    own = [f"w{j:03d}q" for j in range(130)]
    model = crf.learn([f"{w} {w} {w} shared shared shared" for w in own], langs, rounds=1)
    assert len(model.lexicon) == 131  # each language's own word and the shared one
    known = crf._lexicon_set(crf.Words(pa.array([" ".join([*own, "shared", "other"])])).hashes(), model.lexicon, model.members)
    assert known[-1] == 0 and (known[:-1] > 0).all() and len(set(known[:-1].tolist())) == 131
    one = np.arange(5, dtype=np.uint64)
    assert crf._set_code(one[:, None]).tolist() == one.tolist()  # up to 64 languages: the set itself
