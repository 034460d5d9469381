"""Phrase mining against counting and scoring every phrase."""

import random
import re
from collections import Counter

import pytest

from flagloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, rank long"


def brute(rows, top, least=10, absorb=50):
    counts, out = {}, []
    for text, lang in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i:i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    for lang, own in counts.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= absorb * a for b in longer):
                continue
            cuts = [(1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def run(spark, rows, top, **how):
    df = spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], SCHEMA)
    got = collocations.mine(df, top=top, **how)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


def corpus(seed, docs=60, vocab=40):
    rng = random.Random(seed)
    names = [f"w{i}" if i % 7 else f"É{i}" for i in range(vocab)]
    fixed = [[rng.choice(names) for _ in range(rng.randrange(2, 5))] for _ in range(14)]
    rows = []
    for _ in range(docs):
        words = []
        for _ in range(rng.randrange(5, 60)):
            words += rng.choice(fixed) if rng.random() < 0.4 else [names[min(int(rng.expovariate(0.1)), vocab - 1)]]
            if rng.random() < 0.1:
                words.append(rng.choice([".", ",", "\n", "!"]))
        rows.append((" ".join(words), rng.choice(["en", "de", "de", None])))
    return rows


EDGES = [(None, "en"), ("", "fr"), ("  \t ", "it"), ("one", "es"), ("a" * 5000, None), ("Same Same same. " * 40, "nl"),
         ("A b c\x0bA b c\x0cA b c " * 12, "und"), ("tie one; tie two; " * 15, "pt")]


@pytest.mark.parametrize("seed,top", [(1, 5), (2, 20), (3, 2000), (4, 1)])
def test_equal_to_scoring_every_phrase(spark, seed, top):
    rows = corpus(seed) + EDGES
    assert run(spark, rows, top) == brute(rows, top)


def test_other_parameters(spark):
    rows = corpus(5)
    assert run(spark, rows, 10, least=3, absorb=80, bits=8) == brute(rows, 10, 3, 80)  # filters of 256 bits let most through
    assert run(spark, rows, 10, least=2, absorb=20) == brute(rows, 10, 2, 20)


def test_pairs_absorbed_by_less_bound_triples(spark):
    """Triples that score too little to be listed still absorb the pairs inside them."""
    rng = random.Random(7)
    rows = []
    for i in range(30):
        parts = [f"x{i % 6} y{i % 6} z", f"q{rng.randrange(3)} z", "z z q0"]
        rows += [(". ".join(parts * 4), "en")]
    for top in (1, 3, 8, 30):
        assert run(spark, rows, top) == brute(rows, top)


def test_large_counts_stay_exact(spark):
    big = 987_654_321_012
    df = spark.createDataFrame([(big, big + 1, big + 7)], "a long, l long, r long")
    got = df.select(collocations._score(df.a, df.l, df.r)).first()[0]
    assert got == 1_000_000 * big * big // ((big + 1) * (big + 7))


def test_few_phrases_and_empty_tables(spark):
    assert run(spark, [], 5) == [] == run(spark, [("just a few words", "en"), (None, None)], 5)
