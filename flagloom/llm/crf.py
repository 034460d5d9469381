"""Word-level language labels by a linear-chain conditional random field.

Every word's features are its beginnings and endings of one to three bytes,
its byte trigrams and the set of languages whose lexicon (frequent words of
the training sample) has it. With learned transitions between the labels of
neighbouring words, forward-backward gives each word its label's probability,
so code-switched passages keep their own labels. A text's language is the one
with the largest mean probability over its words that may hold a letter.

The chains of a whole batch run as one chain that restarts at every text: it
is cut into blocks, the blocks' transfer matrices are multiplied side by side,
and the block ends are then known. That is exact for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagloom.llm.common import Words, first_ids, mix, slices, windows_hash

_BITS = 16
_SALT = np.uint64(8)
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # bucket x language
    moves: np.ndarray  # language x language
    start: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    members: np.ndarray  # set of languages for each, as one number


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    return (mix(x * _SALT + np.uint64(kind)) >> np.uint64(64 - _BITS)).astype(np.int64)


def _lexicon_set(hashes: np.ndarray, lexicon: np.ndarray, members: np.ndarray) -> np.ndarray:
    if not len(lexicon):
        return np.zeros(len(hashes), np.uint64)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, members[at], 0).astype(np.uint64)


def _set_code(sets: np.ndarray) -> np.ndarray:
    """One number for each row of 64-bit words: a single word is its own number, further
    words are hashed into it; the empty set has 0."""
    code = sets[:, 0].copy()
    for i in range(1, sets.shape[1]):
        code ^= mix(sets[:, i] * np.uint64(2 * i + 1))
    return code


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, known: np.ndarray) -> list[np.ndarray]:
    """Buckets of each word: six affixes and the lexicon set (one array each),
    then the trigrams' buckets and the word each belongs to."""
    low = data.astype(np.uint64) + np.uint64(1)
    low += ((data >= 65) & (data <= 90)).astype(np.uint64) * np.uint64(32)
    out = []
    for i, k in enumerate((1, 2, 3)):
        out.append(_bucket(windows_hash(low, start, np.minimum(start + k, end)), 2 * i))
        out.append(_bucket(windows_hash(low, np.maximum(end - k, start), end), 2 * i + 1))
    out.append(_bucket(known, 6))
    count = np.maximum(end - start - 2, 0)
    word = np.repeat(np.arange(len(start)), count)
    at = start[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    tri = (low[at] << np.uint64(20)) ^ (low[at + 1] << np.uint64(10)) ^ low[at + 2]
    return [*out, _bucket(tri, 7), word]


def _emissions(features: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    *single, tri, word = features
    total = sum(weights[f] for f in single)
    n = len(total)
    for k in range(weights.shape[1]):
        total[:, k] += np.bincount(word, weights=weights[tri, k], minlength=n)[:n]
    return total


def forward_backward(emit: np.ndarray, first: np.ndarray, moves: np.ndarray,
                     start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward vectors of every word, and the scaled emissions.

    ``first`` holds the position of each text's first word; their products,
    normalised, are the label probabilities."""
    n, k = emit.shape
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    a, opening = np.exp(moves - moves.max()), np.exp(start - start.max())
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    opens = np.zeros(blocks * size, bool)
    opens[first[first < n]] = True
    opens[n:n + 1] = True  # what fills the last block is a text of its own
    padded = np.ones((blocks * size, k))
    padded[:n] = e
    padded, opens = padded.reshape(blocks, size, k), opens.reshape(blocks, size)
    at_open = [np.flatnonzero(opens[:, t]) for t in range(size)]

    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(size):
        nxt = product @ a
        if len(at_open[t]):
            nxt[at_open[t]] = product[at_open[t]].sum(axis=2, keepdims=True) * opening
        nxt *= padded[:, t, None, :]
        nxt /= nxt.sum(axis=(1, 2), keepdims=True)
        product = nxt
    heads, tails = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.full(k, 1 / k)
    for j in range(blocks):
        heads[j] = v
        v = v @ product[j]
        v = v / v.sum()
    v = np.ones(k)
    for j in range(blocks - 1, -1, -1):
        tails[j] = v
        v = product[j] @ v
        v = v / v.sum()
    forward, backward = np.empty((size, blocks, k)), np.empty((size, blocks, k))
    v = heads
    for t in range(size):
        nxt = v @ a
        nxt[at_open[t]] = opening
        nxt *= padded[:, t]
        nxt /= nxt.sum(axis=1, keepdims=True)
        forward[t] = v = nxt
    v = tails
    for t in range(size - 1, -1, -1):
        backward[t] = v
        v = (padded[:, t] * v) @ a.T
        v[at_open[t]] = 1
        v /= v.sum(axis=1, keepdims=True)
    flat = [np.ascontiguousarray(x.swapaxes(0, 1)).reshape(-1, k)[:n] for x in (forward, backward)]
    return flat[0], flat[1], e


def probabilities(words: Words, model: Model) -> np.ndarray:
    """P(label) of every word given its whole text."""
    if not len(words):
        return np.zeros((0, len(model.langs)))
    vocab, example, word = np.unique(words.hashes(), return_index=True, return_inverse=True)
    known = _lexicon_set(vocab, model.lexicon, model.members)
    emit = _emissions(word_features(words.data, words.start[example], words.end[example], known), model.weights)[word]
    p, q, _ = forward_backward(emit, words.first[:-1], model.moves, model.start)
    p = p * q
    return p / p.sum(axis=1, keepdims=True)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """``(text, lang)`` of at most ``per_lang`` labelled ids of every language,
    least hashes first: the documented bound on what the fit sees."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, lang_col).distinct()
    ids = first_ids(labelled, lang_col, id_col, per_lang).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("text"))
    # the ids are at most per_lang for each language, so they may be broadcast
    return (rows.join(F.broadcast(ids), ["_id", "_lang"]).where(F.col("text").isNotNull())
            .dropDuplicates().orderBy("_lang", "_id", "text").select("text", F.col("_lang").alias("lang")))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = 150, rounds: int = 30, segment: int = 25, lexicon_size: int = 2000) -> Model | None:
    """Learn from whole texts of at most ``per_lang`` labelled rows a language.

    A text's label stands for each of its words. So that the transitions see
    switches, the sample's texts are cut into stretches (``segment`` words on
    average) and dealt anew into mixed sequences. ``None`` without labelled words.
    """
    rows = training_rows(docs, id_col, text_col, lang_col, per_lang).collect()
    return learn([r["text"] for r in rows], [r["lang"] for r in rows], rounds, segment, lexicon_size)


def learn(texts: list[str], langs_of: list[str], rounds: int = 30, segment: int = 25,
          lexicon_size: int = 2000) -> Model | None:
    words = Words(pa.array(texts, pa.string()))
    if not len(words):
        return None
    langs = sorted(set(langs_of))
    k = len(langs)
    label = np.repeat(np.array([langs.index(x) for x in langs_of]), np.diff(words.first))
    hashes = words.hashes()
    vocab, example, word = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.stack([np.bincount(word[label == j], minlength=len(vocab)) for j in range(k)])
    sets = np.zeros((len(vocab), -(-k // 64)), np.uint64)
    for j in range(k):
        top = np.lexsort((vocab, -counts[j]))[:lexicon_size]
        top = top[counts[j][top] >= 3]
        sets[top, j // 64] |= np.uint64(1 << j % 64)
    members = _set_code(sets)
    feats = word_features(words.data, words.start[example], words.end[example], members)
    # mixed sequences: shuffle stretches of words
    rng = np.random.default_rng(7)
    opens = np.zeros(len(word), bool)
    opens[words.first[:-1][words.first[:-1] < len(word)]] = True
    opens |= rng.random(len(word)) < 1 / segment
    begin = np.flatnonzero(opens)
    length = np.diff(np.append(begin, len(word)))
    deal = rng.permutation(len(begin))
    order = np.concatenate([np.arange(begin[i], begin[i] + length[i]) for i in deal])
    word, label = word[order], label[order]
    first = np.arange(0, len(word), 20 * segment)
    weights, moves, start = np.zeros((1 << _BITS, k)), np.zeros((k, k)), np.zeros(k)
    gains = [np.full_like(x, 1e-6) for x in (weights, moves, start)]
    truth = np.eye(k)[label]
    inner = np.ones(len(word), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    for _ in range(rounds):
        emit = _emissions(feats, weights)[word]
        p, q, e = forward_backward(emit, first, moves, start)
        post = p * q
        post /= post.sum(axis=1, keepdims=True)
        a = np.exp(moves - moves.max())
        y = (e * q)[inner]
        x = p[inner - 1]
        x = x / ((x @ a) * y).sum(axis=1, keepdims=True)
        g_moves = a * (x.T @ y) - seen + 0.1 * moves
        diff = post - truth
        per_word = np.stack([np.bincount(word, weights=diff[:, j], minlength=len(vocab)) for j in range(k)], axis=1)
        g = 0.1 * weights
        for j in range(k):
            for f in feats[:-2]:
                g[:, j] += np.bincount(f, weights=per_word[:, j], minlength=1 << _BITS)
            g[:, j] += np.bincount(feats[-2], weights=per_word[feats[-1], j], minlength=1 << _BITS)
        for value, gain, grad in zip((weights, moves, start), gains, (g, g_moves, diff[first].sum(axis=0))):
            gain += grad * grad
            value -= 0.3 / np.sqrt(gain) * grad
    keep = members > 0
    return Model(langs, weights.astype(np.float32), moves, start, vocab[keep], members[keep])


def _voters(words: Words) -> np.ndarray:
    """Words with an ASCII letter or any byte outside ASCII."""
    d = words.data
    letter = ((d | 32) >= 97) & ((d | 32) <= 122) | (d >= 128)
    total = np.concatenate(([0], np.cumsum(letter)))
    return total[words.end] > total[words.start]


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred``, ``score`` (mean probability of
    that language, 0 to 1) and ``n_switches`` (neighbouring words whose likeliest
    labels differ).

    ``und`` with score 0 for a null text, a text without any letter, or without
    a model. Ties go to the language first in the alphabet; repeated rows give
    repeated results, no rows none; other columns are ignored.
    """
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("n_switches", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            n = batch.num_rows
            lang, score, switches = [UNKNOWN] * n, np.zeros(n), np.zeros(n, np.int64)
            words = Words(batch.column("_text"))
            if model is not None and len(words):
                post = probabilities(words, model)
                vote = _voters(words)
                votes = np.concatenate((np.zeros((1, post.shape[1])), np.cumsum(post * vote[:, None], axis=0)))
                count = np.concatenate(([0], np.cumsum(vote)))
                change = np.concatenate(([0, 0], np.cumsum(np.diff(post.argmax(axis=1)) != 0)))
                for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                    if count[b] > count[a] and _has_letter(words.text(i)):
                        mean = (votes[b] - votes[a]) / (count[b] - count[a])
                        best = int(mean.argmax())
                        lang[i], score[i] = model.langs[best], min(1.0, max(0.0, mean[best]))
                        switches[i] = change[b] - change[a + 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), pa.array(switches)],
                [*keep, "lang_pred", "score", "n_switches"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def label_spans(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``spans``: runs of equally labelled words as
    (``first_word``, ``n_words``, ``lang``, ``score``: mean probability). A text without words has none."""
    span = T.StructType().add("first_word", "long").add("n_words", "long").add("lang", "string").add("score", "double")
    schema = docs.select(*keep).schema.add("spans", T.ArrayType(span))
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()),
                               ("lang", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = Words(batch.column("_text"))
            post, out = probabilities(words, model), []
            for a, b in zip(words.first[:-1], words.first[1:]):
                best = post[a:b].argmax(axis=1)
                at = np.flatnonzero(np.append(True, best[1:] != best[:-1])) if b > a else np.zeros(0, np.int64)
                stop = np.append(at[1:], b - a)
                out.append([{"first_word": int(x), "n_words": int(y - x), "lang": model.langs[best[x]],
                             "score": float(post[a + x:a + y, best[x]].mean())} for x, y in zip(at, stop)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, kind)], [*keep, "spans"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)
