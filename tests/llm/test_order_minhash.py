"""Order MinHash against a plain restatement, and its edited texts against slicing."""

import hashlib
from collections import Counter

import numpy as np

from flagloom.llm import ordermin

SCHEMA = "doc_id long, text string, fingerprint string"


def edited(rows):
    """(id, n, sha of the edited text) in the contract's order, for distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        n, k = len(t), len(t) // 3
        out[i] = (n, hashlib.sha256((t[:n - k] + nxt[:k]).encode()).hexdigest(), t[:n - k] + nxt[:k])
    return out


def test_edited_texts_and_fingerprints(spark):
    rows = [(i, "".join(chr(97 + (i * j * j) % 23) for j in range(i * 13 % 700)) + "é漢😀" * (i % 3)) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "ab"), (73, "same text twice"), (74, "same text twice"), (75, "x" * 200000)]
    got = {r["doc_id"]: r for r in ordermin.order_minhash(
        spark.createDataFrame([(i, t, "c") for i, t in rows], SCHEMA)).collect()}
    want = edited(rows)
    assert set(got) == set(want)
    for i, (n, sha, text) in want.items():
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (n, sha)
        sig = ordermin.signature(ordermin._points(dict(rows)[i] or ""))
        new = ordermin.signature(ordermin._points(text))
        assert got[i]["fingerprint"] == sig.astype(">u4").tobytes().hex()
        assert got[i]["edited_fingerprint"] == new.astype(">u4").tobytes().hex()
        assert got[i]["near_edited"] == float(np.mean(sig == new))
    assert got[73]["fingerprint"] == got[74]["fingerprint"] and got[74]["near_next"] == 1.0


def test_selection_matches_plain_restatement():
    points = ordermin._points("abracadabra abracadabra alakazam " * 3)
    k, picks, sketches = 4, 3, 16
    base = ordermin._kmer_hashes(points, k).tolist()
    n, seen, numbered = len(base), {}, []
    bits = (n - 1).bit_length()
    spacing = int(ordermin._SPACING)
    for h in base:
        top = h >> bits
        number = seen.get(top, 0)
        seen[top] = number + 1
        x = top if not number else int(ordermin.mix(np.array([(top + number * spacing) % 2**64], np.uint64))[0])
        numbered.append(x * spacing % 2**64)
    assert max(seen.values()) > 1
    out = []
    for i, (f, s) in enumerate(zip(*(x.tolist() for x in ordermin._functions(sketches)))):
        order = [(((x >> 32) ^ s) * f % 2**32, place) for place, x in enumerate(numbered)]
        code = i + 1
        for place in sorted(p for _, p in sorted(order)[:picks]):
            code = int(ordermin.mix(np.array([(code * spacing + numbered[place]) % 2**64], np.uint64))[0])
        out.append(code >> 32)
    assert ordermin.signature(points, k, picks, sketches).tolist() == out


def test_order_matters_and_edits_show():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 123, 3000).astype(np.uint32)
    sig = lambda x: ordermin.signature(x, 6, 2, 128)
    small, swapped = text.copy(), np.concatenate((text[1500:], text[:1500]))
    small[100:110] = 65
    assert ordermin.likeness(sig(text), sig(small)) > 0.9
    assert 0.2 < ordermin.likeness(sig(text), sig(swapped)) < 0.8  # the same k-mers, another order
    assert ordermin.likeness(sig(text), sig(rng.integers(97, 123, 3000).astype(np.uint32))) < 0.05


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", ""), (1, "a", ""), (None, "zz", ""), (1, "b", "")], SCHEMA)
    rows = ordermin.order_minhash(df).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "1", "None"]
    assert ordermin.order_minhash(df.limit(0)).count() == 0
    one = ordermin.order_minhash(spark.createDataFrame([(1, "abcdef", "")], SCHEMA)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0


def plain_likeness(a, b, k, picks, sketches):
    """Order MinHash by its definition: numbered k-mers ranked by a keyed digest, the picked ones in text order."""
    def picked(text):
        seen, numbered = Counter(), []
        for i in range(len(text) - k + 1):
            numbered.append((text[i:i + k], seen[text[i:i + k]]))
            seen[text[i:i + k]] += 1
        out = []
        for s in range(sketches):
            rank = [hashlib.blake2b(repr(x).encode(), digest_size=8, key=bytes([s])).digest() for x in numbered]
            least = sorted(range(len(rank)), key=rank.__getitem__)[:picks]
            out.append([numbered[i] for i in sorted(least)])
        return out

    return sum(x == y for x, y in zip(picked(a), picked(b))) / sketches


def test_likeness_does_not_follow_the_length():
    rng = np.random.default_rng(5)
    text = "".join(map(chr, rng.integers(97, 123, 1200))) + "the same words, the same words again. " * 4
    ours = lambda a, b: ordermin.likeness(*(ordermin.signature(ordermin._points(x), 6, 2, 200) for x in (a, b)))
    # numbers of 6-mers just below, at and above powers of two, and longer texts cut across one
    for a, b in ((1024, 1025), (512, 513), (128, 129), (64, 65), (127, 130), (1020, 1030), (1300, 900), (700, 400)):
        a, b = text[:a + 5], text[:b + 5]
        assert abs(ours(a, b) - plain_likeness(a, b, 6, 2, 200)) < 0.15
        if len(a) < len(b):
            assert ours(a, b) > 0.8
    changed = text[:1024] + "Q" + text[1025:1030]
    assert ours(text[:1029], changed) > 0.9


def test_equal_top_bits_do_not_mix_up_kmers():
    base = np.array([5, 4, 5, 4, 1 << 40, 5] + [9] * 300 + [8], np.uint64)
    assert ordermin._by_hash(base).tolist() == np.argsort(base, kind="stable").tolist()


def test_no_text_in_the_order_of_tasks(spark):
    rows = [(i, f"text {i} " * 20, "") for i in range(50)]
    plan = ordermin.order_minhash(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "Window [" in x)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    below = [x for x in lines[at + 1:] if x.strip()]
    stop = next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))
    assert below[:stop] and any("Project [part#" in x for x in below[:stop])
    assert not any("Project" in x and "_text" in x for x in below[:stop])
