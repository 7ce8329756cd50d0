"""Repeated substrings against brute force on small alphabets, with a small cover."""

import glob
import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import repeats
from rasterloom.llm.common import CLEANUP, durable


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("v", sorted(repeats.COVERS))
def test_covers_are_perfect(v):
    d = repeats.COVERS[v]
    assert sorted((a - b) % v for a in d for b in d if a != b) == list(range(1, v))


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    shared = [part(rng.randint(18, 60)) for _ in range(4)]
    texts = [None, "", "short", part(300), "a" * 50]
    for _ in range(25):
        t = part(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 8)
            t += s[a : len(s) - rng.randint(0, 8)] + part(rng.randint(0, 30))
        texts.append(t)
    texts += [texts[7], texts[3], texts[3]]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeat_report(documents(rows), length=20, v=13).collect()}
    want = brute(texts, 20)
    kept = {r["doc_id"]: (r["n_kept"], r["n_kept_chars"]) for r in repeats.repeat_report(documents(rows), length=20, v=13).collect()}
    assert kept == {i: (len(w[4]), sum(b & 0xC0 != 0x80 for b in w[4])) for i, w in enumerate(want)}
    assert got == {i: w[:4] for i, w in enumerate(want)}
    cut = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(documents(rows), length=20, v=7).collect()}
    assert cut == {i: None if texts[i] is None else w[4].decode("utf-8", "ignore") for i, w in enumerate(want)}


def test_empty_table(documents):
    assert repeats.repeat_report(documents([])).count() == 0
    assert repeats.remove_repeats(documents([])).count() == 0


def test_strings_of_a_hot_name_are_dealt_by_content(spark, documents):
    rng = random.Random(2)
    part = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = part(45)
    texts = [part(30) + passage + part(30) for _ in range(300)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["kept_sha256"] for r in repeats.repeat_report(documents(rows), length=20, v=13).collect()}
    assert got == {i: w[3] for i, w in enumerate(brute(texts, 20))}
    # all texts have the name at place 30; of their strings around it, those in the passage go on once, the others by content
    code, codes = [], repeats.secret_codes(2)
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        code.append(codes(raw, *repeats.windows(repeats.around(np.array([30]), len(raw), 13, 20), 20, None))[0])
    code = np.concatenate(code)
    keep, rest, flag = repeats.once_each(code)
    assert len(code) == 13 * 300 and len(set(code[keep].tolist())) == len(keep) and len(keep) + len(rest) == len(code)
    assert len(rest) >= 299 and max(np.bincount((code[keep] % np.uint64(16)).astype(int))) < 2 * len(keep) / 16
    assert flag[keep].sum() >= 1 and not flag[rest].any()


@pytest.mark.parametrize("seed", range(2))
def test_words_against_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    part = lambda n: "".join(word() + rng.choice((" ", " ", ", ", "\n", " ")) for _ in range(n))
    shared = [part(rng.randint(40, 60)) for _ in range(4)]
    texts = [None, "", "a b", part(100)]
    for _ in range(25):
        t = part(rng.randint(0, 20))
        for _ in range(rng.randint(0, 3)):
            t += shared[rng.randrange(4)][rng.randint(0, 60) :] + part(rng.randint(0, 20))
        texts.append(t)
    texts += [texts[7], texts[3], "x y z", "x y z"]
    length, seen, bounds = 41, Counter(), []
    for t in texts:
        raw = (t or "").encode()
        start, end = (b.tolist() for b in repeats.word_bounds(np.frombuffer(raw, np.uint8)))
        assert [raw[a:b].decode() for a, b in zip(start, end)] == [w.strip(",") or w for w in (t or "").split()]
        bounds.append([(a, b) for a, b in zip(start, end[length - 1 :])])
        seen.update(raw[a:b] for a, b in bounds[-1])
    want = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = {k for a, b in bounds[i] if seen[raw[a:b]] > 1 for k in range(a, b)}
        copied = bool(bounds[i]) and texts.count(t) > 1
        want[i] = None if t is None else "" if copied else bytes(c for k, c in enumerate(raw) if k not in gone).decode()
    rows = list(enumerate(texts))
    assert {r["doc_id"]: r["text"] for r in repeats.remove_repeats(documents(rows), length=length, v=21, words=True).collect()} == want
    assert sum(len(want[i] or "") < len(t or "") for i, t in rows) > 5


def test_contract_length_against_brute_force(spark, documents):
    rng = random.Random(12)
    part = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [part(n) for n in (380, 399, 400, 401, 640, 900)]
    texts = [None, "", shared[4], shared[4], part(2000)]
    for k in range(24):
        texts.append(part(rng.randint(0, 300)) + shared[k % 6][rng.randint(0, 3) :] + part(rng.randint(0, 250)) + (shared[(k + 1) % 6] if k % 3 == 0 else ""))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeat_report(documents(rows)).collect()}
    assert got == {i: w[:4] for i, w in enumerate(brute(texts, 400))}


def test_texts_made_to_collide(documents):
    """Two texts of 400 bytes that sums of powers of any base modulo 2**64 can't tell apart: Thue and Morse's words."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 11))
    other = word.translate(str.maketrans("ab", "ba"))
    base = lambda t: sum(ord(c) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(t)) % (1 << 64)
    assert base(word) == base(other)
    rng = random.Random(5)
    tail = "".join(rng.choice("cdefgh") for _ in range(300))
    out = {r["doc_id"]: r["n_removed"] for r in repeats.repeat_report(documents([(0, word + tail), (1, other + tail)]), length=2200, v=183).collect()}
    assert out == {0: 0, 1: 0}


def test_codes_depend_on_bytes_and_length_alone():
    rng = np.random.default_rng(6)
    codes = repeats.secret_codes(4)
    raw = rng.integers(0, 4, 3000, np.uint8)
    start = rng.integers(0, 2000, 500)
    end = start + rng.integers(0, 1000, 500)
    start[:40], end[:40] = 3000 - np.arange(40), 3000
    one, two = codes(raw, start, end)
    for shift in (1, 2, 3):
        moved = np.concatenate([rng.integers(0, 4, shift, np.uint8), raw, rng.integers(0, 4, 5, np.uint8)])
        again = codes(moved, start + shift, end + shift)
        assert (again[0] == one).all() and (again[1] == two).all()
    strings = [raw[a:b].tobytes() for a, b in zip(start, end)]
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(set(strings))
    big = rng.integers(0, 255, 20_000, np.uint8)
    assert len(set(codes(big, np.array([0, 1, 0]), np.array([9000, 9001, 9000]))[0].tolist())) == 2


def test_texts_with_equal_key_bits(spark, documents, monkeypatch):
    real = repeats.F.substring
    monkeypatch.setattr(repeats.F, "substring", lambda c, a, n: real(c, a, 1) if n == 16 and a == 1 else real(c, a, n))  # 4 bits at first
    texts = ["x" * 30 + "abcdefghijklmnopqrstuvwxyz"[k % 26] * 25 + str(k) for k in range(60)]
    got = {r["doc_id"]: r["kept_sha256"] for r in repeats.repeat_report(documents(list(enumerate(texts))), length=20, v=13).collect()}
    assert got == {i: w[3] for i, w in enumerate(brute(texts, 20))}


def test_shuffle_files_go_when_a_table_is_durable(spark):
    """``repeat_report`` would else hold the files of all its shuffles at once."""
    jvm = spark.sparkContext._jvm
    folders = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before = held()
    made = durable(spark.range(5000).repartition(5, "id").groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert spark.conf.get(CLEANUP) == "false" and made.count() == 100 and made.agg(F.sum("count")).first()[0] == 5000
