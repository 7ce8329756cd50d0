"""Packing: gapless sequences, whole documents, few sequences; against the tokenizer itself."""

import random
import zlib
from array import array
from collections import Counter

import pytest

from rasterloom.llm import packing
from rasterloom.llm.queries import PACKING_TOKENIZER

CASES = ["It's   a TEST'S 'll x2y <|endoftext|> ok", "", "naïve Éàö ß x", "Σίσυφος ΣΑΣ 你好 é å", "a\x1cb", "tab\tnew\nline\x85z !!?? 123 4.5", "don't 'Re I'M", "İstanbul µ ÿ Ÿ", "word " * 3000]


def test_ids_are_the_tokenizers():
    t = packing.tokenizer(PACKING_TOKENIZER)
    assert t.encode(CASES) == [t._whole(x) for x in CASES]


def test_new_chunks_are_cut_in_one_call(monkeypatch):
    calls = []

    class Counted:
        def findall(self, text):
            calls.append(len(text))
            return real.findall(text)

    real = packing._WORDS
    monkeypatch.setattr(packing, "_WORDS", Counted())
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("abÉÿß'stºµ²½19.,-#\u00ad\u0394<|") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(part() for _ in range(rng.randint(0, 40))) for _ in range(100)]
    t = packing.WordTokenizer(PACKING_TOKENIZER)
    assert t.encode(texts) == [t._whole(x) for x in texts] and t.encode(texts[::-1]) == [t._whole(x) for x in texts[::-1]]
    assert len(t.chunks) > 1000 and len(calls) == 1
    assert t.encode(["Δ <|endoftext|>"]) == [t._whole("Δ <|endoftext|>")] and t.encode([]) == []


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold_all_pieces(seed):
    rng = random.Random(seed)
    cap, n = rng.choice((20, 50, 2048)), rng.choice((0, 1, 40, 3000))
    lengths = Counter(rng.randint(1, cap) for _ in range(n))
    groups, got, bins = packing.plan(lengths, cap), Counter(), 0
    for content, times in groups:
        assert times > 0 and sum(a * b for a, b in content) <= cap
        bins += times
        for a, b in content:
            got[a] += b * times
    assert got == lengths
    total = sum(a * b for a, b in lengths.items())
    large = sum(b for a, b in lengths.items() if 2 * a > cap)
    assert bins <= max(-(-total // cap), large) * 1.1 + 1


def test_reduction_is_exact_on_small_instances():
    def fewest(items, cap):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= cap:
                    bins[k] += items[i]
                    go(i + 1, bins)
                    bins[k] -= items[i]
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    for seed in range(40):
        rng = random.Random(seed)
        items = sorted((rng.randint(1, 10) for _ in range(8)), reverse=True)
        fixed, left = packing.reduce_dominated(Counter(items), 10)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + (fewest(rest, 10) if rest else 0) == fewest(items, 10)


def test_documents_are_packed_whole(spark, documents):
    rows = [(1, None), (2, ""), (2, ""), (3, "word " * 5000), (None, "ok"), (4, "same text"), (5, "same text")] + [(10 + k, "alpha beta " * (37 * k % 400)) for k in range(60)]
    got = packing.pack_documents(documents(rows), PACKING_TOKENIZER, with_ids=True)
    pieces = got.collect()
    t = packing.tokenizer(PACKING_TOKENIZER)
    want = Counter()
    for i, text in rows:
        ids = array("I", t._whole(text or "")).tolist() + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, n, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r["n_tokens"] for r in packing.sequences(got).collect()} == {sum(n for _, n in p) for p in by.values()}


def test_empty_table(documents):
    assert packing.pack_documents(documents([]), PACKING_TOKENIZER).count() == 0
