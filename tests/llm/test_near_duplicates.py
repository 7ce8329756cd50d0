"""Near-duplicate classes against all pairs, with and without split super-components."""

import random

import numpy as np
import pytest

from rasterloom.llm import near_duplicates as nd


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([text or ""])


def classes_by_pairs(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common / (len(sets[i]) + len(sets[j]) - common) >= threshold:
                parent[find(i)] = find(j)
    out = {}
    for i, (k, _) in enumerate(rows):
        out.setdefault(find(i), []).append(k)
    return {min(v): sorted(v) for v in out.values()}


def corpus(words, seed):
    rng = random.Random(seed)
    texts = [None, "", "", "one", "one", "a b c d", "a b c d", "a b c d e"]
    for _ in range(12):
        base = words(rng, rng.choice((30, 120, 300))).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            new = list(base)
            for _ in range(rng.randint(0, 5)):
                new[rng.randrange(len(new))] = "changed" + str(rng.random())[2:8]
            base = new if rng.random() < 0.5 else base
            texts.append(" ".join(new))
    return list(enumerate(texts))


@pytest.mark.parametrize("chunk", [nd.CHUNK, 500])
def test_classes(spark, documents, words, chunk, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", chunk)
    rows = corpus(words, 3)
    got = {}
    for r in nd.near_duplicate_classes(documents(rows)).collect():
        got.setdefault(r["class_id"], []).append(r["doc_id"])
    assert {k: sorted(v) for k, v in got.items()} == classes_by_pairs(rows)


def test_one_of_each_class_stays(spark, documents, words):
    rows = corpus(words, 5)
    twice = rows + [rows[9], (None, "alone in the world of null ids")]
    kept = nd.keep_one(documents(twice))
    assert kept.columns == documents([]).columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(classes_by_pairs(rows)) and ids.count(None) == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:889], rng.integers(0, 1 << 62, 111).astype(np.uint64)]))
    s = nd.prob_min_hash([a, b], [np.ones(len(a)), np.ones(len(b))], 1024)
    assert abs((s[0] == s[1]).mean() - nd.similarity(a, b)) < 0.05
    w = rng.random(len(a)) + 0.1
    t = nd.prob_min_hash([a, a], [w, 3 * w], 256)
    assert (t[0] == t[1]).all()  # probability Jaccard doesn't change with the scale of the weights


def test_empty_table(documents):
    assert nd.near_duplicate_classes(documents([])).count() == 0
    assert nd.keep_one(documents([])).count() == 0


def test_one_template_is_compared_in_bounded_blocks(spark, documents, words, monkeypatch):
    monkeypatch.setattr(nd, "TEXTS", 12, raising=False)
    monkeypatch.setattr(nd, "CHUNK", 1500)
    monkeypatch.setattr(nd, "SHARES", 2, raising=False)
    most = []

    def counted(run):
        def f(nodes, threshold):
            most.extend(r["n"] for r in nodes.groupBy("part").agg(nd.F.countDistinct("node").alias("n")).collect())
            return run(nodes, threshold)

        return f

    for name in ("_clustered", "_linked"):
        if hasattr(nd, name):
            monkeypatch.setattr(nd, name, counted(getattr(nd, name)))
    rng = random.Random(9)
    base, texts = words(rng, 100).split(), []
    for k in range(60):
        new = list(base)
        for at in rng.sample(range(0, 100, 5), 4):
            new[at : at + 2] = ["x" + str(rng.random())[2:8], "y"]
        texts.append(" ".join(new))
        if k % 10 == 0:
            texts.append(" ".join(new[:-3]))
    rows = list(enumerate(texts))
    got = {}
    for r in nd.near_duplicate_classes(documents(rows)).collect():
        got.setdefault(r["class_id"], []).append(r["doc_id"])
    assert {k: sorted(v) for k, v in got.items()} == classes_by_pairs(rows)
    assert max(most) < len(rows) * 3 // 4
