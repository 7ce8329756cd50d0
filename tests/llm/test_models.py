"""The trained models against plain versions: Kneser-Ney, string kernel, Viterbi; and held-out layouts."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rasterloom.llm import html, language, toxicity

END = "\1"


def grams(text):
    for word in re.findall(r"[^\W_]+", text or ""):
        s = END + word.lower() + END
        for i in range(1, len(s)):
            yield s[max(0, i - 5) : i + 1]


def packed(gram):
    n = 0
    for c in gram:
        n = n << toxicity.BITS | int(toxicity._SYMBOL[ord(c)])
    return n


def kneser_ney(counts, shared):
    """p(last character | those before) by the textbook, with plain dictionaries."""
    levels, now = [], dict(counts)
    for order in (6, 5, 4):
        total, kinds = Counter(), Counter()
        for g, n in now.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        once, twice = (sum(n == k for n in now.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once else 0.5
        levels.append((order, now, total, kinds, d))
        lower = defaultdict(set)
        for g in now:
            lower[g[-(order - 1) :]].add(g)
        now = {g: len(s) for g, s in lower.items()}

    def p(gram, at=0):
        if at == 3:
            return shared.get(gram[-3:], 1e-6)
        order, now, total, kinds, d = levels[at]
        g = gram[-order:]
        rest = p(gram, at + 1)
        c = g[:-1]
        if c not in total:
            return rest
        return max(now.get(g, 0) - d, 0) / total[c] + min(1.0, d * kinds[c] / total[c]) * rest

    return p


def test_kneser_ney_is_the_textbooks(spark, documents, words):
    rng = random.Random(6)
    rows = [(i, words(rng, 20) + (" blorg snarf vexit" if i % 3 == 0 else "")) for i in range(90)] + [(None, words(rng, 9)), (200, None), (201, "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(documents(rows), labels)
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    counts = [Counter(), Counter()]
    for i, t in rows[:90]:
        if fold(i) not in (1, 2):
            counts[i % 3 == 0].update(grams(t))
    follow, context = defaultdict(set), Counter()
    for _, t in rows:
        for g in grams(t):
            follow[g[-3:]].add(g[-4:])
    for g, s in follow.items():
        context[g[:-1]] += len(s)
    shared = {g: len(s) / context[g[:-1]] for g, s in follow.items()}
    known = {g[-3:] for c in counts for g in c}
    shared = {g: v for g, v in shared.items() if g in known}
    ordinary, toxic = (kneser_ney(c, shared) for c in counts)
    asked = sorted({g for _, t in rows for g in grams(t)})
    want = [math.log(toxic(g)) - math.log(ordinary(g)) for g in asked]
    assert np.allclose(model.ratio(np.array([packed(g) for g in asked])), want, atol=1e-9)


def test_toxic_words_are_learnt_whatever_the_ids(spark, documents, words):
    rng = random.Random(7)
    rows = [(f"d{i}", words(rng, 25) + (" blorg snarf vexit" if i % 4 == 0 else "")) for i in range(400)] + [("d0", "twice"), ("x", None), ("y", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 4 == 0)) for i in range(400)] + [(None, 1), ("d3", None)], "doc_id string, toxic int")
    out = {(r["doc_id"], r["text"]): r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    held = [i for i in range(1, 400) if zlib.crc32(f"d{i}".encode()) % 4 == 2]
    assert all(out[rows[i]] == int(i % 4 == 0) for i in held)
    short = toxicity.labelled_sample(docs, labels, "doc_id", "text", 50, 2000)
    assert 0 < short.count() < 50


def test_kernel_and_ridge_are_exact_with_all_landmarks():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(97, 103, 40).astype(np.uint8) if k % 2 else rng.integers(100, 110, 60).astype(np.uint8) for k in range(30)]
    x = language.presence(blocks)

    def slots(b):
        raw = b.tobytes()
        found = set()
        for n in range(1, language.SPECTRUM + 1):
            for i in range(len(raw) - n + 1):
                h = raw[i]
                for k, c in enumerate(raw[i + 1 : i + n], 1):
                    h = (h * 257 + c + k) % 2**64
                found.add(h * 0x9E3779B97F4A7C15 % 2**64 >> 50)
        return found

    sets = [slots(b) for b in blocks]
    kernel = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    n = np.sqrt(x.sum(1))
    assert np.allclose((x @ x.T) / n[:, None] / n[None, :], kernel, atol=1e-5)
    y = ["a" if k % 2 else "b" for k in range(30)]
    m = language.nystrom_ridge(x.copy(), y, 1000, 0.5)
    target = np.where(np.array(y)[:, None] == np.array(["a", "b"])[None, :], 1.0, -1.0)
    centre = np.eye(30) - 1 / 30
    k = centre @ kernel @ centre
    want = k @ np.linalg.solve(k + 0.5 * np.eye(30), centre @ target) + target.mean(0)
    assert np.allclose(x / n[:, None] @ m.matrix + m.bias, want, atol=1e-3)


def test_languages_are_learnt_beyond_foreign_beginnings(spark, documents):
    rng = random.Random(3)
    part = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    same = part("xyz", 3000)  # over 8 KB that say nothing
    rows = [(i, same + " " + part("abcde" if i % 2 else "klmno", 9000), "one" if i % 2 else "two") for i in range(24)]
    rows += [(100, None, "one"), (101, "12 !?", "two"), (102, part("abcde", 60), None), (102, part("klmno", 60), None), (None, part("klmno", 60), "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, per_text=8)
    out = [(r["doc_id"], r["text"], r["lang_pred"]) for r in language.classify(docs, model).collect()]
    assert all(p == ("one" if i % 2 else "two") for i, t, p in out if i is not None and i < 24)
    assert sorted((t or "", p) for i, t, p in out if i in (100, 101)) == [("", "und"), ("12 !?", "und")]
    assert sorted(p for i, _, p in out if i == 102) == ["one", "two"]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(4)
    for n in (1, 2, 6, 9):
        crf = html.Field(move=rng.normal(0, 2, (2, 2)), start=rng.normal(0, 1, 2))
        s = rng.normal(0, 2, (n, 2))
        value = lambda y: crf.start[y[0]] + sum(s[i, y[i]] for i in range(n)) + sum(crf.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(crf.viterbi(s)) == max(itertools.product((0, 1), repeat=n), key=value)


def test_training_climbs_the_likelihood():
    data = [([["a"], ["b"], ["a"]], [1, 0, 1]), ([["b"], ["b"]], [0, 0]), ([["a"], ["a"], ["b"], ["a"]], [1, 1, 0, 0])]

    def likelihood(crf):
        total = 0.0
        for x, y in data:
            s = crf.scores(x)
            value = lambda y: crf.start[y[0]] + sum(s[i, k] for i, k in enumerate(y)) + sum(crf.move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            total += value(y) - np.logaddexp.reduce([value(z) for z in itertools.product((0, 1), repeat=len(y))])
        return total

    steps = [likelihood(html.train(data, rounds=r, rate=0.1)) for r in (1, 5, 40)]
    assert steps[0] < steps[1] < steps[2] < 0


# Pages in layouts that the training pages don't have.
HELD_OUT = [
    ("<body><div id=wrap><ul class='topnav'><li><a href=/>Home</a><li><a href=/b>Blog</a></ul><div class='hentry'><h2>A walk</h2><p>We went up the hill, and saw the lake. It was cold.<p>Then we came back by bus.</div><div id='secondary'><h4>Recent posts</h4><a href=1>One more walk</a></div><div id='colophon'>Powered by a small engine</div></div>", ["A walk", "We went up the hill, and saw the lake. It was cold.", "Then we came back by bus."]),
    ("<html><body><header class='bar'><a>Login</a></header><main role='main'><section class='story'><h1>Rain</h1><p>It rained for three days &amp; nights, which nobody had expected.</p><figure><figcaption>The river on Monday, at noon.</figcaption></figure><p>The dam held, said the mayor.</p></section></main><aside class='rail'><p>Buy our umbrellas!</p></aside><footer><p>© 2020</p></footer></body>", ["Rain", "It rained for three days & nights, which nobody had expected.", "The river on Monday, at noon.", "The dam held, said the mayor."]),
    ("<table><tr><td class='menu'><a href=a>A</a> <a href=b>B</a></td><td class='content'><p>The old page uses a table, as pages did once.</p><p>It has two columns, one for links.</p></td></tr></table>", ["The old page uses a table, as pages did once.", "It has two columns, one for links."]),
    ("<div class='cookie-bar'>This site uses cookies. <button>OK</button></div><article><h1>Sums</h1><p>We know that <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is the same as b + a.</p><pre>print(1)</pre></article><section id='comments'><p>First! Nice text.</p></section>", ["Sums", "We know that a+b is the same as b + a.", "print(1)"]),
]


def test_layouts_held_out_of_training(spark):
    crf = html.fit()
    kept = lost = extra = 0
    for page, truth in HELD_OUT:
        got = html.main_blocks(page, crf)
        kept += sum(t in got for t in truth)
        lost += sum(t not in got for t in truth)
        extra += sum(g not in truth for g in got)
    assert kept / (kept + lost) >= 0.9 and extra <= 0.15 * kept, (kept, lost, extra)
    print("held-out layouts:", kept, lost, extra)


def test_broken_markup_takes_linear_time():
    for unit in ('<a x="', "<div>", "</p>", "<!--", "<a x='y\">", "<![CDATA[", "<a b='c", "< <"):
        began = time.perf_counter()
        html.leaf_blocks(unit * (500_000 // len(unit)))
        assert time.perf_counter() - began < 5
    blocks = [b.text for b in html.leaf_blocks("<p title='a > b'>one</p><p>x < y and <b>z</b></p><svg><text>label</text></svg><noscript>turn it on</noscript><script>no</script ><p>two<!-- x --> three")]
    assert blocks == ["one", "x < y and z", "label", "turn it on", "two three"]


@pytest.mark.parametrize("rows", [[], [(1, "u", None), (2, "u", ""), (2, "u", "<p>")]])
def test_pages_without_text(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as n_chars", "'mine' as text")
    assert [(r["text"], r["n_chars"]) for r in html.extract(pages, html.fit(20)).collect()] == [("", 0)] * len(rows)


def test_training_rows_are_bounded(spark, words):
    rng = random.Random(8)
    rows = [("one", words(rng, 60), "en") for _ in range(300)] + [("same", words(rng, 60), "fr")] * 300 + [(f"d{i}", words(rng, 60), f"l{i % 40}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    count = lambda **bounds: Counter(r["label"] for r in language.training_blocks(docs, "doc_id", "text", "lang", 10, 2, **bounds).collect())
    assert all(n <= 20 for n in count().values()) and count()["fr"] <= 2
    assert len(count(max_languages=3)) <= 3
    assert sum(count(max_blocks=100).values()) <= 100


def test_sample_counts_rows_without_text(spark):
    docs = spark.createDataFrame([("a", "")] * 1000 + [(f"d{i}", "x") for i in range(50)], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1)] + [(f"d{i}", i % 2) for i in range(50)], "doc_id string, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "doc_id", "text", 100, 2000)
    ids = docs.select(toxicity.id_hash("doc_id").alias("id")).join(sample, "id")
    assert 0 < ids.count() < 100
