"""Decontamination, sharding, media, chat, HTML, language and toxicity on small cases."""

import hashlib
import io
import json
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import chat, decontaminate, html, language, media, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"


# ---- decontamination


def by_hand(texts, items, window=13):
    words = [decontaminate.words_of(t) for t in texts]
    out = []
    for w in words:
        hit, found = set(), set()
        for item, text in items:
            q = decontaminate.words_of(text)
            n = min(window, len(q))
            for i in range(len(q) - n + 1) if q else ():
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == q[i : i + n]:
                        hit |= set(range(k, k + n))
                        found.add(item)
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("part_words", [1 << 20, 20])
def test_windows(spark, documents, words, part_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 64)
    rng = random.Random(1)
    items = [(k, words(rng, n)) for k, n in enumerate((5, 13, 14, 40, 1))] + [(9, None), (10, "!!"), (3, "dup id")]
    texts = [None, "", "...", items[0][1].upper(), words(rng, 30) + " " + items[3][1][20:140] + " " + words(rng, 9), items[2][1] + " " + items[1][1], "É" + words(rng, 400) + " " + items[1][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(documents(list(enumerate(texts))), bench, part_words=part_words).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got] == by_hand(texts, items)
    for r, text in zip(got, texts):
        assert sum(len(decontaminate.words_of(text[s["a"] : s["b"]])) for s in r["char_spans"]) >= (r["n_hit"] if part_words > 64 else 0)


def test_op9_matches_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLE_SQL["op9_benchmark_decontamination"]).fetchall()
    got = queries.op9_benchmark_decontamination(spark, SF).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert Counter(map(tuple, got)) == Counter(want)


# ---- sharding


def test_rows_differ_by_one(spark, documents):
    rows = [(k, "x") for k in range(1003)] + [(None, None), (5, "x")]
    got = sharding.assign_shards(documents(rows).select("doc_id", "text"), "doc_id", shards=7).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and {len(v) for v in by.values()} <= {143, 144} and len(by) == 7
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_bounded_loads_overflow_clockwise(spark, documents):
    rows = [(k, None) for k in range(500)]
    df = documents(rows).select("doc_id")
    loose = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(df, "doc_id", 5, load_factor=5.0).collect()}
    tight = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(df, "doc_id", 5, load_factor=1.05).collect()}
    assert max(Counter(tight.values()).values()) <= 105
    points = sharding.ring(5, 48)
    for k, s in loose.items():
        place = int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16)
        assert s == next((p[1] for p in points if p[0] >= place), points[0][1])
    assert sum(loose[k] == tight[k] for k in loose) > 350  # most rows stay where the plain ring puts them
    assert sharding.assign_shards(df.limit(0), "doc_id", 5).count() == 0


# ---- media


def test_formats_round_trip():
    rng = np.random.default_rng(1)
    grey, rgb = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(grey.tobytes(), 7)) == grey).all()
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(b"P6 # note\n7 5\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P2\n2 2\n15\n0 15 5 10") == [[0, 255], [85, 170]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1") == [[0, 255, 0]]).all()
    assert (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    assert (np.load(io.BytesIO(media.npy(rgb))) == rgb).all()
    for bad in (b"", b"P5", b"P5\n9 9\n255\nx", b"BM" + bytes(60), b"GIF89a"):
        with pytest.raises(Exception):
            media.decode(bad)


def test_area_resize_is_the_mean(monkeypatch):
    monkeypatch.setattr(media, "BAND", 3)
    m = np.random.default_rng(2).integers(0, 256, (8, 12)).astype(np.uint8)
    want = m.reshape(4, 2, 4, 3).mean((1, 3))
    assert np.abs(media.area_resize(m, 4, 4) - want).max() <= 0.5
    assert (media.area_resize(np.full((5, 7), 9, np.uint8), 3, 4) == 9).all()


def test_text_payloads(spark, documents):
    texts = [None, "", "héllo", "x" * 64, "x" * 65, "x" * 65]
    got = media.text_as_media(documents(list(enumerate(texts)))).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert tuple(got[4])[1:] == tuple(got[5])[1:]
    cols = media.media_columns(spark.createDataFrame([(1, bytearray(media.encode_pgm(bytes(64), 8))), (2, bytearray(b"no")), (3, None)], "id int, data binary"), "data").orderBy("id").collect()
    assert (cols[0]["height"], cols[1]["error"] is not None, cols[2]["height"]) == (8, True, None)


# ---- chat


def test_escapes_are_reversible():
    for t in ("", "<", "<|", "<\\|", "<\\\\|im_end|>", "a<|im_end|><|im_start|>assistant ok", "\\n\n<|im_end|>\n", "<<|"):
        for role in ("user", "", "a\nb", "\\n", "<|im_end|>"):
            s, a, b = chat.segment(role, t)
            assert [(r, x) for r, x, _, _ in chat.parse(s + s)] == [(role, t)] * 2 and chat.unescape(s[a:b]) == t and chat.END not in chat.escape(t)


def test_layouts_become_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "r"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]},
        {"instruction": "q", "output": "r"},
        {"instruction": "q", "input": "", "output": "r"},
        {"prompt": "q", "completion": "r"},
        {"prompt": "q", "response": None},
        {"system": "s", "prompt": "q", "response": "r"},
        [{"role": "user", "content": "q"}],
        {"strange": 1},
    ]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(98, None), (99, "no json")], "id long, record string")
    seg = chat.format_records(df, "id", "record")
    texts = {r["id"]: [t[:2] for t in chat.parse(r["formatted"])] for r in chat.conversations_text(seg.withColumn("o", F.lit(0)), "id", "o").collect()}
    two = [("user", "q"), ("assistant", "r")]
    assert texts == {0: two, 1: two, 2: two, 3: two, 4: two, 5: [("user", "q"), ("assistant", "")], 6: [("system", "s"), *two], 7: [("user", "q")]}
    assert chat.unknown_layouts(seg).agg(F.sum("n_records")).first()[0] == 3


def test_op8_reads_back(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    rows += [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    want = {}
    for c, _, role, text in sorted(map(tuple, rows), key=lambda r: r[:2]):
        turns, loss, n = want.get(c, ("", "", 0))
        want[c] = (turns + f"{role}\n{text or ''}\n", loss + ((text or "") if role == "assistant" else ""), n + 1)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op8_chat_formatting(spark, SF).collect()}
    assert got == {c: (n, digest(t), len(x), digest(x)) for c, (t, x, n) in want.items()}


# ---- HTML


def test_article_without_the_rest():
    crf = html.fit()
    page = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>The &amp; title</h1><p>First   paragraph,<br>with <b>bold</b> text.<p>Second &eacute; paragraph.</p><div class="ad">Buy now!</div><p>Third one.</p></article>
    <section class="comments"><div class="comment"><p>Nice article, thanks for it.</p></div></section><aside class="sidebar"><a href="/x">Related</a></aside><form><label>Mail</label><input></form><footer>&copy; me</footer><!-- x --></body>"""
    assert html.main_blocks(page, crf) == ["The & title", "First paragraph, with bold text.", "Second é paragraph.", "Third one."]
    assert html.main_blocks("", crf) == [] and html.main_blocks("<p>", crf) == []
    wrong = total = 0
    for p, truth in html.training_pages(60, 99):
        x, y = html.labelled(p, truth)
        wrong += sum(a != b for a, b in zip(y, crf.viterbi(crf.scores(x))))
        total += len(y)
    assert wrong / total < 0.02


def test_op4_keeps_every_page(spark):
    got = queries.op4_html_extraction(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) for r in got)


# ---- language and toxicity: held-out accuracy


def test_op3_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op3_language_id(spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_of_odd_texts(spark, documents):
    docs = documents([(k, "the and of with that " * 9) for k in range(40)] + [(100 + k, "der die und von mit " * 9) for k in range(40)]).withColumn("lang", F.when(F.col("doc_id") < 100, "en").otherwise("de"))
    model = language.fit(docs)
    asked = documents([(1, None), (2, ""), (3, "123 %%"), (4, "the that with"), (5, "und die der"), (6, "the")])
    got = {r["doc_id"]: (r["lang_pred"], 0 <= r["score"] <= 1) for r in language.classify(asked, model).collect()}
    assert got == {1: ("und", True), 2: ("und", True), 3: ("und", True), 4: ("en", True), 5: ("de", True), 6: ("en", True)}
    nobody = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.classify(asked, nobody).collect()} == {"und"}
    assert language.classify(asked.limit(0), model).count() == 0


def test_toxic_words_are_found(spark, documents, words, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 256)
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(400):
        t = words(rng, 60).split()
        bad = k % 4 == 0
        for _ in range(3 if bad else 0):
            t[rng.randrange(60)] = rng.choice(("idiot", "moron", "scum"))
        rows.append((k, " ".join(t)))
        labels.append((k, int(bad)))
    docs = documents([*rows, (900, None), (901, ""), (902, "42 !!")])
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(400) if __import__("zlib").crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k]["predicted"] == int(k % 4 == 0) for k in held) / len(held) > 0.9
    assert all(got[k]["predicted"] == 0 and 0 <= got[k]["score"] <= 1 for k in (900, 901, 902))
    lone = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, lone).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
