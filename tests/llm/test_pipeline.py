"""Each stage against its own rule, on planted cases."""

import random

import corpus_pipeline
from rasterloom.llm import decontaminate


def test_stages(spark, words, tmp_path):
    rng = random.Random(8)
    passage, item = words(rng, 120), words(rng, 40)
    texts = [words(rng, 80) for _ in range(30)]
    texts += [texts[0], texts[1] + " more", words(rng, 30) + " " + passage + " " + words(rng, 30), words(rng, 40) + " " + passage, words(rng, 20) + " " + item, None, ""]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    toxic, near, cut, clean, packed = seen
    assert set(toxic) == set(range(len(texts)))
    assert set(near) == set(range(len(texts))) - {30, 31, 36}
    assert all(passage not in (r["text"] or "") for r in cut.values()) and cut[2]["text"] == texts[2]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.values())
    assert set(cut) - set(clean) == {34} and decontaminate.words_of(texts[34])
    assert set(packed) == set(clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == spark.read.parquet(path).count()


def test_passages_of_51_short_words_go(spark, tmp_path):
    rng = random.Random(4)
    short = lambda n, k: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(k)) for _ in range(n))
    tiny, small, under, other = short(51, 1), short(51, 3), short(50, 3), short(50, 3)
    long_words = short(45, 12)  # 584 bytes, but not over fifty words
    signs = "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(51))
    apart = [short(60, 4) for _ in range(12)]
    texts = [f"{apart[0]} {tiny} {apart[1]}", f"{tiny}, {apart[2]}", f"{apart[3]}\n{small}", f"{small}. {apart[4]}", f"{apart[5]} {under} {other}", f"{other} {apart[6]} {under}", f"{long_words} {apart[7]}", f"{apart[8]} {long_words}", f"{apart[9]} {signs}{short(3, 4)}", f"{apart[10]}{signs}", None, ""]
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_repeats(spark, docs, str(tmp_path)).collect()}
    gone = [tiny, tiny, small, small, "", "", "", "", signs, signs]
    assert out == {k: None if t is None else t.replace(gone[k], "") if k < 10 and gone[k] else t for k, t in enumerate(texts)}
