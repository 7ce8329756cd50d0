"""Operator 3: string-kernel language identification.

The kernel of two texts is the number of n-grams (1 to ``SPECTRUM`` bytes, blended) that both contain, over the
root of the product of how many each contains: presence, not counts. Texts are cut into blocks of ``BLOCK`` bytes,
so that presence doesn't saturate in long texts and every part of a text speaks for itself. Landmarks are
blocks of training texts; Nyström features of a block are its kernels with the landmarks times the inverse root of
the landmarks' own kernel matrix; one-versus-rest kernel ridge regression on these features gives a score
for each language. Since the kernel is linear in (normalised) presence vectors, the landmarks, the inverse root
and the weights fold into one matrix, and blocks are scored by batched products of presence rows with it. A
text's score is the mean of its blocks, weighted by their n-grams.

Training takes the ``max_languages`` languages with most labelled rows, at most ``max_rows`` different labelled rows of each (by hash of the id, then
of the text) and of each whole text the ``per_text`` blocks whose hash of id and number is least, wherever they are; with many
languages fewer rows, so that ``max_blocks`` blocks at most reach the driver. Rows of one id and text teach once. ``und`` for null texts and texts without
a letter (score 0). Ties go to the first language in sorted order; without any labelled row everything is ``und``.
Repeated rows get equal results; rows without an id teach nothing; an empty table gives an empty result; a
column with an output's name gives way to it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, mix, slices, text_buffers, tidy

SPECTRUM, DIMS, BLOCK = 4, 1 << 14, 1024
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOISE = np.isin(np.arange(256), [c for c in range(128) if not chr(c).isalpha()])
_LOWER[_NOISE] = 32  # digits, punctuation and white space say nothing about a language


def presence(blocks: list[np.ndarray]) -> np.ndarray:
    """(blocks, DIMS) presence of hashed n-grams, as 32-bit floats."""
    out = np.zeros((len(blocks), DIMS), np.float32)
    for row, b in zip(out, blocks):
        h = b.astype(np.uint64)
        at = h.copy()
        row[(at * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64)] = 1
        for n in range(1, SPECTRUM):
            if len(b) <= n:
                break
            at = at[:-1] * np.uint64(257) + h[n:] + np.uint64(n)
            row[(at * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64)] = 1
    return out


def blocks_of(raw: np.ndarray) -> list[np.ndarray]:
    """Lowered blocks of a text; runs of anything but letters are one space."""
    s = _LOWER[raw]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 32) | (s[:-1] != 32)
    s = s[keep]
    return [s[i : i + BLOCK] for i in range(0, len(s), BLOCK)]


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # (DIMS, languages)
    bias: np.ndarray


def nystrom_ridge(x: np.ndarray, y: list[str], landmarks: int, ridge: float, seed: int = 0) -> Model:
    """Fit on presence rows ``x`` (normalised in place): landmark features, then ridge regression to +1 and -1 for each language."""
    languages = sorted(set(y))
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    of = np.array([languages.index(v) for v in y])
    rng = np.random.default_rng(seed)
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([rng.permutation(np.flatnonzero(of == k))[:each] for k in range(len(languages))])
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = (x @ marks.T) @ root
    # classes of unequal size count alike
    weight = (1 / np.bincount(of, minlength=len(languages)))[of][:, None]
    weight = weight / weight.mean()
    target = 2.0 * (of[:, None] == np.arange(len(languages))) - 1
    mean_f, mean_t = (features * weight).mean(0), (target * weight).mean(0)
    f, t = features - mean_f, target - mean_t
    w = np.linalg.solve(f.T @ (f * weight) + ridge * np.eye(f.shape[1]), f.T @ (t * weight))
    return Model(languages, (marks.T.astype(np.float64) @ (root @ w)).astype(np.float32), (mean_t - mean_f @ w).astype(np.float32))


def training_blocks(docs: DataFrame, key: str, column: str, label: str, max_rows: int, per_text: int, max_languages: int = 64, max_blocks: int = 10_000) -> DataFrame:
    """(label, id, number, block): at most ``max_rows`` rows a label, ``per_text`` blocks of each, and ``max_blocks`` in all."""
    texts = docs.select(F.col(key).cast("string").alias("id"), F.col(label).cast("string").alias("label"), F.col(column).alias("text"), F.xxhash64(column).alias("h"))
    usable = texts.where(F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & (crc_fold("id", 5) != 0))
    languages = [r["label"] for r in usable.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_languages).collect()]
    each = min(max_rows, max_blocks // (per_text * max(1, len(languages))))
    usable = usable.where(F.col("label").isin(languages))
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "h")
    ids = usable.select("id", "label", "h").distinct()
    picked = ids.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("id", "label", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                out = []
                for name, i, h, text in zip(*(batch.column(c).to_pylist() for c in ("label", "id", "h", "text"))):
                    if _LETTER.search(text):
                        found = blocks_of(np.frombuffer(text.encode(), np.uint8))
                        number = np.arange(len(found), dtype=np.uint64)
                        chosen = np.argsort(mix(number + np.uint64(zlib.crc32(i.encode()) << 32)), kind="stable")[:per_text]
                        out += [(name, i, h, k, found[k].tobytes()) for k in sorted(chosen.tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()))], names=["label", "id", "h", "number", "block"])

    chosen = usable.join(F.broadcast(picked), ["id", "label", "h"]).select("label", "id", "h", "text")  # max_blocks rows are broadcast at most
    blocks = chosen.mapInArrow(tidy(run), "label string, id string, h long, number int, block binary")
    return blocks.groupBy("label", "id", "h", "number").agg(F.min("block").alias("block")).select("label", "id", "number", "block")


def fit(docs: DataFrame, key: str = "doc_id", column: str = "text", label: str = "lang", max_rows: int = 600, per_text: int = 2, landmarks: int = 320, ridge: float = 1.0, max_languages: int = 64, max_blocks: int = 10_000) -> Model:
    """Learn from rows whose id's crc32 modulo 5 isn't 0; what reaches the driver is the bounded sample of blocks."""
    rows = training_blocks(docs, key, column, label, max_rows, per_text, max_languages, max_blocks).orderBy("label", "id", "number", "block").collect()
    if not rows:
        return Model([], np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32))
    return nystrom_ridge(presence([np.frombuffer(r["block"], np.uint8) for r in rows]), [r["label"] for r in rows], landmarks, ridge)


def classify(docs: DataFrame, model: Model, column: str = "text", out: str = "lang_pred") -> DataFrame:
    """``docs`` with the predicted language and a score (softmax of the ridge outputs)."""
    kept = [f for f in docs.schema.fields if f.name not in (out, "score")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` string, score double"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for batch in slices(whole, column, 4 << 20):
                o, data = text_buffers(batch.column(column))
                raw = np.frombuffer(data, np.uint8)
                totals = np.zeros((batch.num_rows, len(m.languages)))
                weights = np.zeros(batch.num_rows)
                letters = np.zeros(batch.num_rows, bool)
                waiting, owner = [], []

                def flush():
                    if waiting:
                        x = presence(waiting)
                        n = x.sum(1, keepdims=True)
                        s = (x @ m.matrix) / np.sqrt(n) + m.bias
                        np.add.at(totals, owner, s * n)
                        np.add.at(weights, owner, n[:, 0])
                        waiting.clear()
                        owner.clear()

                for i in range(batch.num_rows):
                    text = raw[o[i] : o[i + 1]]
                    letters[i] = bool(_LETTER.search(text.tobytes().decode("utf-8", "replace")))
                    if letters[i] and m.languages:
                        for b in blocks_of(text):
                            waiting.append(b)
                            owner.append(i)
                            if len(waiting) == 64:
                                flush()
                flush()
                known = letters & (weights > 0)
                mean = totals / np.maximum(weights, 1)[:, None]
                if m.languages:
                    best = mean.argmax(1)
                    soft = np.exp(4 * (mean - mean.max(1, keepdims=True)))
                    share = soft.max(1) / soft.sum(1)
                else:
                    best, share, known = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), known & False
                named = [m.languages[b] if k else "und" for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(named, pa.string()), pa.array(np.where(known, share, 0.0))], names=[*names, out, "score"])

    return docs.select(*names).mapInArrow(tidy(run), schema)
