"""Operator 2: class-conditional Kneser-Ney models of words' characters.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of character 6-grams inside words, estimated
from its labelled texts. Orders 6 to 4 are the class's own; below that both classes share one continuation model
that is counted over all documents, so rare expressions are smoothed alike and only what the labels
support tells the classes apart. A text's statistic is its log-likelihood ratio divided by its number of
words, once as it is and once with only each word's evidence beyond ``MARGIN``; a logistic map, fitted on a
third of the labelled rows that the counts haven't seen, turns them into a score.

The labelled sample is bounded (``max_rows`` rows and ``max_bytes`` of text a class, in the order of a hash of the
id); what is broadcast is that sample's ids and the model made from it. Counts over all documents are aggregated by
Spark and joined with the sample's grams. Ids of any type are known by a 64-bit hash of their text form.

Letters and digits of any script are lowered; anything else ends a word. Symbols beyond U+024F are hashed into 430
classes. Null, empty and wordless texts have no evidence and get the score of the base rate without evidence;
labels with null ids or values teach nothing; of contradicting labels toxic wins; without both classes every score is
the share of toxic labels. Repeated rows count and are scored one by one; an empty table gives an empty result; a
column with an output's name gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold, durable, text_buffers, tidy

ORDER, SHARED, BITS = 6, 3, 10
MARGIN = 2.0
BLOCK = 1 << 20
NO_KEY = -(1 << 63)  # stands for a null id, which no label has
SLOTS = 1 << 20
_SYMBOL = np.ones(0x110000, np.int64)  # 1: the end of a word
for _o in range(0x33480):  # no letters or digits beyond
    if chr(_o).isalnum():
        _l = ord(chr(_o).lower()[0])
        _SYMBOL[_o] = 2 + (_l if _l < 0x250 else 0x250 + _l % 430)


def suffix(grams: np.ndarray, order: int) -> np.ndarray:
    return grams & ((1 << (BITS * order)) - 1)


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, rows) of the texts in blocks of about ``BLOCK`` bytes; longer texts are cut between words."""
    offsets, data = text_buffers(batch.column(column))
    raw = np.frombuffer(data, np.uint8)
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        if offsets[end] - offsets[row] <= BLOCK:
            yield raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], np.arange(row, end)
        else:
            start, stop = int(offsets[row]), int(offsets[end])
            while start < stop:
                cut = min(stop, start + BLOCK)
                while cut < stop and raw[cut] not in (32, 10):
                    cut += 1
                yield raw[start:cut], np.array([0, cut - start]), np.array([row])
                start = cut
        row = end


def word_grams(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that start at ``starts``: each character's gram (it and up to five before it in its word, packed),
    the index of each word's last gram, and the number of each word's text."""
    char_at = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[starts]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != char_at[-1]:  # not valid UTF-8: count again
        parts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[:-1], starts[1:])]
        char_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    lengths = np.diff(char_at)
    s = np.insert(_SYMBOL[points], char_at[:-1], 1)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 1) | (s[:-1] != 1)
    s, row = s[keep], row[keep]
    if s[-1] != 1:
        s = np.append(s, 1)
    if len(s) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.arange(len(s), dtype=np.int32)
    last = np.maximum.accumulate(np.where(s == 1, place, 0))
    since = place - np.concatenate([[0], last[:-1]])  # to the boundary before, which belongs to the context
    grams = s.copy()
    for k in range(1, ORDER):
        grams[k:] += np.where(since[k:] >= k, s[:-k], 0) << (BITS * k)
    grams = grams[1:]
    ends = np.flatnonzero(s[1:] == 1)
    return grams, ends, row[ends]  # s[i + 1] ends the word whose last character is s[i]


def id_hash(key: str):
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("string")))


def _slot(grams: np.ndarray) -> np.ndarray:
    return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def count_grams(docs: DataFrame, key: str, column: str, sample: DataFrame) -> DataFrame:
    """(gram, n_all, n_ordinary, n_toxic) over all documents; ``sample`` has the ids, classes and folds."""
    known = sorted((r[0], r[1]) for r in sample.where("fold = 'count'").select("id", "toxic").collect())  # max_rows a class
    sent = docs.sparkSession.sparkContext.broadcast((np.array([k for k, _ in known], np.int64), np.array([t for _, t in known], np.int64)))
    names = ["gram", "n_all", "n_ordinary", "n_toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = sent.value
        keys, counts = np.zeros(SLOTS, np.int64), np.zeros((3, SLOTS), np.int64)

        def rows(grams, numbers):
            return pa.RecordBatch.from_arrays([pa.array(grams), *(pa.array(n.astype(np.int64)) for n in numbers)], names=names)

        for batch in batches:
            own = np.array([NO_KEY if k is None else k for k in batch.column("_key").to_pylist()], np.int64)
            at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
            kinds = np.where(ids[at] == own, 1 + toxic[at], 0).astype(np.int8) if len(ids) else np.zeros(len(own), np.int8)
            for raw, starts, rows_of in blocks(batch, column):
                grams, ends, row = word_grams(raw, starts)
                if not len(grams):
                    continue
                kind = np.repeat(kinds[rows_of[row]], np.diff(np.concatenate([[-1], ends])))
                slot = _slot(grams)
                free = keys[slot] == 0
                keys[slot[free]] = grams[free]
                hit = keys[slot] == grams
                counts[0] += np.bincount(slot[hit], minlength=SLOTS)
                for c in (1, 2):
                    counts[c] += np.bincount(slot[hit & (kind == c)], minlength=SLOTS)
                if not hit.all():
                    u, inverse = np.unique(grams[~hit], return_inverse=True)
                    k = kind[~hit]
                    yield rows(u, [np.bincount(inverse, minlength=len(u)), *(np.bincount(inverse, k == c, len(u)) for c in (1, 2))])
        used = np.flatnonzero(keys)
        for part in np.array_split(used, max(1, len(used) // 100_000)):
            yield rows(keys[part], counts[:, part])

    counted = docs.select(id_hash(key).alias("_key"), column).mapInArrow(tidy(run), "gram long, n_all long, n_ordinary long, n_toxic long")
    return counted.groupBy("gram").agg(*(F.sum(n).alias(n) for n in names[1:]))


@dataclass
class Level:
    """One order of a Kneser-Ney model: discounted shares of known grams, and what their contexts leave."""

    grams: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(grams: np.ndarray, counts: np.ndarray) -> Level:
        contexts, inverse = np.unique(grams >> BITS, return_inverse=True)
        total, kinds = np.bincount(inverse, counts), np.bincount(inverse)
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.5
        return Level(grams, np.maximum(counts - discount, 0) / total[inverse], contexts, np.minimum(discount * kinds / total, 1.0))

    def mix(self, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return lower
        i = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        j = np.minimum(np.searchsorted(self.contexts, grams >> BITS), len(self.contexts) - 1)
        return np.where(self.grams[i] == grams, self.share[i], 0) + np.where(self.contexts[j] == grams >> BITS, self.rest[j], 1) * lower


@dataclass
class Model:
    classes: tuple[list[Level], list[Level]]  # ordinary and toxic: orders 6, 5, 4
    shared: tuple[np.ndarray, np.ndarray]  # grams of the shared order and their probability
    weights: np.ndarray
    base: float

    def ratio(self, grams: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log probability of each gram's last character."""
        low, (known, share) = suffix(grams, SHARED), self.shared
        if not len(known):
            return np.zeros(len(grams))
        i = np.minimum(np.searchsorted(known, low), len(known) - 1)
        lowest = np.where(known[i] == low, share[i], 1e-6)
        logs = []
        for levels in self.classes:
            p = lowest
            for level, order in zip(levels[::-1], range(SHARED + 1, ORDER + 1)):
                p = level.mix(suffix(grams, order), p)
            logs.append(np.log(p))
        return logs[1] - logs[0]

    def statistics(self, batch: pa.RecordBatch, column: str, cache: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Rows of: ratio a word, evidence beyond the margin a word, its root, log of the number of words."""
        total, beyond, n = np.zeros((3, batch.num_rows))
        keys, values = cache
        for raw, starts, rows in blocks(batch, column):
            grams, ends, row = word_grams(raw, starts)
            if not len(grams):
                continue
            slot = _slot(grams)
            miss = keys[slot] != grams
            found = values[slot]
            if miss.any():
                u, inverse = np.unique(grams[miss], return_inverse=True)
                r = self.ratio(u).astype(np.float32)
                found[miss] = r[inverse]
                keys[_slot(u)], values[_slot(u)] = u, r
            words = np.add.reduceat(found.astype(np.float64), np.concatenate([[0], ends[:-1] + 1]))
            total += np.bincount(rows[row], words, batch.num_rows)
            beyond += np.bincount(rows[row], np.maximum(words - MARGIN, 0), batch.num_rows)
            n += np.bincount(rows[row], minlength=batch.num_rows)
        each = np.maximum(n, 1)
        return np.column_stack([total / each, beyond / each, np.sqrt(beyond / each), np.log1p(n)])

    def score(self, statistics: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(statistics), self.base)
        return 1 / (1 + np.exp(-np.clip(design(statistics) @ self.weights, -30, 30)))


def design(statistics: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(statistics)), statistics, statistics[:, 2] * statistics[:, 3]])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; the intercept is not penalised."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


ROW_BYTES = 64  # that a row of the sample counts for beside its text


def cache() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, column: str, max_rows: int, max_bytes: int) -> DataFrame:
    """(id, toxic, fold) of the labelled rows to learn from."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("name")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("fold", crc_fold("name", 4)).where("fold <> 2").withColumn("id", id_hash("name"))
    first = [known.where(F.col("toxic") == t).orderBy("id", "name").limit(max_rows) for t in (0, 1)]
    rows = durable(first[0].unionByName(first[1]))
    size = docs.select(id_hash(key).alias("id"), (F.coalesce(F.octet_length(column), F.lit(0)) + ROW_BYTES).alias("n")).join(F.broadcast(rows.select("id")), "id").groupBy("id").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("toxic").orderBy("id", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over max_rows rows a class
    short = rows.join(F.broadcast(size), "id", "left").withColumn("bytes", F.sum(F.coalesce("n", F.lit(0))).over(before)).where(F.col("bytes") <= max_bytes)
    return durable(short.select("id", "toxic", F.when(F.col("fold") == 1, "calibrate").otherwise("count").alias("fold")))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", max_rows: int = 20_000, max_bytes: int = 200_000_000) -> Model:
    """Learn from labelled rows whose id's crc32 modulo 4 isn't 2; a third of them (remainder 1) calibrates."""
    sample = labelled_sample(docs, labels, key, column, max_rows, max_bytes)
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("toxic", "fold").count().collect()}
    total = sum(sizes.values())
    base = sum(c for (t, _), c in sizes.items() if t) / total if total else 0.0
    if len(sizes) < 4:
        return Model(([], []), (np.empty(0, np.int64), np.empty(0)), np.empty(0), base)

    grams = durable(count_grams(docs, key, column, sample))
    mask = lambda order: F.lit((1 << (BITS * order)) - 1)
    own = grams.where("n_ordinary + n_toxic > 0")
    # Shared continuation counts: of how many longer grams, over all documents, each shared gram is the end.
    longer = grams.select(F.col("gram").bitwiseAND(mask(SHARED + 1)).alias("g")).distinct()
    follow = longer.groupBy(F.col("g").bitwiseAND(mask(SHARED)).alias("gram")).agg(F.count("*").alias("n"))
    follow = follow.withColumn("context", F.shiftright("gram", BITS))
    context = follow.groupBy("context").agg(F.sum("n").alias("n_context"))
    needed = own.select(F.col("gram").bitwiseAND(mask(SHARED)).alias("gram")).distinct()
    shared = follow.join(needed, "gram", "left_semi").join(context, "context").select("gram", (F.col("n") / F.col("n_context")).alias("p")).orderBy("gram").toPandas()
    top = own.select("gram", "n_ordinary", "n_toxic").orderBy("gram").toPandas()
    classes = []
    for name in ("n_ordinary", "n_toxic"):
        kept_rows = top[name].to_numpy() > 0
        g, n = top["gram"].to_numpy()[kept_rows], top[name].to_numpy()[kept_rows].astype(float)
        levels = []
        for order in range(ORDER, SHARED, -1):
            levels.append(Level.of(g, n))
            g, n = np.unique(suffix(g, order - 1), return_counts=True)
            n = n.astype(float)
        classes.append(levels)
    model = Model(tuple(classes), (shared["gram"].to_numpy(), shared["p"].to_numpy()), np.empty(0), base)

    sent = docs.sparkSession.sparkContext.broadcast(model)
    held = docs.select(id_hash(key).alias("id"), F.col(column).alias("_text")).join(F.broadcast(sample.where("fold = 'calibrate'").select("id", "toxic")), "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cache()
        for batch in batches:
            if batch.num_rows:
                s = sent.value.statistics(batch, "_text", known)
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(c) for c in s.T)], names=["toxic", "a", "b", "c", "d"])

    rows = held.select("toxic", "_text").mapInArrow(tidy(measure), "toxic int, a double, b double, c double, d double").orderBy("toxic", "a", "b", "c", "d").toPandas()
    if rows["toxic"].nunique() == 2:
        model.weights = logistic(design(rows[["a", "b", "c", "d"]].to_numpy()), rows["toxic"].to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, column: str = "text", threshold: float = 0.3, out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1) and a prediction (1 from the threshold on), named by ``out``."""
    kept = [f for f in docs.schema.fields if f.name not in out]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out[0]}` double, `{out[1]}` int"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cache()
        for batch in batches:
            if batch.num_rows:
                s = sent.value.score(sent.value.statistics(batch, column, known))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, *out])

    return docs.select(*names).mapInArrow(tidy(run), schema)
