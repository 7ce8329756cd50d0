"""Operator 6: ProbMinHash near-duplicate classes.

Words are runs of letters and digits, A-Z lowered; a shingle is five words in a row (a shorter text is one
shingle). ProbMinHash lets every shingle arrive at random registers at the times of a Poisson process whose rate
is its weight; a register keeps its first arrival, and a shingle stops as soon as its time is past the latest
register. Signatures of two texts then agree in a register with their probability Jaccard similarity; with
weights of 1 (the default) that is the Jaccard similarity of their sets of shingles.

Signatures are cut into ``BANDS`` bands of ``ROWS`` registers. Texts that share a band are candidates: 48 bands of
7 miss a pair of similarity 0.8 once in 80,000. Candidates are verified on their whole shingle sets, exactly:

* equal sets are one node, so copies never meet; a bucket only links its members to its smallest, which gives
  super-components by alternating stars, without pairs;
* inside a super-component, a text is compared with clusters that share a band with it, first with their
  anchors; since Jaccard distance is a metric, a text with similarity under 1 - 2 * (1 - threshold) to an anchor
  can't reach what hangs on that anchor, and is spared those comparisons. No candidate link is lost;
* super-components over ``CHUNK`` shingles or ``TEXTS`` texts are dealt to several tasks; then, first of their
  anchors and then of all their texts, those in a band with several clusters are compared there, in blocks under
  the same bounds: a round compares each block with the one so many further on, and labels are merged after it.

Null texts are empty; texts without words are near-duplicates of equal texts only. Rows are kept one by one; a
class has the smallest id of its rows (null only if all ids are null). An empty table gives an empty result; other
columns may have any name. Nodes are 64-bit fingerprints of shingle sets; links are decided on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .bloom import bit_table, maybe, maybe_in
from .common import durable, mix, slices, text_buffers, text_key, tidy

SHINGLE, ROWS, BANDS = 5, 7, 48
REGISTERS = ROWS * BANDS
CHUNK, TEXTS = 4_000_000, 4096  # shingles and texts that one task compares
SHARES = 16  # the bands go in so many shares, so that few copies of a text are under way at once
_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 1024, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, SHINGLE, np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch: pa.RecordBatch, column: str, weights: str = "set") -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of each text: its sorted distinct shingle hashes, their weights, and the key of that set."""
    parts = [_shingle_sets(part, column, weights) for part in slices(batch, column, 1 << 20)]
    return [s for p in parts for s in p[0]], [w for p in parts for w in p[1]], np.concatenate([p[2] for p in parts] or [np.empty(0, np.uint64)])


def _shingle_sets(batch: pa.RecordBatch, column: str, weights: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    offsets, data = text_buffers(batch.column(column))
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    s = _TABLE[raw]
    inside = s != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    text_start = starts[:-1][starts[:-1] < len(s)]
    first[text_start] = inside[text_start]  # a word doesn't go on from the text before
    at = np.flatnonzero(first)
    sets, weight, keys = [], [], np.zeros(batch.num_rows, np.uint64)
    if len(at):
        place = np.arange(len(s)) - np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(s)]])))
        hashed = np.where(inside, _BYTE[s] * _PLACE[place & 1023] + (place >> 10).astype(np.uint64), np.uint64(0))
        words = mix(np.add.reduceat(hashed, at))
    else:
        words = np.empty(0, np.uint64)
    bounds = np.searchsorted(at, starts)
    for i in range(batch.num_rows):
        w = words[bounds[i] : bounds[i + 1]]
        if not len(w):
            sets.append(w)
            weight.append(np.empty(0))
            text = np.frombuffer(data, np.uint8)[offsets[i] : offsets[i + 1]]
            keys[i] = mix(np.array([hash_bytes(text)], np.uint64))[0]
            continue
        n = max(1, len(w) - SHINGLE + 1)
        h = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, len(w))):
            h += w[k : k + n] * _STEP[k]
        u, count = np.unique(mix(h + np.uint64(min(SHINGLE, len(w)))), return_counts=True)
        sets.append(u)
        weight.append(count.astype(float) if weights == "count" else np.ones(len(u)))
        keys[i] = mix(np.array([np.bitwise_xor.reduce(mix(u + np.uint64(7))) + np.uint64(len(u))], np.uint64))[0]
        if weights == "count":
            keys[i] ^= np.bitwise_xor.reduce(mix(u + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return sets, weight, keys


def hash_bytes(a: np.ndarray) -> int:
    place = np.arange(len(a))
    return int((_BYTE[a] * mix(place.astype(np.uint64) + np.uint64(11))).sum(dtype=np.uint64)) ^ len(a)


def prob_min_hash(sets: list[np.ndarray], weights: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """Signatures (texts, registers) of shingle hashes; all texts advance one arrival of each live shingle a round."""
    n = len(sets)
    time = np.full(n * registers, np.inf)
    sign = np.zeros(n * registers, np.uint64)
    element = np.concatenate(sets) if n else np.empty(0, np.uint64)
    rate = np.concatenate(weights) if n else np.empty(0)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    state, clock = element.copy(), np.zeros(len(element))
    while len(element):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        x = mix(state)
        clock = clock - np.log(((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate
        register = owner * registers + (mix(x) % np.uint64(registers)).astype(np.int64)
        better = clock < time[register]
        r, c = register[better], clock[better]
        np.minimum.at(time, r, c)
        won = time[r] == c
        sign[r[won]] = element[better][won]
        latest = time.reshape(n, registers).max(1)
        live = clock < latest[owner]
        element, rate, owner, state, clock = element[live], rate[live], owner[live], state[live], clock[live]
    return sign.reshape(n, registers)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of each band's registers and its number."""
    s = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.zeros(s.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key


def _signed(sets, weights) -> np.ndarray:
    """Band keys; texts with few shingles need many rounds and go together, apart from the others."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    size = np.array([len(s) for s in sets])
    for group in (np.flatnonzero((size > 0) & (size < 48)), np.flatnonzero(size >= 48)):
        if len(group):
            out[group] = band_keys(prob_min_hash([sets[i] for i in group], [weights[i] for i in group]))
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 at once where their sizes rule ``least`` out."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    common = int((b[i] == a).sum())
    return common / (len(a) + len(b) - common)


def cluster(nodes: list[tuple[int, np.ndarray, np.ndarray, int | None]], threshold: float) -> tuple[list[int], list[bool]]:
    """Clusters of (key, set, bands, known cluster): the index of each node's cluster, and who is an anchor."""
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    known: dict[int, int] = {}
    anchor, is_anchor = list(range(len(nodes))), [False] * len(nodes)
    buckets: dict[int, dict[int, list[int]]] = {}  # of each band: its members by the cluster they were in
    reach = max(0.0, 1 - 2 * (1 - threshold))
    for i, (_, own, bands, label) in enumerate(nodes):
        if label is not None:
            parent[i] = find(known.setdefault(label, i))
        met: dict[int, float] = {}

        def meet(j: int) -> float:
            if j not in met:
                met[j] = similarity(own, nodes[j][1], reach)
                if met[j] >= threshold:
                    parent[find(i)] = find(j)
            return met[j]

        for b in bands:
            groups = buckets.get(b)
            if groups is None:
                continue
            for root in [r for r in groups if find(r) != r]:  # merged since
                members, to = groups.pop(root), find(root)
                groups[to] = groups[to] + members if to in groups else members
            for root, members in groups.items():
                for j in members:
                    if find(i) == find(root):
                        break
                    if j not in met and (anchor[j] == j or meet(anchor[j]) >= reach) and find(i) != find(root):
                        meet(j)
        linked = next((j for j, s in met.items() if s >= threshold and is_anchor[j]), None)
        if linked is None:
            is_anchor[i] = True
        else:
            anchor[i] = linked
        for b in bands:
            buckets.setdefault(b, {}).setdefault(find(i), []).append(i)
    return [find(i) for i in range(len(nodes))], is_anchor


def sketch(docs: DataFrame, keys: tuple[str, ...], column: str, weights: str = "set") -> DataFrame:
    """(keys, node, n_shingles, bands) of every row."""
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", node long, n_shingles long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for whole in batches:
            for batch in slices(whole, column, 4 << 20):
                sets, weight, keys = shingle_sets(batch, column, weights)
                fresh = []
                for i, k in enumerate(keys.tolist()):  # copies of what this task has sent need no bands
                    if len(sets[i]) and k not in seen:
                        seen[k] = None
                        fresh.append(i)
                bands = _signed([sets[i] for i in fresh], [weight[i] for i in fresh]).view(np.int64)
                size = np.zeros(batch.num_rows, np.int64)
                size[fresh] = BANDS
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                column_of = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key_columns), pa.array(keys.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), column_of], names=[*key_columns, "node", "n_shingles", "bands"])

    key_columns = list(keys)
    return docs.select(*keys, column).mapInArrow(tidy(run), schema)


def _sets_of(docs: DataFrame, column: str, wanted: np.ndarray, weights: str) -> DataFrame:
    """(node, shingles, bands) of texts whose node may be wanted, once a task."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole, column, 4 << 20):
                sets, weight, keys = shingle_sets(batch, column, weights)
                fresh = []
                for i in np.flatnonzero(maybe(sent.value, keys)).tolist():
                    if len(sets[i]) and int(keys[i]) not in seen:
                        seen.add(int(keys[i]))
                        fresh.append(i)
                if fresh:
                    bands = _signed([sets[i] for i in fresh], [weight[i] for i in fresh])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[fresh].view(np.int64)), pa.array([sets[i].tobytes() for i in fresh], pa.binary()), pa.array([b.tobytes() for b in bands], pa.binary())], names=["node", "shingles", "bands"])

    return docs.select(column).mapInArrow(tidy(run), "node long, shingles binary, bands binary")


def _clustered(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, label, anchor) by clustering each ``part`` of ``nodes`` (part, node, shingles, bands, known)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, last = None, [], None

        def done():
            label, anchors = cluster(held, threshold)
            least: dict[int, int] = {}
            for (k, _, _, _), c in zip(held, label):
                least[c] = min(k, least.get(c, k))
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([least[c] for c in label], pa.int64()), pa.array(anchors)], names=["node", "label", "anchor"])

        for batch in batches:
            for part, node, shingles, bands, known in zip(*(batch.column(c).to_pylist() for c in ("part", "node", "shingles", "bands", "known"))):
                if part != now:
                    if held:
                        yield done()
                    now, held, last = part, [], None
                if node != last:  # the same node may come from several tasks
                    held.append((node, np.frombuffer(shingles, np.uint64), np.frombuffer(bands, np.uint64).tolist(), known))
                    last = node
        if held:
            yield done()

    dealt = nodes.select("part", "node", "shingles", "bands", "known").repartition("part").sortWithinPartitions("part", "node")
    return dealt.mapInArrow(tidy(run), "node long, label long, anchor boolean")


def block_links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of each right set: its place and the left sets with a similarity of ``threshold`` or more."""
    size = np.array([len(x) for x in left])
    every, owner = np.concatenate(left), np.repeat(np.arange(len(left)), size)
    order = np.argsort(every)
    every, owner = every[order], owner[order]
    for i, own in enumerate(right):
        low = np.searchsorted(every, own)
        n = np.searchsorted(every, own, side="right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(left))
        yield i, np.flatnonzero(common / (size + len(own) - common) >= threshold)


def _linked(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b): labels that links join, within each ``part`` of ``blocks`` (part, side, node, shingles, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done():
            a, b = sides
            pairs = set()
            if a and (b or now[1] == now[2]):
                for i, hits in block_links([x[0] for x in a], [x[0] for x in b or a], threshold):
                    label = (b or a)[i][1]
                    pairs.update((label, a[j][1]) for j in hits.tolist() if a[j][1] != label)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for part, side, shingles, label in zip(*(batch.column(c).to_pylist() for c in ("part", "side", "shingles", "label"))):
                part = tuple(part.values())
                if part != now:
                    if now is not None:
                        yield done()
                    now, sides = part, ([], [])
                sides[side].append((np.frombuffer(shingles, np.uint64), label))
        if now is not None:
            yield done()

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(run), "a long, b long")


def _settled(pool: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``labels`` (node, label) after comparing texts of ``pool`` (node, n, bands, shingles) that share a band."""
    for share in range(SHARES):
        in_band = durable(pool.select("node", "n", F.explode("bands").alias("band")).where(F.pmod(F.xxhash64("band"), F.lit(SHARES)) == share))
        ahead = 0
        while True:
            blocks = F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.count("*") / TEXTS)).cast("int")
            of_band = in_band.join(labels, "node").groupBy("band").agg(blocks.alias("blocks"), F.min("label").alias("x"), F.max("label").alias("y"))
            open_bands = durable(of_band.where(f"x <> y and {ahead} <= blocks div 2").select("band", "blocks"))
            if open_bands.isEmpty():
                break
            block = F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")
            placed = in_band.join(open_bands, "band").withColumn("block", block)
            part = lambda back, side: F.struct(F.struct("band", F.pmod(F.col("block") - back, F.col("blocks")).alias("i"), F.pmod(F.col("block") - back + ahead, F.col("blocks")).alias("j")).alias("part"), F.lit(side).alias("side"))
            parts = [part(0, 0)] + ([part(ahead, 1)] if ahead else [])
            sent = placed.withColumn("_to", F.explode(F.array(*parts))).select("node", "_to.*").join(pool.select("node", "shingles"), "node").join(labels, "node")
            links = durable(_linked(sent, threshold).distinct())
            if not links.isEmpty():
                merged = components(links).withColumnRenamed("node", "label")
                labels = durable(labels.join(merged, "label", "left").select("node", F.coalesce("component", "label").alias("label")))
            ahead += 1
    return labels


def near_duplicate_nodes(docs: DataFrame, keys: tuple[str, ...], column: str = "text", threshold: float = 0.8, weights: str = "set") -> DataFrame:
    """(keys, class) of every row; the class is a node of it: links are similarities of ``threshold`` or more."""
    rows = durable(sketch(docs, keys, column, weights))
    bands = rows.where(F.size("bands") > 0).select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("band", "least")
    edges = bands.join(shared, "band").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    grouped = durable(components(edges))

    sizes = rows.where(F.size("bands") > 0).groupBy("node").agg(F.max("n_shingles").alias("n")).join(grouped, "node")
    salts = sizes.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.count("*") / TEXTS)).cast("int").alias("salts"))
    wanted = bit_table(grouped, "node")
    texts = _sets_of(docs, column, wanted, weights).join(grouped.join(salts, "component"), "node")
    salt = F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")
    held = durable(texts.select("node", "component", "salts", "shingles", "bands", F.struct("component", salt.alias("salt")).alias("part"), F.lit(None).cast("long").alias("known")))
    first = durable(_clustered(held, threshold))
    labels = first.select("node", "label")
    split = held.where("salts > 1")
    if not split.isEmpty():
        some = split.dropDuplicates(["node"]).select("node", (F.length("shingles") / 8).cast("long").alias("n"), "shingles").join(rows.where(F.size("bands") > 0).select("node", "bands").dropDuplicates(["node"]), "node")
        pool = durable(some.join(first.groupBy("node").agg(F.max("anchor").alias("anchor")), "node"))
        labels = durable(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))).withColumnRenamed("component", "label"))
        for part in (pool.where("anchor"), pool):
            labels = _settled(part, labels, threshold)
    found = labels.withColumnRenamed("label", "component")
    return rows.select(*keys, "node").join(found, "node", "left").select(*keys, F.coalesce("component", "node").alias("class"))


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", column: str = "text", threshold: float = 0.8, weights: str = "set") -> DataFrame:
    """(key, class_id) of every row."""
    rows = docs.select(F.col(key).alias("_key"), F.col(column).alias("_text"))
    named = durable(near_duplicate_nodes(rows, ("_key",), "_text", threshold, weights))
    return named.join(named.groupBy("class").agg(F.min("_key").alias("class_id")), "class").select(F.col("_key").alias(key), "class_id")


def keep_one(docs: DataFrame, key: str = "doc_id", column: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id (null first, then by a hash of the text)."""
    names = [f"_{i}" for i in range(len(docs.columns))]  # none that the columns here can clash with
    own, text = names[docs.columns.index(key)], names[docs.columns.index(column)]
    keyed = docs.toDF(*names).withColumn("text_key", text_key(text)).withColumn("row_key", F.xxhash64(own, "text_key"))
    named = durable(near_duplicate_nodes(keyed.select(own, "text_key", "row_key", text), (own, "text_key", "row_key"), text, threshold))
    order = F.struct(own, "text_key")
    best = named.groupBy("class").agg(F.min(order).alias("best"))
    rows = named.join(best, "class").groupBy("row_key").agg(F.max(order == F.col("best")).alias("kept"), F.count("*").alias("n"))
    changes = durable(rows.where("not kept or n > 1").select("row_key", "kept"))
    table = bit_table(changes, "row_key")
    touched = maybe_in(keyed, table, once=False, key="row_key").join(changes, "row_key", "left")
    once = touched.where("kept").dropDuplicates(["row_key"]).select(*names)
    others = maybe_in(keyed, table, once=False, inside=False, key="row_key").select(*names).unionByName(touched.where("kept is null").select(*names))
    return others.unionByName(once).toDF(*docs.columns)
