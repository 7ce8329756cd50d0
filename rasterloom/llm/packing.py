"""Operator 1: best-fit packing after Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` tokens. What packing depends on is only how many pieces
have each length, so the plan is made from at most ``capacity`` counts, however many documents there are:

1. Reduction. A feasible set dominates another if its pieces can stand for groups of the other's. Of all sets that
   hold one length, taken from the longest down, one dominates where it fills the sequence in two; where nothing
   fits beside it; where only one more fits (the longest that does); where two more fit, but the longest partner is
   as long as the longest two together; or where, with the longest partner, as long a piece fits as in any other
   way. Such sets are fixed for good, as often as the counts allow, and taken out of the instance.
2. Best fit, in decreasing length, for the remainder: the fullest sequence that still has room, with sequences of
   equal content kept as one group and a count.

The plan is a list of (content, count) groups: each length adds a few groups at most, and a group holds at most
some sixty different lengths, so its size is bounded by the capacity. It gives every length ranges of ranks.
Pieces are ranked within (length, salt), with a salt for each ``PER_RANK`` pieces of the length, so that a length
that a third of all pieces share is ranked by many tasks; they find their sequence and offset by a join with the
ranges, which are cut into blocks of ranks.

Null and empty texts are the end token alone; repeated rows are packed one by one; an empty table packs to none.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, kept, slices, text_buffers, tidy

PER_RANK = 500_000  # pieces of one length that one task ranks
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
_STOP = 0xFFFFFFFF  # parts ids; their own two high bytes are never all ones
_STOP_BYTES = array("I", [_STOP]).tobytes()
_ODD = regex.compile("[\x1c-\x1f]")
CACHE = 250_000  # chunks that a task remembers
WORDS = 400_000  # words that it remembers; they take longer to learn again


class WordTokenizer:
    """Ids of texts by a tokenizers file whose words end at white space, each distinct word encoded once.

    A text is the concatenation of its white-space chunks. Chunks of Latin-1 characters are lowered and cut by the
    file's own pattern, and their words go to the file's BPE in one call for all new words of a slice; other
    chunks, and texts with separators on which libraries differ, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.plain = spec.get("normalizer") and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(spec, ensure_ascii=False).replace("\\\\", "\\")
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]}}
        self.words_only = Tokenizer.from_str(json.dumps(spec))
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        plain = [c for c in new if "<|" not in c and (c.isascii() or max(c) < "Ā")]
        if len(plain) < len(new):
            self.chunks |= {c: self._whole(c) for c in set(new).difference(plain)}
        # All new chunks are cut in one call, and so are all bytes of ids: chunks hold no white space, ids no _STOP.
        words = _WORDS.findall("\n".join(plain).lower())
        fresh = list(set(words).difference(self.words, "\n"))
        if fresh:
            e = self.words_only.encode(" ".join(fresh), add_special_tokens=False)
            of = np.array(e.word_ids)
            ids = np.insert(np.array(e.ids, "<u4"), np.flatnonzero(of[1:] != of[:-1]) + 1, _STOP)
            self.words.update(zip(fresh, ids.tobytes().split(_STOP_BYTES), strict=True))
        if plain:
            self.words["\n"] = _STOP_BYTES
            self.chunks.update(zip(plain, b"".join(map(self.words.__getitem__, words)).split(_STOP_BYTES), strict=True))

    def forget(self) -> None:
        """Start anew: learning a task's words again costs little, and a worker's memory is for its next operator."""
        self.chunks, self.words = {}, {}

    def encode(self, many: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.chunks) > CACHE:
            self.chunks = {}
        if len(self.words) > WORDS:
            self.words = {}
        out: list[bytes | None] = [None if not self.plain or _ODD.search(text) else b"" for text in many]
        chunks = pc.utf8_split_whitespace(pa.array([text for text, ids in zip(many, out) if ids is not None], pa.large_string()))
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = list(filterfalse(self.chunks.__contains__, distinct))
        if new:
            self._learn(new)
        ids = pa.array(list(map(self.chunks.__getitem__, distinct)), pa.large_binary()).take(coded.indices)
        at, data = text_buffers(ids)
        at = at[chunks.offsets.to_numpy()].tolist()
        spans = zip(at[:-1], at[1:])
        return [self._whole(text) if known is None else bytes(data[slice(*next(spans))]) for text, known in zip(many, out)]


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker."""
    return kept(("tokenizer", path), lambda: WordTokenizer(path))


def token_pieces(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of each document: key, piece, start, length, ids_crc32 and, if asked, ids (little-endian 32 bits)."""
    schema = f"`{key}` {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    tail = array("I", [end_id]).tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, column, 4 << 20):
                source, rows = [], []
                for i, ids in enumerate(t.encode([x or "" for x in batch.column(column).to_pylist()])):
                    ids += tail
                    for n, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        source.append(i)
                        rows.append((n, at // 4, len(part) // 4, zlib.crc32(part), part))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 4 + with_ids]
                cols = [pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(source, pa.int64())), *cols], names=[key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
        t.forget()

    return docs.select(key, column).mapInArrow(tidy(run, keeps=True), schema)


Group = tuple[list[tuple[int, int]], int]  # ((length, how many in a sequence) ..., number of such sequences)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Sets that dominate all others that share a piece with them, fixed; and the counts that are left."""
    left = {n: c for n, c in counts.items() if c}
    fixed: list[Group] = []

    def take(lengths: list[int], times: int) -> None:
        if times:
            fixed.append(([(n, lengths.count(n)) for n in dict.fromkeys(lengths)], times))
            for n in lengths:
                left[n] -= times
                if not left[n]:
                    del left[n]

    take([capacity], left.get(capacity, 0))
    for n in sorted(left):  # lengths that fill a sequence together
        other = capacity - n
        if n == other and n in left:
            take([n, n], left[n] // 2)
        elif n < other and n in left and other in left:
            take([other, n], min(left[n], left[other]))
    for n in sorted(left, reverse=True):  # what is known of the sets that hold n
        while n in left:
            best = _dominating(n, left, capacity)
            if best is None:
                break
            whole = [n, *best]
            take(whole, min(left[x] // whole.count(x) for x in whole))
    return fixed, left


def _dominating(n: int, left: dict[int, int], capacity: int) -> list[int] | None:
    """The partners of the set with n that dominates all other sets with n, or None where none is known to."""
    room = capacity - n
    have = lambda x: left.get(x, 0) - (x == n)
    fits = sorted(x for x in left if x <= room and have(x) > 0)
    if not fits:
        return []
    longest = fits[-1]
    low = [x for x in fits[:3] for _ in range(min(3, have(x)))][:3]
    if len(low) < 2 or low[0] + low[1] > room:
        return [longest]
    if len(low) == 3 and sum(low) <= room:
        return None
    most, shorter, beside, at = 0, 0, 0, len(fits) - 1
    for i, x in enumerate(fits):  # two that fit together, x being the shorter one
        while at >= 0 and fits[at] + x > room:
            at -= 1
        j = at if at != i or have(x) > 1 else at - 1
        if j < i:
            break
        most, shorter = max(most, x + fits[j]), x
        beside = x if fits[j] == longest else beside
    if longest >= most:
        return [longest]
    return [longest, beside] if beside and beside >= shorter else None


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best fit in decreasing length; equal sequences stay one group."""
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def put(room: int, group: Group) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(group)

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                if c >= each:
                    put(capacity - each * n, ([(n, each)], c // each))
                if c % each:
                    put(capacity - c % each * n, ([(n, c % each)], 1))
                break
            room = rooms[at]
            content, times = by_room[room].pop()
            each = min(room // n, c)
            filled = min(times, c // each)
            if times > filled:
                by_room[room].append((content, times - filled))
            elif not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            put(room - each * n, ([*content, (n, each)], filled))
            c -= filled * each
    return [g for groups in by_room.values() for g in groups]


def plan(counts: dict[int, int], capacity: int) -> list[Group]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def pack(pieces: DataFrame, length: str = "length", capacity: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``length`` holds 1 to ``capacity``. Reads ``pieces`` three times."""
    spark = pieces.sparkSession
    names = [f"_{i}" for i in range(len(pieces.columns))]  # none that the columns here can clash with
    rows = pieces.toDF(*names).withColumn("length", F.col(names[pieces.columns.index(length)]).cast("long"))
    plain = [n for n, (_, t) in zip(names, pieces.dtypes) if t not in ("void", "binary") and not t.startswith(("map", "array", "struct"))]
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # a row a length
    salts = {n: -(-c // PER_RANK) for n, c in counts.items() if c > PER_RANK}
    salted = rows.withColumn("salt", F.lit(0).cast("long"))
    base = {(n, 0): 0 for n in counts}
    if salts:
        many = F.create_map(*[F.lit(x).cast("long") for kv in salts.items() for x in kv])
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(*plain), F.coalesce(F.element_at(many, F.col("length")), F.lit(1).cast("long"))))
        at = dict.fromkeys(salts, 0)
        of_salts = salted.where(F.col("length").isin(list(salts))).groupBy("length", "salt").count()
        for n, salt, c in sorted(tuple(r) for r in of_salts.collect()):  # a row for each PER_RANK pieces
            base[n, salt] = at[n]
            at[n] += c
    ranges: dict[int, list] = {}
    used, sequence = dict.fromkeys(counts, 0), 0
    for content, times in plan(counts, capacity):
        at_token = 0
        for n, each in content:
            ranges.setdefault(n, []).append((used[n], used[n] + times * each, sequence, each, at_token))
            used[n] += times * each
            at_token += n * each
        sequence += times
    width = {n: -(-counts[n] // len(r)) for n, r in ranges.items()}
    blocks: dict[tuple[int, int], list] = {}
    for n, found in ranges.items():
        for r in found:
            for block in range(r[0] // width[n], (r[1] - 1) // width[n] + 1):
                blocks.setdefault((n, block), []).append(r)
    bases = spark.createDataFrame([(n, salt, b, width[n]) for (n, salt), b in base.items()], "length long, salt long, base long, width long")
    lookup = spark.createDataFrame([(*k, v) for k, v in blocks.items()], "length long, block long, ranges array<struct<a:long,b:long,first:long,each:long,at:long>>")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*plain)) - 1
    inside = F.col("rank") - F.col("r.a")
    return (
        salted.withColumn("rank", rank)
        .join(F.broadcast(bases), ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("base"))
        .withColumn("block", F.floor(F.col("rank") / F.col("width")))
        .join(F.broadcast(lookup), ["length", "block"])
        .withColumn("r", F.filter("ranges", lambda r: (r["a"] <= F.col("rank")) & (F.col("rank") < r["b"]))[0])
        .select(*[F.col(n).alias(c) for n, c in zip(names, pieces.columns)], (F.col("r.first") + F.floor(inside / F.col("r.each"))).alias("sequence_id"), (F.col("r.at") + inside % F.col("r.each") * F.col("length")).alias("offset"))
    )


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", column: str = "text", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenize once, cut the lineage, and pack."""
    return pack(durable(token_pieces(docs, path, key, column, capacity, with_ids=with_ids)), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (pieces that carry ``ids`` are needed)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))
