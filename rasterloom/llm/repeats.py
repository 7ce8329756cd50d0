"""Operator 5: repeated substrings by a distributed difference-cover suffix algorithm.

Every byte that a string of ``LENGTH`` bytes covers which also starts at another place is removed (all places,
matches inside one text and overlaps included, judged on the input). A full suffix array of the corpus isn't
needed for that: suffixes only have to be told apart by their first ``LENGTH`` bytes. So the difference-cover
algorithm runs to that depth:

1. Sampled suffixes. With a perfect difference cover D of the residues modulo V, any two places have a shift
   under V that puts both on sampled places. Every sampled place is named by its next ``WIDTH`` = LENGTH + 1 - V bytes;
   equal names meet in one bucket, which sorts them; places with a name of their own are done with.
2. Recursion on names. For the others, the triple of names at p - V, p and p + V names a stretch that holds every
   string of ``LENGTH`` bytes through p; places with equal triples are repeated as a whole.
3. Remaining suffixes. Where a triple is alone, a repeat begins or ends nearby: for these places (and one of each
   triple they share a name with) the strings of ``LENGTH`` at each of the V shifts are hashed where the text is,
   each string once; equal ones of a task become one with a flag, and only strings with equal content meet, so a
   name that half of the corpus has is dealt by what surrounds it.

Fingerprints of bytes are multilinear sums of 32-bit words under secret keys, drawn anew for each run (``Codes``): no
text can be made to collide, and two given different strings share 64 bits with probability 2**-64, whatever they are.
Names have 64 bits, a place with its triple 128 and more, strings 128. Bytes aren't compared again: the weakest decision is
the last name of a stretch, which takes 2**64 pairs of passages that end differently for one to be expected wrong. Texts are known by bits of their
SHA-256, and where 64 of them are those of another text (``with_text_keys``) by other bits, so equal texts are one text with a
count, and a text that occurs twice is removed whole. Matches never cross texts. Rows with null text are
empty; texts under ``LENGTH`` bytes keep everything; repeated rows and null ids are rows like any other; an empty
table gives an empty result; other columns may have any name.

With ``words`` the same runs over words instead of bytes (``word_bounds``): places, ``length`` and ``v`` count words,
and a string goes from the first byte of its first word to the last of its last; what is between counts.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import bit_table, maybe_in
from .common import durable, mix, slices, text_buffers, tidy, total_bytes

LENGTH = 400
# Perfect difference covers: every residue modulo V is a difference of two of these (fixed values).
COVERS = {
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    133: (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121),
    183: (1, 13, 20, 21, 23, 44, 61, 72, 77, 86, 90, 116, 122, 169),
}
PER_BUCKET = 12 << 20  # bytes of text whose samples meet in one bucket
FLUSH = 700_000  # samples that a task holds before it sends them
_BASE = 0x9E3779B97F4A7C15
LONGEST = 4096  # bytes of a window that is a sum of words; a longer one (of huge words) is hashed as a whole
AT_ONCE = 1 << 15  # windows that are summed together


class Codes:
    """Fingerprints of windows of a buffer: for each lane of 32 bits, the upper half of k0 + k1 w1 + k2 w2 + ... modulo
    2**64, with the window's 32-bit words, filled up with zeros, and its length, under keys of 64 secret bits each. That family is strongly
    universal: different windows have equal lanes with probability 2**-32, each lane on its own."""

    def __init__(self, seed: int, lanes: int):
        self.seed = seed
        self.keys = np.random.default_rng(seed).integers(0, 1 << 64, (lanes, LONGEST // 4 + 2), np.uint64)

    def __call__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Columns of 64 bits (two lanes each) of the windows."""
        n = len(raw)
        if n % 4 or n < 8 or not raw.flags.c_contiguous:
            raw = np.pad(raw, (0, 8))
            n = len(raw)
        words = np.ndarray((n - 3,), "<u4", raw, strides=(1,))
        out = np.zeros((len(self.keys) // 2, len(start)), np.uint64)
        size = end - start
        for a in range(0, len(start), AT_ONCE):
            order = np.argsort(-size[a : a + AT_ONCE], kind="stable") + a
            order = order[size[order] <= LONGEST]
            out[:, order] = self._sums(words, start[order], size[order])
        for i in np.flatnonzero(size > LONGEST):
            digest = hashlib.blake2b(raw[start[i] : end[i]], digest_size=8 * len(out), key=self.keys[:, 0].tobytes()[:64]).digest()
            out[:, i] = np.frombuffer(digest, np.uint64)
        return list(out)

    def _sums(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of windows from long to short."""
        sums = [k[0] + k[1] * size.astype(np.uint64) for k in self.keys]
        whole, rest = size >> 2, size & 3
        live = np.searchsorted(-whole, -np.arange(1, (whole[0] if len(whole) else 0) + 1), side="right")  # windows with so many words
        for i, m in enumerate(live.tolist()):
            w = words[start[:m] + 4 * i].astype(np.uint64)
            for total, k in zip(sums, self.keys):
                total[:m] += k[i + 2] * w
        part = np.flatnonzero(rest)
        if len(part):
            at = start[part] + 4 * whole[part]
            behind = at - np.minimum(at, len(words) - 1)  # the last bytes of the buffer aren't a whole word
            w = words[at - behind].astype(np.uint64) >> (8 * behind).astype(np.uint64)
            w &= (np.uint64(1) << (8 * rest[part]).astype(np.uint64)) - np.uint64(1)
            for total, k in zip(sums, self.keys):
                total[part] += k[whole[part] + 2] * w
        high = [t >> np.uint64(32) for t in sums]
        return np.array([x << np.uint64(32) | y for x, y in zip(high[::2], high[1::2])])


def secret_codes(lanes: int) -> Codes:
    """Codes with new keys; a job's tasks, and tasks that run again, share them."""
    return Codes(secrets.randbits(127), lanes)


def with_text_keys(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with ``text_key``: 64 bits of the text's SHA-256 (null as empty). Texts that share them take the next
    64 bits until different texts have different keys."""
    digest = F.sha2(F.coalesce(F.col(column), F.lit("")), 256)
    bits = lambda k: F.conv(F.substring(digest, 1 + 16 * k, 16), 16, -10).cast("long")
    keyed = docs.withColumn("text_key", bits(0))
    for k in (1, 2, 3):
        pairs = keyed.select("text_key", F.unhex(F.substring(digest, 17, 48)).alias("rest")).groupBy("text_key").agg(F.min("rest").alias("a"), F.max("rest").alias("b"))
        shared = durable(pairs.where("a <> b").select("text_key", F.lit(True).alias("_shared")))
        if shared.isEmpty():
            break
        keyed = keyed.join(shared, "text_key", "left").withColumn("text_key", F.when(F.col("_shared"), bits(k)).otherwise(F.col("text_key"))).drop("_shared")
    return keyed


_SPACE, _SOLID = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's words: what white space parts, less ASCII punctuation around it.

    Ideographs, kana and Thai to Burmese letters, which are written without spaces, count as a word each.
    """
    space = _SPACE[raw]
    at = np.flatnonzero(raw >= 0xC2)
    x, y, z = (np.take(raw, at + k, mode="clip") for k in range(3))
    blank = ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F))))
    blank |= ((x == 0xE3) & (y == 0x80)) | ((x == 0xEF) & (y == 0xBC) & (z <= 0x8F))  # with marks of these scripts
    for size, found in ((2, (x == 0xC2) & ((y == 0xA0) | (y == 0x85))), (3, blank)):
        for k in range(size):
            space[at[found] + k] = True
    first = ~space
    first[1:] &= space[:-1]
    lone = ~blank & (((x >= 0xE3) & (x <= 0xE9)) | ((x == 0xF0) & (y >= 0xA0)) | ((x == 0xE0) & (y >= 0xB8) & (y <= 0xBB)) | ((x == 0xE1) & ((y == 0x80) | (y == 0x81) | (y == 0x9E) | (y == 0x9F))))
    first[at[lone]] = True
    after = at[lone] + np.where(x[lone] == 0xF0, 4, 3)
    after = after[after < len(raw)]
    first[after] = ~space[after]
    last = ~space
    last[:-1] &= space[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    solid = np.flatnonzero(_SOLID[raw])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = a < b
    start[some], end[some] = solid[a[some]], solid[b[some] - 1] + 1
    return start, end


def sampled(n: int, v: int, width: int) -> np.ndarray:
    """Sampled places of a text of n bytes that have ``width`` bytes after them."""
    if n < width:
        return np.empty(0, np.int64)
    first = np.zeros(v, bool)
    first[[d % v for d in COVERS[v]]] = True
    return np.flatnonzero(np.resize(first, n - width + 1))


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys (first key first), and where a new combination starts in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, new


KINDS = {"name": np.uint64, "place": np.uint32, "text_key": np.int64, "triple": np.uint64, "flag": np.uint8, "code": np.uint64, "code2": np.uint64}


def _pack(name: str, values: np.ndarray) -> bytes:
    """A column of a bucket's rows: byte planes, so that empty high bytes compress away; runs of equal text keys
    once with their lengths."""
    if name == "text_key":
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return np.int64(len(first)).tobytes() + values[first].tobytes() + np.diff(np.append(first, len(values))).astype(np.uint32).tobytes()
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unpack(name: str, data: bytes) -> np.ndarray:
    if name == "text_key":
        n = int(np.frombuffer(data, np.int64, 1)[0])
        return np.repeat(np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.uint32, n, 8 + 8 * n))
    kind = np.dtype(KINDS[name])
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T).view(kind)[:, 0]


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket, with its rows' columns packed."""
    order = np.argsort(bucket, kind="stable")
    ids, starts = np.unique(bucket[order], return_index=True)
    bounds = [*starts.tolist(), len(order)]
    cols = [pa.array(ids.astype(np.int32))]
    for name, c in columns.items():
        c = np.ascontiguousarray(c[order])
        cols.append(pa.array([_pack(name, c[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=["bucket", *columns])


def _gathered(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each bucket, joined; rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for key, *parts in zip(*(batch.column(c).to_pylist() for c in ("bucket", *names))):
            if key != now and held:
                yield now, [np.concatenate(c) for c in zip(*held)]
                held = []
            now = key
            held.append([_unpack(n, p) for n, p in zip(names, parts)])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


def _schema(*names: str) -> str:
    return "bucket int, " + ", ".join(f"{n} binary" for n in names)


def _by_bucket(df: DataFrame, by: str = "bucket") -> DataFrame:
    return df.repartition(by).sortWithinPartitions(by)


def repeated_spans(docs: DataFrame, column: str, length: int = LENGTH, v: int = 183, words: bool = False) -> DataFrame:
    """(text_key, spans): packed (start, end) pairs of int64, merged, of texts that other places repeat in part.

    ``docs`` has ``text_key`` (of the text) and ``column``. Whole copies aren't reported here. With ``words`` the
    pairs count words, and spans that only touch stay apart.
    """
    width = length + 1 - v
    name_of, string_of = secret_codes(2), secret_codes(4)
    least, touch = least_bytes(length, words), not words
    buckets = max(4, -(-total_bytes(docs, column) // PER_BUCKET))
    text_buckets = 4 * buckets
    place_of = ("name", "place", "text_key")
    to_name = lambda name: (mix(name) % np.uint64(buckets)).astype(np.int64)
    to_text = lambda key: (mix(key.view(np.uint64)) % np.uint64(text_buckets)).astype(np.int64)

    # 1. names of sampled places; those that occur at two places or more
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            name, place, key = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            # A name that this task has more than once is repeated in any case: one of its places goes on, with a
            # flag, to meet the rest; the others (negative buckets, dealt by text) needn't.
            keep, rest, flag = once_each(name)
            yield _packed(to_name(name[keep]), {"name": name[keep], "place": place[keep], "text_key": key[keep], "flag": flag[keep]})
            if len(rest):
                yield _packed(-1 - to_text(key[rest]), {"name": name[rest], "place": place[rest], "text_key": key[rest], "flag": flag[rest]})

        for whole in batches:
            for batch in slices(whole, column):
                offsets, data = text_buffers(batch.column(column))
                raw = np.frombuffer(data, np.uint8)
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
                for key, a, b in zip(batch.column("text_key").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    if b - a < least or key in seen:
                        continue
                    seen.add(key)
                    bounds = word_bounds(raw[a:b]) if words else None
                    n = len(bounds[0]) if words else b - a
                    if n < length:
                        continue
                    places = sampled(n, v, width)
                    found.append((*windows(places, width, bounds, a), places.astype(np.uint32), np.full(len(places), key, np.int64)))
                if found:
                    start, end, places, keys = (np.concatenate(c) for c in zip(*found))
                    held.append((name_of(raw, start, end)[0], places, keys))
                    count += len(places)
                    if count > FLUSH:
                        yield from flush()
                        count = 0
        if held:
            yield from flush()

    def repeated_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (name, place, key, flag) in _gathered(batches, *place_of, "flag"):
            if bucket >= 0:
                order, new = _runs(name, key, place)  # copies of one text send the same place
                first = np.concatenate([[True], name[order][1:] != name[order][:-1]])
                group = np.cumsum(first) - 1
                often = (np.bincount(group, new) > 1) | (np.bincount(group, flag[order]) > 0)
                keep = order[new & often[group]]
                name, place, key = name[keep], place[keep], key[keep]
            if len(name):
                order = np.argsort(key, kind="stable")
                name, place, key = name[order], place[order], key[order]
                yield _packed(to_text(key), {"name": name, "place": place, "text_key": key})

    # 2. triples of names, text by text; then back to the names' buckets
    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (name, place, key) in _gathered(batches, *place_of):
            order, new = _runs(key, place)
            order = order[new]
            name, place, key = name[order], place[order], key[order]
            which = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            at = which * (1 << 34) + place + v
            triple, complete = mix(name + np.uint64(1)), np.ones(len(name), bool)
            for shift in (-v, v):
                i = np.minimum(np.searchsorted(at, at + shift), len(at) - 1)
                complete &= at[i] == at + shift
                triple = mix(triple * np.uint64(_BASE) + name[i])
            triple[~complete] = 0
            # equal triples in this bucket are settled here; one of them, with a flag, goes on
            order, first = _runs(name, triple)
            size = np.diff(np.append(np.flatnonzero(first), len(order)))
            flag = np.zeros(len(name), np.uint8)
            flag[order] = np.repeat(size > 1, size) & (triple[order] != 0)
            rest = order[~first & (triple[order] != 0)]
            keep = np.sort(order[first | (triple[order] == 0)])
            yield _packed(to_name(name[keep]), {"name": name[keep], "place": place[keep], "text_key": key[keep], "triple": triple[keep], "flag": flag[keep]})
            if len(rest):
                rest = np.sort(rest)
                yield _packed(np.full(len(rest), -1 - bucket), {"name": name[rest], "place": place[rest], "text_key": key[rest], "triple": triple[rest], "flag": flag[rest]})

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """flag 0: the stretch of a repeated triple; flag 1: a place around which strings must be looked at."""
        for bucket, (name, place, key, triple, flag) in _gathered(batches, *place_of, "triple", "flag"):
            if bucket < 0:
                yield _packed(np.full(len(name), -1 - bucket), {"place": place, "text_key": key, "flag": np.zeros(len(name), np.uint8)})
                continue
            order, first = _runs(name, triple)
            name, place, key, triple, flag = (x[order] for x in (name, place, key, triple, flag))
            group = np.cumsum(first) - 1
            whole = (triple != 0) & ((np.bincount(group) > 1) | (np.bincount(group, flag) > 0))[group]
            same = np.cumsum(np.concatenate([[True], name[1:] != name[:-1]])) - 1
            look = (np.bincount(same, ~whole) > 0)[same] & (~whole | first)
            out = np.concatenate([np.flatnonzero(whole), np.flatnonzero(look)])
            kind = np.repeat(np.array([0, 1], np.uint8), [whole.sum(), look.sum()])
            order = np.argsort(key[out], kind="stable")
            out, kind = out[order], kind[order]
            if len(out):
                yield _packed(to_text(key[out]), {"place": place[out], "text_key": key[out], "flag": kind})

    # 3. the strings around open places, text by text
    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (place, key, kind) in _gathered(batches, "place", "text_key", "flag"):
            order, first = _runs(key)
            bounds = [*np.flatnonzero(first).tolist(), len(order)]
            rows = []
            for a, b in zip(bounds, bounds[1:]):
                o = order[a:b]
                at, look = place[o[kind[o] == 0]].astype(np.int64), o[kind[o] == 1]
                rows.append((int(key[o[0]]), _merged(at - v, at + v + width, touch).tobytes(), place[look].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["text_key", "spans", "places"])

    samples = docs.select("text_key", column).mapInArrow(tidy(sample), _schema(*place_of, "flag"))
    candidates = _by_bucket(samples).mapInArrow(tidy(repeated_names), _schema(*place_of))
    named = _by_bucket(candidates).mapInArrow(tidy(triples), _schema(*place_of, "triple", "flag"))
    found = _by_bucket(named).mapInArrow(tidy(compared), _schema("place", "text_key", "flag"))
    texts_found = durable(_by_bucket(found).mapInArrow(tidy(by_text), "text_key long, spans binary, places binary"))
    to_look = texts_found.where(F.length("places") > 0)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings around open places; of those that this task has more than once one meets the rest, with a flag."""
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            code, code2, place, key = (np.concatenate([h[i] for h in held]) for i in range(4))
            held.clear()
            keep, rest, flag = once_each(code, code2)
            columns = {"code": code, "code2": code2, "place": place, "text_key": key, "flag": flag}
            yield _packed(to_text(code[keep]), {n: c[keep] for n, c in columns.items()})
            if len(rest):  # settled: dealt by text (negative buckets), where codes aren't read
                columns["code"] = columns["code2"] = np.zeros(len(code), np.uint64)
                yield _packed(-1 - to_text(key[rest]), {n: c[rest] for n, c in columns.items()})

        for whole in batches:
            for batch in slices(whole, column, 1 << 20):
                for key, text, place in zip(*(batch.column(c).to_pylist() for c in ("text_key", column, "places"))):
                    if key in seen:
                        continue
                    seen.add(key)
                    raw = np.frombuffer(text.encode(), np.uint8)
                    bounds = word_bounds(raw) if words else None
                    at = around(np.frombuffer(place, np.uint32).astype(np.int64), len(bounds[0]) if words else len(raw), v, length)
                    held.append((*string_of(raw, *windows(at, length, bounds)), at.astype(np.uint32), np.full(len(at), key, np.int64)))
                    count += len(at)
                    if count > FLUSH:
                        yield from flush()
                        count = 0
        if held:
            yield from flush()

    def repeated_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (code, code2, place, key, flag) in _gathered(batches, "code", "code2", "place", "text_key", "flag"):
            if bucket >= 0:
                order, new = _runs(code, code2, key, place)  # copies of one text send the same string
                first = np.concatenate([[True], (code[order][1:] != code[order][:-1]) | (code2[order][1:] != code2[order][:-1])])
                group = np.cumsum(first) - 1
                often = (np.bincount(group, new) > 1) | (np.bincount(group, flag[order]) > 0)
                keep = order[new & often[group]]
                place, key = place[keep], key[keep]
            if len(key):
                yield _packed(to_text(key), {"place": place, "text_key": key})

    def their_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (place, key) in _gathered(batches, "place", "text_key"):
            order, _ = _runs(key, place)
            at, key = place[order].astype(np.int64), key[order]
            bounds = [*np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist(), len(key)]
            spans = [_merged(at[a:b], at[a:b] + length, touch).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(key[bounds[:-1]]), pa.array(spans, pa.binary())], names=["text_key", "spans"])

    looked = maybe_in(docs.select("text_key", column), bit_table(to_look, "text_key")).join(to_look.select("text_key", "places"), "text_key")
    found_strings = looked.mapInArrow(tidy(strings), _schema("code", "code2", "place", "text_key", "flag"))
    again = _by_bucket(found_strings).mapInArrow(tidy(repeated_strings), _schema("place", "text_key"))
    more = _by_bucket(again).mapInArrow(tidy(their_spans), "text_key long, spans binary")
    every = texts_found.where(F.length("spans") > 0).select("text_key", "spans").unionByName(more)

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def row():
            pairs = np.concatenate(held).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_merged(pairs[:, 0], pairs[:, 1], touch).tobytes()], pa.binary())], names=["text_key", "spans"])

        for batch in batches:
            for key, spans in zip(batch.column("text_key").to_pylist(), batch.column("spans").to_pylist()):
                if key != now and held:
                    yield row()
                    held = []
                now = key
                held.append(np.frombuffer(spans, np.int64))
        if held:
            yield row()

    return _by_bucket(every, "text_key").mapInArrow(tidy(union), "text_key long, spans binary")


def around(place: np.ndarray, n: int, v: int, length: int) -> np.ndarray:
    """Starts of the strings of ``length`` that begin less than ``v`` before a place, each once, in a text of n."""
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, np.maximum(place - v + 1, 0), 1)
    np.add.at(edge, place + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, n - length + 1)] > 0)


def windows(start: np.ndarray, width: int, bounds: tuple[np.ndarray, np.ndarray] | None, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of windows of ``width`` bytes, or words with these ``bounds``."""
    if bounds is None:
        return base + start, base + start + width
    return base + bounds[0][start], base + bounds[1][start + width - 1]


def once_each(*code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that go on, one of each code; rows that needn't, as their code is repeated; a flag where it is."""
    order, first = _runs(*code)
    flag = np.zeros(len(code[0]), np.uint8)
    flag[order[first]] = np.diff(np.append(np.flatnonzero(first), len(order))) > 1
    return np.sort(order[first]), np.sort(order[~first]), flag


def least_bytes(length: int, words: bool) -> int:
    """Bytes that no string of ``length`` undercuts: words have a byte each and one between them."""
    return 2 * length - 1 if words else length


def _merged(start: np.ndarray, end: np.ndarray, touch: bool = True) -> np.ndarray:
    """Union of spans as (start, end) rows; touching spans join if ``touch``."""
    if not len(start):
        return np.empty((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    at = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1] if touch else start[1:] >= end[:-1]]))
    return np.column_stack([start[at], end[np.append(at[1:] - 1, len(end) - 1)]]).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch], column: str, length: int, words: bool = False) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, int, int]]]]:
    """Each batch with (kept bytes, removed bytes, removed spans) of its rows.

    ``copied``, where the batch has it: digests of texts that occur twice; such a text goes as a whole.
    """
    for whole in batches:
        for batch in slices(whole, column):
            out = []
            copied = batch.column("copied").to_pylist() if "copied" in batch.schema.names else [None] * batch.num_rows
            for text, spans, digests in zip(batch.column(column).to_pylist(), batch.column("spans").to_pylist(), copied):
                raw, pairs = (text or "").encode(), np.frombuffer(spans or b"", np.int64).reshape(-1, 2)
                start, end = word_bounds(np.frombuffer(raw, np.uint8)) if words else (raw, raw)
                if digests and len(start) >= length and hashlib.sha256(raw).hexdigest() in digests:
                    pairs = np.array([[0, len(raw)]])
                elif words and len(pairs):
                    pairs = np.column_stack([start[pairs[:, 0]], end[pairs[:, 1] - 1]])
                pairs = pairs.tolist()
                edges = [0, *(x for p in pairs for x in p), len(raw)]
                out.append((b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), sum(b - a for a, b in pairs), len(pairs)))
            yield batch, out


def repeat_report(docs: DataFrame, key: str = "doc_id", column: str = "text", length: int = LENGTH, v: int = 183) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, n_kept, n_kept_chars) of every row.

    ``n_kept`` counts the bytes that stay, ``n_kept_chars`` the characters that begin in them.
    """
    keyed = with_text_keys(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(column), F.lit("")).alias("_text")), "_text")
    rows = durable(keyed.select("_key", "text_key", F.octet_length("_text").cast("long").alias("n_bytes"), F.length("_text").cast("long").alias("n_chars"), F.sha2("_text", 256).alias("whole_sha256")))
    same = ["text_key", "whole_sha256"]
    copies = rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same, F.lit(True).alias("copied"))
    spans = durable(repeated_spans(keyed, "_text", length, v))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cut in _cut(batches, "_text", length):
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.int64()), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cut], pa.string()), pa.array([int(((np.frombuffer(c[0], np.uint8) & 0xC0) != 0x80).sum()) for c in cut], pa.int64())], names=["text_key", "removed", "spans", "kept", "chars"])

    part = maybe_in(keyed.select("text_key", "_text"), bit_table(spans, "text_key")).join(spans, "text_key")
    cut = part.mapInArrow(tidy(digest), "text_key long, removed long, spans long, kept string, chars long").dropDuplicates(["text_key"])
    whole = F.col("copied").isNotNull() & (F.col("n_bytes") >= length)
    return rows.join(copies, same, "left").join(cut, "text_key", "left").select(
        F.col("_key").alias(key),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "whole_sha256")).alias("kept_sha256"),
        F.when(whole, F.lit(0).cast("long")).otherwise(F.col("n_bytes") - F.coalesce("removed", F.lit(0))).alias("n_kept"),
        F.when(whole, F.lit(0).cast("long")).otherwise(F.coalesce("chars", "n_chars")).alias("n_kept_chars"),
    )


def remove_repeats(docs: DataFrame, column: str = "text", length: int = LENGTH, v: int = 183, words: bool = False) -> DataFrame:
    """``docs`` with every repeated byte taken out of ``column``; a character cut in two loses both parts.

    With ``words``, bytes of repeated strings of ``length`` words. Other columns stay, whatever their names.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]  # none that the columns here can clash with
    text = names[docs.columns.index(column)]
    keyed = with_text_keys(docs.toDF(*names), text)
    long_ones = keyed.where(F.octet_length(text) >= least_bytes(length, words)).groupBy("text_key", F.sha2(text, 256).alias("sha")).agg(F.count("*").alias("n"))
    copies = durable(long_ones.where("n > 1").groupBy("text_key").agg(F.collect_list("sha").alias("copied")))
    changes = durable(repeated_spans(keyed, text, length, v, words).join(copies, "text_key", "full_outer"))
    table = bit_table(changes, "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cut in _cut(batches, text, length, words):
            new = [None if old is None else c[0].decode("utf-8", "ignore") for c, old in zip(cut, batch.column(text).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == text else batch.column(n) for n in names], names=names)

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    touched = maybe_in(keyed, table, once=False).join(changes, "text_key", "left").mapInArrow(tidy(run), schema)
    return maybe_in(keyed, table, once=False, inside=False).select(*names).unionByName(touched).toDF(*docs.columns)
