"""Operator 9: one Aho-Corasick automaton over normalised test questions and answers, scanning each text once.

A-Z are lowered; a word is a run of 0-9, a-z and non-ASCII characters. A window is ``window`` consecutive words
of an item; an item with fewer words (not none) is one window. The automaton works on word numbers: the
benchmark's words have numbers from 1, every other word is 0, so it stays small and a text is scanned in
one pass over its words, in blocks that carry their last ``window`` - 1 words over.

The benchmark is broadcast in parts of ``part_words`` words at most (and whole items). A word adds at most
``window`` nodes of some 70 bytes, so an automaton's size has a proven bound, some 90 MB by default, unless one item
alone is longer; a worker builds it once and keeps it for its next tasks. With more than one part, each part scans
all texts and the hits are merged by document. Null or wordless texts have no words and no hits; null, empty or
wordless items have no window; items with equal ids count once; without items nothing is hit; repeated rows are rows
like any other. Of columns to hand through, one with an output's name gives way (``prefix`` renames the outputs).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import durable, kept, texts, tidy

# Bytes that are no part of a word become spaces; A-Z become a-z; non-ASCII bytes stay.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # on the original text, where A-Z belong to words
BLOCK = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Matcher:
    """Word numbers and the automaton over them, built from (item_id, text) rows."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window, self.number = window, {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, found in windows.items():
            self.automaton.add_word(ids, (len(ids), tuple(found)))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def blocks(self, raw: bytes) -> Iterator[list[bytes]]:
        """The words, in lists that each come from about BLOCK bytes."""
        start = 0
        while start < len(raw):
            end = start + BLOCK
            while end < len(raw) and _LOWER[raw[end]] != 32:  # go on to the word's end
                end += 1
            yield raw[start:end].translate(_LOWER).split()
            start = end

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged spans of hit words, items with occurring windows."""
        total, spans, items, tail = 0, [], set(), []
        get = self.number.get
        for words in self.blocks(raw):
            ids = [get(w, 0) for w in words]
            if not self.empty and any(ids):
                base = total - len(tail)
                for end, (length, found) in self.automaton.iter(tuple(tail + ids)):
                    if end < len(tail):
                        continue  # found with the last block
                    spans.append((base + end + 1 - length, base + end + 1))
                    items.update(found)
            total += len(words)
            tail = (tail + ids)[-(self.window - 1) :] if self.window > 1 else []
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return total, merged, items


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of characters of the original text."""
    bounds = [m.span() for m in WORD.finditer(text)] if spans else []
    return [(bounds[a][0], bounds[b - 1][1]) for a, b in spans]


def parts_of(benchmark: DataFrame, part_words: int) -> list[DataFrame]:
    """The items, dealt into parts that each hold about ``part_words`` words."""
    words = benchmark.agg(F.sum(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    n = -(-words // part_words) or 1
    if n == 1:
        return [benchmark]
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", column: str = "text", window: int = 13, part_words: int = 100_000, least_share: float = 0.05, carry: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """Per row: key, n_words, n_hit, items (sorted), char_spans of the hits in the original text, contaminated.

    ``carry``: more columns of ``docs`` to hand through.
    """
    inverse = round(1 / least_share)
    handed = list(dict.fromkeys([key, *carry]))
    names = [f"_{i}" for i in range(len(handed))]  # none that the columns here can clash with
    docs = docs.select(*[F.col(c).alias(n) for c, n in zip(handed, names)], F.col(column).alias("text"))
    schema = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    benchmark = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    parts = parts_of(benchmark, part_words)
    if len(parts) > 1:
        docs = durable(docs.withColumn("row", F.monotonically_increasing_id()))
        names, schema = ["row", *names], "row long, " + schema
    schema += f", n_words long, hits array<struct<a:long,b:long>>, items array<{benchmark.schema['item_id'].dataType.simpleString()}>, char_spans array<struct<a:long,b:long>>"
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def scanned(part: DataFrame) -> DataFrame:
        items = sorted((r[0], r[1]) for r in part.collect())  # part_words at most
        sent, build = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = kept(("matcher", build), lambda: Matcher(sent.value, window))
            for batch in batches:
                n, hits, found, chars = [], [], [], []
                for raw in texts(batch.column("text")):
                    total, merged, items = matcher.scan(raw)
                    n.append(total)
                    hits.append([{"a": a, "b": b} for a, b in merged])
                    found.append(sorted(items))
                    chars.append([{"a": a, "b": b} for a, b in char_spans(raw.decode(), merged)] if merged else [])
                cols = [pa.array(n, pa.int64()), pa.array(hits, pa.list_(span)), pa.array(found, pa.list_(kind)), pa.array(chars, pa.list_(span))]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + cols, names=[*names, "n_words", "hits", "items", "char_spans"])

        return docs.select(*names, "text").mapInArrow(tidy(run, keeps=True), schema)

    out = scanned(parts[0])
    if len(parts) > 1:
        for part in parts[1:]:
            out = out.unionByName(scanned(part))
        # the hits of one row are spans of the same words; merge them as sets of spans
        out = out.groupBy("row").agg(
            *(F.first(c).alias(c) for c in names[1:]),
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("hits")).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list("char_spans")).alias("char_spans"),
        )
        out = out.withColumn("hits", _merged("hits")).withColumn("char_spans", _merged("char_spans"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["b"] - h["a"])
    found = {"n_words": F.col("n_words"), "n_hit": n_hit, "items": F.col("items"), "char_spans": F.col("char_spans"), "contaminated": (n_hit > 0) & (F.lit(inverse) * n_hit >= F.col("n_words"))}
    results = {prefix + c: v for c, v in found.items()}
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(handed) if c not in results], *[v.alias(c) for c, v in results.items()])


def _merged(column: str):
    """Union of spans: sorted, each span loses what earlier spans have covered."""
    return F.aggregate(
        F.array_sort(column),
        F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<a:long,b:long>>").alias("out")),
        lambda acc, h: F.struct(
            F.greatest(acc["end"], h["b"]).alias("end"),
            F.when(h["b"] > acc["end"], F.concat(acc["out"], F.array(F.struct(F.greatest(acc["end"], h["a"]).alias("a"), h["b"].alias("b"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
