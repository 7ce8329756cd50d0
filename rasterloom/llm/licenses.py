"""Operator 13: licence scans. An Aho-Corasick automaton finds notice phrases and identifier tags, and a shunting-yard
parser evaluates the and/or/with expressions behind the tags.

A-Z are lowered; a word is a run of 0-9, a-z and non-ASCII characters, as in ``decontaminate``. One automaton over word
sequences looks for the phrases of ``BASE``, for more phrases of licences (``NOTICES``) and for tags (``TAGS``) in one
pass over a text, in blocks that carry their last words over, so memory doesn't grow with the text. Where a tag stands, the rest of its line in the original text is read as an expression: licence
identifiers, parentheses, ``AND``, ``OR`` and ``WITH`` (an exception), ``WITH`` binding closest and ``OR`` least. Comment
marks around it are left out; a line that isn't an expression as a whole gives none (prose after a tag is no licence).

An expression's value is the list of ways to satisfy it: each a set of licences that hold together. Its labels are the
families of its licences (``family``); it is permissive if one way has only permissive families. A text's score is 1
where an expression was read, otherwise 1 - 1 / 2**n for n different labels' phrases: 0 without any.

Null and empty texts have no words and no labels; a phrase counts at each place where its words begin, overlaps
included; ties and repeated rows are rows like any other; an empty table gives an empty result. Of columns to hand through, one with an output's name gives way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, texts, tidy

#: Phrases that count as base, with their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: More phrases of notices.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "boost",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0 universal": "cc0",
    "licensed under the apache": "apache",
    "released under the mit": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
TAGS = ("spdx license identifier", "license expression")
#: Beginnings of identifiers, the longest that fits decides; families that ask nothing but notices.
FAMILIES = ("agpl", "apache", "artistic", "bsd", "boost", "bsl", "cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa", "cc0", "epl", "gpl", "isc", "lgpl", "mit", "mpl", "ofl", "python", "unlicense", "zlib")
PERMISSIVE = {"apache", "bsd", "boost", "bsl", "cc-by", "cc0", "isc", "mit", "python", "unlicense", "zlib"}
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_TOKEN = re.compile(r"\s*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
BLOCK = 1 << 20
LINE = 4096  # bytes behind a tag that are read; a longer line is no expression
STRENGTH = {"or": 1, "and": 2, "with": 3}
WAYS = 256  # ways to satisfy an expression that are written out; one with more keeps labels and no ways

Ways = frozenset[frozenset[str]]


def postfix(expression: str) -> list[str] | None:
    """Dijkstra's shunting yard: identifiers and operators in postfix order; None if the text isn't an expression."""
    out: list[str] = []
    stack: list[str] = []
    operand, at = True, 0  # whether an operand may come next
    while at < len(expression.rstrip()):
        m = _TOKEN.match(expression, at)
        if not m:
            return None
        at = m.end()
        mark, name = m.groups()
        if mark == "(" and operand:
            stack.append("(")
        elif mark == ")" and not operand:
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif name and (low := name.lower()) in STRENGTH and not operand:
            while stack and STRENGTH.get(stack[-1], 0) >= STRENGTH[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif name and name.lower() not in STRENGTH and operand:
            out.append(name)
            operand = False
        else:
            return None
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[list[str], Ways | None] | None:
    """(licences in order, ways): each way a set of licences that hold together, ``WITH`` a licence and its exception.

    ``ways`` is None beyond ``WAYS``; None for the whole if the text isn't an expression.
    """
    tokens = postfix(expression)
    if tokens is None:
        return None
    names: list[str] = []
    stack: list[tuple[Ways | None, str | None]] = []  # value, and the identifier where it is a single one
    for token in tokens:
        if token not in STRENGTH:
            stack.append((frozenset([frozenset([token])]), token))
            names.append(token)
            continue
        (b, second), (a, first) = stack.pop(), stack.pop()
        if token == "with":
            if first is None or second is None:
                return None  # only a licence takes an exception
            names.remove(second)
            stack.append((frozenset([frozenset([f"{first} WITH {second}"])]), None))
        elif a is None or b is None:
            stack.append((None, None))
        else:
            joined = a | b if token == "or" else frozenset(x | y for x, y in product(a, b)) if len(a) * len(b) <= WAYS * WAYS else None
            stack.append((joined if joined is not None and len(joined) <= WAYS else None, None))
    return list(dict.fromkeys(names)), stack[0][0]


def family(identifier: str) -> str | None:
    """The licence family that an identifier begins with."""
    low = identifier.lower()
    fits = [f for f in FAMILIES if low == f or low.startswith((f + "-", f + "+"))]
    return max(fits, key=len, default=None)


def permissive(ways: Ways | None) -> bool | None:
    """Whether one way asks nothing but notices; None if that isn't known."""
    return None if ways is None else any(all(family(x.split(" WITH ")[0]) in PERMISSIVE for x in way) for way in ways)


class Scanner:
    """The automaton over word sequences; words are parted and surrounded by single spaces."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {p: [label, p in BASE, False] for p, label in (BASE | NOTICES).items()} | {t: [None, False, True] for t in TAGS}
        for phrase, (label, base, tag) in entries.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 1, phrase.count(" ") + 1, label, base, tag))
        self.automaton.make_automaton()
        self.tail = max(p.count(" ") for p in entries)  # words that the next block must see again

    def blocks(self, raw: bytes) -> Iterator[list[bytes]]:
        start = 0
        while start < len(raw):
            end = start + BLOCK
            while end < len(raw) and _LOWER[raw[end]] != 32:  # go on to the word's end
                end += 1
            yield raw[start:end].translate(_LOWER).split()
            start = end

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, int, str, bool]], list[int]]:
        """Number of words; (first word, words, label, base) of each phrase; the words that follow tags."""
        total, phrases, tags, tail = 0, [], [], []
        for words in self.blocks(raw):
            line = (" " + " ".join(w.decode("latin-1") for w in tail + words) + " ") if words else ""
            base_word, at, seen = total - len(tail), 0, 0
            for end, (length, size, label, base, tag) in self.automaton.iter(line):
                begin = end - length  # of the space before the phrase
                if begin >= at:
                    seen += line.count(" ", at, begin)
                else:
                    seen -= line.count(" ", begin, at)
                at = begin
                if seen + size <= len(tail):
                    continue  # found with the last block
                if tag:
                    tags.append(base_word + seen + size)
                else:
                    phrases.append((base_word + seen, size, label, base))
            total += len(words)
            tail = (tail + words)[-self.tail :]
        return total, phrases, tags

    def expressions(self, raw: bytes, after: list[int]) -> list[dict]:
        """What stands in the rest of the lines before which tags end, with its place in the text's bytes."""
        wanted, out = set(after), []
        ends = [m.end() for k, m in enumerate(_WORD.finditer(raw), 1) if k in wanted]
        for end in ends:
            stop = raw.find(b"\n", end, end + LINE)
            line = raw[end : len(raw) if stop < 0 else stop]
            if len(line) >= LINE or line.lstrip(b" \t")[:1] not in (b":", b"="):
                continue
            text = line.decode("utf-8", "replace").lstrip(" \t:=")
            text = re.sub(r"\s*(\*/|-->|#\}|\"\"\"|['\"])\s*$", "", text.strip().lstrip("'\"")).strip()
            value = evaluate(text)
            if value is not None:
                names, ways = value
                labels = sorted({f for n in names if (f := family(n))})
                listed = None if ways is None else sorted(sorted(w) for w in ways)
                out.append({"expression": text, "byte": end, "labels": labels, "ways": listed, "permissive": permissive(ways)})
        return out


_EXPRESSION = "array<struct<expression:string,byte:long,labels:array<string>,ways:array<array<string>>,permissive:boolean>>"
_PHRASE = "array<struct<word:long,words:int,label:string,base:boolean>>"


def scan_licenses(docs: DataFrame, key: str = "doc_id", column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, n_words, phrases (place, length, label, whether base), expressions, base_labels, labels, score."""
    handed = list(dict.fromkeys([key, *carry]))
    names = [f"_{i}" for i in range(len(handed))]  # none that the columns here can clash with
    docs = docs.select(*[F.col(c).alias(n) for c, n in zip(handed, names)], F.col(column).alias("text"))
    phrase = pa.struct([("word", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("base", pa.bool_())])
    expression = pa.struct([("expression", pa.string()), ("byte", pa.int64()), ("labels", pa.list_(pa.string())), ("ways", pa.list_(pa.list_(pa.string()))), ("permissive", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept("licences", Scanner)
        for batch in batches:
            n, phrases, expressions = [], [], []
            for raw in texts(batch.column("text")):
                total, found, tags = scanner.scan(raw)
                n.append(total)
                phrases.append([{"word": w, "words": s, "label": label, "base": b} for w, s, label, b in sorted(found)])
                expressions.append(scanner.expressions(raw, tags) if tags else [])
            cols = [pa.array(n, pa.int64()), pa.array(phrases, pa.list_(phrase)), pa.array(expressions, pa.list_(expression))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + cols, names=[*names, "n_words", "phrases", "expressions"])

    schema = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names) + f", n_words long, phrases {_PHRASE}, expressions {_EXPRESSION}"
    out = docs.mapInArrow(tidy(run, keeps=True), schema)
    labels = lambda c: F.transform(c, lambda p: p["label"])
    own = F.flatten(F.transform("expressions", lambda e: e["labels"]))
    noticed = F.array_distinct(labels("phrases"))
    results = {
        "n_words": F.col("n_words"),
        "phrases": F.col("phrases"),
        "expressions": F.col("expressions"),
        "base_labels": F.array_sort(F.array_distinct(labels(F.filter("phrases", lambda p: p["base"])))),
        "labels": F.array_sort(F.array_union(noticed, own)),
        "score": F.when(F.size("expressions") > 0, 1.0).otherwise(1.0 - F.pow(F.lit(0.5), F.size(noticed))),
    }
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(handed) if c not in results], *[v.alias(c) for c, v in results.items()])
