"""Operator 8: schema fingerprinting of chat records, and a reversible chat template.

A record's fingerprint is the hash of its sorted nested field paths (arrays as ``[]``, with leaf kinds). It
selects a declarative mapping: where the turns are, and where each turn's role and text are. A fingerprint that is
met for the first time selects the mappings whose own paths it all has, those with the most of them first. A record takes the first of them that
reads all it says: a field named like one that some mapping reads (``SPOKEN``), or a string inside a list of turns, must be read or empty; a record
with more to say than any mapping reads is an unknown layout. Of other fields (ids, names, weights) those with text are listed in ``unread``. Records of any layout so become canonical (role, text) turns, and turns become
template segments.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every ``<``,
backslashes, ``|`` gets one backslash more, so no control string can occur there and reading takes one off;
a line feed in a role is written ``\\n`` and a backslash there is doubled.

A conversation is the concatenation of its segments in turn order. Segments are made row by row and read back
as a sorted stream, so a conversation of any length never has to be gathered. Null roles and texts are empty;
records whose layout no mapping knows give no turns and are listed with their fingerprint by
``unknown_layouts``; equal turns stay separate, and of turns with equal places the one whose segment sorts first comes
first. Other columns of the table aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

START, END = "<|im_start|>", "<|im_end|>"


def field_paths(value, path: str = "$") -> set[str]:
    """Nested field paths with leaf kinds; null leaves count as text, so a null doesn't change the layout."""
    if isinstance(value, dict):
        return {p for k in value for p in field_paths(value[k], f"{path}.{k}")} or {path + ":{}"}
    if isinstance(value, list):
        return {p for x in value for p in field_paths(x, path + "[]")} or {path + "[]"}
    return {f"{path}:{'number' if isinstance(value, int | float) and not isinstance(value, bool) else 'text'}"}


def fingerprint_paths(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def fingerprint(record) -> str:
    return fingerprint_paths(field_paths(record))


@dataclass(frozen=True)
class Mapping:
    """``turns``: path of the list of turns (empty: the record is made of fixed parts or is one turn itself).

    ``role`` and ``text``: paths inside a turn; ``parts``: fixed (role, path) turns of a record, before those of its list; absent or empty
    optional parts are left out. ``roles``: names to rewrite.
    """

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def reads(self, path: str) -> bool:
        """Whether this mapping's turns have what stands at a field path."""
        place = path.rpartition(":")[0]
        if self.turns:
            inside = "$[]" if self.turns == "$" else f"$.{self.turns}[]"
        else:
            inside = "$"
        own = [f"{inside}.{self.text}", f"{inside}.{self.role}"] if self.text else []
        return place in own or any(place == f"$.{p}" for _, part in self.parts for p in part.split("+"))

    @property
    def fingerprint(self) -> str:
        return fingerprint_paths(set(self.paths))


MAPPINGS = (
    Mapping("turn", ("$.role:text", "$.text:text"), role="role", text="text"),
    Mapping("turn_content", ("$.role:text", "$.content:text"), role="role", text="content"),
    Mapping("turn_value", ("$.from:text", "$.value:text"), role="from", text="value"),
    Mapping("messages", ("$.messages[].role:text", "$.messages[].content:text"), turns="messages", role="role", text="content"),
    Mapping("system_messages", ("$.system:text", "$.messages[].role:text", "$.messages[].content:text"), turns="messages", role="role", text="content", parts=(("system", "system"),)),
    Mapping("system_sharegpt", ("$.system:text", "$.conversations[].from:text", "$.conversations[].value:text"), turns="conversations", role="from", text="value", parts=(("system", "system"),), roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("system_instruction", ("$.system:text", "$.instruction:text", "$.output:text"), parts=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Mapping("system_instruction_input", ("$.system:text", "$.instruction:text", "$.input:text", "$.output:text"), parts=(("system", "system"), ("user", "instruction+input"), ("assistant", "output"))),
    Mapping("messages_text", ("$.messages[].role:text", "$.messages[].text:text"), turns="messages", role="role", text="text"),
    Mapping("bare_list", ("$[].role:text", "$[].content:text"), turns="$", role="role", text="content"),
    Mapping("sharegpt", ("$.conversations[].from:text", "$.conversations[].value:text"), turns="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("instruction", ("$.instruction:text", "$.output:text"), parts=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("$.instruction:text", "$.input:text", "$.output:text"), parts=(("user", "instruction+input"), ("assistant", "output"))),
    Mapping("prompt_completion", ("$.prompt:text", "$.completion:text"), parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", ("$.prompt:text", "$.response:text"), parts=(("user", "prompt"), ("assistant", "response"))),
    Mapping("system_prompt_response", ("$.system:text", "$.prompt:text", "$.response:text"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", ("$.question:text", "$.answer:text"), parts=(("user", "question"), ("assistant", "answer"))),
)


#: Names of fields that hold what is said.
SPOKEN = {"text", "content", "value", "instruction", "input", "output", "prompt", "completion", "response", "system", "question", "answer", "messages", "conversations"}


def texts_at(value, path: str = "$") -> set[str]:
    """Paths of the strings that aren't empty."""
    if isinstance(value, dict):
        return {p for k in value for p in texts_at(value[k], f"{path}.{k}")}
    if isinstance(value, list):
        return {p for x in value for p in texts_at(x, path + "[]")}
    return {path + ":text"} if isinstance(value, str) and value else set()


def _spoken(path: str) -> bool:
    return path.rpartition(":")[0].rpartition(".")[2].rstrip("[]") in SPOKEN or path == "$[]:text"


class Layouts:
    """The mappings of each fingerprint, learnt as they come."""

    def __init__(self, mappings: tuple[Mapping, ...]):
        self.by_size = sorted(mappings, key=lambda m: -len(m.paths))
        self.known: dict[str, list[tuple[Mapping, bool]]] = {}

    def of(self, record) -> tuple[str, Mapping | None, list[str]]:
        """(fingerprint, mapping, paths of texts that it doesn't read)."""
        paths = field_paths(record)
        name = fingerprint_paths(paths)
        if name not in self.known:  # with whether all text is read in any case
            fits = [m for m in self.by_size if paths.issuperset(m.paths)]
            self.known[name] = [(m, all(m.reads(p) or not p.endswith(":text") for p in paths)) for m in fits]
        for mapping, whole in self.known[name]:
            unread = [] if whole else sorted(p for p in texts_at(record) if not mapping.reads(p))
            if not any(map(_spoken, unread)):
                return name, mapping, unread
        return name, None, []


def _plain(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record, m: Mapping) -> list[tuple[str, str]]:
    """The record's (role, text) turns."""
    found = []
    for role, path in m.parts:
        pieces = [_plain(record.get(p)) for p in path.split("+")]
        if pieces[0] or role != "system":
            found.append((role, "\n\n".join(x for i, x in enumerate(pieces) if x or i == 0)))
    if not m.text:
        return found
    rename = dict(m.roles)
    turns = [record] if not m.turns else record if m.turns == "$" else record[m.turns]
    spoken = [(_plain(t.get(m.role)), _plain(t.get(m.text))) for t in turns if isinstance(t, dict)]
    return found + [(rename.get(role, role), text) for role, text in spoken]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """One turn in the template, and the place of its escaped text."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not in the template")
        role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1]))
        out.append((role, unescape(m[2]), *m.span(2)))
        at = m.end()
    return out


def format_records(df: DataFrame, key: str, record: str, order: str | None = None, mappings: tuple[Mapping, ...] = MAPPINGS, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Template segments of JSON records: key, order, n, layout, role, segment, loss_start, loss_end, unread.

    ``n`` counts the turns inside a record; ``loss_start`` and ``loss_end`` bound what the loss covers in the
    segment (null for other roles); ``unread`` has the paths of a record's texts that its mapping doesn't read (with its first turn). One record may be a whole conversation or one turn with its place in ``order``.
    """
    kinds = dict(df.dtypes)
    keep = [key, *([order] if order else [])]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n int, layout string, role string, segment string, loss_start int, loss_end int, unread array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(mappings)
        for batch in batches:
            rows, source = [], []
            for i, raw in enumerate(batch.column(record).to_pylist()):
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    value = None
                layout, mapping, unread = layouts.of(value)
                if mapping is None:
                    rows.append((0, layout, None, None, None, None, None))
                    source.append(i)
                    continue
                for n, (role, text) in enumerate(canonical(value, mapping)):
                    s, a, b = segment(role, text)
                    rows.append((n, mapping.name, role, s, *((a, b) if role in learn_from else (None, None)), unread if unread and n == 0 else None))
                    source.append(i)
            took = pa.array(source, pa.int64())
            types = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            cols = [pa.array(list(x), t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(took) for c in keep] + cols, names=[*keep, "n", "layout", "role", "segment", "loss_start", "loss_end", "unread"])

    return df.select(*keep, record).mapInArrow(tidy(run), schema)


def unknown_layouts(segments: DataFrame) -> DataFrame:
    """Fingerprints that no mapping knows, and how many records have each."""
    return segments.where(F.col("segment").isNull()).groupBy(F.col("layout").alias("fingerprint")).agg(F.count("*").alias("n_records"))


def unread_fields(segments: DataFrame) -> DataFrame:
    """Paths of texts that no turn has, and how many records of each mapping have them."""
    return segments.select("layout", F.explode("unread").alias("path")).groupBy("layout", "path").agg(F.count("*").alias("n_records"))


def conversations_text(segments: DataFrame, key: str, order: str) -> DataFrame:
    """Whole formatted conversations as strings, for conversations that fit a row."""
    turns = F.array_sort(F.collect_list(F.struct(order, "n", "segment")))
    return segments.where("segment is not null").groupBy(key).agg(F.array_join(F.transform(turns, lambda t: t["segment"]), "").alias("formatted"))


def read_back(segments: DataFrame, key: str, order: str) -> DataFrame:
    """Digests of every conversation, read from its segments alone as a stream in turn order.

    Columns: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A conversation is hashed in
    its order, so its segments pass through one task, one Arrow batch at a time.
    """
    kind = dict(segments.dtypes)[key]
    schema = f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def done():
            if state:
                n, turns, chars, loss, size = state
                out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            kind_of_key = batch.schema.field(key).type
            for k, text, a, b in zip(*(batch.column(c).to_pylist() for c in (key, "segment", "loss_start", "loss_end"))):
                if state is None or k != now:
                    done()
                    now, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    body = unescape(text[a:b])
                    state[2] += len(body)
                    state[3].update(body.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield _rows(out, key, kind_of_key, types)
                out.clear()
        done()
        if out:
            yield _rows(out, key, kind_of_key, types)

    stream = segments.where("segment is not null").select(key, order, "n", "segment", "loss_start", "loss_end")
    return stream.repartition(key).sortWithinPartitions(key, order, "n", "segment").mapInArrow(tidy(run), schema)


def _rows(out: list, key: str, kind: pa.DataType, types: list) -> pa.RecordBatch:
    cols = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(list(cols[0]), kind)] + [pa.array(list(c), t) for c, t in zip(cols[1:], types)], names=[key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
