"""Operator 4: main text of pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks: runs of text between block-level tags, in page order, each with the tags,
classes, ids and roles of its open ancestors. Every block is labelled content or boilerplate. Features are
tokens of the ancestors' names, and of the text (length, link share, punctuation, position); the chain adds a
weight for each pair of neighbouring labels. Weights maximise the conditional likelihood (forward-backward,
gradient ascent) of labelled pages, which ``training_pages`` writes from layouts and phrases kept here, with the
truth known by construction; Viterbi decodes a page.

Scripts, styles, templates and comments aren't blocks; formulas, drawings and the text inside other elements are
text like any other. Character references are decoded and white space inside a block is one space. A page is read
once from start to end, however broken its tags are; a tag that never ends is no text. Of two labellings with equal
scores the one that keeps less is taken. A null or empty page has no text; repeated rows are rows like any other; an
empty table gives an empty result; a column with an output's name gives way to it.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, tidy

BLOCK_TAGS = frozenset(
    "html head body title address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button textarea label input iframe noscript caption".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template".split())
DEEP = 512  # nesting that counts; browsers keep no more
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_OPENING = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_IN_TAG = re.compile(r"=\s*[\"']|>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-label|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    ancestors: tuple[tuple[str, str], ...]  # (tag, class and id words)
    link_chars: int = 0


def markup(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag, closing, attributes) of each tag in one pass; the last has no tag.

    A tag ends at the first ``>`` outside quoted values. Where a quote is never closed, quotes mean nothing from
    there on; where a tag or comment never ends, neither does it.
    """
    n, at, said, quotes = len(page), 0, [], True
    while True:
        lt = page.find("<", at)
        if lt < 0:
            yield "".join([*said, page[at:]]), "", False, ""
            return
        opening = _OPENING.match(page, lt)
        if opening is None:
            if page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                said += [page[at:lt], page[lt + 9 : end if end >= 0 else n]]
                at = end + 3 if end >= 0 else n
            elif page.startswith(("<!", "<?", "</"), lt):
                comment = page.startswith("<!--", lt)
                end = page.find("-->", lt + 2) if comment else page.find(">", lt)
                said.append(page[at:lt])
                at = n if end < 0 else end + (3 if comment else 1)
            else:  # a sign, not a tag
                said.append(page[at : lt + 1])
                at = lt + 1
            continue
        end = opening.end()
        while quotes:
            stop = _IN_TAG.search(page, end)
            if stop is None or page[stop.end() - 1] == ">":
                end = stop.start() if stop else n
                break
            end = page.find(page[stop.end() - 1], stop.end()) + 1
            if not end:
                quotes = False
        if not quotes or end == n:
            end = page.find(">", opening.end())
            end = n if end < 0 else end
        yield "".join([*said, page[at:lt]]), opening[1].lower(), page[lt + 1] == "/", page[opening.end() : end]
        said.clear()
        at = end + 1
        if opening[1].lower() in RAW_TAGS and page[lt + 1] != "/":
            close = re.compile(rf"</{opening[1]}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n


def leaf_blocks(page: str) -> list[Block]:
    """The page's non-empty leaf blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    links, in_link = 0, False

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            out.append(Block(text, tuple(stack[-DEEP:]), links))
        pieces.clear()
        links = 0

    def close(k: int) -> None:
        for tag, _ in stack[k:]:
            open_tags[tag] -= 1
        del stack[k:]

    for raw, tag, closing, attributes in markup(page):
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                links += len(text.strip())
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = not closing
        if tag not in BLOCK_TAGS:
            continue
        flush()
        in_link = False
        if closing:
            if open_tags[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in _ENDS_P and open_tags["p"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in ("div", "article", "section", "td", "li", "body", "button"):
                    break
        shut = _CLOSES.get(tag)
        if shut and stack and stack[-1][0] in shut:
            close(len(stack) - 1)
        if tag in VOID_TAGS:
            continue
        words = ""
        if attributes:
            words = " ".join(f"{a[1].lower()}={a[2] or a[3] or a[4] or ''}" for a in _ATTRIBUTE.finditer(attributes))
        stack.append((tag, words))
        open_tags[tag] += 1
    flush()
    return out


@lru_cache(4096)
def ancestor_features(ancestors: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    found = []
    for depth, (tag, words) in enumerate(reversed(ancestors)):
        found.append(f"in:{tag}")
        if depth == 0:
            found.append(f"leaf:{tag}")
        if depth == 1:
            found.append(f"under:{tag}")
        if words:
            for w in _PART.findall(words):
                w = w.lower()
                if w not in ("class", "id", "role"):
                    found.append(f"name:{w}")
    return tuple(found)


_SIGNS = re.compile(r"©|copyright|all rights|cookie|consent|newsletter|subscribe|sign up|log ?in|sign in|advert|sponsor|promo|related|read more|share|tweet|comment|repl(?:y|ies)|posted by|privacy|terms|menu|search|skip to|previous|next|follow us|\bad\b", re.I)


def block_features(block: Block, where: float) -> list[str]:
    text = block.text
    n = len(text)
    words = text.count(" ") + 1
    found = list(ancestor_features(block.ancestors))
    found.append(f"words:{min(7, words.bit_length())}")
    found.append(f"links:{min(4, int(4 * block.link_chars / n))}")
    found.append("ends:stop" if text[-1] in ".!?\"'”»…:;)" else "ends:open")
    found.append(f"stops:{min(3, text.count('. ') + text.count(', '))}")
    found.append(f"at:{int(4 * where)}")
    if words < 24:
        found += {f"says:{m.lower()}" for m in _SIGNS.findall(text)}
    found.append("bias")
    return found


@dataclass
class Field:
    """Weights of the chain: ``state`` by feature and label, ``move`` by the labels of neighbours, ``start``."""

    index: dict[str, int] = field(default_factory=dict)
    state: np.ndarray = None
    move: np.ndarray = None
    start: np.ndarray = None

    def scores(self, features: list[list[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.state[[k for k in map(get, set(names)) if k is not None]].sum(0) for names in features])

    def viterbi(self, scores: np.ndarray) -> list[int]:
        (m00, m01), (m10, m11) = self.move.tolist()
        rows = (scores + np.vstack([self.start, np.zeros((len(scores) - 1, 2))])).tolist()
        (a, b), back = rows[0], []
        for x, y in rows[1:]:
            back.append((a + m00 < b + m10, a + m01 < b + m11))  # which label comes best before each
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        path = [int(b > a)]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.8, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by gradient ascent with forward-backward expectations (AdaGrad steps)."""
    crf = Field({f: i for i, f in enumerate(sorted({f for x, _ in pages for names in x for f in names}))})
    crf.state, crf.move, crf.start = np.zeros((len(crf.index), 2)), np.zeros((2, 2)), np.zeros(2)
    data = [([np.array(sorted({crf.index[f] for f in names})) for names in x], np.array(y)) for x, y in pages if y]
    seen = [np.full_like(a, 1e-8) for a in (crf.state, crf.move, crf.start)]
    for _ in range(rounds):
        grads = [-ridge * a for a in (crf.state, crf.move, crf.start)]
        for x, y in data:
            s = np.array([crf.state[k].sum(0) for k in x])
            n = len(y)
            a, b = np.empty((n, 2)), np.zeros((n, 2))
            a[0] = crf.start + s[0]
            for i in range(1, n):
                a[i] = np.logaddexp.reduce(a[i - 1][:, None] + crf.move, axis=0) + s[i]
            for i in range(n - 2, -1, -1):
                b[i] = np.logaddexp.reduce(crf.move + (s[i + 1] + b[i + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(a[-1])
            off = np.eye(2)[y] - np.exp(a + b - z)
            for k, o in zip(x, off):
                grads[0][k] += o / len(data)
            for i in range(1, n):
                p = np.exp(a[i - 1][:, None] + crf.move + (s[i] + b[i])[None, :] - z)
                grads[1] -= p / len(data)
                grads[1][y[i - 1], y[i]] += 1 / len(data)
            grads[2] += off[0] / len(data)
        for w, g, h in zip((crf.state, crf.move, crf.start), grads, seen):
            h += g * g
            w += rate * g / np.sqrt(h)
    return crf


# Labelled layouts. {0}: boilerplate, {1}: content; the number says the kind of phrase.
_SYLLABLES = "an be ti on er ver sche ion que la re do sa lu mi ko ra ten der ung lich ado para ción eau oi".split()
_NOTES = ("We use cookies to improve this site.", "Accept all", "Sign up for our newsletter", "Subscribe now for free", "Advertisement", "Sponsored content", "Share this article", "Log in", "Read more", "© 2024 Example. All rights reserved.", "Privacy policy", "Terms of use", "Related articles", "Leave a comment", "Search", "Follow us", "Skip to content", "Posted by guest", "Reply", "Next", "Previous", "Please enable JavaScript to view this page.")


def training_pages(count: int = 160, seed: int = 7) -> list[tuple[str, list[tuple[str, int]]]]:
    """(page, [(text, is it content)]) of made-up pages in many layouts."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 1, 2, 3))))

    def sentence(low, high):
        w = [word() for _ in range(rng.randint(low, high))]
        return (" ".join(w)).capitalize() + rng.choice((".", ".", ".", "?", "!"))

    def prose():
        return " ".join(sentence(3, 14) for _ in range(rng.choice((1, 1, 2, 3, 6)))) if rng.random() < 0.9 else word().capitalize() + "."

    def bare():
        return " ".join(word() for _ in range(rng.randint(1, 4)))

    made = []
    for number in range(count):
        blocks: list[tuple[str, int]] = []
        html: list[str] = []

        def put(text, content, before="", after=""):
            blocks.append((_SPACE.sub(" ", text).strip(), content))
            html.append(f"{before}{entities.escape(text)}{after}")

        def short():
            return rng.choice((rng.choice(_NOTES), bare(), sentence(2, 9)))

        def junk(tag, name="", items=None):
            attribute = f' {rng.choice(("class", "id"))}="{name}"' if name else ""
            html.append(f"<{tag}{attribute}>")
            if items is None and rng.random() < 0.3:
                put(" ".join(sentence(3, 12) for _ in range(rng.randint(1, 3))), 0)
            elif rng.random() < 0.5:
                html.append("<ul>")
                for _ in range(items or rng.randint(1, 6)):
                    put(short(), 0, "<li><a href='/x'>", "</a></li>")
                html.append("</ul>")
            else:
                for _ in range(items or rng.randint(1, 3)):
                    put(short(), 0, *rng.choice((("<p>", "</p>"), ("<a href='#'>", "</a><hr>"), ("<div>", "</div>"), ("<h3>", "</h3>"), ("<button>", "</button>"), ("<label>", "</label>"))))
            html.append(f"</{tag}>")

        def comments():
            html.append(rng.choice(("<section class='comments'>", "<div id='comments' class='comment-list'>", "<div class='discussion replies'>", "<section id='disqus-thread'>")))
            for _ in range(rng.randint(1, 4)):
                put(prose(), 0, rng.choice(("<div class='comment'><p>", "<div class='comment-body reply'><p>", "<article class='comment'><p>")), rng.choice(("</p></div>", "</p></article>")))
            html.append("</section></div>")

        html.append("<!DOCTYPE html><html><head>")
        put(sentence(3, 9), 0, "<title>", "</title>")
        html.append("</head><body>")
        if rng.random() < 0.4:
            junk("header", rng.choice(("", "site-header", "masthead", "top-bar")))
        if rng.random() < 0.8:
            junk(*rng.choice((("nav", ""), ("nav", "main-nav"), ("div", "menu"), ("div", "navbar navigation"), ("ul", "nav menu"), ("div", "breadcrumb"))))
        for _ in range(rng.randint(0, 2)):
            junk(*rng.choice((("div", "ad"), ("div", "ads banner"), ("div", "advert sponsored"), ("div", "cookie-notice"), ("div", "cookie consent banner"), ("div", "promo"), ("form", "search"), ("div", "notice alert"), ("aside", "promo"), ("div", "popup modal newsletter"), ("noscript", ""))))
        side = lambda: junk(*rng.choice((("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget related"), ("div", "related-posts"), ("section", "recommended"))))
        if rng.random() < 0.25:
            side()
        wrap = rng.choice((["<article>"], ["<article>"], ["<article>"], ["<main>"], ["<main>", "<article class='post'>"], ["<div class='content'>"], ["<div id='main-content' class='entry-content post-body'>"], ["<div class='article-body story'>"], ["<section>"], ["<div class='container'>", "<div class='text'>"]))
        html += wrap
        if rng.random() < 0.9:
            put(prose(), 1, *rng.choice((("<h1>", "</h1>"), ("<h1 class='title'>", "</h1>"), ("<header><h1>", "</h1></header>"))))
        for _ in range(rng.choice((1, 2, 5, 9, 14))):
            kind = rng.random()
            if kind < 0.72:
                put(prose(), 1, *rng.choice((("<p>", "</p>"), ("<p>", "</p>"), ("<p><b>", "</b></p>"), ("<p>", ""), ("<p><b>", "<br>"))))
            elif kind < 0.8:
                put(sentence(2, 6).rstrip(".!?"), 1, "<h2>", "</h2>")
            elif kind < 0.88:
                html.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    put(sentence(2, 9), 1, "<li>", "</li>")
                html.append("</ul>")
            elif kind < 0.92:
                put(prose(), 1, "<blockquote>", "</blockquote>")
            elif kind < 0.93:
                put(f"{sentence(2, 6)} x + y = {rng.randint(2, 99)}", 1, "<p><math><mi>", "</mi></math></p>")
            elif kind < 0.95:
                html.append("<table><tr>")
                for _ in range(3):
                    put(bare(), 1, "<td>", "</td>")
                html.append("</tr></table>")
            else:
                junk(*rng.choice((("div", "ad"), ("div", "share social"), ("aside", "promo related"), ("div", "newsletter signup"), ("figure", "ad"))), items=1)
        html += [f"</{w[1:].split()[0].rstrip('>')}>" for w in reversed(wrap)]
        if rng.random() < 0.3:
            comments()
        if rng.random() < 0.3:
            side()
        if rng.random() < 0.2:
            junk("form", rng.choice(("comment-form", "subscribe", "")))
        if rng.random() < 0.85:
            junk(*rng.choice((("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright legal"))))
        html.append("</body></html>")
        made.append(("".join(html), blocks))
    return made


def labelled(page: str, truth: list[tuple[str, int]]) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page's blocks, matched in order with the truth."""
    blocks, labels, at = leaf_blocks(page), [], 0
    for b in blocks:
        for k in range(at, len(truth)):
            if truth[k][0] == b.text:
                at = k
                break
        labels.append(truth[at][1] if at < len(truth) else 0)
    n = max(1, len(blocks) - 1)
    return [block_features(b, min(0.999, i / n)) for i, b in enumerate(blocks)], labels


def fit(count: int = 120, seed: int = 7) -> Field:
    return train([labelled(*p) for p in training_pages(count, seed)])


def main_blocks(page: str, crf: Field) -> list[str]:
    blocks = leaf_blocks(page)
    if not blocks:
        return []
    n = max(1, len(blocks) - 1)
    path = crf.viterbi(crf.scores([block_features(b, min(0.999, i / n)) for i, b in enumerate(blocks)]))
    return [b.text for b, y in zip(blocks, path) if y]


def extract(pages: DataFrame, crf: Field, column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``column``, with the main text and its number of code points."""
    kept = [f for f in pages.schema.fields if f.name not in (column, out, "n_chars")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{out}` string, n_chars long"
    sent = pages.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                found = ["\n\n".join(main_blocks(p or "", sent.value)) for p in batch.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*names, out, "n_chars"])

    return pages.select(*names, column).mapInArrow(tidy(run), schema)
