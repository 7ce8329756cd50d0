"""Licence scans against plain searches over word lists; expressions against truth tables."""

import random
import re

import pytest

from rasterloom.llm import licenses, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def places(words, phrase):
    p = phrase.split()
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def plain(text):
    words = WORD.findall(lowered(text))
    base = sorted((i, label) for p, label in licenses.BASE.items() for i in places(words, p))
    own = {label for p, label in licenses.NOTICES.items() if places(words, p)}
    labels = {label for _, label in base}
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), labels | own


@pytest.mark.parametrize("block", [7, 40, 1 << 20])
def test_phrases_equal_plain_search(monkeypatch, block):
    monkeypatch.setattr(licenses, "BLOCK", block)
    rng = random.Random(block)
    pool = [*licenses.BASE, *licenses.NOTICES, "GNU", "general", "cc", "By", "MIT", "license", "Apache-License", "ünd", "x", "the"]
    scanner = licenses.Scanner()
    for _ in range(200):
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "-", ", ", " "]) for _ in range(rng.randint(0, 30)))
        n, found, _ = scanner.scan(text.encode())
        base = sorted(w for w, _, _, b in found if b)
        want = plain(text)
        assert (n, len(base), min(base, default=None), max(base, default=None), ",".join(sorted({f[2] for f in found if f[3]}))) == want[:5]
        assert {f[2] for f in found} == want[5]


@pytest.mark.parametrize(
    "text, ways",
    [
        ("MIT", [["MIT"]]),
        ("MIT OR Apache-2.0", [["Apache-2.0"], ["MIT"]]),
        ("MIT or BSD-3-Clause and ISC", [["BSD-3-Clause", "ISC"], ["MIT"]]),
        ("(MIT OR BSD-3-Clause) AND ISC", [["BSD-3-Clause", "ISC"], ["ISC", "MIT"]]),
        ("GPL-2.0-only WITH Classpath-exception-2.0 AND MIT", [["GPL-2.0-only WITH Classpath-exception-2.0", "MIT"]]),
        ("((MIT))", [["MIT"]]),
    ],
)
def test_expressions(text, ways):
    assert sorted(sorted(w) for w in licenses.evaluate(text)[1]) == ways


@pytest.mark.parametrize("text", ["", "AND", "MIT OR", "MIT Apache-2.0", "(MIT", "MIT)", "MIT OR OR ISC", "(MIT OR ISC) WITH x", "MIT, ISC", "()", "see below."[:0] + "the file, please"])
def test_what_is_no_expression(text):
    assert licenses.evaluate(text) is None


def test_values_equal_truth_tables():
    rng = random.Random(3)

    def make(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice("ABCDE")
        return f"({make(depth - 1)} {rng.choice(['AND', 'OR'])} {make(depth - 1)})"

    for _ in range(100):
        text = make(4)
        ways = licenses.evaluate(text)[1]
        for mask in range(32):
            true = {x for i, x in enumerate("ABCDE") if mask >> i & 1}
            want = eval(text.replace("AND", "and").replace("OR", "or"), {x: x in true for x in "ABCDE"})
            assert any(w <= true for w in ways) == want


def test_many_ways_are_bounded():
    names, ways = licenses.evaluate(" AND ".join(f"(A{i} OR B{i})" for i in range(40)))
    assert ways is None and len(names) == 80


def test_query(spark, tmp_path):
    texts = [
        "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND BSD-3-Clause */\nint x;",
        "# spdx license identifier: Apache-2.0 WITH LLVM-exception\nand MIT License, and the CC-BY terms",
        "SPDX-License-Identifier: see the file named so",
        "Released under the MIT License. Apache license; apache LICENSE",
        "a Word İ 中文 mit license",
        "SPDX-License-Identifier: " + "A AND " * 2000 + "A",
        "",
        None,
        "word " * 400_000 + "gnu general public license",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "cc by")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op13_license_scan(spark, str(tmp_path)).collect()}
    for i, t in rows:
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t)[:5]
    assert out[0]["labels"] == "bsd,gpl,mit" and out[0]["score"] == 1.0
    assert out[1]["labels"] == "apache,cc-by,mit" and out[1]["base_labels"] == "cc-by,mit"
    assert out[2]["labels"] == "" and out[2]["score"] == 0.0 and out[5]["labels"] == ""
    assert out[3]["score"] == 0.75 and out[6]["score"] == out[7]["score"] == 0.0


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "MIT License", 5, "x")], "doc_id long, text string, n_words int, labels string")
    out = licenses.scan_licenses(df, carry=("text", "n_words", "labels")).first()
    assert out["doc_id"] == 1 and out["text"] == "MIT License" and out["labels"] == ["mit"] and out["n_words"] == 2
    e = licenses.scan_licenses(spark.createDataFrame([(1, "é SPDX-License-Identifier: MIT OR GPL-3.0-or-later")], "doc_id long, text string")).first()["expressions"][0]
    assert e["labels"] == ["gpl", "mit"] and e["permissive"] is True and e["byte"] == len("é SPDX-License-Identifier".encode())
