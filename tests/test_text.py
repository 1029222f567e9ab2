import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import chunking, excerpt, markdown, splitting
from tessera.functions import text as X
from tessera.functions.decode import CP1252_BYTES, CP1252_CHARS, decoded

TEXTS = [
    "",
    "   \n\n ",
    "x" * 50_000,
    "😀" * 300,
    "```py\n" + "line of code\n" * 60,
    "```\n" + "a = 1\n" * 200 + "```",
    "| a | b |\n|---|---|\n" + "| one | two |\n" * 120,
    "uno dos\r\ntres\r\n\r\ncuatro " * 40,
    "El Sr. Pérez llegó. Después habló D. Juan. ¿Quién? Nadie! etc. Fin " * 30,
    "# T\n\npara one\n\n" + "word " * 400 + "\n\n- item\n- item",
    "a\n\n\n\nb  c",
]


def letters(s):
    return "".join(s.split())


@pytest.mark.parametrize("bound", [5, 20, 60, 200])
@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_split_keeps_the_bound_and_loses_nothing(i, bound):
    parts = splitting.split_to_bound(TEXTS[i], bound)
    assert all(X.estimate_tokens(p) <= bound for p in parts)
    rest = iter(letters("".join(parts)))
    assert all(any(c == d for d in rest) for c in letters(TEXTS[i]))


def test_split_repeats_table_heads_and_fences():
    rows = splitting.split_to_bound(TEXTS[6], 60)
    assert len(rows) > 2 and all(p.startswith("| a | b |\n|---|---|\n") for p in rows)
    fenced = splitting.split_to_bound(TEXTS[5], 60)
    assert all(p.startswith("```\n") and p.endswith("\n```") for p in fenced)


def test_sentences_know_abbreviations_and_initials():
    assert splitting.sentences("El Sr. Pérez vino. ¿Y D. Juan? No, p. Ej. nada. fin. Fin") == ["El Sr. Pérez vino.", "¿Y D. Juan?", "No, p. Ej. nada. fin.", "Fin"]


def test_tokens_count_utf16_units(spark):
    rows = spark.createDataFrame([("a😀b",), ("",), ("abcde",)], "t string").select(X.token_estimate(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [1, 0, 2] == [X.estimate_tokens(t) for t in ("a😀b", "", "abcde")]


def test_folding_in_the_jvm_is_folding_in_python(spark):
    words = ["Ábaco", "ÑANDÚ", "straße", "çédille", "é", "ΆΈ", "ǖ", "x^`´y", "Å"]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = df.select(X.folded(F.col("t")).alias("a"), X.folded(F.col("t"), True).alias("b")).collect()
    assert [r.a for r in got] == [X.fold_match(w) for w in words]
    assert [r.b for r in got] == [X.fold_similar(w) for w in words]
    assert X.fold_match("x^y") == "x^y" and X.fold_similar("x^y´") == "xy"


def test_display_strings(spark):
    df = spark.createDataFrame([("docs/a/my-file__name.md", " a \n b c ", "x" * 141)], "p string, s string, l string")
    r = df.select(
        X.humanized(F.col("p")).alias("title"),
        X.module_of(F.col("p"), ("docs",)).alias("module"),
        X.condense(F.col("s")).alias("s"),
        X.condense(F.col("l")).alias("l"),
        X.doc_line(F.lit(None), F.col("p"), F.lit("s"), F.lit("draft")).alias("line"),
        X.display_summary(F.lit("  "), F.lit("T")).alias("d"),
    ).first()
    assert (r.title, r.module, r.s, r.l, r.line, r.d) == ("My file name", "a", "a b c", "x" * 139 + "…", "- docs/a/my-file__name.md — s (draft)", "T")


def test_decoding(spark):
    cases = {
        "utf8": "añ".encode(), "mark": b"\xef\xbb\xbfx", "le": "é😀".encode("utf-16"), "be": b"\xfe\xff\x00a", "odd": b"\xff\xfea",
        "1252": b"caf\xe9 \x80", "bad": b"ab\x81\xe9", "markbad": b"\xef\xbb\xbf\xe9", "null": b"\xe9\x00", "all": b"\xff" + CP1252_BYTES, "empty": b"",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "k string, c binary")
    got = {r.k: r.d for r in df.select("k", decoded(F.col("c")).alias("d")).collect()}
    texts = {k: d.text for k, d in got.items()}
    assert texts["utf8"] == "añ" and texts["mark"] == "x" and texts["le"] == "é😀" and texts["be"] == "a" and texts["1252"] == "café €" and texts["empty"] == ""
    assert texts["all"] == "ÿ" + CP1252_CHARS and got["all"].encoding == "windows-1252" and got["le"].encoding == "utf-16le"
    assert all(texts[k] is None and got[k].error for k in ("odd", "bad", "markbad", "null"))
    assert got["bad"].error == "undecodable byte 0x81 at offset 2"


OUTLINE = """# Title *one*

First `code` paragraph
goes on.

### Early
x

## Two
own text

```
## not a heading
```

### Child
c

> ## quoted
- ## listed

Setext
------
tail

# Later
## Three ##
"""


def test_outline():
    o = markdown.outline(OUTLINE)
    assert (o.title, o.summary) == ("Title one", "First code paragraph\ngoes on.")
    assert "### Early" in o.intro and "## Two" not in o.intro
    assert [(s.title, [c.title for c in s.children]) for s in o.sections] == [("Two", ["Child"]), ("Setext", []), ("Three", [])]
    assert "# Later" in o.sections[1].text and "not a heading" in o.sections[0].text
    assert markdown.outline("no heading at all").intro == "no heading at all"
    assert markdown.outline("##\n\ntext").sections[0].title == ""


def told(body):
    return [(b.kind[0] + (str(b.depth) if b.depth else ""), b.text) for b in markdown.top_blocks(body)]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        # HTML blocks end where their kind does, and inline HTML begins none
        ("<b>bold</b> text\n", [("p", "<b>bold</b> text")]),
        ("<!-- hidden\n\n## no\n-->\n## yes", [("h2", "yes")]),
        ("<!-- one line -->\n# T", [("h1", "T")]),
        ("<script>\n\n# no\n</script>\ntext", [("p", "text")]),
        ("<?php\n\n# no\n?>\n# yes", [("h1", "yes")]),
        ("<![CDATA[\n\n# no\n]]>\n# yes", [("h1", "yes")]),
        ("<div>\n# no\n\n# yes\n</div>", [("h1", "yes")]),
        ("text\n<div>\n# no\n\nmore", [("p", "text"), ("p", "more")]),
        ("<span>\n# no\n\n# yes", [("h1", "yes")]),
        ("text\n<span>\nmore", [("p", "text\n<span>\nmore")]),
        ("<https://x.org> is a link", [("p", "https://x.org is a link")]),
        # only a paragraph goes on lazily
        ("> quoted\nlazily\n\nown", [("p", "own")]),
        ("> # heading\nown", [("p", "own")]),
        ("> ---\nown", [("p", "own")]),
        ("> ```\nown\n```", [("p", "own")]),
        ("> > deep\nlazily\n# T", [("h1", "T")]),
        ("- item\nlazily\n\nown", [("p", "own")]),
        ("- # heading\nown", [("p", "own")]),
        ("- a\n\n  more of a\n\nown", [("p", "own")]),
        ("- ```\n  # no\n  ```\n# T", [("h1", "T")]),
        ("1. a\n   - b\n     ## no\n\n   c\n## T", [("h2", "T")]),
        ("- a\n***\n## T", [("h2", "T")]),
        ("> - a\n>   ## no\n## T", [("h2", "T")]),
        ("> a\n===\nown", []),
        # setext headings, definitions and references
        ("two\nlines\n===\ntext", [("h1", "two\nlines"), ("p", "text")]),
        ("[a]: /x\n# T [a] [b][A] [c]\n", [("h1", "T a b [c]")]),
        ("see [the  Guide][]\n\n[the guide]: <x y> 'z'", [("p", "see the  Guide")]),
        ("[a]: /x\n[b]: /y\ntext ![pic][b] [a]", [("p", "text  a")]),
        ("[a]: /x\n===\n", [("p", "===")]),
        ("text\n[a]: /x", [("p", "text\n[a]: /x")]),
        ("`[a]`\n\n[a]: /x", [("p", "[a]")]),
    ],
)
def test_blocks_of_commonmark(body, want):
    assert told(body) == want
    assert told(body.replace("\n", "\r\n")) == want


def test_headings_in_fragments():
    assert markdown.headings_in("## A\r\n```\n## no\n```\n### B \n# not") == ["A", "B"]
    assert markdown.headings_in("```\n## A") == ["A"]


def test_frontmatter():
    data, body = markdown.split_frontmatter("---\ntype: adr\nupdated: 2024-05-06\ntags: [A, b]\n---\n# T\n")
    assert data["type"] == "adr" and markdown.scalar(data["updated"]) == "2024-05-06" and body == "# T\n"
    assert markdown.split_frontmatter("# T")[0] == {} and markdown.scalar("  ") is None and markdown.scalar(3) is None
    with pytest.raises(Exception):
        markdown.split_frontmatter("---\na: [\n---\nx")


def test_chunks():
    long = "word " * 200
    text = f"# T\n\nintro {long}\n\n## A\n\n{long}\n\n### A1\n\n{long}\n\n### A2\n\n{long}\n\n## B\n\ntiny"
    chunks = chunking.chunk_outline(markdown.outline(text), 100, 480)
    assert [h for h, _ in chunks] == ["T", "A", "A > A1", "A > A2"]  # tiny B joins the last
    assert chunks[-1][1].endswith("tiny") and all(X.estimate_tokens(c) <= 480 for _, c in chunks)
    assert chunking.chunk_outline(markdown.outline("")) == []
    assert chunking.with_headings([("", "x")], chunking.heading_of(" ", " ")) == [(chunking.UNTITLED, "x")]


def test_flatten_and_its_map():
    text = "# H\nSome **bold** [link](http://x) `code`\n```\nfenced\n```\n\ttail  end "
    flat = excerpt.flatten(text)
    assert flat.text == "Some bold link code tail end"
    assert len(flat.at) == len(flat.text) and flat.at == sorted(flat.at)
    assert text[flat.at[flat.text.index("link")] :].startswith("link](")
    assert excerpt.flatten(text, False).text.count("fenced") == 1


def test_excerpts():
    assert excerpt.excerpt("short *text*") == "short text"
    assert excerpt.excerpt("```\nonly code\n```") == "only code"
    assert excerpt.excerpt("word " * 100) == ("word " * 24).rstrip() + "…"
    content = "the start " * 400 + "the RÉSUMÉ of zebras " + "the end " * 400
    lead = excerpt.excerpt_for(content, "the resume zebras", True)
    assert "RÉSUMÉ of zebras" in lead and lead.startswith("…") and lead.endswith("…") and len(lead) <= 1402
    assert len(excerpt.excerpt_for(content, "zebras", False)) <= 121
    assert excerpt.locate("ÁáA", ["a"]) == [(0, 1, "a"), (1, 2, "a"), (2, 3, "a")]
    assert excerpt.best_centre([], 10) is None
    assert excerpt.best_centre([(0, 3, "the"), (100, 103, "the"), (110, 116, "zebra")], 50) == 108


def test_windows_against_every_window():
    """The best centre against a search through all windows; repeated query terms count like repeated spans."""
    rng = random.Random(9)
    for _ in range(200):
        terms = ["a", "bb", "ccc", "dddd"]
        times = {t: rng.randint(1, 3) for t in terms}
        spans = sorted({(p, p + len(t), t) for t in terms for p in rng.sample(range(80), rng.randint(0, 5))})
        budget = rng.randint(4, 40)
        every = sorted([s for s in spans for _ in range(times[s[2]])], key=lambda s: s[:2])
        count = Counter(s[2] for s in every)
        best = None
        for right in range(len(every)):
            reach = max(s[1] for s in every[: right + 1])
            left = next(i for i in range(right + 1) if every[i][0] >= reach - budget or i == right)
            own = {s[2] for s in every[left : right + 1]}
            key = (-round(sum(math.log(1 + len(every) / count[t]) for t in own), 9), -sum(map(len, own)), every[left][0])
            if best is None or key < best[0]:
                best = (key, (every[left][0] + every[right][1]) // 2)
        got = excerpt.best_centre(spans, budget, times)
        assert got == excerpt.best_centre(every, budget) == (best and best[1])


def test_texts_of_a_batch_are_python_strings_slice_by_slice(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.operators import reading

    sizes = []

    class Watched:
        def __init__(self, rows):
            self.rows = rows

        def __len__(self):
            return len(self.rows)

        def slice(self, lo, n):
            sizes.append(n)
            return pa.array(self.rows[lo : lo + n])

    rows = [f"## a{i}\nb" for i in range(500)] + [None]
    assert X.mapped(lambda t: len(t or ""), pa.int32(), Watched(rows)).to_pylist() == [len(r or "") for r in rows]
    assert max(sizes) <= 64 and X.mapped(len, pa.int32(), pa.array([], pa.string())).to_pylist() == []
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")
    got = frame.select("id", reading.headings(F.col("text")).alias("h"), excerpt.excerpts(F.col("text"), F.lit("b"), F.lit(1)).alias("e")).orderBy("id").collect()
    assert [r.h for r in got] == [[f"a{i}"] for i in range(500)] + [[]] and [r.e for r in got] == ["b"] * 500 + [""]


def test_located_equals_every_occurrence():
    rng = random.Random(4)
    for _ in range(200):
        raw = "".join(rng.choice("aÁbİß ẍx̌😀") for _ in range(rng.randint(0, 30)))
        terms = list(dict.fromkeys("".join(rng.choice("aábBi̇") for _ in range(rng.randint(1, 2))) for _ in range(4)))
        raw = X.units(raw)
        folded = [(c, i) for i, r in enumerate(raw) for c in X.fold_match(r)] + [("", len(raw))]
        flat = "".join(c for c, _ in folded)
        want = [(folded[k][1], folded[k + len(low)][1], t) for t in terms if (low := X.fold_match(t)) for k in range(len(flat)) if flat.startswith(low, k)]
        assert sorted(excerpt.locate(raw, terms)) == sorted(want)
        found = excerpt.located(raw, terms)
        assert found.start.tolist() == sorted(found.start.tolist())
