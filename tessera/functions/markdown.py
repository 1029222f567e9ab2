"""Markdown as the engine needs it: frontmatter, and an outline of title, summary, intro and two levels of sections.

A line scanner follows the block structure of CommonMark as far as it decides which top-level lines are headings and
paragraphs: ATX and setext headings, fenced and indented code, the seven kinds of HTML blocks, link definitions, and quotes
and lists: what they hold is looked at only to know whether a paragraph is open in them, which alone goes on lazily.
"""

from __future__ import annotations

import datetime
import html
import re
from dataclasses import dataclass, field

from tessera.functions.splitting import is_fence
from tessera.functions.text import SPACE_CHARS

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\r?$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*\r?$")
_OPEN = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\r?$")
_QUOTE = re.compile(r" {0,3}>")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|\r?$)")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<[^<>]*>|\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*\r?$")

#: Tags that begin an HTML block up to a blank line (fixed by CommonMark).
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th "
    "thead title tr track ul"
).split()
_ATTRIBUTE = r"""(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
#: How an HTML block begins, where it ends (None: at a blank line), and whether it ends a paragraph.
_HTML = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.IGNORECASE), re.compile(r"</(?:script|pre|style|textarea)>", re.IGNORECASE), True),
    (re.compile(r" {0,3}<!--"), re.compile("-->"), True),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>"), True),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">"), True),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(_BLOCK_TAGS)})(?:\s|/?>|$)", re.IGNORECASE), None, True),
    (re.compile(rf" {{0,3}}(?:<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None, False),
]


@dataclass
class Block:
    kind: str  # heading or paragraph
    depth: int
    text: str
    start: int
    end: int


def label(text: str) -> str:
    """Link labels are compared without case and with single blanks."""
    return " ".join(text.split()).casefold()


def inline_text(source: str, labels: frozenset[str] | set[str] = frozenset()) -> str:
    """What is read of inline Markdown: no emphasis marks, code without ticks, links by their text, no images; references
    are links where their label is defined."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[2].replace("\n", " ").strip() or m[2])
        return f"\0{len(kept) - 1}\0"

    s = re.sub(r"(`+)(.+?)\1(?!`)", keep, source, flags=re.DOTALL)
    s = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: kept.append(m[1]) or f"\0{len(kept) - 1}\0", s)
    s = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", s)
    s = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", s)
    if labels:  # [text][label], [label][] and [label]
        s = re.sub(r"(!?)\[([^\[\]]*)\]\[([^\[\]]+)\]", lambda m: m[0] if label(m[3]) not in labels else "" if m[1] else m[2], s)
        s = re.sub(r"(!?)\[([^\[\]]+)\](?:\[\])?", lambda m: m[0] if label(m[2]) not in labels else "" if m[1] else m[2], s)
    s = re.sub(r"<((?:https?|mailto):[^>\s]*)>", r"\1", s)
    for mark in (r"\*\*\*", r"\*\*", r"\*"):
        s = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark}", r"\1", s, flags=re.DOTALL)
    for mark in ("___", "__", "_"):
        s = re.sub(rf"(?<!\w){mark}(?=\S)(.+?)(?<=\S){mark}(?!\w)", r"\1", s, flags=re.DOTALL)
    s = re.sub(r" {2,}\n|\\\n", "", s)
    s = re.sub(r"[ \t]*\n[ \t]*", "\n", html.unescape(s))
    return re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], s)


def html_end(line: str, in_paragraph: bool) -> tuple[re.Pattern | None] | None:
    """(where the HTML block that this line begins ends,), or None if it begins none."""
    for begins, ends, interrupts in _HTML:
        if (interrupts or not in_paragraph) and begins.match(line):
            return (ends,)
    return None


class Container:
    """A quote or list that is open: the indent that goes on in it (0 for a quote), and whether a paragraph is open inside."""

    def __init__(self, line: str, width: int):
        self.width, self.fence, self.open = width, "", False
        self.take(line)

    def take(self, line: str) -> None:
        """A line that belongs to it."""
        inner = line[self.width :] if self.width and not line[: self.width].strip() else line
        while not self.fence and (m := _QUOTE.match(inner) or _ITEM.match(inner)) and not _RULE.match(inner):
            inner = inner[m.end() :].removeprefix(" ") if m.re is _QUOTE else inner[m.end() :]
            self.open = False
        bare = inner.strip()
        if self.fence:
            if _QUOTE.match(inner):
                bare = inner[_QUOTE.match(inner).end() :].strip()
            if bare.startswith(self.fence) and not bare.strip(self.fence[0]):
                self.fence = ""
            self.open = False
        elif m := _OPEN.match(inner):
            self.fence, self.open = m[1], False
        elif _ATX.match(inner) or _RULE.match(inner) or html_end(inner, self.open) or (self.open and _SETEXT.match(inner)):
            self.open = False
        else:
            self.open = bool(bare) and (self.open or not inner.startswith(("    ", "\t")))

    def blank(self) -> bool:
        """Whether it goes on behind a blank line."""
        self.open = False
        self.fence = self.fence if self.width else ""
        return self.width > 0


def top_blocks(body: str) -> list[Block]:
    """Headings and paragraphs that stand at top level, with their offsets."""
    out: list[Block] = []
    held: list[tuple[str, int, int]] = []  # lines of an open paragraph
    labels: set[str] = set()
    fence, at = "", 0
    container: Container | None = None
    markup: tuple[re.Pattern | None] | None = None

    def define() -> None:
        """Definitions at the beginning of a paragraph are none of it."""
        while held and (m := _DEFINITION.match(held[0][0])) and label(m[1]):
            labels.add(label(m[1]))
            del held[0]

    def close() -> None:
        define()
        if held:
            out.append(Block("paragraph", 0, "\n".join(x.strip() for x, _, _ in held), held[0][1], held[-1][2]))
            held.clear()

    for line in body.split("\n"):
        start, end = at, at + len(line.removesuffix("\r"))
        at += len(line) + 1
        blank = not line.strip()
        indent = len(line) - len(line.lstrip(" ")) if not line.startswith("\t") else 4
        if fence:
            if line.strip().startswith(fence) and not line.strip().strip(fence[0]) and indent < 4:
                fence = ""
            continue
        if markup:
            if blank if markup[0] is None else markup[0].search(line):
                markup = None
            continue
        if container:
            if blank:
                container = container if container.blank() else None
                continue
            item = None if _RULE.match(line) else _ITEM.match(line)
            if _QUOTE.match(line) or item or (container.width and indent >= container.width):
                if item and indent < max(container.width, 1):
                    container = Container(line, len(item[0]))
                else:
                    container.take(line)
                continue
            if container.open and not (_ATX.match(line) or _OPEN.match(line) or _RULE.match(line) or html_end(line, True)):
                continue  # its paragraph goes on
            container = None
        if blank:
            close()
            continue
        if held and (m := _SETEXT.match(line)):
            define()
            if held:
                out.append(Block("heading", 1 if m[1][0] == "=" else 2, "\n".join(x.strip() for x, _, _ in held), held[0][1], end))
                held.clear()
                continue
        if indent >= 4 and not held:
            continue
        if m := _ATX.match(line):
            close()
            title = re.sub(r"^#+$", "", (m[2] or "").strip())
            out.append(Block("heading", len(m[1]), title, start + len(line) - len(line.lstrip(" ")), end))
        elif m := _OPEN.match(line):
            close()
            fence = m[1]
        elif _RULE.match(line):
            close()
        elif _QUOTE.match(line):
            close()
            container = Container(line, 0)
        elif (m := _ITEM.match(line)) and not (held and (not m[3].strip(" \t\r") and m[0].strip() == line.strip() or m[2][0].isdigit() and m[2][:-1] != "1")):
            close()
            container = Container(line, len(m[0]))
        elif ends := html_end(line, bool(held)):
            close()
            markup = None if ends[0] is not None and ends[0].search(line, line.index("<") + 2) else ends
        else:
            held.append((line, start + len(line) - len(line.lstrip()), end))
    close()
    for b in out:
        b.text = inline_text(b.text, labels)
    return out


@dataclass
class Section:
    title: str
    text: str
    children: list[Section] = field(default_factory=list)


@dataclass
class Outline:
    title: str
    summary: str
    intro: str
    sections: list[Section]


def outline(body: str) -> Outline:
    """The first H1 is the title; the first paragraph behind it the summary; H2 sections with H3 children."""
    found = top_blocks(body)
    top = next((b for b in found if b.kind == "heading" and b.depth == 1), None)
    summary = next((b.text for b in found if top and b.kind == "paragraph" and b.start > top.start and b.text), "")
    marks = [b for b in found if b.kind == "heading" and b.depth in (2, 3)]
    stops = [b.start for b in marks] + [len(body)]
    cut = lambda a, b: body[a:b].strip(SPACE_CHARS)
    majors = [i for i, b in enumerate(marks) if b.depth == 2]
    first = marks[majors[0]].start if majors else len(body)
    sections = []
    for i, after in zip(majors, [*majors[1:], len(marks)], strict=False):
        inner = [Section(marks[j].text, cut(stops[j], stops[j + 1])) for j in range(i + 1, after)]
        sections.append(Section(marks[i].text, cut(stops[i], stops[i + 1]), inner))
    return Outline(top.text if top else "", summary, cut(top.end if top else 0, first), sections)


def split_frontmatter(raw: str) -> tuple[dict, str]:
    """Frontmatter between ``---`` lines at the very start, and the body; malformed YAML is an error."""
    m = re.match(r"---[ \t]*\r?\n(.*?)(?:^---[ \t]*(?:\r?\n|$))", raw, re.DOTALL | re.MULTILINE)
    if not m:
        return {}, raw
    import yaml

    data = yaml.safe_load(m[1])
    return (data if isinstance(data, dict) else {}), raw[m.end() :]


def scalar(value: object) -> str | None:
    """A frontmatter value that counts as text; dates as YYYY-MM-DD; anything else, and blank text, is absent."""
    if isinstance(value, datetime.date):
        return value.isoformat()[:10]
    return value.strip(SPACE_CHARS) or None if isinstance(value, str) else None


def headings_in(text: str) -> list[str]:
    """Titles of H2-H6 lines outside fences; fences are trusted only if they pair up."""
    lines = text.split("\n")
    paired = sum(map(is_fence, lines)) % 2 == 0
    out, inside = [], False
    for line in lines:
        if is_fence(line):
            inside ^= paired
        elif not inside and (m := re.fullmatch(r"#{2,6}\s+(.+?)\r?", line)):
            out.append(m[1].strip(SPACE_CHARS))
    return out
