"""Chunks of a document: one a section, of its subsections where it is too large, bounded, tiny ones merged."""

from __future__ import annotations

from tessera.functions.markdown import Outline, Section
from tessera.functions.splitting import Splitter
from tessera.functions.text import SPACE_CHARS, estimate_tokens

MIN_TOKENS, MAX_TOKENS = 100, 480
UNTITLED = "Untitled document"


def heading_of(title: str, path: str) -> str:
    return title.strip(SPACE_CHARS) or path.strip(SPACE_CHARS) or UNTITLED


def whole(section: Section) -> str:
    return "\n\n".join(t for t in (section.text, *map(whole, section.children)) if t.strip(SPACE_CHARS))


def pieces(outline: Outline, max_tokens: float) -> list[tuple[tuple[str, ...], str]]:
    out = [((outline.title,), outline.intro.strip(SPACE_CHARS))]
    for s in outline.sections:
        if not s.children or estimate_tokens(whole(s)) <= max_tokens:
            out.append(((s.title,), whole(s)))
        else:
            out.append(((s.title,), s.text.strip(SPACE_CHARS)))
            out += [((s.title, c.title), whole(c)) for c in s.children]
    return [p for p in out if p[1]]


def chunk_outline(outline: Outline, min_tokens: float = MIN_TOKENS, max_tokens: float = MAX_TOKENS) -> list[tuple[str, str]]:
    """(heading path, content) in order; the heading of a merged chunk is its first part's."""
    cut = Splitter(max_tokens)
    out: list[tuple[tuple[str, ...], str]] = []
    for path, text in pieces(outline, max_tokens):
        for part in cut.split(text):
            together = f"{out[-1][1]}\n\n{part}" if out else ""
            if out and estimate_tokens(part) < min_tokens and estimate_tokens(together) <= max_tokens:
                out[-1] = (out[-1][0], together)
            else:
                out.append((path, part))
    return [(" > ".join(s for s in path if s.strip(SPACE_CHARS)), text) for path, text in out]


def chunk_whole(body: str, max_tokens: float = MAX_TOKENS) -> list[tuple[str, str]]:
    """By size only, for documents exempt from heading chunks."""
    text = body.strip(SPACE_CHARS)
    return [("", part) for part in Splitter(max_tokens).split(text)] if text else []


def with_headings(chunks: list[tuple[str, str]], fallback: str) -> list[tuple[str, str]]:
    return [(h or fallback, t) for h, t in chunks]
