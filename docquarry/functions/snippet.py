"""Snippets and highlights of the few rows that a search returns, in plain Python."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Sequence

from ..plans.ast import Phrase
from .text import token_spans

# --- fixed values: marks, window and context
OPEN, CLOSE, ELLIPSIS = ">>", "<<", "..."
WINDOW_TOKENS, CONTEXT_CHARS = 12, 40
#: Worth of a phrase's first and further places in a window, and of a window at the start of the text
#: or of a sentence.
NEW_PHRASE, SAME_PHRASE, TEXT_START, SENTENCE_START = 1000, 1, 120, 100


def places(tokens: Sequence[str], phrases: Iterable[Phrase]) -> list[tuple[int, int, int]]:
    """``(start, end, phrase number)`` in tokens of every phrase of the body, in order."""
    out = []
    for k, p in enumerate(phrases):
        n = len(p.tokens)
        if not n or p.field not in (None, "body"):
            continue
        for i in range(len(tokens) - n + 1):
            if tuple(tokens[i : i + n - 1]) == p.tokens[:-1] and (tokens[i + n - 1].startswith(p.tokens[-1]) if p.prefix else tokens[i + n - 1] == p.tokens[-1]):
                out.append((i, i + n, k))
    return sorted(out)


def _worth(found: list[tuple[int, int, int]], start: int) -> tuple[int, int, int]:
    """Of the window at ``start``: its worth, and the first and last token of phrases in it."""
    worth, seen, first, last = 0, set(), None, 0
    for n in range(bisect_left(found, (start,)), len(found)):
        a, b, k = found[n]
        if a >= start + WINDOW_TOKENS:
            break
        worth += SAME_PHRASE if k in seen else NEW_PHRASE
        seen.add(k)
        first, last = a if first is None else first, b
    return worth, first if first is not None else start, last


def sentence_starts(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """Tokens that begin the text, or follow a full stop or colon."""
    follows = (text[spans[i - 1][2] : spans[i][1]].rstrip(" \t\r\n")[-1:] for i in range(1, len(spans)))
    return [0, *(i for i, sign in enumerate(follows, 1) if sign in (".", ":"))]


def window(text: str, spans: list[tuple[str, int, int]], found: list[tuple[int, int, int]]) -> int:
    """First token of the best window of WINDOW_TOKENS."""
    n, best, at = len(spans), 0, 0
    sentences = sentence_starts(text, spans) if found and n > WINDOW_TOKENS else [0]
    for a, _, _ in found:
        worth, first, last = _worth(found, a)
        centred = max(0, min(first - (WINDOW_TOKENS - (last - first)) // 2, n - WINDOW_TOKENS))
        if worth > best:
            best, at = worth, centred
        if n > WINDOW_TOKENS:
            begin = sentences[bisect_right(sentences, a) - 1]
            if begin < a:
                worth = _worth(found, begin)[0] + (TEXT_START if begin == 0 else SENTENCE_START)
                if worth > best:
                    best, at = worth, begin
    return at


def snippet(text: str, phrases: Sequence[Phrase]) -> str:
    """The best window with its phrases marked; without any, the first tokens."""
    spans = token_spans(text)
    found = places([t for t, _, _ in spans], phrases)
    first = window(text, spans, found)
    last = min(first + WINDOW_TOKENS, len(spans))
    begin = spans[first][1] if first else 0
    end = spans[last - 1][2] if last < len(spans) else len(text)
    merged: list[list[int]] = []
    for a, b, _ in found:
        if a < last and b > first:
            a, b = max(a, first), min(b, last)
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
    out, at = ELLIPSIS if first else "", begin
    for a, b in merged:
        out += text[at : spans[a][1]] + OPEN + text[spans[a][1] : spans[b - 1][2]] + CLOSE
        at = spans[b - 1][2]
    return out + text[at:end] + (ELLIPSIS if last < len(spans) else "")


def _ascii_lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def literal_span(text: str, needles: Iterable[str]) -> tuple[int, int] | None:
    """Start and length of the first needle that occurs, A-Z in either case."""
    low = _ascii_lower(text)
    for needle in needles:
        at = low.find(_ascii_lower(needle))
        if needle and at >= 0:
            return at, len(needle)
    return None


def around(text: str, start: int, length: int) -> str:
    """The span marked, with context on both sides."""
    a, b = max(0, start - CONTEXT_CHARS), min(len(text), start + length + CONTEXT_CHARS)
    return (ELLIPSIS if a else "") + text[a:start] + OPEN + text[start : start + length] + CLOSE + text[start + length : b] + (ELLIPSIS if b < len(text) else "")


def widened(marked: str, needles: Sequence[str]) -> str:
    """Marks extended over what follows, where a longer needle begins with the marked text."""
    out, rest = "", marked
    while True:
        a = rest.find(OPEN)
        b = rest.find(CLOSE, a + len(OPEN)) if a >= 0 else -1
        if b < 0:
            return out + rest
        hit, after = rest[a + len(OPEN) : b], rest[b + len(CLOSE) :]
        low, more = _ascii_lower(hit), 0
        for needle in needles:
            tail = needle[len(hit) :]
            if len(needle) > len(hit) and _ascii_lower(needle[: len(hit)]) == low and _ascii_lower(after[: len(tail)]) == _ascii_lower(tail):
                more = max(more, len(tail))
        out += rest[:a] + OPEN + hit + after[:more] + CLOSE
        rest = after[more:]


def located(analyser, text: str, forms: Iterable[str]) -> tuple[int, int] | None:
    """Where the analyser finds one of the forms, widened to the whole word."""
    return None if analyser is None else analyser.locate(text, list(forms))


def result_snippet(text: str, phrases: Sequence[Phrase], needles: Sequence[str], forms: Sequence[str] = (), analyser=None) -> str:
    """What a hit shows: the best window, else a needle's place, else a word form's; marks widened."""
    shown = snippet(text, phrases)
    if OPEN not in shown:
        span = literal_span(text, needles) or located(analyser, text, forms)
        if span:
            shown = around(text, *span)
    return widened(shown, needles)


def snippet_text(shown: str) -> str:
    """Without marks."""
    return re.sub(f"{OPEN}|{CLOSE}", "", shown)
