"""Text functions as Spark expressions, with Python twins for what runs on the driver or in snippets."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An index token: a run of letters, numbers and private-use characters.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
_TOKEN = re.compile("(?:[^\\W_]|[-])+")


def _diacritics() -> dict[str, str]:
    """Latin letters with one diacritical mark, and the letter without it (lower case)."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha() and chr(code) == chr(code).lower():
            found[chr(code)] = parts[0]
    return found


DIACRITICS = _diacritics()
_FOLD = str.maketrans(DIACRITICS)


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics.  Texts in ASCII skip the table."""
    low = F.lower(text)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, "".join(DIACRITICS), "".join(DIACRITICS.values()))).otherwise(low)


def fold_py(text: str) -> str:
    return text.lower().translate(_FOLD)


def index_tokens(text: Column) -> Column:
    """Folded index tokens in order; null has none."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def index_tokens_py(text: str) -> list[str]:
    return _TOKEN.findall(fold_py(text))


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """Folded tokens with their places in the text (folding keeps lengths, but for rare capitals)."""
    return [(fold_py(m.group()), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def bigrams(text: Column) -> Column:
    """Pairs of adjacent characters of each white-space-separated word; a word of one character is itself."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) <= 1, F.array(w)).otherwise(pairs(w))))


def bigram_text(text: Column) -> Column:
    """A text with the tokens of its ``bigrams``, joined: inner characters of a word stand twice, white space stays."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)(?<=\S)(\S)(?=\S)", "$1 $1")


def bigrams_py(text: str) -> list[str]:
    return [x for w in text.split() for x in ([w] if len(w) == 1 else [w[i : i + 2] for i in range(len(w) - 1)])]


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "[/\\\\]"), -1)


def extension(name: Column) -> Column:
    """Lower case, without the dot; empty where there is none, or where only the name's first character is a dot."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def human_bytes(n: Column) -> Column:
    """``512.0B``, ``2.0KB``, ``5.0MB``: powers of 1024 up to TB, one decimal."""
    out, scale = None, 1
    size = n.cast("double")
    for unit in ("B", "KB", "MB", "GB", "TB"):
        shown = F.concat(F.format_string("%.1f", size / scale), F.lit(unit))
        below = size < scale * 1024
        out = F.when(below, shown) if out is None else (out.otherwise(shown) if unit == "TB" else out.when(below, shown))
        scale *= 1024
    return out


def human_bytes_py(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f}{unit}"
        n /= 1024
    return f"{n:.1f}TB"
