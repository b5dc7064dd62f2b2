"""Plain Python versions of what the operators must give, and small tables with the odd cases."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text))


def shingles(text: str | None, width: int = 5) -> set[tuple]:
    w = words(text)
    if len(w) >= width:
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


def roots(n: int, links) -> list[int]:
    """The smallest member of the component of each of 0..n-1."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def odd_documents() -> list[tuple]:
    """NULLs in every column, empty and long texts, ties, repeated rows, no words, odd letters."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = " ".join(f"a{i}" for i in range(60))
    near = base.replace("a59", "b59")
    far = " ".join(f"a{i}" for i in range(30)) + " " + " ".join(f"c{i}" for i in range(30))
    texts = [
        base, near, near, far, "", None, "   \n\t ", "one", "one two three", "ONE Two three", long, long + " end",
        "Line\nfoot line\nLine", "ñandú 漢字 😀 ▁ x", "a\x00b\x1fc", "x" * 5000, "tail line\nfoot line",
    ]
    rows = [(i * 3, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, base, None, None, None), (None, None, None, None, None), (7, "own words of a sole text here", None, None, 3)]
    return rows
