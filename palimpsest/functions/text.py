"""Words of a text, as the message index knows them."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.scalars import ColumnOrName, col

# Letters, digits, private-use characters and marks on them; all else separates words.
WORD_BREAK = r"[^\p{L}\p{N}\p{Co}]+"
COMBINING_MARKS = r"[\u0300-\u036f]"
# What ``WORD_BREAK`` is in text of ASCII characters in lower case.
ASCII_BREAK = "[^a-z0-9]+"


def _one_mark_letters() -> tuple[str, str]:
    """Latin letters with one accent, and the letters without it.

    A letter with two accents keeps both, as in the default tokenizer of SQLite's text index.
    """
    marked, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.combining(parts[1]):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _one_mark_letters()


def fold(text: ColumnOrName) -> Column:
    """Lower case without accents."""
    bare = F.regexp_replace(col(text), COMBINING_MARKS, "")
    return F.lower(F.translate(bare, MARKED, PLAIN))


def tokens(text: ColumnOrName) -> Column:
    """Folded words in order; ASCII text has no accents to take off and a plainer word break."""
    words = F.when(col(text).rlike(r"[^\x00-\x7F]"), F.split(fold(text), WORD_BREAK)).otherwise(
        F.split(F.lower(col(text)), ASCII_BREAK))
    return F.filter(words, lambda t: t != "")


def fold_term(term: str) -> str:
    """The same folding for a search term."""
    bare = re.sub(COMBINING_MARKS, "", term)
    return bare.translate(str.maketrans(MARKED, PLAIN)).lower()


def term_words(text: str) -> list[str]:
    """Folded words of a search term or phrase."""
    words, word = [], []
    for ch in fold_term(text):
        if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co":
            word.append(ch)
        elif word:
            words.append("".join(word))
            word = []
    if word:
        words.append("".join(word))
    return words
