"""Text expressions: accent folding, tokens, n-grams. All run inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of at least two word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Fixed value: white space at either end of a text, in the Unicode sense.
WHITE_SPACE_ENDS = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition, without marks, is one other character.

    Combining marks themselves come last, so that ``translate`` drops them.
    """
    folded, plain, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        kept = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if len(kept) == 1 and kept != char and code < 0x10000:
            folded.append(char)
            plain.append(kept)
    return "".join(folded + marks), "".join(plain)


def strip_accents(text: Column) -> Column:
    """Replace accented characters by their base character and drop combining marks.

    Pure ASCII texts, where the character count equals the byte count, pass untouched.
    """
    accented, plain = _accent_table()
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(
        F.translate(text, accented, plain)
    )


def strip_white_space(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_SPACE_ENDS, "")


def normalize_text(text: Column, fold_accents: bool) -> Column:
    lowered = F.lower(text)
    return strip_accents(lowered) if fold_accents else lowered


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def remove_stop_words(tokens: Column, stop_words: tuple[str, ...]) -> Column:
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda word: ~word.isin(*stop_words))


def ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """All word n-grams with ``lo <= n <= hi``, each joined by one space.

    Pass a column that already holds the tokens: it is referenced several times. Every
    length is built from the one below it, so the work is linear in the token count.
    """
    if not 1 <= lo <= hi:
        raise ValueError(f"need 1 <= lo <= hi, got ({lo}, {hi})")
    parts = []
    grams = tokens
    for n in range(1, hi + 1):
        if n > 1:
            count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, 1, count),
                F.slice(tokens, n, count),
                lambda head, word: F.concat(head, F.lit(" "), word),
            )
        if n >= lo:
            parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)
