"""Text scalar functions: case folding, punctuation strip, tokenising.

Python's ``\\w`` and ``\\s`` are Unicode-aware while Java's are ASCII, so the
classes are spelled out with Unicode properties to keep accented letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.split() sees it.
WS_CHARS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_RUN = f"[{WS_CHARS}]+"
# Python r'[^\w\s\[\]]' with Unicode \w and \s.
PUNCT = rf"[^\p{{L}}\p{{N}}_{WS_CHARS}\[\]]"
# Runs of two or more word characters (default TF-IDF token pattern).
WORD2 = r"([\p{L}\p{N}_]{2,})"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_punct(col, repl: str = "") -> Column:
    """Remove (repl='') or blank out (repl=' ') everything but word chars, blanks and brackets."""
    return F.regexp_replace(_c(col), PUNCT, repl)


def split_words(col) -> Column:
    """Whitespace tokenise like Python ``str.split()``: no empty tokens."""
    return F.filter(F.split(_c(col), WS_RUN), lambda t: t != F.lit(""))


def lexicon_tokens(col, repl: str = "", lower: bool = True) -> Column:
    """Lower-case (unless told not to), strip punctuation, split on whitespace."""
    return split_words(strip_punct(F.lower(_c(col)) if lower else _c(col), repl))


def tfidf_tokens(col) -> Column:
    """Lower-case runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD2), 1)


def first_word_exact(col) -> Column:
    """``s.split(' ')[0]`` -- no trimming, a leading blank gives ''."""
    return F.split(_c(col), " ").getItem(0)


def first_word(col) -> Column:
    """``s.split()[0]`` -- trimmed; null when there is no word."""
    return F.get(split_words(col), 0)


def scene_season(col) -> Column:
    """``int(scene_id.split('_')[0])``."""
    return F.split(_c(col), "_").getItem(0).cast("int")


def scene_episode(col) -> Column:
    """``int(scene_id.split('_')[1][1:])``."""
    return F.substring(F.get(F.split(_c(col), "_"), 1), 2, 1 << 20).cast("int")


def list_literal(arr_col) -> Column:
    """Render an array the way a Python list prints: ``[1, 0, -1]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr_col, lambda x: x.cast("string")), ", "),
                    F.lit("]"))
