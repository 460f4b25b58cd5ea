"""Text normalisation as column expressions (T1-T10). Python is only asked for texts beyond Latin letters."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The code points that count as Arabic marks, and the letter and digit maps of the normal form.
ARABIC_MARKS = r"[ؐ-ًؚ-ٰٟۖ-ۭـ]"
LETTERS_FROM = "يىكهۀةأإٱँ" + "़‌‍‎‏"
LETTERS_TO = "ییکہہہاااं"
DIGITS_FROM = "".join(chr(0x660 + i) for i in range(10)) + "".join(chr(0x6F0 + i) for i in range(10)) + "".join(chr(0x966 + i) for i in range(10))
DIGITS_TO = "0123456789" * 3
APOSTROPHES = "'’"
# Letters that sound alike, for the phonetic skeleton; what has no counterpart is deleted.
SKELETON_FROM = ("ڑڈٹطثصذضظحۃعآںےئؤق"
                 "डटठढणषंॉ" + "ھ")  # fmt: skip
SKELETON_TO = ("ردتتسسزززہہاانییوک"
               "दतथधनशनो")  # fmt: skip
#: Characters that NFKC keeps and whose casefold is lower(), but for the sharp s.
LATIN = r"^[\x00-\x7EÀ-ÖØ-öø-ÿ]*$"
#: Of private use: stands for a dot that is to be kept as a word (functions.numbers).
DOT = "\uE000"
# characters one by one are looked up in a table, which takes less time than their ranges
_ONE_BY_ONE = [chr(c) for c in range(0x7F)] + [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
_listed = lambda some: "".join(rf"\x{ord(c):02x}" for c in some)
_PLAIN = rf"^[{_listed(_ONE_BY_ONE)}{DOT}]*+$"
_PLAIN_GAP = _listed(c for c in _ONE_BY_ONE if not c.isalnum() and c != " ")
_KNOWN = _listed(c for c in _ONE_BY_ONE if c.isalnum())
_GAP = r"\p{P}\p{S}\p{Cc}\s"


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def casefold(text: Column) -> Column:
    """NFKC, then full case folding (T2); null gives the empty text."""
    t = F.coalesce(text, F.lit(""))
    latin = t.rlike(LATIN)
    # the guard goes into the argument: a function in Python is not skipped by when()
    return F.when(latin, F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))).otherwise(_folded(F.when(~latin, t)))


def casefold_latin(text: Column) -> Column:
    """casefold() for columns known to hold Latin text only; it never leaves the JVM."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_marks(folded: Column) -> Column:
    """T3-T7 of folded text: marks, letters, digits, apostrophes, punctuation, white space. In Latin text of the first two only apostrophes are found."""
    def marks(t: Column) -> Column:
        letters = F.translate(F.regexp_replace(t, ARABIC_MARKS, ""), LETTERS_FROM[: len(LETTERS_TO)] + DIGITS_FROM + LETTERS_FROM[len(LETTERS_TO) :] + APOSTROPHES, LETTERS_TO + DIGITS_TO)
        # one pass for punctuation and white space, in which a space alone is left as it is; properties are only asked of what is no letter or digit of Latin
        other = F.regexp_replace(letters, rf"(?U)(?![ {_KNOWN}])[{_GAP}]++| (?![{_KNOWN}])[{_GAP}]++", " ")
        # in plain text spaces that meet are left for another pass
        plain = F.regexp_replace(F.replace(t, F.lit("'"), F.lit("")), f"[{_PLAIN_GAP}][ {_PLAIN_GAP}]*+", " ")
        return F.when(t.rlike(_PLAIN), bound(plain, lambda p: F.when(F.contains(p, F.lit("  ")), F.regexp_replace(p, "  ++", " ")).otherwise(p))).otherwise(other)

    return F.trim(bound(folded, marks))


def without_edges(text: Column) -> Column:
    """The text without white space at its ends; null gives the empty text."""
    bare = lambda t: F.when(F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t)
    return bound(F.coalesce(text, F.lit("")), bare)


def normalize(text: Column, latin: bool = False) -> Column:
    """The normal form (T1); null and empty give the empty text. latin=True promises Latin text."""
    return fold_marks(casefold_latin(text) if latin else casefold(text))


def skeleton(normal: Column) -> Column:
    """The phonetic skeleton (T8) of a text in normal form; Latin text has no letters to translate."""
    letters = lambda t: F.when(t.rlike(LATIN), t).otherwise(F.translate(t, SKELETON_FROM, SKELETON_TO))
    return F.replace(bound(normal, letters), F.lit(" "), F.lit(""))


def skeletons(normal: pa.Array) -> list[str | None]:
    """skeleton() of an Arrow array."""
    letters: dict[int, str | None] = {}
    for i, c in enumerate(SKELETON_FROM):
        letters.setdefault(ord(c), SKELETON_TO[i] if i < len(SKELETON_TO) else None)
    bare, rare = pc.replace_substring(normal, " ", "").to_pylist(), pc.match_substring_regex(normal, f"[{SKELETON_FROM}]").to_pylist()
    return [t.translate(letters) if there else t for t, there in zip(bare, rare, strict=True)]


# The ranges of code points of each script; letters outside them are "other".
SCRIPTS = {"arabic": r"\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF", "devanagari": r"\u0900-\u097F", "latin": r"\u0000-\u024F"}
RTL_SCRIPT = "arabic"


def dominant_script(text: Column) -> Column:
    """The script of most letters (T9): the one seen first wins a tie, no letters give `none`.

    Letters are counted by deleting others, in runs; all but Latin ones among what is left of the text without those."""

    def entry(letters: Column, name: str, before: str, n: Column) -> Column:
        first = F.when(n > 0, F.length(F.regexp_extract(letters, f"^[{before}]*+", 0)))
        return F.struct(n.alias("n"), (-first).alias("before"), F.lit(name).alias("name"))

    def top(letters: Column, rest: Column) -> Column:
        others = {name: ranges for name, ranges in SCRIPTS.items() if name != "latin"}
        entries = [entry(letters, "latin", "^" + SCRIPTS["latin"], F.length(letters) - F.length(rest))]
        entries += [entry(letters, name, f"^{ranges}", F.length(F.regexp_replace(rest, f"[^{ranges}]+", ""))) for name, ranges in others.items()]
        known = "".join(SCRIPTS.values())
        entries.append(entry(letters, "other", known, F.length(F.regexp_replace(rest, f"[{known}]+", ""))))
        return F.array_max(F.array(*entries))

    letters = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", "")
    best = bound(letters, lambda x: bound(F.regexp_replace(x, f"[{SCRIPTS['latin']}]+", ""), lambda rest: top(x, rest)))
    return bound(best, lambda t: F.when(t["n"] > 0, t["name"]).otherwise("none"))


def is_rtl(text: Column) -> Column:
    """T10."""
    return dominant_script(text) == RTL_SCRIPT
