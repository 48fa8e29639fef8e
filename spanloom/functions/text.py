"""Scalar text functions over code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = r"[\p{L}\p{Nl}\p{No}]"
CONTENT = r"[\p{L}\p{N}]"
BREAK = r"(\r?\n[ \t\x{a0}\x{200f}\x{200e}]*\r?\n)"
STOP = r"([.؟?!]+)(?=(?U:\s)|\x01|$)"
#: Ends of sentences for an alternative grid, in which a line ends one too.
LINE_STOP = r"([.؟?!]+(?=(?U:\s)|\x01|$)|\n)"
#: All white space in the sense of (?U:\s).
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def pieces(text: Column, stop: str = STOP) -> Column:
    """Cuts a text after each run of terminators before white space and around paragraph breaks; nothing is lost."""
    mark = F.lit("\x01")
    return F.split(F.regexp_replace(F.regexp_replace(text, F.lit(BREAK), F.concat(mark, F.lit("$1"), mark)), F.lit(stop), F.concat(F.lit("$1"), mark)), "\x01")


def leading(s: Column) -> Column:
    """Number of white-space characters before the text; trim() alone knows only the ASCII space."""
    return F.char_length(s) - F.char_length(F.ltrim(s, F.lit(WHITE)))


def trimmed_length(s: Column) -> Column:
    return F.char_length(F.rtrim(s, F.lit(WHITE)))


def trimmed(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITE))


def slice_(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))


def words(text: Column) -> Column:
    """Words in the sense of letters, numbers and underscores, without combining marks."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def let(value: Column, body) -> Column:
    """body of a value that is computed once; an expression inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, n: int) -> Column:
    """The distinct n-word sequences; a shorter text is one. Runs of white space separate words."""
    words = F.split(F.btrim(F.regexp_replace(text, r"(?U:\s)+", " ")), " ")

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.array_distinct(many)

    return let(words, of)


def html_escape(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def bucket(value: Column, edges: list[int]) -> Column:
    """The first edge that the value lies under, as a label; the last one if none."""
    out = None
    for e in edges:
        out = F.when(value < e, F.lit(f"<{e}")) if out is None else out.when(value < e, F.lit(f"<{e}"))
    return out.otherwise(F.lit(f">={edges[-1]}"))
