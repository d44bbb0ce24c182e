"""Text rules as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# White space that is neither a blank nor a tab nor a line end.
RARE_WHITESPACE = r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """The white-space separated words, an empty array for a blank text.

    Where line ends and tabs are the only other white space, the usual case, they
    become blanks and the text is split at blanks, which needs no character class.
    """
    plain = text
    for mark in "\n\t\r":
        plain = F.replace(plain, F.lit(mark), F.lit(" "))
    parts = F.when(text.rlike(RARE_WHITESPACE), F.split(text, f"[{WHITESPACE_CLASS}]+")).otherwise(F.split(plain, " "))
    return F.array_remove(parts, "")


def normalize_ws(text: Column) -> Column:
    """The words joined by single blanks."""
    return F.array_join(words(text), " ")


def occurrences(text: Column, character: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def preview(text: Column, limit: int = 200) -> Column:
    """The first characters, with dots where something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def sample_document(text: Column, max_chars: int) -> Column:
    """The collapsed text cut to `max_chars`, at a word boundary when one is near enough."""
    collapsed = normalize_ws(text)
    cut = F.left(collapsed, F.lit(max_chars))
    from_end = F.instr(F.reverse(cut), " ")
    boundary = F.lit(max_chars) - from_end
    near = (from_end > 0) & (boundary > max_chars * 0.8)
    shortened = F.when(near, F.left(cut, boundary)).otherwise(cut)
    return F.when(F.length(collapsed) <= max_chars, collapsed).otherwise(F.concat(shortened, F.lit("...")))


def content_hash(text: Column) -> Column:
    """The key of a text, equal in every run."""
    return F.sha2(text, 256)


def decode_text(data: Column) -> Column:
    """File bytes as text: UTF-8, else Latin-1; line ends become `\\n`; stripped."""
    decoded = F.when(F.is_valid_utf8(data.cast("string")), F.decode(data, "UTF-8")).otherwise(
        F.decode(data, "ISO-8859-1")
    )
    return strip(F.regexp_replace(decoded, "\r\n?", "\n"))
