"""Text expressions. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed as X

def strip(text: Column) -> Column:
    """Cut every kind of white space from both ends (SQL trim cuts only blanks)."""
    return F.btrim(text, F.lit(X.WHITESPACE_CHARS))


def words(text: Column) -> Column:
    """Lower-case words between white space; empty for a blank text."""
    bare = strip(F.lower(text))
    return F.when(bare != "", F.split(bare, f"{X.WHITESPACE}+")).otherwise(F.array().cast("array<string>"))


def blocks(text: Column, size: int) -> Column:
    """Consecutive pieces of `size` characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))


def windows_of(pieces: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each starting `size - overlap` after the last,
    from the blocks of one step (`blocks(text, size - overlap)`).

    A substring at offset n has to walk n characters first, so cutting a long
    text window by window is quadratic. A window is its block plus the start of
    what follows. `pieces` should be a column by itself: it is used per window.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the window")
    following = -(-overlap // step)

    def window(piece: Column, at: Column) -> Column:
        tail = F.array_join(F.slice(pieces, at + F.lit(2), F.lit(following)), "")
        return F.concat(piece, F.left(tail, F.lit(overlap)))

    return F.transform(pieces, window) if overlap else pieces


def display_name(feature: Column) -> Column:
    """`BILL_AMT1` -> `Bill Amt1`."""
    plain = F.replace(F.replace(feature, F.lit(X.ENCODED_SUFFIX), F.lit("")), F.lit("_"), F.lit(" "))
    return F.initcap(plain)


def signed(value: Column, digits: int) -> Column:
    """Fixed number of decimals with an explicit sign; a small negative keeps its minus."""
    return F.concat(F.when(value < 0, "-").otherwise("+"), fixed_decimals(F.abs(value), digits))


def fixed_decimals(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(value, digits))
