"""IUPAC base sets as 4-bit masks (A=1 C=2 G=4 T=8)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters in mask order 0..15.
LETTERS = "XACMGRSVTWYHKDBN"
# One bit per base.
BASE_BITS = {"A": 1, "C": 2, "G": 4, "T": 8}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def mask(call) -> Column:
    """OR of the masks of all letters in `call`; NULL when a letter is unknown."""
    call = F.upper(_c(call))
    # A single letter (the usual case) needs only a locate; longer calls fold.
    one = F.instr(F.lit(LETTERS), call) - 1
    many = F.aggregate(
        F.split(call, ""), F.lit(0),
        lambda acc, x: acc.bitwiseOR(F.when(x == "", 0).otherwise(F.instr(F.lit(LETTERS), x) - 1)))
    known = call.rlike(f"^[{LETTERS}]+$")
    return F.when(~known, F.lit(None)).when(F.length(call) == 1, one).otherwise(many).cast("int")


def letter(mask_col) -> Column:
    """Mask 0..15 to its letter."""
    return F.substring(F.lit(LETTERS), _c(mask_col) + 1, 1)


def expand(mask_col, sep: str = "/") -> Column:
    """Bases of a mask joined by `sep`; empty for mask 0."""
    m = _c(mask_col)
    return F.concat_ws(sep, *[F.when(m.bitwiseAND(bit) != 0, base) for base, bit in BASE_BITS.items()])


def expand_letter(call, sep: str = "/") -> Column:
    return expand(mask(call), sep)


def is_nocall(call) -> Column:
    return F.upper(_c(call)).rlike("^[NX]")


def call_class(call) -> Column:
    """'nocall', 'hom', 'het' of a call's letters (NULL for an unknown letter)."""
    m = mask(call)
    bits = F.bit_count(m)
    return (F.when(is_nocall(call) | m.isin(0, 15), "nocall")
            .when(bits == 1, "hom").when(bits > 1, "het"))
