"""Sequence column functions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

# IUPAC letters and their complements, both cases.
_LETTERS = "ACGTMRWSYKVHDBNXacgtmrwsykvhdbnx"
_COMPLEMENTS = "TGCAKYWSRMBDHVNXtgcakywsrmbdhvnx"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def complement(col) -> Column:
    return F.translate(_c(col), _LETTERS, _COMPLEMENTS)


def revcomp(col) -> Column:
    """Reverse complement including ambiguity letters."""
    return F.reverse(complement(col))


def let(col, body) -> Column:
    """`body(value)` with `col` computed once per row.

    Without it the optimiser copies the whole expression of `col` into every
    use, also inside lambdas, where it would run once per element.
    """
    return F.element_at(F.transform(F.array(_c(col)), body), 1)


def kmer_code(col) -> Column:
    """2-bit code of an acgt string as a number (k <= 31)."""
    return F.conv(F.translate(F.lower(_c(col)), "acgt", "0123"), 4, 10).cast("long")


def kmer_text(code, k: int) -> Column:
    """Inverse of `kmer_code`, four letters at a time from a table."""
    parts, left = [], k
    while left:
        n = min(left, 4)
        left -= n
        words = F.split(F.lit(" ".join(map("".join, product("acgt", repeat=n)))), " ")
        parts.append(F.element_at(words, F.shiftright(_c(code), 2 * left).bitwiseAND(F.lit(4 ** n - 1)).cast("int") + 1))
    # The table's lookup takes a NULL place for a number.
    return F.when(_c(code).isNotNull(), F.concat(*parts))


def fill_ambiguous(col) -> Column:
    """Replace each run of non-ACGT letters by the base before it; a leading run by the first base."""
    def fill(s):
        lead = F.regexp_extract(s, "^[^acgt]*", 0)
        first = F.regexp_extract(s, "[acgt]", 0)
        run = F.regexp_extract_all(s, F.lit("[acgt]+[^acgt]*"), F.lit(0))
        filled = F.transform(run, lambda t: let(
            F.regexp_extract(t, "^[acgt]+", 0), lambda b: F.rpad(b, F.length(t), F.right(b, F.lit(1)))))
        return F.when(~s.rlike("[^acgt]"), s).otherwise(
            F.concat(F.repeat(first, F.length(lead)), F.array_join(filled, "")))

    return let(F.lower(_c(col)), fill)


_BASES = ("a", "c", "g", "t")


def _replaced(s, i, b):
    return F.concat(F.substr(s, F.lit(1), i), b, F.substr(s, i + 2))


def _ambiguous(s):
    """Number of letters outside acgt, and the position of the first."""
    return F.length(F.translate(s, "acgt", "")), F.length(F.regexp_extract(s, "^([acgt]*)", 1))


def resolutions(col) -> Column:
    """The string itself, or the 4 readings of its single ambiguous letter, else nothing."""
    def readings(s):
        count, spot = _ambiguous(s)
        return (F.when(count == 0, F.array(s))
                .when(count == 1, F.transform(F.array(*[F.lit(b) for b in _BASES]), lambda b: _replaced(s, spot, b)))
                .otherwise(F.array().cast("array<string>")))

    return let(F.lower(_c(col)), readings)


def _letters(read, ref):
    return F.arrays_zip(F.split(_c(read), "").alias("a"), F.split(_c(ref), "").alias("b"))


def mark_differences(read, ref) -> Column:
    """Read letters in lower case, upper case where they differ from `ref`."""
    return F.array_join(F.transform(_letters(F.lower(_c(read)), F.lower(_c(ref))), lambda z: F.when(
        z["a"].eqNullSafe(z["b"]) | z["b"].isNull(), z["a"]).otherwise(F.upper(z["a"]))), "")


def mismatches(read, ref) -> Column:
    """Number of differing letters of two strings."""
    return F.size(F.filter(_letters(read, ref), lambda z: ~z["a"].eqNullSafe(z["b"])))


def first_mismatch(read, ref) -> Column:
    """0-based position of the first differing letter, -1 if none."""
    return F.array_position(F.transform(_letters(read, ref), lambda z: ~z["a"].eqNullSafe(z["b"])), True).cast("int") - 1


def colorspace_bases(col) -> Column:
    """Decode `T0123..` colour text: each colour XORs the previous base.

    An unreadable colour (`.`, 4, 5, 6, N) counts as colour 0: the base repeats.
    """
    s = F.translate(F.upper(_c(col)), "ACGT456.N", "012300000")
    return F.aggregate(
        F.split(F.substr(s, F.lit(2)), ""),
        F.struct(F.substring(s, 1, 1).cast("int").alias("b"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            acc["b"].bitwiseXOR(x.cast("int")).alias("b"),
            F.concat(acc["out"], F.substr(F.lit("ACGT"), acc["b"].bitwiseXOR(x.cast("int")) + 1, F.lit(1))).alias("out")),
        lambda acc: acc["out"])


def phred_text(quals) -> Column:
    """Space-separated integer qualities as Phred+33 letters."""
    return F.array_join(F.transform(F.split(F.trim(_c(quals)), " +"),
                                    lambda q: F.chr(q.cast("int") + 33)), "")
