"""Two-bit DNA as longs: A 0, C 1, G 2, T 3, first base in the highest bits; up to 32 bases, as an unsigned bit pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
ODD_BITS = 0x5555555555555555


def mask(bases: int) -> int:
    """The low bits of so many bases, as a signed long; all ones from 32 bases on."""
    return -1 if bases >= 32 else (1 << (2 * bases)) - 1


def encode(sequence: Column) -> Column:
    """Bits of a sequence of at most 32 bases, in either case; N counts as G. Two halves, as 32 T's don't fit a signed long."""
    digits = F.translate(F.upper(sequence), "ACGTN", "01232")
    high, low = F.greatest(F.length(digits) - 16, F.lit(0)), F.least(F.length(digits), F.lit(16))
    part = lambda start, n: F.coalesce(F.conv(F.substring(digits, start, n), 4, 10).cast("long"), F.lit(0).cast("long"))
    return F.shiftleft(part(F.lit(1), high), 32).bitwiseOR(part(high + 1, low))


def decode(bits: Column, bases: int) -> Column:
    """The sequence of so many bases in the low bits."""
    letter = lambda shift: F.substring(F.lit(BASES), F.shiftrightunsigned(bits, shift).bitwiseAND(3).cast("int") + 1, F.lit(1))
    return F.concat(*[letter(2 * i) for i in range(bases - 1, -1, -1)])


def hamming(a: Column, b: Column) -> Column:
    """Number of bases in which the two differ."""
    d = a.bitwiseXOR(b)
    return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(ODD_BITS)))


def neighbours(bits: Column, bases: int) -> Column:
    """All values that differ in exactly one base."""
    flips = F.array(*[F.lit(x << (2 * i) if x << (2 * i) < 1 << 63 else (x << (2 * i)) - (1 << 64)).cast("long") for i in range(bases) for x in (1, 2, 3)])
    return F.transform(flips, lambda x: bits.bitwiseXOR(x))


def unsigned(bits: Column) -> Column:
    """A key that sorts longs as unsigned values."""
    return bits.bitwiseXOR(F.lit(-(1 << 63)))
