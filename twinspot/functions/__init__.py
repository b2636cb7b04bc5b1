"""Column expressions that the operators share; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Row-major places of an 8 x 8 panel after each of its eight turns and mirrors.
SIDE = 8


def orientations(side: int = SIDE) -> list[list[int]]:
    """For each orientation, the source place of every target place."""
    out = []
    for mirror in (False, True):
        for turn in range(4):
            places = []
            for r in range(side):
                for c in range(side):
                    y, x = r, c
                    for _ in range(turn):
                        y, x = x, side - 1 - y
                    places.append(y * side + (side - 1 - x if mirror else x))
            out.append(places)
    return out


def l1_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.aggregate(diff, F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diff, F.lit(0.0), lambda s, v: s + v)


def logistic(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Into [lo, hi]; NaN goes to lo."""
    return F.when(F.isnan(x) | (x < lo), F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def ramp(x: Column, lo: float, hi: float) -> Column:
    return clip((x - lo) / (hi - lo), 0.0, 1.0) if hi > lo else F.when(x >= hi, 1.0).otherwise(0.0)


def log_ramp(n: Column, at_one: float) -> Column:
    return clip(F.log1p(F.greatest(n.cast("double"), F.lit(0.0))) / F.log1p(F.lit(at_one)), 0.0, 1.0)


def ratio(a: Column, b: Column, empty: Column | None = None) -> Column:
    """a / b, and ``empty`` (null by default) where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(None).cast("double") if empty is None else empty)


def hash_bits(values: Column, side: int = SIDE) -> Column:
    """One bit for each value, set where it is above the median; as a text of 0 and 1."""
    ordered = F.array_sort(F.transform(values, lambda x: x.cast("double")))
    half = side * side // 2
    median = (F.element_at(ordered, half) + F.element_at(ordered, half + 1)) / 2
    return F.array_join(F.transform(values, lambda x: F.when(x.cast("double") > median, "1").otherwise("0")), "")


def bits_to_long(bits: Column) -> Column:
    """64 bits as a signed number (two's complement)."""
    return F.conv(bits, 2, -10).cast("long")


def turned(bits: Column, places: list[int]) -> Column:
    return F.concat(*[F.substring(bits, p + 1, 1) for p in places])


def all_orientations(bits: Column) -> Column:
    return F.array(*[turned(bits, p) for p in orientations()])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dihedral_hamming(left: Column, right: list[Column]) -> Column:
    """Smallest Hamming distance of a hash to another one's orientations."""
    return reduce(F.least, [hamming(left, r) for r in right])


def band(probability: Column) -> Column:
    """Verdict of a probability; lower bounds belong to the band."""
    return F.when(probability >= 0.85, "likely_manipulated").when(probability >= 0.60, "suspicious").when(probability >= 0.35, "inconclusive").otherwise("clean")


#: Dataset splits and their shares, in the order in which they are filled.
SPLITS = (("train", 0.80), ("val", 0.10), ("calib", 0.05), ("test", 0.05))


def split_of(digest: Column) -> Column:
    """Dataset split by the first 32 bits of a hex digest."""
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    upto, chain = 0.0, None
    for name, share in SPLITS[:-1]:
        upto = round(upto + share, 6)
        chain = F.when(place < upto, name) if chain is None else chain.when(place < upto, name)
    return chain.otherwise(SPLITS[-1][0])
