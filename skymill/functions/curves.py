"""Places along a space-filling curve, as column expressions: neighbours in space become neighbours in storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each of three axes that a curve number holds.
BITS = 21
#: Fixed values of the usual interleaving: shifts, and masks of what then lies apart.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def cell(p: Column, low: float, span: float, bits: int = BITS) -> Column:
    """Which of 2**bits equal parts of an axis a position lies in; positions beyond the ends count as at them."""
    at = F.least(F.greatest(F.floor((p - low) / span * float(1 << bits)), F.lit(0)), F.lit((1 << bits) - 1))
    return F.when(p.isNotNull(), at).cast("long")


def spread(n: Column) -> Column:
    """The bits of a number below 2**21, two zeros between any two."""
    for by, mask in SPREAD:
        n = n.bitwiseOR(F.shiftleft(n, by)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def morton(axes: tuple[Column, ...], low: float = 0.0, span: float = 1.0) -> Column:
    """The Morton number of a position in a cube: the bits of its cells on up to three axes, interleaved, the first axis' lowest. Null where a coordinate is."""
    parts = [F.shiftleft(spread(cell(p, low, span)), k) for k, p in enumerate(axes)]
    return reduce(Column.bitwiseOR, parts)
