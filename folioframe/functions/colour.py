"""Numbers as colours: three digits to the base 40, one a channel, shifted so that black stays free."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits per channel, steps of a channel (none of them black), and how far a channel may be off.
BASE, STEPS = 40, 41
TOLERANCE = 0.08


def encode(n: Column) -> Column:
    m = n + 1
    channel = lambda k: ((F.floor(m / (BASE**k)) % BASE + 1) / float(STEPS)).cast("double")
    return F.struct(channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))


def decode(r: Column, g: Column, b: Column) -> Column:
    """The number, or null for channels outside the grid or off it by more than the tolerance, and for none."""
    step = lambda c: F.round(c * STEPS)
    bad = lambda c: (F.abs(c * STEPS - step(c)) > TOLERANCE) | (step(c) < 1) | (step(c) > BASE)
    n = sum(((step(c) - 1).cast("long") * BASE**k for c, k in ((r, 2), (g, 1), (b, 0))), F.lit(-1))
    return F.when(bad(r) | bad(g) | bad(b) | (n < 0), None).otherwise(n)
