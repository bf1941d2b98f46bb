"""Exact decimal and rounding expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MODEL_PRICES


def to_decimal(c: Column, scale: int = 2) -> Column:
    """Half-up decimal of a double by its shortest text; null for NaN, infinities and what doesn't fit."""
    return F.when(~F.isnan(c), c.try_cast(f"decimal(18,{scale})"))


def clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def bound(x: Column, f) -> Column:
    """``f(x)`` with x computed once, however often f takes it; keeps expressions small."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def round4(x: Column) -> Column:
    """Half-even rounding of a double in [0, 1] to four places by its exact binary value.

    x is the sum of its leading 27 bits and a rest; both times 10000 are exact in doubles, and so is the sign of the
    difference between what is left after whole units and one half.
    """

    def of(v: Column) -> Column:
        lead = F.floor(v * float(2**27)) / float(2**27)
        k = F.floor(lead * 10000)
        over = (lead * 10000 - k - 0.5) + (v - lead) * 10000
        return bound(F.struct(k.alias("k"), over.alias("over")), lambda r: (r["k"] + ((r["over"] > 0) | ((r["over"] == 0) & (r["k"] % 2 == 1))).cast("int")) / F.lit(10000.0))

    return bound(x, of)


def within(a: Column, b: Column, tolerance: Column) -> Column:
    return F.abs(a - b) <= tolerance


def model_price(model: Column, output: bool) -> Column:
    """Price of a million tokens: of the model named, else of the first listed model of which it is a dated variant."""
    at = int(output)
    chain = None
    for name, price in MODEL_PRICES.items():
        chain = F.when(model == name, price[at]) if chain is None else chain.when(model == name, price[at])
    for name, price in MODEL_PRICES.items():
        chain = chain.when(model.startswith(name + "-"), price[at])
    return chain


def estimated_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """USD for a call; null for models without a price."""
    return (tokens_in * model_price(model, False) + tokens_out * model_price(model, True)) / 1e6
