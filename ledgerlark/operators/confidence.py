"""The composite confidence score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WEIGHTS
from ..functions.numbers import bound, clamp, round4


def composite(ocr: Column, ai: Column, validation: Column) -> Column:
    """Struct of composite, components and weights: weights of missing components go to the others in proportion.

    NaN components count as missing. Sums run in the order ocr, ai, validation.
    """
    known = lambda v: F.when(~F.isnan(v), v)
    parts = F.struct(known(ocr).alias("ocr"), known(ai).alias("ai"), known(validation).alias("validation"))

    def weighed(p: Column) -> Column:
        share = [F.when(p[k].isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()]
        terms = [F.coalesce(F.lit(w) * clamp(p[k]), F.lit(0.0)) for k, w in WEIGHTS.items()]
        values = {"sum": terms[0] + terms[1] + terms[2], "total": share[0] + share[1] + share[2]}
        return F.struct(*[c.alias(n) for n, c in values.items()], *[c.alias(f"w_{k}") for k, c in zip(WEIGHTS, share, strict=True)])

    share = lambda v, c: round4(F.coalesce(v[c] / F.nullif(v["total"], F.lit(0.0)), F.lit(0.0)))
    total = bound(parts, weighed)
    # Fields stand side by side, so that a query that takes the composite alone computes nothing else.
    return F.struct(
        bound(total, lambda v: round4(clamp(F.coalesce(v["sum"] / F.nullif(v["total"], F.lit(0.0)), F.lit(0.0))))).alias("composite"),
        *[round4(clamp(known(c))).alias(k) for k, c in zip(WEIGHTS, (ocr, ai, validation), strict=True)],
        bound(total, lambda v: F.struct(*[share(v, f"w_{k}").alias(k) for k in WEIGHTS])).alias("weights"),
    )
