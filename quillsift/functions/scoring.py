"""Term weights and scores.  Weights are cut from single precision, scores from double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights are in ten-thousandths, scores in thousandths.
WEIGHT_UNIT = 10000


def weight(count: Column, total: Column) -> Column:
    """Share of a term among the terms of its document, in ten-thousandths."""
    share = (count.cast("float") / total.cast("float")).cast("float")
    return F.when(total > 0, (share * F.lit(float(WEIGHT_UNIT)).cast("float")).cast("int")).otherwise(F.lit(0))


def score(weight: Column, allocated: Column, hits: Column) -> Column:
    """Weight times the inverse document frequency: ``allocated`` ids over ``hits`` of the query."""
    idf = F.log10(allocated.cast("double") / hits.cast("double"))
    return F.floor(weight / F.lit(float(WEIGHT_UNIT)) * idf * F.lit(1000.0)).cast("bigint")
