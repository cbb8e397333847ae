"""Learning-rate schedule as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def schedule(step: Column, steps: int, warmup: int) -> Column:
    """Linear warm-up, then a cosine from 1 down to 0.1; 1 throughout without warm-up."""
    if not warmup:
        return F.lit(1.0)
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, steps - warmup))))
    return F.when(step < warmup, (step + 1) / F.lit(float(warmup))).otherwise(F.lit(0.1) + F.lit(0.45) * (F.lit(1.0) + F.cos(F.lit(math.pi) * progress)))
