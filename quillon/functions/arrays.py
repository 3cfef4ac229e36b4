"""Series as arrays: windows, patches, padding, masks and masked losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window(series: Column, start: Column, end: Column) -> Column:
    """The half-open range ``[start, end)``, clamped to the series."""
    first = F.greatest(start, F.lit(0))
    return F.slice(series, first + 1, F.greatest(F.least(end, F.size(series)) - first, F.lit(0)))


def values_text(values: Column, scale: float = 100.0) -> Column:
    """Values times ``scale``, rounded half to even, joined by commas; single precision first."""
    return F.array_join(F.transform(values, lambda x: F.format_string("%.0f", F.rint(x.cast("float").cast("double") * scale))), ", ")


def padded(values: Column, size: Column | int) -> Column:
    """Zeros after the values up to ``size``."""
    n = F.greatest((F.lit(size) if isinstance(size, int) else size) - F.size(values), F.lit(0)).cast("int")
    return F.concat(values, F.array_repeat(F.lit(0.0), n))


def validity(values: Column, size: Column | int) -> Column:
    """True where :func:`padded` holds a value of the series."""
    n = F.greatest((F.lit(size) if isinstance(size, int) else size) - F.size(values), F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(True), F.size(values)), F.array_repeat(F.lit(False), n))


def patches(values: Column, size: int) -> Column:
    """Consecutive patches of ``size`` values, the last one padded with zeros."""
    count = F.ceil(F.size(values) / size).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: padded(F.slice(values, i * size + 1, size), size))


def patch_mask(mask: Column, size: int) -> Column:
    """Whether each patch has any valid step."""
    count = F.ceil(F.size(mask) / size).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.exists(F.slice(mask, i * size + 1, size), lambda x: x))


def masked_mse(actual: Column, predicted: Column, mask: Column) -> Column:
    """Aggregate: mean squared error over rows where ``mask`` holds; null without any."""
    return F.avg(F.when(mask, F.pow(actual - predicted, 2)))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Row loss: log of the summed exponentials minus the label's logit (0-based label)."""
    peak = F.array_max(logits)
    return F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - peak))) + peak - F.get(logits, label)


def hints(token: str, count: Column, enabled: Column) -> Column:
    """A hint token repeated, or nothing where the mode turns it off."""
    return F.when(enabled, F.repeat(F.lit(token), F.greatest(count, F.lit(0)).cast("int"))).otherwise("")
