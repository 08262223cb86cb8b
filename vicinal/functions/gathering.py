"""Ordered arrays from groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_list(value: Column, *keys: Column) -> Column:
    """Aggregate: the values of a group in the order of the keys; null values are left out."""
    entry = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), value.alias("v"))
    return F.transform(F.sort_array(F.collect_list(F.when(value.isNotNull(), entry))), lambda e: e["v"])


def latest(value: Column, *keys: Column) -> Column:
    """Aggregate: the value of the largest keys."""
    return F.max_by(value, F.struct(*keys))


def count_where(test: Column) -> Column:
    return F.count_if(test).cast("long")


def total(value: Column) -> Column:
    """Sum as a long, 0 for none."""
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")
