"""Set algebra over frames of equal columns, rows being members."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).union(b.subtract(a))


def is_subset(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty()


def is_superset(a: DataFrame, b: DataFrame) -> bool:
    return is_subset(b, a)


def is_disjoint(a: DataFrame, b: DataFrame) -> bool:
    return a.intersect(b).isEmpty()
