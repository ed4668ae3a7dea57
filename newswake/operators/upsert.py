"""Keyed upserts on plain Parquet: insert, and on a key conflict update the named columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the greatest `order` per key, by an aggregate that combines before the shuffle."""
    values = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), order).alias("r"))
        .select(*keys, "r.*").select(*rows.columns)
    )


def first_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*values), order).alias("r"))
        .select(*keys, "r.*").select(*rows.columns)
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str],
           update_cols: list[str] | None = None) -> DataFrame:
    """`existing` with `incoming` merged in; both have unique keys and the same columns.

    On a conflict the `update_cols` (default: every non-key column) come from `incoming`, null
    values included; the rest keeps its stored value. One full outer join on the keys.
    """
    values = [c for c in existing.columns if c not in keys]
    changed = set(values if update_cols is None else update_cols)
    old = existing.select(*keys, F.struct(*values).alias("_old"))
    new = incoming.select(*keys, F.struct(*values).alias("_new"))
    joined = old.join(new, keys, "full_outer")
    conflict = F.col("_old").isNotNull() & F.col("_new").isNotNull()

    def pick(c: str) -> Column:
        o, n = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        on_conflict = n if c in changed else o
        return F.when(conflict, on_conflict).when(F.col("_new").isNotNull(), n).otherwise(o)

    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in existing.columns])

