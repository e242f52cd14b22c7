"""Trait labels: unpivot, 0/1 labels, value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodweave import constants as K

TRAIT_COLS = [c for c, _ in K.TRAITS]
SHORT = dict(K.TRAITS)


def short_trait(col: str = "trait_col"):
    return F.create_map(*[x for c, s in K.TRAITS for x in (F.lit(c), F.lit(s))])[F.col(col)]


def trait_labels(traits: DataFrame, ids: list[str] = ("scene_id", "character")) -> DataFrame:
    """Long table (ids..., trait, flag, label); label is 1 only for a real True."""
    long = traits.unpivot(list(ids), TRAIT_COLS, "trait_col", "flag")
    return long.select(*ids, short_trait().alias("trait"), "flag",
                       F.coalesce(F.col("flag"), F.lit(False)).cast("int").alias("label"))


def trait_value_counts(traits: DataFrame, ordered: bool = False) -> DataFrame:
    """Count of each flag value per trait; nulls are not counted.

    F3: ``ordered`` sorts by (trait, flag) -- once, at the end, on the tiny result.
    """
    long = trait_labels(traits)
    out = long.where(F.col("flag").isNotNull()).groupBy("trait", "flag") \
        .agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy("trait", "flag") if ordered else out


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """the first rows for a look (a limit, never a collect of the table)."""
    return df.limit(n)


def keep_roles(df: DataFrame, roles: list[str], col: str = "character") -> DataFrame:
    """Keep only the listed (main) characters."""
    return df.where(F.col(col).isin(*roles))
