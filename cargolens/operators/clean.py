"""Cleaning, projection and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.operators.scale import dominant_values, exact_quantiles
from cargolens.schema import present
from cargolens.sources.orders import parse_dates

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def dedup_rows(df: DataFrame) -> DataFrame:
    """Drop fully duplicate rows. Copies collapse before the shuffle."""
    return df.dropDuplicates()


def columns_of(df: DataFrame, kinds: Sequence[str]) -> list[str]:
    return [c for c, t in df.dtypes if t in kinds]


def nullable_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that really hold nulls, found in one pass."""
    if not columns:
        return []
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] > 0]


def numeric_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians; a column without any value has none."""
    if not columns:
        return {}
    rows = exact_quantiles(df, columns, {"median": 0.5}).collect()  # one row per column
    return {r["column"]: r["median"] for r in rows if r["median"] is not None}


def categorical_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    if not columns:
        return {}
    row = dominant_values(df, columns).first()
    return {} if row is None else {c: v for c, v in row.asDict().items() if v is not None}


def impute_numeric_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls with the exact median. An all-null column keeps its nulls."""
    todo = nullable_columns(df, columns or columns_of(df, NUMERIC))
    types = dict(df.dtypes)
    fills = {}
    for c, m in numeric_medians(df, todo).items():
        # An integer column whose median falls between two integers becomes a double, as a mean would.
        kind = types[c] if types[c] in ("float", "double") or m == int(m) else "double"
        fills[c] = F.coalesce(F.col(c).cast(kind), F.lit(m).cast(kind))
    return df.withColumns(fills) if fills else df


def impute_categorical_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls with the most frequent value, the smallest on a tie."""
    todo = nullable_columns(df, columns or columns_of(df, ("string",)))
    fills = categorical_modes(df, todo)
    return df.fillna(fills) if fills else df


def clean(df: DataFrame) -> DataFrame:
    """Dates, duplicates, missing numbers, missing texts: in that order."""
    return impute_categorical_mode(impute_numeric_median(dedup_rows(parse_dates(df))))


def null_census(df: DataFrame, region: str = "macro_region", date: str = "order_date") -> DataFrame:
    """One row: rows, columns, remaining nulls, regions and date range."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    aggs = [F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), nulls.alias("nulls")]
    if region in df.columns:
        aggs.append(F.count_distinct(region).alias("regions"))
    if date in df.columns:
        aggs += [F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    return df.agg(*aggs)


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=present(df, columns))


def project_present(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    return df.select(*present(df, candidates))


def query_filter(df: DataFrame, condition: str) -> DataFrame:
    """Rows matching a Spark SQL predicate."""
    return df.where(F.expr(condition))


def override_columns(df: DataFrame, values: Mapping) -> DataFrame:
    """Set columns to constants."""
    return df.withColumns({c: F.lit(v) for c, v in values.items()})


def reindex_features(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exactly the expected columns, in order; an absent column is 0."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(0.0).alias(c) for c in expected])


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A fixed random sample of ``n`` rows, the same for every partitioning.

    Only the ``n`` smallest row hashes of each task travel to the final merge. For a sample that
    is large itself use ``df.sample``.
    """
    from cargolens.operators.scale import row_hash

    return df.withColumn("_h", row_hash(df, seed)).orderBy("_h").limit(n).drop("_h")
