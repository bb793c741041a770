"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.operators import features
from cargolens.session import cut
from cargolens.sources.orders import order_items

KEYS = ("order_id", "line_no", "product_id", "store_id")

# Columns the full feature table needs.
FEATURE_INPUTS = (
    *KEYS, "customer_id", "order_date", "shipping_mode", "days_real", "days_scheduled", "late_risk", "order_status",
    "sales", "quantity", "discount_rate", "profit_ratio", "profit", "benefit", "order_item_total",
    "sales_per_customer", "product_price", "product_status", "customer_segment", "order_region", "order_country",
    "market", "customer_country", "order_city", "latitude", "longitude",
)


def items(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return order_items(spark, folder, columns or None)


def written(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """For queries that read their rows several times: the joins run once and the result is written."""
    return cut(items(spark, folder, *columns))


def regional(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return features.add_macro_region(items(spark, folder, "order_region", *columns))


def regional_written(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return features.add_macro_region(written(spark, folder, "order_region", *columns))


def feature_items(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table's rows. Whatever columns are taken of them, all dimensions are joined: keys that repeat or are missing there decide on rows."""
    return items(spark, folder, *FEATURE_INPUTS)


def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return features.build_features(feature_items(spark, folder))


def rule_scores(df: DataFrame) -> DataFrame:
    """Stand-in probabilities by rule of the keys: the operators behind them have exact oracles."""
    c = F.col
    h = ((c("order_id") * 31 + c("product_id") * 17) % 997).cast("double") / 996.0
    return df.withColumns({
        "h": h,
        "p_late": 0.6 * h + 0.4 * c("late_risk"),
        "p_fraud": ((c("order_id") * 7 + c("store_id") * 13) % 1000).cast("double") / 999.0,
        "p_cancel": ((c("product_id") * 11 + c("order_id")) % 500).cast("double") / 499.0,
    })


def scored_items(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return rule_scores(items(spark, folder, *KEYS, "late_risk", *columns))
