"""Order-item sources: the wide CSV file, its parquet form, and a star schema of base tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.schema import CSV_COLUMNS, DATE_COLUMNS

# Date formats seen in order files, month first.
DATE_FORMATS = ("M/d/yyyy H:mm", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def parse_date(text: Column | str, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """First format that fits; null when none does."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in formats])


def load_orders_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read the Latin-1 CSV with a header; unknown columns are skipped, headers are trimmed.

    The header line alone is read first, to bind names to positions: columns come as strings
    and are cast with the declared types, so no pass over the data infers a schema.
    """
    reader = spark.read.option("header", True).option("encoding", "ISO-8859-1")
    raw = reader.csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    known = [c for c in raw.columns if c in CSV_COLUMNS]
    return parse_dates(raw.select([_typed(c) for c in known]))


def _typed(header: str) -> Column:
    name, kind = CSV_COLUMNS[header]
    c = F.col(f"`{header}`")
    return c.alias(name) if isinstance(kind, T.StringType) else c.try_cast(kind).alias(name)


def load_orders_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_dates(df: DataFrame, columns: Iterable[str] = DATE_COLUMNS) -> DataFrame:
    types = dict(df.dtypes)
    todo = {c: parse_date(c) for c in columns if types.get(c) == "string"}
    return df.withColumns(todo) if todo else df


# --- Star schema -> order items ----------------------------------------------------------


def _mode(p: Column) -> Column:
    return (
        F.when(p == "1-URGENT", "Same Day")
        .when(p == "2-HIGH", "First Class")
        .when(p == "3-MEDIUM", "Second Class")
        .otherwise("Standard Class")
    )


def _scheduled(p: Column) -> Column:
    return F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).when(p == "3-MEDIUM", 2).otherwise(4)


def _status(key: Column, status: Column) -> Column:
    turn = key % 50
    return (
        F.when(turn == 0, "SUSPECTED_FRAUD")
        .when(turn.isin(1, 2), "CANCELED")
        .when(turn == 3, "ON_HOLD")
        .when(status == "F", "COMPLETE")
        .when(status == "O", "PROCESSING")
        .otherwise("PENDING")
    )


def _delivery(real: Column, scheduled: Column, status: Column) -> Column:
    return (
        F.when(status.isin("CANCELED", "SUSPECTED_FRAUD"), "Shipping canceled")
        .when(real > scheduled, "Late delivery")
        .when(real == scheduled, "Shipping on time")
        .otherwise("Advance shipping")
    )


def _definitions() -> dict[str, tuple[Column, frozenset[str]]]:
    """Every order-item column: its expression and the dimension tables it needs."""
    c = F.col
    real = ((c("l_partkey") + c("l_suppkey") + c("l_orderkey")) % 7).cast("int")
    scheduled = _scheduled(c("o_orderpriority"))
    status = _status(c("o_orderkey"), c("o_orderstatus"))
    margin = 0.15 - 2 * c("l_discount")
    plain = {
        "order_id": c("l_orderkey"),
        "line_no": c("l_linenumber"),
        "product_id": c("l_partkey"),
        "store_id": c("l_suppkey"),
        "days_real": real,
        "sales": c("l_extendedprice"),
        "quantity": c("l_quantity"),
        "discount_rate": c("l_discount"),
        "latitude": ((c("l_suppkey") * 37) % 120).cast("double") - 60.0,
        "longitude": ((c("l_suppkey") * 73) % 360).cast("double") - 180.0,
        "profit_ratio": margin,
        "profit": c("l_extendedprice") * margin,
        "benefit": c("l_extendedprice") * margin,
        "order_item_total": c("l_extendedprice") * (1 - c("l_discount")),
        "sales_per_customer": c("l_extendedprice"),
    }
    orders = {
        "customer_id": c("o_custkey"),
        "order_customer_id": c("o_custkey"),
        "order_date": c("o_orderdate"),
        "shipping_mode": _mode(c("o_orderpriority")),
        "days_scheduled": scheduled,
        "order_status": status,
        "late_risk": (real > scheduled).cast("int"),
        "delivery_status": _delivery(real, scheduled, status),
    }
    part = {
        "product_price": c("p_retailprice"),
        "category_name": c("p_type"),
        "product_status": c("p_size") % 2,
    }
    supplier = {
        "order_city": c("s_name"),
    }
    out = {n: (e, frozenset()) for n, e in plain.items()}
    out |= {n: (e, frozenset({"orders"})) for n, e in orders.items()}
    out |= {n: (e, frozenset({"part"})) for n, e in part.items()}
    out |= {n: (e, frozenset({"supplier"})) for n, e in supplier.items()}
    out["customer_segment"] = (c("c_mktsegment"), frozenset({"orders", "customer"}))
    out["order_region"] = (c("cn_name"), frozenset({"orders", "customer", "customer_nation"}))
    out["order_country"] = out["order_region"]
    out["market"] = (c("r_name"), frozenset({"orders", "customer", "customer_nation", "market"}))
    out["customer_country"] = (c("sn_name"), frozenset({"supplier", "supplier_nation"}))
    return out


ORDER_ITEM_COLUMNS = (
    "order_id", "line_no", "product_id", "store_id", "customer_id", "order_customer_id", "order_date",
    "shipping_mode", "days_real", "days_scheduled", "late_risk", "delivery_status", "order_status",
    "sales", "quantity", "discount_rate", "profit_ratio", "profit", "benefit", "order_item_total",
    "sales_per_customer", "product_price", "category_name", "product_status", "customer_segment",
    "order_region", "order_country", "market", "customer_country", "order_city", "latitude", "longitude",
)


def _spread(lines: DataFrame) -> DataFrame:
    """Give every core a share of a small input.

    A file with one row group is read by one task, and broadcast joins would keep all further work in
    that task. Inputs that already come in as many splits as there are cores are left alone.
    """
    cores = lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartition(cores, "l_orderkey") if lines.rdd.getNumPartitions() < cores else lines


def order_items(spark: SparkSession, folder: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Order lines of a star schema (lineitem, orders, customer, part, supplier, nation, region).

    Only dimensions that a requested column needs are joined: the foreign keys are whole, so a
    dimension nobody asks for cannot change the rows. No side is hinted: the planner broadcasts
    a dimension while its size allows it and otherwise shuffles, with skewed keys split at run time.
    """
    wanted = list(columns) if columns is not None else list(ORDER_ITEM_COLUMNS)
    defs = _definitions()
    need = frozenset().union(*[defs[c][1] for c in wanted])

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    # Order lines meet the smaller dimensions first and the orders last, so that the columns of an order, its buyer among
    # them, are not shuffled again; the 25 nations come after, so that their names are not shuffled at all.
    df = _spread(table("lineitem"))
    if "part" in need:
        df = df.join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    if "supplier" in need:
        df = df.join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "orders" in need:
        bought = table("orders")
        if "customer" in need:
            bought = bought.join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        df = df.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    if "customer_nation" in need:
        places = table("nation").select(
            F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("cn_name"),
            F.col("n_regionkey").alias("cn_region"),
        )
        if "market" in need:
            places = places.join(table("region"), F.col("cn_region") == F.col("r_regionkey"))
        df = df.join(places, F.col("c_nationkey") == F.col("cn_key"))
    if "supplier_nation" in need:
        homes = table("nation").select(
            F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("sn_name")
        )
        df = df.join(homes, F.col("s_nationkey") == F.col("sn_key"))
    return df.select([defs[c][0].alias(c) for c in wanted])
