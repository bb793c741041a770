"""Order-item schema: one row per order line."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Header names of the order-item CSV file, and the internal names they get.
CSV_COLUMNS = {
    "Type": ("payment_type", T.StringType()),
    "Days for shipping (real)": ("days_real", T.IntegerType()),
    "Days for shipment (scheduled)": ("days_scheduled", T.IntegerType()),
    "Benefit per order": ("benefit", T.DoubleType()),
    "Sales per customer": ("sales_per_customer", T.DoubleType()),
    "Delivery Status": ("delivery_status", T.StringType()),
    "Late_delivery_risk": ("late_risk", T.IntegerType()),
    "Category Id": ("category_id", T.IntegerType()),
    "Category Name": ("category_name", T.StringType()),
    "Customer City": ("customer_city", T.StringType()),
    "Customer Country": ("customer_country", T.StringType()),
    "Customer Email": ("customer_email", T.StringType()),
    "Customer Fname": ("customer_first_name", T.StringType()),
    "Customer Id": ("customer_id", T.LongType()),
    "Customer Lname": ("customer_last_name", T.StringType()),
    "Customer Password": ("customer_password", T.StringType()),
    "Customer Segment": ("customer_segment", T.StringType()),
    "Customer State": ("customer_state", T.StringType()),
    "Customer Street": ("customer_street", T.StringType()),
    "Customer Zipcode": ("customer_zipcode", T.StringType()),
    "Department Id": ("department_id", T.IntegerType()),
    "Department Name": ("department_name", T.StringType()),
    "Latitude": ("latitude", T.DoubleType()),
    "Longitude": ("longitude", T.DoubleType()),
    "Market": ("market", T.StringType()),
    "Order City": ("order_city", T.StringType()),
    "Order Country": ("order_country", T.StringType()),
    "Order Customer Id": ("order_customer_id", T.LongType()),
    "order date (DateOrders)": ("order_date", T.StringType()),
    "Order Id": ("order_id", T.LongType()),
    "Order Item Cardprod Id": ("order_item_product_id", T.LongType()),
    "Order Item Discount": ("order_item_discount", T.DoubleType()),
    "Order Item Discount Rate": ("discount_rate", T.DoubleType()),
    "Order Item Id": ("order_item_id", T.LongType()),
    "Order Item Product Price": ("product_price", T.DoubleType()),
    "Order Item Profit Ratio": ("profit_ratio", T.DoubleType()),
    "Order Item Quantity": ("quantity", T.DoubleType()),
    "Sales": ("sales", T.DoubleType()),
    "Order Item Total": ("order_item_total", T.DoubleType()),
    "Order Profit Per Order": ("profit", T.DoubleType()),
    "Order Region": ("order_region", T.StringType()),
    "Order State": ("order_state", T.StringType()),
    "Order Status": ("order_status", T.StringType()),
    "Order Zipcode": ("order_zipcode", T.StringType()),
    "Product Card Id": ("product_id", T.LongType()),
    "Product Category Id": ("product_category_id", T.LongType()),
    "Product Description": ("product_description", T.StringType()),
    "Product Image": ("product_image", T.StringType()),
    "Product Name": ("product_name", T.StringType()),
    "Product Price": ("list_price", T.DoubleType()),
    "Product Status": ("product_status", T.IntegerType()),
    "shipping date (DateOrders)": ("shipping_date", T.StringType()),
    "Shipping Mode": ("shipping_mode", T.StringType()),
}

DATE_COLUMNS = ["order_date", "shipping_date"]


def present(df: DataFrame, candidates: Iterable[str]) -> list[str]:
    """The candidates that exist in ``df``, in the order given."""
    have = set(df.columns)
    return [c for c in candidates if c in have]
