"""SQL building blocks of the oracles: the order-item view and its features."""

from __future__ import annotations


def R(expr: str, places: int = 6) -> str:
    """The rounding of ``functions.columns.rnd``."""
    return f"(round(({expr}) + {0.00123 * 10.0 ** -places:.18f}::DOUBLE, {places}) + 0.0)"


OI = """
base AS (
 SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, l.l_partkey AS product_id, l.l_suppkey AS store_id,
  o.o_custkey AS customer_id, o.o_orderdate AS order_date,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Same Day' WHEN '2-HIGH' THEN 'First Class'
       WHEN '3-MEDIUM' THEN 'Second Class' ELSE 'Standard Class' END AS shipping_mode,
  (l.l_partkey + l.l_suppkey + l.l_orderkey) % 7 AS days_real,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 4 END AS days_scheduled,
  CASE WHEN o.o_orderkey % 50 = 0 THEN 'SUSPECTED_FRAUD' WHEN o.o_orderkey % 50 IN (1,2) THEN 'CANCELED'
       WHEN o.o_orderkey % 50 = 3 THEN 'ON_HOLD' WHEN o.o_orderstatus='F' THEN 'COMPLETE'
       WHEN o.o_orderstatus='O' THEN 'PROCESSING' ELSE 'PENDING' END AS order_status,
  l.l_extendedprice AS sales, l.l_quantity AS quantity, l.l_discount AS discount_rate,
  0.15 - 2*l.l_discount AS profit_ratio, l.l_extendedprice*(0.15 - 2*l.l_discount) AS profit,
  p.p_retailprice AS product_price, p.p_type AS category_name, p.p_size % 2 AS product_status,
  c.c_mktsegment AS customer_segment, cn.n_name AS order_region, cn.n_name AS order_country, cr.r_name AS market,
  sn.n_name AS customer_country, s.s_name AS order_city,
  CAST((s.s_suppkey*37) % 120 AS DOUBLE) - 60.0 AS latitude, CAST((s.s_suppkey*73) % 360 AS DOUBLE) - 180.0 AS longitude
 FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey JOIN customer c ON o.o_custkey=c.c_custkey
 JOIN nation cn ON c.c_nationkey=cn.n_nationkey JOIN region cr ON cn.n_regionkey=cr.r_regionkey
 JOIN part p ON l.l_partkey=p.p_partkey JOIN supplier s ON l.l_suppkey=s.s_suppkey JOIN nation sn ON s.s_nationkey=sn.n_nationkey),
oi AS (SELECT *, CASE WHEN days_real > days_scheduled THEN 1 ELSE 0 END AS late_risk, order_region AS macro_region,
  sales*(1-discount_rate) AS order_item_total, profit AS benefit,
  CASE WHEN order_status IN ('CANCELED','SUSPECTED_FRAUD') THEN 'Shipping canceled'
       WHEN days_real > days_scheduled THEN 'Late delivery'
       WHEN days_real = days_scheduled THEN 'Shipping on time' ELSE 'Advance shipping' END AS delivery_status
  FROM base)"""

HAVERSINE = """CASE WHEN latitude IS NULL OR longitude IS NULL THEN 0.0 ELSE
  2*6371.0*asin(sqrt(least(1.0::DOUBLE, sin(radians(dest_lat-latitude)/2)*sin(radians(dest_lat-latitude)/2)
  + cos(radians(latitude))*cos(radians(dest_lat))*sin(radians(dest_lon-longitude)/2)*sin(radians(dest_lon-longitude)/2)))) END"""

SEASON = """CASE WHEN month(order_date) IN (12,1,2) THEN 'Winter' WHEN month(order_date) IN (3,4,5) THEN 'Spring'
  WHEN month(order_date) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END"""

WEATHER = """CASE month(order_date) WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 WHEN 4 THEN 0.3 WHEN 5 THEN 0.2
  WHEN 6 THEN 0.3 WHEN 7 THEN 0.2 WHEN 8 THEN 0.3 WHEN 9 THEN 0.5 WHEN 10 THEN 0.6 WHEN 11 THEN 0.7 WHEN 12 THEN 0.8
  ELSE 0.5 END"""

GEO = OI + f""",
cen AS (SELECT order_country, avg(latitude) AS dest_lat, avg(longitude) AS dest_lon FROM oi GROUP BY 1),
geo AS (SELECT oi.*, dest_lat, dest_lon, {HAVERSINE} AS shipping_distance_km FROM oi JOIN cen USING (order_country))"""

REG = """,
reg AS (SELECT macro_region, avg(late_risk) AS region_late_rate, avg(days_real) AS region_avg_days,
  stddev_samp(days_real) AS region_std_days, avg(sales) AS region_avg_order_value, sum(sales) AS region_total_sales,
  count(sales) AS region_total_orders, avg(discount_rate) AS region_avg_discount FROM oi GROUP BY 1)"""

FEAT = GEO + REG + f""",
feat AS (SELECT geo.*, region_late_rate, region_avg_days, region_std_days, region_avg_order_value, region_total_sales,
  region_total_orders, region_avg_discount, month(order_date) AS order_month, {SEASON} AS season,
  CAST({WEATHER} AS DOUBLE) AS weather_risk, CASE WHEN month(order_date) IN (11,12) THEN 1 ELSE 0 END AS holiday_flag,
  CASE WHEN isodow(order_date) >= 6 THEN 1 ELSE 0 END AS is_weekend
  FROM geo JOIN reg USING (macro_region))"""

PLANAR = OI + """,
mid AS (SELECT avg(latitude) AS lat0, avg(longitude) AS lon0 FROM oi),
pl AS (SELECT oi.*, sqrt((latitude-lat0)*(latitude-lat0)+(longitude-lon0)*(longitude-lon0))*111.0 AS planar_distance_km FROM oi, mid)"""

# Deterministic stand-in scores by rule of the keys, so that curves and costs have exact oracles.
SCORED = OI + """,
sc AS (SELECT *, CAST((order_id*31 + product_id*17) % 997 AS DOUBLE)/996.0 AS h,
  0.6::DOUBLE*(CAST((order_id*31 + product_id*17) % 997 AS DOUBLE)/996.0::DOUBLE) + 0.4::DOUBLE*late_risk AS p_late,
  CAST((order_id*7 + store_id*13) % 1000 AS DOUBLE)/999.0::DOUBLE AS p_fraud,
  CAST((product_id*11 + order_id) % 500 AS DOUBLE)/499.0::DOUBLE AS p_cancel FROM oi)"""

PANEL = OI + """,
panel AS (SELECT macro_region, CAST(order_date AS DATE) AS date, sum(sales) AS sales, sum(quantity) AS quantity,
  avg(late_risk) AS late_risk, count(DISTINCT customer_id) AS unique_customers FROM oi GROUP BY 1, 2)"""
