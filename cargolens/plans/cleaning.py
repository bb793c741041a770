"""Queries for sources, cleaning and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions import columns as X
from cargolens.operators import clean, features, risk
from cargolens.plans.inputs import KEYS, feature_table, items, regional, regional_written, scored_items
from cargolens.plans.registry import query
from cargolens.plans.sql import FEAT, GEO, HAVERSINE, OI, PLANAR, R, SCORED, SEASON, WEATHER
from cargolens.sources.orders import parse_date

K = "order_id, line_no, product_id, store_id"


@query("order_items", f"""
WITH {OI} SELECT {K}, customer_id, shipping_mode, order_status, delivery_status, days_real::BIGINT AS days_real,
 days_scheduled::BIGINT AS days_scheduled, late_risk::BIGINT AS late_risk, {R('sales', 2)} AS sales, quantity,
 {R('profit', 4)} AS profit, category_name, customer_segment, order_region, market, customer_country, order_city,
 latitude, longitude FROM oi""")
def q_order_items(spark, sf):
    df = items(spark, sf)
    return df.select(
        *KEYS, "customer_id", "shipping_mode", "order_status", "delivery_status",
        *[F.col(c).cast("bigint").alias(c) for c in ("days_real", "days_scheduled", "late_risk")],
        X.rnd("sales", 2).alias("sales"), "quantity", X.rnd("profit", 4).alias("profit"), "category_name",
        "customer_segment", "order_region", "market", "customer_country", "order_city", "latitude", "longitude",
    )


@query("load_orders", f"""
WITH {OI} SELECT order_region, count(*) AS rows, {R('sum(sales)', 2)} AS sales, sum(late_risk)::BIGINT AS late,
 CAST(min(order_date) AS DATE)::VARCHAR AS first_day, CAST(max(order_date) AS DATE)::VARCHAR AS last_day FROM oi GROUP BY 1""")
def q_load_orders(spark, sf):
    """The wide file round trip: write the view as Latin-1 CSV with its file headers, read it back typed."""
    import uuid

    from cargolens.schema import CSV_COLUMNS
    from cargolens.session import shared_dir
    from cargolens.sources.orders import load_orders_csv

    names = {name: header for header, (name, _) in CSV_COLUMNS.items()}
    cols = ("order_id", "order_date", "order_region", "sales", "late_risk", "discount_rate", "shipping_mode")
    wide = items(spark, sf, *cols).withColumn("order_date", F.date_format("order_date", "M/d/yyyy H:mm"))
    path = f"{shared_dir(spark).rstrip('/')}/orders-csv-{uuid.uuid4().hex}"
    wide.select([F.col(c).alias(names[c]) for c in cols]).write.option("header", True) \
        .option("encoding", "ISO-8859-1").csv(path)
    back = load_orders_csv(spark, path)
    return back.groupBy("order_region").agg(
        F.count(F.lit(1)).alias("rows"), X.rnd(F.sum("sales"), 2).alias("sales"), F.sum("late_risk").alias("late"),
        F.to_date(F.min("order_date")).cast("string").alias("first_day"),
        F.to_date(F.max("order_date")).cast("string").alias("last_day"),
    )


@query("export_flagged", f"""
WITH {SCORED}, r AS (SELECT order_id, order_region, 0.45::DOUBLE*p_late + 0.35::DOUBLE*p_fraud + 0.20::DOUBLE*p_cancel AS s FROM sc)
SELECT order_region, count(*) AS flagged, {R('max(s)', 4)} AS top_score FROM r WHERE s >= 0.7::DOUBLE GROUP BY 1""")
def q_export_flagged(spark, sf):
    import uuid

    from cargolens.session import shared_dir
    from cargolens.sources.sinks import export_flagged

    path = f"{shared_dir(spark).rstrip('/')}/flagged-{uuid.uuid4().hex}"
    export_flagged(risk.composite_risk(scored_items(spark, sf, "order_region")), path)
    back = spark.read.option("header", True).schema(
        "order_id bigint, order_region string, line_no int, product_id bigint, store_id bigint, late_risk int, h double, "
        "p_late double, p_fraud double, p_cancel double, composite_risk_score double, risk_tier string, requires_review int"
    ).csv(path)
    return back.groupBy("order_region").agg(
        F.count(F.lit(1)).alias("flagged"), X.rnd(F.max("composite_risk_score"), 4).alias("top_score"))


@query("sample_rows")
def q_sample_rows(spark, sf):
    return clean.sample_rows(items(spark, sf, *KEYS, "order_region", "sales"), 5000)


@query("parse_dates", f"""
WITH {OI}, t AS (SELECT {K}, CAST(order_date AS DATE) AS d, order_id % 4 AS style FROM oi)
SELECT {K}, CASE WHEN style = 3 THEN NULL ELSE d::VARCHAR END AS parsed FROM t""")
def q_parse_dates(spark, sf):
    """Dates rewritten as text in three styles and one unreadable one, then parsed back."""
    df = items(spark, sf, *KEYS, "order_date")
    style = F.col("order_id") % 4
    text = (
        F.when(style == 0, F.date_format("order_date", "M/d/yyyy H:mm"))
        .when(style == 1, F.date_format("order_date", "yyyy-MM-dd HH:mm:ss"))
        .when(style == 2, F.date_format("order_date", "M/d/yyyy"))
        .otherwise(F.lit("not a date"))
    )
    return df.select(*KEYS, F.to_date(parse_date(text)).cast("string").alias("parsed"))


@query("dedup_rows", f"WITH {OI} SELECT DISTINCT order_id, line_no, shipping_mode, order_region FROM oi")
def q_dedup(spark, sf):
    return clean.dedup_rows(items(spark, sf, "order_id", "line_no", "shipping_mode", "order_region"))


HOLES = f"""holes AS (SELECT {K}, CASE WHEN order_id % 97 = 0 THEN NULL ELSE sales END AS sales,
 CASE WHEN order_id % 89 = 0 THEN NULL ELSE quantity END AS quantity,
 CASE WHEN order_id % 83 = 0 THEN NULL ELSE category_name END AS category_name,
 CASE WHEN order_id % 79 = 0 THEN NULL ELSE customer_segment END AS customer_segment, order_date, macro_region FROM oi)"""


def holes(spark, sf):
    """Order items with nulls put in by key rules."""
    df = regional_written(spark, sf, *KEYS, "sales", "quantity", "category_name", "customer_segment", "order_date")
    rules = {"sales": 97, "quantity": 89, "category_name": 83, "customer_segment": 79}
    return df.withColumns({c: F.when(F.col("order_id") % m != 0, F.col(c)) for c, m in rules.items()}).drop("order_region")


@query("impute_numeric_median", f"""
WITH {OI}, {HOLES}, m AS (SELECT median(sales) AS ms, median(quantity) AS mq FROM holes)
SELECT {K}, {R('coalesce(sales, ms)', 4)} AS sales, {R('coalesce(quantity, mq)', 4)} AS quantity FROM holes, m""")
def q_impute_median(spark, sf):
    out = clean.impute_numeric_median(holes(spark, sf), ["sales", "quantity"])
    return out.select(*KEYS, X.rnd("sales", 4).alias("sales"), X.rnd("quantity", 4).alias("quantity"))


@query("impute_categorical_mode", f"""
WITH {OI}, {HOLES},
mc AS (SELECT category_name AS v FROM holes WHERE category_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
ms AS (SELECT customer_segment AS v FROM holes WHERE customer_segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT {K}, coalesce(category_name, mc.v) AS category_name, coalesce(customer_segment, ms.v) AS customer_segment FROM holes, mc, ms""")
def q_impute_mode(spark, sf):
    return clean.impute_categorical_mode(holes(spark, sf), ["category_name", "customer_segment"]).select(
        *KEYS, "category_name", "customer_segment")


@query("null_census", f"""
WITH {OI}, {HOLES} SELECT count(*) AS rows, 10::BIGINT AS columns,
 (count(*)*10 - count(order_id)-count(line_no)-count(product_id)-count(store_id)-count(sales)-count(quantity)-count(category_name)
  -count(customer_segment)-count(order_date)-count(macro_region))::BIGINT AS nulls, count(DISTINCT macro_region) AS regions,
 CAST(min(order_date) AS DATE)::VARCHAR AS first_date, CAST(max(order_date) AS DATE)::VARCHAR AS last_date FROM holes""")
def q_null_census(spark, sf):
    out = clean.null_census(holes(spark, sf))
    return out.select(
        "rows", F.col("columns").cast("bigint").alias("columns"), F.col("nulls").cast("bigint").alias("nulls"), "regions",
        *[F.to_date(c).cast("string").alias(c) for c in ("first_date", "last_date")])


@query("drop_incomplete", f"""
WITH {OI}, {HOLES} SELECT {K}, {R('sales', 2)} AS sales, category_name FROM holes
WHERE sales IS NOT NULL AND quantity IS NOT NULL AND category_name IS NOT NULL""")
def q_drop_incomplete(spark, sf):
    out = clean.drop_incomplete(holes(spark, sf), ["sales", "quantity", "category_name", "no_such_column"])
    return out.select(*KEYS, X.rnd("sales", 2).alias("sales"), "category_name")


@query("project_present", f"WITH {OI} SELECT {K}, shipping_mode, quantity FROM oi")
def q_project_present(spark, sf):
    return clean.project_present(items(spark, sf, *KEYS, "shipping_mode", "quantity", "sales"),
                                 [*KEYS, "shipping_mode", "no_such_column", "quantity"])


@query("trim_region", f"WITH {OI} SELECT trim('  ' || order_region || ' ') AS macro_region, count(*) AS n FROM oi GROUP BY 1")
def q_trim_region(spark, sf):
    padded = items(spark, sf, "order_region").withColumn("order_region", F.concat(F.lit("  "), "order_region", F.lit(" ")))
    return features.add_macro_region(padded).groupBy("macro_region").agg(F.count(F.lit(1)).alias("n"))


@query("cross_border", f"""
WITH {OI} SELECT order_country, customer_country, CASE WHEN customer_country <> order_country THEN 1 ELSE 0 END AS is_cross_border,
 count(*) AS n FROM oi GROUP BY 1, 2, 3""")
def q_cross_border(spark, sf):
    return features.add_cross_border(items(spark, sf, "order_country", "customer_country")).groupBy(
        "order_country", "customer_country", "is_cross_border").agg(F.count(F.lit(1)).alias("n"))


@query("status_labels", f"""
WITH {OI} SELECT order_status, (order_status = 'SUSPECTED_FRAUD')::INT AS fraud, (order_status IN ('CANCELED','ON_HOLD'))::INT AS cancel,
 count(*) AS n FROM oi GROUP BY 1""")
def q_status_labels(spark, sf):
    return items(spark, sf, "order_status").groupBy(
        "order_status", X.fraud_flag().alias("fraud"), X.cancel_flag().alias("cancel")).agg(F.count(F.lit(1)).alias("n"))


@query("query_filter", f"WITH {OI} SELECT {K}, {R('sales', 2)} AS sales FROM oi WHERE market = 'ASIA' AND sales > 200")
def q_query_filter(spark, sf):
    out = clean.query_filter(items(spark, sf, *KEYS, "market", "sales"), "market = 'ASIA' and sales > 200")
    return out.select(*KEYS, X.rnd("sales", 2).alias("sales"))


@query("override_columns", f"""
WITH {OI} SELECT 'First Class' AS shipping_mode, order_region, 0.0::DOUBLE AS discount_rate, count(*) AS n FROM oi GROUP BY order_region""")
def q_override(spark, sf):
    out = clean.override_columns(items(spark, sf, "shipping_mode", "order_region", "discount_rate"),
                                 {"shipping_mode": "First Class", "discount_rate": 0.0})
    return out.groupBy("shipping_mode", "order_region", "discount_rate").agg(F.count(F.lit(1)).alias("n"))


@query("reindex_features", f"WITH {OI} SELECT {K}, quantity, 0.0::DOUBLE AS season_Winter, {R('discount_rate', 4)} AS discount_rate FROM oi")
def q_reindex(spark, sf):
    out = clean.reindex_features(items(spark, sf, *KEYS, "discount_rate", "sales", "quantity"),
                                 [*KEYS, "quantity", "season_Winter", "discount_rate"])
    return out.withColumn("discount_rate", X.rnd("discount_rate", 4))


# --- Scalar functions --------------------------------------------------------------------


@query("haversine_km", f"""
WITH {OI}, t AS (SELECT {K}, CASE WHEN order_id % 101 = 0 THEN NULL ELSE latitude END AS latitude, longitude,
 10.0::DOUBLE AS dest_lat, 20.0::DOUBLE AS dest_lon FROM oi) SELECT {K}, {R(HAVERSINE, 5)} AS km FROM t""")
def q_haversine(spark, sf):
    df = items(spark, sf, *KEYS, "latitude", "longitude")
    df = df.withColumn("latitude", F.when(F.col("order_id") % 101 != 0, F.col("latitude")))
    return df.select(*KEYS, X.rnd(X.haversine_km("latitude", "longitude", F.lit(10.0), F.lit(20.0)), 5).alias("km"))


@query("dest_centroid", f"""
WITH {GEO} SELECT {K}, {R('dest_lat')} AS dest_lat, {R('dest_lon')} AS dest_lon, {R('shipping_distance_km', 4)} AS shipping_distance_km FROM geo""")
def q_dest_centroid(spark, sf):
    out = features.add_distance(items(spark, sf, *KEYS, "order_country", "latitude", "longitude"))
    return out.select(*KEYS, X.rnd("dest_lat", 6).alias("dest_lat"), X.rnd("dest_lon", 6).alias("dest_lon"),
                      X.rnd("shipping_distance_km", 4).alias("shipping_distance_km"))


@query("planar_distance_km", f"WITH {PLANAR} SELECT {K}, {R('planar_distance_km', 5)} AS planar_distance_km FROM pl")
def q_planar(spark, sf):
    out = features.add_planar_distance(items(spark, sf, *KEYS, "latitude", "longitude"))
    return out.select(*KEYS, X.rnd("planar_distance_km", 5).alias("planar_distance_km"))


@query("calendar_features", f"""
WITH {OI} SELECT {K}, month(order_date)::INT AS order_month, year(order_date)::INT AS order_year, (isodow(order_date)-1)::INT AS order_dayofweek,
 quarter(order_date)::INT AS order_quarter, (isodow(order_date)>=6)::INT AS is_weekend,
 (last_day(CAST(order_date AS DATE)) = CAST(order_date AS DATE))::INT AS is_month_end FROM oi""")
def q_calendar(spark, sf):
    return features.add_calendar(items(spark, sf, *KEYS, "order_date")).select(
        *KEYS, "order_month", "order_year", "order_dayofweek", "order_quarter", "is_weekend", "is_month_end")


def _by_month(spark, sf, **exprs):
    month = items(spark, sf, "order_date").select(F.month("order_date").alias("order_month"))
    return month.groupBy("order_month").agg(F.count(F.lit(1)).alias("n")).withColumns(exprs)


@query("season", f"WITH {OI} SELECT month(order_date)::INT AS order_month, {SEASON} AS season, count(*) AS n FROM oi GROUP BY 1, 2")
def q_season(spark, sf):
    return _by_month(spark, sf, season=X.season("order_month"))


@query("weather_risk", f"WITH {OI} SELECT month(order_date)::INT AS order_month, ({WEATHER})::DOUBLE AS weather_risk, count(*) AS n FROM oi GROUP BY 1, 2")
def q_weather(spark, sf):
    return _by_month(spark, sf, weather_risk=X.weather_risk("order_month"))


@query("holiday_flag", f"WITH {OI} SELECT month(order_date)::INT AS order_month, (month(order_date) IN (11,12))::INT AS holiday_flag, count(*) AS n FROM oi GROUP BY 1, 2")
def q_holiday(spark, sf):
    return _by_month(spark, sf, holiday_flag=X.holiday_flag("order_month"))


@query("hemisphere_season", f"""
WITH {OI}, t AS (SELECT month(order_date)::INT AS order_month, latitude < 0 AS south, {SEASON} AS s FROM oi)
SELECT order_month, south::INT AS south, CASE WHEN NOT south THEN s WHEN s='Winter' THEN 'Summer' WHEN s='Summer' THEN 'Winter'
 WHEN s='Spring' THEN 'Fall' ELSE 'Spring' END AS season, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def q_hemisphere(spark, sf):
    df = items(spark, sf, "order_date", "latitude")
    return df.select(
        F.month("order_date").alias("order_month"), (F.col("latitude") < 0).cast("int").alias("south"),
        X.hemisphere_season(F.month("order_date"), "latitude").alias("season"),
    ).groupBy("order_month", "south", "season").agg(F.count(F.lit(1)).alias("n"))


@query("us_macro_region", f"""
WITH {OI}, t AS (SELECT CASE order_id % 3 WHEN 0 THEN 'EE. UU.' WHEN 1 THEN 'Puerto Rico' ELSE order_country END AS country,
 CASE product_id % 4 WHEN 0 THEN 'ca' WHEN 1 THEN ' IL' WHEN 2 THEN 'TX' ELSE 'ZZ' END AS state FROM oi)
SELECT country, state, CASE country WHEN 'Puerto Rico' THEN 'Caribbean' WHEN 'EE. UU.' THEN
 CASE state WHEN 'ca' THEN 'West' WHEN ' IL' THEN 'Midwest' WHEN 'TX' THEN 'South' END END AS us_region, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def q_us_region(spark, sf):
    df = items(spark, sf, "order_id", "product_id", "order_country")
    turn, kind = F.col("order_id") % 3, F.col("product_id") % 4
    country = F.when(turn == 0, "EE. UU.").when(turn == 1, "Puerto Rico").otherwise(F.col("order_country"))
    state = F.when(kind == 0, "ca").when(kind == 1, " IL").when(kind == 2, "TX").otherwise("ZZ")
    return df.select(country.alias("country"), state.alias("state")).groupBy("country", "state").agg(
        F.count(F.lit(1)).alias("n")).withColumn("us_region", X.us_macro_region("country", "state"))


@query("shipping_cost_lookup", f"""
WITH {OI}, t AS (SELECT CASE WHEN order_id % 11 = 0 THEN 'Drone' ELSE shipping_mode END AS shipping_mode FROM oi)
SELECT shipping_mode, (CASE shipping_mode WHEN 'Same Day' THEN 12 WHEN 'First Class' THEN 5 WHEN 'Second Class' THEN 2 ELSE 0 END)::DOUBLE AS whatif_cost,
 (CASE shipping_mode WHEN 'Same Day' THEN 18 WHEN 'First Class' THEN 7.5 WHEN 'Second Class' THEN 2.5 ELSE 0 END)::DOUBLE AS tradeoff_cost,
 count(*) AS n FROM t GROUP BY 1""")
def q_cost_lookup(spark, sf):
    df = items(spark, sf, "order_id", "shipping_mode")
    mode = F.when(F.col("order_id") % 11 == 0, "Drone").otherwise(F.col("shipping_mode"))
    return df.groupBy(mode.alias("shipping_mode")).agg(F.count(F.lit(1)).alias("n")).withColumns({
        "whatif_cost": X.lookup("shipping_mode", X.WHATIF_MODE_COST, 0.0),
        "tradeoff_cost": X.lookup("shipping_mode", X.TRADEOFF_MODE_COST, 0.0)})


RENAMED = """CASE market WHEN 'AFRICA' THEN 'West Africa' WHEN 'AMERICA' THEN 'LATAM' WHEN 'ASIA' THEN 'Pacific Asia'
 WHEN 'EUROPE' THEN 'western europe' ELSE market END"""


@query("emission_factor", f"""
WITH {OI}, t AS (SELECT {RENAMED} AS market, order_region FROM oi)
SELECT market, order_region, (CASE market WHEN 'West Africa' THEN 0.30 WHEN 'LATAM' THEN 0.20 WHEN 'Pacific Asia' THEN 0.20
 WHEN 'western europe' THEN 0.12 ELSE 0.20 END)::DOUBLE AS factor, count(*) AS n FROM t GROUP BY 1, 2""")
def q_emission(spark, sf):
    m = F.col("market")
    name = F.when(m == "AFRICA", "West Africa").when(m == "AMERICA", "LATAM").when(m == "ASIA", "Pacific Asia") \
        .when(m == "EUROPE", "western europe").otherwise(m)
    return items(spark, sf, "market", "order_region").withColumn("market", name).groupBy("market", "order_region").agg(
        F.count(F.lit(1)).alias("n")).withColumn("factor", X.emission_factor("market", "order_region"))


@query("mode_multiplier", f"""
WITH {OI} SELECT shipping_mode, (CASE shipping_mode WHEN 'Same Day' THEN 3.5 WHEN 'First Class' THEN 2.0 WHEN 'Second Class' THEN 1.2 ELSE 1.0 END)::DOUBLE
 AS multiplier, count(*) AS n FROM oi GROUP BY 1""")
def q_multiplier(spark, sf):
    return items(spark, sf, "shipping_mode").groupBy("shipping_mode").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "multiplier", X.lookup("shipping_mode", X.MODE_EMISSION_MULTIPLIER, 1.0))


@query("cut_tiers", f"""
WITH {SCORED}, t AS (SELECT {K}, CAST((order_id + product_id) % 11 AS DOUBLE)/10.0::DOUBLE AS s FROM sc)
SELECT {K}, s, CASE WHEN s <= 0.3 THEN 'Low' WHEN s <= 0.5 THEN 'Medium' WHEN s <= 0.7 THEN 'High' ELSE 'Critical' END AS risk_tier,
 CASE WHEN s <= 0 THEN NULL WHEN s <= 0.3 THEN 'Low' WHEN s <= 0.6 THEN 'Medium' WHEN s <= 0.8 THEN 'High' ELSE 'Critical' END AS fraud_tier,
 CASE WHEN s <= 0.4 THEN 'Fragile' WHEN s <= 0.6 THEN 'Vulnerable' WHEN s <= 0.8 THEN 'Stable' ELSE 'Resilient' END AS resilience_tier FROM t""")
def q_cut_tiers(spark, sf):
    df = items(spark, sf, *KEYS)
    s = ((F.col("order_id") + F.col("product_id")) % 11).cast("double") / 10.0
    return df.withColumn("s", s).select(
        *KEYS, "s", X.cut_tiers("s", *X.RISK_TIERS, include_lowest=True).alias("risk_tier"),
        X.cut_tiers("s", *X.FRAUD_TIERS, include_lowest=False).alias("fraud_tier"),
        X.cut_tiers("s", *X.RESILIENCE_TIERS, include_lowest=True).alias("resilience_tier"))


@query("one_hot_drop_first", f"""
WITH {OI} SELECT shipping_mode, (shipping_mode='Same Day')::INT AS shipping_mode_Same_Day, (shipping_mode='Second Class')::INT AS shipping_mode_Second_Class,
 (shipping_mode='Standard Class')::INT AS shipping_mode_Standard_Class, count(*) AS n FROM oi GROUP BY 1""")
def q_one_hot(spark, sf):
    out, names, _ = features.one_hot_drop_first(items(spark, sf, "shipping_mode"), ["shipping_mode"])
    return out.groupBy("shipping_mode", *names).agg(F.count(F.lit(1)).alias("n"))


@query("label_codes", f"""
WITH {OI} SELECT order_region, market, customer_segment, (dense_rank() OVER (ORDER BY order_region)-1)::INT AS order_region_code,
 (dense_rank() OVER (ORDER BY market)-1)::INT AS market_code, (dense_rank() OVER (ORDER BY customer_segment)-1)::INT AS customer_segment_code, n
 FROM (SELECT order_region, market, customer_segment, count(*) AS n FROM oi GROUP BY 1, 2, 3)""")
def q_label_codes(spark, sf):
    cols = ["order_region", "market", "customer_segment"]
    out = features.add_label_codes(items(spark, sf, *cols), cols)
    return out.groupBy(*cols, *[f"{c}_code" for c in cols]).agg(F.count(F.lit(1)).alias("n"))


@query("standard_scale", f"""
WITH {OI}, m AS (SELECT avg(sales) AS a, stddev_pop(sales) AS b, avg(quantity) AS c, stddev_pop(quantity) AS d FROM oi)
SELECT {K}, {R('(sales-a)/b')} AS sales_z, {R('(quantity-c)/d')} AS quantity_z FROM oi, m""")
def q_standard_scale(spark, sf):
    out = features.standard_scale(items(spark, sf, *KEYS, "sales", "quantity"), ["sales", "quantity"])
    return out.select(*KEYS, X.rnd("sales_z", 6).alias("sales_z"), X.rnd("quantity_z", 6).alias("quantity_z"))


@query("minmax_scale", f"""
WITH {OI}, m AS (SELECT min(sales) AS a, max(sales) AS b FROM oi)
SELECT {K}, {R('(sales-a)/(b-a)')} AS sales_scaled, 0.5::DOUBLE AS same_scaled FROM oi, m""")
def q_minmax_scale(spark, sf):
    df = items(spark, sf, *KEYS, "sales").withColumn("same", F.lit(3.0))
    out = features.minmax_scale(df, ["sales", "same"])
    return out.select(*KEYS, X.rnd("sales_scaled", 6).alias("sales_scaled"), "same_scaled")


@query("clip_round", f"""
WITH {OI} SELECT {K}, greatest(profit, 0) AS floor_profit, round_even(CAST(quantity AS DOUBLE)/2, 0) AS half_even FROM oi""")
def q_clip_round(spark, sf):
    df = items(spark, sf, *KEYS, "profit", "quantity")
    return df.select(*KEYS, F.greatest(F.col("profit"), F.lit(0.0)).alias("floor_profit"),
                     F.bround(F.col("quantity") / 2, 0).alias("half_even"))


@query("regional_merge", f"""
WITH {FEAT} SELECT {K}, {R('region_late_rate')} AS region_late_rate, {R('region_avg_days')} AS region_avg_days, {R('region_std_days')} AS region_std_days,
 {R('region_avg_order_value', 4)} AS region_avg_order_value, region_total_orders FROM feat""")
def q_regional_merge(spark, sf):
    df = regional(spark, sf, *KEYS, "late_risk", "days_real", "sales", "discount_rate")
    out = features.add_regional(df)
    return out.select(*KEYS, *[X.rnd(c, 6).alias(c) for c in ("region_late_rate", "region_avg_days", "region_std_days")],
                      X.rnd("region_avg_order_value", 4).alias("region_avg_order_value"), "region_total_orders")


@query("feature_table", f"""
WITH {FEAT} SELECT {K}, {R('shipping_distance_km', 4)} AS shipping_distance_km, season, weather_risk, holiday_flag, is_weekend,
 {R('region_late_rate')} AS region_late_rate, {R('region_avg_discount')} AS region_avg_discount FROM feat""")
def q_feature_table(spark, sf):
    """The whole feature pipeline in one plan."""
    out = feature_table(spark, sf)
    return out.select(*KEYS, X.rnd("shipping_distance_km", 4).alias("shipping_distance_km"), "season", "weather_risk",
                      "holiday_flag", "is_weekend", X.rnd("region_late_rate", 6).alias("region_late_rate"),
                      X.rnd("region_avg_discount", 6).alias("region_avg_discount"))


@query("map_join", f"""
WITH {OI}, r AS (SELECT order_region, avg((order_status IN ('CANCELED','ON_HOLD'))::INT) AS rate FROM oi WHERE order_region <> 'NATION_3' GROUP BY 1),
j AS (SELECT oi.order_region, rate FROM oi LEFT JOIN r USING (order_region)), f AS (SELECT avg(rate) AS fb FROM j)
SELECT order_region, {R('coalesce(rate, fb)')} AS regional_cancel_rate, count(*) AS n FROM j, f GROUP BY 1, 2""")
def q_map_join(spark, sf):
    from cargolens.operators.aggregate import regional_cancel_rate

    df = items(spark, sf, "order_region", "order_status")
    rates = regional_cancel_rate(df.where("order_region <> 'NATION_3'"))
    out = risk.map_cancel_rate(df, rates)
    return out.groupBy("order_region", X.rnd("regional_cancel_rate", 6).alias("regional_cancel_rate")).agg(
        F.count(F.lit(1)).alias("n"))


