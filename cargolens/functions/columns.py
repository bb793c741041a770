"""Scalar column expressions. All of them stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ------------------------------------------------------------------------

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.0

WEATHER_RISK = {
    1: 0.9, 2: 0.7, 3: 0.5, 4: 0.3, 5: 0.2, 6: 0.3,
    7: 0.2, 8: 0.3, 9: 0.5, 10: 0.6, 11: 0.7, 12: 0.8,
}
WEATHER_RISK_DEFAULT = 0.5

HOLIDAY_MONTHS = (11, 12)

SEASON_OF_MONTH = {
    1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring", 6: "Summer",
    7: "Summer", 8: "Summer", 9: "Fall", 10: "Fall", 11: "Fall", 12: "Winter",
}
OPPOSITE_SEASON = {"Winter": "Summer", "Spring": "Fall", "Summer": "Winter", "Fall": "Spring"}

# Extra cost per order of a mode: used for what-if scenarios and for the trade-off tables.
WHATIF_MODE_COST = {"Standard Class": 0.0, "Second Class": 2.0, "First Class": 5.0, "Same Day": 12.0}
TRADEOFF_MODE_COST = {"Standard Class": 0.0, "Second Class": 2.5, "First Class": 7.5, "Same Day": 18.0}

# kg CO2 per km by region name; the first name contained in the text wins.
EMISSION_FACTOR = {
    "Western Europe": 0.12,
    "Eastern Europe": 0.18,
    "North America": 0.15,
    "USCA": 0.15,
    "Southeast Asia": 0.22,
    "South Asia": 0.25,
    "West Africa": 0.30,
    "Central Africa": 0.30,
    "East Africa": 0.28,
    "Southern Africa": 0.26,
    "LATAM": 0.20,
    "South America": 0.20,
    "Pacific Asia": 0.20,
    "Eastern Asia": 0.18,
    "Oceania": 0.14,
}
EMISSION_DEFAULT = 0.20
MODE_EMISSION_MULTIPLIER = {"Same Day": 3.5, "First Class": 2.0, "Second Class": 1.2, "Standard Class": 1.0}
CARBON_PRICE_PER_KG = 0.05

FRAUD_STATUS = "SUSPECTED_FRAUD"
CANCEL_STATUSES = ("CANCELED", "ON_HOLD")
FAST_MODES = ("First Class", "Same Day")

# Right-closed tiers: (edges, labels).
RISK_TIERS = ([0.0, 0.3, 0.5, 0.7, 1.01], ["Low", "Medium", "High", "Critical"])
FRAUD_TIERS = ([0.0, 0.3, 0.6, 0.8, 1.0], ["Low", "Medium", "High", "Critical"])
RESILIENCE_TIERS = ([0.0, 0.4, 0.6, 0.8, 1.01], ["Fragile", "Vulnerable", "Stable", "Resilient"])

US_STATE_REGION = {
    "West": ["CA", "OR", "WA", "NV", "AZ", "UT", "CO"],
    "Midwest": ["IL", "IN", "MI", "OH", "WI", "IA", "MN"],
    "Northeast": ["NY", "PA", "NJ", "MA", "CT", "ME"],
    "South": ["TX", "FL", "GA", "NC", "VA", "TN", "LA"],
}
US_COUNTRIES = ("United States", "EE. UU.")
CARIBBEAN_COUNTRIES = ("Puerto Rico",)

# Part of the last decimal place added before rounding a report.
NUDGE = 0.00123

# --- Expressions -------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal(value) -> str:
    """SQL text of a literal: one expression for a whole table instead of one call per entry."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def lookup(key: Column | str, table: Mapping, default=None) -> Column:
    """Value of a small literal table; ``default`` for an unknown or null key."""
    entries = ", ".join(_literal(x) for pair in table.items() for x in pair)
    found = F.try_element_at(F.expr(f"map({entries})"), _col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; 0 where the first point is unknown."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    arc = 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))
    return F.when(lat1.isNull() | lon1.isNull(), F.lit(0.0)).otherwise(arc)


def planar_km(lat, lon, lat0, lon0) -> Column:
    """Flat-earth distance with a fixed number of km per degree."""
    dlat, dlon = _col(lat) - _col(lat0), _col(lon) - _col(lon0)
    return F.sqrt(dlat * dlat + dlon * dlon) * KM_PER_DEGREE


def weekend_flag(date) -> Column:
    return F.weekday(_col(date)).isin(5, 6).cast("int")


def month_end_flag(date) -> Column:
    d = F.to_date(_col(date))
    return (d == F.last_day(d)).cast("int")


def season(month) -> Column:
    """Northern season of a month; anything that is no month 1..12 counts as Fall."""
    return lookup(_col(month).cast("int"), SEASON_OF_MONTH, "Fall")


def hemisphere_season(month, latitude) -> Column:
    """Season by month, turned round south of the equator."""
    north = season(month)
    return F.when(_col(latitude) < 0, lookup(north, OPPOSITE_SEASON)).otherwise(north)


def weather_risk(month) -> Column:
    return lookup(_col(month).cast("int"), WEATHER_RISK, WEATHER_RISK_DEFAULT)


def holiday_flag(month) -> Column:
    return F.coalesce(_col(month).isin(*HOLIDAY_MONTHS), F.lit(False)).cast("int")


def emission_factor(market, region) -> Column:
    """First table name found in the market text, then in the region text, else the default."""
    out = None
    for text in (_col(market), _col(region)):
        low = F.lower(text)
        for name, factor in EMISSION_FACTOR.items():
            hit = low.contains(name.lower())
            out = F.when(hit, F.lit(factor)) if out is None else out.when(hit, F.lit(factor))
    return out.otherwise(F.lit(EMISSION_DEFAULT))


def cut_tiers(score, edges: Sequence[float], labels: Sequence[str], include_lowest: bool) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2], ...``; ``include_lowest`` also closes the first on the left."""
    s = _col(score)
    above = s >= edges[0] if include_lowest else s > edges[0]
    out = F.when(s.isNull() | ~above, F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        out = out.when(s <= edge, F.lit(label))
    return out


def tier_order(tier, labels: Sequence[str]) -> Column:
    """Position of a tier in its scale, for sorting."""
    return lookup(tier, {label: i for i, label in enumerate(labels)})


def bin_index(value, low, high, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the upper edge belongs to the last bin."""
    v, low, high = _col(value), _col(low) if isinstance(low, (str, Column)) else F.lit(low), \
        _col(high) if isinstance(high, (str, Column)) else F.lit(high)
    raw = F.floor((v - low) / (high - low) * bins).cast("int")
    return F.when(high == low, F.lit(0)).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)))


def ratio(num, den) -> Column:
    """Division that gives null instead of failing when the divisor is zero."""
    num, den = _col(num), _col(den)
    return F.when(den != 0, num / den)


def status_flag(status, wanted) -> Column:
    wanted = (wanted,) if isinstance(wanted, str) else wanted
    return F.coalesce(_col(status).isin(*wanted), F.lit(False)).cast("int")


def fraud_flag(status="order_status") -> Column:
    return status_flag(status, FRAUD_STATUS)


def cancel_flag(status="order_status") -> Column:
    return status_flag(status, CANCEL_STATUSES)


def quarter_label(date) -> Column:
    d = _col(date)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def rnd(value, places: int) -> Column:
    """Rounding for reports and comparisons, without a negative zero.

    Means of cent amounts often end exactly on a half, and the last bit of a sum depends on its
    order; a nudge far below the last place makes such halves fall the same way every time.
    """
    return F.round(_col(value) + F.lit(NUDGE * 10.0 ** -places), places) + F.lit(0.0)


def us_macro_region(country, state) -> Column:
    """Macro region inside the United States; Caribbean for Puerto Rico; null elsewhere."""
    by_state = lookup(F.upper(F.trim(_col(state))), {s: r for r, states in US_STATE_REGION.items() for s in states})
    place = F.trim(_col(country))
    return F.when(place.isin(*CARIBBEAN_COUNTRIES), F.lit("Caribbean")).when(place.isin(*US_COUNTRIES), by_state)
