"""Scalar rules of the observation feed as Column functions (built-in functions only)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing value, after trimming and case folding.
NULL_MARKERS = ("", "null", "none", "nan", "n/a", "\\n")
#: Spellings of two city regions.
REGION_ALIASES = {
    "г москва": "москва",
    "город москва": "москва",
    "г санкт петербург": "санкт-петербург",
    "город санкт петербург": "санкт-петербург",
    "санкт петербург": "санкт-петербург",
}
#: Settlement prefixes; the first that fits goes.
LOCATION_PREFIXES = ("городской поселок ", "рабочий поселок ", "деревня ", "посёлок ", "поселок ", "станица ", "слобода ", "город ", "село ", "г. ", "г ", "с. ", "с ", "д. ", "д ", "п. ", "п ")
LEGACY_PREFIXES = ("г ", "гп ", "г. ", "гп. ", "с ", "д ", "п ", "пгт ", "пос ")
#: Settlement prefixes of origins, month names, metres of the mean radius of the earth.
ORIGIN_PREFIX = "(?iu)^(?:г(?:ород)?|г\\.|п(?:ос(?:елок)?)?|п\\.|пос\\.|рп\\.|гп\\.)\\s+"
MONTHS = ("Янв", "Фев", "Мар", "Апр", "Май", "Июн", "Июл", "Авг", "Сен", "Окт", "Ноя", "Дек")
EARTH_M = 6_371_008.8


def clean_text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*NULL_MARKERS), t)


def parse_float(c: Column) -> Column:
    """A decimal comma is allowed; anything but a plain number is null (so are inf, nan, digit separators and suffixes)."""
    t = F.replace(clean_text(c), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def parse_int(c: Column) -> Column:
    t = clean_text(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long"))


def parse_datetime(c: Column) -> Column:
    return F.try_to_timestamp(F.replace(clean_text(c), F.lit("T"), F.lit(" ")))


def normalize_name(c: Column) -> Column:
    """Case, ё, dashes and spaces made uniform. Of compatibility characters only spaces and dashes are folded here;
    names.with_normal_name does the rest."""
    t = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, "[\\u00A0\\u2000-\\u200A\\u202F\\u3000]", " "))), "ё", "е")
    t = F.regexp_replace(F.regexp_replace(t, "[\\u2010-\\u2015\\u2212]+", "-"), "\\s+", " ")
    return F.nullif(t, F.lit(""))


def normalize_region(c: Column) -> Column:
    n = normalize_name(c)
    alias = F.create_map(*[F.lit(x) for x in chain.from_iterable(REGION_ALIASES.items())])
    return F.coalesce(F.element_at(alias, n), n)


def _alternation(prefixes: tuple[str, ...]) -> str:
    return "|".join(p.replace(".", "\\.") for p in prefixes)


def strip_location_prefix(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), f"(?iu)^(?:{_alternation(LOCATION_PREFIXES)})", ""))


def strip_legacy_prefix(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"^(?:{_alternation(LEGACY_PREFIXES)})", ""))


def strip_origin_prefix(c: Column) -> Column:
    t = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "\\s+", " ")), "ё", "е")
    return F.btrim(F.regexp_replace(t, ORIGIN_PREFIX, ""), F.lit(" .,"))


def validation_errors(units: Column, route_length: Column, bid_count: Column, nanos: Column, period_id: Column, tech_ts: Column) -> Column:
    """Names of the fields that have a value which does not parse."""
    bad = lambda raw, parsed: clean_text(raw).isNotNull() & parsed.isNull()
    period = clean_text(period_id)
    return F.array_compact(
        F.array(
            F.when(bad(units, parse_float(units)), "invalid_units"),
            F.when(bad(route_length, parse_float(route_length)), "invalid_route_length"),
            F.when(bad(bid_count, parse_int(bid_count)), "invalid_bid_count"),
            F.when(bad(nanos, parse_int(nanos)), "invalid_nanos"),
            F.when(period.isNotNull() & ~period.rlike(r"^\d{6}$"), "invalid_period_id"),
            F.when(bad(tech_ts, parse_datetime(tech_ts)), "invalid_tech_load_ts"),
        )
    )


def rub_per_km(price: Column, length: Column) -> Column:
    return F.when((price > 0) & (length > 0), price / length)


def row_fingerprint(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def source_row_id(snapshot: Column, row: Column) -> Column:
    """16 hexadecimal digits that name a row of a snapshot: the row's number is assigned once, when the snapshot is read."""
    return F.substring(F.sha2(F.concat(snapshot.cast("string"), F.lit(":"), row.cast("string")), 256), 1, 16)


def stable_origin_id(name: Column) -> Column:
    return F.concat(F.lit("actual_"), F.substring(F.sha2(F.trim(name), 256), 1, 24))


def parse_month(c: Column) -> Column:
    """yyyy-MM from yyyy-MM, yyyyMM or yyyy-MM-dd."""
    t = clean_text(c)
    date = F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd"), F.try_to_date(F.concat(t, F.lit("01")), "yyyyMMdd"))
    return F.date_format(date, "yyyy-MM")


def month_difference(later: Column, earlier: Column) -> Column:
    part = lambda c, a, n: F.substring(c, a, n).cast("int")
    return (part(later, 1, 4) - part(earlier, 1, 4)) * 12 + part(later, 6, 2) - part(earlier, 6, 2)


def month_label(horizon: Column) -> Column:
    return F.concat(F.lit("M"), horizon.cast("string"))


def period_label(period_id: Column) -> Column:
    name = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.substring(period_id, 5, 2).cast("int") - 1)
    return F.when(period_id.rlike(r"^\d{6}$") & name.isNotNull(), F.concat_ws(" ", name, F.substring(period_id, 1, 4))).otherwise(period_id)


def relative_delta(value: Column, base: Column) -> Column:
    return F.when(base > 0, value / base - 1)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def aeqd(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Spherical azimuthal equidistant x, y in metres about (lat0, lon0)."""
    p, p0, dl = F.radians(lat), F.radians(lat0), F.radians(lon - lon0)
    cos_c = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl)))
    c = F.acos(cos_c)
    k = F.when(F.abs(c) < 1e-12, 1.0).otherwise(c / F.sin(c)) * EARTH_M
    return k * F.cos(p) * F.sin(dl), k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))


def aeqd_inverse(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    rho = F.sqrt(x * x + y * y)
    c, p0 = rho / EARTH_M, F.radians(lat0)
    lat = F.when(rho < 1e-9, lat0).otherwise(F.degrees(F.asin(F.cos(c) * F.sin(p0) + y * F.sin(c) * F.cos(p0) / rho)))
    lon = lon0 + F.degrees(F.atan2(x * F.sin(c), rho * F.cos(p0) * F.cos(c) - y * F.sin(p0) * F.sin(c)))
    return lat, F.when(rho < 1e-9, lon0).otherwise(lon)


def auction_bin(c: Column) -> Column:
    return F.when(c.isNull(), "missing").when(c == 0, "0").when(c <= 0.25, "(0,0.25]").when(c <= 0.5, "(0.25,0.5]").when(c <= 0.75, "(0.5,0.75]").otherwise("(0.75,1]")
