"""Column functions that read text attributes: coordinates, lengths, speeds, colours, rules, URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import clamp

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"

# Named colours.
COLORS = {
    "grey": "#8f9599", "gray": "#8f9599", "red": "#ad5b55", "brown": "#8d725c", "beige": "#cbbd9d", "white": "#deded8",
    "black": "#34383c", "blue": "#708aa5", "green": "#738c70", "yellow": "#c7ad65",
}
# Road widths in metres, speeds in km/h.
OSM_WIDTHS = {"motorway": 13.0, "trunk": 11.0, "primary": 9.0, "secondary": 8.0, "tertiary": 7.0, "residential": 5.5, "service": 4.0, "pedestrian": 4.0, "footway": 1.8, "path": 1.4, "cycleway": 2.0}
SEGMENT_WIDTHS = {
    "motorway": 13.0, "trunk": 11.0, "primary": 9.0, "secondary": 8.0, "tertiary": 7.0, "residential": 5.8, "living_street": 5.0,
    "unclassified": 5.0, "service": 4.0, "track": 3.5, "pedestrian": 4.0, "cycleway": 2.0, "footway": 1.8, "path": 1.5, "steps": 1.6,
}
SEGMENT_SPEEDS = {"motorway": 100.0, "trunk": 80.0, "primary": 60.0, "secondary": 50.0, "tertiary": 45.0, "residential": 30.0, "living_street": 20.0, "service": 20.0, "track": 15.0}
GRAPH_SPEEDS = {"motorway": 100.0, "trunk": 80.0, "primary": 60.0, "secondary": 50.0, "tertiary": 45.0, "living_street": 20.0, "service": 20.0}


def lookup(table: dict, key: Column, default=None) -> Column:
    found = reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(key == next(iter(table)), F.lit(next(iter(table.values())))))
    return found.otherwise(F.lit(default)) if default is not None else found


def number_prefix(text: Column) -> Column:
    """The number that a text begins with, after blanks; null without one."""
    return F.regexp_extract(text, rf"^\s*({_NUMBER})", 1).try_cast("double")


def whole_number(text: Column) -> Column:
    """A text that is a number as a whole."""
    return F.when(text.rlike(rf"^{_NUMBER}$"), text.try_cast("double"))


def _pair(lat: Column, lon: Column) -> Column:
    good = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(good, F.struct(lon.alias("lon"), lat.alias("lat")))


def coordinate(text: Column) -> Column:
    """(lon, lat) of a text 'lat, lon': brackets dropped, cut at blanks and commas, exactly two numbers in range."""
    parts = F.filter(F.split(F.trim(F.regexp_replace(text, r"[()]", "")), r"[\s,]+"), lambda p: p != "")
    return F.when(F.size(parts) == 2, _pair(whole_number(F.get(parts, 0)), whole_number(F.get(parts, 1))))


def coordinate_input(text: Column) -> Column:
    """coordinate(), or the first of @lat,lon, query/q/ll=lat,lon and center=lat,lon in a decoded URL that is in range."""
    decoded = F.coalesce(F.try_url_decode(text), text)
    n = r"(-?[0-9]+(?:\.[0-9]+)?)"
    forms = (rf"@{n},{n}", rf"[?&](?:query|q|ll)={n},\s*{n}", rf"[?&]center={n},\s*{n}")
    tries = [_pair(F.regexp_extract(decoded, f, 1).try_cast("double"), F.regexp_extract(decoded, f, 2).try_cast("double")) for f in forms]
    return F.coalesce(coordinate(text), *tries)


def length_metres(text: Column) -> Column:
    low = F.lower(F.trim(text))
    feet = F.regexp_extract(low, r"^(-?[0-9]+(?:\.[0-9]+)?)\s*(?:ft|feet|')$", 1).try_cast("double") * 0.3048
    plain = number_prefix(F.regexp_replace(low, r"^([^,]*),", "$1."))
    return F.when(text == "", None).otherwise(F.coalesce(feet, F.when(plain >= 0, plain)))


def positive(text: Column) -> Column:
    n = number_prefix(text)
    return F.when(n > 0, n)


def osm_speed(text: Column) -> Column:
    n = positive(text)
    return n * F.when(F.lower(text).contains("mph"), 1.609344).otherwise(1.0)


def osm_oneway(text: Column) -> Column:
    return F.when(F.lower(text).isin("yes", "true", "1"), "forward").when(text == "-1", "backward").otherwise("both")


def color(text: Column, names: bool = True) -> Column:
    plain = F.when(F.lower(text).rlike("^#[0-9a-f]{3,8}$"), text)
    return F.coalesce(lookup(COLORS, F.lower(text)), plain) if names else plain


def osm_road_width(width: Column, lanes: Column, kind: Column) -> Column:
    explicit, n = length_metres(width), positive(lanes)
    return F.coalesce(
        F.when(explicit > 0, clamp(explicit, 1.0, 32.0)), clamp(n * 3.15, 2.5, 28.0),
        F.when(kind.startswith("railway:"), 2.2).when(kind == "waterway", 3.0), lookup(OSM_WIDTHS, kind), F.lit(4.5),
    )


def segment_width(width: Column, kind: Column) -> Column:
    n = number_prefix(width)
    return F.coalesce(F.when(n > 0, clamp(n, 2.4, 32.0)), lookup(SEGMENT_WIDTHS, kind), F.lit(4.5))


def segment_speed(kind: Column) -> Column:
    return lookup(SEGMENT_SPEEDS, kind, 30.0)


def segment_surface(kind: Column) -> Column:
    return F.when(kind.isin("track", "path"), "unpaved").otherwise("paved")


def _rules(text: Column) -> Column:
    """The elements of a JSON array as texts; malformed: none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def connectors(text: Column) -> Column:
    """array<(id, at)> of a JSON array of connector references; others are dropped, `at` is clamped to [0, 1]."""
    made = F.transform(_rules(text), lambda e: F.struct(F.get_json_object(e, "$.connector_id").alias("id"), F.get_json_object(e, "$.at").try_cast("double").alias("at")))
    return F.transform(F.filter(made, lambda c: c["id"].isNotNull() & c["at"].isNotNull() & ~F.isnan(c["at"])), lambda c: F.struct(c["id"].alias("id"), clamp(c["at"], 0.0, 1.0).alias("at")))


def oneway_rules(text: Column) -> Column:
    denied = lambda way: F.exists(_rules(text), lambda e: F.coalesce((F.get_json_object(e, "$.access_type") == "denied") & (F.get_json_object(e, "$.when.heading") == way), F.lit(False)))
    back, ahead = denied("backward"), denied("forward")
    return F.when(back & ~ahead, "forward").when(ahead & ~back, "backward").otherwise("both")


def speed_rules(text: Column) -> Column:
    read = F.transform(_rules(text), lambda e: F.get_json_object(e, "$.max_speed.value").try_cast("double") * F.when(F.get_json_object(e, "$.max_speed.unit") == "mph", 1.609344).otherwise(1.0))
    return F.get(F.filter(read, lambda v: v.isNotNull() & (v > 0)), 0)


def app_url(url: Column) -> Column:
    """A URL without query and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def has_seed(url: Column) -> Column:
    """Whether a URL's query names a latitude or longitude."""
    return F.regexp_replace(url, r"#.*$", "").rlike(r"[?&](lat|lng)(=|&|$)")


def share_url(url: Column, lon: Column, lat: Column, radius: Column, style: Column, mode: Column, route=None) -> Column:
    rest = [F.lit("&route="), route] if route is not None else []
    return F.concat(app_url(url), F.format_string("?lat=%.6f&lng=%.6f&r=", lat, lon), F.floor(radius + 0.5).cast("long").cast("string"), F.lit("&style="), style, F.lit("&mode="), mode, *rest)
