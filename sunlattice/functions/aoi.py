"""Areas of interest and time properties: GeoJSON checks, boxes, rings, ISO times and durations, schedules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32
M_PER_DEGREE = 111_320.0
GEOJSON = (
    "struct<type:string,features:array<struct<type:string,geometry:struct<type:string,coordinates:string>,"
    "properties:struct<time:string,is_rectangle:boolean>>>,geometry:struct<type:string,coordinates:string>,"
    "properties:struct<time:string,is_rectangle:boolean>>"
)
RING = "array<array<double>>"


def single_feature(json: Column) -> Column:
    """The one feature of a Feature or FeatureCollection as struct(geometry, properties); NULL if there isn't just one."""
    g = F.from_json(json, GEOJSON)
    from_collection = F.when(F.size(g["features"]) == 1, F.get(g["features"], F.lit(0)))
    return F.when(
        g["type"] == "FeatureCollection",
        F.struct(from_collection["geometry"].alias("geometry"), from_collection["properties"].alias("properties")),
    ).when(g["type"] == "Feature", F.struct(g["geometry"].alias("geometry"), g["properties"].alias("properties")))


def point_of(coordinates: Column) -> Column:
    return F.from_json(coordinates, "array<double>")


def ring_of(coordinates: Column) -> Column:
    """The one ring of a polygon; NULL if it has holes."""
    rings = F.from_json(coordinates, f"array<{RING}>")
    return F.when(F.size(rings) == 1, F.get(rings, F.lit(0)))


def _x(p: Column) -> Column:
    return F.get(p, F.lit(0))


def _y(p: Column) -> Column:
    return F.get(p, F.lit(1))


def in_range(p: Column) -> Column:
    ok = (F.size(p) == 2) & _x(p).between(-180, 180) & _y(p).between(-90, 90)
    return F.coalesce(ok, F.lit(False))


def valid_ring(ring: Column) -> Column:
    """Four points or more, closed, all in range."""
    closed = F.get(ring, F.lit(0)) == F.element_at(ring, -1)
    return F.coalesce((F.size(ring) >= 4) & closed & F.forall(ring, in_range), F.lit(False))


def is_axis_aligned(ring: Column) -> Column:
    """Five points, four of them distinct, on two longitudes and two latitudes (exact equality)."""
    corners = F.array_distinct(ring)
    lons, lats = F.array_distinct(F.transform(ring, _x)), F.array_distinct(F.transform(ring, _y))
    return F.coalesce(
        (F.size(ring) == 5) & (F.size(corners) == 4) & (F.size(lons) == 2) & (F.size(lats) == 2), F.lit(False)
    )


def ring_bbox(ring: Column) -> dict[str, Column]:
    """Bounds of a ring and their midpoint."""
    xs, ys = F.transform(ring, _x), F.transform(ring, _y)
    out = {"min_lon": F.array_min(xs), "min_lat": F.array_min(ys), "max_lon": F.array_max(xs), "max_lat": F.array_max(ys)}
    return out | {
        "center_lon": (out["min_lon"] + out["max_lon"]) / 2.0,
        "center_lat": (out["min_lat"] + out["max_lat"]) / 2.0,
    }


def bbox_from_km(lat: Column, lon: Column, size_km_y: float, size_km_x: float) -> dict[str, Column]:
    """A box of the given size about a point; NULL at the poles. Sizes must be positive."""
    if size_km_y <= 0 or size_km_x <= 0:
        raise ValueError("box sizes must be positive")
    scale = F.cos(F.radians(lat))
    dx = F.when(F.abs(scale) >= 1e-12, F.lit(size_km_x / 2.0) / (KM_PER_DEGREE * scale))
    dy = F.lit(size_km_y / 2.0 / KM_PER_DEGREE)
    return {"min_lon": lon - dx, "min_lat": lat - dy, "max_lon": lon + dx, "max_lat": lat + dy}


def parse_time(text: Column) -> Column:
    """A timestamp without zone from YYYY-MM-DD or YYYY-MM-DDThh:mm:ss; NULL otherwise."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?$")
    return F.when(shape, text.try_cast("timestamp_ntz"))


#: Days, hours, minutes, seconds; years, months and weeks are no fixed spans.
DURATION = r"^P(?=\d|T\d)(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 duration; NULL if malformed or not positive."""
    units = (86400, 3600, 60, 1)
    parts = [F.coalesce(F.regexp_extract(text, DURATION, i + 1).try_cast("long"), F.lit(0)) * u for i, u in enumerate(units)]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    return F.when(text.rlike(DURATION) & (total > 0), total)


def duration(text: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), duration_seconds(text).cast("decimal(18,6)"))


def schedule(start: Column, end: Column, step: Column) -> Column:
    """start, start + step, ... up to and including end."""
    return F.sequence(start, end, step)


def parse_time_property(text: Column) -> dict[str, Column]:
    """mode (null, instant, range, invalid), start, end, step seconds of a `time` property given as JSON text or a string."""
    items = F.from_json(text, "array<string>")
    start, end = parse_time(F.get(items, F.lit(0))), parse_time(F.get(items, F.lit(1)))
    step = duration_seconds(F.get(items, F.lit(2)))
    instant = parse_time(F.trim(text, F.lit('"')))
    ranged = (F.size(items) == 3) & start.isNotNull() & end.isNotNull() & step.isNotNull() & (end >= start)
    mode = (
        F.when(text.isNull() | (text == "null"), "null")
        .when(instant.isNotNull(), "instant")
        .when(F.coalesce(ranged, F.lit(False)), "range")
        .otherwise("invalid")
    )
    is_range = mode == "range"
    return {
        "mode": mode,
        "t_start": F.when(is_range, start).otherwise(instant),
        "t_end": F.when(is_range, end).otherwise(instant),
        "step_seconds": F.when(is_range, step),
    }


def series_request(json: Column) -> dict[str, Column]:
    """Box and times of a FeatureCollection's first feature (others are ignored); all NULL if it is none.

    A point has a box without extent, a polygon that of its first ring. A `time` of three items is start, end and step, the
    step cut to whole hours (none shorter than one); of any other number it is a list of dates.
    """
    g = F.from_json(json, GEOJSON)
    feature = F.when(g["type"] == "FeatureCollection", F.get(g["features"], F.lit(0)))
    at, rings = point_of(feature["geometry"]["coordinates"]), F.from_json(feature["geometry"]["coordinates"], f"array<{RING}>")
    point = feature["geometry"]["type"] == "Point"
    ring = F.get(rings, F.lit(0))

    def side(which: Callable[[Column], Column], pick: Callable[[Column], Column]) -> Column:
        return F.when(point, which(at)).otherwise(pick(F.transform(ring, which)))

    items = F.from_json(feature["properties"]["time"], "array<string>")
    start, end = parse_time(F.get(items, F.lit(0))), parse_time(F.get(items, F.lit(1)))
    hours = F.floor(duration_seconds(F.get(items, F.lit(2))) / 3600).cast("int")
    stepped = F.when((end >= start) & (hours >= 1), F.sequence(start, end, F.make_dt_interval(F.lit(0), hours)))
    return {
        "min_lon": side(_x, F.array_min),
        "min_lat": side(_y, F.array_min),
        "max_lon": side(_x, F.array_max),
        "max_lat": side(_y, F.array_max),
        "times": F.when(F.size(items) == 3, stepped).otherwise(F.transform(items, parse_time)),
    }


def adjust_area(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, width: float = 0.1) -> dict[str, Column]:
    """Spans narrower than `width` degrees are widened about their middle; longitudes by width / cos(latitude)."""
    mid_lat, mid_lon = (lat_min + lat_max) / 2.0, (lon_min + lon_max) / 2.0
    lon_width = F.when(F.abs(mid_lat) >= 89.9, F.lit(width)).otherwise(F.lit(width) / F.cos(F.radians(mid_lat)))
    narrow_lat, narrow_lon = lat_max - lat_min < width, lon_max - lon_min < lon_width
    return {
        "lat_min": F.when(narrow_lat, mid_lat - width / 2).otherwise(lat_min),
        "lat_max": F.when(narrow_lat, mid_lat + width / 2).otherwise(lat_max),
        "lon_min": F.when(narrow_lon, mid_lon - lon_width / 2).otherwise(lon_min),
        "lon_max": F.when(narrow_lon, mid_lon + lon_width / 2).otherwise(lon_max),
    }


def station_box(lat: Column, lon: Column, half_m: float = 60.0) -> dict[str, Column]:
    """The square of 120 m about a station."""
    d_lat = F.lit(half_m / M_PER_DEGREE)
    d_lon = F.lit(half_m) / (M_PER_DEGREE * F.cos(F.radians(lat)))
    return {"min_lon": lon - d_lon, "min_lat": lat - d_lat, "max_lon": lon + d_lon, "max_lat": lat + d_lat}


def box_ring(box: dict[str, Column]) -> Column:
    """The closed ring of a box, counter-clockwise from the lower left."""
    corner = [("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat")]
    return F.array(*[F.array(box[x], box[y]) for x, y in corner])


def station_geojson(lat: Column, lon: Column, start: str = "2018-01-01", end: str = "2019-01-01", step: str = "P30D") -> Column:
    """The FeatureCollection of a station: its square and a time range, as JSON text."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array(box_ring(station_box(lat, lon))).alias("coordinates")).alias("geometry"),
        F.struct(F.array(F.lit(start), F.lit(end), F.lit(step)).alias("time"), F.lit(True).alias("is_rectangle")).alias("properties"),
    )
    return F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))


def swap_if_latitudes_first(ring: Column) -> Column:
    """Swap axes if a second coordinate can't be a latitude."""
    swapped = F.transform(ring, lambda p: F.array(_y(p), _x(p)))
    return F.when(F.exists(ring, lambda p: F.abs(_y(p)) > 90), swapped).otherwise(ring)


def bounding_box(lat: Column, lon: Column, buffer: float) -> dict[str, Column]:
    return {"min_lon": lon - buffer, "min_lat": lat - buffer, "max_lon": lon + buffer, "max_lat": lat + buffer}


def ring_difference(a: Column, b: Column) -> Column:
    """The largest coordinate difference of two rings of one length; NULL if lengths differ."""
    gaps = F.zip_with(a, b, lambda p, q: F.greatest(F.abs(_x(p) - _x(q)), F.abs(_y(p) - _y(q))))
    return F.when(F.size(a) == F.size(b), F.array_max(gaps))


def rings_equal(a: Column, b: Column, tolerance: float = 1e-7) -> Column:
    """Equal within the tolerance, as given or with the axes of one swapped."""
    swapped = F.transform(b, lambda p: F.array(_y(p), _x(p)))
    best = F.least(ring_difference(a, b), ring_difference(a, swapped))
    return F.coalesce(best <= tolerance, F.lit(False))


def consistent(geometry_type: Column, is_rectangle: Column, ring: Column, sizes_given: Column, mode: Column) -> Column:
    """A point needs sizes and no rectangle flag, a polygon the right flag, and time must be given."""
    point = (geometry_type == "Point") & is_rectangle.isNull() & sizes_given
    polygon = (geometry_type == "Polygon") & is_rectangle.eqNullSafe(is_axis_aligned(ring))
    return F.coalesce((point | polygon) & mode.isin("instant", "range"), F.lit(False))


def safe_filename(text: Column) -> Column:
    return F.translate(text, ":T", "-_")


def explode_schedule(df: DataFrame, start: str, end: str, step: str, name: str = "target") -> DataFrame:
    return df.select("*", F.explode(F.expr(f"sequence({start}, {end}, {step})")).alias(name))
