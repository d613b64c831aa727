"""Geometry as column expressions over rings: array<struct<x: double, y: double>>; a feature has array<ring>.

NaN is turned to null before comparisons: Spark ranks NaN highest, and the rules here ignore it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32
#: Five blues, light to dark.
PALETTE = ("#edf4fc", "#bfd8f2", "#72ade0", "#3372bf", "#0c3f8c")
EPSILON = 2.220446049250313e-16


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def ring_area_km2(ring: Column) -> Column:
    """Area of a lon/lat ring, scaled to km at its mean latitude (all vertices count); under 3 vertices: 0.

    The scale of longitude is taken out of the sum, so the cosine is computed once a ring."""

    def shoelace(r: Column) -> Column:
        turned = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
        cross = _sum(F.zip_with(r, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))
        lat = _sum(F.transform(r, lambda p: p["y"])) / F.size(r)
        return F.abs(cross) * F.cos(F.radians(lat)) * (KM_PER_DEGREE * KM_PER_DEGREE * 0.5)

    return bound(ring, lambda r: F.when(F.size(r) < 3, 0.0).otherwise(shoelace(r)))


def area_km2(rings: Column) -> Column:
    """Sum of the areas of a feature's rings."""
    return _sum(F.transform(rings, ring_area_km2))


#: Fixed values of the WGS 84 ellipsoid: half of its long axis in km, and the square of its eccentricity.
SEMI_MAJOR_KM, ECCENTRICITY2 = 6378.137, 0.0066943799901413165


def _authalic(sin_lat: Column) -> Column:
    """q of a latitude: the area between the equator and it, by which latitudes are spaced in an equal-area projection."""
    e = ECCENTRICITY2**0.5
    return (sin_lat / (1 - ECCENTRICITY2 * sin_lat * sin_lat) + F.atanh(sin_lat * e) / e) * (1 - ECCENTRICITY2)


def equal_area(lon: Column, lat: Column) -> Column:
    """struct(x, y) in km of a point in degrees: the cylindrical equal-area projection of the WGS 84 ellipsoid.

    x runs along the equator; y is such that areas on the plane are those on the ellipsoid."""
    x, y = F.radians(lon) * SEMI_MAJOR_KM, _authalic(F.sin(F.radians(lat))) * (SEMI_MAJOR_KM / 2)
    return F.struct(x.alias("x"), y.alias("y"))


def reproject_ring(ring: Column) -> Column:
    """A lon/lat ring on the equal-area plane, in km."""
    return F.transform(ring, lambda p: equal_area(p["x"], p["y"]))


def plane_area(ring: Column) -> Column:
    """Area of a ring on a plane; under 3 vertices: 0. Taken relative to the first vertex, so that no digits are lost."""

    def shoelace(r: Column) -> Column:
        origin = F.get(r, F.lit(0))
        turned = F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1))
        cross = lambda p, q: (p["x"] - origin["x"]) * (q["y"] - origin["y"]) - (q["x"] - origin["x"]) * (p["y"] - origin["y"])
        return F.abs(_sum(F.zip_with(r, turned, cross))) * 0.5

    return bound(ring, lambda r: F.when(F.size(r) < 3, 0.0).otherwise(shoelace(r)))


def equal_area_km2(rings: Column) -> Column:
    """Area of a feature on the ellipsoid, edges straight on the equal-area plane."""
    return _sum(F.transform(rings, lambda r: plane_area(reproject_ring(r))))


def density(population: Column, area: Column) -> Column:
    """population / area; 0 where the area is null, NaN or not positive."""
    return F.when((area > 0) & ~F.isnan(area), population / area).otherwise(F.lit(0.0))


def bbox_polygon(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Closed ring of five points, counter-clockwise from the lower left."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(min_x, min_y), corner(max_x, min_y), corner(max_x, max_y), corner(min_x, max_y), corner(min_x, min_y))


def bbox_contains(box: Column, x: Column, y: Column) -> Column:
    return x.between(box["min_x"], box["max_x"]) & y.between(box["min_y"], box["max_y"])


def bbox_intersects(a: dict[str, Column], b: dict[str, float]) -> Column:
    """Closed boxes, touching counts. Flat columns on the left, so that Parquet statistics can prune."""
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def ensure_closed(ring: Column) -> Column:
    """The first vertex is appended unless it equals the last within the machine epsilon; under 2 vertices: as is."""

    def close(r: Column) -> Column:
        first, last = F.get(r, F.lit(0)), F.get(r, F.size(r) - 1)
        open_ = (F.abs(first["x"] - last["x"]) > EPSILON) | (F.abs(first["y"] - last["y"]) > EPSILON)
        return F.when((F.size(r) >= 2) & open_, F.concat(r, F.slice(r, 1, 1))).otherwise(r)

    return bound(ring, close)


def simplify_ring(ring: Column, lod: Column) -> Column:
    """Every 2**min(lod, 6)-th vertex, closed; rings of up to 4 vertices, or left with fewer than 4, stay as they are."""
    step = F.pow(F.lit(2), F.least(lod, F.lit(6))).cast("int")

    def thin(r: Column) -> Column:
        picked = ensure_closed(F.filter(r, lambda _, i: i % step == 0))
        return F.when((F.size(r) <= 4) | (step <= 1), r).otherwise(bound(picked, lambda p: F.when(F.size(p) < 4, r).otherwise(p)))

    return bound(ring, thin)


def lod_for_zoom(zoom: Column, levels: int) -> Column:
    coarsest = max(levels - 1, 0)
    return F.when(zoom >= 1.0, 0).when(zoom >= 0.5, min(1, coarsest)).otherwise(coarsest)


def vertex_centroid(rings: Column) -> Column:
    """Mean of the first ring's vertices (a closing vertex counts again); no vertex: null."""

    def mean(r: Column) -> Column:
        n = F.size(r)
        return F.when(n > 0, F.struct((_sum(F.transform(r, lambda p: p["x"])) / n).alias("x"), (_sum(F.transform(r, lambda p: p["y"])) / n).alias("y")))

    return bound(F.get(rings, F.lit(0)), mean)


def _extent(low: Column, high: Column) -> Column:
    return F.greatest(high - low, F.lit(1e-9))


def tile_for_point(x: Column, y: Column, box: Column, grid_x: int, grid_y: int) -> Column:
    """struct(tx, ty) on a grid over the box; points outside go to the nearest edge tile."""

    def index(v: Column, low: Column, high: Column, n: int) -> Column:
        return F.least(F.greatest(F.floor((v - low) / _extent(low, high) * n), F.lit(0)), F.lit(n - 1)).cast("int")

    return F.struct(index(x, box["min_x"], box["max_x"], grid_x).alias("tx"), index(y, box["min_y"], box["max_y"], grid_y).alias("ty"))


def to_ndc(x: Column, y: Column, box: Column, width: float, height: float, pad: float = 24.0) -> Column:
    """struct(x, y float) in [-1, 1]: the box is fitted into the padded viewport with its aspect kept, y pointing up."""
    room_w, room_h = width - 2 * pad, height - 2 * pad
    dx, dy = _extent(box["min_x"], box["max_x"]), _extent(box["min_y"], box["max_y"])
    aspect = dx / dy
    wide = aspect > room_w / room_h
    draw_w = F.when(wide, F.lit(room_w)).otherwise(aspect * room_h)
    draw_h = F.when(wide, room_w / aspect).otherwise(F.lit(room_h))
    sx = pad + (room_w - draw_w) / 2 + (x - box["min_x"]) / dx * draw_w
    sy = pad + (room_h - draw_h) / 2 + (box["max_y"] - y) / dy * draw_h
    return F.struct((sx / width * 2 - 1).cast("float").alias("x"), (1 - sy / height * 2).cast("float").alias("y"))


def svg_path(ring: Column, box: Column, width: float, height: float, pad: float) -> Column:
    """`M x y L x y ... Z` with two decimals, y pointing down; the aspect is not kept."""
    dx, dy = _extent(box["min_x"], box["max_x"]), _extent(box["min_y"], box["max_y"])

    def point(p: Column, i: Column) -> Column:
        sx = pad + (p["x"] - box["min_x"]) / dx * (width - 2 * pad)
        sy = pad + (box["max_y"] - p["y"]) / dy * (height - 2 * pad)
        return F.format_string("%s %.2f %.2f", F.when(i == 0, "M").otherwise("L"), sx, sy)

    return F.concat_ws(" ", F.array_join(F.transform(ring, point), " "), F.lit("Z"))


def classify(value: Column, breaks: Column) -> Column:
    """0-based class: the first whose upper break is not below the value; above all, or NaN: the last."""
    last = F.size(breaks) - 2
    inner = F.slice(breaks, 2, F.greatest(last, F.lit(0)))
    below = F.size(F.filter(inner, lambda b: value > b))
    return F.when(F.isnan(value), last).otherwise(below).cast("int")


def class_color(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PALETTE)), number + 1)
