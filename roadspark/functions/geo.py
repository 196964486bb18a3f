"""Geographic column functions: cells of the S2 grid, distances, tile boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
LEVEL = 9
OVERLAP_DEG = 2.0 / 111.32
#: Fixed values of the cell grid: position along the curve by orientation and (i, j) bits, and the turn each position makes.
POSITION = [[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]]
TURN = [1, 0, 0, 3]


def s2_cell(lat: Column, lng: Column, level: int = LEVEL) -> Column:
    """The 64 bits of the cell id as LONG (negative for faces 4 and 5)."""
    phi, theta = F.radians(lat), F.radians(lng)
    x, y, z = F.cos(phi) * F.cos(theta), F.cos(phi) * F.sin(theta), F.sin(phi)
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    axis = F.when((ax > ay) & (ax > az), 0).when(ay > az, 1).otherwise(2)
    lead = F.when(axis == 0, x).when(axis == 1, y).otherwise(z)
    point = F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.when(lead < 0, axis + 3).otherwise(axis).alias("f"))

    def ident(p: Column) -> Column:
        x, y, z, f = p["x"], p["y"], p["z"], p["f"]
        u = F.when(f == 0, y / x).when(f == 1, -x / y).when(f == 2, -x / z).when(f == 3, z / x).when(f == 4, z / y).otherwise(-y / z)
        v = F.when(f == 0, z / x).when(f == 1, z / y).when(f == 2, -y / z).when(f == 3, y / x).when(f == 4, -x / y).otherwise(-x / z)
        cells = 1 << level

        def grid(c: Column) -> Column:
            st = F.when(c >= 0, F.sqrt(1 + 3 * c) * 0.5).otherwise(1 - F.sqrt(1 - 3 * c) * 0.5)
            return F.least(F.greatest(F.floor(st * cells), F.lit(0)), F.lit(cells - 1)).cast("long")

        table = F.array(*(F.lit(v) for row in POSITION for v in row))
        turns = F.array(*map(F.lit, TURN))
        start = F.struct(f.bitwiseAND(1).cast("int").alias("o"), F.lit(0).cast("long").alias("pos"), grid(u).alias("i"), grid(v).alias("j"))

        def step(a: Column, bit: Column) -> Column:
            ij = F.call_function("shiftright", a["i"], bit).bitwiseAND(1) * 2 + F.call_function("shiftright", a["j"], bit).bitwiseAND(1)
            digit = F.element_at(table, (a["o"] * 4 + ij + 1).cast("int"))
            return F.struct(a["o"].bitwiseXOR(F.element_at(turns, digit + 1)).alias("o"), (a["pos"] * 4 + digit).alias("pos"), a["i"].alias("i"), a["j"].alias("j"))

        low = 60 - 2 * level
        return F.aggregate(F.sequence(F.lit(level - 1), F.lit(0), F.lit(-1)), start, step, lambda a: F.shiftleft(f.cast("long"), 61).bitwiseOR(F.shiftleft(a["pos"], low + 1)).bitwiseOR(F.lit(1 << low)))

    # a one-element transform evaluates the point once
    return F.when(lat.isNotNull() & lng.isNotNull(), F.element_at(F.transform(F.array(point), ident), 1))


def unsigned(cell: Column) -> Column:
    """The id as an unsigned decimal, as paths and JSON show it."""
    return F.conv(F.hex(cell), 16, 10)


def distance_m(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Equirectangular distance in metres of (lng, lat) points."""
    dx = F.radians(x2 - x1) * F.cos((F.radians(y1) + F.radians(y2)) / 2) * EARTH_RADIUS_M
    dy = F.radians(y2 - y1) * EARTH_RADIUS_M
    return F.sqrt(dx * dx + dy * dy)


def tile_box(name: Column, core: bool = False) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) of a tile file name; an error for other names."""
    middle = F.regexp_extract(name, r"(?:^|/)tile_([^/]+)\.osm\.pbf$", 1)
    parts = F.regexp_extract_all(middle, F.lit(r"(m?\d+(?:_\d+)?)"), F.lit(1))
    values = F.transform(parts, lambda p: F.translate(p, "m_", "-.").cast("double"))
    good = F.size(parts) == 4
    by = F.lit(OVERLAP_DEG if core else 0.0)
    box = F.struct(
        (values[1] + by).alias("min_lon"), (values[0] + by).alias("min_lat"), (values[3] - by).alias("max_lon"), (values[2] - by).alias("max_lat")
    )
    return F.when(good, box).otherwise(F.raise_error(F.concat(F.lit("not a tile file name: "), name)).cast("struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>"))


def tile_name(min_lat: Column, min_lon: Column, max_lat: Column, max_lon: Column) -> Column:
    """The file name of a tile's box, six decimals."""
    shown = [F.translate(F.regexp_replace(F.format_string("%.6f", c), "^-", "m"), ".", "_") for c in (min_lat, min_lon, max_lat, max_lon)]
    return F.concat(F.lit("tile_"), F.concat_ws("_", *shown), F.lit(".osm.pbf"))


def in_box(lng: Column, lat: Column, box: Column) -> Column:
    """Half-open membership."""
    return (lng >= box["min_lon"]) & (lng < box["max_lon"]) & (lat >= box["min_lat"]) & (lat < box["max_lat"])
