"""Point-wise maps, stencils, filters and searches on a grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def binary(a: Column, b: Column) -> dict[str, Column]:
    """The binary operators of two fields at one point."""
    return {
        "sum": a + b, "difference": a - b, "absolute_difference": F.abs(a - b), "product": a * b,
        # where a comparison with NaN fails, the first operand is taken
        "maximum": F.when((a < b) & ~F.isnan(b), b).otherwise(a), "minimum": F.when((b < a) & ~F.isnan(a), b).otherwise(a),
    }


def derivative(column: str, axis: str, step: float = 1.0, keys: list[str] = ()) -> Column:
    """Central difference along an axis, one-sided at its ends; ``keys`` tell time steps and members apart."""
    w = Window.partitionBy(*keys, *[a for a in "xyz" if a != axis]).orderBy(axis)
    v, after, before = F.col(column), F.lead(column).over(w), F.lag(column).over(w)
    steps = F.when(after.isNull() | before.isNull(), F.lit(1.0)).otherwise(2.0)
    return (F.coalesce(after, v) - F.coalesce(before, v)) / (steps * step)


def velocity(df: DataFrame) -> DataFrame:
    """Members 0, 1 and 2 as the components u, v, w of a vector field."""
    pick = [F.max(F.when(F.col("m") == k, F.col("value"))).alias(c) for k, c in enumerate("uvw")]
    return df.filter("m < 3").groupBy("point_id", "x", "y", "z").agg(*pick)


#: Names by which the components of a velocity are found, in this order.
COMPONENTS = (("u", "U", "velocityX", "x-velocity"), ("v", "V", "velocityY", "y-velocity"), ("w", "W", "velocityZ", "z-velocity"))


def named_velocity(df: DataFrame, names: tuple | None = None, keys: list[str] = ["t", "e"]) -> DataFrame:  # noqa: B006
    """(keys, point_id, x, y, z, u, v, w) of rows with a ``variable``: its components by their names.

    ``names`` are the three variables; by default the first known name of each
    component that occurs. A component that isn't there is refused.
    """
    if names is None:
        there = {r[0] for r in df.select("variable").distinct().limit(10_000).collect()}
        names = tuple(next((n for n in known if n in there), None) for known in COMPONENTS)
        missing = [known[0] for known, n in zip(COMPONENTS, names) if n is None]
        if missing:
            raise ValueError(f"no variable for the components {', '.join(missing)} of a velocity among {sorted(there)}")
    pick = [F.max(F.when(F.col("variable") == n, F.col("value"))).alias(c) for n, c in zip(names, "uvw")]
    return df.filter(F.col("variable").isin(*names)).groupBy(*keys, "point_id", "x", "y", "z").agg(*pick)


def vorticity(df: DataFrame, steps: tuple = (1.0, 1.0, 1.0), keys: list[str] = (), normalised: bool = False) -> DataFrame:
    """Curl, magnitudes and helicity of a field of (keys, x, y, z, u, v, w).

    ``normalised``: helicity of the unit vectors; vectors of at most 1e-6 stay as they are.
    """
    d = lambda c, a: derivative(c, a, steps["xyz".index(a)], keys)
    df = df.withColumns({"cu": d("w", "y") - d("v", "z"), "cv": d("u", "z") - d("w", "x"), "cw": d("v", "x") - d("u", "y")})
    size = lambda *c: F.sqrt(sum((F.col(x) * F.col(x) for x in c), F.lit(0.0)))
    dot = F.col("u") * F.col("cu") + F.col("v") * F.col("cv") + F.col("w") * F.col("cw")
    df = df.withColumns({"speed": size("u", "v", "w"), "curl": size("cu", "cv", "cw")})
    if normalised:
        unit = lambda c: F.when(F.col(c) > 1e-6, F.col(c)).otherwise(1.0)
        dot = dot / unit("speed") / unit("curl")
    return df.withColumn("helicity", dot)


def smoothed(df: DataFrame, radius: int = 1, sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing: the kernel is a product over axes, so each axis has a pass of its own.

    In a pass each cell gives weighted parts to its neighbours along the axis,
    added up before the shuffle; the next pass goes on from the sums of values
    and weights.
    """
    total = df.filter(~F.isnan("value")).select("m", "x", "y", "z", F.col("value").alias("v"), F.lit(1.0).alias("w"))
    parts = F.array(*[F.struct(F.lit(i).alias("d"), F.lit(math.exp(-i * i / (2 * sigma * sigma))).alias("k")) for i in range(-radius, radius + 1)])
    for axis in "xyz":
        given = total.withColumn("p", F.explode(parts))
        at = [(F.col(a) + F.col("p.d") if a == axis else F.col(a)).alias(a) for a in "xyz"]
        total = given.groupBy("m", *at).agg(F.sum(F.col("v") * F.col("p.k")).alias("v"), F.sum(F.col("w") * F.col("p.k")).alias("w"))
    cells = df.select("point_id", "x", "y", "z", "m")
    value = F.when(F.col("w") > 1e-5, F.col("v") / F.col("w")).otherwise(F.lit(float("nan")))
    return cells.join(total, ["x", "y", "z", "m"], "left").select("point_id", "m", value.alias("value"))


def sphere(df: DataFrame, centre: tuple, radius: float) -> DataFrame:
    apart = sum(((F.col(a) - c) * (F.col(a) - c) for a, c in zip("xyz", centre)), F.lit(0))
    return df.filter(F.sqrt(apart.cast("double")) <= radius)


def cube(df: DataFrame, centre: tuple, radius: float) -> DataFrame:
    return df.filter(F.greatest(*[F.abs(F.col(a) - c) for a, c in zip("xyz", centre)]) <= radius)


def sizes(df: DataFrame) -> tuple[int, int, int]:
    """Points along each axis, counted from 0: one row comes to the driver; none in an empty field."""
    return tuple(0 if v is None else v + 1 for v in df.agg(*[F.max(a) for a in "xyz"]).first())


def inner(df: DataFrame, sizes: tuple, radius: int) -> DataFrame:
    """Without the points within ``radius`` of the border."""
    ok = [F.col(a).between(radius, n - 1 - radius) for a, n in zip("xyz", sizes)]
    return df.filter(ok[0] & ok[1] & ok[2])


def crossing_cells(df: DataFrame, iso: float) -> DataFrame:
    """Cells of eight corners whose values lie on both sides of ``iso``, for each member.

    Corners are taken together axis by axis: each row meets the next along it.
    A cell with a corner that is missing or NaN crosses nothing.
    """
    df = df.filter(~F.isnan("value")).select("m", "x", "y", "z", F.col("value").alias("low"), F.col("value").alias("high"))
    for axis in "xyz":
        w = Window.partitionBy("m", *[a for a in "xyz" if a != axis]).orderBy(axis)
        low, high = F.least("low", F.lead("low").over(w)), F.greatest("high", F.lead("high").over(w))
        df = df.withColumns({"next": F.lead(axis).over(w), "low": low, "high": high}).filter(F.col("next") == F.col(axis) + 1)
    return df.filter((F.col("low") < iso) & (F.col("high") >= iso)).select("m", "x", "y", "z")


def neighbours(points: DataFrame, eps: float) -> DataFrame:
    """(id, n): points within eps, itself included; by a join on grid cells of width eps."""
    cell = lambda c: F.floor(F.col(c) / eps)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = points.select("id", "px", "py", F.explode(near).alias("o")).select("id", "px", "py", (cell("px") + F.col("o.i")).alias("ci"), (cell("py") + F.col("o.j")).alias("cj"))
    right = points.select(F.col("px").alias("qx"), F.col("py").alias("qy"), cell("px").alias("ci"), cell("py").alias("cj"))
    dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
    return left.join(right, ["ci", "cj"]).filter(F.sqrt(dx * dx + dy * dy) <= eps).groupBy("id").agg(F.count("*").alias("n"))


def transfer_weights(df: DataFrame, low: float, high: float, entries: int) -> DataFrame:
    """Add j, the lower transfer-function entry, and f, the weight of the entry above it.

    Values beyond the bounds belong to the outermost entries; NaN has neither j nor f.
    """
    at = F.coalesce(F.try_divide(F.col("value") - low, F.lit(high - low)), F.lit(0.0)) * (entries - 1)
    at = F.when(~F.isnan("value"), F.least(F.greatest(at, F.lit(0.0)), F.lit(entries - 1.0)))
    df = df.withColumn("f", at)
    j = F.when(F.col("f").isNotNull(), F.least(F.floor("f"), F.lit(entries - 2)).cast("int"))
    return df.withColumn("j", j).withColumn("f", F.col("f") - F.col("j"))


def normal_equations(df: DataFrame, target: Column) -> DataFrame:
    """(i, j, right, ata) of rows with j, f: the sums of weight products; row i = j + 1 pairs neighbours.

    The right side, A'b, has ``right`` and no j. Rows without j, and those of a target that is NaN or null, are left out.
    """
    f, g, j = F.col("f"), 1 - F.col("f"), F.col("j")
    none, yes, no = F.lit(None).cast("int"), F.lit(True), F.lit(False)
    rows = F.array(*[
        F.struct(a.alias("i"), b.alias("j"), right.alias("right"), w.alias("w"))
        for a, b, right, w in ((j, j, no, g * g), (j + 1, j + 1, no, f * f), (j + 1, j, no, f * g), (j, none, yes, g * target), (j + 1, none, yes, f * target))
    ])
    df = df.filter(j.isNotNull() & target.isNotNull() & ~F.isnan(target))
    return df.select(F.explode(rows).alias("r")).groupBy("r.i", "r.j", "r.right").agg(F.sum("r.w").alias("ata"))


def region(df: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """The points of a box, its bounds included."""
    ok = [F.col(a).between(lo, hi) for a, lo, hi in zip("xyz", low, high)]
    return df.filter(ok[0] & ok[1] & ok[2])


def masked(df: DataFrame, mask: DataFrame, keys: list[str] = ["point_id"]) -> DataFrame:  # noqa: B006
    """The points at which the mask field (keys, value) is above 0.5."""
    return df.join(mask.filter(~F.isnan("value") & (F.col("value") > 0.5)).select(*keys).distinct(), keys, "left_semi")


def subsampled(df: DataFrame, factor: int) -> DataFrame:
    """Every factor-th point along each axis, at its place in the smaller grid."""
    ok = [F.col(a) % factor == 0 for a in "xyz"]
    return df.filter(ok[0] & ok[1] & ok[2]).withColumns({a: F.floor(F.col(a) / factor) for a in "xyz"})


def transposed(df: DataFrame, axes: tuple = (0, 2, 1)) -> DataFrame:
    """The field with y and z exchanged, the one exchange of axes that is allowed."""
    if tuple(axes) != (0, 2, 1):
        raise ValueError(f"axes {axes}: only y and z can be exchanged")
    return df.withColumns({"y": F.col("z"), "z": F.col("y")})


def unit_positions(df: DataFrame, sizes: tuple) -> DataFrame:
    """Add px, py, pz in [-1, 1]; an axis of one point is at -1."""
    return df.withColumns({f"p{a}": F.col(a) / float(max(n - 1, 1)) * 2 - 1 for a, n in zip("xyz", sizes)})


def decoded(v: Column, bits: int) -> Column:
    """A stored whole number of 8 or 16 bits as a part of the largest one."""
    return v.cast("double") / float((1 << bits) - 1)


def centred(points: DataFrame, columns: tuple = ("px", "py", "pz"), size: float = 1.0) -> DataFrame:
    """Positions about their box's middle, scaled alike so that its longest side is ``size``."""
    bounds = points.agg(*[f(c).alias(f"{n}{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    longest = F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in columns])
    both = points.crossJoin(F.broadcast(bounds))  # bounds are one row
    placed = {c: F.coalesce(F.try_divide((F.col(c) - (F.col(f"lo{c}") + F.col(f"hi{c}")) / 2) * size, longest), F.lit(0.0)) for c in columns}
    return both.withColumns(placed).select(*points.columns)


def colour(v: Column, low: float, high: float, table: list[tuple[float, float, float, float]]) -> Column:
    """The (r, g, b, a) of a value by a transfer function of at most 256 entries, between its neighbours."""
    n = len(table)
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(v - low, F.lit(high - low)), F.lit(0.0)))) * (n - 1)
    entries = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in table])
    j = F.least(F.floor(at), F.lit(n - 1)).cast("int")
    f = at - j
    below, above = F.get(entries, j), F.get(entries, F.least(j + 1, F.lit(n - 1)))
    return F.zip_with(below, above, lambda a, b: a * (1 - f) + b * f)


def residual(first: Column, second: Column) -> Column:
    """Length of the difference of two colours, each premultiplied by its opacity."""
    part = lambda c, k: F.get(c, k) * (F.get(c, 3) if k < 3 else F.lit(1.0))
    return F.sqrt(sum(((part(first, k) - part(second, k)) * (part(first, k) - part(second, k)) for k in range(4)), F.lit(0.0)))


def trilinear(df: DataFrame, places: DataFrame, keys: list[str] = ["m"]) -> DataFrame:  # noqa: B006
    """Values between grid points: places (id, px, py, pz) to (id, keys, value).

    Each place asks its eight corners, which meet the field in one equi-join;
    corners outside the grid are left out, with their weight.
    """
    corner = [F.struct(*[F.lit(v).alias(a) for v, a in zip((i, j, k), "xyz")]) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    asked = places.withColumn("c", F.explode(F.array(*corner)))
    part = {a: F.col(f"p{a}") - F.floor(f"p{a}") for a in "xyz"}
    weight = F.lit(1.0)
    for a in "xyz":
        weight = weight * F.when(F.col(f"c.{a}") == 1, part[a]).otherwise(1 - part[a])
    asked = asked.select("id", weight.alias("w"), *[(F.floor(f"p{a}") + F.col(f"c.{a}")).alias(a) for a in "xyz"]).filter("w > 0")
    met = df.select("x", "y", "z", *keys, "value").join(asked, ["x", "y", "z"])
    return met.groupBy("id", *keys).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def slice_range(df: DataFrame, axis: str, place: float, keys: list[str] = ["m"]) -> DataFrame:  # noqa: B006
    """Smallest and largest value on a plane across an axis, between two layers of points."""
    low = math.floor(place)
    f = place - low
    rest = [a for a in "xyz" if a != axis]
    near = df.filter(F.col(axis).between(low, math.ceil(place)) & ~F.isnan("value"))
    w = F.when(F.col(axis) == low, 1 - f).otherwise(f)
    on = near.groupBy(*keys, *rest).agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))
    return on.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def composited(df: DataFrame, axis: str, emission: Column, density: Column, step: float = 1.0, keys: list[str] = ["m"]) -> DataFrame:  # noqa: B006
    """Front-to-back compositing along an axis: opacity is 1 - exp(-density * step).

    What reaches the eye of a point is the product of the transparencies in
    front of it, a running sum of their logarithms.
    """
    rest = [a for a in "xyz" if a != axis]
    front = Window.partitionBy(*keys, *rest).orderBy(axis).rowsBetween(Window.unboundedPreceding, -1)
    depth = density * step
    df = df.withColumns({"depth": depth, "before": F.coalesce(F.sum(depth).over(front), F.lit(0.0)), "light": emission})
    part = F.exp(-F.col("before")) * (1 - F.exp(-F.col("depth")))
    return df.groupBy(*keys, *rest).agg(F.sum(part * F.col("light")).alias("light"), F.sum(part).alias("opacity"))


def height_at(level: Column, heights: list[float]) -> Column:
    """The height of a place between two levels of a table of heights."""
    n = len(heights)
    table = F.array(*[F.lit(float(h)) for h in heights])
    at = F.greatest(F.lit(0.0), F.least(level, F.lit(float(n - 1))))
    j = F.floor(at).cast("int")
    return F.get(table, j) * (1 - (at - j)) + F.get(table, F.least(j + 1, F.lit(n - 1))) * (at - j)


def map_position(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude as places in [0, 1] of a world map."""
    return lon / 360 + 0.5, lat / 180 + 0.5


def scatter(df: DataFrame, first: int, second: int, padding: float = 0.05, across: bool = False) -> DataFrame:
    """(m, a, b) of two points' member vectors, with their padded ranges: their own, or those of the field."""
    rows = df.filter(F.col("point_id").isin(first, second))
    pick = lambda p: F.max(F.when(F.col("point_id") == p, F.col("value")))
    both = rows.groupBy("m").agg(pick(first).alias("a"), pick(second).alias("b"))
    if across:
        bounds = df.agg(F.min("value").alias("alo"), F.max("value").alias("ahi")).selectExpr("alo", "ahi", "alo AS blo", "ahi AS bhi")
    else:
        bounds = both.agg(F.min("a").alias("alo"), F.max("a").alias("ahi"), F.min("b").alias("blo"), F.max("b").alias("bhi"))
    pad = lambda c, sign: (F.col(f"{c}hi" if sign > 0 else f"{c}lo") + sign * padding * (F.col(f"{c}hi") - F.col(f"{c}lo")))
    out = both.crossJoin(F.broadcast(bounds))  # bounds are one row
    return out.select("m", "a", "b", pad("a", -1).alias("a_low"), pad("a", 1).alias("a_high"), pad("b", -1).alias("b_low"), pad("b", 1).alias("b_high"))
