"""Queries of point-wise maps, filters, sampling, features, clusters, fitting and learned estimators' parts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlark import twins
from gridlark.fields import embedding_field, holes, lineitem_field, placed
from gridlark.functions import sequences
from gridlark.operators import density, dependence, encodings, ensemble, features, fitting, grid, learned
from gridlark.plans import calculators
from gridlark.plans import described as plans
from gridlark.twins import CORR, E, H, L, bounds, rounded

# Two small transfer functions (red, green, blue, opacity) and heights of levels.
TABLES = (
    ((0.0, 0.0, 0.5, 0.1), (0.2, 0.6, 0.9, 0.4), (0.9, 0.9, 0.3, 0.7), (1.0, 0.1, 0.0, 1.0)),
    ((0.1, 0.2, 0.3, 0.9), (0.5, 0.5, 0.5, 0.2), (1.0, 0.8, 0.6, 0.5)),
)
HEIGHTS = (0.0, 1.0, 3.0, 6.0, 10.0)
RAMP = tuple(j / 7 for j in range(8))
LOW, HIGH = -0.5, 0.5


def identities(spark, sf):
    return rounded(lineitem_field(spark, sf).select("point_id", "t", "m", F.col("quantity").alias("first"), F.col("tax").alias("second")))


def helicity_normalised(spark, sf):
    df = grid.vorticity(grid.velocity(embedding_field(spark, sf)), normalised=True)
    return rounded(df.select("point_id", "helicity"))


def residual_colour(spark, sf):
    v = F.col("value")
    one, two = grid.colour(v, LOW, HIGH, TABLES[0]), grid.colour(v * v, 0.0, HIGH, TABLES[1])
    df = holes(embedding_field(spark, sf)).withColumns({"one": one, "two": two})
    value = F.when(F.isnan("value"), 0.0).otherwise(grid.residual(F.col("one"), F.col("two")))
    return rounded(df.select("point_id", "m", value.alias("value")))


def decoded(spark, sf):
    stored = F.floor(F.least(F.abs("value"), F.lit(1.0)) * 255)
    return rounded(embedding_field(spark, sf).select("point_id", "m", grid.decoded(stored, 8).alias("value")))


def unit_positions(spark, sf):
    df = embedding_field(spark, sf).filter("m = 0")
    return rounded(grid.unit_positions(df, grid.sizes(df)).select("point_id", "px", "py", "pz"))


def centred(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    df = df.select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("px", "py", "pz"))])
    return rounded(grid.centred(df))


def masked(spark, sf):
    df = embedding_field(spark, sf)
    mask = df.groupBy("point_id").agg(F.when(F.avg("value") > 0, 1.0).otherwise(0.0).alias("value"))
    return rounded(grid.masked(df, mask).select("point_id", "m", "value"))


def trilinear(spark, sf):
    i = F.col("id").cast("double")
    places = spark.range(50).select("id", (i * 0.37 % 9).alias("px"), (i * 0.71 % 9).alias("py"), (i * 0.23 % 4).alias("pz"))
    return rounded(grid.trilinear(embedding_field(spark, sf), places))


def composited(spark, sf):
    v = F.abs("value")
    return rounded(grid.composited(embedding_field(spark, sf), "z", v, v))


def heights(spark, sf):
    df = embedding_field(spark, sf).filter("m = 0")
    return rounded(df.select("point_id", grid.height_at(F.col("z") + F.col("x") % 2 * 0.5, HEIGHTS).alias("height")))


def map_positions(spark, sf):
    u, v = grid.map_position(F.col("x") * 36.0 - 180, F.col("y") * 18.0 - 90)
    return rounded(embedding_field(spark, sf).filter("m = 0").select("point_id", u.alias("u"), v.alias("v")))


def _placed(df):
    return rounded(df.select("x", "y", "z", "m", "value"))


def neighbourhood_features(spark, sf):
    df = embedding_field(spark, sf)
    return rounded(features.neighbourhood_features(df, grid.sizes(df)))


def sampled_points(spark, sf):
    df = embedding_field(spark, sf)
    return features.sampled_points(spark, grid.sizes(df), 50, border=1)


def clusters(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    df = df.select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("px", "py"))])
    x0, x1, y0, y1 = df.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    return density.dbscan(df, 0.05 * ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5, 8)


def _weighted(spark, sf):
    df = embedding_field(spark, sf)
    return grid.transfer_weights(df, *bounds(df), 8)


def _square():
    return F.col("value") * F.col("value")


def smoothing_prior(spark, sf):
    table = spark.range(8).select(F.col("id").cast("int").alias("j"), (F.col("id") * F.col("id")).cast("double").alias("value"))
    return rounded(fitting.smoothing_prior(table, 2.0))


def divergence_bound(spark, sf):
    df = dependence.with_reference(embedding_field(spark, sf), 0)
    own = Window.partitionBy("point_id").orderBy("m")
    nxt = F.coalesce(F.lead("b").over(own), F.first("b").over(own))
    df = df.withColumns({"joint": F.col("a") * F.col("b"), "shuffled": F.col("a") * nxt})
    return rounded(learned.divergence_bound(df))


def symmetrised(spark, sf):
    df = embedding_field(spark, sf)
    df = learned.combined(df, *bounds(df), grid.sizes(df))
    ref = df.filter("point_id = 0").select("m", F.col("features").alias("r"))  # a row for each member
    both = df.join(F.broadcast(ref), "m")
    both = both.select("point_id", "m", F.posexplode(F.concat(learned.symmetrised(F.col("r"), F.col("features"), "add_diff"), learned.symmetrised(F.col("r"), F.col("features"), "mul"))).alias("k", "value"))
    return rounded(both.groupBy("point_id", "k").agg(F.sum("value").alias("value")))


def on_valid(spark, sf):
    mean = lambda df: df.groupBy("point_id").agg(F.avg("value").alias("value"))
    return rounded(learned.on_valid(holes(embedding_field(spark, sf)), mean))


def encoded_positions(spark, sf):
    """Grid places by two grids of features, the second one hashed, whose slots hold means of the vectors' components."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("point_id", F.col("vec_id"))
    grids = encodings.levels(2, 3, 2.0, 6)
    held = [F.struct(F.lit(n).alias("level"), (F.col("vec_id") % g.slots).alias("slot"), F.slice("embedding", 2 * n + 1, 2).alias("f")) for n, g in enumerate(grids)]
    table = df.select(F.explode(F.array(*held)).alias("h")).groupBy("h.level", "h.slot").agg(F.array(*[F.avg(F.get("h.f", F.lit(k)).cast("double")) for k in (0, 1)]).alias("features"))
    at = placed(df.select("point_id")).select("point_id", *[(F.col(a) / 10.0).alias(f"p{a}") for a in "xyz"])
    return rounded(encodings.grid_encoded(at, table, grids, 2, ["point_id"]).select("point_id", F.posexplode("features").alias("k", "value")))


def described(spark, sf):
    """The strongest pairs of blocks in a box, as a description in JSON."""
    text = plans.saved(
        {"field": "embeddings", "folder": sf}, {"op": "region", "low": [1, 1, 0], "high": [8, 8, 9]}, {"op": "filter", "where": "m < 32"},
        {"op": "block_means", "factor": 4}, {"op": "mean_pairs", "measure": "pearson", "absolute": True}, {"op": "strongest", "k": 5},
    )
    out = plans.run(spark, text)
    return rounded(out.select(*[F.col(c)[b].alias(f"{c}{b[1]}") for c in "ij" for b in ("bx", "by", "bz")], "value"))


def calculated(spark, sf):
    """Three calculators that use each other: how far the smoothed squares of a field are from its spread."""
    said = {
        "sources": {"value": {"field": "embeddings", "folder": sf}},
        "calculators": [
            {"name": "apart", "op": "absolute_difference", "inputs": ["smooth", "spread"]},
            {"name": "smooth", "op": "smoothed", "inputs": ["squares"], "radius": 1},
            {"name": "squares", "op": "product", "inputs": ["value", "value"]},
            {"name": "spread", "op": "spread", "inputs": ["value"]},
        ],
    }
    return rounded(calculators.Fields(spark, json.dumps(said))["apart"].select("point_id", "m", "value"))


QUERIES = {
    "calculated": calculated,
    "described": described,
    "encoded_positions": encoded_positions,
    "identities": identities,
    "helicity_normalised": helicity_normalised,
    "residual_colour": residual_colour,
    "decoded": decoded,
    "divergent_range": lambda s, d: rounded(ensemble.divergent_range(holes(embedding_field(s, d)))),
    "unit_positions": unit_positions,
    "centred": centred,
    "region_box": lambda s, d: rounded(grid.region(embedding_field(s, d), (2, 2, 1), (7, 7, 3)).select("point_id", "m", "value")),
    "masked": masked,
    "subsampled": lambda s, d: _placed(grid.subsampled(embedding_field(s, d), 2)),
    "transposed": lambda s, d: _placed(grid.transposed(embedding_field(s, d))),
    "trilinear": trilinear,
    "slice_range": lambda s, d: rounded(grid.slice_range(holes(embedding_field(s, d)), "z", 1.25)),
    "composited": composited,
    "heights": heights,
    "map_positions": map_positions,
    "scatter": lambda s, d: rounded(grid.scatter(embedding_field(s, d), 0, 1)),
    "scatter_across": lambda s, d: rounded(grid.scatter(embedding_field(s, d), 0, 1, across=True)),
    "neighbourhood_features": neighbourhood_features,
    "point_features": lambda s, d: rounded(features.point_features(holes(embedding_field(s, d)))),
    "member_features": lambda s, d: rounded(features.member_features(holes(embedding_field(s, d)))),
    "sampled_points": sampled_points,
    "clusters": clusters,
    "tf_losses": lambda s, d: rounded(fitting.losses(_weighted(s, d), _square(), list(RAMP))),
    "tf_gradient_l2": lambda s, d: rounded(fitting.gradient(_weighted(s, d), _square(), list(RAMP))),
    "tf_gradient_l1": lambda s, d: rounded(fitting.gradient(_weighted(s, d), _square(), list(RAMP), "l1")),
    "tf_smoothing_prior": smoothing_prior,
    "tf_solved": lambda s, d: rounded(fitting.solved(_weighted(s, d), _square(), 8)),
    "tf_adam": lambda s, d: rounded(fitting.descended(_weighted(s, d), _square(), 8)),
    "divergence_bound": divergence_bound,
    "symmetrised": symmetrised,
    "on_valid": on_valid,
}

_N = ", n AS (SELECT max(x) + 1 AS xs, max(y) + 1 AS ys, max(z) + 1 AS zs FROM e)"


def _colour(v: str, low: float, high: float, table: tuple) -> str:
    n = len(table)
    at = f"greatest(0::DOUBLE, least(1::DOUBLE, ({v} - {low}::DOUBLE) / ({high - low}::DOUBLE))) * {n - 1}"
    rows = [[float(c) for c in r] for r in table]
    parts = []
    for k in range(4):
        c = "[" + ", ".join(f"{r[k]}::DOUBLE" for r in rows) + "]"
        parts.append(f"{c}[floor({at})::INT + 1] * (1 - ({at} - floor({at}))) + {c}[least(floor({at})::INT + 2, {n})] * ({at} - floor({at}))")
    return ", ".join(f"{p}" for p in parts)


_COLOURS = f"""c AS (SELECT point_id, m, v, [{_colour('v', LOW, HIGH, TABLES[0])}] AS p, [{_colour('(v * v)', 0.0, HIGH, TABLES[1])}] AS q FROM h)"""
_W = E + """, g AS (SELECT min(v) AS lo, max(v) AS hi FROM e), tf AS (SELECT point_id, m, v, (v - lo) / (hi - lo) * 7 AS u FROM e, g),
 w AS (SELECT v, least(floor(u), 6)::INT AS j, u - least(floor(u), 6) AS f FROM tf), d AS (SELECT j, f, (j / 7.0::DOUBLE * (1 - f) + (j + 1) / 7.0::DOUBLE * f) - v * v AS d FROM w)"""
_GRADIENT = "WITH " + _W + " SELECT i, round(sum(g) / (SELECT count(*) FROM d), 9) AS value FROM (SELECT j AS i, {g} * (1 - f) AS g FROM d UNION ALL SELECT j + 1, {g} * f FROM d) GROUP BY i"
_SIGN = "CASE WHEN d >= 0 THEN 1 ELSE -1 END"
_F = E + _N + """, g AS (SELECT min(v) AS lo, max(v) AS hi FROM e), c AS (SELECT point_id, m, [(v - lo) / (hi - lo), x / greatest(xs - 1, 1)::DOUBLE * 2 - 1,
 y / greatest(ys - 1, 1)::DOUBLE * 2 - 1, z / greatest(zs - 1, 1)::DOUBLE * 2 - 1] AS f FROM e, g, n)"""
_POINTS = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py FROM embeddings), g AS (SELECT 0.05::DOUBLE * sqrt((max(px) - min(px)) ** 2 + (max(py) - min(py)) ** 2) AS eps FROM p)"
_S3 = [f"(0.5::DOUBLE + {a!r}::DOUBLE * (i + 1))" for a in sequences.plastic_steps(3)]
_CELL = lambda k, n: f"least(greatest(floor((({_S3[k]} - floor({_S3[k]}))::FLOAT)::DOUBLE * {n}), 0), {n} - 1)::BIGINT"

ORACLE_SQL = {
    "encoded_positions": """WITH g(level, scale, side, slots) AS (VALUES (0, 2.0::DOUBLE, 3, 32), (1, 5.0::DOUBLE, 6, 64)), c AS (SELECT a.r AS i, b.r AS j, d.r AS k FROM range(2) a(r), range(2) b(r), range(2) d(r)),
 p AS (SELECT vec_id AS point_id, level, side, slots, scale * ((vec_id % 10) / 10.0::DOUBLE) + 0.5 AS x, scale * ((vec_id // 10 % 10) / 10.0::DOUBLE) + 0.5 AS y, scale * ((vec_id // 100) / 10.0::DOUBLE) + 0.5 AS z FROM embeddings, g),
 v AS (SELECT point_id, level, side, slots, floor(x)::BIGINT + i AS x, floor(y)::BIGINT + j AS y, floor(z)::BIGINT + k AS z,
 (CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN k = 1 THEN z - floor(z) ELSE 1 - z + floor(z) END) AS w FROM p, c),
 s AS (SELECT point_id, level, w, (CASE WHEN side ** 3 > slots THEN xor(xor(x * 1958374283 % 4294967296, y * 2654435761 % 4294967296), z * 805459861 % 4294967296) ELSE x + side * y + side * side * z END) % slots AS slot FROM v),
 f AS (SELECT level, vec_id % slots AS slot, k, avg(embedding[2 * level + k + 1]::DOUBLE) AS f FROM embeddings, g, range(2) r(k) GROUP BY 1, 2, 3),
 a AS (SELECT point_id, s.level, r.k, sum(w * coalesce(f, 0)) AS value FROM s JOIN range(2) r(k) ON true LEFT JOIN f ON f.level = s.level AND f.slot = s.slot AND f.k = r.k GROUP BY 1, 2, 3)
 SELECT point_id, (2 * level + k)::INT AS k, round(value, 9) AS value FROM a""",
    "calculated": f"""WITH {E}, w AS (SELECT *, exp(-((dx * dx + dy * dy + dz * dz) / 2.0::DOUBLE)) AS k FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dz)),
 g AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z, m, sum(v * v * k) / sum(k) AS smooth FROM e, w GROUP BY 1, 2, 3, 4), d AS (SELECT point_id, stddev_samp(v) AS spread FROM e GROUP BY 1)
 SELECT e.point_id, e.m::INT AS m, round(abs(smooth - spread), 9) AS value FROM e JOIN g USING (x, y, z, m) JOIN d ON d.point_id = e.point_id""",
    "described": f"""WITH {E}, b AS (SELECT x // 4 AS bx, y // 4 AS b2, z // 4 AS bz, m, avg(v) AS v FROM e WHERE x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8 AND z <= 9 AND m < 32 GROUP BY 1, 2, 3, 4),
 p AS (SELECT i.bx AS ix, i.b2 AS iy, i.bz AS iz, j.bx AS jx, j.b2 AS jy, j.bz AS jz, i.v AS a, j.v AS b FROM b i JOIN b j ON i.m = j.m AND (i.bz, i.b2, i.bx) > (j.bz, j.b2, j.bx))
 SELECT ix, iy, iz, jx, jy, jz, round(abs({CORR}), 9) AS value FROM p GROUP BY 1, 2, 3, 4, 5, 6 ORDER BY abs({CORR}) DESC LIMIT 5""",
    "identities": f"WITH {L} SELECT point_id, t::INT AS t, m, round(q, 9) AS first, round(tax, 9) AS second FROM l",
    "helicity_normalised": f"""WITH {E}, u AS (SELECT point_id, x, y, z, max(v) FILTER (m = 0) AS u, max(v) FILTER (m = 1) AS v, max(v) FILTER (m = 2) AS w FROM e GROUP BY ALL),
 c AS (SELECT *, {twins.derivative('w', 'y')} - {twins.derivative('v', 'z')} AS cu, {twins.derivative('u', 'z')} - {twins.derivative('w', 'x')} AS cv,
 {twins.derivative('v', 'x')} - {twins.derivative('u', 'y')} AS cw FROM u), s AS (SELECT *, sqrt(u * u + v * v + w * w) AS a, sqrt(cu * cu + cv * cv + cw * cw) AS b FROM c)
 SELECT point_id, round((u * cu + v * cv + w * cw) / CASE WHEN a > 1e-6 THEN a ELSE 1 END / CASE WHEN b > 1e-6 THEN b ELSE 1 END, 9) AS helicity FROM s""",
    "residual_colour": f"""WITH {H}, {_COLOURS} SELECT point_id, m::INT AS m, round(CASE WHEN v IS NULL THEN 0 ELSE
 sqrt((p[1] * p[4] - q[1] * q[4]) ** 2 + (p[2] * p[4] - q[2] * q[4]) ** 2 + (p[3] * p[4] - q[3] * q[4]) ** 2 + (p[4] - q[4]) ** 2) END, 9) AS value FROM c""",
    "decoded": f"WITH {E} SELECT point_id, m::INT AS m, round(floor(least(abs(v), 1) * 255) / 255, 9) AS value FROM e",
    "divergent_range": f"WITH {H} SELECT point_id, round(-greatest(abs(min(v)), abs(max(v))), 9) AS low, round(greatest(abs(min(v)), abs(max(v))), 9) AS high FROM h GROUP BY 1",
    "unit_positions": f"""WITH {E}{_N} SELECT point_id, round(x / greatest(xs - 1, 1)::DOUBLE * 2 - 1, 9) AS px, round(y / greatest(ys - 1, 1)::DOUBLE * 2 - 1, 9) AS py,
 round(z / greatest(zs - 1, 1)::DOUBLE * 2 - 1, 9) AS pz FROM e, n WHERE m = 0""",
    "centred": """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS pz FROM embeddings),
 b AS (SELECT min(px) AS ax, max(px) AS bx, min(py) AS ay, max(py) AS by, min(pz) AS az, max(pz) AS bz FROM p), s AS (SELECT *, greatest(b.bx - b.ax, b.by - b.ay, b.bz - b.az) AS s FROM b)
 SELECT vec_id, round((px - (s.ax + s.bx) / 2) / s.s, 9) AS px, round((py - (s.ay + s.by) / 2) / s.s, 9) AS py, round((pz - (s.az + s.bz) / 2) / s.s, 9) AS pz FROM p, s""",
    "region_box": f"WITH {E} SELECT point_id, m::INT AS m, round(v, 9) AS value FROM e WHERE x BETWEEN 2 AND 7 AND y BETWEEN 2 AND 7 AND z BETWEEN 1 AND 3",
    "masked": f"WITH {E} SELECT point_id, m::INT AS m, round(v, 9) AS value FROM e WHERE point_id IN (SELECT point_id FROM e GROUP BY 1 HAVING avg(v) > 0)",
    "subsampled": f"WITH {E} SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, m::INT AS m, round(v, 9) AS value FROM e WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0",
    "transposed": f"WITH {E} SELECT x, z AS y, y AS z, m::INT AS m, round(v, 9) AS value FROM e",
    "trilinear": f"""WITH {E}, q AS (SELECT id, id * 0.37::DOUBLE % 9 AS px, id * 0.71::DOUBLE % 9 AS py, id * 0.23::DOUBLE % 4 AS pz FROM range(50) r(id)),
 w AS (SELECT id, m, v, greatest(1 - abs(x - px), 0) * greatest(1 - abs(y - py), 0) * greatest(1 - abs(z - pz), 0) AS w FROM e JOIN q ON abs(x - px) < 1 AND abs(y - py) < 1 AND abs(z - pz) < 1)
 SELECT id, m::INT AS m, round(sum(v * w) / sum(w), 9) AS value FROM w GROUP BY 1, 2""",
    "slice_range": f"""WITH {H}, s AS (SELECT m, x, y, sum(v * w) / sum(w) AS v FROM (SELECT *, CASE WHEN z = 1 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS w FROM h WHERE z IN (1, 2) AND v IS NOT NULL) GROUP BY 1, 2, 3)
 SELECT m::INT AS m, round(min(v), 9) AS low, round(max(v), 9) AS high FROM s GROUP BY 1""",
    "composited": f"""WITH {E}, b AS (SELECT *, coalesce(sum(abs(v)) OVER (PARTITION BY m, x, y ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
 SELECT m::INT AS m, x, y, round(sum(exp(-before) * (1 - exp(-abs(v))) * abs(v)), 9) AS light, round(sum(exp(-before) * (1 - exp(-abs(v)))), 9) AS opacity FROM b GROUP BY 1, 2, 3""",
    "heights": f"""WITH {E}, l AS (SELECT point_id, least(z + x % 2 * 0.5::DOUBLE, 4) AS l, {[float(h) for h in HEIGHTS]!r}::DOUBLE[] AS h FROM e WHERE m = 0)
 SELECT point_id, round(h[floor(l)::INT + 1] * (1 - (l - floor(l))) + h[least(floor(l)::INT + 2, 5)] * (l - floor(l)), 9) AS height FROM l""",
    "map_positions": f"WITH {E} SELECT point_id, round((x * 36.0::DOUBLE - 180) / 360 + 0.5::DOUBLE, 9) AS u, round((y * 18.0::DOUBLE - 90) / 180 + 0.5::DOUBLE, 9) AS v FROM e WHERE m = 0",
    "scatter": f"""WITH {E}, p AS (SELECT m, max(v) FILTER (point_id = 0) AS a, max(v) FILTER (point_id = 1) AS b FROM e GROUP BY 1),
 g AS (SELECT min(a) AS al, max(a) AS ah, min(b) AS bl, max(b) AS bh FROM p) SELECT m::INT AS m, round(a, 9) AS a, round(b, 9) AS b, round(al - 0.05::DOUBLE * (ah - al), 9) AS a_low,
 round(ah + 0.05::DOUBLE * (ah - al), 9) AS a_high, round(bl - 0.05::DOUBLE * (bh - bl), 9) AS b_low, round(bh + 0.05::DOUBLE * (bh - bl), 9) AS b_high FROM p, g""",
    "scatter_across": f"""WITH {E}, p AS (SELECT m, max(v) FILTER (point_id = 0) AS a, max(v) FILTER (point_id = 1) AS b FROM e GROUP BY 1), g AS (SELECT min(v) AS l, max(v) AS h FROM e)
 SELECT m::INT AS m, round(a, 9) AS a, round(b, 9) AS b, round(l - 0.05::DOUBLE * (h - l), 9) AS a_low, round(h + 0.05::DOUBLE * (h - l), 9) AS a_high,
 round(l - 0.05::DOUBLE * (h - l), 9) AS b_low, round(h + 0.05::DOUBLE * (h - l), 9) AS b_high FROM p, g""",
    "neighbourhood_features": f"""WITH {E}{_N}, o AS (SELECT (i + 1) + 3 * (j + 1) + 9 * (k + 1) AS n, i, j, k FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k)),
 q AS (SELECT DISTINCT x, y, z, o.n, least(greatest(x + i, 0), xs - 1) AS qx, least(greatest(y + j, 0), ys - 1) AS qy, least(greatest(z + k, 0), zs - 1) AS qz FROM e, o, n),
 p AS (SELECT q.x, q.y, q.z, q.n, s.v AS a, t.v AS b FROM q JOIN e s ON s.x = q.x AND s.y = q.y AND s.z = q.z JOIN e t ON t.x = qx AND t.y = qy AND t.z = qz AND t.m = s.m)
 SELECT x, y, z, n::INT AS k, round({CORR}, 9) AS value FROM p GROUP BY x, y, z, n""",
    "point_features": f"WITH {H} SELECT point_id, m::INT AS k, round(coalesce(v, 0), 9) AS value FROM h",
    "member_features": f"WITH {H} SELECT m::INT AS m, point_id AS k, round(coalesce(v, 0), 9) AS value FROM h",
    "sampled_points": f"""WITH {E}{_N}, c AS (SELECT i, {_CELL(0, 'xs')} AS x, {_CELL(1, 'ys')} AS y, {_CELL(2, 'zs')} AS z FROM range(5000) r(i), n)
 SELECT x, y, z FROM c, n WHERE x BETWEEN 1 AND xs - 2 AND y BETWEEN 1 AND ys - 2 AND z BETWEEN 1 AND zs - 2 GROUP BY x, y, z ORDER BY min(i) LIMIT 50""",
    "clusters": f"""WITH RECURSIVE {_POINTS}, l AS (SELECT a.id, b.id AS other FROM p a, p b, g WHERE sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) <= eps),
 k AS (SELECT id FROM l GROUP BY id HAVING count(*) >= 8), c AS (SELECT l.id, l.other FROM l JOIN k ON k.id = l.id JOIN k o ON o.id = l.other),
 r AS (SELECT id, id AS label FROM k UNION SELECT c.other, r.label FROM r JOIN c ON c.id = r.id), b AS (SELECT id, min(label) AS cluster FROM r GROUP BY id)
 SELECT id, cluster FROM b UNION ALL SELECT l.id, min(b.cluster) FROM l JOIN b ON b.id = l.other WHERE l.id NOT IN (SELECT id FROM k) GROUP BY l.id""",
    "tf_losses": f"WITH {_W} SELECT round(avg(abs(d)), 9) AS l1, round(avg(d * d), 9) AS l2 FROM d",
    "tf_gradient_l2": _GRADIENT.format(g="2 * d"),
    "tf_gradient_l1": _GRADIENT.format(g=_SIGN),
    "tf_smoothing_prior": "SELECT j::INT AS j, round(2.0::DOUBLE * (coalesce(v - lag(v) OVER (ORDER BY j), 0) + coalesce(v - lead(v) OVER (ORDER BY j), 0)) / 14, 9) AS value FROM (SELECT j, (j * j)::DOUBLE AS v FROM range(8) r(j))",
    "divergence_bound": f"""WITH {twins.P}, s AS (SELECT point_id, a * b AS j, a * coalesce(lead(b) OVER w, first_value(b) OVER w) AS s FROM p WINDOW w AS (PARTITION BY point_id ORDER BY m))
 SELECT point_id, round(greatest(avg(j) - ln(avg(exp(s))), 0), 9) AS value FROM s GROUP BY 1""",
    "symmetrised": f"""WITH {_F}, b AS (SELECT c.point_id, r.f AS r, c.f AS q FROM c JOIN c r ON r.m = c.m AND r.point_id = 0),
 k AS (SELECT point_id, unnest(range(12)) AS k, unnest([r[1] + q[1], r[2] + q[2], r[3] + q[3], r[4] + q[4], abs(r[1] - q[1]), abs(r[2] - q[2]), abs(r[3] - q[3]), abs(r[4] - q[4]),
 r[1] * q[1], r[2] * q[2], r[3] * q[3], r[4] * q[4]]) AS v FROM b) SELECT point_id, k::INT AS k, round(sum(v), 9) AS value FROM k GROUP BY 1, 2""",
    "on_valid": f"WITH {H} SELECT point_id, CASE WHEN count(*) > count(v) THEN 'NaN'::DOUBLE ELSE round(avg(v), 9) END AS value FROM h GROUP BY 1",
}
