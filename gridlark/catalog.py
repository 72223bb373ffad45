"""Registered queries of the field operators, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark import catalog_grid, catalog_hierarchy, catalog_measures, catalog_regions
from gridlark.fields import embedding_field, event_series, holes, lineitem_field
from gridlark.functions.measures import default_k, mi_coefficient, psi, valid
from gridlark.operators import dependence, ensemble, grid, regions, similarity
from gridlark.twins import CORR as _CORR
from gridlark.twins import PSI as _PSI
from gridlark.twins import E as _E
from gridlark.twins import H as _H
from gridlark.twins import L as _L
from gridlark.twins import P as _P
from gridlark.twins import bounds as _bounds
from gridlark.twins import derivative as _d
from gridlark.twins import rounded

MEMBERS = 64


def _reference(measure, **more):
    return lambda spark, sf: rounded(measure(dependence.with_reference(embedding_field(spark, sf), 0), **more))


def reference_mi_binned(spark, sf):
    df = embedding_field(spark, sf)
    low, high = _bounds(df)
    out = dependence.mi_binned(dependence.with_reference(df, 0), low, high, 80)
    return rounded(out.withColumn("coefficient", mi_coefficient(F.col("value"))))


def field_minmax(spark, sf):
    return _minmax(embedding_field(spark, sf))


def _minmax(df):
    v = valid(F.col("value"))
    return rounded(df.groupBy("m").agg(F.min(v).alias("low"), F.max(v).alias("high")))


def histogram(spark, sf):
    df = embedding_field(spark, sf)
    return rounded(ensemble.histogram(df, *_bounds(df), 50))


def histogram_holes(spark, sf):
    """With holes, and bounds that leave values out on both sides."""
    df = holes(embedding_field(spark, sf))
    low, high = _bounds(df)
    return rounded(ensemble.histogram(df, low / 2, high / 2, 50))


def block_pairs(spark, sf):
    return catalog_regions.numbered(regions.mean_pairs(ensemble.block_means(embedding_field(spark, sf), 3), least=0.2))


def _two_spreads(spark, sf):
    df = holes(embedding_field(spark, sf))
    return ensemble.two_block_spreads(df, df.withColumn("value", F.col("value") * F.col("value")), 3)


def named_velocity(spark, sf):
    """Curl of a velocity whose components are variables of their own names, for each year and line number."""
    df = lineitem_field(spark, sf).withColumnRenamed("m", "e")
    named = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(c).alias("value")) for n, c in (("U", "quantity"), ("V", "discount"), ("W", "tax"))])
    df = df.select("t", "e", "point_id", "x", "y", "z", F.inline(named))
    out = grid.vorticity(grid.named_velocity(df), keys=["t", "e"])
    return rounded(out.select("point_id", "t", "e", "cu", "cv", "cw", "helicity"))


def binary_operators(spark, sf):
    df = lineitem_field(spark, sf)
    return rounded(df.select("point_id", "t", "m", *[c.alias(n) for n, c in grid.binary(F.col("quantity"), F.col("tax")).items()]))


def vorticity(spark, sf):
    df = grid.vorticity(grid.velocity(embedding_field(spark, sf)))
    return rounded(df.select("point_id", "cu", "cv", "cw", "speed", "curl", "helicity"))


def variable_matrix(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    names = ["quantity", "extendedprice", "discount", "tax"]
    df = df.select(*[F.col(f"l_{n}").alias(n) for n in names])
    return rounded(similarity.similarity_matrix(df, names))


def variables_at_points(spark, sf):
    df = lineitem_field(spark, sf).select("point_id", "t", "m", F.col("quantity").alias("a"), F.col("extendedprice").alias("b"))
    full = df.groupBy("point_id", "t").agg(F.count("*").alias("n")).filter("n >= 3").drop("n")
    return rounded(dependence.pearson(df.join(full, ["point_id", "t"]), ["point_id", "t"]))


def cluster_cores(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    df = df.select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("px", "py"))])
    x0, x1, y0, y1 = df.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    found = grid.neighbours(df, 0.05 * ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5)
    return found.withColumn("core", F.col("n") >= 8)


def transfer_function(spark, sf):
    df = embedding_field(spark, sf)
    df = grid.transfer_weights(df, *_bounds(df), 8)
    entry = lambda j: j / 7.0
    red = entry(F.col("j")) * (1 - F.col("f")) + entry(F.col("j") + 1) * F.col("f")
    return rounded(df.select("point_id", "m", "j", "f", red.alias("red")))


def inner_points(spark, sf):
    df = embedding_field(spark, sf)
    return rounded(grid.inner(df, grid.sizes(df), 1).select("point_id", "m", "value"))


def normal_equations(spark, sf):
    df = embedding_field(spark, sf)
    df = grid.transfer_weights(df, *_bounds(df), 8)
    return _equations(df)


def _equations(df):
    df = grid.normal_equations(df, F.col("value") * F.col("value"))
    return rounded(df.select("i", F.when(F.col("right"), -1).otherwise(F.col("j")).alias("j"), "ata"))


def normal_equations_holes(spark, sf):
    """With holes, and bounds within the values on both sides."""
    df = holes(embedding_field(spark, sf))
    low, high = _bounds(df)
    return _equations(grid.transfer_weights(df, low / 2, high / 2, 8))


QUERIES = {
    "reference_pearson": _reference(dependence.pearson),
    "reference_spearman": _reference(dependence.spearman),
    "reference_kendall": _reference(dependence.kendall),
    "reference_mi_ksg": _reference(dependence.mi_ksg),
    "reference_mi_binned": reference_mi_binned,
    "ensemble_mean_spread": lambda s, d: rounded(ensemble.mean_and_spread(holes(embedding_field(s, d)))),
    "set_predicate": lambda s, d: rounded(ensemble.set_predicate(holes(embedding_field(s, d)), ">", 0.0, 20, 40)),
    "kl_binned": lambda s, d: rounded(ensemble.kl_binned(embedding_field(s, d))),
    "kl_knn": lambda s, d: rounded(ensemble.kl_knn(embedding_field(s, d), 3)),
    "field_minmax": field_minmax,
    "histogram": histogram,
    "block_means": lambda s, d: rounded(ensemble.block_means(holes(embedding_field(s, d)), 3)),
    "block_spread": lambda s, d: rounded(ensemble.block_spread(embedding_field(s, d), 3)),
    "block_spread_two_fields": lambda s, d: rounded(_two_spreads(s, d)),
    "block_spread_range": lambda s, d: rounded(ensemble.spread_range(_two_spreads(s, d), ["first", "second"])),
    "named_velocity": named_velocity,
    "block_pairs": block_pairs,
    "windowed_correlation": lambda s, d: rounded(dependence.windowed(event_series(s, d), "click", 32)),
    "binary_operators": binary_operators,
    "vorticity": vorticity,
    "smoothed": lambda s, d: rounded(grid.smoothed(holes(embedding_field(s, d)))),
    "variable_matrix": variable_matrix,
    "variables_at_points": variables_at_points,
    "sphere": lambda s, d: rounded(grid.sphere(embedding_field(s, d), (4, 4, 2), 3.0).select("point_id", "m", "value")),
    "cube": lambda s, d: rounded(grid.cube(embedding_field(s, d), (4, 4, 2), 2).select("point_id", "m", "value")),
    "inner_points": inner_points,
    "crossing_cells": lambda s, d: grid.crossing_cells(embedding_field(s, d), 0.1),
    "cluster_cores": cluster_cores,
    "transfer_function": transfer_function,
    "normal_equations": normal_equations,
    "field_minmax_holes": lambda s, d: _minmax(holes(embedding_field(s, d))),
    "histogram_holes": histogram_holes,
    "crossing_cells_holes": lambda s, d: grid.crossing_cells(holes(embedding_field(s, d)), 0.1),
    "normal_equations_holes": normal_equations_holes,
}

_Z = _E + """, s AS (SELECT point_id, m, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS u, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY point_id))"""
_K = default_k(MEMBERS)
_F = _E + """, g AS (SELECT min(v) AS lo, max(v) AS hi FROM e), tf AS (SELECT point_id, m, v, (v - lo) / (hi - lo) * 7 AS u FROM e, g),
 w AS (SELECT point_id, m::INT AS m, v, least(floor(u), 6)::INT AS j, u - least(floor(u), 6) AS f FROM tf)"""

_SPREADS = _H + """, q AS (SELECT point_id, x, y, z, var_samp(v) AS s, var_samp(v * v) AS r FROM h GROUP BY ALL),
 b AS (SELECT x // 3 AS bx, y // 3 AS by, z // 3 AS bz, sqrt(avg(s)) * 0.5::DOUBLE AS a, sqrt(avg(r)) * 0.5::DOUBLE AS b FROM q GROUP BY 1, 2, 3)"""


def _dk(c, axis):
    """The derivative within each t and e."""
    return _d(c, axis).replace("PARTITION BY ", "PARTITION BY t, e, ")


ORACLE_SQL = {
    "reference_pearson": f"WITH {_P} SELECT point_id, round({_CORR}, 9) AS value FROM p GROUP BY 1",
    "reference_spearman": f"""WITH {_P}, k AS (SELECT point_id,
 rank() OVER (PARTITION BY point_id ORDER BY a) + (count(*) OVER (PARTITION BY point_id, a) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY point_id ORDER BY b) + (count(*) OVER (PARTITION BY point_id, b) - 1) / 2.0 AS b FROM p)
 SELECT point_id, round({_CORR}, 9) AS value FROM k GROUP BY 1""",
    "reference_kendall": f"""WITH {_P} SELECT x.point_id, round(sum(sign(x.a - y.a) * sign(x.b - y.b)) /
 sqrt(count_if(x.a <> y.a)::DOUBLE * count_if(x.b <> y.b)), 9) AS value FROM p x JOIN p y ON x.point_id = y.point_id AND x.m < y.m GROUP BY 1""",
    "reference_mi_ksg": f"""WITH {_P}, d AS (SELECT x.point_id, x.m, abs(x.a - y.a) AS dx, abs(x.b - y.b) AS dy, x.m = y.m AS own
 FROM p x JOIN p y ON x.point_id = y.point_id), k AS (SELECT point_id, m, greatest(dx, dy) AS far FROM d WHERE NOT own
 QUALIFY row_number() OVER (PARTITION BY point_id, m ORDER BY greatest(dx, dy)) = {_K}),
 c AS (SELECT point_id, m, greatest(count_if(dx < far), 1) AS nx, greatest(count_if(dy < far), 1) AS ny FROM d JOIN k USING (point_id, m) GROUP BY 1, 2)
 SELECT point_id, round(greatest({psi(_K)!r} + {psi(MEMBERS)!r} - avg({_PSI % 'nx'}) - avg({_PSI % 'ny'}), 0), 9) AS value FROM c GROUP BY 1""",
    "reference_mi_binned": f"""WITH {_P}, g AS (SELECT min(v) AS lo, max(v) AS hi FROM e),
 t AS (SELECT point_id, least(greatest(floor((a - lo) / (hi - lo) * 80), 0), 79) AS i, least(greatest(floor((b - lo) / (hi - lo) * 80), 0), 79) AS j FROM p, g),
 c AS (SELECT point_id, i, j, count(*) AS c FROM t GROUP BY ALL), n AS (SELECT point_id, sum(c)::DOUBLE AS n FROM c GROUP BY 1),
 hi AS (SELECT point_id, sum(c * ln(c / n)) AS h FROM (SELECT point_id, i, sum(c) AS c FROM c GROUP BY ALL) JOIN n USING (point_id) GROUP BY 1),
 hj AS (SELECT point_id, sum(c * ln(c / n)) AS h FROM (SELECT point_id, j, sum(c) AS c FROM c GROUP BY ALL) JOIN n USING (point_id) GROUP BY 1),
 hh AS (SELECT point_id, sum(c * ln(c / n)) AS h FROM c JOIN n USING (point_id) GROUP BY 1),
 mi AS (SELECT point_id, (hh.h - hi.h - hj.h) / n AS mi FROM hi JOIN hj USING (point_id) JOIN hh USING (point_id) JOIN n USING (point_id))
 SELECT point_id, round(mi, 9) AS value, round(sqrt(1 - exp(-2 * mi)), 9) AS coefficient FROM mi""",
    "ensemble_mean_spread": f"WITH {_H} SELECT point_id, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS spread, count(v) AS n FROM h GROUP BY 1",
    "set_predicate": f"WITH {_H} SELECT point_id, count_if(v > 0)::BIGINT AS n, round(least(greatest((count_if(v > 0) - 20) / 20.0, 0), 1)::DOUBLE, 9) AS share FROM h GROUP BY 1",
    "kl_binned": f"""WITH {_Z}, r AS (SELECT *, min(u) OVER w - 0.01::DOUBLE AS lo, max(u) OVER w + 0.01::DOUBLE AS hi FROM s WINDOW w AS (PARTITION BY point_id)),
 b AS (SELECT point_id, lo, hi, least(greatest(floor((u - lo) / (hi - lo) * 80), 0), 79) AS b, count(*) / max(n)::DOUBLE AS p FROM r GROUP BY point_id, lo, hi, b)
 SELECT point_id, round(sum(p * ln(p * 80 / (hi - lo) / (exp(-0.5 * (lo + (b + 0.5) * (hi - lo) / 80) ** 2) / sqrt(2 * pi())))), 9) AS kl FROM b GROUP BY 1""",
    "kl_knn": f"""WITH {_Z}, d AS (SELECT x.point_id, x.m, x.u, x.n, abs(x.u - y.u) AS d FROM s x JOIN s y ON x.point_id = y.point_id AND x.m <> y.m
 QUALIFY row_number() OVER (PARTITION BY x.point_id, x.m ORDER BY abs(x.u - y.u)) = 3)
 SELECT point_id, round(greatest(-(avg(ln(d)) + any_value({_PSI % 'n'}) - {psi(3)!r} + ln(2)) + 0.5 * ln(2 * pi()) + 0.5 * avg(u * u), 0), 9) AS kl FROM d GROUP BY 1""",
    "field_minmax": f"WITH {_E} SELECT m::INT AS m, round(min(v), 9) AS low, round(max(v), 9) AS high FROM e GROUP BY 1",
    "histogram": f"""WITH {_E}, g AS (SELECT min(v) AS lo, max(v) AS hi FROM e), c AS (SELECT least(greatest(floor((v - lo) / (hi - lo) * 50), 0), 49)::INT AS bin, count(*) AS n FROM e, g GROUP BY 1),
 f AS (SELECT i::INT AS bin, coalesce(n, 0) AS n FROM range(50) t(i) LEFT JOIN c ON c.bin = i) SELECT bin, n, round(n / max(n) OVER ()::DOUBLE, 9) AS part FROM f""",
    "block_means": f"WITH {_H} SELECT x // 3 AS bx, y // 3 AS by, z // 3 AS bz, m::INT AS m, round(avg(v), 9) AS value FROM h GROUP BY ALL",
    "block_spread": f"""WITH {_E}, q AS (SELECT point_id, x, y, z, var_samp(v) AS s FROM e GROUP BY ALL)
 SELECT x // 3 AS bx, y // 3 AS by, z // 3 AS bz, round(sqrt(avg(s)), 9) AS spread, count(*) AS n FROM q GROUP BY 1, 2, 3""",
    "block_spread_two_fields": f"WITH {_SPREADS} SELECT bx, b.by AS by, bz, round(a, 9) AS \"first\", round(b, 9) AS \"second\" FROM b",
    "block_spread_range": f"""WITH {_SPREADS} SELECT round(min(a), 9) AS low_first, round(max(a), 9) AS high_first, round(min(b), 9) AS low_second,
 round(max(b), 9) AS high_second FROM b""",
    "named_velocity": f"""WITH {_L}, u AS (SELECT point_id, t::INT AS t, m AS e, point_id % 10 AS x, (point_id // 10) % 10 AS y, point_id // 100 AS z, q AS u, d AS v, tax AS w FROM l),
 c AS (SELECT *, {_dk('w', 'y')} - {_dk('v', 'z')} AS cu, {_dk('u', 'z')} - {_dk('w', 'x')} AS cv, {_dk('v', 'x')} - {_dk('u', 'y')} AS cw FROM u)
 SELECT point_id, t, e, round(cu, 9) AS cu, round(cv, 9) AS cv, round(cw, 9) AS cw, round(u * cu + v * cv + w * cw, 9) AS helicity FROM c""",
    "block_pairs": f"""WITH {_E}, b AS (SELECT (z // 3) * 1000000 + (y // 3) * 1000 + x // 3 AS id, m, avg(v) AS v FROM e GROUP BY 1, 2),
 p AS (SELECT x.id AS i, y.id AS j, x.v AS a, y.v AS b FROM b x JOIN b y ON x.m = y.m AND x.id > y.id)
 SELECT i, j, round({_CORR}, 9) AS value FROM p GROUP BY 1, 2 HAVING abs({_CORR}) >= 0.2""",
    "windowed_correlation": """WITH s AS (SELECT event_type AS sidx, floor(epoch(ts) / 21600)::BIGINT AS t, avg(value) AS v FROM events GROUP BY 1, 2),
 p AS (SELECT s.sidx, s.t, r.v AS a, s.v AS b FROM s JOIN s r ON r.t = s.t AND r.sidx = 'click'),
 w AS (SELECT x.sidx, x.t, count(*) AS n, corr(y.a, y.b) AS c FROM p x JOIN p y ON y.sidx = x.sidx AND y.t BETWEEN x.t - 31 AND x.t GROUP BY 1, 2)
 SELECT sidx, t, round(c, 9) AS value FROM w WHERE n = 32""",
    "binary_operators": f"""WITH {_L} SELECT point_id, t::INT AS t, m, round(q + tax, 9) AS sum, round(q - tax, 9) AS difference, round(abs(q - tax), 9) AS absolute_difference,
 round(q * tax, 9) AS product, round(greatest(q, tax), 9) AS maximum, round(least(q, tax), 9) AS minimum FROM l""",
    "vorticity": f"""WITH {_E}, u AS (SELECT point_id, x, y, z, max(v) FILTER (m = 0) AS u, max(v) FILTER (m = 1) AS v, max(v) FILTER (m = 2) AS w FROM e GROUP BY ALL),
 c AS (SELECT *, {_d('w', 'y')} - {_d('v', 'z')} AS cu, {_d('u', 'z')} - {_d('w', 'x')} AS cv, {_d('v', 'x')} - {_d('u', 'y')} AS cw FROM u)
 SELECT point_id, round(cu, 9) AS cu, round(cv, 9) AS cv, round(cw, 9) AS cw, round(sqrt(u * u + v * v + w * w), 9) AS speed,
 round(sqrt(cu * cu + cv * cv + cw * cw), 9) AS curl, round(u * cu + v * cv + w * cw, 9) AS helicity FROM c""",
    "smoothed": f"""WITH {_H} SELECT a.point_id, a.m::INT AS m, round(sum(b.v * exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2.0)) /
 sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 2.0)), 9) AS value
 FROM h a JOIN h b ON a.m = b.m AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 WHERE b.v IS NOT NULL GROUP BY 1, 2""",
    "variable_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr(l_{a}, l_{b}), 9) AS value FROM lineitem"
        for a, b in (("extendedprice", "quantity"), ("discount", "quantity"), ("discount", "extendedprice"), ("tax", "quantity"), ("tax", "extendedprice"), ("tax", "discount"))
    ),
    "variables_at_points": f"WITH {_L}, p AS (SELECT point_id, t::INT AS t, q AS a, e AS b FROM l) SELECT point_id, t, round({_CORR}, 9) AS value FROM p GROUP BY 1, 2 HAVING count(*) >= 3",
    "sphere": f"WITH {_E} SELECT point_id, m::INT AS m, round(v, 9) AS value FROM e WHERE sqrt((x - 4) ** 2 + (y - 4) ** 2 + (z - 2) ** 2) <= 3",
    "cube": f"WITH {_E} SELECT point_id, m::INT AS m, round(v, 9) AS value FROM e WHERE greatest(abs(x - 4), abs(y - 4), abs(z - 2)) <= 2",
    "inner_points": f"""WITH {_E} SELECT point_id, m::INT AS m, round(v, 9) AS value FROM e WHERE x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8
 AND z BETWEEN 1 AND (SELECT max(z) - 1 FROM e)""",
    "field_minmax_holes": f"WITH {_H} SELECT m::INT AS m, round(min(v), 9) AS low, round(max(v), 9) AS high FROM h GROUP BY 1",
    "histogram_holes": f"""WITH {_H}, g AS (SELECT min(v) / 2 AS lo, max(v) / 2 AS hi FROM h),
 c AS (SELECT least(greatest(floor((v - lo) / (hi - lo) * 50), 0), 49)::INT AS bin, count(*) AS n FROM h, g WHERE v IS NOT NULL GROUP BY 1),
 f AS (SELECT i::INT AS bin, coalesce(n, 0) AS n FROM range(50) t(i) LEFT JOIN c ON c.bin = i) SELECT bin, n, round(n / max(n) OVER ()::DOUBLE, 9) AS part FROM f""",
    "crossing_cells_holes": f"""WITH {_H}, o AS (SELECT i, j, k FROM range(2) a(i), range(2) b(j), range(2) c(k))
 SELECT m::INT AS m, x - i AS x, y - j AS y, z - k AS z FROM h, o WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) = 8 AND min(v) < 0.1::DOUBLE AND max(v) >= 0.1::DOUBLE""",
    "normal_equations_holes": f"""WITH {_H}, g AS (SELECT min(v) / 2 AS lo, max(v) / 2 AS hi FROM h),
 tf AS (SELECT v, least(greatest((v - lo) / (hi - lo) * 7, 0), 7) AS u FROM h, g WHERE v IS NOT NULL), w AS (SELECT v, least(floor(u), 6)::INT AS j, u - least(floor(u), 6) AS f FROM tf)
 SELECT i, j, round(sum(w), 9) AS ata FROM (SELECT j AS i, j, (1 - f) * (1 - f) AS w FROM w UNION ALL SELECT j + 1, j + 1, f * f FROM w
 UNION ALL SELECT j + 1, j, f * (1 - f) FROM w UNION ALL SELECT j, -1, (1 - f) * v * v FROM w UNION ALL SELECT j + 1, -1, f * v * v FROM w) GROUP BY 1, 2""",
    "crossing_cells": f"""WITH {_E}, o AS (SELECT i, j, k FROM range(2) a(i), range(2) b(j), range(2) c(k))
 SELECT m::INT AS m, x - i AS x, y - j AS y, z - k AS z FROM e, o GROUP BY 1, 2, 3, 4 HAVING count(*) = 8 AND min(v) < 0.1::DOUBLE AND max(v) >= 0.1::DOUBLE""",
    "cluster_cores": """WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py FROM embeddings),
 g AS (SELECT 0.05::DOUBLE * sqrt((max(px) - min(px)) ** 2 + (max(py) - min(py)) ** 2) AS eps FROM p)
 SELECT a.id, count(*) AS n, count(*) >= 8 AS core FROM p a, p b, g WHERE sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) <= eps GROUP BY 1""",
    "transfer_function": f"WITH {_F} SELECT point_id, m, j, round(f, 9) AS f, round(j / 7.0::DOUBLE * (1 - f) + (j + 1) / 7.0::DOUBLE * f, 9) AS red FROM w",
    "normal_equations": f"""WITH {_F} SELECT i, j, round(sum(w), 9) AS ata FROM (SELECT j AS i, j, (1 - f) * (1 - f) AS w FROM w UNION ALL SELECT j + 1, j + 1, f * f FROM w
 UNION ALL SELECT j + 1, j, f * (1 - f) FROM w UNION ALL SELECT j, -1, (1 - f) * v * v FROM w UNION ALL SELECT j + 1, -1, f * v * v FROM w) GROUP BY 1, 2""",
}

for _more in (catalog_measures, catalog_regions, catalog_grid, catalog_hierarchy):
    QUERIES |= _more.QUERIES
    ORACLE_SQL |= _more.ORACLE_SQL
