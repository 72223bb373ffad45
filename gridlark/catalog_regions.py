"""Queries of regions: block pairs by means, samples and all points, and quasi-random points."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark import twins
from gridlark.fields import embedding_field
from gridlark.functions import sequences
from gridlark.functions.measures import default_k
from gridlark.operators import ensemble, grid, regions, search
from gridlark.twins import B, BP, CORR, E, rounded

MEMBERS, FACTOR, SAMPLES, BINS = 64, 5, 20, 10


def numbered(df):
    """Pairs with their blocks as numbers, by which the twins know them."""
    number = lambda c: (F.col(c)["bz"] * 1_000_000 + F.col(c)["by"] * 1000 + F.col(c)["bx"]).alias(c)
    return rounded(df.select(*[number(c) if c in ("i", "j") else F.col(c) for c in df.columns]))


def _blocks(spark, sf, squared: bool = False):
    df = embedding_field(spark, sf)
    return ensemble.block_means(df.withColumn("value", F.col("value") * F.col("value")) if squared else df, 3)


def _means(**options):
    return lambda s, d: numbered(regions.mean_pairs(_blocks(s, d), **options))


def pairs_cross_region(spark, sf):
    df = _blocks(spark, sf)
    return numbered(regions.mean_pairs(df.filter("bx < 2"), df.filter("bx >= 2")))


def pairs_listed(spark, sf):
    """Blocks and those that follow them along x; 0 where there is no such correlation."""
    df = _blocks(spark, sf)
    ids = df.select("bz", "by", "bx").distinct()
    nxt = ids.select(F.struct("bz", "by", (F.col("bx") + 1).alias("bx")).alias("i"), F.struct("bz", "by", "bx").alias("j"))
    listed = nxt.join(ids.select(F.struct("bz", "by", "bx").alias("i")), "i")
    return numbered(regions.pair_statistics(listed, regions.mean_pairs(df, listed=listed, low=0.0)))


def pairs_merged(spark, sf):
    one, two = regions.mean_pairs(_blocks(spark, sf)), regions.mean_pairs(_blocks(spark, sf, True))
    return numbered(regions.merged(plain=one, squared=two))


def pairs_limited(spark, sf):
    return regions.limited(pairs_merged(spark, sf), "squared")


def _sampled(method: str):
    def query(spark, sf):
        df = embedding_field(spark, sf)
        return numbered(regions.sampled_pairs(df, FACTOR, grid.sizes(df), SAMPLES, method))

    return query


def pairs_sampled_two_fields(spark, sf):
    """Blocks of the field with those of its squares."""
    df = embedding_field(spark, sf)
    return numbered(regions.sampled_pairs(df, FACTOR, grid.sizes(df), SAMPLES, second=df.withColumn("value", F.col("value") * F.col("value"))))


def pairs_sampled_cross_region(spark, sf):
    df = embedding_field(spark, sf)
    low, high = df.filter(F.col("x") < FACTOR), df.filter(F.col("x") >= FACTOR)
    return numbered(regions.sampled_pairs(low, FACTOR, grid.sizes(df), SAMPLES, others=high))


def pairs_bayesian(spark, sf):
    """A search has no SQL; tests compare it with all points."""
    df = embedding_field(spark, sf)
    return numbered(search.bayesian_pairs(df, FACTOR, grid.sizes(df), 2 * SAMPLES))


def sampling_errors(spark, sf):
    df = embedding_field(spark, sf)
    found = regions.sampled_pairs(df, FACTOR, grid.sizes(df), SAMPLES)
    return rounded(regions.exhaustive_errors(df, FACTOR, found))


def _points(method: str, d: int):
    def query(spark, sf):
        df = sequences.points(spark, method, 100, d)
        return df.select("i", *[F.round(F.col(f"s{j}").cast("double"), 6).alias(f"s{j}") for j in range(d)])

    return query


QUERIES = {
    "block_abs_max": lambda s, d: rounded(ensemble.block_abs_max(embedding_field(s, d), 3)),
    "pairs_spearman": _means(measure="spearman"),
    "pairs_kendall": _means(measure="kendall"),
    "pairs_mi_binned": _means(measure="mi_binned", bins=BINS),
    "pairs_mi_ksg": _means(measure="mi_ksg"),
    "pairs_range": _means(low=0.1, high=0.3, absolute=True),
    "pairs_distance": _means(cells=(1.5, 3)),
    "pairs_clicked": _means(clicked=(1, 2, 0)),
    "pairs_cross_region": pairs_cross_region,
    "pairs_listed": pairs_listed,
    "pairs_two_fields": lambda s, d: numbered(regions.two_fields(_blocks(s, d), _blocks(s, d, True))),
    "pairs_merged": pairs_merged,
    "pairs_limited": pairs_limited,
    "pairs_strongest": lambda s, d: numbered(regions.strongest_means(_blocks(s, d), 20)),
    "pairs_matrix": lambda s, d: numbered(regions.matrix(regions.mean_pairs(_blocks(s, d)))),
    "pairs_sampled_plastic": _sampled("plastic"),
    "pairs_sampled_halton": _sampled("halton"),
    "pairs_sampled_two_fields": pairs_sampled_two_fields,
    "pairs_sampled_cross_region": pairs_sampled_cross_region,
    "pairs_bayesian": pairs_bayesian,
    "pairs_exhaustive": lambda s, d: numbered(regions.exhaustive_pairs(embedding_field(s, d), FACTOR)),
    "sampling_errors": sampling_errors,
    "plastic_points": _points("plastic", 6),
    "plastic_points_3d": _points("plastic", 3),
    "halton_points": _points("halton", 6),
}

_VALUED = BP + f", v AS (SELECT i, j, {CORR} AS c FROM p GROUP BY i, j)"
_S = E + ", s AS (SELECT (z // 3) * 1000000 + (y // 3) * 1000 + x // 3 AS id, m, avg(v) AS v, avg(v * v) AS w FROM e GROUP BY 1, 2)"
_CELLS = E + f""", k AS (SELECT (z // {FACTOR}) * 1000000 + (y // {FACTOR}) * 1000 + x // {FACTOR} AS id, point_id, m, v FROM e),
 q AS (SELECT x.id AS i, y.id AS j, x.point_id AS g, y.point_id AS h, {CORR.replace('(a, b)', '(x.v, y.v)').replace('(a)', '(x.v)').replace('(b)', '(y.v)')} AS c
 FROM k x JOIN k y ON x.m = y.m AND x.id > y.id GROUP BY 1, 2, 3, 4)"""
_TWO_CELLS = _CELLS.replace("m, v FROM e)", "m, v, v * v AS w FROM e)").replace("y.v", "y.w").replace("x.id > y.id", "x.id >= y.id")
#: Blocks of the lower half along x with those of the upper one.
_CROSS = "x.id % 1000 = 0 AND y.id % 1000 = 1"
_BOXES = f""", n AS (SELECT max(x) + 1 AS xs, max(y) + 1 AS ys, max(z) + 1 AS zs FROM e),
 o AS (SELECT DISTINCT x // {FACTOR} AS bx, y // {FACTOR} AS by, z // {FACTOR} AS bz FROM e),
 r AS (SELECT o.bz * 1000000 + o.by * 1000 + o.bx AS id, o.bx * {FACTOR} AS ox, o.by * {FACTOR} AS oy, o.bz * {FACTOR} AS oz, least({FACTOR}, xs - o.bx * {FACTOR}) AS nx,
 least({FACTOR}, ys - o.by * {FACTOR}) AS ny, least({FACTOR}, zs - o.bz * {FACTOR}) AS nz FROM o, n)"""


def _coordinates(method: str, d: int) -> list[str]:
    if method == "plastic":
        parts = [f"(0.5::DOUBLE + {a!r}::DOUBLE * (i + 1))" for a in sequences.plastic_steps(d)]
        return [f"({x} - floor({x}))::FLOAT" for x in parts]
    out = []
    for b in sequences.BASES[:d]:
        terms, size = ["0.0::DOUBLE"], 1
        while size < 1 << 31:
            terms.append(f"((i + 1) // {size}) % {b} / {size * b}.0::DOUBLE")
            size *= b
        out.append(f"({' + '.join(terms)})::FLOAT")
    return out


def _found(method: str) -> str:
    s = _coordinates(method, 6)
    at = lambda k, side: f"{side}.o{'xyz'[k % 3]} + least(greatest(floor(s{k}::DOUBLE * {side}.n{'xyz'[k % 3]}), 0), {side}.n{'xyz'[k % 3]} - 1)"
    place = lambda side, first: f"({at(first, side)}) + 10 * ({at(first + 1, side)}) + 100 * ({at(first + 2, side)})"
    return f"""{_BOXES}, u AS (SELECT {', '.join(f'{c} AS s{k}' for k, c in enumerate(s))} FROM range({SAMPLES}) t(i)),
 a AS (SELECT DISTINCT x.id AS i, y.id AS j, {place('x', 0)} AS g, {place('y', 3)} AS h FROM r x JOIN r y ON x.id > y.id, u),
 f AS (SELECT q.i, q.j, (max({{'s': abs(c), 'c': c}})).c AS value FROM q JOIN a ON a.i = q.i AND a.j = q.j AND a.g = q.g AND a.h = q.h GROUP BY 1, 2)"""


def _sequence(method: str, d: int) -> str:
    return "SELECT i, " + ", ".join(f"round({c}::DOUBLE, 6) AS s{k}" for k, c in enumerate(_coordinates(method, d))) + " FROM range(100) t(i)"


ORACLE_SQL = {
    "block_abs_max": f"WITH {E} SELECT x // 3 AS bx, y // 3 AS by, z // 3 AS bz, m::INT AS m, round((max({{'s': abs(v), 'v': v}})).v, 9) AS value FROM e GROUP BY 1, 2, 3, 4",
    "pairs_spearman": twins.spearman(BP, "i, j"),
    "pairs_kendall": twins.kendall(BP, "i, j"),
    "pairs_mi_binned": twins.mi_binned(BP, "i, j", BINS),
    "pairs_mi_ksg": twins.mi_ksg(BP, "i, j", default_k(MEMBERS), MEMBERS),
    "pairs_range": f"WITH {_VALUED} SELECT i, j, round(abs(c), 9) AS value FROM v WHERE abs(c) BETWEEN 0.1::DOUBLE AND 0.3::DOUBLE",
    "pairs_distance": f"""WITH {_VALUED} SELECT i, j, round(c, 9) AS value FROM v WHERE sqrt((i // 1000000 - j // 1000000) ** 2 + (i // 1000 % 1000 - j // 1000 % 1000) ** 2
 + (i % 1000 - j % 1000) ** 2) BETWEEN 1.5::DOUBLE AND 3""",
    "pairs_clicked": f"WITH {_VALUED} SELECT i, j, round(c, 9) AS value FROM v WHERE i = 2001 OR j = 2001",
    "pairs_cross_region": twins.pearson(B + ", p AS (SELECT x.id AS i, y.id AS j, x.m, x.v AS a, y.v AS b FROM b x JOIN b y ON x.m = y.m AND x.bx < 2 AND y.bx >= 2)", "i, j"),
    "pairs_listed": f"""WITH {B}, p AS (SELECT x.id AS i, y.id AS j, x.v AS a, y.v AS b FROM b x JOIN b y ON x.m = y.m AND x.bx = y.bx + 1 AND x.by = y.by AND x.bz = y.bz),
 c AS (SELECT i, j, {CORR} AS c FROM p GROUP BY i, j) SELECT i, j, round(CASE WHEN c >= 0 THEN c ELSE 0 END, 9) AS value FROM c""",
    "pairs_two_fields": f"""WITH {_S}, p AS (SELECT x.id AS i, y.id AS j, x.v AS a, y.w AS b, false AS second FROM s x JOIN s y ON x.m = y.m AND x.id >= y.id
 UNION ALL SELECT y.id, x.id, x.w, y.v, true FROM s x JOIN s y ON x.m = y.m AND x.id >= y.id)
 SELECT i, j, second, round({CORR}, 9) AS value FROM p GROUP BY i, j, second""",
    "pairs_merged": f"""WITH {_S}, p AS (SELECT x.id AS i, y.id AS j, x.v AS a, y.v AS b, 'plain' AS variable FROM s x JOIN s y ON x.m = y.m AND x.id > y.id
 UNION ALL SELECT x.id, y.id, x.w, y.w, 'squared' FROM s x JOIN s y ON x.m = y.m AND x.id > y.id)
 SELECT i, j, variable, round({CORR}, 9) AS value FROM p GROUP BY i, j, variable""",
    "pairs_strongest": f"WITH {_VALUED} SELECT i, j, round(c, 9) AS value FROM v ORDER BY abs(c) DESC, i, j LIMIT 20",
    "pairs_matrix": f"WITH {_VALUED} SELECT i, j, round(c, 9) AS value FROM v UNION ALL SELECT j, i, round(c, 9) FROM v",
    "pairs_sampled_plastic": f"WITH {_CELLS}{_found('plastic')} SELECT i, j, round(value, 9) AS value FROM f",
    "pairs_sampled_halton": f"WITH {_CELLS}{_found('halton')} SELECT i, j, round(value, 9) AS value FROM f",
    "pairs_sampled_two_fields": f"WITH {_TWO_CELLS}{_found('plastic').replace('x.id > y.id', 'x.id >= y.id')} SELECT i, j, round(value, 9) AS value FROM f",
    "pairs_sampled_cross_region": f"WITH {_CELLS.replace('x.id > y.id', _CROSS)}{_found('plastic').replace('x.id > y.id', _CROSS)} SELECT i, j, round(value, 9) AS value FROM f",
    "pairs_exhaustive": f"WITH {_CELLS} SELECT i, j, round((max({{'s': abs(c), 'c': c}})).c, 9) AS value, count(*) AS n FROM q GROUP BY 1, 2",
    "sampling_errors": f"""WITH {_CELLS}{_found('plastic')}, z AS (SELECT q.i, q.j, 1 - count_if(abs(c) < abs(f.value)) / count(*)::DOUBLE AS quantile,
 1 - (any_value(abs(f.value)) - min(abs(c))) / (max(abs(c)) - min(abs(c))) AS linear, max(abs(c)) - any_value(abs(f.value)) AS absolute
 FROM q JOIN f ON f.i = q.i AND f.j = q.j GROUP BY 1, 2) SELECT round(avg(quantile), 9) AS quantile, round(avg(linear), 9) AS linear, round(avg(absolute), 9) AS absolute FROM z""",
    "plastic_points": _sequence("plastic", 6),
    "plastic_points_3d": _sequence("plastic", 3),
    "halton_points": _sequence("halton", 6),
}
ORACLE_SQL["pairs_limited"] = f"SELECT * FROM ({ORACLE_SQL['pairs_merged']}) WHERE variable = 'squared'"
