"""What registered queries and their DuckDB twins share: rounding, and SQL of fields and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.measures import EULER, psi, valid


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine places: sums run in another order in every engine and plan."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bounds(df: DataFrame, column: str = "value") -> tuple[float, float]:
    """Smallest and largest value, NaN left out: one row comes to the driver."""
    return tuple(df.agg(F.min(valid(F.col(column))), F.max(valid(F.col(column)))).first())


E = """e AS (SELECT vec_id AS point_id, vec_id % 10 AS x, (vec_id // 10) % 10 AS y, vec_id // 100 AS z, m, v FROM
 (SELECT vec_id, unnest(range(len(embedding))) AS m, unnest(embedding)::DOUBLE AS v FROM embeddings))"""
H = E + ", h AS (SELECT point_id, x, y, z, m, CASE WHEN point_id % 17 = 3 AND m % 13 = 5 THEN NULL ELSE v END AS v FROM e)"
P = E + ", p AS (SELECT e.point_id, e.m, r.v AS a, e.v AS b FROM e JOIN e r ON r.m = e.m AND r.point_id = 0)"
L = """l AS (SELECT l_suppkey AS point_id, year(l_shipdate) - 1995 AS t, l_linenumber AS m, avg(l_quantity) AS q,
 avg(l_extendedprice) AS e, avg(l_discount) AS d, avg(l_tax) AS tax FROM lineitem GROUP BY 1, 2, 3)"""
CORR = "covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0)"
PSI = f"({-EULER!r} + coalesce(list_sum([1.0::DOUBLE / i FOR i IN range(1, %s::BIGINT)]), 0))"
#: Blocks of three cells, b(id, bx, by, bz, m, v).
B = E + ", b AS (SELECT (z // 3) * 1000000 + (y // 3) * 1000 + x // 3 AS id, x // 3 AS bx, y // 3 AS by, z // 3 AS bz, m, avg(v) AS v FROM e GROUP BY 1, 2, 3, 4, 5)"
#: Their pairs p(i, j, m, a, b).
BP = B + ", p AS (SELECT x.id AS i, y.id AS j, x.m, x.v AS a, y.v AS b FROM b x JOIN b y ON x.m = y.m AND x.id > y.id)"


def _same(keys: str) -> str:
    return " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))


def pearson(p: str, keys: str, value: str = CORR, source: str = "p") -> str:
    """Of pairs p(keys, m, a, b), as in all of the following."""
    return f"WITH {p} SELECT {keys}, round(CASE WHEN count(*) = 1 THEN 1.0::DOUBLE ELSE {value} END, 9) AS value FROM {source} GROUP BY {keys}"


def spearman(p: str, keys: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0 AS {c}"
    return pearson(f"{p}, k AS (SELECT {keys}, {rank('a')}, {rank('b')} FROM p)", keys, source="k")


def kendall(p: str, keys: str, value: str | None = None) -> str:
    value = value or "sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(count_if(x.a <> y.a)::DOUBLE * count_if(x.b <> y.b))"
    named = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"WITH {p} SELECT {named}, round({value}, 9) AS value FROM p x JOIN p y ON {_same(keys)} AND x.m < y.m GROUP BY {named}"


def mi_binned(p: str, keys: str, bins: int, low: str | None = None, high: str | None = None) -> str:
    lo, hi = low or f"min(least(a, b)) OVER (PARTITION BY {keys})", high or f"max(greatest(a, b)) OVER (PARTITION BY {keys})"
    at = lambda c: f"least(greatest(coalesce(floor(({c} - lo) / nullif(hi - lo, 0) * {bins}), 0), 0), {bins - 1})"
    return f"""WITH {p}, q AS (SELECT {keys}, a, b, {lo} AS lo, {hi} AS hi FROM p), t AS (SELECT {keys}, {at('a')} AS bi, {at('b')} AS bj FROM q),
 c AS (SELECT {keys}, bi, bj, count(*)::DOUBLE AS c FROM t GROUP BY ALL),
 w AS (SELECT {keys}, c, sum(c) OVER (PARTITION BY {keys}) AS n, sum(c) OVER (PARTITION BY {keys}, bi) AS ci, sum(c) OVER (PARTITION BY {keys}, bj) AS cj FROM c)
 SELECT {keys}, round(sum(c / n * ln(c * n / (ci * cj))), 9) AS value FROM w GROUP BY {keys}"""


def mi_ksg(p: str, keys: str, k: int, n: int, estimator: int = 1, told: str = "%s") -> str:
    """``told`` is what is made of the estimate."""
    far, more = ("k.far", 0.0) if estimator == 1 else (None, 1 / k)
    count = "greatest(count_if(d.dx < k.far), 1) AS nx, greatest(count_if(d.dy < k.far), 1) AS ny" if far else "greatest(count_if(d.dx <= k.ex) - 1, 1) AS nx, greatest(count_if(d.dy <= k.ey) - 1, 1) AS ny"
    named = ", ".join(f"x.{c.strip()}" for c in keys.split(","))
    value = f"greatest({psi(k)!r} - {more!r} + {psi(n)!r} - avg({PSI % 'nx'}) - avg({PSI % 'ny'}), 0)"
    return f"""WITH {p}, d AS (SELECT {named}, x.m, abs(x.a - y.a) AS dx, abs(x.b - y.b) AS dy, x.m = y.m AS own FROM p x JOIN p y ON {_same(keys)}),
 o AS (SELECT *, row_number() OVER (PARTITION BY {keys}, m ORDER BY greatest(dx, dy)) AS turn FROM d WHERE NOT own),
 k AS (SELECT {keys}, m, max(greatest(dx, dy)) AS far, max(dx) AS ex, max(dy) AS ey FROM o WHERE turn <= {k} GROUP BY {keys}, m),
 c AS (SELECT {keys}, m, {count} FROM d JOIN k USING ({keys}, m) GROUP BY {keys}, m)
 SELECT {keys}, round({told % value}, 9) AS value FROM c GROUP BY {keys}"""


def derivative(c: str, axis: str) -> str:
    """Central difference of a column of u(x, y, z, ...), one-sided at the ends."""
    w = f"(PARTITION BY {', '.join(a for a in 'xyz' if a != axis)} ORDER BY {axis})"
    after, before = f"lead({c}) OVER {w}", f"lag({c}) OVER {w}"
    return f"((coalesce({after}, {c}) - coalesce({before}, {c})) / CASE WHEN {after} IS NULL OR {before} IS NULL THEN 1 ELSE 2 END)"
