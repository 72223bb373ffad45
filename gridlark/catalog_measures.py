"""Queries of measures and their modes: reference point, second variable, lag, windows, whole fields."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridlark import twins
from gridlark.fields import embedding_field, event_series, lineitem_field, ordered_lineitem_field
from gridlark.functions.measures import default_k, psi, psi_of
from gridlark.operators import dependence, similarity
from gridlark.twins import CORR, L, P, PSI, bounds, rounded

MEMBERS, LENGTH, POINT = 64, 32, 1
_K = default_k(MEMBERS)
_FIELD_K = 10
_WINDOW_K, _WINDOW_BINS = min(max(math.ceil(3 * LENGTH / 100), 1), 100), math.ceil(LENGTH / 10)
VARIABLES = {"quantity": "q", "extendedprice": "e", "discount": "d", "tax": "tax"}


def _field(measure: str, absolute: bool = False, **options):
    return lambda s, d: rounded(dependence.correlation_field(embedding_field(s, d), 0, measure, absolute, options))


def _lines(measure: str, field=lineitem_field, **pairing):
    return lambda s, d: rounded(dependence.correlation_field(field(s, d), POINT, measure, **pairing))


def _window(measure: str, **options):
    return lambda s, d: rounded(dependence.windowed(event_series(s, d), "click", LENGTH, measure, **options))


def window_mi_binned(spark, sf):
    low, high = bounds(event_series(spark, sf))
    return _window("mi_binned", bins=_WINDOW_BINS, low=low, high=high)(spark, sf)


def _similar(measure: str):
    return lambda s, d: rounded(similarity.similarity_matrix(lineitem_field(s, d), list(VARIABLES), measure))


def similarity_mi_ksg(spark, sf):
    """Two variables over all rows, ten neighbours."""
    return rounded(similarity.similarity_matrix(lineitem_field(spark, sf), ["quantity", "extendedprice"], "mi_ksg", k=_FIELD_K))


def largest_information(spark, sf):
    """The largest value of Kraskov's estimate for 4 to 64 members and k = 3."""
    n = spark.range(4, MEMBERS + 1).select(F.col("id").alias("n"))
    return rounded(n.withColumn("value", psi_of(F.col("n")) - psi(3)))


QUERIES = {
    "reference_pearson_one_pass": lambda s, d: rounded(dependence.pearson_one_pass(dependence.with_reference(embedding_field(s, d), 0))),
    "reference_pearson_eps": _field("pearson", eps=1e-16),
    "reference_absolute": _field("pearson", absolute=True),
    "reference_kendall_tau_a": _field("kendall", variant="tau_a"),
    "reference_kendall_signs": lambda s, d: rounded(dependence.kendall_by_signs(dependence.with_reference(embedding_field(s, d), 0))),
    "reference_mi_ksg2": _field("mi_ksg", estimator=2),
    "reference_mi_ksg_coefficient": _field("mi_ksg_coefficient"),
    "largest_information": largest_information,
    "separate_pearson": _lines("pearson", variable="quantity", reference_variable="extendedprice", time="t"),
    "lagged_pearson": _lines("pearson", variable="quantity", time="t", lag=3),
    "time_axis_spearman": _lines("spearman", ordered_lineitem_field, variable="tax", member="t", time="m"),
    "same_point_spearman": lambda s, d: rounded(dependence.same_point_field(ordered_lineitem_field(s, d), "quantity", "tax", "spearman", ["point_id", "t"])),
    "window_spearman": _window("spearman"),
    "window_kendall": _window("kendall"),
    "window_mi_binned": window_mi_binned,
    "window_mi_ksg": _window("mi_ksg", k=_WINDOW_K),
    "similarity_pearson": _similar("pearson"),
    "similarity_spearman": _similar("spearman"),
    "similarity_kendall": _similar("kendall"),
    "similarity_mi_binned": _similar("mi_binned"),
    "similarity_mi_ksg": similarity_mi_ksg,
}

_LP = L + ", p AS (SELECT x.point_id, x.t::INT AS t, x.m, r.{r} AS a, x.{v} AS b FROM l x JOIN l r ON r.m = x.m AND {on} AND r.point_id = 1)"
_SERIES = """s AS (SELECT event_type AS sidx, floor(epoch(ts) / 21600)::BIGINT AS t, avg(value) AS v FROM events GROUP BY 1, 2),
 z AS (SELECT s.sidx, s.t, r.v AS a, s.v AS b FROM s JOIN s r ON r.t = s.t AND r.sidx = 'click'),
 p AS (SELECT x.sidx, x.t, y.t AS m, y.a, y.b FROM z x JOIN z y ON y.sidx = x.sidx AND y.t BETWEEN x.t - 31 AND x.t QUALIFY count(*) OVER (PARTITION BY x.sidx, x.t) = 32)"""


def _each(told) -> str:
    names = list(VARIABLES)
    rows = [(a, b) for k, a in enumerate(names) for b in names[:k]]
    parts = [f"SELECT '{a}' AS a, '{b}' AS b, value FROM ({told(_PAIR.format(a=VARIABLES[a], b=VARIABLES[b]), 'one')})" for a, b in rows]
    return " UNION ALL ".join(parts)


_PAIR = L + ", p AS (SELECT 1 AS one, row_number() OVER () AS m, {a} AS a, {b} AS b FROM l)"

ORACLE_SQL = {
    "reference_pearson_one_pass": twins.pearson(P, "point_id", "(count(*) * sum(a * b) - sum(a) * sum(b)) / sqrt((count(*) * sum(a * a) - sum(a) ** 2) * (count(*) * sum(b * b) - sum(b) ** 2))"),
    "reference_pearson_eps": twins.pearson(P, "point_id", "covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b) + 1e-16::DOUBLE)"),
    "reference_absolute": twins.pearson(P, "point_id", f"abs({CORR})"),
    "reference_kendall_tau_a": twins.kendall(P, "point_id", "1 - 2.0::DOUBLE * count_if(sign(x.a - y.a) * sign(x.b - y.b) < 0) / count(*)"),
    "reference_kendall_signs": twins.kendall(P, "point_id", "sum(sign(x.a - y.a) * sign(x.b - y.b)) / count(*)"),
    "reference_mi_ksg2": twins.mi_ksg(P, "point_id", _K, MEMBERS, 2),
    "reference_mi_ksg_coefficient": twins.mi_ksg(P, "point_id", _K, MEMBERS, told="sqrt(1 - exp(-2 * %s))"),
    "largest_information": f"SELECT n::BIGINT AS n, round({PSI % 'n'} - {psi(3)!r}, 9) AS value FROM range(4, {MEMBERS + 1}) r(n)",
    "separate_pearson": twins.pearson(_LP.format(r="e", v="q", on="r.t = x.t"), "point_id, t"),
    "lagged_pearson": twins.pearson(_LP.format(r="q", v="q", on="r.t = 3"), "point_id, t"),
    "time_axis_spearman": twins.spearman(L + ", p AS (SELECT x.point_id, x.m AS member, x.t, r.tax AS a, x.tax AS b FROM l x JOIN l r ON r.m = x.m AND r.t = x.t AND r.point_id = 1)", "point_id, member"),
    "same_point_spearman": twins.spearman(L + ", p AS (SELECT point_id, t::INT AS t, m, q AS a, tax AS b FROM l)", "point_id, t"),
    "window_spearman": twins.spearman(_SERIES, "sidx, t"),
    "window_kendall": twins.kendall(_SERIES, "sidx, t"),
    "window_mi_binned": twins.mi_binned(_SERIES, "sidx, t", _WINDOW_BINS, "(SELECT min(v) FROM s)", "(SELECT max(v) FROM s)"),
    "window_mi_ksg": twins.mi_ksg(_SERIES, "sidx, t", _WINDOW_K, LENGTH),
    "similarity_pearson": _each(lambda p, k: twins.pearson(p, k)),
    "similarity_spearman": _each(lambda p, k: twins.spearman(p, k)),
    "similarity_kendall": _each(lambda p, k: twins.kendall(p, k)),
    "similarity_mi_binned": _each(lambda p, k: twins.mi_binned(p, k, 80)),
    "similarity_mi_ksg": f"""WITH {_PAIR.format(a='e', b='q')},
 k AS (SELECT x.m, min(greatest(abs(x.a - y.a), abs(x.b - y.b)), {_FIELD_K})[{_FIELD_K}] AS far FROM p x JOIN p y ON x.m <> y.m GROUP BY x.m),
 c AS (SELECT x.m, greatest(count_if(abs(x.a - y.a) < far), 1) AS nx, greatest(count_if(abs(x.b - y.b) < far), 1) AS ny FROM p x JOIN k USING (m) JOIN p y ON true GROUP BY x.m),
 n AS (SELECT count(*) AS n FROM p) SELECT 'extendedprice' AS a, 'quantity' AS b,
 round(greatest({psi(_FIELD_K)!r} + any_value({PSI % 'n'}) - avg({PSI % 'nx'}) - avg({PSI % 'ny'}), 0), 9) AS value FROM c, n""",
}
