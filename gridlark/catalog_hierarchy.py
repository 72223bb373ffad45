"""Queries of the tree over blocks: leaves, bundles of pairs, pairs inside a block."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlark.catalog_regions import numbered
from gridlark.fields import embedding_field
from gridlark.operators import ensemble, grid, hierarchy, regions
from gridlark.twins import CORR, E

FACTOR, OUTER, BLOCK = 3, 5, (1, 0, 0)


def block_tree(spark, sf):
    df = embedding_field(spark, sf)
    counts, factor = hierarchy.block_counts(grid.sizes(df), FACTOR)
    blocks = df.select(*[F.floor(F.col(a) / factor).alias(f"b{a}") for a in "xyz"]).distinct()
    return hierarchy.coded(blocks, counts)


def bundled_pairs(spark, sf):
    df = embedding_field(spark, sf)
    counts, factor = hierarchy.block_counts(grid.sizes(df), FACTOR)
    pairs = regions.mean_pairs(ensemble.block_means(df, factor)).filter(F.abs("value") >= 0.2)
    path = F.array_join(F.transform("path", lambda p: F.concat_ws(":", p["level"], p["code"])), ",")
    return numbered(hierarchy.bundled(pairs.select("i", "j"), counts).withColumn("path", path))


def drilled_pairs(spark, sf):
    df = embedding_field(spark, sf)
    inner, sizes = hierarchy.drilled(df, BLOCK, OUTER, grid.sizes(df))
    _, factor = hierarchy.block_counts(sizes, 2)
    return numbered(regions.mean_pairs(ensemble.block_means(inner, factor)))


QUERIES = {"block_tree": block_tree, "bundled_pairs": bundled_pairs, "drilled_pairs": drilled_pairs}

_TREE = f"""WITH RECURSIVE {E}, g AS (SELECT max(x) // 3 + 1 AS nx, max(y) // 3 + 1 AS ny, max(z) // 3 + 1 AS nz FROM e),
 h AS (SELECT ceil(log2(greatest(nx, ny, nz)))::INT AS h FROM g),
 t AS (SELECT DISTINCT x // 3 AS cx, y // 3 AS cy, z // 3 AS cz, 0 AS level, 0::BIGINT AS lx, 0::BIGINT AS ly, 0::BIGINT AS lz,
 nx::BIGINT AS nx, ny::BIGINT AS ny, nz::BIGINT AS nz, 0::BIGINT AS code FROM e, g UNION ALL
 SELECT cx, cy, cz, level + 1, CASE WHEN px THEN lx + (nx + 1) // 2 ELSE lx END, CASE WHEN py THEN ly + (ny + 1) // 2 ELSE ly END,
 CASE WHEN pz THEN lz + (nz + 1) // 2 ELSE lz END, CASE WHEN px THEN nx // 2 ELSE (nx + 1) // 2 END, CASE WHEN py THEN ny // 2 ELSE (ny + 1) // 2 END,
 CASE WHEN pz THEN nz // 2 ELSE (nz + 1) // 2 END, code * 8 + px::INT + 2 * py::INT + 4 * pz::INT
 FROM (SELECT t.*, cx - lx >= (nx + 1) // 2 AS px, cy - ly >= (ny + 1) // 2 AS py, cz - lz >= (nz + 1) // 2 AS pz FROM t, h WHERE level < h))"""

ORACLE_SQL = {
    "block_tree": f"{_TREE} SELECT cx AS bx, cy AS by, cz AS bz, code FROM t, h WHERE level = h",
    "bundled_pairs": f"""{_TREE}, n AS (SELECT cz * 1000000 + cy * 1000 + cx AS id, list(level || ':' || code ORDER BY level) AS nodes FROM t GROUP BY 1),
 b AS (SELECT (z // 3) * 1000000 + (y // 3) * 1000 + x // 3 AS id, m, avg(v) AS v FROM e GROUP BY 1, 2),
 p AS (SELECT x.id AS i, y.id AS j, x.v AS a, y.v AS b FROM b x JOIN b y ON x.m = y.m AND x.id > y.id),
 c AS (SELECT i, j FROM p GROUP BY 1, 2 HAVING abs({CORR}) >= 0.2),
 o AS (SELECT i, j, a.nodes AS a, b.nodes AS b, len([k FOR k IN range(1, len(a.nodes) + 1) IF a.nodes[k] = b.nodes[k]]) AS same
 FROM c JOIN n a ON a.id = i JOIN n b ON b.id = j)
 SELECT i, j, array_to_string(list_concat(list_concat(list_reverse(a[same + 1:]), CASE WHEN same = len(a) - 1 THEN [a[same]] ELSE [] END), b[same + 1:]), ',') AS path
 FROM o""",
    "drilled_pairs": f"""WITH {E}, b AS (SELECT (z // 2) * 1000000 + (y // 2) * 1000 + (x - 5) // 2 AS id, m, avg(v) AS v FROM e
 WHERE x BETWEEN 5 AND 9 AND y < 5 AND z < 5 GROUP BY 1, 2),
 p AS (SELECT x.id AS i, y.id AS j, x.v AS a, y.v AS b FROM b x JOIN b y ON x.m = y.m AND x.id > y.id)
 SELECT i, j, round({CORR}, 9) AS value FROM p GROUP BY 1, 2""",
}
