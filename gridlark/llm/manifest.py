"""Merkle manifest of a table: a leaf for each row, a tree for each source, and one tree over the sources.

Nodes are hex digests. Leaves are ranked within their source by a range
partitioning, whose counts give each partition's first place, so a source of
any size is ranked by many tasks. Blocks of a fixed number of consecutive
leaves are arrays, whose levels are collapsed by sequence, transform, slice
and aggregate; their roots are the leaves of the next round, until each source
has one node. Paths of siblings come down again through the blocks' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, slots, written

#: Levels that one block collapses, and children of a node: a block holds 3^5 leaves.
LEVELS = 5
FAN = 3
_NO_PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """A value with its number of UTF-8 bytes; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(row: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[encoded(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")]), 256)


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with ``pos``, a row's place in its group from 0, and ``n``, the group's size.

    Rows are spread by (group, order) over ranges and sorted there; a group's
    counts in earlier ranges are what its rows begin with. A group may span
    any number of ranges, and a range any number of groups. No group may be
    null. Rows that are equal in ``order`` are told apart by their place in
    the written table.
    """
    keys = [group, *order, "__row"]
    df = df.withColumn("__row", F.monotonically_increasing_id())
    # the id counts a partition's rows from the partition's number times 2^33
    df = df.repartitionByRange(slots(df), *keys).sortWithinPartitions(*keys).drop("__row").withColumn("__at", F.monotonically_increasing_id())
    df = written(df.withColumn("__part", F.shiftright("__at", 33)), "manifest-ranked")
    parts = df.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__size"))
    over = Window.partitionBy(group)
    before = F.sum("__size").over(over.orderBy("__part")) - F.col("__size")
    parts, _ = hinted(parts.withColumns({"__before": before, "n": F.sum("__size").over(over)}).drop("__size"))
    out = df.join(parts, [group, "__part"])
    return out.withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def _levels_of(n: Column) -> Column:
    """Levels from n nodes to one: the least L with 3^L >= n."""
    return F.size(F.filter(F.array(*[F.lit(FAN**i) for i in range(40)]), lambda x: x < n))


def _runs(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int")), lambda i: F.slice(nodes, i * FAN + 1, F.lit(FAN)))


def _collapsed(nodes: Column, levels: Column) -> Column:
    """All levels above ``nodes`` (one or more digests): an array of at most LEVELS arrays."""
    up = lambda level: F.transform(_runs(level), lambda run: F.sha2(F.array_join(run, ""), 256))
    start = F.array(nodes)
    step = lambda done, _: F.concat(done, F.array(up(F.element_at(done, -1))))
    return F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), levels), start, step)).otherwise(start)


def _path(all_levels: Column, at: Column, levels: Column) -> Column:
    """The siblings of node ``at``: for each level what stands left and right of it in its run."""

    def around(level: Column) -> Column:
        here = F.floor(at / F.pow(F.lit(FAN), level)).cast("int")
        nodes, first = F.get(all_levels, level), here - here % FAN
        return F.struct(
            F.array_join(F.slice(nodes, first + 1, here - first), "").alias("left"),
            F.array_join(F.slice(nodes, here + 2, first + FAN - 1 - here), "").alias("right"),
        )

    return F.when(levels > 0, F.transform(F.sequence(F.lit(0), levels - 1), around)).otherwise(F.array().cast(_NO_PATH))


def climbed(nodes: DataFrame, group: str, kept: list[str]) -> DataFrame:
    """The blocks of ``nodes`` with their group's last node as ``top``, and the siblings of their root as ``above``.

    ``nodes`` holds (group, pos, n, node, *kept). A block is FAN^LEVELS nodes;
    the rounds are as many as a group's size has powers of a block.
    """
    size = FAN**LEVELS
    row = F.struct(F.pmod("pos", F.lit(size)).cast("int").alias("at"), "node", *kept).alias("row")
    rows = nodes.select(group, "n", F.floor(F.col("pos") / size).cast("long").alias("block"), row)
    blocks = rows.groupBy(group, "block").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.max("n").alias("n"))
    blocks = blocks.withColumn("levels", F.least(F.lit(LEVELS), _levels_of(F.col("n"))))
    blocks = blocks.withColumn("all", _collapsed(F.transform("rows", lambda r: r["node"]), F.col("levels")))
    blocks = written(blocks.withColumn("root", F.get(F.element_at("all", -1), F.lit(0))), "manifest-blocks")
    over = blocks.filter(F.col("n") > size)
    if over.isEmpty():
        # every group is one block
        return blocks.withColumns({"above": F.array().cast(_NO_PATH), "top": F.col("root")})
    n = F.ceil(F.col("n") / size).cast("long")
    roots = over.select(group, F.col("block").alias("pos"), n.alias("n"), F.col("root").alias("node"))
    above = paths(climbed(roots, group, ["pos"]), group, ["pos"])
    above = above.select(group, F.col("pos").alias("block"), F.col("path").alias("above"), "top")
    blocks = blocks.join(above, [group, "block"], "left")
    return blocks.withColumns({"above": F.coalesce("above", F.array().cast(_NO_PATH)), "top": F.coalesce("top", "root")})


def paths(blocks: DataFrame, group: str, kept: list[str]) -> DataFrame:
    """(group, *kept, node, top, path) of each node of climbed blocks; path holds its siblings, level by level up to the top."""
    path = lambda r: F.concat(_path(F.col("all"), r["at"], F.col("levels")), F.col("above")).alias("path")
    rows = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in (*kept, "node")], path(r)))
    out = blocks.select(group, "top", F.explode(rows).alias("row"))
    return out.select(group, *[F.col(f"row.{c}").alias(c) for c in (*kept, "node")], "top", "row.path")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    ``tampered`` is the text that a check finds, by default the row's own:
    folded_root is recomputed from its leaf and the untampered siblings.
    Sources are ordered with null first, then by UTF-8 bytes; leaves by doc_id
    with null first, ties by their digest. Repeated rows are leaves of their
    own. Null fields count as such, and differ from empty ones; very long
    texts are hashed whole; other columns are left aside. A lone row is its
    own subroot, and root if its source is alone; then its proof is the digest
    of nothing. An empty table gives an empty table.
    """
    row = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    found = leaf_of(row | {"text": tampered}) if tampered is not None else leaf_of(row)
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("group")
    leaves = docs.select(key, "doc_id", leaf_of(row).alias("node"), found.alias("found"))
    blocks = climbed(ranked(written(leaves, "manifest-leaves"), "group", ["doc_id", "node"]), "group", ["doc_id", "found"])
    tops = blocks.select(F.lit("").alias("all_groups"), "group", F.col("top").alias("node")).distinct()
    tops = ranked(written(tops, "manifest-subroots"), "all_groups", ["group"])
    above = paths(climbed(tops, "all_groups", ["group"]), "all_groups", ["group"])
    above, _ = hinted(above.select("group", F.col("top").alias("root"), F.col("path").alias("last")))
    out = paths(blocks, "group", ["doc_id", "found"]).join(above, "group")
    path = F.concat("path", "last")
    proof = F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate(path, F.col("found"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    out = out.select("doc_id", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_breaks(doc_id: Column, text: Column) -> Column:
    """The text without \\n where 2 divides crc32 of the decimal doc_id; others, and rows without doc_id, as they are."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)
