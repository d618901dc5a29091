"""Merkle manifest of a table: a tree per group, a tree over the groups, and a proof for every row by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import unused, written

#: Levels of a tree that one task builds from 2**LEVELS neighbouring nodes; more levels take another round.
LEVELS = 8
#: Bytes up to which the ancestors of a jump are sent to every task, worked out from the sizes of the trees.
FEW_BYTES = 1 << 20
#: Tree number of the tree whose leaves are the roots of the others.
TOP = -1


def record_digest(columns: Sequence[Column | str]) -> Column:
    """Lower-case hex SHA-256 of a row: per column ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows of ``df`` stored in sorted ranges, with ``_at``: number of the range above bit 33, place in it below.

    Equal keys may fall into several ranges (a random last key parts them), so no key fills a task.
    """
    ranged = df.withColumn("_salt", F.rand(11)).repartitionByRange(*order, "_salt")
    return written(ranged.sortWithinPartitions(*order, "_salt").drop("_salt").withColumn("_at", F.monotonically_increasing_id()), name)


def _starts(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Per range and key values: where they start in the range and how many rows of the key stand in earlier ranges."""
    counted = ordered.groupBy(*keys, F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per range and key, ranges being sorted by key: as many as ranges and keys together.
    place = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_before", F.coalesce(F.sum("_n").over(place), F.lit(0)))


def _numbered_groups(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(groups, starts)``: number, size and height of each group in order; where each group starts in each range."""
    starts = written(_starts(ordered, ["grp"]), "merkle-starts")
    sizes = _in_order(starts.groupBy("grp").agg(F.sum("_n").alias("size")), ["grp"], "merkle-groups")
    firsts = _starts(sizes.withColumn("_all", F.lit(0)), ["_all"]).select("_part", "_first", "_before")
    sizes = sizes.withColumn("_part", F.shiftright("_at", 33)).join(firsts, "_part")
    # The bits of size - 1 give the height exactly, at any size.
    height = F.when(F.col("size") < 2, 0).otherwise(F.length(F.bin(F.col("size") - 1)))
    return written(sizes.select("grp", (F.col("_at") - F.col("_first") + F.col("_before")).alias("tree"), "size", height.alias("height")), "merkle-groups"), starts


NODES = "tree long, level int, idx long, height int, digest binary, sibling binary"
#: The same for Arrow.
ARROW = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("height", pa.int32()), ("digest", pa.binary()), ("sibling", pa.binary())])


def _hashed(left: bytes, right: bytes | None) -> bytes:
    return hashlib.sha256((left.hex() + (right.hex() if right else "")).encode()).digest()


def _built(base: int):
    """Blocks of neighbouring nodes of level ``base`` to all nodes above and in them, up to LEVELS levels on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, layer = [], [node["digest"] for node in row["nodes"]]
                first, height = row["block"] << LEVELS, row["height"]
                for level in range(base, min(base + LEVELS, height) + 1):
                    last = level == height or level == base + LEVELS
                    for i, digest in enumerate(layer):
                        other = layer[i ^ 1] if not last and i ^ 1 < len(layer) else None
                        # The node a block ends in gets its sibling in the next round.
                        if not last or level == height:
                            rows.append((row["tree"], level, first + i, height, digest, other))
                    if last:
                        if level < height:
                            rows.append((row["tree"], -level, first, height, layer[0], None))
                        break
                    layer = [_hashed(layer[i], layer[i + 1] if i + 1 < len(layer) else None) for i in range(0, len(layer), 2)]
                    first >>= 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), ARROW.types)], schema=ARROW)

    return run


def _trees(leaves: DataFrame, tallest: int) -> DataFrame:
    """All nodes of the trees over ``leaves (tree, idx, height, digest)``, each with its sibling's digest (null: none).

    A block is 2**LEVELS neighbours, so no task holds more of a tree at once; every round goes LEVELS levels up and
    hands on 1/2**LEVELS of its nodes.
    """
    done, layer, base = None, leaves, 0
    while True:
        blocks = layer.groupBy("tree", "height", F.shiftright("idx", LEVELS).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("nodes")
        )
        built = written(blocks.mapInArrow(_built(base), NODES), "merkle-nodes")
        # A negative level marks what the next round starts from.
        part = built.where("level >= 0")
        done = part if done is None else done.unionByName(part)
        if base + LEVELS >= tallest:
            return done
        layer, base = built.where("level < 0").select("tree", "idx", "height", "digest"), base + LEVELS


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes below a root with the node above as a struct ``up`` and the segment towards it; roots of the trees of the
    groups are leaves of the top tree, and named as such."""
    up = F.struct(
        F.when((F.col("tree") != TOP) & (F.col("level") + 1 == F.col("height")), F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("tree"),
        F.when((F.col("tree") != TOP) & (F.col("level") + 1 == F.col("height")), 0).otherwise(F.col("level") + 1).cast("int").alias("level"),
        F.when((F.col("tree") != TOP) & (F.col("level") + 1 == F.col("height")), F.col("tree")).otherwise(F.shiftright("idx", 1)).cast("long").alias("idx"),
    )
    return nodes.where("level < height").select(
        F.struct("tree", "level", "idx").alias("node"), up.alias("up"), F.array("sibling").alias("path")
    )


def _jump(rows: DataFrame, above: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the segment of the node they point to behind their own, pointing where that node points."""
    further = above.select(F.col("node").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"))
    joined = rows.join(F.broadcast(further) if few else further, "up", "left")
    path = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path"))
    return joined.withColumn("path", path).withColumn("up", F.col("_up")).drop("_path", "_up")


def folded(leaf: Column, path: Column, index: Column, height: Column, tree: Column) -> Column:
    """The root that a leaf digest (hex) leads to along ``path``; ``index``, ``height`` and ``tree`` say on which side
    the siblings stand: the bits of the index below the height, those of the tree's number above."""
    steps = F.transform(path, lambda sibling, i: F.struct(
        F.lower(F.hex(sibling)).alias("sibling"),
        # Shifts by a column need the SQL form; 2 ** i is exact.
        (F.when(i < height, F.floor(index / F.pow(F.lit(2.0), i))).otherwise(F.floor(tree / F.pow(F.lit(2.0), i - height))) % 2 == 1).alias("left"),
    ))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(
        F.when(s["sibling"].isNull(), node).when(s["left"], F.concat(s["sibling"], node)).otherwise(F.concat(node, s["sibling"])), 256
    ))


def manifest(rows: DataFrame, leaf_col: str = "leaf", group_col: str = "lang", order_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``rows`` with their place in the tree, its roots and their proof.

    ``leaf_col`` holds a hex digest (see ``record_digest``).  Per value of ``group_col`` the leaves ascend by
    ``order_cols``, then by digest (nulls first); while several nodes remain, two neighbours, or a last one alone,
    become the SHA-256 of their hex digests.  What remains is the group's ``subroot``; the subroots in order of the
    group (null first, bytewise) likewise give ``root``.  Added: ``tree`` (number of the group), ``height`` (of its
    tree), ``index`` (of the leaf), ``subroot``, ``root`` (hex) and ``path``: sibling digests as bytes from the leaf to
    the root, null where a node has no sibling.  ``folded`` turns leaf and path into a root again.

    The path comes by pointer jumping: every node starts with the segment to its parent; each self-join appends the
    segment of the node it points to and takes over its pointer, so 2**k levels are done after k joins.  A node less
    than 2**k levels up is nobody's target any more, so only leaves and higher nodes go on.

    Null ids or group: the first in order, null group is a group.  Repeated rows are leaves of their own; equal keys
    are ordered by digest, so results do not depend on the order of the input.  Null digests are not allowed.  Columns
    of ``rows`` stay, unless named like an added one: those are replaced.  One group or key may hold any share of the
    rows: ranges, blocks and jumps are all cut by place.  Empty table: empty result.
    """
    added = ["tree", "height", "index", "subroot", "root", "path"]
    kept = rows.drop(*[c for c in rows.columns if c.lower() in added and c not in (leaf_col, group_col, *order_cols)])
    carried = unused(kept, "row")
    bare = kept.select(
        F.col(group_col).alias("grp"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(order_cols)], F.col(leaf_col).alias("leaf"),
        F.struct(*[F.col(c) for c in kept.columns]).alias(carried),
    )
    ordered = _in_order(bare, ["grp", *[f"k{i}" for i in range(len(order_cols))], "leaf"], "merkle-leaves")
    groups, starts = _numbered_groups(ordered)
    totals = groups.agg(F.max("height").alias("tallest"), F.count(F.lit(1)).alias("n")).first()
    top_height = max(totals["n"] - 1, 0).bit_length()

    known = starts.alias("s").join(groups.alias("g"), F.col("s.grp").eqNullSafe(F.col("g.grp"))).select(
        F.col("s.grp").alias("_grp"), F.col("_part"), "_first", "_before", "tree", "height"
    )
    placed = ordered.withColumn("_part", F.shiftright("_at", 33)).join(
        known.withColumnRenamed("_part", "_of"), (F.col("_part") == F.col("_of")) & F.col("grp").eqNullSafe(F.col("_grp"))
    ).select(
        carried, "tree", "height", (F.col("_at") - F.col("_first") + F.col("_before")).alias("index"), F.unhex("leaf").alias("digest")
    )
    placed = written(placed, "merkle-placed")
    nodes = _trees(placed.select("tree", F.col("index").alias("idx"), "height", "digest"), totals["tallest"] or 0)
    subroots = nodes.where("level = height").select(F.col("tree").alias("idx"), "digest")
    top = _trees(subroots.select(F.lit(TOP).cast("long").alias("tree"), "idx", F.lit(top_height).alias("height"), "digest"), top_height)
    root = top.where("level = height").select(F.lower(F.hex("digest"))).first()

    linked = written(_with_parents(nodes.unionByName(top)), "merkle-links")
    # A group's only leaf is a leaf of the top tree.
    single = F.col("height") == 0
    leaf_node = F.struct(
        F.when(single, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("tree"), F.lit(0).alias("level"),
        F.when(single, F.col("tree")).otherwise(F.col("index")).alias("idx"),
    )
    rows_up = placed.drop("digest").withColumn("node", leaf_node).join(
        linked.where("node.level = 0"), "node", "left"
    ).withColumn("path", F.coalesce("path", F.array().cast("array<binary>"))).drop("node")
    above, reach = linked.where(f"node.level >= 1 OR node.tree = {TOP}"), 1
    while reach < (totals["tallest"] or 0) + top_height:
        higher = F.expr(f"aggregate(sequence(0, 62), 0D, (s, l) -> s + if(l >= {reach} AND l <= height, ceil(size / pow(2D, l)), 0D))")
        targets = (groups.agg(F.sum(higher)).first()[0] or 0) + 2 * totals["n"]
        few = targets * (100 + 40 * reach) <= FEW_BYTES
        rows_up = _jump(rows_up, above, few)
        reach *= 2
        if reach < (totals["tallest"] or 0) + top_height:
            above = written(_jump(above.where(f"node.level >= {reach} OR node.tree = {TOP}"), above, few), "merkle-jumps")
    named = subroots.select(F.col("idx").alias("tree"), F.lower(F.hex("digest")).alias("subroot"))
    few = totals["n"] * 100 <= FEW_BYTES
    return rows_up.join(F.broadcast(named) if few else named, "tree").select(
        f"{carried}.*", "tree", "height", "index", "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path"
    )
