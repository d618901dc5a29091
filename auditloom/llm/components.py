"""Connected components of links between documents, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``(id, root)`` for every id in ``links (a, b)``: root is the least id it is connected with.

    Each round points every id at the least root among its neighbours and then at that root's root, so chains halve;
    rounds are cut by written tables.  Only sums and minima per id are kept, so an id with many links needs no room.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "links")
    roots = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("root")), "roots")
    for _ in range(max_rounds):
        # The least root next to each id, and the same for the root of the id.
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("best"))
        hooked = roots.join(near, roots["id"] == near["a"]).select("id", "root", F.least("root", "best").alias("best"))
        hooks = hooked.select(F.col("id").alias("x"), "best").unionByName(hooked.select(F.col("root").alias("x"), "best"))
        moved = written(hooks.groupBy("x").agg(F.min("best").alias("root")).select(F.col("x").alias("id"), "root"), "roots")
        jumped = moved.join(moved.select(F.col("id").alias("root"), F.col("root").alias("up")), "root", "left").select(
            "id", F.coalesce("up", "root").alias("root")
        )
        jumped = written(jumped, "roots")
        changed = jumped.join(roots.withColumnRenamed("root", "was"), "id", "left").where("was IS NULL OR was <> root")
        if changed.isEmpty():
            return jumped
        roots = jumped
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
