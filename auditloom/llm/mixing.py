"""Mixing sources to target weights by entropy balancing, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import join_facts, row_key, unused, written

WORD = "[^\\x20\\x09-\\x0D]+"

#: A group of documents of one source and size is dealt to parts of about this many before its rows are ranked.
PART_ROWS = 4096

#: A source whose words are within this share of its target needs no correction.
NEAR = 0.0005


def _group(source: str, size: str) -> Column:
    """Text that names source and size; a null source differs from every text."""
    return F.concat(F.col(size).cast("string"), F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), source)))


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sources`` (source, name, source_size, n_docs) with ``target``: weights by code point order, null last, repeating.

    Targets fill up like water: with level L a source gets min(cap * size, weight * L).  In the order of cap * size /
    weight the full sources come first, so running sums give the level; the excess of full sources thereby goes to the
    others by weight.  One row per source, and the order of the sources is one global order.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    room = sources.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "name")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = room.withColumn("full", F.col("most") <= F.col("weight") * level)
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(
        F.sum(F.when(F.col("full"), F.col("most")).cast("decimal(28,9)")).over(whole).cast("double"), F.lit(0.0)
    )
    rest = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * left / rest)
    return leveled.withColumn("target", target).select("source", "name", "source_size", "n_docs", "target")


def _total(value: Column) -> Column:
    """Sum of doubles as decimals of nine places: the same whatever the order in which the shuffle brings them."""
    return F.sum(value.cast("decimal(28,9)")).cast("double")


def tilts(sizes: DataFrame, sources: DataFrame, cap: float, rounds: int = 60, exact: float = 1e-6) -> DataFrame:
    """The dual variable of each source: columns name, tilt, mean.

    Documents of size s get the rate min(cap, exp(tilt * s / mean)): of all rates up to ``cap`` that meet the source's
    word target this is the one of least relative entropy to one copy each.  The dual is convex; each round is one
    distributed pass over (source, size, count) that sums value and slope, then a Newton step, kept inside the bracket.
    """
    log_cap = F.log(F.lit(float(cap)))
    least = sizes.groupBy("name").agg(F.min("size").alias("least"))
    state = sources.where("source_size > 0").join(least, "name").select(
        "name", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), F.col("source_size").alias("words"), "least",
    ).select(
        "name", "target", "mean",
        F.when(F.col("target") >= F.col("words"), 0.0).otherwise(F.lit(float("-inf"))).alias("low"),
        F.when(F.col("target") >= F.col("words"), log_cap * F.col("mean") / F.col("least")).otherwise(0.0).alias("high"),
        F.when(F.col("target") >= F.lit(float(cap)) * F.col("words") * (1 - exact), log_cap * F.col("mean") / F.col("least")).otherwise(0.0).alias("tilt"),
        (F.col("target") >= F.lit(float(cap)) * F.col("words") * (1 - exact)).alias("done"),
    )
    state = written(state, "tilts")
    for _ in range(rounds):
        if state.where("NOT done").isEmpty():
            break
        pull = F.col("tilt") * F.col("size") / F.col("mean")
        free = pull < log_cap
        rate = F.exp(F.least(pull, log_cap))
        words = F.col("n") * F.col("size") * rate
        sums = sizes.join(state.where("NOT done").select("name", "tilt", "mean"), "name").groupBy("name").agg(
            _total(words).alias("reached"), _total(F.when(free, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")
        )
        over = F.col("reached") - F.col("target")
        stepped = state.join(sums, "name", "left").withColumn("low2", F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn(
            "high2", F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
        ).withColumn("newton", F.when(F.col("slope") > 0, F.col("tilt") - over / F.col("slope")))
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("low2")) & (F.col("newton") < F.col("high2"))
        middle = F.when(F.col("low2") == float("-inf"), F.col("high2") * 2 - 1).otherwise((F.col("low2") + F.col("high2")) / 2)
        settled = F.col("done") | (F.abs(over) <= F.col("target") * exact)
        state = written(stepped.select(
            "name", "target", "mean", F.coalesce("low2", "low").alias("low"), F.coalesce("high2", "high").alias("high"),
            F.when(settled, F.col("tilt")).when(inside, F.col("newton")).otherwise(middle).alias("tilt"), settled.alias("done"),
        ), "tilts")
    return state.select("name", "tilt", "mean")


def _rounded(sizes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """Per (source, size): ``base`` copies for each document and ``more``, how many documents get one more.

    Running sums of the fractions from the largest size down are rounded, so counts follow the rates; the few words then
    missing or over are made up by single copies, largest fitting size first, until none fits: every round takes from what
    is missing, so it ends.
    """
    down = Window.partitionBy("name").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = sizes.withColumn("base", F.floor("rate").cast("long")).withColumn("part", F.col("n") * (F.col("rate") - F.col("base")))
    upto = F.sum("part").over(down)
    dealt = parts.withColumn(
        "more", F.greatest(F.lit(0), F.least(F.col("n"), F.floor(upto + 0.5) - F.floor(upto - F.col("part") + 0.5))).cast("long")
    ).select("grp", "name", "size", "n", "rate", "base", "more")
    dealt = written(dealt, "rounded")
    goal = sources.select("name", "target")
    while True:
        taken = dealt.groupBy("name").agg(F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("more"))).alias("taken"))
        miss = goal.join(taken, "name").withColumn("miss", F.col("target") - F.col("taken")).where(F.abs("miss") > F.col("target") * NEAR)
        room = F.when(F.col("miss") > 0, F.when(F.col("base") + 1 <= F.lit(cap), F.col("n") - F.col("more")).otherwise(0)).otherwise(F.col("more"))
        fits = dealt.join(miss.select("name", "miss"), "name").where((F.col("size") <= F.abs("miss")) & (room > 0)).select(
            "name", F.struct("size", F.signum("miss").cast("long").alias("sign"), F.least(F.floor(F.abs("miss") / F.col("size")), room).cast("long").alias("by")).alias("pick")
        )
        picks = written(fits.groupBy("name").agg(F.max("pick").alias("pick")).select("name", "pick.*"), "picks")
        if picks.isEmpty():
            break
        dealt = written(dealt.join(picks, ["name", "size"], "left").select(
            "grp", "name", "size", "n", "rate", "base", (F.col("more") + F.coalesce(F.col("sign") * F.col("by"), F.lit(0))).alias("more")
        ), "rounded")
    return dealt


def copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
) -> DataFrame:
    """How often each document enters the mix: one row per distinct row of ``docs`` by id, source and text.

    Size is the number of words (``WORD``) of the text.  Sources in code point order, null last, weigh ``weights``,
    repeating, and share ``share`` of all words; no target exceeds ``cap`` times its source's words.  Rates come from
    entropy balancing (``tilts``) and are rounded to 0, 1, ... ``cap`` copies, so that the words taken from a source come
    near its target.  Which documents of one source and size get the further copy is settled by a hash of id and text.

    Columns: id, row (as scratch.row_key with the source), source, size, rows (how many equal rows), source_size,
    target, rate, copies (for each of the equal rows).  Null or blank text has size 0 and stays once.  Equal rows are
    treated alike.  Empty table: empty result.  All steps are deterministic, so reruns agree.
    """
    name = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source")))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), row_key(id_col, text_col).alias("row"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    units = written(rows.groupBy("row", "source", "size", "id").agg(F.count(F.lit(1)).alias("rows")).withColumn("name", name).withColumn("grp", _group("source", "size")), "mix-units")
    sizes = written(units.groupBy("grp", "name", "size").agg(F.sum("rows").alias("n")), "mix-sizes")
    sources = units.groupBy("source", "name").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n_docs"))
    sources = written(source_targets(sources, weights, share, cap), "mix-sources")
    filled = sizes.where("size > 0")
    tilt = tilts(filled, sources, cap)
    rate = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.log(F.lit(float(cap)))))
    top = F.when(rate > cap * (1 - 1e-9), F.lit(float(cap))).otherwise(rate)
    dealt = _rounded(filled.join(tilt, "name").select("grp", "name", "size", "n", top.alias("rate")), sources, cap)
    blank = sizes.where("size = 0").select("grp", "name", "size", "n", F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("base"), F.lit(0).cast("long").alias("more"))
    facts = dealt.unionByName(blank).join(sources.select("name", "source_size", "target"), "name").drop("name", "size")
    facts = written(facts, "mix-facts")
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.ceil(F.col("n") / PART_ROWS))
    placed = written(join_facts(units, facts, "grp", "n").withColumn("part", part), "mix-placed")
    per_part = placed.groupBy("grp", "part", "n", "more").agg(F.sum("rows").alias("in_part"))
    upto = F.sum("in_part").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    share_of = lambda x: F.floor(x * F.col("more") / F.col("n"))
    quota = per_part.select("grp", "part", (share_of(upto) - share_of(upto - F.col("in_part"))).alias("quota"))
    rank = Window.partitionBy("grp", "part").orderBy(F.xxhash64("row", F.lit(2)), "row").rowsBetween(Window.unboundedPreceding, 0)
    chosen = placed.where("more > 0").join(quota, ["grp", "part"]).withColumn("extra", (F.sum("rows").over(rank) <= F.col("quota")).cast("long"))
    plain = placed.where("more = 0").withColumn("extra", F.lit(0).cast("long"))
    return plain.unionByName(chosen.drop("quota")).select(
        "id", "row", "source", "size", "rows", "source_size", "target", "rate", (F.col("base") + F.col("extra")).alias("copies")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """``docs`` with each row as often as ``copies`` says (rows with none go); columns as before."""
    made = copies(docs, id_col, text_col, source_col, **how)
    key, times, src = unused(docs, "row_key"), unused(docs, "n_copies"), unused(docs, "source_name")
    made = made.select(F.col("row").alias(key), F.col("source").alias(src), F.col("copies").cast("int").alias(times)).where(F.col(times) > 0)
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    same = (keyed[key] == made[key]) & keyed[source_col].cast("string").eqNullSafe(made[src])
    joined = keyed.join(made.hint("merge"), same).drop(keyed[key]).drop(made[key])
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])
