"""Joins and positions that hold for frequent keys, rules by index, names in texts: against plain statements."""

import random

from pyspark.sql import functions as F

from auditloom.operators import keyed, mapping, ordered, packages


def test_join_by_hot_keys_equals_a_plain_join(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", None, f"k{rng.randrange(3000)}"]), i) for i in range(6000)]
    left = spark.createDataFrame(rows, "k string, i int")
    facts = spark.createDataFrame([("hot", "H")] + [(f"k{n}", str(n)) for n in range(0, 3000, 2)], "k string, v string")
    known = dict(facts.collect())
    got = {r["i"]: r["v"] for r in keyed.join_by_hot_keys(left, facts, "k").collect()}
    assert got == {i: known.get(k) for k, i in rows}
    inner = keyed.join_by_hot_keys(left, facts.where("k <> 'hot'"), "k", "inner")
    assert sorted(r["i"] for r in inner.collect()) == sorted(i for k, i in rows if k in known and k != "hot")
    none = keyed.join_by_hot_keys(left.limit(0), facts, "k")
    assert none.columns == ["k", "i", "v"] and none.count() == 0


def test_hot_rows_are_not_shuffled(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    facts = spark.range(0, 3000, 7).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))
    made = keyed.join_by_hot_keys(rows, facts, "k").withColumn("task", F.spark_partition_id())
    per_task = {r["task"]: r["count"] for r in made.where("k = 'hot'").groupBy("task").count().collect()}
    assert len(per_task) > 1 and max(per_task.values()) < 1500


def test_bit_filter_passes_all_that_match(spark):
    wanted = spark.range(0, 5000, 5).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    rows = spark.range(5000).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"), "id")
    got = {r["id"] for r in keyed.that_may_match(rows, keyed.bit_filter(wanted, "a", "b"), "a", "b").collect()}
    assert got >= set(range(0, 5000, 5)) and len(got) < 1100
    assert keyed.that_may_match(rows, keyed.bit_filter(wanted.limit(0), "a", "b"), "a", "b").count() == 0


def test_rules_by_index_equal_a_search(spark, findings):
    rng = random.Random(4)
    parts = ["sqli", "xss", "auth", "os", "v_", "e", "crypto", "log", "redirect"]
    rules, seen = [], set()
    for prio in rng.sample(range(10_000), 600):
        kind = rng.choice(["exact", "prefix", "contains"])
        needle = rng.choice(["", "osv_"]) * (kind == "prefix") + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
        words = [rng.choice(["dos", "leak", "inject"])] if kind == "prefix" and needle.startswith("osv_") and rng.random() < 0.7 else []
        if (kind, needle, tuple(words)) not in seen:
            seen.add((kind, needle, tuple(words)))
            rules.append((prio, f"t{prio}", kind, needle, words))
    ids = [rng.choice(["", "osv_"]) + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(150)] + ["", None, "nothing"]
    texts = ["a leak", "DoS and inject", "", None]
    df = findings(*[{"rule_id": r, "description": t, "finding_type": ft} for r in ids for t in texts for ft in (None, "own") if ft is None or t == ""])

    def by_hand(rid, text):
        rid = (rid or "").lower()
        text = (text or "").lower() if rid.startswith("osv_") else ""
        for _, kind_of, kind, needle, words in sorted(rules):
            if kind == "exact" and rid == needle or kind == "contains" and needle in rid or (
                kind == "prefix" and rid.startswith(needle) and (not words or any(w in text for w in words))
            ):
                return kind_of
        return mapping.controls.DEFAULT_TYPE

    table = spark.createDataFrame(rules, "prio int, finding_type string, kind string, needle string, desc_needles array<string>")
    got = mapping.classify_by_table(df, table).collect()
    assert len(got) == df.count()
    for r in got:
        want = r["finding_type"] or by_hand(r["rule_id"], r["description"])
        assert r["resolved_type"] == want, (r["rule_id"], r["description"])
    assert mapping.classify_by_table(df, table.limit(0)).where("finding_type is null").select("resolved_type").distinct().collect()[0][0] == mapping.controls.DEFAULT_TYPE


def test_positions_run_through_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.choice(["f1", "f2", None, "f3"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "repo_id string, file_path string, n int")
    want = {}
    for repo in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == repo), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        want.update({r[2]: i for i, r in enumerate(own)})
    assert {r["n"]: r["pos"] for r in ordered.numbered(df, "file_path", "n").collect()} == want
    monkeypatch.setattr(ordered, "BLOCK_POSITIONS", 7)
    one = df.where("n < 200").withColumn("pos", F.col("n").cast("bigint"))
    two = df.where("n >= 200").withColumn("pos", F.col("n").cast("bigint"))
    got = {r["n"]: r["pos"] for r in ordered.in_turn(two, one).collect()}
    turn = {}
    for repo in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == repo), key=lambda r: (r[2] < 200, r[2]))
        turn.update({r[2]: i for i, r in enumerate(own)})
    assert got == turn


def test_names_in_texts(spark):
    rng = random.Random(9)
    names = ["a", "ab", "left-pad", "express", "Über-lib", "zz", "request", "quest"]
    components = spark.createDataFrame([(f"r{i}", n, i) for i in range(4) for n in names], "repo_id string, name string, i int")
    rows = [(f"r{rng.randrange(4)}", f"uses {rng.choice(names).upper()}, see", rng.choice(["", None, "REQUESTS"])) for _ in range(6)]
    told = spark.createDataFrame(rows, "repo_id string, description string, title string")
    got = {(r["repo_id"], r["name"]) for r in packages._named_in_text(components, told).collect()}
    want = {(f"r{i}", n) for i in range(4) for n in names if any(r == f"r{i}" and n.lower() in f"{d}\n{t or ''}".lower() for r, d, t in rows)}
    assert got == want


def test_rolled_up_rows_equal_a_search(monkeypatch):
    """What a task keeps of each package, cut down again and again, gives what the whole gives."""
    import pyarrow as pa

    rng = random.Random(12)
    rows = [(rng.choice(["r", "r", None]), rng.choice(["hot", "hot", None, f"p{rng.randrange(6)}"]), i, rng.choice([None, f"CVE-{i}"]),
             rng.choice([None, "", f"text {i}"]), rng.choice([None, 0, 1, 4])) for i in rng.sample(range(10_000), 900)]
    schema = pa.schema([("repo_id", pa.string()), ("package", pa.string()), ("pos", pa.int64()), ("id", pa.string()), ("summary", pa.string()),
                        ("n", pa.int64()), ("rank", pa.int32()), ("low", pa.int64())])
    full = [(r, p, pos, i, s, int(i is not None), rank, pos) for r, p, pos, i, s, rank in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*full[at : at + 40]), schema.types)], schema=schema) for at in range(0, 900, 40)]
    for held in (60, 10_000):
        monkeypatch.setattr(packages, "HELD_ROWS", held)
        kept = [tuple(r.values()) for b in packages._shown_rows(iter(batches)) for r in b.to_pylist()]
        assert len(kept) < (300 if held > 900 else 500)
        for key in {r[:2] for r in full}:
            own, mine = sorted((r for r in full if r[:2] == key), key=lambda r: r[2]), sorted((r for r in kept if r[:2] == key), key=lambda r: r[2])
            assert [r[3] for r in mine if r[3] is not None][:3] == [r[3] for r in own if r[3] is not None][:3]
            assert [r[4] for r in mine if r[4]][:2] == [r[4] for r in own if r[4]][:2]
            assert (sum(r[5] for r in mine), max(r[6] for r in mine), min(r[7] for r in mine)) == (
                sum(r[5] for r in own), max(-1 if r[6] is None else r[6] for r in own), own[0][2])
