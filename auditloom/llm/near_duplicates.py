"""Near-duplicate classes: ProbMinHash sketches, banding, exact check of the similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_blocks as tb
from .components import components
from .scratch import join_facts, row_key, unused, written

U64 = tb.U64
WORDS = 5
SIMILAR = 0.8
#: Bands of a sketch and registers per band: at similarity 0.8 one pair in 10,000 shares no band.
BANDS, BAND_ROWS = 24, 5
REGISTERS = BANDS * BAND_ROWS
#: Two sketches that agree in fewer registers belong to texts below SIMILAR (five standard errors off).
LEAST_AGREEING = int(REGISTERS * (SIMILAR - 5 * (SIMILAR * (1 - SIMILAR) / REGISTERS) ** 0.5))
#: Rows compared with each other in one task; larger groups are cut into blocks of this many.
GROUP_ROWS = 256


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of each text (capitals A-Z as small letters): hash, document, weight 1 + ln(count).

    Ordered by document, then hash.
    """
    starts, stops, doc = tb.words(data, offsets)
    hashes, doc = tb.shingles(tb.span_hashes(data, starts, stops, tb.LOWER_VALUES), doc, len(offsets) - 1, size)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1]))) if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    counts = np.diff(np.concatenate((at, [len(hashes)])))
    return hashes[at], doc[at], 1 + np.log(counts)


def prob_min_hash(hashes: np.ndarray, doc: np.ndarray, weights: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Sketch of each text: the element that reaches each register first.

    Every element sends arrivals of a Poisson process with its weight as rate, each to a random register, all settled by
    its hash; a register keeps the earliest arrival.  Two sketches agree in a register with the probability Jaccard
    similarity of the weighted sets.  Work goes on in time windows and ends for a text as soon as its latest register
    is earlier than anything still to come, so later arrivals of most elements are never drawn.
    """
    best = np.full(n_docs * registers, np.inf)
    owner = np.zeros(n_docs * registers, U64)
    total = np.bincount(doc, weights, n_docs)
    window = registers * (np.log(registers) + 1) / np.maximum(total, 1e-9)
    limit = window.copy()
    state = hashes.copy()
    time = np.zeros(len(hashes))
    who, rate, where = hashes, weights, doc

    def arrive(state, time, rate):
        state = tb.mixed(state + U64(0x9E3779B97F4A7C15))
        uniform = ((state >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53
        return state, time - np.log(uniform) / rate

    state, time = arrive(state, time, rate)
    while len(who):
        now = np.flatnonzero(time < limit[where])
        while len(now):
            register = ((tb.mixed(state[now] ^ U64(0xA5A5A5A5A5A5A5A5)) >> U64(32)) * U64(registers) >> U64(32)).astype(np.int64)
            slot = where[now] * registers + register
            np.minimum.at(best, slot, time[now])
            won = best[slot] == time[now]
            owner[slot[won]] = who[now][won]
            state[now], time[now] = arrive(state[now], time[now], rate[now])
            now = now[time[now] < limit[where[now]]]
        latest = best.reshape(n_docs, registers).max(1)
        going = (latest > limit)[where] & (time < latest[where])
        state, time, who, rate, where = state[going], time[going], who[going], rate[going], where[going]
        limit += window
    return owner.reshape(n_docs, registers)


#: A register is kept as 16 bits of its owner's hash: enough to compare sketches, and 80 bits to a band.  A text with
#: repeated shingles has a second sketch behind the first, of equal weights; for all others both are the same.
SKETCHES = "id binary, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch of each text, by its weights and (if these differ) by equal weights, named by its digest; texts without words get none."""
    for batch in batches:
        for rows, data, offsets in tb.text_blocks(batch.column("text")):
            n = len(offsets) - 1
            hashes, doc, weights = weighted_shingles(data, offsets, WORDS)
            short = (tb.mixed(prob_min_hash(hashes, doc, weights, n)) & U64(0xFFFF)).astype(np.uint16)
            repeating = np.flatnonzero(np.bincount(doc, weights > 1, n))
            again = np.isin(doc, repeating)
            level = prob_min_hash(hashes[again], np.searchsorted(repeating, doc[again]), np.ones(again.sum()), len(repeating))
            plain = dict(zip(repeating.tolist(), (tb.mixed(level) & U64(0xFFFF)).astype(np.uint16), strict=True))
            made = [short[i].tobytes() + (plain[i].tobytes() if i in plain else b"") for i in np.flatnonzero(np.bincount(doc, minlength=n)).tolist()]
            filled = np.flatnonzero(np.bincount(doc, minlength=n))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(rows.start, n).take(pa.array(filled)), pa.array(made, pa.binary())],
                names=["id", "sketch"],
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle hashes of each text, sorted, and their weights (4-byte floats), beside the columns given."""
    for batch in batches:
        passed = [c for c in batch.schema.names if c != "text"]
        for rows, data, offsets in tb.text_blocks(batch.column("text")):
            n = len(offsets) - 1
            hashes, doc, weights = weighted_shingles(data, offsets, WORDS)
            cuts = np.searchsorted(doc, np.arange(1, n))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).slice(rows.start, n) for c in passed],
                pa.array([h.tobytes() for h in np.split(hashes, cuts)], pa.binary()),
                pa.array([w.astype(np.float32).tobytes() for w in np.split(weights, cuts)], pa.binary()),
            ], names=[*passed, "payload", "weights"])


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Sum over shared elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i); x, y: weights, 0 where absent.

    With equal weights this is the plain Jaccard similarity.
    """
    shared = (x > 0) & (y > 0)
    if not shared.any():
        return 0.0
    if x.max() == y.max() == x[shared].min() == y[shared].min() and ((x == 0) | (x == x.max())).all() and ((y == 0) | (y == y.max())).all():
        return float(shared.sum() / len(x))
    # max(x_j / x_i, y_j / y_i) is the first where x_j / y_j >= x_i / y_i: order by that ratio, then use running sums.
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    sums_x = np.concatenate(([0.0], np.cumsum(x[order][::-1])))[::-1]
    sums_y = np.concatenate(([0.0], np.cumsum(y[order])))
    i = np.flatnonzero(shared)
    at = np.searchsorted(ratio[order], ratio[i], "left")
    return float((1 / (sums_x[at] / x[i] + sums_y[at] / y[i])).sum())


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The greater of probability Jaccard (weighted) and plain Jaccard of two weighted shingle sets."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    return max(probability_jaccard(x, y), float(((x > 0) & (y > 0)).sum() / max(len(every), 1)))


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _spanning(pairs: np.ndarray, parent: list[int], check: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Those pairs that join two parts (and pass the check)."""
    out = []
    for i, j in pairs.tolist():
        a, b = _find(parent, i), _find(parent, j)
        if a != b and (check is None or check(i, j)):
            parent[a] = b
            out.append((i, j))
    return out


def _registers(rows: list[dict]) -> np.ndarray:
    """Registers of each row by weights and by equal weights (row, kind, register)."""
    return np.stack([np.resize(np.frombuffer(r["payload"], np.uint16), (2, REGISTERS)) for r in rows])


def sketch_links(left: list[dict], right: list[dict] | None) -> list[tuple[int, int]]:
    """Links between rows whose sketches of either kind agree often enough; ``right`` None: within ``left``."""
    a = _registers(left)
    b = a if right is None else _registers(right)
    if all(len(r["payload"]) == 2 * REGISTERS for r in left + (right or [])):
        a, b = a[:, :1], b[:, :1]
    found = []
    for i in range(len(a)):
        agree = (b[i + 1 if right is None else 0 :] == a[i]).sum(2).max(1)
        hits = np.flatnonzero(agree >= LEAST_AGREEING) + (i + 1 if right is None else 0)
        found.append(np.stack([np.full(len(hits), i), hits + (0 if right is None else len(a))], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), int)
    return _spanning(pairs, list(range(len(a) + (0 if right is None else len(b)))))


def exact_links(left: list[dict], right: list[dict] | None) -> list[tuple[int, int]]:
    """Links between rows of SIMILAR or more, by exact counting; ``right`` None: within ``left``.

    Counts of shared shingles come from one sorted list of (shingle, row); whatever could reach SIMILAR on either
    measure is then compared exactly, unless its rows are joined already.
    """
    rows = left if right is None else left + right
    sets = [np.frombuffer(r["payload"], U64) for r in rows]
    weights = [np.frombuffer(r["weights"], np.float32).astype(np.float64) for r in rows]
    n, m = len(rows), len(left)
    sizes = np.array([len(s) for s in sets])
    flat, at = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(n), sizes)
    several = np.bincount(at, minlength=len(flat)) > 1
    number = np.cumsum(several) - 1
    keep = several[at]
    cols, who, mass = number[at[keep]], who[keep], np.concatenate(weights)[keep]
    order = np.argsort(cols, kind="stable")
    cols, who, mass = cols[order], who[order], mass[order]
    heavy = np.array([w.sum() for w in weights])
    even = np.array([len(w) == 0 or w.max() == 1 for w in weights])
    shared = np.zeros((n, n), np.float32)
    light = np.zeros((n, n), np.float32)
    for lo in range(0, int(several.sum()), 4096):
        inside = slice(*np.searchsorted(cols, (lo, lo + 4096)))
        block = np.zeros((n, 4096), np.float32)
        block[who[inside], cols[inside] - lo] = 1
        shared += block @ block.T
        if not even.all():
            block[who[inside], cols[inside] - lo] = mass[inside]
            light += block @ (block > 0).T.astype(np.float32)
    if even.all():
        light = shared
    plain = shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1)
    # Probability Jaccard is at most the shared part of either side's weight.
    most = np.minimum(light / heavy[:, None], light.T / heavy[None, :])
    could = np.triu((plain >= SIMILAR - 1e-6) | ((most >= SIMILAR - 1e-6) & ~(even[:, None] & even[None, :])), 1)
    if right is not None:
        could[m:, :] = False
        could[:, :m] = False
    pairs = np.argwhere(could)
    pairs = pairs[np.argsort(-plain[pairs[:, 0], pairs[:, 1]], kind="stable")]
    sure = plain >= SIMILAR + 1e-6
    return _spanning(pairs, list(range(n)), lambda i, j: bool(sure[i, j]) or similarity((sets[i], weights[i]), (sets[j], weights[j])) >= SIMILAR)


LINKS = "grp string, a binary, b binary"
LinkFinder = Callable[[list[dict], list[dict] | None], list[tuple[int, int]]]


def _per_group(find: LinkFinder, with_sides: bool):
    """Arrow function over rows sorted by ``grp`` (and ``side``): links found within each group, or between its sides."""

    def close(rows: list[dict]) -> list[tuple[str, bytes, bytes]]:
        if with_sides:
            left, right = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
            pairs, rows = (find(left, right) if left and right else []), left + right
        else:
            pairs = find(rows, None) if len(rows) > 1 else []
        return [(rows[i]["grp"], rows[i]["id"], rows[j]["id"]) for i, j in pairs]

    def as_batch(found: list[tuple[str, bytes, bytes]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=["grp", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            found: list[tuple[str, bytes, bytes]] = []
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if held and held[0]["grp"] != row["grp"]:
                        found += close(held)
                        held = []
                    held.append(row)
            yield as_batch(found)
        yield as_batch(close(held) if held else [])

    return run


def links_within(rows: DataFrame, find: LinkFinder, payload: list[str], hub: str) -> DataFrame:
    """Links (a, b) that connect what ``find`` connects within each group of ``rows (grp, n, id, payload..., hub)``.

    ``n`` is the size of the group.  Up to GROUP_ROWS rows meet in one task.  Of a larger group first all rows meet its
    hub, the row with the greatest ``hub`` value; the rows that the hub of this group does not reach then meet all rows,
    block by block, whatever hubs of other groups reached.  Only links that join two parts of what a task sees are returned, never all pairs of a group.
    ``rows`` should be a written table; ``grp`` is text.
    """
    small = rows.where(F.col("n").between(2, GROUP_ROWS)).select("grp", "id", *payload)
    found = small.repartition("grp").sortWithinPartitions("grp", "id").mapInArrow(_per_group(find, False), LINKS)
    large = rows.where(F.col("n") > GROUP_ROWS)
    if large.isEmpty():
        return found.select("a", "b")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / GROUP_ROWS))
    large = written(large.withColumn("block", block), "large-groups")
    blocks = lambda rows: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(rows) / GROUP_ROWS) - 1))
    side = lambda df, parts, no: df.select(F.concat_ws("/", "grp", *parts).alias("grp"), "id", *payload, F.lit(no).alias("side"))
    meet = lambda left, right: left.unionByName(right).repartition("grp").sortWithinPartitions("grp", "side").mapInArrow(_per_group(find, True), LINKS)
    hubs = large.groupBy("grp").agg(F.max(F.struct(hub, "id")).getField("id").alias("hub_id"))
    hub_rows = large.join(hubs, "grp").where("id = hub_id").withColumn("block", blocks("n"))
    by_hub = written(meet(side(hub_rows, ["block"], 0), side(large, ["block"], 1)), "hub-links")
    of_group = by_hub.withColumn("grp", F.regexp_replace("grp", "/[^/]*$", ""))
    reached = of_group.select("grp", F.explode(F.array("a", "b")).alias("id")).distinct()
    rest = written(large.join(reached, ["grp", "id"], "left_anti"), "not-reached")
    n_rest = rest.groupBy("grp").agg(F.count(F.lit(1)).alias("left"))
    asked = rest.join(n_rest, "grp").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("left") / GROUP_ROWS)))
    asked = asked.withColumn("block", blocks("n"))
    told = large.join(n_rest, "grp").withColumn("part", blocks("left"))
    by_block = meet(side(asked, ["part", "block"], 0), side(told, ["part", "block"], 1))
    return found.unionByName(by_hub).unionByName(by_block).select("a", "b").where("a <> b")


def near_duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct (id, text): row (as scratch.row_key), id, ``digest`` of the text, ``root`` (row of its class).

    Equal texts are joined first, by digest; sketches are made for one of each.  Rows of a class are connected by pairs
    of similarity SIMILAR or more (five-word shingles); its root is the row with the least (id, row).
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(id_col, text_col).alias("row")
    )
    texts = written(rows.select("id", "row", F.unhex(F.md5("text")).alias("digest")), "text-digests")
    firsts = written(texts.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n")), "text-firsts")
    sketches = rows.select(F.unhex(F.md5("text")).alias("id"), "text").mapInArrow(_sketch, SKETCHES).dropDuplicates(["id"])
    sketches = written(sketches, "sketches")
    # Bands of both sketches; where a text has the same one in both, it counts once.
    last = (F.octet_length("sketch") / (2 * BAND_ROWS)).cast("int") - 1
    band = F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0), last), lambda b: F.xxhash64(b % BANDS, F.substring(F.col("sketch"), b * (2 * BAND_ROWS) + 1, 2 * BAND_ROWS))
    )))
    bands = sketches.select(band.alias("band"), "id")
    groups = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("members")).where("n > 1")
    # Bands that hold the same texts are needed once.
    groups = written(groups.groupBy("n", "members").agg(F.min("band").alias("band")).select("band", "n"), "band-groups")
    met = written(bands.join(groups, "band"), "band-members")
    popular = written(met.groupBy("id").agg(F.sum("n").alias("popular")), "popular")
    met = met.join(popular.join(sketches, "id"), "id").select(
        F.col("band").cast("string").alias("grp"), "n", "id", "popular", F.col("sketch").alias("payload")
    )
    likely = components(links_within(written(met, "band-rows"), sketch_links, ["payload"], "popular"))
    likely = likely.withColumnRenamed("root", "cluster")
    counts = likely.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    members = likely.join(counts, "cluster").join(popular, "id").withColumn("grp", F.hex("cluster"))
    # The whole text of each member, once; by a merge join at every size, as members grow with the table.
    wanted = firsts.select(F.col("digest").alias("id"), F.col("first.row").alias("row")).join(members, "id").select("row", "id", "grp", "n", "popular")
    chosen = rows.select("row", "text").join(written(wanted, "members").hint("merge"), "row").dropDuplicates(["row"]).drop("row")
    sets = chosen.select("id", "grp", "n", "popular", "text").mapInArrow(
        _shingle_sets, "id binary, grp string, n long, popular long, payload binary, weights binary"
    )
    classes = components(links_within(written(sets, "shingle-sets"), exact_links, ["payload", "weights"], "popular"))
    return _with_roots(texts, firsts, classes)


def _with_roots(texts: DataFrame, firsts: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with the least (id, row) of their class."""
    found = firsts.join(classes.withColumnRenamed("id", "digest"), "digest", "left").withColumn("cls", F.coalesce("root", "digest"))
    found = written(found.select("digest", "first", "n", "cls"), "class-members")
    roots = found.groupBy("cls").agg(F.min("first").alias("root"))
    facts = written(found.join(roots, "cls").select("digest", "n", "root"), "class-roots")
    return join_facts(texts, facts, "digest", "n").select("id", "row", "digest", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, is_first)``, one row per row of ``docs``: class_id is the least id of its near-duplicate class.

    Classes are the connected parts of all pairs of texts with similarity 0.8 or more: probability Jaccard of their
    five-word shingles weighted 1 + ln(count), or plain Jaccard, whichever is greater; without repeats within a text both
    are the same.  Words are runs of non-blank characters, A-Z as a-z; fewer than five words make one shingle.

    Null and empty text are one text; texts without a word are near only to equal texts.  Repeated rows: one row each,
    all of one class; ``is_first`` holds for the row of the class with the least (id, row digest), and for its repeats.
    A null id is the smallest.  Other columns of ``docs`` are not read.  Empty table: empty result.
    """
    found = near_duplicate_rows(docs, id_col, text_col)
    return found.select(
        F.col("id").alias(id_col), F.col("root.id").alias("class_id"), (F.col("root.row") == F.col("row")).alias("is_first")
    )


def keep_first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate class, the one with the least id; repeated rows count as copies."""
    firsts = near_duplicate_rows(docs, id_col, text_col).where(F.col("root.row") == F.col("row")).select("row").distinct()
    key = unused(docs, "row_key")
    kept = docs.withColumn(key, row_key(id_col, text_col)).join(firsts.withColumnRenamed("row", key).hint("merge"), key, "left_semi")
    return kept.dropDuplicates([key]).drop(key)
