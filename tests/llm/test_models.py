"""Language model, byte-level BPE, mixing, nearest vectors, classifier, fingerprints, pipeline."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import byte_bpe, max_entropy, mixing, nearest, quality, winnowing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)


def words(rng, n, size=300):
    return " ".join(f"w{min(rng.randrange(size), rng.randrange(size))}" for _ in range(n))


ODD = [(None, None, None), (None, "a b c", "s"), (1, "", "s"), (2, "same text", "s"), (2, "same text", "s"), (2, None, "t"), (3, " \n\t", None), (4, "long " * 40_000, "t"), (5, "é ß 中", "u")]


# --------------------------------------------------------------------------- language model

def test_base_score_and_model(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(("a b " if rng.random() < 0.7 else f"W{rng.randrange(40)} c ") for _ in range(60)), "s") for i in range(150)]
    rows += [(i + 1000, t, s) for i, (_, t, s) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in max_entropy.score_texts(table(spark, rows), rounds=25).collect()}
    toks = lambda t: [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows}
    counts = collections.Counter(w for i, t, _ in rows if not held[i] for w in toks(t))
    total, kinds = sum(counts.values()), len(counts)
    ours = base = 0
    for i, t, _ in rows:
        want = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in toks(t))
        row = got[i]
        assert abs(row["base_score"] - want) < 1e-6 * max(1, abs(want))
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held[i], len(toks(t)), total)
        assert row["n_known"] == sum(counts[w] > 0 for w in toks(t)) and math.isfinite(row["score"])
        if held[i] and i < 1000:
            ours, base = ours + row["score"], base + row["base_score"]
    assert ours > base


def test_class_probabilities_sum_to_one():
    weights = np.random.default_rng(1).normal(size=(max_entropy.ROWS, max_entropy.CLASSES))
    logs = max_entropy.log_probabilities(weights, np.arange(0, max_entropy.CONTEXTS, 97))
    assert np.allclose(np.exp(logs).sum(1), 1)


def test_model_on_odd_tables(spark):
    assert max_entropy.score_texts(table(spark, ODD).withColumn("score", F.lit(1)), rounds=2).count() == len(ODD)
    assert max_entropy.score_texts(table(spark, []), rounds=2).count() == 0


# --------------------------------------------------------------------------- tokens

def test_tokens_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    letters = "abcdeéñßтк中 \n\t12!*' e th in <|endoftext|>"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(200))), "s") for i in range(150)] + [r for r in ODD]
    got = byte_bpe.encode_documents(table(spark, rows).withColumn("ids", F.lit(0))).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in got) == want
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in got)
    assert byte_bpe.encode_documents(table(spark, [])).count() == 0


def test_one_long_piece_takes_linear_time():
    vocabulary = byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    piece = b"abcab" * 40_000
    assert b"".join(vocabulary.bytes_of[t] for t in vocabulary.encode(piece)) == piece


# --------------------------------------------------------------------------- mixing

def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 1 + int(rng.paretovariate(1.1) * 20) % 900), f"s{min(i % 7, i % 3)}") for i in range(600)]
    rows += [(i + 2000, t, s) for i, (_, t, s) in enumerate(ODD)]
    made = mixing.copies(table(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(r["rows"] for r in made) == len(rows)
    per = collections.Counter()
    for _, t, s in rows:
        per[s] += size(t)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    total, target, open_ = 1.5 * sum(per.values()), {}, set(per)
    while True:
        left, share = total - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / share >= 2 * per[s]} if share else set()
        if not full:
            target |= {s: left * weight[s] / share for s in open_}
            break
        target |= {s: 2.0 * per[s] for s in full}
        open_ -= full
    taken = collections.Counter()
    for r in made:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * total and r["source_size"] == per[r["source"]]
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"] * r["rows"]
    for s in per:
        least = min((r["size"] for r in made if r["source"] == s and r["size"]), default=0)
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + least, s
    again = mixing.copies(table(spark, rows[::-1])).collect()
    assert sorted((r["row"], r["copies"]) for r in made) == sorted((r["row"], r["copies"]) for r in again)
    mixed = mixing.mix(table(spark, rows).withColumn("row_key", F.lit(1)))
    assert mixed.columns == [*DOC.replace(" long", "").replace(" string", "").split(", "), "row_key"]
    assert mixed.count() == sum(r["copies"] * r["rows"] for r in made)


def test_longer_texts_lose_first_where_words_are_over(spark):
    rows = [(i, "x " * (5 + i % 40), s) for i, s in enumerate(["a", "b", "c"] * 80)]
    made = mixing.copies(table(spark, rows), weights=(1, 1, 20), share=0.8).collect()
    rates = {r["size"]: r["rate"] for r in made if r["source"] == "a"}
    ordered = [rates[s] for s in sorted(rates)]
    assert all(x >= y for x, y in zip(ordered, ordered[1:])) and ordered[0] > ordered[-1]


def test_rates_do_not_depend_on_how_the_rows_are_dealt(spark):
    rng = random.Random(21)
    rows = [(i, words(rng, rng.randrange(1, 400)), rng.choice("abcde")) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    made = []
    try:
        for parts, shuffled, order in ((1, "2", rows), (7, "5", rows[::-1])):
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
            made.append(sorted(tuple(r) for r in mixing.copies(table(spark, order).repartition(parts)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1]


def test_mix_of_nothing(spark):
    assert mixing.copies(table(spark, [])).count() == 0 and mixing.mix(table(spark, [])).count() == 0
    assert mixing.mix(table(spark, [(1, None, None), (2, "", "a")])).count() == 2


# --------------------------------------------------------------------------- nearest vectors

VEC = "vec_id long, embedding array<float>, label int"


def test_nearest_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "QUERY_ROWS", 8)
    monkeypatch.setattr(nearest, "CANDIDATE_ROWS", 64)
    rng = np.random.default_rng(2)
    data = np.float32(rng.normal(size=(700, 16)) * rng.lognormal(size=(700, 1)))
    data[100:400] = data[100]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    odd = [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] + [1.0] * 15, 0), (1060, [None] + [1.0] * 15, 0), (1080, [float("inf")] * 16, 0), (1100, [], 0), (1120, [1.0] * 5, 0), (1121, [2.0] * 5, 0), (None, [1.0] * 16, 0), (5, rows[5][1], 0)]
    got = nearest.nearest_vectors(spark.createDataFrame(rows + odd, VEC), F.col("vec_id") % 20 == 0, k=20).collect()
    exact = data.astype(np.float64)
    want = {(1120, 1, 1121, 10.0)}
    for q in range(0, 700, 20):
        scores = np.add.accumulate(exact * exact[q], axis=1)[:, -1]
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:20]
        want |= {(q, rank, int(i), float(scores[i])) for rank, i in enumerate(order, 1)}
    assert {tuple(r) for r in got} == want
    assert nearest.nearest_vectors(spark.createDataFrame([], VEC), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = nearest.Quantised(rng.normal(size=(50, 32))), nearest.Quantised(rng.normal(size=(60, 32)) * 100)
    low, high = nearest.tile_bounds(a, b)
    exact = a.exact @ b.exact.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low < 1e4).all()


@pytest.mark.parametrize("scale", [1e-170, 1e-320, 1e150, None])
def test_very_small_and_large_vectors_keep_their_place(spark, scale):
    """Squares and codes of such vectors vanish in double precision; only scores as they are count."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(200, 8))
    data = data * scale if scale else data * 10.0 ** rng.integers(-300, 150, size=(200, 1))
    data[7] = 0
    data[7, 0] = 5e-324
    data = data[(data != 0).any(1)]
    n = len(data)
    made = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(data)], "vec_id long, embedding array<double>, label int")
    got = nearest.nearest_vectors(made, F.col("vec_id") % 20 == 0, k=20).collect()
    want = set()
    for q in range(0, n, 20):
        scores = np.add.accumulate(data * data[q], axis=1)[:, -1]
        order = [i for i in np.lexsort((np.arange(n), -scores)) if i != q][:20]
        want |= {(q, rank, int(i), float(scores[i])) for rank, i in enumerate(order, 1)}
    assert {tuple(r) for r in got} == want


# --------------------------------------------------------------------------- quality

def quality_rows(n, rng):
    rows, labels = [], []
    for i in range(n):
        text = words(rng, 80)
        bad, toxic = rng.random() < 0.25, rng.random() < 0.15
        if bad:
            text = " ".join(w + "###" for w in text.split())
        if toxic:
            parts = text.split()
            for _ in range(3):
                parts.insert(rng.randrange(len(parts)), rng.choice(["vile1", "vile2", "vile3"]))
            text = " ".join(parts)
        rows.append((i, text, "s1" if bad else "s2"))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = quality_rows(900, random.Random(6))
    known = spark.createDataFrame(labels[:500] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_documents(table(spark, rows), known).collect()}
    right = sum(got[i]["keep"] == bool(q and not t) for i, q, t in labels[500:])
    assert right >= 0.97 * 400
    lost = sum(not got[i]["keep"] for i, q, t in labels[500:] if q and not t)
    assert lost <= 4


def test_classifier_on_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, ODD).withColumn("keep", F.lit("x"))
    got = quality.score_documents(docs, labels)
    assert got.count() == len(ODD) and got.where("keep").count() == len(ODD)
    assert quality.score_documents(table(spark, []), labels).count() == 0
    rows, known = quality_rows(200, random.Random(8))
    some = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    mixed = table(spark, [*rows, *[((i or 0) + 5000, t, s) for i, t, s in ODD]]).drop("lang", "source").withColumn("Score", F.lit(1))
    assert quality.score_documents(mixed, some).count() == len(rows) + len(ODD)


# --------------------------------------------------------------------------- fingerprints

def winnowed_by_hand(text, k, window):
    points = np.array([ord(c) for c in text], np.uint32)
    if not len(points):
        return []
    # Either half holds a whole window.
    k = max(1, min(k, len(points) // 2))
    window = max(1, min(window, len(points) // 2 - k + 1))
    hashes = (winnowing.kgram_hashes(points, k) >> np.uint64(24)).tolist()
    width = min(window, len(hashes))
    picked = []
    for i in range(len(hashes) - width + 1):
        least = min(hashes[i : i + width])
        at = max(j for j in range(i, i + width) if hashes[j] == least)
        if at not in picked:
            picked.append(at)
    return [(hashes[i], i) for i in picked]


def test_winnowing_equals_brute_force():
    rng = random.Random(9)
    for _ in range(150):
        text = "".join(rng.choice("abé中") for _ in range(rng.randrange(120)))
        got = winnowing.winnow(winnowing._code_points(text), 5, rng.choice((1, 4, 7, 8)) if len(text) % 2 else 6)
        if len(text) % 2 == 0:
            assert list(zip(got[0].tolist(), got[1].tolist())) == winnowed_by_hand(text, 5, 6)
    base = "".join(rng.choice("abcdefgh") for _ in range(400))
    shared = base[100:200]
    one, two = (set(winnowing.winnow(winnowing._code_points(t), 24, 72)[0].tolist()) for t in (base, "zz" * 70 + shared + "yy" * 50))
    assert one & two


def test_a_kept_half_is_always_seen():
    rng = random.Random(12)
    for n in [2, 3, 7, 15, 30, 31, 32, 33, 60, 95, 120, 174, 175, 300, 1000]:
        for _ in range(20):
            text = "".join(rng.choice("abcdefghij") for _ in range(n))
            edited = text[: n - n // 2] + "".join(rng.choice("klmnop") for _ in range(n // 2))
            one, two = (np.unique(winnowing.winnow(winnowing._code_points(t), 16, 72)[0]) for t in (text, edited))
            assert winnowing.likeness(one, two) > 0


def test_near_next_by_brute_force(spark):
    rng = random.Random(13)
    rows = [(i, words(rng, rng.randrange(80), 30), "s") for i in range(40)]
    got = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in winnowing.edited_fingerprints(table(spark, rows), ranges=3).collect()}
    for i, text, _ in rows:
        after = rows[i - 1][1]
        half = len(text) // 2
        sets = [{h for h, _ in winnowed_by_hand(t, 16, 72)} for t in (text, text[: len(text) - half] + after[:half], after)]
        want = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        assert got[i] == pytest.approx(want)


def test_edited_fingerprints(spark):
    rng = random.Random(10)
    rows = [(i * 3 % 101, words(rng, rng.randrange(60)) + "é中", "s") for i in range(101)] + [(200, None, "s"), (201, "", "s"), (3, "tie", "s"), (3, "tie", "s"), (None, "last", "s")]
    got = winnowing.edited_fingerprints(table(spark, rows), ranges=7).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for (i, t, _), (_, after, _) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 3 and r["n_chars"] == 3}) == 1
    one = winnowing.edited_fingerprints(table(spark, [(1, "abcd", "s")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    assert winnowing.edited_fingerprints(table(spark, [])).count() == 0


# --------------------------------------------------------------------------- pipeline

@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = quality_rows(240, rng)
    passage = "\n".join(words(rng, 20, 9000) for _ in range(5))
    near = words(rng, 200, 9000).split()
    rows += [(1000 + i, f"{words(rng, 30, 9000)}\n{passage}\n{words(rng, 30, 9000)}", "s2") for i in range(3)]
    rows += [(1100 + i, " ".join(near[:150] + [f"e{i}"] + near[151:]), "s2") for i in range(3)]
    rows += [((i or 0) + 5000, t, s) for i, t, s in ODD]
    table(spark, rows).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), passage


def test_stages_take_effect(spark, sf_dir):
    folder, passage = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        seen[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {n: [r["text"] or "" for r in rows] for n, rows in seen.items() if n != "tokens"}
    assert not any("vile" in t for t in texts["quality"])
    assert sum(passage in t for t in texts["quality"]) == 3 and sum(passage in t for t in texts["line_dedup"]) == 1
    assert {r["doc_id"] for r in seen["near_dedup"]} & {1100, 1101, 1102} == {1100}
    assert len({(r["doc_id"], r["text"]) for r in seen["near_dedup"]}) == len(seen["near_dedup"])
    assert all(r["n_chars"] == len(r["text"] or "") for r in seen["line_dedup"])
    assert len(seen["tokens"]) == len(seen["mixing"])
    again = corpus_pipeline.run(spark, folder)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in again.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in seen["tokens"])


# --------------------------------------------------------------------------- language model: pairs of words

def test_model_learns_pairs_of_ordinary_words(spark):
    """Every second word follows from the one before: half of the tokens carry log2(400) bits, the others none."""
    rng = random.Random(31)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(800)]
    after = dict(zip(names[:400], rng.sample(names[400:], 400)))
    rows = []
    for i in range(1500):
        first = [names[rng.randrange(400)] for _ in range(100)]
        rows.append((i, " ".join(f"{w} {after[w]}" for w in first), "s"))
    made = max_entropy.score_texts(table(spark, rows)).where("held_out").agg(
        F.sum("score"), F.sum("base_score"), F.sum("n_tokens")
    ).first()
    bits, base = (-x / made[2] * np.log2(10) for x in made[:2])
    assert base > 9 and bits < np.log2(400) / 2 + 1, (bits, base)


def test_pair_weights_meet_the_counts():
    """Within a group the shares of the heavy words come near their counts, and all shares sum to one."""
    rng = np.random.default_rng(5)
    group = np.repeat(np.arange(50), rng.integers(1, 9, 50))
    place = np.concatenate([np.arange(k) for k in np.bincount(group)])
    share = rng.dirichlet(np.ones(12), 50)[group, place] * 0.9 + 1e-4
    n = rng.integers(2, 400, len(group)).astype(float)
    total = np.bincount(group, n)[group] * 1.5
    weight, log_sum = max_entropy.pair_weights(group, n, total, share)
    p = share * np.exp(weight - log_sum)
    assert np.abs(p * total - n).max() < 12
    held = np.bincount(group, share)
    left = (1 - held) * np.exp(-log_sum[np.unique(group, return_index=True)[1]])
    assert np.allclose(np.bincount(group, p) + left, 1)


def test_score_by_brute_force(spark):
    """The score of each text from the model's parts, looked up word by word."""
    rng = random.Random(33)
    rows = [(i, " ".join(rng.choice(["a b", "c d e", f"w{rng.randrange(40)}x"]) for _ in range(rng.randrange(30))), "s") for i in range(200)]
    caught = {}
    plain = max_entropy._score
    try:
        max_entropy._score = lambda *parts: caught.setdefault("parts", parts) and plain(*parts)
        got = {r["doc_id"]: r["score"] for r in max_entropy.score_texts(table(spark, rows), rounds=10).collect()}
    finally:
        max_entropy._score = plain
    held, weights, spread, pairs = caught["parts"]
    lexicon, logs = held.value, max_entropy.class_table(weights)
    counts = collections.Counter(w for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split())
    tilts = dict(zip(pairs.pair.tolist(), pairs.weight.tolist()))
    sums = dict(zip(pairs.group.tolist(), pairs.log_sum.tolist()))
    assert tilts
    for i, text, _ in rows[:60]:
        data = np.frombuffer(text.encode(), np.uint8)
        word, ending, doc = max_entropy.tokens(data, np.array([0, len(data)]))
        cls, context = max_entropy.classes_and_contexts(word, ending, doc, lexicon.look_up(word)[1])
        want, spoken = 0.0, [*text.split(), None]
        for j, said in enumerate(spoken):
            want += logs[context[j], cls[j]]
            if cls[j] > max_entropy.OWN_CLASS:
                before = word[j - 1 : j] if j else np.array([max_entropy.END])
                want += np.log10(counts[said] + 0.1) - spread[cls[j]]
                want += (tilts.get(int(max_entropy.pair_hashes(before, word[j : j + 1])[0]), 0.0)
                         - sums.get(int(max_entropy.pair_hashes(before, cls[j : j + 1])[0]), 0.0)) / np.log(10)
        assert got[i] == pytest.approx(want, abs=1e-4)  # class probabilities are 4-byte floats


def test_pairs_that_are_not_held_count_alike(spark, monkeypatch):
    """every pair of the training texts has a weight, single ones too, whether tasks hold it or tokens meet it in the join."""
    rng = random.Random(41)
    rows = [(i, " ".join(rng.choice(["a b", "c d e", f"w{rng.randrange(90)}x v{rng.randrange(9)}"]) for _ in range(rng.randrange(40))), "s") for i in range(300)]
    scores, held, made = [], [], max_entropy._score
    monkeypatch.setattr(max_entropy, "_score", lambda *parts: held.append(len(parts[3].pair)) or made(*parts))
    for most in (200_000, 20):
        monkeypatch.setattr(max_entropy, "PAIRS", most)
        scores.append({r["doc_id"]: r["score"] for r in max_entropy.score_texts(table(spark, rows), rounds=5).collect()})
    assert scores[0] == pytest.approx(scores[1], abs=1e-3)
    counts = collections.Counter(w for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split())
    pairs = {p for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10 for p in zip([None, *t.split()], t.split())}
    # The 31 most frequent words are classes of their own; of words that come once the pair does, too.
    least = sorted(counts.values())[-31]
    assert held[0] >= sum(counts[w] < least for _, w in pairs) > 10 * held[1]
