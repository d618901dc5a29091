"""Repeated units, line windows, repeated strings, near duplicates: against brute force and on odd tables."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import near_duplicates as nd, run_index, text_units
from auditloom.llm import token_blocks as tb
from auditloom.llm.line_windows import drop_repeated_windows
from auditloom.llm.text_units import drop_repeated_units

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def edge_rows(rng):
    """Nulls, empty and blank texts, repeats, ties, a very long text."""
    text = "\n".join(words(rng, 12) for _ in range(6))
    return [
        (None, None), (None, text), (1, ""), (1, text), (1, text), (2, None), (3, " \n\t\n "), (4, "one"), (5, "é" * 300),
        (6, words(rng, 30_000)), (7, "the same line of words\n" * 50), (8, text.upper()), (-3, "x" * 99),
    ]


# --------------------------------------------------------------------------- three-line windows

def windows_by_hand(rows):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, row_digest(r)))
    for doc in order:
        lines = (doc[1] or "").split("\n") if doc[1] is not None else []
        full = [(i, " ".join(x.split(" "))) for i, x in enumerate(lines)]
        full = [(i, " ".join(part for part in x.replace("\t", " ").split(" ") if part)) for i, x in full]
        full = [(i, x) for i, x in full if x]
        gone = set()
        for (a, x), (b, y), (c, z) in zip(full, full[1:], full[2:]):
            place = (row_digest(doc), a)
            if seen.setdefault((x, y, z), place) != place:
                gone |= {a, b, c}
        out[row_digest(doc)] = sorted(gone)
    return out


def row_digest(row):
    name = "null" if row[0] is None else str(row[0])
    return hashlib.md5(f"{len(name)}:{name}{row[1] or ''}".encode()).digest()


def test_line_windows_equal_brute_force(spark):
    rng = random.Random(5)
    lines = [words(rng, 3) for _ in range(8)] + ["", "  "]
    rows = [(i // 2, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(60)] + edge_rows(rng)
    got = drop_repeated_windows(table(spark, rows)).collect()
    want = windows_by_hand(rows)
    assert len(got) == len(rows)
    originals = {}
    for r in rows:
        originals.setdefault(r[0], []).append(r)
    for r in got:
        assert any(
            want[row_digest(o)] == r["removed"]
            and (o[1] is None) == (r["text"] is None)
            and (o[1] is None or r["text"] == "\n".join(x for i, x in enumerate(o[1].split("\n")) if i not in set(r["removed"])))
            for o in originals[r["doc_id"]]
        ), r


def test_line_windows_keep_clean_text_and_columns(spark):
    docs = table(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb")]).withColumn("row_key", F.lit("own")).withColumn("Removed", F.lit(1))
    got = {r["doc_id"]: r for r in drop_repeated_windows(docs).collect()}
    assert got[1]["text"] == "a\nb\nc\nd" and got[2]["text"] == "x\ny" and got[3]["text"] == "a\nb"
    assert got[2]["row_key"] == "own" and got[2]["removed"] == [1, 2, 3, 4]
    assert drop_repeated_windows(table(spark, [])).count() == 0


# --------------------------------------------------------------------------- lines and paragraphs

@pytest.mark.parametrize("kind", ["line", "paragraph"])
def test_units_equal_brute_force(spark, kind):
    rng = random.Random(7)
    lines = [words(rng, n) for n in (1, 2, 3, 5, 9)] + ["", "Same, words here!", "same words HERE"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 10)))) for i in range(40)] + [(99, None), (98, ""), (0, rng.choice(lines))]
    got = drop_repeated_units(table(spark, rows), kind=kind).collect()
    seen, want = set(), {}
    for r in sorted(rows, key=lambda r: (r[0], row_digest(r))):
        spans = []
        for a, b in text_units.units_of(r[1] or "", kind):
            form = text_units.normalised((r[1] or "")[a:b])
            if form:
                if form in seen:
                    spans.append((a, b))
                seen.add(form)
        want.setdefault(r[0], []).append(spans)
    for r in got:
        assert [tuple(s) for s in r["removed"]] in want[r["doc_id"]]
    assert drop_repeated_units(table(spark, [])).count() == 0


def test_units_on_odd_rows(spark):
    rows = edge_rows(random.Random(3))
    got = drop_repeated_units(table(spark, rows).withColumn("kept", F.lit("x"))).collect()
    assert len(got) == len(rows) and sum(r["text"] is None for r in got) == 2
    short = {r["doc_id"]: r["text"] for r in drop_repeated_units(table(spark, [(1, "Ja!\n你好世界\n--"), (2, "ja\n你好世界\n--\nnein")])).collect()}
    assert short == {1: "Ja!\n你好世界\n--", 2: "--\nnein"}


# --------------------------------------------------------------------------- repeated strings

def strings_by_hand(rows, length):
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, row_digest(r))):
        if row_digest(r) in out:
            continue
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        out[row_digest(r)] = hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("length", [24, 100])
def test_strings_equal_brute_force(spark, length):
    rng = random.Random(length)
    pool = [words(rng, 60) for _ in range(6)]
    rows = []
    for i in range(50):
        text = rng.choice(pool)
        at = rng.randrange(len(text))
        rows.append((i, text[at:] + words(rng, rng.randrange(20)) + text[: rng.randrange(len(text))] + ("ab" * rng.randrange(80))))
    rows += [(50 + i, "z" * 400) for i in range(4)] + [r for r in edge_rows(rng) if r[0] != 6]
    got = run_index.remove_repeated_strings(table(spark, rows), length=length).collect()
    want = strings_by_hand(rows, length)
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(want[row_digest(r)])
    assert len(got) == len(rows)
    for r in got:
        assert r["kept_sha256"] in by_id[r["doc_id"]]
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and r["n_removed"] == sum(s["stop"] - s["start"] for s in r["spans"])
    assert run_index.remove_repeated_strings(table(spark, [])).count() == 0


def test_run_index_statistics():
    rng = random.Random(11)
    for _ in range(400):
        contexts = list(dict.fromkeys(bytes(rng.choice(b"abc") for _ in range(rng.randrange(4, 30))) for _ in range(rng.randrange(2, 9))))
        seen, want = set(), []
        for c in contexts:
            flags = []
            for s in range(len(c) - 3):
                flags.append(c[s : s + 4] in seen)
                seen.add(c[s : s + 4])
            want.append(flags)
        if len(contexts) > 1:
            assert [f.tolist() for f in run_index.repeated_starts(contexts, 4)] == want


# --------------------------------------------------------------------------- near duplicates

def test_prob_min_hash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(1, 1 << 62, 300, dtype=np.uint64))
    left, right = np.arange(0, 220), np.arange(80, 300)
    weights = 1 + np.log(rng.integers(1, 9, 300))
    doc = np.repeat([0, 1], [220, 220])
    sketch = nd.prob_min_hash(np.concatenate((hashes[left], hashes[right])), doc, np.concatenate((weights[left], weights[right])), 2, 4096)
    exact = nd.similarity((hashes[left], weights[left]), (hashes[right], weights[right]))
    x, y = np.zeros(300), np.zeros(300)
    x[left], y[right] = weights[left], weights[right]
    slow = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(300) if x[i] and y[i])
    assert abs(nd.probability_jaccard(x, y) - slow) < 1e-9 and exact >= slow - 1e-9
    assert abs((sketch[0] == sketch[1]).mean() - slow) < 0.04


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_classes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for base in range(25):
        text = words(rng, 120, 5000).split()
        for _ in range(rng.randrange(1, 9)):
            edited = list(text)
            for _ in range(rng.randrange(0, 5)):
                edited[rng.randrange(len(edited))] = f"e{rng.randrange(999)}"
            rows.append((len(rows), " ".join(edited)))
    cloud = words(rng, 150, 5000).split()
    for _ in range(80):
        edited = list(cloud)
        for _ in range(rng.randrange(1, 5)):
            edited[rng.randrange(len(edited))] = f"c{rng.randrange(9999)}"
        rows.append((len(rows), " ".join(edited)))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "one two", "one two", "One TWO", rows[0][1]])]
    monkeypatch.setattr(nd, "GROUP_ROWS", 16)  # so the cloud goes through hub and blocks
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(table(spark, rows)).collect()}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: shingle_set(t or "") for i, t in rows}
    for (a, x), (b, y) in itertools.combinations(rows, 2):
        union = len(sets[a] | sets[b])
        if (x or "") == (y or "") or (union and len(sets[a] & sets[b]) / union >= 0.8):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {i: find(i) for i in got}


def test_copies_that_repeat_a_block_are_found(spark):
    """Plain Jaccard is above 0.8, probability Jaccard far below: one text says a block a hundred times."""
    rng, rows = random.Random(8), []
    for _ in range(10):
        text = [f"w{rng.randrange(10**9)}" for _ in range(500)]
        edited = text[:200] * 100 + text[200:]
        for place in range(20_010, 20_300, 32):
            edited[place] = "edited"
        assert len(shingle_set(" ".join(text)) & shingle_set(" ".join(edited))) >= 0.8 * len(shingle_set(" ".join(text)) | shingle_set(" ".join(edited)))
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(edited))]
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_hubs_of_other_groups_do_not_hide_pairs(spark, monkeypatch):
    """x is near hub h1, y near hub h2, and x and y are alike: they share both large groups, and each hub misses one."""
    monkeypatch.setattr(nd, "GROUP_ROWS", 4)
    near = {frozenset(p) for p in ("px", "qy", "xy")}  # p: hub of group 1, q: hub of group 2

    def find(left, right):
        rows = left + (right or [])
        pairs = itertools.combinations(range(len(rows)), 2) if right is None else itertools.product(range(len(left)), range(len(left), len(rows)))
        return [(i, j) for i, j in pairs if frozenset((rows[i]["id"] + rows[j]["id"]).decode()) in near]

    rows = [(g, 6, i.encode(), 9 if i == hub else 1, b"") for g, hub, ids in (("1", "p", "pxyabc"), ("2", "q", "qxydef")) for i in ids]
    table = spark.createDataFrame(rows, "grp string, n long, id binary, popular long, payload binary")
    got = {frozenset((r["a"] + r["b"]).decode()) for r in nd.links_within(table, find, ["payload"], "popular").collect()}
    assert got == near


def test_near_duplicates_on_odd_rows(spark):
    rows = edge_rows(random.Random(4))
    docs = table(spark, rows).withColumn("row_key", F.lit(1)).withColumn("digest", F.lit(2))
    assert nd.near_duplicates(docs).count() == len(rows)
    kept = nd.keep_first_of_class(docs)
    assert kept.columns == docs.columns
    assert kept.count() == nd.near_duplicates(docs).select("class_id").where("class_id IS NOT NULL").distinct().count() + 2
    assert nd.near_duplicates(table(spark, [])).count() == 0 and nd.keep_first_of_class(table(spark, [])).count() == 0


def test_words_and_shingles():
    texts = ["", "  a b\tc ", "one", "x y z u v w", "É ß"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    starts, stops, doc = tb.words(data, offsets)
    assert [(d, bytes(data[a:b]).decode()) for a, b, d in zip(starts, stops, doc)] == [(i, w) for i, t in enumerate(texts) for w in t.split()]
    _, owner = tb.shingles(tb.span_hashes(data, starts, stops), doc, 5, 5)
    assert owner.tolist() == [1, 2, 3, 3, 4]
