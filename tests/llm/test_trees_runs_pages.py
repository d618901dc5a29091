"""Merkle manifest, periodic runs and main texts: against brute force and on odd tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from auditloom.llm import html_text, merkle, queries
from auditloom.llm import periodic_runs as pr

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --------------------------------------------------------------------------- Merkle manifest

def leaf_by_hand(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_by_hand(leaves):
    """Root and, per leaf, its siblings (None: none), level by level, with the side they stand on."""
    proofs, layer, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(layer) > 1:
        above, below = [], []
        for i in range(0, len(layer), 2):
            pair = layer[i : i + 2]
            for side, members in enumerate(under[i : i + 2]):
                for m in members:
                    proofs[m].append((side, pair[1 - side] if len(pair) == 2 else None))
            above.append(sha("".join(pair)))
            below.append(sum(under[i : i + 2], []))
        layer, under = above, below
    return layer[0], proofs


def manifest_by_hand(rows):
    """(id, leaf, subroot, root, siblings joined) per row, as a sorted list."""
    groups = {}
    for i, text, lang, source, n in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf_by_hand(i, source, lang, n, text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort()
        trees[g] = tree_by_hand([leaf for *_, leaf in groups[g]])
    root, top = tree_by_hand([trees[g][0] for g in names])
    out = []
    for no, g in enumerate(names):
        for (known, i, leaf), proof in zip(groups[g], trees[g][1]):
            out.append((i if known else None, leaf, trees[g][0], root, "".join(s for _, s in proof + top[no] if s)))
    return sorted(out, key=str)


def made_by_spark(spark, rows):
    docs = spark.createDataFrame(rows, DOC)
    leaf = merkle.record_digest(["doc_id", "source", "lang", "n_chars", "text"])
    made = merkle.manifest(docs.withColumn("leaf", leaf)).withColumn(
        "folded", merkle.folded(F.col("leaf"), F.col("path"), F.col("index"), F.col("height"), F.col("tree"))
    ).collect()
    assert all(r["folded"] == r["root"] for r in made)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], "".join(x.hex() for x in r["path"] if x is not None)) for r in made), key=str)


def test_manifest_equals_a_plain_tree(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"text {i}", rng.choice(["en", "en", "en", "de", "ñ", None]), rng.choice(["a", None]), rng.choice([i, None])) for i in range(700)]
    rows += [(5000, "alone", "zz", "s", 1), (None, None, "en", None, None), (7, "", "en", "", 0)] + [(9, "same", "de", "s", 4)] * 5
    by_hand = manifest_by_hand(rows)
    assert made_by_spark(spark, rows) == by_hand
    # Without broadcasts, and with blocks of four leaves: many rounds, every jump a shuffle.
    monkeypatch.setattr(merkle, "FEW_BYTES", -1)
    monkeypatch.setattr(merkle, "LEVELS", 2)
    assert made_by_spark(spark, rows) == by_hand


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_manifest_of_few_rows(spark, n):
    rows = [(i, "t", f"g{i % 2}" if n > 2 else "g", None, 0) for i in range(n)]
    assert made_by_spark(spark, rows) == manifest_by_hand(rows)
    alone = [(i, "t", f"g{i}", None, 0) for i in range(n)]
    assert made_by_spark(spark, alone) == manifest_by_hand(alone)


def test_manifest_odd_tables(spark):
    assert made_by_spark(spark, []) == []
    docs = spark.createDataFrame([(1, "x" * 300_000, "en", "s", 2), (2, None, None, None, None)], DOC)
    docs = docs.withColumns({"leaf": merkle.record_digest(["doc_id", "text"]), "ROW": F.lit(1), "index": F.lit("mine"), "grp": F.lit(2), "node": F.lit(3)})
    made = merkle.manifest(docs)
    assert sorted(r["index"] for r in made.collect()) == [0, 0]
    assert {"ROW", "grp", "node", "text"} <= set(made.columns)
    assert {(r["ROW"], r["grp"], r["node"]) for r in made.collect()} == {(1, 2, 3)}


def test_manifest_query_finds_what_was_changed(spark, tmp_path):
    rows = [(i, f"t{i}", "en" if i % 3 else None, "s", i if i % 5 else None) for i in range(60)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    made = {r["doc_id"]: r for r in queries.op11_merkle_manifest(spark, str(tmp_path)).collect()}
    changed = {i for i, *_, n in rows if zlib.crc32(str(i).encode()) % 7 == 0 and n is not None}
    assert changed and {i for i, r in made.items() if not r["verified"]} == changed
    by_hand = {i: (leaf, sub, root, sha(s)) for i, leaf, sub, root, s in manifest_by_hand(rows)}
    assert {i: (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for i, r in made.items()} == by_hand


# --------------------------------------------------------------------------- periodic runs

def runs_by_hand(words, least):
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                best.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def odd_words(rng):
    kinds = rng.choice([1, 2, 3, 5, 30])
    words = [b"w%d" % rng.randrange(kinds) for _ in range(rng.randrange(60))]
    if words and rng.random() < 0.5:
        at, p = rng.randrange(len(words)), rng.randrange(1, 12)
        words = words[:at] + [words[at + (i % p) % (len(words) - at)] for i in range(rng.randrange(60))] + words[: rng.randrange(len(words))]
    return words


@pytest.mark.parametrize("least", [2, 3, 7, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(400):
        texts = [odd_words(rng) for _ in range(rng.randrange(1, 6))]
        assert pr.runs_of_texts(texts, least) == [runs_by_hand(w, least) for w in texts]


def test_runs_of_long_texts_take_no_square_of_time():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 60_000:
        a, b = b, b + a
    runs = pr.runs_of_texts([[b"x"] * 200_000, b, [b"%d" % (i % 7) for i in range(200_000)]], 12)
    assert runs[0] == [(0, 200_000, 1)] and runs[2] == [(0, 200_000, 7)]
    assert all(b[s : s + n - q] == b[s + q : s + n] and n >= max(12, 2 * q) for s, n, q in runs[1]) and len(runs[1]) > 1000


def test_runs_operator_on_odd_rows(spark):
    run = " ".join(["la", "li"] * 7)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, run), (4, run), (None, f"a {run}\nb"), (5, "é " * 30), (6, "x " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"RUNS": F.lit("old"), "n": F.lit(1), "h": F.lit(2)})
    made = pr.periodic_runs(docs)
    found = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in made.collect()))
    assert found[0] == (0, 16, [(1, 14, 2)], "a la li b")
    assert found[1:4] == [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], "")]
    assert found[4] == found[5] == (4, 14, [(0, 14, 2)], "la li")
    assert found[6] == (5, 30, [(0, 30, 1)], "é") and found[7] == (6, 100_000, [(0, 100_000, 1)], "x")
    assert set(made.columns) == {"doc_id", "text", "n", "h", "n_words", "runs", "collapsed"}
    assert pr.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(docs, min_length=1)


def test_runs_query_equals_its_contract(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    rows += [(None, "x " * 20), (1000, None), (1001, "\x0b a\fb  "), (1002, "q r s " * 10)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, text in rows:
        words = [w for w in re.split("[\x20\x09-\x0D]+", text or "") if w]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            planted += 1
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        runs = runs_by_hand(words, 12)
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        known = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        assert made[i] == (i, len(runs), *known, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for j, w in enumerate(words) if j not in gone)))
    assert planted > 20


# --------------------------------------------------------------------------- main text of pages

SENTENCE = "The quick brown fox is in the garden and it was over the lazy dog of our house."
P = f"<p>{SENTENCE}</p>"

PAGES = {
    "plain": (f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1>{P}<p>Ok.</p></article>"
              "<footer>&copy; us</footer></body></html>", f"Head\n{SENTENCE}\nOk."),
    "unclosed inline": (f"<article><p><b>One.<br><p>Two&nbsp;\n three.<p>{SENTENCE}</article>", f"One.\nTwo three.\n{SENTENCE}"),
    "no article": (f"<div id=header><h1>Site</h1></div><div class=menu><a href=a>Home</a> | <a href=b>About</a></div><div id=content><h2>Head</h2>{P}"
                   f"<p>Short.</p>{P}<ul><li>one<li>two</ul></div><div class=sidebar-left>{P}</div><div id=comments><article>{P}</article></div>"
                   "<p>&copy; 2020 us", f"Head\n{SENTENCE}\nShort.\n{SENTENCE}\none\ntwo"),
    "markup that speaks against": (f"<article>{P}<div class='cookie-notice'>{P}</div><aside>{P}</aside><form>{P}</form><p hidden>{P}<div style='display: none'>x</div>"
                                   f"<script>var a='<p>no</p>';</script><style>p{{}}</style><noscript>no</noscript><textarea>no</textarea><p>Yes<span hidden>no</span>.</article>",
                                   f"{SENTENCE}\n{SENTENCE}\nYes."),
    "readers' articles": (f"<article>{P}</article><section class=comments><article>{P}</article><article>{P}</article></section>", SENTENCE),
    "teasers beside": (f"<aside><article><h2>Other</h2>{P}</article></aside><article><p>Main.</p></article>", "Main."),
    "advert never closed": (f"<div class=ad>Buy<article><h1>Head</h1>{P}<button>Go</button></article>", f"Head\n{SENTENCE}"),
    "links": (f"<main>{P}<p><a href=x>A linked sentence.</a></p><ul><li><a href=x>Tag</a><li><a href=y>Tag</a></ul></main>", f"{SENTENCE}\nA linked sentence."),
    "main with article": (f"<main><div>Crumbs</div><article>{P}</article><div>{SENTENCE}</div></main>", SENTENCE),
    "attributes": ("<article><p data-class='ad' href='?id=ad' title='a>b'>Kept<!-- a > b --> it</p></article>", "Kept it"),
    "references": ("<p>&lt;a&gt; &amp;amp; &eacute;&#233;&#xE9; &copy;&unknown; &am", "<a> &amp; ééé ©&unknown; &am"),
    "stray signs": ("<p>1 < 2 and 3 > 2 <3</p>", "1 < 2 and 3 > 2 <3"),
    "only short": ("<p>Hello.</p><p>World.</p>", "Hello.\nWorld."),
    "foreign words": ("<article><p>" + "zxq wvu " * 40 + "</p></article>", ("zxq wvu " * 40).strip()),
    "nothing": ("<nav><a href=/>Home</a></nav>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, text = PAGES[name]
    assert html_text.main_text(page)[0] == text


def test_main_text_of_hostile_pages_takes_linear_time():
    for part in ("<", "<a \"", "<a x=\"", "<div>", "<!--", "<p><b>", "<li>", "</p>", "<b>", "<a>", "&", "<p>x<b>", "<b></i>"):
        html_text.main_text(part * 20_000)


def test_main_text_of_given_pages(spark):
    """The pages of the smallest data set have one article, with a heading and paragraphs, and nothing else of value."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    made = {r["page_id"]: r["text"] for r in queries.op13_html_text(spark, "/root/testdata/sf0.001").collect()}
    assert len(made) == len(pages)
    import html

    for row in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", row["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert made[row["page_id"]] == "\n".join(x for x in parts if x)


def test_extract_text_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, P), (3, P), (None, "<p>" + "long text " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumns({"TEXT": F.lit("old"), "blocks": F.lit(1), "label": F.lit("l")})
    made = html_text.extract_text(pages)
    assert set(made.columns) == {"page_id", "blocks", "label", "text", "n_chars"}
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in made.collect()) == [(0, 999_999), (1, 0), (2, 0), (3, len(SENTENCE)), (3, len(SENTENCE))]
    labelled = html_text.extract_text(pages.where("page_id = 3"), keep_blocks=True).first()
    assert [tuple(b) for b in labelled["blocks"]] == [(SENTENCE, "p", "good")]
    assert html_text.extract_text(pages.limit(0)).count() == 0
