"""Quality and toxicity of documents by co-training a text classifier and a metadata classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_blocks as tb
from .scratch import unused

#: Hashed words, and words kept in a model.
SLOTS = 1 << 20
KEPT_WORDS = 512
#: A word must sit in so many sampled documents, and differ between the classes by so many standard errors.
LEAST_DOCS, LEAST_Z = 4, 4.0
#: Steps per rate, and the rates of a text: shares of its words or bytes, square roots taken.
STEPS = 24
RATES = ("symbol ends", "capitals", "lone symbols", "repeats of the word before", "distinct words", "digits", "other than ASCII")
META_STEPS = 64

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[ord(c) for c in ".,;:?'\")-]"]] = True
#: Punctuation counts for nothing, so "word" and "word," are one; capitals are small.
_WORD_VALUES = np.where(_PUNCTUATION, np.uint64(0), tb.LOWER_VALUES)
_COUNTED = {name: np.asarray(mask, np.int64) for name, mask in (
    ("upper", tb.IS_UPPER), ("lower", (tb.BYTES >= 97) & (tb.BYTES <= 122)), ("digit", (tb.BYTES >= 48) & (tb.BYTES <= 57)), ("high", tb.BYTES >= 128),
)}


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and document of each word, and the rate steps (documents x RATES) of a block of texts."""
    n = len(offsets) - 1
    starts, stops, doc = tb.words(data, offsets)
    hashes = tb.span_hashes(data, starts, stops, _WORD_VALUES)
    counts = {}
    for name, mask in _COUNTED.items():
        sums = np.concatenate(([0], np.cumsum(mask[data])))
        counts[name] = sums[stops] - sums[starts]
    inked = np.concatenate(([0], np.cumsum(_PUNCTUATION[data])))
    all_marks = inked[stops] - inked[starts] == stops - starts
    last = data[stops - 1] if len(stops) else np.zeros(0, np.uint8)
    flags = (
        _PUNCTUATION[last] & ~_PLAIN_END[last],
        (counts["upper"] >= 2) & (counts["lower"] == 0),
        all_marks,
        np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))) if len(hashes) else np.zeros(0, bool),
    )
    n_words = np.bincount(doc, minlength=n)
    n_bytes = np.diff(offsets)
    pairs = np.unique((hashes & tb.U64((1 << 44) - 1)) | (doc.astype(tb.U64) << tb.U64(44))) if len(hashes) else np.zeros(0, tb.U64)
    distinct = np.bincount((pairs >> tb.U64(44)).astype(np.int64), minlength=n)
    shares = [np.bincount(doc, f, n) / np.maximum(n_words, 1) for f in flags] + [distinct / np.maximum(n_words, 1)]
    shares += [np.bincount(doc, counts[c], n) / np.maximum(n_bytes, 1) for c in ("digit", "high")]
    steps = np.minimum((np.sqrt(np.stack(shares, 1)) * STEPS).astype(np.int64), STEPS - 1)
    return (hashes & tb.U64(SLOTS - 1)).astype(np.int64), doc, steps


def meta_features(batch: pa.RecordBatch, rows: slice, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Slots of what is known beside the words: language, source, length, lines and line length."""
    n = len(offsets) - 1
    out = []
    for field in ("lang", "source"):
        named = [f"{field}={v}".encode() for v in batch.column(field).slice(rows.start, n).to_pylist()]
        out.append([int.from_bytes(x[-8:].rjust(8, b"\0"), "little") % 61 % META_STEPS for x in named])
    at = np.concatenate(([0], np.cumsum(data == 10)))
    lines = at[offsets[1:]] - at[offsets[:-1]] + 1
    size = np.diff(offsets)
    for amount in (size, lines, size / lines):
        out.append(np.minimum(np.log2(amount + 1) * 3, META_STEPS - 1).astype(np.int64))
    return np.stack([np.asarray(o) for o in out], 1) + np.arange(len(out)) * META_STEPS


META_WIDTH = 5 * META_STEPS
FEATURES = "id long, words array<int>, rates array<int>, meta array<int>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of whole texts: distinct word slots, rate steps, metadata slots."""
    for batch in batches:
        for rows, data, offsets in tb.text_blocks(batch.column("text")):
            slots, doc, steps = text_features(data, offsets)
            n = len(offsets) - 1
            pairs = np.unique(doc * SLOTS + slots)
            cuts = np.searchsorted(pairs, np.arange(1, n) * SLOTS)
            meta = meta_features(batch, rows, data, offsets)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(rows.start, n),
                pa.array([p % SLOTS for p in np.split(pairs, cuts)], pa.list_(pa.int32())),
                pa.array(list(steps), pa.list_(pa.int32())), pa.array(list(meta), pa.list_(pa.int32())),
            ], names=["id", "words", "rates", "meta"])


#: Rows of a design worked on at once; designs are kept as bytes.
CHUNK = 1024


class Logistic:
    """Ridge logistic regression by Newton steps on a small design of zeros and ones (or a few real columns)."""

    def __init__(self, designs: list[np.ndarray], y: np.ndarray, ridge: float = 1.0) -> None:
        width = designs[0].shape[1] + 1
        self.w = np.zeros(width)
        penalty = np.full(width, ridge)
        penalty[0] = 1e-6
        for _ in range(12):
            slope, bend, at = penalty * self.w, np.diag(penalty), 0
            for design in designs:
                for lo in range(0, len(design), CHUNK):
                    x = design[lo : lo + CHUNK].astype(np.float64)
                    x = np.hstack([np.ones((len(x), 1)), x])
                    p = sigmoid(x @ self.w)
                    slope += x.T @ (p - y[at : at + len(x)])
                    bend += (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
                    at += len(x)
            step = np.linalg.solve(bend, slope)
            self.w -= np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-4:
                break

    def logit(self, design: np.ndarray) -> np.ndarray:
        parts = [design[lo : lo + CHUNK].astype(np.float64) @ self.w[1:] for lo in range(0, len(design), CHUNK)]
        return self.w[0] + np.concatenate(parts) if parts else np.zeros(0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Sample:
    """Features of sampled documents in the driver, in flat arrays."""

    def __init__(self, rows: pa.Table) -> None:
        self.n = rows.num_rows
        column = lambda name: rows[name].combine_chunks()
        flat = lambda name: column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.slots = column("words").flatten().to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(self.n), column("words").value_lengths().to_numpy(zero_copy_only=False))
        self.rates = flat("rates").reshape(self.n, len(RATES))
        self.meta = flat("meta").reshape(self.n, META_WIDTH // META_STEPS)

    def telling_words(self, y: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Slots whose documents' share differs most between the classes of the used rows, most telling first."""
        mine = used[self.owner]
        slots, at = np.unique(self.slots[mine], return_inverse=True)
        n, n1 = max(int(used.sum()), 1), max(y[used].sum(), 1)
        n0 = max(n - n1, 1)
        with1 = np.bincount(at, y[self.owner[mine]], len(slots))
        docs = np.bincount(at, minlength=len(slots))
        share = docs / n
        z = (with1 / n1 - (docs - with1) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
        good = (docs >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)
        order = np.argsort(-np.abs(z[good]), kind="stable")[:KEPT_WORDS]
        return slots[good][order].astype(np.int64)

    def text_design(self, kept: np.ndarray) -> np.ndarray:
        x = np.zeros((self.n, len(kept) + len(RATES) * STEPS), np.uint8)
        if len(kept):
            order = np.argsort(kept)
            at = np.minimum(np.searchsorted(kept[order], self.slots), len(kept) - 1)
            hit = kept[order][at] == self.slots
            x[self.owner[hit], order[at[hit]]] = 1
        # A rate counts as "at least so many steps", so neighbouring steps share what is learned.
        x[:, len(kept) :] = (self.rates[:, :, None] >= np.arange(STEPS)[None, None, :]).reshape(self.n, len(RATES) * STEPS)
        return x

    def meta_design(self) -> np.ndarray:
        x = np.zeros((self.n, META_WIDTH), np.uint8)
        for j in range(self.meta.shape[1]):
            x[np.arange(self.n), self.meta[:, j]] = 1
        return x


def co_train(labelled: Sample, y: np.ndarray, pool: Sample, rounds: int, sure: float) -> dict:
    """Both views for one 0/1 target: weights, and how their logits are combined.

    A fifth of the labelled rows is held back.  In each round either view labels those rows of the pool of which it is
    sure (``sure`` as precision on the held-back rows, both ways) for the other view.  In the end a small logistic
    regression on the held-back logits calibrates and combines the views.
    """
    held = np.arange(len(y)) % 5 == 4
    kept = labelled.telling_words(y, ~held)
    designs = {"text": (labelled.text_design(kept), pool.text_design(kept)), "meta": (labelled.meta_design(), pool.meta_design())}
    given: dict[str, tuple[np.ndarray, np.ndarray]] = {v: (np.zeros(0, np.int64), np.zeros(0)) for v in designs}
    models = {}
    for step in range(rounds + 1):
        for view, (own, more) in designs.items():
            rows, labels = given[view]
            models[view] = Logistic([own[~held], more[rows]], np.concatenate([y[~held], labels]))
        if step == rounds:
            break
        for view, other in (("text", "meta"), ("meta", "text")):
            p_held, p_pool = (sigmoid(models[view].logit(d)) for d in (designs[view][0][held], designs[view][1]))
            rows, labels = [], []
            for label in (0, 1):
                right = (y[held] == label)[order := np.argsort(-(p_held if label else 1 - p_held), kind="stable")]
                precise = np.flatnonzero(np.cumsum(right) >= sure * np.arange(1, len(right) + 1))
                if len(precise) and precise[-1] >= 9 and sure > np.mean(y[held] == label):
                    edge = (p_held if label else 1 - p_held)[order[precise[-1]]]
                    picked = np.flatnonzero((p_pool if label else 1 - p_pool) >= max(edge, 0.5))
                    rows.append(picked)
                    labels.append(np.full(len(picked), float(label)))
            if rows:
                given[other] = (np.concatenate(rows), np.concatenate(labels))
    logits = np.stack([models[v].logit(designs[v][0][held]) for v in ("text", "meta")], 1)
    joint = Logistic([logits], y[held], ridge=0.1)
    return {"kept": kept, "text": models["text"].w, "meta": models["meta"].w, "joint": joint.w, "given": {v: len(g[0]) for v, g in given.items()}}


def fit(docs: DataFrame, labels: DataFrame, target_columns: dict[str, int], id_col: str, text_col: str, n_labelled: int, n_pool: int, rounds: int, sure: float) -> dict[str, dict]:
    """A model per target from bounded samples: the documents with the least hash of the id, with and without label."""
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        *[(F.max if bad else F.min)(c).alias(c) for c, bad in target_columns.items()]
    ).dropna()
    rows = _features_input(docs, id_col, text_col)
    every = rows.select("id").dropna()
    order = F.xxhash64("id", F.lit(7))
    first = known.join(every.distinct(), "id", "left_semi").orderBy(order, "id").limit(n_labelled)
    rest = every.distinct().join(known, "id", "left_anti").orderBy(order, "id").limit(n_pool)
    marked = first.unionByName(rest, allowMissingColumns=True).collect()  # at most n_labelled + n_pool short rows
    truth = {r["id"]: [r[c] for c in target_columns] for r in marked if r[next(iter(target_columns))] is not None}
    wanted = docs.sparkSession.createDataFrame([(r["id"],) for r in marked], "id long")
    found = rows.join(F.broadcast(wanted), "id", "left_semi").mapInArrow(_extract, FEATURES).dropDuplicates(["id"]).toArrow().sort_by("id")
    known_ids = pa.array(list(truth), pa.int64())
    has_label = pc.is_in(found["id"], known_ids)
    labelled = found.filter(has_label)
    sample, pool = Sample(labelled), Sample(found.filter(pc.invert(has_label)))
    ids = labelled["id"].to_pylist()
    out = {}
    for i, name in enumerate(target_columns):
        y = np.array([truth[k][i] for k in ids], float)
        out[name] = co_train(sample, y, pool, rounds, sure) if 0 < y.sum() < len(y) and len(y) >= 50 else None
        if out[name] is None:
            out[name] = {"constant": float(y.mean()) if len(y) else float(not target_columns[name])}
    return out


def _features_input(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    field = lambda c: (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), field("lang"), field("source"))


def _scorer(models: dict[str, dict]):
    """Arrow function from (id, text, lang, source, ...) to the logits and probabilities of each target."""
    tables = {}
    for name, m in models.items():
        if "constant" in m:
            continue
        weights = np.zeros(SLOTS)
        weights[m["kept"]] = m["text"][1 : len(m["kept"]) + 1]
        steps = np.cumsum(m["text"][len(m["kept"]) + 1 :].reshape(len(RATES), STEPS), 1)
        tables[name] = (weights, steps, m)

    def scores(batch: pa.RecordBatch) -> Iterator[tuple[slice, dict[str, np.ndarray]]]:
        for rows, data, offsets in tb.text_blocks(batch.column("text")):
            slots, doc, steps = text_features(data, offsets)
            meta = meta_features(batch, rows, data, offsets)
            n, out = len(offsets) - 1, {}
            for name, m in models.items():
                if "constant" in m:
                    out |= {f"{name}_text": np.full(n, m["constant"]), f"{name}_meta": np.full(n, m["constant"]), name: np.full(n, m["constant"])}
                    continue
                weights, table, _ = tables[name]
                at = np.flatnonzero(weights[slots])
                pairs = np.unique(doc[at] * SLOTS + slots[at])
                text = m["text"][0] + np.bincount(pairs // SLOTS, weights[pairs % SLOTS], n)
                text = text + table[np.arange(len(RATES))[None, :], steps].sum(1)
                other = m["meta"][0] + m["meta"][1:][meta].sum(1)
                joint = m["joint"][0] + m["joint"][1] * text + m["joint"][2] * other
                out |= {f"{name}_text": sigmoid(text), f"{name}_meta": sigmoid(other), name: sigmoid(joint)}
            yield rows, out

    return scores


SCORES = "quality_text double, quality_meta double, p_quality double, toxic_text double, toxic_meta double, p_toxic double, score double, keep boolean"


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_labelled: int = 8000, n_pool: int = 4000,
    rounds: int = 3, sure: float = 0.98, least_quality: float = 0.5, most_toxic: float = 0.5,
) -> DataFrame:
    """``docs`` with probabilities of good quality and of toxicity, and ``keep``.

    Text view: words (hashed) and shares of odd words in the whole text.  Metadata view: language, source, length and
    line layout.  Both are fitted in the driver on at most ``n_labelled`` labelled and ``n_pool`` other documents, picked
    by a hash of the id; all documents are scored.  ``labels``: the id column, ``quality`` and ``toxic`` (0/1); of several
    rows for one id the worst counts, rows with a null are not used.  Fewer than 50 usable labels, or only one class:
    the share of the class is everybody's probability (quality 1 and toxicity 0 without any).

    All columns of ``docs`` stay (an existing column named like an added one gets replaced).  Null text counts as empty;
    an empty text is scored like any other; a null language or source is a value of its own.  Repeated rows get equal
    scores.  Columns ``lang`` and ``source`` are used where they exist.  Empty table: empty result.
    """
    models = fit(docs, labels, {"quality": 0, "toxic": 1}, id_col, text_col, n_labelled, n_pool, rounds, sure)
    return _scored(docs, models, text_col, least_quality, most_toxic)


def _scored(docs: DataFrame, models: dict, text_col: str, least_quality: float, most_toxic: float) -> DataFrame:
    added = [p.split()[0] for p in SCORES.split(", ")]
    names = [c for c in docs.columns if c.lower() not in added]
    scores = _scorer(models)
    lang, source = (unused(docs, c) if c in docs.columns else c for c in ("lang", "source"))
    text = unused(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = pa.RecordBatch.from_arrays([batch.column(c) for c in (text, lang, source)], names=["text", "lang", "source"])
            for rows, out in scores(given):
                n = rows.stop - rows.start
                made = [out["quality_text"], out["quality_meta"], out["quality"], out["toxic_text"], out["toxic_meta"], out["toxic"]]
                made += [out["quality"] * (1 - out["toxic"]), (out["quality"] >= least_quality) & (out["toxic"] < most_toxic)]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(rows.start, n) for c in names] + [pa.array(m) for m in made], names=names + added)

    field = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    asked = docs.select(*names, F.col(text_col).alias(text), field("lang").alias(lang), field("source").alias(source))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names] + [SCORES])
    return asked.mapInArrow(run, schema)
