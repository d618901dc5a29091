"""Hashed maximum-entropy language model with class-factored softmax, and a smoothed unigram base beside it.

P(word | history) = P(class | history) P(word | class, word before).  Both factors are softmaxes over features: the first
over hashes of the word before, the one before that (skip) and both, the second over pairs of words, told apart by 64-bit
hashes.  Weights come from gradient updates over counts, of the first factor by sums of all tasks in each round, of the
second group by group, since a group (word before, class) shares its weights with no other.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import token_blocks as tb
from .scratch import written

U64 = tb.U64
#: The token that ends each text.
END = np.uint64(0x0E0D0E0D0E0D0E0D)
#: Classes: the end, the most frequent words one each, all other words by their ending.
OWN_CLASS, ENDINGS = 31, 32
CLASSES = 1 + OWN_CLASS + ENDINGS
#: Features: what the word before and the one before that hash to (frequent words have a slot of their own), and both.
BEFORE, SKIPPED, BOTH = 1024, 32, 4096
CONTEXTS = BEFORE * SKIPPED
#: Words with at least one in so many of all training tokens are held by every task; by counting there are no more.
COMMON = 200_000
#: Every pair of words gets a weight.  Those of pairs with at least one in so many of all training tokens are held by
#: every task, all others meet their tokens in a join.  A word of a held pair is common, as it is no rarer than the pair.
PAIRS = COMMON
#: Pairs that a task counts before it hands them on.
COUNTED_PAIRS = 1 << 22
SMOOTHING = 0.1
BLOCK = 256

WORDS = "word long, ending int, n long"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an END after each text, hash of the last two bytes, document of each."""
    starts, stops, doc = tb.words(data, offsets)
    n = len(offsets) - 1
    hashes = tb.span_hashes(data, starts, stops, tb.LOWER_VALUES)
    low = tb.LOWERED[data]
    ending = low[stops - 1].astype(np.int64) * 256 + np.where(stops - starts > 1, low[stops - 2], 0) if len(stops) else np.zeros(0, np.int64)
    at = np.cumsum(np.bincount(doc, minlength=n))
    return np.insert(hashes, at, END), np.insert(ending, at, 0), np.insert(doc, at, np.arange(n))


def hashed(what: np.ndarray, salt: int, size: int) -> np.ndarray:
    return (tb.mixed(what.astype(U64) + U64(salt)) >> U64(20)).astype(np.int64) % size


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, offsets in tb.text_blocks(batch.column("text")):
            word, ending, _ = tokens(data, offsets)
            word, first, n = np.unique(word, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(hashed(ending[first], 1, ENDINGS).astype(np.int32)), pa.array(n)], names=["word", "ending", "n"]
            )


class Lexicon:
    """Slots, classes and counts of the common words, small enough for every task."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        """``words`` (without END) from the most frequent on."""
        self.rank = np.argsort(words)
        self.words, self.counts = words[self.rank], counts[self.rank].astype(float)

    def look_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if not common) and rank (-1) of each word."""
        if not len(self.words):
            return np.zeros(len(word)), np.full(len(word), -1)
        each, back = np.unique(word, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, each), len(self.words) - 1)
        hit = self.words[at] == each
        return np.where(hit, self.counts[at], 0.0)[back], np.where(hit, self.rank[at], -1)[back]


def words_before(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hash of the word before each token; END at the start of a text."""
    before = np.full(len(word), END)
    same = doc[1:] == doc[:-1]
    before[1:][same] = word[:-1][same]
    return before


def pair_hashes(before: np.ndarray, what: np.ndarray) -> np.ndarray:
    """64-bit hash of a word before and a word (or class) behind it."""
    return tb.mixed(before * U64(0x9E3779B97F4A7C15) + tb.mixed(what.astype(U64)))


#: The word in front of a text among the ranks of common words, of which there are fewer.
END_RANK = 1 << 20
#: Sign of a number that stands for a hash; ranks have none.
HASHED = U64(1 << 63)


def word_keys(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Words as numbers: the rank of a common word, which is short, or else the hash."""
    return np.where(rank >= 0, rank, np.where(word == END, END_RANK, (word | HASHED).view(np.int64)))


def group_keys(before: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The word before (as ``word_keys``) and the class as one number."""
    return np.where(before >= 0, before * CLASSES + cls, (pair_hashes(before.view(U64), cls) | HASHED).view(np.int64))


def keys_before(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each token the key of the word before; END_RANK at the start of a text."""
    before = np.full(len(keys), END_RANK)
    same = doc[1:] == doc[:-1]
    before[1:][same] = keys[:-1][same]
    return before


def classes_and_contexts(word: np.ndarray, ending: np.ndarray, doc: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token and the context (hashes of the two words before, within the text) it stands in."""
    cls = np.where(word == END, 0, np.where((rank >= 0) & (rank < OWN_CLASS), rank + 1, 1 + OWN_CLASS + hashed(ending, 1, ENDINGS)))
    own = BEFORE // 2
    slot = np.where((rank >= 0) & (rank < own - 1), rank + 1, own + hashed(word, 2, BEFORE - own))
    half = SKIPPED // 2
    skip = np.where((rank >= 0) & (rank < half - 1), rank + 1, half + hashed(word, 3, SKIPPED - half))
    before, skipped = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    same = doc[1:] == doc[:-1]
    before[1:][same] = slot[:-1][same]
    same = doc[2:] == doc[:-2]
    skipped[2:][same] = skip[:-2][same]
    return cls, before * SKIPPED + skipped


def _count_contexts(held: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of contexts by class; a task counts less than 2**31 tokens."""
        lexicon = held.value
        total = np.zeros(CONTEXTS * CLASSES, np.int32)
        for batch in batches:
            for _, data, offsets in tb.text_blocks(batch.column("text")):
                word, ending, doc = tokens(data, offsets)
                cls, context = classes_and_contexts(word, ending, doc, lexicon.look_up(word)[1])
                at, n = np.unique(context * CLASSES + cls, return_counts=True)
                total[at] += n.astype(np.int32)
        total = total.reshape(CONTEXTS // BLOCK, -1)
        filled = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(filled.astype(np.int32)), pa.array([total[b].tobytes() for b in filled], pa.binary())], names=["block", "counts"]
        )

    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of each block as its rows stream by."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            more = np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
            sums[block] = sums[block] + more if block in sums else more
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"])


#: Tasks of a gradient round; each returns a table of weights, whatever it has read.
GRADIENT_TASKS = 4

#: Feature of both words for every context.
JOINT = (tb.mixed(np.arange(CONTEXTS, dtype=U64) + U64(5)) % U64(BOTH)).astype(np.int64)
#: Rows of the weight table: one for all contexts, then the three kinds of features.
ROWS = 1 + BEFORE + SKIPPED + BOTH


def features(context: np.ndarray) -> np.ndarray:
    """The four weight rows of each context."""
    return np.stack([np.zeros(len(context), np.int64), 1 + context // SKIPPED, 1 + BEFORE + context % SKIPPED, 1 + BEFORE + SKIPPED + JOINT[context]], 1)


def log_probabilities(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Natural logarithm of the class probabilities in each context."""
    logits = weights[features(context)].sum(1)
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def class_table(weights: np.ndarray) -> np.ndarray:
    """log10 class probabilities of all contexts."""
    return np.concatenate([log_probabilities(weights, np.arange(a, a + BLOCK)) / np.log(10) for a in range(0, CONTEXTS, BLOCK)]).astype(np.float32)


PAIR = "grp long, word long, cls int, n long"


def _count_pairs(held: Broadcast):
    """Pairs of words behind any word and in classes of many words, with their counts; those of a task are added up first."""
    names = [c.split()[0] for c in PAIR.split(", ")]

    def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        pair, grp, word, cls, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        pair, first, back = np.unique(pair, return_index=True, return_inverse=True)
        return pair, grp[first], word[first], cls[first], np.bincount(back, n, len(pair)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, parts, size = held.value, [], 0
        for batch in batches:
            for _, data, offsets in tb.text_blocks(batch.column("text")):
                word, ending, doc = tokens(data, offsets)
                rank = lexicon.look_up(word)[1]
                cls, _ = classes_and_contexts(word, ending, doc, rank)
                many = cls > OWN_CLASS
                keys = word_keys(word, rank)
                grp = group_keys(keys_before(keys, doc)[many], cls[many])
                pair = pair_hashes(words_before(word, doc)[many], word[many])
                parts.append(added([(pair, grp, keys[many], cls[many].astype(np.int32), np.ones(len(pair)))]))
                size += len(parts[-1][0])
                if size > COUNTED_PAIRS:
                    parts = [added(parts)]
                    size = len(parts[0][0])
                    if size > COUNTED_PAIRS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0][1:]], names=names)
                        parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in added(parts)[1:]], names=names)

    return run


WEIGHED = "grp long, word long, n long, weight float, log_sum float, summed boolean"
#: Most updates of the second factor, the step at which it is found, and the pull of its weights towards 0.
PAIR_ROUNDS, PAIR_STEP, PAIR_RIDGE = 150, 1e-4, 0.5


def pair_weights(group: np.ndarray, n: np.ndarray, total: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each pair and logarithm of its group's sum 1 + sum of share * (exp(weight) - 1).

    ``n``: the pair's count, ``total``: its group's tokens, ``share``: the word's plain share of its class.  Pairs come
    sorted by group.  Each update is Newton's, of all weights of a group at once: their curvature is a diagonal less
    one product, so it is solved by two sums.
    """
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    weight = np.zeros(len(group))
    each = lambda sums: np.repeat(sums, sizes)
    for _ in range(PAIR_ROUNDS):
        p = share * np.exp(weight) / each(1 + np.add.reduceat(share * np.expm1(weight), starts))
        slope, bend = n - total * p - PAIR_RIDGE * weight, total * p + PAIR_RIDGE
        shared = np.add.reduceat(p * slope / bend, starts) / (1 - np.add.reduceat(total * p * p / bend, starts))
        step = np.clip((slope + total * p * each(shared)) / bend, -1, 1)
        weight = np.clip(weight + step, -20, 20)
        if np.abs(step).max() < PAIR_STEP:
            break
    return weight, np.log(each(1 + np.add.reduceat(share * np.expm1(weight), starts)))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by group, in tables of whole groups."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        group = table["grp"].to_numpy()
        cut = int(np.flatnonzero(np.append(True, group[1:] != group[:-1]))[-1]) if len(group) else 0
        rest = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if rest is not None and rest.num_rows:
        yield rest


def _weigh(held_n: float):
    """Weights of sorted pairs; ``summed``: a pair of the group has ``held_n`` tokens.  A group is at most as long as its class has words."""
    return lambda batches: (_weighed(table, held_n) for table in _by_group(batches))


def _weighed(table: pa.Table, held_n: float) -> pa.RecordBatch:
    # Sums are added up in the order of the words, so reruns agree.
    table = table.take(pa.array(np.lexsort((table["word"].to_numpy(), table["grp"].to_numpy()))))
    group, n, share = (table[c].to_numpy() for c in ("grp", "n", "share"))
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    # Each token of a class behind a word is of some pair, so these add up to the group.
    sizes = np.diff(np.append(starts, len(group)))
    total = np.repeat(np.add.reduceat(n, starts), sizes)
    summed = np.repeat(np.maximum.reduceat(n, starts) >= held_n, sizes)
    weight, log_sum = pair_weights(group, n.astype(float), total.astype(float), share)
    kept = [table[c].combine_chunks() for c in ("grp", "word", "n")]
    return pa.RecordBatch.from_arrays([*kept, pa.array(weight.astype(np.float32)), pa.array(log_sum.astype(np.float32)), pa.array(summed)], names=[c.split()[0] for c in WEIGHED.split(", ")])


def _gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What tokens add to their texts: the weight of their pair, less the sum of its group unless that is ``summed``.

    Rows come sorted by group; those without ``row`` are weights.
    """
    for table in _by_group(batches):
        told = table["row"].is_valid().to_numpy()
        if not told.any():
            continue
        # The weight of a pair in front of its tokens.
        order = np.lexsort((told, table["word"].to_numpy(), table["grp"].to_numpy()))
        table, told = table.take(pa.array(order)), told[order]
        group, word, summed = (table[c].to_numpy() for c in ("grp", "word", "summed"))
        row, weight, log_sum = (pc.fill_null(table[c], 0).to_numpy() for c in ("row", "weight", "log_sum"))
        new = np.append(True, group[1:] != group[:-1])
        # Sums are of one sign or none: a group that no training text has has neither weights nor a sum.
        starts = np.flatnonzero(new)
        sums = np.where((low := np.minimum.reduceat(log_sum, starts)) < 0, low, np.maximum.reduceat(log_sum, starts))[np.cumsum(new) - 1]
        new[1:] |= word[1:] != word[:-1]
        weight = weight[np.flatnonzero(new)][np.cumsum(new) - 1]
        rows, back = np.unique(row[told], return_inverse=True)
        gain = np.bincount(back, (weight.astype(float) - np.where(summed, 0, sums))[told], len(rows))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(gain)], names=["row", "gain"])


class Pairs:
    """Weights of the held pairs and sums of their groups, by sorted hash: at most PAIRS of each."""

    def __init__(self, pair: np.ndarray, group: np.ndarray, weight: np.ndarray, log_sum: np.ndarray) -> None:
        order = np.argsort(pair)
        self.pair, self.weight = pair[order], weight[order]
        self.group, first = np.unique(group, return_index=True)
        self.log_sum = log_sum[first]

    def gains(self, before: np.ndarray, word: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """What the second factor adds to the logarithm of the plain share of each word."""
        if not len(self.pair):
            return np.zeros(len(word))
        return self._of(self.pair, self.weight, pair_hashes(before, word)) - self._of(self.group, self.log_sum, pair_hashes(before, cls))

    def held(self, before: np.ndarray, word: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the weight of each pair is held, and the sum of its group."""
        return tuple(np.isin(asked, keys) for asked, keys in ((pair_hashes(before, word), self.pair), (pair_hashes(before, cls), self.group)))

    @staticmethod
    def _of(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], 0.0)


def train_pairs(training: DataFrame, held: Broadcast, counts: DataFrame, all_n: int, class_sizes: np.ndarray) -> tuple[Pairs, DataFrame]:
    """The second factor: all pairs, counted by a shuffle and weighed group by group in the tasks.

    Returns the frequent ones for every task to hold, and the table of all (WEIGHED).
    """
    pairs = training.mapInArrow(_count_pairs(held), PAIR).groupBy("grp", "word", "cls").agg(F.sum("n").alias("n"))
    sizes = F.element_at(F.array(*[F.lit(float(x)) for x in class_sizes]), F.col("cls") + 1)
    shared = lambda rows: rows.select("grp", "word", "n", ((F.col("c") + SMOOTHING) / sizes).alias("share"))
    hashed_words = counts.where(F.col("n") * COMMON < all_n).select(F.col("word").bitwiseOR(F.lit(-(1 << 63))).alias("word"), F.col("n").alias("c"))

    def with_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = np.zeros(len(held.value.words))
        by_rank[held.value.rank] = held.value.counts
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(by_rank[batch.column("word").to_numpy()])], names=["grp", "word", "cls", "n", "c"])

    pairs = written(pairs, "pairs", free=True)
    common = pairs.where("word >= 0").select("grp", "word", "cls", "n").mapInArrow(with_count, "grp long, word long, cls int, n long, c double")
    rows = shared(common).unionByName(shared(pairs.where("word < 0").join(hashed_words, "word")))
    weighed = written(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(_weigh(all_n / PAIRS), WEIGHED), "weights", free=True)
    # At most PAIRS rows, by counting.
    top = weighed.where(F.col("n") * PAIRS >= all_n).toArrow()
    grp, word, weight, log_sum = (top[c].to_numpy() for c in ("grp", "word", "weight", "log_sum"))
    by_rank = np.full(END_RANK + 1, END)
    by_rank[held.value.rank] = held.value.words
    before, cls = by_rank[grp // CLASSES], grp % CLASSES
    return Pairs(pair_hashes(before, by_rank[word]), pair_hashes(before, cls), weight.astype(float), log_sum.astype(float)), weighed


def _gradient(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope = np.zeros((ROWS, CLASSES))
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen = np.frombuffer(counts.as_buffer(), np.int64).reshape(BLOCK, CLASSES)
                used = np.flatnonzero(seen.any(1))
                context, seen = block * BLOCK + used, seen[used]
                rest = seen - np.exp(log_probabilities(weights, context)) * seen.sum(1, keepdims=True)
                for rows in features(context).T:
                    np.add.at(slope, rows, rest)
        yield pa.RecordBatch.from_arrays([pa.array([slope.astype(np.float32).tobytes()], pa.binary())], names=["slope"])

    return run


def train(contexts: DataFrame, n_tokens: int, rounds: int, ridge: float = 1e-6) -> np.ndarray:
    """Weights after ``rounds`` distributed gradient updates (Adam) over the counted contexts.

    Each round every partition returns the gradient over its contexts, a table of fixed size; the driver adds them up.
    """
    weights = np.zeros((ROWS, CLASSES))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        parts = contexts.mapInArrow(_gradient(weights.astype(np.float32)), "slope binary").toArrow()["slope"]
        slope = sum(np.frombuffer(p.as_buffer(), np.float32).reshape(ROWS, CLASSES).astype(float) for p in parts) / max(n_tokens, 1) - ridge * weights
        del parts
        gc.collect()  # the function sent to the tasks holds the weights until it is collected
        first = 0.8 * first + 0.2 * slope
        second = 0.95 * second + 0.05 * slope * slope
        rate = 0.35 * min(1.0, 2.0 * (1 - step / (rounds + 1)))
        weights = weights + rate * (first / (1 - 0.8**step)) / (np.sqrt(second / (1 - 0.95**step)) + 1e-7)
    return weights


SCORED = (
    "row long, n_tokens long, common_sum double, common_known long, own_sum double, class_score double, "
    "rare array<long>, rare_n array<int>, grp array<long>, word array<long>, summed array<boolean>"
)


def _score(held: Broadcast, weights: np.ndarray, spread: np.ndarray, pairs: Pairs):
    """``weights``: of the first factor; ``spread``: log10 of what a class divides its words by; ``pairs``: what is held
    of the second factor.  Tokens whose pair is not held are listed by group and word; ``summed``: the group's sum is held."""
    tables: list[np.ndarray] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held.value
        for batch in batches:
            # log10 class probabilities by context, worked out once a task.
            if not tables:
                tables.append(class_table(weights))
            table = tables[0]
            for rows, data, offsets in tb.text_blocks(batch.column("text")):
                n = len(offsets) - 1
                word, ending, doc = tokens(data, offsets)
                count, rank = lexicon.look_up(word)
                cls, context = classes_and_contexts(word, ending, doc, rank)
                logs = np.log10(count + SMOOTHING)
                known = count > 0
                own = (cls <= OWN_CLASS) & known
                common = known | (word == END)
                rare = np.flatnonzero(~common)
                order = np.lexsort((word[rare], doc[rare]))
                pair_doc, pair_word = doc[rare][order], word[rare][order]
                new = np.flatnonzero(np.concatenate(([True], (pair_doc[1:] != pair_doc[:-1]) | (pair_word[1:] != pair_word[:-1])))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.concatenate((new, [len(rare)]))).astype(np.int32)
                cuts = np.concatenate(([0], np.cumsum(np.bincount(pair_doc[new], minlength=n)))).astype(np.int32)
                own_sum = np.bincount(doc, np.where(own & (word != END), logs, 0.0), n)
                many = cls > OWN_CLASS
                parts = table[context, cls] - np.where(many, spread[cls], 0.0)
                of_pair = words_before(word, doc)[many], word[many], cls[many]
                parts[many] += pairs.gains(*of_pair) / np.log(10)
                weighed, summed = pairs.held(*of_pair)
                keys = word_keys(word, rank)
                rest = np.flatnonzero(many)[~weighed]
                rest_cuts = np.concatenate(([0], np.cumsum(np.bincount(doc[rest], minlength=n)))).astype(np.int32)
                listed = group_keys(keys_before(keys, doc)[rest], cls[rest]), keys[rest], summed[~weighed]
                score = np.bincount(doc, parts, n)
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(rows.start, n), pa.array(np.bincount(doc, minlength=n)),
                    pa.array(np.bincount(doc, np.where(known & (word != END), logs, 0.0), n)), pa.array(np.bincount(doc, known & (word != END), n).astype(np.int64)),
                    pa.array(own_sum), pa.array(score),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(pair_word[new].view(np.int64))), pa.ListArray.from_arrays(pa.array(cuts), pa.array(times)),
                    *[pa.ListArray.from_arrays(pa.array(rest_cuts), pa.array(c)) for c in listed],
                ], names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, rounds: int = 40) -> DataFrame:
    """Base and model scores of each text: log10 probabilities of all its tokens.

    Learned from the rows whose crc32 of the id as text leaves a remainder by ``folds``; the others are ``held_out``.
    Tokens: words (runs of non-blank bytes, A-Z as a-z), then one end.  Words are told apart by 64-bit hashes.

    ``base_score``: sum of log10((c + 0.1) / (N + 0.1 (V + 1))).  ``score``: P(class | two words before) P(word | class,
    word before).  The 31 most frequent words and the end are classes of their own, all others share 32 by their ending.
    Within a class a word's plain share is (c + 0.1) / (N_class + 0.1 (V_class + 1)), what is left belongs to words never
    seen, and every pair of words that stands in the training texts tilts it: share * exp(weight) / sum.

    Columns: the id column, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row, whatever
    repeats.  Null text counts as empty: its only token is the end.  A null id counts as the empty text.  Other columns
    of ``docs`` are not read.  No training row: all counts are 0.  Empty table: empty result.
    """
    rest = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (rest == 0).alias("held_out"))
    training = rows.where("NOT held_out").select("text")
    counts = written(training.mapInArrow(_count_words, WORDS).groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n")), "word-counts", free=True)
    end = int(END.view(np.int64))
    all_n, all_v = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    n_end = (counts.where(F.col("word") == end).agg(F.sum("n")).first()[0]) or 0
    # At most COMMON words, by counting; they come as two columns of numbers.
    common = counts.where((F.col("n") * COMMON >= all_n) & (F.col("word") != end)).select("word", "n").toArrow()
    words, times = (common[c].to_numpy().astype(np.int64) for c in ("word", "n"))
    order = np.lexsort((words, -times))
    held = docs.sparkSession.sparkContext.broadcast(Lexicon(words[order].view(U64), times[order]))
    own_words = words[order][:OWN_CLASS].tolist()
    shared = counts.where((F.col("word") != end) & ~F.col("word").isin(own_words or [end])).groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    spread = np.full(CLASSES, np.log10(SMOOTHING))
    for r in shared:
        spread[1 + OWN_CLASS + r["ending"]] = np.log10(r["n"] + SMOOTHING * (r["v"] + 1))
    seen = training.mapInArrow(_count_contexts(held), "block int, counts binary").repartition("block").mapInArrow(_sum_blocks, "block int, counts binary")
    counted = written(seen, "contexts", free=True)
    weights = train(counted.coalesce(GRADIENT_TASKS), all_n, rounds)
    pairs, weighed = train_pairs(training, held, counts, all_n, 10.0**spread)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    passed = numbered.select("row", "text", "id", "held_out")
    scored = written(passed.mapInArrow(_with_columns(_score(held, weights.astype(np.float32), spread, pairs), ["id", "held_out"]), f"{SCORED}, id {docs.schema[id_col].dataType.simpleString()}, held_out boolean"), "scored", free=True)
    rare_words = scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rare = rare_words.join(counts.where(F.col("n") * COMMON < all_n).select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(c + SMOOTHING)).alias("rare_sum"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    # What the pairs that are not held add.  Tokens meet the weights of their group, or of their pair alone where the sum
    # of the group is held, as that of a large group is: no part is large.
    listed = scored.select("row", F.explode(F.arrays_zip("grp", "word", "summed")).alias("x")).select("row", "x.*")
    both = listed.unionByName(weighed.drop("n"), allowMissingColumns=True)
    dealt = both.repartition(F.when(F.col("summed"), F.xxhash64("grp", "word")).otherwise(F.col("grp")))
    gains = dealt.sortWithinPartitions("grp").mapInArrow(_gains, "row long, gain double").groupBy("row").agg(F.sum("gain").alias("gain"))
    every = F.lit(float(np.log10(all_n + SMOOTHING * (all_v + 1))))
    end_log = F.lit(float(np.log10(n_end + SMOOTHING)))
    zero = F.lit(0.0)
    sums = F.col("common_sum") + F.coalesce("rare_sum", zero)
    out = scored.drop("rare", "rare_n", "grp", "word", "summed").join(rare, "row", "left").join(gains, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("common_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_end > 0))).cast("long").alias("n_known"),
        F.lit(int(all_n)).cast("long").alias("train_tokens"), (sums + end_log - F.col("n_tokens") * every).alias("base_score"),
        (sums - F.col("own_sum") + F.col("class_score") + F.coalesce("gain", zero) / float(np.log(10))).alias("score"),
    )
    return out


def _with_columns(inner, names: list[str]):
    """Runs ``inner`` batch by batch and sets columns of the input, row for row, beside its output."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in inner(iter([batch])):
                more = [batch.column(c).slice(at, out.num_rows) for c in names]
                at += out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, *more], names=[*out.schema.names, *names])

    return run
