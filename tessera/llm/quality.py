"""Quality classifier: a generalised additive model with pairwise interactions.

Features are of the whole text: FEATURES of its surface, and LEXICAL ones that hold its words and characters against labelled texts. A
Lexicon counts the hashed words, runs of four bytes and runs of three before a byte in good and in bad texts; a text gets the mean log
odds of its words, those of its runs, and the bits a byte that a character model needs for it. The counts are made on Spark from the
sampled labelled texts, whole, and have a fixed size. Rows that the model is fitted on get their odds from counts of the texts of another part (by
the text's own checksum, so copies stay together): no text vouches for itself.

Features are cut into quantile bins. Shallow trees over one feature at a time are boosted in cycles, each
adding a small step to that feature's lookup table; then the strongest pairs of features get two-dimensional tables the same
way, on what the single features leave over. A score is the logistic function of table entries added up, all vectorised.

The model is fitted on at most TRAIN_ROWS labelled rows, those first by a hash of their id; the counts are of the texts of a hash share of ids, of
1.2 times as many rows if there are so many. Labels, language, source and id
are never features.

Cases: null and empty texts have features of zero and get a score like any other; null labels teach nothing; ids labelled twice
teach twice; without both labels the model is the share of good rows (0.5 without rows) and the odds are even; repeated rows are scored alike; very long
texts are read whole, step by step (a word of over STEP bytes counts as several); an empty table gives an empty result; other columns are kept, but columns named features or score give way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, stored, without

TRAIN_ROWS = 20_000
FEATURES = ("log_bytes", "word_length", "upper", "digits", "marks", "symbols", "distinct_words", "repeated_words", "repeated_lines", "line_words", "sentence_words", "long_words", "short_words", "longest_word")
LEXICAL = ("word_odds", "run_odds", "byte_bits")
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAST = 24, 120, 60, 6, 0.15, 8


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)  # letters and bytes of longer characters
    kinds[[9, 10, 11, 12, 13, 32]] = 1
    kinds[65:91] = 2
    kinds[48:58] = 3
    for c in b".,;:'\"-()?":
        kinds[c] = 4
    for c in b"!#$%&*+/<=>@[\\]^_`{|}~":
        kinds[c] = 5
    return kinds


KINDS = _kinds()


def text_features(text: str | None) -> list[float]:
    """FEATURES of one whole text."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    count = np.bincount(KINDS[np.frombuffer(raw, np.uint8)], minlength=6)
    words = raw.split()
    n = max(1, len(words))
    solid = max(1, len(raw) - int(count[1]))
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x]
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    return [
        float(np.log1p(len(raw))),
        solid / n,
        count[2] / solid,
        count[3] / solid,
        count[4] / solid,
        count[5] / solid,
        len(set(words)) / n,
        same / n,
        1 - len(set(lines)) / max(1, len(lines)),
        n / max(1, len(lines)),
        n / (ends + 1),
        float((sizes > 12).sum()) / n,
        float((sizes < 4).sum()) / n,
        float(np.log1p(sizes.max(initial=0))),
    ]


#: Bytes that are looked at in one go, slots of a table of counts, parts of the learned texts that know nothing of each other.
STEP, SLOT_BITS, PARTS = 1 << 18, 15, 2
SLOTS = 1 << SLOT_BITS
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
POWERS = np.cumprod(np.full(STEP, 0x100000001B3, np.uint64))


def _slots(codes: np.ndarray, odd: int) -> np.ndarray:
    """The first SLOT_BITS of the products with an odd number."""
    return (codes * codes.dtype.type(odd)) >> codes.dtype.type(8 * codes.dtype.itemsize - SLOT_BITS)


def lexical_slots(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slots of the words of a text, of each run of four bytes and of that run's first three, step by step; A-Z are lower-cased.

    A step ends behind the last white space in STEP bytes, and looks back three bytes: runs are never cut."""
    every = np.frombuffer(raw, np.uint8)
    at = 0
    while at < len(every):
        spaces = np.flatnonzero(KINDS[every[at : at + STEP]] == 1)
        end = len(every) if at + STEP >= len(every) else at + (int(spaces[-1]) + 1 if len(spaces) else STEP)
        step = LOWER[every[at:end]]
        solid = KINDS[step] != 1
        starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        words = np.zeros(0, np.uint64)
        if len(starts):
            first = np.zeros(len(step), np.int64)
            first[starts] = starts
            place = np.arange(len(step)) - np.maximum.accumulate(first)
            words = np.add.reduceat(np.where(solid, (step.astype(np.uint64) + np.uint64(1)) * POWERS[place], np.uint64(0)), starts)
        run = LOWER[every[max(0, at - 3) : end]].astype(np.uint32)
        runs = np.zeros(0, np.uint32) if len(run) < 4 else run[:-3] | run[1:-2] << np.uint32(8) | run[2:-1] << np.uint32(16) | run[3:] << np.uint32(24)
        yield _slots(words, 0x9E3779B97F4A7C15), _slots(runs, 0x9E3779B1), _slots(runs & np.uint32(0xFFFFFF), 0x85EBCA6B)
        at = end


class Lexicon:
    """What labelled texts say of words and runs of bytes: counts has a table of SLOTS for each label (0, 1) of words, runs of four and runs of three."""

    def __init__(self, counts: np.ndarray):
        total = counts.sum(2, keepdims=True)
        share = np.log((counts + 1.0) / (total + SLOTS))
        even = (total > 0).all(0, keepdims=True)  # without texts of both labels nothing speaks for either
        odds = np.where(even, share[1:] - share[:1], 0.0)[0].astype(np.float32)
        both = counts.sum(0)
        self.words, self.runs = odds[0], odds[1]
        self.run_bits = np.log2(both[1] + 0.5).astype(np.float32)
        self.before_bits = np.log2(both[2] + 128.0).astype(np.float32)

    def features(self, raw: bytes) -> list[float]:
        """LEXICAL features of one whole text."""
        sums, words, runs = np.zeros(3), 0, 0
        for word, run, before in lexical_slots(raw):
            words += len(word)
            runs += len(run)
            sums += [self.words[word].sum(dtype=np.float64), self.runs[run].sum(dtype=np.float64), self.before_bits[before].sum(dtype=np.float64) - self.run_bits[run].sum(dtype=np.float64)]
        return [float(sums[0] / max(1, words)), *(sums[1:] / max(1, runs)).tolist()]


def part_of(raw: bytes) -> int:
    return zlib.crc32(raw) % PARTS


def label_counts(texts: DataFrame, text: str = "text", label: str = "_label") -> np.ndarray:
    """Counts of the words and runs of labelled texts, by part, label (over 0.5 is good), kind and slot. Each task sends its sums, never more numbers than slots."""
    shape = (PARTS, 2, len(LEXICAL), SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(shape, np.int64)
        for batch in batches:
            for t, good in zip(batch.column(text), batch.column(label).to_pylist(), strict=True):
                raw = (t.as_py() or "").encode()
                for kinds in lexical_slots(raw):
                    for table, slots in zip(counts[part_of(raw), int(good > 0.5)], kinds, strict=True):
                        table += np.bincount(slots.astype(np.int64), minlength=SLOTS)
        flat = counts.reshape(-1)
        filled = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(flat[filled], pa.int64())], names=["slot", "n"])

    bound_batches(texts.sparkSession)
    sums = texts.select(text, label).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(shape, np.int64)
    counts.reshape(-1)[sums["slot"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return counts


def lexicons(counts: np.ndarray) -> list[Lexicon]:
    """For the texts of each part a lexicon that does not know them, and last the one that knows all."""
    every = counts.sum(0)
    return [*(Lexicon(every - part) for part in counts), Lexicon(every)]


def featured(df: DataFrame, text: str = "text", known: list[Lexicon] | None = None, apart: bool = False) -> DataFrame:
    """The frame with its text column replaced by features: an array of FEATURES, then, with lexicons, of LEXICAL; apart: by the lexicon that does not know the text's part."""
    kept = without(df, text, "features")

    def features(t: str | None) -> list[float]:
        surface = text_features(t)
        if known is None:
            return surface
        raw = (t or "").encode()
        return surface + known[part_of(raw) if apart else PARTS].features(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([features(t.as_py()) for t in batch.column(text)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, "features"])

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField("features", T.ArrayType(T.DoubleType()))]))


class AdditiveModel:
    """Lookup tables for single features and pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for c in x.T]
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(share / (1 - share)))
        self.single = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.double: list[np.ndarray] = []
        if not 0 < y.sum() < len(y):
            return
        bins = self.bins(x)
        total = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for k, table in enumerate(self.single):
                g, h = self._slopes(total, y)
                step = RATE * self._tree(np.bincount(bins[:, k], g, len(table)), np.bincount(bins[:, k], h, len(table)), np.bincount(bins[:, k], minlength=len(table)))
                table += step
                total += step[bins[:, k]]
        g, h = self._slopes(total, y)
        gains = sorted(((self._quadrants(bins, i, j, g, h)[0], i, j) for i, j in combinations(range(len(self.edges)), 2)), reverse=True)
        self.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
        self.double = [np.zeros((len(self.single[i]), len(self.single[j]))) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in zip(self.pairs, self.double, strict=True):
                g, h = self._slopes(total, y)
                step = RATE * self._quadrants(bins, i, j, g, h)[1]
                table += step
                total += step[bins[:, i], bins[:, j]]

    @staticmethod
    def _slopes(total: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    @staticmethod
    def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A tree of at most three leaves over ordered bins: its Newton step for each bin."""
        leaves = [(0, len(g))]
        for _ in range(2):
            best = (1e-9, None)
            for at, (a, b) in enumerate(leaves):
                cg, ch, cn = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
                if b - a < 2:
                    continue
                left = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
                left[(cn[:-1] < LEAST) | (cn[-1] - cn[:-1] < LEAST)] = -1
                cut = int(left.argmax())
                if left[cut] > best[0]:
                    best = (left[cut], (at, a + cut + 1))
            if best[1] is None:
                break
            at, cut = best[1]
            a, b = leaves[at]
            leaves[at : at + 1] = [(a, cut), (cut, b)]
        step = np.zeros(len(g))
        for a, b in leaves:
            step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
        return step

    def _quadrants(self, bins: np.ndarray, i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best cut of each axis into two: gain over no cut, and the Newton step for each cell."""
        shape = (len(self.single[i]), len(self.single[j]))
        cell = bins[:, i] * shape[1] + bins[:, j]
        cg, ch = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape).cumsum(0).cumsum(1) for v in (g, h))
        if min(shape) < 2:
            return 0.0, np.zeros(shape)

        def corners(c: np.ndarray) -> list[np.ndarray]:
            a, rows, cols, every = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
            return [a, rows - a, cols - a, every - rows - cols + a]

        gs, hs = corners(cg), corners(ch)
        gain = sum(a**2 / (b + 1) for a, b in zip(gs, hs, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
        r, c = np.unravel_index(gain.argmax(), gain.shape)
        steps = [a[r, c] / (b[r, c] + 1) for a, b in zip(gs, hs, strict=True)]
        table = np.empty(shape)
        table[: r + 1, : c + 1], table[: r + 1, c + 1 :], table[r + 1 :, : c + 1], table[r + 1 :, c + 1 :] = steps
        return float(gain[r, c]), table

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1."""
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.single):
            total += table[bins[:, k]]
        for (i, j), table in zip(self.pairs, self.double, strict=True):
            total += table[bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-total))


def labelled(df: DataFrame, labels: DataFrame, value: str, row_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """_id, _label and the value of the rows whose id is in a hash share of the labelled ones, a little more than the bound, so that no task sends more than its part of it to the driver."""
    known = labels.where(F.col(label).isNotNull()).select(F.col(row_id).alias("_id"), F.col(label).cast("double").alias("_label"))
    some = int(min(1.0, 1.2 * rows / max(1, known.count())) * 1_000_000) + 1
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < some)
    ids = chosen.select("_id").distinct()
    # There are at most 1.2 x rows ids but for chance: values, which may be whole texts, are not shuffled to be chosen.
    ids = F.broadcast(ids) if ids.count() <= 2 * rows else ids
    mine = df.select(F.col(row_id).alias("_row"), F.col(value)).join(ids, F.col("_row") == F.col("_id"), "left_semi")
    return mine.join(chosen, F.col("_row") == F.col("_id")).select("_id", "_label", value)


def train(sample: DataFrame, rows: int = TRAIN_ROWS, width: int = len(FEATURES)) -> AdditiveModel:
    """Fits on at most so many rows of _id, _label and so many features, the first by a hash of the id."""
    first = sample.orderBy(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)), F.xxhash64("_id"), "_id", "_label", "features").limit(rows).select("_label", "features").toPandas()
    x = np.array(first["features"].tolist(), np.float64).reshape(-1, width)
    return AdditiveModel(x, first["_label"].to_numpy(np.float64))


def fit(features: DataFrame, labels: DataFrame, row_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fits on a bounded sample of the labelled rows of a features frame."""
    return train(labelled(features, labels, "features", row_id, label, rows), rows)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> tuple[list[Lexicon], AdditiveModel]:
    """Lexicons and the model that goes with them, from a bounded sample of the labelled documents."""
    taught = stored(labelled(docs, labels, text, row_id, label, rows), "quality-sample")
    known = lexicons(label_counts(taught, text))
    return known, train(featured(taught, text, known, apart=True), rows, len(FEATURES) + len(LEXICAL))


def scored(features: DataFrame, model: AdditiveModel) -> DataFrame:
    """Adds a score; the features go."""
    kept = without(features, "features", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(model.score(x), pa.float64())], names=[*kept, "score"])

    return features.mapInArrow(run, T.StructType([*(features.schema[c] for c in kept), T.StructField("score", T.DoubleType())]))
