"""Language identification by cross-parsing entropy.

For each language the labelled text of a bounded sample is indexed by a suffix automaton. A text is parsed against it from left
to right into phrases, each the longest match with anything in the index; a phrase of a language's own text is long, so the
language that needs the fewest phrases, normalised to phrases x log2(index size) / symbols, wins.

Parsing only ever follows transitions forward and restarts at the root. The automata of all languages lie in one pair of arrays:
the moves of a state start at its base, and a slot belongs to the state that its owner names. The texts of a batch are parsed side by
side with array operations, against all languages at once; the few that go on longer than all others are finished one symbol after
the other. Whole texts are parsed, and no phrase is cut.

The learned sample is bounded: at most SAMPLE_DOCS texts a language, chosen by a hash among the distinct ones that hold a letter. A chosen text is
learned whole, however long. All letters of the sample are told apart. Languages are the non-null labels.

Cases: null texts and texts without a letter are "und" with score 0; letters that the sample lacks are unknown symbols,
each a phrase of its own; equal rates go to the language first by name; repeated rows are judged alike; rows without an id teach
nothing, and equal texts of a language count once, whatever their ids; without labelled rows everything is "und"; an empty table gives an empty result; other columns are kept, but columns
named like an output give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bound_batches, without, worker

#: Labelled texts learned for a language, shares of a language that they are chosen in.
SAMPLE_DOCS, SHARES = 64, 64
#: Texts that are still parsed side by side; slope of the score against differences of rates.
LEAST_LANES, SLOPE = 12, 12.0
GAP, OTHER = 0, 1


def remainder(row_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo of."""
    return F.crc32(row_id.cast("string").cast("binary")) % of


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence, by state."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def packed(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The moves in arrays: base by state; owner and target by slot, where a state's move by symbol c has the slot base + c.

    Only the root, state 0, has a slot for every symbol, by which it stays what it is where it has no move."""
    base = np.zeros(len(moves), np.int64)
    owner = np.full(2 * width + sum(map(len, moves)) + len(moves), -1, np.int64)
    target = np.zeros(len(owner), np.int64)
    used = bytearray(len(owner) + width)
    used[:width] = b"\1" * width
    owner[:width] = 0
    for c, to in moves[0].items():
        target[c] = to
    low, ones = 0, []
    for state in sorted(range(1, len(moves)), key=lambda k: -len(moves[k])):
        to = moves[state]
        if len(to) < 2:
            ones += [state] * len(to)
            continue
        at, tries = low, 0
        while any(used[at + c] for c in to):
            at, tries = at + 1, tries + 1
        if tries > 64:  # what lies below is too full to be tried again
            low = at - 32
        if at + width > len(owner):
            owner, target = np.concatenate((owner, np.full(len(owner), -1))), np.concatenate((target, np.zeros(len(target), np.int64)))
            used += bytes(len(owner))
        base[state] = at
        for c, t in to.items():
            used[at + c], owner[at + c], target[at + c] = 1, state, t
    if ones:
        symbols, targets = (np.array(x) for x in zip(*(next(iter(moves[k].items())) for k in ones), strict=True))
        gaps = np.flatnonzero(np.frombuffer(bytes(used), np.uint8) == 0)
        slots = gaps[gaps >= width][: len(ones)]
        if len(slots) < len(ones):
            slots = np.concatenate((slots, np.arange(len(ones) - len(slots)) + len(used)))
        size = int(slots[-1]) + 1
        if size > len(owner):
            owner, target = np.concatenate((owner, np.full(size - len(owner), -1))), np.concatenate((target, np.zeros(size - len(target), np.int64)))
        base[ones], owner[slots], target[slots] = slots - symbols, ones, targets
    end = int(np.flatnonzero(owner >= 0)[-1]) + 1 + width
    return base, np.concatenate((owner, np.full(width, -1)))[:end], np.concatenate((target, np.zeros(width, np.int64)))[:end]


class CrossParser:
    """Automata of the labelled texts of each language, over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s.lower() if c.isalpha()})
        self.codes = np.fromiter((OTHER if chr(c).isalpha() else GAP for c in range(0x110000)), np.uint16 if len(letters) < 65_000 else np.uint32, 0x110000)
        self.codes[[ord(c) for c in letters]] = np.arange(len(letters)) + OTHER + 1
        width = OTHER + 1 + len(letters)
        self.scale, self.roots = np.ones(len(self.names)), np.zeros(len(self.names), np.int32)
        #: By language and symbol, what follows where a phrase ends: 4 x the state after the symbol + the phrases that end.
        self.start = np.zeros((len(self.names), width), np.int32)
        parts, states, slots = [], 0, 0
        for k, name in enumerate(self.names):
            symbols = self.symbols(samples[name])
            moves = automaton(symbols.tolist())
            base, owner, target = packed(moves, width)
            lacks = np.ones(width, np.int64)
            lacks[list(moves[0])] = 0
            after = (target + states) * 4
            after[:width] += lacks
            self.start[k] = after[:width] + 1
            self.roots[k], self.scale[k] = states, np.log2(max(2, len(symbols)))
            parts.append((base + slots, np.where(owner < 0, -1, owner + states), after))
            states, slots = states + len(base), slots + len(owner)
        joined = [np.concatenate(x).astype(np.int32) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int32)] * 3
        self.base, self.owner, self.after = joined

    def symbols(self, text: str) -> np.ndarray:
        """Letters in lower case; a run of anything else is one gap."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        codes = np.concatenate((np.zeros(1, self.codes.dtype), self.codes[points]))
        return codes[(codes != GAP) | np.concatenate((np.ones(1, bool), codes[:-1] != GAP))]

    def rates(self, texts: list[np.ndarray]) -> np.ndarray:
        """Normalised phrases of each text (rows) in each language (columns)."""
        sizes = np.array([len(s) for s in texts])
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([texts[i] for i in order])
        starts = np.concatenate(([0], np.cumsum(sizes[order])[:-1]))
        alive = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")
        state = np.repeat(self.roots[:, None], len(texts), 1)
        count = np.zeros(state.shape, np.int64)
        steps = int(np.searchsorted(-alive, -LEAST_LANES, side="right"))
        for t in range(steps):
            n = alive[t]
            symbol = flat[starts[:n] + t]
            now = state[:, :n]
            slot = self.base[now] + symbol
            after = np.where(self.owner[slot] == now, self.after[slot], self.start[:, symbol])
            count[:, :n] += after & 3
            state[:, :n] = after >> 2
        base, owner, after = memoryview(self.base), memoryview(self.owner), memoryview(self.after)
        for i in range(alive[steps] if steps < len(alive) else 0):
            rest = flat[starts[i] + steps : starts[i] + sizes[order[i]]].tolist()
            for k in range(len(self.names)):
                at, n, restart = int(state[k, i]), 0, memoryview(self.start[k])
                for c in rest:
                    slot = base[at] + c
                    to = after[slot] if owner[slot] == at else restart[c]
                    n += to & 3
                    at = to >> 2
                state[k, i] = at
                count[k, i] += n
        count += state != self.roots[:, None]
        out = np.empty((len(texts), len(self.names)))
        out[order] = (count * self.scale[:, None] / sizes[order]).T
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and rate of each text."""
        symbols = [self.symbols(t) if t else None for t in texts]
        known = [i for i, s in enumerate(symbols) if s is not None and (s != GAP).any() and self.names]
        names, scores, best = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        if known:
            rates = self.rates([symbols[i] for i in known])
            win = rates.argmin(1)
            lead = 1 / np.exp(-SLOPE * (rates - rates.min(1, keepdims=True))).sum(1)
            for i, w, s, r in zip(known, win, lead, rates.min(1), strict=True):
                names[i], scores[i], best[i] = self.names[w], float(s), float(r)
        return names, scores, best


def learn(labelled: DataFrame, row_id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS) -> CrossParser:
    """The parser of the bounded sample. Texts are chosen by their digests, at most `docs` a language, and then fetched whole by a broadcast of these."""
    said = labelled.where(F.col(lang).isNotNull() & F.col(row_id).isNotNull()).select(F.col(lang).alias("_of"), F.col(text).alias("_said"), F.xxhash64(text).alias("_mark"))
    lettered = said.where(F.col("_said").rlike(r"\p{L}"))
    marks = lettered.select(F.col("_of").alias("_lang"), F.col("_mark").alias("_key")).distinct()
    # First in shares of a language, then among the firsts of all shares: no task meets all digests of a language.
    marks = marks.withColumn("_share", F.pmod(F.xxhash64("_key", F.lit("share")), F.lit(SHARES)))
    for group in (["_lang", "_share"], ["_lang"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64("_key"), "_key"))
        marks = marks.withColumn("_rank", rank).where(F.col("_rank") <= docs)
    chosen = marks.select("_lang", "_key")
    found = lettered.join(F.broadcast(chosen), (F.col("_of") == F.col("_lang")) & (F.col("_mark") == F.col("_key"))).groupBy("_lang", "_key").agg(F.min("_said").alias("_text")).collect()
    texts: dict[str, list[str]] = {}
    for name, _, whole in sorted(found):
        texts.setdefault(name, []).append(whole)
    return CrossParser({name: "\n".join(said) for name, said in texts.items()})


def identify(df: DataFrame, parser: CrossParser, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and phrase_rate. The parser, of a size that the sample bounds, goes to every worker."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrase_rate", T.DoubleType())]
    kept = without(df, *(f.name for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rates = parser.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=[*kept, *(f.name for f in fields)])

    bound_batches(df.sparkSession)
    return df.mapInArrow(worker(run), T.StructType([*(df.schema[c] for c in kept), *fields]))
