"""N-gram Jaccard join with components: T-occurrence search with DivideSkip.

A document is its set of distinct word shingles, as 64-bit hashes; documents with equal sets are one node. Two nodes of sizes x and y link
when 100 * overlap >= 85 * union, that is when the overlap reaches T = ceil(85 (x + y) / 185).

Candidates come from inverted lists. All tokens have one global order (rare first), and two nodes that link share a token
among the first x - ceil(0.85 x) + 1 of each; at their first shared token the positions can't add up to more than the
tokens they may differ in. Only those prefix tokens are posted. The order counts as frequent what a bounded sample shows;
any order gives the same links, so the sample touches speed alone.

Links are searched in two passes, because components are what is asked for and groups of copies can be very large. First every posted
node is compared with the cleanest node of each of its lists; the links found give components. Then only lists that still
hold several components are searched: pairs of different components that pass the size, position and parity bounds go on. A list
of more than LIST_ROWS nodes is dealt into blocks. No pair that may link two components is ever skipped.

The comparison itself is a T-occurrence search: lists of the query's tokens over a block of candidates are split by length; the
short ones are merged by a heap, the long ones are probed by binary search, only for candidates that can still reach T.

Cases: null and empty texts, and texts of white space, have no shingle and link with nothing; with fewer words than a shingle the
whole sequence is one; repeated rows are one node; null ids are rows of their own and never name a component unless all of its
ids are null; long texts are taken whole; an empty table gives an empty result; other columns are not looked at.
Node keys are 64-bit hashes of whole sets.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, stored, unused, worker
from .components import components

WORDS, PERCENT = 4, 85
#: Sample for the order: one document in SAMPLE_OF, about SAMPLE_DOCS at most; tokens on at least SAMPLE_LEAST of them, at most FREQUENT.
SAMPLE_OF, SAMPLE_DOCS, SAMPLE_LEAST, FREQUENT = 64, 20_000, 3, 50_000
#: Nodes of a block of a list, of a block of a search; nodes that a task remembers as posted; pairs held before they are passed on.
LIST_ROWS, BLOCK_ROWS, SEEN, HELD = 2_048, 256, 500_000, 50_000
#: Documents for each file of the tables made of them, at least: small inputs in many partitions are kept in few files.
PART_DOCS = 4_000
U64 = np.uint64
_rng = np.random.default_rng(20)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTES[65:91] = _BYTES[97:123]
_BASE, _STEPS = 0x9E3779B97F4A7C15, _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 17, 1 << (size - 1).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> U64(29))) * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(solid))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
        word = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        n = min(words, len(word))
        m = len(word) - n + 1
        out = np.full(m, n, np.uint64)
        for k in range(n):
            out += word[k : k + m] * _STEPS[k % 64] + U64(k)
    return np.unique(mixed(out))


def required(x: int, y: int, percent: int = PERCENT) -> int:
    """The overlap at which sets of these sizes link."""
    return -(-percent * (x + y) // (100 + percent))


def prefix_size(x: int, percent: int = PERCENT) -> int:
    return x - -(-percent * x // 100) + 1 if x else 0


def parity(tokens: np.ndarray, percent: int = PERCENT) -> bytes:
    """One bit for the parity of each class of tokens: two sets differ in at least as many tokens as bits."""
    width = max(256, 1 << int(4 * (len(tokens) * 2 - 2 * required(len(tokens), len(tokens), percent)) + 1).bit_length())
    return np.packbits(np.bincount((tokens >> U64(7)).astype(np.int64) & (width - 1), minlength=width).astype(np.uint8) & 1).tobytes()


class Order:
    """The global order of tokens: those not known as frequent by hash, then frequent ones, the most frequent last."""

    def __init__(self, frequent: list[int]):
        known = np.array(frequent, np.uint64)  # most frequent first
        self.tokens, self.ranks = np.sort(known), len(known) - np.argsort(known, kind="stable")

    def prefix(self, tokens: np.ndarray, size: int) -> np.ndarray:
        if not len(self.tokens):
            return tokens[:size]
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        rank = np.where(self.tokens[at] == tokens, self.ranks[at], 0)
        return tokens[np.argsort(rank, kind="stable")][:size]


@lru_cache(maxsize=1)
def _order(packed: bytes) -> Order:
    return Order(np.frombuffer(packed, np.uint64).tolist())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def frequent_tokens(docs: DataFrame, words: int) -> bytes:
    """Tokens of a sample by a hash, of a share that bounds it, most frequent first: at most FREQUENT of them reach the driver."""
    one_in = max(SAMPLE_OF, docs.count() // SAMPLE_DOCS)
    chosen = docs.where(F.pmod(F.xxhash64("row"), F.lit(one_in)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found)) if found else [], pa.int64())], names=["token"])

    counts = chosen.mapInArrow(worker(run), "token long").groupBy("token").count().where(F.col("count") >= SAMPLE_LEAST)
    rows = counts.orderBy(F.col("count").desc(), "token").limit(FREQUENT).select("token").collect()
    return np.array([r[0] for r in rows], np.int64).tobytes()


def nodes_of(docs: DataFrame, order: bytes, words: int, percent: int) -> DataFrame:
    """row, id, h, n, node and, where its task first meets a node (or again, after SEEN others), prefix and parity."""
    schema = "row long, id long, h long, n long, node long, prefix array<long>, parity binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                tokens = shingles(text.as_py(), words)
                n = len(tokens)
                if not n:
                    rows.append((0, None, None, None))
                    continue
                node = int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)
                if node in seen:
                    rows.append((n, node, None, None))
                else:
                    if len(seen) >= SEEN:  # a node may be posted again
                        seen.clear()
                    seen.add(node)
                    rows.append((n, node, signed(_order(order).prefix(tokens, prefix_size(n, percent))), parity(tokens, percent)))
            n, node, prefix, bits = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("h"), *arrays], names=["row", "id", "h", "n", "node", "prefix", "parity"])

    return docs.mapInArrow(worker(run), schema)


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """Indexes of the candidates that link with the query."""
    x = len(query)
    need = [required(x, len(c), percent) for c in candidates]
    least = min(need, default=0)
    joined = np.concatenate(candidates) if candidates else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(candidates)), [len(c) for c in candidates])
    at = np.searchsorted(query, joined)
    hit = (at < x) & (query[np.minimum(at, x - 1)] == joined)
    place, owner = at[hit], owner[hit]
    order = np.lexsort((owner, place))
    lists = [part.tolist() for part in np.split(owner[order], np.searchsorted(place[order], np.arange(1, x)))]
    lists.sort(key=len)
    n_long = max(0, min(least - 1, x))
    short, long = lists[: x - n_long], lists[x - n_long :][::-1]
    counts: dict[int, int] = {}
    for c in heapq.merge(*(s for s in short if s)):
        counts[c] = counts.get(c, 0) + 1
    found = []
    for c, count in counts.items():
        left = n_long
        for one in long:
            if count >= need[c] or count + left < need[c]:
                break
            k = bisect_left(one, c)
            count += k < len(one) and one[k] == c
            left -= 1
        if count >= need[c]:
            found.append(c)
    return sorted(found)


def linked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, percent: int, merge: bool, parts: int) -> DataFrame:
    """The pairs (a, b) that link, stored: each a's set against the sets of its b, in blocks. Every node's text is fetched once and its set sent where it is needed.

    parts: the most files of its tables. merge: whether the nodes asked for may be many, so that texts are joined by a shuffle; else Spark decides by the size of their table."""
    per = pairs.groupBy("a").agg(F.count("*").alias("_of"))
    salted = stored(pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("_of") / BLOCK_ROWS)).cast("long").alias("salt")), "shingle-blocks", parts)
    asked = salted.select(F.col("a").alias("node"), "a", "salt", F.lit(True).alias("query")).distinct()
    roles = asked.unionByName(salted.select(F.col("b").alias("node"), "a", "salt", F.lit(False).alias("query")))
    wanted = roles.groupBy("node").agg(F.collect_list(F.struct("a", "salt", "query")).alias("roles")).join(nodes.select("node", "row"), "node")
    wanted = stored(wanted.select("node", "row", "roles"), "shingle-wanted", parts)
    schema = "a long, salt long, query boolean, node long, tokens binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows = batch.slice(at, 64), []
                for node, text, roles in zip(part.column("node").to_pylist(), part.column("text"), part.column("roles").to_pylist(), strict=True):
                    packed = shingles(text.as_py(), words).tobytes()
                    if int.from_bytes(hashlib.blake2b(packed, digest_size=8).digest(), "little", signed=True) == node:  # ids may repeat with other texts
                        rows += [(r["a"], r["salt"], r["query"], node, packed) for r in roles]
                a, salt, query, node, packed = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(salt, pa.int64()), pa.array(query, pa.bool_()), pa.array(node, pa.int64()), pa.array(packed, pa.binary())], names=[x.split()[0] for x in schema.split(", ")])

    def search(block: pa.Table) -> pa.Table:
        role, ids, packed = block.column("query").to_pylist(), block.column("node").to_pylist(), block.column("tokens").to_pylist()
        found, a = [], block.column("a")[0].as_py()
        asker = next((k for k, q in enumerate(role) if q), None)
        if asker is not None:
            others = [k for k, q in enumerate(role) if not q]
            hits = divide_skip(np.frombuffer(packed[asker], np.uint64), [np.frombuffer(packed[k], np.uint64) for k in others], percent)
            found = [ids[others[k]] for k in hits]
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    joined = texts.join(wanted.hint("merge") if merge else wanted, "row").select("node", "text", "roles")
    found = stored(joined.mapInArrow(worker(sets), schema).groupBy("a", "salt").applyInArrow(search, "a long, b long"), "shingle-links", parts)
    discard(salted, wanted)
    return found


def apart(p: bytes, q: bytes) -> int:
    """Tokens in which two sets differ at least, from their parities."""
    if len(p) != len(q):
        p, q = sorted((p, q), key=len)
        q = np.bitwise_xor.reduce(np.frombuffer(q, np.uint8).reshape(-1, len(p))).tobytes()
    return (int.from_bytes(p, "little") ^ int.from_bytes(q, "little")).bit_count()


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that the parity bound doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, p, q = (batch.column(c).to_pylist() for c in ("n", "m", "p", "q"))
            keep = [apart(p, q) <= n + m - 2 * required(n, m, percent) for n, m, p, q in zip(x, y, p, q, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(nodes.select(F.col("node").alias("a"), "n", F.col("parity").alias("p")), "a")
    both = with_a.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("parity").alias("q")), "b")
    return both.mapInArrow(worker(run), "a long, b long")


def size_fits(x: Column, y: Column, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of one list and different components that pass the bounds. rows: token, block_a, block_b, block, node, n, pos, component, parity."""

    def pairs(col: dict[str, np.ndarray], bits: list[bytes], i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        n, pos = col["n"], col["pos"]
        total = n[i] + n[j]
        differ = total - 2 * (-(-percent * total // (100 + percent)))
        across = (col["block_a"][i] == col["block_b"][i]) | (col["block"][i] != col["block"][j])
        fit = (col["component"][i] != col["component"][j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & (pos[i] + pos[j] <= differ) & across
        out = []
        for x, y, d in zip(i[fit].tolist(), j[fit].tolist(), differ[fit].tolist(), strict=True):
            if apart(bits[x], bits[y]) <= d:
                out.append((x, y))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # A list may go on in the next batch: the last one of what is held waits.
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([whole.column(c).to_numpy() for c in ("token", "block_a", "block_b")])
            change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            if len(change):
                yield from searched(whole.slice(0, change[-1]))
                held = whole.slice(change[-1]).to_batches()
        if held:
            yield from searched(pa.Table.from_batches(held).combine_chunks())

    def searched(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        names = ("token", "block_a", "block_b", "block", "node", "n", "pos", "component")
        col = {c: whole.column(c).to_numpy() for c in names}
        bits = whole.column("parity").to_pylist()
        keys = np.stack([col[c] for c in names[:3]])
        starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [whole.num_rows]))
        run_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        node, ends = col["node"].tolist(), set()

        def made() -> pa.RecordBatch:
            a, b = zip(*ends, strict=True) if ends else ((), ())
            ends.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for shift in range(1, int(np.diff(starts).max(initial=0))):
            i = np.flatnonzero(run_of[:-shift] == run_of[shift:])
            if not len(i):
                break
            ends.update((min(node[x], node[y]), max(node[x], node[y])) for x, y in pairs(col, bits, i, i + shift))
            if len(ends) >= HELD:
                yield made()
        yield made()

    return rows.mapInArrow(worker(run), "a long, b long").distinct()


def _keyed(df: DataFrame, row_id: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(row_id).cast("long"), F.xxhash64(text)).alias("row"), F.xxhash64(text).alias("h")]


def labelled_rows(df: DataFrame, row_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """row, id, h, n, component of every row: component is a node key, null without shingles."""
    bound_batches(df.sparkSession)
    docs = df.select(*_keyed(df, row_id, text), F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    table = stored(nodes_of(docs, frequent_tokens(docs, words), words, percent), "shingle-nodes")
    parts = 1 + table.count() // PART_DOCS

    posted = table.where("prefix is not null").select("node", "n", F.posexplode("prefix").alias("pos", "token"))
    # Lists are told by an aggregate, stored, and a join, which can split the postings of one token; a window over them could not.
    cleanest = F.min(F.struct("pos", "node", "n")).alias("first")
    lists = stored(posted.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), cleanest).where("low != high").select("token", "first"), "shingle-tokens", parts)
    pivots = [F.col("first.node").alias("pivot"), F.col("first.n").alias("pivot_n"), F.col("first.pos").cast("long").alias("pivot_pos")]
    live = stored(posted.join(lists, "token").select("token", "node", "n", F.col("pos").cast("long").alias("pos"), *pivots), "shingle-lists", parts)
    discard(lists)
    texts = docs.select("row", "text")
    nodes = stored(table.where("prefix is not null").groupBy("node").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("parity").alias("parity")), "shingle-sets", parts)
    # Here a pair may be left out: lists that still hold several components are searched in full below.
    total = F.col("n") + F.col("pivot_n")
    within = F.col("pos") + F.col("pivot_pos") <= total - 2 * F.ceil(total * percent / (100 + percent))
    stars = live.where((F.col("node") != F.col("pivot")) & size_fits(F.col("n"), F.col("pivot_n"), percent) & within).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    stars = stored(plausible(stars.distinct(), nodes, percent), "shingle-stars", parts)
    first = linked(stars, texts, nodes, words, percent, True, parts)
    discard(stars)
    grown = components(first)

    labelled = stored(live.join(grown, "node", "left").withColumn("component", F.coalesce("component", "node")).select("token", "node", "n", "pos", "component").distinct(), "shingle-labelled", parts)
    discard(live)
    sizes = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    still = stored(sizes.where("low != high").select("token", "size"), "shingle-open", parts)
    open_lists = labelled.join(still, "token")
    blocks = F.ceil(F.col("size") / LIST_ROWS).cast("long")
    blocked = open_lists.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    blocked = blocked.withColumn("block_a", F.least("block", "with")).withColumn("block_b", F.greatest("block", "with")).join(nodes.select("node", "parity"), "node")
    dealt = blocked.repartition("token", "block_a", "block_b").sortWithinPartitions("token", "block_a", "block_b", "pos", "node")
    late = stored(cross_pairs(dealt.select("token", "block_a", "block_b", "block", "node", "n", "pos", "component", "parity"), percent), "shingle-pairs", parts)
    discard(labelled, still)
    last = linked(late, texts, nodes, words, percent, False, parts)
    final = components(first.unionByName(last))
    discard(late, nodes, first, last)

    return table.select("row", "id", "h", "n", "node").join(final, "node", "left").select("row", "id", "h", "n", F.coalesce("component", "node").alias("component"))


def join(df: DataFrame, row_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """row id, n_shingles, component_id of every row."""
    rows = stored(labelled_rows(df, row_id, text, words, percent), "shingle-rows")
    least = rows.where("component is not null").groupBy(F.col("component").alias("of")).agg(F.min("id").alias("least"))
    # Stored before it is joined: a join on its own exchanges can split a large component, one behind an aggregate cannot.
    named = rows.join(stored(least, "shingle-least"), F.col("component") == F.col("of"), "left")
    return named.select(F.col("id").alias(row_id), F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def representatives(df: DataFrame, row_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, the one of the smallest id, with all its columns; rows without shingles all stay."""
    rows = labelled_rows(df, row_id, text, words, percent)
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "row", "h")).alias("first")
    chosen = rows.where("component is not null").groupBy("component").agg(first).select(F.col("first.row").alias("_row"), F.col("first.h").alias("_h"))
    solid = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    row, h = unused(df, "_row", "_h")
    own = [c.alias(n) for c, n in zip(_keyed(df, row_id, text), (row, h), strict=True)]
    kept = df.where(solid).select("*", *own).join(chosen.withColumnsRenamed({"_row": row, "_h": h}), [row, h])
    # Of rows alike in id and text, the one of the least hash: repeats collapse before they are shuffled.
    whole = F.struct(*(F.col(c) for c in df.columns))
    once = kept.groupBy(row, h).agg(F.min_by(whole, F.xxhash64(whole)).alias("one")).select("one.*")
    return once.unionByName(df.where(~solid))


#: The same components in DuckDB SQL, over all pairs that share a shingle.
ORACLE = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i : i + {WORDS} - 1], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
tokens AS (SELECT doc_id, unnest(s) AS token FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
reach AS (SELECT doc_id AS node, doc_id AS least FROM sizes UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.node AND r.least < l.b)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, min(r.least) AS component_id FROM sizes s JOIN reach r ON r.node = s.doc_id GROUP BY 1, 2"""
