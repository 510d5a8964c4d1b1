"""The trie of conversation prefixes, without a task that holds a whole conversation or all that start alike.

Every distinct sequence of first turns is a node; the conversation of the smallest id that starts so owns it. A prefix's digest is the exclusive
or of a digest for each (depth, turn) in it, so that prefixes of a long conversation are added up segment by segment. Grouping the
digests gives each node's owner (the minimum of its ids) and members. Ownership is monotone: who owns a node owns all its deeper nodes on the same path.
So each conversation looks for its first owned depth by binary search, all of them in one join a round: their digests at the depths
asked for against the digest minima. The depths owned are one chain for each conversation, hung on the node of the last miss; the chains are the tree.

Sums over subtrees go bottom-up over chains: totals of a chain and its descendants by pointer doubling (as many rounds as the logarithm of the
tree's height in chains), then falling totals along each chain, segment by segment.

The ids of the conversations that end at a node are hashed as a stream of sorted ids: ranges make text chunks of them side by side, one
task a node hashes the chunks in order, one chunk at a time. One digest over one text can't be split further.

Cases: null turns come first, ties go by role, then text, equal rows are turns of their own; null role or text is empty; rows of a null conv_id are
left out; a conversation may come out without turns and is then a member of the root only; an empty table gives no rows, not even
a root; texts are hashed whole; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, stored
from .manifest import crc32_sql
from .order import SEGMENT, placed, running

#: Donors give the turns of every fifth conversation, of up to eight turns.
GROUP, SHARED = 5, 9


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes over."""
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv, depth, mark (digest of role and text), bytes of the rebuilt conversations, and conv at depth 0 for each of them.

    turns: conv_id, turn, role, text. Conversation c has the first h turns of conversation c - c % GROUP, then its own ones after its first h."""
    said = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    slim = said.select("*", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("mark"), F.octet_length("text").cast("long").alias("bytes"))
    own = stored(placed(slim, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["mark", "bytes"], "trie-order"), "trie-turns")

    h = shared_turns(F.col("conv"))
    convs = own.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", (F.col("conv") - F.col("conv") % GROUP).alias("base"), h.alias("h"))
    donors = own.where((F.col("conv") % GROUP == 0) & (F.col("place") < SHARED - 1)).select(F.col("conv").alias("base"), "place", "mark", "bytes")
    gives = donors.groupBy("base").agg(F.count("*").alias("gives"))
    plans = stored(convs.join(gives, "base", "left").select("conv", "n", "base", "h", F.least("h", F.coalesce("gives", F.lit(0))).alias("taken")), "trie-plans")
    taken = plans.join(donors, "base").where(F.col("place") < F.col("taken")).select("conv", (F.col("place") + 1).alias("depth"), "mark", "bytes")
    # One row of a plan for each segment of the conversation, so that a long one isn't one join key.
    dealt = plans.select(F.col("conv").alias("of"), "h", "taken", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SEGMENT))).alias("segment"))
    kept = own.join(dealt, (F.col("conv") == F.col("of")) & (F.floor(F.col("place") / SEGMENT) == F.col("segment"))).where(F.col("place") >= F.col("h"))
    after = kept.select("conv", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "mark", "bytes")
    start = plans.select("conv", F.lit(0).cast("long").alias("depth"), F.lit("").alias("mark"), F.lit(0).cast("long").alias("bytes"))
    return start.unionByName(taken).unionByName(after)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, bytes, x, y: the digest of each prefix in two halves. turns: conv, depth, mark, bytes, with depth 0."""
    half = lambda n: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(n), "depth", "mark"))
    terms = turns.select("conv", "depth", "bytes", half(1).alias("x"), half(2).alias("y"))
    return running(terms, "conv", "depth", ["x", "y"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def first_owned(paths: DataFrame, minima: DataFrame) -> DataFrame:
    """conv, last (its length), first (its first owned depth from 1 on; last + 1 if it owns none), parent (owner of the node before; null if that is the root).

    Each round asks, for all conversations still searching, who owns the node halfway."""
    lengths = paths.groupBy("conv").agg(F.max("depth").alias("last"))
    found = checkpointed(lengths.select("conv", "last", F.lit(1).cast("long").alias("low"), (F.col("last") + 1).alias("high"), F.lit(None).cast("long").alias("parent")))
    while found.where("low < high").limit(1).count():
        asked = found.where("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        probes = asked.join(paths.select("conv", "depth", "x", "y"), ["conv", "depth"])
        answers = probes.join(minima.select("depth", "x", "y", "owner"), ["depth", "x", "y"])
        mine = F.col("owner") == F.col("conv")
        moved = answers.select(
            "conv", "last",
            F.when(mine, F.col("low")).otherwise(F.col("depth") + 1).alias("low"),
            F.when(mine, F.col("depth")).otherwise(F.col("high")).alias("high"),
            F.when(mine, F.col("parent")).otherwise(F.col("owner")).alias("parent"),
        )
        found = checkpointed(found.where("low >= high").unionByName(moved))
    return found.select("conv", "last", F.col("low").alias("first"), "parent")


def totals(chains: DataFrame, values: list[str]) -> DataFrame:
    """conv and each value summed over the chain and all chains below it. chains: conv, parent (null at the top), values.

    After round r a chain holds the sums of what hangs less than 2^r chains below it, and points to the chain 2^r above."""
    state = checkpointed(chains.select("conv", F.col("parent").alias("up"), *values))
    while state.where("up is not null").limit(1).count():
        below = state.where("up is not null").groupBy(F.col("up").alias("conv")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        above = state.select(F.col("conv").alias("up"), F.col("up").alias("next"))
        moved = state.join(below, "conv", "left").select("conv", "up", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        # Chains that are done have no one to ask: as rows of a join they would all have one key.
        state = checkpointed(moved.where("up is null").unionByName(moved.join(above, "up").select("conv", F.col("next").alias("up"), *values)))
    return state.select("conv", *values)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted ids of nodes as comma-joined chunks."""
    for rows in batches:
        new = (rows["owner"] != rows["owner"].shift()) | (rows["depth"] != rows["depth"].shift())
        chunk = new.cumsum()
        yield rows.groupby(chunk, sort=False).agg(owner=("owner", "first"), depth=("depth", "first"), least=("conv", "first"), ids=("conv", lambda s: ",".join(map(str, s)))).reset_index(drop=True)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest for each node, over its chunks as they come."""
    node, digest = None, None
    for rows in batches:
        done = []
        for owner, depth, ids in zip(rows["owner"], rows["depth"], rows["ids"], strict=True):
            if (owner, depth) != node:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (owner, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pd.DataFrame(done, columns=["owner", "depth", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, digest.hexdigest())], columns=["owner", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256: the SHA-256 of each node's ids, ascending and joined by commas. ends: owner, depth, conv."""
    ranged = ends.repartitionByRange("owner", "depth", "conv").sortWithinPartitions("owner", "depth", "conv")
    chunks = ranged.mapInPandas(_chunks, "owner long, depth long, least long, ids string")
    ordered = chunks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "least")
    return ordered.mapInPandas(_hashed, "owner long, depth long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = stored(prefixes(rebuilt(turns)), "trie-prefixes")
    minima = stored(paths.groupBy("depth", "x", "y").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")), "trie-minima")
    top = F.lit(minima.where("depth = 0").agg(F.min("owner")).first()[0]).cast("long")
    root = F.col("conv") == top
    searched = stored(first_owned(paths, minima).select(
        "conv", "last", F.when(root, 0).otherwise(F.col("first")).alias("first"),
        F.when(~root, F.coalesce("parent", top)).alias("parent"),
    ), "trie-chains")
    chains = searched.where("first <= last")
    nodes = minima.select("owner", "depth", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))

    hung = chains.where("parent is not null").select(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth"), "conv")
    hung_at = hung.groupBy("owner", "depth").agg(F.lit(1).alias("hung"))
    tips = chains.join(hung_at.select(F.col("owner").alias("conv"), F.col("depth").alias("last"), "hung"), ["conv", "last"], "left").select("conv", "parent", F.when(F.col("hung").isNull(), 1).otherwise(0).cast("long").alias("leaves"))
    saved = nodes.groupBy(F.col("owner").alias("conv")).agg(F.sum("saved").alias("saved"))
    sums = totals(tips.join(saved, "conv"), ["leaves", "saved"])

    # Everything about a node in one pass: its own row, where its chain begins and ends, what hangs on it.
    facts = ["n_convs", "saved", "above", "is_first", "is_last", "hung", "leaves", "ends_sha256"]
    below = hung.join(sums, "conv").groupBy("owner", "depth").agg(F.count("*").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    begins = chains.select(F.col("conv").alias("owner"), F.col("first").alias("depth"), F.col("parent").alias("above"), F.lit(1).alias("is_first"))
    stops = chains.select(F.col("conv").alias("owner"), F.col("last").alias("depth"), F.lit(1).alias("is_last"))
    ends = searched.select(F.when(F.col("first") <= F.col("last"), F.col("conv")).otherwise(F.col("parent")).alias("owner"), F.col("last").alias("depth"), "conv")
    tagged = nodes
    for part in (begins, stops, below, ends_digests(ends)):
        tagged = tagged.unionByName(part, allowMissingColumns=True)
    one = {f: F.sum(f) if f in ("saved", "leaves") else F.max(f) for f in facts}
    gathered = tagged.groupBy("owner", "depth").agg(*[one[f].alias(f) for f in facts])
    zero = lambda c: F.coalesce(c, F.lit(0))
    tip = F.col("is_last").isNotNull() & F.col("hung").isNull()
    valued = gathered.select(
        "owner", "depth", "n_convs", "ends_sha256",
        F.when(F.col("is_first").isNotNull(), F.col("above")).otherwise(F.col("owner")).alias("parent"),
        (zero("hung") + F.when(F.col("is_last").isNull(), 1).otherwise(0)).alias("n_children"),
        (zero("leaves") + F.when(tip, 1).otherwise(0)).alias("n_leaves"), zero("saved").alias("saved_tokens"),
    )
    summed = running(stored(valued, "trie-nodes"), "owner", "depth", ["n_leaves", "saved_tokens"], F.sum, lambda a, b: a + b, falling=True)
    none = hashlib.sha256(b"").hexdigest()
    return summed.select(F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


#: The query's rows in DuckDB SQL: nodes are hashed whole prefixes, subtrees are joins of nodes with their owners' prefixes.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS j, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 5 AS base, {crc32_sql('c::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT c FROM turns)),
taken AS (SELECT i.c, t.j AS d, t.role, t.text FROM ids i JOIN turns t ON t.c = i.base AND t.j <= i.h),
after AS (
  SELECT t.c, t.j - i.h + coalesce(g.n, 0) AS d, t.role, t.text
  FROM turns t JOIN ids i USING (c) LEFT JOIN (SELECT c, count(*) AS n FROM taken GROUP BY c) g USING (c) WHERE t.j > i.h),
prefixes AS (
  SELECT c, 0 AS d, '' AS k, 0 AS bytes FROM ids
  UNION ALL
  SELECT c, d, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d)), octet_length(encode(text))
  FROM (FROM taken UNION ALL FROM after)),
nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved FROM prefixes GROUP BY d, k),
linked AS (
  SELECT n.*, up.conv_id AS parent_conv_id, up.d AS up_d, up.k AS up_k
  FROM nodes n LEFT JOIN prefixes p ON p.c = n.conv_id AND p.d = n.d - 1 LEFT JOIN nodes up ON up.d = p.d AND up.k = p.k),
children AS (SELECT up_d AS d, up_k AS k, count(*) AS n FROM linked WHERE up_d IS NOT NULL GROUP BY ALL),
subtrees AS (
  SELECT p.d, p.k, count(*) FILTER (ch.n IS NULL) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM nodes u JOIN prefixes p ON p.c = u.conv_id AND p.d <= u.d LEFT JOIN children ch ON ch.d = u.d AND ch.k = u.k GROUP BY p.d, p.k),
ends AS (
  SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
  FROM prefixes JOIN (SELECT c, max(d) AS d FROM prefixes GROUP BY c) USING (c, d) GROUP BY d, k)
SELECT conv_id, l.d::BIGINT AS depth, parent_conv_id, n_convs, coalesce(ch.n, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM linked l JOIN subtrees s USING (d, k) LEFT JOIN children ch USING (d, k) LEFT JOIN ends e USING (d, k)"""
