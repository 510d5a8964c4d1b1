"""The trie against one that is built turn by turn, with segments so short that conversations span several."""

import hashlib
import random
import zlib

import pytest

from tessera.llm import order, prefix_trie
from tessera.llm.prefix_trie import ends_digests, totals, trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(node))))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, more=()):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in more:
        df = df.selectExpr("*", f"7 AS `{name}`")
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie(df).collect()), key=str)


def conversations(seed, convs, turns, words):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", r.choice(words)) for c in range(-6, convs) for t in range(r.randint(1, turns))]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_trie(spark, monkeypatch, seed):
    monkeypatch.setattr(order, "SEGMENT", 3)
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    rows = conversations(seed, 30, 12, ["a", "bé", "", None])
    assert found(spark, rows) == plain(rows)


def test_ties_nulls_repeats_copies_and_missing_donors(spark):
    long = [(40, t, "user", f"x{t % 3}" * 50) for t in range(40)]
    rows = [(0, None, "user", "first"), (0, 1, "b", "y"), (0, 1, "b", "x"), (0, 1, None, None), (0, 1, "b", "x"), (None, 1, "user", "nobody")]
    rows += long + [(41, *t[1:]) for t in long] + [(45, *t[1:]) for t in long[:17]] + [(103, 1, "u", "only"), (207, 1, "u", "z"), (208, 2, "u", "z")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, ["owner", "Depth", "x", "parent", "conv", "ends_sha256"]) == plain(rows)


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "x")]) == []
    assert found(spark, [(5, 1, "u", "x")]) == plain([(5, 1, "u", "x")])


def test_totals_of_a_long_line_of_chains(spark):
    chains = spark.createDataFrame([(i, i - 1 if i else None, i + 1) for i in range(37)] + [(100, 5, 1000)], "conv long, parent long, n long")
    sums = {r.conv: r.n for r in totals(chains, ["n"]).collect()}
    assert sums == {100: 1000} | {i: sum(range(i + 1, 38)) + (1000 if i <= 5 else 0) for i in range(37)}


def test_ids_of_a_node_over_many_chunks(spark):
    ends = spark.range(25_000).selectExpr("1L AS owner", "id % 2 AS depth", "id AS conv").repartition(7)
    rows = {r.depth: r.ends_sha256 for r in ends_digests(ends).collect()}
    assert rows == {k: hashlib.sha256(",".join(map(str, range(k, 25_000, 2))).encode()).hexdigest() for k in (0, 1)}
