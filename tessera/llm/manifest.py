"""Merkle manifest of a dataset: a tree of digests for each group of rows, one tree over the groups' roots, and a proof for each row.

Rows are leaves in the order of their ids. Executors reduce blocks of FANOUT ** BLOCK_LEVELS leaves to one node each, block nodes
to nodes of larger blocks, until at most TOP_NODES are left; the driver builds the rest of the tree and broadcasts the path of each
of these nodes, from its run to the root: at most TOP_NODES paths of some 500 bytes a level. Executors then go down again: every
block is rebuilt, its path hung on, and each row's proof is gathered and folded. Where no more than TOP_NODES blocks exist, that is one
reduction and one descent; where there are more, the blocks between get their paths by a join of one row a block.

No group is in one task: a hot group is as many blocks as it needs. Leaves are slim (an id and two digests); the rows' texts are hashed
where they are read and never moved.

Cases: a null field is `-` in the leaf, so it differs from an empty one; rows of the null group come first, as do null ids; rows of one
id go by their leaves, equal rows are leaves side by side; a group of one row has its leaf as root, a table of one row too, with an empty
proof; an empty table gives no rows; very long texts are hashed whole; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .order import placed

FANOUT = 8
#: Levels that one block's reduction climbs: 4,096 leaves a block.
BLOCK_LEVELS = 4
#: The most nodes that the driver builds on, and whose paths are broadcast (about 10 MB).
TOP_NODES = 4096
#: The tree over the groups' roots, where executors have to reduce that too. Names of groups begin with "=", or are empty for null.
ROOTS = "#"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as byte count, colon and value; `-` if null."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*each), 256)


class Tree:
    """The levels over some neighbouring nodes: `steps` of them, or up to a single node."""

    def __init__(self, digests: list[str], steps: int | None):
        self.levels, self.runs = [digests], []
        while len(self.runs) < steps if steps is not None else len(self.levels[-1]) > 1:
            level = self.levels[-1]
            self.runs.append(["".join(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)])
            self.levels.append([_hash(run) for run in self.runs[-1]])

    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, i: int) -> list[tuple[str, str]]:
        """For each level what stands left and right of node i's ancestor in its run."""
        out = []
        for runs in self.runs:
            run, at = runs[i // FANOUT], i % FANOUT * 64
            out.append((run[:at], run[at + 64 :]))
            i //= FANOUT
        return out


def fold(digest: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that a digest and the siblings on its path give."""
    for left, right in path:
        digest = _hash(left + digest + right)
    return digest


def write_path(path: list[tuple[str, str]]) -> str:
    return ",".join(f"{left}.{right}" for left, right in path)


def read_path(text: str) -> list[tuple[str, str]]:
    return [tuple(level.split(".")) for level in text.split(",")] if text else []


def _steps(n: int, levels: int) -> int | None:
    """A tree that is one block is climbed to its root, any other by the levels of a block."""
    return levels if n > FANOUT**levels else None


def reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, place, n, digest of the nodes that the blocks reduce to. nodes: the same columns; n is how many nodes the tree has on that level."""
    block = FANOUT**levels

    def reduce(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        n, place = rows["n"][0].as_py(), rows["place"][0].as_py()
        top = Tree([d.hex() for d in rows["digest"].to_pylist()], _steps(n, levels)).top()
        return pa.table({"tree": rows["tree"][:1], "place": pa.array([place // block], pa.int64()), "n": pa.array([-(-n // block)], pa.int64()), "digest": pa.array([bytes.fromhex(top)], pa.binary())})

    blocks = nodes.withColumn("block", F.floor(F.col("place") / block))
    return blocks.groupBy("tree", "block").applyInArrow(reduce, "tree string, place long, n long, digest binary")


def built(rows: list) -> tuple[dict[tuple[str, int], str], str]:
    """The driver's part: the paths of the top nodes to the root, as (path in the group's tree)/(path over the roots), and the root."""
    trees: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["tree"].encode(), r["place"])):
        trees.setdefault(r["tree"], []).append(r["digest"].hex())
    own = {name: Tree(digests, None) for name, digests in trees.items()}
    if ROOTS in own:
        return {(ROOTS, i): "/" + write_path(own[ROOTS].path(i)) for i in range(len(trees[ROOTS]))}, own[ROOTS].top()
    over = Tree([t.top() for t in own.values()], None)
    paths = {(name, i): write_path(own[name].path(i)) + "/" + write_path(over.path(k)) for k, name in enumerate(trees) for i in range(len(trees[name]))}
    return paths, over.top()


def _joined(inside: list[tuple[str, str]], path: str, in_roots: bool) -> str:
    """A path within a block with the block's own behind it."""
    group, roots = path.split("/")
    text = write_path(inside)
    return f"/{','.join(x for x in (text, roots) if x)}" if in_roots else f"{','.join(x for x in (text, group) if x)}/{roots}"


def descended(nodes: DataFrame, paths: dict | DataFrame, levels: int, finish, schema: str) -> DataFrame:
    """finish(rows of a block in order, their tree, the block's path) for every block. paths: a broadcast of the driver's, or a frame of tree, block, path."""
    block = FANOUT**levels
    blocks = nodes.withColumn("block", F.floor(F.col("place") / block))

    def finished(rows: pa.Table, path: str) -> pa.Table:
        rows = rows.sort_by("place")
        tree = Tree([d.hex() for d in rows["digest"].to_pylist()], _steps(rows["n"][0].as_py(), levels))
        return finish(rows, tree, path)

    if not isinstance(paths, DataFrame):
        sent = nodes.sparkSession.sparkContext.broadcast(paths)
        return blocks.groupBy("tree", "block").applyInArrow(lambda key, rows: finished(rows, sent.value[key[0].as_py(), key[1].as_py()]), schema)
    return blocks.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(lambda rows, path: finished(rows, path["path"][0].as_py()), schema)


def _paths_of(rows: pa.Table, tree: Tree, path: str) -> pa.Table:
    """tree, block, path for the nodes of a block of upper nodes; own and own_place tell which block below each of them is."""
    in_roots = rows["tree"][0].as_py() == ROOTS
    return pa.table({"tree": rows["own"], "block": rows["own_place"], "path": pa.array([_joined(tree.path(i), path, in_roots) for i in range(rows.num_rows)], pa.string())})


def prove(leaves: DataFrame, group: str, id: str, digest: str, claimed: str, levels: int = BLOCK_LEVELS, top_nodes: int = TOP_NODES) -> DataFrame:
    """id, leaf, subroot, root, place (in its group), proof, folded_root, verified for each row.

    leaves: a group's name, an id, the digest of the row as it was (hex) and that of the row as it is claimed to be. proof: the 32-byte digests of the
    siblings on the way up, level by level from left to right. folded_root: what the claimed digest and the proof give; verified: whether it is the root."""
    spark, kind = leaves.sparkSession, leaves.schema[id].dataType
    named = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(id).alias("id"), F.unhex(digest).alias("digest"), F.unhex(claimed).alias("claimed"))
    ordered = placed(stored(named, "manifest-leaves"), "tree", [F.col("id").asc_nulls_first(), F.col("digest")], ["id", "digest", "claimed"], "manifest-order")
    sizes = ordered.groupBy(F.col("tree").alias("of")).agg(F.count("*").alias("n"))
    bottom = stored(ordered.join(sizes, F.col("tree") == F.col("of")).drop("of"), "manifest-placed")

    floors, here = [], bottom
    while True:
        up = stored(reduced(here.select("tree", "place", "n", "digest"), levels), "manifest-nodes")
        if up.count() <= top_nodes:
            break
        if not up.where("n > 1").limit(1).count():
            roots = placed(up.select(F.lit(ROOTS).alias("all"), F.col("tree").alias("own"), "digest"), "all", [F.col("own")], ["own", "digest"], "manifest-roots")
            up = stored(roots.select(F.lit(ROOTS).alias("tree"), "place", F.lit(up.count()).alias("n"), "digest", "own", F.lit(0).cast("long").alias("own_place")), "manifest-nodes")
        floors.append(up)
        here = up
    paths, root = built(up.collect()) if up.limit(1).count() else ({}, "")

    for floor in reversed(floors):
        own = floor if "own" in floor.columns else floor.select("*", F.col("tree").alias("own"), F.col("place").alias("own_place"))
        paths = stored(descended(own, paths, levels, _paths_of, "tree string, block long, path string"), "manifest-paths")

    def proofs(rows: pa.Table, tree: Tree, path: str) -> pa.Table:
        group_path, roots_path = map(read_path, path.split("/"))
        subroot = fold(tree.top(), group_path)
        above = bytes.fromhex("".join(left + right for left, right in [*group_path, *roots_path]))
        proof, folded = [], []
        for i, now in enumerate(rows["claimed"].to_pylist()):
            inside = tree.path(i)
            proof.append(bytes.fromhex("".join(left + right for left, right in inside)) + above)
            folded.append(fold(now.hex(), [*inside, *group_path, *roots_path]))
        n = rows.num_rows
        return pa.table({
            "id": rows["id"], "leaf": pa.array(tree.levels[0], pa.string()), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "place": rows["place"], "proof": pa.array(proof, pa.binary()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_()),
        })

    schema = f"id {kind.simpleString()}, leaf string, subroot string, root string, place long, proof binary, folded_root string, verified boolean"
    return descended(bottom, paths, levels, proofs, schema).withColumnRenamed("id", id)


def crc32_sql(x: str) -> str:
    """Unsigned CRC-32 of an ASCII text in DuckDB SQL."""
    eight_bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {eight_bits}), 4294967295)"


def _field_sql(x: str) -> str:
    return f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"


_LEAF_SQL = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))

#: The query's rows in DuckDB SQL: level by level up, then the paths down each row's ancestors, then the folds.
ORACLE = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_LEAF_SQL} || {_field_sql('text')}) AS leaf,
         CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN sha256({_LEAF_SQL} || {_field_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows_),
nodes AS (
  SELECT tree, 0 AS lvl, place, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, lvl, place, sha256(run), n FROM (
    SELECT tree, lvl + 1 AS lvl, place // 8 AS place, string_agg(h, '' ORDER BY place) AS run, (any_value(n) + 7) // 8 AS n
    FROM nodes WHERE n > 1 GROUP BY tree, lvl, place // 8)),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM nodes WHERE n = 1),
over_ AS (
  SELECT 0 AS lvl, place, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl, place, sha256(run), n FROM (
    SELECT lvl + 1 AS lvl, place // 8 AS place, string_agg(h, '' ORDER BY place) AS run, (any_value(n) + 7) // 8 AS n FROM over_ WHERE n > 1 GROUP BY lvl, place // 8)),
runs AS (
  SELECT tree, lvl, place // 8 AS run, string_agg(h, '' ORDER BY place) AS digests FROM nodes WHERE n > 1 GROUP BY tree, lvl, place // 8
  UNION ALL
  SELECT '#', lvl, place // 8, string_agg(h, '' ORDER BY place) FROM over_ WHERE n > 1 GROUP BY lvl, place // 8),
depths AS (SELECT tree, max(lvl) AS top FROM nodes GROUP BY tree),
steps AS (
  SELECT l.tree, l.place AS leaf_place, k AS step, CASE WHEN k < d.top THEN l.tree ELSE '#' END AS of_tree, CASE WHEN k < d.top THEN k ELSE k - d.top END AS lvl,
         (CASE WHEN k < d.top THEN l.place ELSE s.place END) // (8 ** (CASE WHEN k < d.top THEN k ELSE k - d.top END))::BIGINT AS node
  FROM leaves l JOIN depths d USING (tree) JOIN subroots s USING (tree), range(0, 64) r(k)
  WHERE k < d.top + (SELECT max(lvl) FROM over_)),
sides AS (
  SELECT p.tree, leaf_place, step, substr(digests, 1, 64 * (node % 8)) AS lft, substr(digests, 64 * (node % 8 + 1) + 1) AS rgt
  FROM steps p JOIN runs r ON r.tree = p.of_tree AND r.lvl = p.lvl AND r.run = p.node // 8),
folds AS (
  SELECT tree, place AS leaf_place, 0 AS step, coalesce(changed, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.tree, f.leaf_place, f.step + 1, sha256(lft || f.h || rgt) FROM folds f JOIN sides s ON s.tree = f.tree AND s.leaf_place = f.leaf_place AND s.step = f.step),
folded AS (SELECT tree, leaf_place, arg_max(h, step) AS h FROM folds GROUP BY ALL),
proofs AS (SELECT tree, leaf_place, string_agg(lft || rgt, '' ORDER BY step) AS siblings FROM sides GROUP BY ALL),
top_ AS (SELECT h FROM over_ WHERE n = 1)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM top_) AS root, sha256(coalesce(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = (SELECT h FROM top_) AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN folded f ON f.tree = l.tree AND f.leaf_place = l.place LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_place = l.place"""
