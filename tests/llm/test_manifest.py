"""The manifest against a plain tree, with blocks and top trees so small that every round is taken."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import registry
from tessera.llm.manifest import Tree, fold, leaf, prove


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*fields):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def plain_path(nodes, i):
    """Siblings of node i level by level, and the root."""
    path = []
    while len(nodes) > 1:
        runs = [nodes[k : k + 8] for k in range(0, len(nodes), 8)]
        path.append((runs[i // 8][: i % 8], runs[i // 8][i % 8 + 1 :]))
        nodes, i = [digest("".join(r)) for r in runs], i // 8
    return path, nodes[0]


def plain_rows(rows):
    """(group, id, leaf, claimed) -> what prove() gives, as a sorted list."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    subroots = [plain_path([r[2] for r in own], 0)[1] for own in groups.values()]
    out = []
    for k, own in enumerate(groups.values()):
        over, root = plain_path(subroots, k)
        for i, (_, id, was, now) in enumerate(own):
            path = plain_path([r[2] for r in own], i)[0] + over
            for left, right in path:
                now = digest("".join([*left, now, *right]))
            siblings = "".join(x for left, right in path for x in left + right)
            out.append((str(id), was, subroots[k], root, i, siblings, now, now == root))
    return sorted(out)


def found(spark, rows, **bounds):
    df = spark.createDataFrame(rows, "lang string, doc_id long, was string, now string").repartition(3)
    proofs = prove(df, "lang", "doc_id", "was", "now", **bounds)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.place, r.proof.hex(), r.folded_root, r.verified) for r in proofs.collect())


@pytest.mark.parametrize("bounds", [{}, {"levels": 1, "top_nodes": 12}, {"levels": 1, "top_nodes": 2}, {"levels": 2, "top_nodes": 3}])
def test_equals_a_plain_tree(spark, bounds):
    rows = [("a", i, digest(f"a{i}"), digest(f"a{i}")) for i in range(150)] + [(None, i, digest(f"n{i}"), digest("other") if i % 2 else digest(f"n{i}")) for i in range(9)]
    rows += [("b", None, digest("x"), digest("x"))] * 3 + [("b", 5, digest("y"), digest("y")), ("", 1, digest("z"), digest("z"))]
    rows += [(f"l{k}", k, digest(f"l{k}"), digest("no") if k % 3 == 0 else digest(f"l{k}")) for k in range(20)]
    assert found(spark, rows, **bounds) == plain_rows(rows)


def test_one_row_and_none(spark):
    assert found(spark, [("a", 1, digest("a"), digest("a"))]) == [("1", digest("a"), digest("a"), digest("a"), 0, "", digest("a"), True)]
    assert found(spark, []) == []


def test_equal_rows_beyond_a_block(spark):
    rows = [("a", 1, digest("same"), digest("same"))] * 70 + [("a", 2, digest("b"), digest("c"))]
    assert found(spark, rows, levels=1, top_nodes=2) == plain_rows(rows)


def test_leaves_of_nulls_long_texts_and_clashing_columns(spark):
    rows = [(1, "s", None, 3, "é\n"), (None, None, "en", None, None), (2, "", "", 0, "x" * 100_000), (3, "a1:b", "c", 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    assert [r[0] for r in df.select(leaf(columns)).collect()] == [plain_leaf(*r) for r in rows]
    clashing = df.select(leaf(columns).alias("leaf"), "lang", "doc_id", F.lit(1).alias("tree"), F.lit(2).alias("place"), F.lit(3).alias("Digest"), F.lit(4).alias("_at"))
    assert prove(clashing, "lang", "doc_id", "leaf", "leaf").where("verified").count() == 4


def test_tampered_rows_of_the_query(spark, sf_dir):
    rows = registry.queries()["op11_manifest"](spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        d = docs[r.doc_id]
        assert r.leaf == plain_leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text)
        changed = zlib.crc32(str(d.doc_id).encode()) % 3 == 0 and d.text is not None and any("A" <= c <= "Z" for c in d.text)
        assert r.verified == (not changed) == (r.folded_root == r.root)


def test_paths_lead_to_the_root():
    tree = Tree([digest(str(i)) for i in range(77)], None)
    assert {fold(digest(str(i)), tree.path(i)) for i in range(77)} == {tree.top()}
