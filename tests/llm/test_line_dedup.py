"""Line dedup against a plain version, with streams cut at every place."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm.line_dedup import GOES, OPEN, SEEN, deduped, kept_text, line_key, streamed

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least_length=40, least_docs=5):
    """(doc_id, text) -> lines, dropped, kept text for each."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    rank = lambda d: (d is not None, d or 0)
    docs = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length:
                docs.setdefault(key(line), set()).add(rank(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(docs.get(key(x), ())) < least_docs or rank(doc) == max(docs[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(spark, rows, more=(), **bounds):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in more:
        df = df.withColumn(name, F.lit(1))
    out = deduped(df, **bounds)
    assert [c.lower() for c in out.columns[-3:]] == ["n_lines", "n_dropped", "keep"]
    return sorted(((r[0], r[1], r[2], r[3]) for r in out.select("doc_id", "n_lines", "n_dropped", kept_text(F.col("text"), F.col("keep"))).collect()), key=str)


LONG = "A line that many documents share, and that is long"


def test_nulls_repeats_ties_and_long_texts(spark):
    rows = [(k, f"own words of {k}\n {LONG}\t\n{LONG.upper()}\nend\n") for k in range(6)]
    rows += [(6, LONG), (6, LONG), (6, f"other text\n{LONG}"), (None, LONG), (None, None), (7, None), (8, ""), (9, "\n\n"), (10, "É" * 39 + "\n" + "É" * 40)]
    rows += [(k, "É" * 40 + "\r\nx") for k in range(20, 24)] + [(30 + k, "short\nshort") for k in range(9)] + [(50, f"{LONG}\n" * 5000 + "tail"), (51, "z" * 50 + "\n" + "z" * 50)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, ["N_Dropped", "keep", "_doc", "_of_doc", "known", "k1", "kind"]) == plain(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_version(spark, seed):
    r = random.Random(seed)
    words = [f"{'the same line again ' * 2}{k}" for k in range(12)]
    rows = [(r.choice([d, d, None, 3]), "\n".join(r.choice(words[: r.choice([1, 3, 12])]) for _ in range(r.randint(0, 9)))) for d in range(80)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, least_docs=2) == plain(rows, least_docs=2)


def test_a_line_of_most_documents_is_dealt_over_ranges(spark):
    rows = [(d, f"{LONG}\nonly {d} has this line, and it is long enough too") for d in range(4000)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_streams_of_any_batch_size(size):
    """A whole stream in one range, cut into batches: what goes, and what its first and last run leave open."""
    r = random.Random(size)
    rows = sorted([(r.randrange(9), 0, 1, -r.randrange(12), 0, 0, 1, p) for p in range(400)])
    frame = pd.DataFrame(rows, columns=["k1", "k2", "known", "doc", "mark", "mark2", "lines", "pos"]).assign(doc=lambda f: -f["doc"])
    batches = [frame.iloc[i : i + size] for i in range(0, len(frame), size)]
    out = pd.concat(list(streamed(iter(batches), 5)))
    goes = set(out[out["kind"] == GOES]["pos"])
    opened = out[out["kind"] == OPEN]
    owners, docs = frame.groupby("k1")["doc"].max(), frame.groupby("k1")["doc"].nunique()
    first, last = frame["k1"].min(), frame["k1"].max()
    expected = {p for k, d, p in zip(frame["k1"], frame["doc"], frame["pos"], strict=True) if k != first and docs[k] >= 5 and d != owners[k]}
    assert goes == expected
    assert set(opened["pos"]) >= set(frame[frame["k1"] == first]["pos"])
    seen = out[out["kind"] == SEEN]
    assert set(seen["k1"]) <= {last} and (seen["doc"].nunique() == 5 if docs[last] >= 5 else seen.empty)
    assert np.isin(opened["k1"], [first, last]).all()


def test_keys(spark):
    df = spark.createDataFrame([("\x0b\t ABÇé \r\x0c",), (" x ",)], "line string")
    assert [r[0] for r in df.select(line_key(F.col("line"))).collect()] == ["abÇé", " x "]
