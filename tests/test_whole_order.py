"""Queues and rankings have every row."""

from tessera.plans import registry

QUERIES = registry.queries()


def test_queue_and_ranking_are_whole(spark, sf_dir):
    orders, parts = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "part"))
    places = sorted(r.place for r in QUERIES["o03_review_order"](spark, sf_dir).collect())
    assert orders > 200 and places == list(range(1, orders + 1))
    assert QUERIES["o05_gap_ranking"](spark, sf_dir).count() == parts
