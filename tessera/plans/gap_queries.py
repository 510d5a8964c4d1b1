"""Queries for records without candidates and for late evidence: filters before the ranking and before the merge, and the merge as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import analytics as A
from tessera.operators import classify as C
from tessera.operators import evidence as R
from tessera.operators import gaps as G
from tessera.sources.scratch import scratch
from tessera.streaming import incremental
from tessera.streaming.keyed_table import KeyedTable

from .base import CITATIONS_SQL, citations, query, table, with_inputs
from .evidence_queries import MERGED_SQL, PRIORITY_SQL, STATUS_SQL, UPSERT_SQL, merged_registry
from .text_queries import DOI_SQL, fold_sql, words_sql

#: The citations with long mixed blocks, boilerplate, texts that a record has several times, and names: rows on both sides of every filter.
GAP_REFS_SQL = """SELECT ref_id, record_id, pdf_type, CASE WHEN ref_id % 16 = 3 THEN repeat(reference_text || ', further reading; ', 12) WHEN ref_id % 16 = 15 THEN 'Press of ' || title || ', Physical Review 12 (1950)'
    WHEN ref_id % 32 = 17 THEN 'Meyer K. et al. On rays in many rooms. Nature 12:345 (19' || (10 + record_id % 80) || ')' ELSE reference_text END AS reference_text FROM {refs}"""
GAP_QUEUE_SQL = "SELECT p_partkey % 97 AS record_id, (1930 + p_partkey % 97 % 80)::INT AS award_year, min(p_name) AS motivation, 'Anna ' || max(p_name) AS full_name FROM part WHERE p_partkey % 97 % 3 > 0 GROUP BY p_partkey % 97"


def gap_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GAP_REFS_SQL, refs=citations(spark, sf_dir))


def gap_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.col("p_partkey") % 97
    rows = table(spark, sf_dir, "part").where(record % 3 > 0).groupBy(record.alias("record_id")).agg(F.min("p_name").alias("motivation"), F.concat(F.lit("Anna "), F.max("p_name")).alias("full_name"))
    return rows.withColumn("award_year", (1930 + F.col("record_id") % 80).cast("int"))


AGGREGATE_SQL = " + ".join(f"contains(lower(plain), '{h}')::INT" for h in C.AGGREGATE_HINTS)
BOILERPLATE_SQL = f"(f = '' OR contains(f, 'delivered in stockholm') OR contains(f, 'nobel lecture entitled') OR ({' + '.join(f"contains(f, '{b}')::INT" for b in C.BOILERPLATE)}) >= 2)"
GAP_CLASSES_SQL = rf"""SELECT ref_id, record_id, pdf_type, reference_text, doi, CASE WHEN doi <> '' THEN 'doi_present' WHEN (length(plain) > 800 AND ({AGGREGATE_SQL}) >= 2) OR (length(plain) > 1800 AND len(ys) >= 8) THEN 'aggregate_further_reading'
    WHEN book AND NOT journal THEN 'book_or_chapter' WHEN journal AND len(ys) > 0 AND ys[1] < 1945 THEN 'historical_nonindexed_reference' WHEN journal AND len(ys) > 0 THEN 'likely_journal_article' ELSE 'needs_manual_review' END AS reference_class FROM (
  SELECT *, lower(rtrim({DOI_SQL.replace('reference_text', 'plain')}, '.,;:)')) AS doi, list_sort(list_distinct(list_transform(regexp_extract_all(plain, '\b(?:18|19|20)\d{{2}}\b'), lambda y: y::INT))) AS ys,
    regexp_matches(plain, '{C.BOOK_HINT}') AS book, regexp_matches(plain, '{C.JOURNAL_HINT}') OR regexp_matches(plain, '\b\d{{1,4}}\s*[:;,]\s*[A-Z]?\d{{1,5}}\b') AS journal
  FROM (SELECT *, regexp_replace(trim(regexp_replace(reference_text, '\s+', ' ', 'g')), '\s+\d{{1,3}}\s*\(\d{{1,3}}\)\s*$', '') AS plain FROM gap_refs))"""


def gap_ranking_sql() -> str:
    """The whole path in DuckDB SQL: classes, filters, first of equal texts, scores, places."""
    return with_inputs(rf"""SELECT record_id, ref_id, reference_class, name AS name_in_reference, score, CASE WHEN score >= 22 THEN 'A_high_priority_official_gap_candidate' WHEN score >= 14 THEN 'B_reviewable_official_gap_candidate' WHEN score >= 7 THEN 'C_low_signal_official_gap_candidate'
    ELSE 'D_hold_for_manual_triage' END AS gap_tier, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, ref_id) AS place FROM (
      SELECT *, (CASE reference_class WHEN 'doi_present' THEN 8 WHEN 'likely_journal_article' THEN 6 WHEN 'historical_nonindexed_reference' THEN 5 ELSE 2 END + CASE WHEN pdf_type = 'scientific_background' THEN 4 WHEN contains(pdf_type, 'lecture') THEN 2 ELSE 0 END
        + CASE WHEN cy IS NULL THEN 0 WHEN cy > award_year THEN -5 WHEN award_year - cy <= 5 THEN 7 WHEN award_year - cy <= 25 THEN 6 ELSE 5 END + least(overlap, 6) * 2 + CASE WHEN name THEN 3 ELSE 0 END + CASE WHEN doi <> '' THEN 3 ELSE 0 END)::INT AS score FROM (
          SELECT *, coalesce(list_max(list_filter(ys, lambda y: y <= award_year)), list_min(ys)) AS cy, len(list_intersect(rt, {words_sql(fold_sql('motivation'), 4, X.GAP_STOP, True)})) AS overlap, list_contains(rt, {words_sql(fold_sql('full_name'), 4, X.GAP_STOP, True)}[-1]) AS name FROM (
            SELECT *, list_distinct({words_sql('f', 4, X.GAP_STOP, True)}) AS rt, list_filter(list_transform(regexp_extract_all(reference_text, '\b(?:18[0-9]{{2}}|19[0-9]{{2}}|20[0-2][0-9])\b'), lambda y: y::INT), lambda y: y <= 2026) AS ys,
              row_number() OVER (PARTITION BY record_id, substr(f, 1, 240) ORDER BY ref_id) AS nth
            FROM (SELECT *, {fold_sql('reference_text')} AS f FROM classes) WHERE reference_class IN ({', '.join(f"'{c}'" for c in C.USABLE_CLASSES)}) AND record_id IN (SELECT record_id FROM queue) AND NOT {BOILERPLATE_SQL}) JOIN queue USING (record_id) WHERE nth = 1))""",
        gap_refs=GAP_REFS_SQL.format(refs=f"({CITATIONS_SQL})"), queue=GAP_QUEUE_SQL, classes=GAP_CLASSES_SQL)


@query(gap_ranking_sql())
def f03_usable_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-03, F-04, J-04, S-04, R-14, O-05: references of queued records that may be candidates, scored with the award's year and the name, and ranked inside their record."""
    rows = G.ranked_gap_candidates(gap_references(spark, sf_dir), gap_queue(spark, sf_dir), "record_id", "ref_id")
    return rows.select("record_id", "ref_id", "reference_class", "name_in_reference", "score", "gap_tier", "place")


@query(with_inputs("SELECT ref_id, reference_class FROM classes", gap_refs=GAP_REFS_SQL.format(refs=f"({CITATIONS_SQL})"), classes=GAP_CLASSES_SQL))
def r01_mixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-01: classes of references, long blocks of several resources among them."""
    return gap_references(spark, sf_dir).select("ref_id", C.reference_class(F.col("reference_text"))[0])


GRADED_SQL = """SELECT l_suppkey AS record, 'w' || (l_partkey % 60) AS work, min(l_orderkey) AS at_row, CASE min(l_orderkey) % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'A' WHEN 2 THEN 'C' ELSE 'B' END AS confidence,
    CASE min(l_orderkey) % 4 WHEN 0 THEN 'metadata_matched_needs_official_alignment' WHEN 1 THEN 'metadata_candidate_needs_review' WHEN 2 THEN 'no_match' END AS review_status FROM {lineitem} GROUP BY l_suppkey, l_partkey % 60"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(GRADED_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    return rows.select("record", "work", "at_row", F.lit("late").alias("title"), F.array(F.lit("gap")).alias("source"), F.col("confidence").alias("metadata_match_confidence"), "review_status")


@query(f"""SELECT coalesce(o.record, n.record) AS record, coalesce(o.work, n.work) AS work, array_to_string(list_concat(coalesce(o.sources, []), CASE WHEN n.record IS NOT NULL THEN ['gap'] ELSE [] END), ' || ') AS sources,
    CASE WHEN o.record IS NULL OR (o.grade = 'D' AND n.confidence IS NOT NULL) THEN n.confidence ELSE o.grade END AS confidence, CASE WHEN o.record IS NULL OR n.p < o.priority THEN n.p ELSE o.priority END AS review_priority
  FROM (SELECT *, {PRIORITY_SQL} AS priority, CASE WHEN official OR dataset_matched THEN 'A' ELSE 'D' END AS grade FROM ({MERGED_SQL})) o
  FULL JOIN (SELECT *, CASE WHEN review_status = 'metadata_matched_needs_official_alignment' THEN 'P1' ELSE 'P2' END AS p FROM ({GRADED_SQL.format(lineitem='lineitem')})
    WHERE confidence <> 'D' AND review_status IN ('metadata_matched_needs_official_alignment', 'metadata_candidate_needs_review')) n ON o.record = n.record AND o.work = n.work""")
def f07_merge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-07, J-09: late matches of grade D or of another status stay out of the registry, the others are merged into it."""
    late = R.mergeable(graded(spark, sf_dir)).select("*", *C.gap_status(F.col("review_status")))
    rows = R.upsert(merged_registry(spark, sf_dir), late, ["record", "work"], "at_row", ["title"], ["source"])
    return rows.select("record", "work", F.array_join("source", R.SEPARATOR).alias("sources"), F.col("metadata_match_confidence").alias("confidence"), "review_priority")


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The late evidence of j09_upsert, as it would arrive."""
    from .evidence_queries import LATE_SQL

    late = spark.sql(LATE_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    return late.select("record", "work", "at_row", F.lit("late").alias("title"), F.array("source").alias("source"), F.lit("B").alias("metadata_match_confidence"), *C.gap_status(F.col("review_status")))


@query(UPSERT_SQL)
def j09_incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-09, SNK-05: the same registry, kept in key buckets; late evidence arrives in two parts and is merged by a stream, of which one run comes twice."""
    registry = merged_registry(spark, sf_dir).select("record", "work", "title", "source", "metadata_match_confidence", "review_priority", "registry_status", "analysis_readiness")
    kept = KeyedTable(spark, scratch(spark, "registry"), registry.schema, ["record", "work"])
    kept.merge(registry, lambda old, new: new)
    merge = lambda old, new: R.upsert(old, new, ["record", "work"], "at_row", ["title"], ["source"])
    late, arrivals, done = late_rows(spark, sf_dir), scratch(spark, "late"), scratch(spark, "late-progress")
    for part in (0, 1):
        late.where(F.pmod(F.xxhash64("record"), F.lit(2)) == part).write.mode("append").parquet(arrivals)
        for _ in range(1 + part):
            kept.follow(spark.readStream.schema(late.schema).parquet(arrivals), merge, "late", done).awaitTermination()
    return kept.read().select("record", "work", "title", F.array_join("source", R.SEPARATOR).alias("sources"), "review_priority", "registry_status")


CLUES_SQL = """SELECT event_id, user_id AS record, CASE event_id % 7 WHEN 0 THEN 'facts' WHEN 1 THEN 'lecture' WHEN 2 THEN '' ELSE 'press-release' END AS target_type, CASE WHEN event_id % 4 = 0 THEN 'pdf_link' ELSE 'reference_like' END AS clue_type,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type || ' found in room ' || (event_id % 13) || ' of event' END AS clue_text, CASE WHEN event_id % 5 > 0 THEN 'page ' || (event_id % 5) END AS source_page, CASE WHEN event_id % 8 = 0 THEN 'file ' || (event_id % 3) END AS href FROM {events}"""


@query(f"""WITH clues AS ({CLUES_SQL.format(events='events')}),
  pages AS (SELECT record, string_agg(source_page, ';' ORDER BY at_) AS v FROM (SELECT record, source_page, min(event_id) AS at_ FROM clues WHERE source_page IS NOT NULL GROUP BY ALL) GROUP BY record),
  files AS (SELECT record, string_agg(href, ';' ORDER BY at_) AS v FROM (SELECT record, href, min(event_id) AS at_ FROM clues WHERE clue_type = 'pdf_link' AND href IS NOT NULL GROUP BY ALL) GROUP BY record),
  shown AS (SELECT record, string_agg('[' || coalesce(nullif(target_type, ''), clue_type) || '] ' || clue_text, ';' ORDER BY nth) AS v FROM (
    SELECT *, row_number() OVER (PARTITION BY record ORDER BY len(list_intersect(string_split(lower(clue_text), ' '), ['purchase', 'room', '5', '7'])) + CASE WHEN target_type = 'facts' THEN 1 ELSE 0 END DESC, length(clue_text), event_id) AS nth
    FROM clues WHERE clue_text <> '' AND NOT (clue_type = 'pdf_link' AND href IS NOT NULL)) WHERE nth <= 3 GROUP BY record)
  SELECT record, coalesce(p.v, '') AS pages, coalesce(f.v, '') AS files, coalesce(s.v, '') AS snippets FROM (SELECT c_custkey AS record FROM customer UNION SELECT record FROM clues) LEFT JOIN pages p USING (record) LEFT JOIN files f USING (record) LEFT JOIN shown s USING (record)""")
def j10_evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10, A-09, W-12, S-06: pages, files and the three best snippets of every record, none of whose clues are gathered."""
    clues = spark.sql(CLUES_SQL, events=table(spark, sf_dir, "events"))
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"))
    terms = F.array(*[F.lit(t) for t in ("purchase", "room", "5", "7")])
    known = records.union(clues.select("record")).distinct().withColumn("terms", terms)
    rows = R.evidence_context(clues, known, "record", "event_id")
    return rows.select("record", *[F.array_join(c, ";").alias(n) for c, n in (("source_pages", "pages"), ("pdf_links", "files"), ("snippets", "snippets"))])


@query("SELECT o_custkey, string_agg(o_orderpriority, ' || ' ORDER BY a) AS priorities, any_value(s) AS statuses FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS a FROM orders GROUP BY ALL) JOIN (SELECT o_custkey, string_agg(o_orderstatus, ' || ' ORDER BY b) AS s FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS b FROM orders GROUP BY ALL) GROUP BY 1) USING (o_custkey) GROUP BY 1")
def a09_ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-09: distinct priorities and statuses of each customer in order of appearance."""
    rows = A.ordered_lists(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderstatus"], "o_orderkey")
    return rows.select("o_custkey", F.array_join("o_orderpriority", R.SEPARATOR).alias("priorities"), F.array_join("o_orderstatus", R.SEPARATOR).alias("statuses"))
