"""Registry, alignment and queue queries: orders play the official source, events the dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import classify as C
from tessera.operators import evidence as R

from .base import query, table

OFFICIAL_SQL = "SELECT o_custkey % 500 AS record, 'w' || (o_orderkey % 40) AS work, o_orderkey AS at_row, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS title, o_orderstatus AS source FROM {orders}"
DATASET_SQL = "SELECT user_id AS record, 'w' || (event_id % 40) AS work, event_id AS at_row, event_type AS title, 'events' AS source FROM {events}"


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OFFICIAL_SQL, orders=table(spark, sf_dir, "orders")).select("*", *[F.lit(c == "official").alias(c) for c in ("official", "dataset", "dataset_matched", "dataset_unresolved")])


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(DATASET_SQL, events=table(spark, sf_dir, "events"))
    matched = F.col("title") != "error"
    return rows.select("*", F.lit(False).alias("official"), F.lit(True).alias("dataset"), matched.alias("dataset_matched"), (~matched).alias("dataset_unresolved"))


MERGED_SQL = f"""SELECT record, work, arg_min(title, seq) FILTER (WHERE trim(title) <> '') AS title, list_transform(list_sort(list(DISTINCT {{'s': first_at, 'v': source}})), lambda x: x.v) AS sources,
    bool_or(k = 0) AS official, bool_or(k = 1) AS dataset, bool_or(k = 1 AND title <> 'error') AS dataset_matched, bool_or(k = 1 AND title = 'error') AS dataset_unresolved
  FROM (SELECT *, min(seq) OVER (PARTITION BY record, work, source) AS first_at FROM (
    SELECT *, 0 AS k, at_row AS seq FROM ({OFFICIAL_SQL.format(orders='orders')}) UNION ALL SELECT *, 1, 1000000000000 + at_row FROM ({DATASET_SQL.format(events='events')}))) GROUP BY 1, 2"""
STATUS_SQL = """CASE WHEN official AND dataset THEN 'strong_candidate_needs_final_acceptance_review' WHEN dataset_matched THEN 'supplementary_candidate_needs_official_alignment' WHEN official THEN 'official_reference_needs_key_relevance_review'
  WHEN dataset AND dataset_unresolved THEN 'metadata_unresolved_needs_manual_or_identifier_search' ELSE 'unclassified_needs_review' END"""
PRIORITY_SQL = "CASE WHEN official AND dataset THEN 'P1' WHEN dataset_matched THEN 'P2' WHEN official THEN 'P3' WHEN dataset AND dataset_unresolved THEN 'P4' ELSE 'P5' END"


def merged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.registry([official(spark, sf_dir), dataset(spark, sf_dir)], ["record", "work"], "at_row", ["title"], ["source"])


@query(f"SELECT record, work, coalesce(title, '') AS title, array_to_string(sources, ' || ') AS sources, {STATUS_SQL} AS registry_status, {PRIORITY_SQL} AS review_priority FROM ({MERGED_SQL})")
def j08_merged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-08, A-09, A-10, A-11, R-03: two sources merged in order into one registry."""
    rows = merged_registry(spark, sf_dir)
    return rows.select("record", "work", F.coalesce("title", F.lit("")).alias("title"), F.array_join("source", R.SEPARATOR).alias("sources"), "registry_status", "review_priority")


LATE_SQL = "SELECT l_suppkey AS record, 'w' || (l_partkey % 60) AS work, min(l_orderkey) AS at_row, 'gap' AS source, CASE WHEN min(l_orderkey) % 2 = 0 THEN 'metadata_matched_needs_official_alignment' ELSE 'other' END AS review_status FROM {lineitem} GROUP BY l_suppkey, l_partkey % 60"
UPSERT_SQL = f"""SELECT coalesce(o.record, n.record) AS record, coalesce(o.work, n.work) AS work, coalesce(nullif(o.title, ''), CASE WHEN n.record IS NOT NULL THEN 'late' END, '') AS title,
   array_to_string(list_concat(coalesce(o.sources, []), CASE WHEN n.record IS NOT NULL THEN ['gap'] ELSE [] END), ' || ') AS sources,
   CASE WHEN o.record IS NULL OR n.p < o.priority THEN n.p ELSE o.priority END AS review_priority, CASE WHEN o.record IS NULL OR n.p < o.priority THEN n.st ELSE o.status END AS registry_status
  FROM (SELECT *, {STATUS_SQL} AS status, {PRIORITY_SQL} AS priority FROM ({MERGED_SQL})) o
  FULL JOIN (SELECT *, CASE WHEN review_status = 'other' THEN 'P2' ELSE 'P1' END AS p, CASE WHEN review_status = 'other' THEN 'official_gap_metadata_candidate_needs_review' ELSE 'official_gap_metadata_matched_needs_official_alignment' END AS st
    FROM ({LATE_SQL.format(lineitem='lineitem')})) n ON o.record = n.record AND o.work = n.work"""


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = spark.sql(LATE_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    incoming = late.select("record", "work", "at_row", F.lit("late").alias("title"), F.array("source").alias("source"), F.lit("B").alias("metadata_match_confidence"), *C.gap_status(F.col("review_status")))
    return R.upsert(merged_registry(spark, sf_dir), incoming, ["record", "work"], "at_row", ["title"], ["source"])


@query(UPSERT_SQL)
def j09_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-09, F-07, R-04: late evidence merged into the registry or added to it."""
    return upserted(spark, sf_dir).select("record", "work", "title", F.array_join("source", R.SEPARATOR).alias("sources"), "review_priority", "registry_status")


@query(f"""SELECT record, work, CASE WHEN title = '' THEN 'excluded' WHEN 1990 + record % 30 > 2010 THEN 'excluded' WHEN record % 7 = 0 THEN 'review_only'
    WHEN registry_status = 'supplementary_candidate_needs_official_alignment' OR registry_status = 'official_gap_metadata_matched_needs_official_alignment' THEN 'main'
    WHEN registry_status IN ('official_gap_metadata_candidate_needs_review', 'official_reference_needs_key_relevance_review') THEN 'sensitivity' ELSE 'review_only' END AS analysis_group FROM ({UPSERT_SQL})""")
def r07_analysis_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-07: which registry rows enter the analysis."""
    rows = upserted(spark, sf_dir)
    journal = F.when(F.col("record") % 7 == 0, "").otherwise("J")
    group = C.analysis_inclusion(F.col("title"), journal, 1990 + F.col("record") % 30, F.lit(2010), F.col("registry_status"), F.col("work"), F.array_join("source", R.SEPARATOR), F.col("metadata_match_confidence"))[0]
    return rows.select("record", "work", group)


SIGNAL_SQL = """SELECT p_partkey, record, CASE WHEN p_partkey % 11 = 0 THEN 'metadata_unresolved' WHEN p_partkey % 5 = 0 AND (o >= 2 OR m >= 1) THEN 'official_reference_with_text_overlap' WHEN p_partkey % 5 = 0 THEN 'official_reference_present'
    WHEN m >= 2 OR o >= 4 THEN 'strong_official_text_overlap' WHEN m >= 1 OR o >= 2 THEN 'moderate_official_text_overlap' WHEN o = 1 THEN 'weak_official_text_overlap' ELSE 'no_automatic_alignment_signal' END AS alignment_signal
  FROM (SELECT p_partkey, p_partkey % 50 AS record, len(list_intersect(t, ot)) AS o, len(list_intersect(t, mt)) AS m FROM (
    SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 4 AND w NOT IN ({stop}))) AS t FROM part) JOIN
    (SELECT p_partkey % 50 AS rec, list(DISTINCT w) FILTER (WHERE p_partkey % 3 = 0) AS ot, list(DISTINCT w) FILTER (WHERE p_partkey % 29 = 0) AS mt FROM (SELECT p_partkey, unnest(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 4 AND w NOT IN ({stop}))) AS w FROM part) GROUP BY 1) ON rec = p_partkey % 50)""".format(
    stop=", ".join(f"'{w}'" for w in X.ALIGNMENT_STOP)
)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_partkey") % 50).alias("record"))
    words = parts.withColumn("w", F.explode(X.alignment_tokens(X.fold(F.col("p_name")))))
    record = words.groupBy("record").agg(F.collect_set(F.when(F.col("p_partkey") % 3 == 0, F.col("w"))).alias("official"), F.collect_set(F.when(F.col("p_partkey") % 29 == 0, F.col("w"))).alias("motivation"))
    rows = parts.join(record, "record").withColumns({
        "status": F.when(F.col("p_partkey") % 11 == 0, "metadata_unresolved_x").otherwise("x"),
        "evidence": F.when(F.col("p_partkey") % 5 == 0, "nobel_official_reference_doi").otherwise("y"),
        "year": F.lit(""),
        "official_text": F.lit(""),
    })
    return R.aligned(rows, "p_name", "official", "motivation", "year", "official_text", "status", "evidence")


@query(f"SELECT p_partkey, coalesce(alignment_signal, '') AS alignment_signal FROM ({SIGNAL_SQL})")
def r05_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-05, U-03: how titles align with official texts."""
    return signals(spark, sf_dir).select("p_partkey", "alignment_signal")


@query(f"""SELECT b.record, count(alignment_signal) AS registry_rows, CASE WHEN count(alignment_signal) = 0 THEN 'no_candidate_registry_rows_yet' WHEN count(*) FILTER (WHERE alignment_signal IN ('strong_official_text_overlap', 'official_reference_with_text_overlap')) > 0 THEN 'has_high_priority_alignment_candidates'
   WHEN count(*) FILTER (WHERE alignment_signal <> 'metadata_unresolved') > 0 THEN 'has_metadata_candidates_needing_official_review' ELSE 'only_metadata_unresolved_candidates' END AS record_alignment_status
   FROM (SELECT unnest(range(0, 60)) AS record) b LEFT JOIN (SELECT * FROM ({SIGNAL_SQL}) WHERE record % 4 <> 1 OR alignment_signal = 'metadata_unresolved') s ON s.record = b.record GROUP BY 1""")
def r06_record_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-06, A-12: what each record is ready for."""
    rows = signals(spark, sf_dir).where((F.col("record") % 4 != 1) | (F.col("alignment_signal") == "metadata_unresolved"))
    return C.record_readiness(rows, spark.range(60).select(F.col("id").alias("record")), "record").select("record", "registry_rows", "record_alignment_status")


@query("SELECT c_custkey AS record, coalesce(k, []) AS snippets FROM customer LEFT JOIN (SELECT user_id, list(event_type ORDER BY event_id) AS k FROM events WHERE event_type <> 'view' GROUP BY 1) ON user_id = c_custkey".replace("coalesce(k, []) AS snippets", "array_to_string(coalesce(k, []), ';') AS snippets"))
def j10_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-10, J-01: records with their snippets in order, those without any kept."""
    clues = table(spark, sf_dir, "events").where("event_type != 'view'").select(F.col("user_id").alias("record"), "event_type", "event_id")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record"))
    rows = R.context(clues.join(known, "record", "left_semi"), known, "record", "event_type", "event_id")
    return rows.select("record", F.array_join("snippets", ";").alias("snippets"))


@query("SELECT p_partkey, kind, url FROM part, (VALUES ('summary', 'summary/'), ('press_release', 'press-release/'), ('popular_information', 'popular-information/')) v(kind, suffix), LATERAL (SELECT 'https://x.example/' || p_partkey || '/' || suffix AS url) WHERE (p_partkey, kind) NOT IN (SELECT l_partkey, 'summary' FROM lineitem)")
def j05_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-05, P-01, P-02: targets of each record that have not been fetched."""
    kinds = [("summary", "summary/"), ("press_release", "press-release/"), ("popular_information", "popular-information/")]
    targets = R.expanded(table(spark, sf_dir, "part").select("p_partkey"), kinds, ("kind", "suffix")).withColumn("url", F.concat(F.lit("https://x.example/"), F.col("p_partkey").cast("string"), F.lit("/"), "suffix")).drop("suffix")
    done = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.lit("summary").alias("kind"))
    return R.resumed(targets, done, ["p_partkey", "kind"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT user_id FROM events) AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j07_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-06, J-07: rows that none of three resolved tables has."""
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return R.unresolved(customers.select("c_custkey", "c_name"), [orders, events, customers.where("c_acctbal < 0")], ["c_custkey"])


@query("SELECT s_suppkey, note FROM supplier JOIN (VALUES (1, 'Supplier#000000001', 'verified'), (2, 'other', 'never'), (3, 'Supplier#000000003', 'duplicate')) v(id, name, note) ON s_suppkey = id AND s_name = name")
def j11_literal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11, SRC-14: rows named by a small literal table of ids and exact titles."""
    rules = spark.createDataFrame([(1, "Supplier#000000001", "verified"), (2, "other", "never"), (3, "Supplier#000000003", "duplicate")], "s_suppkey long, s_name string, note string")
    return table(spark, sf_dir, "supplier").join(F.broadcast(rules), ["s_suppkey", "s_name"]).select("s_suppkey", "note")


@query("""WITH d AS (SELECT o_custkey AS k, o_orderstatus AS v FROM orders WHERE o_orderstatus = 'P'), s AS (SELECT user_id AS k, event_type AS v FROM events WHERE event_type = 'error')
  SELECT c_custkey, v, 'dataset' AS origin FROM customer JOIN d ON k = c_custkey UNION ALL SELECT c_custkey, v, 'seed' FROM customer JOIN s ON k = c_custkey WHERE c_custkey NOT IN (SELECT k FROM d)
  UNION ALL SELECT c_custkey, NULL, 'placeholder' FROM customer WHERE c_custkey NOT IN (SELECT k FROM d) AND c_custkey NOT IN (SELECT k FROM s)""")
def j12_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-12: candidates from the dataset, else from seeds, else a placeholder."""
    first = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("v"))
    second = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("v"))
    return R.fallback(table(spark, sf_dir, "customer").select("c_custkey"), first, second, "c_custkey", ["v"])


AUDIT_SQL = """SELECT c_custkey, coalesce(a.n, 0) AS accepted, coalesce(b.n, 0) AS candidates, coalesce(c.n, 0) AS early, coalesce(d.n, 0) AS historical FROM customer
  LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.k = c_custkey LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) b ON b.k = c_custkey
  LEFT JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) c ON c.k = c_custkey LEFT JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) d ON d.k = c_custkey"""


@query(f"SELECT *, CASE WHEN accepted > 0 THEN 'metadata_matched_partial' WHEN historical > 0 THEN 'historical_bibliography_verified' WHEN early > 0 THEN 'official_narrative_manual_review' WHEN candidates > 0 THEN 'covered_pending_review' ELSE 'no_candidate_evidence' END AS coverage_status FROM ({AUDIT_SQL})")
def j16_coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-16, R-12, G-04: counts of four tables for every record, and its status."""
    orders, events = (table(spark, sf_dir, t).withColumnRenamed(k, "c_custkey") for t, k in (("orders", "o_custkey"), ("events", "user_id")))
    counts = {"accepted": orders.where("o_orderstatus = 'P'"), "candidates": orders, "early": events.where("event_type = 'error'"), "historical": events.where("event_type = 'purchase'")}
    rows = R.audit(table(spark, sf_dir, "customer"), "c_custkey", counts)
    c = F.col
    return rows.withColumn("coverage_status", C.coverage_status(c("accepted"), F.lit(0), F.lit(0), c("historical"), c("early"), c("candidates")))


@query("""SELECT p_partkey, CASE WHEN s = 0 THEN 'non_paper_review' WHEN m = 0 AND j THEN 'journal_candidate_matched' WHEN m = 0 THEN 'matched_missing_source' WHEN s = 1 THEN 'manual_seed_review' WHEN m = 1 THEN 'mag_unresolved' WHEN d THEN 'identifier_present_needs_review' ELSE 'unresolved_metadata' END AS eligibility,
  CASE WHEN s = 0 THEN 'P1' WHEN m = 0 AND j THEN 'P4' WHEN m = 0 THEN 'P3' WHEN s = 1 THEN 'P2' WHEN m = 1 THEN 'P3' ELSE 'P4' END AS manual_priority,
  CASE WHEN 1900 + p_size * 3 >= 2000 THEN 'P2' WHEN 1900 + p_size * 3 >= 1940 THEN 'P3' ELSE 'P4' END AS queue_priority,
  CASE WHEN contains(lower(p_name), 'process') THEN 'patent_or_process' WHEN p_partkey % 9 = 0 THEN 'monograph_or_book' ELSE 'non_journal_contribution' END AS contribution_type
  FROM (SELECT *, p_partkey % 5 AS s, p_partkey % 3 AS m, p_partkey % 2 = 0 AS j, p_partkey % 7 = 0 AS d FROM part)""")
def r08_review_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-08, R-09, R-10, R-11: eligibility, priorities and kinds of contribution."""
    k, c = F.col("p_partkey"), F.col
    rows = table(spark, sf_dir, "part").withColumns({
        "s": F.when(k % 5 == 0, "non_paper_contribution_review").when(k % 5 == 1, "needs_manual_verification").otherwise(""),
        "m": F.when(k % 3 == 0, "matched_by_mag_id").when(k % 3 == 1, "no_openalex_result_for_mag_id").otherwise(""),
        "j": F.when(k % 2 == 0, "J").otherwise(""),
        "d": F.when(k % 7 == 0, "10.1/x").otherwise(""),
        "press": F.when(k % 9 == 0, "Silliman lectures").otherwise(""),
    })
    rows = rows.withColumn("eligibility", C.narrative_eligibility(c("s"), c("m"), c("j"), c("d")))
    return rows.select("p_partkey", "eligibility", C.manual_priority(c("eligibility")), C.record_queue_priority(1900 + c("p_size") * 3), C.contribution_type(c("p_name"), c("press")))


@query("""SELECT o_custkey, CASE WHEN list_contains(s, 'P') THEN 'P1' WHEN list_contains(s, 'F') THEN 'P1' ELSE 'P2' END AS queue_priority, CASE WHEN list_contains(s, 'P') THEN 'review_candidate_match' WHEN list_contains(s, 'F') THEN 'review_official_reference_relevance' ELSE 'resolve_metadata' END AS queue_task FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1)""")
def r10_candidate_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-10, A-24: priority and task of records from their rows' statuses."""
    status = F.when(F.col("o_orderstatus") == "P", "official_gap_metadata_candidate_needs_review").when(F.col("o_orderstatus") == "F", "official_reference_needs_key_relevance_review").otherwise("metadata_unresolved_needs_manual_or_identifier_search")
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(status).alias("s"))
    return sets.select("o_custkey", *C.candidate_queue(F.col("s")))


@query("SELECT o_orderkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE o_orderpriority END AS o_orderpriority FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def p06_conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-05, P-06: columns replaced where a lookup matches, all others passed through."""
    found = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = table(spark, sf_dir, "orders").join(found, "o_custkey", "left")
    return rows.select("o_orderkey", F.coalesce("c_mktsegment", "o_orderpriority").alias("o_orderpriority"))


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_name END), ''), p_brand) AS title, 'openalex:w' || p_partkey AS key_1, 'doi:10.1/x' || p_partkey AS key_2, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')) || '|' || p_size AS paper FROM part")
def p04_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-04: choices of first filled values, work keys and paper keys."""
    c, none = F.col, F.lit("")
    part = c("p_partkey").cast("string")
    title = R.filled(F.when(c("p_partkey") % 2 == 0, " ").otherwise(c("p_name")), c("p_brand"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        title.alias("title"),
        R.work_key(F.concat(F.lit("W"), part), none, none, none).alias("key_1"),
        R.work_key(none, F.concat(F.lit("https://doi.org/10.1/X"), part, F.lit(").")), none, none).alias("key_2"),
        R.paper_key(none, none, c("p_name"), c("p_size")).alias("paper"),
    )
