"""The candidate registry: keys, order-safe merges of evidence, upserts, review queues and coverage audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

from . import classify as C
from .analytics import first_filled, first_rows, ordered_lists

SEPARATOR = " || "
#: Cells that gather distinct values, and cells where the first value stays.
LIST_FIELDS = ("evidence_sources", "source_record_ids", "official_reference_ids", "source_candidate_titles", "official_reference_texts", "metadata_match_methods", "notes")
FIRST_FIELDS = ("openalex_work_id", "doi", "title", "publication_year", "journal", "openalex_source_id", "issn_l", "work_type", "candidate_year", "award_lag_years")


def filled(*columns: Column) -> Column:
    """P-04: the first non-blank value, trimmed; empty if there is none."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def work_key(work: Column, doi: Column, dataset_id: Column, fallback: Column) -> Column:
    """Work id, else identifier, else dataset id, else the source row's own id."""
    return (
        F.when(filled(work) != "", F.concat(F.lit("openalex:"), F.lower(X.short_id(X.work_id(work)))))
        .when(X.bare_doi(doi) != "", F.concat(F.lit("doi:"), X.bare_doi(doi)))
        .when(filled(dataset_id) != "", F.concat(F.lit("mag_unresolved:"), F.trim(dataset_id)))
        .otherwise(fallback)
    )


def paper_key(work: Column, doi: Column, title: Column, year: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(work), F.lit("")), F.nullif(F.trim(doi), F.lit("")), F.concat(X.fold(title), F.lit("|"), F.coalesce(year.cast("string"), F.lit(""))))


def lag_years(award: Column, published: Column) -> Column:
    """P-03: null unless both are whole numbers."""
    return X.strict_int(award.cast("string")) - X.strict_int(published.cast("string"))


def merged(sources: list[DataFrame], key: list[str], ordinal: str, first: list[str], lists: list[str], flags: list[str]) -> DataFrame:
    """J-08: one row a key from several sources, earlier sources first and by ordinal within one: first filled values, ordered distinct lists, flags that any row sets."""
    tagged = [s.withColumn("_seq", F.struct(F.lit(k).alias("source"), F.col(ordinal).alias("at"))) for k, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    aggs = [first_filled(c, "_seq").alias(c) for c in first] + [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in flags]
    ones = rows.groupBy(*key).agg(*aggs)
    if not lists:
        return ones
    names = [f"_key{k}" for k in range(len(key))]
    listed = ordered_lists(rows, key, lists, "_seq").withColumnsRenamed(dict(zip(key, names, strict=True)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, names, strict=True)])
    return ones.join(listed, same).select(*key, *first, *lists, *flags)


def registry(sources: list[DataFrame], key: list[str], ordinal: str, first: list[str], lists: list[str]) -> DataFrame:
    """Merged candidates with their status (R-03). Sources carry the flags official, dataset, dataset_matched, dataset_unresolved."""
    rows = merged(sources, key, ordinal, first, lists, ["official", "dataset", "dataset_matched", "dataset_unresolved"])
    return rows.select("*", *C.registry_status(*[F.col(c) for c in ("official", "dataset", "dataset_matched", "dataset_unresolved")]))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], ordinal: str, first: list[str], lists: list[str]) -> DataFrame:
    """J-09: incoming rows merged into existing ones, or added. Lists grow, first values stay, a D confidence gives way, and the better priority brings its status along (compared as text)."""
    fields = ["metadata_match_confidence", "review_priority", "registry_status", "analysis_readiness"]
    status = F.struct(F.col("review_priority").alias("p"), F.col(ordinal).alias("at"), "registry_status", "analysis_readiness")
    new = incoming.groupBy(*key).agg(
        *[first_filled(c, ordinal).alias(f"_{c}") for c in first],
        *[F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct(ordinal, c))).getField(c))).alias(f"_{c}") for c in lists],
        F.min_by(F.nullif("metadata_match_confidence", F.lit("")), ordinal).alias("_confidence"),
        F.min(status).alias("_status"),
    )
    old = existing.select(*key, *first, *lists, *fields, F.lit(True).alias("_old"))
    both = old.join(new, key, "full_outer")
    empty = F.array().cast("array<string>")
    better = F.col("_old").isNull() | F.coalesce(F.col("_status.p") < F.col("review_priority"), F.lit(False))
    confidence = F.when(F.col("_old").isNull() | ((F.col("metadata_match_confidence") == "D") & F.col("_confidence").isNotNull()), F.col("_confidence")).otherwise(F.col("metadata_match_confidence"))
    return both.select(
        *key,
        *[F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_{c}"), F.lit("")).alias(c) for c in first],
        *[F.array_distinct(F.concat(F.coalesce(c, empty), F.coalesce(f"_{c}", empty))).alias(c) for c in lists],
        confidence.alias("metadata_match_confidence"),
        F.when(better, F.col("_status.p")).otherwise(F.col("review_priority")).alias("review_priority"),
        F.when(better, F.col("_status.registry_status")).otherwise(F.col("registry_status")).alias("registry_status"),
        F.when(better, F.col("_status.analysis_readiness")).otherwise(F.col("analysis_readiness")).alias("analysis_readiness"),
    )


#: Statuses of late matches that may enter the registry.
MERGEABLE_STATUSES = ("metadata_matched_needs_official_alignment", "metadata_candidate_needs_review")


def mergeable(rows: DataFrame, confidence: str = "metadata_match_confidence", status: str = "review_status") -> DataFrame:
    """F-07: late matches that may be merged: of another confidence than D (a missing one counts as another), and of a status that is meant for it."""
    return rows.where((F.coalesce(confidence, F.lit("")) != "D") & F.coalesce(F.col(status).isin(*MERGEABLE_STATUSES), F.lit(False)))


def context(clues: DataFrame, baseline: DataFrame, key: str, text: str, ordinal: str) -> DataFrame:
    """J-10: snippets of each record in order; records without clues, and ids only in clues, are kept. A record's snippets are one cell: for records of any size see evidence_context()."""
    gathered = clues.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, text))), lambda s: s[text]).alias("snippets"))
    return baseline.join(gathered, key, "full_outer").withColumn("snippets", F.coalesce("snippets", F.array().cast("array<string>")))


#: Kinds of pages whose snippets count one more; snippets that are shown of a record, and their length.
PRIVILEGED_TARGETS = ("secondary_lecture", "secondary_biographical", "facts", "advanced-information")
SHOWN_SNIPPETS, SNIPPET_LENGTH = 3, 300


def evidence_context(clues: DataFrame, records: DataFrame, key: str, ordinal: str) -> DataFrame:
    """J-10, W-12, S-06: key, source_pages, pdf_links, snippets: what a review sees of each record's clues, without gathering them.

    clues: key, ordinal, target_type, clue_type, clue_text, source_page, href; records: key, terms (the tokens that snippets are measured by).
    Pages and files are distinct values in order of appearance. Links to files are no snippets. Of the snippets those with most terms stay, the shorter ones
    first, then in order; each task hands on three of a record. Records without clues, and ids only in clues, are kept."""
    is_link = (F.col("clue_type") == "pdf_link") & (F.coalesce("href", F.lit("")) != "")
    given = clues.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    lists = ordered_lists(given.select(key, ordinal, F.col("source_page").alias("source_pages"), F.when(is_link, F.col("href")).alias("pdf_links")), [key], ["source_pages", "pdf_links"], ordinal)
    texts = given.where(~F.coalesce(is_link, F.lit(False)) & (F.coalesce("clue_text", F.lit("")) != "")).join(records.select(key, "terms"), key, "left")
    shared = F.size(F.array_intersect(X.alignment_tokens(X.fold(F.col("clue_text"))), F.coalesce("terms", F.array().cast("array<string>"))))
    scored = texts.withColumn("_score", shared + F.coalesce(F.col("target_type").isin(*PRIVILEGED_TARGETS), F.lit(False)).cast("int"))
    top = first_rows(scored, [key], [F.col("_score").desc(), F.length("clue_text"), F.col(ordinal)], SHOWN_SNIPPETS)
    label = F.concat(F.lit("["), filled(F.col("target_type"), F.col("clue_type"), F.lit("official")), F.lit("] "), X.clipped(X.squeezed(F.col("clue_text")), SNIPPET_LENGTH))
    shown = top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", label.alias("text")))), lambda s: s["text"]).alias("snippets"))
    none = F.array().cast("array<string>")
    out = records.select(key).join(lists, key, "full_outer").join(shown, key, "left")
    return out.select(key, *[F.coalesce(c, none).alias(c) for c in ("source_pages", "pdf_links", "snippets")])


def aligned(rows: DataFrame, title: str, official: str, motivation: str, year: str, official_text: str, status: str, evidence: str) -> DataFrame:
    """R-05 over token columns: official and motivation are token arrays made once a record; titles are tokenised once a row."""
    titles = F.array_distinct(X.alignment_tokens(X.fold(F.col(title))))
    shared = rows.withColumn("official_overlap", F.array_sort(F.array_intersect(titles, F.col(official)))).withColumn("motivation_overlap", F.array_sort(F.array_intersect(titles, F.col(motivation))))
    mentioned = (F.coalesce(F.col(year).cast("string"), F.lit("")) != "") & F.contains(F.col(official_text), F.col(year).cast("string"))
    return shared.select("*", *C.alignment_signal(F.col(status), F.col(evidence), F.size("official_overlap"), F.size("motivation_overlap"), F.coalesce(mentioned, F.lit(False))))


def unresolved(rows: DataFrame, resolved: list[DataFrame], key: list[str]) -> DataFrame:
    """J-07: rows whose key none of the resolved tables has."""
    done = reduce(lambda a, b: a.unionByName(b), [r.select(*key) for r in resolved]).distinct()
    return rows.join(done, key, "left_anti")


def fallback(records: DataFrame, first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """J-12: rows of the first table; for records it lacks, rows of the second; for the rest, one blank row."""
    one = records.join(first.select(key, *fields), key).withColumn("origin", F.lit("dataset"))
    left = records.join(first.select(key).distinct(), key, "left_anti")
    two = left.join(second.select(key, *fields), key).withColumn("origin", F.lit("seed"))
    none = left.join(second.select(key).distinct(), key, "left_anti").select("*", *[F.lit(None).cast("string").alias(f) for f in fields], F.lit("placeholder").alias("origin"))
    return one.unionByName(two).unionByName(none)


def audit(baseline: DataFrame, key: str, counts: dict[str, DataFrame]) -> DataFrame:
    """J-16, G-04: counts of several tables for every record, in one pass: the rows of all tables under a tag each, and one aggregate over them."""
    tagged = reduce(lambda a, b: a.unionByName(b), [rows.select(F.col(key).alias(key), F.lit(k).alias("_tag")) for k, rows in enumerate([baseline, *counts.values()])])
    per = tagged.groupBy(key).agg(F.count_if(F.col("_tag") == 0).alias("_known"), *[F.count_if(F.col("_tag") == k).alias(name) for k, name in enumerate(counts, 1)])
    return per.where(F.col("_known") > 0).drop("_known")


def expanded(records: DataFrame, kinds: list[tuple[str, ...]], names: tuple[str, ...]) -> DataFrame:
    """P-02: one row of each record for each kind, with literal columns."""
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, kind, strict=True)]) for kind in kinds]))
    return records.withColumn("_kind", each).select(*records.columns, *[F.col(f"_kind.{n}").alias(n) for n in names])


def resumed(targets: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """J-05: targets that have no status row yet."""
    return targets.join(done.select(*key).distinct(), key, "left_anti")
