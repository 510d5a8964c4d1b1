"""Candidates for records that no source has settled: official references, filtered, scored and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

from . import classify as C
from .analytics import placed
from .match import gap_score, gap_tier


def usable(reference_class: Column) -> Column:
    """F-03: classes of references that may be candidates."""
    return reference_class.isin(*C.USABLE_CLASSES)


def gap_candidates(refs: DataFrame, gaps: DataFrame, record: str, ref: str) -> DataFrame:
    """F-03, F-04, J-04, S-04, R-14: the references of records in the queue that may be candidates, each text once a record, with score and tier.

    refs: record, ref (their order), reference_text, pdf_type; gaps: record (unique), award_year, motivation, full_name.
    Rows go in the order of cost: by class, by a semi join with the queue, as boilerplate, as a repeated text; only what is left is tokenised and scored. The queue's
    texts are tokenised once a record."""
    text = F.col("reference_text")
    classified = refs.select(record, ref, "pdf_type", "reference_text", *C.reference_class(text))
    asked = classified.where(usable(F.col("reference_class"))).join(gaps.select(record), record, "left_semi")
    marked = asked.where(~C.is_boilerplate(text)).withColumn("_mark", X.fingerprint(text))
    firsts = marked.groupBy(record, "_mark").agg(F.min(F.struct(ref, "pdf_type", "reference_text", "reference_class", "detected_doi")).alias("_first")).select(record, "_first.*")
    queue = gaps.select(record, "award_year", F.array_distinct(X.gap_tokens(X.fold(F.col("motivation")))).alias("_motive"), X.gap_name_tokens(F.col("full_name")).alias("_name"))
    rows = firsts.join(queue, record).withColumns({"_tokens": F.array_distinct(X.gap_tokens(X.fold(text))), "_years": X.years(text, X.YEAR_CAPPED)})
    year = X.year_for_award(F.col("_years"), F.col("award_year"))
    score = gap_score(F.col("reference_class"), F.col("pdf_type"), year, F.col("award_year"), F.size(F.array_intersect("_tokens", "_motive")), F.arrays_overlap("_tokens", "_name"), F.col("detected_doi"))
    scored = rows.select(record, ref, "reference_class", "detected_doi", year.alias("candidate_year"), F.arrays_overlap("_tokens", "_name").alias("name_in_reference"), score.alias("score"))
    return scored.withColumn("gap_tier", gap_tier(F.col("score")))


def ranked_gap_candidates(refs: DataFrame, gaps: DataFrame, record: str, ref: str) -> DataFrame:
    """O-05: gap_candidates() with the place inside its record, by falling score, then reference; counted over sorted ranges."""
    ranked = placed(gap_candidates(refs, gaps, record, ref), [record], [F.col("score").desc(), F.col(ref)])
    return ranked.withColumn("place", F.col("_at") + 1).drop("_at", "_n")


def without_references(refs: DataFrame, gaps: DataFrame, record: str, ref: str) -> DataFrame:
    """Records of the queue that no reference is a candidate for."""
    return gaps.join(gap_candidates(refs, gaps, record, ref).select(record).distinct(), record, "left_anti")
