"""Matching: scores of candidate works against citations, best match, confidence, cascades, and name linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.functions.rules import first_match
from tessera.sources.scratch import materialised


def containment(a: Column, b: Column) -> Column:
    """S-05: the share of a's tokens that b has; 0 if a has none. Not symmetric."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def bibliographic_score(doi: Column, article: Column, year: Column, title: Column, source: Column, api: Column) -> Column:
    """S-01."""
    points = lambda c, n: F.when(c, F.lit(float(n))).otherwise(F.lit(0.0))
    return points(doi, 70) + points(article, 10) + points(year, 15) + 60 * title + points(source >= 0.5, 10) + F.least(F.coalesce(api, F.lit(0.0)), F.lit(100.0)) / 100


def search_score(article: Column, year: Column, title: Column, source: Column) -> Column:
    """S-02."""
    points = lambda c, n: F.when(c, F.lit(float(n))).otherwise(F.lit(0.0))
    return points(article, 10) + points(year, 20) + 70 * title + points(source >= 0.5, 10)


def match_confidence(doi: Column, title: Column, year: Column, source: Column) -> list[Column]:
    """R-13: confidence, method, review status. A full source overlap is one that prints as 1.00."""
    rules = [
        (title.isNull(), ("D", "no_crossref_candidate", "no_match")),
        (doi, ("A", "crossref_exact_doi", "accepted")),
        ((title >= 0.75) & year, ("A", "crossref_title_year_high_overlap", "accepted")),
        ((title >= 0.60) & year, ("B", "crossref_title_year_medium_overlap", "needs_review")),
        ((title >= 0.45) & (year | (source >= 0.995)), ("C", "crossref_partial_overlap", "needs_review")),
        (None, ("D", "crossref_low_overlap", "no_match")),
    ]
    return first_match(rules, ("confidence", "method", "review_status"))


def search_acceptance(title: Column, year: Column, score: Column) -> Column:
    """S-03: the confidence of an acceptable search hit, null if it isn't acceptable."""
    return F.when((title >= 0.75) & year, "A").when((title >= 0.60) & year, "B").when((score >= 65) & year, "C")


def best_per(rows: DataFrame, key: list[str], score: str, ordinal: list[str]) -> DataFrame:
    """J-13: the best row of each key; of equals, the first."""
    order = Window.partitionBy(*key).orderBy(F.col(score).desc(), *ordinal)
    return rows.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def best_containment(items: DataFrame, item: str, item_tokens: str, docs: DataFrame, doc: str, doc_tokens: str, rounds: list[int] | None = None) -> DataFrame:
    """J-13: item, doc, shared, size: for each item the document that holds most of its distinct tokens, of equals the smallest; items that share nothing are left out.

    An item's tokens are taken from the rarest on. Documents that hold none of the first p of its m tokens share at most m - p, so once the best
    document found shares more than that, no other can beat or equal it. Each round takes as many tokens again, up to m - best + 1, counts only the postings
    of those, scores only documents that can still reach the best so far, and goes on with the items that are not done. rounds, if given, gets the number of pairs met in
    each round. Keys are unique."""
    sought = items.select(F.col(item).alias("_item"), F.array_distinct(item_tokens).alias("_all"))
    wanted = sought.select(F.explode("_all").alias("_token")).distinct()
    found = docs.select(F.col(doc).alias("_doc"), F.explode(F.array_distinct(doc_tokens)).alias("_token")).join(wanted, "_token", "left_semi")
    held = materialised(found.groupBy("_doc").agg(F.collect_list("_token").alias("_held")), "held-tokens")
    postings = held.select("_doc", F.explode("_held").alias("_token"))
    rarity = postings.groupBy("_token").agg(F.count("*").alias("_df"))
    ordered = sought.select("_item", F.size("_all").alias("_size"), F.explode("_all").alias("_token")).join(rarity, "_token").groupBy("_item", "_size").agg(F.array_sort(F.collect_list(F.struct("_df", "_token"))).alias("_rare"))
    queries = ordered.select("_item", "_size", F.transform("_rare", lambda x: x["_token"]).alias("_tokens"), F.size("_rare").alias("_m"))
    state = materialised(queries.select("*", F.lit(0).alias("_done"), F.lit(0).alias("_shared"), F.lit(None).cast(docs.schema[doc].dataType).alias("_doc")), "best-so-far")
    enough = F.least(F.col("_m") - F.col("_shared") + 1, F.col("_m"))
    open_ = F.col("_done") < enough
    while state.where(open_).limit(1).count():
        reach = F.least(enough, F.greatest(F.col("_done") * 2, F.lit(1)))
        todo = state.where(open_).withColumn("_reach", reach)
        fresh = todo.select("_item", F.explode(F.slice("_tokens", F.col("_done") + 1, F.col("_reach") - F.col("_done"))).alias("_token"))
        met = fresh.join(postings, "_token").groupBy("_item", "_doc").agg(F.count("*").alias("_hits"))
        if rounds is not None:
            rounds.append(met.count())
        # A document that was met before has been scored; of any other these are all its hits so far.
        able = met.join(todo.select("_item", "_tokens", "_m", "_reach", "_shared"), "_item").where(F.col("_hits") + F.col("_m") - F.col("_reach") >= F.col("_shared"))
        scored = able.select("_item", "_doc", "_tokens").join(held, "_doc").select("_item", F.struct((-F.size(F.array_intersect("_tokens", "_held"))).alias("less"), F.col("_doc").alias("doc")).alias("_new"))
        top = scored.groupBy("_item").agg(F.min("_new").alias("_new"))
        better = F.col("_new").isNotNull() & (F.col("_new") < F.struct((-F.col("_shared")).alias("less"), F.col("_doc").alias("doc")))
        state = materialised(state.join(top, "_item", "left").select(
            "_item", "_size", "_tokens", "_m", F.when(open_, reach).otherwise(F.col("_done")).alias("_done"),
            F.when(better, -F.col("_new.less")).otherwise(F.col("_shared")).alias("_shared"), F.when(better, F.col("_new.doc")).otherwise(F.col("_doc")).alias("_doc"),
        ), "best-so-far")
    return state.where("_shared > 0").select(F.col("_item").alias(item), F.col("_doc").alias(doc), F.col("_shared").alias("shared"), F.col("_size").alias("size"))


def gap_score(cls: Column, pdf: Column, candidate_year: Column, award: Column, overlap: Column, name: Column, doi: Column) -> Column:
    """S-04."""
    n = lambda c, k: F.when(F.coalesce(c, F.lit(False)), F.lit(k)).otherwise(F.lit(0))
    by_class = F.when(cls == "doi_present", 8).when(cls == "likely_journal_article", 6).when(cls == "historical_nonindexed_reference", 5).when(cls == "needs_manual_review", 2).otherwise(0)
    by_file = F.when(pdf == "scientific_background", 4).when(F.contains(pdf, F.lit("lecture")), 2).otherwise(0)
    lag = award - candidate_year
    by_year = F.when(candidate_year.isNull(), 0).when(lag < 0, -5).when(lag <= 5, 7).when(lag <= 25, 6).otherwise(5)
    return by_class + by_file + by_year + F.least(overlap, F.lit(6)) * 2 + n(name, 3) + n(doi != "", 3)


def gap_tier(score: Column) -> Column:
    """R-14."""
    rules = [(score >= 22, ("A_high_priority_official_gap_candidate",)), (score >= 14, ("B_reviewable_official_gap_candidate",)), (score >= 7, ("C_low_signal_official_gap_candidate",)), (None, ("D_hold_for_manual_triage",))]
    return first_match(rules, ("gap_tier",))[0]


#: Characters of the parts by which names are looked up, and parts that a frequent one is dealt over.
GRAM, GRAM_SALTS = 3, 8


def grams(x: Column, size: Column) -> Column:
    """The distinct runs of `size` characters of a text."""
    return F.array_distinct(F.when(F.length(x) >= size, F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda k: x.substr(k, size))).otherwise(F.array().cast("array<string>")))


def name_linkage(base: DataFrame, dataset: DataFrame, keys: list[str], full_name: str, dataset_name: str) -> DataFrame:
    """J-03: rows of the same keys whose dataset family name lies in one of the family-name candidates.

    A name that lies in another shares all its runs of GRAM characters with it (a shorter name is one run). Each dataset name is looked up by the one of its runs
    that fewest names of its block have, and only what is found there is compared. Equal names of a block are compared once; names are folded before the joins."""
    left = base.withColumn("_names", X.family_names(F.col(full_name)))
    right = dataset.withColumn("_family", X.dataset_family_name(F.col(dataset_name))).where("_family != ''")
    sizes = [F.lit(k) for k in range(1, GRAM + 1)]
    parts = F.array_distinct(F.flatten(F.flatten(F.transform("_names", lambda n: F.array(*[grams(n, k) for k in sizes])))))
    names = left.select(*keys, "_names").distinct().select(*keys, "_names", F.explode(parts).alias("_gram"))
    families = right.select(*keys, "_family").distinct()
    known = names.groupBy(*keys, "_gram").agg(F.count("*").alias("_n"))
    tried = families.select(*keys, "_family", F.explode(grams(F.col("_family"), F.least(F.length("_family"), F.lit(GRAM)))).alias("_gram"))
    rarest = tried.join(known, [*keys, "_gram"], "left").groupBy(*keys, "_family").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("gram"))).alias("_least"))
    asked = rarest.where("_least.n > 0").select(*keys, "_family", F.col("_least.gram").alias("_gram"), F.explode(F.sequence(F.lit(0), F.lit(GRAM_SALTS - 1))).alias("_salt"))
    dealt = names.withColumn("_salt", F.pmod(F.xxhash64("_names"), F.lit(GRAM_SALTS)).cast("int"))
    pairs = dealt.join(asked, [*keys, "_gram", "_salt"]).where(F.exists("_names", lambda n: F.contains(n, F.col("_family")))).select(*keys, "_names", "_family")
    return left.join(pairs, [*keys, "_names"]).join(right, [*keys, "_family"]).drop("_names", "_family")


def cascade(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, fields: list[str], ordinal: list[str] | None = None) -> DataFrame:
    """J-14: fields from the first source by key, from the second where the first has none, with a status. Keys are looked up once each; where a
    source repeats a key, its first row by the ordinal columns counts, or the least row by its fields where there are none."""
    once = lambda source: source.groupBy(key).agg(F.min(F.struct(*(ordinal or []), *fields)).alias("_row")).select(key, *[F.col("_row")[f].alias(f) for f in fields])
    keys = rows.select(key).where(F.coalesce(F.col(key), F.lit("")) != "").distinct()
    one = keys.join(once(first).withColumn("_one", F.lit(1)), key, "left")
    missed = one.where("_one is null").select(key).join(once(second), key).withColumn("_status", F.lit("matched_second"))
    found = one.where("_one = 1").drop("_one").withColumn("_status", F.lit("matched_first")).unionByName(missed)
    return rows.join(found, key, "left").withColumn("match_status", F.coalesce("_status", F.lit("no_match"))).drop("_status")


def candidate_queries(text: Column) -> Column:
    """SC-18: up to four titles to search for: what stands before a source's name in three punctuation patterns, then the whole text."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")
    named = r"(?:Phys\.|Physical Review|Nature|Science|Cell|Lancet|PNAS|Proc\.|Rev\.)"
    patterns = [r"\),\s*([^,]{25,220}?),\s*" + named, r"\.\s*([^\.]{25,220}?)\.\s*" + named, r"\.\s*([^\.]{25,220}?),\s*" + named]
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
    trimmed = F.transform(found, lambda q: F.trim(q, F.lit(" .,;:")))
    long = F.filter(trimmed, lambda q: F.size(X.gap_match_tokens(X.fold(q, slashed_o=True))) >= 4)
    return F.slice(F.array_distinct(F.concat(long, F.array(text))), 1, 4)


# What S-02 and S-03 imply: an acceptable hit is in a cited year and scores 62 at least (B: 20 + 70 * 0.6), so a hit that counts for or against
# one shares 22/70 of its title in a cited year (22 + 40 points for the rest), 42/70 outside (42 + 20).
LEAST_IN_YEAR, LEAST_OUTSIDE, WHOLE_TITLE = 22, 42, 70


def rare_first(titles: DataFrame) -> DataFrame:
    """_t, _rare: each distinct title's tokens, those of fewest titles first."""
    distinct = titles.select("_t").distinct()
    each = distinct.select("_t", F.explode("_t").alias("_token"))
    rarity = each.groupBy("_token").agg(F.count("*").alias("_df"))
    return each.join(rarity, "_token").groupBy("_t").agg(F.transform(F.array_sort(F.collect_list(F.struct("_df", "_token"))), lambda x: x["_token"]).alias("_rare"))


def title_prefix(least: int) -> Column:
    """The rarest tokens of a title of which a text must have one, if it has least / WHOLE_TITLE of them."""
    n = F.size("_rare")
    return F.slice("_rare", 1, n - F.floor((n * least + WHOLE_TITLE - 1) / WHOLE_TITLE).cast("int") + 1)


class WorkIndex:
    """Works to search: equal works once (by the first id), each under the rare tokens of its title, by year and without."""

    def __init__(self, works: DataFrame):
        of = works.select(F.array_sort("title_tokens").alias("_t"), F.array_sort("source_tokens").alias("_s"), "article", "year", "work_id").where(F.size("_t") > 0)
        rare = rare_first(of)
        ordered = of.join(rare, "_t")
        self.dated = materialised(ordered.where("year is not null").groupBy("_t", "_s", "_rare", "article", "year").agg(F.min("work_id").alias("work_id")), "works-by-year")
        self.whole = materialised(ordered.groupBy("_t", "_s", "_rare", "article").agg(F.min("work_id").alias("work_id")), "works")

    def in_year(self, asked: DataFrame) -> DataFrame:
        """The best work of a cited year for each class of searches, if it scores enough to count: _class, score, work_id, title_overlap."""
        under = self.dated.select("year", "work_id", F.explode(title_prefix(LEAST_IN_YEAR)).alias("_token"))
        words = asked.select("_class", F.explode("_r").alias("_token"), "years").select("_class", "_token", F.explode("years").alias("year"))
        met = words.join(under, ["year", "_token"]).select("_class", "work_id").distinct()
        return best_per(self._scored(met, asked, self.dated, True), ["_class"], "score", ["work_id"])

    def better_outside(self, asked: DataFrame) -> DataFrame:
        """_class of searches (with score and work_id of a hit) for which a work scores better without a cited year, or as well under a smaller id."""
        under = self.whole.select(F.col("work_id").alias("other"), F.explode(title_prefix(LEAST_OUTSIDE)).alias("_token"))
        met = asked.select("_class", F.explode("_r").alias("_token")).join(under, "_token").select("_class", F.col("other").alias("work_id")).distinct()
        scored = self._scored(met, asked, self.whole, False).select("_class", F.col("score").alias("_score"), F.col("work_id").alias("_work"))
        rival = (F.col("_score") > F.col("score")) | ((F.col("_score") == F.col("score")) & (F.col("_work") < F.col("work_id")))
        return scored.join(asked.select("_class", "score", "work_id"), "_class").where(rival).select("_class").distinct()

    def _scored(self, met: DataFrame, asked: DataFrame, works: DataFrame, in_year: bool) -> DataFrame:
        title, source = containment(F.col("_t"), F.col("_r")), containment(F.col("_s"), F.col("_r"))
        pairs = met.join(asked.select("_class", "_q", "_r"), "_class").join(works.select("work_id", "_t", "_s", "article"), "work_id").where(F.arrays_overlap("_t", "_q"))
        return pairs.select("_class", "work_id", title.alias("title_overlap"), search_score(F.col("article"), F.lit(in_year), title, source).alias("score"))


def search_cascade(queries: DataFrame, works: DataFrame) -> DataFrame:
    """J-15: for each reference the hit of its first query that has an acceptable one.

    queries: ref_id, pos, query_tokens, ref_tokens, years; works: work_id, title_tokens, source_tokens, year, article.
    A query finds all works that share a title token with it; the best of them by score (first work on ties) is accepted or not. One round for each position: only
    references that no earlier round has settled are searched again. A round looks for the best work of a cited year among those that share enough of their titles to count,
    and only for the acceptable ones among these for a better work of any year. Searches of equal tokens and years are made once."""
    index, settled = WorkIndex(works), None
    ready = materialised(queries.select("ref_id", "pos", F.array_sort("query_tokens").alias("_q"), F.array_sort("ref_tokens").alias("_r"), F.array_sort(F.array_distinct("years")).alias("years")), "searches")
    # At most as many positions as a reference has queries (SC-18: four).
    for pos in sorted(r.pos for r in ready.select("pos").distinct().collect()):
        live = ready.where(F.col("pos") == pos)
        if settled is not None:
            live = live.join(settled.select("ref_id"), "ref_id", "left_anti")
        live = materialised(live.withColumn("_class", F.sha2(F.to_json(F.struct("_q", "_r", "years")), 256)), "searches-left")
        asked = live.groupBy("_class").agg(F.any_value("_q").alias("_q"), F.any_value("_r").alias("_r"), F.any_value("years").alias("years"))
        hits = index.in_year(asked).withColumn("confidence", search_acceptance(F.col("title_overlap"), F.lit(True), F.col("score"))).where("confidence is not null")
        likely = materialised(hits.join(asked, "_class"), "hits")
        found = likely.join(index.better_outside(likely), "_class", "left_anti").select("_class", "work_id", "score", "confidence")
        now = materialised(live.join(found, "_class").select("ref_id", "pos", "work_id", "score", "confidence"), "accepted")
        settled = now if settled is None else settled.unionByName(now)
    return settled if settled is not None else ready.select("ref_id", "pos", F.lit(None).cast("long").alias("work_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("confidence"))


def is_mixed_reference(text: Column) -> Column:
    """R-15: a block of several resources; shorter and with other markers than an aggregate of R-01."""
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(m)).cast("int") for m in MIXED_MARKERS), F.lit(0))
    return (F.length(text) > 900) & (hits >= 3)


# Markers of mixed blocks.
MIXED_MARKERS = ["books", "videos", "scientific article", "websites", "additional information"]
