"""Text, extraction, classification and matching queries, over pages, documents and synthesised citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X
from tessera.operators import analytics as A
from tessera.operators import classify as C
from tessera.operators import extract as E
from tessera.operators import match as M
from tessera.sources import readers as S

from .base import CITATIONS_SQL, citations, query, table, with_inputs

FOLD_SQL = r"trim(regexp_replace(lower(strip_accents(replace(replace(coalesce({x}, ''), 'ß', 'ss'), 'ẞ', 'ss'))), '[^a-z0-9]+', ' ', 'g'))"


def fold_sql(x: str) -> str:
    return FOLD_SQL.format(x=x)


def words_sql(folded: str, least: int, stop: list[str], digits: bool) -> str:
    stop_test = " AND t NOT IN (" + ", ".join(f"'{w}'" for w in stop) + ")" if stop else ""
    return f"list_filter(string_split({folded}, ' '), lambda t: length(t) > 0 AND (length(t) >= {least}{" OR regexp_full_match(t, '[0-9]+')" if digits else ''}){stop_test})"


@query(f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def sc01_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-01, SC-02, SC-03: texts folded to ASCII words."""
    return table(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query(f"""SELECT doc_id, len({words_sql('f', 4, X.ALIGNMENT_STOP, True)}) AS alignment, len({words_sql('f', 4, X.GAP_STOP, True)}) AS gap, len(list_distinct({words_sql('f', 3, X.MATCH_STOP, False)})) AS match,
  len(list_distinct({words_sql('f', 3, X.GAP_MATCH_STOP, False)})) AS gap_match, len(list_distinct({words_sql('f', 4, [], False)})) AS narrative FROM (SELECT doc_id, {fold_sql('text')} AS f FROM documents)""")
def sc04_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-04: sizes of the five token lists and sets of each text."""
    folded = table(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("f"))
    kinds = {"alignment": X.alignment_tokens, "gap": X.gap_tokens, "match": X.match_tokens, "gap_match": X.gap_match_tokens, "narrative": X.narrative_tokens}
    return folded.select("doc_id", *[F.size(t(F.col("f"))).cast("long").alias(n) for n, t in kinds.items()])


@query(with_inputs(r"""SELECT ref_id, array_to_string(list_sort(list_distinct(regexp_extract_all(reference_text, '\b(?:18|19|20)\d{2}\b'))), ';') AS years,
  coalesce((SELECT max(y::INT) FROM unnest(regexp_extract_all(reference_text, '\b(?:18[0-9]{2}|19[0-9]{2}|20[0-2][0-9])\b')) AS u(y) WHERE y::INT <= 1960),
           (SELECT min(y::INT) FROM unnest(regexp_extract_all(reference_text, '\b(?:18[0-9]{2}|19[0-9]{2}|20[0-2][0-9])\b')) AS u(y) WHERE y::INT <= 2026)) AS award_year FROM refs""", refs=CITATIONS_SQL))
def sc05_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-05, W-14: years of citations, and the one closest before an award."""
    text = F.col("reference_text")
    return citations(spark, sf_dir).select("ref_id", F.array_join(X.years(text).cast("array<string>"), ";").alias("years"), X.year_for_award(X.years(text, X.YEAR_CAPPED), F.lit(1960)).alias("award_year"))


DOI_SQL = r"""regexp_extract(reference_text, '(?i)\b10\.\d{4,9}/[^\s"<>]+')"""


@query(with_inputs(rf"""SELECT ref_id, lower(rtrim({DOI_SQL}, '.,;:)')) AS detected, lower(rtrim({DOI_SQL}, '.,;:)]}}')) AS matched,
  rtrim(regexp_replace(lower(trim(reference_text)), '^(?:https://doi\.org/|http://dx\.doi\.org/)', ''), '.,;)') AS registry,
  array_to_string(list_transform(regexp_extract_all(reference_text, '(?i)\b10\.\d{{4,9}}/[^\s"<>]+'), lambda d: rtrim(d, '.,;:)')), '; ') AS every FROM refs""", refs=CITATIONS_SQL))
def sc06_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-06, SC-08: identifiers under the different cleaning rules."""
    text = F.col("reference_text")
    return citations(spark, sf_dir).select("ref_id", X.find_doi(text).alias("detected"), X.find_doi(text, "matched").alias("matched"), X.bare_doi(text).alias("registry"), X.all_dois(text).alias("every"))


@query("SELECT p_partkey, '10.' || (1000 + p_partkey) || '/abc-' || p_size || '.' || p_partkey AS doi FROM part")
def sc07_repaired_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-07: identifiers that line breaks have cut, mended."""
    parts = table(spark, sf_dir, "part")
    broken = F.concat(F.lit("see 10."), (1000 + F.col("p_partkey")).cast("string"), F.lit("/\nabc- "), F.col("p_size").cast("string"), F.lit(" ."), F.col("p_partkey").cast("string"), F.lit(") and more"))
    return parts.select("p_partkey", X.repaired_doi(broken).alias("doi"))


@query(rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS raw_title FROM pages""")
def sc10_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-10: page titles, references not decoded so that SQL can follow."""
    raw = F.regexp_replace(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", X.squeezed(raw).alias("raw_title"))


def cleaned_sql(x: str) -> str:
    """A fragment's text with the four character references that the pages hold decoded, the ampersand last and also without its semicolon."""
    spaced = f"regexp_replace(regexp_replace({x}, '(?i)<br\\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    decoded = f"regexp_replace(replace(replace(replace({spaced}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g')"
    return f"trim(regexp_replace({decoded}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({cleaned_sql('html')})::INT AS n, {cleaned_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages")
def sc09_clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-09, SC-02: pages as text, references decoded."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(X.clean_html(F.col("html"))).alias("n"), X.page_title(F.col("html")).alias("title"))


@query(r"""SELECT doc_id, CASE WHEN length(s) <= 300 THEN s ELSE rtrim(substr(s, 1, 299)) || '...' END AS snippet, CASE WHEN length(s) <= 420 THEN s ELSE rtrim(substr(s, 1, 417)) || '...' END AS compact
  FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)""")
def sc13_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-11, SC-13: squeezed texts, clipped two ways."""
    s = X.squeezed(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.clipped(s, 300).alias("snippet"), X.clipped(s, 420, 3).alias("compact"))


@query(f"SELECT mark, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, substr({fold_sql('text')}, 1, 240) AS mark FROM documents) GROUP BY 1")
def sc14_fingerprint_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-14, W-09: one document of each fingerprint, the first."""
    marks = table(spark, sf_dir, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("mark"))
    return marks.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


NAMES_SQL = "SELECT c_custkey AS id, 'Jan ' || CASE c_custkey % 3 WHEN 0 THEN 'van ' ELSE '' END || split_part(c_mktsegment, ' ', 1) || ' ' || 'Muller' || c_nationkey AS full_name, c_nationkey AS nation FROM customer"


@query(with_inputs("""SELECT id, split_part(f, ' ', -1) AS last, CASE WHEN len(string_split(f, ' ')) >= 2 THEN array_to_string(string_split(f, ' ')[-2:], ' ') END AS two,
  CASE WHEN contains(f, ' van ') THEN substr(f, instr(f, ' van ') + 1) END AS particle FROM (SELECT id, lower(full_name) AS f FROM names)""", names=NAMES_SQL))
def sc15_family_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-15: family-name candidates: last part, last two, from the particle on."""
    names = spark.sql(NAMES_SQL.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    found = names.withColumn("c", X.family_names(F.col("full_name")))
    return found.select("id", F.element_at("c", 1).alias("last"), F.element_at("c", 2).alias("two"), F.get(F.filter("c", lambda x: x.startswith("van ")), 0).alias("particle"))


@query("""SELECT p_partkey, lower(split_part(p_name, ' ', -1)) AS comma, lower(split_part(p_name, ' ', 1)) AS plain FROM part""")
def sc16_dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-16: family names of a dataset: before the comma, or before short initials."""
    parts = table(spark, sf_dir, "part")
    first = F.split("p_name", " ")[0]
    return parts.select("p_partkey", X.dataset_family_name(F.concat(F.element_at(F.split("p_name", " "), -1), F.lit(", "), first)).alias("comma"), F.when(F.length(first) > 3, X.dataset_family_name(F.concat(first, F.lit(" JR")))).otherwise(F.lower(first)).alias("plain"))


@query("SELECT p_partkey, lower(p_brand) AS short, 'https://openalex.org/' || p_brand AS full_id FROM part")
def sc20_work_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-20: work ids as URLs and their last step."""
    full = X.work_id(F.concat(F.lit(" /"), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(X.short_id(full)).alias("short"), full.alias("full_id"))


@query("SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) || '_' || substr(sha1(url), 1, 10) AS name FROM pages")
def sc21_safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-21: file names from addresses."""
    return table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@query("SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>', 1), lambda x: x) AS targets FROM pages".replace("SELECT page_id, list_transform(", "SELECT page_id, pos - 1 AS pos, target FROM (SELECT page_id, unnest(t) AS target, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT page_id, list_transform(").replace("AS targets FROM pages", "AS t FROM pages))"))
def sc23_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-23: link targets in page order."""
    return E.links(table(spark, sf_dir, "pages"), ["page_id"], "html").select("page_id", "pos", "target")


@query(with_inputs(rf"""SELECT ref_id, 'pdf_link' AS clue_type, 'Report ' || ref_id AS clue_text, '/files/' || ref_id || '.PDF' AS href FROM refs
  UNION ALL SELECT ref_id, 'doi', every, '' FROM (SELECT *, array_to_string(list_transform(regexp_extract_all(t, '(?i)\b10\.\d{{4,9}}/[^\s"<>]+'), lambda d: rtrim(d, '.,;:)')), '; ') AS every FROM texts) WHERE every <> ''
  UNION ALL SELECT ref_id, 'reference_like', t, '' FROM texts WHERE regexp_matches(t, '(?i)\b10\.\d{{4,9}}/[^\s"<>]+') OR (regexp_matches(t, '\b(?:18|19|20)\d{{2}}\b') AND (({' OR '.join(f"contains(lower(t), '{w}')" for w in C.PAGE_KEYWORDS)})
    OR regexp_matches(lower(t), '\bet al\.?\b') OR regexp_matches(lower(t), '\bvol\.?\s*\d+')))""", refs=CITATIONS_SQL, texts=r"SELECT ref_id, trim(regexp_replace(reference_text, '\s+', ' ', 'g')) AS t FROM refs WHERE length(trim(regexp_replace(reference_text, '\s+', ' ', 'g'))) >= 30"))
def tx01_page_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-01, F-09: links to files, identifiers and reference-like blocks of pages, one made of each citation."""
    html = F.concat(F.lit("<body><p class=x>"), "reference_text", F.lit("</p><li>too short</li><a class=f href='/files/"), F.col("ref_id").cast("string"), F.lit(".PDF'>Report <b>"), F.col("ref_id").cast("string"), F.lit("</b></a><a href='/other'>no</a></body>"))
    return E.page_clues(citations(spark, sf_dir).select("ref_id", html.alias("html")), ["ref_id"], "html")


@query(r"""SELECT page_id, 'lecture' AS target_type, label, target_url FROM (SELECT *, row_number() OVER (PARTITION BY page_id, target_url ORDER BY pos) AS nth FROM (
  SELECT page_id, pos, trim(regexp_replace('Lecture ' || regexp_replace(label, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS label, regexp_extract(url, '^[a-z]+://[^/]+') || target AS target_url FROM (
    SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a href="([^"]*)">(.*?)</a>', 1)) AS target, unnest(regexp_extract_all(html, '(?is)<a href="([^"]*)">(.*?)</a>', 2)) AS label, unnest(range(0, len(regexp_extract_all(html, '(?is)<a href="([^"]*)">(.*?)</a>', 1)))) AS pos FROM pages))) WHERE nth = 1""")
def tx02_secondary_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-02, SC-22: links to known kinds of pages; every link is labelled here so that kinds occur."""
    html = F.regexp_replace("html", r"(<a href=\"[^\"]*\">)", "$1Lecture ")
    return E.secondary_targets(table(spark, sf_dir, "pages").withColumn("html", html), ["page_id"], "html", "url")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(html, '&', '+'), '(?i)<br\s*/?>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS said FROM pages")
def sc09_plain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-09: pages without character references as text."""
    return table(spark, sf_dir, "pages").select("page_id", X.clean_html(F.replace("html", F.lit("&"), F.lit("+"))).alias("said"))


@query(rf"""SELECT ref_id, {fold_sql(r"replace(replace(regexp_replace('Øre søk ' || reference_text || ' see https://x.example/Ab?c=' || ref_id || ' end', 'https?://[^\s]+', ' ', 'g'), 'ø', 'o'), 'Ø', 'o')")} AS folded FROM ({CITATIONS_SQL})""")
def sc03_fold_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-03: texts folded without addresses, slashed letters spelled out."""
    text = F.concat(F.lit("Øre søk "), "reference_text", F.lit(" see https://x.example/Ab?c="), F.col("ref_id").cast("string"), F.lit(" end"))
    return citations(spark, sf_dir).select("ref_id", X.fold_without_urls(text).alias("folded"))


@query(f"SELECT doc_id, trim({fold_sql('text')} || ' fin 1 2 x2') AS folded FROM documents")
def sc01_fold_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-01: folding with ligatures, fractions and raised digits taken apart."""
    return table(spark, sf_dir, "documents").select("doc_id", X.fold_exact(F.concat(F.coalesce("text", F.lit("")), F.lit(" ﬁn ½ x²"))).alias("folded"))


@query(r"SELECT doc_id, substr(regexp_replace(trim(regexp_replace(text || ' 12 (34) ', '\s+', ' ', 'g')), '\s+\d{1,3}\s*\(\d{1,3}\)\s*$', ''), 1, 1200) AS clipped FROM documents")
def sc12_unstamped_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-12: texts without their page stamp, clipped to 1,200 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", X.unstamped(F.concat("text", F.lit(" 12 (34) ")), 1200).alias("clipped"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS raw_title FROM pages")
def sc10_title_of_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-10: titles out of the bytes of pages, half of them in Latin-1."""
    content = F.when(F.col("page_id") % 2 == 0, F.encode("html", "ISO-8859-1")).otherwise(F.encode("html", "UTF-8"))
    raw = F.regexp_replace(F.regexp_extract(X.page_text(content), r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " ")
    return table(spark, sf_dir, "pages").select("page_id", X.squeezed(raw).alias("raw_title"))


LINES_SQL = r"""SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(range(0, len(l)::BIGINT)) AS line_no, unnest(list_transform(l, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(line) >= 20"""


@query(with_inputs("""SELECT doc_id, size, md5(chunk) AS mark FROM (SELECT doc_id, 1 AS size, line AS chunk FROM lines
  UNION ALL SELECT doc_id, 2, line || ' ' || lead(line, 1) OVER (PARTITION BY doc_id ORDER BY line_no) FROM lines
  UNION ALL SELECT doc_id, 3, line || ' ' || lead(line, 1) OVER (PARTITION BY doc_id ORDER BY line_no) || ' ' || lead(line, 2) OVER (PARTITION BY doc_id ORDER BY line_no) FROM lines) WHERE chunk IS NOT NULL""", lines=LINES_SQL))
def w08_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-08: windows of one to three lines of each document."""
    return E.line_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text").select("doc_id", "size", F.md5(F.col("chunk").cast("binary")).alias("mark"))


SECTION_SQL = """SELECT record_id, 'Intro. References' || chr(10) || string_agg('[' || ref_id || '] ' || reference_text, chr(10) ORDER BY ref_id) AS body FROM refs GROUP BY 1"""


@query(with_inputs(r"""SELECT record_id, count(*) AS items, sum(length(t))::BIGINT AS chars FROM (SELECT record_id, trim(regexp_replace(regexp_replace(trim(regexp_replace(reference_text, '\s+', ' ', 'g')), '^(?:\[\d+\]|\d+[\).])\s+', ''), '^', '')) AS raw,
    trim(regexp_replace(reference_text, '\s+', ' ', 'g')) AS t FROM refs) WHERE length(t) >= 25 AND (regexp_matches(t, '(?i)\b10\.\d{4,9}/[^\s"<>]+') OR regexp_matches(t, '\b(?:18|19|20)\d{2}\b')) GROUP BY 1""", refs=CITATIONS_SQL))
def tx04_reference_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-04, W-10, W-11: reference items after the last marker of a document, here one put together from a record's citations."""
    refs = citations(spark, sf_dir)
    lines = F.array_sort(F.collect_list(F.struct("ref_id", F.concat(F.lit("["), F.col("ref_id").cast("string"), F.lit("] "), "reference_text").alias("t"))))
    docs = refs.groupBy("record_id").agg(F.concat(F.lit("See references. Intro. References\n"), F.array_join(F.transform(lines, lambda p: p["t"]), "\n")).alias("body"))
    items, _ = E.document_references(docs, ["record_id"], "body")
    return items.groupBy("record_id").agg(F.count("*").alias("items"), F.sum(F.length("reference_text")).alias("chars"))


R01_SQL = rf"""SELECT *, CASE WHEN doi <> '' THEN 'doi_present' WHEN book AND NOT journal THEN 'book_or_chapter' WHEN journal AND len(ys) > 0 AND ys[1] < 1945 THEN 'historical_nonindexed_reference'
  WHEN journal AND len(ys) > 0 THEN 'likely_journal_article' ELSE 'needs_manual_review' END AS reference_class FROM (
  SELECT ref_id, pdf_type, record_id, reference_text, lower(rtrim({DOI_SQL}, '.,;:)')) AS doi, list_sort(list_distinct(list_transform(regexp_extract_all(reference_text, '\b(?:18|19|20)\d{{2}}\b'), lambda y: y::INT))) AS ys,
  regexp_matches(reference_text, '{C.BOOK_HINT}') AS book, regexp_matches(reference_text, '{C.JOURNAL_HINT}') OR regexp_matches(reference_text, '\b\d{{1,4}}\s*[:;,]\s*[A-Z]?\d{{1,5}}\b') AS journal
  FROM (SELECT * REPLACE (regexp_replace(trim(regexp_replace(reference_text, '\s+', ' ', 'g')), '\s+\d{{1,3}}\s*\(\d{{1,3}}\)\s*$', '') AS reference_text) FROM refs))"""


@query(with_inputs("SELECT ref_id, reference_class, doi AS detected_doi, array_to_string(ys, ';') AS detected_years, CASE reference_class WHEN 'doi_present' THEN '1' WHEN 'book_or_chapter' THEN '4' WHEN 'historical_nonindexed_reference' THEN '3' WHEN 'likely_journal_article' THEN '2' ELSE '5' END AS matching_priority FROM classified", refs=CITATIONS_SQL, classified=R01_SQL))
def r01_reference_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-01, SC-12: citations classified."""
    return citations(spark, sf_dir).select("ref_id", *C.reference_class(F.col("reference_text"))).select("ref_id", "reference_class", "detected_doi", "detected_years", "matching_priority")


@query(with_inputs(f"SELECT ref_id, f = '' OR contains(f, 'delivered in stockholm') OR contains(f, 'nobel lecture entitled') OR (SELECT count(*) FROM (VALUES {', '.join(f"('{b}')" for b in C.BOILERPLATE)}) v(b) WHERE contains(f, b)) >= 2 AS boilerplate FROM (SELECT ref_id, {fold_sql('reference_text')} AS f FROM refs)", refs=CITATIONS_SQL))
def f04_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-04, F-03: references that are boilerplate."""
    return citations(spark, sf_dir).select("ref_id", C.is_boilerplate(F.col("reference_text")).alias("boilerplate"))


def keyword_sql(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(reference_text), '{w}')" for w in words) + ")"


@query(with_inputs(rf"""SELECT ref_id, d OR (y AND ({keyword_sql(C.PAGE_KEYWORDS)} OR regexp_matches(lower(reference_text), '\bet al\.?\b') OR regexp_matches(lower(reference_text), '\bvol\.?\s*\d+'))) AS on_page,
  d OR (y AND ({keyword_sql(C.FILE_KEYWORDS)} OR contains(lower(reference_text), 'et al') OR regexp_matches(reference_text, '^\s*(?:\[\d+\]|\d+[\).])\s+'))) AS in_file
  FROM (SELECT *, regexp_matches(reference_text, '(?i)\b10\.\d{{4,9}}/[^\s"<>]+') AS d, regexp_matches(reference_text, '\b(?:18|19|20)\d{{2}}\b') AS y FROM refs)""", refs=CITATIONS_SQL))
def f09_reference_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-09, F-10: which citations look like references, by the page's and the document's rules."""
    text = F.col("reference_text")
    return citations(spark, sf_dir).select("ref_id", C.page_reference_like(text).alias("on_page"), C.file_reference_like(text).alias("in_file"))


@query("""SELECT p_partkey, CASE WHEN contains(x, 'advanced') OR contains(x, 'scientific background') THEN 'scientific_background' WHEN contains(x, 'popular') THEN 'popular_background' WHEN contains(x, 'lecture') THEN 'nobel_lecture'
  WHEN contains(x, 'press') THEN 'press_release' ELSE 'other_pdf' END AS pdf_type, NOT contains(x, 'image') AND p_partkey % 2 = 0 AS wanted FROM (SELECT p_partkey,
  CASE p_partkey % 6 WHEN 0 THEN 'advanced' WHEN 1 THEN 'popular' WHEN 2 THEN 'lecture' WHEN 3 THEN 'press' WHEN 4 THEN 'image' ELSE 'other' END || ' ' || p_name AS x FROM part)""")
def r02_file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-02, F-08: kinds of files and which to fetch."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Advanced", "popular", "lecture", "press", "image", "other")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    label, href = F.concat(kind, F.lit(" "), "p_name"), F.when(F.col("p_partkey") % 2 == 0, "a.PDF").otherwise("a.html")
    return table(spark, sf_dir, "part").select("p_partkey", C.file_type(label, href).alias("pdf_type"), C.wanted_file(label, href).alias("wanted"))


GAP_SQL = rf"""SELECT c.*, cy, 1990 AS award, len(list_intersect({words_sql('rf', 4, X.GAP_STOP, True)}, {words_sql('mf', 4, X.GAP_STOP, True)})) AS overlap FROM (
  SELECT *, {fold_sql('reference_text')} AS rf, {fold_sql('m')} AS mf, coalesce(list_max(list_filter(ys, lambda y: y <= 1990)), list_min(ys)) AS cy
  FROM classified JOIN (SELECT p_partkey % 97 AS rid, min(p_name) AS m FROM part GROUP BY 1) ON rid = record_id) c"""


@query(with_inputs("""SELECT ref_id, score, CASE WHEN score >= 22 THEN 'A_high_priority_official_gap_candidate' WHEN score >= 14 THEN 'B_reviewable_official_gap_candidate' WHEN score >= 7 THEN 'C_low_signal_official_gap_candidate' ELSE 'D_hold_for_manual_triage' END AS gap_tier
  FROM (SELECT ref_id, (CASE reference_class WHEN 'doi_present' THEN 8 WHEN 'likely_journal_article' THEN 6 WHEN 'historical_nonindexed_reference' THEN 5 WHEN 'needs_manual_review' THEN 2 ELSE 0 END
   + CASE WHEN pdf_type = 'scientific_background' THEN 4 WHEN contains(pdf_type, 'lecture') THEN 2 ELSE 0 END
   + CASE WHEN cy IS NULL THEN 0 WHEN award - cy < 0 THEN -5 WHEN award - cy <= 5 THEN 7 WHEN award - cy <= 25 THEN 6 ELSE 5 END + least(overlap, 6) * 2 + CASE WHEN doi <> '' THEN 3 ELSE 0 END)::INT AS score FROM gap)""", refs=CITATIONS_SQL, classified=R01_SQL, gap=GAP_SQL))
def s04_gap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-04, R-14, J-04: scores and tiers of references for records without candidates."""
    refs = citations(spark, sf_dir)
    classified = refs.select("ref_id", "record_id", "pdf_type", "reference_text", *C.reference_class(F.col("reference_text")))
    motive = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 97).alias("record_id")).agg(F.min("p_name").alias("m")).withColumn("motive", F.array_distinct(X.gap_tokens(X.fold(F.col("m")))))
    rows = classified.join(motive, "record_id").withColumn("tokens", F.array_distinct(X.gap_tokens(X.fold(X.unstamped(F.col("reference_text"))))))
    candidate = X.year_for_award(X.years(X.unstamped(F.col("reference_text"))), F.lit(1990))
    score = M.gap_score(F.col("reference_class"), F.col("pdf_type"), candidate, F.lit(1990), F.size(F.array_intersect("tokens", "motive")), F.lit(False), F.col("detected_doi"))
    return rows.select("ref_id", score.alias("score")).withColumn("gap_tier", M.gap_tier(F.col("score")))


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE contains('name' || (c_custkey % 13), 'name' || (s_suppkey % 13)) """)
def j03_name_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-03: rows of one nation linked by family name, equal or contained."""
    left = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.concat(F.lit("Jan Name"), (F.col("c_custkey") % 13).cast("string")).alias("full_name"))
    right = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.concat(F.lit("NAME"), (F.col("s_suppkey") % 13).cast("string"), F.lit(", J")).alias("dataset_name"))
    return M.name_linkage(left, right, ["nation"], "full_name", "dataset_name").select("c_custkey", "s_suppkey")


@query(with_inputs("""SELECT item_id, doc_id, containment, CASE WHEN containment >= 0.75 THEN 'A' WHEN containment >= 0.6 THEN 'B' WHEN containment >= 0.45 THEN 'C' ELSE 'D' END AS confidence FROM (
  SELECT item_id, doc_id, containment, row_number() OVER (PARTITION BY item_id ORDER BY containment DESC, doc_id) AS place FROM (
    SELECT b.item_id, d.doc_id, len(list_intersect(b.t, d.t)) / len(b.t) AS containment FROM b JOIN d ON len(list_intersect(b.t, d.t)) > 0)) WHERE place = 1""",
    b=f"SELECT item_id, list_distinct({words_sql(fold_sql('text'), 3, X.MATCH_STOP, False)}) AS t FROM benchmark", d=f"SELECT doc_id, list_distinct({words_sql(fold_sql('text'), 3, X.MATCH_STOP, False)}) AS t FROM documents"))
def j13_best_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13, S-05, R-13: the document that holds most of each item's tokens, of all documents."""
    tokens = lambda c: X.match_tokens(X.fold(F.col(c)))
    items = table(spark, sf_dir, "benchmark").select("item_id", tokens("text").alias("bt"))
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("dt"))
    found = M.best_containment(items, "item_id", "bt", docs, "doc_id", "dt")
    best = found.select("item_id", "doc_id", (F.col("shared") / F.col("size")).alias("containment"))
    confidence = F.when(F.col("containment") >= 0.75, "A").when(F.col("containment") >= 0.6, "B").when(F.col("containment") >= 0.45, "C").otherwise("D")
    return best.withColumn("confidence", confidence)


@query(with_inputs("""SELECT ref_id, n, s1, s2, CASE WHEN doi THEN 'A' WHEN title >= 0.75 AND y THEN 'A' WHEN title >= 0.6 AND y THEN 'B' WHEN title >= 0.45 AND (y OR source >= 0.995) THEN 'C' ELSE 'D' END AS confidence,
    CASE WHEN title >= 0.75 AND y THEN 'A' WHEN title >= 0.6 AND y THEN 'B' WHEN s2 >= 65 AND y THEN 'C' END AS accepted
  FROM (SELECT *, CASE WHEN doi THEN 70.0 ELSE 0 END + 10 + CASE WHEN y THEN 15.0 ELSE 0 END + 60 * title + CASE WHEN source >= 0.5 THEN 10.0 ELSE 0 END + least(n, 100.0) / 100 AS s1,
    10 + CASE WHEN y THEN 20.0 ELSE 0 END + 70 * title + CASE WHEN source >= 0.5 THEN 10.0 ELSE 0 END AS s2
  FROM (SELECT ref_id, (ref_id % 150)::DOUBLE AS n, ref_id % 7 = 0 AS doi, ref_id % 3 > 0 AS y, (ref_id % 11) / 10 AS title, (ref_id % 5) / 4 AS source FROM refs))""", refs=CITATIONS_SQL))
def s01_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-01, S-02, S-03, R-13: scores and confidence over a grid of overlaps."""
    rows = citations(spark, sf_dir).select("ref_id", (F.col("ref_id") % 150).cast("double").alias("n"), (F.col("ref_id") % 7 == 0).alias("doi"), (F.col("ref_id") % 3 > 0).alias("y"), (F.col("ref_id") % 11 / 10).alias("title"), (F.col("ref_id") % 5 / 4).alias("source"))
    c = F.col
    rows = rows.withColumn("s1", M.bibliographic_score(c("doi"), F.lit(True), c("y"), c("title"), c("source"), c("n"))).withColumn("s2", M.search_score(F.lit(True), c("y"), c("title"), c("source")))
    return rows.select("ref_id", "n", "s1", "s2", M.match_confidence(c("doi"), c("title"), c("y"), c("source"))[0], M.search_acceptance(c("title"), c("y"), c("s2")).alias("accepted"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'no_match' WHEN c_custkey IS NOT NULL THEN 'matched_first' WHEN s_suppkey IS NOT NULL THEN 'matched_second' ELSE 'no_match' END AS match_status,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE coalesce(c_name, s_name) END AS name FROM (SELECT o_orderkey, o_custkey, o_custkey % 211 AS k FROM orders)
  LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = k AND o_custkey % 5 <> 0 LEFT JOIN supplier ON s_suppkey = k AND o_custkey % 5 <> 0""")
def j14_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-14, SRC-08: exact lookup in one source, in a second where the first has nothing; each key once."""
    key = F.when(F.col("o_custkey") % 5 == 0, "").otherwise((F.col("o_custkey") % 211).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"))
    first = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"))
    return M.cascade(rows, "key", first, second, ["name"]).select("o_orderkey", "match_status", "name")


NAMED_SQL = r"(?:Phys\.|Physical Review|Nature|Science|Cell|Lancet|PNAS|Proc\.|Rev\.)"
TITLES_SQL = " || ".join(f"regexp_extract_all(t, '{p}{NAMED_SQL}', 1)" for p in (r"\),\s*([^,]{25,220}?),\s*", r"\.\s*([^\.]{25,220}?)\.\s*", r"\.\s*([^\.]{25,220}?),\s*"))


@query(with_inputs(f"""SELECT ref_id, list_filter(found, lambda q, i: list_position(found, q) = i)[1:4] AS queries FROM (
  SELECT ref_id, list_filter(list_transform({TITLES_SQL}, lambda q: trim(q, ' .,;:')), lambda q: len(list_distinct({words_sql(fold_sql("replace(replace(q, 'ø', 'o'), 'Ø', 'o')"), 3, X.GAP_MATCH_STOP, False)})) >= 4) || [t] AS found
  FROM (SELECT ref_id, trim(regexp_replace(reference_text, '\\s+', ' ', 'g')) AS t FROM cited))""", refs=CITATIONS_SQL,
    cited=r"SELECT ref_id, 'Smith (ed.), A study of ' || title || ' and its many uses, Nature ' || reference_text || '. On ' || title || ' in several large rooms. Science 3' AS reference_text FROM refs"))
def sc18_candidate_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-18: searches for citations, put into sentences whose titles the patterns find."""
    text = F.concat(F.lit("Smith (ed.), A study of "), "title", F.lit(" and its many uses, Nature "), "reference_text", F.lit(". On "), "title", F.lit(" in several large rooms. Science 3"))
    return citations(spark, sf_dir).select("ref_id", M.candidate_queries(text).alias("queries"))


@query(with_inputs(f"""SELECT doc_id, line, score, place FROM (SELECT doc_id, line, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(line), line_no) AS place FROM (
  SELECT doc_id, line_no, line, len(list_intersect(list_distinct({words_sql(fold_sql('line'), 4, X.ALIGNMENT_STOP, True)}), t)) + CASE WHEN line_no = 0 THEN 1 ELSE 0 END AS score
  FROM lines JOIN (SELECT doc_id, list_distinct({words_sql(fold_sql('context'), 4, X.ALIGNMENT_STOP, True)}) AS t FROM (SELECT doc_id, b.text AS context FROM documents JOIN benchmark b ON item_id = doc_id % (SELECT count(*) FROM benchmark))) USING (doc_id))) WHERE place <= 3""", lines=LINES_SQL))
def w12_top_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-12, S-06: the three lines of each document that share most terms with a context of its own, here one of the benchmark's texts."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    contexts = items.select("item_id", F.array_distinct(X.alignment_tokens(X.fold(F.col("text")))).alias("terms"))
    terms = docs.select("doc_id").join(contexts, F.col("doc_id") % items.count() == F.col("item_id")).select("doc_id", "terms")
    lines = E.lines(docs, ["doc_id"], "text").join(terms, "doc_id")
    return E.top_snippets(lines, "doc_id", "line", "terms", F.col("line_no") == 0, "line_no").select("doc_id", "line", "score", "place")


@query("SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN 'http_error' ELSE 'ok' END AS fetch_status FROM pages WHERE page_id % 4 <> 0 AND page_id % 3 = 0 AND html <> ''")
def f02_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-01, F-02: rows of a status and kind with content."""
    status = F.when(F.col("page_id") % 4 == 0, "http_error").otherwise("ok")
    rows = table(spark, sf_dir, "pages").withColumn("fetch_status", status).withColumn("target_type", F.when(F.col("page_id") % 3 == 0, "facts").otherwise("summary"))
    return rows.where((F.col("fetch_status") == "ok") & F.col("target_type").isin("facts") & (F.col("html") != "")).select("page_id", "url", "fetch_status")


@query("SELECT event_id, (props::JSON->>'k')::INT AS k, substr(sha256(props), 1, 24) AS cache_key FROM events")
def src04_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, SRC-07: nested documents read under a schema, with their cache keys."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.substring(F.sha2("props", 256), 1, 24).alias("cache_key"))


#: Customers in a row that a page of prizes is made of, as an interface gives its results by pages: no payload holds more laureates, however many a nation has.
PAGE_BITS = 6
PAGE_CUSTOMERS = 1 << PAGE_BITS


def prize_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a nation's prize with at most PAGE_CUSTOMERS laureates each, as nested payloads."""
    key, en = F.col("c_custkey").cast("string"), lambda c: F.struct(c.alias("en"))
    place = lambda n: F.struct(en(F.concat(F.lit(n), key)).alias("name"), en(F.col("n_name")).alias("country"))
    links = F.array(F.struct(F.lit("self").alias("rel"), F.lit("https://api.example").alias("href")), F.struct(F.when(F.col("c_custkey") % 5 > 0, "external").otherwise("other").alias("rel"), F.concat(F.lit("https://x.example/"), key).alias("href")))
    laureate = F.struct(
        key.alias("id"), F.when(F.col("c_custkey") % 3 > 0, en(F.col("c_name"))).alias("fullName"), en(F.concat(F.lit("known "), key)).alias("knownName"),
        F.when(F.col("c_custkey") % 4 > 0, F.array(place("first "), place("second "))).alias("affiliations"), links.alias("links"),
    )
    # Pages are numbered on the scan, before any exchange: how customers fall into pages changes no row of the result.
    customers = table(spark, sf_dir, "customer").withColumn("page", F.shiftright(F.monotonically_increasing_id(), PAGE_BITS))
    pages = table(spark, sf_dir, "nation").join(customers, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "page").agg(F.collect_list(laureate).alias("laureates"))
    category = F.element_at(F.array(F.lit("Physics"), F.lit("Chemistry"), F.lit("Peace")), F.col("n_nationkey") % 3 + 1)
    prize = F.struct((1901 + F.col("n_nationkey")).cast("string").alias("awardYear"), en(category).alias("category"), "laureates")
    return pages.select(F.to_json(F.struct(F.array(prize).alias("nobelPrizes"))).alias("value"))


@query("""SELECT c_custkey::VARCHAR AS laureate_id, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_name END, 'known ' || c_custkey) AS full_name, (1901 + n_nationkey)::VARCHAR AS award_year, CASE n_nationkey % 3 WHEN 0 THEN 'Physics' ELSE 'Chemistry' END AS category,
  CASE WHEN c_custkey % 4 > 0 THEN 'first ' || c_custkey END AS affiliation_name, CASE WHEN c_custkey % 4 > 0 THEN n_name END AS affiliation_country, CASE WHEN c_custkey % 5 > 0 THEN 'https://x.example/' || c_custkey END AS nobel_url
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 < 2""")
def src04_prize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, F-01, J-02, J-20: prizes with their laureates, as nested payloads, flattened to one row a prize and laureate with the first affiliation and the external link."""
    rows = S.prize_rows(prize_payloads(spark, sf_dir), ["Physics", "Chemistry"])
    return rows.select("laureate_id", "full_name", "award_year", "category", "affiliation_name", "affiliation_country", "nobel_url")


def token_list_sql(x: str) -> str:
    return f"list_distinct({words_sql(fold_sql(x), 3, X.MATCH_STOP, False)})"


@query(with_inputs("""SELECT ref_id, pos, work_id, score, confidence FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY pos) AS k FROM (
    SELECT *, CASE WHEN title >= 0.75 AND y THEN 'A' WHEN title >= 0.6 AND y THEN 'B' WHEN score >= 65 AND y THEN 'C' END AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY ref_id, pos ORDER BY score DESC, work_id) AS place FROM (
        SELECT ref_id, pos, work_id, title, y, 10.0 + CASE WHEN y THEN 20.0 ELSE 0 END + 70 * title + CASE WHEN src >= 0.5 THEN 10.0 ELSE 0 END AS score FROM (
          SELECT q.ref_id, q.pos, w.work_id, w.wy = q.cited_year AS y, CASE WHEN len(wt) > 0 THEN len(list_intersect(wt, rt)) / len(wt) ELSE 0 END AS title, CASE WHEN len(ws) > 0 THEN len(list_intersect(ws, rt)) / len(ws) ELSE 0 END AS src
          FROM q JOIN w ON list_has_any(q.qt, w.wt)))) WHERE place = 1) WHERE confidence IS NOT NULL) WHERE k = 1""",
    refs=CITATIONS_SQL,
    w=f"SELECT p_partkey AS work_id, {token_list_sql("p_name")} AS wt, {token_list_sql('p_brand')} AS ws, 1900 + p_partkey * 7 % 125 AS wy FROM part",
    q=f"SELECT ref_id, 0 AS pos, cited_year, {token_list_sql("title")} AS qt, {token_list_sql("reference_text")} AS rt FROM refs UNION ALL SELECT ref_id, 1, cited_year, {token_list_sql("reference_text")}, {token_list_sql("reference_text")} FROM refs"))
def j15_search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-15, S-02, S-03: the first search of each citation with an acceptable hit among all works, titles before whole texts; years are derived, so that searches miss."""
    tokens = lambda c: X.match_tokens(X.fold(F.col(c)))
    refs = citations(spark, sf_dir).select("ref_id", F.array(F.col("cited_year").cast("long")).alias("years"), tokens("reference_text").alias("ref_tokens"), F.array(tokens("title"), tokens("reference_text")).alias("q"))
    queries = refs.select("ref_id", "years", "ref_tokens", F.posexplode("q").alias("pos", "query_tokens"))
    year = 1900 + F.col("p_partkey") * 7 % 125
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work_id"), tokens("p_name").alias("title_tokens"), tokens("p_brand").alias("source_tokens"), year.alias("year"), F.lit(True).alias("article"))
    return M.search_cascade(queries, works)


@query(with_inputs("SELECT record_id, ref_id, row_number() OVER (PARTITION BY record_id ORDER BY (ref_id * 7919) % 31 DESC, ref_id) AS place FROM refs", refs=CITATIONS_SQL))
def o05_gap_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-05: all references of each record by falling score, then id; places come from sorted ranges, so that no record is one task."""
    rows = citations(spark, sf_dir).select("record_id", "ref_id", (F.col("ref_id") * 7919 % 31).alias("score"))
    return A.placed(rows, ["record_id"], [F.col("score").desc(), F.col("ref_id")]).select("record_id", "ref_id", (F.col("_at") + 1).alias("place"))


@query(f"""SELECT a.doc_id, len(list_intersect(a.t, b.t)) AS shared, len(list_distinct(list_concat(a.t, b.t))) AS either FROM (SELECT doc_id, {token_list_sql('text')} AS t FROM documents) a JOIN (SELECT doc_id, {token_list_sql('text')} AS t FROM documents) b ON b.doc_id = a.doc_id + 1""")
def u03_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-03, U-04: tokens that neighbouring documents share, and those of either."""
    docs = table(spark, sf_dir, "documents").select("doc_id", X.match_tokens(X.fold(F.col("text"))).alias("t"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return docs.join(after, "doc_id").select("doc_id", F.size(F.array_intersect("t", "u")).cast("long").alias("shared"), F.size(F.array_union("t", "u")).cast("long").alias("either"))


@query(with_inputs(rf"""SELECT record_id, count(*) AS chunks FROM (SELECT DISTINCT record_id, trim(regexp_replace(reference_text, '\s+', ' ', 'g')) AS chunk FROM (
    SELECT *, regexp_matches(reference_text, '(?i)\b10\.\d{{4,9}}/[^\s"<>]+') AS d, regexp_matches(reference_text, '\b(?:18|19|20)\d{{2}}\b') AS y FROM refs)
   WHERE length(chunk) >= 20 AND (d OR (y AND ({keyword_sql(C.FILE_KEYWORDS)} OR contains(lower(reference_text), 'et al') OR regexp_matches(reference_text, '^\s*(?:\[\d+\]|\d+[\).])\s+'))))) GROUP BY 1""", refs=CITATIONS_SQL))
def tx03_reference_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX-03, F-10: reference-like chunks of documents; every citation is a page of one line here."""
    pages = citations(spark, sf_dir).select("record_id", "ref_id", "reference_text")
    chunks = E.reference_chunks(pages, ["record_id", "ref_id"], "reference_text")
    return chunks.select("record_id", "chunk").distinct().groupBy("record_id").agg(F.count("*").alias("chunks"))


@query(with_inputs("SELECT record_id, sum(length(body)) > 0 AS filled, sum(length(body)) > 900 AND max(hits) >= 3 AS mixed FROM (SELECT record_id, string_agg(lower(reference_text), ' ' ORDER BY ref_id) AS body, (contains(string_agg(lower(reference_text), ' '), 'books'))::INT + (contains(string_agg(lower(reference_text), ' '), 'videos'))::INT + (contains(string_agg(lower(reference_text), ' '), 'scientific article'))::INT + (contains(string_agg(lower(reference_text), ' '), 'websites'))::INT + (contains(string_agg(lower(reference_text), ' '), 'additional information'))::INT AS hits FROM refs GROUP BY 1) GROUP BY 1", refs=CITATIONS_SQL))
def r15_mixed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-15: long blocks with several markers, put together from a record's citations."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "reference_text"))), lambda p: p["reference_text"])
    blocks = citations(spark, sf_dir).groupBy("record_id").agg(F.array_join(texts, " ").alias("body"))
    return blocks.select("record_id", (F.length("body") > 0).alias("filled"), M.is_mixed_reference(F.col("body")).alias("mixed"))


@query("SELECT c_custkey, CASE WHEN length(f) >= 4 THEN f END AS family, 'laureate: ' || c_name || ' prize paper ' || (1900 + c_custkey % 120) AS search FROM (SELECT *, split_part(lower(c_mktsegment), ' ', 1) AS f FROM customer)")
def sc17_name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC-17, SC-19: the family name that the gap tokeniser leaves, and a search phrase from a template."""
    phrase = F.format_string("laureate: %s prize paper %d", F.col("c_name"), 1900 + F.col("c_custkey") % 120)
    name = X.gap_name_tokens(F.concat(F.lit("Jo van "), F.split("c_mktsegment", " ")[0]))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(name, F.lit(0)).alias("family"), phrase.alias("search"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'https://x.example/facts/' || year(o_orderdate) ELSE 'https://x.example/built/' || o_orderkey END AS url FROM orders")
def j02_fact_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-02, J-20: the facts link of the prize of a year inside nested prizes, else a built one."""
    year = F.year("o_orderdate").cast("string")
    link = lambda y, kind: F.struct(F.concat(F.lit("https://x.example/facts/"), y).alias("href"), F.array(F.lit(kind)).alias("class"))
    prize = lambda y, kind: F.struct(y.alias("awardYear"), F.array(link(y, "other"), link(y, kind)).alias("links"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "laureate facts").otherwise("none")
    prizes = F.array(prize(F.lit("1900"), "laureate facts"), F.struct(year.alias("awardYear"), F.array(F.struct(F.concat(F.lit("https://x.example/facts/"), year).alias("href"), F.array(kind).alias("class"))).alias("links")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", year.alias("y"), prizes.alias("prizes"))
    return rows.select("o_orderkey", S.fact_url(F.col("prizes"), F.col("y"), F.concat(F.lit("https://x.example/built/"), F.col("o_orderkey").cast("string"))).alias("url"))
