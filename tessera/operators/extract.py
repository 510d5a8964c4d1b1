"""Text extraction: rows of links, blocks, lines and reference items out of pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as X

from .classify import file_reference_like, page_reference_like

# Shapes of elements, markers of sections, beginnings of items.
LINK = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
OPTION = r"""(?is)<option\b[^>]*value=["']([^"']+)["'][^>]*>(.*?)</option>"""
BLOCK = r"(?is)<(?:p|li|td|h[1-6])\b[^>]*>(.*?)</(?:p|li|td|h[1-6])>"
MARKERS = "references|further reading|selected literature|bibliography"
ITEM_START = r"^\s*(?:\[\d+\]|\d+[\).])\s+"
LEAST_BLOCK, LEAST_LINE, LEAST_REFERENCE = 30, 20, 25
#: Lines of a segment: longer documents are worked on in several tasks.
SEGMENT_LINES = 4096
# Labels of secondary pages, in the order in which they are tried.
TARGET_LABELS = [
    ("nobel prize lecture", "lecture"),
    ("lecture", "lecture"),
    ("biographical", "biographical"),
    ("article", "article"),
    ("other resources", "other_resources"),
    ("perspectives", "perspectives"),
    ("speed read", "speedread"),
]


def paired(x: Column, pattern: str) -> Column:
    """Both groups of every match, as structs."""
    firsts, seconds = (F.regexp_extract_all(x, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.arrays_zip(firsts.alias("target"), seconds.alias("label"))


def links(pages: DataFrame, keys: list[str], html: str, pattern: str = LINK) -> DataFrame:
    """SC-23: targets and labels of links (or options), in page order."""
    found = pages.select(*keys, F.posexplode(paired(F.col(html), pattern)).alias("pos", "m"))
    return found.select(*keys, "pos", F.col("m.target").alias("target"), F.col("m.label").alias("raw_label"))


def blocks(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Texts of blocks of at least LEAST_BLOCK characters, each once a page, in page order."""
    found = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1))).alias("pos", "raw"))
    cleaned = found.withColumn("text", X.clean_html(F.col("raw"))).where(F.length("text") >= LEAST_BLOCK)
    return cleaned.groupBy(*keys, "text").agg(F.min("pos").alias("pos"))


def page_clues(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """TX-01: links to files, identifiers and reference-like blocks of pages."""
    files = links(pages, keys, html).where(F.contains(F.lower("target"), F.lit(".pdf"))).select(*keys, F.lit("pdf_link").alias("clue_type"), X.clean_html(F.col("raw_label")).alias("clue_text"), F.col("target").alias("href"))
    texts = blocks(pages, keys, html)
    dois = texts.withColumn("clue_text", X.all_dois(F.col("text"))).where("clue_text != ''").select(*keys, F.lit("doi").alias("clue_type"), "clue_text", F.lit("").alias("href"))
    likely = texts.where(page_reference_like(F.col("text"))).select(*keys, F.lit("reference_like").alias("clue_type"), F.col("text").alias("clue_text"), F.lit("").alias("href"))
    return files.unionByName(dois).unionByName(likely)


def label_type(label: Column) -> Column:
    """The first label of the dictionary that a text contains."""
    low, out = F.lower(F.trim(label)), None
    for needle, kind in TARGET_LABELS:
        hit = F.contains(low, F.lit(needle))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("")


def secondary_targets(pages: DataFrame, keys: list[str], html: str, url: str) -> DataFrame:
    """TX-02: links and options of a page that lead to known kinds of pages; each target once."""
    both = links(pages.select(*keys, html, url), [*keys, url], html).withColumn("kind", F.lit(0)).unionByName(links(pages.select(*keys, html, url), [*keys, url], html, OPTION).withColumn("kind", F.lit(1)))
    label = F.regexp_replace(X.clean_html(F.col("raw_label")), r"^\s*--\s*", "")
    typed = both.withColumn("label", label).withColumn("target_type", label_type(F.col("label"))).where("target_type != ''").withColumn("resolved", X.resolve_url(F.col(url), X.unescape(F.col("target"))))
    order = Window.partitionBy(*keys, "resolved").orderBy("kind", "pos")
    return typed.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(*keys, "target_type", "label", F.col("resolved").alias("target_url"))


def lines(docs: DataFrame, keys: list[str], text: str, least: int = LEAST_LINE) -> DataFrame:
    """Squeezed lines of a least length, numbered."""
    found = docs.select(*keys, F.posexplode(F.split(F.col(text), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085  ]")).alias("line_no", "raw"))
    return found.withColumn("line", X.squeezed(F.col("raw"))).where(F.length("line") >= least).drop("raw")


def _segmented(kept: DataFrame) -> DataFrame:
    return kept.withColumn("_segment", F.floor(F.col("line_no") / SEGMENT_LINES))


def _long(docs: DataFrame, text: str) -> DataFrame:
    """Documents that can have more than one segment: of so many bytes, a line break has one at least."""
    return docs.where(F.octet_length(text) >= SEGMENT_LINES)


def line_chunks(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """W-08: windows of one, two and three lines.

    Windows are made inside segments of a document; a segment's last lines go on with the first two of what follows, which are looked up only for documents of several
    segments. So a document of a million lines is hundreds of tasks' work."""
    kept = _segmented(lines(docs, keys, text))
    order = Window.partitionBy(*keys, "_segment").orderBy("line_no")
    of = [f"_of{k}" for k in range(len(keys))]
    later = _segmented(lines(_long(docs, text), keys, text)).where(F.col("_segment") > 0).select(*[F.col(k).alias(n) for k, n in zip(keys, of, strict=True)], "line_no", "_segment", "line")
    # Two lines a segment.
    heads = later.withColumn("_nth", F.row_number().over(Window.partitionBy(*of, "_segment").orderBy("line_no"))).where("_nth <= 2")
    along = Window.partitionBy(*of).orderBy("line_no")
    follows = heads.select(*of, "_nth", "_segment", F.col("line").alias("_next1"), F.lead("line").over(along).alias("_next2"), F.coalesce(F.lag("_segment").over(along), F.lit(0)).alias("_since")).where("_nth = 1")
    carried = follows.select(*of, "_next1", "_next2", F.explode(F.sequence("_since", F.col("_segment") - 1)).alias("_after"))
    same = F.col("_segment") == F.col("_after")
    for k, n in zip(keys, of, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    wide = kept.withColumns({"_two": F.lead("line", 1).over(order), "_three": F.lead("line", 2).over(order)}).join(carried, same, "left")
    two, three = F.coalesce("_two", "_next1"), F.coalesce("_three", F.when(F.col("_two").isNotNull(), F.col("_next1")).otherwise(F.col("_next2")))
    wide = wide.select(*keys, "line_no", "line", two.alias("two"), three.alias("three"))
    joined = [F.col("line"), F.when(F.col("two").isNotNull(), F.concat_ws(" ", "line", "two")), F.when(F.col("three").isNotNull(), F.concat_ws(" ", "line", "two", "three"))]
    exploded = wide.select(*keys, "line_no", F.posexplode(F.array(*joined)).alias("size", "chunk")).where("chunk is not null")
    return exploded.withColumn("size", F.col("size") + 1)


def reference_chunks(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """TX-03: chunks of a document's lines that look like references, each once."""
    return line_chunks(docs, keys, text).where(file_reference_like(F.col("chunk"))).select(*keys, "chunk").distinct()


def reference_section(text: Column) -> tuple[Column, Column]:
    """W-11: the last marker and what follows it."""
    pattern = rf"(?is)^.*\b({MARKERS})\b(.*)$"
    return F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)


def numbered_items(docs: DataFrame, keys: list[str], section: str) -> DataFrame:
    """W-10: lines gathered into items that start at numbered lines; what is before the first number is an item too. Items need some length and a year or identifier.

    Items are counted inside segments of a document and moved on by those of the segments before; an item goes on over their borders."""
    kept = _segmented(lines(docs, keys, section, least=1)).withColumn("_starts", F.col("line").rlike(ITEM_START).cast("int"))
    within = F.sum("_starts").over(Window.partitionBy(*keys, "_segment").orderBy("line_no"))
    # Items of the segments before, for documents of several segments: one row a segment.
    of = [f"_of{k}" for k in range(len(keys))]
    counts = _segmented(lines(_long(docs, section), keys, section, least=1)).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, of, strict=True)], F.col("_segment").alias("_in")).agg(F.sum(F.col("line").rlike(ITEM_START).cast("int")).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*of).orderBy("_in").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.select(*of, "_in", before.alias("_before")).where("_before is not null")
    same = F.col("_segment") == F.col("_in")
    for k, n in zip(keys, of, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    numbered = kept.withColumn("_item", within).join(carried, same, "left").select(*keys, "line_no", "line", (F.col("_item") + F.coalesce("_before", F.lit(0))).alias("item"))
    texts = numbered.groupBy(*keys, "item").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    item = F.trim(F.regexp_replace(X.squeezed(F.array_join(F.transform("parts", lambda p: p["line"]), " ")), ITEM_START, ""))
    cleaned = texts.select(*keys, "item", item.alias("reference_text"))
    return cleaned.where((F.length("reference_text") >= LEAST_REFERENCE) & (F.col("reference_text").rlike(X.DOI) | F.col("reference_text").rlike(X.YEAR)))


def document_references(docs: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """TX-04: reference items with their section's marker, and the documents without a marker."""
    marker, section = reference_section(F.col(text))
    marked = docs.withColumn("section_marker", marker).withColumn("_section", section)
    return numbered_items(marked.where("section_marker != ''"), [*keys, "section_marker"], "_section"), marked.where("section_marker = ''").select(*keys)


def top_snippets(snippets: DataFrame, key: str, text: str, terms: str, privileged: Column, ordinal: str, k: int = 3) -> DataFrame:
    """W-12, S-06: the k snippets of each key with most terms shared (one more for privileged kinds), shorter first, then in order."""
    score = F.size(F.array_intersect(X.alignment_tokens(X.fold(F.col(text))), F.col(terms))) + privileged.cast("int")
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.length(text), ordinal)
    return snippets.withColumn("score", score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
