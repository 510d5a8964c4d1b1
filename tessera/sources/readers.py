"""Scans. Inside Spark a missing value is null; files hold an empty string for it."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

PRIZE_PAPERS = "`Field` string, `Laureate ID` string, `Laureate name` string, `Prize year` string, `Title` string, `Pub year` string, `Paper ID` string, `Additional information` string"
TEXT = "struct<en:string>"
PRIZES = (
    f"nobelPrizes array<struct<awardYear:string, category:{TEXT}, laureates:array<struct<id:string, fullName:{TEXT}, knownName:{TEXT}, motivation:{TEXT}, portion:string, sortOrder:string, "
    f"affiliations:array<struct<name:{TEXT}, city:{TEXT}, country:{TEXT}>>, links:array<struct<rel:string, href:string>>>>>>"
)
LAUREATES = "laureates array<struct<id:string, fileName:string, nobelPrizes:array<struct<awardYear:string, links:array<struct<href:string, class:array<string>>>>>>>"
WORKS = "results array<struct<id:string, title:string, display_name:string, publication_year:int, type:string, doi:string, primary_location:struct<source:struct<id:string, display_name:string, issn_l:string>>>>, group_by array<struct<key:string, count:long>>, meta struct<count:long>"
CITED = (
    "message struct<items:array<struct<DOI:string, title:array<string>, `container-title`:array<string>, `published-print`:struct<`date-parts`:array<array<int>>>, `published-online`:struct<`date-parts`:array<array<int>>>, "
    "issued:struct<`date-parts`:array<array<int>>>, type:string, score:double, URL:string>>>"
)
#: HTTP codes that are tried again.
RETRYABLE = frozenset({429, 500, 502, 503, 504})


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, tab: bool = False, quoted_breaks: bool = True) -> DataFrame:
    """SRC-01, SRC-03, SRC-17: files with a header; quotes are doubled, a backslash is a character, a byte order mark is dropped. Without a schema all columns are strings.

    quoted_breaks: line breaks may stand in quotes, which makes each file one task; without them, large files are split."""
    reader = spark.read.option("header", True).option("multiLine", quoted_breaks).option("escape", '"').option("sep", "\t" if tab else ",").option("enforceSchema", False)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-02: a missing file is an empty table."""
    try:
        return csv(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC-11: files as text; bytes that aren't UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def document_pages(spark: SparkSession, paths: list[str], pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """SRC-12: page texts of files through a given extractor; a file that fails gives one row with its error."""
    schema = "path string, page int, text string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, k + 1, t, None) for k, t in enumerate(pages_of(bytes(content)))]
                except Exception as e:  # noqa: BLE001  one bad file must not stop the others
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return spark.read.format("binaryFile").load(paths).mapInPandas(run, schema)


def prize_rows(payload: DataFrame, categories: list[str], column: str = "value") -> DataFrame:
    """SRC-04, J-20: one row for each prize and laureate of the given categories, with the first affiliation and the link of the wanted relation."""
    prize = payload.select(F.explode(F.from_json(column, PRIZES)["nobelPrizes"]).alias("p"))
    rows = prize.where(F.col("p.category.en").isin(categories)).select(F.col("p.awardYear").alias("award_year"), F.col("p.category.en").alias("category"), F.explode("p.laureates").alias("l"))
    place = F.get("l.affiliations", F.lit(0))
    return rows.select(
        F.col("l.id").alias("laureate_id"),
        F.coalesce("l.fullName.en", "l.knownName.en").alias("full_name"),
        "award_year",
        "category",
        F.col("l.motivation.en").alias("motivation"),
        F.col("l.portion").alias("prize_share"),
        F.col("l.sortOrder").alias("sort_order"),
        place["name"]["en"].alias("affiliation_name"),
        place["city"]["en"].alias("affiliation_city"),
        place["country"]["en"].alias("affiliation_country"),
        link(F.col("l.links"), "external").alias("nobel_url"),
    )


def link(links: Column, rel: str) -> Column:
    """The target of the first link of a relation."""
    return F.get(F.filter(links, lambda x: x["rel"] == rel), F.lit(0))["href"]


def fact_url(prizes: Column, year: Column, fallback: Column) -> Column:
    """J-02: the facts link of the prize of a year, else a link built from parts."""
    of_year = F.flatten(F.transform(F.filter(prizes, lambda p: p["awardYear"] == year), lambda p: p["links"]))
    return F.coalesce(F.get(F.filter(of_year, lambda x: F.array_contains(x["class"], "laureate facts")), F.lit(0))["href"], fallback)


def work_fields(payload: Column) -> Column:
    """Fields of the first work of a response."""
    w = F.get(F.from_json(payload, WORKS)["results"], F.lit(0))
    source = w["primary_location"]["source"]
    names = {"openalex_work_id": w["id"], "openalex_title": F.coalesce(w["title"], w["display_name"]), "openalex_year": w["publication_year"], "openalex_type": w["type"], "openalex_doi": w["doi"]}
    names |= {"openalex_journal": source["display_name"], "openalex_source_id": source["id"], "issn_l": source["issn_l"]}
    return F.struct(*[c.alias(n) for n, c in names.items()])


def first_year(item: Column, keys: tuple[str, ...] = ("published-print", "published-online", "issued")) -> Column:
    """The first year in order of preference."""
    return F.coalesce(*[F.get(F.get(item[k]["date-parts"], F.lit(0)), F.lit(0)) for k in keys])


def cited_items(payload: Column) -> Column:
    """Title, journal, year, type, score and identifier of every item of a response."""
    items = F.from_json(payload, CITED)["message"]["items"]
    return F.transform(
        items,
        lambda i: F.struct(
            F.lower(i["DOI"]).alias("doi"), F.get(i["title"], F.lit(0)).alias("title"), F.get(i["container-title"], F.lit(0)).alias("journal"), first_year(i).alias("year"), i["type"].alias("type"), i["score"].alias("score")
        ),
    )


def lookup_url(kind: str, x: Column) -> Column:
    """SRC-16: addresses of exact lookups and searches."""
    encoded = F.url_encode(x)
    forms = {
        "openalex_doi": F.concat(F.lit("https://api.openalex.org/works?filter=doi:"), encoded),
        "openalex_mag": F.concat(F.lit("https://api.openalex.org/works?filter=ids.mag:"), encoded),
        "openalex_search": F.concat(F.lit("https://api.openalex.org/works?per-page=5&search="), F.url_encode(F.substring(x, 1, 500))),
        "crossref_doi": F.concat(F.lit("https://api.crossref.org/works/"), encoded),
        "crossref_search": F.concat(F.lit("https://api.crossref.org/works?rows=3&query.bibliographic="), F.url_encode(F.substring(x, 1, 1000))),
    }
    return forms[kind]


def publication_counts(works: DataFrame, year: str, countries: str, extra: list[str]) -> DataFrame:
    """SRC-15: yearly counts by country, a work once for each distinct country."""
    return works.select(*extra, year, F.explode(F.array_distinct(countries)).alias("country")).groupBy(*extra, "country", year).agg(F.count("*").alias("publication_count"))


def cache_key(url: Column) -> Column:
    """SRC-07."""
    return F.substring(F.sha2(url, 256), 1, 24)


def request(url: str, tries: int = 5, timeout: float = 90, cap: float = 60, opener=urllib.request.urlopen, sleep=time.sleep) -> dict:
    """SRC-05, SRC-06, SRC-09: one fetch as a status row; retryable codes wait for Retry-After or a doubling pause."""
    for k in range(tries):
        try:
            with opener(url, timeout=timeout) as r:
                return {"url": url, "fetch_status": "ok", "http_status": r.status, "body": r.read().decode("utf-8", "replace"), "error": None}
        except urllib.error.HTTPError as e:
            if e.code not in RETRYABLE or k + 1 == tries:
                return {"url": url, "fetch_status": "http_error", "http_status": e.code, "body": None, "error": str(e)}
            after = (e.headers or {}).get("Retry-After", "")
            sleep(float(after) if str(after).isdigit() else min(cap, 2.0**k))
        except OSError as e:
            if k + 1 == tries:
                return {"url": url, "fetch_status": "error", "http_status": None, "body": None, "error": str(e)}
            sleep(min(cap, 2.0**k))
    raise AssertionError


def fetched(urls: DataFrame, cache: DataFrame | None = None, get: Callable[[str], dict] = request) -> DataFrame:
    """SRC-05..10: each distinct address once, those in the cache (url, fetch_status, http_status, body, error) not at all."""
    schema = "url string, fetch_status string, http_status int, body string, error string"
    todo = urls.select("url").distinct()
    if cache is not None:
        todo = todo.join(cache.select("url"), "url", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([get(u) for u in b["url"]], columns=["url", "fetch_status", "http_status", "body", "error"]).astype({"http_status": "Int32"})

    new = todo.mapInPandas(run, schema)
    return new if cache is None else new.unionByName(cache.join(urls.select("url").distinct(), "url", "left_semi").select("url", "fetch_status", "http_status", "body", "error"))


#: SRC-18: the declared sources.
SOURCES = [
    ("award_api", "http_json", "award baseline"),
    ("openalex", "http_json", "exact lookup, search, yearly counts"),
    ("crossref", "http_json", "exact lookup, bibliographic search"),
    ("prize_papers", "tsv", "dataset candidates"),
    ("official_pages", "http_html", "clues and targets"),
    ("official_files", "http_file", "reference sections"),
    ("manual_seeds", "csv", "narrative reconstruction"),
    ("review_decisions", "csv", "verified rows"),
    ("undownloaded_dataset", "none", "declared only"),
]


def source_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source string, access string, use string")

