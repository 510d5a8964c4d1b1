"""Text kernel: folding, tokens, years, identifiers, names and clips, as column expressions.

Python's text rules count Unicode white space and word characters; the patterns here do too ((?U)), so that a no-break space is white space.
Only what Spark has no expression for is a vectorised UDF: relative URLs."""

from __future__ import annotations

import html
import html.entities
import json
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stop words of the tokenisers, by purpose.
ALIGNMENT_STOP = (
    "about after against also among analysis and are been between case containing contribution demonstration der des die das during effect effects eine from has have into its new not observations one part paper "
    "research some study the their there this through uber ueber und using was were with"
).split()
GAP_STOP = (
    "about after against also among analysis and application are been being between case chapter chemical chemistry contribution de der des die discovery during effects for from has have his into its new not one "
    "paper part physics physiology recognition research services some study the their there this through und using was were which with work"
).split()
MATCH_STOP = "and the for with from into that this eine uber ueber des der die dans les sur".split()
GAP_MATCH_STOP = [*MATCH_STOP, "using", "study", "research"]
# Shapes of identifiers and years.
DOI = r"(?i)\b10\.\d{4,9}/[^\s\"<>]+"
YEAR = r"\b(?:18|19|20)\d{2}\b"
YEAR_CAPPED = r"\b(?:18[0-9]{2}|19[0-9]{2}|20[0-2][0-9])\b"
LAST_YEAR = 2026
#: Characters that end a DOI by accident, by source.
DOI_TAILS = {"detected": ".,;:)", "matched": ".,;:)]}", "registry": ".,;)", "plain": ""}
FAMILY_PARTICLES = ("de", "del", "du", "van", "von", "der", "zu")
SAMPLE_PARTICLES = ("de", "van", "von")


def _ranges(codes: list[int]) -> str:
    """A pattern's class of code points."""
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    written = lambda some: "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in some)
    # Few characters of Latin texts are tried against the long list.
    low, high = written(r for r in runs if r[0] < 0x250), written(r for r in runs if r[0] >= 0x250)
    return f"[{low}[\\x{{250}}-\\x{{10ffff}}&&[{high}]]]"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, str, dict[str, str]]:
    """What compatibility decomposition, without marks, makes of characters beyond ASCII, derived from the Unicode tables: characters that become one ASCII letter or
    digit, and which; a class of those that vanish; what is left of those that become several characters (ligatures, fractions). All others become spaces."""
    pairs, gone, spelled = [], [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        made = "".join(c if c.isascii() and c.isalnum() else " " for c in base)
        if not made:
            gone.append(code)
        elif len(made) == 1 and made != " ":
            pairs.append((chr(code), made))
        elif made.strip():
            spelled[chr(code)] = made
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), _ranges(gone), spelled


def fold(x: Column, eszett: bool = True, slashed_o: bool = False, drop: str = "") -> Column:
    """Lower-case ASCII letters and digits, single spaces. Marks are dropped, ligatures and the like spelled out; eszett and slashed o as well if asked; drop: characters
    removed without a space. Texts of ASCII alone take a shorter way."""
    x = F.coalesce(x, F.lit(""))
    old, new, gone, spelled = _folding()
    several = _ranges(sorted(map(ord, spelled)))
    words = lambda y: F.trim(F.regexp_replace(F.lower(F.translate(y, drop, "") if drop else y), "[^a-z0-9]+", " "))
    table = F.from_json(F.lit(json.dumps(spelled)), "map<string,string>")
    runs = F.regexp_extract_all(x, F.lit(f"{several}|(?:(?!{several})[\\s\\S])+"), F.lit(0))
    y = F.when(x.rlike(several), F.array_join(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.coalesce(F.try_element_at(table, r), r)).otherwise(r)), "")).otherwise(x)
    y = F.regexp_replace(y, f"{gone}+", "")
    if eszett:
        y = F.regexp_replace(y, "[ßẞ]", "ss")
    if slashed_o:
        y = F.translate(y, "øØ", "oo")
    return F.when(F.octet_length(x) == F.length(x), words(x)).otherwise(words(F.translate(y, old, new)))


def fold_exact(x: Column) -> Column:
    """fold(), which spells out ligatures and fractions as well."""
    return fold(x)


#: A character reference, as browsers and Python find it.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@lru_cache(maxsize=1)
def _references() -> tuple[str, str, dict[str, str]]:
    """Names of references and what they stand for; a pattern of those that need no semicolon, longest first; numbers that stand for something else, or nothing."""
    named = html.entities.html5
    open_ended = sorted((n for n in named if not n.endswith(";")), key=len, reverse=True)
    numbers = {str(n): html.unescape(f"&#{n};") for n in range(0x110000) if not 0xD800 <= n < 0xE000 and html.unescape(f"&#{n};") != chr(n)}
    return json.dumps(named), "^(?:" + "|".join(open_ended) + ")", numbers


def unescape(x: Column) -> Column:
    """Character references decoded: by name (the longest that fits, where the semicolon is missing) and by number. Texts without an ampersand stay as they are."""
    json_names, open_ended, odd = _references()
    names, numbers = F.from_json(F.lit(json_names), "map<string,string>"), F.from_json(F.lit(json.dumps(odd)), "map<string,string>")

    def decoded(piece: Column) -> Column:
        name = F.substr(piece, F.lit(2))
        stem = F.regexp_extract(name, open_ended, 0)
        by_name = F.coalesce(F.try_element_at(names, name), F.when(stem != "", F.concat(F.try_element_at(names, stem), F.substr(name, F.length(stem) + 1))), piece)
        is_hex = piece.rlike("^&#[xX]")
        digits = F.regexp_replace(piece, "^&#[xX]?0*|;$", "")
        # Seven decimal or six hexadecimal digits hold the last code point.
        number = F.when(digits == "", F.lit(0)).when(F.length(digits) > 7, F.lit(0x110000)).when(is_hex, F.conv(digits, 16, 10).cast("int")).otherwise(digits.cast("int"))
        beyond = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        by_number = F.when(beyond, F.lit("\ufffd")).otherwise(F.coalesce(F.try_element_at(numbers, number.cast("string")), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")))
        return F.when(piece.rlike("^&#."), by_number).when(F.length(piece) > 1, F.when(piece.startswith("&"), by_name).otherwise(piece)).otherwise(piece)

    pieces = F.regexp_extract_all(x, F.lit(REFERENCE + "|[^&]+|&"), F.lit(0))
    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(x)


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    return pd.Series([urljoin(b or "", h or "") for b, h in zip(base, href, strict=True)])


def tokens(folded: Column, least: int, stop: list[str], digits: bool, distinct: bool) -> Column:
    """Words of a folded text of a least length (numbers of any length, if asked) outside a stop list."""
    keep = lambda t: (F.length(t) >= least) | (t.rlike("^[0-9]+$") if digits else F.lit(False))
    found = F.filter(F.split(folded, " "), lambda t: (F.length(t) > 0) & keep(t) & ~t.isin(*stop) if stop else (F.length(t) > 0) & keep(t))
    return F.array_distinct(found) if distinct else found


def alignment_tokens(folded: Column) -> Column:
    return tokens(folded, 4, ALIGNMENT_STOP, True, False)


def gap_tokens(folded: Column) -> Column:
    return tokens(folded, 4, GAP_STOP, True, False)


def match_tokens(folded: Column) -> Column:
    return tokens(folded, 3, MATCH_STOP, False, True)


def gap_match_tokens(folded: Column) -> Column:
    return tokens(folded, 3, GAP_MATCH_STOP, False, True)


def narrative_tokens(folded: Column) -> Column:
    return tokens(folded, 4, [], False, True)


def years(x: Column, pattern: str = YEAR) -> Column:
    """Distinct years of a text, ascending."""
    found = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), F.lit(0)), lambda y: y.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda y: y <= LAST_YEAR) if pattern == YEAR_CAPPED else found))


def year_for_award(found: Column, award: Column) -> Column:
    """The latest year up to the award, else the earliest."""
    before = F.filter(found, lambda y: y <= award)
    return F.when(F.size(before) > 0, F.array_max(before)).when(F.size(found) > 0, F.array_min(found))


def right_strip(x: Column, characters: str) -> Column:
    return F.rtrim(x, F.lit(characters)) if characters else x


def find_doi(x: Column, tail: str = "detected") -> Column:
    """The first DOI of a text in lower case, without the tail characters; empty if none."""
    return F.lower(right_strip(F.regexp_extract(F.coalesce(x, F.lit("")), DOI, 0), DOI_TAILS[tail]))


def all_dois(x: Column, tail: str = "detected") -> Column:
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(DOI), F.lit(0))
    return F.array_join(F.transform(found, lambda d: right_strip(d, DOI_TAILS[tail])), "; ")


def bare_doi(x: Column, tail: str = "registry") -> Column:
    """A DOI field without resolver prefix."""
    return right_strip(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"^(?:https://doi\.org/|http://dx\.doi\.org/)", ""), DOI_TAILS[tail])


def repaired_doi(x: Column) -> Column:
    """A DOI that line breaks have cut: a gap closes before '.', ':' or '-', and after '/' or '-' before a digit or small letter."""
    run = r"(?i:10\.\d{4,9}/)(?:[A-Za-z0-9._;()/:\-]|\s+(?=[.:\-])|(?<=[/\-])\s+(?=[0-9\p{Ll}])|(?<=[/\-]\s{1,40})\s*(?=[0-9\p{Ll}]))*"
    text = F.translate(F.coalesce(x, F.lit("")), "\u00ad", "")
    return F.lower(right_strip(F.regexp_replace(F.regexp_extract(text, run, 0), r"(?U)\s+", ""), DOI_TAILS["matched"]))


def squeezed(x: Column) -> Column:
    """White space collapsed, soft hyphens gone."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), "\u00ad", ""), r"(?U)\s+", " "), r"^ | $", "")


def unstamped(x: Column, limit: int | None = None) -> Column:
    """squeezed(), without a page stamp 'N (M)' at the end; clipped if asked."""
    x = F.regexp_replace(squeezed(x), r"\s+\d{1,3}\s*\(\d{1,3}\)\s*$", "")
    return F.substring(x, 1, limit) if limit else x


def clipped(x: Column, limit: int, room: int = 1) -> Column:
    """A text of at most limit characters as it is; a longer one cut to limit - room characters, then an ellipsis."""
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, limit - room)), F.lit("...")))


#: Characters of a fingerprint, and of the beginning of a text that holds them as a rule.
FINGERPRINT, BEGINNING = 240, 1000


def fingerprint(x: Column) -> Column:
    """The first FINGERPRINT characters of the folded text. A text's beginning folds to the beginning of the folded text, so where that is long enough the rest isn't folded."""
    begin = fold(F.substring(x, 1, BEGINNING))
    return F.substring(F.when((F.length(begin) >= FINGERPRINT) | (F.coalesce(F.length(x), F.lit(0)) <= BEGINNING), begin).otherwise(fold(x)), 1, FINGERPRINT)


def family_names(full_name: Column, particles: tuple[str, ...] = FAMILY_PARTICLES) -> Column:
    """The last one, two and three parts of a folded name, and its end from the first occurrence of a particle."""
    parts = F.filter(F.split(fold(full_name, eszett=False, drop="'"), " "), lambda p: F.length(p) > 0)
    n = F.size(parts)
    ends = [F.when(n >= k, F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), " ")) for k in (1, 2, 3)]
    from_particle = [F.when(F.array_position(parts, p) > 0, F.array_join(F.slice(parts, F.array_position(parts, p).cast("int"), n), " ")) for p in particles]
    return F.array_distinct(F.filter(F.array(*ends, *from_particle), lambda x: x.isNotNull()))


def dataset_family_name(name: Column) -> Column:
    """'Family, given' or 'Family XX' (short initials at the end) or 'given family', folded."""
    folded = fold(name, eszett=False, drop="'")
    parts = F.split(folded, " ")
    n = F.size(parts)
    last = F.element_at(parts, -1)
    initials = (n >= 2) & (F.length(last) <= 3) & (F.length(F.element_at(parts, 1)) > 3)
    return F.when(F.contains(name, F.lit(",")), fold(F.substring_index(name, ",", 1), eszett=False, drop="'")).when(initials, F.element_at(parts, 1)).otherwise(last)


def gap_name_tokens(full_name: Column) -> Column:
    """The last token of a name, as the gap tokeniser sees it: particles and short names are gone before."""
    found = gap_tokens(fold(full_name))
    return F.when(F.size(found) > 0, F.array(F.element_at(found, -1))).otherwise(F.array().cast("array<string>"))


def work_id(x: Column) -> Column:
    """A work's URL from an id or a URL."""
    x = F.trim(F.coalesce(x, F.lit("")))
    return F.when(x == "", "").when(x.startswith("https://openalex.org/"), x).otherwise(F.concat(F.lit("https://openalex.org/"), F.ltrim(x, F.lit("/"))))


def short_id(x: Column) -> Column:
    return F.element_at(F.split(F.rtrim(x, F.lit("/")), "/"), -1)


def safe_name(x: Column) -> Column:
    """A file name from anything: word characters, and ten digits of its SHA-1."""
    return F.concat(F.substring(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_"), 1, 80), F.lit("_"), F.substring(F.sha1(x), 1, 10))


def strict_int(x: Column) -> Column:
    """A whole number with spaces around it; anything else is null."""
    return F.trim(x).try_cast("int")


def lenient_int(x: Column) -> Column:
    return F.trim(x).try_cast("double").cast("int")


def clean_html(x: Column) -> Column:
    """A fragment's text: line breaks and tags become spaces, character references are decoded."""
    return squeezed(unescape(F.regexp_replace(F.regexp_replace(x, r"(?i)<br\s*/?>", " "), "<[^>]+>", " ")))


def fold_without_urls(x: Column) -> Column:
    """SC-03: fold() of a text without its addresses, slashed o spelled out."""
    return fold(F.regexp_replace(F.coalesce(x, F.lit("")), r"https?://\S+", " "), slashed_o=True)


def page_text(content: Column) -> Column:
    """SC-10: the bytes of a page as text: UTF-8 where they are that, else Latin-1."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def page_title(x: Column) -> Column:
    return squeezed(unescape(F.regexp_replace(F.regexp_extract(x, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " ")))
