"""Text functions against plain Python."""

import html
import random
import re
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import match as M


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"k int, x {kind}").withColumn("y", f(F.col("x"))).orderBy("k").collect()
    return [r.y for r in rows]


WORDS = ["Müller", "Røntgen", "Straße", "soft\u00adhyphen", "no\u00a0break", "ÉCOLE  d'été", "ﬁne ½", None, "", "  x  ", "E=mc²", "Ǆ"]


def folded(text):
    text = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower().replace("ß", "ss")
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text).split())


def test_folding_of_every_code_point(spark):
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x".join(map(chr, codes[k : k + 97])) + "y" + "-".join(map(chr, codes[k : k + 97])) for k in range(0, len(codes), 97)]
    assert column(spark, texts, X.fold) == [folded(t) for t in texts]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folding_and_references_stay_in_the_engine(spark, sf_dir):
    from tessera.plans import registry

    for name in ("sc01_fold", "sc01_fold_exact", "sc09_clean_html", "sc09_plain_pages", "sc10_title"):
        plan = plan_of(registry.queries()[name](spark, sf_dir))
        assert "Python" not in plan and "Pandas" not in plan, name


def test_references_equal_the_standard_library(spark):
    names = list(html.entities.html5)
    texts = [f"a&{n}b &{n.rstrip(';')}xyz&{n.rstrip(';')};q&{n}" for n in names]
    numbers = [*range(0, 0x180), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 10**9, 10**30]
    texts += [f"{'é' * (n % 2)}&#{n};&#{n} &#x{n:x};&#X{n:X}g&#000{n};" for n in numbers]
    rng = random.Random(1)
    texts += ["".join(rng.choice(["&", "#", "x", ";", "amp", "lt", "not", "notin", "AMP", " ", "\n", "1", "65", "ä", "quot;", "&&", "<", "thetasym", "f"]) for _ in range(12)) for _ in range(2000)]
    texts += ["", None, "no reference", "&", "&;", "&#;", "&#x;", "&#xg", "&" + "a" * 40 + ";", "x" * 5000 + "&eacute;"]
    assert column(spark, texts, X.unescape) == [t if t is None else html.unescape(t) for t in texts]


def test_fingerprints_of_long_texts(spark):
    texts = ["é" * 3000 + "ab", "- " * 900 + "word " * 100, "a" * 239 + "-" + "b" * 2000, "--- " * 5000 + "end", "a" * 1000, "a " * 119 + "\u0301" * 3000 + "bc" * 300, None, "", "½" * 2000]
    assert column(spark, texts, X.fingerprint) == [folded(t)[:240] for t in texts]


def test_folding(spark):
    assert column(spark, WORDS, X.fold) == [folded(w) for w in WORDS]
    assert column(spark, ["ﬁne ½"], X.fold_exact) == ["fine 1 2"]
    assert column(spark, ["Røntgen"], lambda x: X.fold(x, slashed_o=True)) == ["rontgen"]
    assert column(spark, ["l'été"], lambda x: X.fold(x, drop="'")) == ["lete"]


def test_squeezed_and_clipped(spark):
    assert column(spark, WORDS, X.squeezed) == [" ".join((w or "").replace("\u00ad", "").split()) for w in WORDS]
    long = "ab " * 200
    assert column(spark, [long, "short"], lambda x: X.clipped(x, 300)) == [long[:299].rstrip() + "...", "short"]
    assert column(spark, ["A paper 12 (345)", "A paper 1234 (5)"], X.unstamped) == ["A paper", "A paper 1234 (5)"]


def test_years(spark):
    values = ["", "none 1799", "in 1899, 2026 and 2030; 1899", "x1950 1950a", None]
    assert column(spark, values, X.years) == [[], [], [1899, 2026, 2030], [], []]
    assert column(spark, values, lambda x: X.years(x, X.YEAR_CAPPED)) == [[], [], [1899, 2026], [], []]
    assert column(spark, values, lambda x: X.year_for_award(X.years(x), F.lit(1990))) == [None, None, 1899, None, None]
    assert column(spark, ["2001 2010"], lambda x: X.year_for_award(X.years(x), F.lit(1990))) == [2001]


def test_identifiers(spark):
    values = ["see 10.1234/AbC.1).", "10.1234/x]}; 10.99999/y,", "https://doi.org/10.1/z", "none", None]
    assert column(spark, values, X.find_doi) == ["10.1234/abc.1", "10.1234/x]}", "", "", ""]
    assert column(spark, values, lambda x: X.find_doi(x, "matched"))[1] == "10.1234/x"
    assert column(spark, values, X.all_dois)[1] == "10.1234/x]}; 10.99999/y"
    assert column(spark, ["https://doi.org/10.1/Z.;", " HTTP://DX.DOI.ORG/10.2/q)"], X.bare_doi) == ["10.1/z", "10.2/q"]


def mended(text):
    """The gap rules, read character by character."""
    start = re.search(r"10\.\d{4,9}/", text)
    if not start:
        return ""
    kept, k = [], start.start()
    while k < len(text):
        c = text[k]
        if re.match(r"[A-Za-z0-9._;()/:-]", c):
            kept.append(c)
            k += 1
        elif c.isspace():
            ahead = text[k:].lstrip()[:1]
            if ahead and (ahead in ".:-" or kept[-1] in "/-" and (ahead.isdigit() or ahead.islower())):
                k = len(text) - len(text[k:].lstrip())
            else:
                break
        else:
            break
    return "".join(kept).rstrip(".,;:)]}").lower()


def test_broken_identifiers(spark):
    values = ["10.1103/ PhysRev", "10.1103/\n\n physrev.12 .5", "x 10.1103/ab-\n 12 next", "10.1103/ab - c: d", "10.1000/a b", "10.1000/a\u00adb-c) end", "no doi", "10.1000/A :b"]
    assert column(spark, values, X.repaired_doi) == [mended(v.replace("\u00ad", "")) for v in values]


def test_names(spark):
    assert column(spark, ["Jan van der Waals", "Curie", ""], X.family_names) == [["waals", "der waals", "van der waals"], ["curie"], []]
    assert column(spark, ["Curie, M", "Einstein A", "Marie Curie", "Li Wu"], X.dataset_family_name) == ["curie", "einstein", "curie", "wu"]
    assert column(spark, ["Rao", "Otto van Berg"], X.gap_name_tokens) == [[], ["berg"]]


def test_numbers(spark):
    assert column(spark, [" 12 ", "12a", "", "1.5", None], X.strict_int) == [12, None, None, None, None]
    assert column(spark, ["1.9", "x", " 7"], X.lenient_int) == [1, None, 7]


def test_html_and_urls(spark):
    assert column(spark, ["a<br>b &amp; <i>c</i>\n&nbsp;d"], X.clean_html) == ["a b & c d"]
    assert column(spark, ["<TITLE x>Ab\n&#233;</title>"], X.page_title) == ["Ab é"]
    assert column(spark, ["../c?d"], lambda x: X.resolve_url(F.lit("http://h/a/b"), x)) == ["http://h/c?d"]


def test_searches(spark):
    text = "Smith (1990), Quantum theory of superconducting tunnel junctions, Phys. Rev. 1. Some long title about protein folding pathways. Nature 5"
    got = column(spark, [text, "short"], M.candidate_queries)
    assert got[0][0] == "Quantum theory of superconducting tunnel junctions" and got[0][-1] == text and len(got[0]) <= 4 and got[1] == ["short"]
