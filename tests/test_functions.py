import random
import re

import pytest
from pyspark.sql import functions as F

from dossier import functions as fn
from dossier import rules


def values(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", function("t").alias("v")).orderBy("i").collect()]


def table(spark, function, cases):
    assert values(spark, function, [t for t, _ in cases]) == [v for _, v in cases]


def test_names_and_keys(spark):
    table(spark, fn.canonical_name, [
        ("Farming (ransomware.live sector tag: Agriculture) ", "Farming"),
        ("A (Ransomware.Live Sector x) (ransomware.live sector y)", "A (ransomware.live sector y)"),
        (None, ""),
    ])
    table(spark, fn.norm_key, [
        ("Third-Party / Supply-Chain Risk", "third party and supply chain risk"),
        ("Initial Access Vector", "initial access vectors"),
        ("A & B—C_d\tE", "a and b c de"),
        ("&", "and"),
        ("¿?", ""),
    ])
    table(spark, fn.family_of, [
        ("vendor legal", "Third-Party & Supply Chain"),
        ("extortion tactics", "Extortion & Impact"),
        ("attack tactics", "OT & Operational Disruption"),
        ("robot arm", "Other"),
        ("ot arm", "OT & Operational Disruption"),
    ])
    table(spark, fn.slug, [("--A b!", "a-b"), ("Ünïx", "n-x"), (None, ""), ("x" * 90, "x" * 80)])
    table(spark, fn.company_key, [("The Acme Holdings, Inc.", "acme"), ("Corpus Co", "corpus"), ("Inc", "")])
    table(spark, fn.org_key, [("MGM (Las Vegas) (x)", "mgm"), ("  Caps ", "caps")])
    table(spark, fn.has_key, [("¿?", False), ("&", True), ("É1", True), (None, False)])
    table(spark, fn.sector_slug, [("Transportation/Logistics Co", "transportation_logistics_co"), ("", "(unclassified)")])


def test_posting_id(spark):
    row = spark.createDataFrame(
        [("u", "v", "g", "d", "m", "c"), ("", "v", None, "d", None, "c")],
        "url string, victim string, `group` string, attackdate string, domain string, country string",
    )
    import hashlib

    digest = hashlib.sha1(b"v||d||c").hexdigest()[:16]
    assert [r[0] for r in row.select(fn.posting_id()).collect()] == ["u", f"rw-{digest}"]


def test_parse_usd(spark):
    table(spark, fn.parse_usd, [
        ("$2.9bn total", 2.9e9),
        ("US$ 1,234.5 million", 1.2345e9),
        ("$350–400m", 350.0),
        ("$2.9B", 2.9),
        ("$5 monthly", 5e6),
        ("$62 billion", None),
        ("Not publicly disclosed; est. $5m", None),
        ("$,", None),
        ("$0", 0.0),
        ("7 dollars", None),
        ("", None),
        (None, None),
    ])


def test_disclosure(spark):
    table(spark, fn.is_disclosed, [("  ", False), ("Undisclosed sum", False), ("$5", True), (None, False)])
    table(spark, fn.is_paid, [("paid", True), ("unpaid", False), ("No disclosed payment of", False)])
    table(spark, fn.is_demanded, [("demanded", True), ("on demand", True), ("undemanding", False)])
    table(spark, fn.is_not_disclosed_any, [("cost unknown", True), ("5 days", False)])
    table(spark, fn.is_not_disclosed_prefix, [("cost unknown", False), ("Unknown", True)])
    table(spark, fn.is_placeholder_victim, [("The Company", True), (" ", True), ("The Company A", False)])


def test_lists_and_urls(spark):
    names = lambda **o: lambda c: F.array_join(fn.split_groups(c, **o), "|")
    table(spark, names(), [("A (x; y) and B/C", "A (x|y)|B|C"), ("land, " + "z" * 61, "land"), (None, "")])
    table(spark, names(strip_first=True), [("A (x; y) and B/C", "A|B|C")])
    table(spark, fn.clean_country, [("United States (Texas) ", "United States")])
    table(spark, fn.host_of, [
        ("https://www.Example.com:80/a?b", "example.com"),
        ("http://u:p@a.b.c/x@y", "a.b.c"),
        ("HTTPS:example.org", "example.org"),
        ("ftp://f.example/x", "f.example"),
        ("no url", ""),
        ("https://bad host/", ""),
        (None, ""),
    ])


def test_texts(spark):
    table(spark, fn.de_dash, [
        ("X — like this — Y", "X, like this, Y"),
        ("a; — b", "a; b"),
        ("end —.", "end ."),
        ("  kept  ", "  kept  "),
        (None, None),
    ])
    table(spark, fn.display_label, [("ot and it risk of the 3d", "OT and IT Risk of the 3d")])
    table(spark, fn.short_name, [("Oil and Gas, x", "Oil"), ("Farming, Fishing and", "Farming")])
    page = "<p>a&nbsp;b</p><SCRIPT>x<1</script><style>s</style>c&#39;d<b\n>e</b>"
    table(spark, fn.strip_html, [(page, "a b c&#39;d e"), (None, "")])
    table(spark, lambda c: fn.fmt_usd(F.col(c).cast("double")), [
        ("1500000000", "$1.5B"), ("2000000000", "$2B"), ("2600000", "$3M"), ("1400", "$1K"), ("350", "$350"), ("2.9", "$2.9"),
    ])
    table(spark, lambda c: fn.heat_bucket(F.col(c).cast("int"), F.lit(100)), [("0", 0), ("1", 1), ("40", 4), ("100", 5)])


def test_clean_payload(spark):
    df = spark.createDataFrame(
        [("a — b", [("c — d", "https://x/ — y", "e — f")], {"k": "g — h"})],
        "t string, l array<struct<m: string, n: string, source_url: string>>, p map<string, string>",
    )
    row = fn.clean_payload(df).first()
    assert row.t == "a, b" and tuple(row.l[0]) == ("c, d", "https://x/ — y", "e — f") and row.p == {"k": "g, h"}


def test_filing_fields(spark):
    df = spark.createDataFrame(
        [("a-1:f.htm", ("0001-24", ["0012"], ["Acme Inc  (ACM)"])), ("a-1:f.htm", ("0001-24", [], [])), ("x:", (None, ["1"], None))],
        "_id string, _source struct<adsh: string, ciks: array<string>, display_names: array<string>>",
    )
    rows = df.select(fn.filing_url().alias("u"), fn.filer_name().alias("n")).collect()
    assert [tuple(r) for r in rows] == [(rules.FILING_ARCHIVE + "12/000124/f.htm", "Acme Inc"), (None, ""), (None, "")]


def _raw_key(s):
    s = (s or "").lower().replace("&", " and ")
    s = re.sub(r"[^a-z0-9 ]+", "", re.sub(r"[/\-–—_]+", " ", s))
    return re.sub(r"\s+", " ", s).strip()


def _usd(s):
    if not s or re.match(rules.NEGATED_DISCLOSURE, s):
        return None
    m = re.search(rules.USD_AMOUNT, s)
    digits = m and m[1].replace(",", "")
    if not digits:
        return None
    scale = {"b": 1e9, "m": 1e6, "k": 1e3, "t": 1e3}.get((m[2] or "x")[0].lower(), 1)
    return None if float(digits) * scale > 5e9 else float(digits) * scale


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    random.seed(seed)
    pieces = list("aZ9 -–—_/&é.,()$") + ["$5", "$1,2", ".5", " million", " bn", "K", "not disclos", "undisclosed ", "\t"]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 14))) for _ in range(600)]
    assert values(spark, fn.raw_key, texts) == [_raw_key(t) for t in texts]
    assert values(spark, fn.parse_usd, texts) == [_usd(t) for t in texts]
    slugs = [re.sub(r"^-|-$", "", re.sub(r"[^a-z0-9]+", "-", t.lower()))[:80] for t in texts]
    assert values(spark, fn.slug, texts) == slugs
