import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausework.functions import urls


def run(spark, rows, schema, *exprs):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [tuple(r) for r in df.orderBy("i").select(*exprs).collect()]


def spec_match(link, seed):
    rest = link.replace(seed, "")
    if any(re.search(p, rest) for p in urls.NEGATIVE_PATTERNS):
        return False
    return any(re.search(p, rest) for p in urls.POSITIVE_PATTERNS)


def test_pattern_counts():
    assert (len(urls.POSITIVE_PATTERNS), len(urls.NEGATIVE_PATTERNS)) == (33, 7)


def test_link_match_edges(spark):
    rows = [
        ("https://terms.com/about", "terms.com"),
        ("https://a.com/terms", "a.com"),
        ("https://a.com/TERMS", "a.com"),
        ("https://a.com/privacy-policy/terms", "a.com"),
        ("https://a.com/conditions-\r-of-use", "a.com"),
        ("https://a.com/conditions-\n-of-use", "a.com"),
        ("https://a.com/conditions of\x85use", "a.com"),
        ("https://warranty.a.com/shop", "warranty.a.com"),
        ("https://warranty.a.com/shop", "b.com"),
        ("https://a.com/cookies/policy", "a.com"),
        ("https://a.com/1099-k-form/refund", "a.com"),
        ("https://tera.comrms.com/", "a.com"),
    ]
    got = run(spark, rows, "l string, s string", urls.link_match(F.col("l"), F.col("s")))
    assert [g[0] for g in got] == [spec_match(*r) for r in rows]


pieces = st.sampled_from(
    ["terms", "return", "privacy", "policy", "cookie", "shipping", "gift", "card", "sale", "tax", "user", "agreement",
     "end", "license", "conditions", "of", "use", "contact", "us", "here", "safety", "guideline", "\r", "\n", "/", "a.com", "-"]
)
links = st.lists(st.lists(pieces, max_size=7).map("".join), min_size=100, max_size=100)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(links)
def test_link_match_any(spark, values):
    got = run(spark, [(v, "a.com") for v in values], "l string, s string", urls.link_match(F.col("l"), F.col("s")), urls.text_match(F.col("l")))
    assert [g[0] for g in got] == [spec_match(v, "a.com") for v in values]
    assert [g[1] for g in got] == [any(re.search(p, v.lower()) for p in urls.POSITIVE_PATTERNS) for v in values]


def test_resolve(spark):
    rows = [
        ("//cdn.x/y", None, "a.com", "https://a.com//cdn.x/y"),
        ("/terms", None, "http://a.com", "http://a.com/terms"),
        ("terms.html", None, "a.com", None),
        ("#top", None, "a.com", None),
        ("mailto:x@a.com", None, "a.com", None),
        ("", None, "a.com", None),
        ("javascript:void(0);", None, "a.com", None),
        ("javascript:void(0);", "go()", "a.com", None),
        ("javascript:void(0);", "open('https://b.com/x y')", "a.com", "https://b.com/x"),
        ("javascript:void(0);", "open('http://b.com/ x')", "a.com", "http://b.com/"),
        ("https://b.com:8080/x?y#z", "https://c.com", "a.com", "https://b.com:8080/x?y#z"),
        ("https://b.com/x\n", None, "a.com", None),
        ("https://b", None, "a.com", None),
        ("https://10.0.0.1/x", None, "a.com", "https://10.0.0.1/x"),
        ("ftp://b.com/x", None, "a.com", None),
    ]
    got = run(spark, [r[:3] for r in rows], "h string, o string, s string", urls.resolve_link(F.col("h"), F.col("o"), F.col("s")))
    assert [g[0] for g in got] == [r[3] for r in rows]


def test_slug_and_schemes(spark):
    rows = [("https://a.com/x_y/https://b",), ("http://a.com/" + "z" * 300,), ("a.com/x_y",), ("ahttps://b",)]
    u = F.col("u")
    got = run(spark, rows, "u string", urls.strip_scheme(u), urls.page_slug(u), urls.with_scheme(u))
    for (value,), row in zip(rows, got):
        bare = value.replace("https://", "").replace("http://", "")
        assert row[0] == bare
        assert row[1] == bare.replace("/", "_")[:255]
        assert row[2] == (value if "https://" in value or "http://" in value else "https://" + value)


def test_file_range(spark):
    rows = [("sites_100_200.json",), ("a_b_0_99.txt",), ("sites.json",)]
    assert run(spark, rows, "n string", *urls.file_range(F.col("n"))) == [(100, 200), (0, 99), (None, None)]


def test_valid_urls_of_the_whole_grammar(spark):
    good = """https://münchen.de https://例え.jp/x http://user:pa%20ss@host.org:81/p https://[2001:db8::1]/ http://[::1] http://[::ffff:10.0.0.1]:8080
    https://[1:2:3:4:5:6:7:8]?q https://xn--mnchen-3ya.de http://10.0.0.255/a http://localhost:80 https://a.b.co.uk#f http://host.org./x http://पर.भारत""".split()
    bad = """http://999.999.999.999 http://256.1.1.1 http://1.2.3 https://[2001:db8::1 https://[1:2:3:4:5:6:7:8:9] https://[1::2::3] https://[:::]
    https://[12345::] ftp://a.org http://-a.org http://a b.org http://user@ https:///x //a.org http://nodots http://a..org http://a.org:123456""".split()
    bad += ["http://a b.org", "", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string")
    got = [r[0] for r in df.select(urls.valid_url(F.col("u"))).collect()]
    assert dict(zip(good, got)) == dict.fromkeys(good, True)
    assert dict(zip(bad, got[len(good) :])) == dict.fromkeys(bad, False)
