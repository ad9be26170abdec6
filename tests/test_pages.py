import html as entities

import pytest
from pyspark.sql import functions as F

from clausework.functions.page_parser import Page
from clausework.operators import pages as G
from clausework.operators import paragraphs as P


def paragraphs(source):
    return list(Page(source).paragraphs())


@pytest.mark.parametrize(
    "source, expected",
    [
        ("<p>a<p>b</p>", ["ab", "b"]),
        ("<p>a</p></p><p>b", ["a", "b"]),
        ("<P>a<B>b</B></P>", ["ab"]),
        ("<p>a<script>x</p></script>b<style>p{}</style><!-- c -->d</p>", ["abd"]),
        ("<p>a<br>b<br/>c</br>d</p>", ["abcd"]),
        ("<div><p>a</div>b", ["a"]),
        ("<p>a<p>b</div>c", ["abc", "bc"]),
        ("<p>&amp; &lt;&copy;&#8212;&#x41; AT&T</p>", ["& <©—A AT&T"]),
        ("<p> </p><p>\n</p><p></p><p/>x", []),
        ("<p>a<template><p>b</p></template>c</p>", ["ac"]),
        ("<p>a<b>\t</b>c</p>", ["a c"]),
        ("<p>a<b>\t\n</b>c</p>", ["a\nc"]),
        ("<pre><p>a<b>\t</b>c</p></pre>", ["a\tc"]),
        ("<p>  a </p>", ["a"]),
        ("plain", []),
        ("", []),
    ],
)
def test_paragraphs(source, expected):
    assert paragraphs(source) == expected


@pytest.mark.parametrize(
    "source, expected",
    [
        ('<html lang="en-GB"><html lang="fr">', "en-GB"),
        ('<html lang=""><meta http-equiv="Content-Language" content="de">', ""),
        ("<html lang>", ""),
        ('<html><meta http-equiv="Content-Language" content="de">', "de"),
        ('<meta http-equiv="content-language" content="de">', None),
        ('<meta http-equiv="Content-Language"><meta http-equiv="Content-Language" content="de">', None),
        ("<body>the</body>", None),
    ],
)
def test_declared_language(source, expected):
    assert Page(source).declared_language == expected


def test_links():
    page = Page('<a href="/x" onclick="go()">1</a><a name="y">2</a><a HREF=\'/x\'>3</a><!--<a href="/z">--><a href>4</a>')
    assert page.links == [("/x", "go()"), ("/x", None), ("", None)]


def test_deep_nesting_is_linear():
    source = "<div>" * 200_000 + "<p>x"
    assert paragraphs(source) == ["x"]


def test_spark_jobs(spark):
    source = [
        (1, "<html lang='en'><p>one two</p><p>one two</p><p>three</p><a href='/t'>t</a>"),
        (2, "<html><p>the cat and the dog</p>"),
        (3, None),
        (4, ""),
    ]
    df = spark.createDataFrame(source, "k int, html string")
    rows = [tuple(r) for r in G.paragraph_rows(df, ["k"]).orderBy("k", "pos").collect()]
    assert rows == [(1, 0, "one two"), (1, 1, "one two"), (1, 2, "three"), (2, 0, "the cat and the dog")]
    assert G.paragraph_rows(df, ["k"], distinct=True).count() == 3
    tagged = {r["k"]: r["language"] for r in G.page_language(df, ["k"]).collect()}
    assert tagged == {1: "en", 2: "en", 4: None}
    facts = G.parse_pages(df, ["k"], ("links", "paragraphs", "text", "declared_language"))
    first = facts.where("k = 1").first()
    assert first["paragraphs"] == ["one two", "one two", "three"] and first["links"][0]["href"] == "/t"
    assert first["text"] == "one two one two three t" and first["parse_ok"]


def test_one_page_may_give_many_batches(spark):
    """Unclosed paragraphs repeat the rest of the page: 3,000 of them give 4.5 million characters and rows in order."""
    df = spark.createDataFrame([(1, "<p>x" * 3000)], "k int, html string")
    rows = G.paragraph_rows(df, ["k"])
    n, longest, shortest = rows.agg(F.count("*"), F.max(F.length("paragraph")), F.min(F.length("paragraph"))).first()
    assert (n, longest, shortest) == (3000, 3000, 1)


def test_order_of_sanitising(spark):
    long = "a b c d e f g h i j"
    html = (
        f"<p>{long}  k</p><p>{long} k</p><p>{long} k</p>"  # differ only in inner white space: both stay
        f"<p>{long}</p>"  # ten words: out
        f'<p>{long}\n "k"</p>'
    )
    df = spark.createDataFrame([("s", 1, html), ("s", 2, f"<p>{long} k</p>")], "url string, page_id int, html string")
    rows = P.sanitise_pages(df)
    got = sorted((r["page_key"], r["pos"], r["paragraph"]) for r in rows.collect())
    assert got == [(1, 0, f"{long} k"), (1, 1, f"{long} k"), (1, 4, f"{long} 'k'"), (2, 0, f"{long} k")]
    assert sorted(P.dedupe(rows, s).count() for s in ("page", "site", "global")) == [2, 2, 3]


def test_entities_match_the_standard_table():
    names = ("nbsp", "eacute", "hellip", "euro", "notin")
    assert paragraphs("<p>x" + "".join(f"&{n};" for n in names) + "</p>") == ["x" + entities.unescape("".join(f"&{n};" for n in names))]
