import random
import re

from pyspark.sql import functions as F

from clausework.functions import taxonomy
from clausework.operators import labels as L
from clausework.operators import tags as A


def test_list_sizes():
    assert (len(taxonomy.FINANCIAL), len(taxonomy.UNFAVOURABLE), len(taxonomy.TOPICS)) == (11, 22, 23)
    assert {c for c, _ in taxonomy.UNFAVOURABLE_RULES} == set(taxonomy.UNFAVOURABLE)
    assert {c for c, _ in taxonomy.TOPIC_RULES} == set(taxonomy.TOPICS)
    assert {c for c, _ in taxonomy.FINANCIAL_RULES} == set(taxonomy.FINANCIAL)


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("B", "fee"), ("A", "refund"), ("B", "charge")], "category string, pattern string")
    rules = A.rules_from(table)
    df = spark.createDataFrame([("No REFUND, a fee and a charge",), ("hello",)], "paragraph string")
    got = [r["categories"] for r in A.taxonomy_tag(df, rules).collect()]
    assert got == [["A", "B"], ["Others"]]
    many = A.rules_from(spark.range(1200).selectExpr("string(id) category", "concat('x', id, '$') pattern"))
    assert len(many) == 1200
    numbered = spark.createDataFrame([("x7",), ("x1199",), ("y",)], "paragraph string")
    assert [r["categories"] for r in A.taxonomy_tag(numbered, many).collect()] == [["7"], ["1199"], ["Others"]]


def test_required_words():
    need = taxonomy.required_words
    assert need("restocking fee") == ("restocking fee",) and need(r"t(ion|ment)\.") == ("ion", "ment")
    assert need(" with (the|of|in) ") == (" with ",) and need(" dans | sich ") == ("dans ", "sich ")
    assert need(r"\b(refund|return)s?\b") == ("fund", "turn") and need("(than|then) .* this ") == (" this ",)
    assert need("x7$") == ("x7",) and need("a+bcd") == ("bcd",) and need("(ab)?cd") == ("cd",) and need("(?:ab){2,}") == ("ab",)
    assert need("[ab]c") == () and need("(a|)") == () and need("(?i)fee") == () and need("(") == ()


def test_rules_find_what_their_patterns_find(spark):
    """Words that overlap, begin alike or stand in each other; rules without any; against plain regular expressions."""
    rules = (("A", "restocking fee"), ("B", "fee"), ("C", r"re(fund|stocking)"), ("D", r"\d"), ("E", "stocking f"), ("F", r"fees? .*fund"), ("G", "é+x"))
    rng = random.Random(6)
    parts = ["restocking", " fee", "fees ", "refund", "re", "stocking", " f", "7", "ééx", "é", "\n", "fund", "FEE"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(400)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, paragraph string")
    got = {r["i"]: r["categories"] for r in A.taxonomy_tag(df, rules).collect()}
    for i, t in enumerate(texts[:-1]):
        want = sorted(c for c, p in rules if re.search(p, t.lower())) or ["Others"]
        assert got[i] == want, t
    assert got[len(texts) - 1] == ["Others"]


def test_shipped_rules_find_their_own_terms(spark):
    terms = [
        ("Restocking Fee", "A RESTOCKING fee of 15 percent applies"),
        ("No Refund for Purchase", "There is no refund for sale items"),
        ("Cancellation Fee or Penalty", "You owe a cancellation fee"),
        ("Forced Waiver of Class Action Rights", "You waive any class action"),
        ("Customers Pay Return Shipping", "Return shipping is paid by the customer"),
    ]
    df = spark.createDataFrame(terms, "want string, paragraph string")
    rows = A.taxonomy_tag(df).collect()
    assert all(r["want"] in r["categories"] for r in rows)
    topics = A.taxonomy_tag(df, taxonomy.TOPIC_RULES).collect()
    assert all(set(r["categories"]) <= {*taxonomy.TOPICS, taxonomy.OTHERS} for r in topics)


def test_undisclosed(spark):
    terms = spark.createDataFrame([("s", "A  fee"), ("s", "No refund"), ("t", "a fee")], "site string, term string")
    info = spark.createDataFrame([("s", " a FEE ")], "site string, term string")
    assert sorted(map(tuple, A.undisclosed_terms(terms, info).collect())) == [("s", "No refund"), ("t", "a fee")]


def test_topics(spark):
    df = spark.createDataFrame([(1, 3, "Benign"), (2, 4, "BENIGN"), (3, 5, "New one"), (4, 6, None)], "cluster_id int, size int, category string")
    kept = L.not_benign(df)
    assert [r["cluster_id"] for r in kept.collect()] == [3]
    assert [tuple(r) for r in L.category_counts(kept).collect()] == [("New one", 1, 5)]
    assert [r["cluster_id"] for r in L.rejects(df, "category").collect()] == [4]


def test_classifier_surface(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "k int, prompt string")

    def build():
        return lambda prompts: [p.upper() for p in prompts]

    got = L.classify_with(df, build, ["k"])
    assert sorted(map(tuple, got.collect())) == [(i, f"P{i}") for i in range(5)]
    joined = L.response_join(df, got.where("k < 2"), ["k"])
    assert joined.where("response IS NULL").count() == 3 and L.unanswered(df, got.where("k < 2"), ["k"]).count() == 3
    twice = got.where("k < 2").unionByName(got.where("k = 0").withColumn("response", F.lit("P9")))
    assert L.response_join(df, twice, ["k"]).count() == 5 and L.unanswered(df, twice, ["k"]).count() == 3
    dated = twice.withColumn("at", F.when(F.col("response") == "P9", 1).otherwise(2))
    assert L.response_join(df, dated, ["k"], order="at").where("k = 0").first()["response"] == "P0"
