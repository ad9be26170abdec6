"""The physical plans: what shuffles, what is read, what runs in the JVM."""

from pyspark.sql import functions as F

from clausework.operators import paragraphs as P
from clausework.operators import positions as O
from clausework.operators import tags as A
from clausework.operators.pages import parse_pages

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sanitising_has_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(P.sanitise_lines(docs, "source", "doc_id"))
    assert "Exchange" not in text and "Python" not in text and "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert "Exchange" not in plan(P.sanitise_pages(pages))


def test_parse_reads_only_what_it_needs(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan(parse_pages(pages, ["page_id"]))


def test_sampling_limits_groups_before_the_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("source", "doc_id")
    text = plan(O.sample_members(docs, ["source"], "doc_id", 5))
    assert text.count("WindowGroupLimit") == 2


def test_dedupe_aggregates_in_the_map_tasks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("source").alias("url"), F.col("doc_id").alias("page_key"), "text")
    text = plan(P.dedupe(P.explode_lines(docs, ["url", "page_key"]), "global"))
    assert text.count("partial_min") == 1 and text.count("Exchange hashpartitioning") == 1


def test_rank_slice_reaches_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("rank"), F.lit("x").alias("domain")).write.parquet(str(tmp_path / "r"))
    text = plan(O.rank_slice(spark.read.parquet(str(tmp_path / "r")), 10, 20))
    assert "GreaterThan(rank,10)" in text and "LessThanOrEqual(rank,20)" in text


def test_tags_need_no_join_or_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(A.taxonomy_tag(docs, text="text"))
    assert "Exchange" not in text and "Join" not in text


def test_only_wanted_pages_are_parsed(spark):
    """The join with the wanted links stands below the parser, and pages of a level are parsed once."""
    from clausework.plans import policy_crawl as CR

    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("content_type", F.lit("text/html"))
    wanted = spark.createDataFrame([("x",)], "link string")
    source = CR.html_content_only(pages).select(F.col("url").alias("link"), "html")
    text = plan(parse_pages(source.join(wanted, "link", "left_semi"), ["link"]))
    assert 0 <= text.index("MapInArrow") < text.index("LeftSemi")
    parsed = []
    original = CR.parse_pages

    def counted(df, keys, *rest):
        parsed.append(df.count())
        return original(df, keys, *rest)

    CR.parse_pages = counted
    try:
        some = pages.limit(3).select(F.col("url").alias("link"))
        assert CR.page_facts(pages, wanted=some).count() == 3 and parsed == [3]
    finally:
        CR.parse_pages = original
