import fnmatch
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from clausework.operators import lineage
from clausework.operators import paragraphs as P
from clausework.operators import positions as O
from clausework.operators import sites as S
from clausework.operators.embedding import embed, hashing_encoder, missing_embeddings
from clausework.sources import readers as R
from clausework.sources import writers as W
from clausework.sources.chunk_files import read_zip
from clausework.streaming import sanitise as T

LONG = "one two three four five six seven eight nine ten eleven"


def test_seed_lists(spark, tmp_path):
    (tmp_path / "ranked.csv").write_text("1,a.com\n2,b.com\n3,c.com\n")
    ranked = R.read_ranked_domains(spark, str(tmp_path / "ranked.csv"))
    assert [tuple(r) for r in O.rank_slice(ranked, 1, 3).collect()] == [(2, "b.com"), (3, "c.com")]
    assert O.rank_slice(ranked, 2, 2).count() == 0 and O.first_n(ranked, 2).count() == 2
    (tmp_path / "d.jsonl").write_text('{"domain": "x.com", "n": 1}\n{"domain": "y.com"}\n')
    assert [r[0] for r in R.read_domain_jsonl(spark, str(tmp_path / "d.jsonl")).collect()] == ["x.com", "y.com"]
    (tmp_path / "s.csv").write_text('id,Online shop URL\n1,https://x.com\n2,"http://y.com/a,b"\n')
    assert [r[0] for r in R.read_shop_csv(spark, str(tmp_path / "s.csv")).collect()] == ["x.com", "y.com/a,b"]


def test_sites(spark, tmp_path):
    for start, end in ((0, 100), (100, 200), (200, 300)):
        rows = [{"url": f"{start}.com", "language": "en", "is_shopping": 1, "html": "<p>"}]
        (tmp_path / f"sites_{start}_{end}.json").write_text(json.dumps(rows, indent=4))
    got = R.read_sites(spark, str(tmp_path), 100, 300)
    assert sorted((r["url"], r["start"], r["end"]) for r in got.collect()) == [("100.com", 100, 200), ("200.com", 200, 300)]
    assert R.read_sites(spark, str(tmp_path)).count() == 3


def test_pages(spark, tmp_path):
    for site, name in (("a.com", "a.com_terms"), ("b.com_x", "b c"), ("b.com_x", "é")):
        (tmp_path / site).mkdir(exist_ok=True)
        (tmp_path / site / name).write_text(f"<p>{LONG}</p>\n<p>{LONG}</p>")
    got = R.read_pages(spark, str(tmp_path))
    assert sorted((r["url"], r["page_key"]) for r in got.collect()) == [("a.com", "a.com_terms"), ("b.com_x", "b c"), ("b.com_x", "é")]
    assert P.sanitise_pages(got, page_key="page_key").count() == 3


NASTY = ['say "hi", you', "tab\tand, comma", " lead and trail ", "back\\slash", "lone \r return", "é x", "'", ""]


def test_paragraph_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a.com", t) for t in NASTY], "url string, paragraph string")
    out = str(tmp_path / "p.csv")
    W.write_paragraphs(df, out)
    expected = sorted(t.replace('"', "'") for t in NASTY if t) + [None]
    for multi_line in (True, False):
        rows = [r["paragraph"] for r in R.read_paragraphs(spark, [out, out], split=1, multi_line=multi_line).collect()]
        got = sorted(t for t in rows if t) + [t or None for t in rows if not t]
        assert got == expected
    assert R.read_paragraphs(spark, [out, out]).groupBy("split").count().count() == 2


def test_foreign_csv(spark, tmp_path):
    """A file with CR LF line ends and newlines inside fields."""
    (tmp_path / "s.csv").write_bytes('"url","paragraph"\r\n"a.com","x ""y"", z"\r\n"b.com","two\nlines"\r\n'.encode())
    got = R.read_paragraphs(spark, [str(tmp_path / "s.csv")], multi_line=True).select("url", "paragraph")
    assert [tuple(r) for r in got.collect()] == [("a.com", 'x "y", z'), ("b.com", "two\nlines")]


STATS = "Languages: defaultdict(<class 'int'>, {})\nOther stats: {'accessible': 59, 'english': 50, 'is_shopping': 14, 'error_urls': ['x.ru', 'y.com']}\n"


def test_stats(spark, tmp_path):
    (tmp_path / "list_0_100.txt").write_text(STATS)
    (tmp_path / "list_100_200.txt").write_text("Languages: {}\nOther stats: {'accessible': 1, 'english': 0, 'is_shopping': 0, 'error_urls': []}")
    stats = R.read_stats(spark, str(tmp_path))
    first = stats.where("start = 0").first()
    assert tuple(first) == (0, 100, 59, 50, 14, ["x.ru", "y.com"])
    assert tuple(S.funnel_totals(stats).first()) == (60, 50, 14)
    assert tuple(S.range_bounds(stats).first()) == (0, 200)
    bad = spark.createDataFrame([("nothing here",)], "value string").select(*R.parse_stats(F.col("value")))
    with pytest.raises(Exception, match="not found"):
        bad.collect()
    odd = r"""Other stats: {'accessible': 1, 'error_urls': ['a.com', "o'b.com", 'x.com/[1]', 'it\'s', 'last.com'], 'english': 2, 'is_shopping': 3}"""
    got = spark.createDataFrame([(odd,)], "value string").select(*R.parse_stats(F.col("value"))).first()
    assert tuple(got) == (1, 2, 3, ["a.com", "o'b.com", "x.com/[1]", "it's", "last.com"])
    many = spark.createDataFrame([("Other stats: " + str({"accessible": 0, "english": 0, "is_shopping": 0, "error_urls": ["u"] * 20_000}),)], "value string")
    assert len(many.select(*R.parse_stats(F.col("value"))).first()["error_urls"]) == 20_000
    short = spark.createDataFrame([("Other stats: {'accessible': 1, 'english': 2, 'error_urls': []}",)], "value string")
    with pytest.raises(Exception, match="is_shopping"):
        short.select(*R.parse_stats(F.col("value"))).collect()
    assert tuple(S.funnel_totals(stats.limit(0)).first()) == (0, 0, 0)


def test_names_with_a_plus(spark, tmp_path):
    (tmp_path / "a.com").mkdir()
    for name in ("terms+conditions.html", "terms conditions.html", "100%25.html"):
        (tmp_path / "a.com" / name).write_text("<p>x</p>")
    assert {r["page_key"] for r in R.read_pages(spark, str(tmp_path)).collect()} == {"terms+conditions.html", "terms conditions.html", "100%25.html"}


def test_place_of_a_line_is_its_number(spark):
    long = [f"{LONG} {i}" for i in range(3)]
    docs = spark.createDataFrame([("s", 1, "\n".join(["x", long[0], long[0], long[1], "", long[0]]))], "url string, page_key int, text string")
    assert {(r["pos"], r["paragraph"]) for r in P.sanitise_lines(docs, "url", "page_key").collect()} == {(1, long[0]), (3, long[1])}


def test_finished_job_leaves_no_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "_job_folder", lambda spark: str(tmp_path / "job"))
    assert O.row_position(spark.range(10), ["id"]).count() == 10
    assert list((tmp_path / "job").rglob("*.parquet"))
    lineage.drop_stages(spark)
    assert not (tmp_path / "job").exists()


def test_cluster_files(spark, tmp_path):
    folder = tmp_path / "split1" / "chunk2"
    folder.mkdir(parents=True)
    (folder / "eps_0.21.json").write_text(json.dumps({"-1": ["n"], "0": ["a", "a", "b"]}))
    got = sorted(tuple(r) for r in R.read_cluster_maps(spark, str(tmp_path)).collect())
    assert got == [(1, 2, 0.21, -1, ["n"]), (1, 2, 0.21, 0, ["a", "a", "b"])]
    lines = tmp_path / "filtered.json"
    lines.write_text('{"cluster_id": "0", "paragraphs": ["a"]}\n{"cluster_id": "1", "paragraphs": ["b"], "category": "X"}\n')
    assert [tuple(r) for r in R.read_cluster_lines(spark, str(lines)).collect()] == [("0", ["a"], None), ("1", ["b"], "X")]


def test_site_and_stats_files_round_trip(spark, tmp_path):
    rows = [(f"{i}.com", "en" if i % 3 else None, i % 2, f"<p>é {i}", i // 100) for i in range(250)]
    sites = spark.createDataFrame(rows, "url string, language string, is_shopping int, html string, chunk int").repartition(7)
    out = str(tmp_path / "sites")
    W.write_sites(sites, out)
    assert sorted(p.name for p in (tmp_path / "sites").iterdir()) == ["sites_0_100.json", "sites_100_200.json", "sites_200_300.json"]
    assert len(json.loads((tmp_path / "sites" / "sites_200_300.json").read_text())) == 50
    back = R.read_sites(spark, out)
    assert sorted((r["url"], r["language"], r["is_shopping"], r["html"], r["start"] // 100) for r in back.collect()) == sorted(rows)
    assert {r["url"] for r in R.read_sites(spark, out, 100, 300).collect()} == {r[0] for r in rows if r[4] >= 1}
    W.write_sites(sites.where("chunk = 1"), out)  # overwriting leaves no older chunk behind
    assert [p.name for p in (tmp_path / "sites").iterdir()] == ["sites_100_200.json"]
    W.write_sites(sites.where("chunk = 0"), out, mode="append")
    assert R.read_sites(spark, out).count() == 200
    (tmp_path / "sites" / "other.json").write_text("[]")
    (tmp_path / "sites" / "odd.json").write_text('[{"url": "x"}]')
    with pytest.raises(Exception, match="no range"):
        R.read_sites(spark, out).collect()

    counts = [(0, 59, 50, 14, ["x.ru", "o'b.com", 'q"t'], {"en": 50, "ru": 9}), (3, 0, 0, 0, [], None)]
    schema = "chunk int, accessible long, english long, is_shopping long, error_urls array<string>, languages map<string,long>"
    df = spark.createDataFrame(counts, schema)
    W.write_stats(df, str(tmp_path / "stats"))
    first = (tmp_path / "stats" / "stats_0_100.txt").read_text().splitlines()
    assert len(first) == 2 and first[0] == "Languages: {'en': 50, 'ru': 9}"
    assert sorted(tuple(r) for r in R.read_stats(spark, str(tmp_path / "stats")).collect()) == [
        (0, 100, 59, 50, 14, ["x.ru", "o'b.com", 'q"t']), (300, 400, 0, 0, 0, []),
    ]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    schema = "chunk int, accessible long, english long, is_shopping long, error_urls array<string>"
    twice = spark.createDataFrame([(0, 1, 1, 1, []), (1, 1, 1, 1, []), (1, 2, 2, 2, [])], schema)  # two rows for one stats file
    with pytest.raises(Exception):
        W.write_stats(twice, str(tmp_path / "stats"))
    assert list((tmp_path / "stats").rglob("*.txt")) == [] and list((tmp_path / "stats").iterdir()) == []


def test_zip_archives(spark, tmp_path):
    for n, members in enumerate((["a.csv"], ["b.csv", "folder/", "folder/c.csv", "empty.csv"])):
        with zipfile.ZipFile(tmp_path / f"list{n}.zip", "w", zipfile.ZIP_DEFLATED) as archive:
            for m in members:
                archive.writestr(m, "" if m in ("folder/", "empty.csv") else f'1,{m}\n2,"x, {m}"\n')
    one = sorted(tuple(r) for r in R.read_ranked_domains(spark, str(tmp_path / "list0.zip")).collect())
    assert one == [(1, "a.csv"), (2, "x, a.csv")]
    every = read_zip(spark, str(tmp_path))
    assert every.rdd.getNumPartitions() == 4 and every.count() == 6 and O.rank_slice(every, 0, 1).count() == 3
    assert read_zip(spark, str(tmp_path)).where("rank > 5").collect() == []


def test_policy_pages(spark, tmp_path):
    pages = spark.createDataFrame([("a.com", "https://a.com/t", "<p>")], "seed string, link string, html string")
    W.write_policy_pages(pages, str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).first()["slug"] == "a.com_t"


def test_embedding_cache(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encoder():
        inner = hashing_encoder(8)()

        def encode(texts):
            calls.add(len(texts))
            return inner(texts)

        return encode

    encoder.name = "counted"
    df = spark.createDataFrame([("a b",), ("c",), ("a b",)], "paragraph string")
    path = str(tmp_path / "cache")
    assert W.embedding_cache(df, encoder, path).count() == 3
    assert calls.value == 2
    more = df.unionByName(spark.createDataFrame([("d",)], "paragraph string"))
    assert W.embedding_cache(more, encoder, path).count() == 4
    assert calls.value == 3
    other = hashing_encoder(16)
    assert {len(r["vec"]) for r in W.embedding_cache(more, other, path).collect()} == {16}
    nulls = spark.createDataFrame([(None,), ("a b",)], "paragraph string")
    assert W.embedding_cache(nulls, other, path).where("vec IS NULL").count() == 1
    assert embed(nulls, other).where("vec IS NULL").count() == 1
    with pytest.raises(ValueError, match="name"):
        W.embedding_cache(df, lambda: None, path)


def test_the_cache_is_read_by_bucket_and_holds_a_key_once(spark, tmp_path):
    df = spark.createDataFrame([(f"text {i % 40}",) for i in range(100)], "paragraph string")
    encoder, path = hashing_encoder(8), str(tmp_path / "cache")
    first = W.embedding_cache(df, encoder, path, buckets=4).count()
    table = W.cached_vectors(spark, path, encoder.name, 4)
    assert first == 100 and spark.table(table).count() == 40
    twice = spark.table(table).collect()  # as if another run had added the same texts
    spark.createDataFrame(twice, spark.table(table).schema).repartition(4, "text_key").write.insertInto(table)
    assert spark.table(table).count() == 80
    again = W.embedding_cache(df, encoder, path, buckets=4)
    assert again.count() == 100 and again.where("vec IS NULL").count() == 0 and spark.table(table).count() == 80
    keys = df.select(F.md5("paragraph").alias("text_key")).distinct()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (W.lookup(keys, table, 4), missing_embeddings(df, spark.table(table), buckets=4)):
            cache_side = joined._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1].rsplit("REPARTITION_BY_NUM", 1)[1]
            cache_side = cache_side[cache_side.index("Scan ExistingRDD") :]
            assert "Exchange" not in cache_side and "Bucketed: true" in cache_side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def rows_of(spark, out):
    schema = "url string, page_key string, pos int, paragraph string"
    return sorted(map(tuple, T.read_batches(spark, out, spark.createDataFrame([], schema).schema).collect()))


def test_stream_equals_batch_and_skips_seen_files(spark, tmp_path):
    pages, out, checkpoint = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (pages / "a.com").mkdir(parents=True)
    (pages / "a.com" / "t1").write_text(f"<p>{LONG}</p><p>short</p><p>{LONG}</p>")
    T.sanitise_stream(spark, str(pages), out, checkpoint).awaitTermination()
    assert len(rows_of(spark, out)) == 1
    (pages / "a.com" / "t2").write_text(f"<p>{LONG} more</p>")
    for _ in range(2):
        T.sanitise_stream(spark, str(pages), out, checkpoint).awaitTermination()
    batch = P.sanitise_pages(R.read_pages(spark, str(pages)), page_key="page_key")
    assert rows_of(spark, out) == sorted(map(tuple, batch.collect()))


def test_columns_of_a_stream_are_laid_out_once(spark, tmp_path, monkeypatch):
    """Not once per micro-batch: a stream may have thousands."""
    pages, out, checkpoint = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (pages / "a.com").mkdir(parents=True)
    for i in range(5):
        (pages / "a.com" / f"t{i}").write_text(f"<p>{LONG} {i}</p>")
    calls, sanitise = [], T.sanitise_pages
    monkeypatch.setattr(T, "sanitise_pages", lambda *a, **k: (calls.append(1), sanitise(*a, **k))[1])
    T.sanitise_stream(spark, str(pages), out, checkpoint, max_files=2).awaitTermination()
    assert len(T.committed(spark, out)) == 3 and len(calls) == 1
    batch = P.sanitise_pages(R.read_pages(spark, str(pages)), page_key="page_key")
    assert rows_of(spark, out) == sorted(map(tuple, batch.collect())) and len(rows_of(spark, out)) == 5


@pytest.mark.parametrize("lanes", [1, 3, 4, 62])
def test_every_name_is_in_one_lane(lanes):
    names = [f"{a}{b}" for a in ("p1", "", "a-") for b in "0189azAZ_-é]!^.*\U0001d504"]
    for name in names:
        assert sum(fnmatch.fnmatchcase(name, glob) for glob in T.lane_globs(lanes)) == 1


def test_lanes_read_every_file_once(spark, tmp_path):
    """Files of all kinds of names, batches no larger than asked for, a second run that adds what is new only."""
    pages, out, checkpoint = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    names = [*(f"p{i}" for i in range(12)), "terms", "refundS", "x-", "é", "a]", "b!", "c^", "d e"]
    (pages / "a.com").mkdir(parents=True)
    for i, name in enumerate(names):
        (pages / "a.com" / name).write_text(f"<p>{LONG} {i}</p>")
    before = spark.conf.get(T.THRESHOLD)
    T.sanitise_lanes(spark, str(pages), out, checkpoint, max_files=2, lanes=4)
    batch = P.sanitise_pages(R.read_pages(spark, str(pages)), page_key="page_key")
    assert rows_of(spark, out) == sorted(map(tuple, batch.collect())) and len(rows_of(spark, out)) == len(names)
    batches = T.committed(spark, out)
    assert len(batches) >= len(names) / 2 and {b[:4] for b in batches} == {f"4-{k}-" for k in range(4)}
    (pages / "a.com" / "new").write_text(f"<p>{LONG} new</p>")
    T.sanitise_lanes(spark, str(pages), out, checkpoint, max_files=2, lanes=4)
    assert len(rows_of(spark, out)) == len(names) + 1 == len(set(rows_of(spark, out))) and len(T.committed(spark, out)) == len(batches) + 1
    assert spark.conf.get(T.THRESHOLD) == before


@pytest.mark.parametrize("stop", ["before the marker", "after the marker"])
def test_a_stopped_stream_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, stop):
    """The job ends between writing a batch and checking it off; the next run writes that batch again."""
    pages, out, checkpoint = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    (pages / "a.com").mkdir(parents=True)
    for i in range(5):
        (pages / "a.com" / f"t{i}").write_text(f"<p>{LONG} {i}</p>")
    whole, written = T.write_batch, []

    def write(rows, out, batch):
        whole(rows, out, batch)
        written.append(batch)
        if len(written) == 2:
            if stop == "before the marker":
                T.forget(spark, out, batch)
            raise RuntimeError("stopped")

    monkeypatch.setattr(T, "write_batch", write)
    with pytest.raises(Exception, match="stopped"):
        T.sanitise_stream(spark, str(pages), out, checkpoint, max_files=2).awaitTermination()
    assert len(rows_of(spark, out)) == (2 if stop == "before the marker" else 4)
    T.sanitise_stream(spark, str(pages), out, checkpoint, max_files=2).awaitTermination()
    assert written.count(written[1]) == 2
    got = rows_of(spark, out)
    assert len(got) == len(set(got)) == 5


def test_incremental_runs_again_after_a_stop(spark, tmp_path):
    out = str(tmp_path / "done")
    calls = []

    def job(df):
        calls.append(df.count())
        return df.withColumn("twice", F.col("n") * 2)

    inputs = spark.createDataFrame([(i, i) for i in range(10)], "k int, n int")
    schema = job(inputs).schema
    assert T.incremental(job, inputs.where("k < 4"), out, ["k"], "one", schema).count() == 4
    assert T.incremental(job, inputs, out, ["k"], "two", schema).count() == 10
    T.forget(spark, out, "two")
    assert T.committed(spark, out) == ["one"] and T.read_batches(spark, out, schema).count() == 4
    rows = T.incremental(job, inputs, out, ["k"], "two", schema).collect()
    assert sorted(r["k"] for r in rows) == list(range(10)) and calls == [10, 4, 6, 6]
    assert T.incremental(job, inputs, out, ["k"], "three", schema).count() == 10 and calls[-1] == 0


def test_split_table_identity(spark):
    rows = [("s1", 0), ("s1", 0), ("s2", 0), ("s1", 1)]
    df = spark.createDataFrame(rows, "url string, split int")
    assert tuple(P.dataset_totals(df).first()) == (4, 3, 2)
    per = P.dataset_stats(df).agg(F.sum("n_rows"), F.sum("n_sites")).first()
    assert tuple(per) == (4, 3)
