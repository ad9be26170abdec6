"""Every operator as a query over the given tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.functions import language_model as language_models
from clausework.functions import language, prompts, responses, text, urls, vectors
from clausework.operators import clustering as C
from clausework.operators import labels as L
from clausework.operators import links as K
from clausework.operators import neighbours as N
from clausework.operators import pages as G
from clausework.operators import paragraphs as P
from clausework.operators import positions as O
from clausework.operators import sites as S
from clausework.operators import sparse
from clausework.operators import tags as A
from clausework.operators.embedding import embed, hashing_encoder, missing_embeddings
from clausework.operators.lineage import materialise, passing_stages, scratch_root, settle
from clausework.operators.skew import skew_join
from clausework.plans import clusters as CL
from clausework.plans import policy_crawl as CR
from clausework.plans import site_funnel as SF
from clausework.plans.report import report
from clausework.sources import readers as R
from clausework.sources import writers as W
from clausework.sources.chunk_files import read_zip, write_chunk_files
from clausework.streaming.sanitise import forget, incremental, read_batches, sanitise_lanes, write_batch, write_stream
from workload import derived as D

QUERIES = {}

EPS = 0.66
SWEEP = [0.62, 0.66, 0.7]
DOC_EPS = [0.01, 0.05]
TERM_EPS = 0.1
SITES_PER_SPLIT = 7
SITES_DDL = "url STRING, language STRING, is_shopping INT, html STRING"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def flag(column):
    return column.cast("int")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "documents")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "pages")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """``url, page_key, pos, paragraph``: the lines of every document."""
    named = docs(spark, sf).select(F.col("source").alias("url"), F.col("doc_id").alias("page_key"), "text")
    return P.explode_lines(named, ["url", "page_key"])


# ---- text -----------------------------------------------------------------------------------


@query
def strip_scheme(spark, sf):
    return pages(spark, sf).select("page_id", urls.strip_scheme(F.col("url")).alias("domain"))


@query
def with_scheme(spark, sf):
    bare = F.when(F.col("page_id") % 2 == 0, urls.strip_scheme(F.col("url"))).otherwise(F.col("url"))
    return pages(spark, sf).select("page_id", urls.with_scheme(bare).alias("url"))


@query
def page_slug(spark, sf):
    return pages(spark, sf).select("page_id", urls.page_slug(F.col("url")).alias("slug"))


@query
def strip_text(spark, sf):
    padded = F.concat(F.lit(" \n"), F.col("text"), F.lit("  \n"))
    return docs(spark, sf).select("doc_id", text.strip(padded).alias("text"))


@query
def normalise_ws(spark, sf):
    padded = F.replace(F.col("text"), F.lit("."), F.lit(" . \n"))
    return docs(spark, sf).select("doc_id", text.normalise_ws(padded).alias("text"))


@query
def sanitise_quotes(spark, sf):
    return docs(spark, sf).select("doc_id", text.sanitise_quotes(F.col("text")).alias("text"))


@query
def split_sentences(spark, sf):
    parts = F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "sentence")
    return docs(spark, sf).select("doc_id", parts)


@query
def explode_lines(spark, sf):
    return lines(spark, sf)


@query
def explode_terms(spark, sf):
    """Whole documents as replies, a term per line."""
    return P.explode_terms(docs(spark, sf), ["doc_id"], "text")


@query
def non_blank(spark, sf):
    return P.non_blank(lines(spark, sf)).select("page_key", "pos")


@query
def min_words(spark, sf):
    return P.min_words(lines(spark, sf)).select("page_key", "pos", "paragraph")


@query
def text_match(spark, sf):
    """Lines of the documents, and page texts with a policy word put behind every third line."""
    word = D.by_remainder("pos", ("", " Return POLICY", " privacy policy"))
    return D.terms(spark, sf).select("doc_id", "pos", flag(urls.text_match(F.concat("term", word))).alias("matched"))


@query
def detect_language(spark, sf):
    return docs(spark, sf).select("doc_id", language.detect_language(F.col("text")).alias("language"))


@query
def language_model(spark, sf):
    """The likeliest language of every document and page by a model fitted to the documents' language tags."""
    model = language_models.fit_languages(docs(spark, sf))
    texts = docs(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    bare = F.regexp_replace("html", "(?s)<[^>]*>", " ")
    texts = texts.unionByName(pages(spark, sf).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), bare.alias("text")))
    return texts.select("kind", "id", model.detect(F.col("text")).alias("language"))


# ---- paragraphs -----------------------------------------------------------------------------


@query
def dedupe_page(spark, sf):
    return P.dedupe(P.min_words(lines(spark, sf)), "page")


@query
def dedupe_site(spark, sf):
    return P.dedupe(P.min_words(lines(spark, sf)), "site")


@query
def dedupe_global(spark, sf):
    return P.dedupe(P.min_words(lines(spark, sf)), "global")


def clean_docs(spark, sf):
    return P.sanitise_lines(docs(spark, sf), "source", "doc_id")


@query
def sanitise_documents(spark, sf):
    return clean_docs(spark, sf).select("url", "page_key", "pos", "paragraph")


def host(url: str = "url"):
    return F.regexp_extract(url, D.HOST, 1)


@query
def sanitise_pages(spark, sf):
    return P.sanitise_pages(pages(spark, sf).withColumn("site", host()), "site").select("url", "page_key", "pos", "paragraph")


@query
def page_paragraphs(spark, sf):
    return G.paragraph_rows(pages(spark, sf), ["page_id"])


@query
def visible_text(spark, sf):
    return G.visible_text(pages(spark, sf), ["page_id"])


@query
def concat_splits(spark, sf):
    rows = docs(spark, sf).select("doc_id", "source")
    parts = [rows.where(F.col("doc_id") % 4 == i) for i in range(4)]
    return P.concat_splits(parts)


@query
def stream_sanitise(spark, sf):
    """The documents as a file stream, sanitised into a parquet table, then read back."""
    source = spark.readStream.schema(docs(spark, sf).schema).parquet(f"{sf}/documents*.parquet")
    return write_and_read(spark, P.sanitise_lines(source, "source", "doc_id")).select("url", "page_key", "paragraph")


@query
def stream_sanitise_pages(spark, sf):
    source = spark.readStream.schema(pages(spark, sf).schema).parquet(f"{sf}/pages*.parquet")
    rows = P.sanitise_pages(source.withColumn("site", host()), "site")
    return write_and_read(spark, rows).select("url", "page_key", "pos", "paragraph")


def write_and_read(spark, rows):
    path = folder(spark, "stream")
    write_stream(rows, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return read_batches(spark, f"{path}/out", rows.schema)


def page_files(spark, sf):
    """A folder per site with one HTML file per page, written by the tasks."""
    path = folder(spark, "pages")
    rows = pages(spark, sf).select(host().alias("site"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), "html")
    W.write_page_files(rows, path)
    return path


@query
def read_page_files(spark, sf):
    """Page folders read back: site, file name and text."""
    back = R.read_pages(spark, page_files(spark, sf))
    return back.select("url", "page_key", F.md5("html").alias("html_md5"))


@query
def stream_page_files(spark, sf):
    """Page files streamed in micro-batches, sanitised, and read from the finished batches."""
    path = folder(spark, "stream")
    sanitise_lanes(spark, page_files(spark, sf), f"{path}/out", f"{path}/checkpoint", max_files=100)
    schema = P.sanitise_pages(R.read_pages(spark, path), page_key="page_key").schema
    rows = read_batches(spark, f"{path}/out", schema)
    return rows.select("url", F.substr(F.col("page_key"), F.lit(2)).cast("long").alias("page_key"), "pos", "paragraph")


# ---- positions ------------------------------------------------------------------------------


@query
def row_position(spark, sf):
    return O.row_position(docs(spark, sf).select("doc_id", "source"), ["source", "doc_id"])


@query
def rank_slice(spark, sf):
    ranked = D.table(spark, sf, "part").select((F.col("p_partkey") + 1).alias("rank"), F.col("p_name").alias("domain"))
    n = ranked.count()
    return O.rank_slice(ranked, n // 4, n // 2)


@query
def position_slice(spark, sf):
    rows = D.table(spark, sf, "part").select("p_partkey", "p_name")
    n = rows.count()
    return O.position_slice(rows, ["p_name", "p_partkey"], n // 4, n // 2)


@query
def assign_splits(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.col("source").alias("url"))
    return O.assign_splits(rows, "url", SITES_PER_SPLIT)


@query
def chunk_of_100(spark, sf):
    return O.chunk_of(docs(spark, sf).select("doc_id"), ["doc_id"])


@query
def assign_chunks(spark, sf):
    return O.assign_chunks(docs(spark, sf).select("doc_id"), ["doc_id"], 7)


@query
def sample_members(spark, sf):
    return O.sample_members(docs(spark, sf).select("source", "doc_id"), ["source"], "doc_id", k=5, seed=7)


@query
def latest_wins(spark, sf):
    slugs = pages(spark, sf).select("page_id", host().alias("site"), F.md5("html").alias("html_md5"))
    return O.latest_wins(slugs, ["site"], ["page_id"], "page_id")


@query
def cluster_rank(spark, sf):
    roots = D.table(spark, sf, "embeddings").select((F.col("label") % 3).alias("g"), F.col("label").cast("long").alias("root"))
    return C.cluster_rank(roots, ["g"])


def chunk_files(spark, sf):
    start = F.floor(F.col("doc_id") / 100) * 100
    name = F.concat(F.lit("sites_"), start.cast("string"), F.lit("_"), (start + 100).cast("string"), F.lit(".json"))
    first, last = urls.file_range(F.col("name"))
    return docs(spark, sf).select(name.alias("name")).distinct().select("name", first.alias("start"), last.alias("end"))


@query
def file_range_of(spark, sf):
    return chunk_files(spark, sf)


@query
def file_range(spark, sf):
    return S.file_range(chunk_files(spark, sf), 200, 700)


@query
def range_bounds(spark, sf):
    return S.range_bounds(chunk_files(spark, sf))


# ---- pages and links ------------------------------------------------------------------------


@query
def html_lang(spark, sf):
    return G.page_language(pages(spark, sf), ["page_id"])


@query
def english_only(spark, sf):
    return S.english_only(G.page_language(pages(spark, sf), ["page_id"]))


@query
def language_histogram(spark, sf):
    return S.language_histogram(G.page_language(pages(spark, sf), ["page_id"]))


@query
def extract_links(spark, sf):
    return G.extract_links(pages(spark, sf), ["page_id"])


@query
def accessible(spark, sf):
    return S.accessible(D.funnel_inputs(spark, sf)[1]).select("url")


def own_links(spark, sf):
    """Every derived hyperlink with its page's own site as the seed."""
    hosts = D.page_hosts(spark, sf)
    rows = D.page_links(hosts).join(hosts.select("page_id", F.col("host").alias("seed")), "page_id")
    return rows.withColumn("link", urls.resolve_link(F.col("href"), F.col("onclick"), F.col("seed")))


@query
def resolve_link(spark, sf):
    return own_links(spark, sf).select("page_id", "k", "link")


@query
def valid_url(spark, sf):
    return own_links(spark, sf).select("page_id", "k", flag(urls.valid_url(F.col("href"))).alias("valid"))


@query
def onclick_link(spark, sf):
    return own_links(spark, sf).select("page_id", "k", urls.onclick_link(F.col("onclick")).alias("link"))


@query
def link_match(spark, sf):
    rows = own_links(spark, sf).where(F.col("link").isNotNull())
    return rows.select("page_id", "k", flag(urls.link_match(F.col("link"), F.col("seed"))).alias("matched"))


@query
def fetch_join(spark, sf):
    seeds, facts = D.link_graph(spark, sf)
    return K.fetch_join(K.candidate_links(seeds), facts).select("seed", "link", "language")


@query
def fetch_errors(spark, sf):
    seeds, facts = D.link_graph(spark, sf)
    return K.fetch_errors(K.candidate_links(seeds), facts)


@query
def not_visited(spark, sf):
    """Links found on the pages of level 1 that are not themselves level 1."""
    seeds, facts = D.link_graph(spark, sf)
    first = K.candidate_links(seeds)
    return K.not_visited(K.candidate_links(K.fetch_join(first, facts)), first)


@query
def union_links(spark, sf):
    seeds, facts = D.link_graph(spark, sf)
    first = K.candidate_links(seeds)
    return K.union_links([first, K.candidate_links(K.fetch_join(first, facts))])


@query
def site_seeds(spark, sf):
    """Sites that pass the open gate, with the links of their home page."""
    domains, captured, replies = D.funnel_inputs(spark, sf)
    records = SF.site_records(SF.site_inputs(domains, captured, replies), captured)
    return CR.site_seeds(records, "truthy").select("seed", F.array_join("links.href", " ").alias("hrefs"))


@query
def policy_crawl(spark, sf):
    return CR.policy_crawl(*D.link_graph(spark, sf))


@query
def html_crawl(spark, sf):
    """The same walk over markup: pages are parsed when a level first asks for them."""
    home, captured = D.crawl_pages(spark, sf)
    return CR.policy_crawl(CR.site_seeds(home), CR.facts_on_demand(materialise(captured, "captured")))


@query
def crawl_levels(spark, sf):
    walked = CR.crawl_levels(*D.link_graph(spark, sf))
    return walked.groupBy("depth").agg(
        F.count("*").alias("candidates"),
        F.count_if("fetched").alias("fetched"),
        F.count_if(F.col("fetched") & F.col("english")).alias("kept"),
    )


@query
def policy_page_counts(spark, sf):
    return S.policy_page_counts(CR.policy_crawl(*D.link_graph(spark, sf)), "seed")


@query
def not_collected(spark, sf):
    done = D.table(spark, sf, "labels")
    return K.not_collected(docs(spark, sf).select("doc_id", "source"), done, ["doc_id"])


@query
def incremental_job(spark, sf):
    """The labelled documents sanitised first, then a stopped run, then the others: no row is lost or doubled."""
    path = folder(spark, "finished")
    job = lambda df: P.sanitise_lines(df, "source", "doc_id").withColumn("doc_id", F.col("page_key"))
    schema = job(docs(spark, sf)).schema
    labelled = docs(spark, sf).join(D.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    incremental(job, labelled, path, ["doc_id"], "labelled", schema)
    write_batch(job(docs(spark, sf)), path, "stopped")
    forget(spark, path, "stopped")  # as if the run had ended before its commit
    rows = incremental(job, docs(spark, sf), path, ["doc_id"], "stopped", schema)
    return rows.select("url", "page_key", "paragraph")


# ---- site funnel ----------------------------------------------------------------------------


@query
def parse_site_class(spark, sf):
    value, error = responses.parse_site_class(F.col("response"))
    return D.funnel_inputs(spark, sf)[2].select("url", value.alias("is_shopping"), flag(error).alias("class_error"))


@query
def site_funnel(spark, sf):
    domains, captured, replies = D.funnel_inputs(spark, sf)
    records = SF.site_records(SF.site_inputs(domains, captured, replies), captured)
    return records.select("url", "language", "is_shopping", F.md5("html").alias("html_md5"))


@query
def shopping_gate_strict(spark, sf):
    return S.shopping_gate(SF.site_inputs(*D.funnel_inputs(spark, sf)).where("english")).select("url", "is_shopping")


@query
def shopping_gate_truthy(spark, sf):
    inputs = SF.site_inputs(*D.funnel_inputs(spark, sf)).where("english")
    return S.shopping_gate(inputs, "truthy").select("url", "is_shopping")


@query
def funnel_counts(spark, sf):
    counts = S.funnel_counts(SF.site_inputs(*D.funnel_inputs(spark, sf)))
    return counts.withColumn("error_urls", F.array_join("error_urls", " "))


@query
def funnel_totals(spark, sf):
    return S.funnel_totals(S.funnel_counts(SF.site_inputs(*D.funnel_inputs(spark, sf))))


# ---- dataset statistics ---------------------------------------------------------------------


def split_paragraphs(spark, sf):
    return O.assign_splits(materialise(clean_docs(spark, sf), "paragraphs"), "url", SITES_PER_SPLIT)


@query
def dataset_stats(spark, sf):
    return P.dataset_stats(split_paragraphs(spark, sf))


@query
def dataset_totals(spark, sf):
    by_page = clean_docs(spark, sf).withColumn("split", (F.col("page_key") % 4).cast("int"))
    return P.dataset_totals(by_page)


@query
def stage_report(spark, sf):
    counts = S.funnel_counts(SF.site_inputs(*D.funnel_inputs(spark, sf)))
    policy = CR.policy_crawl(*D.link_graph(spark, sf)).withColumnRenamed("seed", "site")
    return report(counts, chunk_files(spark, sf), policy, split_paragraphs(spark, sf))


# ---- vectors and clusters -------------------------------------------------------------------


def whole_vector(vec, places):
    """All components as whole numbers of a unit."""
    return F.array_join(F.transform(vec, lambda x: F.round(x.cast("double") * 10**places).cast("long").cast("string")), ",")


@query
def l2_normalise(spark, sf):
    scaled = F.transform("vec", lambda x: x * F.lit(3.0))
    unit = vectors.l2_normalise(scaled)
    return D.points(spark, sf).select("id", F.round(vectors.l2_norm(unit), 6).alias("norm"), whole_vector(unit, 5).alias("unit"))


@query
def cosine_distance(spark, sf):
    """The distance of both vectors of every near pair, and of every vector to the one with the next number."""
    return near_distances(materialise(D.points(spark, sf), "points"), EPS, every_copy=True)


def near_distances(points, eps, every_copy=False):
    """A pair's distance comes from the task that found it, so no pair is shuffled; where an id names several vectors, it is
    that of each of them. Copies of a vector go by their smallest id, or with ``every_copy`` each by its own."""
    sides = [points.select(F.col("id").alias(f"id_{s}"), F.col("vec").alias(f"vec_{s}")) for s in "ab"]
    exact = vectors.cosine_distance(F.col("vec_a"), F.col("vec_b"))
    dist = F.round(exact, 6).alias("dist")
    following = sides[0].join(sides[1].withColumn("id_a", F.col("id_b") - 1), "id_a").select("id_a", "id_b", dist)
    pairs = N.point_pairs(N.collapse_copies(points, []), eps) if every_copy else N.eps_neighbours(points, eps)
    near = pairs.where("id_b <> id_a + 1").select("id_a", "id_b", F.round("dist", 6).alias("dist"))
    if not points.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        near = near.select("id_a", "id_b").distinct().join(sides[0], "id_a").join(sides[1], "id_b")
        if every_copy:  # what one vector of an id is near to need not be near to the others
            near = near.where(exact <= eps + 1e-9)
        near = near.select("id_a", "id_b", dist)
    return near.unionByName(following)


@query
def eps_neighbours(spark, sf):
    return near_points(D.points(spark, sf), EPS, 6)


def near_points(points, eps, places):
    """Per point the number of other points within eps and the distance of the nearest."""
    c = N.collapse_copies(points, [])
    nearest = F.round(F.greatest("nearest", F.lit(0.0)), places).alias("nearest")
    per_vector = N.near_counts(c, N.place_blocks(c, eps), eps).select("rid", F.col("n").alias("n_near"), nearest)
    return N.members_of(c).join(per_vector, "rid").select("id", "n_near", "nearest")


@query
def term_neighbours(spark, sf):
    """Near copies among whole documents by all their terms, none folded together."""
    vectors = sparse.collapse_vectors(sparse.term_counts(docs(spark, sf), "doc_id", "text"))
    nearest = F.round(F.greatest("nearest", F.lit(0.0)), 6).alias("nearest")
    return vectors.members.join(sparse.near_counts(vectors, TERM_EPS), "rid").select("id", F.col("n").alias("n_near"), nearest)


@query
def core_flags(spark, sf):
    flags = N.core_flags(D.points(spark, sf), EPS)
    return flags.withColumn("is_core", flag(F.col("is_core")))


@query
def dbscan(spark, sf):
    return C.dbscan(D.points(spark, sf), EPS)


@query
def dbscan_sweep(spark, sf):
    return C.dbscan_sweep(D.points(spark, sf), SWEEP)


@query
def embed_documents(spark, sf):
    """The term-frequency vector of every document."""
    vec = embed(docs(spark, sf).select("doc_id", F.col("text").alias("paragraph")), hashing_encoder())
    return vec.select("doc_id", whole_vector("vec", 4).alias("vec"))


def doc_points(spark, sf):
    named = docs(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("paragraph"))
    return embed(named, hashing_encoder()).select("id", "vec")


@query
def tf_neighbours(spark, sf):
    """Near copies among whole documents by term-frequency cosine."""
    return near_points(materialise(doc_points(spark, sf), "vectors"), DOC_EPS[0], 4)


@query
def cluster_chunks(spark, sf):
    """Whole documents embedded and clustered in four chunks, two eps values at once."""
    named = docs(spark, sf).select("doc_id", F.col("text").alias("paragraph"))
    _, labels = CL.cluster_chunks(named, hashing_encoder(), DOC_EPS, ["doc_id"], num_chunks=4, min_samples=3)
    return labels


@query
def missing_embedding(spark, sf):
    """Texts whose vector is not cached, when the labelled documents are."""
    named = docs(spark, sf).select("doc_id", F.col("text").alias("paragraph"))
    done = D.table(spark, sf, "labels").select("doc_id")
    cached = named.join(done, "doc_id", "left_semi").select(F.md5("paragraph").alias("text_key")).distinct()
    return missing_embeddings(named, cached).select("text_key")


KEYS = ["split", "chunk", "eps", "cluster_id"]
LINE_EPS = [0.25]


def split_labels(spark, sf, eps_list=LINE_EPS):
    """Sanitised lines of all documents by split and chunk, and their labels."""
    return CL.label_splits(clean_docs(spark, sf), hashing_encoder(), list(eps_list), 10, 2, SITES_PER_SPLIT)


def members(spark, sf):
    """``split, chunk, eps, cluster_id, id, paragraph``. Texts are fetched each time that it is read."""
    splits = split_labels(spark, sf)
    return splits.texts(splits.labels).select(*KEYS, "id", "paragraph")


@query
def cluster_splits(spark, sf):
    """The reference's own job: sanitised paragraphs, splits, chunks, vectors, clusters."""
    return members(spark, sf).select(*KEYS, "id", F.md5("paragraph").alias("text_md5"))


@query
def cluster_size_between(spark, sf):
    return C.cluster_size_between(C.cluster_sizes(split_labels(spark, sf).labels, KEYS[:3]))


@query
def members_with_repeat(spark, sf):
    """Sizes that count the first member twice, against the same bounds."""
    repeated = C.members_with_repeat(clusters(spark, sf, reference_sizes=True))
    return repeated.select(*KEYS, "size", F.array_join("paragraphs", "\n").alias("paragraphs"))


def clusters(spark, sf, reference_sizes=False):
    """The bounded clusters, collected; only their texts are fetched."""
    splits = split_labels(spark, sf)
    sizes = C.cluster_size_between(C.cluster_sizes(splits.labels, KEYS[:3], reference_sizes=reference_sizes))
    kept = materialise(skew_join(splits.labels, sizes, KEYS, salt_by=["id"]), "kept")
    return C.gather_clusters(splits.texts(kept).select(*KEYS, "size", "id", "paragraph"), KEYS[:3])


@query
def collect_clusters(spark, sf):
    return clusters(spark, sf).select(*KEYS, "size", F.array_join("paragraphs", "\n").alias("paragraphs"))


def financial(spark, sf):
    """Prompts for the bounded clusters, five texts each."""
    return settle(lambda: CL.financial_prompts(clusters(spark, sf), k=5, seed=7), "prompts")


@query
def build_prompt(spark, sf):
    return financial(spark, sf).select(*KEYS, "prompt", "prompt_hash")


def financial_labelled(spark, sf, unwrap=False):
    asked = financial(spark, sf)
    key = [*KEYS, "prompt_hash"]
    return CL.label_clusters(asked, D.replies_for(asked, D.CLUSTER_REPLIES, key), key, unwrap)


@query
def response_join(spark, sf):
    """Documents with their label as the reply; most have none."""
    replies = D.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("response"))
    return L.response_join(docs(spark, sf).select("doc_id"), replies, ["doc_id"])


@query
def unanswered(spark, sf):
    return L.unanswered(docs(spark, sf).select("doc_id"), D.table(spark, sf, "labels"), ["doc_id"])


@query
def parse_label(spark, sf):
    replies = docs(spark, sf).select("doc_id", D.by_remainder("doc_id", D.CLUSTER_REPLIES).alias("response"))
    plain, confidence = responses.parse_financial(F.col("response"))
    unwrapped, _ = responses.parse_financial(F.col("response"), unwrap=True)
    return replies.select("doc_id", plain.alias("plain"), unwrapped.alias("unwrapped"), confidence.alias("confidence"))


@query
def label_clusters(spark, sf):
    kept = L.financial_filter(financial_labelled(spark, sf))
    return kept.select(*KEYS, "size", "confidence", F.array_join("paragraphs", "\n").alias("paragraphs"))


@query
def label_clusters_unwrap(spark, sf):
    return L.financial_filter(financial_labelled(spark, sf, unwrap=True)).select(*KEYS, "size")


@query
def label_rejects(spark, sf):
    return L.rejects(financial_labelled(spark, sf)).select(*KEYS, "response")


def topics(spark, sf):
    asked = settle(lambda: CL.topic_prompts(L.financial_filter(financial_labelled(spark, sf)), prompts.CATEGORY, k=5, seed=7), "prompts")
    key = [*KEYS, "prompt_hash"]
    return CL.topic_clusters(asked, D.replies_for(asked, D.TOPIC_REPLIES, key), key)


@query
def topic_clusters(spark, sf):
    return topics(spark, sf).select(*KEYS, "size", "category")


@query
def category_counts(spark, sf):
    return L.category_counts(topics(spark, sf))


# ---- tags -----------------------------------------------------------------------------------


def tagged(spark, sf):
    return A.taxonomy_tag(D.terms(spark, sf), D.RULES, "term")


@query
def taxonomy_tag(spark, sf):
    return tagged(spark, sf).select("doc_id", "pos", F.array_join("categories", "|").alias("categories"))


@query
def undisclosed_terms(spark, sf):
    """Lines that no even document of the site states; upper case and doubled spaces make no difference."""
    terms = materialise(D.terms(spark, sf), "terms")
    stated = terms.where("doc_id % 2 = 0").withColumn("term", F.translate(F.replace("term", F.lit(" "), F.lit("  ")), "abcdefghij", "ABCDEFGHIJ"))
    return A.undisclosed_terms(terms, stated)


@query
def site_profile(spark, sf):
    return A.site_profile(tagged(spark, sf), list(D.CATEGORIES), "site")


@query
def parse_products(spark, sf):
    parsed = D.payment_pages(spark, sf).select("doc_id", responses.parse_products(F.col("response")).alias("r"))
    rows = parsed.select("doc_id", "r.is_payment_page", F.explode_outer("r.products").alias("p"))
    return rows.select("doc_id", "is_payment_page", "p.name", "p.price", "p.shipping_charge")


@query
def parse_annotation(spark, sf):
    reply = F.concat(F.lit('{"topic_classification": '), F.when(F.col("doc_id") % 2 == 0, F.lit('"Warranty"')).otherwise(F.lit('["Warranty", "Others"]')), F.lit(', "has_financial_term": '), (F.col("doc_id") % 3 % 2).cast("string"), F.lit("}"))
    named, financial_term = responses.parse_annotation(F.col("response"))
    rows = docs(spark, sf).select("doc_id", reply.alias("response"))
    return rows.select("doc_id", F.array_join(named, "|").alias("topics"), financial_term.alias("has_financial_term"))


# ---- files and surfaces ---------------------------------------------------------------------


def folder(spark, label):
    return f"{scratch_root(spark)}/clausework/{spark.sparkContext.applicationId}/{label}-{uuid4().hex}"


@query
def ranked_domains_csv(spark, sf):
    path = folder(spark, "ranked")
    pages(spark, sf).select((F.col("page_id") + 1).alias("rank"), host().alias("domain")).write.csv(path)
    return R.read_ranked_domains(spark, path)


@query
def domain_jsonl(spark, sf):
    path = folder(spark, "domains")
    pages(spark, sf).select(F.col("url").alias("domain"), "page_id").write.json(path)
    return R.read_domain_jsonl(spark, path)


@query
def shop_csv(spark, sf):
    path = folder(spark, "shops")
    pages(spark, sf).select(F.col("url").alias("Online shop URL"), "page_id").write.csv(path, header=True)
    return R.read_shop_csv(spark, path)


@query
def sites_json(spark, sf):
    """Site records written per chunk and read back."""
    path = folder(spark, "sites")
    domains, captured, replies = D.funnel_inputs(spark, sf)
    inputs = SF.site_inputs(domains, captured, replies)
    records = SF.site_records(inputs, captured).join(inputs.select("url", "chunk"), "url")
    W.write_sites(records, path)
    back = R.read_sites(spark, path).withColumn("chunk", (F.col("start") / 100).cast("int"))
    return back.select("url", "language", "is_shopping", "chunk", F.md5("html").alias("html_md5"))


@query
def sites_in_range(spark, sf):
    """The files of a range of inputs only."""
    path = folder(spark, "sites")
    named = pages(spark, sf).select(
        "url", F.lit("en").alias("language"), F.lit(1).alias("is_shopping"), "html", F.floor(F.col("page_id") / 100).alias("chunk")
    )
    W.write_sites(named, path)
    return R.read_sites(spark, path, 100, 300).select("url", "start", "end", F.md5("html").alias("html_md5"))


@query
def stats_files(spark, sf):
    """Chunk counters written as two-line files and read back."""
    path = folder(spark, "stats")
    W.write_stats(S.funnel_counts(SF.site_inputs(*D.funnel_inputs(spark, sf))), path)
    return R.read_stats(spark, path).withColumn("error_urls", F.array_join("error_urls", " "))


@query
def ranked_domains_zip(spark, sf):
    """A ranked list in several zip archives, read without extracting them."""
    path = folder(spark, "archives")
    ranked = D.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("rank"), F.col("p_name").alias("domain"))
    write_chunk_files(ranked.withColumn("chunk", F.floor((F.col("rank") - 1) / 500)), path, "ranked", 500)
    return read_zip(spark, path)


@query
def first_n(spark, sf):
    """A look at more rows than there are gives them all."""
    rows = pages(spark, sf).select("page_id", "url")
    return O.first_n(rows, 10**9)


@query
def cluster_maps(spark, sf):
    """Clusters as one JSON map per split, chunk and eps, read back."""
    path = folder(spark, "maps")
    with passing_stages():
        named = members(spark, sf).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("id", "paragraph")))["paragraph"].alias("p"))
        maps = named.groupBy(*KEYS[:3]).agg(F.map_from_entries(F.collect_list(F.struct(F.col("cluster_id").cast("string"), "p"))).alias("m"))
        W.write_cluster_maps(maps.select(*KEYS[:3], F.to_json("m").alias("value")), path)
    return R.read_cluster_maps(spark, path).select(*KEYS, F.array_join("paragraphs", "\n").alias("paragraphs"))


@query
def parse_stats_file(spark, sf):
    """Stats texts of the funnel chunks, parsed again."""
    counts = S.funnel_counts(SF.site_inputs(*D.funnel_inputs(spark, sf)))
    quoted = F.concat(F.lit("['"), F.array_join("error_urls", "', '"), F.lit("']"))
    line = F.concat(
        F.lit("Languages: {}\nOther stats: {'accessible': "), F.col("accessible").cast("string"),
        F.lit(", 'english': "), F.col("english").cast("string"),
        F.lit(", 'is_shopping': "), F.col("is_shopping").cast("string"),
        F.lit(", 'error_urls': "), quoted, F.lit("}\n"),
    )
    texts = counts.select("chunk", line.alias("value"))
    return texts.select("chunk", *R.parse_stats(F.col("value"))).withColumn("error_urls", F.array_join("error_urls", " "))


@query
def paragraph_csv(spark, sf):
    """Sanitised paragraphs written as quoted CSV and read back."""
    path = folder(spark, "paragraphs")
    W.write_paragraphs(clean_docs(spark, sf), path)
    return R.read_paragraphs(spark, [path], multi_line=False).select("url", "paragraph", "split")


@query
def policy_page_files(spark, sf):
    """Kept policy pages with the text of the page behind the link, written and read back."""
    path = folder(spark, "policy")
    policy = CR.policy_crawl(*D.link_graph(spark, sf))
    number = F.regexp_extract("link", r"/(\d+)$", 1).cast("long")
    texts = pages(spark, sf).select("page_id", "html")
    paths = policy.select("link").distinct().withColumn("page_id", number).join(texts, "page_id")
    W.write_policy_pages(CR.attach_html(policy, paths, "link"), path)
    return spark.read.parquet(path).select("seed", "link", "depth", "slug", F.md5("html").alias("html_md5"))


@query
def cluster_files(spark, sf):
    """Cluster membership in a folder per split, chunk and eps, read back."""
    path = folder(spark, "clusters")
    with passing_stages():
        W.write_clusters(members(spark, sf), path)
    schema = "cluster_id INT, id LONG, paragraph STRING, split INT, chunk INT, eps DOUBLE"
    return spark.read.schema(schema).json(path).select(*KEYS, "id", "paragraph")


@query
def labelled_files(spark, sf):
    """Filtered clusters as JSON lines, read back."""
    path = folder(spark, "labelled")
    with passing_stages():
        W.write_labelled(L.financial_filter(financial_labelled(spark, sf)), path)
    back = spark.read.schema("split INT, chunk INT, eps DOUBLE, cluster_id INT, paragraphs ARRAY<STRING>").json(path)
    return back.select(*KEYS, F.array_join("paragraphs", "\n").alias("paragraphs"))


@query
def embedding_cache(spark, sf):
    """Document vectors when those of the labelled documents are cached already."""
    path = folder(spark, "vectors")
    named = docs(spark, sf).select("doc_id", F.col("text").alias("paragraph"))
    known = named.join(D.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    W.embedding_cache(known, hashing_encoder(), path)
    vec = W.embedding_cache(named, hashing_encoder(), path)
    return vec.select("doc_id", whole_vector("vec", 4).alias("vec"))


@query
def classify_with(spark, sf):
    """A user's classifier over a prompt per line."""
    prompt = prompts.build_prompt(prompts.FINANCIAL, F.col("term"))
    replies = L.classify_with(D.terms(spark, sf).withColumn("prompt", prompt), word_classifier, ["doc_id", "pos"])
    return L.financial_labels(replies).select("doc_id", "pos", "classification", "confidence")


def word_classifier():
    return lambda batch: ['{"classification": %d, "confidence": 0.5}' % ("thble" in text) for text in batch]


@query
def html_content_only(spark, sf):
    served = pages(spark, sf).select(
        "page_id", D.by_remainder("page_id", ("text/html; charset=utf-8", "Text/HTML", "application/pdf", None)).alias("content_type")
    )
    return S.html_content_only(served)
