"""URL filter: rules first, and for what no rule covers the trust that flows over the links between hosts.

Hosts whose pages the rules allow are trusted seeds, hosts whose pages they block distrusted ones. Trust walks along the
links and distrust against them, as two personalised PageRanks that one loop of joins computes; a host is blocked when its
share of all distrust is above its share of all trust. Column functions and joins only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.operators.lineage import materialise
from clausework.operators.skew import skew_join

# (verdict, host, path): a rule holds for its host and all hosts below it, and for paths that begin with its own.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

DAMPING = 0.85
# the loop ends when a round moves less than this much of all trust and of all distrust; it shrinks by DAMPING a round
TOLERANCE = 1e-6
# a host is blocked when its distrust is above its trust by more than this
MARGIN = 1e-9
# links of one host that a task should take
LINKS_PER_TASK = 100_000

# The letters whose case a host's name ignores.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# the host in a link with a scheme, or with the page's own
_LINK = "(?i)(?:^|\\s)href\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s]+)"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as ``(rule, verdict)``; of equally long ones that of the longer host, then the block."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1] + r[2]))
    fits = [
        (((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in ranked
    ]
    return F.coalesce(*[F.when(c, r) for c, r in fits], F.lit(None).cast("struct<rule:string,verdict:string>"))


def linked_hosts(html: Column) -> Column:
    """The hosts that a page's anchors name, each once. Tags are cut out first, so broken markup is read once as well."""
    tags = F.transform(F.split(html, "(?i)<a(?=\\s)"), lambda t: F.substring_index(t, ">", 1))
    hosts = F.transform(F.slice(tags, 2, F.greatest(F.size(tags) - 1, F.lit(0))), lambda t: F.regexp_extract(t, _LINK, 1))
    return F.array_distinct(F.filter(F.transform(hosts, lambda h: F.translate(h, UPPER, LOWER)), lambda h: h != ""))


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: pages of a host that link to another host."""
    links = pages.select(url_host(F.col("url")).alias("src"), F.explode(linked_hosts(F.col("html"))).alias("dst"))
    return links.where("src != '' AND src != dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagated(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``kind, host, score``: personalised PageRank of every host that a seed reaches; scores of a kind add up to 1.

    ``links`` is ``src, dst, weight``; ``seeds`` is ``kind, host, weight`` where ``kind`` is ``trust`` or ``distrust``.
    Trust goes along the links, distrust against them. What hosts without a way on hold goes back to the seeds, which only
    scales all scores and so is done once at the end. A host with very many links is split over several tasks. The loop
    ends by itself: a round moves at most ``damping`` times what the round before moved.
    """
    forward = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight")
    against = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "weight")
    edges = forward.unionByName(against)
    degree = edges.groupBy("kind", "host").agg(F.sum("weight").alias("out"), F.count("*").alias("n"))
    degree = materialise(degree.withColumn("parts", F.ceil(F.col("n") / LINKS_PER_TASK)).drop("n"), "degrees")
    shares = skew_join(materialise(edges, "edges"), degree, ["kind", "host"], salt_by=["to"], rows_per_task=LINKS_PER_TASK)
    # a host's links are dealt over as many parts as they fill tasks; its rank is copied to each
    shares = shares.select(
        "kind", "host", "to", (F.col("weight") / F.col("out")).alias("share"), F.pmod(F.xxhash64("to"), "parts").alias("part")
    )
    shares = materialise(shares, "shares")
    mass = seeds.groupBy("kind").agg(F.sum("weight").alias("mass"))  # two rows
    start = seeds.join(F.broadcast(mass), "kind").select("kind", "host", ((1 - damping) * F.col("weight") / F.col("mass")).alias("seed"))
    start = materialise(start, "seeds")
    ranks = start.select("kind", "host", F.col("seed").alias("score"))
    moves = not shares.isEmpty()
    while moves:
        sent = ranks.join(degree, ["kind", "host"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        got = shares.join(sent.select("kind", "host", "part", "score"), ["kind", "host", "part"])
        got = got.select("kind", F.col("to").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"), F.lit(0.0).alias("old"))
        base = start.select("kind", "host", F.col("seed").alias("score"), F.lit(0.0).alias("old"))
        old = ranks.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("old"))
        every = reduce(DataFrame.unionByName, [got, base, old]).groupBy("kind", "host")
        ranks = materialise(every.agg(F.sum("score").alias("score"), F.sum("old").alias("old")), "ranks")
        by_kind = ranks.groupBy("kind").agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("moved"), F.sum("score").alias("all"))
        moves = not by_kind.where(F.col("moved") > tolerance * F.col("all")).isEmpty()
        ranks = ranks.drop("old")
    total = ranks.groupBy("kind").agg(F.sum("score").alias("total"))  # two rows
    return ranks.join(F.broadcast(total), "kind").select("kind", "host", (F.col("score") / F.col("total")).alias("score"))


def judged(pages: DataFrame, rules=RULES, margin: float = MARGIN) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    A page that a rule fits gets the longest rule's verdict. Any other page gets its host's: ``block`` if the host's
    share of all distrust is above its share of all trust by more than ``margin``, else ``allow``. The seeds are the hosts
    of the pages that rules decide, weighted by those pages. A null url or one without ``://`` has an empty host and path,
    fits no rule and is allowed. Null and repeated ids and repeated rows are rows like any other; null or broken markup
    gives the links that can be read from it. Without pages that rules block, nothing is blocked.
    """
    url = F.col("url")
    named = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    facts = named.withColumn("fit", _fitting(F.col("host"), F.col("path"), rules))
    facts = materialise(facts.select("page_id", "host", "path", "fit.rule", "fit.verdict"), "urls")
    kind = F.when(F.col("verdict") == "allow", "trust").otherwise("distrust")
    seeds = facts.where("verdict IS NOT NULL").groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("weight"))
    scores = propagated(host_links(pages.select("url", "html")), seeds)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0))
    blocked = scores.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))
    blocked = blocked.where(F.col("distrust") > F.col("trust") + margin).select("host", F.lit("block").alias("of_host"))
    found = skew_join(facts, materialise(blocked, "blocked"), ["host"], "left", salt_by=["page_id", "path"])
    return found.select(
        F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", F.coalesce("verdict", "of_host", F.lit("allow")).alias("verdict")
    )
