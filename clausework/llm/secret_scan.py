"""Secret scan: strong patterns on their own, weak candidates only beside their complements. Column functions only.

Every pattern is marked in place, and the lengths between the marks give each match its offsets, so a text is read
once per pattern and only the pieces of texts with matches are dealt out. Identifiers, secrets and endpoints of one
text are then linked by an interval join over bins as wide as the reach: the evidence of a bin is first reduced to its
smallest and largest offset per role, which decides nearness exactly, so no pairs of parts are ever listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from clausework.llm.common import row_key
from clausework.operators.lineage import materialise

# The patterns of the three strong kinds; the last group of an assignment is its value.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ASSIGN_VALUE = 8

# Weak kinds: an account or key name that is set, a long mixed run, an address with a scheme.
IDENT = "(?i:user(?:name)?|login|client_?id|account_?id|access_?key(?:_?id)?)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9@._-]{3,}"
KEY = "[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = "(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\\x20\\x09-\\x0D\"'<>]+"

KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "key": KEY, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")
# kinds that show an identifier or a secret, and what a weak kind needs beside it
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "ident", "ident": "ident"}
REACH = 256

_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"


def _marked(text: Column, pattern: str) -> Column:
    """The text cut before every match; each piece after the first is a match, a closing mark and what follows."""
    return F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)


def _matches(docs: DataFrame) -> DataFrame:
    """``k1, k2, kind, start, end`` of every match that passes its kind's own test; offsets are code points."""
    text = F.coalesce("text", F.lit(""))
    # the marks must not stand in a text; what takes their place matches nothing either
    plain = F.when(text.rlike("[\\x01\\x02]"), F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)).otherwise(text)
    keyed = docs.select(*row_key("doc_id", "text"), plain.alias("plain"))
    cut = [F.struct(F.lit(kind).alias("kind"), _marked(F.col("plain"), p).alias("pieces")) for kind, p in KINDS.items()]
    # outer, as the planner would otherwise search the texts once more to see which rows have anything to explode
    by_kind = keyed.select("k1", "k2", F.explode_outer(F.filter(F.array(*cut), lambda c: F.size(c["pieces"]) > 1)).alias("c"))
    by_kind = by_kind.where("c IS NOT NULL")
    pieces = by_kind.select("k1", "k2", "c.kind", F.posexplode("c.pieces").alias("i", "piece"))
    match = F.when(F.col("i") > 0, F.substring_index("piece", _CLOSE, 1)).otherwise("")
    rest = F.length("piece") - F.length("match") - F.when(F.col("i") > 0, 1).otherwise(0)
    sound = (
        F.when(F.col("kind") == "assign", F.length(F.regexp_extract("match", ASSIGN, 1)) >= ASSIGN_VALUE)
        .when(F.col("kind") == "key", F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Z]") & F.col("match").rlike("[a-z]"))
        .otherwise(F.lit(True))
    )
    sized = pieces.withColumn("match", match).select(
        "k1", "k2", "kind", "i", F.length("match").alias("size"), rest.alias("rest"), (sound & (F.col("i") > 0)).alias("sound")
    )
    # equal rows give equal pieces: one of each stays
    once = sized.repartition("k1", "k2").dropDuplicates(["k1", "k2", "kind", "i"])
    before = W.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    placed = once.withColumn("start", F.coalesce(F.sum(F.col("size") + F.col("rest")).over(before), F.lit(0)))
    return placed.where("sound").select("k1", "k2", "kind", "start", (F.col("start") + F.col("size")).alias("end"))


def _outside_base(matches: DataFrame) -> DataFrame:
    """All matches but the weak ones that overlap a strong one, which already reports that text."""
    strong = F.col("kind").isin(*BASE)
    by_start = W.partitionBy("k1", "k2").orderBy("start")
    covered = F.max(F.when(strong, F.col("end"))).over(by_start.rangeBetween(W.unboundedPreceding, W.currentRow))
    follows = F.min(F.when(strong, F.col("start"))).over(by_start.rangeBetween(W.currentRow, W.unboundedFollowing))
    seen = matches.withColumn("covered", covered).withColumn("follows", follows)
    overlaps = F.coalesce(F.col("covered") > F.col("start"), F.lit(False)) | F.coalesce(F.col("follows") < F.col("end"), F.lit(False))
    return seen.where(strong | ~overlaps).drop("covered", "follows")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """Weak parts that have their complements within ``reach`` code points between starts.

    An identifier needs a secret, a bare secret an identifier, an endpoint both.
    """
    place = F.floor(F.col("start") / reach)
    roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    evidence = (
        parts.withColumn("role", roles[F.col("kind")])
        .where(F.col("role").isNotNull())
        .groupBy("k1", "k2", "role", place.alias("bin"))
        .agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    )
    around = evidence.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    weak = parts.where(~F.col("kind").isin(*BASE)).withColumn("bin", place)
    near = weak.join(around, ["k1", "k2", "bin"]).where(
        (F.col("lo") <= F.col("start") + reach) & (F.col("hi") >= F.col("start") - reach)
    )
    found = near.groupBy("k1", "k2", "kind", "start", "end").agg(F.collect_set("role").alias("roles"))
    ident, secret = F.array_contains("roles", "ident"), F.array_contains("roles", "secret")
    complete = F.when(F.col("kind") == "ident", secret).when(F.col("kind") == "key", ident).otherwise(ident & secret)
    return found.where(complete).drop("roles")


def secret_spans(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``k1, k2, kind, start, end`` of all reported spans; ``k1, k2`` is ``row_key`` of ``doc_id, text``.

    Strong kinds: ``assign`` (a password, secret, token or key that is set to 8 or more characters), ``access``, ``hex``.
    Weak kinds: ``ident``, ``key``, ``endpoint``, outside strong spans and only with their complements near.
    A null text is empty; rows equal in id and text have one set of spans.
    """
    parts = materialise(_outside_base(_matches(docs)), "parts")
    return parts.where(F.col("kind").isin(*BASE)).unionByName(_linked(parts, reach))


def secret_report(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row; texts without spans count as zero."""
    spans = secret_spans(docs, reach)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    said = F.concat_ws(":", "kind", "start", "end")
    row = F.struct("start", order.alias("o"), said.alias("said"), F.col("kind").isin(*BASE).alias("base"))
    grouped = spans.groupBy("k1", "k2").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in BASE],
        F.array_sort(F.collect_list(row)).alias("all"),
    )
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key("doc_id", "text")).join(grouped, ["k1", "k2"], "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,o:bigint,said:string,base:boolean>>"))
    texts = lambda a: F.array_join(F.transform(a, lambda s: s["said"]), ",")
    return joined.withColumn("all", every).select(
        "doc_id",
        *[F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(texts(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"),
        texts(F.col("all")).alias("spans"),
    )
