"""URL and link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausework.functions.expr import once
from clausework.functions.text import WS_CHARS

# A link is a policy link when a pattern of the first list is found in it
# and none of the second. Case-sensitive, found anywhere in the link.
POSITIVE_PATTERNS = (
    "terms",
    "return",
    "refund",
    "terms.*?conditions",
    "terms.*?of.*?use",
    "terms.*?of.*?service",
    "terms.*?of.*?sale",
    "terms.*?of.*?conditions",
    "terms.*?and.*?conditions",
    "terms.*?&.*?conditions",
    "conditions.*?of.*?use",
    "intellectual.*property.*policy",
    "return[s]?.*?policy",
    "refund[s]?.*?policy",
    "return.*?and.*?refund.*?policy",
    "cancellation.*?and.*?returns",
    "cancellation.*?returns",
    "prohibited.*conduct",
    "electronic.*communication.*policy",
    "dmca.*copyright.*notification",
    "safety.*guideline",
    "requests.*from.*law.*enforcement",
    "bonus.*terms.*apply",
    "community.*rules",
    "gift.*card.*policy",
    "contact.*us.*here",
    "shipping.*policy",
    "delivery.*shipping",
    "warranty",
    "end.*user.*license",
    "user.*?agreement",
    "payment.*terms",
    "content.*policy",
)
NEGATIVE_PATTERNS = (
    "privacy.*?policy",
    "cookie.*?policy",
    "privacy.*?notice",
    "sale.*?tax.*?policy",
    "prohibited.*?items",
    "1099.*?k.*?form",
    "privacy",
)

# An href holding this text points to its onclick attribute instead.
VOID_HREF = "javascript:void(0);"

SLUG_LENGTH = 255

# letters and digits of any script; a host has at least two names, the last of which begins with a letter
_NAME = r"[\p{L}\p{N}_](?:[\p{L}\p{M}\p{N}_-]{0,61}[\p{L}\p{M}\p{N}_])?"
_HOST = rf"(?:{_NAME}\.)+\p{{L}}[\p{{L}}\p{{M}}\p{{N}}-]{{0,61}}[\p{{L}}\p{{M}}\p{{N}}]\.?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H16 = "[0-9A-Fa-f]{1,4}"
_END32 = rf"(?:{_H16}:{_H16}|{_IPV4})"


def _ipv6() -> str:
    """Eight groups, the last two also as an IPv4 address, where one run of groups may be left out."""
    ways = [rf"(?:{_H16}:){{6}}{_END32}"]
    for after in range(5, -1, -1):  # groups between the gap and the last two
        before = rf"(?:(?:{_H16}:){{0,{4 - after}}}{_H16})?" if after < 5 else ""
        ways.append(rf"{before}::(?:{_H16}:){{{after}}}{_END32}")
    ways += [rf"(?:(?:{_H16}:){{0,5}}{_H16})?::{_H16}", rf"(?:(?:{_H16}:){{0,6}}{_H16})?::"]
    return "|".join(ways)


_USER = rf"(?:[^{WS_CHARS}/?#@\[\]]+@)?"
VALID_URL = (
    rf"^https?://{_USER}(?:{_HOST}|{_IPV4}|\[(?:{_ipv6()})\]|localhost)(?::\d{{1,5}})?(?:[/?#][^{WS_CHARS}]*)?\z"
)


def _any_of(patterns: tuple[str, ...]) -> str:
    # (?d): "." stops at \n only
    return "(?d)" + "|".join(patterns)


def strip_scheme(url: Column) -> Column:
    """Remove ``https://`` and ``http://`` wherever they occur."""
    return F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))


def with_scheme(url: Column) -> Column:
    """Prefix ``https://`` unless a scheme occurs in the text."""
    has_scheme = url.contains("https://") | url.contains("http://")
    return F.when(has_scheme, url).otherwise(F.concat(F.lit("https://"), url))


def link_match(link: Column, seed: Column) -> Column:
    """Policy link test on what is left of ``link`` once every ``seed`` text is cut out."""
    rest = F.when(seed == "", link).otherwise(F.replace(link, seed, F.lit("")))
    return once(rest, lambda r: ~r.rlike(_any_of(NEGATIVE_PATTERNS)) & r.rlike(_any_of(POSITIVE_PATTERNS)))


def text_match(text: Column) -> Column:
    """True when the lower-cased text holds a policy pattern."""
    return F.lower(text).rlike(_any_of(POSITIVE_PATTERNS))


def valid_url(link: Column) -> Column:
    """True for an absolute http(s) URL with a dotted host in any script, an IP address or localhost."""
    return F.coalesce(link.rlike(VALID_URL), F.lit(False))


def onclick_link(script: Column) -> Column:
    """First http(s) URL inside an onclick script, null when there is none."""
    return F.nullif(F.regexp_extract(script, f"(https?://[^{WS_CHARS}'\"]+)", 1), F.lit(""))


def target_of(href: Column, onclick: Column, seed: Column) -> Column:
    """Text of a hyperlink's target, valid or not.

    A leading ``/`` is resolved against the seed, whichever page holds the link.
    """
    return (
        F.when(href.contains(VOID_HREF), onclick_link(onclick))
        .when(href.startswith("/"), F.concat(with_scheme(seed), href))
        .otherwise(href)
    )


def resolve_link(href: Column, onclick: Column, seed: Column) -> Column:
    """Absolute form of a hyperlink, null when it gives no valid URL."""
    return once(target_of(href, onclick, seed), lambda link: F.when(valid_url(link), link))


def policy_links(links: Column, seed: Column) -> Column:
    """Array of the distinct policy links in an array of ``href, onclick``.

    Everything happens inside the array, so a link is resolved once and only matches are exploded.
    """
    targets = F.transform(links, lambda link: target_of(link["href"], link["onclick"], seed))
    return F.array_distinct(F.filter(targets, lambda link: valid_url(link) & link_match(link, seed)))


def page_slug(link: Column) -> Column:
    """File name of a page: no scheme, ``/`` as ``_``, first 255 characters."""
    return F.substring(F.translate(strip_scheme(link), "/", "_"), 1, SLUG_LENGTH)


def file_range(name: Column) -> tuple[Column, Column]:
    """Start and end numbers of a chunk file name such as ``sites_100_200.json``."""
    pattern = r"_(\d+)_(\d+)\.[^./]*$"
    return (
        F.regexp_extract(name, pattern, 1).try_cast("int"),
        F.regexp_extract(name, pattern, 2).try_cast("int"),
    )
