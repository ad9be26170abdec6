"""Main text of HTML pages by two passes over their blocks.

The first pass labels a block from its own words: blocks in containers named for page furniture and blocks of links are
boilerplate, long blocks with many function words are text, and short ones are left open. The second pass gives an open
block the label of its nearest decided neighbours. Both run on every page. An article is a feature of them: inside it a
long block with few function words is left open and the article's edges count as text, outside it a block must be twice
as long to be text by its own words.

A container's name and tag are features too, not a verdict: one that may as well hold the page (a form, a search page, a
layout named for its header) is cleared when it holds an article or most of the words and no article stands elsewhere, and
a navigation element is cleared when nothing else on the page is text. Names of adverts, comments and the like always hold.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody"
    " td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
# by how sure they are: page furniture whatever it holds, unless nothing else is text, unless it holds the page
SURE_TAGS = frozenset("head select button".split())
LIKELY_TAGS = frozenset("nav footer aside menu".split())
MAYBE_TAGS = frozenset("header form fieldset dialog".split())
# tags that end where an article begins, as they never hold one
NO_ARTICLE_TAGS = frozenset("nav menu select button".split())
ARTICLE_TAGS = frozenset(["article", "main"])
# tags that end an open paragraph when they begin
CLOSES_P = BLOCK_TAGS - {"body", "html", "td", "th", "tr", "option", "caption"}

def _names(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.IGNORECASE)


# words in a class, id or role that name page furniture, by how sure they are
SURE = _names(
    r"ads?|advert\w*|sponsor\w*|related|recommend\w*|share|sharing|social|cookies?|consent|newsletter|subscri\w*|comments?|"
    r"comment-?\w*|repl(?:y|ies)|disqus|discussion|pagination|pager"
)
LIKELY = _names(
    r"nav\w*|menu\w*|breadcrumbs?|footer|side-?bar|aside|notices?|alert|popup|signup|sign-?in|login|toolbar|skip|"
    r"complementary|contentinfo|navigation"
)
MAYBE = _names(r"promo\w*|banner|header|masthead|widget\w*|modal|overlay|search\w*|copyright|legal|disclaimer")
# the head of an article belongs to it
HEAD = _names("header|masthead")

# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their them"
    " there they this to was we were which will with would you"
    " au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que"
    " qui sa se ses son sur un une vous"
    " aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach"
    " nicht noch nur oder sich sie sind so über um und uns von vor war wie wird zu zum zur"
    " al como con del el ella ellos es esta este ha hay la las le lo los más me mi muy no nos o para pero por que se ser si sin"
    " sobre su sus te todo un una y ya".split()
)

# names of an <article> or <main> that is not the page's text: furniture, and excerpts of other pages
EXCERPT = _names(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|footer|side-?bar|aside|widget\w*|related|"
    r"recommend\w*|share|sharing|social|cookies?|consent|popup|modal|overlay|newsletter|subscri\w*|comments?|comment-?\w*|"
    r"repl(?:y|ies)|disqus|discussion|pagination|pager|toolbar|complementary|contentinfo|navigation|"
    r"teasers?|cards?|tiles?|previews?|excerpts?|snippets?"
)
# names that tell a page's state or subject, not what an element is: has-sidebar, comments-open, tag-social
STATE = re.compile(r"(?<!\S)(?:(?:has|no|with|without|category|tag)[_-]\S+|\S+[_-](?:open|closed))(?!\S)", re.IGNORECASE)

MIN_WORDS, STOP_SHARE, LINK_SHARE = 12, 0.25, 0.4
# words of a text block outside the article of a page that has one
OUTSIDE_WORDS = 2 * MIN_WORDS

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# what ends a tag, or begins a value that may hold such a sign
_IN_TAG = re.compile(r">|=\s*([\"'])")
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
# a run of letters and digits; characters of scripts without spaces stand for words of their own
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]|[^\W\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+")


_SURE, _LIKELY, _MAYBE = 3, 2, 1
# containers that may hold the page, one in the other, that are told apart; deeper ones go with the last of them
NESTED = 8


class _Element:
    """An open element: its doubt (how sure it is furniture, 0: not), and what it inherits."""

    __slots__ = ("tag", "parent", "doubt", "doubts", "is_article", "articles", "link")

    def __init__(self, tag: str, parent: _Element | None, doubt: int, is_article: bool):
        self.tag, self.parent, self.doubt, self.is_article = tag, parent, doubt, is_article
        self.doubts: tuple[_Element, ...] = () if parent is None else parent.doubts
        self.articles: tuple[tuple[_Element, ...], ...] = () if parent is None else parent.articles
        # an element in a surer one stands and falls with it, so chains stay short
        surest = max((d.doubt for d in self.doubts), default=0)
        if doubt and (doubt > surest or doubt == surest == _MAYBE and len(self.doubts) < NESTED):
            self.doubts = (*self.doubts, self)
        if is_article:
            self.articles = (self.doubts,) if not self.articles else self.articles
        self.link = parent is not None and parent.link or tag == "a"


def _doubt(tag: str, attributes: str, in_article: bool) -> tuple[int, bool]:
    """How sure an element is page furniture, and whether it is an article."""
    article = tag in ARTICLE_TAGS
    names = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)) if attributes and tag not in ("html", "body") else ""
    names = STATE.sub(" ", names) if names else names
    if article:
        excerpt = bool(names and EXCERPT.search(names))
        return (_SURE if excerpt else 0), not excerpt
    if in_article and names:
        names = HEAD.sub(" ", names)
    if tag in SURE_TAGS or names and SURE.search(names) or attributes and tag not in ("html", "body") and _HIDDEN.search(attributes):
        return _SURE, False
    if tag in LIKELY_TAGS or names and LIKELY.search(names):
        return _LIKELY, False
    if tag in MAYBE_TAGS and not (tag == "header" and in_article) or names and MAYBE.search(names):
        return _MAYBE, False
    return 0, False


def _tag_end(page: str, at: int) -> int:
    """Where a tag's closing sign is, outside quoted values; -1 if the page ends before."""
    while found := _IN_TAG.search(page, at):
        if not found[1]:
            return found.start()
        close = page.find(found[1], found.end())
        if close < 0:
            return -1
        at = close + 1
    return -1


def blocks(page: str) -> list[tuple[str, int, _Element]]:
    """``(text, characters in links, element)`` of every block that has text, in page order.

    The page is read once: a tag that a quote leaves open to the end of the page makes all later tags end at the first
    closing sign, and without one the rest of the page is text.
    """
    found: list[tuple[str, int, _Element]] = []
    root = _Element("", None, 0, False)
    stack = [root]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    in_links = 0
    home = root

    def close() -> None:
        nonlocal in_links
        text = " ".join("".join(parts).split())
        if text:
            found.append((text, in_links, home))
        parts.clear()
        in_links = 0

    def add(raw: str) -> None:
        nonlocal in_links, home
        top = stack[-1]
        if not parts or (home.doubts, home.articles) != (top.doubts, top.articles):
            if parts:
                close()
            home = top
        text = html.unescape(raw)
        parts.append(text)
        if top.link:
            in_links += len(text.strip())

    def pop_from(depth: int) -> None:
        for element in stack[depth:]:
            open_tags[element.tag] -= 1
        del stack[depth:]

    def pop_last(tag: str) -> None:
        if open_tags[tag] > 0:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_from(depth)
                    return

    at, quoted = 0, True
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        named = _TAG.match(page, start)
        if not named and page[start + 1 : start + 2] not in ("!", "?"):
            add("<")
            at = start + 1
            continue
        end = _tag_end(page, named.end()) if named and quoted else page.find(">", start)
        if end < 0 and named and quoted:
            quoted = False
            end = page.find(">", named.end())
        if end < 0:
            add(page[start:])
            break
        at = end + 1
        if not named:
            continue
        tag = named[2].lower()
        if named[1]:
            if tag in BLOCK_TAGS:
                close()
            elif tag == "br":
                add(" ")
            pop_last(tag)
            continue
        attributes = page[named.end() : end]
        if tag in RAW_TAGS:
            if not (tag in ("svg", "math") and attributes.endswith("/")):
                last = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                at = page.find(">", last.end()) + 1 if last else 0
                at = at or len(page)
            continue
        if tag in BLOCK_TAGS:
            close()
            if tag in CLOSES_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        pop_from(depth)
                        break
                    if stack[depth].tag in BLOCK_TAGS:
                        break
        elif tag == "br":
            add(" ")
        if tag not in VOID_TAGS:  # a slash before the end of a tag means nothing in HTML
            doubt, article = _doubt(tag, attributes, bool(stack[-1].articles))
            if article:
                for other in NO_ARTICLE_TAGS:
                    pop_last(other)
            stack.append(_Element(tag, stack[-1], doubt, article))
            open_tags[tag] += 1
    close()
    return found


def _decided(text: str, in_links: int, furniture: bool, article: bool, marked: bool, listed: bool) -> bool | None:
    """The first pass: text, boilerplate, or open.

    ``marked``: the page has an article; ``listed``: it is in a language whose function words are known.
    """
    if furniture or in_links > LINK_SHARE * len(text):
        return False
    words = _WORD.findall(text.lower())
    if len(words) < MIN_WORDS:
        return None
    if listed and sum(w in STOP_WORDS for w in words) < STOP_SHARE * len(words):
        return None if article else False
    return None if marked and not article and len(words) < OUTSIDE_WORDS else True


def _features(found: list[tuple[str, int, _Element]], cleared: set[_Element]) -> list[tuple[str, int, bool, bool]]:
    """``(text, characters in links, furniture, in article)`` of every block, given the elements cleared of doubt."""
    out = []
    for text, in_links, home in found:
        furniture = any(d not in cleared for d in home.doubts)
        # an article that is furniture, such as a comment or a teaser, marks no text
        article = any(all(d in cleared for d in doubts) for doubts in home.articles)
        out.append((text, in_links, furniture, article))
    return out


def _cleared(found: list[tuple[str, int, _Element]]) -> set[_Element]:
    """Elements in doubt that hold the page: an article, or more than half of its words, when no article is elsewhere."""
    if any(home.articles and not home.articles[0] and not home.doubts for _, _, home in found):
        return set()
    words: Counter[_Element] = Counter()
    holds_article = set()
    total = 0
    for text, in_links, home in found:
        if in_links > LINK_SHARE * len(text):
            continue
        n = len(text.split())
        total += n
        for d in home.doubts:
            words[d] += n
        if home.articles and all(d.doubt == _MAYBE for d in home.articles[0]):
            holds_article.update(home.articles[0])
    return {d for d in words if d.doubt == _MAYBE and (2 * words[d] > total or d in holds_article)}


def _labels(features: list[tuple[str, int, bool, bool]], listed: bool = True) -> tuple[list[bool | None], list[bool]]:
    """Labels of the first pass and of both."""
    marked = any(article and not furniture for _, _, furniture, article in features)
    first = [_decided(*block, marked, listed) for block in features]
    labels = list(map(bool, first))
    runs: list[list[int]] = []
    for i, (_, _, furniture, article) in enumerate(features):
        if article and furniture:
            continue  # cut out of the article, no neighbour of its text
        if not runs or features[runs[-1][-1]][3] != article:
            runs.append([])
        runs[-1].append(i)
    for run in runs:
        for i, label in zip(run, _inherited([first[i] for i in run], features[run[0]][3])):
            labels[i] = label
    return first, labels


def labelled(page: str | None) -> list[tuple[str, bool | None, bool]]:
    """``(text, label of the first pass, label)`` of every block.

    A page without any text is read again: long blocks then need no function words, as its language may have no list, and
    if that gives nothing, the likely furniture with most of the words is cleared with what is in it.
    """
    found = blocks(page or "")
    cleared = _cleared(found)
    features = _features(found, cleared)
    first, labels = _labels(features)
    if not any(labels):
        first, labels = _labels(features, listed=False)
    if not any(labels):
        words: Counter[_Element] = Counter()
        for text, in_links, home in found:
            open_ = [d for d in home.doubts if d not in cleared]
            if open_ and in_links <= LINK_SHARE * len(text) and all(d.doubt < _SURE for d in open_):
                words[open_[0]] += len(text.split())
        if words:
            most = max(words.values())
            held = next(d for d in words if words[d] == most)
            cleared = cleared | {d for _, _, home in found if held in home.doubts for d in home.doubts if d.doubt < _SURE}
            features = _features(found, cleared)
            for listed in (True, False):
                first, labels = _labels(features, listed)
                if any(labels):
                    break
    return [(block[0], one, label) for block, one, label in zip(features, first, labels)]


def main_text(page: str | None) -> str:
    """The page's main text: blocks labelled text, joined by one space; empty without any."""
    return " ".join(text for text, _, label in labelled(page) if label)


def _inherited(first: list[bool | None], article: bool) -> list[bool]:
    """The second pass: open blocks take the label of the nearest decided block; between two labels, the nearer one.

    An article's edge counts as a text block beside it; any other edge as boilerplate, further off than any block. On a
    tie, text wins.
    """
    edge = (0 if article else len(first), article)
    before: list[tuple[int, bool]] = []
    last = edge
    for label in first:
        last = (last[0] + 1, last[1]) if label is None else (0, label)
        before.append(last)
    after: list[tuple[int, bool]] = []
    last = edge
    for label in reversed(first):
        last = (last[0] + 1, last[1]) if label is None else (0, label)
        after.append(last)
    after.reverse()
    labels = []
    for (back, left), (ahead, right) in zip(before, after):
        labels.append(left if left == right else (left if back < ahead else right if ahead < back else left or right))
    return labels


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row, from the whole page; a null page has an empty text.

    Null ids and repeated rows are rows like any other. Pages are read once, however long or broken their markup is. A
    page in a language without a list of function words goes by the length and the links of its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in pc.fill_null(batch.column("html"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
