"""Page parsing as Spark jobs: Arrow batches in, rows out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clausework.functions import language
from clausework.functions.page_parser import Page
from clausework.schemas import LINKS

_BATCH_BYTES = 4 << 20
_BATCH_ROWS = 5_000

_FACTS = {
    "declared_language": T.StringType(),
    "links": LINKS,
    "paragraphs": T.ArrayType(T.StringType()),
    "text": T.StringType(),
    # text only where no language is declared: all that the language fallback needs
    "undeclared_text": T.StringType(),
}


def _facts(page: Page, wanted: tuple[str, ...]) -> dict:
    out = {}
    for name in wanted:
        if name == "declared_language":
            out[name] = page.declared_language
        elif name == "links":
            out[name] = [{"href": href, "onclick": onclick} for href, onclick in page.links]
        elif name == "paragraphs":
            out[name] = list(page.paragraphs())
        elif name == "text":
            out[name] = page.text(" ")
        else:
            out[name] = None if page.declared_language is not None else page.text()
    return out


class _Writer:
    """Collects rows and cuts a batch at a number of bytes or rows, so no batch grows with a page."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: dict, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= _BATCH_BYTES or len(self.rows) >= _BATCH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
            self.rows, self.size = [], 0


def _keys(pages: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [pages.schema[k] for k in keys]


def parse_pages(
    pages: DataFrame,
    keys: list[str],
    wanted: tuple[str, ...] = ("declared_language", "links"),
    html: str = "html",
) -> DataFrame:
    """Key columns plus the ``wanted`` facts of each page, from one parse; ``parse_ok`` is false for a broken page.

    Facts: ``declared_language``, ``links``, ``paragraphs``, ``text``, ``undeclared_text``. A null page gives no row.
    """
    schema = T.StructType(
        [*_keys(pages, keys), *(T.StructField(n, _FACTS[n]) for n in wanted), T.StructField("parse_ok", T.BooleanType())]
    )
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(arrow_schema)
        for batch in batches:
            for row in batch.to_pylist():
                source = row.pop(html)
                page = Page(source)
                yield from writer.add({**row, **_facts(page, wanted), "parse_ok": page.ok}, len(source))
        yield from writer.flush()

    return pages.select(*keys, html).where(F.col(html).isNotNull()).mapInArrow(run, schema)


def paragraph_rows(pages: DataFrame, keys: list[str], html: str = "html", distinct: bool = False) -> DataFrame:
    """One row ``(keys, pos, paragraph)`` per paragraph of a page, in page order.

    Rows stream out of the parse: nested unclosed paragraphs can make a page's output far larger than
    the page. With ``distinct`` a repeated text keeps its first place in the page, which
    needs no shuffle because a page is one row. A broken page gives no rows.
    """
    schema = T.StructType(
        [*_keys(pages, keys), T.StructField("pos", T.IntegerType()), T.StructField("paragraph", T.StringType())]
    )
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(arrow_schema)
        for batch in batches:
            for row in batch.to_pylist():
                page = Page(row.pop(html))
                if not page.ok:
                    continue
                seen = set()
                for pos, text in enumerate(page.paragraphs()):
                    if distinct:
                        digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                        if digest in seen:
                            continue
                        seen.add(digest)
                    yield from writer.add({**row, "pos": pos, "paragraph": text}, len(text))
        yield from writer.flush()

    return pages.select(*keys, html).where(F.col(html).isNotNull()).mapInArrow(run, schema)


def extract_links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row ``(keys, pos, href, onclick)`` per anchor with an href, repeats kept."""
    parsed = parse_pages(pages, keys, ("links",), html)
    return parsed.select(*keys, F.posexplode("links").alias("pos", "link")).select(*keys, "pos", "link.href", "link.onclick")


def visible_text(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """``(keys, text)``: page text with a space between the pieces; no script, style or comment text."""
    return parse_pages(pages, keys, ("text",), html).drop("parse_ok")


def page_language(pages: DataFrame, keys: list[str], html: str = "html", detector=language.detect_language) -> DataFrame:
    """``(keys, language)``: the declared language, also when empty; else the detector on the page text."""
    parsed = parse_pages(pages, keys, ("declared_language", "undeclared_text"), html)
    return parsed.select(*keys, language_of(detector).alias("language"))


def language_of(detector=language.detect_language) -> Column:
    """Language from the ``declared_language`` and ``undeclared_text`` columns of a parse."""
    return F.coalesce(F.col("declared_language"), detector(F.col("undeclared_text")))
