"""One pass over a page's HTML: links, declared language, paragraphs, visible text.

HTML cannot be taken apart by a regular expression: paragraphs nest when they are not
closed, and scripts may hold closing tags. This helper keeps a stack of open elements
over the standard tokenizer; it runs inside Arrow batches of a Spark job.
"""

from __future__ import annotations

from html.parser import HTMLParser

# Elements that never have content.
VOID_ELEMENTS = frozenset(
    (
        "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta",
        "param", "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex",
        "nextid", "spacer",
    )
)
# Elements whose text is not page text.
HIDDEN_ELEMENTS = frozenset(("script", "style", "template", "rt", "rp"))
# Elements that keep blank text as it is.
PREFORMATTED_ELEMENTS = frozenset(("pre", "textarea"))
_BLANKS = " \n\t\f\r"
_NOTED = frozenset(("a", "meta"))


class Page(HTMLParser):
    """Facts of one page. Read them after ``Page(html)``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.links: list[tuple[str, str | None]] = []
        self.ok = True
        self._html_lang: str | None = None
        self._seen_html = False
        self._meta_lang: str | None = None
        self._seen_meta = False
        self._texts: list[str] = []
        self._buffer: list[str] = []
        self._stack: list[tuple[str, int]] = []
        self._open: dict[str, int] = {}
        self._hidden = 0
        self._preformatted = 0
        self._spans: list[list[int]] = []
        try:
            self.feed(html)
            self.close()
        except AssertionError:  # the tokenizer's answer to a malformed declaration
            self.ok = False
        self._flush()
        for span in self._spans:
            if span[1] < 0:
                span[1] = len(self._texts)

    @property
    def declared_language(self) -> str | None:
        """``lang`` of the first html element even when empty, else the content-language meta tag."""
        return self._html_lang if self._html_lang is not None else self._meta_lang

    def text(self, separator: str = "") -> str:
        return separator.join(self._texts)

    def paragraphs(self):
        """Stripped, non-empty text of every ``p`` in order of its start tag."""
        for start, end in self._spans:
            text = "".join(self._texts[start:end]).strip()
            if text:
                yield text

    def _flush(self) -> None:
        if not self._buffer:
            return
        data = "".join(self._buffer)
        self._buffer.clear()
        if self._hidden:
            return
        if data[0] in _BLANKS and not self._preformatted and not data.strip(_BLANKS):
            data = "\n" if "\n" in data else " "
        self._texts.append(data)

    def _note(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {name: "" if value is None else value for name, value in attrs}
        if tag == "a":
            if "href" in values:
                self.links.append((values["href"], values.get("onclick")))
        elif tag == "html":
            if not self._seen_html:
                self._seen_html = True
                self._html_lang = values.get("lang")
        elif not self._seen_meta and values.get("http-equiv") == "Content-Language":
            self._seen_meta = True
            self._meta_lang = values.get("content")

    def _count(self, tag: str, step: int) -> None:
        self._open[tag] = self._open.get(tag, 0) + step
        if tag in HIDDEN_ELEMENTS:
            self._hidden += step
        elif tag in PREFORMATTED_ELEMENTS:
            self._preformatted += step

    def handle_starttag(self, tag, attrs):
        self._flush()
        if attrs and tag in _NOTED or tag == "html":
            self._note(tag, attrs)
        if tag in VOID_ELEMENTS:
            return
        slot = -1
        if tag == "p":
            slot = len(self._spans)
            self._spans.append([len(self._texts), -1])
        self._stack.append((tag, slot))
        self._count(tag, 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        # an end tag closes everything opened since its start tag; without one it means nothing
        while self._open.get(tag):
            name, slot = self._stack.pop()
            self._count(name, -1)
            if slot >= 0:
                self._spans[slot][1] = len(self._texts)
            if name == tag:
                return

    def updatepos(self, i, j):
        return j  # line numbers are not used

    def handle_data(self, data):
        self._buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self._buffer.append(data[len("CDATA[") :])
            self._flush()
