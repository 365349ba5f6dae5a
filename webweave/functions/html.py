"""Page extraction: one Arrow UDF around the standard-library HTML parser."""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text directly inside these elements is not visible.
HIDDEN_PARENTS = frozenset(["style", "script", "head", "title", "meta", "[document]"])
# Elements of the HTML standard that never have content.
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("main", T.StringType()),
    T.StructField("hrefs", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])

SLICE_BYTES = 1_000_000

_HREF = re.compile("https?://")
_CHARSET = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.IGNORECASE)
_MARKS = {codecs.BOM_UTF8: "utf-8", codecs.BOM_UTF16_LE: "utf-16-le", codecs.BOM_UTF16_BE: "utf-16-be"}


class _PageReader(HTMLParser):
    """Collects title, visible text and link targets while walking a page once.

    Each tag costs the same however many are open: per name it is counted how often it is open, and
    regions (the first ``title`` and ``body``, that body's first ``header`` and ``footer``) by how
    many are open. A ``main`` is a stretch of the visible pieces.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, object]] = []
        self.depth: Counter[str] = Counter()
        self.inside: Counter[str] = Counter()
        self.buffer: list[str] = []
        self.title: list[str] | None = None
        self.pieces: list[tuple[str, bool]] = []  # visible text, and whether it counts for the body
        self.mains: list[list[int]] = []  # first piece and the one after the last
        self.has_body = False
        self.links: list[tuple[str, bool]] = []
        self.taken: set[str] = set()

    def _flush(self) -> None:
        if not self.buffer:
            return
        text = "".join(self.buffer)
        self.buffer.clear()
        if self.inside["title"]:
            self.title.append(text)
        parent = self.open[-1][0] if self.open else "[document]"
        if parent not in HIDDEN_PARENTS:
            self.pieces.append((text, self.inside["body"] > 0 and not self.inside["cut"]))

    def _mark(self, tag: str) -> str | int | None:
        if tag == "title" and self.title is None:
            self.title = []
            return "title"
        if tag == "main":
            self.mains.append([len(self.pieces), -1])
            return len(self.mains) - 1
        if tag == "body" and not self.has_body:
            self.has_body = True
            return "body"
        if tag in ("header", "footer") and tag not in self.taken and self.inside["body"]:
            # a footer inside the removed header is gone already; a header inside a footer is not
            if tag == "header" or not self.inside["header"]:
                self.taken.add(tag)
                return tag
        return None

    def _close(self) -> None:
        tag, mark = self.open.pop()
        self.depth[tag] -= 1
        if isinstance(mark, int):
            self.mains[mark][1] = len(self.pieces)
        elif mark:
            self.inside[mark] -= 1
            self.inside["cut"] -= mark in ("header", "footer")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._flush()
        mark = self._mark(tag)
        if tag == "a":
            href = dict(attrs).get("href")
            if href and _HREF.match(href):
                self.links.append((href, self.inside["cut"] > 0))
        if tag not in VOID_ELEMENTS:
            self.open.append((tag, mark))
            self.depth[tag] += 1
            if isinstance(mark, str):
                self.inside[mark] += 1
                self.inside["cut"] += mark in ("header", "footer")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_ELEMENTS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if not self.depth[tag]:
            return
        while self.open[-1][0] != tag:
            self._close()
        self._close()

    def finish(self) -> None:
        self.close()
        self._flush()
        while self.open:
            self._close()

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def handle_comment(self, data: str) -> None:
        self._flush()

    def handle_decl(self, decl: str) -> None:
        self._flush()

    def handle_pi(self, data: str) -> None:
        self._flush()


def _visible(pieces: list[str]) -> str:
    text = " ".join(piece.strip() for piece in pieces)
    return re.sub(" +", " ", re.sub(r"[\n\t\r]", " ", text)).strip()


def read_page(page: str) -> tuple[str | None, str | None, list[str]]:
    """Title, main text and http link targets of one page."""
    reader = _PageReader()
    reader.feed(page)
    reader.finish()
    title = None if reader.title is None else re.sub(r"\s+", " ", "".join(reader.title))
    if reader.mains:
        mains = (_visible([text for text, _ in reader.pieces[a:b]]) for a, b in reader.mains)
        return title, " ".join(mains), [href for href, _ in reader.links]
    main = _visible([text for text, counts in reader.pieces if counts]) if reader.has_body else None
    return title, main, [href for href, cut in reader.links if not cut]


def decode_page(page: bytes) -> str:
    """A page's text by its byte order mark, else the charset it declares, else UTF-8, else Windows-1252."""
    for mark, name in _MARKS.items():
        if page.startswith(mark):
            return page[len(mark):].decode(name)
    declared = _CHARSET.search(page[:4096])
    names = [declared[1].decode("ascii")] if declared else []
    for name in [*names, "utf-8"]:
        try:
            return page.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return page.decode("cp1252")


def _slices(pages: pa.Array, size: int = SLICE_BYTES) -> Iterator[list[bytes | None]]:
    """The pages of a batch, about so many bytes at a time."""
    some, held = [], 0
    for page in pages:
        some.append(page.as_py())
        held += len(some[-1] or b"")
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def _extracted(page: bytes | None) -> dict:
    if page is None:
        return {}
    try:
        return dict(zip(("title", "main", "hrefs"), read_page(decode_page(page))))
    except Exception as problem:  # a broken page becomes a row with its error text
        return {"error": str(problem)}


@F.arrow_udf(SCHEMA)
def extract_page(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Title, main text, link targets and error of each page, given as bytes; null pages stay null.

    A batch has up to 10,000 pages; of what is made of them only a slice is held at a time.
    """
    kind = pa.struct([("title", pa.string()), ("main", pa.string()), ("hrefs", pa.list_(pa.string())), ("error", pa.string())])
    for pages in batches:
        for some in _slices(pages):
            yield pa.array([_extracted(page) for page in some], kind)
