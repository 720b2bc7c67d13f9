"""HTML to columns: articles, blocks, links, data pages. Arrow batches, the standard library's parser.

Null and broken pages give null or empty fields; nothing raises.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: elements that hold no text of the page, blocks of text, and containers of the main text
NOISE = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "template", "svg"}
BLOCKS = {"p", "li", "h1", "h2", "h3", "h4", "td", "blockquote", "pre", "dd", "dt", "div", "section", "article", "main"}
CONTAINERS = ("main", "article", ".node--type-report", "#main-content")
NOISE_CLASSES = {"breadcrumb", "region-sidebar-first"}
# fixed values: types of linked data that describe an article
ARTICLES = {"NewsArticle", "Article", "BlogPosting"}
DATA_FILES = {"csv": "CSV", "xls": "Excel", "xlsx": "Excel", "json": "JSON", "geojson": "GeoJSON", "zip": "ZIP", "pdf": "PDF", "shp": "Shapefile", "xml": "XML"}


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


LINK = T.StructType([*_texts("url", "text", "kind").fields, T.StructField("same_host", T.BooleanType())])
BLOCK_LIST = T.StructType([T.StructField("title", T.StringType()), T.StructField("blocks", T.ArrayType(T.StringType()))])


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.meta, self.scripts, self.links = "", {}, [], []
        self.blocks: list[tuple[str | None, str, str]] = []  # (container, element, text)
        self.pairs: list[tuple[str, str]] = []
        self._open: list[str] = []
        self._text: list[str] = []
        self._roles: list[str] = []  # of each open element: a container's name, noise or nothing
        self._tag, self._link, self._key, self._json, self._in_title = "", None, None, False, False

    def _flush(self, tag: str) -> None:
        text = re.sub(r"\s+", " ", "".join(self._text)).strip()
        if text:
            holder = next((c for c in CONTAINERS if c in self._roles), None)
            self.blocks.append((holder, self._tag or tag, text))
            if self._tag in ("dt", "strong", "label"):
                self._key = text.rstrip(" :")
            elif self._key is not None:
                self.pairs.append((self._key, text))
                self._key = None
        self._text = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("property") or a.get("name")
            if name and a.get("content"):
                self.meta.setdefault(name.lower(), a["content"])
            return
        if tag == "a" and a.get("href"):
            self._link = [a["href"], ""]
        if tag == "script":
            self._json = a.get("type", "").lower() == "application/ld+json"
        if tag == "title":
            self._in_title = True
        if tag in BLOCKS or tag in ("strong", "label"):
            self._flush(tag)
            self._tag = tag
        if tag not in ("br", "img", "hr", "input", "link"):
            self._open.append(tag)
            classes = set(a.get("class", "").split())
            self._roles.append(
                "noise" if classes & NOISE_CLASSES else tag if tag in CONTAINERS else "#main-content" if a.get("id") == "main-content"
                else ".node--type-report" if "node--type-report" in classes else "")

    def handle_endtag(self, tag):
        if tag == "a" and self._link:
            self.links.append((self._link[0], re.sub(r"\s+", " ", self._link[1]).strip()))
            self._link = None
        if tag == "title":
            self._in_title = False
        if tag in BLOCKS or tag in ("strong", "label"):
            self._flush(tag)
            self._tag = ""
        if tag in self._open:
            while self._open and self._open.pop() != tag:
                self._roles.pop()
            self._roles.pop()

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        elif self._open and self._open[-1] == "script":
            if self._json:
                self.scripts.append(data)
        elif not NOISE.intersection(self._open) and "noise" not in self._roles:
            self._text.append(data)
            if self._link:
                self._link[1] += data


def read(page: str | None) -> _Reader:
    """A page read to title, meta tags, JSON-LD, blocks, links and pairs."""
    r = _Reader()
    if page:
        try:
            r.feed(page)
            r.close()
        except (ValueError, AssertionError):
            pass
        r._flush("")
    return r


def _linked_data(r: _Reader) -> dict:
    for s in r.scripts:
        try:
            x = json.loads(s)
        except ValueError:
            continue
        for y in x if isinstance(x, list) else [x]:
            if isinstance(y, dict) and y.get("@type") in ARTICLES:
                return y
    return {}


def _text(x) -> str | None:
    if isinstance(x, list):
        x = x[0] if x else None
    if isinstance(x, dict):
        x = x.get("name")
    return str(x) if x not in (None, "") else None


@F.pandas_udf(_texts("title", "author", "published", "modified", "description", "content"))
def article(pages: pd.Series) -> pd.DataFrame:
    """Fields of an article: linked data goes before Open Graph, that before meta tags; paragraphs over 20 characters."""
    out = []
    for p in pages:
        r = read(p)
        ld, m = _linked_data(r), r.meta
        inside = [t for c, tag, t in r.blocks if c and tag == "p" and len(t) > 20] or [t for _, tag, t in r.blocks if tag == "p" and len(t) > 20]
        out.append((
            _text(ld.get("headline") or ld.get("name")) or m.get("og:title") or r.title.strip() or None, _text(ld.get("author")) or m.get("article:author") or m.get("author"),
            _text(ld.get("datePublished")) or m.get("og:published_time") or m.get("article:published_time") or m.get("date"), _text(ld.get("dateModified")),
            _text(ld.get("description")) or m.get("og:description") or m.get("description"), "\n".join(inside) or None))
    return pd.DataFrame(out, columns=["title", "author", "published", "modified", "description", "content"])


@F.pandas_udf(BLOCK_LIST)
def blocks(pages: pd.Series) -> pd.DataFrame:
    """Title and the first ten blocks over 20 characters."""
    rows = [(r.title.strip() or None, [t for _, _, t in r.blocks if len(t) > 20][:10]) for r in map(read, pages)]
    return pd.DataFrame(rows, columns=["title", "blocks"])


@F.pandas_udf(T.StringType())
def report(pages: pd.Series) -> pd.Series:
    """Text of the first container that holds any; null without one and under 200 characters."""
    out = []
    for r in map(read, pages):
        parts = next((x for c in CONTAINERS if (x := [t for h, _, t in r.blocks if h == c])), [])
        text = " ".join(parts)
        out.append(text if len(text) >= 200 else None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(LINK))
def links(pages: pd.Series, urls: pd.Series) -> pd.Series:
    """Links of a page, absolute, without fragments, first of each url: pdf, document, data or page."""
    out = []
    for page, base in zip(pages, urls):
        seen, found = set(), []
        host = urlsplit(base or "").hostname
        for href, text in read(page).links:
            try:
                url = urljoin(base or "", href).split("#")[0]
                parts = urlsplit(url)
            except ValueError:
                continue
            if parts.scheme not in ("http", "https") or url in seen:
                continue
            seen.add(url)
            kind = parts.path.rpartition(".")[2].lower()
            kind = "pdf" if kind == "pdf" else "document" if kind in ("doc", "docx", "odt") else "data" if kind in DATA_FILES else "page"
            found.append({"url": url, "text": text, "kind": kind, "same_host": parts.hostname == host})
        out.append(found)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def pairs(pages: pd.Series) -> pd.Series:
    """Label and value pairs of a catalogue page."""
    return pd.Series([dict(read(p).pairs) for p in pages], dtype=object)


class _Form(HTMLParser):
    """Title and questions of a form: headings by role, options by class."""

    def __init__(self):
        super().__init__()
        self.title, self.questions = "", []
        self._open: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        name = a.get("class") or ""
        role = "title" if tag == "h1" or "HeaderTitle" in name else "question" if a.get("role") == "heading" else "option" if "Option" in name else ""
        if role == "question":
            self.questions.append(("", []))
        if role == "option" and self.questions and not any(r == "option" for _, r in self._open):
            self.questions[-1][1].append("")
        if tag not in ("br", "img", "hr", "input", "link", "meta"):
            self._open.append((tag, role))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self._open):
            while self._open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        roles = [r for _, r in self._open]
        if "title" in roles:
            self.title += data
        elif "question" in roles:
            self.questions[-1] = (self.questions[-1][0] + data, self.questions[-1][1])
        elif "option" in roles and self.questions and self.questions[-1][1]:
            self.questions[-1][1][-1] += data


QUESTIONS = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("questions", T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("options", T.ArrayType(T.StringType()))])))])


@F.pandas_udf(QUESTIONS)
def form(pages: pd.Series) -> pd.DataFrame:
    """Title of a form and its questions in order with their options; null and empty pages have none."""
    rows = []
    for page in pages:
        r = _Form()
        if page:
            r.feed(page)
            r.close()
        asked = [(q.strip(), [o.strip() for o in options if o.strip()]) for q, options in r.questions]
        rows.append((r.title.strip() or None, [{"question": q, "options": o} for q, o in asked if q]))
    return pd.DataFrame(rows, columns=["title", "questions"])


def file_format(url: Column) -> Column:
    """Format of a data file by its extension; null if it isn't one."""
    names = [x for k, v in DATA_FILES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*names), F.lower(F.regexp_extract(url, r"\.([A-Za-z]+)(?:[?#].*)?$", 1)))


def index_link(url: Column, index: str, keywords: tuple[str, ...]) -> Column:
    """True for links worth following from the page ``index``: a document, or a keyword on the same host below the first level, not the page itself."""
    low, home = F.lower(url), urlsplit(index)
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "^$", "/")
    deep = F.size(F.filter(F.split(path, "/"), lambda p: p != "")) > 1
    host = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1) == home.netloc
    named = low.rlike("|".join(map(re.escape, keywords))) & host & (path != (home.path or "/")) & deep
    return low.rlike(r"\.(pdf|docx?|xlsx?)$") | named


def shared_link(url: Column) -> Column:
    """struct(kind, id) of links to shared files, documents, sheets and forms."""
    kind = (
        F.when(url.contains("/forms/"), "form").when(url.contains("/spreadsheets/"), "sheet").when(url.contains("/document/"), "document")
        .when(url.rlike(r"/drive/(?:u/\d+/)?folders/"), "folder").when(url.rlike(r"/file/d/|[?&]id="), "file").otherwise("unknown")
    )
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"/d/e/([\w-]+)", r"/d/([\w-]+)", r"/folders/([\w-]+)", r"[?&]id=([\w-]+)")]
    return F.struct(kind.alias("kind"), F.coalesce(*found).alias("id"))


def publication_code(doi: Column) -> Column:
    """Code at the end of a publication's DOI, in lower case; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(doi), r"10\.\d{4,9}/([a-z]{1,3}\d{3,}[a-z]{0,2})$", 1), F.lit(""))
