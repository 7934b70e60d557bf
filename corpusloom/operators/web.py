"""URLs, links and HTML of crawled pages."""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..session import materialise

# Endings and path parts of links that lead to no article.
SKIPPED_ENDINGS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".pdf", ".zip", ".tar", ".gz", ".mp4", ".mp3", ".ogg", ".css", ".js", ".xml", ".rss", ".atom")
SKIPPED_PARTS = ("/tag/", "/tags/", "/author/", "/authors/", "/search/", "/login", "/logout", "/register", "/signup", "/cart", "/wp-admin", "/wp-login", "/feed/", "/sitemap", "/cdn-cgi/", "/page/")
# Elements without readable text, elements without content, and where articles stand, best first.
JUNK = frozenset("script style nav footer header aside form noscript figure figcaption iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ARTICLE = (("tag", "article"), ("class", "post-content"), ("class", "entry-content"), ("class", "article-body"), ("class", "story-body"), ("class", "td-post-content"), ("class", "content-area"), ("id", "content"), ("tag", "main"))


def normalised_url(url: Column) -> Column:
    """Without fragment, query and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"[#?].*$", ""), r"/+$", "")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)


def is_article_link(url: Column, own_host: Column) -> Column:
    """Same host, http or https, and neither a skipped ending nor a skipped part in its path."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    endings = F.rlike(path, F.lit("(" + "|".join(e.replace(".", r"\.") for e in SKIPPED_ENDINGS) + ")$"))
    parts = F.rlike(path, F.lit("|".join(p.replace("-", r"\-") for p in SKIPPED_PARTS)))
    return F.rlike(url, F.lit("^https?://")) & (host(url) == own_host) & ~endings & ~parts


@F.pandas_udf(Y.StringType())
def resolved(page: pd.Series, link: pd.Series) -> pd.Series:
    """Absolute form of a link found on a page."""
    return pd.Series([None if p is None or x is None else urljoin(p, x.strip()) for p, x in zip(page, link)])


@F.pandas_udf(Y.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Decoded HTML entities."""
    return text.map(lambda t: t if t is None else _html.unescape(t))


class _Tree(HTMLParser):
    """A page's texts with the elements that are open around each, junk left out; and its links and title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict, int]] = []
        self.count = 0
        self.texts: list[tuple[tuple[int, ...], str]] = []
        self.found: dict[int, list[int]] = {}
        self.body: int | None = None
        self.links: list[str] = []
        self.title: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in VOID:
            return
        self.count += 1
        self.stack.append((tag, a, self.count))
        if tag == "body" and self.body is None:
            self.body = self.count
        for i, (kind, value) in enumerate(ARTICLE):
            if tag == value if kind == "tag" else value in a.get("class", "") if kind == "class" else a.get("id") == value:
                self.found.setdefault(i, []).append(self.count)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if any(t == "title" for t, _, _ in self.stack):
            self.title.append(data)
        elif not any(t in JUNK for t, _, _ in self.stack):
            self.texts.append((tuple(n for _, _, n in self.stack), data))

    def inside(self, node: int | None) -> list[str]:
        return [t for open_, t in self.texts if node is None or node in open_]


def parse(page: str) -> _Tree:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree


def main_text_of(page: str, least: int = 300, line: int = 25) -> str:
    """Lines longer than ``line`` of the first article element with more than ``least`` characters, else of the body."""
    tree = parse(page)
    node = tree.body
    for i in range(len(ARTICLE)):
        first = next(iter(tree.found.get(i, [])), None)
        if first is not None and sum(len(t.strip()) for t in tree.inside(first)) > least:
            node = first
            break
    lines = (x.strip() for x in "\n".join(tree.inside(node)).splitlines())
    return "\n".join(x for x in lines if len(x) > line)


@F.pandas_udf(Y.StringType())
def main_text(page: pd.Series) -> pd.Series:
    return page.map(lambda p: None if p is None else main_text_of(p))


@F.pandas_udf(Y.ArrayType(Y.StringType()))
def links(page: pd.Series) -> pd.Series:
    return page.map(lambda p: [] if p is None else parse(p).links)


def title(page: Column) -> Column:
    """Text of the first title element, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def unseen(candidates: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Candidates whose URL is not among the seen ones, each once."""
    return candidates.dropDuplicates([url]).join(seen.select(url).distinct(), url, "left_anti")


def sitemap_urls(xml: Column) -> Column:
    """The addresses that a sitemap lists, in order; they can be seeds of a crawl."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc[^>]*>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def crawl(pages: DataFrame, seeds: DataFrame, most_rounds: int | None = None, most_pages: int | None = None) -> DataFrame:
    """(url, depth): breadth-first over stored pages (url, html) from the seeds (url), each page once.

    A round is a join of the frontier with the pages and an anti-join with what was visited.  It ends when nothing new
    is linked.  Limits are for partial crawls: ``most_rounds`` is the greatest depth, and of the round
    that passes ``most_pages`` only the first addresses by name are taken.
    """
    pages = pages.select(normalised_url(F.col("url")).alias("url"), "html").dropDuplicates(["url"])
    frontier = materialise(seeds.select(normalised_url(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0)))
    visited, n, depth = frontier, frontier.count(), 0
    while (most_rounds is None or depth < most_rounds) and (most_pages is None or n < most_pages):
        depth += 1
        out = pages.join(frontier.select("url"), "url").select("url", F.explode(links("html")).alias("href")).select("url", normalised_url(resolved(F.col("url"), F.col("href"))).alias("to"))
        out = out.where(is_article_link(F.col("to"), host(F.col("url")))).select(F.col("to").alias("url")).distinct()
        frontier = materialise(out.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        found = frontier.count()
        if not found:
            break
        if most_pages is not None and n + found > most_pages:
            frontier = frontier.orderBy("url").limit(most_pages - n)
        visited, n = visited.union(frontier), n + found
    return visited
