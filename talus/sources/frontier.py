"""A polite crawl that follows links: a frontier of pages, fetched in rounds until nothing new is found.

Each round takes the pages not seen before (an anti-join), at most ``per_host`` of a host, drops what the host's robots file forbids, fetches the
rest dealt by host, and hands each kind of page to the function that finds its links. What a round leaves over waits for the next, so a host with very
many pages does not hold up the others. Fetched pages, seen addresses and robots files are tables in the shared folder.

A page is fetched once, whatever the number of links to it; the first link (by round, page, place) names it. Addresses are joined to their page's, without
fragment, with sorted parameters. A page that fails or is larger than ``max_bytes`` is kept without its body and nothing is followed from it. Where a
robots file cannot be fetched, nothing is forbidden.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.sources import regions as R
from talus.store import stored

MAX_BYTES = 2 * 1024 * 1024
AGENT = "talus"
_ASKED = "url string, host string, role string, name string, parent string, pos int"
_PAGE = "url string, host string, role string, name string, parent string, status string, content_type string, content binary"
_GOT = "url string, status string, content_type string, content binary"

#: fetch(url) -> (content type, body), or raises.
Fetch = Callable[[str], tuple[str, bytes]]
#: What a kind of page links to: pages -> (parent, pos, href, role, name).
Follow = Callable[[DataFrame], DataFrame]


def canonical(base: str | None, href: str | None) -> str | None:
    """The address that a link on page ``base`` leads to; None if there is none or it is no web address."""
    if href is None:
        return None
    try:
        to = urlsplit(urljoin(base or "", href.strip()))
        port = to.port
    except ValueError:
        return None
    if to.scheme not in ("http", "https") or not to.hostname:
        return None
    place = to.hostname + (f":{port}" if port and port != {"http": 80, "https": 443}[to.scheme] else "")
    query = urlencode(sorted(parse_qsl(to.query, keep_blank_values=True)))
    return urlunsplit((to.scheme, place, to.path or "/", query, ""))


def addresses(base: Column, href: Column) -> Column:
    """``canonical`` of columns."""

    def join(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for bases, hrefs in parts:
            yield pa.array([canonical(b, h) for b, h in zip(bases.to_pylist(), hrefs.to_pylist())], pa.string())

    join.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(join, "string")(base, href)


def _host(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://([^/?]*)", 1)


def _got(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["url", "status", "content_type", "content"])


def by_host(fetch: Fetch, delay: float = 1.0, max_bytes: int = MAX_BYTES, agent: str = AGENT) -> Callable[[DataFrame], DataFrame]:
    """Fetches pages (url, host, robots) one after the other within a host, with its delay; a task has whole hosts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rules, last = None, RobotFileParser(), 0.0
        for batch in batches:
            for url, host, robots in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "robots"))):
                if host != at:
                    at, rules, last = host, RobotFileParser(), 0.0
                    rules.parse((robots or "").splitlines())
                if not rules.can_fetch(agent, url):
                    yield _got([(url, "disallowed", None, None)])
                    continue
                rest = last + max(delay, float(rules.crawl_delay(agent) or 0)) - time.monotonic()
                if last and rest > 0:
                    time.sleep(rest)
                last = time.monotonic()
                try:
                    kind, body = fetch(url)
                except Exception:  # noqa: BLE001 - whatever a page's failure is, the crawl goes on
                    yield _got([(url, "failed", None, None)])
                    continue
                large = len(body) > max_bytes
                yield _got([(url, "too_large" if large else "ok", kind, None if large else body)])

    return lambda pages: pages.repartition("host").sortWithinPartitions("host", "url").mapInArrow(run, _GOT)


def from_table(store: DataFrame, agent: str = AGENT) -> Callable[[DataFrame], DataFrame]:
    """Fetches pages from a table (url, content_type, content) by a join, under the same robots rules; an address stands there once."""

    def allowed(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rules: dict[str, RobotFileParser] = {}
        for urls, robots in parts:
            out = []
            for url, text in zip(urls.to_pylist(), robots.to_pylist()):
                if text not in rules:
                    rules = {text: RobotFileParser()}
                    rules[text].parse((text or "").splitlines())
                out.append(rules[text].can_fetch(agent, url))
            yield pa.array(out, pa.bool_())

    allowed.__annotations__ = {"parts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    ask = F.arrow_udf(allowed, "boolean")

    def run(pages: DataFrame) -> DataFrame:
        asked = pages.select("url", ask("url", "robots").alias("may"))
        found = asked.where("may").join(store.select("url", "content_type", "content", F.lit(True).alias("there")), "url", "left")
        found = found.select("url", F.when(F.col("there"), "ok").otherwise("failed").alias("status"), "content_type", "content")
        return found.union(asked.where("not may").select("url", F.lit("disallowed"), F.lit(None).cast("string"), F.lit(None).cast("binary")))

    return run


def _within(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    name = F.regexp_replace(host, ":[0-9]+$", "")
    return reduce(lambda a, b: a | b, [(name == d) | F.endswith(name, F.lit(f".{d}")) for d in domains], F.lit(not domains))


def crawl(spark: SparkSession, start: list[str], follow: dict[str, Follow], fetch: Callable[[DataFrame], DataFrame], domains: list[str] = (), per_host: int | None = 10_000, most_rounds: int | None = None) -> DataFrame:
    """All pages reached from ``start`` (whose role is ``start``): url, host, role, name, parent, status, content_type, content, round.

    ``most_rounds`` ends the crawl early, at a depth of links if ``per_host`` is never reached. With ``per_host`` None nothing waits (for tables, which
    need no politeness), so ``round`` is the depth of links.
    """
    first = [(u, "start", None, None, i) for i, u in enumerate(filter(None, (canonical(None, x) for x in start)))]
    frontier = spark.createDataFrame(first, "url string, role string, name string, parent string, pos int").withColumn("host", _host(F.col("url")))
    frontier = stored(_first(frontier.select(*_names(_ASKED))), "frontier")
    robots: DataFrame | None = None
    pages: list[DataFrame] = []
    seen = frontier.select("url")
    while (most_rounds is None or len(pages) < most_rounds) and not frontier.isEmpty():
        if per_host is None:
            now, later = frontier, None
        else:
            turn = F.row_number().over(Window.partitionBy("host").orderBy("pos", "url"))
            frontier = frontier.withColumn("turn", turn)
            now = stored(frontier.where(F.col("turn") <= per_host).drop("turn"), "round")
            later = frontier.where(F.col("turn") > per_host).drop("turn")
            later = None if later.isEmpty() else later
        robots = _robots(now, robots, fetch)
        got = fetch(now.select("url", "host").join(robots, "host", "left"))
        page = stored(now.join(got, "url").select(*_names(_PAGE)), "pages")
        pages.append(page.withColumn("round", F.lit(len(pages))))
        ok = page.where("status = 'ok'")
        found = [f(ok.where(F.col("role") == role)).select("parent", "pos", "href", "role", "name") for role, f in follow.items()]
        if found:
            links = reduce(DataFrame.union, found).withColumn("url", addresses(F.col("parent"), F.col("href"))).where("url is not null")
            links = links.withColumn("host", _host(F.col("url"))).where(_within(F.col("host"), list(domains)))
            new = _first(links.select(*_names(_ASKED))).join(seen, "url", "left_anti").select(*_names(_ASKED))
            new = stored(new, "frontier")
            seen = seen.union(new.select("url"))
            frontier = new if later is None else stored(new.union(later.select(*_names(_ASKED))), "frontier")
        elif later is None:
            break
        else:
            frontier = later.select(*_names(_ASKED))
    if not pages:
        return spark.createDataFrame([], _PAGE + ", round int")
    return reduce(DataFrame.union, pages)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _first(links: DataFrame) -> DataFrame:
    """One row an address: the first link to it by page and place."""
    names = [c for c in links.columns if c != "url"]
    least = F.min_by(F.struct(*names), F.struct("parent", "pos", "role", "name")).alias("x")
    return links.groupBy("url").agg(least).select("url", *[F.col(f"x.{c}").alias(c) for c in names])


def _robots(pages: DataFrame, known: DataFrame | None, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(host, robots): the robots files of all hosts so far; each is fetched once."""
    scheme = F.regexp_extract("url", "^([a-z]+)://", 1)
    hosts = pages.groupBy("host").agg(F.min(scheme).alias("scheme"))
    if known is not None:
        hosts = hosts.join(known, "host", "left_anti")
        if hosts.isEmpty():
            return known
    asked = hosts.select(F.concat("scheme", F.lit("://"), "host", F.lit("/robots.txt")).alias("url"), "host", F.lit(None).cast("string").alias("robots"))
    got = fetch(asked).where("status = 'ok'")
    new = stored(hosts.select("host").join(got.select(_host(F.col("url")).alias("host"), F.col("content").cast("string").alias("robots")), "host", "left"), "robots")
    return new if known is None else known.union(new)


def linked(path: str, role: str, keep: Callable[[Column], Column] | None = None) -> Follow:
    """Follow the links at ``path`` whose label ``keep`` accepts; the label names the page."""

    def find(pages: DataFrame) -> DataFrame:
        page = pages.select(F.col("url").alias("parent"), R.regions(F.col("content").cast("string")).alias("page"))
        anchors = F.transform(R.select(F.col("page"), path), lambda e: F.struct(e.n.alias("pos"), e.href.alias("href"), R.text_of(F.col("page"), e).alias("name")))
        out = page.select("parent", F.inline(anchors)).where("href is not null")
        out = out.where(keep(F.col("name"))) if keep else out
        return out.withColumn("role", F.lit(role))

    return find
