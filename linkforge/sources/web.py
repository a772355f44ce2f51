"""Optional web access. Pages and search results are tables first: what a cache table holds is never fetched.

Fetching runs inside the pipeline over URL rows, one request at a time in each partition with a delay between
them; failures are rows with an error, so one bad page fails no job."""

from __future__ import annotations

import hashlib
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkforge.functions.urls import defragment, part
from linkforge.runtime import checkpointed, ship

FETCHED = "url string, final_url string, status int, content_type string, body binary, sha256 string, error string"


@dataclass(frozen=True)
class Politeness:
    delay: float = 3.0
    timeout: float = 30.0
    retries: int = 3
    agent: str = "linkforge/1"


def _get(url: str, p: Politeness) -> tuple:
    error = None
    for attempt in range(p.retries + 1):
        if attempt:
            time.sleep(p.delay * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": p.agent}), timeout=p.timeout) as r:
                body = r.read()
                return url, r.geturl(), r.status, r.headers.get("Content-Type"), body, hashlib.sha256(body).hexdigest(), None
        except urllib.error.HTTPError as e:
            return url, url, e.code, None, None, None, f"HTTP {e.code}"
        except Exception as e:
            error = str(e)
    return url, url, None, None, None, None, error


def fetch(urls: DataFrame, allowed: DataFrame, politeness: Politeness = Politeness(), get: Callable = _get, lanes: int = 1) -> DataFrame:
    """Fetch the distinct URLs that are allowed; ``lanes`` partitions fetch side by side."""
    ship(urls.sparkSession)
    todo = urls.select("url").distinct().join(allowed.select("url").distinct(), "url", "left_semi").repartition(lanes, "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            for url in batch.column("url").to_pylist():
                if not first:
                    time.sleep(politeness.delay)
                first = False
                row = get(url, politeness)
                kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in FETCHED.split(", ")])

    return todo.mapInArrow(run, FETCHED)


def through_cache(urls: DataFrame, cache: DataFrame, fetch_misses: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pages by bare URL: from the cache table where it has them, fetched for the rest."""
    wanted = urls.select(defragment(F.col("url")).alias("url")).distinct()
    hits = cache.join(wanted, "url", "left_semi")
    misses = wanted.join(cache.select("url"), "url", "left_anti")
    return hits.unionByName(fetch_misses(misses), allowMissingColumns=True)


def robots_urls(urls: DataFrame) -> DataFrame:
    return urls.select(F.concat(part(F.col("url"), 1), F.lit("://"), part(F.col("url"), 2), F.lit("/robots.txt")).alias("url")).distinct()


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """url and allowed for each of ``urls``: whether its host's robots.txt (``robots``: url, body; no row or no body:
    nothing is forbidden) lets the agent fetch it."""
    ship(urls.sparkSession)
    site = F.concat(part(F.col("url"), 1), F.lit("://"), part(F.col("url"), 2))
    rules = robots.select(F.regexp_replace("url", "/robots\\.txt$", "").alias("site"), F.col("body").cast("binary").alias("body")).dropDuplicates(["site"])
    wanted = urls.select("url", defragment(F.col("url")).alias("bare"), site.alias("site")).join(rules, "site", "left").select("url", "bare", "site", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, urllib.robotparser.RobotFileParser] = {}
        for batch in batches:
            out = []
            for bare, host, body in zip(*(batch.column(c).to_pylist() for c in ("bare", "site", "body"))):
                if body is None:
                    out.append(True)
                    continue
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[host] = urllib.robotparser.RobotFileParser()
                    known[host].parse(body.decode("utf-8", "replace").splitlines())
                out.append(known[host].can_fetch(agent, bare))
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(out, pa.bool_())], names=["url", "allowed"])

    return wanted.mapInArrow(run, "url string, allowed boolean")


def fetch_politely(urls: DataFrame, politeness: Politeness = Politeness(), get: Callable = _get, lanes: int = 1) -> DataFrame:
    """Fetch what robots rules allow; a forbidden URL is a row with an error. robots.txt files are fetched first."""
    files = robots_urls(urls)
    robots = checkpointed(fetch(files, files, politeness, get, lanes))
    judged = checkpointed(robots_allowed(urls.select("url").distinct(), robots.where("status between 200 and 299"), politeness.agent))
    allowed = judged.where("allowed").select("url")
    refused = judged.where("not allowed").select("url", F.lit("robots.txt disallows fetching this URL").alias("error"))
    return fetch(allowed, allowed, politeness, get, lanes).unionByName(refused, allowMissingColumns=True)


def text_pages(fetched: DataFrame) -> DataFrame:
    """Successful pages of a text type, decoded."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    ok = F.col("error").isNull() & (F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("text")))
    return fetched.where(ok).select("url", F.decode("body", "UTF-8").alias("html"))


class SearchProvider(Protocol):
    """A search service: query text to rows of title, url, snippet."""

    name: str

    def search(self, query: str, limit: int) -> list[dict]: ...


class NoSearch:
    name = "none"

    def search(self, query: str, limit: int) -> list[dict]:
        return []


# Where a provider's JSON answer holds its results, and their title, url and snippet.
ANSWERS = {
    "searxng": ("results", "title", "url", "content"),
    "brave": ("web.results", "title", "url", "description"),
    "duckduckgo": ("RelatedTopics", "Text", "FirstURL", "Text"),
}


def normalized_results(answers: DataFrame, provider: str, limit: int = 10) -> DataFrame:
    """query, pos, title, url, snippet from raw JSON answers (query, body) of a provider."""
    where, title, url, snippet = ANSWERS[provider]
    items = F.from_json(F.get_json_object("body", f"$.{where}"), "array<map<string,string>>")
    rows = answers.select("query", F.posexplode(F.slice(items, 1, limit)).alias("pos", "x"))
    return rows.select("query", "pos", F.col("x")[title].alias("title"), F.col("x")[url].alias("url"), F.col("x")[snippet].alias("snippet")).where("url is not null")


def choose_provider(asked: str, available: dict[str, SearchProvider]) -> SearchProvider:
    """The provider asked for, or for 'auto' the first available of searxng, duckduckgo, brave; else none."""
    order = ("searxng", "duckduckgo", "brave") if asked == "auto" else (asked,)
    return next((available[n] for n in order if n in available), NoSearch())


def search_all(queries: DataFrame, provider: SearchProvider, limit: int = 10) -> DataFrame:
    """query, pos, title, url, snippet, error for every query; a failed query is a row with its error."""
    ship(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for q in batch.column("query").to_pylist():
                try:
                    out += [{"query": q, "pos": i, "title": r.get("title"), "url": r.get("url"), "snippet": r.get("snippet"), "error": None} for i, r in enumerate(provider.search(q, limit)[:limit])]
                except Exception as e:
                    out.append({"query": q, "pos": 0, "title": None, "url": None, "snippet": None, "error": str(e)})
            schema = pa.schema([("query", pa.string()), ("pos", pa.int32()), *[(n, pa.string()) for n in ("title", "url", "snippet", "error")]])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return queries.select("query").distinct().mapInArrow(run, "query string, pos int, title string, url string, snippet string, error string")
