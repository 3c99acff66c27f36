"""HTML extraction by consensus: pages of a host vote for the tag-class paths of their main containers, and all are extracted by the winners."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliometry.llm.html_pages import best_container, extract, parse
from foliometry.llm.tables import arrow_pass, read, stored

MIN_VOTE_PERCENT = 10
BROADCAST_HOSTS = 200_000


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; none, or a null URL, is the empty host, whose pages vote together."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def container_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): each page votes for its best container's path with its characters of prose, added up per batch and then per host."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        votes: Counter = Counter()
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            page = parse(html.as_py() or "")
            best = page.nodes[best_container(page)]
            if best.prose:
                votes[host, best.path] += best.prose
        yield {"host": [h for h, _ in votes], "path": [p for _, p in votes], "votes": list(votes.values())}

    return arrow_pass(pages.select("host", "html"), step, "host string, path string, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, paths): the paths with MIN_VOTE_PERCENT of a host's votes, most votes first; so a host has a bounded number."""
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    strong = votes.join(totals, "host").where(F.col("votes") * 100 >= F.col("total") * MIN_VOTE_PERCENT)
    ranked = strong.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("order"), "path"))).alias("ranked"))
    return ranked.select("host", F.transform("ranked", lambda r: r["path"]).alias("paths"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages.

    A null, empty or text-free page gives the empty text. A page without any of its host's paths falls back on its own best container. Repeated rows
    give repeated results; an empty table gives no rows; other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    winners = stored(winning_paths(container_votes(rows)))
    bounded = F.broadcast(winners) if winners.count() <= BROADCAST_HOSTS else winners

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        paths = batch.column("paths").to_pylist()
        texts = [extract(parse(html.as_py() or ""), paths[k] or []) for k, html in enumerate(batch.column("html"))]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    joined = rows.join(bounded, "host", "left").select("page_id", "url", "html", "paths")
    return arrow_pass(joined, step, "page_id bigint, url string, text string, n_chars bigint")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
