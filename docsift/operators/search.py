"""Stored search responses -> ranked URL rows, and the multi-engine crawl selection.

A response row is ``(response_id, keyword, engine, status_code, body)`` where
``body`` is the provider's JSON text. Only status 200 yields URLs. URL lists
are built per row with higher-order array functions (no shuffle); the crawl
selection then needs three keyed steps, each a map-side-combined aggregate or
a per-group top-k that Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift import constants as C
from docsift.functions import json as J


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _has(x: Column, key: str) -> Column:
    return F.variant_get(x, "$." + key, "variant").isNotNull()


def _str(x: Column, path: str) -> Column:
    return F.try_variant_get(x, path, "string")


def engine_urls(engine: str, body: Column) -> Column:
    """ARRAY<STRING> of URLs in provider order for one engine's response body."""
    v = J.strict_parse(body)
    if engine == "serper":
        items = F.filter(_items(v, "$.images"), lambda x: _has(x, "imageUrl") | _has(x, "link"))
        return F.transform(items, lambda x: F.when(_has(x, "imageUrl"), _str(x, "$.imageUrl"))
                           .otherwise(_str(x, "$.link")))
    if engine == "serpapi":
        items = F.filter(_items(v, "$.images_results"), lambda x: _has(x, "original"))
        return F.transform(items, lambda x: _str(x, "$.original"))
    if engine == "unsplash":
        items = _items(v, "$.results")
        urls = F.transform(items, lambda x: _str(x, "$.urls.regular"))
        # a result without urls.regular fails the whole search -> no URLs
        return F.when(F.exists(items, lambda x: F.variant_get(x, "$.urls.regular", "variant").isNull()),
                      F.array().cast("array<string>")).otherwise(urls)
    if engine == "flickr":
        items = _items(v, "$.photos.photo")
        parts = ("farm", "server", "id", "secret")
        incomplete = F.exists(items, lambda x: F.greatest(*[F.variant_get(x, "$." + p, "variant").isNull()
                                                           for p in parts]))
        urls = F.transform(items, lambda x: F.format_string(C.FLICKR_URL_FORMAT,
                                                            *[_str(x, "$." + p) for p in parts]))
        return F.when(incomplete, F.array().cast("array<string>")).otherwise(urls)
    raise ValueError(f"Unsupported search engine: {engine}")


def search_urls(responses: DataFrame, engine: str | None = None, limit: int = 100) -> DataFrame:
    """``response_id, keyword, engine, pos, url`` for successful responses.

    With ``engine`` only that engine's rows are read (an unknown name raises
    ``ValueError`` before any job runs); without it every row is dispatched on
    its own engine column and rows of unknown engines yield nothing. Each
    response keeps its first ``min(limit, page cap)`` URLs.
    """
    engines = C.ENGINES if engine is None else (engine,)
    for e in engines:
        if e not in C.ENGINES:
            raise ValueError(f"Unsupported search engine: {e}")
    rows = responses.filter(F.col("status_code") == 200)
    if engine is not None:
        rows = rows.filter(F.col("engine") == engine)
    urls = F.lit(None).cast("array<string>")
    for e in reversed(engines):
        cap = min(limit, C.ENGINE_PAGE_CAP[e])
        urls = F.when(F.col("engine") == e, F.slice(engine_urls(e, F.col("body")), 1, cap)).otherwise(urls)
    return rows.select("response_id", "keyword", "engine", F.posexplode(urls).alias("pos", "url"))


def budgets(n_keywords: Column, max_images: int, engine: str = "mixed") -> tuple[Column, Column]:
    """(per keyword, per engine) URL budgets of a crawl; without keywords the whole budget."""
    per_keyword = F.coalesce(F.floor(F.try_divide(F.lit(max_images), n_keywords)), F.lit(max_images)).cast("bigint")
    per_engine = F.floor(per_keyword / len(C.ENGINES)).cast("bigint") if engine == "mixed" else per_keyword
    return per_keyword, per_engine


def crawl_budgets(responses: DataFrame, max_images: int = 500) -> DataFrame:
    """One row: ``n_keywords, per_keyword, per_engine`` over all responses,
    those of keywords whose searches all failed too."""
    n = responses.agg(F.count_distinct("keyword").alias("n_keywords"))
    per_keyword, per_engine = budgets(F.col("n_keywords"), max_images)
    return n.select("n_keywords", per_keyword.alias("per_keyword"), per_engine.alias("per_engine"))


def crawl_selection(responses: DataFrame, max_images: int = 500, n_keywords: int | None = None) -> DataFrame:
    """Mixed-engine crawl: per-engine limit, per-keyword distinct + limit,
    global distinct + limit. First-seen order decides which duplicate stays
    and what the limits keep: keyword, then engine order, then response and
    rank. Returns ``seq, url, keyword, engine``. ``n_keywords``: how many were
    searched for, where that is more than have a response.
    """
    if n_keywords is None:
        budget = crawl_budgets(responses, max_images).first()
    else:
        budget = responses.sparkSession.range(1).select(*[c.alias(k) for c, k in zip(
            budgets(F.lit(n_keywords), max_images), ("per_keyword", "per_engine"))]).first()
    rank = F.lit(len(C.ENGINES))
    for i, e in reversed(list(enumerate(C.ENGINES))):
        rank = F.when(F.col("engine") == e, F.lit(i)).otherwise(rank)
    w_engine = Window.partitionBy("keyword", "engine").orderBy("response_id", "pos")
    limited = (search_urls(responses).withColumn("engine_rank", rank)
               .withColumn("_rn", F.row_number().over(w_engine))
               .filter(F.col("_rn") <= budget["per_engine"]))
    seen = F.struct("engine_rank", "response_id", "pos", "engine")
    per_kw = limited.groupBy("keyword", "url").agg(F.min(seen).alias("first"))
    w_kw = Window.partitionBy("keyword").orderBy("first")
    per_kw = per_kw.withColumn("_rn", F.row_number().over(w_kw)).filter(F.col("_rn") <= budget["per_keyword"])
    glob = per_kw.groupBy("url").agg(F.min(F.struct("keyword", "first")).alias("g"))
    top = glob.orderBy("g").limit(max_images)
    return top.select(
        (F.row_number().over(Window.orderBy("g")) - 1).alias("seq"),
        "url", F.col("g.keyword").alias("keyword"), F.col("g.first.engine").alias("engine"))
