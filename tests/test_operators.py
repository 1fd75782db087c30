"""Fetch naming, numbering, search shapes, attempts, filters."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import fetch as FT
from docsift.operators import images as I
from docsift.operators import labels as L
from docsift.operators import search as S
from docsift.operators.numbering import with_position


@pytest.mark.parametrize("url", ["http://h.example.com/a/b.JPG?x=1.png", "http://h.example.com/.jpg",
                                 "http://h.example.com/a.b/c", "http://h.example.com/x.tar.webp#f",
                                 "http://h.example.com/y.gif", "http://h.example.com", "http://h/a/..png",
                                 "http://h/a/b.", "http://h/a/.b.c"])
def test_path_suffix_matches_splitext(spark, url):
    from urllib.parse import urlparse
    want = os.path.splitext(urlparse(url).path)[1]
    got = spark.createDataFrame([(url,)], "u string").select(
        FT.path_suffix(FT.url_path(F.col("u"))).alias("s")).first().s
    assert got == want


def test_file_suffix_rules(spark):
    rows = [("image/jpeg", "http://x/a.png"), ("IMAGE/JPEG", "http://x/a.png"), ("", "http://x/a.gif"),
            ("image/webp", "http://x/a"), ("text/plain", "http://x/a.JPEG")]
    df = spark.createDataFrame(rows, "ct string, u string")
    got = [r.e for r in df.select(FT.file_suffix(F.col("ct"), F.col("u")).alias("e")).collect()]
    assert got == [".jpg", ".png", ".jpg", ".webp", ".jpeg"]


def test_with_position_is_dense_and_ordered(spark):
    vals = random.Random(3).sample(range(10**9), 5000)
    df = spark.createDataFrame([(v,) for v in vals], "k long").repartition(7)
    got = with_position(df, ["k"], "pos", start=1, ranges=13).orderBy("k").collect()
    assert [r.pos for r in got] == list(range(1, 5001))


def test_with_position_strings(spark):
    names = [f"image_{i:06d}.jpg" for i in random.Random(5).sample(range(100000), 700)]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = {r.f: r.p for r in with_position(df, ["f"], "p", ranges=9).collect()}
    assert [got[n] for n in sorted(names)] == list(range(700))


def test_search_shapes(spark):
    rows = [
        (1, "k", "serper", 200, '{"images":[{"imageUrl":"a","link":"x"},{"link":"b"},{"title":"t"},{"imageUrl":"c"}]}'),
        (2, "k", "serpapi", 200, '{"images_results":[{"original":"d"},{"thumbnail":"e"}]}'),
        (3, "k", "unsplash", 200, '{"results":[{"urls":{"regular":"f"}}]}'),
        (4, "k", "flickr", 200, '{"photos":{"photo":[{"farm":1,"server":"s","id":"1","secret":"x"}]}}'),
        (5, "k", "serper", 429, '{"images":[{"imageUrl":"z"}]}'),
    ]
    df = spark.createDataFrame(rows, "response_id long, keyword string, engine string, status_code int, body string")
    got = [(r.response_id, r.pos, r.url) for r in S.search_urls(df).orderBy("response_id", "pos").collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d"), (3, 0, "f"),
                   (4, 0, "https://farm1.staticflickr.com/s/1_x_b.jpg")]
    with pytest.raises(ValueError, match="Unsupported search engine: google"):
        S.search_urls(df, engine="google")


def test_budgets(spark):
    def of(keywords, images):
        return tuple(spark.range(1).select(*S.budgets(F.lit(keywords), images)).first())

    assert [of(1, n)[1] for n in range(5)] == [0, 0, 0, 0, 1]
    assert of(3, 100) == (33, 8) and of(0, 100) == (100, 25)


def test_failed_keywords_count_for_the_budget(spark):
    body = '{"images":[{"imageUrl":"a"},{"imageUrl":"b"},{"imageUrl":"c"}]}'
    rows = [(1, "k", "serper", 200, body), (2, "lost", "serper", 429, body)]
    df = spark.createDataFrame(rows, "response_id long, keyword string, engine string, status_code int, body string")
    assert [r.url for r in S.crawl_selection(df, max_images=8).collect()] == ["a"]
    assert S.crawl_selection(df.limit(0), max_images=8).count() == 0


def test_attempt_resolution(spark):
    rows = [("u1", 1, 500, None), ("u1", 2, None, "timeout"), ("u1", 3, 200, None),
            ("u2", 1, 404, None), ("u2", 2, 200, None),
            ("u3", 1, None, "network"),
            ("u4", 1, 500, None), ("u4", 2, 500, None), ("u4", 3, 500, None), ("u4", 4, 200, None)]
    df = spark.createDataFrame(rows, "url string, attempt int, status_code int, exception_kind string")
    got = {r.url: (r.outcome, r.attempts_used) for r in FT.resolve_attempts(df).collect()}
    assert got == {"u1": ("done", 3), "u2": ("gave_up", 1), "u3": ("gave_up", 1), "u4": ("exhausted", 3)}


def test_filter_reasons_order(spark):
    rows = [(1, "a", 4000, "JPEG", 500, 500, True), (2, "b", 6000, "GIF", 500, 500, True),
            (3, "c", 6000, "PNG", 200, 500, True), (4, "d", 6000, "PNG", 301, 3500, True),
            (5, "e", 6000, "WEBP", 500, 500, False), (6, "f", 6000, "JPEG", 500, 500, True)]
    df = spark.createDataFrame(rows, "file_id int, filename string, file_size long, format string, width int, "
                                     "height int, decodable boolean")
    got = [r.reject_reason for r in I.apply_filter(df).orderBy("file_id").collect()]
    assert got == ["file_size", "format", "dimensions", "aspect_ratio", "undecodable", None]


def test_failure_hints(spark):
    df = spark.createDataFrame([("HTTP 429",), ("Quota exceeded",), ("401 x",), ("Unauthorized",), ("boom",), (None,)],
                               "e string")
    got = [r.h for r in df.select(L.failure_hint(F.col("e")).alias("h")).collect()]
    assert got == ["rate_limit", "rate_limit", "auth", "auth", "unexpected", "unexpected"]
