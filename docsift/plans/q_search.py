"""Queries over stored search responses."""

from __future__ import annotations

from docsift import constants as C
from docsift.operators import search as S
from docsift.plans.registry import register
from docsift.sources.fixtures import duckdb_cte, fixture

_R = duckdb_cte("search_responses")

# DuckDB: item list per engine and the URL of one item
_DK = {
    "serper": ("$.images[*]", "json_exists(x, '$.imageUrl') or json_exists(x, '$.link')",
               "case when json_exists(x, '$.imageUrl') then x ->> '$.imageUrl' else x ->> '$.link' end"),
    "serpapi": ("$.images_results[*]", "json_exists(x, '$.original')", "x ->> '$.original'"),
    "unsplash": ("$.results[*]", "true", "x ->> '$.urls.regular'"),
    "flickr": ("$.photos.photo[*]", "true",
               "printf('https://farm%s.staticflickr.com/%s/%s_%s_b.jpg', x ->> '$.farm', x ->> '$.server', x ->> '$.id', x ->> '$.secret')"),
}


def _dk_engine(engine: str, limit: int = 100) -> str:
    path, keep, url = _DK[engine]
    cap = min(limit, C.ENGINE_PAGE_CAP[engine])
    return f"""select response_id, keyword, engine, cast(row_number() over (partition by response_id order by i) - 1 as integer) as pos, url
 from (select response_id, keyword, engine, i, {url} as url
   from (select response_id, keyword, engine, unnest(items) as x, generate_subscripts(items, 1) as i
     from (select *, json_extract(body, '{path}') as items from search_responses where status_code = 200 and engine = '{engine}'))
   where {keep})
 qualify pos < {cap}"""


def _make(engine):
    @register(f"search_urls_{engine}", _R + _dk_engine(engine))
    def q(spark, sf_dir):
        return S.search_urls(fixture(spark, sf_dir, "search_responses"), engine=engine)
    return q


for _e in C.ENGINES:
    _make(_e)

_ALL = "\n union all ".join(f"({_dk_engine(e)})" for e in C.ENGINES)


@register("search_urls", _R + _ALL)
def search_urls(spark, sf_dir):
    return S.search_urls(fixture(spark, sf_dir, "search_responses"))


MAX_IMAGES = 500


@register("crawl_budgets", _R + f"""
select count(distinct keyword) as n_keywords, {MAX_IMAGES} // count(distinct keyword) as per_keyword,
  ({MAX_IMAGES} // count(distinct keyword)) // 4 as per_engine from search_responses""")
def crawl_budgets(spark, sf_dir):
    return S.crawl_budgets(fixture(spark, sf_dir, "search_responses"), MAX_IMAGES)


@register("crawl_selection", _R + f""", u as ({_ALL}),
 b as (select count(distinct keyword) as nk from search_responses),
 r as (select u.*, case engine when 'serper' then 0 when 'unsplash' then 1 when 'serpapi' then 2 else 3 end as engine_rank,
   row_number() over (partition by keyword, engine order by response_id, pos) as rn from u),
 l as (select r.* from r, b where rn <= ({MAX_IMAGES} // nk) // 4),
 k as (select keyword, url, min_by(engine, (engine_rank, response_id, pos)) as engine,
   min((engine_rank, response_id, pos)) as first from l group by keyword, url),
 kl as (select k.* from k, b qualify row_number() over (partition by keyword order by first) <= {MAX_IMAGES} // nk),
 g as (select url, min_by(keyword, (keyword, first)) as keyword, min_by(engine, (keyword, first)) as engine,
   min((keyword, first)) as gk from kl group by url)
select cast(row_number() over (order by gk) - 1 as integer) as seq, url, keyword, engine
from g order by gk limit {MAX_IMAGES}""")
def crawl_selection(spark, sf_dir):
    return S.crawl_selection(fixture(spark, sf_dir, "search_responses"), max_images=MAX_IMAGES)
