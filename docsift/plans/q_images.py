"""Queries over image metadata: info projection and quality filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsift import constants as C
from docsift.operators import images as I
from docsift.operators.numbering import with_position
from docsift.plans.registry import register
from docsift.sources.fixtures import duckdb_cte, fixture

_I = duckdb_cte("image_info")


@register("image_info", _I + f"""
select file_id, filename, format, width, height, mode, file_size,
  (mode in ('RGBA', 'LA') or transparency) as has_transparency, file_size > {C.MAX_PAYLOAD_BYTES} as needs_reencode
from image_info""")
def image_info(spark, sf_dir):
    return I.describe(fixture(spark, sf_dir, "image_info"))


_REASON = f"""case when file_size < {C.MIN_FILE_BYTES} or file_size > {C.MAX_FILE_BYTES} then 'file_size'
  when format not in ('JPEG', 'PNG', 'WEBP') then 'format'
  when width < {C.MIN_SIDE} or height < {C.MIN_SIDE} or width > {C.MAX_SIDE} or height > {C.MAX_SIDE} then 'dimensions'
  when greatest(width, height) > least(width, height) * {C.MAX_ASPECT} then 'aspect_ratio'
  when not decodable then 'undecodable' end"""


@register("image_filter", _I + f"""
select file_id, filename, {_REASON} as reject_reason, ({_REASON}) is null as accepted from image_info""")
def image_filter(spark, sf_dir):
    return I.apply_filter(fixture(spark, sf_dir, "image_info")).select(
        "file_id", "filename", "reject_reason", "accepted")


@register("image_filter_reasons", _I + f"""
select coalesce({_REASON}, 'accepted') as reason, count(*) as n from image_info group by 1""")
def image_filter_reasons(spark, sf_dir):
    return I.reason_counts(I.apply_filter(fixture(spark, sf_dir, "image_info")))


@register("image_filter_tuned", _I + f"""
select 'min100_5k' as variant, count(*) filter (where decodable and width >= 100 and height >= 100 and file_size >= 5000) as n_accepted from image_info
union all select 'min200_10k', count(*) filter (where decodable and width >= 200 and height >= 200 and file_size >= 10000) from image_info
union all select 'open50_10000', count(*) filter (where decodable and file_size > 1000 and width > 50 and height > 50 and width < 10000 and height < 10000) from image_info
union all select 'default', count(*) filter (where ({_REASON}) is null) from image_info""")
def image_filter_tuned(spark, sf_dir):
    return I.tuned_counts(fixture(spark, sf_dir, "image_info"))


@register("file_info", _I + """
select file_id, filename, filename as file_path, cast(row_number() over (order by filename) as bigint) as processing_order
from image_info
where lower(filename) similar to '.*\\.(jpg|jpeg|png|webp|bmp|tiff)'""")
def file_info(spark, sf_dir):
    files = fixture(spark, sf_dir, "image_info").filter(I.label_scan_filter(F.col("filename")))
    files = files.select("file_id", "filename", F.col("filename").alias("file_path"))
    return with_position(files, ["filename"], "processing_order", start=1)
