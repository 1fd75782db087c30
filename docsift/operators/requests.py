"""Vision-model request bodies as a column (input of a batch inference job).

The prompt is a parameter; the request carries the image as a base64 data
URL, always declared as JPEG. Payloads above the size limit are flagged for re-encoding
(``needs_reencode``), which happens outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsift import constants as C
from docsift.sources.images import payload_b64

LABEL_PARAMS = {"max_tokens": 1500, "temperature": 0.1, "detail": "high"}
EXTRACT_PARAMS = {"max_tokens": 2000, "temperature": 0.1, "detail": "high"}


def request_body(content: Column, prompt: str, model: str, params=LABEL_PARAMS) -> Column:
    """JSON text of a chat request with one text part and one image part."""
    url = F.concat(F.lit(C.DATA_URL_PREFIX), payload_b64(content))
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text"),
                 F.lit(None).cast("struct<url:string,detail:string>").alias("image_url")),
        F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                 F.struct(url.alias("url"), F.lit(params["detail"]).alias("detail")).alias("image_url")))
    msg = F.array(F.struct(F.lit("user").alias("role"), parts.alias("content")))
    return F.to_json(F.struct(F.lit(model).alias("model"), msg.alias("messages"),
                              F.lit(params["max_tokens"]).alias("max_tokens"),
                              F.lit(params["temperature"]).alias("temperature")))


def needs_reencode(length: Column) -> Column:
    return length > C.MAX_PAYLOAD_BYTES
