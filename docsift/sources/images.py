"""Image metadata from bytes, and the pixel form of the average hash.

Header parsing walks the segments of a file up to the frame header, wherever
that is. It is a pandas UDF over Arrow batches (one small loop per row in
Python, no per-row JVM round trip). The JVM ``image`` source decodes JPEG, PNG, BMP and GIF; WebP
has no JVM reader, so for WebP only the header is checked.
"""

from __future__ import annotations

import functools
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import scratch_dir
from docsift.sources.image_folder import list_images, with_content, write_files

INFO_TYPE = "struct<format:string,width:int,height:int,mode:string,transparency:boolean,error:string>"

_PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}


def _png_transparency(b: bytes) -> bool:
    """A tRNS chunk stands before the image data, after however many others."""
    at = 8
    while at + 8 <= len(b):
        n, kind = struct.unpack(">I4s", b[at:at + 8])
        if kind == b"tRNS":
            return True
        if kind in (b"IDAT", b"IEND"):
            return False
        at += 12 + n
    return False


def _gif_transparency(b: bytes) -> bool:
    """The flag of a graphic control extension before the first image."""
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 0x80 else 0)
    while at + 3 < len(b) and b[at] == 0x21:
        if b[at + 1] == 0xF9:
            return bool(b[at + 3] & 1)
        at += 2
        while at < len(b) and b[at]:
            at += 1 + b[at]
        at += 1
    return False


def _header_info(b: bytes | None) -> dict:
    if b is None or len(b) < 12:
        return {"error": "cannot identify image file"}
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, depth, ctype = struct.unpack(">IIBB", b[16:26])
            return {"format": "PNG", "width": w, "height": h, "mode": _PNG_MODES.get(ctype, "RGB"),
                    "transparency": _png_transparency(b)}
        if b[:3] == b"GIF":
            w, h = struct.unpack("<HH", b[6:10])
            return {"format": "GIF", "width": w, "height": h, "mode": "P", "transparency": _gif_transparency(b)}
        if b[:2] == b"BM":
            w, h = struct.unpack("<ii", b[18:26])
            bpp = struct.unpack("<H", b[28:30])[0]
            return {"format": "BMP", "width": w, "height": abs(h), "mode": "RGBA" if bpp == 32 else "RGB"}
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            kind = b[12:16]
            if kind == b"VP8 ":
                w, h = struct.unpack("<HH", b[26:30])
                return {"format": "WEBP", "width": w & 0x3FFF, "height": h & 0x3FFF, "mode": "RGB"}
            if kind == b"VP8L":
                v = int.from_bytes(b[21:25], "little")
                alpha = (v >> 28) & 1
                return {"format": "WEBP", "width": (v & 0x3FFF) + 1, "height": ((v >> 14) & 0x3FFF) + 1,
                        "mode": "RGBA" if alpha else "RGB"}
            if kind == b"VP8X":
                w = int.from_bytes(b[24:27], "little") + 1
                h = int.from_bytes(b[27:30], "little") + 1
                return {"format": "WEBP", "width": w, "height": h, "mode": "RGBA" if b[20] & 0x10 else "RGB"}
        if b[:2] == b"\xff\xd8":
            i = 2
            while i + 9 < len(b):
                if b[i] != 0xFF:
                    i += 1
                    continue
                marker = b[i + 1]
                if marker in (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                    h, w = struct.unpack(">HH", b[i + 5:i + 9])
                    comps = b[i + 9] if i + 9 < len(b) else 3
                    return {"format": "JPEG", "width": w, "height": h,
                            "mode": {1: "L", 3: "RGB", 4: "CMYK"}.get(comps, "RGB")}
                if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
                    i += 2
                    continue
                i += 2 + struct.unpack(">H", b[i + 2:i + 4])[0]
            return {"error": "JPEG without frame header"}
    except struct.error as e:
        return {"error": f"truncated header: {e}"}
    return {"error": "cannot identify image file"}


def _header_batch(content: pd.Series) -> pd.DataFrame:
    rows = [_header_info(None if c is None else bytes(c)) for c in content]
    col = lambda k: [r.get(k) for r in rows]
    return pd.DataFrame({
        "format": pd.Series(col("format"), dtype="object"),
        "width": pd.array(col("width"), dtype="Int32"),
        "height": pd.array(col("height"), dtype="Int32"),
        "mode": pd.Series(col("mode"), dtype="object"),
        "transparency": pd.array([bool(r.get("transparency")) for r in rows], dtype="boolean"),
        "error": pd.Series(col("error"), dtype="object"),
    })


@functools.cache
def _header_udf():
    return F.pandas_udf(_header_batch, INFO_TYPE)


def header_info(content: Column) -> Column:
    """Header-level image info of a BINARY column (pandas UDF over Arrow batches)."""
    return _header_udf()(content)


def image_info(files: DataFrame) -> DataFrame:
    """``path, name, file_size`` plus header format, size, mode, transparency marker
    and error. Contents are read here if ``files`` is a listing without them."""
    files = files if "content" in files.columns else with_content(files)
    return files.select("path", "name", F.col("length").alias("file_size"),
                        header_info(F.col("content")).alias("info")).select(
        "path", "name", "file_size", "info.*")


#: Suffixes that the JVM readers decode, in any case.
DECODED_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".gif")


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """JVM-decoded pixels: ``name, width, height, nChannels, data`` (BGR order).

    Undecodable files are dropped by the source; join on ``name`` to flag them. The
    source hides names that start with ``_`` or ``.``: such files are copied to a
    scratch folder under a name with a letter before it, and decoded from there.
    """
    hidden = list_images(spark, [folder], DECODED_SUFFIXES, any_case=True).filter(F.substring("name", 1, 1).isin("_", "."))
    glob = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[bB][mM][pP],[gG][iI][fF]}"

    def read(path: str, name) -> DataFrame:
        found = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", glob).load(path)
        return found.select(name(F.regexp_extract("image.origin", r"([^/]*)$", 1)).alias("name"), "image.width", "image.height", "image.nChannels", "image.data")

    shown = read(folder, lambda n: n)
    if hidden.isEmpty():
        return shown
    staged = scratch_dir(spark, "hidden-images")
    write_files(with_content(hidden.select("path", F.concat(F.lit("h"), "name").alias("name"))), staged)
    return shown.unionByName(read(staged, lambda n: F.substring(n, 2, 1 << 20)))


def _ahash(data: bytes, w: int, h: int, c: int, n: int = 8) -> str | None:
    if data is None or w <= 0 or h <= 0:
        return None
    px = np.frombuffer(bytes(data), dtype=np.uint8).reshape(h, w, c).astype(np.float64)
    if c >= 3:  # BGR(A) -> luminance
        gray = 0.299 * px[:, :, 2] + 0.587 * px[:, :, 1] + 0.114 * px[:, :, 0]
    else:
        gray = px[:, :, 0]
    ys = np.linspace(0, h, n + 1).astype(int)
    xs = np.linspace(0, w, n + 1).astype(int)
    grid = np.array([[gray[ys[i]:max(ys[i + 1], ys[i] + 1), xs[j]:max(xs[j + 1], xs[j] + 1)].mean()
                      for j in range(n)] for i in range(n)])
    return "".join("1" if v > grid.mean() else "0" for v in grid.ravel())


def _ahash_batch(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
    return pd.Series([_ahash(d, int(w), int(h), int(c)) for d, w, h, c in zip(data, width, height, channels)])


@functools.cache
def _ahash_udf():
    return F.pandas_udf(_ahash_batch, "string")


def pixel_ahash(data, width, height, channels) -> Column:
    """64-bit average hash of decoded pixels: block means on an 8x8 grid.

    Self-consistent, but the shrink filter differs from other libraries, so
    stored hashes from other tools are not bit-compatible.
    """
    return _ahash_udf()(data, width, height, channels)


def hash_images(spark: SparkSession, folder: str) -> DataFrame:
    """``name, bits`` for every decodable image of a folder."""
    img = decoded(spark, folder)
    return img.select("name", pixel_ahash("data", "width", "height", "nChannels").alias("bits"))


def payload_b64(content: Column) -> Column:
    """Base64 text for a data URL (Spark inserts CRLF line breaks; removed here)."""
    return F.regexp_replace(F.base64(content), "[\\r\\n]", "")
