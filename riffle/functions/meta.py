"""Metadata, URLs, RTSP text and code tables as Column expressions. Ordered metadata is ``array<struct<k,v>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riffle.functions.bytesx import be, put_be

# Codec, media type, PID and stream id of each kind of media that can be carried.
CODECS = [("h264", "video/h264", 256, 27), ("h265", "video/h265", 256, 36), ("mjpeg", "video/x-motion-jpeg", 256, 136), ("pcm", "audio/pcm", 210, 192), ("adpcm", "audio/adpcm", 210, 193)]
# Names that a pipeline takes as codecs.
VALID_CODECS = ("pcm", "adpcm", "h264", "h264_au", "h265", "mjpeg", "jpeg")
# Number of each URL scheme; 1 stands for tunnelling over HTTP, 2 for encryption, 4 for SSL, 8 for RTMFP.
SCHEMES = {"rtmp": 0, "rtmpt": 1, "rtmpe": 2, "rtmpte": 3, "rtmps": 4, "rtmpts": 5, "rtmfp": 8}
# Base quantisation table of JPEG luminance in zigzag order.
LUMA = (16, 11, 12, 14, 12, 10, 16, 14, 13, 14, 18, 17, 16, 19, 24, 40, 26, 24, 22, 22, 24, 49, 35, 37, 29, 40, 58, 51, 61, 60, 57, 51, 56, 55, 64, 72, 92, 78, 64, 68, 87, 69, 55, 56, 80, 109, 81, 87, 95, 98, 103, 104, 103, 62, 77, 113, 121, 112, 100, 120, 92, 101, 103, 99)


def encoded_text(kv: Column) -> Column:
    return F.array_join(F.transform(kv, lambda e: F.concat(e["k"], F.lit("="), e["v"])), "\t")


def encoded(kv: Column) -> Column:
    """Bytes 00 10, the length, and ``k=v`` joined by tabs."""
    body = F.encode(encoded_text(kv), "UTF-8")
    return F.concat(F.unhex(F.lit("0010")), F.unhex(put_be(F.octet_length(body), 2)), body)


def upserted(kv: Column, key: Column, value: Column) -> Column:
    """An entry of the key keeps its place; a new key goes to the end."""
    entry = F.struct(key.alias("k"), value.alias("v"))
    return F.when(F.exists(kv, lambda e: e["k"] == key), F.transform(kv, lambda e: F.when(e["k"] == key, entry).otherwise(e))).otherwise(F.concat(kv, F.array(entry)))


def deleted(kv: Column, key: Column) -> Column:
    return F.filter(kv, lambda e: e["k"] != key)


def decoded(data: Column) -> tuple[Column, Column]:
    """The entries, null where there is an error, and the error: bad header, wrong length, or an entry that is not ``k=v``."""
    text = F.decode(F.substring(data, F.lit(5), F.lit(1 << 30)), "UTF-8")
    parts = F.transform(F.split(text, "\t"), lambda x: F.split(x, "="))
    err = F.when(F.octet_length(data) < 4, "too short").when(be(data, 0, 2) != 16, "not metadata").when(be(data, 2, 2) != F.octet_length(data) - 4, "wrong length").when(F.exists(parts, lambda p: F.size(p) != 2), "unexpected format")
    return F.when(err.isNull(), F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("k"), F.get(p, F.lit(1)).alias("v")))), err


def url_fields(url: Column) -> dict[str, Column]:
    """Of a streaming URL: protocol number, host, port, app and play path, or why there are none."""
    scheme = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    rest = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", 2)
    host = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    number = F.coalesce(*[F.when(scheme == s, n) for s, n in SCHEMES.items()])
    explicit = F.regexp_extract(host, r":(\d+)$", 1)
    app = F.regexp_extract(rest, "^/([^/]*)", 1)
    path = F.regexp_extract(rest, "^/[^/]+/(.*)$", 1)
    first = F.regexp_extract(path, "^([^/]*)", 1)
    joined = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    ext = F.regexp_extract(joined, r"(\.[^./]*)$", 1)
    stem = F.regexp_replace(joined, r"\.[^./]*$", "")
    prefixed = lambda p: F.when(F.startswith(stem, F.lit(p)), stem).otherwise(F.concat(F.lit(p), stem))
    play = F.when(ext.isin(".mp4", ".f4v"), prefixed("mp4:")).when(ext == ".mp3", prefixed("mp3:")).when(ext == ".flv", stem).otherwise(joined)
    play = F.when(query != "", F.concat(play, F.lit("?"), query)).otherwise(play)
    err = (
        F.when(number.isNull(), "unknown scheme").when(~F.startswith(rest, F.lit("/")), "invalid path").when((app == "") | (first == ""), "invalid elements").when((explicit == "") & (number.bitwiseAND(4) != 0), "ssl not implemented")
    )
    port = F.when(explicit != "", explicit.cast("int")).when(number.bitwiseAND(1) != 0, 80).otherwise(1935)
    fine = err.isNull()
    return {"protocol": F.when(fine, number), "host": F.when(fine, host), "port": F.when(fine, port), "app": F.when(fine, app), "playpath": F.when(fine, play), "err": err}


def rtsp_request(method: Column | str, cseq: Column, url: Column, headers: Column) -> Column:
    """The request text; headers are ``array<struct<k,v>>``."""
    method = F.lit(method) if isinstance(method, str) else method
    lines = F.concat(F.array(F.concat(method, F.lit(" "), url, F.lit(" RTSP/1.0")), F.concat(F.lit("CSeq: "), cseq.cast("string"))), F.transform(headers, lambda h: F.concat(h["k"], F.lit(": "), h["v"])))
    return F.concat(F.array_join(lines, "\r\n"), F.lit("\r\n\r\n"))


def rtsp_response(text: Column) -> dict[str, Column]:
    """Status and headers of a response; header values of one name are a list, in order."""
    lines = F.split(F.regexp_extract(text, "(?s)^(.*?)\r\n\r\n", 1), "\r\n")
    first = F.get(lines, F.lit(0))
    heads = F.transform(F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.transform(heads, lambda h: h["k"]))
    grouped = F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.transform(F.filter(heads, lambda h: h["k"] == n), lambda h: h["v"]).alias("value"))))
    status = F.regexp_extract(first, r"^RTSP/1\.0 (\d{3})( .*)?$", 1)
    return {"status": F.when(status != "", status.cast("int")), "reason": F.trim(F.regexp_extract(first, r"^RTSP/1\.0 \d{3} (.*)$", 1)), "headers": grouped, "err": F.when(status == "", "not an RTSP response")}


def quant_table(quality: Column) -> Column:
    """The luminance table scaled for a quality of 1 to 99."""
    q = F.greatest(F.lit(1), F.least(F.lit(99), quality))
    factor = F.when(q < 50, F.floor(5000 / q)).otherwise(200 - q * 2)
    return F.transform(F.array(*map(F.lit, LUMA)), lambda v: F.greatest(F.lit(1), F.least(F.lit(255), F.floor((v * factor + 50) / 100))).cast("int"))
