"""WARC derivative builder.

Each response record becomes a *metadata* record (source status, headers,
digests, title, links) and a *conversion* record (plain text). Both carry
WARC-Refers-To with the response's record id, its target URI and date, and block
digests of their own. Everything is a DataFrame expression: no Python runs on
the executors, nothing is shuffled, and each record is made from its own row.

Cases: a null page body is an empty payload; a null URL gives records without a
target URI; a null id gives records with a null source_id; repeated rows each get
their records, with equal ids; rows with one id and different pages have different
record ids where their URLs differ; a very long page is one value in its row's task;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"

#: What turns a page into text, in this order; valid for Java and RE2 alike.
DROPPED = r"(?is)<!--.*?-->|<script[^>]*>.*?</script[^>]*>|<style[^>]*>.*?</style[^>]*>|<title[^>]*>.*?</title[^>]*>"
BREAKS = r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|body|html|head)(?:[ \t\r\n/][^>]*)?>"
TAGS = r"<[^>]*>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))
BLANKS, LINES = r"[ \t\r\f]+", r" ?\n[ \n]*"

#: DROPPED and LINES with the same result and less work: one sign decides where a match can start (once blanks are single).
DROPPED_FROM_SIGN = r"(?is)<(?:!--.*?-->|script[^>]*>.*?</script[^>]*>|style[^>]*>.*?</style[^>]*>|title[^>]*>.*?</title[^>]*>)"
LINES_FROM_END = r"\n[ \n]+"

TITLE = r"(?is)<title[^>]*>(.*?)</title"
LINK = r"(?i)<a[^>]* href=[\"']([^\"']*)[\"']"


def plain_text(html: Column) -> Column:
    """Visible text of a page, a line for each block."""
    c = F.regexp_replace(html, DROPPED_FROM_SIGN, "")
    c = F.regexp_replace(F.regexp_replace(c, BREAKS, "\n"), TAGS, "")
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(c, BLANKS, " "), F.lit(" \n"), F.lit("\n")), LINES_FROM_END, "\n"), F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """A urn:uuid that follows from the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Raw pages as response records: source_id, record_id, target_uri, warc_date, http_header, payload, payload_digest, block_digest."""
    p = pages.select(F.col(id_col).cast("long").alias("source_id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF + CRLF))
    p = p.withColumns({"record_id": record_id(F.lit("response"), F.col("source_id").cast("string"), F.col("target_uri")), "warc_date": F.lit(date), "http_header": header, "payload_digest": digest(F.col("payload"))})
    return p.withColumn("block_digest", digest(F.concat("http_header", "payload")))


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record."""
    title = F.trim(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), r"[ \t\r\n\f]+", " "), F.lit(" \n"))
    field = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit(CRLF))
    metadata = F.concat(
        field("source-status", F.regexp_extract("http_header", r"^HTTP/[0-9.]+ ([0-9]+)", 1)),
        field("source-content-type", F.regexp_extract("http_header", r"\nContent-Type: ([^\r\n]*)", 1)),
        field("source-content-length", F.regexp_extract("http_header", r"\nContent-Length: ([^\r\n]*)", 1)),
        field("source-block-digest", F.col("block_digest")),
        field("source-payload-digest", F.col("payload_digest")),
        field("title", title),
        field("outlinks", F.array_join(F.regexp_extract_all("payload", F.lit(LINK), 1), " ")),
    )
    base = records.select("source_id", "target_uri", "warc_date", F.col("record_id").alias("refers_to"), F.col("payload_digest").alias("source_payload_digest"), F.col("block_digest").alias("source_block_digest"), F.col("http_header").alias("source_http_header"), metadata.alias("m"), plain_text(F.col("payload")).alias("t"))
    kind = lambda name, content_type, block: F.struct(F.lit(name).alias("warc_type"), F.lit(content_type).alias("content_type"), F.col(block).alias("block"))
    out = base.withColumn("r", F.explode(F.array(kind("metadata", "application/warc-fields", "m"), kind("conversion", "text/plain; charset=utf-8", "t"))))
    return out.select("source_id", F.col("r.warc_type"), record_id(F.col("r.warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "warc_date", F.col("r.content_type"), F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), "source_payload_digest", "source_block_digest", "source_http_header", F.col("r.block").alias("block"))


def record_text(df: DataFrame) -> DataFrame:
    """Derived records as they stand in a file, without the two line ends that close one: column record.

    The payload of a derived record is its block; the response's digests have headers of their own.
    """
    lines = [F.lit("WARC/1.1"), *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))) for name, c in (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "block_digest"), ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")))]
    return df.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), F.col("block")).alias("record"))


def write_records(df: DataFrame, path: str) -> None:
    """Write derived records as WARC files, compressed part by part."""
    record_text(df).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file's bytes."""
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", start)) >= 0:
        head = dict(x.split(": ", 1) for x in data[start:end].decode("utf-8", "replace").split(CRLF)[1:] if ": " in x)
        at = end + 4 + int(head.get("Content-Length", 0))
        yield head, data[end + 4 : at]


def read_records(spark, path: str) -> DataFrame:
    """Records of WARC files: type, record id, refers-to, target URI, date and block; a file is the unit of work, and is held whole (files of up to 2 GB)."""
    import zlib

    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "content_type": "Content-Type"}

    def inflate(data: bytes) -> bytes:
        out = []
        while data[:2] == b"\x1f\x8b":
            d = zlib.decompressobj(31)
            out.append(d.decompress(data))
            data = d.unused_data
        return b"".join(out) or data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = [([h.get(n) for n in names.values()], block) for h, block in split_records(inflate(data))]
                cols = [pa.array([r[0][k] for r in rows], pa.string()) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in rows], pa.binary())], names=[*names, "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", block binary")


def _oracle() -> str:
    """The derived records in DuckDB's SQL, written from the same fixed patterns."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    crlf = "chr(13) || chr(10)"
    text = f"regexp_replace(regexp_replace(regexp_replace(payload, {q(DROPPED)}, '', 'g'), {q(BREAKS)}, chr(10), 'g'), {q(TAGS)}, '', 'g')"
    for name, sign in ENTITIES:
        text = f"replace({text}, {q(name)}, {q(sign)})"
    text = f"trim(regexp_replace(regexp_replace({text}, {q(BLANKS)}, ' ', 'g'), {q(LINES)}, chr(10), 'g'), ' ' || chr(10))"
    uuid = lambda x: f"'<urn:uuid:' || substr(md5({x}), 1, 8) || '-' || substr(md5({x}), 9, 4) || '-' || substr(md5({x}), 13, 4) || '-' || substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12) || '>'"
    title = f"trim(regexp_replace(regexp_extract(payload, {q(TITLE)}, 1), '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ' || chr(10))"
    meta = " || ".join(f"{q(name + ': ')} || {c} || {crlf}" for name, c in (("source-status", "'200'"), ("source-content-type", "'text/html; charset=utf-8'"), ("source-content-length", "CAST(strlen(payload) AS VARCHAR)"), ("source-block-digest", "source_block_digest"), ("source-payload-digest", "source_payload_digest"), ("title", title), ("outlinks", f"array_to_string(regexp_extract_all(payload, {q(LINK)}, 1), ' ')")))
    return f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS source_id, url AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, {uuid("concat_ws('|', 'response', CAST(source_id AS VARCHAR), target_uri)")} AS refers_to,
  'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(payload) || {crlf} || {crlf} AS source_http_header FROM p),
d AS (SELECT *, 'sha256:' || sha256(payload) AS source_payload_digest, 'sha256:' || sha256(source_http_header || payload) AS source_block_digest FROM r),
k AS (SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {meta} AS block FROM d
  UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {text} FROM d)
SELECT source_id, warc_type, {uuid("concat_ws('|', warc_type, refers_to)")} AS record_id, refers_to, target_uri, '{DATE}' AS warc_date, content_type,
  CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, source_payload_digest, source_block_digest, source_http_header, block FROM k"""


ORACLE = _oracle()
