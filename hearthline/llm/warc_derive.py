"""WARC derivatives: a metadata and a plain-text conversion record per response.

Both records refer to the response by its record id and keep its target, date,
source headers and digests; the metadata record lists title and links, the
conversion record holds the text. Links are those of anchors, in double, single or
no quotes. Identifiers follow from the response's id, so a
repeated run or a lost executor gives the same records.

A null payload is empty; null headers, digests, dates and targets are left out. A
null record id leaves the records without WARC-Refers-To. Repeated responses give
repeated records. Further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
#: The version line, line ends and record end of the format.
VERSION, EOL, RECORD_END = "WARC/1.1", "\r\n", "\r\n\r\n"

# Comments, scripts and styles that are never closed reach to the end, so each is read once.
_HIDDEN = (
    "(?is)<!--.*?(?:-->|\\z)|<(script|style)\\b[^>]*(?:>.*?(?:</\\1\\s*>|\\z)|\\z)"
    "|<(noscript|template|head)\\b[^>]*>.*?</\\2\\s*>"
)
#: The value of an anchor's own href, with its quotes if it has some.
_HREF = "(?i)<a\\s(?:[^<>]*?\\s)?href\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'<>]+)"
_BLOCK = "(?i)</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|article|section|header|footer|nav|main|aside|body|html|blockquote|pre|hr|form)\\b[^>]*>"
_TAG = "<[a-zA-Z/!?][^>]*>"
#: Named characters, the ampersand last.
_NAMED = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"),
    ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"),
)


def uuid_of(*parts: Column) -> Column:
    """A record id that follows from ``parts``."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _numeric(text: Column) -> Column:
    """Character references by number; those of no character stay."""
    def one(piece: Column) -> Column:
        code = F.regexp_extract(piece, "^(x[0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        number = F.when(code.startswith("x"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).try_cast("int")
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        # An ampersand takes its named form, which is decoded last and once.
        char = F.when(number == 38, "&amp;").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.when(valid, F.concat(char, F.substr(piece, F.char_length(code) + 2))).otherwise(F.concat(F.lit("&#"), piece))

    def whole(bound: Column) -> Column:
        pieces = F.split(bound, "&#")
        rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.when(F.contains(bound, F.lit("&#")), F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(rest, one), ""))).otherwise(bound)

    # Bound as an element, so that the text is made once and not once per branch.
    return F.get(F.transform(F.array(text), whole), F.lit(0))


def _unescaped(text: Column) -> Column:
    for name, char in _NAMED:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.replace(_numeric(text), F.lit("&amp;"), F.lit("&"))


def plain_text(html: Column) -> Column:
    """Visible text: blocks on lines of their own, single spaces, no empty lines."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _HIDDEN, " "), _BLOCK, "\n"), _TAG, "")
    text = F.regexp_replace(text, "[\\x20\\t\\r\\f\\x0B]+", " ")
    return F.btrim(_unescaped(F.regexp_replace(text, " ?\n[ \n]*", "\n")), F.lit(" \n"))


def responses_of(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Captured pages (page_id, url, html) as response records."""
    html = F.coalesce("html", F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit(EOL))
    return pages.select("page_id", F.col("url").alias("target_uri"), html.alias("payload"), header.alias("http_header")).select(
        "*",
        uuid_of(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("target_uri", F.lit(""))).alias("record_id"),
        F.lit(date).alias("date"),
        digest(F.col("payload")).alias("payload_digest"),
        digest(F.concat("http_header", F.lit(EOL), "payload")).alias("block_digest"),
    )


def _field(name: str, value: Column) -> Column:
    """A line of an optional field."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response (record_id, target_uri, date, http_header, payload, payload_digest, block_digest)."""
    payload = F.coalesce("payload", F.lit(""))
    quoted = lambda x: x.startswith('"') | x.startswith("'")
    links = F.transform(
        F.regexp_extract_all(payload, F.lit(_HREF), F.lit(1)), lambda x: F.when(quoted(x), F.substr(x, F.lit(2), F.char_length(x) - 2)).otherwise(x)
    )
    title = F.regexp_replace(F.regexp_extract(payload, "(?is)<title[^>]*>(.*?)</title", 1), "\\s+", " ")
    headers = F.filter(F.split(F.coalesce("http_header", F.lit("")), EOL), lambda x: x != "")
    lines = lambda name, items: F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"{name}: "), x, F.lit(EOL))), "")
    metadata = F.concat(
        _field("title", F.nullif(F.trim(_unescaped(title)), F.lit(""))),
        _field("source-payload-digest", F.col("payload_digest")),
        _field("source-block-digest", F.col("block_digest")),
        lines("source-header", headers),
        lines("outlink", F.transform(links, lambda x: F.regexp_replace(_unescaped(x), "[\\r\\n]+", " "))),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("mime"), metadata.alias("content")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("mime"), plain_text(payload).alias("content")),
    )
    kept = [c for c in responses.columns if c not in ("record_id", "target_uri", "date", "http_header", "payload", "payload_digest", "block_digest", "record_type", "refers_to")]
    rows = responses.select(*kept, F.col("record_id").alias("refers_to"), "target_uri", "date", "http_header", "payload_digest", "block_digest", F.explode(both).alias("r"))
    return rows.select(
        *kept,
        F.col("r.type").alias("record_type"),
        uuid_of(F.col("r.type"), F.coalesce("refers_to", F.lit("")), F.coalesce("target_uri", F.lit(""))).alias("record_id"),
        "refers_to",
        "target_uri",
        "date",
        F.col("r.mime").alias("content_type"),
        F.octet_length("r.content").cast("long").alias("content_length"),
        digest(F.col("r.content")).alias("block_digest"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.col("block_digest").alias("source_block_digest"),
        F.col("http_header").alias("source_header"),
        F.col("r.content").alias("content"),
    )


def record_text(records: DataFrame) -> DataFrame:
    """The record as it stands in a file, without the record end."""
    head = F.concat(
        F.lit(VERSION + EOL),
        _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", F.col("record_id")), _field("WARC-Refers-To", F.col("refers_to")),
        _field("WARC-Target-URI", F.col("target_uri")), _field("WARC-Date", F.col("date")), _field("WARC-Block-Digest", F.col("block_digest")),
        _field("Content-Type", F.col("content_type")), _field("Content-Length", F.col("content_length").cast("string")),
    )
    return records.select(F.concat(head, F.lit(EOL), F.col("content")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files below ``path``, one per task: the text sink's line end is the record end."""
    record_text(records).write.option("lineSep", RECORD_END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Header fields and content of the records of files that ``write_warc`` made.

    Files are split at version lines, so a content that holds one would be cut; such a
    row has ``whole`` false, as its length then differs from the one its header says.
    """
    raw = spark.read.option("lineSep", VERSION + EOL).text(path).where("value != ''")
    head, content = F.substring_index("value", EOL + EOL, 1), F.substr("value", F.instr("value", EOL + EOL) + 4)
    field = lambda name: F.nullif(F.regexp_extract(head, f"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))
    length = field("Content-Length").cast("long")
    return raw.select(
        field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target_uri"), field("WARC-Date").alias("date"), field("WARC-Block-Digest").alias("block_digest"),
        F.regexp_replace(content, "\r\n\r\n$", "").alias("content"), length.alias("content_length"),
    ).withColumn("whole", F.octet_length("content") == F.col("content_length"))
