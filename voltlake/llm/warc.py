"""Derivatives of web archive records: metadata and plain-text conversion records.

A response record becomes two records that name it in ``WARC-Refers-To``: a metadata record
(title, language, length, digests, links out) and a conversion record with the page's
text. Both carry the source's own headers. Identifiers are made from content, so a rerun
gives the same files. Only built-in functions are used, and each page is read once.
"""

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Pages carry no time of their own.
FETCHED = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
BLOCK_TAGS = (
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul"
).split()
# Named references, and what numbers 128 to 159 mean on pages. No-break spaces are blanks.
NAMED = {name: chr(code).replace("\xa0", " ") for name, code in name2codepoint.items()} | {"apos": "'"}
WINDOWS = {
    code: bytes([code]).decode("cp1252") for code in range(128, 160) if code not in (129, 141, 143, 144, 157)
}

# Patterns mean the same to Java and to RE2. What is opened and never closed goes to the end.
# One pattern for all that is hidden: a comment's start inside a script is no comment.
_SPACES = "[ \\t\\r\\n\\f]"
HIDDEN = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(
    f"<{t}(?:{_SPACES}[^>]*)?>.*?(?:</{t}[^>]*>|\\z)" for t in ("script", "style", "noscript", "template")
)
HEAD = f"(?is)<head(?:{_SPACES}[^>]*)?>.*?(?:</head[^>]*>|<body[^>]*>)"
BREAK = f"(?i)</?(?:{'|'.join(BLOCK_TAGS)})(?:{_SPACES}[^>]*)?/?>"
TAG = "<[^>]*>"
# An attribute's value in double quotes, in single ones, or bare.
_VALUE = f"{_SPACES}*={_SPACES}*(\"[^\"]*\"|'[^']*'|[^ \\t\\r\\n\\f\"'>]+)"
LINK = f"(?i)<a(?:{_SPACES}[^>]*?)?{_SPACES}href{_VALUE}"
TITLE = "(?is)<title[^>]*>(.*?)</title"
LANG = f"(?i)<html(?:{_SPACES}[^>]*?)?{_SPACES}lang{_VALUE}"
DECIMAL = "^#[0-9]{1,7}$"
HEXADECIMAL = "^#[xX][0-9a-fA-F]{1,6}$"

# Headers that records state from columns of their own.
HEADERS = (
    ("WARC-Type", "warc_type"),
    ("WARC-Record-ID", "record_id"),
    ("WARC-Refers-To", "refers_to"),
    ("WARC-Target-URI", "target_uri"),
    ("WARC-Date", "warc_date"),
    ("WARC-Payload-Digest", "payload_digest"),
    ("WARC-Block-Digest", "block_digest"),
    ("Content-Type", "content_type"),
    ("Content-Length", "content_length"),
)


def _constant(table: dict) -> Column:
    """A map that Spark works out once, planning."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _character(code: Column) -> Column:
    """The character of a number; null where there is none."""
    valid = code.between(33, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return (
        F.when(code.between(1, 32) | (code == 160), " ")
        .when(code.between(128, 159), F.try_element_at(_constant(WINDOWS), code.cast("string")))
        .when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _reference(part: Column) -> Column:
    """What follows an ampersand, with the reference it begins with as a character."""
    name = F.substring_index(part, ";", 1)
    number = F.when(name.rlike(DECIMAL), F.substring(name, 2, 7).cast("int")).when(
        name.rlike(HEXADECIMAL), F.conv(F.substring(name, 3, 6), 16, 10).cast("int")
    )
    named = F.try_element_at(_constant(NAMED), name)
    character = F.when(F.startswith(name, F.lit("#")), _character(number)).otherwise(named)
    rest = F.substring(part, F.length(name) + 2, F.length(part))
    return F.when(
        F.contains(part, F.lit(";")) & (F.length(name) <= 10), F.concat(character, rest)
    )  # null where there is no such reference


def decoded(text: Column) -> Column:
    """Named and numeric character references as characters, each decoded once."""
    return F.array_join(
        F.transform(
            F.split(text, "&"),
            lambda part, i: F.when(i == 0, part).otherwise(
                F.coalesce(_reference(part), F.concat(F.lit("&"), part))
            ),
        ),
        "",
    )


def visible(html: Column) -> Column:
    """A page without comments, scripts, styles and templates."""
    return F.regexp_replace(html, HIDDEN, "")


def page_text(shown: Column) -> Column:
    """Text of a visible page's body: a line per block, blanks run together, no empty lines."""
    body = F.regexp_replace(F.regexp_replace(shown, HEAD, ""), f"{_SPACES}+", " ")
    lined = F.regexp_replace(F.regexp_replace(body, BREAK, "\n"), TAG, "")
    lined = F.regexp_replace(decoded(lined), " +", " ")
    return F.btrim(F.regexp_replace(lined, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def _value(written: Column) -> Column:
    """An attribute's value without its quotes and line ends, references decoded."""
    bare = F.when(
        written.rlike("^[\"']"), F.substring(written, F.lit(2), F.length(written) - 2)
    ).otherwise(written)
    return F.regexp_replace(decoded(bare), "[\\r\\n]", "")


def _sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from the hash of its parts."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(digest, a, n) for a, n in cuts)), F.lit(">")
    )


def _carried(headers: Column | None) -> Column:
    """Headers a record can hold: no names of its own columns, no line ends, no nulls."""
    empty = F.create_map().cast("map<string,string>")
    if headers is None:
        return empty
    own = [name.lower() for name, _ in HEADERS]
    named = F.map_filter(
        headers, lambda k, v: k.rlike("^[!-9;-~]+$") & ~F.lower(k).isin(own) & v.isNotNull()
    )
    return F.coalesce(F.transform_values(named, lambda _, v: F.regexp_replace(v, "[\\r\\n]+", " ")), empty)


def responses(pages: DataFrame, fetched: str = FETCHED, headers: Column | None = None) -> DataFrame:
    """Response records of pages (page_id, url, html), one per row.

    Null url or html are empty. The block is the page itself, so block and payload digest
    agree. Rows with the same page_id, url and html have the same identifier. ``headers``
    is a map of further source headers of each page; those that state what a record's own
    columns state, that are null or whose name is no token are left out.
    """
    url, html = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "html"))
    page = F.col("page_id").cast("bigint")
    key = F.coalesce(page.cast("string"), F.lit("null"))
    return pages.select(
        page.alias("page_id"),
        F.lit("response").alias("warc_type"),
        record_id(F.lit("response"), key, url, F.sha2(html, 256)).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"),
        # A line end would begin another header.
        F.regexp_replace(url, "[\\r\\n]", "").alias("target_uri"),
        F.lit(fetched).alias("warc_date"),
        F.lit("text/html").alias("content_type"),
        _sha256(html).alias("payload_digest"),
        _sha256(html).alias("block_digest"),
        F.octet_length(html).cast("bigint").alias("content_length"),
        _carried(headers).alias("headers"),
        html.alias("block"),
    )


def _fields(shown: Column) -> Column:
    """``application/warc-fields`` lines about a response."""
    title = F.regexp_replace(decoded(F.regexp_extract(shown, TITLE, 1)), f"{_SPACES}+", " ")
    links = F.regexp_extract_all(shown, F.lit(LINK), F.lit(1))
    lines = F.concat(
        F.array(
            F.concat(F.lit("title: "), F.btrim(title, F.lit(" "))),
            F.concat(F.lit("languages-declared: "), _value(F.regexp_extract(shown, LANG, 1))),
            F.concat(F.lit("sourceLength: "), F.col("content_length").cast("string")),
            F.concat(F.lit("sourceDigest: "), F.col("payload_digest")),
        ),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), _value(x))),
    )
    return F.concat(F.array_join(lines, CRLF), F.lit(CRLF))


KINDS = {
    "metadata": ("application/warc-fields", _fields),
    "conversion": ("text/plain", page_text),
}


def derivatives(source: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Derivative records of every response record, one of each of ``kinds``.

    A metadata record holds title, language, length, digest and links out, a conversion
    record the plain text. A page without text gets a conversion record with an empty
    block, a page without title, language or links a metadata record with those left empty.
    Headers of the source are carried over, extra columns are not. No responses give no
    records.
    """
    kept = ("page_id", "record_id", "target_uri", "warc_date", "payload_digest", "headers")
    shown = source.select(*kept, "content_length", visible(F.col("block")).alias("shown"))
    blocks = [(kind, *KINDS[kind]) for kind in kinds]
    made = F.array(
        *(
            F.struct(F.lit(kind).alias("kind"), F.lit(mime).alias("mime"), block(F.col("shown")).alias("block"))
            for kind, mime, block in blocks
        )
    )
    return shown.select(*kept, F.explode(made).alias("made")).select(
        "page_id",
        F.col("made.kind").alias("warc_type"),
        record_id(F.col("made.kind"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        F.col("made.mime").alias("content_type"),
        # The digest of what the record was made from.
        "payload_digest",
        _sha256(F.col("made.block")).alias("block_digest"),
        F.octet_length("made.block").cast("bigint").alias("content_length"),
        "headers",
        F.col("made.block").alias("block"),
    )


def serialized(records: DataFrame) -> DataFrame:
    """Each record as WARC 1.1 text: header lines, an empty line, the block."""
    # concat_ws leaves out nulls, and concat of a null is null.
    headers = [F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in HEADERS]
    carried = F.transform(F.map_entries("headers"), lambda h: F.concat(h["key"], F.lit(": "), h["value"]))
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), *headers, carried)
    return records.select(F.concat(head, F.lit(CRLF * 2), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Gzip files of records, each closed by the two empty lines the format asks for."""
    serialized(records).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Headers (a map) and block of the records in files of ``write_warc``.

    A record starts at a version line after two empty lines that a block of this module's
    records cannot hold: conversion text has no empty lines, metadata no empty values.
    """
    cut = "\\r\\n\\r\\n(?=WARC/1\\.1\\r\\nWARC-Type: )|\\r\\n\\r\\n\\z"
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.split("value", cut)).alias("r")).filter("r <> ''")
    at = F.locate(CRLF * 2, F.col("r"))
    head = F.substring("r", F.lit(len("WARC/1.1\r\n") + 1), at - len("WARC/1.1\r\n") - 1)
    pairs = F.transform(
        F.split(head, CRLF),
        lambda line: F.struct(
            F.substring_index(line, ": ", 1),
            F.substring(line, F.locate(": ", line) + 2, F.length(line)),
        ),
    )
    block = F.substring("r", at + 4, F.length("r"))
    return rows.select(F.map_from_entries(pairs).alias("headers"), block.alias("block"))
