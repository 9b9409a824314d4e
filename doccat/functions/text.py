"""Column expressions over text bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doccat.config import SPACE_CHARS

TOKEN_PATTERN = r"([\p{L}\p{M}\p{N}_]+)"

# Applied in this order: markup goes first, ``&amp;`` is decoded last.
HTML_STEPS = (
    (r"(?is)<(script|style)\b.*?</(script|style)\s*>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?s)<[^>]*>", " "),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r"\s+", " "),
)


def trim_space(text: Column) -> Column:
    """Trim every kind of whitespace, in one linear pass over each end."""
    return F.trim(text, F.lit(SPACE_CHARS))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks, digits and ``_``."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(1))


def html_to_text(html: Column) -> Column:
    for pattern, replacement in HTML_STEPS:
        html = F.regexp_replace(html, pattern, replacement)
    return trim_space(html)


#: How PDF, ZIP and Office, PNG, JPEG and gzip files begin, in hexadecimal.
BINARY_STARTS = ("25504446", "504B0304", "D0CF11E0", "89504E47", "FFD8FF", "1F8B")


def decode_text(content: Column, content_type: Column | None = None) -> Column:
    """UTF-8 bytes to whole text, NULs included; malformed bytes become the replacement character.

    Bytes that begin like a known binary format give null, unless the content type says that they are text.
    """
    start = F.hex(F.substring(content, 1, 4))
    binary = F.coalesce(start.rlike(f"^({'|'.join(BINARY_STARTS)})"), F.lit(False))
    if content_type is not None:
        binary = binary & ~F.coalesce(F.lower(content_type).rlike("^text/|html"), F.lit(False))
    return F.when(~binary, F.make_valid_utf8(content.cast("string")))


def lenient_base64(payload: Column) -> Column:
    """Decode base64 the forgiving way: skip foreign characters, accept the URL alphabet, stop at padding."""
    body = F.substring_index(payload, "=", 1)
    body = F.regexp_replace(F.translate(body, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    rest = F.length(body) % 4
    whole = F.when(rest == 1, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    padded = F.concat(whole, F.when(rest == 2, "==").when(rest == 3, "=").otherwise(""))
    return F.unbase64(padded)
