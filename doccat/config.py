"""Settings and fixed values shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- Fixed values: patterns, word lists, codes and formats -------------------

# Inbox naming rules, first match wins; each capture is named by its meaning.
ROUTING_RULES = (
    (
        r"(\d\d\d\d[\-_]\d\d[\-_]\d\d)[_\-]([^/]+?)[_\-\.\s]([^/]+?)[_\-\.\s](\d\d[\.\-_]\d\d[\.\-_]\d\d\d\d)[_\- ]?(.*)",
        "date,lastname,firstname,birthdate,title",
    ),
    (
        r"([^/]+?)[_\-\.\s]([^/]+?)[_\-\.\s](\d\d[\.\-_]\d\d[\.\-_]\d\d\d\d)[_\- ]?(.*)",
        "lastname,firstname,birthdate,title",
    ),
    (
        r"(\d\d\d\d[\-_]\d\d[\-_]\d\d)[_\-]([^/]+?)[_\-\.\s]([^/]+?)[_\-\.\s](\d\d\d\d[\.\-_]\d\d[\.\-_]\d\d)[_\- ]?(.*)",
        "date,lastname,firstname,birthdate,title",
    ),
    (
        r"([^/]+?)[_\-\.\s]([^/]+?)[_\-\.\s](\d\d\d\d[\.\-_]\d\d[\.\-_]\d\d)[_\- ]?(.*)",
        "lastname,firstname,birthdate,title",
    ),
)
CONCERN_PATTERN = r"([^/]+)_([^/]+)_(\d\d\.\d\d\.\d\d\d\d)"
CONCERN_FIELDS = ("lastname", "firstname", "birthdate")
LEADING_DATE_PATTERN = r"^(\d\d\d\d)[.\-_](\d\d)[.\-_](\d\d)[\-_\s].+"
INBOX_FOLDER = "aaa_inbox"
MANUAL_FOLDER = "aaa_manuell"
CONCERN_PREFIX_LENGTH = 1
DOCTYPE = "Inbox"
DEFAULT_CATEGORY = "General"
DISPLAY_FIELDS = ("title", "concern", "categories", "date", "content-type")
IMAGE_SUFFIXES = ("tiff", "tif", "png", "jpg", "jpeg", "gif", "bmp", "eps", "pcx", "pcd", "psd")
BOILERPLATE_TITLES = ("untitled", "pdfpreview", "polypoint", "rptcumd", "fast report document")
CREATION_DATE_KEYS = (
    "creation-Date",
    "Creation-Date",
    "meta_creation-date",
    "meta:creation-date",
    "last-modified",
    "Last-Modified",
    "last-save-date",
)
OCR_TEXT_THRESHOLD = 100
# Exit codes of the text-recognition tool, by what happens to the document.
REPLACED_CODES = (0, 10)
KEPT_CODES = (2, 4, 6, 8, 15)
ERROR_CODES = (1, 3, 5, 7, 9, 130)

# Whitespace as JavaScript's trim() and \s understand it.
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# Relevance ranking constants.
BM25_K1 = 1.2
BM25_B = 0.75

# Page sizes: web search form, string queries, structured queries.
WEB_LIMIT = 20
STRING_LIMIT = 100
DEFAULT_LIMIT = 10

_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()

# field, kind, multi-valued, searchable, returnable
# kinds: text = tokenised, string = exact, long, date
FIELDS = (
    ("Character_Count", "long", True, True, True),
    ("Content-Encoding", "text", True, True, True),
    ("Content-Language", "text", True, True, True),
    ("Content-type", "text", True, True, True),
    ("Creation-Date", "date", True, True, True),
    ("Last-Modified", "date", False, True, True),
    ("Word-Count", "long", False, True, True),
    ("X-Parsed-By", "text", True, True, True),
    ("addressee", "text", True, True, True),
    ("author", "text", True, True, True),
    ("birthdate", "string", False, True, True),
    ("categories", "text", True, True, True),
    ("checksum", "string", False, False, True),
    ("concern", "text", False, True, True),
    ("contents", "text", False, True, False),
    ("date", "date", False, True, True),
    ("dc_title", "text", False, True, True),
    ("dcterms_created", "date", True, True, True),
    ("dcterms_modified", "date", True, True, True),
    ("deleted", "string", False, True, True),
    ("description", "text", True, True, True),
    ("doctype", "string", False, True, True),
    ("filename", "text", False, False, True),
    ("firstname", "string", False, True, True),
    ("generator", "text", False, True, True),
    ("id", "string", False, True, True),
    ("imported_at", "string", False, False, True),
    ("language", "text", True, True, True),
    ("lastname", "string", False, True, True),
    ("lastupdate", "long", False, True, True),
    ("loc", "string", False, False, True),
    ("name", "text", True, True, True),
    ("subject", "text", True, True, True),
    ("template", "string", False, True, True),
    ("title", "text", False, True, True),
    ("url", "string", False, False, True),
    ("version", "long", False, False, False),
)
# --- End of fixed values -----------------------------------------------------

_TYPES = {"text": _S, "string": _S, "long": _L, "date": _TS}
FIELD_KINDS = {name: kind for name, kind, *_ in FIELDS}
SEARCHABLE = frozenset(name for name, _, _, searchable, _ in FIELDS if searchable)
NOT_SEARCHABLE = frozenset(FIELD_KINDS) - SEARCHABLE
RETURNABLE = frozenset(name for name, *_, returnable in FIELDS if returnable)
NOT_RETURNABLE = frozenset(FIELD_KINDS) - RETURNABLE
PROPS_TYPE = T.MapType(_S, T.ArrayType(_S))
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField(name, T.ArrayType(_TYPES[kind]) if multi else _TYPES[kind])
        for name, kind, multi, _, _ in FIELDS
        if name not in ("contents", "version")
    ]
)


@dataclass(frozen=True)
class Settings:
    """What a deployment chooses: where documents live and how names are read."""

    root: str = ""
    inbox: str = INBOX_FOLDER
    manual: str = MANUAL_FOLDER
    rules: tuple = ROUTING_RULES
    concern_pattern: str = CONCERN_PATTERN
    concern_fields: tuple = CONCERN_FIELDS
    concern_prefix_length: int = CONCERN_PREFIX_LENGTH
    doctype: str = DOCTYPE

    @property
    def base(self) -> str:
        return self.root.rstrip("/")
