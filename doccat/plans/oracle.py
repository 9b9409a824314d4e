"""The same results in plain SQL, written for another engine, to check every query against."""

from __future__ import annotations

from doccat.plans.inputs import CHANGES, PATHS, PROPS

CONCERN = r"([^/]+)_([^/]+)_(\d\d\.\d\d\.\d\d\d\d)"
LEADING = r"^\d{4}[.\-_]\d\d[.\-_]\d\d[\-_\s].+"
SPACES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)||chr(65279)"


def _date(text: str, form: str, out: str) -> str:
    return f"strftime(try_strptime({text}, '{form}'), '{out}')"


_BIRTH = _date(f"nullif(regexp_extract(path, '{CONCERN}', 3), '')", "%d.%m.%Y", "%Y%m%d")
_STEM = r"regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_BASE = "regexp_extract(path, '[^/]*$')"
_PARENT = "regexp_extract(path, '([^/]*)/[^/]*$', 1)"
_LEADING_DATE = _date(
    rf"regexp_replace({_BASE}, '^(\d{{4}}).(\d\d).(\d\d).*$', '\1-\2-\3')", "%Y-%m-%d", "%Y-%m-%d"
)
_TITLE = f"""CASE WHEN p_title IS NULL OR p_title = '' OR lower(trim(p_title)) IN
 ('untitled', 'pdfpreview', 'polypoint', 'rptcumd', 'fast report document') THEN {_STEM} ELSE p_title END"""
_DATE = f"""CASE WHEN p_date IS NOT NULL THEN p_date WHEN regexp_matches({_BASE}, '{LEADING}') THEN {_LEADING_DATE}
 ELSE coalesce(p_created, p_meta_created, p_modified) END"""
_TIME = "coalesce(try_strptime(date_text, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(date_text, '%Y-%m-%d'))"

# Documents as files, their properties, and the catalogue made of both.
FILES = f"catalog_paths AS ({PATHS}), files AS ({PROPS})"
CATALOG = f"""{FILES}, catalog AS (SELECT *, {_TIME} AS date FROM (
 SELECT doc_id, text, lang, source, n_chars, path, md5(path) AS id, substr(path, 2) AS loc,
  coalesce(nullif(regexp_extract(path, '{CONCERN}', 0), ''), {_PARENT}) AS concern,
  nullif(regexp_extract(path, '{CONCERN}', 1), '') AS lastname,
  nullif(regexp_extract(path, '{CONCERN}', 2), '') AS firstname,
  {_BIRTH} AS birthdate, {_TITLE} AS title, {_DATE} AS date_text, p_type AS content_type, 'Inbox' AS doctype,
  md5(text) AS checksum FROM files) c)"""
TOKENS = r"""tokens AS (SELECT id, unnest(list) AS term, generate_subscripts(list, 1) - 1 AS pos FROM
 (SELECT md5(path) AS id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS list FROM catalog_paths) t)"""
STATE = f"""{FILES}, on_disk AS (SELECT md5(path) AS id, doc_id, path, md5(text) AS checksum FROM catalog_paths),
 known AS (SELECT id, doc_id, path, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN reverse(checksum)
  ELSE checksum END AS checksum FROM on_disk WHERE doc_id % 5 <> 0
  UNION ALL SELECT md5('/gone' || path), doc_id, '/gone' || path, checksum FROM on_disk WHERE doc_id % 50 = 0)"""
BM25 = """stats AS (SELECT id, count(*) AS n_terms FROM tokens GROUP BY id),
 totals AS (SELECT count(*) AS n, avg(n_terms) AS avg_terms FROM stats),
 tfs AS (SELECT id, term, count(*) AS tf FROM tokens WHERE term IN ({terms}) GROUP BY id, term),
 dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
 scores AS (SELECT t.id, sum({weight} * ln(1 + (n - df + 0.5) / (df + 0.5))
   * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * n_terms / avg_terms))) AS score
  FROM tfs t JOIN dfs USING (term) JOIN stats s ON s.id = t.id CROSS JOIN totals GROUP BY t.id)"""


def _paths(select: str) -> str:
    return f"WITH {FILES} SELECT {select} FROM catalog_paths"


def _files(select: str) -> str:
    return f"WITH {FILES} SELECT {select} FROM files"


def _catalog(rest: str) -> str:
    return f"WITH {CATALOG}{rest}" if rest.startswith(",") else f"WITH {CATALOG} {rest}"


def _search(rest: str, more: str = "") -> str:
    return f"WITH {CATALOG}, {TOKENS}{', ' + more if more else ''} {rest}"


def _having(term: str) -> str:
    return f"(SELECT id FROM tokens WHERE term = '{term}')"


ORACLES: dict[str, str] = {}

# --- sources and sinks ------------------------------------------------------------

ORACLES["scan_files"] = _paths("substr(path, 2) AS loc, strlen(text) AS length, md5(text) AS content_md5")
ORACLES["stream_files"] = ORACLES["scan_files"]
ORACLES["list_files"] = _catalog(r"""SELECT DISTINCT 'inbox' AS dir, substr(loc, 7) AS name, false AS is_dir FROM catalog
 WHERE loc LIKE 'inbox/%' AND regexp_matches(substr(loc, 7), '(note .*\.pdf$)|(^scan)')
UNION ALL SELECT DISTINCT 'n', split_part(loc, '/', 2), true FROM catalog
 WHERE loc LIKE 'n/%' AND regexp_matches(split_part(loc, '/', 2), 'Name1|_31')""")
ORACLES["intake_batch"] = """SELECT conv_id, turn, CAST(CASE WHEN ok THEN 202 ELSE 400 END AS INTEGER) AS status,
 CASE WHEN ok THEN concat('/incoming/', role, '/', conv_id, '_', turn, '.txt') END AS path,
 CASE WHEN ok THEN md5(text) END AS content_md5, CASE WHEN ok THEN 'REST API' END AS origin
FROM (SELECT *, turn % 3 <> 2 AND conv_id % 10 <> 0 AS ok FROM conversations) c"""
ORACLES["upsert_documents"] = _catalog("""SELECT id, title, checksum FROM catalog
 WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0)
UNION ALL SELECT CASE WHEN doc_id % 3 <> 0 THEN id ELSE md5('{"title":"Labelled ' || doc_id || '","checksum":"' ||
  md5('Labelled ' || doc_id) || '"}') END, 'Labelled ' || doc_id, md5('Labelled ' || doc_id)
 FROM labels JOIN catalog USING (doc_id)""")
ORACLES["remove_documents"] = _catalog("""SELECT doc_id, id, title FROM catalog
 WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)""")
_ASKED = "asked AS (SELECT id FROM labels JOIN catalog USING (doc_id) UNION ALL SELECT md5(text) FROM benchmark)"
ORACLES["get_document"] = _catalog(f""", {_ASKED}, answered AS (SELECT a.id, c.path, c.text, CAST(CASE
  WHEN c.id IS NULL THEN 404 WHEN c.lang = 'de' THEN 500 WHEN c.source = 'src3' THEN 404 ELSE 200 END AS INTEGER) AS status
 FROM asked a LEFT JOIN catalog c ON c.id = a.id)
SELECT id, status, CASE WHEN status = 200 THEN path END AS path, CASE WHEN status = 200 THEN md5(text) END AS content_md5
FROM answered""")
ORACLES["get_metadata"] = _catalog(f""", {_ASKED}
SELECT a.id, CAST(CASE WHEN c.id IS NULL THEN 404 ELSE 200 END AS INTEGER) AS status, title, concern, loc
FROM asked a LEFT JOIN catalog c ON c.id = a.id""")
ORACLES["archive_versions"] = f"""WITH {STATE} SELECT f.id, concat(regexp_extract(f.path, '([^/]*)/[^/]*$', 1), '_',
  {_STEM.replace('path', 'f.path')}, '_', year(day), '-', month(day), '-', day(day),
  regexp_extract(regexp_extract(f.path, '[^/]*$'), '.(\\.[^.]*)$', 1)) AS version_name, f.path,
  strftime(day, '%Y-%m-%d') AS archived_on, f.checksum
FROM (SELECT *, CAST('2023-01-01' AS DATE) + CAST(doc_id % 400 AS INTEGER) AS day FROM on_disk) f JOIN known k ON k.id = f.id
WHERE k.checksum <> f.checksum"""
ORACLES["align_schema"] = """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN source <> 'src5' THEN lang END AS language,
 CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS word_count,
 CASE WHEN doc_id % 14 BETWEEN 1 AND 12 THEN concat('2024-', lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0'), '-10') END AS date_text,
 CAST(NULL AS VARCHAR) AS template, source AS extra_source FROM documents"""
_HTML = "html"
for _pattern, _by in (
    (r"<(script|style)\b.*?</(script|style)\s*>", " "),
    (r"<!--.*?-->", " "),
    (r"<[^>]*>", " "),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "''"),
    ("&amp;", "&"),
    (r"\s+", " "),
):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', '{_by}', 'gis')"
ORACLES["extract_text"] = f"SELECT page_id, trim({_HTML}) AS contents FROM pages"
ORACLES["write_catalog"] = _catalog("""SELECT id, CASE WHEN concern = 'inbox' THEN '2nd ' || title ELSE title END AS title,
 concern, checksum, CAST(CASE WHEN concern = 'inbox' THEN 1 ELSE 0 END AS BIGINT) AS version FROM catalog""")
ORACLES["json_result"] = _search(f"""SELECT concat('{{"id":"', id, '","title":"', title, '","concern":"', concern, '"}}') AS json
FROM catalog WHERE id IN {_having('the')}""")

# --- metadata ---------------------------------------------------------------------

ORACLES["file_id"] = _paths("doc_id, md5(path) AS file_id")
ORACLES["location"] = _paths("doc_id, substr(path, 2) AS location")
ORACLES["needs_conversion"] = _paths(
    "doc_id, regexp_matches(lower(path), '(tiff|tif|png|jpg|jpeg|gif|bmp|eps|pcx|pcd|psd)$') AS needs_conversion"
)
ORACLES["concern"] = _paths(f"doc_id, coalesce(nullif(regexp_extract(path, '{CONCERN}', 0), ''), {_PARENT}) AS concern")
ORACLES["person_fields"] = _paths(
    f"doc_id, nullif(regexp_extract(path, '{CONCERN}', 1), '') AS lastname, "
    f"nullif(regexp_extract(path, '{CONCERN}', 2), '') AS firstname, {_BIRTH} AS birthdate"
)
ORACLES["path_parts"] = _paths(
    rf"doc_id, regexp_replace(path, '/[^/]*$', '') AS dirname, {_BASE} AS basename, "
    rf"regexp_extract({_BASE}, '.(\.[^.]*)$', 1) AS extension, {_STEM} AS stem, {_PARENT} AS parent"
)
ORACLES["has_meta"] = _files(
    "doc_id, CASE WHEN NOT p_two_types THEN p_type LIKE '%pdf%' END AS is_pdf, p_tool LIKE '%ocrmypdf%' AS is_scanned"
)
_CHARS = """CASE doc_id % 6 WHEN 2 THEN n_chars % 250 WHEN 3 THEN greatest(doc_id % 130, n_chars % 140)
 WHEN 5 THEN n_chars % 250 ELSE 0 END"""
_OCR = f"NOT p_two_types AND p_type LIKE '%pdf%' AND coalesce(p_tool, '') NOT LIKE '%ocrmypdf%' AND {_CHARS} <= 100"
ORACLES["needs_ocr"] = _files(f"doc_id, {_OCR} AS needs_ocr")
ORACLES["boilerplate_title"] = _files("doc_id, doc_id % 4 <> 2 AS boilerplate_title")
ORACLES["document_date"] = _files(f"doc_id, {_DATE} AS document_date")
ORACLES["resolve_title"] = _files(f"doc_id, {_TITLE} AS resolve_title")
ORACLES["checksum"] = "SELECT doc_id, md5(text) AS checksum FROM documents"
ORACLES["visible"] = """SELECT doc_id, source NOT IN ('src1', 'src2') AS visible, source <> 'src2' AS visible_name
FROM documents"""
ORACLES["trim_contents"] = f"SELECT doc_id, trim(text, {SPACES}) AS contents FROM documents"
_BAG = """SELECT doc_id, 'Content-Type' AS key, CASE WHEN p_two_types THEN p_type || '|application/octet-stream' ELSE p_type END AS value FROM files
UNION ALL SELECT doc_id, {chars}, CASE doc_id % 6 WHEN 1 THEN '' WHEN 2 THEN concat(n_chars % 250)
  WHEN 3 THEN concat(doc_id % 130, '|', n_chars % 140) WHEN 4 THEN 'n/a' ELSE concat(n_chars % 250, ' chars') END FROM files WHERE doc_id % 6 > 0
UNION ALL SELECT doc_id, {tool}, p_tool FROM files WHERE p_tool IS NOT NULL
UNION ALL SELECT doc_id, 'title', p_title FROM files WHERE p_title IS NOT NULL
UNION ALL SELECT doc_id, 'date', p_date FROM files WHERE p_date IS NOT NULL
UNION ALL SELECT doc_id, 'Creation-Date', p_created FROM files WHERE p_created IS NOT NULL
UNION ALL SELECT doc_id, {meta}, p_meta_created FROM files WHERE p_meta_created IS NOT NULL
UNION ALL SELECT doc_id, 'Last-Modified', p_modified FROM files WHERE p_modified IS NOT NULL
UNION ALL SELECT doc_id, {title}, p_dc_title FROM files WHERE p_dc_title IS NOT NULL
UNION ALL SELECT doc_id, 'language', lang FROM files"""
ORACLES["normalize_keys"] = f"WITH {FILES} " + _BAG.format(
    chars="'pdf_charsPerPage'", tool="'xmp_CreatorTool'", meta="'meta_creation-date'", title="'dc_title'"
)
_RAW_BAG = _BAG.format(
    chars="CASE WHEN doc_id % 4 < 2 THEN 'pdf:charsPerPage' ELSE 'pdf_charsPerPage' END",
    tool="CASE WHEN doc_id % 2 = 0 THEN 'xmp:CreatorTool' ELSE 'xmp_CreatorTool' END",
    meta="'meta:creation-date'",
    title="'dc:title'",
)
ORACLES["merge_metadata"] = f"""WITH {FILES}, bag AS ({_RAW_BAG})
SELECT doc_id, key, CASE WHEN key = 'language' AND quality = 0 THEN 'xx' ELSE value END AS value FROM bag LEFT JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'quality', CAST(quality AS VARCHAR) FROM labels WHERE quality IS NOT NULL
UNION ALL SELECT doc_id, 'id', 'supplied ids are ignored' FROM labels WHERE quality IS NOT NULL
UNION ALL SELECT doc_id, 'concern', 'Labelled' FROM labels WHERE toxic = 1"""
ORACLES["stamp"] = """SELECT doc_id, strftime(make_timestamp((1700000000 + doc_id) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS imported_at,
 'Inbox' AS doctype, CASE source WHEN 'src1' THEN 'REST API' WHEN 'src2' THEN 'watcher' END AS origin FROM documents"""
ORACLES["display_metadata"] = _catalog("""SELECT id, 'title' AS key, title AS value FROM catalog
UNION ALL SELECT id, 'concern', concern FROM catalog
UNION ALL SELECT id, 'categories', CASE WHEN source = 'src1' THEN lang ELSE 'General' END FROM catalog
UNION ALL SELECT id, 'date', date_text FROM catalog WHERE date_text IS NOT NULL
UNION ALL SELECT id, 'content-type', content_type FROM catalog""")
ORACLES["patch_metadata"] = _catalog("""SELECT id, CASE WHEN quality IS NOT NULL THEN concat('New ', doc_id) ELSE title END AS title, concern,
 CAST(CASE WHEN quality IS NULL THEN 1 END AS INTEGER) AS version,
 CASE WHEN toxic = 1 THEN concat('Err: [broken ', doc_id, ']') WHEN quality IS NOT NULL THEN concat('lab|q', quality) END AS categories,
 CASE WHEN quality IS NOT NULL THEN md5(text) END AS contents_md5
FROM catalog LEFT JOIN labels USING (doc_id)""")
ORACLES["derive_metadata"] = _catalog("""SELECT doc_id, id, loc, CASE WHEN toxic = 1 THEN 'Labelled' ELSE concern END AS concern,
 CASE WHEN toxic = 1 THEN NULL ELSE lastname END AS lastname, CASE WHEN toxic = 1 THEN NULL ELSE firstname END AS firstname,
 CASE WHEN toxic = 1 THEN NULL ELSE birthdate END AS birthdate, title, date_text,
 strftime(date, '%Y-%m-%d %H:%M:%S') AS date_utc, content_type, '2024-02-29T12:30:45.000Z' AS imported_at, doctype,
 'REST API' AS origin, CASE WHEN doc_id % 10 = 3 THEN p_created ELSE date_text END AS creation_date,
 title AS dc_title, CASE WHEN p_dc_title IS NOT NULL THEN title END AS dc_colon_title,
 CASE WHEN quality = 0 THEN 'xx' ELSE lang END AS language, CAST(quality AS VARCHAR) AS quality
FROM catalog JOIN (SELECT doc_id, p_created, p_dc_title FROM files) f USING (doc_id) LEFT JOIN labels USING (doc_id)""")
ORACLES["import_documents"] = _catalog(f"""SELECT c.doc_id, id,
 CASE WHEN bag THEN title ELSE {_STEM} END AS title, concern,
 regexp_matches(lower(path), '(tiff|tif|png|jpg|jpeg|gif|bmp|eps|pcx|pcd|psd)$') AS convert, bag AND ocr AS ocr,
 CASE WHEN NOT readable THEN 'unreadable' WHEN NOT bag THEN 'no metadata' END AS error,
 CASE WHEN readable THEN checksum END AS checksum, CASE WHEN readable THEN md5(trim(text, {SPACES})) END AS contents_md5
FROM catalog c JOIN (SELECT doc_id, doc_id % 13 <> 0 AS readable, doc_id % 17 <> 0 AS bag, {_OCR} AS ocr FROM files) f USING (doc_id)""")

# --- routing ------------------------------------------------------------------------

# Each rule's names are cut out on their own; the view holds one rule per remainder.
_RULES = {
    2: (0, r"^(\d{4}-\d\d-\d\d)_([^_]+)_([^_]+)_(\d\d\.\d\d\.\d{4})_(.*)\.pdf$", r"\2_\3_\4", r"\1_\5"),
    3: (1, r"^([^-]+)-([^-]+)-(\d\d)-(\d\d)-(\d{4})-(.*)\.pdf$", r"\1_\2_\3.\4.\5", r"\6"),
    4: (2, r"^(\d{4})_(\d\d)_(\d\d)_([^-]+)-([^-]+)-(\d{4})-(\d\d)-(\d\d)-(.*)\.pdf$", r"\4_\5_\8.\7.\6", r"\1-\2-\3_\9"),
    5: (3, r"^([^_]+)_([^_]+)_(\d{4})\.(\d\d)\.(\d\d)_(.*)\.pdf$", r"\1_\2_\5.\4.\3", r"\6"),
}
_RULE = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {r[0]}" for k, r in _RULES.items()) + " END"
_PLACED = "CASE doc_id % 8 " + " ".join(
    f"WHEN {k} THEN concat('n/', regexp_replace({_BASE}, '{p}', '{folder}'), '/', "
    f"replace(regexp_replace({_BASE}, '{p}', '{name}'), ' ', '_'), '.pdf')"
    for k, (_, p, folder, name) in _RULES.items()
) + " END"
ORACLES["route_inbox"] = _paths(f"doc_id, CAST({_RULE} AS INTEGER) AS rule, {_PLACED} AS placed")
ORACLES["route_plan"] = _paths(f"""doc_id, path, CASE WHEN doc_id % 8 BETWEEN 2 AND 5 THEN 'move' WHEN doc_id % 8 = 6 THEN 'manual'
 ELSE 'index' END AS action, CASE WHEN doc_id % 8 BETWEEN 2 AND 5 THEN {_PLACED}
 WHEN doc_id % 8 = 6 THEN 'manualcheck/' || {_BASE} ELSE substr(path, 2) END AS destination""")

# --- search -------------------------------------------------------------------------

_POSTINGS = """SELECT id, 'contents' AS field, term, CAST(count(*) AS INTEGER) AS tf,
 CAST(any_value(n_terms) AS INTEGER) AS n_terms, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM tokens JOIN (SELECT id, count(*) AS n_terms FROM tokens GROUP BY id) n USING (id) GROUP BY id, term"""
ORACLES["build_postings"] = f"WITH {FILES}, {TOKENS} {_POSTINGS}"
ORACLES["build_postings_conversations"] = r"""WITH tokens AS (SELECT id, unnest(list) AS term, generate_subscripts(list, 1) - 1 AS pos FROM
 (SELECT concat(conv_id, '-', turn) AS id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS list FROM conversations) t) """ + _POSTINGS
ORACLES["refresh_postings"] = f"""WITH {FILES}, {TOKENS}, n AS (SELECT id, count(*) AS n_terms FROM tokens GROUP BY id),
 labelled AS (SELECT md5(path) AS id, quality, toxic FROM labels JOIN catalog_paths USING (doc_id))
SELECT id, term, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(n_terms) AS INTEGER) AS n_terms FROM tokens JOIN n USING (id)
 WHERE id NOT IN (SELECT id FROM labelled) GROUP BY id, term
UNION ALL SELECT id, unnest(['quality', 'is', CAST(quality AS VARCHAR)]), CAST(1 AS INTEGER), CAST(3 AS INTEGER) FROM labelled WHERE toxic = 0"""
ORACLES["append_postings"] = f"SELECT * FROM ({ORACLES['refresh_postings']}) r WHERE term IN ('quality', 'the', 'is')"
ORACLES["match_terms"] = f"WITH {FILES}, {TOKENS} SELECT DISTINCT id FROM tokens WHERE term IN ('the', 'und')"
ORACLES["match_terms_unindexed"] = ORACLES["match_terms"]
ORACLES["match_bool"] = _search(rf"""SELECT id FROM catalog WHERE id IN {_having('the')} AND id NOT IN {_having('with')}
 AND len(list_filter(regexp_extract_all(lower(concern), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda t: starts_with(t, 'name1'))) > 0""")
ORACLES["match_field"] = _catalog("""SELECT id, 'lastname' AS clause FROM catalog WHERE lastname = 'Name5'
UNION ALL SELECT id, 'title' FROM catalog
 WHERE list_has_any(regexp_extract_all(lower(title), '[\\p{L}\\p{M}\\p{N}_]+'), ['report', 'nothing'])""".replace("\\\\", "\\"))
ORACLES["match_author_field"] = _catalog("""SELECT id, 'word' AS clause FROM catalog WHERE doc_id % 97 = 5
UNION ALL SELECT id, 'prefix' FROM catalog WHERE doc_id % 97 = 9 OR doc_id % 97 >= 90
UNION ALL SELECT id, 'wildcard' FROM catalog WHERE source LIKE 's_c2'""")
ORACLES["match_language"] = _catalog("SELECT id FROM catalog WHERE lang = 'de'")
ORACLES["match_range_created"] = _catalog(f"""SELECT id FROM (
 SELECT id, {_TIME} AS created FROM (SELECT md5(path) AS id, CASE WHEN doc_id % 10 = 3 THEN p_created ELSE {_DATE} END AS date_text
  FROM files) f) c WHERE created BETWEEN TIMESTAMP '2008-06-01' AND TIMESTAMP '2014-12-31'""")
ORACLES["match_prefix"] = _search(r"""SELECT id, 'concern' AS clause FROM catalog
 WHERE regexp_matches(lower(concern), '(^|[^\p{L}\p{M}\p{N}_])name1')
UNION ALL SELECT DISTINCT id, 'contents' FROM tokens WHERE starts_with(term, 'thr')""")
ORACLES["match_wildcard"] = _search(r"""SELECT id, 'concern' AS clause FROM catalog
 WHERE regexp_matches(lower(concern), '(^|[^\p{L}\p{M}\p{N}_])name[\p{L}\p{M}\p{N}_]_first')
UNION ALL SELECT DISTINCT id, 'contents' FROM tokens WHERE term LIKE 'th_t%n'""")
ORACLES["match_all"] = f"WITH {FILES}, {TOKENS} SELECT DISTINCT id FROM tokens"
ORACLES["match_phrase"] = f"""WITH {FILES}, {TOKENS} SELECT DISTINCT a.id FROM tokens a JOIN tokens b
 ON b.id = a.id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'"""
ORACLES["match_phrase_slop"] = f"""WITH {FILES}, {TOKENS} SELECT DISTINCT a.id
FROM tokens a JOIN tokens b ON b.id = a.id AND b.term = 'the' AND b.pos - 1 BETWEEN a.pos - 3 AND a.pos + 3
JOIN tokens c ON c.id = a.id AND c.term = 'and' AND c.pos - 2 BETWEEN a.pos - 3 AND a.pos + 3
WHERE a.term = 'with' AND greatest(a.pos, b.pos - 1, c.pos - 2) - least(a.pos, b.pos - 1, c.pos - 2) <= 3"""
ORACLES["match_range"] = _catalog("SELECT id FROM catalog WHERE date BETWEEN TIMESTAMP '2010-01-01' AND TIMESTAMP '2016-06-30'")
# The engine counts bytes; a stand-in for each foreign letter makes it count letters.
ORACLES["match_fuzzy"] = rf"""WITH {FILES}, {TOKENS} SELECT DISTINCT id FROM tokens
 WHERE damerau_levenshtein(regexp_replace(term, '[^\x00-\x7F]', '#', 'g'), 'erheat') <= 2"""
_WEIGHTED = BM25.format(terms="'the', 'reaux', 'nicht'", weight="CASE WHEN term = 'nicht' THEN 2.0 ELSE 1.0 END")
ORACLES["score_bm25"] = f"WITH {FILES}, {TOKENS}, {_WEIGHTED} SELECT id, round(score, 6) AS score FROM scores"
_PLAIN = BM25.format(terms="'the', 'reaux', 'nicht'", weight="1.0")
ORACLES["score_bm25_top"] = f"""WITH {FILES}, {TOKENS}, {_PLAIN} SELECT id, round(score, 6) AS score FROM scores
ORDER BY round(score, 6) DESC, id LIMIT 10"""
ORACLES["search_filter"] = _search("""SELECT id, round(score, 6) AS score, date_text FROM catalog JOIN scores USING (id)
WHERE date >= TIMESTAMP '2015-01-01' ORDER BY round(score, 6) DESC, id LIMIT 25""", BM25.format(terms="'the', 'and'", weight="1.0"))
_THE = f"FROM catalog WHERE id IN {_having('the')}"
ORACLES["search_sorted"] = _search(f"SELECT id, concern, title {_THE} ORDER BY lower(concern), lower(title), id LIMIT 100")
ORACLES["search_sort_spec"] = _search(f"SELECT id, lastname {_THE} ORDER BY lastname DESC NULLS LAST, id LIMIT 100")
ORACLES["search_page"] = _search(f"SELECT id, concern, title {_THE} ORDER BY lower(concern), lower(title), id LIMIT 20 OFFSET 40")
ORACLES["page_state"] = """SELECT event_id, new_offset, new_offset > 250 AS next_disabled, new_offset < num AS back_disabled
FROM (SELECT event_id, num, CAST(CASE event_type WHEN 'view' THEN event_id % 300 + num
  WHEN 'click' THEN greatest(0, event_id % 300 - num) ELSE 0 END AS BIGINT) AS new_offset
 FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN 20 ELSE 50 END AS num FROM events) e) s"""
_ASKED = r"""asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS term FROM benchmark)"""


def _ranked(tokens: str, field: str) -> str:
    """Term frequencies and lengths of a field, with the BM25 part of each word of a document."""
    return f"""{field}_stats AS (SELECT id, count(*) AS n_terms FROM {tokens} GROUP BY id),
 {field}_totals AS (SELECT count(*) AS n, avg(n_terms) AS avg_terms FROM {field}_stats),
 {field}_tfs AS (SELECT id, term, count(*) AS tf FROM {tokens} GROUP BY id, term),
 {field}_dfs AS (SELECT term, count(*) AS df FROM {field}_tfs GROUP BY term),
 {field}_parts AS (SELECT t.id, t.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * n_terms / avg_terms)) AS part
  FROM {field}_tfs t JOIN {field}_dfs USING (term) JOIN {field}_stats s ON s.id = t.id CROSS JOIN {field}_totals)"""


ORACLES["search_batch"] = f"""WITH {FILES}, {TOKENS}, {_ASKED}, {_ranked('tokens', 'body')}
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(part), 6) AS score FROM asked JOIN body_parts USING (term) GROUP BY query_id, id) s) r WHERE rank <= 10"""
ORACLES["search_batch_bool"] = rf"""WITH {CATALOG}, {TOKENS}, {_ASKED}, {_ranked('tokens', 'body')},
 words AS (SELECT id, unnest(regexp_extract_all(lower(title), '[\p{{L}}\p{{M}}\p{{N}}_]+')) AS term FROM catalog), {_ranked('words', 'title')},
 clauses AS (SELECT query_id, term, CASE WHEN length(term) <= 2 THEN 'must' WHEN length(term) >= 9 THEN 'must_not' ELSE 'should' END AS occur FROM asked),
 hits AS (SELECT query_id, id, occur, part FROM clauses JOIN body_parts USING (term)
  UNION ALL SELECT item_id, id, 'should', part FROM benchmark JOIN title_parts
   ON term = CASE item_id % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'letter' ELSE 'note' END),
 needed AS (SELECT query_id, count(*) FILTER (occur = 'must') AS n_must FROM clauses GROUP BY query_id)
SELECT query_id, id, round(sum(part) FILTER (occur <> 'must_not'), 6) AS score FROM hits JOIN needed USING (query_id) GROUP BY query_id, id, n_must
HAVING count(*) FILTER (occur = 'must') = n_must AND count(*) FILTER (occur = 'must_not') = 0
 AND (n_must > 0 OR count(*) FILTER (occur = 'should') > 0)"""
ORACLES["search_hits"] = f"WITH {FILES}, {TOKENS} SELECT count(DISTINCT id) AS num_found FROM tokens WHERE term IN ('the', 'und')"
ORACLES["search_facets"] = _search(f"""SELECT field, value, count(*) AS n FROM (
 SELECT 'concern' AS field, concern AS value {_THE} UNION ALL SELECT 'doctype', doctype {_THE}
 UNION ALL SELECT 'language', lang {_THE} UNION ALL SELECT 'content_type', content_type {_THE}) f GROUP BY field, value""")
ORACLES["search_facets_top"] = _search(f"""(SELECT 'lastname' AS field, lastname AS value, count(*) AS n {_THE} AND lastname IS NOT NULL
 GROUP BY lastname ORDER BY n DESC, value LIMIT 5)
UNION ALL (SELECT 'content_type', content_type, count(*) AS n {_THE} GROUP BY content_type ORDER BY n DESC, content_type LIMIT 5)""")
_BY = f"""f.*, c.date, c.title, c.lastname, c.content_type, c.concern FROM catalog c JOIN (SELECT md5(path) AS id, lang, p_modified FROM files) f USING (id)
 WHERE id IN {_having('the')}"""
ORACLES["search_facets_range"] = _search("""SELECT e.field, strftime(low, '%Y-%m-%d %H:%M:%S') AS value, count(moment) AS n
FROM edges e LEFT JOIN times t ON t.field = e.field AND moment >= low AND moment < high GROUP BY e.field, low""", f"""found AS (SELECT {_BY}),
 edges AS (SELECT 'date' AS field, make_timestamp(y, 1, 1, 0, 0, 0) AS low, make_timestamp(y + 2, 1, 1, 0, 0, 0) AS high FROM range(2001, 2022, 2) r(y)
  UNION ALL SELECT 'Last-Modified', make_timestamp(2010, m, 1, 0, 0, 0), make_timestamp(2010, m + 1, 1, 0, 0, 0) FROM range(1, 12) r(m)),
 times AS (SELECT 'date' AS field, date AS moment FROM found UNION ALL SELECT 'Last-Modified', try_strptime(p_modified, '%Y-%m-%dT%H:%M:%SZ') FROM found)""")
ORACLES["search_facets_query"] = _search("""SELECT 'query' AS field, unnest(['reports', 'german', 'people', 'nobody']) AS value, unnest([
 count(*) FILTER (list_contains(regexp_extract_all(lower(title), '[a-z0-9_]+'), 'report')), count(*) FILTER (lang = 'de'), count(lastname), 0]) AS n FROM found
UNION ALL (SELECT 'content_type', content_type, count(*) AS n FROM found GROUP BY content_type ORDER BY n DESC, content_type LIMIT 3)
UNION ALL (SELECT 'concern', concern, count(*) AS n FROM found GROUP BY concern ORDER BY n DESC, concern LIMIT 3)""", f"found AS (SELECT {_BY})")
ORACLES["search_listing"] = _search(f"SELECT id, title, concern {_THE}")
ORACLES["search_concern"] = _search(rf"""SELECT id, title, concern {_THE}
 AND regexp_matches(lower(concern), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])name1') ORDER BY lower(concern), id LIMIT 20""")
ORACLES["normalize_query"] = """SELECT conv_id, turn, CASE WHEN instr(query, ':') = 0 THEN concat('contents:(', query, ')') ELSE query END AS query,
 CASE WHEN turn % 2 = 0 THEN 'concern asc,title asc' WHEN conv_id % 2 = 0 THEN 'lastname asc' END AS sort
FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN 'lastname:' || text ELSE text END AS query FROM conversations) c"""

# --- keeping in step -----------------------------------------------------------------

_NEW = "SELECT id, path FROM on_disk WHERE doc_id % 5 = 0"
_CHANGED = "SELECT f.id, f.path FROM on_disk f JOIN known k ON k.id = f.id WHERE k.checksum <> f.checksum"
ORACLES["new_files"] = f"WITH {STATE} {_NEW}"
ORACLES["changed_files"] = f"WITH {STATE} {_CHANGED}"
ORACLES["deleted_files"] = f"WITH {STATE} SELECT id, path FROM known WHERE path LIKE '/gone/%'"
ORACLES["pending_files"] = f"WITH {STATE} {_NEW} UNION ALL {_CHANGED}"
ORACLES["sync_plan"] = f"""WITH {STATE} SELECT coalesce(f.id, k.id) AS id, CASE WHEN k.id IS NULL THEN 'add' WHEN f.id IS NULL THEN 'remove'
 WHEN k.checksum <> f.checksum THEN 'update' ELSE 'keep' END AS action FROM on_disk f FULL JOIN known k ON k.id = f.id"""
ORACLES["duplicate_ids"] = _catalog("SELECT id, CAST(2 AS BIGINT) AS copies FROM catalog WHERE lang = 'de'")
ORACLES["duplicate_content"] = f"""WITH {FILES} SELECT md5(text) AS checksum, count(*) AS copies, min(md5(path)) AS keep_id
FROM catalog_paths GROUP BY md5(text) HAVING count(*) > 1"""
ORACLES["settled_files"] = "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-14 23:59:58.5'"

# --- streaming -------------------------------------------------------------------------

_LAST = f"""feed AS ({CHANGES}), last AS (SELECT md5(path) AS id, path, op, seq FROM
 (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS rn FROM feed) r WHERE rn = 1)"""
ORACLES["apply_changes"] = f"""WITH {STATE}, {_LAST} SELECT id, path, CASE WHEN op <> 'unlink' THEN md5(path || '|' || seq) END AS checksum,
 CASE WHEN op = 'unlink' THEN 'true' END AS deleted, seq AS last_seq FROM last
UNION ALL SELECT id, path, checksum, NULL, NULL FROM known WHERE id NOT IN (SELECT id FROM last)"""
ORACLES["stream_changes"] = f"""WITH {FILES}, {_LAST} SELECT id, path, md5(path || '|' || seq) AS checksum, seq AS last_seq
FROM last WHERE op <> 'unlink'"""
ORACLES["stream_ingest"] = _catalog(f"""SELECT doc_id, id, title, CASE WHEN source = 'src1' AND doc_id % 17 <> 0 THEN NULL ELSE 'watcher' END AS origin,
 checksum, md5(trim(text, {SPACES})) AS contents_md5 FROM catalog WHERE doc_id % 13 <> 0""")
ORACLES["stream_route"] = ORACLES["route_plan"]

# --- a collection that follows its files -------------------------------------------------


def _followed(origin: str, seen: str, more: str = "") -> str:
    """Rows of documents as ``seen`` leaves them: ``now`` (text, null if removed), ``version``, ``archived``, ``origin``."""
    date = f"CASE WHEN regexp_matches({_BASE}, '{LEADING}') THEN {_LEADING_DATE} END"
    found = "coalesce(list_contains(regexp_extract_all(lower(now), '[\\p{L}\\p{M}\\p{N}_]+'), '%s'), false)"
    return f"""WITH {FILES}{more}, seen AS ({seen})
SELECT md5(path) AS id, substr(path, 2) AS loc, coalesce(nullif(regexp_extract(path, '{CONCERN}', 0), ''), {_PARENT}) AS concern,
 {_STEM} AS title, {date} AS date_text, {origin} AS origin, md5(held) AS checksum,
 CASE WHEN now IS NULL THEN 'true' END AS deleted, CAST(version AS BIGINT) AS version,
 {found % 'the'} AS has_the, {found % 'edited'} AS has_edited, CAST(archived AS BIGINT) AS archived FROM seen"""


ORACLES["rescan"] = _followed("CAST(NULL AS VARCHAR)", """SELECT path,
 CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 2 THEN NULL WHEN doc_id % 7 = 1 THEN text || ' edited' ELSE text END AS now,
 CASE WHEN doc_id % 7 = 1 THEN text || ' edited' ELSE text END AS held,
 CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 1 THEN 2 ELSE 1 END AS version,
 CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 = 1 THEN 1 ELSE 0 END AS archived FROM catalog_paths""")
ORACLES["change_feed_on_catalog"] = _followed("origin", """SELECT path, origin, CASE WHEN op = 'unlink' THEN NULL ELSE held END AS now, held, version, archived FROM (
 SELECT p.path, op, CASE WHEN changed THEN 'watcher' END AS origin, CASE WHEN changed THEN text || ' edited' ELSE text END AS held,
  CASE WHEN changed THEN 2 ELSE 1 END AS version, CASE WHEN changed THEN 1 ELSE 0 END AS archived
 FROM (SELECT c.*, l.op, coalesce(l.op <> 'unlink', false) AND doc_id % 3 = 0 AS changed FROM catalog_paths c LEFT JOIN last l ON l.id = md5(c.path)) p) r""",
    f", {_LAST}")
ORACLES["stream_modified"] = _paths("""substr(path, 2) AS loc, 'add' AS op, CAST(1 AS BIGINT) AS seq, strlen(text) AS length FROM catalog_paths
UNION ALL SELECT substr(path, 2), CASE doc_id % 3 WHEN 1 THEN 'change' ELSE 'unlink' END, CAST(2 AS BIGINT),
 CASE doc_id % 3 WHEN 1 THEN strlen(text) + 7 END""") + " WHERE doc_id % 3 > 0"
ORACLES["stream_follow"] = _followed("'watcher'", """SELECT path, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || ' edited' END AS now,
 CASE doc_id % 3 WHEN 1 THEN text || ' edited' ELSE text END AS held, CASE doc_id % 3 WHEN 1 THEN 2 ELSE 1 END AS version,
 CASE doc_id % 3 WHEN 1 THEN 1 ELSE 0 END AS archived FROM catalog_paths""")
ORACLES["import_errors"] = f"""WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 9 <> 4 THEN strlen(text) END AS length,
 CASE WHEN doc_id % 9 <> 4 AND strlen(text) <= 10000 THEN md5(text) END AS checksum,
 CASE WHEN doc_id % 9 = 4 THEN 'vanished' WHEN strlen(text) > 10000 THEN 'too large' END AS error FROM catalog_paths"""

# --- text recognition --------------------------------------------------------------------

_RUNS = """(SELECT event_id, CASE WHEN k % 16 = 11 THEN 130 ELSE k % 16 END AS code FROM
 (SELECT event_id, CAST(regexp_extract(props, '\\d+') AS INTEGER) AS k FROM events) e) r""".replace("\\\\", "\\")
_OUTCOME = "CASE WHEN code IN (0, 10) THEN 'replaced' WHEN code IN (2, 4, 6, 8, 15) THEN 'kept' ELSE 'error' END"
ORACLES["triage_results"] = f"SELECT event_id, code, {_OUTCOME} AS outcome, code NOT IN (12, 13, 14) AS known_code FROM {_RUNS}"
ORACLES["triage_summary"] = f"SELECT {_OUTCOME} AS outcome, code, count(*) AS n FROM {_RUNS} GROUP BY code"
