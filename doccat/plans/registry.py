"""One query over the given tables for every operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doccat.config import Settings
from doccat.functions import metadata as M
from doccat.functions import paths as P
from doccat.functions import props as B
from doccat.functions import text as X
from doccat.operators import batch as OB
from doccat.operators import metadata as OM
from doccat.operators import postings as OP
from doccat.operators import routing as OR
from doccat.operators import search as Q
from doccat.operators import sync as OS
from doccat.operators import triage as OT
from doccat.operators.postings import TextIndex
from doccat.plans import inputs as I
from doccat.plans import reconcile as PR
from doccat.plans import search as PS
from doccat.plans.ingest import pending
from doccat.session import shared_folder
from doccat.sources import catalog as SC
from doccat.sources import files as SF
from doccat.sources import intake as SI
from doccat.sources import schema as SS
from doccat.sources import text as ST
from doccat.sources import watch as SW
from doccat.streaming import ingest as SG

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- sources and sinks ----------------------------------------------------------

@query
def scan_files(spark, sf):
    """The documents as files, read back."""
    root = shared_folder(spark, "files")
    I.on_disk(I.paths(spark, sf), root)
    return _read_back(SF.scan_files(spark, root), root)


def _rooted(root: str) -> Settings:
    return replace(I.SETTINGS, root=root.removeprefix("file://").removeprefix("file:"))


def _read_back(files: DataFrame, root: str) -> DataFrame:
    loc = P.location(P.strip_scheme(F.col("path")), _rooted(root))
    return files.select(loc.alias("loc"), "length", F.md5("content").alias("content_md5"))


@query
def stream_files(spark, sf):
    """The same tree as a stream of added files, run to its end."""
    root, out, checkpoint = (shared_folder(spark, n) for n in ("files", "stream-files", "checkpoint"))
    I.on_disk(I.paths(spark, sf), root)
    found = _read_back(SF.stream_files(spark, root, max_files=1000), root)
    run = (
        found.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(out)


@query
def list_files(spark, sf):
    rows = I.catalog(spark, sf)
    inbox = SF.list_files(rows, "inbox", pattern=r"note .*\.pdf$|^scan").withColumn("dir", F.lit("inbox"))
    people = SF.list_files(rows, "/n/", with_subdirs=True, pattern="Name1|_31").withColumn("dir", F.lit("n"))
    return inbox.unionByName(people)


@query
def intake_batch(spark, sf):
    turns = I.table(spark, sf, "conversations")
    filepath = F.when(F.col("turn") % 3 == 2, None).otherwise(
        F.concat(
            F.when(F.col("conv_id") % 10 == 0, "../").otherwise("incoming//"),
            "role", F.lit("/"), "conv_id", F.lit("_"), "turn", F.lit(".txt"),
        )
    )
    encoded = F.base64(F.col("text").cast("binary"))
    url_safe = F.rtrim(F.translate(encoded, "+/", "-_"), F.lit("="))
    requests = turns.select(
        "conv_id", "turn",
        F.create_map(F.lit("title"), "role", F.lit("filepath"), filepath).alias("metadata"),
        F.when(F.col("turn") % 2 == 0, encoded).otherwise(url_safe).alias("payload"),
    )
    judged = SI.intake_batch(requests, I.SETTINGS)
    return judged.select(
        "conv_id", "turn", "status", "path",
        F.md5("content").alias("content_md5"),
        B.first(F.col("supplied"), "origin").alias("origin"),
    )


def _labelled(spark, sf) -> DataFrame:
    """Ids of the labelled documents, with their labels."""
    ids = I.catalog(spark, sf).select("doc_id", "id")
    return I.table(spark, sf, "labels").join(ids, "doc_id")


@query
def upsert_documents(spark, sf):
    rows = I.catalog(spark, sf).select("id", "title", "checksum")
    title = F.concat(F.lit("Labelled "), "doc_id")
    docs = _labelled(spark, sf).select(
        F.when(F.col("doc_id") % 3 != 0, F.col("id")).alias("id"),
        title.alias("title"),
        F.md5(title.cast("binary")).alias("checksum"),
    )
    return OS.upsert_documents(rows, docs, order=("title",))


@query
def remove_documents(spark, sf):
    rows = I.catalog(spark, sf).select("doc_id", "id", "title")
    going = _labelled(spark, sf).where("toxic = 1 OR quality = 0").select("id")
    unknown = I.table(spark, sf, "benchmark").select(F.md5(F.col("text").cast("binary")).alias("id"))
    return OS.remove_documents(rows, going.union(unknown))


def _shaky_catalog(spark, sf) -> DataFrame:
    """A catalogue with double ids and rows without location."""
    rows = I.catalog(spark, sf)
    rows = rows.withColumn("loc", F.when(F.col("source") == "src3", None).otherwise(F.col("loc")))
    return rows.unionByName(rows.where("lang = 'de'"))


@query
def get_document(spark, sf):
    asked = _labelled(spark, sf).select("id")
    unknown = I.table(spark, sf, "benchmark").select(F.md5(F.col("text").cast("binary")).alias("id"))
    stored = I.paths(spark, sf).select("path", F.col("text").cast("binary").alias("content"))
    found = SI.get_document(_shaky_catalog(spark, sf), asked.union(unknown), stored, I.SETTINGS)
    return found.select("id", "status", "path", F.md5("content").alias("content_md5"))


@query
def get_metadata(spark, sf):
    asked = _labelled(spark, sf).select("id")
    unknown = I.table(spark, sf, "benchmark").select(F.md5(F.col("text").cast("binary")).alias("id"))
    found = SI.get_metadata(I.catalog(spark, sf), asked.union(unknown))
    return found.select("id", "status", "title", "concern", "loc")


@query
def archive_versions(spark, sf):
    on_disk, known = I.index_state(spark, sf)
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 400).cast("int"))
    replaced = OS.changed_files(on_disk, known)
    return OS.archive_versions(replaced, day).select("id", "version_name", "path", "archived_on", "checksum")


@query
def align_schema(spark, sf):
    spec = T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("language", T.ArrayType(T.StringType())),
            T.StructField("Word-Count", T.LongType()),
            T.StructField("date", T.TimestampType()),
            T.StructField("template", T.StringType()),
        ]
    )
    foreign = I.paths(spark, sf).select(
        F.col("doc_id").alias("id"),
        F.when(F.col("source") != "src5", F.col("lang")).alias("language"),
        F.when(F.col("doc_id") % 3 == 0, "many").otherwise(F.col("n_chars").cast("string")).alias("Word-Count"),
        F.concat(F.lit("2024-"), F.lpad((F.col("doc_id") % 14).cast("string"), 2, "0"), F.lit("-10")).alias("date"),
        "source",
    )
    return SS.align_schema(foreign, spec).select(
        F.col("id"), F.array_join("language", ",").alias("language"), F.col("Word-Count").alias("word_count"),
        F.date_format("date", "yyyy-MM-dd").alias("date_text"), "template",
        B.first(F.col("props"), "source").alias("extra_source"),
    )


@query
def extract_text(spark, sf):
    return ST.extract_text(I.table(spark, sf, "pages"), "html", True, I.PARTITIONS).select("page_id", "contents")


@query
def write_catalog(spark, sf):
    """Two commits, the second with only some rows, then what a reader sees."""
    rows = I.catalog(spark, sf).select("id", "title", "concern", "checksum", "deleted")
    store = SC.CatalogStore(spark, shared_folder(spark, "catalog"))
    store.write(rows, SC.FULL)
    store.write(rows.where("concern = 'inbox'").withColumn("title", F.concat(F.lit("2nd "), "title")))
    return store.read().select("id", "title", "concern", "checksum", "version")


@query
def json_result(spark, sf):
    return SI.json_result(Q.listing(_the(spark, sf)))


# --- metadata --------------------------------------------------------------------

def _over_paths(name: str, *columns: Callable[[Column], Column], names: tuple[str, ...] = ()) -> None:
    def run(spark, sf):
        out = [fn(F.col("path")).alias(n) for fn, n in zip(columns, names or (name,), strict=True)]
        return I.paths(spark, sf).select("doc_id", *out)

    QUERIES[name] = run


def _over_files(name: str, *columns: Callable[[], Column], names: tuple[str, ...] = ()) -> None:
    def run(spark, sf):
        out = [fn().alias(n) for fn, n in zip(columns, names or (name,), strict=True)]
        return I.files(spark, sf).select("doc_id", *out)

    QUERIES[name] = run


_over_paths("file_id", lambda p: P.file_id(F.concat(F.lit("file://"), p), I.SETTINGS))
_over_paths("location", lambda p: P.location(p, I.SETTINGS))
_over_paths("needs_conversion", P.needs_conversion)
_over_paths("concern", lambda p: M.concern(p, settings=I.SETTINGS))
_over_paths(
    "person_fields",
    *(lambda p, i=i: M.person_field(M.person_match(p), i) for i in (1, 2, 3)),
    names=("lastname", "firstname", "birthdate"),
)
_over_paths(
    "path_parts", P.dirname, P.basename, P.extension, P.stem, P.parent_name,
    names=("dirname", "basename", "extension", "stem", "parent"),
)
_over_files(
    "has_meta",
    lambda: B.has_meta(F.col("extracted"), "Content-Type", "pdf"),
    lambda: B.has_meta(F.col("extracted"), "xmp:CreatorTool", "ocrmypdf"),
    names=("is_pdf", "is_scanned"),
)
_over_files("needs_ocr", lambda: B.needs_ocr(F.col("extracted")))
_over_files("boilerplate_title", lambda: M.boilerplate_title(F.get(B.values(F.col("extracted"), "title"), 0)))
_over_files("document_date", lambda: M.document_date(F.col("extracted"), F.col("path")))
_over_files(
    "resolve_title", lambda: M.resolve_title(F.get(B.values(F.col("extracted"), "title"), 0), F.col("path"))
)


@query
def checksum(spark, sf):
    return I.paths(spark, sf).select("doc_id", M.checksum(F.col("text")).alias("checksum"))


@query
def visible(spark, sf):
    """Some folders and some file names get a leading dot first."""
    path = (
        F.when(F.col("source") == "src1", F.concat(F.lit("/.hidden"), "path"))
        .when(F.col("source") == "src2", F.concat(P.dirname(F.col("path")), F.lit("/."), P.basename(F.col("path"))))
        .otherwise(F.col("path"))
    )
    dotted = I.paths(spark, sf).select("doc_id", path.alias("path"))
    return dotted.select(
        "doc_id", P.visible(F.col("path")).alias("visible"), P.visible_name(F.col("path")).alias("visible_name")
    )


@query
def trim_contents(spark, sf):
    padded = F.concat(F.lit(" \t\n "), "text", F.lit(" \r\n ﻿"))
    return I.paths(spark, sf).select("doc_id", X.trim_space(padded).alias("contents"))


@query
def normalize_keys(spark, sf):
    tidy = I.files(spark, sf).select("doc_id", B.normalize_keys(F.col("extracted")).alias("props"))
    return tidy.select("doc_id", F.explode("props").alias("key", "list")).select(
        "doc_id", "key", F.array_join("list", "|").alias("value")
    )


@query
def merge_metadata(spark, sf):
    merged = I.labelled_files(spark, sf).select(
        "doc_id", B.merge_props(F.col("extracted"), F.col("supplied")).alias("props")
    )
    return merged.select("doc_id", F.explode("props").alias("key", "list")).select(
        "doc_id", "key", F.array_join("list", "|").alias("value")
    )


@query
def stamp(spark, sf):
    origin = F.when(F.col("source") == "src1", "REST API").when(F.col("source") == "src2", "watcher")
    moment = F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id"))
    return OM.stamp(I.paths(spark, sf), moment, origin).select("doc_id", "imported_at", "doctype", "origin")


@query
def display_metadata(spark, sf):
    bag = F.when(F.col("source") == "src1", B.put_all(F.col("props"), {"categories": F.col("lang")})).otherwise(
        F.col("props")
    )
    return OM.display_metadata(I.catalog(spark, sf).withColumn("props", bag))


@query
def patch_metadata(spark, sf):
    text = lambda prefix: F.concat(F.lit(prefix), F.col("doc_id").cast("string"))
    changes = F.create_map(
        F.lit("title"), text("New "),
        F.lit("categories"), F.when(F.col("toxic") == 1, F.concat(F.lit("[broken "), "doc_id", F.lit("]"))).otherwise(
            F.concat(F.lit('["lab","q'), "quality", F.lit('"]'))
        ),
        F.lit("_version_"), F.lit("17"),
    )
    patches = _labelled(spark, sf).select("id", changes.alias("changes"))
    patched = OM.patch_metadata(I.catalog(spark, sf).withColumn("version", F.lit(1)), patches, I.texts(spark, sf))
    return patched.select(
        "id", "title", "concern", "version",
        F.array_join(B.values(F.col("props"), "categories"), "|").alias("categories"),
        F.md5(F.col("contents").cast("binary")).alias("contents_md5"),
    )


@query
def derive_metadata(spark, sf):
    derived = OM.derive_metadata(I.labelled_files(spark, sf), I.as_of(), "REST API", I.SETTINGS)
    bag = F.col("props")
    return derived.select(
        "doc_id", "id", "loc", "concern", "lastname", "firstname", "birthdate", "title", "date_text",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date_utc"),
        "content_type", "imported_at", "doctype", "origin",
        B.first(bag, "Creation-Date").alias("creation_date"),
        B.first(bag, "dc_title").alias("dc_title"),
        B.first(bag, "dc:title").alias("dc_colon_title"),
        B.first(bag, "language").alias("language"),
        B.first(bag, "quality").alias("quality"),
    )


def _with_content(spark, sf) -> DataFrame:
    """Files with bytes; some cannot be read, some have no properties."""
    return I.files(spark, sf).withColumns(
        {
            "content": F.when(F.col("doc_id") % 13 != 0, F.col("text").cast("binary")),
            "extracted": F.when(F.col("doc_id") % 17 != 0, F.col("extracted")),
        }
    ).drop("text")


@query
def import_documents(spark, sf):
    done = OM.import_documents(_with_content(spark, sf), None, I.as_of(), "watcher", I.SETTINGS, I.PARTITIONS)
    return done.select(
        "doc_id", "id", "title", "concern", "convert", "ocr", "error", "checksum",
        F.md5(F.col("contents").cast("binary")).alias("contents_md5"),
    )


# --- routing -----------------------------------------------------------------------

@query
def route_inbox(spark, sf):
    return OR.route_inbox(I.paths(spark, sf).select("doc_id", "path"), I.SETTINGS).select("doc_id", "rule", "placed")


@query
def route_plan(spark, sf):
    return OR.route_plan(I.paths(spark, sf).select("doc_id", "path"), I.SETTINGS)


# --- search ------------------------------------------------------------------------

@query
def build_postings(spark, sf):
    postings = OP.build_postings(I.texts(spark, sf))
    return postings.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query
def build_postings_conversations(spark, sf):
    """The second text source."""
    turns = I.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("contents")
    )
    postings = OP.build_postings(turns)
    return postings.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query
def refresh_postings(spark, sf):
    """Labelled documents get a new text, toxic ones go."""
    changed, gone = _relabelled(spark, sf)
    after = OP.refresh_postings(OP.build_postings(I.texts(spark, sf)), changed, gone)
    return after.select("id", "term", "tf", "n_terms")


def _rows(spark, sf) -> DataFrame:
    return I.stored(spark, sf)[0]


def _index(spark, sf) -> OP.TextIndex:
    return I.stored(spark, sf)[1]


def _relabelled(spark, sf) -> tuple[DataFrame, DataFrame]:
    """New texts for the labelled documents, and the toxic ones as removed."""
    labels = _labelled(spark, sf)
    text = F.concat_ws(" ", F.lit("Quality is"), "quality")
    return labels.where("toxic = 0").select("id", text.alias("contents")), labels.where("toxic = 1").select("id")


@query
def append_postings(spark, sf):
    """A stored index after a later version: what it now finds."""
    path = shared_folder(spark, "index")
    OP.TextIndex.write(I.texts(spark, sf), path)
    changed, gone = _relabelled(spark, sf)
    found = OP.TextIndex.append(changed, path, gone).terms(["quality", "the", "is"])
    return found.select("id", "term", "tf", "n_terms")


@query
def match_terms(spark, sf):
    return Q.match_terms(_index(spark, sf), "the und")


@query
def match_terms_unindexed(spark, sf):
    """The same search straight on the texts, without a stored index."""
    return Q.match_terms(I.index(spark, sf), "the und")


@query
def match_bool(spark, sf):
    rows, index = I.stored(spark, sf)
    return Q.match_bool(
        must=(Q.match_terms(index, "the"), Q.match_prefix(rows, "name1", "concern")),
        should=(Q.match_terms(index, "and"),),
        must_not=(Q.match_terms(index, "with"),),
    )


@query
def match_field(spark, sf):
    rows = _rows(spark, sf)
    exact = Q.match_field(rows, "lastname", "Name5").withColumn("clause", F.lit("lastname"))
    words = Q.match_field(rows, "title", "REPORT nothing").withColumn("clause", F.lit("title"))
    return exact.unionByName(words)


def _with_authors(spark, sf) -> DataFrame:
    rows = _rows(spark, sf)
    author = F.concat(F.lit("Name"), F.col("doc_id") % 97, F.lit(" of "), "source")
    return rows.withColumn("props", B.put_all(F.col("props"), {"author": author}))


@query
def match_author_field(spark, sf):
    """A configured field that stands in the property bag only: by word, beginning and pattern."""
    rows = _with_authors(spark, sf)
    word = Q.match_field(rows, "author", "NAME5 nobody").withColumn("clause", F.lit("word"))
    start = Q.match_prefix(rows, "name9*", "author").withColumn("clause", F.lit("prefix"))
    return word.unionByName(start).unionByName(Q.match_wildcard(rows, "s?c2", "author").withColumn("clause", F.lit("wildcard")))


@query
def match_language(spark, sf):
    return Q.match_field(_rows(spark, sf), "language", "de")


@query
def match_range_created(spark, sf):
    low, high = (F.lit(d).cast("timestamp") for d in ("2008-06-01", "2014-12-31"))
    return Q.match_range(_rows(spark, sf), "Creation-Date", low, high)


@query
def match_prefix(spark, sf):
    fields = Q.match_prefix(_rows(spark, sf), "Name1*", "concern").withColumn("clause", F.lit("concern"))
    text = Q.match_prefix(_index(spark, sf), "thr").withColumn("clause", F.lit("contents"))
    return fields.unionByName(text)


@query
def match_wildcard(spark, sf):
    fields = Q.match_wildcard(_rows(spark, sf), "name?_first*", "concern").withColumn("clause", F.lit("concern"))
    text = Q.match_wildcard(_index(spark, sf), "th?t*n").withColumn("clause", F.lit("contents"))
    return fields.unionByName(text)


@query
def match_all(spark, sf):
    return Q.match_all(_index(spark, sf))


@query
def match_phrase(spark, sf):
    return Q.match_phrase(_index(spark, sf), "of the")


@query
def match_phrase_slop(spark, sf):
    return Q.match_phrase(_index(spark, sf), "with the and", slop=3)


@query
def match_range(spark, sf):
    low, high = (F.lit(d).cast("timestamp") for d in ("2010-01-01", "2016-06-30"))
    return Q.match_range(_rows(spark, sf), "date", low, high)


@query
def match_fuzzy(spark, sf):
    return Q.match_fuzzy(_index(spark, sf), "erheat", 2)


@query
def score_bm25(spark, sf):
    scores = Q.score_bm25(_index(spark, sf), "the reaux nicht", {"nicht": 2.0})
    return scores.select("id", F.round("score", 6).alias("score"))


@query
def score_bm25_top(spark, sf):
    return Q.top_ranked(Q.score_bm25(_index(spark, sf), "the reaux nicht"), 10)


def _asked(spark, sf) -> DataFrame:
    return I.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query
def search_batch(spark, sf):
    """Every benchmark text as a query of optional words."""
    return OB.search_batch(_index(spark, sf), OB.clauses_of(_asked(spark, sf)), 10)


@query
def search_batch_bool(spark, sf):
    """Short words of the benchmark texts are required, long ones forbidden; titles are searched for the same words."""
    size = F.length("term")
    occur = F.when(size <= 2, OB.MUST).when(size >= 9, OB.MUST_NOT).otherwise(OB.SHOULD)
    rows, index = I.stored(spark, sf)
    titles = TextIndex(rows.select("id", "title"), field="title")
    asked = _asked(spark, sf)
    kind = F.get(F.array(F.lit("report"), F.lit("letter"), F.lit("note")), (F.col("query_id") % 3).cast("int"))
    of_titles = OB.clauses_of(asked.withColumn("query", kind), field="title")
    return OB.match_batch([index, titles], OB.clauses_of(asked, occur=occur).unionByName(of_titles)).select(
        "query_id", "id", F.round("score", 6).alias("score")
    )


def _the(spark, sf) -> DataFrame:
    rows, index = I.stored(spark, sf)
    return Q.documents(rows, Q.match_terms(index, "the"))


@query
def search_filter(spark, sf):
    scores = Q.score_bm25(_index(spark, sf), "the and")
    late = F.col("date") >= F.lit("2015-01-01").cast("timestamp")
    found = PS.search(_rows(spark, sf), scores.select("id"), scores, filter=late, limit=25)
    return found.docs.select("id", "score", "date_text")


@query
def search_sorted(spark, sf):
    return Q.page(_the(spark, sf), limit=100).select("id", "concern", "title")


@query
def search_sort_spec(spark, sf):
    return Q.page(_the(spark, sf), "lastname desc", limit=100).select("id", "lastname")


@query
def search_page(spark, sf):
    return Q.page(_the(spark, sf), limit=20, offset=40).select("id", "concern", "title")


@query
def page_state(spark, sf):
    clicks = I.table(spark, sf, "events").select(
        "event_id",
        (F.col("event_id") % 300).alias("offset"),
        F.when(F.col("user_id") % 2 == 0, 20).otherwise(50).cast("bigint").alias("num"),
        F.when(F.col("event_type") == "view", "forward").when(F.col("event_type") == "click", "backward").alias("direction"),
    )
    return Q.page_state(clicks, F.lit(250)).select("event_id", "new_offset", "next_disabled", "back_disabled")


@query
def search_hits(spark, sf):
    return Q.hits(Q.match_terms(_index(spark, sf), "the und"))


@query
def search_facets(spark, sf):
    return Q.facets(_the(spark, sf), ["concern", "doctype", "language", "content_type"])


@query
def search_facets_top(spark, sf):
    return Q.facets(_the(spark, sf), ["lastname", "content_type"], limit=5)


@query
def search_facets_range(spark, sf):
    """Years of documents, and months of change out of the property bag."""
    day = lambda y, m=1: F.lit(f"{y}-{m:02}-01").cast("timestamp")
    edges = {"date": [day(y) for y in range(2001, 2024, 2)], "Last-Modified": [day(2010, m) for m in range(1, 13)]}
    return Q.facets(_the(spark, sf), ranges=edges)


@query
def search_facets_query(spark, sf):
    """Predicates beside the first values of a field, in one pass."""
    rows = _the(spark, sf)
    asked = {
        "reports": Q.field_is(rows, "title", "report"),
        "german": Q.field_is(rows, "language", "de"),
        "people": F.col("lastname").isNotNull(),
        "nobody": Q.field_is(rows, "lastname", "Nobody"),
    }
    return Q.facets(rows, ["content_type", "concern"], limit=3, queries=asked)


@query
def search_listing(spark, sf):
    return Q.listing(Q.returnable(_the(spark, sf)))


@query
def search_concern(spark, sf):
    return PS.search_concern(*I.stored(spark, sf), "the", "name1")


@query
def normalize_query(spark, sf):
    raw = I.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("lastname:"), "text")).otherwise(F.col("text")).alias("query"),
        F.when(F.col("conv_id") % 2 == 0, "lastname asc").alias("sort"),
        (F.col("turn") % 2 == 1).alias("is_object"),
    )
    return Q.normalize_query(raw).drop("is_object")


# --- keeping in step ---------------------------------------------------------------

@query
def new_files(spark, sf):
    on_disk, known = I.index_state(spark, sf)
    return OS.new_files(on_disk, known).select("id", "path")


@query
def changed_files(spark, sf):
    on_disk, known = I.index_state(spark, sf)
    return OS.changed_files(on_disk, known).select("id", "path")


@query
def deleted_files(spark, sf):
    on_disk, known = I.index_state(spark, sf)
    return OS.deleted_files(on_disk, known).select("id", "path")


@query
def pending_files(spark, sf):
    """New and changed files by one join, as the ingest uses them."""
    on_disk, known = I.index_state(spark, sf)
    return pending(on_disk, known).select("id", "path")


@query
def sync_plan(spark, sf):
    return OS.sync_plan(*I.index_state(spark, sf))


@query
def duplicate_ids(spark, sf):
    return OS.duplicate_ids(_shaky_catalog(spark, sf))


@query
def duplicate_content(spark, sf):
    return OS.duplicate_content(I.catalog(spark, sf).select("id", "checksum"))


@query
def settled_files(spark, sf):
    touched = I.table(spark, sf, "events").select("event_id", F.col("ts").alias("modification_time"))
    return OS.settled_files(touched, 1.5, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("event_id")


# --- streaming -----------------------------------------------------------------------

@query
def apply_changes(spark, sf):
    _, known = I.index_state(spark, sf)
    known = known.select("id", "path", "checksum").withColumns(
        {"last_ts": F.lit(None).cast("timestamp"), "last_seq": F.lit(None).cast("bigint")}
    )
    after = OS.apply_changes(known, I.changes(spark, sf).drop("event_type"))
    return after.select("id", "path", "checksum", "deleted", "last_seq")


def _stream(spark, sf, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of them: a pattern finds both."""
    one = I.table(spark, sf, name)
    return spark.readStream.schema(one.schema).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")


@query
def stream_changes(spark, sf):
    """The change feed as a stream into a stored catalogue."""
    documents = I.table(spark, sf, "documents")
    n = documents.agg(F.count("*").alias("n"))
    events = _stream(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "unlink").when(F.col("event_type") == "view", "change").otherwise("add")
    total = n.first()["n"]
    feed = events.withColumn("doc_id", F.col("event_id") % total).join(
        I.paths_of(documents).select("doc_id", "path"), "doc_id"
    )
    feed = I.as_feed(feed.select(F.col("event_id").alias("seq"), "ts", "path", op.alias("op")))
    store = SC.CatalogStore(spark, shared_folder(spark, "catalog"))
    SG.stream_changes(feed, store, shared_folder(spark, "checkpoint")).awaitTermination()
    return store.read().select("id", "path", "checksum", "last_seq")


@query
def stream_ingest(spark, sf):
    """All files streamed into a store that already holds some of them."""
    store = SC.CatalogStore(spark, shared_folder(spark, "catalog"))
    known = OM.import_documents(_with_content(spark, sf), None, I.as_of(), None, I.SETTINGS)
    store.write(OM.imported(known.where("source = 'src1'")))
    files = I.with_bag(I.props_of(I.paths_of(_stream(spark, sf, "documents")))).withColumn(
        "content", F.when(F.col("doc_id") % 13 != 0, F.col("text").cast("binary"))
    ).drop("text")
    SG.stream_ingest(files, store, shared_folder(spark, "checkpoint"), None, I.as_of(), I.SETTINGS).awaitTermination()
    return store.read().select(
        "doc_id", "id", "title", "origin", "checksum", F.md5(F.col("contents").cast("binary")).alias("contents_md5")
    )


@query
def stream_route(spark, sf):
    out = shared_folder(spark, "route")
    arriving = I.paths_of(_stream(spark, sf, "documents")).select("doc_id", "path")
    SG.stream_route(arriving, out, shared_folder(spark, "checkpoint"), I.SETTINGS).awaitTermination()
    return spark.read.schema(OR.route_plan(arriving, I.SETTINGS).schema).parquet(out)


# --- a collection that follows its files ------------------------------------------------

def _collection(spark) -> PR.Collection:
    folder = shared_folder(spark, "collection")
    return PR.Collection(spark, f"{folder}/tables", replace(I.SETTINGS, root=f"{folder}/files"), parts=8, buckets=8)


def _contents(to: PR.Collection) -> DataFrame:
    """What the tables hold, with the documents that a search finds."""
    index = to.index()
    hits = [Q.match_terms(index, w).withColumn(f"has_{w}", F.lit(True)) for w in ("the", "edited")]
    noted = to.versions().groupBy("id").agg(F.count(F.lit(1)).alias("archived"))
    rows = to.rows(tombstones=True).join(hits[0], "id", "left").join(hits[1], "id", "left").join(noted, "id", "left")
    return rows.select(
        "id", "loc", "concern", "title", "date_text", "origin", "checksum", "deleted", "version",
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_the", "has_edited")), F.coalesce("archived", F.lit(0).cast("bigint")).alias("archived"),
    )


@query
def rescan(spark, sf):
    """A folder of four fifths of the documents; then the rest is added, some are edited, some removed, and it is walked again."""
    to, rows = _collection(spark), I.paths(spark, sf)
    I.on_disk(rows.where("doc_id % 5 <> 0"), to.settings.root)
    PR.rescan(to, to.settings.root, as_of=I.as_of())
    edited = F.when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit(" edited"))).when(F.col("doc_id") % 5 == 0, F.col("text"))
    I.on_disk(rows.where("doc_id % 5 = 0 OR doc_id % 7 IN (1, 2)").withColumn("text", edited), to.settings.root)
    PR.rescan(to, to.settings.root, as_of=I.as_of())
    return _contents(to)


@query
def change_feed_on_catalog(spark, sf):
    """The events as a change feed over a full catalogue, with a third of the files edited meanwhile."""
    to, rows = _collection(spark), I.paths(spark, sf)
    I.on_disk(rows, to.settings.root)
    PR.rescan(to, to.settings.root, as_of=I.as_of())
    I.on_disk(rows.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" edited"))), to.settings.root)
    feed = I.changes(spark, sf).withColumn("ts", F.col("ts") + F.expr("interval 10 years"))
    PR.apply_feed(to, feed.withColumn("path", F.concat(F.lit(to.settings.root), "path")), as_of=I.as_of())
    return _contents(to)


def _walked(spark, sf, first: Callable, second: Callable) -> tuple[str, PR.Collection]:
    """The documents as files, walked; then a third edited and a third removed, and walked again."""
    to, rows = _collection(spark), I.paths(spark, sf)
    feed = shared_folder(spark, "feed")
    I.on_disk(rows, to.settings.root)
    SW.note_changes(spark, to.settings.root, feed, as_of=I.as_of())
    first(feed, to)
    edited = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" edited")))
    I.on_disk(rows.where("doc_id % 3 > 0").withColumn("text", edited), to.settings.root)
    SW.note_changes(spark, to.settings.root, feed, as_of=I.as_of())
    second(feed, to)
    return feed, to


@query
def stream_modified(spark, sf):
    """Additions, edits and removals as a stream that is stopped between two walks."""
    out, checkpoint = shared_folder(spark, "events"), shared_folder(spark, "checkpoint")

    def run(feed: str, to: PR.Collection) -> None:
        loc = P.location(P.strip_scheme(F.col("path")), _rooted(to.settings.root))
        events = SW.stream_noted(spark, feed).select(loc.alias("loc"), "op", "seq", "length")
        writer = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()

    _walked(spark, sf, run, run)
    return spark.read.parquet(out)


@query
def stream_follow(spark, sf):
    """A collection that follows the same stream."""
    checkpoint = shared_folder(spark, "checkpoint")

    def run(feed: str, to: PR.Collection) -> None:
        SG.stream_feed(SW.stream_noted(spark, feed), to, checkpoint, as_of=I.as_of()).awaitTermination()

    return _contents(_walked(spark, sf, run, run)[1])


@query
def import_errors(spark, sf):
    """Files that vanished or are too large give their reason and cost no other document anything."""
    root, rows = shared_folder(spark, "files"), I.paths(spark, sf)
    I.on_disk(rows.where("doc_id % 9 <> 4"), root)
    read = SF.read_files(rows.select("doc_id", F.concat(F.lit(root), "path").alias("path")), most_bytes=10_000)
    return read.select("doc_id", "length", F.md5("content").alias("checksum"), F.col("read_error").alias("error"))


# --- text recognition -------------------------------------------------------------------

@query
def triage_results(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 16
    runs = I.table(spark, sf, "events").select("event_id", F.when(k == 11, 130).otherwise(k).alias("code"))
    return OT.triage_results(runs)


@query
def triage_summary(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 16
    return OT.triage_summary(I.table(spark, sf, "events").select(F.when(k == 11, 130).otherwise(k).alias("code")))
