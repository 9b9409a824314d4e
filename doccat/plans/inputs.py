"""Catalogue inputs derived from the given tables.

The tables hold texts but no files, so paths, properties and index states are
worked out from their columns. The SQL texts read the same in Spark and in the
oracle; what the operators compute from them is written separately for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.config import PROPS_TYPE, Settings
from doccat.functions import props as B
from doccat.operators.metadata import derive_metadata
from doccat.operators.postings import TextIndex
from doccat.plans.ingest import with_ids
from doccat.session import shared_folder, spread
from doccat.sources.catalog import CatalogStore
from doccat.sources.commits import FULL

SETTINGS = Settings(inbox="inbox", manual="manualcheck")
AS_OF = "2024-02-29T12:30:45Z"
#: Parts to deal texts out to; a benchmark on tables of one row group sets it, nothing else does.
PARTITIONS: int | None = None

PATHS = """
SELECT doc_id, text, lang, source, n_chars,
 CASE doc_id % 8
 WHEN 0 THEN concat('/n/',ln,'_',fn,'_',dd,'.',mm,'.',yy,'/',y2,'-',mm,'-',dd,'_report ',doc_id,'.pdf')
 WHEN 1 THEN concat('/n/',ln,'_',fn,'_',dd,'.',mm,'.',yy,'/reports/letter ',doc_id,'.odt')
 WHEN 2 THEN concat('/inbox/',y2,'-',mm,'-',dd,'_',ln,'_',fn,'_',dd,'.',mm,'.',yy,'_note ',doc_id,'.pdf')
 WHEN 3 THEN concat('/inbox/',ln,'-',fn,'-',dd,'-',mm,'-',yy,'-note ',doc_id,'.pdf')
 WHEN 4 THEN concat('/inbox/',y2,'_',mm,'_',dd,'_',ln,'-',fn,'-',yy,'-',mm,'-',dd,'-note ',doc_id,'.pdf')
 WHEN 5 THEN concat('/inbox/',ln,'_',fn,'_',yy,'.',mm,'.',dd,'_note ',doc_id,'.pdf')
 WHEN 6 THEN concat('/inbox/scan ',doc_id,'.png')
 ELSE CASE WHEN doc_id % 16 = 15 THEN concat('/n/',ln,'_',fn,'_31.02.2000/',doc_id,'.pdf')
           ELSE concat('/misc/',source,'/',doc_id,'.tar.gz') END END AS path
FROM (SELECT *, concat('Name',doc_id % 97) AS ln, concat('First',doc_id % 13) AS fn,
  lpad(cast(1+doc_id % 28 AS STRING),2,'0') AS dd, lpad(cast(1+doc_id % 12 AS STRING),2,'0') AS mm,
  cast(1930+doc_id % 80 AS STRING) AS yy, cast(2015+doc_id % 9 AS STRING) AS y2 FROM documents) p
"""

# The extracted properties of each file, one column per key.
PROPS = """
SELECT p.*,
 CASE WHEN doc_id % 8 = 1 THEN 'application/vnd.oasis.opendocument.text' WHEN doc_id % 8 = 6 THEN 'image/png'
      WHEN doc_id % 16 = 7 THEN 'application/gzip' ELSE 'application/pdf' END AS p_type,
 doc_id % 24 = 15 AS p_two_types,
 CASE WHEN doc_id % 9 = 0 THEN 'ocrmypdf 14.0' WHEN doc_id % 9 = 1 THEN 'Writer' END AS p_tool,
 CASE doc_id % 4 WHEN 0 THEN ' Untitled ' WHEN 2 THEN concat('Report ', doc_id) WHEN 3 THEN '' END AS p_title,
 CASE WHEN doc_id % 10 = 3 THEN '2010-04-02T14:49:43Z' END AS p_date,
 CASE WHEN doc_id % 3 = 0 THEN concat(2000 + doc_id % 20, '-01-15T10:00:00Z') END AS p_created,
 CASE WHEN doc_id % 3 = 1 THEN concat(2001 + doc_id % 20, '-02-16T11:00:00Z') END AS p_meta_created,
 CASE WHEN doc_id % 5 <> 0 THEN concat(2002 + doc_id % 20, '-03-17T12:00:00Z') END AS p_modified,
 CASE WHEN doc_id % 2 = 0 THEN 'Some title' END AS p_dc_title
FROM catalog_paths p
"""

CHANGES = """
SELECT e.event_id AS seq, e.ts, d.path,
 CASE e.event_type WHEN 'error' THEN 'unlink' WHEN 'view' THEN 'change' ELSE 'add' END AS op,
 e.event_type
FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS doc_id FROM events) e
JOIN catalog_paths d ON d.doc_id = e.doc_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def paths_of(documents: DataFrame) -> DataFrame:
    return documents.sparkSession.sql(PATHS.replace("FROM documents", "FROM {documents}"), documents=documents)


def props_of(paths: DataFrame) -> DataFrame:
    return paths.sparkSession.sql(PROPS.replace("FROM catalog_paths", "FROM {paths}"), paths=paths)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture view: documents with a file path."""
    return paths_of(table(spark, sf_dir, "documents"))


# The property columns as one bag; page counts come under two spellings and in all shapes.
BAG = """map_filter(map(
 'Content-Type', CASE WHEN p_two_types THEN array(p_type, 'application/octet-stream') ELSE array(p_type) END,
 'pdf:charsPerPage', CASE WHEN doc_id % 4 < 2 THEN {chars} END,
 'pdf_charsPerPage', CASE WHEN doc_id % 4 >= 2 THEN {chars} END,
 'xmp:CreatorTool', CASE WHEN doc_id % 2 = 0 THEN array(p_tool) END,
 'xmp_CreatorTool', CASE WHEN doc_id % 2 = 1 THEN array(p_tool) END,
 'title', array(p_title), 'date', array(p_date), 'Creation-Date', array(p_created),
 'meta:creation-date', array(p_meta_created), 'Last-Modified', array(p_modified),
 'dc:title', array(p_dc_title), 'language', array(lang)),
 (k, v) -> v IS NOT NULL AND (size(v) = 0 OR v[0] IS NOT NULL))""".format(
    chars="""CASE doc_id % 6 WHEN 1 THEN cast(array() AS array<string>) WHEN 2 THEN array(string(n_chars % 250))
  WHEN 3 THEN array(string(doc_id % 130), string(n_chars % 140)) WHEN 4 THEN array('n/a')
  WHEN 5 THEN array(concat(n_chars % 250, ' chars')) END"""
)


def with_bag(props: DataFrame) -> DataFrame:
    """``path, extracted, supplied`` rows."""
    columns = [c for c in props.columns if not c.startswith("p_")]
    return props.select(
        *columns, F.expr(BAG).alias("extracted"), F.create_map().cast(PROPS_TYPE).alias("supplied")
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with extracted properties and nothing supplied."""
    return with_bag(props_of(paths(spark, sf_dir)))


def labelled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the labels as supplied properties."""
    labels = table(spark, sf_dir, "labels")
    entries = {
        "quality": F.col("quality").cast("string"),
        "concern": F.when(F.col("toxic") == 1, "Labelled"),
        "language": F.when(F.col("quality") == 0, "xx"),
        "id": F.when(F.col("quality").isNotNull(), "supplied ids are ignored"),
    }
    supplied = B.put_all(F.create_map().cast(PROPS_TYPE), entries)
    joined = files(spark, sf_dir).join(labels, "doc_id", "left")
    return joined.withColumn("supplied", supplied).drop("quality", "toxic")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of all documents, with ``doc_id`` and the columns they came from."""
    derived = derive_metadata(files(spark, sf_dir), as_of(), "watcher", SETTINGS)
    return derived.withColumns(
        {"checksum": F.md5(F.col("text").cast("binary")), "deleted": F.lit(None).cast("string")}
    ).drop("text")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_ids(paths(spark, sf_dir), SETTINGS).select("id", F.col("text").alias("contents"))
    return spread(rows, PARTITIONS, "id")


def index(spark: SparkSession, sf_dir: str) -> TextIndex:
    return TextIndex(texts(spark, sf_dir))


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TextIndex]:
    """Catalogue and term index as a search finds them: written once per session, in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        folder = shared_folder(spark, "stored")
        CatalogStore(spark, f"{folder}/catalog").write(catalog(spark, sf_dir), FULL)
        TextIndex.write(texts(spark, sf_dir), f"{folder}/index")
        _STORED[key] = folder
    folder = _STORED[key]
    return CatalogStore(spark, f"{folder}/catalog").read(), TextIndex.read(spark, f"{folder}/index")


def index_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files on disk and a catalogue that has fallen behind: ``id, doc_id, path, checksum``."""
    text_hash = F.md5(F.col("text").cast("binary"))
    on_disk = with_ids(paths(spark, sf_dir), SETTINGS).select("id", "doc_id", "path", text_hash.alias("checksum"))
    known = on_disk.where("doc_id % 5 <> 0").withColumn(
        "checksum",
        F.when(F.col("doc_id") % 11 == 0, F.lit(None))
        .when(F.col("doc_id") % 7 == 0, F.reverse("checksum"))
        .otherwise(F.col("checksum")),
    )
    gone = paths(spark, sf_dir).where("doc_id % 50 = 0").select(
        "doc_id", F.concat(F.lit("/gone"), "path").alias("path"), text_hash.alias("checksum")
    )
    return on_disk, known.unionByName(with_ids(gone, SETTINGS))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change feed over the files."""
    sql = (
        CHANGES.replace("FROM events", "FROM {events}")
        .replace("JOIN catalog_paths", "JOIN {paths}")
        .replace("FROM documents", "FROM {documents}")
    )
    documents = table(spark, sf_dir, "documents")
    feed = spark.sql(sql, events=table(spark, sf_dir, "events"), paths=paths_of(documents), documents=documents)
    return as_feed(feed)


def as_feed(feed: DataFrame) -> DataFrame:
    return with_ids(feed, SETTINGS).withColumn(
        "checksum", F.when(F.col("op") != "unlink", F.md5(F.concat_ws("|", "path", F.col("seq").cast("string")).cast("binary")))
    )


def on_disk(files: DataFrame, root: str) -> int:
    """Write ``text`` of each row to its ``path`` below ``root``, or remove the file where text is null; gives their number."""

    def write(batches):
        import re

        import pyarrow as pa
        from pyarrow import fs

        scheme, host, rest = re.match(r"(?s)^(?:(\w+):(//[^/]*)?)?(/.*)$", root).groups()
        store, base = (fs.LocalFileSystem(), "") if scheme in (None, "file") else fs.FileSystem.from_uri(f"{scheme}:{host or '//'}/")
        top = base.rstrip("/") + rest
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())  # one at a time, as bytes: a batch is not copied as a whole
            for path, text in zip(batch.column("path"), texts, strict=True):
                where = top + path.as_py()
                if not text.is_valid:
                    store.delete_file(where)
                    continue
                store.create_dir(where.rpartition("/")[0], recursive=True)
                with store.open_output_stream(where, compression=None) as file:
                    file.write(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return files.select("path", "text").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
