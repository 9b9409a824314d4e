"""Metadata derivation: files and extracted properties in, catalogue rows out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.config import DEFAULT_CATEGORY, DISPLAY_FIELDS, Settings
from doccat.functions import metadata as M
from doccat.functions import paths as P
from doccat.functions import props as B
from doccat.functions import text as X
from doccat.operators.sync import upsert_documents
from doccat.session import spread


def stamp(df: DataFrame, as_of: Column | None = None, origin: str | Column | None = None,
          settings: Settings = Settings()) -> DataFrame:
    """Import time, document type and where the document came from."""
    moment = F.current_timestamp() if as_of is None else as_of
    return df.withColumns(
        {
            "imported_at": F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
            "doctype": F.lit(settings.doctype),
            "origin": origin if isinstance(origin, Column) else F.lit(origin).cast("string"),
        }
    )


def derive_metadata(files: DataFrame, as_of: Column | None = None, origin: str | Column | None = None,
                    settings: Settings = Settings()) -> DataFrame:
    """Add the catalogue fields to rows of ``path, extracted, supplied``.

    One narrow pass in four projections: merged bag, then the regex match that
    name fields share, then the fields, then the bag with the results put back.
    """
    path, bag, match = F.col("path"), F.col("props"), F.col("_person")
    given = B.first(bag, "concern")
    merged = files.withColumn("props", B.merge_props(F.col("extracted"), F.col("supplied"))).drop(
        "extracted", "supplied"
    )
    matched = stamp(merged, as_of, origin, settings).withColumn(
        "_person", F.when(given.isNull(), M.person_match(path, settings))
    )
    fields = {
        "id": P.file_id(path, settings),
        "concern": F.coalesce(given, match, P.parent_name(path)),
        "loc": P.location(P.strip_scheme(path), settings),
        "date_text": M.document_date(bag, path),
        "title": M.resolve_title(F.get(B.values(bag, "title"), 0), path),
        "content_type": B.first_of(bag, ("Content-Type", "Content-type")),
    }
    for i, name in enumerate(settings.concern_fields, start=1):
        fields[name] = F.when(match.isNotNull(), M.person_field(match, i, settings)).otherwise(B.first(bag, name))
    derived = matched.withColumns(fields).withColumn("date", F.try_to_timestamp("date_text"))
    title = F.col("title")
    put = {
        "dc_title": title,
        "pdf_docinfo_title": title,
    }
    # a document with a date keeps all its creation dates
    created = F.when(B.first(bag, "date").isNull(), F.array("date_text")).otherwise(B.values(bag, "Creation-Date"))
    if_present = {
        key: F.when(B.first(bag, key).isNotNull(), title).otherwise(F.get(B.values(bag, key), 0))
        for key in ("dc:title", "pdf_docinfo:title")
    }
    return derived.withColumn("props", B.drop(B.put_all(bag, {**put, **if_present}, {"Creation-Date": created}), "title", "date", "concern", "id")).drop(
        "_person"
    )


def with_text(files: DataFrame, extractor: Callable[[Column], Column] | None = None) -> DataFrame:
    """Checksum and trimmed text of ``content``; the bytes are dropped."""
    content = F.col("content")
    text = extractor(content) if extractor else X.decode_text(content, F.col("content_type"))
    return files.withColumns(
        {"contents": X.trim_space(text), "checksum": M.checksum(F.col("content"))}
    ).drop("content")


def import_documents(files: DataFrame, extractor: Callable[[Column], Column] | None = None,
                     as_of: Column | None = None, origin: str | Column | None = None,
                     settings: Settings = Settings(), partitions: int | None = None) -> DataFrame:
    """Rows of ``path, content, extracted, supplied`` to catalogue rows with text.

    A document that cannot be imported keeps its row with the reason in
    ``error``; ``convert`` and ``ocr`` flag those an external tool should see,
    which may be without text. ``partitions`` deals the files out anew, for
    inputs of few row groups; it moves their bytes, so the default leaves them.
    """
    content, text = F.col("content"), F.col("contents")
    flagged = spread(files, partitions, "path").withColumns(
        {
            "convert": P.needs_conversion(F.col("path")),
            "ocr": B.needs_ocr(F.col("extracted")),
            "error": F.when(F.col("path").isNull(), "no path")
            .when(content.isNull(), "unreadable")
            .when(F.col("extracted").isNull(), "no metadata"),
        }
    )
    derived = with_text(derive_metadata(flagged, as_of, origin, settings), extractor)
    return derived.withColumn("error", F.coalesce("error", F.when(text.isNull() & ~F.col("convert") & ~F.col("ocr"), "no text")))


def imported(documents: DataFrame) -> DataFrame:
    """The documents of ``import_documents`` that made it."""
    return documents.where(F.col("error").isNull()).drop("error")


def display_metadata(catalog: DataFrame) -> DataFrame:
    """Key and value rows of the fields a person looks at; ``categories`` has a default."""
    bag = F.col("props")
    shown = {
        "title": F.col("title"),
        "concern": F.col("concern"),
        "categories": F.coalesce(F.array_join(B.values(bag, "categories"), ","), F.lit(DEFAULT_CATEGORY)),
        "date": F.col("date_text"),
        "content-type": F.col("content_type"),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), shown[k].alias("value")) for k in DISPLAY_FIELDS))
    return catalog.select("id", F.inline(pairs)).where(F.col("value").isNotNull())


def patch_value(text: Column) -> Column:
    """A form value as list: ``[...]`` is read as JSON, and marked if that fails."""
    as_list = F.from_json(text, "array<string>")
    return F.when(
        text.rlike(r"\A\[.+\]\z"), F.coalesce(as_list, F.array(F.concat(F.lit("Err: "), text)))
    ).otherwise(F.array(text))


def patch_metadata(catalog: DataFrame, patches: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Apply ``id, changes map<string,string>`` to catalogue rows and give the whole new catalogue.

    Several patches of one id are merged key by key: the one of the highest
    ``order`` wins, or of the greatest value if there is no such column.
    Patched rows lose ``version``; with ``texts`` (id, contents) they carry their re-extracted text.
    Unpatched rows are only passed through.
    """
    order = F.col("order") if "order" in patches.columns else F.lit(0)
    each = patches.select("id", order.alias("_order"), F.explode("changes").alias("_key", "_value"))
    last = each.groupBy("id", "_key").agg(F.max(F.struct("_order", "_value")).alias("_last"))
    patches = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("_key", "_last._value"))).alias("changes"))
    changes = F.transform_values("changes", lambda k, v: patch_value(v))
    patched = catalog.join(patches.select("id", changes.alias("_changes")), "id")
    kinds = dict(catalog.dtypes)
    names = {c: c for c in catalog.columns if kinds[c] == "string" and c != "id"}
    names.update({"date": "date_text", "content-type": "content_type"})
    new = {
        column: F.coalesce(F.array_join(F.try_element_at("_changes", F.lit(name)), ","), F.col(column))
        for name, column in names.items()
        if column in kinds
    }
    extra = F.map_filter("_changes", lambda k, v: ~k.isin("_version_", "version", "id", *names))
    patched = patched.withColumns({**new, "props": B.merge_props(F.col("props"), extra)}).drop("_changes", "version")
    if "date" in kinds:
        patched = patched.withColumn("date", F.try_to_timestamp("date_text"))
    if texts is not None:
        patched = patched.join(texts.select("id", "contents"), "id", "left")
    return upsert_documents(catalog, patched)
