"""Documents pushed by callers, and documents handed back to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.config import Settings
from doccat.functions import paths as P
from doccat.functions.text import lenient_base64
from doccat.operators.search import returnable


def intake_batch(requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Judge and unpack rows of ``metadata map<string,string>, payload``.

    Adds ``status`` (202 or 400), and for accepted rows ``path``, ``content``
    and ``supplied`` metadata stamped with its origin. A path that climbs out
    of the root is refused.
    """
    wanted = F.nullif(F.try_element_at("metadata", F.lit("filepath")), F.lit(""))
    accepted = F.coalesce(wanted.isNotNull() & ~wanted.rlike(r"(^|/)\.\.(/|$)"), F.lit(False)) & F.col(
        "payload"
    ).isNotNull()
    path = F.regexp_replace(F.concat(F.lit(settings.base + "/"), wanted), "/+", "/")
    supplied = F.transform_values(F.map_filter("metadata", lambda k, v: k != "origin"), lambda k, v: F.array(v))
    stamped = F.map_concat(supplied, F.create_map(F.lit("origin"), F.array(F.lit("REST API"))))
    judged = requests.withColumn("status", F.when(accepted, 202).otherwise(400))
    ok = F.col("status") == 202
    return judged.withColumns(
        {
            "path": F.when(ok, path),
            "content": F.when(ok, lenient_base64(F.col("payload"))),
            "supplied": F.when(ok, stamped),
        }
    ).drop("metadata", "payload")


def get_document(catalog: DataFrame, requests: DataFrame, files: DataFrame | None = None,
                 settings: Settings = Settings()) -> DataFrame:
    """``id, status, path`` per requested id; with ``files`` also the bytes.

    404 for none or one without location, 500 for an id that is not unique.
    """
    asked = requests.select("id").distinct()
    held = (
        catalog.join(asked, "id", "left_semi").groupBy("id").agg(F.count("*").alias("_n"), F.max("loc").alias("_loc"))
    )
    status = (
        F.when(F.col("_n").isNull(), 404)
        .when(F.col("_n") > 1, 500)
        .when(F.col("_loc").isNull() | (F.col("_loc") == ""), 404)
        .otherwise(200)
    )
    answered = requests.join(held, "id", "left").withColumn("status", status)
    path = F.when(F.col("status") == 200, F.concat(F.lit(settings.base + "/"), F.col("_loc")))
    answered = answered.withColumn("path", path).drop("_n", "_loc")
    if files is None:
        return answered
    bytes_ = files.select(P.strip_scheme(F.col("path")).alias("path"), "content")
    return answered.join(bytes_, "path", "left")


def get_metadata(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """The returnable fields per requested id, and ``status`` 200 or 404."""
    known = returnable(catalog).withColumn("_known", F.lit(True))
    return (
        requests.join(known, "id", "left")
        .withColumn("status", F.when(F.col("_known"), 200).otherwise(404))
        .drop("_known")
    )


def json_result(page: DataFrame) -> DataFrame:
    """Each row of a result page as one JSON document."""
    return page.select(F.to_json(F.struct(*page.columns)).alias("json"))
