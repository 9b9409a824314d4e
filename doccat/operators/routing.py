"""Filing inbox documents by the naming rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.config import SPACE_CLASS, Settings
from doccat.functions import paths as P

_MARK = "\u0001"  # parts the captures; no file name holds it


def _read_by(rule: int, read: Column, pattern: str, groups: int) -> Column:
    """The rule's number, its whole match and its captures, if no earlier rule has read the name."""
    wanted = _MARK.join([str(rule), *(f"${i}" for i in range(1, groups + 2))])
    taken = F.regexp_replace(read, rf"\A(?s:.*?)({pattern})(?s:.*)\z", wanted)
    return F.when(F.contains(read, F.lit(_MARK)), read).otherwise(taken)


def _concern_part(part: Column) -> Column:
    """Write a day-first or year-first date inside a name part as dd.mm.yyyy."""
    dotted = F.when(part.rlike(r"\d\d[\-_/]\d\d[\-_/]\d{2,4}"), F.translate(part, "-_/", "...")).otherwise(part)
    year_first = r"(?s)\A.*?(\d\d\d\d)[\-._/](\d\d)[\-._/](\d\d).*\z"
    return F.regexp_replace(dotted, year_first, "$3.$2.$1")


def route_inbox(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``rule`` (0-based, null if none fits) and ``placed``, the path below the root.

    Staged so that each regex runs at most once per row: one step per rule,
    then the parts, then the name.
    """
    return _route(files, P.stem(F.col("path")), settings)


def _route(files: DataFrame, name_read: Column, settings: Settings) -> DataFrame:
    rule, captures = F.col("rule"), F.col("_captures")
    meanings = [meaning.split(",") for _, meaning in settings.rules]
    staged = files.withColumn("_read", name_read)
    for i, (pattern, _) in enumerate(settings.rules):
        staged = staged.withColumn("_read", _read_by(i, F.col("_read"), pattern, len(meanings[i])))
    staged = staged.withColumn(
        "_captures", F.when(F.contains("_read", F.lit(_MARK)), F.split("_read", _MARK))
    ).withColumn("rule", F.get(captures, 0).cast("int"))

    def capture(field: str) -> Column:
        value = F.lit(None).cast("string")
        for i, meaning in enumerate(meanings):
            if field in meaning:
                value = F.when(rule == i, F.get(captures, meaning.index(field) + 2)).otherwise(value)
        return value

    parts = {f"_{f}": _concern_part(capture(f)) for f in settings.concern_fields}
    staged = staged.withColumns(
        {
            **parts,
            "_date": F.translate(capture("date"), "\\._", "---"),
            "_title": capture("title"),
            "_ext": P.extension(F.col("path")),
        }
    )
    staged = staged.withColumns(
        {
            "_folder": F.concat_ws("_", *parts),
            "_name": F.coalesce(F.nullif(F.concat_ws("_", "_date", "_title"), F.lit("")), F.get(captures, 1)),
        }
    )
    folder = F.col("_folder")
    if settings.concern_prefix_length:
        folder = F.concat(F.lower(F.substring(folder, 1, settings.concern_prefix_length)), F.lit("/"), folder)
    name = F.regexp_replace("_name", SPACE_CLASS, "_")
    placed = F.when(rule.isNotNull(), F.concat(folder, F.lit("/"), name, F.col("_ext")))
    return staged.select(*files.columns, "rule", placed.alias("placed"))


def route_plan(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """What to do with each arriving file: ``move`` or ``manual`` with a destination, or ``index`` in place."""
    in_inbox = P.parent_name(F.col("path")) == settings.inbox
    placed = F.col("placed")
    manual = F.concat(F.lit(settings.manual + "/"), P.basename(F.col("path")))
    routed = _route(files, F.when(in_inbox, P.stem(F.col("path"))), settings)  # no name is read outside the inbox
    return routed.withColumns(
        {
            "action": F.when(~in_inbox, "index").when(placed.isNotNull(), "move").otherwise("manual"),
            "destination": F.when(in_inbox, F.coalesce(placed, manual)).otherwise(
                P.location(P.strip_scheme(F.col("path")), settings)
            ),
        }
    ).drop("rule", "placed")
