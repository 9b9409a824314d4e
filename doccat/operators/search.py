"""Search operators: ids of matching documents, and what is done with them.

Every ``match_*`` gives a DataFrame of distinct ``id``. Clauses on the text
body go through a ``TextIndex``; clauses on short catalogue fields are plain
predicates on catalogue rows, which need neither postings nor a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccat.config import (
    BM25_B,
    BM25_K1,
    FIELD_KINDS,
    NOT_RETURNABLE,
    NOT_SEARCHABLE,
    STRING_LIMIT,
)
from doccat.functions import props as B
from doccat.functions.text import tokens
from doccat.operators.postings import TextIndex


# --- predicates on catalogue fields ---------------------------------------

def _kind(field: str) -> str:
    """The content type stands in the field table under its name with a hyphen."""
    return "text" if field == "content_type" else FIELD_KINDS.get(field, "string")


def field_value(catalog: DataFrame, field: str) -> tuple[Column, bool]:
    """A field's value, and whether it is a list.

    A column of the catalogue if there is one. Any other configured field is
    lifted out of the property bag, where its key may have a colon for the
    first underscore: a list of its kind (text, whole number, time), without
    the values that are none; null if nothing is left.
    """
    kinds = dict(catalog.dtypes)
    if field in kinds:
        return F.col(f"`{field}`"), kinds[field].startswith("array")
    if field not in FIELD_KINDS or "props" not in kinds:
        raise ValueError(f"neither a column nor a configured field: {field!r}")
    found = F.coalesce(B.values(F.col("props"), field), B.values(F.col("props"), field.replace("_", ":", 1)))
    wanted = {"long": "bigint", "date": "timestamp"}.get(_kind(field), "string")
    fitting = F.filter(F.transform(found, lambda v: v.try_cast(wanted)), lambda v: v.isNotNull())
    return F.when(F.size(fitting) > 0, fitting), True


def lifted(catalog: DataFrame, *fields: str) -> DataFrame:
    """The catalogue with configured fields of the property bag as columns of their kind."""
    return catalog.withColumns({field: field_value(catalog, field)[0] for field in fields})


def _some(catalog: DataFrame, field: str, test: Callable[[Column], Column]) -> Column:
    """Whether the value, or some value of a list, passes."""
    value, many = field_value(catalog, field)
    return F.exists(value, test) if many else test(value)


def field_tokens(catalog: DataFrame, field: str) -> Column:
    """Terms of a text field, single or multi-valued."""
    _check_searchable(field)
    value, many = field_value(catalog, field)
    return F.flatten(F.transform(value, tokens)) if many else tokens(value)


def field_is(catalog: DataFrame, field: str, value: str) -> Column:
    """Exact and case-sensitive on string fields, any of the terms on text fields."""
    _check_searchable(field)
    if _kind(field) == "text":
        terms = _words(value)
        return F.arrays_overlap(field_tokens(catalog, field), F.array(*(F.lit(t) for t in terms)))
    return _some(catalog, field, lambda v: v == value)


def field_prefix(catalog: DataFrame, field: str, prefix: str) -> Column:
    """Some term begins with ``prefix``; a trailing ``*`` is optional and ``*`` alone asks for any value."""
    _check_searchable(field)
    bare = prefix.removesuffix("*")
    if not bare:
        return field_value(catalog, field)[0].isNotNull()
    if _kind(field) == "text":
        return F.exists(field_tokens(catalog, field), lambda t: t.startswith(bare.lower()))
    return _some(catalog, field, lambda v: v.startswith(bare))


def field_wildcard(catalog: DataFrame, field: str, glob: str) -> Column:
    _check_searchable(field)
    if _kind(field) == "text":
        return F.exists(field_tokens(catalog, field), lambda t: t.rlike(_glob_regex(glob.lower())))
    return _some(catalog, field, lambda v: v.rlike(_glob_regex(glob)))


def field_range(field: str, low=None, high=None, many: bool = False) -> Column:
    """``low`` and ``high`` are inclusive; leave one out for an open end. Of a multi-valued field some value must fit."""
    _check_searchable(field)
    return F.exists(field, _between(low, high)) if many else _between(low, high)(F.col(field))


def _between(low, high) -> Callable[[Column], Column]:
    def inside(value: Column) -> Column:
        fits = value.isNotNull()
        if low is not None:
            fits = fits & (value >= F.lit(low))
        return fits & (value <= F.lit(high)) if high is not None else fits

    return inside


def concern_pattern(concern: str | None) -> str:
    """The web form's concern box: empty means any, and a missing ``*`` is added."""
    concern = concern or "*"
    return concern if "*" in concern else concern + "*"


def field_pattern(catalog: DataFrame, field: str, pattern: str) -> Column:
    """A prefix where ``*`` only ends the pattern, else a wildcard."""
    if re.search(r"[*?]", pattern[:-1]) or pattern.endswith("?"):
        return field_wildcard(catalog, field, pattern)
    return field_prefix(catalog, field, pattern)


# --- matching ---------------------------------------------------------------

def match_terms(index: TextIndex, words: str | list[str]) -> DataFrame:
    """Documents with at least one of the words."""
    terms = _words(words)
    return _ids(index.terms(terms), unique=len(terms) == 1)


def match_field(catalog: DataFrame, field: str, value: str) -> DataFrame:
    return catalog.where(field_is(catalog, field, value)).select("id")


def match_prefix(source: TextIndex | DataFrame, prefix: str, field: str = "contents") -> DataFrame:
    bare = prefix.removesuffix("*")
    if isinstance(source, TextIndex):
        if not bare:
            return match_all(source)
        return _ids(source.lookup(lambda t: t.startswith(bare.lower())))
    return source.where(field_prefix(source, field, prefix)).select("id")


def match_wildcard(source: TextIndex | DataFrame, glob: str, field: str = "contents") -> DataFrame:
    if isinstance(source, TextIndex):
        return _ids(source.lookup(lambda t: t.rlike(_glob_regex(glob.lower()))))
    return source.where(field_wildcard(source, field, glob)).select("id")


def match_all(index: TextIndex) -> DataFrame:
    """Every document that has text."""
    return index.stats.select("id")


def match_range(catalog: DataFrame, field: str, low=None, high=None) -> DataFrame:
    _check_searchable(field)
    return catalog.where(_some(catalog, field, _between(low, high))).select("id")


def match_fuzzy(index: TextIndex, term: str, max_edits: int = 2) -> DataFrame:
    """Documents with a term at most ``max_edits`` (0 to 2) edits away.

    An edit is an insertion, deletion or replacement of a character, or a swap of two neighbours.
    """
    return _ids(index.lookup(lambda t: within_edits(t, term.lower(), max_edits)))


def within_edits(column: Column, word: str, max_edits: int) -> Column:
    """Edit distance test with neighbour swaps, out of plain edit distances.

    A swap leaves its two letters side by side, so what is left to edit lies
    before or after them; two swaps give one of a few fixed words.
    """
    if max_edits not in (0, 1, 2):
        raise ValueError("max_edits must be 0, 1 or 2")
    near = F.levenshtein(column, F.lit(word), max_edits) >= 0
    places = [i for i in range(len(word) - 1) if word[i] != word[i + 1]]
    swap = lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2:]
    if max_edits and places:
        near = near | column.isin(*(swap(word, i) for i in places))
    if max_edits == 2:
        twice = [swap(swap(word, i), j) for i in places for j in places if j > i + 1]
        near = near | column.isin(*twice) if twice else near
        for i in places:
            before, pair, after = word[:i], word[i + 1] + word[i], word[i + 2:]
            tail = F.substring(column, len(before) + 3, 2**31 - 1)
            head = F.substring(column, F.lit(1), F.length(column) - len(after) - 2)
            near = near | (column.startswith(before + pair) & (F.levenshtein(tail, F.lit(after), 1) >= 0))
            near = near | (column.endswith(pair + after) & (F.levenshtein(head, F.lit(before), 1) >= 0))
    return near


def match_phrase(index: TextIndex, words: str | list[str], slop: int = 0) -> DataFrame:
    """Documents with the words next to each other in order, or within ``slop`` moves of that.

    Only the phrase's own postings are gathered, one row per document; the
    positions are then compared inside that row. Each word needs a place of its own.
    """
    terms = _words(words)
    slots: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        slots.setdefault(t, []).append(i)
    if len(slots) == 1 and len(terms) == 1:
        return match_terms(index, terms)
    names = {t: f"_p{k}" for k, t in enumerate(slots)}
    gathered = (
        index.terms(list(slots))
        .groupBy("id")
        .agg(*(F.max(F.when(F.col("term") == t, F.col("positions"))).alias(n) for t, n in names.items()))
    )
    present = gathered.dropna(subset=list(names.values()))
    # A match is a window: slot i sits in [a+i, a+i+slop]; the tightest window starts at some slot's own place.
    if slop == 0:
        starts = F.col(names[terms[0]])
    else:
        starts = F.array_distinct(
            F.concat(*(_shifted(names[t], i) for t, places in slots.items() for i in places))
        )

    def fits(a: Column) -> Column:
        ok = F.lit(True)
        for t, places in slots.items():
            last = None
            for i in places:
                last = _next_place(names[t], a + i, a + i + slop, last)
            ok = ok & last.isNotNull()
        return ok

    return present.where(F.exists(starts, fits)).select("id")


def match_bool(must: tuple[DataFrame, ...] = (), should: tuple[DataFrame, ...] = (),
               must_not: tuple[DataFrame, ...] = ()) -> DataFrame:
    """All of ``must``, none of ``must_not``, and one of ``should`` if nothing is a must.

    One shuffle for any number of clauses: each gives its bit, ids gather them.
    """
    if not must and not should:
        raise ValueError("a query needs something to look for")
    should = () if must else should  # beside a must they only add to scores
    clauses = [*must, *should, *must_not]
    tagged = [ids.select("id", F.lit(k).alias("_clause")) for k, ids in enumerate(clauses)]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionByName(t)
    n_must, n_wanted = len(must), len(must) + len(should)
    hit = [F.max(F.when(F.col("_clause") == k, 1).otherwise(0)) for k in range(len(clauses))]
    needed = sum(hit[:n_wanted], F.lit(0)) >= (n_must or 1)
    banned = sum(hit[n_wanted:], F.lit(0))
    return merged.groupBy("id").agg((needed & (banned == 0)).alias("_ok")).where("_ok").select("id")


def score_bm25(index: TextIndex, words: str | list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """``id, score`` of every document with one of the words.

    Text lengths sit in the postings, so scoring joins nothing that grows with
    the collection: document frequencies have one row per word, the totals one.
    """
    terms = sorted(set(_words(words)))
    weights = {k.lower(): v for k, v in (weights or {}).items()}
    found = index.terms(terms).select("id", "term", "tf", "n_terms")
    totals = index.stats.agg(F.count("*").alias("n"), F.avg("n_terms").alias("avg_terms")).select(
        F.struct("n", "avg_terms")
    )
    weight = F.lit(1.0)
    for t in terms:
        if t in weights:
            weight = F.when(F.col("term") == t, float(weights[t])).otherwise(weight)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    joined = found.join(F.broadcast(df), "term").withColumn("_all", totals.scalar())
    n, avg_terms = F.col("_all")["n"], F.col("_all")["avg_terms"]
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    part = weight * idf * tf / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("n_terms") / avg_terms))
    return joined.groupBy("id").agg(F.sum(part).alias("score"))


# --- results ------------------------------------------------------------------

def hits(ids: DataFrame) -> DataFrame:
    """``numFound`` as one row, whatever page is shown."""
    return ids.agg(F.count("*").alias("num_found"))


def documents(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalogue rows of the matches."""
    return catalog.join(ids.select("id"), "id", "left_semi")


def sort_columns(spec: str = "concern asc,title asc") -> list[Column]:
    """``"field asc,field desc"`` as sort columns: text without case, ``id`` last to break ties."""
    columns = []
    for item in spec.split(","):
        name, _, direction = item.strip().partition(" ")
        direction = direction.strip().lower() or "asc"
        if direction not in ("asc", "desc"):
            raise ValueError(f"sort direction {direction!r} is neither asc nor desc")
        column = F.lower(name) if _kind(name) == "text" and name != "content_type" else F.col(name)
        columns.append(column.desc_nulls_last() if direction == "desc" else column.asc_nulls_last())
    return [*columns, F.col("id").asc()]


def sorts_by(spec: str, name: str) -> bool:
    return any(item.split()[:1] == [name] for item in spec.split(","))


def sort_by(df: DataFrame, spec: str = "concern asc,title asc") -> DataFrame:
    return df.orderBy(*sort_columns(spec))


def page(df: DataFrame, spec: str = "concern asc,title asc", limit: int = STRING_LIMIT, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in sort order; a top-k, not a full sort."""
    ordered = sort_by(df, spec)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def top_ranked(scores: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Best scores first, ``id`` breaking ties after rounding to six places."""
    ordered = scores.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "id")
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def facets(matches: DataFrame, fields: list[str] = (), limit: int | None = None,
           ranges: dict[str, list] | None = None, queries: dict[str, Column] | None = None) -> DataFrame:
    """``field, value, n`` counts over the matches: all fields, ranges and queries in one pass.

    ``limit`` keeps the most frequent values of each of ``fields``, in their
    order; no field's values gather in one task for that. ``ranges`` gives ascending edges of a
    field: a row for each interval, named by its lower edge, which belongs to
    it, as the upper one does not. ``queries`` gives names to predicates; their
    ``field`` is ``query``. Intervals and queries that nothing fits count 0. A
    document counts once for each value, interval and query it fits.
    """
    ranges, queries = ranges or {}, queries or {}
    entry = lambda field, value: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))
    none = F.array().cast("array<struct<field:string,value:string>>")

    def listed(field: str) -> Column:
        value, many = field_value(matches, field)
        return value if many else F.array(value)

    def pairs(field: str) -> Column:
        return F.coalesce(F.transform(F.array_distinct(listed(field)), lambda v: entry(field, v)), none)

    def intervals(field: str, edges: list) -> Column:
        at = F.array(*(F.lit(e) for e in edges))
        place = lambda v: F.size(F.filter(at, lambda e: e <= v))
        places = F.filter(F.transform(listed(field), place), lambda i: (i > 0) & (i < len(edges)))
        return F.coalesce(F.transform(F.array_distinct(places), lambda i: entry(field, F.get(at, i - 1))), none)

    hits = [F.when(fits, F.array(entry("query", F.lit(name)))).otherwise(none) for name, fits in queries.items()]
    parts = [*map(pairs, fields), *(intervals(f, e) for f, e in ranges.items()), *hits]
    counted = (
        matches.select(F.inline(F.concat(*parts)))
        .where(F.col("value").isNotNull())
        .groupBy("field", "value")
        .agg(F.count("*").alias("n"))
    )
    if ranges or queries:
        asked = [entry(f, F.lit(e)) for f, edges in ranges.items() for e in edges[:-1]] + [entry("query", F.lit(q)) for q in queries]
        empty = matches.sparkSession.range(1).select(F.inline(F.array(*asked)), F.lit(0).cast("bigint").alias("n"))
        counted = counted.unionByName(empty).groupBy("field", "value").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("value").asc()]
    if limit is not None:
        # the limit on the row number is applied in every task before rows of a field come together
        place = F.row_number().over(Window.partitionBy("field").orderBy(*order))
        ranked = counted.withColumn("_place", place)
        top = F.col("_place") <= limit
        counted = ranked.where(top if not ranges and not queries else top | ~F.col("field").isin(*fields)).drop("_place")
        places = F.array(*(F.lit(f) for f in [*fields, *ranges, "query"]))
        return counted.orderBy(F.array_position(places, F.col("field")), *order)
    return counted.orderBy("field", *order)


def returnable(df: DataFrame) -> DataFrame:
    """Without the fields that are indexed but never given back."""
    return df.drop(*NOT_RETURNABLE, "last_ts", "last_seq", "last_batch_id")


def listing(df: DataFrame) -> DataFrame:
    return df.select("id", "title", "concern")


def page_state(requests: DataFrame, total: Column) -> DataFrame:
    """Offset after a click (``direction``: forward, backward, anything else) and which buttons are off."""
    offset, num = F.col("offset"), F.col("num")
    moved = (
        F.when(F.col("direction") == "forward", offset + num)
        .when(F.col("direction") == "backward", F.greatest(F.lit(0), offset - num))
        .otherwise(0)
    )
    return requests.withColumn("new_offset", moved.cast("bigint")).withColumns(
        {"next_disabled": F.col("new_offset") > total, "back_disabled": F.col("new_offset") < num}
    )


def normalize_query(queries: DataFrame) -> DataFrame:
    """Raw ``query, sort, is_object`` rows: bare words search ``contents``, strings get the default sort."""
    query = F.col("query")
    return queries.withColumns(
        {
            "query": F.when(F.instr(query, ":") == 0, F.concat(F.lit("contents:("), query, F.lit(")"))).otherwise(query),
            "sort": F.when(F.col("is_object"), F.col("sort")).otherwise(F.lit("concern asc,title asc")),
        }
    )


# --- helpers ------------------------------------------------------------------

def _check_searchable(field: str) -> None:
    if field in NOT_SEARCHABLE:
        raise ValueError(f"field {field!r} is not indexed and cannot be searched")


def _words(words: str | list[str]) -> list[str]:
    """Split words the way texts are split, in order."""
    joined = words if isinstance(words, str) else " ".join(words)
    inside = lambda c: c == "_" or unicodedata.category(c)[0] in "LMN"
    found = "".join(c if inside(c) else " " for c in joined.lower()).split()
    if not found:
        raise ValueError("no word to search for")
    return found


def _shifted(positions: str, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _next_place(positions: str, low: Column, high: Column, after: Column | None) -> Column:
    """The first position in ``[low, high]`` that comes after the one taken before."""
    free = lambda p: (p >= low) & (p <= high) & (F.lit(True) if after is None else p > after)
    return F.array_min(F.filter(positions, free))


def _glob_regex(glob: str) -> str:
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return rf"(?s)\A{body}\z"


def _ids(postings: DataFrame, unique: bool = False) -> DataFrame:
    ids = postings.select("id")
    return ids if unique else ids.distinct()
