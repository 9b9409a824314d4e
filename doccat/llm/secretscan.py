"""Secret scan: spans by pattern, and how many owners and repositories share each candidate. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import row_key, stored, text_of

#: The base patterns, in the order in which kinds are listed, with the shortest match that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: What else may be a credential: long runs of letters, digits and signs, with both letters and digits.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|test|x{4}|0{6}|123456|abcdef(?![0-9a-f])"
KINDS = ("assign", "access", "hex", "owned")
#: From this many owners on a candidate counts as copied; of one owner as specific.
COPIED_OWNERS = 3
STEP = 256

SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array of ints, in steps of 256 so that long arrays stay cheap."""
    blocks = F.sequence(F.lit(0), F.ceil(F.size(values) / STEP).cast("int") - 1)

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    sums = F.transform(blocks, lambda b: total(F.slice(values, b * STEP + 1, F.lit(STEP))))
    bases = F.transform(blocks, lambda b: total(F.slice(sums, F.lit(1), b)))

    def within(b: Column) -> Column:
        part = F.slice(values, b * STEP + 1, F.lit(STEP))
        return F.transform(part, lambda _, i: F.element_at(bases, b + 1) + total(F.slice(part, F.lit(1), i + 1)))

    return F.when(F.size(values) > 0, F.flatten(F.transform(blocks, within))).otherwise(F.array().cast("array<int>"))


def placed(found: str, starts: str, rank: int, value) -> Column:
    """Matches as structs of start, rank of the kind, end and value."""
    return F.transform(
        F.arrays_zip(F.col(starts).alias("s"), F.col(found).alias("m")),
        lambda p: F.struct(
            p["s"].alias("start"), F.lit(rank).alias("rank"), (p["s"] + F.length(p["m"])).alias("end"), value(p["m"]).alias("value")
        ),
    )


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` without its text but with ``base`` (spans of the three kinds) and ``others`` (other candidates).

    A match's start is the length of all matches and of all text between them
    that come before it: what splitting the text at the pattern leaves. Texts
    without matches are looked at once for each pattern.
    """
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "owned": CANDIDATE}
    out = docs.withColumns({f"{k}__found": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    none = F.array().cast("array<int>")
    steps = {
        k: F.when(
            F.size(f"{k}__found") > 0,
            F.zip_with(
                F.slice(F.transform(F.split(F.col("text"), p, -1), F.length), F.lit(1), F.size(f"{k}__found")),
                F.concat(F.array(F.lit(0)), F.transform(F.col(f"{k}__found"), F.length)),
                lambda gap, match: F.coalesce(gap, F.lit(0)) + match,
            ),
        ).otherwise(none)
        for k, p in patterns.items()
    }
    out = out.withColumns({f"{k}__steps": F.slice(s, F.lit(1), F.size(f"{k}__found")) for k, s in steps.items()})
    out = out.withColumns({f"{k}__starts": running_sums(F.col(f"{k}__steps")) for k in patterns})

    def same(match: Column) -> Column:
        return match

    assign = placed("assign__found", "assign__starts", 0, lambda m: F.regexp_extract(m, ASSIGN, 2))
    access = placed("access__found", "access__starts", 1, same)
    base = F.array_sort(
        F.concat(
            F.filter(assign, lambda s: F.length(s["value"]) >= ASSIGN_LEAST), F.filter(access, lambda s: s["end"] - s["start"] >= ACCESS_LEAST),
            placed("hex__found", "hex__starts", 2, same),
        )
    )
    out = out.withColumn("base", base)
    others = F.filter(
        placed("owned__found", "owned__starts", 3, same),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
        & ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return out.select(*(c for c in docs.columns if c != "text"), "base", others.alias("others"))


def ownership(candidates: DataFrame) -> DataFrame:
    """``hash, n_owners, n_repos``: distinct owners and repositories of each candidate hash, over the whole corpus.

    Reduced before each shuffle, so a value that very many documents hold
    travels once from every task.
    """
    by_owner = candidates.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n")).groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def rendered(spans: str) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(documents: DataFrame, owner: Column, repo: Column) -> DataFrame:
    """``doc_id, base, added, n_live, n_copied`` of every row of ``documents``, repeated rows included.

    Candidates are the values of the base spans and other long runs of letters
    and digits that overlap none of them. One held by a single owner that does
    not look like a placeholder is live-looking; such other candidates become
    spans of the kind ``owned``. One held by three owners or more is copied. Null
    owners and repositories count as one each; a null text is empty.
    """
    docs = text_of(documents, F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repo.cast("string"), F.lit("")).alias("repo"))
    rows = stored(with_spans(docs.withColumn("key", row_key())), "spans")
    each = rows.select("doc_id", "key", "owner", "repo", F.explode(F.concat("base", "others")).alias("span"))
    each = each.select("doc_id", "key", "owner", "repo", "span", F.sha2(F.col("span.value").cast("binary"), 256).alias("hash"))
    owners = ownership(each)
    live = (F.col("n_owners") == 1) & ~F.col("span.value").rlike(PLACEHOLDER)
    judged = each.join(owners, "hash").groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.when(live & (F.col("span.rank") == 3), F.col("span")))).alias("added"),
        F.count_distinct(F.when(live, F.col("span"))).alias("n_live"),
        F.count_distinct(F.when(F.col("n_owners") >= COPIED_OWNERS, F.col("span"))).alias("n_copied"),
    )
    judged = judged.select(F.col("doc_id").alias("id__"), F.col("key").alias("key__"), "added", "n_live", "n_copied")
    out = rows.join(judged, F.col("doc_id").eqNullSafe(F.col("id__")) & (F.col("key") == F.col("key__")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"),
    )


def digest(found: DataFrame) -> DataFrame:
    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    out = found.withColumn("all", F.array_sort(F.concat("base", "added")))
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(rendered("base").cast("binary"), 256).alias("base_sha256"), rendered("all").alias("spans"), "n_live", "n_copied",
    )
