"""Phrase collocations by Toivonen's method: a sample proposes, full passes count the proposals and their border exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doccat.llm.blobs import gathered, groups_of, pack, pack_sorted, unpack, unpack_sorted
from doccat.llm.common import row_of, stored, task_count, utf8
from doccat.llm.hashing import LOWER, STEP, Words, mix, powers

#: Words of a phrase, its least count, the share in hundredths from which a longer one covers it, and rows for each language.
LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Documents are dealt into parts by hash; so many parts are the sample, and what that holds this often is proposed.
PARTS, SAMPLED, PROPOSED = 64, 4, 2
#: Text that a task counts at a time, and text for each bucket of the counts.
GATHER_BYTES, BUCKET_BYTES = 8 * 1024 * 1024, 8 * 1024 * 1024
#: Bits of a filter for each phrase, and at most: 16 MB to broadcast, whatever the corpus. It has one slice for the first ten bits of a hash.
KEY_BITS, MOST_BITS, SLICES = 16, 2**27, 1024
#: A language's phrases are dealt into so many groups that each find their first rows.
DEALT = 64

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True
#: Phrases are told apart by a hash of 64 bits and these of a second one.
LOW = np.uint64(2**32 - 1)
SECOND = np.random.default_rng(12).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pieces_of(docs: DataFrame) -> DataFrame:
    """``lang, text, part`` of each row: null as ``und`` and as empty; rows with one doc_id and text share a part."""
    text = F.coalesce("text", F.lit(""))
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(PARTS)).cast("int")
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"), part.alias("part"))


# --- filters ----------------------------------------------------------------------

def slice_of(a: np.ndarray) -> np.ndarray:
    return (a >> np.uint64(54)).astype(np.int64)


def bit(a: np.ndarray, step: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and place in it of the ``k``-th of the four bits that a key has in its slice of ``width`` bits, a power of two."""
    at = mix(a + np.uint64(k) * step) & np.uint64(width - 1)
    return (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)


def step_of(b: np.ndarray) -> np.ndarray:
    return mix(b + STEP) | np.uint64(1)


class Filter:
    """A Bloom filter over pairs of hashes. What it takes for a member by mistake is merely counted too."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.bytes = bits.reshape(-1), bits.shape[1]

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key is a member; a key is done with at its first bit that is not set."""
        out, alive = np.zeros(len(a), bool), np.arange(len(a))
        start, step = slice_of(a) * self.bytes, step_of(b)
        for k in range(4):
            at, place = bit(a, step, k, self.bytes * 8)
            hit = np.flatnonzero((self.bits[start + at] >> place) & np.uint8(1))
            alive, a, start, step = alive[hit], a[hit], start[hit], step[hit]
        out[alive] = True
        return out


def of_part(a: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Another key for each part."""
    return mix(a ^ mix(part.astype(np.uint64) + STEP))


def filter_of(found: DataFrame, parts: bool = False) -> Broadcast:
    """A filter over the phrases of ``found`` (``a, b``), or over phrases with the part that is to name them.

    Each slice is filled by one task; they are put together at the driver and sent to all.
    """
    width = 8
    most = KEY_BITS * found.count() // SLICES
    while width < min(most, MOST_BITS // SLICES):
        width *= 2

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
            a = of_part(a, batch.column("part").to_numpy()) if parts else a
            yield pa.RecordBatch.from_arrays([pa.array(slice_of(a), pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["slice", "a", "b"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            number = batch.column("slice").to_numpy()
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
            for s in np.unique(number).tolist():
                own = made.setdefault(s, np.zeros(width // 8, np.uint8))
                for k in range(4):
                    at, place = bit(a[number == s], step_of(b[number == s]), k, width)
                    np.bitwise_or.at(own, at, np.uint8(1) << place)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([m.tobytes() for m in made.values()], pa.binary())], names=["slice", "bits"])

    dealt = found.select("a", "b", "part").mapInArrow(keys, "slice int, a long, b long").repartition(32, "slice")
    bits = np.zeros((SLICES, width // 8), np.uint8)
    for row in dealt.mapInArrow(fill, "slice int, bits binary").toArrow().to_pylist():
        bits[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return found.sparkSession.sparkContext.broadcast(Filter(bits))


# --- phrases of some texts --------------------------------------------------------

def salts(lang: str) -> tuple[np.uint64, np.uint64]:
    made = np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=16).digest(), np.uint64)
    return made[0], made[1]


def second_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    heads = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(heads, size)
    return mix(np.add.reduceat(SECOND[data[np.repeat(starts, size) + place]] * powers(int(size.max()))[place], heads))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the number of the key at each place."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    at = order[new]
    return keys[at], at, number


class Phrases:
    """Phrases of one length in a gathering of texts: for each place its phrase or -1, and of each phrase hashes, count, least part, a place."""

    def __init__(self, places: np.ndarray, keys: np.ndarray, n: int, part: np.ndarray):
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(new)
        self.places, self.at = places, places[order[heads]]
        self.of = np.full(n, -1, np.int64)
        self.of[places[order]] = np.cumsum(new) - 1
        self.count = np.diff(np.append(heads, len(keys)))
        self.part = np.minimum.reduceat(part[places[order]], heads) if len(heads) else np.zeros(0, part.dtype)

    @classmethod
    def words(cls, number: np.ndarray, kinds: int, part: np.ndarray) -> Phrases:
        """Words that are numbered already."""
        own = cls.__new__(cls)
        own.places, own.of, own.count = np.arange(len(number)), number, np.bincount(number, minlength=kinds)
        own.at, own.part = np.empty(kinds, np.int64), np.full(kinds, 255, np.uint8)
        own.at[number] = own.places
        np.minimum.at(own.part, number, part)
        return own


class Slice:
    """Words of a batch of texts: of each distinct one (by language) two hashes and a place; of each place its word, part and row.

    ``joins`` tells where the next word is in the same piece.
    """

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        self.data = LOWER[data]
        words = Words(self.data, offsets, gap=APART)
        self.rows, self.starts, self.ends = row_of(words.first), words.starts, words.ends()
        self.langs, self.sizes = batch.column("lang").to_pylist(), np.diff(words.first)
        known = {x: salts(x) for x in set(self.langs)}
        salt = np.array([known[x] for x in self.langs], np.uint64).reshape(-1, 2)
        self.a, self.first, self.number = numbered(mix(words.hashes + salt[self.rows, 0]))
        second = second_hashes(self.data, self.starts[self.first], self.ends[self.first])
        self.b = mix(second + salt[self.rows[self.first], 1]) & LOW
        breaks = np.cumsum(BREAK[self.data])[self.starts] if len(data) else np.zeros(0, np.int64)
        self.joins = np.zeros(len(self.starts), bool)
        self.joins[:-1] = (self.rows[1:] == self.rows[:-1]) & (breaks[1:] == breaks[:-1])
        self.parts = batch.column("part").to_numpy().astype(np.uint8)[self.rows]

    def proposals(self, longest: int, filters: list[Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, places of the phrases that the last filter proposes, their hashes, and whether it is the first to do so.

        Nothing is sorted: every place asks the filters, so this is for callers that want few of the phrases.
        """
        n, a, b = len(self.number), self.a[self.number], self.b[self.number]
        known = [f.has(self.a, self.b)[self.number] for f in filters]
        own_a, own_b = a, b
        yield 1, np.flatnonzero(known[-1]), a[known[-1]], b[known[-1]], np.full(int(known[-1].sum()), len(filters) <= 1)
        for length in range(2, longest + 1):
            proposed = [k[:-1] & k[1:] for k in known]
            at = np.flatnonzero(proposed[-1])
            at = at[at + length <= n]
            at = at[self.joins[at + length - 2]]
            to_a, to_b = mix(own_a[at] * STEP + a[at + length - 1]), mix(own_b[at] * STEP + b[at + length - 1]) & LOW
            fresh = np.ones(len(at), bool)
            for p in proposed[:-1]:
                fresh &= ~p[at]
            yield length, at, to_a, to_b, fresh
            if length < longest:
                own_a, own_b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                own_a[at], own_b[at] = to_a, to_b
                known = [np.zeros(n, bool) for _ in filters]
                for k, f, p in zip(known, filters, proposed, strict=True):
                    asked = at[p[at]]
                    k[asked] = f.has(own_a[asked], own_b[asked])

    def text(self, place: int, length: int) -> bytes:
        spans = zip(self.starts[place : place + length].tolist(), self.ends[place : place + length].tolist(), strict=True)
        return b" ".join(self.data[x:z].tobytes() for x, z in spans)


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by both hashes, and where in it each distinct key begins."""
    order = np.argsort(a, kind="stable")
    if ((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])).any():
        order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order, np.flatnonzero(new)


class Texts:
    """All words of a gathering of texts, numbered by language."""

    def __init__(self, held: list[pa.RecordBatch]):
        keys, others, numbers, joins, parts, known = [], [], [], [], [], 0
        for batch in held:
            own = Slice(batch)
            keys.append(own.a)
            others.append(own.b)
            numbers.append(own.number + known)
            known += len(own.a)
            joins.append(own.joins)
            parts.append(own.parts)
        self.a, first, number = numbered(np.concatenate(keys))
        self.b = np.concatenate(others)[first]
        self.words, self.joins, self.parts = number[np.concatenate(numbers)], np.concatenate(joins), np.concatenate(parts)

    def phrases(self, longest: int, known_to: Filter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, and of each phrase two hashes, count and least part. The filter proposes a phrase if it has all parts of it; without one all are."""
        n = len(self.words)
        own, a, b = Phrases.words(self.words, len(self.a), self.parts), self.a, self.b
        yield 1, a, b, own.count, own.part
        for length in range(2, longest + 1):
            at = self.extended(own, known_to.has(a, b) if known_to else None, length)
            before, own = own, Phrases(at, (own.of[at] << 32) | self.words[at + length - 1], n, self.parts)
            head, last = before.of[own.at], self.words[own.at + length - 1]
            a, b = mix(a[head] * STEP + self.a[last]), mix(b[head] * STEP + self.b[last]) & LOW
            yield length, a, b, own.count, own.part

    def extended(self, own: Phrases, known: np.ndarray | None, length: int) -> np.ndarray:
        """Places of phrases of ``length`` words whose two parts, a word shorter, are both known."""
        good = own.of >= 0
        if known is not None and len(known):
            good &= known[own.of]
        at = np.flatnonzero(good[:-1] & good[1:])
        return at[self.joins[at + length - 2]]


def added(held: list[pa.RecordBatch], longest: int, filters: list[Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Length, and of each phrase two hashes, count and least part, as far as the last filter is the first to propose it."""
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    for batch in held:
        own = Slice(batch)
        for size, at, a, b, fresh in own.proposals(longest, filters):
            found.setdefault(size, []).append((a[fresh], b[fresh], own.parts[at[fresh]]))
    for size, columns in found.items():
        a, b, part = (np.concatenate(c) for c in zip(*columns, strict=True))
        if len(a):
            order, heads = distinct(a, b)
            yield size, a[order[heads]], b[order[heads]], np.diff(np.append(heads, len(a))), np.minimum.reduceat(part[order], heads)


# --- counts -----------------------------------------------------------------------

PACKED = "bucket long, size int, a binary, b binary, n binary, part binary"


def counted(rows: DataFrame, buckets: int, filters: list[Broadcast], longest: int, least: int) -> DataFrame:
    """``size, a, b, n, part`` of the phrases that the last filter is first to propose, as far as they occur ``least`` times.

    Counts of ``GATHER_BYTES`` of text go to the buckets of the phrases' hashes, packed,
    with one record for each phrase, however frequent it is. Phrases are told
    apart by 96 bits. ``part`` is the least part of the corpus that has the phrase.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, GATHER_BYTES):
            given = [f.value for f in filters]
            phrases = added(held, longest, given) if len(given) > 1 else Texts(held).phrases(longest, given[0] if given else None)
            for size, a, b, n, part in phrases:
                if not len(a):
                    continue
                at = np.argsort(a)
                bucket = ((a[at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                used, first = np.unique(bucket, return_index=True)
                cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True))
                columns = (a[at], b[at].astype(np.uint32), n[at].astype(np.uint32), part[at])
                packs = [[(pack if c else pack_sorted)(column[x:z]) for x, z in cuts] for c, column in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), pa.array(np.full(len(used), size, np.int32)), *(pa.array(p, pa.binary()) for p in packs)],
                    names=["bucket", "size", "a", "b", "n", "part"],
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["bucket", "size"]):
            a = np.concatenate([unpack_sorted(x, np.uint64) for x in group.column("a").to_pylist()])
            b, n, part = (
                np.concatenate([unpack(x, kind) for x in group.column(c).to_pylist()]) for c, kind in (("b", np.uint32), ("n", np.uint32), ("part", np.uint8))
            )
            order, heads = distinct(a, b)
            a, b, n, part = a[order], b[order], n[order].astype(np.int64), part[order]
            sums = np.add.reduceat(n, heads)
            often = sums >= least
            size = group.column("size")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(int(often.sum()), size, np.int32)), pa.array(a[heads][often].view(np.int64)), pa.array(b[heads][often].astype(np.int64)),
                    pa.array(sums[often]), pa.array(np.minimum.reduceat(part, heads)[often].astype(np.int32)),
                ],
                names=["size", "a", "b", "n", "part"],
            )

    packed = rows.select("lang", "text", "part").mapInArrow(count, PACKED)
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "size").mapInArrow(total, "size int, a long, b long, n long, part int")


def failures(found: DataFrame, last: Broadcast, longest: int) -> DataFrame:
    """Frequent phrases that the last filter has not: their extensions may not have been counted."""

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(~last.value.has(a, b)))], names=["a"])

    return found.where(F.col("size") < longest).select("a", "b").mapInArrow(missed, "a long")


def frequent(rows: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, Broadcast]:
    """``size, a, b, n, part`` of all phrases of up to ``longest`` words that occur ``least`` times, and the last filter.

    The sample proposes phrases. A full pass counts all words, and all phrases
    whose parts are both proposed: the proposals and their negative border. A
    frequent phrase that was not proposed is a border failure; a further pass
    then proposes all that is known to be frequent and counts what that adds,
    until there is no failure. As parts of a frequent phrase are frequent, none
    is missed, whatever the sample held.
    """
    buckets = task_count(rows, "text", BUCKET_BYTES)
    proposed = stored(counted(rows.where(F.col("part") < SAMPLED), buckets, [], longest - 1, PROPOSED), "proposed")
    filters = [filter_of(proposed)]
    found = stored(counted(rows, buckets, filters, longest, least), "counts")
    while not failures(found, filters[-1], longest).isEmpty():
        filters.append(filter_of(found.where(F.col("size") < longest)))
        found = found.union(stored(counted(rows, buckets, filters, longest, least), "counts"))
    return found, filters[-1]


def named(rows: DataFrame, found: DataFrame, last: Broadcast, longest: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of the phrases found, and ``lang, n`` of all words.

    Only where a text of the part that a phrase is noted with is among those
    looked at, the phrase is named, so few name a phrase of any frequency.
    """
    wanted = filter_of(found, parts=True)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in gathered(batches, GATHER_BYTES):
            texts, totals, wanted_here = [Slice(batch) for batch in held], {}, {}
            for number, own in enumerate(texts):
                for lang, n in zip(own.langs, own.sizes.tolist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
                for size, at, a, b, _ in own.proposals(longest, [last.value]):
                    hit = wanted.value.has(of_part(a, own.parts[at]), b)
                    wanted_here.setdefault(size, []).append((a[hit], b[hit], np.full(int(hit.sum()), number), at[hit]))
            yield batch_of([0] * len(totals), [0] * len(totals), list(totals), [None] * len(totals), list(totals.values()))
            for size, columns in wanted_here.items():
                a, b, number, place = (np.concatenate(c) for c in zip(*columns, strict=True))
                order, heads = distinct(a, b)
                at = order[heads]
                owners = [(texts[s], p) for s, p in zip(number[at].tolist(), place[at].tolist(), strict=True)]
                phrase = [own.text(p, size).decode() for own, p in owners]
                lang = [own.langs[own.rows[p]] for own, p in owners]
                yield batch_of(a[at].view(np.int64), b[at].view(np.int64), lang, phrase, [0] * len(at))

    def batch_of(a, b, lang, phrase, n) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((a, b, lang, phrase, n), kinds, strict=True)], names=["a", "b", "lang", "phrase", "n"])

    told = stored(rows.select("lang", "text", "part").mapInArrow(tell, "a long, b long, lang string, phrase string, n long"), "names")
    names = told.where("phrase is not null").groupBy("a", "b").agg(F.first("lang").alias("lang"), F.first("phrase").alias("phrase"))
    totals = told.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = found.join(names, ["a", "b"]).select("lang", "phrase", "size", F.col("n").alias("f"))
    return stored(phrases, "phrases"), stored(totals, "totals")


# --- scores -----------------------------------------------------------------------

def score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact for counts of up to 15 digits."""
    exact = [f"cast({c} as decimal(15, 0))" for c in (a, left, right)]
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({exact[0]} * {exact[0]})) div ({exact[1]} * {exact[2]})")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language by score, count, bytes.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends
    and into words at blanks and tabs. Phrases of 2 to ``longest`` words that
    occur ``least`` times within pieces are scored by their lowest-scoring cut
    (ties: the first). Phrases inside a longer one that has ``covered``
    hundredths of their count are dropped. A null language is ``und``; null and
    empty texts have no words; repeated rows and rows with a null doc_id count
    like all others; no rows, or no such phrases, give no rows.
    """
    rows = pieces_of(docs)
    found, last = frequent(rows, longest, least)
    phrases, totals = named(rows, found, last, longest)
    parts = phrases.select("lang", "phrase", "f")
    many = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    head = F.expr("substring_index(phrase, ' ', k)")
    cuts = cuts.withColumn("head", head).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    scored = cuts.withColumn("score", score("a", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = many.where("size > 2").select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring(phrase, locate(' ', phrase) + 1)"))).alias("phrase"),
    )
    inside = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {covered} * a")
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).orderBy(*order)
    first = left.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
