"""Token files: static range asymmetric numeral systems with interleaved states.

Container: Parquet rows, one for each block, in ascending order of ``block`` (so
any store that Spark reads will do). A block is a run of neighbouring documents:

    block        long    number in the order of the documents: the writing task's, then the block's within it
    doc_ids      binary  int64 each
    lengths      binary  uint32 each: ids of each document, the end id included
    starts       binary  uint64 each: ids of the task's documents before each of them
    n_ids, lanes long    ids in the block, interleaved states
    states       binary  uint64 each: the final state of every lane
    words        binary  uint32 stream of the lanes' renormalisations, in the decoder's order
    checkpoints  binary  for every CHECKPOINT steps: place in ``words`` (int64), then all lanes' states
    crc32        long    of the block's ids as little-endian uint32

Beside it ``tables`` (token, frequency; they add up to 2 ** PRECISION) and
``parts`` (ids that each task wrote; their running sums make starts global).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.llm.common import SLICE_BYTES, row_key, shared_path, slices, stored, text_of, utf8
from doccat.llm.hashing import BYTE, STEP, mix, powers

END = 2
PRECISION = 20
LANES = 4096
LANES_SMALL = 64
CHECKPOINT = 64
BLOCK_IDS = 1 << 20
LOW = np.uint64(1) << np.uint64(31)
CACHE = 2_000_000


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a visible letter: its own where that is printable, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


BYTE_LETTERS = byte_letters()


# --- tokens -----------------------------------------------------------------------

#: White space besides ASCII in UTF-8: two bytes from C2 on, or three whose first two are these (and some that are none).
WIDE_FIRST = np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])
WIDE_SECOND = np.isin(np.arange(256), [0x9A, 0x80, 0x81])
NARROW_SECOND = np.isin(np.arange(256), [0x85, 0xA0])
SPACE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text, and at every blank between two characters that are no white space.

    The byte-level pre-tokenizer never joins such a blank to what stands before
    it, so the ids of the pieces, joined, are those of the whole text.
    """
    good = data == 0x20
    good[:2] = good[-2:] = False
    solid = ~SPACE[data]
    good[1:] &= solid[:-1]
    good[:-1] &= solid[1:]
    if (data == 0xC2).any() or WIDE_FIRST[data].any():
        at = np.flatnonzero(good)
        before, after = data[at - 1], data[at + 1]
        bad = (data[at - 2] == 0xC2) & NARROW_SECOND[before] | (after == 0xC2) & NARROW_SECOND[data[at + 2]]
        bad |= WIDE_FIRST[data[np.maximum(at - 3, 0)]] & WIDE_SECOND[data[at - 2]] | WIDE_FIRST[after] & WIDE_SECOND[data[at + 2]]
        good[at[bad]] = False
    good[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(good)


class Pieces:
    """Ids of texts through ids of their pieces, which are kept by their hash and length.

    A new piece that is a plain word, perhaps with punctuation after it, is one
    or two pre-tokens and goes to the library's BPE model at once; the others go
    through the whole tokenizer in one string, with the end-of-text mark between.
    """

    TAIL = ".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.mark = "<|endoftext|>"
        self.mark_id = self.library.token_to_id(self.mark)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool: list[np.ndarray] = []
        self.pooled = 0
        self.tails: dict[str, list[int]] = {}

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def ids_of(self, new: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(new)
        plain = []
        for i, p in enumerate(new):
            word = p.rstrip(self.TAIL)
            if (word[1:] if word[:1] == " " else word).isalpha():
                ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_LETTERS))]
                if len(word) < len(p):
                    tail = p[len(word) :]
                    if tail not in self.tails:
                        self.tails[tail] = self.whole(tail)
                    ids = ids + self.tails[tail]
                out[i] = ids
            elif self.mark in p:
                out[i] = self.whole(p)
            else:
                plain.append(i)
        for k in range(0, len(plain), 4000):
            part = plain[k : k + 4000]
            ids = np.array(self.library.encode_batch_fast([self.mark.join(new[i] for i in part)], add_special_tokens=False)[0].ids)
            for i, found in zip(part, np.split(ids, np.flatnonzero(ids == self.mark_id)), strict=True):
                out[i] = (found if i == part[0] else found[1:]).tolist()
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch, and each text's offsets in them."""
        if len(self.hashes) > CACHE:
            self.forget()
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = cuts(data, offsets)
        sizes = np.diff(np.append(starts, len(data)))
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        hashes = np.add.reduceat(BYTE[data] * powers(int(sizes.max()))[place], starts)
        hashes = mix(hashes + sizes.astype(np.uint64) * STEP)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        unknown = np.flatnonzero(~known)
        if len(unknown):
            raw = data.tobytes()
            new = [raw[a : a + n].decode() for a, n in zip(starts[first[unknown]].tolist(), sizes[first[unknown]].tolist(), strict=True)]
            ids = self.ids_of(new)
            count = np.array([len(x) for x in ids], np.int64)
            self.pool.append(np.array([i for x in ids for i in x], np.uint32))
            begin = self.pooled + np.cumsum(count) - count
            self.pooled += int(count.sum())
            self.hashes = np.insert(self.hashes, at[unknown], distinct[unknown])
            self.begin = np.insert(self.begin, at[unknown], begin)
            self.count = np.insert(self.count, at[unknown], count)
            at = np.searchsorted(self.hashes, distinct)
            if len(self.pool) > 1:
                self.pool = [np.concatenate(self.pool)]
        at = at[inverse]
        begin, count = self.begin[at], self.count[at]
        ends = np.cumsum(count)
        ids = self.pool[0][np.arange(ends[-1]) + np.repeat(begin - ends + count, count)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One per worker, kept between tasks."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, key, packed`` of ``doc_id, key, text``: ids as compressed uint16 or uint32, the end id last."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack = pieces(path), zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, most=2 * SLICE_BYTES):
            found, at = coder.encode(*utf8(batch.column("text")))
            ids = [np.append(found[a:b], np.uint32(END)) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"),
                    pa.array([pack.compress(x.astype(np.uint16).tobytes() if x.max() < 65536 else b"\0" + x.tobytes()) for x in ids], pa.binary()),
                ],
                names=["doc_id", "key", "packed"],
            )

    return docs.mapInArrow(tokens, "doc_id long, key long, packed binary")


def unpack(packed: bytes) -> np.ndarray:
    raw = zstandard.decompress(packed)
    return np.frombuffer(raw, np.uint16).astype(np.uint32) if len(raw) % 2 == 0 else np.frombuffer(raw[1:], np.uint32)


# --- frequency table --------------------------------------------------------------

def frequencies(rows: DataFrame) -> DataFrame:
    """``token, n`` over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for packed in batch.column("packed"):
                found = np.bincount(unpack(packed.as_py()))
                if len(found) > len(total):
                    total = np.append(total, np.zeros(len(found) - len(total), np.int64))
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["token", "n"])

    return rows.select("packed").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def quantised(n: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that add up to 2 ** precision, none below 1."""
    total = 1 << precision
    if len(n) > total:
        raise ValueError("more distinct tokens than the table's precision holds")
    out = np.maximum(1, np.floor(n / n.sum() * total)).astype(np.int64)
    while (over := int(out.sum()) - total) > 0:  # take what the rare tokens got too much from the frequent ones
        room = out - 1
        out -= np.minimum(room, np.ceil(room * (over / room.sum())).astype(np.int64)) if over > len(out) else (
            np.isin(np.arange(len(out)), np.argsort(-room, kind="stable")[:over]) & (room > 0)
        ).astype(np.int64)
    out[int(np.argmax(n))] += total - int(out.sum())
    return out


class Coder:
    """Encodes and decodes blocks by one static table; dense over the tokens that occur."""

    def __init__(self, tokens: np.ndarray, freq: np.ndarray, precision: int = PRECISION):
        self.tokens, self.bits = tokens.astype(np.uint32), np.uint64(precision)
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64)
        size = int(tokens.max()) + 1 if len(tokens) else 0
        self.place = np.zeros(size, np.int32)
        self.place[tokens] = np.arange(len(tokens))
        self.slot: np.ndarray | None = None

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final states, the stream in the decoder's order, and checkpoints (one row: place in the stream, states)."""
        symbols = self.place[ids]
        steps = -(-len(ids) // lanes)
        states = np.full(lanes, LOW, np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, int, np.ndarray]] = []
        written = 0
        for step in range(steps - 1, -1, -1):
            part = symbols[step * lanes : (step + 1) * lanes]
            x, f = states[: len(part)], self.freq[part]
            full = x >= (((LOW >> self.bits) << np.uint64(32)) * f)
            words = x[full].astype(np.uint32)
            out.append(words)
            written += len(words)
            x = np.where(full, x >> np.uint64(32), x)
            states[: len(part)] = ((x // f) << self.bits) + x % f + self.cum[part]
            if step and step % CHECKPOINT == 0:
                marks.append((step, written, states.copy()))
        stream = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        rows = [np.concatenate([np.array([written - w], np.uint64), s]) for _, w, s in marks[::-1]]
        return states, stream, np.array(rows, np.uint64).reshape(len(rows), lanes + 1)

    def decode(self, n: int, lanes: int, states: np.ndarray, stream: np.ndarray, at: int = 0, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of steps ``first`` to ``last``; ``states`` and ``at`` are those of ``first``."""
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.tokens), dtype=np.int32), self.freq.astype(np.int64))
        steps = -(-n // lanes)
        last = steps if last is None else min(last, steps)
        states, mask, out = states.copy(), (np.uint64(1) << self.bits) - np.uint64(1), []
        for step in range(first, last):
            size = min(lanes, n - step * lanes)
            x = states[:size]
            low = x & mask
            symbol = self.slot[low.astype(np.int64)]
            out.append(symbol)
            x = self.freq[symbol] * (x >> self.bits) + low - self.cum[symbol]
            need = np.flatnonzero(x < LOW)
            x[need] = (x[need] << np.uint64(32)) | stream[at : at + len(need)]
            at += len(need)
            states[:size] = x
        return self.tokens[np.concatenate(out)] if out else np.zeros(0, np.uint32)


BLOCKS = (
    "block long, doc_ids binary, lengths binary, starts binary, n_ids long, lanes long, states binary, "
    "words binary, checkpoints binary, crc32 long"
)


def write_files(docs: DataFrame, path: str, out: str) -> None:
    """Tokenise ``doc_id, text`` and write blocks and table under ``out``.

    Texts are tokenised once, into rows in the shared folder that are counted for
    the table and then dealt out by ranges of doc_id, so every task encodes a run
    of the order; a null doc_id comes first, ties go by the text's hash.
    """
    spark = docs.sparkSession
    rows = stored(token_rows(docs.select("doc_id", row_key().alias("key"), "text"), path), "tokens")
    totals = frequencies(rows).toArrow()  # a row for each token of the vocabulary at most
    order = np.argsort(totals.column("token").to_numpy())
    tokens, n = totals.column("token").to_numpy()[order], totals.column("n").to_numpy()[order]
    freq = quantised(n) if len(n) else n
    table = spark.createDataFrame(pd.DataFrame({"token": tokens.astype("int64"), "frequency": freq.astype("int64")}), "token long, frequency long")
    table.coalesce(1).write.parquet(f"{out}/tables")
    shared = spark.sparkContext.broadcast((tokens, freq))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = Coder(*shared.value), TaskContext.get().partitionId()
        held: list[tuple[int | None, int, np.ndarray]] = []
        size = number = before = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate([h[2] for h in held])
            lanes = LANES if len(ids) >= 16 * LANES else LANES_SMALL
            states, stream, marks = coder.encode(ids, lanes)
            null = np.int64(-(2**63))
            values = [
                [(part << 32) + number], [np.array([null if h[0] is None else h[0] for h in held], np.int64).tobytes()],
                [np.array([len(h[2]) for h in held], np.uint32).tobytes()], [np.array([h[1] for h in held], np.uint64).tobytes()],
                [len(ids)], [lanes], [states.tobytes()], [stream.tobytes()], [marks.tobytes()], [zlib.crc32(ids.astype("<u4").tobytes())],
            ]
            names = [f.split()[0] for f in BLOCKS.split(", ")]
            types = [pa.binary() if f.endswith("binary") else pa.int64() for f in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                ids = unpack(packed)
                held.append((doc_id, before, ids))
                before += len(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield block()
                    held, size, number = [], 0, number + 1
        if held:
            yield block()

    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")
    written = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    parts = written.groupBy(F.shiftright("block", 32).alias("part")).agg(F.sum("n_ids").alias("n_ids"))
    parts.coalesce(1).write.parquet(f"{out}/parts")


def read_files(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files; a wrong checksum fails."""
    table = spark.read.parquet(f"{out}/tables").orderBy("token").toPandas()
    parts = spark.read.parquet(f"{out}/parts").orderBy("part").toPandas()  # a row for each task that wrote
    bases = dict(zip(parts["part"], parts["n_ids"].cumsum() - parts["n_ids"], strict=True))
    shared = spark.sparkContext.broadcast((table["token"].to_numpy(), table["frequency"].to_numpy()))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row["n_ids"], row["lanes"], np.frombuffer(row["states"], np.uint64), np.frombuffer(row["words"], np.uint32))
                if zlib.crc32(ids.astype("<u4").tobytes()) != row["crc32"]:
                    raise ValueError(f"block {row['block']} is damaged")
                lengths, doc_ids = np.frombuffer(row["lengths"], np.uint32).astype(np.int64), np.frombuffer(row["doc_ids"], np.int64)
                at = np.concatenate([[0], np.cumsum(lengths)])
                raw = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64(), mask=doc_ids == np.int64(-(2**63))),
                        pa.array(np.frombuffer(row["starts"], np.uint64).astype(np.int64) + bases[row["block"] >> 32]), pa.array(lengths),
                        pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenised(documents: DataFrame, path: str | None = None, out: str | None = None) -> DataFrame:
    """Encode all texts, write the files, read them back: ``doc_id, start, n_tokens, ids_crc32`` for every row.

    A null or empty text is the end id alone. Rows that share a doc_id follow
    each other. An empty table gives empty files and no rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    spark = documents.sparkSession
    out = out or shared_path(spark, "token-files")
    write_files(text_of(documents), path, out)
    return read_files(spark, out)
