"""Long word sequences that an earlier document already holds, cut out.

Difference-cover anchors: windows of ``size - period + 1`` words are hashed only where their position
modulo the period lies in a difference cover.  For any two places of an equal window of ``size`` words
some shift below the period puts both on the cover, so every repeated window holds an anchor that is
repeated too.  Two Bloom filters find the repeated anchors without a shuffle; each is then extended to
all windows that hold it at such a shift.  Runs of these windows are compared as blocks cut where the
content says so, and only windows in a block's first document are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from factloom.llm import filters
from factloom.llm.common import configure, pieces, text_bytes, with_columns, written
from factloom.llm.kernels import U, Words, mix, sequences

#: Perfect difference sets: every shift modulo the period is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}


def _words(batch: pa.RecordBatch, text: str) -> Words:
    return Words(*text_bytes(batch.column(text)))


def _anchors(words: Words, size: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows at cover positions of each text."""
    begin, hashes = words.windows(size - period + 1)
    place = begin - np.repeat(words.at[:-1], np.diff(words.at))[begin]
    on = np.zeros(period, bool)
    on[list(COVERS[period])] = True
    keep = on[place % period]
    return begin[keep], hashes[keep]


def _held(words: Words, size: int, period: int, anchors: np.ndarray) -> np.ndarray:
    """Windows of ``size`` words (by first word) that hold one of the anchors at a shift below the period."""
    change = np.zeros(len(words.hash) + 1, np.int64)
    begin_of = np.repeat(words.at[:-1], np.diff(words.at))
    np.add.at(change, np.maximum(anchors - period + 1, begin_of[anchors]), 1)
    np.add.at(change, anchors + 1, -1)
    ends = np.repeat(words.at[1:], np.diff(words.at))
    at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    return at[at + size <= ends[at]]


def _blocks(words: Words, size: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of held windows, split before positions that the two words there choose: first and last window."""
    if not len(held):
        return held, held
    pair = words.hash[held] ^ (words.hash[np.minimum(held + 1, len(words.hash) - 1)] << U(1))
    text = np.repeat(np.arange(words.texts), np.diff(words.at))[held]
    cut = mix(pair) & U(15) == 0
    cut[0] = True
    cut[1:] |= (np.diff(held) != 1) | (np.diff(text) != 0)
    first = np.flatnonzero(cut)
    return held[first], held[np.append(first[1:], len(held)) - 1]


def _once(words: Words, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Each hash once per text: what a text repeats by itself is no reason to suspect it."""
    text = np.searchsorted(words.at, at, "right") - 1
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[keep]


def _by_text(words: Words, places: np.ndarray) -> np.ndarray:
    """How many of the ascending word positions lie in each text."""
    return np.diff(np.searchsorted(places, words.at))


def remove_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, period: int = 21, bits: int = 30, probes: int = 3
) -> DataFrame:
    """``docs`` with its words joined by one blank but for those covered by a window of ``size`` words
    whose sequence also starts in a row with a smaller id; columns n_words, n_removed (long) added.

    Windows are judged on the input.  Null, empty and short texts have no window.  Rows with a null id
    neither lose words nor make others lose them; rows with the same id leave each other alone.  Columns
    named n_words or n_removed are replaced, others pass.  ``bits``: log2 of the slots of the anchor
    filters, best 30 times the anchors (fewer only let more windows through to the exact comparison).
    """
    configure(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed")
    late_bits, columns = bits - 3, docs.columns

    def anchor_hashes(batches) -> Iterator[np.ndarray]:
        for batch in pieces(batches, text_col):
            words = _words(batch, text_col)
            yield _once(words, *_anchors(words, size, period))

    known = docs.where(F.col(id_col).isNotNull())
    path = filters.build(known.select(text_col), anchor_hashes, "anchors", bits, probes, 2, (2,))
    block = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    block_sql = "array<struct<a:bigint,b:bigint,first:int,last:int>>"

    def repeats(batches):
        """Batches with their words and the blocks of windows that may be repeated."""
        twice = filters.load(path, bits, 1)
        for batch in pieces(batches, text_col):
            words = _words(batch, text_col)
            at, found = _anchors(words, size, period)
            yield batch, words, *_blocks(words, size, _held(words, size, period, at[filters.seen(twice, found, bits, probes)]))

    def finished(batch: pa.RecordBatch, words: Words, keep: np.ndarray) -> pa.RecordBatch:
        """The batch with the words that stay."""
        raw = words.raw.tobytes()
        start, end = words.start[keep].tolist(), words.end[keep].tolist()
        stays = np.append(0, np.cumsum(keep))[words.at].tolist()
        texts = [b" ".join([raw[x:y] for x, y in zip(start[i:j], end[i:j])]).decode() for i, j in zip(stays, stays[1:])]
        n_words = np.diff(words.at)
        kept = batch.select(columns)
        return with_columns(kept, {text_col: pa.array(texts, pa.string()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_words - np.diff(stays), pa.int64())})

    def clean(batches):
        """Rows without such blocks, or without id: nothing goes."""
        for batch, words, first, _ in repeats(batches):
            whole = finished(batch, words, np.ones(len(words.hash), bool))
            none = pa.array(_by_text(words, first) == 0)
            yield whole.filter(pc.or_(none, pc.is_null(batch.column(id_col))))

    def suspects(batches):
        for batch, words, first, last in repeats(batches):
            a, b = sequences(words, first, last + size)
            begin = words.at[np.searchsorted(words.at, first, "right") - 1]
            rows = pa.StructArray.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array((first - begin).astype(np.int32)), pa.array((last - begin).astype(np.int32))],
                fields=list(block),
            )
            lengths = np.zeros(words.texts + 1, np.int32)
            np.cumsum(_by_text(words, first), out=lengths[1:])
            yield with_columns(batch, {"_blocks": pa.ListArray.from_arrays(pa.array(lengths), rows)})

    marked = docs.mapInArrow(suspects, T.StructType([*docs.schema.fields, T.StructField("_blocks", T._parse_datatype_string(block_sql))]))
    suspected = (F.size("_blocks") > 0) & F.col(id_col).isNotNull()
    held = written(marked.where(suspected).withColumn("_row", F.monotonically_increasing_id()), "blocks")

    # All windows of a block start in the first document that has the block, which stands for the others.
    # A Bloom filter of (block, first id) tells the rows: what it does not hold is settled, and a false hit
    # is only compared window by window as well.
    blocks = held.select(F.col(id_col).alias("_id"), F.explode("_blocks").alias("_b")).select("_id", "_b.a", "_b.b")
    first = blocks.groupBy("a", "b").agg(F.min("_id").alias("_id")).select("a", "b", F.xxhash64("_id").alias("_key"))

    def owner(a: pa.Array, b: pa.Array, key: np.ndarray) -> np.ndarray:
        a, b = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in (a, b))
        return mix(a + U(3) * b) ^ mix(key.view(np.uint64))

    def owners(batches) -> Iterator[np.ndarray]:
        for batch in batches:
            yield owner(batch.column("a"), batch.column("b"), batch.column("_key").to_numpy())

    owner_path = filters.build(first, owners, "owners", late_bits, probes, 2, (1,))
    keyed = held.withColumn("_key", F.xxhash64(id_col))

    def windows_of(words: Words, batch: pa.RecordBatch, first_ones: bool) -> np.ndarray:
        """Windows in the blocks that the rows are first to have, or in all others."""
        blocks = batch.column("_blocks")
        sizes = blocks.value_lengths().to_numpy(zero_copy_only=False)
        flat, begin = blocks.flatten(), np.repeat(words.at[:-1], sizes)
        key = np.repeat(batch.column("_key").to_numpy(), sizes)
        mine = filters.seen(filters.load(owner_path, late_bits, 0), owner(flat.field("a"), flat.field("b"), key), late_bits, probes)
        keep = mine if first_ones else ~mine
        change = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(change, (begin + flat.field("first").to_numpy())[keep], 1)
        np.add.at(change, (begin + flat.field("last").to_numpy())[keep] + 1, -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    def window_hashes(batches) -> Iterator[np.ndarray]:
        for batch in pieces(batches, text_col):
            words = _words(batch, text_col)
            at = windows_of(words, batch, True)
            yield _once(words, at, sequences(words, at, at + size)[0])

    late_path = filters.build(keyed.select(text_col, "_blocks", "_key"), window_hashes, "windows", late_bits, probes, 2, (2,))

    def late_windows(batches):
        for batch in pieces(batches, text_col):
            words = _words(batch, text_col)
            at = windows_of(words, batch, True)
            a, b = sequences(words, at, at + size)
            keep = filters.seen(filters.load(late_path, late_bits, 1), a, late_bits, probes)
            at, a, b = at[keep], a[keep], b[keep]
            text = np.searchsorted(words.at, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(pa.array(text)), batch.column("_id").take(pa.array(text)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array((at - words.at[text]).astype(np.int32))],
                names=["_row", "_id", "a", "b", "at"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    windows = keyed.select("_row", F.col(id_col).alias("_id"), text_col, "_blocks", "_key").mapInArrow(late_windows, f"_row long, _id {kind}, a long, b long, at int")
    windows = written(windows, "windows")
    first = written(windows.groupBy("a", "b").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last"), "first")
    late = windows.join(first.hint("merge"), ["a", "b"]).where("_id > _first").groupBy("_row").agg(F.collect_list("at").alias("_late"))
    rest = keyed.join(late, "_row", "left").drop("_row")
    def rewrite(batches):
        for batch in pieces(batches, text_col):
            words = _words(batch, text_col)
            change = np.zeros(len(words.hash) + 1, np.int64)
            late = batch.column("_late")
            at = np.repeat(words.at[:-1], late.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) + late.flatten().to_numpy()
            at = np.concatenate([at, windows_of(words, batch, False)])
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)
            yield finished(batch, words, np.cumsum(change[:-1]) == 0)

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return docs.mapInArrow(clean, schema).unionByName(rest.mapInArrow(rewrite, schema))
