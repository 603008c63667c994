"""Language of texts by prediction by partial matching.

For every language a context tree over bytes says how often each byte followed the last ``order`` bytes, the last
``order`` - 1, and so on down to none.  A byte that was not seen after a context costs an escape to the next shorter
one, where the bytes already ruled out are excluded; escapes get one count per different byte (method C).  So the
costs are exact code lengths: in any context the probabilities of all 256 bytes add up to 1.  The counts are frozen
after training; the language with the shortest code of the whole text is predicted.

Trees are kept as sorted tables of contexts, so that all bytes of many texts are looked up at once.  What follows a
long context also follows its shorter ones, hence what is excluded after an escape is a sum known per context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from factloom.llm.common import configure, forget, pieces, text_bytes, with_columns, written

U = np.uint64
NEWLINE = 10
UNKNOWN = "und"


def mask(size: int) -> np.uint64:
    return U((1 << (8 * size)) - 1)


def grams(raw: np.ndarray, at: np.ndarray, order: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (text number, key) of all bytes of the texts.  A key holds the byte and, above it, the ``order``
    bytes before it; before its first byte a text has newlines."""
    for start in range(0, len(raw), block):
        pos = np.arange(start, min(start + block, len(raw)))
        text = np.searchsorted(at, pos, "right") - 1
        room = pos - at[text]
        keys = raw[pos].astype(np.uint64)
        for back in range(1, order + 1):
            before = np.where(room >= back, raw[np.maximum(pos - back, 0)], np.uint8(NEWLINE))
            keys |= before.astype(np.uint64) << U(8 * back)
        yield text, keys


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in an ascending table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


@dataclass
class Trees:
    """Frozen statistics.  Per order k: ``grams[k]`` keys of k + 1 bytes and ``counts[k]`` (one column per language);
    ``contexts[k]`` keys of k bytes with ``totals[k]``, the number of different bytes ``kinds[k]``, and ``below[k]``,
    the counts of those bytes after the next shorter context."""

    languages: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]
    below: list[np.ndarray]

    @classmethod
    def of(cls, languages: list[str], order: int, rows: list[tuple[int, int, int, int]]) -> Trees:
        """From rows (order, key, language number, count)."""
        trees = cls(languages, *[[] for _ in range(6)])
        data = np.array(rows, dtype=np.int64).reshape(-1, 4)
        for k in range(order + 1):
            part = data[data[:, 0] == k]
            keys, at = np.unique(part[:, 1].astype(np.uint64), return_inverse=True)
            counts = np.zeros((len(keys), len(languages)), np.float32)
            np.add.at(counts, (at, part[:, 2]), part[:, 3])
            contexts, at = np.unique(keys >> U(8), return_inverse=True)
            add = lambda values: np.stack([np.bincount(at, values[:, i], len(contexts)) for i in range(len(languages))], 1).astype(np.float32) if len(languages) else np.zeros((len(contexts), 0), np.float32)
            shorter = np.zeros_like(counts)
            if k:
                place, there = found(trees.grams[k - 1], keys & mask(k))
                shorter[there] = trees.counts[k - 1][place[there]]
            trees.grams.append(keys)
            trees.counts.append(counts)
            trees.contexts.append(contexts)
            trees.totals.append(add(counts))
            trees.kinds.append(add(counts > 0))
            trees.below.append(add(np.where(counts > 0, shorter, 0)))
        return trees

    @property
    def order(self) -> int:
        return len(self.grams) - 1

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each key after its context, one column per language."""
        shape = (len(keys), len(self.languages))
        out, open_ = np.zeros(shape), np.ones(shape, bool)
        gone_total, gone_kinds = np.zeros(shape), np.zeros(shape)

        def rows(table: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            at, there = found(table, wanted)
            return np.where(there[:, None], values[at], 0.0) if len(table) else np.zeros(shape)

        for k in range(self.order, -1, -1):
            context = (keys >> U(8)) & mask(k)
            total, kinds, below = (rows(self.contexts[k], v[k], context) for v in (self.totals, self.kinds, self.below))
            count = rows(self.grams[k], self.counts[k], keys & mask(k + 1))
            left, escape = total - gone_total, kinds - gone_kinds
            hit = open_ & (count > 0)
            out[hit] += np.log2((left[hit] + escape[hit]) / count[hit])
            miss = open_ & ~hit & (total > 0) & (escape > 0)
            out[miss] += np.log2((left[miss] + escape[miss]) / escape[miss])
            open_ &= ~hit
            known = total > 0
            gone_total, gone_kinds = np.where(known, below, gone_total), np.where(known, kinds, gone_kinds)
        out[open_] += np.log2(256 - gone_kinds[open_])
        return out


def train(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
    order: int = 3, sample: int = 1_000, languages: int = 100, most: int = 400_000, least: int = 2,
) -> Trees:
    """Context trees of the languages in ``docs``.

    Bounds, all parameters: of each language the texts of ``sample`` ids are read, whole, smallest hash of the id first
    (up to 1,000 Spark finds them without ordering a whole language; beyond, raise
    ``spark.sql.optimizer.windowGroupLimitThreshold`` too); of the languages the ``languages`` most frequent are learned, ties by name;
    all trees together keep at most about ``most`` byte sequences, the most frequent of each language, and none seen less
    than ``least`` times.  An id counts once per language, with its smallest text, and so do all rows without id; rows without
    language teach nothing, null and empty texts neither; a table without languages gives trees without any.
    """
    if not 0 <= order <= 6:
        raise ValueError("order is 0 to 6: a key of order + 1 bytes has to fit a long")
    configure(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.xxhash64(F.col(id_col).cast("string")).alias("_hash"), F.col(text_col).alias("_text"))
    names = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(languages).select("_lang")
    names = sorted(r._lang for r in names.collect())
    if not names:
        return Trees.of([], order, [])
    known = rows.where(F.col("_lang").isin(names))
    first = F.row_number().over(W.partitionBy("_lang").orderBy("_hash"))
    chosen = known.select("_lang", "_hash").distinct().withColumn("_place", first).where(F.col("_place") <= sample).select("_lang", "_hash")
    texts = known.join(F.broadcast(chosen), ["_lang", "_hash"]).groupBy("_lang", "_hash").agg(F.min("_text").alias("_text")).where(F.length("_text") > 0)

    def count(batches):
        for batch in pieces(batches, "_text"):
            number = np.array([names.index(v) for v in batch.column("_lang").to_pylist()], np.int32)
            for text, keys in grams(*text_bytes(batch.column("_text")), order, 1 << 20):
                for i in np.unique(number[text]):
                    some, n = np.unique(keys[number[text] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int64)), pa.array(n)], names=["lang", "key", "n"])

    counts = texts.select("_lang", "_text").mapInArrow(count, "lang int, key long, n long")
    counts = counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("order"), F.col("key").bitwiseAND(F.lit(int(mask(k + 1)))).alias("key")) for k in range(order + 1)]))
    counts = written(counts.select("lang", "n", orders.alias("g")).groupBy("lang", "g.order", "g.key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "byte-contexts")

    top, room = 1 << 12, most // len(names)
    steps: dict[int, dict[int, int]] = {}
    for r in counts.groupBy("lang", F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("rows")).collect():
        steps.setdefault(r.lang, {})[r.n] = r.rows
    limit = {}
    for i, rows_of in steps.items():
        kept, limit[i] = 0, max(rows_of)
        for n in sorted(rows_of, reverse=True):
            kept += rows_of[n]
            if kept > room:
                break
            limit[i] = n
    kept = counts.where(F.col("n") >= F.element_at(F.create_map(*[F.lit(x) for pair in limit.items() for x in pair]), F.col("lang"))) if limit else counts
    trees = Trees.of(names, order, [(r.order, r.key, r.lang, r.n) for r in kept.collect()])
    forget(counts)
    return trees


def predict(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """``docs`` with columns lang_pred and score.

    lang_pred is the language whose trees encode the whole text in the fewest bits, the first by name of a tie;
    ``und`` for a null text, one without a letter, and where no language was learned.  score is that language's share
    of the probability of the text under all of them (0 for ``und``).  Rows are scored one by one, repeated ones alike; columns
    named lang_pred or score are replaced, others pass.
    """
    configure(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    letters = "_letters"
    while letters in docs.columns:
        letters = f"_{letters}"
    marked = docs.withColumn(letters, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    names = pa.array([*trees.languages, UNKNOWN])
    kept = list(docs.columns)
    fields = [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def run(batches):
        count = len(trees.languages)
        for batch in pieces(batches, text_col):
            total = np.zeros((batch.num_rows, count))
            best, score = np.full(batch.num_rows, count), np.zeros(batch.num_rows)
            if count:
                for text, keys in grams(*text_bytes(batch.column(text_col)), trees.order, max(1 << 15, (1 << 22) // count)):
                    different, at = np.unique(keys, return_inverse=True)
                    bits = trees.bits(different)
                    first = int(text[0])
                    for i in range(count):
                        sums = np.bincount(text - first, bits[:, i][at])
                        total[first : first + len(sums), i] += sums
                has = batch.column(letters).to_numpy(zero_copy_only=False).astype(bool)
                near = np.argmin(total, 1)
                share = 1 / np.exp2(np.maximum(total.min(1, keepdims=True) - total, -1000)).sum(1)
                best, score = np.where(has, near, count), np.where(has, share, 0.0)
            rest = batch.select(kept)
            yield with_columns(rest, {"lang_pred": names.take(pa.array(best)), "score": pa.array(score)})

    return marked.mapInArrow(run, T.StructType(fields))
