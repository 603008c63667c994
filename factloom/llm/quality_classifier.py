"""Quality of texts by Naive Bayes support vectors.

A text is the set of its n-grams: one and two words, one and two word shapes, a word said twice in a row,
and the share of different words in tenths, all hashed.  Each indicator is scaled by the log-count ratio
of the two classes; on these a linear hinge-loss model is fitted by dual coordinate descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from factloom.llm.common import configure, pieces, text_bytes, with_columns
from factloom.llm.kernels import _BASES, _BYTE, U, Words, mix, prefix, spans

#: log2 of the number of hashed n-grams, and the share of the scale a margin of 1 stands for.
BITS = 18
SLOPE = 2.0
_SHAPE = np.arange(256)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def shapes(words: Words) -> np.ndarray:
    """Hash of each word's shape: small, capital, digit or the very sign, runs once ("Abc!!" as "Aa!")."""
    kind = _SHAPE[words.raw]
    turn = np.ones(len(kind), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[words.start] = True
    at = np.flatnonzero(turn)
    sums = prefix(_BYTE[kind[at]], _BASES[2])
    return spans(sums, np.searchsorted(at, words.start), np.searchsorted(at, words.end), _BASES[2])


def features(batch: pa.RecordBatch, text_col: str) -> list[np.ndarray]:
    """Ascending distinct n-gram numbers of each text; a text without words has only its share."""
    words = Words(*text_bytes(batch.column(text_col)))
    number = lambda h, salt: (mix(h ^ U(salt)) >> U(64 - BITS)).astype(np.int32)
    one, shape = words.hash, shapes(words)
    two = (one[:-1] * U(3)) ^ one[1:]
    pair = (shape[:-1] * U(3)) ^ shape[1:]
    again = one[:-1] == one[1:]
    all_of = [number(one, 1), number(two, 2), number(shape, 3), number(pair, 4)]
    special = number(np.arange(12, dtype=np.uint64), 5)
    out = []
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist()):
        last = max(a, b - 1)
        share = 10 * len(np.unique(one[a:b])) // max(1, b - a)
        extra = special[[share, 11]] if again[a:last].any() else special[[share]]
        out.append(np.unique(np.concatenate([all_of[0][a:b], all_of[1][a:last], all_of[2][a:b], all_of[3][a:last], extra])))
    return out


def fit(rows: list[np.ndarray], good: np.ndarray, rounds: int = 12, cost: float = 1.0, alpha: float = 1.0) -> np.ndarray:
    """Weight of each n-gram, the log-count ratio within; the last value is the bias."""
    n = 1 << BITS
    count = [np.full(n, alpha), np.full(n, alpha)]
    for row, y in zip(rows, good):
        count[int(y)][row] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    x = [(ratio[row] / np.sqrt(len(row))) for row in rows]
    norm = np.array([v @ v + 1 for v in x])
    sign = np.where(good, 1.0, -1.0)
    w, bias, dual = np.zeros(n), 0.0, np.zeros(len(rows))
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            slack = sign[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(dual[i] - slack / norm[i], 0.0), cost)
            step = (new - dual[i]) * sign[i]
            if step:
                dual[i] = new
                w[rows[i]] += step * x[i]
                bias += step
    return np.append(w * ratio, bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> np.ndarray:
    """Weights learned from labelled rows (label 0 or 1, any other is none).

    At most ``sample`` rows are used, half of each class, smallest hash of the id first: this bounds what
    is broadcast and what the fitting task holds.  An id labelled twice counts once, with its smaller label.
    Without rows of both classes all weights are 0, so every score is 0.5.
    """
    configure(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    known = known.withColumn("_order", F.xxhash64("_id"))
    chosen = [known.where(F.col("_y") == y).orderBy("_order", "_id").limit(sample // 2) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))

    def extract(batches):
        for batch in pieces(batches, "_text"):
            rows = [r.tobytes() for r in features(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_order"), batch.column("_y"), pa.array(rows, pa.binary())], names=["_order", "_y", "_f"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").select("_order", "_y", "_text")
    rows = rows.mapInArrow(extract, "_order long, _y int, _f binary").groupBy("_order").agg(F.min(F.struct("_y", "_f")).alias("r")).select("_order", "r._y", "r._f")

    def learn(batches):
        table = pa.Table.from_batches(list(batches), pa.schema([("_order", pa.int64()), ("_y", pa.int32()), ("_f", pa.binary())])).sort_by("_order")
        good = table["_y"].to_numpy() == 1
        kept = [np.frombuffer(f, np.int32) for f in table["_f"].to_pylist()]
        weights = fit(kept, good) if good.any() and not good.all() else np.zeros((1 << BITS) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["w"])

    return np.frombuffer(rows.repartition(1).mapInArrow(learn, "w binary").first().w, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with columns score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5).

    Whole texts are scored; null counts as empty, which has a score too.  Columns named score or predicted
    are replaced, others pass.
    """
    configure(docs.sparkSession)
    docs = docs.drop("score", "predicted")

    def run(batches):
        w = weights.astype(np.float64)
        for batch in pieces(batches, text_col):
            margin = np.array([w[f].sum() / np.sqrt(len(f)) + w[-1] for f in features(batch, text_col)])
            value = 1 / (1 + np.exp(-np.clip(SLOPE * margin, -700, 700)))
            yield with_columns(batch, {"score": pa.array(value), "predicted": pa.array((value >= 0.5).astype(np.int32))})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
