"""Approximate nearest neighbours by learned partitions.

On a bounded sample the neighbour graph is built and cut into balanced parts; a small classifier learns
the part of a vector.  It then puts every row of the table into a part and routes each query to its most
probable parts, whose rows are compared exactly.  How many parts a query visits is set on rows of the sample that
were held out of the fit, so that the wanted share of their true neighbours is found.

A query visits its first parts, which settles most of its answer; the later ones only tell what beats the last
of it.  So what is compared is many times what is handed on, which grows with the queries and not with the parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import configure, with_columns, written
from factloom.llm.vectors import matrix, usable

#: Rows and queries that meet in one task at a time.
ROWS, QUERIES = 4096, 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product of each row."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        near = x[a : a + 1024] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        out[a : a + 1024] = np.take_along_axis(top, order, 1)
    return out


def neighbours_of(x: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of largest inner product of the rows ``asked``, without themselves."""
    k = min(k, len(x) - 1)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    return np.argpartition(-near, k - 1, axis=1)[:, :k]


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """Part of each row: most edges inside parts, no part above ``slack`` times the mean size."""
    rng = np.random.Generator(np.random.PCG64(3))
    limit = int(np.ceil(len(x) / parts * slack))
    centres = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(6):
        near = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        for p in range(parts):
            if (near == p).any():
                centres[p] = x[near == p].mean(0)
    score = x @ centres.T - 0.5 * (centres**2).sum(1)
    part, size = np.full(len(x), -1), np.zeros(parts, np.int64)
    for i in np.argsort(-score.max(1), kind="stable"):
        for p in np.argsort(-score[i], kind="stable"):
            if size[p] < limit:
                part[i], size[p] = p, size[p] + 1
                break
    both = [[*row] for row in graph.tolist()]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            both[j].append(i)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(part[both[i]], minlength=parts)
            best = int(np.argmax(votes))
            if votes[best] > votes[part[i]] and size[best] < limit:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def fit_classifier(x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, rounds: int = 30) -> list[np.ndarray]:
    """One hidden layer and softmax, fitted by Adam."""
    rng = np.random.Generator(np.random.PCG64(5))
    shapes = [(x.shape[1], hidden), (hidden,), (hidden, parts), (parts,)]
    w = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in shapes]
    w[0] /= max(1e-12, np.sqrt((x**2).sum(1).mean() / x.shape[1]))
    m, v, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    rate = [0.01 * max(1e-12, np.abs(w[0]).mean()), 0.01, 0.01, 0.01]
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a : a + 256]
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            p = softmax(h @ w[2] + w[3])
            p[np.arange(len(rows)), part[rows]] -= 1
            p /= len(rows)
            back = (p @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= rate[i] * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(model: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return softmax(np.maximum(x @ model[0] + model[1], 0) @ model[2] + model[3])


def visits(model: list[np.ndarray], x: np.ndarray, asked: np.ndarray, near: np.ndarray, recall: float) -> int:
    """Fewest parts a query has to visit to find ``recall`` of its neighbours ``near`` (rows of x), on average."""
    part = probabilities(model, x).argmax(1)
    p = probabilities(model, asked)
    place = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1)
    at = place[np.arange(len(asked))[:, None], part[near]]
    found = np.cumsum(np.bincount(at.ravel(), minlength=p.shape[1])) / at.size
    return min(int(np.searchsorted(found, recall)) + 1, p.shape[1])


def nearest(
    rows: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20,
    sample: int = 16_384, part_rows: int = 1024, most_parts: int = 256, recall: float = 0.94, first_parts: int = 4,
) -> DataFrame:
    """(query_id, rank from 1, id_col, score): the ``top`` rows of largest inner product found for each query.

    Candidates are all rows but those with the query's id; if there are fewer than ``top``, all are returned.
    Equal scores: smaller id first.  Scores are inner products of the given vectors in double precision.
    Rows without id, or whose vector is null, zero, or holds null or non-finite components, take no part.
    A query searches the rows whose vectors are as long as its own.  A query id that repeats is searched once,
    with its smallest vector.

    A partitioning is learned for each length on ``sample`` rows (smallest hash of the id first), one row in eight
    held out; all rows are indexed.  Parts have about ``part_rows`` rows; a smaller table has eight, or so many that
    they have 64 (below 128 rows there is one, which is the whole), a larger one than the sample can cut has
    ``most_parts``.  ``recall``: share of the held-out rows' neighbours that the visited parts have to hold;
    ``first_parts``: how many a query visits before only better rows are handed on.
    """
    spark = rows.sparkSession
    configure(spark)
    valid = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = valid(rows).withColumn("d", F.size("v"))
    asked = valid(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    out = f"query_id long, rank int, {id_col} long, score double"
    lengths = {r.d: r["count"] for r in rows.groupBy("d").count().collect()}
    if not lengths:
        return spark.createDataFrame([], out)

    def learned(size: int, n: int) -> tuple[list[np.ndarray], int, int]:
        """Classifier, number of parts and parts to visit, for the rows of one length."""
        parts = int(np.clip(max(-(-n // part_rows), min(8, n // 64)), 1, most_parts))

        def learn(batches):
            x = matrix(pa.Table.from_batches(list(batches)).column("v"), size)
            kept = len(x) - len(x) // 8 if len(x) >= 512 else len(x)
            k = max(1, min(parts, kept // 8))
            graph = neighbour_graph(x[:kept], min(top, 10)) if kept > 1 else np.zeros((1, 0), np.int64)
            model = fit_classifier(x[:kept], balanced_parts(x[:kept], graph, k), k)
            asked = np.arange(kept, len(x)) if kept < len(x) else np.arange(len(x))
            near = neighbours_of(x, asked, top) if len(x) > 1 else np.zeros((1, 0), np.int64)
            depth = visits(model, x, x[asked], near, recall) if near.size else 1
            yield pa.RecordBatch.from_arrays([pa.array([[w.tobytes() for w in model]], pa.list_(pa.binary())), pa.array([k]), pa.array([depth])], names=["w", "k", "depth"])

        chosen = rows.where(F.col("d") == size).orderBy(F.xxhash64("id"), "id").limit(sample).select("v")
        fitted = chosen.repartition(1).mapInArrow(learn, "w array<binary>, k long, depth long").first()
        k = fitted.k
        return [np.frombuffer(w).reshape(s) for w, s in zip(fitted.w, ((size, -1), (-1,), (-1, k), (k,)))], k, fitted.depth

    models = {size: learned(size, n) for size, n in sorted(lengths.items()) if n >= 128}

    def by_length(batch):
        """(length, places, matrix) of the vectors in a batch that have a model."""
        d = batch.column("d").to_numpy()
        for size in np.unique(d).tolist():
            if size in models:
                at = np.flatnonzero(d == size)
                yield size, at, matrix(batch.column("v").take(pa.array(at)), size)

    def assign(batches):
        for batch in batches:
            best = np.zeros(batch.num_rows, np.int32)
            for size, at, x in by_length(batch):
                best[at] = probabilities(models[size][0], x).argmax(1)
            yield with_columns(batch, {"part": pa.array(best, pa.int32())})

    kind = valid(queries).schema["v"].dataType.simpleString()
    placed = written(rows.mapInArrow(assign, f"id long, v {rows.schema['v'].dataType.simpleString()}, d int, part int"), "parts")
    held = {size: np.zeros(k, np.int64) for size, (_, k, _) in models.items()}
    for r in placed.groupBy("d", "part").count().collect():  # at most ``most_parts`` rows a length
        if r.d in held:
            held[r.d][r.part] = r["count"]

    def route(batches):
        for batch in batches:
            parts, later = [np.zeros(1, np.int32)] * batch.num_rows, [np.zeros(0, np.int32)] * batch.num_rows
            for size, at, x in by_length(batch):
                model, k, depth = models[size]
                order = np.argsort(-probabilities(model, x), axis=1, kind="stable").astype(np.int32)
                enough = (np.cumsum(held[size][order], axis=1) < top + 1).sum(1) + 1
                use = np.minimum(np.maximum(enough, depth), k)
                begin = np.minimum(np.maximum(enough, first_parts), use)
                for i, o, f, u in zip(at.tolist(), order, begin, use):
                    parts[i], later[i] = o[:f], o[f:u]
            kind = pa.list_(pa.int32())
            yield with_columns(batch, {"parts": pa.array(parts, kind), "later": pa.array(later, kind)})

    routed = written(asked.mapInArrow(route, f"id long, v {kind}, d int, parts array<int>, later array<int>"), "routed")

    def compare(rows_of: pa.Table, queries_of: pa.Table) -> pa.Table:
        ids, asks = rows_of.column("id").to_numpy(), queries_of.column("id").to_numpy()
        found = []
        if len(ids) and len(asks):
            size = rows_of.column("d")[0].as_py()
            x, q = matrix(rows_of.column("v"), size), matrix(queries_of.column("v"), size)
            by_id = np.argsort(ids, kind="stable")
            ids, x = ids[by_id], x[by_id]
            scores = q @ x.T
            beats = queries_of.column("t").to_numpy()
            room = 1e-12 * np.sqrt((q**2).sum(1) * max((x**2).sum(1).max(), 1e-300))
            for i, ask in enumerate(asks):
                mine = scores[i]
                mine[ids == ask] = -np.inf
                near = np.flatnonzero((mine >= beats[i] - room[i]) & (mine > -np.inf))
                if len(near) > top:
                    least = np.partition(mine[near], -top)[-top]
                    near = near[mine[near] >= least - room[i]]
                exact = (x[near] * q[i]).sum(1)  # the same sum for the same vectors, in any block
                best = np.lexsort((ids[near], -exact))[:top]
                found.append((np.full(len(best), ask), ids[near][best], exact[best]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    numbered = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    keys = ["d", "part", "rb", "qb"]

    def compared(visiting: DataFrame) -> DataFrame:
        """(query_id, id, score) of the rows of the visited parts.  Parts of any size: rows and queries of a part meet in blocks."""
        blocks = lambda df, most, name: df.groupBy("d", "part").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
        many = F.broadcast(blocks(placed, ROWS, "nr").join(blocks(visiting, QUERIES, "nq"), ["d", "part"]))
        left = placed.join(many, ["d", "part"]).select("d", "part", block("nr").alias("rb"), numbered("nq").alias("qb"), "id", "v")
        right = visiting.join(many, ["d", "part"]).select("d", "part", block("nq").alias("qb"), numbered("nr").alias("rb"), "id", "v", "t")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, id long, score double")

    at_first = routed.select("id", "v", "d", F.explode("parts").alias("part"), F.lit(float("-inf")).alias("t"))
    found = written(best_of(compared(at_first), top), "found")
    # A query whose answer is not full yet takes whatever comes.
    last = found.where(F.col("rank") == top).select(F.col("query_id").alias("id"), F.col("score").alias("t"))
    then = routed.select("id", "v", "d", F.explode("later").alias("part")).join(last, "id", "left").fillna(float("-inf"), ["t"])
    both = found.drop("rank").unionByName(compared(then))
    return best_of(both, top).select("query_id", "rank", F.col("id").alias(id_col), "score")


def best_of(pairs: DataFrame, top: int) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
