"""Near-duplicate vectors by cross-polytope hashing, with verified pairs.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform; the largest
component and its sign are one hash.  ``hashes`` of them make a bucket number, in each of ``tables``
tables, and a vector goes to its ``probes`` nearest buckets in each.  All pairs that share a bucket are
compared exactly, once, in the first bucket they share; only counts and a star of links leave the task.
Vectors of each length are hashed and compared among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import configure, ragged, written
from factloom.llm.components import components
from factloom.llm.vectors import matrix, usable

#: Vectors of a bucket that are compared in one task at a time.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (the width is a power of two), scaled to keep lengths."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def bucket_numbers(unit: np.ndarray, tables: int, hashes: int, probes: int, seed: int = 11) -> np.ndarray:
    """Ascending bucket numbers of each unit vector, ``tables`` * ``probes`` of them."""
    width = 1 << max(2, (unit.shape[1] - 1).bit_length())  # probing takes three components
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    rng = np.random.Generator(np.random.PCG64(seed))
    choices = np.array(list(product(range(3), repeat=hashes)))
    out = []
    for table in range(tables):
        codes, losses = [], []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :3]
            top = np.take_along_axis(size, best, 1)
            codes.append(2 * best + (np.take_along_axis(y, best, 1) < 0))
            losses.append((top[:, :1] - top) ** 2)
        loss = sum(losses[h][:, choices[:, h]] for h in range(hashes))
        pick = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        number = np.full(pick.shape, table, np.int64)
        for h in range(hashes):
            number = number * (2 * width) + np.take_along_axis(codes[h], choices[:, h][pick], 1)
        out.append(number)
    return np.sort(np.concatenate(out, axis=1), axis=1)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, of batches that are ordered by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows - 1, bool)
        for key in keys:
            column = table.column(key).to_numpy()
            change |= column[1:] != column[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield table.slice(a, b - a)
        rest = table.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number each of ``n`` places reaches by the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93,
    tables: int = 10, hashes: int = 2, probes: int = 3,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) of each row.

    Rows link when their labels are equal and not null, their vectors equally long and the cosine, in double
    precision, is at least ``least``.  n_links counts other rows linked directly, component_id is the smallest id reachable, kept
    says whether that is the row's own.  Vectors that are null, zero or hold null or non-finite components
    link with nothing, like rows without label or id.  Rows may repeat: equal vectors with equal labels are
    compared once and counted as often as they occur.
    Pairs that share no bucket are missed; recall is measured in the tests.
    """
    spark = rows.sparkSession
    configure(spark)
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    good = usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    keys = {"k1": F.when(good, F.xxhash64("label", "v")), "k2": F.when(good, F.xxhash64(F.lit(7), "v", "label"))}
    keyed = given.withColumns(keys)
    kind, label_kind = given.schema["v"].dataType.simpleString(), given.schema["label"].dataType.simpleString()
    classes = keyed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v"))

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.list_value_length(batch.column("v")).to_numpy()
            for size in np.unique(lengths).tolist():
                some = batch.filter(pa.array(lengths == size))
                x = matrix(some.column("v"), size)
                # Scaled by the largest component first: squares of tiny or huge ones stay in range.
                x /= np.abs(x).max(1, keepdims=True)
                numbers = bucket_numbers(x / np.sqrt((x**2).sum(1, keepdims=True)), tables, hashes, probes)
                codes = ragged(numbers.ravel(), np.full(len(numbers), numbers.shape[1]), pa.int64())
                yield pa.RecordBatch.from_arrays([*some.columns, codes], names=[*some.schema.names, "codes"])

    schema = f"k1 long, k2 long, least long, m long, label {label_kind}, v {kind}, codes array<long>"
    classes = written(classes.mapInArrow(place, schema).withColumn("c", F.monotonically_increasing_id()), "vectors")
    members = classes.select("label", F.size("v").alias("d"), "c", F.explode("codes").alias("code"))
    full = written(members.groupBy("label", "d", "code").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("c"), F.col("nb")).cast("int")
    split = (
        members.join(full, ["label", "d", "code"]).withColumn("nb", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("c", "d", F.xxhash64("label", "d", "code", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "code", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    meeting = split.join(classes.select("c", "label", "m", "v", "codes"), "c").repartition("g").sortWithinPartitions("g", "label", "d", "code", "lo", "hi")

    def compare(batches):
        found: list[tuple] = []
        n = 0
        for group in _groups(batches, ["g", "label", "d", "code", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            x = matrix(group.column("v"), group.column("d")[0].as_py())
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x**2).sum(1, keepdims=True))
            near = x @ x.T >= least - 1e-12
            lo, hi, code = (group.column(k)[0].as_py() for k in ("lo", "hi", "code"))
            if lo != hi:
                side = group.column("own").to_numpy() == lo
                near &= side[:, None] & ~side[None, :]
                a, b = np.nonzero(near)
            else:
                a, b = np.nonzero(np.triu(near, 1))
            keep = np.einsum("ij,ij->i", x[a], x[b]) >= least
            a, b = a[keep], b[keep]
            if len(a):
                codes = group.column("codes").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
                first = np.empty(len(a), bool)
                for s in range(0, len(a), 8192):
                    one, two = codes[a[s : s + 8192]], codes[b[s : s + 8192]]
                    shared = (one[:, :, None] == two[:, None, :]).any(2)
                    first[s : s + 8192] = one[np.arange(len(one)), shared.argmax(1)] == code
                a, b = a[first], b[first]
            if len(a):
                c, m = group.column("c").to_numpy(), group.column("m").to_numpy()
                count = np.bincount(a, weights=m[b], minlength=len(c)) + np.bincount(b, weights=m[a], minlength=len(c))
                some = np.flatnonzero(count)
                found.append((c[some], count[some].astype(np.int64), c[_roots(len(c), a, b)[some]]))
                n += len(some)
            if n > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found)], names=["c", "n", "root"])
                found, n = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in zip(*found)], names=["c", "n", "root"])

    linked = written(meeting.mapInArrow(compare, "c long, n long, root long"), "links")
    counts = linked.groupBy("c").agg(F.sum("n").alias("n"))
    parts = components(linked, "c", "root").select(F.col("node").alias("c"), "component")
    told = classes.select("c", "k1", "k2", "least", "m").join(counts, "c", "left").join(parts, "c", "left")
    told = written(told.withColumns({"component": F.coalesce("component", "c"), "n_links": F.coalesce("n", F.lit(0)) + F.col("m") - 1}), "classes")
    names = told.groupBy("component").agg(F.min("least").alias("component_id"))
    named = told.join(names, "component").select("k1", "k2", "n_links", "component_id")
    known = keyed.where("k1 IS NOT NULL").select("id", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = keyed.where("k1 IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = known.union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
