"""Exact join of documents by the Jaccard similarity of their word n-grams, in its metric space.

Jaccard distance obeys the triangle inequality, so a pivot's distances bound those between documents.
Most documents of a corpus share nothing and lie at distance 1 from any pivot; regions around random
pivots would then all overlap.  Regions are therefore cells of the finest pivots there are, single
n-grams in an order from rare to frequent: linked documents share one of the first
``n - ceil(threshold * n) + 1`` of each, so each document is replicated into the regions of that window
and no link is lost.  A counting filter gives the order and leaves out n-grams that occur once.

Inside a region the most central document is the pivot.  Its distances settle most documents (linked to
the pivot: same component); only documents of different components go on, to the pivots of their other
regions, and at last to each other inside the triangle-inequality window |d(x,p) - d(y,p)| <= 1 -
threshold: pair by pair in regions of few, in blocks that give only links in regions of many.  Components, not
pairs, are the result, so groups of copies never become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm import filters
from factloom.llm.common import configure, pieces, ragged, text_bytes, written
from factloom.llm.components import components
from factloom.llm.kernels import _BASES, Words, prefix, spans


#: Hashes that are looked up in the filter at once.
LOOKED_UP = 3 << 20
#: Regions of at most so many documents are joined by rows, others in blocks of so many documents and hashes.
FEW, BLOCK, BLOCK_HASHES = 32, 512, 1 << 21


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Ascending distinct hashes of the ``size``-word shingles of each text; a shorter text is one."""
    begin, hashes = words.windows(size)
    cuts = np.searchsorted(begin, words.at)
    lengths = np.diff(words.at)
    whole = spans(words.sums(), words.at[:-1], words.at[1:], _BASES[1])
    return [
        np.unique(hashes[cuts[i] : cuts[i + 1]]) if lengths[i] >= size else whole[i : i + 1] if lengths[i] else hashes[:0]
        for i in range(words.texts)
    ]


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, p, d, link) of the given pairs, from the whole sets."""
    left = sets.select(F.col("_row").alias("x"), F.col("_set").alias("_sx"))
    right = sets.select(F.col("_row").alias("p"), F.col("_set").alias("_sp"))
    both = pairs.select("x", "p").join(left, "x").join(right, "p")
    same = F.size(F.array_intersect("_sx", "_sp"))
    sized = both.select("x", "p", same.alias("_i"), (F.size("_sx") + F.size("_sp") - same).alias("_u"))
    return sized.select("x", "p", (1 - F.col("_i") / F.col("_u")).alias("d"), (100 * F.col("_i") >= percent * F.col("_u")).alias("link"))


def linked(block: pa.Table, percent: int) -> pa.Table:
    """Links (x, p) between the documents of two blocks of a region, as far as they join different components.  A pair that
    shares an earlier region meets there."""
    h, lo, hi = (block.column(c)[0].as_py() for c in ("h", "lo", "hi"))
    x, n, i, part, b = (block.column(c).to_numpy() for c in ("x", "n", "i", "part", "b"))
    d = block.column("d").to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
    lists = lambda c: [v.values.to_numpy() for v in block.column(c)]
    sets, earlier = lists("_set"), []
    sets = [np.sort(s.view(np.uint64)) for s in sets]
    for head in lists("_head"):
        earlier.append(set(head[: int(np.flatnonzero(head == h)[0])].tolist()))
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while root.get(k, k) != k:
            k = root[k]
        return k

    found: list[tuple[int, int]] = []
    second = np.flatnonzero(b == hi)
    for one in np.flatnonzero(b == lo).tolist():
        rest = np.minimum(n[one] - i[one], n[second] - i[second])
        fits = (part[second] != part[one]) & ((100 + percent) * rest >= percent * (n[one] + n[second]))
        fits &= ~(np.abs(d[one] - d[second]) > (100 - percent) / 100 + 1e-9)
        if lo == hi:
            fits &= x[second] > x[one]
        for two in second[fits].tolist():
            if find(part[one]) == find(part[two]) or not earlier[one].isdisjoint(earlier[two]):
                continue
            small, large = sorted((sets[one], sets[two]), key=len)
            same = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
            if 100 * same >= percent * (len(small) + len(large) - same):
                root[find(part[one])] = find(part[two])
                found.append((x[one], x[two]))
    return pa.table({name: pa.array([pair[k] for pair in found], pa.int64()) for k, name in enumerate(("x", "p"))})


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bits: int = 28
) -> DataFrame:
    """(id_col, n_shingles, component_id) of each row of ``docs``.

    Words are runs of bytes other than blank and \\x09-\\x0D, A-Z in lower case; a row's set holds its
    distinct ``size``-word shingles, or its whole word sequence if it has fewer words.  Rows link when
    100 * intersection >= ``percent`` * union; component_id is the smallest id reachable by links.
    Null and empty texts have the empty set, n_shingles 0, and link with nothing.  Rows with a null id
    link like others but never name a component; alone, theirs is null.  Rows may repeat; other columns
    are ignored.  ``bits``: log2 of the counters of the filter, best some more than there are shingles; fewer only mean
    more candidates.
    """
    configure(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def hashes(batches) -> Iterator[np.ndarray]:
        for batch in pieces(batches, "_text"):
            yield np.concatenate(shingle_sets(Words(*text_bytes(batch.column("_text")), lower=True), size))

    path = filters.build(narrow.select("_text"), hashes, "shingles", bits, 1, 255)

    def sets_of(batches):
        """Rows of the sets; those of some texts are looked up in the filter at once."""
        held, n = [], 0
        for batch in pieces(batches, "_text"):
            held.append((batch.column("_id"), shingle_sets(Words(*text_bytes(batch.column("_text")), lower=True), size)))
            n += sum(map(len, held[-1][1]))
            if n >= LOOKED_UP:
                yield from rows_of(held)
                held, n = [], 0
        if held:
            yield from rows_of(held)

    def rows_of(held):
        levels = filters.levels_of(path, bits, np.concatenate([s for _, sets in held for s in sets]))
        none, at = np.zeros(0, np.int64), 0
        for ids, sets in held:
            a, b, mean, heads, places, kept = [], [], [], [], [], []
            for s in sets:
                n = len(s)
                if not n:
                    a.append(None), b.append(None), mean.append(0.0)
                    heads.append(none), places.append(none), kept.append(none)
                    continue
                ends = np.array([0]), np.array([n])
                for base, out in ((1, a), (2, b)):
                    out.append(int(spans(prefix(s, _BASES[base]), *ends, _BASES[base]).view(np.int64)[0]))
                often = levels[at : at + n]
                at += n
                head = np.lexsort((s, often))[: n - (percent * n + 99) // 100 + 1]
                place = np.flatnonzero(often[head] > 1)
                head = s[head[place]]
                mean.append(float(often.mean()))
                heads.append(head.view(np.int64))
                places.append(place)
                kept.append(s.view(np.int64) if len(head) else none)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(mean, pa.float64()),
                    *(ragged(np.concatenate(some), [len(x) for x in some], pa.int64()) for some in (heads, places, kept)),
                ],
                names=["_id", "_n", "_a", "_b", "_mean", "_head", "_place", "_set"],
            )

    schema = f"_id {kind}, _n long, _a long, _b long, _mean double, _head array<long>, _place array<long>, _set array<long>"
    rows = written(narrow.mapInArrow(sets_of, schema).withColumn("_row", F.monotonically_increasing_id()), "sets")

    # One class per distinct set, known by its first row.
    classes = written(rows.where("_n > 0").groupBy("_a", "_b").agg(F.min("_id").alias("_least"), F.min("_row").alias("_row")), "classes")
    sets = rows.where("size(_head) > 0").join(classes.select("_row"), "_row")
    region = sets.select(F.explode(F.arrays_zip("_head", "_place")).alias("r"), F.col("_row").alias("x"), F.col("_n").alias("n"), F.col("_mean").alias("mean"))
    region = region.select(F.col("r._head").alias("h"), "x", "n", F.col("r._place").alias("i"), "mean")
    pivots = (
        region.groupBy("h").agg(F.count("*").alias("k"), F.max(F.struct("mean", (-F.col("x")).alias("nx"), "n", "i")).alias("top")).where("k > 1")
        .select("h", (-F.col("top.nx")).alias("p"), F.col("top.n").alias("np"), F.col("top.i").alias("ip"), F.col("top.mean").alias("pm"))
    )
    regions = written(region.drop("mean").join(written(pivots, "pivots"), "h"), "regions")

    def able(n: str, i: str, m: str, j: str):
        """Whether sets of sizes n and m whose first common n-gram has places i and j can be alike enough;
        at later common ones less is left, so a pair that can be linked passes at its first."""
        rest = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
        return (100 + percent) * rest >= percent * (F.col(n) + F.col(m))

    # Each document to the pivot that it shares most regions with.
    near = regions.where((F.col("x") != F.col("p")) & able("n", "i", "np", "ip")).groupBy("x", "p").agg(F.count("*").alias("c"), F.max("pm").alias("pm"))
    cell = near.groupBy("x").agg(F.max(F.struct("c", "pm", "p")).alias("t")).select("x", "t.p")
    tested = written(_verified(cell, sets, percent), "tested")

    def divided(tested: DataFrame) -> DataFrame:
        """Rows of the regions that still hold different components, with these."""
        parts = components(tested.where("link"), "x", "p").select(F.col("node").alias("x"), "component")
        told = regions.join(parts, "x", "left").withColumn("part", F.coalesce("component", "x")).drop("component")
        split = told.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("h")
        return told.join(written(split, "split"), "h")

    # The pivots of the other regions, for documents not yet in the pivot's component.
    left = divided(tested)
    left = written(left, "left")
    part_of_pivot = written(left.where("x = p").select("h", F.col("part").alias("pp")), "pivots")
    pairs = left.join(part_of_pivot, "h").where((F.col("part") != F.col("pp")) & able("n", "i", "np", "ip")).select("x", "p").distinct()
    pairs = pairs.join(tested, ["x", "p"], "left_anti")
    tested = written(tested.union(_verified(pairs, sets, percent)), "tested")

    # What is still apart, document by document inside the windows of the region's pivot.
    left = divided(tested).join(tested.select("x", "p", "d"), ["x", "p"], "left")
    left = written(left.select("h", "x", "n", "i", "part", F.when(F.col("x") == F.col("p"), 0.0).otherwise(F.col("d")).alias("d")), "apart")
    held = left.groupBy("h").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    held = written(held.withColumn("nb", F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("w") / BLOCK_HASHES)).cast("int")), "held")
    few = left.join(held.where(F.col("k") <= FEW).select("h"), "h")
    other = few.select("h", F.col("x").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("part").alias("part_y"), F.col("d").alias("d_y"))
    window = F.coalesce(F.abs(F.col("d") - F.col("d_y")) <= (100 - percent) / 100 + 1e-9, F.lit(True))
    pairs = few.join(other, "h").where((F.col("x") < F.col("y")) & (F.col("part") != F.col("part_y")) & able("n", "i", "m", "j") & window)
    pairs = pairs.select("x", F.col("y").alias("p")).distinct()
    for done in (tested.select("x", "p"), tested.select(F.col("p").alias("x"), F.col("x").alias("p"))):
        pairs = pairs.join(done, ["x", "p"], "left_anti")
    links = tested.where("link").select("x", "p").union(_verified(pairs, sets, percent).where("link").select("x", "p"))

    # Regions of many: blocks of their documents meet with their sets, and only links come out, no more than join components.
    many = left.join(held.where(F.col("k") > FEW).select("h", "nb"), "h").withColumn("b", F.pmod(F.xxhash64("x"), F.col("nb")).cast("int"))
    many = many.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    many = many.select("h", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), "b", "x", "n", "i", "part", "d")
    many = many.join(sets.select(F.col("_row").alias("x"), "_head", "_set"), "x")

    def meet(block: pa.Table) -> pa.Table:
        return linked(block, percent)

    links = links.union(many.groupBy("h", "lo", "hi").applyInArrow(meet, "x long, p long"))

    parts = components(links, "x", "p").select(F.col("node").alias("_row"), "component")
    told = classes.join(parts, "_row", "left").withColumn("component", F.coalesce("component", "_row"))
    names = told.groupBy("component").agg(F.min("_least").alias("component_id"))
    named = told.join(names, "component").select("_a", "_b", "component_id")
    of_sets = rows.where("_n > 0").select("_id", "_n", "_a", "_b").join(named, ["_a", "_b"])
    out = of_sets.select("_id", "_n", "component_id").union(rows.where("_n = 0").select("_id", "_n", F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), "component_id")
