"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is wanted target / source size times.  The whole copies in that number are
certain; for the rest documents are ranked by their random odds over their inclusion odds, and the first
ones are taken until the target's words are reached.  No source is ever ordered in one task: ranks are
cut by sums over 4,096 buckets, then over 4,096 buckets of the bucket at the cut, and only what lies in
that one is ordered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from factloom.functions.running import totals_before
from factloom.llm.common import configure, text_bytes, written
from factloom.llm.kernels import _BLANK

BUCKETS = 4096
SEED = "mix"


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Number of words of each whole text; null has none."""
    raw, at = text_bytes(text)
    first = ~_BLANK[raw]
    edge = at[(at > 0) & (at < len(raw))]
    begins = first[edge]
    first[1:] &= _BLANK[raw[:-1]]
    first[edge] = begins
    return pa.array(np.diff(np.append(0, np.cumsum(first))[at]), pa.int64())


def draw(id_col: Column) -> Column:
    """A number in [0, 1) that hangs on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(2**48))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, total, target) from rows (source, size): one row per source, null among them.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all words; none gets
    more than ``most`` times its own, and what that leaves is shared again by weight.  A source is at its
    limit if limit / weight is at most the level that all sources up to it in that order leave.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("total"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    rows = totals.withColumn("weight", weight).withColumn("ratio", most * F.col("total") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    rows = rows.withColumns({
        "all": F.sum("total").over(W.partitionBy()),
        "before": F.coalesce(F.sum("total").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "behind": F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)),
    })
    rows = rows.withColumn("full", F.col("ratio") <= (share * F.col("all") - most * F.col("before")) / F.col("behind"))
    whole = W.partitionBy()
    level = F.try_divide(
        share * F.col("all") - most * F.sum(F.when(F.col("full"), F.col("total")).otherwise(0)).over(whole),
        F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole),
    )
    return rows.select("source", "total", F.when(F.col("full"), most * F.col("total").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2,
) -> DataFrame:
    """``docs`` with columns size (words), source_size, target, copies, taken (= copies * size).

    The mix takes each row ``copies`` times (0 and ``most`` at most); a source's taken words miss its target
    by half of its largest document at most.  Null or empty text: size 0.  Null is a source of its
    own.  Draws hang on the id, a null id draws as the word ``null``; rows that agree in id and size stand side by side in
    the order, and where the target ends among them as many as fit are taken, by a hash of the text.  Columns of
    these names are replaced, others pass.  Runs agree.
    """
    configure(docs.sparkSession)
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    keys = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    drawn = {"size": word_count("text"), "u": draw(F.col("id"))}
    rows = written(keys.withColumns(drawn).drop("text"), "sizes")
    plan = written(targets(rows, weights, share, most), "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])

    def joined(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        b = b.withColumnRenamed("source", "_source")
        return a.join(b, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")

    wanted = F.coalesce(F.try_divide("target", F.col("total").cast("double")), F.lit(0.0))
    share_of = wanted - F.floor(wanted)
    odds = F.when(share_of > 0, (F.col("u") / (1 - F.col("u"))) * ((1 - share_of) / share_of))
    spot = (odds / (1 + odds)) * BUCKETS
    ranks = {"sure": F.floor(wanted), "q": odds, "b1": F.floor(spot).cast("int"), "b2": F.floor((spot - F.floor(spot)) * BUCKETS).cast("int")}
    need = (F.col("target") - F.floor(wanted) * F.col("total")).alias("need")
    ranked = joined(rows, plan).withColumns(ranks)
    state = plan.select("source", need, F.lit(0).cast("long").alias("base"))

    def cut(rows: DataFrame, bucket: str, state: DataFrame) -> DataFrame:
        """The bucket where the need is passed (null if never), and the words before it."""
        sums = joined(rows.where("q IS NOT NULL").groupBy("source", bucket).agg(F.sum("size").alias("words")), state)
        run = F.col("base") + F.sum("words").over(W.partitionBy("source").orderBy(bucket))
        over = sums.withColumn("run", run).where("run > need").groupBy("source").agg(F.min(F.struct(bucket, (F.col("run") - F.col("words")).alias("base"))).alias("c"))
        return written(joined(state.drop("base"), over.select("source", f"c.{bucket}", "c.base"), "left"), "cut")

    state = cut(ranked, "b1", state)
    first = state.select("source", F.col("b1").alias("c1"))
    state = cut(joined(ranked, first).where("b1 = c1").drop("c1"), "b2", state.select("source", "need", "b1", "base"))
    at = joined(ranked, state.select("source", "need", "base", F.col("b1").alias("c1"), F.col("b2").alias("c2"))).where("b1 = c1 AND b2 = c2")
    key = F.struct("q", "id", "size")
    # Rows that agree in rank and size are one group with a count; the need may end inside it.
    groups = at.groupBy("source", "need", "base", "q", "id", "size").agg(F.count("*").alias("m"))
    order = W.partitionBy("source").orderBy("q", F.col("id").asc_nulls_first(), "size")
    groups = groups.withColumn("run", F.col("base") + F.sum(F.col("size") * F.col("m")).over(order))
    last = groups.where("run <= need").groupBy("source").agg(F.max(key).alias("last"), F.max("run").alias("reached"))
    begun = F.col("run") - F.col("size") * F.col("m")
    fitting = F.floor((F.col("need") - begun) / F.col("size"))
    partial = groups.where((begun <= F.col("need")) & (F.col("need") < F.col("run"))).select(
        "source", key.alias("partial"), fitting.alias("fitting"), (begun + fitting * F.col("size")).alias("reached_in")
    )
    state = joined(joined(state.withColumnsRenamed({"b1": "c1", "b2": "c2"}), last, "left"), partial, "left")
    state = written(state.withColumn("reached", F.coalesce("reached_in", "reached", "base", F.lit(0))).drop("reached_in"), "cut")

    chosen = F.coalesce(
        F.col("q").isNotNull() & (
            F.col("c1").isNull() | (F.col("b1") < F.col("c1"))
            | ((F.col("b1") == F.col("c1")) & (F.col("c2").isNull() | (F.col("b2") < F.col("c2")) | ((F.col("b2") == F.col("c2")) & (key <= F.col("last")))))
        ),
        F.lit(False),
    )
    told = joined(ranked, state).withColumn("chosen", chosen)
    # One more document, the one whose size closes the gap best, if that is nearer to the target.
    gap = F.col("need") - F.col("reached")
    miss = F.abs(F.col("size") - gap)
    closing = told.where(~F.col("chosen") & F.col("q").isNotNull() & F.col("c1").isNotNull() & (miss < gap))
    closing = closing.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "q", "id", "size")).alias("m"))
    closing = closing.select("source", F.struct("m.q", "m.id", "m.size").alias("key"), F.lit(1).cast("long").alias("take"))
    # Groups of which some rows are taken: at most two a source.
    some = state.where("fitting > 0").select("source", F.col("partial").alias("key"), F.col("fitting").alias("take")).union(closing)
    some = written(some.groupBy("source", "key").agg(F.sum("take").alias("take")).withColumnRenamed("source", "_source"), "some")
    copies = ranked.where("q IS NOT NULL").join(F.broadcast(some), F.col("source").eqNullSafe(F.col("_source")) & key.eqNullSafe(F.col("key")))
    copies = copies.groupBy("source", "key", "take").agg(F.count("*").alias("m"))
    some = written(copies.groupBy("source").agg(F.collect_list(F.struct("key", "take", "m")).alias("some")), "some")
    final = written(joined(joined(plan, state, "left"), some, "left"), "plan")

    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    whole = joined(whole.withColumns({**drawn, "h": F.xxhash64("text")}).drop("text"), final).withColumns(ranks)
    mine = F.get(F.filter("some", lambda s: s["key"].eqNullSafe(key)), F.lit(0))
    whole = whole.withColumns({"chosen": chosen, "mine": mine}).drop("some", "last", "partial").withColumnRenamed("total", "source_size")
    inside = F.coalesce(F.col("mine.take") < F.col("mine.m"), F.lit(False))
    more = F.col("chosen") | (F.col("mine").isNotNull() & ~inside)
    whole = whole.withColumn("extra", F.when(more, 1).otherwise(0))
    if not final.where(F.exists("some", lambda s: s["take"] < s["m"])).isEmpty():
        # Rows of a group that is taken in part are numbered, however many they are.
        group = {"group": F.struct("source", "q", "id", "size"), "one": F.lit(1)}
        numbered = totals_before(whole.where(inside).withColumns(group), "group", [F.asc("h")], "one")
        numbered = numbered.withColumn("extra", F.when(F.col("before") < F.col("mine.take"), 1).otherwise(0))
        whole = whole.where(~inside).unionByName(numbered.select(*whole.columns))
    taken = F.col("sure") + F.col("extra")
    return whole.withColumn("copies", taken.cast("int")).select(
        "doc.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )
