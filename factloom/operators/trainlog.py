"""Training-log analytics.

A log is a table of entries (run, pos, step, loss, mean_token_accuracy, entropy, eval_loss,
train_runtime, train_loss and, for preference runs, rewards_chosen, rewards_rejected,
rewards_margins); which values are present tells the kind of an entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from factloom.functions.running import join_keys, sums_before

POSITIONS_PER_BLOCK = 4096


def classify(log: DataFrame) -> DataFrame:
    """Add ``kind``: summary, eval, train or ignored, in this order of precedence."""
    return log.withColumn(
        "kind",
        F.when(F.col("train_runtime").isNotNull(), "summary")
        .when(F.col("eval_loss").isNotNull(), "eval")
        .when(F.col("loss").isNotNull(), "train")
        .otherwise("ignored"),
    )


def train_series(log: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return classify(log).filter(F.col("kind") == "train").select(
        "run", "pos", F.coalesce("step", F.lit(0).cast("bigint")).alias("step"), "loss",
        zero("mean_token_accuracy"), zero("entropy"),
    )


def eval_series(log: DataFrame) -> DataFrame:
    return classify(log).filter(F.col("kind") == "eval").select(
        "run", "pos", F.coalesce("step", F.lit(0).cast("bigint")).alias("step"), "eval_loss"
    )


def reward_series(log: DataFrame) -> DataFrame:
    """Rewards of train entries; an absent margin is chosen minus rejected.  Values stay with
    their entry, so a gap does not shift later ones."""
    margin = F.coalesce("rewards_margins", F.col("rewards_chosen") - F.col("rewards_rejected"))
    return classify(log).filter(F.col("kind") == "train").select(
        "run", "pos", F.coalesce("step", F.lit(0).cast("bigint")).alias("step"), "loss",
        F.col("rewards_chosen").alias("chosen"), F.col("rewards_rejected").alias("rejected"), margin.alias("margin"),
    )


def loss_reduction(log: DataFrame) -> DataFrame:
    """First and last loss and token accuracy of each run, and the reduction in percent."""
    ends = train_series(log).groupBy("run").agg(
        F.min_by("loss", "pos").alias("first_loss"), F.max_by("loss", "pos").alias("last_loss"),
        F.min_by("mean_token_accuracy", "pos").alias("first_accuracy"),
        F.max_by("mean_token_accuracy", "pos").alias("last_accuracy"),
        F.count("*").alias("entries"),
    )
    first, last = F.col("first_loss"), F.col("last_loss")
    reduction = F.when(first != 0, (first - last) / first * 100).otherwise(0.0)
    return ends.withColumn("reduction_pct", F.round(reduction, 4))


def run_summary(log: DataFrame) -> DataFrame:
    """Runtime, final loss and steps per run; the last summary entry of a run counts."""
    is_kind = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    per_run = classify(log).groupBy("run").agg(
        F.max_by("train_runtime", is_kind("summary", "pos")).alias("runtime"),
        F.max_by("train_loss", is_kind("summary", "pos")).alias("final_loss"),
        F.max(is_kind("train", "step")).alias("max_step"),
        F.count_if(F.col("kind") == "train").alias("train_entries"),
    )
    return per_run.select(
        "run", F.round(F.coalesce("runtime", F.lit(0.0)) / 60, 4).alias("runtime_min"), "final_loss",
        F.coalesce("max_step", F.lit(0).cast("bigint")).alias("max_step"), "train_entries",
    )


def total_runtime(log: DataFrame) -> DataFrame:
    """Runtime over all runs."""
    return run_summary(log).agg(F.round(F.sum("runtime_min"), 4).alias("runtime_min"), F.count("*").alias("runs"))


def numbered(series: DataFrame, order: str = "pos") -> DataFrame:
    """Add ``idx``, the 0-based place of an entry within its run.

    Positions are unique within a run, so a block of 4,096 positions holds at most as many
    entries: entries are counted per block, the running total over blocks gives each block its
    first place, and entries are ranked inside their block only.
    """
    block = F.floor(F.col(order) / POSITIONS_PER_BLOCK)
    blocks = series.groupBy("run", block.alias("block")).agg(F.count("*").alias("n"))
    first = sums_before(blocks, ["run"], "block", "n")
    inside = F.row_number().over(W.partitionBy("run", "block").orderBy(order)) - 1
    placed = join_keys(series.withColumn("block", block).withColumn("inside", inside), first, ["run", "block"])
    return placed.withColumn("idx", F.col("before") + F.col("inside")).drop("block", "before", "inside")


def downsample(series: DataFrame, value: str = "loss", width: int = 50) -> DataFrame:
    """(run, col, step, value): ``width`` points per run at places ``round(i * (n - 1) / (width - 1))``,
    half to even.  Short series repeat points."""
    sizes = series.groupBy("run").agg(F.count("*").alias("n"))
    place = lambda i: F.bround(i * (F.col("n") - 1) / F.lit(width - 1), 0).cast("bigint")
    wanted = sizes.select("run", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"), "n").select(
        "run", "col", place(F.col("col")).alias("idx")
    )
    return join_keys(numbered(series), wanted, ["run", "idx"]).select("run", "col", "step", F.col(value).alias("value"))


def levels(
    series: DataFrame, value: str = "loss", width: int = 50, height: int = 8, lower_is_better: bool = True
) -> DataFrame:
    """Down-sampled points with their row in a chart of ``height`` rows (row 0 on top).  Scaling
    is by the least and greatest value of the whole series; a flat series counts as range 1."""
    span = series.groupBy("run").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    high = F.when(F.abs(F.col("high") - F.col("low")) < 1e-9, F.col("low") + 1.0).otherwise(F.col("high"))
    norm = (F.col("value") - F.col("low")) / (high - F.col("low"))
    top = height - 1
    row = F.bround((1 - norm) * top, 0) if lower_is_better else F.lit(top) - F.bround(norm * top, 0)
    level = F.greatest(F.lit(0), F.least(F.lit(top), row.cast("int")))
    return join_keys(downsample(series, value, width), span, ["run"]).select("run", "col", "step", "value", level.alias("level"))


def _four(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.4f", value))


def sft_step_table(log: DataFrame) -> DataFrame:
    return train_series(log).select(
        "run", "pos", "step", _four(F.col("loss")).alias("loss"),
        _four(F.col("mean_token_accuracy")).alias("token_accuracy"), _four(F.col("entropy")).alias("entropy"),
    )


def dpo_step_table(log: DataFrame) -> DataFrame:
    """Step rows of a preference run; an entry without rewards shows 0."""
    shown = lambda c: _four(F.coalesce(c, F.lit(0.0))).alias(c)
    return reward_series(log).select(
        "run", "pos", "step", _four(F.col("loss")).alias("loss"), shown("chosen"), shown("rejected"), shown("margin")
    )
