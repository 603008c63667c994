import random
from datetime import datetime, timedelta

import pytest

from factloom.operators import requests, trainlog

T0 = datetime(2024, 1, 1)


def make_log(spark, rows):
    data = [(i, s, T0 + timedelta(seconds=t), float(e), c, st) for i, (s, t, e, c, st) in enumerate(rows)]
    return spark.createDataFrame(data, "request_id long, service string, start_ts timestamp, elapsed_s double, status_code int, status string")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for i in range(1500):
        hot = i % 3 == 0  # a third of all requests take exactly the same time
        out.append(("a" if i % 10 else "b", r.randrange(20000), 2.0 if hot else r.choice([0.01, 0.5, 3.0, 40.0]) * r.random(), r.choice([200, 200, 500]), "ok"))
    return out


def test_percentiles_against_sorting(spark, rows):
    got = {(r.service, r.p): r.elapsed_s for r in requests.latency_percentiles(make_log(spark, rows)).collect()}
    for s in ("a", "b"):
        values = sorted(float(e) for x, _, e, _, _ in rows if x == s)
        for p in (0.5, 0.9, 0.99):
            assert got[(s, p)] == values[min(len(values) - 1, int(len(values) * p))]


def test_percentile_rule_on_twenty(spark):
    log = make_log(spark, [("a", i, i, 200, "ok") for i in range(20)])
    assert {r.p: r.elapsed_s for r in requests.latency_percentiles(log).collect()} == {0.5: 10.0, 0.9: 18.0, 0.99: 19.0}


def test_percentiles_beyond_the_sketch(spark, monkeypatch):
    """With a coarse sketch the bracket leaves values out on both sides; the result stays exact."""
    monkeypatch.setattr(requests, "SKETCH_ACCURACY", 50)
    r = random.Random(2)
    values = [r.expovariate(1) for _ in range(5000)] + [1.0] * 2500
    log = make_log(spark, [("a", 0, v, 200, "ok") for v in values])
    got = {x.p: x.elapsed_s for x in requests.latency_percentiles(log).collect()}
    values.sort()
    assert got == {p: values[int(len(values) * p)] for p in (0.5, 0.9, 0.99)}


def test_inflight_against_counting(spark, rows):
    got = {(r.service, r.ts): r.inflight for r in requests.inflight_requests(make_log(spark, rows)).collect()}
    spans = [(s, T0 + timedelta(seconds=t), T0 + timedelta(seconds=t) + timedelta(microseconds=round(e * 1e6))) for s, t, e, _, _ in rows]
    for (s, ts), n in random.Random(1).sample(sorted(got.items()), 200):
        assert n == sum(a <= ts < b for x, a, b in spans if x == s)


def test_summaries(spark, rows):
    log = make_log(spark, rows)
    by = {r.service: r for r in requests.success_failure(log).collect()}
    assert by["a"].success_count + by["a"].failure_count == sum(r[0] == "a" for r in rows)
    empty = requests.latency_summary(log.filter("false"), by=None).collect()[0]
    assert tuple(empty) == (0.0, 0.0, 0.0)
    one = requests.throughput(make_log(spark, [("z", 0, 0, 200, "ok")])).collect()[0]
    assert one.per_second == 0.0
    places = sorted((f.service, f.place, f.start_ts, f.request_id) for f in requests.failures(log).collect())
    assert len(places) == sum(r[3] != 200 for r in rows)
    for s in ("a", "b"):
        mine = [p for p in places if p[0] == s]
        assert [p[1] for p in mine] == list(range(1, len(mine) + 1)) and [p[2:] for p in mine] == sorted(p[2:] for p in mine)
    hist = {r.le: r.cumulative for r in requests.latency_histogram(log).filter("service = 'a'").collect()}
    assert hist["+Inf"] == by["a"].success_count + by["a"].failure_count
    assert hist["2.5"] == sum(r[0] == "a" and r[2] <= 2.5 for r in rows)


def test_null_service_and_run_are_groups(spark, rows):
    log = make_log(spark, [(None if r[0] == "b" else r[0], *r[1:]) for r in rows])
    named = make_log(spark, rows)
    for f in (requests.latency_percentiles, requests.inflight_requests, requests.peak_concurrency, requests.failures):
        got = sorted((tuple("b" if v is None else v for v in r) for r in f(log).drop("status_code").collect()), key=str)
        assert got == sorted(map(tuple, f(named).drop("status_code").collect()), key=str)
    series = spark.range(9).selectExpr("cast(null as string) run", "id pos", "id step", "cast(id as double) loss")
    assert trainlog.downsample(series).count() == 50 and trainlog.levels(series).count() == 50


def test_running_sums_in_blocks(spark):
    from factloom.functions.running import sums_before

    r = random.Random(3)
    given = {(k, b): r.randrange(10) for k in ("x", None) for b in r.sample(range(-500, 500), 90)}
    df = spark.createDataFrame([(k, b, n) for (k, b), n in given.items()], "k string, b long, n long")
    got = {(x.k, x.b): x.before for x in sums_before(df, ["k"], "b", "n", width=7).collect()}
    assert got == {(k, b): sum(n for (k2, b2), n in given.items() if k2 == k and b2 < b) for k, b in given}


LOG_SCHEMA = ("run string, pos long, step long, loss double, mean_token_accuracy double, entropy double, eval_loss double, "
              "train_runtime double, train_loss double, rewards_chosen double, rewards_rejected double, rewards_margins double")


def entry(pos, run="r", **values):
    names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    return tuple({**dict.fromkeys(names), "run": run, "pos": pos, **values}[n] for n in names)


def test_train_log(spark):
    log = spark.createDataFrame(
        [
            entry(0, step=5, loss=4.0, rewards_chosen=1.0, rewards_rejected=0.25),
            entry(1, loss=2.0),
            entry(2, step=10, loss=1.0, rewards_chosen=2.0, rewards_rejected=1.0, rewards_margins=9.0),
            entry(3, step=10, eval_loss=0.5, loss=7.0),
            entry(4, train_runtime=60.0, train_loss=3.0, eval_loss=1.0),
            entry(5, train_runtime=120.0, train_loss=2.0),
            entry(6, step=11),
        ],
        LOG_SCHEMA,
    )
    assert [r.kind for r in trainlog.classify(log).orderBy("pos").collect()] == ["train"] * 3 + ["eval"] + ["summary"] * 2 + ["ignored"]
    series = trainlog.train_series(log).orderBy("pos").collect()
    assert [(r.step, r.loss, r.entropy) for r in series] == [(5, 4.0, 0.0), (0, 2.0, 0.0), (10, 1.0, 0.0)]
    assert [r.margin for r in trainlog.reward_series(log).orderBy("pos").collect()] == [0.75, None, 9.0]
    red = trainlog.loss_reduction(log).collect()[0]
    assert (red.first_loss, red.last_loss, red.reduction_pct) == (4.0, 1.0, 75.0)
    run = trainlog.run_summary(log).collect()[0]
    assert (run.runtime_min, run.final_loss, run.max_step, run.train_entries) == (2.0, 2.0, 10, 3)


@pytest.mark.parametrize("n", [1, 7, 50, 10001])
def test_downsample(spark, n):
    log = spark.range(n).selectExpr("'r' run", "id * 3 pos", "id step", "cast(id as double) loss", "0.0D mean_token_accuracy", "0.0D entropy")
    got = {r.col: r.step for r in trainlog.downsample(log).collect()}
    assert got == {i: round(i * (n - 1) / 49) for i in range(50)}


def test_levels(spark):
    log = spark.range(50).selectExpr("'r' run", "id pos", "id step", "cast(id as double) loss", "1.0D mean_token_accuracy")
    got = {r.col: r.level for r in trainlog.levels(log).collect()}
    assert got == {i: max(0, min(7, round((1 - i / 49) * 7))) for i in range(50)}
    flat = {r.level for r in trainlog.levels(log, "mean_token_accuracy", lower_is_better=False).collect()}
    assert flat == {7}


def test_percentiles_of_any_range_from_one_sketch(spark):
    """Groups without name, equal, negative, zero and missing values; hours, days and a range of three hours."""
    from pyspark.sql import functions as F

    r = random.Random(9)
    data = [("a" if i % 3 else None, T0 + timedelta(minutes=r.randrange(60 * 40)), r.choice([0.0, 2.0, -1.5, r.random(), r.random() * 1e-9, r.random() * 1e12])) for i in range(4000)]
    data += [("a", None, 1.0), ("a", T0, None), ("c", T0, 7.0)]
    log = spark.createDataFrame(data, "service string, start_ts timestamp, elapsed_s double").repartition(6)
    sketch = requests.rank_sketch(log)
    assert sketch.agg(F.sum("n")).first()[0] == 4001
    low, high = T0 + timedelta(hours=3), T0 + timedelta(hours=6)
    inside = lambda t: F.when((t >= F.lit(low)) & (t < F.lit(high)), F.lit(low))
    hour = lambda t: t.replace(minute=0)
    for start_of, plain in (
        (lambda t: F.date_trunc("hour", t), hour), (lambda t: F.date_trunc("day", t), lambda t: hour(t).replace(hour=0)),
        (inside, lambda t: low if low <= t < high else None),
    ):
        groups = {}
        for s, t, e in data:
            if t is not None and e is not None and plain(t) is not None:
                groups.setdefault((s, plain(t)), []).append(e)
        expected = {(*k, p): sorted(v)[min(len(v) - 1, int(len(v) * p))] for k, v in groups.items() for p in requests.PERCENTILES}
        got = {(x.service, x.start, x.p): x.elapsed_s for x in requests.percentiles_over(sketch, log, start_of).collect()}
        assert got == expected
    assert requests.percentiles_over(sketch, log, lambda t: F.lit(None).cast("timestamp")).collect() == []


def test_buckets_rise_with_the_value(spark):
    from pyspark.sql import functions as F

    values = sorted([-1e300, -2.0, -1.001, -1.0, -1e-300, 0.0, 5e-324, 1e-9, 1.0, 1.0005, 1.002, 3.0, 1e300])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", requests.value_bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in df.orderBy("v").collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) >= 10
