import hashlib
import random

from factloom.llm.mixing import mix
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, size int"


def targets(totals, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by repeated sharing: whoever is above the limit gets it, the rest share again."""
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        rest = share * sum(totals.values()) - sum(most * totals[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > most * totals[s]}
        if not over:
            return {s: most * totals[s] if s in full else level * weight[s] for s in order}
        full |= over


def check(spark, rows, gap):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(4)
    got = mix(df).collect()
    assert len(got) == len(rows)
    totals, taken = {}, {}
    for r in got:
        totals[r.source] = totals.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.size == len(brute.words(r.text)) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
    want = targets(totals)
    for r in got:
        assert r.source_size == totals[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.copies in (int(r.target // max(1, r.source_size)), int(r.target // max(1, r.source_size)) + 1)
    for s in totals:
        assert abs(taken[s] - want[s]) <= gap, s
    # The whole choice, by one sort per source.
    for s in totals:
        mine = sorted((draw(r.doc_id), -1 if r.doc_id is None else r.doc_id, r.size) for r in got if r.source == s)
        sure, need = divmod(want[s], totals[s]) if totals[s] else (0, 0)
        need, run, first = want[s] - sure * totals[s], 0, set()
        for k in mine:
            if need < 1e-9 or run + k[2] > need:
                break
            run += k[2]
            first.add(k)
        extra = {(draw(r.doc_id), -1 if r.doc_id is None else r.doc_id, r.size) for r in got if r.source == s and r.copies > sure}
        assert len(extra - first) <= 1 and not first - extra
    again = mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def draw(i):
    return int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:12], 16) / 2**48


def test_same_as_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.choice([1, 5, 9, 50, 200, 1000]), rng.choice(["a", "a", "a", "b", "é", "z", None, "A"])) for k in range(1500)]
    check(spark, rows, 500)


def test_odd_rows(spark):
    rows = [(1, None, "only empty"), (2, "", "only empty"), (None, "a b c", "n"), (None, "a b c d", "n"), (7, "w " * 9, "m"), (7, "w " * 9, "m"), (8, "w " * 30_000, None)]
    check(spark, rows, 15_000)
    check(spark, [(1, None, None)], 0)


def test_rows_that_repeat_are_counted(spark):
    """Many rows without id, many copies of one id: as many are taken as fit."""
    for rows in (
        [(None, "a b c", "s")] * 1000,
        [(5, "a b c", "s")] * 300 + [(100 + k, "d e f", "s") for k in range(700)],
        [(5, "a b c", "s")] * 300 + [(5, "a b c d e", "s")] * 300 + [(9, "w " * 40, "t")] * 50 + [(None, None, "t")] * 20,
    ):
        df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5)
        got = mix(df).collect()
        assert len(got) == len(rows)
        for source in {r[2] for r in rows}:
            mine = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2
            assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in mine)
        assert sorted(map(str, mix(df.repartition(3)).collect())) == sorted(map(str, got))


def test_empty_table(spark):
    out = mix(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"] and out.collect() == []
