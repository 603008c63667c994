import gzip
import hashlib
import io

from factloom.llm import warc
from factloom.llm.common import scratch

LONG = "x" * 60 + "é" * 20  # 100 bytes


def rows():
    inner = gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n").decode("latin-1")
    return [
        (5, "http://a/1", LONG), (3, "http://a/2 with blank\n", LONG), (9, None, LONG), (9, None, LONG), (None, "http://n", LONG), (1, "ü", LONG[:-1]), (2, "u", LONG[:-1]),
        (4, "http://e", ""), (6, "http://null", None), (7, "http://nested", inner), (8, "http://long", "line\r\n\r\n" * 50_000), (10, "http://long2", "line\r\n\r\n" * 50_000),
        (None, "n", None), (12, "k", "k" * 100), (11, "k", "k" * 100),
    ]


def expected(given):
    out, first = [], {}
    for i, _, html in given:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            first[raw] = min(first.get(raw, i), i)
    for i, _, html in given:
        raw = (html or "").encode()
        one = first.get(raw)
        kind = "revisit" if one is not None and one != i else "response"
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), kind, one if kind == "revisit" else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    given = rows() + [(100 + k, f"http://p/{k}", f"<p>{k}</p>" * (k % 40)) for k in range(300)]
    df = spark.createDataFrame([(*r, "more") for r in given], "page_id long, url string, html string, payload string").repartition(3)
    files = warc.write_archives(df, scratch(spark, "warc"))
    assert files.agg({"records": "sum"}).first()[0] == len(given)
    for split in (1000, 1 << 24):
        got = warc.read_archives(files, split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(given)
        for r in got:
            if r.record_type == "response":
                assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes


def test_other_members_are_no_records():
    """Members without a record's header, and magic bytes anywhere, are passed over."""
    one = warc.record(1, "http://a", "text", "0", None, "x", "2000-01-01T00:00:00Z")
    raw = gzip.compress(b"no record") + warc.MAGIC + gzip.compress(one) + b"\x1f\x8b\x08\x00" + gzip.compress(one)
    for split in (1, 7, 100, 10_000):
        found = [m for begin in range(0, len(raw), split) for m in warc.members(io.BytesIO(raw), begin, min(begin + split, len(raw)), len(raw))]
        assert found == [one, one]


def test_empty_table(spark):
    files = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), scratch(spark, "warc"))
    assert warc.read_archives(files).collect() == []


def test_revisits_name_the_record_they_stand_for(spark, folder):
    import glob

    rows = [(i, f"http://x/{i}", "same payload " * 20) for i in (7, 3, 5)] + [(4, None, "short"), (None, "http://n", "same payload " * 20), (3, "http://x/3", "same payload " * 20)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{folder}/a")
    names, refers = [], []
    for path in glob.glob(f"{folder}/a/*.warc.gz"):
        for line in gzip.open(path).read().decode().split("\r\n"):
            if line.startswith("WARC-Record-ID: "):
                names.append(line.split(": ", 1)[1])
            elif line.startswith("WARC-Refers-To: "):
                refers.append(line.split(": ", 1)[1])
    assert len(names) == 6 and len(refers) == 3 and set(refers) <= set(names) and len(set(names)) == 5
