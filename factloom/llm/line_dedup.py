"""Lines that many documents repeat, dropped but for one place.

Two Bloom filters hold the hashes of line keys seen once and seen twice.  Only documents with a key in
the second filter take part in any shuffle: their suspected keys are confirmed exactly (distinct
documents and largest doc_id per key, combined before the shuffle), and what has to go comes back by
row.  All other rows pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from factloom.llm import filters
from factloom.llm.common import configure, with_columns, written

BLANK = b" \t\n\x0b\x0c\r"


def key_of(line: bytes, shortest: int) -> bytes | None:
    """The line stripped and with A-Z in lower case; None if it has fewer than ``shortest`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < shortest or not key.isascii() and len(key.decode()) < shortest:
        return None
    return key


def keys_of(text: str | None, shortest: int) -> set[bytes]:
    found = {key_of(line, shortest) for line in (text or "").encode().split(b"\n")}
    found.discard(None)
    return found


def _hash(keys) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(k, digest_size=8).digest() for k in keys), np.uint64)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 20, least_docs: int = 3, bits: int = 27, probes: int = 3
) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, and columns n_lines (before), n_dropped (long).

    A key of at least ``shortest`` code points that occurs in at least ``least_docs`` distinct ids stays
    only in rows with the largest id that holds it.  Null or empty text: one empty line, returned as ''.
    Rows with a null id count as no document and lose repeated lines; rows with the same id are one
    document and keep or lose a line together.  Columns named n_lines or n_dropped are replaced, others
    pass.  ``bits``: log2 of the slots of the filters; fewer only mean more suspects.
    """
    configure(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for text in batch.column(0):
                yield _hash(keys_of(text.as_py(), shortest))

    path = filters.build(docs.select(text_col), hashes, "lines", bits, probes, 2)

    def repeats(batches):
        """Batches with the suspected keys of each text."""
        twice = filters.load(path, bits, 1)
        for batch in batches:
            found = []
            for text in batch.column(text_col):
                keys = sorted(keys_of(text.as_py(), shortest))
                hit = filters.seen(twice, _hash(keys), bits, probes) if keys else []
                found.append([k.decode() for k, h in zip(keys, hit) if h])
            yield batch, found

    def suspects(batches):
        for batch, found in repeats(batches):
            yield with_columns(batch, {"_suspects": pa.array(found, pa.list_(pa.string()))})

    def clean(batches):
        """Rows without a suspected line: nothing goes."""
        for batch, found in repeats(batches):
            batch = batch.filter(pa.array([not f for f in found], pa.bool_()))
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            new = {"n_lines": pa.array([t.count("\n") + 1 for t in texts], pa.int64()), "n_dropped": pa.array([0] * len(texts), pa.int64())}
            yield with_columns(batch, {text_col: pa.array(texts, pa.string()), **new})

    marked = docs.mapInArrow(suspects, T.StructType([*docs.schema.fields, T.StructField("_suspects", T.ArrayType(T.StringType()))]))
    held = written(marked.where("size(_suspects) > 0").withColumn("_row", F.monotonically_increasing_id()), "suspects")
    lines = held.select("_row", F.col(id_col).alias("_id"), F.explode("_suspects").alias("_key"))
    firsts = lines.groupBy("_key").agg(F.countDistinct("_id").alias("_n"), F.max("_id").alias("_keeper")).where(F.col("_n") >= least_docs)
    firsts = written(firsts.drop("_n"), "repeated")  # its size decides how it is joined
    gone = (
        lines.join(firsts, "_key").where(F.col("_id").isNull() | (F.col("_id") < F.col("_keeper")))
        .groupBy("_row").agg(F.collect_list("_key").alias("_gone"))
    )
    rest = held.drop("_suspects").join(gone, "_row", "left").drop("_row")

    def rewrite(batches):
        for batch in batches:
            texts, before, dropped = [], [], []
            for text, keys in zip(batch.column(text_col), batch.column("_gone")):
                text, keys = text.as_py() or "", keys.as_py()
                lines = text.split("\n")
                n = len(lines)
                if keys:
                    out = {k.encode() for k in keys}
                    lines = [x for x in lines if key_of(x.encode(), shortest) not in out]
                    text = "\n".join(lines)
                texts.append(text)
                before.append(n)
                dropped.append(n - len(lines))
            kept = batch.select([c for c in batch.schema.names if c != "_gone"])
            yield with_columns(kept, {text_col: pa.array(texts, pa.string()), "n_lines": pa.array(before, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return docs.mapInArrow(clean, schema).unionByName(rest.mapInArrow(rewrite, schema))
