"""Filters over the hashes of a whole corpus, built by Spark and kept in the shared folder.

Each task turns its hashes into slot numbers, counts them and emits the counts per slice of the slot
range; slices are added up independently and written as rows (slice, counts).  Nothing passes the
driver.  The size is a parameter: it bounds what a task loads.  A filter that is too small for the
corpus lets more hashes through to the exact step behind it, and never hides a repeated one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

from factloom.llm.common import scratch
from factloom.llm.kernels import U, mix

SLICES = 64
#: Slot numbers a task gathers before it emits them.
GATHER = 1 << 21


def slots(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """``probes`` slot numbers below 2^bits for each hash, one row per probe."""
    step = mix(hashes ^ U(0x5851F42D4C957F2D)) | U(1)
    return np.stack([(hashes + U(i) * step) >> U(64 - bits) for i in range(probes)]).astype(np.uint32)


def _emit(gathered: list[np.ndarray], bits: int, most: int) -> pa.RecordBatch:
    found, counts = np.unique(np.concatenate(gathered), return_counts=True)
    counts = np.minimum(counts, most).astype(np.uint8)
    cuts = np.searchsorted(found, np.arange(SLICES + 1, dtype=np.int64) << (bits - 6))
    rows: dict[str, list] = {"slice": [], "slots": [], "counts": []}
    for k in range(SLICES):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            steps = np.diff(found[a:b], prepend=np.uint32(k << (bits - 6))).astype("<u4")
            rows["slice"].append(k)
            rows["slots"].append(zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
            rows["counts"].append(zlib.compress(counts[a:b].tobytes(), 1))
    return pa.RecordBatch.from_arrays(
        [pa.array(rows["slice"], pa.int32()), pa.array(rows["slots"], pa.binary()), pa.array(rows["counts"], pa.binary())],
        names=list(rows),
    )


def build(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], name: str, bits: int, probes: int, most: int, wanted: tuple[int, ...] = (1, 2)) -> str:
    """Path of the counts of all hashes that ``hashes`` yields for the rows of ``df``, none above ``most``.

    With ``most`` = 2 they are two Bloom filters: slots seen once and slots seen twice (``wanted``: those that are
    kept).  Else they are kept as
    levels of four bits: 0, 1, 2 to 3, 4 to 7, and so on up to 255.
    """

    def gather(batches):
        kept, n = [], 0
        for some in hashes(batches):
            if len(some):
                kept.append(slots(some, bits, probes).ravel())
                n += len(kept[-1])
            if n >= GATHER:
                yield _emit(kept, bits, most)
                kept, n = [], 0
        if kept:
            yield _emit(kept, bits, most)

    def add(batches):
        width = 1 << (bits - 6)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, where, counts in zip(*(c.to_pylist() for c in batch.columns)):
                total = sums.setdefault(k, np.zeros(width, np.uint8))
                steps = np.frombuffer(zlib.decompress(where), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                at = np.cumsum(steps, dtype=np.int64)
                more = total[at].astype(np.uint16) + np.frombuffer(zlib.decompress(counts), np.uint8)
                total[at] = np.minimum(more, most)
        for k, total in sums.items():
            planes = [np.packbits(total >= i).tobytes() for i in wanted] if most == 2 else [packed_levels(total).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([planes], pa.list_(pa.binary()))], names=["slice", "planes"])

    path = scratch(df.sparkSession, name)
    parts = df.mapInArrow(gather, "slice int, slots binary, counts binary")
    parts.repartition(SLICES, "slice").mapInArrow(add, "slice int, planes array<binary>").write.parquet(path)
    return path


def load(path: str, bits: int, plane: int) -> np.ndarray:
    """The packed slots of one of two Bloom filters.  They go with the task that asked for them: a Python worker
    outlives its stage, and its executor pays for what it keeps."""
    out = np.zeros((1 << bits) // 8, np.uint8)
    part = len(out) // SLICES
    for k, planes in slices(path):
        out[k * part : (k + 1) * part] = np.frombuffer(planes[len(planes) - 1 if plane else 0].as_buffer(), np.uint8)
    return out


def slices(path: str) -> Iterator[tuple[int, pa.Array]]:
    """(number, planes) of the slices of a filter, one after the other."""
    where, folder = fs.FileSystem.from_uri(path)
    for f in where.get_file_info(fs.FileSelector(folder)):
        if f.base_name.startswith("part-"):
            for batch in pq.ParquetFile(f.path, filesystem=where).iter_batches(batch_size=1, use_threads=False):
                for k, planes in zip(batch.column("slice").to_pylist(), batch.column("planes")):
                    yield k, planes.values


def seen(plane: np.ndarray, hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Whether all slots of a hash are set in a plane of a Bloom filter."""
    at = slots(hashes, bits, probes)
    return np.logical_and.reduce([(plane[s >> 3] >> (7 - (s & 7))) & 1 for s in at]).astype(bool)


def levels_of(path: str, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Level of each hash's count, which is the true count at least: 0 and 1 are exact bounds.

    The filter is read slice by slice, and of many hashes at once those of a slice are looked up in it: a task holds
    one slice, however large the filter is.
    """
    at = slots(hashes, bits, 1)[0]
    of = (at >> np.uint32(bits - 6)).astype(np.uint8)
    inside = np.uint32((1 << (bits - 6)) - 1)
    out = np.zeros(len(at), np.uint8)
    for k, planes in slices(path):
        mine = np.flatnonzero(of == k)
        plane, slot = np.frombuffer(planes[0].as_buffer(), np.uint8), at[mine] & inside
        out[mine] = (plane[slot >> 1] >> ((slot & 1) << 2).astype(np.uint8)) & 15
    return out


def packed_levels(counts: np.ndarray) -> np.ndarray:
    """Two levels to a byte: how many binary digits each count has."""
    level = np.zeros(len(counts), np.uint8)
    for digit in range(8):
        level[counts >= (1 << digit)] = digit + 1
    return level[::2] | (level[1::2] << 4)
