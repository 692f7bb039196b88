"""What the operators that work on Arrow batches share."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which all executors share; it goes when the driver ends.

    Where that is unset, as in local tests, the warehouse folder serves; on a cluster
    that raises ValueError, as the warehouse may be a folder of one machine only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name storage that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/vellum-{uuid.uuid4().hex}"
    path, fs = _on_storage(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes tables whose readers have all been written themselves."""
    for folder in folders:
        path, fs = _on_storage(spark, folder)
        fs.delete(path, True)


def _on_storage(spark: SparkSession, folder: str) -> tuple:
    """(path, file system) of a folder, as Hadoop has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, after which its Python worker gives back the memory that it no longer uses; workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows with about ``most`` bytes of text each; null becomes empty.

    Only one run's Python strings exist at a time. A longer text is a run of its own.
    """
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, [t or "" for t in col.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, [t or "" for t in col.slice(start).to_pylist()]


def table_of(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(k).type) for k, c in columns.items()], schema=schema)


WIDE_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
MIX, MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MORE
    return (x ^ (x >> np.uint64(27))) * MIX


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the texts' words in lower case, where each text's begin and the end). Words end at white space."""
    lines = [(WIDE_SPACE.sub(" ", t) if WIDE_SPACE.search(t) else t).lower().encode("utf-8", "surrogatepass") for t in texts]
    whole = b"\n".join(lines) + b"\n" + bytes(8)
    size = len(whole) - 8
    space = SPACE[np.frombuffer(whole, np.uint8, size)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    loads = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))
    length = ends - starts
    h = mixed(length.astype(np.uint64) + MIX)
    left, at = np.arange(len(starts)), 0
    while len(left):
        h[left] = mixed(h[left] ^ (loads[starts[left] + at] & MASKS[np.minimum(length[left] - at, 8)]))
        at += 8
        left = left[length[left] > at]
    return h, np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]))
