"""Binary key-value records and headed vectors, read and written byte for byte.

Files are read in ranges of whole records, so that a file of any size is spread
over tasks; each task writes files of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.plans.storage import stable

KINDS = {"int8": "int", "uint8": "int", "int16": "int", "uint16": "int", "int32": "int", "uint32": "long", "int64": "long", "uint64": "long", "float32": "float", "float64": "double"}
HEADER = np.dtype([("size", "<u8"), ("count", "<u8")])
#: Bytes of a file that one row of the plan reads.
RANGE = 32 * 1024 * 1024


def _record(key: str, value: str | None) -> np.dtype:
    kinds = [("key", np.dtype(key).newbyteorder("<"))]
    return np.dtype(kinds if value is None else [*kinds, ("value", np.dtype(value).newbyteorder("<"))])


def _frame(records: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({n: records[n].view("<i8") if records.dtype[n] == np.dtype("<u8") else records[n].astype(records.dtype[n].newbyteorder("=")) for n in records.dtype.names})


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI and the path in it; Spark writes ``file:/x`` for local files."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path)


def read_pairs(spark: SparkSession, path: str | list[str], key: str = "uint32", value: str | None = "uint32", headed: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """Packed records key (value) of each file; 64-bit unsigned keys come signed.

    With ``headed`` a file begins with the record size and the number of records,
    8 bytes each; another size, and a file cut short, raise ``ValueError``.
    """
    record = _record(key, value)
    head = HEADER.itemsize if headed else 0
    step = max(1, range_bytes // record.itemsize) * record.itemsize
    schema = f"key {KINDS[key]}" if value is None else f"key {KINDS[key]}, value {KINDS[value]}"
    # Lengths alone: the content isn't read for this plan.
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    last = F.greatest(F.col("length") - 1, F.lit(head))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(head).cast("long"), last.cast("long"), F.lit(step).cast("long"))).alias("start"))
    counted = stable(ranges)

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in frame.itertuples(index=False):
                store, inside = _store(x.path)
                with store.open_input_file(inside) as source:
                    if headed and x.start == head:
                        first = np.frombuffer(source.read(head), HEADER)
                        if len(first) != 1 or first["size"][0] != record.itemsize:
                            raise ValueError(f"{x.path}: elements don't have {record.itemsize} bytes")
                        if x.length - head != record.itemsize * int(first["count"][0]):
                            raise ValueError(f"{x.path}: not {first['count'][0]} elements")
                    if (x.length - head) % record.itemsize:
                        raise ValueError(f"{x.path}: not a whole number of records")
                    source.seek(x.start)
                    yield _frame(np.frombuffer(source.read(min(step, max(0, x.length - x.start))), record))

    return counted.repartition(max(1, counted.count())).mapInPandas(parse, schema)


def packed(frame: pd.DataFrame, record: np.dtype) -> bytes:
    """The frame's records side by side without padding."""
    out = np.empty(len(frame), record)
    for name in record.names:
        column = frame[name].to_numpy()
        out[name] = column.view(np.uint64) if record[name] == np.dtype("<u8") else column
    return out.tobytes()


def encoded(rows: DataFrame, key: str = "uint32", value: str | None = "uint32", headed: bool = False) -> DataFrame:
    """part, piece, content: the packed records of each partition, a piece an Arrow batch."""
    record = _record(key, value)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for piece, frame in enumerate(frames):
            head = np.array([(record.itemsize, len(frame))], HEADER).tobytes() if headed else b""
            yield pd.DataFrame({"part": [part], "piece": [piece], "content": [head + packed(frame, record)]})

    return rows.select(*record.names).mapInPandas(pack, "part int, piece int, content binary")


def write_pairs(rows: DataFrame, folder: str, key: str = "uint32", value: str | None = "uint32", headed: bool = False) -> DataFrame:
    """Writes one packed file a task to ``folder``, which all executors share; path, records of each.

    With ``headed`` a file begins with the record size and the number of records.
    Only files that the result names count: a task that is run again writes under
    another name.  A partition without rows writes an empty file.
    """
    record = _record(key, value)
    shared, top = _store(folder)
    shared.create_dir(top, recursive=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [packed(frame, record) for frame in frames] if headed else None
        store, root = _store(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        count = 0
        with store.open_output_stream(f"{root}/{name}") as out:
            if parts is not None:
                count = sum(map(len, parts)) // record.itemsize
                out.write(np.array([(record.itemsize, count)], HEADER).tobytes())
                for part in parts:
                    out.write(part)
            else:
                for frame in frames:
                    out.write(packed(frame, record))
                    count += len(frame)
        yield pd.DataFrame({"path": [f"{folder.rstrip('/')}/{name}"], "records": [count]})

    return stable(rows.select(*record.names).mapInPandas(write, "path string, records long"))


def write_table(rows: DataFrame, path: str, files: int | None = None, partition_by: list[str] | None = None, mode: str = "error", format: str = "parquet") -> None:
    """The rows in a columnar or text format: a file a task, or about ``files`` in all.

    ``mode`` and ``format`` select the writer as Spark's own do.
    """
    rows = rows if files is None else rows.repartition(files)
    writer = rows.write.mode(mode).format(format)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def checksum(rows: DataFrame) -> DataFrame:
    """One row: n and an order-free checksum, to compare what was written and read."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("checksum"))
