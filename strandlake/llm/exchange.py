"""Batches of rows that ask a sharded, global question and get the answers back.

``in_batches`` deals rows out by a hash of their content.  A batch computes keys
from its texts, sends each to the shard that owns it (one row of packed arrays
for each batch and shard, so that repeats inside a batch travel once), and the
shard answers every batch.  Spark reuses the one exchange of the texts in each
round of a query.  A lost executor costs the recomputation of its batches, whose
requests come out the same because batches are put in an order of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlake.llm.kernels import thrifty
from strandlake.functions.ordered import checkpointed  # noqa: F401  (cuts lineage in the folder that the cluster shares)

MESSAGE = "shard int, batch int, kind int, payload binary"
_ARROW = pa.schema([("shard", pa.int32()), ("batch", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
BATCHES_PER_PARTITION = 1
SHARDS_PER_PARTITION = 1


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, which grows with the cluster's data."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_batches(docs: DataFrame, *keys: str, per_partition: int = BATCHES_PER_PARTITION) -> tuple[DataFrame, str]:
    """The rows with a batch number from a hash of the key columns; and its name."""
    numbered, name, n = _numbered(docs, keys, per_partition)
    return numbered.repartition(n, name), name


def _numbered(docs: DataFrame, keys: tuple[str, ...], per_partition: int) -> tuple[DataFrame, str, int]:
    name, n = fresh(docs, "batch"), partitions(docs)
    number = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(n * per_partition)).cast("int")
    return docs.withColumn(name, number), name, n


def packed_batches(docs: DataFrame, *keys: str) -> DataFrame:
    """``batch`` and ``payload``: the rows of each batch, those of a task together and compressed as one.

    Texts shrink far more so than a shuffle's own compression gets them to, and
    travel as few large rows.  ``unpacked`` restores a batch's table.
    """
    numbered, name, n = _numbered(docs, keys, 1)

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for record in batches:
            number = record.column(name).to_numpy(zero_copy_only=False)
            order = np.argsort(number, kind="stable")
            cut = np.flatnonzero(np.diff(number[order], prepend=-1))
            rest = record.drop_columns([name])
            for begin, end in zip(cut, np.append(cut[1:], len(order))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema, options=options) as writer:
                    writer.write_batch(rest.take(pa.array(order[begin:end])))
                yield pa.RecordBatch.from_arrays([pa.array([number[order[begin]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "payload"])

    return numbered.mapInArrow(thrifty(run), "batch int, payload binary").repartition(n, "batch")


def unpacked(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(p.as_buffer()).read_all() for p in table.column("payload")])


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def number_of(table: pa.Table, name: str) -> int:
    return table.column(name)[0].as_py()


def by_sender(table: pa.Table) -> list[tuple[int, int, list[np.ndarray]]]:
    """(batch, kind, arrays) of the messages of a shard, or (shard, kind, arrays), in one order."""
    from strandlake.llm.kernels import unpack

    columns = [table.column(c).to_pylist() for c in ("shard", "batch", "kind", "payload")]
    rows = sorted(zip(*columns), key=lambda r: r[:3])
    return [(s, b, k, unpack(p)) for s, b, k, p in rows]
