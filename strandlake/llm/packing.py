"""Operator 6: packing into fixed-length sequences by minimum bin slack."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from strandlake.llm.bpe import REMEMBERED, _parts, load
from strandlake.llm.exchange import checkpointed, fresh, partitions
from strandlake.llm.kernels import thrifty

EOS = 2


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, of those available, that fill as much of ``room`` as any can.

    Subset sums as a bitset: bit k of ``reach`` says that some chosen lengths add
    up to k.  Lengths enter from the longest, each as often as it is available and
    could fit; the way back from the highest bit gives the combination.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in np.flatnonzero(counts[1 : room + 1])[::-1] + 1:
        length = int(length)
        for _ in range(min(int(counts[length]), room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach >> room:
            break
    target, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> target & 1:
            chosen.append(length)
            target -= length
    return chosen[::-1]


def plan(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many bins alike), for counts[length] pieces of each length.

    Each bin takes the longest piece left and the combination that leaves the
    least slack beside it.  The same combination serves as long as it is
    available, so the work depends on ``size`` and not on the number of pieces.
    """
    counts, bins = counts.copy(), []
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        chosen = [longest, *fullest(counts, size - longest)]
        counts[longest] += 1
        lengths, times = np.unique(chosen, return_counts=True)
        again = int((counts[lengths] // times).min())
        counts[lengths] -= times * again
        bins.append((chosen, again))
    return bins


def token_pieces(docs: DataFrame, path: str, size: int = 1024, eos: int = EOS, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` tokens: id, piece, start, length, ids_crc32 (and ``token_ids`` if asked for).

    A text's ids end with ``eos``.  Only longer ones are cut: the first piece takes
    the remainder, the others are full.  Null and empty texts are their ``eos``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *fields])
    arrow = to_arrow_schema(schema)
    with open(path, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        tokenizer, end = load(data.value, "pack"), np.int32(eos).tobytes()
        # Only ids are kept here, so there is room for more.
        tokenizer.remembered = 2 * REMEMBERED
        special = {t: np.int32(i).tobytes() for t, i in tokenizer.special.items()}
        for batch in batches:
            for begin, stop, texts in _parts(batch, text_col, 1 << 23):
                owner, rows, arrays = [], [], []
                for k, units in enumerate(tokenizer.encode_batch(texts, lambda b: b, special)):
                    every = b"".join(units) + end
                    n, at, piece = len(every) // 4, 0, 0
                    while at < n:
                        to = at + (n % size or size) if piece == 0 and n > size else min(n, at + size)
                        owner.append(k)
                        rows.append((piece, at, to - at, zlib.crc32(every[4 * at : 4 * to])))
                        arrays.append(np.frombuffer(every, np.int32)[at:to] if ids else None)
                        at, piece = to, piece + 1
                columns = [batch.column(id_col).slice(begin, stop - begin).take(pa.array(owner, pa.int64())), *map(pa.array, zip(*rows))]
                columns += [pa.array(arrays, pa.list_(pa.int32()))] * ids
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(thrifty(run, "pack"), schema)


def pack(pieces: DataFrame, size: int = 1024, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: a place for each piece in a sequence of at most ``size``.

    The bins are planned on the driver from the counts by length, at most ``size``
    numbers.  A piece's rank among those of its length, counted by buckets so that
    no length gathers in one task, tells its bin.  Lengths are 1 to ``size``; a
    piece of another or a null length has no place and is an error.
    """
    n, bucket, rank = partitions(pieces), fresh(pieces, "bucket"), fresh(pieces, "rank")
    length = F.col(length_col)
    pieces = pieces.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    by_bucket = pieces.groupBy(length_col, bucket).agg(F.count("*").alias("_n"))
    counts = np.zeros(size + 1, np.int64)
    for r in by_bucket.groupBy(length_col).agg(F.sum("_n").alias("_n")).limit(size + 2).collect():
        if r[0] is None or not 1 <= r[0] <= size:
            raise ValueError(f"a piece of length {r[0]} can't be packed into {size}")
        counts[r[0]] = r[1]
    slots, base, used = [], 0, np.zeros(size + 1, np.int64)
    for chosen, again in plan(counts, size):
        at = 0
        for value in sorted(set(chosen), reverse=True):
            times = chosen.count(value)
            slots.append((value, int(used[value]), int(used[value]) + times * again, base, times, at))
            used[value] += times * again
            at += times * value
        base += again
    table = pieces.sparkSession.createDataFrame(slots, "_length long, _from long, _to long, _base long, _times long, _at long")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(length_col).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = by_bucket.select(length_col, bucket, before.alias("_before"))
    ranked = pieces.withColumn(rank, F.row_number().over(Window.partitionBy(length_col, bucket).orderBy(*order)) - 1)
    ranked = ranked.join(offsets, [length_col, bucket]).withColumn(rank, F.col(rank) + F.col("_before"))
    # At most ``size`` lengths in a few hundred kinds of bins: a bounded table.
    placed = ranked.join(F.broadcast(table), (length == F.col("_length")) & (F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_to")))
    place = F.col(rank) - F.col("_from")
    return placed.select(
        *[c for c in pieces.columns if c != bucket],
        (F.col("_base") + F.floor(place / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_at") + place % F.col("_times") * length).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 1024) -> DataFrame:
    """All documents' pieces with their places; tokenized once, as the pieces are checkpointed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(checkpointed(token_pieces(docs, path, size)), size)


def op6_packing(docs: DataFrame) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack_documents(docs)
