"""Operator 1: substring removal with a logarithmic family of suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlake.llm.kernels import _BYTE, Batch, digests, prefix_hash, powers, runs, sliding_min, U
from strandlake.llm.repeats import Rule, Segments, repeats


class SuffixFamily:
    """Suffix arrays of places in one buffer, whose sizes double: the index that grows by batches.

    A batch's suffixes, compared up to ``width`` bytes, are sorted into a suffix
    array of places.  It is merge-scanned against each existing level, block by
    block, for suffixes that agree over the whole width; what is new then becomes a
    level itself, and levels of equal rank are merged in the same manner until all
    ranks differ.  Only a block of either side is ever spelt out.
    """

    BLOCK = 1 << 13

    def __init__(self, data: np.ndarray, width: int, base: int = 1 << 14):
        self.windows = np.lib.stride_tricks.sliding_window_view(data, width) if len(data) >= width else np.zeros((0, width), np.uint8)
        self.width, self.base, self.levels = width, base, {}

    def rank(self, n: int) -> int:
        return max(0, int(np.ceil(np.log2(max(1, n) / self.base))))

    def spelt(self, places: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.windows[places]).view(f"S{self.width}").ravel()

    def _locate(self, level: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each suffix of one array would stand in another, and whether it is there: one pass over both."""
        at, there, begin = np.empty(len(places), np.int64), np.zeros(len(places), bool), 0
        for k in range(0, len(places), self.BLOCK):
            keys = self.spelt(places[k : k + self.BLOCK])
            done = 0
            while done < len(keys):
                block = self.spelt(level[begin : begin + self.BLOCK])
                last = begin + len(block) >= len(level)
                to = len(keys) if last else int(np.searchsorted(keys, block[-1], side="right"))
                mine = keys[done:to]
                found = np.searchsorted(block, mine)
                at[k + done : k + to] = begin + found
                there[k + done : k + to] = block[np.minimum(found, len(block) - 1)] == mine if len(block) else False
                done = to
                if done < len(keys):
                    begin += len(block)
        return at, there

    def add(self, places: np.ndarray) -> np.ndarray:
        """Which of the suffixes (in order of arrival) occur earlier; all are indexed then."""
        keys = self.spelt(places)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        seen = np.zeros(len(order), bool)
        seen[1:] = keys[1:] == keys[:-1]
        fresh = places[order[~seen]]
        known = np.zeros(len(fresh), bool)
        for level in self.levels.values():
            known |= self._locate(level, fresh)[1]
        # A suffix equal to its left neighbour is seen; the first of each group is seen if a level has it.
        seen[~seen] = known
        out = np.empty(len(order), bool)
        out[order] = seen
        self._insert(fresh[~known])
        return out

    def _insert(self, level: np.ndarray) -> None:
        if not len(level):
            return
        rank = self.rank(len(level))
        while rank in self.levels:
            other = self.levels.pop(rank)
            level = np.insert(other, self._locate(other, level)[0], level)
            rank = max(rank, self.rank(len(level)))
        self.levels[rank] = level


class ByteWindows(Rule):
    """Windows of ``width`` bytes; the anchor is the least hash of a window's ``gram``-byte strings.

    Windows that share an anchor at one place form a segment, so a window never
    stands twice in the same segment.
    """

    by_place = True

    def __init__(self, width: int = 100, gram: int | None = None):
        self.width, self.gram = width, gram or max(1, width // 3)

    def segments(self, batch: Batch, row: int, to: int) -> tuple | None:
        width, gram, found = self.width, self.gram, []
        for row, to in batch.chunks(row, to):
            at = batch.ends[row]
            cut, data = batch.ends[row : to + 1] - at, batch.data[at : batch.ends[to]]
            lengths = np.diff(cut)
            has = lengths >= width
            if not has.any():
                continue
            h = prefix_hash(_BYTE[data])
            grams = (h[gram:] - h[:-gram]) * powers(len(h))[1][: len(h) - gram]
            grams = (grams ^ (grams >> U(29))) * U(0xBF58476D1CE4E5B9)
            grams ^= grams >> U(32)
            least = sliding_min(grams, width - gram + 1)
            begin, count = cut[:-1][has], lengths[has] - width + 1
            new = np.ones(len(least) + 1, bool)
            new[1:-1] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
            new[begin] = True
            new[np.minimum(begin + count, len(least))] = True
            valid = np.zeros(len(least) + 1, np.int8)
            valid[begin] += 1
            ends = begin + count
            np.add.at(valid, ends, -1)
            valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
            bounds = np.flatnonzero(new)
            s, e = bounds[:-1], bounds[1:]
            keep = valid[s]
            s, e = s[keep], e[keep]
            owner = np.searchsorted(cut, s, side="right") - 1
            found.append((owner + row, s - cut[owner], e - s, least[s], digests(data, s, e + width - 1)))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else None

    def contents(self, batch: Batch, s: Segments, which: np.ndarray) -> list[np.ndarray]:
        start = batch.ends[s.row[which]] + s.start[which]
        return [batch.data[runs(start, s.count[which] + self.width - 1)]]

    def sizes(self, count: np.ndarray) -> np.ndarray:
        return count + self.width - 1

    def repeated(self, anchor, doc, start, count, contents) -> np.ndarray:
        data = np.concatenate([c[0] for c in contents])
        sizes = count + self.width - 1
        at = np.cumsum(sizes) - sizes
        out_at = np.cumsum(count) - count
        hit = np.zeros(int(count.sum()), bool)
        family = SuffixFamily(data, self.width)
        # Few enough batches that scanning the levels for each costs about as much as sorting.
        batch = max(family.base, len(hit) // 16)
        order = np.lexsort((start, doc))
        # The same place of the same document, delivered by two rows, is no earlier place.
        twin = np.zeros(len(order), bool)
        twin[1:] = (doc[order][1:] == doc[order][:-1]) & (start[order][1:] == start[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
        copies, pending, size = [], [], 0

        def take() -> None:
            which = np.array(pending)
            hit[runs(out_at[which], count[which])] = family.add(runs(at[which], count[which]))

        for j, i in enumerate(order):
            if twin[j] and np.array_equal(data[at[i] : at[i] + sizes[i]], data[at[last] : at[last] + sizes[last]]):
                copies.append((i, last))
                continue
            last = i
            pending.append(i)
            size += count[i]
            if size >= batch:
                take()
                pending, size = [], 0
        if pending:
            take()
        for i, j in copies:
            hit[out_at[i] : out_at[i] + count[i]] = hit[out_at[j] : out_at[j] + count[j]]
        return hit


def suffix_dedup(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
    """Removes every byte that a ``width``-byte string covers which also starts earlier.

    Earlier: in a document with a smaller id, or before in the same document;
    strings are judged on the input.  The result has the columns of ``docs``, in
    which a null text stays null, then ``spans`` (array of struct start, end: the
    removed byte runs) and ``kept`` (binary: the rest).  Null and empty texts and
    texts under ``width`` bytes lose nothing.  A null id is the smallest id; rows
    that share an id count as one document.  Rows repeated in full keep or lose
    the same bytes, as none of them is earlier.  With ``characters``, a character
    that is removed in part stays whole in ``kept``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from strandlake.llm.exchange import fresh

    spans_col, kept_col = fresh(docs, "spans"), fresh(docs, "kept")
    extra = docs.select("*", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias(spans_col), F.lit(None).cast("binary").alias(kept_col)).schema
    arrow = to_arrow_schema(extra)

    def finish(table: pa.Table, batch: Batch, row: int, to: int, owner, start, end) -> pa.Table:
        ends = batch.ends[row : to + 1] - batch.ends[row]
        data = batch.data[batch.ends[row] : batch.ends[to]]
        keep = np.ones(len(data), bool)
        keep[runs(ends[owner] + start, end - start)] = False
        if characters and len(keep):
            lead = np.flatnonzero(data & 0xC0 != 0x80)
            lead = lead if len(lead) and lead[0] == 0 else np.concatenate([[0], lead])
            keep = np.repeat(np.logical_or.reduceat(keep, lead), np.diff(np.append(lead, len(keep))))
        offsets = np.concatenate([[0], np.cumsum(keep)])[ends].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), to - row, [None, pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes())])
        pairs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(to - row + 1)).astype(np.int32)), pairs)
        return pa.Table.from_arrays([*table.columns, lists, kept], names=[*table.column_names, spans_col, kept_col]).cast(arrow)

    return repeats(docs, ByteWindows(width), finish, extra, id_col, text_col)


def without_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """A documents table whose texts lack their repeated bytes (whole characters), with n_chars anew."""
    from strandlake.llm.exchange import fresh

    done = suffix_dedup(docs, width, characters=True)
    text = F.when(F.col("text").isNotNull(), F.col(fresh(docs, "kept")).cast("string"))
    new = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op1_suffix_dedup(docs: DataFrame) -> DataFrame:
    """The digests of ``suffix_dedup`` over strings of 100 bytes."""
    done = suffix_dedup(docs.select("doc_id", "text"), 100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
