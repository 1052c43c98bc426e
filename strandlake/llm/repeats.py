"""Windows that also occur earlier: the rounds shared by both substring removers.

A rule cuts the windows of every row into segments: runs of consecutive windows
that share an anchor, a value read from each window's content alone, so that
equal windows have equal anchors wherever they stand.

Round 1 sends each distinct segment of a batch (anchor, 128-bit digest of its
content, first place) to the anchor's shard.  A segment whose content has an
earlier place is a repeat as a whole; one whose anchor no other content has is
new; the few others are open.  Round 2 sends the content of open segments to the
same shard, which compares their windows.  Round 3 hands each batch its spans.
Batches are worked on in parts, so a task holds the texts and the segments of one
batch and little more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.exchange import MESSAGE, SHARDS_PER_PARTITION, by_sender, in_batches, messages, number_of, partitions
from strandlake.llm.kernels import Batch, narrow, pack, thrifty, thrifty_pair, union_length

NEW, REPEAT, OPEN = 0, 1, 2
#: Bytes of text worked on at once.
PART = 1 << 21


@dataclass
class Segments:
    """row: of the batch; start: first window's place in the row; count: of windows; content: (n, 2) digests."""

    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray

    @staticmethod
    def joined(parts: list[tuple]) -> Segments:
        if not parts:
            z = np.zeros(0, np.int64)
            return Segments(z, z, z, z.astype(np.uint64), np.zeros((0, 2), np.uint64))
        return Segments(*(np.concatenate(x) for x in zip(*parts)))


class Rule:
    """How windows are found and compared. ``by_place``: an earlier place in the same document counts too."""

    width: int
    by_place: bool

    def segments(self, batch: Batch, row: int, to: int) -> tuple | None:
        """The fields of ``Segments`` for some rows, or nothing if they hold no window."""
        raise NotImplementedError

    def contents(self, batch: Batch, segments: Segments, which: np.ndarray) -> list[np.ndarray]:
        """Arrays that let a shard compare the windows of the chosen segments, one segment after the other."""
        raise NotImplementedError

    def sizes(self, count: np.ndarray) -> np.ndarray:
        """How many values of ``contents`` a segment of ``count`` windows has."""
        raise NotImplementedError

    def repeated(self, anchor, doc, start, count, contents: list[list[np.ndarray]]) -> np.ndarray:
        """For each window of the segments, in their order, whether it occurs earlier."""
        raise NotImplementedError


class _Local:
    """The distinct segments of one batch, in order of content."""

    def __init__(self, rule: Rule, table: pa.Table, columns: tuple[str, str], n_shards: int):
        self.batch = batch = Batch(table, *columns)
        found = (rule.segments(batch, row, to) for row, to in batch.chunks(most=PART))
        self.all = s = Segments.joined([f for f in found if f is not None])
        doc = batch.ids[s.row]
        place = s.start if rule.by_place else np.zeros(len(doc), np.uint8)
        order = np.lexsort((s.start, doc, s.content[:, 1], s.content[:, 0]))
        content, doc, place = s.content[order], doc[order], place[order]
        first = np.ones(len(order), bool)
        first[1:] = (content[1:] != content[:-1]).any(1)
        at = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        self.group = np.empty(len(order), np.int64)
        self.group[order] = group
        self.later = np.empty(len(order), bool)
        self.later[order] = (doc != doc[at][group]) | (place != place[at][group])
        self.pick = order[at]
        self.anchor, self.content, self.doc = s.anchor[self.pick], content[at], doc[at]
        self.start = s.start[self.pick]
        shard = (self.anchor % np.uint64(n_shards)).astype(np.int64)
        self.by = np.argsort(shard, kind="stable")
        self.cut = np.searchsorted(shard[self.by], np.arange(n_shards + 1))

    def of_shard(self, k: int) -> np.ndarray:
        return self.by[self.cut[k] : self.cut[k + 1]]

    def states(self, answers: list[np.ndarray]) -> np.ndarray:
        """The state of each distinct segment, from the shards' answers."""
        out = np.zeros(len(self.pick), np.uint8)
        if len(self.by):
            out[self.by] = np.concatenate(answers)
        return out


def _asked(rule: Rule, columns, n_shards, batch_col, table: pa.Table) -> pa.Table:
    number, local = number_of(table, batch_col), _Local(rule, table, columns, n_shards)
    rows = []
    for k in range(n_shards):
        i = local.of_shard(k)
        if len(i):
            rows.append((k, number, 0, pack(local.anchor[i], local.content[i, 0], local.content[i, 1], local.doc[i], narrow(local.start[i]))))
    return messages(rows)


def _judged(rule: Rule, table: pa.Table) -> pa.Table:
    asked = by_sender(table)
    anchor, content, rest, doc, start = (np.concatenate([a[i] for *_, a in asked]) for i in range(5))
    place = start if rule.by_place else np.zeros(len(doc), np.uint8)
    order = np.lexsort((place, doc, rest, content, anchor))
    a, c, r, d, p = anchor[order], content[order], rest[order], doc[order], place[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    first = new.copy()
    first[1:] |= (c[1:] != c[:-1]) | (r[1:] != r[:-1])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    key = np.cumsum(new) - 1
    kinds = np.bincount(key, weights=first)
    state = np.where((d != d[head]) | (p != p[head]), REPEAT, np.where(kinds[key] > 1, OPEN, NEW)).astype(np.uint8)
    out = np.empty(len(a), np.uint8)
    out[order] = state
    rows, at = [], 0
    for shard, batch, _, arrays in asked:
        rows.append((shard, batch, 0, pack(out[at : at + len(arrays[0])])))
        at += len(arrays[0])
    return messages(rows)


def _opened(rule: Rule, columns, n_shards, batch_col, table: pa.Table, answers: pa.Table) -> pa.Table:
    if not answers.num_rows or not table.num_rows:
        return messages([])
    number, local = number_of(table, batch_col), _Local(rule, table, columns, n_shards)
    open_ = local.states([a[0] for *_, a in by_sender(answers)]) == OPEN
    chosen = [i[open_[i]] for i in map(local.of_shard, range(n_shards))]
    every = np.concatenate(chosen)
    # One pass over the batch; each shard then gets its share.
    sizes = local.all.count[local.pick[every]]
    whole, per, rows, at = rule.contents(local.batch, local.all, local.pick[every]), rule.sizes(sizes), [], 0
    ends = np.concatenate([[0], np.cumsum(per)])
    for k, i in enumerate(chosen):
        if len(i):
            head = [local.anchor[i], local.doc[i], narrow(local.start[i]), narrow(local.all.count[local.pick[i]])]
            rows.append((k, number, 1, pack(*head, *[w[ends[at] : ends[at + len(i)]] for w in whole])))
        at += len(i)
    return messages(rows)


def _compared(rule: Rule, table: pa.Table) -> pa.Table:
    sent = by_sender(table)
    anchor, doc, start, count = (np.concatenate([a[i].astype(np.int64) if i > 1 else a[i] for *_, a in sent]) for i in range(4))
    hit = rule.repeated(anchor, doc, start, count, [a[4:] for *_, a in sent])
    rows, at = [], 0
    for shard, batch, _, arrays in sent:
        n = int(arrays[3].sum(dtype=np.int64))
        rows.append((shard, batch, 1, pack(np.packbits(hit[at : at + n]))))
        at += n
    return messages(rows)


def spans(rule: Rule, local: _Local, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the runs of units that repeated windows cover."""
    s = local.all
    got = by_sender(answers)
    state = local.states([a[0] for _, _, kind, a in got if kind == 0])
    whole = local.later | (state[local.group] == REPEAT)
    row, start, end = [s.row[whole]], [s.start[whole]], [s.start[whole] + s.count[whole] + rule.width - 1]
    members = np.argsort(local.group, kind="stable")
    bounds = np.searchsorted(local.group[members], np.arange(len(local.pick) + 1))
    for k, _, kind, arrays in got:
        if kind != 1:
            continue
        i = local.of_shard(k)
        i = i[state[i] == OPEN]
        count = s.count[local.pick[i]]
        hit = np.unpackbits(arrays[0], count=int(count.sum())).astype(bool)
        owner = np.repeat(np.arange(len(i)), count)
        # Runs of repeated windows inside each segment.
        begin = hit.copy()
        begin[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]))
        stop = hit.copy()
        stop[:-1] &= ~(hit[1:] & (owner[1:] == owner[:-1]))
        b, e = np.flatnonzero(begin), np.flatnonzero(stop)
        base = np.cumsum(count) - count
        for j, x, y in zip(owner[b], b - base[owner[b]], e - base[owner[b]]):
            same = members[bounds[i[j]] : bounds[i[j] + 1]]
            same = same[~local.later[same]]
            row.append(s.row[same])
            start.append(s.start[same] + x)
            end.append(s.start[same] + y + rule.width)
    return union_length(np.concatenate(row), np.concatenate(start).astype(np.int64), np.concatenate(end).astype(np.int64))


def repeats(docs: DataFrame, rule: Rule, finish, schema: str, id_col: str, text_col: str) -> DataFrame:
    """``finish(table, batch, row, to, owner, start, end)`` makes the result of some rows from their spans."""
    n_shards, columns = partitions(docs) * SHARDS_PER_PARTITION, (id_col, text_col)
    rows, batch = in_batches(docs, id_col, text_col)

    def result(table: pa.Table, answers: pa.Table) -> pa.Table:
        local = _Local(rule, table, columns, n_shards)
        found, texts = spans(rule, local, answers), local.batch
        ordered = (table.take(pa.array(texts.order)) if texts.moved else table).drop_columns([batch])
        parts = [finish(ordered.slice(0, 0), texts, 0, 0, *(x[:0] for x in found))]
        for row, to in texts.chunks(most=PART):
            i, j = np.searchsorted(found[0], [row, to])
            parts.append(finish(ordered.slice(row, to - row), texts, row, to, found[0][i:j] - row, found[1][i:j], found[2][i:j]))
        return pa.concat_tables(parts)

    asked = rows.groupBy(batch).applyInArrow(thrifty(lambda t: _asked(rule, columns, n_shards, batch, t)), MESSAGE)
    judged = asked.groupBy("shard").applyInArrow(thrifty(lambda t: _judged(rule, t)), MESSAGE)
    opened = rows.groupBy(batch).cogroup(judged.groupBy("batch")).applyInArrow(thrifty_pair(lambda t, a: _opened(rule, columns, n_shards, batch, t, a)), MESSAGE)
    compared = opened.groupBy("shard").applyInArrow(thrifty(lambda t: _compared(rule, t)), MESSAGE)
    return rows.groupBy(batch).cogroup(judged.unionByName(compared).groupBy("batch")).applyInArrow(thrifty_pair(result), schema)
