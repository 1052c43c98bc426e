"""Operator 8: long repeated word passages found by recompression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlake.llm.kernels import LONE, Batch, U, Words, digests, mix, runs, sliding_min, window_hashes
from strandlake.llm.repeats import Rule, Segments, repeats

#: Longest symbol, in words, that each round may merge.
CAPS = (1, 2)
#: Adjacent symbols whose names together anchor a window.
PHRASE = 3


def recompress(symbols: np.ndarray, row: np.ndarray, caps: tuple[int, ...] = CAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length (in words) and name of the symbols after the rounds.

    Each round first names runs of one symbol, then pairs of adjacent symbols of
    which the round's coin puts the left one in one class and the right one in
    the other.  Names are hashes of what they stand for, so every task of the
    cluster names alike and a round needs no dictionary.  Symbols longer than the
    round's cap stay as they are; nothing crosses a row.
    """
    n = len(symbols)
    start, length = np.arange(n), np.ones(n, np.int64)
    for turn, cap in enumerate(caps):
        if len(symbols) < 2:
            break
        new = np.ones(len(symbols), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (row[1:] != row[:-1]) | (length[1:] > cap)
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(symbols)))
        symbols, start, row, length = symbols[at], start[at], row[at], length[at] * times
        many = times > 1
        symbols[many] = mix(mix(symbols[many] + U(1)) + times[many].astype(np.uint64))
        side = (mix(symbols ^ U(turn + 77)) & U(1)).astype(bool)
        able = length <= cap
        left = np.flatnonzero(side[:-1] & ~side[1:] & able[:-1] & able[1:] & (row[1:] == row[:-1]))
        symbols[left] = mix(mix(symbols[left] + U(2)) * U(3) + symbols[left + 1])
        length[left] += length[left + 1]
        stay = np.ones(len(symbols), bool)
        stay[left + 1] = False
        symbols, start, row, length = symbols[stay], start[stay], row[stay], length[stay]
    return start, length, symbols


class WordWindows(Rule):
    """Windows of ``width`` words; the anchor is the least name of a phrase of adjacent symbols inside.

    A boundary between symbols depends on ``margin`` words on either side at most:
    each of a round's two steps looks at one symbol of at most the cap and a word
    beyond it.  So symbols that stand at least that far inside a window are read
    from the window's own words.  A window that holds no phrase of such symbols,
    being mostly long runs, is anchored by its own hash.
    """

    by_place = False

    def __init__(self, width: int = 50, caps: tuple[int, ...] = CAPS, phrase: int = PHRASE):
        def fits(caps, phrase) -> bool:
            longest = 2 * max(caps, default=1) if caps else 1
            return width - 4 * sum(c + 1 for c in caps) - longest * phrase + 1 >= longest

        while caps and not fits(caps, phrase):
            caps, phrase = (caps, phrase - 1) if phrase > 1 else (caps[:-1], PHRASE)
        self.width, self.caps, self.margin = width, caps, 2 * sum(c + 1 for c in caps)
        self.longest = 2 * max(caps) if caps else 1
        self.phrase = phrase if caps else 1

    def _windows(self, batch: Batch, row: int, to: int):
        """For chunks of rows: first row, words, and where each row's words and windows begin."""
        for row, to in batch.chunks(row, to):
            words = Words(batch, other=True, row=row, to=to)
            lengths = np.diff(words.first)
            has = lengths >= self.width
            if has.any():
                yield row, words, has

    def segments(self, batch: Batch, row: int, to: int) -> tuple | None:
        width, margin, found = self.width, self.margin, []
        places = width - 2 * margin - self.longest * self.phrase + 1
        for row, words, has in self._windows(batch, row, to):
            h, cut = words.hash, words.first
            lengths = np.diff(cut)
            start, length, name = recompress(h.copy(), words.row_of(), self.caps)
            # The phrase at a symbol: its name and those of the next, if all are short.
            many, k = len(start) - self.phrase + 1, self.phrase
            value = np.full(len(h), LONE)
            if many > 0:
                short = sliding_min((length <= self.longest).astype(np.int8), k) > 0
                value[start[:many][short]] = window_hashes(name, k)[short]
            least = sliding_min(value[margin : len(h) - margin], places)[: len(h) - width + 1]
            bare = np.flatnonzero(least == LONE)
            if len(bare):
                least[bare] = window_hashes(h, width)[bare]
            begin, ends = cut[:-1][has], cut[1:][has] - width + 1
            new = np.ones(len(least) + 1, bool)
            new[1:-1] = least[1:] != least[:-1]
            new[begin] = True
            new[ends] = True
            valid = np.zeros(len(least) + 1, np.int8)
            valid[begin] += 1
            np.add.at(valid, ends, -1)
            valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
            bounds = np.flatnonzero(new)
            s, e = bounds[:-1], bounds[1:]
            keep = valid[s]
            s, e = s[keep], e[keep]
            owner = np.searchsorted(cut, s, side="right") - 1
            text, opens, closes = spaced(batch.data, words.start, words.end)
            found.append((owner + row, s - cut[owner], e - s, least[s], digests(text, opens[s], closes[e + width - 2])))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else None

    def contents(self, batch: Batch, s: Segments, which: np.ndarray) -> list[np.ndarray]:
        n = int(s.count[which].sum())
        out = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
        place = np.cumsum(s.count[which]) - s.count[which]
        by_row = np.argsort(s.row[which], kind="stable")
        rows = s.row[which][by_row]
        for row, words, has in self._windows(batch, 0, batch.n):
            mine = by_row[np.searchsorted(rows, row) : np.searchsorted(rows, row + len(has))]
            count = s.count[which[mine]]
            begin = runs(words.first[s.row[which[mine]] - row] + s.start[which[mine]], count)
            for lane, values in enumerate((words.hash, words.other)):
                out[lane][runs(place[mine], count)] = window_hashes(values, self.width)[begin]
        return out

    def sizes(self, count: np.ndarray) -> np.ndarray:
        return count

    def repeated(self, anchor, doc, start, count, contents) -> np.ndarray:
        window, other = (np.concatenate([c[lane] for c in contents]) for lane in (0, 1))
        doc = np.repeat(doc, count)
        order = np.lexsort((doc, other, window))
        w, o, d = window[order], other[order], doc[order]
        first = np.ones(len(order), bool)
        first[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        hit = np.empty(len(order), bool)
        hit[order] = d != d[head]
        return hit


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of a buffer one after the other, each followed by a space; and where each begins and ends now."""
    size = end - start + 1
    after = np.cumsum(size)
    index = runs(start, size)
    out = data[np.minimum(index, max(len(data) - 1, 0))] if len(index) else np.zeros(0, np.uint8)
    out[after - 1] = 0x20
    return out, after - size, after - 1


def passage_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word that a ``width``-word window covers which a smaller id also has.

    Words are runs of anything but ASCII white space; windows are judged on the
    input.  The result has the columns of ``docs``, then ``n_words`` and
    ``n_removed`` (long), ``spans`` (array of struct start, end: removed word
    runs) and ``kept`` (string: the kept words joined by one space).  Null and
    empty texts have no words; texts under ``width`` words lose nothing.  A null
    id is the smallest; rows that share an id don't count as smaller.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from strandlake.llm.exchange import fresh

    names = [fresh(docs, c) for c in ("n_words", "n_removed", "spans", "kept")]
    kinds = ("bigint", "bigint", "array<struct<start:bigint,end:bigint>>", "string")
    extra = docs.select("*", *[F.lit(None).cast(k).alias(n) for n, k in zip(names, kinds)]).schema
    arrow = to_arrow_schema(extra)

    def finish(table: pa.Table, batch: Batch, row: int, to: int, owner, start, end) -> pa.Table:
        words = Words(batch, row=row, to=to)
        keep = np.ones(len(words.hash), bool)
        keep[runs(words.first[owner] + start, end - start)] = False
        data, opens, closes = spaced(batch.data, words.start[keep], words.end[keep])
        total = np.concatenate([[0], np.cumsum(keep)])[words.first]
        per = np.diff(total)
        # A row's text ends before the space after its last word, which is left out.
        solid = np.ones(len(data), bool)
        solid[closes[total[1:][per > 0] - 1]] = False
        size = np.zeros(len(per), np.int64)
        size[per > 0] = closes[total[1:][per > 0] - 1] - opens[total[:-1][per > 0]]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        kept = pa.Array.from_buffers(pa.string(), to - row, [None, pa.py_buffer(offsets), pa.py_buffer(data[solid].tobytes())])
        pairs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
        n_words = np.diff(words.first)
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(to - row + 1)).astype(np.int32)), pairs)
        new = [pa.array(n_words, pa.int64()), pa.array(n_words - per, pa.int64()), lists, kept]
        return pa.Table.from_arrays([*table.columns, *new], names=[*table.column_names, *names]).cast(arrow)

    return repeats(docs, WordWindows(width), finish, extra, id_col, text_col)


def op8_passage_dedup(docs: DataFrame) -> DataFrame:
    """The digests of ``passage_dedup`` over windows of 50 words."""
    done = passage_dedup(docs.select("doc_id", "text"), 50)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
