"""Operator 3: n-gram language model scores by a weighted backoff automaton."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandlake.llm.exchange import MESSAGE, SHARDS_PER_PARTITION, by_sender, fresh, messages, number_of, packed_batches, partitions, unpacked
from strandlake.llm.kernels import Batch, U, Words, from_planes, mix, narrow, pack, planes, thrifty, thrifty_pair

#: The tokens at a text's end and before its begin, in two independent hashes.
END, BEGIN = mix(np.array([1, 2], np.uint64)), mix(np.array([3, 4], np.uint64))
#: Longest n-grams, and the weight of the lower order in a state, in counts.
ORDER, STRENGTH = 3, 20.0
#: Tokens of a text that one lane of the traversal reads, and bytes of text traversed at once.
PIECE, PART = 512, 1 << 21


class Automaton:
    """The smoothed n-grams of some texts as states and arcs.

    The root reads any token with log10 p1.  An n-gram of up to ORDER - 1 tokens
    that the training text has is a state.  A state h that was followed by w has an
    arc for w, weighted log10((c(hw) + s * p(w | h')) / (c(h) + s)), where h' lacks
    the first token of h; for any other token it has a failure arc to h', weighted
    log10(s / (c(h) + s)).  These weights add up to one over all tokens of a state.

    ``counts[n][i]`` is the training count of the n + 1 tokens that end with token
    i, ``follow[n][i]`` that of the n + 1 tokens before it, as far as its text reaches.
    """

    def __init__(self, counts: list[np.ndarray], follow: list[np.ndarray], total: int, distinct: int, strength: float):
        probability = (counts[0] + 1.0) / (total + distinct + 1.0)
        #: Per order, for each place: the weight of the arc for its token, whether there is one, and that of failing there.
        self.weight, self.has, self.fail = [np.log10(probability)], [np.ones(len(probability), bool)], []
        for seen, before in zip(counts[1:], follow):
            probability = (seen + strength * probability) / (before + strength)
            self.weight.append(np.log10(probability))
            self.has.append(seen > 0)
            self.fail.append(np.log10(strength / (before + strength)))
        self.known = [c > 0 for c in counts[: len(follow)]]

    def traverse(self, first: np.ndarray) -> np.ndarray:
        """Log-probability of each text, whose tokens are first[i] to first[i + 1]; one pass from left to right.

        A lane carries the order of its state, the longest n-gram read so far that
        is one.  For each token it follows failure arcs down to a state that has an
        arc for it.  What was read ORDER - 1 tokens ago is forgotten, so a long
        text is cut into lanes that start so many tokens early, without counting.
        """
        lengths = np.diff(first)
        lanes = -(-lengths // PIECE)
        text = np.repeat(np.arange(len(lengths)), lanes)
        turn = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin, most = first[text] + turn * PIECE, len(self.fail)
        size = np.minimum(first[text + 1] - begin, PIECE)
        early = np.where(turn > 0, most, 0)
        at, steps = begin - early, size + early
        order = np.argsort(-steps, kind="stable")
        at, early, steps = at[order], early[order], steps[order]
        # A text begins in the state of its begin, which is of order 1; a lane that starts early in the root.
        state, total = np.where(early > 0, 0, min(1, most)), np.zeros(len(at))
        for step in range(int(steps.max(initial=0))):
            n = int(np.searchsorted(-steps, -step, side="left"))
            place, now, cost = at[:n] + step, state[:n], np.zeros(n)
            for level in range(most, 0, -1):
                here = now == level
                lost = here & ~self.has[level][place]
                cost += np.where(lost, self.fail[level - 1][place], 0.0)
                cost += np.where(here & ~lost, self.weight[level][place], 0.0)
                now = np.where(lost, level - 1, np.where(here, -1, now))
            cost += np.where(now == 0, self.weight[0][place], 0.0)
            total[:n] += np.where(step >= early[:n], cost, 0.0)
            reach = np.minimum(state[:n] + 1, most)
            for level in range(most, 0, -1):
                reach = np.where((reach == level) & ~self.known[level - 1][place], level - 1, reach)
            state[:n] = reach
        return np.bincount(text[order], total, len(lengths))


class _Level:
    """The distinct n-grams of one length in a batch and their training counts here; those to ask about in order of shard."""

    def __init__(self, key: np.ndarray, route: np.ndarray, train: np.ndarray, open_: np.ndarray, n_shards: int):
        """open_: whether others may have a token's n-gram too; ``place``: the n-gram's number."""
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        at, group = np.flatnonzero(new), (np.cumsum(new) - 1).astype(np.int32)
        self.key, one = sorted_[at], order[at]
        self.place = np.empty(len(order), np.int32)
        self.place[order] = group
        self.count = np.bincount(group, train[order], len(at)).astype(np.int64)
        asked = np.flatnonzero(open_[one])
        shard = (route[one[asked]] % U(n_shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        self.by, self.cut = asked[by], np.searchsorted(shard[by], np.arange(n_shards + 1))

    def asked(self, number: int, kind: int, empty: bool) -> list[tuple[int, int, int, bytes]]:
        rows = []
        for k in range(len(self.cut) - 1):
            i = self.by[self.cut[k] : self.cut[k + 1]]
            if len(i) or empty:
                rows.append((k, number, kind, pack(planes(self.key[i]), narrow(self.count[i]))))
        return rows

    def answered(self, got: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Counts in all training rows, and whether other batches have the n-gram."""
        count, others, parts = self.count.copy(), np.zeros(len(self.key), bool), []
        for _, code, large, much in got:
            value = (code >> 1).astype(np.int64)
            value[large.astype(np.int64)] = much
            parts.append((value, (code & 1).astype(bool)))
        if len(self.by):
            count[self.by], others[self.by] = (np.concatenate(x) for x in zip(*parts))
        return count, others


class _Grams:
    """Tokens of a batch and, as far as the shards' answers reach, the counts of their n-grams.

    Words and pairs are asked about in one round.  A longer n-gram is asked about
    only if other batches have both its parts of one token less.  Else no other batch
    has it, so its count here is its count: asking less loses nothing.
    """

    def __init__(self, table: pa.Table, columns: tuple[str, str], train_col: str, n_shards: int, levels: int, answered: int, answers: list):
        """Builds ``levels`` lengths of n-grams, of which the shards have answered the first ``answered``."""
        self.batch = batch = Batch(table, *columns)
        words = Words(batch, lower=True, places=False, other=True)
        lengths = np.diff(words.first) + 1
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        n = int(self.first[-1])
        self.train = table.column(train_col).fill_null(True).to_numpy()[batch.order].astype(bool)
        train, inner = np.repeat(self.train, lengths), np.ones(n, bool)
        inner[self.first[1:] - 1] = False
        lanes = []
        for lane, values in enumerate((words.hash, words.other)):
            token = np.full(n, END[lane])
            token[inner] = values
            lanes.append(token)
        del words
        depth = np.arange(n) - np.repeat(self.first[:-1], lengths)
        gram, wide, self.counts, self.last = lanes, np.ones(n, bool), [], []
        for level in range(levels):
            if level == 0:
                # The begin of every row is a token too, though not one that is predicted.
                keys = [np.concatenate([g, np.full(batch.n, BEGIN[lane])]) for lane, g in enumerate(gram)]
                one = _Level(*keys, np.concatenate([train, self.train]), np.ones(n + batch.n, bool), n_shards)
                del keys
            else:
                # The n-gram that ends here is the one that ended a token before, and this token.
                gram = [self._longer(g, t, lane, depth == 0) for lane, (g, t) in enumerate(zip(gram, lanes))]
                # Pairs are asked about before it is known which words others have.
                open_ = np.ones(n, bool) if level == 1 else wide & np.append(True, wide[:-1]) & (depth >= level - 1)
                # 48 bits of one hash in the shard that the other tells.
                one = _Level(gram[0] >> U(16), gram[1], train, open_, n_shards)
            if level >= answered:
                self.last.append((level, one))
                continue
            got = [a for _, _, kind, a in answers if kind == level]
            count, others = one.answered(got)
            here, wide = count[one.place[:n]], others[one.place[:n]]
            here[depth < level - 1] = 0
            if level == 0:
                self.texts = int(count[one.place[n]]) if batch.n else 0
                self.total, self.distinct = (int(sum(a[0][k] for a in got)) for k in (0, 1))
            self.counts.append(here)

    def asks(self, number: int) -> pa.Table:
        return messages([row for level, one in self.last for row in one.asked(number, level, level == 0)])

    @staticmethod
    def _longer(gram: np.ndarray, token: np.ndarray, lane: int, start: np.ndarray) -> np.ndarray:
        before = np.empty_like(gram)
        before[1:] = gram[:-1]
        before[start] = BEGIN[lane]
        return mix(before * U(0x9E3779B97F4A7C15) ^ token)

    def follow(self) -> list[np.ndarray]:
        """How often what stands before each token is followed by any, for each length."""
        out = []
        for level, count in enumerate(self.counts[:-1]):
            before = np.zeros_like(count)
            before[1:] = count[:-1]
            before[self.first[:-1]] = self.texts if level == 0 else 0
            out.append(before)
        return out


def _counted(table: pa.Table) -> pa.Table:
    rows, sent = [], by_sender(table)
    for kind in sorted({k for _, _, k, _ in sent}):
        asked = [(shard, batch, from_planes(a[0]), a[1]) for shard, batch, k, a in sent if k == kind]
        keys, where = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([a[3] for a in asked]), len(keys)).astype(np.int64)
        # Every batch that has an n-gram asks, and once.
        others, token = np.bincount(where, minlength=len(keys)) > 1, keys != BEGIN[0]
        totals, at = np.array([counts[token].sum(), (counts[token] > 0).sum()], np.int64), 0
        for shard, batch, key, _ in asked:
            mine = where[at : at + len(key)]
            got = counts[mine]
            # Most counts and the flag fit a byte; the other counts follow, with their places.
            large = np.flatnonzero(got > 126)
            code = (np.minimum(got, 127) * 2 + others[mine]).astype(np.uint8)
            rows.append((shard, batch, kind, pack(totals, code, narrow(large), narrow(got[large]))))
            at += len(key)
    return messages(rows)


def score_texts(docs: DataFrame, train: Column, strength: float = STRENGTH, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text with the model of the rows where ``train`` holds.

    Tokens: words in lower case (A-Z only), then one end.  Every distinct n-gram of
    up to ``order`` tokens of the training rows counts, whatever its frequency.
    Adds ``n_tokens``, ``n_known``, ``train_tokens`` (long), ``base_score`` (the
    unigram log10 probability with one added to each count and one place for
    unknown tokens) and ``score`` (the automaton's).  Null and empty texts are
    their end token.  A null condition trains.  Rows repeated in full count each
    time.  With no training row every count is 0.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [fresh(docs, c) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")]
    train_col = fresh(docs, "train")
    extra = docs.select("*", *[F.lit(None).cast("bigint" if i < 3 else "double").alias(n) for i, n in enumerate(names)]).schema
    arrow = to_arrow_schema(extra)
    n_shards, columns = partitions(docs) * SHARDS_PER_PARTITION, (id_col, text_col)
    rows = packed_batches(docs.withColumn(train_col, train), id_col, text_col)

    def begin(table: pa.Table) -> pa.Table:
        return _Grams(unpacked(table), columns, train_col, n_shards, min(2, order), 0, []).asks(number_of(table, "batch"))

    def further(level: int):
        def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows:
                return messages([])
            return _Grams(unpacked(table), columns, train_col, n_shards, level + 1, level, by_sender(answers)).asks(number_of(table, "batch"))

        return ask

    def result(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        table = unpacked(table)
        grams = _Grams(table, columns, train_col, n_shards, order, order, by_sender(answers))
        follow, first, parts = grams.follow(), grams.first, []
        ordered = (table.take(pa.array(grams.batch.order)) if grams.batch.moved else table).drop_columns([train_col])
        for row, to in grams.batch.chunks(most=PART):
            a, b, cut = first[row], first[to], first[row : to + 1] - first[row]
            counts = [c[a:b] for c in grams.counts]
            model = Automaton(counts, [f[a:b] for f in follow], grams.total, grams.distinct, strength)
            known = np.add.reduceat((counts[0] > 0).astype(np.int64), cut[:-1])
            base = np.add.reduceat(model.weight[0], cut[:-1])
            new = [np.diff(cut), known, np.full(to - row, grams.total), base, model.traverse(cut)]
            parts.append(pa.Table.from_arrays([*ordered.slice(row, to - row).columns, *map(pa.array, new)], names=arrow.names).cast(arrow))
        return pa.concat_tables(parts)

    answers = rows.groupBy("batch").applyInArrow(thrifty(begin), MESSAGE).groupBy("shard").applyInArrow(thrifty(_counted), MESSAGE)
    for level in range(2, order):
        asked = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(thrifty_pair(further(level)), MESSAGE)
        answers = answers.unionByName(asked.groupBy("shard").applyInArrow(thrifty(_counted), MESSAGE))
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(thrifty_pair(result), extra)


def op3_language_model(docs: DataFrame) -> DataFrame:
    """Scores of all documents; those whose crc32(doc_id) mod 7 is 2 are held out."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % 7
    held = docs.select("doc_id", "text", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"))
    return score_texts(held, ~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
