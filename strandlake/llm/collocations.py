"""Operator 12: phrase collocations from depth-limited count tries, merged by ranges of prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from strandlake.functions.ordered import checkpointed, running
from strandlake.llm.exchange import MESSAGE, by_sender, messages, number_of, partitions
from strandlake.llm.kernels import _LOWER, U, from_planes, narrow, pack, planes, portions, runs, thrifty, thrifty_pair, unpack, word_hashes

#: Words of a phrase at most: the depth of the tries.
DEPTH = 4
#: Occurrences of a prefix beyond which its children are spread over a further range.
SPLIT = 1 << 21
#: Ends a language in a word's key; no UTF-8 text has this byte.
_MARK = b"\xff"
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = _BREAK.copy()
_BLANK[[0x20, 0x09]] = True
_NODE = 9
_ID_BITS = 40


class Piece:
    """The words of some texts of one language: their distinct bytes, sorted, and one place in them for each word, 0 where a phrase must end."""

    def __init__(self, lang: bytes, texts: pa.Array):
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        cut, data = ends - ends[0], _LOWER[data]
        inside = ~_BLANK[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[cut] = True
        begin, stop = inside.copy(), np.zeros(len(data) + 1, bool)
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        stop[1:] = inside
        stop[1:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop)
        # A phrase ends where a mark or the end of a text lies between two words.
        marks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        text = np.searchsorted(cut, start, side="right")
        apart = (np.diff(marks[start]) > 0) | (np.diff(text) > 0) if len(start) else np.zeros(0, bool)
        hashes = word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
        _, one, place = np.unique(hashes, return_index=True, return_inverse=True)
        words = _taken(data, start[one], end[one])
        # Equal hashes of different words would merge them; their bytes tell.
        same = hashes_agree(data, start, end, one[place]) if len(start) else True
        if not same:
            words = _taken(data, start, end)
            encoded = words.dictionary_encode()
            words, place = encoded.dictionary, encoded.indices.to_numpy()
        order = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.lang, self.words, self.n = lang, words.take(pa.array(order)), len(start)
        # One empty place after each word that ends a piece.
        shift = np.arange(len(start)) + np.concatenate([[0], np.cumsum(apart)])[: len(start)]
        self.stream = np.zeros(int(shift[-1]) + 2 if len(start) else 0, np.int64)
        self.stream[shift] = rank[place] + 1

    def payload(self) -> bytes:
        word = self.words.cast(pa.large_binary())
        offsets = np.frombuffer(word.buffers()[1], np.int64)[word.offset : word.offset + len(word) + 1]
        data = np.frombuffer(word.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(word) and word.buffers()[2] is not None else np.zeros(0, np.uint8)
        raw = pack(np.frombuffer(self.lang, np.uint8), narrow(np.diff(offsets)), data, narrow(self.stream))
        return pa.compress(raw, "zstd", asbytes=True) + np.int64(len(raw)).tobytes()


def hashes_agree(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> bool:
    """Whether each word has the length and a second hash of the first word with its hash."""
    other = word_hashes(data, start, end, 1)
    return bool(((end - start) == (end - start)[first]).all() and (other == other[first]).all())


def _taken(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of a buffer as binary values."""
    size = (end - start).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[runs(start, size)]))])


def _pieces(n: int, id_col: str, text_col: str, lang_col: str, batches):
    """(batch, payload): the words of the rows of each batch and language."""
    for record in batches:
        for part in portions(record, text_col, 1 << 24):
            if not part.num_rows:
                continue
            batch = part.column("_batch").to_numpy(zero_copy_only=False)
            lang = pc.fill_null(part.column(lang_col).cast(pa.string()), "und")
            code = lang.dictionary_encode()
            which = code.indices.to_numpy(zero_copy_only=False)
            texts = pc.fill_null(part.column(text_col).cast(pa.large_binary()), b"")
            order = np.lexsort((which, batch))
            new = np.flatnonzero((np.diff(batch[order], prepend=-1) != 0) | (np.diff(which[order], prepend=-1) != 0))
            for a, b in zip(new, np.append(new[1:], len(order))):
                piece = Piece(code.dictionary[int(which[order[a]])].as_py().encode(), texts.take(pa.array(order[a:b])))
                if piece.n:
                    yield pa.RecordBatch.from_arrays([pa.array([batch[order[a]]], pa.int32()), pa.array([piece.payload()], pa.binary())], names=["batch", "payload"])


class Trie:
    """The count trie of a batch, grown by one depth in each round.

    Depth 1 has the words, each with its language; a node below is its parent and a
    word.  Only nodes that the merged trie keeps get children, and only where the
    words after the first are a kept node too: all others are rarer than a candidate
    may be.  Nodes are sent and answered in one order, that of their keys.
    """

    def __init__(self, table: pa.Table):
        langs, words, streams, base = [], [], [], 0
        parts = []
        for payload in table.column("payload"):
            raw = payload.as_py()
            lang, size, data, stream = unpack(pa.decompress(raw[:-8], int(np.frombuffer(raw[-8:], np.int64)[0]), "zstd", asbytes=True))
            offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            parts.append((lang.tobytes(), pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data.copy())]), stream))
        for lang, word, stream in parts:
            key = pc.binary_join_element_wise(pa.scalar(lang + _MARK, pa.large_binary()), word, pa.scalar(b"", pa.large_binary()))
            words.append(key)
            stream = stream.astype(np.int64)
            streams.append(np.where(stream > 0, stream + base, 0))
            base += len(word)
        keys = pa.chunked_array(words, pa.large_binary()).combine_chunks().dictionary_encode()
        if isinstance(keys, pa.ChunkedArray):
            keys = keys.combine_chunks()
        order = pc.sort_indices(keys.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys = keys.dictionary.take(pa.array(order)).cast(pa.large_binary())
        place = np.concatenate([[-1], rank[keys.indices.to_numpy(zero_copy_only=False)]])
        #: For each place of the stream the node of depth 1 that begins there, as a place in ``keys``; -1 for none.
        self.stream = place[np.concatenate(streams)] if streams else np.zeros(0, np.int64)
        self.count = np.bincount(self.stream[self.stream >= 0], minlength=len(self.keys))

    def word_shards(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(self.keys.buffers()[1], np.int64)[: len(self.keys) + 1]
        data = np.frombuffer(self.keys.buffers()[2], np.uint8)
        shard = (word_hashes(data, offsets[:-1], offsets[1:]) % U(n)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(n + 1))

    def grown(self, n: int, replies: dict[int, list[list[np.ndarray]]], depth: int):
        """Parent id, word id, count of the distinct children at ``depth``, in order of shard, parent and word; and their bounds by shard."""
        order, _ = self.word_shards(n)
        ids, often = np.zeros(len(self.keys), np.uint64), np.zeros(len(self.keys), np.int64)
        ids[order], often[order] = _answered(replies[1])
        at = self.stream >= 0
        node = np.where(at, ids[self.stream], U(0))
        word, times = node, np.where(at, often[self.stream], 0)
        for d in range(2, depth + 1):
            # The node that begins here, and the one that begins a word later, stand for the phrase without its last and its first word.
            can = np.flatnonzero((node[:-1] > 0) & (node[1:] > 0))
            parent, child, f = node[can], word[can + (d - 1)], times[can]
            up, u = np.unique(parent, return_inverse=True)
            down, w = np.unique(child, return_inverse=True)
            pair, first, inverse = np.unique(u.astype(np.uint64) << U(32) | w.astype(np.uint64), return_index=True, return_inverse=True)
            parent, child, f = parent[first], child[first], f[first]
            shard = _shards(parent, child, f, n)
            place = np.argsort(shard, kind="stable")
            if d == depth:
                return parent[place], child[place], np.bincount(inverse, minlength=len(pair))[place], np.searchsorted(shard[place], np.arange(n + 1))
            found, many = _answered(replies[d])
            ids, often = np.zeros(len(pair), np.uint64), np.zeros(len(pair), np.int64)
            ids[place], often[place] = found, many
            node, times = np.zeros(len(word), np.uint64), np.zeros(len(word), np.int64)
            node[can], times[can] = ids[inverse], often[inverse]


def _shards(parent: np.ndarray, word: np.ndarray, often: np.ndarray, n: int) -> np.ndarray:
    """The range that merges a child: that of its first word's id, or one after it for part of a prefix that is very frequent."""
    home = (parent >> U(_ID_BITS)) & U(0xFFFFF)
    wide = np.minimum(U(n), U(1) + often.astype(np.uint64) // U(SPLIT))
    return ((home + (word * U(0x9E3779B97F4A7C15) >> U(33)) % wide) % U(n)).astype(np.int64)


def _asked_words(n: int, table: pa.Table) -> pa.Table:
    number, trie = number_of(table, "batch"), Trie(table)
    order, cut = trie.word_shards(n)
    rows = []
    for k in np.flatnonzero(np.diff(cut)):
        i = order[cut[k] : cut[k + 1]]
        keys = trie.keys.take(pa.array(i))
        offsets = np.frombuffer(keys.buffers()[1], np.int64)[: len(keys) + 1]
        rows.append((int(k), number, 1, pack(narrow(np.diff(offsets)), np.frombuffer(keys.buffers()[2], np.uint8)[: offsets[-1]], narrow(trie.count[i]))))
    return messages(rows)


def _asked(n: int, depth: int, table: pa.Table, replies: pa.Table) -> pa.Table:
    if not table.num_rows:
        return messages([])
    number, trie, got = number_of(table, "batch"), Trie(table), {d: [] for d in range(1, depth)}
    for _, _, kind, arrays in by_sender(replies):
        got[kind].append(arrays)
    parent, word, count, cut = trie.grown(n, got, depth)
    return messages([(int(k), number, depth, _serialised(parent[a:b], word[a:b], count[a:b])) for k, a, b in zip(range(n), cut[:-1], cut[1:]) if a < b])


def _serialised(parent: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
    """Part of a trie in order: each parent once with its number of children, steps between the words of a parent, counts."""
    first = np.flatnonzero(np.diff(parent, prepend=parent[:1] + U(1)))
    step = np.diff(word, prepend=U(0))
    step[first] = word[first]
    return pack(planes(parent[first]), narrow(np.diff(np.append(first, len(parent)))), np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).ravel(), narrow(count))


def _restored(parents: np.ndarray, children: np.ndarray, steps: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, size = from_planes(parents), children.astype(np.int64)
    total = np.cumsum(np.ascontiguousarray(steps.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)
    first = np.cumsum(size) - size
    before = np.where(first > 0, total[first - 1], U(0))
    return np.repeat(up, size), total - np.repeat(before, size), count.astype(np.int64)


def _answer(ids: np.ndarray, often: np.ndarray) -> bytes:
    """Which of the asked nodes are kept, and the ids and counts of those."""
    kept = ids > 0
    return pack(np.array([len(ids)]), np.packbits(kept), ids[kept], narrow(often[kept]))


def _answered(replies: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids (0: not kept) and counts of all asked nodes, shard after shard."""
    ids, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for size, bits, found, many in replies:
        kept = np.unpackbits(bits)[: size[0]].astype(bool)
        i, f = np.zeros(size[0], np.uint64), np.zeros(size[0], np.int64)
        i[kept], f[kept] = found, many
        ids.append(i)
        often.append(f)
    return np.concatenate(ids), np.concatenate(often)


def _ids(depth: int, shard: int, n: int) -> np.ndarray:
    """New ids of a range: depth, then range, then number, so they are unique over all ranges and depths."""
    return (U(depth) << U(60)) | (U(shard) << U(_ID_BITS)) | np.arange(n, dtype=np.uint64)


def _merged_words(least: int, table: pa.Table) -> pa.Table:
    """The words of a range, and for each language how many there are in all."""
    shard, asked, keys, counts = number_of(table, "shard"), by_sender(table), [], []
    for _, _, _, (size, data, count) in asked:
        offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        keys.append(pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data.copy())]))
        counts.append(count.astype(np.int64))
    both = pa.table({"key": pa.chunked_array(keys, pa.large_binary()), "count": pa.array(np.concatenate(counts))})
    total = both.group_by("key").aggregate([("count", "sum")]).sort_by("key")
    f, key = total.column("count_sum").to_numpy(), total.column("key").combine_chunks()
    kept = np.flatnonzero(f >= least)
    ids = np.zeros(len(f), np.uint64)
    ids[kept] = _ids(1, shard, len(kept))
    place = pc.index_in(both.column("key"), key).to_numpy(zero_copy_only=False)
    rows, at = [], 0
    for (_, batch, _, (size, _, _)) in asked:
        mine = place[at : at + len(size)]
        rows.append((shard, batch, 1, _answer(ids[mine], f[mine])))
        at += len(size)
    words = [k.split(_MARK, 1) for k in key.to_pylist()]
    langs: dict[bytes, int] = {}
    for (lang, _), times in zip(words, f.tolist()):
        langs[lang] = langs.get(lang, 0) + times
    out = [(1, int(ids[i]), None, None, int(f[i]), words[i][0].decode(), words[i][1].decode()) for i in kept] + [(0, None, None, None, times, lang.decode(), None) for lang, times in langs.items()]
    return messages([*rows, (shard, -1 - shard, _NODE, _frame(out))])


_NODES = pa.schema([("depth", pa.int32()), ("id", pa.int64()), ("parent", pa.int64()), ("word", pa.int64()), ("f", pa.int64()), ("lang", pa.string()), ("text", pa.string())])
_NODES_SQL = "depth int, id long, parent long, word long, f long, lang string, text string"


def _frame(rows) -> bytes:
    return _stream(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_NODES)], schema=_NODES))


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _merged(least: int, depth: int, table: pa.Table) -> pa.Table:
    """A range of the merged trie at one depth, from the sorted parts that the batches sent."""
    shard, asked = number_of(table, "shard"), by_sender(table)
    parts = [_restored(*arrays) for *_, arrays in asked]
    parent, word, count = (np.concatenate(x) for x in zip(*parts))
    up, u = np.unique(parent, return_inverse=True)
    down, w = np.unique(word, return_inverse=True)
    # Each part is sorted, so a stable sort merges runs.
    key = u.astype(np.uint64) << U(32) | w.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] + U(1)))
    f = np.add.reduceat(count[order], new)
    kept = np.flatnonzero(f >= least)
    ids = np.zeros(len(new), np.uint64)
    ids[kept] = _ids(depth, shard, len(kept))
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
    place = np.empty(len(key), np.int64)
    place[order] = group
    rows, at = [], 0
    for (_, batch, _, _), part in zip(asked, parts):
        mine = place[at : at + len(part[0])]
        rows.append((shard, batch, depth, _answer(ids[mine], f[mine])))
        at += len(part[0])
    at = order[new[kept]]
    columns = [np.full(len(kept), depth, np.int32), ids[kept].view(np.int64), parent[at].view(np.int64), word[at].view(np.int64), f[kept]]
    nodes = pa.table([*[pa.array(c) for c in columns], pa.nulls(len(kept), pa.string()), pa.nulls(len(kept), pa.string())], schema=_NODES)
    return messages([*rows, (shard, -1 - shard, _NODE, _stream(nodes))])


def _opened(batches):
    for record in batches:
        for kind, payload in zip(record.column("kind").to_pylist(), record.column("payload")):
            if kind == _NODE:
                yield from pa.ipc.open_stream(payload.as_buffer()).read_all().cast(_NODES).to_batches()


def frequent_phrases(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The merged trie: ``depth``, ``id``, ``parent``, ``word`` (ids), ``f``, and for words ``lang`` and ``text``.

    Nodes are the phrases of 1 to DEPTH words that stand ``least`` times or more;
    rows of depth 0 have how many words a language has in all, in parts.
    """
    n = partitions(docs)
    number = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)).cast("int")
    texts = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col), number.alias("_batch"))
    pieces = texts.mapInArrow(thrifty(lambda b: (yield from _pieces(n, id_col, text_col, lang_col, b))), "batch int, payload binary").repartition(n, "batch")
    asked = pieces.groupBy("batch").applyInArrow(thrifty(lambda t: _asked_words(n, t)), MESSAGE)
    replies = [asked.groupBy("shard").applyInArrow(thrifty(lambda t: _merged_words(least, t)), MESSAGE).repartition(n, "batch")]
    for depth in range(2, DEPTH + 1):
        known = replies[0]
        for more in replies[1:]:
            known = known.union(more)
        asks = pieces.groupBy("batch").cogroup(known.groupBy("batch"))
        asked = asks.applyInArrow(thrifty_pair(lambda t, r, d=depth: _asked(n, d, t, r)), MESSAGE)
        replies.append(asked.groupBy("shard").applyInArrow(thrifty(lambda t, d=depth: _merged(least, d, t)), MESSAGE).repartition(n, "batch"))
    nodes = [r.mapInArrow(_opened, _NODES_SQL) for r in replies]
    out = nodes[0]
    for more in nodes[1:]:
        out = out.union(more)
    return checkpointed(out)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the best phrases of 2 to 4 words of each language.

    A phrase stands in a piece of text between two of ``. , ; : ! ?`` or line ends,
    ``least`` times or more; ``a`` is how often.  Cut after its first words, ``l`` and
    ``r`` are how often its parts stand, and its score is the least
    floor(2000000 a / (l + r)) over the cuts (ties: the earliest).  Phrases inside a
    longer one that stands at least ``covered`` per cent as often are left out.

    Null texts are empty, null languages ``und``; repeated rows count each.  An empty
    table gives no rows.  Only the three named columns are read.

    A batch of documents makes a trie of counts, one depth a round, and sends it in
    order, by ranges of prefixes, to the tasks that merge them; a prefix of more than
    SPLIT occurrences has several ranges.  Nodes that stand too seldom get no
    children, which loses nothing.  Words are told apart by their bytes and nodes by
    their parent and word, not by hashes.  Left parts are the nodes on the walk from
    the root; right parts are found by suffix links, where the link of (p, w) is the
    child by w of the link of p.
    """
    nodes = frequent_phrases(docs, least, id_col, text_col, lang_col)
    total = nodes.filter("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    one = nodes.filter("depth = 1").select("id", "lang", "text", "f")
    level = {d: nodes.filter(f"depth = {d}").select("id", "parent", "word", "f") for d in range(2, DEPTH + 1)}
    first, last = one.select(F.col("id").alias("parent"), "lang", F.col("text").alias("head"), F.col("f").alias("f1")), one.select(F.col("id").alias("word"), F.col("text").alias("last"), F.col("f").alias("f_last"))
    two = checkpointed(level[2].join(first, "parent").join(last, "word").select("id", "parent", F.col("word").alias("link"), "word", "lang", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f1", "f_last"))
    over = two.select(F.col("id").alias("parent"), F.col("link").alias("over_link"), "lang", F.col("phrase").alias("head"), "f1", F.col("f").alias("f12"))
    under = two.select(F.col("id").alias("link"), F.col("parent").alias("over_link"), "word", "last", "f_last", F.col("f").alias("f_link"))
    three = checkpointed(level[3].join(over, "parent").join(under, ["over_link", "word"]).select("id", "parent", "link", "word", "lang", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f1", "f12", "f_link", "f_last"))
    over = three.select(F.col("id").alias("parent"), F.col("parent").alias("p12"), F.col("link").alias("over_link"), "lang", F.col("phrase").alias("head"), "f1", "f12", F.col("f").alias("f123"))
    under = three.select(F.col("id").alias("link"), F.col("parent").alias("over_link"), F.col("link").alias("p34"), "word", "last", "f_last", F.col("f_link").alias("f34"), F.col("f").alias("f_link"))
    four = level[4].join(over, "parent").join(under, ["over_link", "word"]).select("id", "parent", "link", "p12", F.col("over_link").alias("p23"), "p34", "lang", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "f1", "f12", "f123", "f_link", "f34", "f_last")
    four = checkpointed(four)

    def scored(frame: DataFrame, *cuts: tuple[str, str]) -> DataFrame:
        def cut(k: int, left: str, right: str) -> Column:
            # Up to 10**19 occurrences fit in 38 digits.
            wide = F.expr(f"(cast(2000000 as decimal(7,0)) * cast(f as decimal(19,0))) div (cast({left} as decimal(19,0)) + cast({right} as decimal(19,0)))")
            return F.struct(wide.cast("long").alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

        best = F.array_min(F.array(*[cut(k + 1, *c) for k, c in enumerate(cuts)]))
        return frame.select("id", "lang", "phrase", F.col("f").alias("a"), best.alias("_cut"))

    inside = three.select(F.explode(F.array("parent", "link")).alias("id"), "f").union(four.select(F.explode(F.array("parent", "link", "p12", "p23", "p34")).alias("id"), "f"))
    most = inside.groupBy("id").agg(F.max("f").alias("_most"))
    found = scored(two, ("f1", "f_last")).union(scored(three, ("f1", "f_link"), ("f12", "f_last"))).union(scored(four, ("f1", "f_link"), ("f12", "f34"), ("f123", "f_last")))
    apart = found.join(most, "id", "left").filter(F.col("_most").isNull() | F.expr(f"100 * cast(_most as decimal(19,0)) < {int(covered)} * cast(a as decimal(19,0))"))
    apart = apart.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    # One order over all languages, and where each begins in it.
    ranked = running(apart.withColumnRenamed("score", "_score"), [F.col("lang"), F.desc("_score"), F.desc("a"), F.col("phrase")])
    begin = ranked.groupBy("lang").agg((F.min("rank") - 1).alias("_before"))
    best = ranked.join(begin, "lang").withColumn("rank", F.col("rank") - F.col("_before")).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("_score").alias("score"))


def op12_collocations(docs: DataFrame) -> DataFrame:
    """The 2000 best collocations of each language."""
    return collocations(docs.select("doc_id", "text", "lang"))


OP12_SQL = r"""WITH p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
halves AS MATERIALIZED (SELECT c.*, cut, array_to_string(list_slice(ws, 1, cut), ' ') AS head, array_to_string(list_slice(ws, cut + 1, k), ' ') AS rest FROM c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k),
cuts AS (SELECT h.lang, h.phrase, h.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * h.a) // (l.f + r.f) AS score FROM halves h LEFT JOIN f l ON l.lang = h.lang AND l.phrase = h.head LEFT JOIN f r ON r.lang = h.lang AND r.phrase = h.rest),
best AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
parts AS (SELECT DISTINCT c.lang, c.a AS longer, array_to_string(list_slice(c.ws, i, i + m - 1), ' ') AS phrase FROM c, (SELECT unnest([2, 3]) AS m) y, (SELECT unnest([1, 2, 3]) AS i) z WHERE m < c.k AND i + m - 1 <= c.k),
gone AS (SELECT DISTINCT b.lang, b.phrase FROM best b JOIN parts ON parts.lang = b.lang AND parts.phrase = b.phrase WHERE 100::HUGEINT * longer >= 80 * b.a),
n AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best b JOIN n ON n.lang = b.lang LEFT JOIN gone ON gone.lang = b.lang AND gone.phrase = b.phrase WHERE gone.phrase IS NULL QUALIFY rank <= 2000"""
