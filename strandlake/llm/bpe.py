"""Operator 2: byte-pair encoding by a segment tree over adjacent pair ranks."""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from strandlake.llm.kernels import KEPT, portions, thrifty

#: Unicode white space as the tokenizer's regular expressions see it.
WHITE = "\t-\r \x85\xa0  -     　"
#: Words of more bytes are merged one by one.
LONG = 1 << 10
#: Frequent marks at the end of a word; none begins a contraction.
MARKS = ".,;:!?)"
#: Texts that a worker remembers the tokens of, at most.
REMEMBERED = 1 << 19


def byte_characters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class SegmentTreeMerger:
    """Merges symbol rows by rank; many rows of a similar length at once.

    Over the places of a row stands a segment tree whose leaf i holds
    rank * width + i for the pair at i and the next living symbol, or nothing.
    The root so yields the leftmost pair of the lowest rank.  A merge changes the
    leaves of three places, and each change walks up one path of the tree.
    """

    NONE = np.int64(1) << 60

    def __init__(self, pairs: np.ndarray, merged: np.ndarray, size: int):
        """pairs: (n, 2) symbol ids by rank; merged: the id that each makes."""
        code = pairs[:, 0].astype(np.int64) * size + pairs[:, 1]
        order = np.argsort(code, kind="stable")
        self.size, self.code, self.rank_of, self.merged = size, code[order], order, merged

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where((self.code[at] == code) & (left >= 0) & (right >= 0), self.rank_of[at], -1)

    def merge(self, symbols: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
        """symbols: (rows, width) ids, padded with -1; width a power of two; ``rank`` of each and the next, if known. The result is padded in between."""
        rows, width = symbols.shape
        # All four tables are flat, a row of each after the other, with one place more than a row has symbols.
        step, half = width + 1, 2 * width
        sym = np.full((rows, step), -1, np.int64)
        sym[:, :width] = symbols
        tree = np.full((rows, half), self.NONE)
        if rank is None:
            rank = self.ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(rows, width)
        tree[:, width:] = np.where(rank >= 0, rank * width + np.arange(width), self.NONE)
        node = width
        while node > 1:
            node //= 2
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
        live = np.flatnonzero(tree[:, 1] < self.NONE) if width > 1 else np.zeros(0, np.int64)
        following = np.tile(np.minimum(np.arange(1, width + 2), width), rows)
        before = np.tile(np.arange(-1, width), rows)
        sym, tree = sym.ravel(), tree.ravel()
        while len(live):
            row, top = live * step, live * half
            best = tree[top + 1]
            at, made = best % width, self.merged[best // width]
            gone = following[row + at]
            sym[row + at], sym[row + gone] = made, -1
            then = following[row + gone]
            following[row + at] = then
            before[row + then] = at
            prior = before[row + at]
            # A row's first symbol has none before it: its own leaf is then set twice, to the same.
            left = np.where(prior >= 0, sym[row + np.maximum(prior, 0)], made)
            right = np.where(prior >= 0, made, sym[row + then])
            prior = np.where(prior >= 0, prior, at)
            rank = self.ranks(np.concatenate([made, left]), np.concatenate([sym[row + then], right]))
            leaf = np.concatenate([at, prior])
            tree[top + width + gone] = self.NONE
            tree[np.concatenate([top, top]) + width + leaf] = np.where(rank >= 0, rank * width + leaf, self.NONE)
            paths = np.concatenate([gone, leaf]) + width
            tops = np.concatenate([top, top, top])
            level = width >> 1
            while level:
                paths >>= 1
                child = tops + 2 * paths
                tree[tops + paths] = np.minimum(tree[child], tree[child + 1])
                level >>= 1
            live = live[tree[top + 1] < self.NONE]
        return sym.reshape(rows, step)[:, :width]


    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long row, all places of the root's rank at once.

        A pair that a merge makes ranks after it, so the root would yield all places
        of one rank, from left to right, before any other.  They are found by going
        down the tree wherever the least rank is; of places that overlap, as in a
        run of one symbol, every second one merges.
        """
        n = len(symbols)
        width = 1 << max(1, int(n - 1).bit_length())
        sym = np.full(width + 1, -1, np.int64)
        sym[:n] = symbols
        following, before = np.minimum(np.arange(1, width + 2), width), np.arange(-1, width)
        tree = np.full(2 * width, self.NONE)
        rank = self.ranks(sym[:-1], sym[1:])
        tree[width:] = np.where(rank >= 0, rank * width + np.arange(width), self.NONE)
        node = width
        while node > 1:
            node //= 2
            tree[node : 2 * node] = np.minimum(tree[2 * node : 4 * node : 2], tree[2 * node + 1 : 4 * node : 2])
        while tree[1] < self.NONE:
            least = tree[1] // width
            nodes = np.ones(1, np.int64)
            while nodes[0] < width:
                nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
                nodes = nodes[tree[nodes] // width == least]
            at = np.sort(nodes - width)
            first = np.ones(len(at), bool)
            first[1:] = following[at[:-1]] != at[1:]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            made, gone = self.merged[least], following[at]
            sym[at], sym[gone] = made, -1
            then = following[gone]
            following[at] = then
            before[then] = at
            prior = before[at]
            touched = np.unique(np.concatenate([at, prior[prior >= 0]]))
            rank = self.ranks(sym[touched], sym[following[touched]])
            tree[width + gone] = self.NONE
            tree[width + touched] = np.where(rank >= 0, rank * width + touched, self.NONE)
            paths = np.unique(np.concatenate([gone, touched]) + width)
            while paths[0] > 1:
                paths = np.unique(paths >> 1)
                tree[paths] = np.minimum(tree[2 * paths], tree[2 * paths + 1])
        return sym[:n]


class Tokenizer:
    """A byte-level BPE tokenizer read from a tokenizers JSON file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.merger = SegmentTreeMerger(pairs, made, max(self.tokens) + 1)
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        # Ranks of pairs of bytes; 256 more for the last byte of a word, and 512 for none.
        self.symbols = np.concatenate([self.inner, self.last, [-1]])
        self.rank = self.merger.ranks(np.repeat(self.symbols, 513), np.tile(self.symbols, 513)).astype(np.int32)
        # Word-level files lower and compose the text and drop white space; byte-level files keep every byte.
        self.lowers = bool(spec["normalizer"])
        contractions, letters = "'s|'t|'re|'ve|'m|'ll|'d", rf"[^{WHITE}\p{{L}}\p{{N}}]+"
        if self.lowers:
            self.words = regex.compile(rf"{contractions}|\p{{L}}+|\p{{N}}|{letters}")
            self.units = re.compile(f"[^{WHITE}]+")
        else:
            self.words = regex.compile(rf"{contractions}| ?\p{{L}}+| ?\p{{N}}+| ?{letters}|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
            self.units = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: Texts that are remembered, at most.
        self.remembered = REMEMBERED
        self.known: dict = {}
        self.older: dict = {}
        self.encoded: dict = {}

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        """The token ids of each word, as 32-bit integers."""
        out, chars = [None] * len(words), self.symbols
        sizes = np.array([len(w) for w in words])
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for i in np.flatnonzero(widths > LONG):
            row = self.inner[np.frombuffer(words[i], np.uint8)]
            row[-1] = self.last[words[i][-1]]
            done = self.merger.merge_long(row)
            out[i] = done[done >= 0].astype("<i4").tobytes()
        for width in np.unique(widths[widths <= LONG]):
            mine = np.flatnonzero(widths == width)
            step = max(1, (1 << 17) // int(width))
            for k in range(0, len(mine), step):
                part = mine[k : k + step]
                data = np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8).astype(np.int32)
                data[np.cumsum(sizes[part]) - 1] += 256
                byte = np.full((len(part), width + 1), 512, np.int32)
                byte[:, :-1][np.arange(width) < sizes[part][:, None]] = data
                done = self.merger.merge(chars[byte[:, :-1]], self.rank[byte[:, :-1] * 513 + byte[:, 1:]].astype(np.int64))
                alive = done >= 0
                ids, ends = done[alive].astype("<i4").tobytes(), (4 * np.cumsum(alive.sum(1))).tolist()
                begin = 0
                for i, end in zip(part.tolist(), ends):
                    out[i] = ids[begin:end]
                    begin = end
        return out

    def _split(self, unit: str) -> list[bytes]:
        if self.lowers:
            unit = unit if unit.isascii() else unicodedata.normalize("NFC", unit)
            unit = unit.lower() if "Σ" not in unit else "".join(c.lower() for c in unit)
            if unit.isalpha():
                return [unit.encode()]
        # Letters and one run of marks are two words.
        letters = unit.rstrip(MARKS)
        if letters != unit and letters[letters[:1] == " " :].isalpha():
            return [letters.encode(), unit[len(letters) :].encode()]
        return [w.encode() for w in self.words.findall(unit)]

    def learn(self, units: set, form) -> None:
        """Encodes the units that are not yet known; ``form`` makes what is remembered from their ids' bytes."""
        if not self.lowers:
            # Units of letters alone are words themselves.
            plain = [u for u in units if u.isalpha() or u[0] == " " and u[1:].isalpha()]
            self.known.update(zip(plain, map(form, self.word_ids([u.encode() for u in plain]))))
            units.difference_update(plain)
        split = {u: self._split(u) for u in units}
        new = list(set(chain.from_iterable(split.values())) - self.encoded.keys())
        self.encoded.update(zip(new, self.word_ids(new)))
        for unit, words in split.items():
            self.known[unit] = form(self.encoded[words[0]] if len(words) == 1 else b"".join([self.encoded[w] for w in words]))

    def encode_batch(self, texts: list[str], form, forms_special: dict) -> list[list]:
        """For each text the forms of its units, in order.

        Nothing here refers to itself, and the search for what does would go through
        millions of units again and again, so it waits.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts, form, forms_special)
        finally:
            if collects:
                gc.enable()

    def _encoded(self, texts: list[str], form, forms_special: dict) -> list[list]:
        if len(self.known) > self.remembered // 2:
            # What is met again is taken over; the rest goes with the next generation.
            self.older, self.known = self.known, {}
        if len(self.encoded) > self.remembered // 2:
            self.encoded.clear()
        # Each text as lists of units and, between them, forms of special tokens.
        cut, seen = [], set()
        for text in texts:
            row: list = []
            if self.specials is not None and self.specials.search(text):
                at = 0
                for m in self.specials.finditer(text):
                    row += [self.units.findall(text[at : m.start()]), forms_special[m[0]]]
                    at = m.end()
                text = text[at:]
            row.append(self.units.findall(text))
            seen.update(*row[::2])
            cut.append(row)
        # A unit is looked for once, however often it stands in the texts.
        new = seen.difference(self.known)
        again = {u: self.older[u] for u in new if u in self.older} if self.older else {}
        self.known.update(again)
        self.learn(new.difference(again), form)
        get, out = self.known.__getitem__, []
        for k, row in enumerate(cut):
            done = list(map(get, row[0]))
            for special, units in zip(row[1::2], row[2::2]):
                done.append(special)
                done += map(get, units)
            out.append(done)
            cut[k] = None
        return out


def load(data: bytes, use: str) -> Tokenizer:
    """The tokenizer of a file's bytes, kept by the worker while its work is of kind ``use``."""
    key = (use, f"{zlib.crc32(data)} {len(data)}")
    if key not in KEPT:
        KEPT[key] = Tokenizer(data)
    return KEPT[key]


def _parts(table_batch: pa.RecordBatch, text_col: str, most: int = 1 << 21):
    """Rows of a batch in parts of about ``most`` bytes of text; null texts are empty."""
    at = 0
    for part in portions(table_batch, text_col, most):
        yield at, at + part.num_rows, [t or "" for t in part.column(text_col).to_pylist()]
        at += part.num_rows


def encode_decode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int), and ``decoded`` (string): the texts encoded and decoded again.

    The whole text is encoded; strings of special tokens become those tokens, as
    the file says.  A null or empty text has no ids and an empty decoded text.
    Without a decoder in the file, decoding joins the tokens by one space.  The
    file's bytes (a few MB, whatever the data) go to the tasks by broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from strandlake.llm.exchange import fresh

    ids_col, decoded_col = fresh(docs, "ids"), fresh(docs, "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded_col, T.StringType())])
    arrow = to_arrow_schema(schema)
    with open(path, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        tokenizer = load(data.value, "decode")
        tokens = tokenizer.tokens

        def form(ids):
            return ids, " ".join([tokens[i] for i in memoryview(ids).cast("i")])

        special = {t: (np.int32(i).tobytes(), t) for t, i in tokenizer.special.items()}
        for batch in batches:
            for begin, end, texts in _parts(batch, text_col):
                done = tokenizer.encode_batch(texts, form, special)
                ids = [b"".join([u[0] for u in row]) for row in done]
                offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                decoded = pa.array([" ".join([u[1] for u in row]) for row in done], pa.string())
                columns = batch.slice(begin, end - begin).columns
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*columns, lists, decoded], arrow)], schema=arrow)

    return docs.mapInArrow(thrifty(run, "decode"), schema)


def op2_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of all documents' ids and decoded texts."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    done = encode_decode(docs.select("doc_id", "text"), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
