"""Document operators against brute force, with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
EXTRA = [(100000, "a " * 300), (100001, "a " * 200 + "b " * 70), (100002, None), (100003, ""), (100004, "x y z " * 60), (100005, "q x y z " + "y z x " * 50), (100006, "é" * 400), (100007, "-" * 5000), (100008, "One  two\n\nOne two\n One two"), (100009, "<|endoftext|> it's 12 ² x")]

#: A row of symbols and its complement, which any polynomial hash modulo 2**64 takes for the same.
MORSE = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(4096)) for k in (0, 1)]
SIXTY = " ".join(f"w{k}" for k in range(60))
EXTRA += [(100010, MORSE[0]), (100011, MORSE[1]), (100012, f"{SIXTY} {MORSE[0]}"), (100013, f"{SIXTY} {MORSE[1]}"), (100014, " ".join(MORSE[0])), (100015, " ".join(MORSE[1])), (100016, f"start {' '.join(MORSE[1])}")]


@pytest.fixture(scope="module")
def docs(spark):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return some.unionByName(spark.createDataFrame(EXTRA, "doc_id long, text string")).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: (r.text or "") for r in docs.collect()}


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_suffix_dedup(docs, texts):
    from strandlake.llm.suffix_dedup import op1_suffix_dedup

    got, seen = {r.doc_id: r for r in op1_suffix_dedup(docs).collect()}, set()
    for i in sorted(texts):
        b = texts[i].encode()
        mark = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                mark[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        spans = sum(1 for k in range(len(b)) if mark[k] and (k == 0 or not mark[k - 1]))
        assert tuple(got[i]) == (i, len(b), sum(mark), spans, digest(bytes(x for x, m in zip(b, mark) if not m)))


def test_suffix_family_levels():
    from strandlake.llm.suffix_dedup import SuffixFamily

    rng = np.random.default_rng(5)
    data = np.frombuffer("".join("ab\0"[k] for k in rng.integers(0, 3, 400)).encode(), np.uint8)
    family, seen = SuffixFamily(data, 4, base=4), set()
    family.BLOCK = 5
    places = rng.permutation(len(data) - 3)
    for k in range(0, len(places), 7):
        want = []
        for w in (data[p : p + 4].tobytes() for p in places[k : k + 7]):
            want.append(w in seen)
            seen.add(w)
        assert family.add(places[k : k + 7]).tolist() == want
    assert len(family.levels) == len(set(family.levels)) and sum(map(len, family.levels.values())) == len(seen)
    for level in family.levels.values():
        spelt = [data[p : p + 4].tobytes() for p in level]
        assert spelt == sorted(spelt)


def test_passage_dedup(docs, texts):
    from strandlake.llm.recompress import op8_passage_dedup

    got, seen = {r.doc_id: r for r in op8_passage_dedup(docs).collect()}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i].encode())
        mark = [0] * len(w)
        for s in range(len(w) - 49):
            if seen.setdefault(b" ".join(w[s : s + 50]), i) < i:
                mark[s : s + 50] = [1] * 50
        assert tuple(got[i]) == (i, len(w), sum(mark), digest(b" ".join(x for x, m in zip(w, mark) if not m)))


def test_language_model(docs, texts, monkeypatch):
    from strandlake.llm import language_model
    from strandlake.llm.language_model import STRENGTH, op3_language_model

    tokens = {i: ["<s>", *WORD.findall(t.encode().translate(LOWER)), None] for i, t in texts.items()}
    seen, followed = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for k in range(1, len(t)):
                for n in (1, 2, 3):
                    if n <= k + 1:
                        seen[tuple(t[k - n + 1 : k + 1])] += 1
                        followed[tuple(t[k - n + 1 : k])] += 1
    total, distinct = sum(c for g, c in seen.items() if len(g) == 1), sum(len(g) == 1 for g in seen)

    def p(*gram):
        if len(gram) == 1:
            return (seen[gram] + 1) / (total + distinct + 1)
        return (seen[gram] + STRENGTH * p(*gram[1:])) / (followed[gram[:-1]] + STRENGTH)

    monkeypatch.setattr(language_model, "PIECE", 7)  # so that a text has many lanes; workers may keep the usual size
    for r in op3_language_model(docs).collect():
        t = tokens[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t) - 1, sum(seen[x,] > 0 for x in t[1:]), total)
        assert r.base_score == pytest.approx(sum(math.log10(p(x)) for x in t[1:]))
        assert r.score == pytest.approx(sum(math.log10(p(*t[max(0, k - 2) : k + 1])) for k in range(1, len(t))))
    words = [g[0] for g in seen if len(g) == 1]
    for h in [(), ("<s>",), max((g for g in followed if len(g) == 2), key=followed.get)]:
        assert sum(p(*h, x) for x in words) + p(*h, "unknown") == pytest.approx(1)


def test_lanes_forget():
    from strandlake.llm import language_model
    from strandlake.llm.language_model import Automaton

    rng = np.random.default_rng(3)
    first = np.array([0, 1, 40, 41, 2000])
    counts = [rng.integers(1, 9, 2000), rng.integers(0, 3, 2000), rng.integers(0, 2, 2000)]
    counts[2] *= counts[1] > 0  # a longer n-gram is only seen where its end is
    follow = [np.append(0, counts[0][:-1]), np.append(0, counts[1][:-1])]
    follow[1][first[:-1]] = counts[2][first[:-1]] = 0
    counts[2] *= follow[1] > 0
    model = Automaton(counts, follow, 9000, 50, 3.0)
    whole = model.traverse(first)
    size, language_model.PIECE = language_model.PIECE, 13
    try:
        assert model.traverse(first) == pytest.approx(whole)
    finally:
        language_model.PIECE = size


def test_bpe(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from strandlake.llm.bpe import op2_bpe

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in op2_bpe(docs).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), digest(" ".join(map(str, ids)).encode()), digest(t.decode(ids, skip_special_tokens=False).encode()))


def test_long_words_merge_like_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    from strandlake.llm import bpe

    rng = np.random.default_rng(2)
    long = ["a" * 5000, "ab" * 3000 + "a", "".join("thenra"[k] for k in rng.integers(0, 6, 20000)), "é" * 1500 + "x"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        with open(public_tokenizers.path(name), "rb") as file:
            own = bpe.Tokenizer(file.read())
        theirs = Tokenizer.from_file(public_tokenizers.path(name))
        for text, units in zip(long, own.encode_batch(long, lambda b: b, {})):
            assert np.frombuffer(b"".join(units), "<i4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    unbroken = bpe.Tokenizer.word_ids(own, [bytes(rng.integers(97, 123, 1 << 20, dtype=np.uint8))])[0]
    assert len(unbroken) > 1 << 20


def test_packing(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from strandlake.llm.packing import op6_packing

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}
    bins, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in op6_packing(docs).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for i, x in ids.items():
        cut = sorted(pieces[i])
        assert [s + n for _, s, n in cut] == [*[s for _, s, _ in cut[1:]], len(x)] and cut[0][:2] == (0, 0)
        assert all(n == 1024 for *_, n in cut[1:])
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.03 * sum(map(len, ids.values())) / 1024 + 1


def test_near_dedup(docs, texts):
    from strandlake.llm.near_dedup import op9_near_dedup

    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.encode())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            a, b = sets[i], sets[j]
            if i < j and (a == b or len(a & b) >= 0.8 * len(a | b)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert {r.doc_id: r.class_id for r in op9_near_dedup(docs).collect()} == {i: find(i) for i in texts}


def test_darts_meet_with_the_weighted_similarity():
    from strandlake.llm.near_dedup import dart_signatures

    rng = np.random.default_rng(8)
    weights = rng.integers(0, 6, (2, 60))
    owner, element = np.nonzero(weights)
    k = 4000
    sig = dart_signatures(owner, element.astype(np.uint64) * np.uint64(7919), weights[owner, element], 2, k)
    want = np.minimum(*weights).sum() / np.maximum(*weights).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / k)


def test_weighted_candidates_find_the_same_classes(docs):
    from strandlake.llm.near_dedup import near_duplicates, op9_near_dedup

    weighted = near_duplicates(docs.select("doc_id", "text"), weighted=True).select("doc_id", "class_id")
    assert sorted(map(tuple, weighted.collect())) == sorted(map(tuple, op9_near_dedup(docs).collect()))


def test_empty_rules_chats_and_clashes(spark, docs):
    from pyspark.sql import functions as F

    from strandlake.llm.bpe import encode_decode
    from strandlake.llm.chat_format import op10_chat_format
    from strandlake.llm.language_model import score_texts
    from strandlake.llm.quality_rules import op4_quality_rules
    from strandlake.llm.suffix_dedup import suffix_dedup

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op4_quality_rules(docs.limit(0).withColumn("lang", F.lit("en")), labels).count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in op10_chat_format(chats).collect()] == [-7]
    odd = docs.limit(6)
    for name in ("batch", "kept", "spans", "ids", "decoded", "train", "score", "n_tokens", "shard"):
        odd = odd.withColumn(name, F.lit("x"))
    import public_tokenizers

    for done in (suffix_dedup(odd), score_texts(odd, F.lit(True)), encode_decode(odd, public_tokenizers.path("word_bpe_49k.json"))):
        assert done.columns[: len(odd.columns)] == odd.columns and done.filter("batch = 'x' and ids = 'x'").count() == 6


def test_quality_counts(spark, docs, texts):
    from pyspark.sql import functions as F

    from strandlake.llm.quality_rules import op4_quality_rules

    labels = spark.createDataFrame([(i, 1 if i % 3 else None, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    for r in op4_quality_rules(docs.withColumn("lang", F.lit(None).cast("string")), labels).collect():
        t = texts[r.doc_id]
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        count, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
        for k in range(len(w) - 2):
            if count[w[k], w[k + 1], w[k + 2]] > 1:
                covered |= {k, k + 1, k + 2}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert tuple(r)[1:7] == (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), failed)
        assert r.kept == (not failed)  # a hundred labels make no cutoff safe


def test_binomial_bound():
    from strandlake.llm.quality_rules import CUTOFFS, strictest, tail

    assert tail(0, 100, 0.03) == pytest.approx(0.97**100)
    assert tail(2, 10, 0.5) == pytest.approx(56 / 1024)
    assert strictest(np.zeros(len(CUTOFFS), int), 100, 0.005, 0.05) is None
    assert strictest(np.zeros(len(CUTOFFS), int), 1000, 0.005, 0.05) == CUTOFFS[-1]


def test_bm25(docs, texts):
    from strandlake.llm.bm25 import op7_bm25

    terms = {i: collections.Counter(WORD.findall(t.encode().translate(LOWER))) for i, t in texts.items()}
    df = collections.Counter(w for c in terms.values() for w in c)
    n, length = len(terms), {i: sum(c.values()) for i, c in terms.items()}
    mean, got = sum(length.values()) / n, collections.defaultdict(list)
    for r in op7_bm25(docs).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    for q in (i for i in texts if i % 20 == 0):
        score = {i: sum(f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w, f in terms[q].items() if w in c) for i, c in terms.items()}
        best = sorted((x for x in score.values() if x > 0), reverse=True)[:10]
        assert [s for *_, s in sorted(got[q])] == pytest.approx(best)
        assert all(score[i] == pytest.approx(s) for _, i, s in got[q])


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_bpe", "op3_language_model", "op6_packing", "op7_bm25", "op8_passage_dedup", "op9_near_dedup"])
def test_empty_table(spark, docs, name):
    import importlib

    module = {"op1": "suffix_dedup", "op2": "bpe", "op3": "language_model", "op6": "packing", "op7": "bm25", "op8": "recompress", "op9": "near_dedup"}[name[:3]]
    assert getattr(importlib.import_module(f"strandlake.llm.{module}"), name)(docs.limit(0)).count() == 0


def test_clashing_columns(docs):
    from pyspark.sql import functions as F

    from strandlake.llm.recompress import passage_dedup

    odd = docs.limit(5).withColumn("batch", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("n_words", F.lit(2))
    assert passage_dedup(odd).columns[:5] == odd.columns and passage_dedup(odd).count() == 5


def test_small_strata_reject_junk(spark):
    """Strata too small for a cutoff of their own take the pooled one, if their own clean texts allow it."""
    from strandlake.llm.quality_rules import quality_rules

    def text(i: int, junk: bool) -> str:
        return " ".join(f"w{i}x{k}" for k in range(60)) + " #" * 30 * junk

    # (language, clean labels, whether the clean texts have symbols, unlabelled junk); 2,540 clean texts can certify a cutoff, 3 of them over.
    plan = [("en", 2500, False, 3), ("fr", 37, False, 3), ("hi", 3, True, 3), ("es", 0, False, 3), (None, 0, False, 3)]
    rows, labels = [], []
    for lang, clean, symbols, junk in plan:
        for j in range(clean + junk):
            rows.append((len(rows), text(len(rows), symbols or j >= clean), lang, "clean" if j < clean else "junk"))
            if j < clean:
                labels.append((rows[-1][0], 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")
    kept = collections.Counter((r.lang, r.kind) for r in quality_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).filter("kept").collect())
    assert kept == {("en", "clean"): 2500, ("fr", "clean"): 37, ("hi", "clean"): 3, ("hi", "junk"): 3}


def test_one_of_each_class_with_repeated_ids(spark):
    from strandlake.llm.near_dedup import one_of_each

    text = lambda k, more="": " ".join(f"t{k}w{i}" for i in range(60)) + more
    # Two classes led by 1; class 2 has a row of id 1 that leads another; ids that are null; copies of one row.
    rows = [(1, text(0)), (1, text(1)), (2, text(1, " end")), (3, text(2)), (3, text(2)), (3, text(2) + " "), (4, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (5, text(4)), (6, text(5)), (6, text(0)), (7, None), (8, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, text(0)), (1, text(1)), (None, text(3)), (5, text(4)), (6, text(5))]
    for parts in (1, 5):
        got = [tuple(r) for r in one_of_each(frame.repartition(parts)).collect()]
        assert sorted([(i, t) for i, t in got if i not in (3, 7)], key=str) == sorted(want, key=str)
        least = min([text(2), text(2) + " "], key=lambda t: digest(t.encode()))
        assert [t for i, t in got if i == 3] == [least] and [t for i, t in got if i == 7] == [None]


def test_bm25_whatever_the_partitions(spark):
    """Copies tie, ties go to the smaller id, and rows are the same for any number of partitions."""
    from strandlake.llm.bm25 import op7_bm25

    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(120).collect()
    rows = [(r.doc_id, r.text) for r in some] + [(1000 + 7 * k, some[k % 5].text) for k in range(60)]
    frame, seen, before = spark.createDataFrame(rows, "doc_id long, text string"), [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(tuple(r) for r in op7_bm25(frame).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]
    texts, by = dict(rows), collections.defaultdict(list)
    for query, doc, rank, score in seen[0]:
        by[query].append((rank, doc, score))
    for found in by.values():
        found.sort()
        for (_, a, x), (_, b, y) in zip(found, found[1:]):
            assert x > y or x == y and a < b
            assert x == y or texts[a] != texts[b]


def test_bm25_skips_blocks_and_keeps_the_best():
    """Blocks that block maxima keep below the threshold are not scored; what is left holds the best, which add up to their scores."""
    from strandlake.llm import bm25

    rng, n, k = np.random.default_rng(5), 640, 10
    # Four subjects of 160 documents; twenty common words of each, and rare words of all.
    tf = np.zeros((n, 300), np.int64)
    for d in range(n):
        own = 20 * (d // 160)
        tf[d, own : own + 20] = rng.integers(0, 6, 20)
        tf[d, rng.integers(80, 300, 3)] += 1
    tf[7] = tf[3]
    term, doc = np.nonzero(tf.T)
    lists, length = np.bincount(term, minlength=300), tf.sum(1)
    index = bm25.BlockIndex(np.arange(n), length, np.arange(300, dtype=np.uint64), lists, lists, doc, tf[doc, term], n, int(length.sum()))
    asks = np.array([3, 200, 400, 639])
    which, words = np.nonzero(tf[asks])
    cut = np.searchsorted(which, np.arange(len(asks) + 1))
    placed = index.placed(cut, words.astype(np.uint64), tf[asks][which, words])
    full = np.zeros((len(asks), n))
    for q, w, add in zip(which, placed[1], placed[2]):
        full[q] += add * tf[:, w] * 2.2 / (tf[:, w] + 1.2 * (0.25 + 0.75 * length / length.mean()))
    best = np.sort(full, 1)[:, ::-1]
    for least in (np.zeros(len(asks)), best[:, k - 1] * (1 - 1e-9)):
        index.scored = 0
        row, place, score = index.search(bm25._Dense(index), *placed, k, least)
        for q in range(len(asks)):
            assert {*np.flatnonzero(full[q] >= best[q, k - 1])} <= {*place[row == q].tolist()}
        exact = index.added(*placed, row, place)
        assert exact == pytest.approx(full[row, place]) and score == pytest.approx(exact, rel=1e-5)
    assert index.scored < len(asks) * index.n_blocks / 2
    assert len({x for x, q, d in zip(exact, row, place) if q == 0 and d in (3, 7)}) == 1


def test_what_a_tokenizer_remembers_is_its_own():
    """A unit is learnt once for all texts of a part, and what is forgotten is learnt again to the same ids."""
    import public_tokenizers
    from tokenizers import Tokenizer as Library

    from strandlake.llm import bpe

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        tokenizer = bpe.Tokenizer(file.read())
    tokenizer.remembered, library = 40, Library.from_file(path)
    special = {t: np.int32(i).tobytes() for t, i in tokenizer.special.items()}
    mark = next(iter(special))
    for part in range(6):
        texts = [f"the word{k * part}x, and {mark}the  end{k}\n{mark}{mark} of {part}!" for k in range(30)] + ["", mark, " "]
        got = [np.frombuffer(b"".join(units), np.int32).tolist() for units in tokenizer.encode_batch(texts, lambda b: b, special)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(tokenizer.known) <= 20 + 100


def test_bm25_merges_batches_before_it_searches():
    """Batches of one group are searched as one: a query has k rows of the group, not of each batch, and they are the best of all."""
    import pyarrow as pa

    from strandlake.llm import bm25

    rng, k, batches, columns = np.random.default_rng(8), 10, 6, ("doc_id", "text")
    # Two languages of 200 words, short texts and long ones.
    texts = {i: " ".join(f"{'ab'[i % 2]}{w}" for w in rng.zipf(1.3, rng.integers(1, 400)) % 200) for i in range(900)} | {900: None, 901: " ", 902: ""}
    texts[440] = texts[20]
    tables = []
    for b in range(batches):
        ids = [i for i in texts if i % batches == b]
        tables.append(pa.table({"doc_id": ids, "text": pa.array([texts[i] for i in ids], pa.string()), "_asks": [i % 20 == 0 for i in ids], "_batch": pa.array([b] * len(ids), pa.int32())}))
    asked = pa.concat_tables([bm25._asked(1, columns, t) for t in tables])
    counted = bm25._counted(asked)
    indexed = [bm25._indexed(1, 1, 1, columns, t, counted.filter(pa.array([b == n for n in counted.column("batch").to_pylist()]))) for b, t in enumerate(tables)]
    found = bm25._found(k, pa.concat_tables(indexed)).to_pylist()
    terms = {i: collections.Counter((t or "").split()) for i, t in texts.items()}
    df, length = collections.Counter(w for c in terms.values() for w in c), {i: sum(c.values()) for i, c in terms.items()}
    mean, got = sum(length.values()) / len(texts), collections.defaultdict(list)
    for r in found:
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    assert len(found) <= k * len(got) and set(got) == {i for i in texts if i % 20 == 0 and terms[i]}
    for q, best in got.items():
        score = {i: sum(f * math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for w, f in terms[q].items() if w in c) for i, c in terms.items()}
        assert sorted((s for _, s in best), reverse=True) == pytest.approx(sorted((s for s in score.values() if s > 0), reverse=True)[:k])
        assert all(s == pytest.approx(score[i]) for i, s in best)
    assert len({s for i, s in got[20] if i in (20, 440)}) == 1
    # Terms of queries travel once, with steps between them.
    postings = sum(len(terms[q]) for q in got)
    assert sum(len(r["payload"]) for t in indexed for r in t.to_pylist() if r["kind"] == 1) < 8 * postings


def test_bm25_holds_some_batches_of_a_group(monkeypatch):
    """A group is searched some batches at a time, so its postings are not all held at once; it finds the same whatever is held."""
    import tracemalloc

    import pyarrow as pa

    from strandlake.llm import bm25

    rng, batches, columns = np.random.default_rng(4), 12, ("doc_id", "text")
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.2, 400) % 20000) for _ in range(1800)]
    texts[20] = texts[33] = texts[47]
    tables = [pa.table({"doc_id": range(b, 1800, batches), "text": texts[b::batches], "_asks": [i % 60 == 20 for i in range(b, 1800, batches)], "_batch": pa.array([b] * 150, pa.int32())}) for b in range(batches)]
    counted = bm25._counted(pa.concat_tables([bm25._asked(1, columns, t) for t in tables]))
    group = pa.concat_tables([bm25._indexed(1, 1, 1, columns, t, counted.filter(pa.array([b == n for n in counted.column("batch").to_pylist()]))) for b, t in enumerate(tables)])
    postings = sum(len(set(t.split())) for t in texts)
    at_once = bm25._found(10, group).to_pylist()
    for name, value in (("STEP", 1 << 13), ("CELLS", 1 << 13), ("POSTINGS", postings // 6)):
        monkeypatch.setattr(bm25, name, value, raising=False)
    tracemalloc.start()
    found = bm25._found(10, group).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == at_once and len(found) == 300
    assert [r["doc_id"] for r in found if r["query_id"] == 20][:3] == [20, 33, 47]
    # Bytes besides the messages, which are there at first.
    assert (peak - sum(len(p) for p in group.column("payload").to_pylist())) / postings < 16, peak


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizer_spends_no_time_on_what_it_knows(name):
    """Ranks of a word's bytes come from a table; units are not gone through for cycles while texts are encoded."""
    import gc

    import public_tokenizers
    from tokenizers import Tokenizer as Library

    from strandlake.llm import bpe

    path = public_tokenizers.path(name)
    with open(path, "rb") as file:
        tokenizer = bpe.Tokenizer(file.read())
    texts = [" ".join(f"é{k}w{i * 7919 % 10007:x}, Straße" + "y" * (i % 40) for i in range(2000)) for k in range(4)] + ["", "a", "x" * 3000]
    seen, ranks = [], tokenizer.merger.ranks
    note = lambda phase, info: seen.append(phase)
    gc.collect()
    gc.callbacks.append(note)
    try:
        got = tokenizer.encode_batch(texts, lambda b: b, {t: np.int32(i).tobytes() for t, i in tokenizer.special.items()})
    finally:
        gc.callbacks.remove(note)
    assert not seen and gc.isenabled()
    assert [np.frombuffer(b"".join(units), np.int32).tolist() for units in got] == [library.ids for library in Library.from_file(path).encode_batch(texts, add_special_tokens=False)]
    code = np.arange(513)
    assert (tokenizer.rank.reshape(513, 513) == ranks(np.repeat(tokenizer.symbols[code], 513), np.tile(tokenizer.symbols[code], 513)).reshape(513, 513)).all()


def test_darts_look_at_many_cells_together(monkeypatch):
    from strandlake.llm import near_dedup

    sizes = [1, 0, 2, 400, 3000]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    element = near_dedup.mix(np.arange(len(owner), dtype=np.uint64))
    calls = []
    monkeypatch.setattr(near_dedup, "mix", lambda x, mix=near_dedup.mix: calls.append(len(x)) or mix(x))
    found = near_dedup.dart_signatures(owner, element, np.ones(len(owner), np.int64), len(sizes), 160)
    # One by one, the cells of a set of one element took four calls each.
    assert len(calls) < 1000
    # What each set keeps is what it keeps alone, and none of the coordinates is empty.
    for i in range(len(sizes)):
        mine = owner == i
        alone = near_dedup.dart_signatures(owner[mine] * 0, element[mine], np.ones(sizes[i], np.int64), 1, 160)
        assert (found[i] == alone[0]).all() and (found[i] != 0).all() == (sizes[i] > 0)
    # The coordinates are those of cells looked at one by one, in a plain walk.
    best = {}
    for number in range(3000):
        width = 2.0 ** -min(6, max(0, 7 - number))
        begin = 0.0 if number == 0 else width if number < 7 else number - 6.0
        cell = int(near_dedup.mix(element[:1] + np.uint64(number * 0x9FB21C651E98DF25 & (1 << 64) - 1))[0])
        below, term, count = 0.0, math.exp(-width), 0
        while (cell >> 11) * 2.0**-53 > below + term and count < 23:
            below, count = below + term, count + 1
            term *= width / count
        for turn in range(count):
            dart = near_dedup.mix(np.array([(cell + turn + 1) & (1 << 64) - 1], np.uint64))
            rank = begin + width * (int(near_dedup.mix(dart + np.uint64(2))[0]) >> 11) * 2.0**-53
            place = int(near_dedup.mix(dart + np.uint64(4))[0]) % 160
            best[place] = min(best.get(place, (math.inf, 0)), (rank, int(dart[0])))
    assert [best[k][1] for k in range(160)] == found[0].tolist()


def test_a_worker_drops_what_other_work_has_kept():
    """Tokenizers remember hundreds of MB, which the stages of a pipeline would carry along in reused workers."""
    import gc
    import weakref

    import public_tokenizers

    from strandlake.llm import bpe
    from strandlake.llm.kernels import thrifty, thrifty_pair

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as file:
        data = file.read()
    others = [lambda: thrifty(lambda t: t)(0), lambda: thrifty_pair(lambda a, b: a)(0, 0), lambda: list(thrifty(lambda b: (yield from b))([1])), lambda: thrifty(lambda t: t, "decode")(0)]
    for other in others:
        kept = weakref.ref(bpe.load(data, "pack"))
        thrifty(lambda t: t, "pack")(0)
        assert kept() is not None and kept() is bpe.load(data, "pack")
        other()
        gc.collect()
        assert kept() is None
