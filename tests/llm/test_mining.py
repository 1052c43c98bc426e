"""Toxicity, collocations and hard negatives against brute force, with nulls, empties, ties, repeats and clashing columns."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F


def brute_collocations(rows, least=30, top=2000):
    """lang -> (phrase, a, l, r, n, score) in order, by counting everything."""
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                count.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    found, longest = collections.defaultdict(list), {}
    for key, f in count.items():
        if f >= least and len(key) > 2:
            lang, *w = key
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    part = (lang, *w[i : i + m])
                    longest[part] = max(longest.get(part, 0), f)
    for key, a in count.items():
        lang, *w = key
        if a >= least and len(w) > 1 and not 100 * longest.get(key, 0) >= 80 * a:
            cuts = [(2000000 * a // (count[(lang, *w[:k])] + count[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang].append((" ".join(w), a, count[(lang, *w[:k])], count[(lang, *w[k:])], total[lang], score))
    return {lang: sorted(x, key=lambda p: (-p[5], -p[1], p[0].encode()))[:top] for lang, x in found.items()}


@pytest.fixture(scope="module")
def phrases():
    rng = np.random.default_rng(3)
    words = ["The", "the", "of", "Éa", "éa", "x", "new", "york", "city", "a-b", " "]
    rows = []
    for i in range(120):
        lang = ["en", "fr", None, "x\x00y"][i % 4]
        text = "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", "\t", ". ", "\n", ","], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(int(rng.integers(0, 120))))
        rows.append((i, text, lang))
    rows += [(200 + k, "new york city hall . new york city hall", "en") for k in range(20)] + [(300, None, "en"), (301, "", "de"), (302, "solo", "de"), (303, " ".join(["go"] * 400), "de"), (None, "new york", "en"), (304, "new york", "en"), (304, "new york", "en"), (305, "z " * 60_000, "long")]
    return rows


@pytest.mark.parametrize("parts", [1, 5])
def test_collocations(spark, phrases, parts):
    from strandlake.llm.collocations import collocations

    want = brute_collocations(phrases)
    frame = spark.createDataFrame(phrases, "doc_id long, text string, lang string").withColumn("f", F.lit(1)).withColumn("word", F.lit("x")).repartition(parts)
    got = collections.defaultdict(list)
    for r in collocations(frame).collect():
        got[r["lang"]].append(tuple(r)[1:])
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_split_prefixes_and_top(spark, phrases, monkeypatch):
    """Prefixes spread over several ranges, and a top that cuts, change nothing else."""
    from strandlake.llm import collocations as c

    monkeypatch.setattr(c, "SPLIT", 3)
    spread = c._shards(np.full(50, (1 << 60) + 2 * (1 << 40), np.uint64), np.arange(50, dtype=np.uint64) << np.uint64(35), np.full(50, 30), 7)
    assert len(set(spread)) > 3
    want = brute_collocations(phrases, top=3)
    got = collections.defaultdict(list)
    for r in c.collocations(spark.createDataFrame(phrases, "doc_id long, text string, lang string"), top=3).collect():
        got[r["lang"]].append(tuple(r)[1:])
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_collocations_of_nothing(spark):
    from strandlake.llm.collocations import op12_collocations

    assert op12_collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert op12_collocations(spark.createDataFrame([(1, None, None), (2, " . ", "en")], "doc_id long, text string, lang string")).count() == 0


def test_words_with_equal_hashes(monkeypatch):
    """Words are told apart by their bytes where their hashes agree."""
    import pyarrow as pa

    from strandlake.llm import collocations as c

    plain = c.Piece(b"en", pa.array([b"one two one, six"], pa.large_binary()))
    real = c.word_hashes
    monkeypatch.setattr(c, "word_hashes", lambda data, start, end, lane=0: real(data, start, end, lane) if lane else (end - start).astype(np.uint64))
    same = c.Piece(b"en", pa.array([b"one two one, six"], pa.large_binary()))
    assert same.words.to_pylist() == plain.words.to_pylist() == [b"one", b"six", b"two"] and list(same.stream) == list(plain.stream)


def brute_negatives(rows, k=10):
    out = []
    for a, al, av in rows:
        if a % 100:
            continue
        dot = lambda v: sum(x * y for x, y in zip(av, v))
        positive = sorted((-dot(v), i) for i, label, v in rows if label == al and i != a)[:5]
        for s, p in positive:
            s = -s
            fits = sorted((-dot(v), i) for i, label, v in rows if label != al and 30 * s <= 100 * dot(v) <= 90 * s)[:k]
            out += [(a, p, r + 1, i, s, -x) for r, (x, i) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3])
def test_hard_negatives(spark, parts):
    from strandlake.llm.hard_negatives import op13_hard_negatives

    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.normal(0.2, 1, 6)]) for i in range(500)]
    rows += [(500 + i, int(rng.integers(0, 4)), [0.5] * 6) for i in range(200)]  # copies: ties by id
    rows += [(1000, 9, [0.1] * 6), (1001, 1, [0.0] * 6), (-100, 2, [-0.3] * 6), (1100, 2, [0.3, 0.3]), (1200, 1, [])]
    odd = [(2000, None, [0.1] * 6), (2100, 1, None), (2200, 1, [0.1, None]), (2300, 1, [float("nan")] * 6), (2400, 1, [float("inf")] * 6), (None, 1, [0.2] * 6), (3, rows[3][1], rows[3][2])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<float>").withColumn("_id", F.lit("x")).withColumn("rank", F.lit(0)).repartition(parts)
    kept = []
    for i, label, v in rows:
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, whole + [0] * (6 - len(whole))))
    got = op13_hard_negatives(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(kept)
    assert op13_hard_negatives(frame.limit(0)).count() == 0


def test_the_tree_skips_and_loses_nothing():
    from strandlake.llm.hard_negatives import VantageTree

    rng = np.random.default_rng(1)
    centre = rng.integers(-200, 200, (12, 8))
    vectors = (centre[rng.integers(0, 12, 6000)] + rng.integers(-9, 10, (6000, 8))).astype(float)
    tree = VantageTree(np.arange(6000), np.zeros(6000, np.int64), vectors)
    anchors = vectors[:40]
    dots = anchors @ tree.vectors.T
    low, high = np.quantile(dots, 0.6, axis=1).astype(np.int64), np.quantile(dots, 0.9, axis=1).astype(np.int64)
    query, row, score = tree.search(anchors, lambda who, at: np.ones((len(who), len(at)), bool), (low, high), np.arange(40), 7)
    for q in range(40):
        fits = [(-int(s), i) for i, s in enumerate(dots[q]) if low[q] <= s <= high[q]]
        assert list(zip(-score[query == q], row[query == q])) == sorted(fits)[:7]
    # A leaf is entered by an anchor only if its bounds reach the annulus.
    assert tree.skipped > 2 * tree.visited > 0


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(3000):
        text = [str(w) for w in rng.choice(words, int(rng.integers(20, 80)))]
        bad = i % 6 == 0
        for _ in range(3 * bad):
            # A stem with many endings, a whole word, and the same disguised.
            text.insert(int(rng.integers(0, len(text))), str(rng.choice(["vorklm" + str(rng.choice(words)), "zutzt", "z.u.t.z.t", "ZU7ZT!"])))
        rows.append((i, " ".join(text)))
        if i % 5 != 1:
            labels.append((i, int(bad)))
    labels += [(0, 0), (3, None), (None, 1), (6, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(rows)


def test_toxicity_on_labels_held_out(spark, toxic):
    from strandlake.llm.toxicity import op11_toxicity

    docs, labels, texts = toxic
    more = spark.createDataFrame([(9001, None), (9002, ""), (9003, "zutzt " * 40_000), (9004, texts[6]), (9004, texts[6]), (None, texts[6])], "doc_id long, text string")
    odd = docs.union(more).withColumn("score", F.lit("x")).withColumn("_text", F.lit(1))
    rows = op11_toxicity(odd, labels).collect()
    assert len(rows) == 3006 and rows[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    by = {r.doc_id: r for r in rows}
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 3000]
    right = sum(r.predicted == (r.doc_id % 6 == 0) for r in held)
    assert len(held) > 500 and right >= 0.97 * len(held)
    assert by[9001].score == by[9002].score < 0.3 and by[9003].predicted == 1
    assert {r.score for r in rows if r.doc_id in (9004, None)} == {by[6].score}


def test_labels_held_out_teach_nothing(spark, toxic):
    """Other labels on rows that are held out, and another order of rows, leave every score as it was."""
    from strandlake.llm.toxicity import held_out, op11_toxicity

    docs, labels, _ = toxic
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda frame: {r.doc_id: round(r.score, 9) for r in frame.collect()}
    assert scores(op11_toxicity(docs, labels)) == scores(op11_toxicity(docs, turned))


def test_nothing_to_learn_from(spark, toxic):
    from strandlake.llm.toxicity import op11_toxicity

    docs, labels, _ = toxic
    assert {r.score for r in op11_toxicity(docs.limit(10), labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in op11_toxicity(docs.limit(10), labels.filter("toxic = 1")).collect()} <= {0.0, 1.0}
    assert op11_toxicity(docs.limit(0), labels).count() == 0


def test_disguises_are_read():
    import pyarrow as pa

    from strandlake.llm.toxicity import Plain

    plain = Plain(pa.array([b"z.u.t.z.t ZU7ZT! zutzt 2024", b"", None, b"You you"], pa.large_binary()))
    assert len(set(plain.hash[plain.word[:3]])) == 1 and list(plain.n) == [4, 0, 0, 2] and plain.disguised[0] >= 1
    assert list(plain.shouted) == [1, 0, 0, 0]
