"""The stages of the corpus pipeline against brute force, each on what the one before kept."""

import collections
import re
import zlib

import numpy as np
import pytest

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """Name -> rows before and after, for the given documents and some odd ones."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    long = " ".join(f"word{i}" for i in range(120))
    odd = [(900000, None), (900001, ""), (900002, long), (900003, long + " tail"), (900004, "start " + long + " é" * 60), (None, long + " other words here"), (900002, long), (900005, " ".join(f"w{i % 90}x{i}" for i in range(3000)))]
    more = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in odd], docs.schema)
    rows, found = docs.unionByName(more), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, rows, DATA).cache()
        found[name] = (rows.collect(), after.collect())
        rows = after
    return found


def test_quality_rules(spark, stages):
    from strandlake.llm.quality_rules import op4_quality_rules

    before, after = stages["quality_rules"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = op4_quality_rules(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), labels)
    kept = collections.Counter(r.doc_id for r in judged.filter("kept").collect())
    assert collections.Counter(r.doc_id for r in after) == kept and 900000 not in kept and kept[900002] == 2
    for r in before:  # the base rule, by hand
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        count = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if count[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        if len(w) < 50 or 100 * len(covered) > 50 * len(w):
            assert r.doc_id not in kept


def test_a_column_called_kept_decides_nothing(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.withColumn("kept", F.lit(True)).withColumn("_stratum", F.lit("x")).withColumn("_cut_symbols", F.lit(0.0)).withColumn("_keep", F.lit(1))
    plain, named = (corpus_pipeline.quality(spark, d, DATA) for d in (docs, odd))
    assert named.columns == odd.columns and sorted(r.doc_id for r in named.collect()) == sorted(r.doc_id for r in plain.collect())
    one = corpus_pipeline.near_duplicates(spark, odd, DATA)
    assert one.columns == odd.columns and one.count() == corpus_pipeline.near_duplicates(spark, docs, DATA).count()
    cut = corpus_pipeline.repeated_substrings(spark, odd, DATA)
    assert cut.columns == odd.columns and cut.count() == docs.count()


def test_near_duplicates(stages):
    before, after = stages["near_dedup"]
    sets = []
    for r in before:
        w = WORD.findall((r.text or "").encode())
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(before)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                label[max(top(i), top(j))] = min(top(i), top(j))
    classes = collections.defaultdict(list)
    for i, r in enumerate(before):
        classes[top(i)].append(r.doc_id)
    least = sorted((min((d for d in c if d is not None), default=None) for c in classes.values()), key=str)
    assert sorted((r.doc_id for r in after), key=str) == least
    assert {r.doc_id: r.text for r in after}.items() <= {(r.doc_id, r.text) for r in before}


def test_repeated_substrings(stages):
    before, after = stages["suffix_dedup"]
    seen, want = set(), {}
    for r in sorted(before, key=lambda r: (r.doc_id is not None, r.doc_id)):
        b = (r.text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        # A character that goes in part stays whole.
        at, out = 0, []
        for c in r.text or "":
            n = len(c.encode())
            if not gone[at : at + n].all():
                out.append(c)
            at += n
        want[r.doc_id] = "".join(out)
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_packing(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in before}
    total, bins = collections.Counter(), collections.defaultdict(list)
    for r in after:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        total[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert total == {i: len(x) for i, x in ids.items()}
    for b in bins.values():
        ends = [0]
        for offset, length in sorted(b):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024


def test_empty_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
