"""Operator 11: toxicity by gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from strandlake.functions.ordered import checkpointed
from strandlake.llm.kernels import _LOWER, mix, portions, release, word_hashes

#: Labelled documents that the classifier is fitted on at most (about: drawn by a hash of the id), and entries of its lexicon.
SAMPLE, LEXICON = 30_000, 1 << 16
#: Folds of the sample; a document's lexicon features come from the other folds.
FOLDS = 4
#: Toxic documents that have an entry at least, and the least root of its likelihood ratio statistic.
LEAST, SURE = 3, 4.0
#: Log odds from which an entry counts as strong and as weak.
STRONG, WEAK = 2.0, 0.7
#: Words on either side that are near a form of address.
NEAR = 3
#: Bytes of the word beginnings and endings that are entries beside whole words: inflected languages share stems.
HEADS, TAILS = (4, 5, 6, 7), (4, 6)
#: Forms of address in the second person (English, German, French, Spanish).
ADDRESS = "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes vosotros tú ti tus os".split()
#: Characters that stand for letters inside a disguised word.
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

FEATURES = ("length", "density", "strong_rate", "strong_count", "weak_rate", "weak_count", "strongest", "address_rate", "near_address", "capitals", "shouted", "punctuation", "exclamations", "disguised", "distinct")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:127] = True
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_MEANT = np.zeros(256, np.uint8)
for _mark, _letter in DISGUISE.items():
    _MEANT[ord(_mark)] = ord(_letter)
_KEEP = ~_PUNCT


def _address() -> np.ndarray:
    words = [w.encode() for w in ADDRESS]
    end = np.cumsum([len(w) for w in words])
    return np.sort(word_hashes(np.frombuffer(b"".join(words), np.uint8), end - [len(w) for w in words], end))


_ADDRESS = _address()


class Plain:
    """The words of some texts, in lower case, freed of marks and of characters that stand for letters."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] is not None and len(texts) else np.zeros(0, np.uint8)
        cut = ends - ends[0]
        low = _LOWER[raw]
        letter = np.concatenate([[False], _LETTER[low], [False]])
        # A mark between two letters is part of a disguise; a digit is one beside a letter.
        between = letter[:-2] & letter[2:]
        digit = (raw >= 48) & (raw <= 57)
        meant = (_MEANT[raw] > 0) & (between | digit & (letter[:-2] | letter[2:]))
        self.disguised = self._sums(meant | (between & (raw == 42)), cut)
        self.bytes = np.diff(cut)
        self.upper, self.letters = self._sums(_UPPER[raw], cut), self._sums(letter[1:-1], cut)
        self.punct, self.exclaims = self._sums(_PUNCT[raw], cut), self._sums(raw == 33, cut)
        low = np.where(meant, _MEANT[raw], low)
        keep = meant | _KEEP[raw]
        place = np.concatenate([[0], np.cumsum(keep)])
        self.data, cut = low[keep], place[cut]
        shouted = (_UPPER[raw] | meant)[keep]
        inside = ~_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[cut] = True
        begin, stop = inside.copy(), np.zeros(len(self.data) + 1, bool)
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        stop[1:] = inside
        stop[1:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop)
        self.row = np.searchsorted(cut, self.start, side="right") - 1
        self.n = np.bincount(self.row, minlength=len(texts))
        loud = np.concatenate([[0], np.cumsum(shouted)])
        size = self.end - self.start
        self.shouted = np.bincount(self.row[(loud[self.end] - loud[self.start] == size) & (size > 1)], minlength=len(texts))
        self.hash, self.first, self.word = np.unique(word_hashes(self.data, self.start, self.end), return_index=True, return_inverse=True) if len(self.start) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    @staticmethod
    def _sums(flags: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[cut])

    def entries(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(distinct word, key) for whole words, beginnings and endings."""
        start, end = self.start[self.first], self.end[self.first]
        size, every = end - start, np.arange(len(start))
        out = [(every, self.hash)]
        for k in HEADS:
            at = np.flatnonzero(size > k)
            out.append((at, mix(word_hashes(self.data, start[at], start[at] + k) + np.uint64(k))))
        for k in TAILS:
            at = np.flatnonzero(size > k)
            out.append((at, mix(word_hashes(self.data, end[at] - k, end[at]) + np.uint64(100 + k))))
        return out


def _features(plain: Plain, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(rows, FEATURES); ``weights`` are the log odds of the sorted ``keys``."""
    n, rows = np.maximum(plain.n, 1), len(plain.n)
    odds = np.zeros(len(plain.hash))
    if len(keys):
        for at, key in plain.entries():
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            odds[at] = np.maximum(odds[at], np.where(keys[place] == key, weights[place], 0))
    each = odds[plain.word]
    strong, weak = each >= STRONG, each >= WEAK
    address = np.isin(plain.hash, _ADDRESS)[plain.word] if len(plain.hash) else np.zeros(0, bool)
    near = np.zeros(len(each), bool)
    for step in range(1, NEAR + 1):
        same = plain.row[step:] == plain.row[:-step]
        near[step:] |= address[:-step] & same
        near[:-step] |= address[step:] & same
    count = lambda flags: np.bincount(plain.row[flags], minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, plain.row, each)
    pairs = np.unique(plain.row * max(len(plain.hash), 1) + plain.word)
    distinct = np.bincount(pairs // max(len(plain.hash), 1), minlength=rows)
    letters, size = np.maximum(plain.letters, 1), np.maximum(plain.bytes, 1)
    columns = [np.log1p(plain.n), np.bincount(plain.row, each, rows) / n, count(strong) / n, np.log1p(count(strong)), count(weak) / n, np.log1p(count(weak)), top, count(address) / n, np.log1p(count(strong & near)), plain.upper / letters, plain.shouted / n, plain.punct / size, plain.exclaims / n, plain.disguised / n, distinct / n]
    return np.round(np.stack(columns, axis=1), 6)


def _counted(batches):
    """(key, fold, toxic, clean): documents that have an entry."""
    for record in batches:
        for part in portions(record, "_text"):
            plain = Plain(part.column("_text"))
            group = (part.column("_fold").to_numpy(zero_copy_only=False) * 2 + part.column("_toxic").to_numpy(zero_copy_only=False)).astype(np.int64)
            distinct = np.unique(plain.row * max(len(plain.hash), 1) + plain.word)
            row, word = distinct // max(len(plain.hash), 1), distinct % max(len(plain.hash), 1)
            for at, key in plain.entries():
                known, inverse = np.unique(key, return_inverse=True)
                which = np.full(len(plain.hash), -1)
                which[at] = inverse
                use = which[word] >= 0
                # A document has an entry once, however many of its words have it.
                once = np.unique(row[use] * max(len(known), 1) + which[word[use]])
                table = np.bincount(once % max(len(known), 1) * (2 * FOLDS) + group[once // max(len(known), 1)], minlength=len(known) * 2 * FOLDS).reshape(-1, FOLDS, 2)
                k, f = np.nonzero(table.sum(2))
                yield pa.RecordBatch.from_arrays([pa.array(known[k].view(np.int64)), pa.array(f.astype(np.int32)), pa.array(table[k, f, 1]), pa.array(table[k, f, 0])], names=["key", "fold", "toxic", "clean"])
    release()


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds of an entry in toxic documents, 0 where it is rare or the likelihood ratio is not sure."""
    a, b = toxic.astype(float), clean.astype(float)
    total = max(n_toxic + n_clean, 1)
    statistic = np.zeros(len(a))
    for seen, all_ in ((a, n_toxic), (b, n_clean)):
        for x, expected in ((seen, all_ * (a + b) / total), (all_ - seen, all_ * (total - a - b) / total)):
            statistic += 2 * np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(expected, 1e-300)), 0)
    odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
    return np.where((a >= LEAST) & (odds > 0) & (statistic >= SURE**2), odds, 0)


@dataclass
class Classifier:
    """Sorted keys of the lexicon with their log odds, trees and calibration; ``share`` is the score of all texts where there was nothing to fit."""

    keys: np.ndarray
    odds: np.ndarray
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def _lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and their log odds without each fold and (last column) with all."""
    totals = np.zeros((FOLDS, 2), np.int64)
    for r in sample.groupBy("_fold", "_toxic").count().collect():
        totals[r["_fold"], r["_toxic"]] = r["count"]
    counts = sample.mapInArrow(_counted, "key long, fold int, toxic long, clean long")
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("toxic", "clean")]
    found = counts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *by_fold).filter(F.col("toxic") >= LEAST)
    # Of entries that stand out at all, those that do so most.
    share = float(totals[:, 1].sum()) / max(1, int(totals.sum()))
    excess = (F.col("toxic") - share * (F.col("toxic") + F.col("clean"))) / F.sqrt(F.col("toxic") + F.col("clean"))
    found = found.withColumn("_excess", excess).filter("_excess > 0").orderBy(F.desc("_excess"), "key").limit(LEXICON).toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    odds = np.stack([log_odds(found["toxic"] - found[f"toxic{f}"], found["clean"] - found[f"clean{f}"], totals[:, 1].sum() - totals[f, 1], totals[:, 0].sum() - totals[f, 0]) for f in range(FOLDS)] + [log_odds(found["toxic"].to_numpy(), found["clean"].to_numpy(), totals[:, 1].sum(), totals[:, 0].sum())], axis=1) if len(keys) else np.zeros((0, FOLDS + 1))
    used = odds.any(axis=1)
    order = np.argsort(keys[used])
    return keys[used][order], odds[used][order]


def _with_features(rows: DataFrame, text_col: str, kept: list[str], keys: np.ndarray, odds: np.ndarray, fold_col: str | None = None) -> DataFrame:
    """``kept`` columns and ``_features``; the lexicon without a row's fold, if there are folds."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes) + ", _features array<double>"

    def run(batches):
        for record in batches:
            for part in portions(record, text_col):
                plain, out = Plain(part.column(text_col)), np.zeros((part.num_rows, len(FEATURES)))
                folds = part.column(fold_col).to_numpy(zero_copy_only=False) if fold_col else np.full(part.num_rows, FOLDS)
                for f in np.unique(folds):
                    out[folds == f] = _features(plain, keys, odds[:, f])[folds == f]
                values = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(FEATURES)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], values], names=[*kept, "_features"])
        release()

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """Fits on about SAMPLE labelled documents whose ids satisfy ``learns``, an expression of ``id_col``.

    A document labelled both ways teaches nothing; of rows with one id the least
    text does.  The lexicon has whole words, word beginnings and endings whose
    documents are toxic more often, beyond chance; each document of the sample is
    described by the lexicon of the other folds.  Two thirds of the sample grow the
    trees, the rest calibrates them.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(learns)
    known = known.groupBy(id_col).agg(F.min(label_col).alias("_toxic"), F.max(label_col).alias("_other")).filter("_toxic = _other").select(F.col(id_col).alias("_id"), (F.col("_toxic") > 0).cast("int").alias("_toxic"))
    total = known.count()
    if total > SAMPLE:
        known = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / total))
    # About SAMPLE ids of a few bytes: bounded, whatever the size of the tables.
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(known), "_id")
    sample = texts.groupBy("_id").agg(F.min("_text").alias("_text"), F.min("_toxic").alias("_toxic"))
    sample = checkpointed(sample.withColumn("_fold", F.pmod(F.xxhash64(F.lit(1), F.col("_id")), F.lit(FOLDS)).cast("int")))
    keys, odds = _lexicon(sample)
    described = _with_features(sample, "_text", ["_id", "_toxic", "_fold"], keys, odds, "_fold")
    rows = checkpointed(described.select("_id", F.col("_toxic").cast("double").alias("_toxic"), array_to_vector("_features").alias("_vector")).coalesce(4))
    calibrates = F.pmod(F.xxhash64(F.lit(2), F.col("_id")), F.lit(3)) == 0
    seen = {(r["_c"], r["_toxic"]): r["count"] for r in rows.groupBy(calibrates.alias("_c"), "_toxic").count().collect()}
    share = sum(n for (_, y), n in seen.items() if y) / max(1, sum(seen.values()))
    if len(seen) < 4:  # one of the parts lacks a class
        return Classifier(keys, odds, None, None, share)
    trees = GBTClassifier(featuresCol="_vector", labelCol="_toxic", maxIter=30, maxDepth=3, stepSize=0.25, minInstancesPerNode=3, seed=11).fit(rows.filter(~calibrates))
    raw = _raw(trees, rows.filter(calibrates)).select("_raw", "_toxic")
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="_toxic", predictionCol="_calibrated").fit(raw)
    return Classifier(keys, odds, trees, calibration, share)


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("_raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every row, from its text alone.

    Null texts are empty, and empty texts are scored too.  The calibrated score is a
    step function; a thousandth of the trees' own probability is mixed in, so that
    it keeps their order inside a step.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if model.trees is None or model.calibration is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(float(model.share)).alias("score"))
    vectors = _with_features(rows, "_text", ["_id"], model.keys, model.odds).select("_id", array_to_vector("_features").alias("_vector"))
    scored = model.calibration.transform(_raw(model.trees, vectors))
    value = F.lit(0.999) * F.col("_calibrated") + F.lit(0.001) * F.col("_raw")
    return scored.select(F.col("_id").alias(id_col), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    """Ids whose labels are never learnt from; a null id is not one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op11_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of all documents, learnt from the labels that are not held out."""
    docs = docs.select("doc_id", "text")
    scored = score(docs, fit(docs, labels, ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
