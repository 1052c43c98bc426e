"""Operator 4: quality rules whose cutoffs are risk-controlled on labelled holdouts."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandlake.llm.exchange import fresh
from strandlake.llm.kernels import _SPACE, Batch, Words, drop_kept, mix, portions, release, U

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
#: Rule -> (numerator, denominator); a text fails if the quotient is over the cutoff.
RULES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
#: Cutoffs from the loosest to the strictest.
CUTOFFS = tuple(round(0.02 * k, 2) for k in range(50, 1, -1))
#: Most clean texts that one rule may reject, with this chance of error over all rules and strata.
RISK, ERROR = 0.005, 0.05
#: Strata for which the thresholds may be broadcast.
BROADCAST_STRATA = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def text_counts(batch: Batch) -> dict[str, np.ndarray]:
    """The counts of each row of a batch, over its whole text."""
    words = Words(batch)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[batch.ends])

    out = {"n_words": np.diff(words.first), "word_chars": np.zeros(batch.n, np.int64), "n_symbols": np.zeros(batch.n, np.int64)}
    out |= {k: np.zeros(batch.n, np.int64) for k in ("n_dup_lines", "n_repeat_words", "n_lines")}
    if len(batch.data):
        out["word_chars"] = per_row(~_SPACE[batch.data] & (batch.data & 0xC0 != 0x80))
        out["n_symbols"] = per_row(_SYMBOL[batch.data])
    h, row = words.hash, words.row_of()
    if len(h) > 2:
        window = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
        at = np.flatnonzero(row[:-2] == row[2:])
        order = at[np.lexsort((window[at], row[at]))]
        same = (window[order][1:] == window[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[order[twice] + k] = True
        out["n_repeat_words"] = np.bincount(row[covered], minlength=batch.n)
    for i in range(batch.n):
        lines = [x for x in batch.text(i).split(b"\n") if x.strip(b" \t\n\v\f\r")]
        out["n_lines"][i], out["n_dup_lines"][i] = len(lines), len(lines) - len(set(lines))
    return out


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counted(texts: pa.Array) -> pa.Array:
    drop_kept()
    record = pa.record_batch({"row": pa.array(np.arange(len(texts))), "text": texts})
    found = [text_counts(Batch(pa.Table.from_batches([part]), "row", "text")) for part in portions(record, "text")]
    release()
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *[f[c] for f in found]]), pa.int64()) for c in COUNTS], list(COUNTS))


#: Else a filter on the counts would be pushed below them and count every text again.
_counted = _counted.asNondeterministic()


def with_counts(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """The rows with their counts, and the counts' column names.  Only counts come back from Python."""
    names, holder = {c: fresh(docs, c) for c in COUNTS}, fresh(docs, "_counts")
    counted = docs.withColumn(holder, _counted(F.col(f"`{text_col}`")))
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{holder}.{c}").alias(n) for c, n in names.items()]), names


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for a binomial X of n trials: at most d means that the exact upper bound at level d is p or less."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def strictest(over: np.ndarray, n: int, risk: float, error: float) -> float | None:
    """The strictest cutoff that is safe; over[j]: clean texts over cutoff j.

    Cutoffs are tested from the loosest on and the first that fails ends the
    sequence, which keeps the chance of any unsafe choice at ``error`` without
    dividing it among the cutoffs.
    """
    best = None
    for cutoff, k in zip(CUTOFFS, over):
        if k >= n * risk or tail(int(k), n, risk) > error:
            break
        best = cutoff
    return best


def _over(passed: pd.Series, n: pd.Series) -> tuple[np.ndarray, int]:
    """Clean texts over each cutoff, and all; passed: how many cutoffs a text is over."""
    by = np.bincount(passed, n, len(CUTOFFS) + 1).astype(np.int64)
    # A text over j cutoffs is over the last j, as they run from loose to strict.
    return np.array([by[len(CUTOFFS) - j :].sum() for j in range(len(CUTOFFS))]), int(by.sum())


def thresholds(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``_stratum`` and a cutoff for each rule (null: no cutoff is safe there), for every stratum of ``docs``.

    The holdout is every document whose labels all say quality 1.  A stratum that
    could not certify a cutoff even if none of its clean texts were over it takes
    the cutoff of the pooled holdout of all strata, which bounds the share of clean
    texts rejected over all strata, but stops before one that rejects ``risk`` or
    more of the stratum's own clean texts.  A stratum large enough to test doesn't
    fall back.  The chance of error is divided by the number of rules times that
    of strata with clean labels and the pool (Bonferroni).
    """
    from strandlake.llm.exchange import checkpointed

    counted, names = with_counts(docs.select("doc_id", "text", F.col(f"`{stratum}`").cast("string").alias("_stratum")))
    clean = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).filter("_q = 1").select("doc_id")
    held = counted.join(clean, "doc_id", "left_semi")
    steps = []
    for rule, (top, bottom) in RULES.items():
        value = F.col(names[top]) / F.greatest(F.col(names[bottom]), F.lit(1))
        passed = reduce(lambda a, b: a + b, [(value > c).cast("int") for c in CUTOFFS])
        steps.append(F.struct(F.lit(rule).alias("rule"), passed.alias("over")))
    counts = checkpointed(held.select("_stratum", F.inline(F.array(*steps))).groupBy("_stratum", "rule", "over").agg(F.count("*").alias("n")))
    strata = counts.select("_stratum").distinct().count()
    level = error / ((strata + 1) * len(RULES))
    every = counts.groupBy("rule", "over").agg(F.sum("n").alias("n")).toPandas()
    pooled = {r: strictest(*_over(g["over"], g["n"]), risk, level) for r, g in every.groupby("rule")}

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        over, n = _over(group["over"], group["n"])
        rule = group["rule"].iloc[0]
        best = strictest(over, n, risk, level)
        if tail(0, n, risk) > level and pooled[rule] is not None:
            best = min((c for c, k in zip(CUTOFFS, over) if c >= pooled[rule] and k < n * risk), default=None)
        return pd.DataFrame({"_stratum": group["_stratum"].iloc[:1].values, "rule": [rule], "cutoff": [best]})

    chosen = counts.groupBy("_stratum", "rule").applyInPandas(choose, "_stratum string, rule string, cutoff double")
    found = chosen.groupBy("_stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_cut_{r}") for r in RULES])
    rest = docs.select(F.col(f"`{stratum}`").cast("string").alias("_stratum")).distinct().alias("d").join(found.alias("f"), F.expr("d._stratum <=> f._stratum"), "left_anti")
    return found.unionByName(rest.select("_stratum", *[F.lit(pooled.get(r)).cast("double").alias(f"_cut_{r}") for r in RULES]))


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept`` to each row.

    A row is kept if it passes the base rule (50 words or more, and not over half
    of them in repeated three-word windows) and is over no cutoff of its stratum.
    Null, empty and blank texts have no words and fail.  A stratum (null is one)
    with too few clean labels takes the cutoffs of all strata together; there are
    none if those are too few as well.  Repeated labels count once, and a document
    with any label of quality 0 isn't clean.
    """
    from strandlake.llm.exchange import checkpointed

    cut = checkpointed(thresholds(docs, labels, stratum, risk, error))
    counted, names = with_counts(docs)
    # Columns of the caller may have the names that the cutoffs come with.
    own = {c: fresh(counted, f"_own{c}") for c in cut.columns}
    cut = cut.select(*[F.col(c).alias(n) for c, n in own.items()])
    few = cut.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    joined = counted.join(F.broadcast(cut) if few else cut, F.col(f"`{stratum}`").cast("string").eqNullSafe(F.col(own["_stratum"])), "left")
    n, repeats = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    base = (n < 50) | (100 * repeats > 50 * n)
    over = reduce(lambda a, b: a | b, [F.coalesce(F.col(names[t]) / F.greatest(F.col(names[b]), F.lit(1)) > F.col(own[f"_cut_{r}"]), F.lit(False)) for r, (t, b) in RULES.items()])
    base_col, kept_col = fresh(counted, "base_failed"), fresh(counted, "kept")
    return joined.select(*[F.col(f"`{c}`") for c in counted.columns], base.alias(base_col), (~base & ~over).alias(kept_col))


def passing(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with their columns, whatever these are called.

    Null, empty and blank texts go; rows repeated in full stay or go together.
    """
    judged = quality_rules(docs, labels, stratum)
    return judged.filter(F.col(f"`{judged.columns[-1]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdicts of all documents."""
    done = quality_rules(docs.select("doc_id", "text", "lang"), labels)
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
