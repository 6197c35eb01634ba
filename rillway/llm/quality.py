"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose feature exceeds a cutoff. Cutoffs are not guessed: labelled good texts of
each stratum (a language) are the holdout, and the five cutoffs are certified together, only if an exact
binomial test says that all rules at once reject at most ``alpha`` of the good texts. The vectors tested
form one path from no cutoff to the strictest, drawn from the stratum's bad texts alone, so that it is fixed
as far as the good texts go; testing stops at the first vector that fails (fixed-sequence testing, which
needs no correction along the path), and strata share ``delta`` by Bonferroni. The false rejection rate of
a whole stratum is then at most ``alpha`` with probability 1 - ``delta``, over all strata together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.llm import textbytes as tb
from rillway.llm.store import bounded, settle

#: Candidate cutoffs of each rule, lenient to strict.
CUTOFFS = {
    "symbol_share": [0.30, 0.25, 0.20, 0.15, 0.10, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01],
    "upper_share": [0.60, 0.50, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.12, 0.10],
    "dup_line_share": [0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25],
    "repeat_share": [0.90, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20],
    "mean_word": [20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5],
}
RULES = list(CUTOFFS)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
BROADCAST_STRATA = 2_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is any other equal, is an earlier one equal) for each key."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    both = same.copy()
    both[:-1] |= same[1:]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order], any_[order] = same, both
    return any_, later


def count_chunk(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text. Equal lines and windows are told by 64-bit hashes within a text."""
    n = len(offs) - 1
    space = tb.SPACE[data]
    starts, ends, first = tb.words(data, offs)
    n_words = np.diff(first)
    word_chars = tb.text_sums(~space & ((data & 0xC0) != 0x80), offs)
    n_symbols = tb.text_sums(_SYMBOL[data], offs)
    upper = (data >= 65) & (data <= 90)
    if len(data) > 1:
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    n_upper = tb.text_sums(upper, offs)

    left, right = tb.runs(data != 10, offs)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=filled[1:])
    keep = filled[right] > filled[left]
    left, right = left[keep], right[keep]
    line_of = np.searchsorted(offs, left, "right") - 1
    salt = tb.mix(np.arange(1, n + 1, dtype=np.uint64))
    _, later = _repeated(tb.span_hash(data, left, right) ^ salt[line_of])
    n_lines = np.bincount(line_of, minlength=n)
    n_dup = np.bincount(line_of[later], minlength=n)

    word_of = tb.owner(first)
    covered = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        w3 = tb.window_hash(tb.span_hash(data, starts, ends), 3)
        at = np.flatnonzero(word_of[:-2] == word_of[2:])
        again, _ = _repeated(w3[at] ^ salt[word_of[at]])
        hit = at[again]
        for j in range(3):
            covered[hit + j] = True
    n_rep = np.bincount(word_of[covered], minlength=n)
    return [n_words, word_chars, n_symbols, n_dup, n_rep, n_lines, n_upper]


def with_counts(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with COUNTS of the whole text beside them, without a shuffle.

    A null text counts as having no words. ``keep`` travels as one struct, so its names cannot clash.
    """
    kept = bounded(df).select(F.struct(*keep).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [count_chunk(data, offs) for _, _, data, offs in tb.texts(batch.column(1))]
            cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["row", *COUNTS])

    schema = f"row {kept.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    return kept.mapInArrow(run, schema)


def features() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word": share("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), exactly summed in logarithms."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    base = math.lgamma(n + 1)
    logs = [base - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified(wrong: list[int], good: int, alpha: float, delta: float) -> int:
    """How many vectors of a path pass, in order: those whose excess risk is refuted at level delta."""
    passed = 0
    for k in wrong:
        if good == 0 or k > alpha * good or binomial_cdf(k, good, alpha) > delta:
            break
        passed += 1
    return passed


def path(bad: np.ndarray, weight: np.ndarray) -> list[int]:
    """The rule whose next cutoff each step adds; ``bad`` has, per text and rule, the first cutoff exceeded.

    Steps that catch the most bad texts each come first; what catches none follows, all rules abreast.
    """
    size = np.array([len(CUTOFFS[r]) for r in RULES])
    at, steps = np.zeros(len(RULES), np.int64), []
    while (at < size).any():
        left = ~(bad < at).any(axis=1)
        best = (0.0, int(np.argmin(at / size)), 1)
        for r in range(len(RULES)):
            caught = np.cumsum(np.bincount(bad[left, r], weight[left], size[r] + 1)[at[r] : size[r]])
            for m, c in enumerate(caught, 1):
                best = max(best, (c / m, r, m), key=lambda x: x[0])
        steps += [best[1]] * best[2]
        at[best[1]] += best[2]
    return steps


def joint_cutoffs(first: np.ndarray, good: np.ndarray, bad: np.ndarray, alpha: float, delta: float) -> list[float | None]:
    """The strictest certified vector; rows of ``first`` are kinds of texts, with numbers of good and bad ones."""
    steps = np.array(path(first[bad > 0], bad[bad > 0]))
    fails = np.full(len(first), len(steps))
    for r in range(len(RULES)):
        when = np.append(np.flatnonzero(steps == r), len(steps))
        fails = np.minimum(fails, when[first[:, r]])
    wrong = np.cumsum(np.bincount(fails, good, len(steps) + 1)[:-1]).astype(int).tolist()
    taken = np.bincount(steps[: certified(wrong, int(good.sum()), alpha, delta)], minlength=len(RULES))
    return [CUTOFFS[r][k - 1] if k else None for r, k in zip(RULES, taken.tolist(), strict=True)]


def fit_cutoffs(counted: DataFrame, stratum: Column, good: Column, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, one nullable cutoff per rule) from labelled rows with COUNTS.

    Only numbers of texts alike in what they exceed leave the executors' first pass. A stratum with too few
    good texts gets nulls: nothing is certified there, so no rule applies. A null stratum is a stratum of
    its own.
    """
    x = features()
    first = [reduce(lambda a, b: a + b, [F.when(x[r] > c, 0).otherwise(1) for c in CUTOFFS[r]]).cast("long").alias(r) for r in RULES]
    named = counted.select(F.struct(stratum.alias("s")).alias("stratum"), good.alias("good"), base_failed().alias("base"), *first)
    cells = named.groupBy(F.col("stratum.s").alias("s"), *RULES).agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good") & ~F.col("base")).alias("n_bad"))
    cells = settle(cells)
    strata = max(1, cells.where("n_good > 0").select(F.struct("s").alias("s")).distinct().count())

    def run(group: pa.Table) -> pa.Table:
        kinds = np.stack([group[r].to_numpy() for r in RULES], axis=1)
        got = joint_cutoffs(kinds, group["n_good"].to_numpy(), group["n_bad"].to_numpy(), alpha, delta / strata)
        return pa.table([group["s"].slice(0, 1), *(pa.array([c], pa.float64()) for c in got)], names=["s", *RULES])

    kind = cells.schema["s"].dataType.simpleString()
    fitted = cells.groupBy("s").applyInArrow(run, f"s {kind}, " + ", ".join(f"{r} double" for r in RULES))
    fitted = fitted.select(F.col("s").alias("cut_stratum"), *(F.col(r).alias(f"cut_{r}") for r in RULES))
    return F.broadcast(fitted) if strata <= BROADCAST_STRATA else fitted


def judge(counted: DataFrame, stratum: Column, cutoffs: DataFrame) -> DataFrame:
    """Adds base_failed and kept; a stratum without certified cutoffs is held to the base alone."""
    x = features()
    joined = counted.join(cutoffs, stratum.eqNullSafe(F.col("cut_stratum")), "left")
    broken = F.lit(False)
    for r in RULES:
        broken = broken | F.coalesce(x[r] > F.col(f"cut_{r}"), F.lit(False))
    out = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~broken)
    return out.drop("cut_stratum", *(f"cut_{r}" for r in RULES))
