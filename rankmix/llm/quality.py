"""Quality rules whose cutoffs are certified on labelled documents.

Every document gets counts (words, symbols, repeated lines and windows) and
from them five badness measures between 0 and 1.  For each stratum (documents
of like length) and measure the strictest cutoff on a fixed grid is chosen that
provably rejects few good documents: going from the laxest cutoff to stricter
ones, a cutoff is certified while the exact binomial test rejects "more than
``alpha / measures`` of good documents lie beyond it" at level ``delta /
(strata * measures)``.  Testing in fixed order needs no correction along the
grid, Bonferroni covers strata and measures; so with confidence ``1 - delta``
no stratum loses more than ``alpha`` of its good documents to the learned
rules.  A stratum with too few labels to certify anything has no learned rule.

Only a histogram of fixed size (strata x measures x grid) reaches the driver.

Null and empty texts have no words and fail the base rules; labels with a null
are ignored, a document with contradicting labels is not good; a null id has no
label; repeated rows repeat; an empty table gives no rows, empty labels no
learned rules; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmix.llm.common import slices, string_buffers, written
from rankmix.llm.pretoken import span_hashes
from rankmix.llm.words import IS_SPACE, WINDOW, window_hashes, word_hashes, word_spans

CHUNK_BYTES = 1 << 21
MIN_WORDS, REPEAT_PERCENT = 10, 20
STRATA = (50, 200, 1000)               # word counts that part the strata
MEASURES = ("symbols", "dup_lines", "repeats", "short_words", "long_words")
GRID = 64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


# ------------------------------------------------------------- counts

def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text, given as UTF-8 bytes and offsets."""
    space = IS_SPACE[raw]
    starts, ends, n_words = word_spans(raw, offsets)
    texts = len(offsets) - 1
    out = {"n_words": n_words, "word_chars": _per_text(~space & ((raw & 0xC0) != 0x80), offsets),
           "n_symbols": _per_text(SYMBOLS[raw], offsets)}
    # a line starts at a text's start and after each \n, and ends at the next \n or the text's end
    breaks = np.flatnonzero(raw == 10)
    at = np.concatenate([offsets[:-1], breaks + 1])
    of_text = np.concatenate([np.arange(texts), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((at, of_text))
    line_starts, of_text = at[order], of_text[order]
    line_ends = offsets[of_text + 1].copy()
    same = of_text[1:] == of_text[:-1]
    line_ends[:-1][same] = line_starts[1:][same] - 1
    lit = np.concatenate([[0], np.cumsum(~space, dtype=np.int64)])
    has_word = lit[line_ends] > lit[line_starts]
    out["n_lines"] = np.bincount(of_text, minlength=texts).astype(np.int64)
    h, t = span_hashes(raw, line_starts[has_word], line_ends[has_word]), of_text[has_word]
    bounds = np.searchsorted(t, np.arange(texts + 1))
    dup = np.zeros(texts, np.int64)
    for i in np.flatnonzero(np.diff(bounds) > 1):
        own = h[bounds[i]:bounds[i + 1]]
        dup[i] = len(own) - len(np.unique(own))
    out["n_dup_lines"] = dup
    windows, per = window_hashes(word_hashes(raw, starts, ends, lower=False), n_words, whole_if_short=False)
    bounds = np.concatenate([[0], np.cumsum(per)])
    repeat = np.zeros(texts, np.int64)
    for i in np.flatnonzero(per > 1):
        own = windows[bounds[i]:bounds[i + 1]]
        ranked = np.sort(own)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(twice):
            again = np.isin(own, twice)
            edge = np.zeros(len(own) + WINDOW, np.int64)
            edge[:len(own)] += again
            edge[WINDOW:] -= again
            repeat[i] = np.count_nonzero(np.cumsum(edge)[:-1])
    out["n_repeat_words"] = repeat
    return out


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for b in batches:
            raw, off = string_buffers(b.column(1))
            parts = []
            for a, z in slices(np.diff(off), CHUNK_BYTES):
                parts.append(text_counts(raw[off[a]:off[z]], off[a:z + 1] - off[a]))
            cols = [np.concatenate([p[n] for p in parts]) if parts else np.empty(0, np.int64) for n in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols]],
                                             names=[id_col, *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(
        run, f"{id_col} {id_type}, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def stratum() -> Column:
    out = F.lit(0)
    for i, words in enumerate(STRATA, 1):
        out = F.when(F.col("n_words") >= words, i).otherwise(out)
    return out


def cells() -> Column:
    """Grid cell (0 to GRID) of each measure, as an array."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    mean = F.col("word_chars") / words
    ratios = (F.col("n_symbols") / chars, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
              F.col("n_repeat_words") / words, 1 - F.least(mean, F.lit(16.0)) / 16, F.least(mean, F.lit(64.0)) / 64)
    return F.array(*[F.least(F.floor(r * GRID), F.lit(GRID)).cast("int") for r in ratios])


# ------------------------------------------------------------- certification

def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly from the largest term down."""
    if k >= n:
        return 1.0
    log_term = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                + k * math.log(p) + (n - k) * math.log1p(-p))
    if k > n * p:                        # the upper tail is the shorter sum
        term, total, i = math.exp(log_term), 0.0, k
        while i < n:
            term *= (n - i) / (i + 1) * p / (1 - p)
            i += 1
            total += term
            if term < 1e-18 * max(total, 1e-300):
                break
        return 1.0 - total
    term, total, i = 1.0, 1.0, k
    while i > 0:
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
        total += term
        if term < 1e-18 * total:
            break
    return math.exp(log_term + math.log(total))


def certified_cutoff(counts: list[int], alpha: float, level: float) -> int | None:
    """Strictest cell that documents may reach: ``counts[c]`` good documents
    lie in cell ``c``; those in higher cells than the cutoff are rejected."""
    n, best, beyond = sum(counts), None, 0
    for cut in range(len(counts) - 2, -1, -1):
        beyond += counts[cut + 1]
        if n == 0 or binomial_cdf(beyond, n, alpha) > level:
            break
        best = cut
    return best


def learn_cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05,
                  id_col: str = "doc_id") -> dict[tuple[int, int], int]:
    """``(stratum, measure) -> cutoff cell``."""
    good = (labels.filter(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id"))
            .agg(F.min("quality").alias("q")).filter("q = 1").select("_id"))
    held = (rows.filter(~F.col("base_failed")).join(good, F.col(id_col) == F.col("_id"))
            .select(stratum().alias("s"), F.posexplode(cells()).alias("m", "c"))
            .groupBy("s", "m", "c").count())
    hist = {}
    for r in held.collect():             # at most strata x measures x (GRID + 1) rows
        hist.setdefault((r["s"], r["m"]), [0] * (GRID + 1))[r["c"]] = r["count"]
    tests = (len(STRATA) + 1) * len(MEASURES)
    cuts = {k: certified_cutoff(c, alpha / len(MEASURES), delta / tests) for k, c in hist.items()}
    return {k: c for k, c in cuts.items() if c is not None}


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every document: ``kept`` is false for those that
    fail a base rule or lie beyond a certified cutoff."""
    rows = written(document_counts(docs, id_col, text_col), "counts")
    cuts = learn_cutoffs(rows, labels, alpha, delta, id_col)
    over = F.lit(False)
    for (s, m), cut in sorted(cuts.items()):
        over = over | ((F.col("_s") == s) & (F.get(F.col("_c"), F.lit(m)) > cut))
    rows = rows.withColumns({"_s": stratum(), "_c": cells()})
    return rows.withColumn("kept", ~F.col("base_failed") & ~over).drop("_s", "_c")
