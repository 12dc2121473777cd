"""Language identification by cross-parsing entropy.

A suffix automaton holds every substring of a language's sample.  A text is
parsed greedily: the longest match with the sample is a phrase, the next one
starts after it.  Text of the sample's language falls into few long phrases, so
the language with the least ``phrases * log2(sample length) / text length`` --
bits for each character -- wins.

The samples are bounded, the texts they come from are not: any labelled text with
a letter counts, however short or long.  Per language, texts are taken in the
order of a hash until ``SAMPLE_BYTES`` of normalised text are there, each counting
for ``SAMPLE_BYTES / SAMPLE_DOCS`` (512) bytes at most -- so ``SAMPLE_DOCS`` long
ones or as many short ones as it takes.  Of each the first ``DOC_CHARS``
characters from its first letter on are collected, and all give the same share,
or all they have.  Automata are built from the samples once in each worker.  Texts
are parsed whole, many side by side: one array step advances every text of a
chunk by a character in all automata.

Parsing works on UTF-8 bytes: A-Z lower-cased, ASCII non-letters as single
spaces, other bytes as they are.

Null texts and texts without a letter are ``und`` with score 0; so is every text
when nothing is labelled.  Ties go to the first language by name.  A null id is
neither learned from nor held out (its crc is null, held_out false); repeated
rows repeat; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmix.llm.common import per_worker, slices, string_buffers

SAMPLE_DOCS, DOC_CHARS, SAMPLE_BYTES = 64, 20_000, 32_768
CHUNK_BYTES = 1 << 22
FOLDS = 5
# Bits a character above which a text counts as no learned language: its phrases average two letters.
MAX_COST = 7.5

LETTER = r"A-Za-z\x{80}-\x{10FFFF}"          # what normalising keeps

# letters a-z as they are, other ASCII as a space, bytes of longer characters as they are
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def normalised(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with single spaces, none at a text's start."""
    data = FOLD[raw]
    space = data == 32
    before = np.empty(len(raw), bool)
    before[1:] = space[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = True
    keep = ~(space & before)
    total = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], total[offsets]


class SuffixAutomaton:
    """All substrings of a byte string; state 0 is the empty one."""

    def __init__(self, text: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new


class CrossParser:
    """The automata of all languages as one transition table.

    ``table[state, symbol]`` is the next state; where the current match cannot
    go on it is ``~s``: a new phrase begins, in state ``s`` after the symbol.
    """

    def __init__(self, samples: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in samples]
        used = sorted({c for _, text in samples for c in text})
        self.symbol = np.full(256, len(used), np.uint8)     # the last symbol is in no sample
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        # a phrase costs a byte at least: a tiny sample is not cheap for texts it knows nothing of
        self.bits = np.array([np.log2(max(256, len(text))) for _, text in samples])
        tables, self.root, base = [], [], 0
        for _, text in samples:
            nxt = SuffixAutomaton(text).next
            t = np.full((len(nxt) + 1, self.width), -1, np.int32)   # the last row: between phrases
            for s, out in enumerate(nxt):
                for c, to in out.items():
                    t[s, self.symbol[c]] = to
            again = np.where(t[0] >= 0, t[0], len(nxt)) + base      # an unknown symbol is a phrase alone
            t = np.where(t >= 0, t + base, ~again[None, :])
            tables.append(t)
            self.root.append(base + len(nxt))
            base += len(nxt) + 1
        self.table = np.concatenate(tables).ravel().astype(np.int32) if tables else np.empty(0, np.int32)
        self.root = np.array(self.root, np.int32)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of every text by every automaton: (languages, texts)."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        size, start = size[order], offsets[:-1][order]
        sym = self.symbol[data]
        state = np.repeat(self.root[:, None], len(size), axis=1)
        count = np.zeros(state.shape, np.int32)
        active = len(size) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1))
        for k, m in enumerate(active.tolist()):
            got = self.table[state[:, :m] * self.width + sym[start[:m] + k]]
            count[:, :m] += got < 0
            state[:, :m] = got ^ (got >> 31)                # ~s for new phrases
        out = np.empty_like(count)
        out[:, order] = count
        return out

    def costs(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits for each character: (languages, texts); inf for empty texts."""
        data, off = normalised(raw, offsets)
        n = np.diff(off)
        bits = self.phrases(data, off) * self.bits[:, None]
        return np.where(n > 0, bits / np.maximum(n, 1), np.inf)


def _parser(samples) -> CrossParser:
    return per_worker(("parser", tuple(samples)), lambda: CrossParser(list(samples)))


def held_out(id_col: str) -> Column:
    """Documents kept from learning: crc32 of the id's text modulo 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, piece, h, level, n)`` of the texts to learn from: the piece, a
    hash, how rare the hash is (half of the rows in each further level) and the
    bytes the piece counts for."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS
    piece = F.regexp_extract(F.col(text_col), rf"(?s)[{LETTER}].{{0,{DOC_CHARS - 1}}}", 0)
    rows = docs.filter(F.col(lang_col).isNotNull() & (fold != 0)).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), piece.alias("piece")).filter("piece != ''")
    low = F.col("h").bitwiseAND(F.lit((1 << 32) - 1)).bitwiseOR(F.lit(1 << 32))
    size = F.octet_length(F.regexp_replace("piece", f"[^{LETTER}]+", " "))
    return rows.withColumn("h", F.xxhash64("id", "piece")).select(
        "lang", "piece", "h", F.bit_count(low.bitwiseXOR(low - 1)).alias("level"),
        F.least(size, F.lit(SAMPLE_BYTES // SAMPLE_DOCS)).alias("n"))


def _share(sizes: list[int], room: int) -> int:
    """The most bytes each text may give so that all fit into the room."""
    left = room
    for k, size in zip(range(len(sizes), 0, -1), sorted(sizes)):
        if size * k > left:
            return left // k
        left -= size
    return max(sizes)


def language_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """Normalised sample text of every labelled language, sorted by name."""
    rows = _labelled(docs, id_col, text_col, lang_col)
    # the rarest levels that hold enough: what is then ranked is about twice the sample
    least: dict[str, tuple[int, int]] = {}
    for r in rows.groupBy("lang", "level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():
        level, have = least.get(r["lang"], (0, 0))
        if have < SAMPLE_BYTES:
            least[r["lang"]] = r["level"], have + r["n"]
    if not least:
        return []
    levels = docs.sparkSession.createDataFrame([(lang, k) for lang, (k, _) in least.items()], "lang string, least int")
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("h", "piece").rowsBetween(Window.unboundedPreceding, -1))
    chosen = (rows.join(F.broadcast(levels), "lang").filter(F.col("level") >= F.col("least"))
              .withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < SAMPLE_BYTES))
    texts: dict[str, list] = {}
    for r in chosen.select("lang", "piece").orderBy("h", "piece").collect():
        raw = r["piece"].encode()
        data, _ = normalised(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        texts.setdefault(r["lang"], []).append(data.tobytes().rstrip() + b" ")
    return [(lang, b"".join(t[:_share([len(x) for x in parts], SAMPLE_BYTES)] for t in parts))
            for lang, parts in sorted(texts.items())]


def predict(samples, raw: np.ndarray, offsets: np.ndarray):
    """(index of the best language or -1, score, bits a character) by text."""
    texts = len(offsets) - 1
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    total = np.concatenate([[0], np.cumsum(letter[raw])])
    has = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
        has[i] = any(c.isalpha() for c in raw[offsets[i]:offsets[i + 1]].tobytes().decode())
    if not samples:
        return np.full(texts, -1), np.zeros(texts), np.full(texts, np.inf)
    cost = _parser(samples).costs(raw, offsets)
    best = cost.argmin(axis=0)
    least = np.sort(cost, axis=0)
    with np.errstate(invalid="ignore"):
        score = 1 - least[0] / least[1] if len(samples) > 1 else np.ones(texts)
    return np.where(has, best, -1), np.where(has, np.clip(score, 0, 1), 0.0), least[0]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             carry: bool = False) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, cost)`` of every row; with
    ``carry`` the columns of ``docs`` follow, prefixed by nothing."""
    samples = docs.sparkSession.sparkContext.broadcast(tuple(language_samples(docs, id_col, text_col, lang_col)))
    fields = docs.schema.fields if carry else [docs.schema[id_col]]
    columns = [f"`{f.name}`" for f in fields] + ([] if carry else [f"`{text_col}`"])
    text_at = 1 + (docs.columns.index(text_col) if carry else len(fields))
    rows = docs.select(held_out(id_col).alias("__held_out"), *[F.col(c) for c in columns])
    names = ["__held_out", "__lang_pred", "__score", "__cost", *[f.name for f in fields]]

    def run(batches):
        known = samples.value
        langs = [lang for lang, _ in known]
        for b in batches:
            raw, off = string_buffers(b.column(text_at))
            for a, z in slices(np.diff(off), CHUNK_BYTES):
                best, score, cost = predict(known, raw[off[a]:off[z]], off[a:z + 1] - off[a])
                pred = [langs[int(i)] if i >= 0 else "und" for i in best]
                part = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64()),
                     *part.columns[1:1 + len(fields)]], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"__held_out boolean, __lang_pred string, __score double, __cost double, {kinds}")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, cost)`` of every row."""
    return identify(docs, id_col, text_col, lang_col).select(
        F.col(id_col), F.col("__held_out").alias("held_out"), F.col("__lang_pred").alias("lang_pred"),
        F.col("__score").alias("score"), F.col("__cost").alias("cost"))


def with_language(docs: DataFrame, max_cost: float = MAX_COST, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` that are of some learned language, with all columns."""
    rows = identify(docs, id_col, text_col, lang_col, carry=True)
    return rows.filter((F.col("__lang_pred") != "und") & (F.col("__cost") <= max_cost)).select(
        *[F.col(f"`{c}`") for c in docs.columns])
