"""Token ids through a pre-token cache.

A BPE tokenizer first splits a text into pre-tokens and then encodes each one
on its own, so equal pre-tokens always give equal ids.  Here the splitting is
done with array operations over the code points of many texts at once, every
pre-token gets a 64-bit hash, and only pre-tokens not met before go to the
tokenizers library.  The cache is bounded (``max_entries``); when it is full
it is started anew, so memory does not grow with the corpus.

Texts with a code point from U+0300 on, with a special token's string, or of a
tokenizer whose splitting rule is not one of the two known here are encoded by
the library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np

from rankmix.llm.common import per_worker

KNOWN = 0x300          # below it every code point is NFC-stable and its class is long settled
CHUNK_CHARS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Unicode White_Space below U+0300.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0)


def _class_table() -> np.ndarray:
    out = np.full(KNOWN, OTHER, np.uint8)
    for c in range(KNOWN):
        cat = unicodedata.category(chr(c))[0]
        out[c] = SPACE if c in WHITE else LETTER if cat == "L" else NUMBER if cat == "N" else OTHER
    return out


def _lower_table() -> np.ndarray:
    """Lower case where it is one code point; 0 marks the others."""
    out = np.arange(KNOWN, dtype=np.uint32)
    for c in range(KNOWN):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 and ord(low) < KNOWN else 0
    out[0] = 0
    return out


CLASSES, LOWERED = _class_table(), _lower_table()
BEYOND = re.compile(f"[{chr(KNOWN)}-\U0010ffff]")
ODD = frozenset(chr(c) for c in range(1, KNOWN) if not LOWERED[c])


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash (never 0) of ``values[starts:ends]`` for each of these
    spans, which lie one after another.  Every value is mixed with its place in
    the span before they are added up: no factor is shared by two places, so
    words that cancel out in a polynomial (two letters and their exchange) don't
    cancel out here."""
    if not len(starts):
        return np.empty(0, np.uint64)
    begin, end = int(starts[0]), int(ends[-1])
    place = np.arange(1, end - begin + 1, dtype=np.uint64)
    place -= np.repeat((starts - begin).astype(np.uint64), np.diff(np.append(starts, end)))
    place *= BASE
    place += values[begin:end]
    place *= np.uint64(0xBF58476D1CE4E5B9)
    place ^= place >> np.uint64(32)
    place *= np.uint64(0x94D049BB133111EB)
    place ^= place >> np.uint64(29)
    total = np.zeros(end - begin + 1, np.uint64)
    np.cumsum(place, out=total[1:])
    h = total[ends - begin] - total[starts - begin]
    h = mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    h[h == 0] = 1
    return h


class HashIndex:
    """Open-addressing table from 64-bit hashes to small integers, probed for
    whole arrays at a time."""

    def __init__(self, bits: int = 16):
        self._alloc(bits)

    def _alloc(self, bits):
        self.bits, self.mask, self.n = bits, np.uint64((1 << bits) - 1), 0
        self.keys, self.vals = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, -1 where absent."""
        slot = h & self.mask
        got = self.keys[slot]
        out = np.where(got == h, self.vals[slot], -1)
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            slot_l = (slot[left] + np.uint64(1)) & self.mask
            slot[left] = slot_l
            got = self.keys[slot_l]
            hit = got == h[left]
            out[left[hit]] = self.vals[slot_l[hit]]
            left = left[~hit & (got != 0)]
        return out

    def add(self, h: np.ndarray, vals: np.ndarray) -> None:
        """Insert distinct hashes that are not in the table yet."""
        while 2 * (self.n + len(h)) > len(self.keys):
            old_k, old_v = self.keys, self.vals
            self._alloc(self.bits + 1)
            full = old_k != 0
            self._put(old_k[full], old_v[full])
        self._put(h, vals)

    def _put(self, h, vals):
        self.n += len(h)
        slot = h & self.mask
        left = np.arange(len(h))
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[left[free]]
            won = self.keys[s] == h[left]
            self.vals[s[won]] = vals[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask


class PieceIds:
    """Bounded cache: hash of a pre-token -> its ids."""

    def __init__(self, max_entries: int = 1 << 20):
        self.max_entries = max_entries
        self.reset()

    def reset(self):
        self.index, self.n, self.used = HashIndex(), 0, 0
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)

    @staticmethod
    def _room(a, n):
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def add(self, h: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, used = self.n + len(h), self.used + len(ids)
        self.start, self.length = self._room(self.start, n), self._room(self.length, n)
        self.ids = self._room(self.ids, used)
        self.start[self.n:n] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n:n] = lengths
        self.ids[self.used:used] = ids
        self.index.add(h, np.arange(self.n, n, dtype=np.int32))
        self.n, self.used = n, used


def _byte_starts(cp, cls, first, last):
    """Pre-token starts of the byte-level rule: runs of letters, numbers or
    others take one space before them; white space before a word leaves its
    last character to itself; 's 't 're 've 'm 'll 'd are units."""
    prev = np.empty_like(cls)
    prev[1:], prev[0] = cls[:-1], 255
    prev[first] = 255
    after_space = np.zeros(len(cp), bool)
    after_space[1:] = cp[:-1] == 32
    after_space[first] = False
    nxt = np.empty_like(cls)
    nxt[:-1], nxt[-1] = cls[1:], SPACE
    nxt[last] = SPACE
    start = (cls != prev) & ~((cls != SPACE) & after_space)
    start |= (cls == SPACE) & (nxt != SPACE)
    return _contractions(cp, start, first)


def _word_starts(cp, cls, first, last):
    """Starts (of white space too) of the word rule: letter runs, single
    numbers, runs of others, the same contractions; white space is dropped."""
    prev = np.empty_like(cls)
    prev[1:], prev[0] = cls[:-1], 255
    prev[first] = 255
    start = (cls != prev) | (cls == NUMBER)
    return _contractions(cp, start, first)


def _contractions(cp, start, first):
    at = np.flatnonzero((cp == 39) & start)
    if len(at):
        edge = np.zeros(len(cp) + 3, bool)
        edge[first] = True
        edge[len(cp):] = True
        pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
        a, b = pad[at + 1], pad[at + 2]
        one = ~edge[at + 1] & np.isin(a, [ord(x) for x in "stmd"])
        two = (~edge[at + 1] & ~edge[at + 2] & ~one
               & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e")))
                  | ((a == ord("l")) & (b == ord("l")))))
        for sel, n in ((one, 1), (two, 2)):
            i = at[sel]
            start[i + 1] = False
            end = i + n + 1
            start[end[end < len(cp)]] = True
    return start


def safe_cuts(text: str, limit: int) -> list[str]:
    """Cut a long text before a single space after a non-space: a pre-token
    starts there under either rule, so the ids of the parts join up."""
    out, pos = [], 0
    while len(text) - pos > limit:
        cut = -1
        i = text.find(" ", pos + limit)
        while i != -1:
            if not text[i - 1].isspace() and i + 1 < len(text) and not text[i + 1].isspace():
                cut = i
                break
            i = text.find(" ", i + 1)
        if cut == -1:
            break
        out.append(text[pos:cut])
        pos = cut
    out.append(text[pos:])
    return out


class CachedTokenizer:
    """``encode(texts) -> (ids, lengths)`` equal to the library's
    ``encode(text, add_special_tokens=False)`` of every text."""

    def __init__(self, path: str, max_entries: int = 1 << 20):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        pre, norm = conf.get("pre_tokenizer") or {}, conf.get("normalizer")
        model = conf["model"]
        self.specials = [t["content"] for t in conf.get("added_tokens", [])]
        plain = model["type"] == "BPE" and not model.get("dropout")
        self.kind = None
        if plain and norm is None and pre == {"type": "ByteLevel", "add_prefix_space": False,
                                              "trim_offsets": pre.get("trim_offsets"), "use_regex": True}:
            self.kind = "byte"
        elif plain and norm and pre.get("type") == "Sequence":
            steps = [s["type"] for s in norm.get("normalizers", [])]
            split = pre["pretokenizers"][0]
            # The splitting pattern that _word_starts implements.
            rule = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            if (steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split"
                    and split["pattern"].get("Regex") == rule and split.get("invert")):
                self.kind = "word"
        self.cache = PieceIds(max_entries)
        self.core = self._core(model) if self.kind else None
        if self.core is None:
            self.kind = None
        self.hits = self.misses = 0

    def _core(self, model: dict):
        """The same merges as byte ranks, for the quicker of the two libraries.
        None unless an id's order is its merge's order, which makes the two
        equal; a word's end is the byte FF, which UTF-8 never has."""
        import tiktoken
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in keep]
        # the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on
        byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
        end = model.get("end_of_word_suffix") or ""

        def raw(token: str) -> bytes:
            mark = b""
            if end and token.endswith(end):
                token, mark = token[:-len(end)], b"\xff"
            return bytes(byte_of[c] for c in token) + mark

        vocab, merges = model["vocab"], model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ordered = [vocab.get(a + b, -1) for a, b in pairs]
        singles = [t for t in vocab if len(t.removesuffix(end) if end else t) == 1 and t not in self.specials]
        if (bool(end) != (self.kind == "word") or any(x >= y for x, y in zip(ordered, ordered[1:]))
                or max(vocab[t] for t in singles) >= ordered[0]
                or len(vocab) != len(singles) + len(pairs) + sum(s in vocab for s in self.specials)):
            return None
        ranks = {raw(t): i for t, i in vocab.items() if t not in self.specials}
        if end and len({r for r in ranks if len(r) == 2 and r[1] == 255}) < 256:
            return None
        return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    # -- pieces -------------------------------------------------------
    def _fast(self, text: str) -> bool:
        if self.kind is None or any(s in text for s in self.specials):
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not (BEYOND.search(text) or (self.kind == "word" and not ODD.isdisjoint(text)))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of distinct pre-tokens."""
        one, mark = self.core.encode_single_piece, b"\xff" if self.kind == "word" else b""
        ids = [one(p.encode() + mark) for p in pieces]
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def split(self, texts: list[str]):
        """Pre-tokens of fast texts: (code points, starts, ends, pieces per text)."""
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(n)])
        if not len(cp):
            none = np.empty(0, np.int64)
            return cp, none, none, np.zeros(len(texts), np.int64)
        if self.kind == "word":
            cp = LOWERED[cp]
        cls = CLASSES[cp]
        full = n > 0
        first, last = bounds[:-1][full], bounds[1:][full] - 1
        start = (_byte_starts if self.kind == "byte" else _word_starts)(cp, cls, first, last)
        start[first] = True
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(cp))
        if self.kind == "word":
            keep = cls[at] != SPACE
            at, ends = at[keep], ends[keep]
        per_text = np.diff(np.searchsorted(at, bounds))
        return cp, at, ends, per_text

    def entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache entry of every pre-token and the number of them per text."""
        cp, at, ends, per_text = self.split(texts)
        return self._cached(span_hashes(cp, at, ends), cp, at, ends), per_text

    def _cached(self, h, cp, at, ends) -> np.ndarray:
        entry = self.cache.index.find(h)
        miss = np.flatnonzero(entry < 0)
        self.hits += len(entry) - len(miss)
        if len(miss):
            new, where = np.unique(h[miss], return_index=True)
            self.misses += len(new)
            if self.cache.n + len(new) > self.cache.max_entries and self.cache.n:
                self.cache.reset()
                return self._cached(h, cp, at, ends)
            i, whole = miss[where], cp.tobytes().decode("utf-32-le")
            pieces = [whole[a:b] for a, b in zip(at[i].tolist(), ends[i].tolist())]
            self.cache.add(new, *self.encode_pieces(pieces))
            entry[miss] = self.cache.index.find(h[miss])
        return entry

    def lengths_of(self, h, cp, at, ends) -> np.ndarray:
        """Token lengths of the given pre-tokens of ``split``'s result."""
        entry = self._cached(h, cp, at, ends)
        return self.cache.length[entry]

    # -- texts --------------------------------------------------------
    def _parts(self, texts):
        """Chunks of about CHUNK_CHARS: lists of (text number, part, fast)."""
        chunk, size = [], 0
        for i, t in enumerate(texts):
            t = t or ""
            fast = self._fast(t) if t else True
            for part in (safe_cuts(t, CHUNK_CHARS) if fast and len(t) > CHUNK_CHARS else [t]):
                if size and size + len(part) > CHUNK_CHARS:
                    yield chunk
                    chunk, size = [], 0
                chunk.append((i, part, fast))
                size += len(part)
        if chunk:
            yield chunk

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for chunk in self._parts(texts):
            fast = [(i, t) for i, t, f in chunk if f]
            if fast:
                entry, per = self.entries([t for _, t in fast])
                total = np.concatenate([[0], np.cumsum(self.cache.length[entry], dtype=np.int64)])
                cut = np.concatenate([[0], np.cumsum(per)])
                np.add.at(out, [i for i, _ in fast], total[cut[1:]] - total[cut[:-1]])
            slow = [(i, t) for i, t, f in chunk if not f]
            for i, t in slow:
                out[i] += len(self.lib.encode(t, add_special_tokens=False).ids)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], np.zeros(len(texts), np.int64)
        for chunk in self._parts(texts):
            fast = [t for _, t, f in chunk if f]
            flat, n = np.empty(0, np.uint32), np.empty(0, np.int64)
            if fast:
                entry, per = self.entries(fast)
                ln = self.cache.length[entry].astype(np.int64)
                total = np.concatenate([[0], np.cumsum(ln)])
                src = np.repeat(self.cache.start[entry] - total[:-1], ln) + np.arange(total[-1])
                flat = self.cache.ids[src]
                cut = np.concatenate([[0], np.cumsum(per)])
                n = total[cut[1:]] - total[cut[:-1]]
            if len(fast) == len(chunk):
                ids.append(flat)
                np.add.at(lengths, [i for i, _, _ in chunk], n)
                continue
            pos, k = 0, 0
            for i, t, f in chunk:
                if f:
                    part = flat[pos:pos + n[k]]
                    pos, k = pos + n[k], k + 1
                else:
                    part = np.asarray(self.lib.encode(t, add_special_tokens=False).ids, np.uint32)
                ids.append(part)
                lengths[i] += len(part)
        return (np.concatenate(ids) if ids else np.empty(0, np.uint32)), lengths


def load(path: str, max_entries: int = 1 << 20) -> CachedTokenizer:
    """One tokenizer and cache per worker process, file and size."""
    return per_worker(("tokenizer", path, max_entries), lambda: CachedTokenizer(path, max_entries))
