"""An adaptive context-mixing range coder for token ids.

A sequence of ids is cut into blocks of ``BLOCK`` ids.  Blocks are independent:
each starts from an empty model and has its own checksum, so any block can be
decoded alone.  All blocks of a call are coded side by side: one array step of
the decoder, which runs the same model, gives the k-th id of every block.

The model of a block mixes three predictions of the next id:

* order 2: the id that followed the last two ids when they last stood together;
* order 1: the id that followed the last id;
* order 0: the frequencies of the block's ids so far, and after it a uniform
  floor over all ids.

Each candidate has a confidence that its hits raise and its misses halve, after
every id.  The share of the code range that an order gets is the block's own
frequency with which a candidate of that confidence was right; what higher
orders leave goes to the lower ones.  These frequencies and those of order 0
are brought up to date whenever the block's history has doubled.

An id's place in the range and its width are coded as range variants of
asymmetric numerals: the state of a block, 64 bits wide, gives or takes one word
of 32 bits at most an id.  Such a code is read in the order opposite to writing,
so the encoder runs the model over a block first and codes it from its end.  It
knows all ids, so it needs no step for each: a slot's visits are walked on their
own, and what follows from them is worked out for whole stretches of ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 8192
LANES = 2048                    # blocks coded side by side at most
WALK_LANES = 128                # blocks whose model is run at once by the encoder
CODE_STEPS = 64                 # steps whose widths the encoder turns to 64 bits at once
TABLE_BITS = 10                 # slots of a block's order-1 and order-2 tables
FIRST_HISTORY = 256
TOTAL = 28                      # the code range is divided into 2^28 units
FLOOR = 1 << 20                 # units kept for the uniform floor
REST = (1 << TOTAL) - FLOOR
CONFS = 16
PRIOR = 8                       # weight of the first guess at a probability, in ids
DENSE_BITS = 20                 # ids up to so many bits are looked up by a table
MAGIC = b"IDR2"
U = np.uint64
SHIFT = np.uint32(32 - TABLE_BITS)
WORD, LOW32 = U(1 << 32), U(0xFFFFFFFF)
# Confidence after a miss (first half) or hit (second); 0: the candidate is replaced.
NEXT = np.array([f >> 1 for f in range(CONFS)] + [min(f + 1, CONFS - 1) for f in range(CONFS)], np.uint32)
NEXT[1] = 0
NEXT8 = NEXT.astype(np.uint8)
STEP = NEXT.astype(np.int64) - np.arange(2 * CONFS) % CONFS
GUESS = np.array([256] + [4096 * i for i in range(1, CONFS)], np.int64)


def _shares(tried: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares by block and confidence of order 2 (in units) and after them of
    order 1, and by block of the history, both of 65536."""
    hits, all_ = tried[:, 1].ravel(), tried.sum(axis=1).ravel()
    guess = np.tile(GUESS, len(tried))
    p = np.clip(((hits << 16) + PRIOR * guess) // (all_ + PRIOR), 32, 65472).astype(np.int32)
    p[:len(p) // 2] *= REST >> 16
    p0 = ((found[1] << 16) + PRIOR * 45000) // (found.sum(axis=0) + PRIOR)
    return p, np.clip(p0, 64, 65000).astype(np.int32)


class _Model:
    """What the decoder knows of ``m`` blocks side by side: the first ones, those
    that still have ids.  In arrays of two rows the first is order 2, the second
    order 1.  Numbers of a step are 64 bits wide: few of its operations convert."""

    def __init__(self, lanes: int, width: int):
        self.lanes, self.logged = lanes, 0
        self.table = np.zeros(2 * lanes << TABLE_BITS, np.uint32)   # candidate << 4 | confidence
        self.tried = np.zeros((2 * lanes, 2, CONFS), np.int64)      # misses, hits by confidence
        self.found = np.zeros((2, lanes), np.int64)                 # neither candidate: in the history or not
        self.log = np.empty((width, 2, lanes), np.uint8)            # confidence + 16 if right
        self.in0 = np.zeros((width, lanes), bool)
        self.hashed = np.zeros((2, lanes), np.uint32)               # the ids before, for either order
        self.last = np.zeros(lanes, np.uint32)
        self.narrow(lanes)
        self.learn(0, lanes)

    def narrow(self, m: int) -> None:
        rows = np.arange(self.lanes)[:m] + [[0], [self.lanes]]
        self.base, self.base_p = (rows << TABLE_BITS).astype(np.uint32), rows * CONFS
        self.hashed, self.last = self.hashed[:, :m].copy(), self.last[:m]
        self.w, self.got = np.empty((2, m), np.int64), np.empty((2, m), np.uint32)

    def learn(self, k: int, m: int) -> None:
        """Probabilities from the first ``k`` ids of the first ``m`` blocks."""
        places = np.arange(2 * self.lanes, dtype=np.int32).reshape(2, -1)[:, :m] * (2 * CONFS)
        for a in range(self.logged, k, FIRST_HISTORY):
            log = self.log[a:min(a + FIRST_HISTORY, k), :, :m]
            at = (places + log).ravel()
            self.tried += np.bincount(at, minlength=self.tried.size).reshape(self.tried.shape)
            if self.logged:
                open_ = (log[:, 0] | log[:, 1]) < CONFS
                known = (open_ & self.in0[a:a + len(log), :m]).sum(axis=0)
                self.found[1, :m] += known
                self.found[0, :m] += open_.sum(axis=0) - known
        p, p0 = _shares(self.tried, self.found)
        self.p, self.p0 = p.astype(np.int64), p0[:m].astype(np.int64)
        self.logged = k

    def predict(self):
        """Candidates, the widths of order 2 and order 1, and what they leave."""
        slot = self.hashed
        slot[0] ^= slot[1]
        slot[0] *= np.uint32(2246822519)
        slot >>= SHIFT
        slot += self.base
        self.slot = slot.astype(np.int64)
        self.table.take(self.slot, out=self.got, mode="clip")
        self.entry = self.got.astype(np.int64)
        self.conf = self.entry & 15
        self.p.take(self.base_p + self.conf, out=self.w, mode="clip")
        c = self.entry >> 4
        w2, w1 = self.w
        left = REST - w2
        share = left >> 16
        share *= c[0] != c[1]
        w1 *= share
        left -= w1
        return c, w2, w1, left

    def update(self, k: int, x: np.ndarray, x32: np.ndarray, right: np.ndarray) -> None:
        state = right.astype(np.int64)
        state <<= 4
        state += self.conf
        self.log[k, :, :len(x)] = state
        entry = self.entry
        entry += STEP.take(state, mode="clip")
        new = x << 4
        new += 1
        entry = np.where(state < 2, new, entry)                     # below 2 a miss replaces the candidate
        self.table[self.slot] = entry.astype(np.uint32)
        np.multiply(self.last, np.uint32(3266489917), out=self.hashed[0])
        np.multiply(x32, np.uint32(2654435769), out=self.hashed[1])
        self.last = x32


def _refreshes(longest: int) -> set[int]:
    out, n = set(), FIRST_HISTORY
    while n < longest:
        out.add(n)
        n *= 2
    return out


def _runs(ids: np.ndarray):
    """Equal ids of each block (blocks x n), sorted: the ids, where their runs
    start (in all blocks) and how long the runs are."""
    lanes, n = ids.shape
    h = np.sort(ids, axis=1)
    new = np.ones((lanes, n), bool)
    new[:, 1:] = h[:, 1:] != h[:, :-1]
    starts = np.flatnonzero(new.ravel())
    return h.ravel()[starts], starts, np.diff(np.append(starts, lanes * n))


def _places(history: np.ndarray, window: np.ndarray, id_bits: int) -> np.ndarray:
    """For each id of the window (blocks x ids) where its run starts in the
    block's sorted history, << 16, and the run's length; 0: it has none."""
    lanes, n = history.shape
    ids, starts, lengths = _runs(history)
    value = ((starts & (n - 1)) << 16 | lengths).astype(np.uint32)
    cut = np.searchsorted(starts, np.arange(lanes + 1) * n).tolist()
    out = np.empty(window.shape, np.uint32)
    if id_bits <= DENSE_BITS:
        table = np.zeros(1 << id_bits, np.uint32)
        for r in range(lanes):
            own = ids[cut[r]:cut[r + 1]]
            table[own] = value[cut[r]:cut[r + 1]]
            table.take(window[r], out=out[r], mode="clip")
            table[own] = 0
    else:
        for r in range(lanes):
            own = ids[cut[r]:cut[r + 1]]
            i = np.minimum(np.searchsorted(own, window[r]), len(own) - 1)
            out[r] = np.where(own[i] == window[r], value[cut[r]:cut[r + 1]][i], 0)
    return out


def _steps(width: int, lanes: int, dtype, fill=None) -> np.ndarray:
    """An array by step and block.  Rows a little longer than a power of two lie
    in different cache sets, which turning the array needs."""
    out = np.empty((width, lanes + 16), dtype)[:, :lanes]
    if fill is not None:
        out[:] = fill
    return out


def _active(sizes: np.ndarray, width: int) -> list[int]:
    return (len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, width + 1))).tolist()


def _walk(slots: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidate that each id (blocks x ids) meets in its slot, and what the
    model logs of it, for each of the orders that ``slots`` has.  A slot's visits
    are walked in their order: one array step takes the r-th visit of all slots."""
    orders, lanes, width = slots.shape
    slots[:, np.arange(width) >= sizes[:, None]] = 1 << TABLE_BITS       # behind a block's end
    slots = slots.reshape(orders * lanes, width)
    by_slot = np.argsort(slots, axis=1, kind="stable")
    by_slot += (np.arange(orders * lanes) * width)[:, None]
    by_slot = by_slot.ravel()
    held = slots.ravel().take(by_slot)
    x_of = np.tile(ids.ravel(), orders).take(by_slot)
    new = np.ones(len(held), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    new[::width] = True
    at = np.flatnonzero(new)
    visits = np.diff(np.append(at, len(held)))
    visits[held[at] == 1 << TABLE_BITS] = 0
    falling = np.argsort((width - visits).astype(np.uint16), kind="stable")
    at, visits = at[falling], visits[falling]
    cands, confs = np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint8)
    met, log = np.zeros(len(held), np.uint32), np.zeros(len(held), np.uint8)
    for g in _active(visits, int(visits[0])):
        i, cand, conf = at[:g], cands[:g], confs[:g]
        x = x_of.take(i)
        state = (cand == x).view(np.uint8)
        state <<= 4
        state |= conf
        met[i] = cand
        log[i] = state
        NEXT8.take(state, out=conf, mode="clip")
        gone = conf == 0
        cand[:] = np.where(gone, x, cand)
        conf |= gone.view(np.uint8)
        i += 1
    out = np.empty_like(met), np.empty_like(log)
    out[0][by_slot], out[1][by_slot] = met, log
    return out[0].reshape(orders, lanes, width), out[1].reshape(orders, lanes, width)


def _intervals(ids: np.ndarray, sizes: np.ndarray, id_bits: int, begins: np.ndarray, widths: np.ndarray) -> None:
    """Place and width in the code range of each id, by step and block.  All ids
    are known here, so the model is run over stretches between its refreshes."""
    lanes, width = ids.shape
    slots = np.empty((2, lanes, width), np.uint16)
    a, b = np.zeros((lanes, width), np.uint32), np.zeros((lanes, width), np.uint32)
    np.multiply(ids[:, :-1], np.uint32(2654435769), out=a[:, 1:])       # of the id before, and two before
    np.multiply(ids[:, :-2], np.uint32(3266489917), out=b[:, 2:])
    b ^= a
    b *= np.uint32(2246822519)
    np.right_shift(b, SHIFT, out=slots[0], casting="unsafe")
    np.right_shift(a, SHIFT, out=slots[1], casting="unsafe")
    del a, b
    met, (log2, log1) = _walk(slots, ids, sizes)
    differ = met[0] != met[1]
    del met, slots
    tried, found = np.zeros((2 * lanes, 2, CONFS), np.int64), np.zeros((2, lanes), np.int64)
    place_of = np.arange(2 * lanes, dtype=np.int32)[:, None]
    logged, known = 0, None
    for n in [0, *sorted(_refreshes(width))]:
        m = int((sizes > n).sum())
        if n:
            for row, log in ((0, log2), (lanes, log1)):
                at = place_of[row:row + m] * (2 * CONFS) + log[:m, logged:n]
                tried += np.bincount(at.ravel(), minlength=tried.size).reshape(tried.shape)
            if logged:
                open_ = (log2[:m, logged:n] | log1[:m, logged:n]) < CONFS
                old = (open_ & known[:m]).sum(axis=1)
                found[1, :m] += old
                found[0, :m] += open_.sum(axis=1) - old
        logged, log_n = n, max(n, 1).bit_length() - 1
        p, p0 = _shares(tried, found)
        end = min(max(2 * n, FIRST_HISTORY), width)
        x, two, one = ids[:m, n:end], log2[:m, n:end], log1[:m, n:end]
        w2 = p.take(place_of[:m] * CONFS + (two & 15), mode="clip")
        left = np.int32(REST) - w2
        w1 = left >> 16
        w1 *= p.take(place_of[lanes:lanes + m] * CONFS + (one & 15), mode="clip")
        w1 *= differ[:m, n:end]
        left -= w1
        begin = w2 + w1
        if n:
            u0 = left >> 16
            u0 *= p0[:m, None]
            u0 >>= log_n
            np.maximum(u0, 1, out=u0)
            left -= u0 << log_n
        left += np.int32(FLOOR)
        left >>= id_bits
        far = x.astype(np.int32)
        far *= left
        if n:
            place = _places(ids[:m, :n], x, id_bits)
            known = place != 0
            far += u0 << log_n
            at = (place >> np.uint32(16)).view(np.int32)
            at *= u0
            u0 *= (place & np.uint32(0xFFFF)).view(np.int32)
            np.copyto(far, at, where=known)
            np.copyto(left, u0, where=known)
        begin += far
        two, one = two >= CONFS, one >= CONFS
        np.copyto(begin, w2, where=one)
        np.copyto(left, w1, where=one)
        np.copyto(begin, 0, where=two)
        np.copyto(left, w2, where=two)
        begins[n:end, :m], widths[n:end, :m] = begin.T, left.T


def _encode_lanes(ids: np.ndarray, sizes: np.ndarray, id_bits: int) -> list[bytes]:
    """Code of each row of ``ids``; rows are sorted by falling size."""
    lanes, width = ids.shape
    begins, widths = _steps(width, lanes, np.int32), _steps(width, lanes, np.int32)
    for a in range(0, lanes, WALK_LANES):
        own = sizes[a:a + WALK_LANES]
        n = int(own[0])
        _intervals(ids[a:a + WALK_LANES, :n], own, id_bits, begins[:n, a:a + len(own)], widths[:n, a:a + len(own)])
    active = _active(sizes, width)
    state, words = np.full(lanes, WORD), widths.view(np.uint32)     # a width gives its place to a word
    given = _steps(width, lanes, bool, False)
    for end in range(width, 0, -CODE_STEPS):
        first = max(end - CODE_STEPS, 0)
        m = active[first]
        size = widths[first:end, :m].astype(U)
        limit = size << U(64 - TOTAL)
        rest = U(1 << TOTAL) - size
        begin = begins[first:end, :m].astype(U)
        for k in range(end - 1, first - 1, -1):
            m, j = active[k], k - first
            x = state[:m]
            full = np.greater_equal(x, limit[j, :m], out=given[k, :m])
            words[k, :m] = x
            x >>= np.multiply(full, U(32))
            q = x // size[j, :m]
            q *= rest[j, :m]                                        # x % size + (x // size << TOTAL)
            x += q
            x += begin[j, :m]
    first = np.stack([state >> U(32), state & LOW32], axis=1).astype("<u4")
    words, given = np.ascontiguousarray(words.T), np.ascontiguousarray(given.T)
    return [first[j].tobytes() + words[j][given[j]].astype("<u4").tobytes() for j in range(lanes)]


def _decode_lanes(codes: list[bytes], sizes: np.ndarray, id_bits: int) -> np.ndarray:
    lanes, width = len(codes), int(sizes[0])
    model = _Model(lanes, width)
    words = np.frombuffer(b"".join(codes), "<u4").astype(U)
    pos = np.cumsum([0] + [len(c) // 4 for c in codes[:-1]])
    code = words.take(pos, mode="clip") << U(32) | words.take(pos + 1, mode="clip")
    signed = code.view(np.int64)
    pos += 2
    column = _steps(width, lanes, np.uint32, 0)
    due, last = _refreshes(width), (1 << id_bits) - 1
    history = lane_at = None
    n, now = 0, lanes
    for k, m in enumerate(_active(sizes, width)):
        if m < now:
            code, pos, now = code[:m], pos[:m], m
            signed = code.view(np.int64)
            model.narrow(m)
            model.p0 = model.p0[:m]
            lane_at = lane_at[:m] if n else None
        if k in due:
            model.learn(k, m)
            n, log_n = k, k.bit_length() - 1
            history = None
            ids, starts, lengths = _runs(np.ascontiguousarray(column[:n, :m].T))
            history = np.repeat(ids.astype(np.int64) << 32 | (starts & (n - 1)) << 16 | lengths, lengths)
            lane_at = np.arange(m, dtype=np.int64) * n
        c, w2, w1, left = model.predict()
        t = signed & ((1 << TOTAL) - 1)
        t1 = t - w2
        over = t1 - w1
        two, hit = t < w2, over < 0                                 # order 2; one of the candidates
        # Quotients of integers below 2^53 have the right whole part.  What is computed
        # of blocks whose candidate is right is left aside, whatever it is.
        if n:
            unit = left >> 16
            unit *= model.p0
            unit >>= log_n
            np.maximum(unit, 1, out=unit)
            x0 = (over / unit).astype(np.int64)
            known = np.less(x0, n, out=model.in0[k, :m])
            j = np.logical_not(known).nonzero()[0]
            x0 += lane_at
            run = history.take(x0, mode="clip")
            x0 = run >> 32
            begin = run >> 16
            begin &= 0xFFFF
            begin *= unit
            run &= 0xFFFF
            run *= unit
            if len(j):
                area = unit.take(j)
                area <<= log_n
                floor = left.take(j)
                floor += FLOOR
                floor -= area
                floor >>= id_bits
                rest = over.take(j)
                rest -= area
                far = (rest / floor).astype(np.int64)
                np.minimum(far, last, out=far)
                x0[j], run[j] = far, floor
                far *= floor
                far += area
                begin[j] = far
            over -= begin
            unit = run
        else:
            left += FLOOR
            left >>= id_bits
            unit = left
            x0 = (over / unit).astype(np.int64)
            np.minimum(x0, last, out=x0)
            over -= x0 * unit
        x = np.where(hit, np.where(two, c[0], c[1]), x0)
        x32 = x.astype(np.uint32)
        column[k, :m] = x32
        unit = np.where(hit, np.where(two, w2, w1), unit)
        model.update(k, x, x32, c == x)
        code >>= U(TOTAL)
        signed *= unit
        signed += np.where(hit, np.where(two, t, t1), over)         # the distance from the interval's begin
        i = (code < WORD).nonzero()[0]
        at = pos.take(i)
        more = code.take(i)
        more <<= U(32)
        more |= words.take(at, mode="clip")
        code[i] = more
        at += 1
        pos[i] = at
    return np.ascontiguousarray(column.T)


# ------------------------------------------------------------- frames

HEAD = struct.Struct("<4sBxxxQI")          # magic, id bits, ids, blocks
ENTRY = np.dtype([("ids", "<u4"), ("bytes", "<u4"), ("crc32", "<u4")])


def encode_frames(sequences: list[np.ndarray], id_bits: int = 16) -> list[bytes]:
    """One self-contained frame for each id sequence: a header, a table of its
    blocks (ids, code bytes, crc32 of the ids) and the blocks' codes."""
    blocks = []                             # (sequence, ids)
    for s, ids in enumerate(sequences):
        if len(ids) and int(ids.max()) >> id_bits:
            raise ValueError(f"an id has more than {id_bits} bits")
        blocks += [(s, ids[a:a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i][1]))
    codes: list[bytes] = [b""] * len(blocks)
    for a in range(0, len(order), LANES):
        part = order[a:a + LANES]
        sizes = np.array([len(blocks[i][1]) for i in part])
        ids = np.zeros((len(part), sizes[0]), np.uint32)
        for r, i in enumerate(part):
            ids[r, :sizes[r]] = blocks[i][1]
        for i, c in zip(part, _encode_lanes(ids, sizes, id_bits)):
            codes[i] = c
    frames, at = [], 0
    for s, ids in enumerate(sequences):
        n = -(-len(ids) // BLOCK)
        table = np.zeros(n, ENTRY)
        for j in range(n):
            own = blocks[at + j][1]
            table[j] = (len(own), len(codes[at + j]), zlib.crc32(own.astype("<u4").tobytes()))
        frames.append(HEAD.pack(MAGIC, id_bits, len(ids), n) + table.tobytes() + b"".join(codes[at:at + n]))
        at += n
    return frames


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The id sequences of frames; raises when a block's checksum is wrong."""
    blocks, sizes = [], []                  # (frame, place, ids, code, crc, id bits)
    for f, raw in enumerate(frames):
        magic, id_bits, total, n = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a frame of token ids")
        table = np.frombuffer(raw, ENTRY, n, HEAD.size)
        at, place = HEAD.size + n * ENTRY.itemsize, 0
        for e in table:
            blocks.append((f, place, int(e["ids"]), raw[at:at + int(e["bytes"])], int(e["crc32"]), id_bits))
            at, place = at + int(e["bytes"]), place + int(e["ids"])
        sizes.append(total)
    out = [np.zeros(n, np.uint32) for n in sizes]
    order = sorted(range(len(blocks)), key=lambda i: (blocks[i][5], -blocks[i][2]))
    a = 0
    while a < len(order):
        part = [i for i in order[a:a + LANES] if blocks[i][5] == blocks[order[a]][5]]
        a += len(part)
        lanes = np.array([blocks[i][2] for i in part])
        ids = _decode_lanes([blocks[i][3] for i in part], lanes, blocks[part[0]][5])
        for r, i in enumerate(part):
            f, place, n, _, crc, _ = blocks[i]
            own = ids[r, :n]
            if zlib.crc32(own.astype("<u4").tobytes()) != crc:
                raise ValueError(f"wrong checksum in block at id {place}")
            out[f][place:place + n] = own
    return out
