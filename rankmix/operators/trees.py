"""Decision trees over binned features: a random forest whose trees are grown
on their own rows, and small trees on weighted rows.

Features are cut at the candidates that Spark's trees use: at most 31 quantiles
of (a sample of) the rows, or all midpoints of a column of few values."""

from __future__ import annotations

import math

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from rankmix.operators.blocks import blocks, summed
from rankmix.session import default_partitions

BINS = 32
SAMPLE = 10_000                # rows that place the cuts, as Spark's trees take
LOCAL_ROWS = 1 << 18           # a node with more rows is split over all tasks
SHUFFLE_BYTES = 1 << 28        # rows of trees that are shuffled at once
KEPT_BYTES = 1 << 26           # sums of test rows that a task holds back


def sample_rows(rows: RDD, seed: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of rows, and ``(x, label)`` of about ``SAMPLE`` of them (all, if
    there are no more)."""
    n = int(summed(rows, lambda b: np.array([len(b[0])]))[0])
    share = SAMPLE / n if n > SAMPLE else 1.0

    def some(index, items):
        rng = np.random.default_rng([seed, index])
        for x, y, *_ in items:
            take = rng.random(len(x)) < share if share < 1 else slice(None)
            yield x[take], y[take]
    got = rows.mapPartitionsWithIndex(some).collect()
    return n, np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got])


class Cuts:
    """Where columns are cut, for any weights of the sampled rows."""

    def __init__(self, x: np.ndarray, rows: int):
        self.order = np.argsort(x, axis=0, kind="stable").T
        self.splits = min(BINS, rows) - 1
        self.columns = []
        for j, order in enumerate(self.order):
            v = x[order, j]
            ends = np.flatnonzero(np.append(v[1:] != v[:-1], True))       # the last row of each value
            self.columns.append((v[ends], ends))

    def at(self, w: np.ndarray | None = None) -> list[np.ndarray]:
        """Rising cuts by column: a value goes left of the cuts that it does not exceed."""
        sums = np.cumsum(w[self.order], axis=1) if w is not None else None
        return [self._column(v, sums[j][ends] if w is not None else ends + 1.0) for j, (v, ends) in enumerate(self.columns)]

    def _column(self, v, count):
        if len(v) - 1 <= self.splits:
            return (v[:-1] + v[1:]) / 2
        # a cut lies before the value that would leave the target behind
        stride, middle, found, least = count[-1] / (self.splits + 1), (count[:-1] + count[1:]) / 2, [], 0
        for i, at in enumerate(np.searchsorted(middle, stride * np.arange(1, self.splits + 1), "right")):
            at = max(at, least)
            if at >= len(middle):
                break
            found.append(at)
            least = at + 1
        found = np.array(found, int)
        return (v[found] + v[found + 1]) / 2


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.searchsorted(c, x[:, j], "left")
    return out


# ------------------------------------------------------------- random forest

def feature_sets(rng, nodes: int, features: int) -> np.ndarray:
    """For each node a random choice of ceil(sqrt(features)) features."""
    m = math.ceil(math.sqrt(features))
    if m >= features:
        return np.tile(np.arange(features), (nodes, 1))
    return np.argpartition(rng.random((nodes, features), dtype=np.float32), m, axis=1)[:, :m]


def _gains(counts, weight, crossed, own):
    """The purity (sum of squared class weights over weight, of both sides) of the
    cut after each bin; -inf where a side is empty."""
    wl, sl, xl = (a.cumsum(axis=1) for a in (weight, own, crossed))
    squares, total = (counts ** 2).sum(axis=1)[:, None], counts.sum(axis=1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = sl / wl + (squares - 2 * xl + sl) / (total - wl)
    return np.where((wl > 0) & (wl < total), score, -np.inf)


def grow(bins, label, times, tested, n_classes: int, max_depth: int, rng, depth: int = 0) -> np.ndarray:
    """A tree (gini, down to single rows) from rows that come ``times`` each; the
    class shares of the leaf of every ``tested`` row.  Two leaves of one prediction
    become one, as in Spark's trees.

    A level's splits are found at once: a node's rows are sorted by class and bin, so
    that a class's running weight, which the squares change by, is a difference of
    running sums; cost goes by rows, not by nodes and classes."""
    c = n_classes
    rows, node = np.arange(len(label)), np.zeros(len(label), np.int64)
    t_rows, t_node = np.arange(len(tested)), np.zeros(len(tested), np.int64)
    leaf_of = np.zeros(len(tested), np.int64)
    levels, first, k = [], 0, 1                      # a level: number of its first node, counts, first children
    while k:
        cell = node * c + label[rows]
        counts = np.bincount(cell, times[rows], k * c).reshape(k, c)
        total, squares = counts.sum(axis=1), (counts ** 2).sum(axis=1)
        child = np.full(k, -1)
        levels.append((first, counts, child))
        open_ = np.flatnonzero(squares < total ** 2) if depth < max_depth else np.zeros(0, int)
        feature, cut = np.zeros(k, np.int64), np.zeros(k, np.int64)
        best = np.full(k, -np.inf)
        if len(open_):
            place = np.full(k, -1)
            place[open_] = np.arange(len(open_))
            inside = place[node] >= 0
            r, at = rows[inside], place[node[inside]]
            w, own_counts = times[r].astype(np.int64), counts[open_]
            sets = feature_sets(rng, len(open_), bins.shape[1])
            head = (at * c + label[r]) << 5
            for s in range(sets.shape[1]):
                key = np.sort(((head | bins[r, sets[at, s]]) << 8) | w)
                wk, key = key & 255, key >> 8
                group, cells = key >> 5, len(open_) * BINS
                before = np.cumsum(wk) - wk
                start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                before = before - np.repeat(before[start], np.diff(np.append(start, len(group))))
                to = (group // c) * BINS + (key & 31)
                score = _gains(own_counts, *(np.bincount(to, v, cells).reshape(-1, BINS) for v in (
                    wk, wk * own_counts.ravel()[group], wk * (2 * before + wk))))
                bin_ = score.argmax(axis=1)
                score = score[np.arange(len(open_)), bin_]
                better = score > best[open_]
                best[open_[better]], feature[open_[better]], cut[open_[better]] = score[better], sets[better, s], bin_[better]
        split = best > squares / np.maximum(total, 1) * (1 + 1e-12)
        n_split = np.count_nonzero(split)
        child[split] = first + k + 2 * np.arange(n_split)
        below = np.where(split, child - first - k, 0)
        stay = split[t_node]
        leaf_of[t_rows[~stay]] = first + t_node[~stay]
        t_rows, t_node = t_rows[stay], t_node[stay]
        t_node = below[t_node] + (tested[t_rows, feature[t_node]] > cut[t_node])
        stay = split[node]
        rows, node = rows[stay], node[stay]
        node = below[node] + (bins[rows, feature[node]] > cut[node])
        first, k, depth = first + k, 2 * n_split, depth + 1
    shares = np.concatenate([counts for _, counts, _ in levels])
    predicted = shares.argmax(axis=1)
    leaf, stands_for = np.ones(first, bool), np.arange(first)
    for at, _, child in reversed(levels):
        inner = np.flatnonzero(child >= 0)
        a, b = child[inner], child[inner] + 1
        leaf[at + inner] = leaf[a] & leaf[b] & (predicted[a] == predicted[b])
    for at, _, child in levels:
        inner = np.flatnonzero(child >= 0)
        inner = inner[leaf[at + inner]]
        for side in (0, 1):
            stands_for[child[inner] + side] = stands_for[at + inner]
    shares = shares[stands_for[leaf_of]]
    return shares / shares.sum(axis=1, keepdims=True)


class RandomForest:
    """A forest of gini trees, each on a bootstrap of the training rows and, in each
    node, on a random choice of ceil(sqrt(features)) features; probabilities are the
    means of the leaves' class shares.

    Nodes of more than ``LOCAL_ROWS`` rows are split over all tasks, from sums by
    bin and class.  Then a node's rows, training and test rows alike, go to one task,
    which grows the rest of the tree at once and gives the test rows their shares: no
    tree is ever collected, and no sums are made for small nodes."""

    def __init__(self, trees: int, max_depth: int, seed: int):
        self.trees, self.max_depth, self.seed = trees, max_depth, seed

    def scores(self, train: DataFrame, test: DataFrame, id_col: str = "item_id", label_col: str = "label") -> DataFrame:
        """``(id, p)``: class probabilities of the test rows."""
        spark = train.sparkSession
        raw = blocks(train, label=label_col)
        n, sample, _ = sample_rows(raw, self.seed)
        n_classes = int(raw.map(lambda b: int(b[1].max())).max()) + 1
        cuts = Cuts(sample, n).at()
        mine = raw.mapPartitionsWithIndex(lambda p, items: (((p, i), binned(x, cuts), y) for i, (x, y, *_) in enumerate(items)))
        mine = mine.persist(StorageLevel.MEMORY_AND_DISK)
        asked = blocks(test, item=id_col)
        theirs = asked.mapPartitionsWithIndex(lambda p, items: (((p, i), binned(x, cuts), ids) for i, (x, _, _, ids) in enumerate(items)))
        theirs = theirs.persist(StorageLevel.MEMORY_AND_DISK)
        tested = theirs.map(lambda b: len(b[1])).sum()
        mine.count()
        for read in (raw, asked):
            read.unpersist()
        seed, depth = self.seed, self.max_depth

        def times(key, tree, rows):
            return np.minimum(np.random.default_rng([seed, tree, *key]).poisson(1.0, rows), 255).astype(np.uint8)

        tops = self._tops(mine, n, n_classes, times)
        per_tree = (n * 0.64 + tested) * (sample.shape[1] + 8)
        at_once, parts = max(1, int(SHUFFLE_BYTES / max(per_tree, 1))), default_partitions(spark)
        done = []
        for begin in range(0, self.trees, at_once):
            trees = range(begin, min(begin + at_once, self.trees))

            def dealt(b, training, trees=trees):
                key, bins, y = b
                for t in trees:
                    w = times(key, t, len(bins)) if training else None
                    at = node_of(tops[t], bins)
                    for node in np.unique(at):
                        take = np.flatnonzero((at == node) & (w > 0) if training else at == node)
                        if len(take):
                            yield (t, int(node)), ((None, bins[take], y[take].astype(np.int32), w[take]) if training
                                                   else (key, bins[take], take.astype(np.int32), len(bins)))

            def grown(groups):
                out, held = {}, 0
                for (t, node), parts in groups:
                    parts = list(parts)
                    # in an order of their own, whichever came first
                    a = sorted((p for p in parts if p[0] is None), key=lambda p: (len(p[3]), p[1].tobytes()[:4096]))
                    b = [p for p in parts if p[0] is not None]
                    if not b:
                        continue
                    rng = np.random.default_rng([seed, 1 << 20, t, node])
                    size = sum(len(x[2]) for x in b)
                    # a tree whose bootstrap is empty has no say
                    p = grow(*(np.concatenate([x[i] for x in a]) for i in (1, 2, 3)), np.concatenate([x[1] for x in b]),
                             n_classes, depth, rng, _depth(tops[t], node)) if a else np.zeros((size, n_classes))
                    ends = np.cumsum([len(x[2]) for x in b])[:-1]
                    for (key, _, places, size), own in zip(b, np.split(p, ends)):
                        if key not in out:
                            out[key] = np.zeros((size, n_classes))
                            held += out[key].nbytes
                        out[key][places] += own
                    if held > KEPT_BYTES:
                        yield from out.items()
                        out, held = {}, 0
                yield from out.items()

            both = mine.flatMap(lambda b, f=dealt: f(b, True)).union(theirs.flatMap(lambda b, f=dealt: f(b, False)))
            sums = both.groupByKey(parts, lambda k: k[0] + k[1]).mapPartitions(grown).reduceByKey(np.add, parts)
            sums = sums.persist(StorageLevel.MEMORY_AND_DISK)
            sums.count()
            done.append(sums)
        trees = self.trees
        total = spark.sparkContext.union(done).reduceByKey(np.add, parts)
        rows = theirs.map(lambda b: (b[0], b[2])).join(total, parts).flatMap(
            lambda r: ((i, (p / (p.sum() or 1.0)).tolist()) for i, p in zip(r[1][0], r[1][1] / trees)))
        out = spark.createDataFrame(rows, f"`{id_col}` {test.schema[id_col].dataType.simpleString()}, p array<double>")
        mine.unpersist()
        return out

    def _tops(self, mine: RDD, n: int, n_classes: int, times) -> dict[int, list]:
        """By tree the nodes above those of at most ``LOCAL_ROWS`` rows."""
        tops = {t: [None] for t in range(self.trees)}
        large = {(t, 0) for t in tops} if n > LOCAL_ROWS else set()
        seed, deepest = self.seed, self.max_depth
        while large:
            def sums(b):
                key, bins, y = b
                for t in sorted({t for t, _ in large}):
                    w, at = times(key, t, len(bins)), node_of(tops[t], bins)
                    for node in sorted(v for u, v in large if u == t):
                        take = np.flatnonzero((at == node) & (w > 0))
                        if len(take):
                            own = bins[take][:, _choice(seed, t, node, bins.shape[1])].astype(np.int64)
                            cell = (np.arange(own.shape[1]) * BINS + own) * n_classes + y[take][:, None]
                            yield (t, node), np.bincount(cell.ravel(), np.repeat(w[take], own.shape[1]).astype(float),
                                                         own.shape[1] * BINS * n_classes)

            def best(item):
                (t, node), hist = item
                hist = hist.reshape(-1, BINS, n_classes)
                counts = hist[0].sum(axis=0)
                left = hist.cumsum(axis=1)
                right = counts - left
                wl, wr = left.sum(axis=2), right.sum(axis=2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where((wl > 0) & (wr > 0), (left ** 2).sum(axis=2) / wl + (right ** 2).sum(axis=2) / wr, -np.inf)
                s, cut = divmod(int(score.argmax()), BINS)
                if score[s, cut] <= (counts ** 2).sum() / counts.sum() * (1 + 1e-12):
                    return (t, node), None
                return (t, node), (s, cut, wl[s, cut], wr[s, cut])

            found = mine.flatMap(sums).reduceByKey(np.add).map(best).collect()
            features = summed(mine, lambda b: np.array([b[1].shape[1], 1]))
            features, large = int(features[0] // features[1]), set()
            for (t, node), split in sorted(found):
                if split is None or _depth(tops[t], node) >= deepest:
                    continue
                s, cut, left, right = split
                child = len(tops[t])
                tops[t][node] = (int(_choice(seed, t, node, features)[s]), cut, child)
                tops[t] += [None, None]
                large |= {(t, child + i) for i, size in enumerate((left, right)) if size > LOCAL_ROWS}
        return tops


def _choice(seed, tree, node, features) -> np.ndarray:
    return feature_sets(np.random.default_rng([seed, 2 << 20, tree, node]), 1, features)[0]


def _depth(tree: list, node: int) -> int:
    above = {v[2] + i: u for u, v in enumerate(tree) if v is not None for i in (0, 1)}
    depth = 0
    while node:
        node, depth = above[node], depth + 1
    return depth


# ------------------------------------------------------- small weighted trees

def weighted_tree(rows: RDD, cuts: list[np.ndarray], n_classes: int, weigh, max_depth: int) -> tuple[tuple[list, np.ndarray], float, float]:
    """A gini tree on weighted rows, one pass a level: ``((nodes, class by node),
    missed weight, all weight)``.  A node: None, or (feature, cut, place of its left
    child).  ``weigh(x, y)`` gives the rows' weights."""
    widths = np.cumsum([0, *(len(c) + 1 for c in cuts)])
    nodes, counts, front = [None], [None], [0]
    for _ in range(max_depth):
        def measure(b):
            x, y, *_ = b
            w, at = weigh(x, y), node_of(nodes, x)
            own = [at == i for i in front]
            return np.stack([np.concatenate([
                np.bincount(np.searchsorted(c, x[mine, j], "left") * n_classes + y[mine], w[mine], (len(c) + 1) * n_classes)
                for j, c in enumerate(cuts)]) for mine in own])

        hists, below = summed(rows, measure).reshape(len(front), -1, n_classes), []
        for i, hist in zip(front, hists):
            counts[i] = whole = hist[:widths[1]].sum(axis=0)
            split = _best_split(hist, whole, widths)
            if split is not None:
                j, k, left, right = split
                nodes[i] = (j, float(cuts[j][k]), len(nodes))
                below += [len(nodes), len(nodes) + 1]
                nodes += [None, None]
                counts += [left, right]
        front = [i for i in below if np.count_nonzero(counts[i]) > 1]
        if not front:
            break
    missed = sum(c.sum() - c.max() for node, c in zip(nodes, counts) if node is None)
    return (nodes, np.array([c.argmax() for c in counts])), missed, counts[0].sum()


def _best_split(hist, whole, widths):
    """``(feature, place of the cut, left, right)`` of the first largest gain; None
    if no cut gains."""
    best, found = 0.0, None
    for j in range(len(widths) - 1):
        left = hist[widths[j]:widths[j + 1]].cumsum(axis=0)[:-1]
        right = whole - left
        wl, wr = left.sum(axis=1), right.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = ((left ** 2).sum(axis=1) / wl + (right ** 2).sum(axis=1) / wr - (whole ** 2).sum() / whole.sum()) / whole.sum()
        gain = np.where((wl > 0) & (wr > 0), gain, -np.inf)
        if len(gain) and gain.max() > best:
            k = int(gain.argmax())
            best, found = gain[k], (j, k, left[k], right[k])
    return found


def node_of(nodes: list, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    for i, node in enumerate(nodes):                 # children come after their parents
        if node is not None:
            here = at == i
            at[here] = node[2] + (x[here, node[0]] > node[1])
    return at


def tree_class(tree: tuple[list, np.ndarray], x: np.ndarray) -> np.ndarray:
    return tree[1][node_of(tree[0], x)]
