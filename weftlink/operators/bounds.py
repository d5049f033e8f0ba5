"""Exact k best inner products of a block of queries with one block of targets after another, by upper bounds.

A bound of every pair comes from one product of narrow float32 matrices; only pairs whose bound reaches the k-th best score that the query has so far
are summed in full, in float64. Bounds are never too small, so no pair is lost; how narrow matrices are changes time alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

DIGITS = 6
ROWS = 1024  # queries in a product
EXACT, FOLDED = 768, 256  # columns with one gram, and columns that share the others
CLUSTERS, ALIKE, SAMPLE_COLUMNS = 12, 0.8, 512
PARTS = 8  # groups of grams for each cluster in the coarse bound
SUMMED = 1 << 20  # entries that are summed at once
SLACK = 2e-4  # float32 sums of up to EXACT + FOLDED positive terms are off by less than that share
HALF = 10.0**-DIGITS  # over half a unit of the last digit
LEAST = np.float32(1e-37)


def recent(kept: dict, key, make: Callable, most: int = 3):
    """`kept[key]`, made if missing; the `most` keys used last stay."""
    found = kept.pop(key, None)
    if found is None:
        while len(kept) >= most:
            kept.pop(next(iter(kept)))
        found = make()
    kept[key] = found
    return found


class Best:
    """The k best rounded scores of each query so far."""

    def __init__(self, n: int, k: int, empty: float):
        self.scores, self.k = np.full((n, k), empty), k

    @property
    def bound(self) -> np.ndarray:
        return self.scores[:, -1]

    def take(self, row: np.ndarray, place: np.ndarray, score: np.ndarray) -> tuple:
        """Of new pairs those that can be among the k best, k of a query at most; ties go to the smaller place."""
        use = score >= self.bound[row]
        row, place, score = row[use], place[use], score[use]
        order = np.lexsort((place, -score, row))
        row, place, score = row[order], place[order], score[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row, "left")
        use = nth < self.k
        row, place, score, nth = row[use], place[use], score[use], nth[use]
        rows, at = np.unique(row, return_inverse=True)
        more = np.full((len(rows), self.k), -np.inf)
        more[at, nth] = score
        self.scores[rows] = -np.sort(-np.concatenate([self.scores[rows], more], 1), 1)[:, : self.k]
        use = score >= self.bound[row]
        return row[use], place[use], score[use]


def first_bounds(upper: np.ndarray, k: int, exact: Callable) -> np.ndarray:
    """Of each row the k-th best exact score among the k pairs with the largest bound, -inf with fewer columns."""
    n = upper.shape[1]
    if n < k:
        return np.full(len(upper), -np.inf)
    place = np.argpartition(upper, n - k, axis=1)[:, n - k :]
    row = np.repeat(np.arange(len(upper)), k)
    return exact(row, place.ravel()).reshape(-1, k).min(1)


class Vectors:
    """Queries with dense vectors. Scores of any sign."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors, self.near = vectors, vectors.astype(np.float32)
        self.length = np.sqrt((vectors * vectors).sum(1))
        self.best = Best(len(vectors), k, -np.inf)

    def meet(self, targets: np.ndarray) -> tuple:
        right, parts = targets.astype(np.float32).T, []
        # float32: an error of each factor, and one for each term of the sum
        off = (targets.shape[1] + 4) * 2.0**-23 * self.length * np.sqrt((targets * targets).sum(1).max(initial=0)) + HALF
        for lo in range(0, len(self.vectors), ROWS):
            own = slice(lo, lo + ROWS)
            upper = self.near[own] @ right
            exact = lambda r, c, lo=lo: np.concatenate([np.einsum("ij,ij->i", self.vectors[lo + r[a : a + 65536]], targets[c[a : a + 65536]]) for a in range(0, len(r), 65536)] or [np.zeros(0)]).round(DIGITS)
            bound = self.best.bound[own].copy()
            if len(new := np.flatnonzero(np.isinf(bound))):
                bound[new] = first_bounds(upper[new], self.best.k, lambda r, c, new=new, exact=exact: exact(new[r], c))
            row, place = np.nonzero(upper >= np.nextafter((bound - off[own]).astype(np.float32), np.float32(-np.inf))[:, None])
            parts.append(self.best.take(lo + row, place, exact(row, place)))
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, int) for i in range(3))


class Asked:
    """Queries as sparse vectors of positive weights: entries (row, place, weight, names), rows rising, names by place.

    Queries fall into clusters (of languages, say). Each has columns of its own for the grams that weigh most there; all others share columns,
    in which a row has the length of its part, so by Cauchy and Schwarz products of columns are bounds. Targets fall to the cluster whose grams
    weigh most in them; for all other clusters a coarser bound, from lengths in a few groups of grams, leaves out most queries.
    """

    def __init__(self, entries: tuple, n: int, k: int):
        self.row, self.place, self.weight, self.names = entries
        self.n, self.best = n, Best(n, k, 0.0)
        self.starts = np.searchsorted(self.row, np.arange(n + 1))
        wide = max(1, len(self.names))
        square = self.weight * self.weight
        cluster = self._clusters(square)
        energy = np.zeros((cluster.max(initial=0) + 1, wide))
        for c in range(len(energy)):
            use = cluster[self.row] == c
            energy[c] = np.bincount(self.place[use], square[use], wide) / max(1, (cluster == c).sum())
        self.group = energy.argmax(0)
        for c in range(len(energy)):  # parts of about equal weight
            own = np.flatnonzero(self.group == c)
            own = own[np.argsort(-energy[c, own], kind="stable")]
            share = np.cumsum(energy[c, own])
            self.group[own] = c * PARTS + np.minimum(share * PARTS // max(share[-1] if len(own) else 0, 1e-300), PARTS - 1).astype(int)
        self.groups = len(energy) * PARTS
        self.coarse = self._lengths(self.row, self.group[self.place], square, n, self.groups)
        self.cluster, self.clusters = cluster, [self._columns(np.flatnonzero(cluster == c), energy[c]) for c in range(len(energy))]
        self.common = self._columns(np.arange(n), energy.sum(0))

    def _columns(self, rows: np.ndarray, energy: np.ndarray) -> tuple:
        """Rows, the column of each gram, how many columns there are, and the rows' matrix."""
        wide, columns = len(energy), min(len(energy), EXACT + FOLDED)
        rank = np.empty(wide, np.int32)
        rank[np.argsort(-energy, kind="stable")] = np.arange(wide, dtype=np.int32)
        rank = np.where(rank < EXACT, rank, EXACT + rank % FOLDED) if wide > columns else rank
        return rows, rank, columns, self._matrix(self.starts, rows, self.place, self.weight, rank, columns)

    def _clusters(self, square: np.ndarray) -> np.ndarray:
        """A number for each query. Queries alike should have the same; results do not depend on it."""
        most = np.argsort(-np.bincount(self.place, square, max(1, len(self.names))), kind="stable")[:SAMPLE_COLUMNS]
        column = np.full(max(1, len(self.names)), -1)
        column[most] = np.arange(len(most))
        at = column[self.place]
        use = at >= 0
        x = np.zeros((self.n, len(most)), np.float32)
        x[self.row[use], at[use]] = self.weight[use]
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)
        count = max(1, min(CLUSTERS, self.n // 64))
        middle = x[np.random.default_rng(0).choice(self.n, count, replace=False)] if self.n else np.zeros((1, len(most)), np.float32)
        for _ in range(5):
            nearest = (x @ middle.T).argmax(1) if self.n else np.zeros(0, int)
            middle = np.stack([x[nearest == c].sum(0) for c in range(count)])
            middle /= np.maximum(np.sqrt((middle * middle).sum(1, keepdims=True)), 1e-30)
        same, name = middle @ middle.T > ALIKE, np.arange(count)
        for c in range(count):
            for d in np.flatnonzero(same[c]):
                name[name == name[d]] = name[c]
        return np.unique(name[nearest], return_inverse=True)[1]

    @staticmethod
    def _lengths(row: np.ndarray, column: np.ndarray, square: np.ndarray, n: int, columns: int) -> np.ndarray:
        return np.sqrt(np.bincount(row * np.int64(columns) + column, square, n * columns)).astype(np.float32).reshape(n, columns)

    @staticmethod
    def _matrix(starts: np.ndarray, rows: np.ndarray, place: np.ndarray, weight: np.ndarray, rank: np.ndarray, columns: int) -> np.ndarray:
        out = np.zeros((len(rows), columns), np.float32)
        for lo in range(0, len(rows), ROWS):
            own, part = rows[lo : lo + ROWS], out[lo : lo + ROWS]
            at, size = slice(starts[own[0]], starts[own[-1] + 1]), np.diff(starts[own[0] : own[-1] + 2])
            if len(own) < len(size):  # others lie between
                at, size = spans(starts, own)
            column, w = rank[place[at]], weight[at]
            cell = np.repeat(np.arange(len(own), dtype=np.int32) * np.int32(columns), size) + column
            shared = column >= EXACT
            part.ravel()[cell] = w  # of columns that grams share, what follows is right
            row, column, w = cell[shared] // columns, column[shared] - EXACT, w[shared]
            part[:, EXACT:] = np.sqrt(np.bincount(row * max(1, columns - EXACT) + column, w * w, len(own) * max(0, columns - EXACT))).reshape(len(own), -1) if columns > EXACT else 0
        return out

    def meet(self, targets: tuple, nt: int) -> tuple:
        """(query rows, target rows, scores): what may be among the k best of all targets met so far, k of a query at most."""
        row, place, weight = matched(self.names, targets)
        held, parts = (np.searchsorted(row, np.arange(nt + 1)), place, weight), []
        coarse = self._lengths(row, self.group[place], weight * weight, nt, self.groups)
        home = (coarse * coarse).reshape(nt, -1, PARTS).sum(2).argmax(1)
        for c, (rows, rank, columns, near) in enumerate(self.clusters):
            there = np.flatnonzero(home == c)
            if len(there):
                right = self._matrix(held[0], there, place, weight, rank, columns).T
                parts += [self._tile(rows[lo : lo + ROWS], near[lo : lo + ROWS] @ right, held, there) for lo in range(0, len(rows), ROWS)]
        # the few queries that may find something among targets of another cluster
        astray, reached = np.zeros(self.n, bool), np.zeros(nt, bool)
        for c, (rows, *_) in enumerate(self.clusters):
            away = np.flatnonzero(home != c)
            for lo in range(0, len(rows), ROWS) if len(away) else ():
                own = rows[lo : lo + ROWS]
                reach = self.coarse[own] @ coarse[away].T >= self._limit(self.best.bound[own])[:, None]
                astray[own] = reach.any(1)
                reached[away] |= reach.any(0)
        rows, there = np.flatnonzero(astray), np.flatnonzero(reached)
        if len(rows):
            _, rank, columns, near = self.common
            right = self._matrix(held[0], there, place, weight, rank, columns).T
            for lo in range(0, len(rows), ROWS):
                own = rows[lo : lo + ROWS]
                upper = near[own] @ right
                upper[self.cluster[own][:, None] == home[there]] = 0  # met above
                parts.append(self._tile(own, upper, held, there))
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, int) for i in range(3))

    def _tile(self, own: np.ndarray, upper: np.ndarray, held: tuple, there: np.ndarray) -> tuple:
        """What `upper`, bounds of the pairs of the rows `own` and the targets `there`, leaves."""
        exact = lambda r, c: row_sums((self.starts, self.place, self.weight), held, len(self.names), own[r], there[c])
        bound = self.best.bound[own].copy()
        if len(new := np.flatnonzero(bound <= 0)):
            bound[new] = np.maximum(first_bounds(upper[new], self.best.k, lambda r, c: exact(new[r], c).round(DIGITS)), 0)
        r, c = np.divmod(np.flatnonzero(upper >= self._limit(bound)[:, None]), len(there))
        sums = exact(r, c)
        real = sums > 0
        return self.best.take(own[r[real]], there[c[real]], sums[real].round(DIGITS))

    @staticmethod
    def _limit(bound: np.ndarray) -> np.ndarray:
        """What a float32 bound of a pair reaches if its rounded score is `bound` or more; without a bound, if it shares a gram."""
        return np.maximum(((bound - HALF) * (1 - SLACK)).astype(np.float32), LEAST)


def spans(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of `rows`, one row after another, and how many each has."""
    size = starts[rows + 1] - starts[rows]
    return np.repeat(starts[rows] - np.cumsum(size) + size, size) + np.arange(size.sum()), size


def matched(names: np.ndarray, targets: tuple) -> tuple:
    """Row, place among `names` and weight of the targets' entries whose gram is among them."""
    row, place, weight, others = targets
    _, mine, theirs = np.intersect1d(names, others, assume_unique=True, return_indices=True)
    own = np.full(max(1, len(others)), -1, np.int32)
    own[theirs] = mine
    place = own[place]
    use = place >= 0
    return (row, place, weight) if use.all() else (row[use], place[use], weight[use])


def row_sums(queries: tuple, targets: tuple, wide: int, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of pairs (row of the queries, row of the targets). Either side is (starts, place, weight) with places below `wide` that mean the same grams."""
    out, sizes = np.zeros(len(rows)), [s[0][r + 1] - s[0][r] for s, r in ((queries, rows), (targets, at))]
    shorter = sizes[0] < sizes[1]  # the shorter row is looked up in the longer one
    for use, held, asked, a, b in ((~shorter, queries, targets, rows, at), (shorter, targets, queries, at, rows)):
        pairs = np.flatnonzero(use)
        if len(pairs):
            out[pairs] = _looked_up(held, asked, wide, a[pairs], b[pairs])
    return out


def _looked_up(held: tuple, asked: tuple, wide: int, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    (starts, place, weight), (starts_t, place_t, weight_t) = held, asked
    out, order = np.zeros(len(rows)), np.argsort(rows, kind="stable")
    many = max(1, min(64, (1 << 20) // max(1, wide)))
    table = np.zeros(many * max(1, wide))
    distinct, first = np.unique(rows[order], return_index=True)
    first = np.append(first, len(rows))
    for lo in range(0, len(distinct), many):
        own = distinct[lo : lo + many]
        entries, size = spans(starts, own)
        cells = np.repeat(np.arange(len(own)) * wide, size) + place[entries]
        table[cells] = weight[entries]
        pairs = order[first[lo] : first[min(lo + many, len(distinct))]]
        offset = np.searchsorted(own, rows[pairs]) * wide
        size = starts_t[at[pairs] + 1] - starts_t[at[pairs]]
        pairs, offset, size = pairs[size > 0], offset[size > 0], size[size > 0]
        step = max(1, SUMMED // max(1, int(size.mean()))) if len(size) else 1
        for a in range(0, len(pairs), step):
            part, n = pairs[a : a + step], size[a : a + step]
            there, _ = spans(starts_t, at[part])
            products = table[np.repeat(offset[a : a + step], n) + place_t[there]] * weight_t[there]
            out[part] = np.add.reduceat(products, np.cumsum(n) - n)
        table[cells] = 0
    return out


def pair_sums(queries: tuple, nq: int, targets: tuple, nt: int, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of given pairs, from the entries of both sides."""
    row, place, weight = matched(queries[3], targets)
    asked = np.searchsorted(queries[0], np.arange(nq + 1)), queries[1], queries[2]
    return row_sums(asked, (np.searchsorted(row, np.arange(nt + 1)), place, weight), len(queries[3]), rows, at)
