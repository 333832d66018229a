"""A bulk-loaded R-tree over group-count vectors, joined with itself under an overlap bound.

A set of hashed tokens is a point: coordinate ``g`` counts its tokens in
group ``g``.  Two sets share at most the sum over the groups of the smaller
counts, and two boxes at most the sum of the smaller upper corners, so a
pair of nodes (or points) is pursued only while that sum, and the sizes,
still allow the similarity.  Survivors are verified on the sets themselves.
"""

from __future__ import annotations

import numpy as np

FANOUT = 32
#: Bytes of the vectors that are compared at once, on each side: vectors of long texts are wide.
COMPARED_BYTES = 8 << 20


class CountTree:
    """Points in sort-tile order; level 0 has the points, each further level boxes of ``FANOUT`` entries."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((*vectors[:, :2].T, sizes))
        # Tiles of similar size are ordered again by the widest-spread coordinate.
        tile = FANOUT * FANOUT
        widest = int(np.argmax(vectors.std(axis=0))) if len(vectors) else 0
        for lo in range(0, len(order), tile):
            part = order[lo : lo + tile]
            order[lo : lo + tile] = part[np.argsort(vectors[part, widest], kind="stable")]
        self.order = order
        self.upper = [vectors[order]]
        self.small = [sizes[order]]
        self.large = [sizes[order]]
        while len(self.upper[-1]) > FANOUT:
            cuts = np.arange(0, len(self.upper[-1]), FANOUT)
            self.upper.append(np.maximum.reduceat(self.upper[-1], cuts, axis=0))
            self.small.append(np.minimum.reduceat(self.small[-1], cuts))
            self.large.append(np.maximum.reduceat(self.large[-1], cuts))

    def _passing(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether entries a and b of a level may hold a pair with 9 * overlap >= 4 * (size + size)."""
        small, large, upper = self.small[level], self.large[level], self.upper[level]
        ok = (5 * large[a] >= 4 * small[b]) & (5 * large[b] >= 4 * small[a])
        at = np.flatnonzero(ok)
        step = max(1, COMPARED_BYTES // (4 * upper.shape[1]))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            shared = np.minimum(upper[a[part]], upper[b[part]]).sum(axis=1, dtype=np.int64)
            ok[part] = 9 * shared >= 4 * (small[a[part]] + small[b[part]])
        return ok

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices (into the input) of all point pairs whose bound allows the similarity."""
        top = len(self.upper) - 1
        a, b = np.triu_indices(len(self.upper[top]))
        for level in range(top, -1, -1):
            if level == 0:
                a, b = a[a != b], b[a != b]
            keep = self._passing(level, a, b)
            a, b = a[keep], b[keep]
            if level == 0:
                break
            below = len(self.upper[level - 1])
            step = np.arange(FANOUT)
            left = (a[:, None, None] * FANOUT + step[None, :, None]) + np.zeros((1, 1, FANOUT), np.int64)
            right = (b[:, None, None] * FANOUT + step[None, None, :]) + np.zeros((1, FANOUT, 1), np.int64)
            a, b = left.ravel(), right.ravel()
            keep = (a < below) & (b < below) & (a <= b)
            a, b = a[keep], b[keep]
        return self.order[a], self.order[b]


def groups_of(size: int) -> int:
    """Groups for a set of this size: a power of two with about eight elements a group or fewer."""
    groups = 16
    while groups < 8192 and groups * 8 < size:
        groups *= 2
    return groups


def count_vector(elements: np.ndarray) -> np.ndarray:
    groups = groups_of(len(elements))
    counts = np.bincount((elements & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype(np.uint8 if not len(counts) or counts.max() < 256 else np.uint16)


def read_vector(raw: bytes | memoryview, size: int) -> np.ndarray:
    """A count vector from its bytes; its width follows from the set's size."""
    return np.frombuffer(raw, np.uint8 if len(raw) == groups_of(size) else np.uint16)


def candidate_pairs(sizes: np.ndarray, vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs whose count vectors allow the similarity.

    Vectors are compared at the number of groups of the smaller set; a
    finer vector folds to it exactly, as group numbers are low hash bits.
    """
    width = np.array([len(v) for v in vectors])
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for groups in np.unique(width).tolist():
        own = np.flatnonzero(width == groups)
        above = np.flatnonzero((width > groups) & (4 * sizes <= 5 * sizes[own].max()))
        part = np.concatenate([own, above])
        if len(part) < 2:
            continue
        flat = np.stack([vectors[i].astype(np.int32).reshape(-1, groups).sum(axis=0) for i in part])
        a, b = CountTree(flat, sizes[part]).pairs()
        keep = (a < len(own)) | (b < len(own))
        found.append((part[a[keep]], part[b[keep]]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sets."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    # Many pairs: an incidence matrix over the elements that two sets or more have, in column blocks.
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value, column, count = np.unique(element, return_inverse=True, return_counts=True)
    shared = count > 1
    renumber = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column, width = owner[keep], renumber[column[keep]], int(shared.sum())
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, width, 2048):
        i, j = np.searchsorted(column, [lo, lo + 2048])
        block = np.zeros((len(sets), min(2048, width - lo)), np.float32)
        block[owner[i:j], column[i:j] - lo] = 1
        total += block @ block.T
    return total[a, b].astype(np.int64)


def linked_pairs(sets: list[np.ndarray], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets with 100 * intersection >= 80 * union, by bound and verification; with ``side``, pairs across sides only."""
    sizes = np.array([len(s) for s in sets], np.int64)
    a, b = candidate_pairs(sizes, [count_vector(s) for s in sets])
    if side is not None:
        across = side[a] != side[b]
        a, b = a[across], b[across]
    if not len(a):
        return a, b
    common = overlaps(sets, a, b)
    ok = 9 * common >= 4 * (sizes[a] + sizes[b])
    return a[ok], b[ok]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each element's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
