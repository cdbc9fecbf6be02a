"""A static R-tree over boxes, bulk-loaded sort-tile-recursive, probed in whole arrays."""

from __future__ import annotations

import numpy as np

FANOUT = 16
#: Pairs a probe looks at together, about.
MOST_PAIRS = 1_000_000


class RTree:
    """Boxes ``x0, y0, x1, y1`` (closed). ``pairs`` gives every (probe, box) that meet."""

    def __init__(self, x0, y0, x1, y1):
        n = len(x0)
        self.n = n
        if not n:
            return
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        tiles = max(1, int(np.ceil(np.sqrt(n / FANOUT))))
        by_x = np.argsort(cx, kind="stable")
        tile = np.empty(n, np.int64)
        tile[by_x] = np.arange(n) * tiles // n
        self.order = np.lexsort((cy, tile))
        level = tuple(a[self.order] for a in (x0, y0, x1, y1))
        self.levels = [level]
        while len(level[0]) > FANOUT:
            at = np.arange(0, len(level[0]), FANOUT)
            level = (np.minimum.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)

    def pairs(self, qx0, qy0, qx1, qy1, block: int = 4096, most: int = MOST_PAIRS):
        """Yields arrays (probe, box), for at most ``block`` probes at a time.

        Where the boxes met by a block of probes are more than ``most``, it is halved, so what is
        held at once is bounded however many boxes lie on one spot. All boxes of a probe are in one array.
        """
        if not self.n:
            return
        top = len(self.levels[-1][0])
        for lo in range(0, len(qx0), block):
            q = np.arange(lo, min(lo + block, len(qx0)))
            todo = [(np.repeat(q, top), np.tile(np.arange(top), len(q)), len(self.levels) - 1)]
            while todo:
                probe, node, depth = todo.pop()
                x0, y0, x1, y1 = self.levels[depth]
                hit = (x0[node] <= qx1[probe]) & (x1[node] >= qx0[probe]) & (y0[node] <= qy1[probe]) & (y1[node] >= qy0[probe])
                probe, node = probe[hit], node[hit]
                if not len(probe):
                    continue
                if not depth:
                    yield probe, self.order[node]
                    continue
                if len(probe) * FANOUT > most and probe[0] != probe[-1]:
                    middle = probe[len(probe) // 2]
                    cut = np.searchsorted(probe, middle, side="left" if middle != probe[0] else "right")
                    todo += [(probe[part], node[part], depth) for part in (slice(cut, None), slice(cut))]
                    continue
                below = len(self.levels[depth - 1][0])
                probe = np.repeat(probe, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                there = node < below
                todo.append((probe[there], node[there], depth - 1))
