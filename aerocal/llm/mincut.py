"""Two-label assignment of least cost on a sparse graph, by maximum flow."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable


def keep_side(gain: list[int], edges: Iterable[tuple[int, int, int]]) -> list[bool]:
    """Labels (True: keep) that minimise dropped gain plus kept loss plus the weights of cut edges.

    ``gain[i]`` is the cost of dropping node ``i`` less the cost of keeping it. ``edges`` are
    (i, j, weight) with positive integer weights. Of several optima the one that keeps most is
    returned: it is unique, as kept sides of minimum cuts are closed under union.

    A node whose gain outweighs all its edges has the same label in that optimum whatever its
    neighbours do; such nodes are settled first and their edges become gains of the neighbours. The
    rest is cut by Dinic's blocking flows.
    """
    gain = list(gain)
    around: list[dict[int, int]] = [{} for _ in gain]
    for i, j, weight in edges:
        if i != j:
            around[i][j] = around[i].get(j, 0) + weight
            around[j][i] = around[j].get(i, 0) + weight
    tie = [sum(x.values()) for x in around]
    label: list[bool | None] = [None] * len(gain)
    queue = deque(range(len(gain)))
    while queue:
        i = queue.popleft()
        if label[i] is not None or -tie[i] <= gain[i] < tie[i]:
            continue
        label[i] = gain[i] >= tie[i]
        for j, weight in around[i].items():
            if label[j] is None:
                gain[j] += weight if label[i] else -weight
                tie[j] -= weight
                queue.append(j)
    left = [i for i, x in enumerate(label) if x is None]
    if left:
        for i, kept in zip(left, _cut(left, gain, around, label)):
            label[i] = kept
    return label


def _cut(left: list[int], gain: list[int], around: list[dict[int, int]], label: list) -> list[bool]:
    """Dinic's algorithm over the unsettled nodes; dropped are those that still reach the sink."""
    number = {i: n for n, i in enumerate(left)}
    size, source, sink = len(left) + 2, len(left), len(left) + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(size)]

    def arc(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i in left:
        if gain[i] > 0:
            arc(source, number[i], gain[i], 0)
        elif gain[i] < 0:
            arc(number[i], sink, -gain[i], 0)
        for j, weight in around[i].items():
            if i < j and label[j] is None:
                arc(number[i], number[j], weight, weight)
    while True:
        # distance to the sink over arcs with room
        far = [-1] * size
        far[sink] = 0
        queue = deque([sink])
        while queue:
            b = queue.popleft()
            for e in out[b]:
                a = to[e]
                if far[a] < 0 and room[e ^ 1]:
                    far[a] = far[b] + 1
                    queue.append(a)
        if far[source] < 0:
            return [far[n] < 0 for n in range(len(left))]
        at = [0] * size
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                push = min(room[e] for e in path)
                cut = len(path)
                for n in range(len(path) - 1, -1, -1):
                    room[path[n]] -= push
                    room[path[n] ^ 1] += push
                    if not room[path[n]]:
                        cut = n
                node = to[path[cut] ^ 1]
                del path[cut:]
                continue
            arcs = out[node]
            while at[node] < len(arcs):
                e = arcs[at[node]]
                if room[e] and far[to[e]] == far[node] - 1:
                    break
                at[node] += 1
            if at[node] < len(arcs):
                path.append(e)
                node = to[e]
            elif path:
                node = to[path.pop() ^ 1]
                at[node] += 1
            else:
                break
