"""Sequential algorithms on one component at a time, with explicit stacks.

The unit of parallelism is the connected component. A component is bounded by ``max_edges``
(``Settings.max_kernel_edges``); a larger one is refused by name rather than read into one task.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.errors import LimitExceededError
from weft.runtime import materialize, ship
from weft.settings import DEFAULTS

Edges = list[tuple[int, int]]


def per_component(rows: DataFrame, kernel: Callable[[int, Edges], Iterator[tuple]], schema: str, max_edges: int | None = None) -> DataFrame:
    """Run ``kernel(component, sorted (a, b) pairs)`` on each component of ``rows(component, a, b)``."""
    ship(rows.sparkSession)
    limit = DEFAULTS.max_kernel_edges if max_edges is None else max_edges
    rows = materialize(rows.select("component", "a", "b"), "component-edges")
    large = rows.groupBy("component").count().filter(F.col("count") > limit).limit(1).collect()
    if large:
        raise LimitExceededError(f"component {large[0]['component']} has {large[0]['count']} edges; the limit of this operator is {limit}")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = sorted(zip(pdf["a"].tolist(), pdf["b"].tolist()))
        return pd.DataFrame(list(kernel(key[0], pairs)), columns=names)

    return rows.groupBy("component").applyInPandas(run, schema)


def neighbours(pairs: Edges, both: bool = True) -> dict[int, list[int]]:
    out: dict[int, set[int]] = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
        if both:
            out[b].add(a)
    return {a: sorted(x) for a, x in out.items()}


def dfs_kernel(start: int):
    def run(_component: int, pairs: Edges):
        out = neighbours(pairs, False)
        seen, seq = {start}, 0
        stack = [(start, iter(out.get(start, ())))]
        yield seq, start, "enter"
        while stack:
            node, rest = stack[-1]
            child = next((c for c in rest if c not in seen), None)
            seq += 1
            if child is None:
                stack.pop()
                yield seq, node, "exit"
            else:
                seen.add(child)
                stack.append((child, iter(out.get(child, ()))))
                yield seq, child, "enter"

    return run


def cycle_kernel(component: int, pairs: Edges):
    """One cycle: the shortest way back to the smallest node of a strongly connected part."""
    out = neighbours(pairs, False)
    first = min(out)
    if len(out) == 1 or first in out[first]:
        if first in out[first]:
            yield component, 0, first
            return
    via, queue = {first: None}, deque([first])
    while queue:
        node = queue.popleft()
        for b in out.get(node, ()):
            if b == first:
                path = []
                while node is not None:
                    path.append(node)
                    node = via[node]
                for at, a in enumerate(reversed(path)):
                    yield component, at, a
                return
            if b not in via:
                via[b] = node
                queue.append(b)


def low_links(pairs: Edges) -> tuple[Edges, set[int]]:
    """Bridges and articulation points of a connected undirected graph; parallel edges matter."""
    count: dict[tuple[int, int], int] = defaultdict(int)
    for a, b in pairs:
        if a != b:
            count[min(a, b), max(a, b)] += 1
    near = neighbours([p for p in count])
    bridges, points = [], set()
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, children = [(root, -1, iter(near[root]))], 0
        while stack:
            node, parent, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if low[node] > order[up] and count[min(up, node), max(up, node)] == 1:
                        bridges.append((up, node))
                    if up != root and low[node] >= order[up]:
                        points.add(up)
            elif child not in order:
                children += node == root
                order[child] = low[child] = len(order)
                stack.append((child, node, iter(near[child])))
            elif child != parent:
                low[node] = min(low[node], order[child])
        if children > 1:
            points.add(root)
    return bridges, points


def bridge_kernel(_component: int, pairs: Edges):
    stored = set(pairs)
    for a, b in low_links(pairs)[0]:
        yield (a, b) if (a, b) in stored else (b, a)


def articulation_kernel(_component: int, pairs: Edges):
    for a in sorted(low_links(pairs)[1]):
        yield (a,)


def matching_kernel(_component: int, pairs: Edges):
    """A maximum matching: augmenting paths with contracted blossoms."""
    near = neighbours([(a, b) for a, b in pairs if a != b])
    nodes = sorted(near)
    mate: dict[int, int | None] = dict.fromkeys(nodes)
    for root in nodes:
        if mate[root] is not None:
            continue
        parent: dict[int, int] = {}
        base = {v: v for v in nodes}
        used, queue, end = {root}, deque([root]), None

        def common(a, b):
            marked = set()
            while True:
                a = base[a]
                marked.add(a)
                if mate[a] is None:
                    break
                a = parent[mate[a]]
            while True:
                b = base[b]
                if b in marked:
                    return b
                b = parent[mate[b]]

        def mark(v, stem, child, inside):
            while base[v] != stem:
                inside |= {base[v], base[mate[v]]}
                parent[v] = child
                child = mate[v]
                v = parent[mate[v]]

        while queue and end is None:
            v = queue.popleft()
            for w in near[v]:
                if base[v] == base[w] or mate[v] == w:
                    continue
                if w == root or (mate[w] is not None and mate[w] in parent):
                    stem, inside = common(v, w), set()
                    mark(v, stem, w, inside)
                    mark(w, stem, v, inside)
                    for u in nodes:
                        if base[u] in inside:
                            base[u] = stem
                            if u not in used:
                                used.add(u)
                                queue.append(u)
                elif w not in parent:
                    parent[w] = v
                    if mate[w] is None:
                        end = w
                        break
                    used.add(mate[w])
                    queue.append(mate[w])
        while end is not None:
            v = parent[end]
            after = mate[v]
            mate[end], mate[v] = v, end
            end = after
    for a in nodes:
        if mate[a] is not None and a < mate[a]:
            yield a, mate[a]


def clique_kernel(limit: int):
    """Maximal cliques whose smallest node in degree order is the group's; pivoted, with a stack."""

    def run(component: int, pairs: Edges):
        near = {a: set(x) for a, x in neighbours([p for p in pairs if p[0] != p[1]]).items()}
        alone = sorted({a for p in pairs for a in p} - set(near))
        made = 0
        for a in alone:
            yield component, made, a
            made += 1
        rank = {a: k for k, a in enumerate(sorted(near, key=lambda a: (len(near[a]), a)))}
        for v in sorted(near, key=rank.get):
            stack = [([v], {u for u in near[v] if rank[u] > rank[v]}, {u for u in near[v] if rank[u] < rank[v]})]
            while stack:
                clique, may, out = stack.pop()
                if not may and not out:
                    for a in clique:
                        yield component, made, a
                    made += 1
                    if made >= limit:
                        return
                    continue
                pivot = max(may | out, key=lambda u: (len(may & near[u]), -u))
                for u in sorted(may - near[pivot]):
                    stack.append(([*clique, u], may & near[u], out & near[u]))
                    may = may - {u}
                    out = out | {u}

    return run


def louvain_kernel(component: int, pairs: list[tuple[int, int, float]]):
    """Greedy modularity moves in node order until none gains, then contraction, and again. Of equal
    gains the smaller community wins. As the contraction drops weight inside communities, degrees
    keep it."""
    weight: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in pairs:
        weight[a][b] += w
        if a != b:
            weight[b][a] += w
    nodes = sorted(weight)
    degree = {a: sum(weight[a].values()) for a in nodes}
    total = sum(degree.values()) / 2
    member = {a: a for a in nodes}
    if total <= 0:
        for a in nodes:
            yield a, a
        return
    graph, strength = {a: dict(weight[a]) for a in nodes}, dict(degree)
    while True:
        group = {a: a for a in graph}
        size = dict(strength)
        moved_any = False
        moved = True
        while moved:
            moved = False
            for a in sorted(graph):
                near: dict[int, float] = defaultdict(float)
                for b, w in graph[a].items():
                    if b != a:
                        near[group[b]] += w
                own = group[a]
                size[own] -= strength[a]
                stay = near.get(own, 0.0) - strength[a] * size[own] / (2 * total)
                best, gain = own, 0.0
                for c in sorted(near):
                    g = near[c] - strength[a] * size.get(c, 0.0) / (2 * total) - stay
                    if c != own and g > gain + 1e-12:
                        best, gain = c, g
                size[best] = size.get(best, 0.0) + strength[a]
                if best != own:
                    group[a] = best
                    moved = moved_any = True
        if not moved_any:
            break
        member = {a: group[c] for a, c in member.items()}
        merged: dict[int, dict[int, float]] = {c: defaultdict(float) for c in set(group.values())}
        heavy: dict[int, float] = defaultdict(float)
        for a, x in graph.items():
            heavy[group[a]] += strength[a]
            for b, w in x.items():
                if group[a] != group[b]:
                    merged[group[a]][group[b]] += w
        graph, strength = {c: dict(x) for c, x in merged.items()}, dict(heavy)
    first: dict[int, int] = {}
    for a in nodes:
        first.setdefault(member[a], a)
    for a in nodes:
        yield a, first[member[a]]
