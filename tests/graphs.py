"""Small fixture graphs and plain-Python answers to compare the Spark jobs with."""

import itertools
import random

# Classes of vertices with equal neighbours: all of one class link to all of another.
CLASSES = [(1, 2), (3, 4, 5), (6,), (7, 8, 9), (10, 11)]
BLOWN_UP = [(a, b) for i, j in [(0, 1), (1, 2), (2, 3), (2, 4), (3, 2)] for a in CLASSES[i] for b in CLASSES[j]]

# A chain 20 - 21 - 22 - 23 with three leaves at one end and two at the other, both ways.
_LINKS = [(20, 21), (21, 22), (22, 23), (20, 24), (20, 25), (20, 26), (23, 27), (23, 28)]
CHAIN = _LINKS + [(b, a) for a, b in _LINKS]

# Out-degrees fall along 1 - 2 - 6 - 8.
FALLING = [(1, 2), (1, 3), (1, 4), (1, 5), (2, 6), (2, 7), (2, 9), (6, 8), (6, 9)]


def random_edges(n, m, seed, hub=0.0):
    """``m`` distinct directed edges over ``n`` vertices, a share of them at vertex 0."""
    rng = random.Random(seed)
    edges = set()
    while len(edges) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if rng.random() < hub:
            a, b = (0, b) if rng.random() < 0.5 else (a, 0)
        if a != b:
            edges.add((a, b))
    return sorted(edges)


def ids(edges):
    return sorted({v for e in edges for v in e})


def shortest(edges, landmark):
    """{vertex: path after it up to the landmark}, lexicographically least per length."""
    into = {}
    for s, d in edges:
        into.setdefault(d, []).append(s)
    paths = {landmark: []}
    frontier = {landmark: []}
    while frontier:
        reached = {}
        for v, path in frontier.items():
            for u in into.get(v, []):
                if u not in paths:
                    longer = [v, *path]
                    reached[u] = min(reached.get(u, longer), longer)
        paths.update(reached)
        frontier = reached
    return paths


def kruskal(edges):
    """Forest of (src, dst, weight) rows, ordered by (weight, least end, greatest end)."""
    best = {}
    for s, d, w in edges:
        if s != d:
            key = (min(s, d), max(s, d))
            best[key] = min(best.get(key, (w, s)), (w, s))
    root = {v: v for key in best for v in key}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    forest = set()
    for w, a, b, src in sorted((w, a, b, s) for (a, b), (w, s) in best.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            forest.add((src, b if src == a else a, w))
    return forest


def components(vertices, edges):
    root = {v: v for v in vertices}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


def attach(vertices, edges, backbone, levels):
    lines = {v: [v] for v in backbone}
    frontier = dict(lines)
    while frontier:
        parents = {}
        for s, d in edges:
            if d in frontier and s not in lines:
                parents[s] = min(parents.get(s, d), d)
        frontier = {v: [*lines[p], v] for v, p in parents.items()}
        lines.update(frontier)
    keys = {}
    for v in vertices:
        line = lines.get(v, [v])
        keys[v] = (line + [v] * levels)[:levels]
    return keys, {v for v, line in lines.items() if len(line) > 1}


def path_vertices(pairs, paths):
    points = set()
    for s, landmark in pairs:
        points |= {s, *paths[landmark][s]}
    return points


def keep_one(edges, min_out_degree, levels):
    out = {}
    for s, _ in edges:
        out[s] = out.get(s, 0) + 1
    important = {v for v, n in out.items() if n > min_out_degree}
    paths = {t: shortest(edges, t) for t in important}
    closure = [(s, t, len(paths[t][s])) for t in important for s in important if s != t and s in paths[t]]
    forest = kruskal(closure)
    backbone = important | path_vertices([(s, t) for s, t, _ in forest], paths)
    return attach(ids(edges), edges, backbone, levels)[0]


def keep_all(edges, important, levels):
    paths = {t: shortest(edges, t) for t in important}
    pairs = [(s, t) for t in important for s in important if s != t and s in paths[t]]
    backbone = set(important) | path_vertices(pairs, paths)
    keys, attached = attach(ids(edges), edges, backbone, levels)
    return {v: k for v, k in keys.items() if v in attached}


def seed_labels(edges, levels, level_size):
    vertices = ids(edges)
    keys = {v: [-1] * levels for v in vertices}
    for level in range(levels):
        label = {v: v for v in vertices if level * level_size <= v < (level + 1) * level_size}
        frontier = dict(label)
        while frontier:
            reached = {}
            for s, d in edges:
                if s in frontier and d not in label:
                    reached[d] = min(reached.get(d, frontier[s]), frontier[s])
            label.update(reached)
            frontier = reached
        for v, seed in label.items():
            keys[v][level] = seed
    return {v: k for v, k in keys.items() if len(set(k)) > 1}


def degree_hierarchy(edges, levels):
    out = {v: 0 for v in ids(edges)}
    for s, _ in edges:
        out[s] += 1
    parent = {}
    for s, d in edges:
        if out[s] > out[d]:
            parent[d] = min(parent.get(d, (-out[s], s)), (-out[s], s))
    keys = {}
    for v in out:
        line = [v]
        while line[0] in parent:
            line.insert(0, parent[line[0]][1])
        keys[v] = (line[-levels:] + [v] * levels)[:levels]
    return keys


def neighbor_sets(edges, symmetric):
    if symmetric:
        edges = {*edges, *((b, a) for a, b in edges)}
    sets = {v: (set(), set()) for v in ids(edges)}
    for s, d in edges:
        sets[s][0].add(d)
        sets[d][1].add(s)
    return sets


def structural(edges):
    sets = neighbor_sets(edges, False)
    least = {}
    for v in sorted(sets):
        least.setdefault((frozenset(sets[v][0]), frozenset(sets[v][1])), v)
    return {v: least[frozenset(o), frozenset(i)] for v, (o, i) in sets.items()}


def fuzzy(edges, threshold, mode="plain", symmetric=True):
    """Neighbourhood by neighbourhood: prune its list to maximal entries, then compare."""
    sets = neighbor_sets(edges, symmetric)
    size = {v: len(o) + len(i) for v, (o, i) in sets.items()}
    around = {v: o | i for v, (o, i) in sets.items()}
    best = {}
    for c in sets:
        kept = []
        for x in sorted(around[c], key=lambda v: (-size[v], v)):
            if not any(sets[x][0] <= sets[y][0] and sets[x][1] <= sets[y][1] for y in kept):
                kept.append(x)
        for d, x in itertools.product(around[c], kept):
            if d == x:
                continue
            total = 0.0
            for a, b in zip(sets[d], sets[x], strict=True):
                total += len(a & b) / len(a | b) if a | b else 1.0
            inside = all(a <= b for a, b in zip(sets[d], sets[x], strict=True))
            if total >= threshold and (mode == "plain" or inside):
                best[d] = min(best.get(d, (-size[x], x)), (-size[x], x))
    return {v: best[v][1] if v in best else v for v in sets}


def fuzzy_schedule(edges, thresholds, levels, mode="plain", symmetric=True):
    """Pass by pass: everybody takes over the start of the chosen vertex's key of the pass before."""
    keys = {v: [v] * levels for v in neighbor_sets(edges, symmetric)}
    for threshold in thresholds:
        chosen = fuzzy(edges, threshold, mode, symmetric)
        before = keys
        keys = {}
        for v, own in before.items():
            parent = before[chosen[v]]
            used = 1 + sum(a != b for a, b in zip(parent, parent[1:]))
            keys[v] = own if chosen[v] == v else parent[:used] + own[used:]
    return keys
