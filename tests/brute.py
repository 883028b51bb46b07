"""Direct, dense answers on small grids, to hold the Spark operators against."""

import itertools

AROUND = [o for o in itertools.product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]


def add(a, b):
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2])


def ball(r):
    n = range(-r, r + 1)
    return [o for o in itertools.product(n, repeat=3) if sum(x * x for x in o) <= r * r]


def within(mask, r):
    """Every voxel within r of the mask."""
    return {add(m, o) for m in mask for o in ball(r)}


def flood(cells):
    """Components in raster order."""
    left, out = set(cells), []
    for start in sorted(cells):
        if start not in left:
            continue
        left.discard(start)
        comp, stack = {start}, [start]
        while stack:
            c = stack.pop()
            for o in AROUND:
                n = add(c, o)
                if n in left:
                    left.discard(n)
                    comp.add(n)
                    stack.append(n)
        out.append(comp)
    return out


def faces(cells, times, shape):
    out = set(cells)
    for _ in range(times):
        out |= {add(c, o) for c in out for o in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))}
        out = {c for c in out if all(0 <= c[n] < shape[n] for n in range(3))}
    return out


class Room:
    """A floor at z = 0 of the grid; the height of a voxel is its k + 0.5."""

    def __init__(self, shape, states, p):
        self.shape, self.p = shape, p
        self.occ = [set(s) for s in states]
        self.objects, self.live, self.labels = [], {}, []
        for ci in range(len(states)):
            if ci:
                self.step(ci)
            self.label(ci)

    def height(self, c):
        return c[2] + 0.5

    def blobs(self, changed, seen_from):
        grown = {c for c in {add(c, o) for c in changed for o in AROUND + [(0, 0, 0)]} if all(0 <= c[n] < self.shape[n] for n in range(3))}
        near = within(seen_from, self.p.coverage_voxels)
        for comp in flood(grown):
            core = comp & changed
            if len(core) < self.p.min_voxels or len(core & near) < self.p.coverage_frac * len(core):
                continue
            yield comp, core

    def step(self, ci):
        p, a, b = self.p, self.occ[ci - 1], self.occ[ci]
        up = lambda s: {c for c in s if self.height(c) > p.floor_band_voxels}
        added = up(b) - within(up(a), p.jitter_voxels)
        removed = up(a) - within(up(b), p.jitter_voxels)
        near_now = within(b, p.jitter_voxels)
        closed, opened = [], []
        for m, core in list(self.blobs(removed, b)):
            hit = [i for i, g in self.live.items() if len(g & m) > 0.2 * min(len(m), len(g))]
            for i in hit:
                self.live[i] = (self.live[i] - m) & near_now
                if len(self.live[i]) / self.objects[i]["voxels"] < 0.3:
                    self.objects[i]["removed_in"] = ci
                    del self.live[i]
                    closed.append(i)
            if hit:
                continue
            since = ci - 1
            while since > 0 and len(core & self.occ[since - 1]) / len(core) >= 0.5:
                since -= 1
            i = self.open(m, since, ci, list(range(since, ci)))
            self.backfill(i, m, since, ci)
            closed.append(i)
        for m, core in list(self.blobs(added, a)):
            i = self.open(m, ci, None, [ci])
            self.live[i] = m
            opened.append(i)
        size = lambda i: self.objects[i]["voxels"]
        used = set()
        for _, r, n in sorted((abs(size(n) - size(r)) / size(r), r, n) for r in closed for n in opened if abs(size(n) - size(r)) <= 0.3 * size(r)):
            if not {("r", r), ("n", n)} & used:
                used |= {("r", r), ("n", n)}
                self.objects[r]["moved_to"], self.objects[n]["moved_from"] = n, r
        for i in self.live:
            if ci not in self.objects[i]["present"]:
                self.objects[i]["present"].append(ci)

    def open(self, m, since, until, present):
        self.objects.append({"id": len(self.objects), "added_in": since, "removed_in": until, "present": present, "voxels": len(m), "moved_from": None, "moved_to": None})
        return len(self.objects) - 1

    def reach(self, seed, growable, blocked):
        support = set(seed)
        for comp in flood(growable):
            if comp & seed:
                support |= comp
        return support | (faces(support, self.p.label_dilate_voxels, self.shape) - blocked)

    def backfill(self, i, blob, since, until):
        static = within(self.occ[until], 1)
        for cj in range(since, until):
            blocked = static | set(self.labels[cj])
            growable = {c for c in self.occ[cj] if self.height(c) > 0.5} - blocked
            for c in self.reach(blob, growable, blocked):
                self.labels[cj].setdefault(c, i)

    def label(self, ci):
        lab = {}
        stood = within(self.occ[ci - 1], 1) if ci else set()
        before = self.labels[ci - 1] if ci else {}
        base = {c for c in self.occ[ci] if self.height(c) > 0.5}
        seeds = set().union(*self.live.values()) if self.live else set()
        for i, g in self.live.items():
            blocked = {c for c in stood if before.get(c) != i} | (seeds - g)
            for c in self.reach(g, base - blocked, blocked):
                lab.setdefault(c, i)
        self.labels.append(lab)
