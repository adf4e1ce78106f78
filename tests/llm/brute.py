"""Plain versions of the corpus operators, one document or pair at a time, for small inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillsift.llm import line_dedup, mixing, packing, simhash
from quillsift.llm.common import text_buffer


def near_groups(rows: list[tuple[int | None, str | None]], radius: int = simhash.RADIUS) -> dict[int, int]:
    """doc_id -> the smallest of its group, over all pairs of signatures."""
    known = [(i, t) for i, t in rows if i is not None]
    hi, lo, some = simhash.signatures(*text_buffer(pa.array([None if t is None else t.lower() for _, t in known], pa.string())))
    parent = {i: i for i, _ in known}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = np.flatnonzero(some)
    for x in at:
        far = np.bitwise_count(hi[at] ^ hi[x]).astype(int) + np.bitwise_count(lo[at] ^ lo[x])
        for y in at[far <= radius]:
            a, b = sorted((root(known[x][0]), root(known[y][0])))
            parent[b] = a
    return {i: root(i) for i, _ in known}


def line_stage(rows: list[tuple], min_chars: int = line_dedup.MIN_CHARS, copy_share: float = line_dedup.COPY_SHARE) -> list[tuple]:
    """The (doc_id, text) that the line dedup stage keeps, with the text left; ids are unique or null."""
    lines = lambda t: [] if t is None else t.split("\n")
    key = lambda x: x.strip(" ").lower()
    long = lambda x: len(x.strip(" ")) >= min_chars
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    first, size, count, short_first = {}, {}, {}, {}
    for i, t in known:
        size[i] = sum(len(x.strip(" ")) for x in lines(t) if long(x))
        for x in lines(t):
            if long(x):
                first.setdefault(key(x), i)
                count[key(x)] = count.get(key(x), 0) + 1
            elif x.strip(" \t\r\f\v"):
                short_first.setdefault(key(x), i)
    out = []
    for i, t in rows:
        if i is None or t is None:
            out.append((i, t))
            continue
        kept, held, seen, went, n_long = [], {}, set(), 0, 0
        for x in lines(t):
            n_long += long(x)
            if long(x) and count[key(x)] > 1 and (first[key(x)] != i or key(x) in seen):
                went += 1
                if first[key(x)] != i:
                    held[first[key(x)]] = held.get(first[key(x)], 0) + len(x.strip(" "))
                continue
            if long(x):
                seen.add(key(x))
            kept.append(x)
        if went and went == n_long:
            if any(short_first.get(key(x)) == i for x in lines(t) if not long(x)):
                out.append((i, "\n".join(kept)))
        elif any(n >= copy_share * max(size[i], size[h]) for h, n in held.items()):
            out.append((i, t))
        else:
            out.append((i, "\n".join(kept)))
    return out


def best_fit(pieces: list[tuple], capacity: int) -> dict[tuple, tuple[int, int]]:
    """(key) -> (window, offset) by scanning all open windows; pieces are (length, order, key)."""
    used: list[int] = []
    out = {}
    for length, _, key in sorted(pieces, key=lambda p: (-p[0], p[1])):
        fits = [(capacity - u, w) for w, u in enumerate(used) if capacity - u >= length]
        window = min(fits)[1] if fits else len(used)
        if not fits:
            used.append(0)
        out[key] = (window, used[window])
        used[window] += length
    return out


def pieces_of(doc_id, text: str | None, capacity: int) -> list[tuple[int, int]]:
    """(piece, length) of a document: full windows, then the rest."""
    n = len((text or "").split())
    return [(k, min(capacity, n - k * capacity)) for k in range(-(-n // capacity))]


def interleave(rows: list[tuple], weights: dict | None = None, block: int = mixing.BLOCK, units: int = mixing.UNITS) -> dict:
    """key -> (slot, in mix), by simulating the schedule slot by slot; rows are (source, order, key)."""
    counts: dict = {}
    for source, _, _ in rows:
        counts[source] = counts.get(source, 0) + 1
    tasks = mixing.apportion(counts, weights, units)
    every, out, place = sum(u for _, u in tasks), {}, {}
    queues = []
    for sources, _ in tasks:
        own = sorted((r for r in rows if r[0] in sources), key=lambda r: r[1])
        queues.append([own[i : i + block] for i in range(0, len(own), block)])
    done, open_, t = [0] * len(tasks), True, 0
    while any(d < len(q) for d, q in zip(done, queues)):
        ready = [(-(-(done[i] + 1) * every // u), i) for i, (_, u) in enumerate(tasks) if done[i] * every // u <= t]
        _, i = min(ready)
        if done[i] >= len(queues[i]):
            open_ = False
        else:
            for r in queues[i][done[i]]:
                place[r[2]] = (t, open_)
        done[i] += 1
        t += 1
    for _, _, key in rows:
        out[key] = place.get(key, (None, False))
    return out
