"""Which segments to merge: a pure plan over their sizes."""

from __future__ import annotations

from collections.abc import Sequence


def plan(sizes: Sequence[int], least: int) -> list[list[int]]:
    """Groups of neighbouring segments to merge, as positions.

    From the first segment below ``least`` on, neighbours join a group until it holds
    ``least`` documents; what is left over is a group too.  A group of one is left alone,
    and segments before the first small one are not touched.
    """
    start = next((i for i, n in enumerate(sizes) if n < least), len(sizes))
    groups, now, held = [], [], 0
    for i in range(start, len(sizes)):
        now.append(i)
        held += sizes[i]
        if held >= least:
            groups.append(now)
            now, held = [], 0
    if now:
        groups.append(now)
    return [g for g in groups if len(g) > 1]


def recent(sizes: Sequence[int], ratio: int = 4) -> list[int]:
    """The last segments, as positions, as far back as none is over ``ratio`` times those after it together.

    Merging these whenever there are many rewrites a document a logarithmic number of times.
    """
    at, held = len(sizes) - 1, sizes[-1] if sizes else 0
    while at > 0 and sizes[at - 1] <= ratio * held:
        at -= 1
        held += sizes[at]
    return list(range(at, len(sizes))) if 0 <= at < len(sizes) - 1 else []


def intervals(ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(a: int, b: int, ranges: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a range outside of others."""
    out = []
    for x, y in intervals(ranges):
        if y > a and x < b:
            if a < x:
                out.append((a, x))
            a = max(a, y)
    return [*out, (a, b)] if a < b else out
