"""Clip regions: the infinite region is None, any other a list of shapes that are intersected.

A shape is a list of path commands with a fill rule. ``simple`` says that it covers no point
twice, so that it may be joined with another under the even-odd rule without changing meaning.
Every combination returns the region and whether it is exact.
"""

from __future__ import annotations

from typing import NamedTuple

from ..constants import CLIP_HUGE

Command = tuple[str, list[float]]


class Shape(NamedTuple):
    cmds: list[Command]
    rule: str = "nonzero"
    simple: bool = True


Region = list[Shape] | None


def quad(points) -> list[Command]:
    (a, *rest) = points
    return [("M", list(a)), *[("L", list(p)) for p in rest], ("Z", [])]


def rect(l: float, t: float, r: float, b: float) -> Shape:  # noqa: E741
    return Shape(quad([(l, t), (r, t), (r, b), (l, b)]))


def rects(boxes) -> Shape:
    return Shape([c for x in boxes for c in rect(*x).cmds], simple=len(boxes) < 2)


def empty() -> Shape:
    return rect(0, 0, 0, 0)


def infinite() -> Shape:
    return rect(-CLIP_HUGE, -CLIP_HUGE, CLIP_HUGE, CLIP_HUGE)


def translate(region: Region, dx: float, dy: float) -> Region:
    move = lambda p: [v + (dy if i % 2 else dx) for i, v in enumerate(p)]
    return region and [s._replace(cmds=[(c, move(p)) for c, p in s.cmds]) for s in region]


def composable(s: Shape) -> bool:
    return s.simple and s.rule == "nonzero"


def inverse(s: Shape) -> Shape:
    return Shape(infinite().cmds + s.cmds, "evenodd", False)


def combine(current: Region, shape: Shape, op: str) -> tuple[Region, bool]:
    """One shape into a region. Where a shape can't be inverted, intersecting with it stands for leaving it out."""
    own, plain = current or [], composable(shape)
    alone = len(own) == 1 and composable(own[0])
    outside = [*own, inverse(shape) if plain else shape]
    joined = lambda rule: [Shape(own[0].cmds + shape.cmds, rule, False)]
    everywhere, both = current is None, alone and plain
    cases = {
        "replace": lambda: ([shape], True),
        "intersect": lambda: ([*own, shape], True),
        "exclude": lambda: (outside, plain),
        # Figures wound in opposite directions could cancel, so a union is never called exact.
        "union": lambda: (None, True) if everywhere else (joined("nonzero") if both else current, False),
        "xor": lambda: (outside, plain) if everywhere else (joined("evenodd"), True) if both else (outside, False),
        "complement": lambda: ([empty()], True) if everywhere else ([shape, inverse(own[0])], True) if alone else ([shape], False),
    }
    return cases[op]()


def combine_regions(current: Region, other: Region, op: str) -> tuple[Region, bool]:
    """The same for a region that is infinite or has several shapes."""
    if op == "replace":
        return other, True
    if other is not None and len(other) == 1:
        return combine(current, other[0], op)
    if other is None:
        if op == "intersect":
            return current, True
        if op == "union":
            return None, True
        if op == "exclude" or current is None:
            return [empty()], True
        return combine(None, current[0], "exclude") if len(current) == 1 else (current, False)
    if op == "intersect":
        return [*(current or []), *other], True
    if op == "complement":
        if current is None:
            return [empty()], True
        return combine(other, current[0], "exclude") if len(current) == 1 else (other, False)
    return (other if op == "xor" and current is None else current), False


def flatten(cmds: list[Command], steps: int = 12) -> list[list[tuple[float, float]]]:
    """Commands to polygons; curves in ``steps`` pieces."""
    import math

    out: list[list[tuple[float, float]]] = []
    for c, p in cmds:
        if c == "M":
            out.append([(p[0], p[1])])
        elif c == "R":
            out.append([(p[0], p[1]), (p[0] + p[2], p[1]), (p[0] + p[2], p[1] + p[3]), (p[0], p[1] + p[3]), (p[0], p[1])])
        elif c == "A":
            cx, cy, rx, ry, a, b = p[:6]
            n = max(2, int(steps * abs(b - a) / (math.pi / 2)) + 1)
            arc = [(cx + rx * math.cos(a + (b - a) * i / n), cy + ry * math.sin(a + (b - a) * i / n)) for i in range(n + 1)]
            if out and c == "A" and len(p) > 6 and p[6]:  # joined to what precedes it
                out[-1] += arc
            else:
                out.append(arc)
        elif not out:
            out.append([(p[-2], p[-1])] if p else [])
        elif c == "L":
            out[-1].append((p[0], p[1]))
        elif c == "C":
            x0, y0 = out[-1][-1]
            for i in range(1, steps + 1):
                t, u = i / steps, 1 - i / steps
                out[-1].append(tuple(u**3 * o + 3 * u * u * t * p[k] + 3 * u * t * t * p[k + 2] + t**3 * p[k + 4] for k, o in ((0, x0), (1, y0))))
        elif c == "Z" and out[-1]:
            first = out[-1][0]
            out[-1].append(first)
            out.append([first])
    return [q for q in out if len(q) > 1]


def contains(region: Region, x: float, y: float) -> bool:
    """Whether a point lies in every shape."""
    for s in region or []:
        winding = crossings = 0
        for poly in flatten(s.cmds):
            for (x0, y0), (x1, y1) in zip(poly, [*poly[1:], poly[0]], strict=True):
                if (y0 <= y) != (y1 <= y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
                    winding += 1 if y1 > y0 else -1
                    crossings += 1
        if not (crossings % 2 if s.rule == "evenodd" else winding):
            return False
    return True
