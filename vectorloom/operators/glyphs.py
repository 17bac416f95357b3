"""A built-in stroke font, as a host's fonts aren't at hand where files are rendered.

A glyph is a choice among sixteen strokes of a cell, as on segment displays; lower case is the
same shape, lower. Every character advances by 0.6 em, which decorations and backgrounds use too.
"""

from __future__ import annotations

from .clip import Command

ADVANCE = 0.6
#: Ends of each stroke in a cell: columns from 0 to 2, rows from 0 (top) to 2.
STROKES = {
    "A": (0, 0, 1, 0), "B": (1, 0, 2, 0), "C": (2, 0, 2, 1), "D": (2, 1, 2, 2), "E": (1, 2, 2, 2), "F": (0, 2, 1, 2), "G": (0, 1, 0, 2), "H": (0, 0, 0, 1),
    "K": (0, 0, 1, 1), "M": (1, 0, 1, 1), "N": (2, 0, 1, 1), "P": (1, 1, 2, 1), "R": (1, 1, 2, 2), "S": (1, 1, 1, 2), "T": (1, 1, 0, 2), "U": (0, 1, 1, 1),
}
#: The strokes of each character; any other is drawn as a box.
GLYPHS = {
    "0": "ABCDEFGHNT", "1": "NCD", "2": "ABCPUGFE", "3": "ABCDEFP", "4": "HUPCD", "5": "ABHUPDEF", "6": "ABHGFEDPU", "7": "ABNT", "8": "ABCDEFGHUP", "9": "ABCDEFHUP",
    "A": "GHABCDUP", "B": "ABCDEFMSP", "C": "ABHGFE", "D": "ABCDEFMS", "E": "ABHGFEU", "F": "ABHGU", "G": "ABHGFEDP", "H": "HGCDUP", "I": "ABEFMS", "J": "CDEFG",
    "K": "HGUNR", "L": "HGFE", "M": "HGKNCD", "N": "HGKRCD", "O": "ABCDEFGH", "P": "ABCHGUP", "Q": "ABCDEFGHR", "R": "ABCHGUPR", "S": "ABHUPDEF", "T": "ABMS",
    "U": "HGFEDC", "V": "HGTN", "W": "HGTRDC", "X": "KNTR", "Y": "KNS", "Z": "ABNTFE", " ": "", "-": "UP", "_": "EF", "+": "UPMS", "=": "UPEF", "/": "NT", "\\": "KR",
    "|": "MS", "*": "UPMSKNTR", "(": "NR", ")": "KT", "<": "NR", ">": "KT", "[": "BMSE", "]": "AMSF", "'": "M", '"': "HM", "!": "MF", "?": "ABCPS", ".": "F", ",": "T",
    ":": "UF", ";": "UT", "#": "MSUPEFCD", "$": "ABHUPDEFMS", "%": "HNTD", "&": "AMUGFER", "@": "ABCPMHGFE", "^": "TR", "`": "K", "~": "UP", "{": "BMUSE", "}": "AMPSF",
}


def width(text: str, size: float) -> float:
    return ADVANCE * size * len(text)


def strokes(text: str, x: float, y: float, size: float, align: str, baseline: str) -> list[Command]:
    """Path commands of a line of text; a cell is 0.4 em wide and 0.7 em high above the baseline."""
    x -= {"center": width(text, size) / 2, "right": width(text, size)}.get(align, 0)
    y += {"top": 0.8 * size, "bottom": -0.2 * size}.get(baseline, 0)
    out: list[Command] = []
    for i, c in enumerate(text):
        high = 0.7 * size * (0.75 if c.islower() else 1)
        left, top = x + (i * ADVANCE + 0.1) * size, y - high
        for s in GLYPHS.get(c.upper(), "ABCDEFGH"):
            x0, y0, x1, y1 = STROKES[s]
            out.append(("M", [left + 0.2 * size * x0, top + high * y0 / 2]))
            out.append(("L", [left + 0.2 * size * x1, top + high * y1 / 2]))
    return out
