"""Pre-tokens of two public split patterns for whole slices of texts at once, in numpy over code points.

STYLE "bytes": 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
STYLE "words": 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+  (white space is dropped)

The tests compare both with the pattern itself, on every code point and on random texts.
"""

from __future__ import annotations

import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: The code points of Unicode's White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point, made once in a process."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, np.uint8)
        first = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        kinds = np.array(first)
        table[kinds == "L"], table[kinds == "N"] = LETTER, NUMBER
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def code_points(data: bytes, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The decoded slice, its code points and the offsets of its texts in code points."""
    text = data.decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return text, points, offsets
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=heads[1:])
    return text, points, heads[offsets]


def spans(points: np.ndarray, offsets: np.ndarray, style: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens, none across two texts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)  # where a text begins or the slice ends
    first[offsets] = True
    begins = np.ones(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    if style == "words":
        begins[:n] |= kind == NUMBER
    begins |= first
    if style == "bytes":
        # White space before other text: its last character stands alone, and goes to what follows if it is a blank.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
        begins[last] = True
        begins[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & begins[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    if len(quote):
        a = points[quote + 1]
        one = quote[np.isin(a, [ord(c) for c in "stmd"])]
        two = quote[quote + 2 < n]
        two = two[~first[two + 2]]
        a, b = points[two + 1], points[np.minimum(two + 2, n - 1)]
        two = two[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
        begins[one + 1], begins[two + 1] = False, False
        begins[one + 2], begins[two + 3] = True, True
    edges = np.flatnonzero(begins)
    starts, ends = edges[:-1], edges[1:]
    if style == "words":
        keep = kind[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends
