"""difflib's ratio of texts, exactly, from matrices of equal characters held as whole numbers.

Bit i * stride + j of a matrix says that the i-th character of one text is the j-th of the other. A block of k equal
characters is a run down a diagonal, so the longest one is found by a few shifts and ands, and its first place is the
lowest bit that is left: the choice that difflib makes. As there, characters that are more than 1 % of a text of 200 or
more begin no block (but lengthen one).
"""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Bins of characters by which matches are bounded from above.
BINS = 64


class Text:
    """A text with what its comparisons need; the rows of its matrices are made when they are asked for."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bins = np.bincount(codes % BINS, minlength=BINS).astype(np.int32)
        self.rows: dict[str, bytes] | None = None

    def prepare(self) -> None:
        # a column more than there are characters: runs end there
        self.width = (self.n + 8) // 8
        self.empty = bytes(self.width)
        counts = Counter(self.text)
        most = self.n // 100 + 1 if self.n >= 200 else self.n
        self.popular = any(c > most for c in counts.values())
        masks = {c: 0 for c, k in counts.items() if k <= most}
        for j, c in enumerate(self.text):
            if c in masks:
                masks[c] |= 1 << j
        self.rows = {c: m.to_bytes(self.width, "little") for c, m in masks.items()}


def _longest(x: int, diagonal: int) -> tuple[int, int]:
    """(length, lowest bit) of the longest runs."""
    levels, k = [x], 1
    while longer := levels[-1] & (levels[-1] >> diagonal * k):
        levels.append(longer)
        k *= 2
    found, size = levels.pop(), k
    while levels:
        k //= 2
        if longer := found & (levels.pop() >> diagonal * size):
            found, size = longer, size + k
    return size, (found & -found).bit_length() - 1


def ratio(a: Text, b: Text, floor: float = -1.0) -> float:
    """SequenceMatcher(None, a, b).ratio(); if it is known not to exceed floor, floor."""
    length = a.n + b.n
    if not length:
        return 1.0
    if a.text == b.text:
        return 1.0 if not b.n or b.n < 200 else max(floor, _ratio(a, b, floor, length))
    return _ratio(a, b, floor, length)


def _ratio(a: Text, b: Text, floor: float, length: int) -> float:
    if b.rows is None:
        b.prepare()
    s, t, width, stride = a.text, b.text, b.width, b.width * 8
    whole = int.from_bytes(b"".join([b.rows.get(c, b.empty) for c in s]), "little")
    todo, matched, may = [(0, a.n, 0, b.n, whole)], 0, min(a.n, b.n)
    while todo:
        if 2.0 * (matched + may) / length <= floor:
            return floor
        alo, ahi, blo, bhi, x = todo.pop()
        may -= min(ahi - alo, bhi - blo)
        i, j, k = alo, blo, 0
        if x:
            k, low = _longest(x, stride + 1)
            i, j = alo + low // stride, low % stride
        if b.popular:
            while i > alo and j > blo and s[i - 1] == t[j - 1]:
                i, j, k = i - 1, j - 1, k + 1
            while i + k < ahi and j + k < bhi and s[i + k] == t[j + k]:
                k += 1
        if not k:
            continue
        matched += k
        for lo, hi, left, right, part in ((alo, i, blo, j, x), (i + k, ahi, j + k, bhi, x >> (i + k - alo) * stride)):
            if lo < hi and left < right:
                inside = (((1 << right - left) - 1) << left).to_bytes(width, "little") * (hi - lo)
                part &= int.from_bytes(inside, "little")
                if part or b.popular:
                    todo.append((lo, hi, left, right, part))
                    may += min(hi - lo, right - left)
    return 2.0 * matched / length


def greatest(texts, threshold: float) -> list[float]:
    """The greatest ratio of each text to an accepted one before it; accepted are those under the threshold."""
    kept: list[Text] = []
    bins, sizes = np.zeros((8, BINS), np.int32), np.zeros(8, np.int64)
    scores = []
    for x in texts:
        t, best, m = Text(x), 0.0, len(kept)
        if m:
            length = sizes[:m] + t.n
            bound = np.where(length == 0, 1.0, 2.0 * np.minimum(bins[:m], t.bins).sum(axis=1) / np.maximum(length, 1))
            for at in np.argsort(-bound, kind="stable").tolist():
                if bound[at] <= best:
                    break
                best = max(best, ratio(t, kept[at], best))
        scores.append(best)
        if best < threshold:
            if m == len(bins):
                bins, sizes = np.concatenate([bins, np.zeros_like(bins)]), np.concatenate([sizes, np.zeros_like(sizes)])
            bins[m], sizes[m] = t.bins, t.n
            kept.append(t)
    return scores
