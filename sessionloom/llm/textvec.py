"""Many texts at once as one byte buffer: words, lines and hashes of byte ranges by numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator


def slices(texts: Iterable, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, UTF-8 texts) in runs of about ``most`` bytes; null is empty."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode() if t else b""
        if part and size + len(b) > most:
            yield first, part
            first, part, size = i, [], 0
        part.append(b)
        size += len(b) + 1
    if part:
        yield first, part


def mixed(h):
    """Scatter unsigned 64-bit numbers (splitmix64's finaliser)."""
    import numpy as np

    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Hasher:
    """64-bit hashes of byte ranges: random byte codes times powers of an odd base, moved to the range's start."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        import numpy as np

        self.codes = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.inverse = pow(self.BASE, -1, 1 << 64)
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        import numpy as np

        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = np.full(n, self.BASE, np.uint64), np.full(n, self.inverse, np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)

    def sums(self, data):
        """Prefix sums of ``data`` for ``ranges``."""
        import numpy as np

        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, sums, start, end):
        import numpy as np

        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Texts:
    """Texts end to end, a newline after each; words are runs without ASCII white space."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        import numpy as np

        raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(raw.lower() if lower else raw, np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(size + 1) - 1
        self.begin = self.end - size
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        self.gap = space[self.data]
        edge = np.flatnonzero(np.diff(self.gap.view(np.int8), prepend=np.int8(1)))
        self.start, self.stop = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.begin)  # of each text's words
        self.n_words = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)
