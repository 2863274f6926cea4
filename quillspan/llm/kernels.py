"""NumPy kernels over batches of text: rolling hashes, window minima and exact extension."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POS_BITS = np.uint64(22)
_POS_MASK = np.uint64((1 << 22) - 1)
#: Characters hashed together; arrays of this length stay in cache.
GROUP_CHARS = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, GROUP_CHARS + 1)
        with np.errstate(over="ignore"):
            _powers["up"] = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
            _powers["down"] = np.cumprod(np.full(size, _INVERSE, dtype=np.uint64))
    return _powers["up"], _powers["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise a 64-bit hash so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each run of ``k`` code points; entry i covers codes[i : i + k]."""
    n = len(codes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _power_tables(n)
    with np.errstate(over="ignore"):
        sums = np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n])
        h = sums[k - 1 :].copy()
        h[1:] -= sums[: n - k]
        return mix64(h * down[: n - k + 1])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` entries, by doubling."""
    span, m = 1, a
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (w - span)], m[w - span :]) if span < w else m


def groups(texts: Sequence[str], limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def minimizers(texts: Sequence[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing fingerprints of each text: (index of text, position, hash).

    Of every ``w`` consecutive k-grams the one of least hash is kept, the leftmost of equals, so two texts that share
    ``k + w - 1`` characters share a fingerprint at the same place of the shared run. Inside a run of one repeated
    character only its first and last k-gram are kept.
    """
    owners, places, values = [], [], []
    for lo, hi in groups(texts):
        part = texts[lo:hi]
        lengths = np.fromiter((len(t) for t in part), dtype=np.int64, count=len(part))
        ends = np.cumsum(lengths)
        codes = code_points("".join(part))
        if len(codes) < k + w - 1:
            continue
        h = window_hashes(codes, k)
        base = np.arange(len(h), dtype=np.uint64)
        if len(codes) >= 1 << int(_POS_BITS):  # one very long text: keep its order by windows of its own
            picked = _long_minima(h, w)
            starts_ok = None
        else:
            m = sliding_min((h & ~_POS_MASK) | base, w)
            starts = ends - lengths
            usable = np.zeros(len(m) + 1, dtype=np.int32)  # windows that lie within one text
            last = lengths - (k + w - 1)
            ok = last >= 0
            np.add.at(usable, starts[ok], 1)
            np.add.at(usable, np.minimum(starts[ok] + last[ok] + 1, len(m)), -1)
            starts_ok = np.cumsum(usable[:-1]) > 0
            picked = (m[starts_ok] & _POS_MASK).astype(np.int64)
        if not len(picked):
            continue
        picked = picked[np.concatenate(([True], picked[1:] != picked[:-1]))]
        val = h[picked]
        inner = np.zeros(len(picked), dtype=bool)
        same = (val[1:] == val[:-1]) & (picked[1:] == picked[:-1] + 1)
        inner[1:-1] = same[:-1] & same[1:]
        picked, val = picked[~inner], val[~inner]
        own = np.searchsorted(ends, picked, side="right")
        owners.append(own + lo)
        places.append(picked - (ends - lengths)[own])
        values.append(val)
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(owners), np.concatenate(places), np.concatenate(values)


def _long_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the window minima of one long text, in overlapping blocks."""
    step, out = 1 << 20, []
    for at in range(0, len(h) - w + 1, step):
        part = h[at : at + step + w - 1]
        m = sliding_min((part & ~_POS_MASK) | np.arange(len(part), dtype=np.uint64), w)
        out.append((m & _POS_MASK).astype(np.int64) + at)
    return np.concatenate(out)


def common_run(a: str, b: str, i: int, j: int, k: int) -> tuple[int, int]:
    """Extends the match a[i : i + k] == b[j : j + k] both ways; (start in a, length), or (i, 0) if there is no match."""
    if a[i : i + k] != b[j : j + k]:
        return i, 0
    return i - _equal(a, b, i, j, -1), k + _equal(a, b, i, j, -1) + _equal(a, b, i + k, j + k, 1)


def _equal(a: str, b: str, i: int, j: int, way: int) -> int:
    """How many characters agree from (i, j) onwards, or before it."""
    most = min(len(a) - i, len(b) - j) if way > 0 else min(i, j)
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        x, y = (a[i + done : i + done + step], b[j + done : j + done + step]) if way > 0 else (a[i - done - step : i - done], b[j - done - step : j - done])
        if x != y:
            if step == 1:
                return done
            step = max(1, step // 2)
            continue
        done += step
        step *= 2
    return done
