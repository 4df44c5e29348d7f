"""Range buckets of sort keys that split hot keys.

Bounds come from a bounded sample.  A key that fills several buckets stands
several times among the bounds; its rows are dealt over all of these."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

#: Keys that a sample has at most.
SAMPLE = 10_000


def bounds(sample: list, buckets: int) -> list:
    """buckets - 1 upper bounds, with repeats for hot keys."""
    s = sorted(sample)
    return [s[i * len(s) // buckets] for i in range(1, buckets)] if s else []


def reach(cuts: list, key) -> tuple[int, int]:
    """First and last bucket that rows of a key may be in."""
    low, high = bisect_left(cuts, key), bisect_right(cuts, key)
    # with one bound equal to the key it begins the bucket after that bound
    return (high, high) if high - low <= 1 else (low + 1, high)


def bucket(cuts: list, key, salt: int) -> int:
    low, high = reach(cuts, key)
    return low + salt % (high - low + 1)
