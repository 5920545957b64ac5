"""Printing of spans, shared by the personal-data and secret scans."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

Span = tuple[str, int, int]


def printed(spans: list[Span]) -> str:
    """kind:start:end, comma-joined in the given order."""
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(printed(spans).encode()).hexdigest()


def outside(extra: list[Span], base: list[Span]) -> list[Span]:
    """Those of `extra` that share no character with a base span or an earlier one of `extra`."""
    starts: list[int] = []
    ends: list[int] = []
    for _, start, end in sorted(base, key=lambda x: x[1]):
        if ends and start < ends[-1]:
            ends[-1] = max(end, ends[-1])
        else:
            starts.append(start)
            ends.append(end)
    found: list[Span] = []
    for span in sorted(set(extra), key=lambda x: (x[1], -x[2], x[0])):
        k = bisect_left(starts, span[2])  # base spans before it begin before the span's end
        if (not k or ends[k - 1] <= span[1]) and (not found or found[-1][2] <= span[1]):
            found.append(span)
    return found
