"""Streams of codes, many at once: what functions.codes gives, over whole Arrow columns.

A column of streams is laid out as one array of bits; every step works on all of it."""

from __future__ import annotations

import numpy as np

from .codes import fibonacci_numbers

_FIBONACCI = np.array(fibonacci_numbers((1 << 63) - 1), np.int64)


def code_of(n: int, code: str) -> str:
    if n < 1:
        return ""
    if code == "unary":
        return "1" * (n - 1) + "0"
    if code == "gamma":
        bits = bin(n)[2:]
        return "1" * (len(bits) - 1) + "0" + bits[1:]
    out = ""
    for f in map(int, _FIBONACCI[: np.searchsorted(_FIBONACCI, n, "right")][::-1]):
        out = ("1" if n >= f else "0") + out
        n -= f * (n >= f)
    return out + "1"


def lengths(gaps: np.ndarray, code: str) -> np.ndarray:
    """Bits of the codes, without the codes."""
    if code == "unary":
        return gaps
    if code == "gamma":
        return 2 * np.searchsorted(1 << np.arange(63, dtype=np.int64), gaps, "right") - 1
    return np.searchsorted(_FIBONACCI, gaps, "right") + 1


def encode(gaps: np.ndarray, offsets: np.ndarray, code: str):
    """A string column: the codes of each run of gaps; each different gap is coded once."""
    import pyarrow as pa

    known, at = np.unique(gaps, return_inverse=True)
    words = pa.array([code_of(int(n), code) for n in known], pa.large_string()).take(pa.array(at))
    # One after another, the codes are the streams already; only other places are cut.
    cuts = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1][offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(cuts), words.buffers()[2] or pa.py_buffer(b"")).cast(pa.string())


def _bits(column) -> tuple:
    """(ones as booleans, first bit of each stream and the end) of a string column."""
    import pyarrow as pa

    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data == ord("1"), offsets - offsets[0]


def decode(column, code: str) -> tuple:
    """(numbers, how many of each stream, whether the stream is whole).  A stream that
    is cut short or broken gives the numbers before the break."""
    one, ends = _bits(column)
    stream = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    n = len(ends) - 1
    if code == "gamma":
        return _decode_gamma(one, ends)
    if code == "unary":
        last = np.flatnonzero(~one)  # the last bit of each code
    else:
        # A code ends where a run of ones has an even number of them so far.
        fresh = np.ones(len(one), bool)
        fresh[1:] = ~one[:-1]
        fresh[ends[:-1][np.diff(ends) > 0]] = True
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(one)), 0))
        last = np.flatnonzero(one & ((np.arange(len(one)) - begin) % 2 == 1))
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    first = np.maximum(first, ends[stream[last]])  # after what a stream before has left over
    count = np.bincount(stream[last], minlength=n)
    reached = ends[:-1].copy()
    reached[stream[last]] = last + 1
    whole = reached == ends[1:]
    if code == "unary":
        return last - first + 1, count, whole
    if not len(last):
        return np.zeros(0, np.int64), count, whole
    place = np.zeros(len(one), np.int64)
    place[first[0] :] = np.arange(first[0], len(one)) - np.repeat(first, np.diff(first, append=len(one)))
    value = np.where(one, _FIBONACCI[np.minimum(place, len(_FIBONACCI) - 1)], 0)
    value[last] = 0
    upto = np.concatenate([[0], np.cumsum(value)])  # may wrap around; the differences do not
    return upto[last + 1] - upto[first], count, whole


def _decode_gamma(one: np.ndarray, ends: np.ndarray) -> tuple:
    """Code after code of all streams at once: as many rounds as the longest stream has."""
    n, size = len(ends) - 1, len(one)
    zero = np.minimum.accumulate(np.where(one, size, np.arange(size))[::-1])[::-1] if size else np.zeros(0, np.int64)
    at, whole, count = ends[:-1].copy(), np.ones(n, bool), np.zeros(n, np.int64)
    live, owners, values = np.flatnonzero(at < ends[1:]), [], []
    while len(live):
        z = zero[at[live]]
        end = 2 * z - at[live] + 1
        fits = (z < ends[live + 1]) & (end <= ends[live + 1])
        whole[live[~fits]] = False
        live, z, end = live[fits], z[fits], end[fits]
        value = np.ones(len(live), np.int64)
        left = end - z - 1
        for i in range(int(left.max(initial=0))):
            more = left > i
            value[more] = 2 * value[more] + one[z[more] + 1 + i]
        owners.append(live)
        values.append(value)
        count[live] += 1
        at[live] = end
        live = live[end < ends[live + 1]]
    if not owners:
        return np.zeros(0, np.int64), count, whole
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(values)[order], count, whole
