"""LZW as TIFF files use it: codes of 9 to 12 bits, most significant bit first, width raised one code early.

How wide a code is depends only on how many codes lie between it and the last clear code, so a whole stretch between two
clear codes is unpacked at once, and its strings are copied by following places in the output instead of a table of
strings: code 258 + k stands for the output of the stretch's k-th code and one byte more.  Packing needs the greedy parse
a byte at a time; its codes are put into bits as one array.
"""

from __future__ import annotations

from array import array

import numpy as np

CLEAR, END, FIRST = 256, 257, 258
#: A stretch has at most this many codes after its clear code: then the next width would be 13.
LONGEST = 4096 - FIRST + 1


def _widths(n: int) -> np.ndarray:
    """Bits of the codes 0, 1, ... after a clear code; when code k is read the table holds FIRST + k - 1 entries."""
    held = FIRST + np.maximum(np.arange(n) - 1, 0) + 1
    return np.clip(np.floor(np.log2(held)).astype(np.int64) + 1, 9, 12)


_BITS = _widths(LONGEST)
_AT = np.concatenate([[0], np.cumsum(_BITS)])
#: Which of 16 bits a code of so many bits takes.
_USED = np.arange(16) < np.arange(13)[:, None]


def decode(data: bytes) -> bytes:
    """The bytes before the end code, or before the data run out."""
    source = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    out, bit, last = [], 0, 8 * len(data)
    while bit + 9 <= last:
        n = int(np.searchsorted(_AT, last - bit, side="right")) - 1  # as many codes as there are bits for
        at = bit + _AT[:n]
        byte, shift = at >> 3, at & 7
        word = source[byte] << 16 | source[byte + 1] << 8 | source[byte + 2]
        codes = word >> 24 - shift - _BITS[:n] & (1 << _BITS[:n]) - 1
        special = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(special[0]) if len(special) else n
        out.append(_strings(codes[:stop]))
        if stop == n:
            if n == LONGEST:
                raise ValueError("LZW data without a clear code where the table is full")
            break
        if codes[stop] == END:
            break
        bit += int(_AT[stop + 1])
    return b"".join(out)


def _strings(codes: np.ndarray) -> bytes:
    """The output of a stretch of codes without special ones."""
    n = len(codes)
    if not n:
        return b""
    parent = codes - FIRST
    if (parent >= np.arange(n)).any():
        raise ValueError("an LZW code that is not known yet")
    # a code's length is 1 and the number of its ancestors: steps double until none is left
    length, up = np.ones(n, np.int64), parent.copy()
    while (linked := up >= 0).any():
        k = np.flatnonzero(linked)
        length[k] += length[up[k]]
        up[k] = up[up[k]]
    end = np.cumsum(length)
    start = end - length
    if end[-1] > 3 * n:  # long strings: one slice a code costs less than the bytes one by one
        return _copied(codes.tolist(), start.tolist(), end.tolist())
    # a byte of a code above FIRST is a copy of an earlier one; the places copied from double, too
    origin = np.repeat(np.where(parent >= 0, start[np.maximum(parent, 0)] - start, 0), length)
    place = np.arange(end[-1]) + origin
    value = np.zeros(end[-1], np.uint8)
    value[start[parent < 0]] = codes[parent < 0]
    copied = np.flatnonzero(origin)
    while len(copied):
        there = place[copied]
        further = place[there]
        place[copied] = further
        copied = copied[further != there]
    return value[place].tobytes()


def _copied(codes: list[int], start: list[int], end: list[int]) -> bytes:
    out = bytearray()
    for code in codes:
        if code < CLEAR:
            out.append(code)
        else:
            k = code - FIRST
            part = out[start[k] : end[k] + 1]
            out += part
            if end[k] + 1 > start[k] + len(part):  # the one byte more is the first of this very string
                out.append(part[0])
    return bytes(out)


def encode(data: bytes) -> bytes:
    """A clear code, the codes of the longest known strings with a clear code whenever the table is full, the end code."""
    codes, bits, first = array("H", [CLEAR]), [_BITS[:1]], 0
    table: dict[int, int] = {}
    learn, put, size = table.setdefault, codes.append, FIRST
    word = data[0] if data else None
    for byte in memoryview(data)[1:]:
        known = learn(word << 8 | byte, size)
        if known != size:
            word = known
            continue
        put(word)
        word = byte
        size += 1
        if size == 4095:
            put(CLEAR)
            bits.append(_BITS[: len(codes) - first - 1])
            table, size, first = {}, FIRST, len(codes) - 1
            learn = table.setdefault
    if word is not None:
        codes.append(word)
    codes.append(END)
    bits.append(_BITS[: len(codes) - first - 1])
    return _packed(np.frombuffer(codes, np.uint16), np.concatenate(bits))


def _packed(codes: np.ndarray, bits: np.ndarray) -> bytes:
    high = (codes << (16 - bits).astype(np.uint16)).astype(">u2")  # a code's bits come first in its 16
    return np.packbits(np.unpackbits(high.view(np.uint8)).reshape(-1, 16)[_USED[bits]]).tobytes()
