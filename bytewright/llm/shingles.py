"""Word shingles of whole texts as 64-bit hashes, by vector operations over the bytes of many texts at once.

Defined cases: null and empty texts have no words and no shingles; a text of any length is hashed whole, in steps of bounded memory, and a word
longer than a step by its pieces; repeated shingles count once; no texts, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: Bytes of text hashed at a time; bounds the memory of a Python worker.
STEP = 1 << 20
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = _U(int(_RNG.integers(1 << 60, 1 << 62)) * 8 + 5)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit sways every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x = x ^ (x >> _U(29))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_POWER = _powers(STEP + (1 << 16))
#: _BASE is odd, so it has an inverse modulo 2**64.
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, _INVERSE, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_BACK = _inverse_powers(STEP + (1 << 16))


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, words being runs of anything but ASCII white space."""
    word = np.empty(len(b) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def _hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every span of ``b`` (at most STEP + 65536 bytes), the same wherever the span lies."""
    at = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * _POWER[: len(b)], dtype=_U, out=at[1:])
    return mix((at[ends] - at[starts]) * _BACK[starts] + (ends - starts).astype(_U) * _U(0xA24BAED4963EE407))


def lower(b: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)


def word_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word in ``b``. Long input is taken in steps cut between words."""
    if len(b) <= STEP:
        s, e = word_spans(b)
        return _hash_spans(b, s, e), s
    hashes, starts, at = [], [], 0
    while at < len(b):
        part = b[at : at + STEP]
        end = len(part)
        if at + end < len(b):
            space = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            if len(space):
                end = int(space[-1]) + 1
            else:  # a word longer than a step: hash it by pieces up to its end
                rest = b[at:]
                stop = np.flatnonzero((rest == 32) | ((rest >= 9) & (rest <= 13)))
                end = int(stop[0]) if len(stop) else len(rest)
                h = _U(end)
                for k in range(0, end, STEP):
                    piece = rest[k : min(k + STEP, end)]
                    h = mix(np.array([h]) * _U(3) + _hash_spans(piece, np.array([0]), np.array([len(piece)])))[0]
                hashes.append(np.array([h]))
                starts.append(np.array([at]))
                at += end
                continue
        s, e = word_spans(part[:end])
        hashes.append(_hash_spans(part[:end], s, e))
        starts.append(s + at)
        at += end
    return np.concatenate(hashes), np.concatenate(starts)


def _runs(h: np.ndarray, first: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text whose words are ``h[first : first + n]``, and each text's number of them."""
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    text = np.repeat(np.arange(len(n)), count)
    at = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    out = np.full(len(text), _U(width))
    room = (first + n)[text]
    for k in range(width):
        i = np.minimum(at + k, len(h) - 1) if len(h) else at
        out = mix(out * _U(0xC2B2AE3D27D4EB4F) + np.where(at + k < room, h[i] if len(h) else _U(0), _U(0x5851F42D4C957F2D)))
    return out, count


def shingle_sets(texts: list[bytes | None], width: int, size: int = STEP) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of texts of about ``size`` bytes: the first's index, the sorted distinct shingle hashes, one text's
    after another's, and the number of each. A text of fewer words than ``width`` is one shingle; no words, none."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end] or b"") + 1 <= size):
            held += len(texts[end] or b"") + 1
            end += 1
        joined = np.frombuffer(b"\n".join(t or b"" for t in texts[at:end]), np.uint8)
        begins = np.cumsum([0] + [len(t or b"") + 1 for t in texts[at : end - 1]])
        h, starts = word_hashes(lower(joined))
        first = np.searchsorted(starts, begins)
        n = np.diff(np.append(first, len(starts)))
        runs, count = _runs(h, first, n, width)
        edges = np.cumsum(count) - count
        sets = [np.unique(runs[a : a + c]) for a, c in zip(edges, count, strict=True)]
        yield at, (np.concatenate(sets) if sets else runs), np.array([len(s) for s in sets], np.int64)
        at = end
