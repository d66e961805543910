"""The coder over many files at once: each is a lane, and every step codes one symbol of each lane with numpy.

The bytes are those of ``codec``, whose models stay the plain form: they take over where few lanes are left, and say what is wrong with a
payload. Weights of a context are kept as counts in two levels, 16 groups of 16 symbols. In a row of either level place 0 holds the row's sum and
place j the sum before j, so that a symbol is found by counting the places that don't exceed a target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from . import codec
from .codec import CorruptError, Decoder, Encoder

#: Lanes below which the plain coder is faster.
FEW = 32
#: Lanes of a wave at most, their bytes, and the cells of steps by lanes.
LANES, WAVE, CELLS = 1024, 8 << 20, 32 << 20
#: Models with lanes; others are coded file by file.
ORDERS = {name: order for name, order in codec.ORDERS.items() if order < 3}

_PAD = 16  # zeros behind each payload
_MASKS = np.array([-1, *[(1 << 40) - 1] * 3])  # without a shift a carry stays
_COARSE, _FINE = np.array([256, *range(16, 256, 16)], np.int32), np.array([16, *range(1, 16)], np.uint16)  # sums of weights of 1
_MORE = (np.arange(16) > np.arange(16)[:, None]).astype(np.int32)
_MORE[:, 0] = 1
_MORE, _MORE_FINE = _MORE.view("V64").ravel(), _MORE.astype(np.uint16).view("V32").ravel()


def _places(row_le: np.ndarray) -> np.ndarray:
    """How many of each row's 16 flags are set."""
    n = np.bitwise_count(row_le.view(np.uint64))
    return (n[:, 0] + n[:, 1]).astype(np.int64)


def _bytes(cells: np.ndarray) -> bytearray:
    """Cells of up to nine bits as bytes, with their carries."""
    cells = cells.copy()
    while (over := cells >> 8).any():
        cells &= 255
        cells[:-1] += over[1:]
    return bytearray(cells.astype(np.uint8).tobytes())


class Encoders:
    """Range coders of all lanes; ``capacity`` has each lane's symbols."""

    def __init__(self, capacity: np.ndarray) -> None:
        n = len(capacity)
        self.low, self.range = np.zeros(n, np.int64), np.full(n, 1 << 40)
        self.begin = np.append(0, np.cumsum(2 * capacity + 8)[:-1])
        self.at = self.begin.copy()
        self.cells = np.zeros(int((2 * capacity + 8).sum()), np.uint16)

    def put(self, k: int, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        part = self.range[:k] // total
        low, range_, at = self.low[:k] + start * part, size * part, self.at[:k]
        n = (range_ <= 1 << 32).astype(np.int64) + (range_ <= 1 << 24) + (range_ <= 1 << 16)
        self.cells[at + 2] = low >> 16 & 255
        self.cells[at + 1] = low >> 24 & 255
        self.cells[at] = low >> 32  # what isn't shifted out is written over later
        at += n
        shift = n << 3
        self.low[:k] = low << shift & _MASKS.take(n)
        self.range[:k] = range_ << shift

    def plain(self, j: int) -> Encoder:
        """Lane ``j``'s coder as it is; the lane begins anew."""
        out = Encoder()
        out.low, out.range, out.out = int(self.low[j]), int(self.range[j]), _bytes(self.cells[self.begin[j] : self.at[j]])
        self.low[j], self.range[j], self.at[j] = 0, 1 << 40, self.begin[j]
        return out


class Decoders:
    """Range decoders of all lanes; ``bad`` tells lanes that no encoder wrote."""

    def __init__(self, payloads: list[list[bytes]]) -> None:
        sizes = [[len(p) + _PAD for p in lane] for lane in payloads]
        starts = np.append(0, np.cumsum([s for lane in sizes for s in lane]))
        data = np.frombuffer(b"".join(p + bytes(_PAD) for lane in payloads for p in lane) + bytes(_PAD), np.uint8).astype(np.uint32)
        self.window = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]).astype(np.int64)
        self.payloads, self.first = payloads, np.append(0, np.cumsum([len(lane) for lane in sizes]))
        self.starts, n = starts, len(payloads)
        self.code, self.range, self.at, self.bad, self.block = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), [-1] * n
        for j in range(n):
            self.next(j)

    def next(self, j: int) -> None:
        """On to the next payload of lane ``j``, if there is one."""
        if self.block[j] >= 0:
            self.bad[j] |= self.at[j] > self.starts[self.first[j] + self.block[j] + 1] - _PAD + 5
        self.block[j] += 1
        if self.block[j] < len(self.payloads[j]):
            d = Decoder(self.payloads[j][self.block[j]])
            self.code[j], self.range[j], self.at[j] = d.code, d.range, self.starts[self.first[j] + self.block[j]] + d.at

    def target(self, k: int, total: np.ndarray) -> np.ndarray:
        self.part = self.range[:k] // total
        value = self.code[:k] // self.part
        self.bad[:k] |= value >= total
        return np.minimum(value, total - 1)

    def take(self, k: int, start: np.ndarray, size: np.ndarray) -> None:
        code, range_, at = self.code[:k] - start * self.part, size * self.part, self.at[:k]
        n = (range_ <= 1 << 32).astype(np.int64) + (range_ <= 1 << 24) + (range_ <= 1 << 16)
        shift = n << 3
        self.code[:k] = code << shift | self.window.take(at, mode="clip") >> (24 - shift)
        self.range[:k] = range_ << shift
        at += n

    def plain(self, j: int) -> Decoder:
        out = Decoder(self.payloads[j][self.block[j]])
        out.code, out.range, out.at = int(self.code[j]), int(self.range[j]), int(self.at[j] - self.starts[self.first[j] + self.block[j]])
        return out


class Adaptive:
    """``codec.Adaptive`` of orders 0 to 2 for all lanes."""

    def __init__(self, order: int, capacity: np.ndarray) -> None:
        n = len(capacity)
        self.order, self.key, self.lane = order, np.zeros(n, np.int64), np.arange(n)
        self.rows = (n, n << 8, 1 + min(int(capacity.sum()), n << 16))[order]
        self.coarse, self.fine = np.zeros((self.rows, 16), np.int32), np.zeros((self.rows << 4, 16), np.uint16)  # pages that aren't touched take no memory
        self.coarse_rows, self.fine_rows = self.coarse.view("V64").ravel(), self.fine.view("V32").ravel()  # whole rows are quickest to move
        self.known, self.free, self.steps = np.zeros(n << 16 if order == 2 else 0, np.int32), 1, 0
        self.place = self.lane << 4

    def _row(self, k: int) -> np.ndarray:
        at = (self.lane[:k] << 8 * self.order) + self.key[:k]
        if self.order < 2:
            return at
        row = self.known.take(at).astype(np.int64)
        if not row.all():
            new = np.flatnonzero(row == 0)
            row[new] = np.arange(self.free, self.free + len(new))
            self.known[at[new]] = row[new]
            self.free += len(new)
        return row

    def ranges(self, k: int, s: np.ndarray, coder: Encoders) -> None:
        """Encode ``s`` and learn it."""
        s = s.astype(np.int64)
        row, group, within = self._row(k), s >> 4, s & 15
        at = group * self.rows + row
        coarse, fine = self.coarse_rows.take(row).view(np.int32).reshape(k, 16), self.fine_rows.take(at).view(np.uint16).reshape(k, 16)
        place, f, after = self.place[:k], fine.ravel(), within + 1 & 15
        low = (f.take(place + within) + within) * (within > 0)
        size = f.take(place + after) + _FINE.take(after) - low
        start = (coarse.ravel().take(place + group) + (group << 4)) * (group > 0) + low
        coder.put(k, start, size, coarse[:, 0] + np.int64(256))
        self._learn(k, s, row, group, within, coarse, at, fine)

    def found(self, k: int, coder: Decoders) -> np.ndarray:
        """Decode a symbol and learn it."""
        row, place = self._row(k), self.place[:k]
        coarse = self.coarse_rows.take(row).view(np.int32).reshape(k, 16)
        c = coarse + _COARSE
        target = coder.target(k, c[:, 0].astype(np.int64))
        group = _places(c <= target.astype(np.int32)[:, None])
        above = c.ravel().take(place + group) * (group > 0)
        at = group * self.rows + row
        fine = self.fine_rows.take(at).view(np.uint16).reshape(k, 16)
        f = fine + _FINE
        within = _places(f <= (target - above).astype(np.uint16)[:, None])
        f = f.ravel()
        low = f.take(place + within).astype(np.int64) * (within > 0)
        coder.take(k, above + low, f.take(place + (within + 1 & 15)) - low)
        s = (group << 4) + within
        self._learn(k, s, row, group, within, coarse, at, fine)
        return s

    def _learn(self, k, s, row, group, within, coarse, at, fine) -> None:
        coarse += _MORE.take(group).view(np.int32).reshape(k, 16)
        self.coarse_rows[row] = coarse.view("V64").ravel()
        fine += _MORE_FINE.take(within).view(np.uint16).reshape(k, 16)
        self.fine_rows[at] = fine.view("V32").ravel()
        self.steps += 1
        if self.steps + 256 > codec.MAX_FREQ:
            for r in row[coarse[:, 0] + 256 > codec.MAX_FREQ]:
                self._set(r, (w := self.weights(r)) - (w >> 1))
        if self.order:
            self.key[:k] = s if self.order == 1 else (self.key[:k] & 255) << 8 | s

    def weights(self, row: int) -> np.ndarray:
        fine = self.fine[row :: self.rows] + _FINE
        before = np.hstack([np.zeros((16, 1), np.int64), fine[:, 1:], fine[:, :1]])
        return np.diff(before, axis=1).ravel()

    def _set(self, row: int, weights: np.ndarray) -> None:
        sums = weights.reshape(16, 16).cumsum(1)
        self.fine[row :: self.rows] = np.hstack([sums[:, -1:], sums[:, :-1]]) - _FINE
        sums = sums[:, -1].cumsum()
        self.coarse[row] = np.append(sums[-1], sums[:-1]) - _COARSE

    def plain(self, j: int) -> codec.Adaptive:
        """Lane ``j``'s model as it is."""
        out = codec.Adaptive(self.order)
        out.context = int(self.key[j]).to_bytes(2, "big")[2 - self.order :]
        if self.order < 2:
            keys = np.arange(1 << 8 * self.order)
            rows = (j << 8 * self.order) + keys
            used = self.coarse[rows, 0] > 0
            keys, rows = keys[used], rows[used]
        else:
            keys = np.flatnonzero(self.known[j << 16 : (j + 1) << 16])
            rows = self.known[(j << 16) + keys]
        for key, row in zip(keys.tolist(), rows.tolist(), strict=True):
            w = self.weights(row).tolist()
            out.tables[key.to_bytes(2, "big")[2 - self.order :]] = [*w, sum(w)]
        return out


class Static:
    """``codec.Fixed`` models of all lanes."""

    def __init__(self, models: list[codec.Fixed]) -> None:
        self.models, n = models, len(models)
        self.sums = np.array([m.sums for m in models], np.int64).reshape(n, 256)
        self.size = np.array([m.w for m in models], np.int64).reshape(n, 256)
        self.start, self.total, self.lane = (self.sums - self.size).ravel(), self.sums[:, -1].copy(), np.arange(n) << 8
        self.begin = np.append(0, np.cumsum(self.total)[:-1])
        self.symbol, self.size = np.repeat(np.tile(np.arange(256, dtype=np.uint8), n), self.size.ravel()), self.size.ravel()  # by place in the totals

    def ranges(self, k: int, s: np.ndarray, coder: Encoders) -> None:
        at = self.lane[:k] + s
        coder.put(k, self.start.take(at), self.size.take(at), self.total[:k])

    def found(self, k: int, coder: Decoders) -> np.ndarray:
        s = self.symbol.take(self.begin[:k] + coder.target(k, self.total[:k]))
        at = self.lane[:k] + s
        coder.take(k, self.start.take(at), self.size.take(at))
        return s

    def plain(self, j: int) -> codec.Fixed:
        return self.models[j]


def waves(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of the files in groups of like sizes, the longest first."""
    order, wave, total = sorted(range(len(sizes)), key=lambda i: -sizes[i]), [], 0
    for i in order:
        if wave and (len(wave) == LANES or total + sizes[i] > WAVE or (len(wave) + 1) * sizes[wave[0]] > CELLS):
            yield wave
            wave, total = [], 0
        wave.append(i)
        total += sizes[i]
    if wave:
        yield wave


def _spans(sizes: list[list[int]]) -> Iterator[tuple[int, int, int, list[int]]]:
    """``(from, to, lanes, ending)``: steps in which the same lanes go on, and the lanes of which a block ends then. Lanes go from long to short."""
    ends: dict[int, list[int]] = {}
    for j, lane in enumerate(sizes):
        at = 0
        for size in lane:
            at += size
            ends.setdefault(at, []).append(j)
    last, total = 0, -np.array([sum(lane) for lane in sizes])
    for at in sorted(ends):
        yield last, at, int(np.searchsorted(total, -last)), ends[at]
        last = at


def _encoded(model: Adaptive | Static, lanes: list[list[bytes]]) -> list[list[bytes]]:
    whole = [b"".join(lane) for lane in lanes]
    n, longest = len(lanes), len(whole[0])
    text = np.ascontiguousarray(np.frombuffer(b"".join(x.ljust(longest, b"\0") for x in whole), np.uint8).reshape(n, longest).T)
    coder, out = Encoders(np.array([max(map(len, lane), default=0) for lane in lanes])), [[] for _ in lanes]
    for since, until, k, ending in _spans([[len(b) for b in lane] for lane in lanes]):
        if k < FEW:
            for j in range(k):
                plain, one, at = model.plain(j), coder.plain(j), sum(map(len, lanes[j][: len(out[j])]))
                for block in lanes[j][len(out[j]) :]:
                    for s in block[max(since - at, 0) :]:
                        plain.encode(one, s)
                    out[j].append(one.finish())
                    one, at = Encoder(), at + len(block)
            break
        for t in range(since, until):
            model.ranges(k, text[t, :k], coder)
        for j in ending:
            out[j].append(coder.plain(j).finish())
    return out


def _decoded(model: Adaptive | Static, lanes: list[list[bytes]], sizes: list[list[int]]) -> list[list[bytes] | None]:
    n, longest = len(lanes), sum(sizes[0])
    text, coder = np.zeros((longest, n), np.uint8), Decoders(lanes)
    tails: dict[int, bytes] = {}
    for since, until, k, ending in _spans(sizes):
        if k < FEW:
            for j in range(k):
                try:
                    plain, one, at, tail = model.plain(j), coder.plain(j), sum(sizes[j][: coder.block[j]]), bytearray()
                    for b in range(coder.block[j], len(sizes[j])):
                        one = one or Decoder(lanes[j][b])
                        tail += bytes(plain.decode(one) for _ in range(max(since - at, 0), sizes[j][b]))
                        one, at = None, at + sizes[j][b]
                    tails[j] = bytes(tail)
                except (CorruptError, IndexError):
                    coder.bad[j] = True
            break
        for t in range(since, until):
            text[t, :k] = model.found(k, coder)
        for j in ending:
            coder.next(j)
    text = np.ascontiguousarray(text.T)
    out: list[list[bytes] | None] = []
    for j, lane in enumerate(sizes):
        whole = text[j, : sum(lane) - len(tails.get(j, b""))].tobytes() + tails.get(j, b"")
        ends = np.cumsum(lane).tolist()
        out.append(None if coder.bad[j] else [whole[e - s : e] for e, s in zip(ends, lane, strict=True)])
    return out


def _by_waves(sizes: list[int], f: Callable[[list[int]], list]) -> list:
    out: list = [None] * len(sizes)
    for wave in waves(sizes):
        for i, x in zip(wave, f(wave), strict=True):
            out[i] = x
    return out


def encode(model: str, files: list[list[bytes]]) -> list[list[bytes]]:
    """Payloads of each file's blocks, none of them empty, as ``codec`` codes them: its model goes from block to block."""
    if model == "O0FIX":
        blocks = [b for f in files for b in f]

        def static(wave: list[int]) -> list[bytes]:
            models = [codec.Fixed([int(c) for c in np.bincount(np.frombuffer(blocks[i], np.uint8), minlength=256)]) for i in wave]
            return [m.header() + x[0] for m, x in zip(models, _encoded(Static(models), [[blocks[i]] for i in wave]), strict=True)]

        coded = iter(_by_waves([len(b) for b in blocks], static))
        return [[next(coded) for _ in f] for f in files]
    if model not in ORDERS:
        codecs = [codec.codec_of(model) for _ in files]
        return [[c.encode(b) for b in f] for c, f in zip(codecs, files, strict=True)]
    sizes = [sum(map(len, f)) for f in files]
    return _by_waves(sizes, lambda wave: _encoded(Adaptive(ORDERS[model], np.array([sizes[i] for i in wave])), [files[i] for i in wave]))


def decode(model: str, files: list[list[tuple[bytes, int]]]) -> list[list[bytes] | None]:
    """Each file's blocks out of their payloads and sizes above 0; None for a file with a payload that no encoder wrote, or of a model without lanes."""
    if model == "O0FIX":
        blocks = [b for f in files for b in f if len(b[0]) >= 512]

        def static(wave: list[int]) -> list[bytes | None]:
            models = [codec.Fixed.read(blocks[i][0][:512]) for i in wave]
            return [x and x[0] for x in _decoded(Static(models), [[blocks[i][0][512:]] for i in wave], [[blocks[i][1]] for i in wave])]

        plain = iter(_by_waves([b[1] for b in blocks], static))
        found = [[next(plain) if len(b[0]) >= 512 else None for b in f] for f in files]
        return [None if None in f else f for f in found]
    if model not in ORDERS:
        return [None] * len(files)
    sizes = [sum(b[1] for b in f) for f in files]
    return _by_waves(sizes, lambda wave: _decoded(Adaptive(ORDERS[model], np.array([sizes[i] for i in wave])), [[b[0] for b in files[i]] for i in wave], [[b[1] for b in files[i]] for i in wave]))
