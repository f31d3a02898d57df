"""Entropy codecs of CRAM 3.1: 16-bit rANS with its transformations, and tokenised names."""

from __future__ import annotations

import struct

from readloom.sources.bgzf import FormatError

#: Flag bits of a stream.
ORDER1, WIDE, STRIPE, NO_SIZE, PLAIN, RUNS, PACKED = 1, 4, 8, 16, 32, 64, 128


class _Input:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError("a stream is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """Seven bits a byte, the highest first."""
        value = 0
        while True:
            b = self.byte()
            value = value << 7 | b & 127
            if b < 128:
                return value


def _alphabet(r: _Input) -> list[int]:
    out, symbol, run = [], r.byte(), 0
    while True:
        out.append(symbol)
        if run:
            run, following = run - 1, symbol + 1
        else:
            following = r.byte()
            if following == symbol + 1:
                run = r.byte()
        symbol = following
        if not symbol:
            return out


def _slots(shares: dict[int, int], bits: int) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Symbols by slot and their (share, first slot); shares are scaled up to 2**bits."""
    total = sum(shares.values())
    shift = 0
    while total and total << shift < 1 << bits:
        shift += 1
    slots, spans = [], {}
    for s, f in sorted(shares.items()):
        if f:
            spans[s] = (f << shift, len(slots))
            slots += [s] * (f << shift)
    return slots, spans


def _order0(r: _Input, size: int, ways: int) -> bytes:
    slots, spans = _slots({s: r.number() for s in _alphabet(r)}, 12)
    return _run(r, size, ways, 12, lambda _: (slots, spans), ((i, i % ways) for i in range(size)))


def _order1(r: _Input, size: int, ways: int) -> bytes:
    how = r.byte()
    bits, t = how >> 4, r
    if how & 1:
        raw, packed = r.number(), r.number()
        t = _Input(_order0(_Input(r.take(packed)), raw, 4))
    symbols = _alphabet(t)
    tables = {}
    for c in symbols:
        shares, zeros = {}, 0
        for s in symbols:
            if zeros:
                zeros -= 1
                continue
            shares[s] = t.number()
            if not shares[s]:
                zeros = t.byte()
        tables[c] = _slots(shares, bits)
    part = size // ways
    plan = [(j * part + i, j) for i in range(part) for j in range(ways)] + [(i, ways - 1) for i in range(ways * part, size)]
    return _run(r, size, ways, bits, tables.__getitem__, plan)


def _run(r: _Input, size: int, ways: int, bits: int, table, plan) -> bytes:
    states, last, out = list(struct.unpack(f"<{ways}I", r.take(4 * ways))), [0] * ways, bytearray(size)
    mask, data, at = (1 << bits) - 1, r.data, r.at
    try:
        for i, j in plan:
            slots, spans = table(last[j])
            low = states[j] & mask
            s = slots[low]
            f, begin = spans[s]
            x = f * (states[j] >> bits) + low - begin
            if x < 1 << 15 and at + 1 < len(data):
                x = x << 16 | data[at] | data[at + 1] << 8
                at += 2
            states[j], out[i], last[j] = x, s, s
    except (IndexError, KeyError) as e:
        raise FormatError("a rANS stream is broken") from e
    r.at = at
    return bytes(out)


def _expanded(data: bytes, repeated: set[int], lengths: _Input, size: int) -> bytes:
    out = bytearray()
    for b in data:
        out += bytes([b]) * ((lengths.number() + 1) if b in repeated else 1)
    if len(out) != size:
        raise FormatError("runs don't add up")
    return bytes(out)


def _unpacked(data: bytes, symbols: bytes, size: int) -> bytes:
    if len(symbols) <= 1:
        return symbols * size
    width = 1 if len(symbols) <= 2 else 2 if len(symbols) <= 4 else 4
    each = [bytes(symbols[min(b >> k & ((1 << width) - 1), len(symbols) - 1)] for k in range(0, 8, width)) for b in range(256)]
    return b"".join(each[b] for b in data)[:size]


def rans16(data: bytes, size: int | None = None) -> bytes:
    """Decodes a stream of any order and combination of transformations."""
    r = _Input(data)
    flags = r.byte()
    size = size if flags & NO_SIZE else r.number()
    if size is None:
        raise FormatError("a stream without its size")
    ways = 32 if flags & WIDE else 4
    if flags & STRIPE:
        n = r.byte()
        packed = [r.number() for _ in range(n)]
        out = bytearray(size)
        for j, k in enumerate(packed):
            out[j::n] = rans16(r.take(k), size // n + (size % n > j))
        return bytes(out)
    full, symbols, run_size = size, b"", 0
    if flags & PACKED:
        symbols = r.take(r.byte())
        size = r.number()
    repeated: set[int] = set()
    lengths = _Input(b"")
    if flags & RUNS:
        meta, inner = r.number(), r.number()
        lengths = _Input(r.take(meta >> 1) if meta & 1 else _order0(_Input(r.take(r.number())), meta >> 1, ways))
        repeated = set(lengths.take(lengths.byte() or 256))
        run_size, size = size, inner
    if flags & PLAIN:
        out = r.take(size)
    elif not size:
        out = b""
    else:
        out = (_order1 if flags & ORDER1 else _order0)(r, size, ways)
    if flags & RUNS:
        out = _expanded(out, repeated, lengths, run_size)
    return _unpacked(out, symbols, full) if flags & PACKED else out


#: Kinds of name tokens.
KIND, ALPHA, CHAR, DIGITS0, WIDTH, DUP, DIFF, DIGITS, DELTA, DELTA0, MATCH, NOP, LAST = range(13)


def names(data: bytes) -> bytes:
    """Decodes tokenised names; each ends with a zero byte."""
    r = _Input(data)
    _, number = struct.unpack("<II", r.take(8))
    if r.byte():
        raise FormatError("arithmetic coding isn't supported")
    streams: list[dict[int, _Input]] = []
    while r.at < len(r.data):
        mark = r.byte()
        kind = mark & 63
        if mark & 128:
            streams.append({})
            if kind != KIND:
                streams[-1][KIND] = _Input(bytes([kind]) + bytes([MATCH]) * (number - 1))
        if mark & 64:
            position, of = r.byte(), r.byte()
            streams[-1][kind] = _Input(streams[position][of].data)
        else:
            streams[-1][kind] = _Input(rans16(r.take(r.number())))
    word = lambda t, kind: struct.unpack("<I", streams[t][kind].take(4))[0]
    made: list[list[str]] = []
    for n in range(number):
        kind = streams[0][KIND].byte()
        like = n - word(0, kind)
        if kind == DUP:
            made.append(made[like])
            continue
        tokens = [""]
        while True:
            t = len(tokens)
            kind = streams[t][KIND].byte() if t < len(streams) else LAST
            if kind == LAST or t >= len(streams):
                break
            if kind == CHAR:
                tokens.append(chr(streams[t][CHAR].byte()))
            elif kind == ALPHA:
                text = bytearray()
                while b := streams[t][ALPHA].byte():
                    text.append(b)
                tokens.append(text.decode("latin-1"))
            elif kind == DIGITS:
                tokens.append(str(word(t, DIGITS)))
            elif kind == DIGITS0:
                tokens.append(str(word(t, DIGITS0)).zfill(streams[t][WIDTH].byte()))
            elif kind == DELTA:
                tokens.append(str(int(made[like][t]) + streams[t][DELTA].byte()))
            elif kind == DELTA0:
                before = made[like][t]
                tokens.append(str(int(before) + streams[t][DELTA0].byte()).zfill(len(before)))
            elif kind == MATCH:
                tokens.append(made[like][t])
            elif kind == NOP:
                tokens.append("")
            else:
                raise FormatError(f"name token {kind}")
        made.append(tokens)
    return b"".join("".join(x).encode("latin-1") + b"\0" for x in made)
