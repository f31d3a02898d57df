"""CRAM 3.0 as a Python data source, with one partition for each container.

Decoded: containers, blocks (raw, gzip, bzip2, lzma, rANS 4x8 and Nx16, names), compression
headers with all integer, byte and array encodings but Golomb, slices, features
against an external or embedded reference, tags, and mates within a slice.  The
arithmetic and quality codecs of version 3.1 raise FormatError.  Single base and quality features change bases and qualities.
"""

from __future__ import annotations

import bz2
import hashlib
import lzma
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from readloom.functions.scalars import FIRST, MATE_REVERSE, MATE_UNMAPPED, REVERSE, UNMAPPED, parse_region
from readloom.sources import bgzf, codecs, indexes
from readloom.sources.bam import _ONLY_BASES, SCHEMA, _tags
from readloom.sources.bgzf import FormatError
from readloom.sources.sam import contigs as contigs_of


class Bytes:
    """A cursor over bytes with the format's integers."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError("data are cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def i32(self) -> int:
        return struct.unpack("<i", self.take(4))[0]

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def itf8(self) -> int:
        """A signed 32-bit number in one to five bytes."""
        b = self.byte()
        more = 0
        while more < 4 and b & (0x80 >> more):
            more += 1
        if more == 4:
            rest = self.take(4)
            value = (b & 0x0F) << 28 | rest[0] << 20 | rest[1] << 12 | rest[2] << 4 | rest[3] & 0x0F
        else:
            value = b & (0x7F >> more)
            for x in self.take(more):
                value = value << 8 | x
        return value - (1 << 32) if value >= 1 << 31 else value

    def ltf8(self) -> int:
        """A signed 64-bit number in one to nine bytes."""
        b, more = self.byte(), 0
        while more < 8 and b & (0x80 >> more):
            more += 1
        value = b & (0x7F >> more) if more < 7 else 0
        for x in self.take(more):
            value = value << 8 | x
        return value - (1 << 64) if value >= 1 << 63 else value

    def itf8s(self) -> list[int]:
        return [self.itf8() for _ in range(self.itf8())]


def _table(r: Bytes) -> list[tuple[int, int]]:
    """Symbols with frequencies; runs of neighbouring symbols are counted."""
    out, symbol, run = [], r.byte(), 0
    while True:
        f = r.byte()
        if f >= 128:
            f = (f & 127) << 8 | r.byte()
        out.append((symbol, f or 4096))
        if run:
            run, following = run - 1, symbol + 1
        else:
            following = r.byte()
            if following == symbol + 1:
                run = r.byte()
        symbol = following
        if not symbol:
            return out


def _spread(pairs: list[tuple[int, int]]) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """The symbol of each of 4096 slots, and each symbol's frequency and first slot."""
    slots, spans = [], {}
    for symbol, f in pairs:
        spans[symbol] = (f, len(slots))
        slots += [symbol] * f
    return slots, spans


def rans(data: bytes) -> bytes:
    """Decodes a rANS 4x8 stream of order 0 or 1."""
    r = Bytes(data)
    order, _, size = r.byte(), r.u32(), r.u32()
    if not size:
        return b""
    if order == 0:
        only = _spread(_table(r))
        tables: dict[int, tuple] = {}
    else:
        tables, context, run = {}, r.byte(), 0
        while True:
            tables[context] = _spread(_table(r))
            if run:
                run, following = run - 1, context + 1
            else:
                following = r.byte()
                if following == context + 1:
                    run = r.byte()
            context = following
            if not context:
                break
    states = [r.u32() for _ in range(4)]
    body, at = r.data, r.at
    out = bytearray(size)
    quarter = size // 4
    if order == 0:
        plan: Iterator[tuple[int, int]] = ((i, i & 3) for i in range(size))
    else:
        plan = ((j * quarter + i, j) for i in range(quarter) for j in range(4))
    last = [0, 0, 0, 0]

    def step(i: int, j: int) -> None:
        nonlocal at
        slots, spans = only if order == 0 else tables[last[j]]
        low = states[j] & 4095
        symbol = slots[low]
        f, begin = spans[symbol]
        x = f * (states[j] >> 12) + low - begin
        while x < 1 << 23 and at < len(body):
            x = x << 8 | body[at]
            at += 1
        states[j], out[i], last[j] = x, symbol, symbol

    try:
        for i, j in plan:
            step(i, j)
        if order:
            for i in range(4 * quarter, size):
                step(i, 3)
    except (IndexError, KeyError) as e:
        raise FormatError("a rANS stream is broken") from e
    return bytes(out)


UNPACK: dict[int, Callable[[bytes], bytes]] = {0: bytes, 1: lambda d: zlib.decompress(d, wbits=47), 2: bz2.decompress, 3: lzma.decompress, 4: rans, 5: codecs.rans16, 8: codecs.names}


@dataclass
class Block:
    kind: int
    number: int
    data: bytes


def block(r: Bytes) -> Block:
    begin = r.at
    method, kind, number, packed, raw = r.byte(), r.byte(), r.itf8(), r.itf8(), r.itf8()
    body = r.take(packed)
    crc = zlib.crc32(r.data[begin : r.at])
    if r.u32() != crc:
        raise FormatError("a block's checksum differs")
    if method not in UNPACK:
        raise FormatError(f"compression method {method} isn't supported")
    data = UNPACK[method](body)
    if len(data) != raw:
        raise FormatError("a block's size differs")
    return Block(kind, number, data)


@dataclass
class Container:
    length: int
    tid: int
    start: int
    span: int
    records: int
    blocks: int
    landmarks: list[int]
    header_size: int

    @staticmethod
    def parse(data: bytes) -> Container:
        r = Bytes(data)
        length, tid, start, span, n = r.i32(), r.itf8(), r.itf8(), r.itf8(), r.itf8()
        r.ltf8()
        r.ltf8()
        blocks, marks = r.itf8(), r.itf8s()
        crc = zlib.crc32(data[: r.at])
        if r.u32() != crc:
            raise FormatError("a container's checksum differs")
        return Container(length, tid, start, span, n, blocks, marks, r.at)

    @property
    def is_end(self) -> bool:
        return self.tid == -1 and self.start == 4542278 and not self.records

    def overlaps(self, tid: int, start: int, end: int) -> bool:
        """With the inclusive 0-based range; containers of several references always do."""
        return self.tid == -2 or (self.tid == tid and self.start - 1 <= end and self.start - 1 + self.span > start)


class Bits:
    """Bits of the core block, highest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        if self.at >> 3 >= len(self.data):
            raise FormatError("bits are cut off")
        b = self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
        self.at += 1
        return b

    def bits(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.bit()
        return value


@dataclass
class Streams:
    core: Bits
    external: dict[int, Bytes]

    def at(self, number: int) -> Bytes:
        return self.external.setdefault(number, Bytes(b""))


class Encoding:
    """A data series' encoding: integer(), byte() and array() read the next value."""

    def __init__(self, r: Bytes):
        self.codec = r.itf8()
        p = Bytes(r.take(r.itf8()))
        if self.codec == 1:
            self.number = p.itf8()
        elif self.codec == 3:
            symbols, lengths = p.itf8s(), p.itf8s()
            self.codes, code, last = {}, 0, 0
            for n, s in sorted(zip(lengths, symbols, strict=True)):
                code <<= n - last
                self.codes[n, code] = s
                code, last = code + 1, n
        elif self.codec == 4:
            self.length, self.value = Encoding(p), Encoding(p)
        elif self.codec == 5:
            self.stop, self.number = p.byte(), p.itf8()
        elif self.codec in (6, 7):
            self.offset, self.width = p.itf8(), p.itf8()
        elif self.codec == 9:
            self.offset = p.itf8()
        elif self.codec != 0:
            raise FormatError(f"encoding {self.codec} isn't supported")

    def _huffman(self, core: Bits) -> int:
        n, code = 0, 0
        if (0, 0) in self.codes:
            return self.codes[0, 0]
        while n < 32:
            code, n = code << 1 | core.bit(), n + 1
            if (n, code) in self.codes:
                return self.codes[n, code]
        raise FormatError("no such code")

    def integer(self, s: Streams) -> int:
        if self.codec == 1:
            return s.at(self.number).itf8()
        if self.codec == 3:
            return self._huffman(s.core)
        if self.codec == 6:
            return s.core.bits(self.width) - self.offset
        if self.codec == 7:
            ones = 0
            while s.core.bit():
                ones += 1
            n = self.width if not ones else self.width + ones - 1
            return (s.core.bits(n) | (1 << n if ones else 0)) - self.offset
        if self.codec == 9:
            zeros = 0
            while not s.core.bit():
                zeros += 1
            return (1 << zeros | s.core.bits(zeros)) - self.offset
        raise FormatError("no integer encoding")

    def byte(self, s: Streams) -> int:
        return s.at(self.number).byte() if self.codec == 1 else self.integer(s)

    def bytes(self, s: Streams, n: int) -> bytes:
        return s.at(self.number).take(n) if self.codec == 1 else bytes(self.byte(s) for _ in range(n))

    def array(self, s: Streams) -> bytes:
        if self.codec == 4:
            return self.value.bytes(s, self.length.integer(s))
        if self.codec == 5:
            r = s.at(self.number)
            end = r.data.find(self.stop, r.at)
            if end < 0:
                raise FormatError("an array has no end")
            out = r.take(end - r.at)
            r.at += 1
            return out
        raise FormatError("no array encoding")


@dataclass
class Compression:
    names: bool = True
    deltas: bool = True
    external_reference: bool = True
    substitutions: dict[str, dict[int, str]] = field(default_factory=dict)
    tag_lists: list[list[tuple[str, str, int]]] = field(default_factory=list)
    series: dict[str, Encoding] = field(default_factory=dict)
    tags: dict[int, Encoding] = field(default_factory=dict)

    @staticmethod
    def parse(data: bytes) -> Compression:
        out, r = Compression(), Bytes(data)
        p = Bytes(r.take(r.itf8()))
        for _ in range(p.itf8()):
            key = p.take(2)
            if key == b"SM":
                for base, codes in zip("ACGTN", p.take(5), strict=True):
                    others = [x for x in "ACGTN" if x != base]
                    out.substitutions[base] = {codes >> (6 - 2 * i) & 3: x for i, x in enumerate(others)}
            elif key == b"TD":
                for line in p.take(p.itf8()).split(b"\0")[:-1]:
                    parts = [line[i : i + 3] for i in range(0, len(line), 3)]
                    out.tag_lists.append([(x[:2].decode(), chr(x[2]), int.from_bytes(x, "big")) for x in parts])
            else:
                flag = bool(p.byte())
                if key == b"RN":
                    out.names = flag
                elif key == b"AP":
                    out.deltas = flag
                elif key == b"RR":
                    out.external_reference = flag
        p = Bytes(r.take(r.itf8()))
        for _ in range(p.itf8()):
            name = p.take(2).decode()
            out.series[name] = Encoding(p)
        p = Bytes(r.take(r.itf8()))
        for _ in range(p.itf8()):
            number = p.itf8()
            out.tags[number] = Encoding(p)
        return out


@dataclass
class Record:
    qname: str = ""
    flag: int = 0
    tid: int = -1
    pos: int = -1
    mapq: int = 0
    ops: list[list] = field(default_factory=list)
    seq: str = ""
    qual: list[int] = field(default_factory=list)
    next_tid: int = -1
    next_pos: int = -1
    tlen: int = 0
    aux: bytes = b""
    group: int = -1
    mate: int | None = None
    detached: bool = False

    @property
    def end(self) -> int:
        return self.pos + max(sum(n for n, op in self.ops if op in "MDN") - 1, 0)


def _add(ops: list[list], n: int, op: str) -> None:
    if n and ops and ops[-1][1] == op:
        ops[-1][0] += n
    elif n:
        ops.append([n, op])


def _features(c: Compression, s: Streams, rec: Record, length: int, reference: Callable[[int, int], str], known: bool) -> None:
    """Bases, qualities and CIGAR of a mapped read from its features."""
    get = c.series
    seq, ops, at, ref = [], rec.ops, 0, rec.pos
    rec.qual = [255] * length

    def matched(n: int) -> None:
        nonlocal at, ref
        if n > 0:
            seq.append(reference(ref, ref + n) if known else "N" * n)
            _add(ops, n, "M")
            at, ref = at + n, ref + n

    last, changed = 0, []
    for _ in range(get["FN"].integer(s)):
        code = chr(get["FC"].byte(s))
        last += get["FP"].integer(s)
        if code in "Qq":
            quals = [get["QS"].byte(s)] if code == "Q" else get["QQ"].array(s)
            changed += [(last - 1 + i, q) for i, q in enumerate(quals)]
            continue
        matched(last - 1 - at)
        if code in "BXb":
            if code == "X":
                base = c.substitutions[reference(ref, ref + 1) if known else "N"][get["BS"].byte(s)]
            elif code == "b":
                base = get["BB"].array(s).decode("latin-1")
            else:
                base = chr(get["BA"].byte(s))
                changed.append((at, get["QS"].byte(s)))
            seq.append(base)
            _add(ops, len(base), "M")
            at, ref = at + len(base), ref + len(base)
        elif code in "ISi":
            bases = chr(get["BA"].byte(s)) if code == "i" else get["IN" if code == "I" else "SC"].array(s).decode("latin-1")
            seq.append(bases)
            _add(ops, len(bases), "S" if code == "S" else "I")
            at += len(bases)
        elif code in "DNHP":
            n = get[{"D": "DL", "N": "RS", "H": "HC", "P": "PD"}[code]].integer(s)
            _add(ops, n, code)
            ref += n if code in "DN" else 0
        else:
            raise FormatError(f"feature {code!r}")
    matched(length - at)
    for i, q in changed:
        rec.qual[i] = q
    rec.seq = "".join(seq).upper().translate(_ONLY_BASES) if known else ""
    if not known:
        rec.qual = []


def _record(c: Compression, s: Streams, tid: int, before: int, reference: Callable[[int], Callable[[int, int], str]]) -> Record:
    get, rec = c.series, Record()
    rec.flag, how = get["BF"].integer(s), get["CF"].integer(s)
    rec.tid = get["RI"].integer(s) if tid == -2 else tid
    length, ap = get["RL"].integer(s), get["AP"].integer(s)
    rec.pos = before + ap if c.deltas else ap - 1
    group = get["RG"].integer(s)
    if c.names:
        rec.qname = get["RN"].array(s).decode()
    rec.detached = bool(how & 2)
    if how & 2:
        mate = get["MF"].integer(s)
        rec.flag |= (MATE_REVERSE if mate & 1 else 0) | (MATE_UNMAPPED if mate & 2 else 0)
        if not c.names:
            rec.qname = get["RN"].array(s).decode()
        rec.next_tid, rec.next_pos, rec.tlen = get["NS"].integer(s), get["NP"].integer(s) - 1, get["TS"].integer(s)
    elif how & 4:
        rec.mate = get["NF"].integer(s)
    wanted = c.tag_lists[get["TL"].integer(s)] if c.tag_lists else []
    rec.aux = b"".join(tag.encode() + kind.encode() + c.tags[number].array(s) for tag, kind, number in wanted)
    rec.group = group
    if rec.flag & UNMAPPED:
        if not how & 8:
            rec.seq = get["BA"].bytes(s, length).decode("latin-1").upper().translate(_ONLY_BASES)
        rec.qual = [255] * len(rec.seq)
    else:
        _features(c, s, rec, length, reference(rec.tid), not how & 8)
        rec.mapq = get["MQ"].integer(s)
    if how & 1:
        quals = list(get["QS"].bytes(s, length))
        rec.qual = quals if rec.seq else []
    return rec


def resolve_mates(records: list[Record]) -> None:
    """Mate fields, flags and template lengths of chains within a slice."""
    seen = set()
    for i in range(len(records)):
        if i in seen or records[i].mate is None:
            continue
        chain = [i]
        while records[chain[-1]].mate is not None:
            chain.append(chain[-1] + records[chain[-1]].mate + 1)
            if chain[-1] >= len(records):
                raise FormatError("a mate lies beyond its slice")
        seen.update(chain)
        group = [records[k] for k in chain]
        one = len({r.tid for r in group}) == 1 and not any(r.flag & UNMAPPED for r in group)
        low, high = min(r.pos for r in group), max(r.end for r in group)
        # the sign belongs to the chain's first record
        first, ends = group[0], [r.end for r in group]
        tied = sum(r.pos == low for r in group) > 1
        if first.pos == low and (first.end < high or not tied):
            sign = 1
        elif first.pos == low and tied and ends.count(high) > 1 and first.flag & FIRST:
            sign = 1
        else:
            sign = -1
        for k, r in enumerate(group):
            mate = group[(k + 1) % len(group)]
            r.next_tid, r.next_pos = mate.tid, mate.pos
            r.flag |= (MATE_REVERSE if mate.flag & REVERSE else 0) | (MATE_UNMAPPED if mate.flag & UNMAPPED else 0)
            r.tlen = 0 if not one else (high - low + 1) * (sign if r is first else -sign)
            r.qname = r.qname or group[0].qname


def slice_records(c: Compression, r: Bytes, fetch: Callable[[int, int, int], str]) -> list[Record]:
    """All records of the slice at r; fetch(tid, start, end) gives reference bases."""
    h = Bytes(block(r).data)
    tid, start, span, n = h.itf8(), h.itf8(), h.itf8(), h.itf8()
    h.ltf8()
    n_blocks, _, embedded, md5 = h.itf8(), h.itf8s(), h.itf8(), h.take(16)
    found = [block(r) for _ in range(n_blocks)]
    core = next((b.data for b in found if b.kind == 5), b"")
    s = Streams(Bits(core), {b.number: Bytes(b.data) for b in found if b.kind == 4})
    inside = next((b.data.decode("latin-1").upper() for b in found if b.kind == 4 and b.number == embedded), None)
    if inside is None and tid >= 0 and any(md5) and c.external_reference:
        if hashlib.md5(fetch(tid, start - 1, start - 1 + span).encode()).digest() != md5:
            raise FormatError("the reference differs from the one that was used to write")

    def reference(of: int) -> Callable[[int, int], str]:
        if inside is not None:
            return lambda a, z: inside[a - start + 1 : z - start + 1]
        return lambda a, z: fetch(of, a, z)

    out: list[Record] = []
    before = start - 1
    for _ in range(n):
        rec = _record(c, s, tid, before, reference)
        before = rec.pos
        out.append(rec)
    resolve_mates(out)
    return out


class Fasta:
    """Reference bases from a mounted file with its index, block-compressed files with that of their blocks (`.gzi`) as well."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.index, self.held, self.blocks = path, {}, (-1, 0, ""), None
        if path.endswith((".gz", ".bgz")):
            with open(path + ".gzi", "rb") as f:
                self.blocks = indexes.BlockIndex.parse(f.read())
        with open(path + ".fai") as f:
            rows = {x[0]: tuple(map(int, x[1:5])) for x in (line.split("\t") for line in f)}
        self.index = {i: rows[n] for i, n in enumerate(names) if n in rows}

    def __call__(self, tid: int, start: int, end: int) -> str:
        known, low, text = self.held
        if known != tid or start < low or end > low + len(text):
            length, offset, bases, width = self.index[tid]
            low, high = start, min(max(end, start + 100_000), length)
            first, last = (offset + p // bases * width + p % bases for p in (low, high))
            text = b"".join(self._bytes(first, last).split()).decode().upper()
            self.held = (tid, low, text)
        return text[start - low : end - low]


    def _bytes(self, first: int, last: int) -> bytes:
        with open(self.path, "rb") as f:
            if self.blocks is None:
                f.seek(first)
                return f.read(last - first)
            block, within = self.blocks.translate(first)
            return bgzf.Reader(f, block << 16 | within).read(last - first)


@dataclass
class Part(InputPartition):
    path: str
    offset: int
    size: int


class CramReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.fasta = options["path"], options.get("reference")
        self.region, self.keep = options.get("region"), options.get("keep_unmapped", "false") == "true"
        with open(self.path, "rb") as f:
            top = f.read(26)
            if top[:4] != b"CRAM" or top[4] != 3:
                raise FormatError("not a CRAM 3 file")
            head, self.begin = self._container(f, 26)
            f.seek(26 + head.header_size)
            data = block(Bytes(f.read(head.length))).data
        text = data[4 : 4 + struct.unpack("<i", data[:4])[0]].decode()
        self.names = [n for _, n, _ in contigs_of(text.splitlines())]
        self.lengths = [k for _, _, k in contigs_of(text.splitlines())]
        self.groups = [m[1] for x in text.splitlines() if x.startswith("@RG") and (m := re.search(r"\tID:([^\t]+)", x))]
        self.range = None
        if self.region:
            wanted = parse_region(self.region)
            tid = self.names.index(wanted.contig)
            self.range = (tid, *wanted.zero_based(self.lengths[tid]))

    @staticmethod
    def _container(f, at: int) -> tuple[Container, int]:
        """The container at an offset and where the next begins; its header may have any length."""
        size = 4096
        while True:
            f.seek(at)
            data = f.read(size)
            try:
                c = Container.parse(data)
                return c, at + c.header_size + c.length
            except FormatError as e:
                if len(data) < size or "cut off" not in str(e):
                    raise
                size *= 8

    def _indexed(self) -> list[int] | None:
        """Offsets of containers that may hold reads of the region (or any), by the file's index; None without one."""
        name = self.path + ".crai"
        if not os.path.exists(name):
            return None
        with open(name, "rb") as f:
            entries = indexes.parse_crai(f.read())
        wanted = entries if self.range is None else indexes.query_crai(entries, *self.range)
        return sorted({e.container for e in wanted if self.keep or e.tid != -1})

    def partitions(self) -> list[Part]:
        """One for each container; with an index only the wanted containers' headers are read."""
        out, at, size = [], self.begin, os.path.getsize(self.path)
        known = self._indexed()
        with open(self.path, "rb") as f:
            while at < size if known is None else known:
                at = at if known is None else known.pop(0)
                c, following = self._container(f, at)
                if not c.is_end and (self.range is None or c.overlaps(*self.range)):
                    out.append(Part(self.path, at + c.header_size, c.length))
                at = following
        return out or [Part(self.path, 0, 0)]

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.size:
            return
        with open(part.path, "rb") as f:
            f.seek(part.offset)
            r = Bytes(f.read(part.size))
        fetch = Fasta(self.fasta, self.names) if self.fasta else _no_reference
        c = Compression.parse(block(r).data)
        while r.at < len(r.data):
            for x in slice_records(c, r, fetch):
                if not self.keep and (x.flag & UNMAPPED or x.tid < 0):
                    continue
                if self.range and (x.tid != self.range[0] or x.pos > self.range[2] or x.end < self.range[1]):
                    continue
                contig = self.names[x.tid] if x.tid >= 0 else None
                ops = [(n, op) for n, op in x.ops]
                aux = _tags(x.aux, 0)
                if 0 <= x.group < len(self.groups):
                    aux.setdefault("RG", ("Z", self.groups[x.group]))
                yield x.qname, x.flag, x.tid, contig, x.pos, x.mapq, ops, x.seq, x.qual, x.next_tid, x.next_pos, x.tlen, aux


def _no_reference(tid: int, start: int, end: int) -> str:
    raise FormatError("a reference is needed: set the option reference to an indexed FASTA file")


class CramSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cram"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CramReader:
        return CramReader(self.options)
