"""A small writer with external encodings, and codecs against plain versions."""

import bz2
import gzip
import hashlib
import lzma
import random
import struct
import zlib
from collections import Counter

import pytest

from readloom.sources import codecs, cram
from readloom.sources.bgzf import FormatError

RNG = random.Random(12)


def itf8(n):
    n &= 0xFFFFFFFF
    if n < 0x80:
        return bytes([n])
    if n < 0x4000:
        return bytes([0x80 | n >> 8, n & 255])
    if n < 0x200000:
        return bytes([0xC0 | n >> 16, n >> 8 & 255, n & 255])
    if n < 0x10000000:
        return bytes([0xE0 | n >> 24, n >> 16 & 255, n >> 8 & 255, n & 255])
    return bytes([0xF0 | n >> 28, n >> 20 & 255, n >> 12 & 255, n >> 4 & 255, n & 15])


def test_varints():
    for n in (0, 1, 127, 128, 16383, 16384, 2097151, 2097152, 2**28, 2**31 - 1, -1, -2):
        assert cram.Bytes(itf8(n)).itf8() == n
    assert cram.Bytes(b"\x7f").ltf8() == 127 and cram.Bytes(b"\x80\xff").ltf8() == 255
    assert cram.Bytes(b"\xff" * 9).ltf8() == -1 and cram.Bytes(b"\xfe" + b"\x01" * 7).ltf8() == 0x01010101010101


def frequencies(counts):
    """Shares of 4096, each at least 1."""
    total = sum(counts.values())
    f = {s: max(1, n * 4096 // total) for s, n in counts.items()}
    top = max(f, key=f.get)
    f[top] += 4096 - sum(f.values())
    return dict(sorted(f.items()))


def table_bytes(f):
    symbols, out, i = list(f), b"", 0
    number = lambda n: bytes([n]) if n < 128 else bytes([128 | n >> 8, n & 255])
    run = 0
    for i, s in enumerate(symbols):
        if run:
            run -= 1
        else:
            out += bytes([s])
            if i and s == symbols[i - 1] + 1:
                run = 0
                while i + run + 1 < len(symbols) and symbols[i + run + 1] == s + run + 1:
                    run += 1
                out += bytes([run])
        out += number(f[s] % 4096)
    return out + b"\0"


def encode(data, order):
    quarter = len(data) // 4
    if order == 0:
        tables = {None: frequencies(Counter(data))}
        steps = [(i, i & 3, None) for i in range(len(data))]
        head = table_bytes(tables[None])
    else:
        begins = [j * quarter for j in range(4)]
        before = lambda i: 0 if i in begins else data[i - 1]
        contexts = {}
        for i in range(len(data)):
            contexts.setdefault(before(i), Counter())[data[i]] += 1
        tables = {c: frequencies(n) for c, n in sorted(contexts.items())}
        steps = [(j * quarter + i, j, before(j * quarter + i)) for i in range(quarter) for j in range(4)]
        steps += [(i, 3, before(i)) for i in range(4 * quarter, len(data))]
        head, names, run = b"", list(tables), 0
        for i, c in enumerate(names):
            if run:
                run -= 1
            else:
                head += bytes([c])
                if i and c == names[i - 1] + 1:
                    while i + run + 1 < len(names) and names[i + run + 1] == c + run + 1:
                        run += 1
                    head += bytes([run])
            head += table_bytes(tables[c])
        head += b"\0"
    states, out = [1 << 23] * 4, bytearray()
    for i, j, c in reversed(steps):
        f, begin = tables[c][data[i]], sum(n for s, n in tables[c].items() if s < data[i])
        while states[j] >= f << 19:
            out.append(states[j] & 255)
            states[j] >>= 8
        states[j] = states[j] // f << 12 | states[j] % f + begin
    body = head + struct.pack("<4I", *states) + bytes(reversed(out))
    return bytes([order]) + struct.pack("<II", len(body), len(data)) + body


@pytest.mark.parametrize("order", [0, 1])
def test_rans(order):
    for data in (b"abracadabra" * 30, bytes(RNG.choice(b"ACGT\0\1\2\3") for _ in range(1003)), b"x" * 50, bytes(range(256)) * 3):
        assert cram.rans(encode(data, order)) == data
    with pytest.raises(FormatError):
        cram.rans(encode(b"abracadabra" * 9, order)[:14])


def test_rans_16_bit():
    u7 = lambda n: bytes([n]) if n < 128 else bytes([0x80 | n >> 7, n & 127])
    for order, ways in ((0, 4), (0, 32), (1, 4), (1, 32)):
        for data in (b"abracadabra" * 30, bytes(RNG.choice(b"ACGT\0\1\2\3") for _ in range(1003)), b"xy" * 50):
            assert codecs.rans16(encode16(data, order, ways)) == data
    assert codecs.rans16(bytes([32]) + u7(300) + b"q" * 300) == b"q" * 300
    # two symbols in eight to a byte: 0101 0011 -> from the lowest bit on
    assert codecs.rans16(bytes([32 | 128]) + u7(10) + b"\x02AB" + u7(2) + b"\xca\x01") == b"ABABAABBBA"
    # runs of A, lengths plain in the metadata
    meta = b"\x01A" + u7(4) + u7(0)
    assert codecs.rans16(bytes([32 | 64]) + u7(8) + u7(len(meta) << 1 | 1) + u7(4) + meta + b"ABAC") == b"AAAAABAC"
    part = lambda x: bytes([32]) + u7(len(x)) + x
    parts = [part(b"ADG"), part(b"BE"), part(b"CF")]
    assert codecs.rans16(bytes([8]) + u7(7) + b"\x03" + b"".join(u7(len(x)) for x in parts) + b"".join(parts)) == b"ABCDEFG"
    with pytest.raises(FormatError):
        codecs.rans16(b"\x00\x05\x01")


def encode16(data, order, ways):
    u7 = lambda n: bytes([n]) if n < 128 else bytes([0x80 | n >> 7, n & 127])

    def alphabet(symbols):
        out, run = b"", 0
        for i, s in enumerate(symbols):
            if run:
                run -= 1
                continue
            out += bytes([s])
            if i and s == symbols[i - 1] + 1:
                while i + run + 1 < len(symbols) and symbols[i + run + 1] == s + run + 1:
                    run += 1
                out += bytes([run])
        return out + b"\0"

    part = len(data) // ways
    if order == 0:
        tables = {None: frequencies(Counter(data))}
        steps = [(i, i % ways, None) for i in range(len(data))]
        head = alphabet(list(tables[None])) + b"".join(map(u7, tables[None].values()))
    else:
        begins = {j * part for j in range(ways)}
        before = lambda i: 0 if i in begins else data[i - 1]
        counts = {}
        for i in range(len(data)):
            counts.setdefault(before(i), Counter())[data[i]] += 1
        tables = {c: frequencies(n) for c, n in counts.items()}
        steps = [(j * part + i, j, before(j * part + i)) for i in range(part) for j in range(ways)]
        steps += [(i, ways - 1, before(i)) for i in range(ways * part, len(data))]
        symbols = sorted({*data, 0})
        head = bytes([12 << 4]) + alphabet(symbols)
        for c in symbols:
            row, j = [tables.get(c, {}).get(s, 0) for s in symbols], 0
            while j < len(row):
                head += u7(row[j])
                if not row[j]:
                    run = next((k for k in range(j + 1, len(row)) if row[k]), len(row)) - j - 1
                    head += bytes([run])
                    j += run
                j += 1
    states, out = [1 << 15] * ways, []
    for i, j, c in reversed(steps):
        f, begin = tables[c][data[i]], sum(n for s, n in tables[c].items() if s < data[i])
        if states[j] >= f << 19:
            out.append(struct.pack("<H", states[j] & 0xFFFF))
            states[j] >>= 16
        states[j] = states[j] // f << 12 | states[j] % f + begin
    return bytes([order | (4 if ways == 32 else 0)]) + u7(len(data)) + head + struct.pack(f"<{ways}I", *states) + b"".join(reversed(out))


def test_names():
    u7 = lambda n: bytes([n]) if n < 128 else bytes([0x80 | n >> 7, n & 127])
    stream = lambda kind, data, new=False: bytes([kind | (128 if new else 0)]) + u7(len(p := bytes([32]) + u7(len(data)) + data)) + p
    word = lambda *n: struct.pack(f"<{len(n)}I", *n)
    # r007:9, then r008:9, the same again, and r012:30
    body = stream(0, bytes([6, 6, 5, 6]), True) + stream(6, word(0, 1, 2)) + stream(5, word(1))
    body += stream(0, bytes([2, 10, 10]), True) + stream(2, b"r")
    body += stream(0, bytes([3, 9, 9]), True) + stream(3, word(7)) + stream(4, b"\x03") + stream(9, bytes([1, 5]))
    body += stream(0, bytes([1, 10, 10]), True) + stream(1, b":\0")
    body += stream(0, bytes([7, 10, 8]), True) + stream(7, word(9)) + stream(8, bytes([21]))
    body += stream(0, bytes([12, 12, 12]), True)
    assert codecs.names(word(24, 4) + b"\0" + body) == b"r007:9\0r008:9\0r008:9\0r013:30\0"


def block(kind, number, data, method=0, packed=None):
    body = bytes([method, kind]) + itf8(number) + itf8(len(packed if packed is not None else data)) + itf8(len(data)) + (packed if packed is not None else data)
    return body + struct.pack("<I", zlib.crc32(body))


def test_blocks():
    data = b"some data " * 40
    packed = {1: gzip.compress(data), 2: bz2.compress(data), 3: lzma.compress(data), 4: encode(data, 1)}
    for method, p in packed.items():
        assert cram.block(cram.Bytes(block(4, 7, data, method, p))).data == data
    broken = bytearray(block(4, 7, data))
    broken[10] ^= 1
    with pytest.raises(FormatError):
        cram.block(cram.Bytes(bytes(broken)))
    with pytest.raises(FormatError):
        cram.block(cram.Bytes(block(4, 7, data, 6, data)))


def codec(number, params):
    return cram.Encoding(cram.Bytes(itf8(number) + itf8(len(params)) + params))


def core(bits):
    bits += "0" * (-len(bits) % 8)
    return cram.Streams(cram.Bits(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))), {})


def test_bit_encodings():
    assert codec(6, itf8(3) + itf8(5)).integer(core("10101")) == 18
    assert [codec(9, itf8(1)).integer(core(b)) for b in ("1", "010", "00111")] == [0, 1, 6]
    assert [codec(7, itf8(0) + itf8(2)).integer(core(b)) for b in ("011", "1010", "11000100")] == [3, 6, 9]
    huffman = codec(3, itf8(3) + b"".join(map(itf8, (65, 66, 67))) + itf8(3) + b"".join(map(itf8, (1, 2, 2))))
    s = core("01011")
    assert [huffman.byte(s) for _ in range(3)] == [65, 66, 67]
    assert codec(3, itf8(1) + itf8(9) + itf8(1) + itf8(0)).integer(core("")) == 9


SERIES = ["BF", "CF", "RL", "AP", "RG", "MF", "NS", "NP", "TS", "NF", "TL", "FN", "FC", "FP", "DL", "RS", "HC", "PD", "MQ", "BA", "QS", "BS"]
ARRAYS = ["RN", "IN", "SC", "BB", "QQ"]


class Maker:
    def __init__(self):
        self.data = {k: bytearray() for k in SERIES + ARRAYS + ["tag"]}

    def put(self, key, value):
        if key in ARRAYS:
            self.data[key] += value + b"\t"
        elif key in ("FC", "BA", "QS", "BS"):
            self.data[key] += bytes(value if isinstance(value, (list, bytes)) else [value])
        else:
            self.data[key] += itf8(value)


def container(tid, start, span, n, blocks, landmarks):
    body = b"".join(blocks)
    head = struct.pack("<i", len(body)) + itf8(tid) + itf8(start) + itf8(span) + itf8(n) + b"\0\0" + itf8(len(blocks)) + itf8(len(landmarks)) + b"".join(map(itf8, landmarks))
    return head + struct.pack("<I", zlib.crc32(head)) + body


REF = "".join(RNG.choice("ACGT") for _ in range(400))


def write(path, reads, embedded=False):
    """reads: (name, flag, pos0, length, features, mate offset or None, detached mate or None, quals or None)."""
    m = Maker()
    ids = {k: i + 1 for i, k in enumerate([*SERIES, *ARRAYS, "tag"])}
    before = reads[0][2]
    for name, flag, pos, length, features, mate, detached, quals in reads:
        m.put("BF", flag)
        m.put("CF", (1 if quals else 0) | (2 if detached else 0) | (4 if mate is not None else 0))
        m.put("RL", length)
        m.put("AP", pos - before)
        before = pos
        m.put("RG", -1)
        m.put("RN", name)
        if detached:
            for k, v in zip(("MF", "NS", "NP", "TS"), detached, strict=True):
                m.put(k, v)
        elif mate is not None:
            m.put("NF", mate)
        m.put("TL", 0)
        m.put("FN", len(features))
        last = 0
        for at, code, *values in features:
            m.put("FC", ord(code))
            m.put("FP", at - last)
            last = at
            for key, value in values:
                m.put(key, value)
        m.put("MQ", 37)
        if quals:
            m.put("QS", quals)
    external = lambda k: itf8(1) + itf8(len(itf8(ids[k]))) + itf8(ids[k])
    stop = lambda k: itf8(5) + itf8(1 + len(itf8(ids[k]))) + b"\t" + itf8(ids[k])
    sized = lambda x: itf8(len(x)) + x
    kept = itf8(5) + b"RN\1AP\1RR\1SM" + bytes([0b00011011] * 5) + b"TD" + sized(b"NMC\0")
    series = itf8(len(SERIES) + len(ARRAYS)) + b"".join(k.encode() + external(k) for k in SERIES) + b"".join(k.encode() + stop(k) for k in ARRAYS)
    length = itf8(3) + sized(itf8(1) + itf8(1) + itf8(1) + itf8(0))
    tag = itf8(4) + sized(length + external("tag"))
    m.data["tag"] = bytearray(range(len(reads)))
    tags = itf8(1) + itf8(int.from_bytes(b"NMC", "big")) + tag
    head = block(1, 0, sized(kept) + sized(series) + sized(tags))
    start, end = reads[0][2], 400
    blocks = [block(4, ids[k], bytes(v)) for k, v in m.data.items() if v]
    inner = -1
    if embedded:
        inner = 99
        blocks.append(block(4, 99, REF[start:end].encode()))
    blocks.append(block(5, 0, b""))
    md5 = bytes(16) if embedded else hashlib.md5(REF[start:end].encode()).digest()
    numbers = [*[ids[k] for k, v in m.data.items() if v]]
    top = itf8(0) + itf8(start + 1) + itf8(end - start) + itf8(len(reads)) + b"\0" + itf8(len(blocks)) + itf8(len(numbers)) + b"".join(map(itf8, numbers)) + itf8(inner) + md5
    slice_head = block(2, 0, top)
    text = b"@HD\tVN:1.6\n@SQ\tSN:c1\tLN:400\n"
    file_head = container(0, 0, 0, 0, [block(0, 0, struct.pack("<i", len(text)) + text)], [0])
    end_mark = container(-1, 4542278, 0, 0, [block(1, 0, b"\1\0\1\0\1\0")], [])
    path.write_bytes(b"CRAM\3\0" + bytes(20) + file_head + container(0, start + 1, end - start, len(reads), [head, slice_head, *blocks], [len(head)]) + end_mark)


READS = [
    (b"a", 99, 10, 20, [], 1, None, list(range(20))),
    (b"b", 0, 12, 12, [(1, "S", ("SC", b"GG")), (5, "I", ("IN", b"TT")), (9, "D", ("DL", 3)), (12, "i", ("BA", ord("C")))], None, (2, -1, 0, 0), None),
    (b"a", 147, 50, 10, [(2, "X", ("BS", 1)), (4, "N", ("RS", 30)), (10, "b", ("BB", b"N"))], None, None, [9] * 10),
    (b"c", 0, 90, 6, [(1, "H", ("HC", 4)), (3, "B", ("BA", ord("T")), ("QS", 8)), (4, "Q", ("QS", 5)), (5, "q", ("QQ", b"\6\7")), (6, "P", ("PD", 2))], None, (0, -1, 0, 0), None),
]


@pytest.mark.parametrize("embedded", [False, True])
def test_file(spark, tmp_path, embedded):
    write(tmp_path / "x.cram", READS, embedded)
    (tmp_path / "r.fa").write_text(">c1\n" + "\n".join(REF[i : i + 50] for i in range(0, 400, 50)) + "\n")
    (tmp_path / "r.fa.fai").write_text("c1\t400\t4\t50\t51\n")
    spark.dataSource.register(cram.CramSource)
    load = lambda **o: spark.read.format("cram").options(**({} if embedded else {"reference": str(tmp_path / "r.fa")}), **o).load(str(tmp_path / "x.cram"))
    a, b, a2, c = load().orderBy("pos").collect()
    text = lambda r: "".join(f"{o.len}{o.op}" for o in r.ops)
    assert (a.qname, a.pos, text(a), a.seq, a.qual) == ("a", 10, "20M", REF[10:30], list(range(20)))
    assert text(b) == "2S2M2I2M3D3M1I" and b.seq == "GG" + REF[12:14] + "TT" + REF[14:16] + REF[19:22] + "C"
    assert b.flag & 8 and b.qual == [255] * 12
    others = [x for x in "ACGTN" if x != REF[51]]
    assert text(a2) == "3M30N7M" and a2.seq == REF[50] + others[1] + REF[52] + REF[83:89] + "N"
    assert (a.next_pos, a.tlen, a2.next_pos, a2.tlen) == (50, 80, 10, -80)
    assert text(c) == "4H5M2P1M" and c.seq == REF[90:92] + "T" + REF[93:96] and c.qual == [255, 255, 8, 5, 6, 7]
    assert [r.aux["NM"].value for r in (a, b, a2, c)] == ["0", "1", "2", "3"]
    assert [r.qname for r in load(region="c1:31-60").collect()] == ["a"]


def test_wrong_reference_and_version(spark, tmp_path):
    write(tmp_path / "x.cram", READS)
    (tmp_path / "r.fa").write_text(">c1\n" + "A" * 400 + "\n")
    (tmp_path / "r.fa.fai").write_text("c1\t400\t4\t400\t401\n")
    reader = cram.CramReader({"path": str(tmp_path / "x.cram"), "reference": str(tmp_path / "r.fa")})
    with pytest.raises(FormatError):
        list(reader.read(reader.partitions()[0]))
    (tmp_path / "y.cram").write_bytes(b"CRAM\2\1" + bytes(40))
    with pytest.raises(FormatError):
        cram.CramReader({"path": str(tmp_path / "y.cram")})
