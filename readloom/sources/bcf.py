"""Binary and block-compressed variant files, written from sorted rows with an index beside each part."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.sources import bgzf, parts
from readloom.sources.indexes import BinIndex
from readloom.sources.vcf import Header

#: Type codes, and the missing and end-of-vector values of the integer types.
INT8, INT16, INT32, FLOAT, CHAR = 1, 2, 3, 5, 7
MISSING = {INT8: -(2**7), INT16: -(2**15), INT32: -(2**31)}
END = {k: v + 1 for k, v in MISSING.items()}
_PACK = {INT8: "b", INT16: "h", INT32: "i"}
FLOAT_MISSING, FLOAT_END = b"\x01\0\x80\x7f", b"\x02\0\x80\x7f"


def int_type(values: list[int | None]) -> int:
    """The smallest type that holds the values besides its eight reserved ones."""
    known = [v for v in values if v is not None]
    low, high = min(known, default=0), max(known, default=0)
    return INT8 if low >= -120 and high <= 127 else INT16 if low >= -32760 and high <= 32767 else INT32


def descriptor(n: int, kind: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([0xF0 | kind]) + ints([n])


def ints(values: list[int | None], kind: int | None = None) -> bytes:
    kind = kind or int_type(values)
    return descriptor(len(values), kind) + ints_only(values, kind)


def ints_only(values: list[int | None], kind: int) -> bytes:
    return struct.pack(f"<{len(values)}{_PACK[kind]}", *(MISSING[kind] if v is None else v for v in values))


def floats(values: list[float | None]) -> bytes:
    return descriptor(len(values), FLOAT) + b"".join(FLOAT_MISSING if v is None else struct.pack("<f", v) for v in values)


def text(value: str) -> bytes:
    data = value.encode()
    return descriptor(len(data), CHAR) + data


def genotypes(samples: list[str]) -> bytes:
    """GT texts of one ploidy; raises ValueError for mixed ones."""
    rows = []
    for s in samples:
        parts, phased = s.replace("|", "/").split("/"), [False] + [c == "|" for c in s if c in "/|"]
        rows.append([(0 if a == "." else (int(a) + 1) << 1) | p for a, p in zip(parts, phased, strict=True)])
    if len({len(r) for r in rows}) > 1:
        raise ValueError("samples differ in ploidy")
    flat = [x for r in rows for x in r]
    kind = int_type(flat)
    return descriptor(len(rows[0]), kind) + ints_only(flat, kind)


class Dictionary:
    """Numbers of filters, INFO and FORMAT fields, PASS first, and of contigs."""

    def __init__(self, header: Header):
        names = ["PASS", *header.filters, *header.infos, *header.formats]
        self.strings = {n: i for i, n in enumerate(dict.fromkeys(names))}
        self.contigs = {n: i for i, n in enumerate(header.contigs)}
        self.kinds = {**{k: v[1] for k, v in header.formats.items()}, **{k: v[1] for k, v in header.infos.items()}}


def _value(kind: str, value: str) -> bytes:
    many = [None if x == "." else x for x in value.split(",")]
    if kind == "Integer":
        return ints([None if x is None else int(x) for x in many])
    if kind == "Float":
        return floats([None if x is None else float(x) for x in many])
    return b"\0" if kind == "Flag" else text(value)


def record(line: str, names: Dictionary, n_samples: int) -> bytes:
    """A binary record of a body line of variant text."""
    contig, pos, name, ref, alt, qual, passed, info, *rest = line.split("\t")
    alts = [] if alt == "." else alt.split(",")
    fields = [] if info == "." else [x.partition("=")[::2] for x in info.split(";")]
    form = rest[0].split(":") if rest and rest[0] != "." else []
    samples = [x.split(":") for x in rest[1:]]
    if len(samples) != (n_samples if form else len(samples)):
        raise ValueError("the number of samples differs from the header's")
    shared = struct.pack("<iii", names.contigs[contig], int(pos) - 1, len(ref))
    shared += FLOAT_MISSING if qual == "." else struct.pack("<f", float(qual))
    shared += struct.pack("<II", (1 + len(alts)) << 16 | len(fields), len(form) << 24 | n_samples)
    shared += text("" if name == "." else name) + b"".join(map(text, [ref, *alts]))
    shared += descriptor(0, 0) if passed == "." else ints([names.strings[x] for x in passed.split(";")])
    for key, value in fields:
        shared += ints([names.strings[key]]) + _value(names.kinds[key], value)
    own = b""
    for i, key in enumerate(form):
        values = [s[i] if i < len(s) else "." for s in samples]
        own += ints([names.strings[key]])
        if key == "GT":
            own += genotypes(values)
        elif names.kinds[key] == "Integer":
            rows = [[None if x == "." else int(x) for x in v.split(",")] for v in values]
            width, kind = max(map(len, rows)), int_type([x for r in rows for x in r])
            own += descriptor(width, kind)
            for r in rows:
                own += ints_only(r, kind) + struct.pack(f"<{width - len(r)}{_PACK[kind]}", *[END[kind]] * (width - len(r)))
        elif names.kinds[key] == "Float":
            rows = [[None if x == "." else float(x) for x in v.split(",")] for v in values]
            width = max(map(len, rows))
            own += descriptor(width, FLOAT)
            for r in rows:
                own += b"".join(FLOAT_MISSING if x is None else struct.pack("<f", x) for x in r) + FLOAT_END * (width - len(r))
        else:
            data = [v.encode() for v in values]
            width = max(map(len, data))
            own += descriptor(width, CHAR) + b"".join(d.ljust(width, b"\0") for d in data)
    return struct.pack("<II", len(shared), len(own)) + shared + own


def _write_part(rows: Iterator, header: Header, path: str, index_path: str, binary: bool) -> None:
    names, index = Dictionary(header), BinIndex()
    top = "\n".join(header.lines()) + "\n"
    with open(path, "wb") as f:
        w = bgzf.Writer(f)
        w.write(b"BCF\2\2" + struct.pack("<I", len(top) + 1) + top.encode() + b"\0" if binary else top.encode())
        w.flush()
        for row in rows:
            a = w.offset
            w.write(record(row.line, names, len(header.samples)) if binary else row.line.encode() + b"\n")
            start = row.pos1 - 1
            index.add(names.contigs[row.contig], start, start + max(len(row.line.split("\t", 4)[3]), 1), a, w.offset)
        w.close()
    with open(index_path, "wb") as f:
        f.write(index.encoded_csi() if binary else index.encoded_tabix(list(header.contigs)))


def write(lines: DataFrame, header: Header, path: str, binary: bool = True) -> None:
    """Sorted part files of lines(contig, pos1, line) under a path that all executors mount: BCF with CSI, or VCF with tabix indexes."""
    rank = F.create_map(*(F.lit(x) for i, c in enumerate(header.contigs) for x in (c, i)))
    known = F.try_element_at(rank, F.col("contig"))
    known = F.when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("no contig "), "contig")).cast("int"))
    sorted_ = lines.withColumn("rank", known).repartitionByRange("rank", "pos1").sortWithinPartitions("rank", "pos1", "line")
    suffix, index = (".bcf", ".csi") if binary else (".vcf.gz", ".tbi")
    parts.write(sorted_.select("contig", "pos1", "line"), path, suffix, index, lambda rows, file, at: _write_part(rows, header, file, at, binary))
