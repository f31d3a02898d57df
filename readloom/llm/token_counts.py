"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text of up to a chunk is cut at all boundaries that are proven below.  The
library encodes each different piece once and its count is held for later
texts, so a text's count is the sum of its pieces' counts, as cutting at such
a boundary changes no token.

A text longer than a chunk is encoded in overlapping chunks with offsets.  Two
neighbouring chunks are spliced at a boundary in their overlap that

* is the start of a token in both encodings,
* stands between a character that surely is no white space and a blank or
  newline, where the byte-level pre-tokeniser splits whatever the context
  (no pattern of it matches a non-space followed by a space, and the added
  special strings hold no white space), and
* is followed by equal tokens in both, up to the last such boundary.

If the overlap holds no such boundary it is doubled, up to the whole rest of
the document.  So the count is the count of the undivided text.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

CHUNK, OVERLAP, LIMIT = 32_768, 256, 512
_BATCH_CHARS = 1 << 20
#: Characters of the pieces whose counts a worker holds; beyond that it forgets them all and begins anew.
HELD_CHARS = 1 << 22
#: Characters of held pieces from which on texts that are new for more than half are encoded whole: that is cheaper.
COLD_CHARS = 1 << 18
#: Pieces that go to the library at once.
_BATCH_PIECES = 1 << 15
_loaded: dict[str, object] = {}
_held: dict[str, _Held] = {}


def load(tokenizer: str):
    """The tokenizers object of a .json file, given by its name among the public tokenizers or its path."""
    if tokenizer not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer
        if os.sep not in tokenizer:
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        made = Tokenizer.from_file(str(path))
        spec = json.loads(made.to_str())
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{tokenizer}: boundaries are proven stable for byte-level pre-tokenisers without prefix space and normaliser only")
        if any(a["rstrip"] or a["lstrip"] or a["single_word"] or any(c.isspace() for c in a["content"]) for a in spec["added_tokens"]):
            raise ValueError(f"{tokenizer}: an added token holds or looks at white space, where texts are cut")
        made.no_truncation()
        made.no_padding()
        _loaded[tokenizer] = made
    return _loaded[tokenizer]


def _stable(text: str, at: int) -> bool:
    before = text[at - 1]
    return text[at] in " \n" and ("!" <= before <= "~" or before.isalnum())


#: A piece up to the next _stable() boundary or the end; it may be empty at the end.
_PIECE = re.compile(r"[ \n]*[^ \n]*(?:(?<![!-~\w])[ \n]+[^ \n]*)*")


class _Held(dict[str, int]):
    """Tokens of the pieces met so far."""

    def __init__(self, coder):
        self.coder, self.chars = coder, 0

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if self.chars > HELD_CHARS:
            self.clear()
            self.chars = 0
        cut = [_PIECE.findall(t) for t in texts]
        new = list(set().union(*cut).difference(self))
        fresh = sum(map(len, new))
        if self.chars > COLD_CHARS and 2 * fresh > sum(map(len, texts)):
            return [len(e) for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]
        self.chars += fresh
        for at in range(0, len(new), _BATCH_PIECES):
            part = new[at : at + _BATCH_PIECES]
            self.update(zip(part, map(len, self.coder.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return [sum(map(self.__getitem__, pieces)) for pieces in cut]


class _Chunk:
    """Tokens of text[start:end] with absolute start offsets."""

    def __init__(self, encode, text: str, start: int, end: int):
        made = encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, min(end, len(text)), made.ids
        self.begins = [start + a for a, _ in made.offsets]

    def first(self, at: int) -> int:
        return bisect_left(self.begins, at)


def common_boundary(text: str, left: _Chunk, right: _Chunk) -> int | None:
    """The first proven boundary in the overlap after which both chunks agree, or None."""
    ours, theirs = set(left.begins[left.first(right.start + 1) :]), right.begins
    shared = [b for b in theirs if right.start < b < left.end and b in ours and _stable(text, b)]
    if len(shared) < 2:
        return None
    a, z = shared[0], shared[-1]
    agree = left.ids[left.first(a) : left.first(z)] == right.ids[right.first(a) : right.first(z)]
    return a if agree else None


def count_huge(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """(tokens, chunks, widenings) of one text; encode takes a string and add_special_tokens."""
    total, counted, pieces, widened = 0, 0, 1, 0
    left, size, width = _Chunk(encode, text, 0, chunk), chunk, overlap
    while left.end < len(text):
        right = _Chunk(encode, text, left.end - width, left.end - width + max(size, 2 * width))
        at = common_boundary(text, left, right)
        if at is None or at <= counted:
            widened += 1
            width *= 2
            if width >= left.end - counted:
                # nothing to splice at in all of the left chunk: encode it anew, twice as long
                size = 2 * (left.end - left.start)
                left, width = _Chunk(encode, text, left.start, left.start + size), overlap
            continue
        total += left.first(at) - left.first(counted)
        left, counted, size, width = right, at, chunk, overlap
        pieces += 1
    return total + len(left.ids) - left.first(counted), pieces, widened


def counted(column: pa.Array, tokenizer: str, chunk: int, overlap: int) -> tuple[list[int], list[int], list[int]]:
    """Tokens, chunks and widenings of each text."""
    coder, texts = load(tokenizer), column.to_pylist()
    held = _held.setdefault(tokenizer, _Held(coder))
    tokens, chunks, widened = [0] * len(texts), [1] * len(texts), [0] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        for i, n in zip(group, held.totals([texts[i] for i in group]), strict=True):
            tokens[i] = n
        group.clear()

    for i, text in enumerate(texts):
        if len(text) > chunk:
            tokens[i], chunks[i], widened[i] = count_huge(coder.encode, text, chunk, overlap)
        elif text:
            group.append(i)
            size += len(text)
            if size > _BATCH_CHARS:
                flush()
                size = 0
    flush()
    return tokens, chunks, widened


def _counter(tokenizer: str, chunk: int, overlap: int, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            tokens, chunks, widened = (pa.array(x, pa.int64()) for x in counted(column, tokenizer, chunk, overlap))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(column).cast(pa.int64()), tokens, pc.greater(tokens, limit), chunks, widened],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    return count


def with_token_counts(docs: DataFrame, column: str = "n_tokens", tokenizer: str = "byte_bpe_50k.json", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with a further column: the tokens of each whole text; docs must not have it yet."""
    if column in docs.columns:
        raise ValueError(f"there is a column {column} already")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            tokens = pa.array(counted(texts, tokenizer, chunk, overlap)[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*batch.schema.names, column])

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(column, LongType())]))


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    limit: int = LIMIT,
) -> DataFrame:
    """Tokens of every whole text, a row for each row of docs(doc_id, text, ...); other columns are ignored.

    A null text counts as empty: 0 bytes, 0 tokens.  A null doc_id stays null,
    repeated rows stay repeated, an empty table gives an empty result.  The
    plan is one scan and one Arrow map, without a shuffle.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("overlap must be positive and at most half a chunk")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _counter(tokenizer, chunk, overlap, limit),
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long",
    )
