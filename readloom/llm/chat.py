"""Chat formatting: schema fingerprints choose a mapping to canonical turns, a template writes them.

A record's layout is the set of its nested field paths (arrays add `[]`).  The
hash of the sorted paths that any mapping knows selects a declarative mapping,
which says where the turns lie; unknown further fields don't matter.  Canonical
turns are rows (conv_id, turn, role, text).

The template writes each turn as a segment with its loss mask, so a conversation
of any length is formatted row by row and never gathered.  Control strings
within roles and texts are broken up by a backslash and can be restored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
TURNS = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Mapping:
    """Turns of one layout.

    single: (role, paths) per turn; the texts of several paths are joined by a blank line.
    many: (array path, role field, text field) for an array of messages.
    row: (turn, role, text) fields of a record that is one turn itself.
    """

    name: str
    single: tuple[tuple[str, tuple[str, ...]], ...] = ()
    many: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None

    @property
    def paths(self) -> frozenset[str]:
        if self.row:
            return frozenset(self.row)
        if self.many:
            array, role, text = self.many
            return frozenset((f"{array}[].{role}", f"{array}[].{text}"))
        return frozenset(p for _, paths in self.single for p in paths)


MAPPINGS = (
    Mapping("turn rows", row=("turn", "role", "text")),
    Mapping("role and content messages", many=("messages", "role", "content")),
    Mapping("from and value messages", many=("conversations", "from", "value")),
    Mapping("instruction with input", single=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction", single=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("system, prompt and response", single=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt and response", single=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt and completion", single=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("question and answer", single=(("user", ("question",)), ("assistant", ("answer",)))),
)
#: Names of roles in arrays of messages; rows of turns keep theirs.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_KNOWN = frozenset().union(*(m.paths for m in MAPPINGS))


def schema_paths(kind: t.DataType, prefix: str = "") -> set[str]:
    """Paths of a Spark type's leaves."""
    if isinstance(kind, t.StructType):
        dot = f"{prefix}." if prefix else ""
        return set().union(*(schema_paths(f.dataType, dot + f.name) for f in kind.fields)) if kind.fields else set()
    if isinstance(kind, t.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def value_paths(value: object, prefix: str = "") -> set[str]:
    """Paths of a parsed JSON value's leaves."""
    if isinstance(value, dict):
        dot = f"{prefix}." if prefix else ""
        return set().union(*(value_paths(v, dot + k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(value_paths(v, f"{prefix}[]") for v in value)) if value else set()
    return {prefix}


def fingerprint(paths: set[str] | frozenset[str]) -> str:
    """The hash of the known paths among these."""
    return hashlib.sha256("\n".join(sorted(paths & _KNOWN)).encode()).hexdigest()


_BY_PRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def mapping_for(paths: set[str]) -> Mapping | None:
    """The mapping of exactly these known paths; else the one with most paths that all are there (first of equals)."""
    if (exact := _BY_PRINT.get(fingerprint(paths))) is not None:
        return exact
    fit = [m for m in MAPPINGS if m.paths <= paths]
    return max(fit, key=lambda m: len(m.paths), default=None)


def _role(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(role)), role, F.lit(""))


def canonical_turns(records: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of records in any known layout, chosen by the fingerprint of their schema.

    Null texts and roles become empty.  Missing arrays have no turns.  Raises
    ValueError for an unknown layout.
    """
    mapping = mapping_for(schema_paths(records.schema))
    if mapping is None:
        raise ValueError(f"no mapping for {sorted(schema_paths(records.schema))}")
    key = F.col(id_column).cast("long").alias("conv_id")
    if mapping.row:
        turn, role, text = (F.col(c) for c in mapping.row)
        return records.select(
            key, turn.cast("long").alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text")
        )
    if mapping.many:
        array, role, text = mapping.many
        each = records.select(key, F.posexplode(array).alias("turn", "m"))
        return each.select(
            "conv_id", F.col("turn").cast("long").alias("turn"), _role(F.col(f"m.{role}")).alias("role"), F.coalesce(F.col(f"m.{text}"), F.lit("")).alias("text")
        )
    turns = F.array(
        *(
            F.struct(F.lit(n).cast("long").alias("turn"), F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.nullif(F.col(p), F.lit("")) for p in paths)).alias("text"))
            for n, (role, paths) in enumerate(mapping.single)
        )
    )
    return records.select(key, F.inline(turns))


def _get(value: object, path: str) -> object:
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _as_text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns_of(record: object) -> list[tuple[int, str, str]]:
    """Turns of one parsed JSON record, by its own fingerprint; none for an unknown layout."""
    mapping = mapping_for(value_paths(record))
    if mapping is None:
        return []
    name = lambda r: ROLES.get(r.lower(), r)
    if mapping.row:
        turn, role, text = (_get(record, p) for p in mapping.row)
        return [(turn if isinstance(turn, int) else 0, _as_text(role), _as_text(text))]
    if mapping.many:
        array, role, text = mapping.many
        messages = _get(record, array) or []
        return [(n, name(_as_text(_get(m, role))), _as_text(_get(m, text))) for n, m in enumerate(messages)]
    joined = lambda paths: "\n\n".join(x for x in (_as_text(_get(record, p)) for p in paths) if x)
    return [(n, role, joined(paths)) for n, (role, paths) in enumerate(mapping.single)]


def canonical_json_turns(records: DataFrame, id_column: str = "conv_id", json_column: str = "record") -> DataFrame:
    """canonical_turns() for a column of JSON texts that may each have another layout.

    A record that can't be parsed, or of an unknown layout, has no turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                try:
                    found = turns_of(json.loads(text)) if text is not None else []
                except ValueError:
                    found = []
                out += [(key, *x) for x in found]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "text"])

    picked = records.select(F.col(id_column).cast("long").alias("conv_id"), F.col(json_column).cast("string").alias("record"))
    return picked.mapInArrow(run, TURNS)


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """turns with segment, loss_start and loss_length: the template's output for each turn.

    Offsets count code points within the segment; only assistant texts are under
    the mask.  Segments of a conversation follow one another by (turn, role, text).
    """
    role = F.replace(_escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    text = _escape(F.col("text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    return turns.select(
        *turns.columns,
        F.concat(head, text, F.lit(END + "\n")).alias("segment"),
        F.length(head).cast("long").alias("loss_start"),
        F.when(F.col("role") == TRAINED, F.length(text)).otherwise(0).cast("long").alias("loss_length"),
    )


_SEGMENT = re.compile(re.escape(START) + r"((?:[^\\\n]|\\[\s\S])*)\n([\s\S]*)" + re.escape(END) + r"\n\Z")


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text that a segment was made of."""
    found = _SEGMENT.match(segment)
    if not found or any(control in part for control in (START, END) for part in found.groups()):
        raise ValueError("not a segment of the template")
    return unescape(found[1]), unescape(found[2])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    none = object()
    now, state, out = none, None, []

    def flush() -> None:
        if state is not None:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_length"))
        for key, segment, start, length in zip(*columns, strict=True):
            if state is None or key != now:
                flush()
                now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_segment(segment)
            trained = unescape(segment[start : start + length])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(trained)
            state[3].update(trained.encode())
            state[4] += len(segment)
        if out:
            yield batch_of()
            out.clear()
    flush()
    yield batch_of()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from format_turns().

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).
    Segments are dealt by conv_id, sorted and streamed through incremental
    hashes, so a conversation of any length takes no memory.  Rows of one turn
    are ordered by role and text; repeated rows count each; null conv_ids form
    one conversation, null turns come first.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "segment", "loss_start", "loss_length").mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + 1
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
