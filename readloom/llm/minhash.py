"""Near-duplicate documents: MinHash signatures, banding, verification and components.

Shape of the plan, for documents of which any group may be a third of all rows:

1. One Arrow pass over the texts gives each row its shingle-set size, a 128-bit
   digest of the set, 128 universal hash minima folded into 32 band keys of
   four, and a compact signature.  Texts are never shuffled for this.
2. Rows with equal digests are one class; the class is represented by its
   smallest doc_id.  Copies cost one map-side aggregated row from here on.
3. Representatives that share a band key are in one bucket.  Buckets are joined
   with aggregates of themselves (their smallest and largest member), so no
   bucket is ever gathered in one place; the aggregates of large buckets, of
   which there are few, are broadcast.  Every member is compared with these
   two pivots; links found give components by large-star and small-star.
4. A bucket whose members already are in one component needs nothing more.  In
   the others every member outside the bucket's largest component is compared
   with all members of other components, in tiles of bounded size.  So each pair
   that shares a bucket is either compared or already known to be connected: no
   pair is lost to a cap.
5. A pivot's pair is compared on signatures first and then, if it may reach the
   threshold, on full shingle sets by exact integer arithmetic; tiles compare
   full sets at once.

A pair at similarity 0.75 shares none of its 32 keys with probability
(1 - 0.75**4)**32 = 6e-6, and less above.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import _text as T
from readloom.llm._common import BROADCAST_ROWS, durable, if_small
from readloom.llm.components import components

HASHES, ROWS, SHINGLE, PERCENT = 128, 4, 5, 75
#: Share of equal minima below which a pair can't reach 0.75 (six standard deviations).
SIGNATURE_FLOOR = 0.52
#: Nodes of a tile in which outsiders and members of buckets are compared.
TILE = 128
#: Members of a bucket, at least, from which its aggregates are broadcast.
LARGE = 512
#: Nodes from here on stand for classes without a doc_id of their own; doc_ids are smaller.
UNNAMED = 1 << 62
_NO_ID = (1 << 63) - 1

_rng = np.random.default_rng(7919)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_BLOCK = 1 << 15


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: k-grams of words, or all words if fewer than k."""
    for lo, hi in T.slices(column):
        w = T.words(*T.padded(column.slice(lo, hi - lo)), T.NON_SPACE)
        runs = T.grams(w.hashes, k)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            if b - a >= k:
                yield np.unique(runs[a : b - k + 1])
            else:
                yield T.grams(w.hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES universal multiply-add minima of each non-empty set, as rows."""
    out = np.empty((len(sets), HASHES), np.uint64)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= _BLOCK):
            size += len(sets[j])
            j += 1
        block = np.concatenate(sets[i:j])
        begins = np.concatenate(([0], np.cumsum([len(s) for s in sets[i : j - 1]]))).astype(np.int64)
        work = np.empty_like(block)
        for h in range(HASHES):
            np.multiply(block, _A[h], out=work)
            np.add(work, _B[h], out=work)
            out[i:j, h] = np.minimum.reduceat(work, begins)
        i = j
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = HASHES // ROWS
    tag = T.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for batch in batches:
        column = batch.column("text")
        done = 0
        sets = shingle_sets(column)
        while done < len(column):
            part = list(islice(sets, 256))
            sizes = np.array([len(s) for s in part], np.int64)
            full = np.flatnonzero(sizes)
            digest = np.zeros((2, len(part)), np.uint64)
            keys: list[np.ndarray | None] = [None] * len(part)
            marks: list[bytes | None] = [None] * len(part)
            if len(full):
                least = minima([part[i] for i in full])
                runs = least.reshape(len(full), bands, ROWS)
                key = np.repeat(tag[None, :], len(full), 0)
                for r in range(ROWS):
                    key = T.mix(key * np.uint64(0x9E3779B97F4A7C15) + runs[:, :, r])
                short = (T.mix(least) >> np.uint64(48)).astype("<u2")
                for n, i in enumerate(full):
                    keys[i], marks[i] = key[n].view(np.int64), short[n].tobytes()
                    digest[0, i] = T.mix(part[i]).sum(dtype=np.uint64)
                    digest[1, i] = T.mix(part[i] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(done, len(part)) for c in ("doc_id", "text_hash")),
                    pa.array(sizes),
                    pa.array(digest[0].view(np.int64)),
                    pa.array(digest[1].view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(marks, pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "d1", "d2", "bands", "signature"],
            )
            done += len(part)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, done = batch.column("text"), 0
        sets = shingle_sets(column)
        while done < len(column):
            part = [s.view(np.int64) for s in islice(sets, 256)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(done, len(part)), pa.array(part, pa.list_(pa.int64()))], ["node", "shingles"]
            )
            done += len(part)


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("sig_u", "sig_v")
        )
        alike = (a == b).mean(axis=1) >= SIGNATURE_FLOOR
        yield batch.select(["u", "v"]).filter(pa.array(alike))


def _verified(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, rows: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the threshold."""
    side = lambda df, end, col, to: df.select(F.col("node").alias(end), F.col(col).alias(to))
    likely = (
        pairs.join(side(signatures, "u", "signature", "sig_u"), "u")
        .join(side(signatures, "v", "signature", "sig_v"), "v")
        .mapInArrow(_plausible, "u long, v long")
        .distinct()
    )
    both = likely.join(side(sets, "u", "shingles", "set_u"), "u").join(side(sets, "v", "shingles", "set_v"), "v")
    common = F.size(F.array_intersect("set_u", "set_v"))
    linked = both.where(100 * common >= PERCENT * (F.size("set_u") + F.size("set_v") - common))
    return durable(linked.select("u", "v").distinct(), rows)


def _pairs(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _by_key(rows: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """rows joined with keys(key, n, ...), where n is the number of rows of each key.

    Keys of more than `most` rows are broadcast, so that no task gets all of a
    large key's rows; there are at most (rows / most) of them.
    """
    large = durable(keys.where(F.col("n") > most))
    if large.isEmpty():
        return rows.join(keys, "key")
    few = F.broadcast(large)
    rest = rows.join(F.broadcast(large.select("key")), "key", "left_anti")
    return rows.join(few, "key").unionByName(rest.join(keys.where(F.col("n") <= most), "key"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the documents that wanted(node, key, text_hash) names, one row each.

    Only documents that occur repeatedly are shuffled with their texts.
    """
    found = docs.join(if_small(wanted), ["key", "text_hash"])
    again = durable(found.groupBy("node").count().where("count > 1").select("node"))
    if again.isEmpty():
        return found.select("node", "text")
    once = found.join(if_small(again), "node", "left_semi").dropDuplicates(["node"])
    return found.join(if_small(again), "node", "left_anti").unionByName(once).select("node", "text")


def _links_to_components(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(node, component) of the representatives with links; signed has a row for each class, docs has key, text_hash and text."""
    band = signed.select(F.explode("bands").alias("key"), "node")
    shared = band.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")
    )
    most = max(LARGE, signed.count() * (HASHES // ROWS) // BROADCAST_ROWS)
    shared = durable(shared.where("n > 1 and low < high"))
    members = durable(_by_key(band, shared, most).select("key", "node", "low", "high"))
    rows = members.count()  # of everything from here on but the pivots' pairs, which are twice as many
    nodes = durable(members.select("node").distinct(), rows)
    wanted = if_small(nodes)
    named = durable(signed.join(wanted, "node", "left_semi").select("node", "key", "text_hash"), rows)
    sets = durable(_texts(docs, named).mapInArrow(_sets, "node long, shingles array<long>"))
    signatures = durable(signed.join(wanted, "node", "left_semi").select("node", "signature"), rows)

    stars = (
        members.select(*_pairs("low", "node"))
        .unionByName(members.select(*_pairs("high", "node")))
        .where("u <> v")
        .distinct()
    )
    found = durable(components(_verified(stars, signatures, sets, 2 * rows), 2 * rows), rows)

    placed = durable(
        members.select("key", "node", "low")
        .join(found, "node", "left")
        .select("key", "node", "low", F.coalesce("component", "node").alias("component")),
        rows,
    )
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b")
    open_ = durable(_by_key(placed, durable(mixed.select("key", "n")), most).drop("n"), rows)
    late = _late_links(open_, sets, rows, most)
    as_is = found.select(F.col("node").alias("x"), F.col("component").alias("cx"))
    bridges = late
    for end in ("u", "v"):
        bridges = bridges.join(as_is.withColumnsRenamed({"x": end, "cx": f"c{end}"}), end, "left")
    bridges = bridges.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    joined = components(bridges, rows).select(F.col("node").alias("component"), F.col("component").alias("over"))
    touched = found.unionByName(
        late.select(F.col("u").alias("node"))
        .unionByName(late.select(F.col("v").alias("node")))
        .distinct()
        .join(found, "node", "left_anti")
        .select("node", F.col("node").alias("component"))
    )
    return touched.join(joined, "component", "left").select("node", F.coalesce("over", "component").alias("component"))


def _tile_links(rows: pa.Table) -> pa.Table:
    """Links between the outsiders and the members of one tile, by exact set sizes."""
    inside = np.asarray(rows.column("outside").to_numpy(zero_copy_only=False)) == 0
    node = rows.column("node").to_numpy()
    component = rows.column("component").to_numpy()
    shingles = rows.column("shingles").combine_chunks()
    begin = shingles.offsets.to_numpy()
    flat = shingles.values.to_numpy()
    sizes = np.diff(begin)
    m, found = np.flatnonzero(inside), []
    if len(m):
        every = np.concatenate([flat[begin[i] : begin[i + 1]] for i in m])
        owner = np.repeat(np.arange(len(m)), sizes[m])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        for o in np.flatnonzero(~inside):
            mine = flat[begin[o] : begin[o + 1]]
            lo, hi = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
            common = np.zeros(len(m), np.int64)
            for part in range(0, len(mine), 2048):
                a, n = lo[part : part + 2048], (hi - lo)[part : part + 2048]
                ends = np.cumsum(n)
                at = np.arange(int(ends[-1])) + np.repeat(a - (ends - n), n)
                common += np.bincount(owner[at], minlength=len(m))
            linked = (100 * common >= PERCENT * (sizes[m] + sizes[o] - common)) & (component[m] != component[o])
            found += [(max(node[o], x), min(node[o], x)) for x in node[m[linked]]]
    u, v = ([x[i] for x in found] for i in (0, 1))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _late_links(open_: DataFrame, sets: DataFrame, rows: int, most: int) -> DataFrame:
    """Links of members outside their bucket's largest component, for buckets of several components.

    Nodes are dealt to tiles of about TILE nodes that tend to share buckets.  An
    outsider meets every tile that holds a node of one of its buckets, so all
    pairs of a bucket are covered, while each set moves once a tile rather than
    once a pair.  Outsiders of a tile are split as well; a task holds one tile.
    """
    main = (
        open_.groupBy("key", "component")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"))
    )
    outside = _by_key(open_, durable(main), most).where("component <> main").select("key", F.col("node").alias("o"))
    anchored = open_.groupBy("node").agg(F.min("low").alias("anchor"), F.min("component").alias("component"))
    number = anchored.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("number"))
    tiles = durable(
        anchored.join(number, "anchor").select(
            "node", "component", "anchor", F.pmod(F.xxhash64("node"), "number").alias("block")
        ),
        rows,
    )
    at_key = open_.select("key", "node").join(tiles.select("node", "anchor", "block"), "node").select("key", "anchor", "block").distinct()
    meets = outside.join(at_key, "key").select("anchor", "block", "o").distinct()
    meets = durable(meets, rows)
    splits = meets.groupBy("anchor", "block").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("splits"))
    outsiders = (
        meets.join(splits, ["anchor", "block"])
        .select("anchor", "block", F.pmod(F.xxhash64("o"), "splits").alias("split"), F.col("o").alias("node"), F.lit(1).alias("outside"))
        .join(tiles.select("node", "component"), "node")
    )
    insiders = tiles.join(splits, ["anchor", "block"]).select(
        "anchor",
        "block",
        F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"),
        "node",
        F.lit(0).alias("outside"),
        "component",
    )
    dealt = outsiders.unionByName(insiders).join(sets, "node")
    links = dealt.groupBy("anchor", "block", "split").applyInArrow(_tile_links, "u long, v long")
    return durable(links.distinct(), rows)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash), a row for each row of docs(doc_id, text, ...).

    Other columns are ignored.  kept marks one text of each component: that of
    its smallest doc_id.  Null or empty texts have an empty set and are linked
    with nothing: component_id is their doc_id, and all are kept.  Rows that share
    a doc_id are judged by their own texts; text_hash (xxhash64) tells them apart,
    and rows that share it as well get equal rows.  Documents without an id take
    part; a component of such documents only has a null component_id, and one of
    its texts is kept.  doc_ids are below 2**62.  An empty table gives an empty
    result.
    """
    text, key = F.col("text").cast("string"), F.col("doc_id").cast("long")
    docs = docs.select(key.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.coalesce(key, F.lit(_NO_ID)).alias("key"))
    rows = durable(
        docs.select("doc_id", "text", "text_hash").mapInArrow(
            _sign, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary"
        )
    )
    # rows of a class have equal sets, so equal bands and signatures
    classes = durable(
        rows.where("n_shingles > 0")
        .groupBy("d1", "d2", "n_shingles")
        .agg(
            F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), "text_hash")).alias("first"),
            F.first("bands").alias("bands"),
            F.first("signature").alias("signature"),
        )
        .select("d1", "d2", "n_shingles", "first.key", "first.text_hash", "bands", "signature")
    )
    # a doc_id stands for one class only; further ones of its texts, and those without an id, get numbers of their own
    twice = durable(
        classes.where(F.col("key") != _NO_ID).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("d1").alias("d")).where("n > 1")
    )
    own = F.lit(UNNAMED) + F.pmod(F.xxhash64("d1", "d2"), F.lit(UNNAMED - 1))
    unnamed = (F.col("key") == _NO_ID) | (F.col("d").isNotNull() & (F.col("d") != F.col("d1")))
    classes = durable(classes.join(if_small(twice.select("key", "d")), "key", "left").withColumn("node", F.when(unnamed, own).otherwise(F.col("key"))).drop("d"))
    linked = _links_to_components(docs, classes.select("node", "key", "text_hash", "bands", "signature"))
    placed = classes.select("d1", "d2", "n_shingles", "node", "key", F.col("text_hash").alias("first_hash")).join(linked, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(placed, ["d1", "d2", "n_shingles"], "left")
    first = (F.col("node") == F.col("component")) & (F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("key")) & (F.col("text_hash") == F.col("first_hash"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("component") < UNNAMED, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce(first, F.lit(True)).alias("kept"),
        "text_hash",
    )
