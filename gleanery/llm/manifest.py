"""A Merkle manifest of a dataset whose parents keep SHA-256 midstates.

1. Each row is a leaf. Leaves of a tree (a language) stand in order of their id; FANOUT
   consecutive nodes have one parent, level by level. The top nodes of the trees are the
   leaves of one more tree, whose top is the root.
2. Places are given without a global sort in one task: the rows are range-partitioned, counted
   per partition, and numbered inside it from the total of the earlier ones.
3. A task builds the LEVELS levels above FANOUT ** LEVELS consecutive nodes, a block. The
   tops of the blocks are the next round's nodes, so 12 rounds would do for 10 ** 43 leaves. Every parent keeps its
   children's digests and a copy of the hash state as it was before each child.
4. To fold a changed leaf in, its parent resumes the state it kept before that child, takes
   the new digest and the children right of it only. A block's leaves are folded together,
   and the way from the top of the block to the root, the same for all of them, is worked
   out once per block, from the top down, so that no task meets all leaves at the root.

Defined results: a null column is `-`; rows that share an id stand in order of their leaf,
null ids first; a null tree is a tree, before all others; a table of one row is its own
subroot and root; an empty table has no root and gives an empty result; other columns are
not looked at. Replacements whose place is not in the tree are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored
from .midstates import START, absorb, finish, hex_blocks, octets, words

FANOUT, LEVELS = 8, 4
SPAN = FANOUT**LEVELS
#: What a leaf hashes, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "tree STRING, block BIGINT, level INT, position BIGINT, top BOOLEAN, digest BINARY, children BINARY, states BINARY"
STEP = "STRUCT<slot: INT, children: BINARY, states: BINARY>"
PATHS = f"tree STRING, block BIGINT, path ARRAY<{STEP}>"


def encoded(c: Column) -> Column:
    """A value with its length in front, or `-`."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: tuple[str, ...] = COLUMNS, **changed: Column) -> Column:
    """Digest of a row; `changed` columns stand for those of the row."""
    return F.unhex(F.sha2(F.concat(*[encoded(changed.get(c, F.col(c))) for c in columns]), 256))


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`rows` with `position` (from 0 in `order` within `keys`) and `size`, the number of rows of the key."""
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in keys + order]).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "manifest-ranged")
    counts = ranged.groupBy("part", *keys).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", *keys, F.coalesce(before, F.lit(0)).alias("first"), F.sum("n").over(whole).alias("size"))
    local = Window.partitionBy("part", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = ranged.withColumn("row", F.row_number().over(local) - 1)
    return numbered.join(starts, ["part", *keys]).withColumn("position", F.col("row") + F.col("first")).drop("part", "row", "first")


def _height(size: int) -> int:
    height = 0
    while size > 1:
        size, height = -(-size // FANOUT), height + 1
    return height


def _parents(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """(digests, number of children, children, states before each child) of the parents of consecutive nodes."""
    n = len(digests)
    count = np.minimum(FANOUT, n - np.arange(0, n, FANOUT))
    blocks = np.zeros((len(count) * FANOUT, 16), np.uint32)
    blocks[:n] = hex_blocks(digests)
    blocks = blocks.reshape(len(count), FANOUT, 16)
    state = np.repeat(START[None], len(count), axis=0)
    before = np.zeros((len(count), FANOUT, 8), np.uint32)
    for slot in range(FANOUT):
        before[:, slot] = state
        has = count > slot
        state[has] = absorb(state[has], blocks[has, slot])
    children, raw = octets(digests), before.astype(">u4").tobytes()
    width = FANOUT * 32
    return (
        finish(state, count), count, [b"".join(children[i : i + FANOUT]) for i in range(0, n, FANOUT)],
        [raw[i * width : i * width + 32 * int(c)] for i, c in enumerate(count)],
    )


def _grow(entries: DataFrame) -> DataFrame:
    """NODES of up to LEVELS levels above `entries` (tree, position, digest, size)."""

    def grow(group: pa.Table) -> pa.Table:
        group = group.sort_by("position")
        tree, block, size = (group.column(c)[0].as_py() for c in ("tree", "block", "size"))
        digests, levels = words(group.column("digest").to_pylist()), min(LEVELS, _height(size))
        rows = [] if levels else [(tree, block, 0, block, True, octets(digests)[0], None, None)]
        for level in range(1, levels + 1):
            digests, _count, children, states = _parents(digests)
            first = block * FANOUT ** (LEVELS - level)
            rows += [(tree, block, level, first + i, level == levels, *r) for i, r in enumerate(zip(octets(digests), children, states))]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in NODES.split(", ")])

    blocked = entries.select("tree", "position", "digest", "size", F.floor(F.col("position") / SPAN).alias("block"))
    return blocked.groupBy("tree", "block").applyInArrow(grow, NODES)


@dataclass
class Manifest:
    """`leaves` with their places, the `nodes` of each round above them, `subroots` (tree, digest) and the root."""

    leaves: DataFrame
    rounds: list[DataFrame]
    over: list[DataFrame]
    subroots: DataFrame
    tops: DataFrame
    root: bytes | None


def _rounds(entries: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of every round above `entries`, and the top of every tree."""
    rounds, tops = [], None
    while True:
        largest = entries.agg(F.max("size")).first()[0]
        if largest is None:
            return rounds, tops if tops is not None else entries.select("tree", "digest")
        nodes = stored(_grow(entries), "manifest-nodes")
        rounds.append(nodes)
        sizes = entries.select("tree", F.ceil(F.col("size") / SPAN).alias("size")).distinct()
        found = nodes.filter("top").select("tree", F.col("block").alias("position"), "digest").join(sizes, "tree")
        done = found.filter("size = 1").select("tree", "digest")
        tops = done if tops is None else tops.unionByName(done)
        entries = found.filter("size > 1")


def build(leaves: DataFrame) -> Manifest:
    """The manifest of `leaves` (id, tree, digest and what else is carried along); a null tree is one too."""
    # a name that sorts like the tree, null before all others
    named = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "tree"), F.lit("")))
    entries = stored(placed(named, ["tree"], ["id", "digest"]), "manifest-leaves")
    rounds, tops = _rounds(entries)
    subroots = stored(placed(tops.withColumnRenamed("tree", "name").withColumn("tree", F.lit("*")), ["tree"], ["name"]), "manifest-subroots")
    over, roots = _rounds(subroots)
    found = roots.first()
    return Manifest(entries, rounds, over, subroots.select(F.col("name").alias("tree"), "position", "digest", "size"), subroots, bytes(found["digest"]) if found else None)


def _ways(entries: DataFrame, nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """PATHS: for each entry of a round, its steps inside its block and those `above` the block.

    Entries are tops of blocks of the round below, so there are few of them.
    """

    def climb(_key, group: pa.Table, parents: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({"tree": pa.array([], pa.string()), "block": pa.array([], pa.int64()), "path": pa.array([], step)})
        at = {(r["level"], r["position"]): r for r in parents.to_pylist()}
        levels, further = max(level for level, _p in at), next((r["path"] for r in at.values() if r["path"]), None) or []
        out = []
        for position in group.column("position").to_pylist():
            path = []
            for level in range(1, levels + 1):
                parent = at[level, position // FANOUT**level]
                path.append({"slot": position // FANOUT ** (level - 1) % FANOUT, "children": parent["children"], "states": parent["states"]})
            out.append(path + further)
        return pa.table({"tree": group.column("tree"), "block": group.column("position"), "path": pa.array(out, step)})

    step = pa.list_(pa.struct([("slot", pa.int32()), ("children", pa.binary()), ("states", pa.binary())]))
    blocked = entries.select("tree", "position", F.floor(F.col("position") / SPAN).alias("block"))
    return blocked.groupBy("tree", "block").cogroup(_with_way(nodes, above).groupBy("tree", "block")).applyInArrow(climb, PATHS)


def _with_way(nodes: DataFrame, above: DataFrame | None) -> DataFrame:
    """Nodes whose top one carries the way from its block on to the root."""
    if above is None:
        return nodes.withColumn("path", F.lit(None).cast(f"ARRAY<{STEP}>"))
    tops = nodes.filter("top").join(above, ["tree", "block"], "left")
    return tops.unionByName(nodes.filter("NOT top").withColumn("path", F.lit(None).cast(f"ARRAY<{STEP}>")))


def _down(rounds: list[DataFrame], above: DataFrame | None) -> DataFrame | None:
    """Ways from the blocks of the lowest round to the root, worked out from the highest one down."""
    for lower, nodes in reversed(list(zip(rounds, rounds[1:]))):
        inner = nodes.select("tree").distinct()  # trees that end in the lower round keep their way
        entries = lower.filter("top").select("tree", F.col("block").alias("position")).join(inner, "tree")
        ways = _ways(entries, nodes, above)
        if above is not None:
            ways = ways.unionByName(above.join(inner, "tree", "left_anti"))
        above = stored(ways, "manifest-ways")
    return above


def fold(manifest: Manifest, replaced: DataFrame, keep: list[str]) -> DataFrame:
    """Roots with one leaf replaced each: `replaced` (tree, position, digest) with `folded` and `proof`.

    `tree` is named as in `manifest.leaves`. Siblings are those of the manifest. proof: digest
    of all siblings, level by level to the root, left to right. `keep`: columns to carry along.
    """
    over = _down(manifest.over, None)
    ends = manifest.tops.select("tree", "position", "name")
    if manifest.over:
        ways = stored(_ways(ends, manifest.over[0], over), "manifest-ways")
        above = ends.join(ways.withColumnRenamed("block", "position"), ["tree", "position"]).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path")
    else:
        above = None
    above = _down(manifest.rounds, above) if manifest.rounds else None
    carried_names = [*dict.fromkeys([*keep, "digest"])]
    schema = replaced.select(*carried_names).schema
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields]
    nodes = _with_way(manifest.rounds[0], above) if manifest.rounds else None
    if nodes is None:
        return replaced.select(*carried_names, F.lit(None).cast("binary").alias("folded"), F.lit(None).cast("binary").alias("proof")).filter(F.lit(False))

    def folded(_key, group: pa.Table, parents: pa.Table) -> pa.Table:
        rows = parents.select(["level", "position", "children", "states", "path"]).to_pylist()
        lowest = {r["position"]: len(r["children"]) // 32 for r in rows if r["level"] == 1} or {r["position"]: 1 for r in rows}
        group = group.filter(pa.array([p % FANOUT < lowest.get(p // FANOUT, 0) for p in group.column("position").to_pylist()], pa.bool_()))
        if not group.num_rows:
            return pa.table({**{c: group.column(c) for c in carried_names}, "folded": pa.array([], pa.binary()), "proof": pa.array([], pa.binary())})
        position = np.array(group.column("position").to_pylist(), np.int64)
        values = words(group.column("digest").to_pylist())
        proof, siblings = np.repeat(START[None], len(values), axis=0), np.zeros(len(values), np.int64)
        steps = []  # (parents of the level, which of them is each row's, its slot in it)
        for level in range(1, max(r["level"] for r in rows) + 1):
            own = sorted((r for r in rows if r["level"] == level), key=lambda r: r["position"])
            steps.append((own, position // FANOUT**level - own[0]["position"], position // FANOUT ** (level - 1) % FANOUT))
        for step in next((r["path"] for r in rows if r["path"]), None) or []:
            steps.append(([step], np.zeros(len(values), np.int64), np.full(len(values), step["slot"])))
        for own, parent, slot in steps:
            count = np.array([len(r["children"]) // 32 for r in own])
            firsts = np.concatenate([[0], np.cumsum(count)])
            children = hex_blocks(words([r["children"] for r in own]))
            state = words([r["states"] for r in own])[firsts[parent] + slot]
            state = absorb(state, hex_blocks(values))
            for k in range(FANOUT):
                has = (count[parent] > k) & (slot != k)
                block = children[firsts[parent[has]] + k]
                proof[has] = absorb(proof[has], block)
                right = slot[has] < k
                at = np.flatnonzero(has)[right]
                state[at] = absorb(state[at], block[right])
            siblings += count[parent] - 1
            values = finish(state, count[parent])
        out = {c: group.column(c) for c in carried_names}
        return pa.table({**out, "folded": pa.array(octets(values), pa.binary()), "proof": pa.array(octets(finish(proof, siblings)), pa.binary())})

    blocked = replaced.select(*dict.fromkeys(["tree", "position", *carried_names]), F.floor(F.col("position") / SPAN).alias("block"))
    return blocked.groupBy("tree", "block").cogroup(nodes.groupBy("tree", "block")).applyInArrow(folded, ", ".join([*carried, "folded BINARY", "proof BINARY"]))


def verify(docs: DataFrame, tampered, key: str = "doc_id", tree: str = "lang") -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    `tampered`: column that holds a row's text as it is found later, null where it is the same.
    """
    found = F.when(tampered.isNotNull(), leaf(text=tampered))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(tree).alias("tree"), leaf().alias("digest"), found.alias("found"))
    manifest = build(rows)
    again = manifest.leaves.select("tree", "position", "id", F.col("digest").alias("leaf"), F.coalesce("found", "digest").alias("digest"))
    roots = fold(manifest, again, ["id", "tree", "leaf"])
    hexed = lambda c: F.lower(F.hex(c))
    whole = F.lit(manifest.root).cast("binary")
    return roots.join(manifest.subroots.select("tree", F.col("digest").alias("subroot")), "tree").select(
        F.col("id").alias("doc_id"), hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed(whole).alias("root"),
        hexed("proof").alias("proof_sha256"), hexed("folded").alias("folded_root"), (F.col("folded") == whole).alias("verified"),
    )


def lower_cased_third(key: str = "doc_id", text: str = "text") -> Column:
    """The text with A-Z lower-cased where 3 divides the crc32 of the id, else null."""
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, ascii_lower(F.col(text)))
