"""Merkle manifest of a dataset: a tree for each group of rows, and one tree over these trees' roots.

Each parent is the hash of its children's hex digests, one after the other, and keeps the copied hash state before
each child slot (that before the first is SHA-256's initial state for all, and is not stored). A changed leaf is
folded by resuming the state of its slot with the replacement and the siblings to its right; what lies to its left is
in the state already and is not read.

Leaves are numbered in order within their tree. ``SLOTS`` consecutive nodes are one task's group and one row of the
manifest, and their top is a node of the next round, so a tree of any size takes a few rounds and no task holds
more than ``SLOTS`` nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sha_states as sha
from .common import numbered, written

FAN = 2
#: Levels within a row of the manifest; such a row covers ``FAN ** LEVELS`` nodes.
LEVELS = 12

CHUNK = "tree string, chunk long, total long, n long, height int, top binary, nodes binary, states binary"


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (32 bytes) of the values, each encoded, one after the other."""
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return sha.words_of(b"".join(column.to_pylist()))


def _sizes(n: int, height: int, fan: int) -> list[int]:
    """Nodes on each level, leaves first."""
    out = [n]
    for _ in range(height):
        out.append(-(-out[-1] // fan))
    return out


def _grown(leaves: np.ndarray, height: int, fan: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of each level, and of each level above the leaves the states before slots 1, 2, ... of its nodes."""
    levels, kept = [leaves], []
    for _ in range(height):
        below = levels[-1]
        parents = -(-len(below) // fan)
        counts = np.minimum(fan, len(below) - fan * np.arange(parents))
        state, before = sha.fresh(parents), []
        for slot in range(fan):
            if slot:
                before.append(state)
            filled = np.flatnonzero(counts > slot)
            after = state.copy()
            after[filled] = sha.absorb(state[filled], below[filled * fan + slot])
            state = after
        levels.append(sha.close(state, counts))
        kept.append(np.stack(before, axis=1))
    return levels, kept


def _chunk_maker(fan: int, levels: int):
    """One manifest row for the nodes of one group."""
    whole = fan**levels

    def make(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        n, total = len(group), group["total"][0].as_py()
        height = levels
        if total <= whole:
            height = 0
            while fan**height < n:
                height += 1
        nodes, states = _grown(_digests(group["digest"]), height, fan)
        row = {
            "tree": group["tree"][0].as_py(), "chunk": group["chunk"][0].as_py(), "total": total, "n": n,
            "height": height, "top": sha.bytes_of(nodes[-1]), "nodes": b"".join(map(sha.bytes_of, nodes)),
            "states": b"".join(map(sha.bytes_of, states)),
        }
        return pa.Table.from_pylist([row], CHUNK_ARROW)

    return make


CHUNK_ARROW = pa.schema(
    [("tree", pa.string()), ("chunk", pa.int64()), ("total", pa.int64()), ("n", pa.int64()), ("height", pa.int32()),
     ("top", pa.binary()), ("nodes", pa.binary()), ("states", pa.binary())]
)


@dataclass
class Chunk:
    """A manifest row opened for folding."""

    fan: int
    nodes: list[np.ndarray]
    states: list[np.ndarray]

    @classmethod
    def opened(cls, row: dict, fan: int) -> Chunk:
        sizes = _sizes(row["n"], row["height"], fan)
        flat, kept = sha.words_of(row["nodes"]), sha.words_of(row["states"]).reshape(-1, fan - 1, 8)
        ends = np.cumsum(sizes)
        nodes = [flat[end - size : end] for end, size in zip(ends.tolist(), sizes, strict=True)]
        above = np.cumsum([0, *sizes[1:]]).tolist()
        return cls(fan, nodes, [kept[a:b] for a, b in zip(above[:-1], above[1:], strict=True)])

    def steps(self, places: np.ndarray) -> Iterator[Step]:
        """From the parents of the leaves at ``places`` upwards."""
        for below, kept in zip(self.nodes[:-1], self.states, strict=True):
            parents, slots = places // self.fan, places % self.fan
            counts = np.minimum(self.fan, len(below) - self.fan * parents)
            around = np.minimum(self.fan * parents[:, None] + np.arange(self.fan), len(below) - 1)
            states = np.where(slots[:, None] > 0, kept[parents, np.maximum(slots, 1) - 1], sha.INITIAL)
            yield Step(slots, counts, states, below[around])
            places = parents


@dataclass
class Step:
    """For each of some nodes: its slot, how many children its parent has, the state before the slot, the children."""

    slots: np.ndarray
    counts: np.ndarray
    states: np.ndarray
    children: np.ndarray

    def packed(self) -> list[bytes]:
        head = np.stack([self.slots, self.counts], axis=1).astype(np.uint8)
        rest = np.concatenate([self.states[:, None, :], self.children], axis=1)
        rest = np.ascontiguousarray(rest.reshape(len(rest), -1).astype(">u4")).view(np.uint8)
        return [row.tobytes() for row in np.concatenate([head, rest], axis=1)]

    @classmethod
    def unpacked(cls, path: bytes, fan: int, n: int) -> Iterator[Step]:
        """The steps of a packed path, each for ``n`` nodes that share it."""
        size = 2 + 32 * (fan + 1)
        for at in range(0, len(path), size):
            words = sha.words_of(path[at + 2 : at + size])
            slots, counts = np.full(n, path[at]), np.full(n, path[at + 1])
            yield cls(slots, counts, np.broadcast_to(words[0], (n, 8)), np.broadcast_to(words[1:], (n, fan, 8)))


@dataclass
class Folding:
    """Digests on their way up, and the running hash of the siblings they meet."""

    digests: np.ndarray
    proofs: np.ndarray = field(init=False)
    met: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.proofs, self.met = sha.fresh(len(self.digests)), np.zeros(len(self.digests), np.int64)

    def up(self, step: Step) -> None:
        """Resume each parent's state with the replacement and the siblings to its right."""
        state = sha.absorb(step.states, self.digests)
        for slot in range(step.children.shape[1]):
            right = np.flatnonzero((slot > step.slots) & (slot < step.counts))
            if len(right):
                state[right] = sha.absorb(state[right], step.children[right, slot])
        self.digests = sha.close(state, step.counts)
        for slot in range(step.children.shape[1]):
            other = np.flatnonzero((slot != step.slots) & (slot < step.counts))
            if len(other):
                self.proofs[other] = sha.absorb(self.proofs[other], step.children[other, slot])
        self.met += step.counts - 1


def _child_paths(fan: int):
    """For each child of manifest rows: its packed steps to the top of its row."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                steps = [s.packed() for s in Chunk.opened(row, fan).steps(np.arange(row["n"]))]
                first = row["chunk"] * fan ** row["levels"]
                places = np.arange(first, first + row["n"])
                path = [b"".join(p) for p in zip(*steps, strict=True)] if steps else [b""] * row["n"]
                tree = pa.array([row["tree"]] * row["n"], pa.string())
                yield pa.record_batch([tree, pa.array(places, pa.int64()), pa.array(path, pa.binary())], ["tree", "place", "path"])

    return paths


def _folder(fan: int, levels: int, schema: pa.Schema):
    def fold(changed: pa.Table, chunks: pa.Table) -> pa.Table:
        n = len(changed)
        if not n:
            return schema.empty_table()
        if not len(chunks):
            nothing = [pa.nulls(n, pa.binary())] * 3
            return pa.Table.from_arrays([*changed.drop_columns(["chunk"]).columns, *nothing], schema=schema)
        row = chunks.to_pylist()[0]
        folding = Folding(_digests(changed["digest"]))
        places = changed["place"].to_numpy() - row["chunk"] * fan**levels
        for step in Chunk.opened(row, fan).steps(places):
            folding.up(step)
        for step in Step.unpacked(row["path"], fan, n):
            folding.up(step)
        tops, proofs = sha.bytes_of(folding.digests), sha.bytes_of(sha.close(folding.proofs, folding.met))
        cut = [pa.array([raw[i : i + 32] for i in range(0, 32 * n, 32)], pa.binary()) for raw in (tops, proofs, row["subroot"] * n)]
        return pa.Table.from_arrays([*changed.drop_columns(["chunk"]).columns, *cut], schema=schema)

    return fold


@dataclass
class Manifest:
    """Rounds of written manifest rows of the trees, and of the tree over their roots."""

    fan: int
    levels: int
    rounds: list[DataFrame]
    forest: list[DataFrame]
    #: ``tree, place, digest, total``: the trees' roots in order.
    subroots: DataFrame

    @property
    def root(self) -> bytes | None:
        """The one hash over everything; none without rows."""
        top = self.forest[-1].select("top").first()
        return bytes(top[0]) if top else None

    def _with_paths(self, rows: DataFrame, rounds: list[DataFrame], tree: str, place: str) -> DataFrame:
        """``rows`` with the ``path`` of each through ``rounds`` appended."""
        for i, chunks in enumerate(rounds):
            steps = (
                chunks.withColumn("levels", F.lit(self.levels))
                .mapInArrow(_child_paths(self.fan), "tree string, place long, path binary")
                .select(F.col("tree").alias("__tree"), F.col("place").alias("__place"), F.col("path").alias("__path"))
            )
            at = F.floor(F.col(place) / F.lit(self.fan ** (self.levels * i)))
            rows = rows.join(steps, (F.col(tree) == F.col("__tree")) & (at == F.col("__place")), "left")
            path = F.concat("path", F.coalesce("__path", F.lit(b"")))
            rows = rows.withColumn("path", path).drop("__tree", "__place", "__path")
        return rows

    def paths(self) -> DataFrame:
        """``tree, chunk, path, subroot``: the steps from the top of each row of the first round to the root."""
        empty = F.lit(b"").alias("path")
        trees = self.subroots.select("tree", "place", F.lit("").alias("forest"), empty, F.col("digest").alias("subroot"))
        trees = self._with_paths(trees, self.forest, "forest", "place").select("tree", F.col("path").alias("above"), "subroot")
        chunks = self.rounds[0].select("tree", "chunk", empty)
        chunks = self._with_paths(chunks, self.rounds[1:], "tree", "chunk")
        return chunks.join(trees, "tree").select("tree", "chunk", F.concat("path", "above").alias("path"), "subroot")

    def fold(self, changed: DataFrame) -> DataFrame:
        """``changed`` (``tree, place, digest`` and other columns) with ``folded``, ``proof`` and ``subroot``.

        ``folded`` is the root with that one leaf replaced by ``digest``, ``proof`` the hash of all siblings on its
        way, ``subroot`` the root of its tree as it was, all 32 bytes. Each row is folded apart; a place that the
        manifest lacks gives nulls.
        """
        out = changed.select(*changed.columns, *[F.lit(None).cast("binary").alias(c) for c in ("folded", "proof", "subroot")]).schema
        chunk = F.floor(F.col("place") / F.lit(self.fan**self.levels)).alias("chunk")
        rows = self.rounds[0].select("tree", "chunk", "n", "height", "nodes", "states").join(self.paths(), ["tree", "chunk"])
        left = changed.select("*", chunk).groupBy("tree", "chunk")
        fold = _folder(self.fan, self.levels, _arrow(out))
        return left.cogroup(rows.groupBy("tree", "chunk")).applyInArrow(fold, out)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _grow(nodes: DataFrame, fan: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Written manifest rows, round by round, and ``tree, digest`` of the roots. ``nodes``: ``tree, place, digest, total``."""
    whole, rounds = fan**levels, []
    while True:
        chunk = F.floor(F.col("place") / F.lit(whole)).alias("chunk")
        groups = nodes.select("*", chunk).groupBy("tree", "chunk")
        rounds.append(written(groups.applyInArrow(_chunk_maker(fan, levels), CHUNK), "manifest"))
        if not rounds[-1].where(F.col("total") > whole).limit(1).count():
            break
        total = F.ceil(F.col("total") / F.lit(whole)).alias("total")
        nodes = rounds[-1].where(F.col("total") > whole).select("tree", F.col("chunk").alias("place"), F.col("top").alias("digest"), total)
    tops = [r.where(F.col("total") <= whole).select("tree", F.col("top").alias("digest")) for r in rounds]
    return rounds, reduce(DataFrame.unionByName, tops)


def build(leaves: DataFrame, fan: int = FAN, levels: int = LEVELS) -> Manifest:
    """The manifest of numbered leaves ``tree`` (string, not null), ``place``, ``total``, ``digest`` (32 bytes).

    Trees are ordered bytewise by name. Places are gapless from 0 in each tree of ``total`` leaves, as ``numbered``
    gives them.
    """
    rounds, tops = _grow(leaves.select("tree", "place", "digest", "total"), fan, levels)
    subroots = written(numbered(tops.withColumn("forest", F.lit("")), ["forest"], ["tree"]), "subroots")
    nodes = subroots.select(F.col("forest").alias("tree"), "place", "digest", "total")
    return Manifest(fan, levels, rounds, _grow(nodes, fan, levels)[0], subroots)


def document_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, digest, tampered, place, total`` of every row of ``docs``, numbered by ``doc_id`` within its language.

    A leaf covers ``doc_id, source, lang, n_chars, text``. ``tampered`` is its digest after 1 is added to ``n_chars``
    where 7 divides the CRC-32 of the decimal ``doc_id``, else null. Any column may be null: a null language is a tree of
    its own, the first, and null ids come first in theirs. Rows with equal ids are ordered by their digests.
    """
    others = [F.col(c) for c in ("doc_id", "source", "lang")]
    more = F.col("n_chars").cast("decimal(38,0)") + F.lit(1)
    picked = (F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"),
        leaf_digest(*others, F.col("n_chars"), F.col("text")).alias("digest"),
        F.when(picked, leaf_digest(*others, more, F.col("text"))).alias("tampered"),
    )
    return written(numbered(written(leaves, "leaves"), ["tree"], ["doc_id", "digest"]), "leaves")


def audit_manifest(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    The manifest covers the rows as they are. Each row's leaf, in its tampered form where there is one, is then folded
    to the root; ``verified`` says whether that is the manifest's root. Repeated rows have leaves of their own; texts of
    any length are hashed whole, by the JVM. An empty table gives an empty result.
    """
    leaves = document_leaves(docs)
    manifest = build(leaves, fan, levels)
    changed = leaves.select(
        "tree", "place", F.coalesce("tampered", "digest").alias("digest"), "doc_id", F.col("digest").alias("leaf")
    )
    root = F.lit(manifest.root).cast("binary")
    as_text = lambda name: F.lower(F.hex(name))
    return manifest.fold(changed).select(
        "doc_id",
        as_text("leaf").alias("leaf"),
        as_text("subroot").alias("subroot"),
        F.lower(F.hex(root)).alias("root"),
        as_text("proof").alias("proof_sha256"),
        as_text("folded").alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )
