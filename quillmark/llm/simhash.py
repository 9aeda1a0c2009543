"""SimHash near-duplicates, linked through BK-trees.

The fingerprints of all texts are grouped, so copies become one node. To find
all pairs at ``RADIUS`` bits or fewer, a fingerprint is dealt to shards by
those of its blocks of bits that a neighbour must share (of c + RADIUS blocks
any two neighbours agree in c at least), and each shard's fingerprints form a
BK-tree: children are keyed by their integer Hamming distance to the parent,
and a search at distance d from a node follows only edges from d - RADIUS to
d + RADIUS. A shard of more than ``SHARD_ROWS`` fingerprints is cut into parts
and each pair of parts searched as a task of its own, so no task grows with a
hot group and no pair is lost. A task returns a spanning forest of the links
that it finds; their components are found by contraction.

Cases: null, empty and blank texts have fingerprint zero and link like any
other; texts of fewer than four words are one shingle; rows that repeat an id
are one member each; rows without id get their group's smallest id (null if
the group has none); an empty table gives an empty table; very long texts are
hashed in blocks; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, per_document
from .components import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a shard's task at most.
SHARD_ROWS = 4000
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """The SimHash of a text's UTF-8 bytes as an unsigned 64-bit integer."""
    own = data.lower().split()
    if not own:
        return 0
    if len(own) < words:
        return xxhash.xxh64_intdigest(b" ".join(own), SEED)
    joined, ends, at = b" ".join(own), [], -1
    for word in own:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(own) - words])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)], "<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of unsigned 64-bit hashes."""
    votes = np.zeros(64, np.int64)
    for block in range(0, len(hashes), BLOCK):
        votes += np.unpackbits(hashes[block : block + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """A Burkhard-Keller tree over unsigned 64-bit integers; searches run for many queries at a time."""

    def __init__(self, values: np.ndarray):
        self.values = values
        #: Of each node (an index of values) its edges: (distance, child).
        self.edges: list[list[tuple[int, int]]] = [[] for _ in range(len(values))]
        stack = [np.arange(len(values))] if len(values) else []
        while stack:
            group = stack.pop()
            node, rest = int(group[0]), group[1:]
            if not len(rest):
                continue
            distance = np.bitwise_count(values[rest] ^ values[node])
            order = np.argsort(distance, kind="stable")
            rest, distance = rest[order], distance[order]
            cuts = np.flatnonzero(distance[1:] != distance[:-1]) + 1
            for part, at in zip(np.split(rest, cuts), [0, *cuts], strict=True):
                self.edges[node].append((int(distance[at]), int(part[0])))
                stack.append(part)

    def within(self, radius: int, queries: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(node, numbers of the queries at that radius or less), for nodes that have any. Without queries: each node against the values after it."""
        own = queries is None
        queries = self.values if own else queries
        stack = [(0, np.arange(len(queries)))] if len(self.values) else []
        while stack:
            node, asked = stack.pop()
            distance = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int16)
            near = asked[distance <= radius]
            near = near[near > node] if own else near
            if len(near):
                yield node, near
            for edge, child in self.edges[node]:
                further = asked[np.abs(distance - edge) <= radius]
                if own:
                    further = further[further > child]
                if len(further):
                    stack.append((child, further))


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, roots): a spanning forest, as stars, of the links among distinct values."""
    parent = np.arange(len(values))

    def find(x: np.ndarray) -> np.ndarray:
        roots = parent[x]
        while (parent[roots] != roots).any():
            roots = parent[roots]
        return roots

    for node, near in BKTree(values).within(radius):
        roots = np.unique(find(np.append(near, node)))
        parent[roots] = roots[0]
    root = find(np.arange(len(values)))
    member = np.flatnonzero(root != np.arange(len(values)))
    return member, root[member]


def block_masks(shared: int, radius: int) -> list[int]:
    """A mask for each choice of ``shared`` of shared + radius blocks of the 64 bits."""
    n = shared + radius
    cuts = [round(64 * i / n) for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, shared)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def cut_shards(dealt: DataFrame, keys: list[str], by: str, most: int | None = None) -> DataFrame:
    """dealt with a column part: a shard (rows of equal keys) of more than ``most`` rows (SHARD_ROWS) is cut by ``by`` into parts, and each pair of parts is a shard of its own."""
    most = most or SHARD_ROWS
    sizes = materialise(dealt.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / (most // 2)).cast("int").alias("parts")), "shards")
    if sizes.isEmpty():
        return dealt.withColumn("part", F.lit(0).cast("long"))
    own = F.pmod(F.xxhash64(by), F.col("parts"))
    cut = dealt.join(sizes, keys, "left").select(*dealt.columns, "parts", own.alias("own"), F.explode(F.expr("CASE WHEN parts IS NULL THEN array(0) ELSE sequence(0, parts - 1) END")).alias("other"))
    pair = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
    # parts meet in pairs, so a part alone needn't be searched again
    return cut.where("parts IS NULL OR own <> other").select(*dealt.columns, F.coalesce(pair, F.lit(0)).cast("long").alias("part"))


def search_shards(shards: DataFrame, keys: list[str], columns: list[str], one: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
    """The rows that ``one`` makes of each shard of two rows or more; it gets the shard's columns as arrays and gives back arrays in the order of ``schema``. A task holds a batch and a shard at a time."""
    keys = [*keys, "part"]
    names = [field.split()[0] for field in schema.split(", ")]

    def search(batches):
        import pyarrow as pa

        found: list[list[np.ndarray]] = []

        def flush(table: list[np.ndarray], last: bool) -> list[np.ndarray]:
            """Search the complete shards of rows sorted by shard; give back the rows of the one that may go on."""
            differs = np.logical_or.reduce([c[1:] != c[:-1] for c in table[: len(keys)]])
            cuts = np.flatnonzero(differs) + 1
            starts, ends = [0, *cuts], [*cuts, len(table[0])]
            for a, b in list(zip(starts, ends, strict=True))[: None if last else -1]:
                if b - a > 1 and len((got := one(*(c[a:b] for c in table[len(keys) :])))[0]):
                    found.append(got)
            return [c[starts[-1] :] for c in table]

        def out() -> pa.RecordBatch:
            got = [np.concatenate(x) for x in zip(*found, strict=True)]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=names)

        held: list[np.ndarray] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                rows = [part.column(i).to_numpy(zero_copy_only=False) for i in range(part.num_columns)]
                held = flush(rows if held is None else [np.concatenate(c) for c in zip(held, rows, strict=True)], False)
                if found:
                    yield out()
        if held is not None:
            flush(held, True)
            if found:
                yield out()

    return shards.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, schema)


def link_fingerprints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of prints (fp long) that join all that are radius bits apart or less."""
    n = prints.count()
    # more blocks to agree in where there are more fingerprints, so that shards stay small
    shared = next((c for c in (1, 2, 3) if n >> (64 * c // (c + radius)) <= SHARD_ROWS // 2), 4)
    keys = F.array(*(F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(block_masks(shared, radius))))
    dealt = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")

    def links(values: np.ndarray) -> list[np.ndarray]:
        values = np.unique(values.view(np.uint64))
        member, root = forest(values, radius)
        return [values[member].view(np.int64), values[root].view(np.int64)]

    return search_shards(cut_shards(dealt, ["t", "key"], "fp"), ["t", "key"], ["fp"], links, "a long, b long")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the SimHash of every whole text, as a signed long."""
    return per_document(docs, [id], lambda: lambda data: (signed(fingerprint(data)),), f"{id} {docs.schema[id].dataType.simpleString()}, fp long", text)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of every row; component_id is the smallest id that its links reach."""
    own = materialise(fingerprints(docs, id, text), "fingerprints")
    nodes = materialise(own.groupBy("fp").agg(F.min(id).alias("least")), "nodes")
    roots = materialise(components(link_fingerprints(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root"), "members")
    least = materialise(roots.join(nodes, "fp").groupBy("root").agg(F.min("least").alias("group_least")), "groups")
    linked = roots.join(least, "root").select("fp", "group_least")
    classes = materialise(nodes.join(linked, "fp", "left").select("fp", F.coalesce("group_least", "least").alias("component_id")), "classes")
    return own.join(classes, "fp").select(id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
