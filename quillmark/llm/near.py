"""SimHash near-dedup by BK-trees at a given Jaccard similarity, for the pipeline's stage.

Texts whose sets of five-word shingles are equal become one node with a
SimHash. Shards hold the nodes
that agree in all of ``ROWS`` minimum hashes of one of ``BANDS`` bands (a pair
at 0.8 misses all bands with a probability of 5e-6), since blocks of the
SimHash itself tell nothing at the radius that 0.8 needs: such a pair differs
in ten bits on average, and ``RADIUS`` is five standard deviations above. In
each shard a BK-tree over the SimHashes is searched along the edges within the
radius; a pair that it finds is likely if ``LIKELY`` of the minimum hashes
agree (at 0.8 this fails with a probability of 1e-8).

What likely pairs connect is a cluster, which holds all links of its nodes.
Clusters are searched the same way once more, and now each likely pair whose
nodes aren't yet connected is held against the exact sets. A search gives a
spanning forest of what it links, so no group's pairs are written out, and
shards of more than a bounded number of nodes are cut into parts that meet in
pairs, so none is collected in one task.

Cases: null, empty and blank texts have no words and are copies of each other;
texts of fewer than five words are one shingle; rows that repeat an id are
judged each by its own text; rows without id take no part and stay; of rows of
one group that tie at the smallest id one stays; an empty table gives an empty
table; very long texts are hashed in blocks; extra columns pass through
``drop_copies`` untouched.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, divide_by_members, likely_members, materialise, per_document, with_made
from .components import components
from .simhash import BKTree, cut_shards, majority, search_shards, signed

WORDS, SEED = 5, 42
#: Least similarity of near-duplicates, as a fraction.
SHARE, OF = 4, 5
BANDS, ROWS = 40, 6
#: Bits in which the SimHashes of a pair may differ, and the share of its minimum hashes that must agree.
RADIUS, LIKELY = 24, 0.63
#: Nodes of a cluster that all meet, and of a shard that is held against the exact sets.
CLUSTER, EXACT_ROWS = 20_000, 1000
#: Shingles whose minimum hashes are taken at a time.
BLOCK = 512


def shingles(data: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    own = data.lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(own[i : i + WORDS]), SEED) for i in range(max(1, len(own) - WORDS + 1))], "<u8"))


def node_of(held: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(held.tobytes(), SEED))


def similar(common: Column | int, a: Column | int, b: Column | int) -> Column | bool:
    return OF * common >= SHARE * (a + b - common)


class Sketcher:
    """The band keys and the signature (a byte of each minimum hash) of a set of hashes."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.factor, self.shift = (rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
        self.factor |= np.uint64(1)

    def sketch(self, held: np.ndarray) -> tuple[list[int], bytes]:
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
        for at in range(0, len(held), BLOCK):
            np.minimum(least, (held[at : at + BLOCK] * self.factor + self.shift).min(axis=1), out=least)
        bands = least.reshape(BANDS, ROWS)
        keys = np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64).view(np.int64).tolist()
        return keys, (least >> np.uint64(56)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, node, n, fp, bands, signature) of every row that has an id."""

    def make():
        sketcher = Sketcher()

        def one(data: bytes) -> tuple:
            held = shingles(data)
            return node_of(held), len(held), signed(majority(held)), *sketcher.sketch(held)

        return one

    return per_document(docs.where(F.col(id).isNotNull()), [id], make, f"{id} {docs.schema[id].dataType.simpleString()}, node long, n int, fp long, bands array<long>, signature binary", text)


def sets(docs: DataFrame, nodes: DataFrame, id: str, text: str) -> DataFrame:
    """(node, hashes) of nodes (node, least) and of some more, from the texts of their least ids; hashes are packed, repeated rows come again. No text is shuffled."""

    def make():
        def one(data: bytes) -> tuple:
            held = shingles(data)
            return node_of(held), held.tobytes()

        return one

    likely = likely_members(docs.select(id, text), F.xxhash64(id), nodes, F.xxhash64("least"))
    return per_document(likely, [], make, "node long, hashes binary", text)


def likely_pairs(n: np.ndarray, fp: np.ndarray, signature: np.ndarray):
    """(place, later places) within the BK-tree's radius whose sizes and signatures allow a similar pair."""
    bytes_of = np.frombuffer(b"".join(signature), np.uint8).reshape(len(signature), -1)
    for at, near in BKTree(fp.view(np.uint64)).within(RADIUS):
        near = near[OF * np.minimum(n[near], n[at]) >= SHARE * np.maximum(n[near], n[at])]
        if len(near):
            near = near[(bytes_of[near] == bytes_of[at]).mean(axis=1) >= LIKELY]
            if len(near):
                yield at, near


class Groups:
    """Groups of a shard's places, and the links that joined them."""

    def __init__(self, n: int):
        self.of, self.a, self.b = np.arange(n), [], []

    def other(self, at: int, near: np.ndarray) -> np.ndarray:
        return near[self.of[near] != self.of[at]]

    def link(self, at: int, near: np.ndarray) -> None:
        """Join the place's group with the places' groups, by one link each."""
        found, first = np.unique(self.of[near], return_index=True)
        self.a += [at] * len(first)
        self.b += near[first].tolist()
        self.of[np.isin(self.of, found)] = self.of[at]

    def pairs(self, node: np.ndarray) -> list[np.ndarray]:
        return [node[np.array(x, np.int64)] for x in (self.a, self.b)]


def likely_links(node: np.ndarray, n: np.ndarray, fp: np.ndarray, signature: np.ndarray) -> list[np.ndarray]:
    """Pairs (a, b) that span what the shard's likely pairs connect."""
    groups = Groups(len(node))
    for at, near in likely_pairs(n, fp, signature):
        if len(near := groups.other(at, near)):
            groups.link(at, near)
    return groups.pairs(node)


def similar_links(node: np.ndarray, n: np.ndarray, fp: np.ndarray, signature: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Pairs (a, b) that span what the shard's similar pairs connect, each held against the exact sets."""
    node, first = np.unique(node, return_index=True)
    n, fp, signature, hashes = n[first], fp[first], signature[first], hashes[first]
    groups = Groups(len(node))
    _, code = np.unique(np.frombuffer(b"".join(hashes), "<u8"), return_inverse=True)
    ends = np.cumsum(n)
    own = [code[e - k : e] for e, k in zip(ends, n, strict=True)]
    marked = np.zeros(len(code), bool)
    for at, near in likely_pairs(n, fp, signature):
        if not len(near := groups.other(at, near)):
            continue
        marked[own[at]] = True
        sizes = n[near]
        common = np.add.reduceat(marked[np.concatenate([own[i] for i in near])].astype(np.int32), np.cumsum(sizes) - sizes)
        marked[own[at]] = False
        if len(near := near[similar(common, sizes, n[at])]):
            groups.link(at, near)
    return groups.pairs(node)


def links(docs: DataFrame, nodes: DataFrame, id: str, text: str) -> DataFrame:
    """Links (a, b) that join all similar nodes of nodes (node, least, n, fp, bands, signature) that share a band."""
    dealt = nodes.select("node", F.explode("bands").alias("key"))
    # a node has a key once, so a key that comes twice is shared; only rows that may have one are shuffled again
    shared = materialise(dealt.groupBy("key").count().where("count > 1").select("key"), "shared")
    members = materialise(likely_members(dealt, F.col("key"), shared, F.col("key")).join(shared, "key", "left_semi").select("key", "node"), "members")
    some = materialise(members.select("node").distinct(), "some")
    own = materialise(likely_members(nodes.select("node", "least", "n", "fp", "signature"), F.col("node"), some, F.col("node")).join(some, "node", "left_semi"), "candidates")
    columns = ["node", "n", "fp", "signature"]
    likely = search_shards(cut_shards(members.join(own.drop("least"), "node"), ["key"], "node"), ["key"], columns, likely_links, "a long, b long")
    clusters = materialise(components(likely), "clusters")
    sized = clusters.join(clusters.groupBy("root").agg(F.count("*").alias("size")), "root")
    # of a small cluster all meet at once, and each set is sent once or a few times; of a large one those that share a band
    small = sized.where(F.col("size") <= CLUSTER).select(F.lit(True).alias("whole"), F.col("root").alias("key"), "node")
    large = members.join(sized.where(F.col("size") > CLUSTER).select("node"), "node", "left_semi").select(F.lit(False).alias("whole"), "key", "node")
    linked = materialise(own.join(clusters.select("node"), "node", "left_semi"), "clustered")
    held = materialise(sets(docs, linked, id, text), "sets")
    rows = small.unionByName(large).join(linked.drop("least"), "node").join(held, "node")
    out = materialise(search_shards(cut_shards(rows, ["whole", "key"], "node", EXACT_ROWS), ["whole", "key"], [*columns, "hashes"], similar_links, "a long, b long"), "linked")
    for used in (shared, members, some, own, clusters, linked, held):
        discard(used)
    return out


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, node, root, component_id) of every row that has an id; a group has one root, and component_id is its smallest id."""
    own = materialise(sketches(docs, id, text), "sketches")
    nodes = materialise(own.groupBy("node").agg(F.min(id).alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "bands", "signature"))), "nodes")
    roots = materialise(components(links(docs, nodes, id, text)).select("node", "root"), "roots")
    least = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("group_least"))
    linked = materialise(roots.join(least, "root"), "groups")
    classes = nodes.join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("group_least", "least").alias("component_id"))
    out = materialise(own.select(id, "node").join(materialise(classes, "classes"), "node").select(id, "node", "root", "component_id"), "near-duplicates")
    for used in (own, nodes, roots, linked):
        discard(used)
    return out


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one of the smallest id, all columns as they are."""
    groups = near_copies(docs, id, text)
    repeated = materialise(groups.groupBy(F.col(id).alias("own")).count().where("count > 1").select("own"), "repeated")
    gone = materialise(groups.where(F.col(id) != F.col("component_id")).select(F.col(id).alias("own")).distinct(), "copies")
    out = gone.unionByName(repeated)
    # only the texts of rows that may go are shuffled
    maybe, stays = divide_by_members(docs, F.xxhash64(id), out, F.xxhash64("own"))
    kept = stays.unionByName(maybe.join(out, F.col(id) == F.col("own"), "left_anti").select(*docs.columns))
    if repeated.isEmpty():
        return kept
    # rows whose id says not which text they are: their nodes are made again
    def make():
        return lambda data: (node_of(shingles(data)),)

    node, group = "node__", "root__"
    again = with_made(likely_members(docs, F.xxhash64(id), repeated, F.xxhash64("own")).join(repeated, F.col(id) == F.col("own"), "left_semi").select(*docs.columns), make, f"{node} long", text)
    first = groups.where(F.col(id) == F.col("component_id")).select(F.col("component_id").alias("least__"), F.col("node").alias(node), F.col("root").alias(group)).distinct()
    rows = again.join(first, [node], "inner").where(F.col(id) == F.col("least__"))
    return kept.unionByName(rows.dropDuplicates([id, group]).select(*docs.columns))
