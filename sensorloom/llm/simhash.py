"""SimHash near duplicates: fingerprints of 64 bits, linked through BK-trees.

Fingerprints that differ in at most ``radius`` bits agree in one of radius + 1 pieces of
their bits, so each is routed to a shard for each of its pieces. What still shares a piece
in great numbers is routed on by the pieces of its other bits, as long as that halves the
pairs; so only fingerprints that are nearly equal stay together, and a group of these is
dealt to shards of a bounded size. Each shard becomes a BK-tree: the children of a node are keyed by
their Hamming distance to it. Spark sends each tree, which has a bounded number of nodes,
to the fingerprints of its route (as a broadcast if the trees are counted to be few, else
in a join), and a search follows only edges within the radius of the distance at hand.
Fingerprints are distinct from the start: copies are one class.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table, text_slices, thin
from sensorloom.llm.graph import components
from sensorloom.llm.runs import worded
from sensorloom.plans.staging import staged

RADIUS = 3
SEED = 42
#: Most fingerprints of a tree and of a block of queries; a route beyond is split again, or dealt.
SHARD = 4_096
#: Pairs of queries and nodes looked at in one step.
STEP = 500_000
#: Trees are broadcast only if they were counted to have at most so many nodes (16 bytes each).
BROADCAST_NODES = 500_000

#: Pairs of a tree and a block of queries that a task takes.
PAIRS_IN_TASK = 16

_POINTS = np.int64(65)


# --- fingerprints -----------------------------------------------------------

def shingle_hashes(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles of each text, XXH64 of every shingle). A-Z lower-cased; a text of fewer words is one shingle."""
    import xxhash

    bounds, flat = worded(texts, lower=True)
    # Words with a blank behind them lie one after the other, so a shingle is a slice.
    spaced = pc.binary_join_element_wise(flat, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    spaced = spaced.take(pa.array(np.arange(len(spaced)))).cast(pa.large_binary())
    offsets = np.frombuffer(spaced.buffers()[1], np.int64, len(spaced) + 1, spaced.offset * 8) if len(spaced) else np.zeros(1, np.int64)
    size = np.diff(bounds)
    many = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(size)), many)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    first = bounds[doc] + place
    last = np.minimum(first + k, bounds[doc + 1])
    data = spaced.buffers()[2].to_pybytes() if len(spaced) else b""
    shingles = [data[a:b] for a, b in zip(offsets[first].tolist(), (offsets[last] - 1).tolist(), strict=True)]
    return many, np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def simhash(many: np.ndarray, hashes: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """One fingerprint for each text: the bits that more than half of its hashes have."""
    ends = np.cumsum(many)
    counts = np.zeros((len(many), 64), np.int64)
    for lo in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[lo : lo + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = np.searchsorted(ends, np.arange(lo, lo + len(bits)), "right")
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > many[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long). Texts without words have fingerprint 0."""

    def prints(batches):
        for part in text_slices(batches):
            found = simhash(*shingle_hashes(part.column("text"), k))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64), pa.int64())], names=["doc_id", "fingerprint"])

    return thin(docs, doc_id=F.col("doc_id").cast("long"), text="text").mapInArrow(prints, "doc_id long, fingerprint long")


# --- BK-trees ---------------------------------------------------------------

class Forest:
    """BK-trees of several routes. Every fingerprint is a node; edges are sorted by parent and distance."""

    def __init__(self, route: np.ndarray, prints: np.ndarray) -> None:
        """Level by level: what lies at one distance from a node goes to its child of that distance, the first to come."""
        self.prints = prints
        self.routes, first = np.unique(route, return_index=True)
        self.roots = first
        at = first[np.searchsorted(self.routes, route)]
        waiting = np.flatnonzero(at != np.arange(len(prints)))
        edges, children = [], []
        while len(waiting):
            node = at[waiting]
            edge = node * _POINTS + np.bitwise_count(prints[waiting] ^ prints[node]).astype(np.int64)
            named, lead, which = np.unique(edge, return_index=True, return_inverse=True)
            child = waiting[lead]
            edges.append(named)
            children.append(child)
            at[waiting] = child[which]
            waiting = waiting[at[waiting] != waiting]
        edge, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, children))
        order = np.argsort(edge, kind="stable")
        self.edge, self.child = edge[order], child[order]

    def search(self, route: np.ndarray, prints: np.ndarray, radius: int):
        """Yield (query, node) arrays of all fingerprints of the query's route within ``radius`` bits."""
        tree = np.searchsorted(self.routes, route)
        known = tree < len(self.routes)
        known[known] = self.routes[tree[known]] == route[known]
        stack = [(np.flatnonzero(known), self.roots[tree[known]])]
        while stack:
            who, node = stack.pop()
            if len(who) > STEP:
                half = len(who) // 2
                stack += [(who[:half], node[:half]), (who[half:], node[half:])]
                continue
            far = np.bitwise_count(prints[who] ^ self.prints[node]).astype(np.int64)
            hit = far <= radius
            if hit.any():
                yield who[hit], node[hit]
            # A fingerprint within the radius of the query is off the node's distance by the radius at most.
            lo = np.searchsorted(self.edge, node * _POINTS + np.maximum(far - radius, 0), "left")
            hi = np.searchsorted(self.edge, node * _POINTS + np.minimum(far + radius, 64), "right")
            many = hi - lo
            if many.any():
                shift = np.repeat(lo - (np.cumsum(many) - many), many)
                stack.append((np.repeat(who, many), self.child[shift + np.arange(len(shift))]))


def forest_links(tree_route, tree_prints, query_route, query_prints, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found by the queries in the trees, as few pairs (a, b) that join the same fingerprints. Distinct fingerprints only."""
    forest = Forest(tree_route, tree_prints)
    # A fingerprint is a node in each of its routes; as a vertex it is one.
    vertices = np.unique(np.concatenate([tree_prints, query_prints]))
    label = np.arange(len(vertices))
    own = np.searchsorted(vertices, query_prints)
    theirs = np.searchsorted(vertices, tree_prints)

    def top(x: np.ndarray) -> np.ndarray:
        while True:
            y = label[x]
            if (y == x).all():
                return x
            x = label[y]

    for who, node in forest.search(query_route, query_prints, radius):
        a, b = own[who], theirs[node]
        while True:
            a, b = top(a), top(b)
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
    label = top(label)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return vertices[moved], vertices[label[moved]]


# --- shards -----------------------------------------------------------------

def _routed(rows: DataFrame, bits: int, radius: int) -> DataFrame:
    """Rows (route, rest, fingerprint) go to a route for each piece of their ``bits`` rest bits; the other bits are the new rest."""
    pieces = radius + 1
    edges = [bits * i // pieces for i in range(pieces + 1)]
    made = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        piece = F.shiftrightunsigned(F.col("rest"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        low = F.col("rest").bitwiseAND(F.lit((1 << lo) - 1)) if lo else F.lit(0).cast("long")
        # Shifts of 64 bits go by 0 in Java, so there is nothing above the last piece.
        high = F.shiftleft(F.shiftrightunsigned(F.col("rest"), hi), lo) if hi < 64 else F.lit(0).cast("long")
        made.append(F.struct(F.xxhash64("route", F.lit(i), piece).alias("route"), high.bitwiseOR(low).alias("rest")))
    return rows.select("fingerprint", F.explode(F.array(*made)).alias("_to")).select("_to.route", "_to.rest", "fingerprint")


def routes(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(route, fingerprint) of the distinct ``prints`` in routes of at most ``shard`` members, and the same of routes that cannot be split further.

    Routes of one member link nothing and are left out. A route is a 64-bit hash: if two
    share it, more is compared and nothing is lost.
    """
    bits, small = 64, []
    large = prints.select(F.lit(0).cast("long").alias("route"), F.col("fingerprint").alias("rest"), "fingerprint")
    pairs = float("inf")
    while True:
        rows = staged(_routed(large, bits, radius), "routes")
        # At least that many bits are gone from the rest of each route.
        bits -= bits // (radius + 1)
        count = staged(rows.groupBy("route").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "route-sizes")
        now = count.agg(F.sum(F.col("n").cast("double") ** 2)).first()[0] or 0.0
        if now > pairs / 2:
            # The members agree in too many bits: the routes of the round before stay whole.
            break
        small.append(rows.join(count.where(F.col("n") <= shard), "route").select("route", "fingerprint"))
        hot = count.where(F.col("n") > shard)  # at most 1 / shard of the rows
        large = rows.join(F.broadcast(hot), "route").select("route", "rest", "fingerprint")
        pairs = hot.agg(F.sum(F.col("n").cast("double") ** 2)).first()[0] or 0.0
        if not pairs or bits <= radius:
            break
    return reduce(DataFrame.unionByName, small), large.select("route", "fingerprint")


def _links_within(routed: DataFrame, radius: int, shard: int) -> DataFrame:
    """Links (a, b) within routes of at most ``shard`` members: whole routes are dealt to groups, and a group is a forest."""
    total = routed.count()
    groups = max(1, -(-total // (4 * shard)))

    def find(rows: pa.Table) -> pa.Table:
        route, prints = (np.asarray(rows.column(c).combine_chunks()) for c in ("route", "fingerprint"))
        route, prints = route.astype(np.int64), prints.astype(np.int64).view(np.uint64)
        a, b = forest_links(route, prints, route, prints, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = routed.withColumn("_group", F.pmod(F.xxhash64("route", F.lit(17)), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(find, "a long, b long")


def _links_across(routed: DataFrame, radius: int, shard: int) -> DataFrame:
    """Links within routes of any size: each is dealt to shards, and every tree meets every block of queries of its route.

    Trees and blocks have about ``shard`` members, whatever the size of a route, and a task takes a few of their pairs.
    """
    count = routed.groupBy("route").agg(F.count(F.lit(1)).alias("_n")).select(F.col("route").alias("_route"), F.ceil(F.col("_n") / shard).cast("int").alias("_many"))
    dealt = routed.join(F.broadcast(count), F.col("route") == F.col("_route"))  # at most 1 / shard of the rows
    dealt = dealt.select("route", "fingerprint", F.pmod(F.xxhash64("fingerprint", F.lit(19)), F.col("_many")).cast("int").alias("part"))
    members = F.sort_array(F.collect_list("fingerprint")).alias("prints")
    blocks = staged(dealt.groupBy("route", "part").agg(members), "shards")
    # The trees of a route meet the blocks up to their own number: each pair of fingerprints once.
    nodes, pairs = blocks.agg(F.sum(F.size("prints")), F.sum(F.col("part") + 1)).first()
    trees = blocks.select(F.col("route").alias("_route"), F.col("part").alias("_part"), F.col("prints").alias("_prints"))
    trees = F.broadcast(trees) if (nodes or 0) <= BROADCAST_NODES else trees
    paired = blocks.join(trees, (F.col("route") == F.col("_route")) & (F.col("part") <= F.col("_part")))

    def find(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (np.asarray(batch.column(c)[i].values).astype(np.int64).view(np.uint64) for c in ("prints", "_prints"))
                x, y = forest_links(np.zeros(len(b), np.int64), b, np.zeros(len(a), np.int64), a, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    spread = paired.repartition(-(-(pairs or 1) // PAIRS_IN_TASK), "route", "part", "_part")
    return spread.select("prints", "_prints").mapInArrow(find, "a long, b long")


def simhash_components(docs: DataFrame, k: int = 3, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links of at most ``radius`` bits.

    Texts are lower-cased (A-Z) and cut at ASCII white space; every shingle of ``k`` words
    counts as often as it stands there. Null, empty and blank texts have fingerprint 0, which links like
    any other. Equal fingerprints are one component; repeated rows stay rows. Rows without
    doc_id link too: their component is the smallest id that is not null, or null. Other
    columns are ignored. An empty table gives no rows.
    """
    rows = staged(fingerprints(docs, k), "fingerprints")
    classes = staged(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    small, large = routes(classes.select("fingerprint"), radius, shard)
    links = _links_within(small, radius, shard).unionByName(_links_across(large, radius, shard))
    labels = staged(components(staged(links, "links").distinct()), "labels")
    named = classes.join(labels.select(F.col("node").alias("fingerprint"), "label"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.join(least, "label").select(F.col("fingerprint").alias("_print"), "component_id")
    # A fingerprint of many copies is a hot key; adaptive execution splits its rows.
    return rows.join(found, F.col("fingerprint") == F.col("_print")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op13_simhash_bk_trees")
def op13(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))
