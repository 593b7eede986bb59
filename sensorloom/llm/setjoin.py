"""Exact Jaccard self-join of shingle sets by partitioning the universe.

Sets whose sizes lie in one band or in two neighbouring bands share a scheme. A
scheme bounds the difference of linked sets by ``gap`` shingles and hashes the
universe into segments. A segment is indexed as a whole (it tolerates no
difference) or with the neighbourhood of all its one-deletions too (it tolerates
one). If the tolerances and the number of segments add up to ``gap + 1``, linked
sets agree in a segment (pigeonhole), so no link is lost. How many segments take
deletions is chosen for each scheme by its cost on a sample: index rows and
expected candidates. That choice and the sample change the work, never the result.
A few segments more than needed are cut, so that linked sets agree in that many more:
a set with no more empty segments than those leaves the empty ones out of the index,
which many unrelated sets would share.

Copies are one class from the start. Among the classes under one key, the most
central one is the lead, and the others are compared with it. What this leaves in
different components is compared in blocks within the group of a lead; blocks of one
component are skipped. So no pairs of a group are listed, and still every candidate
pair is decided. First parity maps are compared: each shingle flips one bit of its
set's map, so maps differ in no more bits than the sets in shingles, and a pair whose
maps differ in more than the gap of its sizes is no link. Only what passes is
verified, on the shingles of the texts themselves.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.base import query, sized, table, thin, unused, whole
from sensorloom.llm.graph import components
from sensorloom.plans.staging import staged

#: Documents of the sample for the cost of a scheme, and of the one that finds keys shared by 1 % of all documents.
COST_SAMPLE, HOT_SAMPLE = 1_000, 10_000
#: Cost of a candidate pair in index rows.
PAIR_COST = 50
#: Members and shingles of a block.
BLOCK_SETS, BLOCK_SHINGLES = 400, 200_000

_U = np.uint64
_ROWS = 1_000


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser, one for each salt."""
    with np.errstate(over="ignore"):
        x = (x + _U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


@dataclass(frozen=True)
class Rules:
    """Link if 100 * intersection >= percent * union, over shingles of ``k`` words."""

    k: int = 3
    percent: int = 90

    def edges(self, most: int) -> np.ndarray:
        """Smallest sizes of the bands up to sets of ``most`` shingles."""
        out = [1]
        while out[-1] <= most:
            out.append(out[-1] * 100 // self.percent + 1)
        return np.array(out, np.int64)

    def gaps(self, edges: np.ndarray) -> np.ndarray:
        """Most shingles in which linked sets of each scheme differ."""
        a = edges[1:] - 1
        return (100 - self.percent) * (a + a * 100 // self.percent) // (100 + self.percent)

    def linked(self, both: int, either: int) -> bool:
        return 100 * both >= self.percent * either


def shingled(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, fingerprint) of the distinct shingles, by document. Words split at ASCII white space, A-Z lower-cased."""
    import xxhash

    # Taken anew: Arrow splits slices that do not start at their buffer's first text wrongly.
    texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    bounds -= bounds[0]
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    full = np.fromiter(map(len, names), np.int64, len(names)) > 0
    codes = np.asarray(coded.indices)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    keep = full[codes] if len(codes) else np.zeros(0, bool)
    doc, h = doc[keep], hashes[codes[keep]] if len(codes) else np.zeros(0, np.uint64)
    length = np.bincount(doc, minlength=len(texts))
    start = np.cumsum(length) - length
    # A shingle stands at each word that has k - 1 words behind it; a shorter text is one shingle.
    place = np.arange(len(doc)) - start[doc]
    first = (place + k <= length[doc]) | ((place == 0) & (length[doc] < k))
    at = np.flatnonzero(first)
    acc = np.full(len(at), 7, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = place[at] + j < length[doc[at]]
            acc = np.where(inside, _mix(acc * _U(0x100000001B3) + h[np.minimum(at + j, max(0, len(h) - 1))], j), acc)
    doc = doc[at]
    order = np.lexsort((acc, doc))
    doc, acc = doc[order], acc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (acc[1:] != acc[:-1])
    return doc[new], acc[new]


def _classes(doc: np.ndarray, prints: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and an id for each set, equal for equal sets."""
    size = np.bincount(doc, minlength=rows)
    one, two = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(one, doc, _mix(prints, 11))
        np.add.at(two, doc, _mix(prints, 12))
        return size, _mix(one ^ (_mix(two, 13) + size.astype(np.uint64)), 14).view(np.int64)


def parity_maps(doc: np.ndarray, prints: np.ndarray, size: np.ndarray) -> list[bytes]:
    """A bit map for each set: as many bits as the next power of two from its size on (64 at least), flipped by each shingle."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.cumsum(bits) - bits
    place = base[doc] + (_mix(prints, 31) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    flipped = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
    packed = np.packbits(flipped, bitorder="little").tobytes()
    return [packed[b // 8 : (b + n) // 8] for b, n in zip(base.tolist(), bits.tolist(), strict=True)]


def _folded(bits: bytes, width: int) -> int:
    """The map in ``width`` bits: as if its shingles had been put into so many."""
    value, n = int.from_bytes(bits, "little"), 8 * len(bits)
    while n > width:
        n //= 2
        value = (value >> n) ^ (value & ((1 << n) - 1))
    return value


def may_link(a: bytes, b: bytes, size_a: int, size_b: int, percent: int) -> bool:
    """False only if the sets differ in too many shingles for a link."""
    low, high = min(size_a, size_b), max(size_a, size_b)
    if 100 * low < percent * high:
        return False
    width = 8 * min(len(a), len(b))
    return (_folded(a, width) ^ _folded(b, width)).bit_count() <= (100 - percent) * (low + high) // (100 + percent)


def spare(edges: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Segments beyond those needed: about the most that stay empty in a band's smallest sets."""
    out = np.zeros(len(gaps), np.int64)
    for k, (n, gap) in enumerate(zip(edges[:-1].tolist(), gaps.tolist(), strict=True)):
        while gap and out[k] < gap:
            m = gap + 1 + out[k]
            empty = m * np.exp(-n / m)
            if out[k] >= empty + 2 * np.sqrt(empty):
                break
            out[k] += 1
    return out


def _keys(doc, prints, size, edges, segments, deleting, slack=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scheme, document, key) of all index entries: each set under its own band's scheme and the one below.

    ``slack``: segments of a scheme beyond those needed. Empty segments without
    deletions are left out where a set has no more of them than that.
    """
    slack = np.zeros(len(segments), np.int64) if slack is None else slack
    band = np.searchsorted(edges, size, "right") - 1
    for down in (0, 1):
        scheme = band - down
        used = (size > 0) & (scheme >= 0)
        m = np.where(used, segments[np.maximum(scheme, 0)], 0)
        base = np.cumsum(m) - m
        mine = used[doc]
        d, p = doc[mine], prints[mine]
        segment = (_mix(p, 21) % m[d].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(int(m.sum()), np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(sums, base[d] + segment, _mix(p, 22))
            owner = np.repeat(np.arange(len(size)), m)
            number = np.arange(len(sums)) - base[owner]
            tag = _mix((scheme[owner] * 1_000_003 + number).astype(np.uint64), 23)
            empty = (np.bincount(base[d] + segment, minlength=len(sums)) == 0) & (number >= deleting[scheme[owner]])
            few = np.bincount(owner[empty], minlength=len(size)) <= slack[np.maximum(scheme, 0)]
            kept = ~(empty & few[owner])
            yield scheme[owner[kept]], owner[kept], _mix(sums ^ tag, 24).view(np.int64)[kept]
            gone = segment < deleting[scheme[d]]
            if gone.any():
                d, p, at = d[gone], p[gone], (base[d] + segment)[gone]
                yield scheme[d], d, _mix((sums[at] - _mix(p, 22)) ^ tag[at], 24).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            yield batch.slice(lo, _ROWS)


def set_ids(docs: DataFrame, rules: Rules) -> DataFrame:
    """The columns of ``docs`` but ``text``, and n_shingles, cid (the class of documents with the same set), bits (its parity map)."""
    own = [c for c in docs.columns if c != "text"]

    def ids(batches):
        for part in _parts(batches):
            doc, prints = shingled(part.column("text"), rules.k)
            size, cid = _classes(doc, prints, part.num_rows)
            maps = parity_maps(doc, prints, size)
            yield pa.RecordBatch.from_arrays(
                [*map(part.column, own), pa.array(size, pa.int64()), pa.array(cid, pa.int64()), pa.array(maps, pa.binary())], names=[*own, "n_shingles", "cid", "bits"]
            )

    return docs.mapInArrow(ids, "".join(f"{c} long, " for c in own) + "n_shingles long, cid long, bits binary")


def index_rows(docs: DataFrame, rules: Rules, edges: np.ndarray, segments: np.ndarray, deleting: np.ndarray) -> DataFrame:
    """(key, cid) of every set; copies within a batch give one."""
    slack = segments + deleting - rules.gaps(edges) - 1

    def keys(batches):
        for part in _parts(batches):
            doc, prints = shingled(part.column("text"), rules.k)
            size, cid = _classes(doc, prints, part.num_rows)
            first = np.zeros(part.num_rows, bool)
            first[np.unique(cid, return_index=True)[1]] = True
            mine = first[doc]
            for _, owner, key in _keys(doc[mine], prints[mine], np.where(first, size, 0), edges, segments, deleting, slack):
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(cid[owner], pa.int64())], names=["key", "cid"])

    return docs.mapInArrow(keys, "key long, cid long")


def _sample(docs: DataFrame, rows: int, total: int) -> DataFrame:
    if total <= rows:
        return docs
    return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < max(1, rows * 1_000_000 // total))


def allocate(docs: DataFrame, rules: Rules, edges: np.ndarray, total: int, sample: int = COST_SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Segments of each scheme, and how many of them take one-deletions, at the least cost on the sample."""
    gaps = rules.gaps(edges)
    slack = spare(edges, gaps)
    options = [0, 1, 2, 4, 8, 16]

    def shapes(q: int) -> tuple[np.ndarray, np.ndarray]:
        deleting = np.minimum(q, (gaps + 1) // 2)
        return gaps + 1 + slack - deleting, deleting

    def rows(batches):
        for part in _parts(batches):
            doc, prints = shingled(part.column("text"), rules.k)
            size, cid = _classes(doc, prints, part.num_rows)
            for q in options:
                for scheme, owner, key in _keys(doc, prints, size, edges, *shapes(q), slack):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), q), pa.int32()), pa.array(scheme, pa.int32()), pa.array(key, pa.int64()), pa.array(cid[owner], pa.int64())],
                        names=["q", "scheme", "key", "cid"],
                    )

    coded = _sample(docs, sample, total).mapInArrow(rows, "q int, scheme int, key long, cid long").groupBy("q", "scheme", "key").agg(F.count_distinct("cid").alias("n"))
    up = max(1.0, total / sample)
    found = coded.groupBy("q", "scheme").agg(F.sum("n").alias("rows"), F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()  # options x schemes
    best: dict[int, tuple[float, int]] = {}
    for r in found:
        cost = float(r["rows"]) * up + PAIR_COST * float(r["pairs"]) * up * up
        best[r["scheme"]] = min(best.get(r["scheme"], (float("inf"), 0)), (cost, r["q"]))
    deleting = np.minimum(np.array([best.get(k, (0, 0))[1] for k in range(len(gaps))], np.int64), (gaps + 1) // 2)
    return gaps + 1 + slack - deleting, deleting


def _shingle_set(text: str, k: int) -> frozenset:
    w = text.encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)])


def _passing(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The (lead, cid) that sizes and parity maps do not rule out. Thin rows."""
    own = classes.select("cid", F.col("n_shingles").alias("n"), "bits")
    other = classes.select(F.col("cid").alias("lead"), F.col("n_shingles").alias("lead_n"), F.col("bits").alias("lead_bits"))

    def passing(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bits", "lead_bits", "n", "lead_n")]
            keep = pa.array([may_link(*row, percent) for row in zip(*columns, strict=True)], pa.bool_())
            yield batch.select(["lead", "cid"]).filter(keep)

    sized_pairs = pairs.join(own, "cid").join(other, "lead").where(100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n"))
    return sized_pairs.mapInArrow(passing, "lead long, cid long")


def _verified(pairs: DataFrame, rules: Rules) -> DataFrame:
    """Links (a, b) among rows with the texts of both."""

    def verify(batches):
        held: OrderedDict[int, frozenset] = OrderedDict()

        def of(cid: int, text: str) -> frozenset:
            if cid not in held:
                held[cid] = _shingle_set(text, rules.k)
                if len(held) > 50:
                    held.popitem(last=False)
            return held[cid]

        for batch in batches:
            lead, cid = batch.column("lead").to_pylist(), batch.column("cid").to_pylist()
            linked = []
            for i, (a, b) in enumerate(zip(lead, cid, strict=True)):
                x, y = of(a, batch.column("lead_text")[i].as_py()), _shingle_set(batch.column("text")[i].as_py(), rules.k)
                both = len(x & y)
                linked.append(rules.linked(both, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("cid")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return pairs.mapInArrow(verify, "a long, b long")


def block_links(rows: pa.Table, k: int, percent: int) -> list[tuple[int, int]]:
    """Pairs of labels that a linked pair of sets across or within two blocks joins, as a forest. Columns: side, label, text."""
    sets = [_shingle_set(t, k) for t in rows.column("text").to_pylist()]
    label, side = np.array(rows.column("label").to_pylist(), np.int64), np.array(rows.column("side").to_pylist())
    number: dict = {}
    own = [np.fromiter((number.setdefault(s, len(number)) for s in x), np.int64, len(x)) for x in sets]
    size = np.array([len(x) for x in sets], np.int64)
    n, wide = len(sets), 4096
    both = np.zeros((n, n), np.float32)
    member = np.repeat(np.arange(n), size)
    token = np.concatenate(own) if own else np.zeros(0, np.int64)
    order = np.argsort(token, kind="stable")
    member, token = member[order], token[order]
    for lo in range(0, len(number), wide):
        a, b = np.searchsorted(token, [lo, lo + wide])
        part = np.zeros((n, wide), np.float32)
        part[member[a:b], token[a:b] - lo] = 1
        both += part @ part.T
    either = size[:, None] + size[None, :] - both
    linked = (100 * both >= percent * either) & (label[:, None] < label[None, :])
    if (side == 1).any():
        linked &= side[:, None] != side[None, :]
    i, j = np.nonzero(linked)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in np.unique(np.stack([label[i], label[j]], 1), axis=0).tolist() if len(i) else []:
        if root(a) != root(b):
            parent[root(a)] = root(b)
            out.append((a, b))
    return out


def survivors(rows: pa.Table, percent: int) -> pa.Table:
    """The rows (side, label, bits, n_shingles) of two blocks that may be linked with a row of another label across (or within one block)."""
    labels, sides = rows.column("label").to_pylist(), rows.column("side").to_pylist()
    bits, sizes = rows.column("bits").to_pylist(), rows.column("n_shingles").to_pylist()
    two = 1 in sides
    folds: dict[tuple[int, int], int] = {}

    def fold(i: int, width: int) -> int:
        if (i, width) not in folds:
            folds[i, width] = _folded(bits[i], width)
        return folds[i, width]

    keep = [False] * len(sizes)
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if percent * sizes[j] > 100 * sizes[i]:
                break
            if (keep[i] and keep[j]) or labels[i] == labels[j] or (two and sides[i] == sides[j]):
                continue
            width = 8 * len(bits[i])
            if (fold(i, width) ^ fold(j, width)).bit_count() <= (100 - percent) * (sizes[i] + sizes[j]) // (100 + percent):
                keep[i] = keep[j] = True
    return rows.filter(pa.array(keep, pa.bool_()))


def _within_leads(pairs: DataFrame, labels: DataFrame, classes: DataFrame, fetch, rules: Rules) -> DataFrame:
    """Links between members of one lead's group that are still in different components."""
    own = labels.select(F.col("node").alias("cid"), "label")
    leads = labels.select(F.col("node").alias("lead"), F.col("label").alias("lead_label"))
    members = (
        pairs.join(own, "cid", "left").withColumn("label", F.coalesce("label", "cid")).join(leads, "lead", "left")
        .withColumn("bin", (~F.col("label").eqNullSafe(F.col("lead_label"))).cast("int")).select("lead", "cid", "label", "bin")
    )
    groups = members.groupBy("lead").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("lead")
    members = staged(members.join(groups, "lead", "left_semi").join(classes.select("cid", "n_shingles"), "cid"), "members")
    bins = members.groupBy("lead", "bin").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("_many"))
    dealt = staged(members.join(bins, ["lead", "bin"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("_many")).cast("int")).drop("_many"), "blocks")
    blocks = dealt.groupBy("lead", "bin", "part").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns]) for s in "ab")
    # Pairs of blocks, a few hundred sets each; members in the lead's own component are one label.
    first = F.struct(F.col("bin_a").alias("b"), F.col("part_a").alias("p"))
    second = F.struct(F.col("bin_b").alias("b"), F.col("part_b").alias("p"))
    paired = a.join(b, (F.col("lead_a") == F.col("lead_b")) & (first <= second)).where(F.least("lo_a", "lo_b") < F.greatest("hi_a", "hi_b"))
    paired = staged(paired.select(F.col("lead_a").alias("lead"), "bin_a", "part_a", "bin_b", "part_b"), "block-pairs")
    key = ["lead", "bin_a", "part_a", "bin_b", "part_b"]
    left = paired.select("*", F.col("bin_a").alias("bin"), F.col("part_a").alias("part"), F.lit(0).alias("side"))
    right = paired.where((F.col("bin_a") != F.col("bin_b")) | (F.col("part_a") != F.col("part_b"))).select("*", F.col("bin_b").alias("bin"), F.col("part_b").alias("part"), F.lit(1).alias("side"))
    rows = left.unionByName(right).join(dealt, ["lead", "bin", "part"]).join(classes.select("cid", "bits"), "cid")
    rows = rows.select(*key, "side", "cid", "label", "bits", "n_shingles")
    names = [*key, "side", "cid", "label"]

    def sift(rows: pa.Table) -> pa.Table:
        return survivors(rows, rules.percent).select(names)

    kept = rows.groupBy(*key).applyInArrow(sift, "lead long, bin_a int, part_a int, bin_b int, part_b int, side int, cid long, label long")
    kept = staged(kept, "survivors")

    def decide(rows: pa.Table) -> pa.Table:
        found = block_links(rows, rules.k, rules.percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    texts = fetch(kept.select("cid"))
    return kept.join(texts, "cid").select(*key, "side", "label", "text").groupBy(*key).applyInArrow(decide, "a long, b long")


def _version() -> Column:
    """A hash of the text: a doc_id may be null or have several texts."""
    return F.xxhash64(whole(), F.lit(3))


def _grouped(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, version, n_shingles, and ``_least``: the first (no id, doc_id, version) reachable by links, rows without id last."""
    docs = thin(docs, doc_id=F.col("doc_id").cast("long"), version=_version(), text=whole())
    ids = staged(set_ids(docs, rules), "set-ids")
    top = ids.agg(F.count(F.lit(1)).alias("rows"), F.max("n_shingles").alias("most")).first()
    edges = rules.edges(int(top["most"] or 1))
    segments, deleting = allocate(docs, rules, edges, top["rows"])
    rows = index_rows(docs, rules, edges, segments, deleting)

    # Keys of 1 % of all documents and more are shared for certain: they need not meet in one task to be found so.
    some = min(HOT_SAMPLE, max(1, top["rows"]))
    hot = index_rows(_sample(docs, HOT_SAMPLE, top["rows"]), rules, edges, segments, deleting).groupBy("key").agg(F.count_distinct("cid").alias("n"))
    hot = staged(hot.where(F.col("n") >= max(50, some // 100)).select(F.col("key").alias("_hot")), "hot-keys")  # at most 100 for each index row of a set
    tagged = rows.join(F.broadcast(hot), F.col("key") == F.col("_hot"), "left")
    every = Window.partitionBy("key")
    cold = tagged.where("_hot IS NULL").select("key", "cid").withColumn("_lo", F.min("cid").over(every)).withColumn("_hi", F.max("cid").over(every))
    shared = cold.where("_lo < _hi").select("key", "cid").unionByName(tagged.where("_hot IS NOT NULL").select("key", "cid"))
    shared = staged(shared.distinct(), "shared-keys")

    # The lead of a key is the class whose keys are shared most.
    count = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    score = shared.join(count, "key").groupBy("cid").agg(F.sum("n").alias("score"))
    lead = shared.join(score, "cid").groupBy("key").agg(F.max_by("cid", F.struct("score", "cid")).alias("lead"))
    pairs = staged(shared.join(lead, "key").where("lead != cid").select("lead", "cid").distinct(), "candidates")

    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    classes = ids.groupBy("cid").agg(F.min(rep).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    reps = staged(classes, "classes")
    k = rules.k

    def checked(batches):  # another text may have the same hash
        for part in _parts(batches):
            _, cid = _classes(*shingled(part.column("text"), k), part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("want"), part.column("text")], names=["cid", "text"]).filter(pa.array(cid == np.asarray(part.column("want"))))

    def fetch(cids: DataFrame) -> DataFrame:
        """The text of one document of each class."""
        wanted = reps.join(cids.distinct(), "cid", "left_semi").select(F.col("cid").alias("want"), F.col("rep.doc_id").alias("_id"), F.col("rep.version").alias("_v"))
        found = docs.join(sized(staged(wanted, "wanted")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_v"))).select("want", "text")
        return staged(found.mapInArrow(checked, "cid long, text string").groupBy("cid").agg(F.first("text").alias("text")), "texts")

    likely = staged(_passing(pairs, reps, rules.percent), "likely")
    texts = fetch(likely.select("cid").unionByName(likely.select(F.col("lead").alias("cid"))))
    with_texts = likely.join(texts, "cid").join(texts.select(F.col("cid").alias("lead"), F.col("text").alias("lead_text")), "lead")
    labels = staged(components(staged(_verified(with_texts, rules), "links")), "labels")
    more = staged(_within_leads(pairs, labels, reps, fetch, rules), "more-links")
    joined = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)
    labels = staged(components(joined), "labels")

    whole_classes = reps.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = whole_classes.groupBy("label").agg(F.min("rep").alias("_least"))
    named = whole_classes.join(least, "label").select(F.col("cid").alias("_cid"), "_least")
    return ids.join(named, F.col("cid") == F.col("_cid")).select("doc_id", "version", "n_shingles", "_least")


def jaccard_components(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links.

    Null, empty and blank texts have an empty set and are linked with nothing.
    Rows that repeat are copies. Rows without doc_id link like any other; their
    component is the smallest id that is not null, or null. Other columns are ignored.
    """
    out = _grouped(docs, rules)
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("_least.doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, rules: Rules = Rules(5, 80)) -> DataFrame:
    """One row of ``docs`` of each group: the smallest doc_id, for equal ids the smallest text hash; rows without doc_id come last.

    A row is judged by its doc_id and text, so other texts of the same id, or
    without one, are not touched. Of rows that repeat one stays (any, if they
    differ in other columns). Texts without words are in no group and all stay.
    """
    found = _grouped(docs, rules).where("n_shingles > 0").groupBy("doc_id", "version").agg(F.first("_least").alias("_least"), F.count(F.lit(1)).alias("n"))
    own = F.col("doc_id").eqNullSafe(F.col("_least.doc_id")) & (F.col("version") == F.col("_least.version"))
    one, two = unused(docs, "_id", "_v")
    marked = staged(found.select(F.col("doc_id").alias(one), F.col("version").alias(two), own.alias("_first"), "n").where("NOT _first OR n > 1"), "gone")
    again = marked.where("_first").select(one, two)
    marked = marked.select(one, two)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (_version() == F.col(two))
    kept = docs.join(sized(marked), same, "left_anti")
    if again.isEmpty():
        return kept
    # Combined map-side: a row that repeats often is no hot key.
    repeated = docs.join(sized(again), same, "left_semi").withColumn(one, F.col("doc_id").cast("long")).withColumn(two, _version())
    return kept.union(repeated.dropDuplicates([one, two]).drop(one, two))


#: Every pair of documents with a common shingle, then the closure of their links.
_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least(c.x, c.y), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id"""


@query("op5_jaccard_join", _SQL)
def op5(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), Rules(3, 90))
