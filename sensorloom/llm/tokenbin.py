"""Token files: blocks of ids transposed into byte or bit planes, each plane compressed.

A chunk holds whole documents up to about ``chunk_ids`` ids. Its ids are cut into
blocks of ``block_ids``; a block is transposed into planes (the lowest bytes of
all its ids, then the next ones; or the lowest bits, and so on), and each plane is
compressed with zstandard. Planes above the highest id of a block are left out.

A store is a folder with two tables: ``chunks`` (one row for each chunk: ids of
its documents, their lengths, sizes of its planes, the planes) and ``index`` (one
row for each chunk: file range, number, first document, documents, ids, and the
number of ids before it). Both are written by Spark's committer, so a lost
executor leaves no half file, and any store Spark writes to will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.llm.base import query, sized, table, thin, whole
from sensorloom.llm.tokens import encoded
from sensorloom.plans.staging import new_path

CHUNKS = "shard int, chunk int, mode string, doc_ids array<long>, lengths array<long>, n_ids long, blocks array<int>, planes array<int>, sizes array<int>, data binary"
DOCS = "doc_id long, start long, n_tokens long, ids binary"


def planes_of(ids: np.ndarray, mode: str) -> list[np.ndarray]:
    """The planes of a block, lowest first, none above the highest id."""
    parts = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    high = int(ids.max()).bit_length() if len(ids) else 0
    if mode == "byte":
        return [np.ascontiguousarray(parts[:, k]) for k in range((high + 7) // 8)]
    bits = np.unpackbits(parts, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(bits[:, k]), bitorder="little") for k in range(high)]


def ids_of(planes: list[np.ndarray], n: int, mode: str) -> np.ndarray:
    """The block of ``n`` ids with these planes."""
    parts = np.zeros((n, 4 if mode == "byte" else 32), np.uint8)
    for k, plane in enumerate(planes):
        parts[:, k] = plane if mode == "byte" else np.unpackbits(plane, bitorder="little")[:n]
    if mode == "bit":
        parts = np.packbits(parts, axis=1, bitorder="little")
    return np.ascontiguousarray(parts).view("<u4").reshape(-1)


def write_store(docs: DataFrame, folder: str, path: str, end: int, mode: str = "byte", block_ids: int = 8192, chunk_ids: int = 1 << 18, level: int = 3) -> None:
    """Encode whole texts (null: empty) and write them in ascending doc_id order (null first).

    Repeated doc_ids are kept, ordered by a hash of their text. Other columns are not stored.
    """
    if mode not in ("byte", "bit"):
        raise ValueError("mode is 'byte' or 'bit'")

    def chunks(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        from zstandard import ZstdCompressor

        pack, shard, number = ZstdCompressor(level=level), TaskContext.get().partitionId(), 0
        names, held, total = [], [], 0

        def closed():
            ids = np.concatenate(held)
            cut = [ids[lo : lo + block_ids] for lo in range(0, len(ids), block_ids)]
            split = [planes_of(b, mode) for b in cut]
            coded = [pack.compress(p.tobytes()) for planes in split for p in planes]
            row = {
                "shard": shard, "chunk": number, "mode": mode, "doc_ids": names, "lengths": [len(x) for x in held], "n_ids": len(ids),
                "blocks": [len(b) for b in cut], "planes": [len(p) for p in split], "sizes": [len(c) for c in coded], "data": b"".join(coded),
            }
            return pa.RecordBatch.from_pylist([row], schema=_CHUNKS)

        for part, coded in encoded(batches, path, end):
            for name, ids in zip(part.column("doc_id").to_pylist(), coded, strict=True):
                if held and total + len(ids) > chunk_ids:
                    yield closed()
                    names, held, total, number = [], [], 0, number + 1
                names.append(name)
                held.append(ids)
                total += len(ids)
        if held:
            yield closed()

    # The range bounds are sampled to the driver, so the texts themselves are no part of the order.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = thin(docs, doc_id=F.col("doc_id").cast("long"), text=whole())
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, CHUNKS).write.option("compression", "uncompressed").parquet(f"{folder}/chunks")
    spark = docs.sparkSession
    stored = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks").select("shard", "chunk", F.get("doc_ids", F.lit(0)).alias("first_doc"), F.get("doc_ids", F.size("doc_ids") - 1).alias("last_doc"), F.size("doc_ids").alias("n_docs"), "n_ids")
    # Two levels: totals of the shards before, then the chunks before within the shard.
    shards = stored.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    index = stored.withColumn("start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(F.broadcast(shards), F.col("shard") == F.col("_shard"))
    index.withColumn("start", (F.col("start") + F.col("_before")).cast("long")).drop("_shard", "_before").write.parquet(f"{folder}/index")


_CHUNKS = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("mode", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("n_ids", pa.int64()), ("blocks", pa.list_(pa.int32())), ("planes", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary()),
])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _decoded(batches: Iterator[pa.RecordBatch]):
    from zstandard import ZstdDecompressor

    unpack = ZstdDecompressor()
    for batch in batches:
        for row in range(batch.num_rows):
            c = batch.slice(row, 1).to_pylist()[0]
            data, sizes, at, blocks = memoryview(c["data"]), iter(c["sizes"]), 0, []
            for n, k in zip(c["blocks"], c["planes"], strict=True):
                planes = []
                for _ in range(k):
                    size = next(sizes)
                    planes.append(np.frombuffer(unpack.decompress(data[at : at + size]), np.uint8))
                    at += size
                blocks.append(ids_of(planes, n, c["mode"]))
            ids, ends = np.concatenate(blocks), np.cumsum(c["lengths"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c["doc_ids"], pa.int64()), pa.array(c["start"] + ends - c["lengths"], pa.int64()), pa.array(c["lengths"], pa.int64()),
                    pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, c["lengths"], strict=True)], pa.binary()),
                ],
                schema=_DOCS,
            )


def read_store(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32 bit).

    With ``first`` or ``last``, only documents with ids in that range, from the chunks that the index names.
    """
    index = spark.read.parquet(f"{folder}/index")
    inside = F.lit(True)
    if first is not None:
        index, inside = index.where(F.col("last_doc") >= first), inside & (F.col("doc_id") >= first)
    if last is not None:
        index, inside = index.where(F.col("first_doc") <= last), inside & (F.col("doc_id") <= last)
    index = sized(index.select(F.col("shard").alias("_s"), F.col("chunk").alias("_c"), F.col("start").cast("long").alias("start")))
    chunks = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")
    found = chunks.join(index, (F.col("shard") == F.col("_s")) & (F.col("chunk") == F.col("_c"))).drop("_s", "_c")
    return found.mapInArrow(_decoded, DOCS).where(inside)


@query("op2_bit_plane_tokens")
def op2(spark, sf_dir):
    import public_tokenizers

    folder = new_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return read_store(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
