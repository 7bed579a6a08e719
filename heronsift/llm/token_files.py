"""Token ids in files: documents compressed one by one with a shared dictionary.

File format.  A folder with two Parquet tables:

``dictionary``  one row: ``sha256``, the zstandard ``dictionary`` (may be empty),
                ``width`` in bytes of a stored id, little-endian.
``frames``      one row per block of consecutive documents: ``shard`` and
                ``block`` order it, ``shard_start`` counts the ids of the
                shard's earlier blocks; ``first_id`` and ``last_id`` bound its
                documents' ids, ``doc_ids``, ``n_tokens`` and ``ends`` (byte offset
                after each document's frame) are the index, and ``payload``
                holds the frames.  ``dictionary_sha256`` says which dictionary
                they need.
``shards``      one row per shard: ``n_tokens`` and ``start``, the ids before it.

Any document is read from its block and the dictionary alone
(``read_documents``).  Shards and blocks follow ascending document ids (null
first, with the least possible id); rows that share an id follow the hash of
their texts, by which an id with very many rows is spread over shards.  Shards
are as many as shuffle partitions, and more where a shard's texts would pass
``SHARD_BYTES``.  A null or empty text is the end id alone; an empty table gives
an empty folder; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched_by_bytes, sample_by_hash
from .tokens import encoder, slices

#: Bytes of text that a shard holds at most, about.
SHARD_BYTES = 128 << 20
#: A block closes at this many documents or payload bytes.
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: Documents from which the dictionary is trained, ids taken of each, its size.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 2000, 2048, 112_640

FRAMES = "shard int, block int, shard_start long, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, ends array<long>, payload binary, dictionary_sha256 string"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; too few samples give an empty one."""
    samples = [s for s in samples if s]
    total = sum(map(len, samples))
    if len(samples) < 20 or total < 20_000:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples).as_bytes()
    except zstandard.ZstdError:  # samples too much alike
        return b""


def _as_dict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


#: Stands for a null id in the order of documents.
_LEAST = -(1 << 63)


def _shards(spark: SparkSession, placed: DataFrame) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """How many shards there are, and the (id, hash) at which all but the first begin.

    An id that takes several quantiles is cut at even steps of its texts' hashes.
    """
    total = placed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    if shards == 1:
        return 1, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    cuts = placed.select(F.percentile_approx("at", [(k + 1) / shards for k in range(shards - 1)], min(20 * shards, 1 << 20)).alias("q")).first().q
    ids, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    steps = [(-(1 << 63)) + (1 << 64) * k // (int(n) + 1) for n in times for k in range(1, int(n) + 1)]
    at = np.repeat(ids, times)
    # An id met once among the quantiles begins a shard as a whole.
    hashes = np.where(np.repeat(times, times) > 1, np.array(steps, np.int64), np.int64(_LEAST))
    return len(at) + 1, (at, hashes)


def _shard_of(bounds: tuple[np.ndarray, np.ndarray], at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The shard of each (id, hash): how many bounds are not above it."""
    ids, hashes = bounds
    lo, hi = np.searchsorted(ids, at, "left"), np.searchsorted(ids, at, "right")
    out = hi.copy()
    for k in np.flatnonzero(hi > lo).tolist():
        out[k] = lo[k] + np.searchsorted(hashes[lo[k] : hi[k]], h[k], "right")
    return out


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 0,
    spaces_matter: bool = True,
    level: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode, compress and write ``docs`` under ``path`` in the format above.

    An id is stored in as many bytes as the tokenizer's vocabulary needs.
    """
    spark = docs.sparkSession
    dtype = "<u2" if max(encoder(tokenizer_path, spaces_matter).size - 1, end_id) < 1 << 16 else "<u4"
    narrow = batched_by_bytes(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def serial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, spaces_matter)
        for b in batches:
            for some in slices(b, 1):
                flat, ends = enc.encode_column(some.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([flat[lo : min(hi, lo + SAMPLE_IDS)].astype(dtype).tobytes() for lo, hi in zip(ends, ends[1:])], pa.binary())], ["ids"])

    samples = [bytes(r.ids) for r in sample_by_hash(narrow, "doc_id", SAMPLE_DOCS).mapInArrow(serial, "ids binary").collect()]
    raw = train_dictionary(samples)
    digest = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(digest, bytearray(raw), int(dtype[2]))], "sha256 string, dictionary binary, width int").coalesce(1).write.parquet(f"{path}/dictionary")

    placed = narrow.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("at"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    shards, bounds = _shards(spark, placed)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, zc = encoder(tokenizer_path, spaces_matter), zstandard.ZstdCompressor(level=level, dict_data=_as_dict(raw))
        for b in batches:
            for some in slices(b, 3):
                flat, ends = enc.encode_ended(some.column(3), end_id)
                flat = flat.astype(dtype)
                made = pa.array([zc.compress(flat[lo:hi].tobytes()) for lo, hi in zip(ends.tolist(), ends[1:].tolist())], pa.binary())
                shard = _shard_of(bounds, some.column(0).to_numpy(), some.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), some.column(1), some.column(2), pa.array(np.diff(ends)), made], ["shard", "doc_id", "h", "n", "frame"])
        enc.settle()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        shard, block, start, size = None, 0, 0, 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(h[2]) for h in held]).tolist()
            known = [h[0] for h in held if h[0] is not None]
            numbers = [(shard, pa.int32()), (block, pa.int32()), (start, pa.int64()), (known[0] if known else None, pa.int64()), (held[-1][0], pa.int64())]
            lists = [[h[0] for h in held], [h[1] for h in held], ends]
            columns = [pa.array([v], t) for v, t in numbers] + [pa.array([v], pa.list_(pa.int64())) for v in lists]
            columns += [pa.array([b"".join(h[2] for h in held)], pa.binary()), pa.array([digest])]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FRAMES.split(", ")])

        for b in batches:
            for s, d, n, f in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4))):
                if held and (s != shard or len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES):
                    yield out()
                    block, start = (block + 1, start + sum(h[1] for h in held)) if s == shard else (0, 0)
                    held, size = [], 0
                shard = s
                held.append((d, n, f))
                size += len(f)
        if held:
            yield out()

    (
        placed.mapInArrow(frames, "shard int, doc_id long, h long, n long, frame binary")
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "h")
        .mapInArrow(blocks, FRAMES)
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/frames")
    )
    # One row per shard.
    per = spark.read.schema(FRAMES).parquet(f"{path}/frames").groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_tokens"))
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per.withColumn("start", before).write.parquet(f"{path}/shards")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents with these ids: ``doc_id, ids`` (little-endian, 4 bytes each).

    Parquet's bounds leave the blocks that may hold them; of these only the
    documents' own frames are cut out by their offsets and decompressed.
    """
    head = spark.read.schema("sha256 string, dictionary binary, width int").parquet(f"{path}/dictionary").first()
    raw, dtype = bytes(head.dictionary), f"<u{head.width}"
    wanted = [int(d) for d in doc_ids]

    def decompressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zd = zstandard.ZstdDecompressor(dict_data=_as_dict(raw))
        for b in batches:
            made = [np.frombuffer(zd.decompress(f), dtype).astype("<u4").tobytes() for f in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["doc_id", "ids"])

    near = F.lit(False)
    for d in wanted:
        near = near | ((F.col("first_id") <= d) & (F.col("last_id") >= d))
    blocks = spark.read.schema(FRAMES).parquet(f"{path}/frames").filter(near)
    places = blocks.select("payload", F.explode(F.arrays_zip("doc_ids", F.concat(F.array(F.lit(0).cast("long")), "ends").alias("starts"), "ends")).alias("x")).filter(F.col("x.doc_ids").isin(wanted))
    frame = F.substring("payload", (F.col("x.starts") + 1).cast("int"), (F.col("x.ends") - F.col("x.starts")).cast("int"))
    return places.select(F.col("x.doc_ids").alias("doc_id"), frame.alias("frame")).mapInArrow(decompressed, "doc_id long, ids binary")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``start``, ``ids`` (little-endian, 4 bytes each)."""
    return _decoded(spark, path, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    return _decoded(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _decoded(spark: SparkSession, path: str, column: str, make, kind: pa.DataType) -> DataFrame:
    head = spark.read.schema("sha256 string, dictionary binary, width int").parquet(f"{path}/dictionary").first()
    digest, raw, dtype = head.sha256, bytes(head.dictionary), f"<u{head.width}"

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zd = zstandard.ZstdDecompressor(dict_data=_as_dict(raw))
        for b in batches:
            for row in range(b.num_rows):
                first, doc_ids, counts, ends, payload, sha = (b.column(k)[row].as_py() for k in range(6))
                if sha != digest:
                    raise ValueError(f"block needs dictionary {sha}, found {digest}")
                starts = first + np.cumsum([0, *counts])[:-1]
                values, lo = [], 0
                for n, hi in zip(counts, ends):
                    ids = np.frombuffer(zd.decompress(payload[lo:hi]), dtype)
                    if len(ids) != n:
                        raise ValueError("a frame does not hold as many ids as its index says")
                    values.append(make(ids))
                    lo = hi
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, kind)], ["doc_id", "start", "n_tokens", column.split()[0]])

    shards = spark.read.schema("shard int, n_tokens long, start long").parquet(f"{path}/shards").select("shard", F.col("start").alias("base"))
    return (
        spark.read.schema(FRAMES).parquet(f"{path}/frames")
        .join(F.broadcast(shards), "shard")  # a row per shard
        .select((F.col("base") + F.col("shard_start")).alias("first"), "doc_ids", "n_tokens", "ends", "payload", "dictionary_sha256")
        .mapInArrow(documents, f"doc_id long, start long, n_tokens long, {column}")
    )
