"""Token ids in files, packed to a fixed width.

Each id takes the fewest bits that hold the vocabulary. Documents are dealt out by ranges of their id, so files
hold them in ascending order; a file's records are segments of whole documents. A segment has the ids packed in
blocks of ``BLOCK``, the byte offset of each block, the first id of each document and the ids before it in its file, so that numpy unpacks a
segment at once and any range of ids is read from its blocks alone. The files are Parquet, which Spark writes to
and reads from any store; ``payload`` is the packed bits.

Encoding is the tokenizers library's, asked once for each distinct piece between cuts (see ``pretokens``).

Defined results: a null text is empty and has the end id alone; rows with the same id follow one another in the
order of Spark's xxhash64 of their texts, so that one id can fill several files; null ids come first; a very long text
is a segment of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrid.llm import pretokens, shared, vectors

#: Ids in a block; a multiple of 8, so that blocks begin at whole bytes.
BLOCK = 4096
#: Bytes of text in a segment.
SEGMENT = 4 << 20
END_ID = 0

SEGMENT_FIELDS = (
    "shard int, segment int, width int, n_ids bigint, ids_before bigint, docs array<bigint>, starts array<bigint>, block_offsets array<bigint>, payload binary"
)


def bits_for(n: int) -> int:
    """The fewest bits that hold 0 to n - 1."""
    return max(1, int(n - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for k in range(0, len(ids), BLOCK):
        bits = np.unpackbits(ids[k : k + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        out.append(np.packbits(bits[:, :width], bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes | memoryview, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel()


def ids_between(payload: bytes, block_offsets: np.ndarray, width: int, n_ids: int, begin: int, end: int) -> np.ndarray:
    """The ids begin to end - 1 of a segment, from their blocks alone."""
    if begin >= end:
        return np.zeros(0, np.uint32)
    first, last = begin // BLOCK, (end - 1) // BLOCK
    stop = block_offsets[last + 1] if last + 1 < len(block_offsets) else len(payload)
    n = min(n_ids, (last + 1) * BLOCK) - first * BLOCK
    ids = unpack(memoryview(payload)[int(block_offsets[first]) : int(stop)], width, n)
    return ids[begin - first * BLOCK : end - first * BLOCK]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


@lru_cache(maxsize=2)
def memory(path: str) -> pretokens.Memory:
    library = tokenizer(path)

    def encode(found: list[bytes]) -> list[list[int]]:
        return [x.ids for x in library.encode_batch_fast([x.decode("utf-8", "surrogatepass") for x in found], add_special_tokens=False)]

    return pretokens.Memory(encode)


@lru_cache(maxsize=2)
def special_of(path: str) -> bytes:
    return next((x.content.encode() for x in tokenizer(path).get_added_tokens_decoder().values() if x.special), b"")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    off = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)))


def _segments(path: str, end_id: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, special = memory(path), special_of(path)
        width = bits_for(tokenizer(path).get_vocab_size(with_added_tokens=True))
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for piece in vectors.pieces(batch.column("text"), SEGMENT):
                ids, off = known(piece, special)
                ids = np.insert(ids, off[1:], end_id)
                starts = off + np.arange(len(off))
                n = int(starts[-1])
                offsets = np.arange(0, n, BLOCK) * width // 8
                docs = batch.column("doc").slice(piece.rows.start, piece.rows.stop - piece.rows.start)
                whole = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()),
                        pa.array([segment], pa.int32()),
                        pa.array([width], pa.int32()),
                        pa.array([n], pa.int64()),
                        pa.array([before], pa.int64()),
                        whole,
                        _lists([starts[:-1]]),
                        _lists([offsets]),
                        pa.array([pack(ids, width)], pa.binary()),
                    ],
                    names=["shard", "segment", "width", "n_ids", "ids_before", "docs", "starts", "block_offsets", "payload"],
                )
                segment, before = segment + 1, before + n

    return segments


def write(df: DataFrame, doc: str, text: str, tokenizer_path: str, out: str, end_id: int = END_ID) -> None:
    """Writes the ids of all texts, in ascending order of ``doc``, as files of segments."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("next"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(n, "doc", "next").sortWithinPartitions("doc", "next", "text").select("doc", "text")
    rows.mapInArrow(_segments(tokenizer_path, end_id), SEGMENT_FIELDS).write.option("compression", "none").parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            docs, starts = batch.column("docs")[k].values, batch.column("starts")[k].values.to_numpy()
            n = batch.column("n_ids")[k].as_py()
            ids = unpack(batch.column("payload")[k].as_buffer(), batch.column("width")[k].as_py(), n).astype("<u4")
            ends = np.append(starts[1:], n)
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            base = batch.column("base")[k].as_py()
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(starts + base), pa.array(ends - starts), pa.array(crcs, pa.int64())], names=["doc", "start", "n_tokens", "ids_crc32"]
            )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) for each document of the files."""
    files = spark.read.schema(SEGMENT_FIELDS).parquet(path)
    # One row for each file. There are no more files than ranges that ``write`` deals out, so this is small.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_base"))
    rows = files.join(F.broadcast(shards), "shard")
    rows = rows.select((F.col("shard_base") + F.col("ids_before")).alias("base"), "width", "n_ids", "docs", "starts", "payload")
    return rows.mapInArrow(_documents, "doc bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def report(df: DataFrame, doc: str, text: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files to the shared folder and returns what ``read`` finds there."""
    spark = df.sparkSession
    out = f"{shared.shared_dir(spark).rstrip('/')}/token-ids-{os.urandom(8).hex()}"
    write(df, doc, text, tokenizer_path, out, end_id)
    return read(spark, out).withColumnRenamed("doc", doc)
