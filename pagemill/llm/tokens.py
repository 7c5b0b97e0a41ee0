"""Token-id output: length-delimited binary records with masked checksums, and an offset index beside each file.

A shard is a file of MAGIC and records. A record is its payload's length (8 bytes), that length's masked checksum (4),
the payload, and the payload's masked checksum (4). A payload is a flag byte (1: the document has no id; 2: ids of 2
bytes, which records have whose ids allow it, else of 4), the document's id (8 bytes, signed), and the token ids. All numbers are little-endian; a checksum is CRC-32 masked as
((crc >> 15 | crc << 17) + MASK). Beside shard-N.bin, shard-N.idx has (offset, number of ids), 8 bytes each, by record,
so that readers may take records in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import new_path, partitions, stage
from pagemill.llm.encode import Encoder, groups

# Fixed values of the file format.
MAGIC = b"PMTOK\x00\x01\n"
MASK = 0xA282EAD8
END_ID = 2

_HEAD, _TAIL, _ID = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq")
_FILES = "shard int, uri string, records long, ids long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return _HEAD.pack(len(payload), masked(size)) + payload + _TAIL.pack(masked(payload))


class DamagedRecord(ValueError):
    """A record whose length or content doesn't fit its checksum, or that ends early."""


def records(stream):
    """The payloads of an open shard, in order."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise DamagedRecord("not a token file")
    while head := stream.read(_HEAD.size):
        if len(head) < _HEAD.size:
            raise DamagedRecord("ends within a length")
        size, check = _HEAD.unpack(head)
        if masked(head[:8]) != check:
            raise DamagedRecord("length")
        payload = stream.read(size)
        tail = stream.read(_TAIL.size)
        if len(payload) < size or len(tail) < _TAIL.size or masked(payload) != _TAIL.unpack(tail)[0]:
            raise DamagedRecord("payload")
        yield payload


def payload_of(doc: int | None, code: bytes) -> bytes:
    ids = np.frombuffer(code, "<u4")
    small = not len(ids) or int(ids.max()) < 1 << 16
    return _ID.pack((doc is None) + 2 * small, doc or 0) + (ids.astype("<u2").tobytes() if small else code)


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc = _ID.unpack_from(payload)
    return (None if flags & 1 else doc), np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=_ID.size).astype("<u4")


def read_at(uri: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """The records of one shard by number, in the order asked for, through its offset index."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path.removesuffix(".bin") + ".idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    out = []
    with fs.open_input_file(path) as f:
        for k in numbers:
            f.seek(int(index[k, 0]))
            size, check = _HEAD.unpack(f.read(_HEAD.size))
            payload = f.read(size)
            if masked(struct.pack("<Q", size)) != check or masked(payload) != _TAIL.unpack(f.read(_TAIL.size))[0]:
                raise DamagedRecord(f"{uri} record {k}")
            out.append(parsed(payload))
    return out


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Encodes whole texts and writes them as record files in ascending id order; returns the manifest (shard, uri, records, ids).

    Documents are dealt to shards by ranges of their ids (and, for ids that repeat, of a hash of the text), so shards in
    order hold all ids in order; nulls come first. Each task writes its shard under a name of its own and renames it when
    it is whole, so a task that is run again, or twice, leaves the same file. path (default: a new folder in the shared
    one) must be one that pyarrow's file systems reach from every executor. Null texts are empty; every document has a
    record, repeated rows too; empty tables write no shard. Other columns are not written, whatever their names.
    """
    spark = docs.sparkSession
    top = path or new_path(spark, "tokens")
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    slim = slim.repartitionByRange(shards or partitions(spark), *order[:2]).sortWithinPartitions(*order)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches):
        shard, stream, n, total = TaskContext.get().partitionId(), None, 0, 0
        fs, folder = pafs.FileSystem.from_uri(top)
        temp, at, index = f"{folder}/.{shard:06d}-{uuid.uuid4().hex}", len(MAGIC), None
        encoder = Encoder.at(tokenizer)
        for batch in batches:
            if stream is None:
                fs.create_dir(folder, recursive=True)
                stream, index = fs.open_output_stream(f"{temp}.bin", buffer_size=1 << 20), fs.open_output_stream(f"{temp}.idx", buffer_size=1 << 16)
                stream.write(MAGIC)
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in groups(texts):
                for doc, code in zip(ids[a:b], encoder.encode(texts[a:b]), strict=True):
                    code += end
                    record = frame(payload_of(doc, code))
                    stream.write(record)
                    index.write(struct.pack("<QQ", at, len(code) // 4))
                    at, n, total = at + len(record), n + 1, total + len(code) // 4
        if stream is not None:
            stream.close()
            index.close()
            name = f"{folder}/shard-{shard:06d}"
            fs.move(f"{temp}.idx", f"{name}.idx")
            fs.move(f"{temp}.bin", f"{name}.bin")
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{top}/shard-{shard:06d}.bin"]), pa.array([n]), pa.array([total])], ["shard", "uri", "records", "ids"])

    return stage(slim.mapInArrow(write, _FILES), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest back, checksums and all: (doc_id, start, n_tokens, ids_crc32), start being the ids of all records before.

    One task a shard; what lies before a shard is a running sum over the manifest, which has one row a shard.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "uri", before.alias("before"), "ids", "records").repartitionByRange(partitions(manifest.sparkSession), "shard")

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                start, n, part = row["before"], 0, []
                fs, path = pafs.FileSystem.from_uri(row["uri"])
                with fs.open_input_stream(path, buffer_size=1 << 20) as stream:
                    for payload in records(stream):
                        doc, ids = parsed(payload)
                        part.append((doc, start, len(ids), zlib.crc32(ids)))
                        start, n = start + len(ids), n + 1
                        if len(part) == 10_000:
                            yield _rows(part)
                            part = []
                if (n, start) != (row["records"], row["before"] + row["ids"]):
                    raise DamagedRecord(f"{row['uri']} has {n} records; the manifest has {row['records']}")
                yield _rows(part)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(part: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return read_tokens(write_tokens(docs, tokenizer or default_tokenizer()))


def query(spark, sf_dir: str) -> DataFrame:
    return token_files(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
