"""Token ids in length-delimited binary record files with a separate offset index.

A record file is a sequence of frames: payload length (unsigned 64-bit little-endian), masked
CRC-32C of those eight bytes, payload, masked CRC-32C of the payload (the framing of TFRecord
files).  A payload holds the ids of one document, 16-bit where the vocabulary allows, else
32-bit.  Beside ``NAME.rec`` lies ``NAME.idx`` with one fixed-size entry per record, so that a
shuffled reader seeks to any record without reading the others.

A task writes its shard under a name of its own and renames it when complete; a repeated or
speculative task writes the same bytes again.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconlake.llm.chunks import ChunkMemo
from beaconlake.llm.scratch import Scratch

#: key, offset of the frame, ids in the shard before it, number of ids, flags (1: the key is null).
ENTRY = struct.Struct("<qQQII")
_ENTRY_TYPE = np.dtype([("key", "<i8"), ("offset", "<u8"), ("before", "<u8"), ("n", "<u4"), ("flags", "<u4")])
_BLOCK = 256
#: Chunks that are encoded in a run, and in a call of the library.
_RUN, _CALL = 64, 1 << 13
#: Fixed values of the published format: the CRC-32C polynomial (reflected) and the mask.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table of CRC-32C, and four tables that advance a state over _BLOCK zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    shift = np.empty((4, 256), dtype=np.uint32)
    for k in range(4):
        state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(_BLOCK):
            state = table[state & 0xFF] ^ (state >> np.uint32(8))
        shift[k] = state
    return table, shift


_TABLE, _SHIFT = _tables()


def masked_crc32c(payloads: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each payload, all blocks of all payloads in step."""
    sizes = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads))
    blocks = np.maximum(1, -(-sizes // _BLOCK))
    first = np.concatenate(([0], np.cumsum(blocks)))
    grid = np.zeros(int(first[-1]) * _BLOCK, dtype=np.uint8)
    for i, payload in enumerate(payloads):  # right-aligned: leading zeros leave the state at zero
        end = int(first[i + 1]) * _BLOCK
        grid[end - len(payload) : end] = np.frombuffer(payload, np.uint8)
    start = first[1:] * _BLOCK - sizes
    for k in range(4):  # the initial state, folded into the first four bytes
        grid[start[sizes >= 4] + k] ^= 0xFF
    columns = np.ascontiguousarray(grid.reshape(-1, _BLOCK).T)
    state = np.zeros(int(first[-1]), dtype=np.uint32)
    for column in columns:
        state = _TABLE[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
    total = np.zeros(len(payloads), dtype=np.uint32)
    for k in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > k)
        t = total[live]
        total[live] = _SHIFT[0][t & 0xFF] ^ _SHIFT[1][(t >> 8) & 0xFF] ^ _SHIFT[2][(t >> 16) & 0xFF] ^ _SHIFT[3][t >> 24] ^ state[first[live] + k]
    for i in np.flatnonzero(sizes < 4):
        t = np.uint32(0xFFFFFFFF)
        for b in payloads[i]:
            t = _TABLE[(t ^ np.uint32(b)) & 0xFF] ^ (t >> np.uint32(8))
        total[i] = t
    crc = ~total
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)


def frames(payloads: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    head_crc, body_crc = masked_crc32c(heads).astype("<u4"), masked_crc32c(payloads).astype("<u4")
    return [b"".join((h, head_crc[i].tobytes(), p, body_crc[i].tobytes())) for i, (h, p) in enumerate(zip(heads, payloads))]


class LibraryTokenizer:
    """Packed ids from the tokenizers library, each distinct chunk of a group of texts encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.largest = max(vocabulary.values(), default=0)
        #: Of each id, whether its token begins with a space, as byte-level vocabularies write it.
        self.opens = np.zeros(self.largest + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.memo = ChunkMemo(self._encode, self._encode_spaced)

    def _encode(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in made]

    def _encode_spaced(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks with a space before each, many in a call: in a byte-level vocabulary only the first id of a chunk begins with a space."""
        out = []
        for at in range(0, len(chunks), _CALL):
            part = chunks[at : at + _CALL]
            runs = [" " + " ".join(part[k : k + _RUN]) for k in range(0, len(part), _RUN)]
            ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
            border = np.flatnonzero(self.opens[ids])
            if len(border) != len(part) or border[0]:  # another kind of vocabulary
                out += self._encode([" " + s for s in part])
                continue
            raw, border = ids.tobytes(), (4 * np.append(border, len(ids))).tolist()
            out += [raw[a:b] for a, b in zip(border, border[1:])]
        return out


_tokenizers: dict[str, LibraryTokenizer] = {}


def library_tokenizer(path: str) -> LibraryTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = LibraryTokenizer(path)
    return _tokenizers[path]


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int, wide: bool | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts, append ``end_id`` and write them in ascending key order; returns the manifest.

    The manifest, itself a table in ``folder``, has a row per shard: shard, name, records, ids,
    bytes; names sort like keys.  Null keys come first, equal keys in order of their text; null
    texts give the end id alone.  ``wide`` stores 32-bit ids; without it they are 16-bit if every id of
    the vocabulary and ``end_id`` fit, and ``wide=False`` fails if one doesn't.  Other columns are not
    written.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    ordered = docs.select(key, text).repartitionByRange(F.col(key)).sortWithinPartitions(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library_tokenizer(tokenizer_path)
        largest = max(end_id, tokenizer.largest)
        if wide is False and largest >= 1 << 16:
            raise ValueError(f"id {largest} does not fit 16 bits")
        broad = largest >= 1 << 16 if wide is None else wide
        kind = "<u4" if broad else "<u2"
        shard = TaskContext.get().partitionId()
        name, own = f"shard-{shard:06d}", f".{uuid.uuid4().hex}"
        files, root = pafs.FileSystem.from_uri(folder)
        records = ids = size = 0
        end = np.array([end_id], dtype=kind).tobytes()
        out = index = None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            for group in _grouped(tokenizer.memo.encode_all(texts)):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out, index = files.open_output_stream(f"{root}/{own}.rec"), files.open_output_stream(f"{root}/{own}.idx")
                payloads = [np.frombuffer(p, "<u4").astype(kind).tobytes() + end for p in group]
                entries = np.zeros(len(group), dtype=_ENTRY_TYPE)
                for i, (payload, frame) in enumerate(zip(payloads, frames(payloads))):
                    own_key = keys[at + i]
                    n = len(payload) // len(end)
                    entries[i] = (own_key or 0, size, ids, n, own_key is None)
                    out.write(frame)
                    size += len(frame)
                    ids += n
                index.write(entries.tobytes())
                records += len(group)
                at += len(group)
        if out is not None:
            out.close()
            index.close()
            for kind_of in ("rec", "idx"):
                files.move(f"{root}/{own}.{kind_of}", f"{root}/{name}.{kind_of}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "records": [records], "ids": [ids], "bytes": [size], "wide": [broad]}, schema=_MANIFEST)

    manifest = ordered.mapInArrow(run, "shard int, name string, records bigint, ids bigint, bytes bigint, wide boolean")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


_MANIFEST = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("wide", pa.bool_())])


def _grouped(packed: Iterator[bytes], size: int = 4 << 20) -> Iterator[list[bytes]]:
    group, held = [], 0
    for p in packed:
        group.append(p)
        held += len(p)
        if held >= size:
            yield group
            group, held = [], 0
    if group:
        yield group


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files in ``folder``: key, shard, ordinal, start, ids (packed 32-bit).

    ``start`` counts the ids of all records before, in key order.  Both checksums of every frame
    are verified against the bytes read; a mismatch, a frame that is not where the index says or a
    missing tail fails the task.
    """
    schema = "shard int, name string, records bigint, ids bigint, bytes bigint, wide boolean"
    manifest = spark.read.schema(schema).parquet(f"{folder}/manifest")
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
    # A number of tasks of its own: the rows are few and small, the files they name are not.
    tasks = max(1, min(manifest.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shards = manifest.withColumn("base", F.coalesce(before, F.lit(0).cast("bigint"))).repartition(tasks, "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, root = pafs.FileSystem.from_uri(folder)
            for row in batch.to_pylist():
                yield from _read_shard(files, f"{root}/{row['name']}", row)

    return shards.mapInArrow(run, "key bigint, shard int, ordinal bigint, start bigint, ids binary")


def _read_shard(files: pafs.FileSystem, path: str, row: dict) -> Iterator[pa.RecordBatch]:
    kind = "<u4" if row["wide"] else "<u2"
    done = offset = 0
    with files.open_input_stream(f"{path}.idx") as index, files.open_input_stream(f"{path}.rec") as data:
        while raw := index.read(_ENTRY_TYPE.itemsize * 1024):
            entries = np.frombuffer(raw, dtype=_ENTRY_TYPE)
            heads, head_crc, payloads, body_crc = [], [], [], []
            for e in entries:
                if int(e["offset"]) != offset:
                    raise ValueError(f"{path}: record {done + len(heads)} is not at {e['offset']}")
                head = data.read(12)
                (size,) = struct.unpack("<Q", head[:8])
                if size != int(e["n"]) * np.dtype(kind).itemsize:
                    raise ValueError(f"{path}: record {done + len(heads)} has another length than its index entry")
                body = data.read(size + 4)
                heads.append(head[:8])
                head_crc.append(head[8:])
                payloads.append(body[:-4])
                body_crc.append(body[-4:])
                offset += 16 + size
            for parts, sums in ((heads, head_crc), (payloads, body_crc)):
                if masked_crc32c(parts).astype("<u4").tobytes() != b"".join(sums):
                    raise ValueError(f"{path}: checksum mismatch")
            keys = pa.array(entries["key"].astype(np.int64), mask=entries["flags"] == 1)
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(np.full(len(entries), row["shard"], np.int32)),
                    pa.array(np.arange(done, done + len(entries), dtype=np.int64)),
                    pa.array(entries["before"].astype(np.int64) + row["base"]),
                    pa.array([np.frombuffer(p, kind).astype("<u4").tobytes() for p in payloads], pa.binary()),
                ],
                names=["key", "shard", "ordinal", "start", "ids"],
            )
            done += len(entries)
    if done != row["records"] or offset != row["bytes"]:
        raise ValueError(f"{path}: {done} records, {offset} bytes; the manifest says {row['records']}, {row['bytes']}")


def read_at(folder: str, name: str, ordinals: list[int], *, wide: bool = False) -> list[np.ndarray]:
    """Ids of chosen records of one shard, read by seeking through its index."""
    files, root = pafs.FileSystem.from_uri(folder)
    kind, out = "<u4" if wide else "<u2", []
    with files.open_input_file(f"{root}/{name}.idx") as index, files.open_input_file(f"{root}/{name}.rec") as data:
        for i in ordinals:
            index.seek(i * _ENTRY_TYPE.itemsize)
            entry = np.frombuffer(index.read(_ENTRY_TYPE.itemsize), dtype=_ENTRY_TYPE)[0]
            data.seek(int(entry["offset"]) + 12)
            out.append(np.frombuffer(data.read(int(entry["n"]) * np.dtype(kind).itemsize), kind))
    return out


def op2_records(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Contract columns, all from the files read back."""
    folder = Scratch(docs.sparkSession, "records").path
    write_records(docs, folder, tokenizer_path, end_id=end_id)
    found = read_records(docs.sparkSession, folder)
    return found.select(F.col("key").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "shard", "ordinal")
