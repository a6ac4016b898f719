"""Token-ID / binary output: fixed-width bit packing in shards with block offsets.

A shard file holds, all little-endian:

* a header of 32 bytes: magic, bits for an id, ids for a block;
* blocks of 64-bit words, each block holding `block` ids (the last one fewer) at `bits`
  bits an id, so that 64 ids fill `bits` words and unpack as numpy columns;
* a footer: block offsets (u64), for each document its id (i64), whether the id is
  present (u8) and the end of its ids (u64);
* a tail of 32 bytes: the footer's place, the number of blocks, documents and ids.

Any id range can be read alone through the block offsets. A folder's manifest, in JSON,
lists the shards that count in order, with the id each starts at, its documents and ids, and
has the bits of an id, the end id and a hash of the tokenizer. Files that it does not
name are leftovers of lost task attempts.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import bounded_batches, id_and_text, shared_folder

MAGIC = b"VFTOKENS"
BLOCK = 1 << 16
MANIFEST = "manifest.json"
HEAD, TAIL = struct.Struct("<8sIIQQ"), struct.Struct("<QQQQ")
#: Ids unpacked at a time by readers that pass over whole shards.
PIECE = 1 << 21


def bits_for(vocabulary: int) -> int:
    """The least width that holds every id below vocabulary."""
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at `bits` bits each; the last group of 64 is filled up with zeros."""
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    groups = -(-ids.size // 64)
    lanes = np.zeros((groups, 64), "<u8")
    lanes.reshape(-1)[: ids.size] = ids
    words = np.zeros((groups, bits), "<u8")
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(packed: bytes, bits: int, count: int) -> np.ndarray:
    words = np.frombuffer(packed, "<u8").reshape(-1, bits)
    lanes = np.empty((len(words), 64), "<u4")
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, lane] = x & mask
    return lanes.reshape(-1)[:count]


class ShardWriter:
    """Writes one shard as ids come, holding a block and 17 bytes a document."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        if block % 64 or not 1 <= bits <= 32:
            raise ValueError("a block is a multiple of 64 ids; an id has 1 to 32 bits")
        self.out, self.bits, self.block = out, bits, block
        self.place = HEAD.size
        self.rest: list[np.ndarray] = []
        self.resting = self.ids = 0
        self.offsets: list[int] = []
        self.docs: list[int | None] = []
        self.ends: list[int] = []
        out.write(HEAD.pack(MAGIC, bits, block, 0, 0))

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.place)
        self.out.write(data)
        self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.ids += ids.size
        self.ends.append(self.ids)
        self.rest.append(ids)
        self.resting += ids.size
        if self.resting >= 16 * self.block:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        held = np.concatenate(self.rest) if self.rest else np.empty(0, "<u4")
        whole = held.size if last else held.size - held.size % self.block
        for at in range(0, whole, self.block):
            self._put(held[at : min(at + self.block, whole)])
        self.rest, self.resting = [held[whole:]], held.size - whole

    def close(self) -> None:
        self._flush(last=True)
        present = np.array([d is not None for d in self.docs], "u1")
        for x in (np.array(self.offsets, "<u8"), np.array([d or 0 for d in self.docs], "<i8"), present, np.array(self.ends, "<u8")):
            self.out.write(x.tobytes())
        self.out.write(TAIL.pack(self.place, len(self.offsets), len(self.docs), self.ids))


class ShardReader:
    """Random access to a shard: `source` is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        magic, self.bits, self.block, _, _ = HEAD.unpack(self._at(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        end = source.seek(0, 2)
        foot, blocks, docs, self.n_ids = TAIL.unpack(self._at(end - TAIL.size, TAIL.size))
        raw = self._at(foot, end - TAIL.size - foot)
        self.offsets = np.append(np.frombuffer(raw, "<u8", blocks), np.uint64(foot)).astype("i8")
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 8 * blocks)
        self.present = np.frombuffer(raw, "u1", docs, 8 * (blocks + docs)).astype(bool)
        self.ends = np.frombuffer(raw, "<u8", docs, 8 * (blocks + docs) + docs).astype("i8")

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, reading their blocks alone."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError((start, stop))
        if start == stop:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        raw = self._at(self.offsets[first], int(self.offsets[last + 1] - self.offsets[first]))
        base = first * self.block
        return unpack(raw, self.bits, stop - base)[start - base :]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def checksums(self) -> Iterator[tuple[int, int]]:
        """(ids, crc32 of the ids as u32) for each document in order, a piece at a time."""
        at, have, held = 0, 0, np.empty(0, "<u4")
        for end in self.ends.tolist():
            n, crc = end - at, 0
            while at < end:
                if not held.size:
                    have_to = min(have + PIECE, self.n_ids)
                    held, have = self.ids(have, have_to), have_to
                take = held[: end - at]
                crc = zlib.crc32(take.tobytes(), crc)
                held, at = held[take.size :], at + take.size
            yield n, crc


def write_shards(docs: DataFrame, spec_json: str, folder: str, end_id: int, vocabulary: int) -> dict:
    """Writes docs in ascending doc_id order, then the manifest, which it returns.

    The order is by doc_id, nulls first, then by a hash of the text, then by the text. A
    shard is a range partition. A task writes under a name of its own attempt and the
    manifest names the attempt that was counted, so lost or repeated tasks do no harm.
    """
    bits = bits_for(max(vocabulary, end_id + 1))
    spec = docs.sparkSession.sparkContext.broadcast(spec_json)

    def shard(batches):
        from pyspark import TaskContext

        encoder = tokens.worker_encoder(spec.value)
        task = TaskContext.get()
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.tok"
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        end = np.array([end_id], "<u4").tobytes()
        with store.open_output_stream(posixpath.join(path, name)) as out:
            writer = ShardWriter(out, bits)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    writer.add(doc_id, np.frombuffer(encoder.encode(text) + end, "<u4"))
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [len(writer.docs)], "ids": [writer.ids]})

    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    made = ordered.mapInArrow(shard, "part long, name string, docs long, ids long").collect()  # one row a shard
    manifest = {"bits": bits, "end_id": end_id, "tokenizer_sha256": hashlib.sha256(spec_json.encode()).hexdigest(), "shards": []}
    start = 0
    for r in sorted(made, key=lambda r: r["part"]):
        manifest["shards"].append({"file": r["name"], "start": start, "documents": r["docs"], "ids": r["ids"]})
        start += r["ids"]
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(posixpath.join(path, MANIFEST + ".part")) as out:
        out.write(json.dumps(manifest).encode())
    store.move(posixpath.join(path, MANIFEST + ".part"), posixpath.join(path, MANIFEST))
    return manifest


def read_manifest(folder: str) -> dict:
    store, path = pafs.FileSystem.from_uri(folder)
    with store.open_input_file(posixpath.join(path, MANIFEST)) as f:
        return json.loads(f.read())


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the files that the folder's manifest names."""
    shards = read_manifest(folder)["shards"]
    starts, names = [x["start"] for x in shards], [x["file"] for x in shards]

    def read(batches):
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with store.open_input_file(posixpath.join(path, names[k])) as f:
                    reader = ShardReader(f)
                    sums = np.array(list(reader.checksums()), "i8").reshape(-1, 2)
                    start = starts[k] + np.concatenate([[0], reader.ends[:-1]]) if len(reader.ends) else np.empty(0, "i8")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, mask=~reader.present), pa.array(start.astype("i8")), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = len(names)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encodes, packs, writes and reads back every document.

    docs needs doc_id and text; further columns are ignored. A null or empty text holds
    the end id alone; texts are encoded whole, whatever their length. A null doc_id sorts first; repeated doc_ids keep a row each, in the
    order of a hash of their texts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spec_json = tokens.read_json(tokenizer)
    folder = folder or shared_folder(spark, "tokens")
    size = tokens.ChunkEncoder(spec_json).tokenizer.get_vocab_size()
    write_shards(id_and_text(docs), spec_json, folder, end_id, size)
    return read_index(spark, folder)
