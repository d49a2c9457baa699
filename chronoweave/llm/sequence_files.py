"""Token ids as length-delimited binary records with a separate offset index.

Fixed format. A record is: payload length (unsigned 64-bit), masked CRC-32C of these eight bytes (unsigned 32-bit), payload,
masked CRC-32C of the payload; all little-endian. The mask of a checksum is its rotation right by 15 bits plus 0xA282EAD8.
A payload is one byte (1 if the document has an id), the id (signed 64-bit), then the token ids, 2 or 4 bytes each as the
manifest says. ``part-NNNNN.records`` holds a range of documents in ascending order; ``part-NNNNN.index`` holds the offset of
each record (unsigned 64-bit), so that any reader can seek to the k-th sequence of a shuffled order. The manifest, one row a
part, is Parquet.

Parts are written by tasks under a name of their own and then renamed, so a repeated or speculative attempt leaves one whole
file. No document passes through the driver: it sees one row a part.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoweave.llm import common
from chronoweave.llm.common import Memo
from chronoweave.llm.pretokens import finder

CASTAGNOLI, MASK = 0x82F63B78, 0xA282EAD8
_HEAD, _HEAD_BYTES, _BLOCK = "<Bq", 9, 64


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Four tables that advance a CRC-32C over a 32-bit word, and four that advance it over a block of zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(CASTAGNOLI), byte >> 1).astype(np.uint32)
    word = [byte]
    for _ in range(3):
        word.append((word[-1] >> 8) ^ byte[word[-1] & 0xFF])
    word = np.stack(word[::-1])  # row j: byte j of the word, the first one having the longest way to go
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(_BLOCK // 4):
        bits = _advance(bits, word)
    zero = np.zeros((4, 256), dtype=np.uint32)
    for j in range(4):
        for k in range(8):
            zero[j] ^= np.where(np.arange(256) >> k & 1, bits[8 * j + k], 0).astype(np.uint32)
    return word, zero


def _advance(state: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][state & 0xFF] ^ tables[1][state >> 8 & 0xFF] ^ tables[2][state >> 16 & 0xFF] ^ tables[3][state >> 24]


def crc32c(parts: list[bytes]) -> list[int]:
    """CRC-32C of every byte string. Whole blocks of all strings are worked on side by side; a CRC is linear, so the blocks of
    one string are then joined by advancing over zeros."""
    word, zero = _tables()
    tables = [t.tolist() for t in word]
    longest = [t.tolist() for t in zero]
    counts = [len(p) // _BLOCK for p in parts]
    whole = b"".join(p[: n * _BLOCK] for p, n in zip(parts, counts, strict=True))
    words = np.frombuffer(whole, dtype="<u4").reshape(-1, _BLOCK // 4)
    state = np.zeros(len(words), dtype=np.uint32)
    for k in range(_BLOCK // 4):
        state = _advance(state ^ words[:, k], word)
    blocks, at, out = state.tolist(), 0, []
    byte, (z0, z1, z2, z3) = tables[3], longest
    for part, n in zip(parts, counts, strict=True):
        crc = 0xFFFFFFFF
        for b in blocks[at : at + n]:
            crc = z0[crc & 0xFF] ^ z1[crc >> 8 & 0xFF] ^ z2[crc >> 16 & 0xFF] ^ z3[crc >> 24] ^ b
        at += n
        for x in part[n * _BLOCK :]:
            crc = byte[(crc ^ x) & 0xFF] ^ crc >> 8
        out.append(crc ^ 0xFFFFFFFF)
    return out


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payloads: list[bytes]) -> list[bytes]:
    """Records of the payloads."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    crcs = crc32c(heads + payloads)
    n = len(payloads)
    return [
        b"".join([h, struct.pack("<I", masked(crcs[i])), p, struct.pack("<I", masked(crcs[n + i]))])
        for i, (h, p) in enumerate(zip(heads, payloads, strict=True))
    ]


def unframe(data: bytes, lengths: list[int]) -> list[bytes]:
    """Payloads of consecutive records of the given sizes; raises ``ValueError`` on any damage."""
    heads, payloads, sums, at = [], [], [], 0
    for size in lengths:
        record = data[at : at + size]
        at += size
        if len(record) != size or size < 16:
            raise ValueError("a record is cut short")
        heads.append(record[:8])
        payloads.append(record[12:-4])
        sums.append((struct.unpack("<I", record[8:12])[0], struct.unpack("<I", record[-4:])[0]))
        if struct.unpack("<Q", record[:8])[0] != size - 16:
            raise ValueError("a record's length disagrees with the index")
    crcs = crc32c(heads + payloads)
    for i, (head, body) in enumerate(sums):
        if head != masked(crcs[i]) or body != masked(crcs[len(heads) + i]):
            raise ValueError("a checksum disagrees with its record")
    return payloads


def _byte_letters() -> str:
    """The letters of byte-level vocabularies, by byte: itself where it is visible in Latin-1, else the next from U+0100."""
    hidden = iter(range(256, 512))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return "".join(chr(b if b in visible else next(hidden)) for b in range(256))


class Encoder:
    """Ids by the tokenizers library. If its file cuts texts by ``pattern`` into byte-level matches, its model is asked once for
    each distinct match; texts with an added token, and any other file, go to the library whole."""

    def __init__(self, path: str, pattern: str | None):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind, self.code = f"<u{self.width}", "H" if self.width == 2 else "I"
        setting = json.loads(self.library.to_str())
        cut = setting["pre_tokenizer"] or {}
        plain = setting["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.by_match = bool(pattern and plain)
        if self.by_match:
            self.find, self.letters = finder(pattern), dict(enumerate(_byte_letters()))
            self.match = Memo(self._match, 250_000, 200)

    def _match(self, match: str) -> bytes:
        if match.isascii() and match.isprintable():
            letters = match.replace(" ", self.letters[32])
        else:
            letters = match.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.library.model.tokenize(letters)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of ``width`` bytes each, little-endian."""
        if not text:
            return b""
        if not self.by_match or any(a in text for a in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        return b"".join(map(self.match.__getitem__, self.find(text)))


@lru_cache(maxsize=2)
def load(path: str, pattern: str | None) -> Encoder:
    return Encoder(path, pattern)


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, reachable from any worker."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str, tokenizer: str, pattern: str | None, end_id: int, parts: int | None = None) -> DataFrame:
    """Encode every row, append ``end_id``, write the files in ascending ``doc_id`` order and return the stored manifest:
    ``part``, ``file``, ``width``, ``docs``, ``ids``.

    Null and empty texts are sequences of the end id alone. Rows with a null ``doc_id`` come first; rows of equal ``doc_id``
    are all written, in the order of a hash of their texts. An empty table writes no part. Other columns are not read.
    ``folder`` must be shared, in a store that Arrow's file systems reach (local or mounted paths, HDFS, S3, GCS).
    """
    spark = common.ready(docs.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "_h"]
    rows = common.texts_of(docs).withColumn("_h", common.text_hash(F.col("text"))).repartitionByRange(parts, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = load(tokenizer, pattern), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
        store, root = _store(folder)
        name, own = f"part-{number:05d}", uuid.uuid4().hex
        sizes, ids, out = [], 0, None
        for batch in batches:
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/_{name}-{own}")
            payloads = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                coded = encoder.encode(text) + end
                ids += len(coded) // encoder.width
                payloads.append(struct.pack(_HEAD, doc is not None, doc or 0) + coded)
            for record in frame(payloads):
                out.write(record)
                sizes.append(len(record))
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{root}/_{name}-{own}.index") as index:
            index.write(np.cumsum([0, *sizes]).astype("<u8").tobytes())
        store.move(f"{root}/_{name}-{own}", f"{root}/{name}.records")
        store.move(f"{root}/_{name}-{own}.index", f"{root}/{name}.index")
        yield pa.RecordBatch.from_pylist([{"part": number, "file": name, "width": encoder.width, "docs": len(sizes), "ids": ids}], _MANIFEST)

    manifest = rows.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, "part int, file string, width int, docs long, ids long")
    manifest.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.parquet(f"{folder.rstrip('/')}/manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every sequence of the files: ``doc_id``, ``start`` (ids of all sequences before it) and ``ids`` (binary, unsigned
    32-bit little-endian). Lengths and checksums are verified. The driver adds up one number a part."""
    common.ready(spark)
    manifest = spark.read.parquet(f"{folder.rstrip('/')}/manifest")
    rows, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        rows.append((r["file"], r["width"], before))
        before += r["ids"]
    schema = "doc_id long, start long, ids binary"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for part in batch.to_pylist():
                with store.open_input_stream(f"{root}/{part['file']}.index") as index:
                    offsets = np.frombuffer(index.read(), dtype="<u8").astype(np.int64)
                start = part["start"]
                with store.open_input_stream(f"{root}/{part['file']}.records") as data:
                    at = 0
                    while at < len(offsets) - 1:  # as many records as fit in a batch, one at least
                        stop = max(at + 1, min(at + common.BATCH_ROWS, int(np.searchsorted(offsets, offsets[at] + common.BATCH_BYTES))))
                        stop = min(stop, len(offsets) - 1)
                        payloads = unframe(data.read(int(offsets[stop] - offsets[at])), np.diff(offsets[at : stop + 1]).tolist())
                        docs, starts, ids = [], [], []
                        for p in payloads:
                            has, doc = struct.unpack_from(_HEAD, p)
                            coded = np.frombuffer(p, dtype=f"<u{part['width']}", offset=_HEAD_BYTES)
                            docs.append(doc if has else None)
                            starts.append(start)
                            ids.append(coded.astype("<u4").tobytes())
                            start += len(coded)
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])
                        at = stop

    table = spark.createDataFrame(rows, "file string, width int, start long").repartition(len(rows))
    return table.mapInArrow(run, schema)


def digests(sequences: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of what :func:`read` gives."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column("ids").to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    return common.map_batches(sequences, work, "doc_id long, start long, n_tokens long, ids_crc32 long")
