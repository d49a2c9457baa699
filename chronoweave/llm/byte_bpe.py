"""Byte-level BPE by backtracking over longest matches, and its decoding.

Tokens are byte strings mapped to Latin-1, so that an Aho-Corasick automaton finds every vocabulary entry in a piece. A token
sequence is the one that merging by rank would give if and only if every two adjacent tokens are *compatible*: merging their
joined bytes by rank gives just these two back. So the encoder takes the longest match that is compatible with the token
before it; where none fits it drops the last token, marks its end as a dead position and tries the next shorter match. Each
position dies at most once, so the time is linear in the piece. Compatibility is memoised, as are the ids of matches.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common
from chronoweave.llm.common import Memo
from chronoweave.llm.pretokens import finder


class ByteBpe:
    """``ranks``: bytes of each token and its rank, which is its id; ``pattern`` cuts a text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, finder(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.whole = Memo(lambda rank: self._merged(self.bytes_of[rank]) == [rank], len(ranks) + 1)
        self.fit = Memo(lambda two: self._merged(self.bytes_of[two[0]] + self.bytes_of[two[1]]) == [*two], 500_000)
        self.match = Memo(lambda match: np.array(self.encode_piece(match.encode()), dtype="<u4").tobytes(), 300_000, 200)

    def _merged(self, data: bytes) -> list[int]:
        """Merges by rank, step by step: only for the bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, len(self.ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def encode_piece(self, data: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        if (one := self.ranks.get(data)) is not None:  # a match that is itself a token is never merged
            return [one]
        n = len(data)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            matches[end - length + 1].append((rank, length))  # by length, as ends ascend
        dead = bytearray(n + 1)
        tokens: list[int] = []
        starts, choices = [0], [len(matches[0]) - 1]
        fit, whole = self.fit, self.whole
        while starts[-1] < n:
            at, k = starts[-1], choices[-1]
            options = matches[at]
            while k >= 0:
                rank, length = options[k]
                if not dead[at + length] and whole[rank] and (not tokens or fit[tokens[-1], rank]):
                    break
                k -= 1
            if k >= 0:
                choices[-1] = k - 1
                tokens.append(rank)
                starts.append(at + length)
                choices.append(len(matches[at + length]) - 1 if at + length < n else -1)
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks single bytes of a text")
                dead[at] = 1
                starts.pop()
                choices.pop()
                tokens.pop()
        return tokens

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.match.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file (lines of base64 bytes and rank), once in each worker."""
    with open(path, "rb") as lines:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary: little-endian unsigned 32-bit) and ``decoded`` (the bytes of the ids, joined) of every row.

    A null or empty text has no ids. Repeated rows are encoded each; rows with a null ``doc_id`` stay. An empty table gives an
    empty table. Other columns are not read. ``path`` must exist on every worker.
    """
    common.ready(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        ids = [bpe.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.binary())],
            ["doc_id", "ids", "decoded"],
        )

    return common.map_batches(common.texts_of(docs), work, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of the ids and of the decoded bytes, in lowercase hex; rows as in
    :func:`encode`."""
    common.ready(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        counts, coded, decoded = [], [], []
        for text in batch.column("text").to_pylist():
            ids = bpe.encode(text) if text else b""
            counts.append(len(ids) // 4)
            coded.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.map_batches(common.texts_of(docs), work, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` again, from ``ids``; bytes that are no UTF-8 (cut sequences) become U+FFFD."""
    common.ready(rows.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = load(path, pattern)
        texts = [None if i is None else bpe.decode(i).decode("utf-8", "replace") for i in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return common.map_batches(rows.select("doc_id", F.col(ids).alias("ids")), work, "doc_id long, text string")
