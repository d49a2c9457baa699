"""Token counts of a piece vocabulary: merges on a heap over a linked list of symbols, without making ids.

A text is normalised as the vocabulary's library does it (spaces become U+2581 and one stands before the text). Symbols begin
as characters; the adjacent pair whose piece has the best score merges first, the leftmost of equals first. The count is the
number of initial symbols minus merges; a character without a piece counts as many as its UTF-8 bytes. No piece holds U+2581
after another character, so words are independent and each distinct word is counted once.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common
from chronoweave.llm.common import Memo

SPACE = "▁"


class PieceCounter:
    """``scores``: piece and score; ``byte_fallback``: unknown characters become their bytes, else one unknown token."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool = True):
        if any(SPACE in piece.lstrip(SPACE) for piece in scores):
            raise ValueError(f"pieces with {SPACE} after another character are not supported")
        self.scores, self.byte_fallback = scores, byte_fallback
        self.word = Memo(lambda word: self.merges(SPACE + word), 200_000, 200)

    def merges(self, symbols: str) -> int:
        """Tokens of a sequence of symbols."""
        n = len(symbols)
        scores, token = self.scores, list(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(left: int, right: int) -> None:
            score = scores.get(token[left] + token[right])
            if score is not None:
                heapq.heappush(heap, (-score, left, len(token[left]) + len(token[right])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, size = heapq.heappop(heap)
            if not token[left]:
                continue
            right = after[left]
            if right >= n or len(token[left]) + len(token[right]) != size:
                continue  # one of the two has merged since
            token[left] += token[right]
            token[right] = ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return sum(1 if t in scores else len(t.encode()) if self.byte_fallback else 1 for t in token if t)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return self._runs(text)
        return sum(map(self.word.__getitem__, text.split(" ")))

    def _runs(self, text: str) -> int:
        """Runs of spaces stay together with the word behind them."""
        total, pending = 0, 0
        words = text.replace(" ", SPACE).split(SPACE)
        for i, word in enumerate(words):
            pending += 1  # the space before the word; before the first, the one that the library adds
            if word:
                total += self.word[word] if pending == 1 else self.merges(SPACE * pending + word)
                pending = 0
            elif i == len(words) - 1:
                total += self.merges(SPACE * pending)
        return total


@lru_cache(maxsize=2)
def load(path: str) -> PieceCounter:
    """The counter of a model file, once in each worker."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in ids]
    scores = {model.id_to_piece(i): model.get_score(i) for i in ids if not special[i]}
    return PieceCounter(scores, byte_fallback=any(model.is_byte(i) for i in ids))


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each; rows with a null ``doc_id`` stay. Other
    columns are not read. ``path`` must exist on every worker.
    """
    common.ready(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = load(path).count
        texts = batch.column("text").to_pylist()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array([count(t) if t else 0 for t in texts], pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )

    rows = common.texts_of(docs).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = common.map_batches(rows, work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
