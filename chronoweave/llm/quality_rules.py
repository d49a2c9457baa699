"""Quality rules by distribution divergence.

From all documents of a language, two references: the histogram of character classes and that of its common words (those that
make up at least ``COMMON`` of the language's words, so at most ``1 / COMMON`` of them) with one more bin for all others. A
document is kept if, for some language, the Jensen-Shannon distances of its own two histograms lie within bounds. A short text
says little, so each distance has a least length below which it isn't judged. Before that stand base rules: at least 20 words,
and no more than 30 % of words in passages of 8 words that repeat within the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common

#: Classes of bytes: white space, lower case, upper case, digits, sentence marks, other ASCII, control, not ASCII.
CLASSES = 8
COMMON = 1 / 400
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Bounds of the distances, and the words a text needs for each to count.
CLASS_BOUND, CLASS_WORDS = 0.30, 20
WORD_BOUND, WORD_WORDS = 0.50, 60
#: Words of a summary, and distinct words of a language that a task holds before it makes one.
SUMMARY, HELD_WORDS = int(4 / COMMON), 50_000


def _classes() -> np.ndarray:
    of = np.full(256, 7, dtype=np.uint8)
    of[:128] = 5
    of[:32] = 6
    of[127] = 6
    of[[9, 10, 11, 12, 13, 32]] = 0
    of[ord("a") : ord("z") + 1] = 1
    of[ord("A") : ord("Z") + 1] = 2
    of[ord("0") : ord("9") + 1] = 3
    of[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    return of


_CLASS = _classes()
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_FACTOR = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    mixed = sum(h[k : k + n] * _FACTOR[k] for k in range(WINDOW))
    if len(np.unique(mixed)) == n:  # equal windows have equal hashes: none repeats
        return 0
    windows = list(zip(*(words[k : k + n] for k in range(WINDOW)), strict=True))
    seen = Counter(windows)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in enumerate(windows):
        if seen[w] > 1:
            marks[i] += 1
            marks[i + WINDOW] -= 1
    return int((np.cumsum(marks) > 0).sum())


def _counts(data: bytes) -> tuple[np.ndarray, int, int]:
    """Class histogram (characters that are not ASCII count once), characters in words, symbols."""
    bytes_ = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    bytes_[0x80:0xC0] = 0  # bytes that continue a character
    classes = np.bincount(_CLASS, weights=bytes_, minlength=CLASSES)
    return classes, int(bytes_.sum() - classes[0]), int(bytes_[_SYMBOL].sum())


def _thinned(counts: Counter, most: int = SUMMARY) -> Counter:
    """A summary of counts in bounded memory: each is lowered by the same amount until at most ``most`` are left. A word that
    makes up more than ``1 / (most + 1)`` of all words counted, over however many such steps, is never lost."""
    if len(counts) <= most:
        return counts
    floor = sorted(counts.values(), reverse=True)[most]
    return Counter({w: n - floor for w, n in counts.items() if n > floor})


def references(docs: DataFrame) -> dict:
    """``classes``: a histogram for each language; ``words``: for each language its common words and their shares.

    Both cover all rows with a language and a word. Common words are found exactly in two passes: summaries in bounded memory,
    which lose no common word, then counts of the words they name. For each language the driver sees ``CLASSES`` numbers and
    at most about ``1.4 / COMMON`` words.
    """
    common.ready(docs.sparkSession)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna()
    schema = "lang string, word binary, n long, class int"

    def table(words: dict[str, dict[bytes, int]], classes: dict[str, np.ndarray]) -> pa.RecordBatch:
        cells = [(lang, w, n, None) for lang, own in words.items() for w, n in own.items()]
        cells += [(lang, None, int(n), k) for lang, own in classes.items() for k, n in enumerate(own)]
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], kind) for i, kind in enumerate(kinds)], ["lang", "word", "n", "class"])

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), common.texts_bytes(batch.column("text")), strict=True):
                words.setdefault(lang, Counter()).update(data.lower().split())
                if len(words[lang]) > HELD_WORDS:
                    words[lang] = _thinned(words[lang])
                counts = _counts(data)[0]
                classes[lang] = classes.get(lang, 0) + np.append(counts, len(data.split()))
        yield table({lang: _thinned(own) for lang, own in words.items()}, classes)

    summary = common.stored(rows.mapInArrow(summarise, schema).groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "word-summary")
    classes: dict[str, np.ndarray] = {}
    for r in summary.filter("word is null").collect():
        classes.setdefault(r["lang"], np.zeros(CLASSES + 1))[r["class"]] = r["n"]
    sums = {lang: own[-1] for lang, own in classes.items() if own[-1] > 0}
    if not sums:
        return {"classes": {}, "words": {}}
    least = F.create_map(*[F.lit(x) for lang, n in sums.items() for x in (lang, float(n) * (COMMON - 1 / (SUMMARY + 1)))])
    named: dict[str, set[bytes]] = {lang: set() for lang in sums}
    for r in summary.filter(F.col("word").isNotNull() & (F.col("n") >= least[F.col("lang")])).collect():
        named[r["lang"]].add(bytes(r["word"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), common.texts_bytes(batch.column("text")), strict=True):
                if wanted := named.get(lang):
                    words.setdefault(lang, Counter()).update(filter(wanted.__contains__, data.lower().split()))
        yield table(words, {})

    words: dict[str, dict[bytes, float]] = {lang: {} for lang in sums}
    exact = rows.mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    for r in sorted(exact, key=lambda r: bytes(r["word"])):
        if r["n"] >= COMMON * sums[r["lang"]]:
            words[r["lang"]][bytes(r["word"])] = r["n"] / sums[r["lang"]]
    return {"classes": {k: classes[k][:-1] / classes[k][:-1].sum() for k in sums}, "words": words}


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two distributions: 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, parts.sum() / 2)))


class Judge:
    """Distances of a text to the nearest language reference."""

    def __init__(self, reference: dict):
        self.classes = reference["classes"]
        self.words = {}
        for lang, shares in reference["words"].items():
            q = np.array([*shares.values(), max(0.0, 1 - sum(shares.values()))])
            self.words[lang] = ({w: i for i, w in enumerate(shares)}, q)

    def within(self, words: list[bytes], classes: np.ndarray) -> bool:
        """Whether some language's two bounds hold. With no reference at all, nothing is judged."""
        n = len(words)
        if not self.classes:
            return True
        p = classes / max(1, classes.sum())
        counts = Counter(words) if n >= WORD_WORDS else None
        for lang, reference in self.classes.items():
            if n >= CLASS_WORDS and distance(p, reference) > CLASS_BOUND:
                continue
            if counts is None:
                return True
            index, q = self.words[lang]
            own = np.zeros(len(q))
            for word, i in index.items():
                own[i] = counts.get(word, 0)
            own[-1] = n - own.sum()
            if distance(own / n, q) <= WORD_BOUND:
                return True
        return False


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean"


def measure(data: bytes | None, judge: Judge) -> tuple:
    """The row of one text, without its id."""
    data = data or b""
    words = data.split()
    classes, chars, symbols = _counts(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
    kept = not failed and judge.within(data.lower().split(), classes)
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, failed, kept


def assess(docs: DataFrame, reference: dict | None = None) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``, ``lang``): the counts of ``COLUMNS``, ``base_failed``, ``kept``.

    A null or empty text has no words and is not kept. Repeated rows are judged each; a null ``doc_id`` stays; a null ``lang``
    only keeps a row out of the references. Other columns are not read. An empty table gives an empty table.
    """
    reference = references(docs) if reference is None else reference

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        judge = Judge(reference)
        rows = list(zip(*(measure(d, judge) for d in common.texts_bytes(batch.column("text"))), strict=True))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        names = ["doc_id", *COLUMNS, "base_failed", "kept"]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], names)

    return common.map_batches(common.texts_of(docs), work, SCHEMA)


def keep(docs: DataFrame, reference: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`assess` keeps, with all their columns, in one pass and without a join."""
    reference = references(docs) if reference is None else reference

    @F.pandas_udf("boolean")
    def kept(texts):
        judge = Judge(reference)
        return texts.map(lambda t: measure(t.encode() if isinstance(t, str) else None, judge)[-1]).astype(bool)

    return docs.filter(kept(F.col("text").cast("string")))
