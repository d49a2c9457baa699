"""Language identification in two steps: the family first, then its languages, by one-versus-one linear support vector machines.

A text is the square roots of the shares of its byte 1-, 2- and 3-grams (A-Z lower-cased, other ASCII but letters as one
blank), hashed to ``DIMENSIONS``: a vector of length one. For each two families, and for each two languages of a family, a
linear SVM is trained; the class with most duels won (then the largest sum of margins, then the first name) is predicted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm import common

DIMENSIONS = 2048
#: About so many labelled rows of each language are trained on (all, where there are fewer): chosen by a hash of the row.
SAMPLE = 1500
UNKNOWN = "und"

#: Families of languages by their codes; a code that isn't listed belongs to the family "other".
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro", "sc", "wa"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sh", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu", "se"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"),
    "sinitic": ("yue", "zh"),
    "austronesian": ("id", "jv", "ms", "su", "tl"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


def _letters() -> np.ndarray:
    of = np.arange(256, dtype=np.uint32)
    of[:128] = ord(" ")
    for c in range(ord("a"), ord("z") + 1):
        of[c] = of[c - 32] = c
    return of


_LETTER = _letters()


def vector(data: bytes) -> np.ndarray:
    """Features of a text's UTF-8 bytes."""
    a = _LETTER[np.frombuffer(b" " + data + b" ", dtype=np.uint8)]
    two = a[:-1] << 8 | a[1:]
    three = two[:-1] << 8 | a[2:]
    out = np.zeros(DIMENSIONS)
    for grams in (a, two | 1 << 25, three | 1 << 26):
        out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(21), minlength=DIMENSIONS)
    return np.sqrt(out / out.sum()).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def training_rows(docs: DataFrame, chosen: Column, sample: int = SAMPLE) -> DataFrame:
    """``lang``, ``vector`` of about ``sample`` rows a language among those ``chosen`` that have a language and a letter."""
    rows = docs.filter(chosen).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    ).dropna(subset=["lang", "text"])
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang string, vector array<float>")
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 20)) / F.lit(1 << 20)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [i for i, t in enumerate(batch.column("text").to_pylist()) if has_letter(t)]
        data = common.texts_bytes(batch.column("text"))
        vectors = np.stack([vector(data[i]) for i in kept]) if kept else np.zeros((0, DIMENSIONS), dtype=np.float32)
        offsets = pa.array(np.arange(len(kept) + 1) * DIMENSIONS, pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("lang").take(pa.array(kept, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], ["lang", "vector"]
        )

    drawn = rows.filter(draw < share[F.col("lang")]).select("lang", "text")
    return common.map_batches(drawn, work, "lang string, vector array<float>")


class Duels:
    """One-versus-one linear machines between ``names``: a margin above zero is for the first of a pair."""

    def __init__(self, names: list[str], weights: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.names, self.pairs = names, [(names.index(a), names.index(b)) for a, b in weights]
        self.matrix = np.stack([w for w, _ in weights.values()], axis=1).astype(np.float32) if weights else None
        self.bias = np.array([b for _, b in weights.values()], dtype=np.float32)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the winner and a confidence from 0 to 1 for each row: the least confidence of the winner's duels."""
        n = len(x)
        if self.matrix is None:
            return np.zeros(n, dtype=np.int64), np.ones(n)
        margins = x @ self.matrix + self.bias
        wins, sums = np.zeros((n, len(self.names))), np.zeros((n, len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            wins[:, a] += margins[:, k] > 0
            wins[:, b] += margins[:, k] <= 0
            sums[:, a] += margins[:, k]
            sums[:, b] -= margins[:, k]
        best = np.argmax(wins + 1e-3 * np.tanh(sums), axis=1)
        sure = np.ones(n)
        for k, (a, b) in enumerate(self.pairs):
            own = np.where(best == a, margins[:, k], np.where(best == b, -margins[:, k], np.inf))
            sure = np.minimum(sure, 1 / (1 + np.exp(-2 * np.clip(own, -30, 30))))
        return best, sure


def duels(rows: DataFrame, column: str, names: list[str]) -> Duels:
    """Machines between every two of ``names``, the values of ``column``; ``rows``: stored ``features`` vectors."""
    weights = {}
    for a, b in itertools.combinations(names, 2):
        two = rows.filter(F.col(column).isin(a, b)).select("features", (F.col(column) == a).cast("double").alias("label"))
        model = LinearSVC(maxIter=25, regParam=1e-4, standardization=False).fit(two)
        weights[a, b] = (model.coefficients.toArray(), float(model.intercept))
    return Duels(names, weights)


class Model:
    """A machine for families, and one for the languages of each."""

    def __init__(self, families: Duels, languages: dict[str, Duels]):
        self.families, self.languages = families, languages

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        chosen, sure = self.families.decide(x)
        names = np.empty(len(x), dtype=object)
        for i, name in enumerate(self.families.names):
            own = np.flatnonzero(chosen == i)
            if len(own):
                best, within = self.languages[name].decide(x[own])
                names[own] = np.array(self.languages[name].names, dtype=object)[best]
                sure[own] *= within
        return names.tolist(), sure


def train(docs: DataFrame, chosen: Column, sample: int = SAMPLE) -> Model | None:
    """The model of the ``chosen`` rows; ``None`` if none of them has a language and a letter."""
    common.ready(docs.sparkSession)
    rows = common.stored(training_rows(docs, chosen, sample), "language-sample")
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not names:
        return None
    of = {name: family(name) for name in names}
    families = sorted(set(of.values()))
    kin = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    rows = rows.select("lang", kin[F.col("lang")].alias("family"), array_to_vector("vector").alias("features"))
    return Model(duels(rows, "family", families), {f: duels(rows.filter(F.col("family") == f), "lang", [n for n in names if of[n] == f]) for f in families})


def identify(docs: DataFrame, model: Model | None, passed: list[Column] | None = None) -> DataFrame:
    """``doc_id``, the columns ``passed``, ``lang_pred`` and ``score`` (0 to 1) of every row, from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text when there was nothing to learn from.
    Repeated rows are predicted each; a null ``doc_id`` stays. Other columns are not read.
    """
    common.ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(passed or []), F.col("text").cast("string").alias("text"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            known = [i for i, t in enumerate(texts.to_pylist()) if has_letter(t)] if model else []
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if known:
                data = common.texts_bytes(texts)
                found, sure = model.predict(np.stack([vector(data[i]) for i in known]))
                for i, name in zip(known, found, strict=True):
                    names[i] = name
                scores[known] = sure
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", lang_pred string, score double"
    return rows.mapInArrow(run, schema)
