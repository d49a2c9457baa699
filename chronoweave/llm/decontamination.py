"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is 13 consecutive words of an item (a shorter item is one window). A document contains a window only if it contains
the window's rarest word, so that word is the prefix that must join: words are ordered by how often they occur in all
documents. One row of the prefix index says which word, which window, and at what offset in it. A document word that joins
fixes the only place where the window could stand; it must fit into the document (positional and length bound), and its words
are then compared. Everything from the text to the verified hit is one stage without a shuffle.

The index is broadcast in blocks of bounded size, as many as the benchmark needs: each block scans the documents once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import common

WINDOW = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word separators after lower-casing: everything in ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: UTF-8 bytes of one broadcast block of the index, words counted.
BLOCK_BYTES = 32 << 20
#: A hit share of at least 1 / ``SHARE`` makes a document contaminated.
SHARE = 20


def words(text: Column) -> Column:
    """Words of a text; null and empty texts have none. Only A-Z are lower-cased; ASCII texts take the fast way."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct ``item_id`` (string), ``window`` (array of words) of every item with a word."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), size).alias("window")).distinct()


def rarity(docs: DataFrame, vocabulary: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """``word``, ``n``: how often each word of ``vocabulary`` (stored, distinct) occurs in all documents; counted in the tasks,
    which are sent the vocabulary in blocks of bounded size."""
    total = vocabulary.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0
    n = max(1, int(-(-total // limit)))
    occurring = docs.select(F.explode(words(F.col("text"))).alias("word"))
    parts = [vocabulary.filter(F.pmod(F.xxhash64("word"), F.lit(n)) == k) if n > 1 else vocabulary for k in range(n)]
    counted = [occurring.join(F.broadcast(part), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n")) for part in parts]
    return reduce(DataFrame.unionByName, counted)


def prefix_index(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """``word``, ``window``, ``offset`` (0-based place of the word), ``item_ids`` of every distinct window, by its rarest word
    (the first of equally rare ones)."""
    grams = windows(items, size).groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    vocabulary = common.stored(grams.select(F.explode("window").alias("word")).distinct(), "benchmark-words")
    counts = rarity(docs, vocabulary, limit)
    placed = grams.select("window", "item_ids", F.posexplode("window").alias("offset", "word"))
    ranked = placed.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.min(F.struct("n", "offset", "word", "item_ids")).alias("first")
    return ranked.groupBy("window").agg(first).filter("first.n > 0").select("first.word", "window", "first.offset", "first.item_ids")


def blocks(index: DataFrame, limit: int = BLOCK_BYTES) -> list[DataFrame]:
    """The index in pieces of at most about ``limit`` bytes (one row at least); one number reaches the driver."""
    size = F.octet_length("word") + F.octet_length(F.concat_ws(" ", "window")) + F.octet_length(F.concat_ws(" ", "item_ids")) + 64
    total = index.agg(F.sum(size)).first()[0] or 0
    n = int(-(-total // limit)) if total else 0
    if n <= 1:
        return [index] if total else []
    return [index.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k) for k in range(n)]


def hits(docs: DataFrame, index: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``start`` (0-based word), ``length``, ``item_ids`` of every verified occurrence,
    and one row with a null ``start`` for every input row, with its ``n_words``.

    The row for each document rides on a word that no text has, put before the others, so that the texts are read once.
    """
    found = []
    for k, block in enumerate(blocks(index, limit) or [index.limit(0)]):
        keys = block.withColumn("size", F.size("window"))
        base = docs.sparkSession.range(1 if k == 0 else 0).select(
            F.lit("").alias("word"), F.lit(None).cast("array<string>").alias("window"), F.lit(0).alias("offset"),
            F.lit(None).cast("array<string>").alias("item_ids"), F.lit(0).alias("size"),
        )
        probe = docs.select("doc_id", common.text_hash(F.col("text")).alias("h"), F.concat(F.array(F.lit("")), words(F.col("text"))).alias("w"))
        placed = probe.select("doc_id", "h", "w", F.posexplode("w").alias("at", "word"))
        joined = placed.join(F.broadcast(keys.unionByName(base)), "word")
        fits = (F.col("at") - F.col("offset") >= 1) & (F.col("at") - F.col("offset") + F.col("size") <= F.size("w"))
        equal = F.slice("w", F.greatest(F.lit(1), F.col("at") - F.col("offset") + 1), F.col("size")) == F.col("window")
        found.append(
            joined.filter(F.col("window").isNull() | (fits & equal)).select(
                "doc_id", "h", F.when(F.col("window").isNotNull(), F.col("at") - F.col("offset") - 1).alias("start"),
                F.col("size").alias("length"), "item_ids", (F.size("w") - 1).alias("n_words"),
            )
        )
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit`` (words inside occurrences of windows), ``n_items``, ``item_ids`` (array of strings,
    sorted) and ``contaminated`` (a hit, and at least one word in 20) of every row of ``docs``; see :func:`verdicts`."""
    return verdicts(docs, items, size, limit).drop("h")


def verdicts(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """As :func:`contamination`, with ``h``, the hash of the text.

    Null, empty and wordless texts have no words and are never contaminated; such items have no window. Rows that repeat an id
    and a text have a row each, with the same values; a null ``doc_id`` stays. Without items, or with an empty ``docs``, the
    result has no hits, or no rows. Items that repeat each other are all reported. Other columns are not read.
    """
    common.ready(docs.sparkSession)
    rows = common.texts_of(docs)
    index = common.stored(prefix_index(rows, items, size, limit), "benchmark-index")
    all_hits = common.stored(hits(rows, index, limit), "benchmark-hits")
    key = ["doc_id", "h"]
    documents = all_hits.filter("start is null").groupBy(*key).agg(F.max("n_words").cast("long").alias("n_words"), F.count(F.lit(1)).alias("_rows"))
    # Occurrences in the order of their starts: each adds the words that end behind all before it.
    spans = all_hits.filter("start is not null").groupBy(*key, "start").agg(F.max(F.col("start") + F.col("length")).alias("stop"))
    before = Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("stop").over(before), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reached)).alias("fresh")
    covered = spans.select(*key, fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    named = (
        all_hits.filter("start is not null").select(*key, F.explode("item_ids").alias("item")).distinct()
        .groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    )
    found = covered.join(named, key_match(covered, named)).select(covered["doc_id"].alias("_d"), covered["h"].alias("_h"), "n_hit", "item_ids")
    out = documents.join(found, documents["doc_id"].eqNullSafe(F.col("_d")) & (documents["h"] == F.col("_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    out = out.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "_rows")
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))
    return out.withColumn("_rows", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_rows")


def key_match(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = verdicts(docs, items, size, limit).filter("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("h").alias("_bad_h")).distinct()
    match = docs["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (common.text_hash(docs["text"].cast("string")) == bad["_bad_h"])
    return docs.join(bad, match, "left_anti")
