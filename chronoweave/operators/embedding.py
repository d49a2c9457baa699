"""Search documents and embeddings of fact versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.functions import scalars as sc
from chronoweave.functions.stemming import search_tokens

SCATTER_ROWS = 1000  # rows of dense vectors a task holds at once
HASH_MODEL = "deterministic:hash-v1"  # fixed value: stored with every embedding of this kind


def _plain_value(value: Column) -> Column:
    """A JSON string without its quotes; any other JSON value as its text."""
    return F.when(
        value.startswith('"'), F.try_variant_get(F.try_parse_json(value), "$", "string")
    ).otherwise(value)


def search_text() -> Column:
    return F.concat_ws(
        " ",
        F.translate("entity_type", "_.", "  "),
        F.col("external_id"),
        F.translate("property", "_.", "  "),
        _plain_value(F.col("value")),
    )


def build_search_docs(versions: DataFrame) -> DataFrame:
    """One row per version: its stemmed tokens without stop words."""
    return versions.select("organization_id", "id", search_tokens(sc.tokens(search_text())).alias("tokens"))


def rendered_document() -> Column:
    """The text that stands for a version in semantic search; no times in it."""
    readable = F.replace(F.replace(F.col("property"), F.lit("_"), F.lit(" ")), F.lit("."), F.lit(" / "))
    return F.concat(
        F.col("entity_type"), F.lit(" "), F.col("external_id"), F.lit("\n"), readable, F.lit(": "),
        sc.display_json(sc.canonical_json(F.col("value"))),
    )


def render_documents(versions: DataFrame) -> DataFrame:
    text = rendered_document()
    return versions.select(
        "organization_id", "id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("content_sha256"),
        "recorded_at",
    )


def hash_embed(tokens: Column, dims: int) -> Column:
    """Signed feature hashing of words and word pairs into ``dims`` numbers of unit length.

    Hashes come from the JVM, one number a feature; a task adds them up for a block of rows at once and hands
    the block back as it is. A row without features is the first unit vector (a fixed value: stored vectors
    have it so).
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def scatter(hashes: pa.Array) -> pa.Array:
        ends = hashes.offsets.to_numpy()
        values = hashes.values.to_numpy()
        parts = []
        for at in range(0, len(hashes), SCATTER_ROWS):
            edges = ends[at : at + SCATTER_ROWS + 1]
            n = len(edges) - 1
            packed = values[edges[0] : edges[-1]]
            cells = np.repeat(np.arange(n) * dims, np.diff(edges)) + (packed >> 8) % dims
            block = np.bincount(cells, weights=np.where(packed & 1, 1.0, -1.0), minlength=n * dims).reshape(n, dims)
            length = np.linalg.norm(block, axis=1)
            block[length == 0, 0] = 1.0
            parts.append((block / np.where(length == 0, 1.0, length)[:, None]).astype(np.float32).ravel())
        flat = np.concatenate(parts) if parts else np.zeros(0, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * dims), pa.array(flat))

    return scatter(_feature_hashes(tokens))


def _feature_hashes(tokens: Column) -> Column:
    """The first five bytes of the SHA-256 of each word and word pair, as one number: each digest is taken once."""
    pairs = F.when(
        F.size(tokens) > 1,
        F.zip_with(
            F.slice(tokens, 1, F.size(tokens) - 1),
            F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(
        F.concat(tokens, pairs), lambda f: F.conv(F.substring(F.sha2(f.cast("binary"), 256), 1, 10), 16, 10).cast("long")
    )


def hash_features(tokens: Column, dims: int) -> Column:
    """Places and signs of words and word pairs, JVM-side.

    Fixed values, as stored vectors have them: SHA-256, the slot from its first four bytes, the sign from
    the lowest bit of the fifth.
    """
    return F.transform(
        _feature_hashes(tokens),
        lambda h: F.struct(
            (F.shiftright(h, 8) % dims).alias("slot"), F.when(h.bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1).alias("sign")
        ),
    )


def missing_embeddings(versions: DataFrame, embeddings: DataFrame, model: str, n: int | None = None) -> DataFrame:
    """Versions without an embedding for the model, oldest first; ``n`` takes the oldest n."""
    have = embeddings.where(F.col("model") == model).select("organization_id", F.col("fact_version_id").alias("id"))
    missing = versions.join(have, ["organization_id", "id"], "left_anti")
    return missing if n is None else missing.orderBy("recorded_at", "id").limit(n)


def embed_missing(
    versions: DataFrame, embeddings: DataFrame, model: str = HASH_MODEL, dims: int = 1536
) -> tuple[DataFrame, DataFrame]:
    """Embeddings for the versions that lack one, and per tenant how many were reused or embedded.

    Each distinct text of a tenant is embedded once, and not at all when the tenant already has a
    vector for it under this model. Tenants never share vectors.
    """
    todo = render_documents(missing_embeddings(versions, embeddings, model))
    key = ["organization_id", "content_sha256"]
    stored = (
        embeddings.where(F.col("model") == model)
        .groupBy(*key)
        .agg(F.min_by("embedding", "fact_version_id").alias("embedding"))
    )
    texts = todo.groupBy(*key).agg(F.first("text").alias("text"))
    reused = texts.select(*key).join(stored, key)
    fresh = texts.join(stored, key, "left_anti").select(
        *key, hash_embed(sc.tokens(F.col("text")), dims).alias("embedding")
    )
    vectors = reused.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))
    rows = todo.select(*key, F.col("id").alias("fact_version_id")).join(vectors, key)
    result = rows.select(
        "organization_id", "fact_version_id", F.lit(model).alias("model"), "content_sha256", "embedding", "reused"
    )
    stats = (
        todo.select(*key)
        .join(stored.select(*key, F.lit(True).alias("reused")), key, "left")
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("n"), F.max("reused").alias("reused"))
        .groupBy("organization_id")
        .agg(
            F.sum("n").alias("versions"),
            F.count_if("reused").alias("texts_reused"),
            F.count_if(F.col("reused").isNull()).alias("texts_embedded"),
        )
    )
    return result, stats


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return 1 - dot / (norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x))
