"""The registered queries of the corpus operators, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from functools import lru_cache

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import byte_bpe, cap_filters, collocations, common, decontamination, language_id, lattice_lm, paragraphs, quality_rules, ranked_search, repeated_strings, sequence_files, simhash, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@lru_cache(maxsize=8)
def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def remainder(n: int) -> Column:
    """Of crc32 of ``doc_id`` as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), remainder(5) == 1
    model = lattice_lm.train(docs.filter(~held_out), vocabulary("piece_bpe_32k.model"))
    return lattice_lm.scores(docs, model, [held_out.alias("held_out")])


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), remainder(4) == 2
    model = language_id.train(docs, ~held_out)
    return language_id.identify(docs, model, [held_out.alias("held_out")])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "sequences")
    sequence_files.write(documents(spark, sf_dir), folder, vocabulary("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return sequence_files.digests(sequence_files.read(spark, folder))


def op6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.report(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), g AS (
  SELECT item_id, w[i : i + 12] AS g, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM g),
s AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), h AS (
  SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g ON s.w[s.i : s.i + s.n - 1] = g.g AND s.n = g.n
), hw AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op9_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings.report(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(documents(spark, sf_dir))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), p AS (
  SELECT doc_id, i, substring(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM p) WHERE k > 1
), marks AS (
  SELECT doc_id, i, CASE WHEN i > lag(i) OVER w + 100 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS fresh
  FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marks) GROUP BY doc_id, run
), cuts AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS a FROM runs),
kept AS (
  SELECT doc_id, string_agg(substring(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY b) AS head, max(e) AS e, sum(e - b) AS n_removed, count(*) AS n_spans
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(x, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, text IS NOT NULL AS here, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), base AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (SELECT doc_id, i, w[i : i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id
), classes AS (
  SELECT doc_id, lang, here, c, length(t) - length(regexp_replace(t, pattern, '', 'g')) AS n FROM d, (VALUES
    (0, '[\x20\x09-\x0D]'), (1, '[a-z]'), (2, '[A-Z]'), (3, '[0-9]'), (4, '[.,;:!?''"()-]'),
    (5, '[#$%&*+/<=>@\[\\\]^_`{|}~]'), (6, '[\x00-\x08\x0E-\x1F\x7F]'), (7, '[^\x00-\x7F]')) AS p(c, pattern)
), words AS (
  SELECT doc_id, lang, word, count(*) AS n FROM (
    SELECT doc_id, lang, unnest(list_transform(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS word FROM d)
  GROUP BY ALL
), totals AS (SELECT lang, sum(n) AS n FROM words WHERE lang IS NOT NULL GROUP BY lang),
ref_class AS (
  SELECT lang, c, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM classes WHERE here AND lang IN (SELECT lang FROM totals) GROUP BY lang, c
), ref_word AS (
  SELECT w.lang, word, sum(w.n) / any_value(t.n) AS q FROM words w JOIN totals t USING (lang) GROUP BY w.lang, word HAVING sum(w.n) >= any_value(t.n) / 400
), own_class AS (SELECT doc_id, c, n / greatest(1, sum(n) OVER (PARTITION BY doc_id)) AS p FROM classes),
d_class AS (
  SELECT doc_id, r.lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM own_class JOIN ref_class r USING (c) GROUP BY doc_id, r.lang
), met AS (
  SELECT w.doc_id, r.lang, sum(p) AS ps, sum(q) AS qs, sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) AS x
  FROM (SELECT doc_id, word, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM words) w JOIN ref_word r ON r.word = w.word GROUP BY w.doc_id, r.lang
), sums AS (SELECT t.lang, coalesce(sum(q), 0) AS q FROM totals t LEFT JOIN ref_word r USING (lang) GROUP BY t.lang),
d_word AS (
  SELECT doc_id, lang, sqrt(greatest(0, (x + q - qs + CASE WHEN po > 0 THEN po * log2(2 * po / (po + qo)) ELSE 0 END
    + CASE WHEN qo > 0 THEN qo * log2(2 * qo / (po + qo)) ELSE 0 END) / 2)) AS x
  FROM (SELECT b.doc_id, s.lang, coalesce(x, 0) AS x, coalesce(qs, 0) AS qs, s.q, CASE WHEN abs(1 - coalesce(ps, 0)) < 1e-12 THEN 0 ELSE 1 - coalesce(ps, 0) END AS po, greatest(0, 1 - s.q) AS qo
    FROM base b CROSS JOIN sums s LEFT JOIN met m ON m.doc_id = b.doc_id AND m.lang = s.lang)
), near AS (
  SELECT b.doc_id, bool_or((b.n_words < 20 OR c.x <= 0.30) AND (b.n_words < 60 OR v.x <= 0.50)) AS ok
  FROM base b JOIN d_class c USING (doc_id) JOIN d_word v ON v.doc_id = b.doc_id AND v.lang = c.lang GROUP BY b.doc_id
), f AS (
  SELECT b.doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * coalesce(rep.n, 0) > 30 * n_words AS base_failed
  FROM base b LEFT JOIN rep USING (doc_id)
)
SELECT f.*, NOT base_failed AND coalesce(near.ok, true) AS kept FROM f LEFT JOIN near USING (doc_id)
"""


def op11_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM e
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93
), ends AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT r.x, b.y FROM reach r JOIN ends b ON b.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM ends GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM e LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked_search.search(ranked_search.index(documents(spark, sf_dir), k=50), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", "doc_id", "score")


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark
), p AS (
  SELECT row, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY row, doc_id, term
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term
), hits AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM hits WHERE score > 0 QUALIFY rank <= 50
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, w FROM (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)) WHERE len(w) > 0
), totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
grams AS (
  SELECT lang, w[i : i + k - 1] AS g, k, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), range(1, 6) AS t(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), within AS (
  SELECT lang, part, max(f) AS most FROM (
    SELECT lang, g[1 : k - 1] AS part, f FROM grams WHERE k > 2 UNION ALL SELECT lang, g[2 : k] AS part, f FROM grams WHERE k > 2) GROUP BY ALL
), own AS (
  SELECT o.lang, o.g, o.f AS a, o.k AS words FROM grams o LEFT JOIN within ON within.lang = o.lang AND within.part = o.g
  WHERE o.k > 1 AND (most IS NULL OR most < o.f)
), cuts AS (SELECT *, unnest(range(1, words)) AS cut FROM own),
scored AS (
  SELECT c.lang, c.g, c.a, cut, x.f AS l, y.f AS r, n, CAST((1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.g = c.g[1 : cut] JOIN grams y ON y.lang = c.lang AND y.g = c.g[cut + 1 : words]
  JOIN totals t ON t.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM best QUALIFY rank <= 2000
"""


QUERIES = {
    "op1_lattice_lm": (op1_lattice_lm, None),
    "op2_byte_bpe": (op2_byte_bpe, None),
    "op3_language_id": (op3_language_id, None),
    "op4_simhash": (op4_simhash, None),
    "op5_sequence_files": (op5_sequence_files, None),
    "op6_paragraphs": (op6_paragraphs, None),
    "op7_decontamination": (op7_decontamination, OP7_SQL),
    "op8_token_counts": (op8_token_counts, None),
    "op9_repeated_strings": (op9_repeated_strings, OP9_SQL),
    "op10_quality_rules": (op10_quality_rules, OP10_SQL),
    "op11_cap_filters": (op11_cap_filters, OP11_SQL),
    "op12_ranked_search": (op12_ranked_search, OP12_SQL),
    "op13_collocations": (op13_collocations, OP13_SQL),
}
