"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from readsift.llm import (
    decontaminate, html_text, importance, jaccard, language, middle, packing, quality, shards, substrings, token_counts,
    va_file, warc,
)
from readsift.llm.common import table
from readsift.session import tune

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Rows hold whole texts or blocks of vectors, so a batch of the usual 10,000 could fill a Python worker.
ROWS_PER_BATCH = "500"


def prepared(spark: SparkSession, df: DataFrame | None = None) -> DataFrame | None:
    """Set what the operators want of a session; returns ``df``."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return df


def _query(function):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared(spark)
        return function(spark, sf_dir)

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    QUERIES[function.__name__] = run
    return function


@_query
def op5_feistel_shards(spark, sf_dir):
    """Law ``rows``: 24 shards whose counts differ by one at most."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shards.shard_rows(docs, ["doc_id"], 24, seed=5).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op9_transducer_counts(spark, sf_dir):
    """Tokens of every document by the compiled transducer of the piece model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 4096).alias("over_limit"),
    )


_SCRAMBLE = "(((({0} % {p} * a + b) % {p}) * (({0} % {p} * a + b) % {p}) % {p}) * (({0} % {p} * a + b) % {p}) + b) % {p}"
ORACLES["op5_feistel_shards"] = f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n] || list_transform(range(8), lambda i: CAST(0 AS BIGINT)),
      lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) g(n))),
digests AS (
  SELECT doc_id, CAST(strlen(text) AS BIGINT) + 8 AS size, xor(list_reduce([4294967295] || list_transform(
      regexp_extract_all(hex(encode(text)), '..'),
      lambda p: CAST(strpos('0123456789ABCDEF', substr(p, 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(p, 2, 1)) - 17 AS BIGINT)),
    lambda c, b: xor(t[CAST(xor(c % 256, b) + 1 AS BIGINT)], c // 256)), 4294967295) AS text_crc32
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), crc),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM digests),
sides AS (
  SELECT n, lefts, CAST(ceil(n / CAST(lefts AS DOUBLE)) AS BIGINT) AS rights
  FROM (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS lefts FROM documents)),
keys (i, a, b) AS (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(shards._round_keys(5)))}),
walk AS (
  SELECT x, 0 AS k, x // rights AS l, x % rights AS r FROM numbered, sides
  UNION ALL
  -- A number outside goes through all rounds again, as it is.
  SELECT x, i + 1, CASE WHEN i % 2 = 0 THEN (l + {_SCRAMBLE.format("r", p=shards._PRIME)}) % lefts ELSE l END,
         CASE WHEN i % 2 = 1 THEN (r + {_SCRAMBLE.format("l", p=shards._PRIME)}) % rights ELSE r END
  FROM walk, sides, keys WHERE i = k % {shards.ROUNDS} AND (k < {shards.ROUNDS} OR l * rights + r >= n)),
places AS (SELECT x, l * rights + r AS place FROM walk, sides WHERE k = {shards.ROUNDS} AND l * rights + r < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % 24 AS INT) AS shard, place // 24 AS slot, CAST(NULL AS INT) AS grown_shard
FROM numbered JOIN places USING (x)
"""


@_query
def op3_best_fit_packing(spark, sf_dir):
    """All documents in sequences of at most 1024 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


@_query
def op7_va_file_top_k(spark, sf_dir):
    """The 5 best inner products of every vector whose id is divisible by 50, over all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return va_file.top_k(vectors.where("vec_id % 50 = 0"), vectors, k=5)


ORACLES["op7_va_file_top_k"] = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM valid q JOIN valid d ON d.vec_id <> q.vec_id AND len(d.v) = len(q.v) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query
def op2_positional_decontamination(spark, sf_dir):
    """Hits of all benchmark items in every document, and items of which 4 rare words stand in 26 words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.contamination(docs, items, near=(13, 4)).drop("_hash")


ORACLES["op2_positional_decontamination"] = """
WITH lowered AS (
  SELECT doc_id AS id, 0 AS is_item, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT item_id, 1, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
split AS (
  SELECT id, is_item, regexp_extract_all(coalesce(t, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM lowered),
items AS (SELECT id AS item_id, w, least(13, len(w)) AS k FROM split WHERE is_item = 1 AND len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM items)),
lengths AS (SELECT DISTINCT k FROM items),
doc_windows AS (
  SELECT id AS doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM split CROSS JOIN lengths WHERE is_item = 0 AND len(w) >= k)),
found AS (SELECT doc_id, s, d.k, item_id FROM doc_windows d JOIN item_windows i ON i.phrase = d.phrase AND i.k = d.k),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM (SELECT DISTINCT doc_id, s, k FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id),
item_words AS (SELECT item_id, w AS whole, k, unnest(w) AS t, unnest(range(0, len(w))) AS p, len(w) AS n FROM items),
doc_words AS (SELECT id AS doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS pos FROM split WHERE is_item = 0),
seen AS (SELECT t, count(*) AS f FROM doc_words WHERE t IN (SELECT t FROM item_words) GROUP BY t),
rare AS (
  SELECT DISTINCT item_id, t FROM (
    SELECT item_id, t, row_number() OVER (PARTITION BY item_id, whole, s ORDER BY f, p) AS nth
    FROM (SELECT item_id, whole, t, p, unnest(range(greatest(p - k + 1, 0), least(p, n - k) + 1)) AS s FROM item_words) JOIN seen USING (t)) WHERE nth <= 2),
close AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (
    SELECT doc_id, item_id, b FROM (SELECT doc_id, t, unnest([pos // 13 - 1, pos // 13]) AS b FROM doc_words) JOIN rare USING (t)
    GROUP BY doc_id, item_id, b HAVING count(DISTINCT t) >= 4) GROUP BY doc_id)
SELECT s.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0) AS n_near
FROM split s LEFT JOIN hit h ON h.doc_id = s.id LEFT JOIN named n ON n.doc_id = s.id LEFT JOIN close c ON c.doc_id = s.id WHERE is_item = 0
"""


@_query
def op4_prefix_orders_join(spark, sf_dir):
    """Components of documents whose 5-word shingle sets agree to 80 per cent."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("_hash")


ORACLES["op4_prefix_orders_join"] = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.t = y.t AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
either_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, e.b FROM reach JOIN either_way e ON e.a = reach.r)
SELECT s.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM split s LEFT JOIN sizes z ON z.doc_id = s.doc_id
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""


@_query
def op6_pu_quality(spark, sf_dir):
    """Quality of every document, learnt from the labelled positives of the training folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs, model, threshold=0.3)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@_query
def op1_paragraph_minhash(spark, sf_dir):
    """Repeated passages of 50 words or more in all documents, and the document that keeps each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = substrings.repeated_spans(docs).drop("_hash").withColumnsRenamed({"start": "start_char", "end": "end_char"})
    return spans.withColumnRenamed("cluster", "cluster_id")


@_query
def op8_warc_round_trip(spark, sf_dir):
    """All pages written to WARC files and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    found = warc.pages(warc.read(spark, warc.archive(pages)))
    return found.select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


@_query
def op10_template_text(spark, sf_dir):
    """Main text of every page."""
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


ORACLES["op8_warc_round_trip"] = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
  SELECT *, list_aggregate(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
        -- Hex digits j and j + 1 hold the five bits that start at bit 5 i.
        ((strpos('0123456789abcdef', substr(hex, 1 + (5 * i) // 4, 1)) - 1) * 16
          + greatest(strpos('0123456789abcdef', substr(hex, 2 + (5 * i) // 4, 1)) - 1, 0)) // (1 << (3 - (5 * i) % 4))) % 32 AS INT), 1)),
    'string_agg', '') AS payload_digest
  FROM payloads),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


@_query
def op11_importance_draw(spark, sf_dir):
    """One document in ten, drawn towards the benchmark texts."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = importance.importance_ranks(docs, target, (10, 100), buckets=10_000, max_run=1, min_words=20, seed=2024)
    return ranked.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLES["op11_importance_draw"] = """
WITH crc AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n] || list_transform(range(8), lambda i: CAST(0 AS BIGINT)),
      lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) g(n))),
texts AS (SELECT doc_id AS id, 0 AS is_target, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
feature AS (
  SELECT id, is_target, unnest(regexp_extract_all(
    coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS f
  FROM texts),
placed AS (
  SELECT f, CAST(xor(list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(f)), '..'),
      lambda p: CAST(strpos('0123456789ABCDEF', substr(p, 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(p, 2, 1)) - 17 AS BIGINT)),
    lambda c, b: xor(t[CAST(xor(c % 256, b) + 1 AS BIGINT)], c // 256)), 4294967295) AS BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM feature), crc),
counts AS (
  SELECT bucket, CAST(count(*) FILTER (is_target = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (is_target = 1) AS DOUBLE) AS t
  FROM feature JOIN placed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (S_all + 10000) / ((s + 1) * (T_all + 10000)))) AS BIGINT) AS gain
  FROM counts, (SELECT sum(s) AS S_all, sum(t) AS T_all FROM counts)),
weights AS (
  SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM feature JOIN placed USING (f) JOIN gains USING (bucket) WHERE is_target = 0 GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(
      -1000 * ln(-ln((CAST('0x' || substr(sha256(concat('2024:', CAST(doc_id AS VARCHAR))), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights w ON w.id = d.doc_id),
ordered AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
         count(*) FILTER (n_features >= 20) OVER () AS eligible
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= eligible * 10 // 100 THEN place END AS rank FROM ordered
"""


@_query
def op12_segment_language(spark, sf_dir):
    """Language of every document, learnt from the training folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    found = language.identify(docs.drop("lang"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@_query
def op13_fill_in_middle(spark, sf_dir):
    """Every document cut at two token boundaries and put together in another order, with its way back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = middle.transform(docs, seed=1, per_cent=90, suffix_first=20)
    sha256 = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha256(F.col("output")).alias("output_sha256"),
        sha256(middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLES["op13_fill_in_middle"] = """
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t,
         sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS d FROM documents),
drawn AS (
  SELECT doc_id, text, t, len(t) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(d, 8 * i + 1, 8) AS BIGINT)) AS h FROM tokens),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
