import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from readsift.llm import packing, queries, shards, token_counts
from readsift.session import stage

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 7, 576, 1000])
def test_permutation_and_its_inverse(spark, n):
    there = shards.permute(F.col("id"), n, seed=9)
    rows = spark.range(n).select("id", there.alias("p")).withColumn("back", shards.unpermute(F.col("p"), n, seed=9)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_shards_of_ties_nulls_and_clashing_columns(spark):
    rows = [(None, None, 1), (None, None, 1), (3, "", 2), (3, "", 2), (3, "x" * 10_000, 3), (-1, "é", 4), (9, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot int")
    found = shards.shard_rows(df, ["doc_id"], 3, seed=1).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((a, b) for a, b, _ in rows)
    for shard, count in Counter(r.shard for r in found).items():
        assert count in (2, 3) and sorted(r.slot for r in found if r.shard == shard) == list(range(count))
    assert shards.shard_rows(df.limit(0), ["doc_id"], 3).count() == 0


def test_shard_query_on_the_small_table(spark, small_dir):
    rows = queries.QUERIES["op5_feistel_shards"](spark, small_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 8 for r in rows)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    by_number = sorted(texts)
    # A slot's row is computable backwards.
    places = spark.createDataFrame([(r.doc_id, r.slot * 24 + r.shard) for r in rows], "doc_id long, place long")
    back = places.select("doc_id", shards.unpermute(F.col("place"), len(rows), 5).alias("i")).collect()
    assert all(by_number[r.i] == r.doc_id for r in back)


def test_packing_query_on_the_small_table(spark, small_dir):
    rows = queries.QUERIES["op3_best_fit_packing"](spark, small_dir).collect()
    library = Tokenizer.from_file(BYTES)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 2] for k, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        own = np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(own) == r.ids_crc32
    assert by_doc.keys() == ids.keys()
    for k, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [(r.start, r.length) for r in own] == packing.cut(len(ids[k]), 1024)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.06 * math.ceil(sum(map(len, ids.values())) / 1024)


def test_packed_sequences_hold_the_tokens(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 60), (4, "word " * 60), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    packed = packing.pack(stage(packing.pieces(docs, BYTES, capacity=16)), 16)
    whole = packing.sequences(packed).collect()
    library = Tokenizer.from_file(BYTES)
    expected = Counter(i for _, t in rows for i in [*library.encode(t or "", add_special_tokens=False).ids, 2])
    found = Counter(i for s in whole for i in np.frombuffer(s.ids, "<u4").tolist())
    assert found == expected and all(s.n_tokens <= 16 and len(s.ids) == 4 * s.n_tokens for s in whole)
    assert packing.pack_documents(docs.limit(0), BYTES).count() == 0


def test_lengths_outside_a_sequence_raise(spark):
    items = spark.createDataFrame([(1, 17)], "id long, length long")
    with pytest.raises(Exception, match="between 1 and 16"):
        packing.pack(items, 16).collect()


def test_token_counts_keep_rows_and_columns(spark):
    rows = [(1, "a b", 9), (1, "a b", 9), (2, None, 9), (None, "", 9), (3, "x" * 70_000 + " y", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = token_counts.count_tokens(df, PIECES, chunk=1000)
    assert Counter((r.doc_id, r.text, r.n_tokens) for r in found.collect()) == Counter(
        (a, b, len(library.encode(b or ""))) for a, b, _ in rows
    )
    assert token_counts.count_tokens(df.limit(0), PIECES).count() == 0


def test_texts_in_parts_are_composed_by_a_scan(spark):
    texts = {1: "hello  world\nof many words " * 9, 2: "", 3: "unbroken" * 40}
    rows = [(k, i, t[7 * i : 7 * i + 7]) for k, t in texts.items() for i in range(max(1, -(-len(t) // 7)))]
    df = spark.createDataFrame(rows, "k long, part long, text string")
    maps = token_counts.part_maps(df, PIECES, "k", "part", "text")
    found = {r.k: r.n_tokens for r in token_counts.scan_parts(maps, PIECES, "k", "part", levels=3, fan=4).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert found[1] == len(library.encode(texts[1])) and found[3] == len(library.encode(texts[3]))


def test_token_query_on_the_small_table(spark, small_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op9_transducer_counts"](spark, small_dir).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)
