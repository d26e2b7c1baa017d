"""Importance draw, language identification and fill-in-the-middle rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from readsift.llm import importance, language, middle, queries
from readsift.session import stage

# ---- fill in the middle


@pytest.mark.parametrize("kind, low", [
    (middle.SortedArray, [0, 5, 9, 70, 65535]),
    (middle.Runs, [*range(10, 4000), *range(5000, 20000), 65535]),
    (middle.Bitmap, sorted(random.Random(3).sample(range(1 << 16), 30_000))),
    (middle.Runs, list(range(1 << 16))),
    (middle.SortedArray, [7]),
])
def test_containers_select_every_member(kind, low):
    held = middle.container(np.array(low))
    assert isinstance(held, kind)
    assert [held.select(k) for k in range(len(low))] == low


def _plain_boundaries(text):
    return [0, *(m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text, re.S))]


@pytest.mark.parametrize("text", [
    "", "a", " ", "ab c1d\n", "é" * 70_000, "word " * 40_000, "x" * 200_000, "a" * 65_536 + "b", "a" * 65_535 + " " + "b" * 9,
    "".join(random.Random(1).choice("ab 1é𝔘\n") for _ in range(150_000)),
])
def test_boundaries_of_whole_texts(text):
    want, found = _plain_boundaries(text), middle.token_boundaries(text)
    assert len(found) == len(want)
    for k in {*range(min(len(want), 300)), *range(max(len(want) - 300, 0), len(want)), *range(0, len(want), 997)}:
        assert found.select(k) == want[k]
    with pytest.raises(IndexError):
        found.select(len(want))


def _plain_middle(doc, text, seed=1):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", text, None, None
    if h[3] % 100 < 20:
        return len(tokens), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(tokens), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_middle_rows_equal_a_plain_version_and_come_back(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("abc <PSM>\né𝔘9") for _ in range(r.randrange(60))) for _ in range(300)]
    texts += [None, "", "<", "<P", "<P>", "a<S", "S>", "<<", "long " * 50_000, "x" * 100_000, "same", "same"]
    rows = [(i, t, "old") for i, t in enumerate(texts)] + [(5, texts[5], "old"), (None, "no id here", "old"), (None, None, "old")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, output string")
    made = middle.transform(docs).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((x.doc_id, x.text, x.n, x.form, x.output, x.prefix_chars, x.middle_chars) for x in made)
    assert got == Counter((d, t, *_plain_middle(d, t)) for d, t, _ in rows)
    assert all(x.back == (x.text or "") for x in made) and {x.form for x in made} == {"plain", "psm", "spm"}
    assert middle.transform(docs.limit(0)).count() == 0
    assert middle.transform(docs, per_cent=0).where("form <> 'plain'").count() == 0


# ---- importance draw


def _plain_features(text, max_run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, max_run + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
@pytest.mark.parametrize("max_run", [1, 3])
def test_features_of_any_piece(piece, max_run):
    r = random.Random(2)
    for text in [None, "", "  ", "One-two THREE", "é1ß a", *("".join(r.choice("aB é.9\n") for _ in range(80)) for _ in range(40))]:
        n, features = 0, []
        for words, found in importance.feature_lists(text, max_run, piece):
            n, features = n + words, features + [f.decode() for f in found]
        want_n, want = _plain_features(text, max_run)
        assert n == want_n and Counter(features) == Counter(want)


def _plain_draw(docs, target, share, buckets, max_run, min_words, seed):
    def bag(texts):
        counts = Counter()
        for t in texts:
            counts.update(zlib.crc32(f.encode()) % buckets for f in _plain_features(t, max_run)[1])
        return counts

    s, t = bag(x for _, x in docs), bag(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        n, features = _plain_features(text, max_run)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    drawn = sorted((x for x in rows if x[1] >= min_words), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    k = len(drawn) * share[0] // share[1]
    return Counter((*x, None) for x in rows if x[1] < min_words) + Counter(
        (*x, i + 1 if i < k else None) for i, x in enumerate(drawn)
    )


@pytest.mark.parametrize("max_run, share", [(1, (10, 100)), (2, (1, 2)), (1, (0, 100)), (1, (100, 100))])
def test_draw_equals_a_plain_version(spark, max_run, share):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(("ab", "cd", "Ef", "é", "x9")) for _ in range(r.randrange(1, 12)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "..."), (None, "ab cd ab cd"), (7, docs[7][1]), (7, docs[7][1]), (503, "ab " * 100_000)]
    target = ["ab ab x9", None, "", "cd ab"]
    made = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, rank int, score string")
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.importance_ranks(made, wanted, share, 50, max_run, 4, 9).collect()
    got = Counter((x.id, x.n_words, x.n_features, x.weight, x.score, x["rank"]) for x in found)
    assert got == _plain_draw(docs, target, share, 50, max_run, 4, 9)
    drawn = importance.resample(made, wanted, share=share, buckets=50, max_run=max_run, min_words=4, seed=9)
    assert drawn.columns == made.columns
    assert {(x.doc_id, x.text) for x in drawn.collect()} == {(x.id, dict(docs)[x.id]) for x in found if x["rank"] is not None}


def test_draw_from_empty_tables(spark):
    docs = spark.createDataFrame([(i, "ab cd ef gh") for i in range(10)], "doc_id bigint, text string")
    assert importance.importance_ranks(docs.limit(0), docs, min_words=1).count() == 0
    found = importance.importance_ranks(docs, docs.limit(0), (1, 2), 10, 1, 1)
    assert found.where("rank IS NOT NULL").count() == 5


@pytest.mark.parametrize("margin, sketch", [(0.0, 8), (0.004, 2048), (1.0, 8)])
def test_a_bracket_holds_the_cutoff_whatever_the_sketch_says(spark, margin, sketch):
    r = random.Random(6)
    scores = [r.randrange(100_000) for _ in range(4000)] + [50_000] * 2000  # a third tie
    scored = stage(spark.createDataFrame([(i, s, True) for i, s in enumerate(scores)], "id long, score long, eligible boolean"))
    falling = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    for wanted in (1, 2500, 3999, 6000):
        bracket = importance.find_bracket(scored, wanted, margin, sketch)
        assert bracket.above == sum(s > bracket.high for s in scores) < wanted <= bracket.above + bracket.inside
        ranked = importance.rank_drawn(scored, wanted, ["id"], margin, sketch).where("rank IS NOT NULL").collect()
        assert {x["rank"]: x.id for x in ranked} == {k + 1: i for k, i in enumerate(falling[:wanted])}


# ---- language


def _ways(word, names):
    """All segmentations of a marked word, unknown characters as their bytes; numbers as in Pieces.named."""
    number, marked = {n: i for i, n in enumerate(names)}, "▁" + word
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        at, parts = 0, []
        for i, cut in enumerate([*cuts, 1], 1):
            if cut:
                parts.append(marked[at:i])
                at = i
        if all(p in number or len(p) == 1 for p in parts):
            yield [x for p in parts for x in ([number[p]] if p in number else [len(names) + b for b in p.encode()])]


NAMES = ["▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ab", "é"]
WORDS = ["", "a", "ab", "abab", "bba", "éa", "aßb", "ßß", "abababa"]


def test_every_segmentation_counts():
    pieces = language.Pieces.named(NAMES)
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 3).T)
    lattice = language.Lattice(pieces, WORDS)
    totals = lattice.totals(lattice.forward(lattice.costs(logs)))
    column = np.arange(len(WORDS)) % 3
    shares = lattice.shares(lattice.costs(logs, column))[:, 0]
    for i, word in enumerate(WORDS):
        ways = list(_ways(word, NAMES))
        each = np.array([logs[w].sum(axis=0) for w in ways])
        assert totals[i] == pytest.approx(np.log(np.exp(each).sum(axis=0)))
        weight = np.exp(each[:, column[i]] - totals[i, column[i]])
        want = Counter()
        for w, x in zip(ways, weight):
            for piece in w:
                want[piece] += x
        got = Counter()
        for e in np.flatnonzero(lattice.word == i):
            got[int(lattice.piece[e])] += shares[e]
            for piece in lattice.more_piece[lattice.more_edge == e]:
                got[int(piece)] += shares[e]
        assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)


def test_words_of_any_piece():
    text = "Éa b2c  déjà_vu 漢字かな. " * 5 + "x" * 200
    want = [w for part in language.word_lists(text) for w in part]
    assert want[:4] == ["éa", "b", "c", "déjà"] and max(map(len, want)) == language.LONGEST and "".join(want).endswith("x" * 200)
    for piece in (1, 5, 64):
        assert [w for part in language.word_lists(text, piece) for w in part] == want
    assert [w for t in (None, "", "12 .") for part in language.word_lists(t) for w in part] == []


def test_both_ways_to_split_words_agree():
    r = random.Random(9)
    for text in ["", *("".join(map(chr, r.choices(range(256), k=200))) for _ in range(300))]:
        assert language._words(text) == language._WORD.findall(text.lower()) == language._words(text + " 漢")[: len(language._words(text))]


MODEL_FILE = public_tokenizers.path("piece_bpe_32k.model")
SAID = {"en": "the house and the river of that thing", "de": "der das und nicht ein haus mit der zeit", "fr": "les une que dans la maison avec le temps"}


def _languages(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(SAID[lang].split(), k=6)).title(), lang) for i, lang in enumerate(list(SAID) * 40)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_languages_of_hard_rows(spark):
    rows, docs = _languages(spark)
    model = language.train(docs, MODEL_FILE)
    hard = [(1, None, 2.5), (1, None, 2.5), (None, "", 2.5), (2, "12 + 3 = ?", 2.5), (None, "the and the", 2.5), (3, "der und " * 60_000, 2.5),
            (4, "x" * 100_000, 2.5), (5, "漢字", 2.5)]
    found = language.identify(spark.createDataFrame(hard, "doc_id bigint, text string, score double"), model).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((a, b) for a, b, _ in hard)
    said = {(r.doc_id, (r.text or "")[:7]): (r.lang_pred, r.score) for r in found}
    assert said[1, ""] == said[None, ""] == said[2, "12 + 3 "] == ("und", 0.0)
    assert said[None, "the and"][0] == "en" and said[3, "der und"] == ("de", pytest.approx(1.0)) and said[5, "漢字"][0] in SAID
    assert all(0 <= r.score <= 1 for r in found)
    assert language.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.train(docs.withColumn("lang", F.lit(None).cast("string")), MODEL_FILE) is None


def test_learning_ignores_the_held_out_fold_and_partitions(spark):
    rows, docs = _languages(spark)
    turned = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    a = language.train(docs, MODEL_FILE)
    b = language.train(spark.createDataFrame(turned, docs.schema).repartition(7), MODEL_FILE)
    assert a.languages == b.languages == sorted(SAID) and np.array_equal(a.logs, b.logs) and np.array_equal(a.prior, b.prior)
    assert np.exp(a.logs).sum(axis=0) == pytest.approx(np.ones(3))


def test_language_of_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.QUERIES["op12_segment_language"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    kept = [r.lang_pred == docs[r.doc_id] for r in found if r.held_out and r.lang_pred != "und"]
    assert sum(kept) >= 0.97 * len(kept) > 0
