"""Parts that need no Spark session, against plain versions."""

import random
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from readsift.llm import packing, shingles, substrings, token_counts, va_file, warc

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def noise(seed, alphabet, texts, longest):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randint(0, longest))) for _ in range(texts)]


TEXTS = ["", " ", "  ", "a  b ", "\n\n x", "日本語😀", "<s> hi </s> <0x0A>", "x" * 900, "12345 678", "▁a ▁▁", " " * 40, "\x00a", "it's 've ok's\n'll"]
TEXTS += noise(1, "abcdeghinorst  \n▁éñßAB12.,'", 300, 200)


@pytest.mark.parametrize("chunk", [5, 64, 1 << 15])
def test_transducer_counts_as_the_library(chunk):
    machine = token_counts.Transducer.load(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert [machine.tokens(t, chunk) for t in TEXTS] == [len(library.encode(t)) for t in TEXTS]


def test_transducer_forgets_and_still_counts():
    full, small = token_counts.Transducer.load(PIECES), token_counts.Transducer.load(PIECES)
    small._kept = 50
    assert [small.tokens(t, 64) for t in TEXTS] == [full.tokens(t, 64) for t in TEXTS]


def test_chunk_maps_compose_in_any_grouping():
    machine, pick = token_counts.Transducer.load(PIECES), random.Random(2)
    text = " " + " ".join(TEXTS)
    whole = machine.finish(machine.compose([machine.chunk_map(text)]))
    for _ in range(5):
        cuts = sorted(pick.sample(range(1, len(text)), 30))
        maps = [machine.chunk_map(text[a:b]) for a, b in pairwise([0, *cuts, len(text)])]
        while len(maps) > 1:
            i = pick.randrange(len(maps) - 1)
            maps[i : i + 2] = [machine.join(maps[i], maps[i + 1])]
        assert machine.finish(maps[0]) == whole


def test_encoder_gives_the_ids_of_the_library():
    library = Tokenizer.from_file(BYTES)
    for kept in (3, 600_000):
        own = packing.Encoder(BYTES, kept)
        for t in [*TEXTS, "a <|endoftext|> b", "one two,\nthree. four!"]:
            assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_cut_leaves_the_short_piece_first():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_best_fit_against_a_list_of_open_bins():
    pick, bins, open_, made = random.Random(3), packing.OpenBins(16, 4), [], 0
    for _ in range(3000):
        n = pick.randint(1, 16)
        sequence, offset = bins.place(n)
        fits = [free for free, _ in open_ if free >= n]
        if fits:
            free = min(fits)
            assert (free, sequence) in open_ and offset == 16 - free
            open_.remove((free, sequence))
        else:
            free = 16
            assert (sequence, offset) == (made, 0)
            made += 1
            if n < 16 and len(open_) == 4:
                fullest = min(f for f, _ in open_)
                # Of equally full ones the tool may close any: take the one it no longer has.
                known = set(bins._by_free[fullest])
                open_.remove(next(b for b in open_ if b[0] == fullest and b[1] not in known))
        if free > n:
            open_.append((free - n, sequence))


def test_shingle_sets_against_tuples():
    def plain(text):
        words = shingles.split(text)
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    texts = [None, "x y z w v", "A b\tc\x0bd\ne f  g", *TEXTS, *noise(4, "ab c", 200, 60)]
    assert [len(s) for s in shingles.shingle_sets(texts, 5)] == [len(plain(t)) for t in texts]


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    texts = [*TEXTS, "word " * 500]
    whole = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "SLICE", 1000)
    sliced = shingles.word_hashes(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, sliced))


def test_every_long_stretch_holds_a_paragraph():
    texts = noise(5, "abcde ", 60, 900)
    hashes, borders = shingles.word_hashes(texts)
    starts = substrings.paragraph_starts(hashes, borders, 20, 31)
    for first, end in pairwise(borders):
        own = starts[(starts >= first) & (starts < end)]
        if end - first >= 50:
            assert max(np.diff([first - 1, *own, end - 20 + 1])) <= 31
        elif end - first < 20:
            assert not len(own)


def test_bands_are_the_fewest_for_the_recall():
    assert 1 - (1 - 0.8**2) ** substrings.BANDS >= 0.98 > 1 - (1 - 0.8**2) ** (substrings.BANDS - 1)


def test_bounds_hold_and_reading_stops_early():
    pick = np.random.default_rng(0)
    vectors, queries = np.floor(pick.normal(0, 60, (256, 16))), np.floor(pick.normal(0, 60, (9, 16)))
    row = type("Row", (), dict(zip(("dim", "n", "ids", "low", "step", "cells", "vectors"), va_file._block(range(256), vectors))))
    middle, reach = va_file._bounds(queries, row)
    exact = queries @ vectors.T
    assert (np.abs(exact - middle) <= reach[:, None]).all()
    for q in range(9):
        order = np.lexsort((np.arange(256), -exact[q]))[:5]
        found = va_file._read_in_order(queries[q], vectors, np.arange(256), middle[q], reach[q], np.arange(256), 5)
        assert [i for _, i in found] == order.tolist()


def test_large_components_are_multiplied_exactly():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**21, 5.0]])
    assert int(va_file._products(a, b)[0, 0]) == 2**61 + 15


def test_digest_of_nothing():
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def words_of(pick, n):
    return [b"w%d" % pick.randrange(10**6) for _ in range(n)]


def test_equal_sentences_around_other_words_are_no_passage():
    pick = random.Random(11)
    for fixed, own in ((35, 45), (25, 40), (40, 20)):
        head, tail = words_of(pick, fixed), words_of(pick, fixed)
        a, b = (words_of(pick, 9) + head + words_of(pick, own) + tail + words_of(pick, 9) for _ in range(2))
        anchors = [(i, i) for i in (9, 9 + fixed - 20, 9 + fixed + own, 9 + fixed + own + fixed - 20)]
        assert substrings._grow(a, b, anchors) == []
    # Stretches that are long enough each stay apart.
    head, tail = words_of(pick, 60), words_of(pick, 70)
    a, b = (head + words_of(pick, 45) + tail for _ in range(2))
    assert substrings._grow(a, b, [(5, 5), (110, 110)]) == [(0, 60), (105, 175)]


def test_passages_grow_over_edits_to_the_similarity():
    pick = random.Random(12)
    for n, edits in ((60, [30]), (80, [40]), (100, [30, 66]), (52, [8]), (300, [40, 90, 140, 190, 240])):
        kept = words_of(pick, n)
        for kind in range(3):
            own = list(kept)
            for e in reversed(edits):
                own[e : e + (kind != 1)] = words_of(pick, kind != 2)  # another word, one more, one less
            around = [words_of(pick, 30) + t + words_of(pick, 30) for t in (own, kept)]
            longest = max(pairwise([-1, *edits, n]), key=lambda g: g[1] - g[0])[0] + 2
            shift = (0, 1, -1)[kind] * sum(e < longest for e in edits)
            spans = substrings._grow(*around, [(30 + longest + shift, 30 + longest)])
            assert len(spans) == 1 and spans[0] == (30, 30 + len(own))


def test_near_passages_share_an_anchor_and_are_removed_whole():
    pick, found, tried = random.Random(13), 0, 0
    for n, edits in ((50, 1), (60, 1), (80, 1), (100, 2), (150, 3)):
        for _ in range(40):
            kept = words_of(pick, n)
            own = list(kept)
            for i in range(edits):  # evenly spread, the hardest case
                own[(i + 1) * n // (edits + 1)] = b"changed"
            if not substrings._jaccard_reaches(own, kept, 80):
                continue
            texts = [words_of(pick, pick.randrange(90)) + t + words_of(pick, pick.randrange(90)) for t in (own, kept)]
            hashes = [shingles.word_hashes([b" ".join(t).decode()]) for t in texts]
            places = []
            for own_hashes, borders in hashes:
                runs = shingles.rolling(own_hashes, substrings.ANCHOR)
                starts = substrings.paragraph_starts(own_hashes, borders, substrings.ANCHOR, substrings.ANCHOR_REACH)
                places.append({int(runs[s]): int(s) for s in starts})
            anchors = [(places[0][h], places[1][h]) for h in places[0].keys() & places[1].keys()]
            spans = substrings._grow(*texts, anchors)
            first = next(i for i in range(len(texts[0])) if texts[0][i : i + n] == own)
            tried += 1
            found += spans == [(first, first + n)]
    assert found == tried >= 150


def test_words_longer_than_a_slice_have_one_hash(monkeypatch):
    pick = random.Random(15)
    texts = ["x" * 5000, "x" * 4999 + "y", "a " + "é" * 3000 + " b c", " " + "z" * 100, "z" * 200 + " " * 250 + "q" * 101, "\n" * 350]
    texts += ["".join(pick.choice("abcdefghijk" * 9 + " \t") for _ in range(2000)) for _ in range(30)]
    whole = shingles.word_hashes(texts)
    assert np.diff(whole[1]).tolist() == [len(shingles.split(t)) for t in texts]
    for size in (100, 64, 7):
        monkeypatch.setattr(shingles, "SLICE", size)
        sliced = shingles.word_hashes(texts)
        assert all(np.array_equal(a, b) for a, b in zip(whole, sliced))
    monkeypatch.undo()
    assert [len(s) for s in shingles.shingle_sets(["w" * (6 << 20)], 5)] == [1]


def test_words_of_letters_skip_the_splitting_of_the_library():
    made = packing.Encoder(BYTES)
    asked = []
    whole = made._whole
    made._whole = lambda text: asked.append(text) or whole(text)
    words = ["Zebra", "straße", "Ærø", "naïve", "ªº", "don't", "x9", "\u0431\u044b\u043b", "a", "\u01c5", "e\u0301"]
    for word in words:
        for text in (word, " " + word):
            assert made._word(text) == whole(text), text
    assert {t.strip() for t in asked} == {"don't", "x9", "\u0431\u044b\u043b", "e\u0301"}
