"""Near copies, repeated passages and benchmark passages, against plain versions on hard cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from readsift.checks.compare import compare, duck
from readsift.llm import common, decontaminate, jaccard, queries, substrings

WORDS = [a + b for a in "bcdfghklm" for b in ("a", "en", "ion", "ost", "um")]


def prose(pick, n):
    return " ".join(pick.choice(WORDS) + str(pick.randint(0, 99)) for _ in range(n))


def edited(pick, text, changes):
    words = text.split()
    for _ in range(changes):
        words[pick.randrange(len(words))] = pick.choice(WORDS)
    return " ".join(words)


@pytest.mark.parametrize("name", ["op2_positional_decontamination", "op4_prefix_orders_join", "op7_va_file_top_k", "op8_warc_round_trip"])
def test_query_against_its_sql(spark, small_dir, name):
    ok, message, _ = compare(spark, duck(small_dir), small_dir, name, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_hubs_and_loops(spark):
    pick = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (8, 9), (9, 8), (None, 3)]
    pairs += [(pick.randint(1000, 1060), pick.randint(1000, 1060)) for _ in range(40)]
    found = common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert {r.node: r.component for r in found} == roots(real, {n for p in real for n in p})
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.fixture(scope="module")
def copies():
    pick = random.Random(6)
    base, other = prose(pick, 120), prose(pick, 90)
    rows = [(1, base), (2, base), (3, base.upper().replace("1", "1")), (4, None), (5, ""), (6, " \n "), (7, "one two"), (8, "ONE  two")]
    rows += [(10 + i, edited(pick, base, i % 6)) for i in range(30)]
    rows += [(50 + i, edited(pick, other, 1)) for i in range(12)]
    rows += [(70 + i, prose(pick, 60)) for i in range(10)] + [(90, "same " * 3000), (91, "same " * 2000)]
    rows += [(1, base), (None, base), (7, "one two")]
    return rows


def plain_components(rows):
    sets = defaultdict(set)
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[doc] |= {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    named = [d for d in sets if d is not None and sets[d]]
    links = [
        (a, b) for a in named for b in named
        if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return roots(links, [d for d in sets if d is not None]), sets


def test_jaccard_components_against_all_pairs(spark, copies):
    found = jaccard.jaccard_components(spark.createDataFrame(copies, "doc_id bigint, text string")).collect()
    expected, sets = plain_components(copies)
    assert Counter(r.doc_id for r in found) == Counter(d for d, _ in copies)
    for r in found:
        assert r.component_id == (expected[r.doc_id] if r.doc_id is not None else None)
        assert r.n_shingles == len(sets[r.doc_id]) or r.doc_id is None


def test_common_shingles_change_no_link(spark, copies, monkeypatch):
    df = spark.createDataFrame(copies, "doc_id bigint, text string")
    expected, _ = plain_components(copies)
    for common_from, rounds in ((2, 1), (10**9, 3)):
        monkeypatch.setattr(jaccard, "COMMON", common_from)
        monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
        found = jaccard.jaccard_components(df).collect()
        assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == expected


def test_one_of_each_stays(spark, copies):
    rows = [(d, t, i % 2, "c") for i, (d, t) in enumerate(copies)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component int, _hash string")
    found = jaccard.keep_one_each(df)
    expected, sets = plain_components(copies)
    assert found.columns == df.columns
    stay = {d for d in expected if expected[d] == d or not sets[d]}
    kept = Counter(r.doc_id for r in found.collect())
    assert set(kept) - {None} == stay and kept[1] == 1 and kept[7] == 1 and kept[None] == 1
    assert jaccard.keep_one_each(df.limit(0)).count() == 0


def near_group(pick, n, edits, first=100):
    """A text and ``n`` copies of it with so many words changed, cut or added, in places drawn at random."""
    base = prose(pick, 150).split()
    rows = [(first, " ".join(base))]
    for i in range(1, n + 1):
        words = list(base)
        for _ in range(pick.randint(*edits)):
            at = pick.randrange(len(words))
            kind = pick.random()
            words[at : at + (kind < 0.9)] = [f"new{pick.randrange(10**6)}"] * (kind > 0.1)
        rows.append((first + i, " ".join(words)))
    return rows


def test_near_copies_short_of_the_threshold_are_not_paired_with_each_other(spark, monkeypatch):
    pick = random.Random(21)
    rows = near_group(pick, 160, (1, 14)) + near_group(pick, 20, (3, 12), 1000)
    # Not linked with the first text, but with each other; a text of several rows; a shorter one.
    twin = rows[70][1].split()
    rows += [(300, " ".join([*twin[:-1], "end"])), (302, " ".join(twin[5:])), (303, rows[0][1])]
    expected, _ = plain_components(rows)
    one, other = expected[rows[3][0]], expected[rows[170][0]]
    expected = {d: min(one, other) if c in (one, other) else c for d, c in expected.items()} | {3000: min(one, other)}
    rows += [(3000, rows[3][1]), (3000, rows[170][1])]
    monkeypatch.setattr(jaccard, "LONG_LIST", 8, raising=False)
    compared, whole = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *more: compared.append(pairs.count()) or whole(pairs, *more))
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert len(set(expected.values())) > 40 and sum(compared) < 700


def passages(pick):
    shared, short = prose(pick, 70), prose(pick, 30)
    rows = [(i, f"{prose(pick, pick.randint(5, 60))}{pick.choice([' ', chr(10)])}{shared} {prose(pick, 40)}") for i in range(1, 9)]
    rows += [(i, f"{prose(pick, 20)} {short} {prose(pick, 20)}") for i in range(20, 26)]
    rows += [(30 + i, prose(pick, 200)) for i in range(5)] + [(40, None), (41, ""), (42, shared), (None, shared), (3, rows[2][1])]
    near = shared.split()
    near[10] = "changed"
    return [*rows, (60, prose(pick, 25) + " " + " ".join(near) + " " + prose(pick, 9))], shared


def test_repeated_passages_wherever_they_stand(spark):
    rows, shared = passages(random.Random(8))
    spans = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    texts = {d: t for d, t in rows}
    # All but the first holder are caught, in full; short and single passages are left alone.
    assert {s.doc_id for s in spans} == {2, 3, 4, 5, 6, 7, 8, 42, 60}
    for s in spans:
        assert s.kept_doc == 1
        cut = texts[s.doc_id][s.start : s.end]
        if s.doc_id != 60:
            assert cut == shared and s.n_words == 70
        else:
            assert s.n_words == 59 and cut == " ".join(shared.split()[11:])


def test_cut_passages_leave_the_rest(spark):
    rows, shared = passages(random.Random(8))
    df = spark.createDataFrame([(d, t, len(t or ""), 1) for d, t in rows], "doc_id bigint, text string, n_chars bigint, _spans int")
    found = substrings.without_repeats(df)
    kept = {(r.doc_id, r.text, r.n_chars) for r in found.collect()}
    assert found.columns == df.columns
    assert sum(shared in (t or "") for d, t, _ in kept if d is not None) == 1
    assert {d for d, _, _ in kept} == {d for d, _ in rows} - {42}
    before = {d: t for d, t in rows}
    for d, t, n in kept:
        if d in (40, 41, None) or 20 <= d < 40 or d == 1:
            assert t == before[d]
        elif d is not None and d < 9:
            assert t == before[d].replace(shared, "") and n == len(t)
    assert substrings.without_repeats(df.limit(0)).count() == 0


def plain_hits(text, items, size=13):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words, hit, found = split(text), set(), set()
    for item, body in items:
        own = split(body)
        k = min(size, len(own))
        for w in range(len(own) - k + 1) if k and item is not None else ():
            for s in range(len(words) - k + 1):
                if words[s : s + k] == own[w : w + k]:
                    hit |= set(range(s, s + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def benchmarked():
    pick = random.Random(9)
    long, other = prose(pick, 40), prose(pick, 20)
    items = [(10, long), (9, other), (9, other), (8, "the the the"), (7, None), (6, " ... "), (5, "É"), (None, prose(pick, 15)), (4, "never seen here")]
    w = long.split()
    docs = [(1, f"x {long.upper()} y"), (2, " ".join(w[:13]) + " " + prose(pick, 300)), (3, " ".join(w[:12]) + " no"), (4, None), (5, ""), (6, "!!!"),
            (7, "The, THE; the the"), (8, "é É"), (9, long + " " + other + " " + long), (10, " ".join(w[5:30]).replace(" ", "\n--")), (1, "again"),
            (9, long + " " + other + " " + long), (None, other), (11, "the " * 5000)]
    return docs, items


def test_contamination_against_every_window(spark, benchmarked):
    docs, items = benchmarked
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ).drop("_hash").collect()
    expected = Counter()
    for doc, text in docs:
        n, hit, names = plain_hits(text, items)
        expected[doc, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and 20 * hit >= n] += 1
    assert Counter(map(tuple, found)) == expected


def test_clean_documents_stay(spark, benchmarked):
    docs, items = benchmarked
    df = spark.createDataFrame([(d, t, "k") for d, t in docs], "doc_id bigint, text string, _id string")
    marks = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.clean(df, marks)
    clean = [(d, t, "k") for d, t in docs if not (lambda n, h, _: h > 0 and 20 * h >= n)(*plain_hits(t, items))]
    assert found.columns == df.columns and Counter(map(tuple, found.collect())) == Counter(clean)
    assert decontaminate.clean(df.limit(0), marks).count() == 0
    assert decontaminate.clean(df, marks.limit(0)).count() == len(docs)


def test_words_near_each_other(spark, benchmarked):
    docs, items = benchmarked
    found = decontaminate.proximity_matches(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), within=20
    ).collect()
    assert {r.doc_id for r in found if r["item"] == "10"} >= {1, 9, 10}


def test_first_holders_of_a_part_hide_no_repeat(spark):
    pick = random.Random(14)
    rows, expected = [], {}
    for i in range(0, 400, 10):
        passage = prose(pick, 60)
        part = " ".join(passage.split()[10:50])
        rows.append((i + 1, f"{prose(pick, 20)} {part} {prose(pick, 20)}"))
        if i % 20:
            # The keeping document holds the part before the whole.
            rows[-1] = (i + 1, f"{rows[-1][1]} {passage} {prose(pick, 9)}")
        else:
            rows.append((i + 2, f"{prose(pick, 25)} {passage} {prose(pick, 9)}"))
        rows.append((i + 3, f"{prose(pick, 31)} {passage} {prose(pick, 12)}"))
        expected[i + 3] = (i + (1 if i % 20 else 2), 31, 60)
    spans = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {s.doc_id: (s.kept_doc, s.first_word, s.n_words) for s in spans} == expected and len(spans) == len(expected)


def test_reworded_items_are_near_words(spark):
    pick = random.Random(16)
    items = [(i, prose(pick, 13)) for i in range(4)]
    docs = []
    for i, text in items:
        own = text.split()[:-1]  # the last word is in no document
        pick.shuffle(own)
        docs.append((i, " ".join(own)))
    found = decontaminate.proximity_matches(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), within=20
    ).collect()
    split = {i: text.split() for i, text in [*docs]}
    counts = Counter(w for words in split.values() for w in set(words))
    expected = set()
    for i, text in items:
        known = sorted((w for w in text.split() if counts[w]), key=lambda w: (sum(x.count(w) for x in split.values()), text.split().index(w)))
        expected |= {(d, str(i)) for d, words in split.items() if len(set(known[:2]) & set(words)) >= 2}
    assert {(r.doc_id, r["item"]) for r in found} == expected and len(expected) >= 4


def test_items_of_many_words(spark):
    pick = random.Random(21)
    words = [f"w{pick.randrange(20_000)}" for _ in range(50_000)]
    docs = [(1, " ".join(words)), (2, " ".join(["no", *words[700:730], "yes"])), (3, " ".join(words[::2]))]
    items = [(7, " ".join(words))]
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in found} == {1: (50_000, 50_000, 1), 2: (32, 30, 1), 3: (25_000, 0, 0)}


@pytest.mark.parametrize("near", [(13, 4), (5, 2)])
def test_items_near_by_every_stretch(spark, benchmarked, near):
    docs, items = benchmarked
    docs = [*docs, (20, " ".join(reversed(items[0][1].split()))), (21, None)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    # A document is counted once however often its row is repeated only if the rows are read again; counts see all rows.
    counts = Counter(w for _, t in docs for w in split(t))
    rare = {}
    for item, text in items:
        w = split(text)
        for s in range(max(len(w) - 12, 1)) if item is not None and w else ():
            known = sorted((counts[t], p, t) for p, t in enumerate(w) if s <= p < s + 13 and counts[t])
            rare.setdefault(str(item), set()).update(t for _, _, t in known[:2])
    within, at_least = near
    expected = Counter()
    for doc, text in docs:
        w = split(text)
        blocks = [set(w[max(b * within, 0) : (b + 2) * within]) for b in range(-1, len(w) // within + 1)]
        expected[doc, sum(any(len(terms & held) >= at_least for held in blocks) for terms in rare.values())] += 1
    found = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), near=near
    ).collect()
    assert Counter((r.doc_id, r.n_near) for r in found) == expected and max(n for _, n in expected) > 0


def test_jaccard_compares_texts_of_all_rows_and_counts_per_batch(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:59], "other"]
    other = [f"u{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (2, " ".join(other)), (3, " ".join(other[:39])), (4, " ".join(near)), (5, "alone here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plans, whole = [], jaccard._verified
    monkeypatch.setattr(
        jaccard, "_verified",
        lambda pairs, prefixes, docs, *rest: plans.append(docs._jdf.queryExecution().optimizedPlan().toString()) or whole(pairs, prefixes, docs, *rest),
    )
    found = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    assert plans and not any("LeftAnti" in plan for plan in plans)
    counts = jaccard._counts(df, 5)
    assert {r.n for r in counts.collect()} == {2, 3}
    plan = counts._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") and "HashAggregate" not in plan[plan.index("Exchange"):]


def test_band_rows_carry_a_digest_only_where_the_band_is_none(spark):
    text = " ".join(f"w{i * i % 97}x{i}" for i in range(120))
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    found = substrings.bands(docs, where=True).toPandas()
    anchors, paragraphs = found[found["digest"].isna()], found[found["digest"].notna()]
    hashes, borders = substrings.shingles.word_hashes([text])
    starts = substrings.paragraph_starts(hashes, borders, substrings.ANCHOR, substrings.ANCHOR_REACH)
    runs = substrings.shingles.rolling(hashes, substrings.ANCHOR).view("int64")
    assert sorted(zip(anchors["pos"], anchors["band"])) == [(p, runs[p]) for p in starts.tolist()]
    assert len(paragraphs) == substrings.BANDS * paragraphs["pos"].nunique() > 0
    halves = substrings.bands(docs, where=False).toPandas()["half"]
    assert sorted(halves) == sorted(int(b) >> 32 for b in found["band"])


@pytest.mark.parametrize("paired", [1, 64])
def test_all_paragraphs_of_a_band_are_compared(spark, monkeypatch, paired):
    pick = random.Random(31)
    # Sixteen shingles, of which all texts share thirteen: bands of many texts, of which only two each are similar.
    common, texts = prose(pick, 17), []
    for i in range(60):
        texts += [f"{common} u{i} v{i} w{i}", f"{common} u{i} v{i} x{i}"]
    # Runs that repeat make sets of fewer shingles, which are similar across sizes.
    for i, n in enumerate([3, 13] * 5):
        rest = prose(pick, 13 if n == 3 else 5)
        texts += [f"{' '.join(['again'] * k)} {rest} {prose(pick, 20 - k - len(rest.split()))}".strip() for k in (5, 5, 6, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(substrings, "PAIRED", paired, raising=False)
    links, joined = [], substrings.components
    monkeypatch.setattr(substrings, "components", lambda edges: links.extend(edges.select("a", "b").collect()) or joined(edges))
    substrings.matched_paragraphs(docs).count()

    found = substrings.bands(docs, where=True).where("digest IS NOT NULL").collect()
    sets = {r.digest: {tuple(texts[r.doc_id].split()[r.pos :][i : i + 5]) for i in range(16)} for r in found}
    bands = defaultdict(set)
    for r in found:
        bands[r.band].add(r.digest)
    similar = {(a, b) for ds in bands.values() for a in ds for b in ds if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert {tuple(sorted(link)) for link in links} <= similar
    assert len({(len(sets[a]), len(sets[b])) for a, b in similar}) > 4 and max(map(len, bands.values())) > 50

    def parts(edges):
        root = {d: d for d in sets}
        for a, b in edges:
            old, new = sorted((root[a], root[b]), reverse=True)
            root = {d: new if r == old else r for d, r in root.items()}
        return root

    assert parts(links) == parts(similar)
