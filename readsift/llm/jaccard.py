"""N-gram Jaccard join by prefix filters under several global token orders.

If two shingle sets have a Jaccard similarity of t, then under *any* order of all shingles the first
``n - ceil(t n) + 1`` shingles of both meet, and of the smaller one already the first
``n - ceil(2 t n / (1 + t)) + 1`` do. Each order is a filter of its own; a pair is compared
only if it passes all of them:

* the first order puts shingles that many documents hold last (else by hash), so the lists of
  documents that share a prefix shingle are short; it makes the candidates;
* further orders, by other hashes, are checked on the candidates before any text is moved.

Which shingles are common is counted over all documents. The choice only bends the first order, never
the result: any order is exact.

Equal sets are one node throughout. Lists are first linked to one of their documents each, the links
found make components, and only lists that still span several components are then paired out, and only
across components; a group of near copies thus costs links in its size, not in its square.

Documents of long lists that are like one of their group, its centre, but not all linked with it, are paired by what the centre
lacks: if x does not link with the centre and y is no smaller than it, then x and y are only similar if they share a shingle
outside of the centre, as what they share inside is no more than x and the centre do. See :func:`_around_centres`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from readsift.llm import shingles
from readsift.llm.common import components, if_small
from readsift.session import stage

SHINGLE = 5
PERCENT = 80
SMALL_ROWS = 200_000
#: Held by so many documents, a shingle is common ...
COMMON = 16
#: ... unless more than this many are; then only the most frequent ones are. Sent to all tasks (4 bytes each).
MAX_COMMON = 500_000
_ORDERS = (np.uint64(0x51ED2701A3C5E98B), np.uint64(0xD6E8FEB86659FD93))  # seeds of the further orders
STAR_ROUNDS = 3
#: A list that still spans several components is long from so many documents on.
LONG_LIST = 64


def _needed(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any similar one, at least."""
    return -(-percent * n // 100)


def _top(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(32)).astype(np.uint32)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int32)


def set_digests(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, _hash, n_shingles, d1, d2): set size and a 128-bit digest of the set, nulls for empty sets."""
    import xxhash

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, halves = [], []
            for found in shingles.shingle_sets(batch["text"], size):
                sizes.append(len(found))
                halves.append(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), ">i8") if len(found) else (None, None))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "_hash": batch["_hash"], "n_shingles": sizes,
                "d1": pd.array([h[0] for h in halves], "Int64"), "d2": pd.array([h[1] for h in halves], "Int64"),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(digested, f"doc_id {kind}, _hash bigint, n_shingles bigint, d1 bigint, d2 bigint")


def _counts(docs: DataFrame, size: int) -> DataFrame:
    """Shingles (upper half of their hash) that several documents hold: (token, n)."""

    def each_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(_top(s)) for s in shingles.shingle_sets(batch["text"], size)]
            tokens, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
            yield pd.DataFrame({"token": _signed(tokens), "n": n})

    # Counted per batch: most shingles are in one document, so a table of them per task would only take memory.
    each = docs.select("text").mapInPandas(each_once, "token int, n bigint").repartition("token")
    return each.groupBy("token").agg(F.sum("n").alias("n")).where("n >= 2")


def _common(counts: DataFrame) -> np.ndarray:
    """The common shingles, sorted; at most ``MAX_COMMON`` numbers come to the driver."""
    rows = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "token").limit(MAX_COMMON).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int32).view(np.uint32))


def _common_last(found: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Shingles in the first order: the common ones last, else by hash."""
    if not len(often) or not len(found):
        return found
    top = _top(found)
    is_common = often[np.minimum(np.searchsorted(often, top), len(often) - 1)] == top
    return np.concatenate([found[~is_common], found[is_common]])


def _prefixes(docs: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """Rows (doc_id, n, first array<bigint>, further array<array<int>>): prefixes under all orders."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = sent.value
        for batch in batches:
            rows = []
            for doc, found in zip(batch["doc_id"], shingles.shingle_sets(batch["text"], size)):
                n = len(found)
                if not n:
                    continue
                length = n - _needed(n, percent) + 1
                first = _common_last(found, often)[:length]
                further = [_signed(_top(np.sort(shingles.mix(found ^ seed))[:length])) for seed in _ORDERS]
                rows.append((doc, n, first.view(np.int64), further))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "first", "further"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        cut, f"doc_id {kind}, n int, first array<bigint>, further array<array<int>>"
    )


def _verified(pairs: DataFrame, prefixes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) with a flag ``linked``: whether they pass every further order and the exact comparison."""

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for x, y in zip(shingles.shingle_sets(batch["a_text"], size), shingles.shingle_sets(batch["b_text"], size)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch[["a", "b"]].assign(linked=linked)

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.withColumnsRenamed({c: name if c == "doc_id" else f"{name}_{c}" for c in frame.columns})

    orders = prefixes.select("doc_id", "further")
    hopeful = pairs.join(side(orders, "a"), "a").join(side(orders, "b"), "b")
    for i in range(len(_ORDERS)):
        hopeful = hopeful.where(F.arrays_overlap(F.col("a_further")[i], F.col("b_further")[i]))
    hopeful = stage(hopeful.select("a", "b"), "hopeful-pairs")
    named = stage(hopeful.select(F.col("a").alias("doc_id")).union(hopeful.select("b")).distinct(), "paired")
    texts = docs.select("doc_id", "text").join(if_small(named, SMALL_ROWS), "doc_id", "left_semi")
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = hopeful.join(side(texts, "a"), "a").join(side(texts, "b"), "b")
    return stage(read.mapInPandas(compared, f"a {kind}, b {kind}, linked boolean").where("linked").select("a", "b").distinct(), "links")


def _components_of(links: DataFrame | None, lists: DataFrame) -> DataFrame:
    """``lists`` with each document's component so far."""
    if links is None:
        return lists.withColumn("component", F.col("doc_id"))
    labels = components(links).withColumnRenamed("node", "doc_id")
    return lists.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _open_lists(lists: DataFrame) -> DataFrame:
    """Per shingle whose documents lie in several components: its first and its last component, and the
    first document of the first one."""
    return (
        lists.groupBy("token")
        .agg(F.min(F.struct("component", "doc_id")).alias("head"), F.max("component").alias("other"))
        .where("head.component <> other")
    )


def _pair(x, y) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _centres(open_lists: DataFrame, links: DataFrame, long_list: int) -> DataFrame:
    """Rows (doc_id, centre) for documents of long lists: of the lists' documents with the most links so far, the one that
    most of a document's long lists name."""
    long = open_lists.groupBy("token").agg(F.count(F.lit(1)).alias("_in")).where(F.col("_in") >= long_list).select("token")
    entries = stage(open_lists.select("token", "doc_id").join(long, "token", "left_semi"), "long-lists")
    ends = links.select(F.col("a").alias("doc_id")).unionByName(links.select(F.col("b").alias("doc_id")))
    degrees = ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_links"))
    rated = entries.join(degrees, "doc_id", "left").withColumn("_links", F.coalesce("_links", F.lit(0)))
    best = rated.groupBy("token").agg(F.max(F.struct("_links", "doc_id")).alias("_best")).select("token", F.col("_best.doc_id").alias("centre"))
    votes = entries.join(best, "token").groupBy("doc_id", "centre").agg(F.count(F.lit(1)).alias("_n"))
    return votes.groupBy("doc_id").agg(F.max(F.struct("_n", "centre")).alias("_best")).select("doc_id", F.col("_best.centre").alias("centre"))


def _around_centres(centres: DataFrame, texts: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """Rows (doc_id, centre, n, linked, outside array<bigint>) for the documents of ``centres`` that are no smaller than their
    centre and at least half as similar to it as asked for. ``linked`` says whether they link with it; ``outside`` is a prefix
    of the shingles that the centre h lacks.

    Let x and y be two of them, x not linked with h, and f = percent / (100 + percent). If they link, they share f (n_x + n_y)
    shingles, of which at most c_x, those that x shares with h, are in h, and c_x < f (n_x + n_h). So outside of h they share more than
    f (n_y - n_h), which is not negative, and at least f (n_x + n_h) - c_x, as n_y is n_h or more. Of so many shared shingles one is in the prefix of
    either under any order. Documents of several texts are left out.
    """
    sent = centres.sparkSession.sparkContext.broadcast(common)
    columns = ["doc_id", "centre", "n", "linked", "outside"]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = sent.value
        for batch in batches:
            rows = []
            own, kept = (shingles.shingle_sets(batch[c], size) for c in ("text", "centre_text"))
            for doc, centre, x, h in zip(batch["doc_id"], batch["centre"], own, kept):
                n, both = len(x), len(np.intersect1d(x, h, assume_unique=True))
                if n < len(h) or 200 * both < percent * (n + len(h) - both):
                    continue
                linked = 100 * both >= percent * (n + len(h) - both)
                shared = percent * (n - len(h)) // (100 + percent) + 1 if linked else -(-percent * (n + len(h)) // (100 + percent)) - both
                outside = _common_last(np.setdiff1d(x, h, assume_unique=True), often)
                rows.append((doc, centre, n, linked, outside[: max(len(outside) - shared + 1, 0)].view(np.int64)))
            yield pd.DataFrame(rows, columns=columns)

    named = stage(centres.select("doc_id").union(centres.select("centre")).distinct(), "grouped")
    read = texts.select("doc_id", "text").join(if_small(named, SMALL_ROWS), "doc_id", "left_semi")
    read = read.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("text").alias("_last")).where("text = _last").drop("_last")
    kind = texts.schema["doc_id"].dataType.simpleString()
    both = centres.join(read, "doc_id").join(read.withColumnsRenamed({"doc_id": "centre", "text": "centre_text"}), "centre")
    return both.mapInPandas(compared, f"doc_id {kind}, centre {kind}, n int, linked boolean, outside array<bigint>")


def _merged(lists: DataFrame, links: DataFrame) -> DataFrame:
    """``lists`` with the components that more ``links`` between its documents join."""
    labels = stage(lists.select("doc_id", "component").distinct(), "labels")
    ends = links.select("a", "b")
    for side in ("a", "b"):
        ends = ends.join(labels.select(F.col("doc_id").alias(side), F.col("component").alias(f"_{side}")), side)
    roots = components(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).select(
        F.col("node").alias("component"), F.col("component").alias("_root")
    )
    joined = lists.join(roots, "component", "left")
    return stage(joined.withColumn("component", F.coalesce("_root", "component")).drop("_root"), "lists-now")


def _across(lists: DataFrame, keys: list[str], same: str, alike) -> DataFrame:
    """Pairs (a, b) of the rows of each list, named by ``keys``, that lie in several classes (``same``) and components and
    are ``alike``, a condition on the columns of both (those of one begin with ``x_``). The largest class of a list is only
    met by the others."""
    size_of = lists.groupBy(*keys, same).agg(F.count(F.lit(1)).alias("_in"))
    largest = size_of.groupBy(*keys).agg(F.max(F.struct("_in", same)).alias("_largest"))
    side = lists.join(largest, keys).where(F.col(same) != F.col(f"_largest.{same}")).drop("_largest")
    side = side.withColumnsRenamed({c: f"x_{c}" for c in lists.columns if c not in keys})
    apart = (F.col("component") != F.col("x_component")) & (F.col(same) != F.col(f"x_{same}"))
    return lists.join(side, keys).where(alike & apart).select(*_pair("doc_id", "x_doc_id")).distinct()


def similar_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, texts: DataFrame | None = None) -> DataFrame:
    """Links between documents whose sets differ: enough rows (a, b), a < b, to connect every two documents that a
    chain of similar pairs connects. ``docs`` has doc_id and text, one row for each set. Pairs read their texts from
    ``texts``, if given: it holds all rows of ``docs`` and may hold more."""
    texts = docs if texts is None else texts
    counts = stage(_counts(docs, size), "shingle-counts")
    common = _common(counts)
    prefixes = stage(_prefixes(docs, common, size, percent), "prefixes")
    postings = prefixes.select("doc_id", "n", F.posexplode("first").alias("_pos", "token"))
    as_smaller = F.col("_pos") <= F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent))
    # A shingle that one document holds has no list.
    postings = postings.select("doc_id", "n", "token", as_smaller.alias("early"), F.shiftright("token", 32).cast("int").alias("_half"))
    shared = postings.join(counts.select(F.col("token").alias("_half")), "_half", "left_semi").drop("_half")
    lists = stage(shared, "lists")

    tried, links = None, None
    for _ in range(STAR_ROUNDS):
        now = stage(_components_of(links, lists), "lists-now")
        heads = _open_lists(now).select("token", F.col("head.component").alias("_head_component"), F.col("head.doc_id").alias("_head"))
        pairs = (
            now.join(heads, "token").where("component <> _head_component")
            .groupBy("doc_id", "_head").agg(F.count(F.lit(1)).alias("_shared"))
            .select(*_pair("doc_id", "_head"), "doc_id", "_shared")
        )
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        # Of a document's heads, the one it shares most with: one comparison a document and round.
        pairs = pairs.groupBy("doc_id").agg(F.max(F.struct("_shared", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
        pairs = stage(pairs, "star-pairs")
        if pairs.isEmpty():
            break
        found = _verified(pairs, prefixes, texts, size, percent)
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)

    now = stage(_components_of(links, lists), "lists-now")
    few = stage(now.join(_open_lists(now).select("token"), "token", "left_semi"), "open-lists")
    grouped = None
    if links is not None:
        centres = stage(_centres(few, links, LONG_LIST), "centres")
        if not centres.isEmpty():
            grouped = stage(_around_centres(centres, texts, common, size, percent), "around-centres")
            met = stage(grouped.where("doc_id <> centre").select(*_pair("doc_id", "centre"), "linked").distinct(), "centre-pairs")
            links, tried = links.unionByName(met.where("linked").select("a", "b")), tried.unionByName(met.select("a", "b"))
            few = _merged(few, met.where("linked"))
            few = stage(few.join(_open_lists(few).select("token"), "token", "left_semi"), "open-lists")

    # Sizes of similar sets differ by the threshold at most, and the smaller set has a shared shingle early.
    alike = 100 * F.least("n", "x_n") >= percent * F.greatest("n", "x_n")
    early = F.when(F.col("n") < F.col("x_n"), F.col("early")).when(F.col("n") > F.col("x_n"), F.col("x_early"))
    in_prefix = alike & F.coalesce(early, F.col("early") | F.col("x_early"))
    if grouped is None:
        rest = _across(few, ["token"], "component", in_prefix)
    else:
        # Two documents of one centre meet by what it lacks; all others by their prefixes.
        classed = few.join(grouped.select("doc_id", "centre"), "doc_id", "left").withColumn(
            "class", F.struct(F.col("centre").isNotNull().alias("grouped"), F.coalesce("centre", "component").alias("of"))
        )
        labels = few.select("doc_id", "component").distinct()
        outside = grouped.join(labels, "doc_id").select("doc_id", "centre", "n", "component", F.explode("outside").alias("token"))
        rest = _across(stage(classed.drop("centre"), "classed-lists"), ["token"], "class", in_prefix).unionByName(
            _across(stage(outside, "outside-lists"), ["centre", "token"], "component", alike)
        ).distinct()
    if tried is not None:
        rest = rest.join(tried, ["a", "b"], "left_anti")
    rest = stage(rest, "rest-pairs")
    if not rest.isEmpty():
        found = _verified(rest, prefixes, texts, size, percent)
        links = found if links is None else links.unionByName(found)
    return links if links is not None else rest


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, _hash, n_shingles, component_id (smallest doc_id that links reach).

    Two documents link if they share ``percent`` of the union of their ``size``-word shingles, at least. A text of
    fewer words is one shingle; null texts and texts without words have none and link with nothing. Equal texts
    link (if they have words). Rows that repeat a doc_id are one node, whichever texts they hold, and each keeps its row; rows with a
    null doc_id stay alone and have a null component. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text").withColumn("_hash", F.xxhash64("text"))
    sets = stage(set_digests(docs, size), "shingle-sets")
    known = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("_first"))
    copies = stage(known.join(first, ["d1", "d2"]).where("doc_id <> _first").select("doc_id", "_hash", "_first"), "copies")
    single = docs.where("doc_id IS NOT NULL").join(
        if_small(copies.select("doc_id", "_hash"), SMALL_ROWS), ["doc_id", "_hash"], "left_anti"
    )
    # A copy's text links its document to what the first one links to, which changes no component; taking the texts
    # from all rows spares the join that leaves the copies out, in every comparison.
    links = similar_sets(single, size, percent, docs)
    edges = links.unionByName(copies.select(F.col("_first").alias("a"), F.col("doc_id").alias("b")))
    labels = components(edges).withColumnRenamed("node", "doc_id")
    return sets.join(labels, "doc_id", "left").select(
        "doc_id", "_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, in their own columns, that stand for their component: those of its smallest doc_id (one,
    if rows repeat it with the same text). Rows without words or id stay."""
    judged = jaccard_components(docs, size, percent).where("n_shingles > 0 AND doc_id <> component_id")
    gone = stage(judged.select("doc_id").distinct(), "near-copies")
    packed = docs.select("doc_id", F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("_row"))
    kept = packed.join(if_small(gone, SMALL_ROWS), "doc_id", "left_anti")
    repeats = Window.partitionBy("doc_id", "_hash").orderBy(F.xxhash64("_row"))
    named = kept.where("doc_id IS NOT NULL").withColumn("_n", F.row_number().over(repeats)).where("_n = 1")
    return named.select("_row.*").unionByName(kept.where("doc_id IS NULL").select("_row.*"))
