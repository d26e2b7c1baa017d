"""Benchmark decontamination over a positional inverted index, in DataFrame functions only.

Postings (document, term, position) of the training texts are stored for the terms that decide: each
window of benchmark words is looked up by its two rarest terms (by their counts in all documents), whose
offset-adjusted lists are intersected. Only documents in which both agree on a place are read
again, and every remaining word of the phrase is compared there. Work thus follows the rarest terms, and
the postings of common words, which no intersection needs, are never moved.

A document is known by (doc_id, hash of its text) inside this module, so rows that repeat an id with
another text stay apart and equal rows share one answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from readsift.llm.common import if_small, lower_ascii
from readsift.session import stage

WINDOW = 13
SMALL_ROWS = 200_000
# Fixed value: every ASCII character but digits and letters parts words. Upper case joins them here
# since it is lowered word by word afterwards.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEY = ("doc_id", "_hash")


def words(text: Column) -> Column:
    """Words of a text, A-Z lowered; null for a null text."""
    return F.transform(F.filter(F.split(text, _BETWEEN), lambda w: w != ""), lower_ascii)


def _raw_words(text: Column) -> Column:
    return F.filter(F.split(text, _BETWEEN), lambda w: w != "")


def _id(docs: DataFrame) -> Column:
    """Null ids become 0: hits depend on the text alone, which the hash stands for."""
    return F.coalesce("doc_id", F.lit("0").cast(docs.schema["doc_id"].dataType))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_id(docs).alias("doc_id"), F.xxhash64("text").alias("_hash"), "text")


def _items(items: DataFrame) -> DataFrame:
    """Distinct items with words, numbered and staged: (no, item, item_words). Items without an id or words say nothing.

    Rows of windows and places carry the number alone; the words of an item are joined once, where they are compared.
    """
    found = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("item_words"))
    distinct = found.where(F.col("item").isNotNull() & (F.size("item_words") > 0)).distinct()
    return stage(distinct.select(F.monotonically_increasing_id().alias("no"), "item", "item_words"), "items")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Positional index of the documents (doc_id, _hash, text) for the given terms: rows (doc_id, _hash,
    term, pos), positions from 0. A document's postings are made where it lies, without a shuffle."""
    each = docs.select(*_KEY, F.posexplode(_raw_words(F.col("text"))).alias("pos", "term"))
    return each.withColumn("term", lower_ascii(F.col("term"))).join(if_small(terms, SMALL_ROWS), "term")


def _rarest_pairs(items: DataFrame, counts: DataFrame, size: int, whole: bool = True) -> DataFrame:
    """The two rarest places of every window, as distinct rows (no, p0, term, p1, term1).

    A window with a term that no document holds cannot occur and is left out, or without ``whole`` gives the rarest of its
    other terms; one of a single word has no second place. Every word names the windows it stands in, so an item costs
    ``size`` short rows a word."""
    each = items.select("no", F.size("item_words").alias("_words"), F.posexplode("item_words").alias("p", "term"))
    last = F.greatest(F.col("_words") - size, F.lit(0))
    starts = F.sequence(F.greatest(F.col("p") - size + 1, F.lit(0)), F.least(F.col("p"), last))
    window = Window.partitionBy("no", "start")
    ranked = (
        each.select("no", "p", "term", F.explode(starts).alias("start"))
        .join(counts, "term", "left" if whole else "inner")
        .withColumn("_known", F.count("n").over(window) == F.count(F.lit(1)).over(window))
        .where("_known")
        .withColumn("_rank", F.row_number().over(window.orderBy("n", "p")))
        .where("_rank <= 2")
    )
    first = lambda c, r: F.max(F.when(F.col("_rank") == r, F.col(c)))
    return ranked.groupBy("no", "start").agg(
        first("p", 1).alias("p0"), first("term", 1).alias("term"), first("p", 2).alias("p1"), first("term", 2).alias("term1")
    ).drop("start").distinct()


def _terms_of(pairs: DataFrame, *keys: str) -> DataFrame:
    both = pairs.select(*keys, "term").union(pairs.select(*keys, F.col("term1")))
    return both.where("term IS NOT NULL").distinct()


class Index:
    """Postings of the documents for the terms that decide, exactly and nearby: staged once for both kinds of match."""

    def __init__(self, docs: DataFrame, items: DataFrame, size: int = WINDOW):
        self.docs, self.items, self.size = _keyed(docs), _items(items), size
        terms = stage(self.items.select(F.explode("item_words").alias("term")).distinct(), "terms")
        counts = stage(postings(self.docs, terms).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
        self.pairs = stage(_rarest_pairs(self.items, counts, size), "rarest")
        #: (no, term) of the rarest terms that documents hold, of each window two.
        self.rare = stage(_terms_of(_rarest_pairs(self.items, counts, size, whole=False), "no"), "rare-terms")
        # A window all of whose terms occur has the same rarest ones either way, so these are all anchors.
        anchors = stage(self.rare.select("term").distinct(), "anchors")
        self.postings = stage(postings(self.docs, anchors), "postings")


def _runs(size: int) -> Column:
    """Stretches [first, last] of item positions whose words stand in ``words`` from ``place`` on, each as long as
    a window at least."""
    n = F.size("item_words")
    needed = F.least(n, F.lit(size))

    def step(state: Column, i: Column) -> Column:
        at = F.col("place") + i
        same = (at >= 0) & (i < n) & F.coalesce(F.get("words", at) == F.get("item_words", i), F.lit(False))
        ends = ~same & (state["since"] >= 0) & (i - state["since"] >= needed)
        return F.struct(
            F.when(same & (state["since"] < 0), i).when(same, state["since"]).otherwise(F.lit(-1)).alias("since"),
            F.when(ends, F.concat(state["runs"], F.array(F.struct(state["since"].alias("first"), (i - 1).alias("last")))))
            .otherwise(state["runs"]).alias("runs"),
        )

    start = F.struct(F.lit(-1).alias("since"), F.expr("CAST(array() AS array<struct<first:int,last:int>>)").alias("runs"))
    return F.aggregate(F.sequence(F.lit(0), n), start, step, lambda s: s["runs"])


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, index: Index | None = None) -> DataFrame:
    """Exact occurrences of benchmark phrases: rows (doc_id, _hash, item, first, last), the document words
    first..last (from 0) being a stretch of the item's words that spans ``size`` of them, or the whole item if
    it is shorter.

    ``docs`` has doc_id and text, ``items`` item_id and text. Null texts and texts without words match
    nothing; repeated rows give one answer; either table may be empty; items may be long. ``index`` is one made of the
    same tables and size.
    """
    index = index or Index(docs, items, size)
    first = index.postings.join(if_small(index.pairs, SMALL_ROWS), "term").select(
        *_KEY, "no", (F.col("pos") - F.col("p0")).alias("place"),
        (F.col("pos") - F.col("p0") + F.col("p1")).alias("pos"), F.col("term1").alias("term"),
    )
    both = first.where("term IS NOT NULL").join(index.postings, [*_KEY, "pos", "term"], "left_semi")
    single = first.where("term IS NULL")
    kept = [*_KEY, "no", "place"]
    places = stage(both.select(kept).union(single.select(kept)).distinct(), "places")

    wanted = stage(places.select(*_KEY).distinct(), "candidates")
    read_again = (
        index.docs.join(if_small(wanted, SMALL_ROWS), list(_KEY), "left_semi").dropDuplicates(list(_KEY))
        .select(*_KEY, words(F.col("text")).alias("words"))
    )
    return (
        places.join(read_again, list(_KEY)).join(index.items, "no")
        .select(*_KEY, "item", "place", F.explode(_runs(size)).alias("run"))
        .select(*_KEY, "item", (F.col("place") + F.col("run.first")).alias("first"), (F.col("place") + F.col("run.last")).alias("last"))
        .distinct()
    )


def proximity_matches(docs: DataFrame, items: DataFrame, within: int, at_least: int = 2, index: Index | None = None) -> DataFrame:
    """Places where rare words of an item stand close together in any order: rows (doc_id, _hash, item, block,
    n_terms), for stretches of ``2 * within`` words, half overlapping, that hold ``at_least`` different ones of the
    item's rarest terms (of each window the two rarest that documents hold). Same rules for nulls and repeats as
    :func:`phrase_matches`."""
    index = index or Index(docs, items)
    block = F.floor(F.col("pos") / within)
    near = index.postings.distinct().withColumn("block", F.explode(F.array(block - 1, block)))
    rare = index.rare.join(index.items.select("no", "item"), "no").select("item", "term").distinct()
    return (
        near.join(if_small(stage(rare, "rare-terms"), SMALL_ROWS), "term").groupBy(*_KEY, "item", "block")
        .agg(F.countDistinct("term").alias("n_terms")).where(F.col("n_terms") >= at_least)
    )


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, near: tuple[int, int] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, _hash, n_words, n_hit (words inside any matched window), n_items, items_sha256
    (of the matched item ids, sorted and comma-joined) and contaminated (at least one word in 20 hit).

    With ``near``, (within, at_least) of :func:`proximity_matches`, also n_near: the items of which rare words stand close
    together somewhere, reworded ones included; it does not touch the verdict.

    Null and empty texts have no words and are clean. Every row has its row in the result, repeats too.
    """
    index = Index(docs, items, size)
    runs = stage(phrase_matches(docs, items, size, index), "phrases")
    before = Window.partitionBy(*_KEY).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("last").over(before), F.lit(-1))
    hits = (
        runs.select(*_KEY, "first", "last").distinct()
        .withColumn("_new", F.greatest(F.col("last") - F.greatest(F.col("first") - 1, reached), F.lit(0)))
        .groupBy(*_KEY).agg(F.sum("_new").alias("n_hit"))
    )
    found = runs.groupBy(*_KEY).agg(F.array_sort(F.collect_set("item")).alias("_found"))
    per_doc = hits.join(found, list(_KEY))
    if near is not None:
        close = proximity_matches(docs, items, *near, index).groupBy(*_KEY).agg(F.countDistinct("item").alias("n_near"))
        per_doc = per_doc.join(close, list(_KEY), "full")
    per_doc = stage(per_doc, "hits")
    counted = docs.select(
        "doc_id", _id(docs).alias("_id"), F.xxhash64("text").alias("_hash"), F.coalesce(F.size(_raw_words(F.coalesce("text", F.lit("")))), F.lit(0)).cast("bigint").alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return (
        counted.join(if_small(per_doc.withColumnRenamed("doc_id", "_id"), SMALL_ROWS), ["_id", "_hash"], "left")
        .select(
            "doc_id", "_hash", "n_words", n_hit.alias("n_hit"),
            F.coalesce(F.size("_found"), F.lit(0)).cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", F.coalesce("_found", F.array().cast("array<string>"))), 256).alias("items_sha256"),
            *([F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near")] if near is not None else []),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, in their own columns, that are not contaminated."""
    judged = contamination(docs.select("doc_id", "text"), items, size).where("contaminated")
    bad = stage(judged.select(_id(docs).alias("_id"), "_hash").distinct(), "contaminated")
    packed = docs.select(_id(docs).alias("_id"), F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("_row"))
    return packed.join(if_small(bad, SMALL_ROWS), ["_id", "_hash"], "left_anti").select("_row.*")
