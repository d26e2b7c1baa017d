"""Language of a text by unigram models over a fixed public vocabulary, summed over all segmentations.

A word (a run of letters, lower-cased, with the vocabulary's word mark before it) can be cut into pieces of the
vocabulary in many ways; a character that is no piece is spelt by its UTF-8 bytes, which are pieces too. A language
gives every piece a probability, a segmentation the product over its pieces, and the word the sum over all its
segmentations, which a forward pass along the word takes for all languages at once. Pieces never cross words, so a
text's probability is the product over its words, and a word met again costs a lookup.

The probabilities are learnt by expectation and maximisation from the words of all labelled training texts: expected
counts of pieces under the last model, summed exactly in millionths, so that no partitioning changes the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from readsift.llm.common import tasks_for
from readsift.session import stage

FOLDS = 5
#: Letters of a run that are read as one word; a longer run is read as several.
LONGEST = 64
#: Code points of a text that are in work at once.
SLICE = 1 << 20
UNKNOWN = "und"
_STORE = 1 << 18  # words whose probabilities a task remembers
_UNITS = 1_000_000
_MARK = "▁"
# Texts within Latin-1 are folded to lower-case letters and spaces by one table; it holds no marks.
_FOLDED = "".join(c.lower() if c.isalpha() else " " for c in map(chr, range(256))).encode("latin-1")
_WORD, _NO_LETTER = regex.compile(r"\p{L}[\p{L}\p{M}]*"), regex.compile(r"[^\p{L}\p{M}]")


def _words(text: str) -> list[str]:
    try:
        return text.encode("latin-1").translate(_FOLDED).decode("latin-1").split()
    except UnicodeEncodeError:
        return _WORD.findall(text.lower())


def word_lists(text: str | None, piece: int = SLICE) -> Iterator[list[str]]:
    """Words of a text in lists of bounded size; none of null."""
    text, at = text or "", 0
    while at < len(text):
        stop = _NO_LETTER.search(text, at + piece)
        end = stop.start() if stop else len(text)
        words = _words(text[at:end])
        if words and max(map(len, words)) > LONGEST:
            words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
        yield words
        at = end


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, of a polynomial hash modulo 2 ** 64


@dataclass(frozen=True)
class Pieces:
    """Pieces that words can be made of, letters behind an optional word mark, by their length: sorted 64-bit hashes and
    the pieces' numbers. The 256 bytes are numbered behind them, from ``first_byte``."""

    by_length: tuple[tuple[np.ndarray, np.ndarray], ...]
    first_byte: int

    @classmethod
    def of(cls, model_file: str) -> "Pieces":
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        inside = regex.compile(rf"{_MARK}?[\p{{L}}\p{{M}}]*")
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        return cls.named([n for n in names if inside.fullmatch(n)])

    @classmethod
    def named(cls, names: list[str]) -> "Pieces":
        """Pieces numbered as listed."""
        tables = []
        for length in range(1, max(map(len, names), default=1) + 1):
            own = [(n, i) for i, n in enumerate(names) if len(n) == length]
            letters = _points("".join(n for n, _ in own)).reshape(len(own), length)
            hashes = np.zeros(len(own), np.uint64)
            for column in letters.T:
                hashes = hashes * _BASE + column
            order = np.argsort(hashes)
            tables.append((hashes[order], np.array([i for _, i in own], np.int64)[order]))
        return cls(tuple(tables), len(names))

    def __len__(self) -> int:
        return self.first_byte + 256


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Lattice:
    """All ways to cut some words into pieces, as edges from one place of a word to a later one, ordered by their ends.

    Pieces are looked up for all places of all words at once, length by length, by rolling hashes. A character that is
    no piece is an edge of all its bytes.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        joined = "".join(_MARK + w for w in words)
        points = _points(joined)
        self.words, self.lengths = len(words), np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        of_word = np.repeat(np.arange(self.words), self.lengths)
        place = np.arange(len(points)) - (np.cumsum(self.lengths) - self.lengths)[of_word]
        left = self.lengths[of_word] - place  # characters from here to the word's end
        at, hashes = np.arange(len(points)), np.zeros(len(points), np.uint64)
        starts, sizes, numbers, extra = [], [], [], []
        for length, (known, number) in enumerate(pieces.by_length, 1):
            inside = left[at] >= length
            at, hashes = at[inside], hashes[inside] * _BASE + points[at[inside] + length - 1]
            slot = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            hit = known[slot] == hashes if len(known) else np.zeros(len(at), bool)
            starts.append(at[hit])
            numbers.append(number[slot[hit]])
            sizes.append(np.full(len(starts[-1]), length))
            if length == 1 and not hit.all():
                spelt = at[~hit]
                codes = [joined[i].encode("utf-8", "surrogatepass") for i in spelt]
                extra = list(zip(spelt, codes))
                starts.append(spelt)
                numbers.append(pieces.first_byte + np.array([c[0] for c in codes], np.int64))
                sizes.append(np.ones(len(spelt), np.int64))
        start, size, piece = map(np.concatenate, (starts, sizes, numbers))
        word, end = of_word[start], place[start] + size
        order = np.lexsort((word, end))
        self.word, self.start, self.end, self.piece = word[order], place[start][order], end[order], piece[order]
        self.more_edge = self.more_piece = np.zeros(0, np.int64)
        if extra:
            # Where each spelt character's edge went, to give it the rest of its bytes.
            edge_of = np.full(len(points), -1)
            one = size[order] == 1
            edge_of[start[order][one]] = np.flatnonzero(one)
            rest = [(edge_of[i], pieces.first_byte + b) for i, code in extra for b in code[1:]]
            self.more_edge, self.more_piece = np.array(rest, np.int64).reshape(-1, 2).T
        # Edges of end j are those from bounds[j] to bounds[j + 1].
        self.longest = int(self.lengths.max(initial=0))
        self.bounds = np.searchsorted(self.end, np.arange(self.longest + 2))

    def costs(self, logs: np.ndarray, column: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each edge: under every language, or under that of its word (``column`` per word)."""
        if column is None:
            made = logs[self.piece]
            np.add.at(made, self.more_edge, logs[self.more_piece])
            return made
        own = column[self.word]
        made = logs[self.piece, own]
        np.add.at(made, self.more_edge, logs[self.more_piece, own[self.more_edge]])
        return made[:, None]

    def forward(self, costs: np.ndarray) -> np.ndarray:
        """Log of the summed probability of all ways to each place, (place, word, language)."""
        alpha = np.full((self.longest + 1, self.words, costs.shape[1]), -np.inf)
        alpha[0] = 0.0
        for j in range(1, self.longest + 1):
            edges = slice(self.bounds[j], self.bounds[j + 1])
            word = self.word[edges]
            ways = alpha[self.start[edges], word] + costs[edges]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            most = np.maximum.reduceat(ways, first)
            ways = np.exp(ways - np.repeat(most, np.diff(first, append=len(word)), axis=0))
            alpha[j, word[first]] = most + np.log(np.add.reduceat(ways, first))
        return alpha

    def totals(self, alpha: np.ndarray) -> np.ndarray:
        """Log probability of each word, summed over its segmentations."""
        return alpha[self.lengths, np.arange(self.words)]

    def shares(self, costs: np.ndarray) -> np.ndarray:
        """Expected uses of each edge, from forward and backward probabilities."""
        alpha = self.forward(costs)
        beta = np.full_like(alpha, -np.inf)
        beta[self.lengths, np.arange(self.words)] = 0.0
        for j in range(self.longest, 0, -1):
            edges = slice(self.bounds[j], self.bounds[j + 1])
            at = (self.start[edges], self.word[edges])  # no two edges of one end share both
            beta[at] = np.logaddexp(beta[at], costs[edges] + beta[j, self.word[edges]])
        whole = self.totals(alpha)[self.word]
        return np.exp(alpha[self.start, self.word] + costs + beta[self.end, self.word] - whole)


def _chunk(languages: int) -> int:
    """Words that go through one lattice, so that its table stays below 32 MB."""
    return max(16, min(4096, 4_000_000 // ((LONGEST + 2) * languages)))


@dataclass(frozen=True)
class Model:
    """``logs``: log probability by (piece, language); ``prior``: log share of each language. Its size follows from the
    vocabulary and the number of languages, not from the corpus."""

    languages: list[str]
    pieces: Pieces
    logs: np.ndarray
    prior: np.ndarray


class _WordScores(dict):
    """Word to a row of log probabilities; forgets all when full, between texts' slices."""

    def __init__(self, model: Model):
        self._model, self._rows = model, np.zeros((0, len(model.languages)))

    def _learn(self, words: list[str]) -> None:
        pieces, logs = self._model.pieces, self._model.logs
        found, chunk = [self._rows[: len(self)]], _chunk(logs.shape[1])
        for at in range(0, len(words), chunk):
            lattice = Lattice(pieces, words[at : at + chunk])
            found.append(lattice.totals(lattice.forward(lattice.costs(logs))))
        self._rows = np.concatenate(found)
        self.update(zip(words, range(len(self), len(self) + len(words))))

    def know(self, words: set[str]) -> None:
        """Make room for the words of a batch, all new ones in one go."""
        if len(self) > _STORE:
            self.clear()
        new = [w for w in words if w not in self]
        if new:
            self._learn(new)

    def total(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self._rows[at].sum(axis=0)


def held_out(doc_id: Column) -> Column:
    """The fold from which nothing is learnt; null ids are outside it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts of (lang, text); a task adds up before anything is shuffled."""

    def frame(counts: dict[str, Counter]) -> pd.DataFrame:
        rows = [(lang, word, n) for lang, words in counts.items() for word, n in words.items()]
        return pd.DataFrame(rows, columns=["lang", "word", "n"])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                own = counts.setdefault(lang, Counter())
                for words in word_lists(text):
                    own.update(words)
                    if len(own) > _STORE:
                        yield frame({lang: own})
                        own.clear()
            if sum(map(len, counts.values())) > _STORE:
                yield frame(counts)
                counts.clear()
        yield frame(counts)

    parts = labelled.select("lang", "text").mapInPandas(counted, "lang string, word string, n long")
    # As many tasks as the session shuffles to, however few bytes: each word costs a pass over its lattice.
    return parts.repartition(tasks_for(parts), "lang", "word").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _maximised(counts: dict[str, dict[int, int]], languages: list[str], pieces: Pieces, smoothing: float) -> np.ndarray:
    table = np.full((len(pieces), len(languages)), smoothing)
    for at, lang in enumerate(languages):
        for piece, units in counts.get(lang, {}).items():
            table[piece, at] += units / _UNITS
    return np.log(table / table.sum(axis=0))


def train(docs: DataFrame, model_file: str, rounds: int = 2, smoothing: float = 0.1) -> Model | None:
    """Learn from the texts and languages of the training folds of (doc_id, text, lang); None without any.

    Rows with a null language or text say nothing. All words of all remaining rows count.
    """
    fold = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text"
    )
    shares = {r["lang"]: r["n"] for r in fold.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return None
    languages, pieces = sorted(shares), Pieces.of(model_file)
    words = stage(word_counts(fold), "language-words")
    logs = np.full((len(pieces), len(languages)), -np.log(len(pieces)))
    for _ in range(rounds):
        found = words.mapInPandas(_expectation(pieces, languages, logs), "lang string, piece int, units long")
        counts: dict[str, dict[int, int]] = {}
        for r in found.groupBy("lang", "piece").agg(F.sum("units").alias("units")).toLocalIterator():
            counts.setdefault(r["lang"], {})[r["piece"]] = r["units"]
        logs = _maximised(counts, languages, pieces, smoothing)
    prior = np.log(np.array([shares[lang] for lang in languages], float) / sum(shares.values()))
    return Model(languages, pieces, logs, prior)


def _expectation(pieces: Pieces, languages: list[str], logs: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column_of = {lang: i for i, lang in enumerate(languages)}
        totals, size = np.zeros(logs.shape, np.int64), _chunk(1)

        def add(rows: list[tuple[str, str, int]]) -> None:
            lattice = Lattice(pieces, [word for _, word, _ in rows])
            column = np.array([column_of[lang] for lang, _, _ in rows])
            n = np.array([n for _, _, n in rows], np.int64)
            # Rounded edge by edge, so that the sum has no order.
            units = np.rint(lattice.shares(lattice.costs(logs, column))[:, 0] * _UNITS).astype(np.int64) * n[lattice.word]
            own = column[lattice.word]
            np.add.at(totals, (lattice.piece, own), units)
            np.add.at(totals, (lattice.more_piece, own[lattice.more_edge]), units[lattice.more_edge])

        waiting: list[tuple[str, str, int]] = []
        for batch in batches:
            waiting += zip(batch["lang"], batch["word"], batch["n"])
            while len(waiting) >= size:
                add(waiting[:size])
                del waiting[:size]
        if waiting:
            add(waiting)
        piece, column = np.nonzero(totals)
        yield pd.DataFrame({"lang": [languages[c] for c in column], "piece": piece.astype(np.int32), "units": totals[piece, column]})

    return run


def _judged(scores: _WordScores | None, model: Model | None, texts: pd.Series) -> Iterator[tuple[str, float]]:
    if model is None:
        yield from [(UNKNOWN, 0.0)] * len(texts)
        return
    totals: list[np.ndarray | None] = [None] * len(texts)
    waiting: list[tuple[int, list[str]]] = []

    def settle() -> None:
        # New words of many texts go through one lattice.
        scores.know({word for _, words in waiting for word in words})
        for at, words in waiting:
            totals[at] = scores.total(words) + (model.prior if totals[at] is None else totals[at])
        waiting.clear()

    held = 0
    for at, text in enumerate(texts):
        for words in word_lists(text):
            if words:
                waiting.append((at, words))
                held += len(words)
            if held > SLICE:
                settle()
                held = 0
    settle()
    for total in totals:
        if total is None:
            yield UNKNOWN, 0.0
        else:
            best = int(total.argmax())
            yield model.languages[best], float(1 / np.exp(total - total[best]).sum())


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, the probability of that language among the learnt ones.

    A null text, one without a letter, and any text without a model are ``und`` with score 0. Of equal languages the
    first by name is taken. Every row keeps its row, columns called like the two are replaced, and an empty table
    gives none.
    """
    kept = docs.drop(*[c for c in ("lang_pred", "score") if c != text_col])

    @F.pandas_udf("lang_pred string, score double")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = _WordScores(model) if model is not None else None
        for batch in texts:
            yield pd.DataFrame(list(_judged(scores, model, batch)), columns=["lang_pred", "score"])

    made = kept.withColumn("_found", found(F.col(text_col)))
    return made.withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")
