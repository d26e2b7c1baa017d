"""Token counts by finite-state transducers compiled from a BPE vocabulary.

The transducer reads one character at a time. Its state holds what can still change the
tokens of the text read so far: the suffixes that begin some piece, and for each the last token
before it and how many tokens fewer stood there. A transition carries the change in the number
of tokens, so a text's count is the sum along its path. Two facts make this exact:

* a sequence of pieces is the BPE result iff every piece and every pair of neighbours is the
  result for its own characters (merges within a stretch don't depend on what stands outside
  until one crosses its border), so the last token of each prefix is found from shorter ones;
* where no piece holds two neighbouring characters in a row (for piece models, before every run
  of spaces) the state is reset, whatever was read before.

States are made on demand, as texts reach them, and stay finite in number: suffixes are no
longer than the longest piece.

Texts are cut into chunks. A chunk's map, from the unknown state at its start to count and state at its
end, is (head, body, tail): what stands before its first reset, the tokens from there to the last
reset, and what follows. Maps compose associatively; :func:`compose` does so pairwise, as a scan does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

_SPACE = "▁"  # fixed value: how piece models write a space
_START = 0


class ChunkMap(NamedTuple):
    """``body`` is None where the chunk has no reset; all of it is then in ``head``."""

    head: str
    body: int | None
    tail: str


class _Words(dict):
    """Counts of words between resets, made when first asked for."""

    def __init__(self, run, before: str) -> None:
        super().__init__()
        self._run, self._before = run, before

    def __missing__(self, word: str) -> int:
        count = self[word] = self._run(self._before + word)
        return count


class Transducer:
    """Deterministic, count-annotated automaton of one piece model."""

    def __init__(self, scores: dict[str, float], kept: int = 150_000) -> None:
        self._scores, self._kept = scores, kept
        self._prefixes = {p[:i] for p in scores for i in range(1, len(p))}
        self._bigrams = {p[i : i + 2] for p in scores for i in range(len(p) - 1)}
        joined = {c for b in self._bigrams for c in b}
        # Characters that stop every merge on both sides; one is enough to cut lines.
        self.cuts_at_newline = "\n" not in joined
        self._whole: dict[str, bool] = {}
        self._apart: dict[tuple[str, str], bool] = {}
        self._forget_states()
        self._forget_words()

    @classmethod
    def load(cls, path: str) -> Transducer:
        """Of a sentencepiece BPE model with byte fallback and the identity normaliser."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = (i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
        if not any(model.is_byte(i) for i in ids):
            raise ValueError("only models with byte fallback are compiled")
        scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(_SPACE in p.lstrip(_SPACE) for p in scores):
            raise ValueError("a piece holds a space after another character")
        return cls(scores)

    def _forget_states(self) -> None:
        start = ("", (None,), (0,))
        self._ids: dict[tuple, int] = {start: _START}
        self._states: list[tuple] = [start]
        # Per state: character -> (row of the next state, change in the count); None -> the state.
        self._rows: list[dict] = [{None: _START}]
        self._steps = 0

    def _forget_words(self) -> None:
        self._spaced, self._bare = _Words(self.run, _SPACE), _Words(self.run, "")

    def _merged(self, text: str) -> list[str]:
        """Pieces of a few characters by the plain merge loop."""
        parts, scores = list(text), self._scores
        while True:
            best = max(
                ((scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores),
                default=None,
            )
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _is_piece(self, piece: str) -> bool:
        if piece not in self._whole:
            self._whole[piece] = piece in self._scores and self._merged(piece) == [piece]
        return self._whole[piece]

    def _stay_apart(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        if (a, b) not in self._apart:
            if len(self._apart) > self._kept:
                self._apart.clear()
            self._apart[a, b] = self._merged(a + b) == [a, b]
        return self._apart[a, b]

    def _step(self, state: int, char: str) -> tuple[int, int]:
        """Next state and change in the count. The first suffix of a state is the empty one."""
        longest, last, fewer = self._states[state]
        sizes = [k for k in range(len(longest) + 1) if k == 0 or longest[-k:] in self._prefixes]
        grown = [longest[len(longest) - k :] + char for k in sizes]
        if state != _START and not any(g in self._prefixes or g in self._scores for g in grown[1:]):
            return self._next(_START, char)
        if char not in self._scores:
            return _START, len(char.encode("utf-8", "surrogatepass"))
        for g, t, d in zip(grown, last, fewer):
            if self._is_piece(g) and self._stay_apart(t, g):
                piece, change = g, 1 + d
                break
        else:
            raise AssertionError("no piece ends here")
        alive = [(len(g), g, t, d) for g, t, d in zip(grown, last, fewer) if g in self._prefixes]
        key = (
            alive[-1][1] if alive else "",
            (piece, *(t for _, _, t, _ in alive)),
            (0, *(d - change for _, _, _, d in alive)),
        )
        if not alive:
            key = ("", (None,), (0,))
        found = self._ids.get(key)
        if found is None:
            found = self._ids[key] = len(self._states)
            self._states.append(key)
            self._rows.append({None: found})
        return found, change

    def _next(self, state: int, char: str) -> tuple[int, int]:
        step = self._rows[state].get(char)
        if step is not None:
            return step[0][None], step[1]
        self._steps += 1
        found, change = self._step(state, char)
        self._rows[state][char] = (self._rows[found], change)
        return found, change

    def run(self, text: str) -> int:
        """Tokens of a stretch read from the start state (spaces written as in the model)."""
        if len(self._states) > self._kept or self._steps > 3 * self._kept:
            self._forget_states()
        row, total = self._rows[_START], 0
        for char in text:
            step = row.get(char)
            if step is None:
                self._next(row[None], char)
                step = row[char]
            row = step[0]
            total += step[1]
        return total

    def _line(self, line: str) -> int:
        """Tokens of a line whose start and end are resets. Its words are cached."""
        if len(self._spaced) + len(self._bare) > 3 * self._kept:
            self._forget_words()
        if "  " in line or line[-1:] == " " or _SPACE in line:
            return self.run(line.replace(" ", _SPACE))
        first, *rest = line.split(" ")
        return (self._bare[first] if first else 0) + sum(map(self._spaced.__getitem__, rest))

    def count(self, text: str) -> int:
        """Tokens of a stretch that begins and ends at resets, its spaces as plain spaces."""
        if not self.cuts_at_newline:
            return self._line(text)
        lines = text.split("\n")
        return sum(self._line(x) for x in lines if x) + (len(lines) - 1) * self.run("\n")

    def resets_at(self, text: str, i: int) -> bool:
        """Whether no piece can hold the characters before and at position i."""
        return text[i - 1 : i + 1].replace(" ", _SPACE) not in self._bigrams

    def chunk_map(self, chunk: str) -> ChunkMap:
        first = next((i for i in range(1, len(chunk)) if self.resets_at(chunk, i)), None)
        if first is None:
            return ChunkMap(chunk, None, "")
        final = next(i for i in range(len(chunk) - 1, 0, -1) if self.resets_at(chunk, i))
        return ChunkMap(chunk[:first], self.count(chunk[first:final]), chunk[final:])

    def join(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if not a.head and a.body is None:
            return b
        if not b.head and b.body is None:
            return a
        middle = a.head + b.head if a.body is None else a.tail + b.head
        border = len(a.head) if a.body is None else len(a.tail)
        reset = 0 < border < len(middle) and self.resets_at(middle, border)
        if a.body is None and b.body is None:
            return ChunkMap(a.head, 0, b.head) if reset else ChunkMap(middle, None, "")
        if a.body is None:
            return ChunkMap(a.head, self.count(b.head) + b.body, b.tail) if reset else ChunkMap(middle, b.body, b.tail)
        if b.body is None:
            return ChunkMap(a.head, a.body + self.count(a.tail), b.head) if reset else ChunkMap(a.head, a.body, middle)
        return ChunkMap(a.head, a.body + self.count(middle) + b.body, b.tail)

    def compose(self, maps: list[ChunkMap]) -> ChunkMap:
        """Pairwise, in log(n) levels."""
        while len(maps) > 1:
            pairs = [self.join(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0] if maps else ChunkMap("", None, "")

    def finish(self, whole: ChunkMap) -> int:
        return self.count(whole.head) + (whole.body or 0) + self.count(whole.tail)

    def tokens(self, text: str, chunk: int) -> int:
        """Tokens of a whole text; an empty one has none, others get a space before them."""
        if not text:
            return 0
        text = " " + text
        return self.finish(self.compose([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]))


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per Python worker and model."""
    return Transducer.load(path)


def count_tokens(
    df: DataFrame, model_path: str, text: str = "text", name: str = "n_tokens", chunk: int = 1 << 15
) -> DataFrame:
    """``df`` with the token count of every whole text, as the model's own library counts it without
    begin or end tokens. No shuffle; a task holds one Arrow batch and a bounded store of states.

    Null and empty texts have 0 tokens. A column already called ``name`` is replaced; rows are
    neither merged nor dropped, and an empty table gives none.
    """
    kept = df.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.LongType())])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(model_path)
        for batch in batches:
            yield batch.assign(**{name: [machine.tokens(x, chunk) if isinstance(x, str) else 0 for x in batch[text]]})

    return kept.mapInPandas(counted, schema)


def part_maps(df: DataFrame, model_path: str, key: str, part: str, text: str) -> DataFrame:
    """Chunk maps (key, part, head, body, tail) of texts that are stored in parts, one per row and
    each in whichever task reads it. The first part's text begins with the model's added space."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(model_path)
        for batch in batches:
            maps = [machine.chunk_map((" " if p == 0 else "") + (x or "")) for p, x in zip(batch[part], batch[text])]
            frame = pd.DataFrame(maps, columns=["head", "body", "tail"]).astype({"body": "Int64"})
            yield pd.concat([batch[[key, part]].reset_index(drop=True), frame], axis=1)

    return df.select(key, part, text).mapInPandas(mapped, _maps_schema(df, key, part))


def _maps_schema(df: DataFrame, key: str, part: str) -> T.StructType:
    own = [df.schema[key], T.StructField(part, T.LongType())]
    return T.StructType([*own, *T._parse_datatype_string("head string, body bigint, tail string").fields])


def scan_parts(maps: DataFrame, model_path: str, key: str, part: str, levels: int, fan: int = 64) -> DataFrame:
    """Compose part maps in ``levels`` rounds of ``fan`` neighbours each, so that no task ever holds more
    than ``fan`` maps of a text: rows (key, n_tokens). ``fan ** levels`` must exceed the number of parts
    of any text; a text with more of them raises."""

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        machine, group = transducer(model_path), group.sort_values(part)
        bodies = [None if pd.isna(b) else int(b) for b in group["body"]]
        whole = machine.compose([ChunkMap(*m) for m in zip(group["head"], bodies, group["tail"])])
        row = {key: group[key].iloc[0], part: int(group[part].iloc[0]) // fan, **whole._asdict()}
        return pd.DataFrame([row]).astype({"body": "Int64"})

    schema = _maps_schema(maps, key, part)
    for _ in range(levels):
        grouped = maps.withColumn("_block", F.floor(F.col(part) / fan)).groupBy(key, "_block")
        maps = grouped.applyInPandas(composed, schema)

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(model_path)
        for batch in batches:
            if (batch[part] > 0).any():
                raise ValueError("a text has more parts than the levels compose")
            bodies = [None if pd.isna(b) else int(b) for b in batch["body"]]
            counts = [machine.finish(ChunkMap(*m)) for m in zip(batch["head"], bodies, batch["tail"])]
            yield pd.DataFrame({key: batch[key], "n_tokens": counts})

    return maps.mapInPandas(finished, T.StructType([maps.schema[key], T.StructField("n_tokens", T.LongType())]))
