"""Fill-in-the-middle rows: a text cut at two token boundaries and put together in another order.

A text's token boundaries are kept as a compressed set of offsets, in chunks of 65,536 code points. A chunk is a
sorted array, a bitmap or a list of runs, whichever is smallest, and running totals of the chunks' sizes say which
chunk holds the k-th boundary; a select inside it gives the offset. A long text therefore costs at most one byte in
eight code points, and a cut costs two searches.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

CHUNK = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class SortedArray:
    """Few members: themselves, two bytes each."""

    def __init__(self, low: np.ndarray):
        self._low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self._low[k])


class Bitmap:
    """Many scattered members: one bit per place, with the number of members up to each word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[low] = 1
        self._words = np.packbits(bits, bitorder="little").view("<u8")
        self._totals = np.cumsum(np.bitwise_count(self._words), dtype=np.int64)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self._totals, k, side="right"))
        before = int(self._totals[word - 1]) if word else 0
        inside = np.unpackbits(self._words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(inside)[k - before])


class Runs:
    """Long stretches of members: first member of each, and the number of members before it."""

    def __init__(self, low: np.ndarray):
        first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self._firsts, self._before = low[first].astype(np.uint16), first.astype(np.int32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self._before, k, side="right")) - 1
        return int(self._firsts[run]) + k - int(self._before[run])


def container(low: np.ndarray) -> SortedArray | Bitmap | Runs:
    """The smallest container of sorted numbers below 65,536."""
    runs = int(np.count_nonzero(np.diff(low, prepend=-2) != 1))
    sizes = ((4 * runs, Runs), (2 * len(low), SortedArray), (CHUNK // 8, Bitmap))
    return min(sizes, key=lambda s: s[0])[1](low)


class Boundaries:
    """A growing set of offsets; chunks are added in rising order and hold at least one member each."""

    def __init__(self) -> None:
        self._chunks: list = []
        self._keys: list[int] = []
        self._before = [0]

    def __len__(self) -> int:
        return self._before[-1]

    def add_chunk(self, key: int, low: np.ndarray) -> None:
        if len(low):
            self._chunks.append(container(low))
            self._keys.append(key)
            self._before.append(self._before[-1] + len(low))

    def select(self, k: int) -> int:
        """The k-th smallest member, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(f"no boundary {k} among {len(self)}")
        at = bisect_right(self._before, k) - 1
        return self._keys[at] * CHUNK + self._chunks[at].select(k - self._before[at])


def _letters(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") | 32  # folds the case of A-Z
    return (code >= 97) & (code <= 122)


def token_boundaries(text: str) -> Boundaries:
    """Offsets between the tokens ``[A-Za-z]+|[^A-Za-z]``, both ends of the text included.

    An offset is a boundary unless letters stand on both sides of it. No text holds a single one: 0.
    """
    found = Boundaries()
    for key in range(len(text) // CHUNK + 1):
        start, end = key * CHUNK, min((key + 1) * CHUNK, len(text) + 1)
        inside = np.zeros(end - start + 1, bool)  # the character before each offset of the chunk, and the last one's
        first = max(start - 1, 0)
        seen = _letters(text[first:end])
        inside[first - start + 1 : first - start + 1 + len(seen)] = seen
        found.add_chunk(key, np.flatnonzero(~(inside[:-1] & inside[1:])))
    return found


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "a", "b")]))
def _cuts(text: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Tokens of each text and the offsets of its two cuts."""
    rows = []
    for t, x, y in zip(text, h1, h2):
        found = token_boundaries(t)
        places = len(found)
        low, high = sorted((int(x) % places, int(y) % places))
        rows.append((places - 1, found.select(low), found.select(high)))
    return pd.DataFrame(rows, columns=["n", "a", "b"])


def transform(
    docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", per_cent: int = 90, suffix_first: int = 20
) -> DataFrame:
    """``docs`` with n (tokens), form, output, prefix_chars and middle_chars.

    The sha256 of ``seed:id`` draws everything: the two cuts, whether the text is rearranged (``per_cent`` of 100) and
    whether the suffix then comes first (``suffix_first`` of 100 of those). Texts that are empty or hold a sentinel
    stay plain; a plain text is its own output, with null lengths.

    A null text counts as empty, a null id as an empty one. Rows equal in id and text have equal results, every row
    keeps its row, columns called like the new ones are replaced, and an empty table gives none.
    """
    made = ["n", "form", "output", "prefix_chars", "middle_chars"]
    kept = docs.drop(*[c for c in made if c not in (id_col, text_col)])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("_text").contains(sentinel)
    plain = (F.col("_text") == "") | marked | (h[2] % 100 >= per_cent)
    cut = (
        kept.withColumns({"_digest": digest, "_text": text})
        .withColumn("_cut", _cuts("_text", h[0], h[1]))
        .withColumns({
            "n": F.col("_cut.n"),
            "form": F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm"),
            "prefix_chars": F.col("_cut.a"),
            "middle_chars": F.col("_cut.b") - F.col("_cut.a"),
        })
    )
    rearranged = F.col("form") != "plain"
    a, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substring("_text", F.lit(1), a), F.substring("_text", a + 1, m)
    suffix = F.substring("_text", a + m + 1, F.char_length("_text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("_text"))
    )
    return (
        cut.withColumn("output", output)
        .withColumns({c: F.when(rearranged, F.col(c)) for c in ("prefix_chars", "middle_chars")})
        .drop("_digest", "_text", "_cut")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of, from these two alone.

    The sentinels occur once each, as no rearranged text holds one and none can arise where parts meet.
    """
    n = F.char_length(output)
    first, second = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    length = len(PREFIX)
    at, end = F.instr(output, second), F.instr(output, F.lit(MIDDLE))
    head = F.substring(output, F.char_length(first) + 1, at - 1 - length)
    body = F.substring(output, at + length, end - at - length)
    middle = F.substring(output, end + length, n)
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, body)).otherwise(F.concat(body, middle, head))
