"""WARC archives: written by Spark's text sink, read in splits, checked by boundary chains.

A split reader meets the magic line wherever its bytes stand, also inside a payload that quotes an archive. What
tells a record from a quotation is its place: records follow one another from the start of the file. Each
magic is a candidate whose header states where the next record must begin; candidates that cannot be reached
from the first byte are rejected and their bytes belong to the payload around them.

Chains are first followed inside each split, in the task that reads it; pointer jumping over the exits of the splits then
tells which candidates the start of the file reaches, in a logarithmic number of rounds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from readsift.llm.common import if_small
from readsift.session import stage, staging_root

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
_GAP = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
SMALL_ROWS = 200_000


def digest(payload: bytes) -> str:
    """Base32 SHA-1, as archives write it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.pandas_udf(T.StringType())
def _digests(payload: pd.Series) -> pd.Series:
    return payload.map(lambda x: digest(x.encode("utf-8", "surrogatepass")))


def describe(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", at_least: int = 0) -> DataFrame:
    """One row per page: id, url, payload (text, empty for null), n_bytes, digest, record_type and refers_to.

    Of pages with equal payloads of ``at_least`` bytes or more, the one with the smallest id is the response and the others
    revisit it; shorter payloads are responses all. Equality is that of digest and length. Rows that repeat the
    smallest id are responses, and a null id never is one that others refer to."""
    made = pages.select(
        F.col(key).cast("string").alias("id"), F.col(key).alias("_key"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    ).withColumns({"digest": _digests("payload"), "n_bytes": F.octet_length("payload").cast("bigint")})
    shared = made.where(F.col("n_bytes") >= at_least).groupBy("digest", "n_bytes").agg(
        F.min("_key").cast("string").alias("first"), F.count(F.lit(1)).alias("_copies")
    )
    shared = stage(shared.where("_copies > 1 AND first IS NOT NULL").drop("_copies"), "payload-groups")
    found = made.join(if_small(shared, SMALL_ROWS), ["digest", "n_bytes"], "left")
    revisit = F.coalesce(F.col("first") != F.col("id"), F.col("first").isNotNull())
    return found.select(
        "id", "url", "payload", "n_bytes", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write(records: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """Write described records as plain WARC files. A text row is one record, the line separator the gap after it.
    Line breaks in urls become spaces."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes"), F.lit(_GAP)
    )
    is_revisit = F.col("record_type") == "revisit"
    block = F.concat(http, F.when(is_revisit, "").otherwise(F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c, F.lit("")), F.lit(">\r\n"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " "), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(is_revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise("\r\n"),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block), F.lit(_GAP),
    )
    rows = records.select(F.concat(head, block).alias("value"))
    rows.write.option("lineSep", _GAP).option("maxRecordsPerFile", records_per_file).text(path)


_LENGTH = re.compile(rb"(?:^|\r\n)content-length: *(\d+) *(?=\r\n|$)", re.IGNORECASE)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Text between magics, in the order of the file, with the split it was read in."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, int, int, bytes]]:
    """((file, block), number in the split, bytes of the split before, text) of each row of a task, in order."""
    now, i, at = None, 0, 0
    for batch in batches:
        for file, block, value in zip(batch["file"], batch["block"], batch["value"]):
            if (file, block) != now:
                now, i, at = (file, block), 0, 0
            raw = value.encode("utf-8", "surrogatepass")
            yield now, i, at, raw
            i, at = i + 1, at + len(raw) + len(MAGIC)


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates (file, block, i, at, next): ``at`` is where the text after the magic starts and ``next`` where the text after the
    following record's magic must start, both counted from the split's first byte read."""
    rows = []
    for (file, block), i, at, raw in _placed(batches):
        head = raw.find(b"\r\n\r\n")
        length = _LENGTH.search(raw, 0, head + 2) if head >= 0 else None
        after = at + head + 4 + int(length[1]) + 4 + len(MAGIC) if length else None
        rows.append((file, block, i, at, after, len(raw) + len(MAGIC)))
        if len(rows) == 10_000:
            yield _candidates(rows)
            rows = []
    yield _candidates(rows)


def _candidates(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["file", "block", "i", "at", "next", "size"]).astype({"next": "Int64"})


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    """Follow chains inside one split, last candidate first: ``exit`` is the first place beyond the split."""
    group = group.sort_values("at")
    end, exits = int(group["at"].iloc[-1] + group["size"].iloc[-1]), {}
    for at, after in zip(reversed(group["at"].tolist()), reversed(group["next"].tolist())):
        if pd.isna(after):
            exits[at] = None
        elif after >= end:
            exits[at] = int(after)
        else:
            exits[at] = exits.get(int(after))
    return group.assign(exit=pd.array([exits[a] for a in group["at"]], "Int64"))


def _reached(group: pd.DataFrame) -> pd.DataFrame:
    """Mark the chain inside one split from the candidates that are reached from outside."""
    group = group.sort_values("at")
    seen, marks = set(), []
    for at, after, entered in zip(group["at"], group["next"], group["entered"]):
        marks.append(entered or at in seen)
        if marks[-1] and not pd.isna(after):
            seen.add(int(after))
    return group.assign(reached=marks)[["file", "block", "i", "at", "reached"]]


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """All candidates of the files: rows (file, block, i, at, reached, record), places from the start of the file; ``record`` is
    the place of the record that the candidate starts or lies in. Text before a file's first magic belongs to none."""
    local = "file string, block bigint, i int, at bigint, next bigint, size bigint"
    found = _scan(spark, path).mapInPandas(_measured, local)
    found = stage(found.groupBy("file", "block").applyInPandas(_exits, f"{local}, exit bigint"), "candidates")
    # One row per split.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("file", "block").agg(F.sum("size").alias("_size"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    placed = stage(
        found.join(if_small(stage(starts, "splits"), SMALL_ROWS), ["file", "block"]).select(
            "file", "block", "i", *[(F.col(c) + F.col("_start")).alias(c) for c in ("at", "next", "exit")]
        ), "places"
    )
    # A file that starts with the magic has nothing before it: its first record's text starts right behind.
    jumps = placed.where("exit IS NOT NULL").select("file", "at", F.col("exit").alias("to"))
    entered = placed.where(F.col("at") == len(MAGIC)).select("file", "at")
    while True:
        fresh = stage(
            entered.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
            .join(placed.select("file", "at"), ["file", "at"], "left_semi").join(entered, ["file", "at"], "left_anti").distinct(), "entered"
        )
        if fresh.isEmpty():
            break
        entered = stage(entered.unionByName(fresh), "entered")
        further = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("_to"))
        jumps = stage(jumps.join(further, ["file", "to"]).select("file", "at", F.col("_to").alias("to")), "jumps")
    marked = placed.join(entered.withColumn("entered", F.lit(True)), ["file", "at"], "left").select(
        "file", "block", "i", "at", "next", F.coalesce("entered", F.lit(False)).alias("entered")
    )
    marked = stage(
        marked.groupBy("file", "block").applyInPandas(_reached, "file string, block bigint, i int, at bigint, reached boolean"), "reached"
    )
    own = F.when(F.col("reached"), F.col("at"))
    within = Window.partitionBy("file", "block").orderBy("at")
    last = marked.groupBy("file", "block").agg(F.max(own).alias("_last"))
    carried = last.withColumn("_carried", F.max("_last").over(earlier)).drop("_last")
    return (
        marked.withColumn("_in_split", F.max(own).over(within)).join(carried, ["file", "block"])
        .select("file", "block", "i", "at", "reached", F.coalesce("_in_split", "_carried").alias("record"))
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: (file, record, head, content), ``head`` the header lines and ``content`` the bytes of the block. A
    record whose block is shorter than its header states raises. An empty folder's files give no rows."""
    places = stage(boundaries(spark, path), "boundaries")
    rows_of = places.groupBy("file", "record").agg(F.count(F.lit(1)).alias("parts"))
    places = stage(places.where("record IS NOT NULL").join(rows_of, ["file", "record"]), "boundaries")

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for (file, block), i, _, raw in _placed(batches):
            rows.append((file, block, i, raw))
            held += len(raw)
            if held > 1 << 23:
                yield pd.DataFrame(rows, columns=["file", "block", "i", "raw"])
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=["file", "block", "i", "raw"])

    texts = _scan(spark, path).mapInPandas(numbered, "file string, block bigint, i int, raw binary")
    rows = texts.join(if_small(places, SMALL_ROWS), ["file", "block", "i"])
    whole = rows.where("parts = 1").select("file", "record", "raw")
    # A payload that holds the magic came in several rows; few records do.
    quoted = rows.where("parts > 1").groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("_rows")
    ).select("file", "record", F.expr(f"aggregate(_rows, cast('' AS binary), (a, r) -> CASE WHEN length(a) = 0 THEN r.raw "
                                      f"ELSE concat(a, encode('{MAGIC[:-2]}\\r\\n', 'UTF-8'), r.raw) END)").alias("raw"))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, record, raw in zip(batch["file"], batch["record"], batch["raw"]):
                cut = raw.find(b"\r\n\r\n")
                n = int(_LENGTH.search(raw, 0, cut + 2)[1])
                content = raw[cut + 4 : cut + 4 + n]
                if len(content) < n:
                    raise ValueError(f"{file}: the record at {record} is cut off")
                rows.append((file, record, raw[:cut].decode(), content))
            yield pd.DataFrame(rows, columns=["file", "record", "head", "content"])

    return whole.unionByName(quoted).mapInPandas(parsed, "file string, record bigint, head string, content binary")


def pages(records: DataFrame) -> DataFrame:
    """Pages of response and revisit records: (id, url, record_type, refers_to, payload_bytes, payload_digest, payload). A
    response's size and digest are those of the payload read, and must agree with its header; a revisit has those
    of the payload it stands for, and no payload."""

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        for batch in batches:
            rows = []
            for head, content in zip(batch["head"], batch["content"]):
                fields = dict(line.split(": ", 1) for line in head.split("\r\n") if ": " in line)
                name = lambda field: (fields.get(field, "")[len("<urn:page:") : -1]) or None  # noqa: B023, E731
                kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                http, _, payload = content.partition(b"\r\n\r\n")
                size = int(_LENGTH.search(http)[1])
                if kind == "response" and (len(payload) != size or digest(payload) != stated):
                    raise ValueError(f"record {fields['WARC-Record-ID']}: the payload is not the one that was written")
                rows.append((
                    name("WARC-Record-ID"), fields.get("WARC-Target-URI"), kind, name("WARC-Refers-To"), size, stated,
                    payload if kind == "response" else None,
                ))
            yield pd.DataFrame(rows, columns=columns)

    return records.mapInPandas(
        unpacked, "id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"
    )


def archive(source: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> str:
    """Write pages to a fresh folder in the shared space; returns its path."""
    path = f"{staging_root(source.sparkSession).rstrip('/')}/readsift/warc-{uuid.uuid4().hex}"
    write(describe(source, key, payload, url), path)
    return path
