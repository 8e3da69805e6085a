"""WARC archives and their external index merge.

Records are written with Spark's own text writer (record separator CRLF CRLF, which is how a WARC
record ends), so any shared store works and a lost executor only repeats its task. Reading back,
the captures of a task's archive files become locally sorted runs of up to RUN_CAPTURES, kept as a table in the shared
folder. The runs are then cut at range boundaries over (URL key, timestamp, record id, place in the archive), an order without
ties, so that no key and no repeated row makes a range larger, and the pieces
of each range are merged k-way by a loser tree, in passes of FAN_IN runs at most, which gives globally ordered capture histories:
ranges in order of ``range_id``, captures within a range in order of ``position``.

A null payload is an empty one; a null or odd URL has the key of its text, null the empty key; a
null id is kept as null and may not be referred to; rows that repeat the smallest id of a payload are
all responses; a null capture time is the epoch, and dates are written in UTC whatever the session's time zone;
empty tables give empty archives and results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import renamed, shared_dir, written

END = "\r\n\r\n"
#: At most so many keys are sampled to place range boundaries; boundaries only spread the work, results never depend on them.
BOUNDARY_SAMPLE = 20_000
CAPTURES_PER_RANGE = 100_000
#: Captures that a task sorts into one run, and runs that one pass merges.
RUN_CAPTURES = 50_000
FAN_IN = 64
CAPTURE = "url_key string, capture_time string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, archive string, record_offset long"
COLUMNS = [c.split()[0] for c in CAPTURE.split(", ")]


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1, in the JVM: every five hex digits are four base32 digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def utc(at: Column) -> Column:
    """``2020-01-31T23:59:59Z`` from the seconds since the epoch, which no session's time zone shifts."""
    seconds = F.unix_seconds(at)
    day, rest = F.floor(seconds / 86_400).cast("int"), F.pmod(seconds, F.lit(86_400))
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(rest / 3600)), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), two(F.pmod(rest, F.lit(60))))
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), clock, F.lit("Z"))


def write_archives(
    pages: DataFrame, capture_time: Column, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, records_per_file: int = 2000, path: str | None = None,
) -> str:
    """Writes one record per row and returns the archives' folder."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    p = pages.withColumn("__at", capture_time)
    p = renamed(p, id=id_col, url=url_col, payload=payload_col, at="__at").withColumn("payload", F.coalesce(F.col("payload").cast("string"), F.lit("")))
    p = p.withColumns({"digest": sha1_base32(F.col("payload").cast("binary")), "n": F.octet_length("payload").cast("long")})
    # revisits: found on (id, digest) only; first ids are pre-aggregated, so a hot payload is one row for each task
    known = p.where(F.col("n") >= min_revisit_bytes).select("id", "digest")
    first = known.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    revisits = known.distinct().join(first, "digest").where("id is null or id > first").select("id", "digest", "first")
    p = p.join(revisits, p.id.eqNullSafe(revisits.id) & (p.digest == revisits.digest), "left").select(p["*"], revisits["first"])
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    is_revisit = F.col("first").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", utc(F.coalesce("at", F.timestamp_seconds(F.lit(0))))),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", clean)).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(
            is_revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(is_revisit, "0").otherwise(F.col("n").cast("string"))),
        F.lit(END),
    )
    record = F.concat(head, F.when(is_revisit, "").otherwise(F.col("payload")))
    p.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def url_key(url: str | None) -> str:
    """Sortable key: host parts from the right, then path and query; the fragment goes."""
    if not url:
        return ""
    try:
        at = urlsplit(url.strip())
        host = (at.hostname or "").removeprefix("www.")
        port = f":{at.port}" if at.port and at.port not in (80, 443) else ""
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + port + ")" + (at.path or "/") + (f"?{at.query}" if at.query else "")


def parse_archive(data: bytes, name: str) -> Iterator[tuple]:
    """The captures of one archive file, in file order. Raises where a record and its digest disagree."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:stop].decode("utf-8").split("\r\n")[1:])
        size = int(head["Content-Length"])
        body = data[stop + 4 : stop + 4 + size]
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind, refers = head["WARC-Type"], head.get("WARC-Refers-To", "<urn:page:>")[10:-1]
        if kind == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
            raise ValueError(f"{name}: record at {at} is damaged")
        page = head["WARC-Record-ID"][10:-1]
        yield (url_key(head.get("WARC-Target-URI")), head["WARC-Date"], page or None, int(head["X-Payload-Length"]), digest, kind, refers or None, name, at)
        at = stop + 4 + size + 4


def order(capture: tuple) -> tuple:
    """URL key, time, record id, and the place in its archive, so that no two captures are equal."""
    return (capture[0], capture[1], len(capture[2] or ""), capture[2] or "", *capture[7:9])


KINDS = [pa.string() if c.split()[1] == "string" else pa.int64() for c in CAPTURE.split(", ")]


def table_of(captures: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, kind) for x, kind in zip(zip(*captures, strict=True) if captures else [()] * len(KINDS), KINDS, strict=True)]


def capture_runs(spark: SparkSession, path: str, run_captures: int = RUN_CAPTURES) -> DataFrame:
    """Sorted runs of captures, written to the shared folder; a run has the name of its first archive file and the captures of one or more."""

    def runs(batches):
        held: list[tuple] = []
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                held += parse_archive(content.as_py(), name.as_py().rpartition("/")[2])
                if len(held) >= run_captures:
                    yield run(held)
                    held = []
        if held:
            yield run(held)

    def run(held):
        name = held[0][7]
        held.sort(key=order)
        return pa.RecordBatch.from_arrays([*table_of(held), pa.array([name] * len(held), pa.string())], [*COLUMNS, "run"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return written(files.mapInArrow(runs, f"{CAPTURE}, run string"), "runs")


class LoserTree:
    """K-way merge of sorted runs: inner nodes hold the losers, so each output costs one path to the root."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [order(h) if h is not None else None for h in self.heads]
        self.losers = [-1] * max(self.k, 1)
        for i in range(self.k):
            self.replay(i)

    def beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            held = self.losers[node]
            if held < 0:  # building: wait here for the other side
                self.losers[node] = winner
                return
            if self.beats(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = h = next(self.runs[w], None)
            self.keys[w] = order(h) if h is not None else None
            self.replay(w)


def merged(runs: list[list[tuple]], fan_in: int = FAN_IN) -> list[tuple]:
    """Sorted runs as one, by passes that each merge ``fan_in`` runs at most."""
    while len(runs) > 1:
        runs = [list(LoserTree(runs[i : i + fan_in])) for i in range(0, len(runs), fan_in)]
    return runs[0] if runs else []


def merged_index(runs: DataFrame, captures_per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """The runs merged: CAPTURE columns, range_id and position. Ranges hold about ``captures_per_range``."""
    n = runs.count()
    n_ranges = max(1, -(-n // captures_per_range))
    bounds: list[tuple] = []
    if n_ranges > 1:
        keys = runs.select(*COLUMNS).sample(min(1.0, 0.8 * BOUNDARY_SAMPLE / n), seed=7).limit(BOUNDARY_SAMPLE)
        some = sorted(order(tuple(r)) for r in keys.collect())
        bounds = sorted({some[len(some) * i // n_ranges] for i in range(1, n_ranges)}) if some else []

    def pieces(batches):
        """Cuts each stretch of a run at the boundaries; every piece is sorted as its run is, and is one row of arrays."""
        for b in batches:
            names = b.column(len(COLUMNS)).to_pylist()
            captures = list(zip(*(b.column(i).to_pylist() for i in range(len(COLUMNS))), strict=True))
            ranges = [bisect_right(bounds, order(c)) for c in captures]
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or ranges[i] != ranges[i - 1]), len(names)]
            offsets = pa.array(cuts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, b.column(i)) for i in range(len(COLUMNS))]
            yield pa.RecordBatch.from_arrays([pa.array([ranges[i] for i in cuts[:-1]], pa.int32()), *lists], ["range_id", *COLUMNS])

    def merge(batches):
        """Ranges come one after the other; the pieces of one are held."""
        now, held = None, []

        def out():
            found = merged(held)
            return pa.RecordBatch.from_arrays([*table_of(found), pa.array([now] * len(found), pa.int32()), pa.array(range(len(found)), pa.int64())], [*COLUMNS, "range_id", "position"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(len(COLUMNS) + 1)), strict=True):
                if row[0] != now:
                    if held:
                        yield out()
                    now, held = row[0], []
                held.append(list(zip(*row[1:], strict=True)))
        if held:
            yield out()

    arrays = ", ".join(f"{c.split()[0]} array<{c.split()[1]}>" for c in CAPTURE.split(", "))
    cut = runs.mapInArrow(pieces, f"range_id int, {arrays}")
    return cut.repartitionByRange(n_ranges, "range_id").sortWithinPartitions("range_id").mapInArrow(merge, f"{CAPTURE}, range_id int, position long")


def globally_numbered(merged: DataFrame) -> DataFrame:
    """Adds index_position, the place in the whole index: places within ranges plus the sizes of the ranges before (a row per range)."""
    merged = written(merged, "index")
    sizes = merged.groupBy("range_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return merged.join(starts, "range_id").withColumn("index_position", (F.col("start") + F.col("position")).cast("long")).drop("start")
