"""WARC archives written and read by Spark, and their index by external merge.

Pages are written as WARC/1.1 records: a response with its payload, or, where an earlier
record has the same payload, a revisit that refers to it. The text writer puts a separator
after each row, and a WARC record ends in just such a one, so the files are plain archives.
Reading gives each file's captures as a run sorted by URL key and time; runs are exchanged
once by ranges of the key and a loser tree merges each range's runs into capture histories.
Files hold a stated number of bytes, or one record that is larger, and a range a stated number
of captures, however many share a key: neither grows with the data.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import bits_of, may_be_in
from tidegauge.session import new_dir, settle

MIN_REVISIT = 100  # payload bytes
FILE_BYTES = 32 << 20  # of payload in a file of more than one record
SMALL = 16  # log2 of the payload bytes up to which records share a file by their number alone
RANGE_ROWS = 100_000  # captures of one range of the merge
LOG2_BITS = 24
END = "\r\n\r\n"
EPOCH = 1_704_067_200  # first capture, 2024-01-01; page n follows n seconds later
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = (
    "page_id long, url_key string, captured string, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, file string, position long, length long"
)


def url_key(url: str) -> str:
    """Host labels from the top domain down, then path and query, in lower case."""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}".lower()


def with_types(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload``, its size and digest, and the response it refers to.

    Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the
    smallest ``page_id`` is the response; rows without an id are responses.
    """
    rows = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload")
    ).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    first = settle(
        rows.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1").drop("n"),
        "repeated",
    )
    # a bitmap of fixed size lets most payloads that occur once pass by the exchange
    bitmap = bits_of(first.select(F.xxhash64("digest").alias("k")), "k", LOG2_BITS)
    repeated = may_be_in(F.xxhash64("digest"), bitmap, LOG2_BITS)
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    joined = rows.filter(repeated).join(first, "digest", "left").withColumn("refers_to", refers).drop("first")
    return joined.unionByName(rows.filter(~repeated).withColumn("refers_to", F.lit(None).cast("long")))


def records(typed: DataFrame) -> DataFrame:
    """Each row as the text of a record without its final separator."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    seen = F.col("refers_to").isNotNull()
    block = F.when(seen, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return typed.select(
        F.concat(
            F.lit("WARC/1.1\r\n"),
            line("WARC-Type", F.when(seen, F.lit("revisit")).otherwise(F.lit("response"))),
            line("WARC-Record-ID", urn("page_id")),
            line("WARC-Date", date),
            line("WARC-Target-URI", uri),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            F.when(
                seen,
                F.concat(
                    line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                    line("WARC-Refers-To", urn("refers_to")),
                ),
            ).otherwise(F.lit("")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("value")
    )


def size_class() -> Column:
    """Log2 of the payload bytes, rounded up; ``SMALL`` for all smaller records."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    return F.greatest(F.lit(SMALL), F.ceil(F.log2(F.greatest(size, F.lit(1))))).cast("int")


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the pages below ``path``, ``FILE_BYTES`` of payload at most to a file, or one record.

    Records of one class of sizes share files, so that a number of records bounds the bytes.
    Most tables have one class; there are at most fifteen.
    """
    classes = sorted(r["c"] for r in pages.select(size_class().alias("c")).distinct().collect())
    for c in classes or [SMALL]:
        # equal payloads are of one class, so each class can be typed by itself
        rows = records(with_types(pages.filter(size_class() == c) if len(classes) > 1 else pages))
        writer = rows.write.option("lineSep", END).option("compression", "none").mode("append")
        writer.option("maxRecordsPerFile", max(1, FILE_BYTES >> c)).text(path)


def parse(content: bytes):
    """Records of an archive: headers, payload bytes, position and length."""
    at = 0
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        lines = content[at:head].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        block = content[head + 4 : head + 4 + size]
        if len(block) < size:
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, block[block.index(b"\r\n\r\n") + 4 :], at, head + 4 + size - at
        at = head + 4 + size + len(END)


def _number(urn: str | None):
    value = (urn or "").removeprefix("<urn:capture:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def runs(spark, path: str) -> DataFrame:
    """The archives' captures; each file is one run, sorted by URL key, time and page."""

    def read(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                run = []
                for headers, payload, position, length in parse(content):
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: payload at byte {position} does not match its digest")
                    url = headers["WARC-Target-URI"]
                    run.append(
                        (
                            _number(headers["WARC-Record-ID"]), url_key(url), headers["WARC-Date"], url,
                            headers["WARC-Type"], _number(headers.get("WARC-Refers-To")),
                            None if revisit else len(payload), digest, name, position, length,
                        )
                    )
                run.sort(key=order)
                yield _frame(run)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") > 0).select("path", "content").mapInPandas(read, INDEX)


def order(row) -> tuple:
    """URL key, time, file and position of a capture row."""
    return row[1], row[2], row[8], row[9]


class LoserTree:
    """Merges sorted runs; each step replays one path from leaf to root."""

    def __init__(self, sources, key):
        self.sources = [iter(s) for s in sources]
        self.key = key
        self.leaves = 1
        while self.leaves < max(1, len(self.sources)):
            self.leaves *= 2
        self.heads = [self._next(i) for i in range(self.leaves)]
        self.tree = [0] * self.leaves
        winners = [0] * self.leaves + list(range(self.leaves))
        for node in range(self.leaves - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.leaves > 1 else 0

    def _next(self, i):
        row = next(self.sources[i], None) if i < len(self.sources) else None
        return None if row is None else (self.key(row), row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None
        return (x[0], a) <= (y[0], b)

    def __iter__(self):
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner][1]
            i = self.winner
            self.heads[i] = self._next(i)
            node = (i + self.leaves) // 2
            while node:
                if not self._before(i, self.tree[node]):
                    i, self.tree[node] = self.tree[node], i
                node //= 2
            self.winner = i


def sorted_pieces(rows: list[tuple]) -> list[list[tuple]]:
    """Rows cut where the order breaks: the runs, or pieces of them, as they arrived."""
    cuts = [0, *(i for i in range(1, len(rows)) if order(rows[i]) < order(rows[i - 1])), len(rows)]
    return [rows[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


def merged(sorted_runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures in global order of URL key and time, partition after partition.

    ``sorted_runs`` is a stored table; it is counted for the number of ranges. The range key
    ends in file and position, so a URL key with many captures is cut over ranges, and a task
    holds one range: some ``range_rows`` captures, without their payloads.
    """

    def merge(frames):
        rows = []
        for frame in frames:
            rows += frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
        out = []
        for row in LoserTree(sorted_pieces(rows), order):
            out.append(row)
            if len(out) == 10_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    own = int(sorted_runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(own, -(-sorted_runs.count() // range_rows))
    dealt = sorted_runs.repartitionByRange(ranges, "url_key", "captured", "file", "position")
    return dealt.mapInPandas(merge, INDEX)


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
    for c in ("page_id", "refers_to", "payload_bytes"):
        out[c] = out[c].astype("Int64")
    return out


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and merge the index.

    One row a row of ``pages``: null html is an empty payload, a null URL is empty. A
    revisit's ``payload_bytes`` are those of the response it refers to. Other columns are
    not read.
    """
    spark = pages.sparkSession
    path = new_dir(spark, "warc")
    write_archives(pages, path)
    history = settle(merged(settle(runs(spark, path), "runs")), "history")
    sizes = history.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(
        F.max("payload_bytes").alias("full")
    )
    return history.join(sizes, ["refers_to", "payload_digest"], "left").withColumn(
        "payload_bytes", F.coalesce("payload_bytes", "full")
    ).drop("full")
