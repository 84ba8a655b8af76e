"""WARC archives of pages: revisit records for equal payloads, sorted capture runs, and their merge into one history."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.tables import BROADCAST_KEYS, broadcast_if_small, tasks_for, written
from corpusflow.session import scratch_path

LEAST_SHARED = 1000  # bytes; smaller payloads are stored each time
RECORDS_PER_FILE = 512
ROWS_PER_MERGE = 100_000
_EOL = "\r\n"
KEY = ("url_key", "captured", "page_id")


def _urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page "), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def with_record_types(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``pages`` with payload_digest, payload_bytes, record_type and refers_to.

    Of rows with equal payloads of ``least`` bytes or more, that with the largest page_id is the response and the others
    revisit it; repeated rows of that page_id are responses, too.  Counts of digests are summed before they are
    shuffled, and pages join the digests that stand more than once.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.withColumn("payload_digest", F.sha1(body)).withColumn("payload_bytes", F.octet_length(body).cast("long"))
    groups = pages.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes")
    groups = groups.agg(F.max("page_id").alias("_keeper"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = pages.join(broadcast_if_small(written(groups, "payloads")), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("_keeper"))
    )


def record() -> Column:
    """One WARC record as text, without the two line ends behind it, from a row of :func:`with_record_types`."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(_EOL))
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    uri = F.regexp_replace(F.regexp_replace(text("url"), "\r", "%0D"), "\n", "%0A")
    date = F.date_format(F.to_utc_timestamp(F.timestamp_seconds("captured"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", text("payload_bytes")), F.lit(_EOL)
    )
    block = F.concat(http, F.when(revisit, "").otherwise(F.coalesce("html", F.lit(""))))
    head = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", text("record_type")),
        line("WARC-Record-ID: ", _urn(F.col("page_id"))),
        line("WARC-Date: ", F.coalesce(date, F.lit("1970-01-01T00:00:00Z"))),
        line("WARC-Target-URI: ", uri),
        line("WARC-Payload-Digest: sha1:", text("payload_digest")),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                line("WARC-Refers-To: ", _urn(F.col("refers_to"))),
                line("X-Refers-To-Page: ", text("refers_to")),
            ),
        ).otherwise(""),
        line("X-Page: ", text("page_id")),
        line("Content-Type: application/http; msgtype=response"),
        line("Content-Length: ", F.octet_length(block).cast("string")),
        F.lit(_EOL),
    )
    return F.concat(head, block)


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Gzip WARC files of at most ``records_per_file`` records below ``path``, through Spark's text writer.

    ``pages``: (page_id, url, html, captured: seconds since 1970, ...).  A record is UTF-8 text, and the writer's line
    separator is the end of a record.  Null html is an empty payload, a null url an empty one, null times are 1970.
    Files are committed by Spark, so a lost executor leaves no half archive.
    """
    rows = with_record_types(pages).select(record().alias("value"))
    rows.write.option("lineSep", _EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str) -> str:
    """Sort key: host names backwards with commas, a bracket, then the path; without scheme, port, www and fragment."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url)
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :].split("#", 1)[0]
    host = re.sub(r"^www\.", "", re.sub(r":[0-9]*$", "", host).lower())
    return ",".join(reversed(host.split("."))) + ")" + tail


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an archive; lengths decide where a record ends, not what a payload says."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode().lower()] = value.strip().decode()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield headers, block


RUN = "run string, seq long, url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted capture run per archive: its records in the order of (url_key, captured, page_id), numbered by seq.

    Digests of responses are computed from the payload read back; a revisit states those of the payload that it stands for.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    number = lambda x: int(x) if x else None

    def capture(headers: dict[str, str], block: bytes) -> dict:
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = headers["warc-type"]
        digest = hashlib.sha1(payload).hexdigest() if kind == "response" else headers["warc-payload-digest"].removeprefix("sha1:")
        size = len(payload) if kind == "response" else int(re.search(rb"(?i)content-length: *([0-9]+)", http)[1])
        url = headers["warc-target-uri"]
        return {
            "url_key": url_key(url), "captured": headers["warc-date"], "page_id": number(headers["x-page"]), "url": url,
            "record_type": kind, "refers_to": number(headers.get("x-refers-to-page")), "payload_bytes": size, "payload_digest": digest,
        }

    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split(" ") for c in RUN.split(", "))])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                    run = [capture(*r) for r in records(stream)]
                run.sort(key=lambda c: (c["url_key"], c["captured"], c["page_id"] is not None, c["page_id"] or 0))
                yield pa.RecordBatch.from_pylist([{"run": name, "seq": i, **c} for i, c in enumerate(run)], schema)

    return files.mapInArrow(read, RUN)


class LoserTree:
    """Merge of sorted lists: every inner place holds the loser of its match, so the next winner plays one path only."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for leaf in range(len(runs)):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's next row comes before run b's; empty runs come last, equal rows in the order of runs."""
        x, y = self.runs[a], self.runs[b]
        if self.at[a] >= len(x):
            return False
        if self.at[b] >= len(y):
            return True
        return (x[self.at[a]], a) < (y[self.at[b]], b)

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.size) // 2
        while node > 0:
            if self.losers[node] < 0:  # the first to come waits for the other side
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position in it) in order."""
        for _ in range(sum(map(len, self.runs))):
            winner = self.losers[0]
            yield winner, self.at[winner]
            self.at[winner] += 1
            self._play(winner)


def merged_runs(runs: DataFrame, rows_per_task: int = ROWS_PER_MERGE) -> DataFrame:
    """All rows of ``runs`` (run, seq, url_key, captured, page_id, ...) with ``position``, their place in the global order.

    The order is that of (url_key, captured, page_id), null ids first.  Ranges of keys go to tasks; a key with very many
    captures is split by time and id.  A task gets its part of every run in the run's own order and merges them.
    """
    runs = runs.withColumn("_part", F.lit(0))
    parts = tasks_for(runs, rows_per_task)
    dealt = runs.repartitionByRange(parts, *KEY).sortWithinPartitions("run", "seq")

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held).combine_chunks() if held else None
        if table is None or not table.num_rows:
            return
        names, ids = table["run"].to_pylist(), table["page_id"].to_pylist()
        keys = list(zip(table["url_key"].to_pylist(), table["captured"].to_pylist(), [x is not None for x in ids], [x or 0 for x in ids], strict=True))
        starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
        lists = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
        order = pa.array([starts[run] + i for run, i in LoserTree(lists)], pa.int64())
        rows = table.drop_columns(["_part"]).take(order).append_column("_at", pa.array(range(len(keys)), pa.int64()))
        rows = rows.append_column("_part", pa.array([TaskContext.get().partitionId()] * len(keys), pa.int32()))
        yield from rows.to_batches(max_chunksize=10_000)

    kept = [f for f in runs.schema.fields if f.name != "_part"]
    schema = T.StructType([*kept, T.StructField("_at", T.LongType()), T.StructField("_part", T.IntegerType())])
    merged = written(dealt.mapInArrow(merge, schema), "merged")
    sizes = merged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    named = merged.join(broadcast_if_small(written(bases, "bases"), BROADCAST_KEYS), "_part")
    return named.withColumn("position", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def capture_history(pages: DataFrame) -> DataFrame:
    """Pages written as archives in the shared folder, read back and merged into one capture history.

    ``pages``: (page_id: long, url, html, captured), see :func:`write_archives`; no pages give no rows, repeated rows are
    captures of their own, other columns are ignored.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages.select("page_id", "url", "html", "captured"), path)
    return merged_runs(written(read_runs(spark, path), "runs"))
