"""WARC archives: write captures, read them back, merge their indexes to capture histories.

Captures of equal payload are written once as ``response``; the others are
``revisit`` records that refer to it.  Reading yields one index run per archive,
sorted by URL key and timestamp; the runs are range-partitioned and each range
is merged by a loser tree, so all ranges together are one globally ordered
index.

Scale: one shuffle of the payloads (to learn which are copies) and one of index
rows.  Equal payloads are counted by digest with map-side combination, and the
join back may be split by key, so a payload with a third of all captures is no
bottleneck.  Range bounds include the capture's id: one URL with very many
captures spans several ranges.  Archives are written and read by Spark itself,
in the shared folder.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, shared_dir

#: Captures in an archive at most, and bytes of payloads in one on average.
PER_FILE, FILE_BYTES = 5_000, 32 << 20
#: When a capture has no time of its own, this plus its id in seconds.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_END = b"\r\n\r\n"


def url_key(url: str | None) -> str:
    """A URL's sort key: host labels reversed, then path and query; no scheme, user, port 80 or 443, or fragment."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url if "://" in url else "//" + url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _one_line(text: str | None) -> str:
    return "" if text is None else "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in text)


def warc_date(capture: int | None) -> str:
    """The WARC-Date of a capture without a time of its own."""
    return (EPOCH + timedelta(seconds=(capture or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(capture, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str | None = None) -> bytes:
    """A WARC/1.1 record (without the two line ends after it): a response, or a revisit without the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:capture:{'' if capture is None else capture}>",
        f"WARC-Date: {date or warc_date(capture)}",
        f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Refers-To: <urn:capture:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + _END + block


def _headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])}


def _capture(urn: str) -> int | None:
    number = urn.removeprefix("<urn:capture:").removesuffix(">")
    return int(number) if number else None


def parse(archive: bytes) -> Iterator[dict]:
    """The records of an archive, each checked: lengths, and for responses the payload's digest."""
    at = 0
    while at < len(archive):
        stop = archive.index(_END, at)
        head = _headers(archive[at:stop])
        begin = stop + len(_END)
        end = begin + int(head["content-length"])
        if not archive.startswith(b"WARC/1.", at) or archive[end : end + len(_END)] != _END:
            raise ValueError(f"broken record at byte {at}")
        cut = archive.index(_END, begin, end)
        size = int(_headers(archive[begin:cut])["content-length"])
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        payload = archive[cut + len(_END) : end]
        if head["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload and digest differ at byte {at}")
        yield {
            "capture": _capture(head["warc-record-id"]),
            "url": head["warc-target-uri"],
            "warc_date": head["warc-date"],
            "payload_bytes": size,
            "payload_digest": digest,
            "record_type": head["warc-type"],
            "refers_to": _capture(head["warc-refers-to"]) if "warc-refers-to" in head else None,
            "record_offset": at,
            "record_bytes": end + len(_END) - at,
        }
        at = end + len(_END)


class LoserTree:
    """K-way merge of sorted runs: each inner node keeps the loser of its match, the root's winner goes out."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.size = max(1, len(self.runs))
        self.losers = [-1] * self.size
        for k in range(len(self.runs)):
            self._play(k, True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return x < y if x != y else a < b

    def _play(self, player: int, building: bool = False) -> None:
        node = (player + self.size) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = player
                return
            if other >= 0 and self._before(other, player):
                self.losers[node], player = player, other
            node //= 2
        self.losers[0] = player

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[k := self.losers[0]] is not None:
            yield self.heads[k]
            self.heads[k] = next(self.runs[k], None)
            self._play(k)


_INDEX = pa.schema(
    [("url_key", pa.string()), ("warc_date", pa.string()), ("capture", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64()), ("record_bytes", pa.int64()), ("place", pa.int64())]
)
_MERGED = "range int, place_in_range long"
_DDL = "url_key string, warc_date string, capture long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long, record_bytes long, place long"


def _record_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, 500):
            rows = batch.slice(s, 500).to_pylist()
            made = [record(r["capture"], r["url"], r["payload"] or b"", r["owner"], r["revisit"], r["date"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            found = list(parse(gzip.decompress(content.as_py())))
            for r in found:
                r |= {"url_key": url_key(r["url"]), "archive": path.as_py()}
            found.sort(key=lambda r: (r["url_key"], r["warc_date"], -1 if r["capture"] is None else r["capture"]))
            yield pa.RecordBatch.from_pylist([r | {"place": k} for k, r in enumerate(found)], _INDEX)


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not tables:
        return
    rows = pa.concat_tables(tables)
    keys = list(zip(*(rows[c].to_pylist() for c in ("archive", "place", "url_key", "warc_date", "capture")), strict=True))
    runs: dict[str, list] = {}
    for at, (archive, place, key, date, capture) in enumerate(keys):
        runs.setdefault(archive, []).append((place, (key, date, -1 if capture is None else capture, archive, place, at)))
    # A shuffle may bring a run's rows out of turn; their places in the run restore it.
    sorted_runs = [[entry for _, entry in sorted(runs[a])] for a in sorted(runs)]
    order = [entry[-1] for entry in LoserTree(sorted_runs)]
    rows = rows.take(pa.array(order, pa.int64()))
    rows = rows.append_column("range", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32()))
    yield from rows.append_column("place_in_range", pa.array(range(len(order)), pa.int64())).combine_chunks().to_batches(max_chunksize=10_000)


def write_archives(captures: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, per_file: int | None = None) -> None:
    """Write each row as a WARC record into gzip-compressed archives under ``path``.

    Payloads are the column's bytes (null: empty).  Of rows with equal payloads
    the one with the largest id is the response and the rest revisit it; rows that
    repeat id and payload have the same type.  Null ids count as the least.  The
    date is that of ``time_col`` (a timestamp), if there is one and it isn't null,
    else EPOCH and the id in seconds.  An archive has ``per_file`` records at most;
    None: as many as make FILE_BYTES of payload on average, PER_FILE at most.
    """
    time = F.date_format(F.to_utc_timestamp(F.col(f"`{time_col}`").cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_col else F.lit(None).cast("string")
    rows = captures.select(
        F.col(f"`{id_col}`").cast("long").alias("capture"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        time.alias("date"),
        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"),
    )
    if per_file is None:
        n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()
        per_file = max(1, min(PER_FILE, FILE_BYTES * n // max(1, size)))
    rows = rows.withColumn("sha", F.sha1("payload"))
    owners = rows.groupBy("sha").agg(F.max("capture").alias("owner"))
    rows = rows.join(owners, "sha").withColumn("revisit", ~F.col("capture").eqNullSafe(F.col("owner")))
    made = rows.select("capture", "url", "date", "payload", "owner", "revisit").mapInArrow(_record_rows, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def capture_history(archives: DataFrame, ranges: int | None = None) -> DataFrame:
    """The globally ordered index of archives (a frame with path and content, as the binaryFile source reads).

    Sorted by url_key, warc_date and capture within and across the partitions;
    ``position`` counts in that order from 0, however the ranges were cut.
    """
    runs = archives.select("path", "content").mapInArrow(_run_rows, _DDL)
    keys = ["url_key", "warc_date", "capture", "archive", "place"]
    spread = runs.repartitionByRange(ranges, *keys) if ranges else runs.repartitionByRange(*keys)
    merged = materialise(spread.mapInArrow(_merge_rows, f"{_DDL}, {_MERGED}"), "history")
    sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = F.broadcast(sizes.select("range", before.alias("begin")))
    return merged.join(begins, "range").withColumn("position", F.col("begin") + F.col("place_in_range")).drop("range", "place_in_range", "begin")


def archive_captures(captures: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``captures`` to archives (a new folder of the shared one, unless ``path`` names another), read them back and merge their indexes.

    One row per capture: url_key, warc_date, capture (the id), url, payload_bytes
    and payload_digest (base32 SHA-1; of the full payload, for revisits too),
    record_type, refers_to, archive, record_offset and record_bytes (in the
    unpacked archive), place (in the archive's own order) and position (in the
    order of all).  Null URLs are empty.  Further columns are ignored; an empty
    table gives no rows.
    """
    spark = captures.sparkSession
    path = path or f"{shared_dir(spark)}/gridskein/warc-{uuid.uuid4().hex}"
    write_archives(captures, path, id_col, url_col, payload_col, time_col)
    return capture_history(spark.read.format("binaryFile").load(path))
