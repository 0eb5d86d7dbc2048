"""WARC: capture runs with local indexes, merged outwards by a loser tree into one order of URL key and time.

Writing. Payload digests are computed in the JVM; of equal payloads of at least min_bytes, the capture with the smallest
id is the response and the others become revisit records that refer to it. Each task writes its captures as one archive
of gzip members, one for each record, into the shared folder, and returns its index sorted by (URL key, time, id): a
run. A file's name is new for each attempt and only the runs that were kept name it, so a repeated task does no harm.

Merging. The index rows are dealt out by ranges of (URL key, time, id, run, offset), so that a key of any size spreads over
tasks, and there are as many ranges as keep one at about MERGE_ROWS rows; within a task the sorted runs are merged by a
loser tree, whose root is the next capture, with one comparison for each level of the tree, and handed on as they come. The
result is in global order: part by part, and within a part by position.

Reading. In merged order each record is read back from its archive by offset and length, parsed, and its payload's
digest compared with the header's.

Cases: a null payload is the empty one, a null URL has the empty key, a null id is the largest and is written as "-";
equal ids are records of their own. Columns other than those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import UTC, datetime, timedelta
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small_batches, tidy

#: Digits of base 32 as conv() writes them, and as the digest has them.
PLAIN_32, DIGEST_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
#: Captures of one archive at most, a bound on a run's index in memory.
RUN_ROWS = 50_000
#: Index rows of one range of the merge, about, a bound on what a merging task holds.
MERGE_ROWS = 100_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of the SHA-1: 20 bytes are four groups of five bytes and of eight digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), PLAIN_32, DIGEST_32)


_URL = re.compile(r"(?:[a-z][a-z0-9+.-]*:)?//(?P<host>[^/?#]*)(?P<path>[^?#]*)(?:\?(?P<query>[^#]*))?|(?P<rest>[^#]*)", re.DOTALL)


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, without user, port and "www", then path and query, in lower case.

    Any text has a key: one without a host keeps all before "#" behind ")", and an address in brackets is one label.
    """
    found = _URL.match((url or "").strip().lower())
    if found["host"] is None:
        return ")" + (found["rest"] or "/")
    host = found["host"].rpartition("@")[2]
    head, bracket, _ = host.rpartition("]")
    host = head + bracket if bracket else host.partition(":")[0].removeprefix("www.")
    labels = [host] if bracket else reversed(host.split("."))
    return ",".join(labels) + ")" + (found["path"] or "/") + (f"?{found['query']}" if found["query"] else "")


def plan_captures(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, digest, bytes, refers_to): refers_to is null for responses."""
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    own = own.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    # Only repeated payloads need the join's other side, and what very many captures share is broadcast to them.
    first = own.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    key = F.concat_ws(":", "digest", "bytes").alias("key")
    groups = materialize(first.select(key, "first", "copies"))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > max(1000, total // 50_000)
    large, small = groups.where(hot).select("key", F.col("first").alias("f1")), groups.where(~hot).select("key", F.col("first").alias("f2"))
    # A row that has its answer from the broadcast is spread by its id, so hot payloads don't meet in the second join.
    both = own.withColumn("key", key).join(F.broadcast(large), "key", "left")
    both = both.withColumn("key", F.when(F.col("f1").isNull(), F.col("key")).otherwise(F.concat(F.lit("id "), F.coalesce(F.col("id").cast("string"), F.lit(""))))).join(small, "key", "left")
    return both.select("id", "url", "payload", "digest", "bytes", F.coalesce("f1", "f2").alias("first")).select("id", "url", "payload", "digest", "bytes", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(kind: str, page: str, url: str, when: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {url}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    return headers, rest[:n]


RUN = pa.schema([("url_key", pa.string()), ("time", pa.int64()), ("page", pa.int64()), ("run", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def when_of(page: int | None) -> int:
    """Seconds since 2024-01-01 for a table without a time column: pages were captured in the order of their ids."""
    return (page or 0) % (1 << 31)


def write_runs(captures: DataFrame, folder: str) -> DataFrame:
    """Write archives below folder; the index rows, each task's sorted."""
    small_batches(captures.sparkSession)

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        out, name, index, at = None, "", [], 0

        def close():
            nonlocal out, index
            if out is not None:
                out.close()
                index.sort()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), RUN, strict=True)], schema=RUN)
            out, index = None, []

        for batch in batches:
            for page, url, payload, digest, size, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                seconds = when_of(page)
                line = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                data = record("response" if first is None else "revisit", "-" if page is None else str(page), line, (EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ"), digest, size, payload.encode() if first is None else b"", None if first is None else str(first))
                member = zlib.compress(data, 1, 31)
                out.write(member)
                index.append((url_key(url), seconds, (1 << 62) if page is None else page, name, at, len(member)))
                at += len(member)
                if len(index) >= RUN_ROWS:
                    yield from close()
        yield from close()

    return captures.select("id", "url", "payload", "digest", "bytes", "refers_to").mapInArrow(tidy(run), "url_key string, time long, page long, run string, offset long, length long")


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, so the next winner replays one path only."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * len(runs)
        self.loser = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _key(self, i: int):
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, i: int, j: int) -> bool:
        a, b = self._key(i), self._key(j)
        return b is None if a is None else b is None or (a, i) < (b, j)

    def _play(self, i: int) -> None:
        """Let run i rise; the root ends as the overall winner. A match with an empty place waits there while the tree is built."""
        node = (i + self.k) // 2
        while node > 0:
            other = self.loser[node]
            if other == -1:
                self.loser[node] = i
                return
            if not self._beats(i, other):
                self.loser[node], i = i, other
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.runs:
            i = self.loser[0]
            item = self._key(i)
            if item is None:
                return
            yield item
            self.at[i] += 1
            self._play(i)


def merge_runs(index: DataFrame, parts: int) -> DataFrame:
    """Index rows in global order: range partitions, each a loser-tree merge of its share of the runs."""
    cols = ["url_key", "time", "page", "run", "offset", "length"]

    def run(batches):
        runs: dict[str, list] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                runs.setdefault(row[3], []).append(row)
        merged = iter(LoserTree([runs[r] for r in sorted(runs)]))
        while part := list(islice(merged, 2000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), RUN, strict=True)], schema=RUN)

    dealt = index.select(*cols).repartitionByRange(parts, "url_key", "time", "page", "run", "offset").sortWithinPartitions("run", "url_key", "time", "page", "offset")
    return dealt.mapInArrow(tidy(run), "url_key string, time long, page long, run string, offset long, length long")


def read_records(merged: DataFrame, folder: str, id_kind: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, url_key, payload) of each record, as the archives have it."""
    small_batches(merged.sparkSession, 500)

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for b in batches:
            keys, names, offsets, lengths = (b.column(i).to_pylist() for i in (0, 3, 4, 5))
            got: list = [None] * len(names)
            opened, handle = None, None
            for i in np.lexsort((np.array(offsets), np.array(names))):
                if names[i] != opened:
                    if handle is not None:
                        handle.close()
                    opened, handle = names[i], store.open_input_file(f"{base}/{names[i]}")
                headers, payload = parse(zlib.decompress(handle.read_at(lengths[i], offsets[i]), 31))
                digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload at {names[i]}, {offsets[i]} has another digest")
                page = headers["WARC-Record-ID"][10:-1]
                first = headers["WARC-Refers-To"][10:-1] if kind == "revisit" else None
                got[i] = (None if page == "-" else int(page), int(headers["X-Payload-Length"]), digest, kind, None if first is None else int(first), headers["WARC-Target-URI"], keys[i], payload.decode() if kind == "response" else None)
            if handle is not None:
                handle.close()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True) if got else [[]] * 8, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "url_key", "payload"])

    out = merged.mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, payload string")
    return out


def capture_histories(pages: DataFrame, *, parts: int | None = None, **names) -> DataFrame:
    """Write pages as WARC archives, merge their indexes, and read every record back in the merged order."""
    spark = pages.sparkSession
    folder = shared_dir(spark)
    index = materialize(write_runs(plan_captures(pages, **names), folder))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // MERGE_ROWS))
    return read_records(merge_runs(index, parts), folder)
