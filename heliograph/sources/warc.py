"""Captures from WARC and ARC-less archives: one row per record, read by the executors.

Files are walked record by record through their gzip members, so memory holds one
record's head and never a file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.surt import url_to_surt
from heliograph.sources.flat import collect_files
from heliograph.sources.paths import filesystem

# Record types that are captures, and the endings of archive files.
CAPTURED = ("response", "revisit", "resource", "metadata")
ENDINGS = (".warc", ".warc.gz")
READ = 1 << 20


def archive_files(paths: list[str]) -> list[str]:
    return [f for f in collect_files(paths) if f.endswith(ENDINGS)]


class _Input:
    """Bytes of a plain or gzipped archive, with the file position of each gzip member."""

    def __init__(self, file, zipped: bool):
        self.file, self.zipped, self.held, self.ended = file, zipped, b"", False
        self.raw, self.read, self.used, self.member = b"", 0, 0, None
        self.start = 0

    def _more(self) -> bool:
        if self.ended:
            return False
        if not self.zipped:
            data = self.file.read(READ)
            self.ended = not data
            self.held += data
            return bool(data)
        if self.member is None or self.member.eof:
            return False
        if not self.raw:
            self.raw = self.file.read(READ)
            if not self.raw:
                self.ended = True
                return False
            self.read += len(self.raw)
        data = self.member.decompress(self.raw, READ)
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        self.held += data
        return bool(data) or bool(self.raw) or not self.member.eof

    def next_member(self) -> bool:
        """Begins a record; False at the end of the file."""
        if not self.zipped:
            while not self.held.lstrip(b"\r\n") and self._more():
                pass
            cut = len(self.held) - len(self.held.lstrip(b"\r\n"))
            self.skip(cut)
            self.start = self.used
            return bool(self.held)
        while self.member is not None and not self.member.eof and self._more():
            self.held = b""
        self.held = b""
        if not self.raw:
            self.raw = self.file.read(READ)
            self.read += len(self.raw)
        if not self.raw:
            return False
        self.start, self.member = self.read - len(self.raw), zlib.decompressobj(31)
        return True

    def position(self) -> int:
        """Where the next record begins in the file, once this one is read."""
        if not self.zipped:
            return self.used
        while self.member is not None and not self.member.eof and self._more():
            self.held = b""
        return self.read - len(self.raw)

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while mark not in self.held and len(self.held) < most and self._more():
            pass
        head, found, _ = self.held.partition(mark)
        self.skip(len(head) + len(found))
        return head

    def skip(self, count: int) -> None:
        while count:
            if not self.held and not self._more():
                return
            step = min(count, len(self.held))
            self.held, count, self.used = self.held[step:], count - step, self.used + step

    def take(self, count: int) -> Iterator[bytes]:
        while count and (self.held or self._more()):
            part = self.held[:count]
            self.held, count, self.used = self.held[len(part) :], count - len(part), self.used + len(part)
            if part:
                yield part


def _headers(text: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = re.sub(rb"\r?\n[ \t]+", b" ", text).replace(b"\r\n", b"\n").split(b"\n")
    pairs = (x.partition(b":") for x in lines)
    return first.decode("latin-1"), {k.strip().decode("latin-1").lower(): v.strip().decode("utf-8", "replace") for k, s, v in pairs if s}


def records(file, zipped: bool) -> Iterator[dict]:
    """The captures of an open archive; ends at a broken record, with a ``fault`` that says
    where it begins."""
    data, start = _Input(file, zipped), 0
    try:
        while data.next_member():
            start = data.start
            version, head = _headers(data.until(b"\r\n\r\n"))
            if not version.startswith("WARC/"):
                raise ValueError("no record begins there")
            length = int(head.get("content-length", "0"))
            found = None
            if head.get("warc-type") in CAPTURED and head.get("warc-target-uri"):
                found = _capture(data, head, length)
            else:
                data.skip(length)
            data.skip(0 if zipped else 4)
            if found:
                yield found | {"offset": str(start), "length": str(data.position() - start)}
        if zipped and data.member is not None and not data.member.eof:
            raise EOFError("the last record is cut")
    except (zlib.error, ValueError, EOFError) as e:
        yield {"fault": f"breaks off at {start}: {e}"}


def _capture(data: _Input, head: dict[str, str], length: int) -> dict:
    kind = head["warc-type"]
    status, mime, left = None, head.get("content-type", "").split(";")[0].strip() or None, length
    if kind in ("response", "revisit") and head.get("content-type", "").startswith("application/http"):
        before = data.used
        line, http = _headers(data.until(b"\r\n\r\n", min(length, 1 << 20)))
        left = max(0, length - (data.used - before))
        code = re.match(r"HTTP/\S+ (\d{3})", line)
        status = code[1] if code else None
        mime = http.get("content-type", "").split(";")[0].strip().lower() or None
    digest, own = head.get("warc-payload-digest"), hashlib.sha1()
    for part in data.take(left):
        own.update(part)
    if kind == "revisit":
        mime = "warc/revisit"
    value = digest.split(":", 1)[-1] if digest else base64.b32encode(own.digest()).decode()
    ts = re.sub(r"\D", "", head.get("warc-date", ""))[:14]
    return {"url": head["warc-target-uri"].strip("<>"), "ts": ts, "mime": mime or "unk", "status": status or "-", "digest": value}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["url", "ts", "json", "src_path", "src_pos", "fault"]
    for batch in batches:
        for path in batch["path"].to_pylist():
            system, inner = filesystem(path)
            rows = []
            with system.open_input_stream(inner, compression=None) as file:
                for number, r in enumerate(records(file, path.endswith(".gz"))):
                    if "fault" in r:
                        rows.append((None, None, None, path, number, r["fault"]))
                        continue
                    fields = {k: r[k] for k in ("url", "mime", "status", "digest", "length", "offset")}
                    payload = json.dumps(fields | {"filename": os.path.basename(inner)}, ensure_ascii=False, separators=(",", ":"))
                    rows.append((r["url"], r["ts"], payload, path, number, None))
                    if len(rows) == 5000:
                        yield _batch(rows, names)
                        rows = []
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(),) * 4 + (pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_warcs(spark: SparkSession, paths: list[str], faults: Observation | bool = False) -> DataFrame:
    """CAPTURE rows of archive files; archives are spread over the tasks one by one.

    Records without a target are no captures.  An archive that breaks off gives the
    records before the break.  With ``faults=True`` the breaks come out instead, as ``src_path,
    fault``; given an observation, their number is observed as ``n_faults``.
    """
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    rows = files.mapInArrow(_read, "url string, ts string, json string, src_path string, src_pos long, fault string")
    if faults is True:
        return rows.where("fault is not null").select("src_path", "fault")
    if faults:
        rows = rows.observe(faults, F.count("fault").alias("n_faults"))
    keyed = rows.where("fault is null").withColumn("surt", F.coalesce(url_to_surt(F.col("url")), F.lower("url")))
    value = F.concat_ws(" ", "surt", "ts", "json").alias("value")
    return keyed.select(value, "surt", "ts", "json", "src_path", F.lit(0).cast("long").alias("src_block"), "src_pos")
