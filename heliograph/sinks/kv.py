"""Key/value sinks for path indexes: one hash ``filename -> path`` per name, last write wins."""

from __future__ import annotations

import contextlib
import os
import socket
import ssl
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators.pathindex import upsert

BATCH = 500


class KeyValueSink(Protocol):
    def put(self, entries: DataFrame, name: str, clear: bool) -> tuple[int, int]:
        """Writes ``filename, path``; returns how many were submitted and how many failed."""


class ParquetSink:
    """A hash as a Parquet folder: for tests, and where no server is wanted."""

    def __init__(self, folder: str):
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name.replace(':', '_')}"

    def put(self, entries: DataFrame, name: str, clear: bool = False) -> tuple[int, int]:
        from heliograph.sinks.text import rewrite_parquet

        new = entries.select("filename", "path")
        if not clear and os.path.isdir(self.path(name)):
            old = entries.sparkSession.read.parquet(self.path(name))
            new = old.join(new, "filename", "left_anti").unionByName(new)
        count = entries.count()
        rewrite_parquet(new, self.path(name))
        return count, 0

    def get(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))


@dataclass(frozen=True)
class Server:
    host: str = "localhost"
    port: int = 6379
    db: int = 0
    password: str | None = None
    unix_socket: str | None = None
    tls: bool = False
    timeout: float = 10.0


class Connection:
    """The few commands needed, of the public RESP protocol, with pipelining."""

    def __init__(self, server: Server):
        self.server = server
        if server.unix_socket:
            self.socket = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
            self.socket.settimeout(server.timeout)
            self.socket.connect(server.unix_socket)
        else:
            self.socket = socket.create_connection((server.host, server.port), server.timeout)
            if server.tls:
                self.socket = ssl.create_default_context().wrap_socket(self.socket, server_hostname=server.host)
        self.input = self.socket.makefile("rb")
        setup = [["AUTH", server.password]] if server.password else []
        setup += [["SELECT", str(server.db)]] if server.db else []
        for answer in self.run(setup):
            if isinstance(answer, Exception):
                raise answer

    def run(self, commands: list[list[str]]) -> list[object]:
        """Sends all commands at once; an error reply becomes an exception in the result."""
        parts = []
        for command in commands:
            parts.append(b"*%d\r\n" % len(command))
            for word in command:
                data = word.encode()
                parts.append(b"$%d\r\n%s\r\n" % (len(data), data))
        self.socket.sendall(b"".join(parts))
        return [self._reply() for _ in commands]

    def _reply(self) -> object:
        line = self.input.readline()
        if not line.endswith(b"\r\n"):
            raise ConnectionError("the server closed the connection")
        kind, text = line[:1], line[1:-2]
        if kind == b"-":
            return RuntimeError(text.decode())
        if kind == b":":
            return int(text)
        if kind == b"$":
            size = int(text)
            return None if size < 0 else self.input.read(size + 2)[:-2].decode()
        if kind == b"*":
            return [self._reply() for _ in range(int(text))]
        return text.decode()

    def close(self) -> None:
        self.input.close()
        self.socket.close()


#: Redirections of one command that are followed.
HOPS = 8


class Routed:
    """Commands for one hash of a cluster of servers, which may move while it is written.

    ``MOVED`` goes on with the server it names, ``ASK`` asks that server for the refused commands
    only, and after ``TRYAGAIN`` they are sent again.
    """

    def __init__(self, server: Server):
        self.link = Connection(server)

    def run(self, commands: list[list[str]]) -> list[object]:
        answers = self.link.run(commands)
        for _ in range(HOPS):
            words = {i: str(a).split(" ") for i, a in enumerate(answers) if isinstance(a, RuntimeError)}
            again = [i for i, w in words.items() if w[0] in ("MOVED", "ASK", "TRYAGAIN")]
            if not again:
                break
            word = words[again[0]]
            again = [i for i in again if words[i] == word]
            wanted = [commands[i] for i in again]
            if word[0] == "MOVED":
                home = self._at(word[2])
                self.link.close()
                self.link = Connection(home)
                found = self.link.run(wanted)
            elif word[0] == "ASK":
                with contextlib.closing(Connection(self._at(word[2]))) as other:
                    found = other.run([x for command in wanted for x in (["ASKING"], command)])[1::2]
            else:
                time.sleep(0.1)
                found = self.link.run(wanted)
            for i, answer in zip(again, found):
                answers[i] = answer
        return answers

    def _at(self, place: str) -> Server:
        host, _, port = place.rpartition(":")
        return replace(self.link.server, host=host or self.link.server.host, port=int(port), unix_socket=None)

    def close(self) -> None:
        self.link.close()


class ServerSink:
    """Hashes of a key/value server; every partition opens its own connection.

    In a cluster of servers a hash lives on one of them, which the first reply names, and
    later replies if it moves.  Writes are idempotent, so a task that is repeated does no
    harm.
    """

    def __init__(self, server: Server, batch_size: int = BATCH, dry_run: bool = False):
        if batch_size < 1:
            raise ValueError("a batch has at least one entry")
        self.server, self.batch_size, self.dry_run = server, batch_size, dry_run

    def _home(self, name: str) -> Server:
        with contextlib.closing(Routed(self.server)) as link:
            link.run([["HLEN", name]])
            return link.link.server

    def put(self, entries: DataFrame, name: str, clear: bool = False) -> tuple[int, int]:
        """A server that cannot be reached gives (0, 1)."""
        if self.dry_run:
            return entries.count(), 0
        try:
            home = self._home(name)
            if clear:
                with contextlib.closing(Routed(home)) as link:
                    link.run([["DEL", name]])
        except OSError:
            return 0, 1
        batch_size = self.batch_size

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = failed = 0
            with contextlib.closing(Routed(home)) as link:
                for batch in batches:
                    pairs = list(zip(batch["filename"].to_pylist(), batch["path"].to_pylist()))
                    for i in range(0, len(pairs), batch_size):
                        answers = link.run([["HSET", name, k, v] for k, v in pairs[i : i + batch_size]])
                        wrong = sum(isinstance(a, Exception) for a in answers)
                        sent, failed = sent + len(answers) - wrong, failed + wrong
            yield pa.RecordBatch.from_arrays([pa.array([sent]), pa.array([failed])], names=["sent", "failed"])

        counts = entries.select("filename", "path").mapInArrow(send, "sent long, failed long").agg(F.sum("sent"), F.sum("failed")).first()
        return counts[0] or 0, counts[1] or 0


def load(entries: DataFrame, sink: KeyValueSink, name: str, clear: bool = False) -> tuple[int, int]:
    """Writes a path index to a hash, of repeated names the last entry."""
    return sink.put(upsert(entries), name, clear)
