"""Growing files, HTTP and process output as streaming data sources."""

from __future__ import annotations

import base64
import json
import os
import re
import socket
import ssl
import struct
import subprocess
import threading
import time
import urllib.request
import uuid
from collections import deque
from collections.abc import Iterator
from glob import glob

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from cordwood.sources.lines import LineSplitter, detect_encoding

SCHEMA = "source string, epoch int, line_number long, byte_offset long, text string, marker string"


def check(path: str, identity: list | None, size: int) -> str | None:
    """What happened to a file since identity and size were noted: Deleted, Rotated, Truncated or None."""
    try:
        now = os.stat(path)
    except FileNotFoundError:
        return "Deleted"
    if identity and [now.st_dev, now.st_ino] != list(identity):
        return "Rotated"
    return "Truncated" if now.st_size < size else None


def newest(folder: str, pattern: str) -> str | None:
    found = [(os.stat(p).st_mtime, p) for p in glob(os.path.join(folder, pattern)) if os.path.isfile(p)]
    return max(found)[1] if found else None


def _whole_lines(data: bytes, newline: bytes) -> tuple[list[bytes], bytes]:
    """(lines without their breaks, what is left); a break of several bytes counts only at its own step."""
    if len(newline) == 1:
        *whole, rest = data.split(newline)
        return whole, rest
    whole, begin, at = [], 0, data.find(newline)
    while at >= 0:
        if at % len(newline) == 0:
            whole.append(data[begin:at])
            begin = at + len(newline)
        at = data.find(newline, at + 1)
    return whole, data[begin:]


def _last(f, start: int, size: int, newline: bytes, n: int) -> tuple[int, int]:
    """(byte, lines before it) where the last n whole lines of a file begin: its breaks are counted block by block, and
    the places of the last n + 1 are kept."""
    places: deque[int] = deque([start], n + 1)
    lines, at = 0, start
    f.seek(start)
    while at < size and (block := f.read(1 << 20 if len(newline) == 1 else (1 << 20) // len(newline) * len(newline))):
        k = block.find(newline)
        while k >= 0:
            if k % len(newline) == 0:
                lines += 1
                places.append(at + k + len(newline))
            k = block.find(newline, k + 1)
        at += len(block)
    return places[0], max(0, lines - n)


class FileTailReader(SimpleDataSourceStreamReader):
    """Reads what was appended since the last offset {path, id, byte, line, epoch}; unfinished lines wait.

    A rotated, truncated or deleted file, or a newer one in a watched folder, gives a marker row numbered 0, then the
    file from its beginning under the next epoch. At most max_bytes are read at a time.
    """

    def __init__(self, options: dict):
        self.path, self.folder, self.pattern = options.get("path"), options.get("folder"), options.get("pattern", "*")
        self.last_lines, self.most = int(options.get("lastlines", options.get("lastLines", 1000))), int(options.get("maxbytes", 16 << 20))

    def _file(self, offset: dict) -> str | None:
        return newest(self.folder, self.pattern) or offset.get("path") if self.folder else self.path

    def initialOffset(self) -> dict:
        return {"path": self._file({}) or "", "id": [], "byte": 0, "line": 0, "epoch": 0, "skip": -1}

    def _slice(self, offset: dict) -> tuple[list[tuple], dict]:
        path = self._file(offset)
        if not path:
            return [], offset
        rows, at = [], dict(offset)
        event = "Switched" if offset["path"] and path != offset["path"] else check(path, offset["id"], offset["byte"])
        if event == "Deleted" and not offset["byte"]:
            return [], offset
        if event and (offset["byte"] or event == "Switched"):
            rows.append((path, offset["epoch"] + 1, 0, 0, "", event))
            at = {"path": path, "id": [], "byte": 0, "line": 0, "epoch": offset["epoch"] + 1, "skip": 0}
        if event == "Deleted":
            return rows, at
        with open(path, "rb") as f:
            info = os.fstat(f.fileno())
            encoding, mark = detect_encoding(f.read(64 * 1024))
            newline = LineSplitter(encoding).newline
            at |= {"path": path, "id": [info.st_dev, info.st_ino], "byte": at["byte"] or mark}
            if at["skip"] < 0:  # the first look at a file shows its last lines only, however large it is
                at |= dict(zip(("byte", "line"), _last(f, at["byte"], info.st_size, newline, self.last_lines)))
            f.seek(at["byte"])
            data = f.read(self.most)
            while newline not in data and (more := f.read(self.most)):  # a line longer than that is read to its end
                data += more
        raw, rest = _whole_lines(data, newline)
        byte = at["byte"]
        for i, part in enumerate(raw):
            text = part.decode(encoding, "replace")
            rows.append((path, at["epoch"], at["line"] + i + 1, byte, text[:-1] if text.endswith("\r") else text, None))
            byte += len(part) + len(newline)
        return rows, at | {"byte": byte, "line": at["line"] + len(raw), "skip": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._slice(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, _ = self._slice(start)
        return (r for r in rows if r[5] or (r[1], r[2]) <= (end["epoch"], end["line"]))

    def commit(self, end: dict) -> None:
        return None


class FileTail(DataSource):
    """format("cordwood_tail"): options path, or folder and pattern; lastLines."""

    @classmethod
    def name(cls) -> str:
        return "cordwood_tail"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FileTailReader(self.options)


# ---- remote and process sources ---------------------------------------------------------------------------------


def sse_data(lines: list[str]) -> list[str]:
    """The data of server-sent event lines; comments, event, id and retry fields and blank lines are dropped, other
    lines stay as they are."""
    out = []
    for x in lines:
        m = re.match(r"^(data|event|id|retry):\s?(.*)$", x)
        if m and m[1] == "data":
            out.append(m[2])
        elif not m and x and not x.startswith(":"):
            out.append(x)
    return out


def poll_difference(seen: int, lines: list[str]) -> tuple[list[str], int, bool]:
    """(new lines, lines seen now, whether the document was cut) of a document that is fetched again and again."""
    cut = len(lines) < seen
    return lines[0 if cut else seen :], len(lines), cut


def split_message(text: str) -> list[str]:
    """Lines of a message; a final line break makes no empty line."""
    parts = [p[:-1] if p.endswith("\r") else p for p in text.split("\n")]
    return parts[:-1] if parts and parts[-1] == "" else parts


def backoff(attempt: int, first: float = 2.0, most: float = 30.0) -> float:
    """Seconds to wait before the attempt-th retry."""
    return min(first * max(1, attempt), most)


class Feed(SimpleDataSourceStreamReader):
    """Lines that can't be read again: those taken for a batch are kept, in memory and, with option spool, as a file in
    that folder, until the batch is committed. With a spool that outlives the process a restarted query gets the batch
    that was planned before it went. Numbers go on from the offset a query starts from."""

    def __init__(self, options: dict, name: str):
        self.source, self.spool = name, options.get("spool")
        self.kept: dict[str, list[tuple]] = {}

    def fresh(self, start: dict) -> tuple[list[tuple], dict]:
        """(rows, offset after them) of what has come since start."""
        raise NotImplementedError

    def initialOffset(self) -> dict:
        return {"line": 0, "epoch": 0}

    def _file(self, key: str) -> str:
        return os.path.join(self.spool, f"batch-{key}.json")

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self.fresh(start)
        if rows:
            key = f"{start['epoch']}-{start['line']}"
            self.kept[key] = rows
            if self.spool:
                os.makedirs(self.spool, exist_ok=True)
                part = f"{self._file(key)}.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8") as f:
                    json.dump(rows, f)
                os.replace(part, self._file(key))
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        key = f"{start['epoch']}-{start['line']}"
        rows = self.kept.get(key)
        if rows is None and self.spool and os.path.exists(self._file(key)):
            with open(self._file(key), encoding="utf-8") as f:
                rows = [tuple(r) for r in json.load(f)]
        return iter(rows or [])

    def commit(self, end: dict) -> None:
        done = lambda key: tuple(map(int, key.split("-"))) < (end["epoch"], end["line"])
        self.kept = {k: v for k, v in self.kept.items() if not done(k)}
        for path in glob(os.path.join(self.spool, "batch-*.json")) if self.spool else ():
            if done(os.path.basename(path)[6:-5]):
                os.remove(path)


class HttpPollReader(Feed):
    """Fetches a document and gives the lines past those seen; a document that shrank starts over with a marker row.
    After a failed fetch the next ones wait longer and longer."""

    def __init__(self, options: dict):
        super().__init__(options, options["url"])
        self.url, self.wait = options["url"], float(options.get("timeout", 10))
        self.failed, self.not_before = 0, 0.0

    def fresh(self, start: dict) -> tuple[list[tuple], dict]:
        if time.monotonic() < self.not_before:
            return [], start
        try:
            with urllib.request.urlopen(self.url, timeout=self.wait) as response:
                lines = split_message(response.read().decode("utf-8", "replace"))
            self.failed = 0
        except OSError:
            self.failed += 1
            self.not_before = time.monotonic() + backoff(self.failed)
            return [], start
        new, seen, cut = poll_difference(start["line"], lines)
        epoch = start["epoch"] + cut
        rows = [(self.url, epoch, 0, 0, "", "Truncated")] if cut else []
        first = 0 if cut else start["line"]
        return rows + [(self.url, epoch, first + i + 1, None, t, None) for i, t in enumerate(new)], {"line": seen, "epoch": epoch}


class ThreadFeed(Feed):
    """Lines that a thread takes from a connection or a process; when that ends it is opened again after growing pauses."""

    first_pause = 2.0

    def __init__(self, options: dict, name: str):
        super().__init__(options, name)
        self.waiting: deque[str] = deque()
        threading.Thread(target=self._run, daemon=True).start()

    def lines(self) -> Iterator[str]:
        """Lines of one connection, until it ends."""
        raise NotImplementedError

    def _run(self) -> None:
        attempt = 0
        while True:
            try:
                for line in self.lines():
                    self.waiting.append(line)
                    attempt = 0
            except (OSError, ValueError):
                pass
            attempt += 1
            time.sleep(backoff(attempt, self.first_pause))

    def fresh(self, start: dict) -> tuple[list[tuple], dict]:
        texts = [self.waiting.popleft() for _ in range(len(self.waiting))]
        rows = [(self.source, start["epoch"], start["line"] + i + 1, None, t, None) for i, t in enumerate(texts)]
        return rows, {"line": start["line"] + len(rows), "epoch": start["epoch"]}


class HttpStreamReader(ThreadFeed):
    """Lines of an endless HTTP response; of server-sent events their data."""

    def __init__(self, options: dict):
        self.url, self.wait = options["url"], float(options.get("timeout", 60))
        super().__init__(options, options["url"])

    def lines(self) -> Iterator[str]:
        asked = urllib.request.Request(self.url, headers={"Accept": "text/event-stream, */*"})
        with urllib.request.urlopen(asked, timeout=self.wait) as response:
            for raw in response:
                yield from sse_data([raw.decode("utf-8", "replace").rstrip("\n").removesuffix("\r")])


class WebSocketReader(ThreadFeed):
    """Lines of the messages of a WebSocket (RFC 6455): text and binary frames, put together where they are parted."""

    def __init__(self, options: dict):
        self.url, self.wait = options["url"], float(options.get("timeout", 60))
        super().__init__(options, options["url"])

    def lines(self) -> Iterator[str]:
        scheme, host, port, target = re.match(r"^(wss?)://([^/:]+)(?::(\d+))?(/.*)?$", self.url).groups()
        raw = socket.create_connection((host, int(port or (443 if scheme == "wss" else 80))), self.wait)
        with ssl.create_default_context().wrap_socket(raw, server_hostname=host) if scheme == "wss" else raw as link:
            key = base64.b64encode(os.urandom(16)).decode()
            link.sendall(
                f"GET {target or '/'} HTTP/1.1\r\nHost: {host}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode()
            )
            stream = link.makefile("rb")
            if b" 101 " not in stream.readline():
                raise OSError("the server opens no WebSocket")
            while stream.readline().strip():
                pass
            message = b""
            while len(head := stream.read(2)) == 2:
                last, code, size = head[0] & 0x80, head[0] & 0x0F, head[1] & 0x7F
                if size > 125:
                    size = struct.unpack(">H" if size == 126 else ">Q", stream.read(2 if size == 126 else 8))[0]
                mask = stream.read(4) if head[1] & 0x80 else b""
                body = stream.read(size)
                if mask:
                    body = bytes(x ^ mask[i % 4] for i, x in enumerate(body))
                if code == 8:
                    return
                if code == 9:  # a ping is answered by its own body, masked
                    link.sendall(bytes([0x8A, 0x80 | len(body)]) + b"\0\0\0\0" + body)
                elif code in (0, 1, 2):
                    message += body
                    if last:
                        yield from split_message(message.decode("utf-8", "replace"))
                        message = b""


class ProcessReader(ThreadFeed):
    """Output lines of a command, started again with growing pauses when it ends."""

    first_pause = 3.0

    def __init__(self, options: dict):
        self.command = options["command"]
        super().__init__(options, options["command"])

    def lines(self) -> Iterator[str]:
        p = subprocess.Popen(self.command, shell=True, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, errors="replace")
        for line in p.stdout:
            yield line.rstrip("\n").removesuffix("\r")


def _source(name_: str, reader: type, doc: str) -> type:
    """The data source of a reader."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return SCHEMA

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return reader(self.options)

    Source.__name__ = Source.__qualname__ = reader.__name__.removesuffix("Reader")
    Source.__doc__ = doc
    return Source


HttpPoll = _source("cordwood_http", HttpPollReader, 'format("cordwood_http"): options url, timeout, spool.')
HttpStream = _source("cordwood_http_stream", HttpStreamReader, 'format("cordwood_http_stream"): options url, timeout, spool.')
WebSocket = _source("cordwood_websocket", WebSocketReader, 'format("cordwood_websocket"): options url (ws or wss), timeout, spool.')
ProcessTail = _source("cordwood_process", ProcessReader, 'format("cordwood_process"): options command, spool.')


def register(spark) -> None:
    for source in (FileTail, HttpPoll, HttpStream, WebSocket, ProcessTail):
        spark.dataSource.register(source)
