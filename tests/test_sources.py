import bz2
import gzip
import io
import time
import zipfile

import pytest
import zstandard

from cordwood.sources import exported, lines, merge, tail
from pyspark.sql import functions as F


def test_splitter():
    s = lines.LineSplitter()
    assert s.append(b"a\r\nb\rc\n\nd") == ["a", "b\rc", ""] and s.append(b"e\r\r\n") == ["de\r"] and s.append(b"x") == [] and s.close() == ["x"] and s.close() == []
    u = lines.LineSplitter("utf-16-le")
    data = "é\nñ\n".encode("utf-16-le")
    assert u.append(data[:5]) == ["é"] and u.append(data[5:]) == ["ñ"]


def test_encodings():
    assert lines.detect_encoding("\ufeffx".encode("utf-8")) == ("utf-8", 3) and lines.detect_encoding("x".encode("utf-16")) == ("utf-16-le", 2)
    assert lines.detect_encoding(b"\x00\x00\xfe\xff") == ("utf-32-be", 4) and lines.detect_encoding(b"caf\xe9") == ("cp1252", 0) and lines.detect_encoding("café".encode()) == ("utf-8", 0)
    assert lines.detect_encoding(("x" + "é" * 40_000).encode()) == ("utf-8", 0)


def test_compression():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("small.log", "s")
        f.writestr("large.log", "large one")
    for data in (gzip.compress(b"t"), bz2.compress(b"t"), zstandard.compress(b"t"), b"t"):
        assert lines.decompress(data) == b"t"
    assert lines.decompress(z.getvalue()) == b"large one" and lines.decompress(z.getvalue(), "small.log") == b"s" and lines.zip_entries(z.getvalue()) == [("small.log", 1), ("large.log", 9)]


def test_read_any(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("\ufeffé\r\nb".encode("utf-16"))
    (tmp_path / "b").write_bytes(gzip.compress(b"x\ny\n"))
    rows = {(r.source.rsplit("/", 1)[1], r.line_number): r.text for r in lines.read_any(spark, str(tmp_path)).collect()}
    assert rows[("b", 1)] == "x" and rows[("b", 2)] == "y" and rows[("a.log", 2)] == "b"
    assert lines.read_any(spark, str(tmp_path / "a.log"), include_unterminated=False).count() == 1
    assert lines.newest_file(spark, str(tmp_path), "*.log").endswith("a.log")


def test_read_lines_numbers_over_splits(spark, tmp_path):
    texts = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "big.log").write_text("\r\n".join(texts))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = lines.read_lines(spark, str(tmp_path / "big.log"))
        assert rows.rdd.getNumPartitions() > 1 and [r.text for r in rows.orderBy("line_number").collect()] == texts
        assert [r.line_number for r in lines.line_window(rows, 2, 5, 1).orderBy("line_number").collect()] == [1, 2, 3] and lines.line_range(rows, 10, 3).count() == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_merge(spark):
    rows = [("a", 1, "2026-01-01 00:00:01 a1"), ("a", 2, "more"), ("a", 3, "2026-01-01 00:00:03 a3"), ("b", 1, "head"), ("b", 2, "2026-01-01 00:00:02 b2"), ("b", 3, "2026-01-01 00:00:04 b3")]
    df = spark.createDataFrame(rows, "source string, line_number long, text string")
    got = [(r.line_number, r.text) for r in merge.merge(df, {"a": "A"}).orderBy("line_number").collect()]
    assert got == [(1, "b│ head"), (2, "A│ 2026-01-01 00:00:01 a1"), (3, "A│ more"), (4, "b│ 2026-01-01 00:00:02 b2"), (5, "A│ 2026-01-01 00:00:03 a3"), (6, "b│ 2026-01-01 00:00:04 b3")]
    assert merge.assign_labels(["/x/app.log", "C:\\y\\App.txt", "z.log", "q/app.log"]) == ["app", "App#2", "z", "app#3"]
    assert [r[0] for r in spark.createDataFrame([("a│ x│y",), ("none",), (None,)], "t string").select(merge.strip_label(F.col("t"))).collect()] == ["x│y", "none", None]


def test_exported_rows(spark):
    df = spark.sql("SELECT timestamp'2026-01-02 03:04:05.678901' AS t, map('b', '2', 'a', '1') AS p")
    row = df.select(exported.event_log_line(F.col("t"), F.lit(None).cast("string"), F.lit("P"), F.lit("a\r\n b ")), exported.provider_line(F.col("t"), F.lit("Info"), F.lit("P"), F.lit("E"), F.col("p"))).first()
    assert tuple(row) == ("2026-01-02 03:04:05 [Information] P: a b", "03:04:05.678901 [Info] P/E a=1 b=2")


def test_container_commands():
    assert exported.container_command("docker", "web", tail=5) == ["docker", "logs", "-f", "--tail", "5", "web"]
    assert exported.container_command("kubectl", "pod-1", namespace="n", container="c") == ["kubectl", "logs", "-f", "-n", "n", "-c", "c", "pod-1"]
    with pytest.raises(ValueError):
        exported.container_command("docker", "a; rm -rf /")
    assert exported.parse_names("pod/a\n\n b \n") == ["a", "b"]


def test_remote_helpers():
    assert tail.sse_data(["data: a", "event: x", ": c", "id: 1", "", "plain", "data:b"]) == ["a", "plain", "b"]
    assert tail.poll_difference(2, ["a", "b", "c"]) == (["c"], 3, False) and tail.poll_difference(3, ["z"]) == (["z"], 1, True)
    assert tail.split_message("a\r\nb\n") == ["a", "b"] and tail.split_message("") == [] and [tail.backoff(n) for n in (1, 3, 99)] == [2, 6, 30]


def test_tail_reader(tmp_path):
    path = tmp_path / "x.log"
    path.write_text("1\n2\n3\npart")
    r = tail.FileTailReader({"path": str(path), "lastLines": "2"})
    first = r.initialOffset()
    rows, offset = r.read(first)
    rows = list(rows)
    assert [(x[2], x[3], x[4]) for x in rows] == [(2, 2, "2"), (3, 4, "3")] and offset["line"] == 3
    with path.open("a") as f:
        f.write("ial\n5\n")
    more, offset2 = r.read(offset)
    assert [(x[2], x[4]) for x in more] == [(4, "partial"), (5, "5")] and list(r.read(offset2)[0]) == []
    assert [x[4] for x in r.readBetweenOffsets(offset, offset2)] == ["partial", "5"]
    path.write_text("new\n")
    cut, offset3 = r.read(offset2)
    assert [(x[1], x[2], x[4], x[5]) for x in cut] == [(1, 0, "", "Truncated"), (1, 1, "new", None)]
    path.unlink()
    gone, _ = r.read(offset3)
    assert [x[5] for x in gone] == ["Deleted"]


def test_first_look_at_any_size_and_long_lines(tmp_path):
    path = tmp_path / "big.log"
    path.write_bytes(b"".join(b"%06d\r\n" % i for i in range(1, 30_001)))
    r = tail.FileTailReader({"path": str(path), "lastLines": "3", "maxbytes": "1000"})
    rows, offset = r.read(r.initialOffset())
    assert [(x[2], x[3], x[4]) for x in rows] == [(n, (n - 1) * 8, f"{n:06d}") for n in (29_998, 29_999, 30_000)] and offset["byte"] == 240_000
    path.write_bytes(b"x" * 5000 + b"\nend\n")
    r = tail.FileTailReader({"path": str(path), "maxbytes": "1000"})
    got, offset = [], r.initialOffset()
    for _ in range(3):
        more, offset = r.read(offset)
        got += [(x[2], x[3], len(x[4])) for x in more]
    assert got == [(1, 0, 5000), (2, 5001, 3)]
    path.write_bytes("\ufeffa\r\nb\u010a\n".encode("utf-16-le"))
    rows, _ = tail.FileTailReader({"path": str(path)}).read(r.initialOffset())
    assert [(x[2], x[3], x[4]) for x in rows] == [(1, 2, "a"), (2, 8, "b\u010a")]


def serve(answer):
    """A server on a free port that gives answer(connection) for each connection; returns the port."""
    import socket
    import threading

    server = socket.create_server(("127.0.0.1", 0))

    def run():
        while True:
            link, _ = server.accept()
            with link:
                answer(link)

    threading.Thread(target=run, daemon=True).start()
    return server.getsockname()[1]


def taken(reader, n):
    offset, rows, until = reader.initialOffset(), [], time.time() + 10
    while len(rows) < n and time.time() < until:
        more, offset = reader.read(offset)
        rows += list(more)
        time.sleep(0.05)
    return rows, offset


def test_server_sent_events_and_spool(tmp_path):
    def answer(link):
        link.recv(4096)
        link.sendall(b"HTTP/1.1 200 OK\r\nContent-Type: text/event-stream\r\n\r\nevent: log\ndata: one\n\n: ping\ndata: two\n\n")
        time.sleep(5)

    r = tail.HttpStreamReader({"url": f"http://127.0.0.1:{serve(answer)}/", "spool": str(tmp_path / "spool")})
    rows, offset = taken(r, 2)
    assert [(x[2], x[4]) for x in rows] == [(1, "one"), (2, "two")] and offset["line"] == 2
    again = tail.Feed({"spool": str(tmp_path / "spool")}, "x")  # after a restart the planned batch is still there
    assert [x[4] for x in again.readBetweenOffsets({"line": 0, "epoch": 0}, offset)][:1] == ["one"]
    again.commit(offset)
    assert list((tmp_path / "spool").iterdir()) == []


def test_websocket():
    def frame(code, body, last=True, size=None):
        head = bytes([(0x80 if last else 0) | code])
        return head + (bytes([len(body)]) if len(body) < 126 else bytes([126]) + len(body).to_bytes(2, "big")) + body

    def answer(link):
        link.recv(4096)
        link.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\n\r\n")
        link.sendall(frame(1, b"a\r\nb", False) + frame(9, b"hi") + frame(0, b"c\n") + frame(1, b"x" * 300) + frame(8, b""))
        time.sleep(5)

    rows, _ = taken(tail.WebSocketReader({"url": f"ws://127.0.0.1:{serve(answer)}/live"}), 3)
    assert [x[4] for x in rows] == ["a", "bc", "x" * 300]


def test_line_index(spark, tmp_path):
    path, store = tmp_path / "i.log", str(tmp_path / "index")
    path.write_bytes(b"".join(b"line %d \xc3\xa9\r\n" % i for i in range(1, 5001)))
    index = lines.line_index(spark, str(path), store)
    source = index.first().source
    assert sorted(r.line_number for r in index.collect()) == [0, 1, 1025, 2049, 3073, 4097]
    assert lines.read_page(index, source, 2050, 3) == [(n, f"line {n} é") for n in (2050, 2051, 2052)] and lines.read_page(index, source, 5000, 9) == [(5000, "line 5000 é")]
    written = len(list((tmp_path / "index").glob("*.parquet")))
    assert lines.line_index(spark, str(path), store).count() == 6 and len(list((tmp_path / "index").glob("*.parquet"))) == written
    with path.open("ab") as f:
        f.write(b"more\n")
    assert lines.line_index(spark, str(path), store).where("line_number = 0").first().byte_offset == 5001


def test_folder_tail(tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_text("a1\n")
    r = tail.FileTailReader({"folder": str(tmp_path), "pattern": "*.log"})
    _, offset = r.read(r.initialOffset())
    time.sleep(0.02)
    b.write_text("b1\n")
    rows, _ = r.read(offset)
    assert [(x[4], x[5]) for x in rows] == [("", "Switched"), ("b1", None)]
