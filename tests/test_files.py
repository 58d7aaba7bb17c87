import datetime
import gzip
import os
import random
import socketserver
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from heliograph import runtime
from heliograph.cli import main
from heliograph.operators.blocklist import Blocklist
from heliograph.operators.merge import order_violations
from heliograph.plans import collection, lookup
from heliograph.schema import IDX
from heliograph.sinks import kv
from heliograph.sinks import zipnum as writer
from heliograph.sinks.text import captures_table, write_by_period, write_one_file
from heliograph.sources import flat, warc, zipnum
from heliograph.streaming.ingest import ingest


def put(path, text, zipped=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = text.encode()
    path.write_bytes(gzip.compress(data) if zipped else data)
    return str(path)


def values(df):
    return [r.value for r in df.collect()]


# ------------------------------------------------ flat sources


def test_discovery(tmp_path):
    for name in ("a.cdxj", "b.cdxj.gz", "b.idx", "c.txt", "d/e.cdxj", "d/skip-me.cdxj"):
        put(tmp_path / name, "x")
    names = lambda found: [os.path.relpath(f, tmp_path) for f in found]
    assert names(flat.collect_files([str(tmp_path), str(tmp_path / "none")], ["*skip*", "*.txt"])) == ["a.cdxj", "b.cdxj.gz", "b.idx", "d/e.cdxj"]
    assert names(flat.discover([str(tmp_path)])) == ["a.cdxj", "b.cdxj.gz", "b.idx", "d/e.cdxj", "d/skip-me.cdxj"]
    assert names(flat.discover([str(tmp_path / "**/*.cdxj"), str(tmp_path / "a.cdxj")])) == ["a.cdxj", "d/e.cdxj", "d/skip-me.cdxj"]
    assert [flat.file_type(x) for x in ("a.idx", "a.cdxj.gz", "a.cdxj", "a")] == ["zipnum_idx", "zipnum_data", "cdxj", "cdxj"]
    plain, indexes = flat.resolve_inputs(flat.discover([str(tmp_path)]))
    assert names(indexes) == ["b.idx"] and len(plain) == 3
    with pytest.raises(FileNotFoundError):
        flat.index_of_data(str(tmp_path / "z.cdxj.gz"))
    uri = f"file://{tmp_path}"
    assert [f.removeprefix(uri) for f in flat.discover([uri])] == ["/" + f for f in names(flat.discover([str(tmp_path)]))]
    assert flat.discover([f"{uri}/**/e.*"]) == [f"{uri}/d/e.cdxj"] and flat.collect_files([f"{uri}/d"], ["e*"]) == [f"{uri}/d/skip-me.cdxj"]


def test_lines_keep_their_order(spark, tmp_path):
    files = {"b": [f"b{i}" for i in range(3000)], "a": ["a1"], "c": [f"c{i}" for i in range(50)]}
    for name, lines in files.items():
        put(tmp_path / name, "\n".join(lines))
    got = values(flat.read_lines(spark, str(tmp_path)).orderBy("src_path", "src_block", "src_pos"))
    assert got == files["a"] + files["b"] + files["c"]


def test_line_ends_gzip_and_utf8(spark, tmp_path):
    assert values(flat.read_lines(spark, put(tmp_path / "x", "a\r\nb\rc\n"))) == ["a", "b", "c"]
    assert values(flat.read_lines(spark, put(tmp_path / "y", "a\rb\n"), exact=True)) == ["a\rb"]
    assert values(flat.read_lines(spark, put(tmp_path / "z.gz", "a\nb\n", zipped=True))) == ["a", "b"]
    (tmp_path / "u").write_bytes(b"ok)/ 1\nb\xff)/ 1\n")
    assert flat.read_captures(spark, str(tmp_path / "u"), "skip").count() == 1
    assert [r.surt for r in flat.read_captures(spark, str(tmp_path / "u"), "repair").collect()] == ["ok)/", "b�)/"]
    with pytest.raises(ValueError):
        flat.read_captures(spark, str(tmp_path / "u"), "what")


def test_small_lists(spark, tmp_path):
    assert [tuple(r)[:2] for r in flat.read_path_index(spark, put(tmp_path / "p", "# c\n\n f\t/a b\t/c \nonly\n\tx\n")).collect()] == [("f", "/a b")]
    assert [r.surt for r in flat.read_excessive_list(spark, put(tmp_path / "e", "a)/ 5\n#x\n  \nb)/\n")).collect()] == ["a)/", "b)/"]
    assert len(flat.read_blocklist(spark, put(tmp_path / "b", "#x\n\n^a\n"))) == 1
    put(tmp_path / "d/2.txt", "x")
    put(tmp_path / "d/1.txt", "x")
    put(tmp_path / "d/e/3.txt", "x")
    assert [os.path.basename(f) for f in flat.arclist_files(str(tmp_path / "d"))] == ["1.txt", "2.txt"]
    with pytest.raises(ValueError):
        flat.arclist_files(str(tmp_path / "none"))


# ------------------------------------------------ clusters


def lines(n, seed=1):
    rng = random.Random(seed)
    return [f'com,h{rng.randrange(9)})/p{rng.randrange(n)} {20200101000000 + i} {{"n":"{rng.getrandbits(200):x}"}}' for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(x, "extra") for x in rows], "value string, line string")


@pytest.mark.parametrize("n,chunk,mb", [(20, 5, 100), (1000, 100, 0.01), (1, 3000, 100), (7, 7, 0)])
def test_round_trip(spark, tmp_path, n, chunk, mb):
    rows = lines(n)
    out = str(tmp_path / "base")
    index = writer.write_zipnum(frame(spark, rows), out, chunk_size=chunk, shard_size_mb=mb).collect()
    ordered = sorted(rows)
    assert [r.key for r in sorted(index, key=lambda r: (r.shard_num, r.offset))] == [x.split("{")[0].strip() for x in ordered[::chunk]]
    assert sorted(values(zipnum.read_zipnum(spark, f"{out}/base.idx"))) == ordered
    assert [r.value for r in zipnum.read_zipnum(spark, f"{out}/base.idx").orderBy("src_block", "src_pos").collect()] == ordered
    shards = sorted({r.shard for r in index})
    assert shards == (["base.cdx.gz"] if len(shards) == 1 else [f"base-{i:02d}.cdx.gz" for i in range(1, len(shards) + 1)])
    assert sorted(os.listdir(out)) == sorted(["base.idx", "base.loc", *shards])
    whole = b"".join(gzip.decompress(open(f"{out}/{s}", "rb").read()) for s in shards)
    assert whole.decode().splitlines() == ordered
    assert {tuple(r) for r in zipnum.read_idx(spark, f"{out}/base.idx").collect()} == {tuple(r) for r in index}
    assert zipnum.read_loc(spark, f"{out}/base.loc").count() == len(shards)
    for key in {x.split(" ")[0] for x in rows[:6]}:
        found = zipnum.read_zipnum(spark, f"{out}/base.idx").where(F.col("surt") == key)
        assert sorted(values(found)) == [x for x in ordered if x.split(" ")[0] == key]
    assert sorted(values(zipnum.read_zipnum(spark, f"{out}/base.idx").where(F.col("surt").startswith("com,h3")))) == [x for x in ordered if x.startswith("com,h3")]


def test_groups_of_chunks_begin_new_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writer, "GROUP", 4)
    rows = lines(100)
    index = writer.write_zipnum(frame(spark, rows), str(tmp_path / "g"), chunk_size=10).orderBy("shard_num", "offset").collect()
    assert [r.shard for r in index] == ["g-01.cdx.gz"] * 4 + ["g-02.cdx.gz"] * 4 + ["g-03.cdx.gz"] * 2
    assert [r.value for r in zipnum.read_zipnum(spark, str(tmp_path / "g/g.idx")).orderBy("src_block", "src_pos").collect()] == sorted(rows)


def test_uris(spark, tmp_path):
    writer.write_zipnum(frame(spark, lines(30)), f"file://{tmp_path}/u v", chunk_size=10)
    assert zipnum.read_zipnum(spark, f"file://{tmp_path}/u v/u v.idx").count() == 30


def test_empty_cluster(spark, tmp_path):
    assert writer.write_zipnum(frame(spark, []), str(tmp_path / "e")).count() == 0
    assert zipnum.read_zipnum(spark, str(tmp_path / "e/e.idx")).count() == 0


def test_options(spark, tmp_path):
    writer.write_zipnum(frame(spark, lines(300)), str(tmp_path / "o"), base="b", chunk_size=10, shard_size_mb=0, single_shard=True, idx_name="i", loc_name="l")
    assert sorted(os.listdir(tmp_path / "o")) == ["b.cdx.gz", "i", "l"]
    for wrong in ({"chunk_size": 0}, {"compress_level": 10}):
        with pytest.raises(ValueError):
            writer.write_zipnum(frame(spark, []), str(tmp_path / "w"), **wrong)


def test_fill_shards():
    assert writer.fill_shards([5, 5, 5, 20, 1], 10) == [(1, 0), (1, 5), (2, 0), (2, 5), (3, 0)]
    assert writer.fill_shards([], 10) == []


def test_only_candidate_blocks_are_read(spark, tmp_path):
    keys = ["a)/ 1", "b)/ 1", "b)/ 5", "c)/ 1", "d)/ 1"]
    assert list(zipnum.candidate_blocks(keys, "b)/", False)) == [0, 1, 2]
    assert list(zipnum.candidate_blocks(keys, "c", True)) == [2, 3]
    assert list(zipnum.candidate_blocks(keys, "0", False)) == [0][:0] + list(range(0, 0))
    assert list(zipnum.candidate_blocks(keys, "z", False)) == [4]
    assert list(zipnum.candidate_blocks(["a)/", "b)/"], "b)/", False)) == [0, 1]


def test_broken_and_foreign_blocks(spark, tmp_path):
    one, two = gzip.compress(b"a)/ 1\n\nbad\xff 1\n"), gzip.compress(b"b)/ 2 {\"x\":1}\r\n")
    (tmp_path / "s-01.cdx.gz").write_bytes(one + b"garbage!" + two)
    rows = [("a)/ 1", "s-01", 0, len(one)), ("x", "s-01", len(one), 8), ("b)/ 2", "s-01", len(one) + 8, len(two)), ("c", "gone", 0, 5), ("d", "s-01", 0, 10)]
    idx = put(tmp_path / "s.idx", "# comment\n" + "".join(f"{k}\t{s}\t{o}\t{n}\t1\n" for k, s, o, n in rows))
    got = [(r.surt, r.ts, r.json) for r in zipnum.read_zipnum(spark, idx).orderBy("surt").collect()]
    assert got == [("a)/", "1", None), ("b)/", "2", '{"x":1}')]
    put(tmp_path / "s.idx", open(idx).read() + "few\tcolumns\ne\ts-01\t-1\t5\t1\n")
    faults = zipnum.read_zipnum(spark, idx, faults=True).collect()
    assert sorted(r.fault for r in faults) == ["bad index row", "broken block", "broken block", "no possible block", "no such shard", "not UTF-8"]
    seen = Observation()
    assert zipnum.read_zipnum(spark, idx, faults=seen).count() == 2 and seen.get == {"n_faults": 6}


@pytest.mark.parametrize("name,shard", [("x.cdxj.gz", "x.cdxj.gz"), ("x.cdxj.gz", "x"), ("x.cdx.gz", "x"), ("x.cdx.gz", "x.cdx.gz")])
def test_endings_and_replacement_characters(spark, tmp_path, name, shard):
    data = gzip.compress("a)/\ufffd 1 {\"t\":\"\ufffd\"}\n".encode())
    (tmp_path / name).write_bytes(data)
    idx = put(tmp_path / "x.idx", f"a)/ 1\t{shard}\t0\t{len(data)}\t1\n")
    assert [r.surt for r in zipnum.read_zipnum(spark, idx).collect()] == ["a)/\ufffd"]


@pytest.mark.parametrize("piece", [16, 1 << 16])
def test_search_over_the_bytes_of_an_index(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(zipnum, "SLICE", piece)
    rng = random.Random(2)
    for n in (0, 1, 2, 50):
        keys = sorted(f"{rng.choice('abc')}{rng.choice(['', 'é', 'bb'])})/{rng.randrange(5)} 2020" for _ in range(n))
        text = "# head\n\n" + "".join(f"{k}\ts\t{i}\t5\t1\n" + ("#\n" if i % 7 == 0 else "") for i, k in enumerate(keys))
        path = put(tmp_path / f"{n}.idx", text)
        with open(path, "rb") as file:
            index = zipnum.IndexFile(file, len(text.encode()))
            assert [int(r.split("\t")[2]) for _, _, r in index.rows(0, index.size)] == list(range(n))
            cuts = sorted(rng.sample(range(index.size + 1), 5))
            parts = [r for a, b in zip([0, *cuts], [*cuts, index.size]) for _, _, r in index.rows(a, b)]
            assert [int(r.split("\t")[2]) for r in parts] == list(range(n))
            for wanted in [*(k.split(" ")[0] for k in keys[:12]), "a", "aé", "b)/2", "0", "zz", "c"]:
                for prefix in (True, False):
                    got = [int(r.split("\t")[2]) for _, _, r in index.rows(*index.candidates(wanted, prefix))]
                    assert got == list(zipnum.candidate_blocks(keys, wanted, prefix)), (wanted, prefix)


def test_single_shard_of_several_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writer, "GROUP", 4)
    rows = lines(100)
    index = writer.write_zipnum(frame(spark, rows), str(tmp_path / "g"), chunk_size=10, single_shard=True, with_chunk=True).orderBy("chunk").collect()
    assert {r.shard for r in index} == {"g.cdx.gz"} and [r.offset for r in index] == [sum(r.length for r in index[:i]) for i in range(10)]
    assert sorted(values(zipnum.read_zipnum(spark, str(tmp_path / "g/g.idx")))) == sorted(rows)


def test_paths_stay_inside(spark, tmp_path):
    base = tmp_path / "base"
    put(base / "in.cdx.gz", "x")
    put(tmp_path / "out.cdx.gz", "x")
    os.symlink(tmp_path / "out.cdx.gz", base / "link.cdx.gz")
    assert zipnum.shard_path("in", str(base), {}) == str(base / "in.cdx.gz")
    assert zipnum.shard_path("s", str(base), {"s": "in.cdx.gz"}) == str(base / "in.cdx.gz")
    for shard, loc in (("../out", {}), ("link", {}), ("s", {"s": "/etc/passwd"}), ("s", {"s": "../out.cdx.gz"})):
        with pytest.raises(ValueError):
            zipnum.shard_path(shard, str(base), loc)


@pytest.mark.parametrize("line", ["a\tb\t1\t2", "a\tb\tx\t2\t3", "a\tb\t1\ty\t3"])
def test_bad_index_rows(line):
    with pytest.raises(ValueError):
        zipnum.parse_idx_line(line)


def test_index_readers(spark, tmp_path):
    idx = put(tmp_path / "i.idx", "#c\n\nshort\tx\nk\ts\t1\t2\t3\nk\ts\tx\t2\t3\n")
    assert [tuple(r) for r in zipnum.read_idx(spark, idx).collect()] == [("k", "s", 1, 2, 3), ("k", "s", None, 2, 3)]
    assert zipnum.read_idx(spark, idx).columns == IDX.names
    loc = put(tmp_path / "i.loc", "#c\ns\tone\nt\tx\ns\ttwo\nshort\n")
    assert {tuple(r) for r in zipnum.read_loc(spark, loc).collect()} == {("s", "two"), ("t", "x")} == set(zipnum.load_loc(loc).items())
    assert zipnum.loc_file(idx) == loc and zipnum.loc_file(str(tmp_path / "z.idx")) is None


# ------------------------------------------------ archives and pipeline


def record(kind, uri, body, date="2021-03-04T05:06:07Z", **extra):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\n" + (f"WARC-Target-URI: {uri}\r\n" if uri else "") + f"WARC-Date: {date}\r\n"
    head += "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in extra.items()) + f"Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def page(uri, text, status="200 OK", mime="text/html; charset=utf-8", **extra):
    body = f"HTTP/1.1 {status}\r\nContent-Type: {mime}\r\n\r\n{text}".encode()
    return record("response", uri, body, Content_Type="application/http; msgtype=response", **extra)


def archive(path, records, zipped=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(gzip.compress(r) if zipped else r for r in records))
    return str(path)


@pytest.mark.parametrize("zipped", [True, False])
def test_warc(spark, tmp_path, zipped):
    records = [
        record("warcinfo", None, b"x"), page("http://www.b.com/y?b=1&a=2", "hello" * 1000, WARC_Payload_Digest="sha1:AAA"), record("request", "http://a.com/", b"GET"),
        page("http://a.com/", "é", "404 Not Found"), record("resource", "urn:x:y", b"data", Content_Type="image/png"), page("http://c.com/" + "z" * 3000, "x" * 3_000_000),
    ]
    path = archive(tmp_path / ("w.warc.gz" if zipped else "w.warc"), records, zipped)
    got = warc.read_warcs(spark, [path]).orderBy("src_pos").collect()
    import json

    assert [r.surt for r in got][:3] == ["com,b)/y?a=2&b=1", "com,a)/", "urn:x:y"] and len(got) == 4
    fields = [json.loads(r.json) for r in got]
    assert [(f["status"], f["mime"]) for f in fields] == [("200", "text/html"), ("404", "text/html"), ("-", "image/png"), ("200", "text/html")]
    assert fields[0]["digest"] == "AAA" and len(fields[1]["digest"]) == 32 and fields[0]["filename"] == os.path.basename(path)
    data = open(path, "rb").read()
    for f, r in zip(fields, [records[1], records[3], records[4], records[5]]):
        part = data[int(f["offset"]) : int(f["offset"]) + int(f["length"])]
        assert (gzip.decompress(part) if zipped else part) == r
    assert {r.ts for r in got} == {"20210304050607"}


def test_broken_archives(spark, tmp_path):
    good = gzip.compress(page("http://a.com/", "x"))
    paths = []
    for i, data in enumerate([good + b"rubbish", good + good[:-30], b"", b"no archive", good]):
        (tmp_path / f"{i}.warc.gz").write_bytes(data)
        paths.append(str(tmp_path / f"{i}.warc.gz"))
    counts = {os.path.basename(r.src_path)[0]: r["count"] for r in warc.read_warcs(spark, paths).groupBy("src_path").count().collect()}
    assert counts["0"] == counts["4"] == 1 and counts.get("2") is None and counts.get("3") is None
    faults = {os.path.basename(r.src_path)[0]: r.fault for r in warc.read_warcs(spark, paths, faults=True).collect()}
    assert set(faults) == {"0", "1", "3"} and faults["1"].startswith(f"breaks off at {len(good)}")


def test_collection(spark, tmp_path):
    source = tmp_path / "C"
    hot = [page("http://hot.com/", f"{i}") for i in range(6)]
    archive(source / "1.warc.gz", hot + [page("http://a.com/x", "1"), page("http://bad.com/", "1")])
    archive(source / "d/2.warc.gz", [page("http://b.com/x", "1")])
    put(source / "notes.txt", "x")
    kept = collection.Collection(spark, str(tmp_path / "state"), "C")
    files = lambda: warc.archive_files([str(source)])
    assert kept.update(files(), warc.read_warcs) == {"added": 2, "changed": 0, "removed": 0}
    assert kept.update(files(), warc.read_warcs) == {"added": 0, "changed": 0, "removed": 0}
    index, report = kept.build(str(tmp_path / "out"), blocklist=Blocklist.of(["^com,bad)"]), threshold=5)
    assert [tuple(r) for r in report.collect()] == [("read", 9, 0.0), ("field added", 9, 0.0), ("blocklist", 8, 11.1), ("excessive keys", 2, 75.0)]
    got = zipnum.read_zipnum(spark, str(tmp_path / "out/out.idx")).orderBy("surt").collect()
    assert [r.surt for r in got] == ["com,a)/x", "com,b)/x"] and '"collection":"C"' in got[0].json
    archive(source / "1.warc.gz", [page("http://a.com/new", "1")])
    os.utime(source / "1.warc.gz", (time.time() + 5, time.time() + 5))
    archive(source / "3.warc.gz", [page("http://c.com/", "1")])
    os.remove(source / "d/2.warc.gz")
    assert kept.update(files(), warc.read_warcs) == {"added": 1, "changed": 1, "removed": 1}
    assert sorted(r.surt for r in kept.captures().collect()) == ["com,a)/new", "com,c)/"]


def test_lookup(spark, tmp_path):
    put(tmp_path / "a.cdxj", "com,a)/ 2020 {}\ncom,b)/ 2020 {}\n")
    writer.write_zipnum(frame(spark, ["com,a)/ 2019 {}", "com,c)/ 2020 {}"]), str(tmp_path / "z"))
    places = [str(tmp_path)]
    assert [r.value for r in lookup.lookup(spark, places, url="http://www.a.com/", sort=True).collect()] == ["com,a)/ 2019 {}", "com,a)/ 2020 {}"]
    assert lookup.lookup(spark, [str(tmp_path / "none")], key="com,a)/", skip_errors=True).count() == 0
    with pytest.raises(FileNotFoundError):
        lookup.lookup(spark, [str(tmp_path / "none")], key="com,a)/")
    put(tmp_path / "broken.idx", "x\ty\tz\t1\t1\n")
    for wrong in ({}, {"key": "a", "url": "b"}, {"url": ""}):
        with pytest.raises(ValueError):
            lookup.lookup(spark, places, **wrong)


def test_stream(spark, tmp_path):
    put(tmp_path / "in/a.cdxj", "com,a)/ 20200101000000 {}\nrubbish\n")
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        put(tmp_path / "in/b.cdxj", "com,b)/ 20210101000000\n")
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert sorted((r.surt, r.year) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("com,a)/", 2020), ("com,b)/", 2021)]


def test_tables(spark, tmp_path):
    df = frame(spark, lines(50)).select(F.split("value", " ")[0].alias("surt"), F.lit("1").alias("ts"))
    captures_table(df, str(tmp_path / "t"), "one")
    captures_table(df.limit(3), str(tmp_path / "t"), "two")
    captures_table(df.limit(5), str(tmp_path / "t"), "two")
    assert {(r.collection, r["count"]) for r in spark.read.parquet(str(tmp_path / "t")).groupBy("collection").count().collect()} == {("one", 50), ("two", 5)}
    assert write_one_file(frame(spark, ["b", None, "a"]).coalesce(1), str(tmp_path / "o")) == 3 and open(tmp_path / "o").read() == "b\n\na\n"
    captures_table(df, str(tmp_path / "u"))
    ordered = spark.read.parquet(str(tmp_path / "u")).select("surt", F.lit(1).alias("p"), F.monotonically_increasing_id().alias("i"))
    assert order_violations(ordered, ["p", "i"], "surt").count() == 0


def test_periods(spark, tmp_path, captures):
    df = captures(["a)/ 20200101000000", "b)/ 20200201000000", "a)/ 20210101000000", "x"])
    write_by_period(df, str(tmp_path / "y"))
    assert {(str(r.year), r["count"]) for r in spark.read.parquet(str(tmp_path / "y")).groupBy("year").count().collect()} == {("2020", 2), ("2021", 1), ("None", 1)}
    write_by_period(df, str(tmp_path / "m"), months=True)
    assert spark.read.parquet(str(tmp_path / "m")).select("year", "month").distinct().count() == 4


def test_working_tables(spark, tmp_path, monkeypatch):
    runtime.release(spark)
    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    kept = runtime.materialise(spark.range(5), "t")
    assert kept.count() == 5 and len(os.listdir(tmp_path / "shared/heliograph")) == 1
    runtime.release(spark)
    assert os.listdir(tmp_path / "shared/heliograph") == []


def test_shared_folder_of_the_session():
    code = """
from pyspark.sql import SparkSession
from heliograph.runtime import shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file:///tmp/some/folder/").getOrCreate()
assert shared_dir(spark) == "file:///tmp/some/folder"
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# ------------------------------------------------ key/value server


class Fake(socketserver.StreamRequestHandler):
    def handle(self):
        while head := self.rfile.readline():
            words = []
            for _ in range(int(head[1:])):
                size = int(self.rfile.readline()[1:])
                words.append(self.rfile.read(size + 2)[:-2].decode())
            self.server.seen.append(words)
            self.wfile.write(self.reply(words))

    def reply(self, w):
        store = self.server.store
        if w[0] == "AUTH":
            return b"+OK\r\n" if w[1] == "pw" else b"-ERR wrong\r\n"
        if w[0] == "HSET":
            if w[2] == "refused":
                return b"-ERR no\r\n"
            for word, port in self.server.redirected.get(w[2], [])[:1]:
                self.server.redirected[w[2]].pop(0)
                return b"-%s 1 127.0.0.1:%d\r\n" % (word.encode(), port)
            store.setdefault(w[1], {})[w[2]] = w[3]
            return b":1\r\n"
        if w[0] == "DEL":
            return b":%d\r\n" % (store.pop(w[1], None) is not None)
        if w[0] == "HLEN":
            if self.server.moved:
                return b"-MOVED 1 127.0.0.1:%d\r\n" % self.server.moved
            return b":%d\r\n" % len(store.get(w[1], {}))
        return b"+OK\r\n"


@pytest.fixture
def server():
    made = []

    def start(moved=None):
        s = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Fake)
        s.daemon_threads, s.seen, s.store, s.moved, s.redirected = True, [], {}, moved, {}
        threading.Thread(target=s.serve_forever, daemon=True).start()
        made.append(s)
        return s

    yield start
    for s in made:
        s.shutdown()


def entries(spark, rows):
    return spark.createDataFrame([(*r, "i", 0, n) for n, r in enumerate(rows)], "filename string, path string, src_path string, src_block long, src_pos long")


def test_server_sink(spark, server):
    s = server()
    sink = kv.ServerSink(kv.Server("127.0.0.1", s.server_address[1], db=2, password="pw"), batch_size=3)
    rows = [(f"f{i}", f"/p/é{i}") for i in range(20)] + [("f1", "/last")]
    assert kv.load(entries(spark, rows), sink, "h") == (20, 0)
    assert s.store["h"]["f1"] == "/last" and s.store["h"]["f3"] == "/p/é3" and ["SELECT", "2"] in s.seen
    assert kv.load(entries(spark, [("g", "x"), ("refused", "x")]), sink, "h", clear=True) == (1, 1)
    assert s.store["h"] == {"g": "x"}
    assert kv.load(entries(spark, []), sink, "h") == (0, 0)


def test_server_sink_moved_dry_and_down(spark, server):
    home = server()
    door = server(moved=home.server_address[1])
    link = kv.Server("127.0.0.1", door.server_address[1])
    assert kv.load(entries(spark, [("a", "1")]), kv.ServerSink(link), "h") == (1, 0) and home.store == {"h": {"a": "1"}}
    assert kv.load(entries(spark, [("b", "1")]), kv.ServerSink(link, dry_run=True), "h") == (1, 0) and "b" not in home.store["h"]
    assert kv.load(entries(spark, [("a", "1")]), kv.ServerSink(kv.Server("127.0.0.1", 1, timeout=1)), "h") == (0, 1)
    with pytest.raises(ValueError):
        kv.ServerSink(link, batch_size=0)


def test_server_sink_follows_a_hash_that_moves(spark, server):
    old, new = server(), server()
    port = new.server_address[1]
    old.redirected = {"b": [("ASK", port)], "c": [("TRYAGAIN", 0)], "e": [("MOVED", port)]}
    link = kv.Server("127.0.0.1", old.server_address[1])
    rows = entries(spark, [(x, x.upper()) for x in "abcdefg"]).repartition(1)
    assert kv.load(rows, kv.ServerSink(link, batch_size=10), "h") == (7, 0)
    assert {**old.store["h"], **new.store["h"]} == {x: x.upper() for x in "abcdefg"}
    assert "b" in new.store["h"] and "e" in new.store["h"] and "c" in old.store["h"] | new.store["h"] and ["ASKING"] in new.seen
    old.redirected = {"z": [("ASK", port)] * 20}
    new.redirected = {"z": [("MOVED", old.server_address[1])] * 20}
    assert kv.load(entries(spark, [("z", "Z")]), kv.ServerSink(link), "h") == (0, 1)


def test_parquet_sink(spark, tmp_path):
    sink = kv.ParquetSink(str(tmp_path))
    assert kv.load(entries(spark, [("a", "1"), ("b", "2")]), sink, "p:x") == (2, 0)
    assert kv.load(entries(spark, [("a", "9")]), sink, "p:x") == (1, 0)
    assert {tuple(r) for r in sink.get(spark, "p:x").collect()} == {("a", "9"), ("b", "2")}
    kv.load(entries(spark, [("c", "3")]), sink, "p:x", clear=True)
    assert sink.get(spark, "p:x").count() == 1


# ------------------------------------------------ command line


def run(spark, *arguments):
    return main(list(arguments), spark)


def test_cli_files(spark, tmp_path, capsys):
    a, b = put(tmp_path / "in/a.cdxj", 'com,b)/ 2020 {"c":"1"}\ncom,z)/ 2020\n'), put(tmp_path / "in/b.tmp", "com,a)/ 2020 {}")
    out = str(tmp_path / "out")
    assert run(spark, "merge", out, str(tmp_path / "in")) == 0 and open(out).read().splitlines() == ["com,a)/ 2020 {}", 'com,b)/ 2020 {"c":"1"}', "com,z)/ 2020"]
    assert run(spark, "merge", out, str(tmp_path / "in"), "--exclude", "*") == 1
    assert run(spark, "blocklist", "-i", a, "-b", put(tmp_path / "bl", "# x\n\n^com,z)\n"), "-o", out) == 0 and open(out).read() == 'com,b)/ 2020 {"c":"1"}\n'
    assert run(spark, "excess", "find", "-i", a, "-n", "0", "-o", out) == 0 and open(out).read() == "com,b)/ 1\ncom,z)/ 1\n"
    assert run(spark, "excess", "remove", "-i", a, "-b", put(tmp_path / "ex", "com,b)/ 9\n"), "-o", out) == 0 and open(out).read() == "com,z)/ 2020\n"
    assert run(spark, "excess", "auto", "-i", a, "-n", "1", "-o", out) == 0 and len(open(out).read().splitlines()) == 2
    assert run(spark, "addfield", "-i", a, "-f", "k=v", "-o", out) == 0 and open(out).read() == 'com,b)/ 2020 {"c":"1","k":"v"}\ncom,z)/ 2020 {"k":"v"}\n'
    assert run(spark, "addfield", "-i", a, "-o", out) == 1 and run(spark, "addfield", "-i", a, "-f", "kv", "-o", out) == 1
    capsys.readouterr()
    assert run(spark, "extract", "-i", a, "-f", "c") == 0 and capsys.readouterr().out == '"1"\n\n'
    assert run(spark, "extract", "-i", a, "-f", "c", "-r", "-d", "?") == 0 and capsys.readouterr().out == "1\n?\n"
    assert run(spark, "extract", "-i", a, "-f", "c", "-s", "-r") == 0 and capsys.readouterr().out == "1\n"
    assert run(spark, "search", "--surt", "com,", "--match-type", "prefix", "--sort", "--limit", "1", a) == 0 and capsys.readouterr().out == 'com,b)/ 2020 {"c":"1"}\n'
    assert run(spark, "search", "--url", "http://b.com/", a, "--filter", "c=1") == 0 and capsys.readouterr().out == 'com,b)/ 2020 {"c":"1"}\n'
    assert run(spark, "search", "--surt", "com,", a, "--filter", "nonsense") == 1
    assert run(spark, "extract", "-i", str(tmp_path / "none"), "-f", "c") == 1
    assert run(spark, "to-zipnum", "-i", a, "-o", str(tmp_path / "z"), "-c", "1") == 0
    capsys.readouterr()
    assert run(spark, "from-zipnum", "-i", str(tmp_path / "z/z.idx")) == 0 and capsys.readouterr().out == open(a).read()
    assert run(spark, "from-zipnum", "-i", put(tmp_path / "e.idx", "")) == 1
    assert b


def test_cli_paths(spark, tmp_path, capsys, server):
    put(tmp_path / "arc/1.txt", "/x/a.gz\n# no\n")
    port = str(server().server_address[1])
    assert run(spark, "path-index", "-d", str(tmp_path / "arc"), "--output-separator", " ") == 0 and capsys.readouterr().out == "a.gz /x/a.gz\n"
    assert run(spark, "path-index", "-i", put(tmp_path / "none.txt", "#\n")) == 1 and run(spark, "path-index") == 1
    index = put(tmp_path / "p.idx", "a\t/x\n")
    assert run(spark, "load-paths", "-i", index, "-k", "h", "--host", "127.0.0.1", "--port", port) == 0
    assert run(spark, "load-paths", "-i", index, "-k", "h", "--port", "1", "--timeout", "1") == 1
    assert run(spark, "load-paths", "-i", index, "-k", "h", "--port", "1", "--dry-run") == 0
    assert run(spark, "load-paths", "-i", index, "-k", "h", "--batch-size", "0") == 1
    assert run(spark, "load-arclists", "-d", str(tmp_path / "arc"), "-k", "h", "--host", "127.0.0.1", "--port", port) == 0


def test_cli_collection(spark, tmp_path):
    archive(tmp_path / "all/C/1.warc.gz", [page("http://a.com/", "x")])
    where = ["--collections-dir", str(tmp_path / "all"), "--output-dir", str(tmp_path / "out"), "--temp-dir", str(tmp_path / "tmp")]
    assert run(spark, "collection", "C", *where, "--incremental", "--blocklist", str(tmp_path / "none")) == 0
    assert run(spark, "collection", "C", *where, "--incremental") == 0 and os.path.exists(tmp_path / "out/C/C.idx")
    assert run(spark, "collection", "none", *where) == 1


def test_dates_of_files(spark, tmp_path):
    put(tmp_path / "a", "x")
    row = collection.file_state(spark, [str(tmp_path / "a")]).first()
    assert row.length == 1 and isinstance(row.modified, datetime.datetime)
    assert collection.file_state(spark, []).count() == 0
