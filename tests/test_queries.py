import os
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract
from heliograph import runtime
from heliograph.queries import captures, commands, common, files, quality  # noqa: F401
from tests.oracle import FOLDER, database, difference

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(common.ORACLES))
def test_against_sql(spark, con, name):
    assert difference(spark, con, common.QUERIES[name], common.ORACLES[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(common.QUERIES) - set(common.ORACLES)))
def test_others_run(spark, name):
    assert common.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["capture_id", "surt", "ts"] and frame.count() > 0


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(common.QUERIES) <= set(contract.queries())


def test_works_without_the_training_data_package():
    code = "import sys; sys.modules['heliograph.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('p6') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


ODD = ['{"mime":"a/b"}', '{"url":"x"}', '{"mime":null}', '{"mime":5,"n":true}', '{"mime":["a",1]}', None]


@pytest.fixture
def odd_payloads(tmp_path):
    """Captures with and without a mime type, and a shared folder where nothing has been written yet."""
    rows = [{"capture_id": i, "surt_key": f"a,b{i})/", "ts": "20200101000000", "json_data": x} for i, x in enumerate(ODD)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "captures.parquet")
    return str(tmp_path)


def test_addfield_file_in_a_new_folder(spark, odd_payloads, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file://{odd_payloads}/shared")
    sql = common.ORACLES["addfield_file"]
    assert difference(spark, database(odd_payloads), files.addfield_file, sql, odd_payloads) == ([], [])


def test_blocklist_file_in_a_new_folder(spark, tmp_path, monkeypatch):
    """A blank at the end of a pattern is a part of it."""
    keys = ["example,q,m)/calendario", "example,q,m)/calendario2", "test,five)/", "test,six)/", "a,b)/ads/"]
    rows = [{"capture_id": i, "surt_key": x, "ts": "20200101000000", "json_data": None} for i, x in enumerate(keys)]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema([("capture_id", pa.int64()), ("surt_key", pa.string()), ("ts", pa.string()), ("json_data", pa.string())])), tmp_path / "captures.parquet")
    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    assert [r.capture_id for r in files.blocklist_file(spark, str(tmp_path)).orderBy("capture_id").collect()] == [1, 3]
    sql = common.ORACLES["blocklist_file"]
    assert difference(spark, database(tmp_path), files.blocklist_file, sql, str(tmp_path)) == ([], [])
