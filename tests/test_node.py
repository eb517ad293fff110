"""Settings, requests, the command line, databases and possession: what no single query shows."""

import hashlib
import json

import pytest

from lithoframe.node import Config, Node, main
from lithoframe.operators.database import Conflict, Database, Unauthorized, split_outside, where_outside


def test_config_round_trip(tmp_path):
    at = str(tmp_path / "deep" / "node.json")
    Config(listen_port=7, bootstrap_peers=["a:1"]).save(at)
    assert Config.load(at) == Config(listen_port=7, bootstrap_peers=["a:1"])
    (tmp_path / "some.json").write_text('{"rlnc_k": 8, "unknown": 1}')
    assert Config.load(str(tmp_path / "some.json")) == Config(rlnc_k=8)
    with pytest.raises(ValueError):
        (tmp_path / "bad.json").write_text("{")
        Config.load(str(tmp_path / "bad.json"))


def test_requests_and_command_line(spark, tmp_path, capsys):
    at = str(tmp_path / "node.json")
    Config(data_dir=str(tmp_path / "data")).save(at)
    for name, text in (("a", "hello"), ("b", "hello"), ("c", "there")):
        (tmp_path / name).write_text(text)
    node = Node(spark, Config.load(at))
    assert node.status()["objects"] == 0 and node.list() == []
    run = lambda *args: main(["--config", at, *args], spark)
    assert run("put", *(str(tmp_path / x) for x in "abc")) == 0
    hello, there = (hashlib.sha256(x).hexdigest() for x in (b"hello", b"there"))
    assert sorted(json.loads(capsys.readouterr().out)) == sorted([hello, hello, there])
    assert node.list() == sorted([hello, there]) and node.status()["bytes"] == 10
    assert node.get(hello) == b"hello" and node.get("0" * 64) is None
    assert run("put", str(tmp_path / "a")) == 0 and node.status()["objects"] == 2
    assert run("create", "d") == 0 and run("execute", "CREATE TABLE t (x INTEGER); INSERT INTO t VALUES (4)", "d") == 0
    capsys.readouterr()
    assert run("query", "SELECT x FROM t", "d") == 0 and json.loads(capsys.readouterr().out) == [{"x": 4}]
    assert run("--writer", "other", "execute", "DELETE FROM t", "d") == 1 and "Unauthorized" in capsys.readouterr().err
    assert "error" in node.handle({"method": "drop_all"}) and "error" in node.handle({"method": "query", "args": ["nowhere", "SELECT 1"]})


def test_statements_are_parted_outside_quotes():
    assert split_outside("a ';' ; (b;c); ", ";") == ["a ';'", "(b;c)"]
    assert where_outside("x = 'where', y = (SELECT 1 WHERE true) WHERE z = 1") == ("x = 'where', y = (SELECT 1 WHERE true)", "z = 1")
    assert where_outside("x = 1") == ("x = 1", None)


def test_writes_make_versions(spark, tmp_path):
    db = Database.create(spark, str(tmp_path / "db"), "ann")
    first = db.commit_at().root
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT)", "ann", first)
    db.execute("INSERT INTO t VALUES (1, 'a;b'), (2, NULL)", "ann")
    with pytest.raises(Conflict):
        db.execute("DELETE FROM t", "ann", first)
    with pytest.raises(Unauthorized):
        db.execute("DELETE FROM t", "bob")
    with pytest.raises(Conflict):  # another writer was faster: the file of the version is there
        db._commit(2, "ann", "ann", "", {})
    with pytest.raises(ValueError):
        db.execute("INSERT INTO t VALUES (5, 'x'); INSERT INTO t VALUES (1, 'again')", "ann")
    assert db.query("SELECT count(*) AS n FROM t").first().n == 2  # all statements or none
    db.execute("UPDATE t SET s = concat(coalesce(s, ''), '!'), id = id + 10 WHERE id = 2", "ann")
    db.execute("DELETE FROM t WHERE s IS NULL", "ann")
    assert sorted(map(tuple, db.query("SELECT * FROM t").collect())) == [(1, "a;b"), (12, "!")]
    assert sorted(map(tuple, db.query("SELECT * FROM t", 2).collect())) == [(1, "a;b"), (2, None)]
    same = Database.create(spark, str(tmp_path / "other"), "ann")
    same.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT); INSERT INTO t VALUES (2, NULL), (1, 'a;b')", "ann")
    assert same.commit_at().root == db.commit_at(2).root  # equal contents, equal roots
    assert [r.version for r in db.history().orderBy("version").collect()] == [0, 1, 2, 3, 4]
