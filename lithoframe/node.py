"""What a node offers outside queries: its settings, requests by name, and a command line.

    python -m lithoframe.node --config node.json put FILE...
    python -m lithoframe.node --config node.json query "SELECT ..." DATABASE
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.operators import objects
from lithoframe.operators.database import Database


@dataclasses.dataclass
class Config:
    """A node's settings, kept as a JSON file; names that a file doesn't have keep their defaults."""

    data_dir: str = "data"
    listen_port: int = 4433
    bootstrap_peers: list[str] = dataclasses.field(default_factory=list)
    max_connections: int = 256
    max_disk_usage_bytes: int = 10 << 30
    health_scan_cycle_secs: int = 300
    rlnc_k: int = 32
    page_size: int = 16_384
    log_level: str = "info"

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in told.items() if k in known})

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(dataclasses.asdict(self), f, indent=2)


class Node:
    """Requests over a store of objects and the databases of a data folder."""

    def __init__(self, spark: SparkSession, config: Config) -> None:
        self.spark, self.config = spark, config
        self.store_at = f"{config.data_dir}/objects"

    def store(self) -> DataFrame:
        try:
            return self.spark.read.schema("cid string, data binary, shard string").parquet(self.store_at)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "cid string, data binary, shard string")

    def status(self) -> dict:
        """Settings, objects and bytes."""
        used = objects.usage(self.store()).first()
        return {"objects": used.objects, "bytes": used.bytes, "page_size": self.config.page_size, "k": self.config.rlnc_k, "full": used.bytes > self.config.max_disk_usage_bytes}

    def put(self, paths: list[str]) -> list[str]:
        """Ids of the files' contents, stored once each."""
        rows = self.spark.read.format("binaryFile").load(paths).select(F.col("content").alias("data"))
        named = objects.address(rows)
        objects.write_objects(objects.put(rows, self.store()), self.store_at)
        return [r.cid for r in named.select("cid").collect()]

    def get(self, cid: str) -> bytes | None:
        """The object, read from its shard alone; None if there is none."""
        wanted = self.spark.createDataFrame([(cid,)], "cid string")
        found = objects.get(self.store().filter(F.col("shard") == cid[:2]), wanted).first()
        return None if found.data is None else bytes(found.data)

    def list(self) -> list[str]:
        return [r.cid for r in objects.list_cids(self.store().select(F.col("cid").alias("name"))).orderBy("cid").collect()]

    def database(self, name: str) -> Database:
        return Database(self.spark, f"{self.config.data_dir}/databases/{name}")

    def create(self, name: str, owner: str) -> int:
        Database.create(self.spark, f"{self.config.data_dir}/databases/{name}", owner)
        return 0

    def query(self, name: str, sql: str) -> list[dict]:
        return [r.asDict() for r in self.database(name).query(sql).collect()]

    def execute(self, name: str, sql: str, writer: str) -> int:
        return self.database(name).execute(sql, writer)

    def handle(self, request: dict) -> dict:
        """A request {"method", "args"} -> {"ok"} or {"error"}; nothing a client sends raises."""
        methods: dict[str, Callable] = {m: getattr(self, m) for m in ("status", "put", "get", "list", "create", "query", "execute")}
        try:
            if request.get("method") not in methods:
                return {"error": f"no method {request.get('method')}"}
            return {"ok": methods[request["method"]](*request.get("args", []))}
        except Exception as e:
            return {"error": f"{type(e).__name__}: {e}"}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lithoframe.node")
    parser.add_argument("--config", help="JSON file of settings")
    parser.add_argument("--writer", default="me", help="who writes")
    commands = parser.add_subparsers(dest="method", required=True)
    for name, args in (("status", []), ("put", ["paths+"]), ("get", ["cid"]), ("list", []), ("create", ["database"]), ("query", ["sql", "database"]), ("execute", ["sql", "database"])):
        one = commands.add_parser(name)
        for a in args:
            one.add_argument(a.rstrip("+"), nargs="+" if a.endswith("+") else None)
    told = parser.parse_args(argv)
    config = Config.load(told.config) if told.config else Config()
    args = {
        "status": lambda: [], "list": lambda: [], "put": lambda: [told.paths], "get": lambda: [told.cid], "create": lambda: [told.database, told.writer],
        "query": lambda: [told.database, told.sql], "execute": lambda: [told.database, told.sql, told.writer],
    }[told.method]()
    if spark is None:
        from lithoframe.session import session

        spark = session("lithoframe-node")
    answer = Node(spark, config).handle({"method": told.method, "args": args})
    if "error" in answer:
        print(answer["error"], file=sys.stderr)
        return 1
    out = answer["ok"]
    print(out.decode("utf-8", "replace") if isinstance(out, bytes) else json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
