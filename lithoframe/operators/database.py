"""Versioned SQL databases: statements that change tables make a new version; any version can be read.

A version is a row of the commit log: the tables' folders of Parquet, a root digest of their contents, who
wrote it and with what. A write changes one table's folder and leaves the others as they are. The log's
files are created, never overwritten, so that of two writers of one version only one succeeds.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, owner string, writer string, sql string, root string, tables array<struct<name:string,path:string,key:string,digest:string>>"
# Settings that a database reports, and the names of column types besides Spark's own.
PRAGMAS = {"page_size": "16384", "journal_mode": "delete", "busy_timeout": "5000"}
TYPES = {"text": "string", "varchar": "string", "integer": "bigint", "int": "bigint", "real": "double", "blob": "binary"}


class Unauthorized(PermissionError):
    """The writer isn't the owner."""


class Conflict(RuntimeError):
    """The version that the writer expected isn't the current one any more."""


def split_outside(text: str, mark: str) -> list[str]:
    """text at each mark that stands outside quotes and brackets; blank parts are left out."""
    out, depth, quote, at = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == mark and not depth:
            out.append(text[at:k])
            at = k + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def where_outside(text: str) -> tuple[str, str | None]:
    """What stands before and after a WHERE outside quotes and brackets."""
    for m in re.finditer(r"(?i)\bwhere\b", text):
        before = text[: m.start()]
        plain = re.sub(r"'[^']*'|\"[^\"]*\"|`[^`]*`", "", before)
        if not re.search(r"['\"`]", plain) and plain.count("(") == plain.count(")"):
            return before.strip(), text[m.end() :].strip()
    return text.strip(), None


class Database:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str, owner: str) -> Database:
        """A new database without tables, as version 0."""
        self = cls(spark, folder)
        self._commit(0, owner, owner, "", {})
        return self

    def history(self) -> DataFrame:
        """The commit log, a row a version."""
        return self.spark.read.schema(COMMIT).json(f"{self.folder}/commits")

    def commit_at(self, version: int | None = None):
        log = self.history()
        rows = (log if version is None else log.filter(F.col("version") == version)).orderBy(F.desc("version")).limit(1).collect()
        if not rows:
            raise LookupError(f"no version {version}")
        return rows[0]

    def _commit(self, version: int, owner: str, writer: str, sql: str, tables: dict[str, dict]) -> str:
        listed = [tables[n] for n in sorted(tables)]
        root = hashlib.sha256(json.dumps([[t["name"], t["key"], t["digest"]] for t in listed]).encode()).hexdigest()
        row = {"version": version, "owner": owner, "writer": writer, "sql": sql, "root": root, "tables": listed}
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/{version:012d}.json")
        try:
            out = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).create(at, False)
        except Exception as e:
            raise Conflict(f"version {version} was written by another") from e
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        return root

    def table(self, name: str, version: int | None = None) -> DataFrame:
        for t in self.commit_at(version).tables:
            if t.name == name.lower():
                return self.spark.read.parquet(t.path)
        raise LookupError(f"no table {name}")

    def query(self, sql: str, version: int | None = None) -> DataFrame:
        """The rows of a query over a version's tables, or the value of a PRAGMA."""
        m = re.fullmatch(r"(?i)\s*pragma\s+(\w+)\s*;?\s*", sql)
        if m:
            return self.spark.createDataFrame([(m[1].lower(), PRAGMAS.get(m[1].lower()))], "name string, value string")
        for t in self.commit_at(version).tables:
            self.spark.read.parquet(t.path).createOrReplaceTempView(t.name)
        return self.spark.sql(sql)

    def execute(self, sql: str, writer: str, expected: str | None = None) -> int:
        """Run statements parted by semicolons as one write: the new version, all of them or none.

        Only the owner may write. A write that expects another root than the current one is a conflict.
        """
        head = self.commit_at()
        if writer != head.owner:
            raise Unauthorized(f"{writer} doesn't own this database")
        if expected is not None and expected != head.root:
            raise Conflict("the database has changed")
        statements = split_outside(sql, ";")
        if not statements:
            raise ValueError("nothing to execute")
        tables = {t.name: t.asDict() for t in head.tables}
        for statement in statements:
            self._apply(tables, statement, head.version + 1)
        self._commit(head.version + 1, head.owner, writer, sql, tables)
        return head.version + 1

    def rollback(self, version: int, writer: str) -> int:
        """A new version with the contents of an older one; nothing is copied."""
        head, old = self.commit_at(), self.commit_at(version)
        if writer != head.owner:
            raise Unauthorized(f"{writer} doesn't own this database")
        self._commit(head.version + 1, head.owner, writer, f"ROLLBACK TO {version}", {t.name: t.asDict() for t in old.tables})
        return head.version + 1

    # -- statements ------------------------------------------------------------------------------------

    def _keep(self, tables: dict[str, dict], name: str, rows: DataFrame, key: str | None, version: int) -> None:
        path = f"{self.folder}/data/{name}-{version}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        told = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*kept.columns).cast("decimal(38,0)")).alias("h")).first()  # the same in any order of rows
        tables[name] = {"name": name, "path": path, "key": key, "digest": f"{kept.schema.simpleString()}:{told.n}:{told.h}"}

    def _rows(self, tables: dict[str, dict], name: str) -> DataFrame:
        if name not in tables:
            raise LookupError(f"no table {name}")
        return self.spark.read.parquet(tables[name]["path"])

    def _sql(self, tables: dict[str, dict], sql: str) -> DataFrame:
        for t in tables.values():
            self.spark.read.parquet(t["path"]).createOrReplaceTempView(t["name"])
        return self.spark.sql(sql)

    def _apply(self, tables: dict[str, dict], statement: str, version: int) -> None:
        for pattern, act in self.STATEMENTS:
            m = re.fullmatch(pattern, statement, re.S | re.I)
            if m:
                act(self, tables, version, *m.groups())
                return
        raise ValueError(f"not a statement that changes tables: {statement[:60]}")

    def _create(self, tables, version, if_not, name, body) -> None:
        name = name.lower()
        if name in tables:
            if if_not:
                return
            raise ValueError(f"table {name} exists")
        columns, key = [], None
        for part in split_outside(body, ","):
            whole = re.fullmatch(r"primary\s+key\s*\(\s*(\w+)\s*\)", part, re.I)
            if whole:
                key = whole[1].lower()
                continue
            m = re.match(r"(\w+)\s+(\w+(?:\s*\([^)]*\))?)", part)
            if not m:
                raise ValueError(f"not a column: {part}")
            kind = m[2].lower()
            columns.append(f"`{m[1].lower()}` {TYPES.get(kind.split('(')[0].strip(), kind)}")
            if re.search(r"primary\s+key", part, re.I):
                key = m[1].lower()
        self._keep(tables, name, self.spark.createDataFrame([], ", ".join(columns)), key, version)

    def _create_as(self, tables, version, name, select) -> None:
        if name.lower() in tables:
            raise ValueError(f"table {name} exists")
        self._keep(tables, name.lower(), self._sql(tables, select), None, version)

    def _drop(self, tables, version, if_there, name) -> None:
        if tables.pop(name.lower(), None) is None and not if_there:
            raise LookupError(f"no table {name}")

    def _insert(self, tables, version, replace, name, columns, rest) -> None:
        name = name.lower()
        old, key = self._rows(tables, name), tables.get(name, {}).get("key")
        new = self._sql(tables, f"SELECT * FROM ({rest})" if rest[:6].lower() == "values" else rest)
        given = [c.strip().lower() for c in columns.split(",")] if columns else old.columns
        if len(given) != len(new.columns) or not set(given) <= set(old.columns):
            raise ValueError(f"columns don't match those of {name}")
        new = new.toDF(*given)
        new = new.select(*[(F.col(c) if c in given else F.lit(None)).cast(f.dataType).alias(c) for c, f in zip(old.columns, old.schema.fields, strict=True)])
        if key:
            if replace:
                new = new.dropDuplicates([key])
                old = old.join(new.select(key), key, "left_anti").select(old.columns)
            elif new.count() != new.select(key).distinct().count() or not new.join(old.select(key), key, "left_semi").isEmpty():
                raise ValueError(f"{name}.{key} must be unique")
        self._keep(tables, name, old.union(new), key, version)

    def _update(self, tables, version, name, rest) -> None:
        name = name.lower()
        old = self._rows(tables, name)
        sets, condition = where_outside(rest)
        to = {}
        for part in split_outside(sets, ","):
            column, _, value = part.partition("=")
            to[column.strip().strip("`").lower()] = value.strip()
        if not set(to) <= set(old.columns):
            raise ValueError(f"columns don't match those of {name}")
        kinds = {f.name: f.dataType.simpleString() for f in old.schema.fields}
        shown = [f"CAST(CASE WHEN {condition or 'true'} THEN {to[c]} ELSE `{c}` END AS {kinds[c]}) AS `{c}`" if c in to else f"`{c}`" for c in old.columns]
        self._keep(tables, name, self._sql(tables, f"SELECT {', '.join(shown)} FROM `{name}`"), tables[name]["key"], version)

    def _delete(self, tables, version, name, condition) -> None:
        name = name.lower()
        self._rows(tables, name)
        self._keep(tables, name, self._sql(tables, f"SELECT * FROM `{name}` WHERE NOT coalesce({condition or 'true'}, false)"), tables[name]["key"], version)

    def _alter(self, tables, version, name, rest) -> None:
        name = name.lower()
        rows, key = self._rows(tables, name), tables[name]["key"]
        add = re.fullmatch(r"add\s+(?:column\s+)?(\w+)\s+(\w+)", rest, re.I)
        drop = re.fullmatch(r"drop\s+(?:column\s+)?(\w+)", rest, re.I)
        column = re.fullmatch(r"rename\s+(?:column\s+)?(\w+)\s+to\s+(\w+)", rest, re.I)
        whole = re.fullmatch(r"rename\s+to\s+(\w+)", rest, re.I)
        if whole:
            tables[whole[1].lower()] = tables.pop(name) | {"name": whole[1].lower()}
            return
        if add:
            kind = add[2].lower()
            rows = rows.withColumn(add[1].lower(), F.lit(None).cast(TYPES.get(kind, kind)))
        elif drop and drop[1].lower() in rows.columns:
            rows, key = rows.drop(drop[1].lower()), None if key == drop[1].lower() else key
        elif column and column[1].lower() in rows.columns:
            rows, key = rows.withColumnRenamed(column[1].lower(), column[2].lower()), column[2].lower() if key == column[1].lower() else key
        else:
            raise ValueError(f"can't alter {name}: {rest[:60]}")
        self._keep(tables, name, rows, key, version)

    STATEMENTS = (
        (r"create\s+table\s+(if\s+not\s+exists\s+)?(\w+)\s*\((.*)\)", _create),
        (r"create\s+table\s+(\w+)\s+as\s+(.*)", _create_as),
        (r"drop\s+table\s+(if\s+exists\s+)?(\w+)", _drop),
        (r"insert\s+(or\s+replace\s+)?into\s+(\w+)\s*(?:\(([\w\s,]+)\))?\s*((?:values|select|with)\b.*)", _insert),
        (r"update\s+(\w+)\s+set\s+(.*)", _update),
        (r"delete\s+from\s+(\w+)(?:\s+where\s+(.*))?", _delete),
        (r"alter\s+table\s+(\w+)\s+(.*)", _alter),
    )
