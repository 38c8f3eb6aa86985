"""Keyed tables as a base and deltas under a commit manifest.

A table is a folder: ``data/`` holds one Parquet folder per write, ``commits/`` one
small JSON file per version that lists the parts a version consists of.  A write puts
its rows into a new data folder, then its manifest into a temporary file, and renames
that to the next version: the rename is the commit.  A run that dies before it leaves
the table as it was (its folder is never read, and ``vacuum`` removes it); a run that
dies after it has committed.  Two writers cannot both make one version.

Parts are ``append`` (rows whose keys are new) or ``upsert`` (rows that replace older
rows of their keys).  Reading unites the parts and drops a row if a later upsert holds
its key: one join with the keys of the upserts, none if there are none, so a write costs
its own rows and not the table's.  When ``FAN`` parts of about one size have come
together at the end they are merged into one, so a row is rewritten a logarithmic number
of times and a version lists few parts.

Streams commit with their batch id: a batch that was committed before is skipped.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

FAN = 8


class DeltaTable:
    """Rows of ``schema`` with the key ``key`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "pmid", partition_by: str | None = None, fan: int = FAN):
        self.spark, self.path, self.schema, self.key, self.partition_by, self.fan = spark, path.rstrip("/"), schema, key, partition_by, fan
        self.columns = spark.createDataFrame([], schema).columns

    # ------------------------------------------------------------ manifests
    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in files.names_in(self.spark, f"{self.path}/commits") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """``parts`` (dir, kind, rows, seq) in order of seq, and ``batches`` (last
        committed batch id of every stream)."""
        if version is None:
            done = self.versions()
            version = done[-1] if done else None
        if version is None:
            return {"version": -1, "parts": [], "batches": {}}
        return json.loads(files.read_text(self.spark, f"{self.path}/commits/{version:010d}.json"))

    def _commit(self, old: dict, parts: list[dict], batches: dict, op: str = "merge", added: bool = False) -> dict:
        """Make ``parts`` the next version.  ``op`` tells how it came from the one before
        (append, upsert, replace, merge), ``added`` whether the last part is new rows."""
        new = {"version": old["version"] + 1, "op": op, "added": added, "parts": parts, "batches": batches}
        draft = f"{self.path}/commits/draft-{uuid.uuid4().hex}"
        files.write_text(self.spark, draft, json.dumps(new))
        if not files.rename(self.spark, draft, f"{self.path}/commits/{new['version']:010d}.json"):
            raise RuntimeError(f"version {new['version']} of {self.path} was written by another run")
        self.published(new)
        return new

    def published(self, manifest: dict) -> None:
        """Called after every commit."""

    # ------------------------------------------------------------ reading
    def exists(self) -> bool:
        return bool(self.versions())

    def _scan(self, dirs: list[str]) -> DataFrame:
        one = lambda *d: self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{x}" for x in d]).select(*self.columns)
        # several roots of partition folders cannot be read as one table
        return reduce(DataFrame.unionByName, (one(d) for d in dirs)) if self.partition_by else one(*dirs)

    def _merged(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        upserts = [p for p in parts[1:] if p["kind"] == "upsert"]  # the first part replaces nothing
        if not upserts:
            return self._scan([p["dir"] for p in parts])
        early = [p for p in parts if p["seq"] < upserts[0]["seq"]]
        rows = self._scan([p["dir"] for p in early]).withColumn("_seq", F.lit(-1).cast("long"))
        newer = None
        for p in parts[len(early):]:
            part = self._scan([p["dir"]]).withColumn("_seq", F.lit(p["seq"]).cast("long"))
            rows = rows.unionByName(part)
            if p["kind"] == "upsert":
                newer = part.select(self.key, "_seq") if newer is None else newer.unionByName(part.select(self.key, "_seq"))
        newest = newer.groupBy(self.key).agg(F.max("_seq").alias("_newest"))
        # every key is held by the newest upsert that has it, or by parts after that
        kept = rows.join(newest, self.key, "left").filter("_newest is null or _seq >= _newest")
        return kept.select(*self.columns)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version (or of ``version``)."""
        return self._merged(self.manifest(version)["parts"])

    # ------------------------------------------------------------ writing
    def _write(self, df: DataFrame, name: str) -> tuple[str, int]:
        folder = f"{name}-{uuid.uuid4().hex[:12]}"
        out = df.select(*self.columns)
        if self.partition_by:
            out = out.repartition(F.col(self.partition_by), F.pmod(F.xxhash64(self.key), F.lit(16))) if self.spread else out
            out.write.partitionBy(self.partition_by).parquet(f"{self.path}/data/{folder}")
        else:
            out.write.parquet(f"{self.path}/data/{folder}")
        if len(files.names_in(self.spark, f"{self.path}/data/{folder}")) <= 1:
            return folder, 0  # the success mark alone
        return folder, self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").count()

    #: Rows are dealt by partition value (and 16 salts) before they are written, so that
    #: a part has a bounded number of files a partition value.
    spread = True

    def _add(self, df: DataFrame, kind: str, batch: tuple[str, int] | None) -> int:
        old = self.manifest()
        if batch is not None and int(batch[1]) <= old["batches"].get(batch[0], -1):
            return 0
        folder, rows = self._write(df, f"v{old['version'] + 1}")
        if not rows and batch is None and old["version"] >= 0:
            return 0
        seq = 1 + max((p["seq"] for p in old["parts"]), default=-1)
        parts = old["parts"] + ([{"dir": folder, "kind": kind, "rows": rows, "seq": seq}] if rows else [])
        batches = old["batches"] | ({batch[0]: int(batch[1])} if batch is not None else {})
        self._settle(self._commit(old, parts, batches, kind, bool(rows)))
        return rows

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add rows whose keys the table does not hold; the number written.  ``batch``:
        (stream name, batch id), written once."""
        return self._add(df, "append", batch)

    def upsert(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Add rows in place of those with their keys (one row a key in ``df``)."""
        return self._add(df, "upsert", batch)

    def replace(self, df: DataFrame) -> int:
        """Make ``df`` the whole table."""
        old = self.manifest()
        folder, rows = self._write(df, f"v{old['version'] + 1}")
        self._commit(old, [{"dir": folder, "kind": "append", "rows": rows, "seq": 0}] if rows else [], old["batches"], "replace", bool(rows))
        return rows

    def _tier(self, part: dict) -> int:
        tier, size = 0, self.fan
        while part["rows"] >= size:
            tier, size = tier + 1, size * self.fan
        return tier

    def _settle(self, manifest: dict) -> None:
        """Merge the last parts while ``fan`` of them are of the last one's size."""
        while manifest["parts"]:
            top = self._tier(manifest["parts"][-1])
            n = 0
            while n < len(manifest["parts"]) and self._tier(manifest["parts"][-1 - n]) <= top:
                n += 1
            if n < self.fan:
                return
            manifest = self._merge(manifest, n)

    def _merge(self, manifest: dict, n: int) -> dict:
        """The last ``n`` parts as one."""
        kept, last = manifest["parts"][:-n], manifest["parts"][-n:]
        folder, rows = self._write(self._merged(last), f"v{manifest['version'] + 1}")
        kind = "upsert" if kept and any(p["kind"] == "upsert" for p in last) else "append"
        return self._commit(manifest, [*kept, {"dir": folder, "kind": kind, "rows": rows, "seq": last[-1]["seq"]}], manifest["batches"])

    def compact(self) -> None:
        """Merge all parts into one."""
        manifest = self.manifest()
        if len(manifest["parts"]) > 1:
            self._merge(manifest, len(manifest["parts"]))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete data folders that none of the last ``keep`` versions lists, and
        abandoned drafts.  No reader of an older version and no writer may be running."""
        done = self.versions()
        listed = {p["dir"] for v in done[-keep:] for p in self.manifest(v)["parts"]}
        gone = [n for n in files.names_in(self.spark, f"{self.path}/data") if n not in listed]
        for n in gone:
            files.delete(self.spark, f"{self.path}/data/{n}")
        for n in files.names_in(self.spark, f"{self.path}/commits"):
            if n.startswith("draft-"):
                files.delete(self.spark, f"{self.path}/commits/{n}")
        return gone


PREDICTIONS_SCHEMA = "pmid bigint, date date, date_completed date, label int"


class PredictionStore(DeltaTable):
    """The prediction table ``name``: a delta table partitioned by label in the
    warehouse, published as the catalog view ``name`` after every commit.  Opening it
    publishes the newest version again, in case a run died between the two.  A plain
    table of that name is taken over: its rows become the first version."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, fan: int = FAN):
        self.name = name
        super().__init__(spark, path or self.location(spark, name), PREDICTIONS_SCHEMA, "pmid", "label", fan)
        if not self.exists() and self._plain_table():
            self.replace(spark.table(name))
        elif self.exists():
            self.published(self.manifest())

    def _plain_table(self) -> bool:
        return self.spark.catalog.tableExists(self.name) and self.spark.catalog.getTable(self.name).tableType != "VIEW"

    @staticmethod
    def location(spark: SparkSession, name: str) -> str:
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}.store"

    def published(self, manifest: dict) -> None:
        if self._plain_table():  # its rows are in the first version by now
            self.spark.sql(f"DROP TABLE {self.name}")
        cols = ", ".join(self.columns)
        parts = manifest["parts"]
        if not parts:
            nothing = ", ".join(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in self.schema.split(", "))
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS SELECT {nothing} WHERE 1 = 0")
            return
        source = lambda p, extra="": f"SELECT {cols}{extra} FROM parquet.`{self.path}/data/{p['dir']}`"
        upserts = [p for p in parts[1:] if p["kind"] == "upsert"]
        if not upserts:
            body = " UNION ALL ".join(source(p) for p in parts)
        else:
            rows = " UNION ALL ".join(source(p, f", {p['seq']} AS _seq") for p in parts)
            newer = " UNION ALL ".join(f"SELECT {self.key}, {p['seq']} AS _seq FROM parquet.`{self.path}/data/{p['dir']}`" for p in upserts)
            body = (
                f"SELECT {', '.join('a.' + c for c in self.columns)} FROM ({rows}) a LEFT JOIN (SELECT {self.key}, max(_seq) AS _newest FROM ({newer}) "
                f"GROUP BY {self.key}) n ON a.{self.key} = n.{self.key} WHERE n._newest IS NULL OR a._seq >= n._newest"
            )
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS {body}")

    def drop(self) -> None:
        self.spark.sql(f"DROP VIEW IF EXISTS {self.name}")
        files.delete(self.spark, self.path)
