"""Where memory tables live: a folder of Parquet tables, or temporary views.

Tables are partitioned by tenant where they have one, so that a tenant's predicate prunes files: a folder per tenant, or
for rows of many tenants written at once a fixed number of buckets of tenants (the pool, a folder within the table's).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..plans.lineage import materialise

#: Tenants of one write up to which each gets a folder; more of them share the buckets of the pool.
FOLDERS, BUCKETS, POOL, BUCKET = 256, 64, "_pool", "tenant_bucket"

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_AGENT = re.compile(r"[a-zA-Z0-9][a-zA-Z0-9_\-]{0,63}")


class MemoryCatalogError(ValueError):
    """A name, a quota or a row that the catalog doesn't take."""


def identifier(name: str) -> str:
    """``name`` if it is a plain identifier, checked when a plan is built."""
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise MemoryCatalogError(f"not an identifier: {name!r}")
    return name


def agent_name(name: str) -> str:
    if not isinstance(name, str) or not _AGENT.fullmatch(name):
        raise MemoryCatalogError(f"not an agent name: {name!r}")
    return name


def is_identifier(name: Column) -> Column:
    """:func:`identifier` over a column: whether a name would pass; null doesn't."""
    return F.coalesce(name.rlike(f"^(?:{_IDENTIFIER.pattern})\\z"), F.lit(False))


def is_agent_name(name: Column) -> Column:
    """:func:`agent_name` over a column."""
    return F.coalesce(name.rlike(f"^(?:{_AGENT.pattern})\\z"), F.lit(False))


def _bucket(tenant: Column) -> Column:
    return F.pmod(F.xxhash64(tenant), F.lit(BUCKETS)).cast("int")


class Catalog:
    """Loads and saves memory tables of one agent (or of all, with ``agent=None``)."""

    def __init__(self, spark: SparkSession, root: str | None = None, agent: str | None = None, max_memory_mb: int = 100, backend: str = "parquet"):
        if backend not in ("parquet", "view"):
            raise MemoryCatalogError(f"unknown backend: {backend!r}")
        if backend == "parquet" and not root:
            raise MemoryCatalogError("a parquet catalog needs a folder")
        if max_memory_mb <= 0:
            raise MemoryCatalogError("the quota must be positive")
        self.spark, self.root, self.backend, self.max_memory_mb = spark, (root or "").rstrip("/"), backend, max_memory_mb
        self.agent = agent if agent is None else agent_name(agent)

    def _path(self, table: str) -> str:
        return f"{self.root}/{identifier(table)}"

    def _exists(self, table: str) -> bool:
        if self.backend == "view":
            return self.spark.catalog.tableExists(identifier(table))
        store, path = self._hadoop(f"{self.root}/{table}")
        return store.exists(path)

    def load(self, table: str) -> DataFrame:
        """A table in its declared layout, this agent's rows only; an empty one if it was never written.

        A table that can't be read raises: unreadable is never empty.
        """
        schema = schemas.TABLES.get(identifier(table))
        if not self._exists(table):
            if schema is None:
                raise MemoryCatalogError(f"unknown table: {table}")
            return self.spark.createDataFrame([], schema)
        if self.backend == "view":
            df = self.spark.table(table)
            df = df if schema is None else self.spark.createDataFrame([], schema).unionByName(df, allowMissingColumns=True)
        else:
            return self._stored(table, schema, self.agent)
        owner = self._owner(df.columns)
        return df if self.agent is None or owner is None else df.where(F.col(owner) == self.agent)

    def _stored(self, table: str, schema: str | None, agent: str | None = None, **options: str) -> DataFrame:
        """What the folders and the pool of a table hold, of one agent if it is given."""
        pooled, parts = self._exists(f"{table}/{POOL}"), []
        if not pooled or self._has_folders(table):
            parts.append(self._read(self._path(table), schema, options))
        if pooled:
            parts.append(self._read(self._pool(table), schema and f"{schema}, {BUCKET} int", options))
        found = None
        for df in parts:
            owner = self._owner(df.columns)
            if agent is not None and owner is not None:
                df = df.where(F.col(owner) == agent)
                df = df.where(F.col(BUCKET) == _bucket(F.lit(agent))) if BUCKET in df.columns else df
            df = df.drop(BUCKET)
            found = df if found is None else found.unionByName(df, allowMissingColumns=True)
        return found

    def _read(self, folder: str, schema: str | None, options: dict[str, str]) -> DataFrame:
        """The declared layout: what older files lack is null, and no footer is read to find out; without one all footers are."""
        reader = self.spark.read.options(**options)
        return reader.option("mergeSchema", "true").parquet(folder) if schema is None else reader.schema(schema).parquet(folder)

    def _pool(self, table: str) -> str:
        return f"{self._path(table)}/{POOL}"

    def _has_folders(self, table: str) -> bool:
        store, path = self._hadoop(self._path(table))
        found = store.listStatusIterator(path)
        while found.hasNext():
            if not found.next().getPath().getName().startswith(("_", ".")):
                return True
        return False

    @staticmethod
    def _owner(columns: Sequence[str]) -> str | None:
        return next((c for c in ("agent_id", "agent_name") if c in columns), None)

    def _tenant(self, columns: Sequence[str]) -> list[str]:
        return [c for c in ("agent_id", "agent_name", "edge_type") if c in columns][:1]

    def _many(self, rows: DataFrame, tenant: Sequence[str]) -> bool:
        """Whether ``rows`` have more tenants than get folders of their own."""
        return self.agent is None and bool(tenant) and rows.select(*tenant).distinct().limit(FOLDERS + 1).count() > FOLDERS

    def save(self, table: str, rows: DataFrame, mode: str = "append") -> None:
        """Adds ``rows``, or with ``overwrite`` replaces the whole table, of all agents.

        Under a quota appended rows are written aside first, so that a write which would pass it is refused.
        """
        if self.backend == "view":
            kept = self.spark.table(table).unionByName(rows, allowMissingColumns=True) if mode == "append" and self._exists(table) else rows
            kept.createOrReplaceTempView(identifier(table))
            return
        tenant, aside = self._tenant(rows.columns), f"{self.root}/_aside/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(aside)
            staged = self.spark.read.schema(rows.schema).parquet(aside)
            if mode == "append":
                self.check_quota(self._bytes(aside), staged)
            if self._many(staged, tenant):
                if mode == "overwrite":
                    self._delete(self._path(table))
                self._write_pool(table, staged, mode)
            else:
                self._gathered(staged, tenant).write.mode(mode).partitionBy(*tenant).parquet(self._path(table))
        finally:
            self._delete(aside)

    @staticmethod
    def _gathered(rows: DataFrame, tenant: Sequence[str]) -> DataFrame:
        """A tenant's rows together, so that a write makes a file per tenant and not per task and tenant; large tenants are split."""
        return rows.hint("rebalance", *tenant) if tenant else rows

    def _write_pool(self, table: str, rows: DataFrame, mode: str) -> None:
        """Adds ``rows`` to the pool, or with ``overwrite`` puts them in place of their buckets; sorted by tenant, so that row groups are pruned."""
        tenant = self._tenant(rows.columns)
        dealt = rows.withColumn(BUCKET, _bucket(F.col(tenant[0]))).hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *tenant)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self._pool(table))

    def _repool(self, table: str, agents: DataFrame, rows: DataFrame | None = None) -> None:
        """Takes ``agents`` (one column) out of the pool and puts ``rows`` in; only their buckets are written again."""
        (tenant,), schema, rest = agents.columns, schemas.TABLES.get(table), None
        pooled = self._exists(f"{table}/{POOL}")
        if not pooled and rows is None:
            return
        touched = [r[0] for r in agents.select(_bucket(F.col(tenant))).distinct().collect()]
        if pooled:
            pooled = self._read(self._pool(table), schema and f"{schema}, {BUCKET} int", {}).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
            gone = agents.select(F.col(tenant).alias("gone"))
            rest = pooled.join(gone, F.col(tenant).eqNullSafe(F.col("gone")), "left_anti")
        after = materialise(rest if rows is None else rows if rest is None else rest.unionByName(rows, allowMissingColumns=True))
        self._write_pool(table, after, "overwrite")
        kept = {r[0] for r in after.select(_bucket(F.col(tenant))).distinct().collect()}
        for k in set(touched) - kept:  # an overwrite without rows replaces nothing
            self._delete(f"{self._pool(table)}/{BUCKET}={k}")

    def _drop_folders(self, table: str, agents: DataFrame) -> None:
        """Deletes the folders of ``agents`` (one column), where they have one."""
        if not self._exists(table):
            return
        (tenant,) = agents.columns
        store, path = self._hadoop(self._path(table))
        names = [n for x in store.listStatus(path) if (n := x.getPath().getName()).startswith(f"{tenant}=")]
        value = lambda n: None if n.endswith("=__HIVE_DEFAULT_PARTITION__") else unquote(n.split("=", 1)[1])
        own = self.spark.createDataFrame([(n, value(n)) for n in names], "name string, held string")
        for r in own.join(agents, F.col("held").eqNullSafe(F.col(tenant)), "left_semi").collect():
            self._delete(f"{self._path(table)}/{r['name']}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """Puts ``rows`` in place of this agent's part of a table, also where none is left; other agents' rows stay.

        ``rows`` must not be read from the table any more (materialise them first).
        """
        tenant = self._tenant(rows.columns)
        if self.agent is None or tenant[:1] not in (["agent_id"], ["agent_name"]):
            self.save(table, rows, mode="overwrite")
        elif self.backend == "view":
            others = self.spark.table(identifier(table)).where(~F.col(tenant[0]).eqNullSafe(self.agent)) if self._exists(table) else None
            self.save(table, rows if others is None else others.unionByName(rows, allowMissingColumns=True), mode="overwrite")
        else:
            if rows.isEmpty():
                self._delete(f"{self._path(table)}/{tenant[0]}={self.agent}")  # an overwrite without rows would replace nothing
            else:
                rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*tenant).parquet(self._path(table))
            self._repool(table, self.spark.createDataFrame([(self.agent,)], f"{tenant[0]} string"))

    def replace_agents(self, table: str, rows: DataFrame) -> None:
        """Puts ``rows`` in place of what their agents have in a table; agents without a row among them keep theirs."""
        tenant, ready = self._tenant(rows.columns), materialise(rows)
        if self.backend == "view":
            agents = ready.select(*tenant).distinct()
            rest = self.load(table).join(agents, tenant, "left_anti")
            self.save(table, materialise(rest.unionByName(ready)), mode="overwrite")
        elif self._many(ready, tenant):
            agents = ready.select(*tenant).distinct()
            self._repool(table, agents, ready)
            self._drop_folders(table, agents)
        else:
            ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*tenant).parquet(self._path(table))
            self._repool(table, ready.select(*tenant).distinct())

    def _hadoop(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _delete(self, folder: str) -> None:
        store, path = self._hadoop(folder)
        store.delete(path, True)

    def _bytes(self, folder: str) -> int:
        store, path = self._hadoop(folder)
        return int(store.getContentSummary(path).getLength()) if store.exists(path) else 0

    def _tables(self) -> list[str]:
        store, path = self._hadoop(self.root)
        found = store.listStatus(path) if store.exists(path) else []
        return [n for x in found if x.isDirectory() and not (n := x.getPath().getName()).startswith("_") and _IDENTIFIER.fullmatch(n)]

    def size_bytes(self) -> int:
        """What this agent's partitions hold (for all agents all tables), from the file system's own summary; of a bucket
        that it shares with others, its part by rows."""
        if self.backend == "view":
            return 0
        if self.agent is None:
            return sum(self._bytes(self._path(t)) for t in self._tables())
        own = sum(self._bytes(f"{self.root}/{t}/{c}={self.agent}") for t in self._tables() for c in ("agent_id", "agent_name"))
        return own + sum(self._pooled_bytes(t) for t in self._tables() if self._exists(f"{t}/{POOL}"))

    def _pooled_bytes(self, table: str) -> int:
        pooled = self._read(self._pool(table), None, {})
        owner = self._owner(pooled.columns)
        if owner is None:
            return 0
        mine = F.sum(F.when(F.col(owner) == self.agent, 1).otherwise(0))
        row = pooled.where(F.col(BUCKET) == _bucket(F.lit(self.agent))).agg(F.first(BUCKET), mine, F.count("*")).first()
        return -(-self._bytes(f"{self._pool(table)}/{BUCKET}={row[0]}") * row[1] // row[2]) if row[2] and row[1] else 0

    def check_quota(self, more: int = 0, rows: DataFrame | None = None) -> None:
        """Raises if what the agent holds and ``more`` bytes pass its quota.

        The quota is an agent's: where a catalog of all agents adds ``rows`` of ``more`` bytes, it holds for each agent among
        them, whose part of a table's bytes is that of its rows. Where that can't be told, it holds for all together.
        """
        quota, held = self.max_memory_mb * 1024 * 1024, self.size_bytes()
        if held + more <= quota:
            return
        owner = None if self.agent is not None or rows is None else self._owner(rows.columns)
        name = self.agent or self.root
        if owner is not None:
            most = self._parts(rows, owner, held, more).orderBy(F.desc("bytes"), "owner").first()
            if most is None or most["bytes"] <= quota:
                return
            name = most["owner"]
        raise MemoryCatalogError(f"the memory of {name} exceeds {self.max_memory_mb} MB")

    def _parts(self, rows: DataFrame, owner: str, held: int, more: int) -> DataFrame:
        """``owner, bytes``: what each agent of ``rows`` has of the ``held`` bytes and of the ``more`` that ``rows`` bring."""
        sizes = {t: self._bytes(self._path(t)) for t in self._tables()}
        shares = [(rows.select(F.col(owner).alias("owner")), more)]
        for table, size in sizes.items():
            df = self.load(table)
            if (own := self._owner(df.columns)) is not None and size:
                shares.append((df.select(F.col(own).alias("owner")), held * size / sum(sizes.values())))
        every = None
        for df, size in shares:
            counted = df.groupBy("owner").agg(F.count("*").alias("n"))
            total = counted.agg(F.sum("n").alias("total"))  # one row
            part = counted.crossJoin(F.broadcast(total)).select("owner", (F.col("n") / F.col("total") * F.lit(float(size))).alias("bytes"))
            part = part.withColumn("adds", F.lit(every is None))
            every = part if every is None else every.unionByName(part)
        return every.groupBy("owner").agg(F.sum("bytes").alias("bytes"), F.max("adds").alias("adds")).where("adds")

    def salvage(self, other: Catalog, tables: Sequence[str]) -> dict[str, int | None]:
        """Copies what can be read of ``tables`` into a fresh store, whole rows only: rows copied by table, None for a table that is beyond reading.

        Files that are corrupt or missing are passed over; their rows are lost, the rest of the table is not.
        """
        found: dict[str, int | None] = {}
        for table in tables:
            try:
                schema = schemas.TABLES[identifier(table)]
                found_rows = self._stored(table, schema, ignoreCorruptFiles="true", ignoreMissingFiles="true")
                other.save(table, found_rows, mode="overwrite")
                found[table] = other.load(table).count()
            except (AnalysisException, KeyError):
                found[table] = None
        return found

    def copy_to(self, other: Catalog, tables: Sequence[str]) -> None:
        """A full copy of ``tables`` into a fresh store."""
        for table in tables:
            other.save(table, self.load(table), mode="overwrite")
