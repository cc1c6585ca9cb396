"""The engine's tables as layers of Parquet parts, and intermediate results in the shared folder.

A table is a list of parts. Each row has an owner (a document for its chunks, tokens and mentions, a name for an entity, a row itself
for relations and links), and a part replaces all that earlier parts hold of its owners, so a write costs what it
changes and not what is stored. A commit is one small file that names the parts of every table. It is created under the next number,
or not at all if another writer was first; what was written meanwhile is then checked against what this writer changes. No folder
is ever written twice, so a reader's tables stay as they are until `vacuum` removes parts that no kept commit and no lease names.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomgraph.frames import stacked
from loomgraph.operators import graph, ingest
from loomgraph.schemas import KEYS, SORTED, TABLES, WITHIN
from loomgraph.scratch import drop_path, scratch_path, shared_dir

#: Trailing parts of about one size are put together when there are so many; each time they grow by about that factor.
FANOUT = 4
#: The owners that later parts replace are broadcast if there are at most so many.
MOST_OWNERS = 100_000
#: Tables whose keys a commit checks: within its own rows, as rows of other owners have other keys.
UNIQUE = ("documents", "chunks", "entities", "merge_history")


class Conflict(RuntimeError):
    """Another writer has changed what this one changes; nothing was written."""


class DuplicateKey(ValueError):
    """Rows of a commit share a key, or stand in the table already; nothing was written."""


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder; it is removed when the session stops."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def owner_of(name: str) -> Column:
    """The owner of a table's rows, as a string."""
    if name in ("chunk_tokens", "mentions"):
        chunk = F.col("id" if name == "chunk_tokens" else "chunk_id")
        return F.when(F.contains(chunk, F.lit(":")), F.regexp_replace(chunk, ":[0-9]+$", "")).otherwise(chunk)
    keys = ["document_id"] if name in ("chunks", "vector_cells") else ["name"] if name == "entity_tokens" else KEYS[name]
    return F.col(keys[0]).cast("string") if len(keys) == 1 else F.to_json(F.array(*keys))


@dataclass
class Change:
    """What a commit does to a table: rows come in the place of all rows of their owners and of those in gone (a column `owner`).

    whole: they come in the place of the whole table. create: none of their owners may have rows yet.
    """

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    whole: bool = False
    create: bool = False


@dataclass
class Snapshot:
    """The tables after one commit; later commits do not change them."""

    store: Store
    number: int
    parts: dict[str, list[dict]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.store._read(name, self.parts.get(name, []))

    def items(self) -> Iterator[tuple[str, DataFrame]]:
        return ((name, self[name]) for name in TABLES)


def open_store(spark: SparkSession, path: str) -> Store:
    """A store by its path; `temporary` is one in the shared folder that goes when the session stops."""
    if not path.strip():
        raise ValueError("a store needs a path, or `temporary`")
    return Store(spark, scratch_path(spark, "store") if path == "temporary" else path)


class Store:
    """Named tables under one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files

    def _fs(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(conf), target

    def _listed(self, folder: str) -> list[tuple[str, float]]:
        """Names in a folder and the seconds since they were changed."""
        fs, target = self._fs(f"{self.path}/{folder}")
        now = time.time()
        return [(x.getPath().getName(), now - x.getModificationTime() / 1000) for x in fs.listStatus(target)] if fs.exists(target) else []

    def _put(self, path: str, text: str) -> bool:
        """Creates a file with its content at once; False if it is there already.

        A finished file gets its name by a link on local disks and by a rename elsewhere. Both fail where the name is taken, on local
        disks and on HDFS; an object store needs a committer or lock of its own for that.
        """
        fs, target = self._fs(path)
        _, part = self._fs(f"{self.path}/_commits/_part-{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(text.encode())
        out.close()
        try:
            if fs.getScheme() == "file":
                java = self.spark.sparkContext._jvm.java
                local = lambda p: java.io.File(p.toUri().getPath()).toPath()
                try:
                    java.nio.file.Files.createLink(local(target), local(part))
                except Exception as e:
                    if "FileAlreadyExistsException" in str(e):
                        return False
                    raise
                return True
            return not fs.exists(target) and fs.rename(part, target)
        finally:
            fs.delete(part, False)

    # reading

    def commits(self) -> list[int]:
        return sorted(int(m[1]) for n, _ in self._listed("_commits") if (m := re.fullmatch(r"c(\d+)", n)))

    def _commit(self, number: int) -> dict:
        fs, path = self._fs(f"{self.path}/_commits/c{number:08d}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def snapshot(self, commit: int | None = None) -> Snapshot:
        """The tables after the last commit or the one given."""
        number = commit or (self.commits() or [0])[-1]
        return Snapshot(self, number, self._commit(number)["parts"] if number else {})

    @contextlib.contextmanager
    def lease(self, commit: int | None = None) -> Iterator[Snapshot]:
        """A snapshot whose parts no vacuum removes as long as the block runs."""
        taken = self.snapshot(commit)
        name = f"{self.path}/_leases/{taken.number:08d}-{uuid.uuid4().hex}"
        fs, path = self._fs(name)
        fs.create(path, False).close()
        try:
            yield taken
        finally:
            fs.delete(path, False)

    def parts(self, name: str) -> list[dict]:
        """The parts of a table's current state, the oldest first: id, rows, gone, bytes, owners (a bound on their number), low and high, at (its commit), whole."""
        return self.snapshot().parts.get(name, [])

    def versions(self, table: str) -> list[str]:
        """Names of the part folders of a table that lie there, used or not."""
        return [n for n, _ in self._listed(table)]

    def table(self, name: str) -> DataFrame:
        """The current rows; an empty table before the first write."""
        return self.snapshot()[name]

    def tables(self) -> Snapshot:
        return self.snapshot()

    def _rows(self, name: str, part: dict) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{part['id']}/rows")

    def _owners(self, name: str, part: dict) -> DataFrame:
        own = self._rows(name, part).select(owner_of(name).alias("owner")) if part["rows"] else None
        gone = self.spark.read.schema("owner string").parquet(f"{self.path}/{name}/{part['id']}/gone") if part["gone"] else None
        both = [x for x in (own, gone) if x is not None]
        return stacked(*both)

    def _read(self, name: str, parts: list[dict]) -> DataFrame:
        """The rows of parts whose owner no later part has: an anti-join of the large part with the few owners of the small ones."""
        held = [(i, p) for i, p in enumerate(parts) if p["rows"]]
        if not held:
            return self.spark.createDataFrame([], TABLES[name])
        if len(parts) == 1:
            return self._rows(name, parts[0])
        # parts that no later one touches are read as they are, all others in one join
        later = {i: [p for p in parts[i + 1 :] if _meet(part, p)] for i, part in held}
        kept = [self._rows(name, part) for i, part in held if not later[i]]
        older = [self._rows(name, part).withColumn("_layer", F.lit(i)) for i, part in held if later[i]]
        if older:
            newer = [(i, p) for i, p in enumerate(parts) if any(p in x for x in later.values())]
            tops = stacked(*(self._owners(name, p).withColumn("_top", F.lit(i)) for i, p in newer)).groupBy(F.col("owner").alias("_owner")).agg(F.max("_top").alias("_top"))
            few = sum(p["owners"] for _, p in newer) <= MOST_OWNERS
            rows = stacked(*older).withColumn("_own", owner_of(name))
            kept.append(rows.join(F.broadcast(tops) if few else tops, (F.col("_own") == F.col("_owner")) & (F.col("_top") > F.col("_layer")), "left_anti").drop("_own", "_layer"))
        return stacked(*kept)

    # writing

    def _written(self, name: str, change: Change) -> dict | None:
        """Writes a new part and returns its description; None if it changes nothing."""
        part = {"id": f"p-{uuid.uuid4().hex}", "rows": 0, "gone": 0, "bytes": 0, "owners": 0, "low": None, "high": None}
        base = f"{self.path}/{name}/{part['id']}"
        lows, highs = [], []
        for kind, rows in (("rows", change.rows), ("gone", change.gone)):
            if rows is None:
                continue
            rows = rows.select(*self.spark.createDataFrame([], TABLES[name]).columns) if kind == "rows" else rows.select(F.col("owner").cast("string").alias("owner")).distinct()
            kept = None
            if kind == "rows" and name in WITHIN:
                rows = rows.sortWithinPartitions(WITHIN[name])
            elif kind == "rows" and name in SORTED:
                # a sort by ranges reads its rows twice, and they may be costly to compute
                kept = scratch_path(self.spark, "unsorted")
                rows.write.parquet(kept)
                rows = self.spark.read.schema(rows.schema).parquet(kept)
                rows = rows.repartitionByRange(SORTED[name]).sortWithinPartitions(SORTED[name])
            # counted while they are written, so that the part is not read again
            seen, owner = Observation(), owner_of(name) if kind == "rows" else F.col("owner")
            rows.observe(seen, F.count(F.lit(1)).alias("n"), F.min(owner).alias("low"), F.max(owner).alias("high")).write.parquet(f"{base}/{kind}")
            if kept:
                drop_path(self.spark.sparkContext, kept)
            told = seen.get
            part[kind] = told["n"]
            part["owners"] += told["n"]
            if told["n"]:
                lows.append(told["low"])
                highs.append(told["high"])
        if not part["rows"] and not part["gone"]:
            self._fs(base)[0].delete(self._fs(base)[1], True)
            return None
        part["low"], part["high"] = min(lows), max(highs)
        fs, path = self._fs(base)
        part["bytes"] = fs.getContentSummary(path).getLength()
        if part["rows"] and name in UNIQUE and self._rows(name, part).groupBy(*KEYS[name]).count().where("count > 1").take(1):
            fs.delete(path, True)
            raise DuplicateKey(f"rows of {name} share a key")
        return part

    def commit(self, tables: dict[str, DataFrame | Change], base: Snapshot | None = None) -> int:
        """All changes become current together, under a new number; a DataFrame is the whole new table.

        base: what the changes were made from (the last commit if not given). If others have committed since, the changes still hold where no
        owner is changed by both; otherwise nothing is written and Conflict is raised.
        """
        base = base or self.snapshot()
        changes = {name: c if isinstance(c, Change) else Change(c, whole=True) for name, c in tables.items()}
        new: dict[str, dict | None] = {}
        try:
            for name, change in changes.items():
                new[name] = self._written(name, change)
                if change.create and new[name] and self._present(name, new[name], base.parts.get(name, [])):
                    raise DuplicateKey(f"rows of {name} are there already")

            def apply(now: Snapshot) -> dict[str, list[dict]]:
                for name, change in changes.items():
                    before, after = base.parts.get(name, []), now.parts.get(name, [])
                    added = [p for p in after if p["at"] > base.number]
                    if (added and (change.whole or any(p["whole"] for p in added))) or (before and not after):
                        raise Conflict(f"{name} was rewritten by another writer")
                    if new[name] and self._present(name, new[name], added):
                        raise Conflict(f"rows of {name} were changed by another writer")
                out = dict(now.parts)
                for name, change in changes.items():
                    own = [new[name] | {"at": now.number + 1, "whole": change.whole}] if new[name] else []
                    out[name] = own if change.whole else [*out.get(name, []), *own]
                return out

            number = self._publish(base, apply)
        except BaseException:
            for name, part in new.items():
                if part:
                    fs, path = self._fs(f"{self.path}/{name}/{part['id']}")
                    fs.delete(path, True)
            raise
        for name in changes:
            self._compact(name)
        return number

    def _present(self, name: str, part: dict, others: list[dict]) -> bool:
        """Whether a part has an owner of one of the others; only parts whose range of owners meets its own are read."""
        near = [p for p in others if _meet(part, p)]
        if not near:
            return False
        between = F.col("owner").between(part["low"], part["high"])
        theirs = stacked(*(self._owners(name, p) for p in near)).where(between)
        own = self._owners(name, part).distinct()
        return bool(theirs.join(F.broadcast(own) if part["owners"] <= MOST_OWNERS else own, "owner", "left_semi").take(1))

    def _publish(self, base: Snapshot, apply) -> int:
        """Creates the next commit from what apply makes of the present one, again if another writer was first."""
        now = base if base.number == (self.commits() or [0])[-1] else self.snapshot()
        while True:
            state = {"parts": apply(now)}
            if self._put(f"{self.path}/_commits/c{now.number + 1:08d}", json.dumps(state)):
                return now.number + 1
            now = self.snapshot()

    def write(self, name: str, rows: DataFrame) -> None:
        """rows become the current version of one table."""
        self.commit({name: rows})

    def upsert(self, name: str, rows: DataFrame) -> None:
        """rows come in the place of those of their owners."""
        self.commit({name: Change(rows)})

    def insert(self, name: str, rows: DataFrame) -> None:
        """rows are added; DuplicateKey if one of their owners is there."""
        self.commit({name: Change(rows, create=True)})

    def clear(self) -> None:
        """Every table becomes empty; schemas stay."""
        self._publish(self.snapshot(), lambda now: {})

    # upkeep

    def _compact(self, name: str) -> None:
        """Puts the last parts together where FANOUT of them are of about one size, so that there are few parts and a row is rewritten
        a number of times that grows with the logarithm of the table."""
        now = self.snapshot()
        parts = now.parts.get(name, [])
        tier = lambda p: (p["rows"] + p["gone"]).bit_length() // 2
        tail = len(parts)
        while tail and tier(parts[tail - 1]) <= tier(parts[-1]):
            tail -= 1
        if len(parts) - tail >= FANOUT:
            self._merge(name, now, tail)

    def compact(self, name: str | None = None) -> None:
        """Every table, or the one named, becomes a single part."""
        for table in [name] if name else TABLES:
            now = self.snapshot()
            if len(now.parts.get(table, [])) > 1:
                self._merge(table, now, 0)

    def _merge(self, name: str, now: Snapshot, first: int) -> None:
        old = now.parts[name][first:]
        gone = stacked(*(self._owners(name, p) for p in old)) if first else None
        part = self._written(name, Change(self._read(name, old), gone))
        ids = [p["id"] for p in old]
        # the commit that last brought new rows, for writers that look for what came after their own base
        made = [part | {"at": max(p["at"] for p in old), "whole": any(p["whole"] for p in old)}] if part else []

        def apply(latest: Snapshot) -> dict[str, list[dict]]:
            there = latest.parts.get(name, [])
            at = next((i for i in range(len(there)) if [p["id"] for p in there[i : i + len(ids)]] == ids), None)
            if at is None:
                raise Conflict(f"{name} was rewritten")
            return latest.parts | {name: [*there[:at], *made, *there[at + len(ids) :]]}

        # another writer that has put them together or rewritten the table leaves nothing to do
        with contextlib.suppress(Conflict):
            self._publish(now, apply)

    def vacuum(self, hours: float = 168, keep: int = 2) -> None:
        """Removes parts that no commit names of the last `keep`, of the last `hours`, or under a lease, and commits beyond these.

        Parts younger than that stay, as their commit may not be written yet; so do leases, which count for as long.
        """
        aged = {int(m[1]): age for n, age in self._listed("_commits") if (m := re.fullmatch(r"c(\d+)", n))}
        leased = {int(n.split("-")[0]) for n, age in self._listed("_leases") if age < max(hours, 168) * 3600}
        kept = {n for n, age in aged.items() if age < hours * 3600 or n in leased} | set(sorted(aged)[-keep:])
        named = {p["id"] for n in kept for parts in self._commit(n)["parts"].values() for p in parts}
        for name in TABLES:
            for part, age in self._listed(name):
                if part not in named and age >= hours * 3600:
                    drop_path(self.spark.sparkContext, f"{self.path}/{name}/{part}")
        for number in set(aged) - kept:
            drop_path(self.spark.sparkContext, f"{self.path}/_commits/c{number:08d}")

    def violations(self) -> dict[str, int]:
        """How many keys stand more than once, by table."""
        return {name: ingest.violations(rows, KEYS[name]).count() for name, rows in self.tables().items()}

    def stats(self) -> DataFrame:
        return graph.stats(self.tables())


def _meet(a: dict, b: dict) -> bool:
    """Whether the ranges of the owners of two parts overlap."""
    return a["low"] <= b["high"] and b["low"] <= a["high"]
