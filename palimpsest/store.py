"""A checkpoint store in a folder of Parquet tables: sealed generations, a hot suffix and tombstones.

One writer at a time; readers see whole commits, as Spark's writers publish them. Each call answers by one batch plan,
so bulk calls (append of many rows, states of all) are the efficient ones.
"""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .functions import canon
from .model import CHECKPOINT, TOMBSTONE
from .operators import checkpoints, compaction, forest
from .scratch import written
from .sources import files, jsonl, metrics

#: A committed checkpoint; identity and result are channels beside the messages, request_id and request_digest the append's.
ROW = (
    "seq long, thread_id string, checkpoint_id string, checkpoint_no long, parent_checkpoint_id string, messages array<string>, state_len long, state_sha256 string,"
    " identity string, result string, request_id string, request_digest string")
COLUMNS = [f.strip().split(" ")[0] for f in ROW.split(",")]
REQUEST = "request_id string, request_digest string"
KEY = ["thread_id", "checkpoint_id"]


FORMAT = 1


def _bytes() -> Column:
    """Bytes of a row's messages, as JSON texts."""
    return F.aggregate("messages", F.lit(0).cast("long"), lambda a, m: a + F.octet_length(m))


class StoreError(Exception):
    """kind: NotFound, Deleted, Conflict, RequestConflict, TooLarge, Precondition, Invalid or OutOfRange."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.counters, self.since, self.readers = dict.fromkeys(metrics.COUNTERS, 0), time.time(), 0
        self.last_write = 0

    # Files ------------------------------------------------------------------------------------------------------

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _there(self, pattern: str) -> list[str]:
        """Names of committed tables that match."""
        p = self._p(pattern)
        found = p.getFileSystem(self._conf).globStatus(self._p(f"{pattern}/_SUCCESS")) or []
        return sorted(s.getPath().getParent().getName() for s in found)

    def _read(self, names: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def generation(self) -> int:
        """The sealed generation that holds, 0 before the first."""
        return max([int(n.split("-")[1]) for n in self._there("generation-*")], default=0)

    def sealed(self) -> DataFrame:
        g = self.generation()
        return self._read([f"generation-{g}"] if g else [], ROW)

    def hot(self) -> DataFrame:
        """Appends since the last seal."""
        g = self.generation()
        return self._read([n for n in self._there("hot-*") if int(n.split("-")[1]) == g], ROW)

    def tombstones(self) -> DataFrame:
        return self._read(self._there("tombstones-*"), TOMBSTONE)

    def sorted_tombstones(self) -> DataFrame:
        """(pos, thread_id, checkpoint_id) in order of their keys."""
        from .operators.history import dense_ids

        return dense_ids(self.tombstones().distinct(), "thread_id", "pos", then=("checkpoint_id",)).select("pos", *KEY)

    def rows(self) -> DataFrame:
        """Live checkpoints: sealed ones and the hot suffix, less tombstones."""
        return self.sealed().unionByName(self.hot()).join(self.tombstones(), KEY, "left_anti")

    # Writes -----------------------------------------------------------------------------------------------------

    def append(self, new: DataFrame, request_id: str | None = None) -> DataFrame:
        """Commits rows of CHECKPOINT (with line_no for their order, identity and result, where there are such columns) as a
        whole, or refuses them all; their keys.

        Parents stand before their children; ids are unique in a thread and never used again. A checkpoint has messages, or
        an identity and no messages; messages need a parent that isn't one of an identity. Lengths and digests of the new
        states are recorded. An append that comes again under its request_id changes nothing; another one under the same
        id is refused."""
        old = self.rows()
        base = (old.agg(F.max("seq")).first()[0] or 0) + 1
        given = lambda name, kind: F.col(name).cast(kind) if name in new.columns else F.lit(None).cast(kind)
        order = F.coalesce(given("line_no", "long"), F.lit(0).cast("long"))
        rows = new.select(order.alias("line_no"), *CHECKPOINT.fieldNames(), given("identity", "string").alias("identity"), given("result", "string").alias("result"))
        digest = None
        if request_id is not None:
            digest = rows.agg(F.concat_ws("-", F.count(F.lit(1)), F.bit_xor(F.xxhash64(*rows.columns)), F.bit_xor(F.xxhash64(F.lit(1), *rows.columns)))).first()[0]
            if known := self.requests().filter(F.col("request_id") == request_id).first():
                if known["request_digest"] != digest:
                    raise StoreError("RequestConflict", f"request {request_id} was another append")
                if not rows.join(self.tombstones(), KEY, "left_semi").isEmpty():
                    raise StoreError("Deleted", "the request's checkpoints were deleted")
                return rows.select(*KEY)
        rows = written(rows.withColumn("seq", F.col("line_no") + base))
        known = old.select(*KEY)
        if not rows.join(known, KEY, "left_semi").isEmpty() or not rows.groupBy(*KEY).count().filter("count > 1").isEmpty():
            raise StoreError("Conflict", "a checkpoint id is there already")
        if not rows.join(self.tombstones(), KEY, "left_semi").isEmpty():
            raise StoreError("Deleted", "a deleted checkpoint id can't be used again")
        bad = "messages is null or (size(messages) = 0) <> (identity is not null) or coalesce(thread_id, '') = '' or coalesce(checkpoint_id, '') = ''"
        if not rows.filter(bad).isEmpty():
            raise StoreError("Invalid", "ids must not be empty, and a checkpoint has messages or an identity")
        above = old.select(*KEY, "identity").unionByName(rows.select(*KEY, "identity")).withColumnsRenamed({"checkpoint_id": "parent_checkpoint_id", "identity": "above"}).withColumn("there", F.lit(True))
        linked = rows.filter("parent_checkpoint_id is not null").join(above, ["thread_id", "parent_checkpoint_id"], "left")
        if not linked.filter("there is null").isEmpty():
            raise StoreError("NotFound", "a parent checkpoint is missing")
        if not linked.filter("above is not null and identity is null").isEmpty():
            raise StoreError("Invalid", "a parent has no messages channel")
        own = old.join(rows.select("thread_id").distinct(), "thread_id", "left_semi")  # states of other threads aren't touched
        s = self._states(own.select(*rows.columns[1:]).unionByName(rows.select(*rows.columns[1:])))
        done = rows.join(s, KEY).withColumns({"state_len": F.octet_length("state").cast("long"), "state_sha256": F.sha2("state", 256), "request_id": F.lit(request_id).cast("string"), "request_digest": F.lit(digest).cast("string")})
        began = time.time_ns()
        done.select(*COLUMNS).write.parquet(f"{self.path}/hot-{self.generation()}-{base:020d}-{uuid.uuid4().hex[:8]}")
        self.last_write = time.time_ns() - began  # the commit of the table is part of its write
        sums = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("messages")), F.lit(0)).alias("m"), F.coalesce(F.sum(_bytes()), F.lit(0)).alias("b")).first()
        self._count(durable_appends=sums["n"], accepted_message_values=sums["m"], accepted_message_json_bytes=sums["b"])
        return rows.select(*KEY)

    def append_bounded(self, new: DataFrame, soft: int, hard: int, request_id: str | None = None) -> bool:
        """append() with a bound on the bytes of messages since the last seal: an append of over `hard` bytes is refused, and
        one that would cross `soft` seals first what is there. Whether it sealed."""
        if not 0 < soft <= hard:
            raise StoreError("Invalid", "limits must be positive, and soft no larger than hard")
        size = new.agg(F.coalesce(F.sum(_bytes()), F.lit(0))).first()[0]
        if size > hard:
            raise StoreError("TooLarge", f"{size} bytes exceed the limit of {hard}")
        hot = self.hot_bytes()
        if sealed := hot > 0 and hot + size > soft:
            self.seal()
        self.append(new, request_id)
        return sealed

    def hot_bytes(self) -> int:
        return self.hot().agg(F.coalesce(F.sum(_bytes()), F.lit(0))).first()[0]

    def requests(self) -> DataFrame:
        """(request_id, request_digest) of all appends that had an id, sealed, pruned or not."""
        named = lambda df: df.filter("request_id is not null").select("request_id", "request_digest")
        return named(self.hot()).unionByName(named(self.sealed())).unionByName(self._read(self._there("requests-*"), REQUEST)).distinct()

    def put(self, thread_id: str, checkpoint_id: str, checkpoint_no: int, parent: str | None, messages: list[str], request_id: str | None = None, identity: str | None = None, result: str | None = None) -> None:
        schema = StructType([*CHECKPOINT, StructField("identity", StringType()), StructField("result", StringType())])
        self.append(self.spark.createDataFrame([(thread_id, checkpoint_id, checkpoint_no, parent, messages, identity, result)], schema), request_id)

    def _count(self, **more: int) -> None:
        for name, n in more.items():
            self.counters[name] = min(self.counters[name] + n, (1 << 64) - 1)

    def prune(self, thread_id: str, checkpoint_id: str) -> int:
        """Deletes a checkpoint and all below it; how many."""
        if self.status(thread_id, checkpoint_id) != "Found":
            raise StoreError(self.status(thread_id, checkpoint_id), f"{thread_id}/{checkpoint_id}")
        nodes = self._nodes(self.rows().filter(F.col("thread_id") == thread_id))
        gone = written(forest.subtree(nodes, F.col("node") == checkpoint_id).select(F.col("thread").alias("thread_id"), F.col("node").alias("checkpoint_id")))
        gone.write.parquet(f"{self.path}/tombstones-{uuid.uuid4().hex}")
        return gone.count()

    def seal(self) -> int:
        """Writes all live checkpoints, densely renumbered, as the next generation."""
        from .operators.history import dense_ids

        g = self.generation() + 1
        self.requests().coalesce(1).write.parquet(f"{self.path}/requests-{g}")
        dense_ids(self.rows().withColumnRenamed("seq", "old"), "old", "seq", then=("thread_id", "checkpoint_id")).select(*COLUMNS).sort("thread_id", "seq").write.parquet(f"{self.path}/generation-{g}")
        return g

    def seal_through(self, n: int) -> int:
        """Seals if the first n checkpoints in order of commitment are all there are, or all that are sealed already: a
        generation ends where an append does."""
        total, sealed = self.rows().count(), self.sealed().join(self.tombstones(), KEY, "left_anti").count()
        if n == sealed and sealed:
            return self.generation()
        if n != total:
            raise StoreError("Precondition", f"{n} is no boundary: {sealed} are sealed of {total}")
        return self.seal()

    def store_id(self) -> str:
        """The store's identity; made on first use."""
        ids = self._there("identity-*")
        return ids[-1].split("-")[-1] if ids else self.reidentify()

    def reidentify(self) -> str:
        """A new identity, for a store that was copied."""
        new = uuid.uuid4().hex
        number = len(self._there("identity-*"))
        self.spark.range(1).write.parquet(f"{self.path}/identity-{number:06d}-{new}")
        return new

    def reclaim(self) -> list[str]:
        """Deletes tables that no generation needs any more; their names. Refused while a reading() is open."""
        g = self.generation()
        if self.readers:
            raise StoreError("Precondition", f"{self.readers} readers still hold an older generation")
        old = [n for n in self._there("generation-*") + self._there("hot-*") if int(n.split("-")[1]) < g]
        for n in old:
            self._p(n).getFileSystem(self._conf).delete(self._p(n), True)
        return old

    # Reads ------------------------------------------------------------------------------------------------------

    @contextmanager
    def reading(self):
        """Holds reclaim() off while frames of this store are read."""
        self.readers += 1
        try:
            yield self
        finally:
            self.readers -= 1

    @staticmethod
    def _nodes(rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({"thread_id": "thread", "checkpoint_id": "node", "parent_checkpoint_id": "parent"})

    def _states(self, rows: DataFrame) -> DataFrame:
        nodes = self._nodes(rows).withColumn("body", F.array_join("messages", ","))
        both = lambda a, b: F.concat_ws(",", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
        way = forest.fold_to_root(nodes, F.col("body"), both).withColumnsRenamed({"thread": "thread_id", "node": "checkpoint_id"})
        return way.join(rows.select(*KEY, "identity", "result"), KEY).select(*KEY, canon.framed(F.col("value"), F.col("identity"), F.col("result")).alias("state"))

    def states(self, thread_id: str | None = None) -> DataFrame:
        """(thread_id, checkpoint_id, state) of all live checkpoints, or of one thread's."""
        rows = self.rows()
        return self._states(rows if thread_id is None else rows.filter(F.col("thread_id") == thread_id))

    def status(self, thread_id: str, checkpoint_id: str) -> str:
        asked = self.spark.createDataFrame([(thread_id, checkpoint_id)], "thread_id string, checkpoint_id string")
        return checkpoints.lookup(self.rows(), self.tombstones(), asked, KEY).first()["status"]

    def _way(self, thread_id: str, checkpoint_id: str) -> DataFrame:
        """The rows from a checkpoint's root to it, with depth: no other state of the thread is built."""
        rows = written(self._nodes(self.rows().filter(F.col("thread_id") == thread_id)))
        path = written(compaction.keep_ancestry(rows, rows.filter(F.col("node") == checkpoint_id)))
        return path.join(forest.depths(path), ["thread", "node"])

    def get(self, thread_id: str, checkpoint_id: str) -> str:
        body = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("depth", "messages"))), lambda x: x["messages"])), ",")
        last = lambda c: F.max_by(c, "depth").alias(c)
        one = self._way(thread_id, checkpoint_id).agg(body.alias("body"), last("identity"), last("result"), F.count(F.lit(1)).alias("n"))
        found = one.select("n", canon.framed(F.col("body"), F.col("identity"), F.col("result")).alias("state")).first()
        self._count(read_requests=1)
        if not found["n"]:
            raise StoreError(self.status(thread_id, checkpoint_id), f"{thread_id}/{checkpoint_id}")
        return found["state"]

    def messages(self, thread_id: str, checkpoint_id: str) -> list[str]:
        """A checkpoint's messages from its root on, as they were appended."""
        found = self._way(thread_id, checkpoint_id).select("depth", "messages").orderBy("depth").collect()
        if not found:
            raise StoreError(self.status(thread_id, checkpoint_id), f"{thread_id}/{checkpoint_id}")
        return [m for r in found for m in r["messages"]]

    def read_range(self, thread_id: str, checkpoint_id: str, offset: int, length: int) -> bytes:
        state = self.get(thread_id, checkpoint_id).encode()
        if offset < 0 or length < 0 or offset + length > len(state):
            raise StoreError("OutOfRange", f"{offset} + {length} of {len(state)}")
        return state[offset : offset + length]

    def list(self, n: int = 100) -> DataFrame:
        return checkpoints.recent(self.rows().select("seq", *KEY, "checkpoint_no", "parent_checkpoint_id", "state_len", "state_sha256"), ["seq"], [F.desc("seq")], n)

    def verify(self) -> dict:
        return checkpoints.verify(self.states(), self.rows(), KEY).first().asDict()

    def fsck(self) -> dict:
        """Checks from the files alone: format, identity, generation and its files, counts, bytes since the last seal and what
        lies behind them (nothing: a table is committed whole or not read), repeated ids, missing and later parents, and
        states whose length or digest isn't the recorded one."""
        rows = self.rows()
        parents = rows.select("thread_id", F.col("checkpoint_id").alias("parent_checkpoint_id"), F.col("seq").alias("above"))
        linked = rows.filter("parent_checkpoint_id is not null").join(parents, ["thread_id", "parent_checkpoint_id"], "left")
        found = linked.agg(F.count_if(F.col("above").isNull()).alias("missing_parents"), F.count_if(F.col("above") > F.col("seq")).alias("later_parents")).first().asDict()
        verified, g = self.verify(), self.generation()
        ids = self._there("identity-*")
        size = lambda name: files.storage(self.spark, f"{self.path}/{name}").first()
        hot = [size(n) for n in self._there("hot-*") if int(n.split("-")[1]) == g]
        return {
            "format_version": FORMAT, "store_id": ids[-1].split("-")[-1] if ids else None, "sealed_generation": g, "sealed_segment_count": size(f"generation-{g}")["files"] if g else 0,
            "checkpoint_count": verified["checked"], "version_count": rows.select(F.expr("1 + cast(size(messages) > 0 as int) + cast(result is not null as int)").alias("v")).agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0],
            "hot_logical_bytes": self.hot_bytes(), "hot_physical_bytes": sum(s["bytes"] for s in hot), "trailing_nonzero_bytes": 0,
            "repeated_ids": rows.groupBy(*KEY).count().filter("count > 1").count(), "failures": verified["failures"] + found["missing_parents"] + found["later_parents"]} | found

    def geometry(self) -> DataFrame:
        return forest.geometry(self._nodes(self.rows()).withColumn("bytes", F.octet_length(F.array_join("messages", ","))), "bytes")

    def stats(self) -> dict:
        sealed = self.sealed().join(self.tombstones(), KEY, "left_anti").count()
        total = self.rows().count()
        return {"checkpoints": total, "sealed_checkpoints": sealed, "hot_checkpoints": total - sealed, "tombstones": self.tombstones().count(), "generation": self.generation()} | files.storage(self.spark, self.path).first().asDict()

    def metrics_text(self) -> str:
        """Prometheus text of all gauges and counters. A Parquet file has no blocks of its own, so allocated bytes are its length."""
        stats = self.stats()
        own = {
            "versions": self.rows().select(F.expr("1 + cast(size(messages) > 0 as int) + cast(result is not null as int)").alias("v")).agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0],
            "sealed_checkpoints": stats["sealed_checkpoints"], "hot_logical_bytes": self.hot_bytes(), "file_length_bytes": stats["bytes"], "allocated_bytes": stats["bytes"], "store_files": stats["files"],
            "service_uptime_seconds": int(time.time() - self.since), "last_append_write_nanoseconds": self.last_write}
        return "".join(r["text"] for r in metrics.text(metrics.gauges(self.geometry())).collect()) + metrics.plain(own, self.counters)

    # Import and export --------------------------------------------------------------------------------------------

    def import_jsonl(self, path: str) -> dict:
        """Imports a file's lines up to the first bad one, then verifies."""
        return self.import_lines(jsonl.numbered_lines(self.spark, path))

    def import_lines(self, lines: DataFrame) -> dict:
        """import_jsonl() of lines (line_no, line)."""
        kept, report = jsonl.import_jsonl(lines)
        kept = written(kept)
        if not kept.isEmpty():
            self.append(kept)
        out = report.first().asDict()
        self._count(import_requests=1, imported_checkpoints=out["checkpoint_count"])
        return out | {"failures": self.verify()["failures"]}

    def export(self, path: str) -> None:
        """One canonical JSON line per checkpoint, in ranges of their order."""
        nodes = self._nodes(self.rows())
        whole = forest.fold_to_root(nodes, F.col("messages"), lambda a, b: F.concat(a, b)).withColumnsRenamed({"thread": "thread_id", "node": "checkpoint_id", "value": "messages"})
        full = self.rows().select("seq", *KEY, "checkpoint_no", "parent_checkpoint_id", "identity", "result").join(whole, KEY)
        files.write_partition(jsonl.export_rows(full), "seq", path)

    def import_export(self, path: str) -> int:
        """Imports what export() wrote into an empty store, as proven deltas; how many checkpoints."""
        if not self.rows().isEmpty():
            raise StoreError("Conflict", "the store isn't empty")
        v = F.parse_json("value")
        channel = lambda name: F.nullif(F.to_json(F.try_variant_get(v, f"$.state.{name}", "variant")), F.lit("null")).alias(name)
        raw = self.spark.read.text(path).select(
            F.from_json("value", "checkpoint_id string, checkpoint_no long, parent_checkpoint_id string, thread_id string", {"mode": "FAILFAST"}).alias("r"), jsonl.json_elements(F.get_json_object("value", "$.state.messages")).alias("messages"),
            channel("identity"), channel("result"))
        d = written(jsonl.import_states(written(raw.select("r.*", "messages", "identity", "result"))))
        if bad := d.filter("error is not null").first():
            raise StoreError("Invalid", f"{bad['thread_id']}/{bad['checkpoint_id']}: {bad['error']}")
        rank = forest.depths(self._nodes(d)).select(F.col("thread").alias("thread_id"), F.col("node").alias("checkpoint_id"), F.col("depth").alias("line_no"))
        self.append(d.drop("messages").withColumnRenamed("delta", "messages").join(rank, KEY))
        return d.count()
