"""Versioned byte sequences as a store in a folder of Parquet tables: sealed snapshots and the operations since.

An operation is decided by folding it behind its own history's snapshot and operations, so a batch costs what its histories
hold since the last seal, and histories replay apart. Tables are dealt into folders by history, so that a batch reads
those of its histories. One writer at a time; a batch commits as one table or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import OPERATION, OUTCOME, RECEIPTS, STEP
from .operators import compaction, history
from .scratch import dropped, written

BUCKETS = 64
#: A committed table: operations with their outcomes, and the folder they lie in.
LOG = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in OPERATION), *(f"{f.name} {f.dataType.simpleString()}" for f in OUTCOME if f.name not in OPERATION.fieldNames()), "bucket int"])
SNAPSHOT = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in STEP), "bucket int"])


def bucket(history_id: Column) -> Column:
    return F.pmod(history_id, F.lit(BUCKETS)).cast("int")


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # Tables -----------------------------------------------------------------------------------------------------

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _there(self, pattern: str) -> list[str]:
        """Names of committed tables that match."""
        found = self._p(pattern).getFileSystem(self._conf).globStatus(self._p(f"{pattern}/_SUCCESS")) or []
        return sorted(s.getPath().getParent().getName() for s in found)

    def _read(self, names: list[str], schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for n in names:  # each is a table of its own, partitioned by bucket
            out = out.unionByName(self.spark.read.schema(schema).parquet(f"{self.path}/{n}"))
        return out

    def generation(self) -> int:
        """The sealed generation that holds, 0 before the first."""
        return max([int(n.split("-")[1]) for n in self._there("snapshot-*")], default=0)

    def sealed(self) -> DataFrame:
        """The snapshot's steps."""
        g = self.generation()
        return self._read([f"snapshot-{g}"] if g else [], SNAPSHOT)

    def log(self) -> DataFrame:
        """Operations since the last seal, with their outcomes."""
        return self._read(self._there(f"log-{self.generation()}-*"), LOG)

    def steps(self) -> DataFrame:
        """What new operations come behind."""
        return self.sealed().unionByName(history.as_steps(self.log()).withColumn("bucket", bucket(F.col("history_id"))))

    # Operations -------------------------------------------------------------------------------------------------

    def apply(self, ops: DataFrame) -> DataFrame:
        """Decides and commits operations (OPERATION), in order of seq within a history; their outcomes.

        Rows whose seq isn't above all that their history holds were delivered before: they change nothing and have no
        outcome. Seqs are unique in the store."""
        ops = written(ops.select(*OPERATION.fieldNames()).withColumn("bucket", bucket(F.col("history_id"))))
        known = self.steps().join(ops.select("bucket", "history_id").distinct(), ["bucket", "history_id"], "left_semi")
        last = known.filter("op <> 'receipt'").groupBy("history_id").agg(F.max("seq").alias("last"))
        new = ops.join(last, "history_id", "left").filter("last is null or seq > last").drop("last")
        found = history.resume(known.drop("bucket"), new)
        own = [c for c in OUTCOME.fieldNames() if c not in ("op", "parent_seq")]
        done = new.join(found.select(*own), ["history_id", "seq"])
        name = f"log-{self.generation()}-{len(self._there('log-*')):08d}-{uuid.uuid4().hex[:8]}"
        done.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        dropped(ops)
        above = F.when(F.col("outcome").isin("Committed", "Forked"), F.col("parent_seq")).alias("parent_seq")
        return self._read([name], LOG).select(*[above if n == "parent_seq" else n for n in OUTCOME.fieldNames()])

    def _one(self, kind: str, history_id: int, **more) -> dict:
        seq = self.next_seq()
        row = dict.fromkeys(OPERATION.fieldNames()) | {"seq": seq, "op": kind, "history_id": history_id} | more
        return self.apply(self.spark.createDataFrame([tuple(row[f] for f in OPERATION.fieldNames())], OPERATION)).first().asDict(recursive=True)

    def next_seq(self) -> int:
        top = self.steps().filter("op <> 'receipt'").agg(F.max("seq")).first()[0]
        return 0 if top is None else top + 1

    def create_history(self, binding: bytes | None = None) -> int:
        """A new history's id, or the one that has this binding already."""
        made = self.histories()
        if binding is not None and (found := made.filter(F.col("binding") == F.lit(binding)).first()):
            return found["history_id"]
        top = made.agg(F.max("history_id")).first()[0]
        new = 0 if top is None else top + 1
        self._one("create", new, binding=binding)
        return new

    def splice(self, history_id: int, parent: int | None, offset: int, delete_len: int, insert: bytes, request_id: bytes | None = None, binding: bytes | None = None) -> dict:
        return self._one("splice", history_id, parent_seq=parent, offset=offset, delete_len=delete_len, insert=insert, request_id=request_id, binding=binding)

    def append(self, history_id: int, parent: int | None, insert: bytes, request_id: bytes | None = None, binding: bytes | None = None) -> dict:
        return self._one("append", history_id, parent_seq=parent, insert=insert, request_id=request_id, binding=binding)

    def fork(self, history_id: int, parent: int, request_id: bytes | None = None, binding: bytes | None = None) -> dict:
        return self._one("fork", history_id, parent_seq=parent, request_id=request_id, binding=binding)

    def expire(self, history_id: int, version: int) -> dict:
        return self._one("expire", history_id, target_seq=version)

    def retire(self, history_id: int, request_id: bytes) -> dict:
        return self._one("retire", history_id, target=request_id)

    # Generations --------------------------------------------------------------------------------------------------

    def seal(self) -> int:
        """Writes the state as the next generation's snapshot, without bytes that only expired versions show."""
        g = self.generation() + 1
        made = history.snapshot(self.steps().drop("bucket"))
        bound = self.histories().select("history_id", F.col("binding").alias("of_history"))
        kept = made.join(bound, "history_id", "left").withColumn("binding", F.when(F.col("op") == "create", F.col("of_history")).otherwise(F.col("binding"))).drop("of_history")
        kept.withColumn("bucket", bucket(F.col("history_id"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/snapshot-{g}")
        return g

    def export_image(self, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The retained versions among roots (history_id, seq), and the leaves that they show: tables that import_image() takes."""
        return compaction.export_image(self.versions().filter("retained"), self.leaves(), roots)

    def import_image(self, versions: DataFrame, leaves: DataFrame) -> int:
        """Makes an image the first generation of an empty store; how many versions. Parents that aren't in the image become
        null; an image with structural faults is refused."""
        if self.generation() or self._there("log-*"):
            raise ValueError("the store isn't empty")
        versions, leaves = written(versions.select("history_id", "seq", "parent_seq", "len", "binding", "pieces")), written(leaves.select("history_id", "leaf", "payload"))
        if bad := compaction.image_faults(versions, leaves).first():
            raise ValueError(f"{bad['history_id']}/{bad['seq']}: {bad['fault']}")
        there = versions.select("history_id", F.col("seq").alias("parent_seq"), F.lit(True).alias("there"))
        linked = versions.join(there, ["history_id", "parent_seq"], "left").withColumn("parent_seq", F.when(F.col("there"), F.col("parent_seq"))).drop("there")
        own = versions.groupBy("history_id").agg(F.max("seq").alias("seq"))

        def steps(df: DataFrame, **more: Column | None) -> DataFrame:
            found = {"phase": F.lit(0)} | {c: F.col(c) for c in df.columns} | more
            return df.select(*[found.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in STEP])

        made = steps(linked, op=F.lit("version")).unionByName(steps(leaves, op=F.lit("leaf"), seq=F.col("leaf"), insert=F.col("payload")))
        made = made.unionByName(steps(own, op=F.lit("last"))).unionByName(steps(own, op=F.lit("create"), seq=F.lit(0)))
        made.withColumn("bucket", bucket(F.col("history_id"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/snapshot-1")
        return versions.count()

    def collect_garbage(self) -> dict:
        """Seals, and deletes the generations before; leaves and bytes before, after and reclaimed."""
        count = lambda: self.leaves().agg(F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("bytes")).first()
        before = count()
        self.seal()
        self.reclaim()
        after = count()
        return {f"{k}_{when}": n for k in ("leaves", "bytes") for when, n in (("before", before[k]), ("after", after[k]), ("reclaimed", before[k] - after[k]))}

    def reclaim(self) -> list[str]:
        """Deletes tables of generations before the one that holds; their names."""
        g = self.generation()
        old = [n for n in self._there("snapshot-*") + self._there("log-*") if int(n.split("-")[1]) < g]
        for n in old:
            self._p(n).getFileSystem(self._conf).delete(self._p(n), True)
        return old

    # Reads ----------------------------------------------------------------------------------------------------------

    def histories(self) -> DataFrame:
        """(history_id, binding)."""
        made = self.log().filter("outcome = 'Created'").select("history_id", "binding")
        return self.sealed().filter("op = 'create'").select("history_id", "binding").unionByName(made)

    def versions(self) -> DataFrame:
        """(history_id, seq, parent_seq, len, binding, pieces, retained) of all versions, expired ones too."""
        hot = self.log()
        made = hot.filter("outcome in ('Committed', 'Forked')").select("history_id", "seq", "parent_seq", "len", "binding", "pieces", F.lit(True).alias("kept"))
        every = self.sealed().filter("op = 'version'").select("history_id", "seq", "parent_seq", "len", "binding", "pieces", F.col("pieces").isNotNull().alias("kept")).unionByName(made)
        gone = hot.filter("outcome = 'Expired'").select("history_id", F.col("version_seq").alias("seq"), F.lit(True).alias("gone"))
        return every.join(gone, ["history_id", "seq"], "left").withColumn("retained", F.col("kept") & F.col("gone").isNull()).drop("kept", "gone")

    def leaves(self) -> DataFrame:
        """(history_id, leaf, payload)."""
        new = self.log().filter("outcome = 'Committed' and octet_length(insert) > 0").select("history_id", F.col("seq").alias("leaf"), F.col("insert").alias("payload"))
        return self.sealed().filter("op = 'leaf'").select("history_id", F.col("seq").alias("leaf"), F.col("insert").alias("payload")).unionByName(new)

    def _of(self, history_id: int) -> DataFrame:
        """One history's steps: a read of its folder alone."""
        return self.steps().filter((F.col("bucket") == history_id % BUCKETS) & (F.col("history_id") == history_id)).drop("bucket")

    def receipts(self, history_id: int | None = None) -> DataFrame:
        """(history_id, request_id, state): Active or Retired; those beyond the horizon are forgotten."""
        return history.receipts(self.steps().drop("bucket") if history_id is None else self._of(history_id))

    def receipt_status(self, history_id: int, request_id: bytes) -> str:
        found = self.receipts(history_id).filter(F.col("request_id") == F.lit(request_id)).first()
        return found["state"] if found else "Unknown"

    def receipt_count(self, history_id: int) -> int:
        return self.receipts(history_id).count()

    def retired_requests(self, history_id: int) -> list[bytes]:
        """In order of their bytes; at most as many as the horizon."""
        return [bytes(r["request_id"]) for r in self.receipts(history_id).filter("state = 'Retired'").orderBy("request_id").collect()]

    def receipt_capacity(self) -> int:
        return RECEIPTS

    def read(self, requests: DataFrame) -> DataFrame:
        """requests (history_id, seq, off, n) with bytes_hex, or error NotFound, VersionExpired or OutOfRange."""
        return history.read(self.versions(), self.leaves(), requests)

    def version_of(self, history_id: int, binding: bytes) -> int | None:
        """The version that a binding names, or None."""
        found = self.versions().filter((F.col("history_id") == history_id) & (F.col("binding") == F.lit(binding))).first()
        return found["seq"] if found else None

    def binding_of(self, history_id: int, version: int) -> bytes | None:
        found = self.versions().filter((F.col("history_id") == history_id) & (F.col("seq") == version)).first()
        return bytes(found["binding"]) if found and found["binding"] is not None else None

    def read_bound(self, requests: DataFrame) -> DataFrame:
        """requests (history_id, binding, off, n) with bytes_hex, or error NotFound, VersionExpired or OutOfRange."""
        return history.read_bound(self.versions(), self.leaves(), requests)

    def content(self, history_id: int, version: int) -> bytes:
        size = self.versions().filter((F.col("history_id") == history_id) & (F.col("seq") == version)).select("len").first()
        if size is None:
            raise KeyError(version)
        got = self.read(self.spark.createDataFrame([(history_id, version, 0, size["len"])], "history_id long, seq long, off long, n long")).first()
        if got["error"]:
            raise ValueError(got["error"])
        return bytes.fromhex(got["bytes_hex"])

    def verify(self) -> dict:
        """Retained versions, and how many whose pieces miss bytes or don't add up to their length."""
        v = self.versions().filter("retained")
        parts = v.select("history_id", "seq", F.explode("pieces").alias("p")).select("history_id", "seq", F.col("p.leaf").alias("leaf"), (F.col("p.off") + F.col("p.len")).alias("end"), F.col("p.len").alias("n"))
        sized = parts.join(self.leaves().select("history_id", "leaf", F.octet_length("payload").alias("size")), ["history_id", "leaf"], "left")
        sums = sized.groupBy("history_id", "seq").agg(F.sum("n").alias("n"), F.count_if(F.col("size").isNull() | (F.col("end") > F.col("size"))).alias("bad"))
        return v.join(sums, ["history_id", "seq"], "left").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("bad").isNull() | (F.col("bad") > 0) | (F.col("n") != F.col("len"))).alias("failures")).first().asDict()

    def stats(self) -> dict:
        """The generation, versions of its snapshot, and operations and inserted bytes since."""
        hot = self.log().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("insert")), F.lit(0)).alias("b")).first()
        return {"generation": self.generation(), "snapshot_versions": self.sealed().filter("op = 'version'").count(), "suffix_operations": hot["n"], "suffix_bytes": hot["b"]}
