"""Operation logs and message mirrors as streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.history import Replay, replay_rows
from ..shipping import on_workers

OUT = "history_id long, seq long, op string, outcome string, error string, version_seq long, parent_seq long, len long, sha256 string, digest string"
NAMES = [f.strip().split(" ")[0] for f in OUT.split(",")]
COLUMNS = ["seq", "op", "history_id", "parent_seq", "offset", "delete_len", "insert", "request_id", "binding", "target", "target_seq"]


def _ops(pdf: pd.DataFrame) -> Iterator[dict]:
    for row in pdf.to_dict("records"):
        op = {k: None if v is None or (isinstance(v, float) and v != v) or v is pd.NA else v for k, v in row.items()}
        for k in ("seq", "history_id", "parent_seq", "offset", "delete_len", "target_seq"):
            op[k] = None if op[k] is None else int(op[k])
        for k in ("insert", "request_id", "binding", "target"):
            op[k] = None if op[k] is None else bytes(op[k])
        yield op


def stream_replay(log: DataFrame) -> DataFrame:
    """Outcomes of a stream of operations, folded by history: the state of a history is its replay so far, so a query that
    restarts goes on from its last committed batch. Within a batch operations go by seq; those that were seen (a source that
    delivers twice) are skipped, and repeated requests answer as Replayed."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, own = pickle.loads(state.get[0]) if state.exists else (-1, Replay(int(key[0])))
        batch = pd.concat(list(frames)).sort_values("seq")
        ops = [op for op in _ops(batch[COLUMNS]) if op["seq"] > last]
        out = [{k: r[k] for k in NAMES} for r in replay_rows(own, iter(ops), pieces=False)]
        if ops:
            state.update((pickle.dumps((ops[-1]["seq"], own)),))
        yield pd.DataFrame(out, columns=NAMES).astype({k: "Int64" for k in ("history_id", "seq", "version_seq", "parent_seq", "len")})

    return on_workers(log).select(*COLUMNS).groupBy("history_id").applyInPandasWithState(fold, OUT, "state binary", "append", GroupStateTimeout.NoTimeout)


def suffixes(full: DataFrame, mirrored: DataFrame) -> DataFrame:
    """What a mirror must still get of each thread: (thread_id, messages) against (thread_id, n, sha256 of the first n).

    delta is the new suffix, null if there is none; error `NotAppendOnly` if the first n messages changed."""
    j = full.join(mirrored, "thread_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    head = F.slice(F.col("messages"), F.lit(1), F.col("n"))
    same = (F.col("n") == 0) | ((F.size("messages") >= F.col("n")) & (F.sha2(F.array_join(head, ","), 256) == F.col("sha256")))
    fresh = F.slice(F.col("messages"), F.col("n") + 1, F.size("messages"))
    return j.select("thread_id", F.when(same & (F.size("messages") > F.col("n")), fresh).alias("delta"), F.when(~same, "NotAppendOnly").alias("error"))


def mirror(stream: DataFrame, path: str, checkpoint: str, fail_open: bool = True):
    """A query that appends the suffixes of a stream of whole threads (thread_id, messages) to a mirror, and stops when all
    is read. Each batch is a folder of its own, overwritten if it is tried again, so redelivery changes nothing. Threads that
    changed before their end are recorded in path/_refused, or raise if fail_open is false."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
        begun = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(there)
        schema = "thread_id string, delta array<string>, batch int"
        latest = batch.groupBy("thread_id").agg(F.max_by("messages", F.size("messages")).alias("messages"))
        got = spark.read.schema(schema).parquet(path).filter(F.col("batch") < number) if begun else spark.createDataFrame([], schema)
        got = got.join(latest.select("thread_id"), "thread_id", "left_semi")  # what this batch doesn't name isn't hashed
        parts = got.groupBy("thread_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("batch", "delta"))), lambda x: x["delta"])).alias("m"))
        done = parts.select("thread_id", F.size("m").alias("n"), F.sha2(F.array_join("m", ","), 256).alias("sha256"))
        new = suffixes(latest, done)
        refused = new.filter("error is not null").select("thread_id", "error")
        if not refused.isEmpty():
            if not fail_open:
                raise ValueError("a mirrored thread changed before its end")
            refused.write.mode("overwrite").parquet(f"{path}/_refused/batch={number}")
        new.filter("delta is not null").select("thread_id", "delta").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
