"""Schemas of the tables that operators take and give."""

from pyspark.sql import types as T

L, S, B, X = T.LongType(), T.StringType(), T.BooleanType(), T.BinaryType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


#: One appended checkpoint: messages are canonical JSON strings.
CHECKPOINT = _schema(("thread_id", S, False), ("checkpoint_id", S, False), ("checkpoint_no", L, False), ("parent_checkpoint_id", S, True), ("messages", T.ArrayType(S, False), False))
#: One operation of a history. Versions are named by the seq of the operation that made them.
OPERATION = _schema(
    ("seq", L, False), ("op", S, False), ("history_id", L, False), ("parent_seq", L, True), ("offset", L, True), ("delete_len", L, True),
    ("insert", X, True), ("request_id", X, True), ("binding", X, True), ("target", X, True), ("target_seq", L, True))
PIECE = T.StructType([T.StructField("leaf", L), T.StructField("off", L), T.StructField("len", L)])
OUTCOME = _schema(
    ("history_id", L, False), ("seq", L, False), ("op", S, False), ("outcome", S, False), ("error", S, True), ("version_seq", L, True),
    ("parent_seq", L, True), ("len", L, True), ("sha256", S, True), ("digest", S, True), ("pieces", T.ArrayType(PIECE), True))
#: One step of a fold: phase 0 restores a snapshot (last, create, version, leaf, receipt), 1 are operations whose outcomes are
#: known, 2 new ones.
STEP = T.StructType([T.StructField("phase", T.IntegerType(), False), *OPERATION, T.StructField("digest", S), T.StructField("len", L), T.StructField("pieces", T.ArrayType(PIECE))])
TOMBSTONE = _schema(("thread_id", S, False), ("checkpoint_id", S, False))
#: Raw trajectories of two sources, as parsed from JSON.
SWE_MESSAGE = T.ArrayType(T.StructType([T.StructField(n, S) for n in ("role", "text", "system_prompt")]))
HANDS_MESSAGE = T.ArrayType(T.StructType([T.StructField(n, S) for n in ("role", "content", "tool_calls", "name", "tool_call_id")]))
EXPORT_FORMAT, EXPORT_VERSION = "checkpoint-export", 1
#: Receipts that a store remembers, and bounds of identifiers and list sizes.
RECEIPTS, MAX_BINDING, RECENT_DEFAULT, RECENT_MOST = 4096, 4096, 100, 1000
#: Error kinds, and the HTTP status an API answers a read or an append with.
READ_STATUS = {
    "NotFound": 404, "Deleted": 404, "TooLarge": 413, "Invalid": 400, "Conflict": 409, "RequestConflict": 409, "Precondition": 409, "OutOfRange": 416,
    "LockBusy": 503, "Capacity": 507, "Corruption": 500, "Internal": 500,
}
APPEND_STATUS = READ_STATUS | {"NotFound": 400}
