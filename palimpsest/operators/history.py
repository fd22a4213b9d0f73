"""Versioned byte sequences: a fold of an operation log into versions, receipts and outcomes, and what hangs on it.

Histories are independent, so the log is dealt out by history and streamed in order through one Arrow pass: a version is a
balanced tree of pieces of leaves (leaf = seq of the operation that brought the bytes) that shares nodes with its parent, so
that edits and forks copy neither payload nor lists.
Only what an order-sensitive fold needs runs in Python; receipts, horizons, bindings, reachability and numbering are
DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from itertools import islice
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..model import MAX_BINDING, OPERATION, OUTCOME, RECEIPTS, STEP
from ..scratch import written
from ..shipping import on_workers

Pieces = list[tuple[int, int, int]]
#: A version's bytes as a tree of pieces that versions share: (bytes, pieces, left, right), or (bytes, 1, leaf, offset) for one
#: piece. Neighbours' weights differ by a factor of 4 at most, so that an edit makes O(log pieces) nodes.
Tree = tuple


def _pair(a: Tree, b: Tree) -> Tree:
    return a[0] + b[0], a[1] + b[1], a, b


def joined(a: Tree | None, b: Tree | None) -> Tree | None:
    """The bytes of a and then of b."""
    if a is None or b is None:
        return b if a is None else a
    if a[1] > 4 * b[1]:
        left, right = a[2], joined(a[3], b)
        if right[1] > 4 * left[1]:  # turned to the left
            return _pair(_pair(left, right[2]), right[3]) if right[2][1] <= 4 * left[1] else _pair(_pair(left, right[2][2]), _pair(right[2][3], right[3]))
        return _pair(left, right)
    if b[1] > 4 * a[1]:
        left, right = joined(a, b[2]), b[3]
        if left[1] > 4 * right[1]:
            return _pair(left[2], _pair(left[3], right)) if left[3][1] <= 4 * right[1] else _pair(_pair(left[2], left[3][2]), _pair(left[3][3], right))
        return _pair(left, right)
    return _pair(a, b)


def parted(t: Tree | None, at: int) -> tuple[Tree | None, Tree | None]:
    """The first `at` bytes, and the others."""
    if t is None or at <= 0:
        return None, t
    if at >= t[0]:
        return t, None
    if t[1] == 1:
        return (at, 1, t[2], t[3]), (t[0] - at, 1, t[2], t[3] + at)
    if at <= t[2][0]:
        a, b = parted(t[2], at)
        return a, joined(b, t[3])
    a, b = parted(t[3], at - t[2][0])
    return joined(t[2], a), b


def spliced(t: Tree | None, offset: int, delete: int, leaf: int, size: int) -> Tree | None:
    """t with [offset, offset + delete) replaced by the whole leaf of so many bytes."""
    left, rest = parted(t, offset)
    return joined(joined(left, (size, 1, leaf, 0) if size else None), parted(rest, delete)[1])


def pieces_of(t: Tree | None, begin: int = 0, end: int | None = None) -> Pieces:
    """(leaf, offset, length) of the bytes in [begin, end); subtrees outside aren't visited."""
    out: Pieces = []
    stack = [(t, 0)] if t else []
    while stack:
        node, at = stack.pop()
        if at + node[0] <= begin or end is not None and at >= end:
            continue
        if node[1] == 1:
            lo, hi = max(begin - at, 0), node[0] if end is None else min(node[0], end - at)
            out.append((node[2], node[3] + lo, hi - lo))
        else:
            stack += [(node[3], at + node[2][0]), (node[2], at)]
    return out


def of_pieces(pieces: Pieces) -> Tree | None:
    if len(pieces) <= 1:
        return (pieces[0][2], 1, pieces[0][0], pieces[0][1]) if pieces else None
    mid = len(pieces) // 2
    return joined(of_pieces(pieces[:mid]), of_pieces(pieces[mid:]))


def shown(trees: Iterable[Tree]) -> dict[int, tuple[int, int]]:
    """By leaf: the first byte and the end of what the trees show of it. A node that trees share is visited once."""
    seen: set[int] = set()
    out: dict[int, tuple[int, int]] = {}
    stack = [t for t in trees if t]
    while stack:
        node = stack.pop()
        if id(node) in seen:
            continue
        seen.add(id(node))
        if node[1] == 1:
            lo, hi = out.get(node[2], (node[3], node[3]))
            out[node[2]] = min(lo, node[3]), max(hi, node[3] + node[0])
        else:
            stack += [node[2], node[3]]
    return out


class Replay:
    """One history's versions and request ledger; checks come in a fixed order: coordinates, ledger, retention."""

    def __init__(self, history: int, horizon: int = RECEIPTS):
        self.history, self.horizon = history, horizon
        self.versions: dict[int, tuple[Tree | None, int, int | None]] = {}
        self.leaves: dict[int, bytes] = {}
        self.expired: set[int] = set()
        self.bindings: dict[bytes, int] = {}
        self.active: dict[bytes, tuple[str, int]] = {}
        self.retired: dict[bytes, str] = {}
        self.fresh: list[bytes] = []
        self.created = False
        self.last = -1

    def content(self, version: int) -> bytes:
        return b"".join(self.leaves[leaf][off : off + n] for leaf, off, n in pieces_of(self.versions[version][0]))

    def live(self) -> dict[int, tuple[int, int]]:
        """Leaves that retained versions show, and the extent of each."""
        return shown(t for v, (t, _, _) in self.versions.items() if v not in self.expired)

    def read(self, ask: dict) -> dict:
        """Bytes [offset, offset + delete_len) of the version target_seq, or why there are none."""
        version, off, n = ask["target_seq"], ask["offset"], ask["delete_len"]
        found = self.versions.get(version)
        error = "NotFound" if not found else "VersionExpired" if version in self.expired else "OutOfRange" if off < 0 or n < 0 or off + n > found[1] else None
        got = None if error else b"".join(self.leaves[leaf][a : a + m] for leaf, a, m in pieces_of(found[0], off, off + n))
        return {"history_id": self.history, "seq": version, "off": off, "n": n, "bytes_hex": None if got is None else got.hex().upper(), "error": error}

    def snapshot(self) -> Iterator[dict]:
        """Steps that restore this state: an expired version keeps its place but no pieces, and leaves that no retained
        version shows are dropped."""
        step = lambda kind, seq, **more: dict.fromkeys(STEP.fieldNames()) | {"phase": 0, "history_id": self.history, "op": kind, "seq": seq} | more
        yield step("last", self.last)
        if self.created:
            yield step("create", 0)
        of = {v: b for b, v in self.bindings.items()}
        for seq, (tree, size, parent) in self.versions.items():
            gone = seq in self.expired
            yield step("version", seq, parent_seq=parent, len=size, binding=of.get(seq), pieces=None if gone else [{"leaf": a, "off": b, "len": n} for a, b, n in pieces_of(tree)])
        for leaf in sorted(self.live()):
            yield step("leaf", leaf, insert=self.leaves[leaf])
        for place, request in enumerate(self.fresh):
            digest, version = self.active.get(request) or (self.retired[request], None)
            yield step("receipt", place, request_id=request, digest=digest, target_seq=version)

    def restore(self, step: dict) -> None:
        """Takes one step of a snapshot; receipts must come in their order."""
        kind, seq = step["op"], step["seq"]
        if kind == "last":
            self.last = seq
        elif kind == "create":
            self.created = True
        elif kind == "version":
            pieces = step["pieces"]
            if pieces is None:
                self.expired.add(seq)
            self.versions[seq] = of_pieces([(p["leaf"], p["off"], p["len"]) for p in pieces or ()]), step["len"], step["parent_seq"]
            if step["binding"] is not None:
                self.bindings[step["binding"]] = seq
        elif kind == "leaf":
            self.leaves[seq] = step["insert"]
        elif kind == "receipt":
            self.fresh.append(step["request_id"])
            if step["target_seq"] is None:
                self.retired[step["request_id"]] = step["digest"]
            else:
                self.active[step["request_id"]] = step["digest"], step["target_seq"]

    def apply(self, op: dict) -> dict:
        self.last = op["seq"]
        try:
            return self._apply(op)
        except _Refused as e:
            return {"outcome": "Rejected", "error": str(e)}

    def _apply(self, op: dict) -> dict:
        kind = op["op"]
        if kind == "create":
            known, self.created = self.created, True
            return {"outcome": "Existing" if known else "Created"}
        if kind == "expire":
            target = op["target_seq"]
            if target not in self.versions:
                raise _Refused("UnknownVersion")
            if target in self.expired:
                return {"outcome": "AlreadyExpired", "version_seq": target}
            self.expired.add(target)
            for request, (digest, version) in list(self.active.items()):
                if version == target:  # its place in the order stays
                    del self.active[request]
                    self.retired[request] = digest
            return {"outcome": "Expired", "version_seq": target}
        if kind == "retire":
            if op["target"] not in self.active:
                raise _Refused("UnknownRequest")
            self.retired[op["target"]] = self.active.pop(op["target"])[0]
            return {"outcome": "RequestRetired"}
        if kind not in ("splice", "append", "fork"):
            raise _Refused("UnknownOperation")
        parent, insert, binding = op["parent_seq"], op["insert"] or b"", op["binding"]
        if not self.created:
            raise _Refused("UnknownHistory")
        if binding is not None and not 0 < len(binding) <= MAX_BINDING:
            raise _Refused("InvalidBinding")
        if parent is not None and parent not in self.versions:
            raise _Refused("UnknownParent")
        length = self.versions[parent][1] if parent is not None else 0
        if kind == "fork":
            if parent is None:
                raise _Refused("UnknownParent")
            digest = _digest(b"fork\0", self.history, parent, binding=binding)
            offset = delete = 0
            insert = b""
        else:
            offset, delete = (length, 0) if kind == "append" else (op["offset"] or 0, op["delete_len"] or 0)
            if offset < 0 or offset > length:
                raise _Refused("OffsetBeyondEnd")
            if delete < 0 or delete > length - offset:
                raise _Refused("DeleteBeyondEnd")
            if parent is None and (offset or delete):
                raise _Refused("RootNeedsZeroOffset")
            if not delete and not insert:
                raise _Refused("EmptyRoot" if parent is None else "NoEffect")
            if length - delete + len(insert) == 0:
                raise _Refused("EmptyResult")
            digest = _digest(b"splice\0", self.history, parent, offset, delete, insert, binding)
        request = op["request_id"]
        if request is not None:
            if request in self.active:
                if self.active[request][0] != digest:
                    raise _Refused("RequestConflict")
                return {"outcome": "Replayed", "version_seq": self.active[request][1], "digest": digest}
            if request in self.retired:
                if self.retired[request] != digest:
                    raise _Refused("RequestConflict")
                return {"outcome": "Retired", "digest": digest}
        if parent is not None and parent in self.expired:
            raise _Refused("VersionExpired")
        if binding is not None:
            if binding in self.bindings:
                raise _Refused("DuplicateBinding")
            self.bindings[binding] = op["seq"]
        seq = op["seq"]
        if kind == "fork":
            tree = self.versions[parent][0]
        else:
            if insert:
                self.leaves[seq] = insert
            tree = spliced(self.versions[parent][0] if parent is not None else None, offset, delete, seq, len(insert))
        self.versions[seq] = tree, tree[0] if tree else 0, parent
        if request is not None:
            self.active[request] = digest, seq
            self.fresh.append(request)
            while len(self.fresh) > self.horizon:
                old = self.fresh.pop(0)
                self.active.pop(old, None)
                self.retired.pop(old, None)
        return {"outcome": "Forked" if kind == "fork" else "Committed", "version_seq": seq, "digest": digest}


class _Refused(Exception):
    pass


def _digest(domain: bytes, history: int, parent: int | None, offset=None, delete=None, insert=None, binding=None) -> str:
    u = lambda x: x.to_bytes(8, "little")
    out = domain + u(history)
    if insert is not None:
        out += (b"\1" + u(parent) if parent is not None else b"\0" + u(0)) + u(offset) + u(delete) + u(len(insert)) + insert
    else:
        out += u(parent)
    return hashlib.sha256(out + (b"\1" + u(len(binding)) + binding if binding is not None else b"\0")).hexdigest()


def replay_rows(state: Replay, rows: Iterator[dict], digests: bool = True, pieces: bool = True) -> Iterator[dict]:
    for op in rows:
        r = state.apply(op)
        made = r["outcome"] in ("Committed", "Forked")
        tree, size, parent = state.versions[op["seq"]] if made else (None, None, None)
        yield {
            "history_id": op["history_id"], "seq": op["seq"], "op": op["op"], "outcome": r["outcome"], "error": r.get("error"),
            "version_seq": r.get("version_seq"), "parent_seq": parent, "len": size,
            "sha256": hashlib.sha256(state.content(op["seq"])).hexdigest() if made and digests else None, "digest": r.get("digest"),
            "pieces": [{"leaf": a, "off": b, "len": n} for a, b, n in pieces_of(tree)] if made and pieces else None}


def _arrow(schema) -> pa.Schema:
    pieces = pa.list_(pa.struct([("leaf", pa.int64()), ("off", pa.int64()), ("len", pa.int64())]))
    simple = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.name, simple.get(f.dataType.simpleString(), pieces)) for f in schema])


def as_steps(log: DataFrame, phase: int = 1) -> DataFrame:
    """Operations as steps that come behind a snapshot's."""
    return log.select(*[F.col(n) if n in OPERATION.fieldNames() else F.lit(phase if n == "phase" else None).cast(f.dataType).alias(n) for n, f in ((f.name, f) for f in STEP)])


LIVE = StructType([StructField(n, LongType()) for n in ("history_id", "leaf", "lo", "hi")])
READ = StructType([*[StructField(n, LongType()) for n in ("history_id", "seq", "off", "n")], StructField("bytes_hex", StringType()), StructField("error", StringType())])
#: Rows that a task gives out at once.
ROWS_AT_ONCE = 4096


def _fold(steps: DataFrame, out: str, horizon: int = RECEIPTS, digests: bool = False, pieces: bool = False) -> DataFrame:
    """Folds steps by history, in order of phase and seq. What comes out: `outcomes` of phase 2, the `snapshot` at each
    history's end, the `live` leaves then, or what reads (phase 3) find."""
    schema = {"snapshot": STEP, "outcomes": OUTCOME, "live": LIVE, "reads": READ}[out]
    arrow = _arrow(schema)

    def ending(state: Replay) -> Iterator[dict]:
        if out == "snapshot":
            yield from state.snapshot()
        elif out == "live":
            for leaf, (lo, hi) in state.live().items():
                yield {"history_id": state.history, "leaf": leaf, "lo": lo, "hi": hi}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        state: Replay | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                for step in batch.slice(at, ROWS_AT_ONCE).to_pylist():
                    if state is None or state.history != step["history_id"]:
                        if state is not None:
                            yield from ending(state)
                        state = Replay(step["history_id"], horizon)
                    if step["phase"] == 0:
                        state.restore(step)
                    elif step["phase"] == 3:
                        yield state.read(step)
                    elif step["phase"] == 1 or out != "outcomes":
                        state.apply(step)
                    else:
                        yield from replay_rows(state, iter([step]), digests, pieces)
        if state is not None:
            yield from ending(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while part := list(islice(found, ROWS_AT_ONCE)):
            yield pa.RecordBatch.from_pylist(part, schema=arrow)

    # A window's needs bind every later change of the plan. A repartition() is dropped where the parts of a union seem to be
    # dealt out by history already, and these may then be dealt out anew, each its own way.
    place = F.row_number().over(W.partitionBy("history_id").orderBy("phase", "seq"))
    return on_workers(steps).withColumn("place_", place).mapInArrow(run, schema)


def replay(log: DataFrame, digests: bool = True, horizon: int = RECEIPTS, pieces: bool = True) -> DataFrame:
    """The outcome of every operation (OUTCOME), by history in order of seq.

    A task streams its histories in sorted order and keeps one history's versions at a time, as trees that share nodes: an
    edit costs O(log pieces). digests (of whole contents) and pieces (whole lists) are the parts of an outcome that grow with
    its version; without them the result grows with the log alone."""
    return _fold(as_steps(log, 2), "outcomes", horizon, digests, pieces)


def live_leaves(log: DataFrame) -> DataFrame:
    """(history_id, leaf, lo, hi): leaves that a log's retained versions show, and the extent of each that is used. Nodes that
    versions share are visited once, and no list of pieces leaves the fold."""
    return _fold(as_steps(log), "live")


def read_log(steps: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (history_id, seq, off, n) with bytes_hex, or error NotFound, VersionExpired or OutOfRange, of what steps (a
    snapshot's, operations) lead to. A read visits the pieces in its range alone."""
    asked = requests.select(*[{
        "phase": F.lit(3), "history_id": F.col("history_id"), "seq": F.col("seq"), "target_seq": F.col("seq"), "offset": F.col("off"), "delete_len": F.col("n"), "op": F.lit("read")
    }.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in STEP])
    return _fold(steps.unionByName(asked), "reads")


def resume(steps: DataFrame, log: DataFrame, digests: bool = True) -> DataFrame:
    """The outcomes of log's operations behind steps (a snapshot's, and operations since): what a replay of all would give."""
    return _fold(steps.unionByName(as_steps(log, 2)), "outcomes", digests=digests, pieces=True)


def snapshot(steps: DataFrame, horizon: int = RECEIPTS) -> DataFrame:
    """Steps that restore what steps lead to, without the bytes that only expired versions show."""
    return _fold(steps, "snapshot", horizon)


def receipts(steps: DataFrame, horizon: int = RECEIPTS) -> DataFrame:
    """(history_id, request_id, state): the receipts that a history still knows, Active or Retired."""
    return snapshot(steps, horizon).filter("op = 'receipt'").select("history_id", "request_id", F.when(F.col("target_seq").isNull(), "Retired").otherwise("Active").alias("state"))


def dense_ids(df: DataFrame, seq: str, out: str, then: tuple[str, ...] = ()) -> DataFrame:
    """df with a dense id from 0 in order of seq, then of the columns `then`: rows are dealt out by sampled ranges of these,
    sorted within a range, and numbered there; a range's numbers are shifted by the counts of those before it. No task sorts
    everything, however seqs lie, and one count a range reaches the driver."""
    ranged = df.repartitionByRange(seq, *then).sortWithinPartitions(seq, *then).withColumn("i_", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("range_", F.shiftright("i_", 33)).withColumn("i_", F.col("i_").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))))
    at, offsets = 0, []
    for r in sorted(ranged.groupBy("range_").count().collect()):
        offsets.append((r["range_"], at))
        at += r["count"]
    shift = F.broadcast(df.sparkSession.createDataFrame(offsets, "range_ long, shift_ long"))
    return ranged.join(shift, "range_").withColumn(out, F.col("shift_") + F.col("i_")).drop("range_", "i_", "shift_")


def classify_requests(requests: DataFrame, key: str = "request_id", seq: str = "seq", digest: str = "digest") -> DataFrame:
    """requests with outcome Fresh, Replayed or Conflict: the first digest of an id is its own."""
    w = W.partitionBy(key).orderBy(seq)
    first = F.first(digest).over(w)
    return requests.withColumn("outcome", F.when(F.row_number().over(w) == 1, "Fresh").when(F.col(digest) == first, "Replayed").otherwise("Conflict"))


def receipt_horizon(fresh: DataFrame, seq: str = "seq", capacity: int = RECEIPTS) -> DataFrame:
    """The newest receipts that a store still knows: a top-k by seq."""
    return fresh.orderBy(F.desc(seq)).limit(capacity)


def bound_histories(requests: DataFrame, binding: str = "binding", seq: str = "seq") -> DataFrame:
    """(binding, first_seq, requests, history_id): one history per binding, numbered by first sight."""
    firsts = requests.groupBy(binding).agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("requests"))
    return dense_ids(firsts, "first_seq", "history_id")


def expire_outcomes(expires: DataFrame, versions: DataFrame) -> DataFrame:
    """expires (history_id, seq, target_seq) with outcome Expired, AlreadyExpired or UnknownVersion; versions: (history_id,
    version_seq)."""
    known = versions.select("history_id", F.col("version_seq").alias("target_seq"), F.lit(True).alias("known"))
    nth = F.row_number().over(W.partitionBy("history_id", "target_seq").orderBy("seq"))
    return expires.join(known, ["history_id", "target_seq"], "left").withColumn("nth", nth).withColumn("outcome", F.when(F.col("known").isNull(), "UnknownVersion").when(F.col("nth") == 1, "Expired").otherwise("AlreadyExpired")).drop("nth", "known")


def with_lifecycle(outcomes: DataFrame) -> DataFrame:
    """Versions (version_seq = seq) with retained: not expired later."""
    made = outcomes.filter(F.col("outcome").isin("Committed", "Forked"))
    gone = outcomes.filter("outcome = 'Expired'").select("history_id", F.col("version_seq").alias("seq"), F.lit(False).alias("retained"))
    return made.join(gone, ["history_id", "seq"], "left").withColumn("retained", F.coalesce("retained", F.lit(True)))


def reachable(versions: DataFrame) -> DataFrame:
    """(history_id, leaf, used): leaves that retained versions show, and the extent of each that is used."""
    return versions.filter("retained").select("history_id", F.explode("pieces").alias("p")).groupBy("history_id", F.col("p.leaf").alias("leaf")).agg(F.min("p.off").alias("lo"), F.max(F.col("p.off") + F.col("p.len")).alias("hi"))


def work(outcomes: DataFrame, log: DataFrame) -> DataFrame:
    """By history: operations seen, versions and leaves allocated, payload bytes written and logical bytes made. Sums saturate
    at the largest unsigned 64-bit number instead of overflowing."""
    sizes = log.select("history_id", "seq", F.coalesce(F.octet_length("insert"), F.lit(0)).cast("long").alias("bytes_"))
    done = F.col("outcome").isin("Committed", "Forked")
    wrote = F.when(F.col("outcome") == "Committed", F.col("bytes_")).otherwise(0)
    return outcomes.join(sizes, ["history_id", "seq"]).groupBy("history_id").agg(
        F.count(F.lit(1)).alias("operations"), F.count_if(done).alias("versions_allocated"), F.count_if(wrote > 0).alias("leaves_allocated"),
        saturating(F.sum(wrote.cast("decimal(38,0)"))).alias("payload_bytes_written"), saturating(F.sum(F.when(done, F.col("len")).otherwise(0).cast("decimal(38,0)"))).alias("logical_bytes"))


def saturating(total: Column) -> Column:
    """A sum as an unsigned 64-bit counter would hold it: at most 2^64 - 1."""
    return F.least(total, F.lit(str((1 << 64) - 1)).cast("decimal(38,0)")).cast("decimal(20,0)")


def read_bound(versions: DataFrame, leaves: DataFrame, requests: DataFrame) -> DataFrame:
    """read() by version bindings: versions has a column binding (unique in a history), requests (history_id, binding, off, n).
    A binding that no version has is NotFound."""
    known = versions.filter("binding is not null").select("history_id", "binding", "seq")
    asked = requests.join(known, ["history_id", "binding"], "left")
    got = read(versions, leaves, asked.filter("seq is not null").select("history_id", "seq", "off", "n").distinct())
    out = asked.join(got, ["history_id", "seq", "off", "n"], "left")
    return out.select("history_id", "binding", "off", "n", "bytes_hex", F.when(F.col("seq").isNull(), "NotFound").otherwise(F.col("error")).alias("error"))


def route_index(keys: DataFrame, key: str = "key") -> DataFrame:
    """keys (distinct) with pos: their place in the order of (hash, key), in which an index looks them up. The hash is the
    SHA-256 of the key (hex)."""
    return dense_ids(keys.withColumn("hash", F.sha2(F.encode(F.col(key).cast("string"), "UTF-8"), 256)), "hash", "pos", then=(key,))


def collect_garbage(live: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row per history: leaves and bytes before, after and reclaimed. live: live_leaves() or reachable(); leaves:
    (history_id, leaf, size)."""
    live = leaves.join(live.select("history_id", "leaf", "lo"), ["history_id", "leaf"], "left").withColumn("live", F.col("lo").isNotNull())
    return live.groupBy("history_id").agg(
        F.count(F.lit(1)).alias("leaves_before"), F.count_if("live").alias("leaves_after"), F.count_if(~F.col("live")).alias("leaves_reclaimed"),
        F.sum("size").alias("bytes_before"), F.coalesce(F.sum(F.when(F.col("live"), F.col("size"))), F.lit(0)).alias("bytes_after"))


def repack(leaves: DataFrame, keep: DataFrame) -> DataFrame:
    """Surviving leaves with dense new ids and offsets in each history, in order of the old ids."""
    w = W.partitionBy("history_id").orderBy("leaf")
    left = leaves.join(keep.select("history_id", "leaf"), ["history_id", "leaf"], "left_semi")
    return left.withColumn("new_leaf", (F.row_number().over(w) - 1).cast("long")).withColumn("new_offset", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))


def read(versions: DataFrame, leaves: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (history_id, seq, off, n) with bytes (hex), or error NotFound, VersionExpired or OutOfRange.

    leaves: (history_id, leaf, payload). Where pieces begin is a running sum over rows; those outside a range are dropped
    before payloads are joined."""
    v = versions.select("history_id", "seq", "len", "retained", "pieces")
    q = requests.join(v, ["history_id", "seq"], "left")
    error = F.when(F.col("len").isNull(), "NotFound").when(~F.col("retained"), "VersionExpired").when((F.col("off") < 0) | (F.col("n") < 0) | (F.col("off") + F.col("n") > F.col("len")), "OutOfRange")
    asked = q.withColumn("error", error).filter("error is null").select("history_id", "seq", "off", "n", F.posexplode("pieces").alias("i", "p"))
    so_far = W.partitionBy("history_id", "seq", "off", "n").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    asked = asked.withColumn("st", F.sum("p.len").over(so_far) - F.col("p.len"))
    hit = asked.withColumn("p", F.struct("i", F.col("p.leaf").alias("leaf"), F.col("p.off").alias("off"), F.col("p.len").alias("len"), "st")).drop("i", "st")
    hit = hit.filter((F.col("p.st") < F.col("off") + F.col("n")) & (F.col("p.st") + F.col("p.len") > F.col("off"))).withColumn("leaf", F.col("p.leaf"))
    begin = F.greatest(F.col("off") - F.col("p.st"), F.lit(0).cast("long"))
    size = F.least(F.col("off") + F.col("n") - F.col("p.st"), F.col("p.len")) - begin
    part = F.hex(F.substring(F.col("payload"), (F.col("p.off") + begin + 1).cast("int"), size.cast("int")))
    got = hit.join(leaves, ["history_id", "leaf"]).groupBy("history_id", "seq", "off", "n").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("p.i").alias("i"), part.alias("h")))), lambda x: x["h"]), "").alias("h"))
    out = q.withColumn("error", error).join(got, ["history_id", "seq", "off", "n"], "left")
    return out.select("history_id", "seq", "off", "n", F.when(F.col("error").isNull(), F.coalesce("h", F.lit(""))).alias("bytes_hex"), "error")


def receipt_status(receipts: DataFrame, asked: DataFrame, key: str = "request_id") -> DataFrame:
    return asked.join(receipts.select(key, "state"), key, "left").withColumn("state", F.coalesce("state", F.lit("Unknown")))


def ledger_faults(active: DataFrame, retired: DataFrame, order: DataFrame, versions: DataFrame) -> DataFrame:
    """(fault, request_id): ids in both ledgers, out of the order, repeated in it, or active on versions not retained."""
    both = active.select("request_id").intersect(retired.select("request_id")).select(F.lit("InBothLedgers").alias("fault"), "request_id")
    every = active.select("request_id").unionByName(retired.select("request_id")).distinct()
    missing = every.join(order, "request_id", "left_anti").select(F.lit("NotInOrder").alias("fault"), "request_id")
    surplus = order.join(every, "request_id", "left_anti").select(F.lit("NotInLedgers").alias("fault"), "request_id")
    twice = order.groupBy("request_id").count().filter("count > 1").select(F.lit("Repeated").alias("fault"), "request_id")
    dead = active.join(versions.filter("retained").select(F.col("seq").alias("version_seq")), "version_seq", "left_anti").select(F.lit("NotRetained").alias("fault"), "request_id")
    return both.unionByName(missing).unionByName(surplus).unionByName(twice).unionByName(dead)
