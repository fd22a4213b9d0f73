"""The operation fold against plain bytes, and its contract case by case."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import canon
from palimpsest.model import OPERATION
from palimpsest.operators import history
from palimpsest.operators.history import Replay, _digest, of_pieces, pieces_of, shown, spliced


def op(seq, kind, **more):
    return dict.fromkeys(OPERATION.fieldNames()) | {"seq": seq, "op": kind, "history_id": 1} | more


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 9), st.binary(max_size=6)), max_size=30))
def test_trees_are_bytes(edits):
    leaves, tree, plain = {0: b"start"}, (5, 1, 0, 0), b"start"
    for i, (o, d, ins) in enumerate(edits, 1):
        o = min(o, len(plain))
        d = min(d, len(plain) - o)
        leaves[i] = ins
        tree = spliced(tree, o, d, i, len(ins))
        plain = plain[:o] + ins + plain[o + d :]
        pieces = pieces_of(tree)
        text = lambda p: b"".join(leaves[a][b : b + n] for a, b, n in p)
        assert text(pieces) == plain and all(n > 0 for _, _, n in pieces) and pieces_of(of_pieces(pieces)) == pieces
        assert text(pieces_of(tree, 2, 7)) == plain[2:7] and (tree[0] if tree else 0) == len(plain)
        assert shown([tree]).keys() == {a for a, _, _ in pieces}


def nodes_of(*trees):
    seen, stack = {}, [t for t in trees if t]
    while stack:
        t = stack.pop()
        if id(t) not in seen:
            seen[id(t)] = t
            stack += [t[2], t[3]] if t[1] > 1 else []
    return seen


def test_edits_share_nodes():
    """A splice into a version of many pieces makes few nodes, and trees stay shallow."""
    rng, tree, versions = random.Random(1), None, []
    for i in range(4000):
        size = tree[0] if tree else 0
        tree = spliced(tree, rng.randint(0, size) if i % 2 else size, 0, i, 5)
        versions.append(tree)
    depth = lambda t: 1 if t[1] == 1 else 1 + max(depth(t[2]), depth(t[3]))
    assert tree[1] > 4000 and depth(tree) < 40
    edited = spliced(tree, tree[0] // 2, 7, 9999, 5)
    assert len(nodes_of(edited).keys() - nodes_of(tree).keys()) < 100


def run(*ops):
    r = Replay(1)
    return r, [r.apply(o) for o in ops]


def test_contract():
    create, root = op(0, "create"), op(1, "splice", offset=0, delete_len=0, insert=b"abc", request_id=b"r")
    cases = [
        (op(2, "append", parent_seq=1, insert=b"d"), "Committed", None), (op(2, "append", parent_seq=1, insert=b""), "Rejected", "NoEffect"),
        (op(2, "splice", parent_seq=1, offset=4, delete_len=0, insert=b"x"), "Rejected", "OffsetBeyondEnd"), (op(2, "splice", parent_seq=1, offset=1, delete_len=3, insert=b"x"), "Rejected", "DeleteBeyondEnd"),
        (op(2, "splice", parent_seq=1, offset=0, delete_len=3), "Rejected", "EmptyResult"), (op(2, "splice", offset=1, delete_len=0, insert=b"x"), "Rejected", "OffsetBeyondEnd"),
        (op(2, "splice", offset=0, delete_len=0, insert=b""), "Rejected", "EmptyRoot"), (op(2, "fork", parent_seq=1), "Forked", None), (op(2, "fork", parent_seq=9), "Rejected", "UnknownParent"),
        (root | {"seq": 2}, "Replayed", None), (root | {"seq": 2, "insert": b"z"}, "Rejected", "RequestConflict"), (op(2, "expire", target_seq=1), "Expired", None),
        (op(2, "expire", target_seq=7), "Rejected", "UnknownVersion"), (op(2, "retire", target=b"r"), "RequestRetired", None), (op(2, "retire", target=b"q"), "Rejected", "UnknownRequest"), (op(2, "create"), "Existing", None),
        (op(2, "append", parent_seq=1, insert=b"d", binding=b""), "Rejected", "InvalidBinding"), (op(2, "zap"), "Rejected", "UnknownOperation"),
    ]
    for o, outcome, error in cases:
        _, got = run(create, root, o)
        assert (got[2]["outcome"], got[2].get("error")) == (outcome, error), o
    assert run(root)[1][0]["error"] == "UnknownHistory"


def test_ledger_comes_before_retention():
    create, root = op(0, "create"), op(1, "splice", insert=b"abc")
    child, again = op(2, "append", parent_seq=1, insert=b"d", request_id=b"r"), op(4, "append", parent_seq=1, insert=b"d", request_id=b"r")
    _, got = run(create, root, child, op(3, "expire", target_seq=1), again, op(5, "append", parent_seq=1, insert=b"e"), op(6, "expire", target_seq=1), op(7, "expire", target_seq=2), again | {"seq": 8})
    assert [g["outcome"] for g in got[3:]] == ["Expired", "Replayed", "Rejected", "AlreadyExpired", "Expired", "Retired"] and got[5]["error"] == "VersionExpired"


def test_horizon():
    r = Replay(1, horizon=3)
    r.apply(op(0, "create"))
    for i in range(1, 6):
        assert r.apply(op(i, "splice", insert=b"x%d" % i, request_id=b"%d" % i))["outcome"] == "Committed"
    assert sorted(r.active) == [b"3", b"4", b"5"]
    assert r.apply(op(9, "splice", insert=b"x1", request_id=b"1"))["outcome"] == "Committed"  # forgotten, so fresh again


def test_counters_saturate(spark):
    rows = spark.createDataFrame([(str((1 << 64) - 1),), ("5",)], "x string").select(F.col("x").cast("decimal(38,0)"))
    assert rows.agg(history.saturating(F.sum("x")).alias("s")).first()["s"] == (1 << 64) - 1


def test_append_is_splice_and_fork_is_parent():
    r, got = run(op(0, "create"), op(1, "splice", insert=b"abc"), op(2, "append", parent_seq=1, insert=b"d"), op(3, "splice", parent_seq=1, offset=3, delete_len=0, insert=b"d"), op(4, "fork", parent_seq=2))
    assert got[2]["digest"] == got[3]["digest"] and r.content(2) == r.content(3) == r.content(4) == b"abcd"


def random_log(seed, n=120, histories=4):
    """Operations of which most commit: parents are mostly versions that are retained."""
    rng, out = random.Random(seed), []
    for h in range(histories):
        state = Replay(h)
        out.append(op(h * 1000, "create", history_id=h))
        state.apply(out[-1])
        for i in range(1, n):
            made = [v for v in state.versions if v not in state.expired][-8:]
            parent = rng.choice(made) if made and rng.random() < 0.9 else None if rng.random() < 0.7 else h * 1000 + i - 1
            kind = rng.choice(["splice"] * 4 + ["append"] * 3 + ["fork", "expire", "retire"])
            more = {"parent_seq": parent, "offset": rng.randint(0, 4) if parent else 0, "delete_len": rng.randint(0, 2) if parent else 0, "insert": rng.choice([b"", b"ab", b"\xff\x00", b"long" * 3]),
                    "request_id": rng.choice([None, b"%d" % rng.randint(0, 9)]), "target": b"%d" % rng.randint(0, 9), "target_seq": parent if parent is not None else 7, "binding": rng.choice([None, None, b"b%d" % i])}
            out.append(op(h * 1000 + i, kind, history_id=h, **more))
            state.apply(out[-1])
        assert len(state.versions) > n // 6 and state.expired and state.fresh
    return out


def test_replay_by_partitions(spark):
    log = random_log(1)
    got = {r["seq"]: r for r in history.replay(spark.createDataFrame([tuple(o[f] for f in OPERATION.fieldNames()) for o in log], OPERATION)).collect()}
    for h in range(4):
        state = Replay(h)
        for o in (x for x in log if x["history_id"] == h):
            r, g = state.apply(o), got[o["seq"]]
            assert (g["outcome"], g["error"]) == (r["outcome"], r.get("error"))
            if r["outcome"] in ("Committed", "Forked"):
                assert g["len"] == len(state.content(o["seq"])) == sum(p["len"] for p in g["pieces"])


def test_output_grows_with_the_log(spark):
    """Twice the operations in one history: twice the rows and bytes of outcomes, twice the live leaves."""
    import pickle

    def rows(n):
        ops = [op(0, "create"), *(op(i, "splice", parent_seq=i - 1 if i > 1 else None, offset=0, delete_len=0, insert=b"x" * 8) for i in range(1, n))]
        log = frame(spark, ops)
        outcomes, live = history.replay(log, False, pieces=False).collect(), history.live_leaves(log).collect()
        assert len(outcomes) == n and len(live) == n - 1
        return len(pickle.dumps([tuple(r) for r in outcomes])) + len(pickle.dumps([tuple(r) for r in live]))

    assert rows(2000) < 2.2 * rows(1000)


def test_reads_of_a_log(spark):
    log = random_log(3, 60, 2)
    state = {h: Replay(h) for h in range(2)}
    for o in log:
        state[o["history_id"]].apply(o)
    asked = [(h, v, off, n) for h, s in state.items() for v in [*s.versions, 77_777] for off, n in ((0, 2), (1, 3), (0, 0), (-1, 2), (2, 10_000))]
    got = {tuple(r)[:4]: tuple(r)[4:] for r in history.read_log(history.as_steps(frame(spark, log)), spark.createDataFrame(asked, "history_id long, seq long, off long, n long")).collect()}
    for h, v, off, n in asked:
        s = state[h]
        error = "NotFound" if v not in s.versions else "VersionExpired" if v in s.expired else "OutOfRange" if off < 0 or off + n > len(s.content(v)) else None
        assert got[h, v, off, n] == ((None, error) if error else (s.content(v)[off : off + n].hex().upper(), None))


def test_digests_agree(spark):
    rows = [(1, 2, 3, 4, b"\xff\x00", b"b"), (200, None, 0, 0, b"", None), ((1 << 62), 255, 1 << 40, 9, b"x" * 300, b"\x80")]
    df = spark.createDataFrame(rows, "h long, p long, o long, d long, i binary, b binary")
    got = df.select(canon.splice_digest(*map(F.col, ["h", "p", "o", "d", "i", "b"])).alias("s"), canon.fork_digest(F.col("h"), F.coalesce("p", F.lit(0)).cast("long"), F.col("b")).alias("f")).collect()
    for r, (h, p, o, d, i, b) in zip(got, rows):
        assert r["s"] == _digest(b"splice\0", h, p, o, d, i, b) and r["f"] == _digest(b"fork\0", h, p or 0, binding=b)


def test_xxh3(spark):
    import xxhash

    got = spark.createDataFrame([(b"",), (b"abc",), (None,)], "b binary").select(canon.xxh3_64(F.col("b")).alias("x")).collect()
    assert [r["x"] for r in got] == [xxhash.xxh3_64_intdigest(b""), xxhash.xxh3_64_intdigest(b"abc"), None]


def test_ledger_faults(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "request_id string")
    active = spark.createDataFrame([("a", 1), ("b", 2)], "request_id string, version_seq long")
    versions = spark.createDataFrame([(1, True), (2, False)], "seq long, retained boolean")
    got = {tuple(r) for r in history.ledger_faults(active, ids("b", "c"), ids("a", "b", "b", "d"), versions).collect()}
    assert got == {("InBothLedgers", "b"), ("NotInOrder", "c"), ("NotInLedgers", "d"), ("Repeated", "b"), ("NotRetained", "b")}


def frame(spark, ops):
    return spark.createDataFrame([tuple(o[f] for f in OPERATION.fieldNames()) for o in ops], OPERATION)


def test_store_resumes_like_a_full_replay(spark, tmp_path):
    """Batches, a redelivered one and seals between them change no outcome; bytes that only expired versions show go."""
    from palimpsest.authority import HistoryStore

    log, store = random_log(2, 90, 3), HistoryStore(spark, f"file://{tmp_path}/h")
    want = {r["seq"]: r.asDict(True) for r in history.replay(frame(spark, log)).collect()}
    batches = [[o for o in log if lo <= o["seq"] % 1000 < hi] for lo, hi in ((0, 30), (30, 60), (60, 90))]
    got = {}
    for i, b in enumerate(batches):
        for r in store.apply(frame(spark, b)).collect():
            got[r["seq"]] = r.asDict(True)
        if i == 0:
            assert store.apply(frame(spark, b)).isEmpty()
        if i == 1:  # a batch that comes again finds its places taken, sealed or not
            assert store.seal() == 1 and store.stats()["suffix_operations"] == 0 and store.apply(frame(spark, b)).isEmpty()
    assert got == want
    tail = [op(80_000 + i, "splice", history_id=i, insert=b"kept") for i in range(3)]
    assert {r["outcome"] for r in store.apply(frame(spark, tail)).collect()} == {"Committed"}
    states = {h: Replay(h) for h in range(3)}
    for o in log + tail:
        states[o["history_id"]].apply(o)
    for sealed in (False, True):
        if sealed:
            gone = store.collect_garbage()
            assert gone["bytes_reclaimed"] > 0 and gone["bytes_after"] == sum(len(s.leaves[x]) for s in states.values() for x in {p[0] for v, d in s.versions.items() if v not in s.expired for p in pieces_of(d[0])})
        assert {(r["history_id"], r["seq"]): (r["len"], r["retained"]) for r in store.versions().collect()} == {(h, v): (d[1], v not in s.expired) for h, s in states.items() for v, d in s.versions.items()}
        assert store.verify()["failures"] == 0
        assert {(r["history_id"], bytes(r["request_id"]), r["state"]) for r in store.receipts().collect()} == {(h, q, "Active" if q in s.active else "Retired") for h, s in states.items() for q in s.fresh}
        h, v = next((h, v) for h, s in states.items() for v in s.versions if v not in s.expired)
        assert store.content(h, v) == states[h].content(v)


def test_images_move_between_stores(spark, tmp_path):
    from palimpsest.authority import HistoryStore

    log = random_log(5, 60, 2)
    one, two = (HistoryStore(spark, f"file://{tmp_path}/{n}") for n in ("one", "two"))
    one.apply(frame(spark, log))
    state = {h: Replay(h) for h in range(2)}
    for o in log:
        state[o["history_id"]].apply(o)
    kept = [(h, v) for h, s in state.items() for v in s.versions if v not in s.expired][::2]
    versions, leaves = one.export_image(spark.createDataFrame(kept, "history_id long, seq long"))
    assert two.import_image(versions, leaves) == len(kept) and two.verify() == {"checked": len(kept), "failures": 0}
    asked = spark.createDataFrame([(h, v, 0, len(state[h].content(v))) for h, v in kept], "history_id long, seq long, off long, n long")
    assert {(r["history_id"], r["seq"]): r["bytes_hex"] for r in two.read(asked).collect()} == {(h, v): state[h].content(v).hex().upper() for h, v in kept}
    h, v = kept[-1]
    more = two.apply(frame(spark, [op(90_000, "append", history_id=h, parent_seq=v, insert=b"more")])).first()
    assert more["outcome"] == "Committed" and two.content(h, 90_000) == state[h].content(v) + b"more"
    for broken in (lambda: two.import_image(versions, leaves), lambda: HistoryStore(spark, f"file://{tmp_path}/three").import_image(versions, leaves.limit(1))):
        try:
            broken()
            raise AssertionError("refused")
        except ValueError:
            pass


def test_store_by_single_operations(spark, tmp_path):
    from palimpsest.authority import HistoryStore

    store = HistoryStore(spark, f"file://{tmp_path}/one")
    h = store.create_history(b"thread")
    assert (h, store.create_history(b"thread"), store.create_history()) == (0, 0, 1)
    root = store.splice(h, None, 0, 0, b"hello", request_id=b"r")
    child = store.append(h, root["seq"], b" world", binding=b"v")
    twin = store.fork(h, child["seq"])
    assert store.content(h, twin["seq"]) == b"hello world" and twin["outcome"] == "Forked"
    assert store.expire(h, root["seq"])["outcome"] == "Expired"
    store.seal()
    assert store.splice(h, None, 0, 0, b"hello", request_id=b"r")["outcome"] == "Retired" and store.receipt_status(h, b"r") == "Retired"
    assert (store.version_of(h, b"v"), store.version_of(h, b"w"), store.binding_of(h, child["seq"]), store.binding_of(h, twin["seq"])) == (child["seq"], None, b"v", None)
    asked = store.spark.createDataFrame([(h, bytearray(b"v"), 6, 5), (h, bytearray(b"w"), 0, 1), (h, bytearray(b"v"), 9, 9)], "history_id long, binding binary, off long, n long")
    assert {(bytes(r["binding"]), r["off"]): (r["bytes_hex"], r["error"]) for r in store.read_bound(asked).collect()} == {(b"v", 6): (b"world".hex().upper(), None), (b"w", 0): (None, "NotFound"), (b"v", 9): (None, "OutOfRange")}
    assert store.receipt_count(h) == 1 and store.retired_requests(h) == [b"r"]
    assert store.append(h, root["seq"], b"!")["error"] == "VersionExpired" and store.create_history(b"thread") == 0
    assert store.append(h, child["seq"], b"!", binding=b"v")["error"] == "DuplicateBinding" and store.receipt_status(h, b"x") == "Unknown"
    try:
        store.content(h, root["seq"])
        raise AssertionError("expired")
    except ValueError as e:
        assert str(e) == "VersionExpired"
