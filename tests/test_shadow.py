"""The mirroring saver beside a primary that lives in memory."""

import asyncio
from types import SimpleNamespace

import pytest

from palimpsest.shadow import ShadowSaver
from palimpsest.store import Store, StoreError


class Primary:
    def __init__(self):
        self.saved = {}

    def put(self, config, checkpoint, *more):
        at = config["configurable"]
        self.saved[at["thread_id"], checkpoint["id"]] = checkpoint, config if at.get("checkpoint_id") else None
        return {"configurable": {**at, "checkpoint_id": checkpoint["id"]}}

    async def aput(self, *given):
        return self.put(*given)

    def get_tuple(self, config):
        at = config["configurable"]
        found = self.saved.get((at["thread_id"], at["checkpoint_id"]))
        return SimpleNamespace(checkpoint=found[0], parent_config=found[1]) if found else None

    def delete_thread(self, thread):
        return f"gone {thread}"


def at(parent=None):
    return {"configurable": {"thread_id": "t", "checkpoint_ns": "n"} | ({"checkpoint_id": parent} if parent else {})}


def checkpoint(name, *messages, channel="messages"):
    return {"id": name, "channel_values": {channel: list(messages)}}


def test_shadow(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    saver, key = ShadowSaver(Primary(), store), '["t","n"]'
    saver.put(at(), checkpoint("a", {"z": 1, "a": "é"}))
    saver.put(at("a"), checkpoint("b", {"z": 1, "a": "é"}))  # nothing new
    saver.put(at("b"), checkpoint("c", "x", channel="other"))  # without the channel
    asyncio.run(saver.aput(at("c"), checkpoint("d", {"z": 1, "a": "é"}, "two")))
    saver.put(at("c"), checkpoint("d", {"z": 1, "a": "é"}, "two"))  # again
    assert store.messages(key, "d") == ['{"a":"é","z":1}', '"two"'] and store.rows().count() == 2
    assert store.rows().filter("checkpoint_id = 'd'").first()["parent_checkpoint_id"] == "a"
    saver.put(at("d"), checkpoint("e", "changed"))  # the primary has it, the mirror tells
    got = saver.shadow_metrics()
    assert (got["callbacks"], got["failures"], got["latency_ns"]["sample"]) == (6, 1, 6) and saver.failures[0]["checkpoint_id"] == "e"
    assert saver.get_tuple(at("e")).checkpoint["id"] == "e" and saver.delete_thread("t") == "gone t"
    again = ShadowSaver(saver.primary, store, fail_open=False)  # goes on from the store
    again.put(at("d"), checkpoint("f", {"z": 1, "a": "é"}, "two", "three"))
    with pytest.raises(StoreError):
        again.put(at("f"), checkpoint("g"))
    assert again.verify_shadow()["failures"] == 0 and again.seal_shadow() == 1 and again.shadow_stats()["sealed_checkpoints"] == 3
    assert again.fsck_shadow()["missing_parents"] == 0
