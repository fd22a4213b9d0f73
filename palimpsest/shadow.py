"""A saver of agent checkpoints that mirrors one append-only channel into a Store, beside the primary saver that holds.

Duck-typed: the primary has put, get_tuple and whatever else its callers use; all but put and aput goes straight to it.
What is mirrored is read back from the store, so a new saver goes on where the last one stopped. For whole streams of
threads, streaming.fold.mirror() does the same in batches.
"""

from __future__ import annotations

import asyncio
import json
import threading
import time

from .store import Store, StoreError

#: Latencies of so many callbacks at most are kept; older ones are written over in turn.
SAMPLE = 4096


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


class ShadowSaver:
    def __init__(self, primary, store: Store, channel: str = "messages", fail_open: bool = True, encode=canonical):
        self.primary, self.store, self.channel, self.fail_open, self.encode = primary, store, channel, fail_open, encode
        self.failures: list[dict] = []
        self._lock, self._calls, self._failed, self._sample = threading.Lock(), 0, 0, []
        self._total, self._least, self._most = 0, None, None

    def __getattr__(self, name: str):
        return getattr(self.primary, name)

    # Writes -----------------------------------------------------------------------------------------------------

    def put(self, config: dict, checkpoint: dict, *more):
        saved = self.primary.put(config, checkpoint, *more)
        self._timed(config, saved, checkpoint)
        return saved

    async def aput(self, config: dict, checkpoint: dict, *more):
        saved = await self.primary.aput(config, checkpoint, *more)
        await asyncio.to_thread(self._timed, config, saved, checkpoint)
        return saved

    def _timed(self, config: dict, saved: dict, checkpoint: dict) -> None:
        with self._lock:
            began, error = time.perf_counter_ns(), None
            try:
                self._mirror(config["configurable"], saved["configurable"]["checkpoint_id"], checkpoint["channel_values"])
            except Exception as e:  # the primary has the checkpoint already
                error = e
                self.failures.append({"checkpoint_id": str(checkpoint.get("id", "unknown")), "error": str(e)})
            self._observe(time.perf_counter_ns() - began, error is None)
        if error is not None and not self.fail_open:
            raise error

    def _mirror(self, at: dict, checkpoint_id: str, values: dict) -> None:
        if self.channel not in values:
            return
        thread = json.dumps([str(at["thread_id"]), str(at.get("checkpoint_ns", ""))], ensure_ascii=False, separators=(",", ":"))
        given = values[self.channel]
        now = [self.encode(m) for m in (given if isinstance(given, list) else [given])]
        if self._messages(thread, str(checkpoint_id)) == now:
            return
        parent = self._mirrored_parent(at, thread)
        before = self._messages(thread, parent) if parent else []
        if now[: len(before)] != before:
            raise StoreError("Invalid", f"{checkpoint_id} changes messages of {self.channel} that were mirrored before")
        if len(now) > len(before):
            self.store.put(thread, str(checkpoint_id), len(now), parent, now[len(before) :])

    def _messages(self, thread: str, checkpoint_id: str) -> list[str] | None:
        """The mirrored messages of a checkpoint, as they were put; None if it isn't mirrored."""
        return self.store.messages(thread, checkpoint_id) if self.store.status(thread, checkpoint_id) == "Found" else None

    def _mirrored_parent(self, at: dict, thread: str) -> str | None:
        """The nearest ancestor in the primary that is mirrored: those that brought nothing new are not."""
        up = at.get("checkpoint_id")
        while up is not None and self.store.status(thread, str(up)) != "Found":
            found = self.primary.get_tuple({"configurable": {**at, "checkpoint_id": up}})
            above = found.parent_config if found else None
            up = above["configurable"].get("checkpoint_id") if above else None
        return None if up is None else str(up)

    # Metrics and maintenance --------------------------------------------------------------------------------------

    def _observe(self, ns: int, good: bool) -> None:
        if len(self._sample) < SAMPLE:
            self._sample.append(ns)
        else:
            self._sample[self._calls % SAMPLE] = ns
        self._calls, self._failed, self._total = self._calls + 1, self._failed + (not good), self._total + ns
        self._least, self._most = min(ns, self._least or ns), max(ns, self._most or ns)

    def shadow_metrics(self) -> dict:
        with self._lock:
            kept = sorted(self._sample)
            rank = lambda f: kept[int((len(kept) - 1) * f)] if kept else None
            return {
                "fail_open": self.fail_open, "callbacks": self._calls, "successes": self._calls - self._failed, "failures": self._failed,
                "latency_ns": {"sample": len(kept), "sample_limit": SAMPLE, "total": self._total, "min": self._least, "p50": rank(0.5), "p95": rank(0.95), "max": self._most}}

    def verify_shadow(self) -> dict:
        return self.store.verify()

    def fsck_shadow(self) -> dict:
        return self.store.fsck()

    def shadow_stats(self) -> dict:
        return self.store.stats()

    def seal_shadow(self) -> int:
        return self.store.seal()
