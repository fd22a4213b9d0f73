"""Language identification by prediction by partial matching (PPM).

Per language, a tree of byte contexts of 0 to ORDER bytes is learned: in a context with n observations of d distinct
bytes, a seen byte costs -log2(count / (n + d)) bits, and an unseen one costs the escape -log2(d / (n + d)) plus its
cost in the context one byte shorter; below order 0 stands the uniform distribution over 256 bytes. Contexts that a
language has never seen cost nothing to leave. The statistics are frozen after learning, so the exact code length of a
text is a sum of table entries; the language with the shortest code wins.

The tables are plain arrays: for each context-plus-byte seen in any of up to BLOCK languages the finished cost in each of
these, and for each context its escape cost. Every language that has a label is learned, and every byte string of the
documents learned from counts. Their number is bounded by parameters (rows a language, rows in all), and so the model's
size, whatever the table's: it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..shipping import on_workers
from .common import release, staged

ORDER = 3
#: The classifier learns from about so many whole documents a language, and so many in all (chosen by a hash of doc_id).
DOCS_A_LANGUAGE, DOCS_IN_ALL = 1500, 60_000
#: Languages whose costs stand side by side in one table.
BLOCK = 16
#: Bytes scored at once.
CHUNK = 1 << 18
ROWS_AT_ONCE = 256
PAD = b"\0" * ORDER


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: crc32 of the doc_id as text is divisible by 5 (a null one counts as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def training_sample(docs: DataFrame, per_language: int = DOCS_A_LANGUAGE, in_all: int = DOCS_IN_ALL) -> DataFrame:
    """(lang, text): a bounded sample of labelled documents that aren't held out, by a hash of doc_id: about per_language of
    each language, or in_all dealt out evenly if these are fewer."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("of"))
    counts = counts.withColumn("share", F.least(F.lit(per_language), F.lit(in_all) / F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))))  # one row a language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.join(F.broadcast(counts), "lang").filter(draw < F.col("share") / F.col("of")).select("lang", "text")


def _keys(data: np.ndarray, order: int, start: int = ORDER) -> np.ndarray:
    """For each byte from start on: it and the order bytes before it as one number, older bytes higher."""
    key = data[start:].astype(np.uint32)
    for back in range(1, order + 1):
        key |= data[start - back : len(data) - back].astype(np.uint32) << np.uint32(8 * back)
    return key


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS_AT_ONCE rows, so that what a task holds of them doesn't follow Arrow's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, ord, key, n) of all byte strings of 1 to ORDER + 1 bytes, counted by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by_lang.setdefault(lang, []).append(text.as_py().encode())
            for lang, texts in by_lang.items():
                data = np.frombuffer(PAD + PAD.join(texts), np.uint8)
                own = np.ones(len(data), bool)  # the padding between texts is context, but isn't counted itself
                at = 0
                for t in texts:
                    own[at : at + ORDER] = False
                    at += ORDER + len(t)
                for order in range(ORDER + 1):
                    keys, n = np.unique(_keys(data, order)[own[ORDER:]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array([order] * len(keys), pa.int32()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "ord", "key", "n"])

    parts = on_workers(sample).mapInArrow(run, "lang string, ord int, key long, n long")
    return parts.groupBy("lang", "ord", "key").agg(F.sum("n").alias("n"))


class Table:
    """Rows of distinct keys by open addressing, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.key, self.row = np.zeros(1 << self.bits, np.uint32), np.full(1 << self.bits, -1, np.int32)
        rest, at = np.arange(len(keys)), self._home(keys)
        while len(rest):
            free = self.row[at[rest]] < 0
            slot, first = np.unique(at[rest[free]], return_index=True)
            put = rest[free][first]
            self.key[slot], self.row[slot] = keys[put], put
            rest = rest[self.row[at[rest]] != rest]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._home(keys)
        out = self.row[at]
        rest = np.nonzero((out >= 0) & (self.key[at] != keys))[0]
        while len(rest):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            out[rest] = self.row[at[rest]]
            rest = rest[(out[rest] >= 0) & (self.key[at[rest]] != keys[rest])]
        return out


@dataclass
class Part:
    """By order: a table of contexts and their byte, with bits by language, and one of contexts, with escape bits."""

    langs: list[str]
    grams: list[tuple[Table, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[Table, np.ndarray]] = field(default_factory=list)

    def bits(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte of each key of order + 1 bytes, by language."""
        out = np.zeros((len(keys), len(self.langs)), np.float32)
        rest = None
        for o in range(order, -1, -1):
            own = keys if rest is None else keys[rest]
            own = own & np.uint32((1 << 8 * (o + 1)) - 1)
            row = self.grams[o][0].find(own)
            seen = row >= 0
            if rest is None:
                out[seen] = self.grams[o][1][row[seen]]
                rest = np.nonzero(~seen)[0]
            else:
                out[rest[seen]] += self.grams[o][1][row[seen]]
                rest = rest[~seen]
            own = own[~seen]
            if not len(rest):
                return out
            if o:
                row = self.contexts[o][0].find(own >> np.uint32(8))
                seen = row >= 0
                out[rest[seen]] += self.contexts[o][1][row[seen]]
            else:
                out[rest] += self.contexts[0][1][0] + 8
        return out

    def add_order(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Finishes the next order from the counts (keys by languages) of its sorted keys."""
        o = len(self.grams)
        of = keys >> np.uint32(8) if o else np.zeros(len(keys), np.uint32)
        contexts, start, group = np.unique(of, return_index=True, return_inverse=True)
        if not len(keys):
            contexts, n, d = np.zeros(1, np.uint32), np.zeros((1, len(self.langs))), np.zeros((1, len(self.langs)))
        else:
            n, d = np.add.reduceat(counts, start, axis=0).astype(float), np.add.reduceat((counts > 0).astype(np.int64), start, axis=0).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
            seen = -np.log2(counts / (n + d)[group]) if len(keys) else np.zeros((0, len(self.langs)))
        lower = self.bits(keys, o - 1) if o else np.full(counts.shape, 8.0)
        cost = np.where(counts > 0, seen, escape[group] + lower) if len(keys) else seen
        self.grams.append((Table(keys), cost.astype(np.float32)))
        self.contexts.append((Table(contexts.astype(np.uint32)), escape.astype(np.float32)))

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text, by language."""
        out = np.zeros((len(texts), len(self.langs)))
        parts: list[tuple[int, bytes]] = []
        held = 0

        def score() -> None:
            data = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
            bits = np.concatenate([self.bits(_keys(data, ORDER), ORDER), np.zeros((1, len(self.langs)), np.float32)])
            ends = np.cumsum([len(p) for _, p in parts])
            begins = ends - [len(p) for _, p in parts]
            sums = np.add.reduceat(bits, np.stack([begins, ends - ORDER], 1).ravel(), axis=0, dtype=np.float64)[::2]
            np.add.at(out, [i for i, _ in parts], sums)

        for i, text in enumerate(texts):
            padded = PAD + text
            for at in range(0, len(text), CHUNK):
                parts.append((i, padded[at : at + CHUNK + ORDER]))
                held += len(parts[-1][1])
                if held >= CHUNK:
                    score()
                    parts, held = [], 0
        if parts:
            score()
        return out


@dataclass
class Model:
    langs: list[str]
    parts: list[Part]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of each text, by language."""
        return np.concatenate([p.lengths(texts) for p in self.parts], 1)


def learn(docs: DataFrame, per_language: int = DOCS_A_LANGUAGE, in_all: int = DOCS_IN_ALL) -> Model | None:
    """The frozen model of all languages that label a document; None if no document is labelled.

    Null texts and labels teach nothing, null doc_ids count as the empty text in the choice of held-out documents; repeated
    rows count as often as they stand there. Documents of any length count whole."""
    counted = staged(gram_counts(training_sample(docs, per_language, in_all)), "grams")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    parts = []
    for at in range(0, len(langs), BLOCK):
        own = langs[at : at + BLOCK]
        part = Part(own)
        for order in range(ORDER + 1):
            rows = counted.filter((F.col("ord") == order) & F.col("lang").isin(own)).select("lang", "key", "n").toArrow()
            keys, of = np.unique(rows.column("key").to_numpy().astype(np.uint32), return_inverse=True)
            counts = np.zeros((len(keys), len(own)), np.int64)
            counts[of, np.searchsorted(own, rows.column("lang").to_pylist())] = rows.column("n").to_numpy()
            part.add_order(keys, counts)
        parts.append(part)
    release(counted)
    return Model(langs, parts) if langs else None


def judge(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """lang_pred, score and bits a byte of each text: `und`, 0 and null where there is no letter (or no model)."""
    out: list[tuple] = [("und", 0.0, None)] * len(texts)
    which = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
    if which:
        raw = [texts[i].encode() for i in which]
        bits = model.lengths(raw)
        best = bits.argmin(1)
        least = bits[np.arange(len(which)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        for j, i in enumerate(which):
            out[i] = model.langs[best[j]], float(share[j]), float(least[j] / len(raw[j]))
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """For each row: doc_id, held_out, lang_pred, score, bits_per_byte, from the whole text alone.

    lang_pred is a learned language, `und` if the text is null or has no letter; on a tie the alphabetically first one
    wins. score is the language's posterior under equal priors. Null and repeated doc_ids stay rows of their own; an
    empty table gives an empty result; other columns are ignored. Texts of any length are scored whole, CHUNK bytes at a
    time. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = judge(shared.value, batch.column(2).to_pylist())
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = on_workers(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def accept(docs: DataFrame, model: Model | None, spare_bits: float = 256.0) -> DataFrame:
    """The rows of docs, whole, whose text is in some learned language: not `und`, and in that language's code no longer
    than the bytes themselves and spare_bits, which the first letters of a short text may cost.

    Null texts go, as do those without a letter, and all rows if no language was learned; null and repeated doc_ids and
    repeated rows are rows like others. An empty table gives an empty result; other columns stay, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([lang != "und" and (bits - 8) * len(text.encode()) <= spare_bits for text, (lang, _, bits) in zip(texts, judge(shared.value, texts))], pa.bool_()))

    return on_workers(docs).mapInArrow(run, docs.schema)
