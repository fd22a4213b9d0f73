"""Canonical JSON, byte and digest expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Framing of a state: messages joined by commas between these, and an identity before them.
OPEN, CLOSE = '{"messages":[', "]}"
IDENTITY_OPEN, IDENTITY_CLOSE = '{"identity":', ',"messages":['
EMPTY_STATE_LEN = len(OPEN + CLOSE)


def message(role: Column, content: Column) -> Column:
    """Keys in alphabetical order, no spaces, null keys kept."""
    return F.to_json(F.struct(content.alias("content"), role.alias("role")), {"ignoreNullFields": "false"})


def state(messages: Column, identity: Column | None = None) -> Column:
    body = F.concat(F.array_join(messages, ","), F.lit(CLOSE))
    return F.concat(F.lit(OPEN), body) if identity is None else F.concat(F.lit(IDENTITY_OPEN), identity, F.lit(IDENTITY_CLOSE), body)


def framed(body: Column, identity: Column, result: Column) -> Column:
    """The state of all three channels: messages joined by commas, an identity and a result (JSON texts, null if there is
    none). A state without the last two is that of its messages alone."""
    plain = F.concat(F.lit(OPEN), body, F.lit(CLOSE))
    tail = F.coalesce(F.concat(F.lit('],"result":'), result, F.lit("}")), F.lit(CLOSE))
    return F.when(identity.isNull() & result.isNull(), plain).otherwise(F.concat(F.lit(IDENTITY_OPEN), F.coalesce(identity, F.lit("null")), F.lit(IDENTITY_CLOSE), body, tail))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def le64(x: Column) -> Column:
    """A long as eight bytes, least first. reverse() of binaries goes through text, so hex pairs are reversed."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(F.lpad(F.hex(x), 16, "0"), i * 2 + 1, F.lit(2)))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def be32(x: Column) -> Column:
    return F.unhex(F.lpad(F.hex(x), 8, "0"))


def encode_binding(thread: Column, checkpoint: Column) -> Column:
    """Length of the thread's bytes (big-endian 32 bits), the thread, the checkpoint."""
    return F.concat(be32(F.octet_length(thread)), F.encode(thread, "UTF-8"), F.encode(checkpoint, "UTF-8"))


def decode_binding(binding: Column) -> Column:
    """(thread_id, checkpoint_id) of encode_binding(); null if it is none."""
    n = F.conv(F.hex(F.substring(binding, 1, 4)), 16, 10).cast("long")
    size = F.octet_length(binding)
    parts = F.struct(
        F.decode(F.substring(binding, F.lit(5), n.cast("int")), "UTF-8").alias("thread_id"),
        F.decode(F.substring(binding, (n + 5).cast("int"), size), "UTF-8").alias("checkpoint_id"))
    return F.when((size > 4) & (n > 0) & (n + 4 < size), parts)


def splice_digest(history: Column, parent: Column, offset: Column, delete: Column, insert: Column, binding: Column) -> Column:
    """SHA-256 over everything a splice asks for, lengths before bytes, so that no two requests read alike."""
    flag = lambda x: F.when(x.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    zero = F.lit(0).cast("long")
    return F.sha2(F.concat(
        F.encode(F.lit("splice\0"), "UTF-8"), le64(history), flag(parent), le64(F.coalesce(parent, zero)), le64(offset), le64(delete),
        le64(F.octet_length(insert).cast("long")), insert, flag(binding),
        F.coalesce(F.concat(le64(F.octet_length(binding).cast("long")), binding), F.unhex(F.lit("")))), 256)


def fork_digest(history: Column, parent: Column, binding: Column) -> Column:
    flag = F.when(binding.isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01")))
    tail = F.coalesce(F.concat(le64(F.octet_length(binding).cast("long")), binding), F.unhex(F.lit("")))
    return F.sha2(F.concat(F.encode(F.lit("fork\0"), "UTF-8"), le64(history), le64(parent), flag, tail), 256)


def thread_key(thread: Column, namespace: Column) -> Column:
    """A compound thread key as a JSON pair, and back."""
    return F.to_json(F.array(thread, namespace))


def parse_thread_key(key: Column) -> Column:
    return F.from_json(key, "array<string>")


def xxh3_64(payload: Column) -> Column:
    """XXH3 (64 bits, unsigned, as a decimal): no built-in has it, so it goes through Arrow batches."""
    @F.pandas_udf("decimal(20,0)")
    def digest(x: pd.Series) -> pd.Series:
        from decimal import Decimal

        import xxhash

        return x.map(lambda b: None if b is None else Decimal(xxhash.xxh3_64_intdigest(bytes(b))))

    return digest(payload)
