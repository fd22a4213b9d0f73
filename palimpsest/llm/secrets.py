"""Secret scans with linking of multipart credentials; DataFrame functions only.

Strong spans (assigned secrets, access identifiers, long hex strings) are always reported. Weak candidates are
identifiers (user names, mail addresses), mixed tokens, short assigned secrets and endpoints (URLs, hosts): harmless alone.
An interval join within one text tells which of them complementary parts complete: an identifier is reported if a secret
begins within SCOPE code points of it, a token if an identifier does, a short secret if an identifier or an endpoint does,
an endpoint if an assigned or hexadecimal secret does, or an identifier and any secret. The join is a range frame over the starts of one
text's parts, so it makes no pairs, and a frame holds no more parts than begin within 2 * SCOPE code points.

A text is searched once. Its matches leave it as lengths; positions are running sums over rows, so that many matches in one
text cost time in proportion. Rows without a match pass straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged, text_or_empty

SCOPE = 256
MASK = "[SECRET]"
#: Code points of a short assigned secret at least, and of a chunk of a text that is masked.
SHORT, CHUNK = 4, 4096
#: Kinds in order of listing; the first three are strong.
KINDS = ["assign", "access", "hex", "id", "email", "token", "pass", "endpoint", "host"]
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "id", "email"), ("assign", "hex", "token", "pass"), ("endpoint", "host")
# The look-ahead at a pattern's head changes no match: it lets most positions fail on one character class.
ASSIGN = r"""(?i)(?=[psta])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # a run of fewer characters fails, and runs don't overlap
ID = r"""(?i)(?=[cula])(client_?id|user_?name|user|login|account|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"(?i)(https?|wss?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:@/?&=%-]{4,}"
HOST = r"[0-9](?<![0-9.].)[0-9]{0,2}(?:\.[0-9]{1,3}){3}(?![0-9.]*[0-9])(?::[0-9]{1,5})?"

SPAN = "struct<start:int,ord:int,end:int,kind:string>"
NONE = f"cast(array() as array<{SPAN}>)"


def _hits(pattern: str, kind: str, when: str = "true", group: int = 0) -> Column:
    """Lengths of the gaps, matches and groups of the pattern's leftmost non-overlapping matches; null if there is none.

    The gaps between matches come from split(), the matches from regexp_extract_all(): both walk the text alike."""
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    sizes = lambda x: f"transform({x}, x -> char_length(x))"
    all_of = lambda g: f"regexp_extract_all(body, {p}, {g})"
    return F.expr(f"if(({when}) and body rlike {p}, named_struct('o', {KINDS.index(kind)}, 'gap', {sizes(f'split(body, {p}, -1)')}, 'size', {sizes(all_of(0))}, 'own', {sizes(all_of(group))}), null)")


def _searched(rows: DataFrame) -> DataFrame:
    """rows with body (the text) replaced by hits: the matches of each kind that has some, and a number of the row."""
    some = lambda *names: " or ".join(f"{n} is not null" for n in names)
    one = rows.select(
        "*", _hits(ASSIGN, "assign", group=2).alias("a"), _hits(ACCESS, "access", "contains(body, 'AKIA')").alias("k"), _hits(HEX, "hex").alias("h"),
        _hits(ID, "id", "contains(body, '=') or contains(body, ':')").alias("i"), _hits(EMAIL, "email", "contains(body, '@')").alias("e"))
    two = one.select(
        "*", _hits(TOKEN, "token", some("i", "e", "k")).alias("t"),  # without an identifier no token is reported
        _hits(ENDPOINT, "endpoint", f"({some('a', 'h', 'i', 'e', 'k')}) and contains(body, '://')").alias("u"), _hits(HOST, "host", some("a", "h", "i", "e", "k")).alias("v"))
    return two.withColumn("hits", F.expr("filter(array(a, k, h, i, e, t, u, v), x -> x is not null)")).withColumn("number", F.monotonically_increasing_id()).drop(*"akhietuv")


def _spans(searched: DataFrame) -> DataFrame:
    """(number, start, ord, end, kind) of what is reported. searched is a written table, so that its numbers hold."""
    each = searched.filter("size(hits) > 0").select("number", F.explode("hits").alias("x")).select("number", "x.o", F.posexplode(F.arrays_zip("x.gap", "x.size", "x.own")).alias("i", "z"))
    each = each.filter("z.size is not null").select("number", "o", "i", "z.gap", "z.size", "z.own").repartition("number")
    so_far = W.partitionBy("number", "o").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    ordinal = F.when((F.col("o") == 0) & (F.col("own") < 12), KINDS.index("pass")).otherwise(F.col("o"))
    placed = placed.withColumn("ord", ordinal).filter(f"(o <> 1 or size >= 18) and (o <> 0 or own >= {SHORT})")
    parts = placed.select("number", "start", "ord", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.col("ord") + 1).alias("kind"))
    # a token that strong spans cover is no news
    rising, falling = (W.partitionBy("number").orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.col("start"), F.col("start").desc()))
    strong = lambda c: F.when(F.col("ord") < 3, F.col(c))
    parts = parts.withColumn("before", F.max(strong("end")).over(rising)).withColumn("after", F.min(strong("start")).over(falling))
    parts = parts.filter((F.col("kind") != "token") | (F.coalesce("before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True)))
    scope = W.partitionBy("number").orderBy("start").rangeBetween(-SCOPE, SCOPE)
    near = lambda kinds: F.max(F.col("kind").isin(*kinds)).over(scope)
    linked = parts.select("number", "start", "ord", "end", "kind", near(IDENTIFIERS).alias("id"), near(SECRETS).alias("secret"), near(("assign", "hex", "pass")).alias("strong"), near(ENDPOINTS).alias("endpoint"))
    whole = F.expr("case when ord < 3 then true when kind in ('id', 'email') then secret when kind = 'token' then id when kind = 'pass' then id or endpoint else strong or id and secret end")
    return linked.filter(whole).select("number", "start", "ord", "end", "kind")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, ord, end, kind; sorted, ends exclusive) of each row's whole text.

    Null texts count as empty. Null and repeated doc_ids are rows like others, each with spans of its own; spans of two
    kinds may overlap, and at one start they go in the order of KINDS. An empty table gives an empty result; other columns
    are ignored. A text of any length is searched whole; only lengths of its matches leave it.
    """
    searched = staged(_searched(docs.select("doc_id", text_or_empty().alias("body"))).drop("body"), "matches")
    listed = _spans(searched).groupBy("number").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("spans"))
    straight = searched.filter("size(hits) = 0").select("doc_id", F.expr(NONE).alias("spans"))
    others = searched.filter("size(hits) > 0").select("number", "doc_id").join(listed, "number", "left")
    return straight.unionByName(others.select("doc_id", F.coalesce("spans", F.expr(NONE)).alias("spans")))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by MASK (overlapping ones by one), and n_chars, where there is such a
    column, following. No row is dropped.

    Rows without a span stay as they are, null texts too, and don't shuffle. Null and repeated doc_ids and repeated rows are
    rows like others; other columns stay, whatever their names. An empty table gives an empty result. A text of any length
    is masked whole, in time in proportion to its length and its spans.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").cast("string").alias("text"), text_or_empty().alias("body"))
    searched = staged(_searched(rows).drop("body"), "matches")
    ahead = W.partitionBy("number").orderBy("start", "ord", "end").rowsBetween(W.unboundedPreceding, -1)
    apart = _spans(searched).withColumn("first", F.coalesce(F.max("end").over(ahead) <= F.col("start"), F.lit(True)).cast("int"))
    grouped = apart.withColumn("mask", F.sum("first").over(W.partitionBy("number").orderBy("start", "ord", "end").rowsBetween(W.unboundedPreceding, 0)))
    masks = grouped.groupBy("number", "mask").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    masks = masks.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("masks"))
    chunks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))  # so that a piece is found without walking the text
    found = searched.filter("size(hits) > 0").select("number", "row", "text", chunks.alias("chunks"), F.char_length("text").alias("n")).join(masks, "number", "left")
    at, lo = f"((a div {CHUNK} + j) * {CHUNK})", f"greatest(a - (a div {CHUNK} + j) * {CHUNK}, 0)"  # where chunk j begins, and from where it counts
    part = f"substring(x, int({lo} + 1), int(least(b - {at}, {CHUNK}) - {lo}))"
    count = f"if(a < b, (b + {CHUNK - 1}) div {CHUNK} - a div {CHUNK}, 0)"
    piece = f"array_join(transform(slice(chunks, int(a div {CHUNK} + 1), int({count})), (x, j) -> {part}), '')"
    pieces = f"zip_with(concat(array(0), masks.end), concat(masks.start, array(n)), (a, b) -> {piece})"
    masked = found.withColumn("text", F.expr(f"if(masks is null, text, array_join({pieces}, '{MASK}'))"))

    def columns(df: DataFrame, changed: bool) -> DataFrame:
        out = []
        for c in docs.columns:
            value = F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col("row").getField(c)
            if c == "n_chars" and changed:
                value = F.when(F.col("masks").isNull(), value).otherwise(F.char_length("text").cast(docs.schema[c].dataType))
            out.append(value.alias(c))
        return df.select(*out)

    return columns(searched.filter("size(hits) = 0"), False).unionByName(columns(masked, True))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Of scan(): counts by strong kind, the SHA-256 of the strong spans' list, and the list of all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(_listed(F.filter("spans", lambda s: s["ord"] < 3)), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
