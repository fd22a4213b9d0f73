"""Quality rules as learned decision lists; DataFrame functions only.

From labelled statistics of texts, rules are learned by sequential covering: a rule grows by the threshold that gains most
(FOIL's gain) on two thirds of the labelled rows, is pruned on the rest to the prefix that is best there, and is kept
if it is precise enough; the rows it covers are set aside, and the next rule is learned. The list becomes one Spark
conditional expression: the first rule that holds rejects the text, and what no rule rejects is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, release, staged, text_or_empty

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs", "n_distinct"]
#: What rules may ask for: quotients of the statistics.
FEATURES = {
    "n_words": "cast(n_words as double)", "chars_a_word": "try_divide(word_chars, n_words)", "symbols_a_word": "try_divide(n_symbols, n_words)",
    "dup_lines": "try_divide(n_dup_lines, n_lines)", "repeat_words": "try_divide(n_repeat_words, n_words)", "capitals": "try_divide(n_capitals, word_chars)",
    "bangs_a_word": "try_divide(n_bangs, n_words)", "distinct_words": "try_divide(n_distinct, n_words)",
}


def _without(pattern: str) -> Column:
    """Characters that match the pattern."""
    return (F.char_length("pal_text") - F.char_length(F.regexp_replace("pal_text", pattern, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines,
    n_capitals, n_bangs, n_distinct for the rules. Null texts have no words; null and repeated doc_ids and repeated rows are
    rows like others; an empty table gives an empty result; other columns are ignored. A text of any length counts whole; its
    words' hashes are one array of its row.

    Repeated windows are found in the row: hashes of words, then of windows; where some hash repeats, windows are sorted
    by hash so that equal ones are neighbours, and those that have one are covered from left to right.
    """
    d = docs.select("doc_id", text_or_empty().alias("pal_text")).withColumn("words", F.array_remove(F.split("pal_text", SPACE_RUN), ""))
    d = d.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), (F.char_length(F.regexp_replace("pal_text", SPACE_RUN, ""))).cast("long").alias("word_chars"),
        _without(SYMBOLS + "+").alias("n_symbols"), _without("[A-Z]+").alias("n_capitals"), _without("!+").alias("n_bangs"),
        F.filter(F.split("pal_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    # hashes of 2, 4 and 8 neighbours; no lambda reads another array, so that a plan that inlines them stays linear
    for n in (1, 2, 4):
        d = d.withColumn("h", F.expr(f"zip_with(h, slice(h, {n + 1}, greatest(size(h) - {n}, 0)), (a, b) -> xxhash64(a, b))"))
    d = d.withColumn("wins", F.expr(f"slice(h, 1, greatest(size(h) - {WINDOW - 1}, 0))"))
    d = d.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    d = d.withColumn("again", F.size(F.array_distinct("wins")) < F.size("wins"))
    d = d.withColumn("ranked", F.expr("if(again, sort_array(transform(wins, (x, i) -> named_struct('h', x, 'i', i))), null)"))
    d = d.withColumn("equal", F.expr("if(again, zip_with(ranked, slice(ranked, 2, size(ranked)), (a, b) -> coalesce(a.h = b.h, false)), null)"))
    d = d.withColumn("hit", F.expr("if(again, zip_with(equal, concat(array(false), equal), (next, last) -> coalesce(next, false) or last), null)"))
    d = d.withColumn("at", F.expr("if(again, sort_array(filter(zip_with(ranked, hit, (r, f) -> if(f, r.i, null)), x -> x is not null)), null)"))
    covered = (
        f"if(again, aggregate(at, named_struct('last', -{WINDOW}, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}, p - a.last)), a -> a.n), 0L)"
    )
    return d.withColumn("n_repeat_words", F.expr(covered)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs", "n_distinct")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Learning:
    """Labelled rows that are learned from at most, chosen by a hash of doc_id; thresholds a feature and class; rules, and
    conditions of a rule, at most; the share of bad ones among the rows that a rule covers, and how many of them, at least."""

    most_labelled: int = 20_000
    quantiles: int = 24
    most_rules: int = 8
    most_conditions: int = 3
    precision: float = 0.95
    least_covered: int = 8


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        f = F.expr(FEATURES[self.feature])
        return F.coalesce(f > self.threshold if self.above else f <= self.threshold, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """Whether the list keeps a text with these statistics: the first rule that holds rejects it."""
    if not rules:
        return F.lit(True)
    out = F
    for rule in rules:
        out = out.when(holds(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def learn(stats: DataFrame, labels: DataFrame, given: Learning | None = None) -> list[Rule]:
    """Rules that reject texts like those with quality 0.

    Learned from labelled rows that don't fail the base rules: labels that are null or of no row of stats teach nothing.
    Repeated labels of a doc_id count once, with the least quality, and repeated doc_ids once, with the least statistics;
    null doc_ids have no label. Without two classes there are no rules. Of conditions that gain alike, the first by feature
    and threshold wins, `<=` before `>`. Other columns are ignored."""
    given = given or Learning()
    sample = staged(labelled(stats, labels, given.most_labelled), "labelled")
    cuts = thresholds(sample, given.quantiles)
    rules: list[Rule] = []
    left = F.lit(True)
    while cuts and len(rules) < given.most_rules:
        rule = _pruned(sample.filter(left & ~F.col("grow")), _grown(sample.filter(left & F.col("grow")), cuts, given), given.precision)
        if not rule:
            break
        rules.append(rule)
        left = left & ~holds(rule)
    release(sample)
    return rules


def labelled(stats: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(bad, grow, statistics) of at most so many labelled rows; those with grow make rules, the others prune them."""
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.filter(~base_failed()).select("doc_id", F.struct(*STATISTICS).alias("s")).join(own, "doc_id").groupBy("doc_id").agg(F.min("s").alias("s"), F.min("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return rows.select((F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("grow"), "s.*")


def thresholds(sample: DataFrame, quantiles: int) -> dict[str, list[float]]:
    """Candidate thresholds of each feature: quantiles of both classes."""
    marks = F.array(*[F.lit(i / quantiles) for i in range(quantiles + 1)])
    found = sample.groupBy("bad").agg(*[F.percentile_approx(F.expr(f), marks, 10_000).alias(n) for n, f in FEATURES.items()]).collect()
    if len(found) < 2:
        return {}
    return {n: sorted({float(x) for r in found for x in r[n] or ()}) for n in FEATURES}


def _grown(rows: DataFrame, cuts: dict[str, list[float]], given: Learning) -> Rule:
    rule: Rule = ()
    while len(rule) < given.most_conditions:
        counts = _counts(rows.filter(holds(rule)), cuts)
        bad, good = (sum(x[i] for x in counts[next(iter(cuts))]) for i in (0, 1))
        if not bad or not good:
            break
        best, most = None, 0.0
        for feature, bins in counts.items():
            below_bad = below_good = 0
            for threshold, (b, g) in zip(cuts[feature], bins):
                below_bad, below_good = below_bad + b, below_good + g
                for above, p, n in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                    if p >= given.least_covered:
                        gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                        if gain > most + 1e-9:
                            best, most = Condition(feature, above, threshold), gain
        if not best:
            break
        rule += (_centred(rows.filter(holds(rule)), best),)
    return rule


def _centred(rows: DataFrame, c: Condition) -> Condition:
    """The condition with its threshold in the middle of the gap between the rows' values on both sides of it."""
    f = F.expr(FEATURES[c.feature])
    got = rows.agg(F.max(F.when(f <= c.threshold, f)).alias("lo"), F.min(F.when(f > c.threshold, f)).alias("hi")).first()
    return c if got["lo"] is None or got["hi"] is None else Condition(c.feature, c.above, (got["lo"] + got["hi"]) / 2)


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """By feature: bad and good rows between neighbouring thresholds (bin i: above threshold i - 1, up to i)."""
    places = [
        F.struct(F.lit(n).alias("f"), F.expr(f"size(filter(array({', '.join(f'{t!r}D' for t in cuts[n])}), t -> t < coalesce({FEATURES[n]}, 0D)))").alias("i")) for n in cuts
    ]
    got = rows.select("bad", F.explode(F.array(*places)).alias("x")).groupBy("x.f", "x.i").agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")).collect()
    out = {n: [(0, 0)] * (len(cuts[n]) + 1) for n in cuts}
    for r in got:
        out[r["f"]][r["i"]] = (r["b"], r["g"])
    return out


def _pruned(rows: DataFrame, rule: Rule, precision: float) -> Rule:
    """The prefix of the rule that is best on rows it wasn't grown on; none if it isn't precise enough there."""
    if not rule:
        return ()
    prefixes = [rule[: i + 1] for i in range(len(rule))]
    got = rows.agg(*[F.count_if(holds(p) & F.col("bad")).alias(f"p{i}") for i, p in enumerate(prefixes)], *[F.count_if(holds(p) & ~F.col("bad")).alias(f"n{i}") for i, p in enumerate(prefixes)]).first()
    worth = lambda i: (got[f"p{i}"] - got[f"n{i}"]) / max(1, got[f"p{i}"] + got[f"n{i}"])
    good = [i for i in range(len(rule)) if got[f"p{i}"] and got[f"p{i}"] >= precision * (got[f"p{i}"] + got[f"n{i}"])]
    return prefixes[max(good, key=lambda i: (worth(i), got[f"p{i}"]))] if good else ()


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, kept and reason: the first rule that rejects, as text, `base` before all, else null. A feature
    that has no value (no words, no lines) meets no condition; columns of these names are replaced, others stay."""
    reason = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        reason = reason.when(holds(rule), F.lit(" and ".join(map(str, rule))))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules)).withColumn("reason", reason)
