"""Quality rules: a learned decision list over text statistics, in DataFrame and SQL functions only.

Statistics.  Per document: words and their code points, symbols, repeated lines, and the words inside
three-word windows that the text has twice or more.

Learning.  Rules are learnt by sequential covering from labelled rows that the base conditions leave:
two thirds (by a hash of the id) grow a rule, one threshold condition at a time by FOIL's information
gain; the last third prunes its conditions from the end while precision on it does not fall, and must
confirm it (``PRECISION``, ``LEAST_ROWS``).  Rows that the rule covers are removed, and the next one is
learnt, until none is confirmed.  Counts per (feature, threshold bin, label) come from Spark
aggregations whose results have at most features x bins x 2 rows; the driver only compares them.

Application.  The list is an ordered Spark expression (when ... when ... otherwise) that names the
first rule that rejects a document, so all of it is compiled code over columns.

Scale.  Everything per document is computed within its row, in time n log n; no words are exploded or
shuffled.  Labels are joined to the narrow statistics, not to texts.

Edge cases.  A null text has no words: all statistics are 0, and the base conditions reject it.  Rows
are judged one by one; extra columns are not read, and carried along by ``accepted``.  Labels that are null, contradictory (the lower counts) or belong to no document
teach nothing or as stated; without labels of both kinds the list is empty.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import SPACES, WORD
from voxloom.session import checked_broadcast, durable

#: Base conditions: fewer words, or more than this share of words in repeated windows (per cent), reject.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3
RULES, CONDITIONS, PRECISION, LEAST_ROWS, BINS = 8, 3, 0.95, 5, 24


# --- statistics --------------------------------------------------------------------------------


def statistics(docs: DataFrame, *extra: Column) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) of each row (doc_id, text), and ``extra``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = docs.select("doc_id", text.alias("text"), words.alias("w"), lines.alias("l"), F.struct(F.lit(0).alias("none"), *extra).alias("extra"))
    grams = F.when(
        F.size("w") >= WINDOW,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.struct(F.xxhash64(*(F.get(F.col("w"), i + k) for k in range(WINDOW))).alias("h"), i.alias("i")))),
    )
    out = out.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        grams.alias("g"),
        "extra",
    )
    # Sorted by hash, equal windows are neighbours: one fold over the sorted array keeps the places of repeated ones.
    same = F.zip_with(F.slice("g", 1, F.size("g") - 1), F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), lambda a, b: a["h"] == b["h"])
    out = out.withColumn("same", F.when(F.size("g") >= 2, same))
    before = F.concat(F.array(F.lit(False)), F.col("same"))
    after = F.concat(F.col("same"), F.array(F.lit(False)))
    out = out.withColumn("again", F.when(F.exists("same", lambda x: x), F.zip_with(before, after, lambda a, b: a | b)))
    places = F.sort_array(F.filter(F.zip_with("g", "again", lambda g, a: F.when(a, g["i"])), lambda i: i.isNotNull()))
    out = out.withColumn("places", F.when(F.col("again").isNotNull(), places))
    # A window covers its words but for those that the next repeated window covers.
    gaps = F.zip_with(F.slice("places", 1, F.size("places") - 1), F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)
    repeated = F.when(F.size("places") >= 2, covered).otherwise(F.lit(0))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", repeated.cast("long").alias("n_repeat_words"), "extra.*").drop("none")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def features() -> dict[str, Column]:
    """The statistics that rules put thresholds on, as doubles; shares of nothing are 0."""
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0).cast("long")), F.lit(0.0))
    return {
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "mean_word": per("word_chars", "n_words"),
        "n_words": F.col("n_words").cast("double"),
    }


# --- learning ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"f_{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _counts(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[tuple[str, bool, float], tuple[int, int]]:
    """For each feature, side and threshold the (bad, good) rows that satisfy the condition; one aggregation."""
    pairs = []
    for name, cuts in thresholds.items():
        bin_ = sum((F.when(F.col(f"f_{name}") > c, 1).otherwise(0) for c in cuts), F.lit(0))
        pairs.append(F.struct(F.lit(name).alias("feature"), bin_.alias("bin")))
    binned = rows.select("bad", F.explode(F.array(*pairs)).alias("p")).groupBy("p.feature", "p.bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
    table: dict[str, dict[int, tuple[int, int]]] = {}
    for feature, bin_, bad, good in binned.collect():  # at most features x bins rows
        table.setdefault(feature, {})[bin_] = (bad, good)
    out = {}
    for name, cuts in thresholds.items():
        own = table.get(name, {})
        for k, cut in enumerate(cuts, 1):
            above = [sum(v[i] for b, v in own.items() if b >= k) for i in (0, 1)]
            below = [sum(v[i] for b, v in own.items() if b < k) for i in (0, 1)]
            out[name, True, cut] = (above[0], above[1])
            out[name, False, cut] = (below[0], below[1])
    return out


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: middles between neighbours among the quantiles of the bad rows and those of the good ones."""
    names = list(features())
    asked = [i / BINS for i in range(BINS + 1)]
    found: dict[str, set[float]] = {n: set() for n in names}
    for r in rows.groupBy("bad").agg(*(F.percentile_approx(f"f_{n}", asked, 10_000).alias(n) for n in names)).collect():
        for n in names:
            found[n] |= set(r[n] or ())
    cuts = {n: [(a + b) / 2 for a, b in itertools.pairwise(sorted(values))] for n, values in found.items()}
    return {n: c for n, c in cuts.items() if c}


def learn(labelled: DataFrame) -> list[Rule]:
    """The ordered rules that reject, of rows (doc_id, bad, f_* features) that the base conditions leave; they are read several times."""
    rows = labelled.withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2)
    thresholds = _thresholds(rows)
    rules: list[Rule] = []
    covered = F.lit(False)
    while thresholds and len(rules) < RULES:
        left = rows.where(~covered)
        grow, prune = left.where("grow"), left.where("not grow")
        bad, good = grow.agg(F.count_if("bad"), F.count_if(~F.col("bad"))).first()
        if bad < LEAST_ROWS or not good:
            break
        rule: Rule = ()
        while len(rule) < CONDITIONS and good:
            counts = _counts(grow.where(_all(rule)), thresholds)
            base = math.log2(bad / (bad + good))
            gains = {k: p * (math.log2(p / (p + n)) - base) for k, (p, n) in counts.items() if p >= LEAST_ROWS}
            if not gains or max(gains.values()) <= 1e-9:
                break
            top = max(gains.values())
            # Of conditions as good, the one in the middle of their thresholds: the widest margin on both sides.
            ties = sorted(k for k, g in gains.items() if g >= top - 1e-9)
            ties = [k for k in ties if k[:2] == ties[0][:2]]
            best = ties[len(ties) // 2]
            rule = (*rule, Condition(*best))
            bad, good = counts[best]
        if not rule:
            break
        # Prefixes of the rule on the rows that did not grow it: the shortest of the highest precision.
        parts = [rule[: i + 1] for i in range(len(rule))]
        sums = prune.agg(*(F.count_if(_all(p) & F.col("bad")) for p in parts), *(F.count_if(_all(p) & ~F.col("bad")) for p in parts)).first()
        scored = [(sums[i] / (sums[i] + sums[i + len(parts)]) if sums[i] else 0.0, -i) for i in range(len(parts))]
        precision, at = max(scored)
        kept = parts[-at]
        if precision < PRECISION or sums[-at] < LEAST_ROWS / 2:
            break
        rules.append(kept)
        covered = covered | _all(kept)
    return rules


def fit(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """The rules of the labelled rows of ``stats``; quality 0 is bad."""
    known = labels.select(F.col("doc_id").alias("__id"), "quality").where("doc_id is not null and quality in (0, 1)").groupBy("__id").agg((F.min("quality") == 0).alias("bad"))
    rows = stats.join(known, F.col("doc_id") == F.col("__id"))
    # Written before the filter: pushed below the statistics, it would split the text anew for each window.
    rows = durable(rows.select("doc_id", "bad", base_failed().alias("failed"), *(c.alias(f"f_{n}") for n, c in features().items())))
    return learn(rows.where("not failed").drop("failed"))


def rejection(rules: list[Rule]) -> Column:
    """The ordered expression: the text of the first rule that covers a row of statistics, or null."""
    values = features()

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & (values[c.feature] > c.threshold if c.above else values[c.feature] <= c.threshold)
        return out

    out = None
    for rule in rules:
        name = F.lit(" and ".join(map(str, rule)))
        out = F.when(holds(rule), name) if out is None else out.when(holds(rule), name)
    return F.lit(None).cast("string") if out is None else out


def _judged(docs: DataFrame, labels: DataFrame, *extra: Column) -> DataFrame:
    stats = durable(statistics(docs, *extra))
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rejection(fit(stats, labels))).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule) of each row."""
    return _judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep.

    A verdict depends on the text alone, so each row is decided by its text (two 64-bit hashes), whatever its id.
    """
    a, b = F.xxhash64("text"), F.xxhash64(F.lit(7), "text")
    gone = _judged(docs, labels, a.alias("a"), b.alias("b")).where("not kept").select("a", "b").distinct()
    rows = docs.select(F.struct("*").alias("row"), a.alias("__a"), b.alias("__b"))
    return rows.join(checked_broadcast(durable(gone)), (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left_anti").select("row.*")
