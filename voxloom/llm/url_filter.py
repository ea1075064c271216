"""URL filters: explicit rules first, then association rules that Spark's FP-growth mines from labelled urls.

Explicit rules.  A rule (verdict, host, path) fits its host and all subdomains, where the url's path
starts with the rule's path; the longest rule that fits decides.

Mined rules.  The urls that an explicit rule decides are the labelled transactions: the tokens of the
url (host labels and their parts, top-level name, path words, query keys; numbers as one token) plus the
verdict as an item.  FP-growth finds frequent itemsets, and rules "tokens -> verdict" of at least
``CONFIDENCE`` are kept, without those that a more general rule of no less confidence makes needless.
FP-growth has no bound on the length of itemsets, so where a basket holds more than ``BASKET`` items
(urls that share many parameters) the same itemsets are counted level by level up to the length asked.
A url without an explicit verdict is decided by its best fitting rule (confidence, then support, then
fewer tokens, then block); without one it is allowed.

Matching is by inverted index: each rule is filed under its rarest token, urls meet rules over that
token, and the other tokens are then compared.

Scale.  Transactions never leave the executors.  The mined rules are bounded by support: a token set
is frequent in at least ``SUPPORT`` of the labelled urls, and rules hold at most ``TOKENS`` tokens.
The frequent tokens themselves are at most the mean number of tokens of a url over ``SUPPORT``.  Equal
token sets are folded with a count before urls meet rules.  Token sets that hold more than one url in
``SETS`` are fewer than ``SETS``, so verdicts of these are broadcast, and no hot set lands in one task;
those of the others are joined.

Edge cases.  A null url, or one without ``://``, has an empty host and path, no tokens and no rule; it
is allowed.  Without labelled urls nothing is mined.  Rows are judged one by one, also where ids repeat
or are null.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import LOWER, UPPER
from voxloom.session import checked_broadcast, durable


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rule list in its given order.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
SUPPORT, CONFIDENCE = 0.01, 0.9
#: Tokens of a rule at most; items of a basket up to which FP-growth mines; see Scale.
TOKENS, BASKET, SETS = 3, 14, 100_000
_LABEL = "verdict="


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The name and the verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # later conditions stand further out
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url, sorted; empty without a host."""
    labels = F.split(host, r"\.")
    below = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    of_host = F.transform(below, lambda x: F.concat(F.lit("host:"), x))
    dashed = F.filter(below, lambda x: F.contains(x, F.lit("-")))
    parts = F.transform(F.flatten(F.transform(dashed, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("part:"), x))
    top = F.array(F.concat(F.lit("top:"), F.element_at(labels, -1)))
    words = F.transform(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: F.when(x.rlike(r"^[0-9]+$"), F.lit("path:0")).otherwise(F.concat(F.lit("path:"), x)))
    query = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([A-Za-z0-9_.-]+)="), F.lit(1)), lambda x: F.concat(F.lit("query:"), F.lower(x)))
    everything = F.array_sort(F.array_distinct(F.concat(of_host, parts, top, words, F.coalesce(query, F.array().cast("array<string>")))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.filter(everything, lambda x: ~x.isin("host:", "part:", "path:", "top:")))


def grown(baskets: DataFrame, support: float) -> DataFrame:
    """(items, freq) of the frequent itemsets of baskets (items, n), by FP-growth."""
    step = F.lit(1000).cast("long")  # rows again, without one long array for a frequent basket
    rows = baskets.select("items", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step)).alias("start"))
    rows = rows.select("items", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + step, "n") - 1)).alias("_")).select("items")
    return FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(rows).freqItemsets


def levelled(baskets: DataFrame, support: float, total: int, longest: int) -> DataFrame:
    """As ``grown``, but of up to ``longest`` items only, counted level by level: each set grows by later items of its basket."""
    rows = baskets.select(F.array_sort("items").alias("basket"), "n", F.array().cast("array<string>").alias("items"))
    out = None
    for _ in range(longest):
        last = F.element_at("items", -1)
        further = F.filter("basket", lambda x: (F.size("items") == 0) | (x > F.when(F.size("items") > 0, last)))
        rows = rows.select("basket", "n", F.col("items").alias("shorter"), F.explode(further).alias("item"))
        rows = rows.select("basket", "n", F.concat("shorter", F.array("item")).alias("items"))
        level = durable(rows.groupBy("items").agg(F.sum("n").alias("freq")).where(F.col("freq") >= support * total))
        out = level if out is None else out.union(level)
        rows = rows.join(checked_broadcast(level.select("items")), "items", "left_semi").select("basket", "n", "items")
    return out


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, basket: int = BASKET) -> DataFrame:
    """(antecedent, verdict, confidence, support) rules of labelled rows (tokens, verdict, n).

    The miners get each row with its frequent tokens only, and the verdict as an item.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "antecedent array<string>, verdict string, confidence double, support double")
    total = labelled.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return empty
    counts = labelled.select("n", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").alias("n"))
    frequent = counts.where(F.col("n") >= support * total).select("token")
    known = F.array(*(F.lit(r[0]) for r in frequent.collect())).cast("array<string>")
    items = F.concat(F.array_intersect("tokens", known), F.array(F.concat(F.lit(_LABEL), F.col("verdict"))))
    baskets = durable(labelled.select(items.alias("items"), "n").groupBy("items").agg(F.sum("n").alias("n")))
    if baskets.agg(F.max(F.size("items"))).first()[0] <= basket:
        sets = grown(baskets, support).where(F.size("items") <= TOKENS + 1)
    else:
        sets = levelled(baskets, support, total, TOKENS + 1)
    label = F.filter("items", lambda x: F.startswith(x, F.lit(_LABEL)))
    with_label = sets.where(F.size(label) == 1).select(F.array_sort(F.array_except("items", label)).alias("antecedent"), F.substring(label[0], len(_LABEL) + 1, 100).alias("verdict"), F.col("freq").alias("both"))
    alone = sets.where(F.size(label) == 0).select(F.array_sort("items").alias("__antecedent"), "freq")
    rules = with_label.where(F.size("antecedent") > 0).join(alone, F.col("antecedent") == F.col("__antecedent"))
    rules = rules.select("antecedent", "verdict", (F.col("both") / F.col("freq")).alias("confidence"), (F.col("both") / F.lit(float(total))).alias("support")).where(F.col("confidence") >= confidence)
    rules = durable(rules)
    # A rule is needless beside one of fewer tokens, all of them its own, the same verdict and no less confidence.
    general = rules.select(F.col("antecedent").alias("g"), F.col("verdict").alias("gv"), F.col("confidence").alias("gc"), F.explode("antecedent").alias("token")).where(F.size("g") < TOKENS)
    special = rules.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
    needless = special.join(general, "token").where((F.size("g") < F.size("antecedent")) & (F.col("gv") == F.col("verdict")) & (F.col("gc") >= F.col("confidence")) & (F.size(F.array_except("g", "antecedent")) == 0))
    return rules.join(needless.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict): for rows of distinct ``tokens``, the verdict of the best rule that fits, by inverted index."""
    frequency = rules.select(F.explode("antecedent").alias("token"), "support").groupBy("token").agg(F.sum("support").alias("w"))
    filed = rules.withColumn("token", F.explode("antecedent")).join(frequency, "token").groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("w", "token"))["token"].alias("token"))
    hits = urls.select("tokens", F.explode("tokens").alias("token")).join(checked_broadcast(durable(filed)), "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", -F.size("antecedent"), F.col("verdict").alias("verdict")))
    return hits.groupBy("tokens").agg(best["verdict"].alias("__verdict")).withColumnRenamed("tokens", "__tokens")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row (page_id, url)."""
    rows = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, verdict = explicit(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    folded = durable(rows.groupBy("tokens", "ruled").agg(F.count("*").alias("n")))
    mined = mine(folded.where("ruled is not null").select("tokens", F.col("ruled").alias("verdict"), "n"), support, confidence)
    sets = folded.where("ruled is null").groupBy("tokens").agg(F.sum("n").alias("n"))
    found = matched(sets.select("tokens"), mined)
    total = folded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sets.where(F.col("n") * SETS > total).select(F.col("tokens").alias("__hot"))
    hot = F.broadcast(durable(hot.join(found, F.col("__hot") == F.col("__tokens"), "left").select("__hot", F.coalesce("__verdict", F.lit("allow")).alias("__known"))))
    rows = rows.join(hot, F.col("tokens") == F.col("__hot"), "left")
    # What is decided so, or by a rule, needs no partner: it is spread over as many keys that no url has.
    decided = F.col("ruled").isNotNull() | F.col("__known").isNotNull()
    rows = rows.withColumn("__key", F.when(decided, F.array(F.concat(F.lit("decided"), (F.monotonically_increasing_id() % 10_007).cast("string")))).otherwise(F.col("tokens")))
    out = rows.join(found, F.col("__key") == F.col("__tokens"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "__known", "__verdict", F.lit("allow")).alias("verdict"))
