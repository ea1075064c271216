"""Personal data: fixed patterns, and bootstrapped contextual extraction of what they miss.

Base.  Emails, IPv4 addresses, payment cards (Luhn) and international phone numbers, as leftmost
non-overlapping matches of each kind in the whole text; a match that fails its check is dropped.

Bootstrapping.  Base matches are seeds.  Mentions are the seeds, and what else looks like an
identifier: token runs with five digits or an @ at least, and inside a base match that failed its
check, each run of tokens with a digit each and 8 to 19 digits in all (a phone number that runs into
an address, say); none of them touches a base span.  A mention has lexical patterns: the kind of the
word before it, of the word after it, of the two words before it, of both sides, and its own shape
(letters as a, digits as 9, and whether it fails a base pattern's check or Luhn's).  Its instance is
that shape, and the same without lengths.  Patterns and instances form a bipartite graph with counts.
Starting from seeds (confidence 1 of their kind) and unknown mentions (0), Spark scores it in turns: a
pattern's confidence in a kind is the count-weighted mean of its mentions' (1 of a seed, that of its
shape of an unknown one), a shape's confidence the count-weighted mean over its mentions (1 of a seed,
that of its pattern of an unknown one), by the sort of pattern and the form that say most.  Only
patterns that tell more than the corpus does pass on what their seeds say (others relay what their
unknown mentions are believed): their other mentions are ``DEVIATIONS`` below the number that the
kind's share of the corpus leads to expect.  Of enough support (``LEAST_SEEDS``) and high confidence,
they accept the unknown mentions that stand in them as new identifiers of the kind, whatever their
shape; patterns that do not tell accept only those of a shape of high confidence.  What is accepted
counts 1 for its pattern in the next of ``ROUNDS`` rounds, and shapes that gain confidence lift the
other patterns they stand in.  Of accepted mentions that overlap, the first stays, of those that begin
together the longest.

Scale.  Each text is scanned once, in time linear in its length; what stays are spans and 64-bit
hashes, so no word or shape is cut.  The graph is aggregated by (pattern, shape, kind) on the map side,
so a very common context is one row; it is small beside the corpus and is only ever joined and
aggregated, never collected.

Edge cases.  A null text is empty and has no spans.  Rows are judged one by one, so repeated rows and
null ids have their own results; a corpus without seeds teaches nothing.  Extra columns are not read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import small_batches
from voxloom.session import durable

KINDS = ("email", "ip", "card", "phone")
#: Confidence that patterns and shapes need to accept a mention; seeds that a pattern needs; rounds.
CONFIDENCE, LEAST_SEEDS, ROUNDS = 0.9, 20, 3
#: Standard deviations by which a pattern has fewer other mentions than its share of the corpus would have.
DEVIATIONS = 2.0

# The base patterns.  The possessive and look-behind forms match the same spans as
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
# without trying every start inside a run.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The rest of a run of identifier characters from its first digit or @ on.
_RUN = re.compile(r"[0-9@][A-Za-z0-9@._%+()/-]*")
_RUN_CHARACTERS = _LOCAL | frozenset("@()/")
_DIGIT, _LETTERS, _TOKEN = re.compile(r"[0-9]"), re.compile(r"[^\W\d_]+"), re.compile(r"[^\x20]+")
_DIGITS = str.maketrans("", "", "".join(chr(c) for c in range(0x20, 0x3A) if not 0x30 <= c <= 0x39))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a domain after it, taken back over its local part, but not into the match before."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            last = m.end()


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _ips(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _IP.search(text, at):
        at = m.end()
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.start(), m.end()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start():
            digits = m.group().translate(_DIGITS)
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(m.group().translate(_DIGITS)) <= 15:
                yield m.start(), m.end()


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans (start, end) of each kind in code points, ends exclusive."""
    return [list(_emails(text)) if "@" in text else [], list(_ips(text)), list(_cards(text)), list(_phones(text))]


def shape(value: str) -> str:
    """Letters become a, digits 9; runs of one of them count up to 4 and then as many."""
    value = _LETTERS.sub("a", value)
    return re.sub(r"9{5,}", "9+", _DIGIT.sub("9", value))


def forms(value: str) -> tuple[str, str]:
    """The shape of a mention, marked if a base pattern fits it but not its check, and the shape without lengths."""
    fine, digits = shape(value), re.sub(r"[^0-9]", "", value)
    if 16 <= len(digits) <= 19 and _CARD.fullmatch(value) and not luhn(digits):
        fine += "!"
    if _IP.fullmatch(value) and not any(_ips(value)):
        fine += "!"
    return fine, re.sub(r"9+\+?", "9", fine.rstrip("!"))


def _neighbour(word: str) -> str:
    """A neighbouring word as a pattern sees it: short words as they are, long ones by their shape."""
    word = word.strip(".,;!?|*#$%&<>\"'()").lower()
    return word if 0 < len(word) <= 12 else shape(word)


def _before(text: str, at: int, low: int) -> tuple[str, int]:
    """The word that ends at or before ``at``, and where it begins; words do not reach below ``low``."""
    while at > low and text[at - 1].isspace():
        at -= 1
    end = at
    while at > low and not text[at - 1].isspace():
        at -= 1
    return text[at:end], at


def _after(text: str, at: int, high: int) -> str:
    while at < high and text[at].isspace():
        at += 1
    start = at
    while at < high and not text[at].isspace():
        at += 1
    return text[start:at]


def _dropped(text: str) -> Iterator[tuple[int, int]]:
    """Runs of tokens inside base matches that failed their check: a digit in each token, 8 to 19 in all."""
    for pattern, least, most in ((_PHONE, 8, 15), (_CARD, 0, 19)):
        if pattern is _PHONE and "+" not in text:
            continue
        for m in pattern.finditer(text):
            if least <= len(m.group().translate(_DIGITS)) <= most:
                continue
            tokens = [(t.start(), t.end(), len(_DIGIT.findall(t.group()))) for t in _TOKEN.finditer(text, *m.span())]
            for i, (start, _, _) in enumerate(tokens):
                digits = 0
                for _, end, own in tokens[i:]:
                    digits += own
                    if not own or digits > 19:
                        break
                    if digits >= 8:
                        yield start, end


def _until(seeds: list[tuple[int, int, int]], at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < len(seeds) and seeds[at][0] < end:
        yield seeds[at]
        at += 1


def mentions(text: str, base: list[list[tuple[int, int]]]) -> Iterator[tuple[int, int, int, list[str], str, str]]:
    """(start, end, kind or -1, patterns, shape, shape without lengths) of the seeds and of what else looks like an identifier."""
    seeds = sorted((s, e, k) for k, own in enumerate(base) for s, e in own)
    unknown = set()
    last = 0
    for m in _RUN.finditer(text):
        s, e = m.span()
        while s > last and text[s - 1] in _RUN_CHARACTERS:
            s -= 1
        last = e
        while e > s + 1 and text[e - 1] in ".%+(/-":
            e -= 1
        if "@" in text[s:e] or len(_DIGIT.findall(text, s, e)) >= 5:
            unknown.add((s, e))
    unknown.update(_dropped(text))
    spans, at = seeds.copy(), 0
    for s, e in sorted(unknown):
        while at < len(seeds) and seeds[at][1] <= s:
            at += 1
        # seeds of several kinds may overlap, so those from here on are looked at while they begin before the end
        if not any(b > s for _, b, _ in _until(seeds, at, e)):
            spans.append((s, e, -1))
    spans.sort()
    starts = sorted({s for s, _, _ in spans})
    reached = low = 0
    for s, e, k in spans:
        if reached <= s:  # a neighbouring word ends where another mention does
            low = reached
        reached = max(reached, e)
        left, edge = _before(text, s, min(low, s))
        left2, _ = _before(text, edge, min(low, edge))
        following = bisect.bisect_left(starts, e)
        right = _after(text, e, starts[following] if following < len(starts) else len(text))
        glued = "" if s and not text[s - 1].isspace() else " "
        near = (_neighbour(left) if left else "^") + glued
        after = _neighbour(right) if right else "$"
        fine, coarse = forms(text[s:e])
        yield s, e, k, [near, after, f"{_neighbour(left2) if left2 else '^'} {near}", f"{near}|{after}", fine], fine, coarse


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, mentions) of each row (doc_id, text).

    base: "kind:start:end" joined by commas.  mentions: (start, end, kind, words, shape, coarse), patterns and shapes as hashes.
    """
    import xxhash

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.int32()), ("words", pa.list_(pa.int64())), ("shape", pa.int64()), ("coarse", pa.int64())])

    def hashed(value: str) -> int:
        return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - 2**63

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, found = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                counts.append([len(own) for own in base])
                bases.append(",".join(f"{k}:{s}:{e}" for k, own in zip(KINDS, base, strict=True) for s, e in own))
                found.append([{"s": s, "e": e, "kind": k, "words": list(map(hashed, words)), "shape": hashed(fine), "coarse": hashed(coarse)} for s, e, k, words, fine, coarse in mentions(text, base)])
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(n[:, i]) for i in range(len(KINDS))), pa.array(bases, pa.string()), pa.array(found, pa.list_(item))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "mentions"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {kind}, {counts}, base string, mentions array<struct<s:long,e:long,kind:int,words:array<long>,shape:long,coarse:long>>")


def bootstrap(scanned: DataFrame, confidence: float = CONFIDENCE, least_seeds: int = LEAST_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """(side, word, shape, k) of the unknown mentions that are accepted; a pattern is a side (its place in ``words``) and a hash.

    Tables hold a column for each kind, so that a pattern, a shape or a group of like mentions is one row.
    """
    kinds = range(len(KINDS))
    m = scanned.select(F.explode("mentions").alias("m")).select("m.*")
    sides = m.select("kind", "shape", "coarse", F.posexplode("words").alias("side", "word"))
    graph = durable(sides.groupBy("side", "word", "shape", "coarse", "kind").agg(F.count("*").alias("n")))
    unknown = graph.where("kind < 0").select("side", "word", "shape", "coarse", F.col("n").alias("unknown"))
    counts = {r["kind"]: r["n"] for r in graph.where("side = 0").groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # a row for each kind
    share = [counts.get(k, 0) / max(1, sum(counts.values())) for k in kinds]

    def seeds(name: str) -> list[Column]:
        return [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{name}{k}") for k in kinds]

    each_form = F.explode(F.array_distinct(F.array("shape", "coarse"))).alias("form")
    places = durable(graph.groupBy("side", "word").agg(F.sum("n").alias("total"), *seeds("s"), F.count_if(F.col("kind") < 0).alias("u")).where("u > 0").drop("u"))
    formed = durable(graph.where("side = 0").select("kind", "n", each_form).groupBy("form").agg(F.sum("n").alias("of_form"), *seeds("c"), F.count_if(F.col("kind") < 0).alias("u")).where("u > 0").drop("u"))
    weighed = unknown.select("*", *(F.lit(0.0).alias(f"w{k}") for k in kinds))
    for _ in range(rounds):
        # A pattern's support in a kind is its seeds, and its unknown mentions as far as they are believed.
        believed = weighed.groupBy("side", "word").agg(*(F.sum(F.col("unknown") * F.col(f"w{k}")).alias(f"b{k}") for k in kinds))
        patterns = places.join(believed, ["side", "word"])
        columns = []
        for k in kinds:
            others = F.col("total") * (1 - share[k])  # mentions that are not of the kind, were the pattern like the corpus
            support = F.col(f"s{k}") + F.col(f"b{k}")
            telling = F.col("total") - support <= others - DEVIATIONS * F.sqrt(others)
            columns += [support.alias(f"support{k}"), (support / F.col("total")).alias(f"score{k}"), (telling & (support > 0)).alias(f"telling{k}"), (F.col(f"b{k}") / F.col("total")).alias(f"relayed{k}")]
        met = durable(unknown.join(patterns.select("side", "word", *columns), ["side", "word"]))
        passed = [F.sum(F.col("unknown") * F.when(F.col(f"telling{k}"), F.col(f"score{k}")).otherwise(F.col(f"relayed{k}"))).alias(f"p{k}") for k in kinds]
        parts = met.select("*", each_form).groupBy("side", "form").agg(*passed).join(formed, "form")
        beliefs = durable(parts.groupBy("form").agg(*(F.max((F.col(f"c{k}") + F.col(f"p{k}")) / F.col("of_form")).alias(f"belief{k}") for k in kinds)))
        fine, coarse = (beliefs.select(F.col("form").alias(form), *(F.col(f"belief{k}").alias(f"{form}{k}") for k in kinds)) for form in ("shape", "coarse"))
        held = met.join(fine, "shape").join(coarse, "coarse")
        own = [F.greatest(f"shape{k}", f"coarse{k}") for k in kinds]
        good = [(F.col(f"support{k}") >= least_seeds) & (F.col(f"score{k}") >= confidence) & (F.col(f"telling{k}") | (own[k] >= confidence)) for k in kinds]
        best = F.array_max(F.array(*(F.when(good[k], F.struct(F.col(f"score{k}").alias("score"), F.lit(k).alias("k"))) for k in kinds)))["k"]
        held = held.select("side", "word", "shape", "coarse", "unknown", best.alias("k"), *(own[k].alias(f"own{k}") for k in kinds))
        weights = [F.when(F.col("k").isNull(), F.col(f"own{k}")).when(F.col("k") == k, 1.0).otherwise(0.0).alias(f"w{k}") for k in kinds]
        weighed = durable(held.select("side", "word", "shape", "coarse", "unknown", "k", *weights))
    return weighed.where("k is not null").select("side", "word", "shape", "k")


def detect(docs: DataFrame, confidence: float = CONFIDENCE, least_seeds: int = LEAST_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of each row (doc_id, text); spans are the base ones and the learnt."""
    scanned = durable(scan(docs))
    accepted = bootstrap(scanned, confidence, least_seeds, rounds)
    rows = scanned.withColumn("__row", F.xxhash64("doc_id", "base", "mentions"))
    unknown = rows.select("__row", F.explode(F.filter("mentions", lambda x: x["kind"] < 0)).alias("m")).distinct()
    unknown = unknown.select("__row", "m.s", "m.e", "m.shape", F.posexplode("m.words").alias("side", "word"))
    new = unknown.join(accepted, ["side", "word", "shape"]).groupBy("__row", "s", "e").agg(F.min("k").alias("k"))
    earlier = Window.partitionBy("__row").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("reached", F.coalesce(F.max("e").over(earlier), F.lit(0).cast("long"))).where("s >= reached")
    new = new.groupBy("__row").agg(F.collect_list(F.struct("k", "s", "e")).alias("new"))
    out = rows.join(new, "__row", "left")
    own = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    kinds = F.array(*map(F.lit, KINDS))

    def parsed(x):
        parts = F.split(x, ":")
        return F.struct((F.array_position(kinds, parts[0]) - 1).cast("int").alias("k"), parts[1].cast("long").alias("s"), parts[2].cast("long").alias("e"))

    everything = F.array_sort(F.concat(F.transform(own, parsed), F.col("new")))
    joined = F.array_join(F.transform(everything, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    spans = F.when(F.col("new").isNull(), F.col("base")).otherwise(joined)
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base", spans.alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    found = detect(docs)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
