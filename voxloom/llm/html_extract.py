"""Main text of web pages by site style trees.

The DOMs of a host's pages are merged into one tree (Yi, Liu and Li, 2003).  Its element nodes are the
paths (as running hashes, of any depth) of tags with class and id (and their order among like
siblings); under an element, each distinct sequence of child tags that pages show there is a
presentation style, and each distinct text or link target of a leaf is a content feature.  With m
pages of the host having an element,

    presentation importance = entropy (base m) of the shares of its l styles,
    content importance      = mean over a page's own features of 1 - log_m(pages that have the feature),
    importance              = (1 - g**l) * presentation + g**l * content,          g = 0.9,

so what a site repeats goes towards 0 and what a page alone says towards 1.  A page's branches below
``LEAST_IMPORTANCE`` are removed, in an ``article`` or ``main`` as elsewhere; but headings and paragraphs
of an article are its content, however often a site repeats them, and only boxes around them are
judged there.  Tags are the prior:
elements that name themselves navigation, header or footer, sidebar, notice, advert, form, script,
style or reader comments are noise everywhere.  A class, id or role names an element so if one of its
words consists of such names and of words for boxes alone (``ad-slot``, but not ``has-sidebar`` or
``legal-analysis``); an article is noise only if a whole word is such a name.  Where that would leave
a page without any text though it has an article, names count for nothing.  ``article`` and ``main``
themselves are never removed, only branches in them, and if those would leave nothing, as where a
host repeats one page, all stay.  Of what is left, a page keeps what is in its articles, and the
branches beside them (``div``, ``section``, lists, paragraphs under ``body``) only if they hold more
text, so that the article is not the story.  With fewer than ``LEAST_PAGES`` pages of a host there is
no evidence, and a branch stays.

Scale.  Pages are parsed twice, and no text is shuffled.  The first pass emits hashes of branches,
styles and features, added up per batch before Spark adds them up by key; a host may hold any share
of all pages.  What the second pass needs is the set of low-importance (host, element, feature) keys.
It is counted: up to ``MOST_KEYS`` it is sent to the executors, beyond that it is joined back by page.

Edge cases.  Null and empty pages give an empty text.  Unclosed and stray tags are allowed.  A null
url, or one without ``://``, belongs to one nameless host.  Pages are extracted row by row, so repeated
rows give repeated results.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import small_batches
from voxloom.session import durable

DAMPING, LEAST_IMPORTANCE, LEAST_PAGES = 0.9, 0.5, 4
#: Keys of low-importance features that are sent to executors at most (8 bytes each).
MOST_KEYS = 2_000_000

# HTML element names by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe".split())
NOISE = set("nav header footer aside form script style noscript template iframe svg canvas object select option button textarea title head menu dialog fieldset label input".split())
CONTENT = set("article main".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: An open element of these ends when the next of the listed ones begins.
ENDS = {"p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words in a class, id or role that name noise.
NOISE_WORDS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice alert popup modal newsletter subscribe signup login share sharing social related recommended comment comments respond reply replies disqus widget toolbar pagination pager copyright legal disclaimer".split())

#: Words for boxes, which say nothing about what is in one.
BOX_WORDS = set("area bar block box button container form group inner item items left link links list outer panel right row section slot text title top bottom unit widget wrap wrapper zone".split())

_VALUE = r"(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)"
#: Comments, declarations and tags; a quote opens a value only after an equals sign.
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?)?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))?)?+", re.S)
_WORDS = re.compile(r"[A-Za-z]+")


def names_noise(value: str) -> bool:
    """Whether a word of a class, id or role consists of names of noise, one at least, and of words for boxes."""
    for word in value.split():
        parts = _WORDS.findall(word)
        if not NOISE_WORDS.isdisjoint(parts) and all(p in NOISE_WORDS or p in BOX_WORDS for p in parts):
            return True
    return False


class Page:
    """One parsed page: its blocks of text, each with the branch it stands in, and what its branches show.

    branches: key of the element -> (styles: child tags, features: texts and links)
    blocks: (text, in an article, branch keys from the outermost neutral one in)
    """

    __slots__ = ("blocks", "features", "styles")

    def __init__(self, source: str):
        if self._parse(source, True) and not self.blocks:  # names of wrappers hide an article and all else
            self._parse(source, False)

    def _parse(self, source: str, by_name: bool) -> bool:
        """Parse the page; whether an element that is noise only by a name has an article in it."""
        import xxhash

        hidden = False
        self.blocks: list[tuple[str, bool, tuple[str, ...]]] = []
        self.features: dict[str, set[str]] = {}
        self.styles: dict[str, list[str]] = {}
        # an open element: tag, path, noise, in content, neutral branches around, children by label
        stack: list[tuple[str, str, bool, bool, tuple[str, ...], dict[str, int]]] = [("", "", False, False, (), {})]
        texts: list[str] = []
        at, end = 0, len(source)

        def text(value: str) -> None:
            _, path, noise, content, _, _ = stack[-1]
            if not noise:
                texts.append(_html.unescape(value) if "&" in value else value)
            elif not content and value.strip():
                self.features.setdefault(path, set()).add(value.strip())

        def block() -> None:
            if texts:
                value = " ".join("".join(texts).split())
                texts.clear()
                if value:
                    _, path, _, content, around, _ = stack[-1]
                    self.blocks.append((value, content, around))
                    for key in around or (path,):
                        self.features.setdefault(key, set()).add(value)

        while at < end:
            tag = _TAG.search(source, at)
            if tag is None:
                text(source[at:])
                break
            if tag.start() > at:
                text(source[at : tag.start()])
            at = tag.end() if tag.end() > tag.start() else tag.start() + 1
            name = tag.group(2)
            if name is None:
                continue
            name = name.lower()
            if tag.group(1):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == name:
                        if name in BLOCK:
                            block()
                        del stack[depth:]
                        break
                    if stack[depth][0] in ("article", "main", "body") and name not in ("body", "html"):
                        break  # a stray end does not leave the article
                if name in ("td", "th"):
                    texts.append(" ")
                continue
            if name == "br" or name in ("td", "th", "img"):
                texts.append(" ")
            if name in BLOCK:
                block()
            while len(stack) > 1 and name in ENDS.get(stack[-1][0], ()):
                del stack[-1]
            if name == "p":  # an unclosed inline element ends with the paragraph before
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        del stack[depth:]
                        break
                    if stack[depth][0] in BLOCK:
                        break
            _, path, noise, content, around, children = stack[-1]
            attributes = tag.group(3)
            label, bad = name, name in NOISE
            if "=" in attributes:
                for m in _ATTRIBUTE.finditer(attributes):
                    kind, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
                    if kind in ("class", "id", "role"):
                        value = value.lower()
                        label += "." + value
                        if by_name and not bad and name not in ("html", "body", "main"):
                            bad = not NOISE_WORDS.isdisjoint(value.split()) if name == "article" else names_noise(value)
                    elif kind == "href" and noise and not content and name == "a":
                        self.features.setdefault(path, set()).add(value)
            hidden = hidden or noise and name in CONTENT
            if not (content and noise):
                self.styles.setdefault(path, []).append(name)
                if not noise and name in BLOCK:  # siblings of one label are told apart by their order
                    children[label] = children.get(label, -1) + 1
                    label = f"{label}#{children[label]}"
                if name in BLOCK or not content:
                    path = xxhash.xxh64_hexdigest(f"{path}/{label}".encode("utf-8", "surrogatepass"))
            if name in VOID:
                continue
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                continue
            inside = content or name in CONTENT and not noise and not bad
            if name in CONTENT and inside and not noise:
                around = ()
            elif not noise and not bad and name in BLOCK and name not in ("html", "body") and not (content and name in PROSE):
                around = (*around, path)
            content = inside
            stack.append((name, path, noise or bad, content, around, {}))
        block()
        return hidden

    def text(self, low: set[str]) -> str:
        """The main text, where ``low`` has the branches of low importance."""
        kept = [(t, content) for t, content, around in self.blocks if low.isdisjoint(around)]
        size = sum(len(t) for t, content in kept if content)
        if size == 0 and any(content for _, content, _ in self.blocks):  # all in the articles is repeated: the prior decides
            kept = [(t, content) for t, content, _ in self.blocks if content]
        elif size >= sum(len(t) for t, content in kept if not content):
            kept = [(t, content) for t, content in kept if content]
        return "\n\n".join(t for t, _ in kept)


def _hash(value: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def host(url: Column) -> Column:
    """The host of a url in lower case; empty for null and without ``://``."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def _keys(site: str, page: Page) -> Iterator[tuple[int, int, int]]:
    """(element, kind, value) hashes of a page: its elements (kind 0), their styles (1) and features (2)."""
    for path in page.styles.keys() | page.features.keys():
        element = _hash(f"{site}\n{path}")
        yield element, 0, 0
        yield element, 1, _hash(" ".join(page.styles.get(path, ())))
        for feature in page.features.get(path, ()):
            yield element, 2, _hash(feature)


def site_statistics(pages: DataFrame) -> DataFrame:
    """(element, kind, value, n): how many pages show it, over all pages (host, html)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for site, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.update(_keys(site, Page(source.as_py() or "")))
            elements, kinds, values = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays([_signed(list(elements)), pa.array(kinds, pa.int32()), _signed(list(values)), pa.array(list(counts.values()), pa.int64())], names=["element", "kind", "value", "n"])

    raw = pages.select("host", "html").mapInArrow(counted, "element long, kind int, value long, n long")
    return raw.groupBy("element", "kind", "value").agg(F.sum("n").alias("n"))


def importances(statistics: DataFrame) -> DataFrame:
    """(element, presentation, weight, m) of each element of enough pages; weight is g**l, the content's share."""
    m = statistics.where("kind = 0").select("element", F.col("n").alias("m")).where(F.col("m") >= LEAST_PAGES)
    p = F.col("n") / F.col("m")
    entropy = F.sum(-p * F.log(p) / F.log("m"))
    styles = statistics.where("kind = 1").join(m, "element").groupBy("element", "m").agg(entropy.alias("presentation"), F.pow(F.lit(DAMPING), F.count("*")).alias("weight"))
    return styles.select("element", F.least(F.col("presentation"), F.lit(1.0)).alias("presentation"), "weight", "m")


def low_features(statistics: DataFrame) -> DataFrame:
    """(key, importance): features by the importance that they alone would give their element's branch on a page.

    Only those that several pages share are there; any other feature counts 1 - 0 towards the content.
    """
    nodes = importances(statistics)
    shared = statistics.where("kind = 2 and n > 1").join(nodes, "element")
    content = F.lit(1.0) - F.log("n") / F.log("m")
    value = (F.lit(1.0) - F.col("weight")) * F.col("presentation") + F.col("weight") * content
    return shared.select(F.xxhash64("element", "value").alias("key"), value.cast("float").alias("importance"))


def _branch_rows(site: str, page: Page) -> list[tuple[str, list[tuple[int, int]]]]:
    """The branches whose blocks might be removed, with their feature keys."""
    out = []
    for path in {key for _, _, around in page.blocks for key in around}:
        element = _hash(f"{site}\n{path}")
        out.append((path, [(element, _hash(f)) for f in page.features.get(path, ())]))
    return out


def spark_hash(element: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(element, value) of two long columns: XXH64 of 8 bytes with the seed 42, chained."""
    import xxhash

    out = np.empty(len(element), np.int64)
    for i, (a, b) in enumerate(zip(element.tolist(), value.tolist(), strict=True)):
        seed = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), seed=42)
        out[i] = np.uint64(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), seed=seed)).astype(np.int64)
    return out


def extract(pages: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """(page_id, url, text, n_chars) of each row (page_id, url, html)."""
    spark = pages.sparkSession
    small_batches(spark, 256)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    statistics = durable(site_statistics(rows))
    low = durable(low_features(statistics).where(F.col("importance") < 1.0))
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string"

    if low.limit(most_keys + 1).count() <= most_keys:
        known = low.toArrow()
        order = np.argsort(known.column("key").to_numpy())
        shared = spark.sparkContext.broadcast((known.column("key").to_numpy()[order], known.column("importance").to_numpy()[order]))

        def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, values = shared.value
            for batch in batches:
                texts = []
                for site, source in zip(batch.column(3).to_pylist(), batch.column(2), strict=True):
                    page = Page(source.as_py() or "")
                    gone = set()
                    for path, features in _branch_rows(site, page):
                        if features and len(keys):
                            both = np.array(features, np.uint64).view(np.int64)
                            own = spark_hash(both[:, 0], both[:, 1])
                            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                            if np.where(keys[at] == own, values[at], 1.0).mean() < LEAST_IMPORTANCE:
                                gone.add(path)
                    texts.append(page.text(gone))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        out = rows.select("page_id", "url", "html", "host").mapInArrow(extracted, schema)
    else:
        out = _extract_joined(rows, low, schema)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _extract_joined(rows: DataFrame, low: DataFrame, schema: str) -> DataFrame:
    """As the second pass, but the importances come to the pages by joins: for any number of keys."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for page, site, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for path, features in _branch_rows(site, Page(source.as_py() or "")):
                    for element, value in features:
                        for column, item in zip(out, (page, path, element, value), strict=True):
                            column.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), _signed(out[2]), _signed(out[3])], names=["page", "path", "element", "value"])

    rows = rows.withColumn("page", F.xxhash64("host", "html"))
    features = rows.select("page", "host", "html").mapInArrow(listed, "page long, path string, element long, value long").distinct()
    judged = features.withColumn("key", F.xxhash64("element", "value")).join(low, "key", "left")
    gone = judged.groupBy("page", "path").agg(F.avg(F.coalesce("importance", F.lit(1.0))).alias("importance")).where(F.col("importance") < LEAST_IMPORTANCE)
    gone = gone.groupBy("page").agg(F.collect_set("path").alias("gone"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source.as_py() or "").text(set(paths.as_py() or ())) for source, paths in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.join(gone, "page", "left").select("page_id", "url", "html", "gone").mapInArrow(extracted, schema)


