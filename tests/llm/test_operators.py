"""Each operator on small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import embedding_dedup, html_extract, line_dedup, minhash_dedup, mixing, packing, pii, quality_rules, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string, n int, h string"


def words(seed, n, vocabulary=4000):
    rng = np.random.Generator(np.random.PCG64(seed))
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


def edited(own, seed, share):
    rng = np.random.Generator(np.random.PCG64(seed))
    return [f"x{seed}_{i}" if rng.random() < share else w for i, w in enumerate(own)]


@pytest.fixture(scope="module")
def rows():
    base = [words(i, 120) for i in range(12)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(edited(base[0], 100 + i, 0.03)) for i in range(30)]  # a group of near copies
    texts += [" ".join(edited(base[1], 200 + i, 0.08)) for i in range(10)]  # on both sides of the threshold
    texts += [texts[2]] * 25 + [texts[3].upper()]  # exact copies, and one but for case
    texts += [None, "", " \t\n", "one", "one two", "One two", "a b c", "a b c d", "Ä b\x1cc d e", "  x \n\n X\t\nx", "\n".join(["Same line here"] * 3 + ["own 17"])]
    texts += [f"Top {i}\n  SHARED footer \x0b\nend {i}\n" for i in range(11)] + [f"only nine\n{i}" for i in range(9)]
    texts += [" ".join(words(7, 9000)) + " mail me@home.example.org now"]
    out = [(i, t, "en", f"s{i % 5}" if i % 7 else None, 0, "c", "r", 1, "h") for i, t in enumerate(texts)]
    return [*out, out[4], out[4], (None, texts[5], None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(values):
    return sorted(values, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


# --- 1 -----------------------------------------------------------------------------------------


def test_toxicity(spark, empty):
    rng = np.random.Generator(np.random.PCG64(5))
    data, labels = [], []
    for i in range(900):
        own = words(10_000 + i, int(rng.integers(5, 80)), 600)
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            own.insert(int(rng.integers(0, len(own))), ["bilge", "rotten" + own[0], "vermin"][int(rng.integers(0, 3))])
        data.append((i, " ".join(own)))
        labels.append((i, 1, int(toxic)))
    data += [(1000, None), (1001, ""), (None, "vermin bilge"), (3, data[3][1]), (1002, " ".join(words(3, 30_000, 600)) + " vermin bilge rottenw1")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (2, None, None), (77_777, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(df, labelled).collect()
    assert len(out) == len(data)
    got = {r.doc_id: r for r in out}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert got[1002].predicted == 1 and got[1000].predicted == 0 and got[1001].score == got[1000].score
    assert toxicity.toxicity(empty, labelled).count() == 0
    assert {r.predicted for r in toxicity.toxicity(df, labelled.where("toxic = 9")).collect()} == {0}


# --- 2 -----------------------------------------------------------------------------------------


def brute_links(vectors, threshold):
    links = defaultdict(set)
    for (a, va, la), (b, vb, lb) in itertools.combinations([v for v in vectors if v[1] is not None and v[2] is not None and v[0] is not None], 2):
        va, vb = np.array(va, float), np.array(vb, float)
        if la == lb and len(va) == len(vb) and np.isfinite(va).all() and np.isfinite(vb).all() and va.any() and vb.any():
            if va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= threshold:
                links[a].add(b)
                links[b].add(a)
    return links


def roots(ids, links):
    root = {}
    for i in sorted(ids):
        if i not in root:
            todo, seen = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            root |= dict.fromkeys(seen, i)
    return root


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)  # several shards of each label
    rng = np.random.Generator(np.random.PCG64(1))
    vectors = []
    for label in (0, 1):
        centre = rng.normal(size=16)
        vectors += [(len(vectors) + i, (centre + rng.normal(size=16) * 0.15).tolist(), label) for i in range(60)]
        vectors += [(len(vectors) + i, rng.normal(size=16).tolist(), label) for i in range(200)]
        vectors += [(len(vectors) + i, vectors[-1 - i][1], label) for i in range(5)]
    n = len(vectors)
    vectors += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0, float("nan")] + [0.0] * 14, 1), (n + 3, vectors[0][1], None), (n + 4, [1.0], 0), (n + 5, [float("inf")] * 16, 0), (n + 6, [], 1)]
    schema = "vec_id long, embedding array<float>, label int"
    single = [(i, None if v is None else np.float32(v).tolist(), label) for i, v, label in vectors]
    df = spark.createDataFrame(single, schema).withColumn("unit", F.lit(1)).withColumn("home", F.lit(2)).repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    links = brute_links(single, 0.93)
    root = roots([v[0] for v in vectors], links)
    assert len(got) == len(vectors)
    found, there = sum(r.n_links for r in got.values()), sum(map(len, links.values()))
    assert 0.97 * there <= found <= there
    assert all(got[i].n_links <= len(links[i]) for i in got)
    assert sum(got[i].component_id == root[i] for i in got) >= 0.99 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    audited, real = embedding_dedup.audit(df)
    assert real == pytest.approx(sum(len(links[i]) for i in links if i % 20 == 0), rel=0.05) and audited >= 0.9 * real
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_dense_group_is_searched_whole():
    """Pruning leaves vertices of a dense group that no list names; expansion must reach them all the same."""
    rng = np.random.Generator(np.random.PCG64(5))
    centre = rng.normal(size=64)
    unit = np.concatenate([centre + rng.normal(size=(250, 64)) * 0.2, rng.normal(size=(300, 64))])
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    edges = embedding_dedup.build(unit)
    assert len(np.setdiff1d(np.arange(len(unit)), edges)) > 0
    near = embedding_dedup.mutual(edges)
    for i in range(len(unit)):
        hits = embedding_dedup.within(unit, near, unit[i], np.array([i]), 0.93, embedding_dedup.SLACK)
        assert hits.tolist() and set(hits.tolist()) == set(np.flatnonzero(unit @ unit[i] >= 0.93).tolist())


def test_skipped_shards_hold_no_links():
    """With as many memberships as centres, two vectors within the threshold share the home of one of them."""
    rng = np.random.Generator(np.random.PCG64(6))
    centres = rng.normal(size=(2, 16)) * 0.2
    unit = rng.normal(size=(400, 16))
    unit = np.concatenate([unit, unit + rng.normal(size=unit.shape) * 0.25])
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    own = [embedding_dedup.nearest_shards(centres, u, np.sqrt(2 - 2 * 0.93) / 2).tolist() for u in unit]
    assert {len(o) for o in own} == {1, 2}
    for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)), strict=True):
        assert own[i][0] in own[j] or own[j][0] in own[i]


def test_links_of_dense_groups_share_a_shard():
    """A dense group that eight shards part, and sparse pairs among thirty shards."""
    rng = np.random.Generator(np.random.PCG64(8))

    def shared(unit, k):
        unit = unit / np.sqrt((unit**2).sum(1))[:, None]
        centres = embedding_dedup._centres(unit[rng.permutation(len(unit))[:1000]], k)
        own = [embedding_dedup.nearest_shards(centres, u, np.sqrt(2 - 2 * 0.93) / 2).tolist() for u in unit]
        assert max(map(len, own)) <= embedding_dedup.OVERLAP
        pairs = list(zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)), strict=True))
        return sum(own[i][0] in own[j] or own[j][0] in own[i] for i, j in pairs) / len(pairs)

    assert shared(rng.normal(size=64) * 1.0 + rng.normal(size=(1500, 64)) * 0.27, 8) >= 0.999
    pairs = rng.normal(size=(1000, 64))
    assert shared(np.concatenate([pairs, pairs + rng.normal(size=pairs.shape) * 0.28]), 30) >= 0.97


def test_samples_follow_the_counts():
    e = embedding_dedup
    assert e.sample_sizes({}) == {}
    assert e.sample_sizes({k: 5_000 for k in range(10)}) == dict.fromkeys(range(10), e.SAMPLE)
    assert e.sample_sizes({"hot": 10**9}) == {"hot": 4 * e.CENTRES}
    mixed = e.sample_sizes({"hot": 10**7} | dict.fromkeys(range(1000), 1_000))
    assert mixed["hot"] == 4 * e.CENTRES and set(mixed[k] for k in range(1000)) == {64}
    crowded = e.sample_sizes(dict.fromkeys(range(e.LABELS), 10**6))
    assert set(crowded.values()) == {64}
    for counts in ({0: 10**9, 1: 10**6, 2: 800}, {k: 10**k for k in range(3, 10)}):
        sizes = e.sample_sizes(counts)
        assert sum(sizes.values()) <= e.SAMPLE_ALL + 64 * len(counts)
        assert [sizes[k] for k in sorted(counts, key=counts.get)] == sorted(sizes.values())


# --- 3 -----------------------------------------------------------------------------------------


def brute_mix(rows):
    """(doc_id, source, size, taken by pass) of each row (doc_id, text, source), the sums, and the targets."""
    docs = [(i, s, len(WORD.findall(t or "")), int(hashlib.md5(f"{'' if i is None else i}|{t or ''}".encode()).hexdigest()[:15], 16)) for i, t, s in rows]
    sums = Counter()
    for _, s, n, _ in docs:
        sums[s] += n
    place = {s: k for k, s in enumerate(sorted(sums, key=lambda s: (s is None, s or "")))}
    weight = {s: float((5, 2, 1)[k % 3]) for s, k in place.items()}
    target, free, left = {}, set(sums), float(sum(sums.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= 3 * sums[s]}
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: 3.0 * sums[s] for s in full}
        left -= sum(3 * sums[s] for s in full)
        free -= full
    copies, before = [], Counter()
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][3], docs[k][0] is not None, docs[k][0] or 0, docs[k][2])):
        _, s, n, _ = docs[k]
        copies += [((before[s] + n + lap * sums[s]) / weight[s], place[s], k, lap, n) for lap in range(3) if n]
        before[s] += n
    taken, room = defaultdict(lambda: [0, 0, 0]), sum(sums.values())
    for _, _, k, lap, n in sorted(copies):
        taken[k][lap] = max(0, min(n, room))
        room -= n
    return [(i, s, n, taken[k]) for k, (i, s, n, _) in enumerate(docs)], sums, target


def test_mixing(docs, rows, empty):
    plain, sums, target = brute_mix([(r[0], r[1], r[3]) for r in rows])
    out = mixing.mix(docs).collect()
    assert key([(r.doc_id, r.size, r.taken) for r in out]) == key([(i, n, sum(t)) for i, _, n, t in plain])
    taken = Counter()
    for r in out:
        assert r.source_size == sums[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    longest = max(n for _, _, n, _ in plain)
    assert sum(taken.values()) == sum(sums.values()) and all(abs(taken[s] - target[s]) <= longest for s in sums)
    again = mixing.mix(docs.repartition(5)).collect()
    assert key([(r.doc_id, r.size, r.taken) for r in out]) == key([(r.doc_id, r.size, r.taken) for r in again])
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("doc_id >= 78 and doc_id < 81")).collect()} == {0}  # no words at all
    for some in (docs, docs.where("doc_id is not null and doc_id != 4"), docs.withColumn("key", F.lit(1)).withColumn("__key", F.lit(2)).withColumn("copies", F.lit(3))):
        mixed = mixing.mixed(some)
        assert mixed.columns == some.columns
    served = Counter((r.doc_id, r.text) for r in mixing.mixed(docs).collect())
    expected = Counter()
    for (i, t, *_), (_, _, n, laps) in zip(rows, plain, strict=True):
        expected[i, t] += sum(2 * v >= n for v in laps) if n else 0
    assert served == +expected


# --- 4 -----------------------------------------------------------------------------------------


def test_shortest_pack_first():
    rng = np.random.Generator(np.random.PCG64(3))
    histogram = Counter(rng.integers(1, 100, 5000).tolist())
    placed, sequences = packing.shortest_pack_first(histogram, 100)
    fill, ranks = [[] for _ in range(sequences)], defaultdict(list)
    for size, first, end, sequence, offset in placed:
        ranks[size] += range(first, end)
        for k in range(end - first):
            fill[sequence + k].append((offset, size))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
    for own in fill:
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= 100
    assert sum(s * n for s, n in histogram.items()) > 0.97 * 100 * sequences


def test_encoder_agrees():
    import duckdb
    from voxloom.llm.packing import Encoder
    import public_tokenizers

    own = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    alphabet = "aB'sTrevmld1²½ªºÀÿĂɏİßǅ\u0301Σσςñ.,<|>-_@ \t\n\x0b\x1c\x85\xa0\u2003\u200b日本"
    rng = np.random.Generator(np.random.PCG64(2))
    texts += ["".join(alphabet[i] for i in rng.integers(0, len(alphabet), 12)) for _ in range(4000)]
    texts += ["x<|endoftext|>y", "<|startoftext|>", "it's we'LL 'Re don'T", "".join(map(chr, range(0x250)))]
    for text in texts:
        assert own.ids(text) == own.whole(text), repr(text)


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.pack(docs, length=256).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    expected = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        for start in range(0, len(ids), 256):
            part = np.array(ids[start : start + 256], "<u4")
            expected[r[0], start, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert expected == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    assert packing.pack(empty).count() == 0


# --- 5 -----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- x --><div class="ad">Buy</div><div id="cookie-notice">We use</div>
<article><h1>Head&nbsp;line &lt;1&gt;</h1><p><b>First  part<br>goes
on.<p>Second &amp; last<script>x()</script>.</p><form><input value="a"><label>L</label></form><aside>Side</aside>
<div class="comments"><p>Reader</p></div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article><footer>&copy; F</footer>"""


def test_html(spark):
    assert html_extract.Page(PAGE).text(set()) == "Head line <1>\n\nFirst part goes on.\n\nSecond & last.\n\none\n\ntwo\n\na b"
    rows = [(0, "http://a.org/", PAGE), (1, None, None), (2, "x", ""), (3, "http://a.org/", PAGE), (4, "http://b.org", "plain <p>text</p"), (5, "http://b.org", "<article><p>" + "long word " * 50_000)]
    for i in range(12):  # a host without semantic tags: a block that all pages share, and one of their own
        rows.append((100 + i, f"https://c.org/{i}", f"<body><div><p>Welcome to the site</p><p>All rights kept</p></div><div><p>Story {i} tells of {i * i}</p><p>more of {i}</p></div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for most in (10, 1000):  # the keys joined back, and sent
        got = {r.page_id: r for r in html_extract.extract(pages, most).collect()}
        assert got[0].text == got[3].text and got[0].n_chars == len(got[0].text)
        assert got[1].text == got[2].text == "" and got[4].text == "plain\n\ntext"
        assert len(got[5].text.split()) == 100_000
        for i in range(12):
            assert got[100 + i].text == f"Story {i} tells of {i * i}\n\nmore of {i}"
    assert html_extract.extract(pages.where("page_id < 0")).count() == 0


def test_html_branches_in_articles_are_judged(spark):
    rows = []
    for i in range(12):
        story = f"<p>Story {i} tells of {i * i}</p><p>more of {i} and {i + 7}</p>"
        rows.append((i, f"http://a.org/{i}", f"<main><div class='box'><p>Read us daily</p></div><article>{story}<div class='x'>All rights kept</div></article></main>"))
        rows.append((100 + i, f"http://b.org/{i}", f"<body><article><p>Teaser {i}</p></article><div>{story}</div><div><p>Read us daily</p></div></body>"))
        rows.append((200 + i, f"http://c.org/{i}", f"<body><article class='post has-sidebar'>{story}</article><article class='comment'><p>Reader {i}</p></article></body>"))
        rows.append((300 + i, f"http://d.org/{i}", "<body><article><p>The same page</p><p>again and again</p></article></body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (10, 100_000):
        got = {r.page_id: r.text for r in html_extract.extract(pages, most).collect()}
        for i in range(12):
            story = f"Story {i} tells of {i * i}\n\nmore of {i} and {i + 7}"
            assert got[i] == got[200 + i] == story and got[100 + i] == f"Teaser {i}\n\n{story}"
            assert got[300 + i] == "The same page\n\nagain and again"


def test_html_deep_paths_have_their_own_nodes(spark):
    deep = "".join(f"<div class='{'long name ' * 8}{k}'>" for k in range(12))  # over 400 characters of path
    html = deep + "<div><p>Menu of the site</p></div><div><p>Story {0} tells of {1}</p></div>"
    pages = spark.createDataFrame([(i, f"http://e.org/{i}", html.format(i, i * i)) for i in range(12)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == {i: f"Story {i} tells of {i * i}" for i in range(12)}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><p><a title=don't>Start</a> middle</p><p>end it's</p></article>", "Start middle\n\nend it's"),
        ("<body><script>x</script foo><article><p>Story</p></article>", "Story"),
        ("<div class='layout has-sidebar'><article><p>Story</p></article></div>", "Story"),
        ("<div class='sidebar'><article><p>Story</p></article></div>", "Story"),
        ("<article><section class='legal-analysis'><p>A</p></section><p class='notice-period'>B</p><div class='ad-slot'>C</div><div id=cookie-notice>D</div></article>", "A\n\nB"),
        ("<div class=ad>Buy</div>", ""),
        ("<nav><article>menu</article></nav>", ""),
        ("<article><p title='a>b' x=\"c>d\" y = z>T</p><p a=>U</p><br/><img src=x/>V<a href=/x/>W</a></article>", "T\n\nU\n\nVW"),
        ("<article>x<p title=\"unclosed>rest", "x"),
    ],
)
def test_html_loses_no_text(html, text):
    assert html_extract.Page(html).text(set()) == text


def brute_style_tree(pages):
    """The texts of (url, html) pages, each element's importance worked out page by page."""
    parsed = [(url.split("/")[2], html_extract.Page(html)) for url, html in pages]
    shows, styles, features = Counter(), defaultdict(Counter), defaultdict(Counter)
    for site, page in parsed:
        for path in page.styles.keys() | page.features.keys():
            shows[site, path] += 1
            styles[site, path][tuple(page.styles.get(path, ()))] += 1
            features[site, path].update(page.features.get(path, ()))
    out = []
    for site, page in parsed:
        gone = set()
        for path in {p for _, _, around in page.blocks for p in around}:
            m, own = shows[site, path], page.features.get(path, ())
            if m >= html_extract.LEAST_PAGES and own:
                shares = [n / m for n in styles[site, path].values()]
                presentation = min(1.0, -sum(p * np.log(p) / np.log(m) for p in shares))
                weight = html_extract.DAMPING ** len(shares)
                each = [(1 - weight) * presentation + weight * (1 - np.log(features[site, path][f]) / np.log(m)) if features[site, path][f] > 1 else 1.0 for f in own]
                if np.mean(each) < html_extract.LEAST_IMPORTANCE:
                    gone.add(path)
        out.append(page.text(gone))
    return out


def test_html_agrees_with_a_brute_force_tree(spark):
    rng = np.random.Generator(np.random.PCG64(12))
    boxes = ["<div class='c1'><p>Read us daily</p></div>", "<section><p>All rights kept</p><p>by us</p></section>", "<ul><li>one</li><li>two</li></ul>", "<div><p>Part {k}</p></div>", "<div><p>Own {i}</p><p>word {j}</p></div>"]
    pages = []
    for i in range(60):
        own = [boxes[b].format(i=i, j=i * i, k=i % 4) for b in rng.permutation(len(boxes))[: rng.integers(1, 6)]]
        wrap = ["<body>{}</body>", "<main>{}</main>", "<body><article>{}</article></body>", "<body><article><p>T</p></article>{}</body>"][i % 4]
        pages.append((f"http://h{i % 3}.org/{i}", wrap.format("".join(own))))
    expected = brute_style_tree(pages)
    assert expected != [html_extract.Page(h).text(set()) for _, h in pages]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").withColumn("element", F.lit(1)).withColumn("gone", F.lit(2))
    for most in (3, 100_000):
        assert [r.text for r in html_extract.extract(df, most).orderBy("page_id").collect()] == expected


# --- 6 -----------------------------------------------------------------------------------------


def shingle_set(text, width):
    own = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]
    return {tuple(own[i : i + width]) for i in range(len(own) - width + 1)} if len(own) >= width else {tuple(own)} if own else set()


@pytest.mark.parametrize("block", [512, 8])
def test_minhash(docs, rows, empty, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "BUCKET_BLOCK", 4 * block)
    monkeypatch.setattr(minhash_dedup, "LANDMARKS", 4)
    sets = {r[0]: shingle_set(r[1], 4) for r in rows if r[0] is not None}
    links = defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            links[a].add(b)
            links[b].add(a)
    root = roots(sets, links)
    out = minhash_dedup.near_duplicates(docs, 4).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert minhash_dedup.near_duplicates(empty, 4).count() == 0


def test_deduplicated_by_row(spark, empty):
    a, b, c = (" ".join(words(k, 60)) for k in (71, 72, 73))
    rows = [(1, a), (7, a), (7, b), (9, c), (9, c), (None, c), (None, c), (None, None), (12, ""), (12, ""), (None, " ".join(words(74, 60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("__key", F.lit(2)).withColumn("__gone", F.lit(3)).withColumn("row", F.lit(4))
    got = minhash_dedup.deduplicated(df)
    assert got.columns == df.columns
    assert key([(r.doc_id, r.text) for r in got.collect()]) == key([(1, a), (7, b), (9, c), (None, None), (12, ""), (12, ""), rows[-1]])
    found = Counter((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect())
    assert found == Counter([(1, 1, True), (7, 1, False), (7, 7, True), (9, 9, True), (9, 9, True), (None, None, True), (None, None, True), (None, None, True), (None, None, True), (12, 12, True), (12, 12, True)])
    assert minhash_dedup.deduplicated(empty).count() == 0


def test_multi_index_guarantee():
    rng = np.random.Generator(np.random.PCG64(9))
    a = rng.integers(0, 2**16, (200, minhash_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash_dedup.SYMBOLS, minhash_dedup.DISTANCE, replace=False)
        row[at] += 1
    assert (minhash_dedup.chunk_keys(a) == minhash_dedup.chunk_keys(b)).any(1).all()


# --- 7 -----------------------------------------------------------------------------------------


def test_lines(docs, rows, empty):
    keys = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\f\r")) for x in (t or "").split("\n")]
    count = Counter(k for r in rows for k in set(keys(r[1])))
    expected = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x, k in zip(lines, keys(r[1]), strict=True) if not k or count[k] < 10]
        expected[r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    assert expected == Counter(tuple(r) for r in line_dedup.digest(docs).collect())
    assert any(k[2] for k in expected)
    assert line_dedup.digest(empty).count() == 0
    clashing = docs.withColumn("lines", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("row", F.lit(3)).withColumn("positions", F.lit(4)).withColumn("__text", F.lit(5))
    whole = line_dedup.without_common_lines(clashing)
    assert whole.columns == clashing.columns
    cut = Counter((r[0], "\n".join(x for x, k in zip((r[1] or "").split("\n"), keys(r[1]), strict=True) if not k or count[k] < 10)) for r in rows)
    assert cut == Counter((r.doc_id, r.text or "") for r in whole.collect())


# --- 8 -----------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        ("http://WWW.Example.com/en/1?x=/net/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://blog.example.com/en/", "blog.example.com", "/en/", "example.com/en/", "block"),
        ("https://notexample.com/en/1#top", "notexample.com", "/en/1", "com/", "allow"),
        ("http://com/x", "com", "/x", "com/", "allow"),
        ("http://a.com", "a.com", "", None, "allow"),
        ("http://a.com?q=1", "a.com", "", None, "allow"),
        ("ftp://b.a.net/es/?u=http://com/", "b.a.net", "/es/", "net/es/", "block"),
        ("http://a.net/ES/", "a.net", "/ES/", None, None),
        (None, "", "", None, "allow"),
        ("a.com/en/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("://x.net/fr/y", "x.net", "/fr/y", "net/fr/", "block"),
    ]
    many = [(f"http://h{i % 7}.net/fr/{i}",) for i in range(200)] + [(f"http://h{i % 7}.com/en/{i}",) for i in range(300)]
    many += [("http://h1.org/fr/9",), ("http://h1.org/en/9",)]
    data = [(i, u[0]) for i, u in enumerate([*rows, *many])]
    pages = spark.createDataFrame([*data, data[0]], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    out = url_filter.judge(pages).collect()
    assert len(out) == len(data) + 1
    got = {r.page_id: r for r in out}
    for i, (_, host, path, rule, verdict) in enumerate(rows):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert verdict is None or got[i].verdict == verdict
    assert got[len(data) - 2].verdict == "block" and got[len(data) - 1].verdict == "allow"  # mined: fr is blocked
    assert url_filter.judge(pages.where("page_id < 0")).count() == 0
    assert url_filter.judge(pages.where("url = 'a.com/en/'")).first().verdict == "allow"


def brute_rules(baskets, support, confidence):
    """(tokens, verdict) -> confidence of the rules of baskets (tokens, verdict), without needless ones."""
    both, alone = Counter(), Counter()
    for own, verdict in baskets:
        for size in range(1, url_filter.TOKENS + 1):
            for some in itertools.combinations(sorted(own), size):
                both[some, verdict] += 1
                alone[some] += 1
    rules = {k: n / alone[k[0]] for k, n in both.items() if n >= support * len(baskets) and n / alone[k[0]] >= confidence}
    return {(t, v): c for (t, v), c in rules.items() if not any(v == w and d >= c and set(u) < set(t) for (u, w), d in rules.items())}


def test_url_rules_by_both_miners(spark):
    rng = np.random.Generator(np.random.PCG64(31))
    baskets = []
    for _ in range(400):
        own = {f"t{i}" for i in range(6) if rng.random() < 0.5}
        bad = {"t0", "t1"} <= own or {"t2", "t3", "t4"} <= own
        baskets.append((sorted(own), "block" if bad and rng.random() < 0.97 else "allow"))
    labelled = spark.createDataFrame([(t, v, 1) for t, v in baskets], "tokens array<string>, verdict string, n long")
    expected = brute_rules(baskets, 0.02, 0.9)
    assert any(len(t) == 3 for t, _ in expected) and any(len(t) == 2 for t, _ in expected)
    for basket in (14, 0):
        got = {(tuple(r.antecedent), r.verdict): r.confidence for r in url_filter.mine(labelled, 0.02, 0.9, basket).collect()}
        assert got == pytest.approx(expected)


def test_urls_that_share_many_parameters(spark):
    query = "&".join(f"key{i}=1" for i in range(25))
    urls = [f"http://h{i % 3}.net/{'fr' if i % 2 else 'es'}/{i}?{query}" for i in range(150)] + [f"http://h{i % 3}.com/en/{i}?{query}" for i in range(150)] + [f"http://h1.org/fr/1?{query}"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("tokens", F.lit(1)).withColumn("__key", F.lit(2))
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    assert len(got) == 301 and got[300] == "block"


# --- 9 -----------------------------------------------------------------------------------------

FIXED = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def literal_spans(text):
    out = []
    for kind, pattern in FIXED.items():
        own = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                own.append(m.span())
        out.append(own)
    return out


def test_pii_base():
    rng = np.random.Generator(np.random.PCG64(8))
    pieces = ["a", "B.c", "@", "@x.org", ".", "-", "+", " ", "(", ")", "1", "12", "255", "256", "4111111111111111", "4111 1111-1111 1111", "+1 (234) 555-0199", "10.0.0.1", "me@home.example.org", "é", "_", "\n", "%"]
    for _ in range(3000):
        text = "".join(pieces[i] for i in rng.integers(0, len(pieces), rng.integers(1, 14)))
        assert pii.base_spans(text) == literal_spans(text), text


def test_pii(spark, docs, rows, empty):
    out = pii.detect(docs)
    expected = Counter()
    for r in rows:
        spans = literal_spans(r[1] or "")
        expected[(r[0], *map(len, spans), ",".join(f"{k}:{s}:{e}" for k, own in zip(pii.KINDS, spans, strict=True) for s, e in own))] += 1
    assert expected == Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in out.collect())
    assert pii.digest(empty).count() == 0
    # seeds always follow "addr", so what follows it and looks the same is taken, and the same look elsewhere is not
    texts = [f"{w} addr 10.0.{i}.{i} {w} end" for i, w in enumerate(words(4, 60))]
    texts += ["the addr 300.10.20.30 is", "see part 300.10.20.30 there", "", None, "none"]
    found = {r.doc_id: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found[5].spans == found[5].base and found[5].n_ip == 1
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in found.values())
    assert found[60].base == "" and found[60].spans == "ip:9:21"
    assert found[61].spans == "" and found[62].spans == found[63].spans == ""


def test_pii_unseen_shapes_are_learnt(spark):
    own = words(9, 1000)
    texts = [f"{own[i]} phone: +1 234 555 {1000 + i} {own[i + 1]}" for i in range(400)]
    new = [f"{own[i]} phone: 555/01{i:02}/99 {own[i + 400]}" for i in range(40)]  # no base pattern has this shape
    call = [f"{own[i]} dial 555/02{i:02}/99 {own[i + 500]}" for i in range(25)]  # nor this place a seed
    other = [f"{own[i]} order 48213{i} {own[i + 600]}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *new, *call, *other])), "doc_id long, text string")
    for rounds, learnt in ((1, 40), (3, 40), (6, 65)):  # the shape lifts the second place in later rounds
        found = {r.doc_id: r for r in pii.detect(docs, rounds=rounds).collect()}
        for i, text in enumerate([*new, *call, *other]):
            r, at = found[400 + i], text.find("555/")
            assert r.base == "" and r.spans == (f"phone:{at}:{at + 11}" if i < learnt else "")
    # nothing is learnt from places that are like the rest of the corpus
    alike = [f"{own[i]} id 10.0.{i}.7 {own[i + 1]}" for i in range(200)] + [f"{own[i]} id 48213{i} x" for i in range(5)]
    found = pii.detect(spark.createDataFrame(list(enumerate(alike)), "doc_id long, text string")).where("spans != base")
    assert found.count() == 0


def brute_bootstrap(texts, confidence, least_seeds, rounds):
    """The accepted (side, pattern, shape) -> kind, scored mention by mention."""
    found = [(k, words, fine, coarse) for t in texts for _, _, k, words, fine, coarse in pii.mentions(t, pii.base_spans(t))]
    total = Counter((i, w) for _, words, _, _ in found for i, w in enumerate(words))
    share = {k: n / len(found) for k, n in Counter(f[0] for f in found).items() if k >= 0}
    of_form = Counter(f for _, _, fine, coarse in found for f in {fine, coarse})
    weight, accepted = {}, {}
    for _ in range(rounds):
        support, believed = Counter(), Counter()
        for k, words, fine, _ in found:
            for i, w in enumerate(words):
                if k >= 0:
                    support[i, w, k] += 1
                for kind in share if k < 0 else ():
                    support[i, w, kind] += weight.get((i, w, fine, kind), 0)
                    believed[i, w, kind] += weight.get((i, w, fine, kind), 0)
        score = {key: n / total[key[:2]] for key, n in support.items() if n}
        telling = {key: total[key[:2]] - support[key] <= (o := total[key[:2]] * (1 - share[key[2]])) - pii.DEVIATIONS * o**0.5 for key in score}
        part = Counter()
        for k, words, fine, coarse in found:
            for i, w in enumerate(words):
                for f in {fine, coarse}:
                    for kind in share:
                        key = i, w, kind
                        if k >= 0:
                            part[i, f, kind] += k == kind
                        elif key in score:
                            part[i, f, kind] += score[key] if telling[key] else believed[key] / total[key[:2]]
        belief = {(f, k): max(part[i, f, k] / of_form[f] for i in range(5)) for f in of_form for k in share}
        accepted, weight = {}, {}
        unknown = {(i, w, fine, coarse) for k, words, fine, coarse in found if k < 0 for i, w in enumerate(words)}
        for i, w, fine, coarse in unknown:
            own = {k: max(belief[fine, k], belief[coarse, k]) for k in share}
            good = [(score[i, w, k], k) for k in share if (i, w, k) in score and support[i, w, k] >= least_seeds and score[i, w, k] >= confidence and (telling[i, w, k] or own[k] >= confidence)]
            if good:
                accepted[i, w, fine] = max(good)[1]
            for k in share:
                weight[i, w, fine, k] = own[k] if not good else float(max(good)[1] == k)
    return accepted


@pytest.mark.parametrize("rounds", [1, 3])
def test_pii_scores_by_brute_force(spark, rounds):
    import xxhash

    own, rng = words(19, 3000), np.random.Generator(np.random.PCG64(3))
    texts = [f"{own[i]} {'call at'.split()[i % 2]} +1 234 555 {1000 + i} {own[i + 1]}" for i in range(90)]
    texts += [f"{own[i]} call 555/01{i}/99 {own[i + 9]}" for i in range(10, 18)] + [f"{own[i]} dial 555/02{i}/98 fast" for i in range(10, 34)]
    texts += [f"{own[i]} host 10.0.{i}.7 {'up' if rng.random() < 0.5 else own[i]} host 300.10.{i}.9" for i in range(40)]
    texts += [f"{own[i]} order 4821{int(rng.integers(10, 99))} {own[i]}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.side, r.word, r["shape"]): r.k for r in pii.bootstrap(pii.scan(docs), 0.8, 10, rounds).collect()}
    hashed = lambda v: xxhash.xxh64_intdigest(v) - 2**63
    expected = {(i, hashed(w), hashed(f)): k for (i, w, f), k in brute_bootstrap(texts, 0.8, 10, rounds).items()}
    assert got == expected and len(set(got.values())) >= 1


def test_pii_inside_failed_matches(spark):
    own = words(29, 400)
    texts = [f"{own[i]} +1 (234) 555-{1000 + i} {own[i + 1]}" for i in range(60)]
    texts += [f"{own[7]} +1 (987) 555-4321 10.20.30.40 {own[8]}", "1 2 " * 4000 + "+1 " * 4000]
    clashing = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for name in ("base", "mentions", "spans", "words", "__row", "side"):
        clashing = clashing.withColumn(name, F.lit(name))
    found = {r.doc_id: r for r in pii.detect(clashing).collect()}
    at = texts[60].find("+1")
    assert found[60].n_phone == 0 and found[60].n_ip == 1 and f"phone:{at}:{at + 17}" in found[60].spans.split(",")
    assert found[61].spans == found[61].base


def test_pii_linear():
    long = "a" * 200_000 + " " + "1" * 200_000 + " " + "+1 " * 50_000 + "@" * 50_000
    assert pii.base_spans(long) == [[], [], [], []]
    list(pii.mentions(long, pii.base_spans(long)))


# --- 10 ----------------------------------------------------------------------------------------


def brute_statistics(text):
    own = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(own, own[1:], own[2:], strict=False))
    repeated = set()
    for i in range(len(own) - 2):
        if windows[own[i], own[i + 1], own[i + 2]] > 1:
            repeated |= {i, i + 1, i + 2}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (99_999, 0, 0)], "doc_id long, quality int, toxic int")
    extra = [(5000, "a b c a b c x a b c b c a b", None), (5001, "q " * 300, None), (5002, "x y z\nx y z\n x y z", None)]
    more = docs.select("doc_id", "text", "n").union(spark.createDataFrame(extra, "doc_id long, text string, n int"))
    out = quality_rules.judge(more, labels).collect()
    expected = Counter()
    for i, text in [(r[0], r[1]) for r in rows] + [(i, t) for i, t, _ in extra]:
        n, *rest, repeated = brute_statistics(text or "")
        failed = n < 50 or 100 * repeated > 50 * n
        expected[(i, n, *rest, repeated, failed, not failed)] += 1
    assert expected == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out)
    assert quality_rules.judge(empty, labels).count() == 0
    clashing = docs.withColumn("__a", F.lit(1)).withColumn("g", F.lit(2)).withColumn("w", F.lit(3)).withColumn("row", F.lit(4)).withColumn("extra", F.lit(5)).withColumn("kept", F.lit(6))
    kept = quality_rules.accepted(clashing, labels)
    assert kept.columns == clashing.columns and quality_rules.judge(clashing, labels).count() == len(rows)
    good = Counter()
    for i, text, *_ in rows:
        n, *_, repeated = brute_statistics(text or "")
        good[i, text] += not (n < 50 or 100 * repeated > 50 * n)
    assert +good == Counter((r.doc_id, r.text) for r in kept.collect())


def test_quality_rules_of_two_conditions(spark):
    """Neither condition rejects alone: long words are bad only in documents of few words."""
    data, labels = [], []
    for i in range(900):
        long, short = i % 2 == 0, i % 4 < 2
        own = [w + ("long" * 3 if long else "") for w in words(i, 80 if short else 400)]
        data.append((i, " ".join(own)))
        labels.append((i, int(not (long and short)), 0))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = quality_rules.judge(docs, spark.createDataFrame(labels[:700], "doc_id long, quality int, toxic int")).collect()
    assert all(r.kept == bool(labels[r.doc_id][1]) for r in got)
    assert all(" and " in r.rule for r in got if not r.kept)


def test_quality_rules_are_learnt(spark):
    data, labels = [], []
    for i in range(600):
        own = words(i, 80)
        if i % 5 == 0:
            own = [w + "###" for w in own]
        data.append((i, " ".join(own)))
        labels.append((i, int(i % 5 != 0), 0))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, known).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in got)
    assert all("symbol_share" in r.rule or "mean_word" in r.rule for r in got if not r.kept)
