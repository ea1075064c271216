"""The stages of corpus_pipeline.py, one after the other, each against brute force on what the one before kept."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_mix, brute_statistics, edited, roots, shingle_set, words

from voxloom.llm import quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = [" ".join(words(1000 + i, 90)) for i in range(120)]
    texts += [" ".join(w + "###" for w in words(2000 + i, 70)) for i in range(60)]  # what the labels call bad
    texts += [" ".join(edited(texts[k].split(), 300 + k, 0.02)) for k in range(10)]
    texts = [f"Shared banner\n{t}\n  shared BANNER" if k % 3 == 0 else t for k, t in enumerate(texts)]
    texts += [texts[0]] * 4 + ["", None, "few words", "again and again " * 40, " ".join(words(9, 6000))]
    rows = [(k, t, "en", f"s{k % 4}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (7, texts[50], "de", "s1", 1), (None, texts[51], None, "s2", 2), (None, texts[51], None, "s2", 2), (None, " ".join(words(77, 90)), None, None, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, int(not (120 <= k < 180)), 0) for k in range(200)]
    spark.createDataFrame([*labels, (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "minhash_near_dedup", "mixing", "packing"]

    def stage(name, docs):
        out = corpus_pipeline.written(stages[name](spark, docs, tables))
        if name != "packing":
            assert out.columns == docs.columns
        return out

    before = [tuple(r) for r in docs.collect()]
    rules = quality_rules.fit(quality_rules.statistics(docs), labels)
    assert rules

    def rejected(text):
        n, chars, symbols, _, repeated = brute_statistics(text or "")
        values = {"symbol_share": symbols / chars if chars else 0, "repeat_share": repeated / n if n else 0, "mean_word": chars / n if n else 0, "n_words": n}
        return n < 50 or 100 * repeated > 50 * n or any(all((values[c.feature] > c.threshold) == c.above for c in rule) for rule in rules)

    good = stage("quality_rules", docs)
    after = [tuple(r) for r in good.collect()]
    assert Counter(after) == Counter(r for r in before if not rejected(r[1])) and 120 < len(after) < 150

    lined = stage("line_dedup", good)
    folded = [[x.strip(" \t\n\x0b\f\r").lower() for x in r[1].split("\n")] for r in after]
    count = Counter(k for own in folded for k in set(own))
    cut = ["\n".join(x for x, k in zip(r[1].split("\n"), own, strict=True) if not k or count[k] < 10) for r, own in zip(after, folded, strict=True)]
    assert any(c != r[1] for c, r in zip(cut, after, strict=True))
    after = [(r[0], c, r[2], r[3], len(c)) for r, c in zip(after, cut, strict=True)]
    assert Counter(after) == Counter(tuple(r) for r in lined.collect())

    alone = stage("minhash_near_dedup", lined)
    sets = [shingle_set(r[1], 5) for r in after]
    links = defaultdict(set)
    for i in range(len(after)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) > 0:
                links[i].add(j)
                links[j].add(i)
    groups = defaultdict(list)
    for i, root in roots(range(len(after)), links).items():
        groups[root].append(after[i])
    stay = [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in groups.values()]
    after = [tuple(r) for r in alone.collect()]
    assert Counter((r[0], r[1]) for r in after) == Counter((r[0], r[1]) for r in stay) and len(stay) < len(sets) - 10

    mixed = stage("mixing", alone)
    plain, _, _ = brute_mix([(r[0], r[1], r[3]) for r in after])
    served = Counter()
    for r, (_, _, n, laps) in zip(after, plain, strict=True):
        served[r] += sum(2 * v >= n for v in laps)
    after = [tuple(r) for r in mixed.collect()]
    assert Counter(after) == +served

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, fill = Counter(), defaultdict(list)
    for r in after:
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            part = np.array(ids[at : at + 4096], "<u4")
            pieces[r[0], at, len(part), zlib.crc32(part.tobytes())] += 1
    for r in stage("packing", mixed).collect():
        pieces[r.doc_id, r.start, r.length, r.ids_crc32] -= 1
        fill[r.sequence_id].append((r.offset, r.length))
    assert not any(pieces.values())
    for own in fill.values():
        assert sum(n for _, n in own) <= 4096 and sorted(own)[0][0] == 0


def test_run_and_empty_tables(spark, tables, tmp_path):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 90
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
