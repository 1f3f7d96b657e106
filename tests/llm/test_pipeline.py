"""The pipeline against a chain of brute-force stages."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_groups import WORD, brute_classes, brute_cuts
from test_scans import base, brute_scores, hits

import corpus_pipeline
from tributary.llm import chunking, cube, minhash, quality
from tributary.llm.queries import table

SF = "/root/testdata/sf0.01"


def brute_quality(spark, docs):
    target, held, bad = quality.trusted_ids(table(spark, SF, "labels"))
    scores = brute_scores([(k, t) for k, t, _, _ in docs], set(target))
    failed = {k: base(t)[5] for k, t, _, _ in docs}
    good, poor = (sorted(scores[k] for k in scores if k in ids and not failed[k]) for ids in (set(held), set(bad)))
    low = good[int(len(good) * quality.LOST)]
    threshold = min((low + poor[int(len(poor) * (1 - quality.PASSED)) - 1]) / 2, low - (good[len(good) // 2] - low) / 4)
    return [d for d in docs if not failed[d[0]] and scores[d[0]] >= threshold]


def brute_dedup(docs):
    first = {k for k, c, _, _ in brute_classes([(k, t) for k, t, _, _ in docs]) if k == c}
    return [d for d in docs if d[0] in first]


def brute_strip(docs):
    """Words left of each text."""
    gone = brute_cuts([(k, t, key) for k, t, _, key in docs])
    return [(k, [w for i, w in enumerate(WORD.findall(t or "")) if i not in own], s) for (k, t, s, _), own in zip(docs, gone, strict=True)]


def test_pipeline_against_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "source", chunking.document_key("doc_id", "text").alias("key"))
    rows = [tuple(r) for r in docs.collect()]
    want = brute_strip(brute_dedup(brute_quality(spark, rows)))

    frame, seen = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        frame = stage(spark, frame, SF).cache()
        seen.append(frame.count())
    got = {r.doc_id: r for r in frame.collect()}
    assert {k: w for k, w, _ in want} == {k: WORD.findall(r.text or "") for k, r in got.items()}
    assert seen[0] > seen[1] == seen[2] and any(r.n_chars != len(r.text) for r in got.values()) is False

    clean = corpus_pipeline.decontaminate(spark, frame, SF)
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    before = hits([(k, r.text) for k, r in got.items()], items)
    after = {r.doc_id: r.text for r in clean.collect()}
    assert any(h[5] for h in before) and not any(h[5] for h in hits(list(after.items()), items))
    for k, n, hit, *_ in before:
        left = len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", after[k]))
        assert left == n - hit if hit else after[k] == got[k].text

    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in out}.items() <= after.items()
    source = {k: s for k, _, s in want}
    total = Counter()
    for k, t in after.items():
        total[source[k]] += len(WORD.findall(t))
    goal, taken = cube.targets(list(total.items())), Counter()
    for r in out:
        assert 1 <= r.copies <= 3
        taken[r.source] += r.copies * len(WORD.findall(r.text))
    assert all(taken[s] == pytest.approx(g, rel=0.05) for s, g in goal.items())


def test_clashing_names(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}x{k % 13}" for k in range(80)), "en", None if i % 2 else "a", 5, "x", 1, None, "c") for i in range(12)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string, n_chars long, _key string, _cut_words int, _lost string, copies string")
    for f, n in ((minhash.keep_one, 12), (chunking.strip_repeats, 15), (cube.materialise, None)):
        out = f(docs)
        assert out.columns == docs.columns and {r._key for r in out.collect()} == {"x"}
        assert n is None or out.count() == n


def test_pipeline_edges(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    words = lambda i, n=90: " ".join(f"w{(i * 7919 + k * 31) % 997}x{(i + k * k) % 83}" for k in range(n))
    rows = [(i, words(i), "en", f"s{i % 2}", 5, "e") for i in range(20)]
    odd = [(None, None, None, None, None, None), (50, None, "en", "a", 0, "e"), (51, "", None, None, 0, None), (52, "short text", "en", "s0", 10, "e"), (None, words(60), None, None, None, "e"), (53, words(3), None, "s1", 1, "e")]
    frames = {"documents": (rows + rows[:4] + odd, kinds), "labels": ([(i, 1, 0) for i in range(12)] + [(None, None, None)], "doc_id long, quality int, toxic int"), "benchmark": ([(1, words(2)[:60]), (None, None)], "item_id long, text string")}
    for empty in (False, True):
        for name, (data, schema) in frames.items():
            spark.createDataFrame([] if empty else data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{empty}/{name}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{empty}")
        assert out.columns == [*corpus_pipeline.COLUMNS, "copies"]
        got = out.collect()
        if empty:
            assert got == []
            continue
        ids = [r.doc_id for r in got]
        assert len(ids) == len(set(ids)) and set(ids) <= {*range(20), None} and len(ids) > 10
        assert all(len(r.text) <= len(words(r.doc_id if r.doc_id is not None else 60)) for r in got)


def test_pipeline_learns_from_every_label(spark, tmp_path):
    by_hash = lambda lo, hi: [r.id for r in spark.range(lo, hi).orderBy(F.xxhash64("id"), "id").collect()]
    good, bad = by_hash(0, 100_000), by_hash(100_000, 105_000)
    # None of these is among the 22 000 trusted ids of least hash, or the 2 000 bad ones; the first hundred are held back.
    kept, gone = good[22_000:22_100] + good[25_000:25_300], bad[2_000:2_100]
    text = lambda i: " ".join(f"{'good' if i < 100_000 else 'bad'}{(i * 31 + k * k) % 211}" if k % 4 else f"all{(i + k) % 97}" for k in range(80))
    spark.createDataFrame([(i, text(i), "en", "s", 5) for i in kept + gone], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(105_000).selectExpr("id doc_id", "int(id < 100000) quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id for r in out.collect()} == set(kept)
