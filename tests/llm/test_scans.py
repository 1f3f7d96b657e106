"""Row-wise operators against brute force: decontamination, quality counts, licences, language ID."""

import hashlib
import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tributary.llm import fm_index, langid, licences, quality
from tributary.llm.queries import table
from tributary.llm.textkit import LETTERS_DIGITS, NON_SPACE, Powers, blocks

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hits(docs, items):
    windows = defaultdict(set)
    for key, text in items:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        width = min(10, len(words))
        for i in range(len(words) - width + 1) if words else ():
            windows[tuple(words[i : i + width])].add("" if key is None else str(key))
    widths = {len(w) for w in windows}
    out = []
    for key, text in docs:
        words = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for width in widths:
            for i in range(len(words) - width + 1):
                if got := windows.get(tuple(words[i : i + width])):
                    found |= got
                    hit |= set(range(i, i + width))
        out.append((key, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1é\n \x1c-ß 😀", max_size=30), max_size=6))
def test_words_and_hashes(texts):
    column = pa.array([*texts, None], pa.string())
    for member, pattern in ((NON_SPACE, WORD), (LETTERS_DIGITS, ITEM_WORD)):
        found = []
        for _, _, block in blocks(column, Powers(), most=16):
            starts, ends, firsts = block.words(member)
            for r in range(block.rows):
                found.append([block.text(s, e) for s, e in zip(starts[firsts[r] : firsts[r + 1]], ends[firsts[r] : firsts[r + 1]], strict=True)])
        want = [pattern.findall(t if member is NON_SPACE else t) for t in [*texts, ""]]
        if member is LETTERS_DIGITS:
            want = [[w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)] for t in [*texts, ""]]
        assert found == want


def test_fm_index_finds_every_occurrence():
    rng = random.Random(5)
    for _ in range(30):
        sequence = np.array([rng.choice([0, 1, 2, 3, 3]) for _ in range(rng.randint(1, 90))] + [0], dtype=np.int64)
        index = fm_index.FMIndex(sequence, 3)
        for width in (1, 2, 3, 5):
            patterns = np.array([[rng.randint(1, 3) for _ in range(width)] for _ in range(12)], dtype=np.int64)
            lo, hi = index.search(patterns)
            for p, (a, b) in enumerate(zip(lo, hi, strict=True)):
                want = [i for i in range(len(sequence) - width + 1) if (sequence[i : i + width] == patterns[p]).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_on_the_tables(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    want = hits([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted(map(tuple, fm_index.find_hits(docs, items).collect())) == sorted(want)
    assert any(w[5] for w in want)


def test_decontamination_edges(spark, monkeypatch):
    long = " ".join(f"w{i % 7}" for i in range(5000))
    items = [(1, "One two"), (2, None), (3, "..."), (4, " ".join(f"w{i % 7}" for i in range(12))), (None, "free"), (5, "two two"), (5, "éa")]
    docs = [(1, "one TWO three"), (1, "one TWO three"), (None, "two two two"), (2, None), (3, ""), (4, long), (5, "free ÉA éa"), (6, "one\x00two")]
    frame = spark.createDataFrame([(d, t, None, None, 0, "x") for d, t in docs], SCHEMA + ", n_words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(map(tuple, fm_index.find_hits(frame, bench).collect()), key=key) == sorted(hits(docs, items), key=key)
    phrases = fm_index.Phrases(items)
    monkeypatch.setattr(fm_index, "SHARD_WORDS", 64)
    judged = fm_index.Judged(pa.array([t for _, t in docs], pa.string()), phrases, Powers())
    assert judged.n_hit.tolist() == [h[2] for h in hits(docs, items)]
    empty = spark.createDataFrame([], SCHEMA)
    assert fm_index.find_hits(empty, bench).count() == 0
    assert all(r.n_items == 0 for r in fm_index.find_hits(frame, bench.limit(0)).collect())


def test_removal_leaves_no_phrase(spark):
    item = " ".join(f"k{i}" for i in range(10))
    nested = " ".join(f"k{i}" for i in range(5)) + f" {item} " + " ".join(f"k{i}" for i in range(5, 10))
    rows = [(1, f"Start here. {item} and on.", "en", "a", 1), (2, nested, "en", "a", 1), (3, "clean", "en", "a", 5), (4, None, None, None, None)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r for r in fm_index.remove_hits(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert out[1].text == "Start here. and on." and out[1].n_chars == len(out[1].text)
    assert out[2].text == "" and out[3].text == "clean" and out[4].text is None
    assert out[3].n_chars == 5


def test_items_in_groups_give_the_result_of_one(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 400)}"
    items = [(i % 25 if i else None, " ".join(word() for _ in range(rng.choice([3, 10, 14, 25])))) for i in range(60)] + [(61, None), (62, "")]
    piece = lambda: " ".join(word() for _ in range(rng.randint(0, 12))) + " " + (rng.choice(items)[1] or "")
    docs = [(i % 40, "\n".join(piece() for _ in range(rng.randint(0, 5)))) for i in range(80)] + [(None, None), (None, ""), (3, items[1][1] + " " + items[2][1])]
    half, other = items[5][1].split(), items[6][1]
    docs.append((90, " ".join([*half[:2], other, *half[2:]])))
    rows = [(d, t, None, None, None if t is None else len(t), "x") for d, t in docs]
    frame = spark.createDataFrame(rows, SCHEMA + ", _row string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple(map(str, r))
    whole = sorted(map(tuple, fm_index.remove_hits(frame, bench).collect()), key=key)
    assert sorted(map(tuple, fm_index.find_hits(frame, bench).collect()), key=key) == sorted(hits(docs, items), key=key)
    monkeypatch.setattr(fm_index, "GROUP_BYTES", 1500)
    assert len(fm_index.phrase_groups(bench)) > 2
    assert sorted(map(tuple, fm_index.find_hits(frame, bench).collect()), key=key) == sorted(hits(docs, items), key=key)
    assert sorted(map(tuple, fm_index.remove_hits(frame, bench).collect()), key=key) == whole
    assert not any(h[5] for h in hits([r[:2] for r in whole], items))
    assert fm_index.find_hits(frame.limit(0), bench).count() == fm_index.remove_hits(frame.limit(0), bench).count() == 0


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    many = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {k for i in range(len(words) - 2) if many[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed)


def brute_scores(docs, target):
    """Log-likelihood ratios with plain counters over the same buckets."""
    raw, good, grams = Counter(), Counter(), {}
    for key, text in docs:
        own = []
        for _, _, block in blocks(pa.array([text or ""]), Powers()):
            hashes, firsts = quality.block_words(block)
            for h in hashes.tolist():
                own.append(h % quality.BUCKETS)
            pairs, _ = quality.runs_of(hashes, firsts, 2)
            own += [p % quality.BUCKETS for p in pairs.tolist()]
        grams[key] = own
        raw.update(own)
        if key in target:
            good.update(own)

    scale = sum(good.values()) / sum(raw.values())
    k = quality.SMOOTHING
    return {key: sum(np.log((good[b] + k) / (raw[b] * scale + k)) for b in own) / max(len(own), 1) for key, own in grams.items()}


def test_quality_on_the_tables(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    target, held, bad = quality.trusted_ids(labels)
    scores = brute_scores(rows, set(target))
    good, poor = (sorted(scores[k] for k, text in rows if k in ids and not base(text)[5]) for ids in (set(held), set(bad)))
    low = good[int(len(good) * quality.LOST)]
    threshold = min((low + poor[int(len(poor) * (1 - quality.PASSED)) - 1]) / 2, low - (good[len(good) // 2] - low) / 4)
    for key, text in rows:
        r = out[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)
        assert r.score == pytest.approx(scores[key], abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= threshold)
    known = {r.doc_id: r.quality for r in labels.collect()}
    passed = [k for k, r in out.items() if not r.base_failed and k in known]
    assert all(out[k].kept for k in passed if known[k])
    assert sum(not out[k].kept for k in passed if not known[k]) >= 0.7 * sum(not known[k] for k in passed)


def test_quality_edges(spark):
    texts = [None, "", " \n\t", "a", "x y\nx y\n\nx y", "#*$%&|<> é😀", "one two three " * 40, " ".join(f"w{i}" for i in range(60)), "w " * 100_000]
    rows = [(i, t, None, None, None, "clash") for i, t in enumerate(texts)] + [(None, texts[7], None, None, None, "clash")]
    frame = spark.createDataFrame(rows, SCHEMA + ", score string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (None, 1, 0), (99, 1, None)], "doc_id long, quality int, toxic int")
    for judged in (quality.judge(frame, labels), quality.judge(frame, labels.limit(0))):
        out = {r.doc_id: r for r in judged.collect()}
        for i, t in enumerate(texts):
            assert (out[i].n_words, out[i].word_chars, out[i].n_symbols, out[i].n_dup_lines, out[i].n_repeat_words, out[i].base_failed) == base(t)
        assert out[7].kept and out[None].kept and not out[1].kept
    assert quality.judge(frame.limit(0), labels).count() == 0
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {7, None}


def test_quality_learns_from_every_label(spark, tmp_path, monkeypatch):
    n, poor = 24_000, 3_000
    text = lambda i: " ".join((f"{'bad' if i >= n else 'good'}{(i * 31 + k * k) % 211}" if k % 4 else f"all{(i + k) % 97}") for k in range(52))
    rows = [(i, text(i), None, None, None) for i in range(0, n + poor, 60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents")
    spark.range(n + poor).selectExpr("id doc_id", f"int(id < {n}) quality", "0 toxic").write.parquet(f"{tmp_path}/labels")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("documents", "labels"))
    target, held, bad = (list(x) for x in quality.trusted_ids(labels))
    assert sorted(target + held) == list(range(n)) and len(held) == n // 4 and sorted(bad) == list(range(n, n + poor))
    scores = brute_scores([r[:2] for r in rows], set(target))
    passed = {k for k, t, *_ in rows if not base(t)[5]}
    good, low_ones = (sorted(scores[k] for k in passed.intersection(ids)) for ids in (held, bad))
    low = good[int(len(good) * quality.LOST)]
    threshold = min((low + low_ones[int(len(low_ones) * (1 - quality.PASSED)) - 1]) / 2, low - (good[len(good) // 2] - low) / 4)
    for few_ids, few_keys in ((quality.FEW_IDS, quality.FEW_KEYS), (0, 0)):
        monkeypatch.setattr(quality, "FEW_IDS", few_ids)
        monkeypatch.setattr(quality, "FEW_KEYS", few_keys)
        out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
        assert all(out[k].score == pytest.approx(s, abs=1e-9) for k, s in scores.items())
        kept = {k for k, r in out.items() if r.kept}
        assert kept == {k for k in passed if scores[k] >= threshold} and len(kept) > 300
        assert {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()} == kept


@pytest.mark.parametrize("few", [0, 7, 10**6])
def test_exact_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW_KEYS", few)
    own = random.Random(5)
    floats = {g: [own.choice([0.0, -0.0, -1.5, own.gauss(0, 1), own.gauss(0, 1e-9), own.gauss(0, 1e9)]) for _ in range(300)] for g in (True, False)}
    keys = {g: quality.in_order((np.array(x) + 0.0).view(np.int64)) for g, x in floats.items()}
    frame = spark.createDataFrame([(g, k) for g, x in keys.items() for k in x.tolist()], "good boolean, key long")
    found = quality.at_ranks(frame, lambda g, n: [0, n // 3, n - 1] if g else [n // 2])
    got = {g: quality.in_order(np.array(x, dtype=np.int64)).view(np.float64).tolist() for g, x in found.items()}
    assert got == {True: [sorted(floats[True])[k] for k in (0, 100, 299)], False: [sorted(floats[False])[150]]}
    assert quality.at_ranks(frame.limit(0), lambda g, n: [0]) == {}


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def grams(text):
    words = ITEM_WORD.findall(text.translate(LOWER))
    return set(zip(words, words[1:], strict=False))


TEMPLATE_GRAMS = [(grams(t), name) for name, own in licences.TEMPLATES.items() for t in own]


def brute_licences(text):
    out = []
    text = text or ""
    parts = {x for x in text.split("\n")} | {text}
    paragraph = re.split(r"\n[ \t\r\x0b\x0c]*(?=\n)", text)
    parts |= {x.strip("\n") for x in paragraph if x.strip("\n")}
    for part in parts:
        own = grams(part)
        best = max(((dice(own, t), name) for t, name in TEMPLATE_GRAMS if own and not own.isdisjoint(t)), key=lambda x: (x[0], [-ord(c) for c in x[1]]), default=(0, ""))
        if best[0] >= licences.THRESHOLD - 1e-12:
            out.append(best)
    return out


def test_licences_against_all_templates(spark):
    docs = table(spark, SF, "documents")
    out = {r.doc_id: r for r in licences.scan_licences(docs).collect()}
    found = 0
    for key, text in docs.select("doc_id", "text").collect():
        want = brute_licences(text)
        assert (out[key].licence is not None) == bool(want), key
        assert set(out[key].licences) == {name for _, name in want}
        if want:
            found += 1
            assert out[key].dice == pytest.approx(max(want)[0])
    assert found


def test_licences_inside_lines_and_comments(spark):
    def block(text, sign, width):
        words = text.split()
        return "\n".join(f"{sign} {' '.join(words[i : i + width])}" for i in range(0, len(words), width))

    mit, gpl = licences.NOTICES["MIT"][2], licences.NOTICES["GPL-3.0"][1]
    about = "Copyright 2020 some people who wrote this program in their time"
    texts = [
        "Prose before. Licensed under the MIT License. Prose after it goes on.",
        f"/*\n{block(about + ' ' + mit + ' THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, ' * 1, ' *', 9)}\n */\nint main() {{ return 0; }}",
        f"# program.py - does a thing that programs do\n#\n{block(about, '#', 8)}\n#\n{block(gpl, '#', 8)}\n#\n# You should have received a copy along with it\nimport os",
        f"{about}. All rights reserved. {mit}",
        "It is licensed under CC BY 4.0 and, in part, released under the MIT license as well.",
        "all rights reserved " * 20_000,
        "He had all the rights, reserved as he was, under the license of the poets.",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in licences.scan_licences(frame).collect()}
    assert [out[i].licences for i in range(7)] == [["MIT"], ["MIT"], ["GPL-3.0"], ["MIT", "Proprietary"], ["CC-BY-4.0", "MIT"], ["Proprietary"], []]
    assert out[0].passage == "Licensed under the MIT License" and out[0].dice == 1.0


def test_licence_windows_against_all_spans(spark):
    rng = random.Random(6)
    small = {name: [t for t in own if len(t) < 90] for name, own in licences.TEMPLATES.items()}
    pool = [ITEM_WORD.findall(t.translate(LOWER)) for own in small.values() for t in own]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(3):
            notice = [w for w in rng.choice(pool) if rng.random() > 0.06]
            words += [rng.choice(["the", "of", "so", "under", "x"]) for _ in range(rng.randint(0, 6))] + notice
        texts.append(" ".join(words if rng.random() < 0.7 else words[:4]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in licences.scan_licences(frame, small).collect()}
    own = [grams(t) for ts in small.values() for t in ts]
    for i, text in enumerate(texts):
        pairs = list(zip(text.split(), text.split()[1:], strict=False))
        best = max((dice(set(pairs[a:b]), t) for a in range(len(pairs)) for b in range(a + 1, min(len(pairs), a + 30) + 1) for t in own), default=0)
        assert (out[i].n_matches > 0) == (best >= licences.THRESHOLD - 1e-12), text
    assert 0 < sum(r.n_matches > 0 for r in out.values()) < len(texts)


def wrapped(text, width, lead=""):
    return "\n".join(lead + line for part in re.split(r"\n\s*\n", text) for line in [*textwrap.wrap(" ".join(part.split()), width), ""])


def test_whole_licences(spark):
    prose = "An essay on rivers and on the towns beside them.\n\n"
    rows, want = [], []
    for name, (text, *_) in licences.WHOLE.items():
        for shape in (text, prose + wrapped(text, 60) + "\n\nMore of the essay.", "Copyright (c) 2020 Somebody Else <a@b.org>\n" + wrapped(text, 90, " * "), " ".join(text.split())):
            rows.append((len(rows), shape))
            want.append(name)
    for name, mark in licences.OPENINGS.items():
        rows.append((len(rows), prose + licences.WHOLE[name][0].split(mark)[0] + "and so on."))
        want.append(name)
    out = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (k, _), name in zip(rows, want, strict=True):
        assert out[k].licences == [name] and out[k].licence == name, (k, name, out[k].licences)
    bsd = {k: name for (k, _), name in zip(rows, want, strict=True) if name.startswith("BSD")}
    assert {n for k in bsd for n in out[k].licences} == {"BSD-2-Clause", "BSD-3-Clause"}


def test_licences_edges(spark):
    long = licences.NOTICES["MIT"][2]
    wrapped = long.replace("to deal in", "to\ndeal in").upper()
    texts = [None, "", "\n\n", "All rights reserved", f"Intro\n\n{wrapped}\n\nMore text here", "all rights", "x " * 50_000, "Released under the MIT License.\nAll rights reserved."]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[3], "clash")] * 2, "doc_id long, text string, licence string")
    out = {r.doc_id: r for r in licences.scan_licences(frame).collect()}
    assert [out[i].licence for i in range(8)] == [None, None, None, "Proprietary", "MIT", None, None, "MIT"]
    assert out[7].licences == ["MIT", "Proprietary"] and out[None].licence == "Proprietary"
    assert licences.scan_licences(frame.limit(0)).count() == 0


def test_language_id_accuracy(spark):
    docs = table(spark, SF, "documents")
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [k for k, r in out.items() if r.held_out]
    assert len(out) == len(truth) and held
    assert sum(out[k].lang_pred == truth[k] for k in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in out.items())


def test_language_id_reads_only_the_text(spark):
    docs = table(spark, SF, "documents")
    from pyspark.sql import functions as F

    held = langid.held_out(F.col("doc_id"))
    changed = docs.withColumn("lang", F.when(held, "en").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(d).collect()} for d in (docs, changed))
    assert a == b


def test_language_id_edges(spark):
    rows = [(i, "the of and " * 20, "en") for i in range(40)] + [(100 + i, "der und die " * 20, "de") for i in range(40)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 34 !!", "de"), (503, "und", None), (None, "the the", None), (504, "é", None), (504, "é", None), (505, "a" * 300_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(frame).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert [by[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and by[502].score == 0
    assert by[503].lang_pred == "de" and by[None].lang_pred == "en" and by[None].held_out and by[504].lang_pred != "und"
    assert langid.identify(frame.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(frame.where("doc_id > 502")).collect()} == {"und"}


def test_kernel_is_the_presence_kernel():
    texts = ["abcab", "abd", "xyz"]
    for _, _, block in blocks(pa.array(texts), Powers()):
        (_, _, seen), *_ = langid.batches_of(block)
    x = langid.normalised(seen)
    sets = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    for i, a in enumerate(sets):
        assert seen[i].sum() == len(a)
        for j, b in enumerate(sets):
            assert float(x[i] @ x[j]) == pytest.approx(len(a & b) / (len(a) * len(b)) ** 0.5, abs=1e-6)


def test_scores_are_those_of_plain_kernel_ridge(monkeypatch):
    """Every text a landmark: the Nyström map loses nothing, and scores are those of the dual solution over the kernel matrix."""
    monkeypatch.setattr(langid, "LANDMARKS", 10_000)
    rng = random.Random(4)
    syllables = {"a": ["ka", "to", "mi", "re"], "b": ["sch", "ung", "ein", "re"], "c": ["eau", "oi", "mi", "tre"]}
    write = lambda lang: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(3, 6)))
    langs = [lang for lang in "aaabbbbbcccc" for _ in range(2)]
    texts, asked = [write(lang) for lang in langs], [write(lang) for lang in "abcabc"]

    def grams(text):
        data = text.encode()
        return {data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)}

    kernel = lambda s, t: len(grams(s) & grams(t)) / np.sqrt(len(grams(s)) * len(grams(t)))
    ridge = np.diag([langid.RIDGE * langs.count(lang) for lang in langs])
    y = np.array([[1.0 if lang == own else -1.0 for own in "abc"] for lang in langs])
    dual = np.linalg.solve(np.array([[kernel(s, t) + 1 for t in texts] for s in texts]) + ridge, y)
    want = np.array([[kernel(s, t) + 1 for t in texts] for s in asked]) @ dual
    presence = lambda some: np.concatenate([x for _, _, block in blocks(pa.array(some), Powers()) for _, _, x in langid.batches_of(block)])
    model = langid.Model(langid.normalised(presence(texts)), langs)
    got = model.scores(langid.normalised(presence(asked)))
    assert model.langs == ["a", "b", "c"] and np.abs(got - want).max() < 0.05
    assert (got.argmax(axis=1) == want.argmax(axis=1)).all() and [model.langs[k] for k in got.argmax(axis=1)] == list("abcabc")
