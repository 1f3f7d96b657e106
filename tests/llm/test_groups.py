"""Operators that compare rows: near-duplicates, substring dedup, mixing."""

import json
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tributary.llm import chunking, cube, minhash
from tributary.llm.queries import table
from tributary.llm.textkit import BYTE_VALUES, NON_SPACE, Powers, blocks, mix

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(docs):
    """Components of Jaccard similarity 0.8 over all pairs that share a shingle, and of equal texts."""
    texts = sorted({t or "" for _, t in docs})
    sets, by = [shingle_set(t) for t in texts], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in {p for own in by.values() for p in combinations(own, 2)}:
        common = len(sets[i] & sets[j])
        if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
            up[find(i)] = find(j)
    at = {t: find(i) for i, t in enumerate(texts)}
    groups = defaultdict(list)
    for key, text in docs:
        groups[at[text or ""]].append((key, text or ""))
    out = []
    for own in groups.values():
        ids = [k for k, _ in own if k is not None]
        out += [(k, min(ids, default=None), len(own), len({t for _, t in own})) for k, _ in own]
    return out


def same_rows(a, b):
    key = lambda r: tuple(map(str, r))
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def test_near_duplicates_on_the_tables(spark):
    docs = table(spark, SF, "documents")
    want = brute_classes([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert same_rows(minhash.near_duplicates(docs).collect(), want)
    assert any(w[3] > 1 for w in want)


def variants(rng, words, n, share):
    for _ in range(n):
        own = list(words)
        for i in rng.sample(range(len(own)), int(len(own) * share)):
            own[i] = f"v{rng.random()}"
        yield " ".join(own)


def test_near_duplicates_of_an_original(spark):
    # Copies are nearer to the original than to one another; some chains have no common centre.
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), *variants(rng, words, 60, 0.02)]
    chain = [f"c{i}" for i in range(200)]
    for k in range(12):
        texts.append(" ".join(chain))
        chain[k * 14] = f"x{k}"
        chain[k * 14 + 7] = f"y{k}"
    docs = [(i + 10, t, None, None, None) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    out = minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    assert same_rows(out, brute_classes([d[:2] for d in docs]))


def test_near_duplicates_differ_in_repeats(spark):
    # Copies whose lines repeat a different number of times: their sets are alike, their counts are not.
    texts = []
    for g in range(40):
        words, line = [f"g{g}w{i}" for i in range(160)], [f"g{g}r{i}" for i in range(40)]
        texts += [" ".join(words + line * n) for n in ((2, 1000) if g else (2, 3, 40, 200, 1000, 3000))]
    rng = random.Random(8)
    group = [f"a{i}" for i in range(200)]
    for text in variants(rng, group, 20, 0.01):
        own = text.split(" ")
        texts.append(" ".join(own + own[:40] * rng.choice((1, 2, 500))))
    docs = [(i, t, None, None, None) for i, t in enumerate(texts)]
    out = minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    want = brute_classes([d[:2] for d in docs])
    assert same_rows(out, want)
    assert sum(w[3] > 1 for w in want) > 80


def test_hot_buckets_are_split(spark, monkeypatch):
    # Groups whose buckets hold many components: the same classes in cells of a few texts.
    for name, value in {"HOT": 2, "MOST_HOT": 10**9, "HELD": 2, "SALTED": 3}.items():
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(6)
    texts = []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(120)]
        texts += list(variants(rng, words, 40, 0.017))
    docs = [(i, t, None, None, None) for i, t in enumerate(texts + texts[:9])]
    out = minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()
    want = brute_classes([d[:2] for d in docs])
    assert same_rows(out, want) and len({w[1] for w in want}) > 3 < max(w[3] for w in want)


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b"), (2, "A  b"), (2, "A  b"), (3, None), (4, ""), (5, " "), (None, "a b"), (None, "q r s t u v"), (6, long), (7, long + " end"), (8, "x"), (8, "y")]
    frame = spark.createDataFrame([(k, t, None, None, None, "clash") for k, t in rows], SCHEMA + ", node string")
    out = minhash.near_duplicates(frame).collect()
    assert same_rows(out, brute_classes(rows))
    kept = minhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), (r.text or "")[:11]) for r in kept.collect()) == sorted([("1", "a b"), ("3", ""), ("5", " "), ("None", "q r s t u v"), ("6", long[:11]), ("8", "x"), ("8", "y")])
    assert minhash.near_duplicates(frame.limit(0)).count() == 0 and minhash.keep_one(frame.limit(0)).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 2**63, 300, dtype=np.int64).view(np.uint64)
    x, y = hashes[:200], hashes[40:240]
    wx, wy = rng.random(200) + 0.5, rng.random(200) + 0.5
    both = {h: [0.0, 0.0] for h in hashes[:240].tolist()}
    for h, w in zip(x.tolist(), wx, strict=True):
        both[h][0] = w
    for h, w in zip(y.tolist(), wy, strict=True):
        both[h][1] = w
    pairs = np.array([v for v in both.values()])
    exact = sum(1 / np.maximum(pairs[:, 0] / a, pairs[:, 1] / b).sum() for a, b in pairs if a and b)
    equal = []
    for k in range(40):
        shift = np.uint64(k * 7919)
        s = minhash.prob_minhash(np.concatenate([x, y]) ^ shift, np.concatenate([wx, wy]), np.array([0, 200, 400]))
        equal.append((s[0] == s[1]).mean())
    assert np.mean(equal) == pytest.approx(exact, abs=0.02)


def brute_chunks(words):
    """(first word, end) of every chunk of a list of words, by the rule alone: a boundary follows a word where two bits of the gear sum of four words are zero, and where 32 words had none."""
    hashes = []
    for _, _, block in blocks(pa.array([" ".join(words)]), Powers()):
        starts, ends, _ = block.words(NON_SPACE)
        hashes = [int(h) for h in mix(block.span_hash(block.prefix(BYTE_VALUES), starts, ends) ^ np.uint64(0xC2B2AE3D27D4EB4F))]
    bounds = [0]
    for i in range(len(words)):
        if i - bounds[-1] == 32:
            bounds.append(i)
        if i >= 3 and not sum(hashes[i - k] << k for k in range(4)) & 0b1100:
            bounds.append(i + 1)
    bounds = sorted({*bounds, len(words)})
    out = [(b, next(e for e in bounds if e >= b + 20)) for b in bounds if b + 20 <= len(words)]
    return out if not out or out[-1][1] == len(words) else [*out, (out[-1][0], len(words))]


def brute_cuts(rows):
    """The words that each of the rows (id, text, key) loses, with dictionaries of the chunks' words."""
    texts = [WORD.findall(t or "") for _, t, _ in rows]
    chunks = [{(b, e): tuple(w[b:e]) for b, e in brute_chunks(w)} for w in texts]
    holders = defaultdict(set)
    for (_, _, key), own in zip(rows, chunks, strict=True):
        for words in own.values():
            holders[words].add(key)
    first = [{} for _ in rows]
    may, whole = [], []
    for (_, _, key), own, at in zip(rows, chunks, first, strict=True):
        for span, words in own.items():
            at.setdefault(words, span)
        may.append({i for (b, e), words in own.items() if min(holders[words]) != key and (at[words] == (b, e) or b >= at[words][1]) or b >= at[words][1] for i in range(b, e)})
        whole.append({words for words, (b, e) in at.items() if may[-1].isdisjoint(range(b, e))})
    kept = {key: w for (_, _, key), w in zip(rows, whole, strict=True)}
    out = []
    for (_, _, key), own, at in zip(rows, chunks, first, strict=True):
        gone = set()
        for (b, e), words in own.items():
            if (min(holders[words]) != key and (at[words] == (b, e) or b >= at[words][1]) or b >= at[words][1]) and words in kept[min(holders[words])]:
                gone |= set(range(b, e))
        out.append(gone)
    return out


def test_chunks_resist_insertions():
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    more = [*words[:100], "new", "words", *words[100:]]
    one, two = ({tuple(x[b:e]) for b, e in brute_chunks(x)} for x in (words, more))
    assert all(20 <= len(c) <= 52 for c in one | two) and {i for b, e in brute_chunks(words) for i in range(b, e)} == set(range(300))
    lost = one - two
    assert 0 < len(lost) < 16 and len(one) > 45
    for _, _, block in blocks(pa.array([" ".join(words)]), Powers()):
        c = chunking.Chunks(block)
        assert sorted(zip(c.begin.tolist(), c.stop.tolist(), strict=True)) == brute_chunks(words) and len(set(c.digest.tolist())) == len(one)


def cut_positions(row):
    return {i for c in json.loads(row.cuts) for i in range(c["begin"], c["end"])}


def windows(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_substring_dedup_on_the_tables(spark):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", chunking.document_key("doc_id", "text").alias("key")).collect()]
    out = {r.doc_id: r for r in chunking.repeats(docs).collect()}
    want = brute_cuts(rows)
    for (key, text, _), gone in zip(rows, want, strict=True):
        words = WORD.findall(text or "")
        assert cut_positions(out[key]) == gone and (out[key].n_words, out[key].n_cut_words) == (len(words), len(gone))
        assert WORD.findall(out[key].text) == [w for i, w in enumerate(words) if i not in gone]
    assert sum(map(bool, want)) > 20
    # A passage of over 50 words is left in one document at most.
    assert max(Counter(x for r in out.values() for x in set(windows(WORD.findall(r.text), 50))).values()) == 1
    assert_stands_whole({k: t for k, t, _ in rows}, out)


def assert_stands_whole(texts, out):
    """Every word cut lies in 20 words that the output holds one after another. Nothing here knows chunks."""
    left = {x for r in out.values() for x in windows(WORD.findall(r.text or ""), 20)}
    for key, text in texts.items():
        words = WORD.findall(text or "")
        for c in json.loads(out[key].cuts):
            held = {i + k for i in range(c["begin"], c["end"] - 19) if tuple(words[i : i + 20]) in left for k in range(20)}
            assert held == set(range(c["begin"], c["end"]))


def test_nothing_is_cut_that_no_document_keeps(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"f{rng.random()}" for _ in range(n)]
    own = fresh(120)
    # Groups of 12 words of one text, scattered over unrelated texts: that text stays.
    rows = {1000: own} | {k: [*fresh(40), *own[10 * k : 10 * k + 12], *fresh(40)] for k in range(11)}
    # Copies of a passage, edited here and there, cut short and joined to others.
    base, other = fresh(150), fresh(90)
    for k in range(40):
        x = [w if rng.random() > 0.01 else fresh(1)[0] for w in base[rng.randint(0, 60) : 150 - rng.randint(0, 60)]]
        rows[2000 + k] = [*fresh(rng.randint(0, 9)), *x, *(other[rng.randint(0, 40) :] if k % 3 else []), *fresh(5), *(x if k % 7 == 0 else [])]
    texts = {k: " ".join(w) for k, w in rows.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r for r in chunking.repeats(docs).collect()}
    assert all(out[k].n_cut_words == 0 for k in rows if k <= 1000)
    assert sum(r.n_cut_words > 50 for r in out.values()) > 30
    assert_stands_whole(texts, out)
    keyed = [tuple(r) for r in docs.select("doc_id", "text", chunking.document_key("doc_id", "text").alias("key")).collect()]
    assert [cut_positions(out[k]) for k, _, _ in keyed] == brute_cuts(keyed)


def test_substring_dedup_edges(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randint(0, 999)}" for _ in range(80))
    fresh = lambda n: " ".join(f"f{rng.random()}" for _ in range(n))
    rows = [(i, f"{fresh(20)}\n{passage}\n{fresh(20)}") for i in range(30)]
    rows += [(100, None), (101, ""), (102, "short line here"), (103, "short line here"), (104, "de " * 5000), (None, fresh(30)), (None, fresh(30)), (105, fresh(50_000))]
    same = (200, f"{fresh(100)}")
    frame = spark.createDataFrame([(k, t, "en", "a", len(t or ""), "clash") for k, t in [*rows, same, same]], SCHEMA + ", key string")
    out = chunking.strip_repeats(frame)
    assert out.columns == frame.columns and [f.dataType for f in out.schema] == [f.dataType for f in frame.schema]
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    assert sum(len(x) for x in got.values()) == len(rows) + 2
    assert sum(passage in got[i][0].text for i in range(30)) == 1
    assert all(r.n_chars == len(r.text) for i in range(30) for r in got[i])
    assert got[100][0].text is None and got[101][0].text == "" and got[102][0].text == got[103][0].text == "short line here"
    assert len(got[104][0].text) < 100
    assert got[105][0].text == rows[-1][1]
    assert all(r.text == same[1] for r in got[200])
    assert chunking.repeats(frame.limit(0)).count() == 0


def test_targets():
    assert cube.targets([]) == {}
    assert cube.targets([("b", 100), ("a", 100)]) == {"a": pytest.approx(200 / 3), "b": pytest.approx(400 / 3)}
    got = cube.targets([("a", 10), ("b", 100), ("c", 50), (None, 3)])
    assert got[None] == 9 and sum(got.values()) == pytest.approx(163)
    assert cube.targets([("a", 0), ("b", 0)]) == {"a": 0, "b": 0}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 900, 3000).astype(float)
    p = rng.random(3000)
    q = cube.fly(p, size, rng.random(3000))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())
    landed = cube.land(q, size)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) <= 900
    assert not ((cube.fly(np.full(50, 0.3), np.full(50, 7.0), rng.random(50)) % 1 > 0).sum() > 1)


def test_inclusion_follows_probabilities():
    rng = np.random.default_rng(9)
    size, p = rng.integers(1, 90, 40).astype(float), np.linspace(0.1, 0.9, 40)
    mean = np.mean([cube.land(cube.fly(p, size, rng.random(40)), size) for _ in range(1500)], axis=0)
    assert np.abs(mean - p).mean() < 0.05


def filled(total):
    """Targets by raising one level until all words are dealt: a source takes its weight of it, three times its size at most."""
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    low, high = 0.0, 3.0 * sum(total.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * total[s], weight[s] * level) for s in order) < sum(total.values()) else (low, level)
    return {s: min(3 * total[s], weight[s] * high) for s in order}


def test_targets_are_those_of_a_rising_level():
    rng = random.Random(8)
    for _ in range(200):
        total = {s: rng.choice([0, 1, 5, 40, 900]) for s in rng.sample(["a", "b", "é", "Z", "", "src9", "src10", None], rng.randint(1, 8))}
        assert cube.targets(list(total.items())) == pytest.approx(filled(total), abs=1e-6)


def test_mixture_on_the_tables(spark):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    size = {k: len(WORD.findall(t or "")) for k, t, _ in rows}
    total = Counter()
    for k, _, s in rows:
        total[s] += size[k]
    goal = filled(total)
    out = cube.mixture(docs).collect()
    assert {r.doc_id: r["size"] for r in out} == size and len(out) == len(rows)
    taken = Counter()
    for r in out:
        assert r.source_size == total[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken % max(r["size"], 1) == 0 and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, g in goal.items():
        assert abs(taken[s] - g) <= max(size.values()) and abs(taken[s] - g) < 0.1 * g
    again = cube.mixture(docs.repartition(5, "text")).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mixture_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cube, "BLOCK_UNITS", 8)
    rows = [(i, "w " * (i % 37 + 1), None, "a" if i % 3 else "b", None) for i in range(600)]
    out = cube.mixture(spark.createDataFrame(rows, SCHEMA)).collect()
    taken, goal = Counter(), {}
    for r in out:
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert len(out) == 600 and all(abs(taken[s] - goal[s]) <= 37 for s in goal)


def test_mixture_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (None, "", None), (2, "d", None), (3, "e f g\x1ch", "y"), (4, "k " * 100_000, "z")]
    frame = spark.createDataFrame([(k, t, None, s, None, "clash") for k, t, s in rows], SCHEMA + ", copies string")
    out = cube.mixture(frame).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in out) == sorted((str(k), len(WORD.findall(t or ""))) for k, t, _ in rows)
    assert all(r.taken <= 3 * r["size"] for r in out)
    mixed = cube.materialise(frame.drop("copies"))
    assert mixed.columns == [*frame.columns[:-1], "copies"] and {r.copies for r in mixed.collect()} <= {1, 2, 3}
    assert cube.mixture(frame.limit(0)).count() == 0 and cube.materialise(frame.drop("copies").limit(0)).count() == 0
