"""Divergence audit, SimHash components and spelling variants against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from impactlake.llm import divergence, simhash, variants
from impactlake.llm.components import spanning

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture
def stored(spark, tmp_path):
    def store(rows, ddl="doc_id long, text string, lang string, source string"):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        spark.createDataFrame(rows, ddl).write.parquet(path)
        return spark.read.parquet(path)

    return store


# -- divergence ------------------------------------------------------------------------------------------------------


def brute_divergence(rows, least, top):
    import re

    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(w for d in docs if d[0] == lang for w in set(d[2]))
        kept = [w for w, n in seen.items() if n >= least]
        counts = {s: Counter(w for d in docs if d[:2] == (lang, s) for w in d[2] if w in kept) for s in {d[1] for d in docs if d[0] == lang}}
        every = sum(counts.values(), Counter())
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept} for s, c in [*counts.items(), (None, every)]}
        for s, c in counts.items():
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in counts if t != s]
            terms = [(p[s][w] - p[None][w], w) for w in kept if c[w] and p[s][w] > p[None][w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered) if part == "pair" or i < top]
    return sorted(out)


def found_divergence(docs, **more):
    return sorted(tuple(r) for r in divergence.divergence(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_equals_brute_force(stored, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 3)
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    draw = random.Random(1)
    words = ["the", "OF", "été", "日本", "x", "ÉTÉ", "a-b", "ß", "don't", "zz9y"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 12))), draw.choice(["en", "fr", None]), draw.choice(["a", "b", "c", None])) for i in range(60)]
    rows += [(None, None, "en", "z"), (1, "", "none", "only"), (1, "12 34 _", "none", "other"), *[(7, "the the OF", "en", "a")] * 20]
    assert found_divergence(stored(rows), least_docs=3, top=2) == brute_divergence(rows, 3, 2)


def test_divergence_without_rows_terms_or_partners(stored):
    assert found_divergence(stored([])) == []
    lone = [(1, "one two", "en", "a")]
    assert found_divergence(stored(lone)) == []
    rows = [(1, "one two", "en", "a"), (2, None, "en", "b")]
    assert found_divergence(stored(rows)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_divergence_long_text_and_clashing_columns(stored):
    rows = [(1, "ab " * 400_000 + "cd", "en", "a", 5, "x"), (2, "cd", "en", "b", 6, "y")]
    docs = stored(rows, "doc_id long, text string, lang string, source string, n long, term string")
    assert found_divergence(docs, least_docs=1) == brute_divergence([r[:4] for r in rows], 1, 50)


def test_pair_tally_counts_implied_zeros():
    cells = pa.table({"i": [0, 1, 0, 2], "term": pa.array([b"a", b"a", b"b", b"c"], pa.binary()), "n": [2, 3, 1, 4], "sources": [4] * 4})
    got = Counter({tuple(r[k] for k in "ijxy"): r["m"] for r in divergence.pair_tally(cells).to_pylist()})
    counts = [{"a": 2, "b": 1}, {"a": 3}, {"c": 4}, {}]
    want = Counter((i, j, counts[i].get(t, 0), counts[j].get(t, 0)) for i, j in combinations(range(4), 2) for t in "abc" if counts[i].get(t, 0) + counts[j].get(t, 0))
    assert got == want


def test_share_is_exact_for_large_counts(spark):
    rows = [(0, 0, 1), (10**13, 10**14 - 7, 10**6 + 3), (123456789012, 987654321098, 4321), (5, 0, 0)]
    df = spark.createDataFrame(rows, "n long, total long, kept long").select("*", divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    for r in df.collect():
        assert r.p == 1 + 10**9 * (r.n + 5) // max(1, r.total + 5 * r.kept)


# -- simhash ---------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = (text or "").translate(LOWER).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_links(points, radius):
    return {(min(a, b), max(a, b)) for a, b in combinations(points, 2) if (a ^ b).bit_count() <= radius}


def clustered(n, seed=3):
    draw = random.Random(seed)
    points = {draw.getrandbits(64) for _ in range(n)}
    for x in draw.sample(sorted(points), n // 4):
        for _ in range(3):
            points.add(x ^ 1 << draw.randrange(64) ^ 1 << draw.randrange(64))
            x ^= 1 << draw.randrange(64)
            points.add(x)
    return sorted(points)


def test_fingerprints_equal_brute_force(spark):
    texts = ["", None, "one", "one Two", "a b c d a b c", "É é\tÀ x\x0by", "w " * 70_000 + "end", "A B C"]
    assert [simhash.fingerprint(t.encode() if t is not None else None) for t in texts] == [brute_print(t) for t in texts]
    rows = spark.createDataFrame([("b c a  B",)], "t string").selectExpr("xxhash64('b c a') as x").first()
    assert rows.x % (1 << 64) == xxhash.xxh64_intdigest(b"b c a", 42)


@pytest.mark.parametrize("radius", [0, 1, 2, 4])
def test_near_pairs_equal_brute_force(radius):
    points = clustered(400)
    for inside, n in ((True, len(points)), (True, 300), (False, 300)):
        own, guests = np.array(points[:n], np.uint64), np.array(points[n:], np.uint64)
        got = [(min(a, b), max(a, b)) for u, v in simhash.near_pairs(own, guests, radius, inside) for a, b in zip(u.tolist(), v.tolist())]
        want = {p for p in brute_links(points, radius) if (inside and p[0] in points[:n] and p[1] in points[:n]) or (p[0] in points[:n]) != (p[1] in points[:n])}
        assert len(got) == len(set(got)) and set(got) == want


def test_routing_loses_no_pair():
    points = np.array(clustered(1500), np.uint64)
    tree = simhash.fit(points[::3], 64, 2)
    found = []
    parts = simhash.routed(tree, points, 2)
    assert sorted(x for _, own, _ in parts for x in own.tolist()) == points.tolist() and len(parts) > 32
    for _, own, guests in parts:
        found += [(min(a, b), max(a, b)) for u, v in simhash.near_pairs(own, guests, 2) for a, b in zip(u.tolist(), v.tolist())]
    assert len(found) == len(set(found)) and set(found) == brute_links(points.tolist(), 2)


def same_components(pairs, want, points):
    a, b = dict(spanning(pairs)), dict(spanning(sorted(want)))
    return [a.get(p, p) for p in points] == [b.get(p, p) for p in points]


@pytest.mark.parametrize("cell", [1 << 19, 40])
def test_links_with_many_shards_and_small_cells(stored, monkeypatch, cell):
    monkeypatch.setattr(simhash, "SHARD", 100)
    monkeypatch.setattr(simhash, "CELL", cell)
    points = [p - (1 << 64) if p >> 63 else p for p in clustered(500)]
    found = [tuple(r) for r in simhash.links(stored([(p,) for p in points], "point long"), 2).collect()]
    want = {(a, b) for a, b in combinations(sorted(points), 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert same_components(found, want, points)


def test_links_in_a_dense_region_without_a_good_vantage(stored, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    monkeypatch.setattr(simhash, "DIRECT", 8)
    points = list(range(600))  # each is within two bits of many others
    found = [tuple(r) for r in simhash.links(stored([(p,) for p in points], "point long"), 2).collect()]
    assert same_components(found, {(a, b) for a, b in combinations(points, 2) if (a ^ b).bit_count() <= 2}, points)


def test_simhash_components_equal_brute_force(stored):
    draw = random.Random(4)
    long = " ".join(draw.choices("abcdefghij", k=30_000)) + " "
    texts = [" ".join(draw.choices("abcdefgh", k=draw.randint(0, 6))) for _ in range(150)] + [None, "", "  ", long + "x", long + "y", long]
    rows = [(k if k % 50 else None, t, "en", f"s{k}", "z", k) for k, t in enumerate(texts)] * 2
    docs = stored(rows, "doc_id long, text string, lang string, source string, point string, component_id int")
    found = simhash.simhash_components(docs).collect()
    prints = {t: brute_print(t) for t in set(texts)}
    points = sorted(set(prints.values()))
    label = dict(spanning(sorted(brute_links(points, 2))))
    least: dict[int, int] = {}
    for r in rows:
        own = label.get(prints[r[1]], prints[r[1]])
        if r[0] is not None:
            least[own] = min(least.get(own, r[0]), r[0])
    want = Counter((r[0], f"{prints[r[1]]:016x}", least.get(label.get(prints[r[1]], prints[r[1]]))) for r in rows)
    assert Counter(tuple(r) for r in found) == want
    assert len({r.component_id for r in found if r.fingerprint == f"{brute_print(long):016x}"}) == 1


def test_simhash_of_an_empty_table(stored):
    assert simhash.simhash_components(stored([])).collect() == []


# -- variants --------------------------------------------------------------------------------------------------------


def brute_variants(counts, factor=5):
    near = defaultdict(set)
    places = defaultdict(list)
    for w in counts:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in counts:
                near[w].add(short)
                near[short].add(w)
            places[i, w[:i], w[i + 1 :]].append(w)
    for group in places.values():
        for a, b in combinations(group, 2):
            near[a].add(b)
            near[b].add(a)
    form = {w: b for w in counts if near[w] and counts[b := min(near[w], key=lambda x: (-counts[x], x))] >= factor * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


def brute_counts(rows, one_in=199, shortest=6, least=5):
    import re

    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            w = w if h % one_in else w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= shortest
    return {w: n for w, n in counts.items() if n >= least}


def found_variants(docs, **more):
    return sorted(tuple(r) for r in variants.variants(docs, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def by_word(rows):
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("largest", [20_000, 2])
def test_variants_equal_brute_force(stored, largest, monkeypatch):
    monkeypatch.setattr(variants, "ENTRIES", 20)
    draw = random.Random(5)
    letters = "abÉ×ÿ"
    rows = [(i if i % 30 else None, " ".join("".join(draw.choices(letters, weights=[9, 4, 2, 1, 1], k=draw.randint(4, 9))) + draw.choice([" ", "1", "Ā", "Ā"]) for _ in range(150))) for i in range(60)]
    rows += [(5, None), (6, ""), (7, "Q" * 300), *[(8, "Q" * 301 + " " + "Q" * 300)] * 6]
    docs = stored(rows, "doc_id long, text string")
    counts = brute_counts(rows, one_in=7)
    assert found_variants(docs, one_in=7, largest=largest) == brute_variants(counts) and len(counts) > 60


def test_variant_chains_and_ties(stored):
    words = {"abcdef": 3, "abcdeg": 3, "abcdxf": 20, "abcyxf": 150, "zzzzzz": 4, "zzzzzza": 21, "zzzzzzb": 21}
    docs = stored([(None, " ".join(w for w, n in words.items() for _ in range(n)), "x", 1)], "doc_id string, text string, word string, n int")
    got = {r[0]: r for r in found_variants(docs, least=1, one_in=1 << 40)}
    assert list(got.values()) == brute_variants(words)
    assert got["abcdef"][1:3] == ("abcdxf", "abcyxf") and got["abcdeg"][1:3] == (None, "abcdeg") and got["zzzzzz"][1] == "zzzzzza"


def test_variants_without_words(stored):
    assert found_variants(stored([], "doc_id long, text string")) == [] and found_variants(stored([(1, "short ab")], "doc_id long, text string")) == []


def test_trie_pairs_are_those_at_distance_one():
    draw = random.Random(6)
    words = sorted({"".join(draw.choices("ab", k=draw.randint(0, 6))) for _ in range(90)})

    def lcp(x, y):
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    def one(x, y):
        i = lcp(x, y)
        return x[i + 1 :] == y[i + 1 :] if len(x) == len(y) else x[i + (len(x) > len(y)) :] == y[i + (len(y) > len(x)) :] and abs(len(x) - len(y)) == 1

    want = sorted((a, b, lcp(words[a], words[b])) for a, b in combinations(range(len(words)), 2) if one(words[a], words[b]))
    assert sorted(variants.trie_pairs(words)) == want


def test_queries_are_registered():
    import __spark_entry__

    assert {"op11_divergence", "op12_simhash_dedup", "op13_spelling_variants"} <= set(__spark_entry__.queries())
