"""Each operator against brute force, and on nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from impactlake.llm import bpe, components, html_text, language_id, neighbours, ngram_join, packing, quality_rules, suffix_dedup, token_counts, url_filters
from impactlake.llm.common import written

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join("".join(rng.choices("abcdefghij", k=1 + rng.randrange(6))) + str(rng.randrange(vocabulary) % 7) for _ in range(n))


def sample_rows():
    rng = random.Random(5)
    base = words(rng, 200)
    near = base.split(" ")
    near[100] = "changed"
    passage = words(rng, 120)
    texts = [None, "", " ", "one", "two words", base, base, " ".join(near), words(rng, 80) + " " + passage, passage + "\n" + words(rng, 50), "é" * 450, "x y " * 300, words(rng, 6000), "Hello <|endoftext|> world", "tab\tand  spaces\n\n\x0b\x1cend "]
    rows = [(i, t, ["en", "fr", None][i % 3], "src0", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return written(spark.createDataFrame(sample_rows(), DOC).repartition(3), "docs")


@pytest.fixture(scope="module")
def no_docs(spark):
    return written(spark.createDataFrame([], DOC), "docs")


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# -- 1 ------------------------------------------------------------------------------------------------------------


def counted(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeat = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def test_quality_counts(docs, no_docs):
    out = quality_rules.quality(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in out.collect():
        q = r["quality"]
        assert tuple(q[n] for n in names) == counted(r["text"]), r["text"]
        assert q["base_failed"] == (q["n_words"] < 10 or 100 * q["n_repeat_words"] > 20 * q["n_words"])
        assert not (q["base_failed"] and q["kept"])
    assert out.count() == docs.count()
    assert quality_rules.quality(no_docs).count() == 0
    clash = docs.withColumn("quality", F.lit(1))
    assert quality_rules.quality(clash).columns == [*clash.columns, "_quality"]


def plain_kneser_ney(texts):
    """p(character | four before it) of interpolated modified Kneser-Ney, from dicts."""
    grams = Counter()
    for t in texts:
        line = "\x02" * 4 + t.lower()
        grams.update(line[i : i + 5] for i in range(len(line) - 4))
    levels = {5: grams}
    for n in (4, 3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    cuts = {n: quality_rules.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))) for n, c in levels.items()}
    by_context = {n: {} for n in levels}
    for n, c in levels.items():
        for g, v in c.items():
            by_context[n].setdefault(g[:-1], []).append(v)

    def p(g):
        n = len(g)
        if not n:
            return 1 / (len(levels[1]) + 1)
        own, below = by_context[n].get(g[:-1]), p(g[1:])
        if not own:
            return below
        cut = lambda v: cuts[n][min(v, 3) - 1]
        v = levels[n].get(g, 0)
        return ((v - cut(v) if v else 0) + sum(map(cut, own)) * below) / sum(own)

    return p


@pytest.mark.parametrize("limits", [(10**6, 10**9), (300, 10**9), (300, 20_000)])
def test_perplexity_is_that_of_kneser_ney(docs, limits):
    """Whether the model is one part or many, in one round or several."""
    rows = docs.collect()
    scored = {r["lang"]: plain_kneser_ney([x["text"] for x in rows if x["lang"] == r["lang"] and x["text"] is not None]) for r in rows}
    found = quality_rules.quality(docs, part_grams=limits[0], model_bytes=limits[1]).collect()
    assert len(found) == len(rows)
    for r in found:
        text = (r["text"] or "").lower()
        n = len(text.encode().split())
        if not n:
            assert r["quality"]["log_perplexity"] is None
        elif len(text) < 3000:
            line = "\x02" * 4 + text
            want = -sum(math.log(scored[r["lang"]](line[i : i + 5])) for i in range(len(text))) / n
            assert math.isclose(r["quality"]["log_perplexity"], want, rel_tol=1e-4), text[:50]


def test_kneser_ney_sums_to_one():
    p, alphabet = plain_kneser_ney(["abracadabra", "cabbage bag", "a bad cab"]), sorted(set("abracadabracabbage bag"))
    for context in ("\x02\x02\x02\x02", "abra", " bag", "zzzz"):
        assert math.isclose(sum(p(context + x) for x in [*alphabet, "?"]), 1.0, rel_tol=1e-9)


def test_characters_are_not_folded_together(spark):
    """Cyrillic prose and shuffled Cyrillic letters differ, as symbols do; long texts are scored whole."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("абвгдежзиклмнопрст", k=rng.randrange(2, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=120)), "ru") for i in range(200)]
    junk = "".join(rng.choices("абвгдежзиклмнопрст ", k=700))
    rows += [(1000, " ".join(junk[i : i + 6] for i in range(0, 600, 6)), "ru"), (1001, " ".join(rng.choices(vocabulary, k=90_000)), "ru")]
    kept = {r["doc_id"]: r["quality"] for r in quality_rules.quality(written(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")).collect()}
    assert not kept[1000]["kept"] and not kept[1000]["base_failed"]
    assert sum(kept[i]["kept"] for i in range(200)) >= 197
    assert abs(kept[1001]["log_perplexity"] - sorted(kept[i]["log_perplexity"] for i in range(200))[100]) < 0.3


def test_perplexity_bands_reject_foreign_text(spark):
    rng = random.Random(1)
    plain = [(i, words(rng, 60, 20), "en") for i in range(300)]
    odd = [(1000, " ".join("zzqx" + "xyzw"[k % 4] * (k // 4 % 5) + "-/~" + "vqk"[k % 3] * (k // 12) for k in range(60)), "en")]
    df = written(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string"), "docs")
    kept = {r["doc_id"]: r["quality"] for r in quality_rules.quality(df).collect()}
    assert not kept[1000]["kept"] and not kept[1000]["base_failed"]
    assert sum(q["kept"] for q in kept.values()) >= 295


def prose(rng, n, vocabulary):
    return " ".join(rng.choices(vocabulary, k=n))


def spam_and_tables(spark):
    """300 clean documents, 12 of words with symbols, 12 of one symbol run repeated between few words, 12 tables of words, some of a rare language."""
    rng = random.Random(11)
    vocabulary = sorted({words(rng, 1, 5) for _ in range(500)})
    clean = [(i, prose(rng, 60 + i % 200, vocabulary), "en") for i in range(300)]
    spam = [(1000 + i, " ".join(w + rng.choice("#*$%&") * 3 for w in rng.choices(vocabulary, k=150)), "en") for i in range(12)]
    runs = [(2000 + i, " ".join(" ".join(rng.sample(vocabulary[:12], 8)) + " " + "-" * (40 + i) for _ in range(12)), "en") for i in range(12)]
    tables = [(3000 + i, " | ".join(rng.choices(vocabulary, k=150)), "en") for i in range(12)]
    rare = [(4000 + i, prose(rng, 100, vocabulary), "xx") for i in range(20)] + [(5000, " ".join("".join(rng.choices("QWZ#@!~^0987", k=6)) for _ in range(40)), "xx")]
    return written(spark.createDataFrame(clean + spam + runs + tables + rare, "doc_id long, text string, lang string"), "docs")


def test_perplexity_bands_reject_spam_and_tables(spark):
    kept = {r["doc_id"]: r["quality"] for r in quality_rules.quality(spam_and_tables(spark)).collect()}
    assert not any(q["base_failed"] for q in kept.values())
    middle = sorted(kept[i]["log_perplexity"] for i in range(300))[150]
    for first in (1000, 2000, 3000):
        assert not any(kept[first + i]["kept"] for i in range(12)), first
    assert {kept[i]["log_perplexity"] > middle for i in (1000, 2000)} == {True, False}  # either side of the band
    assert not kept[5000]["kept"] and all(kept[4000 + i]["kept"] for i in range(20))
    assert sum(kept[i]["kept"] for i in range(300)) >= 297


# -- 2 ------------------------------------------------------------------------------------------------------------


def repeats(texts, width):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(1 for k, _ in itertools.groupby(gone) if k), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width", [64, 400])
def test_suffix_dedup(docs, width):
    rows = docs.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, repeats([r["text"] for r in rows], width)))
    out = suffix_dedup.without_repeats(docs, width).select("doc_id", "repeats.*", F.size("repeats.spans").alias("n_spans"))
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_dedup_random_overlaps(spark):
    rng = random.Random(3)
    pieces = ["".join(rng.choices("ab", k=rng.randrange(30, 150))) for _ in range(12)]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 9))) for _ in range(60)] + ["a" * 300, "ab" * 200]
    df = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    out = suffix_dedup.without_repeats(df, 64).select("doc_id", "repeats.*", F.size("repeats.spans").alias("n_spans"))
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter((i, *x) for i, x in enumerate(repeats(texts, 64)))


def test_word_hashes_tell_words_apart():
    """Equal words have equal hashes wherever they stand, other words others; pieces and very long words make no difference."""
    rng = random.Random(1)
    vocabulary = [bytes(rng.choices(b"ab\x00\xff", k=rng.randrange(1, 6))) for _ in range(300)] + [b"long" * 300_000, b"long" * 300_000 + b"x"]
    texts = [b"", b" ", b"\x0bone\x0c", *(b"".join(w + rng.choice([b" ", b"\n", b"\t\r"]) for w in rng.choices(vocabulary[:-2], k=n)) for n in (1, 7, 300, 200_000)), b" ".join(vocabulary)]
    seen = {}
    for t, h in zip(texts, suffix_dedup.word_hashes(texts)):
        words_ = t.split()
        assert len(words_) == len(h)
        for w, x in zip(words_, h.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_suffix_dedup_marks_passages_of_words(spark):
    rng = random.Random(8)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 8))) for _ in range(n))
    passage, short = own(50), own(49)
    texts = [f"{own(80)} {passage} {own(70)}", f"{own(60)}\t{passage.replace(' ', chr(10))} é", f"{own(20)} {short}", f"{short} {own(9)}", None, ""]
    df = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    for r in suffix_dedup.without_repeats(df, 400, mark_words=50).collect():
        raw, found = (r["text"] or "").encode(), r["repeats"]["passages"]
        assert [raw[s["start"] : s["end"]].split() for s in found] == ([passage.encode().split()] if r["doc_id"] < 2 else [])
        assert r["repeats"]["n_removed"] == 0


def test_suffix_dedup_empty_and_clash(no_docs):
    assert suffix_dedup.without_repeats(no_docs).count() == 0
    assert suffix_dedup.without_repeats(no_docs.withColumn("repeats", F.lit(1))).columns[-1] == "_repeats"


# -- 3 ------------------------------------------------------------------------------------------------------------


def test_packing(docs, no_docs):
    library = Tokenizer.from_file(BYTE)
    rows = packing.pack_documents(docs, BYTE, capacity=64, end_id=2).collect()
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    want = Counter()
    for d in docs.collect():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 64 + 1
        start, piece = 0, 0
        while start < len(ids):
            n = first if piece == 0 else 64
            want[(d["doc_id"], piece, start, n, zlib.crc32(np.asarray(ids[start : start + n], "<u4").tobytes()))] += 1
            start, piece = start + n, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.pack_documents(no_docs, BYTE).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_packing_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    counts = np.zeros(capacity + 1, np.int64)
    for w in rng.integers(1, capacity + 1, int(rng.integers(0, 300))):
        counts[w] += 1
    t = packing.slots(counts, capacity)
    bins = int(t["sequence"].max()) + 1 if len(t["sequence"]) else 0
    total = int((np.arange(capacity + 1) * counts).sum())
    large = int(counts[capacity // 2 + 1 :].sum())
    assert max(-(-total // capacity), large) <= bins <= 1.25 * max(-(-total // capacity), large) + 2


def test_reduction_keeps_the_optimum():
    def optimum(items, capacity):
        best = [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for room in sorted(set(r for r in rooms if r >= items[i])):
                j = rooms.index(room)
                place(i + 1, rooms[:j] + [room - items[i]] + rooms[j + 1 :])
            place(i + 1, rooms + [capacity - items[i]])

        place(0, [])
        return best[0]

    rng = random.Random(7)
    for _ in range(60):
        items = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(items, minlength=13)
        fixed, left = packing.reduce_instance(counts, 12)
        rest = [w for w in range(12, 0, -1) for _ in range(left[w])]
        assert sum(n for _, n in fixed) + (optimum(rest, 12) if rest else 0) == optimum(items, 12)


# -- 4 ------------------------------------------------------------------------------------------------------------


def test_token_counts_follow_edits(docs, no_docs):
    library = Tokenizer.from_file(BYTE)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    edited = docs.withColumn("edits", F.when(F.col("doc_id") % 4 != 0, token_counts.sample_edits(F.col("text"))))
    trees = token_counts.build_trees(edited, BYTE)
    for r in token_counts.apply_edits(trees, BYTE, "edits").collect():
        text = r["text"] or ""
        assert r["n_tokens"] == count(text)
        for e in r["edits"] or ():
            text = text[: e["start"]] + e["inserted"] + text[e["start"] + e["deleted"] :]
        assert r["text_after"] == text and r["tokens_after"] == count(text) == r["trees_after"][1]
        if len(text) > 20000:
            assert r["chars_encoded"] < len(text) / 10
    assert token_counts.build_trees(no_docs, BYTE).count() == 0


def test_segment_tree_splits_what_grows():
    from impactlake.llm.tokens import encoder

    e, rng = encoder(BYTE), random.Random(3)
    japanese = "".join("".join(rng.choices("かきくけこ山川田日本", k=rng.randrange(3, 20))) + "、。"[rng.randrange(2)] for _ in range(3000))
    for text, grown in ((words(rng, 3000), words(rng, 30_000)), (japanese, japanese * 3)):
        tree = token_counts.SegmentTree(text, e.count)
        assert tree.size > len(text) / 2000
        tree.edit(100, 0, grown)
        before = tree.encoded
        ref = text[:100] + grown + text[100:]
        for at in (50_000, 5, len(ref) - 3):
            tree.edit(at, 1, "x")
            ref = ref[:at] + "x" + ref[at + 1 :]
        assert tree.encoded - before < 3 * 2500 and tree.now == ref
        assert tree.tokens[1] == len(e.library.encode(ref, add_special_tokens=False).ids)


def test_sure_borders_are_borders():
    """Counts of the two sides add up to that of the whole, whatever stands around."""
    from impactlake.llm.tokens import encoder

    e, rng = encoder(BYTE), random.Random(6)
    for _ in range(1500):
        text = "".join(rng.choices(["a", "it's", "'", "'ll", " ", "  ", "\n", "\t", "\u3000", "7", "½", "é", "e\u0301", "日本", "。", "!", "<|", "|>", "endoftext", "ß", "\u00a0", "Ⅷ", "😀"], k=rng.randrange(2, 9)))
        for i in range(1, len(text)):
            if token_counts.sure_border(text[:i], text[i:]):
                assert e.count(text[:i]) + e.count(text[i:]) == len(e.library.encode(text, add_special_tokens=False).ids), (text, i)


def test_segment_tree_random_edits():
    from impactlake.llm.tokens import encoder

    e, rng = encoder(BYTE), random.Random(11)
    for text in ["", " ", words(rng, 400), "a\n\n b  c\t" * 40, "<|endoftext|> x " * 30]:
        tree, ref = token_counts.SegmentTree(text, e.count), text
        for _ in range(40):
            start, deleted, new = rng.randint(-2, len(ref) + 2), rng.choice([0, 1, 7, 300]), rng.choice(["", " ", "x", " new words ", "\n", "<|endoftext|>", "'s 12"])
            tree.edit(start, deleted, new)
            start = min(max(0, start), len(ref))
            ref = ref[:start] + new + ref[start + deleted :]
            assert tree.now == ref and tree.tokens[1] == len(e.library.encode(ref, add_special_tokens=False).ids)


# -- 5 ------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home</a></header><nav><ul><li><a href=1>One</a></ul></nav>
<div id="cookie-notice">We use cookies on this site, please accept.</div><article><header><h1>Head &amp; line</h1></header><p>First <b>bo</b>ld, <a href=x>a link</a> in it.<br>Second line &lt;here&gt;.<p>Next one a &lt; b and a < c.
<script>if (a < b) document.write("<p>no</p>")</script><section class="comments"><p>I liked this, said a reader.</p></section></article><div class="ad">Buy now, buy here, buy cheap.</div><aside>Related things to read.</aside><form><label>Name</label><input></form><footer>&copy; me</footer>"""


def test_html_text(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<p>" + "Plain text without any frame goes here. " * 3), (5, "u", "<div>" * 3000 + "A deep sentence, quite long enough to count as text."), (6, "u", "<script>x"), (7, "u", "<nav>a<p>b")]
    out = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1]["text"] == "Head & line First bold, a link in it. Second line <here>. Next one a < b and a < c."
    assert [out[i]["text"] for i in (2, 3, 6, 7)] == ["", "", "", ""]
    assert out[4]["text"].startswith("Plain text") and out[5]["text"].startswith("A deep")
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


ARTICLE = "<article><h1>A title</h1><p>First sentence of the article, long enough to count.<p>Second sentence of the article, just as long as the first.</article>"
KEPT = "A title First sentence of the article, long enough to count. Second sentence of the article, just as long as the first."


@pytest.mark.parametrize("outer", ["class='site has-sidebar'", "id='page-with-nav'", "class=search-result-page", "class=no-comments", "class='social-policy'", "class='site has-header'", "id=footerless-comments-page"])
def test_html_text_in_named_wrappers(outer):
    menu, ad = "<nav><a href=1>One</a></nav>", "<div class='ad'>Buy now, buy here, buy cheap.</div>"
    assert html_text.main_text(f"<body><div {outer}>{menu}{ARTICLE}{ad}</div><footer>me</footer>") == KEPT
    plain = [html_text.main_text(f"<body>{menu}<div {x}>{ARTICLE.replace('article>', 'div>')}</div>{ad}<footer>me</footer>") for x in (outer, "class=x")]
    assert plain[0] == plain[1] and plain[0] in KEPT and "First sentence" in plain[0]
    assert html_text.main_text(f"<body><form action=/><div {outer}>{ARTICLE}</div></form>{ad}") == KEPT


def test_html_text_leaves_named_boilerplate_out():
    comments = "<section class='comments'><article><p>" + "I liked this a lot, said a reader at length. " * 9 + "</article></section>"
    cookies = "<div id='cookie-consent'>" + "<p>We use cookies on this site, please accept all of them now.</p>" * 9 + "</div>"
    assert html_text.main_text(f"<body>{cookies}{ARTICLE}{comments}") == KEPT
    assert html_text.main_text(f"<body>{ARTICLE.replace('</article>', comments + '</article>')}{cookies}") == KEPT


LONG = "This is a sentence of the text, long enough to be told from a menu by its words alone. And here is one more."


def test_the_cut_does_better_than_the_costs_alone():
    """Headings and short lines go with the text around them, a sentence among links with the links."""
    links = "".join(f"<p><a href={i}>Some other page {i}</a></p>" for i in range(6))
    page = f"<body><div>{links}</div><div><h2>Heading</h2><p>{LONG}</p><p>Figure 2</p><p>{LONG}</p></div><div>{links}<p>See our shop for more offers.</p>{links}</div>"
    assert html_text.main_text(page) == f"Heading {LONG} Figure 2 {LONG}"
    alone = html_text.main_text(page, smooth=0.0)
    assert "Figure 2" not in alone and "shop" in alone


def test_html_text_odd_attributes():
    page = f"<article><p class=it's>{LONG}</p><p title='a > b' id=x>{LONG}</p><p data-x=\"it's\">{LONG}</p></article>"
    assert html_text.main_text(page) == " ".join([LONG] * 3)
    assert html_text.main_text("<p title=\"never closed>" + LONG) == LONG
    assert html_text.main_text("<a " + 'x="y" ' * 5000) == ""


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><meta charset=utf-8><title>T</title><article>{}</article>",
        "<head><title>T</title><style>p{{}}</style><link rel=x><p></p><article>{}</article>",
        "<head><title>T</title> text in a head ends it <article>{}</article>",
        "<body><article><svg class=icon/>{}</article>",
        "<body><article><svg><path d='M0'/><title>icon</title></svg>{}</article>",
        "<body><svg><g><article>{}</article>",
        "<body><!--><article>{}</article>",
        "<body><!---><article>{}</article><!-- end",
        "<body><!-- a --!><article>{}</article>",
        "<body><article>{}<section id=responses><p>A reader says that this is a good text to read.</section></article>",
    ],
)
def test_html_text_of_odd_but_allowed_pages(page):
    assert html_text.main_text(page.format(f"<p>{LONG}</p>")).removeprefix("text in a head ends it ") == LONG


def test_html_text_inside_images():
    assert html_text.main_text(f"<article><svg><foreignObject><div>label</div></foreignObject></svg><p>{LONG}</p></article>") == LONG


def test_html_text_long_pages_and_clashing_names(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 4000 + "</article>"
    df = spark.createDataFrame([(1, "u", page, "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert html_text.extract(df).first()["text"] == " ".join([LONG] * 4000)


def test_min_cut_is_least():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 7)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda keep: sum(abs(g) for g, k in zip(gain, keep) if (g > 0) != k) + sum(w for a, b, w in edges if keep[a] != keep[b])
        assert cost(html_text.min_cut(gain, edges)) <= min(cost(k) for k in itertools.product([False, True], repeat=n)) + 1e-6


# -- 6 ------------------------------------------------------------------------------------------------------------


def test_language_id(spark, docs, no_docs):
    texts = {"en": "the quick brown fox and the lazy dog were walking through the old town with their friends", "fr": "le renard brun et le chien paresseux se promenaient dans la vieille ville avec leurs amis"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(texts[k].split(), k=30)), k) for i in range(60) for k in texts]
    train = written(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")
    learned = language_id.fit_dictionaries(train, F.col("text"), F.col("lang"))
    assert set(learned) == {"en", "fr"}
    found = language_id.identify(train.withColumn("language", F.lit(0)), learned)
    assert all(r["_language"]["lang_pred"] == r["lang"] and 0 <= r["_language"]["score"] <= 1 for r in found.collect())
    for r in language_id.identify(docs, learned).collect():
        if not r["text"] or not any(map(str.isalpha, r["text"])):
            assert tuple(r["language"]) == ("und", 0.0, True)
        else:
            assert r["language"]["lang_pred"] in learned
    assert language_id.fit_dictionaries(no_docs, F.col("text"), F.col("lang")) == {}
    assert language_id.identify(no_docs, learned).count() == 0


def test_language_id_equals_sizes_computed_one_by_one(spark, docs):
    import zstandard

    settings = language_id.Settings(block_bytes=100, sample_pieces=9, dictionary_bytes=900)
    rows = [(i, f"{w} " * 40 + "\n" + w * 3, k) for i, (w, k) in enumerate([("alpha beta", "a"), ("gamma Delta", "b"), ("épsilon zeta", "c"), ("beta alpha", "a")])]
    learned = language_id.fit_dictionaries(written(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs"), F.col("text"), F.col("lang"), settings)
    found = {(r["doc_id"], r["text"]): r["language"] for r in language_id.identify(docs, learned, settings=settings).collect()}
    for (_, text), got in found.items():
        if not text or not any(map(str.isalpha, text)):
            continue
        raw = (" " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ").split(" ")
        raw = " ".join(["", *[w for w in raw if w], ""]).encode()
        sizes = {}
        for k in sorted(learned):
            d = zstandard.ZstdCompressionDict(learned[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            one = zstandard.ZstdCompressor(level=settings.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[k] = sum(len(one.compress(raw[i : i + 100])) for i in range(0, len(raw), 100))
        first, second = sorted(sizes, key=lambda k: (sizes[k], k))[:2]
        assert got["lang_pred"] == first and got["rejected"] == (sizes[second] == sizes[first] or sizes[second] - sizes[first] < 0.01 * sizes[first])


def test_dictionaries_take_pieces_from_all_over_long_texts(spark):
    text = " ".join("".join(random.Random(i).choices("abcdefghij", k=7)) for i in range(40_000))
    learned = language_id.fit_dictionaries(written(spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "y"), (4, "zz", None)], "doc_id long, text string, lang string"), "docs"), F.col("text"), F.col("lang"))
    assert set(learned) == {"x"} and len(learned["x"]) > 100_000
    at = [text.find(w.decode()) / len(text) for w in learned["x"].split() if len(w) == 7]
    assert all(sum(lo <= x < lo + 0.1 for x in at) > 0.05 * len(at) for lo in (k / 10 for k in range(10)))


# -- 7 ------------------------------------------------------------------------------------------------------------


def test_url_filters(spark):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]
    urls = [None, "no scheme", "http://A.Example.com/en/x?q#f", "http://www.example.com/en/", "https://a.net/es/", "https://a.net/fr?x", "http://bad.org/1", "http://good.org/2", "http://com", "http://xexample.com/en/", "http://bad.org/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([("http://bad.org/p", 1)] * 60 + [("http://good.org/p", 0)] * 60 + [("http://other.de/p", 0)] * 40 + [(None, 1), ("http://good.org/", None)], "url string, bad int")
    out = {r["page_id"]: r for r in url_filters.judge_urls(pages, outcomes, rules).collect()}
    assert (out[2]["host"], out[2]["path"], out[2]["rule"], out[2]["verdict"]) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert [out[i]["rule"] for i in (0, 1, 3, 4, 5, 8, 9)] == [None, None, "www.example.com/en/", "net/es/", None, None, "com/"]
    assert [out[i]["verdict"] for i in (0, 6, 7, 10)] == ["allow", "block", "allow", "block"]
    assert url_filters.judge_urls(pages.limit(0), outcomes.limit(0), rules).count() == 0


# -- 8 ------------------------------------------------------------------------------------------------------------


def gram_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def linked_components(rows, t, width):
    sets = [gram_set(text, width) for _, text in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {r: min([x for x in g if x is not None], default=None) for r, g in groups.items()}
    return [(d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("t,width", [(Fraction(9, 10), 3), (Fraction(8, 10), 5), (Fraction(1, 2), 2)])
def test_ngram_join(spark, t, width):
    rng = random.Random(13)
    rows = [(r[0], r[1]) for r in sample_rows()]
    for group in range(6):
        base = words(rng, rng.choice([4, 12, 40, 150])).split(" ")
        for k in range(14):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(50)}"
            rows.append((1000 + group * 50 + k, " ".join(w).upper() if k % 3 == 0 else " ".join(w)))
    df = written(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "docs")
    out = ngram_join.jaccard_components(df, t, width)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == Counter(linked_components(rows, t, width))



def test_ngram_join_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    test_ngram_join(spark, Fraction(9, 10), 3)


def test_one_of_each(docs, no_docs):
    kept = ngram_join.one_of_each(docs, Fraction(8, 10), 5).collect()
    assert [c for c in kept[0].asDict()] == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept if r["text"] and r["text"].strip())
    want = {c for d, n, c in linked_components([(r["doc_id"], r["text"]) for r in docs.collect()], Fraction(8, 10), 5) if n}
    assert ids == sorted((False, c) for c in want)
    assert sum(1 for r in kept if not (r["text"] or "").strip()) == sum(1 for r in docs.collect() if not (r["text"] or "").strip())
    assert ngram_join.one_of_each(no_docs).count() == 0
    assert ngram_join.jaccard_components(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(pairs, "u long, v long").repartition(7)
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in pairs:
        if a is not None and root(a) != root(b):
            up[max(root(a), root(b))] = min(root(a), root(b))
    assert rows_of(components.components(df, "u", "v"), "node", "label") == Counter((x, root(x)) for x in up if root(x) != x)


# -- 9 ------------------------------------------------------------------------------------------------------------


def test_bpe(docs, no_docs):
    library = Tokenizer.from_file(WORD)
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[(r["doc_id"], len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert rows_of(bpe.encode_and_decode(docs, WORD), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.encode_and_decode(no_docs, WORD).count() == 0


def test_bpe_odd_texts(spark):
    library = Tokenizer.from_file(WORD)
    texts = ["İstanbul ΣΑΣ. éÁ, x", "it's I'LL. don't,\nyes", "<|startoftext|>A<|ENDOFTEXT|> b.", "a.b, c..., d!, e ,f .", " x y\x85z \x1c", "日本語。123 4", "🙂 🙂."]
    df = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    for r in bpe.encode_and_decode(df, WORD, full=True).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_words_without_ids(spark):
    library = Tokenizer.from_file(WORD)
    texts = ["a \u00a0 b", "a \u00a0", "\u3000", "\u2028 a \u3000 b \u00a0\u00a0 c", " \u00a0 a"]
    df = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    for r in bpe.encode_and_decode(df, WORD, full=True).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


# -- 10 -----------------------------------------------------------------------------------------------------------


def test_reputation_blocks_a_host_that_is_surely_worse(spark):
    """A planted host of bad pages is blocked, its clean neighbour, hosts without labels and odd urls are not; two-label suffixes are suffixes."""
    pages = [(i, f"https://{h}/p{i}") for i, h in enumerate(["spam.bad.com"] * 60 + ["fine.org"] * 60 + ["Other.NET:80"] * 60 + ["new.example"] * 3 + ["a.shop.co.uk", "b.books.co.uk"] * 30)] + [(900, None), (901, "no host"), (902, "https:///x")]
    bad = [(u, int(u is not None and ("spam.bad" in u or i % 10 == 0))) for i, u in pages if u is None or "new.example" not in u] + [("https://fine.org/x", None)]
    df, outcomes = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(bad, "url string, bad int")
    out = {r["page_id"]: r for r in url_filters.judge_urls(df.withColumn("host", F.lit("clash")), outcomes, []).collect()}
    assert {out[i]["verdict"] for i in range(60)} == {"block"}
    assert {out[i]["verdict"] for i in out if i >= 60} == {"allow"} and len(out) == len(pages)
    hosts = spark.createDataFrame([("a.shop.co.uk",), ("co.uk",), ("x",), ("www.a.b.com",), ("",)], "host string")
    got = [tuple(r) for r in hosts.select(url_filters.domain_of(F.col("host")), url_filters.suffix_of(F.col("host"))).collect()]
    assert got == [("shop.co.uk", "co.uk"), ("co.uk", "uk"), ("x", "x"), ("b.com", "com"), ("", "")]


def test_other_columns_may_clash(spark):
    """Extra columns with the names that operators use for themselves change nothing."""
    rng = random.Random(4)
    base = words(rng, 120)
    rows = [(i, t, "en") for i, t in enumerate([base, base + " x", words(rng, 90), None, "", base])]
    plain = written(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "docs")
    names = ("key", "c", "n", "h", "map", "u", "v", "label", "prefix", "piece", "start", "length", "rank", "part", "n_tokens", "ids_sha256", "component_id", "language", "repeats", "runs", "marks", "row_mark", "row_key", "sum", "docs", "words", "gram", "Text2")
    odd = written(plain.withColumns({c: F.lit(c) for c in names}), "docs")
    from fractions import Fraction

    for run in (lambda d: ngram_join.jaccard_components(d, Fraction(8, 10), 5), lambda d: packing.pack_documents(d, BYTE, 64, 2).drop("sequence_id", "offset"), lambda d: bpe.encode_and_decode(d, WORD)):
        assert Counter(map(tuple, run(plain).collect())) == Counter(map(tuple, run(odd).collect()))
    kept = ngram_join.one_of_each(odd, Fraction(8, 10), 5)
    assert kept.columns == odd.columns and kept.count() == 4
    assert rows_of(quality_rules.quality(odd).select("doc_id", "quality.n_words", "quality.kept"), "doc_id", "n_words", "kept") == rows_of(quality_rules.quality(plain).select("doc_id", "quality.n_words", "quality.kept"), "doc_id", "n_words", "kept")
    assert rows_of(suffix_dedup.without_repeats(odd, 64).select("doc_id", "_repeats.kept_sha256"), "doc_id", "kept_sha256") == rows_of(suffix_dedup.without_repeats(plain, 64).select("doc_id", "repeats.kept_sha256"), "doc_id", "kept_sha256")


def test_language_ties_and_long_texts(spark):
    learned = {"aa": b"some words of a language that is here " * 9, "bb": b"some words of a language that is here " * 9}
    rows = [(1, "some words of a language"), (1, "some words of a language"), (2, "words of a language " * 40_000)]
    got = [tuple(r["language"]) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), learned).orderBy("doc_id").collect()]
    assert got[0] == got[1] and all(x[0] == "aa" and x[2] for x in got)


def test_parity_maps_bound_overlaps():
    from fractions import Fraction

    rng = np.random.default_rng(5)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, int(rng.integers(10, 4000)), int(rng.integers(1, 900))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = ngram_join.parity_map(a), ngram_join.parity_map(b)
        size = min(len(x), len(y))
        odd = int(np.bitwise_count(ngram_join.folded(x, size) ^ ngram_join.folded(y, size)).sum())
        assert (len(a) + len(b) - odd) // 2 >= len(set(a.tolist()) & set(b.tolist()))
        if ngram_join.linked(ngram_join.overlap(a, b), len(a), len(b), Fraction(1, 2)):
            assert ngram_join.may_link(ngram_join.folded(x, size), ngram_join.folded(y, size), len(a), len(b), Fraction(1, 2))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 3
    vectors = [(i, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(3000)]
    vectors[10] = (10, vectors[20][1])
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None, 1.0]), (5004, []), (None, [1.0] * 16), (6000, [1.0, 2.0]), (6100, [1.0, 3.0])]
    df = written(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>"), "vectors")
    found = neighbours.search(df, F.col("vec_id") % 100 == 0, 10, neighbours.Settings(part_rows=500)).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    m = np.array([v for _, v in vectors])
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        assert sorted(got[q]) == list(range(1, 11))
        assert all(math.isclose(s, d[v], rel_tol=1e-12) for v, s in got[q].values())
        hit += len({v for v, _ in got[q].values()} & set(best.tolist()))
    assert hit / 300 >= 0.9
    assert got[6000] == {1: (6100, 1.0)} and set(got) == {*range(0, 3000, 100), 6000, 6100}
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_of_equal_vectors(spark):
    """Copies are ranked by id, a hot vector's bucket is dealt over several parts, repeated ids count once, other columns may clash."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4).round(1).tolist(), "x", 1.0) for i in range(900)]
    rows += [(0, rows[0][1], "again", 2.0), (7, [9.0, 9.0, 9.0, 9.0], "other", 0.0)]
    df = written(spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string, score double"), "vectors")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0, 10, neighbours.Settings(part_rows=100, query_rows=2)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    points = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows]
    hit = 0
    for q in range(0, 900, 100):
        best = {}
        for i, v in points:
            if i != q:
                best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - points[q][1]) ** 2).sum())))
        want = sorted(best.items(), key=lambda x: (x[1], x[0]))[:10]
        hit += len(set(want) & set(got[q]))
        if q % 3 == 0:
            assert got[q] == want
    assert hit / 90 >= 0.9 and len(got) == 9
