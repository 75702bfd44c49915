"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity within bands of the language.

The model is an interpolated modified Kneser-Ney model of order 5 over the texts' lower-cased characters (code points,
none of them folded together), one per language. Spark counts the n-grams of all texts, so the model grows with what
the corpus holds. All that concerns a character is known where the two characters before it are: n-grams are dealt by
these two, each part is built in one group and kept as sorted arrays of 64-bit hashes with log probabilities and
backoffs beside them. Tasks get the parts by broadcast, as many at once as MODEL_BYTES allows; if there are more,
texts are scored in several rounds, whose sums are added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlake.llm.common import ASCII_SPACE, WordHashes, bounded_batches, drop, free_name, mix64, schema_with, written

ORDER = 5
START = 2  # a control character stands before each text
SYMBOLS = b"#*$%&|<>"
#: Characters handled at once, n-grams of a part, bytes of the parts that are broadcast together.
SEGMENT, PART_GRAMS, MODEL_BYTES = 1 << 19, 250_000, 192 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Bands:
    """Documents are rejected whose log perplexity per word lies more than z * sigma / sqrt(words) from their language's median, or per character more than char_z * sigma / sqrt(characters).

    sigma is the robust spread (quartiles' distance over 1.349) of the language's (log perplexity - median) * sqrt(n),
    so it is the spread that its documents show at any length. A language of fewer than min_docs documents has its
    own median and the sigma of all documents about their languages' medians.
    """

    z: float = 4.0
    char_z: float = 6.0
    min_docs: int = 50
    bin_width: float = 0.002
    length_steps: int = 8  # a doubling of length


def hashed(chars: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points; rows of other lengths have other hashes."""
    key = np.full(len(chars), seed_of(chars.shape[1]))
    for j in range(chars.shape[1]):
        key = _step(key, chars[:, j])
    return key


def seed_of(length: int) -> np.uint64:
    return np.uint64((length + 1) * int(_M) & 0xFFFFFFFFFFFFFFFF)


def _step(key: np.ndarray, char: np.ndarray) -> np.ndarray:
    key = (key ^ char) * _M
    key ^= key >> np.uint64(31)
    return key


def part_of(before: np.ndarray, last: np.ndarray, parts: int) -> np.ndarray:
    """The part of a model that holds what follows these two characters."""
    return (mix64(before.astype(np.uint64) << np.uint64(32) | last.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def segments(texts: list[str]):
    """(texts' places, characters of each, stream, ends) of about SEGMENT characters: the n-gram of a character ends at its place in the stream."""
    held, n = [], 0
    pad = np.full(ORDER - 1, START, np.uint32)

    def out():
        lengths = np.array([len(x) for _, x in held]) - (ORDER - 1)
        ends = np.repeat(np.arange(1, len(held) + 1) * (ORDER - 1), lengths) + np.arange(lengths.sum())
        return np.array([i for i, _ in held]), lengths, np.concatenate([x for _, x in held]), ends

    for i, t in enumerate(texts):
        code = np.concatenate([pad, np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4")])
        for at in range(0, len(code) - ORDER + 1, SEGMENT):
            held.append((i, code[at : at + SEGMENT + ORDER - 1]))
            n += len(held[-1][1])
            if n >= SEGMENT:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def gram_keys(stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """hashed() of the n-gram that ends at each place."""
    key = np.full(len(ends), seed_of(ORDER))
    for back in range(ORDER - 1, -1, -1):
        key = _step(key, stream[ends - back])
    return key


def by_language(texts, langs):
    """The texts that are not null, with their places, language by language ('' for null)."""
    places: dict[str, list[int]] = {}
    for i, (t, lang) in enumerate(zip(texts, langs)):
        if t is not None:
            places.setdefault(lang or "", []).append(i)
    for lang, at in places.items():
        yield lang, at, [texts[i] for i in at]


class Counts:
    """Counts of n-grams in a table of fixed size; those whose slot is taken are kept aside, and handed out when they are many."""

    BITS, ASIDE = 18, 400_000
    SLOTS = 1 << BITS

    def __init__(self):
        self.keys, self.n = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int64)
        self.chars = np.zeros((self.SLOTS, ORDER), np.uint32)
        self.aside: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, stream: np.ndarray, ends: np.ndarray) -> None:
        key = gram_keys(stream, ends)
        slot = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        hit = self.keys[slot] == key
        self.n += np.bincount(slot[hit], minlength=self.SLOTS)
        key, first, n = np.unique(key[~hit], return_index=True, return_counts=True)
        chars = stream[ends[~hit][first][:, None] + np.arange(1 - ORDER, 1)]
        slot = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        free = self.n[slot] == 0
        free &= np.append(True, slot[1:] != slot[:-1])  # of two new ones with one slot the first gets it: keys are sorted
        self.keys[slot[free]], self.n[slot[free]], self.chars[slot[free]] = key[free], n[free], chars[free]
        self.aside.append((key[~free], chars[~free], n[~free]))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        key, chars, n = (np.concatenate(x) for x in zip(*self.aside))
        key, first, at = np.unique(key, return_index=True, return_inverse=True)
        n = np.bincount(at, n, len(key)).astype(np.int64)
        self.aside = [(key, chars[first], n)]
        return chars[first], n

    def many(self):
        """Those aside, if they are too many to keep."""
        if sum(len(x[0]) for x in self.aside) > self.ASIDE:
            chars, n = self.merged()
            if len(n) > self.ASIDE // 2:
                self.aside = []
                yield chars, n

    def rest(self):
        yield self.chars[self.n > 0], self.n[self.n > 0]
        if self.aside:
            yield self.merged()


def texts_of(chars: np.ndarray) -> list[str]:
    """Rows of code points as strings."""
    flat, width = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), chars.shape[1]
    return [flat[i : i + width] for i in range(0, len(flat), width)]


def chars_of(grams: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, width)


def count_ngrams(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """lang, gram, n: how often each n-gram of ORDER characters occurs in all texts of a language. Tasks emit counts, not occurrences."""
    bounded_batches(docs.sparkSession)

    def rows(lang_: str, found):
        for chars, n in found:
            for i in range(0, len(n), 50_000):
                grams = texts_of(chars[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n[i : i + 50_000], pa.int64())], ["lang", "gram", "n"])

    def count(batches):
        total: dict[str, Counts] = {}
        for batch in batches:
            for name, _, texts in by_language(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = total.setdefault(name, Counts())
                for _, _, stream, ends in segments(texts):
                    own.add(stream, ends)
                    yield from rows(name, own.many())
                if len(total) > 8:  # many languages: one table at a time
                    yield from rows(name, total.pop(name).rest())
        for name, own in total.items():
            yield from rows(name, own.rest())

    return docs.select(text.cast("string").alias("text"), lang.cast("string").alias("lang")).mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The discounts of counts 1, 2 and 3 or more, from how many n-grams have the counts 1 to 4."""
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5  # too few counts to estimate them
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.01), k - 0.01) for k, x in enumerate(d, 1))


def level(chars: np.ndarray, counts: np.ndarray, cuts: tuple[float, float, float], below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probabilities, contexts' hashes, contexts' backoffs) of one order's n-grams, all of each context; below are the shorter n-grams' probabilities."""
    cut = np.where(counts >= 3, cuts[2], np.where(counts >= 2, cuts[1], cuts[0]))
    context, at = np.unique(hashed(chars[:, :-1]), return_inverse=True)
    total = np.bincount(at, counts, len(context))
    gamma = np.bincount(at, cut, len(context)) / total
    return (counts - cut) / total[at] + gamma[at] * below, context, gamma


def sorted_arrays(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order and logarithms beside them."""
    keys, values = np.concatenate(keys), np.log(np.maximum(np.concatenate(values), 1e-12))
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Short:
    """Probabilities of single characters and pairs of a language; what is not there gets the share of unseen characters."""

    def __init__(self, ones: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], cuts: dict[int, tuple[float, float, float]]):
        chars, counts = ones
        share = 1.0 / (len(chars) + 1)
        p1, _, gamma = level(chars, counts, cuts[1], np.full(len(chars), share))
        self.unseen = float(np.log(gamma[0] * share))
        order = np.argsort(hashed(chars))
        below = p1[order][np.searchsorted(hashed(chars)[order], hashed(pairs[0][:, 1:]))]
        p2, context, gamma = level(*pairs, cuts[2], below)
        self.keys, self.logs = sorted_arrays([hashed(chars), hashed(pairs[0])], [p1, p2])
        self.back_keys, self.backs = sorted_arrays([context], [gamma])


def build(chars: np.ndarray, counts: np.ndarray, short: Short, cuts: dict[int, tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, logs, contexts' hashes, backoffs) of a part's n-grams of order 3 and more; lower orders count the distinct characters before an n-gram."""
    levels = {ORDER: (chars, counts.astype(float))}
    for n in range(ORDER - 1, 2, -1):
        longer = levels[n + 1][0][:, 1:]
        _, first, c = np.unique(hashed(longer), return_index=True, return_counts=True)
        levels[n] = (longer[first], c.astype(float))
    keys, values, back_keys, backs = [], [], [], []
    lower_keys, lower = short.keys, np.exp(short.logs.astype(float))
    for n in range(3, ORDER + 1):
        chars, counts = levels[n]
        p, context, gamma = level(chars, counts, cuts[n], lower[find(lower_keys, hashed(chars[:, 1:]))[0]])
        own = hashed(chars)
        order = np.argsort(own)
        lower_keys, lower = own[order], p[order]
        for out, x in ((keys, own), (values, p), (back_keys, context), (backs, gamma)):
            out.append(x)
    return (*sorted_arrays(keys, values), *sorted_arrays(back_keys, backs))


class Model:
    """Some parts of a language's model: Kneser-Ney log probabilities of n-grams and log backoffs of contexts."""

    def __init__(self, short: Short, parts: int, found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.short, self.parts, self.have = short, parts, np.zeros(parts, bool)
        self.have[list(found)] = True
        empty = [np.zeros(0, t) for t in (np.uint64, np.float32, np.uint64, np.float32)]
        arrays = [np.concatenate(x) for x in zip(empty, *found.values())]
        for at, names in ((0, ("keys", "logs")), (2, ("back_keys", "backs"))):
            order = np.argsort(arrays[at], kind="stable")
            for k, name in enumerate(names):
                setattr(self, name, arrays[at + k][order])

    def log_probabilities(self, chars: np.ndarray) -> np.ndarray:
        """Of each row's last character after the others."""
        out, todo = np.zeros(len(chars)), np.arange(len(chars))
        for n in range(ORDER, 0, -1):
            own = self if n > 2 else self.short
            g = chars[todo, -n:]
            at, hit = find(own.keys, hashed(g))
            out[todo[hit]] += own.logs[at[hit]]
            todo, g = todo[~hit], g[~hit]
            if n == 1:
                out[todo] += self.short.unseen
            elif len(todo):
                at, hit = find(own.back_keys, hashed(g[:, :-1]))
                out[todo[hit]] += own.backs[at[hit]]
        return out


class Scorer:
    """Sums of log probabilities of texts; what was looked up lately is at hand in a table of fixed size."""

    BITS = 18

    def __init__(self, models: dict[str, Model]):
        self.models, self.seen = models, {}

    def logs(self, lang: str, stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
        model = self.models[lang]
        if lang not in self.seen:
            if len(self.seen) >= 8:
                self.seen.clear()
            self.seen[lang] = (np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.float32))
        keys, values = self.seen[lang]
        key = gram_keys(stream, ends)
        slot = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        out, hit = values[slot].astype(np.float64), keys[slot] == key
        if not hit.all():
            miss = np.nonzero(~hit)[0]
            new, first, at = np.unique(key[miss], return_index=True, return_inverse=True)
            found = model.log_probabilities(stream[ends[miss[first]][:, None] + np.arange(1 - ORDER, 1)])
            out[miss] = found[at]
            slot = (new >> np.uint64(64 - self.BITS)).astype(np.int64)
            keys[slot], values[slot] = new, found
        return out

    def __call__(self, texts: list, langs: list) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log probabilities, NaN without a character or model; characters) over the parts at hand."""
        out, n = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64)
        for lang, at, own in by_language(texts, langs):
            if lang not in self.models:
                continue
            model, sums, counts = self.models[lang], np.zeros(len(own)), np.zeros(len(own), np.int64)
            for places, lengths, stream, ends in segments(own):
                row = np.repeat(places, lengths)
                if not model.have.all():
                    mine = model.have[part_of(stream[ends - 2], stream[ends - 1], model.parts)]
                    row, ends = row[mine], ends[mine]
                sums += np.bincount(row, self.logs(lang, stream, ends), len(own))
                counts += np.bincount(row, minlength=len(own))
            n[at], out[at] = counts, np.where(counts > 0, sums, np.nan)
        return out, n


def word_counts(texts: list) -> np.ndarray:
    return np.array([len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts], np.int64)


def fit_models(docs: DataFrame, text: Column, lang: Column, part_grams: int = PART_GRAMS, model_bytes: int = MODEL_BYTES) -> tuple[list, list[DataFrame]]:
    """(one model per language over all texts, as functions that load a round of parts of at most model_bytes (one part at least), tables to drop when all are loaded).

    The driver gets the pairs and single characters, five lines of counts of counts for each language, and the parts
    of one round at a time.
    """
    spark = docs.sparkSession
    levels = {ORDER: written(count_ngrams(docs, text, lang), "ngram-counts")}
    for n in range(ORDER - 1, 0, -1):  # distinct characters before an n-gram
        levels[n] = levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n"))
        if n == 3:
            levels[n] = written(levels[n], "ngram-counts")
    seen: dict[tuple[str, int], list[int]] = {}
    totals: dict[str, int] = {}
    for n, rows in levels.items():
        for r in rows.groupBy("lang", F.least("n", F.lit(5)).alias("c")).agg(F.count("*").alias("m")).collect():  # five rows a language
            seen.setdefault((r["lang"], n), [0] * 6)[r["c"]] = r["m"]
            if n == ORDER:
                totals[r["lang"]] = totals.get(r["lang"], 0) + r["m"]
    cuts = {name: {n: discounts(*seen[name, n][1:5]) for n in levels} for name in totals}
    short: dict[str, Short] = {}
    low = [{} for _ in range(3)]
    for n in (1, 2):
        table = levels[n].toArrow().to_pandas()
        for name, rows in table.sort_values(["lang", "gram"]).groupby("lang"):
            low[n][name] = (chars_of(rows["gram"].tolist(), n), rows["n"].to_numpy(float))
    short = {name: Short(low[1][name], low[2][name], cuts[name]) for name in totals}
    parts = {name: -(-n // part_grams) for name, n in totals.items()}
    if not totals:
        drop(levels[ORDER], levels[3])
        return [], []
    known = spark.sparkContext.broadcast((short, cuts))

    def deal(batches):
        for batch in batches:
            langs, grams = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            chars, out = chars_of(grams, ORDER), np.zeros(len(grams), np.int64)
            for name in set(langs.tolist()):
                own = langs == name
                out[own] = part_of(chars[own, -3], chars[own, -2], parts[name])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], ["lang", "gram", "n", "part"])

    def built(key: tuple, rows: pa.Table) -> pa.Table:
        name = key[0].as_py()
        found = build(chars_of(rows["gram"].to_pylist(), ORDER), rows["n"].to_numpy(), known.value[0][name], known.value[1][name])
        return pa.table([[name], [key[1].as_py()], *([x.tobytes()] for x in found)], names=["lang", "part", *ARRAYS])

    dealt = levels[ORDER].mapInArrow(deal, "lang string, gram string, n long, part long").groupBy("lang", "part").applyInArrow(built, "lang string, part long, " + ", ".join(f"{x} binary" for x in ARRAYS))
    model = written(dealt, "ngram-model")
    sizes = model.select("lang", "part", sum((F.octet_length(x) for x in ARRAYS), F.lit(0)).alias("size")).orderBy("lang", "part").collect()  # a row for PART_GRAMS n-grams
    rounds: list[list] = []
    room = 0
    for r in sizes:
        if room < r["size"] or not rounds:
            rounds.append([])
            room = model_bytes
        rounds[-1].append((r["lang"], r["part"]))
        room -= r["size"]

    def of_round(wanted: list) -> dict[str, Model]:
        found: dict[str, dict] = {}
        lang_, part = F.col("lang"), F.col("part")
        which = F.lit(False)
        for name in {x for x, _ in wanted}:
            which = which | ((lang_ == name) & part.isin([p for x, p in wanted if x == name]))
        for r in model.filter(which).collect():
            found.setdefault(r["lang"], {})[r["part"]] = tuple(np.frombuffer(r[x], t) for x, t in zip(ARRAYS, (np.uint64, np.float32, np.uint64, np.float32)))
        return {name: Model(short[name], parts[name], own) for name, own in found.items()}

    drop(levels[ORDER], levels[3])
    return [lambda own=own: of_round(own) for own in rounds], [model]


ARRAYS = ("hashes", "logs", "context_hashes", "backoffs")


def spread(x: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Median of x and distance of its quartiles, by weights n."""
    order = np.argsort(x, kind="stable")
    cum = np.cumsum(n[order])
    q1, q2, q3 = (float(x[order][np.searchsorted(cum, q * cum[-1])]) for q in (0.25, 0.5, 0.75))
    return q2, q3 - q1


def bands_of(rows, bands: Bands, width: float) -> dict[str, tuple[float, float]]:
    """lang -> (median, sigma) from a histogram (lang, bin, size, n) of log perplexities and lengths."""
    if not len(rows):
        return {}
    rows = rows.sort_values(["lang", "bin", "size"], ignore_index=True)
    x, root = (rows["bin"].to_numpy() + 0.5) * width, 2.0 ** (rows["size"].to_numpy() / (2 * bands.length_steps))
    n, at = rows["n"].to_numpy(), rows.groupby("lang").indices
    medians = {name: spread(x[i], n[i])[0] for name, i in at.items()}
    scaled = (x - rows["lang"].map(medians).to_numpy()) * root
    sigma = lambda i: max(spread(scaled[i], n[i])[1], width * float(np.average(root[i], weights=n[i]))) / 1.349
    pooled = sigma(np.arange(len(rows)))
    return {name: (medians[name], sigma(i) if n[i].sum() >= bands.min_docs else pooled) for name, i in at.items()}


def text_counts(texts: list, hashes: WordHashes) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    words: list[bytes] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        own = raw.split()
        words += own
        out["n_words"][i] = len(own)
        out["word_chars"][i] = len(text) - len(raw) + len(raw.translate(None, ASCII_SPACE))
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = raw.split(b"\n")
        if len(set(lines)) < len(lines):
            lines = [x for x in lines if x.strip(ASCII_SPACE)]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    out["n_repeat_words"] = repeat_words(words, out["n_words"], hashes)
    return out


def repeat_words(words: list[bytes], lengths: np.ndarray, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Words of each text that stand in a window of `width` words found twice or more in it."""
    hashes.trim()
    code = hashes.of(words)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    end = np.cumsum(lengths)
    start = np.arange(len(code) - width + 1)
    if not len(start):
        return np.zeros(len(lengths), np.int64)
    start = start[start + width <= end[doc[start]]]
    key = mix64(doc[start].astype(np.uint64))
    for k in range(width):
        key = mix64(key + code[start + k])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    a, b = start[order][1:][same], start[order][:-1][same]
    real = doc[a] == doc[b]
    for k in range(width):
        real &= code[a + k] == code[b + k]
    mark = np.zeros(len(code) + 1, np.int64)
    for x in (a[real], b[real]):
        x = np.unique(x)
        mark[x] += 1
        mark[x + width] -= 1
    covered = np.cumsum(mark[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(lengths))


def scored_in_rounds(docs: DataFrame, text: Column, lang: Column, rounds: list) -> DataFrame:
    """text key and language, sum, n: each distinct text's sum of log probabilities over all rounds."""
    own = docs.select(_text_key(text).alias("key"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"), text.cast("string").alias("text")).filter("text is not null")
    parts = []
    for models in rounds:
        now = docs.sparkSession.sparkContext.broadcast(models())

        def score(batches, now=now):
            scorer = Scorer(now.value)
            for batch in batches:
                sums, n = scorer(batch.column(2).to_pylist(), batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.nan_to_num(sums)), pa.array(n), pa.array(word_counts(batch.column(2).to_pylist()))], ["key", "lang", "sum", "n", "words"])

        part = own.mapInArrow(score, "key binary, lang string, sum double, n long, words long").groupBy("key", "lang").agg(*(F.first(x).alias(x) for x in ("sum", "n", "words")))
        parts.append(written(part, "ngram-scores"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = written(every.groupBy("key", "lang").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.first("words").alias("words")), "ngram-scores")
    drop(*parts)
    return out


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string")))


def fit_bands(scored: DataFrame, bands: Bands) -> list[dict[str, tuple[float, float]]]:
    """What bands_of() makes of the log perplexities per word and per character, from histograms of (lang, sum, n, words, docs)."""
    out = []
    for size, width in (("words", 5 * bands.bin_width), ("n", bands.bin_width)):
        cells = scored.filter(f"n > 0 and {size} > 0").groupBy("lang", F.floor(F.col("sum") / -F.col(size) / width).alias("bin"), F.round(bands.length_steps * F.log2(F.col(size).cast("double"))).cast("long").alias("size"))
        out.append(bands_of(cells.agg(F.sum("docs").alias("n")).toArrow().to_pandas(), bands, width))  # some ten thousand cells a language
    return out


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bands: Bands = Bands(), min_words: int = 10, max_repeat_percent: int = 20, part_grams: int = PART_GRAMS, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """docs with a struct column `quality` (further underscores if the name is taken).

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity (per word, null
    without a word), base_failed, kept. A null or empty text has no words, fails the base rules and is not kept. A
    null language is a language of its own. Repeated rows are judged alike; an empty table gives no rows. Very long
    texts are scored whole, SEGMENT characters at a time. docs must be a stored table: it is read three times.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text, lang = docs[text_col], docs[lang_col]
    rounds, tables = fit_models(docs, text, lang, part_grams, model_bytes)
    name, sum_name, n_name = free_name(docs, "quality", "sum", "n")
    if len(rounds) > 1:  # more parts than fit at once: scores are joined to their texts
        scores = scored_in_rounds(docs, text, lang, rounds)
        keyed = docs.select(_text_key(text).alias("key"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang")).groupBy("key", "lang").agg(F.count("*").alias("docs"))
        limits = fit_bands(scores.join(keyed, ["key", "lang"]), bands)
        on = (F.col("_s.key") == _text_key(text)) & (F.col("_s.lang") == F.coalesce(lang.cast("string"), F.lit("")))
        rows = docs.join(scores.alias("_s"), on, "left").select(*[docs[c] for c in docs.columns], F.col("_s.sum").alias(sum_name), F.col("_s.n").alias(n_name))
        models = None
        drop(*tables)
    else:
        models = spark.sparkContext.broadcast(rounds[0]() if rounds else {})
        drop(*tables)

        def score(batches):
            scorer = Scorer(models.value)
            for batch in batches:
                texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                sums, n = scorer(texts, langs)
                yield pa.RecordBatch.from_arrays([pa.array([x or "" for x in langs], pa.string()), pa.array(np.nan_to_num(sums)), pa.array(n), pa.array(word_counts(texts))], ["lang", "sum", "n", "words"])

        scores = written(docs.select(text.cast("string").alias("text"), lang.cast("string").alias("lang")).mapInArrow(score, "lang string, sum double, n long, words long"), "ngram-scores")
        limits = fit_bands(scores.withColumn("docs", F.lit(1)), bands)
        drop(scores)
        rows = docs
    at_text, at_lang, places = docs.columns.index(text_col), docs.columns.index(lang_col), len(docs.columns)
    fields = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("log_perplexity", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]

    def judge(batches):
        scorer, hashes = Scorer(models.value if models else {}), WordHashes()
        for batch in batches:
            texts, langs = ([None if x is None else str(x) for x in batch.column(i).to_pylist()] for i in (at_text, at_lang))
            c = text_counts(texts, hashes)
            if models:
                sums, n = scorer(texts, langs)
            else:
                sums, n = (np.array([x or 0 for x in batch.column(places + k).to_pylist()], t) for k, t in ((0, float), (1, np.int64)))
            with np.errstate(invalid="ignore", divide="ignore"):
                c["log_perplexity"] = np.where(c["n_words"] > 0, -sums / c["n_words"], np.nan)
                per_char = np.where(n > 0, -sums / n, np.nan)
            c["base_failed"] = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
            outside = np.zeros(len(texts), bool)
            for own, x, size, z in zip(limits, (c["log_perplexity"], per_char), (c["n_words"], n), (bands.z, bands.char_z)):
                centre, sigma = (np.array([own.get(x or "", (0.0, np.inf))[k] for x in langs], float) for k in (0, 1))
                with np.errstate(invalid="ignore"):
                    outside |= np.abs(x - centre) > z * sigma / np.sqrt(np.maximum(size, 1))
            c["kept"] = ~c["base_failed"] & ~outside
            column = pa.StructArray.from_arrays([pa.array(c[k], t, from_pandas=True) for k, t in fields], [k for k, _ in fields])
            yield pa.RecordBatch.from_arrays([*batch.columns[:places], column], [*batch.schema.names[:places], name])

    kinds = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}
    return rows.mapInArrow(judge, schema_with(docs, name, ", ".join(f"{k} {kinds[t]}" for k, t in fields)))
