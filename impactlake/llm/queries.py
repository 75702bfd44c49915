"""The operators' queries over the driver's tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlake.llm import bpe, divergence, html_text, language_id, neighbours, ngram_join, packing, quality_rules, simhash, suffix_dedup, token_counts, url_filters, variants
from impactlake.llm.common import crc_mod

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.quality(docs).select("doc_id", "quality.*")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passages: passages of 50 words or more that occur twice, which may be shorter than 400 bytes and then stay."""
    docs = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=400, mark_words=50)
    found = F.col("repeats")
    n = lambda c: F.size(found[c]).cast("long")
    return docs.select("doc_id", found["n_bytes"].alias("n_bytes"), found["n_removed"].alias("n_removed"), n("spans").alias("n_spans"), found["kept_sha256"].alias("kept_sha256"), n("passages").alias("n_passages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits; chars_encoded is what the edits made it encode again."""
    path = vocabulary("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", token_counts.sample_edits(F.col("text")))
    edited = token_counts.apply_edits(token_counts.build_trees(docs, path), path, "edits", with_state=False)
    return edited.select("doc_id", "n_tokens", "tokens_after", "chars_encoded")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.fit_dictionaries(docs.filter(crc_mod(F.col("doc_id"), 3) != 1), F.col("text"), F.col("lang"))
    return language_id.identify(docs.select("doc_id", "text"), learned).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled bad if its label (same id) says toxic or not of quality."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    bad = ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("long")
    outcomes = pages.join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id").select("url", "bad")
    return url_filters.judge_urls(pages, outcomes, RULES)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), Fraction(90, 100), width=3)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), radius=2, width=3, seed=42)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"), least=5, shortest=6, factor=5, one_in=199)


_OPERATORS = (
    op1_quality_rules, op2_suffix_dedup, op3_best_fit_packing, op4_token_counts, op5_html_text, op6_language_id, op7_url_filters,
    op8_ngram_join, op9_bpe, op10_neighbours, op11_divergence, op12_simhash_dedup, op13_spelling_variants,
)
QUERIES = {f.__name__: f for f in _OPERATORS}


def _url_filter_sql() -> str:
    """op7 in DuckDB's SQL, with the operator's default parameters."""
    p = url_filters.Reputation()
    rho = lambda of: f"SELECT 1 / least({p.rho_max}, greatest({p.rho_min}, coalesce(sum(n * pow(k / n - prior, 2) - prior * (1 - prior)) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), {p.rho_min}))) - 1 AS w FROM {of}"
    ordered = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda text: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*text.split("/", 1))
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in ordered) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in ordered) + " END"
    return f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
      h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
      hosts AS (SELECT DISTINCT host, regexp_extract(host, '{url_filters.domain_pattern(p)}', 0) AS domain, regexp_extract(host, '{url_filters.domain_pattern(p)}', 2) AS suffix FROM h WHERE host <> ''),
      own AS (SELECT host, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS k FROM h JOIN labels ON doc_id = page_id JOIN hosts USING (host) GROUP BY host),
      overall AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM own),
      s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m) AS prior FROM own, overall GROUP BY suffix), sw AS ({rho('s0')}), s AS (SELECT suffix, (w * prior + k) / (w + n) AS mean FROM s0, sw),
      d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(mean) AS prior FROM own JOIN s USING (suffix) GROUP BY domain), dw AS ({rho('d0')}), d AS (SELECT domain, (w * prior + k) / (w + n) AS mean FROM d0, dw),
      o0 AS (SELECT host, n, k, mean AS prior FROM own JOIN d USING (domain)), ow AS ({rho('o0')}),
      post AS (SELECT hosts.host, w + coalesce(n, 0) AS size, (w * coalesce(d.mean, s.mean, m) + coalesce(k, 0)) / (w + coalesce(n, 0)) AS mean FROM hosts CROSS JOIN ow CROSS JOIN overall LEFT JOIN own ON own.host = hosts.host LEFT JOIN d ON d.domain = hosts.domain LEFT JOIN s ON s.suffix = hosts.suffix),
      blocked AS (SELECT host FROM post WHERE mean - {p.z} * sqrt(mean * (1 - mean) / (size + 1)) > (SELECT m FROM overall) + {p.excess})
      SELECT page_id, host, path, {rule} AS rule, coalesce({ruled}, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM h"""


def _islands(rows: str, width: int) -> str:
    """Maximal ranges that windows of a width starting at rows(doc_id, i) cover."""
    new = f"SELECT doc_id, i, CAST(coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {width}, true) AS INTEGER) AS new FROM {rows}"
    return f"SELECT doc_id, min(i) AS lo, max(i) + {width} AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ({new})) GROUP BY doc_id, g"


_SPACES = r"'[ \t\n\x0B\x0C\r]+'"


def _suffix_dedup_sql() -> str:
    """op2 in DuckDB's SQL: all windows of 400 bytes and of 50 words counted."""
    twice = lambda rows: f"SELECT doc_id, i FROM {rows} WHERE h IN (SELECT h FROM {rows} GROUP BY h HAVING count(*) > 1)"
    return f"""WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, list_filter(string_split_regex(coalesce(text, ''), {_SPACES}), lambda x: x <> '') AS w FROM documents),
      bw AS (SELECT doc_id, i, md5(raw[i + 1 : i + 400]) AS h FROM (SELECT doc_id, raw, unnest(range(octet_length(raw) - 399)) AS i FROM b)), br AS ({twice("bw")}),
      ww AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM b)), wr AS ({twice("ww")}),
      s AS ({_islands("br", 400)}), p AS (SELECT doc_id, count(*) AS n FROM ({_islands("wr", 50)}) GROUP BY doc_id),
      c AS (SELECT doc_id, count(*) AS n, sum(hi - lo) AS gone, list(lo ORDER BY lo) AS lows, list(hi ORDER BY lo) AS highs FROM s GROUP BY doc_id),
      k AS (SELECT b.doc_id, raw, coalesce(n, 0) AS n, coalesce(gone, 0) AS gone, CASE WHEN n IS NULL THEN [raw] ELSE list_transform(range(n + 1), lambda j: raw[CASE WHEN j = 0 THEN 1 ELSE highs[j] + 1 END : CASE WHEN j = n THEN octet_length(raw) ELSE lows[j + 1] END]) END AS parts FROM b LEFT JOIN c USING (doc_id))
      SELECT k.doc_id, octet_length(raw) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, k.n AS n_spans, sha256(list_reduce(parts, lambda x, y: x || y)) AS kept_sha256, coalesce(p.n, 0) AS n_passages FROM k LEFT JOIN p USING (doc_id)"""


def _ngram_join_sql() -> str:
    """op8 in DuckDB's SQL: overlaps of all pairs that share a shingle, then reachability."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, '{url_filters.UPPER}', '{url_filters.LOWER}'), {_SPACES}), lambda x: x <> '') AS w FROM documents),
      s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
      c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
      e AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * i >= 90 * (cx.n + cy.n - i)),
      b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
      r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.node = b.x)
      SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(node) AS component_id FROM r LEFT JOIN c USING (doc_id) GROUP BY doc_id"""


def _divergence_sql() -> str:
    """op11 in DuckDB's SQL: every kept term of every group, zeros included, pair by pair."""
    p = lambda n, of: f"1 + (1000000000 * ({n} + 5)) // ({of})"
    return f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{url_filters.UPPER}', '{url_filters.LOWER}') AS text FROM documents),
      t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
      k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
      l AS (SELECT lang, sum(n) AS total, count(*) AS v FROM k GROUP BY lang),
      g AS (SELECT DISTINCT lang, source FROM d),
      c AS (SELECT g.lang, g.source, k.term, k.n AS all_n, coalesce(o.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY ALL) o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
      s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
      p AS (SELECT c.lang, c.source, c.term, c.n, {p("c.n", "s.total + 5 * l.v")} AS p, {p("c.all_n", "l.total + 5 * l.v")} AS q FROM c JOIN s ON s.lang = c.lang AND s.source = c.source JOIN l ON l.lang = c.lang),
      f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
      x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
      y AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM x UNION ALL SELECT * FROM y))
      SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""


def _variants_sql() -> str:
    """op13 in DuckDB's SQL: crc32 by its table, near words by equal words with a letter left out or any letter in a place."""
    return f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
      r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{url_filters.UPPER}', '{url_filters.LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
      d AS (SELECT doc_id, run, count(*) AS n, concat(doc_id, ':', run) AS s FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
      b AS (SELECT run, n, flatten(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN unicode(s[i]) < 128 THEN [unicode(s[i])] ELSE [192 | (unicode(s[i]) >> 6), 128 | (unicode(s[i]) & 63)] END)) AS bytes FROM d),
      h AS (SELECT run, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], bytes), lambda c, x: xor(tab[xor(c & 255, x) + 1], c >> 8)), 4294967295) AS h FROM b, crc),
      e AS (SELECT n, CASE WHEN h % 199 = 0 THEN run[1 : CAST(h % length(run) AS BIGINT)] || run[CAST(h % length(run) AS BIGINT) + 2 : length(run)] ELSE run END AS word FROM h),
      w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
      o AS (SELECT word, i, word[1 : i - 1] AS a, word[i + 1 : length(word)] AS z FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
      x AS (SELECT l.word AS a, r.word AS b FROM o l JOIN o r ON l.i = r.i AND l.a = r.a AND l.z = r.z AND l.word <> r.word UNION SELECT o.word, w.word FROM o JOIN w ON w.word = o.a || o.z UNION SELECT w.word, o.word FROM o JOIN w ON w.word = o.a || o.z),
      m AS (SELECT x.a AS word, count(*) AS n_near, arg_min(struct_pack(form := x.b, n := w.n), struct_pack(k := -w.n, e := encode(x.b))) AS best FROM x JOIN w ON w.word = x.b GROUP BY x.a),
      f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * w.n THEN best.form END AS form, CASE WHEN best.n >= 5 * w.n THEN best.n END AS form_n FROM w LEFT JOIN m USING (word)),
      s AS (SELECT word, word AS at, 0 AS steps FROM f UNION ALL SELECT s.word, f.form, steps + 1 FROM s JOIN f ON f.word = s.at WHERE f.form IS NOT NULL)
      SELECT f.word, f.form, (SELECT arg_max(s.at, s.steps) FROM s WHERE s.word = f.word) AS root, f.n, f.n_near, f.form_n FROM f"""


#: The others cannot be had in SQL (perplexities, tokens, compressed sizes, cuts, XXH64, approximate search); tests/llm has brute force for them.
ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": _suffix_dedup_sql(), "op7_url_filters": _url_filter_sql(), "op8_ngram_join": _ngram_join_sql(), "op11_divergence": _divergence_sql(), "op13_spelling_variants": _variants_sql(),
}
