"""The operators over the fixture tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (best_fit, bpe, exact_dedup, html_text, itq, jaccard, lm, packing, ranked_search, substring,
                        token_counts, toxicity, variants)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_itq_near_dup", """
WITH RECURSIVE x AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, e.v FROM r JOIN e ON r.t = e.u),
c AS (SELECT s, min(t) AS component_id FROM r GROUP BY s),
n AS (SELECT u, count(*) AS n_links FROM e GROUP BY u)
SELECT m.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m JOIN c ON c.s = m.vec_id LEFT JOIN n ON n.u = m.vec_id
""")
def op1_itq_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query("op2_prefix_bpe")
def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(ids, path).select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op3_ordinal_toxicity")
def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return (toxicity.severity(docs, model).drop("text")
            .withColumn("rejected", F.col("p_toxic") >= toxicity.REJECT))


@_query("op4_multi_order_jaccard", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i + 4], 'string_agg', ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT r.s, b.v FROM r JOIN b ON r.t = b.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.t) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.s = d.doc_id GROUP BY 1, 2
""")
def op4_multi_order_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_table(spark, sf_dir, "documents")).drop("node")


@_query("op5_bloom_exact_dedup", """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
""")
def op5_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


@_query("op6_block_tree_text")
def op6_block_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (html_text.extract(_table(spark, sf_dir, "pages"))
            .withColumn("n_chars", F.char_length("text").cast("long")))


@_query("op7_suffix_automata", r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
           FROM documents),
s AS (SELECT doc_id, i, list_aggregate(ws[i:i + 34], 'string_agg', ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
m AS (SELECT doc_id, list(k) AS gone, count(*) AS n_removed FROM c GROUP BY doc_id),
j AS (SELECT w.doc_id, ws, coalesce(n_removed, 0) AS n_removed, coalesce(gone, []) AS gone FROM w LEFT JOIN m USING (doc_id))
SELECT doc_id, len(ws) AS n_words, n_removed,
       sha256(coalesce(list_aggregate(list_filter(ws, lambda x, k: NOT list_contains(gone, k)), 'string_agg', ' '), ''))
         AS kept_sha256 FROM j
""")
def op7_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@_query("op8_backoff_automaton")
def op8_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


@_query("op9_binary_packing")
def op9_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op10_pretoken_counts")
def op10_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"),
                                       public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@_query("op11_partenum_variants", r"""
WITH RECURSIVE
crc AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY 1, 2),
byte AS (SELECT doc_id, w, n, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
            ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS s FROM run WHERE length(w) >= 5),
hash AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, s),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]::BIGINT)), 4294967295) AS h FROM byte, crc),
word AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0
    THEN substring(w, 1, (h % length(w))::INT) || substring(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hash)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, unnest(list_distinct(list_transform(range(1, length(word) + 1),
  lambda i: substring(word, 1, i - 1) || substring(word, i + 1)))) AS c FROM word),
gap AS (SELECT word, n, unnest(list_transform(range(1, length(word) + 1),
  lambda i: substring(word, 1, i - 1) || '*' || substring(word, i + 1))) AS g FROM word),
near AS (SELECT c.word AS word, w.word AS near, w.n AS m FROM cut c JOIN word w ON c.c = w.word
  UNION ALL SELECT w.word, c.word, c.n FROM cut c JOIN word w ON c.c = w.word
  UNION ALL SELECT a.word, b.word, b.n FROM gap a JOIN gap b ON a.g = b.g AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM near GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form,
  CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM word w LEFT JOIN best USING (word)),
path AS (SELECT word, word AS r FROM form UNION ALL SELECT p.word, f.form FROM path p JOIN form f ON f.word = p.r
  WHERE f.form IS NOT NULL)
SELECT f.word, f.form, p.r AS root, f.n, f.n_near, f.form_n FROM form f JOIN path p USING (word)
JOIN form e ON e.word = p.r WHERE e.form IS NULL
""")
def op11_partenum_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


@_query("op12_certified_packing")
def op12_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query("op13_blocked_search", r"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
tot AS (SELECT count(*) AS cn, sum(n)::BIGINT AS cl FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot GROUP BY term, cn),
imp AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * cn) // cl)) AS v
        FROM tf JOIN len USING (doc_id), tot),
sc AS (SELECT item_id, doc_id, sum(w.w * imp.v)::BIGINT AS score FROM it JOIN w USING (term) JOIN imp USING (term)
       GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10
""")
def op13_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))
