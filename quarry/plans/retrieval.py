"""Retrieval jobs: text and vector ranking, FK-graph expansion,
and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import bfs
from quarry.operators.text import tfidf_topk as _tfidf
from quarry.operators.vectors import centroids, knn
from quarry.plans.registry import query
from quarry.session import materialise
from quarry.sources.tables import Tables

TFIDF_K = 5
VECTOR_K = 10
FALLBACK_TOP = 50        # candidates ranked before the filter
FALLBACK_KEEP = 3
EXPAND_HOPS = 2
EXPAND_TOTAL = 25        # nodes of a bounded expansion, seeds included

_TOK = r"regexp_split_to_array(lower({t}), '[^\p{{L}}]+')"


def _tfidf_sql(k: int, asked: str = "benchmark") -> str:
    return f"""
dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format(t='text')}) AS term FROM documents)
       WHERE term <> '' GROUP BY 1, 2),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
df AS (SELECT term, count(*) AS df FROM dt GROUP BY term),
dw AS (SELECT dt.doc_id, dt.term, dt.tf * ln(1.0 + nd.n / df.df) AS w FROM dt JOIN df USING (term), nd),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TOK.format(t='text')}) AS term FROM {asked})
       WHERE term <> '' GROUP BY 1, 2),
qw AS (SELECT qt.item_id, qt.term, qt.tf * ln(1.0 + nd.n / df.df) AS w FROM qt JOIN df USING (term), nd),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY item_id),
s AS (SELECT qw.item_id, dw.doc_id, sum(qw.w * dw.w) AS dot FROM qw JOIN dw USING (term) GROUP BY 1, 2),
r AS (SELECT s.item_id, s.doc_id, round(s.dot / (qn.norm * dn.norm), 6) AS score
      FROM s JOIN qn USING (item_id) JOIN dn USING (doc_id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
        WHERE rank <= {k})"""


def _tfidf_top(t: Tables, k: int) -> DataFrame:
    return _tfidf(t.documents, "doc_id", "text", t.benchmark, "item_id", "text", k)


@query("tfidf_topk", "R-TFIDF", "WITH " + _tfidf_sql(TFIDF_K) + " SELECT item_id, doc_id, score, rank FROM top")
def tfidf_topk(t: Tables):
    """Top-5 documents per benchmark item by TF-IDF cosine over the whole corpus."""
    return _tfidf_top(t, TFIDF_K)


_ASKED_SQL = """(SELECT item_id, text FROM benchmark
  UNION ALL SELECT -1 - item_id, CAST(item_id AS VARCHAR) FROM benchmark)"""


@query("retrieve_fallback", "R-FALLBACK", "WITH " + _tfidf_sql(FALLBACK_TOP, _ASKED_SQL) + f""",
f AS (SELECT item_id, doc_id, rank FROM top WHERE score > 0),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE doc_id IS NOT NULL)
SELECT item_id, doc_id, rank FROM f
UNION ALL SELECT a.item_id, d.doc_id, d.rank FROM {_ASKED_SQL} a, d WHERE d.rank <= {FALLBACK_KEEP}
  AND NOT EXISTS (SELECT 1 FROM f WHERE f.item_id IS NOT DISTINCT FROM a.item_id)""")
def retrieve_fallback(t: Tables):
    """Of the best 50 keep those that score above zero; a query with none gets the first
    three documents. Half of the queries are numbers, which no document's words match."""
    asked = t.benchmark.select("item_id", "text").unionByName(
        t.benchmark.select((-1 - F.col("item_id")).alias("item_id"), F.col("item_id").cast("string").alias("text")))
    return with_fallback(_tfidf(t.documents, "doc_id", "text", asked, "item_id", "text", FALLBACK_TOP), asked,
                         t.documents, FALLBACK_KEEP)


def with_fallback(top: DataFrame, asked: DataFrame, docs: DataFrame, keep: int) -> DataFrame:
    """(item_id, doc_id, rank): the ranked rows that score above zero, and for every query
    without one the ``keep`` first documents by id."""
    found = materialise(top.filter("score > 0").select("item_id", "doc_id", "rank"))
    first = docs.select("doc_id").filter("doc_id is not null").orderBy("doc_id").limit(keep)
    first = first.agg(F.array_sort(F.collect_list("doc_id")).alias("d")).scalar()       # ``keep`` ids
    hit = found.select(F.col("item_id").alias("_hit")).distinct()
    none = asked.select("item_id").distinct().join(hit, F.col("item_id").eqNullSafe(F.col("_hit")), "left_anti")
    rest = none.select("item_id", F.posexplode(first).alias("n", "doc_id"))
    return found.unionByName(rest.select("item_id", "doc_id", (F.col("n") + 1).cast("long").alias("rank")))


VECTOR_SQL = f"""
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e)
      GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY label),
s AS (SELECT c.label, e.vec_id,
             round(list_dot_product(e.v, c.c) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(c.c, c.c))), 6)
               AS score
      FROM c, e),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= {VECTOR_K})"""


def _centroids(t: Tables) -> DataFrame:
    """One written row per label: its mean vector and its number of vectors."""
    return materialise(centroids(t.embeddings, "label", "embedding"))


@query("vector_topk", "R-VECTOR", "WITH " + VECTOR_SQL + " SELECT label, vec_id, score, rank FROM top")
def vector_topk(t: Tables):
    """Ten nearest embeddings (cosine) to every label centroid."""
    q = _centroids(t).withColumnRenamed("label", "centroid")
    top = knn(t.embeddings, "vec_id", "embedding", q, "centroid", "c", VECTOR_K)
    return top.withColumnRenamed("centroid", "label").select("label", "vec_id", "score", "rank")


def _metrics(t: Tables) -> DataFrame:
    """Per query (label): hits = |retrieved n gold|, gold = vectors of that label. A retrieved
    vector carries its own label, so the embeddings are read for the centroids and for
    the ranking only."""
    q = _centroids(t).withColumnRenamed("label", "centroid")
    top = knn(t.embeddings, "vec_id", "embedding", q, "centroid", "c", VECTOR_K, ("label",))
    per = top.groupBy("centroid").agg(F.count(F.lit(1)).alias("n_ret"),
                                      F.count_if(F.col("label") == F.col("centroid")).alias("hits"))
    gold = q.select("centroid", F.col("n").alias("n_gold"))
    return gold.join(per, "centroid")


_METRICS_SQL = "WITH " + VECTOR_SQL + """,
m AS (SELECT g.label, g.n_gold, r.n_ret, coalesce(h.hits, 0) AS hits
      FROM (SELECT label, count(*) AS n_gold FROM embeddings GROUP BY label) g
      JOIN (SELECT label, count(*) AS n_ret FROM top GROUP BY label) r USING (label)
      LEFT JOIN (SELECT top.label, count(*) AS hits FROM top JOIN embeddings e
                 ON e.label = top.label AND e.vec_id = top.vec_id GROUP BY top.label) h USING (label))"""


@query("set_recall", "R-SETRECALL", _METRICS_SQL +
       " SELECT round(avg(CASE WHEN hits = n_gold THEN 1.0 ELSE 0.0 END), 6) AS set_recall, count(*) AS n_queries FROM m")
def set_recall(t: Tables):
    """Share of queries whose retrieved set covers the whole gold set (U-SUBSET by counts)."""
    return _metrics(t).agg(F.round(F.avg((F.col("hits") == F.col("n_gold")).cast("double")), 6).alias("set_recall"),
                           F.count(F.lit(1)).alias("n_queries"))


@query("table_recall", "R-TABLERECALL", _METRICS_SQL +
       " SELECT round(avg(CAST(hits AS DOUBLE) / n_gold), 6) AS table_recall FROM m")
def table_recall(t: Tables):
    return _metrics(t).agg(F.round(F.avg(F.col("hits").cast("double") / F.col("n_gold")), 6).alias("table_recall"))


@query("precision_at_k", "R-PRECISION", _METRICS_SQL +
       " SELECT round(avg(CAST(hits AS DOUBLE) / n_ret), 6) AS precision_at_k FROM m")
def precision_at_k(t: Tables):
    return _metrics(t).agg(F.round(F.avg(F.col("hits").cast("double") / F.col("n_ret")), 6).alias("precision_at_k"))


def _node(kind: str, key) -> F.Column:
    return F.concat(F.lit(kind + ":"), key.cast("string"))


@query("fk_expand", "R-EXPAND", """
WITH seeds AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
h1 AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey IN (SELECT c_custkey FROM seeds)),
h2c AS (SELECT c_custkey AS k FROM customer
        WHERE c_nationkey IN (SELECT k FROM h1) AND c_custkey NOT IN (SELECT c_custkey FROM seeds)),
h2s AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey IN (SELECT k FROM h1))
SELECT 0 AS hop, 'customer' AS kind, CAST(c_custkey AS BIGINT) AS node_key FROM seeds
UNION ALL SELECT 1, 'nation', CAST(k AS BIGINT) FROM h1
UNION ALL SELECT 2, 'customer', CAST(k AS BIGINT) FROM h2c
UNION ALL SELECT 2, 'supplier', CAST(k AS BIGINT) FROM h2s""")
def fk_expand(t: Tables):
    """Grow a node set along FK edges (customer-nation-supplier), two hops,
    from the customers with a negative balance."""
    seeds = t.customer.filter(F.col("c_acctbal") < 0).select(_node("customer", F.col("c_custkey")).alias("node"))
    return _nodes(bfs(seeds, _fk_edges(t), EXPAND_HOPS))


def _fk_edges(t: Tables) -> DataFrame:
    """customer - nation and supplier - nation, both directions."""
    cn = t.customer.select(_node("customer", F.col("c_custkey")).alias("src"), _node("nation", F.col("c_nationkey")).alias("dst"))
    sn = t.supplier.select(_node("supplier", F.col("s_suppkey")).alias("src"), _node("nation", F.col("s_nationkey")).alias("dst"))
    fwd = cn.unionByName(sn)
    return fwd.unionByName(fwd.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _nodes(v: DataFrame) -> DataFrame:
    parts = F.split("node", ":")
    return v.select(F.col("hop").cast("int").alias("hop"), parts[0].alias("kind"),
                    parts[1].cast("long").alias("node_key"))


@query("fk_expand_bounded", "R-EXPAND", f"""
WITH RECURSIVE f AS (
  SELECT 'customer:' || c_custkey AS a, 'nation:' || c_nationkey AS b FROM customer WHERE c_nationkey IS NOT NULL AND c_custkey IS NOT NULL
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL AND s_suppkey IS NOT NULL),
e AS (SELECT a, b FROM f UNION SELECT b, a FROM f),
r(node, hop) AS (SELECT 'supplier:' || s_suppkey, 0 FROM supplier WHERE s_suppkey <= 2
                 UNION SELECT e.b, r.hop + 1 FROM r JOIN e ON e.a = r.node WHERE r.hop < 4),
v AS (SELECT node, min(hop) AS hop FROM r GROUP BY node)
SELECT hop::INT AS hop, split_part(node, ':', 1) AS kind, split_part(node, ':', 2)::BIGINT AS node_key
FROM (SELECT * FROM v ORDER BY hop, node LIMIT {EXPAND_TOTAL})""")
def fk_expand_bounded(t: Tables):
    """Growth from the first two suppliers, at most ``EXPAND_TOTAL`` nodes in all: nearer
    nodes first, within a hop by name."""
    seeds = t.supplier.filter(F.col("s_suppkey") <= 2).select(_node("supplier", F.col("s_suppkey")).alias("node"))
    return _nodes(bfs(seeds, _fk_edges(t), max_hops=4, max_total=EXPAND_TOTAL))


@query("fk_hops", "R-HOPS", f"""
WITH RECURSIVE e AS (SELECT DISTINCT c.c_nationkey AS a, s.s_nationkey AS b
                     FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
                     JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
                     WHERE c.c_nationkey IS NOT NULL AND s.s_nationkey IS NOT NULL),
ue AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, hop) AS (SELECT 0, 0 UNION SELECT ue.b, r.hop + 1 FROM r JOIN ue ON ue.a = r.node WHERE r.hop < (SELECT count(*) FROM nation))
SELECT CAST(node AS BIGINT) AS nation, CAST(min(hop) AS BIGINT) AS hops FROM r GROUP BY node""")
def fk_hops(t: Tables):
    """FK distance between nations: edge a-b when a customer of a bought from a
    supplier of b; BFS from nation 0."""
    # lines become distinct (order, supplier nation) pairs before they meet the orders
    li = (t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
          .join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey").select("o_orderkey", "s_nationkey").distinct())
    oc = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")) \
        .join(t.customer.select("c_custkey", "c_nationkey"), "c_custkey")
    # written: both directions of the edges read it
    pairs = materialise(li.join(oc, "o_orderkey")
                        .select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct())
    edges = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seeds = t.dim("nation").filter(F.col("n_nationkey") == 0).select(F.col("n_nationkey").alias("node"))
    v = bfs(seeds, edges)
    return v.select(F.col("node").cast("long").alias("nation"), F.col("hop").cast("long").alias("hops"))
