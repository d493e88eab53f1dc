"""Plans over vectors: redundant siblings, entity links, presence in a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from folium.functions import text as T
from folium.operators import vectors as V
from folium.operators.components import connected_components
from folium.plans.registry import Registry
from folium.plans.retrieval import _DOT, nearest, queries_of
from folium.sources.tables import table

QUERIES = Registry()
query = QUERIES.query
#: The corpus' vectors are far apart, so links are looked for above this cosine.
REDUNDANT = 0.3


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("run"), "embedding")


_PAIRS = f"""pairs AS (SELECT q.vec_id AS a, c.vec_id AS b FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id < c.vec_id AND round({_DOT}, 9) >= {REDUNDANT})"""


@query("j9_redundant_siblings", f"WITH {_PAIRS}, n AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id) SELECT vec_id AS id, coalesce(links, 0) AS links FROM embeddings LEFT JOIN n ON id = vec_id")
def redundant_siblings(spark, sf_dir):
    """Drafts of a run that are near others of it, with how many; both sides are flagged."""
    return V.link_counts(vectors(spark, sf_dir), REDUNDANT, block=64)


@query("j7_vector_clusters", f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id, min(root) AS cluster FROM r GROUP BY id""")
def vector_clusters(spark, sf_dir):
    """Clusters of a run's vectors that links above the threshold connect."""
    rows = vectors(spark, sf_dir)
    roots = connected_components(V.spanning_links(rows, REDUNDANT, block=64))
    return rows.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("cluster"))


@query("j14_source_presence", f"SELECT q.vec_id AS q, max(round({_DOT}, 9)) >= 0.4 AS present FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1")
def source_presence(spark, sf_dir):
    """Whether the best of a source's sentences is near enough to a claim."""
    return nearest(spark, sf_dir, 1).select("q", (F.col("cosine") >= 0.4).alias("present"))


@query("j12_retrieval_inference", f"""WITH s AS (SELECT q.vec_id AS q, c.vec_id AS c, round({_DOT}, 9) AS cosine FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, c) AS k FROM s)
SELECT q, arg_max(c, (c % 7) * 1000000000 - c) AS c, max(c % 7) / 10.0 AS entailment FROM r WHERE k <= 5 GROUP BY q""")
def retrieval_inference(spark, sf_dir):
    """Of a claim's five nearest chunks the one that entails it most (a stand-in scores by the id)."""
    from folium.operators.models import inference

    top = nearest(spark, sf_dir, 5)
    s = inference(F.col("c").cast("string"), F.col("q").cast("string"), lambda a, b: (int(a) % 7 / 10, 0.0, 0.0))
    return top.withColumn("e", s["entailment"]).groupBy("q").agg(F.max_by("c", F.struct("e", -F.col("c"))).alias("c"), F.max("e").alias("entailment"))


@query("f40_title_embedding", "SELECT p_partkey, CAST(1.0 AS DOUBLE) AS norm, 64::BIGINT AS n FROM part")
def title_embedding(spark, sf_dir):
    """A title as a unit vector of hashed words, where no encoder is configured."""
    v = T.hashed_vector(F.col("p_name"), 64)
    measured = T.bound(v, lambda v: F.struct(F.round(F.sqrt(T.dot(v, v)), 6).alias("norm"), F.size(v).cast("long").alias("n")))
    return table(spark, sf_dir, "part").select("p_partkey", measured.alias("m")).select("p_partkey", "m.norm", "m.n")


@query("j38_max_semantic", f"SELECT q.vec_id AS q, greatest(0.0, max(round({_DOT}, 9))) AS best FROM embeddings q JOIN embeddings c ON q.label = c.label AND q.vec_id <> c.vec_id AND c.vec_id % 3 > 0 WHERE q.vec_id % 100 = 0 GROUP BY 1")
def max_semantic(spark, sf_dir):
    """The best dot product of a claim with the long sentences of its own page (here: its label)."""
    rows = table(spark, sf_dir, "embeddings")
    asked = queries_of(rows).select(F.col("vec_id").alias("q"), "label", F.col("embedding").alias("a"))
    # The query set is a hundredth of the vectors; each task keeps one number a query.
    pairs = rows.where("vec_id % 3 > 0").select(F.col("vec_id").alias("c"), "label", F.col("embedding").alias("b")).join(asked, "label").where("q <> c")
    return pairs.groupBy("q").agg(F.greatest(F.lit(0.0), F.max(F.round(T.dot(F.col("a"), F.col("b")), 9))).alias("best"))


@query("w27_semantic_page", f"""WITH s AS (SELECT q.vec_id AS q, c.vec_id % 13 AS page, max(round({_DOT}, 9)) AS best FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT q, CASE WHEN max(best) >= 0.35 THEN arg_max(page, best) END AS page FROM s GROUP BY q""")
def semantic_page(spark, sf_dir):
    """The page whose best sentence is nearest to a quote, if it is near enough."""
    top = nearest(spark, sf_dir, 1).withColumn("page", F.col("c") % 13)
    return top.select("q", F.when(F.col("cosine") >= 0.35, F.col("page")).alias("page"))
