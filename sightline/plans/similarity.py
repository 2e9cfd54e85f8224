"""Queries on nearest vectors."""

from pyspark.sql import functions as F

from sightline.operators.semantic import InvertedFile
from sightline.plans.registry import query
from sightline.session import work_path


def embedding_index(t):
    return InvertedFile.build(t.embeddings, work_path(t.spark, "inverted-file"))


@query("semantic_exact", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(q.e, c.e), 9) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank, id, round(score, 6) AS score
FROM s QUALIFY rank <= 10""")
def _(t):
    found = embedding_index(t).nearest(t.embeddings, 10, exact=True)
    return found.withColumn("score", F.round("score", 6))


@query("semantic_nearest")
def _(t):
    """Multi-probe only; its recall is measured in the tests."""
    return embedding_index(t).nearest(t.embeddings.filter("vec_id % 20 = 0"), 10)
