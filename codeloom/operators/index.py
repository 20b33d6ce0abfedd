"""A search index: postings of all words of nodes, written once and read by the ranges of a query's terms.

Postings are sorted by term, so a query's prefixes reach the scan as filters and skip all row groups
but theirs. A node's length and the corpus counts stand beside them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.readers import count_rows
from codeloom.operators.search import _BM25, B, K1, TERMS, WEIGHTS, search_terms, tokens
from codeloom.operators.store import GraphStore, with_sql
from codeloom.plans.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class SearchIndex:
    """Postings (term, id, tf) with tf weighted by field, lengths (id, len), and the corpus totals."""

    def __init__(self, postings: DataFrame, lengths: DataFrame) -> None:
        self.postings, self.lengths = postings, lengths
        totals = lengths.agg(count_rows().alias("n"), F.avg("len").alias("avg")).first()
        self.n, self.average = totals["n"], totals["avg"] or 1.0

    @staticmethod
    def build(nodes: DataFrame, scratch: Scratch) -> SearchIndex:
        fields = nodes.select("id", *(tokens(F.col(c)).alias(c) for c in WEIGHTS))
        sized = fields.select("id", sum((F.size(c) for c in WEIGHTS), F.lit(0)).cast("double").alias("len"))
        said = None
        for column, weight in WEIGHTS.items():
            part = fields.select("id", F.explode(column).alias("term"), F.lit(weight).alias("w"))
            said = part if said is None else said.unionByName(part)
        postings = said.groupBy("term", "id").agg(F.sum("w").alias("tf"))
        return SearchIndex(scratch.spool(postings.repartitionByRange("term").sortWithinPartitions("term")), scratch.spool(sized))

    def search(self, text: str) -> DataFrame:
        """(id, score) of nodes that hold a word starting with a term of the text, by BM25."""
        rows = None
        for term in search_terms(text):
            part = self.postings.where(F.col("term").startswith(term)).select(F.lit(term).alias("asked"), "id", "tf")
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            return self.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
        hits = rows.groupBy("asked", "id").agg(F.sum("tf").alias("tf"))
        frequency = hits.groupBy("asked").agg(count_rows().alias("df"))
        idf = F.greatest(F.log((F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / self.average))
        return hits.join(frequency, "asked").join(self.lengths, "id").groupBy("id").agg(F.sum(part).alias("score"))


def j08_index_search(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """The best nodes by the index, joined with what is shown of them."""
    g = GraphStore(spark, sf_dir)
    found = SearchIndex.build(g.nodes, Scratch(spark, "j08")).search(" ".join(TERMS)).select("id", F.round("score", 6).alias("score"))
    top = found.orderBy(F.desc("score"), "id").limit(limit)
    return top.join(g.nodes.select("id", "name", "file_path"), "id").select("id", "name", "file_path", "score")


QUERIES["j08_index_search"] = j08_index_search
ORACLE["j08_index_search"] = with_sql("SELECT t.id, n.name, n.file_path, t.score FROM (SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 100) t JOIN n USING (id)", False, _BM25)
