"""CodeGraph: the engine's operations on one dataset, with free arguments. Every method gives a DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators import deadcode, evaluation, imports, passes, readers, resolve, retrieval, search, traversal, walks
from codeloom.operators.hierarchy import hierarchy
from codeloom.operators.index import SearchIndex
from codeloom.operators.store import GraphStore, delete_files
from codeloom.plans.scratch import Scratch
from codeloom.sources import extract


class CodeGraph:
    """Opens the tables of a folder; nothing runs before a result is read, loops apart."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, GraphStore(spark, folder)

    def _ids(self, ids: Iterable[str] | DataFrame) -> DataFrame:
        return ids.select("id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")

    def _scratch(self) -> Scratch:
        return Scratch(self.spark, "graph")

    # Reads

    def stats(self) -> DataFrame:
        return readers.distributions(self.store)

    def nodes(self, kinds: Iterable[str] = (), languages: Iterable[str] = (), path: str = "", name: str = "") -> DataFrame:
        """Nodes by kinds, languages, a part of the path, a part of the name; an empty argument asks nothing."""
        rows = self.store.nodes
        for column, wanted in (("kind", [*kinds]), ("language", [*languages])):
            rows = rows.where(F.col(column).isin(*wanted)) if wanted else rows
        rows = rows.where(F.lower("file_path").contains(path.lower())) if path else rows
        return rows.where(F.lower("name").contains(name.lower())) if name else rows

    def nodes_by_ids(self, ids) -> DataFrame:
        return self.store.nodes.join(self._ids(ids), "id", "left_semi")

    def nodes_in_file(self, path: str) -> DataFrame:
        return self.store.nodes.where(F.col("file_path") == path).orderBy("start_line", "id")

    def nodes_by_name(self, name: str) -> DataFrame:
        return self.store.nodes.where(F.col("name") == name).orderBy("file_path", "start_line", "id")

    def files(self, glob: str | None = None) -> DataFrame:
        return self.store.files if glob is None else self.store.files.where(F.col("path").rlike(X.glob_pattern(glob)))

    def outgoing(self, ids, kinds: Iterable[str] = ()) -> DataFrame:
        return self._edges(kinds).join(self._ids(ids).withColumnRenamed("id", "source"), "source", "left_semi")

    def incoming(self, ids, kinds: Iterable[str] = ()) -> DataFrame:
        return self._edges(kinds).join(self._ids(ids).withColumnRenamed("id", "target"), "target", "left_semi")

    def _edges(self, kinds: Iterable[str] = ()) -> DataFrame:
        kinds = [*kinds]
        return self.store.edges.where(F.col("kind").isin(*kinds)) if kinds else self.store.edges

    # Traversals

    def walk(self, ids, depth: int = 3, kinds: Iterable[str] = (), backwards: bool = False) -> DataFrame:
        """(root, id, depth) within a depth, over edges of the kinds, forwards or backwards."""
        return traversal.reach(self._ids(ids), traversal._links(self._edges(kinds), backwards), depth, self._scratch())

    def callers(self, ids, depth: int = 1) -> DataFrame:
        return self.walk(ids, depth, traversal.USES, True).where("root <> id")

    def callees(self, ids, depth: int = 1) -> DataFrame:
        return self.walk(ids, depth, traversal.USES).where("root <> id")

    def ancestors(self, ids, depth: int = 32) -> DataFrame:
        return self.walk(ids, depth, ("contains",), True).where("root <> id")

    def children(self, ids) -> DataFrame:
        return self.outgoing(ids, ("contains",)).select(F.col("source").alias("id"), F.col("target").alias("child")).distinct()

    def shortest(self, start: str, goal: str, depth: int = 12, kinds: Iterable[str] = ()) -> DataFrame:
        """The length of the shortest way, no row if there is none."""
        return self.walk([start], depth, kinds).where(F.col("id") == goal)

    def file_dependents(self, paths: Iterable[str], depth: int = 1) -> DataFrame:
        links = readers.file_pairs(self.store).select(F.col("t_file_path").alias("a"), F.col("s_file_path").alias("b"))
        return traversal.reach(self._ids(paths), links, depth, self._scratch()).where("root <> id")

    def affected_tests(self, changed: Iterable[str], depth: int = 5) -> DataFrame:
        """Changed tests and tests that depend on changed files."""
        changed = [*changed]
        reached = self.file_dependents(changed, depth).select(F.col("id").alias("path")).unionByName(self._ids(changed).select(F.col("id").alias("path")))
        return reached.where(X.is_test_path(F.col("path"))).distinct()

    def circular_files(self) -> DataFrame:
        return traversal.strong_components(self.store, self._scratch()).where("n_files > 1")

    def dead_code(self) -> DataFrame:
        return traversal.simple_dead_code(self.store, self._scratch())

    def hierarchy(self, what: str = "roots") -> DataFrame:
        """Containment: roots and depths, paths, descendants or cycles."""
        links = self.store.edges.where("kind = 'contains'").select("source", "target")
        return hierarchy(links, self._scratch(), what)

    def dead_code_report(self) -> DataFrame:
        """(id, reason) of all unused symbols: one of 17 reasons that spare them, or dead."""
        return deadcode.report(self.store, self._scratch())

    def routes(self) -> DataFrame:
        return walks.routes(self.store)

    def file_neighbours(self, path: str) -> DataFrame:
        """Files that a file depends on and files that depend on it."""
        pairs = readers.file_pairs(self.store)
        into = pairs.where(F.col("t_file_path") == path).select(F.col("s_file_path").alias("path"), F.lit("dependent").alias("direction"))
        return into.unionByName(pairs.where(F.col("s_file_path") == path).select(F.col("t_file_path").alias("path"), F.lit("dependency").alias("direction"))).distinct()

    def synthesized_edges(self) -> DataFrame:
        return passes.merged_passes(self.store)

    def extracted(self) -> dict[str, DataFrame]:
        """Symbols, containment and references of the stored texts."""
        texts = self.store.raw("source_files").select("path", "language", "content").distinct()
        return {"nodes": extract.extract(texts), "edges": extract.extract_containment(texts), "references": extract.extract_references(texts)}

    def imports(self) -> DataFrame:
        return imports.imports(self.store)

    def metadata(self) -> DataFrame:
        return evaluation.index_metadata(self.store)

    def listing(self) -> str:
        """The tree of files, as text; for the paths of one repository, not of a corpus."""
        return evaluation.render_tree([r[0] for r in self.store.files.select("path").toLocalIterator()])

    # Search and resolution

    def search(self, text: str, limit: int = 20, kinds: Iterable[str] = (), languages: Iterable[str] = ()) -> DataFrame:
        """Ranked hits; substrings where no token matches."""
        nodes = self.nodes(kinds, languages)
        terms = search.search_terms(text)
        if not terms:
            return nodes.orderBy("name", "id").limit(limit).select("id", F.lit(1.0).alias("score"))
        return search.bm25(nodes, terms).orderBy(F.desc("score"), "id").limit(limit)

    def search_index(self) -> SearchIndex:
        """Postings written once, for many searches."""
        return SearchIndex.build(self.store.nodes, self._scratch())

    def find(self, text: str, limit: int = 20) -> DataFrame:
        """A search with fields (kind:, lang:, path:, name:); without text the names in order."""
        fields = retrieval.parse_query(retrieval.normal_spelling(text))
        nodes = self.store.nodes.where(retrieval.field_filter(fields))
        terms = search.search_terms(fields["text"])
        if not terms:
            return nodes.select("id", F.lit(1.0).alias("score"), "name").orderBy("name", "id").limit(limit).select("id", "score")
        return search.bm25(nodes, terms).orderBy(F.desc("score"), "id").limit(limit)

    def resolve(self, least: float = 0.5) -> DataFrame:
        return resolve.new_edges(self.store, least)

    def without_files(self, paths: Iterable[str]) -> dict[str, DataFrame]:
        """The four tables after files and what hangs on them are deleted."""
        return delete_files(self.store, self._ids(paths).withColumnRenamed("id", "path"))
