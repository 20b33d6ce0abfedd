"""Generated, minified or vendored source files.

Method: thresholds on layout statistics, tuned per language: longest and mean line, shares of
white space, of words outside of literals, of numbers, and of encoded runs. With them
the evidence that needs no layout: the flag of the files table, conventional names and folders,
notices in the head of a text, sizes above 1 MiB, and texts of known third-party files whatever
their header comment, indentation and line ends.

All statistics are expressions of the planner; texts never leave the JVM. The third-party
texts are joined by a hash of the normalised text.

Defined results: the current row of a path is the one with the greatest indexed_at, ties by
the greatest flag and size; null paths are ignored; a null flag says nothing; empty or missing
texts say nothing; a null language has the default thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.tables import table

MAX_SIZE = 1 << 20
HEAD_LINES = 60
HEAD_CHARS = 8192
# Names and folders of tool output and of dependencies, as whole path segments in lower case.
TOOL_FOLDERS = "generated __generated__ _generated generated-sources generated-src generated_sources autogen auto-generated autogenerated gen gen-src src-gen codegen-out __pycache__ .next .nuxt".split()
DEPENDENCY_FOLDERS = "vendor node_modules bower_components jspm_packages web_modules third_party third-party thirdparty 3rdparty 3rd_party 3rd-party external externals godeps pods carthage site-packages dist-packages .venv venv virtualenv .tox .bundle deps _vendor vendored".split()
TOOL_NAMES = r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw|\.validate|\.micro)?\.[a-z]{1,4}|_pb\.[jt]s|_grpc_pb\.[jt]s|_pb_service\.[jt]s|\.pulsar\.go|_grpc\.pb\.go|OuterClass\.java|Grpc\.java|[._-](?:generated|gen|autogen|g)\.[A-Za-z]{1,5}|_generated\.[a-z]{1,4}|\.g\.[a-z]{1,4}|\.designer\.[a-z]{1,3}|\.freezed\.dart|_string\.go|(?:^|/)zz_generated\.[\w.]+|(?:^|/)(?:mock_\w+|\w+_mock|mocks)\.go|\.min\.[mc]?[jt]s|-min\.[mc]?js|\.bundle\.[mc]?[jt]s|\.chunk\.[mc]?js|\.packed\.js)$"
NOTICE = (
    r"(?im)^[ \t]*(?:/\*+!?|//[/!]*|#+|\*|\"{3}|--|<!--|;+)[ \t!]*(?:"
    r"<auto-?generated\s*/?>|@generated\b|@?code[- ]generated\b.{0,40}\bby\b|code generated (?:by|from)\b|(?:this (?:file|code|class|source)(?: \w+)? (?:is|was|has been) )?auto(?:matically)?[- ]?generated (?:by|from|with|using|via|/?>)\b|(?:this (?:file|code|class|module) (?:is|was|has been) (?:machine |tool |auto[- ]?)?(?:generated|produced|created|written|emitted|compiled) (?:automatically|by|from|with|using)\b)|this file is (?:auto-?|machine-?)?generated\b|(?:auto-?|machine-?)generated (?:file|code|source)?\b.{0,40}\b(?:by|from|do not)\b|generated (?:by|from|with|using) (?:the |a )?\S+.{0,60}(?:do not|compiler|from\b|version|v?\d+\.\d+|$)|machine-?(?:written|made|generated) (?:by|from)\b|(?:produced|emitted|created|built|compiled) by \S+.{0,60}(?:overwritten|discarded|lost|do not edit)|!+ ?(?:output|product) of \S+.{0,80}\btemplate\b|(?:source|input|schema): ?\S+\s+(?:tool|generator): ?\S+.{0,60}(?:discarded|lost|overwritten)"
    r"|.{0,80}(?:manual|hand|any|your|local)? ?(?:changes|edits|modifications)[^\n]{0,30}(?:will be|are|get) (?:lost|overwritten|discarded)"
    r"|[^\n\"'`=]{0,60}\bgenerated\b[^\n]{0,80}\bdo not (?:edit|modify|change|touch)\b)"
)
#: Mentions that are no notices. Fixed values.
NO_NOTICE = r"maintained by hand|written by hand|hand-?written|generated names are|auto-generated method stub|is generated by the nightly|report is generated"
#: Languages whose comments begin with #; the others have // and /* */.
HASH_LANGUAGES = ("python", "py", "ruby", "rb", "shell", "sh", "bash", "yaml", "yml", "toml", "perl", "r", "makefile", "dockerfile")
_BLOCK = r"\"{3}(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"{3}|'{3}(?:[^'\\]++|\\.|'(?!''))*+'{3}"
_STRINGS = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`"
_COMMENTS = {True: rf"#[^\n]*+|(?m:^)[ \t]*+(?:{_BLOCK})", False: r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/"}
#: Strings and comments in one pass: whichever begins first hides the other's marks.
_MARKED = {True: rf"(?s){_COMMENTS[True]}|({_BLOCK}|{_STRINGS})", False: rf"(?s){_COMMENTS[False]}|({_STRINGS})"}
_NUMBERS = r"(?<![A-Za-z_])[-+]?(?:0[xX][0-9a-fA-F]++|\d[\d_]*+(?:\.\d++)?(?:[eE][-+]?\d++)?)[uUlLfFn]*+"
LEAST_DATA, LEAST_MINIFIED = 300, 400
#: Thresholds by language, set by hand between the two kinds of files, which lie far apart: in the 5,863 texts of sf0.1
#: hand-written ones have at least 0.12 white space, mean lines of at most 83 and 0.26 words outside of literals,
#: minified ones at most 0.03 white space and mean lines of at least 427, data at most 0.02 words. A minified text has
#: a smaller share of white space, a greater longest line, a greater mean line; data has a smaller share of words
#: outside of literals, or a greater share of numbers with at most twice that of words.
LIMITS = {
    "python": (0.06, 400, 200, 0.12, 0.70),  # keeps its indentation and line ends
    "javascript": (0.08, 300, 150, 0.12, 0.70),
    "typescript": (0.08, 300, 150, 0.12, 0.70),
    "java": (0.09, 350, 150, 0.11, 0.70),
    "go": (0.07, 350, 150, 0.12, 0.70),
    "rust": (0.08, 350, 170, 0.12, 0.70),
    "c": (0.09, 350, 150, 0.11, 0.75),
    "default": (0.08, 350, 150, 0.11, 0.70),
}
#: Least share of encoded runs in data.
ENCODED_SHARE = 0.5
ENCODED_RUN = 400


#: The comments and blank lines before the first line of code, however many.
LEADING = r"(?s)\A(?:\s++|//[^\n]*+|#[^\n]*+|--[^\n]*+|;[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/|<!--(?:[^-]++|-(?!->))*+-->|\"{3}(?:[^\"]++|\"(?!\"\"))*+\"{3})*+"


def hash_comments(language: Column, path: Column) -> Column:
    """Whether # begins a comment, by language or, where that is unknown, by the path's extension."""
    named = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    return F.when(named.isin("", "unknown"), F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.(\w+)$", 1)).isin(*HASH_LANGUAGES)).otherwise(named.isin(*HASH_LANGUAGES))


def _without(text: Column, hashes: Column, patterns: dict[bool, str], kept: str = "") -> Column:
    return F.when(hashes, F.regexp_replace(text, patterns[True], kept)).otherwise(F.regexp_replace(text, patterns[False], kept))


def fingerprint(text: Column, hashes: Column) -> Column:
    """The hash of a text without comments, indentation, blank lines and line ends.

    All comments go, not only the one at the head, in one pass that needs no stack however long
    they are; null where nothing is left.
    """
    body = F.regexp_replace(_without(text, hashes, _MARKED, "$1"), r"\s+", "")
    return F.when(F.length(body) > 0, F.sha2(body, 256))


def layout(text: Column, hashes: Column) -> dict[str, Column]:
    """Layout statistics of a text. Shares of code, numbers and letters are of its characters outside of comments and white space."""
    size = F.length(text)
    lines = F.split(text, "\n")
    body = F.length(F.regexp_replace(_without(text, hashes, _MARKED, "$1"), r"\s+", ""))
    bare = F.regexp_replace(_without(text, hashes, _MARKED), r"\s+", "")
    code = F.regexp_replace(bare, _NUMBERS, "")
    words = F.length(F.regexp_replace(code, r"[^\p{L}\p{N}_$]+", ""))
    runs = F.regexp_extract_all(text, F.lit(rf"([A-Za-z0-9+/=_-]{{{ENCODED_RUN},}}+)"), F.lit(1))
    return {
        "n_chars": size,
        "longest_line": F.array_max(F.transform(lines, F.length)),
        "mean_line": F.try_divide(size, F.size(lines)),
        "space_share": F.try_divide(size - F.length(F.regexp_replace(text, r"\s+", "")), size),
        "word_share": F.try_divide(words, body),
        "number_share": F.try_divide(F.length(bare) - F.length(code), body),
        "encoded_share": F.try_divide(F.aggregate(runs, F.lit(0), lambda n, x: n + F.length(x)), body),
    }


def _limit(language: Column, at: int) -> Column:
    out = F.lit(LIMITS["default"][at])
    for name, limits in LIMITS.items():
        if name != "default":
            out = F.when(language == name, F.lit(limits[at])).otherwise(out)
    return out


def _text_column(df: DataFrame, name: str) -> Column:
    """A column of a table, null where the table has none of the name."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)


def classify(files: DataFrame, source_files: DataFrame, upstream: DataFrame) -> DataFrame:
    """path, reason for every current file that nobody wrote by hand; the first of the reasons that hold."""
    newest = F.max(F.struct("indexed_at", F.coalesce("generated", F.lit(False)).alias("generated"), "size", F.lower("language").alias("language"))).alias("r")
    current = files.where("path is not null").groupBy("path").agg(newest).select("path", "r.generated", "r.size", "r.language")
    folders = F.slice(F.split(F.lower("path"), "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    texts = source_files.where("path is not null and content is not null").select("path", _text_column(source_files, "language"), "content")
    hashes = hash_comments(F.col("language"), F.col("path"))
    comments = F.regexp_extract("content", LEADING, 0)
    lines = F.substring_index(F.substring("content", 1, HEAD_CHARS), "\n", HEAD_LINES)
    head = F.regexp_replace(F.when(F.length(comments) > F.length(lines), comments).otherwise(lines), "\r", "")
    said = F.regexp_replace(head, "(?im)^.*(?:" + NO_NOTICE + ").*$", "").rlike(NOTICE)
    judged = texts.select("path", said.alias("notice"), fingerprint(F.col("content"), hashes).alias("print"), *(c.alias(n) for n, c in layout(F.col("content"), hashes).items()))
    copies = upstream.where("content is not null").select(_text_column(upstream, "path"), _text_column(upstream, "language"), "content")
    known = copies.select(fingerprint(F.col("content"), hashes).alias("print")).where("print is not null").distinct().withColumn("known", F.lit(True))
    # Texts without a print get one of their own, which nothing has: null keys would all meet in one task.
    judged = judged.withColumn("print", F.coalesce("print", F.concat(F.lit("path:"), "path"))).join(known, "print", "left")
    # Repeated rows of a path: any of them counts.
    judged = judged.groupBy("path").agg(F.max("notice").alias("notice"), F.max("known").alias("known"), *(F.max(n).alias(n) for n in ("n_chars", "longest_line", "mean_line", "number_share", "encoded_share")), *(F.min(n).alias(n) for n in ("space_share", "word_share")))
    rows = current.join(judged, "path", "left")
    limit = lambda at: _limit(F.col("language"), at)
    literal = (F.col("word_share") < limit(3)) | ((F.col("number_share") >= limit(4)) & (F.col("word_share") < 2 * limit(3))) | (F.col("encoded_share") >= ENCODED_SHARE)
    data = (F.col("n_chars") >= LEAST_DATA) & literal
    minified = (F.col("n_chars") >= LEAST_MINIFIED) & (F.col("space_share") < limit(0)) & (F.col("longest_line") >= limit(1)) & (F.col("mean_line") >= limit(2)) & (F.col("word_share") >= limit(3))
    reason = (
        F.when(F.col("generated"), "flag")
        .when(F.col("path").rlike(TOOL_NAMES), "name")
        .when(F.arrays_overlap(folders, F.array(*map(F.lit, TOOL_FOLDERS))), "tool folder")
        .when(F.arrays_overlap(folders, F.array(*map(F.lit, DEPENDENCY_FOLDERS))), "dependency folder")
        .when(F.col("notice"), "notice")
        .when(F.col("known"), "third-party text")
        .when(F.col("size") > MAX_SIZE, "size")
        .when(data, "data")
        .when(minified, "minified")
    )
    return rows.select("path", reason.alias("reason")).where("reason is not null")


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(*(table(spark, sf_dir, t) for t in ("files", "source_files", "upstream_files")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).select("path")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


QUERIES = {"p3_found": p3_found, "p3_reasons": p3_reasons}
ORACLE: dict[str, str] = {}
