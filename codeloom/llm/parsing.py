"""Source files that do not parse.

Method: every file is parsed by the grammars of all languages: its own first, the others in the
order of a ranking over its tokens, the likeliest first. A foreign success of a file that its own
grammar rejects names the wrong extension, failure everywhere means corruption. A foreign parse
ends at the first token, group or statement that breaks the grammar, looking at the first tokens
before the rest; that never changes its outcome.

Defined results: null content gives no row; empty or blank content is valid; a language without
a grammar gives ``valid`` null, as does a Python text beyond the limits of the language's parser
even when cut down (thousands of operators in one expression or elif branches in one statement); repeated rows give one
row per path (a path with several texts is invalid if one of them is). ``accepted`` holds all
languages that take the text, the declared one too. Only the columns path, language and content are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import syntax
from codeloom.llm.text import map_rows
from codeloom.sources.tables import table

#: Tokens, as white space parts them, that speak for a language.
MARKS = {
    "python": "def elif except: import from None True False self, not and in is lambda: else: try: return: #".split(),
    "javascript": "const let var function => === !== require( export { } typeof new // null".split(),
    "typescript": "interface type readonly private public export import const let => : string; number; unknown; === // namespace".split(),
    "java": "package public private protected static final class void String new import @Override throws int boolean //".split(),
    "go": "package func := import type struct defer range nil chan go var err map[string]int //".split(),
    "rust": "fn let mut impl pub use mod -> struct enum match &self, &str, self self, => // u32,".split(),
    "c": "#include #define struct unsigned char void int double long static const -> /* typedef sizeof".split(),
}
_MARKS = {name: frozenset(tokens) for name, tokens in MARKS.items()}
#: First tokens of a file that a foreign grammar looks at before the next step.
STEPS = (8, 60)
CONFLICT = re.compile(r"^(?:<{7} |={7}$|>{7} )", re.M)


def ranking(text: str, declared: str) -> list[str]:
    """Languages other than ``declared``, the likeliest by the tokens of the text first."""
    tokens = set(text.split())
    return sorted((name for name in syntax.LANGUAGES if name != declared), key=lambda name: (-len(_MARKS[name] & tokens), name))


#: Languages that take most texts of another: nothing is gained by looking at first tokens.
WIDER = {("javascript", "typescript")}


def accepts(name: str, text: str, declared: str = "") -> bool:
    """Does a foreign grammar take the text?"""
    grammar = syntax.grammar(name)
    return ((declared, name) in WIDER or all(grammar.plausible(text, first) for first in STEPS)) and bool(grammar.valid(text))


def judge(path: str | None, language: str | None, content: str | None) -> Iterator[tuple]:
    """(path, language, valid, found_language, cause, accepted) of one file."""
    if path is None or content is None:
        return
    grammar = syntax.grammar(language)
    name = (language or "").strip().lower()
    valid = grammar.valid(content) if grammar else None
    foreign = [x for x in ranking(content, grammar.name if grammar else "") if accepts(x, content, grammar.name if grammar else "")]
    accepted = [grammar.name, *foreign] if valid else foreign
    if valid is False:
        cause = "wrong language" if foreign else "merge conflict" if CONFLICT.search(content) else "corrupt"
        yield path, name, False, foreign[0] if foreign else None, cause, accepted
    else:
        yield path, name, valid, None, None, accepted


def parse_files(files: DataFrame) -> DataFrame:
    """path, language, valid, found_language, cause, accepted: one row per path with a text."""
    schema = "path string, language string, valid boolean, found_language string, cause string, accepted array<string>"
    arrow = pa.schema([("path", pa.string()), ("language", pa.string()), ("valid", pa.bool_()), ("found_language", pa.string()), ("cause", pa.string()), ("accepted", pa.list_(pa.string()))])
    rows = map_rows(files.select("path", "language", "content"), judge, schema, arrow)
    worst = F.min(F.struct(F.coalesce(F.col("valid"), F.lit(True)).alias("order"), "language", "valid", "found_language", "cause", "accepted")).alias("r")
    return rows.groupBy("path").agg(worst).select("path", "r.language", "r.valid", "r.found_language", "r.cause", "r.accepted")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(table(spark, sf_dir, "source_files")).where("not valid").select("path")


def p4_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_files(table(spark, sf_dir, "source_files")).where("not valid").select("path", "language", "found_language", "cause")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid files and their share per repository and language."""
    files = parse_files(table(spark, sf_dir, "source_files")).where("valid is not null")
    counts = files.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("repository"), "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
    return counts.withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))


def p4_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each declared language each grammar accepts."""
    files = parse_files(table(spark, sf_dir, "source_files"))
    return files.select("language", F.explode("accepted").alias("accepted_by")).groupBy("language", "accepted_by").agg(F.count(F.lit(1)).alias("n_files"))


QUERIES = {"p4_grammars": p4_grammars, "p4_found": p4_found, "p4_causes": p4_causes, "p4_rates": p4_rates}
ORACLE: dict[str, str] = {}
