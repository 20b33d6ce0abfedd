"""Evaluation and usage: medians, folds of events, costs by price band, boolean rules, index metadata and freshness, spellings."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators.readers import count_rows
from codeloom.operators.store import GraphStore, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SCHEMA_VERSION = 9
UNIT_TOKENS = 1_000_000


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = False):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(GraphStore(spark, sf_dir))
        if sql:
            ORACLE[name] = with_sql(sql, recursive, more)
        return function

    return register


def medians(runs: DataFrame, groups: list[str], passed: Column, *measures: str) -> DataFrame:
    """Runs, passes and the medians of measures by group; nulls of a measure don't count."""
    return runs.groupBy(*groups).agg(count_rows().alias("runs"), F.count_if(passed).alias("passes"), *(F.round(F.median(m), 4).alias(f"median_{m}") for m in measures))


@query("a31_eval_medians", "SELECT event_type AS scenario, user_id % 3 AS configuration, count(*) AS runs, count_if(value >= 50) AS passes, round(median(value), 4) AS median_value FROM events GROUP BY ALL")
def eval_medians(g):
    """Medians by scenario and configuration; here event types and a third of the users stand for them."""
    runs = g.raw("events").select(F.col("event_type").alias("scenario"), (F.col("user_id") % 3).alias("configuration"), "value")
    return medians(runs, ["scenario", "configuration"], F.col("value") >= 50, "value")


def fold_events(events: DataFrame, key: str, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """How many events of each named class a key has; malformed payloads count as events all the same."""
    return events.groupBy(key).agg(count_rows().alias("n_events"), *(F.count_if(F.col("event_type").isin(*types)).alias(name) for name, types in kinds.items()))


@query("a33_event_fold", "SELECT user_id, count(*) AS n_events, count_if(event_type IN ('click', 'view', 'purchase')) AS tool_calls, count_if(event_type = 'view') AS search_calls, count_if(event_type = 'click') AS read_calls, count_if(event_type = 'error') AS failed FROM events GROUP BY user_id")
def event_fold(g):
    return fold_events(g.raw("events"), "user_id", {"tool_calls": ("click", "view", "purchase"), "search_calls": ("view",), "read_calls": ("click",), "failed": ("error",)})


#: Prices by model and band for UNIT_TOKENS tokens, and the input from which the long band holds. An example table; a parameter.
PRICES = {
    "view": {"threshold": 500, "short": {"input": "1.25", "cached": "0.125", "output": "10"}, "long": {"input": "2.5", "cached": "0.25", "output": "15"}},
    "click": {"threshold": None, "short": {"input": "0.25", "cached": "0.025", "output": "2"}},
}


def usage_cost(model: Column, input_tokens: Column, cached: Column, output: Column, prices: dict = PRICES) -> tuple[Column, Column]:
    """(band, cost) of a usage: the long band from the threshold on; uncached input is never negative; null where a needed rate is missing."""
    band, cost = F.lit(None).cast("string"), F.lit(None).cast("decimal(30,12)")
    uncached = F.greatest(F.lit(0), input_tokens - cached)
    for name, entry in prices.items():
        limit = entry["threshold"]
        own = F.when(input_tokens >= limit, "long").otherwise("short") if limit is not None else F.lit("short")
        band = F.when(F.lower(model) == name.lower(), own).otherwise(band)
        for b in ("short", "long"):
            rates = entry.get(b)
            if rates is None:
                continue
            total = F.lit(Decimal(0)).cast("decimal(30,12)")
            for kind, tokens in (("input", uncached), ("cached", cached), ("output", output)):
                rate = F.lit(Decimal(rates[kind])).cast("decimal(18,6)") if rates.get(kind) is not None else F.lit(None).cast("decimal(18,6)")
                total = (total + F.when(tokens == 0, F.lit(Decimal(0)).cast("decimal(30,12)")).otherwise((tokens.cast("decimal(12,0)") * rate / UNIT_TOKENS).cast("decimal(30,12)"))).cast("decimal(30,12)")
            cost = F.when((F.lower(model) == name.lower()) & (own == b), total).otherwise(cost)
    return band, cost


@query("x16_token_cost", """SELECT event_id, band, CASE WHEN band IS NULL THEN NULL ELSE round((greatest(0, i - c) * CASE WHEN event_type = 'click' THEN 0.25 WHEN band = 'long' THEN 2.5 ELSE 1.25 END + c * CASE WHEN event_type = 'click' THEN 0.025 WHEN band = 'long' THEN 0.25 ELSE 0.125 END + o * CASE WHEN event_type = 'click' THEN 2 WHEN band = 'long' THEN 15 ELSE 10 END) / 1000000.0, 9)::DOUBLE END AS cost FROM
  (SELECT event_id, event_type, floor(value * 10)::BIGINT AS i, user_id % 50 AS c, event_id % 90 AS o, CASE WHEN event_type = 'view' THEN CASE WHEN floor(value * 10) >= 500 THEN 'long' ELSE 'short' END WHEN event_type = 'click' THEN 'short' END AS band FROM events WHERE value IS NOT NULL)""")
def token_cost(g):
    """The cost of every event as if it were a usage: model by type, tokens from value and ids; null for models without a price."""
    rows = g.raw("events").where("value is not null").select("event_id", "event_type", F.floor(F.col("value") * 10).alias("i"), (F.col("user_id") % 50).alias("c"), (F.col("event_id") % 90).alias("o"))
    band, cost = usage_cost(F.col("event_type"), F.col("i"), F.col("c"), F.col("o"))
    return rows.select("event_id", band.alias("band"), F.round(cost.cast("double"), 9).alias("cost"))


def rule(text: str, atom: Callable[[str], Column]) -> Column:
    """A boolean rule of names, and, or, not and parentheses as a condition; ``not`` binds closest, then ``and``."""
    tokens = re.findall(r"[()]|[^\s()]+", text)
    at = 0

    def peek() -> str:
        return tokens[at].lower() if at < len(tokens) else ""

    def either() -> Column:
        nonlocal at
        left = both()
        while peek() == "or":
            at += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal at
        left = one()
        while peek() == "and":
            at += 1
            left = left & one()
        return left

    def one() -> Column:
        nonlocal at
        if at >= len(tokens) or peek() in (")", "and", "or"):
            raise ValueError(f"a name is missing in {text!r}")
        token = tokens[at]
        at += 1
        if token.lower() == "not":
            return ~one()
        if token == "(":
            inner = either()
            if peek() != ")":
                raise ValueError(f"a bracket is open in {text!r}")
            at += 1
            return inner
        return atom(token)

    found = either()
    if at != len(tokens):
        raise ValueError(f"{tokens[at]!r} is out of place in {text!r}")
    return found


@query("x17_rule", "SELECT user_id, list_contains(t, 'purchase') AND (list_contains(t, 'view') OR list_contains(t, 'click')) AND NOT list_contains(t, 'signup') AS holds FROM (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY user_id)")
def rule_query(g, text: str = "purchase and (view or click) and not signup"):
    types = g.raw("events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return types.select("user_id", rule(text, lambda name: F.array_contains("t", name)).alias("holds"))


@query("x13_call_text", "SELECT DISTINCT reference_name, regexp_replace(regexp_replace(reference_name, '/\\d+$', ''), '::|->', '.', 'g') AS call FROM r")
def call_text(g):
    """Calls as they compare: scopes and arrows as dots, without arity."""
    return g.refs.select("reference_name", F.regexp_replace(F.regexp_replace("reference_name", r"/\d+$", ""), "::|->", ".").alias("call")).distinct()


@query("x14_spelling", "SELECT DISTINCT reference_name, regexp_replace(regexp_replace(reference_name, '^([A-Za-z_][\\w@.]*)/\\d{1,3}$', '\\1'), '^([a-z_][\\w@]*):([A-Za-z_][\\w@]*)$', '\\1.\\2') AS spelled FROM r")
def spelling(g):
    """module:function and function/arity as readers write them."""
    bare = F.regexp_replace("reference_name", r"^([A-Za-z_][\w@.]*)/\d{1,3}$", "$1")
    return g.refs.select("reference_name", F.regexp_replace(bare, r"^([a-z_][\w@]*):([A-Za-z_][\w@]*)$", "$1.$2").alias("spelled")).distinct()


@query("sc13_index_metadata", f"SELECT 'schema_version' AS key, '{SCHEMA_VERSION}' AS value UNION ALL SELECT 'last_indexed_at', max(indexed_at)::VARCHAR FROM f UNION ALL SELECT 'n_files', count(*)::VARCHAR FROM f UNION ALL SELECT 'n_nodes', count(*)::VARCHAR FROM n UNION ALL SELECT 'n_references', count(*)::VARCHAR FROM r")
def index_metadata(g):
    """Keys and values that describe the index."""
    files = g.files.agg(F.max("indexed_at").cast("string").alias("last_indexed_at"), count_rows().cast("string").alias("n_files"))
    rows = files.select(F.explode(F.map_entries(F.create_map(F.lit("last_indexed_at"), "last_indexed_at", F.lit("n_files"), "n_files"))).alias("e")).select("e.key", "e.value")
    for key, table in (("n_nodes", g.nodes), ("n_references", g.refs)):
        rows = rows.unionByName(table.agg(count_rows().cast("string").alias("value")).select(F.lit(key).alias("key"), "value"))
    return rows.unionByName(g.spark.createDataFrame([("schema_version", str(SCHEMA_VERSION))], "key string, value string"))


def freshness(exists: bool, readable: bool, record: dict | None, head: str | None, dirty: bool) -> str:
    """Whether an index holds for a working copy: MISSING, INVALID, UNKNOWN, STALE, FRESH, the first that applies."""
    if not exists:
        return "MISSING"
    if not readable:
        return "INVALID"
    if record is None or head is None:
        return "UNKNOWN"
    return "STALE" if record.get("head") != head or dirty or record.get("dirty") else "FRESH"


def backoff(attempt: int, first_ms: int = 1000, most_ms: int = 30_000) -> int:
    """Milliseconds before a repeated attempt: doubled each time, thirty seconds at most."""
    return min(most_ms, first_ms * 2 ** max(0, attempt))


# Renderers


def render_tree(paths: list[str]) -> str:
    """Paths as a tree of folders, folders first."""
    root: dict = {}
    for path in sorted(set(paths)):
        at = root
        for part in path.split("/"):
            at = at.setdefault(part, {})

    def lines(node: dict, indent: str):
        for name in sorted(node, key=lambda n: (not node[n], n)):
            yield f"{indent}{name}{'/' if node[name] else ''}"
            yield from lines(node[name], indent + "  ")

    return "\n".join(lines(root, ""))


def render_markdown(rows: list[dict], title: str) -> str:
    """Rows under a heading as a table; bars in values are escaped."""
    if not rows:
        return f"## {title}\n\nNothing found."
    columns = list(rows[0])
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    body = [f"| {' | '.join(cell(r.get(c)) for c in columns)} |" for r in rows]
    return "\n".join([f"## {title}", "", f"| {' | '.join(columns)} |", "|" + "-|" * len(columns), *body])


def format_bytes(n: int) -> str:
    size, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024 or unit == "TB":
            break
        size /= 1024
    return f"{size:.1f} {unit}" if unit != "B" else f"{int(size)} B"


def number_lines(text: str, first: int = 1) -> str:
    lines = text.split("\n")
    width = len(str(first + len(lines) - 1))
    return "\n".join(f"{k:>{width}}  {line}" for k, line in enumerate(lines, first))


@query("x15_file_sizes", "SELECT path, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN ((size * 10 + 512) // 1024) // 10 || '.' || ((size * 10 + 512) // 1024) % 10 || ' KB' ELSE ((size * 10 + 524288) // 1048576) // 10 || '.' || ((size * 10 + 524288) // 1048576) % 10 || ' MB' END AS said FROM f WHERE size IS NOT NULL")
def file_sizes(g):
    """Sizes as they are shown: whole bytes, tenths of greater units, halves up."""
    size = F.col("size")

    def tenths(unit: int) -> Column:
        n = F.floor((size * 10 + unit // 2) / unit)
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))

    said = F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.concat(tenths(1 << 10), F.lit(" KB"))).otherwise(F.concat(tenths(1 << 20), F.lit(" MB")))
    return g.files.where("size is not null").select("path", said.alias("said"))


@query("f15_file_classes", "SELECT path, regexp_matches(lower(path), '[.](h|hh|hpp|hxx|h[+][+]|inc|d[.]ts|d[.]mts|d[.]cts|pyi|pxd)$') AS header, CASE WHEN contains(lower(path), '/src/') THEN regexp_matches(lower(path)[1:strpos(lower(path), '/src/')], '(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/') WHEN starts_with(lower(path), 'src/') THEN false ELSE regexp_matches(lower(path), '(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/') END OR regexp_matches(path, '" + X.TEST_PATH + "') AS off_target FROM f")
def file_classes(g):
    """Headers, and files that are tests or no production code."""
    return g.files.select("path", X.is_header(F.col("path")).alias("header"), X.is_test_file(F.col("path")).alias("off_target"))
