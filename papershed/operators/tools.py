"""Reading tools as table functions: named, with a JSON schema, callable in SQL and from a list of calls.

A tool is a query over the library's views with parameters. ``register`` makes each a temporary SQL table function, so
``SELECT * FROM library_search('spark')`` is planned like the query itself; ``call`` checks arguments against the schema before
anything is planned. ``guarded`` says which calls of a turn are answered. Callers may register tools of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bounds of arguments and of a turn.
PAGE_CHARS, SEARCH_HITS, DEFAULT_LIST, MOST_LISTED, MOST_WORDS = 24_000, 20, 20, 100, 8
REPEATS_ANSWERED, REPEATS_STOP, CALLS_ANSWERED, CALLS_STOP = 2, 12, 250, 300
ID = {"type": "string", "pattern": "^[a-f0-9]{16}$"}
LIMIT = {"type": "integer", "minimum": 1, "maximum": MOST_LISTED}


class ArgumentError(ValueError):
    """What is wrong with the arguments of a call."""


@dataclass(frozen=True)
class Tool:
    """``properties`` and ``required`` are those of the JSON schema of its arguments; ``query`` is SQL over the views, with the arguments' names."""

    name: str
    properties: dict[str, dict]
    required: tuple[str, ...]
    returns: str
    query: str
    defaults: tuple[tuple[str, object], ...] = ()

    def schema(self) -> dict:
        return {"type": "object", "properties": self.properties, "required": list(self.required), "additionalProperties": False}


def check(tool: Tool, arguments: object) -> dict:
    """The arguments with defaults filled in; an ArgumentError says what the schema forbids."""
    if not isinstance(arguments, dict):
        raise ArgumentError("Arguments must be a JSON object.")
    if extra := [k for k in arguments if k not in tool.properties]:
        raise ArgumentError(f"Unknown argument(s): {', '.join(extra)}. Allowed: {', '.join(tool.properties)}.")
    full = {**dict(tool.defaults), **arguments}
    for name, rule in tool.properties.items():
        if name not in full:
            raise ArgumentError(f'"{name}" is missing.')
        value = full[name]
        if rule["type"] == "integer":
            low, high = rule.get("minimum", 0), rule.get("maximum", 2**31 - 1)
            if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
                raise ArgumentError(f'"{name}" must be an integer between {low} and {high}.')
        else:
            if not isinstance(value, str) or not value.strip():
                raise ArgumentError(f'"{name}" must be a non-empty string.')
            if len(value) > rule.get("maxLength", len(value)):
                raise ArgumentError(f'"{name}" is longer than {rule["maxLength"]} characters.')
            if "pattern" in rule and not re.fullmatch(rule["pattern"], value):
                raise ArgumentError(f'"{name}" has another form than {rule["pattern"]}.')
    return full


#: Over the views ``materials`` (id, title, text, saved_s), ``annotations`` (material, start, quote, note) and ``inbox`` (id, title, source_id, published_s).
READING = (
    Tool(
        "library_search", {"query": {"type": "string", "maxLength": 200}}, ("query",), "id STRING, title STRING, kind STRING",
        " UNION ALL ".join(
            f"""SELECT id, title, '{kind}' AS kind FROM (SELECT id, title, row_number() OVER (ORDER BY {newest} DESC NULLS LAST, id) AS nth FROM (
                  SELECT id, title, {newest} FROM {view} WHERE trim(query) <> '' AND forall(slice(split(trim(lower(query)), '\\\\s+'), 1, {MOST_WORDS}), w -> contains(lower(concat_ws(' ', title, {also})), w))
                  ORDER BY {newest} DESC NULLS LAST, id LIMIT {SEARCH_HITS}))"""
            for view, kind, newest, also in (("materials", "material", "saved_s", "text"), ("inbox", "item", "published_s", "source_id"))
        ),
    ),
    Tool(
        "library_recent", {"how_many": LIMIT}, (), "id STRING, title STRING, saved_s BIGINT",
        f"SELECT id, title, saved_s FROM (SELECT id, title, saved_s, row_number() OVER (ORDER BY saved_s DESC NULLS LAST, id) AS nth FROM (SELECT id, title, saved_s FROM materials ORDER BY saved_s DESC NULLS LAST, id LIMIT {MOST_LISTED})) WHERE nth <= how_many",
        (("how_many", DEFAULT_LIST),),
    ),
    Tool(
        "material_read", {"material": ID, "start": {"type": "integer", "minimum": 0}}, ("material",), "content STRING, next_start INT, total INT",
        f"SELECT substr(text, start + 1, {PAGE_CHARS}), CASE WHEN start + {PAGE_CHARS} < char_length(text) THEN start + {PAGE_CHARS} END, char_length(text) FROM materials WHERE id = material AND start <= char_length(text)",
        (("start", 0),),
    ),
    Tool("material_annotations", {"material_id": ID}, ("material_id",), "start INT, quote STRING, note STRING", "SELECT start, quote, note FROM annotations WHERE material = material_id"),
    Tool(
        "inbox_list", {"how_many": LIMIT}, (), "id STRING, title STRING, source_id STRING, published_s BIGINT",
        f"SELECT id, title, source_id, published_s FROM (SELECT *, row_number() OVER (ORDER BY published_s DESC NULLS LAST, id) AS nth FROM (SELECT * FROM inbox ORDER BY published_s DESC NULLS LAST, id LIMIT {MOST_LISTED})) WHERE nth <= how_many",
        (("how_many", DEFAULT_LIST),),
    ),
)


def register(spark: SparkSession, views: dict[str, DataFrame], tools: tuple[Tool, ...] = READING) -> None:
    """Makes the views and the table functions of a session; those of the same names are replaced."""
    for name, rows in views.items():
        rows.createOrReplaceTempView(name)
    for tool in tools:
        known = dict(tool.defaults)
        types = {n: "INT" if r["type"] == "integer" else "STRING" for n, r in tool.properties.items()}
        parameters = ", ".join(f"{n} {t}" + (f" DEFAULT {known[n]!r}" if n in known else "") for n, t in types.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {tool.name}({parameters}) RETURNS TABLE ({tool.returns}) RETURN {tool.query}")


def call(spark: SparkSession, name: str, arguments: object, tools: tuple[Tool, ...] = READING) -> DataFrame:
    """The rows of a registered tool; its arguments are checked first and travel as values, never as SQL."""
    tool = next((t for t in tools if t.name == name), None)
    if tool is None:
        raise ArgumentError(f"Unknown tool {name}.")
    full = check(tool, arguments)
    return spark.sql(f"SELECT * FROM {name}({', '.join(f':{p}' for p in tool.properties)})", args={p: full[p] for p in tool.properties})


def guarded(calls: DataFrame, turn: str, order: list[str], same: list[str], read: str) -> DataFrame:
    """Calls with ``outcome``: answered; refused (a read a third time, or beyond 250 calls); stopped (the 12th time of one read, or the
    300th call, which ends the turn); ended (after that). ``same`` are the columns in which equal reads agree, ``read`` says what is a read."""
    upto = Window.partitionBy(turn).orderBy(*order)
    nth = F.row_number().over(Window.partitionBy(turn, read, *same).orderBy(*order))
    counted = calls.withColumn("_nth", F.when(F.col(read), nth).otherwise(1)).withColumn("_call", F.row_number().over(upto))
    stops = (F.col("_nth") == REPEATS_STOP) | (F.col("_call") == CALLS_STOP)
    ended = F.sum(stops.cast("int")).over(upto)
    marked = counted.withColumn("_stops", stops).withColumn("_ended", ended)
    outcome = (
        F.when(F.col("_stops") & (F.col("_ended") == 1), "stopped").when(F.col("_ended") > 0, "ended")
        .when((F.col("_nth") > REPEATS_ANSWERED) | (F.col("_call") > CALLS_ANSWERED), "refused").otherwise("answered")
    )
    return marked.withColumn("outcome", outcome).drop("_nth", "_call", "_stops", "_ended")
