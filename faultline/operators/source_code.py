"""C# sources: types, methods, and what methods do with databases and configuration.

Positions of matches come from running sums over the pieces between them, blocks
from the depth of braces: an opening brace and the next brace on the same level
belong together. Both are windows inside one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import distinct_ci, nonblank, strip
from faultline.plans.staging import staged

# Patterns of declarations.
NAMESPACE = r"(?m)\bnamespace\s+([A-Za-z_][A-Za-z0-9_.]*)\s*[;{]"
TYPE = (
    r"(?m)(?:(?:public|internal|private|protected|static|abstract|sealed|partial|readonly)\s+)*"
    r"(class|interface|record|struct)\s+([A-Za-z_][A-Za-z0-9_]*)(\s*:\s*[^{\r\n]+)?"
)
METHOD = (
    r"(?m)(?:(?:public|internal|private|protected|static|virtual|override|abstract|async|sealed|new|extern|partial)\s+)+"
    r"(?:[A-Za-z_][A-Za-z0-9_<>,?.\[\]\s]*\s+)([A-Za-z_][A-Za-z0-9_]*)\s*\([^;{}]*\)"
)
CONTROL_WORDS = ["if", "for", "foreach", "while", "switch", "catch", "using", "lock"]
KINDS = {"interface": "Interface", "record": "Record", "struct": "Struct"}
# Patterns inside method bodies.
EXEC_NAME = r"(?i)\b(?:EXEC|EXECUTE)\s+(?:dbo\.)?([A-Za-z_][A-Za-z0-9_]*)"
COMMAND_TEXT = r'(?i)CommandText\s*=\s*"([^"]+)"'
EXECUTE_SQL = (
    r"(?i)(?:ExecuteSqlRaw|ExecuteSqlRawAsync|ExecuteSqlInterpolated|ExecuteSqlInterpolatedAsync)"
    r'\s*\(\s*"([^"]+)"'
)
DIRECT_NAME = r"(?i)^(?:dbo\.)?([A-Za-z_][A-Za-z0-9_]*)\b"
CONTEXT_TYPE = r"(?i)\b([A-Za-z_][A-Za-z0-9_]*DbContext)\b"
CONTEXT_SERVICE = r"(?i)(?:GetRequiredService|GetService)\s*<\s*([A-Za-z_][A-Za-z0-9_]*DbContext)\s*>"
CONFIGURATION_KEYS = [
    r'(?i)(?:configuration|_configuration|config|_config)\s*\[\s*"([^"]+)"\s*\]',
    r'(?i)\.GetValue(?:<[^>]+>)?\s*\(\s*"([^"]+)"',
    r'(?i)\.GetSection\s*\(\s*"([^"]+)"',
]
CONNECTION_STRING = r'(?i)\.GetConnectionString\s*\(\s*"([^"]+)"'
FILE = ["repository", "project_name", "relative_path"]


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def match_positions(df: DataFrame, keys: list[str], text: str, pattern: str, groups: dict[str, int]) -> DataFrame:
    """One row per match: ``keys``, ``match_no``, 1-based ``pos``, and its groups.

    Groups are read from the match itself, so patterns must not look at what stands around a match.
    """
    zipped = F.arrays_zip(
        F.transform(F.split(F.col(text), pattern, -1), F.length).alias("gap"), _found(F.col(text), pattern, 0).alias("whole"))
    rows = df.select(*keys, F.posexplode(zipped).alias("match_no", "m")).select(*keys, "match_no", "m.*").filter(
        F.col("whole").isNotNull()).withColumns({n: F.regexp_extract("whole", pattern, g) for n, g in groups.items()})
    order = Window.partitionBy(*keys).orderBy("match_no")
    until = F.sum(F.col("gap") + F.length("whole")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("pos", (F.coalesce(until, F.lit(0)) + F.col("gap") + 1).cast("int")).drop("gap")


def brace_blocks(files: DataFrame) -> DataFrame:
    """``open_pos`` and ``close_pos`` of every block of a file."""
    braces = match_positions(files, FILE, "content", "[{}]", {})
    opens = F.col("whole") == "{"
    order = Window.partitionBy(*FILE).orderBy("pos")
    depth = F.sum(F.when(opens, 1).otherwise(-1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    level = braces.withColumn("level", F.when(opens, depth).otherwise(depth + 1))
    same = Window.partitionBy(*FILE, "level").orderBy("pos")
    return level.withColumn("close_pos", F.lead("pos").over(same)).filter(opens).select(
        *FILE, F.col("pos").alias("open_pos"), "close_pos")


def with_blocks(declarations: DataFrame, files: DataFrame, out: str) -> DataFrame:
    """Add the text of the block that follows each declaration (``pos``).

    ``<out>_start`` is where it begins. Without an opening brace the block runs
    from the declaration, without a closing one to the end of the file.
    """
    declarations = staged(declarations, "declarations")  # they are found by scans of the text, and needed twice
    blocks = brace_blocks(files)
    marks = declarations.select(*FILE, "pos").distinct().withColumns(
        {"open_pos": F.lit(None).cast("int"), "close_pos": F.lit(None).cast("int")}).unionByName(
        blocks.withColumn("pos", F.col("open_pos")))
    ahead = Window.partitionBy(*FILE).orderBy("pos").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    following = F.min(F.when(F.col("open_pos").isNotNull(), F.struct("open_pos", "close_pos"))).over(ahead)
    next_open = marks.withColumn("_next", following)
    bounds = next_open.filter(F.col("open_pos").isNull()).select(*FILE, "pos", F.col("_next.open_pos").alias("_o"), F.col("_next.close_pos").alias("_c"))
    start = F.coalesce("_o", "pos")
    text = F.when(F.col("_c").isNotNull(), F.substring(F.col("content"), start, F.col("_c") - start + 1)).otherwise(
        F.substring(F.col("content"), start, F.length("content")))
    return (
        declarations.join(bounds, [*FILE, "pos"]).join(files.select(*FILE, "content"), FILE)
        .withColumns({f"{out}_start": start, out: text}).drop("_o", "_c"))


def _first_per(df: DataFrame, keys: list, order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def source_types(files: DataFrame) -> DataFrame:
    """Types of every file with full name, kind, bases and body."""
    named = files.withColumn("namespace", strip(F.regexp_extract("content", NAMESPACE, 1)))
    found = match_positions(named, [*FILE, "namespace"], "content", TYPE, {"kind": 1, "name": 2, "bases": 3})
    kind = None
    for word, label in KINDS.items():
        kind = F.when(F.col("kind") == word, label) if kind is None else kind.when(F.col("kind") == word, label)
    bases = F.filter(F.transform(F.split(F.regexp_replace(strip(F.col("bases")), "^:+", ""), ","), strip), lambda b: b != "")
    typed = found.select(
        *FILE, "namespace", F.col("match_no").alias("type_no"), "pos", "name", kind.otherwise("Class").alias("kind"), bases.alias("base_types"),
        F.when(F.col("namespace") == "", F.col("name")).otherwise(F.concat_ws(".", "namespace", "name")).alias("full_name"))
    unique = _first_per(typed, [*FILE, F.lower("full_name")], ["type_no"])
    return with_blocks(unique, files, "body").drop("content")


def source_methods(types: DataFrame, files: DataFrame) -> DataFrame:
    """Methods of every type with signature, line, and body facts."""
    keys = [*FILE, "type_no", "full_name", "type_name", "body_start"]
    bodies = types.withColumnRenamed("name", "type_name").select(*keys, "body")
    found = match_positions(bodies, keys, "body", METHOD, {"name": 1}).filter(~F.lower("name").isin(CONTROL_WORDS))
    placed = found.select(
        *FILE, "type_no", "type_name", "full_name", F.col("match_no").alias("method_no"), "name",
        strip(F.regexp_replace("whole", r"\s+", " ")).alias("signature"),
        (F.col("body_start") + F.col("pos") - 1).cast("int").alias("pos"))
    unique = _first_per(placed, [*FILE, "type_no", F.lower("name"), F.lower("signature")], ["method_no"])
    before = F.substring(F.col("content"), F.lit(1), F.col("pos") - 1)
    return (
        with_blocks(unique, files, "body")
        .withColumn("line_number", F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)
        .withColumns({
            "database_operations": method_db_operations(F.col("body")), "db_contexts": method_db_contexts(F.col("body")),
            "configuration_keys": method_config_keys(F.col("body"))})
        .drop("content", "body", "body_start"))


def _operation_name(value: Column) -> Column:
    flat = strip(F.regexp_replace(value, r"[\r\n]", " "))
    named = F.regexp_extract(flat, EXEC_NAME, 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(flat, DIRECT_NAME, 1))


def method_db_operations(body: Column) -> Column:
    """Names of procedures a body executes, first spelling kept."""
    return distinct_ci(F.filter(F.concat(
        F.transform(_found(body, EXEC_NAME), strip), F.transform(_found(body, COMMAND_TEXT), _operation_name),
        F.transform(_found(body, EXECUTE_SQL), _operation_name)), lambda v: v != ""))


def method_db_contexts(body: Column) -> Column:
    return distinct_ci(F.concat(_found(body, CONTEXT_TYPE), _found(body, CONTEXT_SERVICE)))


def method_config_keys(body: Column) -> Column:
    """Configuration keys a body reads; connection strings carry their prefix."""
    keys = F.concat(*[F.transform(_found(body, p), strip) for p in CONFIGURATION_KEYS])
    names = F.filter(F.transform(_found(body, CONNECTION_STRING), strip), lambda n: n != "")
    return distinct_ci(F.concat(
        F.filter(keys, lambda k: k != ""), F.transform(names, lambda n: F.concat(F.lit("ConnectionStrings:"), n))))


def repository_db_references(methods: DataFrame) -> DataFrame:
    """Method x operation x context; no context reads ``""``."""
    contexts = F.filter(F.transform("db_contexts", strip), lambda c: c != "")
    rows = methods.select(
        *FILE, "type_no", "method_no", F.col("type_name").alias("class_name"), F.col("name").alias("method_name"), "line_number",
        F.posexplode("database_operations").alias("op_no", "operation"),
        F.when(F.size(contexts) == 0, F.array(F.lit(""))).otherwise(contexts).alias("_c"),
    ).filter(nonblank(F.col("operation"))).select("*", F.posexplode("_c").alias("context_no", "db_context")).withColumns({
        "operation": strip(F.col("operation")),
        "database_type": F.when(F.col("db_context") == "", "Unknown").otherwise("EntityFrameworkCore")})
    keys = [F.lower(c) for c in ("repository", "project_name", "relative_path", "class_name", "method_name", "operation", "db_context")]
    return _first_per(rows, keys, ["type_no", "method_no", "op_no", "context_no"]).select(
        *FILE, "class_name", "method_name", "line_number", "operation", "db_context", "database_type")


def repository_config_references(methods: DataFrame) -> DataFrame:
    rows = methods.select(
        *FILE, "type_no", "method_no", F.col("type_name").alias("class_name"), F.col("name").alias("method_name"),
        F.posexplode("configuration_keys").alias("key_no", "key")).filter(nonblank(F.col("key"))).withColumn("key", strip(F.col("key")))
    keys = [F.lower(c) for c in ("repository", "project_name", "relative_path", "class_name", "method_name", "key")]
    return _first_per(rows, keys, ["type_no", "method_no", "key_no"]).select(*FILE, "class_name", "method_name", "key")


def source_summary(projects: DataFrame, files: DataFrame, types: DataFrame, methods: DataFrame, references: DataFrame) -> DataFrame:
    """Counts per repository."""
    def count(df, name):
        return df.groupBy("repository").agg(F.count(F.lit(1)).alias(name))

    out = count(projects, "project_count")
    for df, name in ((files, "source_file_count"), (types, "type_count"), (methods, "method_count"), (references, "database_reference_count")):
        out = out.join(count(df, name), "repository", "left")
    return out.na.fill(0)
