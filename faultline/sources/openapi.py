"""OpenAPI documents as contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import nonblank
from faultline.operators.facts import dedupe_keep_best
from faultline.sources.json_text import whole_files

# HTTP verbs of an operation; longest description kept.
VERBS = ["get", "post", "put", "patch", "delete", "head", "options", "trace"]
DESCRIPTION_LIMIT = 1000
SOURCE = "OpenAPI Intelligence"


def openapi_locations(metadata: DataFrame) -> DataFrame:
    """Locations named by ``Source:*:Location`` keys whose ``:Type`` is OpenApi."""
    key = F.lower("key")
    suffix = lambda s: F.regexp_extract(key, rf"^(source:.*):{s}$", 1)
    located = metadata.select(suffix("location").alias("prefix"), F.col("value").alias("location")).filter(
        (F.col("prefix") != "") & nonblank(F.col("location")))
    typed = metadata.select(suffix("type").alias("prefix"), F.lower("value").alias("t")).filter(
        (F.col("prefix") != "") & (F.col("t") == "openapi"))
    return (
        located.join(typed, "prefix", "left_semi")
        .groupBy(F.lower("location").alias("_k")).agg(F.min("location").alias("location")).select("location"))


def _object(v):
    """Members of a JSON object by name; null for anything else."""
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.try_variant_get(v, "$", "map<string,variant>"))


def _items(v):
    """Elements of a JSON array; none of anything else."""
    none = F.array().cast("array<variant>")
    return F.coalesce(F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>")), none)


def _string(v):
    """A JSON string; empty for anything else, numbers included."""
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))


def openapi_documents(files: DataFrame) -> DataFrame:
    """``path, content`` with the parsed root; ``warning`` says why a file gives nothing."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    yaml = extension.isin(".yaml", ".yml")
    parsed = F.when(~yaml, _object(F.try_parse_json("content")))
    warning = F.when(yaml, F.concat(
        F.lit("OpenAPI YAML document '"), F.col("path"),
        F.lit("' was detected. JSON OpenAPI documents are supported in the current implementation."))).when(
        F.col("root").isNull(), F.concat(
            F.lit("OpenAPI document '"), F.col("path"), F.lit("' could not be analyzed: invalid JSON.")))
    return files.withColumn("root", parsed).withColumn("warning", warning)


def openapi_scan(spark: SparkSession, path: str) -> DataFrame:
    return openapi_documents(whole_files(spark, path))


def located_documents(locations: DataFrame, files: DataFrame) -> DataFrame:
    """Documents of ``openapi_locations``, found as the end of a file's path; a location without a file has a warning."""
    wanted = locations.select("location", F.lower(F.replace(F.col("location"), F.lit("\\"), F.lit("/"))).alias("_l"))
    last = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    found = files.withColumn("_p", F.lower("path")).withColumn("_name", last(F.col("_p")))
    joined = wanted.withColumn("_name", last(F.col("_l"))).join(found, "_name", "left").withColumn(
        "_hit", F.endswith("_p", F.regexp_replace("_l", r"^(?:\.?/)+", "")))
    read = openapi_documents(joined.filter("_hit").select("path", "content").distinct())
    missing = joined.groupBy("location").agg(F.bool_or(F.coalesce("_hit", F.lit(False))).alias("any")).filter(~F.col("any")).select(
        F.col("location").alias("path"), F.concat(F.lit("OpenAPI document '"), F.col("location"), F.lit("' was not found.")).alias("warning"))
    return read.unionByName(missing, allowMissingColumns=True)


def openapi_contributions(
    documents: DataFrame, application_hint: str = "", description_limit: int | None = DESCRIPTION_LIMIT,
) -> DataFrame:
    """Statements of every readable document, best one per key.

    Only JSON strings count as text; an element of another kind is skipped alone. The
    description is cut at ``description_limit`` characters, whole with None.
    """
    docs = documents.filter(F.col("root").isNotNull()).select("path", "root")
    member = lambda m, k: F.try_element_at(m, F.lit(k))
    at = lambda m, k: _string(member(m, k))
    info = _object(member(F.col("root"), "info"))

    def row(kind, key, value, score, evidence, tags):
        return F.struct(
            F.lit(kind).alias("type"), key.alias("key"), value.alias("value"), F.lit(score).alias("confidence_score"),
            evidence.alias("evidence"), F.array(*[t if not isinstance(t, str) else F.lit(t) for t in tags]).alias("tags"))

    def say(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    path, L = F.col("path"), F.lit
    title, version, description = at(info, "title"), at(info, "version"), at(info, "description")
    if description_limit is not None:
        description = F.substring(description, 1, description_limit)
    whole = docs.select("path", F.inline(F.array(
        row("Other", L("OpenApiTitle"), title, 100, say("OpenAPI title '", title, "' declared in '", path, "'."), ["openapi", "metadata", "title"]),
        row("Version", L("ApiVersion"), version, 100, say("OpenAPI version '", version, "' declared in '", path, "'."), ["openapi", "version"]),
        row("Other", L("ApiDescription"), description, 100,
            say("API description declared in '", path, "'."), ["openapi", "description"]),
        row("Technology", L("Specification"), L("OpenAPI"), 100, say("OpenAPI specification discovered in '", path, "'."),
            ["openapi", "api", "specification"]))))
    url = at(_object(F.col("server")), "url")
    servers = docs.select("path", F.explode(_items(member(F.col("root"), "servers"))).alias("server")).select(
        "path", F.inline(F.array(row(
            "Dependency", L("ApiServer"), url, 95, say("OpenAPI server URL '", url, "' declared in '", path, "'."),
            ["openapi", "server", "url"]))))
    routes = docs.select("path", F.explode(_object(member(F.col("root"), "paths"))).alias("route", "item"))
    route = F.col("route")
    route_rows = routes.select("path", F.inline(F.array(row(
        "ApiEndpoint", L("Route"), route, 100, say("API route '", route, "' discovered in '", path, "'."), ["openapi", "route", "api"]))))
    operations = (
        routes.filter(nonblank(route))
        .select("path", "route", F.explode(_object(F.col("item"))).alias("verb", "body"))
        .filter(F.lower("verb").isin(VERBS))
        .select("path", "route", F.upper("verb").alias("verb"), _object(F.col("body")).alias("op"))
        .withColumn("operation", F.concat_ws(" ", "verb", "route"))
    )
    op, name = F.col("op"), F.col("operation")
    operation_rows = operations.select("path", F.inline(F.concat(
        F.array(
            row("ApiEndpoint", L("Operation"), name, 100,
                say(F.col("verb"), " operation discovered for route '", route, "' in '", path, "'."), ["openapi", "operation", F.col("verb")]),
            row("Component", L("OperationId"), at(op, "operationId"), 95,
                say("Operation '", name, "' maps to operationId '", at(op, "operationId"), "'."), ["openapi", "operation-id"]),
            row("Other", say("Summary:", name), at(op, "summary"), 100, say("OpenAPI summary for '", name, "'."), ["openapi", "summary"])),
        F.coalesce(F.transform(
            _items(member(op, "tags")),
            lambda t: row("Component", say("ApiTag:", name), _string(t), 85,
                          say("Operation '", name, "' is grouped under OpenAPI tag '", _string(t), "'."), ["openapi", "tag"])),
            F.array().cast("array<struct<type:string,key:string,value:string,confidence_score:int,evidence:string,tags:array<string>>>")))))
    schemas = docs.select("path", F.explode(_object(member(_object(member(F.col("root"), "components")), "schemas"))).alias("name", "_body")).select(
        "path", F.inline(F.array(row(
            "Other", L("ApiSchema"), F.col("name"), 90, say("OpenAPI schema '", F.col("name"), "' discovered in '", path, "'."), ["openapi", "schema"]))))
    everything = whole.unionByName(servers).unionByName(route_rows).unionByName(operation_rows).unionByName(schemas)
    rows = everything.filter(nonblank(F.col("value"))).withColumns({
        "application_id": L(application_hint), "application_name": L(application_hint),
        "source_kind": L("OpenApi"), "source_name": L(SOURCE), "is_identity_evidence": L(False)})
    return dedupe_keep_best(rows, ["application_id", "type", "key", "value"], [F.col("path"), F.col("value"), F.col("evidence")])


def openapi_warnings(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("warning").isNotNull()).select("warning")
