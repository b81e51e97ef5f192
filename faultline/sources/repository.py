"""Code repositories: file inventory, projects, source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.text import any_of, contains_ci, decoded, distinct_ci, nonblank, strip
from faultline.plans.staging import globally_ranked

# File kinds that count, by category, and directories that do not.
CATEGORIES = {
    "CSharp": [".cs"], "Project": [".csproj", ".sln"], "Database": [".sql"],
    "Configuration": [".json", ".config", ".xml", ".yml", ".yaml"],
    "Presentation": [".razor", ".cshtml", ".html"], "Frontend": [".js", ".jsx", ".ts", ".tsx"],
    "Styles": [".css"], "Automation": [".ps1", ".cmd", ".bat"], "Documentation": [".md"],
}
IGNORED_DIRECTORIES = [".git", ".vs", ".idea", "bin", "obj", "node_modules", "packages", "testresults"]
READ_EXTENSIONS = [".cs", ".csproj"]
# Words of a path that exclude it always, as generated, as tests.
NEVER = ["/bin/", "/obj/", "/.git/"]
GENERATED_WITHIN, GENERATED_ENDS = ["/generated/"], [".g.cs", ".generated.cs"]
TESTS = ["/test/", "/tests/", ".tests/"]


def extension_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./\\]*)$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directory(path: Column) -> Column:
    """Directory part of a relative path, ``""`` at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(F.locate(".", name) > 0, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


def category(extension: Column) -> Column:
    chain = None
    for name, kinds in CATEGORIES.items():
        hit = F.lower(extension).isin(kinds)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("Other")


def repository_files(listing: DataFrame) -> DataFrame:
    """Supported files outside ignored directories, with extension and category."""
    kinds = [k for ks in CATEGORIES.values() for k in ks]
    path = F.replace(F.col("relative_path"), F.lit("\\"), F.lit("/"))
    dirs = F.split(F.lower(directory(path)), "/")
    return (
        listing.withColumn("relative_path", path)
        .withColumn("extension", extension_of(F.col("relative_path")))
        .filter(F.lower("extension").isin(kinds))
        .filter(~F.exists(dirs, lambda d: d.isin(IGNORED_DIRECTORIES)))
        .withColumns({"file_name": file_name(F.col("relative_path")), "category": category(F.col("extension"))})
    )


def repository_file_scan(spark: SparkSession, root: str, repository: str) -> DataFrame:
    """Inventory of a code tree; file contents are not read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    listing = files.select(
        F.lit(repository).alias("repository"),
        F.regexp_replace("path", r"^.*?" + "\\Q" + base + "\\E" + "/", "").alias("relative_path"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return repository_files(listing)


def code_tree(spark: SparkSession, root: str, repository: str) -> DataFrame:
    """``repository, relative_path, size_bytes, modified, content`` of a folder, and what the inventory adds.

    Contents are read of C# sources and projects only; of other files it is null. Text is
    decoded by its byte order mark, UTF-8 without one.
    """
    pattern = "*{" + ",".join(READ_EXTENSIONS) + "}"
    base = root.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    texts = read.select(F.col("path"), decoded(F.col("content")).alias("content"))
    relative = F.regexp_replace("path", r"^.*?" + "\\Q" + base + "\\E" + "/", "").alias("relative_path")
    return repository_file_scan(spark, root, repository).join(texts.select(relative, "content"), "relative_path", "left")


def repository_path_filter(path: Column, include_generated: bool = False, include_tests: bool = False) -> Column:
    """True for paths that belong to the product's own source."""
    p = F.lower(F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))))
    within = lambda words: any_of(F.contains(p, F.lit(w)) for w in words)
    out = ~within(NEVER)
    if not include_generated:
        out = out & ~(within(GENERATED_WITHIN) | any_of(F.endswith(p, F.lit(e)) for e in GENERATED_ENDS))
    return out if include_tests else out & ~within(TESTS)


_LOWER = "translate(local-name(),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"


def _first_element(xml: Column, name: str) -> Column:
    return strip(F.xpath_string(xml, F.lit(f"(//*[{_LOWER}='{name}'])[1]")))


def _includes(xml: Column, name: str) -> Column:
    values = F.xpath(xml, F.lit(f"//*[{_LOWER}='{name}']/@Include"))
    return distinct_ci(F.filter(values, nonblank))


def project_files(files: DataFrame) -> DataFrame:
    """Projects from ``.csproj`` files (``repository, relative_path, content``).

    ``warning`` is set, and the fields are null, when the XML cannot be read.
    """
    xml = F.regexp_replace("content", "^﻿", "")
    # Few small files that take long to read: dealt out, or all may stand in the part of a table that one task reads.
    rows = files.filter(F.lower(extension_of(F.col("relative_path"))) == ".csproj").repartition("repository", "relative_path").select(
        "repository", "relative_path", xml.alias("_xml"), (xml.rlike(r"^\s*<") & F.from_xml(
            F.when(xml.rlike(r"^\s*<"), xml), "_corrupt_record string", {"mode": "PERMISSIVE"})["_corrupt_record"].isNull()).alias("_ok"))
    ok = lambda c: F.when(F.col("_ok"), c)
    x = F.when(F.col("_ok"), F.col("_xml"))
    sdk = F.xpath_string(x, F.lit("/*/@Sdk"))
    read = rows.select(
        "repository", "relative_path", file_stem(F.col("relative_path")).alias("name"), ok(sdk).alias("sdk"),
        ok(_first_element(x, "targetframework")).alias("_one"), ok(_first_element(x, "targetframeworks")).alias("_many"),
        ok(_first_element(x, "outputtype")).alias("_output"),
        ok(_includes(x, "projectreference")).alias("project_references"),
        ok(_includes(x, "packagereference")).alias("package_references"), "_ok")
    kind = F.when(contains_ci(F.col("sdk"), "Web"), "Web").when(F.lower("_output") == "exe", "Executable").otherwise("Library")
    framework = F.when(F.col("_one") != "", F.col("_one")).otherwise(F.col("_many"))
    typed = read.withColumns({
        "project_type": F.when(F.col("_ok"), kind), "target_framework": framework,
        "warning": F.when(~F.col("_ok"), F.concat(F.lit("Unable to inspect project '"), F.col("relative_path"), F.lit("'.")))})
    uses = lambda word: F.exists("package_references", lambda p: contains_ci(p, word))
    found = F.array_compact(F.array(
        F.when(F.col("target_framework") != "", F.col("target_framework")),
        F.when(F.col("sdk") != "", F.when(contains_ci(F.col("sdk"), "Web"), "ASP.NET Core").otherwise(".NET")),
        F.when(uses("EntityFrameworkCore"), "Entity Framework Core"),
        # A package of the newer framework also holds the older name.
        F.when(uses("EntityFramework"), "Entity Framework")))
    return typed.withColumn("technologies", distinct_ci(found)).drop("_one", "_many", "_output", "_ok", "sdk")


def _path_prefixes(path: Column) -> Column:
    """All directories above a file, the root (``""``) included, lower-cased."""
    parts = F.split(F.lower(directory(path)), "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(ups)


def _containing(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Every (file, project) where the project's directory holds the file."""
    homes = projects.filter(F.col("warning").isNull()).select(
        "repository", F.lower(directory(F.col("relative_path"))).alias("_dir"),
        F.col("name").alias("project_name"), F.col("relative_path").alias("_project_path"))
    return files.withColumn("_dir", F.explode(_path_prefixes(F.col("relative_path")))).join(homes, ["repository", "_dir"])


def attach_project(files: DataFrame, projects: DataFrame) -> DataFrame:
    """Files with the project of the longest matching directory, or null."""
    best = (
        _containing(files.select("repository", "relative_path"), projects)
        .groupBy("repository", "relative_path")
        .agg(F.min_by("project_name", F.struct(-F.length("_dir"), "_project_path")).alias("project_name")))
    return files.join(best, ["repository", "relative_path"], "left")


def source_file_scan(
    files: DataFrame, projects: DataFrame, include_generated: bool = False, include_tests: bool = False,
    maximum_files: int | None = None,
) -> DataFrame:
    """C# files below each project; all of them, or at most ``maximum_files`` per repository.

    A file below two nested projects belongs to both. A limit takes files in the
    order of project name and path.
    """
    wanted = files.filter(
        (F.lower(extension_of(F.col("relative_path"))) == ".cs")
        & repository_path_filter(F.col("relative_path"), include_generated, include_tests))
    owners = projects.filter(repository_path_filter(F.col("relative_path"), include_generated, include_tests))
    pairs = _containing(wanted.select("repository", "relative_path"), owners).drop("_dir")
    contents = wanted.select("repository", "relative_path", "content")
    if maximum_files is None:
        return pairs.select("repository", "project_name", "relative_path").join(contents, ["repository", "relative_path"])
    order = [
        F.asc("repository"), F.asc(F.lower("project_name")), F.asc("_project_path"), F.asc(F.lower(directory(F.col("relative_path")))),
        F.asc(F.lower("relative_path")), F.asc("relative_path")]
    ranked = globally_ranked(pairs, order, "_rank", "source_order")
    first = ranked.groupBy("repository").agg(F.min("_rank").alias("_first"))
    kept = ranked.join(first, "repository").filter(F.col("_rank") - F.col("_first") < maximum_files)
    return kept.select("repository", "project_name", "relative_path").join(contents, ["repository", "relative_path"])


def repository_technologies(files: DataFrame, projects: DataFrame) -> DataFrame:
    """``repository, technology``: of its projects and its kinds of files."""
    ext = F.lower("extension")
    probes = F.array_compact(F.array(
        F.when(ext == ".sql", "SQL"), F.when(ext == ".razor", "Blazor"),
        F.when(ext.isin(".ts", ".tsx"), "TypeScript"), F.when(F.lower("file_name") == "package.json", "Node.js")))
    rows = files.select("repository", F.explode(probes).alias("technology")).unionByName(
        projects.select("repository", F.explode("technologies").alias("technology")))
    return rows.groupBy("repository", F.lower("technology").alias("_k")).agg(F.min("technology").alias("technology")).drop("_k")


def repository_summary(files: DataFrame, projects: DataFrame) -> DataFrame:
    """One row per repository; category counts stay a narrow table inside a map."""
    totals = files.groupBy("repository").agg(F.count(F.lit(1)).alias("total_files"), F.sum("size_bytes").alias("total_size_bytes"),
                                             F.count_if(F.lower("extension") == ".sln").alias("solutions"))
    by_category = files.groupBy("repository", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("repository").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("files_by_category"))
    tech = repository_technologies(files, projects).groupBy("repository").agg(
        F.array_sort(F.collect_list("technology")).alias("technologies"))
    counted = projects.groupBy("repository").agg(F.count(F.lit(1)).alias("projects"))
    return totals.join(by_category, "repository", "left").join(tech, "repository", "left").join(counted, "repository", "left").withColumn(
        "projects", F.coalesce("projects", F.lit(0)))


def repository_contributions(
    files: DataFrame, projects: DataFrame, application_hint: str = "", listed_files: int | None = None,
) -> DataFrame:
    """Statements about each repository, best one per key.

    Every SQL and configuration file is listed, or the first ``listed_files`` of each kind by path.
    """
    from faultline.operators.facts import dedupe_keep_best

    def row(kind, key, value, score, evidence, tags):
        lit = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(F.lit(kind).alias("type"), lit(key).alias("key"), lit(value).alias("value"), F.lit(score).alias("confidence_score"),
                        lit(evidence).alias("evidence"), F.array(*[lit(t) for t in tags]).alias("tags"))

    def say(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def rows(df, *items):
        return df.select("repository", F.inline(F.array(*items)))

    path, name, tech = F.col("relative_path"), F.col("name"), F.col("technology")
    repo = rows(files.select("repository").distinct(), row(
        "Repository", "Repository", F.col("repository"), 100, say("Repository root: ", F.col("repository")), ["repository"]))
    solutions = rows(files.filter(F.lower("extension") == ".sln"), row(
        "Repository", "Solution", path, 100, say("Solution discovered in repository: ", path), ["repository", "solution"]))
    techs = rows(repository_technologies(files, projects), row(
        "Technology", "Technology", tech, 95, say("Technology discovered from repository structure and project metadata: ", tech), ["repository", "technology"]))
    good = projects.filter(F.col("warning").isNull())
    own = rows(
        good,
        row("Component", "Project", name, 95, say("Project '", name, "' discovered at '", path, "'."), ["repository", "project", F.col("project_type")]),
        row("Technology", "TargetFramework", F.col("target_framework"), 100, say("Project '", name, "' targets ", F.col("target_framework"), "."), ["repository", "framework"]))
    each = lambda c, item: good.select("repository", F.inline(F.transform(c, item)))
    uses = each("technologies", lambda t: row("Technology", name, t, 95, say("Project '", name, "' uses ", t, "."), ["repository", "technology"]))
    stem = lambda r: F.when(file_stem(r) == "", r).otherwise(file_stem(r))
    refs = each("project_references", lambda r: row("Dependency", name, stem(r), 90, say("Project '", name, "' references '", r, "'."), ["repository", "project-reference"]))
    packs = each("package_references", lambda r: row("Dependency", name, r, 85, say("Project '", name, "' references NuGet package '", r, "'."), ["repository", "package-reference"]))
    n = F.col("n").cast("string")
    counts = rows(files.groupBy("repository", "category").agg(F.count(F.lit(1)).alias("n")), row(
        "Other", say("FileCategory:", F.col("category")), n, 100, say("Repository contains ", n, " ", F.col("category"), " file(s)."),
        ["repository", "file-category", F.col("category")]))
    order = Window.partitionBy("repository").orderBy(F.lower("relative_path"), "relative_path")

    def first(df):
        df = df.select("repository", "relative_path")
        return df if listed_files is None else df.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= listed_files)

    sql = rows(first(files.filter(F.lower("extension") == ".sql")), row(
        "DatabaseObject", "SqlFile", path, 70, say("SQL source file discovered: ", path), ["repository", "database", "sql-file"]))
    conf = rows(first(files.filter(F.col("category") == "Configuration")), row(
        "Configuration", "ConfigurationFile", path, 70, say("Configuration file discovered: ", path), ["repository", "configuration"]))
    everything = repo
    for df in (solutions, techs, own, uses, refs, packs, counts, sql, conf):
        everything = everything.unionByName(df)
    full = everything.filter(nonblank(F.col("value"))).withColumns({
        "application_id": F.lit(application_hint), "application_name": F.lit(application_hint), "source_kind": F.lit("SourceCode"),
        "source_name": F.lit("Repository Intelligence"), "is_identity_evidence": F.lit(False)})
    return dedupe_keep_best(full, ["application_id", "repository", "type", "key", "value"], [F.col("value"), F.col("evidence")])
