"""Queries over code repositories that are derived from the ``part`` table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import check, flat, shared
from checks.sql import q, query, step
from faultline.operators import source_code as sc
from faultline.plans.staging import new_folder
from faultline.sources import repository as rp

M = "cast(floor(p_partkey / 8) as int)"
NL = " || chr(10) || "
SVC = NL.join([
    "'namespace Shop.M' || m || ';'", "'public class Svc' || k || ' : Base, IRun {'", "'  // loads'",
    """'  public async Task<int> Load' || k || '(int a) { if (a > 1) { db.ExecuteSqlRaw("EXEC dbo.spLoad' || (k % 5) || ' @p"); } return _config["Key:' || (k % 3) || '"]; }'""",
    """'  private void Save() { cmd.CommandText = "dbo.SaveOrder"; using var c = new OrderDbContext(); var s = configuration.GetConnectionString("Main"); }'""",
    "'}'", "'public interface IRun { }'", """'public record Row' || (k % 2) || ' { public string Name() { return "x"; } }'"""])
PROJECT = """CASE WHEN m % 11 = 10 THEN '<Project Sdk="Broken">' WHEN m % 3 = 0 THEN
 '<Project Sdk="Microsoft.NET.Sdk.Web"><PropertyGroup><TargetFramework> net9.0 </TargetFramework></PropertyGroup><ItemGroup><PackageReference Include="Microsoft.EntityFrameworkCore" /><PackageReference Include="microsoft.entityframeworkcore" /><ProjectReference Include="../M0/M0.csproj" /></ItemGroup></Project>'
 WHEN m % 3 = 1 THEN '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><OutputType>Exe</OutputType><TargetFrameworks>net8.0;net9.0</TargetFrameworks></PropertyGroup><ItemGroup><PackageReference Include="EntityFramework" /></ItemGroup></Project>'
 ELSE '<Project xmlns="http://schemas.example.com/build"><PropertyGroup><targetframework>net48</targetframework></PropertyGroup></Project>' END"""
# (condition, path, content): expressions valid in both engines.
FILES = [
    ("true", "'src/M' || m || '/Svc' || k || '.cs'", SVC),
    ("k % 8 = 0", "'src/M' || m || '/M' || m || '.csproj'", PROJECT),
    ("k % 8 = 0 AND m < 4", "'Root.csproj'", "'<Project Sdk=\"Microsoft.NET.Sdk\"></Project>'"),
    ("k % 8 = 1 AND m % 2 = 0", "'src/M' || m || '/Inner/Inner' || m || '.csproj'", "'<Project Sdk=\"Microsoft.NET.Sdk\"></Project>'"),
    ("k % 8 = 1 AND m % 2 = 0", "'src/M' || m || '/Inner/In' || k || '.cs'", "'class In { }'"),
    ("k % 8 = 2", "'db/q' || k || '.sql'", "'select 1'"),
    ("k % 8 = 3", "'web/a' || k || '.ts'", "'x'"),
    ("k % 8 = 4", "'src/M' || m || '/bin/x' || k || '.cs'", "'class X { }'"),
    ("k % 8 = 5", "'tests/t' || k || '.cs'", "'class T { }'"),
    ("k % 8 = 6", "'src/M' || m || '/generated/g' || k || '.g.cs'", "'class G { }'"),
    ("k % 8 = 7", "'docs/r' || k || '.md'", "'doc'"),
    ("k % 8 = 7", "'lib/x' || k || '.dll'", "'binary'"),
    ("k % 40 = 7", "'web/p' || k || '/package.json'", "'{}'"),
    ("k % 64 = 0", "'All' || k || '.sln'", "'sln'"),
]
step("parts_km", "", f"SELECT p_partkey k, {M} m, 'repo' || ({M} % 4) repository FROM part")
step("repo_all", "parts_km", " UNION ALL ".join(f"SELECT repository, {p} relative_path, {c} AS content FROM parts_km WHERE {w}" for w, p, c in FILES))
_kinds = [k for ks in rp.CATEGORIES.values() for k in ks]
_cat = "CASE " + " ".join(f"WHEN extension IN ({', '.join(q(k) for k in ks)}) THEN {q(c)}" for c, ks in rp.CATEGORIES.items()) + " END"
step("repo_files", "repo_all", f"""SELECT *, {_cat} category FROM (SELECT *, lower(regexp_extract(relative_path, '(\\.[^./]*)$', 1)) extension, regexp_extract(relative_path, '([^/]*)$', 1) file_name,
  regexp_extract(relative_path, '^(.*)/[^/]*$', 1) dir, length(content) size_bytes FROM repo_all) WHERE extension IN ({', '.join(q(k) for k in _kinds)}) AND NOT regexp_matches('/' || lower(dir) || '/', '/(bin|obj|packages|node_modules|testresults)/')""")
step("projects", "repo_files parts_km", """SELECT f.*, regexp_replace(file_name, '\\.[^.]*$', '') AS name,
 CASE WHEN content LIKE '%Sdk.Web%' THEN 'Web' WHEN content LIKE '%Exe%' THEN 'Executable' WHEN content LIKE '%Broken%' THEN NULL ELSE 'Library' END project_type,
 CASE WHEN content LIKE '%net8.0;net9.0%' THEN 'net8.0;net9.0' WHEN content LIKE '%net9.0%' THEN 'net9.0' WHEN content LIKE '%net48%' THEN 'net48' WHEN content LIKE '%Broken%' THEN NULL ELSE '' END target_framework,
 CASE WHEN content LIKE '%Broken%' THEN NULL WHEN content LIKE '%M0.csproj%' THEN '../M0/M0.csproj' ELSE '' END refs,
 CASE WHEN content LIKE '%Broken%' THEN NULL WHEN content LIKE '%Microsoft.EntityFrameworkCore%' THEN 'Microsoft.EntityFrameworkCore' WHEN content LIKE '%EntityFramework%' THEN 'EntityFramework' ELSE '' END packs,
 CASE WHEN content LIKE '%Broken%' THEN 'Unable to inspect project ''' || relative_path || '''.' END warning,
 concat_ws(';', CASE WHEN content LIKE '%net8.0;net9.0%' THEN 'net8.0,net9.0' WHEN content LIKE '%net9.0%' THEN 'net9.0' WHEN content LIKE '%net48%' THEN 'net48' END,
  CASE WHEN content LIKE '%Sdk.Web%' THEN 'ASP.NET Core' WHEN content LIKE '%Microsoft.NET.Sdk%' THEN '.NET' END, CASE WHEN content LIKE '%Microsoft.EntityFrameworkCore%' THEN 'Entity Framework Core' END,
  CASE WHEN content LIKE '%EntityFramework%' THEN 'Entity Framework' END) tech
FROM repo_files f WHERE extension = '.csproj'""")


def listing(spark, sf):
    """``repository, relative_path, content, size_bytes`` of every file."""
    parts = fx.table(spark, sf, "part").selectExpr("p_partkey AS k", f"{M} AS m", f"'repo' || ({M} % 4) AS repository")
    rows = [parts.filter(w).selectExpr("repository", f"{p} AS relative_path", f"{c} AS content") for w, p, c in FILES]
    return reduce(lambda a, b: a.unionByName(b), rows).withColumn("size_bytes", F.length("content"))


@shared("repo_files")
def files(spark, sf):
    return rp.repository_files(listing(spark, sf))


@shared("repo_projects")
def projects(spark, sf):
    return rp.project_files(files(spark, sf))


@check("repository_files", query("SELECT repository, relative_path, extension, category, size_bytes FROM repo_files", "repo_files"))
def _(spark, sf):
    return rp.repository_files(listing(spark, sf)).select("repository", "relative_path", "extension", "category", "size_bytes")


@check("repository_file_scan", "SELECT 'tree' repository, 'k=' || (p_partkey % 16) dir, 'Configuration' category, count(*) rows_written FROM part GROUP BY 2")
def _(spark, sf):
    folder = new_folder(spark, "tree")
    parts = fx.table(spark, sf, "part").selectExpr("p_partkey", "p_name", "p_partkey % 16 AS k")
    parts.repartition("k").write.partitionBy("k").json(folder)
    found = rp.repository_file_scan(spark, folder, "tree")
    read = spark.read.text(folder, recursiveFileLookup=True).groupBy(
        F.regexp_extract(F.col("_metadata.file_path"), r"/(k=\d+)/", 1).alias("dir")).agg(F.count(F.lit(1)).alias("rows_written"))
    return found.select("repository", rp.directory(F.col("relative_path")).alias("dir"), "category").distinct().join(read, "dir")


KEEP = """NOT regexp_matches('/' || lower(relative_path), '/(bin|obj|\\.git|generated|test|tests)/|\\.tests/|\\.g\\.cs$|\\.generated\\.cs$')"""


@check("repository_path_filter", query(f"SELECT repository, relative_path FROM repo_all WHERE {KEEP}", "repo_all"))
def _(spark, sf):
    return listing(spark, sf).filter(rp.repository_path_filter(F.col("relative_path"))).select("repository", "relative_path")


@check("project_file_scan", query("SELECT repository, relative_path, name, project_type, target_framework, refs, packs, replace(tech, ',', ';') tech, warning FROM projects", "projects"))
def _(spark, sf):
    return rp.project_files(files(spark, sf)).select(
        "repository", "relative_path", "name", "project_type", "target_framework", flat(F.col("project_references")).alias("refs"),
        flat(F.col("package_references")).alias("packs"), F.coalesce(flat(F.col("technologies")), F.lit("")).alias("tech"), "warning")


step("owned", "repo_files projects", """SELECT f.repository, f.relative_path, p.name project_name, p.relative_path project_path, p.dir pdir FROM repo_files f JOIN projects p ON f.repository = p.repository AND p.warning IS NULL
  AND (p.dir = '' OR starts_with(lower(f.relative_path), lower(p.dir) || '/'))""")


@check("attach_project", query("""SELECT f.repository, f.relative_path, o.project_name FROM repo_files f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repository, relative_path ORDER BY length(pdir) DESC, project_path) rn FROM owned) o
  ON o.rn = 1 AND o.repository = f.repository AND o.relative_path = f.relative_path""", "repo_files owned"))
def _(spark, sf):
    return rp.attach_project(files(spark, sf), projects(spark, sf)).select("repository", "relative_path", "project_name")


step("sources", "owned", f"SELECT * FROM owned WHERE relative_path LIKE '%.cs' AND {KEEP}")
step("sources_cap", "sources", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY lower(project_name), project_path, lower(regexp_extract(relative_path, '^(.*)/[^/]*$', 1)), lower(relative_path)) rn FROM sources) WHERE rn <= 50""")


@shared("repo_sources")
def sources(spark, sf):
    return rp.source_file_scan(files(spark, sf), projects(spark, sf))


@check("source_file_scan", query("SELECT repository, project_name, relative_path FROM sources", "sources"))
def _(spark, sf):
    return rp.source_file_scan(files(spark, sf), projects(spark, sf)).select("repository", "project_name", "relative_path")


@check("source_file_scan_capped", query("SELECT repository, project_name, relative_path FROM sources_cap", "sources_cap"))
def _(spark, sf):
    return rp.source_file_scan(files(spark, sf), projects(spark, sf), maximum_files=50).select("repository", "project_name", "relative_path")


step("techs", "projects repo_files", """SELECT repository, technology FROM (SELECT repository, replace(unnest(string_split(tech, ';')), ',', ';') technology FROM projects WHERE tech <> '' UNION SELECT repository, 'SQL' FROM repo_files WHERE extension='.sql'
 UNION SELECT repository, 'TypeScript' FROM repo_files WHERE extension='.ts' UNION SELECT repository, 'Node.js' FROM repo_files WHERE file_name='package.json') GROUP BY 1, 2""")


@check("repository_summary", query("""SELECT f.repository, count(*) total_files, sum(size_bytes) total_size_bytes, count(*) FILTER (WHERE extension='.sln') solutions, count(*) FILTER (WHERE category='CSharp') csharp, count(*) FILTER (WHERE category='Database') sql_files,
  (SELECT string_agg(technology, '|' ORDER BY technology) FROM techs t WHERE t.repository = f.repository) technologies, (SELECT count(*) FROM projects p WHERE p.repository = f.repository) projects FROM repo_files f GROUP BY 1""", "repo_files techs projects"))
def _(spark, sf):
    s = rp.repository_summary(files(spark, sf), projects(spark, sf))
    return s.select("repository", "total_files", "total_size_bytes", "solutions", F.col("files_by_category")["CSharp"].alias("csharp"),
                    F.col("files_by_category")["Database"].alias("sql_files"), flat(F.col("technologies"), "|").alias("technologies"), "projects")


_listed = lambda where: f"(SELECT *, row_number() OVER (PARTITION BY repository ORDER BY lower(relative_path), relative_path) rn FROM repo_files WHERE {where})"
_k5 = lambda t, k, v, s, frm: f"SELECT repository, {q(t)} AS type, {k} AS key, {v} AS value, {s} confidence_score FROM {frm}"
step("k5", "repo_files projects techs", " UNION ALL ".join([
    _k5("Repository", "'Repository'", "repository", 100, "(SELECT DISTINCT repository FROM repo_files)"), _k5("Repository", "'Solution'", "relative_path", 100, "repo_files WHERE extension='.sln'"),
    _k5("Technology", "'Technology'", "technology", 95, "techs"), _k5("Component", "'Project'", "name", 95, "projects WHERE warning IS NULL"),
    _k5("Technology", "'TargetFramework'", "target_framework", 100, "projects WHERE warning IS NULL AND target_framework <> ''"),
    _k5("Technology", "name", "replace(t, ',', ';')", 95, "(SELECT repository, name, unnest(string_split(tech, ';')) t FROM projects WHERE warning IS NULL AND tech <> '')"),
    _k5("Dependency", "name", "'M0'", 90, "projects WHERE refs <> ''"), _k5("Dependency", "name", "packs", 85, "projects WHERE packs <> ''"),
    _k5("Other", "'FileCategory:' || category", "cast(n as varchar)", 100, "(SELECT repository, category, count(*) n FROM repo_files GROUP BY 1, 2)"),
    _k5("DatabaseObject", "'SqlFile'", "relative_path", 70, _listed("extension='.sql'")),
    _k5("Configuration", "'ConfigurationFile'", "relative_path", 70, _listed("category='Configuration'"))]))


@check("repository_contributions", query("SELECT repository, type, key, value, max(confidence_score) confidence_score FROM k5 GROUP BY 1, 2, 3, 4", "k5"))
def _(spark, sf):
    return rp.repository_contributions(files(spark, sf), projects(spark, sf)).select("repository", "type", "key", "value", "confidence_score")


# ---- C# sources -----------------------------------------------------------------------
step("svc", "sources", "SELECT repository, project_name, relative_path, cast(regexp_extract(relative_path, 'Svc(\\d+)', 1) as bigint) k FROM sources WHERE relative_path LIKE '%/Svc%'")
step("types", "svc sources", """
SELECT repository, project_name, relative_path, 'Shop.M' || (k // 8) || '.Svc' || k full_name, 'Class' kind, 'Base;IRun' bases FROM svc
UNION ALL SELECT repository, project_name, relative_path, 'Shop.M' || (k // 8) || '.IRun', 'Interface', '' FROM svc
UNION ALL SELECT repository, project_name, relative_path, 'Shop.M' || (k // 8) || '.Row' || (k % 2), 'Record', '' FROM svc
UNION ALL SELECT repository, project_name, relative_path, 'In', 'Class', '' FROM sources WHERE relative_path LIKE '%/In%' AND relative_path NOT LIKE '%/Svc%'""")
step("methods", "svc", """
SELECT *, 'Svc' || k type_name, 'Load' || k AS name, 'public async Task<int> Load' || k || '(int a)' signature, 4 line_number, 'spLoad' || (k % 5) ops, '' ctx, 'Key:' || (k % 3) keys FROM svc
UNION ALL SELECT *, 'Svc' || k, 'Save', 'private void Save()', 5, 'SaveOrder', 'OrderDbContext', 'ConnectionStrings:Main' FROM svc
UNION ALL SELECT *, 'Row' || (k % 2), 'Name', 'public string Name()', 8, '', '', '' FROM svc""")


@shared("source_types")
def types(spark, sf):
    return sc.source_types(sources(spark, sf))


@shared("source_methods")
def methods(spark, sf):
    return sc.source_methods(types(spark, sf), sources(spark, sf))


@check("source_types", query("SELECT repository, project_name, relative_path, full_name, kind, bases FROM types", "types"))
def _(spark, sf):
    return sc.source_types(sources(spark, sf)).select(*sc.FILE, "full_name", "kind", flat(F.col("base_types")).alias("bases"))


@check("source_methods", query("SELECT repository, project_name, relative_path, type_name, name, signature, line_number FROM methods", "methods"))
def _(spark, sf):
    return sc.source_methods(types(spark, sf), sources(spark, sf)).select(*sc.FILE, "type_name", "name", "signature", "line_number")


@check("method_db_operations", query("SELECT repository, project_name, relative_path, name, ops, ctx FROM methods", "methods"))
def _(spark, sf):
    return methods(spark, sf).select(*sc.FILE, "name", flat(F.col("database_operations")).alias("ops"), flat(F.col("db_contexts")).alias("ctx"))


@check("method_config_keys", query("SELECT repository, project_name, relative_path, name, keys FROM methods", "methods"))
def _(spark, sf):
    return methods(spark, sf).select(*sc.FILE, "name", flat(F.col("configuration_keys")).alias("keys"))


@check("repository_db_references", query("""SELECT repository, project_name, relative_path, type_name class_name, name method_name, line_number, ops operation, ctx db_context,
  CASE WHEN ctx='' THEN 'Unknown' ELSE 'EntityFrameworkCore' END database_type FROM methods WHERE ops <> ''""", "methods"))
def _(spark, sf):
    return sc.repository_db_references(methods(spark, sf))


@check("repository_config_references", query("SELECT repository, project_name, relative_path, type_name class_name, name method_name, keys AS key FROM methods WHERE keys <> ''", "methods"))
def _(spark, sf):
    return sc.repository_config_references(methods(spark, sf))


@check("source_summary", query("""SELECT repository, (SELECT count(*) FROM projects p WHERE p.repository=s.repository) project_count, count(*) source_file_count, (SELECT count(*) FROM types p WHERE p.repository=s.repository) type_count,
  (SELECT count(*) FROM methods p WHERE p.repository=s.repository) method_count, (SELECT count(*) FROM methods p WHERE p.repository=s.repository AND ops <> '') database_reference_count FROM sources s GROUP BY 1""", "sources projects types methods"))
def _(spark, sf):
    return sc.source_summary(projects(spark, sf), sources(spark, sf), types(spark, sf), methods(spark, sf), sc.repository_db_references(methods(spark, sf)))


@check("analyze_code", query("""SELECT repository, (SELECT count(*) FROM methods p WHERE p.repository=s.repository) method_count, (SELECT count(*) FROM methods p WHERE p.repository=s.repository AND ops <> '') database_reference_count FROM sources s GROUP BY 1""", "sources methods"))
def analyze(spark, sf):
    """The whole plan from files to counts, nothing reused."""
    from faultline.plans.code import analyze_code
    found = analyze_code(rp.repository_files(listing(spark, sf)))
    return found.summary.select("repository", "method_count", "database_reference_count")
