"""Files as they come: encodings, loose stamps, odd JSON, code trees."""

import json

import pytest
from pyspark.sql import functions as F

from faultline.functions.eventviewer import parse_stamp
from faultline.plans.code import analyze_code
from faultline.sources import logs, openapi, repository

RECORD = "Error\t1/2/2024 3:04:05 PM\tShop\t7\tNone\tOrder failed für ü\r\nmore\r\n"


@pytest.mark.parametrize("stamp,want", [
    ("Jan 2, 2024 3:04:05 PM", "2024-01-02 15:04:05"), ("1/2/24 3:04 PM", "2024-01-02 15:04:00"), ("January 2, 2024", "2024-01-02 00:00:00"),
    ("Tue, 02 Jan 2024 03:04:05 GMT", "2024-01-02 03:04:05"), ("1-2-2024 3:04:05 PM", "2024-01-02 15:04:05"),
    ("Tuesday, January 2, 2024 3:04 PM", "2024-01-02 15:04:00"), ("1/2/2024 3:04:05 PM", "2024-01-02 15:04:05"), ("2.1.2024 15.04.05", "2024-01-02 15:04:05"),
    ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"), ("hello", None), ("", None), ("May", None),
])
def test_stamps(spark, stamp, want):
    row = spark.createDataFrame([(stamp,)], "s string").select(F.date_format(parse_stamp(F.col("s")), "yyyy-MM-dd HH:mm:ss").alias("t")).first()
    assert row.t == want


@pytest.mark.parametrize("encoding,mark", [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-8", b"\xef\xbb\xbf"), ("utf-8", b"")])
def test_encodings(spark, tmp_path, encoding, mark):
    (tmp_path / "a.txt").write_bytes(mark + RECORD.encode(encoding))
    read = logs.log_line_scan(spark, str(tmp_path))
    assert [(r.line_no, r.value) for r in read.orderBy("line_no").collect()] == [(1, RECORD.split("\r\n")[0]), (2, "more")]
    entry = logs.normalize_entries(read).collect()
    assert len(entry) == 1 and entry[0].severity == "Error"


def test_one_folder_of_all_encodings_in_small_splits(spark, tmp_path):
    """Characters that hold the byte 10 in either half, every kind of line end, and files cut anywhere."""
    import random
    import re
    rng = random.Random(4)
    pieces = ["a", "Zeile", "\u0a0a", "\u4e0a", "\u0a00", "\u4e00", "\u0100", "\u0a0d", "\u000d\u000a", "\n", "\n", "\r", "\r\n", "", " ", "😀"]
    texts = {f"f{i}-{e}.log": ("".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 40, 900]))), e)
             for i in range(6) for e in ("utf-8", "utf-16-le", "utf-16-be")}
    texts |= {f"end-{e}.log": ("x\n\n", e) for e in ("utf-8", "utf-16-le", "utf-16-be")}
    marks = {"utf-8": b"", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
    want = []
    for file, (text, e) in texts.items():
        (tmp_path / file).write_bytes(marks[e] + text.encode(e))
        if marks[e] or text:
            want += [(file, n, line) for n, line in enumerate(re.split(r"\r\n|\r|\n", re.sub(r"(\r\n|\r|\n)\Z", "", text)), 1)]
    for size in ("64", "1000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = logs.log_line_scan(spark, str(tmp_path), lambda p: F.regexp_extract(p, "([^/]+)$", 1)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted((r.source, r.line_no, r.value) for r in got) == sorted(want), size


def test_openapi_takes_strings_only(spark):
    document = {
        "info": {"title": "T", "version": 1.5, "description": "d" * 1500}, "servers": ["x", {"url": "https://h"}, {"url": 3}, 5],
        "paths": {"/a": {"get": {"operationId": 7, "summary": "s", "tags": ["one", 3, None]}, "x-note": {}}, "/b": "no"},
        "components": {"schemas": {"S": {}}}}
    files = [("/d/api.json", json.dumps(document)), ("/d/api.yaml", "openapi: 3"), ("/d/bad.json", "{")]
    documents = openapi.openapi_documents(spark.createDataFrame(files, "path string, content string"))
    got = {(r.key, r.value) for r in openapi.openapi_contributions(documents).collect()}
    assert got == {("OpenApiTitle", "T"), ("ApiDescription", "d" * 1000), ("Specification", "OpenAPI"), ("ApiServer", "https://h"), ("Route", "/a"),
                   ("Route", "/b"), ("Operation", "GET /a"), ("Summary:GET /a", "s"), ("ApiTag:GET /a", "one"), ("ApiSchema", "S")}
    assert ("ApiDescription", "d" * 1500) in {(r.key, r.value) for r in openapi.openapi_contributions(documents, description_limit=None).collect()}
    assert openapi.openapi_warnings(documents).count() == 2


def test_openapi_locations_without_a_file(spark):
    files = spark.createDataFrame([("file:/k/specs/orders.json", '{"info": {"title": "T"}}'), ("file:/k/my-orders.json", "{}")], "path string, content string")
    places = spark.createDataFrame([("specs/Orders.json",), ("./other.json",)], "location string")
    got = openapi.located_documents(places, files).collect()
    assert sorted((r.path, r.warning is None) for r in got) == [("./other.json", False), ("file:/k/specs/orders.json", True)]


def test_code_tree(spark, tmp_path):
    project = tmp_path / "src" / "Shop"
    project.mkdir(parents=True)
    (project / "Shop.csproj").write_text('<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup></Project>')
    (project / "Orders.cs").write_bytes(b"\xff\xfe" + "namespace Shop; public class Orders { public void Run() { } }".encode("utf-16-le"))
    (project / "notes.md").write_text("text")
    (project / "logo.png").write_bytes(b"\x89PNG")
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "Old.cs").write_text("class Old { }")
    tree = repository.code_tree(spark, str(tmp_path), "shop")
    assert {r.relative_path: r.content is not None for r in tree.collect()} == {
        "src/Shop/Shop.csproj": True, "src/Shop/Orders.cs": True, "src/Shop/notes.md": False}
    found = analyze_code(tree)
    assert [r.name for r in found.projects.collect()] == ["Shop"]
    assert found.types.count() == 1 and found.methods.count() == 1
    assert found.summary.first().source_file_count == 1


def test_no_file_is_left_out(spark):
    rows = [("r", "p/P.csproj", "<Project/>")] + [("r", f"p/F{i}.cs", f"class F{i} {{ }}") for i in range(5200)]
    listing = spark.createDataFrame(rows + [("r", f"s/{i}.sql", "") for i in range(130)], "repository string, relative_path string, content string")
    files = repository.repository_files(listing)
    projects = repository.project_files(files)
    assert repository.source_file_scan(files, projects).count() == 5200
    assert repository.source_file_scan(files, projects, maximum_files=5000).count() == 5000
    listed = repository.repository_contributions(files.withColumn("size_bytes", F.lit(1)), projects)
    assert listed.filter("key = 'SqlFile'").count() == 130
    assert repository.repository_contributions(files.withColumn("size_bytes", F.lit(1)), projects, listed_files=100).filter("key = 'SqlFile'").count() == 100


@pytest.mark.parametrize("document,error", [
    ('{"components": [{"name": "a", "keywords": ["x", null]}], "workflows": null}', None),
    ('{"components": ["x", {"name": "a"}]}', "components.*array of objects"),
    ('{"components": [{"name": "a", "apiPaths": "one"}]}', "apiPaths.*list of string"),
    ('{"components": [{"name": "a", "keywords": ["x", 3]}]}', "keywords.*list of string"),
])
def test_knowledge_files_are_read_strictly(spark, document, error):
    from faultline.sources.knowledge import parse_knowledge_base

    found = parse_knowledge_base(spark.createDataFrame([("/k.json", document)], "path string, content string")).components
    if error:
        with pytest.raises(Exception, match=error):
            found.collect()
    else:
        assert [(r.name, r.keywords, r.api_paths) for r in found.collect()] == [("a", ["x", None], [])]
