"""A code tree to types, methods, references and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from faultline.operators import source_code as sc
from faultline.plans.staging import staged
from faultline.sources import repository as rp


@dataclass
class CodeKnowledge:
    projects: DataFrame
    types: DataFrame
    methods: DataFrame
    database_references: DataFrame
    configuration_references: DataFrame
    summary: DataFrame


def analyze_code(
    files: DataFrame, include_generated: bool = False, include_tests: bool = False,
    maximum_files: int | None = None,
) -> CodeKnowledge:
    """``files`` hold ``repository, relative_path, content``; ``code_tree`` reads them from a folder."""
    projects = staged(rp.project_files(files), "projects")
    sources = staged(rp.source_file_scan(files, projects, include_generated, include_tests, maximum_files), "sources")
    types = staged(sc.source_types(sources), "types")
    methods = staged(sc.source_methods(types, sources), "methods")
    references = sc.repository_db_references(methods)
    return CodeKnowledge(
        projects, types, methods, references, sc.repository_config_references(methods),
        sc.source_summary(projects, sources, types, methods, references))
