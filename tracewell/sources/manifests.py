"""Dependencies declared by Python projects."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.files import basename


def _requirement(name: str, spec) -> str:
    """A requirement from an entry of a table: a version, or an object with one; ``*`` and carets as plain names or bounds."""
    version = spec.get("version", "") if isinstance(spec, dict) else spec if isinstance(spec, str) else ""
    version = version.replace("^", ">=").replace("~", ">=") if version != "*" else ""
    return name + (version if not version or version[0] in "<>=!~" else f"=={version}")


def project_requirements(text: str) -> list[str]:
    """Requirements of a pyproject file: its list, the optional ones and the tool's table; none if it doesn't parse."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return []
    project = data.get("project", {})
    listed = [*project.get("dependencies", []), *(r for group in project.get("optional-dependencies", {}).values() for r in group)]
    table = data.get("tool", {}).get("poetry", {}).get("dependencies", {})
    return [r for r in listed if isinstance(r, str)] + [_requirement(k, v) for k, v in table.items() if k.lower() != "python"]


def python_requirements(files: DataFrame) -> DataFrame:
    """file_path, requirement of manifests (file_path, code): in each folder requirements.txt, or else pyproject.toml."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path.endswith("requirements.txt"):
                    lines = (x.split("#")[0].strip() for x in (code or "").splitlines())
                    rows += [(path, x) for x in lines if x and not x.startswith("-")]
                else:
                    rows += [(path, x) for x in project_requirements(code or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["file_path", "requirement"])

    named = files.withColumn("name", basename(F.col("file_path"))).where(F.col("name").isin("requirements.txt", "pyproject.toml"))
    named = named.withColumn("folder", F.regexp_replace("file_path", "[^/]*$", ""))
    listed = named.where("name = 'requirements.txt'").select("folder").distinct()
    chosen = named.where("name = 'requirements.txt'").unionByName(named.where("name = 'pyproject.toml'").join(listed, "folder", "left_anti").select(named.columns))
    return chosen.select("file_path", "code").mapInArrow(parse, "file_path string, requirement string")
