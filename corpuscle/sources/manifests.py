"""Dependency manifests and lock files to exact evidence: (path, ecosystem, module, version, integrity)."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.scalars import basename
from corpuscle.operators.relations import longest_prefix

SCHEMA = "path string, ecosystem string, module string, version string, integrity string"


def go_mod(text: str) -> list[tuple]:
    bare = re.sub(r"//.*", "", text)
    blocks = re.findall(r"require\s*\(([^)]*)\)", bare) + re.findall(r"^require\s+([^(\n]+)$", bare, re.M)
    return [("go", m, v, "") for b in blocks for m, v in re.findall(r"(\S+)\s+(v\S+)", b)]


def npm_lock(text: str) -> list[tuple]:
    data = json.loads(text)
    packages = {k.rpartition("node_modules/")[2]: v for k, v in data.get("packages", {}).items() if "node_modules/" in k} or data.get("dependencies", {})
    return [("npm", name, p.get("version", ""), p.get("integrity", "")) for name, p in packages.items()]


def cargo_lock(text: str) -> list[tuple]:
    return [("cargo", p["name"], p["version"], p.get("checksum", "")) for p in tomllib.loads(text).get("package", [])]


def maven(text: str) -> list[tuple]:
    root = ET.fromstring(text)
    space = root.tag.partition("}")[0] + "}" if root.tag.startswith("{") else ""
    of = lambda d, tag: (d.findtext(f"{space}{tag}") or "").strip()
    return [("maven", f"{of(d, 'groupId')}:{of(d, 'artifactId')}", of(d, "version"), "") for d in root.iter(f"{space}dependency")]


PARSERS = {"go.mod": go_mod, "package-lock.json": npm_lock, "Cargo.lock": cargo_lock, "pom.xml": maven}


def dependencies(files: DataFrame) -> DataFrame:
    """The evidence of all manifests among files (path, content); broken manifests give a row without a module."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = path.rpartition("/")[2]
                try:
                    rows += [(path, *r) for r in PARSERS[name](content)]
                except (ValueError, KeyError, ET.ParseError):
                    rows.append((path, name, None, None, None))
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=["path", "ecosystem", "module", "version", "integrity"])

    return files.where(basename(F.col("path")).isin(*PARSERS)).select("path", "content").mapInArrow(parse, SCHEMA)


def qualified_imports(imports: DataFrame, evidence: DataFrame) -> DataFrame:
    """Import paths (name) with the module that provides them: the longest that is a prefix by whole segments."""
    modules = evidence.where("module is not null").select(F.col("module").alias("prefix"), F.concat_ws("@", "module", "version").alias("module")).distinct()
    return longest_prefix(imports, modules)
