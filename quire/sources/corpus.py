"""Catalogs, file lists, manifests and the place of the active build."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.schema import CATALOG, LINES


class CorpusError(RuntimeError):
    pass


class NoIndex(CorpusError):
    pass


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped, a broken line is an error, null and missing texts are empty."""
    text = spark.read.text(path).where(F.trim("value") != "")
    rows = text.select(F.from_json("value", CATALOG, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    needed = F.col("work_id").isNotNull() & F.col("canon").isNotNull() & F.col("path").isNotNull()
    problem = F.raise_error(F.lit("catalog row without work_id, canon or path")).cast("string")
    rows = rows.withColumn("work_id", F.when(needed, F.col("work_id")).otherwise(problem))
    return rows.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.name in ("title", "author", "dynasty", "category", "work_type") else F.col(f.name) for f in CATALOG])


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, place): one a line, without blank lines and ``#`` comments."""
    named = [x.strip() for x in Path(path).read_text().splitlines()]
    rows = [(x, i) for i, x in enumerate(x for x in named if x and not x.startswith("#"))]
    return spark.createDataFrame(rows, "path string, place long")


@dataclass(frozen=True)
class Manifest:
    tag: str
    scope: str
    scope_hash: str
    work_count: int = 0
    exclude_canons: tuple[str, ...] = ()
    label: str = ""

    @property
    def artifact(self) -> str:
        return f"{self.tag}-{self.scope_hash}"

    @property
    def artifact_id(self) -> str:
        return f"{self.tag}+{self.scope_hash}"


def read_manifest(path: str) -> Manifest:
    """The tag is the key ``tag``, or one that ends so; unknown keys are ignored."""
    found = json.loads(Path(path).read_text())
    tag = found.get("tag") or next((v for k, v in found.items() if k.endswith("_tag")), None)
    if not tag or "scope_hash" not in found:
        raise CorpusError(f"{path}: tag or scope_hash is missing")
    label = found.get("label") or next((k.removesuffix("_tag").upper() for k in found if k.endswith("_tag")), "")
    return Manifest(tag, found.get("scope", ""), found["scope_hash"], int(found.get("work_count") or 0), tuple(found.get("exclude_canons") or ()), label)


@dataclass(frozen=True)
class Scope:
    name: str
    canons: tuple[str, ...] = ()
    works: tuple[str, ...] = ()
    exclude_canons: tuple[str, ...] = ()


def in_scope(catalog: DataFrame, scope: Scope) -> DataFrame:
    kept = catalog
    if scope.canons:
        kept = kept.where(F.col("canon").isin(*scope.canons))
    if scope.works:
        kept = kept.where(F.col("work_id").isin(*scope.works))
    return kept.where(~F.col("canon").isin(*scope.exclude_canons)) if scope.exclude_canons else kept


def require_segment(name: str) -> str:
    """A name that can be one part of a path."""
    if not name or name in (".", "..") or re.search(r"[/\\\0]", name):
        raise CorpusError(f"not a path segment: {name!r}")
    return name


def is_below(path: str) -> bool:
    return not path.startswith("/") and ".." not in path.split("/")


def below(path: Column) -> Column:
    """The same of a column."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def active_artifact(root: str) -> Path:
    """What CURRENT names, else the only finished build."""
    base = Path(root)
    current = base / "CURRENT"
    if current.is_file() and (name := current.read_text().strip()):
        found = base / require_segment(name)
        if found.is_dir():
            return found
        raise NoIndex(f"CURRENT names {name}, which is not there")
    built = [p for p in sorted(base.glob("*-*")) if p.is_dir() and not p.name.endswith(".tmp")]
    if len(built) != 1:
        raise NoIndex(f"no index in {root}: " + ("none is built" if not built else "several are built and CURRENT names none"))
    return built[0]


def open_lines(spark: SparkSession, artifact: Path) -> DataFrame:
    return spark.read.schema(LINES).parquet(str(artifact / "lines"))
