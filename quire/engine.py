"""One opened artifact and everything that can be asked of it."""

from __future__ import annotations

import json
from dataclasses import replace
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import catalog as cat
from quire.operators import lookup, verify
from quire.operators.search import LIMIT, search
from quire.plans import dsl, match
from quire.plans.filters import Filters
from quire.schema import CATALOG, GRAMS
from quire.sources import corpus


class Engine:
    """The lines stay those of the artifact that was opened, even if another becomes current."""

    def __init__(self, spark: SparkSession, lines: DataFrame, catalog: DataFrame | None = None, meta: dict | None = None, traditional: bool = True, gaiji: dict[str, str] | None = None, grams: DataFrame | None = None):
        self.spark, self.lines, self.catalog, self.meta, self.gaiji, self.grams = spark, lines, catalog, meta or {}, gaiji or {}, grams
        self.script = tx.script_map(spark, "Hans-Hant") if traditional else {}
        self._stats: dict[str, int] = {}

    @classmethod
    def open(cls, spark: SparkSession, index_root: str, **how) -> Engine:
        artifact = corpus.active_artifact(index_root)
        meta = json.loads((artifact / "meta.json").read_text()) if (artifact / "meta.json").is_file() else {}
        rows = spark.read.schema(CATALOG).parquet(f"file://{artifact.resolve()}/catalog")
        grams = spark.read.schema(GRAMS).parquet(f"file://{artifact.resolve()}/grams") if (artifact / "grams").is_dir() else None
        return cls(spark, corpus.open_lines(spark, artifact.resolve()), rows, meta | {"index_path": str(artifact)}, grams=grams, **how)

    def norm(self, text: str) -> str:
        return tx.search_key_text(text, self.script, self.gaiji)

    @cached_property
    def size(self) -> tuple[int, float]:
        if "lines" in self.meta:
            return self.meta["lines"], self.meta["mean_length"]
        row = self.lines.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
        return row["n"], row["mean"] or 0.0

    def statistics(self, grams: set[str]) -> match.Stats:
        """Counts of grams are kept; those not asked for before are looked up in the index, or cost a pass where it has none."""
        new = grams - self._stats.keys()
        if new and self.grams is not None and all(len(g) <= 2 for g in new):
            found = self.grams.where(F.col("gram").isin(*sorted(new))).collect()  # as many rows as the query has grams
            self._stats |= dict.fromkeys(new, 0) | {r["gram"]: r["df"] for r in found}
        elif new:
            self._stats |= match.statistics(self.lines, new).with_gram
        return match.Stats(*self.size, {g: self._stats[g] for g in grams})

    def parse(self, query: str, mode: str | None = None) -> dsl.ParsedQuery:
        return dsl.with_mode(dsl.parse(query), mode)

    def search(self, query: str | dsl.ParsedQuery, filters: Filters = Filters(), limit: int = LIMIT, mode: str | None = None, extended: bool = False) -> DataFrame:
        parsed = dsl.with_mode(query, mode) if isinstance(query, dsl.ParsedQuery) else self.parse(query, mode)
        if extended and (filters.types or filters.categories) and self.catalog is not None:
            works = self.catalog
            if filters.types:
                works = works.where(F.col("work_type").isin(*filters.types))
            if filters.categories:
                works = works.where(F.col("category").isin(*filters.categories))
            kept = self.lines.join(works.select("path").distinct(), "path", "left_semi")
        else:
            kept = self.lines
        stats = self.statistics(match.grams_needed(match.plan(parsed, self.norm, extended)))
        return search(kept, parsed, self.norm, filters, limit, stats, extended)

    def verify(self, quote: str) -> verify.Report:
        return verify.verify(self.lines, quote, self.norm)

    def verify_batch(self, quotes: DataFrame) -> DataFrame:
        """``quotes`` (quote_id, quote)."""
        return verify.verify_batch(self.lines, quotes.select("quote_id", tx.search_key(F.col("quote"), self.script, self.gaiji).alias("quote_norm")))

    def get(self, line_id: str, context: int = 0) -> DataFrame:
        return lookup.get_context(self.lines, line_id, context)

    def read(self, work_id: str, juan: int) -> DataFrame:
        return lookup.read_juan(self.lines, work_id, juan)

    def cite(self, line_id: str) -> str | None:
        row = lookup.cite(self.lines, line_id).first()
        return row["citation"] if row else None

    def entries(self, filters: Filters = Filters()) -> DataFrame:
        if self.catalog is None:
            raise corpus.CorpusError("no catalog")
        return cat.entries(self.catalog, self.meta.get("tag", ""), self.meta.get("scope_hash", ""), filters)

    def info(self) -> dict:
        tag, scope_hash = self.meta.get("tag", ""), self.meta.get("scope_hash", "")
        return {"tag": tag, "scope": self.meta.get("scope", ""), "artifact_id": f"{tag}+{scope_hash}", "work_count": self.meta.get("work_count", 0), "index_path": self.meta.get("index_path", "")}

    def shown(self, hits: DataFrame, script: str | None) -> DataFrame:
        """Titles, authors and texts in simplified script if asked for; ids and citations as they are."""
        if script != "s":
            return hits
        simple = tx.script_map(self.spark, "Hant-Hans")
        return hits.withColumns({c: tx.convert_script(F.col(c), simple) for c in ("title", "author", "text_raw")})

    def marked(self, hits: DataFrame, terms, before: str = "\x1b[1;31m", after: str = "\x1b[0m") -> DataFrame:
        """Texts with the first term that occurs between marks, each term as it is, then in either script."""
        maps = [{}, *(tx.script_map(self.spark, name) for name in ("Hans-Hant", "Hant-Hans"))]
        needles = dict.fromkeys(term.translate(str.maketrans(m)) for term in terms for m in maps)
        return hits.withColumn("text_raw", tx.highlighted(F.col("text_raw"), list(needles), before, after))


def session_file(root: str) -> Path:
    return Path(root) / "last.json"


def save_session(engine: Engine, root: str, query: str, filters: Filters, hits: list[dict]) -> None:
    from quire.sinks.publish import write_json

    info = engine.info()
    write_json(session_file(root), {"query": query, "filters": vars(filters), "hits": hits, "artifact_id": info["artifact_id"], "tag": info["tag"]})


def load_session(engine: Engine, root: str) -> dict:
    path = session_file(root)
    if not path.is_file():
        raise corpus.CorpusError("no saved session")
    saved, info = json.loads(path.read_text()), engine.info()
    if saved.get("artifact_id") != info["artifact_id"] or saved.get("tag") != info["tag"]:
        raise corpus.CorpusError("the saved session is of another index")
    return saved


def pick(hits: list[dict], number: int) -> dict:
    """The hit of a number from 1."""
    if not 1 <= number <= len(hits):
        raise corpus.CorpusError(f"no hit {number} of {len(hits)}")
    return hits[number - 1]


__all__ = ["Engine", "Filters", "load_session", "pick", "replace", "save_session"]
