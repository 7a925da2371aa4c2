"""TEI documents as lines: a streaming pull over mixed content that keeps its order.

A line is the text between two ``lb`` marks of the body.  The header is skipped, of
variant readings the ``lem`` is kept and the ``rdg`` is not, and a chapter (juan) mark
counts for the line in which it stands.  A document that cannot be read is one row
with ``error``; it does not fail the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import work_of_text
from quire.schema import PARSED


class TeiError(ValueError):
    pass


def _number(text: str | None) -> int | None:
    digits = (text or "").removeprefix("+")
    return int(digits) if digits.isascii() and digits.isdigit() and int(digits) < 1 << 63 else None


class _Lines:
    """The handlers' state; ``done`` has (line_id, work_id, juan, text, lb)."""

    def __init__(self) -> None:
        self.done: list[tuple[str, str, int, str, str]] = []
        self.document, self.juan, self.mark = "", 0, None
        self.text: list[str] = []
        self.header = self.readings = 0
        self.body = False

    def close(self) -> None:
        if self.mark is None:
            return
        if not self.document:
            raise TeiError("TEI xml:id is missing")
        self.done.append((f"{self.document}_p{self.mark}", work_of_text(self.document), self.juan, "".join(self.text).strip(), self.mark))
        self.mark = None

    def start(self, name: str, attributes: dict[str, str]) -> None:
        local = name.rpartition(":")[2]
        values = {k.rpartition(":")[2]: v for k, v in attributes.items()}
        if local == "teiHeader" or self.header:
            self.header += 1
        elif local in ("TEI", "tei"):
            self.document = values.get("id", self.document)
        elif local == "body":
            self.body = True
        elif local == "juan" or (local == "milestone" and values.get("unit") == "juan"):
            found = _number(values.get("n"))
            self.juan = self.juan if found is None else found
        elif local == "rdg":
            self.readings += 1
        elif local == "lb" and self.body:
            self.close()
            self.mark = values.get("n")
            self.text = []

    def end(self, name: str) -> None:
        local = name.rpartition(":")[2]
        if self.header:
            self.header -= 1
        elif local == "rdg":
            self.readings = max(0, self.readings - 1)
        elif local == "body":
            self.close()
            self.body = False

    def characters(self, text: str) -> None:
        if self.body and not self.header and not self.readings and self.mark is not None:
            self.text.append(text)


def parse_lines(content: bytes | str) -> list[tuple[str, str, int, str, str]]:
    """(line_id, work_id, juan, text, lb) in document order; bytes that are no UTF-8 are replaced."""
    text = content if isinstance(content, str) else content.decode("utf-8", "replace")
    state = _Lines()
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = state.start, state.end, state.characters
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as problem:
        raise TeiError(str(problem)) from problem
    state.close()
    if not state.document:
        raise TeiError("TEI xml:id is missing")
    return state.done


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.string()) for f in PARSED])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                rows = [(path, i, *line, None) for i, line in enumerate(parse_lines(content or b""))]
            except TeiError as problem:
                rows = [(path, None, None, None, None, None, None, str(problem))]
            ordered = [(p, s, i, w, j, t, n, e) for p, s, i, w, j, t, n, e in rows]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in ordered], schema=schema)


def read_lines(files: DataFrame) -> DataFrame:
    """Files (path, content) to parsed lines, file by file on the executors."""
    return files.select("path", "content").mapInArrow(_parse, PARSED)


def read_files(spark: SparkSession, root: str, glob: str = "*.xml") -> DataFrame:
    """(path below ``root``, content, xml_sha256) of all documents of a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    below = F.substring_index(F.col("path"), root.rstrip("/").removeprefix("file://") + "/", -1)
    return found.select(below.alias("path"), "content", F.sha2("content", 256).alias("xml_sha256"))
