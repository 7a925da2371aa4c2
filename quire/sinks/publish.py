"""Finished builds become visible at once: written aside, renamed, then named by CURRENT."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame

from quire.sources.corpus import CorpusError, require_segment


class Locked(CorpusError):
    pass


def _replace(path: Path, text: str) -> None:
    aside = path.with_name(f"{path.name}.{os.getpid()}.tmp")
    with aside.open("w") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    os.replace(aside, path)


def write_current(root: Path, name: str) -> None:
    _replace(root / "CURRENT", require_segment(name) + "\n")


def read_current(root: Path) -> str | None:
    path = root / "CURRENT"
    return (path.read_text().strip() or None) if path.is_file() else None


def stage(root: Path, name: str) -> Path:
    """An empty place to write to."""
    aside = root / f"{require_segment(name)}.tmp"
    shutil.rmtree(aside, ignore_errors=True)
    aside.mkdir(parents=True)
    return aside


def publish(root: Path, name: str, aside: Path) -> Path:
    """Rename what was staged; a build of that name that is there already stays, under the new one's side."""
    target = root / name
    if target.exists():
        target = root / f"{name}.{time.time_ns()}"
    os.rename(aside, target)
    write_current(root, target.name)
    return target


def write_lines(lines: DataFrame, folder: Path) -> None:
    """Sorted by id inside ranges of works, so that an id or a work is found by the files' statistics."""
    ordered = lines.repartitionByRange("work_id", "line_id").sortWithinPartitions("work_id", "line_id")
    ordered.write.option("parquet.bloom.filter.enabled#norm_hash", "true").parquet(f"file://{folder}/lines")


def write_grams(grams: DataFrame, folder: Path) -> None:
    grams.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"file://{folder}/grams")


def write_json(path: Path, value: dict) -> None:
    _replace(path, json.dumps(value, ensure_ascii=False, indent=1))


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


@contextlib.contextmanager
def single_writer(root: Path) -> Iterator[None]:
    """One writer at a time; the lock of a process that is gone is taken over."""
    root.mkdir(parents=True, exist_ok=True)
    path = root / ".lock"
    for _ in range(2):
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            owner = path.read_text().strip()
            if owner.isdigit() and _alive(int(owner)):
                raise Locked(f"process {owner} is writing to {root}") from None
            path.unlink(missing_ok=True)
    else:
        raise Locked(f"{root} is locked")
    try:
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        yield
    finally:
        path.unlink(missing_ok=True)
