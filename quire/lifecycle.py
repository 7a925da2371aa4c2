"""Releases of a corpus: what is there, which is current, what can go.  Plain control code, no Spark job."""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import time
from pathlib import Path

from quire.sinks.publish import _replace, read_current, single_writer, write_json
from quire.sources.corpus import CorpusError, require_segment

# Refs that are no releases.
NOT_RELEASES = ("master",)
OLD_SERIES = "xml-p5-2018"


def order_key(tag: str) -> tuple[int, int]:
    year, mark, revision = tag.partition("R")
    number = lambda x: int(x) if x.isascii() and x.isdigit() else 0
    return (number(year), number(revision)) if mark else (0, 0)


def parse_remote(listing: str) -> dict[str, str]:
    """Tags and commits of a listing of remote refs; the commit a tag points to wins over the tag object."""
    found: dict[bool, dict[str, str]] = {False: {}, True: {}}
    for line in listing.splitlines():
        m = re.match(r"\s*(\S+)\s+refs/tags/(\S+?)((?:\^\{\})*)(?:\s|$)", line)
        if m and m[2] not in NOT_RELEASES and OLD_SERIES not in m[2]:
            found[bool(m[3])][m[2]] = m[1]
    return dict(sorted((found[False] | found[True]).items()))


def remote_tags(url: str) -> dict[str, str]:
    out = subprocess.run(["git", "ls-remote", "--tags", url], capture_output=True, text=True, timeout=60)
    if out.returncode:
        raise CorpusError(out.stderr.strip())
    return parse_remote(out.stdout)


def mirrored(url: str, mirror: str | None) -> str:
    """``url`` below a mirror's address, where one is given."""
    return f"{mirror.rstrip('/')}/{url.split('://', 1)[-1].split('/', 1)[-1]}" if mirror else url


def read_lock(path: str) -> dict[str, dict[str, str]]:
    """Pinned commits by tag: JSON, or the plain two-level YAML of such a file."""
    text = Path(path).read_text()
    try:
        return json.loads(text).get("releases", {})
    except ValueError:
        pass
    releases: dict[str, dict[str, str]] = {}
    tag = None
    for line in text.splitlines():
        body = line.split("#", 1)[0].rstrip()
        if not body.strip() or body.strip() == "releases:":
            continue
        key, _, value = body.strip().partition(":")
        key, value = key.strip("\"' "), value.strip("\"' ")
        if value and tag is not None and body.startswith("    "):
            releases[tag][key] = value
        elif not value and body.startswith("  "):
            tag = key
            releases[tag] = {}
    return releases


def newest(tags) -> str | None:
    return max(tags, key=order_key, default=None)


def resolve(tag: str, pinned: dict) -> str:
    found = newest(pinned) if tag == "latest" else tag
    if found not in pinned:
        raise CorpusError(f"no release {tag}")
    return found


def check_pins(fetched: dict[str, str], pinned: dict[str, str]) -> None:
    """What was fetched must be what the release pins."""
    wrong = sorted(k for k, sha in pinned.items() if fetched.get(k) != sha)
    if wrong:
        raise CorpusError(f"fetched commits differ from the pinned ones: {', '.join(wrong)}")


def utc_now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


class Store:
    """Corpora by tag below one folder."""

    def __init__(self, root: str):
        self.root = Path(root)

    def tags(self) -> list[str]:
        return sorted((p.name for p in self.root.iterdir() if p.is_dir() and not p.name.startswith(".")), key=lambda t: (order_key(t), t)) if self.root.is_dir() else []

    def current(self) -> str | None:
        return read_current(self.root)

    def complete(self, tag: str) -> bool:
        return (self.root / require_segment(tag) / "FETCHED.json").is_file() and (self.root / tag / "scopes").is_dir()

    def fetch(self, tag: str, source: str, pins: dict[str, str] | None = None) -> Path:
        """Copy a corpus in; again does nothing, and CURRENT never changes."""
        with single_writer(self.root):
            target = self.root / require_segment(tag)
            if self.complete(tag):
                return target
            aside = self.root / f".{tag}.tmp"
            shutil.rmtree(aside, ignore_errors=True)
            shutil.copytree(source, aside)
            write_json(aside / "FETCHED.json", {"tag": tag, "fetched_at": utc_now(), "pins": pins or {}})
            shutil.rmtree(target, ignore_errors=True)
            os.rename(aside, target)
            return target

    def use(self, tag: str, build=None, pinned: dict[str, str] | None = None) -> str:
        """Make a complete corpus current, building it first where a builder is given; a failed build changes nothing."""
        if not self.complete(tag):
            raise CorpusError(f"{tag} is not complete; fetch it first")
        if pinned:
            check_pins(json.loads((self.root / tag / "FETCHED.json").read_text()).get("pins", {}), pinned)
        if build is not None:
            build(self.root / tag)
        _replace(self.root / "CURRENT", tag + "\n")
        (self.root / "last.json").unlink(missing_ok=True)
        return tag

    def pull(self, known) -> dict:
        latest, current = newest(known), self.current()
        return {"current": current, "latest": latest, "behind": bool(latest and (current is None or order_key(current) < order_key(latest)))}

    def prunable(self) -> list[str]:
        return sorted(t for t in self.tags() if t != self.current())

    def prune(self, tags: list[str] | None = None, dry: bool = False) -> list[str]:
        with single_writer(self.root):
            gone = [t for t in self.prunable() if tags is None or t in tags]
            if tags and self.current() in tags:
                raise CorpusError("the current release stays")
            if not dry:
                for tag in gone:
                    shutil.rmtree(self.root / require_segment(tag))
            return gone
