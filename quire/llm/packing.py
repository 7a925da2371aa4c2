"""Packing token sequences: first-fit decreasing over randomised groups.

A document's ids (with a closing id 1) are cut into pieces of the full length and
one remainder.  Pieces are dealt to groups by a hash that includes the row's place
in its task, so copies of one document spread as well.  Inside a group, pieces go
in order of falling length to the first sequence with room, found by descending a
tournament tree of the sequences' free room.  A group has a bounded number of
pieces whatever the size of the table, and groups are independent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut, table

LENGTH = 2048
GROUP = 8192
END = 1
#: Texts that are Python strings at once.
SLICE = 512
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
_loaded: dict[str, tuple] = {}


def tokenizer(name: str):
    """A function from text to ids, as the tokenizer file gives them without added special tokens.

    The rank file of the same vocabulary is about four times as fast and gives the
    same ids; texts that hold a special token's string go to the tokenizer file itself.
    """
    if name not in _loaded:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        path = public_tokenizers.path(name)
        with open(path) as file:
            special = [t["content"] for t in json.load(file)["added_tokens"]]
        with open(path.replace(".json", ".tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        del ranks
        whole: list = []  # loaded when a text needs it

        def ids(text: str) -> list[int]:
            if any(s in text for s in special):
                if not whole:
                    from tokenizers import Tokenizer

                    whole.append(Tokenizer.from_file(path))
                return whole[0].encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _loaded[name] = ids
    return _loaded[name]


def pieces(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """(doc_id, text) to pieces; a null text is empty, so a document has at least its closing id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokenizer(vocabulary)
        salt = 0
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.array([*ids(text or ""), END], "<u4")
                for start in range(0, len(found), length):
                    piece = found[start : start + length]
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(found), salt))
                    salt += 1
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def first_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, taken in the given order, by a tournament tree of free room."""
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    tree = [room] * (2 * leaves)
    where, offset = [0] * len(sizes), [0] * len(sizes)
    for i, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        where[i], offset[i] = at - leaves, room - tree[at]
        tree[at] -= size
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return np.array(where, np.int64), np.array(offset, np.int64)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pieces of all ``docs`` with ``sequence_id`` and ``offset``.

    Null texts are empty; repeated rows are packed as often as they come; an empty
    table has no pieces.  The pieces are cut to the shared folder first, so their
    groups do not change when an executor is lost.
    """
    made = cut(pieces(docs, vocabulary, length))
    groups = max(1, -(-made.count() // group))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "salt"], ascending=[False, True, True, True], kind="stable")
        where, offset = first_fit(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=(int(key[0]) << 32) + where, offset=offset).drop(columns=["salt", "part"])

    dealt = made.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(groups)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("part").applyInPandas(fill, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
