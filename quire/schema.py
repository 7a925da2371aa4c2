"""Fixed schemas of the engine's tables; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_s, _l = T.StringType(), T.LongType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PARSED = _of(path=_s, seq=_l, line_id=_s, work_id=_s, juan=_l, text_raw=_s, lb_n=_s, error=_s)
LINES = _of(
    line_id=_s, work_id=_s, canon=_s, title=_s, author=_s, tag=_s, juan=_l, text_raw=_s, text_norm=_s, norm_hash=_s, citation=_s, path=_s, seq=_l,
    n_chars=T.IntegerType(), dl=T.IntegerType(),
)
CATALOG = _of(work_id=_s, canon=_s, path=_s, title=_s, author=_s, dynasty=_s, category=_s, work_type=_s)
WORKS = _of(work_id=_s, path=_s, xml_sha256=_s, line_count=_l)
GRAMS = _of(gram=_s, df=_l)
HIT = ("line_id", "work_id", "title", "author", "juan", "text_raw", "citation", "score", "tag")


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the order of ``schema``; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df.select([f.name for f in schema])
