"""Scalar functions over lines, as column expressions; Unicode folding is the only Python."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The characters that a search key leaves out.
PUNCT = "，。、；：！？「」『』,.;:!?\"'（）()"
#: Canons that are left out of every build.
SKIPPED_CANONS = ("Y", "TX", "LC", "YP")


def strip_punct(text: Column) -> Column:
    return F.translate(text, PUNCT, "")


def strip_punct_text(text: str) -> str:
    return text.translate({ord(c): None for c in PUNCT})


def nfkc(text: Column) -> Column:
    """Only texts that are not plain ASCII, which folding leaves as they are, go to Python."""

    @F.pandas_udf("string")
    def fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.coalesce(fold(F.when(~text.rlike(r"^\p{ASCII}*$"), text)), text)


_scripts: dict[str, dict[str, str]] = {}


def script_map(spark: SparkSession, name: str) -> dict[str, str]:
    """One-to-one characters of an ICU transform ('Hans-Hant' or 'Hant-Hans') over the common Han block.

    Character-wise, so words whose writing depends on their neighbours keep the
    plain mapping; queries and lines go through the same map.
    """
    if name not in _scripts:
        change = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance(name)
        source = "".join(map(chr, range(0x4E00, 0xA000)))
        # A space between characters keeps the transform from reading them as words.
        changed = change.transliterate(" ".join(source)).split(" ")
        _scripts[name] = {a: b for a, b in zip(source, changed, strict=True) if a != b and len(b) == 1}
    return _scripts[name]


def convert_script(text: Column, mapping: Mapping[str, str]) -> Column:
    if not mapping:
        return text
    return F.translate(text, "".join(mapping), "".join(mapping.values()))


def replace_gaiji(text: Column, gaiji: Mapping[str, str]) -> Column:
    """Each code replaced by its character, longer codes first."""
    for code in sorted(gaiji, key=lambda k: (-len(k), k)):
        text = F.replace(text, F.lit(code), F.lit(gaiji[code]))
    return text


def resolve_gaiji(gaiji: Mapping[str, str], code: str) -> str:
    return gaiji.get(code, "□")


def search_key(text: Column, to_traditional: Mapping[str, str] = {}, gaiji: Mapping[str, str] = {}, fold: bool = True) -> Column:
    """What lines are searched by: NFKC, one script, gaiji, no punctuation."""
    text = nfkc(text) if fold else text
    return strip_punct(replace_gaiji(convert_script(text, to_traditional), gaiji))


def search_key_text(text: str, to_traditional: Mapping[str, str] = {}, gaiji: Mapping[str, str] = {}) -> str:
    """The same for a query, on the driver."""
    text = unicodedata.normalize("NFKC", text)
    text = "".join(to_traditional.get(c, c) for c in text)
    for code in sorted(gaiji, key=lambda k: (-len(k), k)):
        text = text.replace(code, gaiji[code])
    return strip_punct_text(text)


def norm_hash(text_norm: Column) -> Column:
    return F.sha2(text_norm, 256)


def token_count(text_norm: Column) -> Column:
    """Tokens of the 1- to 3-gram index of a line: none, one, or three a character less three."""
    n = F.length(text_norm)
    return F.when(n == 0, 0).when(n == 1, 1).otherwise(3 * n - 3)


def grams(text: Column, n: int) -> Column:
    """The n-grams in order, with repeats; none for a shorter text."""
    size = F.length(text)
    chars = F.split(text, "(?!^)(?!$)")
    out = chars
    for k in range(1, n):  # shifted lists side by side: linear, where cutting out each gram would scan the text again
        out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.greatest(size, F.lit(1))), lambda a, b: F.concat(a, b))
    return F.when(size >= n, F.slice(out, F.lit(1), F.greatest(size - (n - 1), F.lit(0)))).otherwise(F.array().cast("array<string>"))


def grams_of(text: str, n: int) -> list[str]:
    """The same of a quote, but a shorter text is its own gram."""
    if not text:
        return []
    return [text[i : i + n] for i in range(len(text) - n + 1)] or [text]


def canon_of(work_id: Column) -> Column:
    return F.regexp_extract(work_id, "^[A-Za-z]*", 0)


def work_of(xml_id: Column) -> Column:
    """Without the volume: letters before the first digit, then what follows the first n."""
    return F.regexp_replace(xml_id, "^([^0-9n]*)[^n]*n", "$1")


def work_of_text(xml_id: str) -> str:
    head, mark, number = xml_id.partition("n")
    if not mark:
        return xml_id
    end = next((i for i, c in enumerate(head) if c in "0123456789"), len(head))
    return head[:end] + number


def display_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^([^R]+)R", "$1.R")


def citation(line_id: Column, tag: Column, label: str) -> Column:
    """(label tag, volume, no. work, p. page, column and line), or the plain id where it has no such parts."""
    parts = "^([^n]*?)n(.*?)_p([^A-Za-z]*)([A-Za-z].*)$"
    page = F.regexp_extract(line_id, parts, 3)
    page = F.when(page.rlike("^[0-9]{1,9}$"), F.regexp_replace(page, "^0+(?=[0-9])", "")).otherwise(F.regexp_replace(page, "^0+", ""))
    part = lambda i: F.regexp_extract(line_id, parts, i)
    full = F.concat(F.lit(f"({label} "), display_tag(tag), F.lit(", "), part(1), F.lit(", no. "), part(2), F.lit(", p. "), page, F.lit(", "), part(4), F.lit(")"))
    plain = F.concat(F.lit(f"({label} "), display_tag(tag), F.lit(", "), line_id, F.lit(")"))
    # The volume ends at the first n, and the line part begins after the first _p.
    return F.when(line_id.rlike("^[^n_]*n[^_]*_p[^A-Za-z]*[A-Za-z]") | line_id.rlike(parts), full).otherwise(plain)


def release_order(tag: Column) -> Column:
    """(year, revision) of a tag; what is no number counts as 0."""
    has = F.instr(tag, "R") > 0
    year = F.coalesce(F.regexp_extract(tag, "^([0-9]{1,9})R", 1).try_cast("bigint"), F.lit(0))
    revision = F.coalesce(F.regexp_extract(tag, "^[^R]*R([0-9]{1,9})$", 1).try_cast("bigint"), F.lit(0))
    return F.struct(F.when(has, year).otherwise(0).alias("year"), F.when(has, revision).otherwise(0).alias("revision"))


def covering_span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(a1, b1) - F.least(a0, b0)


def quoted(term: str) -> str:
    """A term as a literal of Java's and RE2's regular expressions."""
    return "".join("\\" + c if c in "\\.^$|?*+()[]{}-" else c for c in term)


def occurrences(text: Column, term: str) -> Column:
    """How often a term occurs, overlapping ones included."""
    return F.regexp_count(text, F.lit(f"(?=(?s:{quoted(term)}))"))


def starts(text: Column, term: str) -> Column:
    """0-based places of a term, overlapping ones included."""
    size = len(term)
    last = F.length(text) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.substring(text, i + 1, F.lit(size)) == F.lit(term))


def similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length, on characters; two empty texts are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def utc_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def highlighted(text: Column, terms: list[str], before: str = "[", after: str = "]") -> Column:
    """The first occurrence of the first term that occurs."""
    out = text
    for term in reversed([t for t in terms if t]):
        at = F.locate(term, text)
        marked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(before + term + after), F.substring(text, at + len(term), F.length(text)))
        out = F.when(at > 0, marked).otherwise(out)
    return out


def copy_block(line_id: Column, title: Column, juan: Column, text: Column, cited: Column) -> Column:
    return F.concat(line_id, F.lit(" "), title, F.lit("卷"), juan.cast("string"), F.lit("："), text, F.lit("\n"), cited)
