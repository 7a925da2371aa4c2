"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import catalog as cat
from quire.operators import lookup, verify
from quire.operators.search import LIMIT, search
from quire.plans import dsl, match
from quire.plans.filters import Filters
from quire.sources import corpus, testbed
from quire.sources.testbed import CATALOG_SQL, LINES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
norm = tx.strip_punct_text
RADIUS = 2
LINE, WORK = "E7n000007_p0001a03", "E000007"


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _holds(term: str) -> str:
    return f"instr(text_norm, {_lit(term)}) > 0"


def _count(term: str) -> str:
    """Occurrences of a term that cannot overlap itself."""
    assert not any(term.startswith(term[i:]) for i in range(1, len(term))), term
    return f"((length(text_norm) - length(replace(text_norm, {_lit(term)}, ''))) // {len(term)})"


def search_sql(p: match.Plan, where: str, limit: int = LIMIT, before: str = "true", after: str = "true") -> str:
    """BM25 with the same leaves: one pass of statistics, then scores, then the best ``limit``."""
    grams = sorted(match.grams_needed(p))
    at = {g: f"g{i}" for i, g in enumerate(grams)}
    counts = ", ".join(f"count(*) FILTER ({_holds(g)}) AS {at[g]}" for g in grams)
    idf = lambda g: f"ln(1 + (n - {at[g]} + 0.5::DOUBLE) / ({at[g]} + 0.5::DOUBLE))"
    terms = []
    for counted, weighed in match.leaves(p):
        tf = _count(counted)
        weight = " + ".join(map(idf, weighed))
        terms.append(f"({weight}) * 2.2::DOUBLE * {tf} / ({tf} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))")
    return f"""WITH {LINES_SQL}, stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean, {counts} FROM lines),
    best AS (SELECT line_id, work_id, title, author, juan, text_raw, citation, round({" + ".join(terms)}, 6) AS score, tag, canon, {" + ".join(terms)} AS exact
        FROM lines, stats WHERE ({where}) AND ({before}) ORDER BY exact DESC, line_id LIMIT {limit})
    SELECT line_id, work_id, title, author, juan, text_raw, citation, score, tag FROM best WHERE {after}"""


def _search(name: str, query: str, where: str | None, filters: Filters = Filters(), before: str = "true", after: str = "true", mode: str | None = None, **how) -> None:
    parsed = dsl.with_mode(dsl.parse(query), mode)
    p = match.plan(parsed, norm, how.get("extended", False))

    @register(name, search_sql(p, where, before=before, after=after) if where else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search(testbed.lines(spark, sf_dir), parsed, norm, filters, **how)
        return found.withColumn("score", F.round("score", 6))


def _near(a: str, b: str, window: int) -> str:
    left = window - len(a) - len(b)
    return f"regexp_matches(text_norm, {_lit(f'(?s){a}.{{0,{left}}}{b}')})" if left >= 0 else "false"


_search("search_keyword", "and the", _holds("and the"))
_search("search_phrase", "of the, with", _holds("of the"), mode="phrase")
_search("search_single_char", "z", _holds("z"))
_search("search_wildcard_compat", "th?on", _holds("thon"))
_search("search_wildcard_extended", "wh?nd", r"regexp_matches(text_norm, '(?s)wh.nd')", extended=True)
_search("search_and", "thon&tion", f"{_holds('thon')} AND {_holds('tion')}")
_search("search_or", "Gewer,Licensed", f"{_holds('Gewer')} OR {_holds('Licensed')}")
_search("search_not", "Licensed-Apache", f"{_holds('Licensed')} AND NOT {_holds('Apache')}")
_search("search_and_not", "tion NOT the-and", f"{_holds('tion')} AND NOT {_holds('the')} AND NOT {_holds('and')}")
_search("search_near2", "moron NEAR/16 the", f"{_near('moron', 'the', 16)} OR {_near('the', 'moron', 16)}")
_search("search_near_default", "idiot+clown", f"{_near('idiot', 'clown', 30)} OR {_near('clown', 'idiot', 30)}")
_search("search_near_overlap", "ation NEAR/6 tions", f"{_near('ation', 'tions', 6)} OR {_near('tions', 'ation', 6)} OR {_holds('ations')}")
_search("search_before2", "scum BEFORE/40 the", _near("scum", "the", 40))
_search("search_before_default", "trash*and", _near("trash", "and", 30))
_orders = [("was", "for", "by"), ("was", "by", "for"), ("for", "was", "by"), ("for", "by", "was"), ("by", "was", "for"), ("by", "for", "was")]


def _chain(terms: tuple[str, ...], window: int) -> str:
    """From some start of the first term, the others in turn inside the window; RE2 has no look-ahead, so the starts are listed."""
    chain = "(?s)^" + ".*?".join(terms)
    return f"""len(list_filter(range(1, 1 + greatest(0, length(text_norm) - {len(terms[0]) - 1})),
        lambda i: substring(text_norm, i, {len(terms[0])}) = {_lit(terms[0])} AND regexp_matches(substring(text_norm, i, {window}), {_lit(chain)}))) > 0"""


_all3 = " AND ".join(_holds(t) for t in ("was", "for", "by"))
_search("search_near3", "was+for+by", f"{_all3} AND ({' OR '.join(_chain(o, 30) for o in _orders)})")
_search("search_before3", "the*and*of", " AND ".join(map(_holds, ("the", "and", "of"))) + f" AND {_chain(('the', 'and', 'of'), 30)}")
_search("search_near7", "was+for+by+the+and+of+in", None)
_search("search_near_not", "moron NEAR/30 and NOT idiot", f"({_near('moron', 'and', 30)} OR {_near('and', 'moron', 30)}) AND NOT {_holds('idiot')}")
_search("filter_work", "th", _holds("th"), Filters(works=(WORK, "E000009")), f"work_id IN ('{WORK}', 'E000009')")
_search("filter_author", "tion", _holds("tion"), Filters(authors=("src1",)), "instr(author, 'src1') > 0")
_search("filter_title", "tion", _holds("tion"), Filters(titles=("oc 12",)), "instr(title, 'oc 12') > 0")
_search("filter_juan", "tion", _holds("tion"), Filters(juans=(2, 3)), "juan IN (2, 3)")
_search("filter_canon", "tion", _holds("tion"), Filters(canons=("F",)), "canon = 'F'")
_search("filter_compat_post_topk", "tion", _holds("tion"), Filters(canons=("F",)), after="canon = 'F'", late_filter=True)


@register("lines_scan", f"WITH {LINES_SQL} SELECT line_id, work_id, juan, seq, text_raw FROM lines")
def lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.lines(spark, sf_dir).select("line_id", "work_id", "juan", "seq", "text_raw")


@register("normalize_strip_punct", f"WITH {LINES_SQL} SELECT line_id, text_norm, n_chars, dl FROM lines")
def normalize_strip_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.lines(spark, sf_dir).select("line_id", "text_norm", "n_chars", "dl")


@register("norm_hash_sha256", f"WITH {LINES_SQL} SELECT line_id, norm_hash FROM lines")
def norm_hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.lines(spark, sf_dir).select("line_id", "norm_hash")


def _gram_sql(sizes: tuple[int, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT line_id, {n} AS size, unnest([substring(text_norm, i::INT, {n}) FOR i IN range(1, 2 + n_chars - {n})]) AS gram FROM lines WHERE n_chars >= {n}" for n in sizes
    )


@register("ngrams_1_3", f"WITH {LINES_SQL}, g AS ({_gram_sql((1, 2, 3))}) SELECT line_id, size, count(*) AS grams, count(DISTINCT gram) AS kinds, min(gram) AS first, max(gram) AS last FROM g GROUP BY ALL")
def ngrams_1_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testbed.lines(spark, sf_dir)
    sized = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), tx.grams(F.col("text_norm"), n).alias("list")) for n in (1, 2, 3)]))
    each = lines.select("line_id", sized.alias("s")).where(F.size("s.list") > 0)
    grams = F.col("s.list")
    return each.select(
        "line_id", F.col("s.size").alias("size"), F.size(grams).cast("long").alias("grams"), F.size(F.array_distinct(grams)).cast("long").alias("kinds"),
        F.array_min(grams).alias("first"), F.array_max(grams).alias("last"),
    )


@register("ngram_df", f"WITH {LINES_SQL}, g AS ({_gram_sql((2,))}) SELECT gram, count(*) AS tf, count(DISTINCT line_id) AS df FROM g GROUP BY gram")
def ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: a line's grams in order, so that those unlike the one before are the distinct ones."""
    lines = testbed.lines(spark, sf_dir).select(F.sort_array(tx.grams(F.col("text_norm"), 2)).alias("g"))
    last = F.concat(F.array(F.lit(None).cast("string")), F.slice("g", 1, F.greatest(F.size("g") - 1, F.lit(0))))
    each = lines.where(F.size("g") > 0).select(F.explode(F.arrays_zip(F.col("g").alias("gram"), last.alias("last"))).alias("p")).select("p.*")
    return each.groupBy("gram").agg(F.count("*").alias("tf"), F.count_if(~F.col("gram").eqNullSafe(F.col("last"))).alias("df"))


@register("bm25_statistics", f"WITH {LINES_SQL} SELECT count(*) AS lines, round(avg(dl), 6) AS mean_length, count(*) FILTER ({_holds('t')}) AS with_t, count(*) FILTER ({_holds('th')}) AS with_th FROM lines")
def bm25_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testbed.lines(spark, sf_dir)
    t, th = (F.count_if(F.col("text_norm").contains(g)) for g in ("t", "th"))
    return lines.agg(F.count("*").alias("lines"), F.round(F.avg("dl"), 6).alias("mean_length"), t.alias("with_t"), th.alias("with_th"))


_HIT = "line_id, work_id, title, author, juan, text_raw, citation, 0.0::DOUBLE AS score, tag"


@register("get_line", f"WITH {LINES_SQL} SELECT {_HIT} FROM lines WHERE line_id = {_lit(LINE)}")
def get_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get_line(testbed.lines(spark, sf_dir), LINE)


@register(
    "get_context",
    f"""WITH {LINES_SQL}, c AS (SELECT work_id AS w, juan AS j FROM lines WHERE line_id = {_lit(LINE)}),
    r AS (SELECT l.*, row_number() OVER (ORDER BY line_id) AS rn FROM lines l, c WHERE work_id = w AND juan = j), m AS (SELECT rn AS mid FROM r WHERE line_id = {_lit(LINE)})
    SELECT CASE WHEN rn < mid THEN 'before' WHEN rn = mid THEN 'hit' ELSE 'after' END AS role, {_HIT} FROM r, m WHERE abs(rn - mid) <= 4""",
)
def get_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get_context(testbed.lines(spark, sf_dir), LINE, 4)


@register(
    "context_batch_window",
    f"""WITH {LINES_SQL} SELECT line_id, coalesce(string_agg(line_id, ',') OVER b, '') AS before, coalesce(string_agg(line_id, ',') OVER a, '') AS after FROM lines
    WINDOW b AS (PARTITION BY work_id, juan ORDER BY line_id ROWS BETWEEN {RADIUS} PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY work_id, juan ORDER BY line_id ROWS BETWEEN 1 FOLLOWING AND {RADIUS} FOLLOWING)""",
)
def context_batch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.contexts(testbed.lines(spark, sf_dir), RADIUS)
    return found.select("line_id", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@register("read_juan", f"WITH {LINES_SQL} SELECT {_HIT} FROM lines WHERE work_id = {_lit(WORK)} AND juan = 1")
def read_juan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.read_juan(testbed.lines(spark, sf_dir), WORK, 1)


@register("cite", f"WITH {LINES_SQL} SELECT line_id, citation FROM lines")
def cite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.lines(spark, sf_dir).select("line_id", "citation")


@register("highlight", f"WITH {LINES_SQL} SELECT line_id, substring(text_raw, 1, instr(text_raw, 'tion') - 1) || '[tion]' || substring(text_raw, instr(text_raw, 'tion') + 4) AS shown FROM lines WHERE instr(text_raw, 'tion') > 0")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testbed.lines(spark, sf_dir).where(F.col("text_raw").contains("tion"))
    return lines.select("line_id", tx.highlighted(F.col("text_raw"), ["absent term", "tion"]).alias("shown"))


@register("copy_block", f"WITH {LINES_SQL} SELECT line_id, line_id || ' ' || title || '卷' || juan || '：' || text_raw || chr(10) || citation AS block FROM lines")
def copy_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return testbed.lines(spark, sf_dir).select("line_id", tx.copy_block(c("line_id"), c("title"), c("juan"), c("text_raw"), c("citation")).alias("block"))


@register("catalog_filter", f"WITH {CATALOG_SQL} SELECT work_id, title, author, dynasty, category, work_type, '2026R2' AS tag, 'bed' AS scope_hash FROM catalog WHERE work_type IN ('fr', 'de') AND instr(author, 'src1') > 0")
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.entries(testbed.catalog(spark, sf_dir), "2026R2", "bed", Filters(types=("fr", "de"), authors=("src1",)))


@register(
    "catalog_join_lines",
    f"WITH {LINES_SQL}, {CATALOG_SQL} SELECT l.line_id, c.title, c.author, c.category, c.work_type FROM lines l JOIN catalog c ON c.path = l.path",
)
def catalog_join_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = testbed.catalog(spark, sf_dir).select("path", "title", "author", "category", "work_type")
    return testbed.lines(spark, sf_dir).select("line_id", "path").join(rows, "path").drop("path")


@register("line_counts_by_work", f"WITH {LINES_SQL} SELECT work_id, path, count(*) AS line_count FROM lines GROUP BY work_id, path")
def line_counts_by_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.line_counts(testbed.lines(spark, sf_dir))


def _quote(text: str) -> str:
    return f"translate({text}, {_lit(tx.PUNCT)}, '')"


@register("verify_exact", f"WITH {LINES_SQL}, q AS (SELECT text_norm AS t FROM lines WHERE line_id = {_lit(LINE)}) SELECT line_id, work_id, title, author, juan, text_raw, citation, 1.0::DOUBLE AS score, tag FROM lines, q WHERE text_norm = t ORDER BY line_id LIMIT 1")
def verify_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = testbed.lines(spark, sf_dir)
    quote = lines.where(F.col("line_id") == LINE).select("text_raw").first()
    return verify.exact(lines, norm(quote[0] if quote else ""))


@register(
    "verify_batch_exact",
    f"""WITH {LINES_SQL}, q AS (SELECT item_id AS quote_id, i, {_quote("trim(string_split(text, chr(10))[i], ' ')")} AS t FROM benchmark, range(1, 1 + len(string_split(text, chr(10)))) x(i)),
    f AS (SELECT text_norm, min(line_id) AS line_id FROM lines GROUP BY text_norm)
    SELECT quote_id || ':' || i AS quote_id, f.line_id IS NOT NULL AND t <> '' AS is_original, CASE WHEN t <> '' THEN f.line_id END AS line_id FROM q LEFT JOIN f ON f.text_norm = q.t""",
)
def verify_batch_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    named = F.concat(F.col("item_id").cast("string"), F.lit(":"), (F.col("i") + 1).cast("string"))
    return verify.verify_batch(testbed.lines(spark, sf_dir), quotes.select(named.alias("quote_id"), tx.strip_punct(F.trim("line")).alias("quote_norm")))


QUOTE = "The nd of thonest was anded to the reonly"


def _similar_sql() -> str:
    grams = tx.grams_of(QUOTE, 2)
    named = sorted(set(grams))
    counts = ", ".join(f"count(*) FILTER ({_holds(g)}) AS g{i}" for i, g in enumerate(named))
    weight = " + ".join(f"CASE WHEN {_holds(g)} THEN {float(grams.count(g))}::DOUBLE * ln(1 + (n - g{i} + 0.5::DOUBLE) / (g{i} + 0.5::DOUBLE)) ELSE 0 END" for i, g in enumerate(named))
    # The engine's edit distance counts bytes; a character that the quote cannot have is one byte, whichever it is.
    return f"""WITH {LINES_SQL}, stats AS (SELECT count(*)::DOUBLE AS n, {counts} FROM lines),
    w AS (SELECT lines.*, {weight} AS weight FROM lines, stats), near AS (SELECT * FROM w WHERE weight > 0 ORDER BY weight DESC, line_id LIMIT {verify.RECALL}),
    s AS (SELECT *, 1 - levenshtein(regexp_replace(text_norm, '[^ -~]', chr(1), 'g'), {_lit(QUOTE)})::DOUBLE / greatest(length(text_norm), {len(QUOTE)}) AS exact FROM near)
    SELECT line_id, work_id, title, author, juan, text_raw, citation, round(exact, 9) AS score, tag FROM s WHERE exact > 0 ORDER BY exact DESC, line_id LIMIT {verify.SIMILAR}"""


@register("verify_similar", _similar_sql())
def verify_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.similar(testbed.lines(spark, sf_dir), norm(QUOTE)).withColumn("score", F.round("score", 9))


def _works(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files as they are, and a last build in which every seventh had other content and every eleventh was not there."""
    files = testbed.catalog(spark, sf_dir).select("path", "work_id", F.sha2("path", 256).alias("xml_sha256"))
    number = F.substring("work_id", 2, 99).cast("long")
    last = files.where(number % 11 != 0).withColumn("xml_sha256", F.when(number % 7 == 0, F.lit("old")).otherwise(F.col("xml_sha256")))
    return files, last


_FILES = f"{CATALOG_SQL}, files AS (SELECT path, work_id, sha256(path) AS xml_sha256, substring(work_id, 2)::BIGINT AS k FROM catalog)"


@register("incremental_reuse", f"WITH {_FILES} SELECT path, work_id, xml_sha256 FROM files WHERE k % 11 <> 0 AND k % 7 <> 0")
def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.unchanged(*_works(spark, sf_dir))


@register("incremental_reparse", f"WITH {_FILES} SELECT path, work_id, xml_sha256 FROM files WHERE k % 11 = 0 OR k % 7 = 0")
def incremental_reparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.changed(*_works(spark, sf_dir))


@register("build_selection", f"WITH {_FILES} SELECT c.path, c.work_id, c.canon, c.title FROM catalog c WHERE substring(c.work_id, 2)::BIGINT % 13 <> 0 AND c.canon <> 'E'")
def build_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a build: those listed that the catalog knows, without skipped canons and paths that leave the corpus."""
    rows = testbed.catalog(spark, sf_dir)
    listed = rows.where(F.substring("work_id", 2, 99).cast("long") % 13 != 0).select("path")
    listed = listed.unionByName(spark.createDataFrame([("Z/none.xml",), ("../out.xml",), ("/abs.xml",)], "path string"))
    return cat.selected(listed.where(corpus.below(F.col("path"))), rows, (*tx.SKIPPED_CANONS, "E")).select("path", "work_id", "canon", "title")


@register("work_count", f"WITH {CATALOG_SQL} SELECT count(DISTINCT path) AS works FROM catalog")
def work_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(cat.work_count(testbed.catalog(spark, sf_dir)),)], "works long")


@register("canon_prefix", f"WITH {CATALOG_SQL} SELECT work_id, canon AS prefix FROM catalog")
def canon_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testbed.catalog(spark, sf_dir).select("work_id", tx.canon_of(F.col("work_id")).alias("prefix"))


@register("search_key", f"WITH {LINES_SQL} SELECT line_id, text_norm AS search_key FROM lines")
def search_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole key, folding included, which leaves these texts as they are."""
    return testbed.lines(spark, sf_dir).select("line_id", tx.search_key(F.col("text_raw"), tx.script_map(spark, "Hans-Hant")).alias("search_key"))


@register("read_work", f"WITH {LINES_SQL} SELECT line_id, work_id, juan, text_raw, citation FROM lines WHERE work_id = '{WORK}'")
def read_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.read_work(testbed.lines(spark, sf_dir), WORK).select("line_id", "work_id", "juan", "text_raw", "citation")


@register("newest_release", "SELECT '2026R10' AS tag")
def newest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    return spark.createDataFrame([(cat.newest_tag(tags),)], "tag string")


TAGS = ("2024R3", "2025R1", "2026R2", "2026R10", "2026R1", "draft", "2023R4")
_TAGS = "tags(tag) AS (VALUES " + ", ".join(f"('{t}')" for t in TAGS) + ")"
_PARTS = "coalesce(try_cast(nullif(regexp_extract(tag, '^([0-9]{1,9})R', 1), '') AS BIGINT), 0)", "coalesce(try_cast(nullif(regexp_extract(tag, '^[^R]*R([0-9]{1,9})$', 1), '') AS BIGINT), 0)"


@register("tag_order_latest", f"WITH {_TAGS} SELECT tag, row_number() OVER (ORDER BY {_PARTS[0]}, {_PARTS[1]}, tag) AS place FROM tags")
def tag_order_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    tags = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    return tags.withColumn("place", F.row_number().over(Window.orderBy(tx.release_order(F.col("tag")), "tag")).cast("long"))


@register("tags_intersect", f"WITH {_TAGS} SELECT tag FROM tags WHERE tag IN ('2026R2', '2025R1')")
def tags_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = spark.createDataFrame([(t,) for t in TAGS], "tag string")
    return cat.common_tags(tags, spark.createDataFrame([("2026R2",), ("2025R1",), ("1999R9",)], "tag string"))


@register("tags_prunable", f"WITH {_TAGS} SELECT tag FROM tags WHERE tag <> '2026R2'")
def tags_prunable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.prunable(spark.createDataFrame([(t,) for t in TAGS], "tag string"), "2026R2")


@register("display_script")
def display_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both script maps over a few words; the mapping is ICU's, so there is no SQL for it."""
    words = spark.createDataFrame([("般若波罗蜜多心经",), ("缘起性空",), ("莲华",)], "text string")
    there = tx.convert_script(F.col("text"), tx.script_map(spark, "Hans-Hant")).alias("traditional")
    return words.select("text", there).select("*", tx.convert_script(F.col("traditional"), tx.script_map(spark, "Hant-Hans")).alias("simplified"))


@register("tei_parse")
def tei_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as TEI files and back to lines; tested against the lines themselves."""
    from quire.sources.tei import read_lines

    lines = testbed.lines(spark, sf_dir)
    escaped = F.replace(F.replace(F.replace(F.col("text_raw"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("]]>"), F.lit("]]&gt;"))
    lb = F.substring_index("line_id", "_p", -1)
    one = F.concat(F.lit('<lb n="'), lb, F.lit('"/><juan n="'), F.col("juan"), F.lit('"/>'), escaped)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", one.alias("x")))), lambda s: s["x"]), "\n")
    text = F.concat(F.lit('<TEI xml:id="'), F.regexp_replace("path", r"\.xml$", ""), F.lit('"><teiHeader><lb n="x"/></teiHeader><text><body>'), F.col("body"), F.lit("</body></text></TEI>"))
    files = lines.groupBy("path").agg(body.alias("body")).select("path", F.encode(text, "UTF-8").alias("content"))
    return read_lines(files)
