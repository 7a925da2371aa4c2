"""Quotation linking of conversations, in DataFrame operations only.

Lines that begin with ``>`` are quoted, as deep as they have leading marks; lines of
one depth in a row are a passage.  A passage is normalised (marks off, A to Z and
white space folded) and hashed, and so are the whole own text, the paragraphs and the
lines of every message.  A passage of several lines is also looked for among the lines
of its conversation that follow each other, from each line equal to its first; blank
lines do not count there.  A passage's original is the latest earlier message of the
conversation with an equal hash, found by one running window over (conversation,
hash); a passage from elsewhere gets the first message of all that has it whole, or the
last if the first is its own, from one row per hash, so that a very common passage
makes no pairs.  A message replies to the
original of its shallowest linked passage, or else to the message before.  Depths
come from pointer doubling, and a conversation's reply order is by depth, then place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, free, table

MARK = "^(?:[ \\t]*>)+"
QUOTED = "^[ \\t]*>"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\r\\n]+", " "))


def own_text(text: Column) -> Column:
    """The lines that are not quoted."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(QUOTED)), "\n")


def numbered(messages: DataFrame) -> DataFrame:
    """``messages`` with ``pos``, their place in the conversation: by turn (null last), then role and text."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    return messages.select("conv_id", "turn", "role", "text").withColumn("pos", F.row_number().over(order))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, pos, run, depth, hash) of quoted passages that are not blank, with the number of lines and the hash of the first, blank ones left out."""
    line = messages.where(F.col("text").rlike("(?m)" + QUOTED)).select("conv_id", "pos", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    mark = F.regexp_extract("line", MARK, 0)
    line = line.withColumn("depth", F.length(F.regexp_replace(mark, "[ \\t]", ""))).withColumn("body", F.expr("substring(line, length(regexp_extract(line, '" + MARK.replace("\\", "\\\\") + "', 0)) + 1)"))
    place = Window.partitionBy("conv_id", "pos").orderBy("line_no")
    begins = (F.col("depth") != F.lag("depth", 1, 0).over(place)).cast("int")
    line = line.withColumn("begins", begins).withColumn("run", F.sum("begins").over(place)).where("depth > 0")
    bodies = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "body"))), lambda s: s["body"])
    found = line.groupBy("conv_id", "pos", "run", "depth").agg(bodies.alias("bodies"))
    found = found.select("conv_id", "pos", "run", "depth", normalised(F.array_join("bodies", "\n")).alias("passage"), said("bodies").alias("lines"))
    return found.where("passage <> ''").select("conv_id", "pos", "run", "depth", F.md5("passage").alias("hash"), F.size("lines").alias("n"), F.md5(F.col("lines")[0]).alias("opening"))


def said(lines) -> Column:
    """The lines of an array that are not blank, normalised."""
    return F.filter(F.transform(lines, normalised), lambda x: x != "")


def stretches(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, pos, hash) of lines in a row that begin like a passage of the conversation and are as many as it has."""
    wanted = quoted.where("n > 1").select(F.col("conv_id").alias("c"), "n", "opening").distinct()
    own = messages.select("conv_id", "pos", said(F.split(own_text(F.col("text")), "\n")).alias("lines")).where("size(lines) > 1")
    line = own.select("conv_id", "pos", F.posexplode(F.transform("lines", F.md5)).alias("at", "line"))
    starts = line.join(wanted, line["conv_id"].eqNullSafe(wanted["c"]) & (line["line"] == wanted["opening"]))
    starts = starts.groupBy("conv_id", "pos").agg(F.collect_list(F.struct("at", "n")).alias("starts")).withColumnsRenamed({"conv_id": "c", "pos": "p"})
    found = own.join(starts, own["conv_id"].eqNullSafe(starts["c"]) & (own["pos"] == starts["p"]))
    inside = F.filter("starts", lambda s: s["at"] + s["n"] <= F.size("lines"))
    hashes = F.transform(inside, lambda s: F.md5(F.array_join(F.slice("lines", s["at"] + 1, s["n"]), " ")))
    return found.select("conv_id", "pos", F.explode(F.array_distinct(hashes)).alias("hash"))


def units(messages: DataFrame) -> DataFrame:
    """(conv_id, pos, hash) of what a quotation of a message may repeat."""
    own = messages.select("conv_id", "pos", own_text(F.col("text")).alias("own")).where("own <> ''")
    parts = F.concat(F.array("own"), F.split("own", "\n[ \\t]*\n"), F.split("own", "\n"))
    each = own.select("conv_id", "pos", F.explode(F.array_distinct(F.transform(parts, normalised))).alias("unit"))
    return each.where("unit <> ''").select("conv_id", "pos", F.md5("unit").alias("hash"))


def linked(messages: DataFrame) -> DataFrame:
    """Passages with ``original`` (place in the same conversation) and ``elsewhere`` (conv_id and pos of the first of all)."""
    quoted = cut(passages(messages))
    known = units(messages).join(quoted.select("hash").distinct(), "hash", "left_semi")
    known = cut(known)
    parts = stretches(messages, quoted).join(quoted.select("hash").distinct(), "hash", "left_semi")
    none = F.lit(None).cast("int")
    both = quoted.drop("n", "opening").withColumn("of", none).unionByName(
        known.unionByName(parts).select("conv_id", "pos", none.alias("run"), none.cast("int").alias("depth"), "hash", F.col("pos").alias("of")), allowMissingColumns=True
    )
    # A message's own passages come before what it says itself, so it is not its own original.
    order = Window.partitionBy("conv_id", "hash").orderBy("pos", F.col("of").isNotNull())
    told = both.withColumn("original", F.max("of").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("of is null")
    place = F.struct("conv_id", "pos")
    ends = known.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    out = told.drop("of").join(ends, "hash", "left")
    own = F.col("first.conv_id").eqNullSafe(F.col("conv_id")) & (F.col("first.pos") >= F.col("pos"))
    other = F.when(~own, F.col("first")).when(~F.col("last.conv_id").eqNullSafe(F.col("conv_id")), F.col("last"))
    return out.withColumn("elsewhere", F.when(F.col("original").isNull(), other)).drop("first", "last")


def depths(parents: DataFrame) -> DataFrame:
    """(conv_id, pos, parent) with ``depth``, the number of replies up to the first message.

    A run of messages that each reply to the one before is one step; pointers are
    doubled between the starts of runs only, and only for those not at the top yet.
    """
    starts = F.col("parent").isNull() | (F.col("parent") != F.col("pos") - 1)
    running = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut(parents.withColumn("start", F.max(F.when(starts, F.col("pos"))).over(running)))
    above = placed.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), F.col("start").alias("up"))
    heads = placed.where("pos = start").select("conv_id", "pos", "parent")
    joined = heads.join(above, heads["conv_id"].eqNullSafe(above["c"]) & (heads["parent"] == above["p"]), "left")
    state = cut(joined.select("conv_id", "pos", "up", F.when(F.col("up").isNull(), 0).otherwise(F.col("parent") - F.col("up") + 1).alias("depth")))
    while state.where("up is not null").limit(1).count():
        on = state.where("up is not null")
        next_ = state.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = on.join(next_, on["conv_id"].eqNullSafe(next_["c"]) & (on["up"] == next_["p"]))
        moved = joined.select("conv_id", "pos", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        after = cut(state.where("up is null").unionByName(moved))
        free(state)
        state = after
    tops = state.select(F.col("conv_id").alias("c"), F.col("pos").alias("p"), "depth")
    out = placed.join(tops, placed["conv_id"].eqNullSafe(tops["c"]) & (placed["start"] == tops["p"]))
    return out.select("conv_id", "pos", (F.col("depth") + F.col("pos") - F.col("start")).alias("depth"))


def link(messages: DataFrame) -> DataFrame:
    """One row per row of ``messages`` (conv_id, turn, role, text), in reply order and without quotes.

    ``text`` is null for a null text; ``parent`` and ``pos`` are places in the
    conversation from 1, a parent of 0 is none; ``reply_order`` counts from 1.  Null conv_ids are one
    conversation; rows that tie in all columns are told apart by place only.
    """
    spoken = cut(numbered(messages))
    quotes = cut(linked(spoken))
    rank = F.struct(F.col("depth"), F.col("run"))
    per = quotes.groupBy("conv_id", "pos").agg(
        F.count("*").alias("n_quotes"),
        F.sum((F.col("original").isNotNull() | F.col("elsewhere").isNotNull()).cast("long")).alias("n_linked"),
        F.min_by("original", F.when(F.col("original").isNotNull(), rank)).alias("original"),
    )
    per = per.withColumnsRenamed({"conv_id": "c", "pos": "p"})
    joined = spoken.join(per, spoken["conv_id"].eqNullSafe(per["c"]) & (spoken["pos"] == per["p"]), "left")
    before = F.when(F.col("pos") > 1, F.col("pos") - 1)
    told = cut(
        joined.select(
            "conv_id", "turn", "role", own_text(F.col("text")).alias("text"), "pos",
            F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("original", before).alias("parent"),
        )
    )
    deep = depths(told.select("conv_id", "pos", "parent")).withColumnsRenamed({"conv_id": "c", "pos": "p"})
    out = told.join(deep, told["conv_id"].eqNullSafe(deep["c"]) & (told["pos"] == deep["p"])).drop("c", "p")
    order = Window.partitionBy("conv_id").orderBy("depth", "pos")
    return out.withColumn("reply_order", F.row_number().over(order)).withColumn("parent", F.coalesce("parent", F.lit(0)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[ \\t\\r\\n]+', ' ', 'g'), ' ')"


SQL = f"""WITH RECURSIVE spoken AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST)::INT AS pos FROM conversations),
split AS (SELECT conv_id, pos, i, string_split(text, chr(10))[i] AS line FROM spoken, range(1, 1 + len(string_split(text, chr(10)))) t(i)),
marked AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \\t]*>)+'), '[ \\t]', '', 'g')) AS depth,
    substring(line, length(regexp_extract(line, '^(?:[ \\t]*>)+')) + 1) AS body FROM split),
begun AS (SELECT *, (depth <> lag(depth, 1, 0) OVER (PARTITION BY conv_id, pos ORDER BY i))::INT AS begins FROM marked),
run AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id, pos ORDER BY i) AS run FROM begun),
quoted AS (SELECT conv_id, pos, run, depth, {_norm("string_agg(body, chr(10) ORDER BY i)")} AS unit,
    list({_norm("body")} ORDER BY i) FILTER ({_norm("body")} <> '') AS lines FROM run WHERE depth > 0 GROUP BY conv_id, pos, run, depth),
quotes AS (SELECT conv_id, pos, run, depth, md5(unit) AS hash, len(lines) AS n, lines[1] AS opening FROM quoted WHERE unit <> ''),
own AS (SELECT conv_id, pos, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (depth = 0), '') AS own FROM marked GROUP BY conv_id, pos),
pieces AS (SELECT conv_id, pos, {_norm("unnest(list_concat([own], regexp_split_to_array(own, chr(10) || '[ \\t]*' || chr(10)), string_split(own, chr(10))))")} AS unit FROM own),
units AS (SELECT DISTINCT conv_id, pos, md5(unit) AS hash FROM pieces WHERE unit <> ''),
firsts AS (SELECT hash, min(struct_pack(c := conv_id, p := pos)) AS f, max(struct_pack(c := conv_id, p := pos)) AS l FROM units GROUP BY hash),
spoken_lines AS (SELECT conv_id, pos, list({_norm("line")} ORDER BY i) FILTER (depth = 0 AND {_norm("line")} <> '') AS lines FROM marked GROUP BY conv_id, pos),
begins_at AS (SELECT conv_id, pos, lines, s FROM spoken_lines, range(1, len(lines)) t(s)),
stretches AS (SELECT DISTINCT b.conv_id, b.pos, md5(array_to_string(b.lines[b.s:b.s + q.n - 1], ' ')) AS hash FROM begins_at b
    JOIN (SELECT DISTINCT conv_id, n, opening FROM quotes WHERE n > 1) q ON q.conv_id IS NOT DISTINCT FROM b.conv_id AND q.opening = b.lines[b.s] AND b.s + q.n - 1 <= len(b.lines)),
here AS (SELECT conv_id, pos, hash FROM units UNION SELECT conv_id, pos, hash FROM stretches),
linked AS (SELECT q.*, (SELECT max(u.pos) FROM here u WHERE u.conv_id IS NOT DISTINCT FROM q.conv_id AND u.hash = q.hash AND u.pos < q.pos) AS original, f.f, f.l
    FROM quotes q LEFT JOIN firsts f ON f.hash = q.hash),
per AS (SELECT conv_id, pos, count(*) AS n_quotes,
    (count(*) FILTER (original IS NOT NULL OR (f IS NOT NULL AND (NOT (f.c IS NOT DISTINCT FROM conv_id AND f.p >= pos) OR l.c IS DISTINCT FROM conv_id)))) AS n_linked,
    arg_min(original, struct_pack(d := depth, r := run)) FILTER (original IS NOT NULL) AS original FROM linked GROUP BY conv_id, pos),
told AS (SELECT s.conv_id, s.turn, s.role, o.own AS text, s.pos, coalesce(p.n_quotes, 0)::BIGINT AS n_quotes, coalesce(p.n_linked, 0)::BIGINT AS n_linked,
    coalesce(p.original, CASE WHEN s.pos > 1 THEN s.pos - 1 END)::INT AS parent FROM spoken s
    LEFT JOIN own o ON o.conv_id IS NOT DISTINCT FROM s.conv_id AND o.pos = s.pos LEFT JOIN per p ON p.conv_id IS NOT DISTINCT FROM s.conv_id AND p.pos = s.pos),
deep AS (SELECT conv_id, pos, 0 AS depth FROM told WHERE parent IS NULL
    UNION ALL SELECT t.conv_id, t.pos, d.depth + 1 FROM told t JOIN deep d ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND t.parent = d.pos)
SELECT t.* REPLACE (coalesce(t.parent, 0) AS parent), d.depth::INT AS depth, row_number() OVER (PARTITION BY t.conv_id ORDER BY d.depth, t.pos)::INT AS reply_order
FROM told t JOIN deep d ON d.conv_id IS NOT DISTINCT FROM t.conv_id AND d.pos = t.pos"""
