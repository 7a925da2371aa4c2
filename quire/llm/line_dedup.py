"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its space-separated tokens.  A line is removed iff an earlier
one, in the order of (doc_id, line number), is similar enough (a Jaccard similarity
of 0.8 or more by default, so an equal line as well); lines without a token stay.

Equal lines become one before anything else is done with them (map-side combined, so
a line that is a third of all lines is one row of each task).  Tokens are ordered by
rarity: a sketch of fixed size counts the tokens of all distinct lines, and a token's
key leads with the class of its count.  Tokens of cells that count ``RARE`` at most are
rare, and come first.

Prefix filter.  Let a and b be the tokens that only the one or the other of two similar
lines has.  The first token that both have is among the first ``n - ceil(0.8 n) + 1`` of
each, as all before it are in one line only.  So a line is posted under the rare tokens
among these; such a list has RARE lines at most.  If all of them are rare, that is all.
Else a similar line may share none of the line's r rare tokens, but then these are r of
its a.  Of the other tokens of both lines, merged in the order, ``a - r + b`` at most are
in one line only, and so they leave two shared tokens side by side among the first
``a - r + b + 2`` shared ones, which are within the first ``2 (a - r) + b + 2`` places.
As ``2 a + b`` is at most 0.4 n, a line is posted under each pair of neighbours among the
first ``0.4 n - 2 r + 2`` of its other tokens: two tokens make far shorter lists than one
that is not rare.  Lines so short that they may share too few tokens for that are posted
under single tokens, rare or not.

At a token that two lines share, the length filter (sizes), the positional filter (what
they can share before and after it) and an odd sketch of the whole line decide whether
they are a candidate pair; all are upper bounds of the overlap, so no similar pair is
lost.  Candidates are verified on their whole token sets, which are read again for the
lines concerned only.

Lists are in the order of documents.  Up to ``LEADERS`` lines of a list all meet; the
rest of a longer one meet its first line only, so that a group of near copies does not
become all its pairs.  Lines of long lists that this has not removed then meet all
others of their lists.  Two lines meet in the first list only of a run of keys that
follow each other in both: a posting names its line's key before, and lines that have
that one in common as well have met there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import carried, cut, free, release, restored, table

PERCENT = 80
#: Cells of the frequency sketch and of the filter of wanted values.
SKETCH = 1 << 18
FILTER = 1 << 20
#: Count of a cell up to which its tokens are rare.
RARE = 256
#: Lines of a list that all meet.
LEADERS = 64
#: Tokens above which a line's odd sketch has two halves.
HALVED = 16
#: Parts of the lists that are shuffled one after the other, which bounds the disk they take at once.
PASSES = 3
_BITS = (1, 2, 4, 8)
_NONE = (1 << 63) - 1


def lines(docs: DataFrame) -> DataFrame:
    """(d, h, line_no, line) of all lines; d and h name the document."""
    named = docs.select(_d(F.col("doc_id")).alias("d"), F.xxhash64("text").alias("h"), "text")
    return named.select("d", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _d(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_NONE))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(id, line, d, h, line_no) of each distinct line that has a token: where it occurs first."""
    first = lines(docs).where("trim(line) <> ''").groupBy("line").agg(F.min(F.struct("d", "h", "line_no")).alias("at"))
    return cut(first.select("line", "at.*").withColumn("id", F.monotonically_increasing_id()), compression="zstd")


def _cells(codes: DataFrame, size: int, none: int) -> DataFrame:
    """One row with ``size`` bytes: of each ``cell`` its ``code`` (1 to 127), or ``none``."""
    whole = codes.sparkSession.range(size).select(F.col("id").cast("int").alias("cell")).join(codes, "cell", "left")
    each = F.struct("cell", F.char(F.coalesce("code", F.lit(none)).cast("long")).alias("c"))
    return whole.agg(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["c"]), "").cast("binary").alias("cells"))


def _read(cells: Column, at: Column) -> Column:
    """The byte at a place of such bytes."""
    return F.ascii(F.substring(cells, (at + 1).cast("int"), 1).cast("string"))


def _members(values: DataFrame) -> Column:
    """A filter of the one column of ``values``: FILTER cells, four a byte, whatever the input; read by a scalar subquery."""
    cell = values.toDF("v").select(F.pmod(F.xxhash64("v"), F.lit(FILTER)).cast("int").alias("c")).distinct()
    bit = F.element_at(F.array(*map(F.lit, _BITS)), F.col("c").bitwiseAND(F.lit(3)) + 1)
    return cut(_cells(cell.groupBy(F.shiftright("c", 2).alias("cell")).agg((F.sum(bit) + 64).cast("int").alias("code")), FILTER // 4, 64)).scalar()


def _maybe(cells: Column, value: Column) -> Column:
    at = F.pmod(F.xxhash64(value), F.lit(FILTER)).cast("int")
    bit = F.element_at(F.array(*map(F.lit, _BITS)), at.bitwiseAND(F.lit(3)) + 1)
    return _read(cells, F.shiftright(at, 2)).bitwiseAND(bit) != 0


def sketch(unique: DataFrame) -> Column:
    """The frequency class of each cell of the sketch, from the tokens of all distinct lines."""
    token = unique.select(F.explode(F.split("line", " ")).alias("token"))
    counted = token.groupBy(F.pmod(F.xxhash64("token"), F.lit(SKETCH)).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    return F.lit(bytes(_cells(counted.select("cell", _class(F.col("n")).alias("code")), SKETCH, 1).first()["cells"]))


def _class(count) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(126), F.floor(F.log2(count) * 3))).cast("int")


def tokens(line: Column, classes: Column) -> Column:
    """The distinct token keys of a line from rare to frequent."""
    empty = F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda x: F.xxhash64(x))), F.xxhash64(F.lit("")))
    key = lambda x: F.shiftleft(_read(classes, F.pmod(x, F.lit(SKETCH))).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(x, 8))
    return F.sort_array(F.transform(empty, key))


def prefix_places(n: Column, percent: int) -> Column:
    """Places among which two similar lines have their first shared token."""
    return (n - F.ceil(n * F.lit(percent / 100) - 1e-9) + 1).cast("int")


def neighbour_places(n: Column, rare: Column, percent: int) -> Column:
    """Places of the tokens that are not rare among which two neighbours are shared, if no rare token is."""
    return (F.floor(n * F.lit(2 * (100 - percent) / 100) + 1e-9) + 2 - 2 * rare).cast("int")


def shortest(percent: int) -> int:
    """The largest size of a line that may share too few tokens with a similar one to have shared neighbours."""
    if percent <= 50:
        raise ValueError("similarities of more than 50 % are asked for")
    most = 2 * (100 + percent) // (2 * percent - 100) + 2
    few = 0
    for n in range(1, most):
        for m in range(n, most * 2):
            shared = -(-percent * (n + m) // (100 + percent))
            if shared <= n and shared < n + m - 2 * shared + 2:
                few = m
    return few


def odd_sketch(t: Column) -> tuple[Column, Column]:
    """Of each of 64 cells, or of 128 in two numbers for more than HALVED tokens, whether an odd number of a line's tokens
    are of it: two lines' sketches differ in at most as many cells as there are tokens in one of them only.  The first
    number is of all tokens, the second of one half of a long line's; the other half is their xor."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    of = lambda c: F.aggregate(c, zero, lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))))
    half = F.when(F.size(t) > HALVED, of(F.filter(t, lambda x: x.bitwiseAND(F.lit(64)) != 0))).otherwise(zero)
    return of(t), half


def may_be(percent: int) -> Column:
    """Whether lines x and y of sizes nx, ny that share the token at places px, py can be similar.

    Similar lines share ``percent / (100 + percent)`` of ``nx + ny`` at least.  They can
    share the lesser of what is before the token and of what comes with it and after,
    which bounds sizes and places at once; and not what their odd sketches tell apart.
    The neighbours that the prefix filter promises are within these lines' own
    ``2 a + b + 2`` places.
    """
    both = F.col("nx") + F.col("ny")
    most = F.least("px", "py") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    whole, half = F.col("ox").bitwiseXOR(F.col("oy")), F.col("ex").bitwiseXOR(F.col("ey"))
    halved = (F.col("nx") > HALVED) & (F.col("ny") > HALVED)
    differ = F.when(halved, F.bit_count(whole.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(whole)).cast("long")
    place = lambda p, n: (F.col(p) - 1) * (100 + percent) <= (F.col(n) + both) * (100 + percent) - 3 * percent * both  # noqa: E731  2 a + b + 1 at most
    return (differ * (100 + percent) <= both * (100 - percent)) & (most * (100 + percent) >= both * percent) & place("px", "nx") & place("py", "ny")


def postings(unique: DataFrame, classes: Column, percent: int) -> DataFrame:
    """(key, id, d, sized, o, e, v) of the rare tokens in each line's prefix and of the neighbours after them; v is the line's key before, or 0."""
    each = unique.select("id", "d", tokens(F.col("line"), classes).alias("t")).withColumn("n", F.size("t"))
    each = each.withColumn("first", prefix_places(F.col("n"), percent))
    least = F.shiftleft(_class(F.lit(RARE + 1)).cast("long"), 56)  # of the keys that are not rare
    each = each.withColumn("r", F.size(F.filter(F.slice("t", 1, F.col("first")), lambda x: x < least)))
    single = F.when(F.col("n") <= shortest(percent), F.col("first")).otherwise(F.col("r"))
    places = F.when(F.col("r") < F.col("first"), F.greatest(F.lit(1), neighbour_places(F.col("n"), F.col("r"), percent))).otherwise(F.lit(1))
    each = each.withColumn("s", single).withColumn("rest", F.slice("t", F.col("r") + 1, places))
    o, e = odd_sketch(F.col("t"))
    each = each.withColumn("o", o).withColumn("e", e)  # once a line, before there is a row a posting
    none = F.lit(0).cast("long")
    each = each.withColumn("a", F.concat(F.slice("t", 1, F.col("s")), F.slice("rest", 2, F.col("n"))))
    each = each.withColumn("b", F.concat(F.array_repeat(none, F.col("s")), F.slice("rest", 1, F.greatest(F.lit(0), F.size("rest") - 1))))
    last = lambda c: F.concat(F.array(none), F.slice(c, 1, F.greatest(F.lit(0), F.size(c) - 1)))
    both = F.arrays_zip(F.col("a"), F.col("b"), last("a").alias("la"), last("b").alias("lb"))
    listed = each.select("id", "d", "n", "o", "e", "s", "r", F.posexplode(both).alias("i", "p"))
    key = lambda i, a, b: F.when(i < F.col("s"), a).otherwise(F.xxhash64(a, b))
    place = F.when(F.col("i") < F.col("s"), F.col("i")).otherwise(F.col("i") - F.col("s") + 1 + F.col("r"))
    return listed.select(
        key(F.col("i"), F.col("p.a"), F.col("p.b")).alias("key"), "id", "d", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(place.cast("long")).alias("sized"), "o", "e",
        F.when(F.col("i") == 0, none).otherwise(key(F.col("i") - 1, F.col("p.la"), F.col("p.lb"))).alias("v"),
    )


def _named(posted: DataFrame) -> DataFrame:
    """Postings under short names: i of the line, n its size, p the place, o and e its sketch, d its document, r the rank."""
    n, place = F.shiftright("sized", 32), F.col("sized").bitwiseAND(F.lit((1 << 32) - 1))
    return posted.select("key", F.col("id").alias("i"), n.alias("n"), place.alias("p"), "o", "e", "d", "v", F.col("rank").alias("r"))


def _ranked(posted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings with their places in their lists, under the names of either side of a join (one exchange for both)."""
    told = _named(posted.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("d", "id"))))
    return tuple(told.select("key", F.col("i").alias(c), *(F.col(v).alias(v + c) for v in "npoerv")) for c in "xy")


def later(pairs: DataFrame, unique: DataFrame, percent: int) -> DataFrame:
    """(id): of each similar one of ``pairs`` (x, y; cut) the line that comes later; verified on the whole sets."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    cells = _members(wanted)
    told = F.array_remove(F.array_distinct(F.split("line", " ")), "")
    sets = unique.where(_maybe(cells, F.col("id"))).join(wanted, "id", "left_semi").select("id", F.struct("d", "h", "line_no").alias("at"), told.alias("t"))
    sets = cut(sets)
    x, y = (sets.select(F.col("id").alias(c), F.col("at").alias(f"a{c}"), F.col("t").alias(f"t{c}")) for c in "xy")
    shared = F.size(F.array_intersect("tx", "ty"))
    similar = pairs.join(x, "x").join(y, "y").where(100 * shared >= percent * (F.size("tx") + F.size("ty") - shared))
    out = cut(similar.select(F.when(F.col("ax") > F.col("ay"), F.col("x")).otherwise(F.col("y")).alias("id")).distinct())
    free(sets)
    return out


def removed_lines(unique: DataFrame, percent: int) -> DataFrame:
    """(id): distinct lines that come after a similar one."""
    spark = unique.sparkSession
    posted = cut(postings(unique, sketch(unique), percent))
    parts = [posted.where(F.pmod(F.xxhash64("key"), F.lit(PASSES)) == i) for i in range(PASSES)]
    fits, met = may_be(percent), []
    marks = (F.col("rx") == LEADERS + 1) & (F.col("ry") == 1)  # one row of each list that is longer
    # Two lines that also have the key before in common meet in that one's list already.
    anew = (F.col("vx") == 0) | (F.col("vx") != F.col("vy"))
    turn = (F.col("ry") < F.col("rx")) & ((F.col("rx") <= LEADERS) & anew | (F.col("ry") == 1))
    for part in parts:
        x, y = _ranked(part)
        # Not by a plain bound of the rank, for which Spark would limit and exchange the one side apart.
        y = y.where(F.pmod("ry", F.lit(1 << 30)) <= LEADERS)
        both = x.join(y, "key").where(turn & (fits | marks))
        met.append(cut(both.select(F.when(fits, F.col("x")).alias("x"), F.when(fits, F.col("y")).alias("y"), F.when(marks, F.col("key")).alias("key"))))
        del x, y, both
        release(spark)
    whole = reduce(DataFrame.unionByName, met)
    long = whole.where("key is not null").select("key")
    any_long = long.limit(1).count() > 0
    lists = cut(posted.where(_maybe(_members(long), F.col("key"))).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PASSES)).cast("int"))) if any_long else None
    del parts, part
    free(posted)
    pairs = cut(whole.where("x is not null").select("x", "y").distinct())
    free(*met)
    gone = later(pairs, unique, percent)
    free(pairs)
    release(spark)
    if not any_long:
        return gone

    settled, rest = _members(gone), []
    for i in range(PASSES):
        live = lists.where(F.col("part") == i).drop("part")
        sure = live.where(~_maybe(settled, F.col("id")))
        left = live.where(_maybe(settled, F.col("id"))).join(gone, "id", "left_anti").select(*sure.columns)
        x, y = (_named(df.withColumn("rank", F.lit(0))).select("key", *(F.col(v).alias(f"{v}{c}") for v in "inpoedv")) for c, df in (("x", sure.unionByName(left)), ("y", live)))
        before = (F.col("dy") <= F.col("dx")) & (F.col("iy") != F.col("ix"))  # ids are in no order within a document
        rest.append(cut(x.join(y, "key").where(before & anew & fits).select(F.col("ix").alias("x"), F.col("iy").alias("y")).distinct()))
        del live, sure, left, x, y
        release(spark)
    free(lists)
    pairs = cut(reduce(DataFrame.unionByName, rest).distinct())
    found = later(pairs, unique, percent)
    free(*rest, pairs)
    return gone.unionByName(found)


def kept_lines(docs: DataFrame, percent: int) -> DataFrame:
    """(row, kept, n_lines, n_removed): all columns of ``docs``, the text that stays, and counts of lines."""
    unique = distinct_lines(docs.select("doc_id", "text"))
    release(docs.sparkSession)
    stays = unique.join(removed_lines(unique, percent), "id", "left_anti")
    places = stays.groupBy("d", "h").agg(F.sort_array(F.collect_set("line_no")).alias("k"))
    since = lambda i: F.when(i > 0, F.element_at("k", F.greatest(i, F.lit(1)))).otherwise(F.lit(-1))
    mask = F.array_join(F.transform("k", lambda x, i: F.concat(F.repeat(F.lit("0"), x - since(i) - 1), F.lit("1"))), "")
    marks = cut(places.select("d", "h", mask.alias("mask")))
    free(unique)
    release(docs.sparkSession)
    rows = docs.select(carried(docs).alias("row")).withColumn("d", _d(F.col("row.doc_id"))).withColumn("h", F.xxhash64("row.text"))
    joined = rows.join(marks.hint("shuffle_hash"), ["d", "h"], "left")
    split = F.split("row.text", "\n")
    stay = lambda x, i: (F.trim(x) == "") | (_read(F.coalesce("mask", F.lit("")).cast("binary"), i) == ord("1"))
    told = joined.select("row", F.size(split).alias("n"), F.filter(split, stay).alias("left"))
    n = F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.col("n"))
    lost = F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.col("n") - F.size("left"))
    return told.select("row", F.array_join("left", "\n").alias("kept"), n.cast("long").alias("n_lines"), lost.cast("long").alias("n_removed"))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with ``text`` without the lines removed, and ``n_lines`` and ``n_removed``.

    A null text stays null with no line, an empty one has one line without a token.
    A null id comes after all others.  Rows that repeat an id and text are one
    document and treated alike; rows that share an id only are ordered by a hash of
    the text.  An empty table stays empty.  Columns of ``docs`` called ``n_lines`` or
    ``n_removed`` are replaced; all others stay, whatever their names.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return kept_lines(docs, percent).select(*restored(columns, text=F.col("kept")), "n_lines", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def lines_sql(docs: str) -> str:
    return f"""
    split AS (SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
        FROM {docs}, range(1, 1 + len(string_split(text, chr(10)))) t(i) WHERE text IS NOT NULL),
    firsts AS (SELECT line, min(struct_pack(d := doc_id, n := line_no)) AS spot FROM split WHERE trim(line, ' ') <> '' GROUP BY line),
    sets AS MATERIALIZED (SELECT line, spot, row_number() OVER (ORDER BY spot) AS id,
        list_distinct(list_filter(string_split(line, ' '), lambda x: x <> '')) AS t FROM firsts),
    words AS MATERIALIZED (SELECT id, len(t) AS n, unnest(t) AS w FROM sets),
    often AS (SELECT w, count(*) AS c FROM words GROUP BY w),
    placed AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS p FROM words JOIN often USING (w)),
    prefix AS MATERIALIZED (SELECT id, n, w, p FROM placed WHERE p <= n - ceil(0.8::DOUBLE * n - 1e-9) + 1),
    pairs AS (SELECT DISTINCT a.id AS x, b.id AS y FROM prefix a JOIN prefix b ON a.w = b.w AND b.id < a.id
        WHERE 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n),
    gone AS (SELECT DISTINCT x FROM pairs JOIN sets a ON a.id = x JOIN sets b ON b.id = y
        WHERE 180 * len(list_intersect(a.t, b.t)) >= 80 * (len(a.t) + len(b.t))),
    kept AS (SELECT line, spot FROM sets WHERE id NOT IN (SELECT x FROM gone)),
    judged AS (SELECT s.*, trim(s.line, ' ') = '' OR k.spot IS NOT NULL AS keep FROM split s
        LEFT JOIN kept k ON k.spot = struct_pack(d := s.doc_id, n := s.line_no)),
    cleaned AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (keep), '') AS text,
        count(*)::BIGINT AS n_lines, (count(*) FILTER (NOT keep))::BIGINT AS n_removed FROM judged GROUP BY doc_id)"""


SQL = f"""WITH {lines_sql("documents")}
SELECT d.doc_id, c.text, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN cleaned c ON c.doc_id = d.doc_id"""
