"""Line dedup by prefix doubling over line-ID sequences, in DataFrame operations only.

A document is a sequence of line IDs (the 128-bit hashes of its lines). Lines that occur once cut the sequences into
stretches; only these stretches are sorted. Prefix doubling ranks, round by round, the stretches' suffixes by their
first 1, 2, 4, ... lines: a round sorts the distinct pairs (rank here, rank half a window on) over range partitions and
numbers them in order. Suffixes that agree in their first n lines make up a longest-common-prefix interval of depth n;
two overlapping ranks name it. The maximal repeated runs are unions of such intervals' members, so for each line it
is enough to look at the shortest run with min_words words that begins with it and the shortest that ends with it:

    a line is deleted if and only if it lies in a run of consecutive lines with at least min_words words that also
    occurs earlier - in a document with a smaller doc_id, or before it in the same one without overlap.

Words are runs of non-space characters, lines are what stands between line feeds. Earlier means: by doc_id, null first,
then by a hash of the text where rows share a doc_id, then by line.

Defined cases: a null text stays null and has no lines. An empty text is one empty line. Rows that repeat both doc_id
and text are one document and get one answer. A text whose lines all go becomes empty. No rows: no result. Columns
other than doc_id and text pass through, whatever their names; only ld_lines and ld_removed are replaced, if asked for.

A line, run or pair of ranks may hold any share of the rows: such a key's rows are split (split_join), and rows without a
pair of ranks go round the join. Doubling stops at the depth that the longest deciding run needs; the order beyond it
decides nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, partitions, split_join

MIN_WORDS = 50
DOC = ["k", "t"]


def _key() -> list:
    """k and t: the document's place in the order, free of nulls."""
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    return [k.alias("k"), F.xxhash64(F.col("doc_id").isNull(), F.col("text")).alias("t")]


def lines(docs: DataFrame) -> DataFrame:
    """k, t, pos, line ID (h1, h2) and words of every line."""
    rows = docs.where("text is not null").select(*_key(), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("k", "t", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(r"\S+")).alias("words"))


def numbered(classes: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """keys with rank: numbers that ascend with the keys, made over range partitions. n, the key's rows, comes along."""
    parts = partitions(classes.sparkSession)
    return scratch.cut(classes.select(*keys, "n").repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()))


def stretches(all_lines: DataFrame, scratch: Scratch) -> DataFrame:
    """The lines whose ID occurs twice or more: k, t, pos, words, s (the stretch they stand in) and rank, the ID's."""
    ids = all_lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    ids = numbered(ids, ["h1", "h2"], scratch)
    found = split_join(all_lines, ids, ["h1", "h2"], "n", all_lines.count()).dropDuplicates([*DOC, "pos"])
    s = F.col("pos") - F.row_number().over(Window.partitionBy(*DOC).orderBy("pos"))
    return scratch.cut(found.select(*DOC, "pos", "words", s.alias("s"), "rank"))


def shortest_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """k, t, start and n of the shortest runs within a stretch that begin or end with a line and have min_words words."""
    at = Window.partitionBy(*DOC, "s")
    upto = F.sum("words").over(at.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*DOC, "s", "pos", "words", upto.alias("c")).withColumn("e", F.col("c") - F.col("words"))
    # Each line's bound is put in order among the other lines' sums; the last sum passed is the one sought.
    event = lambda value, kind: F.struct(value.alias("v"), F.lit(kind).alias("asks"))
    ends = rows.select(*DOC, "s", "pos", F.explode(F.array(event(F.col("c"), 0), event(F.col("e") + min_words, 1))).alias("x")).select(*DOC, "s", "pos", "x.*")
    last = F.last(F.when(F.col("asks") == 0, F.col("pos")), ignorenulls=True)
    down = at.orderBy(F.desc("v"), "asks", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = ends.select("*", last.over(down).alias("end")).where("asks = 1 and end is not null").select(*DOC, F.col("pos").alias("start"), (F.col("end") - F.col("pos") + 1).alias("n"))
    begins = rows.select(*DOC, "s", "pos", F.explode(F.array(event(F.col("e"), 0), event(F.col("c") - min_words, 1))).alias("x")).select(*DOC, "s", "pos", "x.*")
    up = at.orderBy("v", "asks", "pos").rowsBetween(Window.unboundedPreceding, 0)
    back = begins.select("*", last.over(up).alias("start")).where("asks = 1 and start is not null").select(*DOC, "start", (F.col("pos") - F.col("start") + 1).alias("n"))
    return ahead.union(back).where("n > 0").distinct()


def doubled(rows: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """k, t, pos and ranks: ranks[i] orders the suffixes by their first 2**i lines; null where these occur once."""
    rows = rows.select(*DOC, "s", "pos", F.array("rank").alias("ranks"), F.col("rank").alias("a"))
    for i in range(rounds):
        on = F.lead("a", 1 << i).over(Window.partitionBy(*DOC, "s").orderBy("pos"))
        rows = scratch.cut(rows.withColumn("b", on))
        whole = rows.where("a is not null and b is not null")
        pairs = numbered(whole.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1"), ["a", "b"], scratch)
        ranked = split_join(whole, pairs, ["a", "b"], "n", rows.count(), "left")
        ranked = ranked.unionByName(rows.where("a is null or b is null").withColumn("rank", F.lit(None).cast("long")))
        rows = ranked.select(*DOC, "s", "pos", F.concat("ranks", F.array("rank")).alias("ranks"), F.col("rank").alias("a"))
    return rows.select(*DOC, "pos", "ranks")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """k, t, start, end (past the last) of the maximal runs of lines that are later copies."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = stretches(scratch.cut(lines(docs)), scratch)
    runs = scratch.cut(shortest_runs(rows, min_words).withColumn("i", F.floor(F.log2("n")).cast("int")))
    rounds = runs.agg(F.max("i")).first()[0] or 0
    ranks = doubled(rows, rounds, scratch)
    if rounds:
        ranks = scratch.cut(ranks)
    one = ranks.select(*DOC, F.col("pos").alias("start"), F.col("ranks").alias("r1"))
    two = ranks.select(*DOC, F.col("pos").alias("second"), F.col("ranks").alias("r2"))
    named = runs.join(one, [*DOC, "start"]).withColumn("second", F.expr("int(start + n - shiftleft(1, i))")).join(two, [*DOC, "second"])
    named = named.select(*DOC, "start", "n", F.expr("r1[i]").alias("a"), F.expr("r2[i]").alias("b")).where("a is not null and b is not null")
    named = scratch.cut(named)
    intervals = named.groupBy("n", "a", "b").agg(F.count("*").alias("size"), F.min(F.struct("k", "t", "start")).alias("f")).where("size > 1")
    same = (F.col("f.k") == F.col("k")) & (F.col("f.t") == F.col("t"))
    later = split_join(named, intervals, ["n", "a", "b"], "size", named.count()).where(~(same & (F.col("start") - F.col("f.start") < F.col("n"))))
    spans = later.select(*DOC, "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    by = Window.partitionBy(*DOC).orderBy("start", "end")
    fresh = F.coalesce(F.col("start") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    spans = spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*DOC, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = True) -> DataFrame:
    """docs with the later copies taken out of text; report: and ld_lines and ld_removed, numbers of lines."""
    spans = repeats(docs, min_words).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    names = [c for c in docs.columns if not (report and c in ("ld_lines", "ld_removed"))]
    rows = docs.select(*_key(), "text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"], F.lit(0).alias("ld_0")).alias("row"))
    rows = rows.join(spans, DOC, "left").withColumn("every", F.when(F.col("cut").isNotNull(), F.split("text", "\n")))
    kept = "zip_with(concat(array(0), cut.end), concat(cut.start, array(size(every))), (a, b) -> slice(every, a + 1, b - a))"
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(F.expr(kept)), "\n"))
    out = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names]
    if report:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
        removed = F.coalesce(F.expr("aggregate(cut, 0, (n, x) -> n + x.end - x.start)"), F.lit(0))
        out += [n.cast("long").alias("ld_lines"), removed.cast("long").alias("ld_removed")]
    return rows.select(*out)
