"""Line dedup: near-equal lines by MinHash, with DataFrame operations only.

Lines are cut at line feeds. Equal lines meet by a 128-bit hash. A line's shingles are all its strings of 8 characters (UTF-16
units), and its signature the bottom of one random order of them: its KEPT smallest hashes, ascending. Each RUN
neighbours in it are a band, and two lines that share a band are candidates: of two similar lines, the smallest hashes of
both together are mostly common, and RUN common ones in a row make a band in either. A candidate pair is verified by the exact
Jaccard similarity of the sets, unless bit maps of the sets alone show that too many shingles are in one set only.
Links form components, and one line per component stays: the first by doc_id, then by place in the table.

Only hashes below DRAWN / n of their range are gathered first, of n places in the line: all, if n is small, and else about DRAWN of
them. Lines that this leaves with fewer than KEPT, as are those that repeat few shingles often, are read again with a range MORE times as
wide, until they have KEPT or all of theirs. So the signature is that of all shingles, whatever was drawn.

Lines shorter than a shingle have themselves as their only shingle, so they meet equal lines only. Blank lines
(only white space) are no content: all stay, and are in no class. Null text: no lines, stays null.
Empty text: one blank line. Null doc_id: after all others. Repeated rows: the first keeps its lines. A document all of whose
lines went has an empty text. Very long lines: whole. Empty table: no rows. Other columns pass through unread, also those
with names that start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm.common import broadcast_up_to, conf, drop_stored, read_table, stored
from strandspark.llm.graph import bucket_links

#: Lines of a similarity of 0.8 share a band with a probability of 0.98, of 0.85 with 0.997.
SHINGLE, KEPT, RUN, DRAWN, SIMILARITY = 8, 12, 3, 24, 0.8
#: By how much the range that is gathered grows, where it held too few hashes.
MORE = 16
#: Longs of a bit map of shingles; two maps are under the 100 columns up to which Spark compiles a join. 64 * MAP is a power of two.
MAP = 32
#: Ids that are broadcast at most (8 MB).
SENT = 1 << 20
#: Lines that a task gathers hashes of in memory before it sorts all further hashes, a row each: about 90 MB by estimate (not measured); most file parts have fewer.
GATHERED = str(1 << 17)


def line_table(rows: DataFrame) -> DataFrame:
    """One row per line that isn't blank of rows (row, doc_id, text): row, doc_id, pos, line and its key."""
    out = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return out.filter(F.col("line").rlike(r"\S")).withColumns({"x": F.xxhash64("line"), "y": F.xxhash64(F.lit(1), "line")})


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16LE")


def _places(units: Column) -> Column:
    """At how many places shingles begin; a shorter line is one itself."""
    return F.greatest(F.shiftright(F.octet_length(units), 1) - (SHINGLE - 1), F.lit(1))


def _shingle(units: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(units, at * 2 + 1, F.lit(2 * SHINGLE)))


def shingles(units: Column) -> Column:
    """A line's character shingles, by their 64-bit hashes."""
    # units are an element here: as a column each shingle would copy the whole line out of its row
    each = F.transform(F.array(units), lambda u: F.transform(F.sequence(F.lit(0), _places(u) - 1), lambda i: _shingle(u, i)))
    return F.get(each, F.lit(0))


def _lowest(lines: DataFrame, drawn: int) -> DataFrame:
    """lines (keys ..., line) with n, the number of their shingles' places, f, the KEPT smallest of their hashes below drawn / n of the
    range, and whole: whether f is what all hashes would give."""
    keys = [c for c in lines.columns if c != "line"]
    cut = lines.select(*keys, _units(F.col("line")).alias("units")).withColumn("n", _places(F.col("units"))).withColumn("most", F.floor(F.lit(drawn * 2.0**31) / F.col("n")))
    each = cut.select(*keys, "n", "most", "units", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at")).select(*keys, "n", "most", "at", F.shiftrightunsigned(_shingle(F.col("units"), F.col("at")), 33).alias("h"))
    # the first place stands for a line that has no hash below
    below = F.col("h") <= F.col("most")
    low = each.filter(below | (F.col("at") == 0)).select(*keys, "n", F.when(below, F.col("h").cast("int")).alias("h"))
    out = low.groupBy(*keys, "n").agg(F.slice(F.sort_array(F.array_distinct(F.collect_list("h"))), 1, KEPT).alias("f"))
    return out.withColumn("whole", (F.size("f") == KEPT) | (F.col("n") <= drawn))


def signatures(lines: DataFrame) -> DataFrame:
    """lines (keys ..., line), of which row and pos tell one from the other, with n, the number of their shingles' places, and f, the
    KEPT smallest hashes. Stored tables."""
    out, drawn = stored(_lowest(lines, DRAWN), "occurrences"), DRAWN
    done, short = out.filter("whole").drop("whole"), out.filter(~F.col("whole")).select("row", "pos")
    if short.isEmpty():
        return done
    again = stored(lines.join(broadcast_up_to(short, SENT // 2), ["row", "pos"], "left_semi"), "short")
    while not short.isEmpty():
        drawn *= MORE
        out = stored(_lowest(again.join(short, ["row", "pos"], "left_semi"), drawn), "occurrences")
        done, short = done.unionByName(out.filter("whole").drop("whole")), out.filter(~F.col("whole")).select("row", "pos")
    drop_stored(again)
    return done


def bands(f: Column) -> Column:
    """A signature's bands; one of fewer hashes than a band has is a band itself."""
    runs = [F.when(F.size(f) >= k + RUN, F.xxhash64(*(F.get(f, F.lit(k + i)) for i in range(RUN)))) for k in range(KEPT - RUN + 1)]
    return F.when(F.size(f) < RUN, F.array(F.xxhash64(f))).otherwise(F.array_compact(F.array(*runs)))


def _maps(texts: DataFrame) -> DataFrame:
    """(x, n, p, m0, m1 ...): the number of different shingles of each line (x, units), their bit map, and its number of bits."""
    each = texts.select("x", F.explode(F.array_distinct(shingles(F.col("units")))).alias("h"))
    bit = F.expr("shiftleft(1L, cast(h & 63 AS int))")
    part = F.shiftright("h", 6).bitwiseAND(F.lit(MAP - 1))
    maps = each.groupBy("x").agg(F.count("*").alias("n"), *(F.bit_or(F.when(part == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(MAP)))
    return maps.withColumn("p", sum((F.bit_count(f"m{k}") for k in range(1, MAP)), F.bit_count("m0")))


def _may_hold(x: str = "a", y: str = "b") -> Column:
    """Whether the sizes and bit maps of x and y, prefixes of columns n, p, m0 ..., leave a similarity of SIMILARITY possible: each bit that only one has stands for a shingle at least."""
    both = sum((F.bit_count(F.col(f"{x}m{k}").bitwiseAND(F.col(f"{y}m{k}"))) for k in range(1, MAP)), F.bit_count(F.col(f"{x}m0").bitwiseAND(F.col(f"{y}m0"))))
    # common <= n - (p - both) on either side, and common >= SIMILARITY * (all of both lines)
    share = SIMILARITY / (1 + SIMILARITY)
    least = share * (F.col(f"{x}n") + F.col(f"{y}n")) - 1e-6
    sizes = F.least(f"{x}n", f"{y}n") >= SIMILARITY * F.greatest(f"{x}n", f"{y}n") - 1e-6
    return sizes & (both + F.least(F.col(f"{x}n") - F.col(f"{x}p"), F.col(f"{y}n") - F.col(f"{y}p")) >= least)


def _verifier(lines: DataFrame):
    """See bucket_links: pairs hold if their lines' sets of shingles are similar enough. lines: (x, line), lines repeated or not."""

    def prepare(ids: DataFrame):
        known = stored(lines.select("x", _units(F.col("line")).alias("units")).join(broadcast_up_to(ids.select(F.col("id").alias("x")), SENT), "x").dropDuplicates(["x"]), "lines")
        text = lambda side: known.select(F.col("x").alias(side), F.col("units").alias(f"u{side}"))

        def verify(pairs: DataFrame) -> DataFrame:
            # the sets are computed once for each pair: a filter on columns of a select would repeat what they are made of
            sets = F.array(F.struct(shingles(F.col("ua")).alias("a"), shingles(F.col("ub")).alias("b")))
            alike = F.exists(sets, lambda s: F.size(F.array_intersect(s.a, s.b)) >= SIMILARITY * F.size(F.array_union(s.a, s.b)))
            return pairs.join(text("a"), "a").join(text("b"), "b").filter(alike).select("a", "b")

        def traits(left: DataFrame) -> DataFrame:
            # maps cost more than they save in the first round, where most lines meet their like
            return stored(_maps(known.join(left.select(F.col("id").alias("x")), "x", "left_semi")), "maps").withColumnRenamed("x", "id")

        verify.traits, verify.may_hold = traits, _may_hold
        return verify

    return prepare


def line_classes(docs: DataFrame) -> DataFrame:
    """One row per line that isn't blank: row, doc_id, pos, class (the first row and place of its component), kept."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return _classes(rows, docs)


def _classes(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows: (row, doc_id, text), read once if its row isn't stored; docs: the same rows without row."""
    spark = docs.sparkSession
    with conf(spark, spark_sql_objectHashAggregate_sortBased_fallbackThreshold=GATHERED):
        every = signatures(line_table(rows))
    members = every.select("x", "f").dropDuplicates(["x"]).select(F.col("x").alias("id"), F.lit(1).alias("size"), F.explode(F.array_distinct(bands(F.col("f")))).alias("bucket"))
    at = every.select("x", "doc_id")

    def prepare(ids: DataFrame):
        # texts of one document each of the lines that share a band
        sent = broadcast_up_to(ids.select(F.col("id").alias("x")), SENT)
        where = stored(at.join(sent, "x").groupBy("x").agg(F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("known")).select(F.when(F.col("known") > 0, F.col("doc_id")).alias("doc_id")).distinct(), "where")
        found = docs.select("doc_id", "text").join(broadcast_up_to(where.filter("doc_id IS NOT NULL"), SENT), "doc_id", "left_semi")
        if not where.filter("doc_id IS NULL").isEmpty():
            found = found.unionByName(docs.select("doc_id", "text").filter("doc_id IS NULL"))
        return _verifier(line_table(found.select(F.lit(0).alias("row"), "doc_id", "text")))(ids)

    _, of = bucket_links(members, 0.0, prepare)  # sizes of sets aren't known here, bit maps bound the similarity
    # a line that is like none is a class of its own by both hashes; links know lines by the first
    of = of.select(F.col("id").alias("x"), F.col("component").alias("cx"))
    places = every.select("row", "doc_id", "pos", "x", "y").join(of, "x", "left")
    known = stored(places.select("row", "doc_id", "pos", F.coalesce("cx", "x").alias("cx"), F.when(F.col("cx").isNull(), F.col("y")).otherwise(0).alias("cy")), "classes")
    drop_stored(every)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("pos"))
    first = known.groupBy("cx", "cy").agg(F.min(place).alias("first"))
    out = known.join(first, ["cx", "cy"])
    same = (F.col("first.row") == F.col("row")) & (F.col("first.pos") == F.col("pos"))
    return out.select("row", "doc_id", "pos", F.col("first.row").alias("class_row"), F.col("first.doc_id").alias("class_doc"), F.col("first.pos").alias("class_pos"), same.alias("kept"))


def drop_repeated_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """docs, all columns, with only the first line of each class in text (and n_chars, if there is one, as it is then).
    drop_emptied: without the documents that had content and have none left."""
    # rows get their numbers once: a second scan may be split differently
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), *(F.col(c).alias(x) for c, x in own.items())), "rows")
    read = rows.select("row", F.col(own["doc_id"]).alias("doc_id"), F.col(own["text"]).alias("text"))
    gone = stored(_classes(read, read.drop("row")).filter(~F.col("kept")).groupBy("row").agg(F.collect_set("pos").alias("gone")), "gone")
    # the text goes as lines through the join: beyond it they are a column, which each place reads
    cut = rows.withColumn(own["text"], F.split(own["text"], "\n")).join(gone, "row", "left")
    lines = F.col(own["text"])
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("gone", F.array().cast("array<int>")))
    text = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    out = cut.withColumn(own["text"], F.when(F.col("gone").isNull(), F.array_join(lines, "\n")).otherwise(text))
    if "n_chars" in own:
        n = F.col(own["n_chars"])
        out = out.withColumn(own["n_chars"], F.when(F.col("gone").isNull(), n).otherwise(F.length(own["text"]).cast(docs.schema["n_chars"].dataType)))
    if drop_emptied:
        out = out.filter(F.col("gone").isNull() | F.col(own["text"]).rlike(r"\S"))
    return out.select(*(F.col(x).alias(c) for c, x in own.items()))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(read_table(spark, sf_dir, "documents")).drop("row", "class_row")
