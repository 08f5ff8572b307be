"""Document fingerprints as invertible Bloom lookup sketches.

A text is cut into paragraphs: sentences with the marks and line ends behind them, at most ``MAX_PIECE`` code points, every
code point in one of them.  Equal paragraphs count as one with its number, so a text is a set of 60-bit digests.  A sketch
has three tables of cells; a digest goes to one cell of each, which holds a count, the XOR of its digests and the XOR of
their check values.  Subtracting the sketches of two versions leaves the digests that only one of them has.  Peeling takes
a cell of one digest (count 1 or -1, fitting check value and place), notes the digest and subtracts it from its two other
cells, table by table.  A pair that does not come out empty is sketched again, with fresh places and twice the cells.

``sketch_text`` gives the fingerprint: the sketch at ``BASE_CELLS`` cells a table, in hexadecimal digits; equal texts have
equal fingerprints.  ``differences`` recovers the digests on either side and ``likeness`` is the share of common digests
among all (1 for two empty texts).  Everything is DataFrame functions.  Pairs are dealt out once, with their digests; the
cells of a pair are summed, peeled and summed again where they are, so the rounds shuffle nothing.

Defined cases: a null text is empty; a null doc_id comes before all others; rows of equal doc_id follow by their text, and
repeated rows follow each other; the document after the last is the first, a lone document is its own next; an empty table
gives no rows.  Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revguard.llm.common import bounded_broadcast, let, pick, shuffle_width, written

#: Code points of a paragraph at most.
MAX_PIECE = 256
PIECE = rf"[^.!?\n]{{1,{MAX_PIECE}}}+[.!?\n]*+|[.!?\n]++"
#: Cells of each of the three tables of a fingerprint.
BASE_CELLS = 8
#: The smallest sketch that is peeled has 2 to this power of cells in each table.
LEAST_BITS = 4
#: Tables that are peeled in turn in one attempt; what is left then counts as a failure.
TURNS = 9
TABLES = 3
#: Ranges of documents per shuffle partition: several, so that tasks come out alike.
RANGES_PER_TASK = 4
#: Rows that are no cells: recovered digests, and the sizes of a pair; kinds of rows in all.
FOUND, SIZES, KINDS = 3, 4, 8
#: Numbers of failed pairs that may be broadcast; more are joined by shuffle.
BROADCAST_FAILED = 1_000_000
#: Digests keep so many bits, so that a digest and a kind of row fit into one number.
DIGEST_BITS = 60


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs, each with how often the paragraph occurs in it."""
    hashes = F.array_sort(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)),
                                      lambda p: F.xxhash64(p)))

    def counted(h: Column) -> Column:
        starts = F.filter(F.transform(h, lambda x, i: F.when((i == 0) | (x != F.get(h, i - 1)), i)), lambda i: i.isNotNull())
        return let(starts, lambda s: F.transform(
            s, lambda i, j: F.shiftrightunsigned(
                F.xxhash64(F.get(h, i), F.coalesce(F.get(s, j + 1), F.size(h)) - i), 64 - DIGEST_BITS)))
    return let(hashes, counted)


# SQL text here: a plan of nine turns is built from few calls.

def cell_of(digest: str, table: int, cells: str) -> str:
    """Place of a digest in a table of so many cells; another number of cells gives unrelated places."""
    return f"pmod(xxhash64({digest}, CAST({cells} AS BIGINT), {table}), CAST({cells} AS BIGINT))"


def check_of(digest: str) -> str:
    return f"xxhash64({digest}, -1)"


def sketch_text(found: str) -> Column:
    """The sketch of a column of digests at ``BASE_CELLS`` cells a table, in hexadecimal digits: count, digests and checks of
    each cell."""
    rows = f"transform({found}, d -> named_struct('d', d, 'check', {check_of('d')}, " + ", ".join(
        f"'c{t}', {cell_of('d', t, str(BASE_CELLS))}" for t in range(TABLES)) + "))"
    tables = ", ".join(f"""array_join(transform(sequence(0, {BASE_CELLS - 1}), p -> transform(array(aggregate(
        filter(v, r -> r.c{t} = p), named_struct('n', 0L, 'k', 0L, 'c', 0L),
        (a, r) -> named_struct('n', a.n + 1, 'k', a.k ^ r.d, 'c', a.c ^ r.check))),
        c -> concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c), 16, '0')))[0]), '')"""
                       for t in range(TABLES))
    return F.expr(f"lower(transform(array({rows}), v -> concat({tables}))[0])")


def _row(table: int, place, n, key, check) -> str:
    """A cell; ``slot`` is its place and table in one number."""
    return (f"named_struct('slot', ({place}) * {KINDS} + {table}, 'n', CAST({n} AS BIGINT), 'key', CAST({key} AS BIGINT), "
            f"'check', CAST({check} AS BIGINT))")


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("pair", "cells", "slot").agg(
        F.expr("sum(n) AS n"), F.expr("bit_xor(key) AS key"), F.expr("bit_xor(check) AS check")).where("n != 0 OR key != 0 OR check != 0")


def _subtracted(pairs: DataFrame, attempt: int) -> DataFrame:
    """Cells of left minus right that are not empty, with a row of both sizes."""
    cells = f"CAST(pow(2, greatest({LEAST_BITS}, ceil(log2(greatest(size(left) + size(right), 1)))) + {attempt}) AS BIGINT)"
    signed = [f"transform({side}, d -> named_struct('sign', {sign}, 'd', d))" for side, sign in (("left", 1), ("right", -1))]
    each = pairs.selectExpr("pair", f"{cells} AS cells", "size(right) AS n_right",
                            f"explode(concat(array(named_struct('sign', 0, 'd', CAST(size(left) AS BIGINT))), {', '.join(signed)})) AS e")
    own = ", ".join(_row(t, cell_of("e.d", t, "cells"), "e.sign", "e.d", check_of("e.d")) for t in range(TABLES))
    rows = f"CASE WHEN e.sign = 0 THEN array({_row(SIZES, 0, 'e.d', 'n_right', 1)}) ELSE array({own}) END"
    return _summed(each.selectExpr("pair", "cells", f"inline({rows})"))


def _peeled(cells: DataFrame, table: int, with_digests: bool) -> DataFrame:
    """One table's cells of one digest taken out: a digest is in one cell of it, so none is taken twice.

    Digests taken out stay as rows of their own where they are asked for, else as a count for each side.
    """
    single = f"abs(n) = 1 AND slot = {cell_of('key', table, 'cells')} * {KINDS} + {table} AND check = {check_of('key')}"
    found = _row(FOUND, *(("key", "n") if with_digests else ("n", "1")), 0, 0)
    others = [_row(t, cell_of("key", t, "cells"), "-n", "key", "check") for t in range(TABLES) if t != table]
    return _summed(cells.selectExpr("pair", "cells", f"""inline(CASE WHEN {single} THEN array({found}, {', '.join(others)})
        ELSE array(named_struct('slot', slot, 'n', n, 'key', key, 'check', check)) END)"""))


def differences(pairs: DataFrame, with_digests: bool = True) -> DataFrame:
    """(pair, n_left, n_right, n_only_left, n_only_right, attempts[, only_left, only_right]) of every pair.

    ``pairs`` has a number pair (unique) and the digests left and right; it is read once per attempt, so it should be a
    written table.  Attempts go on until every pair has come out empty.
    """
    spark = pairs.sparkSession
    done, attempt = None, 0
    pairs = pick(pairs, "pair", "left", "right")
    left = pairs
    while True:
        cells = _subtracted(left.repartition(shuffle_width(spark), "pair"), attempt)
        for turn in range(TURNS):
            cells = _peeled(cells, turn % TABLES, with_digests)
        table, n = F.pmod("slot", F.lit(KINDS)), F.col("n")
        place = F.expr(f"(slot - pmod(slot, {KINDS})) div {KINDS}")
        if with_digests:
            plus, minus = (F.when((table == FOUND) & (n == s), 1) for s in (1, -1))
            odd = (table == FOUND) & (F.abs(n) != 1)
        else:
            plus, minus = (F.when((table == FOUND) & (place == s), n) for s in (1, -1))
            odd = F.lit(False)
        lists = [F.collect_list(F.when(c.isNotNull(), place)).alias(a) for c, a in ((plus, "only_left"), (minus, "only_right"))]
        out = written(cells.groupBy("pair").agg(
            F.max(F.when(table == SIZES, n)).alias("n_left"), F.max(F.when(table == SIZES, F.col("key"))).alias("n_right"),
            F.coalesce(F.sum(plus), F.lit(0)).cast("long").alias("n_only_left"),
            F.coalesce(F.sum(minus), F.lit(0)).cast("long").alias("n_only_right"),
            F.count(F.when((table < FOUND) | odd, 1)).alias("n_stuck"),
            F.lit(attempt + 1).alias("attempts"), *(lists if with_digests else [])), "peeled")
        ready = out.where("n_stuck = 0").drop("n_stuck")
        done = ready if done is None else done.unionByName(ready)
        failed = out.where("n_stuck > 0").select("pair")
        if failed.isEmpty():
            return done
        left, attempt = pairs.join(bounded_broadcast(failed, BROADCAST_FAILED), "pair", "left_semi"), attempt + 1


def likeness(n_left: Column, n_right: Column, only_left: Column, only_right: Column) -> Column:
    """Common digests among all of both sides; 1 where there are none at all."""
    every = n_left + only_right
    return F.when(every == 0, F.lit(1.0)).otherwise((n_left - only_left) / F.greatest(every, F.lit(1)))


def _edited(text: Column, after: Column) -> Column:
    """The text with its last quarter replaced by as much of the beginning of the next one."""
    k = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - k), F.substring(after, F.lit(1), k))


def _range_of(rows: DataFrame) -> Column:
    """Number of the range that a row's (doc_id, h) lies in, by binary search among the ranges' first keys."""
    n = RANGES_PER_TASK * shuffle_width(rows.sparkSession)
    key = F.struct("doc_id", "h")
    ranged = rows.select("doc_id", "h").repartitionByRange(n, F.asc_nulls_first("doc_id"), F.col("h"))
    firsts = ranged.select(F.spark_partition_id().alias("part"), key.alias("k")).groupBy("part").agg(F.min("k").alias("k"))
    kind = rows.schema["doc_id"].dataType
    starts = [F.struct(F.lit(r["k"][0]).cast(kind).alias("doc_id"), F.lit(r["k"][1]).cast("long").alias("h"))
              for r in firsts.orderBy("part").collect()][1:]  # at most one per range
    if not starts:
        return F.lit(0)

    def search(k: Column) -> Column:
        """The number of starts up to k: halves the step until it is one."""
        steps = F.array(*(F.lit(1 << b) for b in reversed(range(len(starts).bit_length()))))
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= len(starts)) & (F.get(F.array(*starts), at + step - 1) <= k), at + step).otherwise(at))
    return let(key, search)


def versions(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_chars, edited_sha256, and the digests own, edited and next of every document, written.

    Documents are dealt out by ranges of doc_id and text hash; a document's next one is the next row of its range, and the
    last row of a range is joined to the first row of the next range that has rows.  Texts move once.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    by = [F.asc_nulls_first("doc_id"), F.col("h"), F.col("text")]
    dealt = rows.withColumn("part", _range_of(rows)).repartition(shuffle_width(spark), "part")
    w = Window.partitionBy("part").orderBy(*by)
    own = dealt.withColumn("own", digests(F.col("text")))
    led = own.select("part", "doc_id", "text", "own", F.row_number().over(w).alias("place"),
                     F.lead("text").over(w).alias("after"), F.lead("own").over(w).alias("next"))
    is_first, is_last = F.col("place") == 1, F.col("after").isNull()

    def with_edit(frame: DataFrame) -> DataFrame:
        return (frame.withColumn("new", _edited(F.col("text"), F.col("after")))
                .withColumn("edited_sha256", F.sha2(F.col("new").cast("binary"), 256)).withColumn("edited", digests(F.col("new"))))

    columns = ["row", "doc_id", "n_chars", "edited_sha256", "own", "edited", "next"]
    row = (F.shiftleft(F.col("part").cast("long"), 33) + F.col("place")).alias("row")
    table = written(with_edit(led).select(
        "part", row, "doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited_sha256", "own", "edited", "next",
        is_first.alias("is_first"), is_last.alias("is_last"), F.when(is_first | is_last, F.col("text")).alias("edge")), "versions")
    parts = sorted(r["part"] for r in table.where("is_first").select("part").collect())  # at most one row per range
    if not parts:
        return table.select(*columns)
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    firsts = table.where("is_first").select(F.col("part").alias("next_part"), F.col("edge").alias("after"), F.col("own").alias("next"))
    lasts = (table.where("is_last").select("part", "row", "doc_id", "n_chars", F.col("edge").alias("text"), "own")
             .join(F.broadcast(following), "part").join(firsts, "next_part"))
    ends = written(with_edit(lasts).select(*columns), "versions")
    return table.where("not is_last").select(*columns).unionByName(ends)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    table = versions(docs)
    pairs = table.select(F.col("own").alias("left"), F.explode(F.array(*(F.struct(
        (F.col("row") * 2 + k).alias("pair"), F.col(c).alias("right")) for k, c in enumerate(("edited", "next"))))).alias("p"))
    near = differences(pairs.select("p.pair", "left", "p.right"), with_digests=False).select("pair", likeness(
        *(F.col(c) for c in ("n_left", "n_right", "n_only_left", "n_only_right"))).alias("near"))
    both = near.groupBy(F.expr("pair div 2").alias("row")).agg(*(
        F.max(F.when(F.col("pair") % 2 == k, F.col("near"))).alias(c) for k, c in enumerate(("near_edited", "near_next"))))
    return table.join(both.hint("shuffle_hash"), "row").select(
        "doc_id", "n_chars", "edited_sha256", sketch_text("own").alias("fingerprint"),
        sketch_text("edited").alias("edited_fingerprint"), "near_edited", "near_next")
