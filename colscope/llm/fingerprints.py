"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text is the set of its paragraphs' 64-bit digests; a paragraph (a line) that is longer is cut after FIRST and then after
each PIECE code points, so that texts of one line can be compared too. A sketch has three parts of t
cells; every digest falls into one cell of each part. A cell holds the exclusive or of its digests (the key) and of
their check sums. Sketches of one size subtract cell by cell: what two versions share is gone, and the rest is
peeled: a cell with one digest (its check sum tells) gives it away, which is then taken out of its other cells, and
so on, a round for all such cells at once. If digests remain that no cell shows alone, the sketches are made again
larger. From the digests found and the side they stand on follows the likeness of the sets.

The digests of a part are put in order of a rotation of their bits, of which the leading ones are the cell number. So one pass
over sorted numbers fills the part, and no step looks at all pairs of cells and digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import documents, whole_text

#: Code points in the first and in each other piece of a paragraph at most.
FIRST, PIECE = 64, 160
#: Cells in each part of the sketch that is returned as the fingerprint.
BASE = 5
#: Rounds of peeling; each at least halves what is left while a sketch is large enough.
ROUNDS = 48
#: Rotations by which the three parts order the digests.
TURNS = (0, 21, 42)
#: Neighbours are found in so many buckets of document ids for each shuffle partition.
BUCKETS = 4

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def elements(text: Column) -> Column:
    """Distinct digests of the pieces of a text; none of the empty text."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?m)^[^\n]{{1,{FIRST}}}|[^\n]{{1,{PIECE}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def shift(name: str, x: Column, by: Column) -> Column:
    return F.call_function(name, x, by)


def sketch(digests: Column, t: Column) -> Column:
    """The 3 t cells of a set of digests as one array of numbers, key and check sum of each cell side by side."""
    nothing = F.lit(0).cast("long")
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).alias("at"), nothing.alias("key"), nothing.alias("chk"))
    # the leading 31 bits as a number from 0, in the order of signed numbers
    place = lambda r: F.shiftright((F.shiftright(r, 33) + (1 << 30)) * t, 31).cast("int")

    def part(turn: Column) -> Column:
        def add(acc: Column, r: Column) -> Column:
            e = shift("shiftrightunsigned", r, turn).bitwiseOR(shift("shiftleft", r, 64 - turn))
            same = F.struct(acc["done"].alias("done"), acc["at"].alias("at"), acc["key"].bitwiseXOR(e).alias("key"),
                            acc["chk"].bitwiseXOR(F.xxhash64(e)).alias("chk"))
            filled = F.concat(acc["done"], F.array(acc["key"], acc["chk"]), F.array_repeat(nothing, 2 * (place(r) - acc["at"] - 1)))
            other = F.struct(filled.alias("done"), place(r).alias("at"), e.alias("key"), F.xxhash64(e).alias("chk"))
            return F.when(place(r) == acc["at"], same).otherwise(other)

        ordered = F.sort_array(F.transform(digests, lambda e: shift("shiftleft", e, turn).bitwiseOR(shift("shiftrightunsigned", e, 64 - turn))))
        return F.aggregate(ordered, start, add, lambda acc: F.concat(
            acc["done"], F.array(acc["key"], acc["chk"]), F.array_repeat(nothing, 2 * (t - acc["at"] - 1))))

    return F.flatten(F.transform(F.array(*map(F.lit, TURNS)), part))


def subtract(one: Column, two: Column) -> Column:
    return F.zip_with(one, two, lambda a, b: a.bitwiseXOR(b))


def peel(cells: Column, t: Column) -> Column:
    """struct(found, left): the digests that the cells give away, and whether any stay hidden."""
    numbers = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("left"), numbers.alias("found"), F.lit(True).alias("going"))
    alone = lambda held: F.array_distinct(F.array_compact(F.transform(F.sequence(F.lit(0), 6 * t - 2, F.lit(2)), lambda i: F.when(
        F.get(held, i + 1) == F.xxhash64(F.get(held, i)), F.get(held, i)))))

    def turn(acc: Column) -> Column:
        return let(alone(acc["left"]), lambda f: F.struct(
            F.when(F.size(f) > 0, subtract(acc["left"], sketch(f, t))).otherwise(acc["left"]).alias("left"),
            F.concat(acc["found"], f).alias("found"), (F.size(f) > 0).alias("going")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda acc, _: F.when(acc["going"], turn(acc)).otherwise(acc), lambda acc: F.struct(
        acc["found"].alias("found"), F.exists(acc["left"], lambda x: x != 0).alias("left")))


def likeness(one: Column, base_one: Column, two: Column, base_two: Column) -> Column:
    """Shared digests over all digests of two sets, from what peeling the difference of their sketches finds; two empty sets are alike.

    First the base sketches are subtracted. If that leaves digests hidden, larger sketches are made: of both sets with the room that
    peeling needs at worst, then of twice and four times that. What even those hide (practically never) is counted directly.
    """
    n, m = F.size(one), F.size(two)
    sizes = F.transform(F.array(F.lit(0.0), (n + m) * 0.48 + 2 * BASE, (n + m) * 0.9 + 4 * BASE, (n + m) * 2.0 + 20 * BASE), lambda s: s.cast("int"))
    start = F.struct(F.array().cast("array<bigint>").alias("found"), F.lit(True).alias("left"))

    def attempt(t: Column) -> Column:
        first = peel(subtract(base_one, base_two), F.lit(BASE))
        return F.when(t == 0, first).otherwise(peel(subtract(sketch(one, t), sketch(two, t)), t))

    tried = F.aggregate(sizes, start, lambda acc, t: F.when(acc["left"], attempt(t)).otherwise(acc))

    def ratio(f: Column) -> Column:
        gone = F.size(F.array_intersect(f["found"], one))  # the others stand in the second set only
        return F.when(f["left"], F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two))).otherwise(
            (n - gone) / (n + F.size(f["found"]) - gone))

    return F.when(n + m == 0, 1.0).otherwise(let(tried, ratio))


def printed(digests: Column, base: Column) -> Column:
    """The base sketch as text: the number of digests, then key and check sum of each cell in hexadecimal."""
    return F.concat_ws(":", F.size(digests).cast("string"), F.array_join(F.transform(base, lambda x: F.hex(x)), ":"))


def with_next(df: DataFrame, value_cols: list[str]) -> DataFrame:
    """df (key, tie, ...) with next_<col> of the row that follows by descending key, and of the first row after the last.

    Rows are dealt into buckets of neighbouring keys; the row with a bucket's largest key is also sent to the bucket
    above, where it follows the last. The bounds are keys of the table: at most BUCKETS x shuffle partitions numbers.
    """
    spark = df.sparkSession
    n = max(1, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx("key", [i / n for i in range(1, n)] + [1.0], F.lit(max(10_000, 2 * n)))).first()[0]
    if not cuts:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in value_cols])
    cuts = sorted({*cuts, df.agg(F.max("key")).first()[0]})
    bounds = F.lit(cuts) if len(cuts) > 1 else F.array(F.lit(cuts[0]))
    # the first bound that is not below the key: as many as are below it
    bucket = F.size(F.filter(bounds, lambda c: c < F.col("key"))) if len(cuts) < 64 else below(cuts)
    copies = F.when(F.col("key") == F.element_at(bounds, F.col("bucket") + 1), F.array(
        F.struct(F.col("bucket").alias("in"), F.lit(False).alias("tail")),
        F.struct(F.when(F.col("bucket") == len(cuts) - 1, 0).otherwise(F.col("bucket") + 1).alias("in"), F.lit(True).alias("tail")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("in"), F.lit(False).alias("tail"))))
    dealt = df.withColumn("bucket", bucket).withColumn("copy", F.explode(copies)).select(*df.columns, F.col("copy.in").alias("bucket"), F.col("copy.tail").alias("tail"))
    order = Window.partitionBy("bucket").orderBy("tail", F.desc("key"), "tie")
    follows = [F.lead(c).over(order).alias(f"next_{c}") for c in value_cols]
    return dealt.select(*df.columns, "tail", *follows).where("not tail").drop("tail")


def below(cuts: list[int]) -> Column:
    """Number of sorted cuts below the key, by halving."""
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("key") <= cuts[mid], search(low, mid)).otherwise(search(mid + 1, high))

    return search(0, len(cuts))


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of df.

    The edited text has its last third replaced by the beginning of the next text (descending doc_id, then by hash of the text; null
    identifiers come last; the first follows the last). Null and empty texts have the fingerprint of no paragraphs. Equal texts have
    equal fingerprints; a table of one row is its own neighbour; other columns are not read.
    """
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    slim = slim.withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))).withColumn("tie", F.xxhash64("text"))
    base = lambda c: sketch(F.col(c), F.lit(BASE))
    slim = slim.withColumn("own", elements(F.col("text"))).withColumn("base", base("own"))
    rows = with_next(slim, ["text", "own", "base"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        "own", "base", elements(F.col("edited")).alias("changed"), "next_own", "next_base").withColumn("changed_base", base("changed"))
    others = F.array(F.struct(F.col("changed").alias("set"), F.col("changed_base").alias("base")),
                     F.struct(F.col("next_own").alias("set"), F.col("next_base").alias("base")))
    near = F.transform(others, lambda o: likeness(F.col("own"), F.col("base"), o["set"], o["base"]))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("own"), F.col("base")).alias("fingerprint"),
        printed(F.col("changed"), F.col("changed_base")).alias("edited_fingerprint"), near.alias("near")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.get("near", F.lit(0)).alias("near_edited"), F.get("near", F.lit(1)).alias("near_next"))


def op2_fingerprints(spark, folder: str) -> DataFrame:
    return fingerprint_edits(documents(spark, folder))
