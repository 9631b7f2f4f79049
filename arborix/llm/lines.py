"""Removal of repeated multi-line passages by content-defined line chunks.

Native: only DataFrame functions.  A text is a list of lines; those without a
word belong to the line before them and are not compared.  A rolling hash over
the hashes of the last two lines says whether a chunk ends at a line, so
borders depend on content alone and shift with it.  A chunk with the next one,
where it is a single line, makes a unit of two lines at least.  Units whose
hashes repeat anywhere are compared byte by byte; of each, all but the first
occurrence go, and with them the lines around it as far as they agree, by the
128 bits of their md5, with those around the first.

Most lines are borders.  The unit of a passage is found if a chunk ends before
its last line but one and one at or behind its second line: short passages are
found as a rule, long ones nearly always, and their edges by the agreement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import SPACE, let
from .storage import columns, drop, release, save

#: Lines at which a chunk may end, of sixteen.  With 16 every pair of lines is a unit, and every passage of two lines is found, at more intermediate rows.
SIXTEENTHS = 15
#: Units that occur more often than this, or than this part of all, are dealt to several tasks.
MANY, PART = 256, 10_000

UNIT = "array<struct<c: int, h: bigint, n: int>>"
FULL = "array<struct<c: int, h: bigint, n: int, first: int, last: int, body: string, before: array<binary>, after: array<binary>>>"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def wordy(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE)) != ""


def units_col(lines: Column, only: Column | None = None, sixteenths: int = SIXTEENTHS) -> Column:
    """lines -> its units (c: number of the chunk, h, n: hash and length of the body), or the full ones of some chunks.

    first and last are places among the lines with words, before and after the
    md5 of the lines of the chunk beside the unit, or of two if that has one line: were all
    of them to agree, they would be a unit of their own.
    """

    def ends(h):  # places of the last lines of the chunks
        roll = lambda i: F.md5(F.concat(F.coalesce(F.get(h, i - 1), F.lit("")), F.get(h, i)).cast("binary"))
        last = F.size(h) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.substring(roll(i), 1, 1) < F.lit("0123456789abcdefg"[sixteenths])))

    def unit(w, e, c):
        start = lambda k: F.coalesce(F.get(e, k - 1) + 1, F.lit(0))
        part = lambda a, b: F.slice(w, a + 1, F.greatest(b - a + 1, F.lit(0)))
        a, single = start(c), F.get(e, c) == start(c)
        b = F.when(single, F.get(e, c + 1)).otherwise(F.get(e, c))
        body = lambda b: F.array_join(part(a, b), "\n")

        def made(b, text):
            plain = [c.alias("c"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("int").alias("n")]
            if only is None:
                return F.struct(*plain)
            d = F.when(single, c + 1).otherwise(c)  # number of the last chunk
            to = F.coalesce(F.when(F.get(e, d + 1) == b + 1, F.get(e, d + 2)), F.get(e, d + 1), b)
            from_ = F.when(start(c - 1) == a - 1, start(c - 2)).otherwise(start(c - 1))
            digests = lambda x: F.transform(x, lambda y: F.unhex(F.md5(y.cast("binary"))))
            before = digests(F.when(c > 0, part(from_, a - 1)).otherwise(F.array().cast("array<string>")))
            return F.struct(*plain, a.alias("first"), b.alias("last"), text.alias("body"), before.alias("before"), digests(part(b + 1, to)).alias("after"))

        return F.when(b.isNotNull(), let(b, lambda b: let(body(b), lambda t: made(b, t))))

    def units(w):
        of = lambda e: F.filter(F.transform(only if only is not None else F.sequence(F.lit(0), F.size(e) - 1), lambda c: unit(w, e, c)), lambda u: u.isNotNull())
        return F.when(F.size(w) < 2, F.array().cast(UNIT if only is None else FULL)).otherwise(let(F.transform(w, lambda x: F.md5(x.cast("binary"))), lambda h: let(ends(h), of)))

    return let(F.filter(lines, wordy), units)


def _dealt(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined to keys (on..., h, n, many) by ``on``: frequent units are dealt to several tasks.

    At most PART units can occur more often than one in PART of all, so the
    table of those is small whatever the input.
    """
    most = max(MANY, total // PART)
    hot = keys.groupBy("h", "n").agg(F.sum("many").alias("many")).filter(F.col("many") > most).select("h", "n", F.ceil(F.col("many") / most).cast("int").alias("parts"))
    count = F.coalesce("parts", F.lit(1))
    left = rows.join(F.broadcast(hot), ["h", "n"], "left").withColumn("part", F.pmod(F.xxhash64("_id", "_key", "c"), count).cast("int")).drop("parts")
    right = keys.join(F.broadcast(hot), ["h", "n"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), count - 1))).drop("parts")
    return left.join(right.drop(*({"h", "n"} - set(on))).hint("merge"), [*on, "part"]).drop("part")


def _agreeing(a: Column, b: Column) -> Column:
    """Number of lines in which two arrays agree from their first on."""
    odd = F.array_position(F.zip_with(a, b, lambda x, y: F.equal_null(x, y)), False)
    return F.when(odd == 0, F.size(a)).otherwise(odd - 1).cast("int")


def _place() -> Column:
    return F.struct(F.isnull("_id").alias("no"), "_id", "_key", "c").alias("place")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sixteenths: int = SIXTEENTHS) -> tuple[DataFrame, DataFrame]:
    """(rows, drops): rows (_row, _id, _key, _some), one for each row of docs; drops (_did, _dkey, _drop), places of the lines to remove among those with words.

    _some is null where nothing repeats.  The first occurrence is that in the
    text with the smallest id (null ids last), then by the text's hash and its
    place.  Rows equal in id and text are one text: they lose the same lines.
    """
    text, spark = F.col(text_col), docs.sparkSession
    key = F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))).alias("_key")
    named = docs.select(F.struct(*columns(docs)).alias("_row"), F.col(id_col).alias("_id"), key, lines_of(text).alias("_lines"))
    small = save(named.select("_id", "_key", F.explode(units_col(F.col("_lines"), None, sixteenths)).alias("u")).select("_id", "_key", "u.*"), "units")
    # two places at least; a row that repeats id and text is the same place
    seen = small.withColumn("at", F.xxhash64("_id", "_key", "c")).groupBy("h", "n").agg(F.count("*").alias("many"), F.min("at").alias("a"), F.max("at").alias("b"))
    twice = save(seen.filter("a <> b").select("h", "n", "many"), "twice")
    total = small.count()
    need = _dealt(small, twice, ["h", "n"], total).groupBy("_id", "_key").agg(F.collect_set("c").alias("_some"))
    need = save(need.select(F.col("_id").alias("_nid"), F.col("_key").alias("_nkey"), "_some"), "needed")
    drop(small), drop(twice), release(spark)
    # the text travels once with its row; only texts in which something repeats go on
    rows = save(named.drop("_lines").join(need.hint("merge"), F.col("_id").eqNullSafe(F.col("_nid")) & (F.col("_key") == F.col("_nkey")), "left").drop("_nid", "_nkey"), "rows")
    drop(need), release(spark)
    full = rows.filter("_some is not null").select("_id", "_key", F.explode(units_col(lines_of(F.col("_row")[text_col]), F.col("_some"), sixteenths)).alias("u")).select("_id", "_key", "u.*")
    full = save(full, "chunks")
    # compared by their bytes: the body is part of the key
    first = full.withColumn("place", _place()).groupBy("h", "n", "body").agg(F.count("*").alias("many"), F.min(F.struct("place", "before", "after")).alias("f"))
    first = save(first.filter("many > 1"), "first")
    gone = _dealt(full, first, ["h", "n", "body"], total).withColumn("place", _place()).filter(F.col("place") > F.col("f.place"))
    back, on = _agreeing(F.reverse("before"), F.reverse("f.before")), _agreeing(F.col("after"), F.col("f.after"))
    spans = gone.select("_id", "_key", F.sequence(F.col("first") - back, F.col("last") + on).alias("span"))
    drops = save(spans.groupBy("_id", "_key").agg(F.array_distinct(F.flatten(F.collect_list("span"))).alias("_drop")), "drops")
    drop(full), drop(first), release(spark)
    return rows, drops.select(F.col("_id").alias("_did"), F.col("_key").alias("_dkey"), "_drop")


def kept_lines(lines: Column, drop: Column) -> Column:
    """The lines that stay; a line that goes takes the lines without words behind it along."""

    def of(at):  # at: places of the lines with words
        none = F.array().cast("array<int>")
        head = F.slice(lines, 1, F.coalesce(F.get(at, F.lit(0)), F.size(lines)))
        own = lambda i: F.slice(lines, F.get(at, i) + 1, F.coalesce(F.get(at, i + 1), F.size(lines)) - F.get(at, i))
        stay = F.when(F.size(at) > 0, F.array_except(F.sequence(F.lit(0), F.size(at) - 1), drop)).otherwise(none)
        return F.concat(head, F.flatten(F.transform(stay, own)))

    return let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: wordy(F.get(lines, i))), of)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sixteenths: int = SIXTEENTHS, keep_columns: bool = True) -> DataFrame:
    """docs with repeated passages cut from the text; all rows and columns stay.

    With keep_columns=False the result is (id, n_lines, n_removed, text).  Null
    texts stay null and have no lines; an empty text is one empty line.  A text
    all of whose lines go becomes empty.  An empty table gives no rows.
    """
    rows, drops = repeated_lines(docs, id_col, text_col, sixteenths)
    some = rows.filter("_some is not null").join(drops.hint("merge"), F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_key") == F.col("_dkey")), "left")
    both = some.select("_row", "_drop").unionByName(rows.filter("_some is null").select("_row", F.lit(None).cast("array<int>").alias("_drop")))
    original, none = F.col("_row")[text_col], F.col("_drop").isNull()
    stay = let(lines_of(original), lambda ls: kept_lines(ls, F.col("_drop")))
    if keep_columns:
        text = F.when(none, original).otherwise(F.array_join(stay, "\n"))
        return both.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])
    both = both.select("_row", F.when(original.isNull(), 0).otherwise(F.size(lines_of(original))).alias("n"), F.when(~none, stay).alias("stay"))
    removed = F.when(F.col("stay").isNull(), 0).otherwise(F.col("n") - F.size("stay"))
    return both.select(F.col("_row")[id_col].alias("id"), F.col("n").cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.coalesce(F.array_join("stay", "\n"), original).alias("text"))
