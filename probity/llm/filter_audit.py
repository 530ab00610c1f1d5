"""What a set of filters removes in every order of applying them.

Each filter has a table of the ids that fail it. The survivors of a prefix of
filters are those of the prefix before, left-anti joined with the next table;
what the next filter removes from them is the left-semi join with its table,
and the rest of its table it finds removed already. A prefix's survivors don't depend on its order, so 32 sets stand for 120
orders of five; all joins are by one row number, all tables narrow.
"""

from itertools import permutations
from math import factorial

from pyspark.sql import functions as F

from probity.functions.lookup import looked_up

from .shared import stored

BLANKS = r"[\x20\x09-\x0D]+"

_PART, _ROW, _TEXT = "__part", "__row", "__text"


def text_failures(text):
    """Conditions A to D of a text (null is empty): short, repetitive, shouting, marked up."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")  # blanks at either end leave an empty piece
    count, characters = F.size(words), F.length(text)
    return {
        "A": count < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)).cast("long") < F.lit(50) * count.cast("long"),
        "C": F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > F.lit(3) * characters.cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failing_rows(docs, labels, ids="doc_id", text="text", part="lang"):
    """(rows, tables): every document's row number, part and labels, and one table of row numbers per filter A to E.

    Both are stored, so the row numbers stay. A document fails E if a row with a
    smaller id, anywhere in the table, has the same text; texts are compared by
    SHA-256. Rows without an id have none before or after them.
    """
    failures = text_failures(F.col(_TEXT))
    seen = stored(docs.select(
        F.col(f"`{ids}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias(_PART),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(_TEXT)).select(
        F.monotonically_increasing_id().alias(_ROW), "doc_id", _PART, F.sha2(F.col(_TEXT).cast("binary"), 256).alias("__hash"),
        *[c.alias(f) for f, c in failures.items()]), "audit-documents")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    first = seen.groupBy("__hash").agg(F.min("doc_id").alias("__first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    held = seen.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    marked = held.join(marks, "doc_id")
    told = looked_up(looked_up(seen, first, ["__hash"]), marked, ["doc_id"])
    told = stored(told.select(
        _ROW, _PART, *failures, F.coalesce(F.col("doc_id") > F.col("__first"), F.lit(False)).alias("E"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")), "audit-rows")
    return told.select(_ROW, _PART, "good", "toxic"), {f: told.where(F.col(f)).select(_ROW, _PART) for f in (*failures, "E")}


def survivors(rows, tables):
    """(row, part, labels, before): each document once for every set of filters that it passes whole.

    ``before`` holds the letters of the set in the order of ``tables``. Each filter tries to extend every prefix so far: one
    left-anti join, in which only the extended rows take part. All joins are by
    row number, so rows and tables are dealt out once.
    """
    out = rows.withColumn("before", F.lit(""))
    for name, table in tables.items():
        tried = out.withColumn("__next", F.explode(F.array(F.lit(False), F.lit(True)))).alias("s")
        out = tried.join(table.select(_ROW).alias("f").hint("shuffle_hash"), (F.col(f"s.{_ROW}") == F.col(f"f.{_ROW}")) & F.col("s.__next"), "left_anti")
        out = out.withColumn("before", F.concat("before", F.when(F.col("__next"), name).otherwise(""))).drop("__next")
    return out


def prefix_counts(rows, tables):
    """(part, key, n, good, toxic), small: how many survive the set of filters ``key`` ("AC"),
    and how many of those the next filter removes ("AC>B"); ">B" for no filter before, "!B" for all that fail B."""
    counts = [F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")]
    alive = survivors(rows, tables)
    out = alive.groupBy(_PART, F.col("before").alias("key")).agg(*counts)
    for name, table in tables.items():
        open_ = alive.where(~F.contains("before", F.lit(name)))
        gone = open_.join(table.select(_ROW).hint("shuffle_hash"), _ROW, "left_semi")
        out = out.unionByName(gone.groupBy(_PART, F.concat("before", F.lit(">" + name)).alias("key")).agg(*counts))
        out = out.unionByName(table.groupBy(_PART, F.lit("!" + name).alias("key")).agg(
            F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")))
    return out


def steps(names):
    """Every order of the filters, step by step: (order, step, filter, set before, set after)."""
    for order in permutations(names):
        for i, name in enumerate(order):
            yield "".join(order), i + 1, name, "".join(sorted(order[:i])), "".join(sorted(order[:i + 1]))


def audited(docs, labels, ids="doc_id", text="text", part="lang"):
    """One row per part, order of the filters A to E and step, zeros included.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley. A null text is empty; a null part is the
    empty string and one part with it; rows are counted, so repeated rows count
    each (equal texts of one id don't fail each other for that). A document labelled
    twice is good (toxic) if one of its labels says so; null labels say nothing. Texts of any
    length are judged whole; columns beside the named ones are not read; an empty table gives no rows.
    """
    rows, tables = failing_rows(docs, labels, ids, text, part)
    names = list(tables)
    # Orders in which a set of so many filters stands right before another one.
    orders = F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))])
    each = F.col("n") * F.get(orders, F.length("key") - 2)

    def last(n):
        return F.lit("".join(o for o in names if o != n) + ">" + n)

    once = prefix_counts(rows, tables).groupBy(_PART).agg(
        # At most 2^n + n 2^(n-1) + n entries for n filters.
        F.map_from_entries(F.collect_list(F.struct("key", F.struct("n", "good", "toxic")))).alias("m"),
        F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.max(F.when(F.col("key") == last(n), F.col("n"))), F.lit(0)))]).alias("u"),
        F.create_map(*[x for n in names for x in (F.lit(n), F.coalesce(F.sum(F.when(F.endswith("key", F.lit(">" + n)), each)), F.lit(0)))]).alias("v"))

    def number(key, field="n"):
        return F.coalesce(F.element_at("m", key)[field], F.lit(0))

    order = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(i).alias("step"), F.lit(n).alias("filter"), F.lit(b).alias("b"), F.lit(a).alias("a"))
                      for o, i, n, b, a in steps(names)])
    each = once.select(F.col(_PART).alias("part"), "m", "u", "v", F.inline(order))
    here = F.concat("b", F.lit(">"), "filter")
    return each.select(
        "part", "filter_order", "step", number(F.col("a")).alias("kept"), number(here).alias("removed"),
        (number(F.concat(F.lit("!"), "filter")) - number(here)).alias("redundant"), F.element_at("u", F.col("filter")).alias("unique_fails"),
        number(here, "good").alias("good_lost"), number(here, "toxic").alias("toxic_lost"), F.element_at("v", F.col("filter")).alias("shapley"))
