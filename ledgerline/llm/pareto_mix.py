"""Mixing sources to target weights by Pareto order sampling.

1. Targets: sources, in order, share `factor` times all words by weight; one that would get
   more than `most` times its own words stops there, and what it leaves is shared again,
   until none is above.
2. Expected copies: a document is wanted target / source size times, or in proportion to a
   weight of its own, and never more than `most` times. The whole copies are certain; the
   rest is the document's inclusion probability p.
3. Sample sizes: documents of a source fall into classes of nearly equal size. From the
   longest class down, a class gives as many documents as its expected words and what
   longer classes owe ask for, rounded up or down at random, so that probabilities stay as
   they are; what rounding gives or takes is owed to the next class. A source so ends within a
   short document of its target, but for the spread of sizes inside classes.
4. Pareto order sampling: in a class, documents are ranked by odds(u) / odds(p), with u a
   random number that depends on the row and the seed only; the lowest are taken.

Only one row per source and class meets in a group: ranks come from a sort by ranges. Sums
are of whole numbers, so reruns agree.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a
source of its own, the last; without words all targets are 0; repeated rows are documents of
their own, told apart by their copies only; an empty table gives an empty result. Weights
that are null, not finite or not above 0 ask for no copy; where the others of a source may
not be copied often enough, all of them come `most` times. Columns of docs are kept; one with
the name of a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import discard, stored
from ledgerline.llm.ranks import ranked

WEIGHTS = (5, 2, 1)
FACTOR = 1.5
MOST = 2
#: Inclusion probabilities and weights are counted in whole units, so that sums are exact.
UNIT = 1_000_000_000
WEIGHT_UNIT = 1_000_000
_SPACE = " \t\n\x0b\f\r"
_RESULTS = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """How many runs without space or control white space a text has; null has none."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(_SPACE))), F.lit(0)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 that depends on the parts only."""
    written = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    digits = F.conv(F.substring(F.md5(written), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / float(1 << 52)


#: Four classes to each doubling: sizes in a class differ by a quarter at most.
_CLASS = """if(size > 0, 4 * (length(bin(size)) - 1)
            + cast((size * 4) div shiftleft(1L, length(bin(size)) - 1) as int) - 4, -1)"""


def targets(sources: DataFrame, weights=WEIGHTS, factor: float = FACTOR, most: int = MOST) -> DataFrame:
    """(source, source_size) with each source's weight and target."""
    placed = ranked(sources, [], [F.col("source").isNull(), "source"], "sources")
    of_place = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = stored(placed.select("source", "source_size", of_place.cast("long").alias("weight")), "weighed")
    level, stopped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("source_size") * most < F.lit(level) * F.col("weight")
        sums = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, F.col("source_size") * most)).alias("fixed"),
            F.sum(F.when(~above, F.col("weight"))).alias("free"),
            F.count(F.when(above, 1)).alias("stopped"),
        ).first()
        if not sums["free"] or sums["stopped"] == stopped:
            break
        stopped = sums["stopped"]
        level = (factor * sums["all"] - (sums["fixed"] or 0)) / sums["free"]
    share = F.lit(float(level or 0.0)) * F.col("weight")
    return weighed.withColumn("target", F.least(share, (F.col("source_size") * most).cast("double")))


def _levels(rows: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """Per source, the number of copies that a unit of weight stands for, so that the copies of
    all documents, at most `most` each, make up the target."""
    words = F.col("size").cast(T.DecimalType(20, 0))
    levels, before = None, None
    while True:
        if levels is None:
            full = F.lit(False)
            joined = rows
        else:
            known = levels.select(F.col("source").alias("of"), F.col("level"))
            joined = rows.join(known, F.col("source").eqNullSafe(F.col("of")))
            full = F.col("level") * F.col("weight") >= most
        sums = joined.groupBy("source").agg(
            F.sum(F.when(full, F.col("size"))).alias("fixed"),
            F.sum(F.when(~full, words * F.col("weight").cast(T.DecimalType(18, 0)))).cast("double").alias("free"),
            F.count(F.when(full, 1)).alias("full"),
        )
        wanted = goals.select(F.col("source").alias("of"), "target")
        found = stored(
            sums.join(wanted, F.col("source").eqNullSafe(F.col("of"))).select(
                "source",
                "full",
                F.when(F.col("free") > 0, (F.col("target") - most * F.coalesce("fixed", F.lit(0))) / F.col("free"))
                .otherwise(F.lit(float(most)))
                .alias("level"),
            ),
            "levels",
        )
        count = found.agg(F.sum("full")).first()[0]
        if levels is not None:
            discard(levels)
        levels = found
        if count == before:
            return levels.select("source", "level")
        before = count


def _sample_sizes(classes: DataFrame, seed: int) -> DataFrame:
    """(source, class, n): how many documents each class gives."""
    one = F.struct(
        F.col("class"), F.col("documents"), F.col("units"), F.col("words"),
        uniform(F.lit("class"), F.col("source"), F.col("class"), F.lit(seed)).alias("u"),
    )
    down = F.sort_array(F.collect_list(one), asc=False)

    def step(so_far: Column, c: Column) -> Column:
        mean = c["words"] / c["units"]
        due = c["words"] / F.lit(float(UNIT))
        n = F.least(c["documents"], F.greatest(F.lit(0).cast("long"), F.floor((due + so_far["owed"]) / mean + c["u"])))
        given = F.struct(c["class"].alias("class"), n.alias("n"))
        return F.struct(
            (so_far["owed"] + due - n * mean).alias("owed"), F.concat(so_far["given"], F.array(given)).alias("given")
        )

    start = F.struct(
        F.lit(0.0).alias("owed"), F.array().cast("array<struct<class:int,n:bigint>>").alias("given")
    )
    return (
        classes.groupBy("source")
        .agg(down.alias("down"))
        .select("source", F.explode(F.aggregate("down", start, step, lambda r: r["given"])).alias("c"))
        .select("source", F.col("c.class").alias("class"), F.col("c.n").alias("n"))
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    factor: float = FACTOR,
    most: int = MOST,
    seed: int = 0,
    weight_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_text: bool = False,
) -> DataFrame:
    """docs with size (words), source_size, target (words, of the source), copies and taken (words).

    Texts are left out unless with_text says otherwise, as rows move."""
    kept = [c for c in docs.columns if c not in _RESULTS and (with_text or c != text_col)]
    text = F.col(f"`{text_col}`")
    weight = F.lit(1).cast("long")
    if weight_col:
        given = F.col(f"`{weight_col}`").cast("double")
        usable = (given > 0) & ~F.isnan(given) & (given < float("inf"))
        weight = F.when(usable, F.round(given * WEIGHT_UNIT).cast("long")).otherwise(F.lit(0))
    rows = stored(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            word_count(text).alias("size"),
            uniform(F.lit("row"), F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.md5(text), F.lit(seed)).alias("u"),
            weight.alias("weight"),
        ),
        "sizes",
    )
    goals = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, factor, most), "targets")
    source = F.col("source").eqNullSafe(F.col("of"))
    wanted = goals.select(F.col("source").alias("of"), "source_size", "target")
    joined = rows.join(wanted, source)
    if weight_col:
        levels = _levels(rows, goals, most).select(F.col("source").alias("of"), "level")
        joined = joined.drop("of").join(levels, source)
        expected = F.least(F.lit(float(most)), F.col("level") * F.col("weight"))
    else:
        expected = F.col("target") / F.col("source_size")
    expected = F.when(F.col("size") > 0, expected).otherwise(F.lit(0.0))
    counted = (
        joined.drop("of")
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("units", F.floor((F.col("expected") - F.col("whole")) * UNIT))
        .withColumn("class", F.expr(_CLASS))
    )
    p = F.col("units") / F.lit(float(UNIT))
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    drawn = stored(
        counted.withColumn("order", F.when(F.col("units") > 0, odds).otherwise(F.lit(float("inf")))).drop("u", "weight", "expected"),
        "odds",
    )
    discard(rows)
    narrow = F.col("units").cast(T.DecimalType(20, 0))
    classes = (
        drawn.where("units > 0")
        .groupBy("source", "class")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.sum(narrow).cast("double").alias("units"),
            F.sum(narrow * F.col("size").cast(T.DecimalType(18, 0))).cast("double").alias("words"),
        )
    )
    sizes = stored(_sample_sizes(classes, seed), "sample").select(
        F.col("source").alias("of"), F.col("class").alias("of_class"), "n"
    )
    places = ranked(drawn, ["source", "class"], ["order", "size"], "drawn")
    copies = (F.col("whole") + F.when(F.col("place") < F.col("n"), 1).otherwise(0)).cast("long")
    result = places.join(sizes, source & (F.col("class") == F.col("of_class")), "left").withColumn("copies", copies)
    return result.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept],
        "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it has copies, numbered from 1 in `copy`."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, cast(copies as int))")))
