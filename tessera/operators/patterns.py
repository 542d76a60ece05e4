"""Which of many plain patterns texts hold, by an inverted index of short runs of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of a run that is looked up, and the runs of all patterns that are sent to every executor at most.
RUN, MOST_RUNS = 4, 1_000_000


def sent(runs: DataFrame, most: int) -> DataFrame:
    """A broadcast of a table of runs that fails while it is made, if there are more than ``most``."""
    n = runs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return F.broadcast(n.where(F.when(F.col("_n") <= most, True).otherwise(F.raise_error(F.lit(f"more than {most} runs of patterns; look them up with few=False")).cast("boolean"))).drop("_n"))


def runs(text: Column, n: int = RUN) -> Column:
    """All runs of ``n`` characters of a text, one for each place."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1)


def held(texts: DataFrame, patterns: DataFrame, id_col: str = "id", text: str = "text", pattern: str = "pattern", few: bool = True) -> DataFrame:
    """(id, pattern): the distinct patterns that a text contains, as written; empty patterns are held by none.

    A pattern is cut into runs of RUN characters, the last one ending with it. Runs meet those of the texts in an equi-join, and a
    text holds the pattern where all its runs stand at their places from one start on. Work grows with texts and hits,
    not with texts times patterns, and no text is shuffled. Shorter patterns are looked up whole among runs of their length.
    ``few``: the patterns' runs are sent to the texts, up to MOST_RUNS of them; without it both are shuffled by run.
    """
    send = (lambda d: sent(d, MOST_RUNS)) if few else (lambda d: d.hint("merge"))
    p = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    last = F.length("pattern") - RUN
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(RUN)), F.array(last)))
    long = p.where(F.length("pattern") >= RUN).withColumns({"starts": starts}).select("pattern", F.size("starts").alias("n"), F.explode("starts").alias("at"))
    long = long.select("pattern", "n", "at", F.expr(f"substring(pattern, at + 1, {RUN})").alias("run"))
    t = texts.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    at = t.select("id", F.posexplode(runs(F.col("text"))).alias("pos", "run")).join(send(long), "run")
    whole = at.where("n = 1").select("id", "pattern").distinct()
    # the parts of a longer pattern meet at its start
    parts = at.where("n > 1").groupBy("id", "pattern", "n", (F.col("pos") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("c")).where("c = n").select("id", "pattern").distinct()
    short = p.where(F.length("pattern") < RUN).withColumn("run", F.col("pattern"))
    small = t.select("id", F.explode(F.array_distinct(F.concat(*[runs(F.col("text"), n) for n in range(1, RUN)]))).alias("run")).join(send(short), "run").select("id", "pattern")
    return whole.unionByName(parts).unionByName(small)
