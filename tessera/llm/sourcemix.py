"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

#: Keys fall into this many buckets of equal width, twice; only the bucket in which a budget ends is sorted.
BUCKETS = 1024


def text_size(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.5 to 1.5: by the share of symbol characters in the text. Null or empty: 0.5."""
    n = F.coalesce(F.length(text), F.lit(0))
    odd = n - F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.when(n > 0, 0.5 + F.greatest(F.lit(0.0), 1.0 - 10.0 * odd / n)).otherwise(0.5)


def uniform(doc_id: Column, seed: str) -> Column:
    """A number above 0 and below 1 from the id: 48 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float, share: float) -> DataFrame:
    """Targets of sources (source, source_size): by weight, at most ``most`` times the size, the excess reshared.

    Sources in order of limit / weight reach their limits first, so running sums give the common level directly.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("place", F.row_number().over(order)).withColumn("w", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", most * F.col("source_size"))
    before = Window.orderBy(F.col("most") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumns({
        "left_size": share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "left_w": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    })
    s = s.withColumn("level", F.col("left_size") / F.col("left_w"))
    free = F.when(F.col("most") / F.col("w") > F.col("level"), F.struct(F.col("most") / F.col("w"), F.col("place"), F.col("level")))
    s = s.withColumn("common", F.min(free).over(every)["level"])
    target = F.when(F.col("common").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("common") * F.col("w")))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of each row of ``docs`` (doc_id, source, text; the columns ``keep`` are passed on).

    A source's complete epochs come first; what its target leaves goes to documents in the order of their keys
    -ln(u) / weight, the last of them in part, so a source takes floor(target) words. A null source is a source of its
    own. Empty texts have size 0 and are taken 0 times. Equal rows have equal keys and share their place in any order
    (they are equal). Reruns agree: u comes from the id. Nothing of a source is gathered in one task but sums by key
    bucket and one bucket of a bucket.
    """
    d = stored(docs.select("doc_id", "source", *keep, text_size(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("quality")), "sizes")
    d = d.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("quality"))
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, share)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = stored(targets.withColumn("rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")), "targets")
    width = 1.0
    # below 1, so that it lies in the last bucket
    d = d.withColumn("at", F.least(1.0 - F.exp(-F.col("key")), F.lit(1.0 - 2.0**-40)))
    edge = targets.select(F.col("source").alias("s"), F.lit(0.0).alias("low"), F.col("rest").cast("long").alias("left"))
    for _ in range(2):
        inside, width = d.join(edge, d["source"].eqNullSafe(edge["s"])), width / BUCKETS
        bucket = F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor((F.col("at") - F.col("low")) / width)))
        inside = inside.where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("low") + width * BUCKETS))
        sums = inside.groupBy("s", "low", "left", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        run = F.sum("size").over(Window.partitionBy("s").orderBy("bucket"))
        cut = sums.withColumn("after", run).where((F.col("after") - F.col("size") <= F.col("left")) & (F.col("after") > F.col("left")))
        edge = stored(cut.select("s", (F.col("low") + F.col("bucket") * width).alias("low"), (F.col("left") - F.col("after") + F.col("size")).alias("left")), "edge")
    last = d.join(edge, d["source"].eqNullSafe(edge["s"])).where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("low") + width))
    before = F.sum("size").over(Window.partitionBy("s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(before, F.lit(0))))
    ends = edge.select(F.col("s").alias("es"), "low")
    rows = d.join(targets.withColumnRenamed("source", "ts"), d["source"].eqNullSafe(F.col("ts"))).join(ends, F.col("source").eqNullSafe(F.col("es")), "left")
    names = ["doc_id", *keep, "size", "source_size", "target", "epochs"]
    sure = F.when((F.col("rest") > 0) & (F.col("es").isNull() & F.col("low").isNull() | (F.col("at") < F.col("low"))), F.col("size")).otherwise(0)
    whole = rows.where(F.col("low").isNull() | (F.col("at") < F.col("low")) | (F.col("at") >= F.col("low") + width)).select(*names, (F.col("epochs") * F.col("size") + sure).cast("long").alias("taken"))
    cut = last.withColumn("part", part).join(targets.withColumnRenamed("source", "ts"), F.col("source").eqNullSafe(F.col("ts"))).select(*names, (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))
    return whole.unionByName(cut)


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """The mix itself: ``docs`` (doc_id, source, text and others) with each row as often as mix() takes it.

    The row in which a budget ends comes once more with its first words only, joined by spaces; ``n_chars``, where there
    is one, is counted again there. Rows that are not taken, such as those without words (null and empty texts), go. Other
    columns are passed on, whatever their names. Repeated rows are taken each. An empty table gives an empty result.
    """
    columns = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row_"))
    m = mix(packed, weights, most, share, seed, keep=("row_",)).where("taken > 0")
    m = m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    rest = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    words = F.regexp_extract_all("row_.text", F.lit(f"({WORD})"))
    text = F.when(rest >= F.col("size"), F.col("row_.text")).otherwise(F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " "))
    m = m.withColumns({"text_": text, "cut_": rest < F.col("size")})
    chars = lambda c: F.when(F.col("cut_"), F.length("text_").cast(docs.schema[c].dataType)).otherwise(F.col(f"row_.{c}"))
    return m.select(*[F.col("text_").alias(c) if c == "text" else chars(c).alias(c) if c == "n_chars" else F.col(f"row_.`{c}`").alias(c) for c in columns])
