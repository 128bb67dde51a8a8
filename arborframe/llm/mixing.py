"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

1. Targets. Sources share the requested total by weight; a share above `cap`
   times the source's words stops there and the excess goes to the others by
   weight (water filling, solved in closed form over the sorted ratios).
2. Expected copies. Within a source each length class c (bits of the word
   count) has the inclusion weight 32 - c, which falls slowly with length, so
   that very long documents repeat less; water filling again turns the weights
   into expected copies that give the target in words, none above max_copies.
3. Whole copies are certain. The fraction p that is left is the document's
   inclusion probability in a Pareto sample: it gets the rank
   (u / (1 - u)) / (p / (1 - p)), u a hash of its id and text, and documents
   are taken in rank order until the words left to take are met.
   A source's taken words so differ from its target by at most half of
   the last document.

The rank order of a hot source is cut into 4096 bins; sums of bins before a
row plus a running sum inside its bin give its place, so no task holds a
whole source. The sample is then a threshold on the rank per source, which is
joined back to the documents: their texts are never shuffled.

Defined cases: null text has no words; null source is a source, last in order;
texts without words and rows of a source without words get the copies of their
class and take nothing; very long texts are in the last classes and repeat
least; rows that repeat in id and text are ranked next to each other, in the
order of a hash of all their columns; an empty table gives an empty result;
columns of any name are kept, and a result that would clash with one of them
gets a trailing underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import any_names, cut, free_name, quoted

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(df: DataFrame, by: list[str], weight: str, cap: str, total: str, name: str) -> DataFrame:
    """Append the level x, per group, at which the sum of least(cap, weight * x) is total (or all are at their cap)."""
    ordered = Window.partitionBy(*by).orderBy(F.when(F.col(weight) > 0, F.col(cap) / F.col(weight)).otherwise(0.0), weight, cap).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    left = F.sum(weight).over(group) - F.coalesce(F.sum(weight).over(ordered), F.lit(0))
    level = (F.col(total) - F.coalesce(F.sum(cap).over(ordered), F.lit(0))) / F.when(left > 0, left)
    return df.withColumn("__level", level).withColumn(name, F.coalesce(F.max("__level").over(group), F.lit(0.0))).drop("__level")


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes: (source, source_size), one row per source. Adds target; the table of sources goes through one task."""
    one = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    all_ = sizes.withColumns(
        {
            "__w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")),
            "__cap": F.col("source_size") * F.lit(float(cap)),
            "__total": F.sum("source_size").over(one) * F.lit(float(share)),
            "__one": F.lit(0),
        }
    )
    level = water_level(all_, ["__one"], "__w", "__cap", "__total", "__x")
    return level.withColumn("target", F.least("__cap", F.col("__w") * F.col("__x"))).select("source", "source_size", "target")


def _with_keys(df: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    plain = [F.col(c) for c in sorted(df.columns) if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    # the table's own columns in one, so that none of them clashes with those used here
    keyed = df.select(F.struct(*df.columns).alias("__row"), F.xxhash64(*plain).alias("__all"), F.col(source).alias("__source"), words(F.col(text)).alias("__size"), digest.alias("__digest"))
    return keyed.withColumn("__class", F.when(F.col("__size") == 0, 0).otherwise(F.length(F.bin("__size"))))


def _rank(fraction: Column) -> Column:
    u = (F.conv(F.substring("__digest", 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    return F.when(fraction > 0, u / (1 - u) * ((1 - fraction) / fraction))


def plan_mix(keys: DataFrame, share: float, cap: float, max_copies: int) -> tuple[DataFrame, DataFrame]:
    """keys: (__source, __class, __size, __digest) of all documents, cheap to read repeatedly.

    Returns per (source, class) the expected copies, and per source the last
    rank that the sample takes.
    """
    classes = keys.groupBy("__source", "__class").agg(F.sum("__size").alias("__words"), F.count("*").alias("__rows"))
    sizes = classes.groupBy(F.col("__source").alias("source")).agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sizes, share, cap)
    per = classes.join(targets, classes["__source"].eqNullSafe(targets["source"])).withColumns(
        {"__w": F.greatest(F.lit(1), 32 - F.col("__class")) * F.col("__words").cast("double"), "__cap": F.col("__words") * F.lit(float(max_copies))}
    )
    per = water_level(per, ["source"], "__w", "__cap", "target", "__x")
    copies = F.least(F.lit(float(max_copies)), F.greatest(F.lit(1), 32 - F.col("__class")) * F.col("__x"))
    per = per.withColumn("__copies", copies).withColumns({"__whole": F.floor("__copies").cast("long")}).withColumn("__fraction", F.col("__copies") - F.col("__whole"))
    group = Window.partitionBy("source")
    per = per.withColumn("__rest", F.col("target") - F.sum(F.col("__whole") * F.col("__words")).over(group))
    per = cut(per.select("__source", "__class", "source_size", "target", "__whole", "__fraction", "__rest"))

    p = per.select(F.col("__source").alias("__s"), F.col("__class").alias("__c"), "__fraction", "__rest")
    ranked = keys.join(p, keys["__source"].eqNullSafe(p["__s"]) & (keys["__class"] == p["__c"])).withColumn("__rank", _rank(F.col("__fraction"))).filter("__rank is not null")
    ranked = ranked.withColumn("__bin", F.least(F.lit(BINS - 1), F.floor(F.lit(BINS) * (F.col("__rank") / (1 + F.col("__rank"))))).cast("int")).select(
        "__source", "__bin", "__rank", "__digest", "__size", "__rest"
    )
    bins = ranked.groupBy("__source", "__bin").agg(F.sum("__size").alias("__in"))
    before = Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("__source").alias("__s"), F.col("__bin").alias("__b"), F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__source", "__bin")
    run = inside.orderBy("__rank", "__digest").rowsBetween(Window.unboundedPreceding, 0)
    tie = Window.partitionBy("__source", "__bin", "__rank", "__digest")
    placed = ranked.withColumns({"__run": F.sum("__size").over(run), "__ties": F.count("*").over(tie), "__tie": F.row_number().over(tie.orderBy("__rank"))})
    taken = placed.join(bins, placed["__source"].eqNullSafe(bins["__s"]) & (placed["__bin"] == bins["__b"])).filter(
        F.col("__before") + F.col("__run") - F.col("__size") / 2 <= F.col("__rest")
    )
    cuts = taken.groupBy("__source").agg(F.max(F.struct("__rank", "__digest", "__tie", "__ties")).alias("__cut"))
    return per, cut(cuts.select(F.col("__source").alias("__cs"), "__cut.*").toDF("__cs", "__cut_rank", "__cut_digest", "__cut_tie", "__cut_ties"))


@any_names("key", "text", "source")
def mix(df: DataFrame, share: float = 1.5, cap: float = 2.0, max_copies: int = 2, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """All rows of df with size, source_size, target and copies (long, 0 and up)."""
    keyed = _with_keys(df, key, text, source, seed)
    per, cuts = plan_mix(cut(keyed.select("__source", "__class", "__size", "__digest")), share, cap, max_copies)
    own, size_, target, copies = (free_name(df.columns, n) for n in ("size", "source_size", "target", "copies"))
    p = per.select(F.col("__source").alias("__s"), F.col("__class").alias("__c"), F.col("source_size").alias(size_), F.col("target").alias(target), "__whole", "__fraction")
    out = keyed.join(p, keyed["__source"].eqNullSafe(p["__s"]) & (keyed["__class"] == p["__c"]), "left").withColumn("__rank", _rank(F.col("__fraction")))
    out = out.join(cuts, out["__source"].eqNullSafe(cuts["__cs"]), "left")
    mine, last = F.struct("__rank", "__digest"), F.struct(F.col("__cut_rank").alias("__rank"), F.col("__cut_digest").alias("__digest"))
    inside = F.col("__rank").isNotNull() & F.col("__cut_rank").isNotNull() & (mine <= last)
    if cuts.filter("__cut_tie < __cut_ties").isEmpty():
        out = out.withColumn("__more", F.when(inside, 1).otherwise(0))
    else:  # the cut falls between equal rows: number these, and only these
        tied = F.coalesce(inside & (mine == last), F.lit(False))
        equal = out.filter(tied).withColumn("__n", F.row_number().over(Window.partitionBy("__source", "__digest").orderBy("__rank", "__all")))
        out = out.filter(~tied).withColumn("__more", F.when(inside, 1).otherwise(0)).unionByName(equal.withColumn("__more", F.when(F.col("__n") <= F.col("__cut_tie"), 1).otherwise(0)).drop("__n"))
    out = out.withColumn(copies, F.col("__whole") + F.col("__more"))
    return out.select("__row.*", F.col("__size").alias(own), size_, target, copies)


def materialise(mixed: DataFrame, columns: list[str], copies: str = "copies") -> DataFrame:
    """Each row as many times as it has copies."""
    return mixed.withColumn(free_name(mixed.columns, "__i"), F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*quoted(columns))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS digest
  FROM documents),
d AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) END AS class FROM docs),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w,
       source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s0),
s2 AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0)) / nullif(sum(w) OVER () - coalesce(sum(w) OVER o, 0), 0) AS lv FROM s1
       WINDOW o AS (ORDER BY cap / w, w, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT source, source_size, least(cap, w * coalesce(max(lv) OVER (), 0)) AS target FROM s2),
c0 AS (SELECT source, class, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source, class),
c1 AS (SELECT c0.*, s.source_size, s.target, greatest(1, 32 - class) * n AS w, n * 2.0::DOUBLE AS cap FROM c0 JOIN s ON c0.source IS NOT DISTINCT FROM s.source),
c2 AS (SELECT *, (target - coalesce(sum(cap) OVER o, 0)) / nullif(sum(w) OVER (PARTITION BY source) - coalesce(sum(w) OVER o, 0), 0) AS lv FROM c1
       WINDOW o AS (PARTITION BY source ORDER BY CASE WHEN w > 0 THEN cap / w ELSE 0 END, w, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c3 AS (SELECT *, least(2.0::DOUBLE, greatest(1, 32 - class) * coalesce(max(lv) OVER (PARTITION BY source), 0)) AS copies FROM c2),
c AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS f, target - sum(floor(copies) * n) OVER (PARTITION BY source) AS rest FROM c3),
r0 AS (SELECT d.*, c.source_size, c.target, c.whole, c.f, c.rest, (CAST('0x' || substr(digest, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
       FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.class = c.class),
r1 AS (SELECT *, CASE WHEN f > 0 THEN u / (1 - u) * ((1 - f) / f) END AS rank FROM r0),
r AS (SELECT *, sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM r1)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN rank IS NOT NULL AND run - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
