"""Names within a few edits of a pattern, from an inverted index of trigrams.

An edit destroys at most ``Q`` trigrams, so a name within d edits keeps all but ``d * Q`` of a pattern's, and of
any ``d * Q + 1`` trigrams of the pattern at least one. Only the rarest that many are looked up, with places at
most d apart; so a trigram that all names share (a file type) is met only by patterns without
rarer ones. Candidates must pass the length filter and the count filter on all trigrams; then the edit
distance is computed. Patterns too short to keep a trigram are found by deletion: strings within d
edits become equal when at most d characters are taken out of each. Among many names even the rarest trigrams (three
digits of a number) are common, and candidates would grow with names times patterns: patterns of up to ``DELETED_CHARS``
characters that would meet more than ``MANY`` rows each are then found by deletion as well, once
all together would meet more than ``DELETED_ROWS`` rows a name. Strings that are left are compared by hash, before the distance.

Defined results: NULL patterns and names match nothing; the empty pattern matches names of at most d
characters; repeated names and patterns give repeated matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textvault.session import scratch_path

Q = 3
MANY = 1_000          # rows of the trigram index that a pattern may always meet
DELETED_CHARS = 40    # longest pattern found by deletion: about half the square of that many strings
DELETED_ROWS = 64     # rows of the index a name, from which deletion is the cheaper way


def trigrams(name: Column) -> Column:
    """array<struct<place, gram>> of a name."""
    last = F.length(name) - (Q - 1)
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.substring(name, i, F.lit(Q)).alias("gram")))


def _deletions(name: Column, edits: int) -> Column:
    """All strings that remain when at most ``edits`` characters are taken out."""
    out = F.array(name)
    for _ in range(edits):
        shorter = lambda s: F.transform(F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")),
                                        lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return out


def fuzzy_match(names: DataFrame, patterns: DataFrame, edits: int = 2, name_col: str = "filename", pattern_col: str = "pattern") -> DataFrame:
    """(pattern, name, distance) of all names within ``edits`` of a pattern. Each distinct string is compared once."""
    n = names.select(F.col(name_col).alias("name")).filter("name is not null")
    p = patterns.select(F.col(pattern_col).alias("pattern")).filter("pattern is not null")
    strings, asked = n.distinct(), p.distinct()
    near = F.abs(F.length("name") - F.length("pattern")) <= edits
    # long patterns: the rarest trigrams
    kept = F.size(F.array_distinct(F.transform(trigrams(F.col("pattern")), lambda g: g["gram"]))) - edits * Q
    long = asked.withColumn("least", kept)
    wanted = long.filter("least > 0").select("pattern", "least", F.inline(trigrams(F.col("pattern"))))
    index = strings.select("name", F.inline(trigrams(F.col("name"))).alias("at", "gram"))
    counts = index.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("met"))
    rarest = Window.partitionBy("pattern").orderBy("met", "gram", "place")
    looked = (wanted.join(counts, "gram", "left").fillna({"met": 0}).withColumn("r", F.row_number().over(rarest))
              .filter(F.col("r") <= edits * Q + 1).select("pattern", "least", "gram", "place", "met"))
    spark = names.sparkSession
    looked.write.parquet(path := scratch_path(spark, "fuzzy-trigrams"))
    looked = spark.read.schema(looked.schema).parquet(path)
    common = (looked.groupBy("pattern").agg(F.sum("met").alias("rows"))
              .filter((F.col("rows") > MANY) & (F.length("pattern") <= DELETED_CHARS)))
    rows, low, high = common.agg(F.sum("rows"), F.min(F.length("pattern")), F.max(F.length("pattern"))).first()
    deleted = rows is not None and rows > DELETED_ROWS * strings.filter(F.length("name").between(low - edits, high + edits)).count()
    if deleted:
        common = common.select("pattern")
        looked = looked.join(common, "pattern", "left_anti")
    some = (index.join(looked, "gram").filter((F.abs(F.col("at") - F.col("place")) <= edits) & near)
            .select("pattern", "name", "least").distinct())
    grams = lambda c: F.transform(trigrams(F.col(c)), lambda g: g["gram"])
    some = some.filter(F.size(F.array_intersect(grams("pattern"), grams("name"))) >= F.col("least")).select("pattern", "name")
    # short ones and those of common trigrams: deletions
    def by_deletion(asked: DataFrame, low: int, high: int) -> DataFrame:
        rest = lambda c: F.explode(F.transform(_deletions(F.col(c), edits), lambda s: F.xxhash64(s))).alias("rest")
        right = strings.filter(F.length("name").between(low - edits, high + edits)).select("name", rest("name"))
        return asked.select("pattern", rest("pattern")).join(right, "rest").filter(near).select("pattern", "name").distinct()

    short = long.filter("least <= 0").select("pattern")
    size = short.agg(F.max(F.length("pattern")).alias("n")).first()["n"]
    if size is not None:
        some = some.unionByName(by_deletion(short, 0, size))
    if deleted:
        some = some.unionByName(by_deletion(common, low, high))
    found = some.withColumn("distance", F.levenshtein("pattern", "name")).filter(F.col("distance") <= edits)
    return found.join(n, "name").join(p, "pattern").select("pattern", "name", F.col("distance").cast("bigint").alias("distance"))
