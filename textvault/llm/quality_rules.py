"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base rules (fixed): too few words, or too many words inside repeated five-word windows.

On top, each statistic of :data:`RULES` may reject a document above a cutoff. Cutoffs are
not guessed: for every rule, stratum (language) and candidate cutoff, the labelled good
documents are counted that it would reject. A cutoff is admitted only if an exact
binomial test excludes a false rejection rate of ``risk`` or more at level
``alpha / number of tests`` (Bonferroni over rules, strata and candidates), so with
probability ``1 - alpha`` *no* admitted cutoff rejects more than ``risk`` of the good
documents of its stratum. The most severe admitted cutoff of a rule and stratum is used; a
stratum without enough labels gets none and keeps its documents.

The text is split once; repeated windows are found by sorting a document's window hashes
with their places inside its row, so nothing shuffles but labels and counts. Counting
uses all labelled documents.

Defined results: null and empty text has no words and fails the base rule; a null language
is a stratum of its own; a document labelled several times counts by its majority, ties
are left out; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textvault.llm.shared import stored

# The characters that count as words' and symbols' (contract).
SPACE_SIGNS = " \t\n\x0b\x0c\r"
SYMBOL_SIGNS = "#*$%&|<>"

# Statistics that grow with junk, each a share between 0 and 1.
RULES = ["symbol_share", "repeat_share", "line_share", "upper_share"]
CANDIDATES = [i / 40 for i in range(40)]      # cutoffs tried for every rule
RISK, ALPHA = 0.02, 0.05
WINDOW = 5


def counted(text: Column, signs: str) -> Column:
    """How many of ``signs`` the text has."""
    return F.length(text) - F.length(F.translate(text, signs, ""))


def barrier(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns here, once: later expressions read them.

    Catalyst would otherwise write an array's expression into every place that uses
    it, also inside lambdas; a one-row generator keeps the projections apart (the outer
    form: for the other a filter on the array's size would be inferred and computed).
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*[F.col(n) for n in names]))))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every row's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", text.alias("t"))
    flat = F.translate("t", SPACE_SIGNS, " " * len(SPACE_SIGNS))
    d = d.withColumn("w", F.filter(F.split(flat, " "), lambda x: x != ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACE_SIGNS, "") != ""))
    d = d.select(
        "doc_id", "lang", "w",
        F.length(F.translate("t", SPACE_SIGNS, "")).cast("long").alias("word_chars"),
        counted(F.col("t"), SYMBOL_SIGNS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        counted(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"))
    d = barrier(d, "w").withColumn("n_words", F.size("w").cast("long"))
    # hashes of the windows: the words' hashes, shifted against each other and combined
    n = F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n", n)
    d = barrier(d, "h")
    shifted = [F.slice("h", k + 1, F.col("n")) for k in range(WINDOW)]
    zipped = F.arrays_zip(*[s.alias(f"s{k}") for k, s in enumerate(shifted)])
    d = d.withColumn("g", F.when(F.col("n") > 0, F.transform(zipped, lambda x: F.xxhash64(*[x[f"s{k}"] for k in range(WINDOW)])))
                     .otherwise(F.array().cast("array<bigint>"))).drop("h", "w")
    d = barrier(d, "g")
    d = d.withColumn("repeats", F.size("g") > F.size(F.array_distinct("g")))
    # places of windows that occur twice or more: neighbours in the order of (hash, place)
    placed = F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.col("repeats"), placed)).drop("g")
    d = barrier(d, "s")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("s.h", 1, F.size("s") - 1))
    after = F.concat(F.slice("s.h", 2, F.size("s") - 1), F.array(F.lit(None).cast("bigint")))
    both = F.arrays_zip(F.col("s.h").alias("h"), F.col("s.i").alias("i"), before.alias("b"), after.alias("a"))
    twice = F.transform(F.filter(both, lambda x: (x["h"] == x["b"]) | (x["h"] == x["a"])), lambda x: x["i"])
    d = d.withColumn("p", F.when(F.col("repeats"), F.sort_array(twice))).drop("s")
    d = barrier(d, "p")
    # words covered by windows at sorted places: five each, less what the next one covers
    gaps = F.zip_with(F.slice("p", 2, F.size("p") - 1), F.slice("p", 1, F.size("p") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)
    return d.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(0).cast("long")).drop("p", "repeats", "n")


def with_shares(m: DataFrame) -> DataFrame:
    """The statistics of the rules, and the base verdict."""
    share = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n)).otherwise(F.lit(0.0))
    return m.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"),
        "line_share": share("n_dup_lines", "n_lines"), "upper_share": share("n_upper", "word_chars"),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))})


def at_most(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p): from the largest term down, in logarithms.

    log of the first term by Stirling's series, the others by the ratio of neighbours. Below the mean
    the terms fall faster than exp(-i^2 / 2npq), so those after 10 sqrt(npq) + 50 add less than 1e-18 of the sum.
    """
    def log_factorial(x: Column) -> Column:
        big = x + 1e-300
        series = x * F.log(big) - x + 0.5 * F.log(2 * F.pi() * big) + 1 / (12 * big) - 1 / (360 * big ** 3) + 1 / (1260 * big ** 5)
        small = F.log(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))
        return F.when(x <= 20, small).otherwise(series)

    n, k = n.cast("double"), k.cast("double")
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    # term(i - 1) / term(i) = i (1 - p) / ((n - i + 1) p); below the mean the terms shrink
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    terms = F.least(k - 1, F.ceil(10 * F.sqrt(n * p * (1 - p))) + 50)
    walk = F.aggregate(F.sequence(F.lit(0), F.greatest(terms.cast("int"), F.lit(0))), start, lambda acc, j: F.struct(
        (acc["t"] * (k - j) * (1 - p) / ((n - (k - j) + 1) * p)).alias("t"),
        (acc["s"] + acc["t"] * (k - j) * (1 - p) / ((n - (k - j) + 1) * p)).alias("s")))
    return F.when(k >= n * p, F.lit(1.0)).when(k < 1, F.exp(n * F.log(F.lit(1 - p)))).otherwise(top * walk["s"])


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """(stratum, rule, cutoff): the most severe admitted cutoff of each rule and stratum.

    The counts are one row per stratum; the strata of all documents are tested.
    """
    one = (labels.select("doc_id", F.col("quality").cast("double").alias("q")).dropna()
           .groupBy("doc_id").agg(F.avg("q").alias("q")).filter("q > 0.5").select("doc_id"))
    # a document of the holdout that the base rule rejects is not this method's to reject
    good = stats.filter(~F.col("base_failed")).join(one, "doc_id", "left_semi")
    ladder = F.array(*[F.lit(c) for c in CANDIDATES])
    # per rule the number of candidates below the statistic: documents are counted once per step
    below = lambda rule: F.size(F.filter(ladder, lambda c: c < F.col(rule)))
    n = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    by = (good.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), below(r).alias("above")) for r in RULES])).alias("x"))
          .groupBy("stratum", "x.rule", "x.above").agg(F.count(F.lit(1)).alias("m")))
    tried = by.groupBy("stratum", "rule").agg(F.collect_list(F.struct("above", "m")).alias("hist"))
    tried = tried.join(n, "stratum").select("stratum", "rule", "n", "hist", F.posexplode(ladder).alias("step", "cutoff"))
    rejected = F.aggregate(F.filter("hist", lambda x: x["above"] > F.col("step")), F.lit(0).cast("long"), lambda s, x: s + x["m"])
    tried = tried.select("stratum", "rule", "n", "cutoff", rejected.alias("k"))
    strata = max(1, stats.select("stratum").distinct().count())
    level = alpha / (strata * len(RULES) * len(CANDIDATES))
    tested = tried.withColumn("p", at_most(F.col("n"), F.col("k"), risk))
    return tested.filter(F.col("p") <= level).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""
    stats = stored(with_shares(measured(docs)).withColumn("stratum", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))), "rule-statistics")
    limits = cutoffs(stats, labels, risk, alpha).groupBy("stratum").pivot("rule", RULES).agg(F.first("cutoff"))
    # a table, so that its size is known: small it is broadcast, and the strata (a few hot keys) don't shuffle
    limits = stored(limits.select("stratum", *[F.col(r).alias(f"max_{r}") for r in RULES]), "rule-limits")
    bad = F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return stats.join(limits, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~bad).alias("kept"))


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, doc_id, coalesce('=' || lang, '') AS stratum, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
        length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM m)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY rid),
c AS (SELECT m.rid, doc_id, stratum, len(w) AS n_words, word_chars, n_symbols, len(lines) AS n_lines, n_upper,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM m LEFT JOIN covered ON m.rid = covered.rid),
s AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_share,
        CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share,
        CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS line_share,
        CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars ELSE 0 END AS upper_share FROM c),
v AS (SELECT rid, doc_id, stratum, base_failed, unnest(['symbol_share', 'repeat_share', 'line_share', 'upper_share']) AS rule,
        unnest([symbol_share, repeat_share, line_share, upper_share]) AS x FROM s),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING avg(quality) > 0.5),
h AS (SELECT stratum, rule, (j::DOUBLE) / 40 AS cutoff, count(*) AS n, sum(CASE WHEN x > (j::DOUBLE) / 40 THEN 1 ELSE 0 END)::BIGINT AS k
      FROM v, range(0, 40) AS r(j) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
t AS (SELECT *, CASE WHEN k >= n * {RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1),
        lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) END AS p FROM h),
limits AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM t
      WHERE p <= {ALPHA} / ((SELECT count(DISTINCT stratum) FROM s) * 160) GROUP BY ALL),
bad AS (SELECT DISTINCT rid FROM v JOIN limits USING (stratum, rule) WHERE x > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM s
"""
