"""URL filters: longest-match rules, and gradient-boosted trees on lexical features for the rest.

DataFrame and ML functions only. Features: lengths of url, host and path, their depths, ratio of
digits, entropy of the characters, number of parameters, hyphens, longest label of the host, and
statistics of the host's last label: the decade of its share of all urls, and in tenths how often it is labelled as
blocked. Both are coarse, so that they don't name single suffixes; the latter counts other folds' urls only for a url that
is learnt from, and where a suffix is labelled in one way only, which would repeat the rule that gave the labels, it is
the rate of all suffixes that are labelled both ways.
Both classes weigh alike in training. The trees learn from labelled urls; by default those are the table's own urls that a rule fits,
MAX_TRAIN distinct ones at most (those with the least hash, a documented bound): half of each class, or more
of one where the other has less. Suffix statistics count all labelled rows.

A rule is ``host/path``. It fits a url whose host is the rule's or a subdomain of it and whose path
starts with the rule's; of several the longest wins. The list of rules is a parameter that is
compiled into the plan, for lists of up to some thousands.

Defined results: null urls and those without ``://`` have an empty host and path, no rule, and the
trees' verdict; with labelled rows of one class only, or none, the verdict where no rule fits is
that class's, or allow; repeated rows give repeated rows; very long urls are read whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut

#: (verdict, rule)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
MAX_TRAIN, TREES, DEPTH, FOLDS = 10_000, 20, 3, 5
#: Partitions of the urls to learn from: they are few, and each tree level is a job over them.
TRAIN_PARTS = 4
_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#=&%+"
FEATURES = ["n_url", "n_host", "n_path", "host_depth", "path_depth", "digits", "entropy", "params", "hyphens", "longest_label", "suffix_share", "suffix_blocked"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    low = F.lower(url)
    counts = [count_of(low, c) for c in _CHARS]
    rest = F.length(low) - sum(counts[1:], counts[0])
    entropy = sum((F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for c in [*counts, rest]), F.lit(0.0))
    digits = sum((count_of(url, d) for d in "123456789"), count_of(url, "0"))
    return {
        "n_url": F.length(url), "n_host": F.length(host), "n_path": F.length(path), "host_depth": count_of(host, "."), "path_depth": count_of(path, "/"),
        "digits": digits / n, "entropy": entropy, "params": F.when(F.contains(url, F.lit("?")), count_of(url, "&") + 1).otherwise(0),
        "hyphens": count_of(host, "-"), "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
    }


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, *, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per page (page_id, host, path, rule, verdict, score): the rule's verdict, or the trees'.

    pages: page_id, url. labelled: url and verdict ('allow' or 'block') of urls to learn from.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def featured(df: DataFrame) -> DataFrame:
        host, path = parts(F.col("url"))
        df = df.withColumns({"host": host, "path": path})
        df = df.withColumns({k: v.cast("double") for k, v in lexical(F.col("url"), F.col("host"), F.col("path")).items()})
        return df.withColumns({"suffix": F.substring_index("host", ".", -1), "fold": F.pmod(F.xxhash64("url", F.lit(17)), F.lit(FOLDS))})

    given = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)]) if rules else F.lit(None).cast("map<string,string>")
    blocked = lambda verdict: F.when(verdict.isin("allow", "block"), (verdict == "block").cast("double"))
    rows = featured(pages.select(F.col("page_id").cast("long"), "url")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("label", blocked(given[F.col("rule")]))
    if labelled is None:
        known, told = rows.where("label is not null"), rows.select("suffix", "fold", "label", F.lit(1).alias("n"))
    else:
        known = featured(labelled.select("url", "verdict")).withColumn("label", blocked(F.col("verdict"))).where("label is not null")
        told = rows.select("suffix", "fold", F.lit(None).cast("double").alias("label"), F.lit(1).alias("n")).union(known.select("suffix", "fold", "label", F.lit(0).alias("n")))
    told = cut(told.groupBy("suffix", "fold").agg(F.sum("n").alias("n"), F.count("label").alias("known"), F.sum("label").alias("bad")))
    suffixes = told.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    mixed = F.when((F.col("bad") > 0) & (F.col("bad") < F.col("known")), F.lit(1))
    total, both, worse = suffixes.agg(F.sum("n"), F.sum(mixed * F.col("known")), F.sum(mixed * F.col("bad"))).first()
    usual = F.lit(round(worse / both, 1) if both else 0.5)

    def statistics(n: Column, known: Column, bad: Column) -> list[Column]:
        rate = F.when((bad > 0) & (bad < known), F.round((bad + 0.5) / (known + 1), 1)).otherwise(usual)
        return [F.when(n > 0, F.floor(F.log10(n / F.lit(float(total or 1))))).otherwise(-12).cast("double").alias("suffix_share"), rate.alias("suffix_blocked")]

    own = told.select("suffix", "fold", F.col("known").alias("k"), F.coalesce("bad", F.lit(0.0)).alias("b"))
    unseen = suffixes.join(own, "suffix").select("suffix", "fold", *statistics(F.col("n"), F.col("known") - F.col("k"), F.col("bad") - F.col("b")))
    suffixes = suffixes.select("suffix", *statistics(F.col("n"), F.col("known"), F.col("bad")))
    order = F.xxhash64("url", "label")
    distinct = known.select("url", "label").distinct()

    def least(df: DataFrame, label: float, n: int) -> DataFrame:
        return df.where(F.col("label") == label).orderBy(order, "url").limit(n)

    # max_train of each class are enough to tell how many of each to take
    picked = cut(least(distinct, 0.0, max_train).union(least(distinct, 1.0, max_train)))
    found = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    half, good, bad = max(1, max_train // 2), found.get(0.0, 0), found.get(1.0, 0)
    bad = min(bad, max(half, max_train - good))
    good = min(good, max(half, max_train - bad))
    classes = {label: n for label, n in ((0.0, good), (1.0, bad)) if n}
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = featured(least(picked, 0.0, good).union(least(picked, 1.0, bad))).join(unseen, ["suffix", "fold"])
    train = cut(assembler.transform(train).select("features", "label").coalesce(TRAIN_PARTS)) if len(classes) == 2 else picked
    train = train.withColumn("weight", F.when(F.col("label") == 1, 0.5 / classes.get(1.0, 1)).otherwise(0.5 / classes.get(0.0, 1)) * sum(classes.values()))
    rows = rows.join(suffixes, "suffix")
    if len(classes) == 2:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, weightCol="weight", seed=11).fit(train)
        rows = model.transform(assembler.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("score", F.lit(max(classes, default=0.0)))
    verdict = F.coalesce(given[F.col("rule")], F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
