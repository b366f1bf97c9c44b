"""URL filters: rules first, and for what no rule fits gradient-boosted trees on lexical features.

The trees learn from the urls that rules label, on length, depth, digit ratio, entropy, number of parameters and what labelled urls
of the same host suffix are like.  Half of the labelled urls (by hash) give these statistics and the other half trains the trees, so no
url's own verdict is among its features.  The two verdicts weigh the same.  Everything runs as DataFrame expressions and Spark's own tree ensembles.

Cases: a url that is null or has no ``://`` has an empty host and path and fits no rule; where the labelled urls that
should train are all of one kind, or there are none, there is nothing to learn and the more frequent kind of labelled urls (else allow) is the verdict; repeated urls and
pages with a null identifier are judged each; of rules of one length that both fit, the last one counts; where the trees find both
verdicts as likely, it is allow; columns besides the identifier and the url take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import frequent, join_spread, staged

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Most different labelled urls that the trees learn from.
SAMPLE = 4000
TREES, LEVELS = 20, 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_suffix_seen", "f_suffix_blocked")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, by runs of the sorted characters."""
    n = F.length(text).cast("double")
    x_ln = lambda v: F.when(v > 1, v * F.log(v)).otherwise(0.0)
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("c"), F.when(a["c"] == c, a["run"] + 1.0).otherwise(1.0).alias("run"), F.when(a["c"] == c, a["sum"]).otherwise(a["sum"] + x_ln(a["run"])).alias("sum"))
    return F.when(n > 0, F.aggregate(F.array_sort(F.split(text, "")), start, step, lambda a: F.log(n) - (a["sum"] + x_ln(a["run"])) / n)).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features of one url."""
    n = F.length(url).cast("double")
    count = lambda text, pattern: F.length(F.regexp_replace(text, pattern, "")).cast("double")
    return {
        "f_length": n,
        "f_depth": count(path, "[^/]"),
        "f_digits": F.when(n > 0, count(url, "[^0-9]") / n).otherwise(0.0),
        "f_entropy": entropy(url),
        "f_params": F.when(url.contains("?"), count(F.regexp_extract(url, r"\?([^#]*)", 1), "[^&]") + 1).otherwise(0.0),
        "f_labels": F.when(host == "", 0.0).otherwise(count(host, "[^.]") + 1),
    }


def prepared(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, url, host, path, rule, said, suffix): said is the verdict of the rule that fits, suffix the host's last label."""
    base = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    base = base.select("id", "url", host.alias("host"), path.alias("path"))
    rule, said = matched(F.col("host"), F.col("path"), rules)
    return base.select("*", rule.alias("rule"), said.alias("said"), F.substring_index("host", ".", -1).alias("suffix"))


def _second_half() -> Column:
    return F.xxhash64("url") % 2 != 0


def suffix_statistics(base: DataFrame) -> DataFrame:
    """For each suffix its rows, those of the first half of urls that have a verdict of the rules (seen) and those of them that are blocked."""
    said = F.when(~_second_half(), F.col("said"))
    return base.groupBy("suffix").agg(F.count(F.lit(1)).alias("rows"), F.count(said).cast("double").alias("seen"), F.count(F.when(said == "block", 1)).cast("double").alias("blocked"))


def described(joined: DataFrame, *more: str | Column) -> DataFrame:
    """The features of urls that are joined to the statistics of their suffix, which have a prior of one row for each verdict."""
    seen, blocked = F.coalesce("seen", F.lit(0.0)), F.coalesce("blocked", F.lit(0.0))
    plain = features(F.col("url"), F.col("host"), F.col("path"))
    return joined.select(*more, *[c.alias(k) for k, c in plain.items()], F.log1p(seen).alias("f_suffix_seen"), ((blocked + 1) / (seen + 2)).alias("f_suffix_blocked"))


def learn(base: DataFrame, statistics: DataFrame, sample: int = SAMPLE):
    """Trees fitted on ``sample`` different labelled urls at most, those of the smallest hash, each with its rows as weight: copies do not crowd others out.
    None unless both verdicts occur among them."""
    from pyspark.ml.classification import GBTClassifier

    labelled = base.where(F.col("said").isNotNull() & _second_half()).groupBy("url", "host", "path", "suffix", "said").agg(F.count(F.lit(1)).cast("double").alias("n"), F.xxhash64("url").alias("h"))
    chosen = staged(labelled.orderBy("h", "url").limit(sample).join(statistics, "suffix", "left"), "labelled")
    size = {r["said"]: r["n"] for r in chosen.groupBy("said").agg(F.sum("n").alias("n")).collect()}  # two verdicts
    if len(size) < 2:
        return None
    weight = F.col("n") / F.when(F.col("said") == "block", size["block"]).otherwise(size["allow"]) * (sum(size.values()) / 2)
    train = described(chosen, "url", "h", weight.alias("weight"), (F.col("said") == "block").cast("double").alias("label"))
    train = _vector(train).coalesce(1).sortWithinPartitions("h", "url").select("features", "label", "weight").cache()
    model = GBTClassifier(weightCol="weight", maxIter=TREES, maxDepth=LEVELS, seed=1, maxBins=64).fit(train)
    train.unpersist()
    return model


def _vector(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def scored(df: DataFrame, model) -> DataFrame:
    """df with block_score, what the trees say of its features."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(_vector(df)).withColumn("block_score", vector_to_array("probability")[1])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", id_col: str = "page_id", sample: int = SAMPLE) -> DataFrame:
    """For each page: its identifier, host, path, the rule that fits (or null), verdict (allow or block) and block_score of the trees."""
    base = prepared(pages, rules, url, id_col)
    statistics = staged(suffix_statistics(base), "suffixes")
    model = learn(base, statistics, sample)
    if model is None:
        kinds = {r["said"]: r["n"] for r in base.where("said is not null").groupBy("said").agg(F.count(F.lit(1)).alias("n")).collect()}  # two at most
        other = max(sorted(kinds), key=kinds.get) if kinds else "allow"
        return base.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", F.lit(other)).alias("verdict"), F.lit(float(other == "block")).alias("block_score"))
    joined = join_spread(base, statistics.drop("rows"), "suffix", frequent(statistics, "suffix", "rows"))
    found = scored(described(joined, "id", "host", "path", "rule", "said", "url"), model)
    verdict = F.coalesce("said", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return found.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_score")


def allowed(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", id_col: str = "page_id") -> DataFrame:
    """The pages whose verdict is allow."""
    good = judge(pages, rules, url, id_col).where("verdict = 'allow'").select(F.col(id_col).alias("__lg_id")).distinct()
    return pages.join(good, pages[id_col].eqNullSafe(F.col("__lg_id")), "left_semi")
