"""URL filters: host and path rules first, gradient-boosted trees for all other URLs.

The trees see lexical features only: lengths, depth, digit ratio, entropy,
parameter counts and the share of bad pages on other hosts of the suffix. Labels
come with the URLs, or from what the pages hold: a page that is strewn with
symbols marks its URL as bad. No word of the URL labels anything.

Suffix statistics count every labelled URL outside the held-out hosts, each host
once; the trees are fitted on a bounded sample of these. A fifth of all hosts is
held out, so that accuracy is told on hosts never seen.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import UPPER, LOWER, join_hot, let, stash, table

#: (verdict, rule): a rule is a host suffix and a path prefix.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: Rows of the sample that the trees are fitted on, about; everything else covers all rows.
TRAIN_ROWS = 20_000
#: A page that, scripts and styles aside, has a greater share of SYMBOLS is bad. None of them belongs to markup.
NOISE, SYMBOLS = 0.03, "$%*+@^|~"
#: Hosts that a suffix has besides its own, all of the average rate.
PRIOR = 5.0
FEATURES = ["f_url_len", "f_host_len", "f_path_len", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_longest_label", "f_suffix"]


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds url_host and url_path: after the first ://; without it, or for null, both are empty."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    return df.withColumns({"url_host": F.translate(host, UPPER, LOWER), "url_path": path})


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Of equal lengths the first in order wins.

    The rules are a setting, not data: they become one expression.
    """
    hit = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)[::-1]:
        at = rule.index("/") if "/" in rule else len(rule)
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        hit = F.when(fits, F.lit(rule)).otherwise(hit[0]), F.when(fits, F.lit(verdict)).otherwise(hit[1])
    return hit


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def lexical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the features but f_suffix; needs url_host and url_path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = F.col("url_host"), F.col("url_path")

    def spread(chars: Column) -> Column:
        """Entropy from the lengths of runs in the sorted characters: one pass."""
        part = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
        start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
        step = lambda a, c: F.when(a["c"] == c, F.struct(a["c"].alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(F.struct(c.alias("c"), F.lit(1.0).alias("n"), (a["s"] + part(a["n"])).alias("s")))
        n = F.greatest(F.size(chars), F.lit(1)).cast("double")
        return F.log2(n) - F.aggregate(F.array_sort(chars), start, step, lambda a: a["s"] + part(a["n"])) / n

    entropy = let(F.split(host, ""), spread)
    labels = F.split(host, r"\.")
    query = F.when(F.instr(url, "?") > 0, F.size(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"))).otherwise(0)
    return df.withColumns({
        "f_url_len": F.length(url).cast("double"),
        "f_host_len": F.length(host).cast("double"),
        "f_path_len": F.length(path).cast("double"),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "f_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "f_entropy": entropy,
        "f_params": query.cast("double"),
        "f_labels": F.size(labels).cast("double"),
        "f_hyphens": (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
        "f_longest_label": F.coalesce(F.array_max(F.transform(labels, lambda x: F.length(x))), F.lit(0)).cast("double"),
    })


def page_labels(pages: DataFrame) -> DataFrame:
    """(page_id, url, label) of pages (page_id, url, html): 1 if the page is strewn with symbols. Pages with nothing but scripts have a null label.

    A script or style lasts to the next end tag of either, or to the end of the
    page. The page is cut at these end tags, and each part at its first opening
    tag: two passes over the page, whatever it holds.
    """
    parts = F.split(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?i)</(?:script|style)\s*>")
    rest = F.array_join(F.transform(parts, lambda part: F.regexp_extract(part, r"(?is)^(.*?)(?:<(?:script|style)[\s>]|\z)", 1)), "")
    plain = F.length(F.translate("rest", SYMBOLS, ""))
    label = F.when(F.length("rest") > 0, ((F.length("rest") - plain) > NOISE * F.length("rest")).cast("int"))
    return pages.select("page_id", "url", rest.alias("rest")).select("page_id", "url", label.alias("label"))


def held_out(host: Column) -> Column:
    return F.pmod(F.crc32(host), F.lit(5)) == 0


class UrlModel:
    """Trees and suffix statistics. Without both labels outside the held-out hosts it allows everything."""

    def __init__(self, labelled: DataFrame, url_col: str = "url", *, rows: int = TRAIN_ROWS, rounds: int = 10, depth: int = 4, seed: int = 7, id_col: str = "page_id"):
        """labelled has url_col and label (0 good, 1 bad; null doesn't count); about ``rows`` of them, chosen by the hash of host, label and id_col (where there is one), fit the trees."""
        row = F.col(id_col).cast("string") if id_col in labelled.columns else F.lit(None).cast("string")
        self.labelled = stash(with_parts(labelled.filter("label IN (0, 1)").select(F.col(url_col).alias("url"), F.col("label").cast("int").alias("label"), row.alias("id"))).withColumn("held", held_out(F.col("url_host"))))
        known = self.labelled.filter("NOT held")
        self.hosts = stash(known.groupBy("url_host").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("own")))
        self.suffixes = stash(self.hosts.groupBy(suffix(F.col("url_host")).alias("suffix")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).cast("double").alias("hosts"), F.sum("own").alias("bad")))
        n, bad = known.agg(F.count(F.lit(1)), F.sum("label")).first()
        self.rate = (bad or 0) / n if n else 0.0
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="f_all", handleInvalid="keep")
        self.model = None
        if 0 < (bad or 0) < n:
            sample = self._featured(known.filter(chosen(F.xxhash64("url_host", "url", "label", "id"), rows / n))).select(*FEATURES, "label")
            sample = stash(self.assembler.transform(sample).select("f_all", F.col("label").cast("double").alias("label")))
            if sample.isEmpty():
                raise ValueError(f"none of {n} labelled URLs came into the sample")
            if sample.select("label").distinct().count() == 2:
                gbt = GBTClassifier(featuresCol="f_all", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, checkpointInterval=-1)
                self.model = gbt.fit(sample)

    def _featured(self, df: DataFrame, url_col: str = "url") -> DataFrame:
        """df with FEATURES; a host's own pages don't count for its suffix."""
        keyed = df.withColumn("suffix", suffix(F.col("url_host")))
        near = join_hot(keyed, self.suffixes.select("suffix", F.col("n").alias("s_n"), F.col("hosts").alias("s_hosts"), F.col("bad").alias("s_bad")), "suffix", "s_n")
        own = join_hot(near, self.hosts.select("url_host", F.col("n").alias("h_n"), F.col("own").alias("h_own")), "url_host", "h_n")
        others = F.coalesce("s_hosts", F.lit(0.0)) - F.when(F.col("h_own").isNotNull(), 1.0).otherwise(0.0)
        share = (F.coalesce("s_bad", F.lit(0.0)) - F.coalesce("h_own", F.lit(0.0)) + PRIOR * self.rate) / (others + PRIOR)
        return lexical(own.withColumn("f_suffix", share), url_col)

    def score(self, df: DataFrame, url_col: str = "url") -> DataFrame:
        """Adds url_bad, the probability of label 1; needs url_host and url_path."""
        if self.model is None:
            return df.withColumn("url_bad", F.lit(0.0))
        found = self.model.transform(self.assembler.transform(self._featured(df, url_col)))
        return found.select(*df.columns, vector_to_array("probability")[1].alias("url_bad"))

    def on_unseen_hosts(self, threshold: float = 0.5, bins: int = 1000) -> dict[str, float | None]:
        """Rows, bad ones, area under the curve, precision and recall over the labelled URLs of the held-out hosts."""
        scored = self.score(self.labelled.filter("held")).select("label", F.least(F.floor(F.col("url_bad") * bins), F.lit(bins - 1)).alias("bin"))
        counts = scored.groupBy("bin").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good")).collect()  # at most ``bins`` rows
        bad, good = sum(r.bad for r in counts), sum(r.good for r in counts)
        below = won = 0.0
        for r in sorted(counts, key=lambda r: r.bin):
            won += r.bad * (below + r.good / 2)
            below += r.good
        blocked = [r for r in counts if r.bin >= threshold * bins]
        hit, all_ = sum(r.bad for r in blocked), sum(r.bad + r.good for r in blocked)
        return {"rows": bad + good, "bad": bad, "auc": won / (bad * good) if bad and good else None, "precision": hit / all_ if all_ else None, "recall": hit / bad if bad else None}


def chosen(hash_: Column, share: float) -> Column:
    """A share of all rows, by a 64-bit hash; a share of 1 or more is all of them."""
    return F.lit(True) if share >= 1 else hash_.cast("double") < F.lit(share * 2.0**64 - 2.0**63)


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of pages (page_id, url). The rules go before the trees.

    A null URL and one without :// have empty hosts and paths and are judged by their
    other features; a long URL is judged whole. Repeated rows each have their row;
    other columns, whatever their names, are ignored; no rows in, no rows out.
    """
    found = model.score(with_parts(pages.select("page_id", "url")))
    rule, verdict = rule_of(F.col("url_host"), F.col("url_path"), RULES if rules is None else rules)
    own = F.when(F.col("url_bad") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.col("url_bad").alias("score"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, UrlModel(page_labels(pages))).select("page_id", "host", "path", "rule", "verdict")
