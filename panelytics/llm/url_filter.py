"""Judges URLs by allow and block rules, and where no rule fits by gradient-boosted trees on lexical features.

The rules label the URLs they fit, and all of those train Spark's boosted trees. Every URL is then judged in one pass
without a shuffle: rules are column expressions, suffix statistics come from a broadcast table. It counts every labelled URL;
a suffix is counted in the cell of its hash, of ``Settings.cells`` for each kind, so the table is bounded for any number of hosts.

Features: lengths of URL, host, path and query; depth of path and host; share of digits; entropy of the
characters; numbers of parameters, hyphens and percent escapes; https, fragment; and for the top-level label, the last two
labels, the first label and the first path segment the smoothed share of blocked URLs and the log count among those labelled.

Defined results: a URL that is null or has no ``://`` has an empty host and path, fits no rule and is judged by the
trees from those empty parts. If no URL is labelled with one of the verdicts there are no trees, and every URL without a rule
gets the other one (allow if there is none). Repeated rows are judged alike; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelytics.session import stage

SUFFIXES = ("top_label", "last_two", "first_label", "segment")


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow | block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Settings:
    cells: int = 1 << 16
    trees: int = 12
    depth: int = 4
    seed: int = 5


def rule(verdict: str, text: str) -> Rule:
    """``rule("block", "example.com/en/")``: host up to the first slash, then the start of the path."""
    host, slash, rest = text.partition("/")
    return Rule(verdict, host.lower(), slash + rest)


def _lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows; empty where the URL is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"^([^?#]*)", 1)
    return _lower_ascii(host), path, F.substring(after, F.length(path) + 1, F.length(after))


def matching_rule(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """``field`` of the longest rule that fits, null if none does; the first of equally long ones wins."""
    chain = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(getattr(r, field)))
        for r in sorted(rules, key=lambda r: -len(r.text))
    ]
    return F.coalesce(*chain) if chain else F.lit(None).cast("string")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits a character, of the distribution of characters."""
    chars = F.split(text, "")
    n = F.size(chars)
    of_char = F.transform(F.array_distinct(chars), lambda c: (n - F.size(F.array_remove(chars, c))) / n)
    return F.when(F.length(text) > 0, F.aggregate(of_char, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def with_features(urls: DataFrame, cells: int) -> tuple[DataFrame, list[str]]:
    """Adds the lexical features and the cells of the four suffixes to (url, host, path, rest)."""
    url, host, path, rest = (F.coalesce(c, F.lit("")) for c in ("url", "host", "path", "rest"))
    labels = F.split(host, r"\.")
    lexical = {
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "rest_length": F.length(rest).cast("double"),
        "path_depth": _count(path, "/"),
        "host_depth": _count(host, r"\."),
        "digit_share": _count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url),
        "parameters": _count(rest, "="),
        "hyphens": _count(host, "-"),
        "escapes": _count(url, "%"),
        "https": F.startswith(url, F.lit("https:")).cast("double"),
        "fragment": F.contains(rest, F.lit("#")).cast("double"),
    }
    suffixes = {
        "top_label": F.element_at(labels, -1),
        "last_two": F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), "."),
        "first_label": F.element_at(labels, 1),
        "segment": F.split_part(path, F.lit("/"), F.lit(2)),
    }
    suffixes = {kind: F.pmod(F.xxhash64(value), F.lit(cells)).cast("int") for kind, value in suffixes.items()}
    return urls.withColumns(lexical | suffixes), list(lexical)


def _with_statistics(df: DataFrame, statistics: DataFrame, share: Column) -> tuple[DataFrame, list[str]]:
    """Joins the broadcast statistics of each suffix; cells without a labelled URL get the share of all."""
    names = []
    for kind in SUFFIXES:
        own = statistics.where(F.col("kind") == kind).select(F.col("value").alias(kind), F.col("share").alias(f"{kind}_share"), F.col("seen").alias(f"{kind}_seen"))
        df = df.join(F.broadcast(own), kind, "left")
        df = df.withColumn(f"{kind}_share", F.coalesce(f"{kind}_share", share)).withColumn(f"{kind}_seen", F.coalesce(f"{kind}_seen", F.lit(0.0)))
        names += [f"{kind}_share", f"{kind}_seen"]
    return df, names


def judge(pages: DataFrame, rules: list[Rule], settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (null where a rule decides) for every row of ``pages``."""
    host, path, rest = parts(F.col("url"))
    judged = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"), rest.alias("rest"))
    judged = judged.withColumns({"rule": matching_rule(F.col("host"), F.col("path"), rules, "text"), "by_rule": matching_rule(F.col("host"), F.col("path"), rules, "verdict")})
    featured, lexical = with_features(judged, settings.cells)
    labelled = featured.where("by_rule IS NOT NULL").withColumn("label", (F.col("by_rule") == "block").cast("double"))
    # Read for the counts and for the trees, in other columns: written out once.
    chosen = stage(labelled.select("label", *lexical, *SUFFIXES), "url-labelled")
    n_labelled, blocked = chosen.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    output = ["page_id", "host", "path", "rule"]
    if not 0 < blocked < n_labelled:
        other = F.lit("block" if blocked else "allow")
        return judged.select(*output, F.coalesce("by_rule", other).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    overall = float(blocked / n_labelled)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in SUFFIXES]))
    statistics = chosen.select("label", kinds.alias("x")).groupBy(F.col("x.kind").alias("kind"), F.col("x.value").alias("value"))
    # Smoothing by twenty URLs of the overall share keeps rare suffixes near it.
    statistics = statistics.agg(((F.sum("label") + 20 * overall) / (F.count("*") + 20)).alias("share"), F.log1p(F.count("*").cast("double")).alias("seen"))
    statistics = stage(statistics, "url-suffixes")
    trainable, extra = _with_statistics(chosen, statistics, F.lit(overall))
    assemble = VectorAssembler(inputCols=lexical + extra, outputCol="features")
    model = GBTClassifier(maxIter=settings.trees, maxDepth=settings.depth, stepSize=0.3, seed=settings.seed).fit(assemble.transform(trainable).select("features", "label"))
    everything, _ = _with_statistics(featured, statistics, F.lit(overall))
    scored = model.transform(assemble.transform(everything))
    score = vector_to_array("probability")[1]
    by_trees = F.when(score >= 0.5, F.lit("block")).otherwise("allow")
    return scored.select(
        *output,
        F.coalesce("by_rule", by_trees).alias("verdict"),
        F.when(F.col("by_rule").isNull(), score).alias("block_score"),
    )
