"""URL filter: host and path rules, and gradient-boosted trees where none fits.

The trees see lexical features of a URL: lengths, depth, digit ratio, entropy of
its characters, parameter counts, hyphens and labels of the host, and two
suffix statistics (of the host's last label and of its last two): how often the
suffix occurs among labelled URLs and how many of those are bad.  In training
the statistics come from the other half of the labelled URLs, so that no URL's
own label is among its features.

Everything runs as DataFrame expressions.  A feature is cut at quantiles of the
labelled URLs; these are then counted by their cut values into cells.  A level
of a tree is one grouped sum of gradients over (node, feature, cut), at most
``2^depth x features x cuts`` rows of which reach the driver, which picks the
splits.  The finished trees are one CASE expression over the features; URLs are
read in one pass, and only the suffix statistics are joined to it: at most two
rows a labelled URL, of three numbers each, so they are broadcast.

Labels.  ``learn`` takes any (url, bad).  ``own_labels`` makes them from the
table itself, which holds none: a rule's verdict where one fits, and elsewhere
whether the host holds a word of ``SEEDS`` (positive seeds; the rest stands for
clean).  The fit is bounded: at most ``max_labelled`` distinct URLs, by hash.

Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased.  Path: from there
up to ``? #``.  A rule fits its host and subdomains if the path starts with the
rule's; the longest wins (of equals, the first in order of spelling).

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and is judged by its other features; without labels of both classes the
verdict is the only label's, allow if there is none; repeated rows stay; ids of
any type, nulls included, are passed on; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolake.llm.common import prepare, stored

# The rules (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SEEDS = ("adult", "ads", "bet", "bets", "casino", "phish", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "warez", "xxx")
MAX_LABELLED = 20_000
TREES, DEPTH, CUTS, RATE, SHRINK, LEAST = 12, 3, 16, 0.3, 1.0, 8.0  # LEAST: labelled URLs on each side of a split
PSEUDO = 4.0  # prior weight in a suffix's share of bad ones
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "query_length",
            "hyphens", "labels", "suffix_share", "suffix_count", "domain_share", "domain_count")
LEXICAL = FEATURES[:10]


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.locate("://", url)
    rest = F.when(after > 0, F.substring(url, after + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The spelling of the longest rule that fits, and its verdict (null if none does)."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]

    def first(values: list[str]) -> Column:
        return F.coalesce(*[F.when(c, F.lit(v)) for c, v in zip(fits, values)], F.lit(None).cast("string"))

    return first([h + p for _, h, p in ranked]), first([v for v, _, _ in ranked])


def entropy(text: Column) -> Column:
    """Entropy in bits of the characters of ``text``, from run lengths of its sorted characters."""
    def gain(run: Column) -> Column:
        return run * F.log2(F.greatest(run, F.lit(1.0)))

    def step(acc: Column, c: Column) -> Column:
        same = c == acc["last"]
        return F.struct(c.alias("last"), F.when(same, acc["run"] + 1.0).otherwise(F.lit(1.0)).alias("run"),
                        F.when(same, acc["total"]).otherwise(acc["total"] + gain(acc["run"])).alias("total"))

    chars = F.array_sort(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))
    n = F.length(text).cast("double")
    return F.aggregate(chars, start, step, lambda a: F.when(n > 0, F.log2(n) - (a["total"] + gain(a["run"])) / n).otherwise(0.0))


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("double")


def with_features(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, the lexical features and hashes of the host's suffixes."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host, path = host_and_path(url)
    parts = urls.withColumn("__url", url).withColumn("__host", host).withColumn("__path", path)
    url, host, path = F.col("__url"), F.col("__host"), F.col("__path")
    asked = F.substring_index(F.regexp_extract(url, r"(?s)\?.*", 0), "#", 1)
    size = F.length(url).cast("double")
    last = F.substring_index(host, ".", -1)
    facts = F.struct(
        size.alias("length"), F.length(host).cast("double").alias("host_length"), F.length(path).cast("double").alias("path_length"),
        _count_of(path, "/").alias("depth"), (_count_of(url, "0123456789") / F.greatest(size, F.lit(1.0))).alias("digit_ratio"),
        entropy(url).alias("entropy"), F.when(F.length(asked) > 1, _count_of(asked, "&") + 1).otherwise(0.0).alias("parameters"),
        F.length(asked).cast("double").alias("query_length"), _count_of(host, "-").alias("hyphens"),
        (_count_of(host, ".") + F.when(host == "", 0.0).otherwise(1.0)).alias("labels"))
    return parts.withColumn("__lexical", facts).withColumn("__suffix", F.xxhash64(last)).withColumn(
        "__domain", F.xxhash64(F.substring_index(host, ".", -2), F.lit(2)))


def own_labels(urls: DataFrame, rules: list[tuple[str, str, str]], seeds: tuple[str, ...] = SEEDS, url_col: str = "url",
               max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(url, bad) of at most ``max_labelled`` distinct URLs: a rule's verdict, elsewhere whether the host holds a seed."""
    known = urls.select(F.col(url_col).cast("string").alias("url")).filter("url IS NOT NULL")
    many = known.agg(F.approx_count_distinct("url")).first()[0]
    share = min(1.0, 2 * max_labelled / max(many, 1))
    by_hash = F.xxhash64("url", F.lit("labels"))
    some = known.filter(F.pmod(by_hash, F.lit(1_000_000)) < math.ceil(share * 1_000_000)).distinct()
    bounded = some.orderBy(by_hash, "url").limit(max_labelled)
    host, path = host_and_path(F.col("url"))
    _, verdict = longest_rule(host, path, rules)
    seeded = F.arrays_overlap(F.split(host, "[^a-z0-9]+"), F.array(*[F.lit(s) for s in seeds]))
    return bounded.select("url", F.coalesce(verdict == "block", seeded).alias("bad"))


@dataclass
class Split:
    feature: int
    cut: int  # rows whose value is at most the cut's go left
    left: Split | float = 0.0
    right: Split | float = 0.0


@dataclass
class Trees:
    prior: float  # share of bad URLs
    cuts: list[list[float]] = field(default_factory=list)
    trees: list[Split | float] = field(default_factory=list)
    suffixes: DataFrame | None = None  # key, n, bad

    def margin(self, values: list[Column], cut_of) -> Column:
        def expression(node: Split | float) -> Column:
            if not isinstance(node, Split):
                return F.lit(float(node))
            goes_left = values[node.feature] <= F.lit(cut_of(node))
            return F.when(goes_left, expression(node.left)).otherwise(expression(node.right))

        odds = math.log(self.prior / (1 - self.prior))
        return reduce(lambda total, tree: total + expression(tree), self.trees, F.lit(odds))

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` (of ``with_features``) with ``__score``, the probability of being bad."""
        if not self.trees:
            return urls.withColumn("__score", F.lit(float(self.prior)))
        table = F.broadcast(self.suffixes)  # at most two rows a labelled URL
        joined = urls
        for name in ("__suffix", "__domain"):
            side = table.select(F.col("key").alias(name), F.struct("n", "bad").alias(name + "_stat"))
            joined = joined.join(side, name, "left")
        stats = [_statistics(F.col(n + "_stat.n"), F.col(n + "_stat.bad"), self.prior) for n in ("__suffix", "__domain")]
        values = [F.col(f"__lexical.{f}") for f in LEXICAL] + [c for pair in stats for c in pair]
        margin = self.margin(values, lambda s: self.cuts[s.feature][s.cut])
        return joined.withColumn("__score", 1 / (1 + F.exp(-margin)))


def _statistics(n: Column, bad: Column, prior: float) -> tuple[Column, Column]:
    n, bad = F.coalesce(n, F.lit(0)).cast("double"), F.coalesce(bad, F.lit(0)).cast("double")
    return (bad + PSEUDO * prior) / (n + PSEUDO), F.log1p(n)


def _cells(labelled: DataFrame, prior: float) -> tuple[DataFrame, list[list[float]], DataFrame]:
    """Labelled URLs counted by their cut features; the cuts; the suffix statistics."""
    rows = stored(with_features(labelled).select(
        "bad", "__lexical", "__suffix", "__domain", F.pmod(F.xxhash64("__url", F.lit("half")), F.lit(2)).alias("half")), "labelled-urls")
    long = rows.select("bad", "half", F.explode(F.array("__suffix", "__domain")).alias("key"))
    halves = long.groupBy("key").agg(*[
        F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (
            ("n0", F.col("half") == 0), ("n1", F.col("half") == 1), ("b0", F.col("bad") & (F.col("half") == 0)), ("b1", F.col("bad") & (F.col("half") == 1)))])
    halves = stored(halves, "url-suffixes")
    joined = rows
    for name in ("__suffix", "__domain"):
        joined = joined.join(halves.select(F.col("key").alias(name), F.struct("n0", "n1", "b0", "b1").alias(name + "_stat")), name, "left")

    def other_half(name: str) -> tuple[Column, Column]:
        def pick(c: str) -> Column:
            return F.when(F.col("half") == 0, F.col(f"{name}_stat.{c}1")).otherwise(F.col(f"{name}_stat.{c}0"))

        return _statistics(pick("n"), pick("b"), prior)

    values = [F.col(f"__lexical.{f}") for f in LEXICAL] + [*other_half("__suffix"), *other_half("__domain")]
    table = stored(joined.select("bad", *[v.alias(f) for v, f in zip(values, FEATURES)]), "url-features")
    points = [i / CUTS for i in range(1, CUTS)]
    found = table.agg(*[F.percentile_approx(f, points).alias(f) for f in FEATURES]).first()
    cuts = [sorted(set(found[f])) for f in FEATURES]
    cut_values = [reduce(lambda a, c: a + (F.col(f) > F.lit(c)).cast("int"), own, F.lit(0)) for f, own in zip(FEATURES, cuts)]
    cells = table.select("bad", F.array(*cut_values).alias("cell")).groupBy("cell").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if("bad").cast("double").alias("bad"))
    statistics = halves.select("key", (F.col("n0") + F.col("n1")).alias("n"), (F.col("b0") + F.col("b1")).alias("bad"))
    return stored(cells, "url-cells"), cuts, statistics


def _best_split(sums: dict[tuple[int, int], tuple[float, float, float]], n_cuts: list[int]) -> tuple[float, int, int] | None:
    """(gain, feature, cut) from sums (gradient, curvature, rows) by (feature, cut value) of one node."""
    best = None
    for f, cuts in enumerate(n_cuts):
        column = [sums.get((f, v), (0.0, 0.0, 0.0)) for v in range(cuts + 1)]
        g_all, h_all, n_all = (sum(c[k] for c in column) for k in range(3))
        g = h = n = 0.0
        for cut in range(cuts):
            g, h, n = g + column[cut][0], h + column[cut][1], n + column[cut][2]
            if min(n, n_all - n) < LEAST:
                continue
            gain = g * g / (h + SHRINK) + (g_all - g) ** 2 / (h_all - h + SHRINK) - g_all * g_all / (h_all + SHRINK)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, cut)
    return best


def _grow(cells: DataFrame, model: Trees) -> Split | float:
    """One more tree, a grouped sum a level."""
    cell = [F.get("cell", F.lit(f)) for f in range(len(FEATURES))]
    p = 1 / (1 + F.exp(-model.margin(cell, lambda s: s.cut)))
    graded = cells.select("cell", "n", (F.col("n") * p - F.col("bad")).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
    n_cuts = [len(c) for c in model.cuts]
    root: list[Split | float] = [0.0]
    # open nodes: (the place that holds the node, the condition for its rows)
    nodes = [((root, 0), F.lit(True))]
    for level in range(DEPTH):
        which = F.coalesce(*[F.when(c, F.lit(i)) for i, (_, c) in enumerate(nodes)], F.lit(-1))
        sums = (graded.select(which.alias("node"), "n", "g", "h", F.posexplode("cell").alias("feature", "value"))
                .groupBy("node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect())
        per: dict[int, dict] = {}
        for r in sums:
            per.setdefault(r["node"], {})[(r["feature"], r["value"])] = (r["g"], r["h"], r["n"])
        following = []
        for i, ((holder, side), rows) in enumerate(nodes):
            best = _best_split(per.get(i, {}), n_cuts)
            if best is None:
                continue
            _, f, cut = best
            column = [(v, s) for (k, v), s in per[i].items() if k == f]
            leaf = [-RATE * sum(s[0] for v, s in column if goes(v)) / (sum(s[1] for v, s in column if goes(v)) + SHRINK)
                    for goes in (lambda v: v <= cut, lambda v: v > cut)]
            split = Split(f, cut, *leaf)
            _put(holder, side, split)
            following += [((split, "left"), rows & (cell[f] <= cut)), ((split, "right"), rows & (cell[f] > cut))]
        nodes = following
        if not nodes:
            break
    return root[0]


def _put(holder, side, split: Split) -> None:
    if isinstance(holder, list):
        holder[side] = split
    else:
        setattr(holder, side, split)


def learn(labelled: DataFrame, trees: int = TREES) -> Trees:
    """Fit to ``labelled`` (url, bad), whose size the caller bounds."""
    prepare(labelled.sparkSession)
    labelled = stored(labelled.filter("bad IS NOT NULL").select("url", "bad"), "url-labels")
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    prior = total["bad"] / total["n"] if total["n"] else 0.0
    if total["bad"] in (0, total["n"]):
        return Trees(prior)
    model = Trees(prior)
    cells, model.cuts, model.suffixes = _cells(labelled, prior)
    for _ in range(trees):
        tree = _grow(cells, model)
        if not isinstance(tree, Split):
            break
        model.trees.append(tree)
    return model


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: the id, host, path, rule, verdict (the rule's, else the trees'), score (of being bad)."""
    model = learn(own_labels(pages, rules, url_col=url_col) if labelled is None else labelled)
    read = model.score(with_features(pages.select(F.col(id_col), F.col(url_col).alias("__given")), "__given"))
    rule, verdict = longest_rule(F.col("__host"), F.col("__path"), rules)
    by_trees = F.when(F.col("__score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return read.select(id_col, F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"),
                       F.coalesce(verdict, by_trees).alias("verdict"), F.col("__score").alias("score"))
