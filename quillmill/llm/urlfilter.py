"""URL verdicts from fixed rules and from mined token combinations.

A URL is split into host and path as written. Fixed rules name a host and the
start of a path; the longest that fits decides. All other URLs are judged by
association rules, mined from pages with a label:

1. Tokens that fewer bad pages than the least support have, or that nearly all
   pages have, can't carry a rule and go. Of tokens that occur on exactly the
   same labelled pages, one stays (the first by name).
2. A token that is a rule by itself goes too, as what contains it says no more.
3. FP-growth finds the combinations of the remaining tokens that enough bad
   pages have; it only sees the bad pages. How many pages have a combination at
   all is counted on the distinct token sets of pages, through an index by the
   combination's rarest token.
4. A combination is a rule if its share of bad pages reaches the confidence and
   lies so far above the overall share that chance does not explain it (a
   z-score), and if no part of it is a rule.

Rules match through an inverted index. Each rule waits under one of its tokens
(its *anchor*, the rarest), so a URL only meets the rules of its own tokens.
Rules that fit a bound become one literal map and need no shuffle; more are
joined by anchor, with the rows of frequent anchors dealt over salts.

All of this is DataFrame code without Python workers. Null URLs and those
without ``://`` have an empty host and path, no tokens and are allowed.
Repeated rows are judged each, and count once each in mining; extra columns are
ignored. A page with several labels is bad if one of them says so. Pages
without a label, and labels without a page, teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """``text`` is the host followed by the start of the path, like ``example.net/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A to Z in lower case) and path, both empty without a ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fixed_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host suffixes, words of host labels, path words (digits as ``0``), query keys and the scheme."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.transform(F.split(host, r"[.\-]"), lambda w: F.concat(F.lit("label:"), w))
    words = F.transform(F.split(F.regexp_replace(F.lower(path), r"\d+", "0"), r"[^a-z0-9]+"), lambda w: F.concat(F.lit("path:"), w))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.concat(F.lit("key:"), F.regexp_extract(p, r"(?s)^[^=]*", 0)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*", 0)))
    all_tokens = F.array_distinct(F.concat(suffixes, parts, words, keys, scheme))
    kept = F.filter(all_tokens, lambda t: ~t.isin("host:", "label:", "path:", "key:", "scheme:"))
    return F.when(host != "", kept).otherwise(F.array().cast("array<string>"))


def parsed(pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id, url, host, path, tokens``."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")).withColumn("host", host).withColumn("path", path)
    return rows.withColumn("tokens", url_tokens(F.col("host"), F.col("path"), F.col("url")))


def _stands_out(bad: Column, n: Column, base: float, confidence: float, z: float) -> Column:
    """Whether ``bad`` of ``n`` pages reach the confidence and exceed the share ``base`` by ``z`` deviations."""
    return (bad >= confidence * n) & (bad - base * n >= z * F.sqrt(n * base * (1 - base)))


def mine_rules(rows: DataFrame, labels: DataFrame, *, support: float = 0.002, least: int = 10, confidence: float = 0.5, z: float = 4.0, usual: float = 0.9) -> DataFrame:
    """Blocking rules ``(rule_id, tokens, anchor, confidence, support)`` from pages with a label.

    ``labels`` has ``page_id`` and ``bad`` (boolean). A rule needs ``support``
    of the labelled pages, and ``least`` pages, to have its tokens and be bad.
    That bounds the tokens that can be in a rule by the tokens of a page
    divided by ``support``. Tokens of more than ``usual`` of the pages are in
    no rule.
    """
    spark = rows.sparkSession
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    found = written(rows.join(known, "page_id").where(F.size("tokens") > 0).select("page_id", "url", "tokens", "bad"), "labelled")
    totals = found.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, anchor string, confidence double, support double")
    n, base, floor = totals["n"], (totals["bad"] or 0) / max(1, totals["n"]), max(least, support * totals["n"])
    if totals["bad"] < floor or base == 1:
        return empty
    # the sets of pages are compared by their sizes and by sums and parities of 64-bit hashes
    page = F.xxhash64("page_id", "url")
    each = found.select(F.explode("tokens").alias("token"), "bad", page.alias("page"))
    sums = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), F.sum(F.col("page").cast("decimal(20,0)")).alias("total"), F.bit_xor("page").alias("parity"))
    fit = sums.where((F.col("b") >= floor) & (F.col("n") <= usual * n))
    tokens = written(fit.groupBy("n", "b", "total", "parity").agg(F.min("token").alias("token")).select("token", "n", "b"), "tokens")
    alone = _stands_out(F.col("b"), F.col("n"), base, confidence, z)
    single = tokens.where(alone).select(F.array("token").alias("tokens"), "b", "n", F.col("token").alias("anchor"))
    # bounded as the docstring says
    names = sorted(r["token"] for r in tokens.where(~alone).select("token").collect())
    rules = single
    if len(names) > 1:
        kept = F.array_sort(F.filter("tokens", lambda t: t.isin(names)))
        sets = written(found.select(kept.alias("kept"), "bad").where(F.size("kept") > 1).groupBy("kept").agg(F.count("*").alias("n"), F.count_if("bad").alias("b")), "token_sets")
        baskets = sets.where("b > 0").select(F.col("kept").alias("items"), F.explode(F.array_repeat(F.lit(1), F.col("b").cast("int"))).alias("one")).select("items")
        # the support is a share of the baskets, which leave out bad pages with fewer than two tokens
        some = baskets.count()
        if some >= floor:
            model = FPGrowth(itemsCol="items", minSupport=min(1.0, (floor - 0.5) / some), minConfidence=1.0).fit(baskets)
            rarity = tokens.select("token", "n")
            likely = written(model.freqItemsets.where((F.size("items") > 1) & (F.col("freq") >= floor)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("b")), "likely")
            anchored = likely.select("tokens", "b", F.explode("tokens").alias("token")).join(F.broadcast(rarity), "token").groupBy("tokens", "b").agg(F.min_by("token", F.struct("n", "token")).alias("anchor"))
            meets = sets.select("kept", F.col("n").alias("m"), F.explode("kept").alias("anchor")).join(anchored, "anchor").where(F.size(F.array_except("tokens", "kept")) == 0)
            counted = meets.groupBy("tokens", "b", "anchor").agg(F.sum("m").alias("n"))
            rules = rules.unionByName(_minimal(written(counted.where(_stands_out(F.col("b"), F.col("n"), base, confidence, z)), "rules")))
    return rules.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "anchor", (F.col("b") / F.col("n")).alias("confidence"), (F.col("b") / F.lit(n)).alias("support"))


def _minimal(rules: DataFrame) -> DataFrame:
    """Rules that contain no other; only those that share a token meet."""
    each = rules.select("tokens", F.explode("tokens").alias("token"))
    wider = each.alias("w").join(each.alias("n"), "token").where("size(w.tokens) > size(n.tokens)").groupBy(F.col("w.tokens").alias("tokens"), F.col("n.tokens").alias("inner")).count()
    return rules.join(wider.where("count = size(inner)").select("tokens").distinct(), "tokens", "left_anti")


def mined_hit(rows: DataFrame, rules: DataFrame, *, literal_rules: int = 2000, salts: int = 32) -> DataFrame:
    """``rows`` (with ``tokens``) plus ``mined``: whether a rule's tokens are all there."""
    some = rules.limit(literal_rules + 1).collect()
    if not some:
        return rows.withColumn("mined", F.lit(False))
    if len(some) <= literal_rules:
        index: dict[str, list[list[str]]] = {}
        for r in sorted(some):
            index.setdefault(r["anchor"], []).append(r["tokens"])
        pairs = [x for t, sets in index.items() for x in (F.lit(t), F.array(*(F.array(*map(F.lit, s)) for s in sets)))]
        lookup = F.create_map(*pairs)
        waiting = F.flatten(F.transform(F.filter("tokens", lambda t: t.isin(list(index))), lambda t: F.element_at(lookup, t)))
        return rows.withColumn("mined", F.exists(waiting, lambda s: F.size(F.array_except(s, F.col("tokens"))) == 0))
    asks = rows.where("url is not null").select("page_id", "url", "tokens", F.explode("tokens").alias("anchor")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)))
    waits = rules.select("anchor", F.col("tokens").alias("rule")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    hits = asks.join(waits, ["anchor", "salt"]).where(F.size(F.array_except("rule", "tokens")) == 0).select("page_id", "url").distinct()
    hits = hits.select(F.col("page_id").alias("__page"), F.col("url").alias("__url"), F.lit(True).alias("__hit"))
    same = F.col("page_id").eqNullSafe(F.col("__page")) & F.col("url").eqNullSafe(F.col("__url"))
    return rows.join(hits, same, "left").withColumn("mined", F.coalesce("__hit", F.lit(False))).drop("__page", "__url", "__hit")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], *, id_column: str = "page_id", url_column: str = "url", **mining) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row."""
    rows = parsed(pages, id_column, url_column)
    mined = mine_rules(rows, labels, **mining)
    judged = mined_hit(rows, mined).withColumn("rule", fixed_rule(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*(x for r in rules for x in (F.lit(r.text), F.lit(r.verdict))))
    own = F.when(F.col("mined"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce(F.element_at(verdicts, F.col("rule")), own).alias("verdict"))
