import re
from itertools import combinations
from math import sqrt

import pytest
from pyspark.sql import functions as F

from quillmill.llm import queries

from quillmill.llm.urlfilter import Rule, judge_urls, mine_rules, mined_hit, parsed, split_url

RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = rest[: min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host) :]
    path = path[: min((path.index(c) for c in "?#" if c in path), default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = [None, "", "no scheme", "http://Example.NET/en/1", "https://a.example.net/de/1?x=/en/", "https://net", "https://net/", "https://xnet/", "http://example.com/de/", "http://example.com/de", "http://b.org/fr/x#y", "ftp://u:p@H.ORG:80/fr/", "http://x.com?q=://net/", "a://b://c/d", "http://ÄÖ.net/ß", "http:///path", "http://line\nbreak.net/a\nb?c"]


def test_split_and_rules(spark):
    rows = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)], "page_id long, url string, verdict int")
    host, path = split_url(F.col("url"))
    assert [tuple(r) for r in rows.select(host, path).collect()] == [plain_split(u) for u in URLS]
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    out = judge_urls(rows, labels, RULES).orderBy("page_id")
    for r, url in zip(out.collect(), URLS):
        host, path = plain_split(url)
        fit = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.text), default=None)
        assert (r["rule"], r["verdict"]) == ((best.text, best.verdict) if best else (None, "allow")), url
    nodes = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


def planted(spark):
    rows = [(i, f"http://{'spam' if i % 4 == 0 else 'good'}.site{i % 7}.io/{'buy' if i % 3 == 0 else 'read'}/{i}") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select("page_id", (F.col("url").contains("//spam.") & F.col("url").contains("/buy/")).alias("bad"))
    return pages, labels


def test_mined_combination(spark):
    pages, labels = planted(spark)
    rules = mine_rules(parsed(pages), labels.where("page_id % 2 = 0"), support=0.02, confidence=0.9)
    found = rules.collect()
    assert found and all(r["confidence"] >= 0.9 and r["anchor"] in r["tokens"] for r in found)
    sets = [frozenset(r["tokens"]) for r in found]
    assert not any(a < b for a in sets for b in sets)
    both = mined_hit(parsed(pages), rules).join(labels, "page_id")
    assert both.where("mined <> bad").count() == 0
    joined = mined_hit(parsed(pages), rules, literal_rules=0).join(labels, "page_id")
    assert joined.where("mined <> bad").count() == 0 and joined.count() == 600


def test_fixed_rules_go_first(spark):
    pages, labels = planted(spark)
    out = judge_urls(pages, labels, [Rule("allow", "site0.io/")], support=0.02, confidence=0.9).join(labels, "page_id")
    assert out.where("host like '%.site0.io' and verdict = 'block'").count() == 0
    assert out.where("host not like '%.site0.io' and bad and verdict = 'allow'").count() == 0


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(1, True), (None, True), (2, None)], "page_id long, bad boolean")
    assert judge_urls(pages, labels, RULES).count() == 0


def plain_tokens(url):
    host, path = plain_split(url)
    if not host:
        return frozenset()
    labels = host.split(".")
    out = {"host:" + ".".join(labels[i:]) for i in range(len(labels))} | {"label:" + w for w in re.split(r"[.\-]", host)}
    out |= {"path:" + w for w in re.split("[^a-z0-9]+", re.sub(r"\d+", "0", path.lower()))}
    query = re.search(r"(?s)\?([^#]*)", url)
    out |= {"key:" + p.split("=")[0] for p in (query.group(1) if query else "").split("&")}
    scheme = re.match("[A-Za-z][A-Za-z0-9+.-]*", url)
    out.add("scheme:" + (scheme.group() if scheme else ""))
    return frozenset(out - {"host:", "label:", "path:", "key:", "scheme:"})


def brute_rules(pages, labels, support=0.002, least=10, confidence=0.5, z=4.0, usual=0.9):
    """Every combination of tokens of a bad page, counted on all labelled pages."""
    bad = {}
    for i, b in labels:
        if i is not None and b is not None:
            bad[i] = bad.get(i, False) or b
    found = [(plain_tokens(u), bad[i]) for i, u in pages if i in bad and plain_tokens(u)]
    n, total = len(found), sum(b for _, b in found)
    floor, base = max(least, support * n), total / max(1, n)
    on = {}
    for k, (tokens, _) in enumerate(found):
        for t in tokens:
            on.setdefault(t, set()).add(k)
    first = {}
    for t in sorted(on):
        if sum(found[k][1] for k in on[t]) >= floor and len(on[t]) <= usual * n:
            first.setdefault(frozenset(on[t]), t)
    names, seen, rules = set(first.values()), set(), []
    for tokens, b in found:
        if b:
            some = sorted(tokens & names)
            seen |= {c for m in range(1, len(some) + 1) for c in combinations(some, m)}
    for c in sorted(seen, key=len):
        at = set.intersection(*(on[t] for t in c))
        b = sum(found[k][1] for k in at)
        if b >= floor and b >= confidence * len(at) and b - base * len(at) >= z * sqrt(len(at) * base * (1 - base)) and not any(r <= set(c) for r in rules):
            rules.append(set(c))
    return rules


def brute_verdicts(pages, rules):
    out = []
    for i, url in pages:
        host, path = plain_split(url)
        fit = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.text), default=None)
        tokens = plain_tokens(url)
        out.append((i, host, path, best.text if best else None, best.verdict if best else "block" if any(r <= tokens for r in rules) else "allow"))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_against_brute_force(spark, name):
    sf = f"/root/testdata/{name}"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    labels = [(r[0], r[1] == 0 or r[2] == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = sorted(map(tuple, queries.op5_url_filter(spark, sf).collect()), key=str)
    assert got == brute_verdicts(pages, brute_rules(pages, labels))


def messy(spark):
    """Bad pages behind combinations of two and three tokens, noise, repeats, nulls and a URL of 200,000 letters."""
    rows = []
    for i in range(900):
        host = ("spam" if i % 4 == 0 else "good") + f".site{i % 5}.com"
        rows.append((i, f"http{'s' * (i % 2)}://{host}/{('buy', 'read', 'win')[i % 3]}/{i}?{('id', 'ref')[i // 7 % 2]}=1"))
    rows += [rows[12], rows[12], (None, rows[3][1]), (901, None), (902, "no scheme"), (903, "http://long.com/" + "a" * 200_000)]
    labels = [(i, (i % 4 == 0 and i % 3 == 0) or (i % 3 == 2 and i % 2 == 1 and i // 7 % 2 == 1) or i % 17 == 0) for i in range(0, 910) if i % 5 != 4]
    labels += [(8, False), (8, True), (None, True), (5, None), (12345, True)]
    return rows, labels


def test_mining_against_brute_force(spark):
    rows, labels = messy(spark)
    pages = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "page_id long, url string, host string, tokens double")
    marked = spark.createDataFrame(labels, "page_id long, bad boolean")
    for options in ({}, {"confidence": 0.95}, {"support": 0.05, "z": 3.0}):
        rules = brute_rules(rows, labels, **options)
        assert any(len(r) == (3 if options.get("confidence") else 2) for r in rules)
        mined = mine_rules(parsed(pages), marked, **options).collect()
        assert sorted(r["tokens"] for r in mined) == sorted(sorted(r) for r in rules)
        got = sorted(map(tuple, judge_urls(pages, marked, RULES, **options).collect()), key=str)
        assert got == brute_verdicts(rows, rules)


def test_labels_of_one_kind(spark):
    pages, _ = planted(spark)
    for bad in (True, False):
        assert mine_rules(parsed(pages), pages.select("page_id", F.lit(bad).alias("bad"))).count() == 0
