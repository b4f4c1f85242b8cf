"""The library's own operators over the driver's tables, each beside the SQL that must agree.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame and ``ORACLES[name]`` is
DuckDB SQL for the same rows. Queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import textops
from ..functions.nulls import first_value, has_value
from ..operators import corpus, download, enrich, extract, resolve, search, topics
from .filterstack import FilterStack, Pattern, RegexFilter, TopicFilter, TopicRule, overview, status_name
from .storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.papers_from_documents(table(spark, sf_dir, "documents"))


TITLE = "trim(split_part(coalesce(text, ''), chr(10), 1))"
KEY = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\p{{M}}_]+', ' ', 'g'))"
# --- identifiers and texts


@query(f"""SELECT doc_id, {KEY.format(TITLE)} AS title_key, regexp_extract(text, '[0-9]{{4}}') AS first_year,
 'paper:' || sha1({TITLE} || '|' || cast(n_chars AS VARCHAR) || '|' || source) AS fallback_id FROM documents""")
def paper_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    title = F.trim(F.substring_index("text", "\n", 1))
    return docs.select("doc_id", ids.title_key(title).alias("title_key"), ids.first_year("text").alias("first_year"), ids.fallback_id(title, F.col("n_chars"), F.col("source"), F.lit("")).alias("fallback_id"))


@query("""SELECT page_id, lower(regexp_replace(trim(regexp_replace(regexp_replace(trim(raw), '^doi:', '', 'i'), '^https://doi\\.org/', '', 'i')), '\\.+$', '')) AS doi
 FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'doi:10.1000/P' || page_id || '..' WHEN 1 THEN ' https://doi.org/10.1000/P' || page_id WHEN 2 THEN 'DOI:https://doi.org/10.1000/' || page_id || '. ' ELSE '10.1000/p' || page_id END AS raw FROM pages)""")
def clean_doi_basic(spark, sf_dir):
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("doi:10.1000/P"), n, F.lit(".."))).when(kind == 1, F.concat(F.lit(" https://doi.org/10.1000/P"), n)).when(kind == 2, F.concat(F.lit("DOI:https://doi.org/10.1000/"), n, F.lit(". "))).otherwise(F.concat(F.lit("10.1000/p"), n))
    return table(spark, sf_dir, "pages").select("page_id", ids.match_doi(raw).alias("doi"))


@query("""SELECT doc_id, CASE WHEN lang = source THEN source ELSE source || ';' || coalesce(lang, '') END AS sources FROM documents""")
def source_merge(spark, sf_dir):
    parts = textops.merge_lists(F.concat_ws(" ; ", "source", "lang"), F.concat(F.lit(" "), F.col("source"), F.lit(";;")))
    return table(spark, sf_dir, "documents").select("doc_id", parts.alias("sources"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", textops.strip_tags("html").alias("plain"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y') AS first_year, cast(year(o_orderdate) AS INTEGER) AS publication_year,
 strftime(o_orderdate, '%Y-%m') AS month_text FROM orders""")
def date_rules(spark, sf_dir):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = ids.date_text(F.year("o_orderdate"), F.month("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ids.first_year(date).alias("first_year"), ids.publication_year(F.concat(F.lit("x 12024 y "), date)).alias("publication_year"), text.alias("month_text"))


@query("""SELECT doc_id, i AS chunk_no, substr(text, i * n + 1, n) AS chunk FROM (
 SELECT doc_id, text, cast(ceil(length(text) / cast(k AS DOUBLE)) AS BIGINT) AS n, unnest(range(k)) AS i FROM (
 SELECT doc_id, text, greatest(1, cast(ceil(greatest(1, ceil(length(text) / 3.0)) / 1000.0) AS BIGINT)) AS k FROM documents WHERE trim(text) <> ''))""")
def text_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("full_text"))
    return extract.chunk_plan(docs, limit=1500, prompt="").select("doc_id", F.posexplode("chunks").alias("chunk_no", "chunk"))


@query("""SELECT doc_id, cast(greatest(1, ceil(length(text) / 3.0)) AS INTEGER) AS n_tokens,
 round(least(1.0, greatest(0.05, 950.0 / greatest(1, ceil(length(text) / 3.0)))), 9) AS ratio FROM documents""")
def token_budgets(spark, sf_dir):
    tokens = textops.estimated_tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("n_tokens"), F.round(textops.compression_ratio(tokens, 1000), 9).alias("ratio"))


@query("""SELECT doc_id, len(list_distinct(string_split(lower(text), ' '))) AS words, text AS rebuilt FROM documents WHERE text IS NOT NULL""")
def rebuilt_abstracts(spark, sf_dir):
    # repeated blanks are empty words, which have places of their own
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    # positions by word, as an inverted index gives them, put back in order
    pairs = docs.select("doc_id", F.posexplode("w").alias("p", "word")).groupBy("doc_id", "word").agg(F.collect_list("p").alias("ps"))
    index = pairs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "ps"))).alias("index"), F.countDistinct(F.lower("word")).alias("words"))
    return index.select("doc_id", "words", textops.text_from_positions("index").alias("rebuilt"))


# --- corpus


@query("""SELECT sha256(text) AS sha256, 'blob:' || sha256(text) AS blob_id, cast(max(strlen(text)) AS BIGINT) AS original_size, count(*) AS papers, min(doc_id) AS first_doc
 FROM documents WHERE text IS NOT NULL GROUP BY text""")
def blob_dedup(spark, sf_dir):
    found = corpus.blob_summary(table(spark, sf_dir, "documents"), "text", "doc_id")
    return found.withColumnRenamed("first_doc_id", "first_doc")


@query("""SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS papers, (SELECT count(*) FROM conversations) AS assets,
 (SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'user') AS abstract_papers, (SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'assistant') AS text_papers,
 (SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'system') AS pdf_papers, count(*) AS blobs, cast(coalesce(sum(n), 0) AS BIGINT) AS original_bytes FROM (SELECT strlen(text) AS n FROM conversations WHERE text IS NOT NULL GROUP BY text)""")
def corpus_stats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    roles = F.create_map(*(F.lit(x) for x in ("user", "abstract", "assistant", "text", "system", "pdf")))
    assets = turns.select(F.col("conv_id").alias("paper_id"), F.element_at(roles, F.col("role")).alias("role"))
    stored = corpus.blobs(turns.select(F.col("text").alias("content"))).withColumn("stored_size", F.col("original_size"))
    return corpus.corpus_stats(assets, stored).select("papers", "assets", "abstract_papers", "text_papers", "pdf_papers", "blobs", F.col("original_bytes").cast("long").alias("original_bytes"))


@query("""SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) = 1""")
def latest_asset(spark, sf_dir):
    return corpus.latest_assets(table(spark, sf_dir, "conversations"), ("conv_id", "role"), ("turn", "text"))


@query("""SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('missing')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY ALL""")
def status_summary(spark, sf_dir):
    return corpus.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O", "P", "missing"))


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 AND (event_type IN ('click', 'view') OR (event_type = 'purchase' AND value < 50)) ORDER BY event_id LIMIT 100""")
def keyset_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ingest_seq"), "user_id", F.when(F.col("event_type") == "purchase", "succeeded").otherwise(F.col("event_type")).alias("enrichment_status"), F.when(F.col("value") < 50, "2020-01-01").otherwise("2030-01-01").alias("enriched_at"))
    found = corpus.enrichment_candidates(rows, ["click", "view"], after=100, limit=100, refreshed_before="2025-01-01")
    return found.select(F.col("ingest_seq").alias("event_id"), "user_id", F.when(F.col("enrichment_status") == "succeeded", "purchase").otherwise(F.col("enrichment_status")).alias("event_type"))


# --- filters

ENERGY = RegexFilter("energy", (Pattern("short", r" (?:the|der|les) "), Pattern("digits", "[0-9]{4}")), (Pattern("license", "license"),), ("title", "full_text"), include_mode="any")
MARKED = RegexFilter("marked", (Pattern("comma", ","), Pattern("and", " (?:and|und|et) ")), (), ("title",), include_mode="all")
RATED = RegexFilter("rated", (Pattern("good", "good"),), (), ("abstract",))
STACK = FilterStack().apply(ENERGY).apply(MARKED, "or").apply(RATED, "and")
_STATUS = f"""p AS (SELECT doc_id, {TITLE} AS title, coalesce(text, '') AS full_text, CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' ELSE '' END AS abstract
 FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
s AS (SELECT doc_id,
 CASE WHEN regexp_matches(title, 'license', 'i') OR regexp_matches(full_text, 'license', 'i') THEN false
  WHEN regexp_matches(title, ' (the|der|les) |[0-9]{{4}}', 'i') OR regexp_matches(full_text, ' (the|der|les) |[0-9]{{4}}', 'i') THEN true
  WHEN trim(title) = '' OR trim(full_text) = '' THEN null ELSE false END AS energy,
 CASE WHEN regexp_matches(title, ',') AND regexp_matches(title, ' (and|und|et) ', 'i') THEN true WHEN trim(title) = '' THEN null ELSE false END AS marked,
 CASE WHEN abstract = 'good' THEN true WHEN abstract = '' THEN null ELSE false END AS rated FROM p)"""
_NAMED = "CASE WHEN {0} THEN 'included' WHEN NOT {0} THEN 'excluded' ELSE 'unavailable' END"


def filter_input(spark, sf_dir) -> DataFrame:
    grades = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("paper_id")).agg(F.max("quality").alias("q"))
    return papers(spark, sf_dir).join(grades, "paper_id", "left").withColumn("abstract", F.when(F.col("q") == 1, "good").when(F.col("q") == 0, "poor").otherwise(""))


@query(f"WITH {_STATUS} SELECT doc_id, {_NAMED.format('energy')} AS status FROM s")
def regex_filter(spark, sf_dir):
    return papers(spark, sf_dir).select(F.col("ingest_seq").alias("doc_id"), status_name(ENERGY.status()).alias("status"))


@query(f"WITH {_STATUS} SELECT doc_id, {_NAMED.format('energy')} AS energy, {_NAMED.format('marked')} AS marked, {_NAMED.format('rated')} AS rated, {_NAMED.format('((energy OR marked) AND rated)')} AS final_status FROM s")
def filter_stack(spark, sf_dir):
    return STACK.evaluate(filter_input(spark, sf_dir)).select(F.col("ingest_seq").alias("doc_id"), "energy", "marked", "rated", "final_status")


@query(f"""WITH {_STATUS}, f AS (SELECT unnest(['energy', 'marked', 'rated', 'final_status']) AS filter, unnest([energy, marked, rated, (energy OR marked) AND rated]) AS v FROM s)
SELECT filter, count(*) FILTER (v) AS included, count(*) FILTER (NOT v) AS excluded, count(*) FILTER (v IS NULL) AS unavailable FROM f GROUP BY filter""")
def filter_overview(spark, sf_dir):
    return overview(STACK.evaluate(filter_input(spark, sf_dir)), ["energy", "marked", "rated"])


@query(f"""SELECT doc_id, least(len(regexp_extract_all(lower({TITLE}), ' (the|der|les) ')), 1000) AS short__title, least(len(regexp_extract_all(lower(coalesce(text, '')), ' (the|der|les) ')), 1000) AS short__full_text,
 least(len(regexp_extract_all({TITLE}, '[0-9]{{4}}')), 1000) AS digits__title, least(len(regexp_extract_all(coalesce(text, ''), '[0-9]{{4}}')), 1000) AS digits__full_text,
 least(len(regexp_extract_all(lower({TITLE}), 'license')), 1000) AS license__title, least(len(regexp_extract_all(lower(coalesce(text, '')), 'license')), 1000) AS license__full_text FROM documents""")
def match_rules_counts(spark, sf_dir):
    return papers(spark, sf_dir).select(F.col("ingest_seq").alias("doc_id"), *ENERGY.counts())


SEARCH = search.Query.parse('the "of the" category:src0')


@query(r"""SELECT doc_id FROM documents WHERE lower(source) = 'src0' AND regexp_matches(' ' || regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}\p{M}_]the', 'i') AND regexp_matches(' ' || regexp_replace(text, '\s+', ' ', 'g'), '[^\p{L}\p{N}\p{M}_]of the', 'i')""")
def query_matches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(SEARCH.in_scope(F.lit(""), F.col("source")) & SEARCH.matches("text")).select("doc_id")


@query(f"""SELECT doc_id, {TITLE} AS title FROM documents ORDER BY lower({TITLE}), doc_id LIMIT 50""")
def select_papers(spark, sf_dir):
    rows = papers(spark, sf_dir).select("ingest_seq", "title", "paper_id")
    return search.select_papers(rows, "title", 50).select(F.col("ingest_seq").alias("doc_id"), "title")


# --- entities


@query(f"""WITH k AS (SELECT doc_id, {KEY.format(TITLE)} || '|' || lang AS key FROM documents WHERE {KEY.format(TITLE)} <> '' AND lang IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS first_doc FROM k""")
def resolve_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    title = F.trim(F.substring_index("text", "\n", 1))
    years = F.create_map(*(x for i, lang in enumerate(("de", "en", "es", "fr")) for x in (F.lit(lang), F.lit(str(2000 + i)))))
    rows = docs.select(F.col("doc_id").alias("ingest_seq"), title.alias("title"), F.element_at(years, F.col("lang")).alias("publication_date"))
    rows = rows.where((ids.title_key("title") != "") & F.col("publication_date").isNotNull())
    return resolve.first_match(rows, rows).select(F.col("incoming_id").alias("doc_id"), F.col("stored_id").alias("first_doc"))


@query(f"""WITH d AS (SELECT doc_id, {TITLE} AS title, text, source, lang FROM documents), k AS (SELECT *, {KEY.format('title')} AS t FROM d),
e AS (SELECT *, CASE WHEN t <> '' AND lang IS NOT NULL THEN min(doc_id) OVER (PARTITION BY t, lang) ELSE doc_id END AS entity FROM k),
s AS (SELECT entity, source, min(doc_id) AS first FROM e GROUP BY entity, source)
SELECT e.entity, count(*) AS merged_rows, arg_min(title, doc_id) AS title, any_value(x.sources) AS sources FROM e JOIN (SELECT entity, string_agg(source, ';' ORDER BY first) AS sources FROM s GROUP BY entity) x USING (entity) GROUP BY e.entity""")
def merge_entities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    years = F.create_map(*(x for i, lang in enumerate(("de", "en", "es", "fr")) for x in (F.lit(lang), F.lit(str(2000 + i)))))
    rows = docs.select(F.col("doc_id").alias("ingest_seq"), F.trim(F.substring_index("text", "\n", 1)).alias("title"), F.element_at(years, F.col("lang")).alias("publication_date"), F.col("source").alias("sources"))
    return resolve.merge_entities(resolve.resolve(rows)).select("entity", "merged_rows", "title", "sources")


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS event_type, arg_max(value, event_id) FILTER (value >= 10) AS value, strftime(min(ts), '%Y-%m-%d') AS publication_date FROM events GROUP BY user_id""")
def version_collapse(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("k"), F.col("event_id").alias("version"), F.col("event_id").alias("seq"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("event_type"), F.when(F.col("value") >= 10, F.col("value")).alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("publication_date"))
    found = resolve.latest_versions(rows, "k")
    return found.select(F.col("k").cast("long").alias("user_id"), "event_type", "value", "publication_date")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN coalesce(cast(c_custkey AS VARCHAR), '') ELSE '' END AS referenced_paper_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def reference_link(spark, sf_dir):
    """Every order cites a customer; one customer in three is known by its DOI, the others have none."""
    doi = lambda c: F.concat(F.lit("10.1000/c"), F.col(c).cast("string"))
    refs = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("https://doi.org/"), doi("o_custkey")).alias("referenced_doi"))
    own = F.when(F.col("c_custkey") % 3 == 0, F.upper(doi("c_custkey"))).otherwise("")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("paper_id"), F.col("c_custkey").alias("ingest_seq"), own.alias("doi"))
    return resolve.link_references(refs, known).select("o_orderkey", "referenced_paper_id")


@query("""SELECT p_partkey + k * 10000000 AS paper_id, CASE WHEN k = 0 OR (k = 1 AND p_partkey % 2 = 0) THEN p_brand ELSE p_name END AS title, CASE WHEN k = 0 AND p_partkey % 2 = 1 THEN NULL ELSE 'old' END AS created_at FROM part, range(2) r(k)""")
def upsert(spark, sf_dir):
    """All parts are stored and all come in: even ones under their own number again, odd ones under a new number."""
    part, odd = table(spark, sf_dir, "part"), F.col("p_partkey") % 2 == 1
    each = part.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("paper_id", F.col("p_partkey") + F.col("k") * 10_000_000)
    stored = each.where(~odd | (F.col("k") == 1)).select("paper_id", F.col("p_name").alias("title"), F.lit("old").alias("created_at"))
    return corpus.upsert_papers(stored, each.where(~odd | (F.col("k") == 0)).select("paper_id", F.col("p_brand").alias("title")))


@query("""SELECT l_orderkey, l_linenumber, tag FROM (SELECT l_orderkey, l_linenumber, 'old' AS tag FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber <= 2) UNION ALL SELECT l_orderkey, l_linenumber, 'new' FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber <= 2)""")
def replace_children(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    added = rows.where("l_orderkey % 2 = 0 and l_linenumber <= 2").withColumn("tag", F.lit("new"))
    return resolve.replace_children(rows.withColumn("tag", F.lit("old")).join(added.select("l_orderkey").distinct(), "l_orderkey", "left_anti").unionByName(added.withColumn("tag", F.lit("stale"))), added, ("l_orderkey",))


# --- enrichment


@query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE ' ' END), ''), s_name, '') AS title, CASE WHEN s_suppkey IS NULL THEN 'partial' ELSE 'succeeded' END AS enrichment_status,
 CASE WHEN s_suppkey IS NULL THEN 'crossref' ELSE 'crossref;openalex' END AS enrichment_sources, cast(coalesce(s_acctbal > 0, false) AS INTEGER) AS is_oa FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def precedence_coalesce(spark, sf_dir):
    people = table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    crossref = people.select("key", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(" ").alias("title"))
    openalex = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("title"), (F.col("s_acctbal") > 0).alias("is_oa"))
    rows = enrich.assemble(people.select("c_custkey", "key"), {"crossref": crossref, "openalex": openalex}, {"crossref": "key", "openalex": "key"})
    return enrich.merge_fields(rows, ["crossref", "openalex"]).select("c_custkey", "title", "enrichment_status", "enrichment_sources", "is_oa")


@query(r"""SELECT page_id, i AS position, link, CASE WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'middle' END AS position_label FROM (
 SELECT page_id, len(links) AS n, unnest(links) AS link, unnest(range(1, len(links) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS links FROM pages))""")
def explode_children(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", links.alias("links"))
    each = rows.select("page_id", F.size("links").alias("n"), F.posexplode("links").alias("i", "link"))
    return each.select("page_id", (F.col("i") + 1).cast("long").alias("position"), "link", ids.position_label(F.col("i") + 1, F.col("n")).alias("position_label"))


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN text WHEN toxic = 1 THEN upper(source) ELSE NULL END AS content, CASE WHEN quality = 1 THEN 'openalex' WHEN toxic = 1 THEN 'pubmed' ELSE '' END AS picked,
 CASE WHEN quality = 1 OR toxic = 1 THEN 'succeeded' ELSE 'failed' END AS status FROM documents JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) WHERE trim(text) <> ''""")
def ordered_fallback(spark, sf_dir):
    grades = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, sf_dir, "documents").where(has_value("text")).join(grades, "doc_id")
    rows = rows.select("doc_id", F.when(F.col("quality") == 1, F.col("text")).alias("openalex_abstract"), F.when(F.col("toxic") == 1, F.upper("source")).otherwise(" ").alias("pubmed_abstract"))
    return download.pick_content(rows, "abstract", ["openalex", "pubmed"], key="doc_id").select("doc_id", "content", F.col("source").alias("picked"), "status")


# --- topics

_STOP = ", ".join(f"'{w}'" for w in sorted(topics.STOPWORDS))
_TOKENS = rf"""t AS (SELECT doc_id, lang, source, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: regexp_full_match(w, '[a-z][a-z0-9]+') AND NOT list_contains([{_STOP}], w)) AS tokens FROM documents)"""


def tokens(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", topics.features(F.lower("text"), bigrams=False).alias("tokens"))


@query(f"""WITH {_TOKENS}, u AS (SELECT doc_id, unnest(tokens) AS term FROM t), v AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM u GROUP BY term),
k AS (SELECT * FROM v WHERE df >= 2 AND df <= 0.95 * (SELECT count(*) FROM t WHERE len(tokens) > 0) ORDER BY tf DESC, term LIMIT 500)
SELECT term, tf, df, cast(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id FROM k""")
def vocab_topk(spark, sf_dir):
    return topics.vocabulary(tokens(spark, sf_dir), max_features=500, doc="doc_id")


@query(f"""WITH {_TOKENS}, c AS (SELECT len(tokens) AS n FROM t) SELECT count(*) AS documents_total, count(*) FILTER (n > 0) AS documents_usable, count(*) FILTER (n = 0) AS documents_empty,
 quantile_cont(n, 0.5) FILTER (n > 0) AS median_tokens FROM c""")
def corpus_assessment(spark, sf_dir):
    counted = tokens(spark, sf_dir).select(F.size("tokens").alias("token_count"))
    return topics.assess_corpus(counted, 4).select("documents_total", "documents_usable", "documents_empty", "median_tokens")


@query("""SELECT doc_id FROM documents ORDER BY substr(sha256(cast(doc_id AS VARCHAR)), 1, 16), doc_id LIMIT 100""")
def hash_sample(spark, sf_dir):
    return topics.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


_DIST = """d AS (SELECT vec_id, list_transform(embedding, lambda x: abs(cast(x AS DOUBLE))) AS a FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p FROM d)"""


def distributions(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x)
    rows = vectors.withColumn("total", total).select("vec_id", F.transform("a", lambda x: x / F.col("total")).alias("distribution"))
    return rows.withColumn("dominant_topic", topics.dominant(F.col("distribution"))).withColumn("prediction_status", F.lit("predicted"))


@query(f"WITH {_DIST} SELECT vec_id, cast(list_position(p, list_max(p)) - 1 AS INTEGER) AS dominant_topic, round(list_max(p), 9) AS probability FROM n")
def dominant_topic(spark, sf_dir):
    return distributions(spark, sf_dir).select("vec_id", "dominant_topic", F.round(F.array_max("distribution"), 9).alias("probability"))


@query(f"""WITH {_DIST}, l AS (SELECT vec_id, unnest(p) AS probability, unnest(range(64)) AS topic_id FROM n)
SELECT topic_id, rank, vec_id, round(probability, 9) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY probability DESC, vec_id) AS rank FROM l) WHERE rank <= 5""")
def representatives(spark, sf_dir):
    best = topics.representatives(topics.scores(distributions(spark, sf_dir), "vec_id"), 5, "vec_id")
    return best.select(F.col("topic_id").cast("long").alias("topic_id"), F.col("rank").cast("long").alias("rank"), "vec_id", F.round("probability", 9).alias("probability"))


@query(f"""WITH {_DIST}, c AS (SELECT list_position(p, list_max(p)) AS t, count(*) AS n FROM n GROUP BY 1)
SELECT CASE WHEN count(*) < 64 THEN 0 ELSE min(n) END AS smallest_topic, max(n) AS largest_topic, round(-sum(n / s * ln(n / s)) / ln(64), 6) AS balance FROM c, (SELECT sum(n) AS s FROM c) GROUP BY s""")
def topic_balance(spark, sf_dir):
    row = topics.balance(topics.scores(distributions(spark, sf_dir), "vec_id"), 64)
    return row.select("smallest_topic", "largest_topic", F.round("balance", 6).alias("balance"))


TOPIC_FILTER = TopicFilter("likely", "demo", (TopicRule("first", 0, 0.02), TopicRule("main", 3, None, True)), (TopicRule("not", 5, 0.03),))


@query(f"""WITH {_DIST} SELECT vec_id, CASE WHEN p[6] >= 0.03 THEN 'excluded' WHEN p[1] >= 0.02 OR list_position(p, list_max(p)) = 4 THEN 'included' ELSE 'excluded' END AS status FROM n""")
def topic_filter(spark, sf_dir):
    rows = topics.score_map(topics.scores(distributions(spark, sf_dir), "vec_id"), "vec_id")
    return rows.select("vec_id", status_name(TOPIC_FILTER.status()).alias("status"))


_WINDOWS = "w AS (SELECT cast(y AS INTEGER) AS window_start, cast(y + 4 AS INTEGER) AS window_end, y + 4 > 1998 AS is_partial FROM range(1992, 1999) r(y))"


@query(f"""WITH {_WINDOWS}, o AS (SELECT cast(year(o_orderdate) AS INTEGER) AS y, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS d, CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE 1 END AS ok FROM orders),
g AS (SELECT w.*, cast(t AS INTEGER) AS topic_id FROM w, range(3) r(t)), a AS (SELECT window_start, topic_id, count(y) AS papers_total, coalesce(sum(ok), 0) AS papers_predicted, sum(CASE WHEN ok = 1 THEN CASE WHEN d = topic_id THEN 0.5 ELSE 0.25 END ELSE 0 END) AS p, count(*) FILTER (ok = 1 AND d = topic_id) AS d
 FROM g LEFT JOIN o ON y BETWEEN window_start AND window_end GROUP BY ALL)
SELECT g.window_start, g.window_end, g.is_partial, g.topic_id, a.papers_total, cast(a.papers_predicted AS BIGINT) AS papers_predicted, CASE WHEN a.papers_predicted > 0 THEN round(a.p / a.papers_predicted, 9) END AS mean_probability, CASE WHEN a.papers_predicted > 0 THEN a.d END AS dominant_papers
 FROM g JOIN a USING (window_start, topic_id)""")
def trend_windows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    d = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    predicted = F.col("o_orderpriority") != "1-URGENT"
    dist = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda t: F.when(t == F.col("d"), 0.5).otherwise(0.25))
    rows = orders.select(F.year("o_orderdate").alias("year"), d.alias("d"), predicted.alias("ok")).select("year", F.when(F.col("ok"), dist).alias("distribution"), F.when(F.col("ok"), F.col("d")).alias("dominant_topic"))
    found = topics.trends(rows, 3, topics.year_windows(1992, 1998, 5, 1))
    return found.select("window_start", "window_end", "is_partial", "topic_id", "papers_total", "papers_predicted", F.round("mean_probability", 9).alias("mean_probability"), "dominant_papers")


@query(f"""WITH {_TOKENS}, u AS (SELECT source, lang, unnest(tokens) AS term FROM t), c AS (SELECT source, lang, term, count(*) AS n FROM u GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n DESC, term) AS k FROM c), a AS (SELECT source AS x, list(term) AS s FROM r WHERE k <= 20 AND lang = 'en' GROUP BY source), b AS (SELECT source AS y, list(term) AS s FROM r WHERE k <= 20 AND lang = 'de' GROUP BY source),
 j AS (SELECT x, y, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM a, b)
SELECT round(((SELECT avg(m) FROM (SELECT max(j) AS m FROM j GROUP BY x)) + (SELECT avg(m) FROM (SELECT max(j) AS m FROM j GROUP BY y))) / 2, 9) AS similarity""")
def topic_similarity(spark, sf_dir):
    counts = tokens(spark, sf_dir).where(F.col("lang").isin("en", "de")).select("source", "lang", F.explode("tokens").alias("term")).groupBy("source", "lang", "term").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("source", "lang").orderBy(F.desc("n"), "term"))
    top = counts.withColumn("k", k).where("k <= 20")
    sides = [top.where(F.col("lang") == lang).select(F.col("source").alias("topic_id"), "term") for lang in ("en", "de")]
    return topics.similarity(*sides).select(F.round("similarity", 9).alias("similarity"))


@query()
def lda_topics(spark, sf_dir):
    """Train, predict and list the scores; SQL can't express it, tests check its invariants.

    The vocabulary and the passes are the operators' defaults: 20,000 terms, 20 complete passes.
    """
    docs = written(tokens(spark, sf_dir).select("doc_id", "tokens"), "tokens")
    terms = [r["term"] for r in topics.vocabulary(docs, doc="doc_id").select("term").collect()]
    vectors = written(topics.vectorize(docs, terms).select("doc_id", "counts"), "vectors")  # read by every pass
    return topics.scores(topics.predict(topics.train_lda(vectors, 4, seed=1), vectors), "doc_id")


# --- extraction


@query("""SELECT event_id, len(json_keys(props)) AS fields FROM events WHERE json_valid(props)""")
def json_repair(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", textops.repair_json(F.concat(F.lit("Answer: "), "props", F.lit(" done."))).alias("r"))
    return events.where(F.size("r") > 0).select("event_id", F.size(F.json_object_keys(F.get("r", F.lit(0)))).cast("long").alias("fields"))


@query("""SELECT DISTINCT role, text FROM conversations""")
def store_dedup(spark, sf_dir):
    recipe = extract.Recipe("turns", "turn", "turns", "", ("role",), (extract.RecipeField("role", "Who speaks?", aliases=("speaker",)), extract.RecipeField("text", "What is said?")))
    turns = table(spark, sf_dir, "conversations")
    return extract.store_results(None, [turns.select("role", "text"), turns.select(F.col("role").alias("Speaker"), F.col("text").alias("What is said?"))], recipe)


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * 0.001, 9) AS ev, round(l_quantity + 273.15, 9) AS kelvin FROM lineitem""")
def unit_conversion(spark, sf_dir):
    value = F.concat(F.lit("about "), F.col("l_quantity").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(extract.convert_units(value, F.lit("meV"), "eV"), 9).alias("ev"), F.round(extract.convert_units(value, F.lit("C"), "K"), 9).alias("kelvin"))


@query("""SELECT doc_id, coalesce(nullif(trim(lang), ''), nullif(trim(source), ''), '') AS first_value FROM documents""")
def first_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", first_value("lang", "source").alias("first_value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers, through a stack of filters, to counts per filter."""
    return filter_overview(spark, sf_dir)


from . import records  # noqa: E402,F401  adds its queries
