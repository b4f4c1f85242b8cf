"""More of the catalogue: provider records, child tables, enrichment, texts and stored state.

Records are built as providers write them, from the rows of whole tables, and
go through the same mappers and flows as recorded pages do. Importing this
module adds its queries to the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions import textops
from ..operators import children, corpus, enrich, search, topics
from ..sources import mappers
from .catalogue import ENERGY, STACK, _NAMED, _STATUS, TITLE, filter_input, papers, query, table, tokens
from .filterstack import gate, paper_content, status_name


def text(*parts: str | Column) -> Column:
    """Parts as one text: columns by name in braces, everything else as it is."""
    return F.concat(*(F.col(p[1:-1]).cast("string") if isinstance(p, str) and p.startswith("{") else F.lit(p) if isinstance(p, str) else p for p in parts))


# --- texts and identifiers


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN '10.1000/a/' || page_id WHEN 1 THEN '10.1000/(x' || page_id || ')' WHEN 2 THEN '10.1000/q-' || page_id WHEN 3 THEN '' ELSE '10.1000/b+' || page_id END AS doi FROM pages""")
def doi_cleaning(spark, sf_dir):
    kind = F.col("page_id") % 5
    raw = F.when(kind == 0, text("https://dx.doi.org/10.1000/A%2F", "{page_id}", "?x=1#y")).when(kind == 1, text("doi: 10.1000/(x", "{page_id}", ")).;")).when(kind == 2, text(" 10.1000/​Q–", "{page_id}", "”"))
    raw = raw.when(kind == 3, F.lit(None)).otherwise(text("HTTPS://DOI.ORG/10.1000/b+", "{page_id}", "&#62;"))
    return table(spark, sf_dir, "pages").select("page_id", textops.clean_doi(raw).alias("doi"))


@query("""SELECT doc_id, '10.1234/d' || doc_id || ' 10.5555/w' || doc_id || ' 10.1234/e(' || doc_id || ')' AS dois FROM documents""")
def doi_extraction(spark, sf_dir):
    raw = text(F.coalesce("text", F.lit("")), "\n10.5555/\n W", "{doc_id}", ", doi:10.1234/D", "{doc_id}", "; 10.1111/(ISSN)1234 (https://doi.org/10.1234/e%28", "{doc_id}", "%29?x) 10.12­\n34/d", "{doc_id}", ".")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(textops.extract_dois(raw), " ").alias("dois"))


@query(r"""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') || ' H2O "in" a-b...') AS plain FROM documents""")
def metadata_text(spark, sf_dir):
    raw = text(F.coalesce("text", F.lit("")), "\tH<sub>2</sub>O<i> &ldquo;in&rdquo;</i> a‐b…")
    return table(spark, sf_dir, "documents").select("doc_id", textops.normalize_metadata(raw).alias("plain"))


@query(r"""SELECT doc_id, regexp_replace(coalesce(text, ''), '\s+$', '') || chr(10) || 'References' || chr(10) || 'one' AS body FROM documents""")
def reference_trimming(spark, sf_dir):
    """Only the last heading cuts; the one before it, and the word within a line, stay."""
    raw = text(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+$", ""), "\nReferences\none\n\n 4.1. BIBLIOGRAPHY \nreferences of all kinds")
    return table(spark, sf_dir, "documents").select("doc_id", textops.trim_references(raw).alias("body"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss') || ' fine doi: www.x.y', '\s+', ' ', 'g')) AS plain FROM documents""")
def topic_texts(spark, sf_dir):
    raw = text("<b>", F.coalesce("text", F.lit("")), "</b> HTTPS://x.y/z?q=1 &#64257;NE doi:10.1000/abc www.x.y")
    return table(spark, sf_dir, "documents").select("doc_id", textops.normalize_topic_text(F.replace(raw, F.lit("doi:10"), F.lit("doi: 10"))).alias("plain"))


@query("""SELECT c_custkey, lpad(cast(c_custkey % 10000 AS VARCHAR), 4, '0') || '.' || lpad(cast(c_custkey AS VARCHAR), 5, '0') AS arxiv, cast(c_custkey % 9 AS INTEGER) AS arxiv_version, '10.1101/2020.01.' || c_custkey AS stem, cast(c_custkey % 7 AS INTEGER) AS version,
 'PMC' || c_custkey AS pmcid, c_name || ' Q. Roe; The Group' AS authors, 'J. ' || c_mktsegment || ' Res.' AS journal, 'W' || c_custkey AS work, cast(1 + c_custkey % 12 AS INTEGER) AS month, c_mktsegment || '_' || c_custkey AS slug FROM customer""")
def identifier_rules(spark, sf_dir):
    people = table(spark, sf_dir, "customer").withColumn("v", F.col("c_custkey") % 9).withColumn("w", F.col("c_custkey") % 7)
    number = F.concat(F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("."), F.lpad(F.col("c_custkey").cast("string"), 5, "0"))
    arxiv = F.when(F.col("v") == 0, F.concat(F.lit("arXiv: "), number)).otherwise(F.concat(F.lit("https://arxiv.org/abs/"), number, F.lit("v"), F.col("v").cast("string")))
    doi = F.when(F.col("w") == 0, text("DOI:10.1101/2020.01.", "{c_custkey}")).otherwise(text("https://doi.org/10.1101/2020.01.", "{c_custkey}", "v", "{w}"))
    months = F.array(*(F.lit(m) for m in ("January", "feb.", "3", "April", "May", "06", "JULY", "August", "Sept", "oct", "November", "12")))
    return people.select(
        "c_custkey", ids.arxiv_id(arxiv).alias("arxiv"), ids.arxiv_version(arxiv).alias("arxiv_version"), ids.preprint_stem(doi).alias("stem"), ids.preprint_version(doi).alias("version"), ids.pmcid(text("pmc ", "{c_custkey}")).alias("pmcid"),
        ids.author_list(text("Roe, ", "{c_name}", " Q.;; The Group ; ")).alias("authors"), ids.journal_name(text("J. ", "{c_mktsegment}", " Res. 12 (2001) 3")).alias("journal"), ids.short_openalex_id(text("https://openalex.org/W", "{c_custkey}", "/")).alias("work"),
        ids.month_number(F.element_at(months, (F.col("c_custkey") % 12 + 1).cast("int"))).alias("month"), textops.slug(text(" ", "{c_mktsegment}", "/:", "{c_custkey}", "?. ")).alias("slug"),
    )


@query("""SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS abstract FROM documents""")
def abstract_search(spark, sf_dir):
    """An abstract deep in a JSON document, under one of several keys; blank ones don't count."""
    inner = F.to_json(F.struct(F.lit(" ").alias("description"), F.struct(F.col("text").alias("dc:description")).alias("deep")))
    return table(spark, sf_dir, "documents").select("doc_id", textops.find_abstract(F.concat(F.lit('{"a": [1, '), inner, F.lit("]}"))).alias("abstract"))


@query("""SELECT page_id, 'Intro' || chr(10) || chr(10) || 'Page ' || page_id || ' is it' || chr(10) || chr(10) || 'End' AS body FROM pages""")
def jats_bodies(spark, sf_dir):
    xml = text("<article><body><title>Intro</title><sec><p>Page <b>", "{page_id}", "</b>\n is <xref>1</xref>it</p><fig><p>no</p></fig></sec><sec><sec><p>End</p></sec></sec></body><body><p>other</p></body></article>")
    return table(spark, sf_dir, "pages").select("page_id", textops.jats_text(xml).alias("body"))


@query("""SELECT event_id, '[{"k":' || cast(json_extract(props, '$.k') AS VARCHAR) || '}' || CASE event_id % 3 WHEN 0 THEN ',{"z":"}{"}' ELSE '' END || ']' AS records FROM events WHERE event_id % 3 < 2 AND json_valid(props)""")
def json_answers(spark, sf_dir):
    """Answers in prose and fences, with a broken object before and brackets in strings; one in three holds none."""
    kind = F.col("event_id") % 3
    answer = F.when(kind == 0, text('As [1] says {"broken": } then ', "{props}", ' and [{"z": "}{"}] end')).when(kind == 1, text("```json\n[", "{props}", ", 7]\n```")).otherwise("no records, see [3]")
    rows = table(spark, sf_dir, "events").select("event_id", textops.repair_json(answer).alias("r"))
    return rows.where("r is not null").select("event_id", F.concat(F.lit("["), F.regexp_replace(F.array_join("r", ","), r'": ', '":'), F.lit("]")).alias("records"))


# --- papers and stored state


@query(f"""SELECT doc_id, 'paper:' || sha1({TITLE} || '||') AS paper_id, {TITLE} AS title, coalesce(source, '') AS sources, 'pending' AS pdf_status, cast(coalesce(n_chars, 0) AS BIGINT) AS num_images, '' AS text_path FROM documents""")
def normalized_papers(spark, sf_dir):
    rows = papers(spark, sf_dir).drop("paper_id").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ingest_seq"), F.col("n_chars").alias("num_images")), "ingest_seq")
    return corpus.normalize_papers(rows).select(F.col("ingest_seq").alias("doc_id"), "paper_id", "title", "sources", "pdf_status", "num_images", "text_path")


@query("""SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY conv_id, role""")
def linked_assets(spark, sf_dir):
    """Even turns are linked already, odd ones are added; the later of a conversation and role stays."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    return corpus.link_assets(turns.where("turn % 2 = 0"), turns.where("turn % 2 = 1"), ("conv_id", "role"), "turn")


@query(f"WITH {_STATUS} SELECT doc_id FROM s WHERE (energy OR marked) AND rated")
def scrape_gate(spark, sf_dir):
    rows = filter_input(spark, sf_dir)
    return gate(rows, STACK.evaluate(rows)).select(F.col("ingest_seq").alias("doc_id"))


@query(f"WITH {_STATUS} SELECT doc_id, {_NAMED.format('((energy OR marked) AND rated)')} AS final_status FROM s")
def stored_filters(spark, sf_dir):
    """Each filter's results stored in long form, and the stack folded over what is stored."""
    rows, results = filter_input(spark, sf_dir), None
    for step in STACK.steps:
        fresh = rows.select(F.lit(step.filter.name).alias("filter"), "paper_id", status_name(step.filter.status()).alias("status"))
        results = fresh if results is None else results.unionByName(fresh)
    return STACK.recompute(rows.select("paper_id", "ingest_seq"), results).select(F.col("ingest_seq").alias("doc_id"), "final_status")


@query(f"WITH {_STATUS} SELECT doc_id, {_NAMED.format('energy')} AS status FROM s")
def bounded_filter(spark, sf_dir):
    """The filter of ``regex_filter`` by the engine that gives up in time."""
    return papers(spark, sf_dir).select(F.col("ingest_seq").alias("doc_id"), status_name(ENERGY.bounded_status()).alias("status"))


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def unfinished_papers(spark, sf_dir):
    marked = table(spark, sf_dir, "labels").where("doc_id is not null").select(F.col("doc_id").cast("string").alias("paper_id"), F.when(F.col("quality") == 1, "text").otherwise("pdf").alias("role"))
    return corpus.unfinished(papers(spark, sf_dir), marked, "text").select(F.col("ingest_seq").alias("doc_id"))


@query(r"""SELECT doc_id, CASE WHEN quality = 1 THEN regexp_replace(text, '\s+$', '') WHEN toxic = 1 THEN 'pdf of ' || doc_id ELSE '' END AS full_text, CASE WHEN quality = 1 OR toxic = 1 THEN 'abstract' ELSE 'abstract;full_text' END AS unavailable
 FROM (SELECT doc_id, coalesce(text, '') AS text, trim(split_part(coalesce(text, ''), chr(10), 1)) AS title, quality, toxic FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)) WHERE title <> '' AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""")
def paper_contents(spark, sf_dir):
    """Text assets without their references, PDF texts where there is none, and what is missing."""
    docs = papers(spark, sf_dir).where(F.trim(F.regexp_replace(F.coalesce("full_text", F.lit("")), r"\s+", " ")) != "").where("title <> ''")
    marks = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("paper_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    both = docs.join(marks, "paper_id")
    texts = both.where("q = 1").select("paper_id", F.lit("text").alias("role"), F.concat(F.regexp_replace("full_text", r"\s+$", ""), F.lit("\nReferences\nx")).alias("content"))
    pdfs = both.where("t = 1").select("paper_id", F.lit("pdf").alias("role"), F.concat(F.lit("pdf of "), "paper_id").alias("content"))
    found = paper_content(docs.select("paper_id", "ingest_seq", "title"), texts.unionByName(pdfs))
    return found.select(F.col("ingest_seq").alias("doc_id"), "full_text", F.array_join("unavailable", ";").alias("unavailable"))


@query("""SELECT count(*) AS papers, count(*) FILTER (c_custkey % 2 = 0) AS with_doi, count(*) FILTER (c_mktsegment = 'FURNITURE') AS with_text, count(*) FILTER (c_mktsegment = 'MACHINERY') AS failed, cast(coalesce(sum(c_nationkey), 0) AS BIGINT) AS num_text_materials FROM customer""")
def pipeline_status(spark, sf_dir):
    state = F.when(F.col("c_mktsegment") == "FURNITURE", "succeeded").when(F.col("c_mktsegment") == "MACHINERY", "failed").otherwise("")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("paper_id"), F.when(F.col("c_custkey") % 2 == 0, text("10.1/", "{c_custkey}")).alias("doi"), state.alias("text_status"), F.col("c_nationkey").alias("num_text_materials"))
    return corpus.pipeline_status(corpus.normalize_papers(rows)).select("papers", "with_doi", "with_text", "failed", "num_text_materials")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'partial' ELSE 'pending' END AS enrichment_status FROM orders""")
def changed_statuses(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.lit("pending").alias("enrichment_status"), "o_orderstatus")
    changed = orders.where("o_orderstatus = 'F'").select("paper_id", F.lit("partial").alias("enrichment_status"))
    return corpus.set_enrichment_status(orders, changed).select(F.col("paper_id").alias("o_orderkey"), "enrichment_status")


# --- provider records


def people(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("y", 1990 + F.col("c_nationkey")).withColumn("m", F.col("c_custkey") % 12 + 1)


def mapped(rows: DataFrame, provider: str, record: Column) -> DataFrame:
    return mappers.MAPPERS[provider](rows.select(F.col("c_custkey").alias("ingest_seq"), record.alias("record")))


def crossref_record() -> Column:
    date = F.array(F.array(F.col("y").cast("int"), F.col("m").cast("int")))
    whole = F.struct(
        text("10.1000/C", "{c_custkey}").alias("DOI"), F.array(text("<i>On</i> ", "{c_mktsegment}", " ", "{c_custkey}")).alias("title"), F.array("c_mktsegment").alias("container-title"), F.struct(date.alias("date-parts")).alias("issued"),
        F.array(F.struct(F.lit("Ada").alias("given"), F.col("c_name").alias("family"), F.lit(None).cast("string").alias("name")), F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), F.lit("Group").alias("name"))).alias("author"),
    )
    return F.to_json(whole)


_DATE = "(1990 + c_nationkey) || '-' || lpad(cast(c_custkey % 12 + 1 AS VARCHAR), 2, '0')"


@query(f"""SELECT c_custkey AS ingest_seq, 'doi:10.1000/c' || c_custkey AS paper_id, 'On ' || c_mktsegment || ' ' || c_custkey AS title, c_mktsegment AS journal, {_DATE} AS publication_date, 'Ada ' || c_name || '; Group' AS authors FROM customer""")
def crossref_records(spark, sf_dir):
    return mapped(people(spark, sf_dir), "crossref", crossref_record()).select("ingest_seq", "paper_id", "title", "journal", "publication_date", "authors")


@query("""SELECT c_custkey AS ingest_seq, CASE WHEN c_custkey % 2 = 0 THEN 'doi:10.1000/c' || c_custkey ELSE 'openalex:W' || c_custkey END AS paper_id, c_name AS title, c_mktsegment AS journal, cast(c_custkey AS VARCHAR) AS pmid, 'zeta beta ' || c_custkey || ' zeta' AS abstract, 'u' || c_custkey AS pdf_url FROM customer""")
def openalex_records(spark, sf_dir):
    return mapped(people(spark, sf_dir), "openalex", openalex_record()).select("ingest_seq", "paper_id", "title", "journal", "pmid", "abstract", "pdf_url")


def openalex_record() -> Column:
    index = F.create_map(F.lit("beta"), F.array(F.lit(1)), F.lit("zeta"), F.array(F.lit(0), F.lit(3)), F.col("c_custkey").cast("string"), F.array(F.lit(2)))
    whole = F.struct(
        text("https://openalex.org/W", "{c_custkey}").alias("id"), F.when(F.col("c_custkey") % 2 == 0, text("https://doi.org/10.1000/C", "{c_custkey}")).alias("doi"), F.col("c_name").alias("title"), F.lit("2020-01-02").alias("publication_date"),
        F.struct(F.struct(F.col("c_mktsegment").alias("display_name")).alias("source")).alias("primary_location"), F.array(F.struct(text("u", "{c_custkey}").alias("pdf_url"))).alias("locations"),
        F.struct(text("https://pubmed.ncbi.nlm.nih.gov/", "{c_custkey}").alias("pmid")).alias("ids"), index.alias("abstract_inverted_index"),
    )
    return F.to_json(whole)


@query("""SELECT c_custkey AS ingest_seq, 'core:' || c_custkey AS paper_id, '10.1000/c' || c_custkey AS doi, cast(1990 + c_nationkey AS VARCHAR) AS publication_date, 'Ada ' || c_name AS authors, c_mktsegment AS journal FROM customer""")
def core_records(spark, sf_dir):
    whole = F.struct(F.col("c_custkey").alias("id"), text("10.1000/C", "{c_custkey}").alias("doi"), F.col("c_name").alias("title"), F.col("y").alias("yearPublished"), F.array(F.struct(text("{c_name}", ", Ada").alias("name"))).alias("authors"), F.col("c_mktsegment").alias("publisher"))
    return mapped(people(spark, sf_dir), "core", F.to_json(whole)).select("ingest_seq", "paper_id", "doi", "publication_date", "authors", "journal")


@query("""SELECT c_custkey AS ingest_seq, 'SCOPUS_ID:' || c_custkey AS paper_id, '10.1000/c' || c_custkey AS doi, c_name AS title, 'http://x/' || c_custkey AS elsevier_link, CASE WHEN c_custkey % 2 = 0 THEN 'long ' || c_mktsegment ELSE 'short' END AS abstract FROM customer""")
def elsevier_records(spark, sf_dir):
    link = F.array(F.struct(F.lit("self").alias("@ref"), F.lit("no").alias("@href")), F.struct(F.lit("full-text").alias("@ref"), text("http://x/", "{c_custkey}").alias("@href")))
    whole = F.struct(text("SCOPUS_ID:", "{c_custkey}").alias("dc:identifier"), text("doi:10.1000/C", "{c_custkey}").alias("prism:doi"), text(" ", "{c_name}", " ").alias("dc:title"), F.when(F.col("c_custkey") % 2 == 0, text("long  ", "{c_mktsegment}")).alias("dc:description"), F.lit("short").alias("prism:teaser"), link.alias("link"))
    return mapped(people(spark, sf_dir), "elsevier", F.to_json(whole)).select("ingest_seq", "paper_id", "doi", "title", "elsevier_link", "abstract")


@query("""SELECT c_custkey AS ingest_seq, CASE WHEN c_custkey % 3 = 0 THEN '10.5555/j' || c_custkey ELSE '10.1101/p' || c_custkey END AS doi, '10.1101/p' || c_custkey AS medrxiv_doi, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'medRxiv' END AS journal, 'Ada ' || c_name AS authors, lower(c_mktsegment) || '-care' AS primary_category,
 'https://www.medrxiv.org/content/10.1101/p' || c_custkey || 'v2.full.pdf' AS pdf_url FROM customer""")
def medrxiv_records(spark, sf_dir):
    whole = F.struct(text("10.1101/p", "{c_custkey}").alias("doi"), F.when(F.col("c_custkey") % 3 == 0, text("10.5555/J", "{c_custkey}")).otherwise("NA").alias("published"), text("{c_name}", ", Ada").alias("authors"), F.lit("2").alias("version"), text("{c_mktsegment}", " Care").alias("category"))
    return mapped(people(spark, sf_dir), "medrxiv", F.to_json(whole)).select("ingest_seq", "doi", "medrxiv_doi", "journal", "authors", "primary_category", "pdf_url")


@query("""SELECT c_custkey AS ingest_seq, '10.26434/chemrxiv-2031-x' || c_custkey AS chemrxiv_stem, cast(c_custkey % 4 + 1 AS VARCHAR) AS version, 'Ada ' || c_name AS authors, c_mktsegment AS category, 'chemRxiv' AS journal FROM customer""")
def chemrxiv_records(spark, sf_dir):
    item = F.struct(F.concat(text("10.26434/chemrxiv-2031-x", "{c_custkey}", "-v"), (F.col("c_custkey") % 4 + 1).cast("string")).alias("doi"), F.array(F.struct(F.lit("Ada").alias("firstName"), F.col("c_name").alias("lastName"))).alias("authors"), F.array(F.struct(F.lit("c1").alias("id"), F.col("c_mktsegment").alias("name"))).alias("categories"))
    return mapped(people(spark, sf_dir), "chemrxiv", F.to_json(F.struct(item.alias("item")))).select("ingest_seq", "chemrxiv_stem", "version", "authors", "category", "journal")


@query(f"""SELECT c_custkey AS ingest_seq, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'doi:10.1000/p' || c_custkey ELSE 'pmid:' || c_custkey END AS paper_id, CASE WHEN c_custkey % 5 <> 0 THEN 'On E. coli ' || c_custkey END AS title, CASE WHEN c_custkey % 5 <> 0 THEN {_DATE} END AS publication_date,
 CASE WHEN c_custkey % 5 <> 0 THEN 'Ada ' || c_name || '; The Group' END AS authors, CASE WHEN c_custkey % 5 <> 0 THEN 'AIM: To see.' || chr(10) || c_mktsegment END AS abstract, c_custkey % 5 = 0 AS broken FROM customer""")
def pubmed_records(spark, sf_dir):
    """One record in five is cut off: it keeps its place, and says what is wrong."""
    month = F.element_at(F.array(*(F.lit(m) for m in ("Jan", "Feb", "3", "Apr", "May", "06", "Jul", "Aug", "Sep", "Oct", "Nov", "12"))), F.col("m").cast("int"))
    doi = F.when(F.col("c_custkey") % 2 == 0, text("<ArticleId IdType='doi'>10.1000/P", "{c_custkey}", "</ArticleId>")).otherwise("")
    xml = text("<PubmedArticle><PMID>", "{c_custkey}", "</PMID><Article><ArticleTitle>On <i>E. coli</i> ", "{c_custkey}", "</ArticleTitle><Journal><PubDate><Year>", "{y}", "</Year><Month>", month, "</Month></PubDate></Journal><Abstract><AbstractText Label='AIM'>To see.</AbstractText><AbstractText>", "{c_mktsegment}",
               "</AbstractText></Abstract><AuthorList><Author><LastName>", "{c_name}", "</LastName><ForeName>Ada</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article><ArticleIdList>", doi, "</ArticleIdList></PubmedArticle>")
    record = F.when(F.col("c_custkey") % 5 == 0, F.substring(xml, 1, 60)).otherwise(xml)
    return mapped(people(spark, sf_dir), "pubmed", record).select("ingest_seq", "paper_id", "title", "publication_date", "authors", "abstract", (F.col("error") != "").alias("broken"))


@query("""SELECT c_custkey AS ingest_seq, '3101.' || lpad(cast(c_custkey AS VARCHAR), 5, '0') AS arxiv_id, cast(c_custkey % 4 + 1 AS VARCHAR) AS version, CASE WHEN c_custkey % 2 = 0 THEN 'doi:10.1000/a' || c_custkey ELSE 'arxiv:3101.' || lpad(cast(c_custkey AS VARCHAR), 5, '0') END AS paper_id,
 CASE WHEN c_custkey % 2 = 0 THEN 'Phys. Rev.' ELSE 'arXiv' END AS journal, 'cs.DB' AS category, 'A ' || c_name AS title FROM customer""")
def arxiv_records(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    number = F.concat(F.lit("3101."), F.lpad(F.col("c_custkey").cast("string"), 5, "0"))
    xml = text("<entry xmlns='http://www.w3.org/2005/Atom'><id>http://arxiv.org/abs/", number, "v", (F.col("c_custkey") % 4 + 1).cast("string"), "</id><title>A\n ", "{c_name}", "</title><published>2031-01-05T00:00:00Z</published><category term='cs.DB'/><category term='cs.IR'/>", F.when(even, text("<doi>10.1000/A", "{c_custkey}", "</doi><journal_ref>Phys. Rev. 12 (2001)</journal_ref>")).otherwise(""), "</entry>")
    return mapped(people(spark, sf_dir), "arxiv", xml).select("ingest_seq", "arxiv_id", "version", "paper_id", "journal", "category", "title")


# --- children and enrichment


def works(spark, sf_dir) -> DataFrame:
    """OpenAlex works with a Crossref author list that is one longer."""
    rows = people(spark, sf_dir).withColumn("n", (F.col("c_custkey") % 3).cast("int"))
    place = F.struct(F.col("c_mktsegment").alias("display_name"), F.lit("https://ror.org/r1").alias("ror"), F.lit("DE").alias("country_code"))
    author = F.struct(F.struct(text("https://openalex.org/A", "{c_custkey}").alias("id"), F.col("c_name").alias("display_name"), F.lit("0000-0002-1825-0097").alias("orcid")).alias("author"), F.array_repeat(place, F.col("n")).alias("institutions"), F.array(F.lit("Home")).alias("raw_affiliation_strings"), F.lit(True).alias("is_corresponding"), F.lit("").alias("author_position"))
    deposited = F.struct(F.lit("Ada").alias("given"), F.col("c_name").alias("family"), F.lit(None).cast("string").alias("ORCID"), F.array(F.struct(F.lit("Away").alias("name"))).alias("affiliation"))
    named = lambda i, n: F.struct(i.alias("id"), n.alias("display_name"), F.lit(0.5).alias("score"))
    level = lambda i, n: F.struct(F.lit(i).alias("id"), n.alias("display_name"))
    topic = F.struct(text("https://openalex.org/T", "{c_nationkey}").alias("id"), level("s1", F.lit("Sub")).alias("subfield"), level("f1", F.col("c_mktsegment")).alias("field"), level("", F.lit("none")).alias("domain"))
    return rows.select(
        F.col("c_custkey").alias("paper_id"), F.array(author).alias("authorships"), F.array(deposited, deposited).alias("author"), F.array(named(text("T", "{c_nationkey}"), F.col("c_name")), named(F.lit("T99"), F.lit("Other")), named(F.lit("T99"), F.lit("Again"))).alias("topics"), topic.alias("primary_topic"),
        F.array(named(F.lit(None).cast("string"), F.col("c_mktsegment"))).alias("keywords"), F.array(named(F.lit("https://metadata.un.org/sdg/3"), F.lit("Health"))).alias("sustainable_development_goals"),
        F.array(text("https://openalex.org/W", "{n}"), F.lit("")).alias("referenced_works"), F.array(F.struct(text("https://doi.org/10.1000/R", "{c_custkey}").alias("DOI"))).alias("reference"),
    )


@query("""WITH c AS (SELECT c_custkey AS paper_id, c_name, c_mktsegment, cast(c_custkey % 3 AS INTEGER) AS n FROM customer)
SELECT paper_id, 0::INTEGER AS author_position, 'first' AS position_label, c_name AS display_name, 'openalex' AS source, r::INTEGER AS affiliation_rank, CASE WHEN r = 0 THEN 'Home' ELSE '' END AS affiliation, CASE WHEN n = 0 THEN '' ELSE c_mktsegment END AS institution_name, '0000-0002-1825-0097' AS orcid FROM c, range(2) t(r) WHERE r < greatest(n, 1)
UNION ALL SELECT paper_id, 1, 'last', 'Ada ' || c_name, 'crossref', 0, 'Away', '', '' FROM c""")
def author_children(spark, sf_dir):
    return children.authors(works(spark, sf_dir)).select("paper_id", "author_position", "position_label", "display_name", "source", "affiliation_rank", "affiliation", "institution_name", "orcid")


@query("""WITH s AS (SELECT c_custkey AS paper_id, unnest([{'scheme': 'topic', 'subject_id': 'T' || c_nationkey, 'display_name': c_name, 'is_primary': 1}, {'scheme': 'topic', 'subject_id': 'T99', 'display_name': 'Other', 'is_primary': 0}, {'scheme': 'subfield', 'subject_id': 's1', 'display_name': 'Sub', 'is_primary': 1},
 {'scheme': 'field', 'subject_id': 'f1', 'display_name': c_mktsegment, 'is_primary': 1}, {'scheme': 'keyword', 'subject_id': c_mktsegment, 'display_name': c_mktsegment, 'is_primary': 0}, {'scheme': 'sdg', 'subject_id': '3', 'display_name': 'Health', 'is_primary': 0}]) AS s FROM customer) SELECT paper_id, s.scheme, s.subject_id, s.display_name, s.is_primary::INTEGER AS is_primary FROM s""")
def subject_children(spark, sf_dir):
    return children.openalex_subjects(works(spark, sf_dir)).select("paper_id", "scheme", "subject_id", "display_name", "is_primary")


@query("""SELECT c_custkey AS paper_id, 'crossref' AS source, 0::INTEGER AS reference_rank, '10.1000/r' || c_custkey AS referenced_doi, '' AS referenced_openalex_id FROM customer UNION ALL SELECT c_custkey, 'openalex', 0, '', 'W' || (c_custkey % 3) FROM customer""")
def reference_children(spark, sf_dir):
    return children.references(works(spark, sf_dir))


@query("""SELECT c_custkey AS paper_id, scheme, subject_id FROM customer, (VALUES ('topic', 'T99'), ('sdg', '3')) v(scheme, subject_id) WHERE c_custkey = 7 AND scheme = 'sdg'""")
def child_lookup(spark, sf_dir):
    return corpus.children(children.openalex_subjects(works(spark, sf_dir)), 7, "subject_rank", scheme="sdg").select("paper_id", "scheme", "subject_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NULL THEN '' WHEN l_linenumber % 2 = 0 THEN '10.1000/own' ELSE '10.1000/p' || p_partkey END AS referenced_doi FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def resolved_references(spark, sf_dir):
    own = F.when(F.col("l_linenumber") % 2 == 0, "10.1000/own").otherwise("")
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text("W", "{l_partkey}").alias("referenced_openalex_id"), own.alias("referenced_doi"))
    known = table(spark, sf_dir, "part").select(text("https://openalex.org/W", "{p_partkey}").alias("id"), text("https://doi.org/10.1000/P", "{p_partkey}").alias("doi"))
    return enrich.resolve_references(refs, known).select("l_orderkey", "l_linenumber", "referenced_doi")


@query("""SELECT key, max(o_orderkey)::VARCHAR AS paper_id FROM (SELECT o_orderkey, '10.1000/c' || o_custkey AS key FROM orders WHERE o_orderstatus <> 'F') GROUP BY key""")
def provider_partition(spark, sf_dir):
    doi = F.when(F.col("o_orderstatus") != "F", text("DOI:10.1000/C", "{o_custkey}")).otherwise("")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("paper_id"), F.col("o_orderkey").alias("ingest_seq"), doi.alias("doi"))
    return enrich.partition_candidates(rows)[0]["crossref"]


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND coalesce(s_name, '') = '' THEN c_mktsegment ELSE coalesce(s_name, '') END AS publisher, CASE WHEN c_custkey % 2 = 0 AND coalesce(s_nationkey, 0) = 0 THEN 7 ELSE coalesce(s_nationkey, 0) END::BIGINT AS cited_by_count FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def preserved_values(spark, sf_dir):
    """Every second customer's provider has failed: what is stored stays where the fresh value is missing or 0."""
    people_ = table(spark, sf_dir, "customer")
    fresh = people_.join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left").select(F.col("c_custkey").alias("paper_id"), F.coalesce("s_name", F.lit("")).alias("publisher"), F.coalesce("s_nationkey", F.lit(0)).cast("long").alias("cited_by_count"))
    stored = people_.select(F.col("c_custkey").alias("paper_id"), F.col("c_mktsegment").alias("publisher"), F.lit(7).cast("long").alias("cited_by_count"))
    return enrich.preserve(fresh, stored, F.col("paper_id") % 2 == 0).withColumnRenamed("paper_id", "c_custkey")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'stored' WHEN c_custkey % 4 = 3 THEN '' WHEN c_custkey % 4 = 1 THEN 'On ' || c_mktsegment || ' ' || c_custkey ELSE c_name END AS title, CASE c_custkey % 4 WHEN 3 THEN 'unresolved' WHEN 2 THEN 'partial' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'succeeded' ELSE 'partial' END END AS enrichment_status,
 CASE c_custkey % 4 WHEN 3 THEN '' WHEN 2 THEN 'openalex' ELSE CASE WHEN c_custkey % 2 = 0 THEN 'crossref;openalex' ELSE 'crossref' END END AS enrichment_sources, CASE WHEN c_custkey % 4 < 2 THEN {_DATE} WHEN c_custkey % 4 = 2 THEN '2020-01-02' ELSE '' END AS publication_date FROM customer""")
def enriched_papers(spark, sf_dir):
    """Recorded Crossref and OpenAlex pages, mapped, joined by DOI or id, merged and given a status.

    Of four papers one has a title and a DOI, one a DOI, one an OpenAlex id and one no key at all.
    """
    rows, kind = people(spark, sf_dir), F.col("c_custkey") % 4
    crossref = mapped(rows, "crossref", crossref_record()).select("doi", "title", "journal", "publication_date", "authors")
    openalex = mapped(rows, "openalex", openalex_record()).select("doi", "openalex_id", "title", "journal", "publication_date", "authors", "pmid")
    asked = rows.select(F.col("c_custkey").cast("string").alias("paper_id"), F.col("c_custkey").alias("ingest_seq"), F.when(kind < 2, text("https://doi.org/10.1000/c", "{c_custkey}")).otherwise("").alias("doi"), F.when(kind == 2, text("W", "{c_custkey}")).otherwise("").alias("openalex_id"), F.when(kind == 0, "stored").otherwise("").alias("title"))
    out = enrich.enrich_papers(asked, {"crossref": crossref, "openalex": openalex}, now="2031-01-01")
    return out.select(F.col("ingest_seq").alias("c_custkey"), "title", "enrichment_status", "enrichment_sources", "publication_date")


@query("""SELECT c_custkey FROM customer WHERE c_custkey % 3 < 2""")
def author_works(spark, sf_dir):
    """Works of one person: by full name with accents, by initials, and a namesake elsewhere."""
    kind = F.col("c_custkey") % 3
    given = F.when(kind == 0, "Pál").when(kind == 1, "P.").otherwise("Piroska")
    person = F.struct(given.alias("given"), F.lit("Erdős").alias("family"), F.lit(None).cast("string").alias("ORCID"), F.array(F.struct(F.lit("Tudományos Akadémia").alias("name"))).alias("affiliation"))
    other = F.struct(F.lit("Ann").alias("given"), F.lit("Other").alias("family"), F.lit(None).cast("string").alias("ORCID"), F.array().cast("array<struct<name:string>>").alias("affiliation"))
    return table(spark, sf_dir, "customer").where(search.author_matches(F.array(other, person), "Erdos", "Pal", affiliation="tudomanyos")).select("c_custkey")


# --- topics

_STOPS = ", ".join(f"'{w}'" for w in sorted(topics.STOPWORDS))


@query(rf"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[.!?;:\n]+')) AS seg FROM documents), t AS (SELECT doc_id, list_filter(regexp_extract_all(seg, '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: regexp_full_match(w, '[a-z][a-z0-9]+') AND NOT list_contains([{_STOPS}], w)) AS w FROM s),
 b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) AS term FROM t WHERE len(w) > 1)
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM b GROUP BY term HAVING count(DISTINCT doc_id) >= 2 ORDER BY tf DESC, term LIMIT 300""")
def bigram_vocabulary(spark, sf_dir):
    """The most frequent pairs of neighbours within a segment; single words are left out by what they are made of."""
    docs = table(spark, sf_dir, "documents").select("doc_id", topics.features(F.lower(F.coalesce("text", F.lit("")))).alias("tokens"))
    pairs = docs.withColumn("tokens", F.filter("tokens", lambda t: F.contains(t, F.lit("_"))))
    return topics.vocabulary(pairs, max_df=1.0, max_features=300, doc="doc_id").select("term", "tf", "df")


@query("""SELECT 'm' || l_linenumber AS model_id, count(*) FILTER (l_returnflag <> 'N') AS predicted, count(*) FILTER (l_returnflag = 'N') AS without_terms, any_value(l_linenumber)::BIGINT AS topics FROM lineitem GROUP BY l_linenumber""")
def stored_models(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(text("m", "{l_linenumber}").alias("model_id"), "l_linenumber", F.when(F.col("l_returnflag") == "N", "no_vocabulary_terms").otherwise("predicted").alias("status"))
    definitions = rows.select("model_id", "l_linenumber").distinct().select("model_id", F.explode(F.sequence(F.lit(1), F.col("l_linenumber"))).alias("topic_id"))
    return topics.stored_models(rows, definitions)


@query(f"""WITH t AS (SELECT lang, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda w: regexp_full_match(w, '[a-z][a-z0-9]+') AND NOT list_contains([{_STOPS}], w))) AS term FROM documents), c AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS k FROM t GROUP BY lang, term)
SELECT round(count(DISTINCT term) / count(term), 9) AS diversity FROM c WHERE k <= 25""")
def topic_diversity(spark, sf_dir):
    counts = tokens(spark, sf_dir).select("lang", F.explode("tokens").alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).where("k <= 25")
    return topics.diversity(top).select(F.round("diversity", 9).alias("diversity"))
