import json

import pytest
from pyspark.sql import functions as F

from quillmill.operators import children, corpus, enrich, extract
from quillmill.plans import workflows
from quillmill.plans.filterstack import FilterStack, Pattern, RegexFilter
from quillmill.sources import mappers

from .test_mappers import RECORDS

AUTHORSHIPS = "array<struct<author_position:string,author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<display_name:string,ror:string,country_code:string>>,raw_affiliation_strings:array<string>,is_corresponding:boolean>>"
CROSSREF_AUTHORS = "array<struct<given:string,family:string,ORCID:string,affiliation:array<struct<name:string>>>>"
NAMED = "struct<id:string,display_name:string>"
WORKS = f"paper_id string, authorships {AUTHORSHIPS}, author {CROSSREF_AUTHORS}, topics array<struct<id:string,display_name:string,score:double,field:{NAMED},domain:{NAMED}>>, primary_topic struct<id:string,subfield:{NAMED},field:{NAMED},domain:{NAMED}>, concepts array<struct<id:string,display_name:string,score:double,level:int>>, keywords array<struct<id:string,display_name:string,score:double>>, sustainable_development_goals array<struct<id:string,display_name:string,score:double>>, referenced_works array<string>, reference array<struct<DOI:string>>"


def works(spark):
    first = (
        "p1",
        [(None, ("https://openalex.org/A1", "Ann Ash", "0000-0002-1825-0097"), [("U", "https://ror.org/r1", "DE"), ("V", None, "FR")], ["U, Bonn"], True), ("middle", ("A2", "Bo Birk", None), [], ["Home"], None)],
        [("Ann", "Ash", None, []), ("Bo", "Birk", "0000-0002-1825-0097", []), ("Cy", "Cole", None, [("X",), ("Y",)]), ("Di", None, None, [])],
        [("https://openalex.org/T1", "One", 0.9, ("f", "F"), ("d", "D")), ("T2", "Two", 0.5, None, None), ("T1", "Again", 0.1, None, None), ("", "none", 0.1, None, None)],
        ("https://openalex.org/T1", ("s1", "Sub"), ("f1", "Field"), None), [("C1", "Con", 0.3, 2)], [(None, "Key word", 0.2)], [("https://metadata.un.org/sdg/3", "Health", 0.7)], ["https://openalex.org/W1", "", "W2"], [("10.5/A",), (None,)],
    )
    return spark.createDataFrame([first, ("p2", *[None] * 9), ("p3", [], [], [], None, [], [], [], [], [])], WORKS)


def test_subjects(spark):
    rows = [tuple(r) for r in children.openalex_subjects(works(spark)).select("scheme", "subject_id", "display_name", "subject_rank", "is_primary", "level", "parent_field", "source").collect()]
    assert sorted(rows) == sorted([("topic", "T1", "One", 0, 1, None, "F", "openalex"), ("topic", "T2", "Two", 1, 0, None, "", "openalex"), ("subfield", "s1", "Sub", 0, 1, None, "", "openalex"), ("field", "f1", "Field", 0, 1, None, "", "openalex"), ("concept", "C1", "Con", 0, 0, 2, "", "openalex"), ("keyword", "Key word", "Key word", 0, 0, None, "", "openalex"), ("sdg", "3", "Health", 0, 0, None, "", "openalex")])
    article = spark.createDataFrame([("p", [("D1", "Mice", True), ("D1", "Mice", False), ("", "no id", False)], [], ["word"], [("P1", "Review", False)])], f"paper_id string, mesh {mappers._TERMS}, qualifiers {mappers._TERMS}, keywords array<string>, publication_types {mappers._TERMS}")
    assert {tuple(r) for r in children.pubmed_subjects(article).select("scheme", "subject_id", "is_primary").collect()} == {("mesh", "D1", 1), ("mesh_keyword", "word", 0), ("publication_type", "P1", 0)}
    paper = mappers.chemrxiv(spark.createDataFrame([(json.dumps({"doi": "10.1/x", "categories": [{"id": "c1", "name": "Organic"}], "keywords": ["Acid", "acid", " "]}),)], "record string"))
    assert {tuple(r) for r in children.preprint_subjects(paper, "chemrxiv").select("scheme", "subject_id", "display_name").collect()} == {("chemrxiv_category", "c1", "Organic"), ("chemrxiv_keyword", "acid", "Acid")}


def test_authors_and_references(spark):
    rows = children.authors(works(spark)).orderBy("author_position", "affiliation_rank").collect()
    got = [(r["author_position"], r["position_label"], r["display_name"], r["given_name"], r["affiliation_rank"], r["affiliation"], r["institution_name"], r["institution_ror"], r["source"]) for r in rows]
    assert got == [(0, "first", "Ann Ash", "Ann", 0, "U, Bonn", "U", "r1", "openalex"), (0, "first", "Ann Ash", "Ann", 1, "", "V", "", "openalex"), (1, "middle", "Bo Birk", "Bo", 0, "Home", "", "", "openalex"), (2, "middle", "Cy Cole", "Cy", 0, "X", "", "", "crossref"), (2, "middle", "Cy Cole", "Cy", 1, "Y", "", "", "crossref"), (3, "last", "Di", "Di", 0, "", "", "", "crossref")]
    assert [r["orcid"] != "" for r in rows] == [True, True, True, False, False, False] and rows[0]["is_corresponding"] == 1 and rows[0]["openalex_author_id"] == "A1"
    refs = {tuple(r)[1:] for r in children.references(works(spark)).collect()}
    assert refs == {("crossref", 0, "10.5/a", ""), ("crossref", 1, "", ""), ("openalex", 0, "", "W1"), ("openalex", 2, "", "W2")}
    stored = workflows.write_children({}, works(spark))
    again = workflows.write_children(stored, works(spark))
    assert {n: d.count() for n, d in again.items()} == {n: d.count() for n, d in stored.items()} == {"authors": 6, "subjects": 7, "references": 4}


def test_partition(spark):
    rows = [("a", "doi:10.1/X", "W1", 1), ("b", "10.1/x", "", 2), ("openalex:W9", "", "", 3), ("c", "", "", 4), ("pmid:77", None, None, 5), ("", "10.1/z", "", 6)]
    found, rest = enrich.partition_candidates(spark.createDataFrame(rows, "paper_id string, doi string, openalex_id string, ingest_seq long"))
    pairs = {p: {(r["key"], r["paper_id"]) for r in d.collect()} for p, d in found.items()}
    assert pairs["crossref"] == {("10.1/x", "b")} and pairs["openalex"] == {("W9", "openalex:W9")} and pairs["pubmed"] == {("77", "pmid:77")}
    assert {r["paper_id"] for r in rest.collect()} == {"c", "pmid:77"}


def test_enrich_papers(spark):
    def records(name):
        return enrich.record_fields(mappers.MAPPERS[name](spark.createDataFrame([(RECORDS[name],)], "record string")), name)

    papers = spark.createDataFrame([("1", "10.5555/pm", "", "", "31", 1), ("2", "", "3101.00001v2", "", "", 2), ("3", "", "", "10.1101/2031.02.02.000002", "", 3), ("4", "", "", "", "", 4), ("5", "10.9/none", "", "", "", 5)], "paper_id string, doi string, arxiv_id string, biorxiv_doi string, pmid string, ingest_seq long")
    out = {r["paper_id"]: r for r in enrich.enrich_papers(papers, {n: records(n) for n in ("pubmed", "arxiv", "biorxiv")}, now="2031-01-01").collect()}
    assert (out["1"]["title"], out["1"]["enrichment_status"], out["1"]["enrichment_sources"], out["1"]["is_oa"]) == ("On E. coli growth", "partial", "pubmed", 0)
    assert (out["2"]["title"], out["2"]["work_type"], out["2"]["oa_status"], out["2"]["is_oa"], out["2"]["enriched_at"]) == ("A preprint", "preprint", "green", 1, "2031-01-01")
    assert (out["3"]["doi"], out["3"]["work_type"], out["3"]["biorxiv_doi"]) == ("10.5555/j.1", "", "10.1101/2031.02.02.000002")
    assert out["4"]["enrichment_status"] == "unresolved" and out["4"]["enriched_at"] == "" and json.loads(out["2"]["enrichment_json"])["arxiv"]["title"] == "A preprint"


def test_enrich_corpus(spark):
    papers = corpus.normalize_papers(spark.createDataFrame([("a", "10.1/a", "old"), ("b", "10.1/b", "x"), ("c", "10.1/c", "done")], "paper_id string, doi string, title string")).withColumn("ingest_seq", F.lit(1))
    papers = papers.withColumn("enrichment_status", F.when(F.col("paper_id") == "c", "succeeded").otherwise("pending")).withColumn("publisher", F.when(F.col("paper_id") == "b", "kept").otherwise(""))
    fields = spark.createDataFrame([("10.1/a", "new", "P")], "doi string, title string, publisher string")
    out, errors = workflows.enrich_corpus(papers, {"crossref": lambda: fields, "pubmed": lambda: 1 / 0}, now="t")
    got = {r["paper_id"]: r for r in out.collect()}
    assert "ZeroDivision" in errors["pubmed"] and len(got) == 3 and set(out.columns) >= set(papers.columns)
    assert (got["a"]["title"], got["a"]["publisher"], got["a"]["enrichment_status"], got["a"]["enriched_at"]) == ("old", "P", "partial", "t")
    assert (got["b"]["publisher"], got["b"]["enrichment_status"]) == ("kept", "failed") and (got["c"]["enrichment_status"], got["c"]["enriched_at"]) == ("succeeded", "")


def test_search_for_papers(spark):
    def asks(name, *records):
        return lambda: spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "ingest_seq long, record string")

    crossref = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/A", "title": "Band gaps", "publication_date": "2020-02-02"}
    core = [{"id": 9, "doi": "10.1/a", "title": "Band Gaps", "yearPublished": "2020", "downloadUrl": "u"}, {"id": 10, "title": "Other things", "yearPublished": "2021"}]
    stored = spark.createDataFrame([("old", "Other things!", "2021-05-05", "manual", 1)], "paper_id string, title string, publication_date string, sources string, ingest_seq long")
    out, errors = workflows.search_for_papers({"openalex": asks("openalex", crossref), "core": asks("core", *core), "pubmed": lambda: 1 / 0}, stored)
    got = {r["doi"]: r for r in out.collect()}
    assert list(errors) == ["pubmed"] and len(got) == 2
    assert got["10.1/a"]["sources"] == "core;openalex" and got["10.1/a"]["pdf_url"] == "u" and got[""]["paper_id"] == "old" and got[""]["sources"] == "manual;core"
    some, _ = workflows.search_for_papers({"core": asks("core", *core)}, query="band", count=5)
    assert [r["title"] for r in some.collect()] == ["Band Gaps"]
    with pytest.raises(ZeroDivisionError):
        workflows.search_for_papers({"pubmed": lambda: 1 / 0})


def test_download_papers(spark):
    papers = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "paper_id string, doi string")
    have = spark.createDataFrame([("3", "abstract")], "paper_id string, role string")

    def fails(row):
        raise OSError("down")

    loaders = {"abstract": {"openalex": lambda r: "A1" if r["paper_id"] == "1" else None, "pubmed": lambda r: "A2"}, "pdf": {"arxiv": fails, "core": lambda r: b"%PDF" if r["paper_id"] == "2" else b"html"}}
    out, added = workflows.download_papers(papers, loaders, have, now="t")
    got = {r["paper_id"]: r for r in out.collect()}
    assert (got["1"]["abstract_source"], got["2"]["abstract_source"], got["3"]["abstract_status"]) == ("openalex", "pubmed", "pending")
    assert (got["2"]["pdf_status"], got["1"]["pdf_status"], got["1"]["last_error"]) == ("succeeded", "failed", "arxiv: down")
    assert sorted((r["paper_id"], r["role"], bytes(r["content"])) for r in added.collect()) == [("1", "abstract", b"A1"), ("2", "abstract", b"A2"), ("2", "pdf", b"%PDF")]


def test_scrape_papers(spark):
    recipe = extract.Recipe("gaps", "gap", "gaps", "", ("material",), (extract.RecipeField("material", "Which?"), extract.RecipeField("gap", "How large?")))
    papers = spark.createDataFrame([("1", "solid alpha", 1), ("2", "liquid", 2), ("3", "solid fails", 3), ("4", "", 4)], "paper_id string, full_text string, ingest_seq long").withColumn("title", F.col("full_text")).withColumn("text_scrape_status", F.lit("pending"))
    stack = FilterStack().apply(RegexFilter("solid", (Pattern("s", "solid"),)))

    def model(prompt):
        if "fails" in prompt.splitlines()[-1]:
            raise RuntimeError("no")
        return '[{"material": "Si", "gap": "1.1"}, {"material": "Si", "gap": "1.1"}]'

    records, state = workflows.scrape_papers(papers, recipe, model, evaluated=stack.evaluate(papers))
    assert [(r["material"], r["Paper id"]) for r in records.collect()] == [("Si", "1")]
    got = {r["paper_id"]: (r["text_scrape_status"], r["num_text_materials"]) for r in state.collect()}
    assert got == {"1": ("succeeded", 2), "2": ("pending", 0), "3": ("failed", 0), "4": ("pending", 0)}
    more, _ = workflows.scrape_papers(state, recipe, model, stored=records, count=1)
    assert more.count() == 2
