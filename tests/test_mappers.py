import json

import pytest

from quillmill.operators.corpus import normalize_papers
from quillmill.sources import mappers

RECORDS = {
    "medrxiv": json.dumps({"doi": "10.1101/2031.01.02.31000001", "title": "On things", "date": "2031-01-03", "version": "2", "category": "Health Policy", "authors": "Roe, R.; Doe, Jane", "published": "NA", "abstract": " x  y "}),
    "biorxiv": json.dumps({"doi": "10.1101/2031.02.02.000002", "title": "Cells", "date": "2031-02-03", "version": "1", "category": "Cell Biology", "published": "10.5555/J.1"}),
    "chemrxiv": json.dumps({"item": {"id": "abc", "doi": "10.26434/chemrxiv-2031-xyz12-v3", "title": "Acid", "publishedDate": "2031-05-06T07:08:09Z", "authors": [{"firstName": "A", "lastName": "B"}], "categories": [{"id": "c1", "name": "Organic"}, {"id": "c2", "name": "Other"}], "license": {"name": "CC BY"}}}),
    "openalex": json.dumps({"id": "https://openalex.org/W77", "title": "A work", "abstract_inverted_index": {"b": [1], "a": [0]}, "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/12"}, "locations": [{"pdf_url": None}, {"pdf_url": "u"}]}),
    "crossref": json.dumps({"DOI": "10.5555/A", "title": ["T<i>x</i>"], "issued": {"date-parts": [[2031, 4]]}, "author": [{"given": "A", "family": "B"}, {"name": "Group"}]}),
    "core": json.dumps({"id": 9, "title": "A deposit", "yearPublished": 2031, "authors": [{"name": "Doe, Jane"}]}),
    "elsevier": json.dumps({"dc:identifier": "SCOPUS_ID:5", "dc:title": "An article", "prism:doi": "10.5555/E", "link": [{"@ref": "self", "@href": "s"}, {"@ref": "full-text", "@href": "f"}]}),
    "pubmed": "<PubmedArticle><MedlineCitation><PMID>31</PMID><Article><Journal><JournalIssue><PubDate><Year>2031</Year><Month>Feb</Month><Day>3</Day></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>On <i>E. coli</i> growth</ArticleTitle><Abstract><AbstractText Label='AIM'>To see.</AbstractText></Abstract><AuthorList><Author><LastName>Roe</LastName><ForeName>Rita</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.5555/PM</ArticleId></ArticleIdList></PubmedData></PubmedArticle>",
    "arxiv": "<entry xmlns='http://www.w3.org/2005/Atom' xmlns:arxiv='http://arxiv.org/schemas/atom'><id>http://arxiv.org/abs/3101.00001v4</id><title>A  preprint</title><summary>Short.</summary><published>2031-01-05T00:00:00Z</published><author><name>R. Roe</name></author><category term='cs.DB'/><category term='cs.IR'/></entry>",
}


@pytest.fixture(scope="module")
def papers(spark):
    return {n: mappers.MAPPERS[n](spark.createDataFrame([(r,)], "record string")) for n, r in RECORDS.items()}


@pytest.mark.parametrize("name", sorted(RECORDS))
def test_contract(papers, name):
    row = papers[name].first().asDict()
    assert set(mappers.CORE) <= set(row) and row["paper_id"] and row["sources"] == name and row["metadata_status"] == "retrieved"
    assert normalize_papers(papers[name]).first()["sources"] == name
    if name in ("arxiv", "medrxiv", "biorxiv", "chemrxiv"):
        assert set(mappers.PREPRINT) <= set(row)
        primary = [t for t in row["categories"] if t["is_primary"]]
        assert [(t["name"], t["id"]) for t in primary] == [(row["category"], row["primary_category"])]


def test_values(papers):
    r = {n: d.first() for n, d in papers.items()}
    assert r["medrxiv"]["doi"] == "10.1101/2031.01.02.31000001" and r["medrxiv"]["journal"] == "medRxiv" and r["medrxiv"]["authors"] == "R. Roe; Jane Doe" and r["medrxiv"]["abstract"] == "x y"
    assert r["biorxiv"]["doi"] == "10.5555/j.1" and r["biorxiv"]["biorxiv_doi"] == "10.1101/2031.02.02.000002" and r["biorxiv"]["journal"] == ""
    assert (r["chemrxiv"]["version"], r["chemrxiv"]["chemrxiv_stem"], r["chemrxiv"]["publication_date"], r["chemrxiv"]["license"]) == ("3", "10.26434/chemrxiv-2031-xyz12", "2031-05-06", "CC BY")
    assert (r["openalex"]["abstract"], r["openalex"]["pmid"], r["openalex"]["pdf_url"], r["openalex"]["paper_id"]) == ("a b", "12", "u", "openalex:W77")
    assert (r["crossref"]["title"], r["crossref"]["publication_date"], r["crossref"]["authors"]) == ("T x", "2031-04", "A B; Group")
    assert (r["core"]["paper_id"], r["core"]["publication_date"], r["core"]["authors"]) == ("core:9", "2031", "Jane Doe")
    assert (r["elsevier"]["elsevier_link"], r["elsevier"]["doi"]) == ("f", "10.5555/e")
    assert (r["pubmed"]["title"], r["pubmed"]["publication_date"], r["pubmed"]["authors"], r["pubmed"]["abstract"], r["pubmed"]["journal"]) == ("On E. coli growth", "2031-02-03", "Rita Roe; The Group", "AIM: To see.", "J")
    assert (r["arxiv"]["arxiv_id"], r["arxiv"]["version"], r["arxiv"]["title"], r["arxiv"]["category"]) == ("3101.00001", "4", "A preprint", "cs.DB")


@pytest.mark.parametrize("name", ["pubmed", "arxiv"])
def test_malformed_records_and_order(spark, name):
    rows = spark.createDataFrame([(7, RECORDS[name]), (8, "<broken"), (9, None)], "ingest_seq long, record string")
    got = {r["ingest_seq"]: r for r in mappers.MAPPERS[name](rows).collect()}
    assert set(got) == {7, 8} and got[7]["error"] == "" and got[8]["error"].startswith("ParseError") and got[8]["paper_id"] == ""
    assert got[7]["paper_id"] == {"pubmed": "doi:10.5555/pm", "arxiv": "arxiv:3101.00001"}[name]
