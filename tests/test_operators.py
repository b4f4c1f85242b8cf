import json

import pytest
from pyspark.sql import functions as F

from quillmill.operators import corpus, download, enrich, extract, resolve, search, topics
from quillmill.operators import graph
from quillmill.operators.graph import components
from quillmill.plans.filterstack import FilterStack, Pattern, RegexFilter, TopicFilter, TopicRule, combine, current, fingerprint, gate, paper_content, status_name, status_value
from quillmill.sources import registry


def regex(name, pattern, **options):
    return RegexFilter(name, (Pattern("rule", pattern),), **options)


def test_regex_statuses(spark):
    rows = spark.createDataFrame([("1", "alpha beta", ""), ("2", "gamma", ""), ("3", "gamma", "text"), ("4", "alpha veto", "x")], "paper_id string, title string, full_text string")
    f = RegexFilter("f", (Pattern("a", "ALPHA"),), (Pattern("v", "veto"),), ("title", "full_text"))
    got = {r["paper_id"]: r["s"] for r in rows.select("paper_id", status_name(f.status()).alias("s")).collect()}
    assert got == {"1": "included", "2": "unavailable", "3": "excluded", "4": "excluded"}
    found = {(r["paper_id"], r["rule"]): r for r in f.evidence(rows).collect()}
    assert found["4", "v"]["snippets"] == ["alpha veto"] and ("2", "a") not in found


def test_definitions_are_checked():
    with pytest.raises(ValueError):
        RegexFilter("f", ())
    with pytest.raises(ValueError):
        regex("f", "(")
    with pytest.raises(ValueError):
        regex("f", "x", fields=("nope",))
    with pytest.raises(ValueError):
        TopicRule("r", 1)
    with pytest.raises(ValueError):
        TopicFilter("t", "m", (TopicRule("r", 9, 0.5),)).validate(4)
    text = json.dumps({"name": "j", "fields": ["title"], "include": [{"name": "a", "pattern": "x"}]})
    assert RegexFilter.from_json(text).include[0].pattern == "x"


def test_truth_table(spark):
    names = ["included", "excluded", "unavailable"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    both = rows.select("a", "b", *(status_name(combine(status_value(F.col("a")), op, status_value(F.col("b")))).alias(op) for op in ("and", "or")))
    for r in both.collect():
        pair = {r["a"], r["b"]}
        assert r["and"] == ("excluded" if "excluded" in pair else "unavailable" if "unavailable" in pair else "included")
        assert r["or"] == ("included" if "included" in pair else "unavailable" if "unavailable" in pair else "excluded")


def test_stack(spark):
    rows = spark.createDataFrame([("1", "alpha gamma"), ("2", "beta"), ("3", "beta gamma")], "paper_id string, title string")
    stack = FilterStack().apply(regex("a", "alpha")).apply(regex("b", "beta"), "or").apply(regex("c", "gamma"))
    assert stack.expression() == "((a OR b) AND c)"
    done = stack.evaluate(rows)
    assert {r["paper_id"] for r in gate(rows, done).collect()} == {"1", "3"}
    assert stack.reset("a").expression() == "(b AND c)" and stack.reset().expression() == ""
    with pytest.raises(ValueError):
        FilterStack().apply(regex("a", "x"), "or")
    with pytest.raises(ValueError):
        stack.apply(regex("a", "x"), "or")
    results = spark.createDataFrame([("a", "1", "included"), ("c", "1", "included"), ("b", "3", "included")], "filter string, paper_id string, status string")
    got = {r["paper_id"]: r["final_status"] for r in stack.recompute(rows, results).collect()}
    assert got == {"1": "included", "2": "unavailable", "3": "unavailable"}


def test_topic_filter_needs_scores(spark):
    rows = spark.createDataFrame([("1", {0: 0.8, 1: 0.2}, 0, "predicted"), ("2", {0: 0.2, 1: 0.8}, 1, "predicted"), ("3", {0: 0.9}, 0, "predicted"), ("4", None, None, None)], "paper_id string, scores map<int,double>, dominant_topic int, prediction_status string")
    f = TopicFilter("t", "m", (TopicRule("a", 0, 0.5),), (TopicRule("b", 1, None, True),))
    got = [r[0] for r in rows.orderBy("paper_id").select(status_name(f.status())).collect()]
    assert got == ["included", "excluded", "unavailable", "unavailable"]


def test_fingerprint(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "paper_id string, full_text string")
    assert fingerprint(a) == fingerprint(a.orderBy(F.desc("paper_id")).repartition(3))
    current(fingerprint(a), a)
    with pytest.raises(ValueError):
        current(fingerprint(a), a.where("paper_id = '1'"))


def test_normalize_and_reset(spark):
    rows = spark.createDataFrame([("10.1000/A", "T", 3)], "doi string, title string, num_images int")
    r = corpus.normalize_papers(rows).first()
    assert r["paper_id"] == "doi:10.1000/a" and r["num_images"] == 3 and r["pdf_status"] == "pending" and r["num_text_chunks"] is None and r["journal"] == ""
    r = corpus.reset_pipeline(corpus.normalize_papers(rows)).first()
    assert r["num_images"] == 0 and r["metadata_status"] == "retrieved"
    assert corpus.violations(corpus.normalize_papers(rows).withColumn("enrichment_status", F.lit("odd"))).count() == 1


def test_blobs_and_links(spark):
    stored = corpus.compressed(corpus.blobs(spark.createDataFrame([("aaaa" * 100,), ("aaaa" * 100,), (None,)], "content string")))
    row = stored.collect()
    assert len(row) == 1 and row[0]["original_size"] == 400 and row[0]["stored_size"] < 100
    import gzip

    assert gzip.decompress(bytes(row[0]["stored"])) == b"aaaa" * 100
    links = spark.createDataFrame([("p", "pdf", "s", "f", "b1", 1)], "paper_id string, role string, source string, original_filename string, blob_id string, asset_seq int")
    added = spark.createDataFrame([("p", "pdf", "s", "f", "b2", 2)], links.schema)
    assert [r["blob_id"] for r in corpus.link_assets(links, added).collect()] == ["b2"]


def test_resolution_chains(spark):
    rows = spark.createDataFrame([(1, "10.1/a", "", "One", "2020"), (2, "", "7", "Two", "2020"), (3, "10.1/A.", "7", "x", ""), (4, "", "", "two!", "2020-05"), (5, "", "", "", "")], "ingest_seq long, doi string, pmid string, title string, publication_date string")
    assert {r["ingest_seq"]: r["entity"] for r in resolve.resolve(rows).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    pairs = {tuple(r) for r in resolve.matches(rows, rows).where("left_id < right_id").collect()}
    assert pairs == {(1, 3), (2, 3), (2, 4)}


def test_merge_rules(spark):
    rows = spark.createDataFrame([(1, "p", "", "pending", 0, "a;b"), (2, "q", "T", "failed", 5, "b; c"), (3, "r", "U", "succeeded", 7, "")], "ingest_seq long, paper_id string, title string, pdf_status string, num_images int, sources string").withColumn("entity", F.lit(1))
    r = resolve.merge_entities(rows).first()
    assert (r["paper_id"], r["title"], r["pdf_status"], r["num_images"], r["sources"], r["merged_rows"]) == ("p", "T", "failed", 5, "a;b;c", 3)
    plain = [x.asDict() for x in rows.drop("entity", "ingest_seq").collect()]
    merged = resolve.merge_in_order([], [{**p, "pmid": "1"} for p in plain])
    assert len(merged) == 1 and (merged[0]["title"], merged[0]["pdf_status"], merged[0]["num_images"], merged[0]["sources"]) == ("T", "failed", 5, "a;b;c")


def test_order_matters_in_order(spark):
    a, b, c = {"paper_id": "a", "pmid": "1"}, {"paper_id": "b", "pmid": "1", "core_id": "2"}, {"paper_id": "c", "core_id": "2"}
    assert len(resolve.merge_in_order([], [a, c, b])) == 2 and len(resolve.merge_in_order([], [a, b, c])) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 103), (103, 101)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, **{200 + i: 200 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_versions(spark):
    rows = spark.createDataFrame([("k", "2", 1, "New", "", "2021"), ("k", "1", 2, "Old", "abs", "2020")], "k string, version string, seq int, title string, abstract string, publication_date string")
    r = resolve.latest_versions(rows, "k").first()
    assert (r["title"], r["abstract"], r["publication_date"], r["version"]) == ("New", "abs", "2020", "2")


def test_enrichment_precedence(spark):
    papers = spark.createDataFrame([("1", "a"), ("2", "b")], "paper_id string, key string")
    crossref = spark.createDataFrame([("a", "", "P", 0)], "key string, title string, publisher string, referenced_works_count int")
    openalex = spark.createDataFrame([("a", "T", "Q", True, 4)], "key string, title string, publisher string, is_oa boolean, referenced_works_count int")
    arxiv = spark.createDataFrame([("a", "X", "green")], "key string, title string, oa_status string")
    rows = enrich.assemble(papers, {"crossref": crossref, "openalex": openalex, "arxiv": arxiv}, dict.fromkeys(("crossref", "openalex", "arxiv"), "key"))
    r = {x["paper_id"]: x for x in enrich.merge_fields(rows, ["crossref", "openalex", "arxiv"]).collect()}
    assert (r["1"]["title"], r["1"]["publisher"], r["1"]["is_oa"], r["1"]["oa_status"], r["1"]["referenced_works_count"], r["1"]["enrichment_status"]) == ("T", "P", 1, "green", 4, "succeeded")
    assert r["2"]["enrichment_status"] == "not_found" and r["2"]["title"] == ""
    frames, errors = enrich.isolated({"a": lambda: papers, "b": lambda: 1 / 0})
    assert list(frames) == ["a"] and "ZeroDivision" in errors["b"]
    with pytest.raises(ZeroDivisionError):
        enrich.isolated({"b": lambda: 1 / 0})


WORKS = "paper_id string, authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<display_name:string,ror:string,country_code:string>>,is_corresponding:boolean>>, topics array<struct<id:string,display_name:string,score:double>>, keywords array<struct<id:string,display_name:string,score:double>>, referenced_works array<string>"


def test_children(spark):
    rows = [("p", [(("https://openalex.org/A1", "Ann", "0000-0002-1825-0097"), [("U", "r", "DE"), ("V", "s", "FR")], True), (("A2", "Bob", None), [], None)], [("T1", "One", 0.9), ("T1", "Again", 0.1)], [("K1", "Key", 0.5)], ["https://openalex.org/W1", "W2"])]
    works = spark.createDataFrame(rows, WORKS)
    authors = enrich.author_rows(works).orderBy("position", "affiliation_rank").collect()
    assert [(a["name"], a["position_label"], a["affiliation"], a["affiliation_rank"]) for a in authors] == [("Ann", "first", "U", 1), ("Ann", "first", "V", 2), ("Bob", "last", "", 1)]
    assert authors[0]["orcid"] == "0000-0002-1825-0097" and authors[0]["is_corresponding"] == 1
    assert {(s["scheme"], s["subject_id"], s["name"]) for s in enrich.subject_rows(works).collect()} == {("topic", "T1", "One"), ("keyword", "K1", "Key")}
    assert [r["referenced_openalex_id"] for r in enrich.reference_rows(works).orderBy("position").collect()] == ["W1", "W2"]


def test_features(spark):
    row = spark.createDataFrame([("the band gap of oxide. solar cells, oxide",)], "t string")
    got = row.select(topics.features("t", domain=("oxide",)).alias("f")).first()["f"]
    assert got == ["band", "gap", "band_gap", "gap_oxide", "solar", "cells", "solar_cells", "cells_oxide"]


def test_trends_windows(spark):
    assert len(topics.year_windows(2000, 2006, 5, 1)) == 7 and len(topics.year_windows(2000, 2006, 5, 1, partial=False)) == 3
    rows = spark.createDataFrame([(2000, [0.8, 0.2], 0), (2001, None, None), (None, [0.1, 0.9], 1)], "year int, distribution array<double>, dominant_topic int")
    got = {(r["window_start"], r["topic_id"]): r for r in topics.trends(rows, 2, topics.year_windows(2000, 2002, 2, 2)).collect()}
    assert len(got) == 4 and got[2000, 0]["papers_total"] == 2 and got[2000, 0]["papers_predicted"] == 1 and got[2000, 0]["mean_probability"] == 0.8 and got[2000, 1]["dominant_papers"] == 0
    assert got[2002, 0]["papers_total"] == 0 and got[2002, 0]["mean_probability"] is None


def test_search_language(spark):
    q = search.Query.parse('genome "covid 19" category:Bio from:2020-01-01')
    assert q.terms == ("genome", "covid 19") and q.scope == {"category": "Bio", "from": "2020-01-01"}
    with pytest.raises(ValueError):
        search.Query.parse("from:2020")
    rows = spark.createDataFrame([("1", "Genomes and COVID  19", "", "2021-01-01", "bio"), ("2", "metagenome covid 19", "", "2021-01-01", "bio"), ("3", "genome covid 19", "", "2019-01-01", "bio")], "paper_id string, title string, abstract string, publication_date string, category string")
    assert [r["paper_id"] for r in search.scan_archive(rows, q, 5).collect()] == ["1"]
    with pytest.raises(ValueError):
        search.select_papers(rows, "random")


def test_author_match(spark):
    rows = spark.createDataFrame([("José", "García", None), ("J.", "Garcia", None), ("Juan", "Garcia", None), ("X", "Y", "https://orcid.org/0000-0002-1825-0097")], "given string, family string, ORCID string")
    rows = rows.select(F.array(F.struct("given", "family", "ORCID", F.array().cast("array<struct<name:string>>").alias("affiliation"))).alias("a"))
    assert [r[0] for r in rows.select(search.author_matches(F.col("a"), "García", "Jose", "0000-0002-1825-0097")).collect()] == [True, True, False, True]


RECIPE = {"record definition": {"subject": "gaps", "singular": "gap", "plural": "gaps", "unit": "eV", "identity fields": ["material"]}, "search fields": {"material": {"prompt": "Which material?", "aliases": ["compound"]}, "gap": {"prompt": "Band gap", "unit": "eV", "example": 1.1}}}


def test_recipe_to_records(spark):
    recipe = extract.Recipe.from_json(json.dumps({"gaps": RECIPE}))
    assert recipe.column_for("Compound") == "material" and recipe.column_for("Gap (eV)") == "gap" and recipe.column_for("other") is None
    with pytest.raises(ValueError):
        extract.Recipe.from_json(json.dumps({"record definition": {}}))

    def model(prompt):
        if "bad" in prompt:
            raise RuntimeError("no")
        return 'Sure: [{"material": "Si", "gap": 1.1}]'

    papers = spark.createDataFrame([("1", "10.1/x", "good text"), ("2", "", "bad text")], "paper_id string, doi string, full_text string")
    answers = extract.ask_model(extract.chunk_plan(papers), recipe, model)
    assert {r["paper_id"]: r["status"] for r in extract.paper_status(answers).collect()} == {"1": "succeeded", "2": "failed"}
    records = extract.records_with_provenance(answers, papers, recipe).collect()
    assert len(records) == 1 and records[0]["gap"] == "1.1" and records[0]["Paper id"] == "1" and records[0]["doi"] == "10.1/x"


def test_store_and_units(spark, tmp_path):
    recipe = extract.Recipe.from_json(json.dumps(RECIPE))
    a = spark.createDataFrame([("Si", "1.1")], "compound string, `gap eV` string")
    out = extract.store_results(a.select(F.col("compound").alias("material"), F.col("gap eV").alias("gap")), [a, a], recipe)
    assert [tuple(r) for r in out.collect()] == [("Si", "1.1")]
    extract.write_swapped(out, f"{tmp_path}/t")
    extract.write_swapped(out.limit(0), f"{tmp_path}/t")
    assert spark.read.schema(out.schema).parquet(f"{tmp_path}/t").count() == 0
    row = spark.range(1).select(extract.convert_units(F.lit("25.0"), F.lit("C"), "K").alias("k"), extract.convert_units(F.lit("n/a"), F.lit("C"), "K").alias("n"), extract.convert_units(F.lit("1"), F.lit("??"), "K").alias("u")).first()
    assert row["k"] == 298.15 and row["n"] is None and row["u"] is None


def test_download_falls_back(spark):
    rows = spark.createDataFrame([(1, None, bytearray(b"%PDF-1"), "down"), (2, bytearray(b"html"), None, "")], "paper_id int, a_pdf binary, b_pdf binary, a_error string")
    got = {r["paper_id"]: r for r in download.pick_content(rows, "pdf", ["a", "b"]).collect()}
    assert got[1]["source"] == "b" and got[2]["status"] == "failed"

    def broken(row):
        raise OSError("no route")

    live = {r["paper_id"]: r for r in download.download(rows.select("paper_id"), "text", {"x": broken, "y": lambda row: "text" if row["paper_id"] == 1 else None}).collect()}
    assert live[1]["source"] == "y" and live[2]["last_error"] == "x: no route"


def test_registry():
    assert registry.resolve_names("search", ["arxiv", "core"]) == ["core", "arxiv"]
    with pytest.raises(ValueError):
        registry.resolve_names("search", ["unpaywall"])
    with pytest.raises(ValueError):
        registry.resolve_names("search", ["nope"])


def test_lda_iteration_is_a_complete_pass(spark):
    from pyspark.ml.linalg import Vectors

    n = 200
    vectors = spark.createDataFrame([(Vectors.sparse(n, [i], [50.0]),) for i in range(n)], ["counts"])
    weights = topics.train_lda(vectors, 2, seed=3, iterations=1).topicsMatrix().toArray()
    assert weights.sum(1).min() > 8  # a term stays near 2 if its only document is not in the batch


def test_lda_query_uses_the_whole_vocabulary_and_all_passes(spark, monkeypatch):
    from quillmill.plans import catalogue

    asked = {}
    vocabulary, train = topics.vocabulary, topics.train_lda
    monkeypatch.setattr(topics, "vocabulary", lambda rows, **kw: asked.update(kw) or vocabulary(rows, **kw))
    monkeypatch.setattr(topics, "train_lda", lambda rows, k, **kw: asked.update(kw) or train(rows, k, **kw))
    assert catalogue.lda_topics(spark, "/root/testdata/sf0.001").count() > 0
    assert asked.get("max_features", 20_000) >= 20_000 and asked.get("iterations", 20) >= 20


def test_components_of_a_chain_take_few_rounds(spark, monkeypatch):
    tables, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or plain(df, name))
    n = 4096
    edges = spark.createDataFrame([(k, k + 1) for k in range(n - 1)], "a long, b long")
    got = components(edges).collect()
    assert len(got) == n and {r["component"] for r in got} == {0} and tables.count("step") <= 15


def test_names_with_any_accent(spark):
    people = [("Karel", "Čapek", None, []), ("Paul", "Erdős", None, [("Magyar Tudományos Akadémia",)])]
    rows = spark.createDataFrame([(people,), (None,)], "authors array<struct<given:string,family:string,ORCID:string,affiliation:array<struct<name:string>>>>")
    hit = lambda *a, **k: [r["x"] for r in rows.select(search.author_matches(F.col("authors"), *a, **k).alias("x")).collect()]
    assert hit("Capek", "K") == [True, None] and hit("Erdos", "P.")[0] and hit("Erdős", "Paul", affiliation="tudomanyos")[0]
    assert not hit("Erdos", "Paul", affiliation="Elsewhere")[0] and not hit("Cape")[0]


def test_endless_patterns_are_given_up(spark):
    """A pattern that backtracks without end leaves a paper unavailable, unless another rule decides."""
    f = RegexFilter("f", (Pattern("slow", "(a|aa)+$"), Pattern("quick", "fine")), (Pattern("veto", "stop"),), ("title",), timeout_ms=50)
    assert f.backtracks and not RegexFilter("g", (Pattern("p", "(ab)+c"),)).backtracks
    rows = spark.createDataFrame([("1", "a" * 60 + "b"), ("2", "a" * 60 + "b fine"), ("3", "a" * 60 + "b stop"), ("4", "aaa"), ("5", "none b"), ("6", " "), ("7", None)], "paper_id string, title string")
    got = {r["paper_id"]: r["s"] for r in rows.select("paper_id", status_name(f.status()).alias("s")).collect()}
    assert got == {"1": "unavailable", "2": "included", "3": "excluded", "4": "included", "5": "excluded", "6": "unavailable", "7": "unavailable"}
    plain = RegexFilter("p", (Pattern("a", "alpha"), Pattern("b", "beta")), (Pattern("v", "veto"),), ("title", "full_text"), include_mode="all")
    rows = spark.createDataFrame([("alpha", "beta"), ("ALPHA beta", ""), ("alpha", ""), ("veto", "alpha beta"), ("x", "y"), (None, "beta alpha")], "title string, full_text string")
    assert all(r["a"] == r["b"] for r in rows.select(plain.status().alias("a"), plain.bounded_status().alias("b")).collect())


def test_stored_filters(spark):
    papers = spark.createDataFrame([("1", "alpha"), ("2", "beta")], "paper_id string, title string")
    stack, results = FilterStack().apply_stored(RegexFilter("a", (Pattern("r", "alpha"),)), papers, None)
    stack, results = stack.apply_stored(RegexFilter("b", (Pattern("r", "beta"),)), papers, results, "or")
    scored = papers.withColumn("scores", F.create_map(F.lit(0), F.when(F.col("paper_id") == "1", 0.9).otherwise(0.1))).withColumn("dominant_topic", F.lit(0)).withColumn("prediction_status", F.lit("predicted"))
    stack, results = stack.apply_stored(TopicFilter("t", "m", (TopicRule("likely", 0, 0.5),)), scored, results, "and")
    final = lambda: {r["paper_id"]: r["final_status"] for r in stack.recompute(papers, results).collect()}
    assert stack.expression() == "((a OR b) AND t)" and final() == {"1": "included", "2": "excluded"}
    results = stack.refresh_topics(scored.withColumn("scores", F.create_map(F.lit(0), F.lit(0.7))), results, "m")
    assert final() == {"1": "included", "2": "included"} and results.count() == 6
    assert FilterStack.from_json(stack.to_json()) == stack
    stack, results = stack.apply_stored(RegexFilter("a", (Pattern("r", "nothing"),)), papers, results, override=True)
    assert final() == {"1": "excluded", "2": "included"}
    stack, results = stack.reset_stored(results, "t")
    assert results.select("filter").distinct().count() == 2 and stack.reset_stored(results)[1].count() == 0


def test_paper_content(spark):
    papers = spark.createDataFrame([("1", "T"), ("2", ""), ("3", "U")], "paper_id string, title string")
    assets = spark.createDataFrame([("1", "text", "body\nReferences\nx"), ("1", "pdf", "pdf text"), ("2", "abstract", "A"), ("2", "pdf", "pdf text")], "paper_id string, role string, content string")
    got = {r["paper_id"]: r for r in paper_content(papers, assets).collect()}
    assert got["1"]["full_text"].strip() == "body" and got["1"]["unavailable"] == ["abstract"]
    assert (got["2"]["abstract"], got["2"]["full_text"], got["2"]["unavailable"]) == ("A", "pdf text", ["title"]) and got["3"]["unavailable"] == ["abstract", "full_text"]


def test_swaps_survive_crashes(spark, tmp_path):
    rows, path = spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "t")
    extract.write_swapped(rows, path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # a crash between the two moves
    (tmp_path / "t.new").mkdir()
    extract.write_swapped(rows.unionByName(rows), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.old").exists() and not (tmp_path / "t.new").exists()
    (tmp_path / "t").rename(tmp_path / "t.old")
    extract.recover_swap(spark, path)
    assert spark.read.parquet(path).count() == 2
    csv = str(tmp_path / "c")
    extract.append_csv(spark.createDataFrame([("a", 'say "x"\nnext')], "m string, n string"), csv)
    extract.append_csv(spark.createDataFrame([("b", 2)], "m string, z int"), csv)
    assert sorted(tuple(r) for r in extract.read_csv(spark, csv).select("m", "n", "z").collect()) == [("a", 'say "x"\nnext', None), ("b", None, "2")]


def test_status_and_assets(spark):
    papers = corpus.normalize_papers(spark.createDataFrame([("1", "10.1/x", "succeeded", 3), ("2", "", "failed", 0)], "paper_id string, doi string, text_status string, num_text_materials int"))
    row = corpus.pipeline_status(papers).first().asDict()
    assert (row["papers"], row["with_doi"], row["with_text"], row["failed"], row["num_text_materials"]) == (2, 1, 1, 1, 3)
    changed = corpus.set_enrichment_status(papers, spark.createDataFrame([("1", "partial")], "paper_id string, enrichment_status string"))
    assert {r["paper_id"]: r["enrichment_status"] for r in changed.collect()} == {"1": "partial", "2": "pending"}
    with pytest.raises(Exception, match="not an enrichment status: done"):
        corpus.set_enrichment_status(papers, spark.createDataFrame([("1", "done")], "paper_id string, enrichment_status string")).collect()
    stored = corpus.blobs(spark.createDataFrame([("old",), ("new",)], "content string"))
    ids = {r["content"]: r["blob_id"] for r in stored.collect()}
    assets = spark.createDataFrame([("1", "text", "a", ids["old"], "2020", 1), ("1", "text", "b", ids["new"], "2021", 2)], "paper_id string, role string, source string, blob_id string, created_at string, asset_seq int")
    assert corpus.get_asset(assets, stored, "1", "text").first()["content"] == "new" and corpus.get_asset(assets, stored, "1", "text", "a").first()["content"] == "old"
    assert corpus.get_asset(assets, stored, "9", "text").count() == 0
    kids = spark.createDataFrame([("1", "a", 2), ("1", "b", 1), ("1", "a", 1), ("2", "a", 1)], "paper_id string, scheme string, position int")
    assert [r["position"] for r in corpus.children(kids, "1", scheme="a").collect()] == [1, 2]
    assert {r["status"]: r["n"] for r in corpus.run_summary(kids.select(F.lit("failed").alias("status"))).collect()} == {"succeeded": 0, "failed": 4}


def test_topic_storage(spark):
    rows = spark.createDataFrame([("1", [0.25, 0.75], 1, "predicted"), ("2", None, None, "no_vocabulary_terms")], "paper_id string, distribution array<double>, dominant_topic int, prediction_status string")
    stored = topics.store_scores(None, rows, "lda:1", "first")
    assert stored.count() == 3 and stored.where("is_dominant").first()["topic_id"] == 1
    stored = topics.store_scores(stored, rows, "lda:2", "second")
    assert topics.store_scores(stored, rows, "lda:1", "first").count() == 6
    for model, name in (("lda:3", "first"), ("lda:1", "third")):
        with pytest.raises(ValueError):
            topics.store_scores(stored, rows, model, name)
    named = {r["topic_id"]: r["topic_name"] for r in topics.name_topics(stored.where("topic_id is not null"), {1: "acids"}).collect()}
    assert named == {0: "topic_0", 1: "acids"}
    assert topics.load_domain_stopwords(["Cell  # biology", "", "# none", "ACID", "cell"]) == ("acid", "cell")


def test_model_quality(spark):
    tokens = spark.createDataFrame([(str(i), ["acid", "base"] * 3 if i % 2 else ["cell", "gene"] * 3) for i in range(40)], "paper_id string, tokens array<string>")
    vectors = topics.vectorize(tokens, ["acid", "base", "cell", "gene"])
    model = topics.train_lda(vectors, 2, seed=1)
    whole, some = topics.evaluate(model, vectors), topics.evaluate(model, vectors, 10)
    assert whole["metrics_scope"] == "complete" and some["metrics_scope"] == "sample" and whole["log_likelihood"] < some["log_likelihood"] < 0
    assert 1 < whole["perplexity"] < 8


def test_bigrams_stay_within_segments(spark):
    got = spark.range(1).select(topics.features(F.lit("band gap. the gap of oxide; thin film, x é1 b2"), ("film",)).alias("t")).first()["t"]
    assert got == ["band", "gap", "band_gap", "gap", "oxide", "gap_oxide", "thin", "b2", "thin_film", "film_b2"]
