import re

from pyspark.sql import functions as F

from quillmill.functions import identifiers as ids
from quillmill.functions import textops
from quillmill.functions.nulls import fill, first_value


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


def test_blank_is_missing(spark):
    assert one(spark, first_value("a", "b"), a="  ", b=" y ") == "y"
    assert one(spark, fill("a", "b"), a="", b="new") == "new"
    assert one(spark, fill("a", "b"), a="old", b="new") == "old"


def test_dois(spark):
    assert one(spark, ids.match_doi("a"), a=" DOI:https://doi.org/10.1000/ABC.. ") == "10.1000/abc"
    assert one(spark, ids.match_doi("a"), a=None) == ""
    assert one(spark, textops.clean_doi("a"), a="https://dx.doi.org/10.1000/a%2Fb?x=1#y") == "10.1000/a/b"
    assert one(spark, textops.clean_doi("a"), a="doi: 10.1000/(x)).") == "10.1000/(x)"
    for raw, bare in ((None, ""), (" ", ""), ("10.1/A+b%", "10.1/a+b%"), ("https://doi.org/10.1/a+b%zz", "10.1/a+b%zz"), ("&lt;10.1/x&gt;", "<10.1/x>"), ("10.1/x&gt;", "10.1/x"), ("10.1/“x”", '10.1/"x'), ("10.1\u200b/x\u2010y.;)", "10.1/x-y"), ("(10.1/x)", "(10.1/x)"), ("DOI : 10.1/[x]]].", "10.1/[x]"), (".", "")):
        assert one(spark, textops.clean_doi("a"), a=raw) == bare, raw
    text = "See 10.1234/one and doi:10.1234/two, 10.1234/one. Wrap 10.5555/\n three; journal 10.1111/(issn)1234"
    assert one(spark, textops.extract_dois("a"), a=text) == ["10.1234/one", "10.1234/two", "10.5555/three"]
    assert one(spark, textops.extract_dois("a"), a="https://doi.org/10.1002/x%28y%29?z, 10.1207/ab&12_3 or 10.1234/Q. 10.1234/q") == ["10.1234/q", "10.1002/x(y)", "10.1207/ab&12_3"]
    assert one(spark, textops.extract_dois("a"), a=None) == one(spark, textops.extract_dois("a"), a="none here") == []
    assert one(spark, textops.extract_dois("a"), a="x 10.1234/Ab­\ncd.") == ["10.1234/abcd"]


def test_titles_and_years(spark):
    assert one(spark, ids.title_key("a"), a="  Über-große Säfte: 2! ") == "über große säfte 2"
    assert one(spark, ids.first_year("a"), a="x 12024 y 2024") == "1202"
    assert one(spark, ids.publication_year("a"), a="x 12024 y 2024") == 2024
    assert one(spark, ids.publication_year("a"), a="none") is None


def test_identifiers(spark):
    assert one(spark, ids.arxiv_id("a"), a="https://arxiv.org/abs/2101.01234v3") == "2101.01234"
    assert one(spark, ids.arxiv_id("a"), a="arXiv:Math.ag/0101001v1") == "math.AG/0101001"
    assert one(spark, ids.arxiv_version("a"), a="2101.01234v3") == 3
    assert one(spark, ids.preprint_stem("a"), a="10.1101/2020.01.01.123456v2") == "10.1101/2020.01.01.123456"
    assert one(spark, ids.pmcid("a"), a="pmc 123") == "PMC123" and one(spark, ids.pmcid("a"), a="x") == ""
    assert one(spark, ids.orcid("a"), a="https://orcid.org/0000-0002-1825-0097") == "0000-0002-1825-0097"
    assert one(spark, ids.orcid("a"), a="0000-0002-1825-0098") == ""
    assert one(spark, ids.short_openalex_id("a"), a="https://openalex.org/W12/") == "W12"
    got = one(spark, ids.fallback_id(F.col("t"), F.lit("2020"), F.lit("A"), F.col("d"), pmid=F.col("p")), t="T", d="", p="7")
    assert got == "pmid:7"


def test_names_and_dates(spark):
    assert one(spark, ids.author_list("a"), a="Curie, Marie; The Group ;Bohr, N.") == "Marie Curie; The Group; N. Bohr"
    assert one(spark, ids.journal_name("a"), a="Phys. Rev. B 12 (2001) 3") == "Phys. Rev. B"
    assert one(spark, ids.month_number("a"), a="September") == 9
    assert one(spark, ids.date_text(F.lit(2020), F.lit(3), F.lit(None).cast("int"))) == "2020-03"
    assert one(spark, ids.date_parts_text(F.array(F.array(F.lit(2020), F.lit(3), F.lit(4))))) == "2020-03-04"


def test_texts(spark):
    assert one(spark, textops.merge_lists("a", "b"), a="x; y", b="y;;z") == "x;y;z"
    assert one(spark, textops.clean_text("a"), a=" N/A ") == "" and one(spark, textops.clean_text("a"), a=" a\n b ") == "a b"
    body = "Intro references here.\nReferences\nold\n2. REFERENCES \n[1] x"
    assert one(spark, textops.trim_references("a"), a=body).rstrip() == "Intro references here.\nReferences\nold"
    assert one(spark, textops.trim_references("a"), a="no heading") == "no heading"
    assert one(spark, textops.slug("a"), a=" A/b: c.txt ") == "A_b_c.txt"
    index = F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2)))
    assert one(spark, textops.text_from_positions(index)) == "a b a"
    assert one(spark, textops.estimated_tokens("a"), a="") == 1 and one(spark, textops.estimated_tokens("a"), a="1234567") == 3
    assert one(spark, textops.normalize_topic_text("a"), a="<b>Go</b> &amp; SEE https://x.y/z doi:10.1000/abc ﬁne www.x.y STRASSE Straße") == "go & see doi: fine www.x.y strasse strasse"
    assert one(spark, textops.normalize_metadata("a"), a="H<sub>2</sub>O &lt;i&gt;in&lt;/i&gt; “water”…") == 'H2O in "water"...'
    assert one(spark, textops.normalize_topic_text("a"), a=None) == one(spark, textops.normalize_metadata("a"), a=None) == ""
    for text in ("References", "a\n\n  3.1) Literature cited \t\nb", "a\nBIBLIOGRAPHY", "references are in the text\nmore"):
        expected = re.split(r"(?im)^\s*(?:\d+(?:\.\d+)*[.)]?\s+)?(?:references|bibliography|literature cited)\s*$", text)[0] if "are in" not in text else text
        assert one(spark, textops.trim_references("a"), a=text).rstrip() == expected.rstrip()
    assert textops.token_budget(100, textops.token_reserve(10)) == 1000


def test_chunks_cover_the_text(spark):
    for text in ("abcdefghij", "a", "abcdefghijk"):
        for tokens in (1, 3, 4, 9):
            parts = one(spark, textops.equal_chunks("a", F.lit(tokens), 2), a=text)
            assert "".join(parts) == text and len(parts) == -(-tokens // 2) or len(text) < tokens


def test_json_repair(spark):
    assert textops.json_records('[{"a": 1}, 2]') == [{"a": 1}]
    assert textops.json_records("[]") == []
    assert textops.json_records('```json\n{"a": 1}\n```') == [{"a": 1}]
    assert textops.json_records('Here: {"a": {"b": 2}} and [{"c": 3}].') == [{"a": {"b": 2}}, {"c": 3}]
    assert textops.json_records('[{"a": 1}, {"b": 2') == [{"a": 1}]
    assert textops.json_records("nothing") is None
    assert textops.json_records("as in [1], nothing") is None and textops.json_records("```\n[]\n```") == []
    assert textops.json_records('bad {"a": } but {"b": "x]}{", "c": [1, {"d": "\\""}]} end') == [{"b": "x]}{", "c": [1, {"d": '"'}]}]
    assert textops.json_records('{"a": "line\none"}') == [{"a": "line\none"}] and textops.json_records('it"s [{"a": 1}') == [{"a": 1}]
    assert textops.json_records('{"broken": {"a": 1}, oops}') == [{"a": 1}] and textops.json_records("[" * 100_000) is None
    assert one(spark, textops.repair_json("a"), a="x") is None


def test_jats_and_nested_abstracts():
    xml = "<article><body><sec><title>One</title><p>A <xref>1</xref>b</p><table-wrap><p>no</p></table-wrap><sec><p>C</p></sec></sec></body></article>"
    assert textops.jats_paragraphs(xml) == "One\n\nA b\n\nC"
    assert textops.jats_paragraphs("<broken") == "" and textops.jats_paragraphs("<a><body><p>1</p><body><p>2</p></body></body><body><p>3</p></body></a>") == "1\n\n2"
    assert textops.nested_abstract('{"x": [{"dc:description": " An  abstract "}]}') == "An abstract"
    assert textops.nested_abstract("no") == ""


def test_images(spark):
    import struct

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    row = spark.createDataFrame([(bytearray(png),), (bytearray(b"no"),)], "c binary").select(*textops.png_size("c"), textops.data_url("c", "image/png")).collect()
    assert row[0][:2] == (640, 480) and row[1][:2] == (None, None) and row[0][2].startswith("data:image/png;base64,iVBOR")
    assert one(spark, textops.image_tokens(F.lit(640), F.lit(480))) == 85 + 170 * 2


def test_normal_forms_are_those_of_the_standard_library(spark):
    import unicodedata

    texts = ["abc", "Ouréau ä ﬁ … ①", "é ß ǅ", "", None, "한글", "AB"]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").coalesce(1)
    got = rows.select(textops.nfkc("a"), textops.fold_case("a")).collect()
    assert [tuple(r) for r in got] == [(None, None) if t is None else (unicodedata.normalize("NFKC", t), unicodedata.normalize("NFKC", t).casefold()) for t in texts]
