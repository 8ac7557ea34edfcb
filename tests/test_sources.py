import gzip
import os
import tempfile

import pytest

from rankspark.sources import corpus as C

ART = """<PubmedArticle><MedlineCitation><PMID Version="1">{id}</PMID>{body}</MedlineCitation></PubmedArticle>"""


def _write(path, text, gz=False):
    if gz:
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)


def _corpus():
    d = tempfile.mkdtemp(prefix="rankspark-xml-")
    a1 = ART.format(id=1, body="<Article><ArticleTitle>Plain title</ArticleTitle><Abstract><AbstractText>One part"
                               "</AbstractText></Abstract></Article><KeywordList><Keyword MajorTopicYN=\"N\">egfr"
                               "</Keyword></KeywordList>")
    a2 = ART.format(id=2, body="<Article><ArticleTitle>A <i>BRAF</i> study</ArticleTitle><Abstract>"
                               "<AbstractText Label=\"BACKGROUND\">First</AbstractText>"
                               "<AbstractText Label=\"RESULTS\">p &lt; 0.05 and x &gt; 3</AbstractText></Abstract>"
                               "</Article><KeywordList><Keyword>alpha</Keyword><Keyword>beta</Keyword></KeywordList>"
                               "<KeywordList><Keyword>gamma</Keyword></KeywordList>"
                               "<MeshHeadingList><MeshHeading><DescriptorName UI=\"D1\">Lung</DescriptorName>"
                               "</MeshHeading><MeshHeading><DescriptorName>Skin</DescriptorName>"
                               "<QualifierName>genetics</QualifierName><QualifierName>therapy</QualifierName>"
                               "</MeshHeading></MeshHeadingList>")
    a3 = ART.format(id=3, body="")
    _write(f"{d}/a.xml", f"<?xml version=\"1.0\"?>\n<!DOCTYPE PubmedArticleSet PUBLIC \"-//X//DTD//EN\" "
                         f"\"http://example.invalid/x.dtd\">\n<PubmedArticleSet>{a1}{a2}</PubmedArticleSet>")
    _write(f"{d}/b.xml.gz", f"<PubmedArticleSet>{a3}</PubmedArticleSet>", gz=True)
    return d


def test_read_articles_edge_cases(spark):
    d = _corpus()
    arts = {r.id: r for r in C.read_articles(spark, d).collect()}
    assert set(arts) == {1, 2, 3}
    assert arts[1].title == "Plain title" and arts[1].abstract == "One part" and arts[1].keywords == ["egfr"]
    assert arts[2].title == "A BRAF study"
    assert arts[2].abstract == "First p < 0.05 and x > 3"
    assert arts[2].keywords == ["alpha", "beta", "gamma"]
    mesh = [(m.description, m.name) for m in arts[2].meshHeadings]
    assert mesh == [("Lung", ""), ("Skin", "genetics"), ("Skin", "therapy")]
    assert arts[3].title == "" and arts[3].abstract == "" and arts[3].keywords == [] and arts[3].meshHeadings == []


def test_file_limit(spark):
    d = _corpus()
    assert len(C.list_corpus_files(spark, d, 1)) == 1
    assert {r.id for r in C.read_articles(spark, d, max_files=1).collect()} == {1, 2}


def test_reference_compat_blanks_markup(spark):
    arts = {r.id: r for r in C.read_articles(spark, _corpus(), reference_compat=True).collect()}
    assert arts[2].title == "" and arts[2].abstract == "" and arts[1].abstract == "One part"
    d = tempfile.mkdtemp(prefix="rankspark-xml-")
    _write(f"{d}/a.xml", "<PubmedArticleSet>" + ART.format(id=4, body="<Article><Abstract><AbstractText>one <i>b</i> two"
                                                           "</AbstractText></Abstract></Article>") + "</PubmedArticleSet>")
    assert C.read_articles(spark, d, reference_compat=True).first().abstract == ""
    assert C.read_articles(spark, d).first().abstract == "one b two"


def test_topics_attribute_or_child(spark):
    d = tempfile.mkdtemp(prefix="rankspark-topics-")
    _write(f"{d}/2020.xml", "<topics><topic number=\"1\"><disease>melanoma</disease><gene>BRAF</gene>"
                            "<treatment>x</treatment></topic><topic><number>2</number><disease>flu</disease>"
                            "<gene>g</gene><treatment>t</treatment></topic></topics>")
    t = {r.id: r for r in C.read_topics(spark, f"{d}/2020.xml", "2020").collect()}
    assert t[1].disease == "melanoma" and t[2].disease == "flu" and t[1].topic_set == "2020"


def test_qrels_and_run_text(spark):
    d = tempfile.mkdtemp(prefix="rankspark-trec-")
    _write(f"{d}/q.txt", "1 0 10 2\n1\t0  11 0\n\n2 0 12 -1\n")
    _write(f"{d}/r.txt", "1 Q0 10 1 2.5 myrun\n1 Q0 11 2 1.25 myrun\n")
    q = sorted(tuple(r) for r in C.read_qrels(spark, f"{d}/q.txt").collect())
    assert q == [(1, "0", 10, 2), (1, "0", 11, 0), (2, "0", 12, -1)]
    r = sorted(tuple(x) for x in C.read_run(spark, f"{d}/r.txt").collect())
    assert r == [(1, 10, 1, 2.5, "myrun"), (1, 11, 2, 1.25, "myrun")]


def test_xml_written_articles_read_back(spark):
    from rankspark.sinks.outputs import to_json_documents  # noqa: F401
    src = C.read_articles(spark, _corpus())
    out = os.path.join(tempfile.mkdtemp(prefix="rankspark-xmlw-"), "corpus")
    C.write_articles_xml(src.filter("id = 2"), out)
    back = C.read_articles(spark, out).collect()[0]
    assert back.id == 2 and back.keywords == ["alpha", "beta", "gamma"] and back.title == "A BRAF study"


@pytest.mark.parametrize("text, read", [("1 0 10\n", C.read_qrels), ("1 0 10 2\n\nx\n", C.read_qrels),
                                        ("1 Q0 10 1 2.5\n", C.read_run)])
def test_short_lines_fail(spark, text, read):
    d = tempfile.mkdtemp(prefix="rankspark-short-")
    _write(f"{d}/x.txt", text)
    with pytest.raises(Exception, match="line with fewer than"):
        read(spark, f"{d}/x.txt").collect()


def test_missing_ids_fail(spark):
    d = tempfile.mkdtemp(prefix="rankspark-noid-")
    _write(f"{d}/a.xml", "<PubmedArticleSet><PubmedArticle><MedlineCitation><Article><ArticleTitle>t</ArticleTitle></Article>"
                         "</MedlineCitation></PubmedArticle></PubmedArticleSet>")
    with pytest.raises(Exception, match="article without PMID"):
        C.read_articles(spark, f"{d}/a.xml").collect()
    _write(f"{d}/t.xml", "<topics><topic><disease>flu</disease></topic></topics>")
    with pytest.raises(Exception, match="topic without number"):
        C.read_topics(spark, f"{d}/t.xml", "s").collect()


def test_report_header_is_dropped(spark):
    from rankspark.sinks import outputs as S

    summary = spark.createDataFrame([(0, "num_q", 2.0), (1, "map", 0.25)], "ord int, name string, value double")
    lines = S.report_lines(summary, "mine")
    assert lines.count() == 3
    assert sorted(tuple(r) for r in S.parse_report(lines).collect()) == [("map", "0.2500"), ("num_q", "2.0000")]


def test_enrichment(spark):
    from rankspark.operators.search import enrich, lookup
    from rankspark.sinks.outputs import nested_response

    arts = spark.createDataFrame([(1, None, "x"), (2, "t", "y")], "id long, title string, abstract string")
    run = lambda *ids: spark.createDataFrame([(7, i, k, 1.0) for k, i in enumerate(ids)],
                                             "topic_id int, doc_id long, rank int, score double")
    assert {(r.doc_id, r.title, r.abstract) for r in enrich(run(1, 2), arts).collect()} == {(1, None, "x"), (2, "t", "y")}
    assert [d.article.doc_id for d in nested_response(run(2, 1), arts).first().documents] == [2, 1]
    assert {r.id for r in lookup(arts, spark.createDataFrame([(2,)], "id long")).collect()} == {2}
    for f in (lambda: enrich(run(1, 9), arts), lambda: nested_response(run(9), arts),
              lambda: lookup(arts, spark.createDataFrame([(9,)], "id long"))):
        with pytest.raises(LookupError):
            f()


def test_checkpoint_folder_is_asked_for_on_clusters():
    from types import SimpleNamespace

    from rankspark.session import checkpoint_dir

    fake = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"),
                           conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError):
        checkpoint_dir(fake)
