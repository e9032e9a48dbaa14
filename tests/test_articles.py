"""Article records with what real ones leave out or spell otherwise."""

from claimloom.operators import articles

WHOLE = """<PubmedArticle><MedlineCitation Status="MEDLINE"><PMID Version="1"> 123 </PMID><Article><Journal><JournalIssue><PubDate><Year>20x1</Year><MedlineDate>2019 Nov-Dec</MedlineDate></PubDate></JournalIssue><ISOAbbreviation>J. A</ISOAbbreviation></Journal>
<ArticleTitle>CO<sub>2</sub> &amp; <i>more</i></ArticleTitle><ELocationID EIdType="pii">x</ELocationID><ELocationID EIdType="doi">10.1234/ABC</ELocationID><AuthorList><Author><LastName>Curie</LastName><Initials>M</Initials></Author><Author/><Author><CollectiveName>Group</CollectiveName></Author></AuthorList></Article>
<CommentsCorrectionsList><CommentsCorrections RefType="ErratumIn"><PMID>5</PMID></CommentsCorrections><CommentsCorrections RefType="RetractionIn"><RefSource>J</RefSource></CommentsCorrections></CommentsCorrectionsList>
<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="N">Air</DescriptorName><QualifierName MajorTopicYN="Y">analysis</QualifierName></MeshHeading><MeshHeading><DescriptorName MajorTopicYN="N">Water</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI="D1"/></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>"""


def test_records(spark):
    rows = [(1, WHOLE), (2, None), (3, ""), (4, "no xml"), (5, WHOLE[:300]), (6, "<PubmedArticle><MedlineCitation><PMID>9</PMID></MedlineCitation></PubmedArticle>")]
    got = {r.k: r for r in articles.parsed(spark.createDataFrame([(k, x, "t") for k, x in rows], "k int, xml string, notes string")).collect()}
    r = got[1]
    assert (r.addressable, r.pmid, r.title, r.authors, r.journal, r.year, r.date_text, r.doi, r.abstract) == (True, "123", "CO2 & more", ["M Curie", "Group"], "J. A", 2019, "2019 Nov-Dec", "10.1234/abc", None)
    assert (r.major, r.minor, r.retracted, r.notice) == (["Air"], ["Water"], True, None)
    for k in (2, 3, 4, 5):
        assert (got[k].addressable, got[k].pmid, got[k].title, got[k].authors, got[k].major, got[k].retracted) == (False, None, None, [], [], False), k
    assert (got[6].addressable, got[6].pmid, got[6].authors, got[6].year) == (True, "9", [], None)
