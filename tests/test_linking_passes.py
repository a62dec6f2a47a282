"""Passes over whole documents: what one has done, the next ones keep."""

from quire.operators import linking as K
from quire.plans import registry

from test_operators import items


def test_split_column_stays_split(spark):
    """Three letters in one column share a section and their entities; the merge does not put them together again."""
    rows = [(1, "Section", "ODMEVI", None), (1, "Headline", "Odmevi", 1)]
    for k in range(3):
        rows += [(1, "Subhead", f"Pismo  {k}", 1), (1, "Paragraph", "Ljubljana pravi", 1), (1, "Paragraph", "in Maribor", 1)]
    df = items(spark, rows)
    found = spark.createDataFrame([(1, p, t, "LOC") for p, r in enumerate(rows) if r[1] == "Paragraph" for t in ("Ljubljana", "Maribor")], "doc_id long, pos int, text string, label string")
    out, links = K.link_document(df, found)
    assert [r.article for r in out.orderBy("pos").collect()] == [None, 1, 1001, 1001, 1001, 1002, 1002, 1002, 1003, 1003, 1003]
    assert links.where("kind = 'article-continues'").count() == 0


def test_long_chain_of_continuations(spark):
    """More merges than there once were rounds, in one pass and without a bound."""
    rows = [x for k in range(1, 81) for x in ((k, "Headline", "Potopis" if k == 1 else "", k), (k, "Paragraph", "nadaljuje se", k))]
    none = spark.createDataFrame([], "doc_id long, pos int, article long, key string")
    w = spark.createDataFrame([], "doc_id long, key string, weight double")
    root, links = K.merged_articles(K.article_table(items(spark, rows), none, w))
    assert {r.article: r.root for r in root.collect()} == {k: 1 for k in range(1, 81)} and links.count() == 79


def test_cross_links_reach_the_result(spark):
    got = registry.queries()["pip05_link_document"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "pos", "article", "links"] and got.where("links > 0").count() > 0
