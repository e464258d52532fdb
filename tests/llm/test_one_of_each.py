"""One document of each component where identifiers are missing or shared."""

from collections import Counter

from sparkloom.llm import jaccard_join

CAT, DOG, SEA, SKY = ("the cat sat on the mat by the door all day", "a dog ran over the hill and far away from home", "waves of the sea rolled in and out under the moon", "clouds in the sky drifted slowly past a church tower")


def left(spark, rows):
    docs = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, source string").repartition(3)
    return Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect())


def test_rows_without_identifier(spark):
    rows = [(None, CAT), (None, CAT), (None, DOG), (None, SEA), (3, SEA), (None, ""), (None, None), (None, "")]
    assert left(spark, rows) == Counter([(None, CAT), (None, DOG), (3, SEA), (None, ""), (None, ""), (None, None)])


def test_one_identifier_on_different_texts(spark):
    rows = [(7, CAT), (7, DOG), (7, DOG), (7, ""), (2, SKY), (9, SKY), (2, SEA)]
    assert left(spark, rows) == Counter([(7, CAT), (7, DOG), (7, ""), (2, SKY), (2, SEA)])
