"""What a reviewer found on larger tables and odd inputs."""

from factloom.operators import text


def test_what_a_cut_leaves_in_front_does_not_stand_alone(spark):
    """A long line's second part begins with a bar; it is packed with what follows."""
    line = "a" * 18 + " | b c"
    docs = spark.createDataFrame([(1, line + "\nend")], "doc_id long, text string")
    got = [(r["kind"], r["text"]) for r in text.chunks(docs, 20).orderBy("idx").collect()]
    assert got == [("paragraph", "a" * 18), ("table", "| b c\n\nend")]
