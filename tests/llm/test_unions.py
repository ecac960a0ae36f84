"""A new session keeps the rows of unions where text operators run first."""

from plantmill.llm import queries


def test_simhash_first(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.unionOutputPartitioning", "true")
    got = queries.op2_simhash(own, "/root/testdata/sf0.001")
    assert own.conf.get("spark.sql.unionOutputPartitioning") == "false" and got.select("doc_id").distinct().count() == 200
