"""A new session keeps the rows of unions, whichever package runs first."""

from plantmill.operators import results

OPTION = "spark.sql.unionOutputPartitioning"


def test_upsert_first(spark):
    own = spark.newSession()
    own.conf.set(OPTION, "true")
    old = own.createDataFrame([(k, "old") for k in range(500)], "plant_id long, value string")
    new = own.createDataFrame([(k, "new") for k in range(400, 900)], "plant_id long, value string")
    got = {r.plant_id: r.value for r in results.upsert(old, new, ["plant_id"]).collect()}
    assert own.conf.get(OPTION) == "false" and got == {k: "old" if k < 400 else "new" for k in range(900)}
