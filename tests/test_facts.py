"""Facts: the searches find what the patterns say, and distinct facts are kept without sorting all of them."""

import random

from pyspark.sql import functions as F

from faultline.operators import contributions as cn, facts as fa

PIECES = [
    "Alert Rule : ", "Source: ", "DbContext", "dbcontext", "OrderDbContext", "sp", "USP", "eo_", "dbo", "dbo.Get", "EXEC ", "execute\t", "select", "a.b", " @", "\n", " ", ".",
    "Exception", "exception", "System.X", "ClientConnectionId: ", "0" * 36, "correlation id = ", "Correlation-ID:", "CorrelationId", "Error Number: -", "2", "CommandTimeout='3'",
    'Failed executing DbCommand ("1,2"ms)', "https://", "HTTP ", "http status: 503", "/api/", "{x}", "_", "é", "K", "ſ", "9", "x", "Aa1", "-", "HTTP=", "Signal", "firstcdn.com",
]


def texts(spark, n=3000):
    rnd = random.Random(5)
    rows = [(f"t{i:05d}", "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 14)))) for i in range(n)]
    return spark.createDataFrame(rows, "id string, text string").repartition(4)


def test_searches_match_the_patterns(spark):
    rows = texts(spark)
    for no, search in fa.FACT_SEARCH.items():
        *_, pattern, group = fa.FACT_PATTERNS[no]
        for g in {0, group}:
            if g == 0 and fa.FACT_PATTERNS[no][1] == "DatabaseOperation":
                continue  # only its group is read
            both = rows.select("text", *[F.regexp_extract_all("text", F.lit(p), F.lit(g)).alias(n) for p, n in ((pattern, "a"), (search, "b"))])
            assert both.where("a <> b").collect() == [], pattern
            assert both.where("size(a) > 0").count() > 0, pattern


def test_distinct_facts_are_the_best_of_all(spark, monkeypatch):
    rows = texts(spark)
    want = fa.dedupe_keep_best(fa.log_facts(rows), ["type", "key", "value"], [F.col("pattern_no"), F.col("id"), F.col("match_no")])
    want = sorted(map(str, want.collect()))
    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting)
    for kept in (fa.GROUPS_IN_MEMORY, 3):  # in memory, and sorted beyond three groups
        monkeypatch.setattr(fa, "GROUPS_IN_MEMORY", kept)
        got = cn.log_fact_table(rows, [F.col("id")])
        assert sorted(map(str, got.collect())) == want and spark.conf.get(setting) == before


def test_distinct_facts_hash_before_they_sort(spark, monkeypatch):
    plans = []

    def keep(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(fa, "staged", keep)
    cn.log_fact_table(texts(spark, 10), [F.col("id")])
    assert "ObjectHashAggregate" in plans[0] and "SortAggregate" not in plans[0]
