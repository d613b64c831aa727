"""Pseudonyms: forms stay, equal values stay linked, unequal ones stay apart, the key undoes them; edge cases."""

import re

from pyspark.sql import functions as F

from terrasheaf.llm import pii, queries

SF = "/root/testdata/sf0.001"


def shape(v):
    return re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v)))


def changed(spark, values, **more):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")
    return [r["text"] for r in pii.pseudonymize(df, "k", **more).orderBy("id").collect()]


def test_forms_stay_and_can_be_undone(spark):
    values = [
        "8.2.1984", "08.02.1984", "12.2.1984", "8.12.1984", "31.1.1999", "29.2.1984", "29.02.1984", "5/20/2001", "12/31/1999", "2/29/2096", "02/29/1804", "31/12/1999", "2004-02-29", "1800-01-01", "2199-12-31",
        "a.b@c.com", "A.B@c.com", "x@y.org", "Ab9_z.Q@Mail.Example.ORG", "someone.with-a.very.long.name.1234567890.abcdefghijklmnop@h.net",
        "123-45-6789", "(293) 555-9179", "+1 293 555 9179", "4111 1111 1111 1111", "4111111111111111", "8.196.197.208", "0.0.0.1",
    ]
    new = changed(spark, values)
    for old, v in zip(values, new, strict=True):
        if "@" not in old and not re.fullmatch(r"[0-9.]+", old) or re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]{4}", old):
            assert shape(v) == shape(old), (old, v)
        elif "@" in old:
            assert shape(v.split("@")[0]) == shape(old.split("@")[0]) and v.split("@")[1] == old.split("@")[1]
    assert len(set(new)) == len(values) and sum(a == b for a, b in zip(values, new, strict=True)) <= 1
    assert changed(spark, new, undo=True) == values
    kept = ["1799-12-31", "2200-01-01", "30.2.1984", "8.1.1.256", "08.1.1.1", "000-12-3456", "4111111111111112", "31/04/2001", ""]
    assert changed(spark, kept) == kept


def test_permutations_on_small_domains(spark):
    days = spark.sql("select date_format(d, 'd.M.yyyy') text from (select explode(sequence(date'1990-01-01', date'1993-12-31')) d)")
    out = pii.pseudonymize(days, "k").withColumn("old", F.lit(0))
    assert out.select("text").distinct().count() == days.count()
    back = pii.restore(pii.pseudonymize(days.withColumn("was", F.col("text")), "k"), "k", result_col="again")
    assert back.filter("text <> was").count() == 0
    leaps = [f"29.2.{y}" for y in range(1800, 2200) if (y % 4 == 0 and y % 100) or y % 400 == 0]
    assert sorted(changed(spark, leaps)) == sorted(leaps) and len(leaps) == 97
    late = [f"{d}.1.{y}" for y in (1800, 1999, 2199) for d in (29, 30, 31)]
    assert all(int(v.split(".")[0]) > 28 for v in changed(spark, late)) and len(set(changed(spark, late))) == 9


def test_rows_and_columns(spark):
    long = "x " * 100_000 + "a.b@c.com " + "1 2 " * 50_000
    rows = [(1, None, 5), (1, "", 5), (2, "a.b@c.com", 5), (2, "a.b@c.com", 5), (None, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Pii2 int")
    out = pii.pseudonymize(df, "k").collect()
    assert [r["text"] for r in out[:2]] == [None, ""] and out[2]["text"] == out[3]["text"] and out[2]["text"] in out[4]["text"]
    assert [r["pii"]["n_email"] for r in out] == [0, 0, 1, 1, 1] and len(out[4]["text"]) == len(long)
    assert pii.pseudonymize(df.limit(0), "k").count() == 0


def test_query(spark):
    """Every text but for its matches is as it was, and the query's texts can be restored."""
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("was"))
    new = queries.op6_pii(spark, SF).select("doc_id", "text", F.expr("n_email + n_ip + n_ssn + n_phone + n_date + n_card").alias("n"))
    assert new.count() == texts.count() and new.agg(F.sum("n")).first()[0] > 0
    back = pii.restore(new, queries.PII_KEY).join(texts, "doc_id")
    assert back.filter("not (text <=> was)").count() == 0
    pattern = re.compile("|".join(pii.PATTERNS.values()))
    for r in new.join(texts, "doc_id").filter("n > 0").limit(40).collect():
        assert pattern.sub("", r["text"]) == pattern.sub("", r["was"])
