from datetime import datetime

import random
import re

import pytest

from docquire.functions.text import html_text
from docquire.operators import fields, publish
from docquire.plans import summaries
from docquire.sources import tables
from docquire.streaming import intake
from pyspark.sql import functions as F


def test_null_and_blank_texts_have_no_fields(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "write to a.b@c.org or a.b@c.org")], "doc_id long, text string")
    assert [tuple(r) for r in fields.extract(docs).orderBy("ordinal").collect()] == [(3, "email", 0, "a.b@c.org"), (3, "email", 1, "a.b@c.org")]


def test_a_common_value_makes_a_star(spark):
    rows = [(i, "email", 0, "x@y.z") for i in range(50)] + [(7, "email", 1, "x@y.z"), (8, "ip", 0, "1.2.3.4")]
    links = fields.link(spark.createDataFrame(rows, "doc_id long, field string, ordinal int, value string")).collect()
    assert len(links) == 49 and {r["first_doc"] for r in links} == {0}


def test_intake_drops_repeats_and_keeps_out_of_order_rows(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("documents", "1", "a", "en", "s", at(30)), ("documents", "2", "b", "en", "s", at(5)), ("documents", "1", "a", "en", "s", at(31))]
    spark.createDataFrame(rows, intake.SCHEMA).write.parquet(str(tmp_path / "in"))
    intake.start(intake.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["doc_key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_rules_match_their_pattern_on_odd_texts(spark):
    rng = random.Random(6)
    words = ["a.b@c.org", "x@y", "9x@y.z", "m@n.com9x@q.zz", "@", ".", " ", "\n", "\n\n", "Released under ", "Licensed under", "license under Z", "licence under", "1.2.3.4", "1234 5678-1234 5678", 'token = "', '"', "é"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in fields.extract(docs).collect())
    want = [(i, f, n, m) for i, t in enumerate(texts) for f, rule in fields.RULES.items() for n, m in enumerate(re.findall(rule.sql_pattern(), t or ""))]
    assert got == sorted(want) and {f for _, f, _, _ in got} == set(fields.RULES)


def test_long_lines_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "a" * 3_000_000 + " Licensed under X"), (2, "under " * 500_000)], "doc_id long, text string")
    assert [(r["doc_id"], r["field"], len(r["value"])) for r in fields.extract(docs).collect()] == [(1, "licence", 3_000_017)]


def test_quarantine_and_acceptance_split_the_records(spark):
    records = spark.createDataFrame([(1, "1.2.3.4", None), (2, "300.1.1.1", 'token = "x"'), (3, None, None)], "doc_id long, ip string, secret string")
    parts = F.transform(F.split("ip", "[.]"), lambda x: x.cast("int"))
    judged = fields.judge(records, {"ip_range": ("ip", ~F.exists(parts, lambda x: x > 255)), "no_secret": ("secret", F.col("secret").isNull())})
    good, bad = fields.route(judged)
    assert [r["doc_id"] for r in good.orderBy("doc_id").collect()] == [1, 3]
    assert [[v["rule_id"] for v in r["violations"]] for r in bad.collect()] == [["ip_range", "no_secret"]]
    assert sorted(tuple(r) for r in fields.violations(judged).collect()) == [(2, "ip_range", "ip"), (2, "no_secret", "secret")]


def test_preferred_value_by_precedence(spark):
    rows = [(1, "s", "email", 0, "b"), (2, "s", "email", 0, "b"), (1, "s", "email", 1, "a"), (5, "t", "ip", 0, "y"), (4, "t", "ip", 0, "x"), (4, "t", "ip", 1, "w")]
    got = fields.preferred(spark.createDataFrame(rows, "doc_id long, source string, field string, ordinal int, value string"), "source")
    assert sorted(tuple(r) for r in got.collect()) == [("s", "email", "b", 2, 1), ("t", "ip", "w", 1, 4)]


def test_entities_are_decoded_once(spark):
    page = spark.createDataFrame([("<p>a &amp;lt; b&nbsp;&copy; &#39;c&#39;</p><script>'</p>'</script>",), (None,)], "html string")
    assert [r[0] for r in page.select(html_text(F.col("html"))).collect()] == ["a &lt; b \u00a9 'c'", None]


def test_malformed_urls_count_as_null(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "x"), (2, "http://[bad", "y"), (3, None, "z")], "page_id long, url string, html string")
    assert {r["host"]: r["n_pages"] for r in summaries.host_counts(pages).collect()} == {"a.b": 1, None: 2}
    assert sorted(r["source"] or "" for r in tables.from_pages(pages).collect()) == ["", "", "a.b"]


def test_manifest_counts_partitions(spark, tmp_path):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(9)], "n long, part string")
    publish.publish(df, str(tmp_path / "t"), ["part"])
    read = lambda: publish.manifest(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "m"), ["part"]).collect()
    before = {r["part"]: (r["n_rows"], r["checksum"]) for r in read()}
    assert {k: v[0] for k, v in before.items()} == {"a": 6, "b": 3}
    publish.publish(spark.createDataFrame([(100, "b")], "n long, part string"), str(tmp_path / "t"), ["part"])
    after = {r["part"]: (r["n_rows"], r["checksum"]) for r in read()}
    assert after["a"] == before["a"] and after["b"][0] == 1


@pytest.mark.parametrize("hour, kept", [(2, True), (0, False)])
def test_intake_drops_rows_behind_the_watermark(spark, tmp_path, hour, kept):
    put = lambda name, key, at: spark.createDataFrame([("documents", key, "t", "en", "s", at)], intake.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    run = lambda: intake.start(intake.arriving(spark, str(tmp_path / "in" / "*")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    put("one", "1", datetime(2024, 1, 1, 2, 30))
    run()
    put("two", "2", datetime(2024, 1, 1, hour, 40))
    run()
    assert sorted(r["doc_key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == (["1", "2"] if kept else ["1"])
