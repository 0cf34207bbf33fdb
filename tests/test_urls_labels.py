"""Parts of URLs against Python's own parser, documents with labels against brute force, in Spark and in the SQL."""

import random
from urllib.parse import urlsplit

import duckdb
from pyspark.sql import functions as F

from docquire import registry
from docquire.functions.urls import url_parts
from docquire.plans import summaries

URLS = [
    None, "", "http://a.example.com", "HTTPS://User:pw@Www.Example.COM:8080/a//b/?x=1&&y=2#top", "http://[2001:db8::1]:81/p?q", "http://10.0.0.7/x",
    "//host.example/only", "/just/a/path?x#y", "mailto:someone@example.com", "http://h?#", "http:///nohost", "ftp://h:/p", "http://h/p?a=b?c#d#e", "x" * 20_000, "http://h/\nline?q\n#f\n",
]


def expected(url):
    if url is None:
        return (None,) * 9
    u = urlsplit(url.replace("\n", "%0A"))  # the parser itself drops line breaks
    netloc = u.netloc.rpartition("@")[2]
    host = (netloc[: netloc.index("]") + 1] if netloc.startswith("[") else netloc.partition(":")[0]).lower()
    names = host.split(".")
    site = ".".join(names[-2:]) if len(names) > 1 and names[-1][:1] not in "0123456789" and not host.startswith("[") else None
    filled = lambda text, at: sum(1 for x in text.split(at) if x)
    back = lambda text: text.replace("%0A", "\n") or None
    return u.scheme or None, host or None, u.port, site, back(u.path), back(u.query), back(u.fragment), filled(u.path, "/"), filled(u.query, "&")


def test_url_parts(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = pages.select("page_id", *(p.alias(n) for n, p in url_parts(F.col("url")).items())).collect()
    known = {i: expected(u) for i, u, _ in rows}
    assert {r["page_id"]: tuple(r)[1:] for r in got} == known
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    answer = db.sql(registry.ORACLE_SQL["url_parts"])
    assert sorted(map(tuple, got)) == sorted(tuple(r[answer.columns.index(c)] for c in got[0].__fields__) for r in answer.fetchall())
    assert pages.limit(0).select(*url_parts(F.col("url")).values()).collect() == []


def test_labelled_documents(spark):
    rng = random.Random(4)
    docs = [(rng.choice([None, *range(30)]), rng.choice(["en", None]), "s") for _ in range(60)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, 1, None]), rng.choice([0, 1, None])) for _ in range(50)] + [(7, 1, 0)] * 40

    def row(doc):
        of = [x for x in labels if x[0] is not None and x[0] == doc[0]]
        values = [{x[i] for x in of if x[i] is not None} for i in (1, 2)]
        quality, toxic = (min(v) if len(v) == 1 else None for v in values)
        return (*doc, len(of), quality, toxic, ",".join(n for n, v in zip(("quality", "toxic"), values) if len(v) > 1))

    some = spark.createDataFrame([(*d, "text", 5) for d in docs], "doc_id long, lang string, source string, text string, quality int")
    marks = spark.createDataFrame([(*x, "fr") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = summaries.labelled(some, marks)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(row, docs), key=repr)
    assert summaries.labelled(some.limit(0), marks).collect() == []
    assert {tuple(r)[3:] for r in summaries.labelled(some, marks.limit(0)).collect()} == {(0, None, None, "")}


def test_profile_and_summary(spark):
    texts = [None, "", " \n ", "a b  a", "x " * 50_000, "\u00e9 \u00e9\tb"]
    docs = spark.createDataFrame([(i, t, None if i % 2 else "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["length"], r["n_words"], r["n_distinct"]) for r in summaries.profile(docs).collect()}
    words = lambda t: (t or "").split()
    assert got == {i: (None if t is None else len(t), len(words(t)), len(set(words(t)))) for i, t in enumerate(texts)}
    total = [r for r in summaries.corpus_summary(docs).collect() if r["n_docs"] == len(texts)]
    assert [r["n_chars"] for r in total] == [sum(len(t or "") for t in texts)]
    assert summaries.corpus_summary(docs.limit(0)).where("lang is not null").collect() == []
