"""Summaries that merge, kept batch by batch, and form-shaped documents."""

import random
import re

import pytest
from docquire import registry
from docquire.operators import forms, publish
from docquire.plans import incremental
from pyspark.sql import functions as F

DOCS = "doc_key string, text string, lang string"


def documents(n, seed):
    rng = random.Random(seed)
    return [(str(i), rng.choice([None, "", "x" * rng.randrange(400) + str(rng.randrange(n // 2))]), rng.choice(["en", "de", None])) for i in range(n)]


def read(summary, by):
    rows = incremental.report(summary, by, {"median": 0.5, "most": 1.0}).collect()
    return {tuple(r[b] for b in by): (r["n_docs"], r["n_chars"], r["n_texts"], r["median"], r["most"]) for r in rows}


def test_merged_partials_are_a_full_count(spark):
    rows = documents(1500, 1)
    docs = spark.createDataFrame([(*r, i % 7) for i, r in enumerate(rows)], f"{DOCS}, batch int")
    parts = incremental.partials(docs, ["lang", "batch"])
    got = read(incremental.merged(parts, ["lang"]), ["lang"])
    for lang in ("en", "de", None):
        texts = [t for _, t, x in rows if x == lang]
        known = sorted(len(t) for t in texts if t is not None)
        n_docs, n_chars, n_texts, median, most = got[lang,]
        assert (n_docs, n_chars, n_texts, most) == (len(texts), sum(known), len({t for t in texts if t is not None}), known[-1])
        low, high = (known[int(len(known) * q)] for q in (0.48, 0.52))
        assert low <= median <= high
    some = parts.where("batch in (1, 4)")
    assert read(incremental.merged(some, ["lang"]), ["lang"]) == read(incremental.partials(docs.where("batch in (1, 4)"), ["lang"]), ["lang"])


def test_estimates_stay_within_the_stated_error(spark):
    docs = spark.range(60_000).select(F.col("id").cast("string").alias("text"), (F.col("id") % 3).alias("part"), F.lit(1).alias("one"))
    both = incremental.merged(incremental.partials(docs.union(docs), ["part"]).withColumn("one", F.lit(1)), ["one"])
    n = incremental.report(both, ["one"]).first()["n_texts"]
    assert abs(n / 60_000 - 1) < 0.06


def test_summary_is_exact_beyond_the_sketches(spark, tmp_path):
    """More different texts and lengths than a sketch holds, copies across sources, null and empty texts, no text at all."""
    rng = random.Random(3)
    rows = [(rng.choice(["en", None]), rng.choice(["a", "b"]), f"{i % 13_000:x}".rjust(rng.choice([5, i % 7_000 + 5]), "é")) for i in range(26_000)]
    rows += [("en", "a", None), (None, "b", ""), ("en", None, ""), ("xx", "a", None), ("xx", "b", None), ("y", "a", "one"), ("y", "b", "four"), ("y", "b", "one")]
    spark.createDataFrame(rows, "lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["lang"]: tuple(r[c] for c in ("n_docs", "n_chars", "n_texts", "median_length")) for r in registry.merged_summary(spark, str(tmp_path)).collect()}
    for lang in ("en", None, "xx", "y"):
        texts = [t for x, _, t in rows if x == lang]
        known = sorted(len(t) for t in texts if t is not None)
        assert got.pop(lang) == (len(texts), sum(known), len({*texts} - {None}), known[(len(known) + 1) // 2 - 1] if known else None)
    assert not got


def test_exact_quantiles(spark):
    docs = spark.range(100).select(F.expr("repeat('x', cast(id + 1 as int))").alias("text"), (F.col("id") % 4).alias("part"))
    parts = incremental.exact_partials(docs, ["part"])
    ranks = {f"q{i}": i / 100 for i in range(0, 101)}
    row = incremental.exact_report(incremental.exact_merged(parts, []), [], ranks).first()
    assert [row[f"q{i}"] for i in range(101)] == [1, *range(1, 101)] and (row["n_docs"], row["n_chars"], row["n_texts"]) == (100, 5050, 100)


def test_replayed_batches_change_nothing(spark, tmp_path):
    rows = documents(300, 2)
    schema = DOCS
    for i in range(3):
        spark.createDataFrame(rows[i * 100 : i * 100 + 100], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        docs = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        incremental.start(docs, f"{tmp_path}/out", f"{tmp_path}/state", ["lang"]).awaitTermination()
    kept = lambda: read(incremental.merged(spark.read.parquet(f"{tmp_path}/out"), ["lang"]), ["lang"])
    want = read(incremental.partials(spark.createDataFrame(rows, schema), ["lang"]), ["lang"])
    assert kept() == want
    again = incremental.partials(spark.createDataFrame(rows[100:200], schema), ["lang"]).withColumn("batch", F.lit(1))
    publish.publish(again, f"{tmp_path}/out", ["batch"])  # what a batch does that is run again
    assert kept() == want and spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() == 3


NAME = re.compile(r"([A-Za-z][A-Za-z0-9 _-]{0,39}):(.*)", re.S)


def parsed(text):
    """The grammar line by line."""
    if text is None:
        return []
    out, section, number, first, group, ordinal = [], "", 0, None, 0, 0
    for line in re.sub("\r\n?", "\n", text).split("\n"):
        if m := re.fullmatch(r"\[([^\[\]\n]{1,80})\][ \t]*", line):
            section, number, first, group, ordinal = m[1], number + 1, None, 0, 0
        elif m := NAME.match(line):
            if first is None:
                first = m[1]
            elif m[1] == first:
                group, ordinal = group + 1, 0
            out.append([number, section, group, ordinal, m[1], [m[2]]])
            ordinal += 1
        elif first is not None:
            out[-1][-1].append(line)
    return [(*r[:-1], "\n".join(x for x in (line.strip(" \t\r") for line in r[-1]) if x) if any(line.strip(" \t\r") for line in r[-1][1:]) else r[-1][0].strip(" \t\r\n")) for r in out]


def rows_of(spark, texts):
    found = forms.parse_forms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").collect()
    return [sorted(tuple(r)[1:] for r in found if r["doc_id"] == i) for i in range(len(texts))]


def test_forms(spark):
    form = "Date: 1 May\nstray\n\n[Person]\nnote before\nName: Ann\nStreet: Long Road\n   12 b\n\n  second line\nName: Bob\nStreet:\n[Empty]\n[Items]\nItem: a: b\nPrice: 3\r\nItem: c"
    want = [
        (0, "", 0, 0, "Date", "1 May\nstray"),
        (1, "Person", 0, 0, "Name", "Ann"),
        (1, "Person", 0, 1, "Street", "Long Road\n12 b\nsecond line"),
        (1, "Person", 1, 0, "Name", "Bob"),
        (1, "Person", 1, 1, "Street", ""),
        (3, "Items", 0, 0, "Item", "a: b"),
        (3, "Items", 0, 1, "Price", "3"),
        (3, "Items", 1, 0, "Item", "c"),
    ]
    assert rows_of(spark, [form, None, "", "no field at all", ":x\n 1a: y"]) == [want, [], [], [], []]


@pytest.mark.parametrize("seed", [4, 5])
def test_random_forms_against_the_grammar(spark, seed):
    rng = random.Random(seed)
    lines = ["Name: x", "Name:", "A b-c_1: y  ", "[S]", "[T] ", "[S] x", "", "  more", "Zip : 9", "é: no", "9: no", "Name: a: b", "\tTab: no", "Q.E: no", "[]", "A" * 50 + ": long"]
    texts = [rng.choice(["\n", "\r\n"]).join(rng.choice(lines) for _ in range(rng.randint(0, 14))) for _ in range(250)] + ["Name: " + "word\n" * 100_000]
    assert rows_of(spark, texts) == [sorted(parsed(t)) for t in texts]
