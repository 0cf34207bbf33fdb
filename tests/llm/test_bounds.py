"""Bounded samples, extreme numbers, many languages and markup against a regular expression."""

import random
import re

import numpy as np
from docquire.llm import ann, langid, licences, quality
from pyspark.sql import functions as F


def test_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(2)
    directions = rng.normal(size=(60, 8))
    rows = [(i, (v * 10.0 ** rng.integers(-290, 290)).tolist()) for i, v in enumerate(directions)]
    rows += [(100, [1e-200] * 8), (101, [1e200] * 8), (102, [-5e-324] * 8), (103, [1.7e308] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, frame, k=3)
    exact = [np.array(v) / np.abs(v).max() for _, v in rows]
    exact = np.array([v / np.linalg.norm(v) for v in exact])
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()}
    assert len(found) == 3 * len(rows)
    names = [i for i, _ in rows]
    hit = 0
    for q, name in enumerate(names):
        score = exact @ exact[q]
        near = [found[name, n][0] for n in (1, 2, 3)]
        for n, other in enumerate(near):
            assert abs(found[name, n + 1][1] - score[names.index(other)]) < 1e-12 and other != name
        score[q] = -2
        hit += len(set(near) & {names[i] for i in np.argsort(-score)[:3]})
    assert hit >= 0.9 * len(found)
    assert found[100, 1][0] in (101, 103) and abs(found[100, 1][1] - 1) < 1e-12  # parallel vectors that differ by 10^400 and more
    lone = spark.createDataFrame([(1, [1e-200] * 8)], "vec_id long, embedding array<double>")
    assert ann.nearest(lone, lone).collect() == []


def test_a_hot_key_stays_within_the_sample(spark, monkeypatch):
    docs = spark.range(6000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    docs = docs.union(spark.createDataFrame([(8, "other words"), (9, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.FactorisationMachine.fit
    monkeypatch.setattr(quality.FactorisationMachine, "fit", staticmethod(lambda rows, y, **kw: seen.append(len(rows)) or fit(rows, y, **kw)))
    quality.learn(docs, labels, sample=500)
    quality.learn(docs.withColumn("text", F.lit("the same")), labels, sample=500)
    quality.learn(docs.limit(300).union(docs.where("doc_id > 7")), labels, sample=500)
    assert 300 < seen[0] <= 1000 and seen[1] <= 1000 and seen[2] == 302


def test_eleven_hundred_languages(spark):
    rng = random.Random(5)
    own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(1100)]
    rows = [(4 * i + j, f"{own[i]} {own[i]}{own[i][:4]} " * 6, f"l{i:04}") for i in range(1100) for j in range(2)]
    filters = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(filters.languages) == 1100 and filters.slots.nbytes <= 1 << 28
    some = spark.createDataFrame([(i, f"{own[i]} {own[i]}") for i in range(0, 1100, 25)], "doc_id long, text string")
    assert all(r["lang_pred"] == f"l{r['doc_id']:04}" for r in langid.identify(some, filters).collect())
    grams = {f"l{i:04}": np.arange(i, i + 4000, dtype=np.uint64) for i in range(130)}
    assert langid.LanguageFilters.build(grams, most_words=1 << 14).slots.size <= 1 << 14


def test_markup_against_a_regular_expression():
    rng = random.Random(8)

    def made(depth):
        """A random region as markup and as a regular expression over words that each have a space in front."""
        kind = rng.choice(["word", "word", "wild", "option", "either"] if depth else ["word", "wild"])
        if kind == "word":
            w = rng.choice(["red", "blue", "green"])
            return w, f"(?: {w})"
        if kind == "wild":
            n = rng.randint(1, 2)
            return f"<<{n}>>", f"(?: [a-z]+){{0,{n}}}"
        parts = [[made(depth - 1) for _ in range(rng.randint(1, 2))] for _ in range(1 if kind == "option" else rng.randint(2, 3))]
        markup, pattern = (["".join(f" {x[i]} " if i == 0 else x[i] for x in part) for part in parts] for i in (0, 1))
        return (f"[[{markup[0]}]]", f"(?:{pattern[0]})?") if kind == "option" else (f"{{{{{'|'.join(markup)}}}}}", f"(?:{'|'.join(pattern)})")

    accepted = 0
    for _ in range(300):
        parts = [made(3) for _ in range(rng.randint(1, 3))]
        automaton = licences.compile_template("t", "foo " + " ".join(m for m, _ in parts) + " end")
        pattern = re.compile(" foo" + "".join(p for _, p in parts) + " end")
        for _ in range(20):
            words = ["foo", *(rng.choice(["red", "blue", "green", "z", "end"]) for _ in range(rng.randint(0, 5))), "end"]
            ends = [i for i in range(len(words) + 1) if pattern.fullmatch("".join(f" {w}" for w in words[:i]))]
            assert automaton.match([w.encode() for w in words], 0) == max(ends, default=None), (parts, words)
            accepted += bool(ends)
    assert accepted > 500
    a = licences.compile_template("t", "foo {{ <<1>> red | <<1>> blue }} end")
    assert a.match(b"foo z red end".split(), 0) == 4 and a.match(b"foo z blue end".split(), 0) == 4
