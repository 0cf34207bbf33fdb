"""The registered queries of the training-data operators on a small folder of tables, against brute force and the libraries."""

import base64
import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from docquire.llm import common, licences, queries
from tokenizers import Tokenizer

LETTERS = {"en": "abcdefghi", "de": "jklmnopqr", "fr": "stuvwxyzé"}


def words(rng, lang, n):
    return ["".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts in three languages with exact and near copies, shared passages, benchmark windows, licences and odd rows."""
    rng = random.Random(41)
    docs = []
    for i in range(48):
        lang = sorted(LETTERS)[i % 3]
        text = words(rng, lang, rng.randint(20, 120))
        docs.append((" ".join(text), lang))
    for i in range(8):  # near copies and exact ones
        text = docs[i][0].split()
        if i % 2:
            text[rng.randrange(len(text))] = "changed"
        docs.append((" ".join(text), docs[i][1]))
    shared = " ".join(words(rng, "en", 60))
    for _ in range(4):
        docs.append((" ".join([*words(rng, "en", 25), shared, *words(rng, "en", 25)]), "en"))
    items = [(f"{n}", " ".join(words(rng, "de", n))) for n in (30, 12, 6)] + [("0", None), ("9", "")]
    for i, (_, item) in enumerate(items[:3]):
        part = item.split()[:11]
        docs.append((" ".join([*words(rng, "de", 30), *part, *words(rng, "de", 5)]), "de"))
    docs += [(" ".join([*words(rng, "fr", 40), "MIT License, and GNU General Public License"]), "fr")]
    docs += [(None, "en"), ("", None), ("12 34 !", "de"), ("  \n", "fr"), (" ".join(words(rng, "fr", 3)), "fr"), ("<|endoftext|> abc  def\n\n ghi's", "en")]
    rows = [(3 * i + 1, t, lang, "s", len(t or ""), "x") for i, (t, lang) in enumerate(docs)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, found string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    good = {r[0]: int(i % 3 != 0) for i, r in enumerate(rows)}  # good: not written in the first language
    spark.createDataFrame([(k, q, 0) for k, q in good.items()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    vectors = np.random.default_rng(3).normal(size=(300, 24))
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int").write.parquet(f"{at}/embeddings.parquet")
    return str(at), rows, items, good, vectors


def run(spark, tables, query):
    got = query(spark, tables[0]).collect()
    return {r["doc_id"]: r for r in got} if "doc_id" in got[0] else got


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def ascii_of(text):
    return common.ascii_words((text or "").encode())


def test_op1(spark, tables):
    got = run(spark, tables, queries.op1_licence_scan)
    assert len(got) == len(tables[1])
    for key, text, *_ in tables[1]:
        w = [x.decode() for x in ascii_of(text)]
        hits = [(s, label) for s in range(len(w)) for p, label in licences.BASE.items() if w[s : s + p.count(" ") + 1] == p.split()]
        r, at = got[key], [s for s, _ in hits]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def test_op2(spark, tables):
    got = run(spark, tables, queries.op2_language_id)
    for key, text, lang, *_ in tables[1]:
        r = got[key]
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if text is None or not any(map(str.isalpha, text)):
            assert r["lang_pred"] == "und"
        elif len(text) > 30:
            assert r["lang_pred"] == lang
    assert any(r["held_out"] for r in got.values())


def test_op3(spark, tables):
    got = run(spark, tables, queries.op3_decontamination)
    for key, text, *_ in tables[1]:
        w, hit, names = ascii_of(text), set(), set()
        for name, item in tables[2]:
            x = ascii_of(item)
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit.update(range(b, b + n))
                        names.add(name)
        r = got[key]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit))
    assert sum(r["contaminated"] for r in got.values()) == 3


def test_op4(spark, tables):
    got = run(spark, tables, queries.op4_token_counts)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for key, text, *_ in tables[1]:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert tuple(got[key]) == (key, len((text or "").encode()), n, n > 1024)


def test_op5(spark, tables):
    got = run(spark, tables, queries.op5_quality)
    for key, *_ in tables[1]:
        r = got[key]
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_accuracy(spark):
    """On the driver's tables: rows that neither classifier learns from."""
    data = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = [r for r in queries.op2_language_id(spark, data).collect() if r["held_out"] and r["lang_pred"] != "und"]
    assert len(found) > 200 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in found]) >= 0.98
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    scored = [(r["score"], quality[r["doc_id"]]) for r in queries.op5_quality(spark, data).collect() if r["held_out"] and r["doc_id"] in quality]
    good, bad = ([s for s, q in scored if q == label] for label in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) >= 0.9


def test_op6(spark, tables):
    got = queries.op6_chained_passages(spark, tables[0]).collect()
    texts = {r[0]: ascii_of(r[1]) for r in tables[1]}
    covered = {}
    for r in got:
        assert r["other_id"] < r["doc_id"] and r["end"] - r["start"] >= 50 and r["share"] >= 0.75
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    seen = set()
    for key in sorted(texts):
        w = texts[key]
        runs = [(p, tuple(w[p : p + 50])) for p in range(len(w) - 49)]
        assert {q for p, x in runs if x in seen for q in range(p, p + 50)} <= covered.get(key, set())
        seen.update(x for _, x in runs)


def test_op7(spark, tables):
    got = run(spark, tables, queries.op7_suffix_array_dedup)
    raw = {r[0]: (r[1] or "").encode() for r in tables[1]}
    seen = {}
    for b in raw.values():
        for s in range(len(b) - 199):
            seen[b[s : s + 200]] = seen.get(b[s : s + 200], 0) + 1
    for key, b in raw.items():
        gone = {x for s in range(len(b) - 199) if seen[b[s : s + 200]] > 1 for x in range(s, s + 200)}
        spans = sum(x - 1 not in gone for x in gone)
        assert tuple(got[key]) == (key, len(b), len(gone), spans, sha(bytes(c for i, c in enumerate(b) if i not in gone)))


def library_ids():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_op8(spark, tables):
    got, encode = run(spark, tables, queries.op8_byte_bpe), library_ids()
    for key, text, *_ in tables[1]:
        ids = encode(text or "")
        assert tuple(got[key]) == (key, len(ids), sha(" ".join(map(str, ids))), sha(text or ""))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard_groups(rows):
    """Key to smallest key of its group, by brute force."""
    sets = {key: shingles(text) for key, text in rows}
    group = {key: key for key in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    return sets, group


def test_op9(spark, tables):
    got = run(spark, tables, queries.op9_jaccard_join)
    sets, group = jaccard_groups([r[:2] for r in tables[1]])
    assert {k: tuple(r) for k, r in got.items()} == {k: (k, len(sets[k]), group[k]) for k in sets}


def test_op10(spark, tables):
    got, vectors = queries.op10_nearest_neighbours(spark, tables[0]).collect(), tables[4]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 300, 50):
        near = unit @ unit[q]
        near[q] = -2
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(abs(near[r["vec_id"]] - r["score"]) < 1e-12 for r in mine)
        assert [r["score"] for r in mine] == sorted((r["score"] for r in mine), reverse=True)
        hits += len({r["vec_id"] for r in mine} & set(np.argsort(-near)[:5].tolist()))
    assert hits >= 0.9 * 30 and len(got) == 30


def brute_pipeline(rows, items):
    """(doc_id, text) after each of the first four stages."""
    kept = [[(r[0], r[1]) for r in rows if r[1] and any(map(str.isalpha, r[1]))]]
    group = jaccard_groups(kept[0])[1]
    kept.append([(k, t) for k, t in kept[0] if group[k] == k])
    seen, out = set(), []
    for key, text in sorted(kept[1]):
        w, bounds = ascii_of(text), [m.start() for m in __import__("re").finditer(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
        runs = [(p, tuple(w[p : p + 50])) for p in range(len(w) - 49)]
        gone = {q for p, x in runs if x in seen for q in range(p, p + 50)}
        seen.update(x for _, x in runs)
        raw, ends = text.encode(), [*bounds[1:], len(text.encode())]
        left = raw[: bounds[0]] + b"".join(raw[a:b] for i, (a, b) in enumerate(zip(bounds, ends)) if i not in gone)
        if len(gone) < len(w):
            out.append((key, left.decode()))
    kept.append(out)
    windows = [tuple(x[a : a + min(10, len(x))]) for x in map(ascii_of, (t for _, t in items)) for a in range(len(x) - min(10, len(x)) + 1) if x]
    has = lambda w, x: any(tuple(w[i : i + len(x)]) == x for i in range(len(w) - len(x) + 1))
    kept.append([(k, t) for k, t in kept[2] if not any(has(ascii_of(t), x) for x in windows)])
    return kept


def test_pipeline_against_brute_force_stage_by_stage(spark, tables):
    want, docs = brute_pipeline(tables[1], tables[2]), spark.read.parquet(f"{tables[0]}/documents.parquet")
    names = docs.columns
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want):
        docs = common.written(stage(spark, docs, tables[0]), name)
        assert docs.columns == names
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(rows), name
    assert len(want[0]) > len(want[1]) > len(want[3]) and any(t not in dict(want[1]).values() for _, t in want[2])
    encode = library_ids()
    got = {r["doc_id"]: (r["ids"], r["n_tokens"]) for r in corpus_pipeline.run(spark, tables[0]).collect()}
    assert got == {k: (encode(t), len(encode(t))) for k, t in want[3]}


def test_pipeline_of_odd_tables(spark, tables, tmp_path):
    """Names that the stages use themselves, a map column, repeated and null doc_ids, and no rows at all."""
    rng = random.Random(5)
    names = ["_row", "_row_key", "score", "lang_pred", "lang_score", "found", "row_key", "component_id", "_doc", "_spans", "text_key"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, tags map<string,int>, " + ", ".join(f"{n} int" for n in names)
    texts = [" ".join(words(rng, "en", 60)) for _ in range(5)]
    rows = [(i, t, "en", "s", 1, {"a": 1}, *range(len(names))) for i, t in [(4, texts[0]), (4, texts[1]), (4, texts[0]), (None, texts[2]), (None, texts[2] + " more"), (7, texts[3]), (9, None), (None, texts[4])]]
    docs = spark.createDataFrame(rows, schema)
    for some in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            some = common.written(stage(spark, some, tables[0]), name)
            if name == "decontamination":
                got = some.collect()
        if got:
            assert sorted((r["doc_id"] or 0, r["text"]) for r in got) in [sorted([(4, texts[0]), (4, texts[1]), (0, third), (7, texts[3]), (0, texts[4])]) for third in (texts[2], texts[2] + " more")]
            assert all([r[n] for n in names] == list(range(len(names))) and r["tags"] == {"a": 1} for r in got)
        else:
            assert some.count() == 0
