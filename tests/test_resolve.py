"""Entities across documents: chains, hubs and merged records against brute force and a recursive query."""

import random
from collections import Counter, defaultdict

import duckdb
from docquire import registry
from docquire.operators import constraints, resolve

FIELDS = "doc_id long, field string, ordinal int, value string"


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def test_components_of_chains_hubs_and_rings(spark):
    rng = random.Random(3)
    chain = list(range(1000, 1400))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(5, i) for i in range(6, 700)] + [(7001, 7002), (7002, 7003), (7003, 7001), (8, 8)] + [(rng.randrange(9000, 9400), rng.randrange(9000, 9400)) for _ in range(300)]
    got = {r["node"]: r["component"] for r in resolve.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots([p for p in pairs if p[0] != p[1]])
    assert resolve.components(spark.createDataFrame([], "a long, b long")).collect() == []


def planted():
    """A chain of documents each sharing a value with the next, a hub value, conflicts and ties."""
    rng = random.Random(9)
    rows = []
    for i in range(40):  # a chain in odd order: e0-e1, e1-e2 ...
        doc = (i * 17) % 40
        rows += [(doc, "email", 0, f"e{i}"), (doc, "email", 1, f"e{i + 1}"), (doc, "ip", 0, f"1.1.1.{i % 5}")]
    rows += [(100 + i, "secret", i % 3, "the hub") for i in range(60)]
    rows += [(100 + i, "card", 0, f"c{i % 7}") for i in range(0, 60, 2)]
    rows += [(300 + i, "licence", 0, "a licence line in very many documents") for i in range(50)]
    rows += [(rng.randrange(400, 480), rng.choice(list(registry.MERGE)), n, f"v{rng.randrange(60)}") for n in range(120)]
    return list({(d, f, o): (d, f, o, v) for d, f, o, v in rows}.values())


def merged(rows):
    links = defaultdict(list)
    for d, f, _, v in rows:
        if f in registry.LINK_ON:
            links[f, v].append(d)
    root = roots([(min(ds), d) for ds in links.values() for d in ds])
    of = defaultdict(list)
    for d, f, o, v in rows:
        of[root.get(d, d)].append((d, f, o, v))
    out = {}
    for entity, mine in of.items():
        record, conflicts = {}, 0
        for name, rule in registry.MERGE.items():
            values = sorted({v for _, f, _, v in mine if f == name})
            places = {v: sorted((d, o) for d, f, o, x in mine if f == name and x == v) for v in values}
            order = {
                "common": lambda v: (-len({d for d, _ in places[v]}), places[v][0], v),
                "first": lambda v: (places[v][0], v),
                "last": lambda v: (-places[v][-1][0], -places[v][-1][1], v),
                "longest": lambda v: (-len(v), v),
            }[rule]
            record[name] = min(values, key=order) if values else None
            conflicts += len(values) > 1
        out[entity] = (len({d for d, *_ in mine}), len(mine), conflicts, *record.values())
    return out


def test_records_against_brute_force_and_a_recursive_query(spark):
    rows = planted()
    frame = spark.createDataFrame([*rows, (None, "email", 0, "e1"), (77, "email", 9, None)], FIELDS)
    got = resolve.resolve(frame, registry.LINK_ON, registry.MERGE)
    found = {r["entity"]: tuple(r)[1:] for r in got.collect()}
    assert found == merged(rows)
    assert found[0][0] == 40 and found[100][0] == 60 and Counter(n for n, *_ in found.values())[1] > 50  # chain, hub, licences
    db = duckdb.connect()
    db.register("planted", frame.where("doc_id is not null and value is not null").toPandas())
    theirs = db.sql(registry.resolved_sql("SELECT doc_id::BIGINT AS doc_id, field, ordinal::INT AS ordinal, value FROM planted"))
    assert theirs.columns == got.columns
    assert {r[0]: r[1:] for r in theirs.fetchall()} == found
    assert resolve.resolve(frame.limit(0), registry.LINK_ON, registry.MERGE).collect() == []


def test_dependencies_broken_across_rows(spark):
    rows = [(i, "hot", "en", "s") for i in range(300)] + [(500, "hot", "de", "s"), (501, "a", "en", None), (502, "a", "en", "t"), (503, None, "en", "x"), (504, None, "de", "y"), (505, "b", "en", "x"), (506, "b", "fr", "y"), (507, "b", "en", "x")]
    frame = spark.createDataFrame(rows, "id long, text string, lang string, source string")
    rules = {"lang": (["text"], "lang"), "source": (["text", "lang"], "source"), "both": (["lang", "source"], "text")}
    got = {(r["rule_id"], r["n_values"], r["n_rows"], r["first_key"], r["last_key"], r["least_value"], r["most_value"]) for r in constraints.dependency_violations(frame, rules, "id").collect()}
    assert got == {("lang", 2, 301, 0, 500, "de", "en"), ("lang", 2, 3, 505, 507, "en", "fr")}
