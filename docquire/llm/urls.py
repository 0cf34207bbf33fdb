"""URL filters: longest matching rule, and elsewhere a logistic regression on hashed character n-grams of host and path.

Everything is DataFrame functions: n-grams, their hash slots and the score are column expressions, and a training step is
one aggregate over the labelled URLs. The weights have a fixed number of slots and go into the plan as one constant.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquire.llm.common import spread, unused, written

#: Hash slots of host n-grams, and as many again of path n-grams; lengths of the n-grams.
SLOTS, LENGTHS = 2048, (3, 4, 5)
#: Rules as (verdict, host, path): a rule fits its host and all subdomains where the URL's path starts with its path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: The small labelled URL table that the query learns from: names of sites by verdict, each with a subdomain, domain and
#: path dealt out alike to both, so that only the name tells them apart.
SITES = {
    "block": """
        casino-royal online-casino best-casino-slots casino-bonus grand-casino poker-room video-poker bet-now sports-betting
        live-bets slot-machines-win win-big-prize jackpot-win free-spins-win easy-win-lottery you-win-iphone
        adult-videos adult-cams adult-movies hot-adult-dating adult-chat-x free-adult xxx-tube xxx-pics x-rated-films
        porn-free best-porn sex-chat sex-shop nude-models webcam-girls
        spam-links spam-offers spamdirectory mass-spam email-spam link-farm click-farm content-farm seo-farm farm-of-links
        cheap-pills diet-pills viagra-store pharmacy-no-rx payday-loans quick-loan-cash crypto-doubler
        torrent-warez warez-movies keygen-cracks replica-watches cheap-replica-bags phish-login malware-update
    """,
    "allow": """
        news library garden museum weather recipes university software history travel science forum city-council health
        school cinema music thought theatre rivers nation station then motion other there thin rather shine table ration
        throne another northern breath tension wiki data archive open-source local-history bird-watch market window winter
        essays release lessons theory thread tender mountain bakery orchestra physics chemistry biology railway harbour
        painting poetry football cycling gardeners hospital parliament statistics election village bridge island kitchen
        teacher student notebook camera planet ocean thimble thousand thunder hearth ethics tradition attention
    """,
}
_SUBDOMAINS, _DOMAINS = ("", "www.", "blog.", "m."), ("org", "net", "com")
_PATHS = ("/en/12", "/fr/345/", "/de/6.html", "/es/78", "/en/901?page=2", "/de/23#top", "/fr/4", "/en/567.html", "/es/8/", "")


@dataclass
class UrlModel:
    bias: float
    weights: list[float]  # SLOTS of host n-grams, then SLOTS of path n-grams


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty where it is null or has no `://`."""
    url = F.coalesce(url, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, upper, upper.lower()), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of rule (its host and path) and verdict of the longest rule that fits (of equal ones the first), or null."""
    fits = lambda h, p: (F.lit(True) if not h else (host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, h, p in ordered], F.lit(None).cast("struct<rule: string, verdict: string>"))


def slots(part: Column, offset: int) -> Column:
    """Distinct slots of the character n-grams of a host or path between a start and an end mark; '' has none.

    The characters are split once, so the work grows with the length of the part and not with its square.
    """
    marked = F.concat(F.lit("\x02"), part, F.lit("\x03"))
    characters = F.regexp_extract_all(marked, F.lit("(?s)."), F.lit(0))

    def of_length(c: Column, n: int) -> Column:
        at = F.when(F.size(c) >= n, F.sequence(F.lit(0), F.size(c) - n)).otherwise(F.array().cast("array<int>"))
        gram = lambda i: F.concat(*[F.get(c, i + j) for j in range(n)])
        return F.transform(at, lambda i: F.xxhash64(gram(i)).bitwiseAND(SLOTS - 1).cast("int") + offset)

    # transform over an array of one: the characters are split once for all lengths
    every = F.flatten(F.transform(F.array(characters), lambda c: F.concat(*[of_length(c, n) for n in LENGTHS])))
    return F.when(part == "", F.array().cast("array<int>")).otherwise(F.array_distinct(every))


def chance(model: UrlModel, host_slots: Column, path_slots: Column) -> Column:
    """Chance that a URL is to be blocked; a part's n-grams count by the root of their number, so a long path can't drown
    the host."""
    weights = F.from_json(F.lit(json.dumps(model.weights)), "array<double>")
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda z, i: z + F.get(weights, i)) / F.sqrt(F.greatest(F.size(s), F.lit(1)))
    return 1 / (1 + F.exp(-(F.lit(model.bias) + total(host_slots) + total(path_slots))))


def labelled_urls(spark: SparkSession, sites: dict[str, str] = SITES) -> DataFrame:
    """url, verdict: the table above."""
    rows = []
    for verdict, names in sites.items():
        for i, name in enumerate(names.split()):
            url = f"https://{_SUBDOMAINS[i % 4]}{name}.example.{_DOMAINS[i % 3]}{_PATHS[i % len(_PATHS)]}"
            rows.append({"url": url, "verdict": verdict})
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<url: string, verdict: string>>")))


def learn(labelled: DataFrame, steps: int = 12, ridge: float = 2e-4) -> UrlModel:
    """Accelerated gradient descent on labelled URLs (url; verdict: block or allow); both classes weigh the same.

    Every weight's step is set by a bound of its curvature. Every step is one map-side-combined aggregate over all rows,
    which sends at most 2 x SLOTS sums to the driver, whatever the number of rows. Rows with null or other values take no
    part; repeated rows count each. Without rows of both classes the model allows, or blocks, everything by the only
    class (allow without any).
    """
    host, path = parse(F.col("url"))
    known = labelled.where(F.col("url").isNotNull() & F.col("verdict").isin("allow", "block"))
    rows = written(known.select((F.col("verdict") == "block").cast("double").alias("y"), slots(host, 0).alias("h"), slots(path, SLOTS).alias("p")), "labelled-urls")
    n, blocked = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        return UrlModel(4.0 if blocked else -4.0, [0.0] * (2 * SLOTS))
    bias_slot = 2 * SLOTS
    share = F.when(F.col("y") == 1, 0.5 / blocked).otherwise(0.5 / (n - blocked))
    each = lambda s: F.transform(s, lambda i: F.struct(i.alias("slot"), (1 / F.sqrt(F.size(s))).alias("x")))
    inputs = F.concat(F.array(F.struct(F.lit(bias_slot).alias("slot"), F.lit(1.0).alias("x"))), each(F.col("h")), each(F.col("p")))

    def sums(factor: Column) -> dict[int, float]:
        """Sum of factor * x over all rows, by slot."""
        found = rows.select(factor.alias("factor"), inputs.alias("at")).select("factor", F.inline("at"))
        return {r["slot"]: r["total"] for r in found.groupBy("slot").agg(F.sum(F.col("factor") * F.col("x")).alias("total")).collect()}

    curvature = sums(share / 4 * (1 + F.sqrt(F.size("h")) + F.sqrt(F.size("p"))))
    now = dict.fromkeys(curvature, 0.0)
    before = now
    model = lambda w: UrlModel(round(w[bias_slot], 6), [round(w.get(i, 0.0), 6) for i in range(2 * SLOTS)])
    for step in range(steps):
        ahead = {i: w + step / (step + 3) * (w - before[i]) for i, w in now.items()}
        slope = sums((chance(model(ahead), F.col("h"), F.col("p")) - F.col("y")) * share)
        penalty = lambda i: 0.0 if i == bias_slot else ridge
        before, now = now, {i: w - (slope[i] + penalty(i) * w) / (curvature[i] + penalty(i)) for i, w in ahead.items()}
    return model(now)


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Add host, path, rule (host and path of the rule that decides, else null), verdict (allow or block: the rule's, else
    the model's, block from 0.5 up) and score (the model's chance of block) to every row.

    The path goes up to `?`, `#` or the end, whatever its length. Null URLs and those without `://` have an empty host and
    path; no rule fits them and the bias decides. Ties can't arise: of fitting rules the longest wins. Repeated rows get
    the same answer, other columns pass through, those with the new names are replaced, an empty table stays empty. No
    shuffle.
    """
    source = F.col(f"`{url}`")
    names = ["host", "path", "rule", "verdict", "score"]
    keep = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in names]
    host, path = parse(source)
    found, known = unused(pages, "_fits"), ("host", "path")
    parsed = spread(pages).select(*keep, host.alias("host"), path.alias("path"))
    judged = parsed.select("*", rule_for(F.col("host"), F.col("path"), rules).alias(found), chance(model, slots(F.col("host"), 0), slots(F.col("path"), SLOTS)).alias("score"))
    verdict = F.coalesce(F.col(f"{found}.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return judged.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in names], *known, F.col(f"{found}.rule").alias("rule"), verdict.alias("verdict"), "score")
