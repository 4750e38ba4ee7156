"""URL filter: host and path rules, else logistic regression on hashed character n-grams; DataFrame functions only."""

from __future__ import annotations

import math
import zlib
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules as they are given: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: The labelled URL table: names of hosts to keep out, and words of which names of hosts to let through are made.
BAD_HOSTS = (
    "grand-casino casino-royal casino365 online-slots slot-machines mega-jackpot poker-room poker-stars sport-betting betting-odds best-bets roulette-live gambling-den "
    "pills-direct diet-pills cheap-meds viagra-shop buy-viagra discount-pharmacy adult-video adult-dating xxx-tube xxx-clips porn-movies freeporn sex-chat hot-webcams nude-girls "
    "escort-service spam-mailer bulk-spam ad-tracker click-ads popup-ads banner-ads adserver track-clicks malware-host virus-download phish-bank login-verify free-warez crack-keys "
    "keygen torrent-movies fake-watches replica-bags payday-loan fast-cash quick-loans get-rich crypto-doubler win-prizes win-big lottery-winner free-gift free-money miracle-cure essay-writer"
).split()
GOOD_FIRST = "city town daily open national royal north river garden music science history winter family public green".split()
GOOD_SECOND = "library museum news school college weather kitchen hospital theatre football archive council railway bakery orchestra review".split()
SUBDOMAINS = ("", "www.", "m.", "blog.")
ENDINGS = ("com", "net", "org", "info", "co.uk", "de")
#: Paths say little here; both kinds of host have the same.
PATHS = ("about", "wiki/History", "news/2021/05/story.html", "docs/api/", "", "index.php", "articles/42", "p/1234", "shop/item?id=9", "category/all/")
DIMENSIONS, SIZES, BIAS = 16384, (3, 4, 5), -1.75


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 for block). Bad names stand four times, in turn with other subdomains, endings and paths, good ones twice."""
    good = [f"{a}{'-' if (i + j) % 2 else ''}{b}" for i, a in enumerate(GOOD_FIRST) for j, b in enumerate(GOOD_SECOND)]
    out = []
    for hosts, each, label in ((BAD_HOSTS, 4, 1), (good, 2, 0)):
        for i, name in enumerate(hosts):
            for j in range(each):
                out.append((f"{SUBDOMAINS[(i + j) % 4]}{name}.{ENDINGS[(i + j) % 6]}", PATHS[(3 * i + j) % len(PATHS)], label))
    return out


def grams(host: str, path: str) -> list[int]:
    """Slots of the n-grams of `^host/path$`, as slots() has them in Spark."""
    s = f"^{host}/{path}$"
    return [zlib.crc32(s[i : i + n].encode()) % DIMENSIONS for n in SIZES for i in range(max(0, len(s) - n + 1))]


@lru_cache(maxsize=4)
def train(rounds: int = 60, rate: float = 2.0, decay: float = 1e-4) -> tuple[float, tuple[float, ...]]:
    """Bias and weights, by gradient descent on the labelled table; features are n-gram counts over the root of their number.

    The bias is set, not learnt: a host of which nothing is known is let through.
    """
    rows = []
    for host, path, label in labelled_urls():
        found = grams(host, path)
        scale = 1 / math.sqrt(len(found))
        count: dict[int, float] = {}
        for g in found:
            count[g] = count.get(g, 0.0) + scale
        rows.append((list(count.items()), label))
    bias, w = BIAS, [0.0] * DIMENSIONS
    for _ in range(rounds):
        for x, label in rows:
            z = bias + sum(w[g] * v for g, v in x)
            step = rate / len(x) ** 0.5 * (label - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            for g, v in x:
                w[g] += step * v - decay * w[g]
    return bias, tuple(w)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def probability(host: Column, path: Column) -> Column:
    bias, weights = train()
    table = F.expr("array(" + ",".join(f"{w!r}D" for w in weights) + ")")
    s = F.concat(F.lit("^"), host, F.lit("/"), F.regexp_replace(path, "^/", ""), F.lit("$"))
    at = lambda n: F.when(F.length(s) >= n, F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    of = lambda n: F.transform(at(n), lambda i: F.crc32(F.encode(F.substring(s, i, F.lit(n)), "UTF-8")) % DIMENSIONS)
    slots = F.concat(*[of(n) for n in SIZES])
    z = F.aggregate(slots, F.lit(0.0), lambda total, g: total + F.element_at(table, (g + 1).cast("int")))
    return 1 / (1 + F.exp(-(F.lit(bias) + z / F.sqrt(F.greatest(F.size(slots), F.lit(1))))))


def judge(pages: DataFrame, keep=(), rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict and score to page_id and the columns in keep.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule (host and path) wins, and
    its verdict stands. Else the verdict follows from the model's score. Null urls and urls without `://` have an empty
    host and path, which the model judges like any other; a score of just the threshold blocks. Urls of any length are judged
    whole. Rows stay one to one, repeated ones too; an empty table gives an empty result. Other columns are ignored; those
    in keep must not be called host, path, rule, verdict, found or score.
    """
    host, path = parts(F.col("url"))
    d = pages.select("page_id", *keep, host.alias("host"), path.alias("path"))
    best = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p))
        found = F.struct(F.lit(f"{h}{p}").alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, found) if best is None else best.when(fits, found)
    d = d.withColumn("found", best)
    score = probability(F.col("host"), F.col("path"))
    d = d.withColumn("score", score)
    verdict = F.coalesce("found.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return d.select("page_id", *keep, "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")
