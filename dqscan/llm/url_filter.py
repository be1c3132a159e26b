"""URL filters: rules by host and path, and for the rest a logistic regression on hashed character n-grams.

DataFrame functions alone. A rule fits its host and all subdomains where the url's path starts with
the rule's; the longest fitting rule decides. Urls without one are scored by the classifier, which
is trained from a small labelled table of urls on the n-grams of host and path: 2 to 4 characters,
each hashed to one of 2**DIM_BITS cells by the first digits of its MD5. Weights are rounded to
integers, so that a score is an exact sum, the same in every engine and order.

Edge cases: a null url and one without `://` have empty host and path, which no rule fits; their
verdict is that of the two edge marks alone; a url of any length is judged whole; an empty table gives
an empty one; repeated rows give repeated results; ids of any type are carried along, other columns
aren't read and may have any names. Only A-Z are lowered in hosts.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM_BITS = 14
#: Sizes of n-grams, and the strength of the fit below, are those of the best cross-validation on the labelled table.
SIZES = (2, 3, 4)
#: A weight of 1.0 as an integer.
UNIT = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules as (verdict, host, path prefix).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: The labelled table: host and path of urls to block, and of urls to allow.
BLOCKED = """
spam-links.example.org/en/4 spamfarm.example.net/en/2 linkspam.example.org/page/9 link-farm.example.org/en/44.html content-farm.example.net/en/7 click-farm.example.org/ads/7 farm-of-links.example.net/de/3/
discount-pills.example.org/buy/now cheap-meds.example.net/en/81 pills-online.example.org/order/5 cheap-viagra.example.org/en/12 best-viagra.example.net/order canada-pills.example.net/fr/61/ cheap-replica.example.org/shop/cheap
casino-bonus.example.org/free/spins win-casino.example.net/en/9 royal-casino.example.org/de/15 casino.example.net/slots/3 mega-slots-win.example.org/en/6.html jackpot-win.example.net/play poker-slots.example.org/play
free-betting.example.org/en/31 sports-bets.example.net/en/17 bets-tips.example.org/es/3 free-poker.example.org/en/201 bet-now.example.net/de/77 free-loans.example.org/apply/now fast-loans.example.net/en/8
xxx-videos.example.org/hot porn-tube.example.net/watch/1 adult-cams.example.org/live adult-videos.example.net/en/66 x-rated.example.org/en/2 sexy-chat.example.net/en/90/ hot-x-girls.example.org/de/5 adult-dating.example.net/fr/10
ad-tracker.example.org/en/5 ads.example.net/pixel track-ads.example.org/en/78 tracking.example.net/click/2 ads-server.example.org/banner/4 popup-ads.example.net/en/3 click-track.example.org/redirect adserver.example.net/track.html
malware-host.example.net/download.exe phishing-login.example.org/bank/verify login-verify.example.net/account/update torrent-warez.example.net/crack/keygen free-crack.example.org/keygen warez.example.net/en/14 win-free-phone.example.org/prize
you-win-prize.example.net/claim free-gift-cards.example.org/claim/now cheap-watches.example.net/shop fake-news-farm.example.org/en/19 get-rich-now.example.net/en/5 miracle-diet-pills.example.org/en/8
"""
ALLOWED = """
news.example.org/en/1 blog.example.org/en/22 www.example.org/en/3 m.example.net/en/4 docs.example.org/guide/install.html wiki.example.org/de/55 example.org/en/6/ example.net/en/77.html blog.therand.example.org/en/9/
library.example.org/books/8 school.example.net/de/9 the.other.example.org/de/10 blog.things.example.net/en/11/ museum.example.org/es/12 weather.example.org/fr/13 m.reader.example.org/en/14 www.garden.example.net/de/15
science.example.org/papers/16 recipes.example.org/en/17/ forum.example.net/en/18 university.example.org/en/19.html health.example.org/en/20 travel.example.net/de/21 theatre.example.org/en/7102 www.theory.example.org/en/8120/
physics.example.net/en/5 history.example.org/de/31.html poems.example.org/fr/8 letters.example.net/en/44 m.station.example.org/en/605 www.nation.example.net/de/88 blog.author.example.org/es/5114/ tourist.example.org/fr/3
children.example.net/en/61 farming.example.org/en/12 pharmacy.example.org/de/4 booking.example.net/en/9 freedom.example.org/en/71 windows-help.example.org/guide/3 trackers-of-birds.example.net/en/2 addition.example.org/maths/5
maths.example.net/en/62 music.example.org/en/307.html chess.example.org/de/90 cinema.example.net/fr/43/ gardens.example.org/en/55 rivers.example.org/en/3312 mountains.example.net/es/6 lighthouse.example.org/en/18
bakery.example.org/en/100 www.ocean.example.org/en/4127 m.nature.example.net/en/2 blog.earth.example.org/en/1591.html town-hall.example.org/de/5 open-source.example.org/docs/1 language.example.net/en/703/ astronomy.example.org/en/64
newspaper.example.org/en/410 city-bus.example.net/de/12 dictionary.example.org/en/9 journals.example.org/papers/77 radio.example.net/fr/16 world-maps.example.org/en/34 clinic.example.org/en/2.html
"""
LABELLED = [(f"http://{u}", label) for text, label in ((BLOCKED, 1), (ALLOWED, 0)) for u in text.split()]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as host and path in one text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name, verdict = F.when(fits, F.lit(domain + prefix)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def cells(host: Column, path: Column) -> Column:
    """Hash cells of all n-grams of ^host and path$, one entry an occurrence."""
    whole = F.concat(F.lit("^"), host, path, F.lit("$"))

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1))), lambda i: F.substring(whole, i, F.lit(n)))

    return F.transform(F.concat(*map(grams, SIZES)), lambda g: F.conv(F.substring(F.md5(g), 1, 4), 16, 10).cast("int").bitwiseAND((1 << DIM_BITS) - 1))


def train(labelled: list[tuple[list[int], int]], l2: float = 1e-5, steps: int = 3000, rate: float = 2.0) -> tuple[list[int], int]:
    """Integer weights and bias, from (cells, label) rows; the table is small, so that this runs on the driver."""
    y, n = np.array([label for _, label in labelled], float), max(1, len(labelled))
    x = np.zeros((len(labelled), 1 << DIM_BITS))
    for k, (found, _) in enumerate(labelled):
        np.add.at(x[k], found, 1 / math.sqrt(len(found) or 1))
    w, bias = np.zeros(1 << DIM_BITS), 0.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(x @ w + bias))) - y) / n
        w, bias = w - rate * (x.T @ g + l2 * w), bias - rate * float(g.sum())
    return [round(v * UNIT) for v in w.tolist()], round(bias * UNIT)


def blocks(url: str, model: tuple[list[int], int]) -> bool:
    """The classifier's verdict on one url, for figures on the labelled table."""
    weights, bias = model
    found = plain_cells(url)
    return sum(weights[c] for c in found) / math.sqrt(len(found)) + bias > 0


def cross_validated(labelled: list[tuple[str, int]] = LABELLED, folds: int = 5) -> dict[str, float]:
    """Precision and recall of `block` on the labelled table, each url judged by a model that hasn't seen its host."""
    fold = [zlib.crc32(url.split("/")[2].encode()) % folds for url, _ in labelled]
    right = wrong = missed = 0
    for k in range(folds):
        model = train([(plain_cells(u), y) for (u, y), f in zip(labelled, fold, strict=True) if f != k])
        for (u, y), f in zip(labelled, fold, strict=True):
            if f == k:
                said = blocks(u, model)
                right, wrong, missed = right + (said and y == 1), wrong + (said and y == 0), missed + (not said and y == 1)
    return {"precision": right / max(1, right + wrong), "recall": right / max(1, right + missed)}


def plain_cells(url: str | None) -> list[int]:
    """`cells` of a url, for the small labelled table."""
    head, mark, rest = (url or "").partition("://")
    host, cut = (rest, len(rest)) if mark else ("", 0)
    for k, c in enumerate(rest if mark else ""):
        if c in "/?#":
            host, cut = rest[:k], k
            break
    path = rest[cut:].split("?")[0].split("#")[0] if mark else ""
    whole = "^" + host.translate(str.maketrans(UPPER, LOWER)) + path + "$"
    grams = [whole[i : i + n] for n in SIZES for i in range(max(len(whole) - n + 1, 1))]
    return [int(hashlib.md5(g.encode()).hexdigest()[:4], 16) & ((1 << DIM_BITS) - 1) for g in grams]


_trained: list[tuple[list[int], int]] = []


def default_model() -> tuple[list[int], int]:
    if not _trained:
        _trained.append(train([(plain_cells(u), y) for u, y in LABELLED]))
    return _trained[0]


def judged(pages: DataFrame, rules=RULES, model: tuple[list[int], int] | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule and verdict."""
    weights, bias = model or default_model()
    table = F.from_json(F.lit(json.dumps(weights)), "array<int>")
    rows = pages.select(F.col(f"`{key}`").alias("key"), host_of(F.col(f"`{url}`").cast("string")).alias("host"), path_of(F.col(f"`{url}`").cast("string")).alias("path"))
    rows = rows.select("*", cells(F.col("host"), F.col("path")).alias("cells"), table.alias("w"))
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.get(F.col("w"), c))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("key", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), total.alias("total"), F.size("cells").alias("n"))
    # bias + total / sqrt(n) > 0, without roots: both sides are whole numbers once squared.
    signed = lambda x: F.signum(x).cast("long") * x.cast("decimal(38,0)") * x
    over = signed(F.col("total")) > -(F.lit(bias).cast("decimal(20,0)") * abs(bias) * F.col("n"))
    return rows.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("by_rule", F.when(over, "block").otherwise("allow")).alias("verdict"))


def oracle(rules=RULES, model: tuple[list[int], int] | None = None) -> str:
    """DuckDB SQL for `judged` over the table pages."""
    weights, bias = model or default_model()
    fits = [(f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}')", d + p, v) for v, d, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    grams = " || ".join(f"list_transform(range(1, greatest(length(t) - {n - 1}, 1) + 1), lambda i: substring(t, i, {n}))" for n in SIZES)
    nonzero = ", ".join(f"({c}, {w})" for c, w in enumerate(weights) if w)
    return f"""
WITH h AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r
  FROM pages
), g AS (
  SELECT r, unnest({grams}) AS gram FROM (SELECT r, '^' || host || path || '$' AS t FROM h)
), c AS (
  SELECT r, ('0x' || substring(md5(gram), 1, 4))::INT & {(1 << DIM_BITS) - 1} AS cell FROM g
), w(cell, weight) AS (VALUES {nonzero}), s AS (
  SELECT r, sum(coalesce(weight, 0))::HUGEINT AS total, count(*) AS n FROM c LEFT JOIN w USING (cell) GROUP BY r
)
SELECT page_id, host, path, {case(1)} AS rule,
       coalesce({case(2)}, CASE WHEN sign(total) * total * total > -({bias * abs(bias)}::HUGEINT * n) THEN 'block' ELSE 'allow' END) AS verdict
FROM h JOIN s USING (r)"""
