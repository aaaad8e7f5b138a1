"""URL filter: host/path rules first, then a logistic regression on hashed character trigrams.

The model is fitted on the driver from a small labelled table of URLs that is part of this module (its
size is fixed): hosts and paths with unwanted or neutral words, and many hosts of syllables that mean
nothing, which are wanted, so that an unknown host alone is no reason to block. A fifth of its hosts is
held out of the fit (accuracy() tells how the model does on them). Judging is made of DataFrame functions
only. Weights are held as integers, so a score is an exact sum and every engine agrees on it.

Defined results: a null URL, or one without "://", has an empty host and path, matches no rule and is
judged by the model's intercept. Repeated rows are judged alike; columns besides page_id and url are
not read; an empty table gives no rows; a very long URL is scored whole, in time proportional to it.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict). A rule is a host, a slash and the start of a path.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
CELLS = 4096
SCALE = 1_000_000

#: Words of the labelled table.
UNWANTED = (
    "adult", "ads", "bet", "bets", "betting", "bingo", "casino", "cheap", "click", "clickbait", "crack", "deal", "escort", "free-money", "gamble", "jackpot", "keygen", "loan", "loans", "lottery",
    "pills", "poker", "porn", "prize", "replica", "sex", "slots", "spam", "torrent", "track", "viagra", "warez", "win", "xxx",
)
WANTED = (
    "academy", "archive", "art", "atlas", "blog", "book", "care", "city", "code", "cooking", "culture", "data", "docs", "earth", "forum", "garden", "health", "history", "home", "journal", "lab",
    "library", "market", "mountain", "museum", "music", "nation", "news", "ocean", "paper", "photo", "reading", "recipe", "river", "school", "science", "shop", "sport", "story", "study", "team",
    "therapy", "thread", "travel", "weather", "wiki", "world", "writing",
)
SYLLABLES = ("an", "ar", "be", "ca", "ch", "da", "de", "di", "el", "en", "er", "es", "fo", "ge", "ha", "he", "in", "ka", "la", "le", "li", "ma", "me", "mo", "na", "ne", "ni", "no", "on", "or", "ou", "pa", "ra", "re", "ri", "ro", "sa", "se", "sh", "st", "ta", "te", "th", "ti", "tion", "to", "ur", "va", "ve", "wh", "za")
PREFIXES, ZONES = ("", "www.", "blog.", "m."), ("example.com", "example.net", "example.org")


def labelled_urls() -> list[tuple[str, str, int, bool]]:
    """The labelled table as (host, path, 1 for unwanted, held out)."""
    rng, rows = random.Random(6), []

    def syllables():
        return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 5)))

    def path():
        return f"/{rng.choice(('en', 'de', 'fr', 'es', 'p', 'a'))}/{rng.randrange(1000)}{rng.choice(('', '/', '.html'))}"

    def add(name, where, label):
        rows.append((f"{rng.choice(PREFIXES)}{name}.{rng.choice(ZONES)}", where, label, rng.random() < 0.2))

    for _ in range(6):
        for bad in UNWANTED:
            add(rng.choice((bad, f"{bad}-{syllables()}", f"{syllables()}-{bad}", f"{bad}{rng.randrange(100)}", f"{bad}-{rng.choice(UNWANTED)}", f"{bad}-{rng.choice(WANTED)}")), path(), 1)
            add(syllables(), f"/{bad}{path()}", 1)
        for good in WANTED:
            add(rng.choice((good, f"{good}-{syllables()}", f"{syllables()}-{good}", f"{good}{rng.randrange(100)}", f"{good}-{rng.choice(WANTED)}")), path(), 0)
            add(syllables(), f"/{good}{path()}", 0)
    for _ in range(900):
        add(syllables(), path(), 0)
    return rows


def cells(host: str, path: str) -> list[int]:
    """The hashed trigrams of a host and a path; score() and judge_sql() hash alike."""
    found = []
    for text, salt in ((f"^{host}$", 0), (f"^{path}$", 7)):
        code = [ord(c) for c in text]
        found += [(a * 961 + b * 31 + c + salt) % CELLS for a, b, c in zip(code, code[1:], code[2:], strict=False)]
    return found


@lru_cache(maxsize=1)
def weights(steps: int = 150, rate: float = 0.3, momentum: float = 0.95, decay: float = 1e-4) -> tuple[int, tuple[int, ...]]:
    """Intercept and cell weights of the regression, in millionths."""
    rows = [r for r in labelled_urls() if not r[3]]
    x, y = np.zeros((len(rows), CELLS)), np.array([r[2] for r in rows], float)
    for i, (host, path, *_) in enumerate(rows):
        np.add.at(x[i], cells(host, path), 1.0)
    w, b, dw, db = np.zeros(CELLS), 0.0, np.zeros(CELLS), 0.0
    for _ in range(steps):  # gradient descent with momentum
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        dw = momentum * dw - rate * (x.T @ miss / len(rows) + decay * w)
        db = momentum * db - rate * miss.mean()
        w, b = w + dw, b + db
    return round(b * SCALE), tuple(int(v) for v in np.rint(w * SCALE))


def accuracy() -> tuple[float, float, float]:
    """On the hosts held out: the share judged right, of the unwanted blocked, of the wanted blocked."""
    bias, w = weights()
    held = [(bias + sum(w[c] for c in cells(h, p)) > 0, bool(y)) for h, p, y, out in labelled_urls() if out]
    share = lambda rows, test: sum(map(test, rows)) / len(rows)
    bad, good = [r for r in held if r[1]], [r for r in held if not r[1]]
    return share(held, lambda r: r[0] == r[1]), share(bad, lambda r: r[0]), share(good, lambda r: r[0])


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def score(host: Column, path: Column) -> Column:
    """The intercept and the weights of all trigrams, in one pass over each text's characters."""
    bias, w = weights()
    held = F.expr("array(" + ",".join(f"{v}L" for v in w) + ")")
    none = F.lit(-1)
    total = F.lit(bias).cast("bigint")

    def adder(salt):
        def add(acc, c):
            cell = (acc["a"] * 961 + acc["b"] * 31 + F.ascii(c) + salt) % CELLS
            weight = F.when(acc["a"] >= 0, F.get(held, cell)).otherwise(0)
            return F.when(c == "", acc).otherwise(F.struct((acc["s"] + weight).alias("s"), acc["b"].alias("a"), F.ascii(c).alias("b")))

        return add

    for text, salt in ((host, 0), (path, 7)):
        codes = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
        total = F.aggregate(codes, F.struct(total.alias("s"), none.alias("a"), none.alias("b")), adder(salt), lambda acc: acc["s"])
    return total


def rule_case(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score in millionths, for every row."""
    host, path = split_url(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    df = df.select("*", rule_case(F.col("host"), F.col("path"), rules).alias("rule"), score(F.col("host"), F.col("path")).alias("score"))
    verdict = F.when(F.col("score") > 0, "block").otherwise("allow")
    for rule, said in rules:
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def judge_sql() -> str:
    bias, w = weights()
    held = "[" + ",".join(map(str, w)) + "]"
    rule = "CASE " + " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR suffix(host, '.{r.partition('/')[0]}')) AND prefix(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for r, _ in sorted(RULES, key=lambda r: -len(r[0]))
    ) + " END"
    said = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)
    part = lambda c, salt: (
        f"coalesce(list_sum(list_transform(range(1, len('^'||{c}||'$') - 1), lambda i: w[1 + (ascii(substr('^'||{c}||'$', i, 1)) * 961"
        f" + ascii(substr('^'||{c}||'$', i + 1, 1)) * 31 + ascii(substr('^'||{c}||'$', i + 2, 1)) + {salt}) % {CELLS}])), 0)"
    )
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM rest),
ruled AS (SELECT *, {rule} AS rule, {held}::BIGINT[] AS w FROM cut),
scored AS (SELECT page_id, host, path, rule, ({bias} + {part('host', 0)} + {part('path', 7)})::BIGINT AS score FROM ruled)
SELECT page_id, host, path, rule, CASE {said} WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict, score FROM scored"""
