"""URL filter: host and path rules first, else a weighted vocabulary found by Aho-Corasick.

No shuffle: host, path and rules are column expressions over one scan, and the automaton is
built once in each Python worker from a vocabulary of fixed size.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.line_dedup import lower_ascii
from siftwork.session import table

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: One of these is enough to reject. Written for this filter, by subject: words that name adult content, games of
#: chance, pirated goods, drugs sold without a prescription, or junk itself, and hardly anything else.
STRICT = (
    "adult", "bdsm", "blowjob", "bukkake", "camgirl", "camgirls", "camsex", "creampie", "cumshot", "deepthroat", "fetish",
    "gangbang", "handjob", "hardcore", "hentai", "incest", "milf", "milfs", "nsfw", "nudes", "orgy", "porn", "porno", "pornhub",
    "pornstar", "sex", "sexcam", "sexcams", "sexchat", "sexshop", "sexy", "shemale", "slut", "sluts", "threesome", "upskirt",
    "webcamsex", "whore", "xrated", "xvideos", "xxx",
    "baccarat", "bookmaker", "casino", "casinos", "gambling", "jackpot", "jackpots", "pokies", "roulette", "slots", "sportsbook",
    "crackz", "serialz", "warez", "keygens", "nulled", "torrentz",
    "cialis", "levitra", "tramadol", "viagra", "xanax",
    "linkfarm", "malware", "phishing", "spam", "spyware",
)

#: Several distinct ones are needed to reject: words of the same subjects, and of advertising, that clean pages use too.
SOFT = (
    "babe", "babes", "cam", "cams", "dating", "erotic", "erotica", "escort", "escorts", "girls", "hookup", "hot", "kinky", "lingerie",
    "naked", "naughty", "nude", "nudity", "playboy", "singles", "teen", "teens", "voyeur", "webcam",
    "bet", "bets", "betting", "bingo", "blackjack", "bonus", "bookie", "lottery", "lotto", "odds", "poker", "slot", "wager", "win", "winner",
    "crack", "cracked", "cracks", "hack", "hacks", "keygen", "leak", "leaked", "mod", "pirate", "proxy", "serial", "torrent", "torrents", "unblocked",
    "diet", "meds", "pharma", "pharmacy", "pill", "pills", "prescription", "rx", "steroid", "steroids", "weightloss",
    "affiliate", "banner", "buy", "cash", "cheap", "click", "clicks", "coupon", "coupons", "credit", "crypto", "deal", "deals", "discount",
    "doubleclick", "earn", "farm", "free", "income", "loan", "loans", "money", "offer", "offers", "payday", "popunder", "popup", "prize",
    "profit", "promo", "promos", "replica", "rich", "survey", "track", "tracker", "tracking", "voucher", "ads", "adserver",
)

STRICT_WEIGHT, SOFT_WEIGHT, REJECT_AT = 2, 1, 2


@lru_cache(maxsize=4)
def _automaton(strict: tuple, soft: tuple):
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, terms in ((1, soft), (0, strict)):
        for term in terms:
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def vocabulary_hits(text: str, strict: tuple = STRICT, soft: tuple = SOFT) -> tuple[int, int]:
    """Distinct strict and soft terms in text, between characters that are no a-z or 0-9."""
    part = lambda c: c.isascii() and c.isalnum()
    hits: tuple[set, set] = (set(), set())
    for end, (kind, term) in _automaton(strict, soft).iter(text):
        start = end - len(term) + 1
        if (start == 0 or not part(text[start - 1])) and (end + 1 == len(text) or not part(text[end + 1])):
            hits[kind].add(term)
    return len(hits[0]), len(hits[1])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def url_filter(pages: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT) -> DataFrame:
    """Add host, path, rule, n_strict, n_soft and verdict; input columns of these names are replaced.

    The longest rule that fits decides (ties: the first given). Without one, distinct terms anywhere
    in the url, its query and fragment included, add up their weights and reject from REJECT_AT on. A
    url without '://' has no host, path or rule, but may have terms. A null or empty url has
    none and is allowed. One row out for each row in.
    """
    new = ("host", "path", "rule", "n_strict", "n_soft", "verdict")
    base = pages.drop(*[c for c in new if c != url_col])
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("n_strict int, n_soft int")
    def hits(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([vocabulary_hits(t, strict, soft) for t in text], columns=["n_strict", "n_soft"])

    host, path = host_and_path(F.col(url_col))
    out = base.withColumns({"__host": host, "__path": path})
    rule = verdict = None
    for what, where, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("__host") == where) | F.col("__host").endswith("." + where)) & F.col("__path").startswith(start)
        rule = F.when(fits, where + start) if rule is None else rule.when(fits, where + start)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    out = out.withColumns({
        "__rule": rule if rule is not None else F.lit(None).cast("string"),
        "__ruled": verdict if verdict is not None else F.lit(None).cast("string"),
        "__hits": hits(lower_ascii(F.coalesce(F.col(url_col), F.lit("")))),
    })
    weight = F.col("__hits.n_strict") * STRICT_WEIGHT + F.col("__hits.n_soft") * SOFT_WEIGHT
    return out.select(
        *base.columns,
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule").alias("rule"),
        F.col("__hits.n_strict").alias("n_strict"),
        F.col("__hits.n_soft").alias("n_soft"),
        F.coalesce("__ruled", F.when(weight >= REJECT_AT, "block").otherwise("allow")).alias("verdict"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url."""
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft"
    )


def _oracle() -> str:
    lowered = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [
        (f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v)
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    ]
    count = lambda terms: " + ".join(f"regexp_matches(t, '(^|[^a-z0-9]){x}([^a-z0-9]|$)')::int" for x in terms)
    return f"""
WITH cut AS (
  SELECT page_id, {lowered.format("coalesce(url, '')")} AS t,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, t, {lowered.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), counted AS (
  SELECT *, ({count(STRICT)})::int AS n_strict, ({count(SOFT)})::int AS n_soft FROM parts
)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)} END AS rule,
       CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)}
            WHEN {STRICT_WEIGHT} * n_strict + {SOFT_WEIGHT} * n_soft >= {REJECT_AT} THEN 'block' ELSE 'allow' END AS verdict,
       n_strict, n_soft
FROM counted
"""


ORACLE = _oracle()
