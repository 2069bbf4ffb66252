"""URL filters: host and path rules first, then a weighted vocabulary counted with Aho-Corasick."""

from __future__ import annotations

import string
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_LIMIT = 1000
VOCABULARY_LIMIT = 200_000
# One of these is enough to reject a URL.
STRICT_TERMS = ("porn", "pornhub", "xxx", "hentai", "milf", "camgirl", "camgirls", "escorts", "warez", "keygen", "sexcam", "sexchat")
# Several distinct ones are needed; the weight says how telling a term is.
SOFT_TERMS = {
    "adult": 1, "sex": 2, "sexy": 2, "nude": 2, "nudes": 2, "erotic": 2, "escort": 2, "fetish": 2, "webcam": 1, "dating": 1,
    "casino": 2, "poker": 1, "betting": 1, "slots": 1, "jackpot": 1, "gambling": 2, "viagra": 2, "cialis": 2, "pills": 1,
    "torrent": 1, "crack": 1, "cracked": 1, "serial": 1, "free": 1, "payday": 1, "loans": 1,
}


def host_of(url: str | Column) -> Column:
    """From behind the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: str | Column) -> Column:
    """From the host's end up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits: its host or a subdomain, its path a prefix; else null.

    `rules` holds (action, host, path). Rules of one length are tried in alphabetical order.
    """
    if len(rules) > RULE_LIMIT:
        raise ValueError(f"more than {RULE_LIMIT} rules; join a rule table instead")
    out = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,action:string>") if out is None else out


def vocabulary_hits(url: str, strict: Sequence[str], soft: Mapping[str, int]) -> Column:
    """struct(n_strict, n_soft, soft_weight): hits of strict terms, distinct soft terms and their summed weight.

    Terms match without regard to case, and only where no letter or digit adjoins them. Null counts nothing.
    """
    if len(strict) + len(soft) > VOCABULARY_LIMIT:
        raise ValueError(f"vocabulary beyond {VOCABULARY_LIMIT} terms")
    terms = {t.lower(): (0, w) for t, w in soft.items() if t} | {t.lower(): (1, 0) for t in strict if t}

    @F.pandas_udf("n_strict int, n_soft int, soft_weight int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, value in terms.items():
            automaton.add_word(term, (term, *value))
        automaton.make_automaton()
        for urls in batches:
            out = []
            for u in urls:
                n_strict, seen = 0, {}
                text = u.lower() if u is not None and terms else ""
                for end, (term, is_strict, weight) in automaton.iter(text) if text else ():
                    start = end - len(term)
                    if start >= 0 and text[start].isalnum() or end + 1 < len(text) and text[end + 1].isalnum():
                        continue
                    if is_strict:
                        n_strict += 1
                    else:
                        seen[term] = weight
                out.append((n_strict, len(seen), sum(seen.values())))
            yield pd.DataFrame(out, columns=["n_strict", "n_soft", "soft_weight"])

    return count(url)


def judge_urls(
    pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = (), strict: Sequence[str] = STRICT_TERMS,
    soft: Mapping[str, int] = SOFT_TERMS, soft_distinct: int = 2, soft_weight: int = 3,
) -> DataFrame:
    """Columns of `pages` (but those named as results) plus host, path, rule, verdict, n_strict, n_soft, soft_weight.

    The verdict is the rule's; without a rule it is `block` on one strict term, or on `soft_distinct` distinct soft
    terms that together weigh `soft_weight`, else `allow`. A null or empty URL has an empty host and path, no rule
    and no hits, so it is allowed. Rows are judged one by one: nothing is shuffled, repeated rows repeat.
    """
    new = ("host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight")
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in new and c != url]
    # Read the input under a private name, so that a column called like a result cannot be taken for one.
    out = pages.select(*rest, F.col(f"`{url}`").alias("_url")).withColumns({"host": host_of("_url"), "path": path_of("_url")})
    out = out.withColumns({
        "_rule": matching_rule(F.col("host"), F.col("path"), rules), "_hits": vocabulary_hits("_url", strict, soft),
    })
    bad = (F.col("_hits.n_strict") > 0) | ((F.col("_hits.n_soft") >= soft_distinct) & (F.col("_hits.soft_weight") >= soft_weight))
    keep = [] if url in new else [F.col("_url").alias(url)]
    return out.select(
        *rest, *keep, "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.action"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "_hits.n_strict", "_hits.n_soft", "_hits.soft_weight",
    )
