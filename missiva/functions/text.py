"""Column functions for text: cleaning, counting, folding, cutting."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from missiva.rules import danish

WORD = r"[\p{L}\p{N}_]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
# The white-space characters of Unicode.
BLANKS = "".join(
    map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def _replace_all(col: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def strip_html(col: Column, breaks: bool = False) -> Column:
    """Drop tags and decode the common entities; `breaks` keeps line and paragraph ends."""
    if breaks:
        col = F.regexp_replace(col, r"(?i)<br\s*/?>", "\n")
        col = F.regexp_replace(col, r"(?i)</p>\s*<p[^>]*>", "\n\n")
    # Entities in decoding order (&amp; before &lt;).
    entities = (
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
        ("&#39;", "'"), ("\r\n", "\n"), ("\r", "\n"),
    )
    return _replace_all(F.regexp_replace(col, r"<[^>]+>", ""), entities)


def clean_transcript(col: Column, marker: str = "<PARA>", illegible: str = "[ulæseligt]") -> Column:
    """Line ends, paragraph markers, dash runs and stray characters of a transcript, in order."""
    c = F.replace(strip(col), F.lit("\r\n"), F.lit("\n"))
    c = F.regexp_replace(c, "\n *\n", "\n\n")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    # Literal replacements in order.
    c = _replace_all(
        c,
        (
            ("\n\n", marker), ("- - - -", illegible), ("----", illegible), ("- - -", illegible),
            ("- -", "-"), ("--", "-"), ("\n", " "), (" ", " "), ("&lt;", " "),
            ("­", ""), ("\u0095", ""),
        ),
    )
    return collapse(c)


def paragraphs(col: Column, marker: str = "<PARA>") -> Column:
    parts = F.transform(F.split(col, marker), strip)
    return F.filter(parts, lambda p: F.length(p) > 0)


def para_to_html(col: Column, marker: str = "<PARA>") -> Column:
    wrapped = F.transform(paragraphs(col, marker), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>")))
    return F.coalesce(F.array_join(wrapped, "\n"), F.lit(""))


def para_to_plain(col: Column, marker: str = "<PARA>") -> Column:
    return F.coalesce(collapse(F.replace(col, F.lit(marker), F.lit(" "))), F.lit(""))


def para_to_newlines(col: Column, marker: str = "<PARA>") -> Column:
    return F.coalesce(F.array_join(paragraphs(col, marker), "\n\n"), F.lit(""))


def cleanup(col: Column) -> Column:
    """Text without soft hyphens and blank runs."""
    return F.regexp_replace(F.replace(col, F.lit("­"), F.lit("")), " {2,}", " ")


def cleanup_hits(col: Column) -> Column:
    bare = F.replace(col, F.lit("­"), F.lit(""))
    return F.length(col) - F.length(bare) + F.regexp_count(bare, F.lit(" {2,}"))


def words(col: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(col, F.lit(WORD), 0)


def pieces(col: Column) -> Column:
    """Words and the text between them; joining the array gives the text back."""
    return F.regexp_extract_all(col, F.lit(f"{WORD}|{NON_WORD}"), 0)


def blank_tokens(col: Column) -> Column:
    """White-space tokens, punctuation kept."""
    return F.filter(F.split(col, r"(?U)\s+"), lambda t: t != "")


def word_count(col: Column) -> Column:
    return F.coalesce(F.size(blank_tokens(col)), F.lit(0))


def digraph_rewrite(
    col: Column, preserve: Sequence[str] = danish.AA_PRESERVE, pair: str = "aa", letter: str = "å"
) -> Column:
    """Replace a letter pair inside words, keeping case, listed words and entities."""
    up, cap = pair.upper(), pair.capitalize()
    mixed = pair[0] + pair[1].upper()
    tokens = F.regexp_extract_all(
        col, F.lit(r"&[a-zA-Z]+;|[a-zA-ZæøåÆØÅéÉ]+|[^a-zA-ZæøåÆØÅéÉ&]+|&"), 0
    )

    def rewrite(t: Column) -> Column:
        done = _replace_all(
            t,
            ((up, letter.upper() * 2), (cap, letter.upper()), (pair, letter), (mixed, letter)),
        )
        keep = t.startswith("&") | F.lower(t).isin(*preserve)
        return F.when(keep, t).otherwise(done)

    return F.array_join(F.transform(tokens, rewrite), "")


def digraph_hits(before: Column, after: Column, pair: str = "aa") -> Column:
    rx = F.lit(f"(?i){pair}")
    return F.greatest(F.lit(0), F.regexp_count(before, rx) - F.regexp_count(after, rx))


def snippet(col: Column, n: int = 200) -> Column:
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def excerpt(col: Column, n: int = 200) -> Column:
    """First non-empty line, cut at the last blank before n characters."""
    lines = F.filter(F.transform(F.split(col, r"\r\n|\n|\r"), strip), lambda p: F.length(p) > 0)
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    head = F.substring(first, 1, n)
    cut = F.when(head.contains(" "), F.regexp_extract(head, r"^(.*) ", 1)).otherwise(head)
    return F.when(F.length(first) <= n, first).otherwise(F.concat(cut, F.lit("...")))


def plain_cut(col: Column, n: int = 100) -> Column:
    return F.substring(strip(F.regexp_replace(col, r"<[^>]+>", "")), 1, n)


def fold_name(
    col: Column,
    chars_from: str = danish.PLACE_FOLD_FROM,
    chars_to: str = danish.PLACE_FOLD_TO,
    pairs: Sequence[tuple[str, str]] = danish.PLACE_FOLD_PAIRS,
) -> Column:
    folded = F.translate(collapse(F.lower(F.coalesce(col, F.lit("")))), chars_from, chars_to)
    return _replace_all(folded, pairs)


def base_name(folded: Column) -> Column:
    return strip(F.regexp_replace(folded, r"(?s)\s*\(.*", ""))


def name_components(folded: Column) -> Column:
    """Base name and the comma parts inside the first parentheses, longer than two letters."""
    inner = F.regexp_extract(folded, r"\(([^)]+)\)", 1)
    parts = F.concat(F.array(base_name(folded)), F.transform(F.split(inner, ","), strip))
    return F.filter(parts, lambda p: F.length(p) > 2)


def slugify(col: Column) -> Column:
    low = _replace_all(F.lower(strip(col)), danish.SLUG_FOLD_PAIRS)
    low = F.translate(low, danish.SLUG_FOLD_FROM, danish.SLUG_FOLD_TO)
    return F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def classify_by_keywords(
    col: Column, groups: Sequence[tuple[str, Sequence[str]]], default: str = "other"
) -> Column:
    """Name of the first group one of whose keywords is part of the lower-cased text."""
    low = F.lower(F.coalesce(col, F.lit("")))
    out = F.lit(default)
    for name, keys in reversed(list(groups)):
        hit = reduce(lambda a, b: a | b, [low.contains(k) for k in keys])
        out = F.when(hit, name).otherwise(out)
    return out


def compose_document(
    fields: Sequence[tuple[str, Column]], text: Column, limit: int = 2000, prefix: str = "passage: "
) -> Column:
    """Labelled non-empty fields and the text, cut to the model's input length."""
    parts = [
        F.concat(F.lit(f"{label}: "), F.nullif(F.coalesce(c, F.lit("")), F.lit("")))
        for label, c in fields
    ]
    body = F.concat_ws(". ", *parts, F.nullif(text, F.lit("")))
    return F.concat(F.lit(prefix), F.substring(body, 1, limit))


def prepare_for_sentences(col: Column, marker: str = "<PARA>") -> Column:
    """A marker after a word ends the sentence, other markers are blanks; leading non-words go."""
    c = F.regexp_replace(col, rf"([\p{{L}}\p{{N}}_]){marker}", "$1. ")
    c = F.regexp_replace(c, rf"{marker}(?:\s*{marker})*", " ")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return collapse(F.regexp_replace(collapse(c), rf"^{NON_WORD}", ""))


def match_positions(text: Column, pattern: str) -> Column:
    """Array of {position, original} of all matches, positions 0-based in characters."""
    parts = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    kind = "array<struct<position:int,original:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        pos = acc["at"] + x["gap"]
        return F.struct(
            (pos + F.length(x["m"])).alias("at"),
            F.array_append(acc["out"], F.struct(pos.alias("position"), x["m"].alias("original"))).alias("out"),
        )

    hits = F.aggregate(both, start, step, lambda a: a["out"])
    return F.when(text.rlike(pattern), hits).otherwise(F.array().cast(kind))
