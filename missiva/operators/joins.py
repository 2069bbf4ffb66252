"""Merges, cascades, range and reference joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.functions import text as T
from missiva.operators.scale import bounded_broadcast, number_rows
from missiva.session import pin


def attach_scores(letters: DataFrame, scores: DataFrame, on: str = "id", how: str = "left") -> DataFrame:
    return letters.join(scores, on, how)


def map_children_to_parent(children: DataFrame, parents: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Children with their parent's columns, and the count of children without one."""
    lost = children.join(parents.select(on), on, "left_anti").agg(F.count(F.lit(1)).alias("unmapped"))
    return children.join(parents, on), lost


def outer_merge(a: DataFrame, b: DataFrame, on: str, both: Sequence[str] = ()) -> DataFrame:
    """Full outer merge; with `both`, only rows that have every named column."""
    out = a.join(b, on, "full")
    return out.dropna(subset=list(both)) if both else out


def priority_merge(base: DataFrame, sources: Sequence[tuple[DataFrame, str]], on: str, out: str) -> DataFrame:
    """First non-empty value per key over the ordered (table, column) sources."""
    cur, names = base, []
    for i, (df, col) in enumerate(sources):
        cur = cur.join(df.select(on, F.col(col).alias(f"_v{i}")), on, "left")
        names.append(f"_v{i}")
    first = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    return cur.withColumn(out, first).drop(*names)


def overlay_merge(
    computed: DataFrame, curated: DataFrame, manual: DataFrame, human: Sequence[str], key: str = "id"
) -> DataFrame:
    """Curated values win for human fields, the pipeline keeps counts and dates, aliases unite in order.

    Manual rows join only if their key is new.
    """
    over = curated.select(
        F.col(key), *[F.col(h).alias(f"_c_{h}") for h in human], F.col("aliases").alias("_c_aliases")
    )
    merged = computed.join(over, key, "left")
    cols = []
    for c in computed.columns:
        if c == "aliases":
            empty = F.array().cast("array<string>")
            cols.append(
                F.array_union(F.coalesce("aliases", empty), F.coalesce("_c_aliases", empty)).alias("aliases")
            )
        elif c in human:
            cols.append(F.coalesce(f"_c_{c}", c).alias(c))
        else:
            cols.append(F.col(c))
    merged = merged.select(*cols)
    extra = manual.join(computed.select(key), key, "left_anti")
    return merged.unionByName(extra, allowMissingColumns=True)


def split_curated(registry: DataFrame, human: Sequence[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Human fields of pipeline rows that have any, and the manual rows (no count, no first mention)."""
    manual = (F.coalesce(F.col("letter_count"), F.lit(0)) == 0) & F.col("first_mention").isNull()
    any_human = reduce(lambda a, b: a | b, [F.col(h).isNotNull() for h in human])
    return registry.filter(~manual & any_human).select(key, *human, "aliases"), registry.filter(manual)


def alias_index(registry: DataFrame, order: str, case_sensitive: bool = False) -> DataFrame:
    """alias -> id; an alias claimed twice goes to the entry that comes first."""
    names = registry.select(
        "id", order, F.explode(F.array_union(F.array("canonical"), F.col("aliases"))).alias("alias")
    )
    if not case_sensitive:
        names = names.withColumn("alias", F.lower("alias"))
    return names.groupBy("alias").agg(F.min(F.struct(order, "id")).alias("_m")).select("alias", F.col("_m.id").alias("id"))


def resolve_aliases(
    mentions: DataFrame, registry: DataFrame, doc: str, name: str, order: str, case_sensitive: bool = False
) -> DataFrame:
    """Distinct (document, entity id) pairs of the mentions the registry knows."""
    index = alias_index(registry, order, case_sensitive)
    key = F.col(name) if case_sensitive else F.lower(name)
    pairs = mentions.select(doc, key.alias("alias")).distinct()
    return pairs.join(bounded_broadcast(index), "alias").select(doc, "id").distinct()


def cascade_match(
    left: DataFrame, right: DataFrame, left_key: str, left_name: str, right_name: str, right_order: str,
    aliases: str | None = None, prefix: int = 4,
) -> DataFrame:
    """Five ordered passes: folded name, base name, any component, shared base prefix, alias.

    Each pass is an equi-join; in the prefix pass the heads of one name, from `prefix`
    letters up, meet the other name whole. The first pass wins, then the first candidate.
    """
    fl, fr = T.fold_name(F.col(left_name)), T.fold_name(F.col(right_name))
    lt = left.select(
        F.col(left_key).alias("_l"), fl.alias("f"), T.base_name(fl).alias("b"), T.name_components(fl).alias("c"),
        *([F.col(aliases).alias("a")] if aliases else []),
    )
    rt = right.select(
        F.col(right_name).alias("matched"), F.col(right_order).alias("_o"), fr.alias("f"),
        T.base_name(fr).alias("b"), T.name_components(fr).alias("c"),
    )

    def firsts(df: DataFrame) -> DataFrame:
        """The first candidate of each key: no key fans out in a join, however common the name part is."""
        return df.groupBy("k").agg(F.min(F.struct("_o", "matched")).alias("m")).select("k", "m._o", "m.matched")

    def hits(a: DataFrame, b: DataFrame, no: int) -> DataFrame:
        return a.join(firsts(b), "k").groupBy("_l").agg(
            F.min(F.struct(F.lit(no).alias("p"), F.col("_o"), F.col("matched"))).alias("m")
        )

    long = F.length("b") > 2
    passes = [
        hits(lt.select("_l", F.col("f").alias("k")), rt.select("matched", "_o", F.col("f").alias("k")), 1),
        hits(
            lt.filter(long).select("_l", F.col("b").alias("k")),
            rt.filter(long).select("matched", "_o", F.col("b").alias("k")), 2,
        ),
        hits(
            lt.select("_l", F.explode(F.array_distinct("c")).alias("k")),
            rt.select("matched", "_o", F.explode(F.array_distinct("c")).alias("k")), 3,
        ),
    ]
    pl = lt.filter(F.length("b") >= prefix).select("_l", F.col("b").alias("k"))
    pr = firsts(rt.filter(F.length("b") >= prefix).select("matched", "_o", F.col("b").alias("k")))
    heads = lambda df, *keep: df.select(
        *keep, F.explode(F.transform(F.sequence(F.lit(prefix), F.length("k")), lambda n: F.substring(F.col("k"), F.lit(1), n))).alias("k")
    )
    passes.append(hits(heads(pl, "_l"), pr, 4).unionByName(hits(pl, heads(pr, "_o", "matched"), 4)))
    if aliases:
        al = lt.select("_l", F.posexplode("a").alias("i", "x")).select("_l", "i", T.fold_name(F.col("x")).alias("k"))
        rk = firsts(rt.select("matched", "_o", F.col("f").alias("k")))
        # Aliases are tried in list order, so their position decides before the candidate order.
        best = al.join(rk, "k").groupBy("_l").agg(F.min(F.struct("i", "_o", "matched")).alias("m"))
        passes.append(
            best.select(
                "_l", F.struct(F.lit(5).alias("p"), F.col("m._o").alias("_o"), F.col("m.matched").alias("matched")).alias("m")
            )
        )
    every = reduce(lambda a, b: a.unionByName(b), passes)
    first = every.groupBy("_l").agg(F.min("m").alias("m"))
    return first.select(F.col("_l").alias(left_key), F.col("m.p").alias("pass_no"), F.col("m.matched").alias("matched"))


def match_by_slug_or_alias(
    places: DataFrame, docs: DataFrame, doc_id: str = "id", date: str = "date", place: str = "place"
) -> DataFrame:
    """Documents of each place by exact name, alias or slug, each document once per place."""
    names = places.select(
        "place_id",
        F.explode(F.array_distinct(F.concat(F.array("place"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("k"),
    )
    slugs = places.select("place_id", T.slugify(F.col("place")).alias("k")).filter(F.col("k") != "")
    d = docs.select(F.col(doc_id).alias("doc_id"), date, F.col(place).alias("_p"))
    exact = d.join(bounded_broadcast(names), d["_p"] == names["k"]).select("place_id", "doc_id", date)
    by_slug = d.withColumn("k", T.slugify(F.col("_p"))).join(bounded_broadcast(slugs), "k").select("place_id", "doc_id", date)
    return exact.unionByName(by_slug).distinct()


def event_window_stats(
    events: DataFrame, docs: DataFrame, score: str, before: int = 14, after: int = 30, date: str = "date"
) -> DataFrame:
    """Mean score of documents before an event's start and after its end, with the difference.

    Documents shrink to one row per day and events to one row per (start, end); such a
    span then touches before+after+1 days.
    """
    daily = docs.filter(F.col(date).isNotNull()).groupBy(F.col(date).alias("_day")).agg(
        F.sum(score).alias("_s"), F.count(score).alias("_n")
    )
    spans = events.select("start", "end").distinct()
    pre = F.transform(F.sequence(F.lit(1), F.lit(before)), lambda i: F.struct(F.lit("pre").alias("side"), F.date_sub("start", i.cast("int")).alias("day")))
    post = F.transform(F.sequence(F.lit(0), F.lit(after)), lambda i: F.struct(F.lit("post").alias("side"), F.date_add("end", i.cast("int")).alias("day")))
    days = spans.select("start", "end", F.explode(F.concat(pre, post)).alias("_d")).select(
        "start", "end", F.col("_d.side").alias("_side"), F.col("_d.day").alias("_day")
    )
    hit = days.join(bounded_broadcast(daily), "_day")
    side = lambda s, c: F.coalesce(F.sum(F.when(F.col("_side") == s, F.col(c))), F.lit(0))
    stats = hit.groupBy("start", "end").agg(
        side("pre", "_s").alias("sb"), side("pre", "_n").alias("before_count"),
        side("post", "_s").alias("sa"), side("post", "_n").alias("after_count"),
    )
    mean = lambda s, n: F.when(F.col(n) > 0, F.col(s) / F.col(n))
    out = events.select("event_id", "start", "end").join(stats, ["start", "end"], "left").select(
        "event_id",
        mean("sb", "before_count").alias("before_mean"), mean("sa", "after_count").alias("after_mean"),
        F.coalesce("before_count", F.lit(0)).alias("before_count"), F.coalesce("after_count", F.lit(0)).alias("after_count"),
    )
    return out.withColumn("delta", F.col("after_mean") - F.col("before_mean"))


def same_day_pairs(
    docs: DataFrame, group: str, a: str, b: str, measures: Sequence[str], doc_id: str = "id", date: str = "date"
) -> DataFrame:
    """Documents of two audiences written on one day, with absolute differences of their measures.

    The pairs are the result itself. The measures are worked out once for both sides; where the second audience is
    small enough for every task, nothing is shuffled, else adaptive skew handling splits a crowded day.
    """
    cols = [F.col(m).cast("double") for m in measures]
    rows = docs.filter(F.col(date).isNotNull() & F.col(group).isin(a, b))
    rows = pin(rows.select(*dict.fromkeys((doc_id, date, group, *measures))))
    left = rows.filter(F.col(group) == a).select(F.col(doc_id).alias("id_a"), date, *[c.alias(f"_a{i}") for i, c in enumerate(cols)])
    right = rows.filter(F.col(group) == b).select(F.col(doc_id).alias("id_b"), date, *[c.alias(f"_b{i}") for i, c in enumerate(cols)])
    return left.join(bounded_broadcast(right), date).select(
        date, "id_a", "id_b", *[F.abs(F.col(f"_a{i}") - F.col(f"_b{i}")).alias(f"{m}_diff") for i, m in enumerate(measures)]
    )


def match_seeds(seeds: DataFrame, sentences: DataFrame, doc_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """Seed sentences with their last index in the document, and the count of seeds without a match."""
    s = seeds.select(doc_id, "sentence", *[c for c in seeds.columns if c not in (doc_id, "sentence")])
    found = sentences.join(bounded_broadcast(s), [doc_id, "sentence"]).groupBy(*s.columns).agg(F.max("idx").alias("idx"))
    missing = s.join(found.select(doc_id, "sentence"), [doc_id, "sentence"], "left_anti")
    return found, missing.agg(F.count(F.lit(1)).alias("unmatched"))


def referential_check(
    entries: DataFrame, dim: DataFrame, entry_id: str, refs: str, dim_key: str, array: bool = True
) -> DataFrame:
    """References without a dimension row, and dimension rows nothing refers to."""
    ref = F.explode(refs) if array else F.col(refs)
    used = entries.select(entry_id, ref.alias("ref"))
    keys = dim.select(F.col(dim_key).alias("ref")).distinct()
    unknown = used.join(keys, "ref", "left_anti").select(
        F.lit("unknown").alias("kind"), F.col(entry_id).cast("string").alias("entry"), F.col("ref").cast("string").alias("ref")
    )
    orphan = keys.join(used.select("ref").distinct(), "ref", "left_anti").select(
        F.lit("orphan").alias("kind"), F.lit(None).cast("string").alias("entry"), F.col("ref").cast("string").alias("ref")
    )
    return unknown.unionByName(orphan)


def assign_place_id(letters: DataFrame, place: str = "place", location: str = "location", order: str = "id") -> DataFrame:
    """A 1-based id per distinct location in order of first use, joined back; no location gives 0."""
    seen = letters.filter(F.col(location).isNotNull() & (F.col(location) != "")).groupBy(location).agg(
        F.min(F.struct(order, place)).alias("_first")
    )
    ids = number_rows(
        seen.select(location, F.col(f"_first.{order}").alias("_o"), F.col(f"_first.{place}").alias("place_name")),
        [], ["_o", location], "place_id",
    ).select(location, "place_id", "place_name")
    return letters.join(bounded_broadcast(ids), location, "left").withColumn(
        "place_id", F.coalesce("place_id", F.lit(0).cast("long"))
    )


def translate_values(df: DataFrame, col: str, names: Mapping[str, str], skip: Sequence[str] = ()) -> DataFrame:
    """Dictionary lookup of fixed size; other values stay, skipped ones become NULL."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    kept = F.coalesce(F.try_element_at(table, F.col(col)), F.col(col))
    return df.withColumn(col, F.when(~F.col(col).isin(*skip), kept) if skip else kept)


def enrich_lookup(places: DataFrame, enriched: DataFrame, display: str, source: str) -> DataFrame:
    """Enrichment by display name, then by source name, of entries that have a link or an id."""
    good = enriched.filter(F.coalesce("wikidata_id", "wikipedia_url").isNotNull())
    one = good.select(F.col("name").alias(display), F.struct(*[c for c in good.columns if c != "name"]).alias("_d"))
    two = good.select(F.col("name").alias(source), F.struct(*[c for c in good.columns if c != "name"]).alias("_s"))
    out = places.join(one, display, "left").join(two, source, "left")
    return out.select(*places.columns, F.coalesce("_d", "_s").alias("enrichment"))


def merged_lookup(a: DataFrame, b: DataFrame, name: str, key: str) -> DataFrame:
    """All names of `a` with their id, then names only `b` has with a NULL id."""
    extra = b.select(name).distinct().join(a.select(name), name, "left_anti")
    return a.select(name, F.col(key).alias("id")).unionByName(
        extra.select(name, F.lit(None).cast(dict(a.dtypes)[key]).alias("id"))
    ).orderBy(name)


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """All substrings of `size` characters, in one pass of a pattern that looks ahead of every place."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def lexicon_annotate(df: DataFrame, doc_id: str, text: str, lexicon: DataFrame, size: int = GRAM) -> DataFrame:
    """Every literal occurrence of each lexicon token with its 0-based positions, left to right without overlap.

    An inverted index: each token is filed under one of its substrings of `size` characters, the one that the fewest
    tokens have (shorter tokens under themselves). Texts are equi-joined by their distinct substrings, and what meets
    is checked on the text itself. Null and empty tokens and texts match nothing; equal lexicon rows and equal texts
    come out each.
    """
    words = lexicon.filter(F.length("token") > 0)
    own = F.col("token")
    filed = words.select("*", F.explode(F.array_distinct(F.when(F.length(own) <= size, F.array(own)).otherwise(_grams(own, size)))).alias("_g"))
    counts = filed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    # The rarest substring of a token; which one it is never changes the result.
    rarest = filed.select("token", "_g").distinct().join(counts, "_g").groupBy("token").agg(F.min(F.struct("_n", "_g")).alias("_r"))
    index = words.join(rarest.select("token", F.col("_r._g").alias("_g")), "token").select("_g", F.struct(*lexicon.columns).alias("_e"))
    index = pin(index)
    lengths = sorted(r[0] for r in index.select(F.length("_g")).distinct().collect())
    names = list(dict.fromkeys((doc_id, text)))
    if not lengths:
        return df.select(doc_id, *[F.lit(None).cast(t).alias(c) for c, t in lexicon.dtypes], F.array().cast("array<int>").alias("positions")).limit(0)
    held = F.array_distinct(F.concat(*[_grams(F.col(text), n) for n in lengths]))
    near = bounded_broadcast(index)
    if near is not index:
        both = df.select(*names, F.explode(held).alias("_g")).join(near, "_g").drop("_g")
    else:
        # A large index: only row numbers travel with the substrings, the texts follow for what was found.
        rows = pin(df.select(*names).withColumn("_row", F.monotonically_increasing_id()))
        met = rows.select("_row", F.explode(held).alias("_g")).join(index, "_g").select("_row", "_e")
        both = rows.join(met, "_row")
    hit = both.filter(F.col(text).contains(F.col("_e.token")))
    # Lengths of the parts between occurrences give the offsets.
    quoted = F.replace(F.col("_e.token"), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    parts = F.split(F.col(text), F.concat(F.lit(r"\Q"), quoted, F.lit(r"\E")))
    lengths_ = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), F.length)
    step = lambda acc, n: F.concat(
        acc,
        F.array(
            F.when(F.size(acc) == 0, n).otherwise(F.element_at(acc, -1) + F.length(F.col("_e.token")) + n)
        ),
    )
    at = F.aggregate(lengths_, F.array().cast("array<int>"), step)
    return hit.select(doc_id, *[F.col(f"_e.{c}").alias(c) for c in lexicon.columns], at.alias("positions"))


def attribute_bare_names(
    bare: DataFrame, variants: DataFrame, mentions: DataFrame, max_days: int = 30
) -> DataFrame:
    """Give each bare-name mention the variant its context points to.

    bare(doc_id, date, sender), variants(variant, alias, ord), mentions(doc_id, date, name).
    Evidence in order: an alias inside the sender (0.95), one variant in the document
    (0.7), one variant on the date (0.5), the nearest dated mention within max_days.
    """
    v = bounded_broadcast(variants)
    named = mentions.join(v, mentions["name"] == variants["alias"]).select("doc_id", "date", "variant", "ord").distinct()
    in_doc = named.groupBy("doc_id").agg(F.countDistinct("variant").alias("_dn"), F.min("variant").alias("_dv"))
    per_day = named.filter(F.col("date").isNotNull()).groupBy("date").agg(
        F.countDistinct("variant").alias("_tn"), F.min("variant").alias("_tv"), F.min(F.struct("ord", "variant")).alias("_first")
    )
    senders = bare.select("sender").distinct()
    inside = lexicon_annotate(senders, "sender", "sender", variants.select(F.col("alias").alias("token"), "variant", "ord"))
    by_sender = inside.groupBy("sender").agg(F.min(F.struct("ord", "variant")).alias("_s"))
    # Nearest mention: one row per day on both sides, filled from either direction by day.
    days = bare.select("date").union(per_day.select("date")).filter(F.col("date").isNotNull()).distinct()
    marks = days.join(per_day.select("date", F.struct("date", "_first").alias("_m")), "date", "left")
    # Keyed by calendar days, so the window holds at most one row per day of the collection.
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    back = F.last("_m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_m", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = marks.select("date", back.alias("_b"), ahead.alias("_a"))
    db, da = F.datediff("date", F.col("_b.date")), F.datediff(F.col("_a.date"), F.col("date"))
    ord_b, ord_a = F.col("_b._first.ord"), F.col("_a._first.ord")
    use_b = (F.col("_a").isNull()) | (db < da) | ((db == da) & (ord_b <= ord_a))
    near = near.select(
        "date",
        F.when(F.col("_b").isNotNull() & use_b, F.struct(db.alias("d"), F.col("_b._first.variant").alias("v")))
        .when(F.col("_a").isNotNull(), F.struct(da.alias("d"), F.col("_a._first.variant").alias("v"))).alias("_n"),
    )
    rows = bare.join(by_sender, "sender", "left").join(in_doc, "doc_id", "left").join(
        per_day.select("date", "_tn", "_tv"), "date", "left"
    ).join(near, "date", "left")
    pick = lambda variant, conf, method: F.struct(
        variant.alias("assigned_to"), conf.cast("double").alias("confidence"), method.alias("method")
    )
    days_off = F.col("_n.d")
    chosen = (
        F.when(F.col("_s").isNotNull(), pick(F.col("_s.variant"), F.lit(0.95), F.lit("sender_identity")))
        .when(F.col("_dn") == 1, pick(F.col("_dv"), F.lit(0.7), F.lit("same_letter_co_occurrence")))
        .when(F.col("_tn") == 1, pick(F.col("_tv"), F.lit(0.5), F.lit("temporal_same_date")))
        .when(
            days_off <= max_days,
            pick(
                F.col("_n.v"), F.round(F.greatest(F.lit(0.3), F.lit(0.5) - days_off * 0.01), 2),
                F.concat(F.lit("temporal_nearest_"), days_off.cast("string"), F.lit("d")),
            ),
        )
        .otherwise(pick(F.lit(None).cast("string"), F.lit(0.0), F.lit("unresolvable")))
    )
    return rows.select("doc_id", "date", "sender", chosen.alias("_c")).select(
        "doc_id", "date", "sender", "_c.*", F.col("_c.assigned_to").isNull().alias("is_ambiguous")
    )


