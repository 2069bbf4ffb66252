"""Repeated passages: MinHash bands over paragraphs, exact verification, removal by components; word windows beside.

A paragraph here is a sentence, or a line where a line ends first, of at least MIN_WORDS words, so that a passage is
found wherever it stands in a longer line. Equal paragraphs meet under a 128-bit hash; similar ones meet in a band of
MinHash values and are verified on their exact 5-word shingles. Each component of verified links keeps the paragraph
that comes first; runs of neighbouring repeated paragraphs make up the passages.

Equal passages need no sentence bounds: every run of `min_passage` equal words that occurs twice counts, wherever it
starts and ends. Each window of so many words picks the smallest hash of the shorter grams in it; equal windows pick
equal grams, so only windows of grams that occur twice are compared, by the gram's hash and one of the whole window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missiva.llm.common import freed_shuffles, giving_back, slices, staged, worker_cache
from missiva.operators.graph import components

SHINGLE = 5
SIMILARITY = 0.8
# Two values a band: 1 - (1 - 0.8 ** 2) ** 5 = 0.994 of the pairs at the threshold meet, more above it.
BANDS, ROWS = 5, 2
MIN_WORDS = 8
# A passage counts from so many words, short sentences inside it included.
MIN_PASSAGE = 25
BUCKET = 512
# Bytes of text whose words are hashed at once.
SLICE = 1 << 21
END = re.compile(r"[.!?]+(?=\s)|\n")
WORD = re.compile(r"\S+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str]) -> np.ndarray:
    """XXH64 of each word, without its lowest bit; equal words are hashed once."""
    import xxhash

    found = pa.array(words, pa.string()).dictionary_encode()
    h = np.fromiter(map(xxhash.xxh64_intdigest, found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
    return (h >> np.uint64(1))[found.indices.to_numpy()]


def pieces(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lower-cased words) of each sentence or line of a text, white space around it left out."""
    at = 0
    for end in (*(m.end() for m in END.finditer(text)), len(text)):
        part = text[at:end]
        words = part.lower().split()
        if words:
            bare = part.strip()
            start = at + part.index(bare[0])
            yield start, start + len(bare), words
        at = end


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def min_hashes(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """BANDS x paragraphs band keys from the word hashes of consecutive paragraphs of at least SHINGLE words."""
    shingle = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        shingle = shingle * MIX + words[k : len(words) - SHINGLE + 1 + k]
    ends = np.cumsum(sizes)
    inside = np.ones(len(words), bool)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    shingle = shingle[inside[: len(shingle)]]
    starts = np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])
    keys = []
    for band in range(BANDS):
        key = np.full(len(sizes), band + 1, np.uint64)
        for row in range(ROWS):
            salt = np.uint64(0x632BE59BD9B4E019 * (band * ROWS + row + 1) % (1 << 64))
            key = _mixed(key * MIX + np.minimum.reduceat(_mixed(shingle ^ salt), starts))
        keys.append(key)
    return np.stack(keys)


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, row, ord, start, end, word, n_words, k1, k2, bands, words): every paragraph of every row.

    `row` is a hash of the whole text, `ord` counts the paragraphs of a text, `start` and `end` are code points, `word`
    counts the words before it.
    """
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        # Lets go what a former stage left in this worker.
        worker_cache("passages")
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, order, start, end, place, size, words, joined = [], [], [], [], [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    n = at_word = 0
                    for a, b, found in pieces(t or ""):
                        if len(found) >= min_words:
                            doc.append(i)
                            order.append(n)
                            start.append(a)
                            end.append(b)
                            place.append(at_word)
                            size.append(len(found))
                            words += found
                            joined.append(" ".join(found))
                            n += 1
                        at_word += len(found)
                if not doc:
                    continue
                key = np.frombuffer(b"".join([xxhash.xxh3_128_digest(j) for j in joined]), np.int64).reshape(-1, 2)
                bands = min_hashes(word_hashes(words), np.array(size)).T.copy().view(np.int64)
                at = pa.array(doc, pa.int64())
                offsets = pa.array(np.arange(len(doc) + 1) * BANDS, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("row").take(at), pa.array(order, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(place, pa.int32()), pa.array(size, pa.int32()),
                     pa.array(key[:, 0]), pa.array(key[:, 1]), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())), pa.array(joined, pa.string())],
                    names=["doc_id", "row", "ord", "start", "end", "word", "n_words", "k1", "k2", "bands", "words"],
                )

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = f"doc_id {kind}, row long, ord int, start int, end int, word int, n_words int, k1 long, k2 long, bands array<long>, words string"
    return source.mapInArrow(giving_back(split), schema)


def _shingles(words: str) -> frozenset:
    w = words.split(" ")
    return frozenset(tuple(w[i : i + SHINGLE]) for i in range(max(len(w) - SHINGLE + 1, 1)))


def _verified(buckets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): for each bucket a forest over its paragraphs with the components of all pairs at least so similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members").to_pylist():
                keys = [(m["k1"], m["k2"]) for m in members]
                sets = [_shingles(m["words"]) for m in members]
                order = sorted(range(len(keys)), key=lambda i: len(sets[i]))
                part = list(range(len(keys)))
                for x, i in enumerate(order):
                    for j in order[x + 1 :]:
                        # Sizes differ too much from here on.
                        if len(sets[i]) < similarity * len(sets[j]):
                            break
                        if part[i] != part[j]:
                            both = len(sets[i] & sets[j])
                            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                                a.append(keys[i])
                                b.append(keys[j])
                                old, new = part[j], part[i]
                                part = [new if p == old else p for p in part]
            as_key = lambda pairs: pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["k1", "k2"])
            yield pa.RecordBatch.from_arrays([as_key(a), as_key(b)], names=["a", "b"])

    return buckets.select("members").mapInArrow(giving_back(verify), "a struct<k1:long,k2:long>, b struct<k1:long,k2:long>")


def _buckets(members: DataFrame, size: int) -> DataFrame:
    """Members of one band gathered; a large band becomes a grid of block pairs, so no list exceeds `2 * size` by much."""
    n = members.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    dealt = members.join(n, "band")
    blocks = F.ceil(F.col("_n") / size)
    own = F.pmod(F.xxhash64("k1", "k2"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j")))
    spread = dealt.select("band", "k1", "k2", "words", F.explode(pairs).alias("_p"))
    return spread.groupBy("band", "_p").agg(F.collect_list(F.struct("k1", "k2", "words")).alias("members")).filter(F.size("members") > 1)


def repeated_paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, min_words: int = MIN_WORDS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, row, ord, start, end, word, n_words, first_doc_id, removed) of the paragraphs that occur more than once.

    The copy that comes first by (doc_id, row, ord) stays, the others are `removed`; null ids come first. Rows that
    repeat an id and its text are one document. Empty and null texts have no paragraphs.
    """
    units = staged(paragraphs(docs, doc_id, text, min_words))
    # One half of the hash is enough to tell a band's paragraphs apart; both uses read the same shuffle.
    band = units.select(F.explode("bands").alias("band"), "k1").repartition("band")
    mixed = band.groupBy("band").agg(F.min("k1").alias("_lo"), F.max("k1").alias("_hi")).filter("_lo <> _hi").select("band")
    meeting = staged(band.join(mixed, "band").distinct())
    similar = meeting.select("k1").distinct()
    equal = units.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1")
    wanted = similar.unionByName(equal).distinct()
    found = staged(units.drop("bands").join(wanted, "k1", "left_semi"))
    texts = found.select("k1", "k2", "words").dropDuplicates(["k1", "k2"])
    links = _verified(_buckets(meeting.join(texts, "k1"), bucket), similarity).distinct()
    nodes = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    links = staged(links)
    with freed_shuffles(docs.sparkSession):
        joined = components(nodes, links)
    groups = joined.select(F.col("id.k1").alias("k1"), F.col("id.k2").alias("k2"), F.col("component").alias("group"))
    own = F.struct("k1", "k2")
    placed = found.drop("words").dropDuplicates(["doc_id", "row", "ord"]).join(groups, ["k1", "k2"], "left").withColumn("group", F.coalesce("group", own))
    placed = staged(placed.drop("k1", "k2"))
    place = F.struct("doc_id", "row", "ord")
    firsts = placed.groupBy("group").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    repeated = placed.join(firsts, "group")
    same = F.col("_first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_first.row") == F.col("row")) & (F.col("_first.ord") == F.col("ord"))
    return repeated.select("doc_id", "row", "ord", "start", "end", "word", "n_words", F.col("_first.doc_id").alias("first_doc_id"), (~same).alias("removed"))


def _rolled(words: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Hash of every run of `size` word hashes."""
    h = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        h = _mixed(h * np.uint64(factor) + words[k : k + len(h)])
    return h


def picked_grams(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram hash, its place) that every window of `n` word hashes picks, from the window's words only."""
    short = (n + 1) // 2
    grams = _rolled(words, short, 0xD6E8FEB86659FD93)
    at = np.lib.stride_tricks.sliding_window_view(grams, n - short + 1).argmin(1) + np.arange(len(words) - n + 1)
    return grams[at], at


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return texts.withColumn("unit", F.xxhash64("doc_id", "row", F.col("doc_id").isNull()))


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = MIN_PASSAGE) -> DataFrame:
    """(doc_id, row, start, end, word, n_words, first_doc_id, removed): spans of equal windows of `n` words.

    Words are compared in lower case, white space is not. Of equal windows the one that comes first by (doc_id, row,
    word) stays; one that overlaps its first copy in the same text stays too. The spans of a text may overlap; together
    they cover every word of every window that occurs twice. Rows that repeat an id and its text are one document.
    """
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType.simpleString()
    texts = _texts(docs, doc_id, text)

    def hashed(texts: list[str | None]) -> list[np.ndarray]:
        """The word hashes of each text."""
        words, ends = [], []
        for t in texts:
            words += t.lower().split() if t else ()
            ends.append(len(words))
        return np.split(word_hashes(words), ends[:-1])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lets go what a former stage left in this worker.
        worker_cache("passages")
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                each = hashed(part.column("text").to_pylist())
                long = np.flatnonzero([len(words) >= n for words in each])
                if not len(long):
                    continue
                words, ends = np.concatenate([each[i] for i in long]), np.cumsum([len(each[i]) for i in long])
                # The windows of all texts at once; those that reach into the next text do not count.
                g, at = picked_grams(words, n)
                row = np.repeat(np.arange(len(long)), np.diff(ends, prepend=0))[: len(g)]
                ok = np.arange(len(g)) + n <= ends[row]
                g, at, row = g[ok], at[ok], row[ok]
                new = np.concatenate([[True], at[1:] != at[:-1]])
                g, row = g[new], row[new]
                order = np.lexsort((g, row))
                g, row = g[order], row[order]
                first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (row[1:] != row[:-1])]))
                count = np.diff(np.append(first, len(g)))
                units = part.column("unit").to_numpy()[long[row[first]]]
                yield pa.RecordBatch.from_arrays([pa.array(g[first].view(np.int64)), pa.array(units), pa.array(count > 1)], names=["gram", "unit", "twice"])

    # Each gram of a text once.
    picked = texts.select("unit", "text").mapInArrow(giving_back(pick), "gram long, unit long, twice boolean").repartition("gram")
    same = Window.partitionBy("gram")
    shared = picked.select("gram", "unit", F.max("twice").over(same).alias("_twice"), F.min("unit").over(same).alias("_lo"), F.max("unit").over(same).alias("_hi"))
    wanted = staged(shared.filter("_twice OR _lo <> _hi").groupBy("unit").agg(F.collect_list("gram").alias("grams")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lets go what a former stage left in this worker.
        worker_cache("passages")
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, gram, word, sizes, whole, start, end = [], [], [], [], [], [], []
                texts = part.column("text").to_pylist()
                for i, (t, words, some) in enumerate(zip(texts, hashed(texts), part.column("grams"), strict=True)):
                    g, at = picked_grams(words, n)
                    ok = np.flatnonzero(np.isin(g.view(np.int64), some.values.to_numpy()))
                    if not len(ok):
                        continue
                    # Neighbouring windows with the same gram in the same place make one row.
                    cuts = np.flatnonzero(np.concatenate([[True], (at[ok[1:]] != at[ok[:-1]]) | (np.diff(ok) > 1)]))
                    bounds = np.array([m.span() for m in WORD.finditer(t)], np.int32)
                    doc.append(np.full(len(cuts), i))
                    gram.append(g[ok[cuts]].view(np.int64))
                    word.append(ok[cuts].astype(np.int32))
                    sizes.append(np.diff(np.append(cuts, len(ok))))
                    whole.append(_rolled(words, n, 0xA0761D6478BD642F)[ok].view(np.int64))
                    start.append(bounds[ok, 0])
                    end.append(bounds[ok + n - 1, 1])
                if not doc:
                    continue
                at = pa.array(np.concatenate(doc))
                windows = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (whole, start, end)], names=["hash", "start", "end"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("row").take(at), pa.array(np.concatenate(gram)), pa.array(np.concatenate(word)), pa.ListArray.from_arrays(offsets, windows)],
                    names=["doc_id", "row", "gram", "word", "windows"],
                )

    some = texts.join(wanted, "unit").select("doc_id", "row", "text", "grams")
    rows = some.mapInArrow(giving_back(compare), f"doc_id {kind}, row long, gram long, word int, windows array<struct<hash:long,start:int,end:int>>").repartition("gram")
    # What is dealt by gram lies right for (gram, hash) too.
    each = rows.select("doc_id", "row", "gram", "word", F.posexplode("windows").alias("_i", "_w"))
    each = each.select("gram", F.col("_w.hash").alias("hash"), F.struct("doc_id", "row", (F.col("word") + F.col("_i")).alias("word")).alias("place"), "_w.start", "_w.end")
    equal = Window.partitionBy("gram", "hash")
    found = each.select("*", F.min("place").over(equal).alias("_first"), F.max("place").over(equal).alias("_last")).filter(~F.col("_first").eqNullSafe(F.col("_last")))
    own = F.col("place.doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("place.row") == F.col("_first.row"))
    ahead = F.col("place.word") - F.col("_first.word")
    found = found.select("gram", "place.*", "start", "end", F.col("_first.doc_id").alias("first_doc_id"), F.col("_first.row").alias("_r"), (~(own & (ahead < n))).alias("removed"), ahead.alias("_d"))
    # Windows equal to windows of one text in the same order: all words between the first and the last are equal.
    spans = found.groupBy("gram", "doc_id", "row", "first_doc_id", "_r", "_d", "removed").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("word").alias("word"), (F.max("word") - F.min("word") + n).alias("n_words"))
    return spans.select("doc_id", "row", "start", "end", "word", "n_words", "first_doc_id", "removed")


def _merged(paragraphs: list, windows: list, least: int) -> list[list]:
    """[start, end, n_words, removed, first ids] of a text's passages, from its sorted runs of paragraphs and windows.

    Overlapping and touching removed spans are one passage; so are kept ones, unless they lie in a removed one.
    """
    out: list[list] = []

    def joined(spans: list) -> list[list]:
        got: list[list] = []
        for s in sorted(spans, key=lambda s: (s["word"], -s["n_words"])):
            to, ids = s["word"] + s["n_words"], s["first_doc_ids"]
            if got and s["word"] <= got[-1][1]:
                # A span inside one that is there already names no further document.
                if to > got[-1][1]:
                    got[-1][1], got[-1][3] = to, s["end"]
                    got[-1][4] += [i for i in ids if i not in got[-1][4]]
            else:
                got.append([s["word"], to, s["start"], s["end"], list(ids)])
        return got

    def runs(units: list) -> list[dict]:
        got: list[dict] = []
        for u in sorted(units, key=lambda u: u["ord"]):
            if got and got[-1]["ord"] == u["ord"] - 1 and got[-1]["removed"] == u["removed"]:
                r = got[-1]
                r |= {"ord": u["ord"], "end": u["end"], "n_words": u["word"] + u["n_words"] - r["word"]}
                r["first_doc_ids"] += [u["first_doc_id"]] * (u["first_doc_id"] not in r["first_doc_ids"])
            else:
                got.append({**u, "first_doc_ids": [u["first_doc_id"]]})
        return [r for r in got if r["n_words"] >= least]

    spans = runs(paragraphs) + [{**w, "first_doc_ids": [w["first_doc_id"]]} for w in windows]
    gone = joined([s for s in spans if s["removed"]])
    kept = [k for k in joined([s for s in spans if not s["removed"]]) if not any(g[0] <= k[0] and k[1] <= g[1] for g in gone)]
    for some, removed in ((gone, True), (kept, False)):
        out += [[a, b, to - word, removed, ids] for word, to, a, b, ids in some]
    return sorted(out, key=lambda r: r[:2])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_passage: int = MIN_PASSAGE, **options) -> DataFrame:
    """(doc_id, row, start, end, n_words, kept, first_doc_id, first_doc_ids): runs of neighbouring repeated paragraphs,
    and equal passages between any two words.

    A run holds paragraphs that are all kept (the first copies) or all removed, with nothing but short sentences
    between them; it and an equal passage have `min_passage` words or more from their first to their last word. What
    overlaps is one passage. `first_doc_ids` are the documents in which its parts come first.
    """
    # One after the other: the tables of the second are not there yet when the first has its shuffles on disk.
    windows = staged(repeated_windows(docs, doc_id, text, min_passage))
    units = repeated_paragraphs(docs, doc_id, text, **options)
    kind = units.schema["first_doc_id"].dataType.simpleString()
    fields = ["doc_id", "row", "ord", "start", "end", "word", "n_words", "first_doc_id", "removed"]
    both = units.select(*fields).unionByName(windows.withColumn("ord", F.lit(None).cast("int")).select(*fields))
    # One list per text, at most a few times as long as the text itself.
    by_text = both.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*fields[2:])).alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, found = [], []
            lists = batch.column("spans")
            # Made by column, not struct by struct.
            each = lists.flatten()
            rows = zip(*[c.to_pylist() for c in each.flatten()], strict=True)
            parts = [[dict(zip(fields[2:], r, strict=True)) for r in islice(rows, k)] for k in lists.value_lengths().to_pylist()]
            for i, spans in enumerate(parts):
                got = _merged([s for s in spans if s["ord"] is not None], [s for s in spans if s["ord"] is None], min_passage)
                doc += [i] * len(got)
                found += got
            ids = batch.schema.field("doc_id").type
            # Null ids come first.
            firsts = [sorted(f[4], key=lambda x: (x is not None, x)) if None not in f[4] else [None, *sorted(x for x in f[4] if x is not None)] for f in found]
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("row").take(at), *[pa.array([f[k] for f in found], pa.int32()) for k in range(3)], pa.array([not f[3] for f in found], pa.bool_()),
                 pa.array([f[4][0] for f in found], ids), pa.array(firsts, pa.list_(ids))],
                names=["doc_id", "row", "start", "end", "n_words", "kept", "first_doc_id", "first_doc_ids"],
            )

    return by_text.mapInArrow(giving_back(merge), f"doc_id {kind}, row long, start int, end int, n_words int, kept boolean, first_doc_id {kind}, first_doc_ids array<{kind}>")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str | None = None, **options) -> DataFrame:
    """`docs` with the removed passages cut out of their texts; a row of which nothing is left goes.

    The columns stay; `n_chars`, where there is one, is counted anew. Rows without repeats are unchanged.
    `mark` names a further column that tells whether something was cut out.
    """
    gone = repeated_passages(docs, doc_id, text, **options).filter("NOT kept")
    spans = gone.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    joined = docs.withColumn("_h", F.xxhash64(F.col(f"`{text}`"))).join(spans, F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_row")), "left")

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, some in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            at, kept = 0, []
            for s in some or ():
                kept.append(t[at : s["start"]])
                at = s["end"]
            out.append(t if not some else "".join([*kept, t[at:]]).strip())
        return pa.array(out, pa.string())

    left = joined.withColumn(text, F.when(F.col("_spans").isNotNull(), cut(F.col(text), F.col("_spans"))).otherwise(F.col(text)))
    left = left.filter(F.col("_spans").isNull() | (F.col(text) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns, *([F.col("_spans").isNotNull().alias(mark)] if mark else []))
