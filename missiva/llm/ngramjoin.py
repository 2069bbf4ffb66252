"""Documents with nearly equal sets of word n-grams, by T-occurrence search.

Two sets that reach the similarity share many n-grams, and some of them among the rarest of both: with t the least
overlap a set of n n-grams needs, any partner shares at least c of its n - t + c rarest ones. Only these go into
inverted lists, ordered by a frequency sketch of all documents. A first round compares every list's members with one
of them (its pivot), so that large groups of near copies become single components. Then whatever shares c list
entries across components is searched; the n-grams before the first shared one count against a pair beforehand.

A search takes one set as the query and builds the inverted lists of its candidates. DivideSkip parts them: the
short lists are merged and counted, the candidates that can still reach their overlap are looked up in the few long
lists by bisection, and those that reach it are linked.

An n-gram is known by 64 bits mixed from its words' XXH64, a set by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.llm.common import slices, staged
from missiva.operators.graph import components
from missiva.operators.scale import bounded_broadcast

WORDS = 4
#: Least intersection in hundredths of the union.
PERCENT = 85
#: The rarest n-grams two linked sets must share are one and one more for so many n-grams.
SHARED_OF = 20
#: Counters of the frequency sketch, in chunks; its size does not depend on the data.
SKETCH, CHUNK = 1 << 20, 1 << 12
FAN_IN = 256
#: Entries of a list in one piece, and candidates of a search in one piece.
LIST, SEARCH = 1024, 256
#: Weight of DivideSkip's choice of long lists.
MU = 0.0085


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the n-grams; with fewer words the whole sequence is one."""
    import xxhash

    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 1)], np.uint64)
    h = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in found]), np.dtype(">u8")).astype(np.uint64)
    last = len(h) - words + 1
    s = h[:last].copy()
    for k in range(1, words):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : last + k]
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(s ^ (s >> np.uint64(29)))


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    """The overlap that a set of `n` needs with any partner."""
    return -(-percent * n // 100)


def pair_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT):
    """The overlap at which percent * union <= 100 * intersection."""
    return -(-percent * (n + m) // (100 + percent))


def shared_rare(n: int, percent: int = PERCENT) -> int:
    return min(1 + n // SHARED_OF, int(least_overlap(n, percent)))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, digest) of every document, and each task's sketch as (chunk, counts) rows.

    The sets themselves are not kept: they would take more room than the texts, from which they are made anew.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                sketch += np.bincount((np.concatenate(sets) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()),
                    ],
                    names=["doc_id", "n", "digest", "chunk", "counts"],
                )
        chunks = sketch.reshape(-1, CHUNK)
        at = np.flatnonzero(chunks.any(1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()),
                pa.array(at, pa.int32()), pa.array([_packed(chunks[i]) for i in at], pa.binary()),
            ],
            names=["doc_id", "n", "digest", "chunk", "counts"],
        )

    made = docs.mapInArrow(cut, "doc_id long, n long, digest binary, chunk int, counts binary")
    return staged(made.select(F.spark_partition_id().alias("task"), "*"))


def _digest(grams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def _packed(counts: np.ndarray) -> bytes:
    """Counters in the fewest bytes each."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _frequencies(made: DataFrame) -> np.ndarray:
    """The sketch of all tasks, added up in groups of FAN_IN; each counter bounds the frequency of its n-grams."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint64)
        for raw in table.column("counts"):
            raw = raw.as_py()
            total += np.frombuffer(raw, np.dtype(f"u{len(raw) // CHUNK}"))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "task": table.column("task").slice(0, 1), "counts": pa.array([_packed(total)], pa.binary())})

    rows = made.filter("chunk IS NOT NULL").select("chunk", "task", "counts")
    tasks = (made.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        tasks = -(-tasks // FAN_IN)
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("chunk", "task").applyInArrow(add, "chunk int, task int, counts binary")
        if tasks == 1:
            break
        rows = staged(rows)
    out = np.zeros(SKETCH, np.uint64)
    for chunk, _, raw in rows.collect():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(raw, np.dtype(f"u{len(raw) // CHUNK}"))
    return out


def _lists(docs: DataFrame, frequency: np.ndarray, words: int, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(k, digest, n) of the distinct sets, and (g, nb, salt, k, n, u): entries of lists that hold more than one set.

    A list that may pass `size` entries is dealt over `nb` pieces.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequency)

    def rarest_of(n: int) -> int:
        return n - int(least_overlap(n, percent)) + shared_rare(n, percent)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s for s in (shingle_set(t, words) for t in part.column("text").to_pylist()) if len(s)]
                out = []
                for s in sets:
                    f = sent.value[(s % np.uint64(SKETCH)).astype(np.int64)]
                    first = np.lexsort((s, f))[: rarest_of(len(s))]
                    # A counter of one is an n-gram that no other document has.
                    out.append(s[first[f[first] > 1]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(out, pa.binary())],
                    names=["digest", "n", "rare"],
                )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rare = [np.frombuffer(r, np.uint64) for r in part.column("rare").to_pylist()]
                g = np.concatenate(rare)
                each = np.repeat(np.arange(len(rare)), [len(r) for r in rare])
                sizes = part.column("n").to_pylist()
                # n-grams of a counter of one, the first in the order, were left out.
                pos = np.concatenate([rarest_of(n) - len(r) + np.arange(len(r)) for n, r in zip(sizes, rare, strict=True)])
                k, n = (part.column(c).to_numpy(zero_copy_only=False)[each] for c in ("k", "n"))
                pieces = 1 + (sent.value[(g % np.uint64(SKETCH)).astype(np.int64)].astype(np.int64) - 1) // size
                salt = ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % pieces.astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.view(np.int64), pieces, salt, k, n, pos.astype(np.int64))], names=["g", "nb", "salt", "k", "n", "pos"])

    rare = docs.select("text").mapInArrow(rarest, "digest binary, n long, rare binary")
    sets = rare.groupBy("digest").agg(F.first("n").alias("n"), F.first("rare").alias("rare"))
    sets = staged(sets.withColumn("k", F.monotonically_increasing_id()))
    flat = sets.select("k", "n", "rare").mapInArrow(entries, "g long, nb long, salt long, k long, n long, pos long").repartition("g", "salt")
    lists = flat.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("g", "salt"))).filter("size > 1 OR nb > 1").drop("size")
    # The first n-gram that two sets share is in a list of both. So `u` n-grams of a set, those that stand before its
    # first n-gram in such a list, are shared with no partner.
    lists = staged(lists)
    lists = lists.drop("pos").join(lists.groupBy("k").agg(F.min("pos").alias("u")), "k")
    return sets.drop("rare"), staged(lists.filter((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent))


def _fit(percent: int) -> Column:
    """Whether sets of n and m n-grams can reach the similarity at all, if u and v of them are shared with no partner."""
    n, m, u, v = (F.col(x) for x in "nmuv")
    most = F.least(n - u, m - v)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (100 * most >= percent * (most + u + v))


def _shared(percent: int, n: str = "n", m: str = "m") -> Column:
    one = lambda x: F.least(1 + F.floor(F.col(x) / SHARED_OF), F.ceil(F.col(x) * percent / 100))
    return F.least(one(n), one(m))


def _pivot_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(x, y): each list's members beside the one whose hash is the smallest."""
    mark = F.min(F.struct(F.xxhash64("k").alias("h"), F.col("k").alias("x"), F.col("n").alias("m"), F.col("u").alias("v"))).alias("z")
    pivots = lists.groupBy("g").agg(mark).select("g", "z.x", "z.m", "z.v")
    pairs = lists.select("g", "k", "n", "u").join(pivots, "g").filter((F.col("x") != F.col("k")) & _fit(percent))
    counted = pairs.groupBy("x", "m", F.col("k").alias("y"), "n").agg(F.count(F.lit(1)).alias("shared"))
    return counted.filter(F.col("shared") >= _shared(percent)).select("x", "y")


def _cross_candidates(lists: DataFrame, found: DataFrame, percent: int, search: int) -> DataFrame:
    """(x, hx, hy, ys): candidates of other components that share enough list entries with x.

    Pieces of a list meet in pairs, each in a bounded block that gives every x the packed rest of its list; all lists
    of an x are then merged and counted together, one x at a time. A set's home is a block of about `search` sets
    that share the smallest neighbour in a list; an x has one row for each home that holds candidates of it. So no
    row stands for a pair.
    """
    named = lists.join(found.select(F.col("id").alias("k"), "component"), "k")
    mixed = named.groupBy("g").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("g")
    named = staged(named.join(mixed, "g", "left_semi"))
    low = named.groupBy("g").agg(F.min("k").alias("_low"))
    label = named.select("g", "k").join(low, "g").groupBy("k").agg(F.min("_low").alias("_label"))
    sizes = label.groupBy("_label").agg(F.ceil(F.count(F.lit(1)) / search).alias("_blocks"))
    homes = staged(label.join(sizes, "_label").select("k", F.xxhash64("_label", F.pmod(F.xxhash64("k"), "_blocks")).alias("home")))
    named = named.join(homes, "k")
    one = ["k", "n", "u", "component", "home"]
    left = named.select("g", F.col("salt").alias("i"), F.explode(F.sequence("salt", F.col("nb") - 1)).alias("j"), F.lit(0).alias("side"), *one)
    right = named.filter("salt > 0").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salt") - 1)).alias("i"), F.col("salt").alias("j"), F.lit(1).alias("side"), *one)
    dealt = left.unionByName(right).repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "k")

    def meet(side: np.ndarray, k: np.ndarray, n: np.ndarray, u: np.ndarray, component: np.ndarray, home: np.ndarray, same: bool) -> Iterator[tuple]:
        own, other = (np.ones(len(k), bool),) * 2 if same else (side == 0, side == 1)
        k2, n2, u2, c2, h2 = k[other], n[other], u[other], component[other], home[other]
        for x, m, v, c, h in zip(*(a[own].tolist() for a in (k, n, u, component, home)), strict=True):
            most = np.minimum(n2 - u2, m - v)
            ok = (c2 != c) & (100 * np.minimum(n2, m) >= percent * np.maximum(n2, m)) & (100 * most >= percent * (most + u2 + v))
            if same:
                ok &= k2 > x
            if ok.any():
                yield x, m, h, k2[ok].tobytes(), n2[ok].astype(np.int32).tobytes(), h2[ok].tobytes()

    def batched(rows: Iterator[tuple], types: list, names: list[str], size: int = 4096) -> Iterator[pa.RecordBatch]:
        while some := list(islice(rows, size)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for block in _runs(batches, ["g", "i", "j"]):
                if block.num_rows > 1:
                    same = block.column("i")[0] == block.column("j")[0]
                    yield from meet(*(block.column(c).to_numpy() for c in ("side", "k", "n", "u", "component", "home")), same)

        yield from batched(rows(), [pa.int64()] * 3 + [pa.binary()] * 3, ["x", "n", "hx", "ys", "ms", "hs"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for own in _runs(batches, ["x"]):
                ys, hs = (np.frombuffer(b"".join(own.column(c).to_pylist()), np.int64) for c in ("ys", "hs"))
                ms = np.frombuffer(b"".join(own.column("ms").to_pylist()), np.int32).astype(np.int64)
                y, first, shared = np.unique(ys, return_index=True, return_counts=True)
                n, x, hx = (own.column(c)[0].as_py() for c in ("n", "x", "hx"))
                many = np.minimum(1 + ms[first] // SHARED_OF, least_overlap(ms[first], percent))
                enough = shared >= np.minimum(many, shared_rare(n, percent))
                y, h = y[enough], hs[first][enough]
                for hy in np.unique(h).tolist():
                    yield x, hx, hy, y[h == hy].tobytes()

        yield from batched(rows(), [pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["x", "hx", "hy", "ys"])

    met = dealt.mapInArrow(blocks, "x long, n long, hx long, ys binary, ms binary, hs binary")
    merged = met.repartition("x").sortWithinPartitions("x").mapInArrow(merge, "x long, hx long, hy long, ys binary")
    return staged(merged)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of sorted batches, one key at a time."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in keys]
        cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist()
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in keys):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, mu: float = MU) -> np.ndarray:
    """Which of `sets` reach the similarity with `query`: all arrays ascend and hold no value twice."""
    sizes = np.array([len(s) for s in sets], np.int64)
    need = pair_overlap(len(query), sizes, percent)
    # Inverted lists of the query's n-grams over the candidates, ascending.
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    held = query[at] == flat
    at, owner = at[held], owner[held]
    order = np.argsort(at, kind="stable")
    owner = owner[order]
    ends = np.cumsum(np.bincount(at, minlength=len(query)))
    lengths = np.diff(ends, prepend=0)
    by_length = np.argsort(lengths, kind="stable")
    t = int(need.min())
    longest = int(lengths.max())
    n_long = min(int(t / (mu * np.log2(longest) + 1)), t - 1) if longest > 1 else 0
    long, short = by_length[len(query) - n_long :], np.zeros(len(query), bool)
    short[by_length[: len(query) - n_long]] = True
    # The short lists are sorted runs; one stable sort merges them, and equal neighbours are counted.
    merged, count = np.unique(np.sort(owner[np.repeat(short, lengths)], kind="stable"), return_counts=True)
    keep = count >= need[merged] - n_long
    live, count = merged[keep], count[keep]
    for left, g in zip(range(n_long - 1, -1, -1), long[::-1], strict=True):
        if not len(live):
            break
        entries = owner[ends[g] - lengths[g] : ends[g]]
        if len(entries):
            place = np.minimum(np.searchsorted(entries, live), len(entries) - 1)
            count = count + (entries[place] == live)
        can = count + left >= need[live]
        live, count = live[can], count[can]
    return live[count >= need[live]]


def _grams_of(docs: DataFrame, sets: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(k, grams) of the sets in `needed`, made anew from their texts."""
    needed = staged(sets.join(bounded_broadcast(needed), "k", "left_semi").select("k", "digest", "first"))
    # The sets that are in a pair, from one document each (from all without an id, if no other has the set).
    ids = bounded_broadcast(needed.select(F.col("first").alias("_first")).distinct())
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("_first")), "left_semi").select("text")

    def anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["digest", "grams"])

    grams = texts.mapInArrow(anew, "digest binary, grams binary").join(bounded_broadcast(needed.select("k", "digest")), "digest")
    return staged(grams.groupBy("k").agg(F.first("grams").alias("grams")))


def _links(docs: DataFrame, sets: DataFrame, pairs: DataFrame, words: int, percent: int, size: int) -> DataFrame:
    """(a, b): the pairs (x, y) that reach the similarity. A query and up to about `size` candidates are one search."""
    pairs = staged(pairs)
    many = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > size)
    piece = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("y"), F.ceil(F.col("_n") / size))).otherwise(F.lit(0)).cast("long")
    pairs = pairs.join(bounded_broadcast(many), "x", "left").select("x", "y", piece.alias("piece"))
    grams = _grams_of(docs, sets, pairs.select(F.col("x").alias("k")).unionByName(pairs.select(F.col("y").alias("k"))).distinct(), words)
    asked = pairs.select("x", "piece").distinct().join(grams, F.col("x") == F.col("k")).select("x", "piece", F.lit(None).cast("long").alias("y"), "grams")
    given = pairs.join(grams, F.col("y") == F.col("k")).select("x", "piece", "y", "grams")
    dealt = asked.unionByName(given).repartition("x", "piece").sortWithinPartitions("x", "piece", F.col("y").asc_nulls_first())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, query, ys, sets = None, None, [], []

        def found():
            at = divide_skip(query, sets, percent) if sets else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.int64()), pa.array([ys[i] for i in at], pa.int64())], names=["a", "b"])

        for batch in batches:
            for qx, y, raw in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("grams"), strict=True):
                s = np.frombuffer(raw.as_py(), np.uint64)
                if y is None:
                    if ys:
                        yield found()
                    x, query, ys, sets = qx, s, [], []
                else:
                    ys.append(y)
                    sets.append(s)
        if ys:
            yield found()

    return staged(dealt.mapInArrow(search, "a long, b long"))


def _cross_links(docs: DataFrame, sets: DataFrame, met: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links among cross candidates. A task holds the sets of one home and the queries of another."""
    # The sets that a home is asked for, once for each home that asks: no others travel.
    def asked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["hx", "hy"]):
            ys = np.unique(np.frombuffer(b"".join(run.column("ys").to_pylist()), np.int64))
            hx, hy = (np.full(len(ys), run.column(c)[0].as_py(), np.int64) for c in ("hx", "hy"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hx, hy, ys)], names=["hx", "hy", "k"])

    given = met.select("hx", "hy", "ys").repartition("hx", "hy").sortWithinPartitions("hx", "hy").mapInArrow(asked_for, "hx long, hy long, k long")
    given = staged(given)
    grams = _grams_of(docs, sets, met.select(F.col("x").alias("k")).unionByName(given.select("k")).distinct(), words)
    held = given.join(grams, "k").select("hx", "hy", F.lit(0).alias("side"), "k", F.lit(None).cast("binary").alias("ys"), "grams")
    asked = met.withColumnRenamed("x", "k").join(grams, "k").select("hx", "hy", F.lit(1).alias("side"), "k", "ys", "grams")
    dealt = held.unionByName(asked).repartition("hx", "hy").sortWithinPartitions("hx", "hy", "side", "k")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sets = None, {}
        for batch in batches:
            a, b = [], []
            for hx, hy, side, k, ys, raw in zip(*(batch.column(c) for c in ("hx", "hy", "side", "k", "ys", "grams")), strict=True):
                if (hx, hy) != task:
                    task, sets = (hx, hy), {}
                own, k = np.frombuffer(raw.as_py(), np.uint64), k.as_py()
                if side.as_py() == 0:
                    sets[k] = own
                    continue
                ys = np.frombuffer(ys.as_py(), np.int64)
                for i in range(0, len(ys), SEARCH):
                    found = ys[i : i + SEARCH][divide_skip(own, [sets[y] for y in ys[i : i + SEARCH].tolist()], percent)]
                    a += [k] * len(found)
                    b += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return staged(dealt.mapInArrow(search, "a long, b long"))


def similar_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, size: int = LIST, search: int = SEARCH,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; a component is named by the smallest id it can reach.

    Rows with equal sets are one for the search and come out each. Null and empty texts and texts without a word have
    the empty set and are linked with nothing, not with each other either: they are named by their own id. A component
    of null ids only has a null name; repeated ids are rows of their own. Other columns, whatever their names, are
    not read.
    """
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    made = _sets(docs, words)
    rows = made.filter("chunk IS NULL").select("doc_id", "n", "digest")
    sets, lists = _lists(docs, _frequencies(made), words, percent, size)
    firsts = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"))
    sets = staged(sets.join(firsts, "digest"))
    nodes = sets.select(F.col("k").alias("id"))
    links = _links(docs, sets, _pivot_pairs(lists, percent), words, percent, search)
    near = staged(components(nodes, links))
    more = _cross_links(docs, sets, _cross_candidates(lists, near, percent, search), words, percent)
    # Whole components are joined by what the second round found.
    label = lambda end: near.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    bridges = more.join(label("a"), "a").join(label("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    joined = components(near.select(F.col("component").alias("id")).distinct(), bridges).withColumnRenamed("component", "whole")
    named = near.join(joined.withColumnRenamed("id", "component"), "component").select(F.col("id").alias("k"), "whole")
    of_set = sets.join(named, "k").select("digest", "first", "whole")
    names = of_set.groupBy("whole").agg(F.min("first").alias("component_id"))
    of_set = of_set.join(names, "whole").select("digest", "component_id")
    linked = rows.filter("n > 0").join(of_set, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
