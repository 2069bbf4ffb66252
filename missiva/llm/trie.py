"""The prefix tree of conversations, from double-array tries over prefix shards.

A conversation is a sequence of turns; equal sequences are counted once. A shard holds all sequences that share a
prefix and is bounded: a prefix with too many turns below it is cut again at twice its depth. A task packs whole
shards into BASE and CHECK arrays over dense turn ids, walks every sequence through them and sums the subtrees.
Nodes above the shards are merged over all shards by their prefix, and take up the sums of what hangs below them.

A turn is known by the SHA-256 of its role and text, a prefix by 124 bits that add up over its (place, turn) pairs,
so that a conversation of any length is hashed in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import staged
from missiva.operators.scale import bounded_broadcast, number_rows, running_sums

#: Turns below a shard's prefix.
LOAD = 65_536
#: Free places that are tried for the children of a node before they go to the end of the arrays.
TRIES = 64
#: Bytes of joined ids in one row.
JOINED = 1 << 16
BASE_STEP = 20
SUMS = ("_s0", "_s1", "_s2", "_s3")
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
NO_ENDS = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """BASE and CHECK over codes from 1: child c of s is t = BASE[s] + c if CHECK[t] is s. The root is slot 0."""

    def __init__(self) -> None:
        self.base, self.check, self.low = [0], [0], 1

    def _slot(self, start: int) -> int:
        try:
            return self.check.index(-1, start)
        except ValueError:
            return max(len(self.check), start)

    def add_children(self, state: int, codes: list[int]) -> None:
        """Place all children of a state at once; the codes ascend."""
        slot = self.low = self._slot(self.low)
        for _ in range(TRIES):
            places = [slot - codes[0] + c for c in codes]
            if all(t >= len(self.check) or self.check[t] == -1 for t in places):
                break
            slot = self._slot(slot + 1)
        else:
            places = [len(self.check) - codes[0] + c for c in codes]
        more = places[-1] + 1 - len(self.check)
        if more > 0:
            self.check += [-1] * more
            self.base += [0] * more
        self.base[state] = places[0] - codes[0]
        for t in places:
            self.check[t] = state

    @classmethod
    def of(cls, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> DoubleArray:
        """From sequences that lie one after the other in `codes`; all nodes of a depth are placed before the next."""
        out = cls()
        state = np.zeros(len(starts), np.int64)
        for j in range(int(lengths.max(initial=0))):
            alive = np.flatnonzero(lengths > j)
            code = codes[starts[alive] + j]
            pairs = np.unique(np.stack([state[alive], code], 1), axis=0)
            cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
            for group in np.split(pairs, cuts):
                out.add_children(int(group[0, 0]), group[:, 1].tolist())
            state[alive] = np.array([out.base[s] for s in state[alive].tolist()]) + code
        return out


def _shard_nodes(b: pa.Table) -> pa.RecordBatch:
    """All nodes of whole shards: rows are ordered by shard, sequence and place."""
    rep, pos, top = (b.column(c).to_numpy() for c in ("rep", "pos", "top"))
    last, weight, words = (b.column(c).to_numpy() for c in ("len", "n", "words"))
    first = np.flatnonzero(pos == top)
    lengths = np.diff([*first, len(pos)])
    # Dense turn ids; a shard's own node stands for its whole prefix.
    ids: dict = {}
    shard = zip(*(b.column(c).to_numpy()[first].tolist() for c in ("top", "sp", "sq")), strict=True)
    heads = [ids.setdefault(s, len(ids) + 1) for s in shard]
    codes = np.array([ids.setdefault(k, len(ids) + 1) for k in b.column("turn").to_pylist()], np.int64)
    codes[first] = heads
    trie = DoubleArray.of(codes, first, lengths)
    base, check = np.array(trie.base), np.array(trie.check)
    size = len(check)
    n, leaves, saved, said, depth, row = (np.zeros(size, np.int64) for _ in range(6))
    least, end = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    ends = np.zeros(size, bool)
    state = np.zeros(len(first), np.int64)
    levels = []
    for j in range(int(lengths.max(initial=0))):
        alive = np.flatnonzero(lengths > j)
        at = first[alive] + j
        to = base[state[alive]] + codes[at]
        if (check[to] != state[alive]).any():
            raise AssertionError("a sequence left the trie")
        state[alive] = to
        np.add.at(n, to, weight[at])
        np.minimum.at(least, to, rep[at])
        said[to], depth[to], row[to] = words[at], pos[at], at
        done = pos[at] == last[at]
        end[to[done]], ends[to[done]] = rep[at[done]], True
        levels.append(np.unique(to))
    nodes = np.concatenate(levels)
    children = np.bincount(check[nodes], minlength=size)
    for level in reversed(levels):
        leaves[level] += children[level] == 0
        saved[level] += (n[level] - 1) * said[level]
        np.add.at(leaves, check[level], leaves[level])
        np.add.at(saved, check[level], saved[level])
    above = check[nodes]
    is_top = above == 0
    col = lambda c: pa.array(b.column(c).to_numpy()[row[nodes]], mask=~is_top)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(least[nodes]), pa.array(depth[nodes]), pa.array(least[above], mask=is_top), pa.array(n[nodes]), pa.array(children[nodes]),
            pa.array(leaves[nodes]), pa.array(saved[nodes]), pa.array(end[nodes], mask=~ends[nodes]), col("pp"), col("pq"),
        ],
        names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep", "pp", "pq"],
    )


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take whole shards together until they hold LOAD turns; a shard never holds more."""
    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) < LOAD:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([rows.column(c).to_numpy() for c in ("top", "sp", "sq")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        if len(cuts):
            yield _shard_nodes(rows.slice(0, int(cuts[-1])))
            held = rows.slice(int(cuts[-1])).to_batches()
    if held and sum(x.num_rows for x in held):
        yield _shard_nodes(pa.Table.from_batches(held).combine_chunks())


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, turn, words): the place of every turn from 1, its digest and its number of words."""
    said, by = (F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) for x in (text, role))
    digest = F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary"), 256))
    words = F.regexp_count(said, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("at"), digest.alias("turn"), words.alias("words"))
    rows = staged(rows.filter("c IS NOT NULL"))
    return number_rows(rows, ["c"], [F.col("at").asc_nulls_first(), "turn"], "pos").select("c", "pos", "turn", "words")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, pos, turn, words) and all conversations (c, len) after the first turns were taken from the base."""
    kept = F.crc32(F.col("c").cast("string").cast("binary")) % 4
    base = F.col("c") - F.col("c") % BASE_STEP
    convs = turns.groupBy("c").agg(F.max("pos").alias("own")).select("c", "own", kept.alias("h"), base.alias("base"))
    heads = convs.filter("c = base").select("base", F.col("own").alias("given"))
    convs = convs.join(heads, "base", "left").select("c", "own", "h", "base", F.least("h", F.coalesce("given", F.lit(0))).alias("given"))
    convs = staged(convs.withColumn("len", F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("given")))
    first = turns.filter("c % 20 = 0 AND pos <= 3").withColumnRenamed("c", "base")
    taken = convs.filter("given > 0").select("c", "base", "h").join(first, "base").filter("pos <= h")
    rest = turns.join(convs.select("c", "h", "given"), "c").filter("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("given"))
    out = ["c", "pos", "turn", "words"]
    return taken.select(*out).unionByName(rest.select(*out)), convs.select("c", "len")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Turns with the ids (p, q) of the prefix that ends with them and (pp, pq) of the one before."""
    part = lambda k: F.xxhash64("turn", "pos", F.lit(k)).bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
    sums = running_sums(staged(turns), ["c"], ["pos"], {s: part(k) for k, s in enumerate(SUMS)})
    before = [F.col(s) - part(k) for k, s in enumerate(SUMS)]
    both = lambda cols: (F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols))
    (p, q), (pp, pq) = both([F.col(s) for s in SUMS]), both(before)
    return staged(sums.select("c", "pos", "turn", "words", p.alias("p"), q.alias("q"), pp.alias("pp"), pq.alias("pq")))


def _root_ids() -> tuple[Column, Column]:
    zero = [F.lit(0).cast("long")] * len(SUMS)
    return F.xxhash64(*zero), F.xxhash64(F.lit(1), *zero)


def _shards(rows: DataFrame, load: int) -> DataFrame:
    """(rep, top, sp, sq): the depth and prefix of each sequence's shard; sequences that end above have none."""
    out, depth, rest = None, 1, None
    while True:
        at = rows.filter(F.col("pos") == depth)
        if rest is not None:
            at = at.join(rest, "rep", "left_semi")
        at = staged(at.select("rep", "p", "q", (F.col("len") - depth + 1).alias("below")))
        loads = at.groupBy("p", "q").agg(F.sum("below").alias("load"))
        big = loads.filter(F.col("load") > load).select("p", "q")
        some = bounded_broadcast(big)
        done = at.join(some, ["p", "q"], "left_anti").select("rep", F.lit(depth).cast("long").alias("top"), F.col("p").alias("sp"), F.col("q").alias("sq"))
        out = done if out is None else out.unionByName(done)
        if big.limit(1).count() == 0:
            return staged(out)
        rest = staged(at.join(some, ["p", "q"], "left_semi").select("rep"))
        depth *= 2


def _with_subtrees(upper: DataFrame) -> DataFrame:
    """Add to each node the leaves and savings of all nodes below it, in rounds of doubled distance."""
    key, far = ["depth", "p", "q"], ["ad", "ap", "aq"]
    cur = staged(upper.withColumns({"ad": F.col("depth") - 1, "ap": F.col("pp"), "aq": F.col("pq")}))
    deepest = cur.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        below = cur.filter("ad >= 0").groupBy(*[F.col(a).alias(k) for a, k in zip(far, key, strict=True)]).agg(
            F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s")
        )
        jump = cur.select(*[F.col(k).alias(a) for k, a in zip(key, far, strict=True)], *[F.col(a).alias(f"_{a}") for a in far])
        cur = cur.join(below, key, "left").join(jump, far, "left").withColumns({
            "n_leaves": F.col("n_leaves") + F.coalesce("_l", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("_s", F.lit(0)),
            **{a: F.coalesce(f"_{a}", F.lit(-1)) for a in far},
        })
        cur = staged(cur.drop("_l", "_s", *[f"_{a}" for a in far]))
        reach *= 2
    return cur.drop(*far)


def _ends_hashes(members: DataFrame) -> DataFrame:
    """(end_rep, sha): SHA-256 of each sequence's conversations, ascending, joined by commas.

    The ids of a sequence are joined in sorted blocks on all tasks; its hash then runs over the blocks, one held at
    a time, as SHA-256 has to read them in order.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, ids, size = None, [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([int(ids[0])], pa.int64()), pa.array([",".join(ids).encode()], pa.binary())], names=["rep", "first", "ids"])

        for batch in batches:
            for r, c in zip(batch.column("rep").to_pylist(), batch.column("c").to_pylist(), strict=True):
                if ids and (r != rep or size > JOINED):
                    yield made()
                    ids, size = [], 0
                rep = r
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield made()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, sha = None, None
        for batch in batches:
            reps, shas = [], []
            for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids"), strict=True):
                if r != rep:
                    if sha is not None:
                        reps.append(rep)
                        shas.append(sha.hexdigest())
                    rep, sha = r, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(shas, pa.string())], names=["end_rep", "sha"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([sha.hexdigest()])], names=["end_rep", "sha"])

    many = members.filter("n > 1").select("rep", "c").repartitionByRange(parts, "rep", "c").sortWithinPartitions("rep", "c")
    joined = many.mapInArrow(join_ids, "rep long, first long, ids binary")
    hashed = joined.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids").mapInArrow(digest, "end_rep long, sha string")
    alone = members.filter("n = 1").select(F.col("rep").alias("end_rep"), F.sha2(F.col("c").cast("string").cast("binary"), 256).alias("sha"))
    return alone.unionByName(hashed)


def prefix_tree(turns: DataFrame, convs: DataFrame, load: int = LOAD) -> DataFrame:
    """(NODE columns, ends_sha256) of every distinct prefix of the sequences `turns` (c, pos, turn, words).

    `convs` (c, len) names all conversations, those without a turn included; they end at the root. No conversation,
    no node. `load` bounds the turns of a shard.
    """
    rows = _prefixes(turns)
    root_p, root_q = _root_ids()
    last = rows.groupBy("c").agg(F.max(F.struct("pos", "p", "q")).alias("z")).select("c", "z.p", "z.q")
    named = convs.join(last, "c", "left").select("c", "len", F.coalesce("p", root_p).alias("p"), F.coalesce("q", root_q).alias("q"))
    named = staged(named)
    classes = staged(named.groupBy("len", "p", "q").agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n")))
    members = named.join(classes, ["len", "p", "q"]).select("rep", "c", "n")
    seqs = staged(rows.withColumnRenamed("c", "rep").join(classes.select("rep", "len", "n"), "rep"))
    dealt = seqs.join(_shards(seqs, load), "rep", "left")
    low = dealt.filter("pos >= top").repartition("sp", "sq").sortWithinPartitions("top", "sp", "sq", "rep", "pos")
    low = staged(low.mapInArrow(_pack_shards, NODE + ", end_rep long, pp long, pq long"))
    whole = classes.agg(F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"), F.min(F.when(F.col("len") == 0, F.col("rep"))).alias("end_rep")).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = whole.select(zero.alias("depth"), root_p.alias("p"), root_q.alias("q"), none.alias("pp"), none.alias("pq"), "n_convs", "conv_id", zero.alias("words"), "end_rep")
    shared = dealt.filter("top IS NULL OR pos < top").groupBy(F.col("pos").alias("depth"), "p", "q").agg(
        F.first("pp").alias("pp"), F.first("pq").alias("pq"), F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"), F.first("words").alias("words"),
        F.max(F.when(F.col("pos") == F.col("len"), F.col("rep"))).alias("end_rep"),
    )
    upper = staged(root.unionByName(shared))
    above = [(F.col("depth") - 1).alias("depth"), F.col("pp").alias("p"), F.col("pq").alias("q")]
    hung = low.filter("pp IS NOT NULL").select(*above, "n_leaves", "saved_tokens").unionByName(upper.filter("depth > 0").select(*above, zero.alias("n_leaves"), zero.alias("saved_tokens")))
    hung = hung.groupBy("depth", "p", "q").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    upper = upper.join(hung, ["depth", "p", "q"], "left").withColumns({
        "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(F.col("n_leaves")), "n_children": F.coalesce("n_children", zero),
        "saved_tokens": F.coalesce("saved_tokens", zero) + (F.col("n_convs") - 1) * F.col("words"),
    })
    upper = _with_subtrees(upper)
    parents = bounded_broadcast(upper.select((F.col("depth") + 1).alias("depth"), F.col("p").alias("pp"), F.col("q").alias("pq"), F.col("conv_id").alias("_above")))
    names = [x.split()[0] for x in NODE.split(", ")]
    every = low.unionByName(upper.withColumn("parent_conv_id", none).select(*low.columns))
    every = every.join(parents, ["depth", "pp", "pq"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    out = every.join(_ends_hashes(members), "end_rep", "left")
    return out.select(*names, F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_tree(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", load: int = LOAD
) -> DataFrame:
    """One row per node of the prefix tree of the rebuilt conversations.

    Turns are ordered by number, null first; rows of one number by the SHA-256 of their role and text, and repeated
    rows are turns of their own. Null roles and texts count as empty, rows with a null conversation take no part.
    Conversation c takes its first h turns, h = crc32(c) % 4, from conversation c - c % 20 if that exists. An empty
    table gives no node. Other columns, whatever their names, are not read.
    """
    return prefix_tree(*rebuild(staged(numbered_turns(conversations, conv_id, turn, role, text))), load=load)
