"""Packing of tokenised documents into sequences of fixed length: best fit, then swap-based local search.

Pieces are dealt by hash into blocks of bounded size. A block is packed by best fit decreasing; then the emptiest
bin gives documents away, by a move or by exchanging one or two of them against shorter ones of fuller bins, as long
as the squared fill grows, until it is empty and another bin becomes the emptiest. What stays rather empty in every
block is pooled and packed again, until one block holds the pool or a round saves no bin.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import BOUNDARY, give_back, giving_back, slices, staged, worker_cache
from missiva.llm.counts import load_tokenizer

BLOCK = 8192
# Encoded words that a worker holds at most.
CACHE = 1_000_000
# Bytes of text whose words are held at once.
SLICE = 1 << 23
# A blank of any kind before a space: such texts are not simply cut at each space.
BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}] "
# A letter and a comma or full stop behind it are always split.
MARKED = "[A-Za-zÀ-ÖØ-öø-ɏ][,.]$"


def encode_pieces(tokenizer, pieces: list[str], size: int = 4096) -> dict[str, bytes]:
    """Ids of each piece, as little-endian unsigned 32-bit numbers.

    Pieces of one blank and a run of other signs are encoded as lines of one text: the tokenizer splits before and
    after a line end that a blank follows, and gives it an id of its own. All others are encoded one by one.
    """
    out: dict[str, bytes] = {}
    line, *more = tokenizer.encode("\n", add_special_tokens=False).ids
    plain = [] if more else [p for p in pieces if p[:1] == " " and len(p) > 1 and p.split() == [p[1:]]]
    for i in range(0, len(plain), size):
        some = plain[i : i + size]
        ids = np.array(tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(ids == line) * 4).tolist()
        if len(cuts) == len(some) - 1:
            raw = ids.tobytes()
            out.update(zip(some, map(raw.__getitem__, map(slice, [0, *[c + 4 for c in cuts]], [*cuts, len(raw)])), strict=True))
    rest = [p for p in pieces if p not in out]
    for i in range(0, len(rest), size):
        encoded = tokenizer.encode_batch_fast(rest[i : i + size], add_special_tokens=False)
        out.update(zip(rest[i : i + size], (np.array(e.ids, "<u4").tobytes() for e in encoded), strict=True))
    return out


def word_ids(tokenizer, words: pa.Array, kept: dict) -> pa.Array:
    """The ids of a blank and each of some distinct words; `kept` holds the words that were encoded before."""
    none = pa.scalar(b"", pa.binary())
    known, ids = kept.setdefault("words", (pa.array([], pa.string()), pa.array([], pa.binary())))
    # One entry serves a word with and without the mark behind it.
    marked = pc.match_substring_regex(words, MARKED)
    bare = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
    at = pc.index_in(bare.dictionary, known)
    new = bare.dictionary.filter(pc.is_null(at))
    pieces = pc.binary_join_element_wise("", new, " ").to_pylist()
    more = encode_pieces(tokenizer, [*pieces, ",", "."])
    both = pa.concat_arrays([ids, pa.array(map(more.__getitem__, pieces), pa.binary())])
    place = at.fill_null(-1).to_numpy()
    place = np.where(place < 0, len(known) - 1 + np.cumsum(place < 0), place)
    found = both.take(pa.array(place[bare.indices.to_numpy()]))
    if len(both) <= CACHE:
        kept["words"] = pa.concat_arrays([known, new]), both
    mark = pc.if_else(marked, pc.if_else(pc.ends_with(words, ","), pa.scalar(more[","], pa.binary()), pa.scalar(more["."], pa.binary())), none)
    return pc.binary_join_element_wise(found, mark, none)


def text_ids(tokenizer, texts: pa.Array, kept: dict) -> Iterator[bytes]:
    """The ids of each text, from those of its words: texts are cut before blanks, where the tokenizer's own splits lie."""
    cut = pc.split_pattern(texts, " ")
    odd = np.flatnonzero(pc.match_substring_regex(texts, BLANKS).to_numpy(zero_copy_only=False))
    if len(odd):
        # The blank before each later piece goes, as it does where the text is cut at each space.
        some = [[head, *[p[1:] for p in rest]] for head, *rest in map(BOUNDARY.split, texts.take(pa.array(odd)).to_pylist())]
        at = np.arange(len(texts))
        at[odd] = len(texts) + np.arange(len(odd))
        cut = pa.concat_arrays([cut, pa.array(some, cut.type)]).take(pa.array(at))
    flat, sizes = cut.flatten(), cut.value_lengths().to_numpy()
    first = np.cumsum(sizes) - sizes
    later = np.ones(len(flat), bool)
    later[first] = False
    heads = flat.take(pa.array(first)).to_pylist()
    head_ids = encode_pieces(tokenizer, list(set(heads)))
    words = flat.filter(pa.array(later)).dictionary_encode()
    ids = word_ids(tokenizer, words.dictionary, kept).take(words.indices)
    _, offsets, data = ids.buffers()
    bounds = np.frombuffer(offsets, np.int32)[np.append(0, np.cumsum(sizes - 1))].tolist() if len(ids) else [0] * (len(texts) + 1)
    raw = memoryview(data or b"")
    for head, lo, hi in zip(heads, bounds[:-1], bounds[1:], strict=True):
        yield head_ids[head] + raw[lo:hi]


def document_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of every row, then `end_id`, cut only where too long.

    `ids` holds little-endian unsigned 32-bit numbers. A longer document is cut into pieces of `capacity` ids; only
    the first may be shorter. A null text counts as empty and gives one piece with the end id; repeated rows repeat.
    The words of many texts are encoded at once, and frequent ones once per worker.
    """
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache, end = worker_cache("packing"), np.uint32(end_id).tobytes()
        tokenizer, kept = load_tokenizer(vocabulary, cache), cache.setdefault(f"ids {vocabulary}", {})
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                doc, piece, start, length, ids = [], [], [], [], []
                for i, found in enumerate(text_ids(tokenizer, part.column("text").fill_null(""), kept)):
                    raw = found + end
                    n, at, k = len(raw) // 4, 0, 0
                    while at < n:
                        to = at + (n % capacity or capacity) if k == 0 else at + capacity
                        doc.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(to - at)
                        ids.append(raw[4 * at : 4 * to])
                        at, k = to, k + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )
                give_back()

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(giving_back(encode), f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin) for lengths in falling order: each goes where least room remains."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, fill = 0, np.empty(len(lengths), np.int64), []
    for i, size in enumerate(lengths.tolist()):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i] = b
        fill[b] += size
        if r > size:
            room[r - size].append(b)
            mask |= 1 << (r - size)
    return bins, np.array(fill, np.int64)


def local_search(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int) -> None:
    """Empty bins in place, emptiest first, by moves and exchanges that raise the squared fill.

    Stops when the bins are as few as their content allows, or when no bin has an improving exchange left.
    """
    least, stuck, changed = -(-int(fill.sum()) // capacity), set(), False
    while int((fill > 0).sum()) > least:
        order = [int(b) for b in np.argsort(fill, kind="stable") if 0 < fill[b] < capacity and int(b) not in stuck]
        if len(order) < 2:
            if not changed:
                return
            # Exchanges with other bins may have opened room for a bin that was stuck before; squared fill bounds the rounds.
            stuck, changed = set(), False
            continue
        donor, had = order[0], fill[order[0]]
        if not _give(lengths, bins, fill, capacity, donor):
            stuck.add(donor)
        changed |= bool(fill[donor] != had)


def _give(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, capacity: int, donor: int) -> bool:
    """Exchange until the donor is empty; False if it cannot be emptied."""
    while fill[donor] > 0:
        own = np.flatnonzero(bins == donor)
        others = np.flatnonzero((fill[bins] < capacity) & (bins != donor) & (fill[bins] >= fill[donor]))
        gap = capacity - fill[bins[others]]
        # A move: the largest item that fits anywhere, into the tightest room.
        free = np.flatnonzero((fill < capacity) & (fill >= fill[donor]) & (np.arange(len(fill)) != donor))
        if len(free):
            room = capacity - fill[free]
            fitting = own[lengths[own] <= room.max()]
            if len(fitting):
                item = fitting[np.argmax(lengths[fitting])]
                ok = free[room >= lengths[item]]
                _move(lengths, bins, fill, item, ok[np.argmax(fill[ok])])
                continue
        if not len(others):
            return False
        # One for one: what the other bin gains must fit into its room.
        first = own[np.unique(lengths[own], return_index=True)[1]]
        gain = lengths[first][:, None] - lengths[others][None, :]
        gain = np.where(gain <= gap[None, :], gain, 0)
        best = int(gain.argmax())
        if gain.flat[best] > 0:
            a, b = first[best // len(others)], others[best % len(others)]
            home = bins[b]
            _move(lengths, bins, fill, b, donor)
            _move(lengths, bins, fill, a, home)
            continue
        # Two for one.
        if len(own) > 1:
            i, j = np.triu_indices(len(own), 1)
            both, at = np.unique(lengths[own[i]] + lengths[own[j]], return_index=True)
            swapped = False
            for k in range(0, len(both), 64):
                gain = both[k : k + 64, None] - lengths[others][None, :]
                gain = np.where(gain <= gap[None, :], gain, 0)
                best = int(gain.argmax())
                if gain.flat[best] > 0:
                    pair, b = at[k + best // len(others)], others[best % len(others)]
                    home = bins[b]
                    _move(lengths, bins, fill, b, donor)
                    _move(lengths, bins, fill, own[i[pair]], home)
                    _move(lengths, bins, fill, own[j[pair]], home)
                    swapped = True
                    break
            if swapped:
                continue
        return False
    return True


def _move(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, item: int, to: int) -> None:
    fill[bins[item]] -= lengths[item]
    fill[to] += lengths[item]
    bins[item] = to


def _packer(names: list[str], capacity: int, step: int, last: bool):
    def fill_block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, fill = best_fit(lengths, capacity)
        local_search(lengths, bins, fill, capacity)
        order = np.argsort(bins, kind="stable")
        starts = np.cumsum(lengths[order]) - lengths[order]
        first = np.searchsorted(bins[order], np.arange(len(fill)))
        offset = np.empty(len(group), np.int64)
        offset[order] = starts - starts[np.minimum(first, len(group) - 1)][bins[order]]
        group["sequence_id"] = (step << 56) + (group["_block"].to_numpy() << 24) + bins
        group["offset"] = offset
        # Bins with much room are packed again together with those of other blocks.
        group["open"] = (fill[bins] < capacity - capacity // 8) & (not last)
        return group[names]

    return fill_block


def pack(pieces: DataFrame, capacity: int = 2048, block: int = BLOCK) -> DataFrame:
    """`pieces` (doc_id, piece, start, length and any further columns) with sequence_id and offset.

    No sequence holds more than `capacity` ids, offsets have no gaps, and only full columns of numbers travel: the
    ids stay where they are. Pieces are dealt by row, so blocks hold about `block` pieces however many of them share an
    id or are equal. Equal lengths are ordered by id, piece and start. Every piece is placed: a round that saves none
    of the pool's bins closes all of them as they are.
    """
    names = pieces.columns
    todo = staged(pieces.withColumn("_row", F.monotonically_increasing_id()))
    schema = todo.schema.add("sequence_id", "long").add("offset", "long").add("open", "boolean")
    done, step, before = None, 0, None
    while True:
        blocks = max(1, -(-todo.count() // block))
        dealt = todo.withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(step)), F.lit(blocks)))
        packed = staged(dealt.groupBy("_block").applyInPandas(_packer(schema.names, capacity, step, blocks == 1), schema))
        # Every bin has one piece at its start.
        bins, still = packed.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col("open"))).first()
        last = blocks == 1 or still == 0 or (before is not None and bins >= before)
        closed = (packed if last else packed.filter("NOT open")).select(*names, "sequence_id", "offset")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        before = still
        todo = packed.filter("open").drop("open", "sequence_id", "offset")
        step += 1


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token ids, from the ids of `document_pieces` and the result of `pack`."""
    keys = ["doc_id", "piece", "start"]
    on = [pieces[k].eqNullSafe(placed[k]) for k in keys]
    # Repeated rows have equal ids, so any one of them stands for all.
    joined = placed.join(pieces.dropDuplicates(keys), on).select("sequence_id", "offset", "ids")
    parts = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
