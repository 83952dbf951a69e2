"""Token sequences of a fixed capacity, packed by best fit and improved by swap-based local search.

A document's ids are cut only beyond the capacity; full pieces are sequences of their own. The others are dealt
to shards of bounded size. Each shard starts from best-fit decreasing and then raises the sum of squared fill:
documents move into, or are exchanged one for one or two for one with, fuller bins, from the least filled bin on,
until no bin can be emptied any more. What lies in underfull bins, the least filled ones first, is dealt anew to half
as many shards or fewer until one shard holds the rest. Shards are dealt by hash or, where sequences are to keep to the
order of documents, are windows of neighbours in it.
"""

from __future__ import annotations

import itertools
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectext

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Expected pieces of one shard.
SHARD = 5000
#: Documents of one shard, neighbours, where sequences keep to the order of documents.
WINDOW = 512
#: Bits of a row number in the order of documents that are left to the pieces of one document.
PIECE_BITS = 20
#: Bins with less room than this part of the capacity count as full; the others are dealt anew.
FULL = 64
#: Words whose ids a worker keeps in memory.
CACHE_WORDS = 200_000

# The tokenizer's word pattern on lower-cased Latin-1 text, and its white space.
WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+"
    "|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\t\n\x0b\x0c\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


@cache
def _tokenizer(name: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))


class WordIds:
    """Ids of texts through remembered ids of their words.

    Texts beyond Latin-1 and texts that hold one of the tokenizer's special strings go through it whole.

    Each word of the pattern is encoded on its own by the tokenizer, so the ids are the same. The first
    CACHE_WORDS words stay remembered (frequent ones come early), later ones only while their texts are encoded.
    """

    def __init__(self, name: str = TOKENIZER):
        self.tokenizer = _tokenizer(name)
        special = sorted({x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()}, key=len)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.missed = 0

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each): one string with a space between them, as the pattern splits there."""
        enc = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, word = np.array(enc.ids, np.uint32), np.array(enc.word_ids, np.int64)
        if not len(word) or word[-1] + 1 != len(words):
            raise ValueError("the tokenizer's words differ from the pattern's")
        return ids, np.bincount(word, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        ids, sizes = self._ids(words)
        at, n = len(self.index), len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[at : at + n] = sizes
        self.starts[at : at + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.index.update(zip(words, range(at, at + n), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if self.missed > 20 * CACHE_WORDS:  # another corpus
            self.clear()
        words, counts, slow = [], [], {}
        for k, text in enumerate(texts):
            try:
                text.encode("latin-1")
                low = text.lower()
            except UnicodeEncodeError:
                low = None
            if low is not None and not self.special.search(low):
                found = WORDS.findall(low)
            else:
                slow[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                found = []
            words += found
            counts.append(len(found))
        at = np.fromiter(map(self.index.get, words, itertools.repeat(-1)), np.int64, len(words))
        flat, starts, sizes = self.flat, self.starts, self.sizes
        if len(missing := np.flatnonzero(at < 0)):
            unknown = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(unknown))
            if len(self.index) < CACHE_WORDS:
                self._learn(new)
                at[missing] = [self.index[w] for w in unknown]
                flat, starts, sizes = self.flat, self.starts, self.sizes
            else:
                self.missed += len(new)
                ids, n = self._ids(new)
                place = dict(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
                at[missing] = [place[w] for w in unknown]
                flat = np.concatenate([flat[: self.used], ids])
                starts = np.concatenate([starts[: len(self.index)], self.used + np.cumsum(n) - n])
                sizes = np.concatenate([sizes[: len(self.index)], n])
        n = sizes[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return [slow[k] if k in slow else ids[stops[k] : stops[k + 1]] for k in range(len(texts))]


@cache
def _word_ids(name: str) -> WordIds:
    """One memory of words by process: tasks that follow each other in a worker share it."""
    return WordIds(name)


def _pieces(capacity: int, tokenizer: str, with_ids: bool):
    def run(batches):
        words = _word_ids(tokenizer)
        for batch in batches:
            doc_ids, texts, kept = batch.column(0).to_pylist(), batch.column(1), batch.columns[2:]
            _, offs = vectext.buffers(texts)
            texts, row = [t or "" for t in texts.to_pylist()], 0
            while row < len(texts):
                end = min(max(int(np.searchsorted(offs, offs[row] + vectext.CHUNK_BYTES, "right")) - 1, row + 1), len(texts))
                out: list[tuple] = []
                of: list[int] = []
                for k, (doc_id, ids) in enumerate(zip(doc_ids[row:end], words.encode(texts[row:end]), strict=True), row):
                    ids = np.append(ids, END_ID).astype("<u4")
                    of += [k] * -(-len(ids) // capacity)
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        raw = ids[start : start + capacity].tobytes()
                        out.append((doc_id, piece, start, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5]), *([pa.array(cols[5], pa.binary())] if with_ids else []), *(c.take(pa.array(of)) for c in kept)], ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + batch.schema.names[2:])
                row = end

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False, position: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids][, position]) of every document's ids, END_ID last; a null text is empty.

    position: a bigint column of docs that its pieces keep.
    """
    common.small_batches(docs.sparkSession)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids + f", `{position}` bigint" * bool(position)
    return docs.select("doc_id", "text", *[position] * bool(position)).mapInArrow(_pieces(capacity, tokenizer, with_ids), schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of the lengths in each bin. A bit mask finds the least room that suffices."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[k]
        free = mask >> n
        if free:
            room = n + (free & -free).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
            bins[b].append(k)
            room -= n
        else:
            b, room = len(bins), capacity - n
            bins.append([k])
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return bins


class _Search:
    """Underfull bins of a shard: rooms, members and what a document can be exchanged for."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.lengths, self.capacity = np.array(lengths, np.int64), capacity
        self.bins, self.changes = [list(b) for b in bins], 0
        self.room = np.array([capacity - sum(lengths[k] for k in b) for b in bins], np.int64)
        self.at = np.full(len(lengths), -1)
        # pairs of members: sum, bin and both documents; those of a bin that has changed are no longer valid
        self.pairs, self.valid, self.n_pairs = np.zeros((4, 1 << 12), np.int64), np.zeros(1 << 12, bool), 0
        self.of_bin: dict[int, slice] = {}
        for i, b in enumerate(self.bins):
            if self.room[i]:
                self.at[b] = i
                self._pair(i)
        self.docs = np.flatnonzero(self.at >= 0)

    def open_bins(self) -> np.ndarray:
        """Underfull bins that hold something, the least filled first."""
        i = np.flatnonzero((self.room > 0) & (self.room < self.capacity))
        return i[np.argsort(-self.room[i], kind="stable")]

    def _pair(self, i: int) -> None:
        """Lists the pairs of bin i anew."""
        if i in self.of_bin:
            self.valid[self.of_bin.pop(i)] = False
        members = np.array(self.bins[i], np.int64)
        if not self.room[i] or len(members) < 2:
            return
        a, b = (members[k] for k in np.triu_indices(len(members), 1))
        if self.n_pairs + len(a) > self.pairs.shape[1]:  # make room: drop what isn't valid, then grow
            keep = np.flatnonzero(self.valid[: self.n_pairs])
            kept = self.pairs[:, keep]
            size = max(1 << 12, 2 * (len(keep) + len(a)))
            self.pairs, self.valid, self.n_pairs = np.zeros((4, size), np.int64), np.zeros(size, bool), len(keep)
            self.pairs[:, : len(keep)], self.valid[: len(keep)] = kept, True
            starts = np.flatnonzero(np.diff(kept[1], prepend=-1))
            self.of_bin = {int(kept[1, x]): slice(int(x), int(y)) for x, y in zip(starts, np.append(starts[1:], len(keep)))}
        at = slice(self.n_pairs, self.n_pairs + len(a))
        self.pairs[:, at] = np.stack([self.lengths[a] + self.lengths[b], np.full(len(a), i), a, b])
        self.valid[at], self.of_bin[i] = True, at
        self.n_pairs += len(a)

    def exchange(self, v: int, d: int, others: np.ndarray) -> tuple[int, int, tuple[int, ...]] | None:
        """(gain, bin, documents in return) of the best exchange of document d of bin v; None if there is none."""
        need = int(self.lengths[d])
        fits = others[self.room[others] >= need]
        if len(fits):  # a move, into the fullest such bin
            return need, int(fits[-1]), ()
        best = None
        docs = self.docs
        home, own = self.at[docs], self.lengths[docs]
        ok = (home != v) & (self.room[home] <= self.room[v]) & (own < need) & (own + self.room[home] >= need)
        if ok.any():
            e = docs[ok][np.argmin(own[ok])]
            best = need - int(self.lengths[e]), int(self.at[e]), (int(e),)
        sums, home = self.pairs[0, : self.n_pairs], self.pairs[1, : self.n_pairs]
        ok = np.flatnonzero(self.valid[: self.n_pairs] & (sums < need) & (sums + self.room[home] >= need) & (home != v) & (self.room[home] <= self.room[v]))
        if len(ok):
            k = ok[np.argmin(sums[ok])]
            if best is None or need - sums[k] > best[0]:
                best = need - int(sums[k]), int(home[k]), (int(self.pairs[2, k]), int(self.pairs[3, k]))
        return best

    def apply(self, v: int, d: int, gain: int, i: int, back: tuple[int, ...]) -> None:
        self.changes += 1
        self.bins[v] = [k for k in self.bins[v] if k != d] + list(back)
        self.bins[i] = [k for k in self.bins[i] if k not in back] + [d]
        self.at[d], self.room[v], self.room[i] = i, self.room[v] + gain, self.room[i] - gain
        self.at[list(back)] = v
        for k in (v, i):
            self._pair(k)
        if not self.room[i]:
            self.at[self.bins[i]] = -1
            self.docs = np.flatnonzero(self.at >= 0)

    def empty(self, v: int) -> None:
        """Exchanges bin v's documents as long as some exchange makes a fuller bin still fuller."""
        changed = True
        while changed and self.bins[v]:
            changed = False
            others = self.open_bins()
            others = others[(others != v) & (self.room[others] <= self.room[v])]
            if self.room[others].sum() < self.capacity - self.room[v]:
                return
            for d in sorted(self.bins[v], key=lambda k: -self.lengths[k]):
                if found := self.exchange(v, d, others):
                    self.apply(v, d, *found)
                    changed = True
                    break


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: empties bins, the least filled first, by moves and swaps that raise the sum of squared fill.

    From a bin a document d goes to a bin with enough room, or to one as full or fuller that gives a smaller document
    (one for one) or two that are smaller together (two for one) in return. Every underfull bin is tried; it ends
    when a pass over all of them changes nothing, or at the least number of bins for so many tokens.
    """
    search, least_bins = _Search(bins, lengths, capacity), -(-sum(lengths) // capacity)
    alive, before = len(bins), -1
    while alive > least_bins and search.changes != before:
        before = search.changes
        for v in search.open_bins().tolist():
            if alive <= least_bins:
                break
            if 0 < search.room[v] < capacity:
                search.empty(v)
                alive -= not search.bins[v]
    return [b for b in search.bins if b]


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        rows, lengths = table.column("row").to_pylist(), table.column("length").to_pylist()
        order = sorted(range(len(rows)), key=rows.__getitem__)
        rows, lengths = [rows[k] for k in order], [lengths[k] for k in order]
        out = []
        for b in improve(best_fit(lengths, capacity), lengths, capacity):
            b, at = sorted(b), 0
            fill = sum(lengths[k] for k in b)
            for k in b:
                out.append((rows[k], lengths[k], rows[b[0]], at, fill))
                at += lengths[k]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "length", "sequence_id", "offset", "fill"])

    return run


def _least_filled(by_fill: dict[int, int], most: int, level: int) -> F.Column:
    """Condition of the rows in underfull bins, the least filled ones with about `most` rows in all (by_fill: rows by fill)."""
    found = F.lit(False)
    for fill in sorted(by_fill):
        if by_fill[fill] > most:  # of equally filled bins a part, by hash
            part = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(1 << 20)) < (most << 20) // by_fill[fill]
            return (F.col("fill") < fill) & found | (F.col("fill") == fill) & part
        found, most = F.col("fill") <= fill, most - by_fill[fill]
    return found


def _neighbours(left: DataFrame, level: int, window: Column) -> DataFrame:
    """left with its shard: the window, in later rounds neighbouring windows with about WINDOW rows together."""
    if not level:
        return left.withColumn("shard", window)
    left = left.withColumn("window", window)
    # one row for WINDOW documents
    sizes = common.stored(left.groupBy("window").agg(F.count("*").alias("n")), "windows")
    shards = sizes.select("window", F.floor((F.sum("n").over(Window.orderBy("window")) - F.col("n")) / WINDOW).alias("shard"))
    return left.join(F.broadcast(shards), "window").drop("window")


def pack(lengths: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, window: Column | None = None) -> DataFrame:
    """(row, sequence_id, offset) for rows (row bigint, unique; length 1 to capacity); gapless from 0 in each sequence.

    A sequence is named by its least row. Each round deals rows of underfull bins, the least filled ones with at most
    half of the round's rows, to shards of about `shard` rows, so that bins of different shards meet; it ends with
    one shard or without underfull bins. All rounds together handle at most twice the rows. An empty table
    gives an empty result.

    window: a number by row that never falls as row rises and that at most WINDOW rows below `capacity` share. Each
    round's shards are then neighbours in the order of rows, at first windows and later about WINDOW rows of underfull
    bins until `shard` rows are left, so that sequences by id keep to the order of rows.
    """
    left = lengths.filter(F.col("length") < capacity).select("row", "length")
    done = [lengths.filter(F.col("length") == capacity).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    n, level = left.count(), 0
    while n:
        shards = max(1, -(-n // (shard if window is None or level else WINDOW)))
        if window is None or shards == 1:
            dealt = left.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
        else:
            dealt = _neighbours(left, level, window)
        packed = common.stored(dealt.groupBy("shard").applyInArrow(_pack(capacity), "row bigint, length bigint, sequence_id bigint, offset bigint, fill bigint"), f"packed-{level}")
        if shards == 1:
            done.append(packed.select("row", "sequence_id", "offset"))
            break
        # at most `capacity` rows
        by_fill = {r.fill: r.n for r in packed.filter(F.col("fill") < capacity - capacity // FULL).groupBy("fill").agg(F.count("*").alias("n")).collect()}
        again = _least_filled(by_fill, n // 2, level)
        done.append(packed.filter(~again).select("row", "sequence_id", "offset"))
        left = packed.filter(again).select("row", "length")
        n, level = left.count(), level + 1
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found


def _placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, position) of docs, positions from 0 in the order of the table's files and their rows.

    What isn't a table as read is written first, in the order of its partitions and their rows.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation":
        docs = common.stored(docs.select("doc_id", "text"), "in-order")
    at = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", "text", at["file_path"].alias("file"), at["row_index"].alias("at"))
    sizes = common.stored(rows.groupBy("file").agg(F.count("*").alias("n")), "file-sizes")
    # part numbers beyond 99,999 have more digits
    before = sizes.select("file", (F.sum("n").over(Window.orderBy(F.length("file"), "file")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "file").select("doc_id", "text", (F.col("before") + F.col("at")).alias("position"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, with_ids: bool = False, in_order: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of every document.

    Null and empty texts are one piece with END_ID alone; rows that repeat a doc_id are packed each by itself, null
    ids stay null; columns other than doc_id and text are ignored. An empty table gives an empty result.

    in_order: sequences by sequence_id follow the order of docs (of its files and their rows), and documents inside a
    sequence do, too. WINDOW neighbours share sequences; what they leave in underfull bins joins that of other windows.
    """
    if not in_order:
        cut = common.stored(pieces(docs, capacity, tokenizer, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
        return cut.join(pack(cut.select("row", "length"), capacity), "row").drop("row")
    row = F.shiftleft("position", PIECE_BITS) + F.col("piece")
    cut = common.stored(pieces(_placed(docs), capacity, tokenizer, with_ids, "position").withColumn("row", row).drop("position"), "pieces")
    # of a document one piece at most is below the capacity
    window = F.floor(F.shiftright("row", PIECE_BITS) / WINDOW)
    return cut.join(pack(cut.select("row", "length"), capacity, window=window), "row").drop("row")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
