"""Removal of byte strings that an earlier document holds, by blockwise suffix sorting with a difference cover.

A byte of a document is removed if it lies in a string of `length` bytes that also starts in a document with a
smaller id. Sorting every suffix of the corpus would move many times the input, so the suffixes are dealt to
buckets by content, and only those that can repeat are sorted:

1. Anchors. Each string of `length` bytes has an anchor: its leftmost K-byte substring with the smallest hash. Equal
   strings have equal anchors, so only strings whose anchor occurs in two documents can repeat. Groups of documents
   send the hashes of their anchors, each once, to buckets by hash; the buckets send back those of two documents.
2. Suffix buckets. The strings with one repeated anchor form a stretch of text of at most 2 * length - K bytes. Each
   group sends every different stretch once, with the smallest document id that holds it in the group, to the bucket
   of the anchor. A bucket sorts its suffixes by themselves, some whole anchor blocks at a
   time: a suffix is ordered by its first V bytes, and where these tie, by the ranks of the suffixes at the positions of
   the difference cover D modulo V. For any two residues there is a shift that puts both into the cover, so
   precomputed ranks of the cover's suffixes (prefix doubling over V, 2V, 4V, ... bytes) decide a tie of any length
   without reading on. Neighbours that share `length` bytes are equal strings; the smallest id of each run of them
   goes back to the groups that hold a larger one.
3. Each group marks the strings that an earlier document holds and removes their bytes.

Memory is bounded by the groups (GROUP_BYTES of text, or one longer text) and the buckets. A stretch that many
documents hold is sent once by each group, so hot passages are aggregated before they are shuffled. An anchor with
HOT_STRETCHES different stretches, as the first words of a passage that follows other text in each document, would put
them all into one bucket: its strings are dealt one by one instead, each to the bucket of its own hash, and once for
each group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.llm.common import flat_bytes
from metergrid.llm.shingles import R, mixed, range_hash, running_hash

#: Bytes of an anchor.
K = 16
#: Modulus of the difference cover, the cover, and for each pair of residues the shift into it.
V, COVER = 7, (0, 1, 3)
SHIFT = np.array([[next(d for d in range(V) if (a + d) % V in COVER and (b + d) % V in COVER) for b in range(V)] for a in range(V)])
GROUP_BYTES = 4 << 20
#: Text bytes for each bucket of step 1; a bucket of step 2 sorts the suffixes of about a fraction of it.
BUCKET_BYTES = 12 << 20
#: With this many different stretches an anchor is dealt by its strings.
HOT_STRETCHES = 1 << 15
#: Strings of a bucket that are sorted at a time, more only where one anchor has more.
SORTED_STRINGS = 1 << 18
#: Texts are hashed together up to this many bytes, longer ones alone.
PIECE = 1 << 17

BLOB = "bucket long, g long, body binary"


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one little-endian number; the last seven positions are left out."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    for o in range(min(8, max(n, 0))):
        count = (len(data) - o) // 8
        out[o::8] = np.frombuffer(data[o : o + 8 * count].tobytes(), "<u8")[: len(out[o::8])]
    return out


class Stretches:
    """The anchors of one piece of consecutive texts: for each anchor run its hash, first string, number of strings
    and text number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int):
        self.data = data
        empty = np.zeros(0, np.int64)
        self.hash, self.start, self.count, self.row = np.zeros(0, np.uint64), empty, empty, empty
        self.ends = self.hash
        self.length = length
        span = length - K + 1  # anchors that a string can have
        if len(data) < length:
            return
        eight = words_at(data)
        h = mixed(mixed(eight[: len(eight) - (K - 8)]) + eight[K - 8 :] * R)
        key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        low, width = key, 1
        while 2 * width <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        best = (low & np.uint64((1 << 32) - 1)).astype(np.int64)  # of the string that starts here
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(best)]
        inside = np.arange(len(best)) + length <= offsets[1:][row]
        change = np.ones(len(best), bool)
        change[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
        starts = np.flatnonzero(change & inside)
        if not len(starts):
            return
        ends = np.append(np.flatnonzero(change), len(best))
        stop = ends[np.searchsorted(ends, starts, side="right")]
        self.row = row[starts]
        last = np.minimum(stop, offsets[1:][self.row] - length + 1)
        self.start, self.count, self.hash = starts, last - starts, h[best[starts]]
        # tells most of the different stretches of an anchor
        self.ends = mixed(eight[starts] * R + eight[last + length - 9])

    def short(self, buckets: int) -> np.ndarray:
        """The hashes as the buckets of step 1 tell them."""
        return ((self.hash // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) + self.hash % np.uint64(buckets)

    def keep(self, index: np.ndarray) -> None:
        self.hash, self.start, self.count, self.row = self.hash[index], self.start[index], self.count[index], self.row[index]

    def deal_strings(self, hot: np.ndarray, buckets: int) -> None:
        """Replaces the stretches of the anchors `hot` by their strings, under hashes of their own."""
        split = np.isin(self.short(buckets), hot)
        if not split.any():
            return
        count = self.count[split]
        first = np.cumsum(count) - count
        start = np.repeat(self.start[split] - first, count) + np.arange(count.sum())
        row = np.repeat(self.row[split], count)
        self.keep(np.flatnonzero(~split))
        own = mixed(range_hash(running_hash(self.data), start, start + self.length))
        self.hash, self.start = np.concatenate([self.hash, own]), np.concatenate([self.start, start])
        self.count, self.row = np.concatenate([self.count, np.ones(len(start), np.int64)]), np.concatenate([self.row, row])


def pieces(column: pa.Array, length: int):
    """(first row, data, offsets) of consecutive texts with about PIECE bytes."""
    data, offsets = flat_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to



def _table(buckets: np.ndarray, g: np.ndarray, bodies: list[bytes]) -> pa.Table:
    return pa.table({"bucket": pa.array(buckets, pa.int64()), "g": pa.array(g, pa.int64()), "body": pa.array(bodies, pa.binary())})


def _cut(order_by: np.ndarray) -> np.ndarray:
    """Starts of the runs of a sorted array, and its end."""
    return np.append(np.flatnonzero(np.concatenate([[True], order_by[1:] != order_by[:-1]])), len(order_by)) if len(order_by) else np.zeros(1, np.int64)


def anchors_sent(docs: DataFrame, groups: int, buckets: int, length: int) -> DataFrame:
    """(bucket, g, body): the different anchor hashes of each group, with a mark where two documents of it share one;
    behind them, the place and number of stretches of the anchors that have more than one."""

    def run(batches):
        for batch in batches:
            found_h, found_ends, found_row = [], [], []
            for at, data, offsets in pieces(batch.column("text"), length):
                s = Stretches(data, offsets, length)
                found_h.append(s.hash)
                found_ends.append(s.ends)
                found_row.append(s.row + at)
            if not found_h:
                continue
            h, ends, row = np.concatenate(found_h), np.concatenate(found_ends), np.concatenate(found_row)
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            order = order[np.append(False, same) | np.append(same, False)]
            order = order[np.lexsort((ends[order], h[order]))]
            of = _cut(h[order])
            fresh = _cut_pairs(h[order], ends[order])[:-1]
            different = np.diff(np.searchsorted(fresh, of))
            many_h, many = h[order][of[:-1]][different > 1], different[different > 1]
            ids, g = batch.column("id").to_numpy()[row], batch.column("g").to_numpy()[row]
            order = np.lexsort((ids, h, g))
            h, ids, g = h[order], ids[order], g[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            other = np.zeros(len(h), bool)
            other[1:] = ~new[1:] & (ids[1:] != ids[:-1])
            starts = np.flatnonzero(new)
            if not len(starts):
                continue
            several = np.logical_or.reduceat(other, starts)
            h, g = h[starts], g[starts]
            bucket, rest = (h % np.uint64(buckets)).astype(np.int64), ((h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            order = np.lexsort((g, bucket))
            bucket, rest, g, several, h = bucket[order], rest[order], g[order], several[order], h[order]
            cut = _cut(bucket)
            mark = (g.astype(np.uint32) << np.uint32(1)) | several
            # an entry of each anchor with several stretches
            which = np.searchsorted(many_h, h)
            place = np.flatnonzero(np.append(many_h, np.uint64(0))[which] == h)
            place = place[which[place] < len(many_h)]
            which, first = np.unique(which[place], return_index=True)
            by_place = np.argsort(place[first])
            place, many = place[first][by_place], many[which][by_place]
            extra = np.searchsorted(place, cut)
            bodies = []
            for a, b, x, y in zip(cut[:-1], cut[1:], extra[:-1], extra[1:], strict=True):
                counts = np.stack([place[x:y] - a, many[x:y]]).astype(np.uint32)
                bodies.append(np.uint32(b - a).tobytes() + rest[a:b].tobytes() + mark[a:b].astype(np.uint32).tobytes() + counts.tobytes())
            yield from _table(bucket[cut[:-1]], np.full(len(bodies), -1), bodies).to_batches()

    return docs.mapInArrow(run, BLOB)


def anchors_repeated(sent: DataFrame) -> DataFrame:
    """(bucket, g, body): for each group the hashes that two documents hold, and that the group itself holds; behind
    them those with HOT_STRETCHES stretches."""
    hot_stretches = HOT_STRETCHES

    def run(key, table):
        parts, counted = [], []
        for x in table.column("body").to_pylist():
            values = np.frombuffer(x, np.uint32)
            n = int(values[0])
            part, (place, many) = values[1 : 1 + 2 * n].reshape(2, n), values[1 + 2 * n :].reshape(2, -1)
            parts.append(part)
            counted.append(np.stack([part[0][place], many]))
        rest, mark = np.concatenate(parts, axis=1)
        name, many = np.concatenate(counted, axis=1)
        name, where = np.unique(name, return_inverse=True)
        hot = name[np.bincount(where, many, len(name)) >= hot_stretches]
        order = np.lexsort((mark, rest))
        rest, mark = rest[order], mark[order]
        cut = _cut(rest)
        several = np.maximum.reduceat(mark & np.uint32(1), cut[:-1]).astype(bool) | (np.diff(cut) > 1)
        keep = np.repeat(several, np.diff(cut))
        rest, g = rest[keep], mark[keep] >> np.uint32(1)
        order = np.lexsort((rest, g))
        rest, g = rest[order], g[order]
        cut = _cut(g)
        bodies = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            mine = np.unique(rest[a:b])
            bodies.append(np.uint32(len(mine)).tobytes() + mine.tobytes() + mine[np.isin(mine, hot)].tobytes())
        return _table(np.full(len(bodies), key[0].as_py()), g[cut[:-1]].astype(np.int64), bodies)

    return sent.groupBy("bucket").applyInArrow(run, BLOB)


def _names(bodies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The short hashes in rows of anchors_repeated(): all, and the hot ones."""
    known, hot = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for bucket, body in zip(bodies.column("bucket").to_pylist(), bodies.column("body").to_pylist(), strict=True):
        values = np.frombuffer(body, np.uint32)
        whole = values[1:].astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket)
        known.append(whole[: values[0]])
        hot.append(whole[values[0] :])
    return np.unique(np.concatenate(known)), np.unique(np.concatenate(hot))


def _stretch_digests(s: Stretches, length: int) -> np.ndarray:
    return range_hash(running_hash(s.data), s.start, s.start + s.count + length - 1)


STRETCH = np.dtype([("hash", "<u8"), ("digest", "<u8"), ("id", "<i8"), ("count", "<u2")])


def stretches_sent(docs: DataFrame, repeated: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, g, body): the different stretches of each group around repeated anchors, with their smallest id; a row
    without stretches holds the hot anchors of the group."""

    def run(key, table, hashes):
        none = _table(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        if not table.num_rows or not hashes.num_rows:
            return none
        known, hot = _names(hashes, buckets)
        table = table.filter(table.column("id").is_valid()).combine_chunks()
        ids = table.column("id").to_numpy()
        heads, texts = [], []
        for at, data, offsets in pieces(table.column("text").chunk(0), length) if len(ids) else ():
            s = Stretches(data, offsets, length)
            short = s.short(buckets)
            place = np.minimum(np.searchsorted(known, short), len(known) - 1)
            held = np.flatnonzero(known[place] == short)
            if not len(held):
                continue
            s.keep(held)
            s.deal_strings(hot, buckets)
            held = s.hash
            head = np.empty(len(held), STRETCH)
            head["hash"], head["digest"], head["id"], head["count"] = s.hash, _stretch_digests(s, length), ids[s.row + at], s.count
            order = np.lexsort((head["id"], head["digest"]))
            order = order[np.concatenate([[True], head["digest"][order][1:] != head["digest"][order][:-1]])]
            heads.append(head[order])
            size = s.count[order] + length - 1
            index = np.repeat(s.start[order] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            texts.append(data[index])
        if not heads:
            return none
        head, text = np.concatenate(heads), np.concatenate(texts)
        size = head["count"].astype(np.int64) + length - 1
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        bucket = (head["hash"] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((head["id"], head["digest"], bucket))
        order = order[np.concatenate([[True], head["digest"][order][1:] != head["digest"][order][:-1]])]
        head, size, begin, bucket = head[order], size[order], begin[order], bucket[order]
        cut = _cut(bucket)
        bodies = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            n = size[a:b]
            index = np.repeat(begin[a:b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            bodies.append(np.uint32(b - a).tobytes() + head[a:b].tobytes() + text[index].tobytes())
        to = bucket[cut[:-1]]
        if len(hot):
            bodies.append(np.uint32(0).tobytes() + hot.tobytes())
            to = np.append(to, key[0].as_py() % buckets)
        return _table(to, np.full(len(bodies), key[0].as_py()), bodies)

    return docs.groupBy("g").cogroup(repeated.groupBy("g")).applyInArrow(run, BLOB)


def cover_ranks(text: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions, by their first `depth` bytes and within their stretches; 0 elsewhere
    and past the end. end: where the stretch of each position ends."""
    n = len(text)
    at = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
    first = first_bytes(text, end)[at]
    rank = np.zeros(n + V, np.int64)
    rank[at] = np.unique(first, return_inverse=True)[1] + 1
    width = V
    while width < depth:
        behind = at + width
        follow = np.where(behind < end[at], rank[np.minimum(behind, n)], 0)
        both = rank[at] * (n + 1) + follow
        rank[at] = np.unique(both, return_inverse=True)[1] + 1
        width *= 2
    return rank


def first_bytes(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first V bytes of each suffix as a number that sorts like them; what ends sooner sorts first."""
    padded = np.concatenate([text, np.zeros(V, np.uint8)])
    left = np.minimum(end - np.arange(len(text)), V).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for o in range(V):
        out = (out << np.uint64(8)) | np.where(o < left, padded[o : o + len(text)], 0).astype(np.uint64)
    return (out << np.uint64(3)) | left


def sorted_suffixes(text: np.ndarray, end: np.ndarray, at: np.ndarray, block: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes `at`, by block, then by their first `depth` bytes at least."""
    lead = first_bytes(text, end)[at]
    order = np.lexsort((lead, block))
    at, lead, block = at[order], lead[order], block[order]
    cut = _cut_pairs(block, lead)
    group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    tied = np.diff(cut)[group] > 1
    if not tied.any():
        return order
    rank = cover_ranks(text, end, depth)
    index = np.flatnonzero(tied)
    p, g = at[index], group[index]
    residue = p % V
    wide = np.int64(len(rank) + 1)
    before = np.zeros(len(p), np.int64)  # tied suffixes of the same group that sort sooner
    members = [np.flatnonzero(residue == r) for r in range(V)]
    for r in range(V):
        for s in range(V):
            if not len(members[r]) or not len(members[s]):
                continue
            d = SHIFT[r, s]
            of = lambda m: g[m] * wide + np.where(p[m] + d < end[p[m]], rank[np.minimum(p[m] + d, len(rank) - 1)], 0)  # noqa: E731, B023
            other = np.sort(of(members[s]))
            mine = of(members[r])
            before[members[r]] += np.searchsorted(other, mine) - np.searchsorted(other, g[members[r]] * wide)
    final = np.lexsort((residue, before, g))
    out = order.copy()
    out[index] = order[index[final]]
    return out


def _cut_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])), len(a)) if len(a) else np.zeros(1, np.int64)


RUN = np.dtype([("digest", "<u8"), ("first", "<u2"), ("count", "<u2"), ("id", "<i8")])


def suffixes_sorted(sent: DataFrame, length: int) -> DataFrame:
    """(bucket, g, body): for the stretches of each group, runs of their strings that a smaller id holds elsewhere.
    Rows of hot anchors go on to their group under the bucket -1."""

    def run(key, table):
        heads, texts, groups = [np.zeros(0, STRETCH)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        hot_groups, hot_bodies = [], []
        for g, body in zip(table.column("g").to_pylist(), table.column("body").to_pylist(), strict=True):
            n = int(np.frombuffer(body, np.uint32, 1)[0])
            if not n:
                hot_groups.append(g)
                hot_bodies.append(body[4:])
                continue
            heads.append(np.frombuffer(body, STRETCH, n, 4))
            texts.append(np.frombuffer(body, np.uint8, offset=4 + n * STRETCH.itemsize))
            groups.append(np.full(n, g))
        passed = _table(np.full(len(hot_groups), -1), np.array(hot_groups, np.int64), hot_bodies)
        if len(heads) == 1:
            return passed
        head, text, group = np.concatenate(heads), np.concatenate(texts), np.concatenate(groups)
        size = head["count"].astype(np.int64) + length - 1
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        # equal stretches are one class, with the smallest id
        order = np.lexsort((head["id"], head["digest"], head["hash"]))
        cut = _cut_pairs(head["hash"][order], head["digest"][order])
        one = order[cut[:-1]]
        of_class = np.empty(len(head), np.int64)
        of_class[order] = np.repeat(np.arange(len(one)), np.diff(cut))
        hashes, ids = head["hash"][one], head["id"][one].copy()
        hash_cut = _cut(hashes)
        several = np.repeat(np.diff(hash_cut) > 1, np.diff(hash_cut))
        counts = head["count"][one].astype(np.int64)
        base = np.concatenate([[0], np.cumsum(counts)])
        least = np.repeat(ids, counts)  # of each string of each class
        # whole anchor blocks, about SORTED_STRINGS strings at a time
        sorted_classes = np.flatnonzero(several)
        per_hash = np.add.reduceat(counts, hash_cut[:-1]) * (np.diff(hash_cut) > 1)
        step = np.repeat((np.cumsum(per_hash) - per_hash) // SORTED_STRINGS, np.diff(hash_cut))[sorted_classes]
        edges = _cut(step)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            picked = sorted_classes[a:b]
            n = size[one[picked]]
            start = np.concatenate([[0], np.cumsum(n)[:-1]])
            body = text[np.repeat(begin[one[picked]] - start, n) + np.arange(n.sum())]
            end = np.repeat(start + n, n)
            c = counts[picked]
            offset = np.arange(c.sum()) - np.repeat(np.concatenate([[0], np.cumsum(c)[:-1]]), c)
            at = np.repeat(start, c) + offset
            string = np.repeat(base[:-1][picked], c) + offset
            block = np.repeat(np.cumsum(np.concatenate([[0], hashes[picked][1:] != hashes[picked][:-1]])), c)
            ranked = sorted_suffixes(body, end, at, block, length)
            at, string, block = at[ranked], string[ranked], block[ranked]
            eight = words_at(np.concatenate([body, np.zeros(8, np.uint8)]))
            same = block[1:] == block[:-1]
            for o in [*range(0, length - 7, 8), length - 8]:
                same &= eight[at[1:] + o] == eight[at[:-1] + o]
            runs = np.append(np.flatnonzero(np.concatenate([[True], ~same])), len(at))
            smallest = np.minimum.reduceat(least[string], runs[:-1])
            least[string] = np.repeat(smallest, np.diff(runs))
        # runs of strings with one smallest id, for each class, then for each stretch with a larger one
        klass = np.repeat(np.arange(len(one)), counts)
        runs = _cut_pairs(klass, least)
        run_class, run_id, run_first, run_count = klass[runs[:-1]], least[runs[:-1]], runs[:-1] - base[klass[runs[:-1]]], np.diff(runs)
        low = np.searchsorted(run_class, of_class)
        many = np.searchsorted(run_class, of_class, side="right") - low
        stretch = np.repeat(np.arange(len(head)), many)
        pick = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        keep = run_id[pick] < head["id"][stretch]
        stretch, pick = stretch[keep], pick[keep]
        order = np.argsort(group[stretch], kind="stable")
        stretch, pick = stretch[order], pick[order]
        out = np.empty(len(pick), RUN)
        out["digest"], out["first"], out["count"], out["id"] = head["digest"][stretch], run_first[pick], run_count[pick], run_id[pick]
        cut = _cut(group[stretch])
        found = _table(np.full(len(cut) - 1, key[0].as_py()), group[stretch][cut[:-1]], [out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])
        return pa.concat_tables([found, passed])

    return sent.groupBy("bucket").applyInArrow(run, BLOB)


OUTPUT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("n_bytes", T.LongType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("kept", T.BinaryType()),
])


def cut_out(docs: DataFrame, held: DataFrame, buckets: int, length: int) -> DataFrame:
    """The output rows: what a smaller id of the same group holds, and what the buckets found."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(OUTPUT)

    def run(key, table, found):
        if not table.num_rows:
            return schema.empty_table()
        table = table.combine_chunks()
        named = np.asarray(table.column("id").is_valid())
        ids = np.asarray(table.column("id").fill_null(0))
        bodies = list(zip(found.column("bucket").to_pylist(), found.column("body").to_pylist(), strict=True))
        runs = np.concatenate([np.zeros(0, RUN), *[np.frombuffer(x, RUN) for bucket, x in bodies if bucket >= 0]])
        hot = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for bucket, x in bodies if bucket < 0]])
        runs = runs[np.argsort(runs["digest"], kind="stable")]
        parts = []
        for at, data, offsets in pieces(table.column("text").chunk(0), length):
            s = Stretches(data, offsets, length)
            s.deal_strings(hot, buckets)
            parts.append((at, data, offsets, s, _stretch_digests(s, length) if len(s.start) else np.zeros(0, np.uint64)))
        digest = np.concatenate([x[4] for x in parts])
        of = np.concatenate([ids[x[3].row + x[0]] for x in parts])
        usable = np.concatenate([named[x[3].row + x[0]] for x in parts])
        order = np.lexsort((np.where(usable, of, np.iinfo(np.int64).max), digest))
        cut = _cut(digest[order])
        smallest = np.empty(len(digest), np.int64)
        smallest[order] = np.repeat(np.where(usable, of, np.iinfo(np.int64).max)[order[cut[:-1]]], np.diff(cut))
        rows_bytes, rows_spans, rows_kept = [], [], []
        done = 0
        for at, data, offsets, s, d in parts:
            mine, least, ok = of[done : done + len(d)], smallest[done : done + len(d)], usable[done : done + len(d)]
            done += len(d)
            whole = np.flatnonzero(ok & (least < mine))
            low, high = np.searchsorted(runs["digest"], d), np.searchsorted(runs["digest"], d, side="right")
            many = np.where(ok, high - low, 0)
            stretch = np.repeat(np.arange(len(d)), many)
            pick = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(d) else np.zeros(0, np.int64)
            keep = runs["id"][pick] < mine[stretch]
            stretch, pick = stretch[keep], pick[keep]
            first = np.concatenate([s.start[whole], s.start[stretch] + runs["first"][pick]])
            last = np.concatenate([s.start[whole] + s.count[whole], s.start[stretch] + runs["first"][pick] + runs["count"][pick]]) + length - 1
            edge = np.bincount(first, minlength=len(data) + 1)[: len(data) + 1] - np.bincount(last, minlength=len(data) + 1)[: len(data) + 1]
            gone = np.cumsum(edge)[:-1] > 0
            for i in range(len(offsets) - 1):
                a, b = offsets[i], offsets[i + 1]
                out = gone[a:b]
                step = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
                rows_bytes.append(int(b - a))
                rows_spans.append([{"first": int(x), "last": int(y)} for x, y in zip(step[::2], step[1::2], strict=True)])
                rows_kept.append(data[a:b][~out].tobytes())
        return pa.table([table.column("id"), pa.array(rows_bytes, pa.int64()), pa.array(rows_spans, schema.field("removed").type), pa.array(rows_kept, pa.binary())], schema=schema)

    return docs.groupBy("g").cogroup(held.groupBy("g")).applyInArrow(run, OUTPUT)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(id_col, n_bytes, removed, kept) of each row of docs: the size of the UTF-8 text, the maximal runs of removed
    bytes (first, and last exclusive) and the bytes that stay, which may end inside a character.

    Null texts are empty. Rows with equal ids don't remove anything from each other; rows without an id neither
    remove nor lose bytes. Strings never cross texts. `length` is at least 24.
    """
    if length < K + 8:
        raise ValueError("length is at least 24")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, buckets = int(max(1, -(-size // GROUP_BYTES))), int(max(1, -(-size // BUCKET_BYTES)))
    # ids spread the rows; those without one go by their text
    rows = rows.withColumn("g", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(groups)))
    named = rows.where("id IS NOT NULL AND octet_length(text) >= " + str(length))
    repeated = anchors_repeated(anchors_sent(named, groups, buckets, length))
    # the same rows as below, so that both steps read one shuffle of the texts
    held = suffixes_sorted(stretches_sent(rows, repeated, buckets, length), length)
    return cut_out(rows, held, buckets, length).withColumnRenamed("id", id_col)
