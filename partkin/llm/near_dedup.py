"""Near-duplicate classes by DartMinHash signatures and banding.

A document is the weighted set of its five-word shingles, a shingle weighing as often as it occurs.
The weight axis of a shingle is cut into regions whose areas double; each region throws hashed darts
at growing ranks, denser with its area, and keeps those below the shingle's weight. Every dart falls
on one of the signature's coordinates, and a coordinate keeps its earliest dart. Since the darts of a
region don't depend on the document, two documents agree on a coordinate with the probability of
their weighted Jaccard similarity; and as ranks are thrown only up to a bound inverse to the
document's weight, a signature costs a constant and a few regions a shingle, whatever the weights.

Equal shingle sets are joined first. Bands of a signature are hashed to buckets. A bucket is compared
in blocks of bounded size, with a few leaders of the bucket in each block, so its work grows with its
members; the signatures of what is then left outside the bucket's largest class are compared with all
of the bucket, so that no pair of different classes stays unseen. Signatures only propose: a link is
taken if the weighted Jaccard similarity of the two texts' shingles, counted exactly, reaches the
border. Members are taken in an order that all buckets share, and a task sends on only links that
connect what was not connected, so links grow with texts. Classes are their connected components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import binary_rows, cut, folded, integer_id, mix64, partitions, steps, utf8, word_hashes

SHINGLE = 5
BANDS, ROWS = 42, 6
COORDINATES = BANDS * ROWS
SIMILAR = 0.8
#: Signatures of 252 coordinates estimate a similarity of 0.8 with a deviation of 0.025; pairs are
#: counted exactly from four deviations below.
MARGIN = 0.1
#: Members of a bucket that are compared with each other at a time.
BLOCK = 250
#: Shingles of such members, about: longer texts stand in smaller blocks.
BLOCK_UNITS = 1_000_000
#: Members of a bucket of several blocks, about, that stand in all of them.
LEADERS = 16
#: Rows of two or three numbers that are broadcast at most (large buckets, texts to fetch again); more are joined.
FEW = 50_000
#: Links, about, that a task joins to classes.
PART = 200_000

_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingles(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles of each text: hashes, rows in order, how often each occurs; and the total a row.

    Words are runs of letters and digits (all bytes beyond ASCII count), case folded. A text of fewer
    words than ``size`` is one shingle; a text without words has none.
    """
    n = len(at) - 1
    words, row, _ = word_hashes(data, at, folded(data))
    count = np.bincount(row, minlength=n)
    begin = np.cumsum(count) - count
    full = np.zeros(len(words), np.uint64)
    for k in range(min(size, len(words))):
        full[: len(words) - k] += words[k:] * _ODD[k % len(_ODD)] ** np.uint64(1 + k // len(_ODD))
    place = np.arange(len(words)) - begin[row]
    whole = place <= count[row] - size
    short = np.flatnonzero((count > 0) & (count < size))
    found, of = mix64(full[whole]), row[whole]
    if len(short):
        masked = np.where(np.isin(row, short), words * (np.uint64(2) * place.astype(np.uint64) + np.uint64(3)), np.uint64(0))
        total = np.concatenate([[np.uint64(0)], np.cumsum(masked, dtype=np.uint64)])
        extra = mix64(total[begin[short] + count[short]] - total[begin[short]])
        found, of = np.concatenate([found, extra]), np.concatenate([of, short])
    # sorted by row and hash, so that repeats stand together
    order = np.argsort((of.astype(np.uint64) << np.uint64(44)) | (found >> np.uint64(20)), kind="stable")
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    return found[first], of[first], np.diff(np.append(first, len(found))), np.bincount(of, minlength=n)


def regions(items: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, region's seed, its area, how much of it lies below the weight) for the regions that a weight reaches.

    The first region is [0, 1), the others [1, 2), [2, 4), [4, 8) and so on.
    """
    weight = np.asarray(weight, float)
    count = 1 + np.ceil(np.log2(np.maximum(weight, 1.0))).astype(np.int64)
    item = np.repeat(np.arange(len(items)), count)
    level = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    low = np.where(level > 0, np.exp2(level - 1.0), 0.0)
    area = np.where(level > 0, low, 1.0)
    seed = np.where(level > 0, mix64(items[item] + level.astype(np.uint64) * _ODD[1]), items[item])
    return item, seed, area, np.minimum(weight[item] - low, area)


def signatures(items: np.ndarray, row: np.ndarray, weight: np.ndarray, total: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """A row of ``k`` 32-bit values a text: of the earliest dart on each coordinate, 0 where none fell.

    A text throws about k (ln k + 3) darts; a coordinate stays without one in 5 of 100 texts.
    """
    n = len(total)
    best = np.full(n * k, ~np.uint64(0))
    limits = k * (np.log(k) + 3) / np.maximum(total, 1)
    which, seeds, areas, filled = regions(items, weight)
    rows, darts = row[which], limits[row[which]] * areas
    for low, high, at_once in ((0.0, 0.7, 1), (0.7, 12.0, 4), (12.0, np.inf, 64)):
        chosen = np.flatnonzero((darts > low) & (darts <= high))
        rank, thrown = np.zeros(len(chosen)), 0
        while len(chosen):
            turn = np.arange(thrown + 1, thrown + at_once + 1, dtype=np.uint64) * _ODD[0]
            dart = mix64(seeds[chosen][:, None] + turn[None, :])
            gaps = -np.log(((dart >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40)
            ranks = rank[:, None] + np.cumsum(gaps, axis=1) / areas[chosen][:, None]
            soon = ranks <= limits[rows[chosen]][:, None]
            hit = soon
            part = filled[chosen] < areas[chosen]
            if part.any():  # a dart's place on the weight axis
                height = (mix64(dart[part] ^ _ODD[4]) >> np.uint64(40)).astype(np.float64) * 2.0**-24 * areas[chosen][part][:, None]
                hit = soon.copy()
                hit[part] &= height < filled[chosen][part][:, None]
            dart_hit = dart[hit]
            spot = np.broadcast_to(rows[chosen][:, None], hit.shape)[hit] * k + ((dart_hit & np.uint64(0xFFFFFF)) * np.uint64(k) >> np.uint64(24)).astype(np.int64)
            packed = (ranks[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix64(dart_hit ^ _ODD[2]) >> np.uint64(32))
            np.minimum.at(best, spot, packed)
            open_ = soon[:, -1]
            chosen, rank, thrown = chosen[open_], ranks[open_, -1], thrown + at_once
    values = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    values[best == ~np.uint64(0)] = 0
    return values.reshape(n, k)


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    wide = values[:, : bands * rows].reshape(len(values), bands, rows).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[3], wide.shape[:2]).copy()
    for k in range(rows):
        total = mix64(total + (wide[:, :, k] + np.uint64(1)) * _ODD[k % len(_ODD)])
    return total.view(np.int64)


def _digest(items: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums a text that tell its weighted shingles."""
    ends = np.searchsorted(row, np.arange(n), "right")
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    digest = np.zeros((n, 2), np.uint64)
    for k in range(2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(items ^ _ODD[k]) * weight.astype(np.uint64), dtype=np.uint64)])
        digest[:, k] = total[ends] - total[begins]
    return digest


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for a, b in steps(at, 1 << 20):
            part, own = data[at[a] : at[b]], at[a : b + 1] - at[a]
            items, row, weight, total = shingles(part, own)
            values = signatures(items, row, weight, total)
            digest = _digest(items, row, weight, b - a)
            for k in np.flatnonzero(total == 0):  # without words only the very text is its like
                digest[k] = np.frombuffer(hashlib.blake2b(part[own[k] : own[k + 1]].tobytes(), digest_size=16).digest(), np.uint64)
            ends = np.concatenate([[0], np.cumsum(np.where(total > 0, BANDS, 0))]).astype(np.int32)
            keys = pa.ListArray.from_arrays(ends, pa.array(band_keys(values)[total > 0].ravel()))
            named = [batch.column(c).slice(a, b - a) for c in ("doc_id", "content", "row")]
            yield pa.RecordBatch.from_arrays(
                [*named, pa.array(total), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), binary_rows(values.astype(np.uint8)), keys],
                ["doc_id", "content", "row", "weight", "d1", "d2", "signature", "bands"],
            )


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarities of byte signatures, less what bytes agree by chance."""
    return ((one == many).mean(-1) - 1 / 256) / (1 - 1 / 256)


Weighted = tuple[np.ndarray, np.ndarray]  # sorted shingles and how often each occurs


def jaccard(one: Weighted, many: list[Weighted]) -> np.ndarray:
    """The weighted Jaccard similarity of a text's shingles and those of others, none empty."""
    size = np.array([len(u) for u, _ in many])
    total, mine = np.array([w.sum() for _, w in many]), one[1].sum()
    out, lo, ends = np.zeros(len(many)), 0, np.cumsum(size)
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + BLOCK_UNITS, "right")))
        body, times = (np.concatenate([m[k] for m in many[lo:hi]]) for k in (0, 1))
        spot = np.minimum(np.searchsorted(one[0], body), len(one[0]) - 1)
        least = np.where(one[0][spot] == body, np.minimum(one[1][spot], times), 0)
        both = np.add.reduceat(least, ends[lo:hi] - size[lo:hi] - (ends[lo] - size[lo]))
        out[lo:hi] = both / (mine + total[lo:hi] - both)
        lo = hi
    return out


def _links_of(ids: np.ndarray, label: np.ndarray, marks: np.ndarray, units: list[Weighted], similar: float, margin: float) -> list[tuple[int, int]]:
    """Links that connect what is alike among members of different labels; labels are joined on the way."""
    label, out = label.copy(), []
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        j = j[label[j] != label[i]]
        j = j[estimates(marks[i], marks[j]) >= similar - margin] if len(j) else j
        j = j[jaccard(units[i], [units[k] for k in j]) >= similar] if len(j) else j
        if len(j):
            new, first = np.unique(label[j], return_index=True)
            out += [(int(ids[i]), int(ids[j[f]])) for f in first]
            label[np.isin(label, new)] = label[i]
    return out


def _units(table: pa.Table) -> tuple[pa.Table, list[Weighted]]:
    """Members whose text is the one that was sketched, once each, and their sorted shingles."""
    data, at = utf8(table.column("text"))
    digests, out = [np.zeros((0, 2), np.int64)], []
    for a, b in steps(at, 1 << 20):
        items, row, weight, _ = shingles(data[at[a] : at[b]], at[a : b + 1] - at[a])
        digests.append(_digest(items, row, weight, b - a).view(np.int64))
        order = np.lexsort((items, row))
        cuts = np.searchsorted(row, np.arange(1, b - a))
        out += list(zip(np.split(items[order], cuts), np.split(weight[order], cuts), strict=True))
    digest = np.concatenate(digests)
    own = (digest == np.stack([table.column(c).to_numpy() for c in ("d1", "d2")], 1)).all(1)
    # rows that repeat a doc_id and text stand together
    place = np.flatnonzero(own)
    same = np.ones(max(0, len(place) - 1), bool)
    for c in ("key", "block", "rep"):
        v = table.column(c).to_numpy()[place]
        same &= v[1:] == v[:-1]
    place = place[np.concatenate([[True], ~same])] if len(place) else place
    return table.take(pa.array(place)), [out[k] for k in place]


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the rows of one bucket and block."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in ("key", "block"):
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, table.num_rows))


def _marks(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _whole(found: Callable[[pa.Table], pa.RecordBatch]) -> object:
    """``found`` of rows sorted by group; all of a group is needed at once, and its rows may be spread over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in ("key", "block"))
            same = np.ones(batch.num_rows, bool)
            for c, v in zip(("key", "block"), last, strict=True):
                same &= batch.column(c).to_numpy() == v
            cut_at = int(np.argmax(same))
            if cut_at:
                held.append(batch.slice(0, cut_at))
                yield found(pa.Table.from_batches(held))
                held = []
            elif held and tuple(held[-1].column(c)[0].as_py() for c in ("key", "block")) != last:
                yield found(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _compare(similar: float, margin: float) -> Callable[[pa.Table], pa.RecordBatch]:
    def links(table: pa.Table) -> pa.RecordBatch:
        table, units = _units(table)
        if not len(units):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        ids, label, marks = table.column("rep").to_numpy(), table.column("label").to_numpy(), _marks(table)
        starts, sizes = _groups(table)
        pair = starts[sizes == 2]
        fine = pair[(label[pair] != label[pair + 1]) & (estimates(marks[pair], marks[pair + 1]) >= similar - margin)] if len(pair) else pair
        fine = fine[[bool(jaccard(units[k], [units[k + 1]])[0] >= similar) for k in fine]] if len(fine) else fine
        out = [(int(x), int(y)) for x, y in zip(ids[fine], ids[fine + 1], strict=True)]
        for s, m in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            out += _links_of(ids[s : s + m], label[s : s + m], marks[s : s + m], units[s : s + m], similar, margin)
        x = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(x.min(1)), pa.array(x.max(1))], ["a", "b"])

    return links


def _propose(border: float) -> Callable[[pa.Table], pa.RecordBatch]:
    """The rows whose signature is alike that of a row of another label, where one of both asks."""

    def rows(table: pa.Table) -> pa.RecordBatch:
        label, asks, marks = table.column("label").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False), _marks(table)
        like = np.zeros(table.num_rows, bool)
        for s, m in zip(*_groups(table), strict=True):
            for i in s + np.flatnonzero(asks[s : s + m]):
                j = s + np.flatnonzero(label[s : s + m] != label[i])
                j = j[estimates(marks[i], marks[j]) >= border] if len(j) else j
                like[j] = True
                like[i] |= len(j) > 0
        return table.filter(pa.array(like)).select(["key", "block", "rep", "label"]).combine_chunks().to_batches(max_chunksize=None)[0] if like.any() else _NO_ROWS

    return rows


_NO_ROWS = pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["key", "block", "rep", "label"])


def connected(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, class_id): the least id of each connected component of links (a, b), for ids that have one.

    Each round takes the least label among the neighbours and then the label's own label, so a path
    of n links needs about log n rounds. All of it is joins and aggregates; nothing is collected.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct())
    parts = 1 + edges.count() // PART  # a file for each task: few edges make few
    edges = edges.coalesce(parts)
    labels = cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).coalesce(parts))
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        lower = labels.join(near, "u").select("u", F.least("l", "m").alias("n"), "l")
        jump = labels.select(F.col("u").alias("n"), F.col("l").alias("far"))
        new = cut(lower.join(jump, "n", "left").select("u", F.least("n", F.coalesce("far", "n")).alias("l"), (F.least("n", F.coalesce("far", "n")) != F.col("l")).alias("moved")).coalesce(parts))
        labels = new.select("u", "l")
        if new.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select(F.col("u").alias("id"), F.col("l").alias("class_id"))


def _blocks(buckets: DataFrame) -> DataFrame:
    """(key, n, blocks) of the buckets to compare; of buckets with the same members one."""
    seen = buckets.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("units"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "rep")).alias("y")
    )
    chosen = seen.where("n > 1").groupBy("n", "units", "x", "y").agg(F.min("key").alias("key"))
    blocks = F.when(F.col("n") <= LEADERS, F.lit(1)).otherwise(F.least("n", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("units") / BLOCK_UNITS))))
    return chosen.select("key", "n", blocks.cast("int").alias("blocks"))


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` with the hint to broadcast them, if a count says that they are few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def near_classes(reps: DataFrame, docs: DataFrame, similar: float = SIMILAR, margin: float = MARGIN) -> DataFrame:
    """(id, class_id) of the shingle sets that are alike another one.

    Members of a bucket bring their texts, to be counted; texts that share no bucket stay where they are.
    """
    turn, n_parts = F.xxhash64(F.lit(3), "rep"), partitions(reps)

    def met(rows: DataFrame) -> DataFrame:
        """Dealt by group, and in the turn that texts have in all buckets."""
        return rows.repartition(n_parts, "key", "block").sortWithinPartitions("key", "block", "turn", "rep").drop("turn")

    def links(rows: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame:
        """From rows (key, block, rep, label); a text is fetched once, then dealt to its places."""
        rows = rows.groupBy("rep").agg(F.first("label").alias("label"), F.collect_list(F.struct("key", "block")).alias("places"))
        rows = rows.join(known.select("rep", "doc_id", "content", "d1", "d2", "signature"), "rep").withColumn("turn", turn)
        rows = rows.join(texts.select("doc_id", "content", "text"), ["doc_id", "content"]).drop("doc_id", "content")
        rows = rows.select("*", F.inline("places")).drop("places")
        return cut(met(rows).mapInArrow(_whole(_compare(similar, margin)), "a long, b long").distinct())

    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    buckets = reps.select("rep", "weight", F.explode("bands").alias("key"))
    chosen = cut(_blocks(buckets))
    leads = (F.col("blocks") > 1) & (F.shiftrightunsigned(turn, 1) / float(1 << 63) < LEADERS / F.col("n"))
    block = F.explode(F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block")
    large, members = chosen.where("blocks > 1"), buckets.select("rep", "key")
    n_large = large.count()
    if n_large <= FEW:  # members of large buckets are dealt by block where they lie, not by bucket first
        large = F.broadcast(large)
        small = members.join(large.select("key"), "key", "left_anti").join(_few(chosen.where("blocks = 1")), "key")
        members = small.unionByName(members.join(large, "key"))
    else:
        members = members.join(chosen, "key")
    classes = connected(links(members.select("key", "rep", block, F.col("rep").alias("label")), reps, docs))
    if not n_large:
        return classes
    inside = buckets.select("rep", "key").join(large, "key").join(classes.select(F.col("id").alias("rep"), "class_id"), "rep", "left")
    inside = cut(inside.select("key", "rep", "n", "blocks", F.coalesce("class_id", "rep").alias("label")))
    sizes = inside.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    most = sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("most"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    most = most.select("key", F.col("most.label").alias("most"), F.col("most.size").alias("size"))
    inside = cut(inside.join(F.broadcast(most) if n_large <= FEW else most, "key"))  # at most a row for each large bucket
    # every block of members meets every block of those that are outside the largest class
    inside = inside.withColumn("rounds", F.ceil((F.col("n") - F.col("size")) / BLOCK).cast("int")).withColumn("asks", F.col("label") != F.col("most"))
    asked = F.transform(F.sequence(F.lit(0), F.col("rounds") - 1), lambda q: own * F.col("rounds") + q)
    mine = F.pmod(F.xxhash64(F.lit(4), "rep"), F.col("rounds")).cast("int")
    asking = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda p: p * F.col("rounds") + mine)
    rows = inside.groupBy("rep").agg(F.first("label").alias("label"), F.collect_list(F.struct("key", "blocks", "rounds", "asks")).alias("places"))
    known = reps.join(_few(inside.select("rep").distinct()), "rep", "left_semi")
    rows = rows.join(known.select("rep", "signature"), "rep").withColumn("turn", turn).select("rep", "label", "signature", "turn", F.inline("places"))
    spots = F.transform(asked, lambda b: F.struct(b.cast("int").alias("block"), F.lit(False).alias("asks")))
    both = F.concat(spots, F.transform(asking, lambda b: F.struct(b.cast("int").alias("block"), F.lit(True).alias("asks"))))
    rows = met(rows.select("key", "rep", "label", "signature", "turn", F.inline(F.when(F.col("asks"), both).otherwise(spots))))
    alike = cut(rows.mapInArrow(_whole(_propose(similar - margin)), "key long, block int, rep long, label long"))
    known = reps.join(_few(alike.select("rep").distinct()), "rep", "left_semi")
    texts = docs.join(_few(known.select("doc_id", "content")), ["doc_id", "content"], "left_semi")
    more = links(alike, known, texts)
    # the new links connect classes, or texts that had none
    of = classes.select(F.col("id").alias("rep"), "class_id")
    ends = more.join(of.toDF("a", "p"), "a", "left").join(of.toDF("b", "q"), "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b"))
    joined = connected(ends).toDF("class_id", "whole")
    alone = joined.join(of, "class_id", "left_anti").select(F.col("class_id").alias("id"), "class_id")
    return classes.unionByName(alone).join(joined, "class_id", "left").select("id", F.coalesce("whole", "class_id").alias("class_id"))


def judged(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, content, class_id, class_size, kept) of each row with an id; ``content`` is a hash of its text."""
    docs = docs.select(integer_id(docs), F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull()).withColumn("content", F.xxhash64("text"))
    schema = "doc_id long, content long, row long, weight long, d1 long, d2 long, signature binary, bands array<long>"
    sketch = cut(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_sketch, schema))
    equal = ["d1", "d2", "weight"]
    reps = sketch.groupBy(*equal).agg(
        F.min(F.struct("doc_id", "content", "row")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"), F.first("bands").alias("bands")
    )
    reps = cut(reps.select(*equal, F.col("first.row").alias("rep"), "first.doc_id", "first.content", "first", "copies", "signature", "bands"))
    classes = near_classes(reps, docs, similar).toDF("rep", "class")
    found = cut(reps.select(*equal, "rep", "first", "copies").join(classes, "rep", "left").drop("rep"))
    grouped = found.where(F.col("class").isNotNull())
    sizes = cut(grouped.groupBy("class").agg(F.sum("copies").alias("class_size"), F.min("first").alias("least"), F.count(F.lit(1)).alias("texts")))
    large = _few(sizes.where(F.col("texts") > BLOCK))  # these classes' texts learn of them where they lie
    small = grouped.join(large.select("class"), "class", "left_anti").join(sizes.where(F.col("texts") <= BLOCK), "class")
    columns = [*equal, "class_size", "least"]
    alone = found.where(F.col("class").isNull()).select(*equal, F.col("copies").alias("class_size"), F.col("first").alias("least"))
    found = alone.unionByName(small.select(*columns)).unionByName(grouped.join(large, "class").select(*columns))
    return sketch.select("doc_id", "content", "row", *equal).join(found, equal).select(
        "doc_id", "content", F.col("least.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("least.row")).alias("kept")
    )


def near_dedup(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    A class is a connected component of documents whose shingles are alike, by a weighted Jaccard
    similarity of ``similar`` or more, counted for all that their signatures propose; its id is its
    least doc_id, and one row with that id is kept. Documents with equal shingles are always in one
    class. Texts without words (null counts as empty) are alike only if equal. Ids are integers; of
    rows that repeat an id and are alike one stays; a row with a null id has a null class and stays.
    """
    out = judged(docs, similar).drop("content")
    nameless = docs.where(F.col("doc_id").isNull()).select(integer_id(docs), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)


def without_near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class, all columns as they are; rows without an id stay."""
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    told = cut(judged(docs, similar).groupBy("doc_id", "content").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept")))
    name, own = "__id", "__content"
    gone = told.where(~F.col("kept")).select(F.col("doc_id").alias(name), F.col("content").alias(own))
    left = docs.withColumn(own, content).join(gone.withColumnRenamed(own, "__gone"), (F.col("doc_id") == F.col(name)) & (F.col(own) == F.col("__gone")), "left_anti")
    twice = told.where(F.col("kept") & (F.col("rows") > 1)).select(F.col("doc_id").alias(name), F.col("content").alias("__gone"))
    if twice.isEmpty():
        return left.select(*docs.columns)
    # rows that are equal in id and text: one of them, by the order of all their columns
    marked = left.join(twice, (F.col("doc_id") == F.col(name)) & (F.col(own) == F.col("__gone")), "left")
    once = marked.where(F.col(name).isNull()).select(*docs.columns)
    again = marked.where(F.col(name).isNotNull()).groupBy("doc_id", own).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return once.unionByName(again)
