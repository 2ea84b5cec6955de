"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits (or several words of them) summarise a text's shingle
hashes. The probe word's bits are grouped into partitions of correlated bits;
thresholds t_i with sum(t_i) = distance - partitions + 1 are allotted to the
partitions by dynamic programming over estimated candidate counts, -1 leaving a
partition out. Any two words within the distance differ in at most t_i bits of
some partition i, so both carry an equal signature of that partition:

  t=0  the partition's value
  t=1  the value with one bit masked, for each bit
  t=2  the value with at most one bit flipped: two such balls meet
  t=3  one bit masked and at most one other flipped
  t=4  at most two bits flipped

Rows with an equal signature are verified in full. Equal fingerprints are one
class, found by grouping, so copies never meet in pairs. From each bucket only
as many links come as its connected parts need. A signature with more classes
than BUCKET is dealt out as pairs of blocks, each block pair its own bucket, so
nothing is dropped and no task holds more than two blocks.

Defined results: null text is empty; texts without words have fingerprint zero
and are linked like any other; a null identifier counts after all others, and
its component has the smallest identifier of the others or null if none;
repeated rows come out as often as they came in; an empty table gives an empty
table; other columns are ignored. Identifiers lie below 2**62.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shardloom.llm.bloom import bloom_filter, may_hold
from shardloom.llm.common import arrow_map, cut, in_steps, raw
from shardloom.llm.components import components
from shardloom.llm.grams import mixed

#: Classes of one signature that a task compares; beyond it blocks of this size are compared in pairs.
BUCKET = 1 << 14
#: Bins in which signatures are counted before any is dealt out.
BINS = 1 << 16
#: Relative costs of making, moving and sorting a signature row and of comparing a pair.
ROW_COST, PAIR_COST = 1.0, 0.003
STAND_IN = 1 << 62


def document_bits(text: bytes, shingle: int, words: int = 1) -> list[int]:
    """The fingerprint words of a text: bit set if set in over half the shingle hashes."""
    tokens = text.lower().split()
    if not tokens:
        return [0] * words
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        grams = [joined]
    else:
        at = [0, *accumulate(len(x) + 1 for x in tokens)]
        grams = [joined[a : b - 1] for a, b in zip(at, at[shingle:], strict=False)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(x, 42) for x in grams], dtype="<u8")
    out = []
    for k in range(words):
        own = h if not k else mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        counts = np.zeros(64, np.int64)
        rows = own.view(np.uint8).reshape(-1, 8)
        for i in range(0, len(rows), 255):
            counts += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        out.append(int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little"))
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, words: int = 1) -> DataFrame:
    """doc_id and words w0, w1, ... (signed longs) of every row."""
    names = [f"w{k}" for k in range(words)]

    def over(batch):
        bits = np.array([document_bits(x, shingle, words) for x in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(words))], names=["doc_id", *names])

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("body"))
    return arrow_map(slim, over, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def bit_counts(classes: DataFrame) -> np.ndarray:
    """64 x 64 counts of classes with both bits of w0 set, over all classes."""

    def over(batches):
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            w = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(w.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(total.ravel())], names=["cell", "n"])

    rows = classes.select("w0").mapInArrow(over, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(4096, np.int64)
    for cell, n in rows:
        counts[cell] = n
    return counts.reshape(64, 64)


def grouped_bits(both: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """The 64 bits in groups of nearly equal size, correlated bits together."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    close = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(close, 0)
    left, groups = set(range(64)), []
    for i in range(parts):
        size = (64 - sum(map(len, groups)) + parts - i - 1) // (parts - i)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (close[b, rest].sum(), -b))]
        while len(group) < size:
            rest = sorted(left - set(group))
            group.append(max(rest, key=lambda b: (close[b, group].sum(), -b)))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def signature_rows(width: int, t: int) -> int:
    return [0, 1, width, width + 1, width * width, 1 + width + width * (width - 1) // 2][t + 1]


def allotted(both: np.ndarray, total: int, distance: int, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use, of the cheapest partitioning.

    Candidates of a partition at threshold t are estimated from all classes: the
    number of pairs times the chance that at most t of its bits differ, each bit
    differing as often as its own count says.
    """
    p = np.diag(both) / max(total, 1)
    differs = 2 * p * (1 - p)
    best = (float("inf"), [])
    for parts in range(1, most_parts + 1):
        groups = grouped_bits(both, total, parts)
        cost = []
        for g in groups:
            chance = np.zeros(6)
            chance[0] = 1
            for b in g:
                chance[1:] = chance[1:] * (1 - differs[b]) + chance[:-1] * differs[b]
                chance[0] *= 1 - differs[b]
            below = np.cumsum(chance)
            cost.append({t: signature_rows(len(g), t) * total * ROW_COST + (below[t] * total * total / 2 * PAIR_COST if t >= 0 else 0) for t in range(-1, 5)})
        table = {0: (0.0, [])}
        for c in cost:
            step: dict[int, tuple] = {}
            for have, (spent, path) in table.items():
                for t, extra in c.items():
                    if (have + t) not in step or spent + extra < step[have + t][0]:
                        step[have + t] = (spent + extra, [*path, t])
            table = step
        need = distance - parts + 1
        if need in table and table[need][0] < best[0]:
            best = (table[need][0], [(g, t) for g, t in zip(groups, table[need][1], strict=True) if t >= 0])
    if not best[1]:
        raise ValueError(f"no thresholds up to 4 in {most_parts} partitions cover a distance of {distance}")
    return best[1]


def signatures(w: np.ndarray, plan: list[tuple[list[int], int]]) -> np.ndarray:
    """Signature keys of the probe words: one row a word."""
    columns = []
    for part, (bits, t) in enumerate(plan):
        one = [np.uint64(1 << b) for b in bits]
        value = w & np.uint64(sum(1 << b for b in bits))

        def key(x, tag, part=part):
            return mixed(x ^ mixed(np.uint64((part + 1) * 1_000_003 + tag).reshape(1)))

        if t in (0, 2, 4):
            columns.append(key(value, 0))
        if t in (2, 4):
            columns += [key(value ^ x, 0) for x in one]
        if t == 4:
            columns += [key(value ^ x ^ y, 0) for i, x in enumerate(one) for y in one[:i]]
        if t in (1, 3):
            columns += [key(value & ~x, 1 + i) for i, x in enumerate(one)]
        if t == 3:
            columns += [key((value ^ y) & ~x, 1 + i) for i, x in enumerate(one) for y in one if x != y]
    return np.stack(columns, axis=1)


def _forest(left: np.ndarray, right: np.ndarray, parent: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that join two parts not joined before, in the order given; parent holds what earlier calls joined."""
    parent = {} if parent is None else parent
    kept = []
    for k, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        while (up := parent.get(y, y)) != y:
            parent[y] = y = parent.get(up, up)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(k)
    return left[kept], right[kept]


def bucket_links(node: np.ndarray, w: np.ndarray, distance: int, further: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep a bucket's connected parts together; w: one row of words for each node.

    All pairs are compared a block of rows at a time. If they link densely, each
    node that is reached compares only with those not reached yet.
    """
    n = len(node)

    def near(rows, cols):
        apart = np.bitwise_count(w[rows, 0][:, None] ^ w[cols, 0][None, :])
        hit = apart <= distance
        if further is not None and hit.any():
            i, j = np.nonzero(hit)
            rest = np.bitwise_count(w[rows[i], 1:] ^ w[cols[j], 1:]).sum(axis=1, dtype=np.int64)
            hit[i, j] = rest <= further
        return hit

    every = np.arange(n)
    left, right, found = [], [], 0
    for a in range(0, n, 256):
        rows = every[a : a + 256]
        cols = every[a:]
        hit = near(rows, cols)
        i, j = np.nonzero(hit)
        upper = j > i
        left.append(rows[i[upper]])
        right.append(cols[j[upper]])
        found += int(upper.sum())
        if found > 4 * n + 64:
            break
    else:
        left, right = _forest(np.concatenate(left), np.concatenate(right))
        return node[left], node[right]
    left, right, rest = [], [], every
    while len(rest) > 1:
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            hit = near(np.array([x]), rest)[0]
            new = rest[hit]
            rest = rest[~hit]
            left.append(np.full(len(new), x))
            right.append(new)
            reached += new.tolist()
    return node[np.concatenate(left).astype(int)], node[np.concatenate(right).astype(int)]


def met_blocks(member, blocks):
    """Numbers of the pairs of blocks in which a member of a group of `blocks` blocks stands: any two members share one."""
    mine = F.pmod(F.xxhash64(member), blocks).cast("int")
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.least(x, mine) * F.lit(1 << 20) + F.greatest(x, mine))


def links(classes: DataFrame, words: int, distance: int, further: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between classes (node, w0, ...) that hold their components together; verified, some repeated."""
    total = classes.count()
    plan = allotted(bit_counts(classes), total, distance)
    names = [f"w{k}" for k in range(words)]
    per = sum(signature_rows(len(bits), t) for bits, t in plan)
    step = max(1, 1_000_000 // per)

    def probe(batch):
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            w0 = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys = signatures(w0, plan).view(np.int64)
            again = pa.array(np.repeat(np.arange(len(w0)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(c.take(again) for c in part.columns)], names=["key", "node", *names])

    def binned(batches):
        bins = np.zeros(BINS, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                w0 = batch.column(0).slice(i, step).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                bins += np.bincount((signatures(w0, plan) >> np.uint64(48)).ravel().astype(np.int64), minlength=BINS)
        used = np.nonzero(bins)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bins[used])], names=["bin", "n"])

    columns = ["node", *names]
    rows = arrow_map(classes.select(*columns), probe, "key long, node long, " + ", ".join(f"{x} long" for x in names), 10_000)
    full = classes.select("w0").mapInArrow(binned, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).filter(F.col("n") > bucket).select("bin")
    full = [r[0] for r in full.collect()]  # at most BINS numbers
    if full:
        bin_of = F.shiftrightunsigned("key", 48)
        inside = bin_of.isin(full) if len(full) < 1000 else F.lit(True)
        large = cut(rows.filter(inside).groupBy("key").count().filter(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("blocks")))
        if large.isEmpty():
            full = []
    if full:
        meets = met_blocks("node", F.col("blocks"))
        rows = rows.join(large, "key", "left").withColumn("block", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(meets))).drop("blocks")
    else:
        rows = rows.withColumn("block", F.lit(0))
    dealt = rows.select("key", "block", *columns).repartition("key", "block").sortWithinPartitions("key", "block")

    def compare(batches):
        held = None
        for batch in batches:
            table = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3 + words)], axis=1)
            held = table if held is None else np.concatenate([held, table])
            change = np.nonzero((held[1:, :2] != held[:-1, :2]).any(axis=1))[0] + 1
            if len(change):
                yield from found(held[: change[-1]], change[:-1])
                held = held[change[-1] :]
        if held is not None:
            change = np.nonzero((held[1:, :2] != held[:-1, :2]).any(axis=1))[0] + 1
            yield from found(held, change)

    def found(part, change):
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.concatenate([starts, [len(part)]]))
        node, w = part[:, 2], np.ascontiguousarray(part[:, 3:]).view(np.uint64)
        two = starts[sizes == 2]
        ok = np.bitwise_count(w[two, 0] ^ w[two + 1, 0]) <= distance
        if further is not None:
            ok &= np.bitwise_count(w[two, 1:] ^ w[two + 1, 1:]).sum(axis=1, dtype=np.int64) <= further
        left, right = [node[two[ok]]], [node[two[ok] + 1]]
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = bucket_links(node[a : a + n], w[a : a + n], distance, further)
            left.append(x)
            right.append(y)
        left, right = np.concatenate(left), np.concatenate(right)
        if len(left):
            pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 4, extra_words: int = 0, further: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest identifier reachable) of every row.

    Two documents link if their first words differ in at most distance bits and,
    where extra_words are asked for, those in at most further bits.
    """
    words = 1 + extra_words
    names = [f"w{k}" for k in range(words)]
    docs = cut(fingerprints(df, id_col, text_col, shingle, words))
    stand_in = F.xxhash64(*names).bitwiseAND(STAND_IN - 1).bitwiseOR(STAND_IN)
    classes = cut(docs.groupBy(*names).agg(F.min("doc_id").alias("least")).select(*names, F.coalesce("least", stand_in).alias("node")))
    parts = components(links(classes, words, distance, further, bucket))
    label = F.coalesce("component", "node")
    labels = classes.join(parts, "node", "left").select(*names, F.when(label < STAND_IN, label).alias("component_id"))
    return docs.join(labels, names).select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity of shingle sets: SimHash finds most links, prefixes find the rest, sets verify.

#: Bits in which the two fingerprint words of coarsely linked sets may differ; near copies do in fewer, prefixes find all other pairs.
DISTANCE, FURTHER = 6, 10
#: Classes of a coarse group that stand in one block, and shingles that they hold, about; larger groups are verified as pairs of blocks.
SETS, SET_SHINGLES = 1 << 9, 1 << 22
#: Prefixes that hold a shingle from which on it comes after rarer ones, and such shingles that are told apart at most (16 MB).
HEAVY, MOST_HEAVY = 4, 1 << 20
#: Classes whose links a task remembers; beyond it it begins anew and may give a link again.
REMEMBERED = 1 << 20
#: Words of parity bits by which candidates of prefixes are sifted; a power of two.
PARITY = 4


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        grams = {joined}
    else:
        at = [0, *accumulate(len(x) + 1 for x in tokens)]
        grams = {joined[a : b - 1] for a, b in zip(at, at[shingle:], strict=False)}
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, 42) for x in grams], dtype="<u8"))


def set_words(hashes: np.ndarray) -> list[int]:
    """Two fingerprint words of a set of shingle hashes."""
    out = []
    for k in (1, 2):
        own = mixed(hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        counts = np.zeros(64, np.int64)
        rows = own.astype("<u8").view(np.uint8).reshape(-1, 8)
        for i in range(0, len(rows), 255):
            counts += np.add.reduce(np.unpackbits(rows[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        out.append(int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little"))
    return out


def set_digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingle hashes, as two signed numbers: sets are the same if these are."""
    whole = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (whole & (2**64 - 1)) - (1 << 63), (whole >> 64) - (1 << 63)


class Nodes:
    """Numbers of sets: the first half of the digest, but another number for sets that share it with a set of another second half."""

    def __init__(self, renamed: dict[tuple[int, int], int]):
        self.renamed = renamed

    def of(self, hashes: np.ndarray) -> int:
        node, twin = set_digest(hashes)
        return self.renamed.get((node, twin), node) if self.renamed else node


def told_apart(marks: DataFrame) -> tuple[DataFrame, Nodes]:
    """marks (node, twin, others) with a number of its own for each digest, and the numbers; half digests of 64 bits clash so seldom that the list of clashes is short."""
    clash = cut(marks.groupBy("node").agg(F.min("twin").alias("least"), F.max("twin").alias("most")).filter("least != most").select("node"))
    if clash.isEmpty():
        return marks.drop("twin"), Nodes({})
    number = F.xxhash64("node", "twin")
    both = marks.join(F.broadcast(clash), "node", "left_semi").select("node", "twin", number.alias("number")).distinct().collect()
    hit = F.col("node").isin([r["node"] for r in clash.collect()])
    return marks.withColumn("node", F.when(hit, number).otherwise(F.col("node"))).drop("twin"), Nodes({(r["node"], r["twin"]): r["number"] for r in both})


def similar_links(node: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between sets with a Jaccard similarity of least or more that keep connected parts together.

    Each set that is reached compares with those not reached yet, all at once by
    counting marked hashes; two empty sets are alike.
    """
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets) if sizes.sum() else np.zeros(0, np.uint64), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    marked = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    waiting = np.ones(len(sets), bool)
    live_ids, live_owner, live = ids, owner, len(sets)
    out = []
    for seed in range(len(sets)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        reached = [seed]
        while reached and waiting.any():
            x = reached.pop()
            own = ids[begin[x] : begin[x + 1]]
            marked[own] = True
            both = np.bincount(live_owner[marked[live_ids]], minlength=len(sets))
            marked[own] = False
            near = waiting & (both >= least * (sizes + sizes[x] - both) - 1e-9)
            new = np.nonzero(near)[0]
            waiting[new] = False
            out += [(int(node[x]), int(node[y])) for y in new]
            reached += new.tolist()
            if (left := int(waiting.sum())) < live / 2:
                keep = waiting[live_owner]
                live_ids, live_owner, live = live_ids[keep], live_owner[keep], left
    return out


def prefix(hashes: np.ndarray, least: float, heavy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first hashes of a set in a fixed order, as many as it takes that any set of similarity least or more shares one of its own.

    The order is by weight, 0 for all hashes that are not in heavy (sorted),
    then by hash. Any order that is the same for all sets is right; this one
    leaves common shingles out of nearly all prefixes.
    """
    n = len(hashes)
    if len(heavy) and n:
        at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
        hashes = hashes[np.argsort(np.where(heavy[at] == hashes, weight[at], 0), kind="stable")]
    return hashes[: n - int(np.ceil(least * n - 1e-9)) + 1]


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY words of bits, each the parity of the number of a set's hashes that fall on it.

    Words of two sets differ in at most as many bits as the sets in elements.
    """
    odd = np.bincount((mixed(hashes.astype("<u8")) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def run_pairs(rows: np.ndarray, least: float):
    """Pairs (node, node, sum of their sizes) of rows (key, size, node, group, place, parity words) with one key that can have the similarity and are not of one group.

    rows are sorted by key and size; place is the key's in the set's order, so
    at most the smaller number before it and after it is in both sets.
    """
    bits = np.ascontiguousarray(rows[:, 5:]).view(np.uint64)
    last = np.flatnonzero(np.append(rows[1:, 0] != rows[:-1, 0], True))
    end = np.repeat(last, np.diff(np.concatenate([[-1], last])))
    i, lag = np.arange(len(rows)), 1
    while len(i):
        i = i[i + lag <= end[i]]
        i = i[rows[i, 1] >= least * rows[i + lag, 1] - 1e-9]
        a, b = rows[i], rows[i + lag]
        most = np.minimum(a[:, 4], b[:, 4]) + np.minimum(a[:, 1] - a[:, 4], b[:, 1] - b[:, 4])
        ok = (a[:, 3] != b[:, 3]) & (most >= least * (a[:, 1] + b[:, 1] - most) - 1e-9)
        ok &= np.bitwise_count(bits[i] ^ bits[i + lag]).sum(axis=1, dtype=np.int64) <= (a[:, 1] + b[:, 1]) * (1 - least) / (1 + least) + 1e-9
        if ok.any():
            yield np.minimum(a[ok, 2], b[ok, 2]), np.maximum(a[ok, 2], b[ok, 2]), a[ok, 1] + b[ok, 1]
        lag += 1


def runs(batches):
    """Rows of Arrow batches of longs sorted by their first column, as arrays that no run of it is cut by."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        change = np.flatnonzero(table[1:, 0] != table[:-1, 0]) + 1
        if held and held[-1][-1, 0] != table[0, 0]:
            yield np.concatenate(held)
            held = []
        if len(change):
            yield np.concatenate([*held, table[: change[-1]]])
            held, table = [], table[change[-1] :]
        held.append(table)
    if held:
        yield np.concatenate(held)


def missed_links(slim: DataFrame, groups: DataFrame, numbers: Nodes, shingle: int, least: float, heavy_from: int = HEAVY, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between classes, by prefix filtering; any two of different groups that can have the similarity hang together by them.

    Copies with changes share hundreds of shingles, and each shingle would give all
    pairs of them. A task gives a pair only if its two classes do not hang together
    by the pairs that it gave before, so it makes fewer rows than it reads.
    A task gives the prefix of a class once, however many copies of it it reads,
    and a shingle in the prefixes of over `bucket` classes is dealt out as pairs of blocks.

    slim: body; groups: node, component of all classes, by what is linked already, and their parity words.
    """
    context = slim.sparkSession.sparkContext
    schema = "key long, size long, node long, place long"
    none = np.zeros(0, "<u8"), np.zeros(0, np.int64)

    def prefixes(shared):
        def over(batches):
            heavy, weight = shared.value if shared is not None else none
            given: set[int] = set()
            for batch in in_steps(batches):
                keys, nodes, sizes, places = [], [], [], []
                for body in batch.column(0).to_pylist():
                    hashes = shingle_hashes(body, shingle)
                    node = numbers.of(hashes)
                    if not len(hashes) or node in given:
                        continue
                    given.add(node)
                    own = prefix(hashes, least, heavy, weight)
                    keys.append(own)
                    nodes.append(np.full(len(own), node))
                    sizes.append(np.full(len(own), len(hashes)))
                    places.append(np.arange(len(own)))
                if keys:
                    keys = np.concatenate(keys).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, nodes, places))], names=["key", "size", "node", "place"])

        return slim.select("body").mapInArrow(over, schema)

    counts = cut(prefixes(None).groupBy("key").count().filter(F.col("count") > heavy_from))
    found = counts.orderBy(F.desc("count"), "key").limit(MOST_HEAVY).toArrow()
    heavy = found.column(0).to_numpy().astype(np.int64).view("<u8")
    order = np.argsort(heavy)
    shared = context.broadcast((heavy[order], found.column(1).to_numpy().astype(np.int64)[order]))

    def again(batches):
        for rows in runs(batches):
            first = np.append(True, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2]))
            rows = rows[first]
            same = rows[1:, 0] == rows[:-1, 0]
            rows = rows[np.append(same, False) | np.append(False, same)]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], names=["key", "size", "node", "place"])

    repeated = cut(prefixes(shared).repartition("key").sortWithinPartitions("key", "node").mapInArrow(again, schema))
    words = [f"p{k}" for k in range(PARITY)]
    full = cut(repeated.groupBy("key").count().filter(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("blocks")))
    if not full.isEmpty():
        # a pair of blocks has a key of its own; were two of them equal, their rows would be compared as well
        keys = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(met_blocks("node", F.col("blocks")), lambda x: F.xxhash64("key", x)))
        repeated = repeated.join(full, "key", "left").select(F.explode(keys).alias("key"), "size", "node", "place")
    named = repeated.join(groups, "node").select("key", "size", "node", "component", "place", *words)

    def joins(batches):
        parent: dict[int, int] = {}
        for rows in runs(batches):
            if len(parent) > REMEMBERED:
                parent = {}
            for left, right, _ in run_pairs(rows, least):
                left, right = _forest(left, right, parent)
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    return named.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(joins, "a long, b long")


def sketch(hashes: np.ndarray) -> bytes:
    """Parity bits of a set, a power of two of them and at least 4 for each element; a wider sketch folds to a narrower one."""
    width = max(64, 1 << (4 * len(hashes) - 1).bit_length())
    odd = np.bincount((mixed(hashes) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(mine: bytes, theirs: bytes) -> int:
    """Bits in which two sketches differ: at most as many as the sets have elements that only one of them holds."""
    x, y = sorted((np.frombuffer(mine, "<u8"), np.frombuffer(theirs, "<u8")), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum(dtype=np.int64))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, distance: int = DISTANCE, further: int = FURTHER, bucket: int = BUCKET, most_sets: int = SETS, most_shingles: int = SET_SHINGLES) -> DataFrame:
    """doc_id, body_hash (xxhash64 of the text), component_id, kept of every row.

    Two documents link if their sets of shingles have the similarity or more.
    Most are found by fingerprints of two words, in coarse groups that may
    hold less similar ones; within a coarse group sets are compared in full.
    Prefix filtering joins every pair that is left, whatever its fingerprints, in
    further groups, within which sets are compared in full as well.
    Of a group the row with the smallest (identifier, text hash) is kept.
    """
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("body"), F.xxhash64(raw(text_col)).alias("body_hash"))

    odd = [f"p{k}" for k in range(PARITY)]

    def marks(batch):
        made = [shingle_hashes(x, shingle) for x in batch.column(1).to_pylist()]
        bits = np.array([set_words(m) for m in made], dtype=np.uint64).view(np.int64)
        ids = np.array([set_digest(m) for m in made], dtype=np.int64)
        sifts = np.array([parity(m) for m in made], dtype=np.int64).reshape(-1, PARITY)
        sizes = np.array([len(m) for m in made], dtype=np.int64)
        columns = [ids[:, 0], ids[:, 1], bits[:, 0], bits[:, 1], sizes, *sifts.T]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=["doc_id", "body_hash", "node", "twin", "w0", "w1", "size", *odd])

    docs = cut(arrow_map(slim, marks, "doc_id long, body_hash long, node long, twin long, w0 long, w1 long, size long, " + ", ".join(f"{x} long" for x in odd)))
    docs, numbers = told_apart(docs)
    classes = cut(docs.select("node", "w0", "w1", "size", *odd).dropDuplicates(["node"]))

    def held_sets(nodes):
        """node, hashes: the sets of the classes in nodes, and of a few more."""
        shared = df.sparkSession.sparkContext.broadcast(bloom_filter(nodes))

        def sets(batches):
            given: set[int] = set()
            for batch in in_steps(batches):
                found = {}
                for body in batch.column(0).to_pylist():
                    hashes = shingle_hashes(body, shingle)
                    if (node := numbers.of(hashes)) not in given:
                        found[node] = hashes
                nodes = np.array(list(found), np.int64)
                nodes = nodes[may_hold(shared.value, nodes)]
                given.update(nodes.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([found[x].tobytes() for x in nodes.tolist()], pa.binary())], names=["node", "hashes"])

        return slim.select("body").mapInArrow(sets, "node long, hashes binary").dropDuplicates(["node"])

    def within(groups):
        """a, b: verified links between the classes of each group (node, component) that hold what is similar in it together."""
        blocks = F.ceil(F.greatest(F.col("n") / most_sets, F.col("shingles") / most_shingles, F.lit(1.0))).cast("int")
        sizes = groups.join(classes.select("node", "size"), "node").groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
        dealt = groups.join(cut(sizes), "component").withColumn("blocks", blocks)
        dealt = cut(dealt.select("node", "component", F.explode(met_blocks("node", F.col("blocks"))).alias("block"))).join(held_sets(groups.select("node")), "node")
        dealt = dealt.select("component", "block", "node", "hashes").repartition("component", "block").sortWithinPartitions("component", "block")
        return dealt.mapInArrow(verify, "a long, b long")

    def whole(found):
        """node, component of all nodes of components(found), those too that are the smallest of theirs."""
        return cut(found.union(found.select(F.col("component").alias("node"), "component").distinct()))

    def verify(batches):
        key, node, own = None, [], []

        def found():
            pairs = similar_links(np.array(node), own, similarity) if len(node) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for group, block, n, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, block) != key:
                    yield from found()
                    key, node, own = (group, block), [], []
                node.append(n)
                own.append(np.frombuffer(hashes, "<u8"))
        yield from found()

    coarse = whole(components(links(classes, 2, distance, further, bucket)))
    parts = whole(components(within(coarse)))
    groups = classes.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), *odd)
    more = whole(components(missed_links(slim, groups, numbers, shingle, similarity, bucket=bucket)))
    if not more.isEmpty():
        judged = within(more)
        parts = whole(components(judged.union(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))))
    rows = docs.select("doc_id", "body_hash", "node").join(parts, "node", "left").withColumn("group", F.coalesce("component", "node"))
    rows = cut(rows.select("doc_id", "body_hash", "group"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("body_hash"))
    first = rows.groupBy("group").agg(F.min(place).alias("first"))
    out = rows.join(first, "group")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("body_hash") == F.col("first.body_hash"))
    return out.select("doc_id", "body_hash", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))


def similar_kept(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of df that stay when one of each group is kept; rows equal in identifier and text stay or go together.

    The list of rows that go grows with the corpus, so it is joined by a
    shuffle at every size.
    """
    gone = similar_groups(df, id_col, text_col, **settings).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.col("body_hash").alias("__gone_hash")).distinct().hint("merge")
    on = (F.xxhash64(raw(text_col)) == F.col("__gone_hash")) & F.col(id_col).cast("long").eqNullSafe(F.col("__gone_id"))
    return df.join(gone, on, "left_anti")
