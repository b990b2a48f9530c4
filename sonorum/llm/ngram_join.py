"""N-gram Jaccard self-join: token-combination prefixes, then exact verification.

A document is the set of its k-word shingles.  Equal sets are one class and are
handled once.  Shingles are ordered by rising document frequency.  Two sets of
Jaccard similarity t or more can miss at most n - ceil(t n) of the shingles of
either; so a prefix in that order that holds one more of them, weighted as
follows, must share a signature with the other's:

* a rare shingle (in fewer than RARE classes) is a signature by itself and
  counts 1;
* frequent shingles are dealt to groups by hash, and every pair of one group is
  a signature; a group with p of them counts p - 1, because p - 1 can miss
  without leaving a common pair.  The prefix is extended until the counts
  suffice.  The number of groups follows from the size class of the smaller
  set, so a set emits for every class in which it can be the larger one.  Sets of
  fewer than SMALL shingles use single frequent shingles.

Only the order decides what is cheap, never what is found: a frequency that is
off changes prefixes, not results.

Signatures go through one packed exchange in which those that only one class
has disappear.  What is left are posting lists, and each has a hub, the class
that most lists hold.  First every class meets one hub, the best of its lists;
then, in each list, the classes outside the component of its hub meet that hub.
Both are linear in the lists.  Classes still outside meet all others of their
list at last, except those of their own component: long lists are cut into
blocks of BLOCK classes, a block meets a block as a matrix of parity sketches,
and only the pairs that the sketches leave become rows.  Every pair that shares
a signature is therefore verified, ruled out or known to be connected.  After
each step components are made of the new links alone, between the labels so far.
Before sets are compared, parity sketches (one bit for a shingle or two) bound
the difference from below and drop pairs that cannot link, never one that can.

Defined results: null or empty text and text without words: 0 shingles, its own
component, linked with nothing; repeated rows fall into one component; a null
doc_id takes part and never names a component unless no other id is in it; an
empty table gives an empty table; other columns are not carried on.

Sets are told apart by 64-bit ids and hold 64-bit hashes of their shingles: of
10^9 different sets, 0.03 pairs are expected to be taken for equal by mistake.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, dropped, released, scratch, ship, text_slices, trim, written
from .hashing import mix, shingle_sets, signed

WORDS = 5
PERCENT = 75
RARE = 48
SMALL = 16
#: Frequent shingles that tasks know of (12 bytes each); the most frequent ones if there are more.
FREQUENT_LIMIT = 2_000_000
#: Class ids that a scan filters by (8 bytes each); beyond that the join filters.
FILTER_LIMIT = 2_000_000
#: Shingles that one task counts or groups at a time.
BUCKET_TOKENS = 1_000_000
#: Tokens that a task packs before it sends them, and class ids by which it knows sets that it has sent (a repeat costs time only).
PACKED_TOKENS, SEEN_SETS = 500_000, 500_000
KEY_BITS = 32
#: Classes of one list that one step compares with as many others.
BLOCK = 1024
#: Pairs that are looked at together, and signatures of a class by which lists share out their common pairs.
PAIRS_AT_ONCE, LOWEST = 500_000, 8

U = np.uint64


def required(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n must share with any similar one."""
    return -(-n * percent // 100)


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for the empty one."""
    sums = np.zeros(len(tokens) + 1, U)
    np.cumsum(mix(tokens + U(0x632BE59BD9B4E019)), out=sums[1:])
    n = np.diff(offsets).astype(U)
    out = mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ (n * U(0x9E3779B97F4A7C15)))
    return np.where(n == 0, U(0), out)


def sketch(tokens: np.ndarray) -> bytes:
    """Parity bits: bit j is the parity of the number of tokens that fall on j; as many bits as the next power of two."""
    bits = max(64, 1 << max(0, len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sketched sets."""
    if len(a) > len(b):
        a, b = b, a
    y = np.frombuffer(b, np.uint8)
    while len(y) > len(a):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ y).sum())


def may_link(n_a: int, n_b: int, difference: int, percent: int) -> bool:
    """|a & b| * 100 >= percent * |a | b| for the given (least) symmetric difference."""
    return 100 * (n_a + n_b - difference) >= percent * (n_a + n_b + difference)


def classes(n: int, percent: int) -> range:
    """Size classes (floor of log2 of the smaller set's size) in which a set of n can be part of a pair."""
    return range(required(n, percent).bit_length() - 1, n.bit_length())


def signatures(tokens: np.ndarray, frequency: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rare and other signatures of one set; frequency: of each token, 0 if rare."""
    n = len(tokens)
    need = n - required(n, percent) + 1
    rare = tokens[frequency == 0]
    if len(rare) >= need:
        return np.sort(rare)[:need], np.zeros(0, U)
    need -= len(rare)
    at = frequency > 0
    common = tokens[at][np.lexsort((tokens[at], frequency[at]))]
    out = []
    for c in classes(n, percent):
        if 1 << c < SMALL:
            out.append(mix(common[:need] ^ U(0x5851F42D4C957F2D)))
            continue
        groups = 1 << (c - 1)
        group = (mix(common) & U(groups - 1)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        place = np.empty(len(group), np.int64)  # of a token in its group, in frequency order
        starts = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1]) if len(group) else np.zeros(0, np.int64)
        place[order] = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        worth = np.cumsum(place > 0)
        end = int(np.searchsorted(worth, need)) + 1
        member = np.flatnonzero(place[:end] >= 0)
        own, g, p = common[member], group[member], place[member]
        o = np.lexsort((p, g))
        own, g = own[o], g[o]
        for gap in range(1, int(p.max()) + 1 if len(p) else 1):
            same = np.flatnonzero(g[gap:] == g[:-gap])
            a, b = own[same], own[same + gap]
            out.append(mix(np.minimum(a, b) * U(3) + mix(np.maximum(a, b)) + U(c)))
    return np.sort(rare), np.unique(np.concatenate(out)) if out else np.zeros(0, U)


class Packer:
    """Arrays by bucket, sent as one row a bucket once they are many."""

    def __init__(self, buckets: int, limit: int = PACKED_TOKENS):
        self.buckets, self.limit = buckets, limit
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> bool:
        self.parts.append((bucket, *columns))
        self.held += len(bucket)
        return self.held >= self.limit

    def rows(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        if not self.held:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts, self.held = [], 0
        order = np.argsort(columns[0], kind="stable")
        bucket = columns[0][order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(bucket[a]), [c[order[a:b]] for c in columns[1:]]


class Sets:
    """Shingle sets of a stream of documents; of equal sets in one task only the first, on demand."""

    def __init__(self, k: int, once: bool = True):
        self.k, self.once, self.seen = k, once, set()

    def __call__(self, batches: Iterator[pa.RecordBatch]):
        """Of each slice: doc ids (Arrow), class ids, tokens, offsets, numbers of the sets to take."""
        for part, texts in text_slices(batches):
            tokens, offsets = shingle_sets(texts, self.k)
            ids = set_ids(tokens, offsets)
            take = [i for i in range(len(texts)) if offsets[i + 1] > offsets[i]]
            if self.once:
                fresh = []
                for i in take:
                    if int(ids[i]) not in self.seen:
                        if len(self.seen) >= SEEN_SETS:
                            self.seen.clear()
                        self.seen.add(int(ids[i]))
                        fresh.append(i)
                take = fresh
            yield part, ids, tokens, offsets, take


def _members(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, tokens, offsets, _ in Sets(k, once=False)(batches):
            sketches = [sketch(tokens[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(signed(ids)), pa.array(sketches, pa.binary())], ["doc_id", "n", "set_id", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, set_id long, sketch binary")


def _frequent(docs: DataFrame, k: int, total: int, rare: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (leading bits) of frequent shingles, ascending, and their frequencies, counted over all documents."""
    bits = max(6, (-(-total // BUCKET_TOKENS) - 1).bit_length())
    shift = U(64 - bits - KEY_BITS)

    def send(packer: Packer) -> Iterator[pa.RecordBatch]:
        rows = []
        for bucket, (keys,) in packer.rows():
            one, counts = np.unique(keys, return_counts=True)
            gaps = np.diff(one.astype(np.uint32), prepend=np.uint32(0))
            planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()
            many = counts > 1
            rows.append((bucket, pa.compress(planes, "zstd", asbytes=True), len(one), one[many].astype("<u4").tobytes(), counts[many].astype("<u4").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "gaps", "n", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(1 << bits)
        for _, _, tokens, offsets, take in Sets(k)(batches):
            if take:
                own = np.concatenate([tokens[offsets[i] : offsets[i + 1]] for i in take]) >> shift
                if packer.add((own >> U(KEY_BITS)).astype(np.int64), (own & U((1 << KEY_BITS) - 1)).astype(np.uint32)):
                    yield from send(packer)
        yield from send(packer)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        trim()
        keys, counts = [], []
        for gaps, n, many, more in zip(*(table.column(c).to_pylist() for c in ("gaps", "n", "keys", "counts")), strict=True):
            planes = np.frombuffer(pa.decompress(gaps, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
            keys += [np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32), np.frombuffer(many, "<u4")]
            counts += [np.ones(n, np.int64), np.frombuffer(more, "<u4").astype(np.int64) - 1]
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts[order], starts)
        at = sums >= rare
        return pa.table({"key": keys[starts][at].astype(np.int64) + (int(key[0].as_py()) << KEY_BITS), "df": sums[at]})

    packed = docs.mapInArrow(run, "bucket int, gaps binary, n long, keys binary, counts binary")
    rows = packed.groupBy("bucket").applyInArrow(count, "key long, df long").orderBy(F.desc("df"), "key").limit(limit).toPandas()
    keys, df = rows["key"].to_numpy(np.int64), rows["df"].to_numpy(np.int64)
    order = np.argsort(keys)
    return keys[order].astype(U) << shift, df[order], shift


def _lists(docs: DataFrame, k: int, percent: int, total: int, frequent) -> DataFrame:
    """sig, set_id of the signatures that at least two classes have (of frequent ones: may have)."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)
    bits = max(6, (-(-total // BUCKET_TOKENS) - 1).bit_length())

    def send(packer: Packer) -> Iterator[pa.RecordBatch]:
        rows = [(bucket, sigs.tobytes(), ids.tobytes(), common.tobytes()) for bucket, (sigs, ids, common) in packer.rows()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "sigs", "ids", "common"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, df, shift = held.value
        packer = Packer(1 << bits)
        for _, ids, tokens, offsets, take in Sets(k)(batches):
            key = tokens >> shift << shift
            at = np.searchsorted(keys, key)
            known = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key) if len(keys) else np.zeros(len(tokens), bool)
            frequency = np.where(known, df[np.minimum(at, max(0, len(keys) - 1))], 0) if len(keys) else np.zeros(len(tokens), np.int64)
            for i in take:
                rare, common = signatures(tokens[offsets[i] : offsets[i + 1]], frequency[offsets[i] : offsets[i + 1]], percent)
                sigs = np.concatenate([rare, common])
                flag = np.zeros(len(sigs), np.uint8)
                flag[len(rare) :] = 1
                # frequent ones are dealt by the class as well, so that no bucket gathers a hot signature
                deal = sigs >> U(64 - bits)
                deal[len(rare) :] = mix(common ^ ids[i]) >> U(64 - bits)
                full = packer.add(deal.astype(np.int64), sigs, np.full(len(sigs), ids[i], U), flag)
            if take and full:
                yield from send(packer)
        yield from send(packer)

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        trim()
        sigs, ids, common = (np.concatenate([np.frombuffer(x, t) for x in table.column(c).to_pylist()]) for c, t in (("sigs", "<u8"), ("ids", "<u8"), ("common", np.uint8)))
        order = np.lexsort((ids, sigs))
        sigs, ids, common = sigs[order], ids[order], common[order]
        new = np.ones(len(sigs), bool)
        new[1:] = (sigs[1:] != sigs[:-1]) | (ids[1:] != ids[:-1])
        sigs, ids, common = sigs[new], ids[new], common[new]
        edge = np.flatnonzero(np.concatenate([[True], sigs[1:] != sigs[:-1], [True]]))
        size = np.repeat(np.diff(edge), np.diff(edge))
        at = (size > 1) | (common > 0)
        return pa.table({"sig": signed(sigs[at]), "set_id": signed(ids[at])})

    packed = docs.mapInArrow(run, "bucket int, sigs binary, ids binary, common binary")
    return packed.groupBy("bucket").applyInArrow(gather, "sig long, set_id long")


def _pruned(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches leave; with n_a, n_b."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
    pairs = pairs.where((F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, s_a, s_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b"))
            keep = [may_link(*x[:2], least_difference(*x[2:]), percent) for x in zip(n_a, n_b, s_a, s_b, strict=True)]
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, n_a long, n_b long")


def _tokens(docs: DataFrame, wanted: DataFrame, k: int, filter_limit: int) -> DataFrame:
    """set_id, tokens of the wanted classes (set_id, first_id), read from the row that names the class."""
    spark = docs.sparkSession
    only = None
    if wanted.count() <= filter_limit:
        rows = wanted.toPandas()
        named = rows["first_id"].notna().to_numpy()
        ids = rows["set_id"].to_numpy(np.int64)
        order = np.argsort(ids)
        only = spark.sparkContext.broadcast((ids[order], named[order], rows["first_id"].fillna(0).to_numpy(np.int64)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, tokens, offsets, take in Sets(k, once=False)(batches):
            own, doc_ids = signed(ids), part.column("doc_id")
            if only is not None and len(only.value[0]):
                known, named, first = only.value
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                is_first = doc_ids.fill_null(0).to_numpy(zero_copy_only=False) == first[at]
                inside = (known[at] == own) & (is_first | ~named[at])
                take = [i for i in take if inside[i]]
            for at in range(0, len(take), 500):
                some = take[at : at + 500]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(some)), pa.array(own[some]), pa.array([tokens[offsets[i] : offsets[i + 1]].tobytes() for i in some], pa.binary())], ["doc_id", "set_id", "tokens"])

    full = docs.mapInArrow(run, "doc_id long, set_id long, tokens binary")
    if only is None:
        full = full.join(wanted, (full["set_id"] == wanted["set_id"]) & (F.col("first_id").isNull() | (F.col("doc_id") == F.col("first_id"))), "left_semi")
    return full.select("set_id", "tokens")


def _verified(tokens: DataFrame, pairs: DataFrame, percent: int, filter_limit: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by their full sets."""
    needed = pairs.select(F.col("a").alias("set_id")).distinct().union(pairs.select("b").distinct()).distinct()
    if needed.count() <= filter_limit:
        tokens = tokens.join(F.broadcast(needed), "set_id", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.select("a", "b").join(tokens.select(F.col("set_id").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    both = with_b.join(tokens.select(F.col("set_id").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    return both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(check, "a long, b long").distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, label of all nodes of links (a, b): label is the smallest node of the component.

    Alternating large-star and small-star steps, each a partial minimum and a
    join, written to the shared folder after every round, until nothing moves.
    """
    spark = links.sparkSession
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{folder}/edges-0")
    state = None
    for k in itertools.count(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(small, f"{folder}/edges-{k}")
        dropped(spark, f"{folder}/edges-{k - 1}")
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _labelled(rows: DataFrame, labels: DataFrame | None, node: str, name: str) -> DataFrame:
    """rows with the label of a node; a node without links is its own."""
    if labels is None:
        return rows.withColumn(name, F.col(node))
    own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return rows.join(own, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", node)).drop("_node", "_label")


def _relabelled(labels: DataFrame | None, links: DataFrame, folder: str) -> DataFrame:
    """Labels after more links (a, b): only the labels that the links join go through another round of components."""
    joined = _labelled(_labelled(links, labels, "a", "la"), labels, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    found = components(joined, folder)
    if labels is None:
        return found
    moved = _labelled(labels.select("node", F.col("label").alias("before")), found, "before", "label").select("node", "label")
    return moved.unionByName(found.join(labels, "node", "left_anti"))


def _folded(sketches: list[bytes], rows: np.ndarray, width: int) -> np.ndarray:
    """The sketches of some rows, folded to so many words."""
    out = np.empty((len(rows), width), U)
    for at, k in enumerate(rows):
        x = np.frombuffer(sketches[k], "<u8")
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[at] = x
    return out


def close_pairs(part: dict[str, np.ndarray], sketches: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the entries of whole lists: pairs of one list that differ in label and that sizes and sketches leave.

    part: list (number of each entry's list, ascending), sig, set_id, label, n,
    left, right, low (least signatures of the class).  A pair that is sure to
    meet in a list of a smaller signature too is left to that list.
    """
    rights = np.flatnonzero(part["right"])
    lefts = np.flatnonzero(part["left"])
    begin = np.searchsorted(part["list"][rights], part["list"][lefts], "left")
    count = np.searchsorted(part["list"][rights], part["list"][lefts], "right") - begin
    width = np.array([len(x) // 8 for x in sketches], np.int64)
    out_i, out_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total = np.concatenate([[0], np.cumsum(count)])
    start = 0
    while start < len(lefts):
        end = max(start + 1, int(np.searchsorted(total, total[start] + PAIRS_AT_ONCE, "right")) - 1)
        own = count[start:end]
        i = np.repeat(lefts[start:end], own)
        j = rights[np.arange(len(i)) - np.repeat(total[start:end] - total[start], own) + np.repeat(begin[start:end], own)]
        start = end
        n_i, n_j, ids = part["n"][i], part["n"][j], part["set_id"]
        fits = (part["label"][i] != part["label"][j]) & (100 * n_i >= percent * n_j) & (100 * n_j >= percent * n_i)
        fits &= (ids[i] < ids[j]) | ~(part["left"][j] & part["right"][i])
        i, j = i[fits], j[fits]
        keep = np.ones(len(i), bool)
        for at in range(0, len(i), 50_000):
            x, y = part["low"][i[at : at + 50_000]], part["low"][j[at : at + 50_000]]
            below = x < part["sig"][i[at : at + 50_000]][:, None]
            shared = np.zeros(x.shape, bool)
            for k in range(y.shape[1]):
                shared |= x == y[:, k : k + 1]
            keep[at : at + 50_000] = ~(shared & below).any(1)
        i, j = i[keep], j[keep]
        least = np.minimum(width[i], width[j])
        for w in np.unique(least):
            at = np.flatnonzero(least == w)
            rows, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            words = _folded(sketches, rows, int(w))
            step = max(1, 500_000 // int(w))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                a, b = back[k : k + len(some)], back[len(at) + k : len(at) + k + len(some)]
                apart = np.bitwise_count(words[a] ^ words[b]).sum(1, dtype=np.int64)
                both = part["n"][i[some]] + part["n"][j[some]]
                near = 100 * (both - apart) >= percent * (both + apart)
                out_i.append(i[some][near]), out_j.append(j[some][near])
    return np.concatenate(out_i), np.concatenate(out_j)


def _close(entries: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of one list, one of them outside its hub's component, of unlike labels, that sizes and sketches leave.

    entries: sig, set_id, label, n, sketch, low, outside, rows (of the list).  A
    list of more than BLOCK classes is cut into blocks, and every block of
    outside classes meets every block: no task holds more than two blocks of one
    list at a time, and only the pairs that are left are rows.
    """
    parts = F.ceil(F.col("rows") / F.lit(float(BLOCK))).cast("int")
    own = F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("parts")).cast("int")
    dealt = entries.withColumn("parts", parts).withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("outside").alias("left"), F.lit(True).alias("right")))
    asks = F.transform(every, lambda k: F.struct(F.col("own").alias("i"), k.alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    meets = F.transform(every, lambda k: F.struct(k.alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    roles = F.when(F.col("parts") == 1, one).when(F.col("outside"), F.concat(asks, meets)).otherwise(meets)
    held = ["set_id", "label", "n", "sketch", "low"]
    tall = dealt.select("sig", *held, F.explode(roles).alias("r")).select("sig", "r.i", "r.j", "r.left", "r.right", *held)

    def compare(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        part = {c: table.column(c).to_numpy() for c in ("sig", "i", "j", "left", "right", "set_id", "label", "n")}
        edge = np.zeros(table.num_rows, bool)
        for c in ("sig", "i", "j"):
            edge[1:] |= part[c][1:] != part[c][:-1]
        part["list"] = np.cumsum(edge)
        part["low"] = np.frombuffer(b"".join(table.column("low").to_pylist()), ">i8").reshape(table.num_rows, LOWEST).astype(np.int64)
        i, j = close_pairs(part, table.column("sketch").to_pylist(), percent)
        ids = part["set_id"]
        pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "i", "j")]
            edges = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            goes_on = bool(waiting) and all(waiting[-1].column(c)[waiting[-1].num_rows - 1].as_py() == k[0] for c, k in zip(("sig", "i", "j"), keys, strict=True))
            if waiting and not goes_on:
                yield compare(waiting)
                waiting = []
            last = int(edges[-1]) if len(edges) else 0
            if last:
                yield compare([*waiting, batch.slice(0, last)])
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield compare(waiting)

    return tall.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, rare: int = RARE, frequent_limit: int = FREQUENT_LIMIT, filter_limit: int = FILTER_LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    ship(spark)
    top = scratch(spark)
    docs = documents(docs)
    members = written(_members(docs, k), f"{top}/members")
    sets = written(members.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first_id")), f"{top}/sets")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = _frequent(docs, k, total, rare, frequent_limit)
    released(spark)
    lists = written(_lists(docs, k, percent, total, frequent), f"{top}/lists")
    released(spark)
    # the hub of a list is the class that most lists hold, which is likely the middle of a group
    held = lists.groupBy("set_id").agg(F.count(F.lit(1)).alias("lists"))
    weighed = lists.join(held, "set_id").select("sig", "set_id", F.struct("lists", "set_id").alias("w"))
    hubs = weighed.groupBy("sig").agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("sig", F.col("w.set_id").alias("hub"), F.col("w.lists").alias("lists"), "rows")
    hubs = written(hubs, f"{top}/hubs")
    shared = written(lists.join(hubs, "sig").select("sig", "set_id", "hub", "lists", "rows"), f"{top}/shared")
    dropped(spark, f"{top}/lists", f"{top}/hubs")
    tokens = written(_tokens(docs, sets.join(shared.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "first_id"), k, filter_limit), f"{top}/tokens")
    released(spark)

    def met(n: int, labels: DataFrame | None, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Verify pairs (a, b): those taken up, and the labels that their links make."""
        asked = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{top}/asked-{n}")
        left = written(_pruned(asked, sets, percent), f"{top}/pairs-{n}")
        found = written(_verified(tokens, left, percent, filter_limit), f"{top}/links-{n}")
        dropped(spark, f"{top}/pairs-{n}")
        after = written(_relabelled(labels, found, f"{top}/cc-{n}"), f"{top}/labels-{n}")
        dropped(spark, f"{top}/links-{n}", f"{top}/cc-{n}")
        released(spark)
        return asked, after

    # one: every class meets the hub that most lists hold among those of its own lists
    best = shared.groupBy("set_id").agg(F.max(F.struct("lists", "hub"))["hub"].alias("b")).select(F.col("set_id").alias("a"), "b")
    asked, labels = met(1, None, best)
    # two: in each list the classes outside the component of its hub meet the hub
    listed = lambda: _labelled(_labelled(shared, labels, "set_id", "label"), labels, "hub", "hub_label")
    others = listed().where("label <> hub_label").select(F.least("set_id", "hub").alias("a"), F.greatest("set_id", "hub").alias("b")).distinct()
    _, labels = met(2, labels, others.join(asked, ["a", "b"], "left_anti"))
    dropped(spark, f"{top}/asked-1", f"{top}/asked-2", f"{top}/labels-1")
    # three: those still outside meet all others of the list, in blocks
    entries = written(listed().select("sig", "set_id", "hub", "label", "rows", (F.col("label") != F.col("hub_label")).alias("outside")), f"{top}/entries")
    open_lists = entries.where("outside").select("sig").distinct()
    rest = written(entries.join(open_lists, "sig", "left_semi").where("set_id <> hub"), f"{top}/rest")
    # the least signatures of a class, as sortable bytes of one length
    least = F.slice(F.array_sort(F.concat(F.collect_list("sig"), F.array_repeat(F.lit((1 << 63) - 1), LOWEST))), 1, LOWEST)
    low = rest.groupBy("set_id").agg(F.unhex(F.array_join(F.transform(least, lambda x: F.lpad(F.hex(x), 16, "0")), "")).alias("low"))
    known = rest.join(low.join(sets.select("set_id", "n", "sketch"), "set_id"), "set_id")
    _, labels = met(3, labels, _close(known.select("sig", "set_id", "label", "n", "sketch", "low", "outside", "rows"), percent))
    dropped(spark, *(f"{top}/{x}" for x in ("entries", "rest", "shared", "tokens", "asked-3", "labels-2")))
    released(spark)
    labelled = _labelled(sets.select("set_id", "first_id"), labels, "set_id", "label")
    named = labelled.groupBy("label").agg(F.min("first_id").alias("component_id")).join(labelled.select("set_id", "label"), "label").select("set_id", "component_id")
    return members.join(named, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
