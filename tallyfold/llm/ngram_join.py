"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact sets verify them.

Each set has a signature of DEEPEST values in each of TREES tries. A trie is sorted by signature, so sets that share a prefix stand
together, and how long a prefix two of them share is read off their neighbours in that order. Each set is matched at the
longest prefix that still reaches the target recall for the least similarity that a set of its size can have
at the threshold; only sets that need it are matched by shorter prefixes, down to that of the threshold itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, write_table
from .components import components

WORDS, THRESHOLD = 5, 0.8
#: Tries, the length of a signature in one, and the recall of a pair at the threshold.
TREES, DEEPEST, RECALL = 32, 8, 0.99999
#: How likely the sketches may miss a pair at the threshold; 0: sketches decide nothing.
MISS = 1e-7
#: Members of a prefix that a task compares with each other at once by sketch.
CELL = 512
#: Members, and bytes of their sets, of each of the two parts that a task compares by exact sets.
PART_ROWS, PART_BYTES = 256, 8 << 20
#: Up to so many dropped or picked documents (about 100 bytes each) are broadcast.
FEW = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def recall(depth: int, similarity: float = THRESHOLD, trees: int = TREES) -> float:
    """How likely two sets share a prefix of this length in a trie or more."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(similarity: float = THRESHOLD, trees: int = TREES, target: float = RECALL) -> int:
    """The longest prefix with the target recall for pairs of this similarity."""
    depth = DEEPEST
    while depth > 1 and recall(depth, similarity, trees) < target:
        depth -= 1
    if recall(depth, similarity, trees) < target:
        raise ValueError("more tries are needed for this recall")
    return depth


def least_similarity(size: int, threshold: float = THRESHOLD) -> float | None:
    """The least similarity from the threshold on of a set of this size with a different set; None if it can have none."""
    low, exact = None, round(threshold * 1000)
    for other in range(max(1, -(-exact * size // 1000)), 1000 * size // exact + 1):
        shared = -(-exact * (size + other) // (1000 + exact))
        if shared <= min(size, other) and not shared == size == other:
            found = shared / (size + other - shared)
            low = found if low is None else min(low, found)
    return low


@cache
def depth_of(size: int, threshold: float = THRESHOLD) -> int:
    """The prefix length at which a set of this size is matched; 0 if no different set can be its partner."""
    if size > 200:
        return prefix_length(threshold)
    low = least_similarity(size, threshold)
    return 0 if low is None else prefix_length(low)


def least_agreement(values: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The most agreeing two-bit values such that a pair at the threshold has fewer with a chance below ``miss``."""
    p = threshold + (1 - threshold) / 4
    chance, total = (1 - p) ** values, 0.0
    for k in range(values + 1):
        total += chance
        if total > miss:
            return k
        chance *= (values - k) / (k + 1) * p / (1 - p)
    return values


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x5851F42D4C957F2D)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base, np.uint64), np.full(n, back, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Shingler:
    """Sets of hashed word n-grams of texts, as sorted arrays. Hashes are the same in every process."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.up, self.down = words, *_powers(1 << 20)

    def word_hashes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each word of some bytes: a polynomial of its bytes, by running sums."""
        if len(raw) > len(self.up):
            self.up, self.down = _powers(2 * len(raw))
        space = np.concatenate([[True], _SPACE[raw], [True]])
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * self.up[: len(raw)])])
        return _mixed((total[end] - total[start]) * self.down[start]), start

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """A text of fewer words is one n-gram of all its words; one without words has an empty set."""
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        whole = np.frombuffer(b" ".join(raws), np.uint8).astype(np.uint64)
        one, start = self.word_hashes(whole)
        begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
        at = np.searchsorted(start, begin)
        n = self.words
        grams = np.zeros(max(0, len(one) - n + 1), np.uint64)
        for i in range(n):
            grams = _mixed(grams * _MIX + one[i : i + len(grams)])
        out = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo >= n:
                out.append(np.unique(grams[lo : hi - n + 1]))
            else:
                key = np.zeros(min(1, hi - lo), np.uint64)
                for w in one[lo:hi]:
                    key = _mixed(key * _MIX + w)
                out.append(key)
        return out


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """MinHash values, (hash, set), of sets that are not empty."""
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 1 << 32, hashes, dtype=np.uint32)
    factors = rng.integers(0, 1 << 32, hashes, dtype=np.uint32) | np.uint32(1)
    out = np.zeros((hashes, len(sets)), np.uint32)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 1 << 15):
            size += len(sets[to])
            to += 1
        x = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])]).astype(np.int64)
        for i in range(hashes):
            out[i, at:to] = np.minimum.reduceat((x ^ seeds[i]) * factors[i], starts)
        at = to
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each MinHash value, (set, bytes). The values' own low bits depend on each other, so they are mixed first."""
    two = (_mixed(sig.astype(np.uint64)) & np.uint64(3)).astype(np.uint8).T
    return two[:, 0::4] | two[:, 1::4] << 2 | two[:, 2::4] << 4 | two[:, 3::4] << 6


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many two-bit values of sketches are equal, row by row."""
    differ = a ^ b
    differ = (differ | differ >> 1) & 0x55
    return 4 * a.shape[1] - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)


def _texts(b: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch in runs of about ``most`` characters."""
    at, run, size = 0, [], 0
    for i, v in enumerate(b.column(column)):
        t = v.as_py()
        run.append(t)
        size += len(t or "")
        if size >= most or i == b.num_rows - 1:
            yield at, run
            at, run, size = i + 1, [], 0


def described(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """doc_id, hash of the text, and of its n-gram set: key (null if empty), size, sketch and places in the tries.

    depth: the prefix length at which it is matched. prefixes: for each trie a hash of the shortest prefix in use. deeper: a byte of
    each further value of the signature, the first one highest, so numbers are sorted as signatures are.
    """
    least = prefix_length(threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            for at, texts in _texts(b, "text"):
                sets = shingler.sets(texts)
                full = [s for s in sets if len(s)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sig = signatures(full, DEEPEST * trees) if full else np.zeros((DEEPEST * trees, 0), np.uint32)
                prefix, deeper = np.zeros((trees, len(full)), np.uint64), np.zeros((trees, len(full)), np.int64)
                for t in range(trees):
                    prefix[t] = t + 1
                    for d in range(DEEPEST):
                        value = sig[t * DEEPEST + d].astype(np.uint64)
                        if d < least:
                            prefix[t] = _mixed(prefix[t] * _MIX + value)
                        else:
                            deeper[t] = deeper[t] << 8 | (_mixed(value + _MIX) & np.uint64(255)).astype(np.int64)
                rows = iter(zip(prefix.T.view(np.int64), deeper.T, sketches(sig), strict=True))
                found = [next(rows) if k else None for k in keys]
                depth = [depth_of(len(s), threshold) if len(s) else 0 for s in sets]
                pick = lambda i: [f[i] if f is not None and d else None for f, d in zip(found, depth, strict=True)]  # noqa: E731, B023
                cols = [
                    b.column("doc_id").slice(at, len(texts)), b.column("text_hash").slice(at, len(texts)), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(depth, pa.int32()),
                    pa.array(pick(0), pa.list_(pa.int64())), pa.array(pick(1), pa.list_(pa.int64())), pa.array([None if f is None else f[2].tobytes() for f in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "key", "size", "depth", "prefixes", "deeper", "sketch"])

    cols = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return cols.mapInArrow(run, "doc_id long, text_hash long, key binary, size long, depth int, prefixes array<long>, deeper array<long>, sketch binary")


def _runs(batches: Iterable[pa.RecordBatch], key: str, rows: int, size: int = 16 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that are sorted by ``key``, in tables of whole groups of about so many rows or bytes, and the groups' starts."""
    held: list[pa.RecordBatch] = []
    n = used = 0

    def starts(t: pa.Table) -> np.ndarray:
        v = t.column(key).to_numpy()
        return np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))

    for b in batches:
        held.append(b)
        n, used = n + b.num_rows, used + b.nbytes
        if n >= rows or used >= size:
            t = pa.Table.from_batches(held).combine_chunks()
            at = starts(t)
            if len(at) > 1:
                yield t.slice(0, at[-1]), at[:-1]
                t = t.slice(at[-1]).combine_chunks()
            held, n, used = t.to_batches(), t.num_rows, t.nbytes
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each row is connected with."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def candidate_edges(classes: DataFrame, agree: int, least: int) -> DataFrame:
    """Edges (a, b) that connect classes which share a long enough prefix in a trie and whose sketches agree.

    A trie's members that share the shortest prefix in use are one cell, sorted by the rest of their signatures. Two of them
    share as much as the neighbours between them do, and are compared if that reaches both their depths. A prefix of more than
    CELL classes is split into cells of two parts, so no task holds a hot prefix; a cell yields edges that
    span its agreeing pairs and not the pairs. Sketches travel only with prefixes that classes share.
    """
    places = classes.where("depth > 0").select("class", F.posexplode(F.arrays_zip("prefixes", "deeper")).alias("t", "p")).select("class", F.col("p.prefixes").alias("prefix"), F.col("p.deeper").alias("deeper"))
    counts = places.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = places.join(counts, "prefix").join(classes.select("class", "depth", "sketch"), "class")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    part = F.pmod(F.xxhash64("class"), parts).cast("int")
    partner = F.when(parts > 1, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    cells = shared.select("prefix", "deeper", "class", "depth", "sketch", part.alias("part"), F.explode(partner).alias("other"))
    key = F.xxhash64("prefix", F.least("part", "other"), F.greatest("part", "other"))
    cells = cells.select(key.alias("cell"), "prefix", "deeper", "class", "depth", "sketch")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _runs(batches, "cell", 4096):
            n = t.num_rows
            width = len(t.column("sketch")[0].as_py())
            bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(n, width)
            own, depth, prefix, deeper = (t.column(c).to_numpy() for c in ("class", "depth", "prefix", "deeper"))
            left = np.append(starts[1:], n)[np.searchsorted(starts, np.arange(n), side="right") - 1] - np.arange(n)
            # Values that each row's signature shares with the next one's.
            length = np.where(prefix[1:] == prefix[:-1], least, 0)
            for i in range(DEEPEST - least):
                length += (length == least + i) & (deeper[1:] >> 8 * (DEEPEST - least - 1 - i) == deeper[:-1] >> 8 * (DEEPEST - least - 1 - i))
            common = np.full(n, DEEPEST, np.int64)
            firsts, seconds = [], []
            rows = np.arange(n)
            for step in range(1, int(left.max())):
                rows = rows[left[rows] > step]
                common[rows] = np.minimum(common[rows], length[rows + step - 1])
                meet = rows[common[rows] >= np.maximum(depth[rows], depth[rows + step])]
                hit = meet[agreement(bits[meet], bits[meet + step]) >= agree]
                firsts.append(hit)
                seconds.append(hit + step)
            if not firsts:
                continue
            a, b = np.concatenate(firsts), np.concatenate(seconds)
            label = _least_labels(n, a, b)
            on = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(own[on], pa.int64()), pa.array(own[label[on]], pa.int64())], names=["a", "b"])

    sorted_cells = cells.repartition("cell").sortWithinPartitions("cell", "prefix", "deeper")
    return sorted_cells.mapInArrow(run, "a long, b long").where("a != b").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of some sets, by products of blocks of their incidence matrix."""
    sizes = [len(s) for s in sets]
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = count > 1
    rank = np.cumsum(often) - 1
    on = often[at]
    owner, at = owner[on], rank[at[on]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    total = int(often.sum())
    for lo in range(0, total, 4096):
        i, j = np.searchsorted(at, [lo, lo + 4096])
        block = np.zeros((len(sets), min(4096, total - lo)), np.float32)
        block[owner[i:j], at[i:j] - lo] = 1
        out += block @ block.T
    return out


def gram_sets(texts: DataFrame) -> DataFrame:
    """The columns of ``texts`` with the text's n-gram set, sorted hashes as bytes, in the text's place. Each text is read once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            rest = b.drop_columns(["text"])
            for at, texts in _texts(b, "text"):
                sets = pa.array([s.tobytes() for s in shingler.sets(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rest.slice(at, len(texts)).columns, sets], names=[*rest.schema.names, "grams"])

    kept = [c for c in texts.columns if c != "text"]
    schema = ", ".join(f"{c} {t}" for c, t in texts.select(*kept).dtypes)
    return texts.select(*kept, "text").mapInArrow(run, f"{schema}, grams binary")


def verified_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links of the classes in each group of candidates, by exact Jaccard similarity of their sets.

    members: class, copies, comp, parts (that the group is cut into) and grams. Returns, for a class and a cell that it is in: the
    documents of linked classes there, and a class that it is connected with. A group of one part is one cell, where each set
    is once; larger ones are split into cells of two parts, bounded by rows and bytes. No pair is emitted.
    """
    parts = F.col("parts")
    part = F.pmod(F.xxhash64("class"), parts).cast("int")
    partner = F.when(parts > 1, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    cells = members.select("comp", "class", "copies", "grams", part.alias("part"), F.explode(partner).alias("other"))
    lo, hi = F.least("part", "other"), F.greatest("part", "other")
    cells = cells.select(F.xxhash64("comp", lo, hi).alias("cell"), (lo == hi).alias("within"), "part", "class", "copies", "grams")
    exact = round(threshold * 1000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _runs(batches, "cell", 2 * PART_ROWS):
            found: list[tuple[int, int, int]] = []
            copies, own, within, part = (t.column(c).to_numpy() for c in ("copies", "class", "within", "part"))
            grams = t.column("grams").combine_chunks()
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                sets = [np.frombuffer(grams[i].as_buffer(), np.uint64) for i in range(lo, hi)]
                both = overlaps(sets)
                size = np.array([len(s) for s in sets], np.float64)
                union = size[:, None] + size[None, :] - both
                link = 1000 * both >= exact * union
                np.fill_diagonal(link, False)
                if not within[lo]:
                    link &= part[lo:hi, None] != part[None, lo:hi]
                label = _least_labels(hi - lo, *np.nonzero(link))
                weight = link @ copies[lo:hi]
                found += [(int(own[lo + i]), int(weight[i]), int(own[lo + label[i]])) for i in np.flatnonzero(weight).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["class", "linked", "root"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "class long, linked long, root long")


def joined(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, group (class_id and its text hash) and n_links.

    Documents with equal n-gram sets are one class, of which one member is compared, and their links are
    counted by the class's size. Candidates only say which sets are compared; groups are what verified links connect.
    """
    rows = write_table(described(docs, threshold), "ngram-docs")
    rows = rows.withColumn("class", F.xxhash64("key"))
    full = rows.where(F.col("key").isNotNull())
    one = [F.first(c).alias(c) for c in ("size", "depth", "prefixes", "deeper", "sketch")]
    classes = full.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("first"), *one)
    classes = write_table(classes, "ngram-classes")
    agree = least_agreement(DEEPEST * TREES, threshold, miss)
    comps = write_table(components(candidate_edges(classes, agree, prefix_length(threshold))), "ngram-candidates")
    known = comps.join(classes.select("class", "copies", "first", "size"), F.col("node") == F.col("class"))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum("size") * 8 / PART_BYTES)).cast("int")
    sizes = known.groupBy("root").agg(parts.alias("parts"))
    few_groups = F.broadcast(sizes) if sizes.count() <= FEW else sizes
    picked = known.join(few_groups, "root").select("class", "copies", F.col("root").alias("comp"), "parts", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    picked = write_table(picked, "ngram-picked")
    text = docs.select(F.col("doc_id").cast("bigint").alias("_id2"), F.xxhash64("text").alias("_hash2"), "text")
    on = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))
    few = picked.count() <= FEW
    texts = text.join(F.broadcast(picked) if few else picked, on).select("class", "copies", "comp", "parts", "text")
    # A repeated row has its text here twice; the class is compared once.
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0
    links = write_table(verified_links(gram_sets(texts.dropDuplicates(["class"]) if repeated else texts), threshold), "ngram-links")
    counts = links.groupBy("class").agg(F.sum("linked").alias("linked"))
    groups = components(links.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    named = classes.select("class", "copies", "first").join(counts, "class", "left").join(groups, "class", "left").withColumn("root", F.coalesce("root", "class"))
    heads = named.groupBy("root").agg(F.min("first").alias("group"))
    final = named.join(heads, "root").select("class", "group", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    final = write_table(final, "ngram-groups")
    many = final.where("n_links > 0")
    many = F.broadcast(many) if many.count() <= FEW else many
    out = rows.select("doc_id", "text_hash", "class", "key").join(many, "class", "left")
    return out.select("doc_id", "text_hash", F.coalesce("group", F.struct("doc_id", "text_hash")).alias("group"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def join_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group) and n_links of every document, a row for each row.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity of ``threshold`` or more (held to
    three places); n_links counts a document's links, and groups are what links connect. Words are separated by
    ASCII white space. A text of fewer words is one shingle; null texts and texts without words link with none.
    A repeated row is a copy like any other. Columns other than doc_id and text are not read.
    """
    return joined(docs, threshold).select("doc_id", F.col("group.doc_id").alias("class_id"), "n_links")


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that are linked, directly or not, with one of a smaller id.

    Of repeated rows one stays. All columns stay.
    """
    rows = write_table(joined(docs, threshold), "ngram-joined")
    own = F.struct("doc_id", "text_hash")
    kept_id, text_hash, gone_id, gone_hash = free_names(docs, "_ng_id", "_ng_hash", "_ng_gone", "_ng_gone_hash")
    dropped = rows.where(F.col("group") != own).select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    dropped = write_table(dropped, "ngram-dropped")
    left = docs.withColumns({kept_id: F.col("doc_id").cast("bigint"), text_hash: F.xxhash64("text")})
    on = F.col(kept_id).eqNullSafe(F.col(gone_id)) & (F.col(text_hash) == F.col(gone_hash))
    left = left.join(F.broadcast(dropped) if dropped.count() <= FEW else dropped, on, "left_anti")
    repeated = rows.where("n_links > 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0
    if repeated:
        left = left.dropDuplicates(["doc_id", text_hash])
    return left.select(*docs.columns)
