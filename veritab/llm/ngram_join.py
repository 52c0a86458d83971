"""Near-duplicate join on word shingles by chosen paths: split sets on sampled shared tokens, compare small buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import drop_scratch, join_groups, min_labels, mix64, partitions_for, scratch_since, slices, stage, texts_of

WORDS = 5
THRESHOLD = 0.8
#: Share of linked pairs to find at least, at the threshold: half of the misses are left to the paths, half to the sketches.
RECALL = 0.9999
#: Paths that a set takes on average from each bucket that it is in.
BRANCHING = 2.0
#: Buckets of more sets are split again, up to LEVELS in all; what is larger then is compared in pairs of blocks.
BUCKET = 2048
LEVELS = 4
#: Bits of a set's sketch, one of each minhash; pairs of a bucket whose sketches agree too little are no candidates.
SKETCH = 512
#: Sets, and tokens of the sets, in a block of a cluster, on average.
BLOCK_SETS = 4096
BLOCK_TOKENS = 1 << 21
#: Numbers of sets that are sent to all tasks at most (8 bytes each); more are joined by a shuffle.
MOST_SENT = 500_000

_GOLDEN = 0x9E3779B97F4A7C15


def runs_needed(levels: int = LEVELS, threshold: float = THRESHOLD, branching: float = BRANCHING, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold shares a path with the target probability.

    Two sets share branching * threshold paths a level on average, so by the law of branching processes the chance
    that a shared path is left after a level is p(n + 1) = 1 - exp(-branching * threshold * p(n)).
    """
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-branching * threshold * p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of so many words (lower case, cut at white space).

    A shorter text is one shingle of all its words; a text without words has none.
    """
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
    n = max(1, len(hashes) - words + 1)
    out = np.full(n, len(hashes) if len(hashes) < words else words, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(words, len(hashes))):
            out = mix64(out * np.uint64(_GOLDEN) + hashes[k : k + n])
    return np.unique(out)


def _hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and the number of words of each text."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(sizes.sum())), sizes


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """shingles() of each text, with one pass over the words of all of them."""
    hashes, sizes = _hashed_words(texts)
    out = np.full(max(0, len(hashes) - words + 1), words, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            out = mix64(out * np.uint64(_GOLDEN) + hashes[k : k + len(out)])
    starts = np.cumsum(sizes) - sizes
    return [np.unique(out[a : a + n - words + 1]) if n >= words else shingles(t, words) for t, a, n in zip(texts, starts.tolist(), sizes.tolist(), strict=True)]


def _limit(size: int, branching: float) -> int:
    """Hashes up to this choose a path, so that a set of so many tokens takes `branching` of them on average."""
    return min((1 << 64) - 1, int(branching / size * (1 << 63)) * 2)


def _mixed(tokens: np.ndarray, path: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((tokens ^ np.uint64(path & (1 << 64) - 1)) * np.uint64(_GOLDEN) + np.uint64(1))


def _chosen(tokens: np.ndarray, path: int, branching: float) -> np.ndarray:
    """Paths taken from path: one for each token whose hash with the path is small enough."""
    if not len(tokens):
        return np.empty(0, np.int64)
    mixed = _mixed(tokens, path)
    return mixed[mixed <= np.uint64(_limit(len(tokens), branching))].view(np.int64)


def _root(run: int) -> int:
    return int(mix64(np.array([run + 1], np.uint64))[0])


def _paths(sets: list[np.ndarray], runs: int, branching: float) -> pa.ListArray:
    """The first paths of every set in each run, as a list array."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    limits = np.repeat(np.array([_limit(n, branching) if n else 0 for n in sizes.tolist()], np.uint64), sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)
    owners, paths = [], []
    for r in range(runs):
        mixed = _mixed(flat, _root(r))
        took = np.flatnonzero(mixed <= limits)
        owners.append(owner[took])
        paths.append(mixed[took].view(np.int64))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(sets)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(paths)[order]))


def _set_key(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def _keys(docs: DataFrame, runs: int, branching: float) -> DataFrame:
    """(id, row, set_key, size, paths) of each row; set_key is equal for equal shingle sets, null for no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, texts = batch.column("id"), batch.column("row"), texts_of(batch.column("text"))
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b])
                columns = [ids.slice(a, b - a), rows.slice(a, b - a), pa.array([_set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _paths(sets, runs, branching)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "set_key", "size", "paths"])

    return docs.mapInArrow(run, "id long, row long, set_key binary, size long, paths array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, tokens, sketch, size) of the sets of wanted (rep, row, set_key), from the texts of their rows.

    Tokens are shingles as 64-bit little-endian integers. Texts meet wanted by a sort-merge join at every size; rows
    that repeat an id and text are read once, and a text whose row hash is another's by chance is told by its set_key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, keys, texts = batch.column("rep").to_pylist(), batch.column("set_key").to_pylist(), texts_of(batch.column("text"))
            for a, b in slices(texts):
                got = [(r, s) for r, k, s in zip(reps[a:b], keys[a:b], shingle_sets(texts[a:b]), strict=True) if _set_key(s) == k]
                columns = [pa.array([r for r, _ in got], pa.int64()), pa.array([s.tobytes() for _, s in got], pa.binary()), pa.array([_sketch(s) for _, s in got], pa.binary()), pa.array([len(s) for _, s in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "tokens", "sketch", "size"])

    rows = docs.join(wanted.hint("merge"), "row").groupBy("row", "id", "rep").agg(F.min("set_key").alias("set_key"), F.min("text").alias("text"))
    return rows.select("rep", "set_key", "text").mapInArrow(run, "rep long, tokens binary, sketch binary, size long")


_SEEDS = mix64(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64))
_XORS, _FACTORS = (_SEEDS[:SKETCH] >> np.uint64(32)).astype(np.uint32), (_SEEDS[SKETCH:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def _sketch(tokens: np.ndarray) -> bytes:
    """A bit of the smallest hash under each of SKETCH hash functions."""
    half = (tokens >> np.uint64(32)).astype(np.uint32)
    low = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(half), 256):
        h = half[a : a + 256, None] ^ _XORS[None, :]
        h *= _FACTORS
        h ^= h >> np.uint32(15)
        low = np.minimum(low, h.min(axis=0))
    return np.packbits((low & np.uint32(1)).astype(bool)).tobytes()


def _least_agreement(threshold: float, miss: float) -> int:
    """The most bits of which a pair at the threshold has so many alike but for a chance of miss.

    A bit is alike where the minhashes are, and by chance in half of the other cases: the tail of a binomial.
    """
    p, tail = (1 + threshold) / 2, 0.0
    for m in range(SKETCH + 1):
        tail += math.exp(math.lgamma(SKETCH + 1) - math.lgamma(m + 1) - math.lgamma(SKETCH - m + 1) + m * math.log(p) + (SKETCH - m) * math.log(1 - p))
        if tail > miss:
            return m
    return SKETCH


def _merge(labels: np.ndarray, members: np.ndarray) -> None:
    """Give the classes of members (places) one label, the smallest of theirs."""
    old = np.unique(labels[members])
    if len(old) > 1:
        labels[np.isin(labels, old[1:])] = old[0]


def _grouped(batches: Iterator[pa.RecordBatch], key: str, names: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with one key, of rows sorted by it: one group is held at a time."""
    now, held = None, []
    for batch in batches:
        for k, *row in zip(batch.column(key).to_pylist(), *[batch.column(n).to_pylist() for n in names], strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(row)
    if held:
        yield now, held


def _bits(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, SKETCH // 64)


def _bucket_stars(rows: DataFrame, threshold: float, least: int) -> DataFrame:
    """(a, b): in each bucket of rows (bucket, half, rep, sketch, size), sets that candidate pairs connect, as a star.

    half is null where a bucket is compared with itself; else rows of half 0 are compared with those of half 1. A star
    has one row less than members, however many pairs there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, "bucket", ("rep", "size", "sketch", "half")):
            if len(held) < 2:
                continue
            reps, sizes, sketches, half = zip(*held, strict=True)
            order = np.argsort(np.array(sizes), kind="stable")
            reps, sizes, bits = np.array(reps, np.int64)[order], np.array(sizes, np.int64)[order], _bits(sketches)[order]
            half = np.array([-1 if h is None else h for h in half])[order]
            labels = np.arange(len(reps))
            ends = np.searchsorted(sizes, sizes / threshold + 1e-9, "right")
            for a in range(len(reps) - 1):
                near = np.bitwise_count(bits[a + 1 : ends[a]] ^ bits[a]).sum(axis=1) <= SKETCH - least
                if half[a] >= 0:
                    near &= half[a + 1 : ends[a]] != half[a]
                if near.any():
                    _merge(labels, np.append(np.flatnonzero(near) + a + 1, a))
            tied = np.flatnonzero(labels != np.arange(len(reps)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(reps[labels[tied]]), pa.array(reps[tied])], ["a", "b"])

    n = partitions_for(rows.sparkSession)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def _deeper(rows: DataFrame, sets: DataFrame, branching: float) -> DataFrame:
    """Split rows (bucket, rep): each set takes paths from its bucket by its own tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, rep, tokens in zip(batch.column("bucket").to_pylist(), batch.column("rep").to_pylist(), batch.column("tokens"), strict=True):
                paths = _chosen(np.frombuffer(tokens.as_buffer(), np.uint64), bucket, branching)
                if len(paths):
                    yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(np.full(len(paths), rep, np.int64))], ["bucket", "rep"])

    rows, sets = stage(rows, "large"), sets.select("rep", "tokens")
    wanted = stage(rows.select("rep").distinct(), "wanted")
    if wanted.count() <= MOST_SENT:
        # Sets are nearly all that is written; those of no large bucket stay where they are.
        sets = sets.join(F.broadcast(wanted), "rep", "left_semi")
    return rows.join(sets, "rep").select("bucket", "rep", "tokens").mapInArrow(run, "bucket long, rep long")


def _links_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, root, linked) of rows (block, half, rep, size, copies, tokens): exact links inside each block.

    Every pair whose sizes allow the threshold is verified on whole sets; linked is the number of rows that a set's
    links stand for, root the smallest set that its links connect it to in this block. One row a set, however many links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _grouped(batches, "block", ("rep", "size", "copies", "half", "tokens")):
            if len(held) < 2:
                continue
            held.sort(key=lambda r: r[1])
            reps, sizes, copies = (np.array([r[i] for r in held], np.int64) for i in range(3))
            half = np.array([-1 if r[3] is None else r[3] for r in held])
            words, tokens = np.unique(np.frombuffer(b"".join(r[4] for r in held), np.uint64), return_inverse=True)
            held.clear()
            tokens = tokens.astype(np.int32)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            lasts = np.searchsorted(sizes, sizes / threshold + 1e-9, "right")
            labels, linked, mark = np.arange(len(reps)), np.zeros(len(reps), np.int64), np.zeros(len(words), np.int32)
            for a in range(len(reps) - 1):
                b = lasts[a]
                if b <= a + 1:
                    continue
                own = tokens[starts[a] : ends[a]]
                mark[own] = 1
                # Shared tokens of each set that follows: sums of marks over its tokens.
                both = np.add.reduceat(mark[tokens[ends[a] : ends[b - 1]]], starts[a + 1 : b] - ends[a])
                mark[own] = 0
                near = both >= threshold * (sizes[a] + sizes[a + 1 : b] - both) - 1e-9
                if half[a] >= 0:
                    near &= half[a + 1 : b] != half[a]
                near = np.flatnonzero(near) + a + 1
                if len(near):
                    linked[a] += copies[near].sum()
                    linked[near] += copies[a]
                    _merge(labels, np.append(near, a))
            got = np.flatnonzero(linked)
            if len(got):
                # A class's root is its smallest id.
                low = np.full(len(reps), np.iinfo(np.int64).max)
                np.minimum.at(low, labels, reps)
                yield pa.RecordBatch.from_arrays([pa.array(reps[got]), pa.array(low[labels[got]]), pa.array(linked[got])], ["rep", "root", "linked"])

    n = partitions_for(members.sparkSession)
    return members.repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "rep long, root long, linked long")


def _shared(rows: DataFrame) -> DataFrame:
    """rows (bucket, rep) of buckets with two sets or more, with the bucket's count; a hot bucket is joined by a broadcast."""
    rows = stage(rows, "paths")
    counts = stage(rows.groupBy("bucket").count().filter("count > 1"), "counts")
    return stage(join_groups(rows, counts, "bucket", "count", rows.count()), "buckets")


def links(docs: DataFrame, reps: DataFrame, paths: DataFrame, threshold: float = THRESHOLD, branching: float = BRANCHING, bucket: int = BUCKET, levels: int = LEVELS, miss: float = (1 - RECALL) / 2, used: list[str] | None = None) -> DataFrame:
    """(rep, root, linked) as _links_in_blocks() gives them, for reps (rep, row, set_key, copies) of docs (id, row, text) and their paths (rep, paths).

    used: scratch folders that only paths is read from; they are deleted once the buckets are written. What is made here
    is deleted once the sets that may be linked are known, before whole sets are sent to their blocks.
    """
    mark = len(scratch_since(0))
    rows = _shared(paths.select(F.explode("paths").alias("bucket"), "rep"))
    drop_scratch(docs.sparkSession, [*(used or []), *(p for p in scratch_since(mark) if "/veritab-buckets-" not in p)])
    # Whole texts are read again only for sets that share a bucket.
    wanted = reps.select("rep", "row", "set_key").join(rows.select("rep").distinct(), "rep", "left_semi")
    sets = stage(_sets(docs, wanted), "sets", "uncompressed")
    every = rows.filter(F.col("count") <= bucket).select("bucket", "rep")
    large = rows.filter(F.col("count") > bucket)
    for _ in range(levels - 1):
        if large.isEmpty():
            break
        rows = _shared(_deeper(large.select("bucket", "rep"), sets, branching))
        every = every.unionByName(rows.filter(F.col("count") <= bucket).select("bucket", "rep"))
        large = rows.filter(F.col("count") > bucket)
    sketches = sets.select("rep", "sketch", "size")
    met = every.join(sketches, "rep").withColumn("half", F.lit(None).cast("int"))
    if not large.isEmpty():
        met = met.unionByName(_block_pairs(large.select("bucket", "rep").join(sketches, "rep"), "bucket", ["sketch"], bucket // 2, None))
    stars = _bucket_stars(met, threshold, _least_agreement(threshold, miss))
    # Sets that candidate pairs connect meet once, with their tokens, in blocks of bounded size; one plan at every size.
    clusters = min_labels(stars, "candidates").withColumnsRenamed({"node": "rep", "label": "block"})
    members = stage(clusters.join(sets.select("rep", "size"), "rep").join(reps.select("rep", "copies"), "rep"), "members")
    kept = ("/veritab-sets-", "/veritab-members-")
    drop_scratch(docs.sparkSession, [p for p in scratch_since(mark) if not any(k in p for k in kept)])
    dealt = _block_pairs(members, "block", ["copies"], BLOCK_SETS, BLOCK_TOKENS, threshold)
    return _links_in_blocks(sets.select("rep", "tokens").join(dealt.hint("merge"), "rep"), threshold)


def _block_pairs(rows: DataFrame, key: str, more: list[str], most_sets: int, most_tokens: int | None, threshold: float = THRESHOLD) -> DataFrame:
    """(key, half, rep, size, more...): groups of rows (key, rep, size) cut into blocks, and every two of their sets together in a pair of blocks.

    A group that fits one block is left whole. Others are cut by size class first, each class the threshold's ratio
    wide: only blocks of one class or of neighbours meet, as other sizes can't reach the threshold.
    """

    def blocks(n: Column, tokens: Column) -> Column:
        return F.greatest(F.ceil(n / most_sets), F.ceil(tokens / most_tokens)) if most_tokens else F.ceil(n / most_sets)

    level = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    rows = rows.withColumn("level", level)
    by_level = rows.groupBy(key, "level").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"))
    # A size class a factor of the threshold apart: some dozens at most, whatever the group.
    groups = by_level.groupBy(key).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.collect_list(F.struct("level", blocks(F.col("n"), F.col("tokens")).cast("int").alias("blocks"))).alias("levels"))
    groups = groups.withColumn("whole", blocks(F.col("n"), F.col("tokens")) <= 1)
    dealt = join_groups(rows, groups, key, "n", rows.count())
    own_blocks = F.filter("levels", lambda x: x["level"] == F.col("level"))[0]["blocks"]
    own = F.col("level") * (1 << 20) + F.pmod(F.xxhash64("rep"), own_blocks).cast("int")
    near = F.filter("levels", lambda x: F.abs(x["level"] - F.col("level")) <= 1)
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda b: x["level"] * (1 << 20) + b)))
    met = dealt.filter("NOT whole").withColumn("own", own).withColumn("other", F.explode(others))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    half = F.when(F.col("own") == F.col("other"), F.lit(None).cast("int")).otherwise((F.col("own") > F.col("other")).cast("int"))
    cut = met.select(F.xxhash64(key, low, high).alias(key), half.alias("half"), "rep", "size", *more)
    return dealt.filter("whole").select(key, F.lit(None).cast("int").alias("half"), "rep", "size", *more).unionByName(cut)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id") -> DataFrame:
    """doc_id (or id_col), class_id, n_links of each row of docs (id_col, text).

    Two texts are linked if their sets of five-word shingles (see shingles()) have a Jaccard similarity of the
    threshold or more. n_links counts the other rows that a row is linked to; class_id is the smallest id of the
    connected component (null ids aside). Texts without words (null, empty or blank) are linked to nothing. Rows whose
    shingle sets are equal are one set: they count as links of each other, and no pairs of them are made. Rows are told
    apart by themselves, not by id: repeated and null ids are rows like others. Other columns are not read; an empty
    table gives an empty result.

    Chosen paths: in each run a set takes about BRANCHING of its tokens and goes to the bucket of each; sets of a
    small bucket are compared, large buckets are split again. runs_needed() gives the runs for the target recall.
    Sketches decide which sets of a bucket may be linked, with a bounded chance of a miss that is part of the target;
    all sets that they connect are verified pair by pair on whole sets, in blocks of bounded size. Only stars and
    counts leave a task, so rows grow with the texts and never with their pairs.
    """
    miss = (1 - recall) / 2
    runs = runs_needed(threshold=threshold, recall=1 - miss)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, "text").alias("row"), "text")
    mark = len(scratch_since(0))
    wide = stage(_keys(docs, runs, BRANCHING), "wide")
    total = wide.count()
    sets = wide.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("low"), F.first("paths").alias("paths"))
    # Written with the sets, so a set keeps its number.
    paths = stage(sets.withColumn("rep", F.monotonically_increasing_id()), "wide")
    used = scratch_since(mark)
    # Paths are most of what is written; the rest is kept apart, so that they can go early.
    keys, sets = stage(wide.select("id", "set_key"), "keys"), stage(paths.drop("paths"), "reps")
    found = stage(links(docs, sets.select("rep", "row", "set_key", "copies"), paths.select("rep", "paths"), threshold, miss=miss, used=used), "links")
    degree = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    labels = min_labels(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "near")
    of_set = (
        sets.select("set_key", "rep", "copies", "low")
        .join(degree, "rep", "left")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("set_key", "copies", "low", F.coalesce("label", "rep").alias("label"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    of_set = stage(of_set, "classes")
    classes = of_set.groupBy("label").agg(F.min("low").alias("class_id"), F.count(F.lit(1)).alias("sets"))
    of_set = stage(join_groups(of_set.select("set_key", "copies", "label", "n_links"), classes, "label", "sets", total).select("set_key", "copies", "class_id", "n_links"), "of_set")
    worded = join_groups(keys.filter("set_key IS NOT NULL").select("id", "set_key"), of_set, "set_key", "copies", total)
    bare = keys.filter("set_key IS NULL").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.select("id", "class_id", "n_links").unionByName(bare).withColumnRenamed("id", id_col)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
