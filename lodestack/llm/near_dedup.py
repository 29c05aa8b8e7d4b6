"""Near duplicates by b-bit MinHash.

A document is the set of its k-word shingles. Documents with the same words
are one class; one of each class goes on. Every class gets HASHES minima over
its whole set. Bands of ROWS minima make bucket keys; a link's two ends share a
bucket but for about three in a million at the least similarity. Of the minima
only BITS low bits are kept, packed into longs; counting equal bits, corrected
for bits that are equal by chance, estimates a candidate pair's similarity and
drops the hopeless ones. What is left is confirmed on the full shingle sets.

Buckets are never expanded into all their pairs while that can be avoided.
Twice, each bucket compares its members with one member only, and what is
linked becomes a component; after that, documents are compared only with other
components that still share a bucket with them, in blocks, and each is looked
up in an index of the other component's full shingle sets. A group of thousands
of near copies so costs a few comparisons a member, and no link between
components is lost.
"""

from __future__ import annotations

import gc
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import components, fresh, quoted, read
from .words import mix, text_words

#: Minima of a document; minima of a band and bands: 1 - (1 - 0.8 ** ROWS) ** BANDS is 0.999997.
HASHES, ROWS, BANDS, BITS = 256, 6, 42, 2
#: Words of a shingle and the least similarity in percent, unless a caller says otherwise.
WORDS, PERCENT = 5, 80
#: A pair whose estimate is this far below the least similarity (over five standard deviations) is dropped, unless a set has fewer shingles than SMALL.
MARGIN, SMALL = 0.17, 64
_ODD = (np.random.default_rng(5).integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_BAND = np.random.default_rng(6).integers(0, 1 << 63, ROWS, dtype=np.uint64) | np.uint64(1)
_SPREAD = np.uint32(0x2C1B3C6D)
#: Shingles that are hashed at a time; documents on either side of a block of a bucket; shingles that one task indexes, and that are looked up in one index.
STEP, BLOCK, INDEXED, LOOKED_UP = 512, 1024, 1 << 18, 1 << 20
#: Asking documents that are compared with a block at a time.
ASKING = 64
#: Links whose components one task finds, and ids that are sent to every executor, at most; more go through joins.
FEW_LINKS, FEW_IDS = 1 << 18, 1 << 16
SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>, planes array<long>"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint; files of shuffles that nothing needs any more are removed.

    Spark removes them when the driver's JVM collects garbage, which may be
    after the last step, and once Python has collected its handles of them;
    both here are well under a second. The files behind df itself go with the
    next call.
    """
    out = common.cut(df)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def among(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """rows joined left_semi or left_anti with ids, a checkpoint of one column; where they are few, rows aren't shuffled."""
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    return rows.join(F.broadcast(ids) if few else ids, column, how)


def clusters(links: DataFrame) -> DataFrame:
    """(node, component) of links (a, b), a checkpoint, as by components(); up to FEW_LINKS of them in one task, without shuffles."""
    if links.coalesce(8).count() > FEW_LINKS:
        return components(links)

    def work(batches):
        up = {}

        def root(x):
            while (above := up.setdefault(x, x)) != x:
                up[x] = x = up[above]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])

    return cut(links.select("a", "b").coalesce(1).mapInArrow(work, "node long, component long"))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles of a sequence of word hashes; fewer words are one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        h = mix(h ^ words[j : j + len(h)]) if j == 0 else mix((h << np.uint64(1)) + words[j : j + len(h)])
    return np.unique(h)


def minima(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima over a set of shingle hashes, each under an own permutation of their upper halves.

    A product alone keeps too much of the order and the low bits of small sets
    alike in all permutations; it is folded and multiplied once more.
    """
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), STEP):
        h = x[at : at + STEP, None] * _ODD
        h ^= h >> np.uint32(15)
        h *= _SPREAD
        np.minimum(out, h.min(0), out=out)
    return out


def packed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket keys (n, BANDS), bit planes (n, BITS * HASHES / 64)) of minima (n, HASHES), as signed longs."""
    banded = rows[:, : ROWS * BANDS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = mix((mix(banded) * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    low = rows ^ (rows >> np.uint32(16))
    planes = [np.packbits((low >> np.uint32(b)) & np.uint32(1), axis=1).view(np.int64) for b in range(BITS)]
    return keys.view(np.int64), np.concatenate(planes, axis=1)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """The columns of SIGNATURE for every row of docs (doc_id, text); without words bands and planes are empty."""

    def work(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, n, h, row in text_words(batch.column(1)):
                ends = np.searchsorted(row, np.arange(n + 1))
                counts, digests, rows, full = [], [], [], []
                for i in range(n):
                    words = h[ends[i] : ends[i + 1]]
                    found = shingles(words, k)
                    counts.append(len(found))
                    digests.append(blake2b(words.tobytes(), digest_size=16).digest())
                    if len(found):
                        full.append(i)
                        rows.append(minima(found))
                keys, planes = packed(np.stack(rows)) if rows else (np.zeros((0, BANDS), np.int64), np.zeros((0, BITS * HASHES // 64), np.int64))
                has = np.zeros(n, np.int64)
                has[full] = 1
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * x.shape[1])]).astype(np.int32)), pa.array(x.ravel())) for x in (keys, planes)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), *lists], names=["doc_id", "n_shingles", "digest", "bands", "planes"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(work, SIGNATURE)


def similarity(a: Column, b: Column) -> Column:
    """The estimate from two documents' bit planes, corrected for bits that are equal by chance."""
    half = HASHES // 64
    differ = sum(F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i)).bitwiseOR(F.get(a, half + i).bitwiseXOR(F.get(b, half + i)))) for i in range(half))
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_GAPS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def shingle_set(text: str, k: int) -> frozenset:
    """The full shingle set of a text."""
    words = [w for w in text.translate(_LOWER).translate(_GAPS).split(" ") if w]
    k = min(k, len(words))
    return frozenset(zip(*[words[j:] for j in range(k)], strict=False)) if words else frozenset()


def meet(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """pairs (a, b, salt, ...) with the columns of others (b, ...), which has one row for each b.

    A b that many pairs name is repeated once for each of its salts, so that
    its pairs meet it in as many tasks.
    """
    salted = pairs.select("b", "salt").distinct().join(others, "b")
    return pairs.join(salted, ["b", "salt"])


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, b, salt) whose full shingle sets are similar enough. texts: (doc_id, text) of all ids in pairs."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def work(batches):
        last, last_set = None, frozenset()
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                ta, tb = ta.as_py(), tb.as_py()
                if tb != last:
                    last, last_set = tb, shingle_set(tb, k)
                own = shingle_set(ta, k)
                common = len(own & last_set)
                keep.append(100 * common >= percent * (len(own) + len(last_set) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = meet(pairs.join(a, "a"), b).select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(work, "a long, b long")


def _runs(batches, keys: int):
    """(key values, rows) of consecutive rows with equal first columns, from sorted batches; a key may come in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for at, end in zip([0, *changes.tolist()], [*changes.tolist(), batch.num_rows], strict=True):
            yield tuple(int(c[at]) for c in columns), batch.slice(at, end - at)


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    """rows (by, asks, doc_id, blocks, parts, ...) with block and part, for a comparison of all that don't ask with all that do and share `by`.

    A row that doesn't ask is in one block and goes to all parts, one that asks
    is in one part and goes to all blocks, so that both sides of a (block, part)
    are bounded whatever the size of a group.
    """
    one = lambda n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n)).cast("int")
    here = F.col("asks") == 0
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(here, F.col("parts")).otherwise(F.col("blocks")) - 1)))
    return rows.withColumn("block", F.when(here, one("blocks", 0)).otherwise(F.col("_copy"))).withColumn("part", F.when(here, F.col("_copy")).otherwise(one("parts", 1)))


def _in_order(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    return rows.select(by, "block", "part", "asks", *columns).repartition(by, "block", "part").sortWithinPartitions(by, "block", "part", "asks")


def contenders(members: DataFrame, planes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, rival, n_shingles): documents that share a bucket with a document of another component that may be similar enough.

    members: (key, doc_id, label). In each bucket the documents outside its
    most frequent component are compared with all the others, in blocks of
    about BLOCK documents of either side. A task holds one block's members and
    lets those who ask pass by.
    """
    by_label = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    sizes = by_label.groupBy("key").agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.max_by("label", F.struct("n", "label")).alias("major"))
    sizes = sizes.select("key", "major", F.expr(f"cast(total div {BLOCK} + 1 as int)").alias("blocks"), F.expr(f"cast((total - most) div {BLOCK} + 1 as int)").alias("parts"))
    # With their planes before they are dealt, so that the join makes a row a member.
    rows = members.join(sizes, "key").join(planes, "doc_id")
    rows = rows.withColumn("asks", F.explode(F.when(F.col("label") == F.col("major"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    dealt = _in_order(_dealt(rows, "key"), "key", "doc_id", "label", "major", "n_shingles", "planes")
    half, chance = HASHES // 64, 2.0**-BITS
    # The estimate is at least `least` where at most this many of the minima differ.
    most = int(HASHES * (1 - chance - (percent / 100 - MARGIN) * (1 - chance)) + 1e-9)

    def columns(rows):
        ids, labels, major, n = (rows.column(c).to_numpy() for c in ("doc_id", "label", "major", "n_shingles"))
        planes = rows.column("planes")
        planes = planes.combine_chunks() if isinstance(planes, pa.ChunkedArray) else planes
        return ids, labels, major, n, np.asarray(planes.flatten()).reshape(len(ids), -1).view(np.uint64)

    def block_of(held):
        ids, labels, major, n, bits = columns(pa.Table.from_batches(held))
        # By component, so that each one's answers to an asking document fold into one.
        order = np.argsort(labels, kind="stable")
        labels = labels[order]
        return labels, major[order], n[order], bits[order], np.flatnonzero(np.diff(labels, prepend=labels[0] - 1))

    def work(batches):
        now, held, there = None, [], None
        for (*group, asks), rows in _runs(batches, 4):
            if group != now:
                now, held, there = group, [], None
            if not asks:
                held.append(rows)
                continue
            if not held:
                continue
            there = there or block_of(held)
            labels, major, n, bits, firsts = there
            ids, own_labels, _, own_n, own_bits = columns(rows)
            for at in range(0, len(ids), ASKING):
                some = slice(at, at + ASKING)
                differ = np.zeros((len(ids[some]), len(labels)), np.uint16)
                for i in range(half):
                    differ += np.bitwise_count((own_bits[some, i, None] ^ bits[:, i]) | (own_bits[some, half + i, None] ^ bits[:, half + i]))
                a, b, label = own_n[some, None], n, own_labels[some, None]
                near = (differ <= most) | (np.minimum(a, b) < SMALL)
                near &= (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent) & (label != labels)
                # Of two components outside the most frequent one, the lower asks.
                near &= (labels == major) | (label < labels)
                x, y = np.nonzero(np.logical_or.reduceat(near, firsts, axis=1))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some][x]), pa.array(labels[firsts[y]]), pa.array(own_n[some][x])], names=["doc_id", "rival", "n_shingles"])

    return dealt.mapInArrow(work, "doc_id long, rival long, n_shingles long").distinct()


def first_links(asked: DataFrame, labels: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): for every (doc_id, rival, n_shingles) asked a link to some document of that component, if there is any.

    labels: (doc_id, label, n_shingles) of all nodes. The full shingle sets of a
    component's documents are indexed by shingle, and the sizes of their
    intersections with an asking document's set are counted. A component is
    dealt over blocks of about INDEXED shingles and those who ask over parts of
    about LOOKED_UP shingles. A task holds one block's index and one asking
    document at a time.
    """
    rivals = asked.select("rival").distinct()
    there = labels.select("doc_id", F.col("label").alias("rival"), "n_shingles").join(rivals, "rival", "left_semi")
    blocks = there.groupBy("rival").agg(F.expr(f"cast(sum(n_shingles) div {INDEXED} + 1 as int)").alias("blocks"))
    parts = asked.groupBy("rival").agg(F.expr(f"cast(sum(n_shingles) div {LOOKED_UP} + 1 as int)").alias("parts"))
    rows = there.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1))).drop("n_shingles")
    rows = rows.join(texts, "doc_id").join(blocks.join(parts, "rival"), "rival")
    rows = _in_order(_dealt(rows, "rival"), "rival", "doc_id", "text")

    def work(batches):
        now, index, ids, sizes = None, {}, [], []
        for (*group, asks), rows in _runs(batches, 4):
            if group != now:
                now, index, ids, sizes = group, {}, [], []
            out = []
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
                own = shingle_set(text.as_py(), k)
                if not asks:
                    for g in own:
                        index.setdefault(g, []).append(len(ids))
                    ids.append(doc_id)
                    sizes.append(len(own))
                    continue
                hits = [index[g] for g in own if g in index]
                if hits:
                    common = np.bincount(np.concatenate([np.asarray(h) for h in hits]), minlength=len(ids))
                    linked = np.flatnonzero(100 * common >= percent * (len(own) + np.asarray(sizes) - common))
                    if len(linked):
                        out.append((doc_id, ids[int(linked[0])]))
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(work, "a long, b long")


def buckets(keyed: DataFrame) -> DataFrame:
    """(key, doc_id, low, high, salts) of the buckets keyed (key, doc_id), dealt by key, that hold several documents.

    low and high are a bucket's least and greatest document, salts counts its
    blocks. Near copies share many bands, so that many buckets have the same
    documents; of those one stays, as all of them pose the same pairs. They are
    told by their number, ends, and two hashes of their documents, 128 bits.
    """
    keyed = keyed.distinct()
    marks = [F.bit_xor(F.xxhash64("doc_id", F.lit(salt))).alias(f"_mark{salt}") for salt in range(2)]
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("_n"), *marks).where("low <> high")
    one = shared.groupBy("low", "high", "_n", "_mark0", "_mark1").agg(F.min("key").alias("key"))
    return keyed.join(one.select("key", "low", "high", F.expr(f"_n div {BLOCK} + 1").alias("salts")), "key")


def groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own
    included. Rows without words (null and empty texts) are linked with
    nothing. A null doc_id is null in component_id and links with nothing.
    Repeated rows each get their row; rows that share a doc_id are one node.
    Other columns are left out; an empty table gives an empty result.

    Shuffled are bucket keys, packed signatures, and the texts of documents
    that share a bucket with another class. Nothing is collected.
    """
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    rows = cut(signatures(texts, k))
    full = rows.where("doc_id is not null and n_shingles > 0")
    classes = cut(full.groupBy("digest").agg(F.min("doc_id").alias("head")))
    heads = cut(full.join(classes, "digest").where("doc_id = head").select("doc_id", "n_shingles", "bands", "planes"))
    keyed = heads.select("doc_id", F.explode("bands").alias("key")).where("key is not null").repartition("key")
    members = cut(buckets(keyed))
    nodes = cut(members.select("doc_id").distinct())
    planes = cut(among(heads.select("doc_id", "n_shingles", "planes"), nodes, "doc_id", "left_semi"))
    near = cut(among(texts.where("doc_id is not null and text is not null"), nodes, "doc_id", "left_semi"))
    least = percent / 100 - MARGIN

    def likely(pairs: DataFrame) -> DataFrame:
        one = planes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("planes").alias("pa"))
        two = planes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("planes").alias("pb"))
        close = (similarity(F.col("pa"), F.col("pb")) >= least) | (F.least("na", "nb") < SMALL)
        kept = meet(pairs.join(one, "a"), two).where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & close)
        return kept.select("a", "b", "salt")

    def salted(a: Column, b: Column, rows: DataFrame) -> DataFrame:
        """Distinct (a, b, salt): a bucket's pairs with one member have a salt for every BLOCK of its documents."""
        pairs = rows.select(a.alias("a"), b.alias("b"), "salts").groupBy("a", "b").agg(F.max("salts").alias("salts"))
        return pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))

    def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(labels, the members of buckets in which several components meet, with their label)."""
        labels = clusters(links)
        own = members.join(labels.select(F.col("node").alias("doc_id"), F.col("component").alias("_label")), "doc_id", "left").withColumn("label", F.coalesce("_label", "doc_id")).drop("_label")
        mixed = own.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("key")
        return labels, cut(own.join(mixed, "key", "left_semi"))

    links = cut(confirmed(likely(salted(F.col("doc_id"), F.col("low"), members.where("doc_id <> low"))), near, k, percent))
    _, open_ = labelled(links)
    top = open_.where("doc_id = high").select("key", F.col("label").alias("_top")).distinct()
    pairs = salted(F.col("doc_id"), F.col("high"), open_.join(top, "key").where("label <> _top"))
    links = cut(links.union(confirmed(likely(pairs), near, k, percent)))
    labels, open_ = labelled(links)
    asked = cut(contenders(open_.select("key", "doc_id", "label"), planes, percent))
    of_node = planes.select("doc_id", "n_shingles").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("label"))
    links = cut(links.union(first_links(asked, of_node, near, k, percent)))
    labels = clusters(links)
    heads_of = classes.join(labels.select(F.col("node").alias("head"), "component"), "head", "left").select("digest", F.coalesce("component", "head").alias("_component"))
    out = rows.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(heads_of, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group, the one of the smallest doc_id, with all its columns.

    Of repeated rows one stays, as they are copies of each other. Rows without
    words and rows with a null doc_id all stay. Where rows share a doc_id, each
    is a document of its own, and of those in one group the first by
    (doc_id, text) stays.
    """
    known = docs.where("doc_id is not null")
    unique = known.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").isEmpty()
    name = fresh(docs, "kept_id")
    if unique:
        rows = known.withColumn(name, F.col("doc_id").cast("long"))
    else:  # numbers in the order of (doc_id, text); the checkpoint holds them still
        rows = cut(known.orderBy("doc_id", "text").withColumn(name, F.monotonically_increasing_id()))
    gone = groups(rows.select(F.col(name).alias("doc_id"), "text"), k, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(name))
    return among(rows, cut(gone), name, "left_anti").select(*[quoted(c) for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def op8_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents on 2-word shingles: doc_id, n_shingles, component_id, kept."""
    out = groups(read(spark, sf_dir, "documents").select("doc_id", "text"), 2, 80)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All four columns, by comparing every pair that shares a shingle.
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE len(ws) WHEN 0 THEN [] WHEN 1 THEN ws ELSE list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS n, doc_id AS m FROM s UNION SELECT r.n, e.b FROM reach r JOIN edges e ON e.a = r.m),
c AS (SELECT n AS doc_id, min(m) AS component_id FROM reach GROUP BY n)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""
