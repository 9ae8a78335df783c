"""N-gram Jaccard join: exact self-join of word-shingle sets at a Jaccard of 0.8 or more, by universe partition.

Sets are compared within bands of set size: a set of at most M shingles differs from a partner of its band or the
band below in at most H = floor(2M/9) shingles. The universe of shingles is hashed into groups of segments per band.
With H//2 + 1 + 2d groups, at least 1 + 2d of them differ in one shingle at most. A group is indexed so that one
difference does no harm: in small bands by the group itself and all its one-deletion neighbours, in larger ones by the
subsets of two of its three segments. Each set leaves out the d groups that would cost most, which keeps at least one
common group for every pair: the cost of a group is how frequent its least selective subset is (an empty one is in
every set; a frequent passage fills others), estimated from shingle frequencies in a bounded sample of sets. The sample
decides about cost only, never about results.

Subsets that collide make candidates; a parity bitmap, whose Hamming distance never exceeds the set difference, drops
most false ones; the others are verified on the whole shingle sets.

Equal sets are one class from the start, known by a 64-bit hash of the set: among N distinct sets about N^2 / 2^65 pairs
are taken for equal by chance (0.03 among 10^9). Classes, not ids, are linked; an id that occurs with several texts links
their classes. Small collision groups give all their pairs; of large ones, first a star is
verified, whose centre is the member that meets most others over all buckets, then for each member the closest ones of other components, then every pair that still lies in different
components. So no link between components is lost while a large group of near copies isn't expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, mix64, release, shingle_sets, shuffle_partitions, trimmed, trimmed_group

#: Jaccard threshold as a fraction: 100 * intersection >= 80 * union.
NUM, DEN = 4, 5
SMALL_GROUP = 4
BLOCK_ROWS = 1024
SAMPLE_SETS, MOST_FREQUENT = 4000, 16_384
CLOSEST = 4
#: One in so many large groups is looked through first; what they link needn't be looked at in the others.
EARLY_GROUPS = 8
SIZE_STEPS = 1600
MOST_APART = int(np.log2(DEN / NUM) * SIZE_STEPS) + 1
#: Ids that are broadcast at most (8 bytes each); a share of the rows that makes a class hot, as its inverse.
MOST_BROADCAST, HOT_CLASSES = 2_000_000, 500
BATCH_DOCS = 1000


def band_tops(limit: int) -> list[int]:
    """Largest set size of each band: a partner of a set in one band is in the same band or the next."""
    tops = [4]
    while tops[-1] < limit:
        tops.append(tops[-1] * DEN // NUM)
    return tops


def allocation(top: int) -> tuple[int, int, int]:
    """(segments per group, groups, groups left out) for a band of sets of at most `top` shingles; 1: by deletion."""
    h = 2 * top * (DEN - NUM) // (DEN + NUM)
    if h <= 4:
        return 1, h // 2 + 1, 0
    d = max(2, h // 10)
    return 3, h // 2 + 1 + 2 * d, d


_TOPS = band_tops(1 << 40)
_ALLOCATION = [allocation(t) for t in _TOPS]


def _sums(values: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """Sums modulo 2**64 by cell; three parts of the bits are summed as exact floats."""
    out = np.zeros(cells, np.uint64)
    for shift, width in ((0, 22), (22, 21), (43, 21)):
        part = ((values >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(float)
        out += np.bincount(cell, part, cells).astype(np.uint64) << np.uint64(shift)
    return out


def _band_signatures(b: int, sets: list[np.ndarray], frequency: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, position of their set) of sets that are compared in band b."""
    parts, m, d = _ALLOCATION[b]
    k, width = len(sets), m * parts
    salt = np.uint64(b * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    own = np.repeat(np.arange(k), [len(s) for s in sets])
    mixed = mix64(np.concatenate(sets) ^ salt)
    cell = own * width + ((mixed >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)
    total = _sums(mixed, cell, k * width)
    if parts == 1:
        tag = np.tile(mix64(np.arange(m, dtype=np.uint64) + salt), k)
        return np.concatenate([mix64(total ^ tag), mix64((total[cell] - mixed) ^ tag[cell])]), np.concatenate([np.repeat(np.arange(k), m), own])
    size = np.bincount(cell, minlength=k * width)
    common = np.ones(k * width)
    np.minimum.at(common, cell, np.concatenate(frequency))
    # A subset is as frequent as its rarer segment, so the worst of three subsets is the middle segment; of equal ones
    # the smaller counts, and the rest is decided by content, so that equal groups rank alike in both sets.
    cost = np.sort(common.reshape(k, m, 3), axis=2)[:, :, 1]
    room = -np.sort(size.reshape(k, m, 3), axis=2)[:, :, :2].sum(axis=2)
    total = total.reshape(k, m, 3)
    keep = np.lexsort((total[:, :, 0], room, cost), axis=1)[:, : m - d]
    t = mix64(total ^ np.arange(3, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    t = np.take_along_axis(t, keep[:, :, None], axis=1)
    pairs = t + np.roll(t, -1, axis=2)
    tag = mix64(keep.astype(np.uint64) * np.uint64(3) + salt)[:, :, None] + np.arange(3, dtype=np.uint64)
    return mix64(pairs + tag).reshape(-1), np.repeat(np.arange(k), (m - d) * 3)


def signatures(sets: list[np.ndarray], frequency: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit signatures, position of their set): each set in its own band and in the next one, where it is the
    smaller partner."""
    bands = np.searchsorted(_TOPS, [len(s) for s in sets])
    sigs, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for b in np.unique(np.concatenate([bands, bands + 1])):
        at = np.flatnonzero((bands == b) | (bands + 1 == b))
        g, own = _band_signatures(int(b), [sets[i] for i in at], [frequency[i] for i in at])
        sigs.append(g), owner.append(at[own])
    return np.concatenate(sigs), np.concatenate(owner)


def parity_bits(shingles: np.ndarray) -> bytes:
    """Bitmap of a power-of-two width of at least 2n bits; each bit is the parity of the shingles hashed to it."""
    width = 64
    while width < 2 * len(shingles):
        width *= 2
    at = (shingles & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width) & 1, bitorder="little").tobytes()


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) > width:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def set_key(shingles: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


def _summary(texts: pd.Series) -> pd.DataFrame:
    sets = shingle_sets(texts)
    return pd.DataFrame({"n": np.array([len(s) for s in sets], np.int64), "key": np.array([set_key(s) for s in sets], np.int64)})


def _counted(batches):
    """(shingle, sets of the sample with it), summed over the batch."""
    for pdf in batches:
        values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_sets(pdf["text"])]), return_counts=True)
        yield pd.DataFrame({"shingle": values.view(np.int64), "n": counts})


def _shingled(batches):
    for pdf in batches:
        sets = shingle_sets(pdf["text"])
        yield pd.DataFrame({"key": np.array([set_key(x) for x in sets], np.int64), "n": np.array([len(x) for x in sets], np.int64), "bits": [parity_bits(x) for x in sets], "shingles": [x.tobytes() for x in sets]})


def _dealt(buckets: int, hot: np.ndarray, hot_share: np.ndarray):
    """One row per batch and bucket: the signatures of the batch that fall to the bucket, packed."""

    def run(batches):
        seen: set[int] = set()

        def packed(ids, sets):
            at = [np.minimum(np.searchsorted(hot, s), len(hot) - 1) for s in sets]
            sig, own = signatures(sets, [np.where(hot[i] == s, hot_share[i], 0.0) for i, s in zip(at, sets)])
            bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sig, own, bucket = sig[order].astype(np.uint32), own[order], bucket[order]
            ids, sizes = np.array(ids, np.int64), size_code(np.array([len(s) for s in sets]))
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            rows = []
            for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
                docs, local = np.unique(own[lo:hi], return_inverse=True)
                rows.append((int(bucket[lo]), sig[lo:hi].tobytes(), local.astype(np.uint16).tobytes(), ids[docs].tobytes(), sizes[docs].tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "sig", "local", "ids", "sizes"])

        ids, sets, held = [], [], 0
        for pdf in batches:
            for s in shingle_sets(pdf["text"]):
                if len(s) < NUM:
                    continue  # such a small set links with equal sets only
                i = set_key(s)
                if i in seen:
                    continue  # a copy in this task; copies are one class already
                if len(seen) < 500_000:
                    seen.add(i)
                ids.append(i), sets.append(s)
                held += len(s)
                if len(ids) >= BATCH_DOCS or held > 500_000:
                    yield packed(ids, sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield packed(ids, sets)

    return run


def size_code(n: np.ndarray) -> np.ndarray:
    """A set's size on a logarithmic scale; codes of sets that may link differ by MOST_APART at most."""
    return (np.log2(n) * SIZE_STEPS).astype(np.uint16)


def _collisions(pdf: pd.DataFrame, stars: bool = True) -> pd.DataFrame:
    """Candidates of one bucket: all pairs of small groups, the members and their sizes of larger ones (once per set of
    members), and stars of these, as far as one bucket tells the centre; the join over many buckets has _starred do it."""
    base, sig, idx, ids, sizes = 0, [], [], [], []
    for s, l, d, n in zip(pdf["sig"], pdf["local"], pdf["ids"], pdf["sizes"]):
        d = np.frombuffer(d, np.int64)
        sig.append(np.frombuffer(s, np.uint32))
        idx.append(np.frombuffer(l, np.uint16).astype(np.int32) + np.int32(base))
        ids.append(d), sizes.append(np.frombuffer(n, np.uint16))
        base += len(d)
    # Most signatures occur once; they go before anything else is done.
    both = np.concatenate(sig).astype(np.uint64) << np.uint64(32) | np.concatenate(idx).astype(np.uint64)
    both.sort()
    same = both[1:] >> np.uint64(32) == both[:-1] >> np.uint64(32)
    both = both[np.append(False, same) | np.append(same, False)]
    del sig, idx, same
    place = (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ids, rank = np.unique(np.concatenate(ids)[place], return_inverse=True)
    size = np.zeros(len(ids), np.int64)
    size[rank] = np.concatenate(sizes)[place]
    both = np.unique(both >> np.uint64(32) << np.uint64(32) | rank.astype(np.uint64))

    def grouped():
        s, doc = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.diff(s, prepend=-1))
        length = np.diff(np.append(start, len(s)))
        return s, doc, start, length, np.repeat(np.arange(len(start)), length)

    # Members are ranked by how many others they meet in the bucket: the first of a group, its star's centre, is likely
    # the text that its others were made from, wherever that one stands in the table.
    s, doc, start, length, group = grouped()
    order = np.lexsort((ids, -np.bincount(doc, length[group] - 1, len(ids))))
    ids, size = ids[order], size[order]
    both = np.sort(both >> np.uint64(32) << np.uint64(32) | np.argsort(order)[doc].astype(np.uint64))
    s, doc, start, length, group = grouped()
    g = length[group]
    pairs = []
    for d in range(1, SMALL_GROUP):
        k = np.flatnonzero((g[:-d] <= SMALL_GROUP) & (s[:-d] == s[d:])) if len(s) > d else np.empty(0, np.int64)
        pairs.append(doc[k] << 32 | doc[k + d])
    big = np.flatnonzero(g > SMALL_GROUP)
    if stars:
        pivot = doc[start[group[big]]]
        pairs.append((pivot << 32 | doc[big])[pivot != doc[big]])
    p = np.unique(np.concatenate(pairs))
    a, b = p >> 32, p & 0xFFFFFFFF
    ok = np.abs(size[a] - size[b]) <= MOST_APART
    a, b = np.minimum(ids[a[ok]], ids[b[ok]]), np.maximum(ids[a[ok]], ids[b[ok]])
    # Large groups, packed; of groups with the same members one is enough.
    first = start[length > SMALL_GROUP]
    groups = {}
    for lo, hi in zip(first, first + length[length > SMALL_GROUP]):
        at = doc[lo:hi][np.argsort(ids[doc[lo:hi]])]
        groups[ids[at].tobytes()] = size[at].astype(np.uint16).tobytes()
    none = np.zeros(len(groups), np.int64)
    # A large group's number, in place of a pair, is a hash of its members.
    number = np.array([xxhash.xxh64_intdigest(m) >> 1 for m in groups], np.int64)
    return pd.DataFrame({"a": np.concatenate([a, number]), "b": np.concatenate([b, none]), "members": [*[None] * len(a), *groups], "sizes": [*[None] * len(a), *groups.values()]})


def _unpacked(batches):
    """(group, id, how many others it meets there) of each member."""
    for pdf in batches:
        lists = [np.frombuffer(m, np.int64) for m in pdf["members"]]
        g = np.array([len(x) for x in lists], np.int64)
        yield pd.DataFrame({"sig": np.repeat(pdf["sig"].to_numpy(), g), "id": np.concatenate([np.empty(0, np.int64), *lists]), "meets": np.repeat(g - 1, g)})


def _starred(batches):
    """(member, centre, centre's rank) of each group, as far as their sizes allow a link."""
    for pdf in batches:
        parts, centres, ranks = [np.empty(0, np.int64)], pdf["centre"].to_numpy(), pdf["rank"].to_numpy()
        for m, n, centre in zip(pdf["members"], pdf["sizes"], centres):
            m, n = np.frombuffer(m, np.int64), np.frombuffer(n, np.uint16).astype(np.int64)
            parts.append(m[(np.abs(n - n[m == centre][0]) <= MOST_APART) & (m != centre)])
        g = [len(x) for x in parts[1:]]
        yield pd.DataFrame({"id": np.concatenate(parts), "centre": np.repeat(centres, g), "rank": np.repeat(ranks, g)})


def _pairs(side: np.ndarray, split: bool, ok) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a cell: all of one block, or across its two blocks."""
    if split:
        i, j = np.meshgrid(np.flatnonzero(side), np.flatnonzero(~side), indexing="ij")
        i, j = i.reshape(-1), j.reshape(-1)
    else:
        i, j = np.triu_indices(len(side), 1)
    keep = ok(i, j)
    return i[keep], j[keep]


def _across(most: int | None):
    """Pairs of members in different components whose sizes and bitmaps allow a link: all, or for each member of a cell
    the `most` closest; a row (group, -1), its larger number first, says that a group has more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, more = [], set()
        for _, g in pdf.groupby("cell", sort=False):
            ids, n, comp, own = (g[c].to_numpy() for c in ("id", "n", "component", "own"))
            bits = [np.frombuffer(x, np.uint64) for x in g["bits"]]
            width = min(map(len, bits))
            rows = np.stack([_fold(x, width) for x in bits])
            i, j = _pairs(own == own.min(), bool(g["split"].iloc[0]), lambda i, j: (comp[i] != comp[j]) & (NUM * np.maximum(n[i], n[j]) <= DEN * np.minimum(n[i], n[j])))  # noqa: B023
            step = max(1, 2_000_000 // width)
            far = np.concatenate([np.empty(0, np.int64), *(np.bitwise_count(rows[i[k : k + step]] ^ rows[j[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(i), step))])
            fits = far * (DEN + NUM) <= (n[i] + n[j]) * (DEN - NUM)
            i, j, far = i[fits], j[fits], far[fits]
            if most is not None and len(i) > most:
                order = np.argsort(far, kind="stable")
                i, j = i[order], j[order]
                keep = np.zeros(len(i), bool)
                for end in (i, j):
                    by = np.argsort(end, kind="stable")
                    first = np.searchsorted(end[by], end[by])
                    keep[by[np.arange(len(by)) - first < most]] = True
                if not keep.all():
                    more.add(int(g["sig"].iloc[0]))
                i, j = i[keep], j[keep]
            found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1))
        out = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found, *(np.array([[x, -1]]) for x in more)]), axis=0)
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _verified(batches):
    """Pairs whose sets reach the threshold; parity bitmaps, where they differ too much, settle most others."""
    for pdf in batches:
        keep = np.zeros(len(pdf), bool)
        for i, (x, y) in enumerate(zip(pdf["set_a"], pdf["set_b"])):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if NUM * max(len(x), len(y)) <= DEN * min(len(x), len(y)):
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = common * DEN >= NUM * (len(both) - common)
        yield pdf.loc[keep, ["a", "b"]]


def _near(batches):
    """Pairs whose parity bitmaps differ in no more bits than the sets may."""
    for pdf in batches:
        keep = np.zeros(len(pdf), bool)
        for i, (x, y, n, m) in enumerate(zip(pdf["bits_a"], pdf["bits_b"], pdf["n_a"], pdf["n_b"])):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            w = min(len(x), len(y))
            keep[i] = NUM * max(n, m) <= DEN * min(n, m) and int(np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum()) * (DEN + NUM) <= (n + m) * (DEN - NUM)
        yield pdf.loc[keep, ["a", "b"]]


def _links(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b), those whose whole shingle sets reach the threshold. Pairs whose bitmaps rule a link out go first."""
    small = sets.select("key", "n", "bits")
    near = near.join(small.toDF("a", "n_a", "bits_a"), "a").join(small.toDF("b", "n_b", "bits_b"), "b").mapInPandas(trimmed(_near), "a long, b long")
    near = materialize(near)
    # Whole sets move only where a pair is left that asks for them.
    asked = materialize(near.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    few = asked.count() <= MOST_BROADCAST
    whole = sets.select("key", "shingles").join(F.broadcast(asked) if few else asked, "key", "left_semi")
    return materialize(near.join(whole.toDF("a", "set_a"), "a").join(whole.toDF("b", "set_b"), "b").mapInPandas(trimmed(_verified), "a long, b long"))


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, share of sets) of the most frequent shingles of at most SAMPLE_SETS texts, lowest hashes first."""
    h = F.xxhash64("text")
    some = texts.filter("text is not null").select(h.alias("h")).distinct().orderBy("h").limit(SAMPLE_SETS)
    last = some.agg(F.max("h").alias("h")).first().h
    if last is None:
        return np.zeros(1, np.uint64), np.zeros(1)
    sample = texts.filter("text is not null").filter(h <= last).dropDuplicates(["text"])
    counts = sample.mapInPandas(trimmed(_counted), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.filter("n >= 3").orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toPandas()
    if top.empty:
        return np.zeros(1, np.uint64), np.zeros(1)
    hot = top["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], top["n"].to_numpy(float)[order] / SAMPLE_SETS


def _cells(groups: DataFrame, part: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """Members of the groups that span components, dealt into cells of at most two blocks of BLOCK_ROWS members or so."""
    g = groups.join(part.toDF("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = g.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("g")).filter("lo != hi")
    g = g.join(mixed.select("sig", F.ceil(F.col("g") / BLOCK_ROWS).cast("int").alias("k")), "sig").join(sets.select(F.col("key").alias("id"), "n", "bits"), "id")
    own = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    g = g.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cell = F.xxhash64("sig", F.least("own", "with"), F.greatest("own", "with"))
    g = g.select("sig", "id", "component", "n", "bits", "own", (F.col("own") != F.col("with")).alias("split"), cell.alias("cell"))
    return g.withColumn("bucket", F.pmod("cell", F.lit(4 * buckets)))


def _joined_keys(live: DataFrame) -> DataFrame:
    """(a, b): classes that share an id, as edges to the least class of the id."""
    several = live.groupBy("id").agg(F.min("key").alias("b"), F.max("key").alias("hi")).filter("b != hi").select("id", "b")
    return live.select("id", F.col("key").alias("a")).distinct().join(several, "id").filter("a != b").select("a", "b").distinct()


def _spread(info: DataFrame, of_class: DataFrame) -> DataFrame:
    """info with component_id from of_class (key, component_id), null where it has none.

    Classes that hold more than a five-hundredth of the rows (at most 500) are looked up by broadcast, so that no task
    gets all copies of a text; the others are joined by key.
    """
    total = info.count()
    hot = F.broadcast(info.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") * HOT_CLASSES > total).join(of_class, "key", "left").select("key", F.lit(True).alias("hot"), F.col("component_id").alias("own")))
    told = info.join(hot, "key", "left")
    rest = told.filter("hot is null").drop("hot", "own").join(of_class, "key", "left").select("id", "n", "component_id")
    return rest.union(told.filter("hot").select("id", "n", F.col("own").alias("component_id")))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: id_col, n_shingles (long), component_id (long).

    component_id is the smallest id reachable over links, the row's own included. Null and empty texts have no
    shingles, link with nothing and keep their own id. Sets of fewer than four shingles link with equal sets only
    (one differing shingle already falls below 0.8); one of four also links with one of five that holds it. Rows that
    repeat an id are one document of several texts: each comes back with its own n_shingles, and whatever links with one
    of the texts is in the component of all. Rows with a null id come back with a null component and link nothing. Other
    columns, whatever their names, are left alone. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    summary = F.pandas_udf(trimmed_group(_summary), "n long, key long")
    info = materialize(texts.select("id", summary("text").alias("s")).select("id", "s.*"))
    live = info.filter("n > 0 and id is not null")
    # Signatures take about 3 bytes a shingle, so that many go into one bucket as fill bucket_bytes.
    buckets = max(shuffle_partitions(spark), int((live.agg(F.sum("n").alias("n")).first().n or 0) * 3 // bucket_bytes) + 1)
    hot, share = _frequent(texts)
    dealt = texts.filter("id is not null and text is not null").mapInPandas(trimmed(_dealt(buckets, hot, share)), "bucket long, sig binary, local binary, ids binary, sizes binary")
    collisions = trimmed_group(lambda pdf: _collisions(pdf, stars=False))
    hits = materialize(dealt.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(collisions, "a long, b long, members binary, sizes binary"))

    packed = materialize(hits.filter("members is not null").select(F.col("a").alias("sig"), "members", "sizes").dropDuplicates(["sig"]))
    groups = materialize(packed.mapInPandas(trimmed(_unpacked), "sig long, id long, meets long"))
    # Members are ranked over all buckets, so a text that others were made from is the centre of each group that holds it.
    # A member is first compared with the centre that it meets most often; the rounds below look through all groups.
    meets = groups.groupBy("id").agg((-F.sum("meets")).alias("rank"))
    centre = groups.select("sig", "id").join(meets, "id").groupBy("sig").agg(F.min(F.struct("rank", "id")).alias("c")).select("sig", F.col("c.id").alias("centre"), "c.rank")
    met = packed.join(centre, "sig").mapInPandas(trimmed(_starred), "id long, centre long, rank long").groupBy("id", "centre", "rank").agg((-F.count("*")).alias("times"))
    stars = met.groupBy("id").agg(F.min(F.struct("times", "rank", "centre")).alias("c")).select(F.least("id", "c.centre").alias("a"), F.greatest("id", "c.centre").alias("b"))
    tried = materialize(hits.filter("members is null").select("a", "b").union(stars).distinct())
    groups = groups.select("sig", "id")
    release(hits, packed)
    wanted = materialize(tried.select(F.explode(F.array("a", "b")).alias("key")).union(groups.select("id")).distinct())
    least = materialize(live.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")))
    one = least.join(wanted, "key", "left_semi").select(F.col("low").alias("id")).distinct()
    # Few ids go to the texts; where there are many, the texts come to the ids.
    few = one.count() <= MOST_BROADCAST
    some = texts.join(F.broadcast(one) if few else one, "id", "left_semi")
    sets = some.mapInPandas(trimmed(_shingled), "key long, n long, bits binary, shingles binary").dropDuplicates(["key"])
    sets = materialize(sets.join(F.broadcast(wanted) if few else wanted, "key", "left_semi"))

    same = materialize(_joined_keys(live))
    links = _links(tried, sets)
    part = connected_components(links.union(same))
    for every, most in ((EARLY_GROUPS, CLOSEST), (1, CLOSEST), (1, None)):
        if most is None:
            groups = materialize(groups.join(new.filter("a > b").select(F.col("a").alias("sig")), "sig", "left_semi"))  # read twice
        new = _cells(groups.filter(F.col("sig") % every == 0), part, sets, buckets).groupBy("bucket").applyInPandas(trimmed_group(_across(most)), "a long, b long").distinct()
        new = materialize(new.join(tried, ["a", "b"], "left_anti"))
        fresh = new.filter("a < b")
        if not fresh.isEmpty():
            tried = tried.union(fresh)
            links = links.union(_links(fresh, sets))
            part = connected_components(links.union(same))
        if every == 1 and new.filter("a > b").isEmpty():
            break

    least = least.join(part.toDF("key", "component"), "key", "left")
    joined = least.filter("component is not null")
    of_part = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = joined.select("key", "component").join(of_part, "component").select("key", "component_id")
    of_class = materialize(of_class.union(least.filter("component is null and low != high").select("key", F.col("low").alias("component_id"))))
    out = _spread(info, of_class)
    none = F.col("id").isNull() | (F.col("n") == 0)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(none, F.col("id")).otherwise(F.coalesce("component_id", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: the first by id (null ids last), then by a hash of id and text.

    A row is its id and text, not its id alone: several texts of one id are linked by their own shingles only, and rows
    without an id are grouped like others. Of rows that repeat both, one stays. Rows without words all stay.
    """
    keyed = docs.withColumn("__row", F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col)))
    joined = materialize(ngram_jaccard_join(keyed, "__row", text_col).filter("n_shingles > 0").groupBy("__row").agg(F.min("component_id").alias("component"), F.count("*").alias("n")))
    ids = keyed.select("__row", F.col(id_col).alias("__id")).dropDuplicates(["__row"])
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__row"))
    best = joined.join(ids, "__row").groupBy("component").agg(first.alias("r")).select(F.col("r.__row").alias("__row"))
    gone = joined.join(best, "__row", "left_anti").select("__row")
    repeated = joined.filter("n > 1").select("__row")
    left = keyed.join(gone, "__row", "left_anti")
    once = left.join(repeated, "__row", "left_semi").dropDuplicates(["__row"])
    return left.join(repeated, "__row", "left_anti").unionByName(once).select(*docs.columns)
