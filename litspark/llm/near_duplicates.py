"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles of five words. Its sketch has ``BANDS * ROWS``
coordinates, filled by rounds of hashed bin placement: in round i every shingle falls in one bin with
a value of i plus a fraction, a bin keeps its least value, and rounds end when all bins are full. After
as many rounds as bins, round t + j places all shingles in bin j, so every coordinate fills whatever the
set's size. Coordinates of two sets agree with the sets' similarity J, concentrated as for independent
hashes. Documents that agree in all rows of a band are candidates: at J = 0.75 a pair is missed with
a chance of (1 - 0.75 ** ROWS) ** BANDS, about 4e-6.

How groups of copies stay linear: equal sets are one class, the smallest document standing for it. Bands
are taken a few at a time. In each bucket all classes are verified against the smallest one (a star, not
all pairs) unless earlier bands have linked both, and linked classes are contracted to components. Only
buckets that still hold two components need more. Where the pairs across components are few for each
member they are all listed and verified. In other buckets the sets travel with the members, so that only
links come out: a bucket of at most ``WIDE`` members and ``HELD`` shingles is verified block by block in one
task, in any other the join itself verifies; buckets of more than ``WIDE`` members are first split by
each of their other bands, which separates classes that met by a common passage. Wide buckets that hold two
components even then are dealt in blocks, and every pair of blocks is verified: first on sizes and sketches,
then with the sets of the members that have a partner there. So no link is lost to a cap. A pair goes to verification only if the
lowest bits of both sketches agree often enough: at J = 0.75 of the ``BINS`` bits 7 in 8 agree, and fewer
than ``LEAST_BITS`` do with a chance below 1e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litspark.llm.components import components, small
from litspark.llm.words import NOT_BLANK, U64, constants, map_text, mix, run_hashes, split_words
from litspark.sources.staging import discard, stage

SHINGLE = 5
ROWS = 6
BANDS = 64
#: Percent of shared shingles that links.
PERCENT = 75
#: Bands taken up to each turn.
TURNS = (4, BANDS)
#: Pairs across components for each member that a bucket may list.
DIRECT_PAIRS = 16
#: Members of a bucket whose join verifies as it is.
WIDE = 4096
#: Shingles of a bucket of at most WIDE members that one task may hold: 64 MB.
HELD = 1 << 23
_BLOCK = 256

BINS = ROWS * BANDS
LEAST_BITS = 300
_ROW, _BAND = constants(11, ROWS) | U64(1), constants(12, BANDS)
_ROUND = constants(13, 2 * BINS)
_DIGEST = constants(14, 2)


def shingle_sets(column: pa.Array):
    """The sorted distinct shingle hashes of each text."""
    words = split_words(column, NOT_BLANK, lower=True)
    hashes = words.hashes()
    runs = run_hashes(hashes, SHINGLE)
    for lo, hi in zip(words.lo[:-1], words.lo[1:], strict=True):
        if hi - lo >= SHINGLE:
            yield np.unique(runs[lo : hi - SHINGLE + 1])
        elif hi > lo:  # fewer words than a shingle: the sequence as one
            yield mix(run_hashes(hashes[lo:hi], int(hi - lo)) + U64(hi - lo))
        else:
            yield np.empty(0, dtype=U64)


def sketch(members: np.ndarray) -> np.ndarray:
    """The coordinates of a set that is not empty."""
    out = np.full(BINS, np.iinfo(U64).max, dtype=U64)
    n, done = len(members), 0
    while done < BINS:
        empty = BINS if not done else int((out == np.iinfo(U64).max).sum())
        if not empty:
            return out
        rounds = min(BINS - done, max(1, int(np.ceil(BINS * (np.log(empty) + 1) / n))))
        for at in range(done, done + rounds, step := max(1, (1 << 16) // n)):
            r = np.arange(at, min(at + step, done + rounds))
            h = mix(members[None, :] ^ _ROUND[r][:, None])
            place = ((h >> U64(32)) * U64(BINS)) >> U64(32)
            value = (h & U64(0xFFFFFFFF)) | (r.astype(U64) << U64(32))[:, None]
            np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
        done += rounds
    for j in np.flatnonzero(out == np.iinfo(U64).max):
        out[j] = (mix(members ^ _ROUND[BINS + j]).min() >> U64(32)) | U64((BINS + int(j)) << 32)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    return mix((coordinates.reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=U64) ^ _BAND).view(np.int64)


def low_bits(coordinates: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, 64 in a value."""
    return np.packbits((coordinates & U64(1)).astype(np.uint8)).view(np.int64)


def digest(members: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([mix(members ^ c).sum(dtype=U64) for c in _DIGEST]).tobytes()


def _sketches():
    def work(column):
        digests, sizes, bands, bits = [], [], [], []
        for members in shingle_sets(column):
            sizes.append(len(members))
            if len(members):
                digests.append(digest(members))
                made = sketch(members)
                bands.append(band_keys(made))
                bits.append(low_bits(made))
            else:
                digests.append(None)
                bands.append([])
                bits.append([])
        return pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, bits))

    return work


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    values = np.concatenate(found) if found else np.empty(0, dtype=U64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def _sets():
    return lambda column: (_lists(list(shingle_sets(column))),)


def _digested_sets():
    def work(column):
        found = list(shingle_sets(column))
        return _lists(found), pa.array([digest(x) if len(x) else None for x in found], pa.binary())

    return work


_SKETCH = T.StructType([
    T.StructField("digest", T.BinaryType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())),
])
_SET = T.StructType([T.StructField("members", T.ArrayType(T.LongType()))])


def _alike(n, m, x, y):
    """Sizes that leave room for the wanted share of common shingles, and sketches that speak for it."""
    differ = sum(F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(BINS // 64))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (differ <= BINS - LEAST_BITS)


def _linked(x: str, y: str):
    """Whether two sets share enough."""
    common = F.size(F.array_intersect(x, y)).cast("long")
    return 100 * common >= PERCENT * (F.size(x) + F.size(y) - common)


class _Verifier:
    """Verifies candidate pairs (a, b) on full sets; keeps the sets of nodes met before."""

    def __init__(self, docs: DataFrame, named: DataFrame | None = None):
        """``named`` has node, id and digest of the classes that don't go by a document's id."""
        self.docs, self.named, self.sets, self.seen = docs, named, None, None

    def load(self, nodes: DataFrame) -> DataFrame:
        """The sets of distinct nodes, and of all before."""
        if self.sets is not None:
            nodes = nodes.join(self.sets.select("id"), "id", "left_anti")
        nodes = stage(nodes)
        plain = nodes if self.named is None else nodes.join(self.named.select(F.col("node").alias("id")), "id", "left_anti")
        wanted = self.docs.join(small(plain, nodes.count()), "id", "left_semi")
        fresh = map_text(wanted, _sets, _SET, ["id"]).where(F.size("members") > 0).dropDuplicates(["id"])
        if self.named is not None:
            asked = stage(self.named.join(nodes.select(F.col("id").alias("node")), "node", "left_semi"))
            texts = self.docs.join(small(asked.select("id").distinct()), "id", "left_semi")
            texts = map_text(texts, _digested_sets, T.StructType([*_SET, _SKETCH["digest"]]), ["id"])
            one = texts.join(small(asked), ["id", "digest"]).select(F.col("node").alias("id"), "members").dropDuplicates(["id"])
            fresh = fresh.unionByName(one)
        fresh = stage(fresh)
        discard(nodes)
        self.sets = fresh if self.sets is None else self.sets.unionByName(fresh)
        return self.sets

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs that were not verified before, the linked ones."""
        pairs = stage(pairs.distinct() if self.seen is None else pairs.distinct().join(self.seen, ["a", "b"], "left_anti"))
        self.seen = pairs if self.seen is None else self.seen.unionByName(pairs)
        sets = self.load(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
        return both.where(_linked("x", "y")).select("a", "b")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members with the component of their class, the class itself before any link."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.drop("label").join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _stars(members: DataFrame) -> DataFrame:
    """Pairs of each bucket's members with its smallest one, of another component and where sizes allow a link."""
    first = members.groupBy("key").agg(F.min(F.struct("node", "n", "label", "bits")).alias("first"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return (
        members.join(first.where("lo != hi").select("key", "first"), "key")
        .where((F.col("label") != F.col("first.label")) & _alike(F.col("n"), F.col("first.n"), F.col("bits"), F.col("first.bits")))
        .select(F.col("node").alias("a"), F.col("first.node").alias("b"))
    )


def _open(members: DataFrame) -> DataFrame:
    """Buckets that hold more than one component, their members and shingles, and whether the pairs across them are few."""
    per = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    per = per.groupBy("key").agg(F.sum("c").alias("s"), F.sum("w").alias("w"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count(F.lit(1)).alias("k"))
    return per.where("k > 1").select("key", "s", "w", (F.col("s") * F.col("s") - F.col("q") <= 2 * DIRECT_PAIRS * F.col("s")).alias("direct"))


def _across(members: DataFrame, linked: bool = False) -> DataFrame:
    """Pairs of a bucket's members in different components; of members with their sets only the linked ones."""
    other = members.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("bits").alias("theirs"), *[F.col("members").alias("y")] * linked)
    meet = (F.col("node") > F.col("b")) & (F.col("label") != F.col("other")) & _alike(F.col("n"), F.col("m"), F.col("bits"), F.col("theirs"))
    if linked:
        meet = meet & _linked("members", "y")
    return members.join(other, "key").where(meet).select(F.col("node").alias("a"), "b")


def _may(size: np.ndarray, bits: np.ndarray, at: int, to: int) -> np.ndarray:
    """Which of all members the members ``at : to`` may link with, by sizes and sketches."""
    differ = np.zeros((to - at, len(size)), np.int16)
    for k in range(bits.shape[1]):
        differ += np.bitwise_count(bits[at:to, None, k] ^ bits[None, :, k])
    n, m = size[at:to, None], size[None, :]
    return (differ <= BINS - LEAST_BITS) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))


def bucket_links(node: np.ndarray, label: np.ndarray, bits: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of a bucket's members; values hold their sets, each sorted."""
    size, bits = np.diff(offsets), bits.view(U64)  # bitwise_count takes the absolute value of signed numbers
    _, root = np.unique(label, return_inverse=True)
    links = []
    for at in range(0, len(node), _BLOCK):
        to = min(at + _BLOCK, len(node))
        may = _may(size, bits, at, to)
        for i in range(at, to):
            others = np.flatnonzero(may[i - at, :i])
            others = others[root[others] != root[i]]
            if not len(others):
                continue
            mine = values[offsets[i] : offsets[i + 1]]
            ends = np.cumsum(size[others])
            theirs = values[np.arange(ends[-1]) + np.repeat(offsets[others] - (ends - size[others]), size[others])]
            place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            common = np.add.reduceat((mine[place] == theirs).astype(np.int64), ends - size[others])
            for j in others[100 * common >= PERCENT * (len(mine) + size[others] - common)]:
                if root[i] != root[j]:
                    links.append((int(node[i]), int(node[j])))
                    root[root == root[j]] = root[i]
    return links


def _held(table: pa.Table) -> pa.Table:
    """The links of one bucket."""
    table = table.combine_chunks()
    bits, sets = (table.column(c).combine_chunks() for c in ("bits", "members"))
    found = bucket_links(
        table.column("node").to_numpy(), table.column("label").to_numpy(), bits.flatten().to_numpy().reshape(-1, BINS // 64),
        sets.offsets.to_numpy().astype(np.int64) - sets.offsets[0].as_py(), sets.flatten().to_numpy().view(U64),
    )
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _verified(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of each bucket; ``s`` and ``w`` are its members and shingles."""
    held = (F.col("s") <= WIDE) & (F.col("w") <= HELD)
    full = members.join(sets.withColumnRenamed("id", "node"), "node")
    links = full.where(held).select("key", "node", "label", "bits", "members").groupBy("key").applyInArrow(_held, "a long, b long")
    if members.where(~held).head(1):
        links = links.unionByName(_across(full.where(~held), True))
    return stage(links.distinct())


def _paired(table: pa.Table) -> pa.Table:
    """Members of a pair of blocks that may link with one of another component there."""
    size = table.column("n").to_numpy()
    bits = table.column("bits").combine_chunks().flatten().to_numpy().reshape(-1, BINS // 64).view(U64)
    _, root = np.unique(table.column("label").to_numpy(), return_inverse=True)
    good = np.zeros(len(size), bool)
    for at in range(0, len(size), _BLOCK):
        to = min(at + _BLOCK, len(size))
        good[at:to] = (_may(size, bits, at, to) & (root[at:to, None] != root[None, :])).any(axis=1)
    return table.filter(pa.array(good))


def _by_blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of buckets of any size: two blocks of one bucket meet in a task."""
    blocks = F.ceil(2 * F.greatest(F.col("s") / F.lit(WIDE), F.col("w") / F.lit(HELD))).cast("int")
    dealt = members.withColumn("blocks", F.greatest(blocks, F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A block meets itself beside each other one; alone only where it is the bucket's whole.
    dealt = dealt.where((F.col("mine") != F.col("other")) | (F.col("blocks") == 1))
    key = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key")
    met = dealt.select(key, "node", "n", "label", "bits")
    met = stage(met.groupBy("key").applyInArrow(_paired, met.schema))
    full = met.join(sets.withColumnRenamed("id", "node"), "node").select("key", "node", "label", "bits", "members")
    return stage(full.groupBy("key").applyInArrow(_held, "a long, b long").distinct())


def _in_buckets(members: DataFrame) -> DataFrame:
    """Members of buckets that hold two classes or more."""
    full = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    return members.join(full, "key", "left_semi")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Null and blank texts have an empty set and stand alone. Rows without id link with nothing and are
    kept, their component null. Rows that repeat an id are one document with all their texts' links; each
    row is returned. An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    rows = stage(map_text(docs, _sketches, _SKETCH, ["id"]))
    useful = rows.where(F.col("id").isNotNull() & F.col("digest").isNotNull())
    classes = stage(useful.groupBy("digest").agg(F.min("id").alias("node"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits")))
    # A class goes by its smallest id, but where that id has several texts by 64 bits of its digest.
    several = useful.groupBy("id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi"))
    several = stage(several.where("lo != hi").select(F.col("id").alias("node")))
    named = None
    if several.head(1):
        apart = stage(classes.join(small(several), "node", "left_semi").select(F.xxhash64("digest").alias("node"), F.col("node").alias("id"), "digest"))
        if apart.head(1):
            named, before = apart, classes
            other = named.select("digest", F.col("node").alias("name"))
            classes = stage(classes.join(small(other), "digest", "left").withColumn("node", F.coalesce("name", "node")).drop("name"))
            discard(before)
    copies = useful.join(classes.select("digest", "node"), "digest").where("id != node").select(F.col("id").alias("a"), F.col("node").alias("b"))

    bands = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    members = stage(_in_buckets(bands).join(classes.select("node", "bits"), "node"))
    verify = _Verifier(docs, named)
    links, labels = None, None
    for lo, hi in zip((0, *TURNS), TURNS, strict=False):
        turn = _labelled(members.where(F.col("band").between(lo, hi - 1)), labels)
        found = stage(verify.links(_stars(turn)))
        known, labels = labels, components(found if links is None else links.unionByName(found))
        discard(found, *([] if known is None else [known]))
        links = labels.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))  # what is known, as stars
    here = stage(_labelled(members, labels))
    rest = stage(_open(here))
    if rest.head(1):
        here = stage(here.join(rest, "key"))
        links = links.unionByName(stage(verify.links(_across(here.where("direct")))))
        large = here.where("not direct").select("key", "node", "n", "bits", "label", "s", "w")
        if large.head(1):
            sets = verify.load(large.select(F.col("node").alias("id")).distinct())
            links = links.unionByName(_verified(large.where(F.col("s") <= WIDE), sets))
            wide = large.where(F.col("s") > WIDE).drop("label", "s", "w")
            if wide.head(1):
                # Classes of wide buckets meet again where a second band agrees too.
                other = bands.select("node", F.col("key").alias("other"))
                again = wide.join(other, "node").where("other != key").select(F.xxhash64("key", "other").alias("key"), "node", "n", "bits")
                labels = components(links)
                again = stage(_labelled(_in_buckets(again), labels))
                links = links.unionByName(stage(verify.links(_stars(again))))
                again = stage(_labelled(again, components(links)))
                again = stage(again.join(_open(again), "key"))
                links = links.unionByName(_verified(again, sets))
                # What met in no second band, or met there with others only, is compared in the wide bucket itself.
                last = stage(_labelled(wide, components(links)))
                last = stage(last.join(_open(last).select("key", "s", "w"), "key"))
                if last.head(1):
                    links = links.unionByName(_by_blocks(last, sets))

    final = components(links.unionByName(copies)).select(F.col("node").alias("id"), "label")
    if named is not None:  # names are no ids: their components take the smallest id
        names = named.select(F.col("node").alias("id"))
        ids = final.join(names, "id", "left_anti")
        touched = final.join(names, "id", "left_semi").select("label").distinct()
        least = stage(ids.join(touched, "label", "left_semi").groupBy("label").agg(F.min("id").alias("least")))
        final = ids.join(small(least), "label", "left").select("id", F.coalesce("least", "label").alias("label"))
    out = rows.select("id", "n_shingles").join(final, "id", "left").withColumn("component_id", F.coalesce("label", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
