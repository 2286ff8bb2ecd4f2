"""SimHash near-dedup: pigeonhole blocks, block join, Hamming check, components.

Fingerprints within ``distance`` bits agree on at least ``blocks - distance`` of
``blocks`` parts, so each choice of that many parts is a join key. Only distinct
fingerprints are joined: copies share one. A key that many fingerprints share
(near copies of one text) is not joined pair by pair: its members are linked
through their variants with each of the remaining bits flipped, as two members
within two bits of each other share a variant. Both ways find all links and no
others; the second is linear in the members.

``near_duplicates`` serves a similarity of shingle sets instead of a few bits. Sets
that are 0.8 alike differ in about ten of 64 bits, which no split into blocks covers.
There the shingles themselves are split: into sections by their hash, each with a
SimHash of its own, so many that a close pair leaves some sections untouched. Equal
section fingerprints are the blocks; then the similarity itself is verified, but where
the Hamming distance of long fingerprints of large sets is far from the threshold's.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .util import materialise, slices, stored_bytes

#: Members up to which a section's block is joined pair by pair, and members of a tile of a larger one.
BLOCK, TILE = 32, 256
#: Shingles of a set that tiles compare: all, or of a larger set at least so many, drawn by hash.
DRAWN = 1024
#: Members up to which a block is joined pair by pair.
PAIRWISE = 64
#: Hashes counted at once.
CHUNK = 1 << 15


def shingle_hashes(text: bytes | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of the shingles of the whole text, repeats included; of all words, if they are fewer."""
    parts = (text or b"").lower().split()  # both are ASCII only on bytes
    digest = xxhash.xxh64_intdigest
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(line, seed)] if parts else [], "<u8")
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist()
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends, strict=True)], "<u8")


def majority(h: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Fingerprint of all hashes, or of each run that begins at ``starts``: bits set in over half."""
    if starts is None:
        ones = np.zeros((1, 64), np.int64)
        for i in range(0, len(h), CHUNK):
            ones += np.unpackbits(h[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        sizes = np.array([len(h)])
    else:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        ones, sizes = np.add.reduceat(bits, starts, axis=0), np.diff(np.append(starts, len(h)))
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_bytes(text: bytes | None, words: int, seed: int) -> int:
    """SimHash of the whole text; zero if it has no words."""
    return int(majority(shingle_hashes(text, words, seed))[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 5, seed: int = 42) -> DataFrame:
    """id, fp (the fingerprint as a signed long) per row; null texts as empty."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fp = [fingerprint_bytes(t, words, seed) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.array(fp, np.uint64).view(np.int64), pa.int64())], names=["id", "fp"]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Unsigned masks of the bits in each choice of ``blocks - distance`` parts."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, blocks: int = 4, distance: int = 2) -> DataFrame:
    """Links (a, b) between distinct ``fp`` within ``distance`` bits, enough to connect all that are."""
    if not 0 <= distance <= 2:
        raise ValueError("variants with one flipped bit link up to two bits")
    masks = block_masks(blocks, distance)
    keys = F.array(
        *[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]
    )
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    sizes = keyed.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = materialise(keyed.join(sizes, ["block", "key"]), "blocks")
    few, other = keyed.where(F.col("n") <= PAIRWISE), keyed.where(F.col("n") <= PAIRWISE)
    pairs = (
        few.alias("x")
        .join(other.alias("y"), F.expr("x.block = y.block and x.key = y.key and x.fp < y.fp"))
        .where(F.expr(f"bit_count(x.fp ^ y.fp) <= {distance}"))
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    flips = F.array(*[F.lit(_signed(x)) for x in [0, *(1 << i for i in range(64))]])
    many = keyed.where(F.col("n") > PAIRWISE).select("fp").distinct()
    variants = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.expr("fp ^ flip").alias("v"))
    if distance == 2:  # two members within two bits share a variant, and all that share one are within two bits
        low = variants.groupBy("v").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
        stars = variants.join(low, "v").where("fp > low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    else:  # a member one bit away is itself a variant; distinct fingerprints are never equal
        stars = variants.join(many.select(F.col("fp").alias("v")), "v").where(F.lit(distance == 1) & (F.col("fp") < F.col("v")))
        stars = stars.select(F.col("fp").alias("a"), F.col("v").alias("b"))
    return pairs.unionByName(stars).distinct()


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    distance: int = 2,
    blocks: int = 4,
    seed: int = 42,
) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits), component_id, group_size.

    Words are runs of other than ASCII white space, A-Z lower-cased; shingles of
    ``words`` words count as often as they occur (a shorter text: all its words). A text
    without words, or null, has fingerprint zero, which links like any other. Rows whose
    fingerprints differ in at most ``distance`` bits (0 to 2) are linked; component_id is
    the smallest identifier reachable over links, itself included, null identifiers
    aside; group_size counts the rows of the component. Repeated rows are rows of their
    own. An empty table gives an empty result; other columns are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    fps = materialise(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "distinct")
    found = connected_components(near_links(fps, blocks, distance))
    parts = materialise(
        fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "parts"
    )
    lows = materialise(parts.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("n").alias("group_size")), "lows")
    named = materialise(parts.select("fp", "component").join(lows, "component").drop("component"), "named")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size"
    )


#: Bits of the long fingerprint, and how many sections of a pair at the threshold shall remain untouched.
LONG_BITS, UNTOUCHED = 512, 8
#: Sets below this size are compared themselves; of larger pairs those within so many standard deviations of the threshold.
EXACT_BELOW, MARGIN = 300, 6
#: Ends of open pairs up to this size on disk are broadcast to the texts; beyond it both are shuffled.
BROADCAST_BYTES = 4 << 20


def mix64(x: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each value (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def section_count(size: float, similarity: float) -> int:
    """Sections of a set of ``size`` shingles: UNTOUCHED of them hold none of the differences of a pair."""
    different = max(1.0, 2 * size * (1 - similarity) / (1 + similarity))
    m = UNTOUCHED + 1.0
    while m * np.exp(-different / m) < UNTOUCHED:
        m *= 1.05
    return int(np.ceil(m))


def section_keys(h: np.ndarray, similarity: float) -> np.ndarray:
    """Keys (size class, section, SimHash of the section) of a set of distinct shingle hashes.

    A class holds the sizes from a power of two to the next; a set that a pair at the
    threshold may have in the next class has that one's sections too.
    """
    own = len(h).bit_length()
    out = []
    for level in (own, own + 1) if len(h) >= similarity * 2**own else (own,):
        m = section_count(2**level, similarity)
        part = mix64(h, level) % np.uint64(m)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        out.append(mix64(majority(h[order], starts), 1000 + level) ^ mix64(part[starts], 2000 + level))
    return np.concatenate(out)


def long_fingerprint(h: np.ndarray) -> np.ndarray:
    return np.concatenate([majority(mix64(h, 3000 + i)) for i in range(LONG_BITS // 64)])


def blocks_apart(keyed: DataFrame, blocks: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, node, component, minor, minors, majors) of the ``blocks`` (key, a) that lie in several components.

    Those in the component of the block's centre ``a`` are the block's majors, with no links among them to look for.
    """
    of_centre = found.toDF("a", "major")
    named = blocks.join(of_centre, "a", "left").select("key", F.coalesce("major", "a").alias("major"))
    members = keyed.join(named, "key").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), "major")
    members = materialise(members.withColumn("minor", F.expr("component <> major")).drop("major"), "members")
    sizes = members.groupBy("key").agg(F.count_if("minor").alias("minors"), F.count_if(~F.col("minor")).alias("majors")).where("minors > 0")
    return materialise(members.join(sizes, "key"), "apart")


def drawn_sets(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """node, size of the set of shingles, shift, drawn: hashes under 2^64 >> shift, all of a set up to 2 DRAWN."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                size, shift, drawn = [], [], []
                for text in part.column(1).to_pylist():
                    h = np.unique(shingle_hashes(text, words, seed))
                    k = max(0, (len(h) // DRAWN).bit_length() - 1)
                    size.append(len(h))
                    shift.append(k)
                    drawn.append(h[h <= np.uint64((2**64 - 1) >> k)].view(np.int64))
                columns = [pa.array(size, pa.int64()), pa.array(shift, pa.int32()), pa.array(drawn, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["node", "size", "shift", "drawn"])

    return texts.mapInArrow(run, "node long, size long, shift int, drawn array<long>")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Elements that each two of the sets have in common."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[element] > 1
    owner, element = owner[shared], (np.cumsum(times > 1) - 1)[element[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    width = 4096
    for lo in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        i, j = np.searchsorted(element, [lo, lo + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[i:j], element[i:j] - lo] = 1
        out += held @ held.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def tile_pairs(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of one block and two components that are as alike as asked (sure), or may be (not sure).

    A block's minors and majors are dealt into tiles, and each two tiles with a minor
    one among them meet in one group: all such pairs are compared, none becomes a row
    unless it is alike. Sets of which all is drawn are compared exactly; of others,
    what is drawn leaves out pairs six standard deviations below the threshold.
    """
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("long")
    place = F.pmod(F.xxhash64("node", "key"), F.greatest(F.lit(1), F.when(F.col("minor"), F.col("m")).otherwise(F.col("j"))))
    rows = apart.withColumns({"m": tiles("minors"), "j": tiles("majors")}).withColumn("own", F.when(F.col("minor"), place).otherwise(F.col("m") + place))
    met = F.when(F.col("minor"), F.expr("sequence(0L, m + j - 1)")).otherwise(F.expr("sequence(0L, m - 1)"))
    rows = rows.withColumn("met", F.explode(met)).select("key", "node", "component", "own", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"))
    rows = rows.join(sets, "node")

    def compare(group: pa.Table) -> pa.Table:
        column = lambda name: group.column(name).to_numpy()
        node, component, own, size, shift = map(column, ("node", "component", "own", "size", "shift"))
        k = int(shift.max())
        drawn = [x.values.to_numpy().view("<u8") for x in group.column("drawn")]
        drawn = [x[x <= np.uint64((2**64 - 1) >> k)] for x in drawn]
        common = common_counts(drawn)
        n = size if k == 0 else np.array([len(x) for x in drawn])
        share = common / np.maximum(n[:, None] + n[None, :] - common, 1)
        least = similarity
        if k:
            least = similarity - 6 * np.sqrt(similarity * (1 - similarity) / np.maximum(n[:, None] + n[None, :] - common, 1))
        alike = (share >= least) & (component[:, None] != component[None, :]) & (node[:, None] < node[None, :])
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        if lo != hi:
            alike &= own[:, None] != own[None, :]
        a, b = np.nonzero(alike)
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64()), "sure": pa.array(np.full(len(a), k == 0))})

    return rows.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long, sure boolean")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    seed: int = 42,
) -> DataFrame:
    """One row per input row: ``id_col``, component_id, group_size.

    Documents are linked if the Jaccard similarity of their sets of word shingles is
    ``similarity`` or more. The sets themselves are compared, but for pairs of EXACT_BELOW
    shingles or more whose long fingerprints' Hamming distance is MARGIN standard
    deviations above or below that of a pair of their sizes at the threshold. A pair at the threshold is met
    with a probability of about 1 - exp(-UNTOUCHED), one more alike with a higher one. All documents
    that share a section are compared: first with one of them, another one for each section,
    and then each two that this has left in different components: pair by pair in a block of up to
    BLOCK members, in tiles in a larger one.

    component_id is the smallest identifier reachable. Texts without words, null among
    them, are one group; fewer words than ``words`` are one shingle. Repeated rows are
    rows of their own. An empty table gives an empty result; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps, keys, sizes = [], [], []
                for text in part.column(1).to_pylist():
                    h = np.unique(shingle_hashes(text, words, seed))
                    sizes.append(len(h))
                    fps.append(long_fingerprint(h).view(np.int64))
                    keys.append(section_keys(h, similarity).view(np.int64) if len(h) else np.zeros(0, np.int64))
                longs = pa.list_(pa.int64())
                columns = [pa.array(fps, longs), pa.array(keys, longs), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "fp", "keys", "size"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = texts.mapInArrow(run, f"id struct<id: {kind}, h: bigint>, fp array<long>, keys array<long>, size long")
    rows = materialise(rows.withColumn("node", F.xxhash64("fp")), "sections")
    nodes = rows.groupBy("node").agg(
        F.min("id").alias("one"), F.min("id.id").alias("low"), F.count(F.lit(1)).alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"),
        F.any_value("size").alias("size"),
    )
    nodes = materialise(nodes, "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    # the least of node ^ key draws another document for each section, and gives it back
    centre = keyed.groupBy("key").agg(F.min(F.expr("node ^ key")).alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    centre = materialise(centre.select("key", F.expr("v ^ key").alias("a"), "n"), "centres")
    stars = keyed.join(centre, "key").where("node <> a").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    distance = F.aggregate(F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fps = nodes.select("node", "fp", "size")
    # the share of bits that differ is the angle between two sets, which their sizes give for a pair at the threshold
    cosine = similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) / F.sqrt(F.col("size_a") * F.col("size_b"))
    angle = F.acos(F.least(cosine, F.lit(1.0))) / np.pi
    slack = MARGIN * F.sqrt(F.col("angle") * (1 - F.col("angle")) / LONG_BITS)
    least, most = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the pairs a, b that are as alike as asked."""
        pairs = materialise(pairs.distinct(), "pairs")
        compared = (
            pairs.join(fps.toDF("a", "fp_a", "size_a"), "a").join(fps.toDF("b", "fp_b", "size_b"), "b").where(least / most >= similarity)
            .withColumns({"small": least < EXACT_BELOW, "angle": angle, "d": distance / LONG_BITS}).withColumn("slack", slack)
            .where("small or d <= angle + slack").select("a", "b", F.expr("not small and d < angle - slack").alias("sure"))
        )
        compared = materialise(compared, "compared")
        return materialise(compared.where("sure").select("a", "b").unionByName(verified(compared.where("not sure"))), "links")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """node, text of the nodes ``wanted``, one text each."""
        ends = wanted.join(nodes.select("node", "one"), "node")
        ends = materialise(ends.select("node", "one.h", F.col("one.id").alias("i")), "ends")
        if stored_bytes(docs.sparkSession, ends) <= BROADCAST_BYTES:
            ends = F.broadcast(ends)
        found = texts.select(F.col("id.h").alias("h"), F.col("id.id").alias("i"), "text").join(
            ends.withColumnsRenamed({"h": "h2", "i": "i2"}), F.expr("h = h2 and i <=> i2")
        )
        return found.select("node", "text").dropDuplicates(["node"])

    def shingle_sets(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [np.unique(shingle_hashes(t, words, seed)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    def verified(open_: DataFrame) -> DataFrame:
        """Those of the pairs a, b whose sets are as alike as asked."""
        of_ends = texts_of(open_.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        of_ends = materialise(of_ends.mapInArrow(shingle_sets, "node long, s array<long>"), "sets")
        both = open_.select("a", "b").join(of_ends.toDF("a", "s_a"), "a").join(of_ends.toDF("b", "s_b"), "b")
        both = both.select("a", "b", F.expr("size(s_a) + size(s_b)").alias("n"), F.expr("size(array_intersect(s_a, s_b))").alias("common"))
        return both.where(F.expr("common / (n - common)") >= similarity).select("a", "b")

    links = alike(stars)
    found = connected_components(links)
    # the pairs of a block that its centre has not brought together
    apart = blocks_apart(keyed, centre.where("n > 2"), found)
    few, many = apart.where(F.col("minors") + F.col("majors") <= BLOCK), apart.where(F.col("minors") + F.col("majors") > BLOCK)
    if not few.isEmpty():
        met = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key and x.node < y.node and x.component <> y.component"))
        links = links.unionByName(alike(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))))
    if not many.isEmpty():
        sets = materialise(drawn_sets(texts_of(many.select("node").distinct()), words, seed), "sets")
        tiled = materialise(tile_pairs(many, sets, similarity), "tiled")
        links = links.unionByName(tiled.where("sure").select("a", "b").distinct())
        if not (unsure := tiled.where("not sure").select("a", "b").distinct()).isEmpty():
            links = links.unionByName(verified(unsure))
    if not apart.isEmpty():
        found = connected_components(links)
    parts = materialise(
        nodes.select("node", "low", "n").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "parts"
    )
    lows = materialise(parts.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("n").alias("group_size")), "lows")
    named = materialise(parts.select("node", "component").join(lows, "component").drop("component"), "named")
    return rows.select("id.id", "node").join(named, "node").select(F.col("id").alias(id_col), "component_id", "group_size")
