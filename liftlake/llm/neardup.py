"""Near-duplicate groups: one-permutation MinHash with densification, bands, star edges.

Each text becomes the set of its word shingles. One hash function deals the
set into bins and keeps each bin's minimum; an empty bin borrows the value of
the non-empty bin that comes first in its own fixed random order (optimal
densification). Consecutive bins form bands and equal bands form buckets.

Equal sets are one node from the start. In each bucket every member is compared
with one centre only, the member that meets the most others over all buckets.
Links are confirmed on the full sets and joined into components. Buckets whose
members then still belong to several components are compared to the end, in blocks:
each pair of members of different components meets, and only links come out. So a
bucket of one big group costs one comparison per member, none is left out, and there
is no cap on buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftlake.llm import textnum
from liftlake.llm.util import saved

SHINGLE_WORDS = 4
BANDS = 32
ROWS = 5
MIN_PERCENT = 80
# Ids of documents that share a bucket, and their labels, are broadcast up to this many (about 16 bytes each).
MAX_BROADCAST_IDS = 1_000_000
# Members of a bucket whose sets are compared in one group with those of another such block.
BLOCK = 1024
# Small tables between rounds are written as one file per so many rows.
ROWS_A_FILE = 500_000


class OnePermutation:
    """Signatures of sorted sets of 64-bit hashes; ``bands * rows`` bins."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        bins = bands * rows
        self.edges = np.array([-(-(k << 64) // bins) for k in range(bins)], np.uint64)
        rng = np.random.default_rng(7)
        self.turn = rng.permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)
        self.seeds = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def signature(self, ordered: np.ndarray) -> np.ndarray:
        first = np.searchsorted(ordered, self.edges)
        after = np.append(first[1:], len(ordered))
        full = np.flatnonzero(first < after)
        source = np.arange(len(first))
        empty = np.flatnonzero(first >= after)
        if len(empty):
            source[empty] = full[self.turn[empty[:, None], full].argmin(axis=1)]
        return ordered[first[source]]

    def band_hashes(self, ordered: np.ndarray) -> np.ndarray:
        grid = self.signature(ordered).reshape(self.bands, self.rows)
        out = self.seeds.copy()
        for k in range(self.rows):
            out = textnum.mix(out + grid[:, k])
        return out


def _sets(column: pa.Array, size: int):
    """Sorted distinct shingle hashes of each text of a batch."""
    data, offsets = textnum.text_bytes(column)
    data = textnum.LOWER[data]
    starts, ends, per_text = textnum.words(data, offsets)
    hashes = textnum.word_hashes(data, starts, ends)
    for a, b in zip(per_text[:-1], per_text[1:]):
        yield np.unique(textnum.shingles(hashes[a:b], size))


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """Per document: id, ``n_shingles``, ``digest`` of the set, ``bands`` hashes (both null for no words)."""

    def run(batches):
        oph = OnePermutation(bands, rows)
        for batch in textnum.parts(batches):
            count, digest, found = [], [], []
            for s in _sets(batch.column(1), size):
                count.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                found.append(oph.band_hashes(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>")


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in textnum.parts(batches):
            sets = pa.array([s.tobytes() for s in _sets(batch.column(1), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "shingles"])

    return docs.mapInArrow(run, "node bigint, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                u = np.frombuffer(x.as_buffer(), np.uint64)
                v = np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                both = int((v[at] == u).sum()) if len(v) else 0
                hit.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(hit))

    x = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    return pairs.join(x, "b").join(y, "a").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node reachable over links (a, b): columns node, component.

    Each round sends the smallest label over the links and then jumps to the
    label's own label, so even a long chain takes a logarithmic number of rounds.
    """
    count = nodes.count()
    parts = 1 + count // ROWS_A_FILE
    # Two numbers a row: broadcast up to the bound, shuffled beyond.
    near_by = F.broadcast if count <= MAX_BROADCAST_IDS else (lambda df: df)
    one_way = links.where("a <> b").select("a", "b")
    both = saved(one_way.union(one_way.select("b", "a")).distinct(), "links", parts)
    labels = saved(nodes.select("node", F.col("node").alias("component")), "labels", parts)
    while True:
        least = both.join(near_by(labels.select(F.col("node").alias("b"), "component")), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least")).coalesce(parts)
        step = labels.join(near_by(least), "node", "left").select(
            "node", "component", F.least("component", F.coalesce("least", "component")).alias("lower"))
        # A node's old label hears of the smaller one, too: whole trees are hooked together.
        hook = step.where("lower < component").groupBy(F.col("component").alias("node")).agg(F.min("lower").alias("hooked")).coalesce(parts)
        lowered = saved(step.join(near_by(hook), "node", "left").select(
            "node", "component", F.least("lower", F.coalesce("hooked", "lower")).alias("lower")), "labels", parts)
        if not lowered.where("lower < component").limit(1).count():
            return labels
        jump = lowered.select(F.col("node").alias("lower"), F.col("lower").alias("root"))
        labels = saved(lowered.join(near_by(jump), "lower", "left").select(
            "node", F.least("lower", F.coalesce("root", "lower")).alias("component")), "labels", parts)


def _joined(labels: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    """Labels after more links: only the components that the links touch are joined."""
    of = labels.select("node", "component")
    touched = links.join(of.withColumnsRenamed({"node": "a", "component": "ca"}), "a") \
        .join(of.withColumnsRenamed({"node": "b", "component": "cb"}), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    touched = saved(touched, "links", parts)
    nodes = saved(touched.select(F.col("a").alias("node")).union(touched.select("b")).distinct(), "nodes", parts)
    new = components(nodes, touched).select(F.col("component").alias("joined"), F.col("node").alias("component"))
    return saved(labels.join(new, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "labels", parts)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                    percent: int = MIN_PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of ``size`` words (A-Z lower-cased);
    fewer words are one shingle; no words, or null, is the empty set, linked with
    nothing. ``component_id`` is the smallest id reachable over links of at least
    ``percent`` similarity, ``kept`` tells whether it is the document's own.
    Two equal texts always link. Repeated rows are returned as often as they come;
    rows of one id with different texts count as versions of one document. A row
    without id links with nothing and is kept. Other columns are not looked at.
    """
    spark = docs.sparkSession
    sig = saved(signatures(docs, id_col, text_col, size, bands, rows), "signatures")
    named = sig.where("doc_id is not null and digest is not null")
    classes = saved(named.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    members = saved(_members(classes), "members")
    labels, many = None, members.count()
    parts = 1 + many // ROWS_A_FILE
    ids = saved(members.select("node").distinct(), "nodes", parts)
    if many:
        texts = docs.select(F.col(id_col).cast("bigint").alias("node"), F.col(text_col).cast("string").alias("text"))
        wanted = F.broadcast(ids) if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS else ids
        sets = saved(_full_sets(texts.join(wanted, "node", "left_semi"), size).distinct(), "sets")
        centre = members.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("c"))
        star = members.join(centre, "bucket").select(
            F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.n").alias("na"), F.col("n").alias("nb"))
        links = saved(_confirmed(_possible(star, percent), sets, percent), "links", parts)
        labels = components(ids, links)
        links = saved(_rest(members, labels, sets, percent), "links", parts)
        if links.limit(1).count():
            labels = _joined(labels, links, parts)
    # Classes of one id are one document; a class takes the label of its node.
    of_class = classes.select("digest", "node")
    found = of_class.join(labels, "node", "left").select("digest", F.coalesce("component", "node").alias("label")) \
        if labels is not None else of_class.select("digest", F.col("node").alias("label"))
    out = sig.join(found, "digest", "left")
    versions = named.groupBy("doc_id").agg(F.countDistinct("digest").alias("k")).where("k > 1")
    if versions.limit(1).count():
        return _with_versions(spark, out, found, named)
    return _result(out)


def _result(out: DataFrame) -> DataFrame:
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.col("doc_id").eqNullSafe(F.when(F.col("doc_id").isNotNull(), component)).alias("kept"))


def _with_versions(spark, out: DataFrame, found: DataFrame, named: DataFrame) -> DataFrame:
    """Join the components of ids that come with several texts."""
    pairs = named.select("doc_id", "digest").distinct().join(found, "digest").select("doc_id", "label")
    least = pairs.groupBy("doc_id").agg(F.min("label").alias("a"))
    links = pairs.join(least, "doc_id").select("a", F.col("label").alias("b")).distinct()
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    joined = components(nodes, links)
    merged = out.join(joined.withColumnRenamed("node", "label"), "label", "left")
    return _result(merged.withColumn("label", F.coalesce("component", "label")).drop("component"))


def _members(classes: DataFrame) -> DataFrame:
    """Rows (bucket, node, n, weight) of buckets with at least two nodes; weight counts a node's company."""
    dealt = classes.select("node", "n", F.explode("bands").alias("bucket"))
    crowd = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    rows = saved(dealt.join(crowd, "bucket"), "buckets")
    weight = rows.groupBy("node").agg(F.sum("crowd").alias("weight"))
    return rows.join(weight, "node").select("bucket", "node", "n", "weight").distinct()


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose set sizes allow the similarity."""
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    return pairs.where(F.col("a") != F.col("b")).where(100 * small >= percent * large) \
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets between members that still belong to different components.

    Members of a bucket's largest component need not meet each other, so only the
    others ask: blocks of them meet blocks of all members. A member of the largest
    component goes to as many groups as there are blocks of others, so one stranger in
    a bucket of a million costs every member one row. Only links leave a group, never the pairs.
    """
    known = members.select("bucket", "node").join(labels, "node")
    sizes = known.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("many"), F.sum("k").alias("k"), F.max(F.struct("k", F.col("component").alias("c"))).alias("top")) \
        .where("many > 1").select(
            "bucket", F.col("top.c").alias("largest"), F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"),
            F.ceil((F.col("k") - F.col("top.k")) / BLOCK).cast("int").alias("askers"))
    dealt = _meetings(saved(known.join(mixed, "bucket"), "mixed"))

    def run(table: pa.Table) -> pa.Table:
        component, node = table.column("component").to_numpy(), table.column("node").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        size = np.array([len(x) for x in held])
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        _, ids = np.unique(np.concatenate(held), return_inverse=True)
        mark = np.zeros(ids.max() + 1, np.int32)
        found_a, found_b = [], []
        answers = np.flatnonzero(~asks)
        for q in np.flatnonzero(asks) if len(answers) else ():
            own = ids[starts[q]:starts[q] + size[q]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids], starts)[answers]
            mark[own] = 0
            hit = answers[(component[answers] != component[q]) & (100 * both >= percent * (size[answers] + size[q] - both))]
            # One link to a component does.
            hit = hit[np.unique(component[hit], return_index=True)[1]]
            found_a += [node[q]] * len(hit)
            found_b += node[hit].tolist()
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    found = dealt.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(run, "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _meetings(rows: DataFrame) -> DataFrame:
    """Rows (bucket, i, j, node, component, asks): a block ``i`` of members outside the largest component asks a block ``j`` of all members."""
    place = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    columns = ["bucket", "node", "component"]
    asking = rows.where("component <> largest").select(*columns, place("askers").alias("i"), every("blocks").alias("j"), F.lit(True).alias("asks"))
    asked = rows.select(*columns, every("askers").alias("i"), place("blocks").alias("j"), F.lit(False).alias("asks"))
    return asking.unionByName(asked).select("bucket", "i", "j", "node", "component", "asks")
