"""Operator 4: near-duplicate documents by a signature-coordinate inverted join.

Each document's set of word shingles gets a MinHash signature of COORDINATES values. Documents with equal sets form
one class, which one member stands for. Classes are posted under each coordinate-value pair, values that only one
class has are skipped, and so are classes with fewer than MATCHES others left. Pairs that agree in MATCHES coordinates
agree in some of each one's rarest COORDINATES - MATCHES + 1, so only that prefix (by frequency) is posted again.

Of each class left, `common` counts the shingles that another class left has, too. Two sets can share no more than the
smaller count, which bounds their similarity; this and the sizes exclude most of a group of loosely similar copies.

Each posting list first meets one member only, the one with the fewest shingles of its own (a star, not all pairs).
Signatures of these pairs are compared; from MATCHES agreeing coordinates on, the full sets are. Confirmed links join
lists' members to components. Lists that still hold several components hang together in clusters of loosely similar
documents. Within a cluster the full sets are compared in blocks of BLOCK documents of like size (fewer where these have
over BLOCK_SHINGLES shingles together, on average over the blocks of that size), two blocks a task, and each task returns links between different components only, no more than it has documents. So no link that joins two
components is lost, and neither pairs nor a group are ever gathered; the work within one cluster does grow with the
square of its size, at some ten million pairs a second and core.

MATCHES lies five standard deviations under what a pair at the least similarity agrees in (40 of 64 for 0.85), so
about one such pair in a million is missed; more similar ones practically never.

Words are runs of bytes but ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a shingle is SHINGLE consecutive words, one of
all words where there are fewer.

Defined cases: null, empty or blank texts have an empty set and are linked with nothing; rows that share an id are one
node, linked with all that any of them is linked with; a row with a null id is linked with nothing, has a null component
and is kept; of a component the smallest id is kept; columns beside the text stay, but those named as the new ones are
replaced; an empty table gives an empty one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship, written
from .words import grams, mix, pieces, word_hashes

U = np.uint64
SHINGLE = 5
PERCENT = 85
COORDINATES = 64
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
SLICES = 64
SPREAD = 2000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * U(2) + U(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit fingerprints."""
    words, bounds = word_hashes(texts, lower=True)
    every = grams(words, n)
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s >= n:
            yield np.unique(every[s : e - n + 1])
        elif e > s:
            yield grams(words[s:e], e - s)
        else:
            yield every[:0]


def matches_for(percent: int) -> int:
    p = percent / 100
    return max(1, int(COORDINATES * p - 5 * (COORDINATES * p * (1 - p)) ** 0.5))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, 32 bits each."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, U)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[None, i : i + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return (low >> U(32)).astype(np.uint32)


def _classes(batches: Iterator[pa.RecordBatch], with_sets: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j in pieces(b.column("text")):
            sizes, one, two, extra = [], [], [], []
            for s in shingle_sets(b.column("text").slice(i, j - i)):
                m = mix(s)
                sizes.append(len(s))
                one.append(int(m.sum(dtype=U)) - (1 << 63))
                two.append(int(mix(m + U(0x51ED270B)).sum(dtype=U)) - (1 << 63))
                extra.append((s if with_sets else signature(s)).view(np.int64 if with_sets else np.int32) if len(s) else None)
            kind = pa.list_(pa.int64() if with_sets else pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(extra, kind)], ["id", "n", "f1", "f2", "extra"])


def _links_between(table: pa.Table, percent: int) -> pa.Table:
    """Links between different components among the sets of one or two blocks: a spanning forest of them."""
    lists = table.column("set").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    of = np.repeat(np.arange(len(sizes)), sizes)
    _, place, count = np.unique(lists.values.to_numpy(), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    of, column = of[use], column[place[use]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(sizes), len(sizes)), np.float32)
    for low in range(0, int(shared.sum()), 2048):
        s, e = np.searchsorted(column, [low, low + 2048])
        held = np.zeros((len(sizes), 2048), np.float32)
        held[of[s:e], column[s:e] - low] = 1
        both += held @ held.T
    union = sizes[:, None] + sizes[None, :] - both
    _, part = np.unique(np.array([str(x) for x in table.column("part").to_pylist()]), return_inverse=True)
    x, y = np.nonzero(np.triu((100 * both >= percent * union) & (part[:, None] != part[None, :]), 1))
    root, kept = list(range(int(part.max(initial=0)) + 1)), []
    for i, j in zip(x.tolist(), y.tolist()):
        ends = []
        for p in (int(part[i]), int(part[j])):
            while root[p] != p:
                root[p] = root[root[p]]
                p = root[p]
            ends.append(p)
        if ends[0] != ends[1]:
            root[max(ends)] = min(ends)
            kept.append((i, j))
    nodes = table.column("node")
    return pa.table({"a": nodes.take(pa.array([i for i, _ in kept], pa.int64())), "b": nodes.take(pa.array([j for _, j in kept], pa.int64()))})


def _components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes (a, b) of links: the smallest node that can be reached."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("seen"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "seen").alias("to"), F.col("component").alias("before"))
        up = labels.select(F.col("node").alias("to"), F.col("component").alias("further"))
        new = written(lower.join(up, "to", "left").select("node", F.least("to", "further").alias("component"), "before"), "labels")
        labels, changed = new.select("node", "component"), new.where("component != before").limit(1).count()
        if not changed:
            return labels


def _slice(total: int):
    """Which slice of its lists a node falls to; a table of no more than SPREAD postings in all has one slice."""
    return F.pmod(F.xxhash64("node"), F.lit(SLICES if total > SPREAD else 1)).cast("int")


def _slices(total: int):
    """The slices that a list's nodes fall to, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _slice(total))).alias("slices")


def _with_list(posted: DataFrame, lists: DataFrame, total: int) -> DataFrame:
    """posted (node, pair, ...) joined with its pair's row in lists, a written table with a row a pair and its _slices.

    Every list is dealt by slices of its nodes, so that no task gets a long one whole, and goes to those slices only
    that it has a node in: to no more rows than it has postings.
    """
    held = F.filter(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.getbit("slices", i) == 1)
    told = lists.withColumn("slice", F.explode(held)).drop("slices")
    return posted.withColumn("slice", _slice(total)).join(told.hint("merge"), ["pair", "slice"]).drop("slice")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row."""
    ship(df.sparkSession)
    matches = matches_for(percent)
    plain = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = written(plain.mapInArrow(lambda it: _classes(it, False), "id long, n long, f1 long, f2 long, extra array<int>"), "signatures")
    same = ["n", "f1", "f2"]
    known = rows.where("id IS NOT NULL AND n > 0")
    classes = written(known.groupBy(*same).agg(F.min("id").alias("rep")), "classes")
    spoken = known.join(classes, same).where("id = rep").select("rep", "f1", "f2", F.col("extra").alias("sig")).dropDuplicates(["rep", "f1", "f2"])
    # a node is a class, which its two fingerprints name; the smallest id orders them
    node = written(spoken.select(F.struct("rep", "f1", "f2").alias("node"), "sig"), "nodes")

    posted = node.select("node", F.posexplode("sig").alias("coordinate", "value"))
    posted = posted.select("node", (F.shiftleft(F.col("coordinate").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))).alias("pair"))
    total = node.count() * COORDINATES
    shared = written(posted.groupBy("pair").agg(F.count("*").alias("freq"), _slices(total)).where("freq > 1"), "lists")
    held = _with_list(posted, shared, total).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("freq", "pair"))).alias("held"))
    prefix = held.where(F.size("held") >= matches).select("node", F.explode(F.slice("held", F.lit(1), F.size("held") - matches + 1)).alias("x")).select("node", F.col("x.pair").alias("pair"))
    prefix = written(prefix, "prefix")

    asked = prefix.select(F.col("node.rep").alias("id")).distinct()
    own = plain.join(asked.hint("merge"), "id").mapInArrow(lambda it: _classes(it, True), "id long, n long, f1 long, f2 long, extra array<long>")
    own = own.select(F.struct(F.col("id").alias("rep"), "f1", "f2").alias("node"), "n", F.col("extra").alias("set")).join(prefix.select("node").distinct().hint("merge"), "node", "left_semi")
    sets = written(own.dropDuplicates(["node"]), "sets")
    single = sets.select(F.col("node.f1").alias("f1"), F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("c"), F.min("f1").alias("f1")).where("c = 1")
    lone = single.groupBy("f1").agg(F.count("*").alias("alone"))
    least = F.lit(percent)
    sized = sets.select("node", "n", F.col("node.f1").alias("f1")).join(lone.hint("merge"), "f1", "left").select("node", "n", F.coalesce("alone", F.lit(0)).alias("alone"))
    sized = sized.withColumn("common", F.col("n") - F.col("alone")).where(F.lit(100) * F.col("common") >= least * F.col("n"))
    member = written(prefix.join(sized.hint("merge"), "node"), "members")  # (node, pair, n, alone, common)

    def possible(n1, c1, n2, c2):
        """Whether sets of these sizes with so many common shingles can be similar."""
        most = F.least(c1, c2)
        return F.lit(100) * most >= least * (n1 + n2 - most)

    postings = member.count()
    first = member.groupBy("pair").agg(F.min(F.struct("alone", "node", "n", "common")).alias("x"), F.count("*").alias("members"), _slices(postings)).where("members > 1")
    first = written(first.select("pair", "slices", F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("x.common").alias("ca")), "lists")
    star = _with_list(member, first, postings).where((F.col("node") != F.col("a")) & possible(F.col("n"), F.col("common"), F.col("na"), F.col("ca")))
    stars = star.select("a", F.col("node").alias("b")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that agree in MATCHES coordinates and whose sets are similar."""
        left, right = node.select(F.col("node").alias("a"), F.col("sig").alias("sa")), node.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
        agreed = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
        near = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(agreed >= matches).select("a", "b")
        met = near.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")).hint("merge"), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")).hint("merge"), "a")
        met = met.select("a", "b", F.size("x").cast("long").alias("nx"), F.size("y").cast("long").alias("ny"), F.size(F.array_intersect("x", "y")).cast("long").alias("both"))
        return written(met.where(F.lit(100) * F.col("both") >= least * (F.col("nx") + F.col("ny") - F.col("both"))).select("a", "b"), "links")

    links = confirmed(stars)
    labels = _components(links)
    # lists that hold several components hang together in clusters, within which all sets are compared in blocks
    member = written(member.join(labels.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "members")
    mixed = member.groupBy("pair").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("node").alias("a"), _slices(postings))
    mixed = written(mixed.where("low != high").select("pair", "a", "slices"), "lists")
    listed = written(_with_list(member, mixed, postings).select("node", "n", "part", "a"), "listed")
    clusters = _components(listed.where("a != node").select("a", F.col("node").alias("b")).distinct()).withColumnRenamed("component", "cluster")
    people = listed.select("node", "n", "part").distinct().join(clusters.hint("merge"), "node")
    people = people.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int"))  # similar sets are one class apart at most
    people = written(people.withColumn("slice", F.pmod(F.xxhash64("node"), F.lit(SLICES)).cast("int")), "people")
    # a cluster's class of more than BLOCK members is dealt by slices of these, so that none of them meets its size in one task
    sizes = people.groupBy("cluster", "class").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("buckets"))
    sizes = written(sizes, "sizes")
    large = sizes.where("buckets > 1").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    bucket = F.when(F.col("buckets").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), F.col("buckets"))).cast("int")
    people = people.join(large.hint("merge"), ["cluster", "class", "slice"], "left").select("cluster", "class", "node", "n", "part", bucket.alias("bucket"))
    people = written(people, "people")
    block = sizes.select("cluster", "class", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    first, second = block.toDF("cluster", "c1", "b1"), block.toDF("cluster", "c2", "b2")
    meetings = first.join(second.hint("merge"), "cluster").where("c2 = c1 AND b2 >= b1 OR c2 = c1 + 1")
    ones = people.toDF("cluster", "c1", "node", "n", "part", "b1").join(meetings.hint("merge"), ["cluster", "c1", "b1"])
    twos = people.toDF("cluster", "c2", "node", "n", "part", "b2").join(meetings.where("NOT (c1 = c2 AND b1 = b2)").hint("merge"), ["cluster", "c2", "b2"])
    task = ["cluster", "c1", "b1", "c2", "b2"]
    meeting = ones.select(*task, "node", "part").unionByName(twos.select(*task, "node", "part")).join(sets.select("node", "set").hint("merge"), "node")
    name = "struct<rep:bigint,f1:bigint,f2:bigint>"
    more = written(meeting.groupBy(*task).applyInArrow(lambda t: _links_between(t, percent), f"a {name}, b {name}"), "links")
    # nodes that share an id are one: classes' ids are linked, rather than the classes
    ids = lambda x: x.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"))
    doubled = known.select("id", "f1", "f2").distinct().groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    tied = known.join(doubled.hint("merge"), "id").join(classes.hint("merge"), same).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    final = _components(ids(links).unionByName(ids(more)).unionByName(tied).where("a != b"))
    final = final.select(F.col("node").alias("rep"), F.col("component"))
    groups = classes.join(final.hint("merge"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("id IS NOT NULL AND n > 0").join(groups.hint("merge"), same).select("id", "n", "component_id")
    alone = rows.where("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
