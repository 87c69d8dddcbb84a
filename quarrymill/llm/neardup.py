"""Near-duplicates by an inverted join over MinHash signature coordinates.

A document's set is its distinct word shingles, as 64-bit hashes. Equal sets are one class, represented by its smallest
doc_id; only classes go on. Each class has a signature of ``COORDS`` minima, and is posted under each coordinate-value
pair that another class shares. Two classes are a candidate pair when ``LEAST`` coordinates or more agree: for sets of
similarity 0.8 the chance of fewer is 8e-7 (binomial, 48 coordinates, 24 wanted), and smaller the more alike they are.

Counting is by prefix and skip: if LEAST of a class's postings must be shared, then under one global order of the
postings a pair must meet within all but the last LEAST - 1 of each. The order is by frequency, so each class skips its
LEAST - 1 most frequent postings, and what many documents share (a passage, a licence) is hardly ever joined on.

Which documents link transitively is wanted, not every pair, so nothing lists the pairs of a group. First families are
found, the connected components of the candidate pairs: a class meets one member of its postings (the smallest of the
posting, the one it collides with most often; then one drawn by a hash), and for postings whose members then still lie
in different families every pair is counted, in blocks of bounded size that tell only which families they join. Then
each family is resolved on full sets. Families of up to ``BLOCK`` classes
(and ``BLOCK_SHINGLES`` hashes) are one block, in which every pair is compared. In a larger one all members are first compared with a few drawn members; the largest component that gives needs no
comparison within itself, and the rest is compared with it and with itself, block by block. So every pair of a family
that isn't already connected is compared on full sets, no cap drops a partner, and no group meets in one task: in joins
on a posting, or on the smallest member of a family, the rows of hot keys stay where they are (``split_join``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import HOT_KEYS, HOT_ROWS, hot_keys, map_batches, slices, split_join, table, written

COORDS, LEAST = 48, 24
PER_CENT = 80
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000  # members and hashes of a part; a block is two parts
DRAWN = 3
#: Families' members (two longs each) up to this number, 32 MB, are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Hashes of all families' drawn members up to this number, 32 MB, are broadcast to the members' sets.
BROADCAST_HASHES = 4_000_000
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None, words_each: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; all words as one where there are fewer; empty without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n < words_each:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    x = each[: n - words_each + 1]
    for k in range(1, words_each):
        x = x * _P1
        x ^= x >> np.uint64(29)
        x = (x + each[k : n - words_each + 1 + k]) * _P2
        x ^= x >> np.uint64(32)
    return np.unique(x)


@lru_cache(maxsize=4)
def _permutations(coords: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_25)
    return rng.integers(1, 1 << 63, coords, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, coords, dtype=np.uint64)


def signature(found: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The minima, as unsigned 32-bit numbers, of a set under ``coords`` hash functions."""
    odd, flip = _permutations(coords)
    if len(found) <= 4096:
        return ((((found[None, :] ^ flip[:, None]) * odd[:, None]).min(axis=1)) >> np.uint64(32)).astype(np.uint32)
    return np.array([((found ^ f) * o).min() >> np.uint64(32) for o, f in zip(odd, flip)], dtype=np.uint32)


def features(docs: DataFrame, words_each: int, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (128 bits of the set), sig; for an empty set the last three are null."""
    schema = "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<int>"
    arrow = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("sig", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sizes, one, two, sigs = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingle_set(text, words_each)
                    sizes.append(len(found))
                    if len(found):
                        a, b = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), np.int64).tolist()
                        one.append(a), two.append(b), sigs.append(signature(found, coords).view(np.int32))
                    else:
                        one.append(None), two.append(None), sigs.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip((sizes, one, two, sigs), list(arrow)[1:]))], schema=arrow)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def set_rows(docs: DataFrame, words_each: int) -> DataFrame:
    """node, family, members: the shingle hashes of each row."""
    arrow = pa.schema([("node", pa.int64()), ("family", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                sets = [shingle_set(t, words_each).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sets, arrow.field(2).type)], schema=arrow)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "family"), run, "node long, family long, members array<long>")


def prefix_postings(sigs: DataFrame, least: int, coords: int) -> DataFrame:
    """post, node: each class under its rarest shared postings, all but the ``least`` - 1 most frequent of the ``coords``.

    A node with several classes (rows that share an id) skips none.
    """
    posts = sigs.select("node", F.posexplode("sig").alias("k", "v")).select("node", F.expr("shiftleft(k::bigint, 32) + (v::bigint & 4294967295)").alias("post"))
    # hot postings are found on one in 16 classes; any count that all classes see alike gives one global order
    drawn = posts.where(F.pmod(F.xxhash64("node"), F.lit(16)) == 0).groupBy("post").agg((F.count("*") * 16).alias("n"))
    hot = hot_keys(drawn, "post", sigs.count() * coords)
    near = F.broadcast(hot.select(F.col("post").alias("hot_post"), F.col("n").alias("hot_n")))
    tagged = posts.join(near, F.col("post") == F.col("hot_post"), "left")
    rare = tagged.where("hot_post is null").select("post", "node")
    shared = rare.groupBy("post").agg(F.count("*").alias("n")).where("n > 1")
    met = rare.join(shared, "post").unionByName(tagged.where("hot_post is not null").select("post", "node", F.col("hot_n").alias("n"))).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "post"))).alias("found"))  # at most coords a class
    skip = F.when(F.size("found") <= coords, F.lit(least - 1)).otherwise(F.lit(0))
    met = met.where(F.size("found") >= least).select("node", F.explode(F.slice("found", F.lit(1), F.size("found") - skip)).alias("x"))
    return met.select("x.post", "node").distinct()


def alike(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b), one for each b, whose signatures agree in ``least`` coordinates or more, and whose sizes allow the similarity."""
    pairs = written(pairs, "met")
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a", pairs.count())  # the a of a large family
    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
    met = split_join(pairs.join(right, "b"), left, "a", hot)
    return met.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PER_CENT).where(agree >= least).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node of the edges (a, b).

    Labels fall to the least of the neighbours' and are then replaced by their own label (pointer jumping), so the
    rounds grow with the logarithm of the longest chain. Each round is a written table; labels only fall, so their
    unchanged sum ends the rounds, and no edge or label goes to the driver.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    hot = hot_keys(both.groupBy("b").agg(F.count("*").alias("n")), "b", both.count())
    total = lambda t: t.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()
    now = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    was, nodes = total(now)
    while was is not None:
        heard = split_join(both, now.select(F.col("node").alias("b"), "label"), "b", hot).groupBy("a").agg(F.min("label").alias("m"))
        fell = written(now.join(heard, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("label")), "fell")
        # labels that have fallen themselves; all nodes of a component come to share a label, so its rows stay where they are
        heads = fell.groupBy("label").agg(F.count("*").alias("n"))
        jumps = written(heads.join(fell.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("m")), "label"), "jumps")
        if jumps.isEmpty():
            now = fell
        else:
            jumped = split_join(fell, jumps.select("label", "m"), "label", hot_keys(jumps, "label", nodes), "left")
            now = written(jumped.select("node", F.coalesce("m", "label").alias("label")), "labels")
        if (then := total(now)[0]) == was:
            break
        was = then
    return now


def relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the links (a, b) have joined components; nodes that aren't there are on their own."""
    if labels is None:
        return components(links)
    n_links, n_nodes = links.count(), labels.count()
    own = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    raised = split_join(split_join(links, own("a"), "a", how="left", total=n_links), own("b"), "b", how="left", total=n_links)
    roots = components(raised.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))).select(F.col("node").alias("up"), F.col("label").alias("root"))
    old = split_join(labels, roots.select(F.col("up").alias("label"), "root"), "label", how="left", total=n_nodes).select("node", F.coalesce("root", "label").alias("label"))
    new = roots.join(labels, F.col("up") == F.col("node"), "left_anti").select(F.col("up").alias("node"), F.col("root").alias("label"))
    return written(old.unionByName(new), "labels")


def often_met(met: DataFrame) -> DataFrame:
    """Of the pairs (a, b), one for each b: the a it meets in most postings, the smallest of those."""
    count = met.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return count.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")


def mixed(posts: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """post, node, label, n of the postings whose members lie in different components."""
    own = labels.select(F.col("node").alias("l2"), "label")
    named = posts.join(own, F.col("node") == F.col("l2"), "left").select("post", "node", F.coalesce("label", "node").alias("label"))
    open_ = named.groupBy("post").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("post", "n")
    return split_join(named, open_, "post", hot)


def spanning(node: np.ndarray, label: np.ndarray, rows: np.ndarray, cols: np.ndarray, links) -> list[tuple[int, int]]:
    """Links that join components: ``links(i, js)`` tells which of the members ``js`` link with member ``i``.

    Members with one label are in one component already, and only pairs of different ones are asked for.
    """
    root, out = label.copy(), []
    within = rows is cols
    for i in rows:
        js = cols[(cols > i) & (root[cols] != root[i])] if within else cols[root[cols] != root[i]]
        if len(js):
            for j in js[links(i, js)]:
                if root[j] != root[i]:
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
                    root[root == root[j]] = root[i]
    return out


def by_block(rows: DataFrame, key: list[str], fn) -> DataFrame:
    """Links (a, b) that ``fn`` (a pyarrow table of one block's rows to pairs) finds in each block, the rows that share ``key``."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in pairs], pa.int64()) for k in (0, 1)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for part in slices(batch, 512):
                now = pa.Table.from_batches([part])
                held = now if held is None else pa.concat_tables([held, now])
                cols = [held.column(c).to_numpy() for c in key]
                starts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in cols], axis=0)) + 1).tolist()]
                found = [x for i, j in zip(starts, starts[1:]) if j - i > 1 for x in fn(held.slice(i, j - i))]
                held = held.slice(starts[-1])
                if found:
                    yield batch_of(found)
        if held is not None and held.num_rows > 1:
            yield batch_of(fn(held))

    return map_batches(rows.repartition(*key).sortWithinPartitions(*key), run, "a long, b long")


def _sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The members to compare: all with all in a block of one part, else those of one part with those of the other."""
    second = block.column("second").to_numpy()
    if not second.any():
        every = np.arange(block.num_rows)
        return every, every
    return np.flatnonzero(~second), np.flatnonzero(second)


def counted_blocks(members: DataFrame, sigs: DataFrame, least: int, coords: int) -> DataFrame:
    """Pairs (a, b) that join components, out of the postings' members that agree in ``least`` coordinates; each posting in blocks."""
    rows = members.join(sigs.select("node", "n_shingles", "sig"), "node").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("post", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).alias("second"), "node", "label", "n_shingles", "sig")

    def count(block: pa.Table) -> list[tuple[int, int]]:
        if block.column("p")[0] != block.column("q")[0] and len(set(block.column("second").to_pylist())) < 2:
            return []  # the other part is empty
        node, label, size = (block.column(c).to_numpy() for c in ("node", "label", "n_shingles"))
        sig = block.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, coords)

        def links(i: int, js: np.ndarray) -> np.ndarray:
            return ((sig[js] == sig[i]).sum(axis=1) >= least) & (np.minimum(size[js], size[i]) * 100 >= np.maximum(size[js], size[i]) * PER_CENT)

        return spanning(node, label, *_sides(block), links)

    return by_block(rows, ["post", "p", "q"], count).distinct()


def families(sigs: DataFrame, posts: DataFrame, least: int, coords: int) -> DataFrame:
    """node, label: the connected components of the candidate pairs."""
    hot = hot_keys(posts.groupBy("post").agg(F.count("*").alias("n")), "post", posts.count())
    first = split_join(posts, posts.groupBy("post").agg(F.min("node").alias("a")), "post", hot).select("a", F.col("node").alias("b"))
    labels = components(written(alike(often_met(first), sigs, least), "pairs"))
    left = written(mixed(posts, labels, hot), "mixed")
    drawn = left.groupBy("post").agg(F.min_by(F.struct("node", "label"), F.xxhash64("post", "node")).alias("x")).select("post", F.col("x.node").alias("a"), F.col("x.label").alias("la"))
    met = split_join(left, drawn, "post", hot).where("label <> la").select("a", F.col("node").alias("b"))
    labels = relabel(labels, written(alike(often_met(met), sigs, least), "pairs"))
    return relabel(labels, written(counted_blocks(mixed(posts, labels, hot), sigs, least, coords), "pairs"))


def compare_block(block: pa.Table) -> list[tuple[int, int]]:
    """Links that join components of a block's members, from exact intersections of their full sets."""
    if block.column("kind")[0].as_py() or block.column("p")[0] != block.column("q")[0]:
        if len(set(block.column("second").to_pylist())) < 2:
            return []  # the other part is empty
    node, label = (block.column(c).to_numpy() for c in ("node", "label"))
    column = block.column("members").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    owner = np.repeat(np.arange(len(node)), sizes)
    _, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[where]
    column_of, owner = (np.cumsum(shared) - 1)[where[keep]], owner[keep]
    order = np.argsort(column_of, kind="stable")
    column_of, owner = column_of[order], owner[order]
    rows, cols = _sides(block)
    both = np.zeros((len(node), len(node)), np.float32)
    wide = int(shared.sum())
    for lo in range(0, wide, 4096):
        i, j = np.searchsorted(column_of, (lo, lo + 4096))
        dense = np.zeros((len(node), min(4096, wide - lo)), np.float32)
        dense[owner[i:j], column_of[i:j] - lo] = 1
        both[np.ix_(rows, cols)] += dense[rows] @ dense[cols].T

    def links(i: int, js: np.ndarray) -> np.ndarray:
        met = both[i, js].astype(np.int64)
        return met * 100 >= (sizes[i] + sizes[js] - met) * PER_CENT

    return spanning(node, label, rows, cols, links)


def _parts(n: str | Column, w: str | Column) -> Column:
    """Parts of bounded size of ``n`` members with ``w`` hashes in all."""
    n, w = (F.col(x) if isinstance(x, str) else x for x in (n, w))
    return F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_SHINGLES)).cast("int")


def resolve(sets: DataFrame) -> DataFrame:
    """node, label: the components of the links, confirmed on full sets, within families; ``sets`` has node, family, members."""
    sizes = written(sets.groupBy("node", "family").agg(F.sum(F.size("members")).cast("long").alias("w")), "sizes")
    family = sizes.groupBy("family").agg(F.count("*").alias("n"), F.sum("w").alias("all_w"))
    n_nodes = sizes.count()
    all_rows = split_join(sizes, family, "family", total=n_nodes)
    is_large = (F.col("n") > BLOCK) | (F.col("all_w") > BLOCK_SHINGLES)
    large = all_rows.where(is_large)
    labels: DataFrame | None = None
    if not large.isEmpty():
        large = written(large, "large")
        long = sets.join(large.select("node", "n", "all_w").distinct(), "node")
        ids = large.groupBy("family").agg(*[F.min_by("node", F.xxhash64("node", F.lit(turn))).alias(f"a{turn}") for turn in range(DRAWN)])
        ids = ids.select("family", F.explode(F.array_distinct(F.array(*[f"a{turn}" for turn in range(DRAWN)]))).alias("a"))
        middle = written(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")).join(ids, "a").select("family", "a", "ma"), "middle")
        if (middle.agg(F.sum(F.size("ma"))).first()[0] or 0) <= BROADCAST_HASHES:
            met = long.join(F.broadcast(middle), "family")  # the members' sets stay where they are
        else:  # a family in parts, each with its own copy of the drawn members
            of_part = middle.join(large.select("family", _parts("n", "all_w").alias("parts")).distinct(), "family").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            met = long.withColumn("part", F.pmod(F.xxhash64("node"), _parts("n", "all_w")).cast("int")).join(of_part, ["family", "part"])
        met = met.where("node <> a").select("node", "a", F.size("members").alias("n"), F.size("ma").alias("na"), F.size(F.array_intersect("members", "ma")).alias("both"))
        links = met.where((F.col("n") + F.col("na") - F.col("both")) * PER_CENT <= F.col("both") * 100).select("a", F.col("node").alias("b"))
        labels = components(written(links, "links"))
    if labels is None:
        named = all_rows.withColumn("label", F.col("node"))
    else:
        named = all_rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named, "members")
    most = named.where(is_large).groupBy("family", "label").agg(F.count("*").alias("m"), F.sum("w").alias("main_w")).groupBy("family").agg(F.max_by(F.struct("label", "m", "main_w"), F.struct("m", "label")).alias("x")).select("family", F.col("x.label").alias("main"), F.col("x.m").alias("m"), F.col("x.main_w").alias("main_w"))
    parts = split_join(named, most, "family", how="left", total=n_nodes).withColumn("m", F.coalesce("m", F.lit(0))).withColumn("main_w", F.coalesce("main_w", F.lit(0))).where("m < n")
    parts = parts.withColumn("first", F.coalesce(F.col("label") == F.col("main"), F.lit(False))).withColumn("mp", _parts("m", "main_w")).withColumn("rp", _parts(F.col("n") - F.col("m"), F.col("all_w") - F.col("main_w")))
    part = F.pmod(F.xxhash64("node"), F.when(F.col("first"), F.col("mp")).otherwise(F.col("rp"))).cast("int")
    parts = parts.withColumn("part", part)
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    cross = lambda x, y, second: F.struct(F.lit(True).alias("kind"), x.cast("int").alias("p"), y.cast("int").alias("q"), F.lit(second).alias("second"))
    own = lambda x: F.struct(F.lit(False).alias("kind"), F.least(F.col("part"), x).alias("p"), F.greatest(F.col("part"), x).alias("q"), (F.col("part") > x).alias("second"))
    spots = F.when(F.col("first"), F.transform(upto("rp"), lambda x: cross(F.col("part"), x, False))).otherwise(F.concat(F.transform(upto("mp"), lambda x: cross(x, F.col("part"), True)), F.transform(upto("rp"), own)))
    blocks = parts.select("node", "family", "label", F.explode(spots).alias("x")).select("node", "family", "label", "x.*")
    rows = blocks.join(sets.select("node", "members"), "node")
    return relabel(labels, written(by_block(rows, ["family", "kind", "p", "q"], compare_block), "links"))


def near_duplicates(docs: DataFrame, words_each: int = 2, coords: int = COORDS, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links, itself included), kept (it is its component's).

    A null text, or one without words, has an empty set and links with nothing. Rows that share an id are one node.
    A null id can't be a component's; such a row is kept only if no other id is in its component, which is null then.
    An empty table gives no rows; other columns are not read.
    """
    found = written(features(docs, words_each, coords), "features")
    classes = found.where("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"))
    classes = written(classes, "classes")
    # every row of a class has its signature: the row of the smallest id stands for it
    sigs = found.join(classes.where("node is not null").select("fp1", "fp2", F.col("node").alias("doc_id")), ["fp1", "fp2", "doc_id"]).select(F.col("doc_id").alias("node"), "fp1", "fp2", "n_shingles", "sig").dropDuplicates(["node", "fp1", "fp2"])
    sigs = written(sigs, "signatures")
    posts = written(prefix_postings(sigs, least, coords), "postings")
    family = families(sigs, posts, least, coords).select(F.col("node").alias("doc_id"), F.col("label").alias("family"))
    near = F.broadcast(family) if family.count() <= BROADCAST_ROWS else family
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(near, "doc_id")
    labels = resolve(written(set_rows(texts, words_each), "sets"))
    named = found.join(classes, ["fp1", "fp2"], "left").select("doc_id", "n_shingles", "node")
    named = named.join(labels.select(F.col("node").alias("n2"), "label"), F.col("node") == F.col("n2"), "left")
    named = named.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("label", "node")))
    return named.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def by_rows(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with node: the id where no other row has it (``repeated`` has the ids of several rows), else a hash of the row; rows that repeat share one."""
    tie = F.xxhash64("doc_id", "text", "lang", "source", "n_chars")
    hot = repeated.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS)
    marked = split_join(docs.where("doc_id is not null"), repeated, "doc_id", hot, how="left")
    return marked.withColumn("node", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(tie)).drop("n").unionByName(docs.where("doc_id is null").withColumn("node", tie))


def keep_one(docs: DataFrame, words_each: int = 5) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id, with the columns of ``documents``.

    Documents without words all stay. Rows are judged each for itself, also those that share an id or have none: of rows with one
    id and different texts each stays that is no near copy of another; a null id is larger than any other, and ties go by
    a hash of the row. Of rows that repeat one stays.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    repeated = written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null"), "repeated")
    if repeated.isEmpty():
        kept = near_duplicates(docs, words_each).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi")
    rows = by_rows(docs, repeated.where("doc_id is not null"))
    found = written(near_duplicates(rows.select(F.col("node").alias("doc_id"), "text"), words_each), "components")
    named = found.where("n_shingles > 0").select(F.col("doc_id").alias("node"), "component_id").distinct().join(rows.select("node", F.col("doc_id").alias("own")), "node")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "node")).alias("x")).select(F.col("x.node").alias("node"))
    kept = rows.join(first, "node", "left_semi").dropDuplicates(["node"])
    bare = rows.join(found.where("n_shingles = 0").select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi")
    return kept.unionByName(bare).select(docs.columns)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document, on shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents"), 2)
