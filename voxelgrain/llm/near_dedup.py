"""Near-duplicate documents by an LSH forest.

Each distinct shingle set gets a signature of min-hashes. Every tree sorts the sets by the signature, begun at another
place; neighbours in an order share the longest common prefixes, so they are the candidates. A pair counts when the
common prefix is at least ``least_depth`` long; in a dense region the nearest neighbours share far deeper prefixes, so the
depth adapts to the region and no region is ever gathered.

The forest is walked in rounds. In each, a set proposes one link, to the likeliest of its neighbours that lies in another
component; links are verified on full sets and components are contracted. Only heads where components met and that still
hold several are sorted again, until a round links next to nothing. What neighbours can't see, such as pairs in regions with
more sets than a window holds, then has an exact way: among the sets that still share a head with another component, a prefix filter on their
rarest shingles leaves out no pair that may link. So the components don't depend on windows or partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_stage, refuse_own_names
from .textkernel import mix, shingle_sets


@dataclass(frozen=True)
class ForestConfig:
    """``width`` words a shingle; a link needs ``100 * intersection >= percent * union``. Trees begin every ``depth``
    min-hashes of the signature (64 trees at most). A set looks at ``near`` predecessors in each order, from the second
    round on at ``reach``. Up to ``broadcast_ids`` ids are broadcast to filter by, more are joined by shuffle. Shingles in
    fewer than ``rare`` sets count as equally rare; the limit doubles until at most ``common`` shingles are above it.

    A link is missed only where two sets share no run of ``least_depth`` min-hashes at the head of any tree, probability
    (1 - s^least_depth)^trees at similarity s: 3e-8 at 0.80, but 4 % at 0.50. Bounds under 0.8 need more trees, or a smaller
    ``least_depth``, for the same certainty."""

    width: int = 5
    percent: int = 80
    trees: int = 24
    depth: int = 10
    least_depth: int = 3
    near: int = 4
    reach: int = 96
    seed: int = 5
    broadcast_ids: int = 1_000_000
    rare: int = 8
    common: int = 1_000_000

    @property
    def hashes(self) -> int:
        return self.trees * self.depth

    @property
    def likely(self) -> float:
        """Neighbours with a lower estimate are not proposed: six standard errors under the bound."""
        j = self.percent / 100
        return j - 6 * (j * (1 - j) / self.hashes) ** 0.5


def signatures(sets: list[np.ndarray], config: ForestConfig) -> tuple[np.ndarray, np.ndarray]:
    """Of each non-empty set: the heads of all trees (``least_depth`` min-hashes of 16 bits) and the whole signature in bytes."""
    rng = np.random.default_rng(config.seed)
    factor = rng.integers(1, 1 << 63, config.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, config.hashes, dtype=np.uint64)
    out = np.empty((len(sets), config.hashes), np.uint64)
    for k, own in enumerate(sets):
        low = np.full(config.hashes, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(own), 512):
            low = np.minimum(low, (own[i : i + 512, None] * factor + shift).min(axis=0))
        out[k] = low
    out = mix(out)
    heads = (out >> np.uint64(48)).astype(">u2").reshape(len(sets), config.trees, config.depth)[:, :, : config.least_depth]
    return np.ascontiguousarray(heads), (out >> np.uint64(8)).astype(np.uint8)


def _features(config: ForestConfig):
    names, types = ["n", "digest", "heads", "sig"], (pa.int64(), pa.binary(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, start = [], 0
            for own in shingle_sets(batch.column(2), config.width, lower=True):
                held.append(own)
                if len(held) == 512 or start + len(held) == batch.num_rows:
                    made = iter(zip(*signatures([s for s in held if len(s)], config), strict=True))
                    rows = []
                    for s in held:
                        if len(s):
                            heads, sig = next(made)
                            rows.append((len(s), _digest(s), heads.tobytes(), sig.tobytes()))
                        else:
                            rows.append((0, None, None, None))
                    part = batch.slice(start, len(held))
                    start, held = start + len(held), []
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", "th", *names])

    return run


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _sets(config: ForestConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in held], pa.binary()), shingles], ["digest", "shingles"])

        held, size = [], 0
        for batch in batches:
            for own in shingle_sets(batch.column(0), config.width, lower=True):
                if len(own):
                    held.append(own)
                    size += len(own)
                if size > 1 << 19:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    return run


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The elements of each list of 64-bit numbers, unsigned."""
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = column.offsets.to_numpy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield values[a:b]


def _neighbours(config: ForestConfig, reach: int):
    """Of each set in a sorted partition its likeliest neighbour in another component, among ``reach`` predecessors that
    share its head: a window slides over the order."""

    def best_of(tree, head, n, comp, sig) -> tuple[np.ndarray, np.ndarray]:
        rows = len(tree)
        best = np.full(rows, -1.0, np.float32)
        best_at = np.zeros(rows, np.int64)
        for lag in range(1, min(reach, rows - 1) + 1):
            a, b = np.arange(rows - lag), np.arange(lag, rows)
            same = (tree[a] == tree[b]) & (head[a] == head[b])
            if not same.any():
                break
            low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            hit = np.flatnonzero(same & (comp[a] != comp[b]) & (100 * low >= config.percent * high))
            if not len(hit):
                continue
            likeness = (sig[a[hit]] == sig[b[hit]]).mean(axis=1, dtype=np.float32)
            better = (likeness >= config.likely) & (likeness > best[b[hit]])
            best[b[hit[better]]], best_at[b[hit[better]]] = likeness[better], a[hit[better]]
        return best, best_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                now = (
                    batch.column(0).to_numpy(zero_copy_only=False),
                    np.array([int.from_bytes(x, "big") for x in batch.column(1).to_pylist()], np.int64),
                    np.array(batch.column(2).to_pylist(), object),
                    batch.column(3).to_numpy(zero_copy_only=False),
                    batch.column(4).to_numpy(zero_copy_only=False),
                    np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(len(batch), -1),
                )
                old = 0 if tail is None else len(tail[0])
                tree, head, digest, n, comp, sig = now if tail is None else (np.concatenate(x) for x in zip(tail, now, strict=True))
                best, best_at = best_of(tree, head, n, comp, sig)
                row = old + np.flatnonzero(best[old:] >= 0)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(digest[row], pa.binary()), pa.array(digest[best_at[row]], pa.binary()), pa.array(best[row])], ["digest", "other", "likeness"])
                tail = tuple(x[-reach:] for x in (tree, head, digest, n, comp, sig))

    return run


def _confirm(config: ForestConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True):
                if 100 * min(len(x), len(y)) < config.percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                merged = np.sort(np.concatenate([x, y]), kind="stable")
                both = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(100 * both >= config.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _rarest(common: np.ndarray, times: np.ndarray, config: ForestConfig):
    """The first shingles of each set in an order common to all, rare ones first: two sets that link share one of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in enumerate(_lists(batch.column(2))):
                n = len(own)
                sets = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    sets = np.where(common[at] == own, times[at], 0)
                first = own[np.lexsort((own, sets))][: n + 1 + -config.percent * n // 100]
                m = len(first)
                columns = [first.view(np.int64), np.arange(m), np.full(m, n), *(np.full(m, batch.column(k)[i].as_py()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["token", "place", "n", "who", "comp"])

    return run


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Label every node with the smallest ``rank`` that it can reach.

    ``nodes`` (digest, rank), ``links`` (a, b) over digests. Each step takes the least label of the neighbours, then
    the label of the node that this label names (pointer jumping), and is written out; it ends when none changed.
    Returns a written frame with digest and label of the nodes with a link only.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    touched = both.select(F.col("a").alias("digest")).distinct()
    labels = cut(nodes.join(touched, "digest", "left_semi").select("digest", "rank", F.col("rank").alias("label"), F.lit(True).alias("moved")), "labels", slim=True)
    both = cut(both, "links", slim=True)
    while True:
        from_next = both.join(labels.select(F.col("digest").alias("b"), "label"), "b").groupBy(F.col("a").alias("digest")).agg(F.min("label").alias("near"))
        lower = labels.join(from_next, "digest").select("digest", "rank", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        heads = labels.groupBy(F.col("rank").alias("label")).agg(F.min("label").alias("ahead"))
        jumped = lower.join(heads, "label", "left").select("digest", "rank", "old", F.least("label", F.coalesce("ahead", "label")).alias("label"))
        after = cut(jumped.select("digest", "rank", "label", (F.col("label") < F.col("old")).alias("moved")), "labels", slim=True)
        drop_stage(labels)
        labels = after
        if labels.where("moved").limit(1).count() == 0:
            drop_stage(both)
            return labels


def _row_hash() -> F.Column:
    return F.xxhash64("text")


def _labelled(docs: DataFrame, config: ForestConfig) -> DataFrame:
    """doc_id, th (hash of the text), n, digest and label of every row. A label names the first row of a component: whether
    it lacks an id, its id, the digest of its set, its text's hash. Rows without words have no digest and no label."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def few(ids: DataFrame) -> DataFrame:
        """Ids to filter by: broadcast behind a look at their number, else joined by shuffle."""
        return F.broadcast(ids) if ids.count() <= config.broadcast_ids else ids

    features = cut(docs.select("doc_id", _row_hash().alias("th"), "text").mapInArrow(_features(config), "doc_id long, th long, n long, digest binary, heads binary, sig binary"), "features")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), "th")).alias("first")
    reps = features.where("digest is not null").groupBy("digest").agg(first, F.min("n").alias("n"), F.min("heads").alias("heads"), F.min("sig").alias("sig"))
    rank = F.struct("first.nameless", "first.id", "digest", "first.th").alias("rank")
    reps = cut(reps.select("digest", rank, "n", "heads", "sig"), "reps")

    wide = 2 * config.least_depth
    heads = [F.substring("heads", 1 + wide * t, wide) for t in range(config.trees)]
    # the low six bits of a key are its tree
    tree_keys = F.array(*[F.shiftleft(F.xxhash64(F.lit(t), h), 6).bitwiseOR(F.lit(t).cast("long")) for t, h in enumerate(heads)])

    def in_trees(mask: str) -> F.Column:
        return F.array_compact(F.transform(tree_keys, lambda x: F.when(F.getbit(mask, x.bitwiseAND(F.lit(63)).cast("int")) != 0, x)))

    def mixed(keyed: DataFrame) -> DataFrame:
        """who and the trees, as bits, in which a set of ``keyed`` (who, comp, key) shares its head with another component;
        with a column ``met``, heads where it is never true are left out."""
        met = F.max("met") if "met" in keyed.columns else F.lit(True)
        several = keyed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), met.alias("met")).where("low <> high and met").select("key")
        return keyed.join(several, "key").groupBy("who").agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("mask"))

    own = reps.withColumn("who", F.xxhash64("digest"))
    masks = cut(mixed(own.select("who", F.col("who").alias("comp"), F.explode(tree_keys).alias("key"))), "masks", slim=True)
    active = cut(own.join(few(masks), "who"), "active")

    wanted = cut(active.select(F.col("rank.id").alias("_id"), F.col("rank.th").alias("_th")), "wanted", slim=True)
    is_wanted = lambda x, at: x["doc_id"].eqNullSafe(F.col("_id")) & (at == F.col("_th"))
    chosen = docs.join(few(wanted), is_wanted(docs, _row_hash()), "left_semi")
    bodies = chosen.select("text").mapInArrow(_sets(config), "digest binary, shingles array<bigint>")
    twins = features.join(few(wanted), is_wanted(features, features["th"]), "left_semi").groupBy("doc_id", "th").count().where("count > 1")
    if twins.limit(1).count():
        bodies = bodies.dropDuplicates(["digest"])
    sets = cut(bodies, "sets")

    def proposed(rows: DataFrame, reach: int) -> DataFrame:
        """One pair for each set of ``rows`` with a likely neighbour in another component."""
        turned = [F.concat(F.substring("sig", 1 + config.depth * t, config.hashes), F.substring("sig", 1, config.depth * t)) for t in range(config.trees)]
        trees = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << t)) != 0, F.struct(F.lit(t).alias("tree"), h.alias("head"), turned[t].alias("turned"))) for t, h in enumerate(heads)]))
        order = rows.select(F.explode(trees).alias("t"), "digest", "n", "comp").select("t.tree", "t.head", "digest", "n", "comp", "t.turned")
        order = order.repartitionByRange(parts, "tree", "head", "turned", "digest").sortWithinPartitions("tree", "head", "turned", "digest")
        found = order.mapInArrow(_neighbours(config, reach), "digest binary, other binary, likeness float")
        best = found.groupBy("digest").agg(F.max(F.struct("likeness", "other")).alias("best"))
        return best.select(F.least("digest", "best.other").alias("a"), F.greatest("digest", "best.other").alias("b")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that link. Sets meet their pairs where they lie, if these are few, and move once to meet each other."""
        pairs = cut(pairs, "pairs", slim=True)
        near = F.broadcast if pairs.count() <= config.broadcast_ids else (lambda ids: ids)
        one = sets.join(near(pairs.withColumnRenamed("a", "digest")), "digest").select(F.col("digest").alias("a"), "b", F.col("shingles").alias("shingles_a"))
        two = sets.join(near(pairs.select(F.col("b").alias("digest")).distinct()), "digest", "left_semi").select(F.col("digest").alias("b"), F.col("shingles").alias("shingles_b"))
        return cut(one.join(two, "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(_confirm(config), "a binary, b binary"), "links")

    def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
        labels = labels.select("digest", "label")
        one, two = (labels.select(F.col("digest").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
        edges = cut(links.join(one, "a").join(two, "b").select("label_a", "label_b").distinct(), "edges", slim=True)
        nodes = edges.select(F.explode(F.array("label_a", "label_b")).alias("rank")).distinct().select("rank.digest", "rank")
        found = connected_components(nodes, edges.select(F.col("label_a.digest").alias("a"), F.col("label_b.digest").alias("b")))
        found = found.select(F.col("digest").alias("_head"), F.col("label").alias("_better"))
        met = F.col("_better").isNotNull().alias("met")
        return cut(labels.join(found, F.col("label.digest") == F.col("_head"), "left").select("digest", F.coalesce("_better", "label").alias("label"), met), "labels", slim=True)

    def unseen(rows: DataFrame) -> DataFrame:
        """All pairs of ``rows`` in different components that may link.

        A set with n shingles that links with one of m has at least ``need = percent * (n + m) / (100 + percent)`` of them in
        common; so the first common shingle, in any order, stands at a place that leaves ``need`` in both. Shingles meet by
        value, and pairs within the component that holds most sets with a shingle are never formed.
        """
        rows = rows.select("digest", "who", "comp")
        held = sets.join(few(rows), "digest").select("who", "comp", "shingles")
        counts = cut(held.select(F.explode("shingles").alias("token")).groupBy("token").agg(F.count("*").alias("times")).where(F.col("times") >= config.rare), "counts")
        sizes = {r["bits"]: r["count"] for r in counts.groupBy(F.length(F.bin("times")).alias("bits")).count().collect()}
        bits = 0
        while sum(n for b, n in sizes.items() if b >= bits) > config.common:
            bits += 1
        common = counts.where(F.length(F.bin("times")) >= bits).toArrow()
        values, times = (common.column(c).to_numpy() for c in ("token", "times"))
        at = np.argsort(values.view(np.uint64))
        tokens = cut(held.mapInArrow(_rarest(values.view(np.uint64)[at], times[at], config), "token long, place long, n long, who long, comp long"), "tokens")
        several = tokens.groupBy("token", "comp").count().groupBy("token").agg(F.max(F.struct("count", "comp")).alias("most"), F.count("*").alias("comps")).where("comps > 1")
        met = cut(tokens.join(several.select("token", F.col("most.comp").alias("main")), "token"), "met")
        one = met.where("comp <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in ("place", "n", "who", "comp")])
        two = met.select("token", "main", *[F.col(c).alias(f"{c}_b") for c in ("place", "n", "who", "comp")])
        need = config.percent * (F.col("n_a") + F.col("n_b"))
        leaves = [(100 + config.percent) * (F.col(f"n_{x}") - F.col(f"place_{x}")) >= need for x in "ab"]
        once = (F.col("comp_b") == F.col("main")) | (F.col("who_a") < F.col("who_b"))
        found = one.join(two, "token").where((F.col("comp_a") != F.col("comp_b")) & once & leaves[0] & leaves[1]).select("who_a", "who_b").distinct()
        names = few(rows.select("who", "digest"))
        for x in "ab":
            found = found.join(names.select(F.col("who").alias(f"who_{x}"), F.col("digest").alias(x)), f"who_{x}")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    labels = cut(active.select("digest", F.col("rank").alias("label")), "labels", slim=True)
    bare = active.drop("rank")
    rows = bare.withColumn("comp", F.col("who"))
    links, total = confirmed(proposed(rows, config.near)), active.count()
    # rounds go on while they link as many as one set in a hundred; fewer are left to the exact end
    while n := links.count():
        labels = contracted(labels, links)
        rows = bare.join(labels, "digest").withColumn("comp", F.xxhash64("label.digest")).drop("label")
        if 100 * n < total:
            break
        # proposals change only for members of components that met; heads without them need no second look
        keyed = rows.select("who", "comp", "met", F.explode(in_trees("mask")).alias("key"))
        masks = cut(mixed(keyed), "masks", slim=True)
        links = confirmed(proposed(rows.drop("mask").join(few(masks), "who"), config.reach))
    left = rows.select("digest", "who", "comp", F.explode(in_trees("mask")).alias("key"))
    rest = cut(rows.select("digest", "who", "comp").join(few(cut(mixed(left), "masks", slim=True)), "who").drop("mask"), "rest", slim=True)
    if rest.limit(1).count():
        links = confirmed(unseen(rest))
        if links.limit(1).count():
            labels = contracted(labels, links)
    for stage in (active, sets):
        drop_stage(stage)
    named = reps.select("digest", "rank").join(labels.select("digest", "label"), "digest", "left").select("digest", F.coalesce("label", "rank").alias("label"))
    return features.select("doc_id", "th", "n", "digest").join(named, "digest", "left")


def near_duplicates(docs: DataFrame, config: ForestConfig = ForestConfig()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are maximal runs without white space, A-Z lower-cased; a text of fewer than ``width`` words is one shingle.
    Defined cases: a null or wordless text has no shingle and is its own component; rows with equal sets share one;
    a null id never names a component unless all its ids are null; a set is known by its digest, so an id that stands on
    several texts does not join them; an empty table gives no rows; other columns are not read.
    """
    component = F.coalesce(F.when(~F.col("label.nameless"), F.col("label.id")), "doc_id")
    out = _labelled(docs, config)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_representatives(docs: DataFrame, config: ForestConfig = ForestConfig()) -> DataFrame:
    """One row of each group of near duplicates, all columns: the smallest id; a null id only where no row has one; of rows
    that repeat id and text, one. Rows without words all stay. An id that stands on several texts is judged by each text. Columns named ``__vg_...`` raise
    ValueError."""
    refuse_own_names(docs)
    names = docs.columns
    rows = _labelled(docs, config).where("digest is not null")
    first = F.col("doc_id").eqNullSafe(F.col("label.id")) & (F.col("digest") == F.col("label.digest")) & (F.col("th") == F.col("label.th"))
    decided = cut(rows.select(F.col("doc_id").alias("__vg_id"), F.col("th").alias("__vg_th"), first.alias("__vg_first")), "decided", slim=True)
    gone = cut(decided.where("not __vg_first").select("__vg_id", "__vg_th").distinct(), "gone", slim=True)
    here = docs["doc_id"].cast("long").eqNullSafe(F.col("__vg_id")) & (F.xxhash64(docs["text"]) == F.col("__vg_th"))
    left = docs.join(F.broadcast(gone) if gone.count() <= config.broadcast_ids else gone, here, "left_anti")
    again = decided.where("__vg_first").groupBy("__vg_id", "__vg_th").count().where("count > 1").select("__vg_id", "__vg_th")
    again = cut(again, "again", slim=True)
    if not again.limit(1).count():
        return left
    here = left["doc_id"].cast("long").eqNullSafe(F.col("__vg_id")) & (F.xxhash64(left["text"]) == F.col("__vg_th"))
    repeated = left.join(again, here, "left_semi").withColumns({"__vg_id": F.col("doc_id").cast("long"), "__vg_th": _row_hash()})
    return left.join(again, here, "left_anti").union(repeated.dropDuplicates(["__vg_id", "__vg_th"]).select(*names))
