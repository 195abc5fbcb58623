"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, the minimum and the maximum, so a signature of 96
values takes 48 hash evaluations a shingle. Bands of four values name candidate buckets: a pair of
similarity 0.8 shares one of 24 bands but for 3 in a million.

Documents with the same shingle set collapse first and go on as one node. In a bucket, the member
that shares most buckets with others (the hub) is compared with each other member, which makes a
number of pairs linear in the bucket. Only where a bucket then still spans several components are
its members compared across components, block against block: first their signatures alone, which
tell the members that may have a partner in the other block (pairs whose signatures rule a
similarity of 0.8 out by five standard deviations are passed over), then the full sets of those
members, within the task, which hands on confirmed links alone. Blocks are bounded in members and in
shingles. A bucket of very many blocks is not compared so, as the rows sent would grow with its square:
its members are grouped anew by each of their rarest shingles. Sets of that similarity share one of
them whatever the order (prefix filter), so no link of the bucket is lost, and what many members
have in common puts none of them into a group. Every link is confirmed on the full shingle sets, of
64-bit hashes mixed from BLAKE2b numbers of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, anti_by_id, components, join_hot, known_id, semi_by_id, shown_id, unused
from .kernels import fixed_binary, min_max, mix64, random64, released, shingles, signed, slices, text_buffers

ROWS = 4
#: Members and shingles of a block, some, when a bucket is compared across components.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
#: Buckets of more blocks are grouped anew by rare shingles; counters, by the first bits of a shingle, that tell what is rare.
WIDE, COUNTERS_BITS = 16, 20
#: Rows of such blocks that one task compares, some.
COMPARED = 4000


def _features(k: int, n_hashes: int):
    n_bands = 2 * n_hashes // ROWS

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids, uids = batch.column("doc_id"), batch.column("uid")
            for i, j in slices(offsets):
                off = offsets[i : j + 1] - offsets[i]
                x, places = shingles(data[offsets[i] : offsets[j]], off, k)
                sets = [np.unique(x[s:e]) for s, e in zip(places[:-1], places[1:])]
                n = np.array([len(s) for s in sets], np.int64)
                sums = np.zeros((j - i, 2), np.uint64)
                if len(x):
                    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)])[:-1][n > 0]
                    for c in range(2):
                        sums[n > 0, c] = np.add.reduceat(mix64(flat ^ random64(2, 9)[c]), at)
                signature = min_max(x, places, n_hashes)
                grouped = signature.reshape(j - i, n_bands, ROWS).astype(np.uint64)
                bands = mix64((grouped * (random64(ROWS, 11) | np.uint64(1))).sum(2, dtype=np.uint64) + random64(n_bands, 12))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), uids.slice(i, j - i), pa.array(n), pa.array(signed(sums[:, 0].copy())), pa.array(signed(sums[:, 1].copy())), fixed_binary(signature), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * n_bands), pa.array(signed(bands.ravel())))],
                    names=["doc_id", "uid", "n", "s1", "s2", "sig", "bands"],
                )

    return released(run)


def _sets(k: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("uid")
            for i, j in slices(offsets):
                x, places = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                sets = [np.unique(x[s:e]).tobytes() for s, e in zip(places[:-1], places[1:])]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return released(run)


def _counted(batches):
    """How often each counter's shingles occur in the task's sets."""
    counts = np.zeros(1 << COUNTERS_BITS, np.int64)
    for batch in batches:
        for v in batch.column("shingles"):
            np.add.at(counts, np.frombuffer(v.as_buffer(), np.uint64) >> np.uint64(64 - COUNTERS_BITS), 1)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], names=["slot", "c"])


def _rarest(counts, percent: int):
    """Of a set of n its n - ceil(percent * n / 100) + 1 rarest shingles; equal counts go by value, so all sets have one order."""

    def run(batches):
        for batch in batches:
            for node, v in zip(batch.column("node").to_pylist(), batch.column("shingles")):
                x = np.frombuffer(v.as_buffer(), np.uint64)
                order = np.lexsort((x, counts.value[x >> np.uint64(64 - COUNTERS_BITS)]))
                x = signed(x[order[: len(x) + (-percent * len(x)) // 100 + 1]])
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), node))], names=["key", "node"])

    return released(run)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if out.num_rows:
                yield out

    return released(run)


def _sides(pdf):
    """The two blocks of a group; both are the same one where a block is compared with itself."""
    left, right = (pdf[pdf.side == s] for s in (0, 1))
    return (left, right) if len(left) and len(right) else (left, left) if len(left) else (right, right)


def _may_be_near(left, right, n_values: int, least: int, percent: int, band: int):
    """For each row of left, the rows of right in another component that signatures and sizes don't rule out.

    A pair counts in the first band that both share, so that one bucket alone compares its sets; groups
    by shingle have no band (-1) and take every pair.
    """
    sig = [np.frombuffer(b"".join(t.sig), np.uint32).reshape(len(t), n_values) for t in (left, right)]
    comp, sizes = [t.comp.to_numpy() for t in (left, right)], [t.n.to_numpy() for t in (left, right)]
    for i in range(len(left)):
        same = sig[1] == sig[0][i]
        near = (comp[1] != comp[0][i]) & (same.sum(1) >= least)
        near &= 100 * np.minimum(sizes[1], sizes[0][i]) >= percent * np.maximum(sizes[1], sizes[0][i])
        if band >= 0 and near.any():
            near &= same.reshape(len(same), -1, ROWS).all(2).argmax(1) == band
        yield near


def _candidates(n_values: int, least: int, percent: int):
    """The members of two blocks that may have a partner in the other one, by their signatures."""

    def run(pdf):
        left, right = _sides(pdf)
        paired = [np.zeros(len(left), bool), np.zeros(len(right), bool)]
        for i, near in enumerate(_may_be_near(left, right, n_values, least, percent, int(pdf.band.iloc[0]))):
            paired[0][i] = near.any()
            paired[1] |= near
        if left is right:
            return left[paired[0] | paired[1]]
        import pandas as pd

        return pd.concat([left[paired[0]], right[paired[1]]])

    return run


def _across(n_values: int, least: int, percent: int):
    """Links between different components of one bucket, block against block, on full sets."""

    def run(pdf):
        import pandas as pd

        left, right = _sides(pdf)
        node = [t.node.to_numpy() for t in (left, right)]
        sets = [[np.frombuffer(x, np.uint64) for x in t.shingles] for t in (left, right)]
        sizes = np.array([len(x) for x in sets[1]])
        known, ids = np.unique(np.concatenate(sets[1]), return_inverse=True)
        starts, mark = np.concatenate([[0], np.cumsum(sizes)])[:-1], np.zeros(len(known), np.int64)
        pairs = set()
        for i, near in enumerate(_may_be_near(left, right, n_values, least, percent, int(pdf.band.iloc[0]))):
            if near.any():
                at = np.minimum(np.searchsorted(known, sets[0][i]), len(known) - 1)
                at = at[known[at] == sets[0][i]]
                mark[at] = 1
                both = np.add.reduceat(mark[ids], starts)
                mark[at] = 0
                near &= 100 * both >= percent * (sizes + len(sets[0][i]) - both)
                pairs.update((min(node[0][i], y), max(node[0][i], y)) for y in node[1][near])
        return pd.DataFrame(sorted(pairs), columns=["a", "b"]).astype("int64")

    return run


def _open_groups(named: DataFrame) -> DataFrame:
    """Keys of more than one component: key, size, blocks."""
    keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("lo <> hi")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return keys.select("key", "size", blocks.alias("blocks"))


def _by_rare_shingles(named: DataFrame, wide: DataFrame, texts: DataFrame, k: int, percent: int, work: Workspace) -> DataFrame:
    """The members of wide buckets as rows (key, band, node, n, comp) with a key for each of their rarest shingles."""
    spark = named.sparkSession
    members = work.save(join_hot(named, wide, ["key"], counted="size").select("node", "n", "comp").distinct(), "wide-members")
    sets = work.save(semi_by_id(texts, "uid", members, "node", work).mapInArrow(_sets(k), "node long, shingles binary"), "wide-sets")
    found = sets.mapInArrow(released(_counted), "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toPandas()  # 2^20 rows at most
    counts = np.zeros(1 << COUNTERS_BITS, np.int64)
    counts[found.slot.to_numpy()] = found.c.to_numpy()
    rare = sets.mapInArrow(_rarest(spark.sparkContext.broadcast(counts), percent), "key long, node long")
    rows = work.save(rare.join(members, "node").select("key", F.lit(-1).alias("band"), "node", "n", "comp"), "wide")
    work.drop(sets, members)
    return rows


def _links_across(named: DataFrame, keys: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, n_values: int, work: Workspace) -> DataFrame | None:
    """Confirmed links (a, b) between components within the groups of named that keys lists, compared block against block."""
    to_compare = keys.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0]
    if not to_compare:
        return None
    least = int(n_values * percent / 100 - 5 * np.sqrt(n_values * percent / 100 * (1 - percent / 100)))
    # Comparisons cost more than bytes tell, so the number of tasks is given by rows.
    tasks = -(-to_compare // COMPARED)
    rest = join_hot(named, keys, ["key"], counted="size").join(reps.select("node", "sig"), "node")
    rest = rest.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") <= F.col("other"), 0).otherwise(1)
    rest = rest.select("key", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), side.alias("side"), "node", "comp", "n", "sig")
    rest = rest.repartition(tasks, "key", "i", "j")
    may = work.save(rest.groupBy("key", "i", "j").applyInPandas(_candidates(n_values, least, percent), rest.schema), "candidates")
    ends = may.select("node").distinct()
    sets = work.save(semi_by_id(texts, "uid", ends, "node", work).mapInArrow(_sets(k), "node long, shingles binary"), "sets")
    more = may.join(sets, "node").repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInPandas(_across(n_values, least, percent), "a long, b long").distinct()
    more = work.save(more, "links")
    work.drop(sets, may)
    return more


def _repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, n_hashes: int = 48) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| over their sets of k-word
    shingles; component_id is the smallest id reachable over links, and that document is kept.
    Null or wordless text: an empty set, linked with nothing. A null id sorts before all others and
    shows as null again; rows that share an id are each judged by their own text. Other columns of docs,
    whatever their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "minhash")
    texts = docs.select(known_id(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    repeated = _repeated(texts)
    # Where ids repeat, each row has a number of its own; the table is written once, so the numbers stay.
    texts = work.save(texts.withColumn("uid", F.monotonically_increasing_id()), "texts") if repeated else texts.withColumn("uid", F.col("doc_id"))
    n_values = 2 * n_hashes
    feats = work.save(texts.mapInArrow(_features(k, n_hashes), "doc_id long, uid long, n long, s1 long, s2 long, sig binary, bands array<long>"), "features")
    nodes = feats.filter("n > 0").groupBy("s1", "s2").agg(F.min("uid").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = work.save(nodes, "nodes")
    # By uid, which no two rows share, so that the copies of one text don't meet in a task.
    reps = feats.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), "n", "sig", "bands")
    reps = work.save(reps, "representatives")

    rows = reps.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = work.save(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    members = work.save(join_hot(rows, shared, ["key"], counted="c", total=reps.count() * n_values // ROWS), "members")
    score = members.groupBy("node").agg(F.sum("c").alias("score"))
    hubs = members.join(score, "node").groupBy("key").agg(F.max(F.struct("score", F.bitwise_not("node").alias("turned"), "n", "node")).alias("h"), F.count("*").alias("size"))
    hubs = work.save(hubs, "hubs")
    first = join_hot(members, hubs, ["key"], counted="size").filter("node <> h.node").filter(F.lit(100) * F.least("n", "h.n") >= F.lit(percent) * F.greatest("n", "h.n"))
    first = work.save(first.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct(), "pairs")

    ends = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = work.save(semi_by_id(texts, "uid", ends, "node", work).mapInArrow(_sets(k), "node long, shingles binary"), "sets")
    joined = first.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    links = work.save(joined.mapInArrow(_confirm(percent), "a long, b long").distinct(), "links")
    work.drop(sets, first)
    labels = components(links, work)

    named = work.save(members.join(labels, "node", "left").select("key", "band", "node", "n", F.coalesce("comp", "node").alias("comp")), "named")
    work.drop(members)
    open_keys = work.save(_open_groups(named).filter("size > 2"), "open")
    compared = [(named, open_keys.filter(F.col("blocks") <= WIDE))]
    wide = open_keys.filter(F.col("blocks") > WIDE)
    if not wide.isEmpty():
        rare = _by_rare_shingles(named, wide, texts, k, percent, work)
        compared.append((rare, work.save(_open_groups(rare), "open")))
    more = [x for rows, keys in compared if (x := _links_across(rows, keys, reps, texts, k, percent, n_values, work)) is not None]
    more = [x for x in more if not x.isEmpty()]
    if more:
        for x in more:
            links = links.unionByName(x)
        labels = components(links, work)
    work.drop(named)
    found = nodes.join(labels, "node", "left").select("s1", "s2", "least", "copies", F.coalesce("comp", "node").alias("comp"))
    if repeated:
        found = work.save(found, "found")
        found = join_hot(found, found.groupBy("comp").agg(F.min("least").alias("first")), ["comp"]).select("s1", "s2", "copies", F.col("first").alias("comp"))
    found = work.save(found.select("s1", "s2", "comp", "copies"), "found")
    out = join_hot(feats.select("doc_id", "n", "s1", "s2"), found, ["s1", "s2"], "left", counted="copies")
    comp = F.coalesce("comp", "doc_id")
    return out.select(shown_id(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown_id(comp).alias("component_id"), (F.col("doc_id") == comp).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, and all others, with all columns of docs.

    It is the row with the least id; of rows that share that id, the one whose text has the least SHA-256.
    """
    work = Workspace(docs.sparkSession, "minhash")
    if not _repeated(docs.select(known_id("doc_id").alias("doc_id"))):
        marked = near_duplicates(docs, k=k, percent=percent).filter("not kept").select(known_id("doc_id").alias("doc_id"))
        return anti_by_id(docs, "doc_id", marked, "doc_id", work)
    row = unused("row", docs.columns)
    rows = work.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    marked = work.save(near_duplicates(rows, row, k=k, percent=percent).select(F.col("doc_id").alias("row"), "component_id"), "marked")
    order = rows.select(F.col(row).alias("row"), known_id("doc_id").alias("id"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("sha"))
    first = marked.join(order, "row").groupBy("component_id").agg(F.min(F.struct("id", "sha", "row")).alias("first"))
    marked = marked.join(first.select(F.col("first.row").alias("row")), "row", "left_anti")
    return anti_by_id(rows, row, marked, "row", work).drop(row)
