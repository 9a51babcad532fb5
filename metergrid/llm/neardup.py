"""Near-duplicate documents by a MinHash LSH forest.

1. Each text becomes a set of word shingles (64-bit hashes), a digest of the set and a signature of TREES x DEPTH
   MinHash values. Texts with equal sets are one class from here on, so a group of copies is one entry.
2. The forest: each tree puts the classes in the order of its part of the signature. Classes with a common prefix of
   `shallow` values are a region. In a region, the neighbours in the order (the longest common prefixes) are compared by
   their whole signatures, then those that the chain of neighbours leaves apart, and plausible pairs (not over five
   standard deviations below the wanted similarity) are joined. A region of more than RUN classes is joined in whole.
   What hangs together over all trees is a block: no link leaves it.
3. Texts travel once, to their block. A task compares the full sets of a block through the postings of their shingles,
   asks for no pair that is already joined, and returns the links that join its components: fewer than classes.
4. A block of more than RUN classes is deepened: it is cut along the sorted signatures into runs, within which
   neighbours have longer prefixes in common. A run is compared as a block is. Then each run sends a member of its
   largest component to a smaller block of such hubs, and so on, until one run is left.
5. So that no link is lost between runs: classes outside their block's largest component are sent to each run with
   which they share a region, where that holds a class of another component, and compared on full sets there.

Links within one component can't change the result, so they need not all be found. Tables are deleted after use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.llm.common import Scratch, arrow_map, flat_bytes, release, sliced, whole_groups, written
from metergrid.llm.components import connected_components
from metergrid.llm.shingles import set_digests, shingle_sets, signatures

TREES, DEPTH = 16, 8
#: Classes and shingles that a task compares at once; one text may have more shingles.
RUN, RUN_SHINGLES = 512, 1 << 21
#: Bytes of text whose shingles are hashed at once; the running sums and words of a slice take some 50 times as many.
SLICE = (1 << 20) - 1


def sets_of(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets() of a column, slice by slice."""
    if texts.nbytes <= SLICE:
        return shingle_sets(*flat_bytes(texts), words)
    parts = [shingle_sets(*flat_bytes(x.column("text")), words) for x in sliced(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", SLICE)]
    return np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in parts]))])


def text_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n_shingles, d1, d2, sig) of each row."""
    outputs = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("sig", T.BinaryType())])

    def make():
        def step(part: pa.RecordBatch):
            values, offsets = shingle_sets(*flat_bytes(part.column(text_col)), words)
            digests = set_digests(values, offsets)
            sig = signatures(values, offsets, TREES * DEPTH)
            return np.diff(offsets), digests[:, 0], digests[:, 1], [x.tobytes() for x in sig]

        return step

    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col)), text_col, outputs, make, ["id"], SLICE)


def regions(classes: DataFrame, shallow: int) -> DataFrame:
    """(r, tree, c, n, low) of the classes c whose region r has others in it: n of them, low the smallest."""
    prefixes = F.expr(f"transform(sequence(0, {TREES - 1}), t -> xxhash64(t, substring(sig, t * {2 * DEPTH} + 1, {2 * shallow})))")
    rows = classes.select("c", F.posexplode(prefixes).alias("tree", "r")).select("r", F.col("tree").cast("byte").alias("tree"), "c")
    sizes = rows.groupBy("r").agg(F.count("*").alias("n"), F.min("c").alias("low")).where("n > 1")
    return rows.join(sizes, "r")


def spanning_links(near: Callable[[int], np.ndarray], label: np.ndarray, asks: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links (i, j) that join the components of a graph, and the labels after them. near(i) gives the neighbours of i;
    only members that `asks` marks are asked for them, and those of the largest component only if it may have others
    outside that weren't asked. label: numbers from 0, equal for members that are joined already."""
    links, label, asked = [], label.copy(), np.zeros(len(label), bool)
    while True:
        outside = label != np.bincount(label).argmax()
        todo = np.flatnonzero(asks & ~asked & outside)
        if not len(todo) and (outside & ~asked).any():
            todo = np.flatnonzero(asks & ~asked)
        if not len(todo):
            return links, label
        i = int(todo[0])
        asked[i] = True
        other = np.flatnonzero(near(i) & (label != label[i]))
        found, at = np.unique(label[other], return_index=True)
        links += [(i, int(j)) for j in other[at]]
        label[np.isin(label, found)] = label[i]


PAIRS = "a long, b long"


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.array(np.minimum(a, b), pa.int64())], names=["a", "b"])


def plausible(rows: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """Pairs that join the plausible components of regions of RUN classes at most."""
    k = TREES * DEPTH
    least = k * share - 5 * np.sqrt(k * share * (1 - share))
    near = rows.join(classes.select("c", "sig"), "c")
    ordered = near.select("r", F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("key"), "c", "sig").repartition("r").sortWithinPartitions("r", "key", "c").select("r", "c", "sig")

    def run(batches):
        for table in whole_groups(batches, "r"):
            r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, k)
            same = r[1:] == r[:-1]
            held = same & ((sig[1:] == sig[:-1]).sum(axis=1) >= least)
            a, b = [c[1:][held]], [c[:-1][held]]
            for start in np.unique(np.searchsorted(r, r[1:][same & ~held])):
                end = np.searchsorted(r, r[start], "right")
                part = sig[start:end]
                chain = np.concatenate([[0], np.cumsum(~held[start : end - 1])])
                found, _ = spanning_links(lambda i, part=part: (part == part[i]).sum(axis=1) >= least, chain, np.ones(end - start, bool))
                if found:
                    x, y = np.array(found).T
                    a.append(c[start + x])
                    b.append(c[start + y])
            yield _pairs(np.concatenate(a), np.concatenate(b))
            del table, sig
        release()

    return ordered.mapInArrow(run, PAIRS).distinct()


#: A class counts as so many shingles at least, so that a run has RUN classes at most.
LEAST_WEIGHT = RUN_SHINGLES // RUN


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, c, block, w, upto): the weights of a sorted partition's classes, summed up to each."""
    from pyspark import TaskContext

    part, upto = TaskContext.get().partitionId(), 0
    for batch in batches:
        w = np.maximum(batch.column("n").to_numpy(), LEAST_WEIGHT)
        sums = upto + np.cumsum(w)
        upto = int(sums[-1]) if len(sums) else upto
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), part, np.int32)), batch.column("c"), batch.column("block"), pa.array(w), pa.array(sums)], names=["part", "c", "block", "w", "upto"])


def runs_of(members: DataFrame, classes: DataFrame, tmp: Scratch) -> DataFrame:
    """(c, block, g, large) of members (c, block): the group g in which a class is compared, the block itself or a run.
    Runs are cut from the order of all large blocks' classes by running sums of weights, over partitions and within
    them, so they don't depend on how many partitions there are."""
    members = tmp.written(members.join(classes.select("c", "n_shingles", "sig"), "c").select("c", "block", F.col("n_shingles").alias("n"), F.expr(f"substring(sig, 1, {2 * DEPTH})").alias("key")), "members")
    sizes = members.groupBy("block").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1")
    sized = members.join(sizes, "block").withColumn("large", (F.col("m") > RUN) | (F.col("s") > RUN_SHINGLES))
    large = tmp.written(sized.where("large").select("block", "key", "c", "n"), "large")
    parts = max(1, large.count() // (8 * RUN))
    ordered = large.repartitionByRange(parts, "block", "key", "c").sortWithinPartitions("block", "key", "c")
    placed = tmp.written(ordered.mapInArrow(_placed, "part int, c long, block long, w long, upto long"), "placed")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = placed.groupBy("part").agg(F.sum("w").alias("held")).select("part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("start"))
    run = F.floor((F.col("start") + F.col("upto") - 1) / RUN_SHINGLES)
    cut = placed.join(F.broadcast(starts), "part").select("c", "block", F.xxhash64("block", run).alias("g"), F.lit(True).alias("large"))
    out = tmp.written(cut.union(sized.where("NOT large").select("c", "block", F.col("block").alias("g"), "large")), "runs")
    tmp.drop(members, large, placed)
    return out


def class_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """wanted (id, c, g, large) with the text of each class c; ids may repeat, so the set's digest is compared."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted, "id")

    def run(batches):
        for batch in batches:
            for part in sliced(batch, "text", SLICE):
                digests = set_digests(*shingle_sets(*flat_bytes(part.column("text")), words))[:, 0]
                kept = part.filter(pa.array(digests == part.column("c").to_numpy()))
                if kept.num_rows:
                    yield kept.select(["c", "g", "large", "text"])
                del part, kept
            del batch
            release()

    return rows.select("id", "c", "g", "large", "text").mapInArrow(run, "c long, g long, large boolean, text string")


def _near(values: np.ndarray, offsets: np.ndarray, percent: int) -> Callable[[int], np.ndarray]:
    """near(i): which of the sets have 100 * intersection >= percent * union with set i."""
    size = np.diff(offsets)
    item = np.unique(values, return_inverse=True)[1]
    order = np.argsort(item, kind="stable")
    holder = (np.searchsorted(offsets, order, "right") - 1).astype(np.int32)
    starts = np.searchsorted(item[order], np.arange(item.max() + 2 if len(item) else 1))

    def near(i: int) -> np.ndarray:
        own = item[offsets[i] : offsets[i + 1]]
        many = starts[own + 1] - starts[own]
        at = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        both = np.bincount(holder[at], minlength=len(size))
        return 100 * both >= percent * (size[i] + size - both)

    return near


def confirmed(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that join the classes of each group on their full sets: (a, b, hub) with hub 0, and for each group a row
    (member of its largest component, g, 1). texts (g, c, label, asks, text): classes with one label are joined
    already; those with asks are compared with all others of their group."""
    ordered = texts.select("g", "c", "label", "asks", "text").repartition("g").sortWithinPartitions("g", "c")

    def links(part: pa.Table) -> tuple[list, list, int]:
        c, at = np.unique(part.column("c").to_numpy(), return_index=True)
        values, offsets = sets_of(part.column("text").combine_chunks(), words)
        if len(at) < part.num_rows:  # repeated rows
            values = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in at])
            offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[at])])
        label = np.unique(part.column("label").to_numpy()[at], return_inverse=True)[1]
        asks = part.column("asks").to_numpy()[at]
        if len(c) == 2:
            both = len(np.intersect1d(values[: offsets[1]], values[offsets[1] :], assume_unique=True))
            found, label = ([(0, 1)], label * 0) if label[0] != label[1] and 100 * both >= percent * (offsets[2] - both) else ([], label)
        else:
            found, label = spanning_links(_near(values, offsets, percent), label, asks)
        return [c[i] for i, _ in found], [c[j] for _, j in found], c[np.flatnonzero(label == np.bincount(label).argmax())[0]]

    def run(batches):
        for table in whole_groups(batches, "g"):
            g = table.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
            a, b, hubs = [], [], []
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end - start > 1:
                    x, y, hub = links(table.slice(start, end - start))
                    a, b = a + x, b + y
                    hubs.append((hub, g[start]))
                else:
                    hubs.append((table.column("c")[start].as_py(), g[start]))
            rows = [(x, y, 0) for x, y in zip(a, b, strict=True)] + [(x, y, 1) for x, y in hubs]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()))], names=["a", "b", "hub"])
            del table, rows
        release()

    return ordered.mapInArrow(run, "a long, b long, hub int")


def across_runs(live: DataFrame, runs: DataFrame, component: DataFrame, texts: DataFrame, words: int, percent: int, tmp: Scratch) -> DataFrame:
    """Links (a, b) between runs of one block that the runs and their hubs haven't joined."""
    members = tmp.written(runs.select("c", "block", "g").join(component.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c")), "placed")
    counts = members.groupBy("block", "component").agg(F.count("*").alias("m"))
    main = counts.groupBy("block").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    mixed = members.join(main, "block").select("c", "g", "component", "main")
    placed = tmp.written(live.select("r", "c").join(mixed, "c"), "mixed")
    there = placed.groupBy("r", "g").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    outside = placed.where("component <> main").select("r", "c", F.col("g").alias("own"), "component")
    asking = tmp.written(outside.join(there, "r").where("g <> own AND (low <> component OR high <> component)").select("c", "component", "g").distinct(), "asking")
    # a run takes RUN askers at once
    many = asking.groupBy("g").agg(F.ceil(F.count("*") / RUN).cast("int").alias("turns"))
    asked = members.select("c", "component", "g").join(many, "g").select("c", "component", "g", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks"))
    asking_ = asking.join(many, "g").select("c", "component", "g", F.pmod(F.xxhash64("c"), "turns").cast("int").alias("turn"), F.lit(True).alias("asks"))
    sent = asked.union(asking_).select("c", F.col("component").alias("label"), F.xxhash64("g", "turn").alias("g"), "asks")
    out = tmp.written(confirmed(texts.select("c", "text").join(sent, "c"), words, percent).where("hub = 0").select("a", "b"), "across")
    tmp.drop(members, placed, asking)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, shallow: int = 3) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs.

    Two texts are linked if 100 * intersection >= percent * union of their sets of distinct `words`-word shingles. A
    text of fewer words has the whole sequence as its one shingle; null texts and texts without words have an empty
    set and no links. component_id is the smallest id that can be reached; kept marks the rows whose id it is (all
    rows, where an id repeats). Rows without an id take no part: their component_id is null and they are kept. Rows
    that share an id are documents of their own, linked by their texts only.

    The forest finds a pair with a probability of 1 - (1 - s**shallow)**16 at similarity s, for the pair itself; a
    group is found through any of its pairs.
    """
    with Scratch(docs.sparkSession) as tmp:
        found = tmp.written(text_sets(docs, id_col, text_col, words), "sets")
        named = found.where("id IS NOT NULL AND n_shingles > 0")
        classes = named.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        classes = tmp.written(classes.withColumnRenamed("d1", "c"), "classes")
        live = tmp.written(regions(classes, shallow), "regions")
        joined = plausible(live.where(F.col("n") <= RUN), classes, percent / 100).union(live.where((F.col("n") > RUN) & (F.col("c") != F.col("low"))).select(F.col("c").alias("a"), F.col("low").alias("b")))
        blocks = connected_components(joined, tmp)
        runs = runs_of(blocks.select(F.col("id").alias("c"), F.col("component").alias("block")), classes, tmp)
        wanted = runs.join(classes.select("c", F.col("rep").alias("id")), "c").select("id", "c", "g", "large")
        texts = tmp.written(class_texts(docs, wanted, id_col, text_col, words), "texts", "large")
        whole = texts.withColumns({"label": F.col("c"), "asks": F.lit(True)})
        first = tmp.written(confirmed(whole, words, percent), "links")
        links, large = first.where("hub = 0").select("a", "b"), texts.where("large")
        cut = runs.where("large")
        hubs = first.where("hub = 1").select(F.col("a").alias("c"), F.col("b").alias("g")).join(cut.select("g", "block").distinct(), "g").select("c", "block")
        while hubs.groupBy("block").count().where("count > 1").limit(1).count():
            level = runs_of(hubs, classes, tmp)
            sent = large.select("c", "text").join(level.select("c", "g"), "c").withColumns({"label": F.col("c"), "asks": F.lit(True)})
            more = tmp.written(confirmed(sent, words, percent), "hubs")
            links = links.union(more.where("hub = 0").select("a", "b"))
            again = level.where("large").select("g", "block").distinct()
            hubs = more.where("hub = 1").select(F.col("a").alias("c"), F.col("b").alias("g")).join(again, "g").select("c", "block")
        component = connected_components(links, tmp)
        if cut.limit(1).count():
            more = across_runs(live, cut, component, large, words, percent, tmp)
            tmp.drop(texts)
            component = connected_components(component.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), tmp)
        linked = classes.select("c", "d2", "rep").join(component.withColumnRenamed("id", "c"), "c")
        least = linked.groupBy("component").agg(F.min("rep").alias("least"))
        of_class = linked.join(least, "component").select(F.col("c").alias("d1"), "d2", "least")
        alone = classes.select(F.col("c").alias("d1"), "d2", "rep")
        of_class = alone.join(of_class, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", "rep").alias("least"))
        # copies of one text may be many: only the classes' rows are aggregated
        out = found.select("id", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
        own = F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.coalesce("least", "id"))
        out = out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"))
        result = out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
        return written(result, "neardup")  # outlives the tables of the run
