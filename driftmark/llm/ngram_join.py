"""N-gram Jaccard join: a MinHash LSH forest proposes pairs, exact shingle sets decide.

1. Equal texts, by their md5, become one class with a number of its own. One pass computes for each text `trees` labels of 8 bytes,
   each byte taken from one MinHash of its word shingles. A label read from its first byte is a path in a prefix trie.
2. The labels of each tree are sorted inside sub-tries of 6 bytes, which have 65,536 different leaves at most: equal labels
   are one leaf, and neighbours in the sorted order share their longest prefix. Two texts meet at depth d if they share d bytes in some tree.
3. The matched prefixes begin at whole labels and are shortened, 8, 7, 6, until the recall reaches the target. It is measured on
   at most `measured` pairs of neighbours in the tries, verified exactly: the share of the similar ones that also meet at
   the depth in some other tree than the one that gave them. Pairs within 0.05 of the threshold must reach the target on their own, too.
4. Texts that meet are joined to components, and each component is dealt out as pairs of blocks of texts of similar length,
   bounded by their shingles. A task holds two blocks: it compares labels first and exact shingle sets then, and
   returns only sums per text and a forest of its links, so no list of pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec
from .common import components, cut, fresh, running, runs, slices

LEVELS, SHORTEST = 8, 6
#: Shingles and texts of a block.
BLOCK_SIZE, BLOCK_TEXTS = 1 << 21, 1024
#: Stands for the id of rows without one.
NO_ID = -(1 << 63)
#: Fewer similar pairs than this measure nothing; the chance to meet at the threshold decides then.
LEAST_PAIRS = 100


def chance(similarity: float, depth: int, trees: int) -> float:
    """Chance that two texts of a similarity share a prefix of a depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _labels(sets: list[np.ndarray], trees: int, seed: int) -> np.ndarray:
    """For each set, `trees` labels as signed 64-bit numbers; the first level is the highest byte."""
    rng = np.random.default_rng(seed)
    k = trees * LEVELS
    mult = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    out = np.zeros((len(sets), trees, 8), dtype=np.uint8)
    buffer = np.empty((1024, k), dtype=np.uint32)
    for i, s in enumerate(sets):
        if not len(s):
            continue
        low = (s >> np.uint64(32)).astype(np.uint32)
        best = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
        for a in range(0, len(low), 1024):
            part = low[a : a + 1024]
            view = buffer[: len(part)]
            np.multiply(part[:, None], mult[None, :], out=view)
            np.add(view, plus[None, :], out=view)
            np.minimum(best, view.min(axis=0), out=best)
        best ^= best >> np.uint32(15)
        best *= np.uint32(0x2C1B3C6D)
        out[i] = (best >> np.uint32(24)).astype(np.uint8).reshape(trees, LEVELS)
    return out.view(">u8").reshape(len(sets), trees).astype(np.uint64).view(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n indices, over the links a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _links(left: list[np.ndarray], right: list[np.ndarray], ll: np.ndarray, rl: np.ndarray, same: bool, shift: int, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) that share a prefix in some trie and whose exact Jaccard similarity is at least share[0] / share[1]."""
    lp, rp = (ll.view(np.uint64) >> np.uint64(shift)).T, (rl.view(np.uint64) >> np.uint64(shift)).T
    met = np.zeros((len(left), len(right)), dtype=bool)
    for t in range(lp.shape[0]):
        met |= lp[t][:, None] == rp[t][None, :]
    nl, nr = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    p, q = share
    met &= (np.minimum(nl[:, None], nr[None, :]) * q >= np.maximum(nl[:, None], nr[None, :]) * p) & (nl[:, None] > 0)
    if same:
        met = np.triu(met, 1)
    if not met.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.concatenate(right)
    begins = np.concatenate([[0], np.cumsum(nr)])
    vocabulary, codes = np.unique(flat, return_inverse=True)
    codes = codes.reshape(-1)
    mark = np.zeros(len(vocabulary) + 1, dtype=bool)
    out_i, out_j = [], []
    for i in np.flatnonzero(met.any(axis=1)).tolist():
        at = np.searchsorted(vocabulary, left[i])
        at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == left[i])]
        mark[at] = True
        js = np.flatnonzero(met[i])
        if len(js) * 4 > len(right):
            sums = np.zeros(len(flat) + 1, dtype=np.int64)
            np.cumsum(mark[codes], out=sums[1:])
            common = sums[begins[js + 1]] - sums[begins[js]]
        else:
            common = np.array([np.count_nonzero(mark[codes[begins[j] : begins[j + 1]]]) for j in js.tolist()])
        mark[at] = False
        ok = js[common * q >= (nl[i] + nr[js] - common) * p]
        out_i.append(np.full(len(ok), i))
        out_j.append(ok)
    return np.concatenate(out_i), np.concatenate(out_j)


def _similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and both * 10**6 >= (len(a) + len(b) - both) * round(threshold * 10**6)


def _depth(pairs: DataFrame, base: DataFrame, classes: DataFrame, words: int, threshold: float, trees: int, target_recall: float, measured: int) -> tuple[int, dict[str, int]]:
    """The longest prefix at which the measured recall reaches the target, and what was measured. pairs: a, b, tree."""
    order = F.xxhash64("a", "b")
    picked = pairs.withColumn("o", order).orderBy("o", "a", "b", "tree").limit(measured * trees).groupBy("o", "a", "b").agg(F.min("tree").alias("tree"))
    picked = cut(picked.orderBy("o", "a", "b").limit(measured).drop("o"))
    ends = picked.select(F.col("a").alias("node")).unionByName(picked.select(F.col("b").alias("node"))).distinct()
    named = cut(classes.join(ends, "node", "left_semi").select("node", "same", "rid", "labels"))
    texts = cut(base.join(named, ["rid", "same"]).select("node", "body", "labels").dropDuplicates(["node"]))
    side = lambda s: texts.select(F.col("node").alias(s), F.col("body").alias(f"body_{s}"), F.col("labels").alias(f"labels_{s}"))
    rows = picked.join(side("a"), "a").join(side("b"), "b").select("tree", "body_a", "body_b", "labels_a", "labels_b")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (textvec.shingle_sets(batch.column(f"body_{s}"), words) for s in "ab")
            x, y = (np.asarray(batch.column(f"labels_{s}").flatten()).reshape(-1, trees).view(np.uint64) for s in "ab")
            diff = x ^ y
            diff[np.arange(len(diff)), batch.column("tree").to_numpy()] = np.uint64(1 << 63)
            shared = sum((diff >> np.uint64(64 - 8 * d) == 0).any(axis=1).astype(np.int32) for d in range(1, LEVELS + 1))
            near = [_similar(u, v, threshold) and not _similar(u, v, min(1.0, threshold + 0.05)) for u, v in zip(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([_similar(u, v, threshold) for u, v in zip(a, b)]), pa.array(near), pa.array(shared.astype(np.int32))], names=["similar", "near", "shared"])

    counts = [F.count_if("similar").alias("similar"), F.count_if("near").alias("near")]
    counts += [F.count_if(F.col(c) & (F.col("shared") >= d)).alias(f"{c}_{d}") for c in ("similar", "near") for d in range(SHORTEST, LEVELS + 1)]
    got = rows.mapInArrow(measure, "similar boolean, near boolean, shared int").agg(*counts).first().asDict()
    for depth in range(LEVELS, SHORTEST, -1):
        kinds = [c for c in ("similar", "near") if got[c] >= LEAST_PAIRS]
        recalls = [got[f"{c}_{depth}"] / got[c] for c in kinds] or [chance(threshold, depth, trees)]
        if min(recalls) >= target_recall:
            return depth, got
    return SHORTEST, got


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, trees: int, target_recall: float, measured: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows of docs as doc_id, rid, same, body; and a row for each text: same, class_id, rep (its least id), lead (whether it stands for its component), copies, n_links."""
    if chance(threshold, SHORTEST, trees) < target_recall:
        raise ValueError(f"{trees} trees can't reach a recall of {target_recall} at {threshold}")
    share = (round(threshold * 10**6), 10**6)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), F.unhex(F.md5("body")).alias("same"), "body")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each different text of a slice: copies are counted here first."""
        for whole in batches:
            for batch in slices(whole, "body"):
                kinds = batch.column("same").dictionary_encode()
                codes, n = kinds.indices.to_numpy(), len(kinds.dictionary)
                first = np.full(n, batch.num_rows)
                np.minimum.at(first, codes, np.arange(batch.num_rows))
                rid = np.full(n, (1 << 63) - 1, dtype=np.int64)
                rep = rid.copy()
                ids = batch.column("rid").to_numpy()
                known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                np.minimum.at(rid, codes, ids)
                np.minimum.at(rep, codes[known], ids[known])
                none = np.bincount(codes[known], minlength=n) == 0
                sets = textvec.shingle_sets(batch.column("body").take(pa.array(first)), words)
                labels = _labels(sets, trees, seed)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, labels.size + 1, trees), pa.int32()), pa.array(labels.ravel()))
                sizes = pa.array(np.array([len(x) for x in sets], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [kinds.dictionary, pa.array(rid), pa.array(rep, mask=none), pa.array(np.bincount(codes, minlength=n)), sizes, flat],
                    names=["same", "rid", "rep", "copies", "size", "labels"],
                )

    signed = base.mapInArrow(sign, "same binary, rid long, rep long, copies long, size int, labels array<long>")
    classes = signed.groupBy("same").agg(F.min("rid").alias("rid"), F.min("rep").alias("rep"), F.sum("copies").alias("copies"), F.max("size").alias("size"), F.first("labels").alias("labels"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))

    # The sub-tries that hold more than one text, their leaves in order, and who meets whom from which depth on.
    entries = classes.where("size > 0").select("node", F.posexplode("labels").alias("tree", "label"))
    entries = entries.select("node", "tree", "label", F.shiftrightunsigned("label", 64 - 8 * SHORTEST).alias("path"))
    crowded = entries.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("met")).where("met > 1").drop("met")
    held = cut(entries.join(crowded, ["tree", "path"]))
    leaves = held.groupBy("tree", "path", "label").agg(F.min("node").alias("head"))
    before = F.lag(F.struct("label", "head")).over(W.partitionBy("tree", "path").orderBy("label"))
    cut_at = lambda c, d: F.shiftrightunsigned(c, 64 - 8 * d)
    prefix = F.when(cut_at("label", 7) == cut_at("p.label", 7), 7).otherwise(SHORTEST)
    trie = leaves.withColumn("p", before).where("p is not null").select(F.col("head").alias("a"), F.col("p.head").alias("b"), "tree", prefix.alias("depth"))
    equal = held.join(leaves.drop("path"), ["tree", "label"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"), "tree", F.lit(LEVELS).alias("depth"))
    meet = cut(trie.unionByName(equal).where("a <> b"))
    depth, _ = _depth(meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "tree"), base, classes, words, threshold, trees, target_recall, measured)
    shift = 64 - 8 * depth
    groups = cut(components(meet.where(F.col("depth") >= depth).select("a", "b")))  # (node, root)

    # Texts of a component in the order of their sizes, cut into blocks; only blocks whose sizes can be similar enough meet.
    members = _in_blocks(groups.join(classes.select("node", "same", "rid", "size", "copies", "labels"), "node"), groups.count())
    spans = members.groupBy("root", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.count(F.lit(1)).alias("n"))
    other = spans.select("root", F.col("block").alias("block2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    fit = f"(block = block2 and n > 1) or (block < block2 and lo2 * {share[0]}L <= hi * {share[1]}L and lo * {share[0]}L <= hi2 * {share[1]}L)"
    meets = spans.join(other, "root").where(fit).select("root", "block", "block2")
    units = meets.select("root", "block", F.col("block").alias("u"), F.col("block2").alias("v"), F.lit(0).alias("side")).unionByName(
        meets.where("block <> block2").select("root", F.col("block2").alias("block"), F.col("block").alias("u"), F.col("block2").alias("v"), F.lit(1).alias("side"))
    )
    texts = base.select("rid", "same", "body").join(members, ["rid", "same"]).dropDuplicates(["node"])
    dealt = texts.join(units, ["root", "block"]).select(F.xxhash64("root", "u", "v").alias("unit"), "side", "node", "copies", "labels", "body")
    dealt = dealt.repartition("unit").sortWithinPartitions("unit", "side", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, "unit"):
            node = unit.column("node").to_numpy()
            side = unit.column("side").to_numpy()
            copies = unit.column("copies").to_numpy()
            labels = np.asarray(unit.column("labels").combine_chunks().flatten()).reshape(len(node), trees)
            sets = textvec.shingle_sets(unit.column("body"), words)
            cutting = int(np.count_nonzero(side == 0))
            alone = cutting == len(node)
            i, j = _links(sets[:cutting], sets if alone else sets[cutting:], labels[:cutting], labels if alone else labels[cutting:], alone, shift, share)
            if not alone:
                j = j + cutting
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            root = _roots(len(node), i, j)
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(node[root[hit]])], names=["node", "links", "head"])

    found = cut(dealt.mapInArrow(verify, "node long, links long, head long"))
    linked = cut(components(found.select(F.col("node").alias("a"), F.col("head").alias("b"))))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    first = linked.join(classes.select("node", "same", "rep"), "node").groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "same")).alias("first"))
    by_class = (
        classes.select("node", "same", "rep", "copies")
        .join(totals, "node", "left").join(linked, "node", "left")
        .join(first, "root", "left")
        .select("same", "rep", F.coalesce("first.rep", "rep").alias("class_id"), (F.coalesce("first.same", "same") == F.col("same")).alias("lead"), "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    return base, by_class


def _in_blocks(members: DataFrame, count: int) -> DataFrame:
    """Adds block: members of a component in classes of similar size, dealt into parts so that no task holds a class, cut where BLOCK_SIZE is reached."""
    step = members.withColumn("step", F.floor(F.log2(F.col("size") + 1.0) * 8)).withColumn("part", F.pmod(F.xxhash64("node"), F.lit(max(64, count // 50_000))))
    weight = F.greatest(F.col("size"), F.lit(BLOCK_SIZE // BLOCK_TEXTS))
    return running(step, ["root"], ["step", "part"], [F.col("size"), F.col("node")], weight, "number").withColumn("block", F.expr(f"number div {BLOCK_SIZE}")).drop("step", "part", "number")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8,
    trees: int = 40, target_recall: float = 0.9995, measured: int = 2000, seed: int = 7,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, copies, n_links.

    Two texts are linked when the Jaccard similarity of their sets of word shingles (lower case, words split at
    ASCII white space) is at least `threshold`. class_id is the smallest doc_id of the linked component, copies the
    number of rows with an equal text, n_links the number of other rows that are equal or linked.

    Null text counts as empty. Empty texts equal each other and link to nothing else. A text of fewer than `words`
    words has one shingle. Rows of a null id take part like others; class_id is null where a component has only such.
    Rows of one id may have different texts, which are classes of their own; where such an id is the smallest of two components, both have its class_id. Repeated rows count as copies. Columns other than the id
    and the text are not read. An empty table gives an empty table.
    """
    base, by_class = _classes(docs, id_col, text_col, words, threshold, trees, target_recall, measured, seed)
    return base.select("doc_id", "same").join(by_class, "same").select("doc_id", "class_id", "copies", "n_links")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8,
    trees: int = 40, target_recall: float = 0.9995, measured: int = 2000, seed: int = 7,
) -> DataFrame:
    """The rows of docs without near duplicates: of each component one row stays, that of the smallest id.

    A row of a null id stays only where its component has no other. Of rows that agree in id and text the one whose JSON has the
    least md5 stays. A text that is no copy of anything stays, also if its id repeats. All columns of docs are returned as they are.
    Nulls, empty texts and empty tables are as in `near_duplicates`.
    """
    _, by_class = _classes(docs, id_col, text_col, words, threshold, trees, target_recall, measured, seed)
    rid, same, n, row = fresh(docs, "rid", "same", "n", "row")
    marks = by_class.where("lead").select(F.coalesce("rep", F.lit(NO_ID)).alias(rid), F.col("same").alias(same))
    keyed = docs.withColumn(rid, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(same, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    repeated = cut(keyed.groupBy(rid, same).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).drop(n))
    kept = keyed.join(marks, [rid, same], "left_semi")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    whole = F.struct(*docs.columns)
    first = kept.join(repeated, [rid, same], "left_semi").groupBy(rid, same).agg(F.min_by(whole, F.md5(F.to_json(whole))).alias(row))
    return kept.join(repeated, [rid, same], "left_anti").select(*docs.columns).unionByName(first.select(f"{row}.*"))
