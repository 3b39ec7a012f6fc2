"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled shared tokens, small buckets compared.

Texts become sets of hashed word 5-grams, and sets become signatures of minwise hashes, whose equal coordinates
stand for shared tokens (two sets agree in a coordinate with their Jaccard similarity as probability). A run of
the search is a tree. A node samples two coordinates, and each set goes to the two children named by its values
there. Nodes of one set end; small ones are leaves, whose sets are compared exactly, all with all; large ones are
split again. Runs are repeated until a link at the threshold is found with the target probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructType

from parchment.llm.common import column, join_groups, one_each, write_table
from parchment.llm.textnum import WORDS, blocks, mix, word_hashes

COORDINATES = 64
_FACTORS = [mix(np.uint64([0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)]))[0] for k in range(COORDINATES)]
_A = np.array([f | np.uint64(1) for f in _FACTORS])
_B = mix(_A)


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """For each text its distinct runs of consecutive lower-case words, hashed and sorted.

    A text of fewer words, but not none, has one run of them all.
    """
    out: list[np.ndarray] = []
    coded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    for lo, hi in blocks(coded):
        hashes, first, _ = word_hashes(coded[lo:hi], WORDS)
        n = max(0, len(hashes) - words + 1)
        runs = np.zeros(n, np.uint64)
        for k in range(words):
            runs = mix(runs + hashes[k : k + n])
        for s, e in zip(first[:-1], first[1:], strict=True):
            if e - s >= words:
                out.append(np.unique(runs[s : e - words + 1]))
            elif e > s:
                short = np.zeros(1, np.uint64)
                for h in hashes[s:e]:
                    short = mix(short + h)
                out.append(mix(short + np.uint64(e - s)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(tokens), 4096):
        np.minimum(low, ((tokens[s : s + 4096, None] ^ _B) * _A).min(axis=0), out=low)
    return low


@F.arrow_udf(StructType().add("n", IntegerType()).add("set", BinaryType()).add("sig", BinaryType()))
def _signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Number of tokens, 128 bits that name the set, and its signature."""
    for texts in batches:
        n, names, sigs = [], [], []
        for tokens in shingle_sets(texts.to_pylist()):
            n.append(len(tokens))
            names.append(mix(tokens).sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mix(~tokens)).tobytes() if len(tokens) else None)
            sigs.append(signature(tokens).tobytes() if len(tokens) else None)
        yield pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())], ["n", "set", "sig"])


def lost_share(threshold: float, runs: int, levels: int, fanout: int = 2) -> float:
    """With which probability a link at the threshold is in no leaf of any run, when trees are so many levels deep.

    A run loses the link below a node if in each sampled coordinate the two sets differ or are lost further down. The
    roots of runs sample coordinates of their own. All nodes below draw from the rest, of which the two sets
    agree in a number that is the same for all runs, so the chance is taken over that number.
    """
    pool, lost = COORDINATES - fanout * runs, 0.0
    for agree in range(pool + 1):
        below = 0.0
        for _ in range(levels - 1):
            below = (1 - agree / pool * (1 - below)) ** fanout
        weight = math.comb(pool, agree) * threshold**agree * (1 - threshold) ** (pool - agree)
        lost += weight * (1 - threshold * (1 - below)) ** (fanout * runs)
    return lost


def runs_needed(threshold: float, recall: float, levels: int = 4, fanout: int = 2) -> int:
    """How many runs find a link at the threshold with probability recall in trees of so many levels."""
    return next((n for n in range(1, COORDINATES // fanout // 2) if lost_share(threshold, n, levels, fanout) <= 1 - recall), COORDINATES // fanout // 2)


#: Rows of a matrix of similar sets that are worked out at once.
_TILE = 512


def compare(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> np.ndarray:
    """Which sets are similar, as a matrix. With sides, only sets of different sides are compared.

    Sets so near to the first one that their differences from it can't add up to too many are similar without being
    compared. Of all others the intersections are counted exactly, by products of matrices over the tokens
    that two sets at least have.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    pivot = np.zeros(len(tokens), bool)
    pivot[at[: sizes[0]]] = True
    with_pivot = np.bincount(owner, pivot[at], len(sets))
    # A and B differ in at most |A - P| + |P - A| + |B - P| + |P - B| tokens, and may differ in share * (|A| + |B|)
    share = (1 - threshold) / (1 + threshold)
    near = share * sizes - (sizes + sizes[0] - 2 * with_pivot) >= 1e-6
    far = np.flatnonzero(~near)

    shared = n[at] > 1
    column = (np.cumsum(n > 1) - 1)[at[shared]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[shared][order]
    last = int((n > 1).sum())
    width = min(last, max(256, (4 << 20) // len(sets)))
    similar = near[:, None] & near[None, :]
    common = np.zeros((len(far), len(sets)), np.float32)
    if len(far):
        for lo in range(0, last, max(1, width)):
            s, e = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[s:e], column[s:e] - lo] = 1
            common += part[far] @ part.T
        for lo in range(0, len(far), _TILE):
            rows = far[lo : lo + _TILE]
            similar[rows] = common[lo : lo + _TILE] * (1 + threshold) >= threshold * (sizes[rows, None] + sizes[None, :]) - 1e-6
            similar[:, rows] = similar[rows].T
    np.fill_diagonal(similar, False)
    return similar if side is None else similar & (side[:, None] != side[None, :])


def _components(similar: np.ndarray) -> np.ndarray:
    """For each row the first row that it is joined to, however many steps away."""
    label = np.full(len(similar), -1)
    for i in range(len(similar)):
        front = np.array([i] if label[i] < 0 else [], int)
        while len(front):
            label[front] = i
            reached = np.zeros(len(similar), bool)
            for lo in range(0, len(front), _TILE):
                reached |= similar[front[lo : lo + _TILE]].any(axis=0)
            front = np.flatnonzero(reached & (label < 0))
    return label


def _leaf(rows: list[tuple], threshold: float) -> list[tuple[int, int, int, int]]:
    """Links of one leaf: rep, the least rep of its component here, links to sets, links to documents.

    A pair that an earlier leaf (of smaller number) holds too is counted there only.
    """
    rows = sorted({r["rep"]: r for r in rows}.values(), key=lambda r: r["rep"])
    if len(rows) < 2:
        return []
    parted = rows[0]["i"] != rows[0]["j"]
    similar = compare(shingle_sets([r["text"] for r in rows]), threshold, np.array([r["block"] for r in rows]) if parted else None)
    if not similar.any():
        return []
    any_here, first = similar.any(axis=1), _components(similar)
    earlier: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        for other in r["leaves"]:
            if other < r["leaf"]:
                earlier.setdefault(other, []).append(k)
    for members in earlier.values():
        if len(members) > 1:
            similar[np.ix_(members, members)] = False
    copies = np.array([r["copies"] for r in rows], np.float64)
    n_docs = np.concatenate([similar[lo : lo + _TILE] @ copies for lo in range(0, len(rows), _TILE)])
    n_sets = similar.sum(axis=1)
    return [(r["rep"], rows[first[k]]["rep"], int(n_sets[k]), int(n_docs[k])) for k, r in enumerate(rows) if any_here[k]]


def _components_of(edges: DataFrame) -> DataFrame:
    """rep and label for the reps of edges (rep, star): equal labels where stars join them, however many steps away.

    Each round gives each star its least label, each rep the least of its stars, and then that label's own label,
    so that long chains shorten quickly. A star may join any number of reps: see join_groups.
    """
    labels = write_table(edges.select("rep", F.col("rep").alias("label")).distinct(), "labels")
    while True:
        stars = write_table(edges.join(labels, "rep").groupBy("star").agg(F.min("label").alias("label"), F.count("*").alias("n")), "stars")
        least = write_table(join_groups(edges, stars, ["star"], "n", F.xxhash64("rep"), how="inner").groupBy("rep").agg(F.min("label").alias("label")), "labels")
        jumped = least.alias("a").join(least.select(F.col("rep").alias("label"), F.col("label").alias("next")).alias("b"), "label")
        new = write_table(jumped.select("rep", F.col("next").alias("label")), "labels")
        changed = new.join(labels.withColumnRenamed("label", "before"), "rep").filter("label <> before").limit(1).count()
        labels = new
        if not changed:
            return labels


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.9999, leaf_sets: int = 1024, leaf_tokens: int = 2 << 20, max_depth: int = 8, block_sets: int = 4096) -> DataFrame:
    """One row for each row of docs: the id, class_id, n_links, n_copies, kept and text_hash (xxhash64 of the text).

    Texts are similar if their sets of word 5-grams have a Jaccard similarity of at least threshold. Classes are
    what such links join, step by step; class_id is the least id of a class (null last), and one row of it is kept. n_links is the
    number of other documents linked to this one directly, n_copies the number of documents with its set of
    5-grams, itself included. Null and empty texts, and texts without words, have no links and stay.
    A text of less than five words is similar to texts of the same words only. Rows that repeat both id and text
    are counted as copies; of rows with the least id the one of least text_hash is kept, and of equal ones any one. An empty table gives no rows.

    Documents with equal sets are one set from the start, found by aggregation, so copies cost no comparisons. Links
    found are exact; a link at the threshold is lost with probability 1 - recall, one of higher similarity more seldom. Nothing
    is capped: sets too different in size to be similar never meet, and nodes still large at max_depth are cut into blocks, and all pairs of blocks are compared. No links
    are written out pair by pair: a leaf tells for each set how many links it has that no earlier leaf has,
    and which component it is in. So rows grow with the documents, not with the pairs.
    """
    runs = runs_needed(threshold, recall)
    keyed = docs.select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("text_hash"), column(text_col).alias("text"))
    sets = write_table(keyed.select("id", "text_hash", _signed(F.coalesce("text", F.lit(""))).alias("s")).select("id", "text_hash", F.monotonically_increasing_id().alias("row"), "s.*"), "sets")
    classes = sets.filter("n > 0").groupBy("set").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "row")).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = write_table(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    def child(run: Column, coordinate: Column) -> Column:
        return F.xxhash64(run, coordinate, F.substring("sig", coordinate * 8 + 1, F.lit(8)))

    # similar sets differ in size by a factor of 1 / threshold at most, so their size classes are equal or next to
    # each other: a root holds two classes, and each set is in the root of its class and the next one
    size_class = F.floor(F.log(F.col("n")) / (math.log(1 / threshold) * 1.001)).cast("int")
    roots = F.array(*[F.xxhash64(child(F.lit(r), F.lit(2 * r + k)), size_class + c) for r in range(runs) for k in range(2) for c in range(2)])
    members = write_table(classes.select("rep", "n", F.explode(roots).alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("used")), "members")
    nodes_of = lambda m: m.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"), F.max("parent").alias("parent"), F.max("used").alias("used"), F.bit_xor(F.xxhash64("rep")).alias("a"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("b")).filter("size > 1")
    levels, fresh, too_large = [], 2 * runs, (F.col("size") > leaf_sets) | (F.col("tokens") > leaf_tokens)
    # a node that keeps more than half of its parent is a dense cluster, which more splits would copy and not thin out
    thins = F.col("parent").isNull() | (2 * F.col("size") <= F.col("parent"))
    for depth in range(max_depth):
        nodes = write_table(nodes_of(members), "nodes")
        large = nodes.filter(too_large & (F.col("size") > 2) & thins) if depth + 1 < max_depth else nodes.limit(0)
        levels.append((members, nodes.join(large.select("node"), "node", "left_anti") if depth + 1 < max_depth else nodes))
        if depth + 1 == max_depth or large.isEmpty():
            break
        # each node draws two of the coordinates that no node above it has drawn
        unused = F.filter(F.sequence(F.lit(0), F.lit(COORDINATES - fresh - 1)), lambda c: F.call_function("shiftrightunsigned", F.col("used"), c).bitwiseAND(F.lit(1).cast("long")) == 0)
        drawn = F.array_sort(F.transform(unused, lambda c: F.struct(F.xxhash64("node", c).alias("hash"), c.alias("at"))))
        large = large.select("node", "size", "used", F.transform(F.slice(drawn, 1, 2), lambda d: d["at"]).alias("drawn"))
        large = large.withColumn("spent", F.aggregate("drawn", F.col("used"), lambda u, c: u.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))).drop("used")
        met = join_groups(members.drop("used"), write_table(large, "large"), ["node"], "size", F.xxhash64("rep"), how="inner")
        below = met.join(classes.select("rep", "sig"), "rep").select("rep", "n", F.col("size").alias("parent"), F.col("spent").alias("used"), F.explode(F.transform("drawn", lambda c: child(F.col("node"), (c + fresh).cast("int")))).alias("node"))
        members = write_table(below.select("rep", "n", "node", "parent", "used").distinct(), "members")

    leaves = None
    for _, nodes in levels:
        leaves = nodes if leaves is None else leaves.unionByName(nodes)
    # nodes with the same members are one leaf
    leaves = leaves.groupBy("size", "tokens", "a", "b").agg(F.min("node").alias("node"))
    parts = F.greatest(F.ceil(F.col("size") * 2 / min(block_sets, 4 * leaf_sets)), F.ceil(F.col("tokens") / leaf_tokens))
    leaves = write_table(leaves.select("node", "size", F.when(too_large & (F.col("size") > 2), parts).otherwise(F.lit(1)).cast("int").alias("parts")), "leaves")
    held = None
    for m, _ in levels:
        own = join_groups(m.select("rep", "node"), leaves, ["node"], "size", F.xxhash64("rep"), how="inner").select("rep", F.col("node").alias("leaf"), "parts")
        held = own if held is None else held.unionByName(own)
    held = write_table(held, "held")

    of_rep = held.groupBy("rep").agg(F.collect_list(F.struct("leaf", "parts")).alias("in_leaves"))
    # an id and a text that rows repeat are one row before they meet their leaves
    key = [F.col("id").isNull().alias("none"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), "text_hash"]
    repeated = write_table(sets.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1"), "repeated-rows")
    once = one_each(keyed.select(*key, "text"), ["none", "key", "text_hash"], repeated)
    wanted = classes.select("rep", "copies", "first.id", "first.text_hash").select("rep", "copies", *key).join(of_rep, "rep")
    texts = once.join(wanted, ["none", "key", "text_hash"]).select("rep", "copies", "text", "in_leaves")
    dealt = texts.select("rep", "copies", "text", F.col("in_leaves.leaf").alias("leaves"), F.explode("in_leaves").alias("l")).select("*", "l.leaf", "l.parts").drop("l")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", "leaf"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "parts")
    dealt = dealt.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal out
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "first", "leaf", "n_sets", "n_docs"])
                out = []

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["leaf"], row["i"], row["j"])
                if here != key:
                    out += [(a, b, key[0], n, d) for a, b, n, d in _leaf(rows, threshold)] if rows else []
                    key, rows = here, []
                rows.append(row)
            if len(out) > 4096:
                yield from flushed()
        out += [(a, b, key[0], n, d) for a, b, n, d in _leaf(rows, threshold)] if rows else []
        yield from flushed()

    links = write_table(dealt.mapInArrow(compared, "rep long, first long, leaf long, n_sets long, n_docs long"), "links")
    edges = write_table(links.select("rep", F.col("first").alias("star")).distinct(), "edges")
    labels = _components_of(edges)

    linked = links.groupBy("rep").agg(F.sum("n_docs").alias("n_docs"))
    named = classes.select("set", "rep", "copies", "first").join(labels, "rep", "left").join(linked, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    named = write_table(named.select("set", "copies", "first", "label", (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    least = write_table(named.groupBy("label").agg(F.min("first").alias("best"), F.count("*").alias("n_sets")), "class-ids")
    named = write_table(join_groups(named, least, ["label"], "n_sets", F.xxhash64("set")).select("set", "copies", F.col("best.id").alias("class_id"), F.col("best.row").alias("best"), "n_links"), "class-of-set")

    out = join_groups(sets.select("id", "text_hash", "row", "set"), named, ["set"], "copies", F.xxhash64("id", "text_hash"))
    alone = F.col("copies").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (alone | (F.col("best") == F.col("row"))).alias("kept"),
        "text_hash",
    )
