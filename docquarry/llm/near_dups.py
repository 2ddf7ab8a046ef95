"""MinHash near-duplicates from bottom-k sketches of one hash function.

Every document becomes its set of distinct 5-word shingles, hashed to 64 bits. Documents with equal sets form a class,
and only classes go on. A class keeps the k smallest hashes of its set (bottom-k: one hash function, k values).

1. Inverted lists. A pair of classes that is similar enough shares at least `_overlap` of its retained values, so under
   any fixed order of values it shares one among the first k - overlap + 1. Rare values come first in that order: a value
   of a passage that many documents quote is listed only for documents that hold little else.
2. Overlaps. Each list pairs its first class, the hub, with all others; the bottom k of the union of two sketches estimates
   their similarity, clearly lower pairs go no further, and the exact Jaccard similarity of the full sets decides.
3. Lists whose classes these links join into one component are done. Of the others, those of at most SMALL classes pair
   their classes of different components, and these pairs go the same way.
4. Longer lists that stay open hold classes that share a passage and little else, or chains of edits. There the full
   sets of these classes alone take part, in lists again (`_rest`): values of one component link nothing, values of few
   classes give pairs, and classes that share only values of many classes are compared by what they have in common, as
   groups of equal common parts. So neither a group of copies nor the documents that quote a passage emit their pairs.

Components grow from confirmed links only. Two different shingles of a pair of sets get one hash with a probability of
about n * m / 2 ** 64 for n and m shingles: 2e-11 for two texts of 20,000 words.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import dropped, mapped, pieces, spread_join, texts, written

WORDS = 5
#: Values that a sketch retains. With SHARE: at similarity 0.75, fewer than half of the union's bottom 64 are shared with probability under 1e-5.
K = 64
SHARE = 32
#: Open lists up to this length give their pairs; longer ones are closed by what their classes have in common.
SMALL = 16
#: Groups in a block that is compared at once; a block holds fewer where they are long.
BLOCK = 256
#: Blocks of the filters that keep texts and sketches out of shuffles: 16 MB at most.
MOST_BLOCKS = 1 << 18

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes (int64) of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64).view(np.int64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    x = hashed[:n] * _MULTIPLIERS[0]
    for i in range(1, WORDS):
        x += hashed[i : n + i] * _MULTIPLIERS[i]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = np.sort(x.view(np.int64))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def _sketches(batches):
    """Document id and text to id, set size, 128 bits that stand for the set, and the sketch."""
    import pyarrow as pa

    for whole in batches:
        for batch in pieces(whole):
            sets = [shingles(t) for t in texts(batch.column(1))]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sketch = [s[:K] for s in sets]
            offsets = np.cumsum([0, *map(len, sketch)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *sketch])))],
                ["doc_id", "n_shingles", "print", "sketch"],
            )


def _full(batches):
    import pyarrow as pa

    for whole in batches:
        for batch in pieces(whole):
            sets = [shingles(t) for t in texts(batch.column(1))]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["rep", "full"])


def _overlap(n: Column) -> Column:
    """How many of its retained values a class of n shingles shares with any class as similar as 0.75."""
    return F.least(F.ceil(n * 0.75), F.lit(SHARE)).cast("int")


def _lists(classes: DataFrame) -> DataFrame:
    """(value, rep, n): the rarest retained values of each class, without values that only one class lists."""
    entries = classes.select("rep", "n", F.explode("sketch").alias("value"))
    common = entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    kept = entries.join(common, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
    retained = F.least("n", F.lit(K)).cast("int")
    # values that no other class retains are the rarest of all, and stand before these
    room = retained - _overlap(F.col("n")) + 1 - (retained - F.size("common"))
    entries = written(kept.where(room > 0).select("rep", "n", F.explode(F.slice("common", F.lit(1), room)).alias("x")).select(F.col("x.value").alias("value"), "rep", "n"))
    listed = written(entries.join(entries.groupBy("value").agg(F.count("*").alias("length")).where("length > 1").drop("length"), "value"))
    dropped(entries)
    return listed


def _alike(n: str, m: str) -> Column:
    """Whether sets of so many shingles can be as similar as 0.75."""
    return 100 * F.least(n, m) >= 75 * F.greatest(n, m)


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    a, b = (table.select(F.col("rep").alias(end), F.col(column).alias(out)) for end, out in (("a", "x"), ("b", "y")))
    return pairs.join(a, "a").join(b, "b")


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose union sketch allows a similarity of 0.75."""
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, K)
    shared = F.size(F.array_intersect(F.array_intersect("x", "y"), union))
    # half of the union's sketch or more; a union smaller than the sketch is known in full, and 0.75 of it is needed
    return _both(pairs, sketches, "sketch").where(F.when(F.size(union) < K, 100 * shared >= 75 * F.size(union)).otherwise(shared >= SHARE)).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as 0.75."""
    both = F.size(F.array_intersect("x", "y"))
    return _both(pairs, sets, "full").where(100 * both >= 75 * (F.size("x") + F.size("y") - both)).select("a", "b")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, full) of the wanted classes, and of few others: texts are filtered where they lie and never shuffled."""
    some = bloom.marked(rows, F.col("doc_id"), wanted, MOST_BLOCKS).where("_perhaps").select("doc_id", "text")
    return written(mapped(some, _full, "rep long, full array<long>").distinct())


def components(links: DataFrame) -> DataFrame:
    """(rep, component) for the ends of links (a, b) other than the least of each component: alternating large-star and
    small-star steps until every end points to the least of its component."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("component"))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        dropped(edges)
        edges = after


def _labelled(reps: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """reps with a column `name`: the component of rep in found, or rep itself."""
    return reps.join(found.withColumnRenamed("component", name), "rep", "left").withColumn(name, F.coalesce(name, "rep"))


def _common_counts(rows: np.ndarray, values: np.ndarray, hub: np.ndarray) -> np.ndarray:
    """How many values each hub shares with each other row; rows and values are the entries of their sets."""
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    number = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]).astype(np.int64)) if len(values) else values
    # only values on both sides count for intersections
    of_hub, n = hub[rows], int(number[-1]) + 1 if len(number) else 0
    shared = (np.bincount(number[of_hub], minlength=n) > 0) & (np.bincount(number[~of_hub], minlength=n) > 0)
    place = np.cumsum(shared) - 1
    keep = shared[number]
    own = np.where(hub, np.cumsum(hub), np.cumsum(~hub)) - 1
    both = np.zeros((int(hub.sum()), int((~hub).sum())), np.float32)
    width, at_once = int(shared.sum()), 16384
    for start in range(0, width, at_once):
        some = keep & (place[number] >= start) & (place[number] < start + at_once)
        x, y = (np.zeros((side, min(at_once, width - start)), np.float32) for side in both.shape)
        for matrix, which in ((x, some & of_hub), (y, some & ~of_hub)):
            matrix[own[rows[which]], place[number[which]] - start] = 1
        both += x @ y.T
    return both.astype(np.int64)


def _compared(table):
    """Of groups of equal common parts, hubs against others of a block pair: links (a, b) between their least classes, one
    for each hub and component of others, and how large a class of each group may be to be linked as well (reach)."""
    import pyarrow as pa

    hub, rep, n = table.column("hub").to_numpy(), table.column("rep").to_numpy(), table.column("n").to_numpy()
    component, mixed = table.column("component").to_numpy(), table.column("mixed").to_numpy()
    sets = table.column("common").combine_chunks()
    both = _common_counts(np.repeat(np.arange(len(rep)), np.diff(sets.offsets.to_numpy())), sets.flatten().to_numpy(), hub)
    left, right = np.flatnonzero(hub), np.flatnonzero(~hub)
    similar = 7 * both >= 3 * (n[left][:, None] + n[right][None, :])
    similar &= (component[left][:, None] != component[right][None, :]) | mixed[left][:, None] | mixed[right][None, :]
    similar &= rep[left][:, None] != rep[right][None, :]
    i, j = np.nonzero(similar)
    _, first = np.unique(np.stack([i, component[right[j]]]), axis=1, return_index=True)
    reach = 7 * both[i, j] // 3
    out_reach = np.full(len(rep), -1, np.int64)
    np.maximum.at(out_reach, left[i], reach - n[right[j]])
    np.maximum.at(out_reach, right[j], reach - n[left[i]])
    some = np.flatnonzero(out_reach >= 0)
    a, b = np.concatenate([rep[left[i[first]]], rep[some]]), np.concatenate([rep[right[j[first]]], rep[some]])
    return pa.table({"a": a, "b": b, "reach": np.concatenate([np.full(len(first), -1, np.int64), out_reach[some]])})


def _by_blocks(groups: DataFrame) -> DataFrame:
    """What _compared finds between groups outside the largest component of their cluster and any group of the cluster.

    groups: cluster, rep, n, component, mixed, common. Sets as similar as 0.75 differ in size by a third at most, so a group
    meets only its own band of sizes and the two beside it.
    """
    sizes = groups.groupBy("cluster", "component").agg(F.sum((~F.col("mixed")).cast("int")).alias("size"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("size", "component"))["component"].alias("largest"))
    outside = F.col("mixed") | (F.col("component") != F.col("largest"))
    groups = spread_join(groups, largest, "cluster", "inner").withColumn("outside", outside).withColumn("band", F.floor(F.log("n") / F.lit(np.log(4 / 3).item())).cast("int"))
    groups = written(groups.drop("largest"))
    # so many blocks that none holds more than about BLOCK groups, or as many values as BLOCK groups of 4096
    blocks = lambda of: F.ceil(F.greatest(F.sum(of) / BLOCK, F.sum(F.size("common") * of) / (BLOCK * 4096))).cast("int")
    counts = written(groups.groupBy("cluster", "band").agg(blocks(F.lit(1)).alias("blocks"), blocks(F.col("outside").cast("int")).alias("hub_blocks")))
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    spread = F.xxhash64("rep")
    met = counts.select("cluster", F.col("band").alias("other"), F.col("blocks").alias("other_blocks"), F.col("hub_blocks").alias("other_hubs"))
    row = groups.join(counts, ["cluster", "band"]).withColumn("other", near).join(met, ["cluster", "other"])
    out = ["cluster", "hub_band", "hub_block", "band_", "block", "hub", "rep", "n", "component", "mixed", "common"]
    hubs = row.where("outside and other_blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    hubs = hubs.withColumns({"hub_band": F.col("band"), "hub_block": F.pmod(spread, "hub_blocks").cast("int"), "band_": F.col("other"), "hub": F.lit(True)}).select(*out)
    others = row.where("other_hubs > 0").withColumn("hub_block", F.explode(F.sequence(F.lit(0), F.col("other_hubs") - 1)))
    others = others.withColumns({"hub_band": F.col("other"), "block": F.pmod(spread, "blocks").cast("int"), "band_": F.col("band"), "hub": F.lit(False)}).select(*out)
    found = written(hubs.union(others).groupBy(*out[:5]).applyInArrow(_compared, "a long, b long, reach long"))
    dropped(groups)
    dropped(counts)
    return found


def _rest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join what is similar among members (rep, n, component, full) of different components.

    Two such classes share three quarters of either set, so in any order of values one of the first quarter of each. In
    order come values that stand in one component alone, which link nothing; then by how many classes hold them.
    Values of at most SMALL classes give pairs, confirmed by the full sets. Classes that share none of these have their
    intersection among values of more classes: a class of n shingles matters if these are three quarters of it or more. Of
    classes whose common parts are equal, the smallest is as similar to any other class as the larger ones or more. So
    groups of equal common parts meet by their smallest classes, and a number (reach) says which of the larger ones are
    linked through them. Work beyond lists is quadratic in the number of different common parts of a cluster at most, not
    in documents that share one.
    """
    members = members.where(F.size("full") == F.col("n")).withColumn("which", F.xxhash64("full"))
    entries = members.select("rep", "n", "component", "which", F.explode("full").alias("value"))
    held = entries.groupBy("value").agg(F.count("*").alias("held"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("value", "held")
    shared = entries.join(held, "value").groupBy("rep", "n", "component", "which").agg(F.array_sort(F.collect_list(F.struct("held", "value"))).alias("shared"))
    room = F.size("shared") - F.ceil(F.col("n") * 0.75).cast("int") + 1
    shared = written(shared.where(room > 0).select("rep", "n", "component", "shared", F.slice("shared", F.lit(1), room).alias("first")))

    few = shared.select("rep", "n", "component", F.explode("first").alias("x")).where(F.col("x.held") <= SMALL).select(F.col("x.value").alias("value"), "rep", "n", "component")
    links = _confirmed(_pairs(few), sets)

    many = F.transform(F.filter("shared", lambda x: x["held"] > SMALL), lambda x: x["value"])
    first = F.transform(F.filter("first", lambda x: x["held"] > SMALL), lambda x: x["value"])
    rest = shared.where(F.exists("first", lambda x: x["held"] > SMALL)).select("rep", "n", "component", F.array_sort(many).alias("common"), first.alias("first"))
    rest = written(rest.withColumns({"p": F.xxhash64("common"), "q": F.xxhash64(F.lit("q"), "common")}))
    groups = rest.groupBy("p", "q").agg(F.min(F.struct("n", "rep", "first", "common")).alias("least"), F.min("component").alias("component"), (F.min("component") < F.max("component")).alias("mixed"))
    groups = written(groups.select("p", "q", "least.*", "component", "mixed"))
    edges = groups.select(F.explode("first").alias("value"), "rep")
    hubs = edges.groupBy("value").agg(F.min("rep").alias("hub"))
    clusters = components(edges.join(hubs, "value").where("rep > hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    clustered = written(_labelled(groups.select("rep", "n", "component", "mixed", "common"), clusters, "cluster"))
    several = clustered.groupBy("cluster").agg(F.count("*").alias("size"), (F.max("mixed") | (F.min("component") < F.max("component"))).alias("open")).where("size > 1 and open").select("cluster")
    met = _by_blocks(written(spread_join(clustered, several, "cluster", "inner")))
    # a group's own smallest class links the others that its common part alone makes similar
    own = groups.where("mixed").select(F.col("rep").alias("a"), (F.floor(7 * F.size("common") / 3) - F.col("n")).cast("long").alias("reach"))
    reach = met.where("reach >= 0").select("a", "reach").union(own).groupBy("a").agg(F.max("reach").alias("reach"))
    least = groups.where("mixed").select("p", "q", F.col("rep").alias("a")).join(reach, "a")
    within = rest.join(least, ["p", "q"]).where("n <= reach and rep <> a").select("a", F.col("rep").alias("b"))
    out = written(links.union(met.where("reach < 0").select("a", "b")).union(within))
    for table in (shared, rest, groups, clustered, met):
        dropped(table)
    return out


def _pairs(lists: DataFrame) -> DataFrame:
    """(a, b): classes of one list (value, rep, n, component) that are of different components and of like sizes."""
    left, right = (lists.select("value", *[F.col(c).alias(c + end) for c in ("rep", "n", "component")]) for end in "ab")
    pairs = left.join(right, "value").where(F.col("repa") < F.col("repb")).where("componenta <> componentb").where(_alike("na", "nb"))
    return pairs.select(F.col("repa").alias("a"), F.col("repb").alias("b")).distinct()


def link(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of documents (doc_id long, text string).

    Null and blank texts have no shingles, stay alone and are kept. Rows of one doc_id count as one document. Rows
    without a doc_id link to nothing, have no component_id and are kept. Further columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = written(mapped(rows, _sketches, "doc_id long, n_shingles long, print binary, sketch array<long>"))
    classes = sketched.where("print is not null and doc_id is not null").groupBy("print").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("c"))
    classes = written(classes.select("print", F.col("c.doc_id").alias("rep"), F.col("c.n_shingles").alias("n"), "c.sketch"))
    prints, verdicts = written(classes.select("print", "rep")), written(sketched.drop("sketch"))
    dropped(sketched)
    listed = _lists(classes)
    sketches = written(bloom.marked(classes, F.col("rep"), listed.select("rep").distinct(), MOST_BLOCKS).where("_perhaps").select("rep", "sketch"))
    dropped(classes)

    hubs = written(listed.groupBy("value").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("length")))
    stars = listed.join(hubs, "value").where(F.col("rep") > F.col("hub.rep")).where(_alike("n", "hub.n")).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    likely = written(_likely(stars, sketches))
    sets = _sets(rows, _ends(likely))
    found = written(components(_confirmed(likely, sets).union(_same_ids(verdicts, prints))))
    dropped(sets)

    # lists that hold more than one component still
    labelled = written(_labelled(listed, found, "component"))
    open_ = labelled.groupBy("value").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").join(hubs, "value").select("value", "hub.rep", "length")
    open_ = labelled.join(open_.withColumnRenamed("rep", "hub"), "value")
    # the hub has met the others of its list
    likely = written(_likely(_pairs(open_.where((F.col("length") <= SMALL) & (F.col("rep") != F.col("hub")))), sketches))
    members = written(open_.where(F.col("length") > SMALL).select("rep", "n", "component").distinct())
    if not (likely.isEmpty() and members.isEmpty()):
        sets = _sets(rows, _ends(likely).union(members.select("rep")).distinct())
        more = _confirmed(likely, sets)
        if not members.isEmpty():
            more = more.union(_rest(members.join(sets, "rep"), sets))
        # a class and the least of its component stand in for the links that made it
        found = written(components(found.select(F.col("rep").alias("a"), F.col("component").alias("b")).union(more)))
        dropped(sets)
    for table in (listed, sketches, hubs, labelled):  # nothing below reads these
        dropped(table)
    of_print = prints.join(found, "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = spread_join(verdicts, of_print, "print")
    return out.select("doc_id", "n_shingles", F.when(F.col("print").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_ids(verdicts: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of documents whose rows have different texts."""
    several = verdicts.where("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p < q").select("doc_id")
    own = verdicts.where("print is not null").join(several, "doc_id", "left_semi").select("doc_id", "print").distinct().join(prints, "print").select("doc_id", "rep").distinct()
    least = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return own.join(least, "doc_id").where("rep > a").select("a", F.col("rep").alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


def deduplicated(documents: DataFrame) -> DataFrame:
    """documents without those that link() does not keep. Of rows with one doc_id, one stays: the least by text, then by the
    row's JSON. Rows without a doc_id, and null or blank texts, stay. Columns of any further names go along.

    Only rows that may have to go are shuffled; a filter lets all others through where they lie.
    """
    verdicts = written(link(documents))
    gone = verdicts.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1")
    gone = written(gone.select("doc_id", "kept", (F.col("rows") > 1).alias("again")))
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = bloom.marked(rows, F.col("doc_id"), gone.select("doc_id"), MOST_BLOCKS)
    sure, others = rows.where("not _perhaps").select("row"), rows.where("_perhaps").join(gone, "doc_id", "left").where("kept is null or kept")
    once = others.where("again is null or not again").select("row")
    again = others.where("again").groupBy("doc_id").agg(F.min_by("row", F.struct("row.text", F.to_json("row"))).alias("row")).select("row")
    return sure.union(once).union(again).select("row.*")
