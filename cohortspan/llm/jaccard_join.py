"""Documents whose word n-gram sets overlap, by a vertically partitioned similarity join.

A global order of all n-grams is cut into fragments, and a document's set into its segments there. Overlaps of a pair
are counted fragment by fragment and summed per pair. The first fragment of the order holds n-grams of one set only:
a set with too many of these links with nothing, and an arbitrary slice of the n-grams shows that for most
sets at once. What is left is ordered by frequency, rare first; linked sets share an n-gram among each one's first
(Chaudhuri's prefix filter). Sets that share one are not paired all with all: they are held against a few centres
first, and by the triangle inequality of the Jaccard distance only sets of two centres that are near each other, and
not in one component already, are compared, set against block. Where many sets of different centres share an n-gram,
no pairs of centres are listed: its sets are dealt to blocks of bounded size, and block is held against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RollingHash, _arrow_schema, _slices, bit_table, checkpointed, connected_components, flatten, map_batches, mixed, passes

SHINGLE = 5
LOW, HIGH = 80, 100  # linked if HIGH * intersection >= LOW * union
SLICE = 4  # one in so many n-grams, by hash, is looked at first
SHORT = np.uint64(24)  # low bits that hashes lose there: two n-grams that then look alike count as shared, never as alone
FRAGMENTS = 4  # of the order that are counted separately
CENTRES = 2  # a set is first compared with so many others that it shares most rare n-grams with
SETTLED = 0.9  # sets are thinned out until this share of their n-grams is shared among those left
PROBE = 16  # one in so many n-grams, by hash, is looked at for that
CROWD = 30  # centres of sets that link among themselves; an n-gram with more is compared block by block
BLOCK_GRAMS = 100_000  # n-grams of the sets that travel together
NEAR = 1e-9  # slack of distances


def shingle_sets(lists: list[list[bytes]], shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams; a shorter text is one n-gram, one without words has none."""
    hashes, owner, starts = flatten(lists)
    rolling = RollingHash(hashes)
    counts = np.diff(starts)
    at = np.flatnonzero(np.arange(len(hashes)) + np.minimum(shingle, counts[owner]) <= starts[owner + 1])
    at = at[(counts[owner[at]] >= shingle) | (at == starts[owner[at]])]
    grams = rolling.spans(at, at + np.minimum(shingle, counts[owner[at]]))
    order = np.lexsort((grams, owner[at]))
    grams, text = grams[order], owner[at][order]
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (text[1:] != text[:-1]))) if len(grams) else np.zeros(0, bool)
    grams, text = grams[new], text[new]
    return np.split(grams, np.searchsorted(text, np.arange(1, len(lists))))


def set_key(grams: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        total = mixed(grams ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def _words(texts: list[bytes]) -> list[list[bytes]]:
    return [t.lower().split() for t in texts]


def least_overlap(n: Column) -> Column:
    """How many n-grams a set of ``n`` shares with any set linked to it, at least."""
    return F.floor((n * LOW + HIGH - 1) / HIGH).cast("long")


def may_link(n: Column, other_n: Column, shared: Column, other_shared: Column) -> Column:
    """Whether sets of these sizes can be linked, if each has ``shared`` n-grams that other sets have too."""
    most = F.least(shared, other_shared)
    return most * (LOW + HIGH) >= (n + other_n) * LOW


def scanned(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc, key, sid, n, part) of every row (doc, key, text): name and size of the set, and a slice of its shortened hashes."""
    schema = _arrow_schema(docs.sparkSession, "doc long, key long, sid long, n long, part array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(2)], names=["i", "text"])
            for rows, texts in _slices(pairs):
                sets = shingle_sets(_words(texts), shingle)
                here = batch.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([
                    here.column(0), here.column(1), pa.array(map(set_key, sets), pa.int64()), pa.array(map(len, sets), pa.int64()),
                    pa.array([(g[g % np.uint64(SLICE) == 0] >> SHORT << SHORT).view(np.int64) for g in sets], pa.list_(pa.int64()))], schema=schema)

    return checkpointed(map_batches(docs.select("doc", "key", "text"), run, "doc long, key long, sid long, n long, part array<bigint>"))


def sliced_out(scan: DataFrame) -> DataFrame:
    """(sid, n, doc, key, times) of the sets that may have links, as far as the slice shows: one text of each set."""
    grams = scan.select("sid", F.explode("part").alias("h"))
    alone = grams.groupBy("h").agg(F.min("sid").alias("sid"), F.max("sid").alias("other")).filter("sid = other")
    lonely = alone.groupBy("sid").agg(F.count("*").alias("alone"))
    texts = scan.filter("n > 0").groupBy("sid", "n", "doc", "key").agg(F.count("*").alias("times"))
    sets = texts.groupBy("sid", "n").agg(F.min(F.struct("doc", "key", "times")).alias("at"))
    return checkpointed(sets.join(lonely, "sid", "left").filter(
        F.coalesce("alone", F.lit(0)) <= F.col("n") - least_overlap(F.col("n"))).select("sid", "n", "at.doc", "at.key", "at.times"))


def _hashed(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(sid, n, grams) of the wanted sets (sid, n, doc, key), hashed again from one document each. Not written: for one use."""
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.xxhash64("doc", "key").alias("h"))))

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(np.asarray(batch.column(3)).view(np.uint64), table.value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(2)], names=["i", "text"])
            for rows, texts in _slices(pairs):
                here = batch.slice(rows[0], len(rows))
                yield pa.RecordBatch.from_arrays([
                    here.column(0), here.column(1),
                    pa.array([g.view(np.int64) for g in shingle_sets(_words(texts), shingle)], pa.list_(pa.int64()))], names=["sid", "n", "grams"])

    # A null doc_id stands for no smaller or larger id; here it only has to find its text again.
    marked = docs.withColumn("h", F.xxhash64("doc", "key")).select("doc", "key", "text", "h")
    texts = map_batches(marked, some, "doc long, key long, text string, h long").drop("h")
    named = wanted.select("sid", "n", "times", F.col("doc").alias("_doc"), F.col("key").alias("_key"))
    met = texts.join(named, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))
    rows = met.select("sid", "n", "text")
    if not wanted.filter("times > 1").isEmpty():
        rows = met.filter("times = 1").select("sid", "n", "text").unionAll(
            met.filter("times > 1").select("sid", "n", "text").dropDuplicates(["sid"]))
    return map_batches(rows, run, "sid long, n long, grams array<bigint>")


def _shared(sets: DataFrame) -> DataFrame:
    """(sid, h, df): the n-grams that several of the sets (sid, grams) hold, and how many do. Each occurrence is dealt out once."""
    grams = sets.select("sid", F.explode("grams").alias("h"))
    return grams.withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1")


def _enough(held: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sid, n, shared, at) of the sets (sid, n) that hold n-grams enough for a link, and these by frequency and hash."""
    found = held.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("at"))
    return checkpointed(sizes.select("sid", "n").join(found, "sid").withColumn("shared", F.size("at").cast("long")).filter(
        F.col("shared") >= least_overlap(F.col("n"))).select("sid", "n", "shared", "at"))


def _settled(kept: DataFrame) -> bool:
    """Whether the n-grams of the sets left are still shared among these, as far as one in ``PROBE`` of them, by hash, shows."""
    grams = kept.select(F.explode(F.filter("at.h", lambda h: F.pmod(h, F.lit(PROBE)) == 0)).alias("h"))
    held = grams.groupBy("h").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("shared")).first()
    return (held["shared"] or 0) >= SETTLED * (held["all"] or 0)


def ordered(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Segments (sid, n, shared, fragment, grams) of the sets that may still have links, and their prefixes (h, sid, n, shared).

    The order is by frequency among the sets of the last round, then by hash; n-grams of one set only come first and are
    left out, and never written. Any order that all sets have in common serves, so another round is made only if it thins out.
    """
    kept = _enough(_shared(_hashed(docs, wanted, shingle)), wanted)
    while not _settled(kept):  # fewer sets make n-grams rarer, so the rest is looked at again
        kept = _enough(_shared(kept.select("sid", F.col("at.h").alias("grams"))), kept)
    cuts = _cuts(kept.select(F.explode("at.df").alias("df")))
    fragment = sum((F.struct(F.col("a.df").alias("df"), F.col("a.h").alias("h")) >= F.struct(F.lit(df).alias("df"), F.lit(h).alias("h"))).cast("int")
                   for df, h in cuts) if cuts else F.lit(0)
    segments = checkpointed(kept.select("sid", "n", "shared", F.explode("at").alias("a")).groupBy(
        "sid", "n", "shared", fragment.alias("fragment")).agg(F.sort_array(F.collect_list("a.h")).alias("grams")))
    take = F.col("n") - least_overlap(F.col("n")) + 1 - (F.col("n") - F.col("shared"))
    prefixes = kept.select("sid", "n", "shared", F.posexplode(F.slice("at", F.lit(1), take.cast("int"))).alias("pos", "a")).select(
        F.col("a.h").alias("h"), "sid", "n", "shared", (F.col("shared") - F.col("pos")).alias("left"))
    return segments, checkpointed(prefixes)


def _cuts(occurrences: DataFrame) -> list[tuple[int, int]]:
    """Where the order is cut so that the fragments hold about as many occurrences each: ends of whole classes of frequency."""
    levels = occurrences.groupBy("df").agg(F.count("*").alias("n")).groupBy(F.floor(F.log2("df") * 8).alias("level")).agg(
        F.min("df").alias("df"), F.sum("n").alias("n")).orderBy("level").collect()
    total, so_far, cuts = sum(r["n"] for r in levels), 0, []
    for r in levels:
        if so_far >= total * (len(cuts) + 1) / FRAGMENTS:
            cuts.append((r["df"], -(1 << 63)))
        so_far += r["n"]
    return cuts[:FRAGMENTS - 1]


def distances(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their exact intersection and the sets' sizes: overlaps per fragment, summed per pair."""
    one = segments.select(F.col("sid").alias("a"), "fragment", F.col("grams").alias("x"), F.col("n").alias("n_a"))
    two = segments.select(F.col("sid").alias("b"), "fragment", F.col("grams").alias("y"), F.col("n").alias("n_b"))
    met = pairs.select("a", "b").join(one, "a").join(two, ["b", "fragment"])
    return checkpointed(met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("c")).groupBy("a", "b").agg(
        F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"), F.sum("c").alias("both"))).withColumn(
        "union", F.col("n_a") + F.col("n_b") - F.col("both")).select(
        "a", "b", (F.col("both") * HIGH >= F.col("union") * LOW).alias("linked"), (1 - F.col("both") / F.col("union")).alias("distance"))


def first_centres(prefixes: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sid, centre, away) of every set, and links found on the way. A centre is its own, at distance 0."""
    pivots = prefixes.groupBy("h").agg(F.min(F.struct(F.xxhash64("sid"), "sid")).alias("p"), F.count("*").alias("held")).filter(
        "held > 1").select("h", F.col("p.sid").alias("b"))
    met = prefixes.join(pivots, "h").filter("sid <> b").groupBy(F.col("sid").alias("a"), "b").agg(F.count("*").alias("n"))
    tried = met.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "b"))), 1, CENTRES).alias("to"))
    seen = distances(tried.select("a", F.explode("to.b").alias("b")), segments).filter("linked")
    links = checkpointed(seen.select("a", "b", "distance"))
    chosen = links.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("c")).select(
        F.col("a").alias("sid"), F.col("c.b").alias("centre"), F.col("c.distance").alias("away"))
    centres = chosen.select(F.col("centre").alias("sid")).distinct().withColumn("own", F.lit(True))
    sets = prefixes.select("sid").distinct()
    placed = sets.join(centres, "sid", "left").join(chosen, "sid", "left").select(
        "sid", F.when(F.col("own") | F.col("centre").isNull(), F.col("sid")).otherwise(F.col("centre")).alias("centre"),
        F.when(F.col("own") | F.col("centre").isNull(), F.lit(0.0)).otherwise(F.col("away")).alias("away"))
    return checkpointed(placed), links.select("a", "b")


def _rooted(links: DataFrame, sets: DataFrame) -> DataFrame:
    """(sid, root) of all sets."""
    nodes = connected_components(links)
    return checkpointed(sets.select("sid").join(nodes, F.col("sid") == F.col("node"), "left").select(
        "sid", F.coalesce("root", "sid").alias("root")))


def _light() -> Column:
    """A set with more than a ninth of its n-grams alone links with none of its kind; all others are light."""
    return F.col("shared") * (LOW + HIGH) >= F.col("n") * (2 * LOW)


def _met(rows: DataFrame) -> DataFrame:
    """(h, a, b, away_a, away_b): different centres whose sets share the n-gram h of their prefixes and
    may link by size, with the largest distances of these sets from their centres.

    Light ones meet all, the others meet the light ones only.
    """
    packed = rows.withColumn("light", _light()).groupBy("h", "centre", "light").agg(
        F.min("n").alias("n"), F.max("shared").alias("shared"), F.max("left").alias("left"), F.max("away").alias("away"))

    def side(df: DataFrame, end: str) -> DataFrame:
        return df.select("h", *[F.col(c).alias(f"{c}_{end}") for c in df.columns if c != "h"])

    met = side(packed.filter("light"), "x").join(side(packed, "y"), "h").filter(
        (F.col("centre_x") != F.col("centre_y"))
        & (~F.col("light_y") | (F.col("centre_x") < F.col("centre_y")))
        # The n-grams from the shared one on, and sizes that fit: bounds over all sets of both centres.
        & may_link(F.col("n_x"), F.col("n_y"), F.col("left_x"), F.col("left_y"))
        & (F.col("n_x") * LOW <= F.col("shared_y") * HIGH) & (F.col("n_y") * LOW <= F.col("shared_x") * HIGH))
    turned = F.col("centre_x") > F.col("centre_y")
    return met.select("h", F.least("centre_x", "centre_y").alias("a"), F.greatest("centre_x", "centre_y").alias("b"),
                      F.when(turned, F.col("away_y")).otherwise(F.col("away_x")).alias("away_a"),
                      F.when(turned, F.col("away_x")).otherwise(F.col("away_y")).alias("away_b")).groupBy("h", "a", "b").agg(
        F.max("away_a").alias("away_a"), F.max("away_b").alias("away_b"))


def components(prefixes: DataFrame, segments: DataFrame) -> DataFrame:
    """(sid, root) of the sets of ``prefixes``: which of them linked pairs connect.

    A linked pair shares an n-gram of both prefixes. Up to ``CROWD`` light centres at it, the pair's centres meet, so
    their number is at most in proportion to the prefixes; at any other n-gram all its sets are compared by blocks.
    """
    reach = 1 - LOW / HIGH + NEAR
    placed, found = first_centres(prefixes, segments)
    sets = placed.select("sid")
    rows = checkpointed(prefixes.join(placed, "sid"))
    crowds = checkpointed(rows.filter(_light()).groupBy("h", "centre").agg(F.count("*").alias("n")).groupBy("h").agg(
        F.count("*").alias("centres")).filter(F.col("centres") > CROWD).select("h"))
    met = checkpointed(_met(rows.join(crowds, "h", "left_anti")))
    between = distances(met.select("a", "b").distinct(), segments)
    found = checkpointed(found.unionAll(between.filter("linked").select("a", "b")))
    # Centres that are still in different components but may have linked sets.
    roots = _rooted(found, sets)
    apart = met.groupBy("a", "b").agg(F.max(F.col("away_a") + F.col("away_b")).alias("away")).filter("away > 0").join(
        between, ["a", "b"], "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))
    root_a, root_b = (roots.select(F.col("sid").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b"))
    open_ = checkpointed(apart.filter(F.col("distance") <= F.col("away") + reach).join(root_a, "a").join(root_b, "b").filter(
        "root_a <> root_b").select("a", "b", "distance"))
    late = [_crossing(open_, placed, segments)] if not open_.isEmpty() else []
    if not crowds.isEmpty():
        late.append(_in_crowds(rows.join(crowds, "h").select("h", "sid"), roots, segments))
    late = checkpointed(reduce(DataFrame.unionAll, late)) if late else None
    if late is None or late.isEmpty():
        return roots
    merged = connected_components(late.join(root_a, "a").join(root_b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    return roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select(
        "sid", F.coalesce("last", "root").alias("root"))


def _in_crowds(held: DataFrame, roots: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b): links between sets of different components that hold the same n-gram (h, sid), enough to connect these.

    Each set has one home, the n-gram of these that most sets hold; so sets that share many of them meet once and not
    at each. The sets of a home are dealt to blocks of bounded size, and every two blocks of one home, or of two whose
    sets hold an n-gram in common, meet in a group of their own, where overlaps are counted fragment by fragment and
    summed. No pair becomes a row unless it joins components.
    """
    held = checkpointed(held)
    homes = held.join(held.groupBy("h").agg(F.count("*").alias("sets")), "h").groupBy("sid").agg(
        F.max(F.struct("sets", "h")).alias("most")).select("sid", F.col("most.h").alias("home"))
    sets = _segments_of(held, segments).groupBy("sid", "n").agg(
        F.sum(F.size("grams")).alias("load"), F.collect_list(F.struct("fragment", "grams")).alias("own"))
    sets = checkpointed(sets.join(homes, "sid").join(roots, "sid"))
    parts = checkpointed(sets.groupBy("home").agg(F.ceil(F.sum("load") / BLOCK_GRAMS).cast("int").alias("parts")))
    dealt = sets.select("sid", "home").join(parts, "home").withColumn("part", F.pmod(F.xxhash64("sid", "home"), F.col("parts")).cast("int"))
    at = held.join(dealt.select("sid", "home", "part"), "sid")
    # Each set, and the homes of all that hold one of its n-grams, its own among them.
    met = at.join(at.select("h", F.col("home").alias("other")).distinct(), "h").select("sid", "home", "part", "other").distinct()
    met = checkpointed(met.join(parts.withColumnRenamed("home", "other"), "other"))
    own = F.col("home") == F.col("other")

    def side(rows: DataFrame, first: Column, last: Column, names: tuple[str, ...]) -> DataFrame:
        placed = rows.withColumn("to", F.explode(F.sequence(first, last))).select(
            "sid", *[F.col(c).alias(name) for c, name in zip(names, ("x", "y", "one", "two"), strict=True)])
        # Fresh column identities, so that both sides can be told apart.
        return placed.join(sets.select("sid", "n", "root", "own"), "sid").select(*[
            F.col(c).alias(c) for c in ("x", "y", "one", "two", "sid", "n", "root", "own")]).groupBy("x", "y", "one", "two")

    none, last = F.lit(0), F.col("parts") - 1
    ahead = side(met.filter("home <= other"), F.when(own, F.col("part")).otherwise(none), last, ("home", "other", "part", "to"))
    behind = side(met.filter("home >= other"), none, F.when(own, F.col("part")).otherwise(last), ("other", "home", "to", "part"))
    return ahead.cogroup(behind).applyInArrow(_joining, "a long, b long")


def _segments_of(sets: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments of the sets (sid), and few others: most of those are dropped where they are read, and never dealt out."""
    table = sets.sparkSession.sparkContext.broadcast(bit_table(sets.select(F.col("sid").alias("h"))))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(np.asarray(batch.column(0)).view(np.uint64), table.value)))

    return segments.select("sid", "n", "fragment", "grams").mapInArrow(some, "sid long, n long, fragment int, grams array<bigint>")


def _joining(one: pa.Table, two: pa.Table) -> pa.Table:
    """Links (a, b) across two blocks that join components: at most one less than there are components."""
    a, b = [], []
    if one.num_rows and two.num_rows:
        block, own = _Block(_unpacked(two)), one["own"].combine_chunks()
        # The components so far, of the first block's sets and of the second's as the block numbers them.
        at = one.num_rows
        label = np.concatenate((one["root"].to_numpy(), two["root"].to_numpy()[np.argsort(two["sid"].to_numpy())]))
        for i, (sid, n) in enumerate(zip(one["sid"].to_pylist(), one["n"].to_pylist(), strict=True)):
            both = block.shared_with(own[i].values)
            linked = both * HIGH >= (block.sizes + n - both) * LOW
            while (apart := linked & (label[at:] != label[i])).any():
                j = int(apart.argmax())
                label[label == label[at + j]] = label[i]
                a.append(sid)
                b.append(int(block.sids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _unpacked(sets: pa.Table) -> pa.StructArray:
    """One item (sid, n, fragment, grams) per segment of packed sets."""
    own = sets["own"].combine_chunks()
    times, flat = np.asarray(own.value_lengths()), own.flatten()
    return pa.StructArray.from_arrays([pa.array(np.repeat(sets["sid"].to_numpy(), times)), pa.array(np.repeat(sets["n"].to_numpy(), times)),
                                       flat.field("fragment"), flat.field("grams")], ["sid", "n", "fragment", "grams"])


def _crossing(centres: DataFrame, placed: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b): of each set of one centre and each block of sets of the other, the most similar pair if it is linked.

    The sets of the larger centre travel in blocks of bounded size, and a set meets a block once: its overlaps with
    all sets of the block are counted fragment by fragment and summed, and no pair becomes a row.
    """
    sets = segments.groupBy("sid", "n").agg(F.sum(F.size("grams")).alias("load"))
    members = checkpointed(placed.join(sets, "sid"))
    loads = members.groupBy("centre").agg(F.sum("load").alias("load"), F.max("away").alias("radius"))
    loads = checkpointed(loads.withColumn("parts", F.ceil(F.col("load") / BLOCK_GRAMS).cast("int")))
    a, b = (loads.select(F.col("centre").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("load", "radius", "parts")]) for x in ("a", "b"))
    first = F.col("load_a") >= F.col("load_b")
    sides = checkpointed(centres.join(a, "a").join(b, "b").select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("large"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("small"), "distance",
        F.when(first, F.col("radius_a")).otherwise(F.col("radius_b")).alias("radius"),
        F.when(first, F.col("parts_a")).otherwise(F.col("parts_b")).alias("parts")))
    dealt = checkpointed(members.join(sides.select(F.col("large").alias("centre"), "parts").distinct(), "centre").select(
        "sid", F.col("centre").alias("large"), F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part")))
    asked = checkpointed(sides.join(members.select(F.col("centre").alias("small"), "sid", "away"), "small").filter(
        F.col("away") + F.col("radius") + 1 - LOW / HIGH + NEAR >= F.col("distance")).select("large", "parts", "sid").distinct())
    segments = _segments_of(dealt.select("sid").unionAll(asked.select("sid")), segments)
    blocks = dealt.join(segments, "sid").groupBy("large", "part").agg(
        F.collect_list(F.struct("sid", "n", "fragment", "grams")).alias("held"))
    own = segments.join(asked.select("sid").distinct(), "sid").groupBy("sid", "n").agg(
        F.collect_list(F.struct("fragment", "grams")).alias("own"))
    rows = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(own, "sid").join(blocks, ["large", "part"])
    return rows.select("large", "part", "sid", "n", "own", "held").mapInArrow(_most_similar, "a long, b long")


class _Block:
    """The sets of a block by number, and its n-grams in order, fragment by fragment."""

    def __init__(self, held: pa.StructArray):
        self.sids, number = np.unique(np.asarray(held.field("sid")), return_inverse=True)
        self.sizes = np.zeros(len(self.sids), np.int64)
        self.sizes[number] = np.asarray(held.field("n"))
        fragment, (grams, lengths) = np.asarray(held.field("fragment")), _lists(held.field("grams"))
        owner, cut = np.repeat(number, lengths), np.repeat(fragment, lengths)
        self.fragments = {}
        for f in np.unique(fragment).tolist():
            there = np.flatnonzero(cut == f)
            there = there[np.argsort(grams[there])]
            self.fragments[f] = grams[there], owner[there]

    def overlaps(self, fragment: int, grams: np.ndarray) -> np.ndarray:
        """How many of ``grams`` each set of the block holds in a fragment."""
        held, owner = self.fragments.get(fragment, (np.empty(0, np.int64), np.empty(0, np.int64)))
        low, high = np.searchsorted(held, grams), np.searchsorted(held, grams, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=len(self.sids))

    def shared_with(self, own: pa.StructArray) -> np.ndarray:
        """How many n-grams each set of the block shares with a set of these segments."""
        flat, size = _lists(own.field("grams"))
        return sum(self.overlaps(f, flat[end - k:end]) for f, end, k in zip(
            np.asarray(own.field("fragment")).tolist(), np.cumsum(size).tolist(), size.tolist(), strict=True))


def _most_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, block = None, None
    for batch in batches:
        a, b = [], []
        for i, (large, part, sid, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
            if (large, part) != at:
                at, block = (large, part), _Block(batch.column(5)[i].values)
            both = block.shared_with(batch.column(4)[i].values)
            union = block.sizes + n - both
            linked = both * HIGH >= union * LOW
            if linked.any():
                a.append(sid)
                b.append(int(block.sids[np.argmax(np.where(linked, both / union, -1))]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All items of some lists, and the lists' lengths."""
    return np.asarray(lists.flatten()), np.asarray(lists.value_lengths())


def similar_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    n_shingles is the number of distinct n-grams of the lower-cased (A to Z) words, component_id the smallest doc_id
    reachable over links, the document's own included. Null texts and texts without words have none and are linked with
    nothing. Rows with a null doc_id are kept; they can link others and take the component's smallest known doc_id (null
    if there is none). Repeated rows stay repeated. N-grams are compared by 64-bit hashes. Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("key"), "text")
    scan = scanned(docs, shingle)
    segments, prefixes = ordered(docs, sliced_out(scan), shingle)
    named = scan.select("doc", "sid", "n").join(components(prefixes, segments), "sid", "left").select(
        "doc", "n", "sid", F.coalesce("root", "sid").alias("root"))
    firsts = checkpointed(named.groupBy("root").agg(F.min("doc").alias("first")))
    return named.join(firsts, "root").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc")).alias("component_id"))
