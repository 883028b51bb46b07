"""MinHash near-duplicates with b-bit signatures.

Each distinct shingle set gets ``BANDS * ROWS`` minima. Sets that agree in all minima of some band are candidates. The low ``BITS`` bits
of the minima are packed into longs; the share of equal fields, counted with bit operations and corrected for chance collisions,
estimates the similarity and drops candidates that are far below the threshold. What is left is confirmed on the full sets.

Two sets at the threshold of 0.8 share no band with probability (1 - 0.8**5)**50 < 3e-9; the estimate is cut ``SIGMAS`` standard errors
below the threshold, under 1e-11. Groups of copies never become pairs: equal sets are one node, members of a band's bucket first meet
only the one among them that shares most buckets with others, the centre of its group, and only nodes still in different components
after that can meet each other.

Those would still be all pairs of a large group whose members are not quite similar enough. Such a group is split by how its members differ
from what they have in common (``still_apart``): members with few differences are linked by arithmetic alone, all others must share some of
their differences and meet only those that share them. A part that is still large is split again by what it has in common. No link is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomdiff.functions.stage import written
from roomdiff.llm.text import Memo, as_bytes, hash64, long_array, own, slices, split_words, unused, window_hashes
from roomdiff.operators.components import connect

WORDS = 5
PERCENT = 80
BANDS, ROWS, BITS = 50, 5, 2
SIGMAS = 7.0
FEW = 20                                    # members of a group that meet in pairs
SHARE = 1000                                # pairs of one node that a task confirms
LONGS = 8                                   # of 64 bits: room for 32 fields of 2 bits each
_FIELDS = BANDS * ROWS
_rng = np.random.default_rng(20240501)
_MULTIPLY = _rng.integers(0, 1 << 31, _FIELDS, np.uint32) * 2 + 1
_ADD = _rng.integers(0, 1 << 32, _FIELDS, np.uint32)


def shingles(words: list[bytes], n: int, hashed) -> np.ndarray:
    """Sorted distinct hashes of ``n``-word runs; fewer words are one shingle; none without words."""
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    got = window_hashes(ids, n) if len(ids) >= n else window_hashes(ids, len(ids))
    return np.unique(got)


def minima(found: np.ndarray) -> np.ndarray:
    """The minima of a shingle set under all permutations, mixed so that their low bits are even."""
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    low = np.full(_FIELDS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at:at + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    low ^= low >> np.uint32(16)
    low *= np.uint32(0x85EBCA6B)
    return low ^ (low >> np.uint32(13))


def bands_of(low: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        keys = (keys ^ low[k::ROWS].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """Two low bits of each minimum, 32 fields to a long."""
    fields = np.zeros(LONGS * 32, np.uint64)
    fields[:_FIELDS] = low & np.uint32(3)
    return np.bitwise_or.reduce(fields.reshape(LONGS, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1).view(np.int64)


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, d1, d2, bands, s0..s7) of every row; d1, d2: 128 bits that stand for the set, null without words."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_shingles", "d1", "d2", "bands", *(f"s{k}" for k in range(LONGS))]

    def run(batches):
        hashed = Memo(hash64)
        for part in slices(batches):
            sizes, digests, bands, packs = [], [], [], []
            for raw in as_bytes(part.column(1)):
                got = shingles(split_words(raw), n, hashed)
                sizes.append(len(got))
                if len(got):
                    low = minima(got)
                    mark = xxhash.xxh128_digest(got.tobytes())
                    digests.append((int.from_bytes(mark[:8], "big", signed=True), int.from_bytes(mark[8:], "big", signed=True)))
                    bands.append(bands_of(low))
                    packs.append(packed(low))
                else:
                    digests.append((None, None))
                    bands.append(np.empty(0, np.int64))
                    packs.append(np.zeros(LONGS, np.int64))
            marks = [pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)]
            packs = np.array(packs, np.int64).reshape(-1, LONGS)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *marks, long_array(bands), *(pa.array(packs[:, k]) for k in range(LONGS))], names=names)

    schema = f"id {kind}, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, " + ", ".join(f"s{k} bigint" for k in range(LONGS))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, hashes) of (id, text)."""
    def run(batches):
        hashed = Memo(hash64)
        for part in slices(batches, 128):
            yield pa.RecordBatch.from_arrays([part.column(0), long_array([shingles(split_words(x), n, hashed).view(np.int64) for x in as_bytes(part.column(1))])], names=["id", "hashes"])
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, hashes array<bigint>")


def likely(percent: int) -> str:
    """SQL: the collision-corrected estimate of sides a and b is not far below the threshold, and their sizes allow it."""
    differ = " + ".join(f"bit_count(((a.s{k} ^ b.s{k}) | shiftrightunsigned(a.s{k} ^ b.s{k}, 1)) & 6148914691236517205)" for k in range(LONGS))
    chance, at = 2.0 ** -BITS, percent / 100
    match = chance + (1 - chance) * at
    least = at - SIGMAS * np.sqrt(match * (1 - match) / _FIELDS) / (1 - chance)
    most_differ = int(np.floor(_FIELDS * (1 - chance - (1 - chance) * least)))
    return f"{differ} <= {most_differ} and 100 * least(a.n_shingles, b.n_shingles) >= {percent} * greatest(a.n_shingles, b.n_shingles)"


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, w) of ids whose full shingle sets ``sets(id, hashes)`` are similar enough. The pairs of a node that has very many are dealt
    out in shares of ``SHARE`` or so, with a copy of its set for each."""
    many = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARE).select("u", F.expr(f"n div {SHARE} + 1").alias("parts"))
    many = written(many, "many")
    dealt = pairs.join(many, "u", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("w"), F.col("parts")), F.lit(0))).drop("parts")
    copies = sets.withColumnRenamed("id", "u").join(many, "u", "left").select("u", F.col("hashes").alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - F.lit(1).cast("bigint"))).alias("part"))
    both = (dealt.hint("merge").join(copies, ["u", "part"]).hint("merge")
            .join(sets.select(F.col("id").alias("w"), F.col("hashes").alias("y")), "w").withColumn("same", F.size(F.array_intersect("x", "y"))))
    return both.filter(100 * F.col("same") >= percent * (F.size("x") + F.size("y") - F.col("same"))).select("u", "w").distinct()


def centred(state: DataFrame) -> DataFrame:
    """``state(g, node, r, comp, size, fixed, items)`` with each group's items taken relative to what more than half of its members hold: an item is
    then a difference, of either sign. Differences that no other member has go from ``items`` to the count ``fixed``; the others are sorted
    from the rarest to the commonest. What two members differ in stays the same."""
    keys = ["g", "node", "r"]
    n = state.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    held = state.select("g", F.explode("items").alias("e")).groupBy("g", "e").agg(F.count(F.lit(1)).alias("k")).join(n, "g").filter("2 * k > n")
    common, none = held.groupBy("g").agg(F.collect_list("e").alias("common")), F.array().cast("array<bigint>")
    rows = state.join(common, "g", "left").withColumn("common", F.coalesce("common", none))
    rows = written(rows.withColumn("items", F.concat(F.array_except("items", "common"), F.array_except("common", "items"))).drop("common"), "differences")
    each = rows.select(*keys, F.explode("items").alias("e"))
    often = each.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("g", "e"))).filter("k > 1")
    lists = often.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("kept"))
    rows = rows.join(lists, keys, "left").withColumn("kept", F.coalesce(F.expr("transform(kept, x -> x.e)"), none))
    return rows.select(*keys, "comp", "size", (F.col("fixed") + F.size("items") - F.size("kept")).alias("fixed"), F.col("kept").alias("items"))


def within_reach(rows: DataFrame, unit: int) -> DataFrame:
    """The members ``rows(g, node, comp, c, len, …)`` that may be linked with one of another component of their group, and ``need``, how many differences
    such a pair shares at least. A pair needs (c + c') / unit shared differences, and neither can share more than it has: of the members of each
    length the least c stands for all, and beside it the least of another component for those of its own."""
    by = rows.groupBy("g", "comp", "len").agg(F.min("c").alias("c"))
    best = by.groupBy("g", "len").agg(F.min(F.struct("c", "comp")).alias("b"))
    other = by.join(best, ["g", "len"]).filter("comp <> b.comp").groupBy("g", "len").agg(F.min("c").alias("c2"))
    best = best.join(other, ["g", "len"], "left").groupBy("g").agg(F.collect_list(F.struct("len", F.col("b.c").alias("c1"), F.col("b.comp").alias("comp1"), "c2")).alias("best"))
    that = "if(x.comp1 = comp, x.c2, x.c1)"
    enough = F.expr(f"array_min(transform(filter(best, x -> c + {that} <= {unit} * least(len, x.len)), x -> greatest(1, cast(ceil((c + {that}) / {unit}) as int))))")
    return rows.join(best, "g").withColumn("need", enough).drop("best").filter("need is not null")


def still_apart(apart: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, w) that may be linked, among the nodes of ``apart(band, node, comp)``: bands connect them, but they lie in different components. Of each
    link between components there is one here, or a chain of others that does the same.

    Take any set K for a group, here what most of its members hold, and the differences D(u) = u xor K. As u xor w = D(u) xor D(w), two members
    are linked if and only if C(u) + C(w) <= 2 (100 + p) |D(u) and D(w)| with C(u) = (100 + p) |D(u)| - (100 - p) |u|. So members with
    C(u) + C(w) <= 0 are linked, and the one with the least C to all that are in such a pair: a star stands for them. All other linked pairs share
    (C(u) + C(w)) / 2 (100 + p) differences or more, and a member meets others only at the first of its differences that it shares, so at none
    that has too few behind it. Who shares a difference is a group; ``FEW`` members are paired, more are a group of their own with what they
    have in common, which makes their differences fewer. Differences before the shared one count as not shared, so each pair is looked for once.
    """
    whole, off = 100 + percent, 100 - percent
    hubs = apart.groupBy("band").agg(F.min("node").alias("w"))
    band_of = connect(apart.join(hubs, "band").select(F.col("node").alias("u"), "w").distinct(), []).select("node", F.col("comp").alias("g"))
    open_nodes = apart.select("node", "comp").distinct().join(band_of, "node")
    state = sets.withColumnRenamed("id", "node").join(open_nodes, "node").select("g", "node", F.xxhash64("hashes").alias("r"), "comp", F.size("hashes").alias("size"),
                                                                               F.lit(0).alias("fixed"), F.col("hashes").alias("items")).dropDuplicates(["g", "node", "r"])
    found = None
    while True:
        state = written(centred(state), "state")
        rows = state.withColumn("len", F.size("items")).withColumn("c", whole * (F.col("fixed") + F.col("len")) - off * F.col("size"))
        least = rows.groupBy("g").agg(F.min(F.struct("c", "node", "comp")).alias("m"), F.min("comp").alias("first"), F.max("comp").alias("last")).filter("first < last").select("g", "m")
        rows = rows.join(least, "g").withColumn("starred", F.col("c") + F.col("m.c") <= 0)
        # Components with a member in the star are one from here on.
        joined = rows.groupBy("g", "comp").agg(F.max("starred").alias("joined")).filter("joined")
        rows = written(rows.join(joined, ["g", "comp"], "left").withColumn("comp", F.when(F.col("joined"), F.col("m.comp")).otherwise(F.col("comp"))).drop("joined"), "members")
        star = rows.filter("starred and node <> m.node").select(F.greatest("node", "m.node").alias("u"), F.least("node", "m.node").alias("w"))
        rows = written(within_reach(rows.drop("m", "starred"), 2 * whole), "reach")
        probes = rows.select("g", "node", "r", "comp", "c", "len", F.posexplode(F.slice("items", F.lit(1), F.col("len") - F.col("need") + 1)).alias("at", "e"))
        probes = written(probes, "probes")
        met = probes.groupBy("g", "e").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("first"), F.max("comp").alias("last")).filter("first < last").select("g", "e", "n")
        met = written(met, "met")
        few = probes.join(met.filter(F.col("n") <= FEW), ["g", "e"]).select("g", "e", "node", "comp", "c", (F.col("len") - F.col("at")).alias("left"))
        close = few.alias("a").join(few.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.e") == F.col("b.e")) & (F.col("a.comp") < F.col("b.comp"))
                                    & (F.col("a.c") + F.col("b.c") <= 2 * whole * F.least("a.left", "b.left"))).select(
            F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("w"))
        got = written(star.union(close).distinct(), "pairs")
        found = got if found is None else found.union(got)
        many = probes.join(met.filter(F.col("n") > FEW).drop("n"), ["g", "e"]).select("g", "e", "node", "r", "at")
        state = many.join(rows, ["g", "node", "r"]).select(F.xxhash64("g", "e").alias("g"), "node", "r", "comp", "size", (F.col("fixed") + F.col("at")).alias("fixed"),
                                                           F.expr("slice(items, at + 2, size(items))").alias("items"))
        state = written(state, "parts")
        if state.isEmpty():
            break
    sides = nodes.select("node", "n_shingles", *(f"s{k}" for k in range(LONGS)))
    near = found.distinct().join(sides.alias("a"), F.col("u") == F.col("a.node")).join(sides.alias("b"), (F.col("w") == F.col("b.node")) & F.expr(likely(percent)))
    return near.select("u", "w").distinct()


def components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row: links are pairs of documents whose sets of ``n``-word shingles have a Jaccard
    similarity of ``percent`` or more, component_id is the smallest id that can be reached, kept is id = component_id.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows without an id are linked with nothing, have a null
    component_id and are kept. Rows that repeat an id are one document with several texts: a link of one is a link of all of them, and
    each row is returned. An empty table gives no rows.
    """
    docs = docs.select(own(docs, id_col).alias("id"), own(docs, text_col).cast("string").alias("text"))
    signed = written(signatures(docs, n, "id", "text"), "signatures")
    packs = [f"s{k}" for k in range(LONGS)]
    real = signed.filter("id is not null and d1 is not null")
    nodes = written(real.groupBy("d1", "d2").agg(F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
                                                 *(F.first(p).alias(p) for p in packs)), "nodes")
    buckets = nodes.select(F.explode("bands").alias("band"), "node")
    shared = written(buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = written(buckets.join(shared, "band").select("band", "node", "n"), "members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    centre = members.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("c")).select("band", F.col("c.node").alias("end"))
    # The full sets of all that may be compared. The texts are met by a sorted join whatever the sizes, so that a large run does as a small one.
    asked = members.select(F.col("node").alias("id")).distinct().hint("merge")
    sets = written(full_sets(docs.join(asked, "id", "left_semi").dropDuplicates(["id", "text"]), n), "sets")

    sides = nodes.select("node", "n_shingles", *packs)
    ends = members.join(centre, "band").filter("node <> end")
    pairs = written(ends.select(F.greatest("node", "end").alias("u"), F.least("node", "end").alias("w")).distinct(), "pairs")
    near = (pairs.join(sides.alias("a"), F.col("u") == F.col("a.node")).join(sides.alias("b"), (F.col("w") == F.col("b.node")) & F.expr(likely(percent)))
            .select("u", "w").distinct())
    twice = (real.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("b")).filter("a <> b").select("id")
             .join(real, "id").join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).select(F.greatest("id", "node").alias("u"), F.least("id", "node").alias("w")))
    links = written(confirm(near, sets, percent).union(twice), "links")
    found = connect(links, [])

    # What the first round left apart: nodes of one bucket in different components.
    placed = members.select("band", "node").join(found, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    open_bands = placed.groupBy("band").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).filter("first < last").select("band")
    apart = written(placed.join(open_bands, "band", "left_semi"), "apart")
    rest = written(still_apart(apart, nodes, sets, percent).join(pairs, ["u", "w"], "left_anti"), "rest")
    more = written(confirm(rest, sets, percent), "links")
    if not more.isEmpty():
        found = connect(links.union(more), [])

    comps = nodes.select("d1", "d2", "node").join(found, "node", "left").select("d1", "d2", F.coalesce("comp", "node").alias("comp"))
    out = signed.select("id", "n_shingles", "d1", "d2").join(comps, ["d1", "d2"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, with all columns: the one with the smallest id, of rows that repeat it the one
    whose text has the smallest hash. Rows without an id all stay."""
    key = own(docs, id_col)
    gone = components(docs, n, percent, id_col, text_col).filter("not kept").select(F.col(f"`{id_col}`").alias("gone")).distinct()
    left = docs.join(gone, key == gone["gone"], "left_anti")
    if docs.filter(key.isNotNull()).groupBy(key).count().filter("count > 1").isEmpty():
        return left
    rank = unused(docs, "rank")
    first = Window.partitionBy(key).orderBy(F.xxhash64(own(docs, text_col)))
    ranked = left.filter(key.isNotNull()).withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).drop(rank)
    return ranked.unionByName(left.filter(key.isNull()))
