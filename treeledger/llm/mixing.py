"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Targets: the sources, ordered by code point with null last, weigh 1, 2, 3, repeating, and share all words. A target
   stops at ``cap`` times its source's size; the excess is shared again by weight until none is above.
2. Blocks: each source is dealt by hash into about sqrt(documents) blocks in all, so both the number of blocks and the
   documents in a block grow as the square root of the corpus. A source's draws are its whole blocks, repeated
   floor(target / size) times in a permuted order, and then blocks of one more pass up to the remaining quota. The
   block that crosses the quota is dealt document by document, to the nearest document; of equal documents at the cut
   (one id and text) so many copies are taken as fit.
3. Tree: the draws of all sources are split between two halves of the output shards, and again, down to single shards.
   A node hands its left half exactly half of its draws, and the sources' numbers in it follow the multivariate
   hypergeometric distribution: one hypergeometric draw after the other, by inversion at a hashed uniform number.
4. A shard draws its count of each source from the permuted blocks at offsets that no other shard has (disjoint), and
   orders its documents by hash (local shuffle).

All random numbers are hashes of keys and a seed: reruns agree. No window runs over a source's documents: those over
blocks and those inside one crossing block see about a square root of the corpus. Tables of sources hold one row a
source, in one array (a node of the tree holds an array of one number a source).

Cases: a null text has size 0, a null source is a source of its own, and a source without words has target 0. Repeated
rows are documents of their own. An empty table gives no rows. Other columns are handed on, whatever their names; those
named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeledger.llm.common import materialize, packed, scratch, unpacked, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
SHARD_LEVELS = 4  # 2 ** 4 output shards
SEED = 20261


def _uniform(*cols) -> Column:
    """In (0, 1), from a hash of the columns."""
    return (F.pmod(F.xxhash64(*cols), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, target of a table with source and size."""
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # binary order of UTF-8 bytes is code point order
    rows = sums.agg(
        F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "source_size"))).alias("s")
    )
    by = F.array(*[F.lit(float(w)) for w in weights])
    rows = rows.select(
        F.transform("s", lambda x, i: F.struct(x.source.alias("source"), x.source_size.alias("source_size"), F.element_at(by, (i % len(weights) + 1).cast("int")).alias("w"))).alias("s"),
        F.aggregate("s", F.lit(0).cast("double"), lambda a, x: a + x.source_size).alias("total"),
    )

    # Water level: a target is min(cap * size, level * weight). A source is capped if cap * size / weight is under the
    # level; in that order, the level after capping the first ones is (total - their caps) / (weight of the others).
    cw = rows.select(
        "*",
        F.array_sort(F.transform("s", lambda x: F.struct((x.source_size * cap / x.w).alias("full"), (x.source_size * F.lit(float(cap))).alias("most"), x.w.alias("w")))).alias("byfull"),
        F.aggregate("s", F.lit(0.0), lambda a, x: a + x.w).alias("allw"),
    )
    start = F.struct(F.col("total").alias("left"), F.col("allw").alias("w"), F.lit(False).alias("done"))

    def fill(a: Column, x: Column) -> Column:
        takes = ~a.done & (a.w > 0) & (x.full * a.w <= a.left)
        return F.struct(
            F.when(takes, a.left - x.most).otherwise(a.left).alias("left"),
            F.when(takes, a.w - x.w).otherwise(a.w).alias("w"),
            (a.done | ~takes).alias("done"),
        )

    level = F.aggregate("byfull", start, fill, lambda a: F.when(a.w > 0.5, a.left / a.w))
    out = cw.select(F.explode("s").alias("x"), level.alias("level"))
    return out.select(
        "x.source", "x.source_size",
        F.least(F.col("x.source_size") * F.lit(float(cap)), F.coalesce(F.col("level") * F.col("x.w"), F.lit(float("inf")))).alias("target"),
    )


def _log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 8, brought down by the product, in doubles: the product outgrows a long."""
    x = x.cast("double")
    z = x + F.lit(8.0)
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)
    return series - F.log((x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once: inside a lambda nothing else keeps a shared expression from repeating."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _hypergeometric(n: Column, k: Column, m: Column, u: Column) -> Column:
    """Of k marked among n, how many fall in a sample of m: the inverse of the distribution at u, over ten standard
    deviations around the mean and always within the possible range."""

    def bounds(v: Column) -> Column:
        mean = v.k.cast("double") * v.m / F.greatest(v.n, F.lit(1))
        var = mean * (v.n - v.k) / F.greatest(v.n, F.lit(1)) * (v.n - v.m) / F.greatest(v.n - 1, F.lit(1))
        sd = F.sqrt(F.greatest(var, F.lit(0.0)))
        lo, hi = F.greatest(F.lit(0), v.m - (v.n - v.k)), F.least(v.k, v.m)
        a = F.greatest(lo, F.floor(mean - 10 * sd - 2).cast("long"))
        b = F.greatest(a, F.least(hi, F.ceil(mean + 10 * sd + 2).cast("long")))
        return F.struct(v.n.alias("n"), v.k.alias("k"), v.m.alias("m"), v.u.alias("u"), a.alias("a"), b.alias("b"), F.least(b, F.greatest(a, F.floor(mean).cast("long"))).alias("mode"))

    def logp(v: Column, x: Column) -> Column:
        return -(_log_factorial(x) + _log_factorial(v.k - x) + _log_factorial(v.m - x) + _log_factorial(v.n - v.k - v.m + x))

    def weigh(v: Column) -> Column:
        ws = _let(logp(v, v.mode), lambda top: F.transform(F.sequence(v.a, v.b), lambda x: F.exp(logp(v, x) - top)))
        return _let(ws, lambda w: F.struct(w.alias("w"), F.aggregate(w, F.lit(0.0), lambda s, y: s + y).alias("sum")))

    def invert(v: Column) -> Column:
        start = lambda t: F.struct((v.u * t["sum"]).alias("left"), v.a.alias("x"))
        step = lambda s, y: F.struct((s.left - y).alias("left"), (s.x + F.when(s.left > y, 1).otherwise(0)).alias("x"))
        return F.least(v.b, _let(weigh(v), lambda t: F.aggregate(t.w, start(t), step, lambda s: s.x)))

    given = F.struct(n.alias("n"), k.alias("k"), m.alias("m"), u.alias("u"))
    return _let(_let(given, bounds), invert)


def splitting_tree(draws: DataFrame, levels: int = SHARD_LEVELS, seed: int = SEED) -> DataFrame:
    """shard, source, first, n: of each source's permuted draws, the n from first on go to the shard. draws: source, n."""
    root = draws.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("n").cast("long").alias("n")))).alias("q"))
    nodes = root.select(
        F.lit(0).alias("node"),
        F.transform("q", lambda x: F.struct(x.source.alias("source"), F.lit(0).cast("long").alias("first"), x.n.alias("n"))).alias("q"),
    )
    for level in range(levels):
        size = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.n)
        start = F.struct(size.alias("n"), F.floor(size / 2).cast("long").alias("m"), F.array().cast("array<bigint>").alias("out"))

        def step(a: Column, x: Column, level=level) -> Column:
            u = _uniform(F.lit(seed), F.lit(level), F.col("node"), x.source)
            got = F.when(x.n > 0, _hypergeometric(a.n, x.n, a.m, u)).otherwise(F.lit(0)).cast("long")
            return _let(got, lambda g: F.struct((a.n - x.n).alias("n"), (a.m - g).alias("m"), F.concat(a.out, F.array(g)).alias("out")))

        halves = nodes.withColumn("left", F.aggregate("q", start, lambda a, x: step(a, x), lambda a: a.out))
        side = lambda i: F.struct(
            (F.col("node") * 2 + i).alias("node"),
            F.zip_with("q", "left", lambda x, l: F.struct(x.source.alias("source"), (x.first + (l if i else F.lit(0))).cast("long").alias("first"), (x.n - l if i else l).cast("long").alias("n"))).alias("q"),
        )
        nodes = materialize(halves.select(F.explode(F.array(side(0), side(1))).alias("x")).select("x.node", "x.q"), f"tree{level}")
    return nodes.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", "x.source", "x.first", "x.n").where("n > 0")


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, levels: int = SHARD_LEVELS, seed: int = SEED) -> DataFrame:
    """The rows of docs with size, source_size, target, taken (words that the mix takes, repeats counted) and shards:
    array<struct<shard, copy, position>>, one entry for each time that the mix takes the row; position is a hash to
    order a shard by."""
    added = ["size", "source_size", "target", "taken", "shards"]
    docs = docs.drop(*added)
    text = F.col("row.text").cast("string")
    sized = packed(docs).select(
        "row", F.col("row.source").cast("string").alias("source"), word_count(text).alias("size"),
        F.xxhash64(F.lit(seed), F.col("row.doc_id"), F.xxhash64(text)).alias("h"),
    )
    with scratch(docs.sparkSession):
        per, plan = _plan(sized.select("source", "size", "h"), weights, cap, levels, seed)
    on = F.col("source").eqNullSafe(F.col("s2"))
    s3 = per.select(F.col("s2").alias("s3"), "source_size", "target", "blocks", "passes")
    out = sized.join(_few(s3), F.col("source").eqNullSafe(F.col("s3")))
    out = out.withColumn("b", F.pmod("h", "blocks")).join(_few(plan), on & (F.col("b") == F.col("b2")))
    # in the crossing block, the last pass holds only the documents up to the cut
    key = F.struct(F.xxhash64(F.lit(seed + 2), "h").alias("k"), F.col("h"))
    out = out.withColumn("under", F.coalesce(key <= F.col("last"), F.lit(False)))
    if not plan.where("tie is not null").isEmpty():
        tied = F.coalesce(key == F.col("tie"), F.lit(False))
        out = out.where(~tied).unionByName(_tied(out.where(tied)))
    under = F.col("under")
    kept = F.filter("draws", lambda d: ~F.col("crosses") | (d["copy"] < F.col("passes")) | under)
    return out.withColumn("draws", kept).select(
        *unpacked(docs.columns), "size", "source_size", "target",
        (F.col("size") * F.size("draws")).cast("long").alias("taken"),
        F.transform("draws", lambda d: F.struct(d.shard.alias("shard"), d["copy"].alias("copy"), F.xxhash64(F.lit(seed + 3), d.shard, d["copy"], "h").alias("position"))).alias("shards"),
    )


def _tied(rows: DataFrame) -> DataFrame:
    """Rows of the documents, equal in id and text, of which the mix takes some in its last pass: as many as the plan says are
    under the cut. They are numbered by the part of the table they come from, so that no task holds all of them."""
    with scratch(rows.sparkSession):
        rows = materialize(rows.withColumn("part", F.spark_partition_id()).withColumn("row_id", F.monotonically_increasing_id()), "tied", keep=True)
        parts = rows.groupBy("source", "h", "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("source", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(F.col("source").alias("s4"), F.col("h").alias("h4"), F.col("part").alias("p4"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        parts = materialize(parts, "tied-parts", keep=True)
    own = F.row_number().over(Window.partitionBy("source", "h", "part").orderBy("row_id"))
    on = F.col("source").eqNullSafe(F.col("s4")) & (F.col("h") == F.col("h4")) & (F.col("part") == F.col("p4"))
    out = rows.withColumn("own", own).join(_few(parts), on)
    return out.withColumn("under", F.col("before") + F.col("own") <= F.col("copies")).drop("part", "row_id", "own", "s4", "h4", "p4", "before")


def _plan(sized: DataFrame, weights, cap: float, levels: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of documents (source, size, h): the sources (s2, source_size, target, blocks, passes, extra), and the blocks (s2, b2,
    draws, crosses, last, tie, copies) with the draws that the shards make from them."""
    # which block: from the share of the documents, about sqrt(documents) in all, at least one for each source
    narrow = materialize(sized, "sizes")
    per = materialize(source_targets(narrow).join(narrow.groupBy("source").agg(F.count("*").alias("docs")).withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "targets")
    corpus = per.agg(F.sum("docs").alias("n"))
    per = per.crossJoin(corpus).select(
        "source", "source_size", "target",
        F.greatest(F.lit(1), F.ceil(F.col("docs") / F.sqrt("n"))).cast("long").alias("blocks"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long").alias("passes"),
    ).withColumn("extra", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    per = materialize(per, "sources", keep=True).withColumnRenamed("source", "s2")
    on = F.col("source").eqNullSafe(F.col("s2"))
    in_block = narrow.join(per.select("s2", "blocks"), on).select("source", "size", "h", F.pmod("h", "blocks").alias("block"))

    blocks = in_block.groupBy("source", "block").agg(F.sum("size").alias("words")).join(per.select("s2", "extra"), on)
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block")
    blocks = blocks.select(
        "source", "block", "words", "extra",
        (F.row_number().over(order) - 1).alias("rank"),
        F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    ).select(
        "source", "block", "rank",
        (F.col("upto") <= F.col("extra")).alias("whole"),
        ((F.col("upto") > F.col("extra")) & (F.col("upto") - F.col("words") < F.col("extra"))).alias("crosses"),
        (F.col("extra") - (F.col("upto") - F.col("words"))).alias("rest"),
    )
    blocks = materialize(blocks, "blocks")

    # inside a crossing block: documents in hashed order while their middle is under the quota; equal ones are one row of
    # the order, of which a number of copies is taken
    b = blocks.where("crosses").select(F.col("source").alias("s2"), F.col("block").alias("b2"), "rest")
    inner = in_block.where("size > 0").join(b, on & (F.col("block") == F.col("b2")))
    inner = inner.groupBy("source", "block", "h").agg(F.sum("size").alias("words"), F.count("*").alias("copies"), F.first("rest").alias("rest"))
    inner = inner.withColumn("key", F.struct(F.xxhash64(F.lit(seed + 2), "h").alias("k"), F.col("h")))
    run = Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("words").over(run), F.lit(0))
    taken = F.least(F.col("copies"), F.floor(left * F.col("copies") / F.col("words") + 0.5))
    partial = inner.withColumn("taken", taken).where("taken > 0")
    whole = F.col("taken") == F.col("copies")
    cut = materialize(partial.groupBy("source", "block").agg(
        F.max(F.when(whole, F.col("key"))).alias("last"), F.max(F.when(~whole, F.col("key"))).alias("tie"), F.max(F.when(~whole, F.col("taken"))).alias("copies")
    ), "cut")

    counts = blocks.groupBy("source").agg(F.count("*").alias("nb"), F.sum((F.col("whole") | F.col("crosses")).cast("long")).alias("more"))
    counts = counts.join(per.select("s2", "passes"), on).select("source", "nb", (F.col("nb") * F.col("passes") + F.col("more")).alias("n"))
    counts = materialize(counts, "draws")
    # draws: position p of a source is its block of rank p % nb, pass p // nb
    tree = splitting_tree(counts.select("source", "n"), levels, seed)
    drawn = tree.select(F.col("source").alias("s2"), "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("p"))
    drawn = drawn.join(counts, on).select("source", "shard", F.pmod("p", "nb").alias("rank"), F.floor(F.col("p") / F.col("nb")).cast("int").alias("copy"))
    held = drawn.select(F.col("source").alias("s2"), F.col("rank").alias("r2"), "shard", "copy")
    plan = blocks.join(held, on & (F.col("rank") == F.col("r2")), "left").groupBy("source", "block").agg(
        F.array_sort(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("copy", "shard")))).alias("draws"), F.first("crosses").alias("crosses")
    )
    c2 = cut.select(F.col("source").alias("s2"), F.col("block").alias("b2"), "last", "tie", "copies")
    plan = plan.join(c2, on & (F.col("block") == F.col("b2")), "left").select("source", "block", "draws", "crosses", "last", "tie", "copies")
    plan = materialize(plan, "plan", keep=True)
    return per, plan.select(F.col("source").alias("s2"), F.col("block").alias("b2"), "draws", "crosses", "last", "tie", "copies")


def _few(df: DataFrame, bound: int = 200_000) -> DataFrame:
    """Broadcast a written table if its rows are few, so that texts need no shuffle; else let the join shuffle."""
    return F.broadcast(df) if df.count() <= bound else df
