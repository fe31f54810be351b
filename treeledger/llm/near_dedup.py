"""MinHash near-duplicates with odd sketches.

1. A document's set: distinct 5-word shingles of its whole text, as 64-bit hashes. Documents of equal sets are one class
   (a 128-bit key), named by its least doc_id; copies are never paired.
2. A class has ``PERMS`` MinHash samples. Bands of ``ROWS`` samples propose candidates; the samples folded into a parity
   bitmap (odd sketch) of ``SKETCH`` bits give, by the population count of the XOR of two, the estimate that drops
   candidates far under the threshold. The rest is confirmed on full sets, exactly.
3. A bucket's members are compared with its least class only, and linked ones merged into components. Buckets left with
   members in different components are not paired out: their classes go through an exact prefix filter. With a class's
   shingles from rare to common (counted among these classes), two sets of similarity 0.75 share a shingle among the
   first quarter of the larger one's and the first seventh of the smaller one's, at places that leave enough shingles
   behind them. Copies of one text that differ in many places begin with their own edits, so they don't meet. Each
   list of a shingle is again compared with one class first, and then only what lies in different components.

A link of similarity 0.75 escapes all 40 bands of 5 samples with probability 2e-5, and needs a sketch estimate more than
five standard deviations too low (under ``FLOOR``) to be dropped.

Cases: a null, empty or blank text has an empty set, size 0, linked with nothing. A row without doc_id takes no part:
component_id is null, kept false. Rows that share a doc_id are one document, which has the links of all its texts. An
empty table gives no rows. Columns other than doc_id and text are ignored by ``components`` and handed on by
``deduplicate``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import few, map_rows, materialize, only, scratch

WORDS = 5
PERCENT = 75
BANDS, ROWS = 40, 5
PERMS = BANDS * ROWS
SKETCH = 512
#: Estimates under it are dropped: 0.75 less five times the error of 200 samples (0.031) and of the bitmap.
FLOOR = 0.55

_rng = np.random.default_rng(75)
_MUL = _rng.integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_A = (_rng.integers(0, 2**32, PERMS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 2**32, PERMS, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_SALT = _rng.integers(0, 2**64, PERMS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (two rounds of xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """The hash of a word; keeps those of short words that it has met, up to a number."""

    def __missing__(self, w: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(w) <= 32:
            if len(self) >= 20_000:
                self.clear()
            self[w] = h
        return h


class Shingler:
    """Shingle sets of whole texts."""

    def __init__(self):
        self.words = Hashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes. bytes.lower() folds A-Z only, and bytes.split() splits at x20 and x09-x0D."""
        h = np.array(list(map(self.words.__getitem__, (text or b"").lower().split())), np.uint64)
        n = len(h)
        if n < WORDS:  # the whole sequence as one, told apart by its length
            s = np.array([n] if n else [], np.uint64)
            for i in range(n):
                s = _mix(s + h[i : i + 1] * _MUL[i : i + 1])
            return s
        s = h[: n - WORDS + 1] * _MUL[0]
        for i in range(1, WORDS):
            s = s + h[i : n - WORDS + 1 + i] * _MUL[i]
        return np.unique(_mix(s))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (int64) and the odd sketch (int64 words)."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(PERMS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), 2048):  # blocks that stay in cache
        np.minimum(low, (h[at : at + 2048][None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    samples = low.astype(np.uint64)
    bands = _mix((samples.reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    bits = np.bincount((_mix(samples ^ _SALT) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return bands.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (the class), bands, sketch for each row; the last four null without words."""

    def make():
        shingles = Shingler()

        def one(d, t) -> tuple:
            s = shingles(t)
            if not len(s):
                return d, 0, None, None, None, None
            raw = s.tobytes()
            return d, len(s), *[xxhash.xxh3_64_intdigest(raw, seed) - 2**63 for seed in (1, 2)], *signature(s)

        return lambda rows: [one(d, t) for d, t in rows]

    return map_rows(_texts(docs), make, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, set array<long> of the documents whose doc_id is among ids."""

    def make():
        shingles = Shingler()
        return lambda rows: [(d, shingles(t).view(np.int64)) for d, t in rows]

    return map_rows(only(_texts(docs), ids, "id"), make, "id long, set array<long>")


def estimate(a: str, b: str):
    """The similarity that two sketches suggest: with p the share of odd bits in their XOR, 1 + N / 4k * ln(1 - 2p)."""
    odd = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    inside = F.greatest(1 - 2 * odd / F.lit(float(SKETCH)), F.lit(1e-9))
    return 1 + F.lit(SKETCH / (4.0 * PERMS)) * F.log(inside)


def _confirm(docs: DataFrame, pairs: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    # sizes alone exclude some: the smaller set over the larger bounds the similarity
    near = near.where((100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")) & (estimate("s_a", "s_b") >= FLOOR))
    near = materialize(near.select("a", "b", "n_a", "n_b"), f"near{label}")
    ids = materialize(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"ids{label}")
    sets = materialize(_sets(docs, ids).dropDuplicates(["id", "set"]), f"sets{label}")
    both = near.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    inter = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - inter
    return both.where(100 * inter >= PERCENT * union).select("a", "b").distinct()


def connect(links: DataFrame, label: str) -> DataFrame:
    """id, comp: the least id that links (a, b) reach, for every linked id. Each turn takes the least label around and
    then the label of that label, until no label changes; labels are written each turn."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"edges{label}")
    now = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), f"comp{label}")
    total = F.sum(F.col("comp").cast("decimal(38,0)"))
    seen = now.agg(total).first()[0]
    while seen is not None:
        around = edges.join(now.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        step = now.join(around, "id").select("id", F.least("comp", "c").alias("comp"))
        over = now.select(F.col("id").alias("comp"), F.col("comp").alias("c2"))
        now = materialize(step.join(over, "comp", "left").select("id", F.least("comp", F.coalesce("c2", "comp")).alias("comp")), f"comp{label}")
        then = now.agg(total).first()[0]
        if then == seen:
            break
        seen = then
    return now


def _place(n, share: float):
    """The last place (from 0), from rare to common, at which a set of n can share its first shingle with a linked one:
    n less share percent of n, rounded up."""
    return (n - F.ceil(n * share / 100.0 - 1e-9)).cast("int")


def _prefixes(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, s, pos: the first shingles of each set, from rare to common among the sets of ids."""
    ex = materialize(_sets(docs, ids).select("id", F.explode("set").alias("s")).distinct(), "shingles")
    # shingles of several sets; a list too long for one task is split by the skew join where the counts aren't few
    counted = materialize(ex.groupBy("s").agg(F.count("*").alias("f")).where("f > 1"), "counted")
    rows = ex.join(F.broadcast(counted) if few(counted) else counted, "s", "left").select("id", "s", F.coalesce("f", F.lit(1)).alias("f"))
    rows = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("l"))
    rows = rows.select("id", F.size("l").alias("n"), F.posexplode(F.slice("l", F.lit(1), _place(F.size("l"), PERCENT) + 1)).alias("pos", "x"))
    return rows.where("x.f > 1").select("id", "n", F.col("x.s").alias("s"), "pos")


def _mixed(rows: DataFrame, key: str, label: str, keep: bool = False) -> DataFrame:
    """The rows of the keys that hold more than one component."""
    keys = rows.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(key)
    return materialize(only(rows, materialize(keys, f"{label}-keys"), key), label, keep)


def _prefix_pairs(index: DataFrame, probe: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle where linked sets can: index holds the smaller."""
    share = PERCENT / (100.0 + PERCENT)
    i = index.select("s", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("comp").alias("cx"))
    j = probe.select("s", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("comp").alias("cy"))
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    fits = (F.col("cx") != F.col("cy")) & (F.col("nx") <= F.col("ny")) & (100 * F.col("nx") >= PERCENT * F.col("ny")) & (rest >= share * (F.col("nx") + F.col("ny")) - 1e-6)
    met = i.join(j, (i.s == j.s) & fits)  # a list that is long on one side only is split by the skew join
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _class_links(docs: DataFrame, classes: DataFrame, given: DataFrame) -> DataFrame:
    """id, comp of the classes that are linked, by their sets or by the given links. Sets and shingles, the largest tables,
    go as soon as what is worked out from them has been written."""
    spark = docs.sparkSession
    members = classes.select("class", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("bucket", "lo")
    held = materialize(members.join(shared, "bucket"), "buckets")
    pairs = held.where("class <> lo").select(F.col("lo").alias("a"), F.col("class").alias("b")).distinct()
    with scratch(spark):
        links = materialize(_confirm(docs, materialize(pairs, "pairs0"), classes, "0").unionByName(given), "links0", keep=True)
    comps = connect(links, "0")

    def marked(rows: DataFrame, column: str, comps: DataFrame) -> DataFrame:
        return rows.drop("comp").join(comps.select(F.col("id").alias(column), F.col("comp").alias("c")), column, "left").withColumn("comp", F.coalesce("c", column)).drop("c")

    left = _mixed(marked(held.select("bucket", "class"), "class", comps), "bucket", "mixed")
    ids = materialize(left.select(F.col("class").alias("id")).distinct(), "left")
    if ids.isEmpty():
        return comps
    with scratch(spark):
        rows = _mixed(marked(_prefixes(docs, ids), "id", comps), "s", "prefixes", keep=True)
    smaller = F.col("pos") <= _place(F.col("n"), 100 * 2 * PERCENT / (100.0 + PERCENT))
    for turn in ("1", "2"):
        with scratch(spark):
            if turn == "1":  # one class of each list: the one with the least id that can be the smaller, against the others
                centre = rows.where(smaller).groupBy("s").agg(F.min(F.struct("id", "n", "pos", "comp")).alias("c")).select("s", "c.*")
                centre = materialize(centre, "centres")
                pairs = _prefix_pairs(F.broadcast(centre) if few(centre) else centre, rows)
            else:
                pairs = _prefix_pairs(rows.where(smaller), rows)
            new = materialize(_confirm(docs, materialize(pairs, f"pairs{turn}"), classes, turn), f"links{turn}", keep=True)
        if new.isEmpty():
            continue
        links = materialize(links.unionByName(new).distinct(), f"all{turn}")
        comps = connect(links, turn)
        rows = _mixed(marked(rows, "id", comps), "s", f"lists{turn}") if turn == "1" else rows
    return comps


def _shared(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that a doc_id with several texts belongs to."""
    ids = named.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi"))
    ids = materialize(ids.where("lo < hi").select("doc_id"), "shared")
    of = only(named.select("doc_id", "k1", "k2"), ids, "doc_id").join(classes.select("k1", "k2", "class"), ["k1", "k2"])
    first = of.groupBy("doc_id").agg(F.min("class").alias("a"))
    return of.join(first, "doc_id").select("a", F.col("class").alias("b")).where("a < b").distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    sig = materialize(signatures(docs), "signatures")
    with scratch(docs.sparkSession):
        named = sig.where("doc_id is not null and n_shingles > 0")
        classes = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("class"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
        classes = materialize(classes, "classes")
        comps = _class_links(docs, classes, _shared(named, classes))
        mark = comps.select(F.col("id").alias("class"), "comp")
        final = classes.select("k1", "k2", "class").join(mark, "class", "left").select("k1", "k2", F.coalesce("comp", "class").alias("comp"))
        final = materialize(final, "final", keep=True)
    out = sig.select("doc_id", "n_shingles", "k1", "k2").join(F.broadcast(final) if few(final) else final, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs less all but one document of each component; of rows that share a doc_id one stays, rows without doc_id stay."""
    with scratch(docs.sparkSession):
        found = materialize(components(docs), "components")
        dropped = materialize(found.where("doc_id is not null and not kept").select("doc_id").distinct(), "dropped", keep=True)
        twice = materialize(found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice", keep=True)
    stay = only(docs, dropped, "doc_id", "left_anti")
    once = only(stay, twice, "doc_id", "left_anti")
    return once.unionByName(only(stay, twice, "doc_id").dropDuplicates(["doc_id"]))
