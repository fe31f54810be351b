"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed patterns find: email, ip, card with Luhn's check, phone, and secret (credentials of known prefixes,
and strings of 40 hexadecimal digits that are assigned in quotes). Beside them a text holds candidates, strings of a like
form that the patterns do not take: an address without a dotted host (form 0), a number without a plus sign or without a
valid check digit (1), a long string of letters and digits (2). An occurrence of either has four lexical patterns: the
word before it, the two words before, the word before with the word after, the two words after. Words are runs of letters
and digits, in lower case; those with digits are all one word.

Spark scores the graph of patterns and instances in rounds. A pattern's confidence in a kind is the share of the kind's
trusted instances among all decided ones that it meets: ordinary words in the same context (counted over the whole
corpus), strings of another form, instances trusted as another kind, and candidates that are distrusted as this kind
count against it; candidates that nothing has decided yet do not count. A pattern is judged from ``SUPPORT`` distinct
trusted instances and counts from confidence ``TRUST``. An instance's score is 1 - prod(1 - confidence) over its
patterns that count; from ``TRUST`` it is trusted for good, as much as a seed, so that it can qualify patterns which no
seed stands in. A candidate is distrusted if all patterns judged together give it 1 - ``TRUST`` or less. Rounds go on
until none trusts a new instance. Then the occurrences of trusted candidates under patterns that count become spans of
that kind. Seeds stay whatever the graph says.

All work on one text is linear in its length: words are hashed once, and a pattern is a 64-bit hash of its words.

Cases: a null or empty text has no spans. Repeated rows have the same spans each; rows are told apart by a 128-bit hash of
id and text. A null doc_id stays null. An empty table gives no rows. Other columns are ignored by ``annotate`` and handed
on by ``redact``, whatever their names. Texts are scanned whole, in code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import as_text, few, map_rows, materialize, packed, row_key, scratch, unpacked

#: The base kinds, and all kinds.
KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "secret")
# The base patterns, written so that no text takes more than linear time, and the seeds of secrets.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24}|(?<== \")[0-9a-f]{40}(?=\"))(?![A-Za-z0-9])")
#: Forms of candidates: around an at sign, seven digits and more with separators, twenty letters and digits and more.
_AROUND = "\\s@,;:<>()\"'"
_LEFT, _RIGHT = re.compile(f"[{_AROUND}]"), re.compile(f"[^{_AROUND}]+")
LIKE_NUMBER = re.compile(r"[0-9](?:[\x20()./-]{0,2}[0-9]){6,}")
LIKE_TOKEN = re.compile(r"[A-Za-z0-9_-]{20,}")
_FORM = {0: 0, 1: 1, 2: 1, 3: 1, 4: 2}
_SOME = re.compile("[0-9@]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"\w+")
SUPPORT, TRUST = 3, 0.9
LONG = 64

_rng = np.random.default_rng(6)
_MUL = _rng.integers(0, 2**64, 7, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, 4, dtype=np.uint64)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    """From each at sign to the left over local characters, as far as the last match or at sign, and to the right over a
    dotted host: what a leftmost search for the whole pattern finds, without trying every place to its left."""
    out, low = [], 0
    p = text.find("@")
    while p >= 0:
        a = low + len(text[low:p].rstrip(LOCAL))
        m = HOST.match(text, p + 1) if a < p else None
        if m:
            out.append((a, 0, m.end()))
        low = m.end() if m else p + 1
        p = text.find("@", low)
    return out


def _ips(text: str) -> list[tuple[int, int, int]]:
    """Four parts after four parts of each dotted chain of numbers."""
    out = []
    for m in DOTTED.finditer(text):
        parts, a = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            b = a + sum(map(len, parts[i : i + 4])) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in parts[i : i + 4]):
                out.append((a, 1, b))
            a = b + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost, non-overlapping in each kind; a match that fails its test is
    dropped and not tried again."""
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += _ips(text)
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out)


def secret_seeds(text: str) -> list[tuple[int, int, int]]:
    return [(m.start(), 4, m.end()) for m in SECRET.finditer(text)] if _DIGIT.search(text) else []


def _apart(found: list[tuple[int, int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of found that overlap no span: the union of the spans as apart stretches, looked up by place."""
    starts, ends = [], []
    for a, _, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [x for x in found if (i := bisect_right(ends, x[0])) == len(starts) or starts[i] >= x[2]]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, form, end) of strings that look alike and overlap no span, nor a candidate of a form named before: around
    an at sign, of letters and digits, a number."""
    found, low = [], 0
    p = text.find("@")
    while p >= 0:
        left = max((m.end() for m in _LEFT.finditer(text, low, p)), default=low)
        m = _RIGHT.match(text, p + 1) if left < p else None
        if m:
            found.append((left, 0, m.end()))
        low = m.end() if m else p + 1
        p = text.find("@", low)
    found = _apart(found, spans)
    mixed = [m for m in LIKE_TOKEN.finditer(text) if _DIGIT.search(m.group()) and any(c.isalpha() for c in m.group())]
    found += _apart([(m.start(), 2, m.end()) for m in mixed], spans + found)
    return found + _apart([(m.start(), 1, m.end()) for m in LIKE_NUMBER.finditer(text)], spans + found)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def patterns_of(b2: np.ndarray, b1: np.ndarray, a1: np.ndarray, a2: np.ndarray) -> np.ndarray:
    """(4, n) int64: the patterns of places whose words before are b2 b1 and whose words after are a1 a2."""
    m, c = _MUL, _ADD
    return _mix(np.stack([b1 * m[0] + c[0], b2 * m[1] + b1 * m[2] + c[1], b1 * m[3] + a1 * m[4] + c[2], a1 * m[5] + a2 * m[6] + c[3]])).view(np.int64)


class Words(dict):
    """The hash of a word as patterns know it; keeps those it has met, up to a number."""

    EDGES = np.array([1, 1, 2, 2], np.uint64)  # two before a text, two after it

    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest("0" if _DIGIT.search(w) else w.lower().encode("utf-8", "surrogatepass"))
        if len(w) <= LONG:
            if len(self) > 20_000:
                self.clear()
            self[w] = h
        return h

    def __call__(self, words: list[str]) -> np.ndarray:
        e = self.EDGES
        return np.concatenate([e[:2], np.array(list(map(self.__getitem__, words)), np.uint64), e[2:]])


def spell(s: str) -> str:
    """An instance as the graph knows it."""
    s = s.lower()
    return s if len(s) <= LONG else xxhash.xxh3_128_hexdigest(s.encode("utf-8", "surrogatepass"))


def places(starts: list[int], ends: list[int], a: int, b: int) -> tuple[int, int]:
    """The words i to j - 1 that lie in the stretch from a to b, whole or in part."""
    return bisect_right(ends, a), bisect_left(starts, b)


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_OCC = "array<struct<start:int,end:int,kind:int,form:int,inst:string,ctx:array<long>>>"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text; key stands for id and text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(F.col("text")).alias("text"))
    return d.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key, base, seeds (spans), occ: occurrences of seeds and candidates, a row for each row."""

    def make():
        known = Words()

        def one(t: str) -> tuple[list, list, list]:
            base, seeds = base_spans(t), secret_seeds(t)
            found = [(a, b, k, _FORM[k]) for a, k, b in base + seeds] + [(a, b, -1, form) for a, form, b in candidates(t, base + seeds)]
            if not found:
                return [], [], []
            at = list(_WORD.finditer(t))
            starts, ends = [m.start() for m in at], [m.end() for m in at]
            w = known([m.group() for m in at])
            ij = np.array([places(starts, ends, a, b) for a, b, _, _ in found])
            i, j = ij[:, 0] + 2, ij[:, 1] + 2
            ctx = patterns_of(w[i - 2], w[i - 1], w[j], w[j + 1]).T.tolist()
            occ = [{"start": a, "end": b, "kind": k, "form": f, "inst": spell(t[a:b]), "ctx": c} for (a, b, k, f), c in zip(found, ctx, strict=True)]
            span = lambda rows: [{"start": a, "kind": k, "end": b} for a, k, b in rows]
            return span(base), span(seeds), occ

        return lambda rows: [(d, k, *(one(t) if _SOME.search(t) else ([], [], []))) for d, k, t in rows]

    return map_rows(keyed(docs), make, f"doc_id long, key struct<a:long,b:long>, base {_SPANS}, seeds {_SPANS}, occ {_OCC}")


def bit_table(contexts: DataFrame) -> np.ndarray:
    """A bit for each context modulo a power of two, 16 times their number if that is at most 2 ** 28: what the corpus
    scan looks up. Contexts that share a bit are told apart by a join afterwards."""
    n = contexts.count()
    bits = 1 << max(15, min(28, (16 * n).bit_length()))
    at = contexts.select(F.pmod("ctx", F.lit(bits)).alias("at"))
    rows = at.groupBy(F.shiftright("at", 15).alias("g")).agg(F.bitmap_construct_agg(F.col("at") % (1 << 15)).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r.g << 12 : (r.g + 1) << 12] = np.frombuffer(r.m, np.uint8)
    return out


def background(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """ctx, words: how often each context occurs in the corpus around a word that is no seed or candidate."""
    held = docs.sparkSession.sparkContext.broadcast(bit_table(contexts))

    def make():
        known, bits = Words(), held.value
        last = np.int64(8 * len(bits) - 1)

        def one(t: str) -> tuple[np.ndarray, np.ndarray]:
            """Hashes of the words with the edges around, and which of them are places of ordinary words."""
            if not _SOME.search(t):
                w = known(_WORD.findall(t))
                free = np.ones(len(w), bool)
            else:
                at = list(_WORD.finditer(t))
                w = known([m.group() for m in at])
                free = np.ones(len(w), bool)
                spans = base_spans(t) + secret_seeds(t)
                starts, ends = [m.start() for m in at], [m.end() for m in at]
                for a, _, b in spans + candidates(t, spans):
                    i, j = places(starts, ends, a, b)
                    free[i + 2 : j + 2] = False
            free[:2] = free[-2:] = False
            return w, free

        def work(rows):
            w, free = (np.concatenate(x) for x in zip(*(one(t) for (t,) in rows), strict=True))
            i = np.nonzero(free)[0]
            ctx = patterns_of(w[i - 2], w[i - 1], w[i + 1], w[i + 2]).ravel()
            at = ctx & last
            ctx, n = np.unique(ctx[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1], return_counts=True)
            return list(zip(ctx.tolist(), n.tolist(), strict=True))

        return work

    found = map_rows(docs.select(as_text(F.col("text")).alias("text")), make, "ctx long, words long")
    found = found.groupBy("ctx").agg(F.sum("words").alias("words"))
    return found.join(F.broadcast(contexts) if few(contexts) else contexts, "ctx", "left_semi")


def discover(docs: DataFrame, scanned: DataFrame, support: int = SUPPORT, trust: float = TRUST) -> DataFrame | None:
    """key, start, kind, end of the candidates that trusted patterns vouch for; None if no pattern can qualify."""
    occ = scanned.select("key", F.explode("occ").alias("o")).select("key", "o.start", "o.end", "o.kind", "o.form", "o.inst", F.explode("o.ctx").alias("ctx"))
    occ = materialize(occ, "occurrences")
    # whatever comes to be trusted, a pattern takes ``support`` instances and something to discover: others are of no use
    useful = occ.groupBy("form", "ctx").agg(F.count_distinct("inst").alias("insts"), F.max((F.col("kind") < 0).cast("int")).alias("new"))
    useful = materialize(useful.where((F.col("insts") >= support) & (F.col("new") == 1)).select("form", "ctx"), "useful")
    if useful.isEmpty():
        return None
    hint = F.broadcast if few(useful) else lambda x: x
    forms = occ.groupBy("ctx", F.col("form").alias("other")).agg(F.count("*").alias("others"))
    forms = forms.join(hint(useful), "ctx").where("form <> other").groupBy("form", "ctx").agg(F.sum("others").alias("others"))
    words = materialize(background(docs, materialize(useful.select("ctx").distinct(), "contexts")), "background")
    # what speaks against a pattern from the start: ordinary words and strings of another form
    no = useful.join(words, "ctx", "left").join(forms, ["form", "ctx"], "left")
    no = materialize(no.select("form", "ctx", (F.coalesce("words", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("no")), "no")
    occ = materialize(occ.join(hint(useful), ["form", "ctx"], "left_semi"), "graph")
    edges = materialize(occ.groupBy("form", "ctx", "inst", "kind").agg(F.count("*").alias("n")), "edges")
    seeds = edges.where("kind >= 0").select("inst", F.col("kind").alias("as")).distinct().withColumn("score", F.lit(1.0))
    trusted = materialize(seeds, "seeds")
    held, distrusted, turn = trusted.count(), None, 0
    while True:
        good = edges.join(trusted, "inst").where("kind < 0 or kind = `as`").groupBy("form", "ctx", "as")
        good = good.agg(F.sum(F.col("n") * F.col("score")).alias("good"), F.count_distinct("inst").alias("distinct"))
        known = trusted.select("inst").distinct()
        decided = edges.join(known, "inst", "left_semi").groupBy("form", "ctx").agg(F.sum("n").alias("decided"))
        judged = good.where(F.col("distinct") >= support).join(decided, ["form", "ctx"]).join(no, ["form", "ctx"])
        met = F.col("decided") + F.col("no")
        if distrusted is not None:
            bad = edges.where("kind < 0").join(known, "inst", "left_anti").join(distrusted, "inst")
            judged = judged.join(bad.groupBy("form", "ctx", "as").agg(F.sum("n").alias("bad")), ["form", "ctx", "as"], "left")
            met = met + F.coalesce("bad", F.lit(0))
        judged = materialize(judged.select("form", "ctx", "as", (F.col("good") / met).alias("conf")), f"patterns{turn}")
        doubt = F.log(1 - F.least(F.col("conf"), F.lit(0.999)))
        scores = edges.where("kind < 0").join(judged, ["form", "ctx"]).groupBy("inst", "as")
        scores = scores.agg((1 - F.exp(F.sum(F.when(F.col("conf") >= trust, doubt).otherwise(0.0)))).alias("score"), (1 - F.exp(F.sum(doubt))).alias("most"))
        scores = materialize(scores, f"scores{turn}")
        vouched = scores.where(F.col("score") >= trust).select("inst", "as", "score")
        distrusted = scores.where(F.col("most") <= 1 - trust).select("inst", "as")
        # what is trusted stays so: the number can only grow, and the rounds end
        trusted = materialize(trusted.unionByName(vouched).groupBy("inst", "as").agg(F.max("score").alias("score")), f"trusted{turn}")
        now, turn = trusted.count(), turn + 1
        if now == held:
            break
        held = now
    found = occ.where("kind < 0").join(judged.where(F.col("conf") >= trust), ["form", "ctx"]).join(trusted, ["inst", "as"])
    best = found.groupBy("key", "start", "end").agg(F.max_by("as", F.struct("conf", -F.col("as"))).alias("kind"))
    return best.select("key", "start", F.col("kind").cast("int").alias("kind"), "end")


def annotate(docs: DataFrame) -> DataFrame:
    """doc_id, key, base and spans (both array<struct<start, kind, end>>, by start and kind) for each row of docs."""
    scanned = materialize(scan(docs), "scan")
    with scratch(docs.sparkSession):
        found = discover(docs, scanned)
        if found is not None:
            more = found.groupBy("key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
            more = materialize(more, "discovered", keep=True)
    out = scanned.select("doc_id", "key", F.array_sort("base").alias("base"), "seeds")
    all_ = ["base", "seeds"]
    if found is not None:
        out = out.join(F.broadcast(more) if few(more) else more, "key", "left")
        all_.append(F.coalesce("more", F.array().cast(_SPANS)))
    return out.select("doc_id", "key", "base", F.array_sort(F.concat(*all_)).alias("spans"))


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in square brackets; spans that overlap are replaced as one."""
    marks = materialize(annotate(docs).where(F.size("spans") > 0).select("key", "spans").dropDuplicates(["key"]), "marks")
    text = F.col("row.text")
    rows = packed(docs).withColumn("key", row_key(F.col("row.doc_id").cast("long"), as_text(text)))
    maybe = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in NAMES])
    piece = lambda a, b: F.substring(text, a + 1, b - a)

    def step(s: Column, x: Column) -> Column:
        apart = x.start >= s.at
        return F.struct(
            F.when(apart, F.concat(s.out, piece(s.at, x.start), F.element_at(names, x.kind + 1))).otherwise(s.out).alias("out"),
            F.greatest(s.at, x.end).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate("spans", start, step, lambda s: F.concat(s.out, piece(s.at, F.length(text))))
    hit = rows.where(maybe).join(F.broadcast(marks) if few(marks, 200_000) else marks, "key", "left")
    masked = F.when(F.col("spans").isNull(), text).otherwise(masked)
    plain = rows.where(~maybe).select(*unpacked(docs.columns))
    return plain.unionByName(hit.select(*unpacked(docs.columns, text=masked)))
