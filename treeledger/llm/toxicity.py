"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs of a word are two trained vectors: the word's own (null for words that the sample does not know), and the greatest
over those of its pieces of 4 and 5 bytes with word edges, dimension by dimension, so that unseen forms of a known stem
count. Both tables hold what at least ``WORD_TEXTS`` or ``PIECE_TEXTS`` texts of the sample hold. Their first dimension
starts at the smoothed log-odds of standing in toxic against other texts, where these are large and could not be chance;
all else starts at random, and training moves all of it.

A text is read in all its windows of ``WINDOW`` words, each overlapping the next, whatever its length. A window goes
through a gated recurrent layer in either direction; attention pools its states into one logit. The text's logit is its
windows' greatest. Training takes, in each epoch, the greatest window of every text (multiple-instance learning), at first
the one with most evidence. A logistic curve from the text's logit to a probability is fitted on a fifth of the sample
that the network has not seen, and moved to the labels' own rate.

The fit uses a bounded sample: of the labelled rows outside fold 0, texts of at most ``FIT_CHARS`` characters, the
``FIT_DOCS`` of each class that come first by a hash of the id. Scoring covers all rows and whole texts.

Cases: a null text scores as the empty text, which gets a score like any other. A null doc_id counts as the id '' for
its fold. Null labels are left out; of several labels for an id the greatest counts. With one class only, the score is
that class's share (0 without labels). Repeated rows are scored each. An empty table gives no rows. Other columns are
ignored by ``score`` and handed on by ``keep_clean``, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import as_text, map_rows, materialize, only, packed, row_key, unpacked
from treeledger.llm.quality import fit_logistic, labelled_sample

FIT_DOCS = 2000
FIT_CHARS = 8000
WINDOW, STRIDE = 64, 48
HIDDEN, VECTOR = 8, 8
EPOCHS = 10
BATCH = 512
THRESHOLD = 0.5
WORD_TEXTS, PIECE_TEXTS = 2, 3
EDGES = b".,;:!?\"'()[]{}*#$%&|<>"
#: Evidence counts from so many standard deviations (of words, of pieces) and from so large log-odds.
WORD_SURE, PIECE_SURE, LEAST_ODDS = 2.5, 3.0, 1.5
#: Log-odds at which a vector's first dimension starts at 1.
FULL_ODDS = 7.0


def tokens(text: str) -> list[bytes]:
    """Lower-case words without punctuation, in UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, EDGES).split()


def pieces(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ^word$ of 4 and 5 bytes, each as one number, and the number of the word they are from."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    b = np.frombuffer(b"".join(b"^%b$" % w for w in words), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), lengths)
    found, at = [], []
    for n in (4, 5):
        if len(b) < n:
            continue
        key = np.full(len(b) - n + 1, n << 40, np.uint64)
        for k in range(n):
            key += b[k : len(b) - n + 1 + k] << np.uint64(8 * k)
        inside = of[: len(key)] == of[n - 1 :]
        found.append(key[inside])
        at.append(of[: len(key)][inside])
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found, at = np.concatenate(found), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    return found[order], at[order]


def evidence(with_it: np.ndarray, n: np.ndarray, sure: float, both_ways: bool) -> np.ndarray:
    """Log-odds, over FULL_ODDS, from the texts of either class (two columns) with a word or piece; 0 if weak or unsure."""
    p = n[1] / max(1, n.sum())
    each = with_it.sum(1)
    z = (with_it[:, 1] - each * p) / np.sqrt(each * p * (1 - p) + 1)
    odds = np.log((with_it[:, 1] + 0.5) / (n[1] + 1)) - np.log((with_it[:, 0] + 0.5) / (n[0] + 1))
    fit = (np.abs(odds) >= LEAST_ODDS) & ((np.abs(z) if both_ways else z) >= sure)
    return np.where(fit, np.clip(odds / FULL_ODDS, -1, 1), 0.0)


#: Words whose pieces are looked at together.
SOME_WORDS = 10_000


class Vectors:
    """The trained tables: known words and pieces (sorted numbers), and their vectors."""

    def __init__(self, words: list[bytes], texts: list[np.ndarray], y: np.ndarray, seed: int):
        """texts: the numbers of their words."""
        some = range(0, len(words), SOME_WORDS)
        every = [np.unique(pieces(words[i : i + SOME_WORDS])[0]) for i in some]
        all_pieces = np.unique(np.concatenate([*every, np.empty(0, np.uint64)]))
        counts, at = np.zeros(len(words) + 1, np.int64), []
        for i in some:
            key, of = pieces(words[i : i + SOME_WORDS])
            at.append(np.searchsorted(all_pieces, key).astype(np.int32))
            counts[1 + i : 1 + i + SOME_WORDS] = np.bincount(of, minlength=len(words[i : i + SOME_WORDS]))
        at, starts = np.concatenate([*at, np.empty(0, np.int32)]), np.cumsum(counts)
        words_in, pieces_in = np.zeros((len(words), 2), np.int32), np.zeros((len(all_pieces), 2), np.int32)
        for t, c in zip(texts, y.astype(int), strict=True):
            mine = np.unique(t)
            words_in[mine, c] += 1
            if len(mine):
                pieces_in[np.unique(np.concatenate([at[starts[i] : starts[i + 1]] for i in mine])), c] += 1
        n = np.bincount(y.astype(int), minlength=2)
        r = np.random.default_rng(seed)
        kept = words_in.sum(1) >= WORD_TEXTS
        self.words = {words[k]: i + 1 for i, k in enumerate(np.nonzero(kept)[0])}
        self.word_vectors = r.normal(0, 0.03, (len(self.words) + 1, VECTOR)).astype(np.float32)
        self.word_vectors[1:, 0] = evidence(words_in[kept], n, WORD_SURE, True)
        self.word_vectors[0] = 0
        held = pieces_in.sum(1) >= PIECE_TEXTS
        self.pieces = all_pieces[held]
        self.piece_vectors = r.normal(0, 0.03, (len(self.pieces), VECTOR)).astype(np.float32)
        self.piece_vectors[:, 0] = evidence(pieces_in[held], n, PIECE_SURE, False)

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the words' vectors, rows of the vectors of their known pieces, and the word that each piece is from."""
        rows = np.array([self.words.get(w, 0) for w in words], np.int32)
        found, whose = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for i in range(0, len(words) if len(self.pieces) else 0, SOME_WORDS):
            key, of = pieces(words[i : i + SOME_WORDS])
            at = np.minimum(np.searchsorted(self.pieces, key), len(self.pieces) - 1)
            known = self.pieces[at] == key
            found.append(at[known].astype(np.int32))
            whose.append((of[known] + i).astype(np.int32))
        return rows, np.concatenate(found), np.concatenate(whose)

    def inputs(self, found) -> np.ndarray:
        """(words, 2 VECTOR): the word's vector, and the greatest over its pieces."""
        rows, at, of = found
        out = np.zeros((len(rows), 2 * VECTOR), np.float32)
        out[:, :VECTOR] = self.word_vectors[rows]
        first = np.nonzero(np.r_[True, of[1:] != of[:-1]])[0] if len(at) else np.empty(0, np.int64)
        for i in range(0, len(first), SOME_WORDS):
            mine = first[i : i + SOME_WORDS]
            last = first[i + SOME_WORDS] if i + SOME_WORDS < len(first) else len(at)
            out[of[mine], VECTOR:] = np.maximum.reduceat(self.piece_vectors[at[mine[0] : last]], mine - mine[0], axis=0)
        return out


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text's words, (windows, WINDOW), the last one ending with it, and their numbers of words. A
    short text is one padded window."""
    n = len(ids)
    if n <= WINDOW:
        out = np.zeros((1, WINDOW), np.int32)
        out[0, :n] = ids
        return out, np.array([n])
    starts = np.minimum(np.arange(0, n - WINDOW + STRIDE, STRIDE), n - WINDOW)
    return ids[starts[:, None] + np.arange(WINDOW)[None, :]], np.full(len(starts), WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters in float32: wx (2, inputs, 3 hidden), b (2, 3 hidden), u (2, hidden, 3 hidden) for the two directions,
    wa (2 hidden, hidden), va for the attention, wo, bo for the logit."""

    def __init__(self, seed: int = 8):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {
            "wx": r.normal(0, 0.5, (2, 2 * VECTOR, 3 * h)), "b": np.zeros((2, 3 * h)), "u": r.normal(0, 1 / np.sqrt(h), (2, h, 3 * h)),
            "wa": r.normal(0, 0.4, (2 * h, h)), "va": r.normal(0, 0.4, h), "wo": r.normal(0, 0.4, 2 * h), "bo": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def project(self, inputs: np.ndarray) -> np.ndarray:
        """(2, words, 3 hidden): what each word adds to the gates of either direction."""
        out = np.matmul(inputs, self.p["wx"])
        out += self.p["b"][:, None, :]
        return out

    def forward(self, projected: np.ndarray, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows (n, WINDOW) of rows of projected; with keep, also what the gradient needs."""
        p, h, n = self.p, HIDDEN, len(ids)
        mask = (np.arange(WINDOW)[:, None] < lengths[None, :]).astype(np.float32)
        padded = not mask.all()
        both = np.empty((WINDOW, 2 * h, n), np.float32)
        saved: list[list] = [[], []]
        for k in (0, 1):
            u, s, mine = p["u"][k].T.copy(), np.zeros((h, n), np.float32), projected[k]
            for t in range(WINDOW)[:: 1 - 2 * k]:
                xt = mine[ids[:, t]].T
                hu = u @ s
                zr = _sigmoid(xt[: 2 * h] + hu[: 2 * h])
                z, r = zr[:h], zr[h:]
                c = np.tanh(xt[2 * h :] + r * hu[2 * h :])
                new = c + z * (s - c)
                if padded:
                    new *= mask[t]
                if keep:
                    saved[k].append((t, s, z, r, c, hu[2 * h :]))
                s = both[t, k * h : k * h + h] = new
        a = np.tanh(np.matmul(p["wa"].T, both))
        e = np.exp(np.clip((p["va"][:, None] * a).sum(1), -20, 20)) * mask
        alpha = e / (e.sum(0) + 1e-9)
        pooled = (alpha[:, None, :] * both).sum(0)
        logit = p["wo"] @ pooled + p["bo"][0]
        return (logit, (mask, saved, both, a, alpha, pooled)) if keep else logit

    def gradient(self, kept, inputs: np.ndarray, ids: np.ndarray, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """By parameter, and by row of inputs."""
        p, h = self.p, HIDDEN
        mask, saved, both, a, alpha, pooled = kept
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["wo"], g["bo"] = pooled @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = p["wo"][:, None] * d_logit[None, :]
        d_both = alpha[:, None, :] * d_pooled[None]
        d_alpha = (both * d_pooled[None]).sum(1)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0)[None])
        g["va"] = (a * d_e[:, None, :]).sum((0, 2))
        d_a = d_e[:, None, :] * p["va"][None, :, None] * (1 - a * a)
        g["wa"] = np.matmul(both, d_a.transpose(0, 2, 1)).sum(0)
        d_both = d_both + np.matmul(p["wa"], d_a)
        d_inputs = np.zeros((WINDOW, len(ids), inputs.shape[1]), np.float32)
        for k in (0, 1):
            d_s = np.zeros_like(saved[k][0][1])
            for t, s, z, r, c, hn in reversed(saved[k]):
                d = (d_s + d_both[t, k * h : k * h + h]) * mask[t]
                d_c = d * (1 - z) * (1 - c * c)
                d_z = d * (s - c) * z * (1 - z)
                d_r = d_c * hn * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_c])
                d_hu = np.concatenate([d_z, d_r, d_c * r])
                g["u"][k] += s @ d_hu.T
                g["wx"][k] += inputs[ids[:, t]].T @ d_x.T
                g["b"][k] += d_x.sum(1)
                d_inputs[t] += d_x.T @ p["wx"][k].T
                d_s = d * z + p["u"][k] @ d_hu
        order = np.argsort(ids.T.ravel(), kind="stable")
        at = ids.T.ravel()[order]
        first = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0]
        by_row = np.zeros_like(inputs)
        by_row[at[first]] = np.add.reduceat(d_inputs.reshape(len(at), -1)[order], first, axis=0)
        return g, by_row

    def logits(self, projected: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """forward in blocks."""
        out = np.empty(len(ids), np.float32)
        for i in range(0, len(ids), BATCH):
            out[i : i + BATCH] = self.forward(projected, ids[i : i + BATCH], lengths[i : i + BATCH])
        return out


def _greatest(value: np.ndarray, bag: np.ndarray) -> np.ndarray:
    """Positions of each bag's greatest value."""
    order = np.lexsort((-value, bag))
    return order[np.r_[True, bag[order][1:] != bag[order][:-1]]]


class _Adaptive:
    """Steps of a table of vectors, by row, each dimension slowed down by its own past gradients."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.rate, self.past = table, rate, np.full_like(table, 1e-4)

    def step(self, rows: np.ndarray, d: np.ndarray) -> None:
        """Rows may repeat."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.nonzero(np.r_[True, rows[1:] != rows[:-1]])[0]
        rows, d = rows[first], np.add.reduceat(d[order], first, axis=0)
        self.past[rows] += d * d
        self.table[rows] -= self.rate * d / np.sqrt(self.past[rows])


def train(texts: list[str], y: np.ndarray, share: float, seed: int = 8) -> dict:
    """The model, from texts and their classes; every fifth text of a class is kept for the curve."""
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.nonzero(y == c)[0][4::5]] = True
    fitted = np.nonzero(~held)[0]
    number: dict[bytes, int] = {}
    read = [np.array([number.setdefault(w, len(number)) for w in tokens(t)], np.int32) for t in texts]
    words = list(number)
    del number
    vectors = Vectors(words, [read[i] for i in fitted], y[fitted], seed)
    found = vectors.look_up(words)
    rows, piece_at, piece_of = found
    starts = np.searchsorted(piece_of, np.arange(len(words) + 1))
    parts = [windows(t) for t in read]
    bag = np.repeat(np.arange(len(parts)), [len(n) for _, n in parts])
    ids, lengths = np.concatenate([i for i, _ in parts]), np.concatenate([n for _, n in parts])
    del parts, read
    mine = ~held[bag]

    net, r = Network(seed), np.random.default_rng(seed)
    if not words:
        found = rows, piece_at, piece_of = np.zeros(1, np.int32), piece_at, piece_of
        starts = np.zeros(2, np.int64)
    inputs = vectors.inputs(found)
    first = (inputs[:, 0] + inputs[:, VECTOR])[ids].sum(1)
    chosen = _greatest(np.where(mine, first, -np.inf), bag)
    weight = np.where(y == 1, 0.5 / max(1, (y[fitted] == 1).sum()), 0.5 / max(1, (y[fitted] == 0).sum())) * len(fitted)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = _Adaptive(vectors.word_vectors, 0.02), _Adaptive(vectors.piece_vectors, 0.02)
    step, size = 0, int(np.clip(len(fitted) // 20, 16, 128))
    for epoch in range(EPOCHS):
        if epoch >= 2:
            inputs = vectors.inputs(found)
            chosen = _greatest(np.where(mine, net.logits(net.project(inputs), ids, lengths), -np.inf), bag)
        chosen = chosen[mine[chosen]]
        r.shuffle(chosen)
        for i in range(0, len(chosen), size):
            part = chosen[i : i + size]
            used, local = np.unique(ids[part], return_inverse=True)
            local = local.reshape(len(part), WINDOW)
            counts = starts[used + 1] - starts[used]
            own = np.repeat(starts[used] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            sub = rows[used], piece_at[own], np.repeat(np.arange(len(used)), counts)
            x = vectors.inputs(sub)
            logit, kept = net.forward(net.project(x), local, lengths[part], keep=True)
            d = ((_sigmoid(logit) - y[bag[part]]) * weight[bag[part]] / len(part)).astype(np.float32)
            step += 1
            gradient, d_x = net.gradient(kept, x, local, d)
            for k, g in gradient.items():
                g = np.clip(g, -1, 1) + 1e-4 * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                net.p[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            known = sub[0] > 0
            if known.any():
                steps[0].step(sub[0][known], d_x[known, :VECTOR])
            if len(sub[1]):  # the greatest piece of a dimension takes its gradient
                hit = vectors.piece_vectors[sub[1]] == x[sub[2], VECTOR:]
                steps[1].step(sub[1], np.where(hit, d_x[sub[2], VECTOR:], 0))
    logit = net.logits(net.project(vectors.inputs(found)), ids, lengths)
    best = np.empty(len(y))
    chosen = _greatest(logit, bag)
    best[bag[chosen]] = logit[chosen]
    use = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    w = fit_logistic(np.clip(best[use, None], -20, 20), y[use].astype(float), ridge=0.01)
    odds = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    w[-1] += odds(share) - odds(y[use].mean())
    return {"net": net.p, "vectors": vectors, "curve": w}


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    rows, share = labelled_sample(docs, labels, "toxic", FIT_DOCS, FIT_CHARS)
    y, texts = rows.y.to_numpy(int), list(rows.text)
    del rows
    if len(set(y)) < 2:
        return {"constant": share if len(y) else 0.0}
    return train(texts, y, share)


class Scorer:
    """Greatest window logit of texts. Keeps what the words it has met add to the gates, up to a number of words."""

    def __init__(self, model: dict, most: int = 20_000):
        self.net, self.vectors, self.most = Network(), model["vectors"], most
        self.net.p = model["net"]
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.projected = np.zeros((2, 0, 3 * HIDDEN), np.float32)

    def __call__(self, texts) -> np.ndarray:
        read = [tokens(t) for t in texts]
        if len(self.number) > self.most:
            self.clear()
        new = list({w for t in read for w in t}.difference(self.number)) or ([] if self.number else [b""])
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            more = self.net.project(self.vectors.inputs(self.vectors.look_up(new)))
            self.projected = np.concatenate([self.projected, more], axis=1)
        best = np.full(len(read), -np.inf)
        for i in range(0, len(read), 50):
            parts = [windows(np.array(list(map(self.number.__getitem__, t)), np.int32)) for t in read[i : i + 50]]
            bag = np.repeat(np.arange(i, i + len(parts)), [len(n) for _, n in parts])
            ids, lengths = np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts])
            np.maximum.at(best, bag, self.net.logits(self.projected, ids, lengths))
        return best


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score for each row of docs. The model, of bounded size, goes to the tasks as a broadcast variable."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text(F.col("text")).alias("text"))
    return _scored(rows, model, "doc_id long")


def _scored(rows: DataFrame, model: dict, first: str) -> DataFrame:
    """The first column and the score of rows with two columns, the second one the text."""
    if "constant" in model:
        return rows.select(rows.columns[0], F.lit(float(model["constant"])).alias("score"))
    held = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value)
        a, b = held.value["curve"]

        def work(part):
            z = np.clip(np.clip(scorer([t for _, t in part]), -20, 20) * a + b, -30, 30)
            return list(zip([k for k, _ in part], (1 / (1 + np.exp(-z))).tolist(), strict=True))

        return work

    return map_rows(rows, make, f"{first}, score double")


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """docs less the texts that score threshold or more. Rows are told apart by 128 bits of id and text, so rows that share
    an id are judged each by its own text."""
    text = as_text(F.col("row.text").cast("string"))
    keyed = packed(docs).withColumn("key", row_key(F.col("row.doc_id"), text))
    scored = _scored(keyed.select("key", text.alias("text")), model, "key struct<a:long,b:long>")
    toxic = materialize(scored.where(F.col("score") >= threshold).select("key").distinct(), "toxic")
    return only(keyed, toxic, "key", "left_anti").select(*unpacked(docs.columns))
