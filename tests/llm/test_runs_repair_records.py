"""Periodic runs, conversation repair and token records against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from treeledger.llm import chat_repair, periodic_runs, token_records

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i - s + q), q)
    return sorted((s, size, q) for (s, size), q in found.items())


def repeated(rng, n):
    words = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 8 else 0):
        s, p = rng.randrange(n), rng.randrange(1, max(2, n // 5))
        for i in range(s + p, min(n, s + p * rng.randrange(2, 9))):
            words[i] = words[i - p]
    return words


def test_runs_are_those_of_a_plain_search():
    rng = random.Random(3)
    for n in [0, 1, 5, 6, 7, 12, *[rng.randrange(8, 250) for _ in range(250)]]:
        words = repeated(rng, n)
        for grid in (periodic_runs.GRID, 7):
            assert periodic_runs.runs(np.array(words, np.int64), grid) == plain_runs(words)


def test_common_prefixes():
    rng = np.random.default_rng(1)
    for words in (rng.integers(0, 2, 400), np.zeros(300, np.int64), np.arange(500) % 37, np.arange(40)):
        n = len(words)
        i, j = np.triu_indices(n, 1)
        got = periodic_runs.Extensions(words).of(i, j)
        at = rng.choice(len(i), 400)
        for a, b, x in zip(i[at], j[at], got[at], strict=True):
            plain = next((k for k in range(n - b) if words[a + k] != words[b + k]), n - b)
            assert x == plain


def test_documents_of_runs(spark):
    texts = ["a b " * 40, None, "", "x", "one two three " * 5 + "end", "la " * 6, "la " * 5, " ".join(map(str, range(300))), "w " * 30000]
    rows = [(i * 7, t, "left", 1) for i, t in enumerate(texts)] + [(None, "b a b a b a b a", "", 1), (0, texts[0], "", 1), (10**12 + 7, "y\n" * 9, "", 1)]
    got = periodic_runs.detect(spark.createDataFrame(rows, "doc_id long, text string, n_runs string, words long")).collect()
    want = []
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain_runs(words) if n < 1000 else [(0, n, 1)]
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in found)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(found), *four, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(kept))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.detect(empty).collect() == []


def plain_repair(rows):
    """All edits of a few rows; rows: (role, must go, truncated)."""
    best = None
    n = len(rows)
    for size in range(n, 2 * n + 3):
        for where in itertools.combinations(range(size), n):
            for edits in itertools.product("DKR", repeat=n):
                it, audit, cost, said, fits = iter(zip(rows, edits, strict=True)), "", 0, "", True
                for k in range(size):
                    expected = {"": "u", "s": "u", "u": "a", "a": "u"}.get(said[-1:], "?")
                    if k not in where:
                        audit, cost, said = audit + "I", cost + 3, said + expected
                        continue
                    (role, gone, cut), e = next(it)
                    audit += e
                    if e == "D":
                        cost += 4
                        continue
                    fits &= not gone
                    cost += (3 if cut else 0) + (3 if e == "R" else 0)
                    said += expected if e == "R" else role[:1]
                if fits and re.fullmatch(r"(s?(ua)+)?", said) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from("suaxSUAX-"), max_size=4))
def test_cheapest_edits(shape):
    rows = [("x" if c == "-" else c.lower().replace("x", "tool"), c == "-", c.isupper()) for c in shape]
    want = plain_repair(rows)
    assert chat_repair.Solver()("".join(shape)) == want
    for cut in range(len(shape) + 1):  # blocks of any lengths lead to the same
        chain = chat_repair.Chain()
        chain.add(chat_repair.block_table("".join(shape[:cut])))
        chain.add(chat_repair.block_table("".join(shape[cut:])))
        assert chain.goal() == want


def plain_conversation(rows):
    """rows: (turn, role, text) of one conversation. The cheapest edits by a table over rows and states."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    counts, shape, seen = [0, 0, 0], "", set()
    for _, _, role, text in rows:
        solid = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else 3
        seen.add((role, text))
        if fault < 3:
            counts[fault] += 1
        letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
        shape += "-" if fault < 2 else letter.upper() if fault == 2 else letter
    turns = [t for given_, t, _, _ in rows if given_]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    best = {0: (0, "")}
    grammar = chat_repair.GRAMMAR

    def closed(at):
        for _ in range(2):
            for s in list(at):
                for name, to in grammar[s].items():
                    if name in "ua" and (to not in at or (at[s][0] + 3, at[s][1] + "I") < at[to]):
                        at[to] = (at[s][0] + 3, at[s][1] + "I")
        return at

    for c in shape:
        to = {}
        for s, (cost, audit) in closed(best).items():
            options = [(s, cost + 4, "D")]
            if c != "-":
                more = cost + (3 if c.isupper() else 0)
                options += [(t, more, "K") for name, t in grammar[s].items() if name == c.lower()]
                options += [(t, more + 3, "R") for name, t in grammar[s].items() if name in "ua"]
            for t, x, e in options:
                if t not in to or (x, audit + e) < to[t]:
                    to[t] = (x, audit + e)
        best = to
    cost, audit = min(v for s, v in closed(best).items() if s in (0, 3))
    out, state, it = [], 0, iter(rows)
    for e in audit:
        role, text = ("", "") if e == "I" else next(it)[2:]
        if e == "D":
            continue
        name = role[:1] if e == "K" else "a" if state == 2 else "u"
        state = grammar[state][name]
        out.append(f"{role if e == 'K' else {'u': 'user', 'a': 'assistant'}[name]}:{text}")
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_conversations(spark):
    rng = random.Random(5)
    say = lambda: rng.choice(["Yes.", "no", "", " \n", "Why?", "Is it?\n", None, f"number {rng.randrange(50)}."])
    rows = []
    for conv in [None, -3, *range(40)]:
        for _ in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "tool", "", None]), say()))
    rows += [(500, t, rng.choice(["user", "assistant"]), f"turn {t // 2}{rng.choice(['.', ''])}") for t in range(9000)]  # more than a task holds
    rows += [(501, 3, "user", "The same.")] * 40
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, late long").repartition(7)
    for df in (frame, frame.withColumn("gone", frame.conv_id.eqNullSafe(-3))):
        got = {r[0]: tuple(r)[1:] for r in chat_repair.repair(df).collect()}
        assert set(got) == {r[0] for r in rows}
        for conv in got:
            mine = [r[1:] for r in rows if r[0] == conv]
            if "gone" in df.columns and conv == -3:
                mine = []
            assert got[conv] == plain_conversation(mine), conv
    assert got[-3] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert chat_repair.repair(frame.limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (1, None) for t in (None, *range(30))]
    got = chat_repair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    code = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    want = []
    for c, t, role, text in rows:
        k = code(c, t)
        text = {1: "", 2: "One Two"}.get(k, text)
        want += [(c, t, "user" if k == 4 else role, text, k == 0)] * (2 if k == 3 else 1)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r  　\u0085'.,'s7éßЖ漢"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
@example(["a b c d e", "x  y z  w", " a b c", "a b c ", "a\u00a0 b c d", "a\n b\n c\n d", "a b" + "\u3000" + " c d", "w" * 50 + " " + "v" * 50 + " u t"])
def test_pieces_give_the_ids_of_whole_texts(texts):
    encoder = token_records.Encoder(PATH)
    for t in [texts, texts[::-1], ["a <|endoftext|> b", *texts]]:
        want = [encoder.tok.encode(x, add_special_tokens=False).ids for x in t]
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder.batch(t)] == want
        assert [p for x in t for p in token_records._PIECE.findall(x)] == [] or ["".join(token_records._PIECE.findall(x)) for x in t] == t


def test_cuts_around_every_sign_of_the_basic_plane():
    encoder = token_records.Encoder(PATH)
    signs = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    texts = [f"a{c}.{c}1 {c}\n{c}'s{c} 's,{c}\t{c}\n {c}{c} {c}" for c in signs]
    assert encoder.batch(texts) == encoder._raw(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'.,\"-sStdmrevl7é×÷ßЖ漢　\u2003\u0301٣😀"), st.characters(exclude_categories=["Cs"])), max_size=80), max_size=5))
@example(["it's 'sand ..'s 5's '5 a'", "x\n", "\ny", "", "\n\nz\n\n", "a\tb\r\nc  d \n e"])
def test_cuts_by_kinds_give_the_ids_of_whole_texts(texts):
    encoder = token_records.encoder_of(PATH)
    for t in [texts, [*texts, "x <|endoftext|>y", *texts], [" ".join(texts), "\n".join(texts)]]:
        assert encoder.batch(t) == encoder._raw(t)
        for x in t:
            # every cut of the pattern is one by kinds
            cut = token_records.cuts(np.frombuffer(x.encode(), np.uint8))
            ends = np.cumsum([0, *(len(p.encode()) for p in token_records._PIECE.findall(x))])[:-1]
            assert x == "" or cut[ends].all()


def test_a_piece_is_encoded_once_whatever_stands_around_it():
    """Before, a word with other signs or with a line feed in it was another word: the tokenizer got ten times as much."""
    encoder = token_records.Encoder(PATH)
    seen, raw = [], encoder._raw
    encoder._raw = lambda texts: (seen.extend(texts), raw(texts))[1]
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) + "ation" for i in range(400)]
    texts = [" ".join(f"{w}{end}" for w in words) for end in ("", "***", ";;;;;", ",%%%", ".\nThe", "###", "7", "'s", "/", "-x")]
    assert encoder.batch(texts) == raw(texts)
    assert sum(map(len, seen)) < 2 * len(texts[0])


def test_more_pieces_than_are_remembered(monkeypatch):
    monkeypatch.setattr(token_records, "PIECES", 50)
    monkeypatch.setattr(token_records, "AT_ONCE", 30)
    encoder = token_records.Encoder(PATH)
    rng = random.Random(5)
    for _ in range(8):
        texts = [" ".join(rng.choice(["a", "é" * 30, "xyz", str(rng.random())]) for _ in range(rng.randrange(40))) for _ in range(4)]
        assert encoder.batch(texts) == encoder._raw(texts)
        assert len(encoder.known) <= 50 and len(encoder.ends) == len(encoder.known) + 1
        assert all(len(p) <= token_records.PIECE_BYTES for p in encoder.known)
    sliced = pa.array(["no", "", *texts, "no"]).slice(1, 5)
    assert encoder.encode(sliced) == encoder._raw(sliced.to_pylist())
    assert encoder.batch([]) == [] and encoder.batch(["", ""]) == [b"", b""]


def test_other_tokenizers_encode_whole_texts():
    encoder = token_records.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not encoder.cut
    assert np.frombuffer(encoder.batch(["Hello  World"])[0], "<u2").tolist() == encoder.tok.encode("Hello  World", add_special_tokens=False).ids


def test_frames():
    payload = token_records.serialize("é1", np.array([1, 65535]), 2)
    data = token_records.frame(payload)
    key, ids = token_records.deserialize(token_records.unframe(data))
    assert (key, ids.tolist()) == ("é1", [1, 65535])
    assert token_records.deserialize(token_records.serialize(None, np.array([1 << 20]), 4))[0] is None
    for i in range(len(data)):
        broken = data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :]
        with pytest.raises(ValueError, match="broken"):
            token_records.unframe(broken)


def test_records(spark, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    rows = [(i, rng.choice(["Some text here.", "line\nline two  ", None, "", "word " * rng.randrange(4000)]), "x") for i in rng.sample(range(10**6), 300)]
    rows += [(None, "no id", "x"), (7, "again", "x"), (7, "again", "x"), (7, "other", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    index = token_records.write_records(docs, str(tmp_path), PATH, file_bytes=20_000)
    assert index.select("file").distinct().count() > 4
    index = token_records.with_starts(index)
    back = token_records.read_records(index, str(tmp_path), ids=True).collect()
    ids = {r.start: (r.key, np.frombuffer(r.ids, "<u4").tolist(), r.ids_crc32) for r in back}
    at, order = 0, []
    for start in sorted(ids):
        key, found, crc = ids[start]
        assert start == at and zlib.crc32(np.array(found, "<u4").tobytes()) == crc
        at += len(found)
        order.append(-1 if key is None else int(key))
    assert order == sorted(order)
    want = sorted((-1 if i is None else i, tok.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, _ in rows)
    assert sorted((-1 if k is None else int(k), x) for k, x, _ in ids.values()) == want
    once, twice, other = [[tuple(r) for r in token_records.read_records(token_records.shuffled(index, s), str(tmp_path)).select("key", "start").collect()] for s in (1, 1, 2)]
    assert once == twice != other and sorted(once, key=str) == sorted(other, key=str)
    # what an attempt has left behind and no index names is not read
    (tmp_path / "part-000000-0000-lost.rec").write_bytes(b"half a record")
    assert token_records.read_records(index, str(tmp_path)).count() == len(rows)
    assert token_records.digest(docs.limit(0), PATH, folder=str(tmp_path / "none")).collect() == []
