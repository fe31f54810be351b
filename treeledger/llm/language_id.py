"""Language identification by Bayesian evidence fusion.

log P(language | page) = log-likelihood of the visible text + log P(declared markup language | language)
                       + log P(address suffix | language) + log prior of the host.

* Text: a multinomial over hashed byte trigrams, one for each language, counted over all labelled documents by grouped
  aggregation. The trigrams of a text are not independent; its log-likelihood is that of ``TEXT_TRIGRAMS`` at most.
* Declaration and suffix: counted over all pages with the text's own posterior as soft label, smoothed.
* Host: a Dirichlet hierarchy. The corpus is the prior of a domain, the domain that of a host, both with weight
  ``KAPPA``; a page's own soft label is left out of its host's and domain's counts.

Counts are grouped sums with partial aggregation, so a host with a third of all pages costs no more than any other; what
the driver holds is bounded by languages x buckets.

Cases: a null or empty html has no text evidence, a null or odd address no suffix and the host ''. Without labelled
documents the language is null and the probability 0. Ties go to the first language by name. Repeated rows are judged
each (each other's soft labels count). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import as_text, few, materialize

BUCKETS = 1 << 15
TEXT_TRIGRAMS = 60
KAPPA = 5.0
SMOOTH = 0.5
_OPENS = re.compile(r"<(?:(?i:(script|style|noscript|template)\b)|!--)")
_CLOSES = {n: re.compile(rf"(?is)</{n}\s*>") for n in ("script", "style", "noscript", "template")}
_TAG = re.compile(r"<[^>]*>")
_ROOT = re.compile(r"(?i)<html\b")
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([A-Za-z]{2,3})""")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)")


def visible(page: str) -> str:
    """The text without comments, scripts and the like, and tags, in time linear in the page: what closes an element is
    looked for once, and what is left open is left alone."""
    closes: dict[str, list[tuple[int, int]]] = {}
    parts, at = [], 0
    comments = True
    for m in _OPENS.finditer(page):
        if m.start() < at:
            continue
        if m[1] is None:
            end = page.find("-->", m.end()) if comments else -1
            comments = end >= 0
            end = end + 3 if comments else None
        else:
            name = m[1].lower()
            if name not in closes:
                closes[name] = [x.span() for x in _CLOSES[name].finditer(page)]
            k = bisect_left(closes[name], (m.end(), 0))
            end = closes[name][k][1] if k < len(closes[name]) else None
        if end is not None:
            parts += [page[at : m.start()], " "]
            at = end
    text = "".join(parts) + page[at:]
    last = text.rfind(">") + 1
    return html.unescape(_TAG.sub(" ", text[:last]) + text[last:])


def declared(page: str) -> str:
    """The language that the first root element with one declares, or ''. A root that is never closed ends with the page."""
    at = 0
    while m := _ROOT.search(page, at):
        end = page.find(">", m.end())
        end = len(page) if end < 0 else end
        if found := _LANG.search(page, m.end(), end):
            return found[1].lower()
        at = end
    return ""


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams of the lower-case words, single spaces between."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return (((b[:-2] * 961 + b[1:-1] * 31 + b[2:]) * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def address(url: str | None) -> tuple[str, str, str]:
    """host, domain (last two labels), suffix (last label)."""
    m = _HOST.match(url or "")
    host = m[1].lower().strip(".") if m else ""
    parts = host.split(".")
    return host, ".".join(parts[-2:]), parts[-1] if len(parts) > 1 else ""


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name and their log-probabilities by bucket, from all documents that name a language."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for p in batches:
            for lang, text in zip(p["lang"], p["text"], strict=True):
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                t = trigrams(text)
                held[lang] += np.bincount(t, minlength=BUCKETS) if len(t) > BUCKETS // 8 else 0
                if len(t) <= BUCKETS // 8:
                    np.add.at(held[lang], t, 1)
        for lang, c in held.items():
            at = np.nonzero(c)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInPandas(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((len(langs), BUCKETS), SMOOTH)
    if langs:
        table[np.searchsorted(langs, counts["lang"].to_numpy(str)), counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def text_evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, loglik and soft (posterior of the text alone), arrays over langs."""
    held = pages.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = held.value
        for p in batches:
            out = []
            for i, url, page in zip(p["page_id"], p["url"], p["html"], strict=True):
                t = trigrams(visible(page))
                ll = table[:, t].sum(1, dtype=float) * min(1.0, TEXT_TRIGRAMS / max(1, len(t))) if len(t) else np.zeros(len(table))
                soft = np.exp(ll - ll.max())
                out.append((i, *address(url), declared(page), ll, soft / soft.sum()))
            yield pd.DataFrame(out, columns=["page_id", "host", "domain", "suffix", "declared", "loglik", "soft"]).astype({"page_id": "Int64"})

    schema = "page_id long, host string, domain string, suffix string, declared string, loglik array<double>, soft array<double>"
    return pages.select(F.col("page_id").cast("long"), "url", as_text(F.col("html")).alias("html")).mapInPandas(run, schema)


def _sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key and the summed soft labels."""
    sums = [F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(n)]
    return rows.groupBy(key).agg(*sums).select(key, F.array(*[F.col(f"s{i}") for i in range(n)]).alias(f"{key}_n"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang for each row of pages."""
    langs, table = fit(docs)
    n = len(langs)
    if not n:
        return pages.select(F.col("page_id").cast("long"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"), F.lit(None).cast("string").alias("text_lang"))
    rows = materialize(text_evidence(pages, langs, table), "evidence")
    total = rows.agg(*[F.sum(F.col("soft")[i]).alias(f"s{i}") for i in range(n)]).select(F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(n)]).alias("all_n"))
    out = rows.crossJoin(F.broadcast(total))  # one row
    for key in ("declared", "suffix", "domain", "host"):
        sums = materialize(_sums(rows, key, n), key)
        out = out.join(F.broadcast(sums) if few(sums, 100_000) else sums, key)
    at = lambda c, i: F.col(c)[i]
    sum_ = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    everything = sum_("all_n")
    score = []
    for i in range(n):
        own = at("soft", i)
        top = (at("all_n", i) + 1) / (everything + n)
        # the marginal share of a declaration or suffix is the same for all languages and left out
        likely = F.lit(0.0)
        for key in ("declared", "suffix"):
            likely = likely + F.log((at(f"{key}_n", i) - own + KAPPA * top) / (sum_(f"{key}_n") - 1 + KAPPA) / top)
        domain = (at("domain_n", i) - own + KAPPA * top) / (sum_("domain_n") - 1 + KAPPA)
        host = (at("host_n", i) - own + KAPPA * domain) / (sum_("host_n") - 1 + KAPPA)
        score.append(at("loglik", i) + likely + F.log(F.greatest(host, F.lit(1e-12))))
    out = out.select("page_id", "loglik", F.array(*score).alias("score"))
    name = F.array(*map(F.lit, langs))
    best = lambda c: F.element_at(name, F.array_position(c, F.array_max(c)).cast("int"))
    mass = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))
    return out.select("page_id", best("score").alias("lang"), (1 / mass).alias("probability"), best("loglik").alias("text_lang"))
