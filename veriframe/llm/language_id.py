"""Language ID by interpolated Kneser-Ney character models, one a language, in sorted hash arrays.

Texts become lower-case letters with single spaces for everything else. Every language has an order-4 model; lower orders
count distinct left neighbours, and discounts come from the counts of counts. The models of all languages are laid out
together: one sorted array of hashes an order, with a column of log-probabilities for each language, so a position of a
text costs one binary search for all languages; only grams that no language has seen go on to shorter ones.

A text gets the language of the lowest cross-entropy per character. Rejection is calibrated on documents that were not
counted: the winner's cross-entropy, standardised by a mean and by a variance that shrinks with length, must not exceed
the level that a share of `false_reject` of the language's own documents exceeds. That share is far smaller than one in
the number of those documents, so the level is carried on from their upper tenth as an exponential tail, whose mean excess
is raised by one standard error: the fewer documents, the further out the level. A language with fewer than LEAST_CHECKS of
them is cross-validated on all its documents, in pieces if there are few.

The models are fitted on a bounded sample: of each of the `max_langs` most frequent languages about `docs_per_lang`
documents, chosen by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_CHARS, blocks, fold, has_columns, in_arrow

ORDER = 4
UNDETERMINED = "und"
#: A text's first letter follows this; it is counted as context, never predicted.
EDGE = 1
SPACE = 32
FOLDS = 5
DOCS_PER_LANG, MAX_LANGS = 1500, 200
FALSE_REJECT = 1e-6
#: A tail has so many documents at least, and a mean excess of half a standard deviation, about that of a normal one.
LEAST_TAIL, LEAST_EXCESS = 5, 0.5
LEAST_CHECKS = 20


@cache
def _letters() -> np.ndarray:
    """Code point of the BMP to lower-case letter or space."""
    low = np.full(1 << 16, SPACE, np.uint64)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            x = ch.lower()
            low[c] = ord(x) if len(x) == 1 else c
    return low


def _folded(points: np.ndarray) -> np.ndarray:
    """Symbols of 16 bits of code points. Letters above the BMP share its 8,448 places of surrogates and private use."""
    out = _letters()[np.minimum(points, 0xFFFF)]
    astral = np.flatnonzero(points > 0xFFFF)
    if len(astral):
        chars, inverse = np.unique(points[astral], return_inverse=True)
        lower = [(ch, ch.lower()) for ch in map(chr, chars.tolist())]
        places = [0xD800 + ord(x[0]) * 40_503 % 0x2100 if ch.isalpha() else SPACE for ch, x in lower]
        out[astral] = np.array(places, np.uint64)[inverse]
    return out


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols in one array, each text after ORDER - 1 edges and ended by a space; and the texts' starts, one more than texts."""
    gap = "\x00" * (ORDER - 1)
    joined = gap + (" " + gap).join(t or "" for t in texts) + " "
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts)) + ORDER
    starts = np.concatenate([[0], np.cumsum(lengths)])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _folded(points)
    edge = np.zeros(len(out), bool)
    for k in range(ORDER - 1):
        edge[starts[:-1] + k] = True
    out[edge] = EDGE
    space = out == SPACE
    keep = np.ones(len(out), bool)
    keep[1:] = ~(space[1:] & (space[:-1] | edge[:-1]))
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def grams(symbols: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The 64-bit code of the `order` symbols that end at each position from order - 1 on, 16 bits each."""
    code = symbols[: len(symbols) - order + 1].copy()
    for k in range(1, order):
        code <<= np.uint64(16)
        code |= symbols[k : len(symbols) - order + 1 + k]
    return code


def hashed(codes: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit codes."""
    x = codes ^ (codes >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


@dataclass
class Models:
    """hashes[k], logp[k]: grams of k + 1 symbols and, a row a language, their log-probabilities; ctx, backoff: contexts of
    k symbols and their log interpolation weights."""

    langs: list[str]
    hashes: list[np.ndarray]
    logp: list[np.ndarray]
    ctx: list[np.ndarray]
    backoff: list[np.ndarray]
    unseen: float
    mean: np.ndarray
    spread: np.ndarray
    limit: np.ndarray

    def log_probs(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """(languages, positions) natural log-probabilities of the last symbol of each code given those before."""
        if order == 0:
            return np.full((len(self.langs), len(codes)), self.unseen, np.float32)
        at, seen = _find(self.hashes[order - 1], hashed(codes))
        out = self.logp[order - 1][:, at] if len(self.hashes[order - 1]) else np.zeros((len(self.langs), len(codes)), np.float32)
        if not seen.all():
            miss = np.flatnonzero(~seen)
            rest = codes[miss]
            lower = self.log_probs(rest & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
            c_at, c_seen = _find(self.ctx[order - 1], hashed(rest >> np.uint64(16)))
            if len(self.ctx[order - 1]):
                lower = lower + np.where(c_seen, self.backoff[order - 1][:, c_at], np.float32(0))
            out[:, miss] = lower
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean negative log-probabilities, and the numbers of symbols they are over (0: no letter)."""
        total = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts), np.int64)
        for i, j in blocks(texts):
            symbols, starts = normalise(texts[i:j])
            codes = grams(symbols)
            first, last = starts[:-1], starts[1:] - (ORDER - 1)  # codes of a text's own symbols
            # a trailing gram of a text that reaches into the next one's edges ends at an edge: it is not the text's own
            n = last - first
            for at in range(0, len(codes), BLOCK_CHARS):  # a text of any length takes the memory of one such part
                logs = self.log_probs(codes[at : at + BLOCK_CHARS])
                lo, hi = (np.clip(x - at, 0, logs.shape[1]) for x in (first, last))
                for k in range(len(self.langs)):
                    sums = np.concatenate([[0.0], np.cumsum(logs[k], dtype=np.float64)])
                    total[i:j, k] -= sums[hi] - sums[lo]
            count[i:j] = n
        return total / np.maximum(count, 1)[:, None], count

    def standardised(self, entropy: np.ndarray, count: np.ndarray, best: np.ndarray) -> np.ndarray:
        a, b = self.spread[best].T
        return (entropy - self.mean[best]) / np.sqrt(a + b / np.maximum(count, 1))


def _kneser_ney(codes: np.ndarray, counts: np.ndarray) -> list[dict]:
    """Per order from 1 to ORDER: grams' codes, numerators' counts, by context the totals and interpolation weights."""
    out = []
    for order in range(ORDER, 0, -1):
        ctx = codes >> np.uint64(16)
        keys, inverse = np.unique(ctx, return_inverse=True)
        total = np.bincount(inverse, counts, len(keys))
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        types = np.bincount(inverse, minlength=len(keys))
        out.append({"codes": codes, "p": np.maximum(counts - d, 0) / total[inverse], "ctx": keys, "weight": d * types / total})
        suffix = codes & np.uint64((1 << 16 * (order - 1)) - 1)
        codes, counts = np.unique(suffix, return_counts=True)  # number of distinct left neighbours
        counts = counts.astype(np.float64)
    return out[::-1]


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]], unseen: float | None = None) -> Models:
    """Models of {language: (distinct codes of ORDER symbols, their counts)}; calibration is left open. `unseen` is the
    log-probability below all orders, by default that of the alphabet of these languages."""
    langs = sorted(counts)
    parts = {x: _kneser_ney(*counts[x]) for x in langs}
    alphabet = {int(c) for x in langs for c in parts[x][0]["codes"]}
    unseen = float(-np.log(len(alphabet) + 1)) if unseen is None else unseen
    m = Models(langs, [], [], [], [], unseen, np.zeros(len(langs)), np.ones((len(langs), 2)), np.full(len(langs), np.inf))
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([parts[x][order - 1]["codes"] for x in langs]))
        contexts = np.unique(np.concatenate([parts[x][order - 1]["ctx"] for x in langs]))
        lower = np.exp(m.log_probs(union & np.uint64((1 << 16 * (order - 1)) - 1), order - 1).astype(np.float64))
        logp = np.empty((len(langs), len(union)), np.float32)
        back = np.zeros((len(langs), len(contexts)), np.float32)
        for k, x in enumerate(langs):
            part = parts[x][order - 1]
            own = np.zeros(len(union))
            own[np.searchsorted(union, part["codes"])] = part["p"]
            weight = np.ones(len(contexts))
            weight[np.searchsorted(contexts, part["ctx"])] = part["weight"]
            back[k] = np.log(weight)
            logp[k] = np.log(own + weight[np.searchsorted(contexts, union >> np.uint64(16))] * lower[k])
        by = np.argsort(hashed(union))
        by_ctx = np.argsort(hashed(contexts))
        m.hashes.append(hashed(union)[by])
        m.logp.append(np.ascontiguousarray(logp[:, by]))
        m.ctx.append(hashed(contexts)[by_ctx])
        m.backoff.append(np.ascontiguousarray(back[:, by_ctx]))
    return m


def count_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i, j in blocks(texts):
        symbols, starts = normalise(texts[i:j])
        c = grams(symbols)
        own = np.zeros(len(c) + 1, np.int64)
        first, last = starts[:-1], np.minimum(starts[1:] - (ORDER - 1), len(c))
        np.add.at(own, first, 1)
        np.add.at(own, last, -1)
        new, n = np.unique(c[np.cumsum(own[:-1]) > 0], return_counts=True)
        both = np.concatenate([codes, new])
        codes, inverse = np.unique(both, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, n]), len(codes)).astype(np.int64)
    return codes, counts


def cross_validate(texts: list[str], unseen: float) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropies and numbers of symbols of one language's texts, each by a model of the other folds."""
    texts = sorted(t for t in texts if t)
    parts = -(-LEAST_CHECKS // max(len(texts), 1))
    pieces = [t[len(t) * k // parts : len(t) * (k + 1) // parts] for t in texts for k in range(parts)]
    h, n = [np.zeros(0)], [np.zeros(0, np.int64)]
    for f in range(FOLDS):
        codes, counts = count_grams([t for i, t in enumerate(pieces) if i % FOLDS != f])
        if len(codes) and pieces[f::FOLDS]:
            entropy, count = build({"": (codes, counts.astype(np.float64))}, unseen).entropies(pieces[f::FOLDS])
            h.append(entropy[:, 0])
            n.append(count)
    h, n = np.concatenate(h), np.concatenate(n)
    return h[n > 0], n[n > 0]


def tail_level(z: np.ndarray, share: float) -> float:
    """The level that a share of values exceeds, by the exponential tail above the upper tenth of z."""
    down = np.sort(z)[::-1]
    tail = min(max(LEAST_TAIL, len(z) // 10), len(z) - 1)
    above = down[tail]
    excess = max(float((down[:tail] - above).mean()) * (1 + tail**-0.5) if tail else 0.0, LEAST_EXCESS)
    return float(above + excess * np.log(max(tail, 1) / len(z) / share))


def _set_limit(m: Models, k: int, h: np.ndarray, n: np.ndarray, false_reject: float) -> None:
    m.mean[k] = mean = float(np.median(h))
    square = (h - mean) ** 2
    long = n >= np.median(n)
    a = max(float(square[long].mean()), 1e-4)
    b = max(float(((square[~long] - a) * n[~long]).mean()) if (~long).any() else 0.0, 0.1)
    m.spread[k] = a, b
    m.limit[k] = tail_level((h - mean) / np.sqrt(a + b / n), false_reject)


def calibrate(m: Models, lang: np.ndarray, entropy: np.ndarray, count: np.ndarray, false_reject: float = FALSE_REJECT) -> list[str]:
    """Mean, variance a + b / symbols and limit of each language from texts that were not counted; returns the languages
    with too few of them, whose limits are left open."""
    few = []
    for k, x in enumerate(m.langs):
        own = (lang == x) & (count > 0)
        if own.sum() < LEAST_CHECKS:
            few.append(x)
        else:
            _set_limit(m, k, entropy[own, k], count[own], false_reject)
    return few


def fit(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = DOCS_PER_LANG,
    false_reject: float = FALSE_REJECT,
    max_langs: int = MAX_LANGS,
) -> Models:
    """Fit on rows where `learn` holds and lang is not null, about docs_per_lang a language, of the max_langs languages with
    the most documents: models are held whole by every worker, so a lang column with stray values may not add to them.

    Counting is distributed; what reaches the driver is distinct grams with counts of that bounded sample, and three
    numbers for each of its calibration documents (every fifth by hash), or of the pieces of a rare language. Raises ValueError without any such row.
    """
    has_columns(docs, (id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn.alias("learn"))
    rows = rows.filter(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    sizes = {r["lang"]: r["count"] for r in counts.collect()}
    if not sizes:
        raise ValueError("no labelled text to learn from")
    rate = F.lit(None).cast("double")
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_lang / n))).otherwise(rate)
    draw = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    picked = rows.filter(draw < rate).withColumn("check", F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(5)) == 0).select("text", "lang", "check")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[str]] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            codes, n = count_grams(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"]
            )

    counted = picked.filter(~F.col("check")).select("text", "lang").transform(in_arrow(count, "lang string, code long, n long"))
    total = counted.groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    m = build({
        x: (g["code"].to_numpy(np.int64).view(np.uint64)[o], g["n"].to_numpy(np.float64)[o])
        for x, g in total.groupby("lang")
        for o in [np.argsort(g["code"].to_numpy(np.int64).view(np.uint64))]
    })
    send = docs.sparkSession.sparkContext.broadcast(m)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = send.value.entropies(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(h), pa.list_(pa.float64())), pa.array(n)], names=["lang", "h", "n"])

    checks = picked.filter("check").select("text", "lang").transform(in_arrow(measure, "lang string, h array<double>, n long")).toPandas()
    few = calibrate(
        m, checks["lang"].to_numpy(object), np.stack(checks["h"].to_list()), checks["n"].to_numpy(np.int64), false_reject
    ) if len(checks) else m.langs
    if few:
        unseen = m.unseen

        def validate(group: pd.DataFrame) -> pd.DataFrame:
            h, n = cross_validate(group["text"].to_list(), unseen)
            return pd.DataFrame({"lang": group["lang"].iloc[:1], "h": [h.tolist()], "n": [n.tolist()]})

        found = picked.filter(F.col("lang").isin(few)).select("text", "lang").groupBy("lang").applyInPandas(validate, "lang string, h array<double>, n array<long>").collect()
        for r in found:
            if r["h"]:
                _set_limit(m, m.langs.index(r["lang"]), np.array(r["h"]), np.array(r["n"]), false_reject)
    open_ = ~np.isfinite(m.limit)
    if open_.any():  # a language of a few letters: as far out as the others' texts may be
        told = ~open_
        m.mean[open_], m.limit[open_] = (m.mean[told].max(), m.limit[told].max()) if told.any() else (0.0, LEAST_EXCESS * -np.log(false_reject))
        m.spread[open_] = m.spread[told].max(axis=0) if told.any() else 1.0
    return m


def _predictor(send) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Models = send.value
        names = np.array(m.langs, object)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            h, n = m.entropies(texts)
            some = np.fromiter((bool(t) and any(map(str.isalpha, t)) for t in texts), bool, len(texts))
            best = h.argmin(axis=1)
            win = h[np.arange(len(h)), best]
            weight = np.exp(-np.minimum(n, 40)[:, None] * (h - win[:, None]))
            score = np.where(some, 1 / weight.sum(axis=1), 0.0)
            reject = ~some | (m.standardised(win, n, best) > m.limit[best])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1], pa.array(np.where(some, names[best], UNDETERMINED), pa.string()), pa.array(score),
                    pa.array(np.where(some, win, np.nan), from_pandas=True), pa.array(reject)
                ],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return run


def predict(docs: DataFrame, m: Models, id_col: str = "doc_id", text_col: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of docs: <id_col>, the extra columns, lang_pred, score, cross_entropy, rejected.

    A null text and one without a letter are `und`, of score 0 and rejected; others get a learned language whether
    rejected or not. Ties go to the language first in order. Nothing but the text is an input of a prediction.
    """
    has_columns(docs, (id_col, text_col))
    send = docs.sparkSession.sparkContext.broadcast(m)  # bounded by the sample the models were fitted on
    src = docs.select(F.col(id_col), *extra, F.col(text_col).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.transform(in_arrow(_predictor(send), f"{kept}, lang_pred string, score double, cross_entropy double, rejected boolean"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """Fit on the rows outside the held-out fold (crc32 of the id, modulo 5, is 0) and predict every row.

    Without any labelled row to learn from, every text is `und`.
    """
    held_out = (fold(F.col(id_col), FOLDS) == 0).alias("held_out")
    try:
        m = fit(docs, fold(F.col(id_col), FOLDS) != 0, id_col, text_col, lang_col, **fitting)
    except ValueError:
        none = [
            F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"),
            F.lit(True).alias("rejected")
        ]
        return docs.select(id_col, held_out, *none)
    return predict(docs, m, id_col, text_col, (held_out,))


def keep_identified(docs: DataFrame, m: Models | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is told: rejected ones go. Without models only texts without a letter do."""
    has_columns(docs, (text_col,))
    if m is None:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    send = docs.sparkSession.sparkContext.broadcast(m)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Models = send.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            h, n = m.entropies(texts)
            best = h.argmin(axis=1)
            z = m.standardised(h[np.arange(len(h)), best], n, best)
            yield batch.filter(pa.array((n > 0) & (z <= m.limit[best])))

    return docs.transform(in_arrow(run, docs.schema))
