"""Subject areas of documents by factoring the document-term matrix.

Terms are hashed to a fixed number of columns, so the factors have a fixed size. The term factor has one component per
subject, seeded and anchored by the labelled documents and the subject descriptions, and one per language for what all
documents share; a term stays with the subjects only while most of its mass lies there. Alternating non-negative updates that lower the Kullback-Leibler divergence run over all documents;
the anchored components then are the subject mixture of each document. The share from which a document deals with a
subject is fitted on labelled documents that are held out from seeding.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.leaks import words
from colloquy.session import cores, cut

#: Columns of the matrix; rounds over all documents; updates of a document's mixture in a round and at the end.
COLUMNS, ROUNDS, INNER, LAST = 1 << 18, 4, 5, 12
#: Labelled documents used at most (by hash order); weight of the anchors against what the documents say.
LABELLED, ANCHOR = 50_000, 0.5
#: Log-likelihood ratio and lift, pooled over the languages, from which labels anchor a term (the ratio is chi-square of one
#: degree at 0.001), and the ratio (0.0001) from which they do even a common one; terms in more than this share of a language's documents tell nothing otherwise.
EVIDENCE, LIFT, SURE, COMMON = 10.83, 2.0, 15.14, 0.3
#: Languages with a component of their own, the most frequent; all others share one more.
LANGUAGES = 32
#: Share of a term's mass on subjects below which, after each round, it goes back to what all documents share.
TELLS = 0.5
#: Times as often in a subject's labelled documents as in all of the language, from which a term seeds a subject that has too few anchors there.
WEAK_LIFT = 4.0
#: One labelled document in so many (but none of a subject with fewer than twice as many in its language) is held out from
#: seeding and fits the thresholds; the thresholds where labels tell no better.
HELD_OUT, USUAL = 5, (0.25, 0.02)
_CJK = regex.compile(r"[\p{Han}々]{1,8}|\p{Katakana}[\p{Katakana}ー]+")


_COLS: dict[str, tuple[int, ...]] = {}


def _columns(word: str) -> tuple[int, ...]:
    """Columns of a word: none for numbers and single letters, one per run of ideographs or katakana in scripts without spaces."""
    got = _COLS.get(word)
    if got is None:
        if len(_COLS) > 500_000:
            _COLS.clear()
        parts = _CJK.findall(word) if ord(word[0]) >= 0x2E80 else [word] if len(word) > 1 and not word.isdigit() else []
        got = _COLS[word] = tuple(zlib.crc32(p.encode()) & (COLUMNS - 1) for p in parts)
    return got


def terms(text: str) -> Counter:
    """Counts by column number."""
    out: Counter = Counter()
    for w, n in Counter(words(text)).items():
        for c in _columns(w):
            out[c] += n
    return out


def _flat(batch: pd.DataFrame, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, counts and row numbers of a batch, row by row."""
    sizes = batch["cols"].map(len).to_numpy()
    if not sizes.sum():
        return np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int64)
    row = np.repeat(np.arange(len(batch)), sizes)
    col = np.concatenate(batch["cols"].to_list()).astype(np.int64)
    n = np.concatenate(batch["counts"].to_list()).astype(np.float32)
    good = keep[col]
    return col[good], n[good], row[good]


class Factors:
    """Subjects x columns `h`; languages x columns `common` (what all documents of a language share) and `share` (the language of a column)."""

    def __init__(self, h: np.ndarray, common: np.ndarray, share: np.ndarray, keep: np.ndarray, open_: np.ndarray):
        self.h, self.common, self.share, self.keep, self.open = (x if x.dtype == bool else x.astype(np.float32) for x in (h, common, share, keep, open_))
        self.norm()

    def norm(self) -> None:
        """A subject's row sums to 1 over the columns of each language, to less where little seeds the subject in that language."""
        self.scale = (self.open / np.maximum(self.share @ self.h.T, 1e-12)).astype(np.float32)

    def languages(self, col: np.ndarray, n: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The language of each row by its terms."""
        votes = np.stack([np.bincount(row, weights=n * s[col], minlength=rows) for s in self.share], axis=1)
        return votes.argmax(axis=1)

    def mixture(self, col: np.ndarray, n: np.ndarray, row: np.ndarray, rows: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mass of each subject, and last of the rest, in each row; each entry's part per component; languages of the rows."""
        lang = self.languages(col, n, row, rows)
        of = lang[row]
        hc = np.concatenate([self.h[:, col].T * self.scale[of], self.common[of, col][:, None]], axis=1).astype(np.float32) + np.float32(1e-12)
        w = np.ones((rows, hc.shape[1]), dtype=np.float32)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, dtype=int)
        part, ones = np.zeros_like(hc), np.ones(hc.shape[1], dtype=np.float32)
        for _ in range(steps if len(row) else 0):
            np.multiply(w[row], hc, out=part)
            part *= (n / (part @ ones))[:, None]
            w = np.zeros_like(w)
            w[row[starts]] = np.add.reduceat(part, starts, axis=0)
        return (w if len(row) else np.zeros_like(w)), part, lang


def _features(w: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of each subject among all subjects, and its mass per term of the document."""
    s = w[:, :-1]
    return s / np.maximum(s.sum(axis=1, keepdims=True), 1e-9), s / np.maximum(size, 1)[:, None]


def _pooled_ratio(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio for more documents than expected; 0 below two documents or `LIFT` times as many as expected."""
    lift = seen / np.maximum(expected, 1e-9)
    return np.where((seen >= 2) & (lift >= LIFT), 2 * (seen * np.log(np.maximum(lift, 1)) - (seen - expected)), 0)


def _thresholds(part_of: np.ndarray, dense: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Least share and mass by F1 on held-out labels: of all settings within one standard error of the best, the one nearest to the usual."""
    tried = []
    for a in np.arange(0.1, 0.525, 0.025):
        for b in (0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1):
            guess = (part_of >= a) & (dense >= b)
            tried.append((2 * (guess & truth).sum() / max(1, guess.sum() + truth.sum()), float(a), b))
    best = max(tried)[0]
    slack = np.sqrt(best * (1 - best) / max(1, truth.sum()))
    far = lambda t: abs(np.log(t[1] / USUAL[0])) + abs(np.log(t[2] / USUAL[1]))
    _, a, b = min((t for t in tried if t[0] >= best - slack), key=far)
    return a, b


def _read_factor(rows: DataFrame, size: int, base: float) -> np.ndarray:
    """A (`size`, COLUMNS) table from its entries (i, c, x), of which there are at most as many."""
    out, t = np.full((size, COLUMNS), base), rows.toArrow()
    out[t["i"].to_numpy(), t["c"].to_numpy()] = t["x"].to_numpy()
    return out


def fit_subjects(matrix: DataFrame, labels: DataFrame, areas: DataFrame) -> dict:
    """Factors, subjects and thresholds; `matrix` has _key, lang, cols, counts. What comes to the driver is bounded by COLUMNS, LANGUAGES and LABELLED."""
    described = areas.select("subject", "description").where("subject IS NOT NULL").orderBy("subject").collect()
    subjects = sorted({r["subject"] for r in described})
    k, place = len(subjects), {s: i for i, s in enumerate(subjects)}
    sizes = matrix.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # two letters at most: few rows
    g_all = min(len(sizes), LANGUAGES + 1)
    docs = np.zeros(g_all)
    number: dict[int, list[str]] = {}
    for i, r in enumerate(sizes):
        docs[min(i, g_all - 1)] += r["count"]
        number.setdefault(min(i, g_all - 1), []).append(r["lang"])
    of = F.coalesce(*[F.when(F.col("lang").isin(names), i) for i, names in number.items() if i < LANGUAGES], F.lit(g_all - 1))
    df = _read_factor(matrix.select(of.alias("i"), F.explode("cols").alias("c")).groupBy("i", "c").agg(F.count(F.lit(1)).alias("x")), g_all, 0.0)
    rate = df / docs[:, None]
    share = rate / np.maximum(rate.sum(axis=0), 1e-12)
    keep = (df.sum(axis=0) > 0) & (np.where(share >= 0.5, rate, 0).max(axis=0) <= COMMON)
    flat = Factors(np.zeros((k, COLUMNS)), df, share, keep, np.zeros((g_all, k)))
    # labelled documents and descriptions; some labelled documents are held out for the thresholds
    marks = labels.select(F.col("doc_id").alias("_key"), "subject").where("_key IS NOT NULL").groupBy("_key").agg(F.collect_set("subject").alias("subjects"))
    chosen = matrix.join(marks.orderBy(F.xxhash64("_key")).limit(LABELLED), "_key").select("_key", "cols", "counts", "subjects", (F.pmod(F.xxhash64("_key", F.lit("held out")), F.lit(HELD_OUT)) == 0).alias("held_out")).orderBy("_key").toPandas()
    lang = flat.languages(*_flat(chosen, keep), len(chosen)) if len(chosen) else np.empty(0, dtype=int)
    pairs = [[(g, x) for x in found if x in place] for g, found in zip(lang, chosen["subjects"])]
    labelled = Counter(p for ps in pairs for p in ps)
    away = np.array([bool(h) and all(labelled[p] >= 2 * HELD_OUT for p in ps) for h, ps in zip(chosen["held_out"], pairs)], dtype=bool)  # scarce labels only seed
    seeds, judged, lang = chosen[~away], chosen[away], lang[~away]
    said, seen, known = np.zeros((k, COLUMNS)), np.zeros((g_all, k, COLUMNS), dtype=np.float32), np.zeros((g_all, k))
    for cols, counts, found, g in zip(seeds["cols"], seeds["counts"], seeds["subjects"], lang):
        for s in (place[x] for x in found if x in place):
            said[s, cols] += counts
            seen[g, s, cols] += 1
            known[g, s] += 1
    # evidence is pooled over the languages, each with its own expected count: a word of another language, or a name, that turns
    # up in the few labelled documents of a language is no anchor
    evidence = _pooled_ratio(seen.sum(axis=0), np.einsum("gs,gc->sc", known, rate))
    anchored = evidence >= EVIDENCE
    keep |= (evidence >= SURE).any(axis=0)  # a term that many labels tie to a subject stays, however many documents the subject has
    anchored &= keep
    anchor = np.where(anchored, said, 0.0)
    for r in described:
        for c in terms(f"{r['subject']} {r['description'] or ''}"):
            anchor[place[r["subject"]], c] += 1.0 if keep[c] else 0.0
    held = share @ (anchor > 0).T  # anchors of each subject in each language
    # where fewer than two are the language's own, the telling terms of the labelled documents there seed the subject; the rounds
    # sort out which hold; with little to seed it a subject is held down there, in proportion
    seed, terms_of = np.zeros((k, COLUMNS)), held.copy()
    for g, s in zip(*np.nonzero((share >= 0.5) @ (anchor > 0).T < 2)):
        own = (seen[g, s] >= 1) & (seen[g, s] >= WEAK_LIFT * known[g, s] * rate[g]) & (share[g] >= 0.5) & keep & ~anchored[np.arange(k) != s].any(axis=0)
        seed[s, own] = seen[g, s, own]
        terms_of[g, s] += own.sum()
    h = anchor + seed + 1e-3 * anchor.sum(axis=1, keepdims=True) * df.sum(axis=0) * keep / max(1.0, df.sum())
    common = df * keep * np.where(anchored.any(axis=0), 0.1, 1.0) + 1e-6
    f = Factors(h, common / common.sum(axis=1, keepdims=True), share, keep, np.minimum(1.0, terms_of / 1.5))
    spark = matrix.sparkSession
    # each task adds up its part of the factors, so few long tasks rather than one per file split: what is shuffled is bounded by cores, not by data
    slim = matrix.select("cols", "counts").coalesce(2 * cores(spark))
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(f)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now = sent.value
            total = np.zeros((len(now.h) + len(now.common), COLUMNS), dtype=np.float64)
            for batch in batches:
                col, n, row = _flat(batch, now.keep)
                _, x, g = now.mixture(col, n, row, len(batch), INNER)
                for i in range(len(now.h)):
                    total[i] += np.bincount(col, weights=x[:, i], minlength=COLUMNS)
                for i in np.unique(g[row]):
                    at = g[row] == i
                    total[len(now.h) + i] += np.bincount(col[at], weights=x[at, -1], minlength=COLUMNS)
            i, c = np.nonzero(total)
            yield pd.DataFrame({"i": i, "c": c, "x": total[i, c]})

        new = _read_factor(slim.mapInPandas(part, "i bigint, c bigint, x double").groupBy("i", "c").agg(F.sum("x").alias("x")), k + g_all, 1e-9)
        h, common = new[:k], new[k:]
        # a term whose mass isn't mostly on subjects tells nothing: else a component could take a language's common words round by round
        idle = h.sum(axis=0) < TELLS * new.sum(axis=0)
        common += share * (h * idle).sum(axis=0)
        h = np.where(idle, 0.0, h * keep)
        h += ANCHOR * anchor / np.maximum(anchor.sum(axis=1, keepdims=True), 1e-12) * h.sum(axis=1, keepdims=True)
        f = Factors(h, common / common.sum(axis=1, keepdims=True), share, keep, f.open)
        sent.unpersist()
    share_least, mass_least = USUAL
    if len(judged):
        w, _, _ = f.mixture(*_flat(judged, keep), len(judged), LAST)
        truth = np.array([[s in set(found) for s in subjects] for found in judged["subjects"]])
        share_least, mass_least = _thresholds(*_features(w, judged["counts"].map(sum).to_numpy()), truth)
    return {"factors": f, "subjects": subjects, "share": share_least, "mass": mass_least}


def term_matrix(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """_key, lang, cols, counts: one row per document with text."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cols, counts = [], []
            for t in batch["_text"]:
                c = terms(t)
                cols.append(np.fromiter(c.keys(), dtype=np.int32, count=len(c)))
                counts.append(np.fromiter(c.values(), dtype=np.int32, count=len(c)))
            yield pd.DataFrame({"_key": batch["_key"].to_numpy(), "lang": pd.Series(batch["lang"].tolist(), dtype=object), "cols": cols, "counts": counts})

    x = documents.select(F.col(key).alias("_key"), F.lower(F.substring(F.coalesce(F.col(lang), F.lit("")), 1, 2)).alias("lang"), F.col(text).alias("_text")).where("_key IS NOT NULL AND _text IS NOT NULL AND _text <> ''")
    return cut(x.mapInPandas(part, "_key bigint, lang string, cols array<int>, counts array<int>"))


def document_subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, subject, share) for every subject a document deals with in a good part of its text.

    `share` is the subject's part of what the document says on any subject. Documents without text, and small talk, have
    no row; repeated keys give one row per subject; without documents, areas or labels there are no rows (without labels
    the descriptions alone seed the factors).
    """
    m = term_matrix(documents, key)
    spark = documents.sparkSession
    schema = f"`{key}` bigint, subject string, share double"
    if areas.where("subject IS NOT NULL").isEmpty() or m.isEmpty():
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(fit_subjects(m, labels, areas))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = model.value
        for batch in batches:
            w, _, _ = f["factors"].mixture(*_flat(batch, f["factors"].keep), len(batch), LAST)
            share, dense = _features(w, batch["counts"].map(sum).to_numpy())
            i, s = np.nonzero((share >= f["share"]) & (dense >= f["mass"]))
            yield pd.DataFrame({key: batch["_key"].to_numpy()[i], "subject": pd.Series([f["subjects"][x] for x in s], dtype=object), "share": share[i, s]})

    return m.select("_key", "cols", "counts").mapInPandas(part, schema).groupBy(key, "subject").agg(F.max("share").alias("share"))
