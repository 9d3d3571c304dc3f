"""Evaluation texts that leaked into training text.

Every shard of documents becomes a suffix array over its words. Each suffix of each held-out item is searched in it by
bisection up to the next word that tells the item from others, so stock wording with other names finds nothing; only
suffixes that begin with three words of some item can match, so the array holds those alone. Where a search hits, the
longest verbatim matches between document and item are taken and checked exactly, word by word.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a shard.
SHARD_WORDS = 4_000_000
#: Share of an item that must be there; fewest words; share of its telling words that must be the same; widest edit.
SHARE, LEAST, TELLING, EDIT = 0.4, 8, 0.5, 4
#: A word tells of what an item is if at most so many passages, or this share of them, have it.
TELLS_AT_MOST, TELLS_SHARE = 2, 0.02
#: Words at the two ends of a cut passage that an edit may have changed beyond recognition.
EDGE = 2
#: The items go to every worker: more characters than this is an error, not a cut.
ITEMS_LIMIT = 64_000_000
_WORD, _ASCII_WORD = re.compile(r"[^\W_]+"), re.compile(r"[a-z0-9]+")
_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}]+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_LAYOUT_LINE = re.compile(r"WEBVTT.*|\d+[ \t]*|.*-->.*|[^:]{1,60} {2,}\d{1,3}(?::\d{2}){1,2}[ \t]*")
_LINE_HEAD = re.compile(r"(?:[\[(<]?\d{1,3}(?::\d{2}){1,2}(?:[.,]\d+)?[\])>]?:?[ \t]*(?:-[ \t])?)?(?:[^:.!?]{1,50}:[ \t]+)?")


def without_layout(text: str) -> str:
    """A transcript without cue times, numbers, labels at line heads and tags."""
    lines = [x[_LINE_HEAD.match(x).end() :] for x in text.split("\n") if x and not _LAYOUT_LINE.fullmatch(x)]
    text = "\n".join(lines)
    return _TAG.sub(" ", text) if "<" in text else text


def words(text: str) -> list[str]:
    """Words in lower case without accents, invisible characters and the layout of transcripts."""
    text = without_layout(html.unescape(text) if "&" in text else text)
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower()
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def alike(items: list[list[int]], length: int = 5, share: float = 0.8) -> list[int]:
    """Per item a class: items that share four fifths of their runs of five words with one of a class belong to it."""
    runs = [{tuple(w[i : i + length]) for i in range(len(w) - length + 1)} or {tuple(w)} for w in items]
    holders: dict[tuple, list[int]] = {}
    root = list(range(len(items)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, r in enumerate(runs):
        both = Counter(j for x in r for j in holders.get(x, ()))
        for j, n in both.items():
            if n >= share * (len(r) + len(runs[j]) - n) and top(i) != top(j):
                root[top(i)] = top(j)
        if top(i) == i:  # one passage of a class stands for it
            for x in r:
                holders.setdefault(x, []).append(i)
    return [top(i) for i in range(len(items))]


class Items:
    """The held-out items as word numbers, with their suffixes ready for bisection."""

    def __init__(self, items: list[tuple[int, str]]):
        listed = [(i, w) for i, t in items if t and (w := words(t))]
        self.ids = [i for i, _ in listed]
        self.number: dict[str, int] = {}
        self.items = [np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], dtype=np.int64) for _, w in listed]
        # a word tells if few different passages have it; passages that share much of their wording word for word are one, under however many ids
        same = alike([w.tolist() for w in self.items])
        seen = Counter(x for x, _ in {(int(x), c) for w, c in zip(self.items, same) for x in w.tolist()})
        self.tells = [np.array([seen[int(x)] <= max(TELLS_AT_MOST, TELLS_SHARE * len(set(same))) for x in w]) for w in self.items]
        self.base = len(self.number) + 1
        grams = [self.grams(w) for w in self.items]
        self.starts = np.unique(np.concatenate(grams)) if grams else np.empty(0, dtype=np.int64)
        rows, owner = [], []
        for k, (w, t) in enumerate(zip(self.items, self.tells)):
            for i in range(len(w) - 2):
                near = np.flatnonzero(t[i : i + 16])
                if len(near):  # a match must take in the next telling word, and four words at least
                    rows.append(w[i : i + max(4, int(near[0]) + 1)])
                    owner.append(k)
        self.queries, self.owner = rows, owner
        self.depth = max(map(len, rows), default=4)  # words of a suffix that are compared: as many as the longest query has

    def grams(self, w: np.ndarray) -> np.ndarray:
        if len(w) < 3:
            return np.empty(0, dtype=np.int64)
        g = (w[:-2] * self.base + w[1:-1]) * self.base + w[2:]
        g[(w[:-2] == 0) | (w[1:-1] == 0) | (w[2:] == 0)] = -1
        return g

    def search(self, docs: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int]]:
        """(doc, item, words of the item found, words of the item) for a shard."""
        gap = np.zeros(self.depth, dtype=np.int64)
        text = np.concatenate([x for _, w in docs for x in (w, gap[:3])] + [gap])
        begins = np.cumsum([0] + [len(w) + 3 for _, w in docs])
        at = np.flatnonzero(np.isin(self.grams(text), self.starts))
        if not len(at):
            return []
        rows = np.lib.stride_tricks.sliding_window_view(text, self.depth)[at].astype(">u4")
        keys = np.ascontiguousarray(rows).view(f"V{4 * self.depth}").ravel()
        as_bytes = [k.tobytes() for k in keys]
        order = sorted(range(len(at)), key=as_bytes.__getitem__)
        array = [as_bytes[i] for i in order]
        found: set[tuple[int, int]] = set()
        for w, k in zip(self.queries, self.owner):
            q = w.astype(">u4").tobytes()
            lo = bisect_left(array, q)
            if lo < len(array) and array[lo].startswith(q):
                hi = bisect_left(array, q + b"\xff" * 4, lo)
                for i in order[lo:hi]:
                    found.add((int(np.searchsorted(begins, at[i], "right")) - 1, k))
        return [(docs[d][0], self.ids[k], *r) for d, k in sorted(found) if (r := self.check(docs[d][1], k))]

    def check(self, doc: np.ndarray, k: int) -> tuple[int, int] | None:
        """Words of item k that the document carries, with small edits between verbatim matches; None if too few."""
        item, tells = self.items[k], self.tells[k]
        where: dict[tuple, list[int]] = {}
        d, w = doc.tolist(), item.tolist()
        grams = {tuple(w[i : i + 2]) for i in range(len(w) - 1)}
        for j in range(len(d) - 1):
            if d[j] and (g := (d[j], d[j + 1])) in grams:
                where.setdefault(g, []).append(j)
        runs = []  # maximal verbatim matches (document position, item position, length)
        for i in range(len(w) - 1):
            for j in where.get(tuple(w[i : i + 2]), ()):
                if i and j and w[i - 1] == d[j - 1]:
                    continue
                n = 2
                while i + n < len(w) and j + n < len(d) and w[i + n] == d[j + n]:
                    n += 1
                runs.append((j, i, n))
        runs.sort()
        held = np.zeros(len(w), dtype=bool)
        same = np.zeros(len(w), dtype=bool)
        strong = [n >= 4 or (n == 3 and bool(tells[i : i + n].any())) for _, i, n in runs]
        close = lambda x, y: 0 <= runs[y][1] - runs[x][1] - runs[x][2] <= EDIT and 0 <= runs[y][0] - runs[x][0] - runs[x][2] <= EDIT + 2
        edits = []
        for x, (j, _, n) in enumerate(runs):
            for y in range(x + 1, len(runs)):
                if runs[y][0] > j + n + EDIT + 2:  # too far on in the document, as are all after it
                    break
                if close(x, y):
                    edits.append((x, y))
        kept = [s or any(strong[x] for x, y2 in edits if y2 == y) or any(strong[y2] for x, y2 in edits if x == y) for y, s in enumerate(strong)]
        for (j, i, n), k_ in zip(runs, kept):
            if k_:
                held[i : i + n] = same[i : i + n] = True
        for x, y in edits:  # an edit: a few words on both sides between two matches
            if kept[x] and kept[y]:
                (j, i, n), (j2, i2, _) = runs[x], runs[y]
                held[i + n : i2] = True
                for p in range(i + n, i2):
                    same[p] |= w[p] in d[j + n : j2]
        total = int(held.sum())
        telling = int((held & tells).sum())
        if total < LEAST or total + EDGE < SHARE * len(w) or telling == 0 or (same & tells).sum() < TELLING * telling:
            return None
        return total, len(w)


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "item_text") -> DataFrame:
    """(key, item, n_found, n_words): the documents that carry two fifths or more of an item's passage, in one place or cut up or edited there.

    NULL and empty texts or passages, and NULL keys, match nothing; repeated rows count once; further columns are
    ignored; an empty table on either side gives no rows. Passages of fewer than eight words are no case.
    """
    rows = items.select(item, passage).where(F.col(item).isNotNull() & F.col(passage).isNotNull()).dropDuplicates([item])
    size = rows.agg(F.sum(F.length(passage))).first()[0] or 0
    if size > ITEMS_LIMIT:
        raise ValueError(f"the items hold {size} characters, more than {ITEMS_LIMIT}")
    shared = documents.sparkSession.sparkContext.broadcast(Items(sorted((r[0], r[1]) for r in rows.toLocalIterator())))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, shard, n = shared.value, [], 0
        get, out = search.number.get, []
        for batch in batches:
            for i, t in zip(batch["_key"], batch["_text"]):
                w = [get(x, 0) for x in words(t)]
                shard.append((i, np.array(w, dtype=np.int64)))
                n += len(w)
                if n >= SHARD_WORDS:
                    out += search.search(shard)
                    shard, n = [], 0
            if out:
                yield pd.DataFrame(out, columns=[key, item, "n_found", "n_words"])
                out = []
        if shard:
            yield pd.DataFrame(search.search(shard), columns=[key, item, "n_found", "n_words"])

    x = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key IS NOT NULL AND _text IS NOT NULL AND _text <> ''")
    schema = f"`{key}` bigint, `{item}` bigint, n_found bigint, n_words bigint"
    return x.mapInPandas(part, schema).groupBy(key, item).agg(F.max("n_found").alias("n_found"), F.max("n_words").alias("n_words"))


def without_leaks(documents: DataFrame, leaks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents in which no item was found."""
    return documents.join(leaks.select(key).distinct(), key, "left_anti")
