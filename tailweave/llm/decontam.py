"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items (at most MOST_BYTES, in blocks of MOST_WORDS words, which bound the index) are cut into passages of SPAN words.  Document frequencies of their words
   are counted over all document passages.
2. The TF-IDF matrix of the benchmark passages gets a randomised SVD: products with the matrix are sums over the
   executors' rows; only thin matrices (terms x RANK) come together.
3. Every passage of every document (SPAN words, every STEP words) is projected into the latent space and compared with
   all benchmark passages, in blocks; those at least LIKELY alike are candidates.  No candidate is left out by rank or number:
   a block has more passages than RANK where its items need it, and the passages of which the basis keeps less than KEPT
   of their length are compared by their whole TF-IDF vectors, through lists of the passages of each term.
   Beside the cosines, an unbroken run of words that would do by itself makes a candidate, however common its words.
4. A candidate counts if the longest common subsequence of the item's words and the words around the passage covers
   the item and the answer check passes: if the item has an answer part (after its last ``?`` or an ``answer:`` mark), the
   answer's words must stand there; if not, half of its rarest words must.  A stretch of RUN words of the item, almost
   unbroken wherever it stands, counts without that check, which is for paraphrases: words copied in a row are a leak
   whatever follows them.

Terms that no benchmark item has, or that stand in more than COMMON of all passages, carry no weight; but benchmark
passages with fewer than FEW other terms keep all of theirs.  All results are exact functions of the rows, in any order of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require_bound, stored, unused, without_ids
from .textarrays import arrow_map, JOIN, mix, slices, U, words

SPAN, STEP, RANK, OVERSAMPLE, TURNS = 48, 24, 256, 16, 2
LIKELY, COVER = 0.30, 0.60
#: Without full cover: so many words in sequence, in at most 1 / DENSE times as many words of the document.
RUN, DENSE = 13, 0.85
COMMON, FEW = 0.05, 4
#: Least length of a unit passage in the basis for which latent cosines stand for the whole ones.
KEPT = 0.995
#: Words of a shared run; items of fewer words are looked for as a whole, from FEW words on.
SHARED = 8
MOST_BYTES, MOST_WORDS = 64 << 20, 100_000
KEY_WORDS = 6

#: ASCII punctuation parts words here, and case is folded for all letters: neither hides a copy.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def plain_words(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds) of runs of whole texts."""
    for row, _, data, offsets in slices(texts, change=pc.utf8_lower):
        yield row, *words(PLAIN[data], offsets)


_ANSWER = re.compile(r"(?is).*(?:\banswers?\s*:|\?)\s*(\S.*)")


def spans(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of each run of words: owner, first word, end word.  Each is two steps long, but for what the end leaves."""
    n = np.diff(bounds)
    k = np.where(n > 0, np.maximum(-(-n // STEP) - 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), k)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k)) * STEP
    start = place + bounds[:-1][owner]
    return owner, start, np.minimum(start + SPAN, bounds[1:][owner])


def inside(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every passage each of its places: (passage, place)."""
    n = end - start
    passage = np.repeat(np.arange(len(n)), n)
    return passage, np.arange(len(passage)) - np.repeat(np.cumsum(n) - n, n) + start[passage]


def lookup(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted terms; -1: none."""
    if not len(terms):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, at, -1)


def common_subsequence(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(length of the longest common subsequence, words of the text from its first to its last match), bit-parallel."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    state, best, first, last = full, 0, None, None
    for place, w in enumerate(text.tolist()):
        m = masks.get(w)
        if m is None:
            continue
        u = state & m
        state = ((state + u) | (state - u)) & full
        length = len(item) - state.bit_count()
        if length > best:
            best, last = length, place
            first = place if first is None else first
    return best, 0 if first is None else last - first + 1


def dense_stretch(item: np.ndarray, text: np.ndarray) -> bool:
    """Whether RUN words of the item stand in sequence somewhere within RUN / DENSE words of the text, and of the item."""
    span = int(RUN / DENSE)

    def crowded(here: np.ndarray) -> np.ndarray:
        """The first places of spans with RUN words that are there."""
        n = np.concatenate(([0], np.cumsum(here)))
        return np.flatnonzero(n[np.minimum(np.arange(len(here)) + span, len(here))] - n[:-1] >= RUN)

    for a in crowded(np.isin(text, item)):
        own = text[a : a + span]
        for b in crowded(np.isin(item, own)):
            if common_subsequence(item[b : b + span], own)[0] >= RUN:
                return True
    return False


def bags(term: np.ndarray, passage: np.ndarray, n: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse term counts: (passage, term, count), sorted by passage and term."""
    known = term >= 0
    key, count = np.unique(passage[known] * max(1, terms) + term[known], return_counts=True)
    return key // max(1, terms), key % max(1, terms), count


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n words in sequence, at its first word; across bounds of texts too."""
    out = hashes[: max(0, len(hashes) - n + 1)]
    for k in range(1, n):
        out = mix(out * JOIN + hashes[k : k + len(out)])
    return out


def expanded(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry its list of n places from first on: (entry, place)."""
    entry = np.repeat(np.arange(len(n)), n)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + first[entry]


@dataclass(frozen=True)
class SharedRuns:
    """All runs of n words of the items that have so many, sorted by hash."""

    n: int
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray  # in the item
    filter: np.ndarray  # of the last 20 bits of the hashes

    def found(self, hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, place of its first word, words) of unbroken runs that would do by themselves.  sizes: words of each item."""
        own = runs_of(hashes, self.n)
        at = np.flatnonzero(self.filter[(own & U(0xFFFFF)).astype(np.int64)])
        low, high = (np.searchsorted(self.hashes, own[at], side) for side in ("left", "right"))
        hit, line = expanded(low, high - low)
        where, item = at[hit], self.item[line]
        text = np.searchsorted(first, where, "right") - 1
        inner = where + self.n <= first[text + 1]
        where, item, text, shift = where[inner], item[inner], text[inner], (where - self.place[line])[inner]
        order = np.lexsort((where, shift, item))
        where, item, text, shift = where[order], item[order], text[order], shift[order]
        if not len(where):
            return where, where, where, where
        head = np.flatnonzero(np.concatenate(([True], (np.diff(where) != 1) | (np.diff(item) != 0) | (np.diff(shift) != 0) | (np.diff(text) != 0))))
        length = np.diff(np.append(head, len(where))) + self.n - 1
        ok = (length >= RUN) | (length >= COVER * sizes[item[head]])
        return text[head[ok]], item[head[ok]], where[head[ok]], length[ok]


def shared_runs(items: list[Item]) -> list[SharedRuns]:
    out = []
    length = np.array([len(m.words) for m in items], np.int64)
    for n in range(FEW, SHARED + 1):
        own = np.flatnonzero(length >= SHARED if n == SHARED else length == n)
        if len(own):
            hashes = np.concatenate([runs_of(items[k].words, n) for k in own])
            item, place = expanded(np.zeros(len(own), np.int64), length[own] - n + 1)
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(hashes & U(0xFFFFF)).astype(np.int64)] = True
            out.append(SharedRuns(n, hashes[order], own[item][order], place[order], bits))
    return out


@dataclass(frozen=True)
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray
    rare: np.ndarray


@dataclass(frozen=True)
class LatentIndex:
    terms: np.ndarray  # of all items
    weight: np.ndarray  # idf of each term, or 0
    row: np.ndarray  # of each term in the basis; the last one, of zeros, for terms of other blocks
    basis: np.ndarray  # rows x rank
    items: list[Item]
    passage_item: np.ndarray  # of each benchmark passage: its item
    passages: np.ndarray  # latent, of length 1
    whole: np.ndarray  # the passages to be compared by their whole vectors
    lists: tuple[np.ndarray, np.ndarray, np.ndarray]  # of those: bounds by term, place in whole, weight in a vector of length 1
    runs: list[SharedRuns]

    def weighted(self, term: np.ndarray) -> np.ndarray:
        """-1 for terms without weight too."""
        return np.append(np.where(self.weight > 0, np.arange(len(self.terms)), -1), -1)[term]

    def latent(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Latent vectors of passages, divided by the length of the whole TF-IDF vector; so products with the index are cosines.

        Counts weigh linearly: a word is projected once, into its step, and a passage is the sum of its two steps.
        """
        out = np.zeros((len(start), self.basis.shape[1]), np.float32)
        term = self.weighted(lookup(self.terms, hashes))
        passage, place = inside(start, end)
        p, t, c = bags(term[place], passage, len(start), len(self.terms))
        if not len(p):
            return out
        norm = np.sqrt(np.bincount(p, (c * self.weight[t]) ** 2, len(start)))
        cut = np.append(np.unique(np.concatenate([start, np.minimum(start + STEP, end)])), end.max())
        known = np.flatnonzero(term >= 0)
        step = np.searchsorted(cut, known, "right") - 1
        heads = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1])))
        steps = np.zeros((len(cut) + 1, out.shape[1]), np.float32)
        for a in range(0, len(heads), 2048):
            b = min(a + 2048, len(heads))
            own = term[known[heads[a] : heads[b] if b < len(heads) else len(known)]]
            part = self.basis[self.row[own]]
            part *= self.weight[own, None].astype(np.float32)
            steps[step[heads[a:b]]] = np.add.reduceat(part, heads[a:b] - heads[a], axis=0)
        first = np.searchsorted(cut, start)
        out += steps[first]
        long = end - start > STEP
        out[long] += steps[first[long] + 1]
        return out / np.maximum(norm, 1e-12)[:, None].astype(np.float32)


    def cosines(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, benchmark passage, cosine) of those LIKELY alike among ``whole``, by all their terms."""
        if not len(self.whole):
            return
        term, (bounds, which, weight) = self.weighted(lookup(self.terms, hashes)), self.lists
        for a in range(0, len(start), 256):
            own = slice(a, min(a + 256, len(start)))
            n = own.stop - a
            passage, place = inside(start[own], end[own])
            p, t, c = bags(term[place], passage, n, len(self.terms))
            w = c * self.weight[t]
            norm = np.sqrt(np.bincount(p, w * w, n))
            entry, line = expanded(bounds[t], bounds[t + 1] - bounds[t])
            alike = np.bincount(p[entry] * len(self.whole) + which[line], w[entry] * weight[line], n * len(self.whole)).reshape(n, -1)
            x, y = np.nonzero(alike >= LIKELY * np.maximum(norm, 1e-12)[:, None])
            yield x + a, self.whole[y], alike[x, y] / norm[x]

    def cosine(self, one: np.ndarray, other: np.ndarray) -> float:
        """Of two passages, by all terms."""
        a, b = (np.bincount(t[t >= 0], minlength=len(self.terms)) * self.weight for t in (self.weighted(lookup(self.terms, x)) for x in (one, other)))
        return float(a @ b / max(1e-12, np.sqrt((a @ a) * (b @ b))))


def _text_words(text: str) -> np.ndarray:
    return next(plain_words(pa.array([text])))[1]


def document_frequencies(texts: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many passages of all texts each term stands, and the number of passages."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, 0
        sums = np.zeros(len(own), np.int64)
        for batch in batches:
            for _, hashes, first in plain_words(batch.column(0)):
                _, start, end = spans(first)
                total += len(start)
                # a term stands in the passages over its place; runs of passages are counted at their first sight of it
                passage, place = inside(start, end)
                term = lookup(own, hashes)[place]
                _, t, _ = bags(term, passage, len(start), len(own))
                sums += np.bincount(t, minlength=len(own))
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(sums[full], total))], names=["term", "n"])

    rows = texts.transform(arrow_map, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row a term
    term, n = rows["term"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(len(terms), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def randomised_svd(rows: DataFrame, terms: int, rank: int, turns: int = TURNS, seed: int = 11) -> np.ndarray:
    """rows: ``term`` array<int>, ``weight`` array<double> (sparse rows of A).  Right singular vectors, terms x rank.

    Each product A'(A X) is summed by Spark from partial sums of its tasks, one row of terms at a time.
    """
    width = min(terms, rank + OVERSAMPLE)
    x = np.random.default_rng(seed).standard_normal((terms, width))

    def gram(x: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(x.astype(np.float32))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[int, np.ndarray] = {}  # blocks of 1024 terms, only those that the task's rows have
            for batch in batches:
                for t, w in zip(batch.column(0), batch.column(1), strict=True):
                    t, w = t.values.to_numpy(), w.values.to_numpy()
                    if len(t):
                        y = np.outer(w, w @ shared.value[t].astype(np.float64))
                        for a in np.unique(t >> 10).tolist():
                            here = t >> 10 == a
                            own.setdefault(a, np.zeros((min(1024, terms - a * 1024), width)))[t[here] & 1023] += y[here]
            for a, block in own.items():
                yield pa.RecordBatch.from_arrays([pa.array([a * 1024], pa.int64()), pa.array([block.tobytes()], pa.binary())], names=["first", "y"])

        def summed(parts: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(y.as_buffer(), np.float64) for y in parts["y"].combine_chunks())
            return pa.table({"first": parts["first"][:1], "y": pa.array([total.tobytes()], pa.binary())})

        partial = rows.select("term", "weight").transform(arrow_map, run, "first long, y binary")
        out = np.zeros((terms, width))
        for r in partial.groupBy("first").applyInArrow(summed, "first long, y binary").toLocalIterator():  # blocks of 1024 terms
            block = np.frombuffer(r["y"]).reshape(-1, width)
            out[r["first"] : r["first"] + len(block)] = block
        return out

    for _ in range(turns):
        x, _ = np.linalg.qr(gram(x))
    small = x.T @ gram(x)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(-value)[:rank]
    keep = keep[value[keep] > 1e-9 * max(1e-300, value.max(initial=0))]
    return x @ vector[:, keep]


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[list[tuple[int, str]]]:
    """The items in blocks of at most MOST_WORDS words (or one item).

    Items without id, text or word can't be found and are passed over; repeated rows count once.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    require_bound(size or 0, MOST_BYTES, "bytes of benchmark items")
    blocks, room = [], 0
    for i, text in sorted((r["id"], r["text"]) for r in items.collect()):
        n = len(_text_words(text))
        if n:
            if n > room:
                blocks.append([])
                room = MOST_WORDS
            blocks[-1].append((i, text))
            room -= n
    return blocks


@dataclass(frozen=True)
class Passages:
    """The words of items, cut into passages."""

    texts: list[np.ndarray]
    hashes: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Passages:
        texts = [_text_words(t) for _, t in items]
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64)
        return Passages(texts, np.concatenate(texts) if texts else np.zeros(0, np.uint64), *spans(bounds))

    def bags(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        passage, place = inside(self.start, self.end)
        return bags(lookup(terms, self.hashes)[place], passage, len(self.start), len(terms))


def term_weights(texts: DataFrame, items: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms of all items, their idf, their weight): the same for every block, so that no cosine depends on blocks.

    texts: one column, the document texts, read once.  Terms in more than COMMON of all passages weigh 0.
    """
    own = Passages.of(items)
    terms = np.unique(own.hashes)
    df, total = document_frequencies(texts, terms)
    idf = np.log((total + 1) / (df + 1)) + 0.1
    common = df > COMMON * total
    p, t, _ = own.bags(terms)
    if len(p):
        common[t[np.bincount(p[~common[t]], minlength=len(own.start))[p] < FEW]] = False
    return terms, idf, np.where(common, 0.0, idf)


def build_index(texts: DataFrame, items: list[tuple[int, str]], rank: int = RANK, weights: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> LatentIndex:
    """texts: one column, the document texts.  items: id and text, each with a word.  weights: of the terms of all items, if these are only some."""
    terms, idf, weight = weights or term_weights(texts, items)
    own = Passages.of(items)
    made = []
    for (i, text), w in zip(items, own.texts, strict=True):
        m = _ANSWER.fullmatch(text)
        answer = _text_words(m[1]) if m else np.zeros(0, np.uint64)
        once = np.unique(w)
        rare = once[np.lexsort((once, -idf[lookup(terms, once)]))][:KEY_WORDS]
        made.append(Item(i, w, answer, rare))
    start, end = own.start, own.end
    p, t, c = own.bags(terms)
    p, t, c = (x[weight[t] > 0] for x in (p, t, c))
    w = c * weight[t]
    norm = np.sqrt(np.bincount(p, w * w, len(start)))
    w = w / np.maximum(norm, 1e-12)[p] if len(p) else w
    cut = np.searchsorted(p, np.arange(len(start) + 1))
    none, here = np.zeros(0, np.int64), np.unique(t)  # the terms of this block
    row = np.full(len(terms) + 1, len(here), np.int32)
    row[here] = np.arange(len(here))
    index = LatentIndex(terms, weight, row, np.zeros((len(here) + 1, 0), np.float32), made, own.owner, np.zeros((len(start), 0), np.float32), none, (none, none, none), [])
    if not made:
        return index
    sparse = [(row[t[a:b]].tolist(), w[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    frame = texts.sparkSession.createDataFrame(sparse, "term array<int>, weight array<double>")
    basis = randomised_svd(frame, len(here), min(rank, len(start))).astype(np.float32) if len(here) else np.zeros((0, 0), np.float32)
    index = replace(index, basis=np.concatenate([basis, np.zeros((1, basis.shape[1]), np.float32)]))
    latent = index.latent(own.hashes, start, end)
    length = np.linalg.norm(latent, axis=1, keepdims=True)
    whole = np.flatnonzero((length[:, 0] < KEPT) & (norm > 0))
    at = lookup(whole, p)
    order = np.flatnonzero(at >= 0)
    order = order[np.argsort(t[order], kind="stable")]
    lists = np.searchsorted(t[order], np.arange(len(terms) + 1)), at[order], w[order]
    return replace(index, passages=latent / np.maximum(length, 1e-12), whole=whole, lists=lists, runs=shared_runs(made))


def confirmed(item: Item, text: np.ndarray) -> tuple[float, float] | None:
    """(cover of the item, density) if the words around a candidate hold the item; more of the item never turns a hit into a miss.

    Either the item is covered and the answer check passes, or a stretch of the item stands there almost unbroken.
    """
    length, width = common_subsequence(item.words, text)
    cover, dense = length / len(item.words), length / max(1, width)
    if length < RUN and cover < COVER:
        return None
    if cover >= COVER:
        there = set(text.tolist())
        key = item.answer if len(item.answer) else item.rare
        have = sum(w in there for w in key.tolist())
        if have >= len(key) * (1.0 if len(item.answer) else 0.5):
            return cover, dense
    return (cover, dense) if length >= RUN and dense_stretch(item.words, text) else None


def contaminated(df: DataFrame, index: LatentIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs found: id, item_id, cosine, cover; at most one row for each row of df and item.

    Null and empty texts hold nothing.  Repeated rows of df give repeated pairs.
    """
    shared = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = np.array([len(item.words) for item in m.items], np.int64)
        for batch in batches:
            found: list[tuple[int, int, float, float]] = []
            for at, hashes, first in plain_words(batch.column(1)) if m.items else ():
                owner, start, end = spans(first)
                latent = m.latent(hashes, start, end)
                best: dict[tuple[int, int], tuple[float, float]] = {}

                def judge(x: int, which: int, cosine: float, low: int, high: int) -> None:
                    doc, item = int(owner[x]), m.items[which]
                    have = best.get((doc, which))
                    if have and have[1] >= 1 and cosine <= have[0]:
                        return
                    reach = len(item.words) + SPAN // 2
                    ok = confirmed(item, hashes[max(first[doc], low - reach) : min(first[doc + 1], high + reach)])
                    if ok and (not have or (ok[0], cosine) > (have[1], have[0])):
                        best[doc, which] = (cosine, ok[0])

                for k in range(0, len(m.passages), 1024):
                    alike = latent @ m.passages[k : k + 1024].T
                    for x, y in zip(*np.nonzero(alike >= LIKELY), strict=True):
                        judge(x, int(m.passage_item[k + y]), float(alike[x, y]), start[x], end[x])
                for xs, ys, alike in m.cosines(hashes, start, end):
                    for x, y, cosine in zip(xs, ys, alike, strict=True):
                        judge(x, int(m.passage_item[y]), float(cosine), start[x], end[x])
                for runs in m.runs:
                    for doc, which, place, n in zip(*runs.found(hashes, first, sizes), strict=True):
                        if (int(doc), int(which)) not in best:
                            x = int(np.searchsorted(start, place, "right")) - 1
                            one = hashes[start[x] : end[x]]
                            judge(x, int(which), max(m.cosine(one, m.items[which].words[a:b]) for _, a, b in zip(*spans(np.array([0, sizes[which]])), strict=True)), place, place + n)
                found += [(at + doc, m.items[which].item_id, *v) for (doc, which), v in sorted(best.items())]
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *(pa.array([f[k] for f in found], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64())))], names=["id", "item_id", "cosine", "cover"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).transform(arrow_map, run, f"`id` {kind}, item_id long, cosine double, cover double").withColumnRenamed("id", id_col)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """contaminated() for all items: block after block of the benchmark against all rows.

    Very long texts are read whole, passage by passage.  Without items or rows there are no pairs.  Repeated benchmark rows count
    once; different texts under one item id are items of their own.  Other columns, whatever their names, do not matter.
    """
    texts, out, blocks = docs.select(F.col(text_col).alias("text")), None, item_blocks(benchmark) or [[]]
    weights = term_weights(texts, [item for items in blocks for item in items])
    for items in blocks:
        own = contaminated(docs, build_index(texts, items, weights=weights), id_col, text_col)
        out = own if out is None else out.unionAll(own)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no benchmark item; rows with null or repeated ids are judged by their own text.

    All columns stay, whatever their names.
    """
    key, = unused(docs, "__row")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`")))
    hit = find_leaks(keyed, benchmark, key, text_col).select(F.col(key).alias("id")).distinct()
    return without_ids(keyed, stored(hit, "leaks"), key).select(*[F.col(f"`{c}`") for c in docs.columns])
