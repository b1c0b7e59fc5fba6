"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs, those seen once among them, are gathered from the whole training corpus.  A count c
is quantised to level 1 + floor(log2 c), and the filter holds the keys (n-gram, 1) ... (n-gram, level): probing level
after level until one is missing gives the count back.  N-grams are dealt by hash to segments of about SEGMENT_TOKENS
tokens; a segment is filled by one task, with BITS bits a key, so the filter grows with the corpus and a text's score
depends on counts only.

Up to MOST_BROADCAST bytes the filter is broadcast, in parts of at most MOST_BYTES; scoring probes it for every distinct
n-gram of HELD tokens, with one part in memory after the other.
A larger filter stays where it is: the distinct n-grams of HELD tokens travel to the segments, are probed there, and their
levels come back.  Both ways give the same levels.

Beside the model's score stands an exact unigram base score: words of the HOT_WORDS table are added up where
the text is read, all others are joined with the full count table by key.  Equal 64-bit hashes of different words are
not told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textarrays import arrow_map, JOIN, mix, signed, slices, U, words

PROBES, BITS = 5, 10
#: Of a part of the filter, and of all parts that are broadcast.
MOST_BYTES, MOST_BROADCAST = 96 << 20, 512 << 20
SEGMENT_TOKENS = 250_000
#: Training tokens whose pairs a shuffle partition merges, one segment after the other.
PARTITION_TOKENS = 2_000_000
HOT_WORDS = 1_000_000
#: Tokens whose pairs a task collects before it deals them out.
FLUSH = 1_000_000
#: Tokens of the texts that go through the parts of the filter together.
HELD = 1_000_000
END = mix(np.array([0xE0D], np.uint64))[0]
_PAIR = U(0xA0761D6478BD642F)
ADD = 0.1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one END after each text; bounds."""
    hashes, first = words(data, offsets)
    bounds = first + np.arange(len(first))
    out = np.empty(bounds[-1], np.uint64)
    out[bounds[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[bounds[1:] - 1] = False
    out[inner] = hashes
    return out, bounds


def pair_hashes(t: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The pair (token before, token) at each token; END stands before the first."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[bounds[:-1]] = END
    return mix((before + _PAIR) * JOIN + t)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def _word_counts(texts: DataFrame) -> DataFrame:
    """word, n: summed within each task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                k, c = np.unique(tokens(data, offsets)[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                size += len(k)
                if size > FLUSH:
                    keys, counts = ([x] for x in _merged(keys, counts))
                    size = len(keys[0])
        if keys:
            k, c = _merged(keys, counts)
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(signed(k[a : a + 100_000])), pa.array(c[a : a + 100_000])], names=["word", "n"])

    return texts.transform(arrow_map, run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    """Segments are runs of hashes, so sorted grams lie in order of segments."""
    return ((grams >> U(32)) * U(segments)) >> U(32)


def _dealt(k: np.ndarray, c: np.ndarray, segments: int) -> pa.RecordBatch:
    """segment, blob of sorted grams and their counts; a blob has the number of grams seen once, those, the others, their counts."""
    segment = segment_of(k, segments).astype(np.int64)
    order = np.lexsort((c > 1, segment))
    k, c, segment = k[order], c[order], segment[order]
    at = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1]))) if len(k) else np.zeros(0, np.int64)
    blobs = []
    for a, b in zip(at, np.append(at[1:], len(k)), strict=True):
        once = int((c[a:b] == 1).sum())
        blobs.append(np.int64(once).tobytes() + k[a:b].tobytes() + c[a + once : b].astype(np.int64).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(segment[at]), pa.array(blobs, pa.binary())], names=["segment", "blob"])


def _pair_blobs(texts: DataFrame, segments: int) -> DataFrame:
    """segment, blob: a task's pairs of one segment, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, size = [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                keys.append(pair_hashes(*tokens(data, offsets)))
                size += len(keys[-1])
                if size > FLUSH:
                    yield _dealt(*np.unique(np.concatenate(keys), return_counts=True), segments)
                    keys, size = [], 0
        if size:
            yield _dealt(*np.unique(np.concatenate(keys), return_counts=True), segments)

    return texts.transform(arrow_map, run, "segment long, blob binary")


def _gram_blobs(grams: DataFrame, segments: int) -> DataFrame:
    """The same of counted grams: gram, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy().view(np.uint64))
            counts.append(batch.column(1).to_numpy())
            size += len(keys[-1])
            if size > FLUSH:
                yield _dealt(np.concatenate(keys), np.concatenate(counts), segments)
                keys, counts, size = [], [], 0
        if size:
            yield _dealt(np.concatenate(keys), np.concatenate(counts), segments)

    return grams.transform(arrow_map, run, "segment long, blob binary")


def level(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(np.float64))[1].astype(np.int64)  # 1 + floor(log2 c)


def count_of(q: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    return np.where(q > 0, (2.0 ** np.maximum(q - 1, 0) + 2.0**q - 1) / 2, 0.0)


def key_hashes(grams: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the key (gram, q); its probes are the first plus multiples of the second."""
    h = mix(grams + U(q * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return h >> U(32), (h & U(0xFFFFFFFF)) | U(1)


def bit_places(first: np.ndarray, step: np.ndarray, probe: int, size) -> np.ndarray:
    """The bit, of a segment of size bits, of one probe."""
    return (((first + U(probe) * step) & U(0xFFFFFFFF)) * size) >> U(32)


def filled_segment(grams: np.ndarray, counts: np.ndarray, bits_a_key: int = BITS) -> np.ndarray:
    """Bytes of the segment that holds these grams."""
    q = level(counts)
    size = max(64, -(-int(q.sum()) * bits_a_key // 8) * 8)
    bits = np.zeros(size, bool)
    for j in range(1, int(q.max(initial=0)) + 1):
        hashes = key_hashes(grams[q >= j], j)
        for probe in range(PROBES):
            bits[bit_places(*hashes, probe, U(size))] = True
    return np.packbits(bits, bitorder="little")


@dataclass(frozen=True)
class LogFrequencyFilter:
    bits: np.ndarray  # bytes of the segments, one after the other
    start: np.ndarray  # byte at which each segment of this part begins, and the end
    segments: int  # of all parts
    first: int = 0  # segment of this part

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Level of each gram: probe 1, 2, ... until a key is missing."""
        out = np.zeros(len(grams), np.int64)
        own = (segment_of(grams, self.segments) - U(self.first)).astype(np.int64)
        base = (self.start[own] * 8).astype(np.uint64)
        size = (np.diff(self.start)[own] * 8).astype(np.uint64)
        live = np.flatnonzero(size)
        for q in range(1, 63):
            if not len(live):
                break
            first, step = key_hashes(grams[live], q)
            b, n = base[live], size[live]
            for probe in range(PROBES):
                at = b + bit_places(first, step, probe, n)
                hit = (self.bits[at >> U(3)] >> (at & U(7)).astype(np.uint8)) & 1 > 0
                if not hit.all():
                    live, first, step, b, n = live[hit], first[hit], step[hit], b[hit], n[hit]
            out[live] = q
        return out


def filter_segments(blobs: DataFrame, partitions: int) -> DataFrame:
    """segment, bits, grams, again (occurrences of its grams but their first): one row for each segment that has a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, keys, counts = None, [], []

        def ended() -> Iterator[pa.RecordBatch]:
            if keys:
                k, c = _merged(keys, counts)
                columns = [pa.array([segment], pa.int64()), pa.array([filled_segment(k, c, BITS).tobytes()], pa.binary()), pa.array([len(k)], pa.int64()), pa.array([int(c.sum()) - len(c)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "bits", "grams", "again"])

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != segment:
                    yield from ended()
                    segment, keys, counts = s, [], []
                raw = blob.as_buffer().to_pybytes()
                once = int(np.frombuffer(raw, np.int64, 1)[0])
                n = once + (len(raw) - 8 - 8 * once) // 16
                keys.append(np.frombuffer(raw, np.uint64, n, 8))
                counts.append(np.concatenate((np.ones(once, np.int64), np.frombuffer(raw, np.int64, n - once, 8 + 8 * n))))
        yield from ended()

    return blobs.repartition(partitions, "segment").sortWithinPartitions("segment").transform(arrow_map, run, "segment long, bits binary, grams long, again long")


def broadcast_parts(made: DataFrame, segments: int) -> list[Broadcast]:
    """The filter of stored segments in parts; only one part at a time lies in the driver's memory."""
    size = np.zeros(segments, np.int64)
    for r in made.select("segment", F.octet_length("bits").alias("n")).collect():  # of a filter of at most MOST_BROADCAST bytes
        size[r["segment"]] = r["n"]
    parts, first = [], 0
    while first < segments:
        end = max(first + 1, int(np.searchsorted(np.cumsum(size[first:]), MOST_BYTES, "right")) + first)
        start = np.concatenate(([0], np.cumsum(size[first:end])))
        bits = np.zeros(start[-1], np.uint8)
        for r in made.where(F.col("segment").between(first, end - 1)).select("segment", "bits").toLocalIterator():
            k = r["segment"] - first
            bits[start[k] : start[k + 1]] = np.frombuffer(r["bits"], np.uint8)
        parts.append((end, made.sparkSession.sparkContext.broadcast(LogFrequencyFilter(bits, start, segments, first))))
        first = end
    return parts


def levels_by_parts(parts: list[tuple[int, Broadcast]], grams: np.ndarray, segments: int) -> np.ndarray:
    """Levels of sorted grams from a filter in broadcast parts, each with its end segment; a worker holds one at a time."""
    if len(parts) == 1:
        return parts[0][1].value.levels(grams)
    out = np.empty(len(grams), np.int64)
    cut = np.concatenate(([0], np.searchsorted(segment_of(grams, segments).astype(np.int64), [end for end, _ in parts], "left")))
    for (_, part), a, b in zip(parts, cut[:-1], cut[1:], strict=True):
        if b > a:
            out[a:b] = part.value.levels(grams[a:b])
            if getattr(part, "_path", None):  # read again from its file when next asked for
                vars(part).pop("_value", None)
    return out


def probed(made: DataFrame, asked: DataFrame, segments: int, partitions: int) -> DataFrame:
    """chunk, segment, levels (a byte a gram) of the grams asked for: chunk, segment, blob.  Grams come to the segments, which never move together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, own = -1, None
        for batch in batches:
            chunks, out = [], []
            for c, s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = np.frombuffer(blob.as_buffer().to_pybytes(), np.uint8)
                if c < 0:
                    segment, own = s, LogFrequencyFilter(raw, np.array([0, len(raw)]), segments, s)
                    continue
                grams = raw.view(np.uint64)
                found = own.levels(grams) if s == segment else np.zeros(len(grams), np.int64)
                chunks.append((c, s))
                out.append(found.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in chunks], pa.int64()), pa.array([s for _, s in chunks], pa.int64()), pa.array(out, pa.binary())], names=["chunk", "segment", "levels"])

    rows = made.select(F.lit(-1).cast("long").alias("chunk"), "segment", F.col("bits").alias("blob")).unionAll(asked.select("chunk", "segment", "blob"))
    return rows.repartition(partitions, "segment").sortWithinPartitions("segment", "chunk").transform(arrow_map, run, "chunk long, segment long, levels binary")


@dataclass(frozen=True)
class Chunk:
    """Texts that are scored together: their distinct words and pairs, sorted, and which of them stands at each token."""

    bounds: np.ndarray
    words: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray

    @staticmethod
    def of(tokens: list[np.ndarray], bounds: list[np.ndarray]) -> Chunk:
        t = np.concatenate(tokens)
        first = np.concatenate(([0], np.cumsum([len(x) for x in tokens])))
        ends = np.concatenate([[0], *(b[1:] + a for a, b in zip(first[:-1], bounds, strict=True))]).astype(np.int64)
        return Chunk(ends, *np.unique(t, return_inverse=True), *np.unique(pair_hashes(t, ends), return_inverse=True))

    def grams(self) -> np.ndarray:
        return np.unique(np.concatenate([self.words, self.pairs]))


@dataclass(frozen=True)
class LanguageScores:
    total: int
    distinct: int
    weight: float  # of the pair estimate against the single one
    hot: np.ndarray  # sorted word hashes
    hot_n: np.ndarray
    hot_least: int

    def base_log(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + ADD) / (self.total + ADD * (self.distinct + 1)))

    def score(self, chunk: Chunk, levels: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """log10 probability of each text: pair and word estimates, weighted.  levels: of sorted grams."""
        of_words = count_of(levels(chunk.words))
        c, both = of_words[chunk.word], count_of(levels(chunk.pairs))[chunk.pair]
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[chunk.bounds[:-1]] = of_words[np.searchsorted(chunk.words, END)]
        alone = (c + ADD) / (self.total + ADD * (self.distinct + 1))
        joint = np.minimum(both, before) / np.maximum(before, 1)
        p = np.where(before > 0, self.weight * joint + (1 - self.weight) * alone, alone)
        return np.add.reduceat(np.log10(p), chunk.bounds[:-1])


def _chunk_scores(model: Broadcast, heads: DataFrame, answers: DataFrame, partitions: int) -> DataFrame:
    """key, score.  heads: chunk, segment (-1), place, blob of tokens; answers: chunk, segment, levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, levels = None, [], []

        def ended() -> Iterator[pa.RecordBatch]:
            if held:
                own, known = Chunk.of([t for _, t, _ in held], [b for _, _, b in held]), np.concatenate(levels).astype(np.int64)
                grams = own.grams()
                score = model.value.score(own, lambda g: known[np.searchsorted(grams, g)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([k for k, _, _ in held])), pa.array(score)], names=["key", "score"])

        for batch in batches:
            for c, s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if c != chunk:
                    yield from ended()
                    chunk, held, levels = c, [], []
                raw = blob.as_buffer().to_pybytes()
                if s >= 0:
                    levels.append(np.frombuffer(raw, np.uint8))
                    continue
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                held.append((np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint64, -1, 8 * (2 * n + 2)), np.frombuffer(raw, np.int64, n + 1, 8 * (n + 1))))
        yield from ended()

    rows = heads.select("chunk", "segment", "place", "blob").unionAll(answers.select("chunk", "segment", F.lit(0).cast("long"), "levels"))
    return rows.repartition(partitions, "chunk").sortWithinPartitions("chunk", "segment", "place").transform(arrow_map, run, "key long, score double")


def language_scores(df: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int | None = None) -> DataFrame:
    """One row per row of df: id, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty: one token, the end.  Without training rows every token is unknown, N is 0 and V is 0.
    Repeated rows are counted and scored each; very long texts are read whole; ids, null ones too, only pass through, and
    no other column is read, whatever its name.  No rows give no rows.
    """
    spark = df.sparkSession
    texts = training.select(F.col(text_col).alias("text"))
    counts = stored(_word_counts(texts), "lm-words")
    log2 = "length(bin(n))"  # the level
    words_by = {r["q"]: r for r in counts.groupBy(F.expr(log2).alias("q")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()}
    total, distinct = sum(r["n"] for r in words_by.values()), sum(r["k"] for r in words_by.values())
    segments = segments or max(32, -(-total // SEGMENT_TOKENS))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_TOKENS))
    blobs = _pair_blobs(texts, segments).unionAll(_gram_blobs(counts, segments))
    made = stored(filter_segments(blobs, partitions), "lm-segments")
    size, again = made.agg(F.sum(F.octet_length("bits")), F.sum("again")).first()
    weight = min(0.9, max(0.0, ((again or 0) - (total - distinct)) / max(1, total)))  # words are among the grams
    parts = broadcast_parts(made, segments) if (size or 0) <= MOST_BROADCAST else None

    hot_least, room = 1 << 62, HOT_WORDS
    for q in sorted(words_by, reverse=True):
        room -= words_by[q]["k"]
        if room < 0:
            break
        hot_least = 1 << (q - 1)
    hot = counts.where(F.col("n") >= hot_least).toArrow()  # at most HOT_WORDS rows
    hot_words, hot_n = hot["word"].to_numpy().view(np.uint64), hot["n"].to_numpy()
    order = np.argsort(hot_words)
    shared = spark.sparkContext.broadcast(LanguageScores(int(total), int(distinct), weight, hot_words[order], hot_n[order], hot_least))

    kind = df.schema[id_col].dataType
    schema = f"key long, id {kind.simpleString()}, n_tokens long, known long, base double, score double, word long, times long, chunk long, segment long, place long, blob binary"
    fields = [x.strip().split()[0] for x in schema.split(", ")]
    plain = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}

    def made_rows(n: int, id_type: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {f.split()[0]: plain.get(f.split()[1]) for f in schema.split(", ")}
        return pa.RecordBatch.from_arrays([columns.get(f) if f in columns else pa.nulls(n, id_type if f == "id" else kinds[f]) for f in fields], names=fields)

    def scored_slices(held: list[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        m, together = shared.value, Chunk.of([t for *_, t, _ in held], [b for *_, b in held])
        own, ids = np.concatenate([k for k, *_ in held]), pa.concat_arrays([i for _, i, *_ in held])
        if parts is None:
            chunk = int(own[0])
            for place, (keys, _, t, bounds) in enumerate(held):
                blob = np.int64(len(keys)).tobytes() + keys.astype(np.int64).tobytes() + bounds.astype(np.int64).tobytes() + t.tobytes()
                yield made_rows(1, ids.type, chunk=pa.array([chunk]), segment=pa.array([-1], pa.int64()), place=pa.array([place], pa.int64()), blob=pa.array([blob], pa.binary()))
            grams = together.grams()
            segment = segment_of(grams, segments).astype(np.int64)
            at = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            n = len(at)
            asked = pa.array([grams[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(grams)), strict=True)], pa.binary())
            yield made_rows(n, ids.type, chunk=pa.array(np.full(n, chunk)), segment=pa.array(segment[at]), place=pa.array(np.zeros(n, np.int64)), blob=asked)
        words, word, bounds = together.words, together.word, together.bounds
        at = np.minimum(np.searchsorted(m.hot, words), max(0, len(m.hot) - 1))
        found = m.hot[at] == words if len(m.hot) else np.zeros(len(words), bool)
        c = m.hot_n[at] if len(m.hot) else np.zeros(len(words))
        base = np.add.reduceat(np.where(found, m.base_log(np.where(found, c, 0)), 0.0)[word], bounds[:-1])
        there = found[word]
        known = np.add.reduceat(there.astype(np.int64), bounds[:-1])
        score = {} if parts is None else {"score": pa.array(m.score(together, lambda g: levels_by_parts(parts, g, segments)))}
        yield made_rows(len(own), ids.type, key=pa.array(own), id=ids, n_tokens=pa.array(np.diff(bounds)), known=pa.array(known), base=pa.array(base), **score)
        rest = np.flatnonzero(~there)
        if len(rest):
            # a text's words of one kind are one row
            text = np.searchsorted(bounds, rest, "right") - 1
            kind, times = np.unique(text * len(words) + word[rest], return_counts=True)
            yield made_rows(len(kind), ids.type, key=pa.array(own[kind // len(words)]), word=pa.array(signed(words[kind % len(words)])), times=pa.array(times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 34
        held, size = [], 0
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                t, bounds = tokens(data, offsets)
                n = end - first
                held.append((key + np.arange(n), batch.column(0).slice(first, n), t, bounds))
                key += n
                size += len(t)
                if size > HELD:
                    yield from scored_slices(held)
                    held, size = [], 0
        if held:
            yield from scored_slices(held)

    scored = stored(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(arrow_map, run, schema), "lm-scored")
    bottom = float(total + ADD * (distinct + 1))
    rare = scored.where("word is not null").select("key", "word", "times").join(counts.where(F.col("n") < hot_least), "word", "left")
    rare = rare.groupBy("key").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + ADD) / bottom)).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    rows = scored.where("n_tokens is not null").select("key", "id", "n_tokens", "known", "base", "score")
    if parts is None:
        answers = probed(made, scored.where("segment >= 0"), segments, partitions)
        rows = rows.drop("score").join(_chunk_scores(shared, scored.where("segment = -1"), answers, partitions), "key")
    out = rows.join(rare, "key", "left")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(total)).alias("train_tokens").cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
