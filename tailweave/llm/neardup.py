"""Near duplicates by min-max hashing: each permutation gives a minimum and a maximum, so half the hash evaluations.

1. Whole texts become sets of five-word shingles (64-bit hashes).  Equal sets form a class, and only one
   text of a class goes on, so thousands of exact copies cost one.
2. PERMUTATIONS permutations give twice as many signature values, cut into BANDS bands of ROWS values.  Classes
   that share a band value are candidates: each is tied to the least class of that value.
3. Connected candidates form a cluster.  Its texts, and only theirs, meet in tasks of at most BLOCK texts and
   BLOCK_SHINGLES shingles for each of two blocks, where links are confirmed on the full sets; pairs that are
   already connected are passed over.  Larger clusters are cut into blocks: first each block meets a hub block,
   then, only if a cluster is not yet of one piece, all pairs of blocks.  No task ever holds a whole large group
   and no table holds all its pairs.

Two sets with Jaccard similarity 0.85 share no band with probability (1 - 0.85 ** ROWS) ** BANDS, about 1 in 90,000.
Lower thresholds get more bands, so that this holds for them too.
Equal 64-bit hashes of different sets join two classes wrongly: at 3e10 documents about two dozen pairs are expected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard
from .common import marked_ids, stored, unused, without_ids
from .components import connected_components
from .textarrays import arrow_map, mix, shingle_sets, signed, slices, U

WIDTH, BANDS, ROWS = 5, 24, 6
PERMUTATIONS = BANDS * ROWS // 2
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
BLOCK, BLOCK_SHINGLES = 128, 250_000
#: Pairs in crowded blocks are confirmed on full sets if their signatures agree in this share (5 deviations below PERCENT).
LIKELY = 0.70

_rng = np.random.Generator(np.random.PCG64(5))
_FLIP = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_TIMES = (_rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) << U(1)) | U(1)
_ROUND = (_rng.integers(0, 2**63, ROWS, dtype=np.uint64) << U(1)) | U(1)


def bands_for(percent: int) -> int:
    """Bands that miss a pair of that similarity as seldom as BANDS miss one of PERCENT."""
    return max(BANDS, math.ceil(BANDS * math.log1p(-((PERCENT / 100) ** ROWS)) / math.log1p(-((percent / 100) ** ROWS)))) if 0 < percent < PERCENT else BANDS


def min_max_signatures(values: np.ndarray, bounds: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(sets, 2 * permutations): all minima, then all maxima, of sets that aren't empty."""
    flip, times = _FLIP, _TIMES
    if permutations > PERMUTATIONS:
        more = np.random.Generator(np.random.PCG64(6)).integers(0, 2**63, (permutations - PERMUTATIONS, 2), dtype=np.uint64)
        flip, times = np.append(flip, more[:, 0]), np.append(times, (more[:, 1] << U(1)) | U(1))
    out = np.empty((2 * permutations, len(bounds) - 1), np.uint64)
    for k in range(permutations):
        x = (values ^ flip[k]) * times[k]
        np.minimum.reduceat(x, bounds[:-1], out=out[k])
        np.maximum.reduceat(x, bounds[:-1], out=out[permutations + k])
    return out.T


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(sets, bands): each band has ROWS minima or ROWS maxima of different permutations."""
    grid = signatures.reshape(len(signatures), -1, ROWS)
    keys = np.zeros(grid.shape[:2], np.uint64)
    for k in range(ROWS):
        keys = mix((keys ^ grid[:, :, k]) * _ROUND[k])
    return keys + np.arange(grid.shape[1], dtype=np.uint64) * U(0x9E3779B97F4A7C15)


def class_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits for each set (not empty) that do not depend on order."""
    return mix(np.add.reduceat(mix(values), bounds[:-1]) + np.diff(bounds).astype(np.uint64) * U(0xD1342543DE82EF95))


def _filled(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    full = np.flatnonzero(np.diff(bounds))
    return full, np.concatenate((bounds[:-1][full], bounds[-1:]))


def _signed_rows(df: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """id, text, row: id, row, n_shingles, class (null for empty sets), bands (only on the first row of a class in its slice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                values, bounds = shingle_sets(data, offsets, WIDTH)
                full, own = _filled(bounds)
                kind, bands = np.zeros(end - first, np.uint64), np.zeros(0, np.uint64)
                at = np.zeros(end - first + 1, np.int32)
                if len(full):
                    kind[full] = class_hashes(values, own)
                    _, lead = np.unique(kind[full], return_index=True)
                    lead.sort()
                    parts = [values[own[k] : own[k + 1]] for k in lead]
                    bands = band_keys(min_max_signatures(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), n_bands * ROWS // 2)).ravel()
                    at[1 + full[lead]] = n_bands
                empty = np.ones(end - first, bool)
                empty[full] = False
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(np.diff(bounds)), pa.array(signed(kind), mask=empty), pa.ListArray.from_arrays(pa.array(np.cumsum(at, dtype=np.int32)), pa.array(signed(bands)))],
                    names=["id", "row", "n_shingles", "class", "bands"],
                )

    kind = df.schema["id"].dataType.simpleString()
    return df.transform(arrow_map, run, f"id {kind}, row long, n_shingles long, class long, bands array<long>")


class _Sets:
    """Union-find over one task's texts, and its links."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], roots: list[int] | None = None):
        self.rows, self.up = rows, list(range(len(rows)))
        self.links: list[tuple[int, int]] = []
        if roots is not None:
            seen: dict[int, int] = {}
            for k, r in enumerate(roots):
                self.join(k, seen.setdefault(r, k), False)

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int, link: bool = True) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            if link:
                self.links.append((a, b))

    def check(self, a: int, b: int, percent: int) -> None:
        if self.find(a) == self.find(b):
            return
        x, y = self.rows[a][2], self.rows[b][2]
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        common = int((y[at] == x).sum())
        if 100 * common >= percent * (len(x) + len(y) - common):
            self.join(a, b)

    def all_pairs(self, percent: int, across: bool) -> None:
        """Confirm every pair (across: only pairs of different sides) that may reach percent and isn't connected yet."""
        n, side = len(self.rows), np.array([r[1] for r in self.rows])
        if n <= 8:
            for b in range(n):
                for a in range(b):
                    if not across or side[a] != side[b]:
                        self.check(a, b, percent)
            return
        sizes = np.array([len(r[2]) for r in self.rows])
        signature = min_max_signatures(np.concatenate([r[2] for r in self.rows]), np.concatenate(([0], np.cumsum(sizes))))
        signature = (signature >> U(48)).astype(np.uint16)
        for b in range(1, n):
            fit = (signature[:b] == signature[b]).mean(axis=1)
            ok = (fit >= LIKELY - (0.85 - percent / 100)) & (100 * np.minimum(sizes[:b], sizes[b]) >= percent * np.maximum(sizes[:b], sizes[b]))
            if across:
                ok &= side[:b] != side[b]
            for a in np.flatnonzero(ok)[np.argsort(-fit[ok], kind="stable")]:
                self.check(int(a), b, percent)


def _linked(members: DataFrame, percent: int, across: bool) -> DataFrame:
    """members: task, class, side, root, text; rows of a task lie together.  Gives the links a, b that connect what is connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, roots = None, [], []

        def ended() -> pa.RecordBatch | None:
            if len(rows) < 2:
                return None
            own = _Sets(rows, roots)
            own.all_pairs(percent, across)
            a, b = (np.array([rows[x[k]][0] for x in own.links], np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            tasks, kinds, sides, before = (batch.column(c).to_pylist() for c in ("task", "class", "side", "root"))
            for first, _, data, offsets in slices(batch.column("text")):
                values, bounds = shingle_sets(data, offsets, WIDTH)
                full, own = _filled(bounds)
                actual = dict(zip(full, signed(class_hashes(values, own)), strict=True)) if len(full) else {}
                for d in range(len(offsets) - 1):
                    k = first + d
                    if tasks[k] != task:
                        if (out := ended()) is not None:
                            yield out
                        task, rows, roots, have = tasks[k], [], [], set()
                    if actual.get(d) == kinds[k] and kinds[k] not in have:  # an id may stand for several texts
                        have.add(kinds[k])
                        rows.append((kinds[k], sides[k], values[bounds[d] : bounds[d + 1]].copy()))
                        roots.append(before[k])
        if (out := ended()) is not None:
            yield out

    return members.transform(arrow_map, run, "a long, b long")


def _row_key(id_, text):
    """64 bits of a row's text and id: what texts are fetched and dropped by, so neither null nor repeated ids matter."""
    return F.xxhash64(F.coalesce(text, F.lit("")), id_)


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs: id, text.  (rows: id, row, n_shingles, class; classes: class, id, row, root), both stored.

    id of a class: its least one, null if it has none; row: the first of its rows by id (null last), then by row key.
    Classes with one root are linked.
    """
    docs = docs.withColumn("row", _row_key(F.col("id"), F.col("text")))
    rows = stored(_signed_rows(docs, bands_for(percent)), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    classes = rows.where("class is not null").groupBy("class").agg(first, F.max("n_shingles").alias("n"))
    classes = stored(classes.select("class", "first.id", "first.row", "n"), "classes")
    keys = rows.where("size(bands) > 0").select("class", F.explode("bands").alias("key")).distinct()
    keys = stored(keys, "keys")
    leads = keys.groupBy("key").agg(F.min("class").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    clusters = connected_components(keys.join(leads, "key").where("class <> lead").select(F.col("class").alias("a"), F.col("lead").alias("b")).distinct())
    members = clusters.select(F.col("node").alias("class"), F.col("root").alias("cluster")).join(classes, "class")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    members = stored(members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks"))), "members")
    # only texts that may be members move, one of each row key
    texts = marked_ids(docs, members.select(F.col("row").alias("id")), members.count(), "row").where("__may").groupBy("row").agg(F.first("text").alias("text"))

    def met(who: DataFrame, tasks, across: bool) -> DataFrame:
        dealt = who.withColumn("task", F.explode(tasks)).withColumn("task", F.xxhash64("cluster", "task")).join(texts, "row")
        own = dealt.select("task", "class", F.col("block").alias("side"), "root", "text").repartition("task").sortWithinPartitions("task")
        return _linked(own, percent, across)

    alone = members.withColumn("root", F.col("class"))
    # each block meets block 0, which goes to every task of its cluster
    hub = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).when(F.col("block") > 0, F.array(F.col("block"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1))
    links = stored(met(alone, hub, False), "links")
    roots = connected_components(links)
    if members.where("blocks > 2").limit(1).count():
        known = members.where("blocks > 2").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        apart = known.groupBy("cluster").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("cluster")
        known = stored(known.join(apart, "cluster", "left_semi").where("block > 0"), "apart")
        # blocks i < j meet in task i * blocks + j
        pairs = F.transform(F.filter(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("block")), lambda j: F.least(j, F.col("block")) * F.col("blocks") + F.greatest(j, F.col("block")))
        more = stored(met(known, pairs, True), "more-links")
        if more.limit(1).count():
            roots = connected_components(links.unionAll(more))
    own = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    own = stored(own.drop("n"), "roots")
    for done in (keys, classes, members, links):
        discard(done)
    return rows.drop("bands"), own


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (least id reachable by links), kept (id = component_id).

    Texts that are null or have no word have no shingles, link with nothing and are kept; very long ones are read whole.
    Rows without id link like all others; a component of them alone has a null component_id, and kept is true there.
    Repeated rows each get their row, and different texts under one id are linked each by itself.  An empty table
    gives no rows; other columns are not read, whatever their names.
    """
    rows, classes = _classes(_named(df, id_col, text_col), percent)
    named = classes.join(classes.groupBy("root").agg(F.min("id").alias("component")), "root").select("class", "component")
    out = rows.join(named, "class", "left")
    out = out.withColumn("component_id", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs with one row left of each group linked at a similarity of percent: that of the least id (null last), then row key.

    Different texts under one id stay unless they are linked; rows without words are linked with nothing and stay.  Of rows
    that repeat id and text one stays, the first by a hash of all columns.  All columns stay, whatever their names.
    """
    rows, classes = _classes(_named(docs, id_col, text_col), percent)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    stays = classes.groupBy("root").agg(first).select("root", F.col("first.row").alias("stays"))
    judged = rows.where("class is not null").select("class", "row").join(classes.join(stays, "root").select("class", "stays"), "class")
    judged = stored(judged.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("row") == F.col("stays")).alias("kept")), "judged")
    key, may, h, least = unused(docs, "__row", "__may", "__hash", "__least")
    keyed = docs.withColumn(key, _row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    out = without_ids(keyed, judged.where("not kept").select(F.col("row").alias("id")), key)
    again = judged.where("kept and n > 1").select(F.col("row").alias("id"))
    n = again.count()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not n:
        return out.select(*columns)
    marked = marked_ids(out, again, n, key, may)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    twice = marked.where(F.col(may)).withColumn(h, F.xxhash64(*hashed)).join(again.select(F.col("id").alias(key)), key, "left_semi")
    one = twice.join(twice.groupBy(key).agg(F.min(h).alias(least)), key).where(F.col(h) == F.col(least)).dropDuplicates([key])
    once = marked.where(F.col(may)).join(again.select(F.col("id").alias(key)), key, "left_anti")
    return marked.where(~F.col(may)).select(*columns).unionAll(once.select(*columns)).unionAll(one.select(*columns))
