"""Alignment of two tokenizers' tokens over the same text.

Texts are cut where neither tokenizer can join what stands on both sides (before a blank or newline after a character that is no white
space; the vocabularies are checked for it), so each distinct piece of a block of texts is encoded and aligned once, relationally:
posexplode of its tokens with the place where each begins (the end of the one before), both sides matched on piece and place, the places that both
have as the groups' beginnings, and the tokens that run through each stretch between two places as links.  Blocks are the buckets of one stored table,
so no token and no text is ever shuffled.

A row of that table holds a shelf of pieces, its tokens in the order of the equi-join's keys (piece, place, side).  Two tokens that match are then
neighbours, and become one row as they are exploded; only those rows are sorted, for the windows that tell which tokens run through them.  A
join would have to be a full one, whose result has no partitioning in Spark, and all tokens would be shuffled again.  Each piece begins with tokens of both sides.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, remove, shared_folder
from .common import stored
from .textarrays import arrow_map, text_array
from .tokencount import PATTERN, byte_letters, check_definition

#: Fixed: characters with the White_Space property.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_OTHER = r"\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces begin at a blank or newline that follows something else than white space.
PIECES = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+(?:[{_OTHER}][{_SPACE}]*[^{_SPACE}]+)*(?:[{_OTHER}][{_SPACE}]*)?|[{_SPACE}]+")
#: The same where blanks and newlines are all the white space there is.
PLAIN, RARE = re.compile(r"[ \n]*[^ \n]+|[ \n]+"), re.compile(rf"[{_OTHER}]")
RUNS = re.compile(r"[ \n][ \n]")
#: Pieces that can be encoded in a row and cut at their blanks.
ALONE = re.compile(r" [^ ]*[^ \s]")
#: Characters of text in a block, about; one long text is a block of its own.
BLOCK = 6 << 20
#: Pieces encoded together, pieces of one string, pieces of a stored row and a window (readers hold 4,096 such rows).
TOGETHER, RUN, SHELF = 4096, 64, 64
#: Texts times links of a block that are looked at together; eighths of it are pieces.
ROOM = 1 << 20


def pieces_of(text: str) -> list[str]:
    """The pieces of a blank and the text."""
    return (PIECES if RARE.search(text) else PLAIN).findall(" " + text)


def words_of(text: str) -> list:
    """The pieces as keys that are quick to make: without the blank they begin with; those that begin with a newline as they are; a blank before a newline as a tuple."""
    if RUNS.search(text) or RARE.search(text) or text[0] in " \n":
        return [p if p[0] != " " else (p,) if p[1:2] == "\n" else p[1:] for p in pieces_of(text)]
    return text.replace("\n", " \n").split(" ")


def piece_of(word) -> str:
    return word[0] if isinstance(word, tuple) else word if word[:1] == "\n" else " " + word


class Sides:
    """Both tokenizers of a worker.  The byte-level one goes by the ranks of its vocabulary, which ``check`` holds against the library."""

    def __init__(self, byte_definition: str, piece_model: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = byte_letters()
        own = {k: bytes(letters[c] for c in t) for t, k in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        self.a_bytes = {k: own.get(k) or (self.a.id_to_token(k) or "").encode() for k in range(self.a.get_vocab_size())}
        self.a_bytes = [self.a_bytes[k] for k in range(len(self.a_bytes))]
        import tiktoken

        ranks = {t: k for k, t in enumerate(self.a_bytes) if k in own}
        self.encode_bytes = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.a_lengths = np.array(list(map(len, self.a_bytes)))
        self.b_bytes = [self._piece(k) for k in range(self.b.vocab_size())]
        self.b_lengths = np.array(list(map(len, self.b_bytes)))
        self.buffers = [np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes)]
        self.blank = self.b.piece_to_id("▁")

    def _piece(self, k: int) -> bytes:
        if self.b.is_byte(k):
            return bytes([int(self.b.id_to_piece(k)[1:-1], 16)])
        return self.b.id_to_piece(k).replace("▁", " ").encode()

    def check(self) -> None:
        """Fails if a piece of the second vocabulary runs over a place where texts are cut, if a lone blank is no piece, or if the ranks don't give the first library's ids."""
        texts = [t for t in (x.decode(errors="ignore") for x in self.a_bytes) if t]
        if [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)] != list(map(self.encode_bytes, texts)):
            raise ValueError("the byte-level vocabulary's order is not that of its merges")
        across = [p for k in range(self.b.vocab_size()) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k)) for p in [self.b.id_to_piece(k)] if re.search("[^▁]▁|\n", p)]
        if across or self.b.is_unknown(self.blank):
            raise ValueError("the piece vocabulary joins what stands on both sides of a blank or newline")

    def encoded(self, pieces: list[str]) -> tuple[list[list[int] | None], list[list[int] | None]]:
        """The ids of both sides for each piece; None where their bytes are not the piece."""
        first = list(map(self.encode_bytes, pieces))
        # the library adds the blank itself; before a newline it is taken off again
        second = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        out, u, v = ([], []), self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for piece, x, y in zip(pieces, first, second, strict=True):
            if piece[0] != " ":
                y = y[1:] if y[:1] == [self.blank] else []
            elif piece == " ":
                y = [self.blank]
            raw = piece.encode()
            whole = b"".join(map(v, y)) == raw and b"".join(map(u, x)) == raw
            out[0].append(x if whole else None)
            out[1].append(y if whole else None)
        return out

    def spelled(self, raw: list[bytes], found: tuple[list[list[int]], list[list[int]]]) -> np.ndarray:
        """Whether both sides' ids spell each of the strings."""
        sizes, good = np.array(list(map(len, raw)), np.int64), np.ones(len(raw), bool)
        want, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes)
        for side, buffer, own in zip(found, self.buffers, (self.a_lengths, self.b_lengths), strict=True):
            ids = np.fromiter(itertools.chain.from_iterable(side), np.int64)
            run = np.concatenate(([0], np.cumsum(own[ids])))
            at = run[np.cumsum([0, *map(len, side)])]
            if np.array_equal(at[1:], ends):  # as nearly always: all at once
                spelled = buffer[np.repeat((np.cumsum(own) - own)[ids] - run[:-1], own[ids]) + np.arange(run[-1])]
                wrong = np.flatnonzero(spelled != want)
                good[np.searchsorted(ends, wrong, side="right")] = False
            else:
                parts = self.a_bytes if own is self.a_lengths else self.b_bytes
                good &= [b"".join(map(parts.__getitem__, x)) == r for x, r in zip(side, raw, strict=True)]
        return good

    def flat(self, pieces: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Which pieces both sides spell, and for each side the number of its ids in each piece and all ids in a row.

        Pieces of a blank and then no white space are encoded RUN at a time as one text, which is then cut at its blanks; the others, and all of a text that a side does
        not spell, go one by one.
        """
        plain = [k for k, p in enumerate(pieces) if ALONE.fullmatch(p)]
        runs = [plain[k : k + RUN] for k in range(0, len(plain), RUN)]
        texts = ["".join([pieces[k] for k in run]) for run in runs]
        found = list(map(self.encode_bytes, texts)), self.b.encode([t[1:] for t in texts], num_threads=1)
        raw = [t.encode() for t in texts]
        good = np.flatnonzero(self.spelled(raw, found))
        if len(good) < len(runs):
            runs, raw, found = [runs[r] for r in good], [raw[r] for r in good], [[side[r] for r in good] for side in found]
        fast = np.fromiter(itertools.chain.from_iterable(runs), np.int64)
        starts = np.flatnonzero(np.frombuffer(b"".join(raw), np.uint8) == 32)
        ids = [np.fromiter(itertools.chain.from_iterable(side), np.int32) for side in found]
        firsts = []
        for own, length in zip(ids, (self.a_lengths, self.b_lengths), strict=True):
            begins = np.cumsum(length[own]) - length[own]
            firsts.append(np.searchsorted(begins, starts))
            if len(starts) != len(fast) or len(starts) and not np.array_equal(begins[firsts[-1]], starts):
                raise ValueError("a token runs over a place where texts are cut")
        slow = np.setdiff1d(np.arange(len(pieces)), fast)
        known, out = np.ones(len(pieces), bool), []
        rest = self.encoded([pieces[k] for k in slow]) if len(slow) else ([], [])
        for own, first, others in zip(ids, firsts, rest, strict=True):
            counts = np.zeros(len(pieces), np.int64)
            counts[fast] = np.diff(first, append=len(own))
            counts[slow] = [len(x or ()) for x in others]
            is_fast = np.zeros(len(pieces), bool)
            is_fast[fast] = True
            every, where = np.empty(counts.sum(), np.int32), np.repeat(is_fast, counts)
            every[where], every[~where] = own, [k for x in others for k in x or ()]
            out.append((counts, every))
        known[slow] = [x is not None for x in rest[0]]
        return known, out


@functools.lru_cache(2)
def _sides(key: str, shared) -> Sides:
    sides = Sides(*shared.value)
    del sides.a  # a worker goes by the ranks alone, and need not hold the library's tables too
    return sides


def by_place(at: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], lengths: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of pieces by piece and place: the ends of each piece's tokens, their ids, and twice the place where each begins, plus 1 on the second side.

    at: rising numbers of the pieces; sides: how many tokens each piece has, and all ids in a row.
    """
    keys = []
    for k, ((counts, ids), length) in enumerate(zip(sides, lengths, strict=True)):
        run, firsts = np.concatenate(([0], np.cumsum(length[ids]))), np.cumsum(counts) - counts
        keys.append(np.repeat(at.astype(np.int64) << 32, counts) + 2 * (run[:-1] - np.repeat(run[firsts], counts)) + k)
    to = [np.arange(len(own)) + np.searchsorted(other, own) for own, other in (keys, keys[::-1])]
    both, ids = np.empty(sum(map(len, keys)), np.int64), np.empty(sum(map(len, keys)), np.int32)
    for where, key, (_, own) in zip(to, keys, sides, strict=True):
        both[where], ids[where] = key, own
    ends = np.concatenate(([0], np.cumsum(sides[0][0] + sides[1][0])))
    return ends.astype(np.int32), ids, (both & 0xFFFFFFFF).astype(np.int32)


def shelves(sides: list[tuple[np.ndarray, np.ndarray]], lengths: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of pieces by shelf, piece and place: the ends of each shelf's tokens, their ids, and which of the shelf's pieces each is in, times 2^32, plus its place as ``by_place`` has it.

    Pieces are counted from the shelf's first, so that there are few different numbers to store.
    """
    n = len(sides[0][0])
    own = np.arange(n, dtype=np.int32)
    ends, ids, places = by_place(own, sides, lengths)
    return ends[[*range(0, n, SHELF), n]], ids, (np.repeat(own.astype(np.int64) % SHELF, np.diff(ends)) << 32) + places


def by_block(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df as a stored table whose buckets hold whole blocks, and what drops it: groups, windows and cogroups by block need no exchange."""
    spark, name = df.sparkSession, f"align_{uuid.uuid4().hex}"
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # most tasks hold one block or two
    path = f"{shared_folder(spark)}/tailweave/{name}"
    df.write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE {name}")
        remove(spark, path)

    return spark.table(name), drop


def _numbers() -> defaultdict:
    """Keys are numbered as they come."""
    found = defaultdict()
    found.default_factory = found.__len__
    return found


_CUT = "block long, row long, id {kind}, words array<int>, shelf int, ids array<int>, places array<long>"


def cut_texts(df: DataFrame, sides, key: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of texts (block, row, id, words: places in the block's dictionary, null without text), and of dictionaries (block, shelf, ids, places: the tokens of SHELF pieces as ``shelves`` has them).

    sides: a broadcast of both definitions.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, longs, numbers = _sides(key, sides), pa.int64(), pa.list_(pa.int32())
        block, row, seen, weight, id_type = TaskContext.get().partitionId() << 32, 0, _numbers(), 0, None
        names = ["block", "row", "id", "words", "shelf", "ids", "places"]

        def dictionary() -> Iterator[pa.RecordBatch]:
            left = iter(seen)
            for first in range(0, len(seen), TOGETHER):
                own = list(map(piece_of, itertools.islice(left, TOGETHER)))
                _, found = both.flat(own)  # pieces that a side does not spell have no tokens
                ends, *lists = shelves(found, (both.a_lengths, both.b_lengths))
                n = len(ends) - 1
                columns = [pa.array(np.full(n, block)), pa.nulls(n, longs), pa.nulls(n, id_type), pa.nulls(n, numbers), pa.array(np.arange(n, dtype=np.int32) + first // SHELF)]
                yield pa.RecordBatch.from_arrays(columns + [pa.ListArray.from_arrays(ends, x) for x in lists], names=names)

        for batch in batches:
            id_type, texts = batch.column(0).type, text_array(batch.column(1))
            first = 0
            while first < len(texts):
                words, end = [], first
                while end < len(texts) and weight < BLOCK:
                    text = texts[end].as_py()
                    weight += len(text)
                    words.append(list(map(seen.__getitem__, words_of(text))) if text else None)
                    end += 1
                n = end - first
                columns = [pa.array(np.full(n, block)), pa.array(np.arange(row, row + n)), batch.column(0).slice(first, n), pa.array(words, numbers), pa.nulls(n, pa.int32()), pa.nulls(n, numbers), pa.nulls(n, pa.list_(longs))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                row, first = row + n, end
                if weight >= BLOCK:
                    yield from dictionary()
                    block, seen, weight = block + 1, _numbers(), 0
        if seen:
            yield from dictionary()

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).transform(arrow_map, run, _CUT.format(kind=kind))


def _lengths(lengths: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, lengths))), ",").cast("array<int>")  # folded to one literal


def _places(ids: Column, lengths: list[int]) -> Column:
    """The bytes before each id."""
    return F.transform(ids, lambda _, k: F.aggregate(F.slice(ids, 1, k), F.lit(0), lambda n, x: n + F.element_at(_lengths(lengths), x + 1)))


def _shelved(tokens: DataFrame, lengths: dict[str, list[int]]) -> DataFrame:
    """(block, shelf, ids, places) as the stored table has them, of (block, at, a, b): a row for each piece."""
    a, b = (F.transform(_places(F.col(c), lengths[c]), lambda x: 2 * x) for c in "ab")
    places = F.transform(F.concat(a, F.transform(b, lambda x: x + 1)), lambda x: F.shiftleft((F.col("at") % SHELF).cast("long"), 32) + x)
    own = F.array_sort(F.arrays_zip(places.alias("place"), F.concat("a", "b").alias("id")))
    return tokens.select("block", F.expr(f"at div {SHELF}").cast("int").alias("shelf"), own.alias("own")).select("block", "shelf", F.col("own.id").alias("ids"), F.col("own.place").alias("places"))


def token_places(tokens: DataFrame, lengths: dict[str, list[int]]) -> DataFrame:
    """(block, shelf, place, a, b): each place of a piece where a token begins, and the tokens that begin there, or null.

    place: the piece, times 2^32, plus twice where it is in the piece, plus 1 if one of the second side begins there.
    tokens: block, shelf, ids, places, sorted by place; or block, at, a, b.  lengths: bytes of each id.  A token begins at the end of the one before, the first one at 0.
    """
    if "ids" not in tokens.columns:
        tokens = _shelved(tokens, lengths)
    rows = tokens.select("block", "shelf", "ids", "places", F.posexplode("ids").alias("k", "id"))
    rows = rows.select("block", "shelf", "id", *[F.get(c, F.col("k") + by).alias(name) for c, by, name in (("places", 0, "place"), ("places", -1, "before"), ("places", 1, "after"), ("ids", -1, "other"))])
    second = F.col("place").bitwiseAND(1) == 1
    # two tokens at one place: the second side's row has both
    rows = rows.where(second | F.col("after").isNull() | (F.col("after") != F.col("place") + 1))
    a = F.when(~second, F.col("id")).when(F.col("before") == F.col("place") - 1, F.col("other"))
    return rows.select("block", "shelf", (F.shiftleft((F.col("shelf") * SHELF).cast("long"), 32) + F.col("place")).alias("place"), a.alias("a"), F.when(second, F.col("id")).alias("b"))


def stretches(tokens: DataFrame, lengths: dict[str, list[int]]) -> DataFrame:
    """(block, at, cut, a, b, a_id, b_id) for each place of a piece where a token begins, in order.

    a, b: the token that begins there, or null; cut: whether both do, so that a group begins; a_id, b_id: the tokens that run through
    the stretch from there on.  Two tokens overlap in exactly one stretch, so each row is one link.
    """
    rows = token_places(tokens, lengths)
    along = Window.partitionBy("block", "shelf").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("block", "place", "a", "b", *[F.last(c, True).over(along).alias(f"{c}_id") for c in "ab"])
    cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    return rows.select("block", F.shiftright("place", 32).cast("int").alias("at"), cut.alias("cut"), "a", "b", "a_id", "b_id")


def _told(id_kind: str) -> str:
    return f"block long, row long, id {id_kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair int, link long, n long, sizes array<int>, pairs array<int>"


def _texts_of_block(texts: pa.Table, found: pa.Table) -> pa.Table:
    """A row for each text of a block; one for each pair of ids that its pieces link, with the number of texts that hold it; and one with the pairs of each piece.

    found: the stretches of the block's pieces, in order: at, cut, whether a token of each side begins there (a, b), and the pair of ids that run through it (link).
    """
    flat = pc.list_flatten(texts["words"]).to_numpy()
    place, fresh = found["at"].to_numpy(), found["cut"].to_numpy()  # each piece begins with a group
    n = 1 + max(int(place.max(initial=-1)), int(flat.max(initial=-1)))
    begins, link = {c: found[c].to_numpy() for c in "ab"}, found["link"].to_numpy()
    group = np.cumsum(fresh) - 1
    own_group = place[fresh]  # the piece of each group
    sums = np.stack([np.bincount(x, minlength=n) for x in (place[begins["a"]], place[begins["b"]], own_group)])
    whole = sums[2] > 0

    def joined(values: pa.Array, counts: np.ndarray, by: str) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values), by)

    ids = {"a": link >> 32, "b": link & 0xFFFFFFFF}
    sides = [joined(pa.array(ids[c][begins[c]]).cast(pa.string()), np.bincount(group[begins[c]], minlength=len(own_group)), ",") for c in "ab"]
    groups = pc.binary_join_element_wise(joined(pc.binary_join_element_wise(*sides, "|"), sums[2], ";"), "", ";").cast(pa.large_string())
    sizes = np.bincount(place, minlength=n)
    starts = np.cumsum(sizes) - sizes
    numbered = pa.array(link).dictionary_encode()
    links, own = numbered.dictionary.to_numpy(), numbered.indices.to_numpy()
    del link, ids, numbered
    lengths = pc.fill_null(pc.list_value_length(texts["words"]), 0).to_numpy()
    ends = np.cumsum(lengths)
    del place, fresh, begins, group, own_group, sides  # memory bounds the size of a block
    totals, run = np.empty((5, len(ends)), np.int64), np.zeros(len(flat) + 1, np.int64)
    for k, x in enumerate((*sums, sizes, ~whole)):
        np.cumsum(x[flat], out=run[1:])
        totals[k] = run[ends] - run[ends - lengths]
    held, rows = np.zeros(len(links), np.int64), []
    most = max(1, ROOM // max(1, len(links)))
    room, first = np.empty(min(most, len(ends)) * len(links), np.int32), 0
    while first < len(ends):  # some texts at a time, whole ones
        begin = ends[first] - lengths[first]
        end = max(first + 1, min(first + most, int(np.searchsorted(ends, begin + ROOM // 8, side="right"))))
        w, own_ends = flat[begin : ends[end - 1]], (ends[first:end] - begin).tolist()
        told = groups.take(pa.array(w))
        _, cuts, letters = told.buffers()
        cuts, letters = (np.frombuffer(cuts, np.int64)[[0, *own_ends]].tolist(), memoryview(letters)) if len(w) else ([0] * (end - first + 1), b"")
        for a, b, size, (*counts, unknown) in zip(cuts, cuts[1:], lengths[first:end].tolist(), totals[:, first:end].T.tolist(), strict=False):
            rows.append((*counts, hashlib.sha256(letters[a : b - 1]).hexdigest()) if size and not unknown else (0, 0, 0, 0, ""))
        good = np.repeat(totals[4, first:end] == 0, lengths[first:end])
        text = np.repeat(np.arange(end - first), lengths[first:end])[good]
        w = w[good]
        count = sizes[w]
        found_links = own[np.arange(count.sum()) + np.repeat(starts[w] - (np.cumsum(count) - count), count)]
        # of the same link in the same text the last one is kept: the one whose number is still there
        spot, along = np.repeat(text * len(links), count) + found_links, np.arange(len(found_links), dtype=np.int32)
        room[spot] = along
        np.add.at(held, found_links[room[spot] == along], 1)
        first = end
    t, p, longs, numbers = len(rows), len(links), pa.int64(), pa.list_(pa.int32())
    n_a, n_b, n_groups, n_links, told = zip(*rows, strict=True) if rows else ((),) * 5
    block = (texts if t else found)["block"][0].as_py()

    def column(kind: pa.DataType, text=None, pair=None, one=None) -> pa.ChunkedArray:
        return pa.chunked_array([pa.nulls(k, kind) if x is None else x.combine_chunks() if isinstance(x, pa.ChunkedArray) else pa.array(x, kind) for x, k in ((text, t), (pair, p), (one, 1))], kind)

    return pa.table({
        "block": pa.array(np.full(t + p + 1, block)), "row": column(longs, texts["row"]), "id": column(texts["id"].type, texts["id"]),
        "n_a": column(longs, n_a), "n_b": column(longs, n_b), "n_groups": column(longs, n_groups), "n_links": column(longs, n_links), "groups_sha256": column(pa.string(), told),
        "pair": column(pa.int32(), None, np.arange(p, dtype=np.int32)), "link": column(longs, None, links), "n": column(longs, None, held),
        "sizes": column(numbers, None, None, [sizes]), "pairs": column(numbers, None, None, [own]),
    })


def _sums_of_block(texts: pa.Table, facts: pa.Table) -> pa.Table:
    """(block, row, n_best, count_sum) of each text.  facts: what the corpus says of each pair, and one row with the pairs of each piece."""
    of_pieces, pairs = facts.filter(pc.is_valid(facts["sizes"])), facts.filter(pc.is_null(facts["sizes"]))
    sizes, own = (pc.list_flatten(of_pieces[c]).to_numpy() for c in ("sizes", "pairs"))
    known, along = np.zeros((2, 1 + int(own.max(initial=-1))), np.int64), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    for k, c in enumerate(("best", "count")):
        known[k, pairs["pair"].to_numpy()] = pairs[c].to_numpy()
    run = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(known[:, own], axis=1)), axis=1)
    each = run[:, along[1:]] - run[:, along[:-1]]
    flat, ends = pc.list_flatten(texts["words"]).to_numpy(), np.cumsum(pc.fill_null(pc.list_value_length(texts["words"]), 0).to_numpy())
    run = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(each[:, flat], axis=1)), axis=1)
    got = run[:, ends] - run[:, np.concatenate(([0], ends))[:-1].astype(np.int64)]
    return pa.table({"block": texts["block"], "row": texts["row"], "n_best": pa.array(got[0]), "count_sum": pa.array(got[1])})


def align(df: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A: byte-level BPE over blank + text; B: piece BPE over the text, to which it adds the blank.  Places where tokens of both begin cut them into groups;
    links are the pairs of tokens whose bytes overlap; a pair's count is the number of rows that hold it linked, and a link is best
    if its count is the highest of its A id.  Null and empty texts, and those that a side's tokens do not spell, have no tokens: zeros, and an
    empty groups_sha256.  Repeated rows count as rows of their own; ids, null ones too, only pass through; very long texts are read whole.
    An empty table gives no rows; other columns are not read, whatever their names.  The files, of fixed size, are read on the driver and broadcast.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    with open(byte_file, encoding="utf-8") as f:
        definition = f.read()
    with open(piece_file, "rb") as f:
        model = f.read()
    check_definition(definition)
    sides = Sides(definition, model)
    sides.check()
    lengths = {"a": sides.a_lengths.tolist(), "b": list(map(len, sides.b_bytes))}
    key = hashlib.md5(definition.encode() + model).hexdigest()
    cut, drop = by_block(cut_texts(df, spark.sparkContext.broadcast((definition, model)), key, id_col, text_col))
    texts = cut.where("shelf is null").select("block", "row", "id", "words")
    found = stretches(cut.where("shelf is not null").select("block", "shelf", "ids", "places"), lengths)
    link = F.shiftleft(F.col("a_id").cast("long"), 32) + F.col("b_id")
    found = found.select("block", "at", "cut", F.col("a").isNotNull().alias("a"), F.col("b").isNotNull().alias("b"), link.alias("link"))
    told = stored(texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_texts_of_block, _told(kind)), "align-told")
    held = told.where("link is not null").select("block", "pair", "link", "n", F.shiftright("link", 32).alias("a"))
    counts = stored(held.groupBy("a", "link").agg(F.sum("n").alias("count")), "align-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    facts = counts.join(F.broadcast(most), "a").select("link", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))  # most: a row for each id of the vocabulary
    none = F.lit(None)
    facts = held.join(facts, "link").select("block", "pair", "best", "count", none.cast("array<int>").alias("sizes"), none.cast("array<int>").alias("pairs"))
    facts = facts.unionByName(told.where("sizes is not null").select("block", none.cast("int").alias("pair"), none.cast("long").alias("best"), none.cast("long").alias("count"), "sizes", "pairs"))
    sums = texts.select("block", "row", "words").groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(_sums_of_block, "block long, row long, n_best long, count_sum long")
    sums = stored(sums, "align-sums")
    drop()
    discard(counts)
    out = told.where("row is not null").select("block", "row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, ["block", "row"])
    has = F.col("groups_sha256") != ""
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *[F.when(has, F.col(c)).otherwise(0).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
