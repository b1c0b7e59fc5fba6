import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tailweave.llm import align
from tailweave.llm.tokencount import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """Whole texts by the libraries: ids and bytes of both sides, or nothing."""
    if not text:
        return [], [], [], []
    a, b = libraries
    letters, x, y = byte_letters(), a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    u = [bytes(letters[c] for c in a.id_to_token(k)) for k in x]
    v = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in y for p in [b.id_to_piece(k)]]
    raw = (" " + text).encode()
    return (x, u, y, v) if b"".join(u) == raw == b"".join(v) else ([], [], [], [])


def ends(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def brute(libraries, rows):
    own, counts = [], Counter()
    for id_, text in rows:
        x, u, y, v = tokens(libraries, text)
        ex, ey = ends(u), ends(v)
        links, j = [], 0
        for i, e in enumerate(ex):
            begin = e - len(u[i])
            while j < len(ey) and ey[j] <= begin:
                j += 1
            k = j
            while k < len(ey) and ey[k] - len(v[k]) < e:
                links.append((x[i], y[k]))
                k += 1
        groups, i, j = [], 0, 0
        for c in sorted(set(ex) & set(ey)):
            p, q = bisect_right(ex, c), bisect_right(ey, c)
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        counts.update(set(links))
        own.append((id_, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return sorted(((id_, n_a, n_b, n_g, len(ls), sum(counts[p] == most[p[0]] for p in ls), sum(counts[p] for p in ls), told) for id_, n_a, n_b, n_g, ls, told in own), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_documents_like_brute_force(spark, libraries, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got(align.align(docs, A, B)) == brute(libraries, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_random_texts_in_small_blocks(spark, libraries, rng, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 300)
    pool = [chr(k) for k in (*range(1, 0x250, 7), 0x2000, 0x3000, 0x200B, 0xFEFF, 0x4E2D, 0x1F600, 0xB2, 0x660, 0x2028, 0x301, 0x5D0, 0x926, 0xA0, 0x85)]
    pool += [" ", " ", " ", "\n", "\n", "\t", "\r\n", "  ", "▁", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "the", " house", "'ll", "ing", "tion", "123", "...", "--", "\x00"]
    rows = [(k, "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(align.align(docs, A, B)) == brute(libraries, rows)


def test_awkward_rows(spark, libraries, awkward, clashing, nothing):
    more = spark.createDataFrame([(30, " ", None, None, 1), (31, "\n", None, None, 1), (32, " a ", None, None, 1), (33, "a \n", None, None, 1), (34, "▁a", None, None, 1), (35, "a\n\nb  c\t d", None, None, 1), (36, "x" * 2000 + " y", None, None, 1)], awkward.schema)
    want = brute(libraries, [(r["doc_id"], r["text"]) for r in awkward.unionByName(more).collect()])
    assert got(align.align(awkward.unionByName(more), A, B)) == want
    assert got(align.align(clashing, A, B)) == brute(libraries, [(r["doc_id"], r["text"]) for r in clashing.collect()])
    assert align.align(nothing, A, B).count() == 0


def test_pieces_encode_by_themselves(libraries, rng):
    """The proof in practice: cut texts give the tokens of whole ones."""
    sides = align.Sides(open(A, encoding="utf-8").read(), open(B, "rb").read())
    sides.check()
    pool = [" ", "\n", "  ", "\t", "\r", "\xa0", " ", "a", "b.", "'s", "é", "漢", "!", "the", "0", "\x1c", "\x85"]
    kept = set()
    for _ in range(2000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 25)))
        pieces = align.pieces_of(text)
        assert "".join(pieces) == " " + text and pieces == align.PIECES.findall(" " + text)
        assert pieces == list(map(align.piece_of, align.words_of(text)))
        x, _, y, _ = tokens(libraries, text)
        assert tuple([k for ids in side for k in ids] for side in sides.encoded(pieces)) == (x, y)
        kept.update(pieces)
    alone = [p for p in kept if "▁" not in p]
    assert sides.encoded(alone)[0] == [e.ids for e in libraries[0].encode_batch(alone, add_special_tokens=False)]


def test_tokens_and_texts_are_not_shuffled(spark):
    cut, drop = align.by_block(spark.createDataFrame([(1, 0, [1, 2], [3])], "block long, at int, a array<int>, b array<int>"))
    plan = align.stretches(cut, {"a": [1] * 9, "b": [2] * 9})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    drop()


def test_pieces_encoded_together(libraries, rng):
    """Runs of pieces give each piece's own tokens; what a side does not spell is marked, and does not touch its neighbours."""
    sides = align.Sides(open(A, encoding="utf-8").read(), open(B, "rb").read())
    pool = ["a", "b.", "'s", "\u00e9", "\u6f22", "!", "the", "0", "\x1c", "ing", "\u0301", "\U0001f600"]
    pieces = list(dict.fromkeys(" " + "".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(900)))
    pieces += [" ", "\n", "\na", "  b", " c ", " d\t e", " x\u2581y", " \ufb01", " <s>", " </s>", " <|endoftext|>"]
    rng.shuffle(pieces)
    want = sides.encoded(pieces)
    known, found = sides.flat(pieces)
    assert known.tolist() == [x is not None for x in want[0]]
    for (counts, ids), own in zip(found, want, strict=True):
        assert counts.tolist() == [len(x or []) for x in own] and ids.tolist() == [k for x in own for k in x or []]
    assert sides.flat([])[0].tolist() == []


def test_places_by_lengths(spark):
    tokens = spark.createDataFrame([(1, 0, [1, 2], [3]), (1, 1, [0, 0], [4, 4])], "block long, at int, a array<int>, b array<int>")
    got = align.stretches(tokens, {"a": [3, 1, 4], "b": [0, 0, 0, 5, 3]}).orderBy("at", "a_id", "b_id").select("at", "cut", "a", "b", "a_id", "b_id").collect()
    assert [tuple(r) for r in got] == [(0, True, 1, 3, 1, 3), (0, False, 2, None, 2, 3), (1, True, 0, 4, 0, 4), (1, True, 0, 4, 0, 4)]


def test_tokens_are_stored_by_place(rng):
    """Tokens of both sides in the order of the windows' key, so that their sort finds them sorted."""
    lengths = np.array([1, 2, 3]), np.array([1, 3, 6])
    rows = [([0, 1, 2], [2]), ([], []), ([2], [0, 0, 0]), ([1, 0], [1])]
    sides = [(np.array([len(r[k]) for r in rows]), np.array([x for r in rows for x in r[k]], np.int32)) for k in (0, 1)]
    ends, ids, places = align.by_place(np.arange(4, dtype=np.int32) + 7, sides, lengths)
    got = [list(zip(ids[a:b].tolist(), places[a:b].tolist(), strict=True)) for a, b in zip(ends, ends[1:], strict=False)]
    assert got == [[(0, 0), (2, 1), (1, 2), (2, 6)], [], [(2, 0), (0, 1), (0, 3), (0, 5)], [(1, 0), (1, 1), (0, 4)]]


def test_spelled_strings(libraries):
    """What a side changes is found, whether the bytes are as many or not, and only there."""
    sides = align.Sides(open(A, encoding="utf-8").read(), open(B, "rb").read())
    for texts in ([" one two", " x\u2581y z", " three"], [" one two", " \ufb01", " three"], [" one", " \ufb03x", ""], []):
        found = [sides.encode_bytes(t) for t in texts], [sides.b.encode(t[1:]) if t else [] for t in texts]
        want = [b"".join(sides.a_bytes[k] for k in x) == t.encode() == b"".join(sides.b_bytes[k] for k in y) for t, x, y in zip(texts, *found, strict=True)]
        assert sides.spelled([t.encode() for t in texts], found).tolist() == want


def test_a_window_holds_many_pieces(spark):
    """No window for each piece: a shelf of them is one, and links never run from piece to piece."""
    rows = [(1, k, [k % 3, 1], [2]) for k in range(600)]
    cut = spark.createDataFrame(rows, "block long, at int, a array<int>, b array<int>")
    out = align.stretches(cut, {"a": [1, 2, 3], "b": [1, 1, 3]})
    assert "windowspecdefinition(block" in out._jdf.queryExecution().optimizedPlan().toString() and "shelf" in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["at"], r["a_id"], r["b_id"]) for r in out.collect())
    assert got == sorted([(k, x, 2) for k in range(600) for x in (k % 3, 1)])


def test_a_stored_row_holds_a_shelf_of_pieces(spark, libraries):
    """Not one piece: its tokens are all there, in order, and pieces that a side does not spell have none."""
    words = [f"word{k}" if k % 50 else f"x▁{k}" for k in range(3 * align.SHELF + 9)]
    definition, model = open(A, encoding="utf-8").read(), open(B, "rb").read()
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").coalesce(1)
    cut = align.cut_texts(docs, spark.sparkContext.broadcast((definition, model)), "shelf of pieces", "doc_id", "text")
    rows = cut.where("shelf is not null").orderBy("shelf").collect()
    assert [r["shelf"] for r in rows] == [0, 1, 2, 3]
    got = [[] for _ in words], [[] for _ in words]
    for r in rows:
        assert r["places"] == sorted(r["places"]) and len(r["ids"]) == len(r["places"])
        for k, place in zip(r["ids"], r["places"], strict=True):
            got[place & 1][r["shelf"] * align.SHELF + (place >> 32)].append(k)
    want = align.Sides(definition, model).encoded([" " + w for w in words])
    assert [x is None for x in want[0]] == [k % 50 == 0 for k in range(len(words))]
    assert got == tuple([x or [] for x in side] for side in want)


def test_tokens_that_match_are_one_row_before_the_sort(spark):
    """Neighbours of a shelf are matched as they are exploded: the windows only carry tokens on, and sort a row for each place."""
    cut = spark.createDataFrame([(1, align.SHELF, [1, 2], [3]), (1, align.SHELF + 1, [0, 0], [2, 4])], "block long, at int, a array<int>, b array<int>")
    lengths = {"a": [3, 1, 4], "b": [0, 0, 1, 5, 5]}
    got = [tuple(r) for r in align.token_places(cut, lengths).orderBy("shelf", "place").select("shelf", "place", "a", "b").collect()]
    first = align.SHELF << 32
    assert got == [(1, first + 1, 1, 3), (1, first + 2, 2, None), (1, first + (1 << 32) + 1, 0, 2), (1, first + (1 << 32) + 3, None, 4), (1, first + (1 << 32) + 6, 0, None)]
    plan = align.stretches(cut, lengths)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan and "lead(" not in plan


@pytest.mark.parametrize("room", [1, 9, 1 << 20])
def test_texts_of_a_block_together(monkeypatch, room):
    """Some texts at a time give what each gives alone; texts without words or with a piece that is not spelled have nothing."""
    monkeypatch.setattr(align, "ROOM", room)
    one, two, three = (7 << 32) + 8, (9 << 32) + 8, (5 << 32) + 6
    found = [(0, True, True, True, one), (1, True, True, True, one), (1, False, True, False, two), (3, True, True, True, three)]
    found = pa.table({"block": [4] * 4} | {n: pa.array(x, kind) for n, x, kind in zip(("at", "cut", "a", "b", "link"), zip(*found, strict=True), (pa.int32(), *[pa.bool_()] * 3, pa.int64()), strict=True)})
    words = [[], [0, 1, 1], None, [0, 2], [3, 0], []]
    texts = pa.table({"block": [4] * 6, "row": [*range(6)], "id": [*range(6)], "words": pa.array(words, pa.list_(pa.int32()))})
    out = align._texts_of_block(texts, found).to_pylist()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    nothing = (0, 0, 0, 0, "")
    assert [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) for r in out[:6]] == [nothing, (5, 3, 3, 5, sha("7|8;7,9|8;7,9|8")), nothing, nothing, (2, 2, 2, 2, sha("5|6;7|8")), nothing]
    assert {r["link"]: r["n"] for r in out[6:-1]} == {one: 2, two: 1, three: 1}
    bare = align._texts_of_block(texts.slice(2, 1), found.slice(0, 0)).to_pylist()
    assert [r["groups_sha256"] for r in bare] == ["", None]
