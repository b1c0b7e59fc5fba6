import re
from collections import defaultdict

import pytest

from tailweave.llm import neardup
from tailweave.llm.common import marked_ids, without_ids
from tailweave.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in groups(links, ids).items()}


def corpus(rng, n=30, copies=12):
    docs = []
    for _ in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        docs.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, copies])):
            own = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 9999)}"
            docs.append(rng.choice([" ", "\n", " \t"]).join(own).upper() if rng.random() < 0.3 else " ".join(own))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [256, 4])
def test_like_brute_force(spark, rng, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # 4: clusters of many blocks, hubs and pairs of blocks
    docs = corpus(rng) + [(9001, None), (9002, ""), (9003, "  "), (9004, "one two"), (9005, "ONE  two"), (9006, "one two three")]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chain_across_blocks(spark, monkeypatch):
    """Neighbours in a chain are alike, its ends are not; blocks deal them apart."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    words = [f"a{k}" for k in range(200)]
    docs = []
    for k in range(40):
        words[5 * k % 200] = f"b{k}"
        docs.append((k, " ".join(words)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs)
    assert len({r["component_id"] for r in got}) == 1


def test_all_pairs_confirms_what_signatures_let_through(rng):
    sets = [[rng.randrange(2**63) for _ in range(60)] for _ in range(4)]
    rows = []
    for k in range(40):
        own = list(sets[k % 4])
        own[: k % 7] = [rng.randrange(2**63) for _ in range(k % 7)]
        import numpy as np

        rows.append((k, 0, np.unique(np.array(own, np.uint64))))
    own = neardup._Sets(rows)
    own.all_pairs(85, False)
    alike = lambda x, y: 100 * len(set(x) & set(y)) >= 85 * len(set(x) | set(y))
    want = groups([(a, b) for a in range(40) for b in range(a) if alike(rows[a][2].tolist(), rows[b][2].tolist())], range(40))
    assert {k: own.find(k) for k in range(40)} == want


def test_components_like_union_find(spark, rng):
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1080)] + [(5000, k) for k in range(6000, 6400)] + [(1, 1)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(edges, {x for e in edges for x in e if e[0] != e[1]})
    assert got == {n: want[n] for n in got} and set(want) == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates_are_unbiased(rng):
    import numpy as np

    base = np.array([rng.randrange(2**63) for _ in range(400)], np.uint64)
    a, b = np.unique(base[:320]), np.unique(base[80:])
    sig = neardup.min_max_signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 240 / 400) < 0.13


def test_awkward_rows(awkward, clashing, nothing):
    for docs in (awkward, clashing):
        got = neardup.near_duplicates(docs).toPandas()
        assert len(got) == awkward.count()
        by = got.groupby("doc_id").component_id.agg(set)
        assert by[1] == {1} and by[11] == {1} and by[2] == {2} and by[3] == {3}
        kept = neardup.without_duplicates(docs)
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.collect()]
        # two texts under id 10 stay, and so do the two rows without id: a text of its own, and no text
        assert sorted(ids, key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, None, None], key=str)
    assert neardup.near_duplicates(nothing).count() == 0 == neardup.without_duplicates(nothing).count()


def test_ids_filter_misses_none(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text")
    some = spark.range(0, 3000, 37)
    got = {r["doc_id"] for r in marked_ids(docs, some, 82).where("__may").collect()}
    assert set(range(0, 3000, 37)) <= got and len(got) < 400
    assert marked_ids(docs, some.where("id < 0"), 0).where("__may").count() == 0
    assert {r["doc_id"] for r in without_ids(docs, some).collect()} == set(range(3000)) - set(range(0, 3000, 37))
    assert without_ids(docs, some.where("id < 0")).count() == 3000


def test_sizes_of_groups(spark, rng):
    docs = corpus(rng, 10)
    n = defaultdict(int)
    for r in neardup.near_duplicates(spark.createDataFrame(docs + docs, "doc_id long, text string")).collect():
        n[r["doc_id"]] += 1
    assert set(n.values()) == {2}


def near(words, k):
    return " ".join([*words[:30], f"other{k}", *words[30:]])


def test_rows_without_id_link_like_others(spark):
    """Near copies without id, with and without a copy that has one; a text without id that ties two others together."""
    a, b = ([f"{x}{k}" for k in range(120)] for x in "ab")
    docs = [(5, " ".join(a)), (None, near(a, 1)), (None, near(b, 1)), (None, near(b, 2)), (None, near(b, 2)), (None, None), (None, " "), (7, "alone here")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 116, 5, True), (None, 117, 5, False), *[(None, 117, None, True)] * 3, *[(None, 0, None, True)] * 2, (7, 1, 7, True)], key=str)
    kept = [tuple(r) for r in neardup.without_duplicates(df).collect()]
    assert (5, " ".join(a)) in kept and (7, "alone here") in kept and (None, None) in kept and (None, " ") in kept and len(kept) == 5
    words = [f"c{k}" for k in range(100)]
    ends = [" ".join([*words[:20], "x", *words[21:]]), " ".join(words), " ".join([*words[:70], "y", *words[71:]])]
    df = spark.createDataFrame([(1, ends[0]), (None, ends[1]), (2, ends[2])], "doc_id long, text string")
    assert {r["component_id"] for r in neardup.near_duplicates(df).collect()} == {1}


def test_different_texts_under_one_id(spark):
    """All rows have one id: unrelated texts stay, near copies and repeated rows go."""
    docs = [(2, near([f"{x}{k}" for k in range(120)], y)) for x in "abcdefgh" for y in (0, 0, 1)]
    df = spark.createDataFrame([(*d, k) for k, d in enumerate(docs)], "doc_id long, text string, __row int")
    kept = neardup.without_duplicates(df).collect()
    assert sorted(r["text"][0] for r in kept) == list("abcdefgh") and neardup.near_duplicates(df).where("component_id = 2").count() == 24
    again = neardup.without_duplicates(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, kept))


def test_hubs_are_met_by_a_broadcast(spark, rng, monkeypatch):
    from tailweave.llm import components

    edges = [(9_999, k) for k in range(400)] + [(k, 20_000 + k % 7) for k in range(300)] + [(30_000 + k, 30_001 + k) for k in range(50)]
    want = groups(edges, {x for e in edges for x in e})
    for least in (0, 5, 256, 10**9):
        monkeypatch.setattr(components, "LEAST_HUB", least)
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == want
