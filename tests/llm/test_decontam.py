import numpy as np
import pytest

from tailweave.llm import decontam, queries


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = list(best)
        for k, y in enumerate(b):
            best[k + 1] = before[k] + 1 if x == y else max(before[k + 1], best[k])
    return best[-1]


def test_bit_parallel_lcs(rng):
    for _ in range(300):
        a = np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 90))], np.uint64)
        b = np.array([rng.randint(0, 8) for _ in range(rng.randint(0, 120))], np.uint64)
        assert decontam.common_subsequence(a, b)[0] == lcs(a.tolist(), b.tolist())


def test_svd_like_numpy(spark, rng):
    a = np.zeros((30, 50))
    for row in a:
        for _ in range(6):
            row[rng.randrange(50)] = rng.random()
    sparse = [([int(k) for k in np.flatnonzero(r)], [float(x) for x in r[np.flatnonzero(r)]]) for r in a]
    df = spark.createDataFrame(sparse, "term array<int>, weight array<double>").repartition(3)
    basis = decontam.randomised_svd(df, 50, 8, turns=8)
    _, _, v = np.linalg.svd(a)
    assert np.allclose(basis.T @ basis, np.eye(8), atol=1e-8)
    assert np.linalg.norm(a @ basis) == pytest.approx(np.linalg.norm(a @ v[:8].T), rel=1e-3)


def items(rng, n=25):
    return [(k, " ".join(f"term{rng.randint(0, 900)}" if rng.random() < 0.6 else rng.choice(["the", "of", "and", "a"]) for _ in range(rng.randint(14, 50)))) for k in range(n)]


def filler(rng, n):
    return [rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.4 else f"other{rng.randint(0, 3000)}" for _ in range(n)]


def test_finds_copies_and_paraphrases_only(spark, rng):
    bench = items(rng)
    docs, want = [], set()
    for k in range(240):
        words = filler(rng, rng.choice([5, 60, 300, 900]))
        if k % 4 == 0:
            item = bench[rng.randrange(len(bench))]
            own = item[1].split()
            if k % 8 == 0:  # a paraphrase: words changed and put in
                own = [f"new{rng.randint(0, 99)}" if rng.random() < 0.12 else w for w in own]
                own.insert(rng.randrange(len(own)), "inserted")
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + rng.choice(["", "!", ","]) for w in own] if k % 12 == 0 else own
            want.add((k, item[0]))
        docs.append((k, " ".join(words)))
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, b).collect()}
    assert got == want
    kept = {r["doc_id"] for r in decontam.without_leaks(df, b).collect()}
    assert kept == set(range(240)) - {d for d, _ in want}


def test_blocks_of_items_find_the_same(spark, rng, monkeypatch):
    bench = items(rng, 12)
    docs = [(k, " ".join(filler(rng, 50)) + " " + bench[k % 12][1]) for k in range(24)]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    monkeypatch.setattr(decontam, "MOST_WORDS", 90)
    assert len(decontam.item_blocks(b)) > 2
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, b).collect()} == {(k, k % 12) for k in range(24)}


def test_answers_have_to_be_there_in_paraphrases(spark):
    question = "what is the name of the tall river that runs through the old stone city of maroon hills? clearwater"
    changed = "what was the title of the tall stream that runs past the old rock city of brown hills "
    docs = [(1, "yes " + question), (2, changed + "clearwater"), (3, changed + "unknown"), (4, "well " + question.replace("clearwater", "unknown"))]
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, question)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.find_leaks(df, b).collect()} == {1, 2, 4}  # 4: the question word for word


def test_more_of_an_item_never_turns_a_hit_into_a_miss(rng):
    words = [f"w{k}" for k in range(40)]
    item = decontam.Item(1, decontam._text_words(" ".join(words)), decontam._text_words("w38 w39"), np.zeros(0, np.uint64))
    around = [f"x{k}" for k in range(30)]
    hits = [bool(decontam.confirmed(item, decontam._text_words(" ".join(around + words[:k] + around)))) for k in range(41)]
    assert hits == [k >= decontam.RUN for k in range(41)]
    for _ in range(60):
        there, hit = set(), False
        for k in rng.sample(range(40), 40):  # words come in one by one, strangers stand for the others
            there.add(k)
            now = bool(decontam.confirmed(item, decontam._text_words(" ".join(w if j in there else f"x{j}" for j, w in enumerate(words)))))
            assert now or not hit
            hit = now
        assert hit


def plain_leaks(docs, bench):
    """{(doc, item): (cosine, cover)} from dictionaries: every passage of every document against every passage of every item."""
    import math
    from collections import Counter

    cut = lambda t: ["".join(c if c.isalnum() else " " for c in w) for w in t.lower().split()]
    passages = lambda w: [(a, min(a + decontam.SPAN, len(w))) for a in range(0, max(1, len(w) - decontam.STEP), decontam.STEP)] if w else []
    words = {k: cut(t) for k, t in docs}
    items = {k: cut(t) for k, t in bench}
    vocabulary = {w for t in items.values() for w in t}
    df, total = Counter(), 0
    for w in words.values():
        for a, b in passages(w):
            df.update(set(w[a:b]) & vocabulary)
            total += 1
    idf = {w: math.log((total + 1) / (df[w] + 1)) + 0.1 for w in vocabulary}
    common = {w for w in vocabulary if df[w] > decontam.COMMON * total}
    spared = set()
    for w in items.values():
        for a, b in passages(w):
            if len(set(w[a:b]) - common) < decontam.FEW:
                spared |= set(w[a:b])
    weight = {w: 0 if w in common - spared else v for w, v in idf.items()}

    def vector(w):
        v = {x: c * weight[x] for x, c in Counter(w).items() if weight.get(x)}
        n = math.sqrt(sum(c * c for c in v.values()))
        return {x: c / n for x, c in v.items()} if n else {}

    index = [(i, vector(w[a:b])) for i, w in items.items() for a, b in passages(w)]
    out = {}
    for d, w in words.items():
        for a, b in passages(w):
            v = vector(w[a:b])
            for i, u in index:
                cosine, item = sum(c * u.get(x, 0) for x, c in v.items()), items[i]
                if cosine < decontam.LIKELY:
                    continue
                reach = len(item) + decontam.SPAN // 2
                text = w[max(0, a - reach) : b + reach]
                own = decontam.Item(i, decontam._text_words(" ".join(item)), np.zeros(0, np.uint64), np.array([decontam._text_words(x)[0] for x in sorted(set(item), key=lambda x: (-idf[x], int(decontam._text_words(x)[0])))[: decontam.KEY_WORDS]], np.uint64))
                cover = lcs(item, text) / len(item)
                if decontam.confirmed(own, decontam._text_words(" ".join(text))) and (cover, cosine) > out.get((d, i), (0, 0))[::-1]:
                    out[d, i] = (cosine, cover)
    return out


@pytest.mark.parametrize("most_words", [decontam.MOST_WORDS, 150])
def test_pairs_cosines_and_covers_like_brute_force(spark, rng, monkeypatch, most_words):
    monkeypatch.setattr(decontam, "MOST_WORDS", most_words)
    bench = items(rng, 14)
    docs = []
    for k in range(100):
        words = filler(rng, rng.choice([3, 60, 150]))
        own = bench[rng.randrange(14)][1].split()
        share = rng.choice([0, 0.3, 0.6, 0.75, 0.85])
        at = rng.randrange(len(words) + 1)
        words[at:at] = [w if rng.random() < share else f"new{rng.randint(0, 99)}" for w in own]
        docs.append((k, " ".join(words)))
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["cosine"], r["cover"]) for r in decontam.find_leaks(df, b).collect()}
    want = plain_leaks(docs, bench)
    assert len(want) > 15 and got.keys() == want.keys()
    for k, (cosine, cover) in want.items():
        assert got[k][1] == pytest.approx(cover, abs=1e-9) and got[k][0] == pytest.approx(cosine, abs=0.01)


def test_like_shared_runs_on_the_test_tables(spark):
    """Items whose runs of eight words mostly stand in a document are found there, and nothing else is."""
    import re
    from collections import Counter, defaultdict

    d = "/root/testdata/sf0.01"
    cut = lambda t: re.findall(r"\w+", t.lower())
    runs, length = defaultdict(set), {}
    for r in spark.read.parquet(f"{d}/benchmark.parquet").collect():
        w = cut(r["text"])
        length[r["item_id"]] = len(w) - 7
        for k in range(len(w) - 7):
            runs[tuple(w[k : k + 8])].add(r["item_id"])
    want = set()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        w, n = cut(r["text"]), Counter()
        for run in {tuple(w[k : k + 8]) for k in range(len(w) - 7)}:
            n.update(runs.get(run, ()))
        want |= {(r["doc_id"], i) for i, c in n.items() if c > 0.5 * length[i]}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op8_benchmark_leaks(spark, d).collect()}
    assert want and got == want


def test_awkward_rows(spark, awkward, clashing, nothing):
    bench = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "The quick brown fox jumps over the lazy dog again", 0), (None, "no id here at all, none", 0), (3, "The quick brown fox jumps over the lazy dog again", 0)], "item_id long, text string, score int")
    for docs in (awkward, clashing):
        got = decontam.find_leaks(docs, bench).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 3), (1, 3), (11, 3)]
        kept = decontam.without_leaks(docs, bench)
        assert kept.columns == docs.columns and kept.count() == awkward.count() - 3
    assert decontam.find_leaks(nothing, bench).count() == 0
    none = bench.where("item_id > 99")
    assert decontam.find_leaks(awkward, none).count() == 0 and decontam.without_leaks(awkward, none).count() == awkward.count()


def test_blocks_of_many_more_passages_than_rank_lose_no_copy(spark, rng):
    """2,200 items in one block; items of common words in prose of rare ones are found by their runs."""
    terms = [f"term{k}" for k in range(4000)]
    plain = ["the", "of", "and", "a", "in", "to"] + terms[:40]
    bench = [(k, " ".join(rng.choice(plain if rng.random() < 0.5 else terms) for _ in range(rng.randint(8, 50)))) for k in range(2200)]
    docs = []
    for k in range(200):
        prose = [rng.choice(plain if rng.random() < 0.3 else terms) for _ in range(400)]
        at = rng.randrange(400)
        docs.append((k, " ".join([*prose[:at], bench[11 * k][1], *prose[at:]])))
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert len(decontam.item_blocks(b)) == 1
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, b).collect()}
    missed = {(k, 11 * k) for k in range(200)} - got
    assert not missed, len(missed)


def test_whole_vectors_stand_in_for_a_short_basis(spark, rng):
    bench = items(rng, 60)
    docs = [(k, " ".join(filler(rng, 30)) + " " + t) for k, t in bench]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    full, short = (decontam.build_index(df.select("text"), bench, rank) for rank in (decontam.RANK, 8))
    assert not len(full.whole) and len(short.whole) > 40
    for _, text in docs:
        words = decontam._text_words(text)
        _, start, end = decontam.spans(np.array([0, len(words)]))
        want = full.latent(words, start, end) @ full.passages.T
        found = {(int(x), int(y)): c for xs, ys, cs in short.cosines(words, start, end) for x, y, c in zip(xs, ys, cs, strict=True)}
        assert set(found) == {(x, y) for x, y in zip(*np.nonzero(want >= decontam.LIKELY), strict=True) if y in short.whole}
        assert all(c == pytest.approx(want[k], abs=1e-3) for k, c in found.items())


def test_partial_copies_count_among_stray_words(spark, rng):
    """20 to 29 words in a row of longer items, in prose that holds other words of the items too."""
    common = ["the", "of", "and", "a", "in", "to", "is", "that"]
    bench = [(k, " ".join(rng.choice(common) if rng.random() < 0.4 else f"term{rng.randint(0, 900)}" for _ in range(rng.randint(50, 59)))) for k in range(40)]
    docs = []
    for k, text in bench:
        prose = [rng.choice(common) if rng.random() < 0.3 else f"other{rng.randint(0, 3000)}" for _ in range(200)]
        docs.append((k, " ".join([*prose[:90], *text.split()[: rng.randint(20, 29)], *prose[90:]])))
        docs.append((100 + k, " ".join(prose)))
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, b).collect()} == {(k, k) for k in range(40)}


def test_unbroken_runs_count_without_the_rare_words_or_the_answer():
    def item(question, answer, rare=()):
        words = decontam._text_words(question + " " + answer)
        return decontam.Item(1, words, decontam._text_words(answer) if answer else words[:0], np.array([decontam._text_words(w)[0] for w in rare], np.uint64))

    run = " ".join(f"w{k}" for k in range(20))
    around = " ".join(f"x{k}" for k in range(20))
    text = decontam._text_words(f"{around} {run} {around}")
    assert decontam.confirmed(item(run + " r1 r2 r3", "", ["r1", "r2", "r3"]), text)
    assert decontam.confirmed(item("w0 w1 w2 w3 w4 w5?", " ".join(f"w{k}" for k in range(6, 20)) + " last"), text)
    assert decontam.confirmed(item(run + "?", "last"), text)  # twenty words in a row, whatever the answer
