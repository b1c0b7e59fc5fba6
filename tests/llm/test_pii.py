import hashlib
import math
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from tailweave.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((x if k % 2 == 0 else 2 * x - 9 * (x > 4)) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_base_spans_like_plain_patterns(spark, rng, awkward):
    pieces = ["a@b.c", "x@@y.z", "q%z@b-c.d-e.f", "a@b.cd%x@y.z", "1.2.3.4", "999.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "+1 (168) 555-5254", "+49 30 1234567", "+12", "é", "漢", "😀", " ", " ", ".", "-", "+", "@", "7", "word"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "a" * 50_000 + "@", "1" * 50_000, "a." * 20_000 + "@b.c", "1.2.3.4 " * 300, "x@y" + ".a" * 20_000, "+1" + " " * 50_000, "4 " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.span_digest(pii.find_personal_data(df)).collect()}
    for k, t in enumerate(texts):
        want = brute(t)
        line = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert got[k]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), t
        assert got[k]["spans"].startswith(line)
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(w[0] == x for w in want) for x in pii.KINDS]


def test_disclosing_terms_like_brute_force(spark, rng):
    filler = ["the", "and", "house", "garden", "river", "stone", "cloud"]
    texts = []
    for k in range(60):
        words = [rng.choice(filler) for _ in range(12)]
        if k % 6 == 0:
            words[5:5] = ["Zorblax", "wrote", "from", "who@example.com", "about", "quimby"]
        elif k % 6 == 1:
            words[3:3] = ["mail", f"user{k}@example.com", "about"]
        elif k == 10:
            words += ["quimby", "quimby"]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], t["start"], t["end"]): t["share"] for r in pii.find_personal_data(df).collect() for t in r["terms"]}

    n_t, n_e, n_te, places = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(list)
    for k, t in enumerate(texts):
        terms = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        for w, *_ in terms:
            n_t[w].add(k)
        spans = brute(t)
        for kind, a, b in spans:
            e = f"{kind}:{t[a:b].lower()}"
            n_e[e].add(k)
            for w, x, y in terms:
                if x >= max(0, a - pii.CONTEXT) and y <= b + pii.CONTEXT and not (x > 0 and x == a - pii.CONTEXT and False) and not any(p < y and q > x for _, p, q in spans):
                    whole = (x > max(0, a - pii.CONTEXT) or a - pii.CONTEXT <= 0) and (y < min(len(t), b + pii.CONTEXT) or b + pii.CONTEXT > len(t))
                    if whole:
                        n_te[w, e].add(k)
                        places[w, e].append((k, x, y))
    want = {}
    for (w, e), docs in n_te.items():
        share = len(docs) / len(n_t[w])
        if len(docs) >= pii.SUPPORT and 1 - math.log(share) / math.log(len(n_e[e]) / len(texts)) >= pii.DISCLOSED:
            for p in places[w, e]:
                want[p] = max(share, want.get(p, 0))
    assert want and got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-12 for p in want)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "who@" not in " ".join(clean.values()) and "Zorblax" not in " ".join(clean.values()) and "[EMAIL]" in clean[0]
    assert all(clean[k] == t for k, t in enumerate(texts) if not brute(t))


def test_awkward_rows(awkward, clashing, nothing):
    for docs in (awkward, clashing):
        assert pii.span_digest(pii.find_personal_data(docs)).count() == awkward.count()
        out = pii.sanitise(docs)
        assert out.columns == docs.columns and out.count() == awkward.count()
    assert pii.span_digest(pii.find_personal_data(nothing)).count() == 0 == pii.sanitise(nothing).count()


def test_overlapping_spans_are_hidden_once(spark):
    df = spark.createDataFrame([(1, "call +4111 1111 1111 111 or 10.0.0.1@x.org now")], "doc_id long, text string")
    out = pii.sanitise(df).first()["text"]
    assert not re.search("[0-9]", out) and out.startswith("call ") and out.endswith(" now")


def test_main_path_stays_in_the_jvm(awkward):
    found = pii.find_personal_data(awkward)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_entities_of_one_document_have_disclosing_terms(spark, rng):
    filler = ["the", "and", "house", "garden", "river", "stone", "cloud"]
    texts = [" ".join(rng.choice(filler) for _ in range(12)) for _ in range(3000)]
    texts[7] = "the house Zorblax who@example.com garden river"
    texts[8] = "the house Quimby other@example.com garden river"
    for k in range(9, 40):
        texts[k] += " quimby"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[7] == "the house  [EMAIL] garden river" and clean[8] == "the house Quimby [EMAIL] garden river"


def test_a_log_of_many_addresses(spark):
    """50,000 spans in one text, each with its context: work follows the spans, not their square."""
    n = 25_000
    text = " ".join(f"user{k}@example.org wrote from 10.{k % 250}.3.{k % 200} today" for k in range(n))
    df = spark.createDataFrame([(1, text), (2, "é" * 5000 + " a@b.c " + "漢" * 5000)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.span_digest(pii.find_personal_data(df)).collect()}
    assert time.perf_counter() - began < 60  # some hours, if every span met every other
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
    assert got[1]["n_email"] == n == got[1]["n_ip"] and got[1]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
    assert got[2]["spans"].startswith("email:5001:5006")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[1].count("[EMAIL]") == n == clean[1].count("[IP]") and "10." not in clean[1] and "[EMAIL]" in clean[2]


def test_cuts_and_sums_by_blocks(spark, rng):
    texts = ["".join(rng.choice("aé漢😀 ") for _ in range(n)) for n in (0, 1, 1023, 1024, 1025, 5000)]
    rows = [(t, a, b, [rng.randint(0, 9) for _ in range(n)]) for t in texts for n in (0, 1, 127, 128, 129, 700) for a, b in [sorted((rng.randint(0, len(t)), rng.randint(0, len(t) + 5)))]]
    df = spark.createDataFrame(rows, "t string, a int, b int, v array<int>")
    got = df.select("t", "a", "b", "v", pii.cut(pii.blocks_of(F.col("t")), F.col("a"), F.col("b")).alias("c"), pii.before_each(F.col("v"), pii.added).alias("s"), pii.before_each(F.col("v"), F.greatest).alias("m")).collect()
    for r in got:
        assert r["c"] == r["t"][r["a"] : r["b"]]
        assert r["s"] == [sum(r["v"][:k]) for k in range(len(r["v"]))] and r["m"] == [max(r["v"][:k], default=0) for k in range(len(r["v"]))]


def test_helper_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "mail a@b.c now", 5, 6, 7, 8), (2, "nothing", 1, 2, 3, 4)], "doc_id long, text string, __key int, __place int, __base int, __map int")
    got = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert got[1]["text"] == "mail [EMAIL] now" and (got[1]["__key"], got[1]["__place"], got[1]["__base"], got[1]["__map"]) == (5, 6, 7, 8) and got[2]["text"] == "nothing"
