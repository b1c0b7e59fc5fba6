import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tailweave.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def costs():
    with open(PATH, encoding="utf-8") as f:
        text = f.read()
    return tokencount.Costs(text, tokencount.whole_tokens(text))


def counts(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_whole_tokens_are_proven(library, costs):
    assert len(costs.whole) > 45_000
    assert all(n == 1 for n in counts(library, costs.whole))


def test_random_texts_like_the_library(library, costs, rng):
    pool = [chr(k) for k in (*range(0x250), 0x2000, 0x3000, 0x200B, 0xFEFF, 0x4E2D, 0x1F600, 0xB2, 0xBD, 0x660, 0x2160, 0x180E, 0x2028, 0x301, 0x5D0, 0x926)] + ["<|endoftext|>", " <|endoftext|> ", "'ll", "'s", "  ", "\n\n", "the ", " house"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["<|endoftext|>" * 3, "a" * 5000, " " * 500, "   a", "a   ", ""]
    assert costs.counts(texts) == counts(library, texts)


def test_every_code_point_is_split_alike(library, costs):
    texts = [f"a{chr(k)}1 {chr(k)}b" for k in range(0x20, 0x11000, 3) if not 0xD800 <= k < 0xE000]
    assert costs.counts(texts) == counts(library, texts)


def test_memory_of_costs_is_bounded(costs, monkeypatch, library):
    monkeypatch.setattr(tokencount, "MOST", 10)
    texts = [f"unlikelyword{k}" for k in range(50)]
    assert costs.counts(texts) == counts(library, texts) and costs.counts(texts) == counts(library, texts)


def test_awkward_rows(library, awkward, clashing, nothing):
    for docs in (awkward, clashing):
        got = tokencount.token_counts(docs, PATH).collect()
        texts = [r["text"] for r in docs.collect()]
        assert [r["n_tokens"] for r in got] == counts(library, texts)
        assert [r["n_bytes"] for r in got] == [len((t or "").encode()) for t in texts]
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert tokencount.token_counts(nothing, PATH).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises(ValueError), open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokencount.check_definition(f.read())
