"""Token counts with a whole-token shortcut.

Offline, once per vocabulary: which vocabulary strings does the library itself encode as one token?
Those pre-tokens then cost 1 by a table; only the others are merged, each distinct one once per worker.
Special strings inside texts count as the library's default has it: one token each.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .textarrays import arrow_map, slices, text_array

#: Fixed: the byte-level pre-tokenizer's published pattern; \s is written out as the White_Space property.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
#: Distinct pre-tokens whose cost a worker remembers; longer ones than LONG are merged anew each time.
MOST, LONG = 1_000_000, 64


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def whole_tokens(definition: str) -> list[str]:
    """The proof: vocabulary strings that are text and that the library encodes, alone, as just themselves."""
    from tokenizers import Tokenizer

    tokenizer, letters = Tokenizer.from_str(definition), byte_letters()
    texts, ids = [], []
    for token, k in json.loads(definition)["model"]["vocab"].items():
        try:
            texts.append(bytes(letters[c] for c in token).decode())
            ids.append(k)
        except (KeyError, UnicodeDecodeError):
            continue
    found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    pattern = regex.compile(PATTERN)
    return [t for t, k, e in zip(texts, ids, found, strict=True) if e.ids == [k] and pattern.fullmatch(t)]


class Costs(dict):
    """Pre-token: number of its tokens."""

    def __init__(self, definition: str, whole: list[str]):
        super().__init__(dict.fromkeys(whole, 1))
        from tokenizers import Tokenizer

        self.whole, self.tokenizer = whole, Tokenizer.from_str(definition)
        self.specials = [x["content"] for x in json.loads(definition)["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.findall = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:  # only pieces too long to remember
        return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def counts(self, texts: list[str]) -> list[int]:
        if len(self) > MOST:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        pieces, extra = [], []
        for text in texts:
            n = 0
            if self.split and any(s in text for s in self.specials):
                parts = self.split.split(text)
                n, found = len(parts) - 1, [p for part in parts for p in self.findall(part)]
            else:
                found = self.findall(text)
            pieces.append(found)
            extra.append(n)
        new = {p for found in pieces for p in set(found) if p not in self and len(p) <= LONG}
        if new:
            rest = list(new)
            self.update(zip(rest, map(len, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
        return [n + sum(map(self.__getitem__, found)) for n, found in zip(extra, pieces, strict=True)]


@functools.lru_cache(2)
def _costs(key: int, shared) -> Costs:
    return Costs(*shared.value)


def check_definition(definition: str) -> None:
    model = json.loads(definition)
    kind, before = model["model"], model["pre_tokenizer"]
    plain = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in model["added_tokens"])
    if kind["type"] != "BPE" or kind.get("dropout") or model["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or not plain:
        raise ValueError("only byte-level BPE without normalizer or prefix space")


def token_counts(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per row of df: id, n_bytes, n_tokens, over_limit.

    Null texts are empty: 0 bytes, 0 tokens.  The definition (a file of fixed size) is read on the driver
    and broadcast with the proven whole tokens, so executors need no file.  Repeated rows stay repeated, ids, null ones too, only
    pass through, and very long texts are read whole.  An empty table gives no rows; other columns are not read, whatever their names.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    check_definition(definition)
    shared = df.sparkSession.sparkContext.broadcast((definition, whole_tokens(definition)))
    key = hash(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        costs = _costs(key, shared)
        for batch in batches:
            for first, end, _, _ in slices(batch.column(1)):
                part = text_array(batch.column(1).slice(first, end - first))
                n = pa.array(costs.counts(part.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pc.binary_length(part).cast(pa.int64()), n, pc.greater(n, limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).transform(arrow_map, run, f"`id` {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
