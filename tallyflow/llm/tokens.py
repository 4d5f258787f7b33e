"""Token counts with the whole-token shortcut (operator 7), and the token ids that packing needs.

Byte-level BPE cuts a text into pre-tokens and merges each on its own.  A
vocabulary string that the library encodes alone as exactly one token is one
token wherever it is a pre-token, because merging sees nothing else.  Which
strings those are is proved once, by encoding the whole vocabulary with the
library (``prove_whole_tokens``); pre-tokens among them count one without any
merging, and only the rest is merged.

Strings of special tokens inside a text are taken out first, as the library
does by default; each is one token.

Edge cases: a null text counts as empty: no bytes, no tokens.  Null, equal and
repeated ids are counted row by row.  Further columns are ignored unless named
in ``keep``; one with the name of a result is then replaced by it.  An empty
table gives no rows.  A long text is cut to pre-tokens whole, in one task.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame

from . import exchange

#: pre-tokens of byte-level BPE, as published with GPT-2 (fixed values)
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIMIT = 512
#: entries of a worker's memo of merged pre-tokens; when full it starts anew
MEMO = 400_000


def byte_alphabet() -> dict[str, int]:
    """The published stand-ins of byte-level BPE: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE of a ``tokenizers`` file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_alphabet()
        self.ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.encoding = tiktoken.Encoding(name="byte-bpe", pat_str=PRE_TOKEN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.pre_tokens = regex.compile(PRE_TOKEN).findall

    @functools.cached_property
    def whole(self) -> dict[str, int]:
        return prove_whole_tokens(self)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text as the library gives them, special strings included."""
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def count(self, text: str, memo: dict[str, int]) -> int:
        """Tokens of a text; ``memo`` has the whole tokens, with 1 for each, and what was merged before."""
        total = 0
        for k, run in enumerate(self.split_special(text) if self.split_special else [text]):
            if k % 2:
                total += 1
                continue
            found = self.pre_tokens(run)
            counts = list(map(memo.get, found))
            try:
                total += sum(counts)
            except TypeError:
                for i, c in enumerate(counts):
                    if c is None:
                        c = memo.get(found[i])
                        if c is None:
                            c = memo[found[i]] = len(self.encoding.encode_ordinary(found[i]))
                    total += c
        return total


def prove_whole_tokens(bpe: ByteBpe) -> dict[str, int]:
    """Vocabulary strings that the library itself encodes alone as their one token."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.path)
    library.encode_special_tokens = True
    texts, ids = [], []
    for raw, i in bpe.ranks.items():
        try:
            texts.append(raw.decode("utf-8"))
            ids.append(i)
        except UnicodeDecodeError:  # part of a character: no text is this pre-token
            continue
    return {t: i for t, i, e in zip(texts, ids, library.encode_batch(texts, add_special_tokens=False), strict=True) if e.ids == [i]}


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (the id if none are named), ``n_bytes``, ``n_tokens``, ``over_limit`` of each row.

    ``tokenizer`` is the path of a byte-level BPE file that every executor has.
    The whole-token table (at most one entry a vocabulary string) is proved on
    the driver and sent with the code.
    """
    exchange.ship(docs.sparkSession)
    path = tokenizer or default_path()
    proved = list(load(path).whole)
    memo: dict[str, int] = {}

    def run(b: dict[str, pa.Array]) -> dict[str, pa.Array]:
        bpe = load(path)
        counts = []
        for t in b["text"]:
            if len(memo) < len(proved) or len(memo) > MEMO:
                memo.clear()
                memo.update(dict.fromkeys(proved, 1))
            counts.append(bpe.count(t.as_py() or "", memo))
        n = pa.array(counts, pa.int64())
        return {"n_bytes": pc.binary_length(b["text"].cast(pa.large_binary())).fill_null(0).cast(pa.int64()), "n_tokens": n, "over_limit": pc.greater(n, limit)}

    return exchange.annotate(docs, [id_col] if keep is None else keep, {"text": text_col}, run, {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"})
