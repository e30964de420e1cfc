"""BPE encoding and decoding of whole texts, long ones by tree concatenation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

#: Texts of more code points are cut into leaves of LEAF code points each.
LONG, LEAF = 16_384, 8_192
#: Fixed value: the public byte-level pre-tokenizer pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CODECS: dict[str, Codec] = {}


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary of the tokenizers library's JSON form."""

    def __init__(self, source: str):
        import tiktoken

        spec = json.loads(source)
        byte = _alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in special.items()}

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all")

    def decode_bytes(self, ids: list[int]) -> bytes:
        of = self.bytes
        return b"".join([of[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def _starts(self, ids: list[int]) -> list[int]:
        """The byte at which each token starts, and the end."""
        out, at = [0], 0
        for i in ids:
            out.append(at := at + len(self.bytes[i]))
        return out

    def join(self, left: list[int], right: list[int], window: int = 16) -> list[int]:
        """The encoding of the text of left and right together.

        A window of tokens around the join is encoded anew, and grows until it gives, on either side, two successive
        tokens that this side has at the same bytes. All adjacent tokens in the result then stood side by side in the
        encoding of one text, which makes the whole the encoding of the joined text. A window that reaches a side's
        end needs no agreement there.
        """
        if not left or not right:
            return left or right
        of = self.bytes
        while True:
            a, b = max(0, len(left) - window), min(window, len(right))
            while a and of[left[a]][0] & 0xC0 == 0x80:
                a -= 1
            while b < len(right) and of[right[b]][0] & 0xC0 == 0x80:
                b += 1
            head, tail = left[a:], right[:b]
            try:
                got = self.encode(self.decode_bytes(head + tail).decode())
            except UnicodeDecodeError:  # a leaf's edge inside a character; leaves are cut between characters, so never
                got = None
            if got is not None:
                if a == 0 and b == len(right):
                    return got
                at = self._starts(got)
                mine, cut = self._starts(head), len(self.decode_bytes(head))
                first = 0 if a == 0 else self._agree(got, at, head, mine, 0, cut)
                theirs = [cut + x for x in self._starts(tail)]
                last = (len(got), b) if b == len(right) else self._agree(got, at, tail, theirs, cut, theirs[-1])
                if a == 0:
                    first = (0, 0)
                if first is not None and last is not None:
                    return left[: a + first[1]] + got[first[0] : last[0]] + right[last[1] :]
            window *= 2

    @staticmethod
    def _agree(got: list[int], at: list[int], side: list[int], starts: list[int], low: int, high: int) -> tuple[int, int] | None:
        """Where (in got, in side) both have the same two successive tokens, about the middle of what they share."""
        place = {s: k for k, s in enumerate(starts[:-1])}
        both = [
            (g + 1, k + 1)
            for g in range(len(got) - 1)
            if low <= at[g] and at[g + 2] <= high and (k := place.get(at[g])) is not None and k + 1 < len(side) and side[k] == got[g] and side[k + 1] == got[g + 1]
        ]
        return both[len(both) // 2] if both else None

    def tree(self, leaves: list[list[int]]) -> list[int]:
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else []

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def codec(source: str) -> Codec:
    """One codec a vocabulary in each Python process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(source)
    return _CODECS[key]


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary: str, long: int = LONG, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs (doc_id, text).

    vocabulary is the path, on the driver, of a byte-level BPE vocabulary; its text (a fixed few MB) goes to the tasks.
    Special strings in a text become special tokens. Texts of up to `long` code points are encoded where they are read.
    Longer ones are cut into leaves, which all tasks encode in parallel; equal texts share their leaves, so thousands
    of copies of one text are encoded once. The leaves' ids then meet by text, and are joined pairwise.

    Null text counts as empty: no tokens, and the digests of nothing. Repeated rows each get their row.
    An empty table gives no rows. Other columns are left aside.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text"))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(source.value)
        for batch in batches:
            out = [c.digest(c.encode(t)) for t in batch["text"]]
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=batch["doc_id"].array)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                at = range(0, len(text), leaf)
                yield pd.DataFrame({"key": key, "leaf": range(len(at)), "piece": [text[i : i + leaf] for i in at]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(source.value)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "leaf": batch["leaf"], "ids": [np.asarray(c.encode(t), dtype="<u4").tobytes() for t in batch["piece"]]})

    def join(group: pd.DataFrame) -> pd.DataFrame:
        c = codec(source.value)
        leaves = [np.frombuffer(b, dtype="<u4").tolist() for b in group.sort_values("leaf")["ids"]]
        return pd.DataFrame([(group["key"].iloc[0], *c.digest(c.tree(leaves)))], columns=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    short = rows.where(F.char_length("text") <= long).mapInPandas(whole, f"doc_id long, {DIGEST}")
    keyed = rows.where(F.char_length("text") > long).select("doc_id", F.sha2("text", 256).alias("key"), "text")
    done = (
        keyed.select("key", "text")
        .mapInPandas(split, "key string, leaf int, piece string")
        .distinct()
        .mapInPandas(encode, "key string, leaf int, ids binary")
        .groupBy("key")
        .applyInPandas(join, f"key string, {DIGEST}")
    )
    return short.unionByName(keyed.select("doc_id", "key").join(done, "key").drop("key"))
