"""Byte-level BPE encoding and decoding, with tree concatenation of long unsplit text.

The pre-tokenizer splits a text into pieces that are encoded one by one.  A
piece that it leaves unsplit over a length is cut in halves, down to leaves
which are encoded in parallel, by threads that run without the interpreter's
lock.  Two encoded halves are joined by encoding a
window of tokens around the join anew, growing it until the tokens at both of
its edges agree with their outer neighbours.  Agreement is exact: a sequence of
tokens is the encoding of its bytes if and only if each adjacent pair is the
encoding of that pair's bytes, so it is enough that the pairs at the edges of
the window are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import columns

#: Bytes of a piece that is halved, and of a leaf.
LONG = 2048
#: Threads that encode the leaves of a piece.
THREADS = 4
#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format.

    Encodes as that library does without adding special tokens (strings of
    special tokens in a text become those tokens), and decodes as it does with
    skip_special_tokens=False: bytes that are no UTF-8 become U+FFFD.
    """

    def __init__(self, path: str, threads: int = THREADS):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        of = _byte_of_char()
        vocab = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in of for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {t: i for t, i in vocab.items() if i not in set(self.special.values())}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[bytes(of[c] for c in a + b)] for a, b in merges]
        if made != sorted(made):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        self.core = tiktoken.Encoding("arborix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.core._core_bpe.encode_single_piece
        self.leaf = tiktoken.Encoding("arborix-leaf", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes[i] = t
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.threads = threads

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; null encodes as the empty text."""
        if not text:
            return []
        if self.split is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        out: list[int] = []
        for k, part in enumerate(self.split.split(text)):
            out += [self.special[part]] if k % 2 else self._ordinary(part)
        return out

    def _ordinary(self, text: str) -> list[int]:
        if len(text) < LONG // 4 or not _has_long_run(text):
            return self.core.encode_ordinary(text)
        import regex

        out: list[int] = []
        for m in regex.finditer(PATTERN, text):  # over the whole text: a piece's end depends on what follows
            piece = m.group().encode("utf-8", "replace")
            out += self.tree(piece.decode()) if len(piece) > LONG else self.piece(piece)
        return out

    def tree(self, piece: str) -> list[int]:
        """The ids of one unsplit piece, by halves."""
        leaves, most = [piece], LONG
        while any(len(x.encode()) > most and len(x) > 1 for x in leaves):
            leaves = [h for x in leaves for h in ((x[: len(x) // 2], x[len(x) // 2 :]) if len(x.encode()) > most and len(x) > 1 else (x,))]
        if self.threads > 1 and len(leaves) > 1:
            with ThreadPoolExecutor(self.threads) as pool:
                done = list(pool.map(self.leaf, leaves))
        else:
            done = [self.leaf(x) for x in leaves]
        while len(done) > 1:
            done = [self.join(done[i], done[i + 1]) if i + 1 < len(done) else done[i] for i in range(0, len(done), 2)]
        return done[0]

    def agree(self, a: int, b: int) -> bool:
        """Whether two tokens stand next to each other in the encoding of their bytes."""
        return self.piece(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings, one after the other."""
        if not left or not right or self.agree(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.piece(b"".join(map(self.bytes.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.agree(left[i - 1], window[0])) and (j == len(right) or self.agree(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_SPACE = re.compile(r"\s{%d,}" % (LONG // 4))


def _has_long_run(text: str) -> bool:
    return max(map(len, text.split()), default=0) >= LONG // 4 or _SPACE.search(text) is not None


@cache
def load(path: str, threads: int = THREADS) -> ByteBPE:
    """The vocabulary at a path, read once in each worker."""
    return ByteBPE(path, threads)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", threads: int = THREADS, decoded_col: str | None = None) -> DataFrame:
    """docs with their ids as a further column (array of int); a column of that name is replaced.

    With decoded_col the ids' text is added in the same pass, so that one
    worker and not two serve a task.  Null and empty texts have no ids and
    decode to the empty text.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        bpe = load(path, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [np.array(bpe.encode(t.as_py()), np.int32) for t in part.column(0)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                made = [pa.ListArray.from_arrays(ends, np.concatenate([*ids, np.empty(0, np.int32)]))]
                if decoded_col:
                    made.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *made], names=[*(f"c{k}" for k in range(len(others))), *new])

    held = [(c, x) for c, x in zip(docs.columns, columns(docs), strict=True) if c not in (ids_col, decoded_col)]
    others = [c for c, _ in held]
    new = ["ids", "decoded"] if decoded_col else ["ids"]
    plain = docs.select(F.col(text_col).cast("string").alias("t"), *[x.alias(f"c{k}") for k, (_, x) in enumerate(held)])
    schema = ", ".join([*(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(others)), "ids array<int>", *(["decoded string"] if decoded_col else [])])
    return plain.mapInArrow(run, schema).toDF(*others, ids_col, *([decoded_col] if decoded_col else []))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text of their ids as a further column; null ids give the empty text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(ids):
        bpe = load(path)
        return ids.map(lambda x: bpe.decode([] if x is None else x))

    return rows.withColumn(text_col, run(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = THREADS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text.

    Encodes and decodes in one pass, so that the ids need not travel.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        bpe = load(path, threads)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
