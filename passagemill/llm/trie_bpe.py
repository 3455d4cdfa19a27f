"""Operator 3, BPE encoding and decoding: prefix-sharing trie traversal.

The distinct words of a run of texts go into a trie. A depth-first walk carries, along the path, the
last token of each prefix's encoding; a prefix that many words share is encoded once. A word's ids
are read back from its end by jumping over the last tokens. Decoding joins the tokens of the ids.

Defined cases: a null or empty text has no ids and decodes to ''. Special strings inside a text
become their special ids. Repeated rows give repeated results. An empty table gives an empty result.
Very long texts are encoded whole, as one run. Extra columns, whatever their names, are not looked at.
Memory: words are cached up to a number, and texts come in runs of about 1 MB.
"""

from __future__ import annotations

import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, read_documents, with_fields
from .word_bpe import END, WordBpe, load, token_table

TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 200_000
pack = [struct.Struct(f"<{n}i").pack for n in range(16)]


class TrieEncoder:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.cache: dict[str, bytes] = {}

    def learn(self, new: set[str]) -> None:
        """Encode words that the cache lacks: ids as packed 32-bit integers."""
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache.clear()
        root: dict = {}
        for word in new:
            node = root
            for c in word.encode("utf-8", "surrogatepass"):
                to = node.get(c)
                if to is None:
                    to = node[c] = {}
                node = to
            node[END] = word
        bpe, step, ends, size, whole = self.bpe, self.bpe.step, self.bpe.ends, self.bpe.size, self.bpe.whole
        fits, next_state, follows = bpe._fits, bpe.next, bpe.follows
        state, last = [0] * 64, [-1] * 64  # along the path: automaton state, last token of the prefix's encoding
        stack = [(c, to, 1) for c, to in root.items()]
        pop = stack.pop
        while stack:
            c, node, d = pop()
            at = state[d - 1]
            s = next_state.get(at * 257 + c)
            if s is None:
                s = step(at, c)
            for token, n in ends[s]:
                before = last[d - n]
                if before < 0:
                    if whole(token):
                        break
                else:
                    ok = fits.get(before << 16 | token)
                    if ok or ok is None and follows(before, token):
                        break
            if c == END:
                ids = [token]
                at = d - n
                while at:
                    token = last[at]
                    ids.append(token)
                    at -= size[token]
                ids.reverse()
                self.cache[node] = pack[len(ids)](*ids) if len(ids) < len(pack) else struct.pack(f"<{len(ids)}i", *ids)
                continue
            if d == len(state):
                state.append(0)
                last.append(-1)
            state[d], last[d] = s, token
            for x in node:
                stack.append((x, node[x], d + 1))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        parts = [self.bpe.pieces(t) for t in texts]
        known = self.cache
        new: set[str] = set()
        for part in parts:
            for _, w in part:
                if w:
                    new.update(w)
        new.difference_update(known)
        if new:
            size = len(known)
            self.learn(new)
            if len(known) < size + len(new):  # the cache was emptied: what these texts need comes back
                self.learn({x for part in parts for _, w in part if w for x in w} - known.keys())
        get, special = known.__getitem__, self.bpe.special
        return [b"".join([np.int32(special[s]).tobytes() if w is None else b"".join(map(get, w)) for s, w in part]) for part in parts]


_encoders: dict[str, TrieEncoder] = {}


def _encoder(path: str) -> TrieEncoder:
    if path not in _encoders:
        _encoders[path] = TrieEncoder(load(path))
    return _encoders[path]


def _ids(path: str, texts: list[str]) -> pa.ListArray:
    packed = _encoder(path).encode(texts)
    ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _decoded(token: list[str], ids: pa.ListArray) -> pa.StringArray:
    show = token.__getitem__
    return pa.array([" ".join(map(show, x.values.to_numpy().tolist())) if x.is_valid else None for x in ids], pa.string())


def _forget(path: str) -> None:
    if path in _encoders:
        _encoders[path].cache.clear()
        _encoders[path].bpe.forget()


def encode(docs: DataFrame, keep: list[str], path: str) -> DataFrame:
    """keep's columns and token_ids array<int> of the column text."""
    return map_texts(docs, lambda texts: [_ids(path, texts)], "token_ids array<int>", keep, after=lambda: _forget(path))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded: the tokens of token_ids as the file's library shows them, special ones too."""
    schema = with_fields(encoded, encoded.columns, "decoded string")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(token_table(path), part.column("token_ids"))], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def roundtrip(docs: DataFrame, keep: list[str], path: str) -> DataFrame:
    """What decode(encode(docs, keep, path), path) gives, by one Python worker for each core instead of two."""

    def both(texts: list[str]) -> list:
        ids = _ids(path, texts)
        return [ids, _decoded(_encoder(path).bpe.token, ids)]

    return map_texts(docs, both, "token_ids array<int>, decoded string", keep, after=lambda: _forget(path))


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, more's columns, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded documents."""
    return decoded.select(
        "doc_id",
        *more,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return digests(roundtrip(read_documents(spark, sf_dir), ["doc_id"], path))
