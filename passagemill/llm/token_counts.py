"""Operator 6, token counts: finite-state tokenizer compilation.

Pre-tokenizer and BPE are compiled to one deterministic transducer that reads characters, state by
state as texts need it. A state holds all that later characters can depend on: which kind of word is
open (or which apostrophe may yet become a contraction), the automaton's state over token prefixes
and, for each place where a token could still begin, the last token before it and how many tokens lie
between it and now. Each transition is annotated with the change of the count, so a text's count is a
sum along its path and needs no search and no look ahead.

Every text is cut into chunks, whatever its length, and each chunk becomes a state map: where a chunk
is entered in some state, in which is it left, and with how many tokens? White space brings every
state to the start, so a map is given by what stands up to the first white space (run from the
entering state), the count behind it and the state at the end. Maps compose associatively, and a
scan of pairs composes those of all texts of a run level by level: compositions of one level don't
depend on each other.

Defined cases: a null or empty text has 0 bytes and 0 tokens. Special strings in a text count one
token each. Repeated rows give repeated results. Extra columns, whatever their names, are not looked
at. An empty table gives an empty result. Very long texts are cut as all others are; compiled states
are kept up to a number.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, read_documents
from .word_bpe import END, WHITE, WordBpe, load

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 16_384
CACHED_STATES = 200_000

#: A compiled state: from characters ("" is the end of the text) to the next state and the emitted count; under None the state's key.
Node = dict
#: A chunk's state map: text up to its first white space, tokens behind it, key of the state at its end (None without white space).
ChunkMap = tuple[str, int, tuple | None]

_WHITE, _LETTER, _NUMBER = (regex.compile(x) for x in ("[" + WHITE + "]", r"\p{L}", r"\p{N}"))
#: What an apostrophe makes a word of, with one letter or two.
ONE, TWO = "stmd", {"r": "e", "v": "e", "l": "l"}
#: What is open: nothing, letters, other marks, an apostrophe with or without a letter behind it.
NOTHING, LETTERS, MARKS, APOSTROPHE = range(4)
START = (NOTHING, "", 0, ())
OPENED = ((0, -1, 0),)


class CountTransducer:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.nodes: dict[tuple, Node] = {}
        self.start = self.node(START)

    def node(self, key: tuple) -> Node:
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = {None: key}
        return node

    def forget(self) -> None:
        """Drop compiled states if there are many; maps name states by their keys, which stay good."""
        if len(self.nodes) > CACHED_STATES:
            for node in self.nodes.values():
                node.clear()
            self.nodes.clear()
            self.start = self.node(START)

    def symbol(self, at: int, opened: tuple, symbol: int) -> tuple[int, tuple, int]:
        """One symbol of an open word: automaton state, open starts (how far back, last token before, count relative to now), emitted count."""
        bpe = self.bpe
        to = bpe.step(at, symbol)
        before = {far: (last, count) for far, last, count in opened}
        for token, n in bpe.ends[to]:
            last, count = before[n - 1]
            if bpe.whole(token) if last < 0 else bpe.follows(last, token):
                emitted = count + 1
                break
        if symbol == END:
            return 0, (), emitted
        starts, back = [(0, token, 0)], to
        while back:
            far = bpe.depth[back]
            last, count = before[far - 1]
            starts.append((far, last, count - emitted))
            back = bpe.fail[back]
        return to, tuple(starts), emitted

    def read(self, at: int, opened: tuple, chars: str) -> tuple[int, tuple, int]:
        count = 0
        for b in chars.encode("utf-8", "surrogatepass"):
            at, opened, n = self.symbol(at, opened, b)
            count += n
        return at, opened, count

    def word(self, chars: str) -> int:
        at, opened, count = self.read(0, OPENED, chars)
        return count + self.symbol(at, opened, END)[2]

    def begin(self, c: str) -> tuple[tuple, int]:
        """Key and count after a character with nothing open."""
        if not c or _WHITE.match(c):
            return START, 0
        if c == "'":
            return (APOSTROPHE, "", 0, ()), 0
        if _NUMBER.match(c):
            return START, self.word(c)
        at, opened, count = self.read(0, OPENED, c)
        return (LETTERS if _LETTER.match(c) else MARKS, "", at, opened), count

    def follow(self, key: tuple, c: str) -> tuple[tuple, int]:
        """Key and count after a character ("": the end) in a state."""
        kind, letter, at, opened = key
        if kind == NOTHING:
            return self.begin(c)
        is_letter = bool(c and _LETTER.match(c))
        is_mark = bool(c) and not is_letter and not _NUMBER.match(c) and not _WHITE.match(c)
        if kind != APOSTROPHE:
            if is_letter if kind == LETTERS else is_mark:
                at, opened, count = self.read(at, opened, c)
                return (kind, "", at, opened), count
            closed = self.symbol(at, opened, END)[2]
        elif letter:  # an apostrophe and a letter that a second one may complete
            if c == TWO[letter]:
                return START, self.word("'" + letter + c)
            middle, closed = self.begin(letter)
            then, count = self.follow(middle, c)
            return then, self.word("'") + closed + count
        elif c and c in ONE:
            return START, self.word("'" + c)
        elif c in TWO:
            return (APOSTROPHE, c, 0, ()), 0
        elif is_mark:  # the apostrophe began a run of marks
            at, opened, count = self.read(0, OPENED, "'" + c)
            return (MARKS, "", at, opened), count
        else:
            closed = self.word("'")
        then, count = self.begin(c)
        return then, closed + count

    def compile(self, node: Node, c: str) -> tuple[Node, int]:
        """The transition of a state by a character."""
        key, count = self.follow(node[None], c)
        made = node[c] = self.node(key), count
        return made

    def run(self, node: Node, text: str) -> tuple[Node, int]:
        """The state after text, and the tokens emitted."""
        count, chars = 0, iter(text)
        while True:
            try:
                for c in chars:
                    node, n = node[c]
                    count += n
                return node, count
            except KeyError:
                node, n = self.compile(node, c)
                count += n

    def chunk(self, text: str) -> ChunkMap:
        self.forget()
        white = _WHITE.search(text)
        if white is None:
            return text, 0, None
        node, count = self.run(self.start, text[white.end() :])
        return text[: white.end()], count, node[None]

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a's chunk followed by b's."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        node, count = self.run(self.node(a[2]), b[0])
        return a[0], a[1] + count + b[1], node[None] if b[2] is None else b[2]

    def total(self, made: ChunkMap) -> int:
        """Tokens of a text whose map this is."""
        node, count = self.run(self.start, made[0])
        if made[2] is not None:
            node = self.node(made[2])
        return count + made[1] + (node.get("") or self.compile(node, ""))[1]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of normalized texts without special strings."""
        maps = [[self.chunk(t[i : i + CHUNK]) for i in range(0, len(t), CHUNK)] or [("", 0, None)] for t in texts]
        while any(len(m) > 1 for m in maps):  # one level of the scan: neighbours of all texts
            maps = [[self.compose(*m[i : i + 2]) if i + 1 < len(m) else m[i] for i in range(0, len(m), 2)] for m in maps]
        return [self.total(m[0]) for m in maps]

    def tokens(self, texts: list[str]) -> list[int]:
        parts = [[p for p in (self.bpe.special_split.split(t) if "<|" in t else [t]) if p] for t in texts]
        plain = self.count([normalize(p) for x in parts for p in x if p not in self.bpe.special])
        counts = iter(plain)
        return [sum(1 if p in self.bpe.special else next(counts) for p in x) for x in parts]


def normalize(text: str) -> str:
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


_transducers: dict[str, CountTransducer] = {}


def count_tokens(docs: DataFrame, keep: list[str], path: str) -> DataFrame:
    """keep's columns and n_tokens long of the column text."""

    def counts(texts: list[str]) -> list:
        if path not in _transducers:
            _transducers[path] = CountTransducer(load(path))
        tokens = _transducers[path].tokens
        return [np.array(tokens(texts), np.int64)]

    return map_texts(docs, counts, "n_tokens long", keep)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, ["doc_id", "n_bytes"], public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
