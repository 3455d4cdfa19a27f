"""Word-level BPE from a tokenizer file: what encoding, decoding and counting share.

The file holds a byte-level BPE with a mark on the last symbol of a word. Two facts carry all that
follows. (1) The encoding of a prefix of a word is its last token put behind the encoding of a
shorter prefix. (2) A token may follow another exactly if undoing their merges from the last to the
first never meets a merge across their border that would have come earlier. So one last token for
each prefix is the whole state, and it is found among the tokens that end there.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import unicodedata

import regex

#: The pre-tokenizer's pattern, and white space as the tokenizer file's library has it.
WHITE = r"\t-\r \x85\xa0  -     　"
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + WHITE + r"\p{L}\p{N}]+")
PRETOKEN_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
REMEMBERED = 400_000  #: transitions and token pairs that a worker keeps, each
END = 256  #: the symbol behind the last byte of a word


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizer file as an automaton over its tokens, compiled as texts need it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.suffix or spec["decoder"] is not None:
            raise ValueError("a word-level BPE file without decoder is needed")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocab: dict[str, int] = model["vocab"]
        self.token = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = text
        n = len(self.token)
        self.made, self.left, self.right = [-1] * n, [0] * n, [0] * n
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = vocab[self.token[a] + self.token[b]]
            self.merge[a << 16 | b] = rank, whole
            self.made[whole], self.left[whole], self.right[whole] = rank, a, b
        self._automaton(vocab)
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    def _automaton(self, vocab: dict[str, int]) -> None:
        """A trie of all tokens with failure links; at each state the tokens that end there, the longest first."""
        number = {c: b for b, c in enumerate(byte_symbols())}
        self.size = [0] * len(self.token)
        children: list[dict[int, int]] = [{}]
        own: dict[int, int] = {}
        for text, i in vocab.items():
            end = text.endswith(self.suffix) and text != self.suffix
            symbols = [number[c] for c in (text[: -len(self.suffix)] if end else text)] + [END] * end
            at = 0
            for c in symbols:
                at = children[at].setdefault(c, len(children))
                if at == len(children):
                    children.append({})
            own[at], self.size[i] = i, len(symbols)
        n = len(children)
        self.children, self.fail, self.depth = children, [0] * n, [0] * n
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * n
        queue = [0]
        for at in queue:
            for c, to in children[at].items():
                back = self.fail[at]
                while back and c not in children[back]:
                    back = self.fail[back]
                self.fail[to] = children[back].get(c, 0) if at else 0
                self.depth[to] = self.depth[at] + 1
                token = own.get(to)
                self.ends[to] = (((token, self.size[token]),) if token is not None else ()) + self.ends[self.fail[to]]
                queue.append(to)
        self.next: dict[int, int] = {}

    def forget(self) -> None:
        """Drop what texts made it remember."""
        self.next.clear()
        self._fits.clear()

    def step(self, state: int, symbol: int) -> int:
        """The automaton's next state."""
        key = state * 257 + symbol
        to = self.next.get(key)
        if to is None:
            if len(self.next) > REMEMBERED:
                self.next.clear()
            at = state
            while at and symbol not in self.children[at]:
                at = self.fail[at]
            to = self.next[key] = self.children[at].get(symbol, 0)
        return to

    def whole(self, token: int) -> bool:
        """Whether the merges make this token of its own text: some tokens of a file can't be reached."""
        known = self._whole.get(token)
        if known is None:
            a, b, rank = self.left[token], self.right[token], self.made[token]
            known = self._whole[token] = rank < 0 or (self.whole(a) and self.whole(b) and self._apart(a, b, rank))
        return known

    def _apart(self, a: int, b: int, bound: int) -> bool:
        """Whether no merge across the border of a and b comes before bound and before those that made a and b."""
        while True:
            across = self.merge.get(a << 16 | b)
            if across is not None and across[0] < bound:
                return False
            made_a, made_b = self.made[a], self.made[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:  # undo what was made last; of equal merges the right one
                bound, a = made_a, self.right[a]
            else:
                bound, b = made_b + 1, self.left[b]

    def follows(self, last: int, token: int) -> bool:
        key = last << 16 | token
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
            known = self._fits[key] = self.whole(token) and self._apart(last, token, 1 << 40)
        return known

    def pieces(self, text: str) -> list[tuple[str, list[str] | None]]:
        """Special tokens (with None) and, between them, the words of the normalized text."""
        out: list[tuple[str, list[str] | None]] = []
        parts = self.special_split.split(text) if "<|" in text else [text]
        for part in parts:
            if part in self.special:
                out.append((part, None))
            elif part:
                out.append(("", words(part)))
        return out


def words(text: str) -> list[str]:
    """Words of one stretch of text: composed, lower case, split by the pattern."""
    if text.isascii():
        return PRETOKEN_ASCII.findall(text.lower())
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return PRETOKEN.findall(text.replace("Σ", "σ").lower())  # lower() looks at the neighbours of this letter alone


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The tokenizer, once for each Python worker."""
    made = WordBpe(path)
    gc.freeze()  # its many small tables hold no cycles, and neither do tries: the cycle collector need not walk them
    gc.set_threshold(1_000_000, 100, 100)
    return made


@functools.lru_cache(maxsize=2)
def token_table(path: str) -> list[str]:
    """Tokens by id, without the automaton: all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    out = [""] * (max(ids.values()) + 1)
    for text, i in ids.items():
        out[i] = text
    return out
