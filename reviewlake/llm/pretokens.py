"""Pre-tokens of the public tokenizers: a quick split for common alphabets, the library's own split otherwise.

A pre-token is encoded on its own by byte pair encoding, so that whatever is known of it (its ids, their number)
holds wherever it occurs. Texts made of ASCII, Latin-1, Latin Extended-A and B and common dashes and quotes are split by
``re`` with classes written out; on these characters the Unicode tables of all libraries agree and no normal form
changes them. Any other text is split by the tokenizer file's own rules.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import tiktoken
from tokenizers import Tokenizer

_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0x250)]


def _ranges(kind: str) -> str:
    inside = [c for c in _PLAIN if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c in inside if c - 1 not in set(inside)]
    ends = [c for c in inside if c + 1 not in set(inside)]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


_L, _N = _ranges("L"), _ranges("N")
OTHER = re.compile("[^\t\n\r -~\xa1-ɏ‐-‧]")

# The split patterns of the two tokenizer files, with classes written out.
BYTE_SPLIT = re.compile(rf" ?[{_L}]+|'(?:[sdmt]|ll|ve|re)| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
WORD_SPLIT = re.compile(rf"'(?:[sdmt]|ll|ve|re)|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Splitter:
    """Splits texts into pre-tokens; special strings of the tokenizer come out as items of their own."""

    def __init__(self, tokenizer: Tokenizer, lower: bool):
        self.tokenizer, self.lower = tokenizer, lower
        self.split = WORD_SPLIT.findall if lower else BYTE_SPLIT.findall
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        found = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({found})") if found else None

    def __call__(self, text: str) -> list[str]:
        if "<|" in text and self.cut and self.cut.search(text):
            parts = self.cut.split(text)
            return [w for p in parts for w in ([p] if p in self.special else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if OTHER.search(text) is None:
            return self.split(text.lower() if self.lower else text)
        normal = self.tokenizer.normalizer
        text = normal.normalize_str(text) if normal else text
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


class Recent:
    """Values of words in two generations: what is still in use moves to the younger one, the rest goes."""

    def __init__(self, make, most: int = 250_000):
        self.make, self.most = make, most  # make: list of words → their values
        self.young, self.old = {}, {}

    def of(self, texts: list[list[str]], besides=frozenset()) -> dict:
        """A dict with the value of every word of the texts that is not in ``besides``."""
        words: set[str] = set()
        for text in texts:
            words.update(text)
        missing = words.difference(self.young, besides)
        if len(self.young) + len(missing) > self.most:
            self.old, self.young = self.young, {}
            missing = words.difference(besides)
        young, old = self.young, self.old
        new = []
        for word in missing:
            value = old.get(word)
            if value is None:
                new.append(word)
            else:
                young[word] = value
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            young.update(zip(part, self.make(part), strict=True))
        return young


def by_library(tokenizer: Tokenizer, of):
    """Values by the library's own encoding: ``of`` the ids of each word."""
    return lambda words: [of(e.ids) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def _byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Rank of each token, by its bytes, if the model is byte-level BPE whose ids rise with its merges; else None."""
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain:
        return None
    vocab = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merged = [(a + b, vocab.get(a + b, -1)) for a, b in pairs]
    ids = [i for _, i in merged]
    # printable bytes stand for themselves, the others for the characters from 256 on, in order
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
    if not all(c in vocab for c in letters) or any(a >= b for a, b in zip(ids, ids[1:])) or ids and ids[0] <= max(vocab[c] for c in letters):
        return None
    return {bytes([b]): vocab[c] for c, b in letters.items()} | {bytes(letters[c] for c in w): i for w, i in merged}


def packed_ids(tokenizer: Tokenizer, code: str):
    """For lists of pre-tokens their ids as packed arrays of type ``code`` (of module array): by ranks of bytes where the file
    allows it, which costs a few microseconds a word, by the library otherwise. Both give the same ids."""
    told = json.loads(tokenizer.to_str())
    ranks = _byte_ranks(told["model"]) if (told.get("pre_tokenizer") or {}).get("type") == "ByteLevel" else None
    if ranks is None:
        return by_library(tokenizer, lambda ids: array(code, ids).tobytes())
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    piece = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda words: [array(code, [special[w]] if w in special else piece(w.encode())).tobytes() for w in words]
