"""Exact byte-level BPE through a bounded cache of space-delimited pieces.

A byte-level BPE of this kind first cuts the text by a pattern that never reaches back, so the text may be cut
before every single space that stands between two non-space characters: the pieces are then encoded on their own.
Each distinct piece is encoded once while it stays in the cache.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

from lodestone.llm.common import kept

SPLIT = re.compile(r" (?<=\S )(?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    """The library's tokenizer without truncation and padding, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    tk.no_truncation()
    tk.no_padding()
    return tk


#: The cut of byte-level BPE, as the library's pre-tokenizer has it (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to this character the libraries' Unicode tables agree, however old.
LATIN = "\u024f"


def quick_core(tk):
    """The same BPE in tiktoken's faster core and its tokens' lengths, or None where they might differ.

    The core merges the pair whose union has the least id. That is the library's order of merges if ids ascend with
    the merges and if every token, alone, is merged to itself: inside a token no other pair can then stand at the
    end, for merges within a stretch of text don't depend on what lies around it.
    """
    import json

    import tiktoken

    spec = json.loads(tk.to_str())
    model, cut, alphabet = spec["model"], spec["pre_tokenizer"] or {}, byte_alphabet()
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or spec["normalizer"] or spec["post_processor"] or {k: cut.get(k) for k in plain} != plain:
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    added = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(set(merged)) or len(merged) + 256 != len(vocab):
        return None
    if not all(set(t) <= alphabet.keys() for t in vocab) or not all(c in vocab for c in alphabet):
        return None
    if any([x.value for x in tk.model.tokenize(t)] != [t] for t in vocab):
        return None
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
    lengths = np.zeros(max(vocab.values()) + 1, np.int64)
    for t, i in vocab.items():
        lengths[i] = len(t)
    core = tiktoken.Encoding("quick", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_ordinary, lengths, added


class WordCoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    cache_words bounds the memory: the cache is emptied when it has grown beyond that many pieces.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        self.tk, self.cache_words = load(path), cache_words
        self.quick, self.lengths, self.added = quick_core(self.tk) or (None, None, set())
        self.spaced: dict[str, bytes] = {}
        self.odd: set[str] = {""}

    def _easy(self, text: str) -> bool:
        return self.quick is not None and (text.isascii() or max(text) <= LATIN) and not any(a in text for a in self.added)

    def _learn(self, parts: set[str]) -> None:
        easy, hard = [], []
        for p in parts:
            if not p or p[0].isspace() or p[-1].isspace():
                self.odd.add(p)
            elif self._easy(p):
                easy.append(p)
            else:
                hard.append(p)
        if hard:
            got = self.tk.encode_batch([" " + p for p in hard], add_special_tokens=False)
            self.spaced.update(zip(hard, (np.array(e.ids, "<u4").tobytes() for e in got), strict=True))
        if easy:  # as one text, cut again where the pieces' bytes end
            ids = np.array(self.quick(" " + " ".join(easy)), "<u4")
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in easy]) + np.arange(1, len(easy) + 1)
            at = (4 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1)).tolist()
            code = ids.tobytes()
            self.spaced.update(zip(easy, [code[a:b] for a, b in zip([0, *at], at, strict=False)], strict=True))

    def _alone(self, text: str) -> bytes:
        if not text:
            return b""
        ids = self.quick(text) if self._easy(text) else self.tk.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) > self.cache_words:
            self.spaced = {}
        if len(self.odd) > self.cache_words:
            self.odd = {""}
        split = [t.split(" ") for t in texts]
        first = [parts.pop(0) for parts in split]
        missing: set[str] = set()
        for parts in split:
            missing.update(parts)
        self._learn({p for p in missing if p not in self.spaced and p not in self.odd})
        out, get = [], self.spaced.__getitem__
        for text, head, parts in zip(texts, first, split, strict=True):
            try:
                out.append(self._alone(head) + b"".join(map(get, parts)))
            except KeyError:  # runs of white space: cut only where that is safe
                head, *parts = SPLIT.split(text)
                tail = parts.pop() if parts and parts[-1][-1:].isspace() else None
                self._learn({p for p in parts if p not in self.spaced})
                out.append(self._alone(head) + b"".join(map(get, parts)) + (self._alone(" " + tail) if tail is not None else b""))
        return out


def coder(path: str, cache_words: int) -> WordCoder:
    """One coder for all tasks of a worker, until another operator runs there."""
    return kept("bpe", ("coder", path, cache_words), lambda: WordCoder(path, cache_words))


def decoder(path: str) -> Decoder:
    return kept("bpe", ("decoder", path), lambda: Decoder(load(path)))


class Decoder:
    """ids to text as the library's decode does: the tokens' bytes, joined, invalid UTF-8 replaced."""

    def __init__(self, tk):
        from tokenizers.pre_tokenizers import ByteLevel

        alphabet = byte_alphabet()
        assert set(alphabet) == set(ByteLevel.alphabet())
        self.table = []
        for i in range(tk.get_vocab_size()):
            token = tk.id_to_token(i)
            if token is None:
                self.table.append(b"")
            elif all(c in alphabet for c in token):
                self.table.append(bytes(alphabet[c] for c in token))
            else:
                self.table.append(token.encode())

    def bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def text(self, ids: list[int]) -> str:
        return self.bytes(ids).decode("utf-8", "replace")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    keep = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def crc(data: bytes) -> int:
    return zlib.crc32(data)
