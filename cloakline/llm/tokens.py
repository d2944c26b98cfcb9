"""Token ids by the tokenizers library, with a bounded memory of words already encoded.

A text whose characters are all in a set where the word split is known exactly is cut into words here, and only words
not met before go to the library; any other text goes to the library whole. Both give the same ids (tests compare them).
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np

#: Latin-1 without the control characters on which white-space definitions differ, and its letters and numerals.
SAFE = re.compile(r"[\x00-\x1b\x20-\x84\x86-\xff]*")
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
SPLITS = {
    # A byte-level pre-tokenizer's own split.
    "ByteLevel": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"),
    # Words, single digits and runs of other characters, white space dropped.
    "Words": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+"),
}
WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_chars() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


BYTE_CHARS = byte_chars()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. Strings of special tokens in a text are ordinary text.

    Words are remembered in two generations of at most `most_words` each: a full young generation becomes the old one,
    and words met again come back to the young one.
    """

    def __init__(self, path: str, most_words: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core already
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.split, self.lower, self.most = None, False, most_words
        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        pre, norm = setup["pre_tokenizer"], setup["normalizer"]
        if norm is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.split = SPLITS["ByteLevel"]
        elif (
            norm is not None
            and [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and pre["type"] == "Sequence"
            and pre["pretokenizers"][0].get("pattern") == {"Regex": WORDS_PATTERN}
        ):
            self.split, self.lower = SPLITS["Words"], True
        self.whole.model._resize_cache(0)  # words are remembered here
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        back = {w: ids for w in words if (ids := self.old.get(w)) is not None}
        cut = self.whole.model.tokenize  # the library's BPE on a word that is split off already
        for w in words.difference(back):
            ids = [t.id for t in cut(w.encode().decode("latin-1").translate(BYTE_CHARS))]
            back[w] = struct.pack(f"<{len(ids)}I", *ids)
        self.known |= back

    def encode_all(self, texts: list[str], most_chars: int = 1_000_000) -> Iterator[bytes]:
        """Ids of each text. Texts go in runs of about most_chars; a run's words not met before are encoded once."""
        run, size = [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= most_chars:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        out: list[bytes | None] = []
        later, new, get = [], set(), self.known.get
        for k, text in enumerate(texts):
            if self.split is None or not SAFE.fullmatch(text):
                out.append(self._library([text])[0])
                continue
            words = self.split.findall(text.lower() if self.lower else text)
            ids = list(map(get, words))
            if None in ids:
                gaps = [(n, words[n]) for n, x in enumerate(ids) if x is None]
                new.update([w for _, w in gaps])
                later.append((k, ids, gaps))
                out.append(None)
            else:
                out.append(b"".join(ids))
        if later:
            self._learn(new)
            for k, ids, gaps in later:
                for n, word in gaps:
                    ids[n] = self.known[word]
                out[k] = b"".join(ids)
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, which runs many tasks."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
