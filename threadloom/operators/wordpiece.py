"""Word pieces: greedy longest match over a vocabulary, ids with special tokens."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import IDEOGRAPHS

PAD, UNK, CLS, SEP, MAX_WORD, MAX_TOKENS = 0, 100, 101, 102, 100, 512
#: Words whose pieces a vocabulary remembers before it forgets them all.
KNOWN_WORDS = 1 << 16


def _punctuation(c: str) -> bool:
    return unicodedata.category(c)[0] == "P" or "!" <= c <= "/" or ":" <= c <= "@" or "[" <= c <= "`" or "{" <= c <= "~"


def _class(codes: Iterable[int]) -> str:
    """Inside of a regular expression's brackets for sorted code points, as ranges."""
    spans: list[list[int]] = []
    for code in codes:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """(characters that vanish, words and characters that stand alone); made once per process."""
    dropped = [c for c in (*range(32), *range(127, 160), 0xFFFD) if chr(c) not in "\t\n\r"]
    marks = _class(c for c in range(sys.maxunicode + 1) if _punctuation(chr(c)))
    ideographs = _class(c for a, b in sorted(IDEOGRAPHS) for c in range(a, b + 1))
    return re.compile(f"[{_class(dropped)}]+"), re.compile(f"[{marks}{ideographs}]|[^\\s\ufeff{marks}{ideographs}]+")


def split_words(text: str) -> list[str]:
    """Normalised words and single punctuation marks, as ``functions.text.pre_tokens``."""
    dropped, word = _patterns()
    return word.findall(dropped.sub("", text))


class WordPiece:
    """A vocabulary (token to id) and its greedy segmentation."""

    def __init__(self, vocabulary: dict[str, int], max_word: int = MAX_WORD, unknown: str = "[UNK]"):
        self.vocabulary, self.max_word, self.unknown = vocabulary, max_word, vocabulary.get(unknown, UNK)
        self._longest = max(map(len, vocabulary), default=0)
        self._known: dict[str, list[str]] = {}

    @classmethod
    def load(cls, path: str) -> WordPiece:
        """From a JSON file: the map itself, or a tokenizer's with its ``model``."""
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data.get("model")
        if not isinstance(model, dict):
            return cls(data)
        return cls(model["vocab"], model.get("max_input_chars_per_word") or MAX_WORD, model.get("unk_token") or "[UNK]")

    def pieces(self, word: str) -> list[str]:
        """The word's pieces, continuations marked ``##``; ``[UNK]`` if any part is unknown."""
        if len(word) > self.max_word:
            return ["[UNK]"]
        out, at = [], 0
        while at < len(word):
            mark = "##" if at else ""
            end = next((e for e in range(min(len(word), at + self._longest), at, -1) if mark + word[at:e] in self.vocabulary), None)
            if end is None:
                return ["[UNK]"]
            out.append(mark + word[at:end])
            at = end
        return out

    def tokenize(self, text: str | None) -> list[str]:
        """Pieces of all words of a text."""
        out, known = [], self._known
        for w in split_words(text or ""):
            found = known.get(w)
            if found is None and len(w) > self.max_word:
                found = ["[UNK]"]
            elif found is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                found = known[w] = self.pieces(w)
            out += found
        return out

    def ids(self, tokens: list[str], max_tokens: int = MAX_TOKENS) -> list[int]:
        """Ids of pieces between the start and end tokens, at most ``max_tokens`` in all."""
        ids = [self.vocabulary.get(p, self.unknown) if p != "[UNK]" else self.unknown for p in tokens[: max_tokens - 2]]
        return [CLS, *ids, SEP]

    def encode(self, text: str | None, max_tokens: int = MAX_TOKENS) -> list[int]:
        """Ids between the start and end tokens, at most ``max_tokens`` in all."""
        return self.ids(self.tokenize(text), max_tokens)


def encode_texts(docs: DataFrame, vocabulary: dict[str, int], key: str = "rowid", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """key, tokens, ids, mask and type_ids of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = WordPiece(shared.value)
        for frame in frames:
            tokens = [pieces.tokenize(t) for t in frame["text"]]
            ids = [pieces.ids(x, max_tokens) for x in tokens]
            yield pd.DataFrame({key: frame[key], "tokens": tokens, "ids": ids, "mask": [[1] * len(x) for x in ids], "type_ids": [[0] * len(x) for x in ids]})

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, tokens array<string>, ids array<bigint>, mask array<bigint>, type_ids array<bigint>")
