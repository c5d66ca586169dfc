"""Text expressions: normalisation, n-grams, extraction, snippets, pre-tokenisation.

All are column expressions over built-in functions, so they stay in the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SETTINGS

#: Fixed value: white space as the request language defines it (Java's \s is ASCII only).
WS = r"[\s\u000B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The characters of ``WS``.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code point ranges that are padded with spaces before word pieces.
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _accents() -> tuple[str, str]:
    """Latin letters with marks and the letters without, from the Unicode data."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            pairs.append((chr(c), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def strip_text(text: Column) -> Column:
    """Only the letters and numbers of a text; null becomes ''."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", "")


def js_trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(SPACES))


def norm_text(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " "))


def fold_ascii(text: Column) -> Column:
    """Lower case for A-Z only, as LIKE compares."""
    return F.translate(text, _UPPER, _LOWER)


def fold_latin(text: Column) -> Column:
    """Lower case without Latin accents, as the word index compares."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def ngrams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters in order; empty for shorter texts."""
    # outside the lambda, the text is worked out once and not once per run
    chars, many = F.split(text, ""), F.greatest(F.length(text) - (n - 1), F.lit(0))
    runs = reduce(lambda x, y: F.zip_with(x, y, lambda a, b: F.concat(a, b)), [F.slice(chars, F.lit(k + 1), many) for k in range(n)])
    return F.when(F.length(text) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngram_list(text: str, n: int) -> list[str]:
    """Distinct runs of ``n`` characters of a literal, in order of appearance."""
    return list(dict.fromkeys(text[i : i + n] for i in range(len(text) - n + 1)))


def strip_literal(text: str) -> str:
    """``strip_text`` for a literal."""
    return "".join(c for c in text if unicodedata.category(c)[0] in "LN")


def words(text: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold_latin(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def word_list(text: str) -> list[str]:
    """``words`` for a literal."""
    folded = text.translate(str.maketrans(ACCENTED, PLAIN)).lower()
    out, run = [], ""
    for c in folded + " ":
        if unicodedata.category(c)[0] in "LN":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def indexed_text(type_: Column, data: Column) -> Column:
    """Searchable text of a raw event from its JSON ``data``.

    User messages have ``content``, assistant messages ``message.content``: a string is
    trimmed, of an array the trimmed non-empty text blocks are joined by line feeds;
    everything else has no text.
    """
    content = F.when(type_ == "user/message", F.get_json_object(data, "$.content")).when(type_ == "assistant/message", F.get_json_object(data, "$.message.content"))
    return F.coalesce(_content(content, "\n", trimmed=True), F.lit(""))


def display_text(type_: Column, data: Column) -> Column:
    """Text of any event for reading: blocks joined by a space, tool calls and others in brackets."""
    content = F.when(type_ == "user/message", F.get_json_object(data, "$.content")).when(type_ == "assistant/message", F.get_json_object(data, "$.message.content"))
    message = F.coalesce(_content(content, " ", trimmed=False), F.lit(""))
    tool = F.concat(F.lit("[tool:"), F.coalesce(F.get_json_object(data, "$.name"), F.lit("undefined")), F.lit("] "), F.coalesce(F.get_json_object(data, "$.arguments"), F.lit("")))
    other = F.when(type_ == "tool/call", tool).otherwise(F.concat(F.lit("["), type_, F.lit("]")))
    return F.when(data.isNull(), "").when(type_.isin("user/message", "assistant/message"), message).otherwise(other)


def _content(content: Column, joint: str, trimmed: bool) -> Column:
    blocks = F.filter(F.from_json(content, "array<struct<type: string, text: string>>"), lambda b: b["type"] == "text")
    texts = F.transform(blocks, lambda b: js_trim(b["text"]) if trimmed else b["text"])
    joined = F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), joint)
    whole = js_trim(content) if trimmed else content
    return F.when(content.startswith("["), F.coalesce(joined, whole)).when(content.startswith("{"), "").otherwise(whole)


def fragments(query: str) -> list[str]:
    """Pieces of the stripped query that a snippet looks for, in order of preference."""
    q = strip_literal(query)
    out = []
    for n in range(min(len(q), SETTINGS.snippet_fragment), 1, -1):
        out += [q[:n], q[len(q) - n :]]
    return list(dict.fromkeys(out))


def snippet(text: Column, query: str, chars: int = SETTINGS.snippet_chars) -> Column:
    """Up to ``chars`` characters around the first fragment of the query that occurs."""
    clean = norm_text(text)
    found = [F.when(F.contains(clean, F.lit(f)), F.instr(clean, f) - 1) for f in fragments(query)]
    at = F.coalesce(*found, F.lit(0))
    start = F.greatest(F.lit(0), at - chars // 3)
    ahead = F.when(start > 0, 1).otherwise(0)
    end = F.least(F.length(clean), start + chars - 1 - ahead)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(clean, start + 1, end - start), F.when(end < F.length(clean), "…").otherwise(""))
    return F.when(F.length(clean) <= chars, clean).otherwise(cut)


def bert_normalize(text: Column) -> Column:
    """Without control characters, white space as spaces, ideographs between spaces."""
    ranges = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in IDEOGRAPHS)
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]", "")
    spaced = F.regexp_replace(clean, WS, " ")
    return F.regexp_replace(F.regexp_replace(spaced, f"(?<! )(?<!^)([{ranges}])", " $1"), f"([{ranges}])", "$1 ")


def pre_tokens(text: Column) -> Column:
    """Runs of characters other than spaces and punctuation, and each punctuation mark."""
    punct = r"\p{P}\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"
    return F.regexp_extract_all(F.trim(bert_normalize(text)), F.lit(f"([^\\s{punct}]+|[{punct}])"), F.lit(1))
