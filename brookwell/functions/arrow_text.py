"""Text functions that no Column expression can state, as vectorised functions over Arrow batches; each text by itself."""

import json
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_THOUGHTS = re.compile(r"<think(ing)?>.*?</think\1>", re.S | re.I)
_PAIR = re.compile(r'"(\w+)"\s*:\s*"((?:[^"\\]|\\.)*)"', re.S)
_DECODER = json.JSONDecoder()
#: The fields of an analysis, and what stands for a field that is missing.
FIELDS = ("detailed_description", "entity_name", "entity_type", "summary")
MISSING = {"detailed_description": "", "entity_name": "unknown_entity", "entity_type": "unknown"}
ANALYSIS = "struct<detailed_description:string,entity_name:string,entity_type:string,summary:string>"


def _mended(text: str) -> str:
    """Typographic quotes as plain ones, no comma before a closing bracket."""
    return re.sub(r",+(?=\s*[\]}])", "", text.translate({ord(c): '"' if c in "“”„" else "'" for c in "“”„‘’"}))


def _first_analysis(text: str) -> dict | None:
    """The first object, from any opening brace on, that decodes and has a field of an analysis at its top."""
    at = text.find("{")
    while at >= 0:
        try:
            found, _ = _DECODER.raw_decode(text, at)
            if {"detailed_description", "entity_info"} & found.keys():
                return found
        except json.JSONDecodeError:
            pass
        at = text.find("{", at + 1)
    return None


def robust_json(response: str | None) -> dict | None:
    """A model's analysis: the first object of it that decodes, as it is written or mended; else what its strings by name say, as far as they go."""
    if response is None:
        return None
    said = _THOUGHTS.sub("", response)
    found = _first_analysis(said) or _first_analysis(_mended(said))
    if found is not None:
        inner = found.get("entity_info")
        inner = inner if isinstance(inner, dict) else {}
        return {f: (found if f == "detailed_description" else inner).get(f) for f in FIELDS}
    named: dict[str, str] = {}
    for name, value in _PAIR.findall(response):
        named.setdefault(name, value)
    out = {f: named.get(f) or MISSING.get(f) for f in FIELDS}
    return out | {"summary": named.get("summary", out["detailed_description"][:100])}


def analyses(c: Column) -> Column:
    """``robust_json`` of each response, as a struct."""
    none = dict.fromkeys(FIELDS)
    return F.pandas_udf(lambda s: pd.DataFrame([robust_json(x) or none for x in s], columns=list(none)), ANALYSIS)(c)


def pack_sentences(text: str, most: int, tokens: Callable[[str], int] = lambda s: len(s.split())) -> list[dict]:
    """Sentences, parted by a full stop and a space, in chunks of up to ``most`` tokens; a chunk begins with the last two sentences of the one before (with all of it, if it had no more).

    A chunk from sentence ``start`` on, whose first new one is ``new``, ends behind the
    last sentence whose running sum allows it, and behind ``new`` at least.
    """
    sentences = [s for s in map(str.strip, text.replace("\n", " ").split(". ")) if s]
    sums = [0, *accumulate(map(tokens, sentences))]
    out, start, new = [], 0, 0
    while new < len(sentences):
        end = max(new + 1, bisect_right(sums, sums[start] + most) - 1)
        out.append({"content": ". ".join(sentences[start:end]) + ".", "tokens": sums[end] - sums[start]})
        start, new = max(start, end - 2), end
    return out


def sentence_packs(most: int):
    return F.pandas_udf(lambda s: s.map(lambda t: pack_sentences(t or "", most)), "array<struct<content:string,tokens:int>>")


SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_recursively(text: str, most: int, overlap: int, size: Callable[[str], int] = lambda s: len(s.split()), separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of up to ``most`` tokens: parted at the first separator that the text has, separators stay at the head of what follows; what is still too long is parted by the next ones, and neighbours are joined again, sharing up to ``overlap`` tokens."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    separator, finer = separators[at], separators[at + 1 :]
    pieces = list(text) if not separator else [p for i, p in enumerate(text.split(separator)) for p in [separator + p if i else p] if p]
    out, run = [], []

    def join() -> None:
        """Give out what has gathered, in windows that share their ends."""
        window, n = [], 0
        for piece in run:
            k = size(piece)
            if window and n + k > most:
                out.append("".join(window).strip())
                while window and (n > overlap or n + k > most):
                    n -= size(window.pop(0))
            window.append(piece)
            n += k
        if window:
            out.append("".join(window).strip())
        run.clear()

    for piece in pieces:
        if size(piece) <= most:
            run.append(piece)
            continue
        join()
        out += split_recursively(piece, most, overlap, size, finer) if finer else [piece]
    join()
    return [x for x in out if x]


def recursive_splits(most: int, overlap: int):
    return F.pandas_udf(lambda s: s.map(lambda t: split_recursively(t, most, overlap) if t else []), "array<string>")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with one big integer for all of ``b``."""
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << len(b)) - 1
    v = every
    for w in a:
        hit = v & places.get(w, 0)
        v = ((v + hit) | (v - hit)) & every
    return len(b) - v.bit_count()


def rouge_l(reference: str | None, said: str | None) -> float:
    """F-measure of the common subsequence of lower-case runs of letters and digits, unstemmed."""
    a, b = (re.findall(r"[a-z0-9]+", (x or "").lower()) for x in (reference, said))
    n = lcs(a, b) if a and b else 0
    return 2 * n / (len(a) + len(b)) if n else 0.0


def rouge_ls(reference: Column, said: Column) -> Column:
    return F.pandas_udf(lambda a, b: pd.Series([rouge_l(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")(reference, said)
