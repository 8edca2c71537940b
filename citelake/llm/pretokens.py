"""Pre-tokens of a tokenizers-library BPE file, as the library cuts them, at the speed of a regular expression."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

#: Code points on which the regex module and the library agree about letters, numbers and white space
#: (tests/llm compares all of them); a text with any other character is cut by the library itself.
_PLAIN = regex.compile(r"[\x00-՗ -₎₠-↏　-鿿가-힣]*")


def read_spec(path: str) -> str:
    """The tokenizer file's content, read once on the driver; tasks get the content, not the path."""
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Texts of these characters alone are composed already, and str.lower() is what the library's lower-casing gives.
_SIMPLE = re.compile(r"[\x00-\u012f\u0131-\u024f]*").fullmatch


#: Byte-level BPE writes bytes as printable characters: these as themselves, the others, in order, as those from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SYMBOLS = {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_SELF}))}


def runs(text: str) -> list[str]:
    """The text cut at ASCII white space, empty pieces included.

    Tokens never span white space and special strings hold none, so each run has the tokens that it has alone."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class Pretokenizer:
    """Cuts runs of characters into pre-tokens, special strings as pieces of their own, and encodes texts run by run.

    cache: about half of the runs that are remembered, and the most pre-tokens; longer ones than LONG never are."""

    LONG = 64

    def __init__(self, spec: str, cache: int = 120_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = parsed["added_tokens"]
        odd = [x["content"] for x in special if x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] or " " in x["content"]]
        split = next(x for x in parsed["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        if odd or not (split["invert"] and split["behavior"] == "Removed") or parsed["post_processor"] or parsed["decoder"]:
            raise ValueError("this tokenizer file is of another kind than those that pre-tokens can be counted for")
        self.special = {x["content"]: x["id"] for x in special}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.marks = [x.lower() for x in names]
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.terms: dict[str, list[int]] = {}
        self.cache = cache

    def prepare(self, text: str) -> list[str]:
        """The runs of a text, in lower case where that changes no token."""
        lower = text.lower()
        if _SIMPLE(text) and not any(x in lower for x in self.marks):
            return runs(lower)
        return runs(text)

    def _plain(self, text: str) -> list[str]:
        text = self.normalize(text)
        if _PLAIN.fullmatch(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pretokens(self, run: str) -> list[str]:
        """Pre-tokens of a run in order; a special string stands as itself."""
        if self.cut is not None and self.cut.search(run):
            out: list[str] = []
            for i, part in enumerate(self.cut.split(run)):
                out += [part] if i % 2 else self._plain(part)
            return out
        if _SIMPLE(run):
            run = run.lower()
            return [run] if run.isalpha() else self.find(run)
        return self._plain(run)

    def encode_pretoken(self, term: str) -> list[int]:
        if term in self.special:
            return [self.special[term]]
        symbols = term if term.isascii() and term.isprintable() else term.encode().decode("latin-1").translate(_BYTE_SYMBOLS)
        return [t.id for t in self.tokenizer.model.tokenize(symbols)]

    def encode_run(self, run: str) -> bytes:
        """The ids of a run as 32-bit numbers, from its pre-tokens, each of which is encoded once."""
        out: list[int] = []
        for x in self.pretokens(run):
            if (ids := self.terms.get(x)) is None:
                ids = self.encode_pretoken(x)
                if len(self.terms) >= self.cache:
                    self.terms.clear()
                if len(x) <= self.LONG:
                    self.terms[x] = ids
            out += ids
        return array("i", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text. Runs are remembered; when there are too many, those that the latest texts didn't use are forgotten."""
        words, known, older = self.prepare(text), self.ids, self.older
        long = []
        for x in set(words).difference(known):
            known[x] = older[x] if x in older else self.encode_run(x)
            if len(x) > self.LONG:
                long.append(x)
        out = np.frombuffer(b"".join([known[x] for x in words]), dtype=np.int32)
        for x in long:
            del known[x]
        if len(known) > self.cache:
            self.older, self.ids = known, {}
        return out
