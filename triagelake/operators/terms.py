"""Terms and ages in texts: automata over words, built from tables, sent once and run in one pass over each text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

from triagelake.functions.text import transliterate_chunk, transliterate_run, unmask_chunk

#: Chunks of a text that a task remembers, and the characters of the longest of them.
KNOWN, SHORT = 100_000, 64
BLANKS = re.compile("[ \t\n\x0b\f\r]+")
# Endings of short words, and forms of those whose stem changes.
ENDINGS = frozenset(("", "s", "es", "а", "у", "ом", "е", "и"))
IRREGULAR = {"child": ("children",), "дети": ("детей", "детям", "детьми", "детях"), "діти": ("дітей", "дітям", "дітьми", "дітях"), "kid": ("kids",)}


class Word(NamedTuple):
    """A word of a term as a condition on what begins where a word begins: the literal, then how the word may go on."""

    literal: str
    ends: str  # "open" (in any way), "inflected" (one of ENDINGS), "whole" (not at all)


def conditions(plain: str, prefix: bool) -> list[Word]:
    """The ways in which a word of a term may stand in a text: a prefix (* in the table) or a long word by its beginning, a
    short word whole, with an ending, or in an irregular form."""
    if prefix:
        return [Word(plain, "open")]
    if len(plain) > 5:
        return [Word(plain[: max(5, len(plain) - 2)], "open")]
    return [Word(plain, "inflected"), *(Word(form, "whole") for form in IRREGULAR.get(plain, ()))]


def is_letter(sign: str) -> bool:
    return sign.isalnum() or sign == "_"


class Terms:
    """A state machine over the chunks of a text (what stands between white space).

    A chunk is first turned to the conditions that it meets, by looking up what begins at each of its words among the
    literals, length by length; chunks are remembered. Terms of several words are paths through a trie of conditions;
    all paths that are open are followed together. A term begins where a word begins; between its words is white space
    alone. Literals that are empty match nothing.
    """

    def __init__(self, terms: Iterable[tuple[object, list[tuple[str, bool]]]]):
        self.number: dict[Word, int] = {}
        self.step: dict[tuple[int, int], int] = {}
        self.names: list[list] = [[]]
        for name, words in terms:
            nodes = [0]
            for plain, prefix in words:
                nodes = [self._child(node, self.number.setdefault(c, len(self.number))) for node in nodes for c in conditions(plain, prefix) if plain]
            for node in nodes if words else ():
                self.names[node].append(name)
        self.literals: dict[str, list[tuple[int, str]]] = {}
        lengths: dict[str, set[int]] = {}
        for word, k in self.number.items():
            self.literals.setdefault(word.literal, []).append((k, word.ends))
            lengths.setdefault(word.literal[0], set()).add(len(word.literal))
        self.lengths = {first: sorted(n) for first, n in lengths.items()}
        self.known: dict[str, tuple] = {}

    def _child(self, node: int, condition: int) -> int:
        child = self.step.setdefault((node, condition), len(self.names))
        if child == len(self.names):
            self.names.append([])
        return child

    def met(self, chunk: str) -> Iterator[tuple[int, bool, bool]]:
        """(condition, whether it begins the chunk, whether its word ends the chunk) of all that a chunk meets."""
        for i, sign in enumerate(chunk[:1] if chunk.isalpha() else chunk):
            if sign not in self.lengths or i and is_letter(chunk[i - 1]):
                continue
            for n in self.lengths[sign]:
                for condition, ends in self.literals.get(chunk[i : i + n], ()):
                    end = i + n
                    while end < len(chunk) and is_letter(chunk[end]):
                        end += 1
                    rest = chunk[i + n : end]
                    if ends == "open" or not rest or ends == "inflected" and rest in ENDINGS:
                        yield condition, i == 0, end == len(chunk)

    def of_chunk(self, chunk: str) -> tuple:
        """What a chunk meets, remembered from now on."""
        found = tuple(self.met(chunk))
        if len(chunk) <= SHORT:
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[chunk] = found
        return found

    def find(self, text: str | None) -> set:
        """Names of the terms in a text that has been unmasked."""
        out: set = set()
        open_, known = [0], self.known
        for chunk in BLANKS.split(text or ""):
            found = known.get(chunk)
            if found is None:
                found = self.of_chunk(chunk)
            if not found:  # as nearly always
                if len(open_) > 1:
                    open_ = [0]
                continue
            open_ = self.follow(open_, found, out)
        return out

    def follow(self, open_: list[int], found: tuple, out: set) -> list[int]:
        """The paths that are open after a chunk which meets ``found``; terms that end in it go to ``out``."""
        after = [0]
        for condition, begins, ends in found:
            for node in open_ if begins else (0,):
                child = self.step.get((node, condition))
                if child is not None:
                    out.update(self.names[child])
                    if ends and child not in after:
                        after.append(child)
        return after


@lru_cache(maxsize=4)
def built(shared) -> Terms:
    """The machine of a table that was sent around, once in each worker."""
    return Terms(shared.value)


# A number, a word (with * in tables), or one sign; blanks, hyphens and what is between words part them and are no tokens.
TOKENS = re.compile(r"(?P<number>\d+(?:[.,]\d+)*)|(?P<word>[^\W\d_]+(?:'[^\W\d_]+)*\*?)|(?P<sign>[^\s-])")


def tokens(low: str) -> list[str]:
    return [m[0] for m in TOKENS.finditer(low)]


def is_number(token: str) -> bool:
    """A number of at most three digits."""
    return token.isdecimal() and len(token) <= 3 and (token == "0" or token[0] != "0")


class Age(NamedTuple):
    """What may stand around a number so that it says an age: a label, words before and after, which numbers, no words behind."""

    label: str
    lang: str
    before: list[str]
    after: list[str]
    low: int
    high: int
    digits_only: bool
    stops: list[list[str]]


class Ages:
    """Numbers of a text, in digits or by name, are looked at one by one, with the tokens on both sides.

    Rows have lang, kind, value, number. A number is whole: no part of a longer one or of a decimal.
    """

    def __init__(self, rows):
        self.names: dict[str, list[tuple[list[str], str, int]]] = {}
        by: dict[tuple[str, str], list] = {}
        for r in rows:
            by.setdefault((r["lang"], r["kind"]), []).append(r)
            if r["kind"] == "number":
                of = tokens(r["value"].lower())
                self.names.setdefault(of[0], []).append((of, r["lang"], r["number"]))
        self.ages = []
        for (lang, kind), of in by.items():
            stops = [tokens(r["value"].lower()) for r in by.get((lang, "stop"), [])]
            for r in of:
                before, _, after = r["value"].lower().rpartition("{n}")
                around = (tokens(before), tokens(after))
                if kind == "unit":
                    self.ages.append(Age("stated age", lang, *around, 1, 17, False, []))
                elif kind == "infant":
                    self.ages.append(Age("infant age", lang, *around, 0, 999, False, []))
                elif kind == "phrase":
                    self.ages.append(Age("stated age", lang, *around, 1, 17, False, stops))
                elif kind == "grade":
                    self.ages.append(Age("school grade", lang, *around, 1, 12, True, []))
        #: How many tokens before a number, and from it on, can matter.
        self.before = max((len(a.before) for a in self.ages), default=0)
        self.after = max((len(n) for of in self.names.values() for n, _, _ in of), default=1)
        self.after += max((len(a.after) + max(map(len, a.stops), default=0) for a in self.ages), default=0)

    def begins(self, token: str) -> bool:
        """Whether a token is a number or the first word of one's name."""
        return token in self.names or is_number(token)

    def numbers(self, of: list[str], first: int = 0, last: int | None = None) -> Iterator[tuple[int, int, str | None, int]]:
        """(start, end, language of its name or None, value) of each whole number that begins among tokens first to last."""
        for i in range(first, len(of) if last is None else last):
            token = of[i]
            if is_number(token):
                yield i, i + 1, None, int(token)
            for name, lang, value in self.names.get(token, ()):
                if of[i : i + len(name)] == name:
                    yield i, i + len(name), lang, value

    def find(self, low: str | None) -> set[str]:
        """Labels of a lower-cased text."""
        out: set[str] = set()
        self.look(tokens(low or ""), 0, None, out)
        return out

    def look(self, of: list[str], begin: int, stop: int | None, out: set[str]) -> None:
        """Adds the labels of the numbers that begin among the tokens ``begin`` to ``stop``."""
        for start, end, lang, value in self.numbers(of, begin, stop):
            for age in self.ages:
                if age.label in out or not age.low <= value <= age.high or lang is not None and (age.digits_only or lang != age.lang):
                    continue
                first, last = start - len(age.before), end + len(age.after)
                if first >= 0 and alike(of[first:start], age.before) and alike(of[end:last], age.after) and not any(alike(of[last : last + len(s)], s) for s in age.stops):
                    out.add(age.label)


def alike(of: list[str], wanted: list[str]) -> bool:
    """Whether tokens are those of a table, where * ends a beginning."""
    return len(of) == len(wanted) and all(t.startswith(w[:-1]) if len(w) > 1 and w[-1] == "*" else t == w for t, w in zip(of, wanted))


SILENT = str.maketrans("", "", "ьъ")


def plain_signs(chunk: str) -> str:
    """A lower-cased chunk as ages are sought in it."""
    return chunk.replace("ё", "е").replace("’", "'")


class Indicators:
    """Age indicators of a text: ages, and terms in both alphabets, where soft and hard signs do not count.

    A chunk is spelt, taken apart and looked up once and then remembered; as nearly all have neither a number nor a part of
    a term, little of a text is looked at again. Of a number only the tokens around it are taken apart.
    """

    def __init__(self, ages: Ages, terms: Terms):
        self.ages, self.terms = ages, terms
        self.known: dict[str, tuple] = {}

    def learn(self, chunks: list[str]) -> dict[str, tuple]:
        """For each chunk: whether a number begins in it, what it meets by its letters, and in Cyrillic spelling; empty if
        nothing. What it meets is None where no sign is left of it, as if it were not there. Short ones are remembered."""
        plain = [c for c in chunks if c.isascii()]
        forms = {c: (c, spelt) for c, spelt in zip(plain, transliterate_run("\n".join(plain)).split("\n"))}
        forms |= {c: (unmask_chunk(c).translate(SILENT), transliterate_chunk(plain_signs(c)).translate(SILENT)) for c in chunks if c not in forms}
        out = {}
        for chunk, (own, spelt) in forms.items():
            # a chunk of letters alone is one token and one word
            number = chunk in self.ages.names if chunk.isalpha() and chunk.isascii() else any(map(self.ages.begins, tokens(plain_signs(chunk))))
            a, b = self.met(own), self.met(spelt)
            out[chunk] = (number, a, b) if number or a != () or b != () else ()
        if len(self.known) + len(out) > KNOWN:
            self.known.clear()
        self.known.update((c, f) for c, f in out.items() if len(c) <= SHORT)
        return out

    def met(self, form: str) -> tuple | None:
        if not form:
            return None
        return () if form.isalpha() and form[0] not in self.terms.lengths else tuple(self.terms.met(form))

    def around(self, chunks: list[str], i: int, out: set[str]) -> None:
        """The ages of the numbers that begin in a chunk."""
        before, own, after = [], tokens(plain_signs(chunks[i])), []
        k = i
        while k and len(before) < self.ages.before:
            k -= 1
            before = tokens(plain_signs(chunks[k])) + before
        k = i + 1
        while k < len(chunks) and len(after) < self.ages.after:
            after += tokens(plain_signs(chunks[k]))
            k += 1
        self.ages.look(before + own + after, len(before), len(before) + len(own), out)

    def find(self, low: str | None) -> set[str]:
        """Labels of a lower-cased text."""
        chunks, out = BLANKS.split(low or ""), set()
        found = list(map(self.known.get, chunks))
        if None in found:
            new = self.learn(list({chunk for chunk, f in zip(chunks, found) if f is None}))
            found = [new[chunk] if f is None else f for chunk, f in zip(chunks, found)]
        open_, last = [[0], [0]], -1
        for i in [i for i, f in enumerate(found) if f]:
            number, *met = found[i]
            if number:
                self.around(chunks, i, out)
            if i > last + 1:
                open_ = [[0], [0]]
            open_, last = [o if m is None else self.terms.follow(o, m, out) for o, m in zip(open_, met)], i
        return out
