"""Operator 2: secrets, found by base patterns and a linear-chain conditional random field.

The field tags tokens begin, inside or outside, decoded by Viterbi, from the shape of the token, the signs and words
around it and features of the text. Tokens are runs of four or more letters, digits and signs that keys use; a name and
its value are two tokens. All tokens of a text are one chain, and each is tagged; none is left out beforehand. What a
token adds to the score of each tag is looked up in tables by its word and the gaps beside it. Viterbi then runs over
what is left between tokens that are outside in every best tagging, whatever stands beside them (Field.surely_out), so
that the tagging is the best one of the whole text.

Tagged spans of which the base spans leave some token uncovered are added under kind crf, whole: they may overlap
base spans. The field is trained here, on seeded lines of several generators (GENERATORS), once per process.

Defined results: a null or empty text has no spans; repeated rows are scanned each on its own; long texts are
scanned whole, in time linear in their length; other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import math
import operator
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import common

KINDS = ("assign", "access", "hex", "crf")
Span = tuple[int, int, str]


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{any_case('api')}_?{any_case('key')}"
ASSIGN = re.compile(rf"({NAMES})[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)")
# The longest run decides: a shorter start inside the same run fails as well, so the length can stand in the pattern.
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each kind that pass its test, by start and then kind."""
    found: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


BODY = "A-Za-z0-9+/_.-"
LEAST_TOKEN = 4
#: A token: a run of body characters with the padding that may end it. What is before "=" is a name of its own.
TOKEN = re.compile(rf"([{BODY}]{{{LEAST_TOKEN},}}+(?:={{1,2}}(?![{BODY}=]))?)")
#: Words that announce a secret.
CUES = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "private", "passphrase")
#: Beginnings that issuers of keys use.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_", "pk_", "xox", "eyJ", "AIza", "glpat-", "sk-")
OUT, BEGIN, INSIDE = 0, 1, 2
QUOTES = ("\"", "'")
#: What between() tells apart, and own_kind().
GAPS = ("line", "line+", "quote", "blank", "none", "assign", "at", "comma", "open", "url", "other")
OWN = ("w", "W", "x")


def split(text: str) -> tuple[list[str], list[str]]:
    """All tokens of a text, and the gaps before, between and after them."""
    parts = TOKEN.split(text)
    return parts[1::2], parts[::2]


def spans_of(words: list[str], gaps: list[str]) -> list[tuple[int, int]]:
    ends = np.cumsum([len(x) for pair in zip(gaps, words, strict=False) for x in pair]).tolist()
    return list(zip(ends[::2], ends[1::2], strict=True))


#: Classes of a token's signs, which are ASCII: digit, lower, upper, other; and those with lower and other as one.
CLASS = bytes(ord("d" if chr(c).isdigit() else "l" if chr(c).islower() else "u" if chr(c).isupper() else "s") for c in range(128)) + b"s" * 128
CASES = bytes.maketrans(b"l", b"s")
CUE = re.compile("|".join(CUES))
#: Lower and upper letters, vowels and hexadecimal signs.
TABLES = [np.array([chr(c) in some for c in range(256)], np.int64) for some in (string.ascii_lowercase, string.ascii_uppercase, "aeiouyAEIOUY", string.hexdigits)]
NAMED = re.compile("[A-Za-z]+[0-9]{1,4}")


#: c log2 c of small counts.
WEIGHED = [0.0, *(c * math.log2(c) for c in range(1, 4096))]
SMALL = np.array(WEIGHED)


def entropy_of(raw: bytes) -> float:
    n, signs = len(raw), set(raw)
    if len(signs) == n < len(WEIGHED):
        return WEIGHED[n] / n
    counts = map(raw.count, signs)
    return math.log2(n) - sum([WEIGHED[c] if c < len(WEIGHED) else c * math.log2(c) for c in counts]) / n


def figures(word: str) -> tuple:
    """What shape() tells of a token, as a few small values."""
    n, raw, low, title = len(word), word.encode(), word.lower(), word.istitle()
    entropy = entropy_of(raw)
    vowels = n - len(raw.translate(None, b"aeiouyAEIOUY"))
    cue, hexed = CUE.search(low) is not None, not raw.translate(None, b"0123456789abcdefABCDEF")
    kinds = raw.translate(CLASS)
    digits = kinds.count(b"d")
    cases = kinds.translate(CASES)
    switches = sum(map(operator.ne, cases, cases[1:])) / max(1, n - 1)
    vowels /= max(1, n - digits)
    flags = (
        title, not digits and b"s" not in kinds and (title or b"u" not in kinds), "." in word[:-1], word[-1] == ".", word.count("-") > 1, "_" in word, hexed,
        word.startswith(PREFIXES), word.count("/") > 1 and entropy < 4.2, word[-1] == "=", cue, digits > 0 and NAMED.fullmatch(word) is not None,
    )
    return (min(n // 4, 10), min(n // 8, 5), min(int(entropy * 2), 10), int(5 * digits / n), (digits > 0, b"l" in kinds, b"u" in kinds, b"s" in kinds), min(int(switches * 6), 4), int(vowels * 6), int(vowels * 4), flags)


def alike(words: list[str]) -> np.ndarray:
    """A number for each word, under zero unless it is plain; plain words of one number have the same figures(). So those
    are computed once for each number and not once for each of the many words of prose."""
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    n = np.fromiter(map(len, words), np.int64, len(words))
    start, owner = np.cumsum(n) - n, np.repeat(np.arange(len(words)), n)
    sums = lambda table: np.add.reduceat(table[raw], start).astype(np.int64)
    lower, upper, vowels, hexed = map(sums, TABLES)
    title = (upper == 1) & (TABLES[1][raw[start]] > 0)
    # how often each sign comes, which decides the entropy
    signs = np.sort(owner * 256 + raw)
    first = np.flatnonzero(np.r_[True, signs[1:] != signs[:-1]])
    weighed = np.bincount(signs[first] >> 8, SMALL[np.diff(np.r_[first, len(signs)]).clip(max=len(SMALL) - 1)], len(words))
    entropy = (np.log2(n) * n - weighed) / n
    # near the edge of a class rounding could decide, and long words are few
    sound = (lower + upper == n) & ((upper == 0) | title) & (n < 64) & (np.abs(entropy * 2 - np.rint(entropy * 2)) > 1e-9)
    named = np.fromiter((2 * w.startswith(PREFIXES) + (CUE.search(w.lower()) is not None) for w in words), np.int64, len(words))
    key = (((n * 64 + vowels) * 32 + (entropy * 2).astype(np.int64)) * 2 + title) * 8 + (hexed == n) * 4 + named
    return np.where(sound, key, -1)


FLAGS = ("title", "plain", "dotted", "ends.", "dashed", "under", "hex", "prefix", "path", "padded", "iscue", "word+digits")


def shape_of(figures_: tuple) -> list[str]:
    """Features of a token by itself."""
    length, wide, entropy, digits, kinds, switches, vowels, few, flags = figures_
    classes = "".join(c for c, there in zip("dlus", kinds, strict=True) if there)
    out = ["bias", f"length={length}", f"entropy={entropy}", f"digits={digits}", f"classes={classes}", f"classes={classes}&length={wide}", f"switches={switches}", f"vowels={vowels}", f"classes={classes}&vowels={few}"]
    return out + [f for f, there in zip(FLAGS, flags, strict=True) if there]


def shape(word: str) -> list[str]:
    return shape_of(figures(word))


def between(gap: str) -> str:
    """What stands between two tokens, in a few kinds."""
    if "\n" in gap or "\r" in gap:
        return "line" if not gap.strip() else "line+"
    core = gap.strip().strip("\"'").strip()
    if not core:
        return "quote" if gap.strip() else ("blank" if gap else "none")
    if core[0] in "=:" or core.startswith("->"):
        return "assign"
    return {"@": "at", ",": "comma", "(": "open", "://": "url"}.get(core[:1] if core[:3] != "://" else "://", "other")


def near_gaps(gaps: list[str]) -> list[str]:
    """What of the gaps the field looks at."""
    near = [g if len(g) <= 24 else g[:12] + g[-12:] for g in gaps]
    near[0], near[-1] = gaps[0][-24:], gaps[-1][:2]
    return near


def is_plain(word: str) -> bool:
    return word.isalpha() and (word.islower() or word.istitle())


def own_kind(word: str) -> str:
    return ("w" if len(word) < 16 else "W") if is_plain(word) else "x"


def has_cue(text: str) -> bool:
    return CUE.search(text.lower()) is not None


def around(words: list[str], gaps: list[str], code: bool) -> list[list[str]]:
    """Features of each token of a chain from what is around it."""
    gaps = near_gaps(gaps)
    kinds = [between(g) for g in gaps]
    cue, short_cue = list(map(has_cue, words)), list(map(has_cue, gaps))
    out = []
    for k, word in enumerate(words):
        far = next((d for d in range(1, 4) if k >= d and cue[k - d] and "line" not in kinds[k - d + 1 : k + 1]), 0)
        if not far and short_cue[k]:
            far = 1
        own = own_kind(word)
        here = [f"gap={kinds[k]}", f"next={kinds[k + 1]}", f"cue={far}", f"cue={far}&gap={kinds[k]}", f"cue={far}&gap={kinds[k]}&{own}", f"{own}&gap={kinds[k]}"]
        here += [f"before={words[k - 1].lower()}"] if k and len(words[k - 1]) < 14 else ["first"] * (not k)
        here += [f"after={words[k + 1].lower()}"] if k + 1 < len(words) and len(words[k + 1]) < 14 else []
        here += ["closed"] * (gaps[k + 1][:1] in QUOTES and gaps[k][-1:] in QUOTES) + ["code"] * code + [f"code&cue={far}"] * code
        out.append(here)
    return out


def features(words: list[str], gaps: list[str], code: bool) -> list[list[str]]:
    return [[*shape(word), *more] for word, more in zip(words, around(words, gaps, code), strict=True)]


def is_code(text: str) -> bool:
    """File feature: assignments and braces rather than prose."""
    return text.count("=") + text.count("{") + text.count(";") > len(text) / 60


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
COMMON = ("the", "your", "with", "this", "from", "that", "have", "will", "was", "and", "use", "for", "note", "please", "about", "when")
SETTINGS = ("host", "port", "path", "name", "version", "mode", "level", "timeout", "region", "user", "url", "commit", "build", "page", "order", "model", "date", "file", "title", "price")


class Lines:
    """Generated lines: pieces of text, some of them marked as tokens of secrets."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def pick(self, alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(self.rng.choice(alphabet) for _ in range(self.rng.randint(low, high or low)))

    def word(self) -> str:
        n = self.rng.choice((1, 2, 2, 3, 3, 4, 6))
        return "".join(self.pick("bcdfglmnprst", 1, 2) + self.pick("aeiou", 1, 2) for _ in range(n))

    def near(self) -> str:
        return self.rng.choice(COMMON) if self.rng.random() < 0.5 else self.word()

    def prose(self, low: int = 1, high: int = 6) -> str:
        return " ".join(self.near() for _ in range(self.rng.randint(low, high)))

    def cue(self) -> str:
        name = self.rng.choice(CUES)
        name = self.rng.choice((name, name, f"api_{name}", f"{self.word()}-{name}", f"{self.word()}_{name}", f"api-{name}", f"x-{name}"))
        return self.rng.choice((name, name, name.upper(), name.capitalize()))

    def key(self) -> str:
        """A long secret."""
        mixed = LOWER + UPPER + DIGITS
        return self.rng.choice((
            lambda: self.pick(mixed, 16, 48), lambda: self.pick(mixed + "+/", 40), lambda: self.rng.choice(("ghp_", "sk_live_", "xoxb-", "AIza", "glpat-", "pk_")) + self.pick(mixed, 24, 36), lambda: self.pick(LOWER + UPPER, 20, 40),
            lambda: self.pick(UPPER + DIGITS, 16, 32), lambda: "eyJ" + self.pick(mixed, 30) + "." + self.pick(mixed, 40), lambda: self.pick(LOWER + DIGITS, 18, 40), lambda: self.pick(LOWER, 24, 40), lambda: self.pick(UPPER, 24, 40), lambda: self.pick(mixed + "+/", 22, 42) + "==", lambda: self.pick(mixed + "_-", 24, 43),
        ))()

    def short(self) -> str:
        """A secret that only what announces it gives away."""
        return self.rng.choice((lambda: self.word()[:8] + self.pick(DIGITS, 1, 4), lambda: self.pick(LOWER + UPPER + DIGITS, 7, 14), lambda: self.pick(DIGITS, 12, 24), lambda: self.word()[:4].title() + self.pick(DIGITS, 2) + self.word()[:4], lambda: self.pick(LOWER, 3) + self.pick(DIGITS, 3) + self.pick(LOWER + "_-", 3)))()

    def plain(self) -> str:
        """What looks alike and is none."""
        return self.rng.choice((
            lambda: f"{self.word()}-{self.word()}-{self.pick(DIGITS, 4)}", lambda: f"{self.word()}{self.pick(DIGITS, 1, 3)}.example.com", lambda: f"20{self.pick(DIGITS, 2)}-0{self.pick('123456789', 1)}-1{self.pick(DIGITS, 1)}T1{self.pick(DIGITS, 1)}", lambda: f"{self.word()}/{self.word()}/{self.word()}{self.pick(DIGITS, 2)}.txt",
            lambda: f"version-{self.pick(DIGITS, 1)}.{self.pick(DIGITS, 2)}.{self.pick(DIGITS, 1)}", lambda: self.word() + self.word() + self.pick(DIGITS, 1, 2), lambda: f"{self.word()}_{self.word()}_{self.pick(DIGITS, 2)}", lambda: self.pick(DIGITS, 12) + "kg", lambda: f"ISBN-978-{self.pick(DIGITS, 4)}-{self.pick(DIGITS, 3)}",
            lambda: self.word().title() + self.word().title() + self.word().title() + "Factory", lambda: "https-" + "-".join(self.word() for _ in range(4)) + self.pick(DIGITS, 2), lambda: "".join(self.word() for _ in range(4)), lambda: self.pick(DIGITS, 4, 10), lambda: self.word(), lambda: "+" + self.pick(DIGITS, 10, 13), lambda: f"{self.word()}.{self.word()}{self.pick(DIGITS, 0, 3)}",
        ))()

    # generators: lists of texts, secrets as one-element tuples

    def config(self) -> list:
        quote = self.rng.choice(("", "", '"', "'"))
        return [f"{self.prose(0, 3)} {self.cue()}{self.rng.choice((' = ', ': ', '=', ' => ', ' -> '))}{quote}", (self.key() if self.rng.random() < 0.6 else self.short(),), f"{quote} {self.prose(0, 4)}"]

    def header(self) -> list:
        return [f"{self.rng.choice(('Authorization: ', 'authorization = ', '', 'X-Auth: '))}{self.rng.choice(('Bearer ', 'bearer ', 'Basic ' , 'Token '))}", (self.key(),), f"\n{self.prose(1, 4)}"] if self.rng.random() < 0.8 else [f"{self.prose()} with Bearer ", (self.key(),), f" {self.prose()}"]

    def export(self) -> list:
        return [f"{self.rng.choice(('export ', 'set ', 'ENV ', ''))}{self.rng.choice((self.word().upper(), self.word().upper() + '_' + self.rng.choice(CUES).upper()))}=", (self.key(),), f"\n{self.prose(0, 4)}"]

    def said(self) -> list:
        long = self.rng.random() < 0.5
        return [f"{self.prose(0, 4)} {self.cue()} {self.rng.choice(('', '', 'is ', 'was '))}", (self.key() if long else self.short(),), f" {self.rng.choice(('here', 'is mine', 'for now', self.prose(1, 3)))}"]

    def alone(self) -> list:
        return [f"{self.prose(1, 5)} ", (self.rng.choice(("ghp_", "sk_live_", "glpat-", "AIza", "")) + self.pick(LOWER + UPPER + DIGITS, 28, 44),), f" {self.prose(1, 5)}"]

    def wrapped(self) -> list:
        lines = [(self.pick(LOWER + UPPER + DIGITS + "+/", 64),) for _ in range(self.rng.randint(2, 5))]
        return [self.rng.choice(("-----BEGIN PRIVATE KEY-----\n", f"{self.near()} secret = ", f"{self.cue()}: |\n")), *[x for line in lines for x in (line, "\n")], self.rng.choice(("-----END PRIVATE KEY-----", self.prose(1, 3)))]

    def json(self) -> list:
        return ['{"', self.word(), '": "', self.plain(), f'", "{self.cue()}": "', (self.key() if self.rng.random() < 0.7 else self.short(),), '", "', self.word(), f'": {self.pick(DIGITS, 2, 6)}}}']

    def talk(self) -> list:
        ends = ("none", "true", "false", "string", "required", "value", "optional", "reset", "policy", "holder", "point", "ring", "changes", "expired", self.word() + "ing", self.word() + "ed", self.word(), self.plain() if self.rng.random() < 0.3 else self.word())
        return [f"{self.prose(0, 5)} {self.cue()}{self.rng.choice((' ', ' ', ' ', ': ', ' of ', ' is '))}{self.rng.choice(ends)} {self.prose(1, 8)}"]

    def settings(self) -> list:
        return [f"{self.prose(0, 4)} {self.rng.choice(SETTINGS) if self.rng.random() < 0.6 else self.word()}{self.rng.choice((' ', ' = ', ': ', '=', ': ', ' -> '))}{self.plain()} {self.prose(0, 5)}"]

    def passage(self) -> list:
        return [f"{self.prose(2, 9)}{self.rng.choice((': ', '. ', ' - ', ', '))}{self.plain()} {self.prose(2, 9)}"]


#: Kinds of generated lines and how often each comes.
GENERATORS = {"config": 5, "header": 2, "export": 3, "said": 3, "alone": 2, "wrapped": 1, "json": 2, "talk": 5, "settings": 6, "passage": 6}


def training_chains(seed: int = 7, n: int = 2000, kinds: tuple[str, ...] = tuple(GENERATORS)) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Generated lines with their secret tokens: (text, [(start, end, tag)])."""
    lines = Lines(seed)
    for _ in range(n):
        kind = lines.rng.choices(kinds, [GENERATORS[k] for k in kinds])[0]
        text, tags = "", []
        for part in getattr(lines, kind)():
            if isinstance(part, tuple):
                # tokens on lines that follow each other are one secret
                follows = tags and not text[tags[-1][1] :].strip()
                tags.append((len(text), len(text) + len(part[0]), INSIDE if follows else BEGIN))
                part = part[0]
            text += part
        yield text, tags


class Rows(dict):
    """Numbers of strings, and a row of values for each, made when it is first asked for."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], width: int) -> None:
        self.make, self.values = make, np.zeros((1024, width))

    def of(self, keys: list[str]) -> np.ndarray:
        self.learn(keys)
        return self.values[np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))]

    def learn(self, keys: list[str]) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        new = [k for k in set(keys) if k not in self]
        if new:
            n = len(self)
            while n + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[n : n + len(new)] = self.make(new)
            self.update(zip(new, range(n, n + len(new)), strict=True))


class Field:
    """Feature weights per tag, and transitions between tags."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights, moves
        # by distance of the cue, gap before and own kind; by gap after
        self.at = np.array([[[self.summed([f"gap={g}", f"cue={d}", f"cue={d}&gap={g}", f"cue={d}&gap={g}&{o}", f"{o}&gap={g}"]) for o in OWN] for g in GAPS] for d in range(4)])
        self.next = np.array([self.summed([f"next={g}"]) for g in GAPS])
        self.code = np.array([self.summed(["code", f"code&cue={d}"]) for d in range(4)])
        self.first, self.closed, self.shapes = self.summed(["first"]), self.summed(["closed"]), {}
        # by number of alike()
        self.plain, self.blank = {}, np.zeros(5)
        names_beside = {f.partition("=")[2] for f in names if f.startswith(("before=", "after="))}
        self.beside = {w: np.r_[self.summed([f"before={w}"]), self.summed([f"after={w}"])] for w in names_beside}
        self.words, self.gaps = Rows(self._words, 11), Rows(self._gaps, 4)

    def __reduce__(self):
        return Field, (self.names, self.weights, self.moves)

    def learn(self, texts: list[str]) -> None:
        """Look at the words and gaps of many texts at once; that costs less than text by text."""
        parts = [split(t) for t in texts]
        self.words.learn([w for words, _ in parts for w in words])
        self.gaps.learn([g for _, gaps in parts for g in near_gaps(gaps)])

    def summed(self, found: Iterable[str]) -> np.ndarray:
        return self.weights[[self.names[f] for f in found if f in self.names]].sum(0)

    def _words(self, words: list[str]) -> np.ndarray:
        """Weights by shape, of what follows a word and of what is before it, whether it is a cue and its own kind."""
        out = np.zeros((len(words), 11))
        key = alike(words)
        same, first, which = np.unique(key, return_index=True, return_inverse=True)
        for at, k in zip(same.tolist(), first.tolist(), strict=True):
            if at >= 0 and at not in self.plain:
                self.plain[at] = self._shape(words[k])
        plain = np.array([self.plain.get(at, self.blank) for at in same.tolist()])[which]
        out[:, :3], out[:, 9:] = plain[:, :3], plain[:, 3:]
        for k in np.flatnonzero(key < 0).tolist():
            own = self._shape(words[k])
            out[k, :3], out[k, 9:] = own[:3], own[3:]
        for k, word in enumerate(words):
            low = word.lower()
            if len(word) < 14 and low in self.beside:
                out[k, 3:9] = self.beside[low]
        return out

    def _shape(self, word: str) -> np.ndarray:
        known = figures(word)
        row = self.shapes.get(known)
        if row is None:
            if len(self.shapes) > REMEMBERED:
                self.shapes.clear()
            row = self.shapes[known] = self.summed(shape_of(known))
        return np.array([*row, known[-1][10], OWN.index(own_kind(word))])

    def _gaps(self, gaps: list[str]) -> np.ndarray:
        return np.array([(GAPS.index(between(g)), g[:1] in QUOTES, g[-1:] in QUOTES, has_cue(g)) for g in gaps])

    def emissions(self, words: list[str], gaps: list[str], code: bool) -> np.ndarray:
        """What each token adds to the score of each tag: the weights of features(), looked up."""
        w, g = self.words.of(words), self.gaps.of(near_gaps(gaps))
        kind = g[:, 0].astype(np.int64)
        n, line, cue = len(w), kind[:-1] == GAPS.index("line"), w[:, 9] > 0
        far, cut = np.zeros(n, np.int64), np.zeros(n, bool)
        for d in range(1, min(4, n)):
            cut[d:] |= line[1 : n - d + 1]
            far[d:] = np.where((far[d:] == 0) & cue[: n - d] & ~cut[d:], d, far[d:])
        far[(far == 0) & (g[:-1, 3] > 0)] = 1
        out = w[:, :3] + self.at[far, kind[:-1], w[:, 10].astype(np.int64)] + self.next[kind[1:]]
        out[1:] += w[:-1, 3:6]
        out[:-1] += w[1:, 6:9]
        out[0] += self.first
        out[(g[1:, 1] > 0) & (g[:-1, 2] > 0)] += self.closed
        return out + self.code[far] if code else out

    def surely_out(self, e: np.ndarray) -> np.ndarray:
        """Tokens that no best tagging has begin or inside: another tag there can be made outside, the inside token
        after it, if there is one, a begin, and the score rises whatever stands on both sides."""
        m, out = self.moves, np.ones(len(e), bool)
        follow = np.r_[e[1:, BEGIN] - e[1:, INSIDE], np.inf]
        for tag in (BEGIN, INSIDE):
            before = min(m[a, OUT] - m[a, tag] for a in (OUT, BEGIN, INSIDE) if (a, tag) != (OUT, INSIDE))
            gain = e[:, OUT] - e[:, tag] + min(before, 0.0)
            loose = min(0.0, *(m[OUT, b] - m[tag, b] for b in (OUT, BEGIN)))
            tied = m[OUT, BEGIN] - m[tag, INSIDE] + min(0.0, *(m[BEGIN, c] - m[INSIDE, c] for c in (OUT, BEGIN, INSIDE)))
            out &= (gain + loose > SURE) & (gain + follow + tied > SURE)
        return out

    def best(self, e: np.ndarray) -> list[tuple[int, int]]:
        """Place and tag of the tokens that the best tagging has not outside."""
        live = np.flatnonzero(~self.surely_out(e))
        found = []
        for part in np.split(live, np.flatnonzero(np.diff(live) > 1) + 1) if len(live) else ():
            some, first, last = e[part], int(part[0]), int(part[-1])
            if first:
                some[0] += self.moves[OUT]
            if last + 1 < len(e):
                some[-1] += self.moves[:, OUT]
            found += [(first + k, tag) for k, tag in enumerate(self.viterbi(some)) if tag != OUT]
        return found

    def viterbi(self, e: np.ndarray) -> list[int]:
        best, back = e[0] + np.array([0, 0, -np.inf]), []
        for row in e[1:]:
            step = best[:, None] + self.moves
            back.append(step.argmax(0))
            best = step.max(0) + row
        tag = int(best.argmax())
        path = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            path.append(tag)
        return path[::-1]


#: Words whose weights a worker remembers, about, and what rounding may take from a gain.
REMEMBERED = 200_000
SURE = 1e-6
#: A feature counts from this many tokens on.
LEAST_SEEN = 4


@functools.cache
def trained(kinds: tuple[str, ...] = tuple(GENERATORS), epochs: int = 90, rate: float = 0.15, shrink: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward over all chains at once, with Adam. kinds: generators to learn from."""
    found, tags = [], []
    for text, truth in training_chains(kinds=kinds):
        known = {(a, b): t for a, b, t in truth}
        words, gaps = split(text)
        if words:
            found.append(features(words, gaps, is_code(text)))
            tags.append([known.get(s, OUT) for s in spans_of(words, gaps)])
    often = Counter(f for chain in found for token in chain for f in token)
    names = {f: k for k, f in enumerate(sorted(f for f, n in often.items() if n >= LEAST_SEEN))}
    n, longest, size = len(found), max(map(len, found)), len(names)
    rows = [[names[f] for f in token if f in names] for chain in found for token in chain]
    # features of all tokens one after another, and where the tokens stand in (chain, place)
    at, owner = np.array([k for row in rows for k in row]), np.repeat(np.arange(len(rows)), list(map(len, rows)))
    place = np.array([i * longest + k for i, chain in enumerate(found) for k in range(len(chain))])
    y, mask = np.zeros((n * longest, 3)), np.zeros(n * longest, bool)
    mask[place] = True
    y[place, [t for chain in tags for t in chain]] = 1
    y, mask = y.reshape(n, longest, 3), mask.reshape(n, longest)
    barred = np.zeros((3, 3))
    barred[OUT, INSIDE] = -1e9
    start = np.array([0, 0, -1e9])
    w, moves = np.zeros((size, 3)), np.zeros((3, 3))
    seen = (y[:, :-1, :, None] * y[:, 1:, None, :]).sum((0, 1))
    lse = lambda z, axis: z.max(axis) + np.log(np.exp(z - z.max(axis, keepdims=True)).sum(axis))
    sums = lambda values, into, many: np.stack([np.bincount(into, values[:, k], many) for k in range(3)], 1)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    for epoch in range(1, epochs + 1):
        e, t = np.zeros((n * longest, 3)), moves + barred
        e[place] = sums(w[at], owner, len(rows))
        e = e.reshape(n, longest, 3)
        f = np.zeros((n, longest, 3))
        f[:, 0] = e[:, 0] + start
        for k in range(1, longest):
            f[:, k] = np.where(mask[:, k, None], lse(f[:, k - 1, :, None] + t, 1) + e[:, k], f[:, k - 1])
        b = np.zeros((n, longest, 3))
        for k in range(longest - 2, -1, -1):
            b[:, k] = np.where(mask[:, k + 1, None], lse(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2), 0)
        z = lse(f[:, -1], 1)
        p = np.exp(f + b - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(f[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        wrong = (p - y).reshape(-1, 3)[place]
        grads = (sums(wrong[owner], at, size) / n + shrink * w, (pair.sum((0, 1)) - seen) / n + shrink * moves)
        for j, (value, g) in enumerate(zip((w, moves), grads, strict=True)):
            m, v = state[2 * j], state[2 * j + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return Field(names, w, moves + barred)


def tagged(text: str, field: Field) -> list[list[tuple[int, int]]]:
    """Tokens of each span the field finds: a begin token with the inside tokens after it."""
    words, gaps = split(text)
    found = field.best(field.emissions(words, gaps, is_code(text))) if words else []
    if not found:
        return []
    spans = spans_of(words, gaps)
    out: list[list[tuple[int, int]]] = []
    for k, tag in found:
        if tag == BEGIN:
            out.append([spans[k]])
        else:
            out[-1].append(spans[k])
    return out


def tagged_spans(text: str, field: Field) -> list[Span]:
    return [(tokens[0][0], tokens[-1][1], "crf") for tokens in tagged(text, field)]


def cover(base: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the base spans cover together; base is by start."""
    starts, ends = [], []
    for a, b, _ in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those the field adds: all with a token that the base spans don't cover."""
    base = base_spans(text)
    starts, ends = cover(base)

    def covered(token: tuple[int, int]) -> bool:
        k = bisect.bisect_right(starts, token[0]) - 1
        return k >= 0 and ends[k] >= token[1]

    return base, [(tokens[0][0], tokens[-1][1], "crf") for tokens in tagged(text, field) if not all(map(covered, tokens))]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find(docs: DataFrame) -> DataFrame:
    """Per document the base and all spans as strings, and how many base spans of each kind."""
    field = trained()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        base_text, all_text, counts = [], [], {k: [] for k in KINDS[:3]}
        field.learn([t or "" for t in batch["text"].to_pylist()])
        for text in batch["text"].to_pylist():
            base, more = all_spans(text or "", field)
            base_text.append(joined(base))
            all_text.append(joined(base + more))
            for k in counts:
                counts[k].append(sum(s[2] == k for s in base))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **{f"n_{k}": v for k, v in counts.items()}, "base": base_text, "spans": all_text})

    return common.map_slices(docs.select("doc_id", "text"), "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string", run)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by [kind]; n_chars follows, all other columns stay."""
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                part = batch.slice(at, common.SLICE_ROWS)
                texts = []
                field.learn([t or "" for t in part["text"].to_pylist()])
                for text in part["text"].to_pylist():
                    base, more = all_spans(text or "", field)
                    out, last = [], 0
                    for a, b, kind in sorted(base + more):
                        if b > last:
                            out += [text[last : max(a, last)], f"[{kind}]"]
                            last = b
                    texts.append("".join([*out, text[last:]]) if out else text)
                k = part.schema.get_field_index("text")
                yield part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op2_secrets": op2_secrets}
SQL: dict[str, str] = {}
