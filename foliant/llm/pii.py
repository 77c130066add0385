"""Operator 4: personal data, found through offset-preserving deobfuscation.

Base patterns find plain identifiers. Then a transducer rewrites disguises - homoglyphs and other digits, spelled
digits, invisible characters, at/dot words - while it keeps, for every character written, the source characters it
stands for. The same patterns run over the rewritten text and their spans are mapped back; a mapped span that no base
span of its kind overlaps is added, and so is an address that reaches beyond a base address. Only texts with something
to rewrite take the second pass; what it would find elsewhere is what the base patterns found. Numbers that mix digits and spelled digits, and addresses of four numbers with disguised dots,
are rewritten in texts of their own: prose has words such as "un" beside digits, which must not spoil other spans.

Defined results: a null or empty text has no spans; repeated rows are scanned each on its own; long texts are
scanned whole, in time linear in their length; other columns are not read.
"""

from __future__ import annotations

import bisect
import copy
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliant.llm import common

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a digit run fails or succeeds like the start of the run, so only run starts are tried.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each kind that pass its test, by start and then kind."""
    found: list[tuple[int, int, int]] = []
    last = 0
    at = text.find("@")
    while at >= 0:
        # the local part runs left over its characters, but not into the match before
        first = at
        while first > last and text[first - 1] in LOCAL:
            first -= 1
        m = DOMAIN.match(text, at) if first < at else None
        if m:
            found.append((first, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


# Spelled digits of the corpus languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Letters of other scripts drawn like Latin ones.
HOMOGLYPHS = dict(
    zip(
        "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456\u0458\u0455\u0501\u051b\u051d\u04bb\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0423\u0425\u0406\u0408\u0405\u03b1\u03bf\u03c1\u03bd\u03b9\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7",
        "aeopcyxijsdqwhABEKMHOPCTYXIJSaopviABEZHIKMNOPTYX",
        strict=True,
    )
)
#: A run of spelled digits as long as this is taken for a number; ordinary prose has single ones.
SPELLED_RUN = 4
def bracketed(words: str) -> str:
    # spaces count from the start of their run only, so that a long run is read once
    return rf"(?:(?<![ \t])[ \t]++)?[\[({{<][ \t]*+(?:{words})[ \t]*+[\])}}>][ \t]*+"


AT = bracketed("at|@|arroba")
DOT = bracketed(r"dot|\.|punkt|point|punto")
WORDS = sorted(DIGIT_WORDS, key=len, reverse=True)
SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]+)?(?:{'|'.join(WORDS)})(?:[ ,.-]{{1,2}}(?:{'|'.join(WORDS)})(?!\w)){{{SPELLED_RUN - 1},}}(?!\w)", re.I)
PART = r"[A-Za-z0-9-]+"
SIGN = rf"{AT}|[ ]at[ ]|_at_|[ ]@[ ]|@|%40|&#64;"
AT_SIGN = re.compile(SIGN, re.I)
#: What follows the sign of an address, dots disguised or not.
HOST = re.compile(rf"{PART}(?:(?:\.|{DOT}|[ ]dot[ ]|_dot_){PART})+", re.I)
#: The same after a sign between blanks.
HOST_SPACED = re.compile(rf"{PART}(?:(?:\.|{DOT}|[ ]dot[ ]|[ ]\.[ ]){PART})+", re.I)
#: What stands before it, read from right to left.
BACK_DOT = r"[ \t]*+[\])}>][ \t]*+(?:tod|\.|tknup|tniop|otnup)[ \t]*+[\[({<](?:[ \t]++(?![ \t]))?"
BACK_LOCAL = re.compile(rf"[A-Za-z0-9_%+-]++(?:(?:\.|{BACK_DOT}|[ ]tod[ ])[A-Za-z0-9_%+-]++)*+", re.I)
FIRST = re.compile("[A-Za-z0-9]")
DOTS = re.compile(rf"{DOT}|[ ]dot[ ]|_dot_|[ ]\.[ ]", re.I)
#: What a disguised address holds, in lower case; a first test only.
BRACKETS = re.compile(r"[\[({<][ \t]*+(?:at|@|arroba|dot|\.|punkt|point|punto)[ \t]*+[\])}>]|%40|&#64;")
PLAIN_AT = re.compile(rf" at {PART}\.(?:{PART}\.)*[a-z]{{2,}}(?![a-z0-9-])| @ {PART} ?\.|_at_{PART}(?:\.|_dot_)")
SPACES = re.compile("[\u00a0\u2007\u2009\u202f]")


ONE = rf"(?<!\w)(?:{'|'.join(WORDS)})(?!\w)"
BETWEEN = "[ ,.()-]{1,3}"
#: A number of digits and spelled digits; what makes one worth a look is a word beside a digit.
MIXED = re.compile(rf"(?<!\w)(?:plus[ -]+)?(?:[0-9]++|{ONE})(?:{BETWEEN}(?:[0-9]++|{ONE}))+", re.I)
MIXED_PARTS = re.compile(r"[0-9]+|[^\W\d_]+|[\W_]+")
IP_DOT = rf"(?:{DOT}|[ \t]+(?:dot|punkt|point|punto)[ \t]+|\.)"
DIGIT, PAIR = "(?<![0-9])[0-9](?![0-9])", "(?<![0-9])[0-9]{2}(?![0-9])"
#: Digits, or up to three of which at least one is spelled.
OCTET = rf"(?:{ONE}[ -]{PAIR}|{PAIR}[ -]{ONE}|{ONE}(?:[ -](?:{ONE}|{DIGIT})){{0,2}}|{DIGIT}[ -]{ONE}(?:[ -](?:{ONE}|{DIGIT}))?|{DIGIT}[ -]{DIGIT}[ -]{ONE}|(?<![0-9])[0-9]++)"
DOTTED = re.compile(rf"{OCTET}(?:{IP_DOT}{OCTET}){{3,}}", re.I)
DOTTED_PARTS = re.compile(rf"(?P<dot>{IP_DOT})|(?P<word>{ONE})|[0-9]+|[ -]", re.I)
#: For the first tests: bytes of words as they are, all other ASCII as a space; what a word is to a number.
WORD_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
ROLES = dict.fromkeys((w.encode() for w in [*WORDS, "plus"]), 1) | dict.fromkeys((b"dot", b"punkt", b"point", b"punto"), 3)
DOT_AMONG = re.compile(b"[\x01\x02]\x03[\x01\x02]")


def roles(low: str) -> bytes:
    """A byte per word: 1 a spelled digit or plus, 2 begins with a digit, 3 a spelled dot, 0 others."""
    return bytes([ROLES.get(w) or (2 if 48 <= w[0] <= 57 else 0) for w in low.encode(errors="replace").translate(WORD_BYTES).split()])


class Rewriter:
    """Text under rewriting: where each character comes from, [first, last) in the source."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.first = list(range(len(text)))
        self.last = list(range(1, len(text) + 1))

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Put strings in place of disjoint ascending ranges. A written character stands for the whole range."""
        out, first, last, at = [], [], [], 0
        for a, b, new in edits:
            out += [self.text[at:a], new]
            first += self.first[at:a] + [self.first[a]] * len(new)
            last += self.last[at:a] + [self.last[b - 1]] * len(new)
            at = b
        out.append(self.text[at:])
        self.first, self.last, self.text = first + self.first[at:], last + self.last[at:], "".join(out)


def plain_letter(c: str) -> str | None:
    """The ASCII character that c disguises, if any."""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    if unicodedata.east_asian_width(c) == "F" or unicodedata.category(c) in ("Lu", "Ll", "Nd", "So", "No") and unicodedata.decomposition(c).startswith(("<font>", "<circle>")):
        folded = unicodedata.normalize("NFKC", c)
        return folded if len(folded) == 1 and folded.isascii() else None
    return {"․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "−": "-"}.get(c)


#: Characters that are not seen; rewriting leaves them out.
UNSEEN = "\u00ad\u200b-\u200f\u2060-\u2064\ufeff"
INVISIBLE = re.compile(f"[{UNSEEN}]")
#: Decimal digits of all other scripts.
FOREIGN_DIGITS = "".join(c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd")
#: Characters that rewriting may replace: what is not seen, Greek, Cyrillic, foreign digits, full-width and mathematical letters, odd dots, dashes and spaces.
EXOTIC = re.compile(f"[{UNSEEN}{FOREIGN_DIGITS}" + "\u0370-\u03ff\u0400-\u052f\u2010\u2011\u2024\u2212\u2460-\u24ff\u3002\ufe52\uff01-\uff5e\U0001d400-\U0001d7ff\u00a0\u2007\u2009\u202f]")


#: A first test for those.
BEYOND_LATIN = re.compile("[\u00a0\u00ad\u0370-\U0010ffff]")


def mixed_edits(text: str) -> list[tuple[int, int, str]]:
    """Spelled digits as digits where they make a number with digits beside them."""
    edits = []
    for m in MIXED.finditer(text):
        parts = list(MIXED_PARTS.finditer(m[0]))
        kinds = ["d" if p[0][0].isdecimal() else "w" if p[0][0].isalpha() else "" for p in parts]
        size = sum(len(p[0]) if k == "d" else p[0].lower() != "plus" for p, k in zip(parts, kinds, strict=True) if k)
        if "w" not in kinds or "d" not in kinds or size < SPELLED_RUN:
            continue
        for k, p in enumerate(parts):
            if kinds[k] == "w":
                new = "+" if p[0].lower() == "plus" else DIGIT_WORDS[p[0].lower()]
            elif kinds[k] == "d" or "w" not in kinds[k - 1 : k + 2]:
                continue
            elif kinds[k - 1] == kinds[k + 1] or parts[k - 1][0].lower() == "plus":
                new = ""
            else:
                new = re.sub(" +", " ", p[0].replace(",", "")) or " "
            edits.append((m.start() + p.start(), m.start() + p.end(), new))
    return edits


def dotted_edits(text: str) -> list[tuple[int, int, str]]:
    """Four numbers or more with dots between them, of which something is disguised, as digits and dots."""
    edits = []
    for m in DOTTED.finditer(text):
        if not m[0].replace(".", "").isdecimal():
            for p in DOTTED_PARTS.finditer(m[0]):
                if not p[0].isdecimal():
                    edits.append((m.start() + p.start(), m.start() + p.end(), "." if p["dot"] else DIGIT_WORDS[p["word"].lower()] if p["word"] else ""))
    return edits


def address_edits(text: str) -> list[tuple[int, int, str]]:
    """Disguised signs and dots of addresses as what they stand for. From each sign the local part is read leftwards and
    the host rightwards; neither holds a sign, so a text is read a fixed number of times."""
    signs = list(AT_SIGN.finditer(text))
    backwards = text[::-1] if signs else ""
    edits: list[tuple[int, int, str]] = []
    for m in signs:
        local, host = BACK_LOCAL.match(backwards, len(text) - m.start()), (HOST_SPACED if m[0] == " @ " else HOST).match(text, m.end())
        if not local or not host:
            continue
        first = FIRST.search(text, len(text) - local.end(), m.start())
        if not first:
            continue
        dots = [d.span() for d in DOTS.finditer(text, first.start(), m.start())]
        behind = [d.span() for d in DOTS.finditer(text, m.end(), host.end())]
        disguised = m[0] != "@" or dots or behind
        clear = m[0].strip().lower() != "at" or behind or re.search(r"\.[a-z]{2,}$", host[0])
        # an end that was the host of the address before is no local part
        if disguised and clear and (not edits or edits[-1][1] <= first.start()):
            edits += [(a, b, ".") for a, b in dots] + [(m.start(), m.end(), "@")] + [(a, b, ".") for a, b in behind]
    return edits


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in source offsets."""
    exotic = not text.isascii() and BEYOND_LATIN.search(text) and EXOTIC.search(text)
    low = text.lower()
    row = roles(low)
    spelled = b"\x01" * SPELLED_RUN in row
    beside = b"\x01\x02" in row or b"\x02\x01" in row
    trigger = " dot " in low or BRACKETS.search(low) or PLAIN_AT.search(low)
    dotted = trigger or DOT_AMONG.search(row)
    if not (exotic or spelled or beside or dotted):
        return []
    doc = Rewriter(text)
    if exotic:
        edits = []
        for m in EXOTIC.finditer(doc.text):
            new = "" if INVISIBLE.match(m[0]) else " " if SPACES.match(m[0]) else plain_letter(m[0])
            if new is not None:
                edits.append((m.start(), m.end(), new))
        doc.apply(edits)
    others = []
    for edits in (mixed_edits(doc.text) if exotic or beside else [], dotted_edits(doc.text) if exotic or dotted else []):
        if edits:
            others.append(copy.copy(doc))
            others[-1].apply(edits)
    edits = []
    if exotic or spelled:
        for m in SPELLED.finditer(doc.text):
            # word for word, so that spans keep their ends; what stands between the words goes
            for w in re.finditer(r"\w+|\W+", m[0]):
                name = w[0].lower()
                edits.append((m.start() + w.start(), m.start() + w.end(), "+" if name == "plus" else DIGIT_WORDS.get(name, "")))
        doc.apply(edits)
    if exotic or spelled or trigger:
        doc.apply(address_edits(doc.text))
    taken = {kind: sorted(s[:2] for s in base if s[2] == kind) for kind in KINDS}
    out: list[Span] = []
    for k, rewritten in enumerate([doc, *others]):
        for a, b, kind in base_spans(rewritten.text):
            first, last = rewritten.first[a], rewritten.last[b - 1]
            # spans of a kind are disjoint but for addresses that reach beyond a base address
            at = bisect.bisect_left(taken[kind], (last, 0))
            met = at > 0 and max(y for _, y in taken[kind][max(0, at - 2) : at]) > first
            beyond = kind == "email" and k == 0 and met and not any(x <= first and last <= y for x, y in taken[kind][max(0, at - 2) : at])
            if not met or beyond:
                out.append((first, last, kind))
                bisect.insort(taken[kind], (first, last))
    return out


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1])))


def find(docs: DataFrame) -> DataFrame:
    """Per document the base and all spans as strings, and how many base spans of each kind."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        base_text, all_text, counts = [], [], {k: [] for k in KINDS}
        for text in batch["text"].to_pylist():
            base = base_spans(text or "")
            more = added_spans(text, base) if text else []
            base_text.append(joined(base, KINDS))
            all_text.append(joined(base + more, KINDS))
            for k in KINDS:
                counts[k].append(sum(s[2] == k for s in base))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **{f"n_{k}": counts[k] for k in KINDS}, "base": base_text, "spans": all_text})

    return common.map_slices(docs.select("doc_id", "text"), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string", run)


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, at = [], 0
    base = base_spans(text)
    for a, b, kind in sorted(base + added_spans(text, base)):
        if b > at:
            out += [text[at : max(a, at)], f"[{kind}]"]
            at = b
    return "".join(out) + text[at:]


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = find(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op4_pii": op4_pii}
SQL: dict[str, str] = {}
