"""Finds personal data, also disguised, and gives spans of the source text."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The patterns of the query contract; as written they could take quadratic time on long runs of digits, so a run is tried once only.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile("[^0-9]")

#: Letters that look like Latin ones (Cyrillic and Greek), and what is invisible; fixed values.
LOOKALIKES = dict(zip("аеорсухіјѕԁԛԝАВЕКМНОРСТХІЈЅαοινρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․‧∙。﹒", "aeopcyxijsdqwABEKMHOPCTXIJSaoivptuxABEZHIKMNOPTYX.....", strict=True))
INVISIBLE = "­​‌‍⁠﻿"
#: Spelled digits in English, German, French and Spanish; fixed values.
SPELLED = {
    w: str(d)
    for line in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(line.split())
} | {"oh": "0", "plus": "+"}
NUMBER = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
SPELLED_RUN = re.compile(rf"(?<!\w){NUMBER}(?:[\s,-]+{NUMBER}){{3,}}(?!\w)", re.I)
SPELLED_ONE = re.compile(rf"{NUMBER}|[\s,-]+", re.I)
LEFT, RIGHT = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
AT = re.compile(rf"{LEFT}(?:at|@){RIGHT}|&#64;|%40|(?<=[A-Za-z0-9])\s+(?:at|AT)\s+(?=[A-Za-z0-9-]+(?:\s+(?:dot|DOT)\s|{LEFT}(?:dot|\.){RIGHT}))", re.I)
DOT = re.compile(rf"{LEFT}(?:dot|point|punkt|punto|\.){RIGHT}|(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])", re.I)
LEET = re.compile(r"(?<=[0-9])[OoIl](?=[0-9])")
HINTS = re.compile(r"\bdot\b|[\[({<]\s*(?:at|@|dot|point|punkt|punto|\.)\s*[\])}>]|&#64;|%40|[0-9][OoIl][0-9]", re.I)
ODD = re.compile("[" + "".join(LOOKALIKES) + INVISIBLE + "！-～٠-٩۰-۹०-९\U0001d7ce-\U0001d7ff]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += (d * 2 - 9 if d > 4 else d * 2) if i & 1 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and domain, from one @ to the next."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def detect(text: str) -> list[tuple[int, int, int]]:
    """The base spans (kind, start, end), in order."""
    out = [(0, a, b) for a, b in emails(text)]
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


class Tape:
    """A text being rewritten, with the source span of each of its pieces."""

    def __init__(self, text: str):
        self.text, self.starts, self.source = text, [0], [(0, len(text), True)]  # piece starts; (start, end, copied as it is)

    def back(self, a: int, b: int) -> tuple[int, int, bool]:
        """The source span of text[a:b], and whether any of it was rewritten."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        start = self.source[i][0] + (a - self.starts[i] if self.source[i][2] else 0)
        end = self.source[j][0] + b - self.starts[j] if self.source[j][2] else self.source[j][1]
        return start, end, not all(s[2] for s in self.source[i : j + 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """A transducer's output: each (start, end, replacement) of the present text takes effect, the rest is copied."""
        out, at, pieces, starts, source = Tape(""), 0, [], [], []

        def copy(a: int, b: int) -> None:
            i = bisect_right(self.starts, a) - 1
            while a < b:
                stop = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
                s, e, plain = self.source[i]
                starts.append(sum_[0])
                source.append((s + a - self.starts[i], s + stop - self.starts[i], True) if plain else (s, e, False))
                pieces.append(self.text[a:stop])
                sum_[0] += stop - a
                a, i = stop, i + 1

        sum_ = [0]
        for a, b, new in edits:
            copy(at, a)
            if new:
                s, e, _ = self.back(a, b)
                starts.append(sum_[0])
                source.append((s, e, False))
                pieces.append(new)
                sum_[0] += len(new)
            at = b
        copy(at, len(self.text))
        out.text, out.starts, out.source = "".join(pieces), starts or [0], source or [(0, 0, True)]
        return out


def plain_char(c: str) -> str:
    if c in INVISIBLE:
        return ""
    return LOOKALIKES.get(c) or (str(unicodedata.digit(c)) if unicodedata.digit(c, None) is not None else unicodedata.normalize("NFKC", c))


def disguised(text: str) -> list[tuple[int, int, int]]:
    """The spans (kind, start, end) in the source text of what is found only after the transducers have rewritten it."""
    odd = not text.isascii() and ODD.search(text)
    spelled = SPELLED_RUN.search(text)
    if not (odd or spelled or HINTS.search(text)):
        return []
    tape = Tape(text)
    if odd:
        tape = tape.rewrite([(*m.span(), plain_char(m[0])) for m in ODD.finditer(tape.text)])
    runs = [(m.start() + x.start(), m.start() + x.end(), SPELLED.get(x[0].lower(), " ")) for m in SPELLED_RUN.finditer(tape.text) for x in SPELLED_ONE.finditer(m[0])]
    if runs:  # "plus" joins the digit behind it
        tape = tape.rewrite([(a, b, "" if new == " " and k and runs[k - 1][2] == "+" else new) for k, (a, b, new) in enumerate(runs)])
    tape = tape.rewrite([(*m.span(), "@") for m in AT.finditer(tape.text)])
    tape = tape.rewrite([(*m.span(), ".") for m in DOT.finditer(tape.text)])
    tape = tape.rewrite([(*m.span(), "0" if m[0] in "Oo" else "1") for m in LEET.finditer(tape.text)])
    found = ((k, *tape.back(a, b)) for k, a, b in detect(tape.text))
    return [(k, a, b) for k, a, b, rewritten in found if rewritten]


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans of a text, and those that the transducers add; an added span overlaps no base span of its kind."""
    base = detect(text)
    ends = [[(b, a) for k2, a, b in base if k2 == k] for k in range(len(KINDS))]  # in order, as spans of a kind don't overlap
    added: list[tuple[int, int, int]] = []
    for k, a, b in disguised(text):
        at = bisect_right(ends[k], (a, len(text)))  # the first that ends behind a
        if at == len(ends[k]) or ends[k][at][1] >= b:
            added.append((k, a, b))
    return base, added


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are of the base spans, those in the text as it stands; spans has these and the
    added ones, kind:start:end in code points, by kind and start. Null text counts as empty and gives no span.
    Very long texts are scanned whole in linear time. Repeated rows get a row each; other columns are ignored;
    an empty table gives an empty result.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, added = spans(text)
                counts = [0] * len(KINDS)
                for k, _, _ in base:
                    counts[k] += 1
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy() if batch["doc_id"].notna().all() else batch["doc_id"].astype("Int64"))
            yield out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(scan, schema)
