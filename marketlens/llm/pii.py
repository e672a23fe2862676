"""Personal data by weak supervision.

Four strict patterns give the base spans. Looser ones give further candidates: addresses with (at) and (dot) written
out or without a domain, numbers of card length whatever their checksum, telephone numbers without a plus, four-part
numbers with parts over 255. ``LABELERS`` then vote on each candidate (yes, no or abstain): patterns, gazetteers,
checksums, shapes and the words before it. How often each pattern of votes occurs is counted by Spark over the whole
corpus, and expectation-maximisation on these counts estimates every labeler's reliability for yes and for no, without
any labels. Its posteriors are the soft labels of a logistic classifier over votes and surface features, fitted on the
same counts. A candidate that the classifier accepts is a span unless it overlaps a base span; base spans always stay.

The counts have one row for each pattern that occurs, of ``PATTERNS`` that can, so the driver's share does not grow.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

# Base patterns, as fixed; possessive where backing off can't make a match, so that no text costs more than its length.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Loose candidates.
NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])*+")
SPELT_AT = re.compile(r"[(\[{]\x20?at\x20?[)\]}]", re.I)
SPELT_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?|\.)[A-Za-z0-9-]+)+", re.I)
HOST = re.compile(r"[A-Za-z0-9-]+")
DATE = re.compile(r"(?:19|20)[0-9]{2}([-./\x20])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./\x20])[0-9]{1,2}\2(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[-\x20](?:19|20)[0-9]{2}")
QUAD = re.compile(r"[0-9]{1,4}(?:\.[0-9]{1,4}){3}")
#: Digits of a longer number than this are no candidate; characters before a candidate that give its context.
MOST_DIGITS, CONTEXT = 24, 40

# Gazetteers: fixed values.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au ch at jp cn in br ru pl se no dk fi be pt mx".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420", "421")
ISSUERS = ("34", "35", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "64", "65")
CUES = {
    "email": frozenset("email mail e-mail contact write reply to from address correo courriel".split()),
    "ip": frozenset("ip host address server login from addr client node dirección adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit payment pay tarjeta carte karte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax dial whatsapp teléfono téléphone telefon".split()),
}
DENIALS = frozenset("version v ver section release isbn issn order invoice id no number ref token key hash sha md5 build page chapter figure".split())


class Candidate(NamedTuple):
    kind: int
    start: int
    end: int
    base: bool


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each of ``KINDS``: leftmost, without overlap within a kind, failing matches dropped."""
    return [_emails(text), _ips(text), _cards(text), _phones(text)]


def _emails(text: str) -> list[tuple[int, int]]:
    """A match's local part is all that can be one before its @, back to the match before; only if there is no
    domain after this @ does the search go on, so one look at each @ is enough."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        got = DOMAIN.match(text, at + 1) if start < at else None
        if got:
            out.append((start, got.end()))
            free = got.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = sum(int(c) for c in digits[::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]


def candidates(text: str, base: list[list[tuple[int, int]]]) -> list[Candidate]:
    """Base spans, and looser ones that overlap none of them, by start."""
    out = [Candidate(k, a, b, True) for k, spans in enumerate(base) for a, b in spans]
    taken = sorted((c.start, c.end) for c in out)
    loose: list[Candidate] = []
    at = text.find("@")
    while at >= 0:
        loose += _address(text, at, at + 1, HOST)
        at = text.find("@", at + 1)
    for m in SPELT_AT.finditer(text):
        left, right = m.span()
        loose += _address(text, left - (text[left - 1 : left] == " "), right + (text[right : right + 1] == " "), SPELT_DOMAIN)
    for m in NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        shown = m.group()
        n = len(_digits(shown))
        if n > MOST_DIGITS:
            continue
        if QUAD.fullmatch(shown):
            loose.append(Candidate(1, *m.span(), False))
        elif 13 <= n <= 19 and CARD.fullmatch(shown):
            loose.append(Candidate(2, *m.span(), False))
        elif 7 <= n <= 15 and not shown.isdigit():
            loose.append(Candidate(3, *m.span(), False))
    loose.sort(key=lambda c: (c.start, -c.end))
    k, end = 0, 0
    for c in loose:
        while k < len(taken) and taken[k][1] <= c.start:
            k += 1
        j = k  # base spans of different kinds may overlap each other
        while j < len(taken) and taken[j][0] < c.end and taken[j][1] <= c.start:
            j += 1
        clash = j < len(taken) and taken[j][0] < c.end
        if not clash and c.start >= end:
            out.append(c)
            end = c.end
    out.sort(key=lambda c: (c.start, c.end, c.kind))
    return out


def _address(text: str, left: int, right: int, domain: re.Pattern) -> list[Candidate]:
    start = left
    while start and left - start < 64 and text[start - 1] in LOCAL:
        start -= 1
    got = domain.match(text, right) if start < left else None
    return [Candidate(0, start, got.end(), False)] if got else []


# ------------------------------------------------------------------ labelers


def _context(text: str, c: Candidate) -> list[str]:
    return re.findall(r"[\w-]+", text[max(0, c.start - CONTEXT) : c.start].lower())[-3:]


def by_pattern(text: str, shown: str, digits: str, c: Candidate) -> int:
    """The strict pattern."""
    return 1 if c.base else 0


def by_check(text: str, shown: str, digits: str, c: Candidate) -> int:
    """Checksum, ranges and lengths that the kind prescribes."""
    if c.kind == 0:
        return 1 if re.search(r"\.[A-Za-z]{2,}$", shown) else -1
    if c.kind == 1:
        return 1 if all(int(p) <= 255 for p in shown.split(".")) else -1
    if c.kind == 2:
        return 1 if luhn(digits) else -1
    return 1 if 10 <= len(digits) <= 13 else -1


def by_gazetteer(text: str, shown: str, digits: str, c: Candidate) -> int:
    """Top-level domains, card issuers, country codes, and networks that are nobody's."""
    if c.kind == 0:
        return 1 if re.split(r"[^a-z]+", shown.lower())[-1] in TOP_DOMAINS else -1
    if c.kind == 1:
        return -1 if digits.startswith("0") or shown.startswith(("127.", "255.", "0.")) else 0
    if c.kind == 2:
        return 1 if digits.startswith(ISSUERS) else 0
    return 1 if shown.startswith("+") and digits.startswith(COUNTRY_CODES) else 0


def by_cue(text: str, shown: str, digits: str, c: Candidate) -> int:
    """A word before it that announces the kind."""
    return 1 if CUES[KINDS[c.kind]].intersection(_context(text, c)) else 0


def by_denial(text: str, shown: str, digits: str, c: Candidate) -> int:
    """A word before it that announces something else, or a date."""
    return -1 if DENIALS.intersection(_context(text, c)) or (c.kind == 3 and DATE.fullmatch(shown)) else 0


def by_edges(text: str, shown: str, digits: str, c: Candidate) -> int:
    """Stands by itself, not inside a longer token."""
    left = text[c.start - 1] if c.start else " "
    right = text[c.end] if c.end < len(text) else " "
    inside = left.isalnum() or right.isalnum() or left in "_=/\\\"'" or right in "_=/\\\"'"
    return -1 if inside else 1


def by_length(text: str, shown: str, digits: str, c: Candidate) -> int:
    """The usual number of digits or letters of the kind."""
    if c.kind == 0:
        return 1 if 6 <= len(shown) <= 64 else -1
    if c.kind == 1:
        return 1 if 7 <= len(shown) <= 15 else -1
    if c.kind == 2:
        return 1 if len(digits) in (15, 16) else -1
    return 1 if shown.count("(") == shown.count(")") and re.search(r"[0-9]{3}[-. )]+[0-9]{2,4}", shown) else -1


LABELERS = (by_pattern, by_check, by_gazetteer, by_cue, by_denial, by_edges, by_length)
#: Surface features beside the votes: separators within, plus or bracket in front, doubled digits, a line's start.
SURFACE = 4
PATTERNS = len(KINDS) * 3 ** len(LABELERS) * 2**SURFACE


def encode(text: str, c: Candidate) -> int:
    """Kind, votes and surface features as one number below ``PATTERNS``."""
    shown = text[c.start : c.end]
    digits = _digits(shown)
    code = c.kind
    for vote in LABELERS:
        code = 3 * code + vote(text, shown, digits, c) + 1
    bits = (" " in shown or "-" in shown, shown[0] in "+(", bool(re.search(r"([0-9])\1\1", shown)), c.start == 0 or text[c.start - 1] == "\n")
    for b in bits:
        code = 2 * code + b
    return code


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (rows x labelers, -1 to 1) and surface bits of codes."""
    rest = codes.astype(np.int64)
    bits = np.empty((len(codes), SURFACE), np.int64)
    for k in range(SURFACE - 1, -1, -1):
        rest, bits[:, k] = rest // 2, rest % 2
    votes = np.empty((len(codes), len(LABELERS)), np.int64)
    for k in range(len(LABELERS) - 1, -1, -1):
        rest, votes[:, k] = rest // 3, rest % 3 - 1
    return rest, votes, bits


# ------------------------------------------------------------------ estimation


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation for one kind: share of yes, P(vote | class) as (2, labelers, 3), and each pattern's
    posterior of yes. Labelers vote independently given the class. It starts from the sum of the votes; half a
    candidate is added to every cell, so no probability is 0."""
    p = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
    share, table = 0.5, np.full((2, votes.shape[1], 3), 1 / 3)
    for _ in range(rounds):
        yes, no = counts * p, counts * (1 - p)
        share = float((yes.sum() + 0.5) / (counts.sum() + 1))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                on = votes[:, j] == v
                table[1, j, v + 1] = (yes[on].sum() + 0.5) / (yes.sum() + 1.5)
                table[0, j, v + 1] = (no[on].sum() + 0.5) / (no.sum() + 1.5)
        each = np.log(table)[:, np.arange(votes.shape[1])[None, :], votes + 1].sum(axis=2)
        z = np.log(share / (1 - share)) + each[1] - each[0]
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    return share, table, p


def features(kinds: np.ndarray, votes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Per kind: 1, each labeler's yes and no, and the surface bits."""
    one = np.concatenate([np.ones((len(votes), 1)), votes == 1, votes == -1, bits], axis=1).astype(float)
    out = np.zeros((len(votes), len(KINDS) * one.shape[1]))
    for k in range(len(KINDS)):
        on = kinds == k
        out[on, k * one.shape[1] : (k + 1) * one.shape[1]] = one[on]
    return out


def logistic(x: np.ndarray, p: np.ndarray, counts: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic classifier for soft labels, by Newton's steps on the counted log loss with a ridge."""
    w = np.zeros(x.shape[1])
    n = max(1.0, counts.sum())
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (counts * (q - p)) / n + ridge * w / len(w)
        h = (x * (counts * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x / n + ridge * np.eye(len(w)) / len(w)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class Model:
    """What a fit leaves: per kind the share of yes and the labelers' tables, and the classifier's weights."""

    shares: tuple[float, ...]
    tables: tuple[np.ndarray, ...]
    weights: np.ndarray

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(*decode(codes)) @ self.weights, -50, 50)))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Estimate from every candidate of every text. Without candidates of a kind nothing of that kind is accepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(encode(text, c) for c in candidates(text, base_spans(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code")
    got = counted.collect()  # PATTERNS rows at most
    codes, counts = np.array([r["code"] for r in got], np.int64), np.array([r["n"] for r in got], float)
    kinds, votes, bits = decode(codes)
    posterior, shares, tables = np.zeros(len(codes)), [], []
    for k in range(len(KINDS)):
        on = kinds == k
        share, table, p = reliabilities(votes[on], counts[on])
        posterior[on] = p
        shares.append(share)
        tables.append(table)
    return Model(tuple(shares), tuple(tables), logistic(features(kinds, votes, bits), posterior, counts))


# ------------------------------------------------------------------ spans

FOUND = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"]


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by kind, then start, comma-joined; code points, end exclusive."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone (base spans), base_spans and spans (base and accepted ones) as strings.

    A null text counts as empty and gives zeros and empty strings. Rows stay as they are, repeated ones too; own columns
    of these names give way. Texts are read whole, in time that goes by their length.
    """
    docs = docs.drop(*[c for c in FOUND if c in docs.columns])
    at = docs.columns.index(text_col)
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted: dict[int, bool] = {}  # at most PATTERNS
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                text = text or ""
                base = base_spans(text)
                own = [(k, *s) for k, spans in enumerate(base) for s in spans]
                more = []
                for c in candidates(text, base):
                    if not c.base:
                        code = encode(text, c)
                        if code not in accepted:
                            accepted[code] = bool(model.probability(np.array([code]))[0] > threshold)
                        if accepted[code]:
                            more.append((c.kind, c.start, c.end))
                out.append((*(len(s) for s in base), joined(own), joined(own + more)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            arrays = [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], [*b.schema.names, *FOUND])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in zip(FOUND, kinds, strict=True))]))
