"""Personal data: fixed patterns, and further spans by weak supervision.

Labelers (patterns, gazetteers and contexts) vote on candidate spans; expectation
maximisation over the counts of vote patterns estimates how reliable each is; the
posteriors train a logistic span classifier, which decides every candidate.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import texts_of
from .common import sliced, written

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Rows of the bounded, hash-ordered sample that the span classifier is fitted to.
SAMPLE = 20_000
FEATURES = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # no other start in a run of digits gives more
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part is the run before an at sign, so each at sign is tried once."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind, in code points."""
    out = [(s, e, "email") for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and _luhn(d)]
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
        out.sort(key=lambda s: (s[0], _ORDER[s[2]]))
    return out


# Candidates: wide patterns, each anchored so that a long run is read once.
_CANDIDATES = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+")),
    ("phone", re.compile(r"(?<![0-9.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
# An obfuscated address from its at sign on.
_OBFUSCATED = re.compile(r"\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)+")

# Values of any length that a key word and a separator stand before.
_SEPARATOR = re.compile(r"[:=]")
_NAMED = re.compile(r"(?i)(?:passw(?:or)?d|passphrase|passcode|pwd|secret|token|api[_\x20-]?key|credential|(?<![a-z])(?:key|auth|bearer))s?[\"']?\x20?$")
_VALUE = re.compile(r"\x20?[\"']?((?:[^\s\"'`,;<>&]|&(?!\w+=))+)")

# Gazetteers (fixed values).
_KEY_WORDS = frozenset("password passwd pwd secret token apikey api_key key credential auth bearer access_key private_key".split())
_PERSON_WORDS = frozenset("call phone tel telephone mobile fax contact cell ssn social security iban account bank konto compte cuenta telefon telefono".split())
_KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "xox", "sk_", "pk_", "sk-", "AIza", "glpat-", "eyJ")
_URL_BITS = ("http://", "https://", "www.", "://", "doi", "sha256:", "commit")
_IBAN_LANDS = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())


def _iban_ok(span: str) -> bool:
    s = span.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _entropy(s: str) -> float:
    p = np.unique(list(s), return_counts=True)[1] / len(s)
    return float(-(p * np.log2(p)).sum())


def _context(text: str, start: int) -> tuple[str, list[str]]:
    before = text[max(0, start - 40) : start]
    return before, re.findall(r"[a-z_]+", before.lower())[-4:]


#: Labelers: (kind, span, text before, its last words) -> 1 personal, -1 not, 0 no vote.
LABELERS: tuple[Callable[[str, str, str, list[str]], int], ...] = (
    # pattern: a form that is hardly met by chance
    lambda kind, span, before, words: 1 if (
        kind == "secret" and re.fullmatch(r"AKIA[A-Z0-9]{16}|[0-9a-f]{18,64}|gh[po]_[A-Za-z0-9]{36}", span) is not None
        or kind == "ssn" and span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
        or kind in ("phone", "email")
    ) else 0,
    # checksum or randomness; a short span has no more than the logarithm of its length
    lambda kind, span, before, words: (1 if _iban_ok(span) else -1) if kind == "iban" else (1 if _entropy(span) >= min(3.0, 0.8 * np.log2(len(span))) and any(c.isdigit() for c in span) else -1) if kind == "secret" else 0,
    # gazetteer: known heads of keys, countries of account numbers
    lambda kind, span, before, words: 1 if kind == "secret" and span.startswith(_KEY_HEADS) or kind == "iban" and span[:2] in _IBAN_LANDS else -1 if kind == "iban" else 0,
    # gazetteer of words near by
    lambda kind, span, before, words: 1 if set(words) & (_KEY_WORDS if kind == "secret" else _PERSON_WORDS) else 0,
    # context: an assignment or a quotation mark just before
    lambda kind, span, before, words: 1 if kind == "secret" and re.search(r"[=:]\s*[\"']?$", before) is not None else 0,
    # context: a link, a path or a hash of something public
    lambda kind, span, before, words: -1 if any(x in before.lower()[-30:] for x in _URL_BITS) or before.endswith(("/", ".")) else 0,
    # form: words joined by signs, numbers alone
    lambda kind, span, before, words: -1 if kind == "secret" and (not any(c.isdigit() for c in span) or not any(c.isalpha() for c in span) or max(map(len, re.findall(r"[a-z]+|", span))) > 9) else 0,
)


def _assigned(text: str) -> Iterator[tuple[int, int]]:
    """Values that are assigned to a key word; links are none."""
    free = 0
    for sep in _SEPARATOR.finditer(text):
        at = sep.start()
        if at >= free and _NAMED.search(text[max(0, at - 16) : at]) and (m := _VALUE.match(text, at + 1)):
            value = m.group(1).rstrip(".:!?)]}")
            if len(value) >= 4 and "://" not in value:
                yield m.start(1), m.start(1) + len(value)
                free = m.end()


def _obfuscated(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost obfuscated addresses, whole: the local part is the run before an at sign, of any length."""
    free = 0
    m = _OBFUSCATED.search(text)
    while m:
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()
        m = _OBFUSCATED.search(text, free if start < m.start() else m.start() + 1)


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans to be voted on: those of the wide patterns that touch no base span and no earlier candidate."""
    found: list[tuple[int, int, str]] = []
    if _DIGIT.search(text):
        for kind, pattern in _CANDIDATES:
            for m in pattern.finditer(text):
                if kind != "secret" or (_DIGIT.search(m.group()) and re.search(r"[A-Za-z]", m.group())):
                    found.append((*m.span(), kind))
        found += [(a, b, "secret") for a, b in _assigned(text) if _DIGIT.search(text, a, b) and re.search(r"[A-Za-z]", text[a:b])]
    low = text if "[" in text or "(" in text else ""
    if "at]" in low or "at)" in low:
        found += [(a, b, "email") for a, b in _obfuscated(text)]
    if not found:
        return found
    found.sort(key=lambda s: (s[0], -s[1], _ORDER[s[2]]))
    out, taken, free = [], sorted(base), 0
    i = 0
    for s, e, kind in found:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= free and not any(s < b[1] for b in takewhile(lambda b: b[0] < e, islice(taken, i, None))):  # noqa: B023
            out.append((s, e, kind))
            free = e
    return out


def votes_of(text: str, span: tuple[int, int, str]) -> tuple[int, ...]:
    s, e, kind = span
    before, words = _context(text, s)
    return tuple(f(kind, text[s:e], before, words) for f in LABELERS)


def features_of(text: str, span: tuple[int, int, str]) -> list[int]:
    """Hashed binary features of a span and its surroundings."""
    s, e, kind = span
    t = text[s:e]
    before, words = _context(text, s)
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", t))))[:12]
    raw = [f"kind {kind}", f"{kind} length {min(len(t) // 4, 12)}", f"{kind} digits {sum(c.isdigit() for c in t) * 5 // len(t)}", f"{kind} upper {sum(c.isupper() for c in t) * 5 // len(t)}", f"{kind} shape {shape[:4]}", f"{kind} head {t[:4] if t.startswith(_KEY_HEADS) else ''}", f"before {before[-1:]}", f"{kind} entropy {int(2 * _entropy(t))}", f"hex {re.fullmatch('[0-9a-f]+', t) is not None}"]
    raw += [f"word {w}" for w in words[-2:] if w in _KEY_WORDS or w in _PERSON_WORDS]
    return sorted({int.from_bytes(hashlib.blake2b(r.encode("utf-8", "replace"), digest_size=4).digest(), "little") % FEATURES for r in raw})


def estimate(counts: dict[tuple[int, ...], int], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Posterior of `personal` for each vote pattern: two classes, labelers independent given the class."""
    if not counts:
        return {}
    patterns = sorted(counts)
    v = np.array(patterns)
    n = np.array([counts[p] for p in patterns], float)
    post = 1 / (1 + np.exp(-1.5 * v.sum(1)))  # labelers are taken to be better than chance at first
    one_hot = np.stack([v == x for x in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        was = post
        like = []
        for w in (1 - post, post):
            total = (w * n).sum()
            p = ((w * n)[:, None, None] * one_hot).sum(0) + 0.5
            like.append(np.log(total + 1) + (one_hot * np.log(p / p.sum(1, keepdims=True))).sum((1, 2)))
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(post - was).max() < 1e-9:
            break
    return dict(zip(patterns, post.tolist(), strict=True))


def fit(features: list[list[int]], targets: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a logistic model, by full-batch gradient steps with an L2 penalty."""
    w = np.zeros(FEATURES + 1)
    if not len(targets):
        return w
    x = np.zeros((len(features), FEATURES + 1), np.float32)
    for row, f in enumerate(features):
        x[row, f] = 1
    x[:, -1] = 1
    speed = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        speed = 0.9 * speed - 0.5 * (x.T @ (p - targets) / len(targets) + 1e-4 * w)
        w = w + speed
    return w


def learn(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The span classifier's weights, from all documents' candidates (votes) and a bounded sample of them (weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            votes, features, order = [], [], []
            for t in texts_of(b.column("text")):
                for span in candidates(t, base_spans(t)):
                    votes.append(",".join(map(str, votes_of(t, span))))
                    features.append(features_of(t, span))
                    key = t[max(0, span[0] - 40) : span[1]] + span[2]
                    order.append(hashlib.blake2b(key.encode("utf-8", "replace"), digest_size=8).hexdigest())
            if votes:
                yield pa.RecordBatch.from_arrays([pa.array(votes), pa.array(features, pa.list_(pa.int32())), pa.array(order)], names=["votes", "features", "o"])

    found = written(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "votes string, features array<int>, o string"), "candidates")
    counts = {tuple(map(int, r["votes"].split(","))): r["n"] for r in found.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3**labelers rows
    posterior = estimate(counts)
    sample = found.dropDuplicates(["o"]).orderBy("o").limit(SAMPLE).collect()
    targets = np.array([posterior[tuple(map(int, r["votes"].split(",")))] for r in sample])
    return fit([r["features"] for r in sample], targets)


def added_spans(text: str, base: list[tuple[int, int, str]], weights: np.ndarray) -> list[tuple[int, int, str]]:
    return [s for s in candidates(text, base) if weights[features_of(text, s)].sum() + weights[-1] > 0]


def written_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], _ORDER[x[2]], x[1])))


def find(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every row; base and spans as kind:start:end lists.

    Null text is empty text, and has none.  Rows are judged one by one, whatever repeats;
    an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            counts: list[list[int]] = [[], [], [], []]
            base, spans = [], []
            for t in texts_of(b.column("text")):
                own = base_spans(t)
                for column, kind in zip(counts, KINDS, strict=False):
                    column.append(sum(x[2] == kind for x in own))
                base.append(written_spans(own))
                spans.append(written_spans(own + added_spans(t, own, weights)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base), pa.array(spans)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`find` with the classifier learnt from the same documents; without candidates it adds nothing.

    Nulls, empty and long texts, repeats, an empty table and other columns as in `find`.
    """
    return find(docs, learn(docs, text), key, text)


def redact_text(text: str, weights: np.ndarray) -> str:
    own = base_spans(text)
    out, at = [], 0
    for s, e, kind in sorted(own + added_spans(text, own, weights), key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; other columns as they were, null text stays null.

    Of spans that overlap, one mark stands for all.  Whole texts are read, rows are judged
    one by one whatever repeats, an empty table gives no rows.
    """
    weights = learn(docs, text) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            at = b.schema.get_field_index(text)
            new = pa.array([t if t is None else redact_text(t, weights) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)
