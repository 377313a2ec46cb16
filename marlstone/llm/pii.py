"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay.  Looser patterns propose
further candidates; labelers (shape, gazetteer, context, variety, placeholder) vote on each.  The votes of
all documents are counted by pattern of votes; expectation-maximisation over these counts estimates
how reliable each labeler is and how likely each pattern is personal data, and a logistic
model of the candidate's votes and traits, trained on those likelihoods, makes the final decision.
The number of patterns is bounded by the number of vote combinations, whatever the input.

Defined results: null text counts as empty; offsets are code points, ends exclusive; an
added span never overlaps a base span or an added one that starts earlier; extra columns are kept by
`redact` and ignored elsewhere; repeated rows give the same spans each; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, Workspace, afresh, batches

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
EMAIL_LOCAL, EMAIL_DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP_PARTS = r"(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Kinds that only the method adds, after the base kinds where spans start together.
ADDED = ("secret", "local_phone", "national_id", "number", "spelled_email")
ORDER = {k: i for i, k in enumerate((*KINDS, *ADDED))}
LOOSE = {
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{20,}={0,2}"),
    "local_phone": re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "number": re.compile(r"(?<![0-9A-Za-z.])[0-9]{9,19}(?![0-9A-Za-z.])"),
    "spelled_email": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z]+)+", re.IGNORECASE),
}
# Words before a span that speak for it, and signs of placeholders.
NEARBY = {
    "secret": ("token", "key", "secret", "passw", "auth", "bearer", "credential", "api"),
    "local_phone": ("phone", "tel", "call", "fax", "mobile", "cell"),
    "national_id": ("ssn", "social", "tax", "passport", "national", "insurance"),
    "number": ("card", "account", "iban", "visa", "passport", "customer", "ssn", "phone"),
    "spelled_email": ("mail", "contact", "write", "reach"),
}
PLACEHOLDER = re.compile(r"example|sample|placeholder|dummy|test|xxxx|your[-_ ]|lorem", re.IGNORECASE)
LABELERS = ("shape", "gazetteer", "context", "variety", "placeholder")
_ANY = re.compile(r"[0-9@]|[\[(] ?[aA][tT] ?[\])]")


# A match can only start where a run of digits does, as all starts in a run succeed or fail together; hence linear time.
IP = re.compile(r"(?<![0-9])[0-9]++" + IP_PARTS)
_DOMAIN = re.compile(EMAIL_DOMAIN)
_LOCAL_BACKWARDS = re.compile(f"{EMAIL_LOCAL}+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of LOCAL+@DOMAIN, in linear time.

    All starts in the run of local characters before an @ succeed or fail together, so
    the leftmost match starts where that run does, or where the match before it ended.
    """
    upto, at = 0, text.find("@")
    while at >= 0:
        after = at + 1
        if m := _DOMAIN.match(text, after):
            window = 64
            while True:
                low = max(upto, at - window)
                run = _LOCAL_BACKWARDS.match(text[low:at][::-1])
                size = run.end() if run else 0
                if size < at - low or low == upto:
                    break
                window *= 8
            if size:
                yield at - size, m.end()
                upto = after = m.end()
        at = text.find("@", after)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind: leftmost and non-overlapping within a kind; failing matches are dropped."""
    out: list[tuple[int, int, str]] = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    if _ANY.search(text) is None:
        return out
    out += [(*m.span(), "ip") for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def _shape(kind: str, s: str) -> int:
    """A vote: 1 for, -1 against, 0 none."""
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", s):
            return 1
        return 1 if re.search("[A-Z]", s) and re.search("[a-z]", s) and len(re.findall("[0-9]", s)) > 2 else -1 if "/" in s or s.count("-") > 2 else 0
    if kind == "number":
        # Twelve digits or fewer have no check digit to speak for or against them; ten or thirteen from 1 on are mostly times.
        return (1 if luhn(s) else -1) if len(s) > 12 else -1 if len(s) == 10 and s[0] == "1" else 0
    if kind == "national_id":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" else 1
    return 1


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote of each labeler."""
    s, before, after = text[start:end], text[max(0, start - 28) : start].lower(), text[end : end + 12]
    gazetteer = 1 if any(w in before for w in NEARBY[kind]) else 0
    context = 1 if re.search(r"[=:#]\s*[\"']?$", before) else -1 if before[-1:] in ("/", "$", "€", "%", "_") or after[:1] in ("%", "/", "_") else 0
    variety = 1 if len(set(s)) > 8 and not s.isdigit() else -1 if len(set(s)) < 4 else 0
    placeholder = -1 if PLACEHOLDER.search(before[-12:] + s + after) else 0
    return _shape(kind, s), gazetteer, context, variety, placeholder


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pattern): loose matches that no base span overlaps, leftmost first, with their votes."""
    if _ANY.search(text) is None:
        return []
    found = sorted((m.start(), m.end(), k) for k, p in LOOSE.items() for m in p.finditer(text))
    taken = sorted((a, b) for a, b, _ in base)
    out, at, upto = [], 0, 0
    for a, b, kind in found:
        while at < len(taken) and taken[at][1] <= a:
            upto = max(upto, taken[at][1])
            at += 1
        if a < upto or any(x < b for x, y in taken[at : at + 8] if y > a):
            continue
        v = votes(kind, text, a, b)
        size = 0 if b - a < 12 else 1 if b - a < 24 else 2
        out.append((a, b, kind, f"{kind},{size},{','.join(map(str, v))}"))
        upto = max(upto, b)
    return out


def _base_pattern(kind: str) -> str:
    """What a base span adds to the counts: it passed a strict shape.  Its kind stands for itself, so that it speaks for labelers only."""
    return f"base,1,1,0,0,{int(kind == 'email')},0"


class Model:
    """Reliabilities by expectation-maximisation, then a logistic model of votes and traits."""

    def __init__(self, counts: dict[str, int], rounds: int = 60):
        self.accuracy = dict.fromkeys(LABELERS, 0.75)
        self.accept: dict[str, float] = {}
        patterns = sorted(counts)
        if not patterns:
            return
        kinds = [p.split(",")[0] for p in patterns]
        v = np.array([[int(x) for x in p.split(",")[2:]] for p in patterns], float)
        n = np.array([counts[p] for p in patterns], float)
        accuracy = np.full(len(LABELERS), 0.75)
        prior = np.full(len(patterns), 0.5)
        names = sorted(set(kinds))
        of = np.array([names.index(k) for k in kinds])
        q = prior
        for _ in range(rounds):
            # E: a vote of +1 has probability `accuracy` if the span is personal data, 1 - accuracy if not.
            log_odds = np.log(prior / (1 - prior)) + v @ np.log(accuracy / (1 - accuracy))
            q = 1 / (1 + np.exp(-log_odds))
            # M, with two pseudo-votes on either side.
            agree = ((v > 0) * (n * q)[:, None] + (v < 0) * (n * (1 - q))[:, None]).sum(axis=0)
            cast = ((v != 0) * n[:, None]).sum(axis=0)
            accuracy = np.clip((agree + 3) / (cast + 4), 0.55, 0.98)
            share = (np.bincount(of, n * q, len(names)) + 1) / (np.bincount(of, n, len(names)) + 2)
            prior = np.clip(share, 0.05, 0.95)[of]
        self.accuracy = dict(zip(LABELERS, accuracy.tolist(), strict=True))
        x = np.column_stack([self._traits(p) for p in patterns]).T
        weight = np.zeros(x.shape[1])
        scale = n / n.sum()
        for _ in range(400):
            p = 1 / (1 + np.exp(-(x @ weight)))
            weight -= 4.0 * (x.T @ (scale * (p - q)) + 1e-4 * weight)
        # Every pattern that can occur gets its decision, also those of later data.
        for kind, size, *vote in product(ADDED, "012", *[("-1", "0", "1")] * len(LABELERS)):
            p = ",".join((kind, size, *vote))
            self.accept[p] = float(1 / (1 + np.exp(-(self._traits(p) @ weight))))

    @staticmethod
    def _traits(pattern: str) -> np.ndarray:
        kind, size, *vote = pattern.split(",")
        return np.array([1.0, *(kind == k for k in ADDED), *(size == s for s in "12"), *(v == "1" for v in vote), *(v == "-1" for v in vote)])

    def holds(self, pattern: str) -> bool:
        return self.accept.get(pattern, 0.0) >= 0.5


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_FOUND = f"{OWN}id long, n_email long, n_ip long, n_card long, n_phone long, base string, loose string"


def _find(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in batches(afresh(rows), [OWN + "id", "text"]):
        out = []
        for t in texts:
            base = base_spans(t or "")
            loose = candidates(t or "", base)
            n = Counter(k for _, _, k in base)
            out.append((*(n[k] for k in KINDS), _written(base), ";".join(f"{a}:{b}:{p}" for a, b, _, p in loose)))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=[OWN + "id", "n_email", "n_ip", "n_card", "n_phone", "base", "loose"])


def _tally(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for base, loose in batches(rows, ["base", "loose"]):
        for b, c in zip(base, loose, strict=True):
            if b:
                seen.update(_base_pattern(s.split(":")[0]) for s in b.split(","))
            if c:
                seen.update(s.split(":")[2] for s in c.split(";"))
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])


def _searched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias(OWN + "id"), F.col(text_col).alias("text")).mapInArrow(_find, _FOUND)


def fit(found: DataFrame) -> Model:
    """found: what the search of all documents gave.  At most 5 x 3 x 3^5 patterns and their counts reach the driver."""
    counts = found.select("base", "loose").mapInArrow(_tally, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return Model({r["pattern"]: r["n"] for r in counts.collect()})


def _with_added(base: str, loose: str, model: Model) -> str:
    spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in base.split(","))] if base else []
    for s in loose.split(";") if loose else []:
        a, b, pattern = s.split(":")
        if model.holds(pattern):
            spans.append((int(a), int(b), pattern.split(",")[0]))
    return _written(sorted(spans, key=lambda s: (s[0], ORDER[s[2]])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """doc_id, counts of base spans, base, spans: written as kind:start:end, joined by commas."""
    work = work or Workspace(docs.sparkSession, "pii")
    found = work.save(_searched(docs, id_col, text_col), "found")
    model = docs.sparkSession.sparkContext.broadcast(fit(found))

    def decide(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            base, loose = b.column(5).to_pylist(), b.column(6).to_pylist()
            spans = [_with_added(x, y, model.value) for x, y in zip(base, loose, strict=True)]
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(spans, pa.string()), pa.array(digests, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "base_sha256"])

    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, base_sha256 string")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, or run of overlapping spans, becomes [KIND] of its first."""
    out, at = [], 0
    for a, b, kind in spans:
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """`docs` with all spans of its texts masked; a null text stays null.  length_col, if there, holds the new lengths."""
    work = Workspace(docs.sparkSession, "redact")
    found = work.save(_searched(docs, id_col, text_col).select("base", "loose"), "found")
    model = docs.sparkSession.sparkContext.broadcast(fit(found))
    at = docs.columns.index(text_col)

    def mask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in afresh(rows):
            out = []
            for t in b.column(at).to_pylist():
                if t:
                    base = base_spans(t)
                    extra = [(x, y, k) for x, y, k, p in candidates(t, base) if model.value.holds(p)]
                    if base or extra:
                        t = masked(t, sorted([*base, *extra], key=lambda s: (s[0], ORDER[s[2]])))
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    out = docs.mapInArrow(mask, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out
