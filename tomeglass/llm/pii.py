"""Personal data: patterns propose spans, checksums confirm them, words nearby raise or lower their score."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
BASE_KINDS = KINDS[:4]


class Scores(NamedTuple):
    """A proposal's score starts with its kind's, gains or loses by the words within ``reach`` characters before and after it. A
    secret gains if an equals sign, a colon or 'bearer' stands before it, and its characters have to carry ``entropy`` bits each.

    Those that pass ``least`` are reported. Proposals of the base kinds that pass their check are always reported.
    """

    iban: float = 0.9
    ssn: float = 0.4
    local_phone: float = 0.3
    secret: float = 0.2
    assigned: float = 0.3
    word: float = 0.4
    against: float = -0.4
    reach: int = 40
    least: float = 0.7
    entropy: float = 3.0


# Words that make a kind likelier nearby, words that make a kind less likely, and kinds whose checksum outweighs the latter.
NEARBY = {
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer", "sozialversicherung"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "passphrase", "key", "apikey", "bearer", "authorization", "credential", "credentials"),
    "local_phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
AGAINST = ("order", "invoice", "isbn", "version", "serial", "tracking", "example")
CHECKED = frozenset(["iban", "secret"])

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits cannot begin a match halfway, so that possessive and guarded forms find the same spans in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_ASSIGNED = re.compile(r"(?:[=:]|\bbearer)\s*[\"'`]?$", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without blanks has a right check number."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def entropy(found: str) -> float:
    """Bits per character, by how often each occurs."""
    return -sum(n / len(found) * math.log2(n / len(found)) for n in Counter(found).values())


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: the run of local characters before it, the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the four base kinds, in order."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            number = _digits(m[0])
            if 12 <= len(number) <= 19 and luhn(number):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans)


def _iban_end(found: str) -> int:
    """Length of the longest beginning of ``found`` that is a valid IBAN, else 0; blanks may run into the next words."""
    for end in range(len(found), 14, -1):
        if found[end - 1] != " " and (end == len(found) or not found[end].isalnum()):
            packed = found[:end].replace(" ", "")
            if 15 <= len(packed) <= 34 and mod97(packed):
                return end
    return 0


def more_spans(text: str, taken: list[tuple[int, int, int]], scores: Scores) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score) beyond the base kinds, of which none but a secret overlaps a span already taken.

    A secret is a run of 16 or more letters, digits and ``+/_-``, with letters and digits both, that looks random.
    """
    proposed = []
    for m in _IBAN.finditer(text):
        if length := _iban_end(m[0]):
            proposed.append((m.start(), 4, m.start() + length, scores.iban))
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            proposed.append((m.start(), 5, m.end(), scores.ssn))
    proposed += [(m.start(), 6, m.end(), scores.local_phone) for m in _LOCAL_PHONE.finditer(text)]
    for m in _SECRET.finditer(text):
        run = m[0].rstrip("=")
        if any(map(str.isdigit, run)) and any(map(str.isalpha, run)) and entropy(run) >= scores.entropy:
            assigned = _ASSIGNED.search(text[max(0, m.start() - 12) : m.start()])
            proposed.append((m.start(), 7, m.end(), scores.secret + scores.assigned * bool(assigned)))
    out = []
    for start, kind, end, score in proposed:
        near = {w.lower() for w in _WORD.findall(text[max(0, start - scores.reach) : start] + " " + text[end : end + scores.reach])}
        score += scores.word * bool(near & set(NEARBY[KINDS[kind]]))
        if KINDS[kind] not in CHECKED:
            score += scores.against * bool(near & set(AGAINST))
        if score >= scores.least and (KINDS[kind] == "secret" or not any(s < end and start < e for s, _, e in taken)):
            out.append((start, kind, end, score))
    return out


def _listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_pii(docs: DataFrame, scores: Scores = Scores()) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): base_spans and spans (kind, start, end, score), by start.

    Offsets count code points, ends are exclusive. A missing text is an empty one. Rows that repeat or lack a doc_id are
    searched like any other; other columns are ignored. Nothing is shuffled.
    """
    span = pa.struct({"kind": pa.string(), "start": pa.int64(), "end": pa.int64(), "score": pa.float64()})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                first = base_spans(text)
                known = [(s, k, e, 1.0) for s, k, e in first]
                rows = sorted(known + more_spans(text, first, scores))
                base.append([{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in known])
                every.append([{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in rows])
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), pa.array(base, pa.list_(span)), pa.array(every, pa.list_(span))],
                ["doc_id", "base_spans", "spans"],
            )

    kind = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(search, f"doc_id bigint, base_spans {kind}, spans {kind}")


def masked(text: str, scores: Scores = Scores()) -> str:
    """``text`` with every span replaced by its kind in angle brackets; of overlapping spans the whole stretch goes."""
    first = base_spans(text)
    spans = sorted([(s, k, e) for s, k, e in first] + [x[:3] for x in more_spans(text, first, scores)])
    out, end = [], 0
    for start, kind, stop in spans:
        if start >= end:
            out += [text[end:start], f"<{KINDS[kind].upper()}>"]
        end = max(end, stop)
    return "".join([*out, text[end:]]) if spans else text


def mask_pii(docs: DataFrame, scores: Scores = Scores()) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; every other column stays as it is, and a missing text stays missing."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if t is None else masked(t, scores) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(mask, docs.schema)
