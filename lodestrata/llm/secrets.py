r"""Secret scan with multipart credential linking.

Base spans come from three rules over the whole text. The method adds weak candidates - an identifier, a secret-like
value or an endpoint, none of which says much alone - by an interval join within scopes: candidates of complementary
kinds link when the gap between their intervals is at most LINK_GAP code points and no blank line (a scope's end) lies
between them. A weak candidate is reported only when such a complementary part is there.

The join is a sweep over the intervals of one text in order of start; each candidate looks at its nearest neighbours of
each other kind, so a text with many candidates costs no pairs.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base rules and the smallest sizes of what they match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # of a maximal run nothing is lost by asking for 16 at once
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Weak parts, as long as their values go. Each alone is common in harmless text.
WEAK = {
    "part_id": re.compile(r"""\b(?:user(?:name)?|login|account(?:_?id|_?name)?|client_?id|access_?key_?id|tenant_?id|uid)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII | re.IGNORECASE),
    "part_secret": re.compile(r"""\b(?:pwd|pass(?:word|wd|phrase)?|secret|credentials?|auth|private_?key|(?:api_?|access_?|secret_?)?key|token)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{6,})""", re.ASCII | re.IGNORECASE),
    "part_endpoint": re.compile(r"""\b(?:(?:https?|ftp|sftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}|(?:host(?:name)?|endpoint|server|database_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,})""", re.ASCII | re.IGNORECASE),
}
WEAK_WORDS = ("user", "login", "account", "client", "access", "tenant", "uid", "pwd", "pass", "secret", "credential", "auth", "key", "token", "://", "host", "endpoint", "server", "database")

#: Code points between two parts that may still be one credential.
LINK_GAP = 200

KINDS = ("assign", "access", "hex", "part_id", "part_secret", "part_endpoint")
_RANK = {k: i for i, k in enumerate(KINDS)}
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, leftmost and non-overlapping per kind, without those that are too short."""
    low = text.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def _nearest(parts: list[tuple[int, int]], starts: list[int], furthest: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The first part after [start, end) and, of those that begin before its end, the one that reaches furthest.

    Parts are sorted and may overlap; furthest[i] is the one of parts[: i + 1] with the largest end.
    """
    i = bisect.bisect_left(starts, end)
    return parts[i : i + 1] + furthest[i - 1 : i] if i else parts[:1]


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates with a complementary part in reach. Base assign and hex spans count as secrets, access as identifiers."""
    low = text.lower()
    if not any(w in low for w in WEAK_WORDS):
        return []
    weak = {k: [m.span() for m in rule.finditer(text)] for k, rule in WEAK.items()}
    if sum(map(bool, weak.values())) + bool(base) < 2:
        return []
    breaks = [m.start() for m in _BLANK.finditer(text)]
    roles = {
        "part_id": weak["part_id"] + [(s, e) for s, e, k in base if k == "access"],
        "part_secret": weak["part_secret"] + [(s, e) for s, e, k in base if k in ("assign", "hex")],
        "part_endpoint": weak["part_endpoint"],
    }
    roles = {k: sorted(set(v)) for k, v in roles.items()}
    index = {k: (v, [s for s, _ in v], list(itertools.accumulate(v, lambda a, b: max(a, b, key=lambda x: x[1])))) for k, v in roles.items()}

    def joined(a: tuple[int, int], b: tuple[int, int]) -> bool:
        first, then = sorted((a, b))
        gap = then[0] - first[1]
        return gap <= 0 or gap <= LINK_GAP and bisect.bisect_left(breaks, first[1]) == bisect.bisect_left(breaks, then[0])

    taken = {(s, e) for s, e, _ in base}
    out = []
    for kind, spans in weak.items():
        # a secret needs an identifier or an endpoint; these need a secret
        wanted = ("part_id", "part_endpoint") if kind == "part_secret" else ("part_secret",)
        for span in spans:
            if span not in taken and any(joined(span, other) for k in wanted for other in _nearest(*index[k], *span) if other != span):
                out.append((*span, kind))
    return out


def _said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], _RANK[x[2]], x[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            base = base_spans(text)
            more = linked_spans(text, base)
            n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            out.append((doc_id.as_py(), *n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(base + more), len(more)))
        columns = zip(*out, strict=True) if out else [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans is kind:start:end of every span (code points, end exclusive), by start and then kind, comma-joined. A null
    text counts as empty and has no spans; repeated rows and null ids are rows of their own. An empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")
