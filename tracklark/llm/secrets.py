"""Secret scan with multipart credential linking.

A credential is rarely one string: an access identifier, a secret and an endpoint stand near each other. Strong
candidates (the base kinds) are reported wherever they stand. Weak candidates, too common to report alone, are
reported only if the parts that complete them stand in the same scope. A scope is a block of text without an empty
line; inside it each part reaches `reach` code points to both sides, and two parts co-occur if they are that near.
The interval join of parts is a sorted sweep in each text, so no pairs are listed and nothing is shuffled.

Rules for linking (s: any secret, strong or weak; i: any identifier; e: any endpoint):
a weak secret needs an i, a weak identifier needs an s, and an endpoint needs both an i and an s.

Nulls: a null text counts as empty and has no spans. Repeated rows give repeated results. An empty table gives an
empty table. Columns other than the id and the text are not read by `scan`; `redact` passes them through whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracklark.llm.batches import per_row
from tracklark.session import table

# The base kinds, in the order that breaks ties, with the shortest accepted length.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
# Words of which one must stand in a lower-cased text for ASSIGN to match.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

# The weak kinds of the method, in the order that breaks ties after the base kinds.
WEAK = ("weak_secret", "weak_id", "endpoint")
DIGITS = re.compile(r"[0-9]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
TOKEN_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
LEAST_TOKEN = 20
WEAK_ID = re.compile(
    r"""(?<![A-Za-z0-9])(?:access_?key(?:_?id)?|client_?id|account|user_?(?:name|id)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
WEAK_ID_WORDS = ("access", "client", "account", "user", "login")
# An endpoint is a scheme, "://" and a body; it is searched from "://", as schemes can be long.
BODY = re.compile(r"""://([^\x00-\x20"'<>]*)""")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SCHEME_SIGNS = LETTERS | frozenset("0123456789+.-")
BLOCK_END = re.compile(r"\n[\x20\t\r]*\n")
ORDER = {kind: k for k, kind in enumerate(KINDS + WEAK)}


class Span(NamedTuple):
    """Code points `start` to `end`, exclusive; `strong`: of a base kind."""

    kind: str
    start: int
    end: int

    @property
    def strong(self) -> bool:
        return self.kind in KINDS


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The strong spans, and the assignments whose value is too short to be strong."""
    strong, short = [], []
    low = text.lower() if ":" in text or "=" in text else ""
    if low and any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            (strong if m.end(2) - m.start(2) >= LEAST_ASSIGN else short).append(Span("assign", m.start(), m.end()))
    if "AKIA" in text:
        strong += (Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS)
    strong += (Span("hex", *m.span()) for m in HEX.finditer(text))
    return sorted(strong, key=lambda s: (s.start, ORDER[s.kind])), short


def mixed_tokens(text: str) -> list[Span]:
    """Runs of token signs, 20 or longer, that hold a capital letter, a small letter and a digit."""
    out, seen = [], 0
    for m in DIGITS.finditer(text):
        if (start := m.start()) < seen:
            continue
        while start > seen and text[start - 1] in TOKEN_SIGNS:
            start -= 1
        seen = TOKEN.match(text, m.start()).end()
        if seen - start >= LEAST_TOKEN:
            token = text[start:seen]
            if token != token.lower() and token != token.upper():
                out.append(Span("weak_secret", start, seen))
    return out


def endpoints(text: str) -> list[Span]:
    """Schemes with their bodies, leftmost and non-overlapping."""
    out, free, at = [], 0, text.find("://")
    while at >= 0:
        start = None
        k = at
        while k > free and text[k - 1] in SCHEME_SIGNS:
            k -= 1
            if text[k] in LETTERS:
                start = k
        end = at + 3 if start is None else BODY.match(text, at).end()
        if end > at + 3:
            out.append(Span("endpoint", start, end))
            free = end
        else:
            free = at + 3
        at = text.find("://", free)
    return out


def near(spans: list[Span], others: list[tuple[int, int]], starts: list[int], ends: list[tuple[int, int]], reach: int) -> list[bool]:
    """For each span, whether one of `others`, sorted by start, stands within `reach` of it and isn't itself.

    ends: for each of the others, the two rightmost ends up to it, as numbers of the others.
    """
    found = []
    for s in spans:
        k = bisect_right(starts, s.end + reach) - 1
        found.append(k >= 0 and any(j >= 0 and others[j][1] >= s.start - reach and others[j] != (s.start, s.end) for j in ends[k]))
    return found


def linked(parts: dict[str, list[Span]], reach: int) -> list[Span]:
    """The weak candidates of one scope whose complementary parts are near."""

    def side(spans: list[Span]) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int]]]:
        others = sorted({(s.start, s.end) for s in spans})
        ends, one, two = [], -1, -1
        for k, (_, end) in enumerate(others):
            if one < 0 or end > others[one][1]:
                one, two = k, one
            elif two < 0 or end > others[two][1]:
                two = k
            ends.append((one, two))
        return others, [a for a, _ in others], ends

    secrets, ids = side(parts["secret"]), side(parts["id"])
    by_secret = lambda x: near(x, *secrets, reach)
    by_id = lambda x: near(x, *ids, reach)
    weak_secret = [s for s in parts["secret"] if not s.strong]
    weak_id = [s for s in parts["id"] if not s.strong]
    out = [s for s, ok in zip(weak_secret, by_id(weak_secret), strict=True) if ok]
    out += [s for s, ok in zip(weak_id, by_secret(weak_id), strict=True) if ok]
    ends = parts["endpoint"]
    return out + [s for s, a, b in zip(ends, by_secret(ends), by_id(ends), strict=True) if a and b]


def find(text: str | None, reach: int = 200) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and all reported spans, each by start and kind."""
    if not text:
        return [], []
    base, short = base_spans(text)
    weak_secret = [Span("weak_secret", s.start, s.end) for s in short] + mixed_tokens(text)
    low = text.lower() if ":" in text or "=" in text else ""
    weak_id = [Span("weak_id", *m.span()) for m in WEAK_ID.finditer(text)] if low and any(w in low for w in WEAK_ID_WORDS) else []
    ends = endpoints(text)
    taken = {(s.start, s.end) for s in base}
    weak = [s for s in weak_secret + weak_id + ends if (s.start, s.end) not in taken]
    if not weak:
        return base, base
    cuts = [m.start() for m in BLOCK_END.finditer(text)]
    scopes: dict[int, dict[str, list[Span]]] = {}
    for s in base + weak:
        role = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id"}.get(s.kind, "endpoint")
        scopes.setdefault(bisect_left(cuts, s.start), {"secret": [], "id": [], "endpoint": []})[role].append(s)
    more = {s for parts in scopes.values() for s in linked(parts, reach)}
    return base, sorted([*base, *more], key=lambda s: (s.start, ORDER[s.kind], s.end))


def shown(spans: list[Span]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row for each row of `docs`: doc_id, and arrays `base` and `spans` of (kind, start, end)."""
    kind = StructType.fromDDL("base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>")
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    full = StructType([narrow.schema["doc_id"], *kind])

    def start():
        def row(doc_id, text):
            base, spans = find(text, reach)
            return doc_id, [s._asdict() for s in base], [s._asdict() for s in spans]

        return row

    return per_row(narrow, full, start)


def redacted(text: str | None, reach: int = 200, mark: str = "[REDACTED]") -> str | None:
    """The text with each reported span, overlapping ones merged, replaced by `mark`."""
    spans = find(text, reach)[1]
    if not spans:
        return text
    parts, at = [], 0
    for s in spans:
        if s.start >= at:
            parts += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", reach: int = 200) -> DataFrame:
    """`docs` with every reported secret in the texts replaced; other columns pass through."""
    place = docs.columns.index(text_col)

    def start():
        def row(*values):
            return *values[:place], redacted(values[place], reach), *values[place + 1 :]

        return row

    return per_row(docs, docs.schema, start)


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of `scan` over all documents."""
    narrow = table(spark, sf_dir, "documents").select("doc_id", "text")

    def start():
        def row(doc_id, text):
            base, spans = find(text)
            count = [sum(s.kind == k for s in base) for k in KINDS]
            return doc_id, *count, hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)

        return row

    kind = StructType([narrow.schema["doc_id"], *StructType.fromDDL("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")])
    return per_row(narrow, kind, start)


QUERIES = {"op3_secret_links": op3_secret_links}
