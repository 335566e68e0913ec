"""Personal data by anchor expansion.

One Aho-Corasick automaton reads a text once and reports anchors: at-signs, the
"://" of a scheme, plus signs, digits, and words that announce an account. From an anchor a small
parser expands to the left and right as far as the form allows, and validates
what it has. A kind's parser resumes after its last match, so each character is
looked at a bounded number of times.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import spread, tidy
from .common import table, with_free_names

#: Kinds in the order of a report; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = 4
#: Words that announce the number of an account or a document, in any letter case.
CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "compte", "cuenta")

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_RUN = re.compile(r"[0-9]+")
_GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DIAL = re.compile(r"[0-9][ ().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"[^\x00-\x20\"/<>?#@\\]+@[A-Za-z0-9.-]+")
_ACCOUNT = re.compile(r"(?: (?:[Nn]umber|[Nn]o|[Ii][Dd]))?[ .:=#]{1,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[0-9]{1,3})?|[0-9](?:[ -]?[0-9]){5,17})")
_LOWER = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    """Whether a number passes the check sum: from the right, every second digit doubled, nines cast out."""
    return sum(int(d) if k % 2 == 0 else (2 * int(d) - 1) % 9 + 1 if d != "0" else 0 for k, d in enumerate(reversed(digits))) % 10 == 0


def octet(part: str) -> bool:
    """At most 255; a part may have any number of leading zeros."""
    short = part.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def iban(value: str) -> bool:
    """The check of an international account number: country and check digits at its end, letters as 10 to 35, remainder 1 by 97."""
    own = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


@cache
def anchors():
    """The automaton; each anchor's value is its kind and its length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("://", "scheme"), ("+", "plus"), *[(d, "digit") for d in _DIGITS], *[(c, "cue") for c in CUES]]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) by kind and start."""
    found: list[tuple[int, int, int]] = []
    # Where each parser may begin: matches of a kind don't overlap, and what one has looked through in vain isn't looked through again.
    email = quad = run = card = address = account = 0
    for last, (kind, length) in anchors().iter(text.translate(_LOWER)):
        at = last - length + 1
        if kind == "digit":
            if at >= run:  # the beginning of a run of digits
                run = _RUN.match(text, at).end()
                if at >= quad and (m := _QUAD.match(text, at)):
                    quad = m.end()
                    if all(map(octet, m.groups())):
                        found.append((1, at, quad))
            if at >= card and (m := _GROUPS.match(text, at)):
                card = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, at, card))
        elif kind == "at":
            begin = at
            while begin > email and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                found.append((0, begin, email))
        elif kind == "plus":
            if (m := _DIAL.match(text, at + 1)) and 9 <= sum(c in _DIGITS for c in m.group()) <= 15:
                found.append((3, at, m.end()))
        elif kind == "scheme":
            begin = at
            while begin > address and text[begin - 1] in _SCHEME:
                begin -= 1
            while begin < at and text[begin] not in _LETTERS:
                begin += 1
            if begin < at and (m := _AUTHORITY.match(text, at + 3)):
                address = m.end()
                found.append((4, begin, address))
        elif at >= account and (at == 0 or text[at - 1] not in _WORD) and (m := _ACCOUNT.match(text, last + 1)):
            account = m.end()
            if m.group(1)[0] in _DIGITS or iban(m.group(1)):
                found.append((5, m.start(1), account))
    return sorted(found)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default) with those of FOUND.

    Base kinds are email, ip, card and phone; base_sha256 is of their spans alone. The method adds
    web addresses that carry a user (address), and numbers after an announcing
    word (account: 6 to 18 digits, or a valid international number). Places are
    code points, ends exclusive. Null, empty and clean texts have no spans, and so the digest of the
    empty string; rows stay as they are, repeated ones too; texts of any length are read
    whole, in one pass; an empty table gives an empty one. Where docs has a column of
    FOUND's names (in any letter case), the new one gets an underscore before its name.
    """
    kept = docs.columns if keep is None else keep
    names = list(with_free_names(docs.select(*kept), *[x.split()[0] for x in FOUND.split(", ")], "__text").values())
    slim = docs.select(*kept, F.col(text_col).alias(names[-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                rows = []
                for text in part.column(len(kept)).to_pylist():
                    found = spans(text) if text else []
                    base = [x for x in found if x[0] < BASE]
                    rows.append((*[sum(x[0] == k for x in base) for k in range(BASE)], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
                made = [pa.array(c, pa.int64() if k < BASE else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*kept, *names[:-1]])

    from pyspark.sql import types as T

    kinds = T._parse_datatype_string(FOUND).fields
    return spread(slim).mapInArrow(tidy(run), T.StructType([*slim.schema.fields[:-1], *[T.StructField(n, f.dataType) for n, f in zip(names, kinds, strict=False)]]))


def redact(text: str | None, kinds: tuple[str, ...] = KINDS) -> str | None:
    """text with each span of these kinds replaced by its kind in brackets; of overlapping spans the first, and of those that begin together the longest, goes."""
    out, at = [], 0
    for begin, end, kind in sorted(((a, b, KINDS[k]) for k, a, b in spans(text or "") if KINDS[k] in kinds), key=lambda x: (x[0], -x[1])):
        if begin >= at:
            out += [text[at:begin], f"[{kind}]"]
        at = max(at, end)
    return None if text is None else "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """docs with its texts redacted; null stays null, all other columns and rows stay as they are."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([redact(t, kinds) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == place else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return spread(docs).mapInArrow(tidy(run), docs.schema)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])


def _sql() -> str:
    cues = "|".join("".join(f"[{c.upper()}{c}]" for c in cue) for cue in CUES)
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "address": r'[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"/<>?#@\\]+@[A-Za-z0-9.-]+',
        "account": rf"\b(?:{cues}){_ACCOUNT.pattern}",
    }
    only = r"regexp_replace(v, '[^0-9]', '', 'g')"
    moved = "list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END)"
    keep = {
        "ip": "len(list_filter(string_split(v, '.'), lambda x: len(ltrim(x, '0')) > 3 OR CAST(coalesce(nullif(substr(ltrim(x, '0'), 1, 3), ''), '0') AS INT) > 255)) = 0",
        "card": f"len({only}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len({only}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse({only}), k, 1) AS INT) WHEN substr(reverse({only}), k, 1) = '0' THEN 0 ELSE (2 * CAST(substr(reverse({only}), k, 1) AS INT) - 1) % 9 + 1 END)) % 10 = 0",
        "phone": f"len({only}) BETWEEN 9 AND 15",
        "account": f"v[1] BETWEEN '0' AND '9' OR list_reduce(list_transform(string_split(array_to_string({moved}, ''), ''), lambda x: CAST(x AS INT)), lambda a, x: (a * 10 + x) % 97) = 1",
    }
    # The k-th match begins after k pieces between matches and k - 1 matches.
    places, kinds = [], []
    for k, (kind, p) in enumerate(patterns.items()):
        q = p.replace("'", "''")
        split = re.sub(r"\((?!\?)", "(?:", q)
        places.append(f"m{k} AS (SELECT r, t, regexp_extract_all(t, '{split}') AS m, regexp_extract_all(t, '{q}', {int(kind == 'account')}) AS v, regexp_split_to_array(t, '{split}') AS g FROM d WHERE regexp_matches(t, '{split}'))")
        places.append(f"p{k} AS (SELECT r, v[j] AS v, list_sum(list_transform(g[:j], lambda x: len(x))) + list_sum(list_transform(m[:j], lambda x: len(x))) AS b FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM m{k}))")
        kinds.append(f"SELECT r, {k} AS k, '{kind}' AS kind, b - len(v) AS a, b FROM p{k} WHERE {keep.get(kind, 'true')}")
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{KINDS[k]}" for k in range(BASE))
    return (
        "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), "
        + ", ".join(places)
        + f", s AS ({' UNION ALL '.join(kinds)}), o AS (SELECT r, {counts}, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY k, a) FILTER (WHERE k < {BASE}) AS base, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY k, a) AS spans FROM s GROUP BY r)"
        + f" SELECT doc_id, {', '.join(f'coalesce(n_{KINDS[k]}, 0) AS n_{KINDS[k]}' for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (r)"
    )


#: The same patterns over whole texts, without anchors.
ORACLE_SQL = _sql()
