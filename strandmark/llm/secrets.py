"""Operator 3, secret scan.

An Aho-Corasick automaton over the lower-cased bytes finds rule keywords in one pass;
a rule's regular expression is then tried only as an anchored match where its keyword
begins. Rules with an embedded checksum or structure are validated before they count.
Bare hex runs have no keyword: they are found as runs of hex bytes. A private key reaches
from its BEGIN line to its END line, whatever lies between (headers, escaped newlines).

Checks: GitHub and npm tokens by their embedded CRC-32, JSON web tokens by the JSON of both parts.
Slack tokens and private keys hold no checksum: the first are known by their parts, the second by
their two lines, as an encrypted or damaged body is a secret too.

Defined cases: a null text is empty and has no spans; a null doc_id is kept as null;
repeated rows give one row each; spans that start together sort by the order of KINDS; an empty
table gives no rows; texts of any length are scanned whole; other columns are not read by
secret_spans, and pass through redact_secrets.
Offsets are code points, end exclusive. ASCII letters only are matched in either case.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_slice, id_text, small_batches, spark_schema

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "slack")
BASE = frozenset(KINDS[:3])
_FLAGS = re.ASCII | re.IGNORECASE
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
JWT_RUN = re.compile(rb"[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----")
SLACK = re.compile(rb"xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]{10,}")
DIGITS62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62(body: bytes) -> bytes:
    """CRC-32 of a token's body in six base-62 digits, as it is embedded in such tokens."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS62[d : d + 1] + out
    return out


def _checksum(m: re.Match) -> bool:
    return crc62(m[1][:30]) == m[1][30:]


def _json(m: re.Match) -> bool:
    try:
        return all(isinstance(json.loads(base64.urlsafe_b64decode(p + b"=" * (-len(p) % 4))), dict) for p in m.groups())
    except ValueError:
        return False


#: kind: keywords (lower case), expression, whether a match counts
RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN, lambda m: len(m[2]) >= 8),
    "access": (("akia",), ACCESS, lambda m: len(m[0]) >= 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), GITHUB, _checksum),
    "npm": (("npm_",), NPM, _checksum),
    "jwt": (("eyj",), JWT, _json),
    "pem": (("-----begin",), PEM, lambda m: True),
    "slack": (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), SLACK, lambda m: True),
}
_AUTOMATON = None


def automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = ahocorasick.Automaton()
        for kind, (words, _, _) in RULES.items():
            for w in words:
                _AUTOMATON.add_word(w, (kind, len(w)))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def _pem_end(text: bytes, begin: re.Match, ends: dict) -> int:
    """End of a key: its END line, with anything but another BEGIN line of its label before it; 0 if there is none.

    ends: where the last search for each line ended, so that many BEGIN lines without END search the text once.
    """

    def after(line):
        if line not in ends or ends[line] < begin.end():
            at = text.find(line, begin.end())
            ends[line] = at if at >= 0 else len(text)
        return ends[line]

    last = b"-----END " + begin[1] + b"-----"
    at = after(last)
    return at + len(last) if begin.end() < at < min(after(begin[0]), len(text)) else 0


def scan(text: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, sorted by start and then by the order of KINDS."""
    found, free = [], dict.fromkeys(RULES, 0)
    ends: dict = {}
    for last, (kind, n) in automaton().iter(text.lower().decode("latin-1")):
        at = last - n + 1
        if at < free[kind]:
            continue
        _, pattern, counts = RULES[kind]
        if kind == "pem":
            if (m := pattern.match(text, at)) and (end := _pem_end(text, m, ends)):
                free[kind] = end
                found.append((at, KINDS.index(kind), end))
        elif m := pattern.match(text, at):
            good = counts(m)
            free[kind] = m.start(2) if kind == "jwt" and not good else m.end()  # a token may begin with the second part
            if good:
                found.append((at, KINDS.index(kind), m.end()))
        elif kind == "jwt" and text.startswith(b"eyJ", at):  # a later start in this run of token characters meets the same end
            free[kind] = JWT_RUN.match(text, at).end()
    found += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def scan_points(text: bytes) -> list[tuple[int, str, int]]:
    """scan() with code-point offsets."""
    found = scan(text)
    if found and not text.isascii():
        before = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
        found = [(int(before[s]), k, int(before[e])) for s, k, e in found]
    return found


def redact(text: bytes) -> bytes:
    """The text with every span, overlapping ones united, replaced by a mark of its first kind."""
    out, at = [], 0
    for s, k, e in scan(text):
        if s >= at:
            out += [text[at:s], b"[" + k.encode() + b" removed]"]
        at = max(at, e)
    return b"".join([*out, text[at:]])


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])
REDACTED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_spans", pa.int64())])


def _rows(ids: list, texts: list) -> dict:
    out: dict = {f.name: [] for f in SCHEMA}
    for i, t in zip(ids, texts, strict=True):
        found = scan_points(t or b"")
        said = [f"{k}:{s}:{e}" for s, k, e in found]
        kinds = [k for _, k, _ in found]
        base = ",".join(x for x, k in zip(said, kinds, strict=True) if k in BASE)
        for name, v in zip(out, (i, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(base.encode()).hexdigest(), ",".join(said), len(found)), strict=True):
            out[name].append(v)
    return out


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row: counts and spans."""
    small_batches(docs.sparkSession)
    return id_text(docs, id_col, text_col).mapInArrow(by_slice(SCHEMA, _rows), spark_schema(SCHEMA))


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, same columns and rows, with the secrets in text_col replaced by marks; a null text stays null."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index(text_col)
            clean = [None if t is None else redact(t) for t in b.column(k).cast(pa.binary()).to_pylist()]
            yield b.set_column(k, b.schema.field(k), pa.array(clean, pa.binary()).cast(b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
