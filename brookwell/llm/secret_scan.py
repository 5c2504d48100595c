"""Secret scans: patterns, then structural confirmation of encoded candidates.

Base kinds are patterns alone (``assign``, ``access``, ``hex``). The structural
kinds report a candidate only after it is decoded: ``signed_token`` needs a JSON
header with an algorithm (white space around its first brace is allowed) and a JSON
body; ``private_key`` needs PEM, base64 (also in the URL alphabet, in lines, around a
PEM text or around base64 once more) or hex that decodes to a key encoding whose
nested lengths all fit: PKCS#1, SEC1, traditional DSA, PKCS#8 with the key of its
algorithm inside, encrypted PKCS#8 with the parameters of its scheme, or OpenSSH.
Line ends may be written as escapes, as in JSON strings. A traditional PEM that is
encrypted has no nested lengths to check: its headers must say so, with a vector, and
its body must fill whole blocks of that size. The outer length of an encoding says
where its base64 or hex ends.

Defined cases: a null text is empty and has no spans; a null id is carried
through; repeated rows get equal results; spans of one kind don't overlap, spans
of different kinds may; a very long text is scanned whole, in time proportional to
its length and its candidates; an empty table gives an empty one; other columns
are not looked at, whatever their names.
"""

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "signed_token", "private_key")
BASE_KINDS = KINDS[:3]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORD = re.compile("password|passwd|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{46,}")
_SSH_HEX = re.compile(r"(?<![0-9A-Fa-f])6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100[0-9A-Fa-f]+")
#: Base64 of a brace with a quote or white space after it, or with white space before it.
_TOKEN = re.compile(r"(?:ey[A-J]|ew[0o]|ewk|IHs|Cns|CXs|DQp7)[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: DER (a sequence begins with M), an OpenSSH key, or a PEM text once more in base64.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/_-]{15,}|b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]+|LS0tLS1CRUdJTi[A-Za-z0-9+/_-]+|(?:TU|YjNCbGJuTnphQzFyWlhrdGRq)[A-Za-z0-9+/_-]{38,})")
_MORE_LINES = re.compile(r"(?:[A-Za-z0-9+/_-]|(?:\r?\n|(?:\\r)?\\n)[ \t]*(?=[A-Za-z0-9+/_=-]))*={0,2}")
_ESCAPED = re.compile(r"\\[nrt]")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:(?:\s|\\[nr])*[A-Z][A-Za-z-]+:[^\n\\]{0,200}){0,8})((?:[A-Za-z0-9+/=\s]|\\[nrt])+)-----END \1-----")
_ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED.*DEK-Info:\s*[A-Z0-9-]+,([0-9A-Fa-f]{32}|[0-9A-Fa-f]{16})(?![0-9A-Fa-f])", re.S)
#: Object identifiers of key algorithms and encryption schemes, as DER contents.
RSA, EC, DSA = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401")
EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _unbase64(text: str) -> bytes | None:
    """Either alphabet, white space between, also as escapes."""
    text = "".join((_ESCAPED.sub("", text) if "\\" in text else text).split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_length(data: bytes) -> int | None:
    """The whole length of the DER item at the start of ``data``, which may be cut off after its head."""
    if len(data) < 2:
        return None
    n = data[1]
    if n < 0x80:
        return 2 + n
    k = n & 0x7F
    return 2 + k + int.from_bytes(data[2 : 2 + k], "big") if 1 <= k <= 4 and len(data) >= 2 + k else None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER items that fill ``data`` exactly; None if a length doesn't fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def _is_openssh(data: bytes) -> bool:
    at = 15
    for _ in range(3):  # cipher, key derivation, its options
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at > len(data):
            return False
    if at + 4 > len(data) or int.from_bytes(data[at : at + 4], "big") < 1:
        return False
    at += 4
    for _ in range(2):  # public key, private part
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if not n or at > len(data):
            return False
    return at == len(data)


def _nests(data: bytes) -> bool:
    """DER items that fill ``data``, and so do those in its sequences and sets."""
    items = der_items(data)
    return bool(items) and all(not content or _nests(content) for tag, content in items if tag in (0x30, 0x31))


def _is_pkcs1(items: list[tuple[int, bytes]]) -> bool:
    return len(items) >= 9 and all(t == 0x02 and c for t, c in items[:9]) and items[0][1] in (b"\0", b"\1")


def _is_dsa(items: list[tuple[int, bytes]]) -> bool:
    """Version, p, q, g, y, x."""
    return len(items) == 6 and all(t == 0x02 and c for t, c in items) and items[0][1] == b"\0" and len(items[1][1]) >= 64 and 20 <= len(items[2][1]) <= 33


def _is_sec1(items: list[tuple[int, bytes]]) -> bool:
    return 2 <= len(items) <= 4 and items[0] == (0x02, b"\1") and items[1][0] == 0x04 and len(items[1][1]) >= 16 and all(t in (0xA0, 0xA1) and der_items(c) for t, c in items[2:])


def _is_pkcs8(items: list[tuple[int, bytes]]) -> bool:
    """Version, algorithm, and an octet string that holds the algorithm's key."""
    if len(items) < 3 or items[0] not in ((0x02, b"\0"), (0x02, b"\1")) or [t for t, _ in items[1:3]] != [0x30, 0x04]:
        return False
    algorithm, key = der_items(items[1][1]), items[2][1]
    if not algorithm or algorithm[0][0] != 0x06:
        return False
    name, inner = algorithm[0][1], der_items(key)
    if not inner or len(inner) != 1:
        return False
    tag, content = inner[0]
    if name == RSA:
        return tag == 0x30 and _is_pkcs1(der_items(content) or [])
    if name == EC:
        return tag == 0x30 and _is_sec1(der_items(content) or [])
    if name in EDWARDS:
        return tag == 0x04 and len(content) == EDWARDS[name]
    if name == DSA:
        return tag == 0x02 and len(content) >= 16
    return tag in (0x02, 0x04, 0x30) and len(content) >= 16 and (tag != 0x30 or _nests(content))


def _is_encrypted_pkcs8(items: list[tuple[int, bytes]]) -> bool:
    if [t for t, _ in items] != [0x30, 0x04] or len(items[1][1]) < 16:
        return False
    scheme = der_items(items[0][1])
    return bool(scheme) and len(scheme) == 2 and scheme[0][0] == 0x06 and scheme[0][1].startswith(SCHEMES) and scheme[1][0] == 0x30 and _nests(scheme[1][1])


def is_private_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        return _is_openssh(data)
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(top[0][1]) or []
    return bool(items) and (_is_pkcs1(items) or _is_dsa(items) or _is_sec1(items) or _is_pkcs8(items) or _is_encrypted_pkcs8(items))


def _is_pem_key(found: re.Match) -> bool:
    data = _unbase64(found[3]) or b""
    vector = _ENCRYPTED.search(found[2]) if found[2] else None
    if vector:
        return len(data) >= 32 and len(data) % (len(vector[1]) // 2) == 0
    return is_private_key(data)


def _base64_key(text: str, start: int, end: int) -> int | None:
    """Where the key ends whose base64 begins at ``start``, in one run of characters or in lines; None if it is none."""
    run = _unbase64(text[start:end])
    if run is None and (end - start) % 4 == 1:
        run = _unbase64(text[start : end - 1])
    if run is None:
        return None
    if run.startswith(b"-----BEGIN"):
        stop = _MORE_LINES.match(text, start).end()
        found = _PEM.search((_unbase64(text[start:stop]) or b"").decode("latin-1"))
        return stop if found and _is_pem_key(found) else None
    if text.startswith(("TU", "YjNCbGJu"), start):  # the base64 of base64, whose own end says where this ends
        stop = _MORE_LINES.match(text, start).end()
        inner = (_unbase64(text[start:stop]) or b"").decode("latin-1")
        whole = re.fullmatch(r"(?:M|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_=\s-]{15,}", inner)
        return stop if whole and _base64_key(inner, 0, _MORE_LINES.match(inner).end()) else None
    n = der_length(run) if run.startswith(b"0") else None
    if n is None:
        stop = _MORE_LINES.match(text, start).end()
        return stop if run.startswith(b"openssh-key-v1\0") and is_private_key(_unbase64(text[start:stop]) or b"") else None
    need, at = -(-n * 4 // 3), start
    stop = _MORE_LINES.match(text, start, start + 2 * need + 1000).end()
    if need > stop - start:
        return None
    while need and at < stop:  # past the line ends
        if text[at] == "\\":
            at += 2
            continue
        need -= not text[at].isspace()
        at += 1
    if need or not is_private_key((_unbase64(text[start:at]) or b"")[:n]):
        return None
    while at < stop and text[at] == "=":
        at += 1
    return at


def is_signed_token(text: str) -> bool:
    parts = text.split(".")
    try:
        header, body = (json.loads(_unbase64(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(body, dict)


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted; code points, end exclusive."""
    if not text:
        return []
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "." in text:
        out += [(m.start(), 3, m.end()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    keys = []
    if "PRIVATE KEY-----" in text:
        keys += [(m.start(), m.end()) for m in _PEM.finditer(text) if _is_pem_key(m)]
    if "M" in text or "TU" in text or "YjNCbGJu" in text or "b3BlbnNzaC1rZXktdjE" in text or "LS0tLS1CRUdJTi" in text:
        keys += [(m.start(), end) for m in _BASE64.finditer(text) if (end := _base64_key(text, m.start(), m.end()))]
    for m in _ANY_HEX.finditer(text):
        n = der_length(bytes.fromhex(m[0][:12]))
        if n and 2 * n <= len(m[0]) and is_private_key(bytes.fromhex(m[0][: 2 * n])):
            keys.append((m.start(), m.start() + 2 * n))
    keys += [(m.start(), m.end() - len(m[0]) % 2) for m in _SSH_HEX.finditer(text) if is_private_key(bytes.fromhex(m[0][: len(m[0]) // 2 * 2]))]
    upto = 0
    for start, end in sorted(set(keys), key=lambda k: (k[0], -k[1])):
        if start >= upto:
            out.append((start, 4, end))
            upto = end
    return sorted(out)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each secret, overlapping ones as one, replaced by ``mark``."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at, upto = [], 0, -1
    for start, _, end in spans:
        if start >= upto:
            out += [text[at:start], mark]
        at = upto = max(upto, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, a count for each kind, base_sha256, spans (kind:start:end, comma-joined)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64()) for kind in range(len(KINDS))]
            base = [hashlib.sha256(_joined([x for x in f if x[1] < 3]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array([_joined(f) for f in found], pa.string())], ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def redact_documents(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents in their own columns with secrets replaced; ``chars_col``, if there, is counted anew."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([redact(t) for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in names:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out
