"""Secret scans (operator 7): three patterns, and dictionary-primed zstandard novelty.

The novelty scan looks at strings of key characters on either side of a sensitive word, and at whole private keys. Each is compressed with a raw
dictionary of common identifiers and of the text around it (its own copies taken out): the bytes that it adds
are what this context can't explain. Strings that stay incompressible are reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbeam.llm.common import renamed

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 16 and more are all runs that the shorter pattern finds with that length.
_HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

#: Words that make their surroundings sensitive, in lower case.
SENSITIVE = (
    *("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "api key"),
    *("access_key", "access key", "private_key", "private key", "credential", "authorization", "bearer", "client_id", "signature"),
)
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE)
#: Characters between a candidate and a sensitive word at most, and of the context on each side.
REACH, CONTEXT = 48, 400
MIN_LENGTH = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
#: What may lie between a reported string and the next one of the same secret, and how much of it.
CHAIN, _ESCAPE = 8, re.compile(r"\\[nrt]")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----(.*?)(?:-----END |\Z)", re.DOTALL)
_KEY_LINE = re.compile(r"(?<![A-Za-z0-9+/=\\-])[A-Za-z0-9+/]{4,}={0,2}(?![A-Za-z0-9:-])|(?<=\\n)[A-Za-z0-9+/]{4,}={0,2}")
#: Characters of a string that are compressed at a time.
NOVELTY_BLOCK = 512
#: Bytes that a candidate must add for each of its characters.
MIN_NOVELTY = 0.7
#: What source code is full of; the compressor gets it as a dictionary.
IDENTIFIERS = (
    "import return function public private static class const void string integer boolean default config configuration "
    "password passwd secret token api_key apikey access_key client_id client_secret authorization bearer username user "
    "value name example placeholder changeme your_api_key_here your-token-here xxxxxxxxxxxxxxxx 0123456789abcdef "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 https http localhost www.example.com .json .yaml "
    "os.environ getenv process.env environment variable settings request response header application content-type "
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, each kind leftmost and without overlap."""
    found, low = [], text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def marginal_bytes(candidate: str, around: str) -> int:
    """Bytes that the candidate adds to its context and the identifiers."""
    own = candidate.encode("utf-8", "replace")
    context = IDENTIFIERS + around.encode("utf-8", "replace").replace(own, b"")
    primed = zstandard.ZstdCompressionDict(context, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(19, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
    compressor = zstandard.ZstdCompressor(dict_data=primed, compression_params=params)
    return len(compressor.compress(own)) - len(compressor.compress(b""))


def is_novel(value: str, around: str) -> bool:
    """Whether some block of the string stays incompressible; a string is read whole, block by block."""
    bounds = list(range(0, max(1, len(value) - MIN_LENGTH + 1), NOVELTY_BLOCK))
    ends = [*bounds[1:], len(value)]
    return any(marginal_bytes(value[a:b], around) >= MIN_NOVELTY * (b - a) for a, b in zip(bounds, ends, strict=True))


def _key_like(value: str) -> bool:
    """Letters with digits, or letters whose case changes more often than in words and names."""
    letters = [c for c in value if c.isalpha()]
    changes = sum(a.islower() and b.isupper() for a, b in zip(letters, letters[1:], strict=False))
    return bool(letters) and (any(c.isdigit() for c in value) or changes >= len(letters) // 8 + 1)


def key_blocks(text: str) -> list[tuple[int, int]]:
    """All lines of the private keys whose text, as a whole, is incompressible."""
    found = []
    for block in _KEY_BLOCK.finditer(text):
        pieces = [m.span() for m in _KEY_LINE.finditer(text, block.start(1), block.end(1))]
        whole = "".join(text[a:b] for a, b in pieces)
        if len(whole) >= MIN_LENGTH and is_novel(whole, ""):
            found += pieces
    return found


def novel_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible strings beside a sensitive word that no pattern has.

    A string is beside a word if at most ``REACH`` characters lie between them, on either side, or if nothing but
    a line end, quotes and the like lies between it and a string that was reported.
    """
    low = text.lower()
    if not any(word in low for word in SENSITIVE):
        return []
    found = [(a, b) for a, b in key_blocks(text) if not any(x < b and a < y for x, _, y in taken)]
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    known = sorted([(a, b) for a, _, b in taken] + found)
    starts, after, before, last = [a for a, _ in words], 0, -1, -1
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        after = bisect_left(starts, end, after)
        at = after - 1
        while at >= 0 and words[at][1] > start:  # words inside the string
            at -= 1
        before = words[at][1] if at >= 0 else -1
        near = (before >= 0 and start - before <= REACH) or (after < len(words) and words[after][0] - end <= REACH)
        chained = last >= 0 and start - last <= CHAIN and not any(c.isalnum() for c in _ESCAPE.sub("", text[last:start]))
        if not (near or chained):
            continue
        place = bisect_left(known, (end,))
        if place and known[place - 1][1] > start:
            last = end if chained else last
            continue
        value = text[start:end]
        if _key_like(value) and is_novel(value, text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]):
            found.append((start, end))
            last = end
    return sorted((a, 3, b) for a, b in found)


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text as (start, kind, end), ordered by start, then kind as listed."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) for every row; ``spans`` is an array of (kind, start, end, base), offsets in code points.

    A null text counts as empty and has no spans. Null ids and repeated rows are scanned like any other. An
    empty table gives an empty result. Whole texts are read, whatever their length.
    """
    slim = renamed(docs, doc_id=doc_id, text=text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": KINDS[k], "start": a, "end": b, "base": k < 3} for a, k, b in spans(x.as_py())[1]] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(of, f"doc_id {id_type}, spans array<struct<kind string, start int, end int, base boolean>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans as text."""

    def text_of(items):
        return F.concat_ws(",", F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    columns = [F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans")]
    return scanned.select("doc_id", *map(count, KINDS[:3]), *columns, count(KINDS[3]))
