"""Secret scan: fixed patterns, and random strings that a tokenizer cannot shorten.

A byte-pair vocabulary is learnt from written text, so words take few tokens and random
strings take many. Runs of code characters are cut at the fixed patterns' spans, at known
digests and at UUIDs; what is left is reported if it has few characters per token, as a
whole, by the parts between separators, or by a stretch of a long one. Words and numbers
joined by separators are judged by their longer words alone. A digest is known by what stands
before it (``sha256:``, ``etag=``, ``commit`` and the like) or as that of no bytes at all, not
by its length. Numbers and nucleotide sequences are identifiers. Letters of one case can be a
long word of a language the vocabulary knows little of, so their limit is lower, lowest for
short ones. Every whole text is scanned, very long ones too; null is empty.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import spans_text, text_or_empty

KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind string, start int, end int>>"
TOKENIZER = "byte_bpe_50k.tiktoken"
MIN_LENGTH = 16
MAX_RATIO = 2.2  # characters a token
WORD_RATIO = 0.93  # of that, for letters of one case
SHORT_RATIO, SHORT_WORD = 0.86, 20  # and for fewer letters than that
LONG = 2 * MIN_LENGTH  # of a run that is searched for a random stretch
WORDY = 6  # letters of a joined word that is judged

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
WORDS = ("passw", "secret", "token", "api")
# digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), and identifiers
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
INTEGRITY = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]{43,86}={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
KNOWN = re.compile(f"(?<![A-Za-z0-9])(?:(?P<sure>{UUID.pattern}|{INTEGRITY.pattern})|{DIGEST.pattern})(?![A-Za-z0-9])")
LABEL = re.compile(
    r"(?<![A-Za-z])(?:md5|sha-?(?:1|224|256|384|512)|digest|checksum|etag|commit|revision)(?:sum)?[\"']?[\x20:=@/(-]{1,3}[\"']?\Z",
    re.IGNORECASE,
)
NO_BYTES = {hashlib.new(name).hexdigest() for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BASES = re.compile(r"[ACGTUN]+|[acgtun]+")
PART = re.compile(r"[A-Za-z0-9+_]+")
PLAIN = re.compile(r"[A-Za-z]*[0-9]*")
DOTTED = re.compile(r"[A-Za-z]+[0-9]*(?:[._/-]+[A-Za-z]+[0-9]*)*|[0-9]+(?:[._/-]+[0-9]+)*")


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chars_per_token(run: str, path: str) -> float:
    """Characters per token; long runs are encoded in stretches of 1,000 characters."""
    encode = _encoding(path).encode_ordinary
    return len(run) / sum(len(encode(run[i : i + 1000])) for i in range(0, len(run), 1000))


def random_stretch(run: str, path: str, max_ratio: float) -> tuple[int, int] | None:
    """The stretch of at least ``MIN_LENGTH`` characters that most exceeds the tokens allowed."""
    encoding = _encoding(path)
    sizes = [
        len(b)
        for i in range(0, len(run), 1000)
        for b in encoding.decode_tokens_bytes(encoding.encode_ordinary(run[i : i + 1000]))
    ]
    best, low, low_at = 0.0, 0.0, 0
    ends, total, sums, first = [0], 0.0, [0.0], 0
    found = None
    for size in sizes:
        total += max_ratio - size
        ends.append(ends[-1] + size)
        sums.append(total)
        while ends[-1] - ends[first] >= MIN_LENGTH:
            if first == 0 or sums[first] < low:
                low, low_at = sums[first], first
            first += 1
        if first and total - low > best:
            best, found = total - low, (ends[low_at], ends[-1])
    return found


def limit(run: str, max_ratio: float) -> float:
    """Characters a token below which a run reads as random."""
    if not WORD.fullmatch(run):
        return max_ratio
    return max_ratio * (SHORT_RATIO if len(run) < SHORT_WORD else WORD_RATIO)


def is_random(run: str, path: str, max_ratio: float) -> bool:
    """Whether a whole run is long enough and takes many tokens for its length."""
    if len(run) < MIN_LENGTH or BASES.fullmatch(run):
        return False
    parts = PART.findall(run)
    # numbers are identifiers: what is left without them must be long enough
    if sum(len(p) for p in parts if not p.isdigit()) < MIN_LENGTH:
        return False
    if len(parts) > 1 and DOTTED.fullmatch(run):
        words = [p for p in parts if len(p) >= WORDY and not p.isdigit()]
        return sum(map(len, words)) >= MIN_LENGTH and sum(map(len, words)) < sum(
            limit(p, max_ratio) * len(p) / chars_per_token(p, path) for p in words
        )
    return chars_per_token(run, path) < limit(run, max_ratio)


def _is_known(text: str, start: int, hit: re.Match) -> bool:
    """Whether a digest or UUID found in the run at ``start`` is known to be one."""
    if hit["sure"] or hit[0].lower() in NO_BYTES:
        return True
    at = start + hit.start()
    return LABEL.search(text[max(0, at - 24) : at]) is not None


def random_spans(run: str, path: str, max_ratio: float = MAX_RATIO) -> list[tuple[int, int]]:
    """Spans of a run that read as random: the whole, else its parts, else stretches."""
    kept = run.strip("./-=")
    if len(kept) < MIN_LENGTH:
        return []
    at = run.index(kept)
    if is_random(kept, path, max_ratio):
        return [(at, at + len(kept))]
    spans = [m.span() for m in PART.finditer(run) if is_random(m[0], path, max_ratio)]
    out, todo = list(spans), _between(0, len(run), spans)
    while todo:
        start, end = todo.pop()
        if end - start < LONG:
            continue
        got = random_stretch(run[start:end], path, max_ratio)
        if not got:
            continue
        a, b = start + got[0], start + got[1]
        parts = PART.findall(run[a:b])
        # plain words and numbers that separators alone make long are none, nor is part of a word
        if len(parts) == 1:
            if not WORD.fullmatch(parts[0]) and not parts[0].isdigit():
                out.append((a, b))
        elif not all(PLAIN.fullmatch(p) for p in parts):
            out.append((a, b))
        todo += [(start, a), (b, end)]
    return sorted(out)


def _between(start: int, end: int, spans) -> list[tuple[int, int]]:
    """What sorted spans leave of a range."""
    out = []
    for a, b in spans:
        if b > start and a < end:
            out.append((start, a))
            start = max(start, b)
    return [(a, b) for a, b in [*out, (start, end)] if a < b]


def _overlapping(taken, at: int, end: int) -> list[tuple[int, int]]:
    """Sorted spans from ``at`` on that start before ``end``."""
    out = []
    while at < len(taken) and taken[at][0] < end:
        out.append(taken[at])
        at += 1
    return out


def find(text: str, path: str, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """Spans of one text, by start and then by kind as listed in ``KINDS``."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(word in low for word in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if max(map(len, text.split()), default=0) >= MIN_LENGTH:
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        taken = sorted((s, e) for _, s, e in out)
        at = 0
        for m in RUN.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            cuts = [m.start() + c for k in KNOWN.finditer(m[0]) if _is_known(text, m.start(), k) for c in k.span()]
            cuts = sorted([*zip(cuts[::2], cuts[1::2]), *_overlapping(taken, at, m.end())])
            for a, b in _between(*m.span(), cuts):
                out += [("random", a + x, a + y) for x, y in random_spans(text[a:b], path, max_ratio)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(text: Column, path: str | None = None, max_ratio: float = MAX_RATIO) -> Column:
    """Spans in code points, end exclusive; a null or empty text has none."""
    where = path or tokenizer_path()

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, where, max_ratio)] for t in texts],
            dtype=object,
        )

    return scan(F.coalesce(text, F.lit("")))


def scan_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and its ``spans``, a row for each row of ``docs``; other columns are not read."""
    return docs.select("doc_id", secret_spans(text_or_empty(), path).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the fixed patterns' spans, and all spans as text."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
        count("random").alias("n_random"),
    )
