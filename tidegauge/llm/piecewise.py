"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

A text is spelled as the model's normaliser does (a mark for each space and one in front) and
cut into words, each a run of marks and what follows it: no piece crosses such a cut. The
symbols of all new words lie in one flat array. In each round every word finds the smallest
rank among its pairs, merges that pair at every place from the left, as long as no merge opens
a better pair, and the array is compacted; words without a pair leave it. Words met before are
looked up. Only byte-pair models with the identity normaliser are taken; others raise.
"""

from __future__ import annotations

import codecs
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.common import chunks, text_or_empty, worker_memory

MARK = "▁"  # stands for a space
NONE = np.iinfo(np.int32).max  # rank of a pair that does not merge
BETWEEN = re.compile(f"[^ {MARK}] ")  # a space that begins a run of spaces
PART = 1_000_000  # characters of one text that are encoded together, if it has spaces
KNOWN_BYTES = 100_000_000  # of words a Python worker remembers


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _each_byte(error):
    """A replacement character for every byte that is no text."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


def gather(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices ``values[begin : begin + count]``, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begin - (ends - count), count)]


def slices(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all parts in one array, with where each begins and how long it is."""
    count = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(count) - count, count


class Pieces:
    """A model's pieces: ranks of pairs for encoding, spellings for decoding."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        probe = "ﬁ  a "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError(f"{path}: only the identity normaliser with a leading space is supported")
        n = self.size = sp.get_piece_size()
        kind = [
            "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "byte" if sp.is_byte(i) else "text"
            for i in range(n)
        ]
        spelled = [sp.id_to_piece(i) for i in range(n)]
        scores = [sp.get_score(i) for i in range(n)]
        text = {p: i for i, (p, k) in enumerate(zip(spelled, kind)) if k == "text" and not sp.is_unused(i)}
        self.byte_ids = np.zeros(256, np.int32)
        for i, k in enumerate(kind):
            if k == "byte":
                self.byte_ids[int(spelled[i][3:5], 16)] = i
        if kind.count("byte") != 256:
            raise ValueError(f"{path}: only models with byte fallback are supported")
        # single characters: pieces, then those that only occur inside longer pieces
        ids = {p: i for p, i in text.items() if len(p) == 1}
        inside = sorted({c for p in text if len(p) > 1 for c in p})
        for c in inside:
            ids.setdefault(c, n + len(ids))
        symbols = text | ids
        self.stray = 1 + max(symbols.values(), default=n)  # any other character
        self.width = self.stray + 1
        self.of_char = np.full(0x110000, self.stray, np.int32)
        self.of_char[[ord(c) for c in ids]] = list(ids.values())
        # which characters stand side by side in some piece, and what they merge into if they do
        self.place = np.full(0x110000, len(inside), np.int16)
        self.place[[ord(c) for c in inside]] = range(len(inside))
        self.beside = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        self.first_rank = np.full(self.beside.shape, NONE, np.int32)
        self.first_into = np.zeros(self.beside.shape, np.int32)
        ranks = {s: r for r, s in enumerate(sorted({scores[i] for i in text.values()}, reverse=True))}
        pairs = {}
        for p, i in text.items():
            side = [self.place[ord(c)] for c in p] if len(p) > 1 else []
            self.beside[side[:-1], side[1:]] = True
            if len(p) == 2:
                self.first_rank[side[0], side[1]] = ranks[scores[i]]
                self.first_into[side[0], side[1]] = i
            for cut in range(1, len(p)):
                if p[:cut] in symbols and p[cut:] in symbols:
                    pairs[symbols[p[:cut]] * self.width + symbols[p[cut:]]] = (ranks[scores[i]], i)
        if any(MARK in p.lstrip(MARK) for p in text):
            raise ValueError(f"{path}: a piece has a space after other characters")
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys], np.int32)
        # what each id spells, and whether it is a byte, a control sign or the unknown sign
        self.is_byte = np.array([k == "byte" for k in kind])
        self.is_sign = np.array([k in ("control", "unknown") for k in kind])
        unknown = sp.decode([sp.unk_id()]).encode()
        self.spelling = slices(
            [
                bytes([int(p[3:5], 16)]) if k == "byte"
                else b"" if k == "control"
                else unknown if k == "unknown"
                else p.replace(MARK, " ").encode()
                for p, k in zip(spelled, kind)
            ]
        )
        self.leads = np.array([k == "text" and p.startswith(MARK) for p, k in zip(spelled, kind)])
        self.decimal = slices([b"%d," % i for i in range(n)])
        alone = "".join(c for c in map(chr, range(32)) if c not in inside)
        stop = re.escape(alone)
        self.lines = "\n" in alone  # a line feed is always a piece of its own
        self.run = self._run_block(text)
        block = f"{MARK}{{{self.run}}}(?={MARK})|" if self.run else ""
        self.word = re.compile(f"{block}{MARK}+[^{MARK}{stop}]*|[^{MARK}{stop}]+|[{stop}]")

    def _run_block(self, text: dict[str, int]) -> int:
        """Length of the blocks that a long run of marks falls into, 0 if they are not all alike.

        Holds if runs merge after all else and a run of several blocks gives whole ones.
        """
        runs = [len(p) for p in text if not p.strip(MARK) and len(p) > 1]
        if not runs:
            return 0
        k, mine = max(runs), {text[MARK * r] for r in runs}
        rank_of = dict(zip(self.merged.tolist(), self.ranks.tolist()))
        worst = max((r for i, r in rank_of.items() if i not in mine), default=-1)
        whole = [text[MARK * k]]
        alike = all(self.encode_words([MARK * (k * m + 1)])[0].tolist()[:m] == whole * m for m in (1, 2, 3))
        return k if alike and min(rank_of[i] for i in mine) > worst else 0

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NONE``: no such pair) and the symbol it merges into."""
        key = left * np.int64(self.width) + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        met = self.keys[at] == key
        return np.where(met, self.ranks[at], NONE), self.merged[at]

    def merge(self, sym: np.ndarray, head: np.ndarray, rank: np.ndarray, into: np.ndarray) -> np.ndarray:
        """The symbols left at their first character's place, -1 at places merged away.

        ``head`` marks the first symbol of each segment; ``rank`` and ``into`` are those of
        the pair that begins at each symbol, ``NONE`` at the last one of a segment. A pair's
        places are merged together up to the first one whose new neighbours rank as well or
        better, because that one would be next if the best, leftmost pair were merged alone.
        """
        out = np.full(len(sym), -1, np.int32)
        pos = np.arange(len(sym))
        while len(sym):
            starts = np.flatnonzero(head)
            size = np.diff(starts, append=len(sym))
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                keep = np.repeat(live, size)
                out[pos[~keep]] = sym[~keep]
                sym, pos, head, rank, into = sym[keep], pos[keep], head[keep], rank[keep], into[keep]
                size, least = size[live], least[live]
                if not len(sym):
                    break
            i = np.flatnonzero(rank == np.repeat(least, size))
            # of places that overlap, every other one from the left
            first = np.flatnonzero(np.diff(i, prepend=-2) != 1)
            i = i[(np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i)))) % 2 == 0]
            new = into[i]
            segment = np.repeat(np.arange(len(size)), size)[i]
            touches = np.diff(i, prepend=-9) == 2  # the symbol before is merged in this round too
            before = np.where(touches, np.roll(new, 1), sym[i - 1])
            left_rank, left_into = self.lookup(before, new)
            left_rank[head[i]] = NONE
            after = np.minimum(i + 2, len(sym) - 1)
            right_rank, right_into = self.lookup(new, sym[after])
            right_rank[(i + 2 >= len(sym)) | head[after]] = NONE
            better = np.minimum(left_rank, right_rank) <= least[segment]
            if better.any():
                seen = np.cumsum(better) - better
                start = np.flatnonzero(np.diff(segment, prepend=-1))
                ok = seen == np.repeat(seen[start], np.diff(start, append=len(i)))
                i, new, touches = i[ok], new[ok], touches[ok]
                left_rank, left_into = left_rank[ok], left_into[ok]
                right_rank, right_into = right_rank[ok], right_into[ok]
            touches &= ~head[i]
            sym[i], rank[i], into[i] = new, right_rank, right_into
            inner = ~head[i]
            at = (i - 1 - touches)[inner]
            rank[at], into[at] = left_rank[inner], left_into[inner]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            sym, pos, head, rank, into = sym[keep], pos[keep], head[keep], rank[keep], into[keep]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size) - size
        if not len(points):
            return np.zeros(0, np.int32), size
        place = self.place[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.beside[place[:-1], place[1:]]
        cut[begin[size > 0]] = True
        rank, into = np.full(len(points), NONE, np.int32), np.zeros(len(points), np.int32)
        rank[:-1] = np.where(cut[1:], NONE, self.first_rank[place[:-1], place[1:]])
        into[:-1] = self.first_into[place[:-1], place[1:]]
        left = self.merge(self.of_char[points], cut, rank, into)
        # characters that are no piece: their bytes
        at = np.flatnonzero(left >= 0)
        ids = left[at]
        count = np.zeros(len(points), np.int64)
        count[at] = 1
        stray = np.flatnonzero(ids >= self.size)
        if len(stray):
            chars, which = np.unique(points[at[stray]], return_inverse=True)
            values, start, length = slices([chr(c).encode() for c in chars])
            count[at[stray]] = length[which]
            ids = np.repeat(ids, count[at])
            ids[ids >= self.size] = self.byte_ids[gather(values, start[which], length[which])]
        run = np.concatenate([[0], np.cumsum(count)])
        return ids, run[begin + size] - run[begin]

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        """The text of the ids; the leading space that encoding added goes if ``first``."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        signs = np.flatnonzero(self.is_sign[ids])
        if len(signs):  # bytes on two sides of a sign are no character
            edges = np.unique(np.concatenate([[0], signs, signs + 1, [len(ids)]]))
            text = ""
            for a, b in zip(edges[:-1], edges[1:]):
                piece = self.is_sign[ids[a]]
                text += self._text(ids[a:b]) if piece else self.decode(ids[a:b], first and not text)
            return text
        text = self._text(ids)
        return text[1:] if first and self.leads[ids[0]] else text

    def _text(self, ids: np.ndarray) -> str:
        values, begin, count = self.spelling
        return gather(values, begin[ids], count[ids]).tobytes().decode("utf-8", "each_byte")


class Words(dict):
    """Numbers words as they come and lists those that are new.

    A key is what follows a mark, or text without one: a line feed and what follows it, or
    any other after a mark that is not part of it.
    """

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


def _spelled(key: str) -> str:
    return key[1:] if key.startswith(MARK) else key if key.startswith("\n") else MARK + key


class Encoder:
    """Encodes texts by words, and remembers the words it met, up to ``KNOWN_BYTES``."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.held = Words(), 0
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """Keys of the words of a text that has a space before it."""
        if "  " not in text and text[:1] != " " and MARK not in text and self.pieces.lines:
            return text.replace("\n", " \n").split(" ")
        found = self.pieces.word.findall(MARK + text.replace(" ", MARK))
        return [
            "" if w == MARK else w[1:] if w[0] == MARK != w[1] else MARK + w
            for w in found
        ]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and how many each has; no text is empty."""
        if self.held > KNOWN_BYTES:
            self.forget()
        which, sizes = [], []
        for text in texts:
            words = self.words(text)
            which.append(np.array(list(map(self.known.__getitem__, words))))
            sizes.append(len(words))
        new = self.known.new
        if new:
            self.known.new = []
            spelled = list(map(_spelled, new))
            ids, count = self.pieces.encode_words(spelled)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids])
            self.held += sum(map(len, new)) + 4 * len(ids) + 150 * len(new)
        which = np.concatenate(which)
        count = self.count[which]
        run = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(sizes)
        return gather(self.ids, self.begin[which], count), run[ends] - run[ends - sizes]


def _encoder(path: str) -> Encoder:
    memory = worker_memory("pieces")
    if path not in memory:
        memory[path] = Encoder(path)
    return memory[path]


def parts(text: str, most: int = PART):
    """The text in parts that can be encoded alone, none if it is empty.

    A space between two parts belongs to neither: it is the space each part has before it.
    """
    start = 0
    while len(text) - start > most and (cut := BETWEEN.search(text, start + most)):
        yield text[start : cut.end() - 1]
        start = cut.end()
    if text:
        yield text[start:]


def encoded(texts: list[str], path: str):
    """For each part of each text in order: the text's number, whether it is the first, its ids."""
    owner, pieces = [], []
    for i, text in enumerate(texts):
        for part in parts(text):
            owner.append(i)
            pieces.append(part)
    encoder = _encoder(path)
    for lo, hi in chunks(pieces):
        ids, count = encoder.encode(pieces[lo:hi])
        ends = np.cumsum(count)
        for j, end in enumerate(ends.tolist()):
            i = owner[lo + j]
            yield i, lo + j == 0 or owner[lo + j - 1] != i, ids[end - int(count[j]) : end]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and the ``ids`` (array of int) of each row's text.

    A null text is empty and has no ids. Rows keep their ids whatever they are: null or
    repeated ones are rows of their own. A very long text is encoded in parts.
    """
    where = path or model_path()

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            got: list[list[np.ndarray]] = [[] for _ in texts]
            for i, _, ids in encoded(texts, where):
                got[i].append(ids)
            count = np.array([sum(map(len, g)) for g in got], np.int64)
            flat = np.concatenate([a for g in got for a in g] or [np.zeros(0, np.int32)])
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and the ``text`` of each row's ``ids``; null or no ids are an empty text.

    As the library: bytes that are no text are replacement characters, control ids are
    nothing, the unknown id is its sign. Ids outside the model or null raise.
    """
    where = path or model_path()

    def run(batches):
        for batch in batches:
            pieces = _encoder(where).pieces
            texts = [pieces.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each text encoded and its ids decoded, as digests of both.

    ``encode`` and ``decode`` in one pass over the rows, a part of a text at a time, so that
    neither ids nor texts travel. Null texts are empty; rows are kept as they are.
    """
    where = path or model_path()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            total = [0] * len(texts)
            spelled = [hashlib.sha256() for _ in texts]
            decoded = [hashlib.sha256() for _ in texts]
            pieces = _encoder(where).pieces
            values, begin, count = pieces.decimal
            for i, first, ids in encoded(texts, where):
                if len(ids):
                    digits = gather(values, begin[ids], count[ids]).tobytes()[:-1]
                    spelled[i].update(b"," + digits if total[i] else digits)
                total[i] += len(ids)
                decoded[i].update(pieces.decode(ids, first).encode())
            columns = [
                batch.column("doc_id"),
                pa.array(total, pa.int64()),
                pa.array([h.hexdigest() for h in spelled]),
                pa.array([h.hexdigest() for h in decoded]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
