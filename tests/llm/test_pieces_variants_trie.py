"""Piece encoding against the library, spelling variants and prefix tries against brute force."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

from tidegauge.llm import minhash, piecewise, queries, turntrie, variants

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# ---- 11 pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piecewise.model_path())


def ids_of(texts):
    out = [[] for _ in texts]
    for i, _, ids in piecewise.encoded(texts, piecewise.model_path()):
        out[i] += ids.tolist()
    return out


def odd_texts(library):
    rng = random.Random(11)
    known = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    signs = "▁ \t\n\r abcdefghinorst.,=-*_/'\"<>{}()0123456789éüñ日本語\x00😀İ\xa0"
    texts = ["", " ", "  ", "\n", " \n x", "a ", "x\ny  z", "▁x ▁▁", "<s></s><unk><0x41>", "ﬁ ½ Ⅳ"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["".join(rng.choice(known) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["".join(rng.choice(known).strip("▁") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [c * 3001 for c in map(chr, range(32, 127))]
    return texts + [" " * 40_003, "ab" * 30_000, "the" * 9_000, "\n" * 9_000, "日本" * 5_000]


def test_pieces_are_those_of_the_library(library):
    texts = odd_texts(library)
    assert ids_of(texts) == library.encode(texts)


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    monkeypatch.setattr(piecewise.parts, "__defaults__", (50,))
    texts = odd_texts(library)[:900] + [" a  b   c" * 100, "word " * 100, "no_space" * 40]
    assert max(len(list(piecewise.parts(t))) for t in texts) > 5
    assert ids_of(texts) == library.encode(texts)


def test_words_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(piecewise, "KNOWN_BYTES", 1_000)
    texts = odd_texts(library)[:400]
    for text in texts:
        assert ids_of([text]) == library.encode([text])


def test_any_ids_are_decoded_as_the_library_does(library):
    rng = random.Random(12)
    pieces = piecewise.Pieces(piecewise.model_path())
    for _ in range(2_000):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(262) for _ in range(rng.randrange(12))]
        assert pieces.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_piece_query(spark, library):
    got = {r["doc_id"]: r for r in queries.op11_piece_encoding(spark, SMALL).collect()}
    docs = documents(spark).select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "")
        r = got[doc_id]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))
        )


def test_pieces_of_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "a  b", 3), (1, "a  b", 3), (None, "x" * 50_000 + " y", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    coded = piecewise.encode(df)
    assert sorted((r["doc_id"] or -1, len(r["ids"])) for r in coded.collect())[2:] == [(1, 0), (1, 3), (1, 3)]
    back = sorted(((r["doc_id"], r["text"]) for r in piecewise.decode(coded).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert piecewise.round_trip(df).count() == 5
    none = spark.createDataFrame([], "doc_id long, text string")
    assert piecewise.decode(piecewise.encode(none)).count() == piecewise.round_trip(none).count() == 0
    assert piecewise.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).head()["text"] == ""


# ---- 12 variants


def naive_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def naive_variants(rows):
    n = naive_words(rows)
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def collected(df, columns):
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variant_query(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    want = naive_variants(rows)
    assert sum(f is not None for _, f, *_ in want) > 100
    assert collected(queries.op12_spelling_variants(spark, SMALL), COLUMNS) == want


def lexicon(rng, letters, lengths, size):
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(size)}
    return sorted(words)


@pytest.mark.parametrize("cells", [100, 60_000])
def test_variants_whatever_the_groups(spark, monkeypatch, cells):
    """Words of few letters, and words that all share front and back, dealt often or hardly."""
    monkeypatch.setattr(variants, "CELLS", cells)
    monkeypatch.setattr(variants, "BATCH", cells)
    rng = random.Random(cells)
    words = lexicon(rng, "ab", (5, 6, 7, 8), 150) + lexicon(rng, "abÿ", (9, 10), 60)
    words += ["prefixe" + w + "suffixe" for w in lexicon(rng, "xyz", (1, 2, 3, 4), 150)]
    words += ["a" * k for k in range(5, 12)] + ["lang" * 40 + w for w in lexicon(rng, "xy", (1, 2), 6)]
    rows = [(i, " ".join([w] * rng.choice((3, 4, 6, 9, 30)))) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(variants.variants(df), COLUMNS) == naive_variants(rows)


def test_variants_of_odd_rows(spark):
    rows = [(None, "Hello hello HELLO hella hella hella"), (1, None), (1, ""), (2, "hello Ünder Ünder Ünder ünder")]
    rows += [(2, "hello Ünder Ünder Ünder ünder")] * 2 + [(3, "abcd " * 9)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    assert collected(variants.variants(df), COLUMNS) == naive_variants(rows)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(none).count() == 0


def test_paths_of_forms_are_followed_to_their_end(spark):
    forms = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "f"), ("y", "x")]
    got = variants.roots(spark.createDataFrame(forms, "word string, form string")).collect()
    assert {tuple(r) for r in got} == {(w, "f") for w, _ in forms}


# ---- 13 trie


def naive_trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by[c].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    return {
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            sha(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))),
        )
        for p, m in members.items()
    }


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.op13_prefix_trie(spark, SMALL), TRIE) == naive_trie(rows)


def talk(rng):
    rows = []
    for c in range(150):
        for t in range(rng.randrange(7)):
            conv = None if rng.random() < 0.02 else c + rng.choice((0, 0, 1000))
            rows.append((conv, None if rng.random() < 0.1 else t, rng.choice(("u", "a", None)), rng.choice(("x y", "x", "", None))))
    rows += [(7, i, "u", "w w") for i in range(60)]
    rows += [(20 * k + 5, i, "u", "w w") for k in range(100, 130) for i in range(20)]  # copies
    rows += [(40, 1, "u", "one"), (40, 1, "u", "two"), (40, 1, "u", "two")]  # ties and repeated rows
    return rows + [(21, 0, "u", "long " * 20_000), (9_000_000_001, 0, None, "\x0b no\x00w ")]


@pytest.mark.parametrize("shard", [1, 7, 20_000])
def test_trie_whatever_the_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(turntrie, "SHARD_KEYS", shard)
    monkeypatch.setattr(turntrie, "BLOB", 10)
    rows = talk(random.Random(13))
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], "conv_id long, turn long, role string, text string, pos int, key binary")
    assert collected(turntrie.prefix_trie(df.repartition(5)), TRIE) == naive_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turntrie.prefix_trie(none).count() == 0
    only = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert turntrie.prefix_trie(only).count() == 0


def test_radix_nodes_grow_and_keep_their_order():
    rng = random.Random(4)
    keys = {bytes(rng.randrange(k) for _ in range(4 * rng.randrange(1, 4))) for k in (2, 20, 60, 256) for _ in range(400)}
    root = turntrie.Node(b"")
    listed = list(keys)
    for i, key in enumerate(listed):
        turntrie.insert(root, key, i)
    found, stack, layouts = [], [(root, b"")], set()
    while stack:
        node, before = stack.pop()
        spelled = before + node.path
        layouts.add("wide" if node.keys is None else len(node.keys) if len(node.keys) == 256 else 16)
        if node.value >= 0:
            assert listed[node.value] == spelled
            found.append(spelled)
        below = node.ordered()
        first = [next(b for b in range(256) if node.child(b) is c) for c in below]
        assert first == sorted(first)
        stack += [(c, spelled + bytes([b])) for b, c in reversed(list(zip(first, below)))]
    assert found == sorted(keys) and layouts == {16, 256, "wide"}


# ---- 9 tasks by size


def test_fingerprint_ranges_follow_the_bytes(spark):
    df = spark.createDataFrame([(i, "ab" * 50) for i in range(90)], "doc_id long, text string")
    assert minhash.ranges(df) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert minhash.ranges(df, 100) == 90
    assert minhash.ranges(df.filter("doc_id < 0"), 100) == minhash.ranges(df)
    few, many = minhash.in_order(df, 2), minhash.in_order(df, 30)
    assert few.select("part").distinct().count() == 2 and many.select("part").distinct().count() == 30
