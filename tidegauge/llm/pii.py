"""Personal data: fixed patterns, and the terms that give a protected entity away.

Patterns find e-mail and IP addresses, card and phone numbers. Each different value is a
protected entity. How strongly a term reveals it is estimated from the corpus: the pointwise
mutual information of term and entity over the entity's own information,

    disclosure = log(N n(t,g) / n(t) n(g)) / log(N / n(e)),

with N documents, n(t) and n(g) those that hold the term or an entity of the group, and
n(t,g) those that hold both, wherever in the text. Documents of one text are one document
here: a copy says nothing of its words that the first did not say. A group is the entity itself, or those
that share a domain, a name part, a network, an issuer or all but the last digits of a
number (``groups``): given the group, entity and term are taken for independent, so a group
scores the terms of entities that are in one document. It is 1 where the term names the
entity and 0 where the two are independent.

The ratio n(t,g) / n(t) is taken as it is from ``SUPPORT`` documents on, and where the
address itself spells the term. Below that it is the lower end (``Z`` deviations, Wilson) of
the ratio in the other documents: one document cannot tell its entity from its other words.

Only terms that stand within ``WINDOW`` words of some entity of the group are scored. One
above the threshold is generalised to its first letters, or removed if those still disclose
as much, wherever it stands in the documents that hold the entity. No other is changed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import Remembered, bits_of, fresh, in_bits, keyed, may_be_in, spans_text, text_key, text_or_empty, tidy
from tidegauge.session import settle

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW = 8  # terms looked at on each side of an entity
SUPPORT = 3  # documents with term and group from which their plain ratio counts
Z = 3.0
THRESHOLD = 0.6
STEM = 3  # letters that a generalised term keeps
LOG2_BITS = 24

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\w+")
NAME = re.compile(r"[a-z]{3,}")


def _emails(text: str):
    """The e-mail pattern's matches, anchored at each @ so that no long run is read twice."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_SET:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        floor = end.end() if end else at + 1
        if end:
            yield start, floor
        at = text.find("@", floor)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans of one text by kind as listed, then by start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    """The protected entity a match stands for: lowered, or its digits alone."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}"


def groups(name: str) -> list[str]:
    """The entity and what it shares with others: ``entity`` names, the entity first."""
    kind, value = name.split(":", 1)
    if kind == "email":
        local, _, domain = value.partition("@")
        return [name, f"domain:{domain}", *(f"name:{x}" for x in dict.fromkeys(NAME.findall(local)))]
    if kind == "ip":
        return [name, f"net:{value.rpartition('.')[0]}"]
    return [name, f"{kind}s:{value[:6] if kind == 'card' else value[:-4]}"]


def beside(text: str, spans, window: int = WINDOW):
    """Terms within ``window`` words of each entity: ``(entity, term, start, end)``, no repeats."""
    covered = sorted((s, e) for _, s, e in spans)
    words = []
    i = 0
    for m in WORD.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        if i == len(covered) or covered[i][0] >= m.end():
            words.append(m.span())
    starts = [w[0] for w in words]
    found = {}
    for kind, s, e in spans:
        name = entity(kind, text[s:e])
        at = int(np.searchsorted(starts, s))
        for a, b in words[max(0, at - window) : at + window]:
            if b - a >= STEM:
                found[name, text[a:b].lower(), a, b] = None
    return list(found)


SCANNED = (
    "array<struct<kind string, start int, end int>>",
    "array<struct<entity string, part string>>",
    "array<struct<part string, term string>>",
)


def scan_column(text: Column) -> Column:
    """``spans`` of the patterns, their entities' groups as ``parts``, and the terms ``near`` them."""

    @F.pandas_udf(f"spans {SCANNED[0]}, parts {SCANNED[1]}, near {SCANNED[2]}")
    @tidy
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            spans, parts, near = [], [], []
            for t in texts:
                got = find(t)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in got])
                held = {n: groups(n) for n in dict.fromkeys(entity(k, t[s:e]) for k, s, e in got)}
                parts.append([{"entity": n, "part": g} for n, gs in held.items() for g in gs])
                both = dict.fromkeys((g, w) for n, w, _, _ in beside(t, got) for g in held[n]) if got else ()
                near.append([{"part": g, "term": w} for g, w in both])
            yield pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in (("spans", spans), ("parts", parts), ("near", near))})

    return scan(F.coalesce(text, F.lit("")))


def _forms(term: Column) -> Column:
    """A term in its two forms: itself and its first letters."""
    return F.array(F.concat(F.lit("w"), term), F.concat(F.lit("s"), F.substring(term, 1, STEM)))


def forms_of(text: str) -> set[str]:
    """``_forms`` of every word of a text."""
    words = {w for w in WORD.findall(text.lower()) if len(w) >= STEM}
    return {"w" + w for w in words} | {"s" + w[:STEM] for w in words}


def together(scanned: DataFrame, wanted: DataFrame, log2_bits: int = LOG2_BITS) -> DataFrame:
    """``(part, form, n)``: documents that hold a group and a form of each wanted pair.

    ``wanted`` has ``part``, ``form``; a bitmap of its hashes keeps other pairs in the scan.
    """
    key = F.xxhash64("form").bitwiseXOR(F.xxhash64("part"))
    bitmap = bits_of(wanted.select(key.alias("h")), "h", log2_bits)

    def pairs(frames):
        bits = np.frombuffer(bitmap, np.uint64)
        known = Remembered()
        shift = np.uint64(64 - log2_bits)

        def hash_of(x: str) -> int:
            got = known.get(x)
            return known.keep(x, xxhash.xxh64_intdigest(x, 42)) if got is None else got

        for frame in frames:
            for text, parts in zip(frame["text"], frame["parts"]):
                forms = list(forms_of(text))
                h = np.fromiter(map(hash_of, forms), np.uint64, len(forms))
                for part in sorted({p["part"] for p in parts}):
                    at = (h ^ np.uint64(xxhash.xxh64_intdigest(part, 42))) >> shift
                    hit = bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
                    some = np.flatnonzero(hit)
                    if some.size:
                        yield pd.DataFrame({"part": part, "form": [forms[i] for i in some]})

    held = scanned.filter(F.size("parts") > 0).select("text", "parts").mapInPandas(tidy(pairs), "part string, form string")
    return held.groupBy("part", "form").agg(F.count("*").alias("n")).join(wanted, ["part", "form"], "left_semi")


def term_counts(docs: DataFrame, wanted: DataFrame, log2_bits: int = LOG2_BITS) -> DataFrame:
    """``(form, n)``: different texts that hold each wanted form, counted over all of them.

    A bitmap of the wanted forms' hashes, of a fixed size, keeps most words from leaving the
    scan; each batch counts what is left, and a join drops what the bitmap let through.
    """
    bitmap = bits_of(wanted.select(F.xxhash64("form").alias("h")), "h", log2_bits)

    def count(frames):
        bits = np.frombuffer(bitmap, np.uint64)
        hits = Remembered()

        def in_set(form: str) -> bool:
            place = xxhash.xxh64_intdigest(form, 42) >> (64 - log2_bits)
            return bool(int(bits[place >> 6]) >> (place & 63) & 1)

        for frame in frames:
            seen: Counter[str] = Counter()
            for text in frame["text"]:
                forms = set()
                for word in set(WORD.findall(text.lower())):
                    got = hits.get(word)
                    if got is None:
                        both = ("w" + word, "s" + word[:STEM]) if len(word) >= STEM else ()
                        got = tuple(f for f in both if in_set(f))
                        hits.keep(word, got, sum(map(len, got)) + 100 * len(got))
                    if got:
                        forms.update(got)
                seen.update(forms)
            if seen:
                yield pd.DataFrame({"form": list(seen), "n": list(seen.values())})

    counted = distinct_texts(docs, tidy(count), "form string, n long")
    return counted.groupBy("form").agg(F.sum("n").alias("n")).join(wanted, "form", "left_semi")


def distinct_texts(docs: DataFrame, run=None, schema: str = "text_key long, text string") -> DataFrame:
    """``text_key`` and ``text`` of every text once; only texts that may have a copy are exchanged.

    ``run``, a function of batches of these, makes rows of ``schema`` instead. It looks at the
    texts in the pass that leaves the copies out: two Python steps in one task would hold two
    workers each, and those stay for all stages that follow.
    """
    rows = docs.select(text_key().alias("text_key"), text_or_empty().alias("text"))
    copied = rows.groupBy("text_key").agg(F.count("*").alias("n")).filter("n > 1")
    bitmap = bits_of(copied, "text_key", LOG2_BITS)

    def alone(frames):
        for frame in frames:
            yield frame[~in_bits(frame["text_key"].to_numpy(np.int64), bitmap, LOG2_BITS)]

    once = rows.filter(may_be_in(F.col("text_key"), bitmap, LOG2_BITS)).dropDuplicates(["text_key"])
    if run is None:
        return rows.mapInPandas(alone, schema).unionByName(once)
    return rows.mapInPandas(lambda frames: run(alone(frames)), schema).unionByName(once.mapInPandas(run, schema))


def disclosing(docs: DataFrame, scanned: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """``(entity, term, keep)``: terms that disclose an entity, and what may stay of them.

    Copies, documents of one text, are one document in every count.

    ``keep`` is the first letters where they disclose less than the threshold, else empty.
    """
    total = docs.agg(F.countDistinct(text_key()).alias("n")).head()["n"]
    scanned = settle(scanned.filter(F.size("parts") > 0).dropDuplicates(["text_key"]), "evidence")
    parts = scanned.select(F.explode("parts").alias("x")).select("x.*")
    n_e = parts.select("entity", "part").filter("entity = part").groupBy("entity").agg(F.count("*").alias("n_e"))
    per_doc = scanned.select(F.explode(F.array_distinct(F.transform("parts", lambda x: x["part"]))).alias("part"))
    n_g = per_doc.groupBy("part").agg(F.count("*").alias("n_g"))
    members = settle(parts.distinct().join(n_e, "entity").join(n_g, "part"), "members")
    # a group says no more of an entity than its own size allows
    info = lambda n: F.greatest(F.log(total / F.col(n)), F.lit(1e-9))
    of_use = members.filter(F.col("n_e") < total).filter(F.log(total / F.col("n_g")) / info("n_e") >= threshold)
    spells = F.col("part") == F.concat(F.lit("name:"), F.col("term"))
    near = scanned.select(F.explode("near").alias("x")).select("x.*").distinct()
    near = near.join(of_use.groupBy("part").agg(F.max("n_e").alias("most_e"), F.first("n_g").alias("n_g")), "part")
    near = settle(near.filter((F.col("n_g") > 1) | spells), "near")
    if not near.limit(1).count():
        return near.select(F.col("part").alias("entity"), "term", F.lit("").alias("keep"))
    wanted = near.select("part", F.explode(_forms(F.col("term"))).alias("form")).distinct()
    both = settle(together(scanned, wanted), "together")
    pairs = (
        near.withColumns({"stem": F.substring("term", 1, STEM), "w": _forms(F.col("term"))[0], "s": _forms(F.col("term"))[1]})
        .join(both.select("part", F.col("form").alias("w"), F.col("n").alias("both_w")), ["part", "w"])
        .join(both.select("part", F.col("form").alias("s"), F.col("n").alias("both_s")), ["part", "s"])
    )
    pairs = settle(pairs.filter((F.col("both_w") > 1) | spells), "pairs")
    if not pairs.limit(1).count():
        return pairs.select(F.col("part").alias("entity"), "term", F.lit("").alias("keep"))
    counts = settle(
        term_counts(docs, pairs.select(F.explode(F.array("w", "s")).alias("form")).distinct()), "term_counts"
    )

    def gain(k: str, n: str) -> Column:
        """Information on the group; of few documents, by the others' lower end."""
        k, n, g = F.col(k).cast("double"), F.col(n).cast("double"), F.col("n_g").cast("double")
        rest, m = k - 1, F.greatest(n - 1, F.lit(1.0))
        p = rest / m
        low = (p + Z * Z / (2 * m) - Z * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m))) / (1 + Z * Z / m)
        few = F.when(rest > 0, F.log(low * (total - 1) / F.greatest(g - 1, F.lit(1.0)))).otherwise(F.lit(float("-inf")))
        return F.when((k >= support) | spells, F.log(total * k / (n * g))).otherwise(few)

    scored = (
        pairs.join(counts.select(F.col("form").alias("w"), F.col("n").alias("n_w")), "w")
        .join(counts.select(F.col("form").alias("s"), F.col("n").alias("n_s")), "s")
        .select("part", "term", "stem", "most_e", gain("both_w", "n_w").alias("gain"), gain("both_s", "n_s").alias("gain_s"))
        .filter(F.col("gain") / info("most_e") >= threshold)
    )
    own = info("n_e")
    return (
        scored.join(of_use.select("part", "entity", "n_e"), "part")
        .filter(F.col("gain") / own >= threshold)
        .groupBy("entity", "term")
        .agg(F.min(F.when(F.col("gain_s") / own < threshold, F.col("stem")).otherwise("")).alias("keep"))
    )


def scan_documents(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """``doc_id``, ``text_key``, ``spans`` and ``terms``, one row a row of ``docs``.

    ``spans`` are the patterns' matches; ``terms`` the words to generalise or remove, with
    what may stay of each. Null texts are empty and have neither; other columns are not read.
    """
    rows = keyed(docs)
    found = rows.select("doc_id", "text_key", "text", scan_column(F.col("text")).alias("x")).select("doc_id", "text_key", "text", "x.*")
    # texts without an entity are not read again
    scanned = settle(found.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "scanned")
    flagged = disclosing(docs, scanned, threshold, support)
    scanned = scanned.withColumns({"i": F.coalesce("doc_id", F.lit(0)), "no": F.col("doc_id").isNull()})
    hit = (
        scanned.filter(F.size("parts") > 0)
        .select("i", "no", "text_key", F.explode("parts").alias("x"))
        .filter("x.entity = x.part")
        .select("i", "no", "text_key", "x.entity")
        .distinct()
        .join(flagged, "entity")
        # of two entities, the stricter answer holds
        .groupBy("i", "no", "text_key", "term")
        .agg(F.min("keep").alias("keep"))
        .groupBy("i", "no", "text_key")
        .agg(F.collect_list(F.struct("term", "keep")).alias("named"))
    )
    hit = settle(hit, "named")
    kind = "array<struct<start:int,end:int,keep:string>>"

    @F.pandas_udf(kind)
    def places(texts: pd.Series, spans: pd.Series, named: pd.Series) -> pd.Series:
        return pd.Series([occurrences(t, s, {x["term"]: x["keep"] for x in n}) for t, s, n in zip(texts, spans, named)], dtype=object)

    joined = scanned.join(hit, ["i", "no", "text_key"], "left")
    some = joined.filter("named is not null").select("doc_id", "text_key", "spans", places("text", "spans", "named").alias("terms"))
    return some.unionByName(
        joined.filter("named is null").select("doc_id", "text_key", "spans", F.array().cast(kind).alias("terms"))
    )


def occurrences(text: str, spans, keep: dict[str, str]) -> list[dict]:
    """Every place of the terms in a text, outside the patterns' spans."""
    covered = sorted((s["start"], s["end"]) for s in spans)
    out, i = [], 0
    for m in WORD.finditer(text):
        while i < len(covered) and covered[i][1] <= m.start():
            i += 1
        term = m[0].lower()
        if term in keep and (i == len(covered) or covered[i][0] >= m.end()):
            out.append({"start": m.start(), "end": m.end(), "keep": keep[term]})
    return out


def report(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the patterns' spans, and all spans as text."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    terms = F.transform(
        "terms", lambda t: F.struct(F.lit(TERM).alias("kind"), t["start"].alias("start"), t["end"].alias("end"))
    )
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(spans_text(spans), 256).alias("base_sha256"),
        spans_text(F.concat(spans, terms)).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def redact(text: str, spans, terms) -> str:
    """The text with ``<KIND>`` for each match and what may stay of each term."""
    edits = [(s["start"], -s["end"], f"<{s['kind'].upper()}>") for s in spans]
    edits += [(t["start"], -t["end"], t["keep"]) for t in terms]
    out, at = [], 0
    for start, end, new in sorted(edits):
        if start >= at:
            out += [text[at:start], new]
        elif -end <= at:
            continue
        at = max(at, -end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all rows and columns stay.

    A null text stays null. ``n_chars``, where there is one, follows the new text.
    """
    found = scan_documents(docs, threshold, support).filter("size(spans) > 0")
    one, none, key, spans, terms = on = fresh(docs.columns, "_id", "_none", "_key", "_spans", "_terms")
    edits = (
        found.groupBy(F.coalesce("doc_id", F.lit(0)).alias(one), F.col("doc_id").isNull().alias(none), F.col("text_key").alias(key))
        .agg(F.first("spans").alias(spans), F.first("terms").alias(terms))
    )

    @F.pandas_udf("string")
    def replace(texts: pd.Series, matched: pd.Series, named: pd.Series) -> pd.Series:
        return pd.Series([redact(t, s, n) for t, s, n in zip(texts, matched, named)], dtype=object)

    tagged = docs.withColumns({one: F.coalesce("doc_id", F.lit(0)), none: F.col("doc_id").isNull(), key: text_key()})
    joined = tagged.join(edits, on[:3], "left")
    changed = joined.filter(F.col(spans).isNotNull()).withColumn("text", replace("text", spans, terms))
    whole = joined.filter(F.col(spans).isNull()).unionByName(changed)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        whole = whole.withColumn(
            "n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return whole.select(*(F.col(f"`{c}`") for c in docs.columns))
