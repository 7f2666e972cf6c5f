"""Personal data: fixed patterns, and contexts learned from what they find.

The patterns' matches are seeds. Words around a seed make lexical patterns; other
tokens that look like identifiers and stand in the same patterns are instances
to be judged. Spark scores the graph of patterns and instances in rounds: a
pattern by the share of its instances that are known, an instance by the
patterns it stands in. Instances that score high are known in the next round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countercheck.functions.names import free_name
from countercheck.llm.support import put, small_batches, stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SEED = 42
SUPPORT = 5  # distinct known instances that a pattern needs
SURE = 0.8  # share of known instances from which a pattern counts as good
FOUND = "found"  # kind of a learned span is this and the kind of its pattern

# What the kinds look like.
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# A run of local characters is tried from its start only: the @ has to follow
# the run's end, so a later start fails or succeeds alike.
EMAIL = re.compile(rf"[{LOCAL}]++@[{LABEL}]+(?:\.[{LABEL}]+)+")
EMAIL_RUN = re.compile(rf"(?<![{LOCAL}])[{LOCAL}]++@[{LABEL}]+(?:\.[{LABEL}]+)+")
# A whole token that holds a digit or an @.
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
EDGE = ".,;:!?()[]{}<>\"'"
NEAR = 200  # characters beside a token in which its neighbouring words are looked for


def emails(text: str) -> Iterator[tuple[int, int]]:
    start = 0
    while text.find("@", start) >= 0:
        found = EMAIL.match(text, start) or EMAIL_RUN.search(text, start)
        if not found:
            return
        yield found.span()
        start = found.end()


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not any(d in text for d in "0123456789"):
        return out
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def _plain(word: str) -> str:
    """A context word, or nothing for signs alone: a bar or a dash tells nothing about its neighbours."""
    word = re.sub(r"\d", "0", word.strip(EDGE).lower())
    return word if any(c.isalnum() for c in word) else ""


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before; one before and one after."""
    before = text[max(0, start - NEAR) : start].split()[-2:]
    after = text[end : end + NEAR].split()[:1]
    before, after = [_plain(w) for w in before], [_plain(w) for w in after]
    out = []
    if len(before) == 2 and all(before):
        out.append(f"{before[0]} {before[1]} _")
    if before and after and before[-1] and after[0]:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens with at least three digits or an @ that touch no base span, without edge marks."""
    taken = sorted((a, b) for _, a, b in base)
    out, k = [], 0
    for m in TOKEN.finditer(text):
        word = m.group()
        if sum("0" <= c <= "9" for c in word) < 3 and "@" not in word:
            continue
        start = m.start() + len(word) - len(word.lstrip(EDGE))
        end = m.end() - (len(word) - len(word.rstrip(EDGE)))
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start < end and not any(a < end and start < b for a, b in taken[k : k + 4]):
            out.append((start, end))
    return out


def _id(value: str) -> int:
    return xxhash.xxh64_intdigest(value.encode()) - (1 << 63)


_SPANS = "array<struct<kind:string,start:int,stop:int>>"
_HITS = "array<struct<kind:string,start:int,stop:int,instance:long,pattern:long>>"
MARKED = re.compile(r"[0-9@]")
#: What every text with candidates holds, for Spark: an @, or three digits in a token.
LIKELY = r"@|[0-9](?:[^\x20\x09-\x0D0-9]*+[0-9]){2}"


def _read(texts: pa.Array) -> pa.Array:
    rows = []
    for value in texts:
        text = value.as_py() or ""
        if not MARKED.search(text):
            rows.append({"base": [], "hits": []})
            continue
        base = base_spans(text)
        hits = []
        for kind, a, b in [*base, *((None, a, b) for a, b in candidates(text, base))]:
            own = _id(text[a:b].lower())
            hits += [
                {"kind": kind, "start": a, "stop": b, "instance": own, "pattern": _id(p)}
                for p in contexts(text, a, b)
            ]
        rows.append({"base": [{"kind": k, "start": a, "stop": b} for k, a, b in base], "hits": hits})
    span = [("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]
    hit = [*span, ("instance", pa.int64()), ("pattern", pa.int64())]
    kind = pa.struct([("base", pa.list_(pa.struct(span))), ("hits", pa.list_(pa.struct(hit)))])
    return pa.array(rows, kind)


def _base(text: str | None) -> list[dict]:
    spans = base_spans(text) if text and MARKED.search(text) else []
    return [{"kind": k, "start": a, "stop": b} for k, a, b in spans]


def _read_base(texts: pa.Array) -> pa.Array:
    """Spans of the fixed patterns."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    return pa.array([_base(x.as_py()) for x in texts], pa.list_(span))


def good_patterns(hits: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """``pattern`` and ``kind`` of the patterns that find identifiers.

    ``hits`` has an occurrence a row: kind (null: unknown), instance, pattern.
    Each instance counts once per pattern. A pattern is good if at least
    ``support`` of its instances and a share of ``sure`` are known; an unknown
    instance becomes known when the mean of all its patterns' shares reaches
    ``sure``. A pattern's kind is that of most of its known instances, ties to
    the first by name.
    """
    edges = stored(
        hits.groupBy("pattern", "instance").agg(F.min("kind").alias("kind")).select("pattern", "instance", "kind"),
        "pii-edges",
    )
    n = edges.count()
    known = edges.filter("kind is not null").groupBy("instance").agg(F.min("kind").alias("known_kind"))
    known = stored(known, "pii-known", rows=n)
    for step in range(rounds):
        votes = edges.join(known, "instance", "left")
        patterns = votes.groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"), F.count("known_kind").alias("n_known"), F.mode("known_kind", True).alias("kind")
        )
        patterns = patterns.select("pattern", "kind", "n_known", (F.col("n_known") / F.col("n")).alias("share"))
        patterns = stored(patterns, "pii-patterns", rows=n)
        if step + 1 < rounds:
            told = patterns.filter(F.col("n_known") >= support).withColumnRenamed("kind", "told")
            scores = edges.select("pattern", "instance").join(told, "pattern").groupBy("instance")
            learned = scores.agg(F.avg("share").alias("share"), F.mode("told", True).alias("known_kind"))
            learned = learned.filter(F.col("share") >= sure).join(known, "instance", "left_anti")
            known = stored(known.unionByName(learned.select("instance", "known_kind")), "pii-known", rows=n)
    return patterns.filter((F.col("n_known") >= support) & (F.col("share") >= sure)).select("pattern", "kind")


def _learned(df: DataFrame, text: str, learned: str, **options) -> DataFrame:
    """Add ``learned``, the spans that learned patterns find, or null.

    Only what was found is stored, under two hashes of the text, on which its
    spans depend alone. Texts that may hold identifier-like tokens are joined
    with it, the others stay where they are.
    """
    small_batches(df.sparkSession)
    own = F.col(f"`{text}`")
    one, two = F.xxhash64(own).alias("one"), F.xxhash64(F.lit(SEED), own).alias("two")
    read = F.arrow_udf(_read, f"struct<base:{_SPANS},hits:{_HITS}>")
    # Stored before it is filtered: a filter on the result would have it computed twice, by two workers in a row.
    known = stored(df.filter(own.rlike("[0-9@]")).select(one, two, read(own)["hits"].alias("hits")), "pii-hits")
    hits = known.select("one", "two", F.explode("hits").alias("hit")).select("one", "two", "hit.*")
    good = stored(good_patterns(hits, **options), "pii-good")
    new = hits.filter("kind is null").drop("kind").join(good, "pattern")
    new = new.groupBy("one", "two", "start", "stop").agg(F.min("kind").alias("kind"))
    each = F.struct(F.concat(F.lit(f"{FOUND}_"), F.col("kind")).alias("kind"), "start", "stop")
    key1, key2 = (free_name(df.columns, f"pii {n}") for n in ("one", "two"))
    new = new.groupBy(F.col("one").alias(key1), F.col("two").alias(key2))
    new = stored(new.agg(F.sort_array(F.collect_list(each)).alias(learned)), "pii-found")
    likely = F.coalesce(own.rlike(LIKELY), F.lit(False))
    plain = put(df.filter(~likely), {learned: F.lit(None).cast(_SPANS)})
    rest = put(df.filter(likely), {key1: one, key2: two}).join(new, [key1, key2], "left").drop(key1, key2)
    return plain.unionByName(rest)


def find(
    df: DataFrame, text: str = "text", spans: str = "pii spans", base: str = "pii base", **options
) -> DataFrame:
    """Add ``spans``, all spans as kind, start and stop, and ``base``, those of the fixed patterns.

    Offsets are code points, the stop exclusive. Kinds are email, ip, card and
    phone, and for learned spans "found_" with the kind of the pattern that
    found them; spans stand by kind in that order, then start. A null or empty
    text has no spans, repeated rows stay, names that clash give way. Texts are
    read twice, once to learn and once for the result.
    """
    new = free_name([*df.columns, spans, base], "pii new")
    both = _learned(df, text, new, **options)
    both = put(both, {base: F.arrow_udf(_read_base, _SPANS)(F.col(f"`{text}`"))})
    found = F.concat(F.col(f"`{base}`"), F.coalesce(F.col(f"`{new}`"), F.array().cast(_SPANS)))
    return put(both, {spans: found}).drop(new)


def spans_text(spans: Column) -> Column:
    """kind:start:stop of the spans, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(one, ",")


def _mask(texts: pa.Array, learned: pa.Array) -> pa.Array:
    rows = zip(texts, learned, strict=True)
    return pa.array([mask(t := x.as_py(), _base(t) + (new.as_py() or [])) for x, new in rows], pa.string())


def mask(text: str | None, spans: list[dict] | None) -> str | None:
    """The text with each span replaced by its kind; spans that overlap by the first one's."""
    if not text or not spans:
        return text
    out, end = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
        if s["start"] >= end:
            out += [text[end : s["start"]], f"<{s['kind'].upper()}>"]
        end = max(end, s["stop"])
    return "".join([*out, text[end:]])


def redact(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The same rows and columns, with personal data in the text replaced by its kind: the spans of ``find``.

    Fixed patterns are searched where the text is masked, so a task has one worker.
    """
    new, clean = (free_name(df.columns, f"pii {n}") for n in ("new", "text"))
    found = _learned(df, text, new, **options)
    out = put(found, {clean: F.arrow_udf(_mask, "string")(F.col(f"`{text}`"), F.col(f"`{new}`"))})
    return out.select(*[F.col(clean).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
