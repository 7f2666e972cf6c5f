"""BPE, SimHash, PII, classifier and passages against brute force, with odd inputs."""

import random
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from countercheck.llm import bpe, passages, pii, quality, simhash
from countercheck.llm.components import components
from countercheck.sinks import storage

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, ids string, `pii base` int, extra int"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


def odd_texts():
    rnd = random.Random(1)
    signs = "ab' \n\t\x1c\x85\xa0é²Ⅷ١_-!?9 0'sll日本́‍\U0001f600 "
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    return [*texts, "", "a" * 3000, "<|endoftext|>x <|endoftext|>", "ab" * 400 + " " * 300, "x" * 64 + " " + "y" * 65]


def test_bpe_as_the_library(vocabulary):
    texts, library = odd_texts(), Tokenizer.from_file(PATH)
    wanted = library.encode_batch(texts, add_special_tokens=False)
    for text, ids, want in zip(texts, bpe.Encoder(vocabulary).encode(texts), wanted, strict=True):
        assert ids.tolist() == want.ids, repr(text)
        assert bpe.decode_ids(ids.tolist(), vocabulary.tokens) == library.decode(want.ids, skip_special_tokens=False)


def test_bpe_pieces_and_full_cache(vocabulary, monkeypatch):
    texts = ["".join(f"word{i} it's  {i}\n" for i in range(300)) * 2]
    whole = bpe.Encoder(vocabulary).encode(texts)[0].tolist()
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "CACHED", 10)
    assert bpe.Encoder(vocabulary).encode(texts)[0].tolist() == whole


def test_bpe_rows(spark):
    rows = [(1, None, "x", 0, 0), (2, "", "x", 0, 0), (None, "it's", "x", 0, 0), (None, "it's", "x", 0, 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = bpe.encode(df)
    assert sorted(len(r["ids"]) for r in out.collect()) == [0, 0, 2, 2]
    assert set(out.columns) == set(df.columns)
    back = bpe.decode(out).select("decoded")
    assert sorted(r[0] for r in back.collect()) == ["", "", "it's", "it's"]
    assert bpe.round_trip(df.limit(0)).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).first()["decoded"] is None


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in [*odd_texts()[:300], "One", "One Two", "Ä B c", "a b c d " * 40, " \n"]:
        assert simhash.fingerprint(text) == brute_print(text)


def test_code_covers_and_probes_find_all():
    code = simhash.Golay(2)
    assert len(code.patterns[0]) == 2048 and (np.diff(code.start[0]) == 1).all()
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    for bits in (0, 1, 2):
        other = prints.copy()
        for i in range(len(other)):
            for b in rng.choice(63, bits, replace=False):
                other[i] ^= np.int64(1) << np.int64(b)
        who, at = simhash.probes(other, code, 2)
        found = set(zip(who.tolist(), at.tolist(), strict=True))
        assert all((int(o), int(h)) in found for o, h in zip(other, simhash.homes(prints, code), strict=True))


def test_simhash_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    values = set(base.tolist()) | {int(b ^ np.int64(3) << np.int64(i % 60)) for i, b in enumerate(base)}
    values |= {int(base[0] ^ (np.int64(1) << np.int64(i))) for i in range(40)} | {0, 1, 7, -1}
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values] + [(None,)], "print long")).collect()}
    rows = sorted(values)
    want = {(a, b) for a in rows for b in rows if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert got == want


def test_simhash_documents(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text.upper()), (9, None), (8, " "), (None, text), (7, "other words in here"), (7, "other words in here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit("x"))
    out = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    assert sorted(out, key=str) == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (7, 7), (7, 7)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5), (300, 301), (301, 300)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 31)} | {(i, 100) for i in range(101, 160)} | {(301, 300)}


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            odd, even = digits[::-1][0::2], digits[::-1][1::2]
            luhn = (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10
            if kind == "card" and (not 16 <= len(digits) <= 19 or luhn):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii_patterns():
    rnd = random.Random(4)
    for signs in ("a1.@-% ", "12.0 5", "40 -12", "+1 (2)-.3a", "a@b.c1+2 é٣"):
        for _ in range(4000):
            text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))
            assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("4111 1111-1111 1111") == [("card", 0, 19)]
    assert pii.base_spans("a" * 200_000 + "1.." * 50_000) == []


def test_pii_learns_from_context(spark):
    rows = [(i, f"so write to user{i}@mail.example.com today {i}") for i in range(12)]
    rows += [(100, "so write to user777(at)mail today"), (101, "room 1234x is free"), (102, None), (103, ""), (100, "so write to user777(at)mail today")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pii new", F.lit(1))
    out = pii.find(df)
    got = {(r["doc_id"], tuple(tuple(s) for s in r["pii spans"])) for r in out.collect()}
    assert (100, (("found_email", 12, 27),)) in got
    assert {(101, ()), (102, ()), (103, ())} <= got and out.count() == len(rows)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[100] == "so write to <FOUND_EMAIL> today" and clean[3] == "so write to <EMAIL> today 3"
    assert clean[102] is None and pii.redact(df).columns == df.columns
    assert pii.find(df.limit(0)).count() == 0


def test_pii_takes_one_worker_a_task(spark):
    rnd = random.Random(6)
    for _ in range(4000):
        text = "".join(rnd.choice("12a.@-\t \u3000,(") for _ in range(rnd.randint(0, 16)))
        assert re.search(pii.LIKELY, text) or not pii.candidates(text, []), text
    rows = [(i, f"so write to user{i}@mail.example.com on {i}") for i in range(9)] + [(9, "to user777(at)mail on"), (10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for out in (pii.find(df), pii.redact(df)):  # two branches: texts that may hold more than the fixed patterns find, and others
        assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2


def test_quality(spark):
    rnd = random.Random(2)

    def text(good):
        return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) + ("" if good else "##") for _ in range(30))

    rows = [(i, text(i % 3 > 0), i % 3 > 0) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "x"), (400, None), (401, "")], "doc_id long, text string")
    labels = [(r[0], int(r[2])) for r in rows[:200]] + [(None, 0), (0, None), (1, 5), (9, int(rows[9][2]))]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality.train(docs, labels)
    assert (weights == quality.train(docs, labels)).all()
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs.withColumn("Score", F.lit(9)), weights).collect()}
    assert all((scores[r[0]] >= 0.5) == r[2] for r in rows) and 0 < scores[400] < 1 and scores[400] == scores[401]
    nothing = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}


def brute_windows(hashes, width):
    out, n = set(), len(hashes)
    for c in range(n):
        low = high = c
        while low > 0 and hashes[low - 1] > hashes[c]:
            low -= 1
        while high < n - 1 and hashes[high + 1] >= hashes[c]:
            high += 1
        if high - low + 1 >= width and hashes[c]:
            out.add((low, c, high))
    return out


def test_compact_windows():
    rng = np.random.default_rng(8)
    for n, top in ((3, 9), (40, 5), (200, 1 << 40), (200, 30)):
        for width in (1, 4, 7):
            hashes = rng.integers(1, top, n).astype(np.uint64)
            hashes[rng.integers(0, n, 2)] = 0
            got = set(zip(*(x.tolist() for x in passages.compact_windows(hashes, width)), strict=True))
            assert got == brute_windows(hashes.tolist(), width)


def test_tokens_of_pieces_and_groups():
    rnd = random.Random(3)
    parts = ["a", "B", "é ", " ", "\n", "c" * 200]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(300))) for _ in range(60)] + [None, "", "x" * 500]
    small = passages.Tokens()
    small.PIECE = 64  # texts are cut, and words are longer than a piece
    by_words: dict = {}
    for text, own, whole in zip(texts, small.each(texts), passages.Tokens().each(texts), strict=True):
        words = (text or "").encode().lower().split()
        assert own.tolist() == whole.tolist() and len(own) == max(0, len(words) - 4)
        for k, token in enumerate(own.tolist()):
            assert by_words.setdefault(tuple(words[k : k + 5]), token) == token
    assert len(set(by_words.values())) == len(by_words)


def test_passages(spark):
    rnd = random.Random(6)

    def words(n):
        return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]

    shared, near, line = words(52), words(120), words(12)
    edited = near[:60] + ["changed"] + near[61:]
    inserted = near[:30] + ["more"] + near[30:]
    texts = {
        1: words(80) + shared + words(30), 2: shared + words(200), 3: words(7) + near, 4: edited + words(60), 5: words(90) + inserted,
        6: words(300), 7: words(48), 8: [w.upper() for w in shared],
    } | {20 + i: words(60) + line + words(60) for i in range(40)} | {70: words(60), 71: ["same"] * 500}
    rows = [(k, " ".join(t)) for k, t in texts.items()] + [(72, None), (73, ""), (7, " ".join(texts[7]))]
    out = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"]: r for r in out}
    assert set(found) == {1, 2, 3, 4, 5, 8} and len(out) == 6
    assert (found[1]["first"], found[1]["stop"]) == (80, 132) and (found[8]["first"], found[8]["stop"]) == (0, 52)
    assert found[3]["first"] <= 8 and found[3]["stop"] >= 126
    assert {found[k]["class_key"] for k in (1, 2, 8)} == {1} and {found[k]["class_key"] for k in (3, 4, 5)} == {3}
    assert [k for k in sorted(found) if found[k]["kept"]] == [1, 3]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert passages.near_duplicate_passages(empty).count() == 0


def test_matches_with_insertions_on_either_side():
    rng = np.random.default_rng(11)
    for own, more in ((72, 8), (80, 7), (50, 5), (120, 12), (120, 15)):
        for at in range(5, own - 5, 6):
            a = rng.integers(1, 1 << 40, own)
            b = np.concatenate([a[: at - 4], rng.integers(1, 1 << 40, more + 4), a[at:]])
            similar = len({*a.tolist()} & {*b.tolist()}) >= 0.8 * len({*a.tolist()} | {*b.tolist()})
            noise = [rng.integers(1, 1 << 40, 30) for _ in range(4)]
            one, two = (np.concatenate([noise[k], x, noise[k + 1]]) for k, x in ((0, a), (2, b)))
            for x, y, size in ((one, two, len(a)), (two, one, len(b))):
                got = passages.matches(x, y, 36, 0.8)
                if similar:
                    assert any(i <= 30 and j >= 30 + size for i, j, _, _ in got), (own, more, at)
                for i, j, p, q in got:
                    s, t = set(x[i:j].tolist()), set(y[p:q].tolist())
                    assert j - i >= 36 and q - p >= 36 and len(s & t) >= 0.8 * len(s | t)


def test_finer_signatures_reach_explained_texts(spark):
    """A chance leader, two copies explained by each other, and a fourth text that holds a passage of them."""
    rnd = random.Random(21)
    lines = [" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30)) for _ in range(300)]

    def texts(k):
        words = [["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)] for n in (60, 25, 25, 60, 60, 60, 60)]
        passage = words[1] + lines[k].split() + words[2]  # 80 words around a line
        x = " ".join(words[0] + passage + words[3])
        return {"leader": " ".join(words[4] + lines[k].split() + words[5]), "x": x, "copy": x, "e": " ".join(passage + words[6])}

    rows, roles = [], {}
    for k in range(300):
        for role, text in texts(k).items():
            roles[len(rows)] = (k, role)
            rows.append((len(rows), text))
    out = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {roles[r["doc_id"]]: r for r in out}
    assert all((k, role) in found for k in range(300) for role in ("x", "copy", "e"))
    for k in range(300):
        assert len({found[k, role]["class_key"] for role in ("x", "copy", "e")}) == 1


def test_longest_stretch_is_that_of_brute_force():
    rng = np.random.default_rng(5)
    for density in (0.8, 8 / 9, 1.0):
        for _ in range(150):
            hit = rng.random(int(rng.integers(1, 60))) < rng.choice([0.0, 0.1, 0.5, 0.85, 1.0])
            sums = np.concatenate([[0], np.cumsum(hit)])
            fits = [
                (i, j) for i in range(len(hit)) for j in range(i, len(hit) + 1) if sums[j] - sums[i] >= density * (j - i) - 1e-9
            ]
            assert passages._longest(hit, density) == max(fits, key=lambda x: (x[1] - x[0], -x[0]))


def test_passages_leave_only_their_result_and_no_shuffle_files(spark):
    shared = Path(storage.shared_folder(spark))
    before = set(shared.iterdir())
    conf = spark.conf.get(storage.CLEANUP)
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*words[k : k + 90], f"own{k}"])) for k in (0, 0, 20, 40)]
    files = list_shuffles(spark)
    out = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before if p.name.startswith("passage")} == {"passage-classes"}
    assert list_shuffles(spark) <= files
    assert spark.conf.get(storage.CLEANUP) == conf
    assert {r.doc_id for r in out.collect()} == {0, 20, 40}


def list_shuffles(spark):
    """Files of shuffled rows that Spark still holds."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (blocks.apply(i).getName() for i in range(blocks.size()))
    return {n for n in names if n.startswith("shuffle") and n.endswith(".data")}


def test_recall_of_lone_near_passages(spark):
    """Passages of 50 words with Jaccard 0.8 to 0.9 by brute force, by a changed word or by inserted ones."""
    rnd = random.Random(33)

    def words(n):
        return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]

    def tokens(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rows, wanted = [], []
    for k in range(300):
        passage, at = words(50), rnd.randrange(6, 44)
        other = passage[:at] + words(1 + k % 3) + passage[at + k % 2 :]
        similarity = len(tokens(passage) & tokens(other)) / len(tokens(passage) | tokens(other))
        if 0.8 <= similarity <= 0.9:
            wanted += [2 * k, 2 * k + 1]
        rows += [(2 * k, " ".join(words(60) + passage + words(60))), (2 * k + 1, " ".join(words(90) + other + words(30)))]
    out = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"] for r in out.collect()}
    share = len(found & set(wanted)) / len(wanted)
    print("recall", share, "of", len(wanted))
    assert len(wanted) > 200 and share >= 0.98


def test_signs_are_no_context():
    text = "| 4111111111111112 | card - 5 now"
    assert pii.contexts(text, 2, 18) == []
    assert pii.contexts("my card 4111 now", 8, 12) == ["my card _", "card _ now"]
    assert pii.contexts("pay | 4111 now", 6, 10) == []


def test_table_cells_teach_nothing(spark):
    """Bars around many cards are no pattern for other numbers between bars."""
    cards = ["4111 1111-1111 1111", "4012888888881881", "5555555555554444", "4222222222222220", "378282246310005", "4000056655665556", "5105105105105100"]
    rows = [(i, f"x | {c} | y") for i, c in enumerate(cards)] + [(50, "x | 1234567890123456 | y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert not [s for r in pii.find(df).collect() for s in r["pii spans"] if s["kind"].startswith(pii.FOUND)]


def plain_patterns(hits, rounds, support, sure):
    edges = {}
    for kind, instance, pattern in hits:
        old = edges.get((pattern, instance))
        edges[pattern, instance] = min(filter(None, (old, kind)), default=None)
    known = {}
    for (_, instance), kind in edges.items():
        if kind:
            known[instance] = min(known.get(instance, kind), kind)
    for step in range(rounds):
        patterns = {}
        for pattern in {p for p, _ in edges}:
            own = [i for p, i in edges if p == pattern]
            kinds = [known[i] for i in own if i in known]
            top = min(set(kinds), key=lambda k: (-kinds.count(k), k), default=None)
            patterns[pattern] = (len(kinds), len(kinds) / len(own), top)
        if step + 1 == rounds:
            return {(p, k) for p, (n, share, k) in patterns.items() if n >= support and share >= sure}
        learned = {}
        for instance in {i for _, i in edges} - set(known):
            told = [patterns[p][1:] for p, i in edges if i == instance and patterns[p][0] >= support]
            if told and sum(s for s, _ in told) / len(told) >= sure:
                kinds = [k for _, k in told]
                learned[instance] = min(set(kinds), key=lambda k: (-kinds.count(k), k))
        known |= learned


def test_pattern_scores(spark):
    rnd = random.Random(8)
    for trial in range(3):
        kinds = {i: rnd.choice(["card", "phone"]) if rnd.random() < 0.7 else None for i in range(60)}
        hits = [(kinds[i], i, p) for p in range(12) for i in rnd.sample(range(60), rnd.randint(1, 15))]
        hits += rnd.sample(hits, 10)
        got = pii.good_patterns(spark.createDataFrame(hits, "kind string, instance long, pattern long"), 3, 3, 0.6)
        assert {tuple(r) for r in got.collect()} == plain_patterns(hits, 3, 3, 0.6), trial


def plain_ftrl(rows, epochs):
    """Follow the regularised leader, one weight at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        rate = (quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2
        return ((1 if z[i] > 0 else -1) * quality.L1 - z[i]) / rate

    for _ in range(epochs):
        for features, label in rows:
            own = {i: weight(i) for i in features}
            guess = 1 / (1 + np.exp(-sum(own[i] * v for i, v in features.items())))
            for i, v in features.items():
                step = (guess - label) * v
                old = n.get(i, 0.0)
                n[i] = old + step * step
                z[i] = z.get(i, 0.0) + step - (n[i] ** 0.5 - old**0.5) / quality.ALPHA * own[i]
    return {i: w for i in z if (w := weight(i))}


def plain_features(text):
    found = {quality.BIAS: 1.0}
    for reading in quality.Features().readings(text):
        for i in reading.tolist():
            found[i] = found.get(i, 0.0) + quality.SCALE / len(reading)
    return found


def test_classifier_as_a_scalar_loop(spark, monkeypatch):
    monkeypatch.setattr(quality, "WORKERS", 1)
    rnd = random.Random(6)
    pool = [["good words in order here", "fine text again and more", "plain words"], ["$$ JUNK 99", "x1 x1 x1 junk", "|| 77 ##"]]
    texts = [(i, " ".join(rnd.choices(pool[i % 2], k=rnd.randint(1, 6))), i % 2) for i in range(40)]
    docs = spark.createDataFrame([t[:2] for t in texts] + [(90, None), (91, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    order = docs.join(labels, "doc_id").select("text", "quality", F.xxhash64("doc_id", F.lit(1)).alias("o")).orderBy("o").collect()
    want = plain_ftrl([(plain_features(r["text"]), r["quality"]) for r in order], quality.EPOCHS)
    assert set(np.flatnonzero(weights).tolist()) == set(want)
    assert all(abs(weights[i] - w) < 1e-9 for i, w in want.items())
    for r in quality.score(docs, weights).collect():
        total = sum(want.get(i, 0.0) * v for i, v in plain_features(r["text"] or "").items())
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_passage_candidates_are_long_enough(spark):
    rows = [(1, 7, 0, 20, 50, 1), (2, 7, 10, 30, 60, 1), (1, 8, 0, 5, 9, 1), (3, 8, 100, 105, 160, 1)]
    shared = spark.createDataFrame(rows, "doc long, signature long, first int, centre int, last int, leader long")
    found = passages._candidates(shared, 36).collect()
    assert {(r["a"], r["b"], r["low"], r["high"]) for r in found} == {(2, 1, 10, 60)}  # 3 shares ten tokens with 1
    tokens = np.arange(5, dtype=np.int32) - 2
    df = spark.createDataFrame([(k, n, tokens.tobytes()) for k in range(6) for n in range(7)], "k int, n int, tokens binary")
    for r in df.select("k", "n", passages._stretch(F.col("k"), F.col("n")).alias("part")).toArrow().to_batches():
        for k, n, part in zip(r["k"].to_pylist(), r["n"].to_pylist(), passages._lists(r["part"]), strict=True):
            assert part.tolist() == tokens[k : k + n].tolist()


def test_passages_store_neither_windows_nor_token_lists(spark, monkeypatch):
    """They outweigh what comes of them; token lists go through one shuffle that both joins read."""
    labels, plans = [], []
    stored = passages.stored

    def watched(df, label, *more):
        labels.append(label)
        if label == "passage-links":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label, *more)

    monkeypatch.setattr(passages, "stored", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = [f"w{i}" for i in range(3000)]
        swapped = [f"own{i}" for i in range(70)] + words[2900:2990] + [f"more{i}" for i in range(900)] + words[10:90]
        rows = [(1, " ".join(words)), (2, " ".join(swapped)), (3, " ".join(words[500:600]))]
        out = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string"))
        spans = {(r["doc_id"], r["first"], r["stop"], r["class_first"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spans == {
        (1, 10, 90, 10), (1, 500, 600, 500), (1, 2900, 2990, 2900), (2, 70, 160, 2900), (2, 1060, 1140, 10), (3, 0, 100, 500)
    }
    assert not {"passage-windows", "passage-fine", "passage-tokens"} & set(labels)
    assert len(plans) == 2 and all("ReusedExchange" in plan for plan in plans)


def test_stretches_are_sent_once_a_pair(spark):
    rows = [(1, 2, 100, 180, 0, 3), (1, 2, 150, 260, 5, 9), (1, 3, 0, 40, 0, 0), (1, 3, 9000, 9040, 0, 0), (4, 2, 10, 60, -5, -5)]
    sent = passages._sent(spark.createDataFrame(rows, "a long, b long, low int, high int, shift int, most int")).collect()
    got = {(r["a"], r["b"], r["start"], r["stop"], tuple(sorted(p["low"] for p in r["parts"]))) for r in sent}
    assert got == {
        (1, 2, 65, 288, (100, 150)),  # one stretch for both
        (1, 3, 0, 73, (0,)), (1, 3, 8968, 9073, (9000,)),  # what lies between isn't sent
        (4, 2, 0, 98, (10,)),
    }


def test_filter_of_signatures_grows_with_them(spark):
    assert passages._filter_size(0, 32) == passages._filter_size(17_926, 32) == 1 << 22
    for keys in (1 << 20, 5_000_000):
        assert 32 * keys <= passages._filter_size(keys, 32) < 64 * keys
    assert passages._filter_size(1 << 40, 32) == 1 << passages.MOST_BITS
    rng = np.random.default_rng(4)
    keys, others = rng.integers(-(1 << 63), 1 << 63, (2, 3000))
    for size in (1 << 16, 1 << 24):
        packed = passages._marked(spark.createDataFrame([(int(k),) for k in keys], "k long"), size).value
        assert len(packed) == size // 8 and passages._passes(packed, keys).all()
        assert set(np.flatnonzero(np.unpackbits(packed))) == set((keys % size).tolist())
        assert passages._passes(packed, others).mean() < 2 * len(keys) / size + 0.001


def test_windows_of_one_text_alone_stay_in_their_task(spark):
    rnd = random.Random(12)

    def words(n):
        return [f"w{rnd.randrange(1 << 40)}" for _ in range(n)]

    line = words(60)
    rows = [(k, " ".join(words(400) + (line if k < 3 else []))) for k in range(40)]
    texts = spark.createDataFrame(rows, "doc long, text string")
    searched = []

    def search(several):
        searched.append((several, passages._windows(46, 4, several)))
        return searched[-1][1]

    shared = passages._shared(texts, search, "passage-shared")
    kept = texts.mapInArrow(searched[1][1], passages._WINDOWS)
    every = texts.mapInArrow(searched[0][1], passages._WINDOWS)
    assert searched[0][0] is None and every.count() > 40 * 4 * 8
    assert shared.count() <= kept.count() <= shared.count() + 5
    by = every.groupBy("signature").agg(F.countDistinct("doc").alias("n"), F.min("doc").alias("leader")).filter("n > 1").drop("n")
    assert sorted(every.join(by, "signature").collect()) == sorted(shared.select("signature", *every.columns[:1], "first", "centre", "last", "leader").collect())
    assert {r["doc"] for r in shared.collect()} == {0, 1, 2}
