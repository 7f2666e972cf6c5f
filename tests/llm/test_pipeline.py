"""Each stage against a plain version on its own input; queries on whole tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from test_words_and_texts import PATH, brute_print, brute_spans
from tokenizers import Tokenizer

import corpus_pipeline
from countercheck.llm import queries
from countercheck.llm.support import stored

FOLDER = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def groups(prints):
    """Number of each row's group of fingerprints within two bits."""
    distinct = sorted(set(prints))
    root = list(range(len(distinct)))
    for i, a in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(np.array(distinct[:i], np.uint64) ^ np.uint64(a)) <= 2):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return [root[distinct.index(p)] for p in prints]


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and comes out of it, as rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), "test-stage"))
    assert all(x.columns == docs.columns for x in out[:-1])
    return [x.collect() for x in out]


def test_quality_stage(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    scored = {r["doc_id"]: r for r in queries.op4_quality(spark, FOLDER).collect()}
    kept = {r["doc_id"] for r in stages[1]}
    assert kept == {k for k, r in scored.items() if r["predicted"]} and set(stages[1]) <= set(stages[0])
    held = [k for k in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(scored[k]["held_out"] for k in held)
    assert np.mean([scored[k]["predicted"] == labels[k] for k in held]) > 0.97


def test_simhash_stage(stages):
    """Of a group within two bits, at most the first document stays; links by similarity may join groups."""
    rows = stages[1]
    group = groups([brute_print(r["text"]) for r in rows])
    first = {}
    for r, g in zip(rows, group, strict=True):
        first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
    assert {r["doc_id"] for r in stages[2]} <= set(first.values()) and set(stages[2]) <= set(rows)


def test_pii_stage(stages):
    before, after = ({r["doc_id"]: r for r in stages[i]} for i in (2, 3))
    assert set(before) == set(after)
    touched = 0
    for k, r in before.items():
        spans = sorted((a, -b, kind) for kind, a, b in brute_spans(r["text"]))
        text, end = "", 0
        for a, b, kind in spans:
            if a >= end:
                text += r["text"][end:a] + f"<{kind.upper()}>"
            end = max(end, -b)
        assert after[k]["text"] == text + r["text"][end:] and after[k]["n_chars"] == len(after[k]["text"])
        touched += bool(spans)
    assert touched


def test_mix_stage(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    copies = Counter(r["doc_id"] for r in stages[4])
    assert set(stages[4]) <= set(stages[3]) and max(copies.values()) <= 3
    total, taken = Counter(), Counter()
    for k, r in before.items():
        total[r["source"]] += len(r["text"].split())
        taken[r["source"]] += len(r["text"].split()) * copies[k]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    target, free, left = {}, set(total), sum(total.values())
    while over := [s for s in free if left / sum(weight[x] for x in free) * weight[s] > 3 * total[s]]:
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
            free.discard(s)
    target |= {s: left / sum(weight[x] for x in free) * weight[s] for s in free}
    far = {s: (taken[s], target[s], total[s]) for s in total if abs(taken[s] - target[s]) > max(2, 0.005 * target[s])}
    assert not far


def test_bpe_stage(stages):
    library = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    for r in stages[5]:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == sha(",".join(map(str, want))) and r["decoded_sha256"] == sha(texts[r["doc_id"]])


def test_nearest_recall(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    unit = np.array([r["embedding"] for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = {}
    for r in queries.op3_nearest(spark, FOLDER).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(got[ids[q]] & set(ids[np.argsort(-near)[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(got)


def test_passages_find_every_repeat(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs}
    seen = {}
    for k, w in words.items():
        for i in range(len(w) - 49):
            seen.setdefault(tuple(w[i : i + 50]), set()).add(k)
    spans = {}
    for r in queries.op10_passages(spark, FOLDER).collect():
        spans.setdefault(r["doc_id"], []).append((r["first"], r["stop"]))
    for k, w in words.items():
        for i in range(len(w) - 49):
            if len(seen[tuple(w[i : i + 50])]) > 1:
                assert any(a <= i and i + 50 <= b for a, b in spans.get(k, [])), (k, i)


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_copies_leave_the_corpus(stages):
    """By brute-force Jaccard: no two documents that go on are similar, and each that goes was like another."""
    rows = sorted(stages[1], key=lambda r: r["doc_id"])
    sets, holders = [shingles(r["text"]) for r in rows], {}
    edges, similar = [], 0
    for i, own in enumerate(sets):
        met = Counter(j for s in own for j in holders.get(s, ()))
        for j, common in met.items():
            if 5 * common >= 4 * (len(own) + len(sets[j]) - common):
                edges.append((j, i))
                similar += rows[i]["text"] != rows[j]["text"]
        for s in own:
            holders.setdefault(s, []).append(i)
    prints = np.array([brute_print(r["text"]) for r in rows], np.uint64)
    for i in range(len(rows)):
        edges += [(int(j), i) for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 2)]
    root = list(range(len(rows)))
    for _ in rows:
        before = list(root)
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    assert similar
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(rows[i]["doc_id"] for i in set(root))
