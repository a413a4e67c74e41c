"""Every operator against a brute-force version, on texts with nulls, empties, ties, copies and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexaline.llm import bpe, chat, decontaminate, licenses, near_copies, pii, queries, secrets, simhash, sketches, substrings, toxicity

SCHEMA = "doc_id long, text string, fp string, component_id string, spans string, id long, h long"


def table(spark, rows):
    """Documents with further columns, whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, 2) for i, t in rows], SCHEMA).repartition(3)


def words(r, n, alphabet="abcdefgé"):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 6))) for _ in range(n))


def texts(seed=5, n=90):
    r = random.Random(seed)
    base = [words(r, r.randint(1, 220)) for _ in range(20)]
    out = []
    for _ in range(n):
        b, k = r.choice(base), r.random()
        if k < 0.25:
            t = b
        elif k < 0.6:
            w = b.split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = words(r, 1)
            t = " ".join(w)
        elif k < 0.75:
            p = r.randrange(len(b))
            t = words(r, 20) + b[p : p + r.randint(80, 250)] + words(r, 20)
        elif k < 0.85:
            t = "ab" * r.randint(10, 200) + words(r, 3)
        else:
            t = words(r, r.randint(0, 100))
        out.append(t)
    return out


def documents():
    rows = [(3 * i, t) for i, t in enumerate(texts())]
    return rows + [(1000, None), (1001, ""), (1002, "x" * 99), (1003, "x" * 100), (1004, "x" * 101), (1005, "x" * 300), (1006, " \n\t "), (1007, "long " * 30000)]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- SimHash


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def slow_components(rows):
    fps = {}
    for i, t in rows:
        fps.setdefault(slow_fingerprint(t), []).append(i)
    left, root = set(fps), {}
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            part.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            todo += near
        least = min((i for f in part for i in fps[f] if i is not None), default=None)
        root |= dict.fromkeys(part, least)
    return root


def test_masks_miss_any_three_positions_together():
    r = random.Random(1)
    for level in simhash.mask_levels(3):
        assert len(level) in (15, 225, 3375)
    first, second = simhash.mask_levels(3, 2)
    for _ in range(300):
        x = sum(1 << p for p in r.sample(range(64), 3))
        hit = [t for t, m in enumerate(first) if not m & x]
        assert hit and all(any(not second[15 * t + j] & x for j in range(15)) for t in hit)
    assert max(64 - m.bit_count() for m in simhash.mask_levels(3)[2]) <= 8


def test_near_groups(spark):
    rows = documents() + [(None, "null id"), (7, "null id"), (8, "null id")] * 2 + [(None, "only nulls here")]
    got = simhash.near_groups(table(spark, rows))
    root = slow_components(rows)
    want = [(i, slow_fingerprint(t), root[slow_fingerprint(t)]) for i, t in rows]
    assert collected(got.select("doc_id", "fp", "component_id")) == sorted(((i, simhash._signed(f), c) for i, f, c in want), key=str)
    assert len({c for _, _, c in want}) < len(want)


def test_crowded_buckets_lose_no_link(spark):
    r = random.Random(2)
    fps, center = set(), r.getrandbits(64)
    while len(fps) < 400:
        x = r.choice(list(fps)) if fps and r.random() < 0.8 else center
        for p in r.sample(range(64), r.randint(1, 4)):
            x ^= 1 << p
        fps.add(x)
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"), max_bucket=4).collect()
    parent = {simhash._signed(f): simhash._signed(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() < 64
        parent[find(a)] = find(b)
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 3:
                assert find(simhash._signed(x)) == find(simhash._signed(y))


def test_keep_one_per_group(spark):
    rows = documents() + [(5000, "twice"), (5000, "twice"), (None, "of null id"), (None, "another of null id with more words")]
    kept = simhash.keep_one_per_group(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    root = slow_components(rows)
    want = {(root[slow_fingerprint(t)]) for _, t in rows} - {None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


# ---- near copies


def slow_copies(rows):
    """Root of each row's shingle set, by comparing all pairs of different sets."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), []).append(i)
    left, root = list(sets), {}
    while left:
        part, todo = [], [left.pop()]
        while todo:
            x = todo.pop()
            part.append(x)
            near = [y for y in left if len(x & y) >= 0.8 * len(x | y)]
            left = [y for y in left if y not in near]
            todo += near
        least = min((i for s in part for i in sets[s] if i is not None), default=None)
        root |= {i: least for s in part for i in sets[s]}
    return root


@pytest.mark.parametrize("bucket", [200_000, 300])
def test_near_copies(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_copies, "BUCKET_SHINGLES", bucket)
    r = random.Random(12)
    base = words(r, 60).split(" ")
    edited = [(2000 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(0, 60, 2)]
    rows = documents() + edited + [(3000, "twice"), (3000, "twice"), (None, "of null id"), (None, "another of null id with more words")]
    want = slow_copies(rows)
    got = near_copies.near_groups(table(spark, rows)).collect()
    assert len(got) == len(rows) and {(g["doc_id"], g["component_id"]) for g in got} == {(i, want[i]) for i, _ in rows}


def test_pipeline_drops_edited_copies(spark):
    import corpus_pipeline

    base = words(random.Random(13), 200).split(" ")
    edited = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (20, 100, 180)]
    docs = table(spark, list(enumerate([" ".join(base), *edited, words(random.Random(14), 200)])))
    assert [x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs, "").orderBy("doc_id").collect()] == [0, 4]


def test_wide_fingerprint_starts_with_the_plain_one():
    text = words(random.Random(15), 700)
    assert len(set(text.split())) > 4
    s = near_copies.shingle_set(text)
    wide = simhash.wide_fingerprint(s)
    for number, bits in enumerate(wide.tolist()):
        hashes = s if not number else s * simhash._MIX[number - 1]
        if number:
            hashes = (hashes ^ hashes >> np.uint64(32)) * simhash._MIX[::-1][number - 1]
            hashes ^= hashes >> np.uint64(29)
        ones = [sum(h >> b & 1 for h in hashes.tolist()) for b in range(64)]
        assert bits == sum(1 << b for b in range(64) if 2 * ones[b] > len(s))
    assert not simhash.wide_fingerprint(s[:0]).any()


@pytest.mark.parametrize("crowd", [4096, 20])
def test_wide_groups_hold_every_pair_near_in_a_word(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "AT_ONCE", 8)
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(16)
    base = [r.getrandbits(64) for _ in range(simhash.WIDE)]
    wide = []
    for _ in range(150):  # most in one crowd, with negative numbers
        w = [x ^ sum(1 << p for p in r.sample(range(64), r.randint(0, 5))) for x in base] if r.random() < 0.8 else [r.getrandbits(64) for _ in base]
        wide.append([simhash._signed(x) for x in w])
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    word = lambda w, k: (w[k // 2] >> 32 * (k % 2)) & 0xFFFFFFFF
    root = [k // 3 for k in range(150)]
    df = spark.createDataFrame([(k, root[k], w) for k, w in enumerate(wide)], "fp long, root long, wide array<long>")
    groups = {}
    for g, fp in simhash.wide_groups(df, range(1, 4)).collect():
        groups.setdefault(g, set()).add(fp)
    pairs = 0
    for a in range(150):
        for b in range(a):
            near = sum(bits(wide[a][i], wide[b][i]) for i in (0, 1)) <= simhash.CANDIDATE_BITS
            if root[a] != root[b] and near and any((word(wide[a], k) ^ word(wide[b], k)).bit_count() <= 3 for k in range(1, 4)):
                pairs += 1
                assert any({a, b} <= g for g in groups.values())
    assert pairs > 1000


def test_groups_go_on_in_the_next_batch():
    r = np.random.default_rng(17)
    key = np.sort(r.integers(0, 40, 300))
    w = r.integers(-(2**62), 2**62, 40)[key]
    rows = {"key": key, "fp": r.permutation(300), "root": np.arange(300), "w0": w, "w1": w}
    want = {tuple(sorted(rows["fp"][key == k].tolist())) for k in set(key.tolist()) if (key == k).sum() > 1}
    for size in (1, 7, 300):
        found = {}
        for batch in simhash._grouped(iter(pa.table(rows).combine_chunks().to_batches(max_chunksize=size))):
            for g, fp in zip(batch.column("g").to_pylist(), batch.column("fp").to_pylist()):
                found.setdefault(g, []).append(fp)
        assert {tuple(f) for f in found.values()} == want


def test_groups_end_at_texts_that_differ_beyond_two_numbers(monkeypatch):
    r = np.random.default_rng(21)
    for crowd in (4096, 80):  # 100 texts with one key, all near in two numbers and 50 of them in the others
        monkeypatch.setattr(simhash, "CROWD", crowd)
        numbers = r.integers(-(2**63), 2**63, (simhash.CHECKED, 100))
        for k in range(100):
            numbers[:2, k] = numbers[:2, 0] ^ np.array([sum(1 << int(p) for p in r.permutation(63)[:10]) for _ in range(2)])
        numbers[2:, 50:] = numbers[2:, 50:51] ^ 1 << r.integers(0, 60, (simhash.CHECKED - 2, 50))
        groups = simhash.bucket_groups(np.zeros(100, np.int64), np.arange(100), np.arange(100), *numbers)
        assert [g.tolist() for g in groups] == [list(range(50, 100))]


def test_each_set_is_compared_in_one_class(spark, monkeypatch):
    r = random.Random(20)
    base = words(r, 200).split(" ")
    rows = []
    for k in range(60):  # most pairs share buckets and are not similar
        w = list(base)
        for at in r.sample(range(0, 200, 10), 5):
            w[at] = f"new{k}x{at}"
        rows.append((k, " ".join(w)))
    seen = []

    def spied(members, sets, similarity, edges=near_copies._edges):
        seen.append((members.count(), members.select("fp").distinct().count(), sets.count()))
        return edges(members, sets, similarity)

    monkeypatch.setattr(near_copies, "_edges", spied)
    want = slow_copies(rows)
    got = near_copies.near_groups(table(spark, rows)).collect()
    assert {(g["doc_id"], g["component_id"]) for g in got} == {(i, want[i]) for i, _ in rows}
    (moved, texts_, sets_), *more = seen
    assert not more and moved == texts_ == sets_ > 50


def test_near_copies_at_the_least_similarity(spark):
    # each pair shares 8 of 9 parts of its shingles: a similarity of 0.8, some 97 of 640 bits
    r = random.Random(18)
    rows = []
    for k in range(300):
        base = words(r, 94).split(" ")
        rows += [(2 * k, " ".join(f"{w}{k}" for w in base)), (2 * k + 1, " ".join([*(f"{w}{k}" for w in base[:-10]), *(f"new{k}x{i}" for i in range(10))]))]
    sets = [near_copies.shingle_set(t) for _, t in rows]
    assert all(len(np.intersect1d(a, b)) == 80 and len(a) == len(b) == 90 for a, b in zip(sets[::2], sets[1::2]))
    assert sorted(x["component_id"] for x in near_copies.near_groups(table(spark, rows)).collect()) == sorted([2 * k for k in range(300)] * 2)


def test_the_stage_searches_simhash(spark, monkeypatch):
    import corpus_pipeline

    base = words(random.Random(13), 200).split(" ")
    docs = table(spark, [(0, " ".join(base)), (1, " ".join([*base[:20], "changed", *base[21:]]))])
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 1
    monkeypatch.setattr(near_copies, "wide_groups", lambda fps, words: fps.selectExpr("fp as g", "fp").where("false"))
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 2


# ---- licenses


def slow_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    lines = ["CC BY cc-by", "All  Rights\nReserved.", "GNU General Public License, version 3", "acc by", "cc byé", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: MIT", "released into the public domain", "ccby İ K", "\0cc\0by"]
    r = random.Random(3)
    rows = documents() + [(2000 + i, " ".join(r.choices(lines + ["word", "é", "--"], k=r.randint(1, 12)))) for i in range(60)] + [(2100, "cc by " * 500), (None, "cc by")]
    got = licenses.scan(table(spark, rows)).collect()
    assert collected(spark.createDataFrame(got).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(((i, *slow_places(t)) for i, t in rows), key=str)
    by = {g["doc_id"]: g for g in got}
    assert all(set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1 for g in got)
    assert by[1001]["labels"] == "" and by[1001]["score"] == 0


@pytest.mark.parametrize("text,labels", [("Licensed under the Apache License, Version 2.0.", "apache"), ("SPDX-License-Identifier: MIT", "mit"), ("under the terms of the GNU Lesser General Public License v2.1 or later", "gpl,lgpl"), ("the GNU General Public License version 3", "gpl"), ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa"), ("copyright 2020 someone", "copyright"), ("an apache helicopter", "")])
def test_license_labels(spark, text, labels):
    assert licenses.scan(table(spark, [(1, text)])).first()["labels"] == labels


def test_name_and_version_alone(spark):
    texts = {"Apache 2.0": "apache", "GPL version 3": "gpl", "MPL 2.0": "mpl", "CC0 1.0": "cc0", "submitted 2.0": ""}
    got = {x["doc_id"]: (x["labels"], x["n_detections"]) for x in licenses.scan(table(spark, list(enumerate(texts)))).collect()}
    assert got == {i: (label, int(label != "")) for i, label in enumerate(texts.values())}


def slow_detections(text):
    """(labels, weight, n) by trying every rule without its keyword and comparing all pairs of detections."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined = " " + " ".join(w) + " "
    found = [(m.start(), m.end(), rule["priority"], nth, rule) for nth, rule in enumerate(licenses.rules()) for m in re.finditer(rule["regex"], joined)]

    def hidden(d):
        return any(o[0] <= d[0] and o[1] >= d[1] and o[2] <= d[2] and o[:4] != d[:4] and ((o[0], o[1]) != (d[0], d[1]) or (o[2], o[3]) < (d[2], d[3])) for o in found)

    kept = [d for d in found if not hidden(d)]
    return {d[4]["label"] for d in kept}, max((d[4]["weight"] for d in kept), default=0.0), len(kept)


def rule_example(regex):
    """A text that the rule matches: options left out, the first of alternatives taken."""
    s = re.sub(r"^\(\?<= \)|\(\?= \)$", "", regex)
    s = s.replace("[sc]", "c").replace("[sz]", "z")
    s = re.sub(r"\[\^ \]\+", "word", s)
    s = re.sub(r"\[([0-9bm])[^\]]*\]\{4\}", "2020", s)
    s = re.sub(r"\[(.)[^\]]*\]\+?", r"\1", s)
    while (new := re.sub(r"\(\?:([^()]*)\)(\?|\*|\{0,8\})", "", s, count=1)) != s or (new := re.sub(r"\(\?:([^()|]*)(\|[^()]*)?\)", r"\1", s, count=1)) != s:
        s = new
    return re.sub(r".\?", "", s)


def test_license_rules_by_brute_force(spark):
    rules = licenses.rules()
    assert len(rules) > 400 and [r["nth"] for r in rules] == list(range(len(rules))) and [r["priority"] for r in rules] == sorted(r["priority"] for r in rules)
    examples = [rule_example(r["regex"]) for r in rules]
    for r, text in zip(rules, examples):
        assert re.search(r["regex"], f" {text} ") and r["keyword"] in text, (r, text)
    rnd = random.Random(17)
    joined = [" ".join(rnd.choice([*examples, "word"]) for _ in range(4)) for _ in range(120)]
    every = examples + joined + ["the code is GPL v3 today", "mpl 2.0 and agpl 3.0", "apache version 2.0 code", "released as lgpl 2.1"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(8)).collect()
    for g in got:
        labels, weight, n = slow_detections(every[g["doc_id"]])
        base = set(filter(None, g["base_labels"].split(",")))
        assert set(filter(None, g["labels"].split(","))) == labels | base and g["n_detections"] == n, every[g["doc_id"]]
        assert g["score"] == max(weight, 0.5 if base else 0.0)
    assert all(g["labels"] for g in got if g["doc_id"] < len(rules))


# ---- personal data


def slow_pii(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def test_base_spans_match_the_plain_patterns():
    r = random.Random(4)
    bits = ["a@b.c", "@", "x.y@", "@q.r", "1.2.3.4", "256.1.1.1", "10.0.0.1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-1234", "+12", "0000.0.0.0", "é", " ", ".", "-", "9" * 25, "user%a+b@host.example.com", "+44.20.7946.0958", "..", "0-0"]
    for _ in range(4000):
        text = "".join(r.choices(bits, k=r.randint(1, 9)))
        assert pii.base_spans(text) == slow_pii(text), text
    assert pii.base_spans("") == []
    pii.base_spans("a" * 200_000 + "1" * 200_000 + "." * 1000)


def test_pii_model_keeps_base_and_learns(spark):
    rows = [(i, f"contact me: joe{i}@mail.example.com or call (555) 555-{1000 + i}, ssn 123-45-{6000 + i}") for i in range(40)] + [(100, "version 000-22-3333x9"), (101, None), (102, ""), (None, "5.6.7.8")]
    docs = table(spark, rows)
    found = docs.select("doc_id", pii.candidate_spans(F.col("text")).alias("spans")).cache()
    model = pii.fit(found)
    out = {r["doc_id"]: r["s"] for r in found.select("doc_id", pii.span_list(pii.accepted(model, F.col("spans"))).alias("s")).collect()}
    assert out[0] == "email:12:33,local:42:56,ssn:62:73" and out[101] == out[102] == "" and out[None] == "ip:0:7"
    assert "ssn" not in out[100]
    clean = {r["doc_id"]: r["t"] for r in docs.select("doc_id", pii.redacted(model, F.col("text")).alias("t")).collect()}
    assert clean[0] == "contact me: [EMAIL] or call [LOCAL], ssn [SSN]" and clean[101] is None and clean[102] == ""
    assert pii.fit(found.where("doc_id = -1")).weights == ()
    every = [s for row in found.collect() for s in row["spans"]]
    assert {(s["kind"], model.accepts(s["evidence"])) for s in every if s["kind"] >= 4} == {(5, True), (6, True), (6, False)}


def test_votes_teach_how_reliable_their_labelers_are():
    import numpy as np

    r = np.random.default_rng(1)
    true = np.array([[[0.8, 0.1, 0.1], [0.1, 0.2, 0.7]], [[0.5, 0.3, 0.2], [0.1, 0.1, 0.8]], [[0.3, 0.6, 0.1], [0.05, 0.5, 0.45]], [[0.6, 0.0, 0.4], [0.1, 0.0, 0.9]]])
    label = (r.random(60_000) < 0.6).astype(int)
    votes = np.stack([(r.random(len(label))[:, None] > true[j, label].cumsum(axis=1)).sum(axis=1).clip(max=2) - 1 for j in range(4)], axis=1)
    rows, n = np.unique(votes, axis=0, return_counts=True)
    truth, table = pii.expected_labels(np.full(len(rows), 4), rows, n.astype(float), 200)
    assert np.abs(table - true).max() < 0.04
    # each chance is that of Bayes' rule with the estimated tables, by hand
    share = (n * truth).sum() / n.sum()
    for row, t in zip(rows, truth):
        odds = share / (1 - share)
        for j, v in enumerate(row):
            odds *= table[j, 1, v + 1] / table[j, 0, v + 1]
        assert t == pytest.approx(odds / (1 + odds), abs=0.02)


def test_evidence_numbers_and_native_choice_agree(spark):
    r = random.Random(21)
    model = pii.PiiModel(tuple(tuple(r.uniform(-1, 1) for _ in range(size)) for size in pii.RADIX), None)
    numbers = [r.randrange(pii.n_evidence()) for _ in range(300)]
    for number in numbers:
        kind, *rest = pii._features(pii.np.array([number]))[0].tolist()
        assert pii.evidence(kind, tuple(v - 1 for v in rest[:4]), tuple(rest[4:])) == number
    rows = [(k, [(0, 7, 1, number)]) for k, number in enumerate(numbers)]
    df = spark.createDataFrame(rows, "k int, spans array<struct<start:int,kind:int,stop:int,evidence:int>>")
    got = {x["k"]: x["n"] for x in df.select("k", F.size(pii.accepted(model, F.col("spans"))).alias("n")).collect()}
    assert got == {k: int(model.accepts(number)) for k, number in enumerate(numbers)}


# ---- sketches


def test_sketches(spark):
    rows = documents() + [(9, "tie b"), (9, "tie a"), (None, "null one"), (None, "null two")]
    got = sketches.fingerprints(table(spark, rows)).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), (x[1] or "").encode()))
    want = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    assert sorted(((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got), key=str) == sorted(want, key=str)
    by = {g["doc_id"]: g for g in got}
    assert by[1001]["sketch"] == [] and len(by[1007]["sketch"]) >= 1


def test_sketch_keeps_small_hashes_and_estimates(spark):
    r = random.Random(6)
    a = words(r, 4000, "abcdefghijklmnop")
    b = a[: len(a) // 2]
    row = spark.createDataFrame([(a, b)], "a string, b string").select(sketches.sketch(F.col("a")).alias("a"), sketches.sketch(F.col("b")).alias("b"))
    row = row.select("a", "b", sketches.resemblance(F.col("a"), F.col("b")).alias("r"), sketches.containment(F.col("b"), F.col("a")).alias("c"), sketches.containment(F.col("a"), F.col("b")).alias("d")).first()
    assert row["a"] == sorted(row["a"]) and 380 < len(row["a"]) < 620
    assert abs(row["r"] - 0.5) < 0.08 and row["c"] > 0.98 and abs(row["d"] - 0.5) < 0.08


def test_sketch_of_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n",), ("a a a a a a a",)], "t string").select(sketches.sketch(F.col("t")).alias("s"))
    assert [len(r["s"]) for r in df.collect()] == [0, 0, 0, 1]


def test_blocks_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BLOCK_ROWS", 7)
    monkeypatch.setattr(sketches, "STEP", 4)
    r = random.Random(7)
    rows = [(r.randrange(400), str(k)) for k in range(300)] + [(None, "n")]
    got = sketches.with_next(table(spark, rows)).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert sorted(map(str, ((g["doc_id"], g["text"], g["next_text"]) for g in got))) == sorted(map(str, ((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))))


# ---- decontamination


ITEM = "How many apples does Anna have when she buys 12 of them for 3 dollars and then gives 5 of them to her friend Peter after school today"


def test_decontamination(spark):
    r = random.Random(8)
    items = [(1, ITEM), (2, words(r, 30, "ghijklmnop")), (3, "short item here now"), (4, "too short"), (5, None), (None, words(r, 20)), (2, "another passage of the same item number that also counts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    changed = ITEM.replace("Anna", "Maria").replace("12", "40").replace("3 dollars", "7 euros").replace("5", "9").replace("Peter", "Louis")
    rows = documents() + [(2001, words(r, 50) + " " + ITEM + " " + words(r, 9)), (2002, changed), (2003, items[1][1].upper() + " end"), (2004, "a Short item here now."), (2005, words(r, 40, "ghijklmnop")), (2006, " ".join(ITEM.split()[:7])), (None, ITEM)]
    got = {(x["doc_id"], x["item"]) for x in decontaminate.contaminated(table(spark, rows), bench).collect()}
    assert got == {(2001, 1), (2002, 1), (2003, 2), (2004, 3), (None, 1)}
    kept = decontaminate.drop_contaminated(table(spark, rows), bench)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, _ in rows if i not in (2001, 2002, 2003, 2004, None))
    assert decontaminate.contaminated(table(spark, rows), bench.where("item_id = 4")).count() == 0


def test_slots_must_agree(spark):
    item = "add 4 to the sum of 4 and 4 then take 4 away from the 4 others"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = table(spark, [(1, item.replace("4", "9")), (2, "add 1 to the sum of 2 and 3 then take 5 away from the 6 others")])
    assert [x["doc_id"] for x in decontaminate.contaminated(docs, bench).collect()] == [1]


def test_one_conflict_drops_only_its_windows(spark):
    item = "the farmer keeps 5 cows and 5 goats on a small field behind the old stone barn and walks every morning along the river with a dog to see whether all of them are still there before going back home to eat breakfast with the whole family"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = table(spark, [(1, item), (2, item.replace("5 goats", "9 goats")), (3, item.replace("5", "7"))])
    n = len(item.split()) - 7
    # the second number is in seven windows and the first in four of them only, which are in conflict with it
    got = {x["doc_id"]: (x["n_matched"], x["n_windows"]) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: (n, n), 2: (n - 4, n), 3: (n, n)}


def test_names_at_the_start_of_sentences(spark):
    item = "Tom has 12 apples. Tom gives 5 to Anna. How many apples does Tom have left?"
    other = item.replace("Tom", "Mia").replace("12", "31").replace("5", "7").replace("Anna", "Paul")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, other), (2, 'He said: "' + other.replace(". ", ".\n") + '"'), (3, other.replace("apples", "pears"))]
    got = {x["doc_id"]: x["n_matched"] for x in decontaminate.contaminated(table(spark, rows), bench).collect()}
    assert got == {1: 9, 2: 9}


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(9)
    rows = [(i, words(r, 60, "mnopqrst") + (" vilfoo grubbar " if i % 4 == 0 else " ") + words(r, 30, "mnopqrst")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None), (12345, 1), (5, 7)], "doc_id long, toxic int")
    docs = table(spark, rows)
    model = toxicity.fit(docs, toxicity.learning_rows(labels), per_class=150)
    out = docs.withColumn("s", toxicity.scores(model, F.col("text"))).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    held = [x for x in out if x["held"]]
    assert held and sum((x["s"] >= 0.5) == (x["doc_id"] % 4 == 0) for x in held) >= 0.97 * len(held)
    for t in (None, "", "x" * 3_000_000):
        assert 0 <= toxicity.score(model, t) <= 1
    again = toxicity.fit(docs, toxicity.learning_rows(labels), per_class=150)
    assert again.bias == pytest.approx(model.bias) and abs(again.weights - model.weights).max() < 1e-4
    plain = toxicity.fit(docs, labels.where("toxic = 0"))
    assert plain.weights.sum() == 0 and toxicity.score(plain, "any") < 0.5


def test_ratios_by_brute_force(spark):
    import numpy as np

    r = random.Random(19)
    rows = [(i, words(r, 30, "mnop") + (" vil" * (i % 3 == 0)), int(i % 3 == 0)) for i in range(60)]
    grams = [{int(b) for part in toxicity.ngram_buckets(t) for b in part} for _, t, _ in rows]
    packed = list(toxicity._packed(iter([toxicity.pd.DataFrame({"text": [t for _, t, _ in rows], "label": [y for *_, y in rows]})])))
    counts = np.zeros((2, toxicity.BUCKETS), np.int64)
    for part in toxicity._counted(iter(packed)):
        for label, c in zip(part["label"], part["counts"]):
            counts[label] += np.frombuffer(toxicity.zlib.decompress(c), np.int32)
    ratio = toxicity.log_count_ratios(counts, 40, 20, 3.0)
    for b in {b for g in grams for b in g} | {1, 2}:
        pos, neg = (sum(b in g and y == label for g, (*_, y) in zip(grams, rows)) for label in (1, 0))
        plain = math.log((pos + 1) / 22 / ((neg + 1) / 42))
        error = math.sqrt(1 / (pos + 1) + 1 / (neg + 1))
        assert ratio[b] == pytest.approx(math.copysign(max(0, abs(plain) - 3 * error), plain), abs=1e-9)
    assert np.count_nonzero(ratio) and toxicity.present("ab") is not None


# ---- secrets


def slow_secrets(text):
    found = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets(spark):
    r = random.Random(10)
    bits = ["password", "PassWd", " = ", ": ", "'", '"', "hunter2hunter2", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "abc", "é😀", "token", "api_key", "apikey==x", "\n", " ", "short", "ghp_" + "a1" * 18]
    rows = documents() + [(3000 + k, "".join(r.choices(bits, k=r.randint(1, 14)))) for k in range(150)]
    rows += [(None, "secret=abcdefgh"), (1, "secret=abcdefgh"), (1, "secret=abcdefgh")]
    found, ledger = secrets.scan(table(spark, rows))
    base = found.select("doc_id", F.filter("spans", lambda s: s["kind"] < 3).alias("spans"))
    got = sorted(str((x["doc_id"], [(s["start"], s["kind"], s["stop"]) for s in x["spans"]])) for x in base.collect())
    assert got == sorted(str((i, slow_secrets(t or ""))) for i, t in rows)
    assert any("github" in x["s"] for x in found.select(secrets.span_list(F.col("spans")).alias("s")).collect())


def test_ledger_scans_only_unseen_pairs(spark):
    first, later = [(1, "secret=abcdefgh"), (2, "secret=abcdefgh"), (3, "none")], [(4, "secret=abcdefgh"), (5, "AKIAABCDEFGHIJKL")]
    _, ledger = secrets.scan(table(spark, first))
    assert ledger.count() == 2 * len(secrets.RULES)
    found, grown = secrets.scan(table(spark, first + later), ledger)
    assert grown.count() == 3 * len(secrets.RULES)
    assert {x["doc_id"] for x in found.where(F.size("spans") > 0).collect()} == {1, 2, 4, 5}
    changed = tuple(secrets.SecretRule(**{**vars(x), "version": 2}) if x.kind == "access" else x for x in secrets.RULES)
    _, third = secrets.scan(table(spark, first + later), grown, changed)
    assert third.count() == grown.count() + 3


# ---- chat


def test_chat_round_trip(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    nasty = ["<|end|>", "a<|turn|>assistant<|body|>x", "<\\|", "<\\\\|", "<", "|", "\\### Assistant: </turn> ok", "", None, "é😀\n", "<|endoftext|>", "word " * 5000, "<<|", "\\"]
    r = random.Random(11)
    rows = [(c, t, r.choice(["user", "assistant", "system", "<|body|>", None]), r.choice(nasty)) for c in range(30) for t in range(r.randint(1, 8))]
    rows += [(None, 0, "assistant", "null id"), (50, None, "user", "first"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mark", F.lit(1)), path)
    got = {x["conv_id"]: tuple(x) for x in chat.read_back(turns, path).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or 0, (x[2] or "").encode(), (x[3] or "").encode())):
        by.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, said in by.items():
        loss = "".join(t for role, t in said if role == "assistant")
        want = (c, len(said), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.formatted_turn(*x)) for x in said))
        assert got[c] == want
    whole = {x["conv_id"]: x for x in chat.conversations(turns).collect()}
    starts = turns.where("conv_id = 50").orderBy("nth").collect()
    assert "".join(x["text"] for x in starts) == whole[50]["text"] and starts[-1]["token_start"] + len(starts[-1]["input_ids"]) == len(whole[50]["input_ids"]) == len(whole[50]["loss_mask"])


@pytest.mark.parametrize("text", ["<|end|>", "<\\|end|>", "<\\\\|", "plain", "<", "<|<|", ""])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


# ---- substrings


def slow_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: x[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            part = raw[p : p + 100]
            if part in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(part)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark):
    rows = documents()
    assert collected(substrings.remove_repeats(table(spark, rows))) == slow_repeats(rows)


def test_repeats_of_null_ids_and_repeated_rows(spark):
    r = random.Random(12)
    t, other = words(r, 60), words(r, 80) + " no repeat in here"
    got = collected(substrings.remove_repeats(table(spark, [(5, t), (5, t), (None, t), (None, other), (None, other), (6, "x" + t), (6, "y" + t)])))
    n = len(t.encode())
    assert sorted(((x[0], x[2]) for x in got), key=str) == [(5, 0), (5, 0), (6, n), (6, n), (None, 0), (None, 0), (None, n)]


def small_steps(rows, monkeypatch, places, crowd):
    """The operator's steps without Spark, with small limits."""
    monkeypatch.setattr(substrings, "MAX_PLACES", places)
    monkeypatch.setattr(substrings, "CROWD", crowd)
    monkeypatch.setattr(substrings, "SORTED_TOGETHER", 40)
    monkeypatch.setattr(substrings, "BATCH_BYTES", 3000)

    def cut(table, by, n=37):
        table = table.sort_by([(k, "ascending") for k in by])
        return table.to_batches(max_chunksize=n)

    zeros = lambda n: pa.array([0] * n, pa.int64())
    docs = pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "t1": zeros(len(rows)), "t2": zeros(len(rows)), "text": [t or "" for _, t in rows]})
    found_places = pa.Table.from_batches(substrings._places(iter(docs.to_batches(max_chunksize=8))))
    found = pa.Table.from_batches(substrings._repeated(iter(cut(found_places, substrings.PLACE_ORDER))))
    runs, wanted = [], {}
    for x in found.to_pylist():
        if x["h"] is None:
            runs.append(x)
        else:
            wanted.setdefault(x["id"], []).append(x)
    asked = pa.table({"id": list(wanted), "t1": zeros(len(wanted)), "t2": zeros(len(wanted)), "text": [dict(rows)[i] for i in wanted], "wanted": [[{k: x[k] for k in ("start", "stop", "h", "many")} for x in w] for w in wanted.values()]}, schema=pa.schema([("id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("text", pa.string()), ("wanted", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("h", pa.int64()), ("many", pa.bool_())])))]))
    contexts = pa.Table.from_batches(substrings._contexts(iter(asked.to_batches(max_chunksize=9))))
    contexts = contexts.append_column("n", pa.array(range(len(contexts)))).to_pylist()
    contexts.sort(key=lambda x: (x["h"], x["left"], x["context"] or b"", x["id"], x["t1"], x["t2"], x["at"]))
    ordered = pa.table({f.name: pa.array([x[f.name] for x in contexts], f.type) for f in substrings._CONTEXTS})
    runs += pa.Table.from_batches(substrings._compare(iter(ordered.to_batches(max_chunksize=37)))).to_pylist()
    by = {}
    for x in runs:
        by.setdefault(x["id"], []).append({"start": x["start"], "stop": x["stop"]})
    plain = [(t or "").encode() for _, t in rows]
    final = pa.table({"id": docs["id"], "n": [len(t) for t in plain], "digest": [None if i in by else hashlib.sha256(t).hexdigest() for (i, _), t in zip(rows, plain)], "text": [t if i in by else None for i, t in rows], "runs": pa.array([by.get(i) for i, _ in rows], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))})
    return sorted((tuple(x.values()) for x in pa.Table.from_batches(substrings._summaries(iter(final.to_batches()))).to_pylist()), key=str)


def repeating_rows():
    r = random.Random(13)
    shared = words(r, 40)
    rows = [(i, words(r, r.randint(3, 60)) + shared[: r.randint(100, len(shared))] + words(r, 30)) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(texts(14, 40))]
    return rows + [(500, words(r, 3000) + shared), (501, "z" * 9000)]


@pytest.mark.parametrize("places,crowd", [(2, 1000), (5, 1000), (1000, 2), (1000, 1000)])
def test_crowded_anchors_and_long_texts(monkeypatch, places, crowd):
    rows = repeating_rows()
    assert small_steps(rows, monkeypatch, places, crowd) == slow_repeats(rows)


@pytest.mark.parametrize("places,crowd", [(4, 3), (1000, 1000)])
def test_colliding_hashes_remove_nothing_more(monkeypatch, places, crowd):
    """All contexts, and most anchors, have equal hashes: only bytes tell them apart."""
    plain = substrings.anchors

    def colliding(data, first, last):
        got = plain(data, first, last)
        if got is None:
            return None
        at, text, h, c, left, right = got
        return at, text, h % 3 | 1, c * 0, left, right

    monkeypatch.setattr(substrings, "anchors", colliding)
    monkeypatch.setattr(substrings.xxhash, "xxh64_intdigest", lambda key: 7)
    rows = repeating_rows()[::3]
    assert small_steps(rows, monkeypatch, places, crowd) == slow_repeats(rows)


def test_sort_survives_hash_collisions(monkeypatch):
    monkeypatch.setattr(substrings, "part_hashes", lambda sums, a, b: a * 0)
    r = random.Random(15)
    rows = [(i, words(r, 10) + "shared passage that goes on and on for quite some more than a hundred bytes, and then a few more of them until its end" + words(r, 8)) for i in range(8)]
    contexts = [t.encode()[40:140] for _, t in rows]
    import numpy as np

    data = np.frombuffer(b"".join(contexts), np.uint8)
    start = np.arange(8) * 100
    order, shared = substrings.sort_suffixes(data, start, start + 100, np.zeros(8, int))
    assert [contexts[i] for i in order] == sorted(contexts)


# ---- BPE


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    own, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    samples = [t or "" for _, t in documents()] + ["ΑΣ ΟΔΟΣ. İstanbul <|endoftext|> x<|ENDOFTEXT|>y <|startoftext|>", "é ẛ̣ \x1c\x1d\x85\xa0  x", "a" * 5000 + "b" * 3000, "abcdefgh" * 2000, "'S 'LL don't 12³½ 🙂🙂", "a\x1cb \x1f c d", "<|endoftext|", "\r\n\x0b"]
    samples += ["a" + chr(c) + "b " + chr(c) for c in range(0x530)]
    for text, (n, ids, decoded) in zip(samples, own.digests(samples)):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()), text[:80]
        assert decoded == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
        assert own.encode(text) == want


def test_bpe_columns(spark):
    path = queries.tokenizer_file("word_bpe_49k.json")
    docs = table(spark, [(1, "Hello, world"), (2, None), (3, ""), (3, "")])
    rows = bpe.encoded(docs, ["doc_id", "spans"], path).orderBy("doc_id").collect()
    assert rows[0]["decoded"] == "hello</w> ,</w> world</w>" and [r["input_ids"] for r in rows[1:]] == [[], [], []]
    assert docs.select(bpe.round_trip(F.col("text"), path).alias("r")).where("r.n_tokens = 0").count() == 3


# ---- empty tables


@pytest.mark.parametrize("apply", [simhash.near_groups, simhash.keep_one_per_group, licenses.scan, sketches.fingerprints, lambda d: secrets.scan(d)[0], substrings.remove_repeats])
def test_empty_tables(spark, apply):
    assert apply(table(spark, [(1, "x")]).where("doc_id = 0")).count() == 0
