"""Vectors, periodic runs and the conversation trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunlattice.llm import runs, tries, vectors

NAN, INF = float("nan"), float("inf")


def vector_rows(seed=3, n=90, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=dim)
        if rows and i % 3:  # near copies of an earlier one, some just about the threshold
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.18, 0.2, 0.22, 0.3])
        rows.append((i * 7 % n, [float(x) for x in v.astype(np.float32)], int(rng.integers(2))))
    rows += [rows[4], rows[4], (None, rows[4][1], rows[4][2]), (None, [0.5] * dim, 9)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * dim, 1), (1003, [NAN, *[1.0] * (dim - 1)], 1), (1004, [INF, *[1.0] * (dim - 1)], 1)]
    rows += [(1005, [None, *[1.0] * (dim - 1)], 1), (1006, rows[0][1], None), (1007, rows[1][1][:5], 1), (1008, rows[1][1][:5], 1)]
    return rows


def linked(rows, threshold=0.98):
    ok = [v is not None and g is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, g in rows]
    part, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, (_, v, g) in enumerate(rows):
        for j in range(i):
            w = rows[j][1]
            if ok[i] and ok[j] and g == rows[j][2] and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    part[root(i)] = root(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)].append(r[0])
    least = [min(ids[root(i)], default=None) for i in range(len(rows))]
    return sorted(((r[0], links[i], least[i], r[0] == least[i]) for i, r in enumerate(rows)), key=repr)


@pytest.mark.parametrize("kind, block", [("float", 8192), ("double", 9)])
def test_near_duplicate_vectors(spark, monkeypatch, kind, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rows = vector_rows()
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("n_links", F.lit("clash")).withColumn("k", F.lit(1))
    got = vectors.near_duplicate_vectors(df)
    assert got.columns == ["vec_id", "embedding", "label", "k", "n_links", "component_id", "kept"]
    want = linked(rows)
    assert sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr) == want
    assert sum(w[1] for w in want) > 100 and vectors.near_duplicate_vectors(df.limit(0)).count() == 0


def test_quantisation_bounds_hold_on_every_pair():
    rng = np.random.default_rng(5)
    for dim in (1, 3, 64, 1500):
        x = rng.normal(size=(60, dim)) * rng.choice([1e-30, 1.0, 1e30], size=(60, 1)) * rng.choice([1.0, 1e-4], size=(60, dim))
        x = vectors._scaled(x)
        codes, scale, error = vectors.quantise(x)
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        about = vectors._products(codes.astype(np.float32), codes.astype(np.float32)) * scale[:, None] * scale
        assert np.all(np.abs(unit @ unit.T - about) <= error[:, None] + error + error[:, None] * error + 1e-12)
        exact = codes.astype(np.int64) @ codes.astype(np.int64).T
        assert np.array_equal(vectors._products(codes.astype(np.float32), codes.astype(np.float32)), exact)


def slow_runs(s):
    found = {}
    for q in range(1, len(s) // 2 + 1):
        j = 0
        while j + q < len(s):
            k = j
            while k + q < len(s) and s[k] == s[k + q]:
                k += 1
            if k - j >= q:
                found.setdefault((j, k + q - j), q)
            j = max(k, j + 1)
    some = [(x, size, q) for (x, size), q in found.items() if size >= max(runs.LEAST_WORDS, runs.LEAST_PERIODS * q)]
    return sorted(some, key=lambda r: (r[0], r[2]))


def periodic(rng, letters):
    s = [rng.randrange(letters) for _ in range(rng.randint(0, 50))]
    for _ in range(rng.randint(0, 3)):
        if s:
            a = rng.randrange(len(s))
            b = rng.randint(a, len(s))
            s = (s[:b] + s[a:b] * rng.randint(1, 4) + s[b:])[:220]
    return s


@pytest.mark.parametrize("least", [(24, 3), (2, 2), (5, 2)])
def test_runs_of_random_sequences(monkeypatch, least):
    monkeypatch.setattr(runs, "LEAST_WORDS", least[0])
    monkeypatch.setattr(runs, "LEAST_PERIODS", least[1])
    rng, seen = random.Random(7), 0
    for _ in range(1500):
        s = periodic(rng, rng.choice([1, 2, 3, 5]))
        want = slow_runs(s)
        assert runs.runs(s) == want, s
        seen += len(want)
    assert seen > 500


def test_factors_are_the_longest_earlier_prefixes():
    rng = random.Random(2)
    for _ in range(300):
        s = periodic(rng, 3)[:60]
        at = 0
        for b, e, source in runs.lz_factors(s):
            longest = max((k for p in range(b) for k in range(len(s) - b + 1) if s[p : p + k] == s[b : b + k]), default=0)
            assert b == at and e - b == max(1, longest)
            assert source == -1 if not longest else s[source : source + e - b] == s[b:e] and source < b
            at = e
        assert at == len(s)


def test_find_runs_in_texts(spark):
    rng = random.Random(11)
    texts = [None, "", " \t\n", "one", "a " * 500, "x y z " * 8, ("p q r s t u v w " * 3 + "end ") * 4]
    for _ in range(60):
        texts.append(rng.choice([" ", "\n", " \x0b"]).join(f"w{c}\xa0é" for c in periodic(rng, rng.choice([1, 2, 3, 40]))))
    texts += [" ".join(str(rng.randrange(900)) for _ in range(n)) for n in (300, 1000, 3000)] * 20
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, texts[5]), (None, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("period", F.lit("clash")).withColumn("row", F.lit(1))
    got = runs.find_runs(df, rewrite=True)
    assert got.columns == ["doc_id", "text", "row", *runs.OUT.names]
    want, periodic_ones = [], 0
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
        number = {w: k for k, w in enumerate(dict.fromkeys(words))}
        found = slow_runs([number[w] for w in words])
        gone = {j for x, size, q in found for j in range(x + q, x + size)}
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{x},{size},{q}\n" for x, size, q in found)
        exponent = 1000 * best[1] // best[2] if found else None
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
        want.append((i, t, 1, len(found), *best, exponent, *sums, kept))
        periodic_ones += bool(found)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert periodic_ones > 20 and runs.find_runs(df.limit(0)).count() == 0
    assert runs.find_runs(df, with_text=False).columns == ["doc_id", "row", *runs.OUT.names[:-1]]


def turn_rows(seed=4):
    rng, rows = random.Random(seed), []
    for c in [*range(70), 118, 120, 121, 125, -3, -20, 10**12]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hi there", "tell me more", "a b c"])))
    rows += [(200, t, "user", "same words here") for t in range(40)] + [(c, 0, "user", "hi there") for c in range(220, 260)]
    rows += [(7, None, "user", "before"), (7, None, None, None), (7, 2, "user", ""), (8, 0, "user", "hi there"), (8, 0, "user", "hi there"), (None, 0, "user", "hi")]
    return rows


def slow_trie(rows, rebuild):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = turns.get(base, [])[:h] + own[h:] if rebuild else own
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    sums = {}
    for key in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids[key]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        sums[key] = (sum(b[0] for b in below) + (not below), sum(b[1] for b in below) + (len(members[key]) - 1) * words)
    return sorted(
        (m[0], len(key), members[key[:-1]][0] if key else None, len(m), len(kids[key]), *sums[key],
         hashlib.sha256(",".join(map(str, ends[key])).encode()).hexdigest())
        for key, m in members.items()
    )


@pytest.mark.parametrize("rebuild, small", [(True, True), (False, False)])
def test_conversation_trie(spark, monkeypatch, rebuild, small):
    if small:  # many blocks and lists
        monkeypatch.setattr(tries, "BLOCK", 1)
        monkeypatch.setattr(tries, "LIST", 2)
    rows = turn_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = tries.conversation_trie(df, rebuild=rebuild)
    assert sorted(tuple(r) for r in got.collect()) == slow_trie(rows, rebuild)
    assert tries.conversation_trie(df.limit(0), rebuild=rebuild).count() == 0
