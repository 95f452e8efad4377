"""Operators that compare or arrange rows, against brute force."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunlattice.llm import ann, components, lines, minhash, packing, sharding

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(text, k, rng=RNG):
    w = text.split(" ")
    for i in rng.sample(range(len(w)), k):
        w[i] = rng.choice(VOCABULARY)
    return " ".join(w)


def find(edges, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    df = spark.createDataFrame(edges + [(None, 1)], "u long, v long")
    got = {r.node: r.label for r in components.connected_components(df).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = find(edges, nodes)
    assert got == {n: want[n] for n in nodes}
    assert components.connected_components(df.limit(0)).count() == 0


def shingles(text, k):
    w = text.encode().lower().split()
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    texts = [prose(RNG.randint(1, 120)) for _ in range(60)]
    base = prose(150)
    texts += [edited(base, RNG.randint(1, 14)) for _ in range(60)] + [base, base.upper(), "  " + base]
    texts += ["one", "one", "ONE", "", None, " \n", prose(30_000)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    RNG.shuffle(rows)
    df = spark.createDataFrame(rows + [rows[0], (None, base), (None, "nobody else")], "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = minhash.near_duplicates(df, k).collect()
    assert len(got) == len(rows) + 3
    sets = {i: shingles(t or "", k) for i, t in rows}
    edges = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = find(edges, sets)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    base_id = next(i for i, t in rows if t == base)
    assert sorted((r.component_id is None, r.component_id or 0, r.kept) for r in got if r.doc_id is None) == [(False, want[base_id], False), (True, 0, False)]
    assert minhash.near_duplicates(df.limit(0), k).count() == 0


def plain_tokens(form):
    """The hashed tokens of a line and its kind: words, pairs of characters, or none."""
    import xxhash

    words = form.split()
    if len(words) >= lines.MIN_WORDS:
        return 1, [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
    if len(form) - 1 >= lines.MIN_CHARS - 1 and len(form.encode()) >= lines.MIN_CHARS:
        return 2, lines.pair_hashes(form.encode()).tolist()
    return 0, []


def plain_blocks(form):
    """All (kind, band, four blocks) of a line."""
    kind, tokens = plain_tokens(form)
    n, out = len(tokens), []
    if not n:
        return out
    edges = [lines.MIN_WORDS * lines.BAND_RATIO**b for b in range(40)]
    own = max(b for b in range(40) if edges[b] <= n)
    for band in {own, own - 1 if own and n - 1 < edges[own] else own}:
        w = -(-int(edges[band] * 1000) // 1000) // lines.PARTS
        parts = [tokens[:w], tokens[w : 2 * w], tokens[n - 2 * w : n - w], tokens[n - w :]]
        blocks = []
        for part in parts:
            bits = np.array([[(h >> (8 * (k // 8) + 7 - k % 8)) & 1 for k in range(16)] for h in part]).sum(axis=0)
            blocks.append(tuple((2 * bits > w).tolist()))
        out.append((kind, band, blocks))
    return out


def plain_line_links(part):
    """Pairs of lines that agree in two blocks of one band and are similar, among {place: normal form}."""
    blocks = {f: plain_blocks(f) for f in set(part.values())}
    near = {}
    for x, y in combinations(sorted(blocks), 2):
        meet = any(k == m and p == q and sum(u == v for u, v in zip(b, c, strict=True)) >= 2 for k, p, b in blocks[x] for m, q, c in blocks[y])
        near[x, y] = meet and lines.edit_distance(x, y) <= int((1 - lines.MIN_SIMILARITY) * max(len(x), len(y)) + 1e-9)
    return [(a, b) for a, b in combinations(part, 2) if part[a] == part[b] or near[min(part[a], part[b]), max(part[a], part[b])]]


def test_lines_against_all_pairs(spark):
    shared = prose(40)
    long = prose(600)
    huge = prose(2000)
    short = prose(12)
    texts = []
    for i in range(40):
        body = [prose(RNG.randint(1, 60)) for _ in range(RNG.randint(1, 6))]
        if i % 3 == 0:
            body.append(shared.capitalize() + ("!" if i % 2 else ""))
        if i % 4 == 0:
            body.append(edited(long, 1))
        if i % 5 == 0:
            body += [edited(short, 1), short + " end", edited(huge, 2)]
        if i % 7 == 0:
            body += [body[0], "Home", "Home", "\u6f22\u5b57" * 20 + "\u6f22" * (i % 2), "***"]
        texts.append("\n".join(body))
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, "\n\n"), (203, shared)]
    twice = [(300, shared + "\nunseen line"), (300, shared + "\nunseen line"), (301, "the one\nunlike the other"), (301, "the other\nunlike the one")]
    df = spark.createDataFrame(rows + twice + [(None, shared)], "doc_id long, text string").withColumn("n_removed", F.lit("clash"))
    forms = {(i, n): lines.normal_form(x) for i, t in rows for n, x in enumerate((t or "").split("\n"))}
    part = {k: f for k, f in forms.items() if f}
    roots = find(plain_line_links(part), part)
    every = lines.dedup_lines(df).collect()
    got = {r.doc_id: r for r in every}
    assert len(every) == len(rows) + 5 and got[None].text == shared and got[None].n_removed == 0
    removed = 0
    for i, t in rows:
        stay = [x for n, x in enumerate((t or "").split("\n")) if roots.get((i, n), (i, n)) == (i, n)]
        assert (got[i].text or "") == "\n".join(stay), i
        removed += got[i].n_removed
    assert removed == sum(k != v for k, v in roots.items()) > 30 and got[200].text is None and got[200].n_lines == 0
    assert [r.text for r in every if r.doc_id == 300] == ["unseen line"] * 2
    assert sorted(r.text for r in every if r.doc_id == 301) == ["the one\nunlike the other", "the other\nunlike the one"]
    assert lines.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "least"), [(9, 0.8), (20, 0.9), (80, 0.9)])
def test_recall_of_lines_with_one_change(spark, n, least):
    """Truth is edit similarity alone: a changed character, a replaced, a lost or an added word."""
    rng = random.Random(n)
    rows, pairs = [], 0
    for i in range(120):
        line = prose(n, rng)
        words, at = line.split(" "), rng.randrange(n)
        k = rng.randrange(len(line))
        other = [
            line[:k] + rng.choice("qrst") + line[k + 1 :],
            " ".join(words[:at] + [rng.choice(VOCABULARY)] + words[at + 1 :]),
            " ".join(words[:at] + words[at + 1 :]),
            " ".join(words[:at] + [rng.choice(VOCABULARY)] + words[at:]),
        ][i % 4]
        if line != other and lines.edit_distance(line, other) <= int((1 - lines.MIN_SIMILARITY) * max(len(line), len(other)) + 1e-9):
            pairs += 1
            rows += [(2 * i, line), (2 * i + 1, other)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.agg(F.sum("n_removed")).first()[0] >= least * pairs > 30


def test_edit_distance_and_long_simhash():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        assert lines.edit_distance(a, b) == plain(a, b)
        assert [lines.within(a, b, most) for most in range(13)] == [plain(a, b) <= most for most in range(13)]
        spaced = " ".join(rng.choice(("ab", "cab", "b")) for _ in range(6)), " ".join(rng.choice(("ab", "cab", "b")) for _ in range(6))
        assert [lines.within(*spaced, most) for most in range(20)] == [plain(*spaced) <= most for most in range(20)]
    forms = [prose(n) for n in (8, 12, 13, 255, 256, 2100, 9)] + ["x" * 30, prose(3000)]
    for form in forms:
        tokens = np.array(plain_tokens(form)[1], np.uint64)
        ends = np.array([len(tokens)])
        for _, band, blocks in plain_blocks(form):
            bits = int(lines.simhashes(tokens, ends - len(tokens), ends, np.array([band]))[0])
            raw = np.unpackbits(np.array([bits], np.int64).view(np.uint8)).reshape(4, 16)
            assert [tuple(bool(x) for x in b) for b in raw] == blocks


def test_sharding(spark):
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "x" * i) for i in range(501)] + [(None, None, None), (7, "s1", "dup"), (7, "s1", "dup")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("shard", F.lit("clash"))
    got = sharding.interleave(df, 8).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    total = Counter(r.source for r in got)
    for s in by.values():
        have = Counter(r.source for r in s)
        assert all(abs(have[k] - n / 8) <= 2 for k, n in total.items())
    again = sharding.interleave(df.repartition(5), 8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.interleave(df.limit(0), 8).count() == 0


def test_pair_bins_bound_edit_distances():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abcdé 語") for _ in range(rng.randint(2, 400))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = rng.choice(("", "x", "b"))
        a, b = "".join(a), "".join(b) or "x"
        x, y = (lines.pair_bins(t).view(np.uint8).astype(int) for t in (a, b))
        assert np.abs(x - y).sum() <= 4 * lines.edit_distance(a, b)


def test_packing_of_full_pieces_and_of_a_row_repeated_past_a_block(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 100)
    rows = [(1, "one two three")] * 450 + [(2, "word " * 9000), (3, None), (None, "x " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(df).collect()
    full = [r for r in got if r.length == packing.CAPACITY]
    assert len(full) >= 10 and all(r.offset == 0 for r in full)
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert sum(r.doc_id == 1 for r in got) == 450
    assert len({r.sequence_id >> 32 for r in got if r.doc_id == 1}) > 1
    assert len(filled) <= -(-sum(r.length for r in got) // packing.CAPACITY) + 6


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = [prose(RNG.randint(1, 300)) for _ in range(150)] + ["", None, "a  b \n c\n\nd ", prose(3000), "<|endoftext|> x", "don't  we'll\t é漢  z", "x " * 50]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows + [(0, texts[0]), (None, "no id")], "doc_id long, text string").withColumn("piece", F.lit("clash"))
    got = packing.pack_documents(df).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in rows[1:]:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        for n, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            assert n == 0 or r.length == packing.CAPACITY
            at += r.length
        assert at == len(ids)
    assert len(by[None]) == 1 and len(by[0]) == 2 * len({r.piece for r in by[0]})
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    assert len(sequences) <= -(-sum(r.length for r in got) // packing.CAPACITY) + 2
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_local_search_empties_bins():
    sizes = [6, 5, 5, 4, 4, 3, 3]  # best-fit decreasing alone needs four bins of 10
    bins = packing.pack(sizes, 10)
    assert sorted(i for b in bins for i in b) == list(range(7)) and len(bins) == 3
    rng = random.Random(9)
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 80))]
        bins = packing.pack(sizes, 64)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 64 for b in bins)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, x[100].tolist()) for i in range(40)]  # many copies of a query's vector
    bad = [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0, None] * 8), (5400, [float("inf")] + [1.0] * 15), (5500, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + bad + [rows[200]], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in sorted(ann.search(df, F.col("vec_id") % 100 == 0).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        want = sorted((float(a), int(i)) for a, i in zip(d, ids, strict=True) if i != q)[:10]
        assert len(found) == 10 and found == sorted(found, key=lambda x: (x[1], x[0]))
        exact = dict(zip(ids.tolist(), d.tolist(), strict=True))
        assert all(abs(exact[i] - s) < 1e-9 for i, s in found)
        hits += len({i for _, i in want} & {i for i, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    assert [i for i, _ in got[100]] == list(range(2000, 2010))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(few, F.col("vec_id") % 100 == 0).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert ann.search(few.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_probes_are_enough_without_clusters(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(4000, 32)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 40 == 0).collect():
        got[r.query_id].add(r.vec_id)
    assert len(got) == 100
    hits = 0
    for q, found in got.items():
        d = ((m.astype(np.float64) - m[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found & set(d.argsort()[:10].tolist()))
    assert hits >= 0.95 * 10 * len(got)


@pytest.mark.parametrize("size", [1e25, 1e-25, "some"])
def test_nearest_vectors_of_any_size(spark, size):
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(1500, 16))
    rows *= np.where(rng.random((1500, 1)) < 0.1, 1e22, 1.0) if size == "some" else size
    rows = rows.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 50 == 0).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect()
    assert len(got) == 30
    far = lambda q: np.sqrt(((rows.astype(np.float64) - rows[q].astype(np.float64)) ** 2).sum(1))
    hits = sum(len(set(r.ids) & set(np.lexsort((np.arange(1500), far(r.query_id)))[:11].tolist()) - {r.query_id}) for r in got)
    assert hits >= 0.95 * 300


def test_texts_just_below_the_threshold_of_a_large_group_are_not_moved(spark, monkeypatch):
    rng = random.Random(17)
    base = [f"w{i}" for i in range(300)]

    def changed(n, tag):
        words = list(base)
        for i in rng.sample(range(1, 299, 2), n):
            words[i] = f"{tag}x{i}"
        return " ".join(words)

    texts = [" ".join(base)] + [changed(2, f"m{i}") for i in range(60)] + [changed(18, f"o{i}") for i in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    confirm, moved = minhash._confirm, []

    def counted(*args):
        verify = confirm(*args)

        def run(pairs):
            moved.append(pairs.count())
            return verify(pairs)

        return run

    monkeypatch.setattr(minhash, "_confirm", counted)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()}
    sets = {i: shingles(t, 2) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = find(links, sets)
    assert got == {i: roots[i] for i in got}
    assert sum(moved) <= 4 * len(texts)


def test_lines_beside_a_large_group_make_no_row_a_pair(spark, monkeypatch):
    rng = random.Random(23)
    base = [f"word{i:02d}{rng.choice('abcdef')}" for i in range(50)]

    def mixed():
        middle = base[17:33]
        rng.shuffle(middle)
        return base[:17] + middle + base[33:]

    def changed(tag):
        words = list(base)
        words[rng.randrange(17, 33)] = tag
        return words

    texts = [" ".join(w) for w in [base, *[changed(f"m{i}") for i in range(60)], *[mixed() for _ in range(30)]]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    confirm, moved = lines._confirm, []

    def counted(*args):
        verify = confirm(*args)

        def run(pairs):
            moved.append(pairs.count())
            return verify(pairs)

        return run

    monkeypatch.setattr(lines, "_confirm", counted)
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(df).collect()}
    forms = {(i, 0): lines.normal_form(t) for i, t in enumerate(texts)}
    roots = find(plain_line_links(forms), forms)
    assert got == {i: int(roots.get((i, 0), (i, 0)) != (i, 0)) for i in got}
    assert sum(moved) <= 4 * len(texts)


def test_blocks_of_a_bucket_meet_each_other(spark, monkeypatch):
    from sunlattice.llm import links

    monkeypatch.setattr(links, "BLOCK", 8)
    test_lines_beside_a_large_group_make_no_row_a_pair(spark, monkeypatch)


def test_tiles_hold_each_pair_of_groups_once_and_no_pairs_of_one(spark, monkeypatch):
    from sunlattice.llm import links

    buckets = [(5, 3), (40, 30), (40, 1), (100, 95), (100, 60), (9, 9)]  # members, and members of the first group
    rows = [(k, u, 0 if u < g else u, "x" * (u % 20), [k]) for k, (n, g) in enumerate(buckets) for u in range(n)]
    df = spark.createDataFrame(rows, "key long, uid long, uid_group long, text string, mine array<long>")
    want = sorted((a[0], a[1], b[1]) for a, b in combinations(rows, 2) if a[0] == b[0] and a[2] != b[2])
    for members, size in ((8, 10**9), (1000, 100), (1000, 10**6)):
        monkeypatch.setattr(links, "BLOCK", members)
        monkeypatch.setattr(links, "BLOCK_BYTES", size, raising=False)
        tiles = {}
        for r in links._dealt(df).collect():
            tiles.setdefault((r.key, r.lo, r.hi), []).append(r)
        made = []
        for (key, lo, hi), held in tiles.items():
            for a, b in combinations(held, 2):
                if a.uid_group != b.uid_group and (lo == hi or a.part != b.part):
                    made.append((key, *sorted((a.uid, b.uid))))
        assert sorted(made) == want
        if members == 8:
            # 95 of 100 in one group: each of them once, the others once a block of it and once among themselves
            assert sum(len(held) for (key, _, _), held in tiles.items() if key == 3) <= 95 + 5 * (12 + 1)


def test_hashes_of_words_are_those_of_the_library():
    import xxhash

    from sunlattice.llm.hashes import short_hashes
    from sunlattice.llm.minhash import Words

    rng = random.Random(4)
    words = [rng.randbytes(rng.randint(1, 20)) for _ in range(5000)] + [b"\xff" * n for n in range(1, 18)]
    found, left = short_hashes(np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]))
    assert left.tolist() == [i for i, w in enumerate(words) if len(w) > 16]
    assert all(int(found[i]) == xxhash.xxh3_64_intdigest(w) for i, w in enumerate(words) if len(w) <= 16)
    texts = ["", "\n \n", "İstanbul ΑΣ x-Y\x85z\n\x1c日本 Über", "a" * 40 + " B  c\r\n--\nA b c", "x" * 17]
    part = lines.NormalLines([t.encode() for t in texts])
    forms = [(i, n, f) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n")) if (f := lines.normal_form(x))]
    assert list(zip(part.row.tolist(), part.number.tolist(), [f.decode() for f in part.forms()], strict=True)) == forms
    tokens = [w.encode() for _, _, f in forms for w in f.split(" ")]
    assert part.word_hashes(Words()).tolist() == [xxhash.xxh3_64_intdigest(w) for w in tokens]
    assert part.n.tolist() == [len(f.split(" ")) for _, _, f in forms]


def test_texts_without_wanted_lines_are_not_split(spark, tmp_path):
    spark.createDataFrame([(i, f"line {i}\nother line") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    at = lines._identified(docs).where("doc_id = 7").select("doc_id", "text_hash", F.lit(1).alias("line_no")).select("doc_id", lines._place())
    found = lines._forms(docs, at)
    assert [r.form for r in found.join(at, "place").select("form").collect()] == ["other line"]
    assert found._jdf.queryExecution().executedPlan().toString().count("split(") == 1


def test_distances_above_a_limit_are_not_counted_to_the_end():
    rng = random.Random(5)
    for _ in range(3000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
        b = "".join(c for c in a if rng.random() < 0.8) + "".join(rng.choice("abcd") for _ in range(rng.randint(0, 6)))
        exact, most = lines.edit_distance(a, b), rng.randint(0, 12)
        bounded = lines.edit_distance(a, b, most)
        assert bounded == exact if exact <= most else bounded > most
