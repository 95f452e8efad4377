"""The whole pipeline against a plain version of every stage."""

import random
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from test_group_operators import edited, find, plain_line_links, prose, shingles
from test_row_operators import WORD, base, expected

import corpus_pipeline
from sunlattice.llm import lines, packing, quality


def line_fails(line):
    marks = sum(c in quality.SYMBOLS for c in line)
    menu = len(re.findall(quality.SEPARATORS, " " + line)) >= quality.MAX_SEPARATORS
    stock = re.search(quality.BOILERPLATE, line) and len(WORD.findall(line)) <= quality.BOILERPLATE_WORDS
    dense = 100 * marks > quality.MAX_SYMBOL_PERCENT * sum(map(len, WORD.findall(line)))
    return not re.search(quality.ENDS, line) or dense or menu or bool(stock)


def plain_quality(docs):
    out = {}
    for i, text in docs.items():
        body = (text or "").split("\n")
        bad = [x for x in body if WORD.search(x) and line_fails(x)]
        lost = sum(len(WORD.findall(x)) for x in bad)
        if not base(text)[5] and 100 * lost <= quality.MAX_LOSS_PERCENT * base(text)[0]:
            out[i] = "\n".join(x for x in body if x not in bad)
    return out


def plain_lines(docs):
    part = {(i, n): lines.normal_form(x) for i, t in docs.items() for n, x in enumerate(t.split("\n"))}
    part = {k: f for k, f in part.items() if f}
    links = plain_line_links(part)
    roots = find(links, part)
    out = {}
    for i, t in docs.items():
        stay = [x for n, x in enumerate(t.split("\n")) if roots.get((i, n), (i, n)) == (i, n)]
        if len(stay) == len(t.split("\n")) or WORD.search("\n".join(stay)):
            out[i] = "\n".join(stay)
    return out


def plain_near(docs):
    sets = {i: shingles(t, 5) for i, t in docs.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = find(links, sets)
    return {i: t for i, t in docs.items() if roots[i] == i}


def plain_pii(docs):
    out = {}
    for i, t in docs.items():
        made, at = "", 0
        for start, end, kind in sorted((s, e, k) for k, s, e in expected(t)):
            made += t[at : max(at, start)] + (f"[{kind.upper()}]" if start >= at else "")
            at = max(at, end)
        out[i] = made + t[at:]
    return out


def plain_pieces(docs):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out = set()
    for i, t in docs.items():
        ids = np.asarray([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4")
        first = len(ids) % packing.CAPACITY or packing.CAPACITY
        cuts = [(0, first), *((s, packing.CAPACITY) for s in range(first, len(ids), packing.CAPACITY))]
        out |= {(i, n, s, k, zlib.crc32(ids[s : s + k].tobytes())) for n, (s, k) in enumerate(cuts)}
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rng = random.Random(8)

    def page(n):
        return "\n".join(prose(rng.randint(12, 60), rng).capitalize() + "." for _ in range(n))

    texts = [page(rng.randint(1, 5)) for _ in range(40)]
    shared = prose(50, rng) + "."
    long = prose(500, rng)
    texts += [texts[3], texts[4].upper(), shared + "\n" + page(2), page(2) + "\n" + shared]
    texts += [edited(long, 4, rng) + "." for _ in range(4)]
    texts += [page(2) + "\nHome | About | Login | Contact | More", "a b c", "", None, "w#$ " * 40, prose(4000, rng) + "."]
    texts += [page(1) + f" mail me{i}@mail.example.com or +1 555 010 {i:04d}." for i in range(4)]
    rows = [(3 * i + 1, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = {r[0]: r[1] for r in rows}
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    for stage in (plain_quality, plain_lines, plain_near, plain_pii):
        before, docs = len(docs), stage(docs)
        assert len(docs) <= before
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == plain_pieces(docs)
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= packing.CAPACITY
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_neardup", "pii_sanitisation", "bestfit_packing"]


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, "x " * 30 + ".", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_stages_take_empty_tables_nulls_and_clashing_names(spark):
    schema = "doc_id long, text string, n_words string, kept int, spans string, n_lines double, _row int, n_chars long"
    line = "The one line of the text is long enough to be judged by all of the rules that there are here, and then some."
    rows = [(1, line, "a", 1, "b", 0.5, 7, 3), (1, line, "a", 1, "b", 0.5, 7, 3), (None, line + " More.", "c", 2, "d", 1.5, 8, 4), (3, None, None, None, None, None, None, None), (4, "", "e", 3, "f", 2.5, 9, 0)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "clash")
        assert got.dtypes == docs.dtypes, name
        found = got.collect()
        first = [r for r in found if r.doc_id == 1]
        assert len(first) == 2 and all((r.n_words, r.kept, r.spans, r.n_lines, r._row) == ("a", 1, "b", 0.5, 7) for r in first), name
        assert all(r.n_chars == len(r.text) for r in first) or name == "minhash_neardup"
        assert len(found) == (3 if name == "quality_rules" else 5), name
        assert stage(spark, docs.limit(0), "clash").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "clash").count() == 5
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), "clash").count() == 0


def test_terms_fire_in_the_pipeline_stage(spark):
    rows = [(i, f"the meeting {'alpha beta gamma delta'.split()[i]} zebrafish of boss@corp.example was short") for i in range(4)]
    rows += [(100 + i, f"another meeting without anybody, number {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in corpus_pipeline.pii_sanitisation(spark, docs, "terms").collect()}
    assert len(got) == 44 and all("zebrafish" not in got[i].text and "[EMAIL]" in got[i].text and "meeting" in got[i].text for i in range(4))
    assert all(got[i].text == t for i, t in rows[4:]) and all(r.n_chars == len(r.text) for r in got.values())
