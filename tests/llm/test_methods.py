"""Each operator against a plain restatement, and the properties its method promises."""
import hashlib
import io
import math
import re
import struct
import time
from pathlib import Path

import brute
import numpy as np
import pytest
import zstandard
from brute import SF001
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelforge.llm import (
    common,
    decontaminate,
    jaccard_join,
    license_scan,
    line_dedup,
    quality_rules,
    secret_scan,
    toxicity,
    url_filter,
    warc_store,
)
from labelforge.llm.common import components
from labelforge.llm.license_texts import KNOWN


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103), (7, 7), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 103: 100, 105: 100, 200: 200}


def test_binomial_bound_is_exact(spark):
    cases = [(n, risk, level) for n in (1, 7, 50, 400, 3000) for risk, level in ((0.02, 0.05), (0.005, 0.0001), (0.3, 1e-6))]
    df = spark.createDataFrame([(n,) for n, _, _ in cases], "n long")
    for n, risk, level in cases:
        got = df.where(F.col("n") == n).select(quality_rules.most_rejections(F.col("n"), risk, F.lit(level))).first()[0]
        total, want = 0.0, -1
        for k in range(n + 1):
            total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                              + k * math.log(risk) + (n - k) * math.log(1 - risk))
            if total > level * (1 + 1e-9):
                break
            want = k
        assert got == want, (n, risk, level)


def test_cutoffs_hold_on_fresh_labels(spark):
    """Random labels: the share of good documents rejected stays near or below the risk in either half."""
    rng = np.random.default_rng(3)
    rows = [(int(i), "s" if i % 3 else "t", int(x)) for i, x in enumerate(rng.exponential(8, 6000))]
    df = spark.createDataFrame(rows, "id long, st string, symbols long")
    for s in quality_rules.SIGNALS:
        if s != "symbols":
            df = df.withColumn(s, F.lit(0).cast("long"))
    cuts = {r._stratum: r.c_symbols for r in quality_rules.controlled_cutoffs(df.where("id % 2 = 0"), "st", 0.04, 0.05).collect()}
    for s, cut in cuts.items():
        if cut is not None:
            assert np.mean([x >= cut for i, t, x in rows if t == s and i % 2]) <= 0.02


def test_jaccard_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, 60))
        for _ in range(9):
            copy = list(base)
            for at in rng.choice(60, rng.integers(0, 5), replace=False):
                copy[at] = f"e{rng.integers(1_000_000)}"
            texts.append(" ".join(copy))
    shared = " ".join(rng.choice(vocabulary, 30))
    texts += [shared + " " + " ".join(rng.choice(vocabulary, int(rng.integers(5, 80)))) for _ in range(60)]
    texts += ["a b c", "A  b\tC", "a b", ""]
    rows = list(enumerate(texts))
    for words, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(
            spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent).collect()}
        sets = []
        for t in texts:
            w = t.lower().split()
            k = min(words, len(w))
            sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
        links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
                 and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        top = brute.join_groups(len(sets), links)
        assert got == {i: (len(s), top[i]) for i, s in enumerate(sets)}


def test_hot_tokens_lose_nothing(spark, monkeypatch):
    """With tokens called hot at once, everything goes through the dense matrix."""
    monkeypatch.setattr(jaccard_join, "HOT", 1)
    texts = [" ".join(["same start of every text here"] * 2 + [f"x{i} y{i} z{i % 4}"] + ["and the same long end of every single text as well"])
             for i in range(40)]
    out = jaccard_join.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=2, percent=60)
    assert {r.component_id for r in out.collect()} == {0}


def test_long_runs_of_a_hot_token_are_cut(spark, monkeypatch):
    """Each pair is counted for every token it shares, whichever cells it is in."""
    monkeypatch.setattr(jaccard_join, "RUN", 16)
    rows = [(g, t) for t, n in ((1, 200), (2, 75), (3, 9)) for g in range(n)]
    cells = jaccard_join.pair_dense(spark.createDataFrame(rows, "gid long, token long"))
    got = {(r.g1, r.g2): r.n for r in cells.groupBy("g1", "g2").agg(F.sum("shared").alias("n")).collect()}
    assert got == {(a, b): 1 + (b < 75) + (b < 9) for b in range(200) for a in range(b)}
    block = np.array([(5, 0, 1, k % 2, k) for k in range(40)])
    assert sum(len(x) for x in jaccard_join._cells(block)) == 400


def said_of(gone, rows):
    return {i: ",".join(map(str, gone.get((i, t), []))) for i, t in rows}


def test_line_dedup_against_all_pairs(spark, docs):
    """The query's parameters: the same lines as by comparing all pairs that share a block; and all pairs, for the exact way."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").where("doc_id < 120").collect()]
    some = docs.where("doc_id < 120")
    common = line_dedup.common_words(some, "doc_id", "text", 5)
    gone, links = brute.removed_lines(rows, flips=line_dedup.FLIPS, bits=line_dedup.LEAST_BITS, common=common)
    assert {r.doc_id: r.removed for r in line_dedup.report(some).collect()} == said_of(gone, rows)
    every, more = brute.removed_lines(rows)
    assert {r.doc_id: r.removed for r in line_dedup.report(some, exact=True).collect()} == said_of(every, rows)
    assert gone and len(links) >= 0.9 * len(more)


def edited_lines():
    rng = np.random.default_rng(11)
    lines = []
    for n in (5, 7, 10, 14, 20, 33):
        for _ in range(5):
            base = [f"v{x}" for x in rng.integers(0, 60, n)]
            lines.append(" ".join(base))
            for _ in range(3):
                copy = list(base)
                for _ in range(int(rng.integers(1, n // 5 + 2))):
                    at = int(rng.integers(0, len(copy)))
                    copy[at:at + 1] = [[], [f"e{rng.integers(99)}"], [copy[at], f"v{rng.integers(60)}"]][int(rng.integers(3))]
                lines.append(" ".join(copy))
    lines += [" ".join("17" if i == a else "42" if i == b else "0" for i in range(9)) for a in range(9) for b in range(9) if a != b]
    return list(enumerate(lines))


def test_edited_lines_are_found_by_the_exact_way(spark, monkeypatch):
    """Every pair within the edit similarity, however far its SimHashes are apart; also with all keys refined."""
    rows = edited_lines()
    want, links = brute.removed_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for big in (line_dedup.BIG, 1):
        monkeypatch.setattr(line_dedup, "BIG", big)
        got = {r.doc_id for r in line_dedup.report(df, exact=True).collect() if r.n_removed}
        assert got == {i for i, _ in want}


def test_hot_blocks_lose_nothing(spark, monkeypatch):
    """With every key called hot, pairs come from the star and the rest outside its groups."""
    rows = edited_lines()
    want, _ = brute.removed_lines(rows, flips=line_dedup.FLIPS, bits=line_dedup.LEAST_BITS)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for dense in (line_dedup.DENSE, 1):
        monkeypatch.setattr(line_dedup, "DENSE", dense)
        assert {r.doc_id for r in line_dedup.report(df).collect() if r.n_removed} == {i for i, _ in want}


def test_short_lines_are_linked_by_equality(spark):
    rows = [(1, "All rights reserved"), (2, "all rights RESERVED!\nmore"), (3, "All rights reserve"), (4, "--\n***"), (5, "--\n***"), (6, "more\nMore")]
    out = {r.doc_id: r.removed for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "", 2: "0", 3: "", 4: "", 5: "", 6: "0,1"}


def test_edits_are_counted_on_the_words(spark, monkeypatch):
    """Words whose codes are equal are still different words."""
    monkeypatch.setattr(line_dedup, "coded", lambda words: F.lpad(F.lit(""), F.size(words), "x"))
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h k l"), (3, "a b c d e f g x y z"), (4, "a b c d e f g h i j j")]
    out = {r.doc_id: r.n_removed for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), exact=True).collect()}
    assert out == {1: 0, 2: 1, 3: 0, 4: 1}


def test_simhash_of_very_long_lines(spark):
    lines = ["a b c d e f", " ".join(f"w{i % 211}" for i in range(20_000)), " ".join(f"w{i % 311}" for i in range(40_000)), "a"]
    df = spark.createDataFrame([(i, x.split(" "), x.count(" ") + 1) for i, x in enumerate(lines)], "i long, w array<string>, size int")
    none = bytes(line_dedup.PLACES)
    got = {r.i: r.sim % 2**64 for r in line_dedup.with_sketches(df, "w", "size", none).collect()}
    assert got == {i: brute.simhash(x) for i, x in enumerate(lines)}
    some = bytes(i % 2 for i in range(line_dedup.PLACES))
    got = {r.i: r.sim % 2**64 for r in line_dedup.with_sketches(df.where("i <> 2"), "w", "size", some).collect()}
    assert got == {i: brute.simhash(lines[i], some) for i in (0, 1, 3)}


def test_secrets_against_plain_expressions(docs):
    rules = [(k, re.compile(p, f), n, g) for k, p, f, n, g in secret_scan.BASE_RULES + secret_scan.ADDED_RULES]
    for r in secret_scan.scan(docs).join(docs, "doc_id").collect():
        spans = sorted((m.start(), i, m.end()) for i, (_, p, n, g) in enumerate(rules) for m in p.finditer(r.text) if len(m[g]) >= n)
        said = [f"{rules[i][0]}:{a}:{b}" for a, i, b in spans]
        assert r.spans == ",".join(said)
        base = ",".join(s for s, (_, i, _) in zip(said, spans) if i < 3)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


@given(st.sampled_from([r[1] for r in secret_scan.BASE_RULES + secret_scan.ADDED_RULES]).flatmap(
    lambda p: st.tuples(st.just(p), st.from_regex(p))))
def test_trigram_queries_miss_no_match(case):
    pattern, text = case
    query = secret_scan.trigram_query(pattern, re.ASCII)
    folded = text.translate(secret_scan._FOLD)
    postings = {t: {0} if t in folded else set() for t in secret_scan.trigrams_of(query)}
    if re.search(pattern, text):
        assert secret_scan.answer(query, postings, {0}) == {0}


def test_licences_survive_spelling_and_layout(spark):
    mit = KNOWN[0][1]
    changed = "Copyright (c) 2024 Some Body\n\n" + mit.upper().replace(",", " ,").replace("SUBLICENSE", "SUB-LICENCE").replace("\n", "  \r\n")
    rows = [(1, mit), (2, changed), (3, mit + " extra"), (4, "text\nLicenced under CC BY-NC 4.0\nReleased under the MIT licence")]
    got = {r.doc_id: (r.license, r.n_notices, r.notices) for r in license_scan.scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MIT", 0, "") and got[2] == ("MIT", 0, "") and got[3] == (None, 0, "")
    assert got[4] == (None, 2, "CC-BY-NC-4.0,MIT")


def test_long_licence_texts_and_usual_notices(spark):
    folder = Path("/usr/share/common-licenses")
    if not (folder / "MPL-2.0").exists():
        pytest.skip("no licence texts here")
    gpl = (folder / "GPL-3").read_text()
    rows = [(1, (folder / "Apache-2.0").read_text()), (2, gpl), (3, gpl[:gpl.index("END OF TERMS")]), (4, (folder / "MPL-2.0").read_text()),
            (5, "# SPDX-License-Identifier: LGPL-2.1-or-later\nThis project is licensed under the MIT License.")]
    got = {r.doc_id: (r.license, r.notices) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == ["Apache-2.0", "GPL-3.0", "GPL-3.0", "MPL-2.0", None]
    assert got[5][1] == "LGPL-2.1,MIT"


def test_leaks_of_edited_copies(spark):
    item = "the quick onyx goblin jumps over a lazy dwarf while seven wizards mix their brew".split()
    edited = list(item)
    edited[3], edited[9] = "elf", "troll"
    rows = [(1, "before " + " ".join(item) + " after"), (2, "noise " * 30 + " ".join(edited[:6] + ["indeed"] + edited[6:])),
            (3, "the quick onyx then something else entirely over a lazy day"), (4, " ".join(reversed(item)))]
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.leaked_pairs(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {1, 2} and got[1] == 1.0
    for i in got:
        assert got[i] == pytest.approx(plain_alignment(item, dict(rows)[i].lower().split()) / len(item), abs=1e-6)
    many = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items.union(items), block_words=1)
    assert many.where("size(leaks) > 0").count() == 2


def test_short_items_are_found_by_any_whole_n_gram():
    """Every third n-gram is the rarest around it; an edit in each leaves other n-grams whole and a score above the limit."""
    item = [f"w{i:02}" for i in range(15)]
    copy = [f"x{i}" if i in (0, 4, 8, 11, 14) else w for i, w in enumerate(item)]
    block = decontaminate.Block([(1, " ".join(item))])
    documents = np.full(len(block.codes), 5)
    documents[block.find(block.grams(block.items[0])[::3], block.codes)] = 1
    block.choose_seeds(documents)
    score = plain_alignment(item, copy) / len(item)
    assert score >= decontaminate.MIN_SCORE
    assert decontaminate.leaks_of(block, [" ".join(copy)]) == [[(1, round(score, 6))]]


def plain_alignment(a, b, penalty=0.5):
    row, best = [0.0] * (len(b) + 1), 0.0
    for x in a:
        new = [0.0]
        for j, y in enumerate(b, 1):
            new.append(max(0.0, row[j - 1] + (1 if x == y else -penalty), row[j] - penalty, new[j - 1] - penalty))
        row, best = new, max(best, *new)
    return best


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    r = toxicity.judge_documents(docs, fit).join(held, "doc_id").agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("rejected").cast("int"))).alias("caught"),
        F.avg(F.when(F.col("toxic") == 0, F.col("rejected").cast("int"))).alias("wrong")).first()
    assert r.caught >= 0.8 and r.wrong <= 0.01


def test_chain_reads_earlier_probabilities():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 8, replace=False)).astype(np.int64) for _ in range(400)]
    first = np.array([float(3 in r) for r in rows])
    model = toxicity.fit(rows, first, np.zeros((400, 0)))
    p = toxicity.predict(model, rows, np.zeros((400, 0)))
    assert ((p > 0.5) == (first == 1)).mean() > 0.99
    chained = toxicity.fit([r[:0] for r in rows], first, p[:, None])
    assert chained["chain"][0] > 1


def test_trust_flows_along_links_and_distrust_against_them(spark):
    edges = spark.createDataFrame([("good", "friend", 2.0), ("good", "other", 1.0), ("shady", "bad", 1.0), ("friend", "good", 1.0)],
                                  "src string, dst string, weight double")
    seeds = spark.createDataFrame([("good", 1.0, 0.0), ("bad", 0.0, 1.0)], "host string, good double, bad double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(edges, seeds, tolerance=1e-12).collect()}
    good = 0.15 / (1 - 0.85 ** 2 * 2 / 3)
    trust = good * (1 + 0.85 * 2 / 3 + 0.85 / 3)             # both walks are shares of their sum
    assert got["good"][0] == pytest.approx(good / trust, rel=1e-6)
    assert got["friend"][0] == pytest.approx(0.85 * 2 / 3 * good / trust, rel=1e-6)
    assert got["shady"] == pytest.approx((0.0, 0.85 / 1.85)) and got["bad"] == pytest.approx((0.0, 1 / 1.85))
    with pytest.raises(RuntimeError):
        url_filter.propagate(edges, seeds, rounds=5, tolerance=1e-12)


def test_distrust_reaches_the_far_end_of_a_chain(spark):
    """Longer than any number of rounds that was fixed before."""
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(45)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h45", 0.0, 1.0)], "host string, good double, bad double")
    got = {r.host: r.distrust for r in url_filter.propagate(edges, seeds).collect()}
    assert set(got) == {f"h{i}" for i in range(46)} and all(got[f"h{i}"] > 0 for i in range(46))
    assert got["h0"] == pytest.approx(got["h45"] * 0.85 ** 45)


def test_links_block_a_host(spark):
    link = '<a class="x" href="https://BAD.example.org/es/1">'
    rows = [(1, "https://shady.net/a", f"{link}{link}<a href='/in'>"), (2, "https://bad.example.org/es/7", ""),
            (3, "https://plain.net/", "<a href=//plain.net/x>")]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


def test_archives_are_plain_frames(spark, tmp_path):
    rows = [(i, f"https://h.net/{i} x%é", "<html>" + "same words " * (i % 5) + "</html>") for i in range(60)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest, folder = warc_store.write_archives(table, f"file://{tmp_path}/warc", archive_bytes=1500)
    names = [r.archive for r in manifest.collect()]
    assert len(names) > 2
    back = {r.page_id: (r.url, r.payload) for r in warc_store.read_archives(manifest, folder).collect()}
    assert {i: u for i, (u, _) in back.items()} == {i: u for i, u, _ in rows}
    assert all(p is None or bytes(p).decode() == rows[i][2] for i, (_, p) in back.items())
    data = (Path(tmp_path) / "warc" / names[0]).read_bytes()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    # another reader: every record is a frame of its own
    raw, rest, records = zstandard.ZstdCompressionDict(data[8:8 + size]), data[8 + size:], 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=raw).decompressobj()
        assert one.decompress(rest).startswith(b"WARC/1.1\r\n") and one.eof
        rest, records = one.unused_data, records + 1
    assert records == {r.archive: r.records for r in manifest.collect()}[names[0]]
    with pytest.raises(ValueError):
        list(warc_store.read_archive(io.BytesIO(data[:-3])))


def test_line_dedup_counts_the_words_of_all_documents(spark, monkeypatch):
    from labelforge.llm import line_dedup as L
    monkeypatch.setattr(L, "SAMPLE", 1, raising=False)          # it used to count one document in number // SAMPLE
    docs = spark.createDataFrame([(i, f"common words here word{i} and{i}\nshort line") for i in range(50)], "doc_id long, text string")
    counts = L.word_counts(docs, "doc_id", "text", 5)
    assert sum(counts.values()) == 250 and sorted(counts.values())[-3:] == [50, 50, 50]


def test_line_dedup_does_not_pair_out_a_large_family(spark):
    from labelforge.llm import line_dedup as L
    words = [f"w{i}" for i in range(39)]
    docs = spark.createDataFrame([(i, " ".join([*words[:-1], f"x{i}"])) for i in range(1200)], "doc_id long, text string")
    lines = L.line_table(docs, "doc_id", "text", 5, 0.8, False).select(*L.FACTS).distinct().persist()
    pairs, dense = L.block_candidates(lines, 0.8, L._near(0.8, False))
    n, listed, held = lines.count(), pairs.count(), dense.count()
    lines.unpersist()
    assert n == 1200 and held > n and listed < n * n / 2 / 4, (n, listed, held)
    assert L.report(docs, "doc_id", "text").agg({"n_removed": "sum"}).first()[0] == n - 1


def test_line_dedup_links_lines_whatever_the_number_of_others(spark, monkeypatch):
    """Which lines are linked does not follow from the size of the table, nor from how large keys are listed."""
    rows = edited_lines()
    want, _ = brute.removed_lines(rows, flips=line_dedup.FLIPS, bits=line_dedup.LEAST_BITS)
    others = [(1000 + i, "\n".join(" ".join(f"{c}{i}x{k}" for c in "qrstuv") for k in range(100))) for i in range(700)]
    df = spark.createDataFrame(rows + others, "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.report(df).collect() if r.n_removed} == {i for i, _ in want}
    monkeypatch.setattr(line_dedup, "WORD", 1, raising=False)
    monkeypatch.setattr(line_dedup, "DENSE", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.report(df).collect() if r.n_removed} == {i for i, _ in want}


def test_components_go_on_with_fewer_edges(spark, monkeypatch):
    """A long chain settles in few rounds, and the rows of all rounds together are a small multiple of its edges."""
    n, made = 1000, []
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    put = type(chain).checkpoint

    def counted(self, *args, **options):
        made.append((out := put(self, *args, **options)).count())
        return out

    monkeypatch.setattr(type(chain), "checkpoint", counted)
    rows = components(chain, max_rounds=12).agg(F.min("component"), F.max("component"), F.count("node")).first()
    assert tuple(rows) == (0, 0, n) and sum(made) < 5 * n, made


def test_joined_components_are_those_of_all_edges(spark):
    from labelforge.llm.common import joined_components
    first, more = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (30, 31), (31, 20), (40, 40), (None, 1)]
    tables = [spark.createDataFrame(e, "a long, b long") for e in (first, more)]
    got = {r.node: r.component for r in joined_components(components(tables[0]), tables[1]).collect()}
    assert got == {r.node: r.component for r in components(tables[0].union(tables[1])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 31: 20, 40: 40}


def test_shared_tokens_are_counted_once_a_pair(spark, monkeypatch):
    """The rows of a pair of groups don't grow with the number of token buckets; the counts are those of all common tokens."""
    rng = np.random.default_rng(3)
    base = rng.choice(1 << 40, 200, replace=False)
    held = {g + 1: np.unique(np.concatenate([base[rng.random(200) < 0.9], rng.choice(1 << 40, 5)])).astype(np.uint64) for g in range(6)}
    rows = [(g, len(t), jaccard_join.pack(t)) for g, t in held.items()]
    groups = spark.createDataFrame(rows, "gid long, entries long, tokens binary")
    for bucket in (10_000, 40):
        monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
        got = [tuple(r) for r in jaccard_join.count_shared(groups).where("g2 IS NOT NULL").collect()]
        sums = {}
        for a, b, n in got:
            sums[a, b] = sums.get((a, b), 0) + n
        assert sums == {(a, b): len(np.intersect1d(held[a], held[b])) for a in held for b in held if a < b}
        assert len(got) <= 2 * 15 + 5, (bucket, len(got))


def test_token_classes_count_all_documents(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SAMPLE", 1, raising=False)          # it used to read one document in number // SAMPLE
    rows = [(i, f"alle aber w{i}") for i in range(64)] + [(64, None), (65, " ")]
    table = np.frombuffer(jaccard_join.token_classes(spark.createDataFrame(rows, "doc_id long, text string"), "text", 2), np.uint8)
    common = int(jaccard_join.shingles("alle aber", 2)[0] % np.uint64(jaccard_join.PLACES))
    assert table[common] == 6 and table.max() == 6                          # 64 // 2 documents have six bits
    assert not np.frombuffer(jaccard_join.token_classes(spark.createDataFrame([], "doc_id long, text string"), "text", 2), np.uint8).any()


def _shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
    return {name for name in held.split(",") if "shuffle_" in name}


def test_finished_steps_leave_no_shuffle_files(spark):
    df = spark.range(5000).select((F.col("id") % 900).alias("k")).groupBy("k").count()
    before = _shuffle_files(spark)
    made = [common.written(df, "some"), common.checkpointed(df.where("k > 3"))]
    for _ in range(50):                                     # they are deleted in the background
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common.SHUFFLES_GO, None) is None
    assert [t.count() for t in made] == [900, 896] and df.count() == 900
    common.discard(made[0])


def test_sketches_lose_no_linked_pair():
    rng, linked, gone = np.random.default_rng(5), 0, 0
    for _ in range(1500):
        a = np.unique(rng.integers(0, 1 << 48, int(rng.integers(1, 400))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.1, 0.5, 0.9, 0.95, 1])],
                                      rng.integers(0, 1 << 48, int(rng.integers(0, len(a) // 5 + 2))).astype(np.uint64)]))
        if not len(b):
            continue
        over = len(np.intersect1d(a, b))
        near = 100 * over >= 80 * (len(a) + len(b) - over)
        x, y = (1, len(a), jaccard_join.sketch(a)), (2, len(b), jaccard_join.sketch(b))
        may = jaccard_join.may_link([x], [y], 80)
        assert may or not near
        assert may == jaccard_join.may_link([y], [(3, 900, b"\0" * 256), x], 80)
        linked, gone = linked + near, gone + (not may)
    assert linked > 200 and gone > 500, (linked, gone)
    assert not jaccard_join.may_link([x], [x], 80)          # a set is no partner of itself


def test_pairs_that_share_a_passage_only_are_not_opened(spark, monkeypatch):
    shared = " ".join(f"p{i}" for i in range(40))
    texts = [f"{shared} " + " ".join(f"w{k}x{i}" for i in range(40)) for k in range(12)]
    texts += [texts[0] + " more", texts[1] + " again"]
    opened, whole = [], jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "verify", lambda pairs, *a: opened.append(pairs.count()) or whole(pairs, *a))
    out = jaccard_join.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=2)
    assert {r.doc_id: r.component_id for r in out.collect()} == {**{i: i for i in range(12)}, 12: 0, 13: 1}
    assert sum(opened) <= 4, opened


def test_keys_of_lines_are_gone_through_in_parts(spark, monkeypatch):
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join([*words[:9 + i % 5], f"x{i % 7}"])) for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup.line_table(df, "doc_id", "text", 5, 0.8, False).where("size >= 5").select(*line_dedup.FACTS).distinct()
    near = line_dedup._near(0.8, False)
    monkeypatch.setattr(line_dedup, "WORD", 3)
    monkeypatch.setattr(line_dedup, "DENSE", 6)
    pairs, dense = line_dedup.block_candidates(lines, 0.8, near)
    monkeypatch.setattr(line_dedup, "KEYS", 10)
    monkeypatch.setattr(line_dedup, "PARTS", 2)
    names, whole = [], line_dedup.written
    monkeypatch.setattr(line_dedup, "written", lambda t, name, **o: names.append(name) or whole(t, name, **o))
    more, held = line_dedup.block_candidates(lines, 0.8, near)
    assert sorted(more.collect()) == sorted(pairs.collect()) and sorted(held.collect()) == sorted(dense.collect()) and dense.count()
    assert names.count("line-words-keys") == 2 and names.count("line-blocks-keys") > 2
