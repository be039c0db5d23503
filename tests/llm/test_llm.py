"""Training-data operators on small tables, against brute force, exact round trips and edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessitura.llm import cotraining, decontaminate, extendible_dedup, kdtree_shards, line_join, lsh_forest, mixing, token_edits, toxicity, warc
from tessitura.llm.common import Scratch, text_buffer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def words(seed, n):
    return list(np.random.default_rng(seed).choice(WORDS, n))


def corpus():
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words(i, 60)), "en", f"s{i % 4}"))
    base = words(7, 60)
    for i in range(40, 52):  # near copies: one word changed
        w = list(base)
        w[i - 40] = f"x{i}"
        rows.append((i, " ".join(w), "en", "hot"))
    for i in range(52, 60):  # exact copies but for white space
        rows.append((i, "\t".join(words(3, 60)) + " " * (i - 52), "de", "hot"))
    rows += [(60, None, None, None), (61, "", "", ""), (62, " \n\t ", "en", "s1"), (63, "one two", "en", "s1"), (64, "one two", "en", "s1"), (65, "ÄÖ é " * 5000, "de", "s2"), (66, "One TWO", "en", "s0")]
    return [(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 mixing


def test_mixing_against_sequential_sharing(docs):
    got = mixing.mix_report(docs).toPandas()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in corpus()}
    by = collections.defaultdict(int)
    for r in corpus():
        by[r[3]] += size[r[0]]
    order = sorted([s for s in by if s is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, rest = dict.fromkeys(by, 0.0), 1.5 * sum(by.values()), set(by)
    while rest:
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        full = {s for s in rest if share[s] > 2 * by[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * by[s]
            left -= 2 * by[s]
        rest -= full
    for r in got.itertuples():
        assert r.size == size[r.doc_id] and r.taken <= 2 * r.size
        assert abs(r.target - target[None if r.source is None or r.source != r.source else r.source]) < 1e-6 * max(1, r.target)
    again = mixing.mix_report(docs.repartition(5)).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_mix_emits_each_document_as_often_as_reported(docs, none):
    times = {r["doc_id"]: r["copies"] for r in mixing.mix_report(docs).collect()}
    out = collections.Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect())
    assert all(out.get(i, 0) == n for i, n in times.items())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


# ---- 2 quality


def test_cotraining_tells_junk_and_uses_both_views(spark):
    rng = np.random.default_rng(0)
    rows, lab = [], []
    for i in range(300):
        junk = i % 3 == 0
        w = words(i, int(rng.integers(20, 80)))
        text = " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)
        rows.append((i, text, "en", "bad" if junk else "good", len(text)))
        if i % 2:
            lab.append((i, int(not junk), 0))
    d = spark.createDataFrame([*rows, (900, None, None, None, None), (901, "", "", "", 0)], DOCS)
    l = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotraining.report(d, l).collect()}
    assert len(got) == 302 and all(0 <= r["quality"] <= 1 for r in got.values())
    held = [i for i in range(300) if got[i]["held_out"]]
    assert held == [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["kept"] == (i % 3 != 0) for i in held]) > 0.95
    assert cotraining.report(d, l.limit(0)).where("quality = 0.5").count() == 302


# ---- 3 near duplicates


def brute_groups(rows, k, threshold):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((find(a), find(b)))
                    comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k", [4])
def test_forest_equals_brute_force(docs, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in lsh_forest.near_groups(docs, k).collect()}
    assert got == brute_groups([(r[0], r[1]) for r in corpus()], k, 80)


def dense_family():
    """500 variants of one text (0.799 at most) and 60 edited copies, each at 0.81 or more to one variant only."""
    rng, codes, copies = np.random.default_rng(5), np.zeros((0, 35), int), []
    while len(codes) < 500:
        c = np.zeros(35, int)
        c[rng.choice(35, 5, replace=False)] = 1
        if not len(codes) or (codes != c).sum(1).min() >= 4:
            codes = np.vstack([codes, c])
    while len(copies) < 60:
        c = codes[int(rng.integers(500))].copy()
        c[rng.choice(35, 3, replace=False)] ^= 1
        if ((codes != c).sum(1) <= 3).sum() == 1 and all((x != c).sum() >= 4 for x in copies):
            copies.append(c)
    for i, c in enumerate([*codes, *copies]):
        w = [f"w{j}" for j in range(146)]
        for s in np.flatnonzero(c):
            w[3 + 4 * s] = f"v{s}"
        if i >= 500:
            w[2] = "z"
        yield i, " ".join(w), "en", "s", 1


@pytest.mark.parametrize("block", [50])
def test_forest_searches_dense_regions_whole(spark, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    base = [f"w{j}" for j in range(146)]
    rows = [*dense_family(), *[(2000 + i, " ".join([*base, f"e{i}"]), "en", "s", 1) for i in range(120)]]  # the last: one large component
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in lsh_forest.near_groups(spark.createDataFrame(rows, DOCS), 4, reach=1).collect()}
    assert got == brute_groups([(r[0], r[1]) for r in rows], 4, 80)


def test_forest_edges(spark, none):
    assert lsh_forest.near_groups(none).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f", "", "", 0), (1, "a b c d e f", "", "", 0), (1, "a b c d e f", "", "", 0)], DOCS)
    got = sorted(tuple(r) for r in lsh_forest.near_groups(d).where("doc_id = 1").collect())
    assert got == [(1, 3, 1, True)] * 2
    assert [tuple(r)[2:] for r in lsh_forest.near_groups(d).where("doc_id IS NULL").collect()] == [(None, True)]


# ---- 4 toxicity


def test_toxicity_learns_words_and_tolerates_insertions(spark):
    bad = ["idiot", "moron", "scumbag"]
    texts, y = [], []
    for i in range(400):
        w = words(i, 40)
        if i % 4 == 0:
            w[i % 40] = bad[i % 3]
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    m = toxicity.fit(texts, np.array(y))
    probe = [" ".join([*words(1000, 20), x]) for x in ("idiot", "i d i o t", "id.iot", "idxiot", "MORON", "pencil", "w7")] + ["", None]
    s = m.score(*text_buffer(pa.array(probe)))
    assert (s[:5] > 0.5).all() and (s[5:] < 0.5).all()
    d = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    l = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    got = toxicity.report(d, l).toPandas()
    held = got[got.held_out]
    assert (held.predicted == [y[i] for i in held.doc_id]).mean() > 0.97
    assert toxicity.reject(d, l).columns == d.columns and toxicity.report(d, l.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.report(d.limit(0), l).count() == 0


# ---- 5 WARC


def test_warc_round_trip_with_magic_in_payloads(spark):
    magic = "WARC/1.1\r\n"
    kinds = [None, "", magic, magic + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" + magic, "é☃" * 60, "\r\n\r\n" + magic * 3 + "W" * 120, "a" * 150, "z" * 99]
    rows = [(i, f"http://x/{i}", kinds[i % len(kinds)]) for i in range(80)] + [(None, None, "a" * 150)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), 25).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first.setdefault(h, i)
    want = []
    for i, _, h in rows:
        b, f = (h or "").encode(), first.get(h)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if f in (None, i) else "revisit", None if f in (None, i) else f))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


# ---- 6 token counts


def test_edit_counts_equal_whole_counts(spark):
    import random

    c, rnd = token_edits.Counter(), random.Random(5)
    for _ in range(150):
        t = token_edits.Tree("".join(rnd.choice("ab 1\n\t'sé .x") for _ in range(rnd.randint(0, 900))), c)
        for _ in range(5):
            a = rnd.randint(0, len(t.text))
            t.edit(a, rnd.choice([a, a + 9, a + 400]), "".join(rnd.choice("ab 1\n's.") for _ in range(rnd.choice([0, 3, 500]))))
            assert t.tokens == len(c.encoding.encode_ordinary(t.text))
            assert "".join(p for b in t.blocks for p in b) == t.text
    long = token_edits.Tree("word " * 50_000, c)
    long.edit(100_000, 100_003, "xyz")
    assert long.reread < 40


def test_count_report(docs, none):
    got = {r["doc_id"]: r for r in token_edits.count_report(docs, check=True).collect()}
    assert len(got) == len(corpus()) and got[60]["tokens"] == 0 and got[61]["tokens"] == 0
    assert token_edits.count_report(none).count() == 0


# ---- 7 lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcde "), int(n))) for n in rng.integers(4, 45, 60)]
    lines = set(base)
    for s in base:
        for _ in range(3):
            t = list(s)
            for _ in range(int(rng.integers(1, 4))):
                at = int(rng.integers(0, len(t) + 1))
                if rng.random() < 0.5 and t:
                    t[at - 1 : at] = [] if rng.random() < 0.5 else ["z"]
                else:
                    t[at:at] = ["y"]
            lines.add("".join(t))
    lines = sorted(x for x in lines if x.strip())
    d = spark.createDataFrame([(i // 5 if i % 11 else None, "\n".join(lines[i : i + 5])) for i in range(0, len(lines), 5)], "doc_id long, text string")
    scratch = Scratch(spark, "test")
    _, _, links = line_join.classify(d, scratch)
    text = {r["id"]: r["line"] for r in spark.read.parquet(scratch.path("texts")).collect()}
    place = {x: i for i, x in enumerate(lines)}
    got = {tuple(sorted((place[text[a]], place[text[b]]))) for a, b in links.collect()}
    limit = lambda n: 0 if n < 10 else 1 if n < 20 else 2
    want = {(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and limit(min(len(a), len(b))) and edit_distance(a, b) <= limit(min(len(a), len(b)))}
    assert got == want and len(want) > 50


def test_dedup_lines(spark, docs, none):
    d = spark.createDataFrame([(1, "a common line of text here\nonly here"), (2, "a common line of text hera\nsecond one\n\n"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_join.dedup_lines(d).collect()}
    assert got == {1: "a common line of text here\nonly here", 2: "second one\n\n", 3: None, 4: ""}
    rep = {r["doc_id"]: tuple(r)[1:] for r in line_join.report(d).collect()}
    assert rep == {1: (2, 0, 1), 2: (2, 1, 1), 3: (0, 0, 0), 4: (0, 0, 0)}
    assert line_join.report(docs).count() == len(corpus()) and line_join.report(none).count() == 0


# ---- 8 decontamination


def test_leaks(spark, docs):
    item = words(900, 30)
    short = words(901, 6)
    b = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, "one two")], "item_id long, text string")
    near = list(item)
    near[1] = "changed"  # 24 of 28 shingles stay
    extra = [(200, " ".join([*words(1, 33), *item, *words(2, 11)])), (201, " ".join([*words(4, 100), *near])), (202, " ".join([*words(5, 9), *item[:12]])), (203, " ".join(short).upper()), (204, " ".join([*item, "x", *item]))]
    d = docs.unionByName(spark.createDataFrame([(i, t, "", "", 0) for i, t in extra], DOCS))
    got = {r["doc_id"]: r for r in decontaminate.report(d, b).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {63, 64, 66, 200, 201, 203, 204}
    assert got[200]["first_item"] == 1 and got[200]["similarity"] == 1.0
    kept = decontaminate.remove(d, b)
    assert kept.columns == d.columns and kept.count() == d.count() - sum(r["contaminated"] for r in got.values())
    assert decontaminate.report(d, b.limit(0)).where("contaminated").count() == 0


# ---- 9 shards


def test_shards_are_even_and_gapless(spark, none):
    rows = [(i, "x" * int(n), "en", "hot" if i % 3 else f"s{i % 5}", int(n)) for i, n in enumerate(np.random.default_rng(1).integers(0, 400, 3000))]
    d = spark.createDataFrame(rows, DOCS).repartition(4)
    got = kdtree_shards.shard_report(d, 40).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 40 and load.max() - load.min() <= 2 * 416 + 0.01 * load.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (got.text_crc32 == [zlib.crc32(rows[i][1].encode()) for i in got.doc_id]).all()
    assert kdtree_shards.shard_report(none, 40).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None)], DOCS).withColumn("shard", F.lit("mine"))
    assert kdtree_shards.shard_report(odd, 4).count() == 2 and kdtree_shards.shard(odd, target_bytes=16).count() == 2


def test_both_walks_agree(spark):
    tree = [kdtree_shards.Node(0, 0, 3, 0, 50, 1, 2), kdtree_shards.Node(1, 0, 1), kdtree_shards.Node(2, 1, 2, 1, 7, 3, 4), kdtree_shards.Node(3, 1, 1), kdtree_shards.Node(4, 2, 1)]
    d = spark.range(100).select(F.col("id").alias("a"), F.pmod("id", F.lit(13)).alias("b"))
    keys = [F.col("a"), F.col("b")]
    assert d.where(kdtree_shards._walk(tree, keys) != kdtree_shards._array_walk(tree, keys)).count() == 0


# ---- 10 exact


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for body, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(body.encode()).hexdigest())
    return out


@pytest.mark.parametrize("weak", [False, True])
def test_exact_equals_brute_force(docs, weak):
    key = (lambda t: F.pmod(F.length(t), F.lit(3)).cast("long") * (1 << 60)) if weak else None
    got = {r["doc_id"]: tuple(r)[1:] for r in extendible_dedup.classes(docs, key, capacity=4).collect()}
    assert got == brute_exact(corpus())
    assert extendible_dedup.keep_one(docs).count() == sum(v[2] for v in brute_exact(corpus()).values())


def test_directory_doubles_only_where_full(spark):
    keys = spark.range(64).select(F.shiftleft(F.col("id"), 50).alias("key")).unionByName(spark.range(1).select(F.lit(-(1 << 62)).alias("key")))
    d = {r["slot"]: r["depth"] for r in extendible_dedup.directory(keys, 8).collect()}
    assert max(d.values()) > min(d.values())
    assert extendible_dedup.exact_report(spark.createDataFrame([], DOCS)).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    item = words(900, 30)
    rows = corpus() + [(300, " ".join([*words(1, 33), *item]), "en", "s1", 9)]
    d = spark.createDataFrame(rows, DOCS)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_near_copies(spark, d, str(tmp_path))
    assert kept.columns == d.columns
    groups = brute_groups([(r[0], r[1]) for r in rows], 4, 80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert 300 not in {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, d, str(tmp_path)).collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pd.unique(out["shard"])) <= set(range(40)) and 300 not in set(out["doc_id"]) and "text" in out
