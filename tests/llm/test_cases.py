"""Edge cases of the training-data operators: repeated rows, ties, nulls, long words, clashing columns; and brute-force forms."""

import collections
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessitura.llm import cotraining, decontaminate, extendible_dedup, kdtree_shards, line_join, lsh_forest, mixing, token_edits, toxicity, warc
from tessitura.llm.common import Scratch, one_row_each, shared_dir, shingle_sets, text_buffer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def words(seed, n):
    return list(np.random.default_rng(seed).choice([f"w{i}" for i in range(400)], n))


def made(spark, rows):
    """(doc_id, text) rows as documents."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


# ---- shared pieces


def test_long_words_whose_blocks_change_places_differ():
    a, b = shingle_sets(*text_buffer(pa.array(["a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096])), 4)
    assert a.tolist() != b.tolist()
    x, y, z = shingle_sets(*text_buffer(pa.array(["x y " + "a" * 9000 + " z w", "X y\t" + "A" * 9000 + " z w ", "x y " + "a" * 9001 + " z w"])), 4)
    assert x.tolist() == y.tolist() != z.tolist()


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_one_row_each(spark):
    d = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, "a", 5), (None, "b", 5), (2, "c", 5)], "k long, v string, __row long")
    assert rows_of(one_row_each(d, ["k"]).select("k", "__row")) == collections.Counter({(1, 5): 1, (None, 5): 1, (2, 5): 1})


# ---- 1 mixing


def test_rows_without_id_draw_by_their_text(spark):
    d = spark.createDataFrame([(None, f"text number {i}", "en", f"s{i % 3}", 9) for i in range(3000)], DOCS)
    r = mixing.mix_report(d).toPandas()
    for _, g in r.groupby("source"):
        assert abs(g.taken.sum() / g.target.iloc[0] - 1) < 0.1
    assert len(set(r.copies)) > 1 and mixing.mix(d).count() == r.copies.sum()


# ---- 2 quality


def two_sided():
    """Texts whose junk both views tell; 20 labels, 400 without."""
    rng, rows, labels = np.random.default_rng(2), [], []
    for i in range(500):
        junk = i % 2 == 0
        text = " ".join((x.upper() + "!!") if junk else x for x in words(i, int(rng.integers(20, 60))))
        rows.append((i, text, "en", "bad" if junk else "good", 100))
        if i < 100:
            labels.append((i, int(not junk), 0))
    return rows, labels


def test_views_teach_each_other_from_every_unlabelled_document(spark):
    rows, labels = two_sided()
    d, l = spark.createDataFrame([*rows, *rows[400:]], DOCS), spark.createDataFrame(labels, LABELS)
    _, told = cotraining.train(d, l)
    free = sum(1 for i in [*range(100, 500), *range(400, 500)] if not __import__("zlib").crc32(str(i).encode()) % 5 == 0)
    assert told[-1][:2].sum() == free and told[-1][2:].sum() == free
    model, _ = cotraining.train(d, l)
    assert np.abs(model.lent_text).sum() > 0 and np.abs(model.lent_meta).sum() > 0


def test_quality_of_odd_rows(spark):
    rows, labels = two_sided()
    odd = [(None, "w1 w2", "en", "good", None), (900, None, None, None, None), (901, "", "", "", -5), (902, "LONG!! " * 60_000, "en", "bad", 1), (3, rows[3][1], "en", "good", 100)]
    d = spark.createDataFrame([*rows, *odd], DOCS).withColumn("label", F.lit("mine"))
    l = spark.createDataFrame([*labels, (1, 0, 0), (None, 1, 1), (2, None, None)], LABELS)
    got = cotraining.report(d, l).toPandas()
    assert len(got) == 505 and got.quality.between(0, 1).all() and got[got.doc_id == 3].quality.nunique() == 1
    assert not got[got.doc_id == 902].kept.iloc[0]
    assert cotraining.report(d.limit(0), l).count() == 0
    assert cotraining.report(d.drop("n_chars"), l.limit(0)).where("quality = 0.5").count() == 505


# ---- 3 near duplicates


def test_a_repeated_doc_id_ties_its_texts(spark):
    a, b, c = (" ".join(words(s, 50)) for s in (1, 2, 3))
    d = made(spark, [(3, a), (3, b), (5, b), (1, a + " x"), (7, c), (7, c), (8, ""), (8, c), (None, a), (None, a)])
    got = collections.defaultdict(set)
    for r in lsh_forest.near_groups(d).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert got[3] == {1} and got[5] == {1} and got[1] == {1} and got[7] == {7} and got[8] == {7, 8} and got[None] == {None}
    kept = [(r["doc_id"], r["text"]) for r in lsh_forest.keep_one(d.withColumn("id", F.lit(1)).withColumn("kept", F.lit(2))).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a + " x"), (7, c), (None, a), (None, a)]))


def template_family(spark):
    """A region of 800 documents that share a template and 200 edited copies at 0.80 to 0.83."""
    rng, rows = random.Random(3), []
    base = [f"t{j}" for j in range(120)]
    for i in range(800):
        w = list(base)
        for j in rng.sample(range(0, 120, 5), 6):
            w[j] = f"v{i}-{j}"
        rows.append((i, w))
    for i in range(200):
        w = list(rows[i * 4][1])
        for j in rng.sample(range(2, 118), 3):
            w[j] = f"e{i}-{j}"
        rows.append((1000 + i, w))
    return [(i, " ".join(w)) for i, w in rows]


def test_dense_regions_lose_no_link(spark):
    rows = template_family(spark)
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    ids, root = list(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.near_groups(made(spark, rows)).collect()}
    assert got == {i: find(i) for i in ids}


# ---- 4 toxicity


def insults():
    bad = ["idiot", "moron", "дурак"]
    return [(i, " ".join([*words(i, 30), *([bad[i % 3]] if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(300)]


def test_toxicity_of_odd_rows(spark):
    rows = insults()
    odd = [(None, "you idiot"), (1, "w1 w2"), (1, "w1 w2"), (400, None), (401, ""), (402, "pencil " * 40_000 + "idiot"), (403, "дурак w3"), (404, "думал w3 w4")]
    d = made(spark, [*[(i, t) for i, t, _ in rows], *odd]).withColumn("score", F.lit("mine"))
    l = spark.createDataFrame([*[(i, 1, y) for i, _, y in rows], (0, 1, 0), (None, 1, 1), (5, None, None)], LABELS)
    got = toxicity.report(d, l).toPandas()
    by = got.groupby("doc_id").score.max()
    assert len(got) == 308 and got.score.between(0, 1).all()
    assert got[got.doc_id.isna()].predicted.iloc[0] == 1 and by[403] > 0.5 > by[404] and by[401] < 0.5 and by[400] < 0.5
    stay = toxicity.reject(d, l)
    assert stay.columns == d.columns and set(r["score"] for r in stay.select("score").distinct().collect()) == {"mine"}
    assert stay.count() == (got.predicted == 0).sum()
    again = toxicity.report(d.repartition(3), l.repartition(2)).toPandas()
    assert sorted(zip(got.doc_id.fillna(-1), got.score)) == sorted(zip(again.doc_id.fillna(-1), again.score))


# ---- 5 WARC


def test_repeated_pages_and_extra_columns(spark):
    rows = [(1, "u", "q" * 150), (1, "u", "q" * 150), (1, "b", "r" * 150), (1, "a", "r" * 150), (None, None, "n" * 150), (None, "x", "n" * 150), (2, "u", "q" * 150), (3, None, None), (3, None, None), (4, "z", "z" * 99), (5, "z", "z" * 99)]
    d = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, digest string")
    c = duckdb.connect()
    pages = pd.DataFrame({"page_id": pd.array([r[0] for r in rows], dtype="Int64"), "url": [r[1] for r in rows], "html": [r[2] for r in rows]})
    c.register("pages", pages)
    got = rows_of(warc.round_trip(d))
    assert got == collections.Counter(c.sql(warc.REPORT_SQL).fetchall())
    assert sum(n for r, n in got.items() if r[3] == "response" and r[1] >= 100) == 3
    assert warc.round_trip(d.limit(0)).count() == 0


# ---- 6 token counts


def test_token_counts_of_repeated_rows(spark):
    d = made(spark, [(1, "one two"), (1, "one two"), (None, "one two"), (2, None)])
    got = token_edits.count_report(d).toPandas()
    assert len(got) == 4 and got[got.doc_id == 1].tokens.nunique() == 1


# ---- 7 lines


def test_hot_and_repeated_lines(spark):
    hot = "a very common line that many documents share"
    rows = [(i, f"{hot}\nown line number {i * 7919} of document {i}") for i in range(300)] + [(None, hot), (5, hot), (7, f"own line number {7 * 7919} of document 7")]
    d = made(spark, rows).withColumn("line", F.lit(1))
    got = line_join.report(d).toPandas()
    assert len(got) == 303 and got[got.doc_id == 0].dropped_lines.iloc[0] == 0 and (got[got.doc_id.between(8, 299)].dropped_lines >= 1).all()
    text = line_join.dedup_lines(d).toPandas().text
    assert sum(hot in t for t in text) == 1


def test_letters_only_part_lines_that_are_apart(spark):
    rnd = random.Random(1)
    pairs = []
    for _ in range(300):
        a = "".join(rnd.choice("etaoinsrhldcumpg xyz") for _ in range(rnd.randint(20, 300)))
        b = list(a)
        for _ in range(2):
            p = rnd.randrange(len(b))
            b[p : p + rnd.randint(0, 1)] = rnd.choice(["", "e", "z", "g"])
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select(line_join.letters_apart(line_join.letter_counts(F.col("a")), line_join.letter_counts(F.col("b"))).alias("gap"), F.levenshtein("a", "b").alias("d"))
    assert got.where("gap > 2 * d").count() == 0


# ---- 8 decontamination


def leaks(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, [rnd.choice(vocabulary) for _ in range(n)]) for i, n in enumerate([3, 1, 2, 4, 5, 6, 8, 12, 20, 30, 45, 60])]
    items[1] = (1, ["unique"])
    items.append((20, items[8][1][:10] + items[9][1][10:]))

    def edited(w):
        w = list(w)
        kind = rnd.choice(["none", "turn", "swap", "insert", "delete", "change", "cut"])
        at = rnd.randrange(len(w))
        if kind == "turn":
            w = w[at:] + w[:at]
        elif kind == "swap" and at:
            w[at - 1], w[at] = w[at], w[at - 1]
        elif kind == "insert":
            w.insert(at, "zz")
        elif kind == "delete" and len(w) > 2:
            del w[at]
        elif kind == "change":
            w[at] = "yy"
        elif kind == "cut":
            w = w[rnd.randrange(3) : len(w) - rnd.randrange(3)]
        return w

    rows = []
    for i in range(120):
        w = edited(rnd.choice(items)[1])
        if rnd.random() < 0.8:
            w = [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))] + w + [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))]
        rows.append((i if i % 9 else (None if i % 2 else 7), " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    return items, rows + [(900, None), (901, ""), (None, None), (902, " "), *rows[:3]]


def brute_leaks(items, rows, k=5, threshold=0.8):
    """Every window of every text against every item."""
    cut = lambda w, n: [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]

    def one(text):
        w, out = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()), {}
        for i, item in items:
            kk = min(k, len(item))
            a, b = collections.Counter(cut(item, kk)), cut(w, kk)
            s = len(item) - kk + 1
            for start in ([0] if len(b) < s else range(len(b) - s + 1)) if b else []:
                c = collections.Counter(b[start : start + s])
                both = sum((a & c).values())
                alike = both / (s + min(s, len(b)) - both)
                if alike >= threshold - 1e-12:
                    out[i] = max(out.get(i, 0), alike)
        return out

    found = collections.defaultdict(dict)
    key = lambda d, t: (d, None) if d is not None else (None, t)
    for d, t in rows:
        for i, alike in one(t).items():
            found[key(d, t)][i] = max(found[key(d, t)].get(i, 0), alike)
    out = []
    for d, t in rows:
        hit = found[key(d, t)]
        best = max(((round(v, 6), -i) for i, v in hit.items()), default=(None, None))
        out.append((d, bool(hit), len(hit), None if best[1] is None else -best[1], best[0]))
    return out


def test_every_window_against_brute_force(spark):
    items, rows = leaks(4)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("k0", F.lit("mine"))
    b = spark.createDataFrame([*[(i, " ".join(w)) for i, w in items], (50, None), (51, ""), (5, " ".join(items[5][1]))], "item_id long, text string")
    want = brute_leaks(items, rows)
    assert sum(x[1] for x in want) > 30
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in decontaminate.report(d, b).collect())
    kept = decontaminate.remove(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not x[1] for x in want)


# ---- 9 shards


def test_equal_rows_are_parted_and_reruns_agree(spark):
    rows = [(7 if i < 1000 else i, "same text here", "en", "s", i % 2) for i in range(3000)] + [(None, None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS).repartition(6)
    a, b = kdtree_shards.shard_report(d, 40).toPandas(), kdtree_shards.shard_report(d.repartition(3), 40).toPandas()
    load = a.groupby("shard")["size"].sum()
    assert len(load) == 40 and load.max() - load.min() <= 2 * 30
    assert sorted(map(str, a.itertuples(index=False))) == sorted(map(str, b.itertuples(index=False)))
    out = kdtree_shards.shard(d.withColumn("shard", F.lit("mine")), 40)
    assert out.columns == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "shard", "shard_", "slot"]
    assert rows_of(out.select(*d.columns)) == rows_of(d) and out.select("shard_", "slot").distinct().count() == 3001


# ---- 10 exact


@pytest.mark.parametrize("weak", [None, lambda t: F.length(t).cast("long"), lambda t: F.shiftleft(F.pmod(F.xxhash64(t), F.lit(7)), 60)])
def test_repeated_rows_stay_once(spark, weak):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, "", " ", "a b", "ab", "a  b", "abc", "xyz\n", *[f"t{i}" for i in range(30)]])) for _ in range(250)]
    d = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, key string").repartition(4)
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "text": [r[1] for r in rows]}))
    assert rows_of(extendible_dedup.classes(d, weak, capacity=2)) == collections.Counter(c.sql(extendible_dedup.REPORT_SQL).fetchall())
    kept = extendible_dedup.keep_one(d, weak, capacity=2)
    bare = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert kept.columns == d.columns and len(bare) == len(set(bare)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows})


def test_buckets_split_until_they_fit():
    rnd = random.Random(2)
    loads = {rnd.randrange(1 << 16): rnd.randrange(1, 40) for _ in range(3000)}
    got = extendible_dedup.grow_directory(loads, 100)
    held = collections.Counter()
    for slot, bucket, depth in got:
        held[bucket, depth] += loads[slot]
        assert slot >> (16 - depth) == bucket >> (16 - depth)
    assert sorted(s for s, _, _ in got) == sorted(loads) and max(held.values()) <= 100 and len(held) > 100


# ---- pipeline


def test_pipeline_of_nothing(spark, tmp_path):
    made(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
