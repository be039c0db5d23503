"""Manifests evaluated end to end, libraries, predictions, imports and the shape of the analysis record."""

import json
import wave

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import kernels as N
from tessitura.operators import corpus as C
from tessitura.operators import series as S
from tessitura.operators.analysis import ANALYSIS, analyze_samples
from tessitura.plans import corpus as P
from tessitura.plans import governance as G
from tessitura.sources import audio, predictions
from tessitura.sources import manifest as M
from tessitura.streaming.incremental import analyze_arrivals

RATE = 8000


def chord(seconds=30.0, bpm=120.0):
    t = np.arange(int(seconds * RATE)) / RATE
    x = 0.2 * sum(np.sin(2 * np.pi * f * t) for f in (220.0, 277.18, 329.63))
    for at in np.arange(0, seconds, 60 / bpm):
        i = int(at * RATE)
        n = min(128, len(x) - i)
        x[i : i + n] += 0.5 * np.linspace(1, 0, 128)[:n]
    return np.clip(x, -1, 1)


def write_wav(path, x):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((x * 32767).astype("<i2").tobytes())


def aiff(x, channels=1):
    data = np.repeat((x * 32767).astype(">i2"), channels).tobytes()
    rate = (16383 + 12).to_bytes(2, "big") + (RATE << (63 - 12)).to_bytes(8, "big")
    common = channels.to_bytes(2, "big") + (len(x)).to_bytes(4, "big") + (16).to_bytes(2, "big") + rate
    chunk = lambda name, body: name + len(body).to_bytes(4, "big") + body
    body = b"AIFF" + chunk(b"COMM", common) + chunk(b"SSND", bytes(8) + data)
    return b"FORM" + len(body).to_bytes(4, "big") + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    x = chord()
    write_wav(d / "a.wav", x)
    (d / "b.aiff").write_bytes(aiff(x[: 12 * RATE]))
    (d / "c.mp3").write_bytes(b"not decoded")
    one = {"expected_bpm": 120.0, "expected_key": "A major", "expected_key_segments": [{"start_seconds": 0.0, "end_seconds": 30.0, "key": "A major"}]}
    more = {"serato": {"bpm": 60.0, "key": "11B"}, "apple_music_understanding": {"bpm": 121.0, "key": "A major"}, "expected_beats": [{"time_seconds": i * 0.5} for i in range(60)], "expected_tempo_segments": [{"start_seconds": 0.0, "end_seconds": 30.0, "bpm": 121.0}]}
    tracks = [
        {"id": "a", "path": "a.wav", "split": "evaluation", **one, **more}, {"id": "b", "path": str(d / "b.aiff"), "expected_key": "D minor"}, {"id": "c", "path": "c.mp3", "expected_bpm": 90.0},
        {"id": "d", "path": "gone.wav"}, {"id": "e", "path": "a.wav", "expected_key": "H sharp"},
    ]
    (d / "manifest.json").write_text(json.dumps({"version": 1, "tracks": tracks}))
    return d


def test_manifest_end_to_end(spark, folder):
    rows = C.run_manifest(spark, str(folder / "manifest.json")).persist()
    got = {r["id"]: r for r in rows.collect()}
    a = got["a"]
    assert set(got) == set("abcde") and a["error"] is None and abs(a["bpm_absolute_error"]) < 3 and a["tempo_relation"] == "exact"
    assert a["exact_key_match"] and a["key_segment_exact_accuracy"] == 1.0 and a["serato_exact_key_agreement"] and a["apple_music_understanding_exact_key_agreement"]
    assert a["beat_f1"] > 0.5 and a["decode_milliseconds"] > 0 and a["analysis_milliseconds"] > 0 and a["tempo_segment_mean_absolute_error"] is not None
    assert got["b"]["error"] is None and got["b"]["detected_key"] == 9 and not got["b"]["exact_key_match"]
    assert "unsupported audio codec" in got["c"]["error"] and got["d"]["error"] and "H sharp" in got["e"]["error"]
    assert all(got[i]["detected_bpm"] is None for i in "cde")
    s = C.summarize(rows).first().asDict()
    assert s["analyzed_tracks"] == 2 and s["failed_tracks"] == 3 and s["exact_key_accuracy"] == 0.5 and s["tempo_exact"] == 1 and s["beat_f1"] == round(a["beat_f1"], 6)
    assert C.run_manifest(spark, str(folder / "manifest.json"), limit=1).count() == 1
    assert str(folder) not in "".join(str(r) for r in got.values())


def test_analysis_record_has_every_published_field():
    """The closed record of the published schema, version by version."""
    names = {
        "": {"version", "duration_seconds", "beat", "key", "waveform"},
        "beat": {"version", "global_bpm", "display_bpm", "display_bpm_decimals", "confidence", "beats", "tempo_segments", "multi_tempo", "alternate_bpm", "alternate_coverage"},
        "waveform": {"version", "sample_rate", "source_samples", "columns"},
    }
    r = analyze_samples(chord(), RATE, 100)
    assert set(r) == names[""] and set(r["beat"]) == names["beat"] and set(r["waveform"]) == names["waveform"]
    assert (r["version"], r["beat"]["version"], r["key"]["version"], r["waveform"]["version"]) == (1, 4, 7, 1)
    assert set(r["key"]) == {f.name for f in ANALYSIS["key"].dataType.fields} and len(r["key"]["chroma"]) == 12
    assert all(set(c) == {"min", "max", "rms", "display_height", "spectral_centroid"} for c in r["waveform"]["columns"])
    assert all(-1 <= c["min"] <= c["max"] <= 1 and 0 <= c["display_height"] <= 1 and 0 <= c["spectral_centroid"] <= 1 for c in r["waveform"]["columns"])
    assert all(1 <= b["position_in_bar"] <= 4 and b["time_seconds"] >= 0 for b in r["beat"]["beats"])
    assert max(c["display_height"] for c in r["waveform"]["columns"]) == 1.0


def test_waveform_numbers():
    t = np.arange(4096) / 44_100
    assert N.spectral_balance(np.sin(2 * np.pi * 5000 * t), 44_100) > N.spectral_balance(np.sin(2 * np.pi * 120 * t), 44_100)
    assert N.spectral_balance(np.zeros(64), 44_100) == 0.5 and N.spectral_balance(np.ones(1), 44_100) == 0.5
    assert N.display_heights(np.zeros(3), np.zeros(3)).tolist() == [0, 0, 0]


def test_downbeats_follow_activation():
    x = np.zeros(100)
    x[[12, 52, 92]] = 1
    assert N.assign_downbeats(np.arange(0, 100, 10) + 2.0, x, 1, 1).tolist() == [4, 1, 2, 3, 4, 1, 2, 3, 4, 1]
    assert N.assign_downbeats([0.0, 1.0], x, 1, 1).tolist() == [1, 2]


def test_boundaries(spark):
    seg = "array<struct<start_seconds:double,key:string>>"
    m = spark.createDataFrame([("a", [(0.0, "C"), (10.0, "D"), (20.0, "D"), (30.0, "E"), (31.0, None), (32.0, "F")]), ("b", []), ("c", [(0.0, "C"), (5.0, "D")])], f"id string, expected_key_segments {seg}")
    r = spark.createDataFrame([("a", [(0.0, "C"), (12.0, "D"), (28.0, "E"), (60.0, "F")], None), ("b", [(0.0, "C"), (1.0, "D")], None)], f"id string, detected_key_segments {seg}, error string")
    rows = C.boundary_matches(m, r)
    by = {x["id"]: x for x in rows.collect()}
    assert by["a"]["reference_boundaries"] == [10.0, 30.0] and by["a"]["true_positives"] == 2 and by["a"]["false_positives"] == 1 and by["c"]["error"] == "not in the report"
    s = C.boundary_scores(rows).first()
    assert (s["evaluated_tracks"], s["failed_tracks"], s["precision"], s["recall"], s["f1"]) == (2, 1, 0.5, 1.0, 0.666667)
    empty = C.boundary_scores(rows.limit(0)).first()
    assert (empty["precision"], empty["recall"], empty["f1"], empty["true_positives"]) == (0.0, 0.0, 0.0, 0)


def test_greedy_matching_equals_a_plain_scan():
    rng = np.random.default_rng(0)
    for _ in range(100):
        ref, det, tol = rng.integers(0, 40, rng.integers(0, 12)) / 4, rng.integers(0, 40, rng.integers(0, 12)) / 4, float(rng.integers(0, 8)) / 4
        free, hit = list(range(len(det))), 0
        for r in ref:
            near = [(abs(det[i] - r), i) for i in free if abs(det[i] - r) <= tol]
            if near:
                free.remove(min(near)[1])
                hit += 1
        assert N.match_events(ref, det, tol) == (hit, len(ref) - hit, len(free))


def test_predictions_resume(spark, tmp_path):
    out = str(tmp_path / "out.jsonl")
    rows = spark.createDataFrame([("t", "a", 1.0), ("t", "b", None)], "tool string, track_id string, detected_bpm double")
    predictions.append_predictions(rows, out)
    predictions.append_predictions(rows.unionByName(spark.createDataFrame([("u", "a", 2.0)], rows.schema)), out)
    (tmp_path / "more.jsonl").write_text('{"tool": "v", "track_id": "z"}\n\nnot json\n')
    got = predictions.read_predictions(spark, out, str(tmp_path / "more.jsonl")).collect()
    assert sorted((r["tool"], r["track_id"]) for r in got if r["error"] is None) == [("t", "a"), ("t", "b"), ("u", "a"), ("v", "z")]
    assert [r["error"] for r in got if r["error"]] == ["not a JSON object"]
    predictions.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 2


def test_imports(spark, tmp_path):
    (tmp_path / "annotations" / "tempo").mkdir(parents=True)
    assert M.find_annotations(spark, str(tmp_path), "tempo").endswith("annotations/tempo")
    with pytest.raises(FileNotFoundError):
        M.find_annotations(spark, str(tmp_path), "table")
    items = spark.createDataFrame([("000001",), ("000002",), ("123456",)], "item string")
    files = spark.createDataFrame([("000001.mp3",), ("123/123456.mp3",), ("123456.mp3",)], "path string")
    got = {r["item"]: (r["path"], r["found"]) for r in M.audio_paths(items, files, nested=True).collect()}
    assert got == {"000001": ("000001.mp3", True), "000002": ("000002.mp3", False), "123456": ("123/123456.mp3", True)}
    old, new = spark.createDataFrame([("a", "x", "s")], "id string, v string, split string"), spark.createDataFrame([("a", "y", None), ("b", "z", None)], "id string, v string, split string")
    up = M.upsert(old, new)
    assert M.import_counts(up, 5, 2, 1) == {"imported": 1, "updated": 1, "skipped": 3, "missing_audio": 1}
    assert M.delete_tracks(old, new).count() == 0 and M.track_paths(new, old.withColumn("path", F.lit("p"))).orderBy("id").collect()[1]["path"] is None


def test_saved_manifests_are_valid(spark, tmp_path):
    path = str(tmp_path / "m.json")
    M.save_manifest(spark, {"version": 1, "tracks": [{"id": "a", "path": "a.wav", "serato": {"bpm": 120.0}}]}, path)
    assert M.read_manifest(spark, path).first()["serato"]["bpm"] == 120.0
    for bad in ({"serato": {"bpm": -1.0}}, {"serato": {"beat_grid_seconds": [2.0, 1.0]}}, {"path": ""}, {"change_events": [{"time_seconds": 1.0}]}):
        with pytest.raises(ValueError):
            M.save_manifest(spark, {"version": 1, "tracks": [{"id": "a", "path": "a.wav", **bad}]}, path)
    with pytest.raises(ValueError):
        M.save_manifest(spark, {"version": 2, "tracks": []}, path)
    assert len(M.file_digest(path)) == 64


def test_interval_joins_equal_all_pairs(spark):
    rng = np.random.default_rng(3)

    def segments(seed):
        out = []
        for track in range(4):
            at = 0.0
            for i in range(int(rng.integers(1, 40))):
                n = float(rng.choice([0.0, 0.1, 1.0, 5.0, 200.0]))
                out.append((track, i, at, at + n, int(rng.integers(0, 3))))
                at += n
        return out

    a, b = segments(1), [(t, i, s + 0.3, e + 0.9, k) for t, i, s, e, k in segments(2)]
    schema = "track int, idx int, start_s double, end_s double, key_idx int"
    ref, det = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = sorted((x[0], x[1], y[1]) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2]))
    assert sorted(tuple(r) for r in S.overlap_pairs(ref, det).select("r.track", "r.idx", "d.idx").collect()) == want
    first = {}
    for x in a:
        hit = [y[1] for y in b if y[0] == x[0] and y[2] <= (x[2] + x[3]) / 2 < y[3]]
        if hit:
            first[x[0], x[1]] = min(hit)
    got = S.midpoint_pairs(ref.withColumn("value", F.col("idx")), det.withColumn("value", F.col("idx")))
    assert {(r["track"], r["idx"]): r["d_value"] for r in got.collect()} == first


def test_arrivals_keep_error_rows(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    write_wav(tmp_path / "in" / "x.wav", chord(5.0))
    (tmp_path / "in" / "y.flac").write_bytes(b"no")
    query = analyze_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), 50)
    query.awaitTermination(120)
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert len(got) == 2 and sum(r["error"] is None for r in got) == 1


def test_aiff_equals_wav(folder):
    x, rate, channels = audio.decode_aiff(aiff(chord(1.0), 2))
    assert rate == RATE and channels == 2 and np.abs(x - chord(1.0)).max() < 1e-3
    for bad in (b"", b"FORM" + bytes(20), aiff(np.zeros(0))):
        with pytest.raises(ValueError):
            audio.decode_aiff(bad)


def test_a_sealed_corpus_is_evaluated_once_configured(tmp_path):
    manifest, config, policy, ledger, receipt = (str(tmp_path / n) for n in ("m.json", "c.json", "p.json", "l.json", "r/receipt.json"))
    M.save_json({"version": 1, "tracks": [{"id": "own-1", "path": "a.wav"}, {"id": "x", "path": "b.wav", "source": {"name": "Known"}}]}, manifest)
    M.save_json({"a": 1}, config)
    M.save_json({"development_corpora": [{"name": "dev", "id_prefixes": ["dev-"]}, {"name": "known", "source_names": ["Known"]}]}, policy)
    with pytest.raises(G.PolicyError, match="known"):
        G.seal(ledger, manifest, "c", config, policy)
    M.save_json({"development_corpora": [{"name": "dev", "id_prefixes": ["dev-"]}]}, policy)
    with pytest.raises(G.PolicyError):
        G.authorize(ledger, manifest, "c", "evaluation", config)
    corpus = G.seal(ledger, manifest, "c", config, policy, receipt)
    assert json.load(open(receipt))["corpus_sha256"] == corpus and G.authorize(ledger, manifest, "c", "evaluation", config) == corpus
    with pytest.raises(G.PolicyError):
        G.seal(ledger, manifest, "c", config, policy)
    M.save_json({"a": 2}, config)
    with pytest.raises(G.PolicyError):
        G.authorize(ledger, manifest, "c", "evaluation", config)
    assert G.checked_model(config, M.file_digest(config)) == config
    with pytest.raises(G.PolicyError):
        G.checked_model(config, "0" * 64)


def test_long_ids_keep_their_own_files(spark, tmp_path):
    """Keys of more than six digits whose items are equal, odd line numbers and a null: as the SQL has them."""
    duck = duckdb.connect()
    duck.sql(f"COPY (SELECT * FROM (VALUES (100000), (1000001), (1000002), (7), (8), (9), (NULL)) t(p_partkey)) TO '{tmp_path}/part.parquet'")
    lines = "(100000, 1, 40.0), (1000001, 2, 40.0), (1000002, 1, 3.0), (7, 4, 31.0), (7, 1, 31.0), (8, NULL, 31.0), (9, -1, 31.0), (NULL, 2, 31.0)"
    duck.sql(f"COPY (SELECT * FROM (VALUES {lines}) t(l_partkey, l_linenumber, l_quantity)) TO '{tmp_path}/lineitem.parquet'")
    for t in ("part", "lineitem"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    key = lambda r: tuple(map(str, r))
    got = P.import_paths(spark, str(tmp_path)).select("item", "path", "found").collect()
    assert sorted(map(key, got)) == sorted(map(key, duck.sql(P.ORACLE["import_paths"]).fetchall()))
    assert sorted(map(key, got))[3:6] == [("100000", "100/100000.mp3", "True"), ("100000", "100000.mp3", "False"), ("100000", "100000.mp3", "True")]


def test_key_table_pads_and_keeps_long_ids(spark, tmp_path):
    (tmp_path / "keys.csv").write_text("Track ID,Key and Mode\n 12,A minor\n1234567,C major\n")
    assert {tuple(r) for r in M.read_key_table(spark, str(tmp_path / "keys.csv")).collect()} == {("000012", "A minor"), ("1234567", "C major")}
