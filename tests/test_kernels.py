import io
import json
import threading
import time
import wave

import numpy as np
import pytest

from tessitura.functions import kernels as K
from tessitura.functions.profiles import template
from tessitura.operators import analysis as A
from tessitura.plans import governance as G
from tessitura.sources import manifest as M
from tessitura.sources.audio import decode_wav
from tessitura.sources.synthetic import chord, clicks, mixed


def test_click_track():
    b = A.analyze_beats(clicks(120, 20), 44100)
    assert abs(b["global_bpm"] - 120) < 2 and len(b["beats"]) >= 35 and len(b["tempo_segments"]) == 1
    assert {x["position_in_bar"] for x in b["beats"]} == {1, 2, 3, 4}


def test_piecewise_clicks_have_both_tempi():
    b = A.analyze_beats(np.concatenate([clicks(120, 24), clicks(90, 24)]), 44100)
    found = [s["bpm"] for s in b["tempo_segments"]]
    assert any(abs(x - 120) < 4 for x in found) and any(abs(x - 90) < 4 for x in found)
    assert b["multi_tempo"] and b["alternate_coverage"] >= 0.25


def test_onset_alias():
    x = np.zeros(2000)
    x[::30] += 0.65
    x[::45] += 1.0
    assert abs(K.estimate_tempo(x, 44100 / 512)[0] - 172.27) < 3


def test_subharmonics():
    assert K.resolve_subharmonic(30, 1.0, 144.0, 20, 60, {30: 1.0, 40: 0.92}) == 40
    assert K.resolve_subharmonic(32, 1.0, 135.0, 20, 60, {32: 1.0, 42: 0.55}) == 32


def test_display_bpm():
    assert K.display_bpm(122.596, np.arange(64) * 60 / 122.596) in (122.0, 123.0)


def test_alternate_tempo_coverage():
    assert K.alternate_tempo([(0, 40, 120.0), (40, 48, 90.0)], 120.0) is None
    assert K.alternate_tempo([(0, 24, 120.0), (24, 48, 90.0)], 120.0) == (90.0, 0.5)


@pytest.mark.parametrize("cents", [0, 10])
def test_a_major_chord(cents):
    f = 2 ** (cents / 1200)
    k = A.analyze_key(chord([220 * f, 277.18 * f, 329.63 * f], 4), 44100)
    assert k["key"] == {"tonic": "A", "mode": "Major"}


def test_key_change():
    x = np.concatenate([chord([220, 277.18, 329.63], 8, 8000), chord([261.63, 311.13, 392], 8, 8000)])
    k = A.analyze_key(x, 8000, 2048, 1024, 4, 2, 0.0, 0.0, 0.01)
    assert k["segments"][0]["key"]["tonic"] == "A" and k["segments"][-1]["key"] == {"tonic": "C", "mode": "Minor"}
    assert min(abs(s["start_seconds"] - 8) for s in k["segments"]) <= 2 and k["multi_key"]


def test_chroma_argmax_and_rotation():
    v = np.zeros(12)
    v[9], v[0], v[4] = 1, 0.6, 0.6
    assert int(np.argmax(K.key_scores(v))) == 21
    for t in range(12):
        assert K.classify(np.roll(v, t))[0] == 12 + (9 + t) % 12


def test_constant_q_finds_a():
    x = np.sin(2 * np.pi * 440 * np.arange(88200) / 44100)
    assert int(np.argmax(K.constant_q_chroma(x, np.array([44100]), 44100)[0])) == 9


def test_dtft_is_goertzel():
    x = np.random.default_rng(1).normal(size=256)
    f, rate = 440.0, 8000
    c, s1, s2 = 2 * np.cos(2 * np.pi * f / rate), 0.0, 0.0
    for v in x:
        s1, s2 = v + c * s1 - s2, s1
    turn = 2 * np.pi * f / rate * np.arange(256)
    assert np.isclose(s1 * s1 + s2 * s2 - c * s1 * s2, (x @ np.cos(turn)) ** 2 + (x @ np.sin(turn)) ** 2)


def test_silence():
    r = A.analyze_samples(np.zeros(44100 * 4), 44100)
    assert r["beat"]["global_bpm"] is None and r["key"]["key"] is None and r["key"]["segments"] == []


def test_matching_is_one_to_one():
    assert K.match_events([30, 60], [29, 31, 100], 3) == (1, 1, 2)


def test_merge_short_keeps_the_earlier_row():
    assert K.merge_short([[0, 5, 1, 0.1], [5, 30, 2, 0.2], [30, 60, 3, 0.3]], 12) == [[0, 30, 1, 0.1], [30, 60, 3, 0.3]]


def test_peaks():
    x = np.zeros(100)
    x[20], x[50], x[80] = 0.8, 0.9, 0.7
    assert K.pick_peaks(x, 0.3, 441) == [20, 50, 80]


def test_reranker_padding_is_silence():
    w = K.unpack_weights(np.random.default_rng(0).normal(0, 0.1, 21528))
    s = np.linspace(0, 1, 24)
    assert np.allclose(K.rerank(np.zeros((0, 12)), s, w), K.rerank(np.zeros((9, 12)), s, w))
    with pytest.raises(ValueError):
        K.unpack_weights(np.zeros(5))


def test_reranker_silence_once_equals_every_row():
    """Tracks together against the plain forward pass over all 256 rows, from no frames to more than fit."""
    w = K.unpack_weights(np.random.default_rng(5).normal(0, 0.3, 21528))

    def plain(frames, scores):
        norm = lambda v, g, b: (v - v.mean(-1, keepdims=True)) / np.sqrt(v.var(-1, keepdims=True) + 1e-5) * g + b
        x = np.zeros((256, 12))
        x[: len(frames)] = K.l1(np.abs(frames[:256]))
        h = np.array([[w["conv_b"][c] + sum(w["conv"][c, j] * r[(p + j - 1) % 12] for j in range(3)) for c in range(3) for p in range(12)] for r in x]) + w["position"]
        q, k, v = np.split(norm(h, w["n1"], w["n1_b"]) @ w["proj"].T + w["proj_b"], 3, 1)
        ctx = []
        for at in range(0, 36, 9):
            e = np.exp(q[:, at : at + 9] @ k[:, at : at + 9].T / 3)
            ctx.append(e / e.sum(1, keepdims=True) @ v[:, at : at + 9])
        h = h + np.hstack(ctx) @ w["out"].T + w["out_b"]
        h = h + np.maximum(norm(h, w["n2"], w["n2_b"]) @ w["up"].T + w["up_b"], 0) @ w["down"].T + w["down_b"]
        return norm(h.mean(0), w["n"], w["n_b"]) @ w["head"].T + w["head_b"] + w["prior"] @ scores

    rng = np.random.default_rng(6)
    for t in (0, 1, 5, 255, 256, 260):
        f, s = np.abs(rng.normal(size=(5, t, 12))), rng.normal(size=(5, 24))
        f[1] = 0
        want = [plain(a, b) for a, b in zip(f, s)]
        assert np.allclose(K.rerank_all(f, s, w, 2), want, atol=1e-11)
        assert np.allclose(K.rerank(f[0], s[0], w), want[0], atol=1e-11)


def test_reranker_deals_out_one_file(spark):
    """All clips of a file that is one row group, over more than one task, each with the logit of its own forward pass."""
    from tessitura.plans.kernels import reranker_forward
    from tessitura.plans.signals import clips

    d = "/root/testdata/sf0.001"
    df = reranker_forward(spark, d)
    assert clips(spark, d).rdd.getNumPartitions() == 1 < df.rdd.getNumPartitions()
    got = {r["track"]: r for r in df.collect()}
    rows = clips(spark, d).collect()
    assert len(got) == len(rows) == df.count()
    w = K.unpack_weights(np.random.Generator(np.random.PCG64(1729)).normal(0, 0.05, 21528))
    for r in rows[::50]:
        f = np.abs(np.array(r["samples"][:60])).reshape(5, 12)
        want = K.rerank(f, K.key_scores(K.l1(f[0])), w)
        assert abs(got[r["track"]]["logit"] - want.max()) < 1e-11 and got[r["track"]]["key"] == want.argmax()


def test_reranker_cost_is_by_frames():
    """Tracks of five frames take far less than those whose frames fill all 256 rows."""
    w = K.unpack_weights(np.random.default_rng(0).normal(0, 0.1, 21528))
    f, s = np.abs(np.random.default_rng(1).normal(size=(64, 256, 12))), np.zeros((64, 24))
    took = []
    for frames in (f[:, :5], f):
        began = time.process_time()
        K.rerank_all(frames, s, w)
        took.append(time.process_time() - began)
    assert took[0] * 3 < took[1]
    assert template() is template()


def test_wav_downmix():
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.array([32767, -32768, 16384, 16384], "<i2").tobytes())
    x, rate, channels = decode_wav(out.getvalue())
    assert rate == 8000 and channels == 2 and np.allclose(x, [0, 0.5], atol=1e-4)


def test_mixed_track_record(spark):
    from tessitura.plans.kernels import synthetic_analysis

    rows = {r["track_id"]: r for r in synthetic_analysis(spark, "").collect()}
    for bpm in (90, 120, 128):
        assert abs(rows[f"click-{bpm}"]["bpm"] - bpm) < 2 and rows[f"click-{bpm}"]["tonic"] == "A" and rows[f"click-{bpm}"]["error"] is None
    assert len(mixed(90, 1)) == 44100


def test_ledger(tmp_path):
    path = str(tmp_path / "ledger.json")
    assert G.act(path, "f1", "seal", "n", "c1") == "sealed"
    with pytest.raises(G.PolicyError):
        G.act(path, "f1", "evaluate", configuration="c2")
    assert G.act(path, "f1", "evaluate", configuration="c1") == "evaluated"
    assert G.act(path, "f1", "invalidate", reason="leak") == "invalidated"
    with pytest.raises(G.PolicyError):
        G.act(path, "f1", "seal")
    with pytest.raises(G.PolicyError):
        G.act(path, "f2", "seal", blocked=True)
    threads = [threading.Thread(target=G.act, args=(path, f"t{i}", "develop")) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {f"t{i}" for i in range(4)} <= set(G.load(path)["corpora"])


def test_manifest_rules_and_fingerprint(spark, tmp_path):
    seg = lambda a, b: {"start_seconds": a, "end_seconds": b, "key": "C", "confidence": 0.5}
    good = {"id": "a", "path": "a.wav", "expected_bpm": 120.0, "expected_key_segments": [seg(0, 4), seg(4, 8)]}
    bad = {"id": "b", "path": "b.wav", "expected_bpm": -1.0, "expected_key_segments": [seg(0, 5), seg(4, 8)], "change_events": [{"time_seconds": 1.0}]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"version": 1, "tracks": [good, bad]}))
    m = M.read_manifest(spark, str(path))
    assert m.count() == 2
    assert {(r["id"], r["rule"]) for r in M.violations(m).collect()} == {("b", "bpm"), ("b", "key_segments"), ("b", "change_events")}
    moved = {"version": 1, "tracks": [{**good, "path": "elsewhere"}, bad]}
    assert M.fingerprint(moved) == M.fingerprint({"version": 1, "tracks": [good, bad]})


def test_importers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x1.bpm").write_text("# note\n\n128.5\n")
    (tmp_path / "t" / "x2.bpm").write_text("-3\n")
    got = M.read_annotations(spark, str(tmp_path / "t"), "tempo").collect()
    assert [(r["item"], r["value"]) for r in got] == [("x1", 128.5)]
    (tmp_path / "k.csv").write_text('Track ID,Key,Mode\n12,"C#",Minor\n')
    assert M.read_key_table(spark, str(tmp_path / "k.csv")).first().asDict() == {"item": "000012", "key": "C# minor"}
    loops = spark.createDataFrame([("s", "120", False, True), ("s", "120.5", False, True), ("q", "99", False, True)], "sound string, bpm string, discard boolean, well_cut boolean")
    assert [(r["sound"], r["bpm"]) for r in M.consensus(loops).collect()] == [("s", 120.25)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "train")], "id string, v int, split string")
    new = spark.createDataFrame([("a", 2, "x"), ("b", 3, "y")], "id string, v int, split string")
    once = M.upsert(old, new)
    assert {tuple(r) for r in once.collect()} == {("a", 2, "train", "updated"), ("b", 3, "y", "imported")}
    assert {r["action"] for r in M.upsert(once.drop("action"), new).collect()} == {"updated"}
