"""Whole corpora from folders of files: lines, lists, JSON, arrays and WAV as they would lie on disk."""

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.operators.dialog import without_words
from turnweave.plans import batch
from turnweave.sources import builders, corpora, dialogs, files, sinks


def wav(path, n=800, rate=8000, channels=2):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.arange(n * channels) % 100 * 100).astype("<i2").tobytes())


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_switchboard(spark, tmp_path):
    for s in ("2001", "2002"):
        wav(tmp_path / f"audio/d1/sw0{s}.wav")
        for ch in "AB":
            put(tmp_path / f"text/{s}/sw{s}{ch}-ms98-a-word.text", f"{s}{ch}1 0.0 0.5 hello\n{s}{ch}1 0.6 1.0 [laughter-you]\n{s}{ch}2 2.0 3.0 [noise]\n")
            put(tmp_path / f"text/{s}/sw{s}{ch}-ms98-a-trans.text", f"{s}{ch}1 0.0 1.0 hello [laughter-you]\n{s}{ch}2 2.0 3.0 [noise]\n")
    put(tmp_path / "train.txt", "2001\n\n"), put(tmp_path / "val.txt", " 2002 \n")
    lists = {"train": str(tmp_path / "train.txt"), "validation": str(tmp_path / "val.txt")}
    c = builders.switchboard(spark, str(tmp_path / "text"), str(tmp_path / "audio"), lists)
    got = {r["session"]: (r["split"], r["audio_path"]) for r in c.sessions.collect()}
    assert got == {"2001": ("train", f"{tmp_path}/audio/d1/sw02001.wav"), "2002": ("validation", f"{tmp_path}/audio/d1/sw02002.wav")}
    u = c.utterances.orderBy("session", "channel").collect()
    assert [(r["session"], r["channel"], r["text"], r["start"], r["end"], len(r["words"])) for r in u][0] == ("2001", 0, "hello you", 0.0, 1.0, 2) and len(u) == 4
    assert c.segments.count() == 8
    put(tmp_path / "paths.json", json.dumps({"2001": "x/sw02001", "2002": "y/sw02002"}))
    p = builders.switchboard(spark, str(tmp_path / "text"), "/a", lists, str(tmp_path / "paths.json")).sessions
    assert {r["audio_path"] for r in p.collect()} == {"/a/x/sw02001.wav", "/a/y/sw02002.wav"}
    put(tmp_path / "means.json", json.dumps({"2001": [110.5, 200.0]}))
    assert sorted(tuple(r) for r in dialogs.speaker_means(spark, str(tmp_path / "means.json")).collect()) == [("2001", 0, 110.5), ("2001", 1, 200.0)]
    slim = without_words(c.utterances.select(F.array(F.struct("text", "words")).alias("dialog"))).first()["dialog"][0]
    assert slim.asDict() == {"text": "hello you"}
    info = builders.audio_table(spark, str(tmp_path / "audio")).collect()
    assert {(r["sample_rate"], r["num_frames"], r["num_channels"], r["duration"]) for r in info} == {(8000, 800, 2, 0.1)} and len(info) == 2


def test_fisher_and_callhome(spark, tmp_path):
    put(tmp_path / "f/fe_03_p1_tran/data/trans/000/fe_03_00001.txt", "# fe_03_00001.sph\n\n0.5 1.5 A: hi\n1.6 2.0 B: yes\n")
    c = builders.fisher(spark, str(tmp_path / "f"))
    assert [tuple(r) for r in c.utterances.orderBy("utt_idx").select("session", "channel", "text").collect()] == [("00001", 0, "hi"), ("00001", 1, "yes")]
    first = c.sessions.where("session = '00001'").first()
    assert (first["split"], first["transcript_path"]) == ("train", f"{tmp_path}/f/fe_03_p1_tran/data/trans/000/fe_03_00001.txt")
    wav(tmp_path / "c/evltest/en_1.wav"), wav(tmp_path / "c/train/en_2.wav")
    put(tmp_path / "t/evaltest/en_1.txt", "10.0 11.0 A: well\n11.5 12.0 A: so {breath}\n12.0 13.0 B: yes\n")
    c = builders.callhome(spark, str(tmp_path / "c"), str(tmp_path / "t"))
    got = {r["session"]: (r["split"], (r["transcript_path"] or "")[-14:]) for r in c.sessions.collect()}
    assert got == {"en_1": ("test", "altest/en_1.txt"[-14:]), "en_2": ("train", "")}
    assert [tuple(r) for r in c.utterances.orderBy("utt_idx").select("session", "channel", "start", "end", "text").collect()] == [("en_1", 0, 10.0, 12.0, "well so "), ("en_1", 1, 12.0, 13.0, "yes")]


def test_vacation(spark, tmp_path):
    for s in ("i1", "i2"):
        put(tmp_path / f"dialogs/{s}.json", json.dumps({"turns": [{"name": "agent", "start_time": 0.0, "end_time": 1.0, "utterance": "wohin?"}]}))
    wav(tmp_path / "audio/i1.wav")
    lists = spark.createDataFrame([("i1", [[[0.123, 1.0]], [[2.0, 2.556]]])], "session string, vad array<array<array<double>>>")
    sinks.write_vad(lists, str(tmp_path / "out"))
    written = next((tmp_path / "out/session=i1").glob("part*")).read_text()
    assert json.loads(written) == [[[0.12, 1.0]], [[2.0, 2.56]]]
    put(tmp_path / "vad/i1.json", written)
    c = builders.vacation(spark, str(tmp_path))
    assert {(r["session"], r["audio_exists"]) for r in c.sessions.select("session" if "session" in c.sessions.columns else F.regexp_extract("audio_path", r"(\w+)\.wav$", 1).alias("session"), "audio_exists").collect()} == {("i1", True), ("i2", False)}
    assert c.utterances.count() == 2 and [tuple(r) for r in c.segments.orderBy("channel").collect()] == [("i1", 0, 0, 0.12, 1.0), ("i1", 1, 0, 2.0, 2.56)]


def test_read_speech(spark, tmp_path):
    put(tmp_path / "l360/7/8/7-8.trans.txt", "7-8-0000 FIRST LINE\n7-8-0001 SECOND\n"), put(tmp_path / "l100/1/2/1-2.trans.txt", "1-2-0000 OTHER\n")
    roots = {"train.360": str(tmp_path / "l360"), "train.100": str(tmp_path / "l100")}
    one = builders.librispeech(spark, roots, "train").sessions
    assert sorted(r["text"] for r in one.collect()) == ["FIRST LINE", "SECOND"] and one.columns == ["id", "file", "text", "dataset_name", "split"]
    assert builders.librispeech(spark, roots, "train", "clean").sessions.count() == 3
    for p in ("p280", "p300", "p301", "p302"):
        put(tmp_path / f"v/wav/{p}_001_mic2.flac", "fLaC"), put(tmp_path / f"v/wav/{p}_001_mic1.flac", "fLaC"), put(tmp_path / f"v/txt/{p}_001.txt", f"said by {p}\n")
    v = {r["speaker_id"]: (r["split"], r["text"]) for r in builders.vctk(spark, str(tmp_path / "v")).sessions.collect()}
    assert v == {"p300": ("train", "said by p300"), "p301": ("train", "said by p301"), "p302": ("validation", "said by p302")}
    put(tmp_path / "ti/DR1/A.PHN", "0 100 h#\n100 250 sh\n"), wav(tmp_path / "ti/DR1/A.WAV")
    c = builders.timit(spark, str(tmp_path / "ti"))
    assert [r["phoneme"] for r in c.utterances.orderBy("idx").collect()] == ["h#", "sh"] and c.utterances.first()["id"] == c.sessions.first()["id"]
    t = {"vctk": spark.createDataFrame([("train", "a", "f", "x"), ("test", "b", "f", "y")], "split string, id string, file string, text string"), "lj": spark.createDataFrame([("validation", "c", "f", "z")], "split string, id string, file string, text string")}
    every = corpora.speech_datasets(spark, str(tmp_path / "cache"), t, ["vctk", "lj"])
    assert [[r["id"] for r in d.collect()] for d in every] == [["a"], ["c"], ["b"]]
    assert [r["id"] for r in corpora.speech_datasets(spark, str(tmp_path / "cache"), {}, [], split="val").collect()] == ["c"]  # from the cache
    assert {k: d.count() for k, d in corpora.few(t, {"vctk": ["id"], "lj": ["id"]}, 1).items()} == {"vctk": 1, "lj": 1}
    with pytest.raises(KeyError):
        corpora.load_texts({"taskmaster2": {"flights": t["lj"]}}, ["taskmaster2"])


def test_sidecars_and_segments(spark, tmp_path):
    for name, x in (("a_f0.npy", np.arange(4.0)), ("b_f0.npy", np.array([7.0]))):
        b = io.BytesIO()
        np.save(b, x)
        (tmp_path / name).write_bytes(b.getvalue())
    (tmp_path / "c_f0.npy").write_bytes(b"broken")
    side = files.read_arrays(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    items = spark.createDataFrame([(n + ".wav", [float(i) for i in range(k)]) for n, k in (("a", 9), ("b", 3), ("c", 5), ("d", 1))], "file string, waveform array<double>")
    both = batch.with_sidecars(items, {"f0": side}, ".wav", "npy")
    assert {r["file"]: r["f0"] for r in both.collect()} == {"a.wav": [0.0, 1.0, 2.0, 3.0], "b.wav": [7.0], "c.wav": None, "d.wav": None}
    r = batch.speech_batches(both.where("f0 is not null").withColumn("id", F.col("file")), ["file"], 2, ("waveform", "f0"), least={"waveform": 2}, frames_of={"f0": 2}).first()
    assert r["f0_length"] == [5, 2] and r["f0"] == [[0.0, 1.0, 2.0, 3.0, 0.0], [7.0, 0.0, 0.0, 0.0, 0.0]]
    cut = {r["file"]: r["waveform"] for r in batch.segments_of(items, "file", 4.0, {"waveform": 1.0}).collect()}
    assert len(cut["a.wav"]) == 4 and np.diff(cut["a.wav"]).tolist() == [1.0] * 3 and cut["b.wav"] == [0.0, 1.0, 2.0] and cut["d.wav"] == [0.0]
    assert cut == {r["file"]: r["waveform"] for r in batch.segments_of(items.repartition(3), "file", 4.0, {"waveform": 1.0}).collect()}
