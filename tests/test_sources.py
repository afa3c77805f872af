"""Parsers of corpus files, audio, sinks and caches on small files."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave import config, schemas
from turnweave.operators import splits
from turnweave.sources import corpora, dialogs, files, sinks


def lines(spark, name, text):
    return spark.createDataFrame([(name, i, x) for i, x in enumerate(text.split("\n"))], "file string, line_no int, line string")


def test_switchboard(spark, tmp_path):
    (tmp_path / "sw2005A-ms98-a-word.text").write_text("u1 0.0 0.5 [silence]\nu1\t0.5  0.7 [laughter-so]\nu1 0.72 1.0 we-\nu1 1.2 1.4 went_1\nu2 2.0 2.5 [noise]\nbad line\n")
    (tmp_path / "sw2005A-ms98-a-trans.text").write_text("u1 0.0 1.5 [laughter-so] we- went_1\nu2 2.0 2.5 [noise]\nu3 3.0 4.0 lost words\n")
    w = dialogs.swb_words(files.read_lines(spark, str(tmp_path), "*word.text"))
    assert [(r["utt_key"], r["text"], r["start"]) for r in w.orderBy("word_idx").collect()] == [("u1", "so", 0.5), ("u1", "we", 0.72), ("u1", "went", 1.2)]
    u, seg = dialogs.swb_dialogs(w, dialogs.swb_utterances(files.read_lines(spark, str(tmp_path), "*trans.text")))
    r = u.collect()
    assert len(r) == 1 and (r[0]["session"], r[0]["channel"], r[0]["start"], r[0]["end"], r[0]["text"]) == ("2005", 0, 0.5, 1.4, "so we went")
    assert sorted((x["start"], x["end"]) for x in seg.collect()) == [(0.5, 1.0), (1.2, 1.4)]
    names = spark.createDataFrame([("/a/swb1/sw02005.sph",), ("/a/x.sph",)], "file string")
    m = dialogs.audio_mapping(names)
    assert [tuple(x) for x in m.collect()] == [("2005", "/a/swb1/sw02005")]
    ses = spark.createDataFrame([("2005",), ("2006",)], "session string")
    assert dialogs.swb_sessions(ses.limit(1), spark.createDataFrame([("2005", "d1/sw02005")], "session string, audio_path string"), "/r/").collect()[0]["audio_path"] == "/r/d1/sw02005.wav"
    with pytest.raises(Exception, match="no path for"):
        dialogs.swb_sessions(ses, spark.createDataFrame([("2005", "x")], "session string, audio_path string"), "/r").collect()


def test_fisher(spark):
    u = dialogs.fisher_utterances(lines(spark, "f", "# fe_03_00001\n\n1.5 2.5 A: hello there\n# x\n2.6 3.0 B: yes\n3 4 C: who\nnonsense")).collect()
    assert [tuple(r) for r in u] == [("f", 0, 0, 1.5, 2.5, "hello there"), ("f", 1, 1, 2.6, 3.0, "yes")]
    s = dialogs.fisher_sessions(spark)
    assert {r["split"]: r["n"] for r in s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {"train": 5099, "validation": 400, "test": 351}


def test_callhome(spark):
    text = "# head\nstray\n\n10.0 12.0 A: well %um\n  and on\n12.0 11.5 A: more\n13 14 B: yes {laugh}\n15 x B: bad"
    u = dialogs.callhome_utterances(lines(spark, "c", text)).orderBy("utt_idx").collect()
    assert [tuple(r) for r in u] == [("c", 0, 0, 10.0, 11.5, "well um and on more"), ("c", 1, 1, 13.0, 14.0, "yes ")]
    assert [r["line"] for r in dialogs.bad_lines(lines(spark, "c", text)).collect()] == ["15 x B: bad"]
    a = spark.createDataFrame([("/r/evltest/en_1.wav",), ("/r/train/en_2.wav",), ("/r/train/en_3.sph",)], "file string")
    t = spark.createDataFrame([("/t/evaltest/en_1.txt",)], "file string")
    got = {r["session"]: (r["split"], r["transcript_path"]) for r in dialogs.callhome_files(a, t).collect()}
    assert got == {"en_1": ("test", "/t/evaltest/en_1.txt"), "en_2": ("train", None)}


def test_vacation(spark, tmp_path):
    (tmp_path / "dialogs").mkdir()
    (tmp_path / "dialogs/s1.json").write_text(json.dumps({"turns": [{"name": "agent", "start_time": 0.5, "end_time": 1, "utterance": "hi"}, {"name": "user", "start_time": 1.5, "end_time": 2, "utterance": "é"}]}))
    (tmp_path / "dialogs/s2.json").write_text("{broken")
    d = files.read_json(spark, str(tmp_path / "dialogs"), schemas.VACATION_DIALOG)
    assert [tuple(r) for r in dialogs.vacation_utterances(d).orderBy("utt_idx").collect()] == [("s1", 0, 0, 0.5, 1.0, "hi"), ("s1", 1, 1, 1.5, 2.0, "é")]
    assert dialogs.vacation_sessions(d, "/r").count() == 6
    v = spark.createDataFrame([("x/s1.json", "[[[0.1,0.5]],[[1,2],[3,4]]]")], "file string, t string").select("file", F.from_json("t", schemas.VAD_JSON).alias("value"))
    assert [tuple(r) for r in dialogs.vad_segments(v).collect()] == [("s1", 0, 0, 0.1, 0.5), ("s1", 1, 0, 1.0, 2.0), ("s1", 1, 1, 3.0, 4.0)]
    e = spark.createDataFrame([("e", json.dumps({"dialog": [[{"text": "a", "start": 1.0, "speaker": "A"}], [{"text": "b", "start": 2.0, "speaker": "B"}]], "chapter": {"A": [[1.0, 3]], "B": [[5.0]]}}))], "file string, t string")
    assert [r["text"] for r in dialogs.chapter_turns(e.select("file", F.from_json("t", schemas.EXAMPLE_DIALOG).alias("value"))).collect()] == ["a"]


def test_text_corpora(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0, 0, 1], "train"), ([], [], "test")], "`m.text` array<string>, `m.who` array<int>, split string").select(F.struct(F.col("`m.text`").alias("text"), F.col("`m.who`").alias("speaker")).alias("utterances"), "split")
    got = corpora.load_texts({"taskmaster1": df}, ["taskmaster1"]).collect()
    assert [(r["dialog"], r["dataset_name"], r["split"]) for r in got] == [(["a b", "c"], "taskmaster1", "train"), ([], "taskmaster1", "test")]
    with pytest.raises(ValueError):
        corpora.load_texts({}, ["nope"])
    assert corpora.flatten(df, "utterances").columns == ["split", "utterances.text", "utterances.speaker"]
    idx = spark.createDataFrame([("train", 1), ("train", 0), ("test", 2)], "split string, pos long")
    assert corpora.stored_split(spark.range(5), ["id"], idx, "train").count() == 2


def test_speech(spark):
    r = corpora.librispeech(lines(spark, "/d/84/121/84-121.trans.txt", "84-121-0000 GO DO YOU HEAR\n\n84-121-0001 BUT")).collect()
    assert tuple(r[0]) == ("84-121-0000", "/d/84/121/84-121-0000.flac", "GO DO YOU HEAR", 84, 121) and len(r) == 2
    a = spark.createDataFrame([(f"/w/p{n}/p{n}_001_{m}.flac",) for n in (225, 226, 227, 280) for m in ("mic1", "mic2")], "file string")
    t = spark.createDataFrame([(f"/t/p{n}/p{n}_001.txt", 0, f" text {n} ") for n in (225, 226, 227, 280)], "file string, line_no int, line string")
    v = corpora.vctk(a, t).orderBy("id").collect()
    assert [(x["id"], x["split"], x["text"]) for x in v] == [("p225_001", "train", "text 225"), ("p226_001", "train", "text 226"), ("p227_001", "validation", "text 227")]
    p = corpora.timit(lines(spark, "x", "0 3050 h#\n3050 4559 sh\nbad")).collect()
    assert [(x["start"], x["end"], x["phoneme"]) for x in p] == [(0, 3050, "h#"), (3050, 4559, "sh")]


def test_audio(spark, tmp_path):
    x = (np.sin(np.arange(8000) / 10) * 16000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.stack([x, -x // 2], 1).astype("<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"no audio")
    a = files.read_audio(spark, str(tmp_path))
    info = {r["file"].rsplit("/", 1)[1]: r["i"] for r in a.select("file", files.audio_info(F.col("content")).alias("i")).collect()}
    assert info["a.wav"]["num_channels"] == 2 and info["a.wav"]["num_frames"] == 8000 and info["a.wav"]["bits_per_sample"] == 16 and info["b.wav"]["duration"] is None
    good = a.where("file like '%a.wav'")
    full = good.select(files.load_waveform(F.col("content"), normalize=True)).first()[0]
    assert abs(max(map(abs, full[0])) - 1) < 1e-6 and len(full) == 2
    part = good.select(files.load_waveform(F.col("content"), 4000, F.lit(0.25), F.lit(0.75), mono=True)).first()[0]
    assert len(part) == 1 and len(part[0]) == 2000


def test_sinks(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string")

    path = str(tmp_path / "c")
    assert sinks.cached(spark, path, make).count() == 2 and sinks.cached(spark, path, make).where("split = 'test'").count() == 1 and len(made) == 1
    sinks.cached(spark, path, make, overwrite=True)
    sinks.cached(spark, path, make, load_from_cache=False)
    assert len(made) == 3
    sinks.write_json(spark.createDataFrame([("é", None)], "a string, b int"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":"é","b":null}'
    sinks.write_lines(spark.range(5), "id", str(tmp_path / "l"), ["id"])
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == list("01234")
    sinks.write_folds(spark.range(23), "id", str(tmp_path / "k"))
    assert sorted(r["n"] for r in spark.read.text(str(tmp_path / "k")).groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()) == [2] * 10 + [3]
    assert spark.createDataFrame([([[[0.126, 1.0]], []],)], "v array<array<array<double>>>").select(sinks.vad_json(F.col("v"))).first()[0] == "[[[0.13,1.0]],[]]"
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert [r["id"] for r in files.read_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]


def test_splits(spark):
    df = spark.range(25)
    sizes = lambda d, c: sorted(r["n"] for r in d.groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect())
    f = splits.folds(df, ["id"]).orderBy("id").collect()
    assert [r["fold"] for r in f] == sorted(r["fold"] for r in f) and sizes(splits.folds(df, ["id"]), "fold") == [2] * 8 + [3] * 3
    assert sizes(splits.folds(spark.range(3), ["id"]), "fold") == [1, 1, 1]
    assert sizes(splits.shuffled_splits(df, "id", halves=True), "split") == [1, 2, 22]
    a, b = (sorted(r["id"] for r in splits.shuffled_splits(df, "id", seed=s).where("split = 'train'").collect()) for s in (1, 1))
    assert a == b and len(a) == 22
    assert splits.positions(spark.createDataFrame([], "id int"), ["id"]).count() == 0
    assert [r["pos"] for r in splits.positions(spark.range(100).repartition(7), ["id"]).orderBy("id").collect()] == list(range(100))


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"dataset": {"vad_hz": 10}}))
    c = config.load(str(tmp_path / "c.json"))
    assert c["dataset"]["vad_hz"] == 10 and c["dataset"]["audio_duration"] == 10.0
    o = config.override(c, {"dataset.vad_hz": 50, "dataset.type": None})
    assert o["dataset"]["vad_hz"] == 50 and o["dataset"]["type"] == "sliding" and c["dataset"]["vad_hz"] == 10
    with pytest.raises(KeyError):
        config.override(c, {"dataset.nope": 1})


@pytest.mark.parametrize("flow", sorted(config.FLOWS))
def test_every_flow_has_options(flow):
    base = config.load(defaults=config.FLOWS[flow])
    given = config.parser_of(flow).parse_args(["--dataset.batch_size", "7"])
    got = config.override(base, given)
    assert got["dataset"]["batch_size"] == 7 and config.FLOWS[flow]["dataset"]["batch_size"] == 4
    assert {k: v for k, v in config.flat(got).items() if k != "dataset.batch_size"} == {k: v for k, v in config.flat(base).items() if k != "dataset.batch_size"}
    with pytest.raises(SystemExit):
        config.parser_of(flow).parse_args(["--dataset.nothing", "1"])
