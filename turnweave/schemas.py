"""Declared schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SESSION = _of(dataset_name=_S, split=_S, session=_S, audio_path=_S, sample_rate=_I, num_frames=_L, duration=_D)
WORD = _of(session=_S, channel=_I, utt_key=_S, word_idx=_I, start=_D, end=_D, text=_S)
UTTERANCE = _of(session=_S, channel=_I, utt_idx=_I, start=_D, end=_D, text=_S)
VAD_SEGMENT = _of(session=_S, channel=_I, seg_idx=_I, start=_D, end=_D)
VAD_FRAME = _of(session=_S, frame=_I, v0=_I, v1=_I)
CLIP = _of(session=_S, clip=_I, start=_D, end=_D, kind=_S)
DIALOG_TEXT = _of(dataset_name=_S, split=_S, dialog_id=_S, dialog=T.ArrayType(_S))
SPEECH = _of(dataset_name=_S, split=_S, id=_S, file=_S, text=_S)
SIGNAL = _of(session=_S, channel=_I, sample_rate=_I, samples=T.ArrayType(T.FloatType()))
VAD_JSON = T.ArrayType(T.ArrayType(T.ArrayType(_D)))
VACATION_DIALOG = _of(turns=T.ArrayType(_of(name=_S, start_time=_D, end_time=_D, utterance=_S)))
EXAMPLE_DIALOG = _of(dialog=T.ArrayType(T.ArrayType(_of(text=_S, start=_D, speaker=_S))), chapter=T.MapType(_S, T.ArrayType(T.ArrayType(_D))))
