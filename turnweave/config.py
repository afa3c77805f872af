"""Settings of the dataflows: defaults, a file, and dotted overrides, each layer above the one before."""

from __future__ import annotations

import argparse
import json
from copy import deepcopy
from typing import Any

#: Defaults of the dialogue-audio flow.
DIALOG_AUDIO = {
    "dataset": {
        "type": "sliding", "sample_rate": 16000, "audio_duration": 10.0, "audio_overlap": 2.0, "audio_normalize": True, "audio_context_duration": 8.0,
        "ipu_pause_time": 0.2, "ipu_min_time": 1.0, "vad": True, "vad_hz": 100, "vad_horizon": 2.0, "vad_history": True, "vad_history_times": [60, 30, 10, 5], "batch_size": 4,
    }
}

#: Defaults of the other flows.
DIALOG_TEXT = {"dataset": {"datasets": [], "max_length": 500, "batch_size": 4, "savepath": None, "overwrite": False, "load_from_cache": True}}
SPEECH = {"dataset": {"datasets": [], "duration": -1.0, "features": [], "batch_size": 4, "savepath": None, "overwrite": False, "load_from_cache": True}}
LANGUAGE = {"dataset": {"dataset_path": None, "max_length": 500, "batch_size": 4, "savepath": None, "overwrite": False, "load_from_cache": True}}
CLASSIFICATION = {
    "dataset": {
        "audio_root": None, "dataset_path": None, "f0_mean_path": None, "audio_duration": 5.0, "lookahead_time": 2.0, "vad_frame_time": 0.1, "f0_frame_time": 0.05, "f0_hop_time": 0.02, "response_diff_time": 0.1, "sample_rate": 8000,
        "omit_post_words": True, "features": ["token", "waveform", "vad_history", "vad", "f0"], "max_length": 500, "overwrite": False, "load_from_cache": True, "batch_size": 4,
    }
}
PROSODY = {"dataset": {"audio_root": None, "dataset_path": None, "f0_mean_path": None, "audio_duration": 3.0, "max_length": 200, "overwrite": False, "load_from_cache": True, "batch_size": 4}}
#: The flow of each kind of batch by name.
FLOWS = {"dialog_audio": DIALOG_AUDIO, "dialog_text": DIALOG_TEXT, "speech": SPEECH, "language": LANGUAGE, "classification": CLASSIFICATION, "prosody": PROSODY}


def parser_of(flow: str) -> argparse.ArgumentParser:
    """A parser with every option of a flow; an unknown flow raises."""
    parser = argparse.ArgumentParser(prog=flow)
    add_arguments(parser, FLOWS[flow])
    return parser


def load(path: str | None = None, defaults: dict | None = None) -> dict:
    """Defaults with the sections of a JSON file (or YAML, where a parser is installed) laid over them."""
    out = deepcopy(defaults if defaults is not None else DIALOG_AUDIO)
    if path:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                given = yaml.safe_load(f)
            else:
                given = json.load(f)
        _lay(out, given)
    return out


def _lay(base: dict, over: dict) -> None:
    for k, v in over.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            _lay(base[k], v)
        else:
            base[k] = v


def flat(config: dict, prefix: str = "") -> dict[str, Any]:
    out = {}
    for k, v in config.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def add_arguments(parser: argparse.ArgumentParser, config: dict) -> None:
    """An option ``--section.key`` for every value; one that isn't given stays None."""
    for k, v in flat(config).items():
        kind = {"type": json.loads} if isinstance(v, (list, bool)) or v is None else {"type": type(v)}
        parser.add_argument(f"--{k}", default=None, **kind)


def override(config: dict, given: dict[str, Any] | argparse.Namespace, omit: tuple[str, ...] = ()) -> dict:
    """A copy with the given dotted values; None means not given, keys of ``omit`` are left out, unknown ones raise."""
    out = deepcopy(config)
    known = flat(out)
    for k, v in (vars(given) if isinstance(given, argparse.Namespace) else given).items():
        if v is None or k in omit:
            continue
        if k not in known:
            raise KeyError(k)
        *path, last = k.split(".")
        at = out
        for p in path:
            at = at[p]
        at[last] = v
    return out
