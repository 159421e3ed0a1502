"""Typed settings of a run, merged from defaults, a JSON file, environment variables and the command line, later ones first."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

PREFIX = "SPECTRALOOM_"
YES, NO = {"1", "true", "yes", "on", "y", "t"}, {"0", "false", "no", "off", "n", "f"}


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a run. `search` holds the settings of an external search engine, passed through as they are.

    search_mode: "results" takes the PSMs as they are, "windowed" searches the spectra again by retention-time
    windows (fasta_file, rt_interval, min_len, max_len, missed_cleavages) with models fitted on those PSMs.
    rt_predictor: "ends" or "composition". fragment_predictor: "fitted" or "flat". known_rt and known_fragments:
    Parquet of predictions by peptide, or by peptide and charge, that are taken in place of new ones.
    """

    mzml_path: str = "mzml_files"
    fasta_file: str = "fasta/proteins.fasta"
    psm_path: str = ""
    fragment_path: str = ""
    result_dir: str = "results"
    remove_intermediate_files: bool = False
    read_search_cache: bool = True
    write_search_cache: bool = False
    read_rt_cache: bool = True
    write_rt_cache: bool = False
    read_fragment_cache: bool = True
    write_fragment_cache: bool = False
    read_correlation_cache: bool = True
    write_correlation_cache: bool = False
    transfer_learn: bool = True
    fdr_init_search: float = 0.05
    search_mode: str = "results"
    rt_predictor: str = "ends"
    fragment_predictor: str = "fitted"
    known_rt: str = ""
    known_fragments: str = ""
    model_type: str = "linear"
    rescoring_rounds: int = 2
    rt_limit: float = 0.15
    apex_width: float = 3.0
    min_count: int = 1
    ppm: float = 20.0
    rt_interval: float = 120.0
    min_len: int = 5
    max_len: int = 50
    missed_cleavages: int = 2
    search: Mapping[str, Any] = field(default_factory=dict)

    def validate(self) -> EngineConfig:
        """self; ValueError that names the first bad setting."""
        if self.fdr_init_search < 0:
            raise ValueError("fdr_init_search must not be negative")
        choices = {"model_type": ("linear", "network"), "search_mode": ("results", "windowed"), "rt_predictor": ("ends", "composition"), "fragment_predictor": ("fitted", "flat")}
        for name, known in choices.items():
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is {' or '.join(known)}")
        if self.rescoring_rounds < 0:
            raise ValueError("rescoring_rounds must not be negative")
        if not 0 < self.min_len <= self.max_len or self.missed_cleavages < 0:
            raise ValueError("peptide lengths and missed cleavages are out of range")
        if min(self.rt_limit, self.apex_width, self.ppm, self.rt_interval) <= 0:
            raise ValueError("rt_limit, apex_width, ppm and rt_interval must be positive")
        return self


def coerced(raw: Any, example: Any) -> Any:
    """A string as the type of an example; strings that don't fit stay as they are, unknown truth words count as true if not empty."""
    if not isinstance(raw, str):
        return raw
    if isinstance(example, bool):
        word = raw.strip().lower()
        return word in YES or (word not in NO and bool(word))
    for kind in (int, float):
        if isinstance(example, kind):
            try:
                return kind(raw)
            except ValueError:
                return raw
    return raw


def parser() -> argparse.ArgumentParser:
    """A flag for each setting, --x and --no-x for truth values; unset flags leave no trace, so they override nothing."""
    p = argparse.ArgumentParser("spectraloom", argument_default=argparse.SUPPRESS)
    p.add_argument("--config_file", help="JSON file with settings")
    for f in fields(EngineConfig):
        if f.name == "search":
            continue
        if isinstance(f.default, bool):
            p.add_argument(f"--{f.name}", action=argparse.BooleanOptionalAction)
        else:
            p.add_argument(f"--{f.name}", type=type(f.default))
    return p


def merged(argv: Sequence[str] = (), environ: Mapping[str, str] | None = None, file: str | None = None) -> EngineConfig:
    """Command line over environment over JSON over defaults. Unknown names in the file go to `search`."""
    given = vars(parser().parse_args(list(argv)))
    file = given.pop("config_file", file)
    data = json.loads(Path(file).read_text()) if file else {}
    defaults = asdict(EngineConfig())
    known = {k: coerced(v, defaults[k]) for k, v in data.items() if k in defaults}
    rest = {k: v for k, v in data.items() if k not in defaults}
    if rest:
        known["search"] = {**rest, **known.get("search", {})}
    env = {k: coerced(v, defaults[k]) for k in defaults if k != "search" and (v := (os.environ if environ is None else environ).get(PREFIX + k.upper())) is not None}
    return replace(EngineConfig(), **{**known, **env, **given}).validate()


def write(config: EngineConfig, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(asdict(config), indent=2) + "\n")
