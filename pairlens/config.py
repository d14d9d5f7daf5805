"""Job configuration read from JSON.

Field names and numeric defaults are fixed values: they are the format of existing configuration
files. Model names only key the caches; the callables passed to a job do the work. Unknown keys
are rejected.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pairlens.operators.encoder_fit import FitConfig
from pairlens.operators.interpret import InterpretConfig
from pairlens.schema import ColumnNames


@dataclass
class DatasetConfig:
    name: str
    path: str
    split_columns: list[str]
    train_split_size: float = 0.8
    split_random_seed: int = 42
    prompt_column: str = "prompt"
    response_a_column: str = "response_A"
    response_b_column: str = "response_B"
    label_column: str = "label"
    max_words_prompt: int = 128
    max_words_response: int = 128
    random_seed: int = 42
    sae_checkpoint_path: str | None = None

    @property
    def columns(self) -> ColumnNames:
        return ColumnNames(
            self.prompt_column, self.response_a_column, self.response_b_column, self.label_column
        )

    @property
    def split_on(self) -> list[str]:
        """Split columns under the library's own column names."""
        renamed = {
            self.prompt_column: "prompt",
            self.response_a_column: "response_A",
            self.response_b_column: "response_B",
            self.label_column: "label",
        }
        return [renamed.get(c, c) for c in self.split_columns]


@dataclass
class EmbeddingConfig:
    model: str = "offline"
    n_workers: int | None = None  # tasks that call the embedder at once; all, if None


@dataclass
class EncoderConfig:
    M: int = 32
    K: int = 4
    prefix_lengths: list[int] | None = field(default_factory=lambda: [8, 32])
    batch_size: int = 256
    n_epochs: int = 50
    min_epochs: int = 10
    patience: int = 3
    learning_rate: float = 5e-4
    dead_neuron_threshold_steps: int = 64
    aux_k: int | None = None
    multi_k: int | None = None

    def fit_config(self, seed: int = 42) -> FitConfig:
        return FitConfig(
            n_neurons=self.M, k=self.K, prefix_lengths=self.prefix_lengths, batch_size=self.batch_size,
            n_epochs=self.n_epochs, min_epochs=self.min_epochs, patience=self.patience,
            learning_rate=self.learning_rate, dead_after_steps=self.dead_neuron_threshold_steps,
            aux_k=self.aux_k, multi_k=self.multi_k, seed=seed,
        )


@dataclass
class InterpretationConfig:
    interpreter_model: str = "offline"
    annotator_model: str = "offline"
    abbreviator_model: str = "offline"
    n_candidates: int = 5
    interpret_n_examples: int = 5
    interpret_sampling_kwargs: dict[str, Any] = field(
        default_factory=lambda: {
            "percentile_bin": (95, 100), "nonzero_only": True, "swap_negative_response_pairs": True
        }
    )
    scoring_n_examples: int = 300
    scoring_sampling_kwargs: dict[str, Any] = field(
        default_factory=lambda: {
            "high_percentile": (50, 100), "low_percentile": (0, 50), "nonzero_only": True
        }
    )
    min_correlation: float = 0.0
    p_value_threshold: float | None = 0.05 / 32
    n_workers_interpretation: int = 80
    n_workers_annotation: int = 300
    timeout: float | None = None
    max_interpretation_tokens: int | None = None
    completion_kwargs: dict[str, Any] = field(default_factory=dict)

    def interpret_config(self) -> InterpretConfig:
        sampling = self.interpret_sampling_kwargs
        percentile_bin = sampling.get("percentile_bin")
        return InterpretConfig(
            n_examples=self.interpret_n_examples,
            n_candidates=self.n_candidates,
            percentile_bin=tuple(percentile_bin) if percentile_bin is not None else None,
            n_top=sampling.get("n_top_select_from"),
            nonzero_only=sampling.get("nonzero_only", True),
            swap_negative=sampling.get("swap_negative_response_pairs", False),
        )


@dataclass
class SelectionConfig:
    controls: list[str] = field(default_factory=lambda: ["length_delta"])
    lasso_top_k: list[int] = field(default_factory=lambda: [5, 10])
    max_samples_lasso: int | None = None
    classification: bool = True
    standardize: bool = True
    use_lasso: bool = True


@dataclass
class RuntimeConfig:
    checkpoint_dir: str | None = None
    retrain_sae: bool = False
    cache_dir: str | None = None
    debug: bool = False


@dataclass
class JobConfig:
    dataset: DatasetConfig
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    sae: EncoderConfig = field(default_factory=EncoderConfig)
    interpretation: InterpretationConfig = field(default_factory=InterpretationConfig)
    selection: SelectionConfig = field(default_factory=SelectionConfig)
    runtime: RuntimeConfig = field(default_factory=RuntimeConfig)


def _section(kind: type, given: dict[str, Any]) -> Any:
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown keys for {kind.__name__}: {sorted(unknown)}")
    return kind(**given)


def job_config(data: dict[str, Any]) -> JobConfig:
    sections = {
        "embedding": EmbeddingConfig,
        "sae": EncoderConfig,
        "interpretation": InterpretationConfig,
        "selection": SelectionConfig,
        "runtime": RuntimeConfig,
    }
    unknown = set(data) - set(sections) - {"dataset"}
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    given = {name: dict(data.get(name, {})) for name in sections}
    given["runtime"].pop("wandb", None)  # experiment tracking is not part of the job
    return JobConfig(
        _section(DatasetConfig, data["dataset"]),
        **{name: _section(kind, given[name]) for name, kind in sections.items()},
    )


def load_config(path: str) -> JobConfig:
    with open(path) as f:
        return job_config(json.load(f))


def load_dataset_configs(path: str) -> list[DatasetConfig]:
    """A JSON list of data sets."""
    with open(path) as f:
        return [_section(DatasetConfig, item) for item in json.load(f)]


def for_debug(cfg: JobConfig) -> JobConfig:
    """Smaller samples and batches for a trial run; rows are capped when the data is read."""
    interpretation = replace(
        cfg.interpretation, scoring_n_examples=max(1, min(cfg.interpretation.scoring_n_examples, 100))
    )
    sae = replace(cfg.sae, batch_size=max(32, min(cfg.sae.batch_size, 128)))
    return replace(cfg, interpretation=interpretation, sae=sae)
