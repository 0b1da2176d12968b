"""Options of the two long-running plans."""

from __future__ import annotations

from dataclasses import dataclass

# Accepted option values.
CHOICES = {
    "analysis_mode": {"regulatory", "representation"},
    "nmf_mode": {"off", "auto", "force"},
    "pc_variant": {"stable", "orig"},
    "pair_prior_mode": {"hard", "soft"},
    "pair_weight_mode": {"weighted", "binary"},
    "tf_prior_mode": {"none", "motif_prior"},
    "joint_mode": {"none", "joint_modality"},
    "joint_profile_mode": {"max", "weighted_sum"},
    "input_modality": {"scrna", "paired_multiome"},
}


def _check(config) -> None:
    for name, allowed in CHOICES.items():
        if hasattr(config, name) and getattr(config, name) not in allowed:
            raise ValueError(f"unsupported {name}: {getattr(config, name)}")


def _within(config, low: float, high: float | None, *names: str) -> None:
    for name in names:
        value = float(getattr(config, name))
        if value < low or (high is not None and value > high):
            raise ValueError(f"{name} must be {'>= ' + str(low) if high is None else f'within [{low}, {high}]'}")


@dataclass(frozen=True)
class RunConfig:
    analysis_mode: str = "representation"
    nmf_mode: str = "auto"
    nmf_components: int = 100
    nmf_max_iter: int = 50_000
    pc_variant: str = "stable"
    max_cond_vars: int = 20
    significance_level: float = 0.01
    window_fraction: float = 0.1
    use_pair_prior: bool = False
    pair_prior_mode: str = "hard"
    pair_weight_mode: str = "weighted"
    pair_alpha: float = 0.20
    pair_min_strength: float = 0.0
    tf_prior_mode: str = "none"
    tf_top_k: int = 5
    tf_alpha: float = 0.20
    tf_min_strength: float = 0.0
    tf_max_conditioning_vars: int = -1
    tf_strength_gamma: float = 1.0
    joint_mode: str = "none"
    joint_open_threshold: float = 0.0
    joint_profile_mode: str = "max"
    key_block: int = 128

    def validate(self) -> "RunConfig":
        _check(self)
        _within(self, 0, 1, "pair_alpha", "pair_min_strength", "tf_alpha", "tf_min_strength")
        _within(self, 1, None, "nmf_components", "nmf_max_iter", "tf_top_k", "key_block")
        _within(self, 0, None, "max_cond_vars", "joint_open_threshold")
        _within(self, -1, None, "tf_max_conditioning_vars")
        if self.analysis_mode == "regulatory" and self.nmf_mode == "force":
            raise ValueError("regulatory mode does not allow nmf_mode='force'")
        if self.tf_strength_gamma <= 0:
            raise ValueError("tf_strength_gamma must be > 0")
        return self

    def uses_factors(self, n_genes: int) -> bool:
        if self.nmf_mode != "auto":
            return self.nmf_mode == "force"
        return self.analysis_mode == "representation" and n_genes > 150


@dataclass(frozen=True)
class PreprocessConfig:
    input_modality: str
    analysis_mode: str = "regulatory"
    input_path: str | None = None
    gtf: str | None = None
    prefix: str = "modules"
    top_genes: int = 1000
    top_cells: int = 2000
    top_peaks: int = 5000
    min_gene_cells: int = 10
    min_peak_cells: int = 10
    module_min_size: int = 20
    module_max_size: int = 120
    soft_power: int = 6
    cut_height: float = 0.7
    enable_motif_prior: bool = False
    tf_list: str | None = None
    motif_file: str | None = None
    genome_fasta: str | None = None
    peak_gene_window: int = 250_000
    peak_gene_corr_threshold: float = 0.1

    def validate(self) -> "PreprocessConfig":
        _check(self)
        _within(self, 1, None, "peak_gene_window")
        _within(self, -1, 1, "peak_gene_corr_threshold")
        if self.input_path is None:
            raise ValueError("input_path is required")
        if self.enable_motif_prior:
            if self.input_modality != "paired_multiome":
                raise ValueError("the motif prior needs input_modality='paired_multiome'")
            for name in ("gtf", "genome_fasta", "motif_file"):
                if getattr(self, name) is None:
                    raise ValueError(f"{name} is required for the motif prior")
        return self
