"""Run configurations: panels, partitions and manifests, checked without Spark."""

from __future__ import annotations

import logging
import random
from dataclasses import dataclass, field

import numpy as np

from stratapanel.errors import ArchitectureMismatchError, MissingHyperparameterError, PredictionHorizonError, TemporalDiscontinuityError

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class PanelSpec:
    """Key, target and feature columns of a panel.  Features default to all other columns."""

    time: str = "month_id"
    entity: str = "entity_id"
    targets: tuple[str, ...] = ()
    features: tuple[str, ...] = field(default=())

    @property
    def keys(self) -> list[str]:
        return [self.time, self.entity]

    @property
    def values(self) -> list[str]:
        return [*self.targets, *self.features]

    def with_features_of(self, columns: list[str]) -> PanelSpec:
        rest = tuple(c for c in columns if c not in (*self.keys, *self.targets))
        return PanelSpec(self.time, self.entity, self.targets, rest)


@dataclass(frozen=True)
class Partition:
    """Inclusive train and test ranges; a forecasting run has no test range."""

    train: tuple[int, int]
    test: tuple[int, int] | None = None

    def check_continuity(self) -> Partition:
        if self.test is not None and self.test[0] != self.train[1] + 1:
            raise TemporalDiscontinuityError(f"test starts at {self.test[0]}, train ends at {self.train[1]}")
        return self

    def origins(self, max_steps: int) -> int:
        """Number of rolling origins whose last step lies in the test range."""
        n = self.test[1] - self.test[0] + 1 - max_steps + 1
        if n < 1:
            raise ValueError(f"a test range of {self.test} has no room for {max_steps} steps")
        return n

    def check_horizon(self, run_type: str, max_steps: int, sequences: int = 12) -> None:
        """In calibration and validation, the last step of the last sequence must be observed."""
        last = self.train[1] + sequences - 1 + max_steps
        if run_type in ("calibration", "validation") and last > self.test[1]:
            raise PredictionHorizonError(f"the last step is {last}, the test range ends at {self.test[1]}")

    def validation(self, input_length: int, output_length: int) -> tuple[Partition, tuple[int, int], bool]:
        """(partition to fit on, inclusive validation range, whether it was carved from the training range).

        The validation range is the test range with its inputs.  If it is too short
        for one window, the last outputs of the training range are held out instead.
        """
        need = input_length + output_length
        if self.test is not None and self.test[1] - (self.test[0] - input_length) + 1 >= need:
            return self, (self.test[0] - input_length, self.test[1]), False
        start, end = self.train
        return Partition((start, end - output_length), self.test), (end - need + 1, end), True


# The keys that a manifest needs, for all runs and by choice.
CORE = (
    "random_state",
    "steps",
    "run_type",
    "name",
    "algorithm",
    "loss_function",
    "lr",
    "weight_decay",
    "batch_size",
    "n_epochs",
    "optimizer_cls",
    "lr_scheduler_cls",
    "early_stopping_patience",
    "early_stopping_min_delta",
    "gradient_clip_val",
    "num_samples",
    "mc_dropout",
)
NULLABLE = frozenset((
    "hidden_fc_sizes",
    "pooling_kernel_sizes",
    "n_freq_downsample",
    "categorical_embedding_sizes",
    "temporal_hidden_size_past",
    "temporal_hidden_size_future",
))
CHUNKS = ("input_chunk_length", "output_chunk_length", "output_chunk_shift")
ALGORITHMS = {
    "NBEATSModel": (
        "num_stacks",
        "num_blocks",
        "num_layers",
        "layer_widths",
        "expansion_coefficient_dim",
        "trend_polynomial_degree",
        "activation",
        "dropout",
        "generic_architecture",
        "force_reset",
        "use_reversible_instance_norm",
    ),
    "NHiTSModel": (
        "num_stacks",
        "num_blocks",
        "num_layers",
        "layer_widths",
        "pooling_kernel_sizes",
        "n_freq_downsample",
        "activation",
        "max_pool_1d",
        "dropout",
        "use_reversible_instance_norm",
        "force_reset",
    ),
    "TFTModel": (
        "hidden_size",
        "lstm_layers",
        "num_attention_heads",
        "full_attention",
        "feed_forward",
        "dropout",
        "hidden_continuous_size",
        "categorical_embedding_sizes",
        "add_relative_index",
        "skip_interpolation",
        "norm_type",
        "use_static_covariates",
        "use_reversible_instance_norm",
    ),
    "TiDEModel": (
        "num_encoder_layers",
        "num_decoder_layers",
        "decoder_output_dim",
        "hidden_size",
        "temporal_width_past",
        "temporal_width_future",
        "temporal_hidden_size_past",
        "temporal_hidden_size_future",
        "temporal_decoder_hidden",
        "use_layer_norm",
        "dropout",
        "use_static_covariates",
        "use_reversible_instance_norm",
    ),
    "TSMixerModel": (
        "num_blocks",
        "ff_size",
        "hidden_size",
        "activation",
        "dropout",
        "norm_type",
        "normalize_before",
        "use_static_covariates",
        "use_reversible_instance_norm",
    ),
    "NLinearModel": ("shared_weights", "const_init", "normalize", "use_static_covariates", "use_reversible_instance_norm"),
    "DLinearModel": ("shared_weights", "kernel_size", "const_init", "use_static_covariates", "use_reversible_instance_norm"),
    "BlockRNNModel": ("rnn_type", "hidden_dim", "n_rnn_layers", "hidden_fc_sizes", "dropout", "activation", "use_static_covariates", "use_reversible_instance_norm"),
    "TransformerModel": (
        "d_model",
        "nhead",
        "num_encoder_layers",
        "num_decoder_layers",
        "dim_feedforward",
        "dropout",
        "activation",
        "norm_type",
        "use_reversible_instance_norm",
        "detect_anomaly",
    ),
    "TCNModel": ("kernel_size", "num_filters", "num_layers", "dilation_base", "weight_norm", "dropout", "use_reversible_instance_norm"),
}
OPTIMIZERS = {
    "Adam": ("lr", "weight_decay"),
    "AdamW": ("lr", "weight_decay"),
    "RAdam": ("lr", "weight_decay"),
    "SGD": ("lr", "weight_decay", "momentum"),
    "RMSprop": ("lr", "weight_decay", "momentum", "alpha"),
}
SCHEDULERS = {
    "ReduceLROnPlateau": ("lr_scheduler_factor", "lr_scheduler_patience", "lr_scheduler_min_lr"),
    "CosineAnnealingWarmRestarts": ("lr_scheduler_T_0", "lr_scheduler_T_mult", "lr_scheduler_eta_min"),
    "WarmupCAWR": ("lr_scheduler_warmup_epochs", "lr_scheduler_T_0", "lr_scheduler_T_mult", "lr_scheduler_eta_min"),
    "StepLR": ("lr_scheduler_step_size", "lr_scheduler_gamma"),
    "ExponentialLR": ("lr_scheduler_gamma",),
}
LOSSES = {
    "WeightedPenaltyHuberLoss": ("zero_threshold", "delta", "non_zero_weight", "false_positive_weight", "false_negative_weight"),
    "WeightedHuberLoss": ("zero_threshold", "delta", "non_zero_weight"),
    "TimeAwareWeightedHuberLoss": ("zero_weight", "non_zero_weight", "decay_factor", "delta"),
    "SpikeFocalLoss": ("alpha", "gamma", "spike_threshold"),
    "TweedieLoss": ("p", "non_zero_weight", "zero_threshold", "false_positive_weight", "false_negative_weight", "eps"),
    "AsymmetricQuantileLoss": ("tau", "non_zero_weight", "zero_threshold"),
    "ZeroInflatedLoss": ("zero_weight", "count_weight", "delta", "zero_threshold", "eps"),
    "ShrinkageLoss": ("a", "c"),
    "PrismLoss": ("non_zero_threshold", "delta"),
    "SpotlightLoss": ("delta", "non_zero_threshold"),
    "SpotlightLossLogcosh": ("non_zero_threshold",),
    "SpotlightLossHuber": ("delta", "non_zero_threshold"),
    "SpotlightLossPowerLaw": ("delta", "non_zero_threshold"),
    "SpotlightLossAsinh": ("non_zero_threshold",),
    "CharbonnierLoss": (),
    "SpotlightFocalLoss": ("gamma", "delta", "non_zero_threshold"),
    "SentinelLoss": ("alpha", "beta", "kappa", "delta", "gamma"),
    "MSELoss": (),
    "L1Loss": (),
    "HuberLoss": ("delta",),
    "PoissonNLLLoss": (),
}
#: Algorithms that use static covariates, and those with an implementation here.
STATIC = frozenset(("TFTModel", "TSMixerModel", "TiDEModel", "BlockRNNModel", "NLinearModel", "DLinearModel"))
RUNNABLE = frozenset(("NLinearModel", "DLinearModel"))


def required_keys(config: dict) -> list[str]:
    """All keys that a manifest with these choices needs."""
    keys = list(CORE)
    for chosen, table, extra in (("algorithm", ALGORITHMS, CHUNKS), ("optimizer_cls", OPTIMIZERS, ()), ("lr_scheduler_cls", SCHEDULERS, ()), ("loss_function", LOSSES, ())):
        name = config.get(chosen)
        if name is None:
            continue
        if name not in table:
            raise MissingHyperparameterError(f"{chosen}: {name!r} is none of {', '.join(sorted(table))}")
        keys += [*extra, *table[name]]
    return list(dict.fromkeys(keys))


def audit_manifest(config: dict) -> None:
    """Raises unless every needed key is there, and none but the nullable ones is None."""
    needed = required_keys(config)
    lacking = [k for k in needed if k not in config or (config[k] is None and k not in NULLABLE)]
    if lacking:
        raise MissingHyperparameterError(f"missing: {', '.join(lacking)}")


def audit_architecture(config: dict) -> None:
    """The horizon must be a whole number of output chunks."""
    steps, chunk = list(config["steps"]), config["output_chunk_length"]
    if len(steps) % chunk:
        raise ArchitectureMismatchError(f"{len(steps)} steps aren't a multiple of an output chunk of {chunk}")
    if len(steps) != 36 or steps[0] != 1:
        log.warning("%d steps from %s; 36 from 1 are usual", len(steps), steps[0])


def unknown_keys(config: dict) -> list[str]:
    known = {*CORE, *CHUNKS, *NULLABLE}
    for table in (ALGORITHMS, OPTIMIZERS, SCHEDULERS, LOSSES):
        known |= {k for keys in table.values() for k in keys}
    return sorted(set(config) - known)


def lock_entropy(seed: int) -> np.random.Generator:
    """Seeds Python's and numpy's global generators and returns one of its own."""
    random.seed(seed)
    np.random.seed(seed % 2**32)
    return np.random.default_rng(seed)
