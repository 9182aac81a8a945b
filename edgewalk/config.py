"""Configuration as frozen dataclasses, with dotted overrides."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Preprocess:
    use_cache: bool = True
    save: bool = True
    folder: str = ""


@dataclass(frozen=True)
class Dataset:
    name: str = "copurchase"
    path: str = ""
    #: 0: ``walks_per_node`` for each start node, so that walks grow with the graph.
    num_walks: int = 0
    walks_per_node: int = 1
    max_walk_length: int = 83
    train_ratio: float = 0.48
    mask_ratio: float = 0.32
    val_ratio: float = 0.10
    test_ratio: float = 0.10
    seed: int = 42
    dedup: bool = False

    def __post_init__(self):
        ratios = (self.train_ratio, self.mask_ratio, self.val_ratio, self.test_ratio)
        if abs(sum(ratios) - 1.0) > 1e-6:
            raise ValueError(f"split ratios sum to {sum(ratios)}, not 1")
        if self.max_walk_length >= 1 << 23:
            raise ValueError("walks of 2 ** 23 steps or more")
        if min(ratios) < 0:
            raise ValueError("a split ratio is negative")


@dataclass(frozen=True)
class Model:
    embedding_dim: int = 32
    hidden_dim: int = 16
    dropout: float = 0.1
    nhead: int = 8
    nlayers: int = 2


@dataclass(frozen=True)
class Training:
    batch_size: int = 64
    epochs: int = 20
    lr: float = 0.001
    weight_decay: float = 0.0
    early_stopping_patience: int = 10
    gradient_clip_val: float = 1.0
    use_weighted_loss: bool = False
    checkpoint_dir: str = ""
    eval_only: bool = False


@dataclass(frozen=True)
class Config:
    preprocess: Preprocess = field(default_factory=Preprocess)
    dataset: Dataset = field(default_factory=Dataset)
    model: Model = field(default_factory=Model)
    training: Training = field(default_factory=Training)

    def override(self, *dotted: str) -> Config:
        """``section.key=value`` strings, in order; a value is read as JSON where it is JSON."""
        out = self
        for item in dotted:
            name, _, raw = item.partition("=")
            section, _, key = name.partition(".")
            part = getattr(out, section, None)
            if not dataclasses.is_dataclass(part) or key not in {f.name for f in dataclasses.fields(part)}:
                raise KeyError(f"no setting {name}")
            try:
                value = json.loads(raw)
            except ValueError:
                value = raw
            out = dataclasses.replace(out, **{section: dataclasses.replace(part, **{key: value})})
        return out

    @classmethod
    def load(cls, path: str, *dotted: str) -> Config:
        """Settings from a JSON file of sections, then overrides."""
        with open(path) as f:
            sections = json.load(f)
        return cls().override(*(f"{s}.{k}={json.dumps(v)}" for s, keys in sections.items() for k, v in keys.items()), *dotted)

    def digest(self, state: object = None) -> str:
        """A hash of what the prepared data depends on: the dataset's settings and the ``state`` of its files."""
        return hashlib.sha256(json.dumps([dataclasses.asdict(self.dataset), state], sort_keys=True).encode()).hexdigest()[:16]
