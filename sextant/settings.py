"""Settings of a corpus and of training, checked as they are made: strict about names, kinds and ranges."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Mapping
from typing import Any, TypeVar

S = TypeVar("S")
LONGEST = 512


def _checked(owner: object, **rules: bool) -> None:
    broken = [name for name, holds in rules.items() if not holds]
    if broken:
        raise ValueError(f"{type(owner).__name__}: out of range: {', '.join(broken)}")


@dataclasses.dataclass(frozen=True)
class Chunking:
    max_tokens: int
    overlap_tokens: int
    min_tokens: int
    exclude_sections: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _checked(self, max_tokens=0 < self.max_tokens <= LONGEST, overlap_tokens=0 <= self.overlap_tokens < self.max_tokens // 2, min_tokens=self.min_tokens >= 0)


@dataclasses.dataclass(frozen=True)
class Tree:
    """Which Markdown files of a repository are documents."""

    repo: str
    commit: str
    docs_root: str
    examples_root: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _checked(self, commit=bool(re.fullmatch("[0-9a-f]{40}", self.commit)), include=len(self.include) > 0)


@dataclasses.dataclass(frozen=True)
class Training:
    base_model: str
    train_file: str
    output_dir: str
    batch_size: int
    mini_batch_size: int
    learning_rate: float
    warmup_ratio: float
    epochs: float
    weight_decay: float
    eval_steps: int
    use_hard_negatives: bool = True
    train_fraction: float = 1.0
    metric_for_best: str = "ndcg@10"
    fp16: bool = True

    def __post_init__(self) -> None:
        _checked(
            self, batch_size=self.batch_size > 1, mini_batch_size=self.mini_batch_size > 0, learning_rate=self.learning_rate > 0, warmup_ratio=0 <= self.warmup_ratio < 1,
            epochs=self.epochs > 0, weight_decay=self.weight_decay >= 0, eval_steps=self.eval_steps > 0, train_fraction=0 < self.train_fraction <= 1,
        )


def settings(kind: type[S], given: Mapping[str, Any]) -> S:
    """`kind` made of a mapping, such as a parsed YAML file: unknown, missing and wrongly typed names are all named."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    wrong = [f"unknown: {n}" for n in given if n not in fields]
    wrong += [f"missing: {n}" for n, f in fields.items() if n not in given and f.default is dataclasses.MISSING]
    made: dict[str, Any] = {}
    for name, value in given.items():
        want = str(fields[name].type) if name in fields else ""
        if want.startswith("tuple"):
            ok, value = isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value), tuple(value) if isinstance(value, (list, tuple)) else value
        elif want == "float":
            ok = isinstance(value, (int, float)) and not isinstance(value, bool)
        else:
            ok = not want or type(value).__name__ == want
        if not ok:
            wrong.append(f"not {want}: {name}")
        made[name] = value
    if wrong:
        raise ValueError(f"{kind.__name__}: {'; '.join(wrong)}")
    return kind(**made)
