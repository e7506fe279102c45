"""Settings in layers: defaults, a file, the environment, and a profile for what nobody set."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace

from mnestra.operators.retrieval import RecallParams

PREFIX = "MNESTRA_"


@dataclass(frozen=True)
class Settings:
    recall_limit: int = 20
    recall_max_tokens: int = 1024
    recall_budget: str = "mid"
    semantic_alpha: float = 0.1
    cap_per_source: int = 0
    chunk_chars: int = 3000
    initial_messages: int = 300
    tool_field_chars: int = 300
    tool_total_chars: int = 1500
    tool_result_chars: int = 2000
    file_tags: int = 20
    round_facts: int = 50
    batch_facts: int = 8
    twin_threshold: float = 0.97
    semantic_threshold: float = 0.7
    retain_every_turns: int = 1

    def recall(self, now_ms: int) -> RecallParams:
        return RecallParams(limit=self.recall_limit, max_tokens=self.recall_max_tokens, budget=self.recall_budget, semantic_alpha=self.semantic_alpha, cap_per_source=self.cap_per_source, now_ms=now_ms).checked()


#: What a profile fills in where no layer has set a key.
PROFILES: dict[str, dict] = {"coding": {"recall_max_tokens": 2048, "chunk_chars": 6000, "retain_every_turns": 5}}


def load(path: str | None = None, environment: dict[str, str] | None = None, profile: str | None = None) -> Settings:
    """Later layers win; unknown keys and values of the wrong kind raise ValueError."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    given: dict = {}
    if path is not None:
        with open(path, "rb") as file:
            given.update(tomllib.load(file))
    for name, value in (os.environ if environment is None else environment).items():
        if name.startswith(PREFIX):
            given[name[len(PREFIX) :].lower()] = value
    if profile is not None:
        if profile not in PROFILES:
            raise ValueError(f"unknown profile {profile!r}")
        given = PROFILES[profile] | given
    unknown = sorted(set(given) - set(kinds))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    try:
        made = replace(Settings(), **{k: kinds[k](v) for k, v in given.items()})
    except (TypeError, ValueError) as error:
        raise ValueError(f"bad setting: {error}") from error
    made.recall(0)
    return made
