"""Parameters with an effect on results. Lengths count code points."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    group: str = "core"
    label: str = "memloom"
    context_tag: str = "memory-context"
    continuity_tag: str = "memory-continuity"
    memories_tag: str = "relevant-memories"
    inbound_schema: str = "inbound_meta"
    auto_recall: bool = False
    auto_capture: bool = True
    auto_index: bool = True
    index_extensions: tuple[str, ...] = (".md", ".txt")
    recall_max_facts: int = 10
    min_prompt_length: int = 10
    min_text: int = 20
    message_cap: int = 2000
    reset_message_cap: int = 1000
    episode_cap: int = 12_000
    reset_sample: int = 20
    hook_min_messages: int = 4
    hook_min_texts: int = 2
    gap_threshold: int = 3
    continuity_budget: int = 8000
    tail_bytes: int = 128 << 10
    least_remainder: int = 100
    semantic_query_chars: int = 2000
    memory_query_messages: int = 10
    continuity_episodes: int = 20
    file_max_bytes: int = 1 << 20
    file_head_bytes: int = 2048
    excerpt_chars: int = 500
    list_limit: int = 10
    list_max: int = 50
    overfetch: int = 5
    overfetch_max: int = 250
    count_ceiling: int = 10_000


DEFAULT = Config()
